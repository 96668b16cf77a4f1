"""Comparisons of runs: their scopes, findings, flags and scores, and of stored snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diffloom.operators.identity import delta_by_id, stable_hash

# Fields of a scope in the order they are compared.
SCOPE_FIELDS = ["mode", "base", "head", "profile", "include", "exclude"]


class ScopeMismatch(ValueError):
    """Runs of different scope were compared strictly."""


def scope_of(runs: DataFrame) -> DataFrame:
    """Runs with mode, base, head as a scope: an absent mode is branch where a base is named, else unstaged; empty refs are null."""
    mode = F.coalesce("mode", F.when(F.coalesce("base", F.lit("")) != "", "branch").otherwise("unstaged"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return runs.withColumns({"mode": mode, "base": blank("base"), "head": blank("head")})


def scope_messages(warnings: DataFrame) -> DataFrame:
    """Rows of identity.scope_warnings (field, before, after) with a code and a sentence."""
    text = lambda c: F.coalesce(c, F.lit("null"))
    said = F.concat(F.lit("Previous run used "), "field", F.lit("="), text("before"), F.lit(", current is "), "field", F.lit("="), text("after"))
    return warnings.withColumn("code", F.lit("scope-mismatch")).withColumn("message", said)


def require_equal_scopes(warnings: DataFrame, shown: int = 20) -> None:
    """Raise ScopeMismatch if there is any warning; the message names the first ones."""
    rows = scope_messages(warnings).select("message").limit(shown).collect()
    if rows:
        raise ScopeMismatch("Scope mismatch detected: " + "; ".join(r.message for r in rows))


def delta_counts(delta: DataFrame, key: str, change: str = "change") -> DataFrame:
    """key, added, removed, changed: numbers of each kind of change."""
    return delta.groupBy(key).agg(*[F.count_if(F.col(change) == c).alias(c) for c in ("added", "removed", "changed")])


def risk_delta(flags: DataFrame, scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """newer, older, score_from, score_to, score_delta, added, removed, changed of pairs of change sets.

    flags: changeset_id, flag_id, effective_score; scores: changeset_id, overall. A
    change set without flags has score 0. Flags are compared by id.
    """
    side = lambda at: pairs.join(flags.select(F.col("changeset_id").alias(at), "flag_id", "effective_score"), at).select("newer", "older", "flag_id", "effective_score")
    delta = delta_by_id(side("older"), side("newer"), ["newer", "older", "flag_id"], "effective_score")
    counts = delta.groupBy("newer", "older").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")])
    score = lambda at, name: scores.select(F.col("changeset_id").alias(at), F.col("overall").alias(name))
    out = pairs.join(score("older", "score_from"), "older", "left").join(score("newer", "score_to"), "newer", "left").join(counts, ["newer", "older"], "left")
    zero = lambda c, t="int": F.coalesce(c, F.lit(0)).cast(t).alias(c)
    rows = out.select("newer", "older", zero("score_from"), zero("score_to"), *[zero(c, "long") for c in ("added", "removed", "changed")])
    return rows.withColumn("score_delta", F.col("score_to") - F.col("score_from"))


def files_delta(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """newer, older, path, change (added, removed, changed) of the files (changeset_id, path, token) of two snapshots.

    The token is a content hash where one is known, else the status.
    """
    side = lambda at: pairs.join(files.select(F.col("changeset_id").alias(at), "path", "token"), at).select("newer", "older", "path", "token")
    return delta_by_id(side("older"), side("newer"), ["newer", "older", "path"], "token")


def consecutive(sets: DataFrame) -> DataFrame:
    """newer, older: every change set with the one before it by id; ids meet in hash buckets of prefixes, no global sort."""
    ids = sets.select("changeset_id").where("changeset_id is not null").distinct()
    # Neighbours within a prefix come from a window; the last of a prefix meets the first of the next one in a table of prefixes.
    at = F.substring("changeset_id", 1, 5)
    inside = Window.partitionBy("p").orderBy("changeset_id")
    near = ids.withColumn("p", at).withColumn("older", F.lag("changeset_id").over(inside))
    ends = near.groupBy("p").agg(F.min("changeset_id").alias("first"), F.max("changeset_id").alias("last"))
    # One row per prefix of five characters: a bounded table.
    edge = ends.withColumn("before", F.lag("last").over(Window.orderBy("p"))).where("before is not null").select(F.col("first").alias("newer"), F.col("before").alias("older"))
    return near.where("older is not null").select(F.col("changeset_id").alias("newer"), "older").unionByName(edge)


# --- snapshot store -------------------------------------------------------------------


def snapshot_id(head: Column, staged: Column, unstaged: Column, manifest: Column) -> Column:
    """The id of a snapshot from what it captures."""
    return stable_hash(F.concat_ws(":", *[F.coalesce(c, F.lit("")) for c in (head, staged, unstaged, manifest)]))


def save_snapshot(table: DataFrame, store: str, kind: str, ident: str) -> None:
    """Write one table (findings, flags or files) of a snapshot; saving the same id again replaces it."""
    table.write.mode("overwrite").parquet(f"{store}/kind={kind}/snapshot_id={ident}")


def show_snapshot(spark: SparkSession, store: str, kind: str, ident: str) -> DataFrame:
    """One table of a snapshot; an unknown id raises."""
    return spark.read.parquet(f"{store}/kind={kind}/snapshot_id={ident}")


def list_snapshots(runs: DataFrame) -> DataFrame:
    """snapshot_id, created_at of saved snapshots, the newest first, by id where times are equal."""
    return runs.select("snapshot_id", "created_at").distinct().orderBy(F.desc("created_at"), "snapshot_id")
