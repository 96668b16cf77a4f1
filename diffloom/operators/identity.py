"""Stable identities of findings and flags, order, deduplication and comparison by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_hash(text: Column, length: int = 12) -> Column:
    """The first hexadecimal characters of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, length)


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def finding_id(type_: Column, fingerprint: Column) -> Column:
    return F.concat(F.lit("finding."), type_, F.lit("#"), stable_hash(fingerprint))


def flag_id(rule_key: Column, finding_ids: Column) -> Column:
    """The id of a flag; the order of its findings does not matter."""
    return F.concat(F.lit("flag."), rule_key, F.lit("#"), stable_hash(F.concat(rule_key, F.lit(":"), F.array_join(F.array_sort(finding_ids), ","))))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by order (nulls least); rows with a null key are left out."""
    kept = rows
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    rest = [c for c in rows.columns if c not in keys]
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def sort_rank(findings: DataFrame) -> DataFrame:
    """findings with sort_rank: their place within a snapshot by type, first evidence path (none first), line, row_id."""
    path = F.lower(posix(F.get("evidence", F.lit(0)).getField("file")))
    line = F.coalesce(F.get("evidence", F.lit(0)).getField("line"), F.lit(0))
    order = Window.partitionBy("facts_path").orderBy("finding_type", F.coalesce(path, F.lit("")), line, "row_id")
    return findings.withColumn("sort_rank", F.row_number().over(order))


def delta_by_id(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, change (added, removed, changed) of two sets of rows with one row per key."""
    b, a = (d.select(*keys, F.col(value).alias(n), F.lit(True).alias(f"has_{n}")) for d, n in ((before, "old"), (after, "new")))
    both = b.join(a, keys, "full")
    change = F.when(F.col("has_old").isNull(), "added").when(F.col("has_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def scope_warnings(runs: DataFrame, pairs: DataFrame, fields: list[str]) -> DataFrame:
    """facts_path, field, before, after: scope fields in which a run differs from the run it is compared with."""
    one = last_wins(runs.select("facts_path", *fields, "loaded_at"), ["facts_path"], ["loaded_at"])
    new = one.select(F.col("facts_path").alias("newer"), *[F.col(f).alias(f"n_{f}") for f in fields])
    old = one.select(F.col("facts_path").alias("older"), *[F.col(f).alias(f"o_{f}") for f in fields])
    joined = pairs.join(new, "newer").join(old, "older")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("before"), F.col(f"n_{f}").alias("after")) for f in fields])
    return joined.select(F.col("newer").alias("facts_path"), F.explode(rows).alias("w")).select("facts_path", "w.*").where("not (before <=> after)")
