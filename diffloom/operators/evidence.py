"""Evidence of findings: made from hunks, redacted, ordered, capped, and the best of each category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions.text import redact_secrets, truncate
from diffloom.operators.identity import posix
from diffloom.operators.labels import Changes

# Most pieces of evidence of a finding by its type; all others keep every piece.
CAPS = {"env-var": 3, "cloudflare-change": 3, "security-file": 3, "test-change": 3, "risk-flag": 3, "impact-analysis": 6}
#: What adds to the score of an excerpt: pattern in lower case and points.
SCORES = [("[0-9]+", 10), ("blast radius", 15), ("high", 5), ("critical", 8), ("breaking", 8), ("added|removed|modified", 3), ("^imports module$", -10), ("^depends on", -5)]


def evidence(file: Column, excerpt: Column, line: Column) -> Column:
    """One piece of evidence: file, trimmed and redacted excerpt of bounded length, line."""
    # Unicode blanks are trimmed too.
    trimmed = F.regexp_replace(excerpt, r"^[\s  ]+|[\s  ]+$", "")
    return F.struct(file.alias("file"), truncate(redact_secrets(trimmed)).alias("excerpt"), line.cast("int").alias("line"))


def sort_evidence(pieces: str) -> Column:
    """The array in order of file (case and slashes apart), then line, null lines first."""
    keyed = F.transform(pieces, lambda e: F.struct(F.lower(posix(e["file"])).alias("k"), F.coalesce(e["line"], F.lit(0)).alias("l"), e["file"].alias("file"), e["excerpt"].alias("excerpt"), e["line"].alias("line")))
    return F.transform(F.array_sort(keyed), lambda e: F.struct(e["file"].alias("file"), e["excerpt"].alias("excerpt"), e["line"].alias("line")))


def capped(pieces: str, type_: str) -> Column:
    """The first pieces that a finding of its type keeps."""
    cap = F.coalesce(*[F.when(F.col(type_) == t, F.lit(n)) for t, n in CAPS.items()], F.greatest(F.size(pieces), F.lit(1)))
    return F.when(F.size(pieces) > 0, F.slice(pieces, 1, cap)).otherwise(F.col(pieces))


def evidence_score(excerpt: Column) -> Column:
    """How much an excerpt tells: numbers and words of impact count for it, empty phrases against it."""
    low = F.lower(excerpt)
    out = F.lit(0)
    for pattern, points in SCORES:
        out = out + F.when(low.rlike(pattern), points).otherwise(0)
    return out


def top_evidence(rows: DataFrame, k: int = 3) -> DataFrame:
    """keys, category, place, file, excerpt: the k best pieces of each category, one per file.

    rows: facts_path, category, file, excerpt. Order: score, then file, then excerpt.
    """
    scored = rows.where("file is not null").withColumn("score", evidence_score(F.coalesce("excerpt", F.lit(""))))
    best = scored.groupBy("facts_path", "category", "file").agg(F.min(F.struct((-F.col("score")).alias("s"), F.coalesce("excerpt", F.lit("")).alias("excerpt"))).alias("b"))
    place = F.row_number().over(Window.partitionBy("facts_path", "category").orderBy("b.s", "file"))
    return best.withColumn("place", place).where(F.col("place") <= k).select("facts_path", "category", "place", "file", "b.excerpt")


def finding_evidence(found: DataFrame, changes: Changes) -> DataFrame:
    """changeset_id, finding_id, file, excerpt, line: for every finding the excerpt of the first hunk of its files.

    A finding over several files (its detail lists them) keeps as many as its type allows.
    A file without hunks has an empty excerpt and no line.
    """
    lists = F.col("type").isin("env-var", "cloudflare-change", "security-file", "test-change", "risk-flag", "infra-change", "api-contract-change")
    of = F.when(F.col("file").isNotNull(), F.array("file")).when(lists, F.split("detail", ","))
    cap = F.coalesce(*[F.when(F.col("type") == t, F.lit(n)) for t, n in CAPS.items()], F.lit(2**31 - 1))
    files = found.where("file is not null or detail is not null").select("changeset_id", "finding_id", F.explode(F.slice(of, F.lit(1), cap)).alias("path")).distinct()
    first = changes.rows("excerpt").groupBy("changeset_id", "path").agg(F.min_by(F.struct("name", "kind"), "hunk_ord").alias("e"))
    joined = files.join(first, ["changeset_id", "path"], "left")
    made = evidence(F.col("path"), F.coalesce("e.name", F.lit("")), F.col("e.kind"))
    return joined.select("changeset_id", "finding_id", made.alias("v")).select("changeset_id", "finding_id", "v.*")
