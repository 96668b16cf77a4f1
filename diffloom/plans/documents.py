"""Documents assembled from the tables of findings, scores and flags.

Every document of a change set holds bounded parts only: counts, the thirteen
categories, a handful of actions and the first findings. Findings and results
themselves come out as one JSON line each, so no change set is gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.operators import paths as P
from diffloom.plans.reports import ACTIONS, HIGHLIGHTS, actions, highlights
from diffloom.plans.sections import section_lines, section_texts

# Markers of a project's framework in the order they are tried.
PROFILES = [
    ("sveltekit", [r"^src/routes/"], "high"),
    ("stencil", [r"^stencil\.config\.[tj]s$"], "high"),
    ("next", [r"^next\.config\.", r"^(src/)?app/.*page\.[tj]sx?$"], "medium"),
    ("vue", [r"\.vue$"], "medium"),
    ("astro", [r"^astro\.config\.", r"\.astro$"], "medium"),
    ("angular", [r"^angular\.json$", r"^\.angular-cli\.json$"], "medium"),
    ("vite", [r"^vite\.config\."], "medium"),
    ("python", [r"^(pyproject\.toml|setup\.py|requirements\.txt|Pipfile|poetry\.lock|manage\.py)$"], "medium"),
]


def profiles(files: DataFrame) -> DataFrame:
    """changeset_id, profile, confidence: the first framework a change set has a marker of, else auto."""
    flags = files.groupBy("changeset_id").agg(*[F.bool_or(P.any_of(F.col("path"), markers)).alias(name) for name, markers, _ in PROFILES])
    pick = lambda values, rest: F.coalesce(*[F.when(F.col(name), F.lit(v)) for (name, _, _), v in zip(PROFILES, values)], F.lit(rest))
    return flags.select("changeset_id", pick([p[0] for p in PROFILES], "auto").alias("profile"), pick([p[2] for p in PROFILES], "low").alias("confidence"))


def finding_lines(found: DataFrame) -> DataFrame:
    """changeset_id, finding_id, json: one JSON object per finding, null fields left out."""
    return found.select("changeset_id", "finding_id", F.to_json(F.struct(F.col("finding_id").alias("findingId"), "type", "category", "file", "name", "detail", "change", "risk")).alias("json"))


def _bounded(rows: DataFrame, item: Column, order: list[Column], k: int, name: str) -> DataFrame:
    """changeset_id and an array of the first k items; at most k rows of a change set are gathered."""
    place = F.row_number().over(Window.partitionBy("changeset_id").orderBy(*order))
    return rows.withColumn("_p", place).where(F.col("_p") <= k).groupBy("changeset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_p"), item.alias("v")))), lambda x: x["v"]).alias(name))


def facts_documents(files: DataFrame, found: DataFrame, scores: DataFrame, aggregates: DataFrame, first: int = 20) -> DataFrame:
    """changeset_id, json: summary, score, categories, actions, highlights and the first findings of a change set."""
    stats = files.groupBy("changeset_id").agg(F.count("*").alias("files"))
    n = found.groupBy("changeset_id").agg(F.count("*").alias("findings"))
    c = F.col
    parts = [
        _bounded(aggregates, F.struct("category", "findings", F.col("risk_weight").alias("riskWeight")), [c("place")], 13, "categories"),
        _bounded(actions(found), F.struct("action", "category", "blocking", "reason"), [c("place")], len(ACTIONS), "actions"),
        _bounded(highlights(found), c("highlight"), [F.col("place")], len(HIGHLIGHTS), "highlights"),
        _bounded(found, F.struct(c("finding_id").alias("findingId"), "type", "category", "file", "name"), [c("type"), F.coalesce("file", F.lit("")), c("finding_id")], first, "firstFindings"),
    ]
    out = stats.join(n, "changeset_id", "left").join(scores, "changeset_id", "left")
    for p in parts:
        out = out.join(p, "changeset_id", "left")
    body = F.struct(F.lit("2.1").alias("schemaVersion"), F.struct("files", F.coalesce("findings", F.lit(0)).alias("findings")).alias("summary"), F.struct("score", "level").alias("risk"), "categories", "actions", "highlights", "firstFindings", F.greatest(F.lit(0), F.coalesce("findings", F.lit(0)) - first).alias("findingsNotListed"))
    return out.select("changeset_id", F.to_json(body).alias("json"))


def markdown(files: DataFrame, found: DataFrame, scores: DataFrame) -> DataFrame:
    """changeset_id, markdown: title, files by category, highlights, every section of findings and the score."""
    by_category = files.groupBy("changeset_id", P.category(F.col("path")).alias("category")).agg(F.count("*").alias("n"))
    cats = _bounded(by_category, F.format_string("| %s | %d |", "category", "n"), [F.desc("n"), F.col("category")], len(P.CATEGORIES) + 1, "rows")
    tops = _bounded(highlights(found), F.concat(F.lit("- "), F.col("highlight")), [F.col("place")], len(HIGHLIGHTS), "tops")
    joined = cats.join(tops, "changeset_id", "left").join(section_texts(section_lines(found)), "changeset_id", "left").join(scores, "changeset_id", "left")
    empty = F.array().cast("array<string>")
    text = F.concat_ws(
        "\n",
        F.lit("## Summary"), F.lit(""), F.lit("| category | files |"), F.lit("|-|-|"), F.array_join("rows", "\n"), F.lit(""), F.lit("## What to look at"), F.lit(""),
        F.array_join(F.coalesce("tops", empty), "\n"), F.lit(""), F.concat("text", F.lit("\n")), F.format_string("**Risk:** %s (%d/100)", "level", "score"),
    )
    return joined.select("changeset_id", text.alias("markdown"))


def result_lines(results: DataFrame) -> DataFrame:
    """changeset_id, json: result-log results, one JSON object each."""
    location = F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation")).alias("physicalLocation")))
    body = F.struct(F.col("rule_id").alias("ruleId"), "level", location.alias("locations"), F.struct(F.col("finding_id").alias("findingId")).alias("partialFingerprints"))
    return results.select("changeset_id", F.to_json(body).alias("json"))


class UnknownId(LookupError):
    """An id names no finding or flag."""


def zoom(rows: DataFrame, ids: DataFrame, key: str = "finding_id") -> DataFrame:
    """Findings (or, with key flag_id, flags) by their ids; an id that names none raises UnknownId with the first such ids."""
    wanted = ids.select(key).distinct()
    lost = [r[key] for r in wanted.join(rows.select(key), key, "left_anti").limit(10).collect()]
    if lost:
        raise UnknownId(f"unknown {key}: {', '.join(map(str, lost))}")
    return rows.join(wanted, key, "left_semi")


def risk_documents(report: DataFrame, flags: DataFrame, k: int = 50) -> DataFrame:
    """changeset_id, json, markdown, text of the categorical score: overall, level and the k weightiest flags, with how many more there are."""
    item = F.struct(F.col("rule_key").alias("ruleKey"), F.col("flag_category").alias("category"), F.col("effective_score").alias("effectiveScore"), F.col("flag_id").alias("flagId"), "findings")
    first = _bounded(flags, item, [F.desc("effective_score"), F.col("flag_category"), F.col("rule_key"), F.col("flag_id")], k, "first")
    rows = report.join(first, "changeset_id", "left").withColumn("more", F.greatest(F.lit(0), F.col("flags") - k))
    body = F.struct(F.lit("1.0").alias("schemaVersion"), F.col("overall").alias("riskScore"), F.col("level").alias("riskLevel"), F.col("first").alias("flags"), F.col("more").alias("flagsNotListed"))
    lines = F.transform("first", lambda x: F.format_string("- **%s** (%s): +%d", x["ruleKey"], x["category"], x["effectiveScore"]))
    more = F.when(F.col("more") > 0, F.format_string("- (+%d more)", "more"))
    md = F.concat_ws("\n", F.format_string("# Risk: %d/100 (%s)", "overall", "level"), F.lit(""), F.array_join(lines, "\n"), more)
    text = F.concat_ws("\n", F.format_string("%s %d/100", F.upper("level"), "overall"), F.array_join(F.transform("first", lambda x: F.format_string("  %s +%d", x["ruleKey"], x["effectiveScore"])), "\n"), more)
    return rows.select("changeset_id", F.to_json(body).alias("json"), md.alias("markdown"), text.alias("text"))
