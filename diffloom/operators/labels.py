"""What the rules of all analyzers find in the text of hunks, as small labels.

A rule has a path gate and an expression that makes labels of one hunk. All wanted rules
are evaluated in one projection over the hunks, behind their gates, so texts are read
once and never shuffled; repeated hunks fall together when their labels do. A label is
(rule, kind, name, more, side); side is 1 for added, 2 for deleted and 3 for all lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.runtime import cut_lineage
from diffloom.sources.changesets import change_files

TEXTS = {1: "add_text", 2: "del_text", 3: "all_text"}
KEYS = ["changeset_id", "path"]
_LABEL = "array<struct<rule:string,kind:string,name:string,more:string,side:int>>"


def lit(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_path(gate: list[str]) -> str:
    return "(" + " or ".join(f"path rlike {lit(g)}" for g in gate) + ")"


def label(rule: str, kind: str = "''", name: str = "''", more: str = "''", side: int = 0) -> str:
    """A label; kind, name and more are SQL expressions."""
    return f"named_struct('rule', {lit(rule)}, 'kind', {kind}, 'name', {name}, 'more', {more}, 'side', {side})"


def marks(rule: str, patterns: dict[str, str], side: int, kind: str = "") -> str:
    """A label named after every pattern that the lines of a side match."""
    return "array_compact(array(" + ", ".join(f"case when {TEXTS[side]} rlike {lit(p)} then {label(rule, lit(kind), lit(n), side=side)} end" for n, p in patterns.items()) + "))"


def names(rule: str, pattern: str, side: int, kind: str = "", group: int = 1) -> str:
    """A label for every distinct thing that the pattern's group matches in the lines of a side."""
    return f"transform(array_distinct(regexp_extract_all({TEXTS[side]}, {lit(pattern)}, {group})), n -> {label(rule, lit(kind), 'n', side=side)})"


def both_sides(rule: str, patterns: dict[str, str]) -> str:
    """names of every kind of pattern in added and in deleted lines."""
    return "concat(" + ", ".join(names(rule, p, side, kind) for kind, p in patterns.items() for side in (1, 2)) + ")"


@dataclass(frozen=True)
class Rule:
    """A path gate and the labels of a hunk behind it, as an SQL expression of an array."""

    gate: list[str]
    labels: str


@dataclass
class Changes:
    """Hunks of change sets under rules. files: changeset_id, path, status; hunks as delivered;
    with_sources: whether nested source texts are read for findings too."""

    files: DataFrame
    hunks: DataFrame
    rules: dict[str, Rule]
    kept: DataFrame | None = None
    with_sources: bool = True

    def texts(self) -> DataFrame:
        """Hunks with their lines joined; null arrays are empty and null lines are left out of them."""
        lines = lambda c: f"coalesce(filter({c}, x -> x is not null), cast(array() as array<string>)) as {c}"
        start = "new_start" if "new_start" in self.hunks.columns else "cast(null as int) as new_start"
        plain = self.hunks.where("changeset_id is not null and path is not null").selectExpr(*KEYS, "hunk_ord", start, lines("additions"), lines("deletions"))
        return plain.selectExpr("*", r"array_join(additions, '\n') as add_text", r"array_join(deletions, '\n') as del_text", r"array_join(concat(additions, deletions), '\n') as all_text")

    def _labelled(self, wanted: list[str]) -> DataFrame:
        rules = [self.rules[n] for n in wanted]
        gates = list(dict.fromkeys(g for r in rules for g in r.gate))
        each = ", ".join(f"case when {any_path(r.gate)} then cast({r.labels} as {_LABEL}) end" for r in rules)
        rows = self.texts().where(any_path(gates)).selectExpr(*KEYS, "hunk_ord", f"explode(flatten(array_compact(array({each})))) as label")
        return rows.select(*KEYS, "hunk_ord", "label.*").distinct()

    def rows(self, *wanted: str) -> DataFrame:
        """changeset_id, path, hunk_ord, rule, kind, name, more, side of some rules, distinct."""
        if self.kept is not None:
            return self.kept.where(F.col("rule").isin(*wanted))
        return self._labelled(list(wanted))

    def counts(self) -> DataFrame:
        """changeset_id, path, hunk_ord, additions, deletions: numbers of lines, one row per hunk."""
        return self.rows("lines").select(*KEYS, "hunk_ord", F.col("kind").cast("int").alias("additions"), F.col("name").cast("int").alias("deletions"))

    def keep(self) -> Changes:
        """The same with the labels of all rules written as one table, for plans that need many of them."""
        kept = cut_lineage(self._labelled(list(self.rules)))
        return Changes(cut_lineage(self.files), self.hunks, self.rules, kept)


def listed_files(files: DataFrame) -> DataFrame:
    """changeset_id, path, status of the files of change sets; an unknown status counts as modified."""
    return change_files(files).select(*KEYS, F.coalesce("status", F.lit("modified")).alias("status"))
