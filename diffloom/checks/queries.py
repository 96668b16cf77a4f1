"""Every rule query once more, over made-up hunks of well-known configuration, schema and route files.

The delivered change sets touch few such files. Their queries have the prefix made_up_, and
no finding or report of the delivered change sets reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom import queries as core
from diffloom.checks.blobs import template_blobs
from diffloom.checks.templates import template_hunks, template_sql
from diffloom.functions.code_reader import source_changes
from diffloom.operators import analyzers as A
from diffloom.operators.labels import Changes
from diffloom.oracle import prelude
from diffloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def made_up(s: SparkSession, d: str) -> Changes:
    """The made-up hunks as change sets."""
    hunks = template_hunks(table(s, d, "hunks"))
    files = hunks.groupBy("changeset_id", "path").agg(F.min_by("status", "hunk_ord").alias("status"))
    return Changes(files, hunks.drop("status"), A.RULES, with_sources=False)


def made_up_source_changes(s: SparkSession, d: str) -> DataFrame:
    """Routes, component members, exports and translation keys read from both sides of made-up source files."""
    return source_changes(template_blobs(table(s, d, "files")))


def queries() -> dict[str, Query]:
    over = lambda query: lambda s, d: query(made_up(s, d))
    return {f"made_up_{name}": over(query) for name, (query, _) in core.RULE_QUERIES.items()} | {"made_up_source_changes": made_up_source_changes}


def oracle_sql() -> dict[str, str]:
    head = prelude(template_sql())
    return {f"made_up_{name}": head + "\n" + sql for name, (_, sql) in core.RULE_QUERIES.items() if sql is not None}
