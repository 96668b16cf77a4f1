"""Registered queries of the training-data operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.llm.credentials import credential_lines, redact_findings, redact_hunks, scan_credentials
from diffloom.llm.eval_leaks import find_leaks
from diffloom.llm.nonhandwritten import classify_files
from diffloom.llm.pack_containers import assign_containers, container_fill
from diffloom.llm.reading_level import demanding, grade, profile
from diffloom.llm.split_oversized import piece_checks, split_oversized
from diffloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "diff_lines"), table(spark, d, "dump_options"))


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    return piece_checks(p1_pieces(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).select("changeset_id", "path").distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return scan_credentials(table(spark, d, "hunks"), table(spark, d, "facts_findings"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return credential_lines(p3_redacted(spark, d))


def p3_hunks(spark: SparkSession, d: str) -> DataFrame:
    return redact_hunks(table(spark, d, "hunks"))


def p3_findings(spark: SparkSession, d: str) -> DataFrame:
    return redact_findings(table(spark, d, "facts_findings"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return classify_files(table(spark, d, "files"), table(spark, d, "hunks"), table(spark, d, "skipped_entries"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_classes(spark, d).select("changeset_id", "path")


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return assign_containers(table(spark, d, "documents"), table(spark, d, "containers"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return container_fill(p6_assignment(spark, d), table(spark, d, "containers"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return grade(table(spark, d, "documents"), table(spark, d, "reading_labels"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return demanding(p8_levels(spark, d))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile(p8_levels(spark, d), table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found, "p1_pieces": p1_pieces, "p1_checks": p1_checks, "p3_found": p3_found, "p3_redacted": p3_redacted, "p3_hunks": p3_hunks, "p3_findings": p3_findings, "p5_found": p5_found, "p5_classes": p5_classes,
        "p6_assignment": p6_assignment, "p6_fill": p6_fill, "p7_found": p7_found, "p7_leaks": p7_leaks,
        "p8_found": p8_found, "p8_levels": p8_levels, "p8_profile": p8_profile,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            with l as (select distinct changeset_id, path, hunk_ord, line_ord, coalesce(length(text), 0) + 2 as size from diff_lines),
                 s as (select changeset_id, path, sum(size) as size from l group by changeset_id, path)
            select distinct s.changeset_id, s.path from s join dump_options o on s.changeset_id = o.changeset_id
            where s.size > o.max_chars""",
        "p1_checks": """
            with l as (select distinct changeset_id, path, hunk_ord, line_ord, coalesce(length(text), 0) as n from diff_lines),
                 s as (select changeset_id, path, sum(n)::bigint as chars, sum(n + 2) as size, arg_min(hunk_ord, hunk_ord * 1000000::bigint + line_ord) as first_hunk, arg_min(line_ord, hunk_ord * 1000000::bigint + line_ord) as first_line,
                        arg_max(hunk_ord, hunk_ord * 1000000::bigint + line_ord) as last_hunk, arg_max(line_ord, hunk_ord * 1000000::bigint + line_ord) as last_line from l group by changeset_id, path),
                 o as (select distinct changeset_id, max_chars from dump_options)
            select s.changeset_id, s.path, chars, first_hunk, first_line, last_hunk, last_line, 0::bigint as faults
            from s join o on s.changeset_id = o.changeset_id where s.size > o.max_chars""",
    }
