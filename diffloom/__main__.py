"""Command line: python -m diffloom COMMAND --data FOLDER [--out FOLDER].

The folder holds one Parquet table per name. Results are written as JSON lines or text
to the output folder, else the first rows are shown. Exit codes: 0, 1 for an error, 2
where a score reaches --fail-on-score.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.operators import analyzers as A
from diffloom.operators import scoring as S
from diffloom.plans import documents as D
from diffloom.plans import dumpdiff as DD
from diffloom.plans import profiles as PR
from diffloom.plans import reports as R
from diffloom.queries import _findings
from diffloom.runtime import cut_lineage, table

COMMANDS = ["facts", "pr-body", "risk-report", "results", "dump-diff", "zoom"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="diffloom", description="Reports on change sets")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--data", required=True, help="folder of Parquet tables")
    p.add_argument("--out", help="folder to write to")
    p.add_argument("--profile", help="look at findings of this profile only; auto detects it by change set", choices=["detect", *PR.PROFILE_ANALYZERS])
    p.add_argument("--only", nargs="*", help="flag categories to keep")
    p.add_argument("--exclude", nargs="*", help="flag categories, or globs for dump-diff, to leave out")
    p.add_argument("--include", nargs="*", help="globs for dump-diff")
    p.add_argument("--max-findings", type=int, help="findings of a change set at most, in their order")
    p.add_argument("--max-chars", type=int, help="size of a dump-diff chunk")
    p.add_argument("--finding", nargs="*", default=[], help="ids to zoom into")
    p.add_argument("--fail-on-score", type=int, help="exit with 2 if an overall score is at least this")
    return p


def chosen(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """Files and findings under the options."""
    changes = A.changes_of(table(spark, args.data, "files"), table(spark, args.data, "hunks"))
    found = _findings(changes)
    if args.profile:
        profiles = D.profiles(changes.files) if args.profile == "detect" else changes.files.select("changeset_id", F.lit(args.profile).alias("profile")).distinct()
        found = PR.profile_findings(found, profiles).drop("profile", "place")
    if args.max_findings is not None:
        found = S.limit_findings(found, args.max_findings)
    return changes.files, cut_lineage(found)


def put(df: DataFrame, out: str | None) -> None:
    if out is None:
        df.show(50, truncate=120)
    elif len(df.columns) == 1:
        df.write.mode("overwrite").text(out)
    else:
        df.write.mode("overwrite").json(out)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "dump-diff":
        lines = table(spark, args.data, "diff_lines")
        entries = DD.dump_entries(table(spark, args.data, "files"), lines, args.include, args.exclude)
        if args.max_chars and args.out:
            DD.write_chunks(entries, lines, args.max_chars, args.out)
        else:
            put(DD.patch_lines(entries, lines).orderBy("changeset_id", "path", "hunk_ord", "line_ord"), args.out)
        return 0
    files, found = chosen(spark, args)
    if args.command == "zoom":
        put(D.zoom(found, spark.createDataFrame([(i,) for i in args.finding], "finding_id string")), args.out)
        return 0
    if args.command == "results":
        put(R.result_logs(R.log_results(found)), args.out)
        return 0
    if args.command == "risk-report":
        flags = cut_lineage(S.filter_flags(S.risk_flags(found), args.only, args.exclude))
        report = S.risk_report(flags)
        put(D.risk_documents(report, flags), args.out)
        high = args.fail_on_score is not None and report.where(F.col("overall") >= args.fail_on_score).limit(1).count()
        return 2 if high else 0
    factors = S.risk_factors(found, files)
    scores = S.risk_scores(factors, files)
    put(D.markdown(files, found, scores) if args.command == "pr-body" else D.facts_documents(files, S.domain_findings(found), scores, S.category_aggregates(found, factors)), args.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("diffloom").getOrCreate()
    try:
        return run(spark, args)
    except (ValueError, LookupError) as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
