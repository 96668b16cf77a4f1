import json

import pytest
from pyspark.sql import functions as F

from diffloom.plans import documents as D
from diffloom.plans import reports as R
from diffloom.plans import sections as SE
from diffloom.operators import scoring as S
from diffloom.streaming.changes import analyze_batches, windowed_stats

FOUND = "changeset_id string, type string, category string, file string, name string, detail string, change string, risk string, n_files long, fingerprint string, finding_id string"
FILES = "changeset_id string, path string, status string"


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        ("c", "db-migration", "database", None, "supabase", "DROP TABLE", None, "high", 1, "a", "f1"), ("c", "env-var", "config_env", None, "K", "x.ts", "added", None, 1, "b", "f2"), ("c", "dependency-change", "dependencies", "p", "react", None, "major", None, 1, "d", "f3"),
        ("e", "risk-flag", "infra", None, "r", None, None, "medium", 1, "e", "f4"), ("e", "sql-risk", "database", "m.sql", None, None, None, "destructive", 1, "g", "f5"),
    ]
    return spark.createDataFrame(rows, FOUND)


def test_actions_and_highlights(spark, found):
    rows = sorted((r.changeset_id, r.place, r.action, r.blocking) for r in R.actions(found).collect())
    assert rows == [("c", 1, "apply-migrations", True), ("c", 2, "backup-db", True), ("c", 3, "run-tests", True), ("c", 4, "review-dependencies", False), ("c", 5, "update-env-docs", False), ("e", 1, "run-tests", True)]
    kit = R.actions(found, spark.createDataFrame([("e", "sveltekit")], "changeset_id string, profile string"))
    assert ("e", "sveltekit-check") in {(r.changeset_id, r.action) for r in kit.collect()}
    told = {(r.changeset_id, r.place): r.highlight for r in R.highlights(found).collect()}
    assert told == {("c", 1): "Database migrations (HIGH RISK)", ("c", 2): "1 major dependency update(s)", ("c", 3): "1 new environment variable(s)", ("e", 1): "Destructive SQL detected in 1 file(s)"}
    assert R.actions(found.where("false")).count() == 0 and R.highlights(found.where("false")).count() == 0
    plain = found.where("type = 'risk-flag'")
    assert [r.highlight for r in R.highlights(plain).collect()] == ["1 finding(s) detected"]


def test_scores_flags_and_documents(spark, found):
    files = spark.createDataFrame([("c", "src/a.ts", "modified"), ("e", "docs/x.md", "added"), ("z", "docs/y.md", "added"), ("z", "tests/y.ts", "added")], FILES)
    factors = S.risk_factors(found, files)
    scores = {r.changeset_id: (r.score, r.level) for r in S.risk_scores(factors, files).collect()}
    assert scores == {"c": (50, "high"), "e": (5, "low"), "z": (0, "low")}
    flags = S.risk_flags(found)
    assert {(r.changeset_id, r.rule_key, r.effective_score) for r in flags.collect()} == {("c", "db.migrations_changed", 10), ("c", "deps.major_version_bump", 23), ("e", "db.destructive_sql", 41)}
    assert {r.changeset_id: r.overall for r in S.risk_report(flags).collect()} == {"c": 18, "e": 30}
    docs = D.facts_documents(files, found, S.risk_scores(factors, files), S.category_aggregates(found, factors))
    one = {r.changeset_id: json.loads(r.json) for r in docs.collect()}
    assert set(one) == {"c", "e", "z"} and one["c"]["risk"]["score"] == 50 and len(one["c"]["firstFindings"]) == 3
    assert one["c"]["categories"][0]["category"] == "database"
    text = {r.changeset_id: r.markdown for r in D.markdown(files, found, S.risk_scores(factors, files)).collect()}
    assert "| product | 1 |" in text["c"] and "**Risk:** high (50/100)" in text["c"]
    assert "## Database migrations" in text["c"] and "## SQL risks" in text["e"]
    results = R.log_results(found)
    assert {r.rule_id for r in results.collect()} == {"CS001", "CS003", "CS004", "CS014"}
    assert all("ruleId" in json.loads(r.json) for r in D.result_lines(results).collect())
    logs = {r.changeset_id: json.loads(r.json) for r in R.result_logs(results).collect()}
    run = logs["c"]["runs"][0]
    assert [x["id"] for x in run["tool"]["driver"]["rules"]] == ["CS001", "CS003", "CS004"] and len(run["results"]) == 3
    assert [(r.finding_id, r.type) for r in D.zoom(found, spark.createDataFrame([("f5",)], "finding_id string")).collect()] == [("f5", "sql-risk")]
    with pytest.raises(D.UnknownId, match="none"):
        D.zoom(found, spark.createDataFrame([("f5",), ("none",)], "finding_id string"))
    report = {r.changeset_id: r for r in D.risk_documents(S.risk_report(flags), flags, k=1).collect()}
    assert json.loads(report["c"].json)["flagsNotListed"] == 1 and "(+1 more)" in report["c"].markdown and report["e"].text.startswith("MODERATE 30/100")


def test_sections_keep_a_count_of_the_rest(spark):
    rows = [("c", "env-var", "config_env", None, f"K{i:02}", "x.ts", "added", None, 1, "b", f"f{i}") for i in range(14)]
    lines = SE.section_lines(spark.createDataFrame(rows, FOUND)).orderBy("place").collect()
    assert len(lines) == 11 and lines[-1].line == "(+4 more)" and lines[0].line == "`K00` in x.ts" and lines[0].title == "Config / Env"


def test_streaming(spark, tmp_path):
    rows = [("c", "a", 0, ["x"], None, "2024-01-01 00:01:00"), ("c", "a", 0, ["x"], None, "2024-01-01 00:02:00"), ("c", "b", 0, None, ["y", "z"], "2024-01-01 00:12:00"), ("d", "a", 0, [], [], "2024-01-01 02:00:00")]
    schema = "changeset_id string, path string, hunk_ord int, additions array<string>, deletions array<string>, arrived_at string"
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).withColumn("arrived_at", F.to_timestamp("arrived_at")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = windowed_stats(stream).writeStream.format("memory").queryName("stats").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(str(r.window_start)[11:16], r.changeset_id): (r.hunks, r.additions, r.deletions) for r in spark.sql("select * from stats").collect()}
    assert got.get(("00:00", "c")) == (1, 1, 0) and got.get(("00:10", "c")) == (1, 0, 2)
    out = str(tmp_path / "out")
    analyze_batches(stream, lambda b: b.groupBy("path").count(), out, str(tmp_path / "ck")).awaitTermination(60)
    assert {r.path: r["count"] for r in spark.read.parquet(out).collect()} == {"a": 3, "b": 1}
