from diffloom.operators import paths as P
from diffloom.operators.chunks import chunk_by_budget
from diffloom.sources import changesets as C
from pyspark.sql import functions as F

PATCH = """diff --git a/x.sql b/x.sql
index 1..2 100644
--- a/x.sql
+++ b/x.sql
@@ -1,3 +1,3 @@ note
 keep
--- gone comment
+++ new line
\\ No newline at end of file
@@ -10 +10,2 @@
 ctx
+more
diff --git a/old.txt b/old.txt
deleted file mode 100644
--- a/old.txt
+++ /dev/null
@@ -1 +0,0 @@
-bye
diff --git a/p.txt b/q.txt
similarity index 100%
rename from p.txt
rename to q.txt
diff --git a/n.txt b/n.txt
--- /dev/null
+++ b/n.txt
@@ -0,0 +1 @@
+hi"""


def test_parse_patch(spark):
    lines = spark.createDataFrame([("c", i, t) for i, t in enumerate(PATCH.split("\n"))], "changeset_id string, line_no int, text string")
    got = sorted((r.path, r.status, r.hunk_ord, r.line_ord, r.kind, r.old_no, r.new_no, r.text) for r in C.parse_patch(lines).collect())
    assert got == sorted([
        ("x.sql", "modified", 0, 0, "ctx", 1, 1, "keep"), ("x.sql", "modified", 0, 1, "del", 2, None, "-- gone comment"), ("x.sql", "modified", 0, 2, "add", None, 2, "++ new line"),
        ("x.sql", "modified", 1, 0, "ctx", 10, 10, "ctx"), ("x.sql", "modified", 1, 1, "add", None, 11, "more"), ("old.txt", "deleted", 0, 0, "del", 1, None, "bye"), ("n.txt", "added", 0, 0, "add", None, 1, "hi"),
    ])
    assert C.parse_patch(lines.where("false")).count() == 0


def test_name_status_and_num_stat(spark):
    rows = [("c", 1, "M\ta b.ts"), ("c", 2, "R100\told\tnew"), ("c", 3, "T\tz"), ("c", 4, ""), ("c", 5, None), ("c", 6, "D\tx")]
    df = spark.createDataFrame(rows, "changeset_id string, line_no int, text string")
    assert sorted((r.status, r.path, r.old_path) for r in C.parse_name_status(df).collect()) == [("deleted", "x", None), ("modified", "a b.ts", None), ("renamed", "new", "old")]
    assert C.parse_name_status(df, keep_all=True).count() == 4
    stats = spark.createDataFrame([("c", "3\t4\tx"), ("c", "-\t-\tb.png"), ("c", "junk"), ("c", None)], "changeset_id string, text string")
    assert sorted((r.path, r.added, r.removed, r.is_binary) for r in C.parse_num_stat(stats).collect()) == [("b.png", 0, 0, True), ("x", 3, 4, False)]


def test_files_and_hunks_with_nulls_and_repeats(spark):
    files = spark.createDataFrame([("c", 0, "a", "A", None, 9)] * 2 + [("c", 1, "b", None, None, 9), ("c", 2, None, "M", None, 9), ("c", 3, "d", "weird", "x", 9)], "changeset_id string, ord int, path string, status string, old_path string, hunk_ord int")
    assert sorted((r.path, r.status) for r in C.change_files(files).collect()) == [("a", "added"), ("b", None), ("d", None)]
    hunks = spark.createDataFrame([(1, "c", "a", 0, 0, 0, 1, 2, None, ["x", None], None, "s")] * 2, "hunk_id long, changeset_id string, path string, hunk_ord int, old_start int, old_lines int, new_start int, new_lines int, content string, additions array<string>, deletions array<string>, status string")
    one = C.change_hunks(hunks).collect()
    assert len(one) == 1 and one[0].additions == ["x"] and one[0].deletions == []
    assert C.hunk_body(C.change_hunks(hunks)).count() == 0
    assert [r.status for r in C.with_status(C.change_hunks(hunks), C.change_files(files)).collect()] == ["added"]
    texts = spark.createDataFrame([("c", "a", "x\ny\n"), ("c", "b", ""), ("c", "d", None)], "changeset_id string, path string, content string")
    assert sorted((r.path, len(r.additions)) for r in C.untracked_hunks(texts).collect()) == [("a", 3), ("b", 1)]


def test_globs_and_decisions(spark):
    df = spark.createDataFrame([("pnpm-lock.yaml",), ("a/b/yarn.lock",), ("src/x.d.ts",), ("src/dist/y.js",), ("src/app.ts",), ("docs/.hid/x.md",)], "path string")
    by = lambda **k: {r.path: r.d for r in df.select("path", P.path_decision(F.col("path"), **k).alias("d")).collect()}
    assert by() == {"pnpm-lock.yaml": "excluded-by-default", "a/b/yarn.lock": "excluded-by-default", "src/x.d.ts": "excluded-by-default", "src/dist/y.js": "excluded-by-default", "src/app.ts": "keep", "docs/.hid/x.md": "keep"}
    got = by(include=["src/**", "*.yaml"], exclude=["**/*.{js,md}"])
    assert got == {"pnpm-lock.yaml": "keep", "a/b/yarn.lock": "not-included", "src/x.d.ts": "keep", "src/dist/y.js": "excluded-by-glob", "src/app.ts": "keep", "docs/.hid/x.md": "excluded-by-glob"}
    cats = {r.path: r.c for r in df.select("path", P.category(F.col("path")).alias("c")).collect()}
    assert cats["src/app.ts"] == "product" and cats["pnpm-lock.yaml"] == "dependencies" and cats["docs/.hid/x.md"] == "docs"


def test_chunks(spark):
    sizes = [5, 4, 3, 20, 2, 2, 9]
    df = spark.createDataFrame([("c", f"p{i}", s) for i, s in enumerate(sizes)] + [("d", "x", None), (None, "y", 1)], "changeset_id string, path string, size long")
    got = sorted((r.changeset_id, r.path, r.chunk) for r in chunk_by_budget(df, 10).collect())
    assert got == [("c", f"p{i}", k) for i, k in enumerate([0, 0, 1, 2, 3, 3, 4])] + [("d", "x", 0)]
    assert chunk_by_budget(df.where("false"), 10).count() == 0


def test_findings_hold_every_analyzer(spark):
    from diffloom.functions.code_reader import source_changes
    from diffloom.operators import analyzers as A
    from diffloom.operators import scoring as S
    from diffloom.checks.blobs import template_blobs

    lines = {
        "api/routes.py": (["from fastapi import APIRouter", "@router.get('/items')"], []), "a/schema.graphql": (["type Item {"], ["enum Old {"]), "prisma/schema.prisma": (["model A {"], []), "db/x.schema.ts": (["export const t = pgTable('t'"], []),
        "tsconfig.json": (['"strict": true'], []), "Dockerfile": (["FROM a:2"], ["FROM a:1"]), "src/routers/item.ts": (["all: publicProcedure.query("], ["x = useQuery("]), "src/A.svelte": (["let a = $state(1)"], []),
        "src/socket.ts": (["s.on('open'"], []), "locales/de/a.json": (['"k": "v"'], []), "src/a.module.css": ([".a {"], []), "next.config.js": (["experimental: {}"], []), "app/page.tsx": (["'use client'"], ["'use server'"]),
    }
    schema = "changeset_id string, path string, hunk_ord int, status string, additions array<string>, deletions array<string>"
    rows = spark.createDataFrame([("c", p, 0, "modified", a, d) for p, (a, d) in lines.items()], schema)
    changes = A.Changes(rows.select("changeset_id", "path", "status"), rows, A.RULES)
    files = rows.select("changeset_id", "path", "status", F.lit(None).cast("string").alias("old_path"))
    found = S.findings(files, changes, source_changes(template_blobs(files.crossJoin(spark.range(40).select(F.col("id").cast("string").alias("n"))).withColumn("changeset_id", F.col("n"))))).select("type", "fingerprint", "finding_id").collect()
    wanted = {"graphql-change", "prisma-schema", "drizzle-schema", "typescript-config", "docker-change", "trpc-router", "tanstack-query", "svelte5-runes", "websocket-change", "i18n-change", "css-change", "next-config-change", "rsc-boundary",
              "angular-component-change", "stencil-component-change", "stencil-prop-change", "stencil-event-change", "stencil-method-change", "stencil-slot-change", "package-exports"}
    assert wanted <= {r.type for r in found} and all(r.fingerprint and r.finding_id for r in found)
    prints = {r.fingerprint for r in found}
    assert {"route-change:/items:added:endpoint", "graphql-change:a/schema.graphql:true:enum:Old:type:Item", "rsc-boundary:app/page.tsx:client:use server:use client:true", "docker-change:Dockerfile:dockerfile:true:a:1,a:2"} <= prints
