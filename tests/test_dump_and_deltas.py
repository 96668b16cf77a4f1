import os

import pytest
from diffloom.operators import deltas as DL
from diffloom.operators import identity as I
from diffloom.plans import dumpdiff as DD
from diffloom.plans import profiles as PR
from diffloom.sources import changesets as C
from pyspark.sql import functions as F

FILES = "changeset_id string, ord int, path string, status string, old_path string"
LINES = "changeset_id string, path string, hunk_ord int, line_ord int, kind string, old_no int, new_no int, text string"


@pytest.fixture(scope="module")
def tables(spark):
    files = [("c", 0, "src/a.ts", "M", None), ("c", 1, "src/b/c.ts", "renamed", "old/c.ts"), ("c", 2, "img/x.png", "added", None), ("c", 3, "dist/y.js", "added", None), ("c", 4, "empty.ts", None, None), ("c", 5, "gone.ts", "D", None), (None, 6, "n", "A", None)]
    lines = [("c", "src/a.ts", 0, 0, "ctx", 4, 4, "keep"), ("c", "src/a.ts", 0, 1, "del", 5, None, "-- old"), ("c", "src/a.ts", 0, 2, "add", None, 5, "++ new"), ("c", "src/b/c.ts", 2, 0, "add", None, 1, None), ("c", "dist/y.js", 0, 0, "add", None, 1, "y"), ("c", "img/x.png", 0, 0, "add", None, 1, "z"), ("c", "gone.ts", 0, 0, "del", 1, None, "bye")]
    return spark.createDataFrame(files * 2, FILES), spark.createDataFrame(lines * 2, LINES)


def test_entries_names_and_stat(tables):
    entries = DD.dump_entries(*tables, exclude=["src/b/**"])
    got = {r.path: r.decision for r in entries.collect()}
    assert got == {"src/a.ts": "keep", "src/b/c.ts": "excluded-by-glob", "img/x.png": "binary", "dist/y.js": "excluded-by-default", "empty.ts": "diff-empty", "gone.ts": "keep"}
    assert [(r.place, r.path) for r in DD.name_only(entries).where("kept").orderBy("place").collect()] == [(1, "empty.ts"), (2, "gone.ts"), (3, "src/a.ts")]
    assert {r.text for r in DD.stat(entries).collect()} == {"src/a.ts | +1 -1", "gone.ts | +0 -1", "empty.ts | +0 -0"}
    only = DD.dump_entries(*tables, include=["dist/**"])
    assert {r.path for r in only.where("decision = 'keep'").collect()} == {"dist/y.js"}


def test_patch_is_parsed_back(tables):
    entries = DD.dump_entries(*tables)
    rows = DD.patch_lines(entries, tables[1]).orderBy("path", "hunk_ord", "line_ord").collect()
    assert [r.text for r in rows if r.path == "src/a.ts"] == ["diff --git a/src/a.ts b/src/a.ts", "--- a/src/a.ts", "+++ b/src/a.ts", "@@ -4,2 +4,2 @@", " keep", "--- old", "+++ new"]
    spark = tables[0].sparkSession
    text = spark.createDataFrame([("c", i, r.text) for i, r in enumerate(rows)], "changeset_id string, line_no long, text string")
    back = {(r.path, r.kind, r.text): (r.status, r.old_path) for r in C.parse_patch(text).collect()}
    assert back[("src/a.ts", "del", "-- old")] == ("modified", None) and back[("src/b/c.ts", "add", "")] == ("renamed", "old/c.ts") and back[("gone.ts", "del", "bye")] == ("deleted", None)


def test_files_of_a_patch_are_numbered_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "PATCH_BLOCK", 3)
    lines = ["noise"] + [x for i in range(5) for x in (f"diff --git a/{i} b/{i}", f"--- a/{i}", f"+++ b/{i}", "@@ -1 +1 @@", "-x", f"+{i}")]
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate(lines)], "changeset_id string, line_no long, text string")
    assert {(r.path, r.text) for r in C.parse_patch(df).where("kind = 'add'").collect()} == {(str(i), str(i)) for i in range(5)}


def test_selectors(tables):
    spark = tables[0].sparkSession
    wanted = spark.createDataFrame([("c", w) for w in ("src/a.ts", "src", "./src/b/", "old/c.ts", ".", "nope", "src/a.ts/")], "changeset_id string, wanted string")
    got = {}
    for r in DD.patch_targets(tables[0], wanted).collect():
        got.setdefault(r.wanted, set()).add((r.path, r.target_kind))
    assert got["src/a.ts"] == {("src/a.ts", "file")} and got["src"] == {("src/a.ts", "directory"), ("src/b/c.ts", "directory")} and got["./src/b/"] == {("src/b/c.ts", "directory")}
    assert got["old/c.ts"] == {("src/b/c.ts", "file")} and len(got["."]) == 6 and "nope" not in got


def test_chunks_are_written_in_order(tables, tmp_path):
    entries = DD.dump_entries(*tables)
    out = str(tmp_path / "out")
    DD.write_chunks(entries, tables[1], 10, out)
    names = sorted(d for d in os.listdir(f"{out}/changeset_id=c") if d.startswith("file_name"))
    assert names == ["file_name=patch-001.diff", "file_name=patch-002.diff", "file_name=patch-003.diff"]
    text = entries.sparkSession.read.text(f"{out}/changeset_id=c/file_name=patch-002.diff").collect()
    assert [r.value for r in text][:2] == ["diff --git a/src/a.ts b/src/a.ts", "--- a/src/a.ts"]


def test_modes_and_collection(spark, tmp_path):
    assert C.resolve_refs("branch") == ("main", "HEAD") and C.resolve_refs("branch", None, "x", "trunk") == ("trunk", "x") and C.resolve_refs("all", "a", "b") == ("HEAD", "WORKING")
    with pytest.raises(ValueError, match="unknown mode"):
        C.resolve_refs("other")
    (tmp_path / "name-status").mkdir()
    (tmp_path / "patch").mkdir()
    (tmp_path / "name-status" / "cs1.txt").write_text("M\ta.ts\nR100\tb.ts\tc.ts\nT\tlink\n")
    (tmp_path / "patch" / "cs1.diff").write_text("diff --git a/a.ts b/a.ts\n--- a/a.ts\n+++ b/a.ts\n@@ -1,2 +1,2 @@\n x\n-y\n+z\n\\ No newline at end of file\n")
    spark.createDataFrame([("cs1", "new.txt", "one\n"), ("cs1", "pic.png", "??")], "changeset_id string, path string, content string").write.parquet(str(tmp_path / "untracked.parquet"))
    files, hunks = C.collect_change_set(spark, str(tmp_path), "branch")
    assert {(r.path, r.status, r.base) for r in files.collect()} == {("a.ts", "modified", "main"), ("c.ts", "renamed", "main")}
    assert [(r.path, r.additions, r.deletions) for r in hunks.collect()] == [("a.ts", ["z"], ["y"])]
    files, hunks = C.collect_change_set(spark, str(tmp_path), "unstaged")
    assert {r.path for r in files.collect()} == {"a.ts", "c.ts", "new.txt", "pic.png"} and {(r.path, len(r.additions)) for r in hunks.collect()} == {("a.ts", 1), ("new.txt", 2)}


def test_manifests_lists_and_lookups(spark):
    rows = [("c", "base", '{"dependencies": {"a": "1.0.0", "b": "2.0.0"}, "devDependencies": {"v": "1"}}'), ("c", "head", '{"dependencies": {"a": "2.0.0", "n": "1.0.0"}, "devDependencies": {"v": "1"}}'), ("d", "head", "no json")]
    m = spark.createDataFrame(rows, "changeset_id string, side string, json string")
    assert sorted((r.section, r.name, r.from_version, r.to_version) for r in C.compare_manifests(m).collect()) == [("dependencies", "a", "1.0.0", "2.0.0"), ("dependencies", "b", "2.0.0", None), ("dependencies", "n", None, "1.0.0")]
    assert [r.changeset_id for r in C.dependency_gate(m, ["v", "x"]).collect()] == ["c"] and C.dependency_gate(m, ["b"]).count() == 0
    listed = spark.createDataFrame([("c", "a\x00b c\x00\x00")], "changeset_id string, text string")
    assert [(r.ord, r.path) for r in C.parse_ls_files(listed).collect()] == [(0, "a"), (1, "b c")]
    blobs = spark.createDataFrame([("c", "HEAD", "a", "x"), ("c", "HEAD", "b", None)], "changeset_id string, ref string, path string, content string")
    assert [r.content for r in C.content_lookup(blobs.drop("content").union(spark.createDataFrame([("c", "HEAD", "q")])), blobs).collect()] == ["x"]


def test_scopes_and_strict_mode(spark):
    runs = spark.createDataFrame([("a", None, "main", ""), ("b", None, "", None), ("c", "all", None, None)], "id string, mode string, base string, head string")
    assert {(r.id, r.mode, r.base, r.head) for r in DL.scope_of(runs).collect()} == {("a", "branch", "main", None), ("b", "unstaged", None, None), ("c", "all", None, None)}
    warnings = spark.createDataFrame([("p", "mode", "branch", "all")], "facts_path string, field string, before string, after string")
    assert DL.scope_messages(warnings).first().message == "Previous run used mode=branch, current is mode=all"
    with pytest.raises(DL.ScopeMismatch, match="mode=branch"):
        DL.require_equal_scopes(warnings)
    DL.require_equal_scopes(warnings.where("false"))


def test_deltas_and_snapshots(spark, tmp_path):
    sets = spark.createDataFrame([(f"set-{i:03}-{k}",) for i in range(9) for k in "ba"] * 2, "changeset_id string")
    ids = sorted({r.changeset_id for r in sets.collect()})
    assert sorted((r.newer, r.older) for r in DL.consecutive(sets).collect()) == list(zip(ids[1:], ids))
    pairs = spark.createDataFrame([("n", "o")], "newer string, older string")
    flags = spark.createDataFrame([("o", "f1", 5), ("o", "f2", 5), ("n", "f2", 9), ("n", "f3", 1)], "changeset_id string, flag_id string, effective_score int")
    scores = spark.createDataFrame([("o", 20), ("n", 35)], "changeset_id string, overall int")
    r = DL.risk_delta(flags, scores, pairs).first()
    assert (r.score_from, r.score_to, r.score_delta, r.added, r.removed, r.changed) == (20, 35, 15, 1, 1, 1)
    files = spark.createDataFrame([("o", "x", "h1"), ("o", "y", "h1"), ("n", "x", "h2"), ("n", "z", "h1")], "changeset_id string, path string, token string")
    assert {(r.path, r.change) for r in DL.files_delta(files, pairs).collect()} == {("x", "changed"), ("y", "removed"), ("z", "added")}
    one = spark.range(1).select(DL.snapshot_id(*[F.lit(x) for x in "abcd"]).alias("i"), I.stable_hash(F.lit("a:b:c:d")).alias("w")).first()
    assert one.i == one.w
    DL.save_snapshot(flags, str(tmp_path), "flags", "s1")
    DL.save_snapshot(flags.limit(1), str(tmp_path), "flags", "s1")
    assert DL.show_snapshot(spark, str(tmp_path), "flags", "s1").count() == 1
    runs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "snapshot_id string, created_at int")
    assert [r.snapshot_id for r in DL.list_snapshots(runs).collect()] == ["b", "c", "a"]


def test_profiles_choose_findings(spark):
    rows = spark.createDataFrame([("c", "env-var", "config_env"), ("c", "prisma-schema", "database"), ("c", "risk-flag", "infra"), ("c", "risk-flag", "database")], "changeset_id string, type string, category string")
    got = {p: {(r.type, r.category) for r in PR.profile_findings(rows, spark.createDataFrame([("c", p)], "changeset_id string, profile string")).collect()} for p in ("auto", "library", "sveltekit")}
    assert got["auto"] == {("env-var", "config_env"), ("prisma-schema", "database"), ("risk-flag", "infra")} and got["library"] == set() and ("risk-flag", "database") in got["sveltekit"]
