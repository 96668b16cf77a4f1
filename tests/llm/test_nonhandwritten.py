from diffloom.llm.nonhandwritten import body_lines, classify_files, notice

FILES = "changeset_id string, path string, status string, note string"
HUNKS = "hunk_id long, changeset_id string, path string, hunk_ord int, new_start int, content string, additions array<string>"
SKIPPED = "changeset_id string, path string, reason string, note string, status string"
CODE = ["import { a } from './a';", "export function f(x: number): number {", "  // adds one", "  return x + 1;", "}"]
MINIFIED = "".join(f'var a{i}=b.c{i},d=!0;function e{i}(g,h){{return g.f(h)}}' for i in range(40))
CASES = {
    "src/plain.ts": (CODE, None), "app/legacy/x.js": ([MINIFIED], "minified"), "src/data/rows.py": (["DATA = ("] + ["'" + "aB3dE6gH" * 8 + "'"] * 20, "data"), "src/t.ts": (["export default ["] + ["1.5, -2.25, 3, 4, 5, 6,"] * 10, "data"),
    "src/gen.go": (["// Code generated by tool v1. DO NOT EDIT.", *CODE], "generated"), "src/helper.py": (["# Helper that prints 'DO NOT EDIT' into outputs it generates", *CODE], None), "lib/own.ts": (["// Copyright the team. Own work, internal licence.", *CODE], None),
    "src/copy.ts": (["// Third-party copy of left-pad, local patches: none", *CODE], "vendored"), "src/generators/a.ts": (CODE, None), "docs/vendor-a.md": (["How we vendor."], None), "src/dist-x/i.ts": (CODE, None), "types/a.d.ts": (CODE, None),
    "src/help.ts": (["const HELP = '" + "The simple update will open again. " * 20 + "';", *CODE], None), "src/rx.ts": (["const RX = /^(?:" + "alpha|beta|gamma|" * 30 + "x)/;", *CODE], None), "src/key.ts": (CODE + ["-----BEGIN PRIVATE KEY-----"] + ["A" * 64] * 9 + ["-----END PRIVATE KEY-----"], None),
}
BY_PATH = {"pnpm-lock.yaml": "lock", "a/Cargo.lock": "lock", "public/a.js.map": "source_map", "public/a.min.js": "minified", "x/node_modules/y/z.js": "vendored", "proto/a_pb2.py": "generated", "dist/a.d.ts": "generated", "node_modules/y/logo.png": None, "assets/a.zip": None}


def test_classes(spark):
    files = spark.createDataFrame([("c", p, "added", "clash") for p in [*CASES, *BY_PATH, "src/blob.ts", "src/skip.ts", "src/nothing.ts"]] * 2 + [("c", None, None, None)], FILES)
    hunks = spark.createDataFrame([(i, "c", p, 0, 7, None if i % 2 else "@@ -0,0 +1 @@\n" + "\n".join("+" + x for x in lines), lines) for i, (p, (lines, _)) in enumerate(CASES.items())] + [(99, "c", "src/nothing.ts", 0, None, None, None), (98, None, "x", 0, 1, "", [])], HUNKS)
    skipped = spark.createDataFrame([("c", "src/blob.ts", "too-large", "numeric table emitted by a script", "x"), ("c", "src/skip.ts", "excluded-by-user", "asked for by the user", "x"), ("c", "src/nothing.ts", None, None, None)], SKIPPED)
    got = {r.path: r.file_class for r in classify_files(files, hunks, skipped).collect()}
    want = {p: k for p, (_, k) in CASES.items() if k} | {p: k for p, k in BY_PATH.items() if k} | {"src/blob.ts": "data"}
    assert got == want
    assert classify_files(files.where("false"), hunks.where("false"), skipped.where("false")).count() == 0


def test_body_and_notice():
    assert body_lines("@@ -1 +1 @@\n a\r\n+b\n-c", ["b"]) == ["a", "b"]
    assert body_lines("@@ -1 +1 @@", ["x", None]) == ["x"] and body_lines(None, None) == []
    assert body_lines("@@ -1 +0,0 @@\n-gone", []) == ["gone"]
    assert notice(["x", "// Package emits generated code for callers."]) is None and notice([]) is None


def _classes(spark, rows):
    """path -> (class, evidence) of files given as (path, hunk_ord, lines)."""
    files = spark.createDataFrame([("c", p, "added", None) for p in dict.fromkeys(p for p, *_ in rows)], FILES)
    hunks = spark.createDataFrame([(i, "c", p, o, 1, None, lines) for i, (p, o, lines) in enumerate(rows)], HUNKS)
    return {r.path: (r.file_class, r.evidence) for r in classify_files(files, hunks, spark.createDataFrame([], SKIPPED)).collect()}


def test_notices_are_read_to_the_end_of_the_leading_comments(spark):
    note = "// Code generated by tool v1. DO NOT EDIT."
    late = ["// line of the licence"] * 30 + [note, *CODE]
    long = ["// " + "words of a long licence sentence " * 12 + "; this file was generated by the tool", *CODE]
    inside = ["/*", "The licence.", "This file was generated by the tool.", "*/", *CODE]
    after_code = [*CODE * 3, note]
    got = _classes(spark, [("src/late.go", 0, late), ("src/long.ts", 0, long), ("src/in.ts", 0, inside), ("src/low.ts", 0, after_code), ("src/second.ts", 3, CODE), ("src/second.ts", 2, [note, *CODE])])
    assert got == {p: ("generated", "notice") for p in ("src/late.go", "src/long.ts", "src/in.ts", "src/second.ts")}


def test_layout_comes_first_and_each_statistic_counts(spark):
    prose = "const TEXT = '" + "a line of plain words that goes on; x = {y} " * 20 + "';"
    marks = "const LIST = 'alpha" + ",beta,gamma" * 60 + "';"
    signs = "/*" + "=-;{}" * 200 + "*/"
    rows = [("web/a.min.js", 0, [MINIFIED]), ("src/a.ts", 0, [MINIFIED, "", *CODE]), ("src/short.py", 0, ["DATA = ["] + [f"  {i % 9}," for i in range(90)] + ["]"]), ("src/prose.ts", 0, [prose]), ("src/marks.ts", 0, [marks]), ("src/signs.ts", 0, [signs]),
            ("src/many.ts", 0, [MINIFIED[:300]] + CODE * 30), ("src/tiny.py", 0, ["  61,", "  5,"]), ("a/data.json", 0, ['{"a": 1, "b": 2}'] * 40), ("a/one.json", 0, ["[" + '{"a":{"b":"xyz"}},' * 90 + "{}]"])]
    got = _classes(spark, rows)
    assert got == {"web/a.min.js": ("minified", "layout"), "src/a.ts": ("minified", "layout"), "src/short.py": ("data", "layout"), "a/one.json": ("minified", "layout")}
