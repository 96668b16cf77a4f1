"""Change sets as DataFrames: file lists, hunks, lines, and the text forms they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What the first letter of a status stands for.
STATUS = {"a": "added", "m": "modified", "d": "deleted", "r": "renamed"}


def canonical_status(status: Column) -> Column:
    """added, modified, deleted or renamed from any spelling; null if it is none of them."""
    first = F.lower(F.substring(F.trim(status), 1, 1))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for letter, name in STATUS.items():
        out = out.when(first == letter, name)
    return out


def change_files(files: DataFrame) -> DataFrame:
    """changeset_id, ord, path, status, old_path: one row per changed file.

    Repeated rows count once; of unequal rows of one path the one of the least ord
    holds. An unknown or null status is kept as null. Rows with a null key are left out.
    """
    return (
        files.where("changeset_id is not null and path is not null")
        .groupBy("changeset_id", "path")
        .agg(F.min_by(F.struct("ord", canonical_status(F.col("status")).alias("status"), "old_path"), "ord").alias("r"))
        .select("changeset_id", "r.ord", "path", "r.status", "r.old_path")
    )


def change_hunks(hunks: DataFrame) -> DataFrame:
    """Hunks without repeats; null arrays are empty and null lines are left out of them."""
    lines = lambda c: F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return (
        hunks.where("changeset_id is not null and path is not null")
        .groupBy("changeset_id", "path", "hunk_ord")
        .agg(F.min_by(F.struct("hunk_id", "old_start", "old_lines", "new_start", "new_lines", "content", "additions", "deletions"), "hunk_id").alias("h"))
        .select("changeset_id", "path", "hunk_ord", "h.hunk_id", "h.old_start", "h.old_lines", "h.new_start", "h.new_lines", "h.content", lines("h.additions").alias("additions"), lines("h.deletions").alias("deletions"))
    )


def hunk_header(text: Column) -> list[Column]:
    """old_start, old_lines, new_start, new_lines of a header line; an omitted count is 1, no header gives nulls."""
    pattern = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    found = text.rlike(pattern)
    names = ("old_start", "old_lines", "new_start", "new_lines")
    return [F.when(found, F.coalesce(part(i + 1), F.lit("1"))).cast("int").alias(n) for i, n in enumerate(names)]


def hunk_body(hunks: DataFrame) -> DataFrame:
    """changeset_id, path, hunk_ord, line_ord, kind, old_no, new_no, text of the lines kept in content.

    Lines are parted at line feeds. A line's kind is its first character: + add, - del,
    blank or nothing ctx; others, such as the no-newline mark, are no lines of the file.
    """
    header = F.element_at(F.split("content", "\n", 2), 1)
    lines = hunks.where("content is not null and instr(content, '\n') > 0").select("changeset_id", "path", "hunk_ord", *hunk_header(header), F.posexplode(F.split("content", "\n", -1)).alias("at", "raw"))
    first = F.substring("raw", 1, 1)
    kind = F.when(first == "+", "add").when(first == "-", "del").when((first == " ") | (first == ""), "ctx")
    body = lines.where("at > 0").withColumn("kind", kind).where("kind is not null")
    before = Window.partitionBy("changeset_id", "path", "hunk_ord").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("int")).over(before), F.lit(0))
    return body.select(
        "changeset_id",
        "path",
        "hunk_ord",
        (F.row_number().over(Window.partitionBy("changeset_id", "path", "hunk_ord").orderBy("at")) - 1).alias("line_ord"),
        "kind",
        F.when(F.col("kind") != "add", F.col("old_start") + seen("del", "ctx")).cast("int").alias("old_no"),
        F.when(F.col("kind") != "del", F.col("new_start") + seen("add", "ctx")).cast("int").alias("new_no"),
        F.expr("substring(raw, 2)").alias("text"),
    )


# --- text forms ---------------------------------------------------------------------


def parse_name_status(lines: DataFrame, keep_all: bool = False) -> DataFrame:
    """changeset_id, line_no, status, path, old_path of tab-separated name-status lines (changeset_id, line_no, text).

    R with a score is a rename (old path, then new). Codes other than A, M, D and R are
    left out, or kept as they are with keep_all.
    """
    parts = F.split("text", "\t")
    code = F.substring(parts[0], 1, 1)
    renamed = (code == "R") & (F.size(parts) >= 3)
    status = canonical_status(code)
    out = lines.where("text is not null").select(
        "changeset_id",
        "line_no",
        (F.coalesce(status, code) if keep_all else status).alias("status"),
        F.when(renamed, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"),
        F.when(renamed, F.get(parts, F.lit(1))).alias("old_path"),
    )
    return out.where("path is not null and status is not null and status <> ''")


def parse_num_stat(lines: DataFrame) -> DataFrame:
    """changeset_id, path, added, removed, is_binary of numstat lines; '-' counts mark a binary file."""
    parts = F.split("text", "\t")
    binary = (parts[0] == "-") & (parts[1] == "-")
    return lines.where("size(split(text, '\t')) >= 3").select(
        "changeset_id",
        F.element_at(parts, -1).alias("path"),
        F.when(binary, F.lit(0)).otherwise(parts[0].try_cast("int")).alias("added"),
        F.when(binary, F.lit(0)).otherwise(parts[1].try_cast("int")).alias("removed"),
        binary.alias("is_binary"),
    )


def parse_patch(lines: DataFrame) -> DataFrame:
    """Lines of whole patches (changeset_id, line_no, text) as diff lines with path, status and numbers.

    Files begin at 'diff --git', hunks at '@@'; within a hunk only the first character
    of a line counts, so removed '--' and added '++' lines stay lines. A deleted file has
    its old path. Result: changeset_id, path, old_path, status, hunk_ord, line_ord, kind,
    old_no, new_no, text.
    """
    filed = split_patch(lines)
    by_file = Window.partitionBy("changeset_id", "file_ord").orderBy("line_no")
    is_header = F.col("text").rlike(r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@")
    hunked = filed.withColumn("hunk", F.sum(is_header.cast("int")).over(by_file))
    whole_file = Window.partitionBy("changeset_id", "file_ord")
    side = lambda mark: F.max(F.when((F.col("hunk") == 0) & F.col("text").startswith(mark), F.regexp_replace(F.expr("substring(text, 5)"), r"^[ab]/", ""))).over(whole_file)
    named = hunked.withColumn("old", side("--- ")).withColumn("new", side("+++ ")).where("hunk > 0")
    status = F.when(F.col("old") == "/dev/null", "added").when(F.col("new") == "/dev/null", "deleted").when(F.col("old") != F.col("new"), "renamed").otherwise("modified")
    by_hunk = Window.partitionBy("changeset_id", "file_ord", "hunk").orderBy("line_no")
    before = by_hunk.rowsBetween(Window.unboundedPreceding, -1)
    numbers = hunk_header(F.col("text"))
    first = F.substring("text", 1, 1)
    kind = F.when(is_header, None).when(first == "+", "add").when(first == "-", "del").when((first == " ") | (first == ""), "ctx")
    typed = (
        named.withColumn("status", status)
        .withColumn("kind", kind)
        .withColumn("old_start", F.first(numbers[0], ignorenulls=True).over(by_hunk))
        .withColumn("new_start", F.first(numbers[2], ignorenulls=True).over(by_hunk))
    )
    seen = lambda *kinds: F.coalesce(F.sum(F.coalesce(F.col("kind").isin(*kinds), F.lit(False)).cast("int")).over(before), F.lit(0))
    counted = typed.withColumn("o", F.col("old_start") + seen("del", "ctx")).withColumn("n", F.col("new_start") + seen("add", "ctx"))
    return counted.where("kind is not null").select(
        "changeset_id",
        F.when(F.col("status") == "deleted", F.col("old")).otherwise(F.col("new")).alias("path"),
        F.when(F.col("status") == "renamed", F.col("old")).alias("old_path"),
        "status",
        (F.col("hunk") - 1).cast("int").alias("hunk_ord"),
        (F.row_number().over(by_hunk) - 1).alias("line_ord"),
        "kind",
        F.when(F.col("kind") != "add", F.col("o")).cast("int").alias("old_no"),
        F.when(F.col("kind") != "del", F.col("n")).cast("int").alias("new_no"),
        F.expr("substring(text, 2)").alias("text"),
    )


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Patch files as lines (changeset_id = file name, line_no, text), for parse_patch.

    Files are read whole, so that line numbers are known; one file is one row.
    """
    texts = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("changeset_id"), "value")
    return texts.select("changeset_id", F.posexplode(F.split("value", "\n", -1)).alias("line_no", "text"))


def read_findings_json(spark: SparkSession, path: str) -> DataFrame:
    """Findings of earlier JSON documents (an object with an array 'findings')."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("findings").alias("finding")).select("finding.*")


def untracked_hunks(contents: DataFrame) -> DataFrame:
    """One all-added hunk per text file (changeset_id, path, content); a line end at the end adds an empty line."""
    lines = F.split("content", "\n", -1)
    return contents.where("content is not null").select(
        "changeset_id", "path", F.lit(0).alias("hunk_ord"), F.lit(0).alias("old_start"), F.lit(0).alias("old_lines"), F.lit(1).alias("new_start"), F.size(lines).alias("new_lines"), lines.alias("additions"), F.array().cast("array<string>").alias("deletions")
    )


def with_status(hunks: DataFrame, files: DataFrame) -> DataFrame:
    """Hunks with the status of their file; where the file list has none it is read from the hunk's sides."""
    listed = files.select("changeset_id", "path", "status")
    inferred = F.when(F.col("old_lines") == 0, "added").when(F.col("new_lines") == 0, "deleted").otherwise("modified")
    return hunks.join(listed, ["changeset_id", "path"], "left").withColumn("status", F.coalesce("status", inferred))


def change_stats(hunks: DataFrame) -> DataFrame:
    """changeset_id, path, hunks, additions, deletions."""
    return hunks.groupBy("changeset_id", "path").agg(F.count("*").alias("hunks"), F.sum(F.size("additions")).alias("additions"), F.sum(F.size("deletions")).alias("deletions"))


# --- whole change sets ------------------------------------------------------------------

#: Modes of a change set and what stands for base and head where they are not refs.
MODES = {"branch": (None, None), "unstaged": ("INDEX", "WORKING"), "staged": ("HEAD", "INDEX"), "all": ("HEAD", "WORKING")}


def resolve_refs(mode: str, base: str | None = None, head: str | None = None, default_branch: str | None = None) -> tuple[str, str]:
    """Base and head of a mode; in branch mode they default to the default branch, else main, and HEAD. Other modes take no refs."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {', '.join(MODES)}")
    if mode == "branch":
        return base or default_branch or "main", head or "HEAD"
    return MODES[mode]


def collect_change_set(spark: SparkSession, folder: str, mode: str = "branch", base: str | None = None, head: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files and hunks of the change sets whose texts lie in a folder.

    name-status/*.txt and patch/*.diff hold one change set per file name; in the modes
    unstaged and all untracked.parquet (changeset_id, path, content) adds new files.
    Files: changeset_id, ord, path, status, old_path, base, head. Hunks: changeset_id,
    path, hunk_ord, status, additions, deletions.
    """
    at, to = resolve_refs(mode, base, head)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("changeset_id")
    rows = spark.read.text(f"{folder}/name-status", wholetext=True).select(stem, F.posexplode(F.split("value", "\n", -1)).alias("line_no", "text"))
    listed = parse_name_status(rows).withColumnRenamed("line_no", "ord")
    lines = spark.read.text(f"{folder}/patch", wholetext=True).select(stem, F.posexplode(F.split("value", "\n", -1)).alias("line_no", "text"))
    hunks = hunks_of_lines(parse_patch(lines))
    if mode in ("unstaged", "all"):
        extra = spark.read.parquet(f"{folder}/untracked.parquet").where("path is not null")
        binary = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
        from diffloom.operators.paths import BINARY

        listed = listed.unionByName(extra.select("changeset_id", F.lit(2**31 - 1).alias("ord"), F.lit("added").alias("status"), "path", F.lit(None).cast("string").alias("old_path")))
        hunks = merge_extra(hunks, untracked_hunks(extra.where(~binary.isin(*BINARY))))
    return listed.withColumns({"base": F.lit(at), "head": F.lit(to)}), hunks


def hunks_of_lines(lines: DataFrame) -> DataFrame:
    """changeset_id, path, hunk_ord, status, additions, deletions from typed diff lines; each hunk is gathered by itself."""
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("line_ord", "text")))), lambda x: x["text"])
    return lines.groupBy("changeset_id", "path", "hunk_ord").agg(F.first("status").alias("status"), side("add").alias("additions"), side("del").alias("deletions"))


def merge_extra(hunks: DataFrame, extra: DataFrame) -> DataFrame:
    """Hunks and the all-added hunks of untracked files as one bag."""
    columns = ["changeset_id", "path", "hunk_ord", "status", "additions", "deletions"]
    return hunks.select(*columns).unionByName(extra.withColumn("status", F.lit("added")).select(*columns))


#: Lines of a patch that are numbered in one task.
PATCH_BLOCK = 4096


def split_patch(lines: DataFrame) -> DataFrame:
    """Lines of whole patches (changeset_id, line_no, text) with file_ord, the place of their file; lines before the first file are left out.

    File starts, few beside all lines, are numbered by change set, and lines find theirs by
    the last start at or before them within blocks of line numbers, so no change set is
    sorted in one task.
    """
    block = F.floor(F.col("line_no") / F.lit(PATCH_BLOCK))
    marked = lines.withColumn("b", block).withColumn("is_start", F.col("text").startswith("diff --git "))
    per_block = marked.groupBy("changeset_id", "b").agg(F.count_if("is_start").alias("n"))
    before = Window.partitionBy("changeset_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.withColumn("files_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("changeset_id", "b").orderBy("line_no")
    counted = marked.withColumn("here", F.sum(F.col("is_start").cast("int")).over(inside)).join(offsets, ["changeset_id", "b"])
    return counted.withColumn("file_ord", F.col("files_before") + F.col("here")).where("file_ord > 0").drop("b", "is_start", "here", "files_before")


def content_lookup(requests: DataFrame, blobs: DataFrame) -> DataFrame:
    """Requests (changeset_id, ref, path) with their content; those without are left out."""
    return requests.select("changeset_id", "ref", "path").distinct().join(blobs.select("changeset_id", "ref", "path", "content"), ["changeset_id", "ref", "path"]).where("content is not null")


def parse_ls_files(outputs: DataFrame) -> DataFrame:
    """changeset_id, ord, path of NUL-separated file lists (changeset_id, text); empty entries are left out."""
    return outputs.select("changeset_id", F.posexplode(F.split("text", "\x00", -1)).alias("ord", "path")).where("path <> ''")


def deletions_of(lines: DataFrame) -> DataFrame:
    """changeset_id, path, line (in the old file), text of deleted lines."""
    return lines.where("kind = 'del'").select("changeset_id", "path", F.col("old_no").alias("line"), "text")


# --- manifests -----------------------------------------------------------------------------

_MANIFEST = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """changeset_id, side, section, name, version of package manifests (changeset_id, side, json); unreadable ones hold nothing."""
    parsed = manifests.select("changeset_id", "side", F.from_json("json", _MANIFEST).alias("m"))
    sections = [parsed.select("changeset_id", "side", F.lit(s).alias("section"), F.explode(f"m.{s}").alias("name", "version")) for s in ("dependencies", "devDependencies")]
    return sections[0].unionByName(sections[1]).where("version is not null")


def compare_manifests(manifests: DataFrame) -> DataFrame:
    """changeset_id, section, name, from_version, to_version of packages that differ between base and head."""
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("version")))
    both = manifest_entries(manifests).groupBy("changeset_id", "section", "name").agg(at("base").alias("from_version"), at("head").alias("to_version"))
    return both.where("not (from_version <=> to_version)")


def dependency_gate(manifests: DataFrame, names: list[str]) -> DataFrame:
    """changeset_id of change sets whose head manifest depends on one of the packages, in either section."""
    return manifest_entries(manifests).where(F.col("side") == "head").where(F.col("name").isin(*names)).select("changeset_id").distinct()
