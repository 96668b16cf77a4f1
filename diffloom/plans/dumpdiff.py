"""Dumping patches: which files, what of them, and the forms they are written in.

A patch is a table of lines with their places, so that a file of any size is spread over
tasks; whoever writes text files sorts by the places. Nothing gathers a whole patch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.operators import paths as P
from diffloom.operators.chunks import chunk_by_budget
from diffloom.sources.changesets import change_files

KEYS = ["changeset_id", "path"]
# Signs of the kinds of lines, and labels of statuses.
SIGNS = {"add": "+", "del": "-"}
STATUS_LABELS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type changed", "U": "unmerged", "X": "unknown"}


def unique_lines(lines: DataFrame) -> DataFrame:
    """Diff lines without repeats; null text is an empty line."""
    used = lines.where("changeset_id is not null and path is not null and hunk_ord is not null and line_ord is not null")
    return used.select(*KEYS, "hunk_ord", "line_ord", "kind", "old_no", "new_no", F.coalesce("text", F.lit("")).alias("text")).distinct()


def dump_entries(files: DataFrame, lines: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """changeset_id, path, old_path, status, decision, additions, deletions, size: one row per changed file.

    decision is keep, or why a file is left out: the path rule, binary (by its extension)
    or diff-empty. A file without lines has 0 added and deleted lines.
    """
    sign = lambda k: F.count_if(F.col("kind") == k)
    sized = unique_lines(lines).groupBy(*KEYS).agg(sign("add").alias("additions"), sign("del").alias("deletions"), F.sum(F.length("text") + 2).alias("size"))
    joined = change_files(files).join(sized, KEYS, "left")
    by_path = P.path_decision(F.col("path"), include, exclude)
    decision = F.when(by_path != "keep", by_path).when(P.is_binary_path(F.col("path")), "binary").when(F.col("size").isNull(), "diff-empty").otherwise("keep")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(*KEYS, "old_path", F.coalesce("status", F.lit("modified")).alias("status"), decision.alias("decision"), zero("additions"), zero("deletions"), zero("size"))


def name_only(entries: DataFrame) -> DataFrame:
    """changeset_id, place, path, kept, reason: files in path order, those kept and those skipped each by themselves."""
    kept = F.col("decision").isin("keep", "diff-empty")
    place = F.row_number().over(Window.partitionBy("changeset_id", kept).orderBy("path"))
    return entries.select("changeset_id", place.alias("place"), "path", kept.alias("kept"), F.when(~kept, F.col("decision")).alias("reason"))


def stat(entries: DataFrame) -> DataFrame:
    """changeset_id, path, additions, deletions, text ('path | +a -d') of the kept files."""
    text = F.format_string("%s | +%d -%d", "path", "additions", "deletions")
    return entries.where("decision in ('keep', 'diff-empty')").select(*KEYS, "additions", "deletions", text.alias("text"))


def selector(path: Column) -> Column:
    """A selector or path in plain form: forward slashes, no leading ./, no slash at the end, '.' for the root."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./+", ""), r"/+$", "")
    return F.when(plain.isin("", "."), ".").otherwise(plain)


def patch_targets(files: DataFrame, selectors: DataFrame) -> DataFrame:
    """changeset_id, wanted, path, target_kind of the files that a selector (changeset_id, wanted) names.

    A path or old path equal to the selector wins over files below it; with a slash at
    its end only files below count. Files are found by an equi-join on every folder of
    their paths. A selector that names nothing gives no row.
    """
    w = selectors.where("wanted is not null").select("changeset_id", "wanted", selector(F.col("wanted")).alias("at"), F.col("wanted").endswith("/").alias("folder")).distinct()
    f = change_files(files).select(*KEYS, "old_path")
    both = f.select(*KEYS, F.explode(F.array_compact(F.array("path", "old_path"))).alias("name")).withColumn("name", selector(F.col("name")))
    parts = F.split("name", "/")
    above = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    hits = both.select(*KEYS, "name", F.explode(above).alias("at")).join(w, ["changeset_id", "at"])
    told = hits.groupBy("changeset_id", "wanted", "path").agg(F.bool_or((F.col("name") == F.col("at")) & ~F.col("folder")).alias("exact"))
    any_exact = F.bool_or("exact").over(Window.partitionBy("changeset_id", "wanted"))
    return told.withColumn("any_exact", any_exact).where("exact or not any_exact").select("changeset_id", "wanted", "path", F.when(F.col("exact"), "file").otherwise("directory").alias("target_kind"))


def patch_lines(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """changeset_id, path, hunk_ord, line_ord, text: the patch of the kept files, a line per row.

    hunk_ord -1 has the three head lines of a file, line_ord -1 the header of a hunk.
    """
    kept = entries.where("decision = 'keep'").select(*KEYS, "status", F.coalesce("old_path", "path").alias("before"))
    old = F.when(F.col("status") == "added", F.lit("/dev/null")).otherwise(F.concat(F.lit("a/"), "before"))
    new = F.when(F.col("status") == "deleted", F.lit("/dev/null")).otherwise(F.concat(F.lit("b/"), "path"))
    head = F.array(F.concat(F.lit("diff --git a/"), "before", F.lit(" b/"), "path"), F.concat(F.lit("--- "), old), F.concat(F.lit("+++ "), new))
    heads = kept.select(*KEYS, F.lit(-1).alias("hunk_ord"), F.posexplode(head).alias("line_ord", "text"))
    body = unique_lines(lines).join(kept.select(*KEYS), KEYS, "left_semi")
    count = lambda other: F.count_if(F.col("kind") != other)
    first = lambda c: F.coalesce(F.min(c), F.lit(0))
    hunks = body.groupBy(*KEYS, "hunk_ord").agg(first("old_no").alias("o"), count("add").alias("ol"), first("new_no").alias("n"), count("del").alias("nl"))
    headers = hunks.select(*KEYS, "hunk_ord", F.lit(-1).alias("line_ord"), F.format_string("@@ -%d,%d +%d,%d @@", "o", "ol", "n", "nl").alias("text"))
    sign = F.when(F.col("kind") == "add", "+").when(F.col("kind") == "del", "-").otherwise(" ")
    return heads.unionByName(headers).unionByName(body.select(*KEYS, "hunk_ord", "line_ord", F.concat(sign, "text").alias("text")))


def markdown_heads(entries: DataFrame, mode: str = "branch", base: str = "main", head: str = "HEAD", unified: int = 3, exclude: list[str] | None = None) -> DataFrame:
    """changeset_id, line_no, text: title, options and file list that stand before the patch of a change set, a line per row."""
    # Titles by mode.
    titles = {"branch": f"Git Diff: {base}..{head}", "unstaged": "Git Diff: Unstaged Changes (working tree vs index)", "staged": "Git Diff: Staged Changes (index vs HEAD)", "all": "Git Diff: All Changes (working tree vs HEAD)"}
    kept = entries.where("decision = 'keep'")
    top = [f"# {titles[mode]}", "", f"**Mode:** {mode}", f"**Unified context:** {unified} lines", *([f"**Excluded patterns:** {', '.join(exclude)}"] if exclude else [])]
    n = len(top)
    opening = kept.groupBy("changeset_id").agg(F.count("*").alias("n")).select("changeset_id", F.posexplode(F.concat(F.array(*[F.lit(t) for t in top]), F.array(F.format_string("**Files included:** %d", "n"), F.lit(""), F.lit("## Files"), F.lit("")))).alias("line_no", "text"))
    place = F.row_number().over(Window.partitionBy("changeset_id").orderBy("path")) + (n + 3)
    listed = kept.select("changeset_id", place.alias("line_no"), F.format_string("- `%s` (%s)", "path", "status").alias("text"))
    return opening.unionByName(listed)


def json_hunks(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """changeset_id, path, hunk_ord, json: one object per hunk of the kept files, with its typed lines in order."""
    body = unique_lines(lines).join(entries.where("decision = 'keep'").select(*KEYS), KEYS, "left_semi")
    line = F.struct("line_ord", F.struct("kind", F.col("old_no").alias("oldLine"), F.col("new_no").alias("newLine"), "text").alias("line"))
    grouped = body.groupBy(*KEYS, "hunk_ord").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return grouped.select(*KEYS, "hunk_ord", F.to_json(F.struct("path", F.col("hunk_ord").alias("hunk"), F.transform("lines", lambda x: x["line"]).alias("lines"))).alias("json"))


def chunk_files(entries: DataFrame, budget: int, name: str = "patch", ext: str = "diff") -> DataFrame:
    """changeset_id, path, size, chunk, file_name of the kept files, packed in path order."""
    packed = chunk_by_budget(entries.where("decision = 'keep'").select(*KEYS, "size"), budget)
    return packed.withColumn("file_name", F.concat(F.lit(f"{name}-"), F.lpad((F.col("chunk") + 1).cast("string"), 3, "0"), F.lit(f".{ext}")))


def write_chunks(entries: DataFrame, lines: DataFrame, budget: int, out: str, name: str = "patch", ext: str = "diff") -> None:
    """Write the patch as text, one folder per change set and chunk, lines in order."""
    chunks = chunk_files(entries, budget, name, ext).select(*KEYS, "file_name")
    rows = patch_lines(entries, lines).join(chunks, KEYS)
    ordered = rows.repartitionByRange("changeset_id", "file_name", "path", "hunk_ord", "line_ord").sortWithinPartitions("changeset_id", "file_name", "path", "hunk_ord", "line_ord")
    ordered.select("changeset_id", "file_name", "text").write.partitionBy("changeset_id", "file_name").mode("overwrite").text(out)
