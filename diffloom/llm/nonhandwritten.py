"""Generated, minified or vendored source files (problem 5).

Layout statistics come first: of every hunk the longest line, lines, characters, white
space, letters and digits, code marks, numeric literals and encoded runs are counted,
summed per file, and held as shares against thresholds tuned per language; that tells
minified files and data dumped as code. A tool's or a third party's text that is laid out
like any other is told by paths that only tools write, by notices in the comments at the
top of a file, and by the notes of skipped entries, in this order. No text is shuffled:
only the few numbers of each hunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Path patterns (lower case) by class.
PATH_RULES = {
    "lock": r"(^|/)(pnpm-lock\.ya?ml|package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|bun\.lockb?|cargo\.lock|poetry\.lock|pdm\.lock|uv\.lock|pipfile\.lock|gemfile\.lock|composer\.lock|podfile\.lock|go\.sum|flake\.lock|mix\.lock|deno\.lock|gradle\.lockfile|packages\.lock\.json)$",
    "source_map": r"\.(js|mjs|cjs|css|ts|jsx|tsx)\.map$",
    "minified": r"([.-]min|\.bundle|\.chunk|\.packed)\.(js|mjs|cjs|css)$",
    "generated": r"(^|/)(__generated__|\.next|\.nuxt|\.svelte-kit|\.output|\.turbo|\.angular|\.parcel-cache|storybook-static)/|(^|/)dist/|(^|/)coverage/(lcov|.*\.(js|css|html|info)$)|(_pb2(_grpc)?\.pyi?|\.pb\.(go|cc|h|rs|dart)|\.pb\.gw\.go|_pb\.(js|ts|d\.ts)|_grpc_pb\.js|\.g\.(ts|dart|cs|js)|\.generated\.[a-z]+|\.gen\.(go|ts|js|rs)|\.designer\.cs|\.freezed\.dart|_generated\.(go|rs|py|ts))$",
    "vendored": r"(^|/)(node_modules|bower_components|vendor|vendored|third[_-]?party|godeps/_workspace|jspm_packages|external/deps|pods|carthage)/",
}
_NO_CASE = r"\.(png|jpe?g|gif|webp|svg|ico|bmp|tiff?|avif|pdf|zip|gz|tgz|bz2|xz|zst|7z|rar|tar|jar|war|woff2?|ttf|otf|eot|mp[34]|mov|webm|wav|ogg)$"

# What a notice at the top of a file says.
_GENERATED = re.compile(
    r"(?i)(?:code|file|source|content|class|module|document)s?\s+(?:is|was|were|has been|are|have been)?\s*(?:auto(?:matically)?[- ]?)?(?:generated|produced|created|emitted|written)\s+(?:automatically\s+)?(?:by|from|with|using)\b|"
    r"^\W*(?:auto-?matically\s+|auto-?)?(?:generated|created|produced|compiled|emitted)\s+(?:automatically\s+)?(?:by|from|with|using)\b|@generated\b|<auto-?generated|\bauto-?generated\s+(?:from|by|file|code|do not)|"
    r"\bdo not (?:edit|modify)\b(?!['\"`])|regenerate\w* instead of|changes (?:will|would) be (?:lost|overwritten)|^\W*built from \S+ (?:on|by|with|at|during)\b|^\W*tool: .* input: "
)
_VENDORED = re.compile(
    r"(?i)\bimported verbatim from\b|\bthird[- ]party copy of\b|\bupstream (?:release|version)\b.*\b(?:bundled|unchanged|unmodified)\b|\bbundled unchanged\b|^\W*[\w.@/-]+\.js v\d+(?:\.\d+)+ \|.*\(c\)|"
    r"\bvendored (?:from|copy)\b|\bcopied (?:verbatim |unchanged )?from (?:the )?upstream\b|\bsend (?:fixes|patches) upstream\b"
)
#: A notice that speaks of what the file makes, or says that it is kept by hand.
_BY_HAND = re.compile(r"(?i)edit (?:this file )?freely|hand[- ](?:maintained|written|edited)|by hand|own work|\bprints\b|\bemits\b|\bwrites the\b|\boutput of this\b|['\"`]do not edit")
# What opens a comment of several lines, and what closes it.
_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))
_COMMENT = re.compile(r"^\s*(?://|#(?!\[)|/\*|\*|--|<!--|;|%|\"\"\"|''')")
#: A numeric literal, a byte escape or a byte written as two hexadecimal digits.
_NUMBER = re.compile(r"(?<![A-Za-z_\d])(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![A-Za-z_\d])|\\x[0-9a-fA-F]{2}|(?<![0-9A-Za-z_])[0-9a-fA-F]{2}(?![0-9A-Za-z_])")
#: An encoded run: 40 or more characters of base64 or base16 that hold a digit, or letters of both cases.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_MIXED = re.compile(r"\d|[a-z].*[A-Z]|[A-Z].*[a-z]")
#: Of so many characters one is a digit before numeric literals are looked for.
_DIGIT_IN = 12
_NO_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
_NO_ALNUM = bytes(c for c in range(128) if not chr(c).isalnum())
_KEY_EDGE = re.compile(r"-----(BEGIN|END) ")
_INLINE_DATA = re.compile(r"data:[\w/+.;=-]+,|sourceMapping")
_MARKS = ";{}="
#: So many lines of code may stand before a notice; comment and empty lines are read without limit.
_TOP_CODE = 8


def body_lines(content: str | None, additions: list[str | None] | None) -> list[str]:
    """Lines of a hunk without signs: of content where its body was kept, else of additions."""
    added = [a for a in additions or [] if a is not None]
    kept: list[str] = []
    if content:
        rows = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        rows = rows[1:] if rows[0].startswith("@@") else rows
        new = [r[1:] for r in rows if r[:1] in ("+", " ")]
        kept = new or [r[1:] for r in rows if r[:1] == "-"]
    if len(kept) >= len(added):
        return kept
    return [x for a in added for x in a.replace("\r\n", "\n").replace("\r", "\n").split("\n")]


def notice(lines: list[str]) -> str | None:
    """generated or vendored, if a comment at the top of a file (the lines of its first hunk) says so."""
    code, closing = 0, None
    for line in lines:
        text = line.strip()
        if not text:
            continue
        if closing:
            inside, closing = True, None if closing in text else closing
        else:
            inside = bool(_COMMENT.match(line))
            closing = next((end for start, end in _BLOCKS if text.startswith(start) and end not in text[len(start) :]), None)
        if not inside:
            code += 1
            if code > _TOP_CODE:
                return None
            continue
        if _BY_HAND.search(text):
            continue
        text = re.sub(r"^\s*(?://+!?|#+|/\*+!?|\*+|--+|<!--|;+|%+|\"\"\"|''')\s*", "", text)
        if _GENERATED.search(text):
            return "generated"
        if _VENDORED.search(text):
            return "vendored"
    return None


def layout(lines: list[str]) -> tuple[int, int, int, int, int, int, int, int]:
    """Counts of one hunk: lines, characters, longest line, white space, letters and digits, statement
    marks, characters of numeric literals (digits only where these are few) and of encoded runs. Key blocks and
    inline images are no encoded runs."""
    text = "\n".join(lines)
    chars = sum(map(len, lines))
    longest = max(map(len, lines), default=0)
    blanks = max(0, chars - sum(map(len, text.split())))
    alnum = len(text.encode().translate(None, _NO_ALNUM)) if text.isascii() else sum(map(str.isalnum, text))
    if "-----" in text:
        kept, in_key = [], False
        for line in lines:
            if m := _KEY_EDGE.search(line):
                in_key = m[1] == "BEGIN" and "-----END" not in line
            elif not in_key:
                kept.append(line)
    else:
        kept = lines
    body = "\n".join(x for x in kept if not _INLINE_DATA.search(x)) if _INLINE_DATA.search(text) else "\n".join(kept)
    runs = 0
    if longest >= 40:
        runs = sum(len(m[0]) for m in _RUN.finditer(body) if _MIXED.search(m[0]))
    numbers = len(body.encode("ascii", "replace").translate(None, _NO_DIGIT))
    if numbers * _DIGIT_IN >= len(body):
        numbers = sum(len(m[0]) for m in _NUMBER.finditer(body))
    return len(lines), chars, longest, blanks, alnum, sum(map(text.count, _MARKS)), numbers, runs


_COUNTS = ("n_lines", "chars", "longest", "blanks", "alnum", "marks", "numbers", "runs")
_STATS_SCHEMA = "changeset_id string, path string, hunk_ord int, says string, " + ", ".join(f"{c} bigint" for c in _COUNTS)


def hunk_layout(hunks: DataFrame) -> DataFrame:
    """Layout counts of every hunk, one row per key; repeated rows count once.

    says: what a notice at the top of the hunk tells, which holds for the file if it is its first hunk.
    """
    schema = pa.schema([("changeset_id", pa.string()), ("path", pa.string()), ("hunk_ord", pa.int32()), ("says", pa.string()), *((c, pa.int64()) for c in _COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            cols = [batch.column(c).to_pylist() for c in ("changeset_id", "path", "hunk_ord", "content", "additions")]
            for cs, path, ord_, content, additions in zip(*cols):
                lines = body_lines(content, additions)
                rows.append((cs, path, ord_, notice(lines), *layout(lines)))
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    used = hunks.select("changeset_id", "path", "hunk_ord", "content", "additions").where("changeset_id is not null and path is not null")
    stats = used.mapInArrow(run, _STATS_SCHEMA)
    return stats.groupBy("changeset_id", "path", "hunk_ord").agg(F.max("says").alias("says"), *[F.max(c).alias(c) for c in _COUNTS])


def _language(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([a-z0-9]+)$", 1)
    return (
        F.when(ext.isin("js", "mjs", "cjs", "jsx", "ts", "tsx", "svelte", "vue"), "script")
        .when(ext.isin("css", "scss", "less"), "style")
        .when(ext.isin("md", "mdx", "rst", "txt", "adoc"), "prose")
        .when(ext.isin("json", "yaml", "yml", "toml", "xml", "html", "svg"), "markup")
        .otherwise("code")
    )


# Thresholds by language, set between the files of sf0.1 on either side (README: how, and the margins).
# minified: least longest line, least mean line, most white space, most and least letters and digits, least
# statement marks. data: least characters and share of numeric literals beside white space, least characters and share of encoded runs.
THRESHOLDS = {
    "script": (240, 155.0, 0.075, 0.90, 0.35, 0.03, 120, 0.17, 400, 0.80),
    "style": (240, 107.0, 0.040, 0.92, 0.35, 0.03, 120, 0.35, 400, 0.80),
    "code": (240, 155.0, 0.075, 0.92, 0.35, 0.03, 120, 0.35, 400, 0.80),
    "markup": (800, 300.0, 0.050, 0.92, 0.25, 0.03, 400, 0.50, 800, 0.85),
    "prose": (2000, 1000.0, 0.030, 0.92, 0.35, 0.03, 400, 0.50, 800, 0.85),
}

# Notes of skipped entries that name the kind of file.
_NOTE_RULES = {
    "generated": r"(?i)machine[- ]?(written|generated|made)|auto(matically)?[- ]?generated|\bgenerated (by|from|file|code)|compiled output|output of (the|a) \w+ (exporter|compiler|generator)|build (output|artifact)",
    "vendored": r"(?i)third[- ]party|vendored|bundled (copy|release)|upstream (copy|release)",
    "minified": r"(?i)minified|one line of \d+|longest line over|single line",
    "data": r"(?i)numeric table|data (blob|dump|table)|emitted by a script|binary data as code|encoded blob",
}


def classify_files(files: DataFrame, hunks: DataFrame, skipped: DataFrame) -> DataFrame:
    """changeset_id, path, file_class, evidence of every file that is not written by hand.

    file_class is lock, source_map, minified, generated, vendored or data, evidence layout,
    path, notice or note. One row per file of the change set; files without hunks are
    judged by path and note alone. Images, archives and fonts are never cases. Null paths
    and change sets are ignored, null texts say nothing, repeated rows count once.
    """
    keys = ["changeset_id", "path"]
    per_hunk = hunk_layout(hunks)
    stats = per_hunk.groupBy(*keys).agg(F.min_by(F.struct("says"), F.coalesce("hunk_ord", F.lit(0))).getField("says").alias("says"), *[(F.max if c == "longest" else F.sum)(c).alias(c) for c in _COUNTS])
    notes = skipped.where("changeset_id is not null and path is not null").groupBy(*keys).agg(F.concat_ws("\n", F.collect_set("note"), F.collect_set("reason")).alias("note"))
    path = F.lower(F.regexp_replace(F.col("path"), r"\\", "/"))
    chosen = F.create_map(*[x for lang, t in THRESHOLDS.items() for x in (F.lit(lang), F.array(*[F.lit(float(v)) for v in t]))])
    limit = lambda i: F.element_at(chosen, _language(path))[i]
    c = F.col
    some = F.greatest(c("chars"), F.lit(1))
    minified = (
        (c("longest") >= limit(0))
        & (some >= limit(1) * F.greatest(c("n_lines"), F.lit(1)))
        & (c("blanks") <= limit(2) * some)
        & c("alnum").between(limit(4) * some, limit(3) * some)
        & (c("marks") >= limit(5) * some)
    )
    data = ((c("chars") >= limit(6)) & (c("numbers") >= limit(7) * (some - c("blanks")))) | ((c("chars") >= limit(8)) & (c("runs") >= limit(9) * some))
    by_path = F.coalesce(*[F.when(path.rlike(rule), F.lit(kind)) for kind, rule in PATH_RULES.items()])
    by_note = F.coalesce(*[F.when(F.col("note").rlike(rule), F.lit(kind)) for kind, rule in _NOTE_RULES.items()])
    by_layout = F.when(data, "data").when(minified, "minified")
    judged = (
        files.where("changeset_id is not null and path is not null")
        .select(*keys)
        .distinct()
        .where(~path.rlike(_NO_CASE))
        .join(stats, keys, "left")
        .join(notes, keys, "left")
        .withColumn("by_path", by_path)
        .withColumn("by_layout", by_layout)
        .withColumn("by_note", by_note)
        .withColumn("file_class", F.coalesce("by_layout", "by_path", "says", "by_note"))
        .where("file_class is not null")
    )
    evidence = F.when(F.col("by_layout").isNotNull(), "layout").when(F.col("by_path").isNotNull(), "path").when(F.col("says").isNotNull(), "notice").otherwise("note")
    return judged.select(*keys, "file_class", evidence.alias("evidence"))
