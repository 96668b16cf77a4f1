"""Splitting oversized items at natural boundaries (problem 1).

An item is all lines of one path in one change set. For every item above its limit
the least number of pieces is counted, as many equal-length targets are placed, and
each target moves to the strongest boundary near it: the end of a hunk, else of a
block, else of a line, else (for a line longer than the limit) a place inside the
line. A target moves only so far that every piece, with the lines it repeats from the
piece before, keeps the limit and the rest still fits in the pieces left.

Items are cut in blocks of bounded size, so that one giant item is spread over many
tasks; a block also gets the last lines of the block before it, for the overlap. That
is enough: a block holds many limits, so lines before it never fit in an overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffloom.runtime import cut_lineage, semi_join

#: Lines of one hunk are gathered in chunks of this many line places.
CHUNK_LINES = 512
#: Hunks per first level of the prefix sum.
HUNK_RUN = 256
#: A block holds about this many times the limit.
BLOCK_LIMITS = 64

HUNK_END, BLOCK_END, LINE_END, INSIDE = 3, 2, 1, 0
END_NAMES = {HUNK_END: "hunk", BLOCK_END: "block", LINE_END: "line", INSIDE: "inside"}
_CLOSERS = ("}", ")", "]", "end", "</")
_SIGN = {"add": "+", "del": "-"}

PIECE_SCHEMA = (
    "changeset_id string, path string, block bigint, piece_in_block int, first_hunk int, first_line int, last_hunk int, last_line int, "
    "repeated_lines int, repeated_chars bigint, size bigint, max_chars int, ends_at string, text string"
)

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
_PIECE = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in PIECE_SCHEMA.split(", "))])


def segment_lengths(text: str, room: int) -> list[int]:
    """Lengths of the parts of one line, each at most room, cut after a blank or mark where one is in the last quarter."""
    out, at = [], 0
    while len(text) - at > room:
        end = at + room
        for back in range(end, max(at + 1, end - room // 4), -1):
            if not text[back - 1].isalnum():
                end = back
                break
        out.append(end - at)
        at = end
    out.append(len(text) - at)
    return out


def line_strength(text: str, next_text: str | None, same_hunk: bool, same_kind: bool) -> int:
    """How natural the end of a line is as the end of a piece."""
    if not same_hunk or next_text is None:
        return HUNK_END
    body, after = text.strip(), next_text.strip()
    if not after or not body:
        return BLOCK_END
    indent = lambda s: len(s) - len(s.lstrip())
    if body.startswith(_CLOSERS) and indent(next_text) <= indent(text):
        return BLOCK_END
    if indent(next_text) < indent(text) or not same_kind:
        return BLOCK_END
    return LINE_END


def reaches(total: np.ndarray, line_of: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start of a piece the first unit it repeats, and the farthest end within the limit.

    The last ``overlap`` lines before the start are repeated, fewer only where the limit
    leaves no room for them beside one new unit.
    """
    n = len(total) - 1
    starts = np.arange(n)
    wanted = np.searchsorted(line_of, line_of[np.maximum(starts - 1, 0)] - overlap + 1)
    wanted = np.where(starts == 0, 0, np.minimum(wanted, starts)) if overlap > 0 else starts
    again = np.minimum(np.maximum(wanted, np.searchsorted(total, total[1:] - limit)), starts)
    ends = np.searchsorted(total, total[again] + limit, side="right") - 1
    return again, np.maximum(ends, starts + 1)


def plan_cuts(sizes: list[int], strengths: list[int], line_of: list[int], limit: int, overlap: int, before: int = 0) -> tuple[list[int], list[int]]:
    """Ends of pieces (exclusive positions) and the number of units each piece repeats.

    sizes: of the units (lines, or parts of lines), each at most limit. strengths: of
    the end of each unit. line_of: the line each unit belongs to, ascending. The first
    ``before`` units belong to the piece before and are there only to be repeated. The
    number of pieces is the least that limit and overlap allow.
    """
    n = len(sizes)
    if n == before:
        return [], []
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    again, reach = reaches(total, np.asarray(line_of), limit, overlap)
    pieces, at = 0, before
    while at < n:
        at, pieces = int(reach[at]), pieces + 1
    # Where the k-th piece must end at the earliest, so that the others can take the rest.
    earliest = [n]
    for _ in range(pieces - 1):
        earliest.append(max(before, int(np.searchsorted(reach, earliest[-1]))))
    earliest.reverse()
    at_least = {s: np.flatnonzero(np.asarray(strengths) >= s) + 1 for s in (HUNK_END, BLOCK_END, LINE_END, INSIDE)}
    step = (int(total[n]) - int(total[before])) / pieces
    ends: list[int] = []
    start = before
    for k in range(1, pieces):
        low, high = max(earliest[k - 1], start + 1), min(int(reach[start]), n - (pieces - k))
        target, best = int(total[before]) + step * k, None
        for s in (HUNK_END, BLOCK_END, LINE_END, INSIDE):
            at_s = at_least[s]
            some = at_s[np.searchsorted(at_s, low) : np.searchsorted(at_s, high, side="right")]
            if not len(some):
                continue
            near = int(some[np.abs(total[some] - target).argmin()])
            # A line end is taken however far the window lets it be; stronger ends only near their target.
            if abs(int(total[near]) - target) <= step / 3 or s <= LINE_END:
                best = near
                break
        start = high if best is None else best
        ends.append(start)
    ends.append(n)
    starts = [before, *ends[:-1]]
    return ends, [s - int(again[s]) for s in starts]


def cut_block(lines: list[tuple[int, int, str, str, bool]], limit: int, overlap: int) -> list[tuple]:
    """Pieces of one block; lines are (hunk_ord, line_ord, kind, text, belongs to the block before)."""
    limit = max(limit, 3)
    units: list[tuple[int, int, str, str]] = []
    strengths: list[int] = []
    line_of: list[int] = []
    before = 0
    for i, (hunk, line, kind, text, halo) in enumerate(lines):
        after = lines[i + 1] if i + 1 < len(lines) else None
        if after is None and line % CHUNK_LINES == CHUNK_LINES - 1:
            end = LINE_END  # the hunk may go on in the next block
        else:
            end = line_strength(text, after[3] if after else None, after is not None and after[0] == hunk, after is not None and after[2] == kind)
        if len(text) + 2 <= limit:
            units.append((hunk, line, kind, text))
            strengths.append(end)
        else:
            at = 0
            for length in segment_lengths(text, limit - 2):
                units.append((hunk, line, kind, text[at : at + length]))
                strengths.append(INSIDE)
                at += length
            strengths[-1] = end
        line_of += [i] * (len(units) - len(line_of))
        if halo:
            before = len(units)
    ends, repeats = plan_cuts([len(u[3]) + 2 for u in units], strengths, line_of, limit, overlap, before)
    out, start = [], before
    for k, (end, again) in enumerate(zip(ends, repeats)):
        part = units[start - again : end]
        text = "".join(f"{_SIGN.get(u[2], ' ')}{u[3]}\n" for u in part)
        repeated = sum(len(u[3]) + 2 for u in part[:again])
        n_lines = len(set(line_of[start - again : start]))
        out.append((k, units[start][0], units[start][1], part[-1][0], part[-1][1], n_lines, repeated, len(text), END_NAMES[strengths[end - 1]], text))
        start = end
    return out


def split_oversized(lines: DataFrame, options: DataFrame) -> DataFrame:
    """Ordered pieces of every item larger than the limit of its change set.

    lines: changeset_id, path, hunk_ord, line_ord, kind, text; options: changeset_id,
    max_chars, overlap_lines (null counts as 0). Repeated rows count once, null text
    is an empty line, a null max_chars or a change set without options means no limit;
    rows with a null in the key are ignored. A limit below 3 counts as 3, as no line
    is shorter. Result: PIECE_SCHEMA with piece_ord, the place of the piece in its
    item. first_hunk, first_line name the first line that is not repeated. text has a
    sign and a line end for each line, or part of a line above the limit, so its length
    is the size; without its first repeated_chars the pieces make up the item.
    """
    keys = ["changeset_id", "path"]
    limits = options.where("changeset_id is not null and max_chars is not null").groupBy("changeset_id").agg(F.min("max_chars").alias("max_chars"), F.max(F.coalesce("overlap_lines", F.lit(0))).alias("overlap"))
    usable = semi_join(lines.where("changeset_id is not null and path is not null and hunk_ord is not null and line_ord is not null"), limits, ["changeset_id"]).select(
        *keys, "hunk_ord", F.floor(F.col("line_ord") / F.lit(CHUNK_LINES)).alias("part"), "line_ord", "kind", F.coalesce("text", F.lit("")).alias("text")
    )
    in_chunks = lambda rows, line: rows.groupBy(*keys, "hunk_ord", "part").agg(F.collect_set(line).alias("lines"))
    # Sizes need lengths only; of the texts only those of oversized items are gathered, below.
    sizes = in_chunks(usable, F.struct("line_ord", F.length("text").alias("n")))
    places = cut_lineage(sizes.select(*keys, "hunk_ord", "part", F.size("lines").alias("n_lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + x["n"] + F.lit(2)).alias("size")))
    places = places.withColumn("run", F.floor(F.col("hunk_ord") / F.lit(HUNK_RUN)))
    runs = places.groupBy(*keys, "run").agg(F.sum("size").alias("run_size"), F.sum("n_lines").alias("run_lines"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        runs.withColumn("item_size", F.sum("run_size").over(whole))
        .withColumn("size_before", F.coalesce(F.sum("run_size").over(earlier), F.lit(0)))
        .withColumn("lines_before", F.coalesce(F.sum("run_lines").over(earlier), F.lit(0)))
        .join(limits, "changeset_id")
        .where("item_size > max_chars")
        .drop("run_size", "run_lines")
    )
    inside = Window.partitionBy(*keys, "run").orderBy("hunk_ord", "part")
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    step = F.greatest(F.col("max_chars"), F.lit(3)).cast("long") * F.lit(BLOCK_LIMITS)
    assigned = (
        places.join(runs, [*keys, "run"])
        .withColumn("size_to", F.col("size_before") + F.sum("size").over(up_to))
        .withColumn("lines_to", F.col("lines_before") + F.sum("n_lines").over(up_to))
        .withColumn("block", F.floor((F.col("size_to") - F.col("size")) / step))
        .withColumn("block_end", F.max("lines_to").over(Window.partitionBy(*keys, "block")))
        # The next chunk starts where the last of the block ends, more than one block on if that is larger than a step.
        .withColumn("next", F.floor(F.max("size_to").over(Window.partitionBy(*keys, "block")) / step))
        .withColumn("halo", (F.col("block_end") - F.col("lines_to") < F.col("overlap")) & (F.col("next") > F.col("block")))
        .select(*keys, "hunk_ord", "part", "max_chars", "overlap", F.explode(F.filter(F.array(F.struct(F.col("block"), F.lit(False).alias("halo")), F.when(F.col("halo"), F.struct(F.col("next").alias("block"), F.lit(True).alias("halo")))), lambda x: x.isNotNull())).alias("to"))
    )
    oversized = semi_join(usable, runs.select(*keys).distinct(), keys)
    blocks = (
        in_chunks(oversized, F.struct("line_ord", "kind", "text"))
        .join(assigned, [*keys, "hunk_ord", "part"])
        .groupBy(*keys, F.col("to.block").alias("block"))
        .agg(F.max("max_chars").alias("max_chars"), F.max("overlap").alias("overlap"), F.collect_list(F.struct("hunk_ord", "part", F.col("to.halo").alias("halo"), "lines")).alias("chunks"))
        .where(F.exists("chunks", lambda c: ~c["halo"]))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for item in batch.to_pylist():
                rows = []
                for chunk in sorted(item["chunks"], key=lambda c: (c["hunk_ord"], c["part"])):
                    rows += [(chunk["hunk_ord"], x["line_ord"], x["kind"], x["text"], chunk["halo"]) for x in sorted(chunk["lines"], key=lambda x: x["line_ord"])]
                head = (item["changeset_id"], item["path"], item["block"])
                made += [(*head, *p[:8], item["max_chars"], *p[8:]) for p in cut_block(rows, item["max_chars"], item["overlap"])]
            columns = list(zip(*made)) if made else [()] * len(_PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)

    pieces = cut_lineage(blocks.mapInArrow(run, PIECE_SCHEMA))
    # A piece's place is its place in its block and the pieces of earlier blocks; only numbers are shuffled for it.
    per_block = pieces.groupBy(*keys, "block").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*keys, "block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("piece_in_block")).cast("int").alias("piece_ord")
    return pieces.join(offsets, [*keys, "block"]).select(*_PIECE.names, place)


def piece_checks(pieces: DataFrame) -> DataFrame:
    """changeset_id, path, pieces, chars, first_hunk, first_line, last_hunk, last_line, faults of every item cut.

    chars: of the texts of all lines, without what is repeated. faults: pieces above
    the limit, out of order, or without the overlap that the limit leaves room for.
    Only numbers of the pieces are shuffled.
    """
    keys = ["changeset_id", "path"]
    rows = F.size(F.split(F.expr("substring(text, repeated_chars + 1)"), "\n", -1)) - 1
    own = F.col("size") - F.col("repeated_chars")
    short = pieces.select(
        *keys, "piece_ord", "size", "max_chars", "first_hunk", "first_line", "last_hunk", "last_line", (own - 2 * rows).alias("chars"),
        F.struct(F.col("first_hunk"), F.col("first_line")).alias("starts"), F.struct(F.col("last_hunk").alias("first_hunk"), F.col("last_line").alias("first_line")).alias("stops"),
    )
    order = Window.partitionBy(*keys).orderBy("piece_ord")
    fault = (F.col("size") > F.greatest(F.col("max_chars"), F.lit(3))) | (F.coalesce(F.lag("stops").over(order) > F.col("starts"), F.lit(False))) | (F.row_number().over(order) - 1 != F.col("piece_ord"))
    told = short.withColumn("fault", fault)
    ends = lambda c, by, pick: pick(c, by).alias(c)
    return told.groupBy(*keys).agg(
        F.sum("chars").alias("chars"), *[ends(c, "piece_ord", F.min_by) for c in ("first_hunk", "first_line")], *[ends(c, "piece_ord", F.max_by) for c in ("last_hunk", "last_line")], F.count_if("fault").alias("faults")
    )
