"""Filling fixed-capacity containers with documents (problem 6).

Items are packed by size classes, not one by one: the plan depends only on how many
documents have which length, so it is made on the driver from a histogram and its
parts have multiplicities. Items above a third of the capacity go at most two to a
container, matched greedily (the largest with the largest that still fits beside it);
smaller items then go by size into the tightest remaining gaps. Each document takes
the place in the plan that its rank among the documents of its length gives it.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffloom.runtime import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer parts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents ranked by one task at most, about.
RANK_ROWS = 50_000


@cache
def tokenizer(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, tokens of every document with a non-empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_to_numpy
        for batch in batches:
            lengths = [len(encode(t, disallowed_special=())) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lengths, pa.int64())], schema=schema)

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null and text <> ''").mapInArrow(run, "doc_id bigint, tokens bigint")


@dataclass
class Bins:
    """A number of containers with the same contents: pairs of (item size, items of it in each)."""

    number: int
    contents: list[tuple[int, int]] = field(default_factory=list)


def pack(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Containers for counts[size] items of each size (1..capacity)."""
    left = {s: n for s, n in counts.items() if n}
    gaps: dict[int, list[Bins]] = defaultdict(list)
    open_gaps: list[int] = []

    def put(bins: Bins, gap: int) -> None:
        if gap not in gaps or not gaps[gap]:
            insort(open_gaps, gap)
        gaps[gap].append(bins)

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    partners = large[::-1]
    for s in large:
        while left.get(s):
            at = bisect_left(partners, capacity - s + 1) - 1
            while at >= 0 and not left.get(partners[at], 0) - (partners[at] == s and left[s] < 2):
                partners.pop(at)
                at -= 1
            if at < 0:
                put(Bins(left.pop(s), [(s, 1)]), capacity - s)
                break
            t = partners[at]
            if t == s:
                n = left[s] // 2
                left[s] -= 2 * n
                put(Bins(n, [(s, 2)]), capacity - 2 * s)
                if left[s]:
                    partners.pop(at)
            else:
                n = min(left[s], left[t])
                left[s] -= n
                left[t] -= n
                put(Bins(n, [(s, 1), (t, 1)]), capacity - s - t)
    for s in sorted((s for s in left if left[s]), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(open_gaps, s)
            if at == len(open_gaps):
                put(Bins(-(-n // (capacity // s))), capacity)
                continue
            gap = open_gaps[at]
            bins = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(at)
            each = gap // s
            full = min(bins.number, n // each)
            if full:
                put(Bins(full, [*bins.contents, (s, each)]), gap - each * s)
                n -= full * each
            rest = bins.number - full
            if rest and n and n < each:
                put(Bins(1, [*bins.contents, (s, n)]), gap - n * s)
                rest, n = rest - 1, 0
            if rest:
                put(Bins(rest, bins.contents), gap)
    return [b for group in gaps.values() for b in group if b.contents]


@dataclass
class Plan:
    """Where the documents of one kind of container go: by length, rank offset, first own container, and
    by item size the runs of ranks (starts, first container, items in each container)."""

    kind: str
    capacity: int
    offset: dict[int, int]
    own: dict[int, int]
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def make_plan(kind: str, capacity: int, lengths: dict[int, int]) -> Plan:
    """The plan for lengths[tokens] documents of each length."""
    sizes: dict[int, int] = defaultdict(int)
    offset: dict[int, int] = {}
    for tokens in sorted(lengths):
        size = tokens if tokens <= capacity else tokens % capacity
        offset[tokens] = sizes[size]
        if size:
            sizes[size] += lengths[tokens]
    container = 0
    parts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for bins in pack({s: n for s, n in sizes.items() if s}, capacity):
        for size, each in bins.contents:
            parts[size].append((bins.number * each, container, each))
        container += bins.number
    runs = {}
    for size, rows in parts.items():
        starts = np.concatenate([[0], np.cumsum([r[0] for r in rows])[:-1]])
        runs[size] = (starts, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    own = {}
    for tokens in sorted(lengths):
        if tokens > capacity:
            own[tokens] = container
            container += lengths[tokens] * (tokens // capacity)
    return Plan(kind, capacity, offset, own, runs)


ASSIGNMENT_SCHEMA = "container_kind string, container_id bigint, doc_id bigint, piece_ord int, start_token bigint, tokens bigint"
_ASSIGNMENT = pa.schema([("container_kind", pa.string()), ("container_id", pa.int64()), ("doc_id", pa.int64()), ("piece_ord", pa.int32()), ("start_token", pa.int64()), ("tokens", pa.int64())])


def _place(plan: Plan, doc_id: np.ndarray, tokens: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Columns (container, doc, piece, start, tokens) of the pieces of documents, given their rank in their length."""
    size = np.where(tokens <= plan.capacity, tokens, tokens % plan.capacity)
    pieces = np.where(tokens <= plan.capacity, 0, tokens // plan.capacity)
    at = rank + np.array([plan.offset[t] for t in tokens.tolist()], dtype=np.int64)
    container = np.full(len(doc_id), -1, dtype=np.int64)
    order = np.argsort(size, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if len(group) and size[group[0]]:
            starts, first, each = plan.runs[int(size[group[0]])]
            k = np.searchsorted(starts, at[group], side="right") - 1
            container[group] = first[k] + (at[group] - starts[k]) // each[k]
    some = size > 0
    out = [(container[some], doc_id[some], pieces[some], pieces[some] * plan.capacity, size[some])]
    big = np.flatnonzero(pieces)
    if len(big):
        n = pieces[big]
        which = np.repeat(big, n)
        piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        base = np.array([plan.own[t] for t in tokens[big].tolist()], dtype=np.int64) + rank[big] * n
        out.append((np.repeat(base, n) + piece, doc_id[which], piece, piece * plan.capacity, np.full(len(which), plan.capacity)))
    return out


def ranked_lengths(lengths: DataFrame, most: int, rank_rows: int = RANK_ROWS) -> DataFrame:
    """doc_id, tokens, rank (from 0, dense) among the documents of the same length.

    most: documents of the commonest length; such lengths are ranked in salted parts
    of about rank_rows rows, which the counts of the parts then put one after another.
    """
    salts = max(1, -(-most // rank_rows))
    salted = lengths.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    rank = F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id")) - 1
    ranked = salted.withColumn("rank", rank.cast("long"))
    if salts > 1:
        before = Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        starts = salted.groupBy("tokens", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
        ranked = ranked.join(starts, ["tokens", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "tokens", "rank")


def assign_containers(documents: DataFrame, containers: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """The container of every document, for each kind of container on its own (ASSIGNMENT_SCHEMA).

    Documents with null or empty text or null doc_id get none. A document that exceeds
    the capacity fills containers of its own and its rest is an item like any other;
    nothing else is divided. Kinds with a null name or a capacity below 1 are left out.
    The driver holds how many documents have which length, never documents.
    """
    spark = documents.sparkSession
    lengths = cut_lineage(token_lengths(documents, tokenizer_path))
    histogram = {r["tokens"]: r["count"] for r in lengths.groupBy("tokens").count().toLocalIterator()}
    kinds = containers.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity")).orderBy("container_kind")
    plans = spark.sparkContext.broadcast([make_plan(r["container_kind"], r["capacity"], histogram) for r in kinds.toLocalIterator()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, tokens, rank = (batch.column(c).to_numpy() for c in ("doc_id", "tokens", "rank"))
            if not len(doc_id):
                continue
            for plan in plans.value:
                for columns in _place(plan, doc_id, tokens, rank):
                    arrays = [pa.array([plan.kind] * len(columns[0]), pa.string())]
                    yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, t.type) for c, t in zip(columns, list(_ASSIGNMENT)[1:]))], schema=_ASSIGNMENT)

    return ranked_lengths(lengths, max(histogram.values(), default=0)).mapInArrow(run, ASSIGNMENT_SCHEMA)


def container_fill(assignment: DataFrame, containers: DataFrame) -> DataFrame:
    """container_kind, container_id, documents, used_tokens, free_tokens of every container in use."""
    used = assignment.groupBy("container_kind", "container_id").agg(F.count("*").alias("documents"), F.sum("tokens").alias("used_tokens"))
    capacity = containers.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    return used.join(capacity, "container_kind").select("container_kind", "container_id", "documents", "used_tokens", (F.col("capacity") - F.col("used_tokens")).alias("free_tokens"))
