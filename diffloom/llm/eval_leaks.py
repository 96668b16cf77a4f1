"""Evaluation texts leaking into training text (problem 7).

Word pairs that occur in one evaluation item only are the seeds. Documents are joined
with items that share seeds on about one diagonal, and each such meeting is aligned
by Smith-Waterman over words, so passages with words changed or left out are found.
Passages without enough such pairs are reached by cuts: every passage crosses the
rarest place of its words by one of three pairs, whichever single words are changed;
its equal words must then tell the item from others.
A passage counts if its words stand in a row in the item apart from single words, and
are not wording that several items share.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.normalise import words
from diffloom.runtime import cut_lineage

MATCH_SCHEMA = "doc_id bigint, item_id bigint, part string, run_words int, matched_words int, score int, first_word int"
_RESULT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("part", pa.string()), ("run_words", pa.int32()), ("matched_words", pa.int32()), ("score", pa.int32()), ("first_word", pa.int32())])


@dataclass(frozen=True)
class LeakOptions:
    """min_run: words in a row that make a leak; min_matched: share of them that must be equal;
    shared_words: wording of this many words in several items counts as shared; min_seeds: seeds that
    must meet before an alignment, or that tell the item of a passage found by a cut; block_words: item words that
    one pass over the documents takes, which bounds what is broadcast; tile_words: words of a document and of an
    item that one alignment takes, beside the overlap of tiles."""

    min_run: int = 12
    min_matched: float = 0.6
    shared_words: int = 6
    min_seeds: int = 2
    block_words: int = 2_000_000
    tile_words: int = 512


@dataclass
class Sequence:
    """Words of one text of an item; own: they lie in no wording of several items; one, skip, three: the pair,
    the pair with a word between, the trigram that starts at a word is held by this item only."""

    item_id: int
    part: str
    words: list[str]
    own: list[bool]
    one: list[bool]
    skip: list[bool]
    three: list[bool]

    @classmethod
    def of(cls, item_id: int, part: str, words_: list[str], shared: dict[str, set[int]], n: int) -> Sequence:
        """shared: by kind of gram the places where one starts that other items hold too."""
        own = [True] * len(words_)
        for i in shared.get("window", ()):
            own[i : i + n] = [False] * n
        free = lambda kind: [i not in shared.get(kind, ()) for i in range(len(words_))]
        return cls(item_id, part, words_, own, free("one"), free("skip"), free("three"))


_WORDS_SCHEMA = "item_id bigint, part string, words array<string>"
_WORDS = pa.schema([("item_id", pa.int64()), ("part", pa.string()), ("words", pa.list_(pa.string()))])


def item_words(items: DataFrame, options: LeakOptions) -> DataFrame:
    """item_id, part, words of the texts of evaluation items with at least min_run words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [(i, p, words(t)) for i, p, t in zip(*(batch.column(c).to_pylist() for c in ("item_id", "part", "text")))]
            columns = list(zip(*(q for q in seqs if len(q[2]) >= options.min_run))) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WORDS)], schema=_WORDS)

    texts = F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("text")) for p in ("item_text", "answer_text")])
    return items.where("item_id is not null").select("item_id", F.explode(texts).alias("t")).select("item_id", "t.*").where("text is not null").mapInArrow(run, _WORDS_SCHEMA)


def shared_grams(sequences: DataFrame, options: LeakOptions) -> DataFrame:
    """item_id, part, kind, places: where grams start that several items hold, counted over all items.

    kind: window (shared_words words), one (a pair), skip (a pair with a word between), three (a trigram).
    """
    n, c = options.shared_words, F.col
    gram = lambda kind, size, *at: F.transform(
        F.when(F.size("words") >= size, F.sequence(F.lit(0), F.size("words") - size)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.concat_ws(" ", *([F.get("words", i + k) for k in at] or [F.slice("words", i + 1, n)])).alias("gram")),
    )
    grams = sequences.select("item_id", "part", F.explode(F.concat(gram("window", n), gram("one", 2, 0, 1), gram("skip", 3, 0, 2), gram("three", 3, 0, 1, 2))).alias("g")).select("item_id", "part", "g.*")
    several = grams.groupBy("kind", "gram").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).where("a <> b").select("kind", "gram")
    return grams.join(several, ["kind", "gram"], "left_semi").groupBy("item_id", "part", "kind").agg(F.collect_list(c("place")).alias("places"))


def seed_index(sequences: list[Sequence]) -> dict[tuple[str, str], list[tuple[int, int]]]:
    """Pairs of neighbouring own words of a single item -> their (sequence, place)."""
    places: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
    for s, seq in enumerate(sequences):
        for i in range(len(seq.words) - 1):
            if seq.one[i] and seq.own[i] and seq.own[i + 1]:
                places[seq.words[i], seq.words[i + 1]].append((s, i))
    return dict(places)


def cut_index(sequences: list[Sequence], n: int) -> dict[tuple[str, str], list[tuple[int, int, int]]]:
    """Word pairs that no passage can avoid -> their (sequence, place, words from the first to the second).

    A passage leaves out at most single words, so it goes from word j or before to a word after j by one of
    the pairs (j, j + 1), (j - 1, j + 1), (j, j + 2). Of every n own words the place j with the rarest such
    pairs is taken, whether or not other items hold them.
    """
    count: Counter[tuple[str, str]] = Counter()
    for seq in sequences:
        for step in (1, 2):
            count.update(zip(seq.words, seq.words[step:]))
    places: dict[tuple[str, str], list[tuple[int, int, int]]] = defaultdict(list)
    for s, seq in enumerate(sequences):
        words_, own = seq.words, seq.own
        crossing = [[(a, b) for a, b in ((j, j + 1), (j - 1, j + 1), (j, j + 2)) if a >= 0 and b < len(own) and own[a] and own[b]] for j in range(len(own) - 1)]
        cost = [sum(count[words_[a], words_[b]] for a, b in c) for c in crossing]
        chosen, row = set(), 0
        for end, o in enumerate(own):
            row = row + 1 if o else 0
            if row >= n:
                chosen.update(crossing[min(range(end - n + 1, end), key=cost.__getitem__)])
        for a, b in sorted(chosen):
            places[words_[a], words_[b]].append((s, a, b - a))
    return dict(places)


def tells_item(equal: set[tuple[int, int]], seq: Sequence, options: LeakOptions) -> bool:
    """Whether equal (document, item) places tell the item from others: shared_words own words in a row, or
    min_seeds pairs, skipping pairs or trigrams that only this item holds and that have no word in common."""
    spans = []
    for d, i in equal:
        if (d - 1, i - 1) not in equal and all((d + k, i + k) in equal for k in range(options.shared_words)):
            return True
        near, far = (d + 1, i + 1) in equal, (d + 2, i + 2) in equal
        if near and seq.one[i]:
            spans.append((i + 1, i))
        elif far and (seq.skip[i] or near and seq.three[i]):
            spans.append((i + 2, i))
    told, last = 0, -1
    for end, start in sorted(spans):
        if start > last:
            told, last = told + 1, end
    return told >= options.min_seeds


@dataclass
class Block:
    """Sequences with their indexes, built once where they are used."""

    sequences: list[Sequence]
    options: LeakOptions

    @cached_property
    def seeds(self) -> dict[tuple[str, str], list[tuple[int, int]]]:
        return seed_index(self.sequences)

    @cached_property
    def cuts(self) -> dict[tuple[str, str], list[tuple[int, int, int]]]:
        return cut_index(self.sequences, self.options.min_run)


def chain(seq: Sequence, doc: list[str], first: tuple[int, int], second: tuple[int, int], n: int) -> set[tuple[int, int]] | None:
    """The equal (document, item) places that two of them lead to in the steps best_run allows, or None if
    they cover fewer than n item words."""
    item, own = seq.words, seq.own

    def reach(at: tuple[int, int], way: int) -> set[tuple[int, int]]:
        seen, todo = {at}, [at]
        while todo:
            d, i = todo.pop()
            for i2 in (i + way, i + 2 * way):
                if not (0 <= i2 < len(item) and own[i2] and abs(i2 - at[1]) <= 2 * n):
                    continue
                for d2 in (d + way, d + 2 * way, d + 3 * way):
                    if 0 <= d2 < len(doc) and doc[d2] == item[i2] and (d2, i2) not in seen:
                        seen.add((d2, i2))
                        todo.append((d2, i2))
        return seen

    met = reach(first, -1) | reach(second, 1)
    places = [i for _, i in met]
    return met if max(places) - min(places) + 1 >= n else None


def align(item: list[str], own: list[bool], doc: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """Smith-Waterman over words: score and the equal (document, item) places of the best local alignment.

    Equal words give 2, changed, left-out or added ones cost 1; shared words of the item equal nothing.
    """
    code = {w: k for k, w in enumerate(dict.fromkeys(item))}
    a = np.array([code[w] if o else -2 for w, o in zip(item, own)], dtype=np.int32)
    b = np.array([code.get(w, -1) for w in doc], dtype=np.int32)
    n, m = len(b), len(a)
    equal = b[:, None] == a[None, :]
    gain = np.where(equal, 2, -1).astype(np.int32)
    h = np.zeros((n + 1, m + 1), dtype=np.int32)
    slope = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.maximum(h[i - 1, :-1] + gain[i - 1], h[i - 1, 1:] - 1)
        row = np.maximum(np.concatenate([[0], row]), 0)
        h[i] = np.maximum.accumulate(row + slope) - slope
    i, j = divmod(int(h.argmax()), m + 1)
    score, path = int(h[i, j]), []
    while i and j and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + gain[i - 1, j - 1]:
            i, j = i - 1, j - 1
            if equal[i, j]:
                path.append((i, j))
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, path[::-1]


def best_run(path: list[tuple[int, int]], options: LeakOptions) -> tuple[int, int, int] | None:
    """(item words covered, of them equal, first document place) of the longest run of item words in a row,
    apart from single ones; None if it is shorter than min_run."""
    best = None
    start = 0
    for k in range(1, len(path) + 1):
        if k < len(path) and path[k][1] - path[k - 1][1] <= 2 and path[k][0] - path[k - 1][0] <= 3:
            continue
        span, same = path[k - 1][1] - path[start][1] + 1, k - start
        if span >= options.min_run and same >= options.min_matched * span and (best is None or span > best[0]):
            best = (span, same, path[start][0])
        start = k
    return best


def _spans(places: list[int], length: int, size: int, margin: int) -> list[tuple[int, int]]:
    """Overlapping spans of at most size places, and a margin on both sides, that hold all places (ascending)."""
    out, at = [], 0
    while at < len(places):
        low = places[at]
        end = at
        while end + 1 < len(places) and places[end + 1] - low < size:
            end += 1
        out.append((max(0, low - margin), min(length, places[end] + margin + 1)))
        if end + 1 == len(places):
            break
        # The next span starts a margin before the last place of this one, so that a passage over both is joined.
        back = end
        while back > at + 1 and places[end] - places[back - 1] <= margin:
            back -= 1
        at = back if back > at else end + 1
    return out


def aligned(seq: Sequence, doc: list[str], met: list[tuple[int, int]], options: LeakOptions) -> tuple[int, int, int, int] | None:
    """(item words in a row, equal words, score, first word) of the longest passage near seeds (document, item).

    Tiles of bounded size are aligned; where the best alignment of a tile is no passage the next best is tried,
    and places of neighbouring tiles are joined.
    """
    margin, floor = 2 * options.min_run, options.min_run
    equal: set[tuple[int, int]] = set()
    scores = []
    for low, high in _spans(sorted({d for d, _ in met}), len(doc), options.tile_words, margin):
        here = sorted({i for d, i in met if low <= d < high})
        for first, last in _spans(here, len(seq.words), options.tile_words, margin):
            own, text = seq.own[first:last], list(doc[low:high])
            while True:
                score, path = align(seq.words[first:last], own, text)
                if not path or score < floor:
                    break
                if best_run(path, options):
                    scores.append(score)
                    equal.update((low + d, first + i) for d, i in path)
                    break
                for d, _ in path:
                    text[d] = ""
    if not equal:
        return None
    path = sorted(equal) if len(scores) == 1 else widest(equal)
    if (run := best_run(path, options)) is None:
        return None
    score = scores[0] if len(scores) == 1 else 3 * len(path) - sum(max(b[0] - a[0], b[1] - a[1]) for a, b in zip(path, path[1:])) - 1
    return run[0], run[1], score, run[2]


def leaks_of(doc: list[str], block: Block) -> list[tuple[int, str, int, int, int, int]]:
    """(item_id, part, words in a row, equal words, score, first word) of every passage of a document."""
    options, sequences = block.options, block.sequences
    out = _crossing(doc, block)
    hits = [(d, at) for d, at in enumerate(map(block.seeds.get, zip(doc, doc[1:]))) if at is not None]
    if len(hits) < options.min_seeds:
        return out
    by_sequence: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for d, at in hits:
        for s, i in at:
            by_sequence[s].append((d, i))
    for s, met in by_sequence.items():
        seq, group = sequences[s], []
        for k, (d, i) in enumerate(met):
            group.append((d, i))
            if k + 1 < len(met) and met[k + 1][0] - d <= 3 * options.min_run:
                continue
            diagonals = Counter((d - i) // 8 for d, i in group)
            if any(diagonals[x] + diagonals[x + 1] >= options.min_seeds for x in list(diagonals)) and (found := aligned(seq, doc, group, options)):
                out.append((seq.item_id, seq.part, *found))
            group = []
    return out


def widest(equal: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the ways through equal places in the steps best_run allows the one over most item words, then of most places."""
    best: dict[tuple[int, int], tuple[int, int, tuple[int, int] | None]] = {}
    for d, i in sorted(equal, key=lambda m: (m[1], m[0])):
        before = [(best[d - x, i - y][0], best[d - x, i - y][1] + 1, (d - x, i - y)) for y in (1, 2) for x in (1, 2, 3) if (d - x, i - y) in best]
        best[d, i] = max(before, key=lambda b: (-b[0], b[1]), default=(i, 1, None))
    at: tuple[int, int] | None = max(best, key=lambda m: (m[1] - best[m][0], best[m][1]))
    path = []
    while at is not None:
        path.append(at)
        at = best[at][2]
    return path[::-1]


def _crossing(doc: list[str], block: Block) -> list[tuple[int, str, int, int, int, int]]:
    """Passages that cross a cut, whatever seeds they hold, if their equal words tell the item."""
    options, out = block.options, []
    done: set[tuple[int, int, int]] = set()
    for step in (1, 2, 3):
        for d, at in enumerate(map(block.cuts.get, zip(doc, doc[step:]))):
            for s, i, length in at or ():
                seq = block.sequences[s]
                if (s, d, i) in done:
                    continue
                met = chain(seq, doc, (d, i), (d + step, i + length), options.min_run)
                if met is None or not tells_item(met, seq, options):
                    continue
                done.update((s, *m) for m in met)
                places, items = zip(*met)
                low, start = min(places), min(items)
                score, path = align(seq.words[start : max(items) + 1], seq.own[start : max(items) + 1], doc[low : max(places) + 1])
                path = [(x + low, y + start) for x, y in path]
                if (run := best_run(path, options)) is None:
                    # Repeated words can be aligned as well with fewer item words.
                    path = widest(met)
                    run = best_run(path, options)
                    score = 3 * len(path) - sum(max(b[0] - a[0], b[1] - a[1]) for a, b in zip(path, path[1:])) - 1
                if run:
                    k = next(k for k, m in enumerate(path) if m[0] == run[2])
                    if tells_item(set(path[k : k + run[1]]), seq, options):
                        out.append((seq.item_id, seq.part, run[0], run[1], score, run[2]))
    return out


def _blocks(items: DataFrame, options: LeakOptions) -> Iterator[list[Sequence]]:
    """Sequences of all items in blocks of bounded size; what several items hold is counted on the executors."""
    sequences = cut_lineage(item_words(items, options))
    places = shared_grams(sequences, options).groupBy("item_id", "part").agg(F.map_from_entries(F.collect_list(F.struct("kind", "places"))).alias("shared"))
    block: list[Sequence] = []
    size = 0
    for row in sequences.join(places, ["item_id", "part"], "left").toLocalIterator():
        if size + len(row.words) > options.block_words and block:
            yield block
            block, size = [], 0
        block.append(Sequence.of(row.item_id, row.part, row.words, {k: set(v) for k, v in (row.shared or {}).items()}, options.shared_words))
        size += len(row.words)
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, options: LeakOptions = LeakOptions()) -> DataFrame:
    """Passages of evaluation items in documents (MATCH_SCHEMA), the longest run per document, item and part.

    Wording that several items hold is counted on the executors; the driver holds one
    block of items at a time, each broadcast. Documents are read once per block, whole,
    and never shuffled but for their few matches. Null or empty texts hold nothing, parts shorter than min_run words
    are never found, repeated documents are each reported.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    found = None
    for block in _blocks(items, options):
        held = spark.sparkContext.broadcast(Block(block, options))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    rows += [(doc_id, *leak) for leak in leaks_of(words(text), held.value)]
                columns = list(zip(*rows)) if rows else [()] * len(_RESULT)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _RESULT)], schema=_RESULT)

        part = docs.mapInArrow(run, MATCH_SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], MATCH_SCHEMA)
    order = F.struct("run_words", "matched_words", "score", (-F.col("first_word")).alias("o"))
    best = found.groupBy("doc_id", "item_id", "part").agg(F.max_by(F.struct("run_words", "matched_words", "score", "first_word"), order).alias("b"))
    return best.select("doc_id", "item_id", "part", "b.*")
