"""Reading level of each document (problem 8).

Interpolated word trigram models are trained on labelled documents, one for each level
of the scale and one for evaluation wording. Every segment of a document's prose gets
its surprisal per word under each model; over the whole document these make, for each
model, a distribution of surprisal weighted by words. Its quantiles are averaged, which
gives the document's surprisal under each level, and the score is the level expected
from these five. An isotonic regression fitted on held-out labels maps the score
monotonically to the scale. Segments of words the models do not know (code, logs, other
languages) or of evaluation wording are no prose and are not graded.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.llm.normalise import TAG
from diffloom.runtime import cut_lineage

LEVELS = 5
EVALUATION = LEVELS  # the column of the model of evaluation wording
_SLOT_BITS = 18
_SLOTS = 1 << _SLOT_BITS


@dataclass(frozen=True)
class LevelOptions:
    """max_labelled: labelled documents used at most, chosen by hash; folds: parts of them, each scored by
    models of the others to fit the regression; min_words: words of prose that a graded document has;
    min_known: share of known words in a segment of prose; weights: of the trigram, bigram, unigram and
    uniform parts; quantiles: of the surprisal distribution of a document; sharpness: how much more a level
    counts for one nat of surprisal per word less; hard_from: least level that counts as demanding."""

    max_labelled: int = 6_000
    folds: int = 4
    min_words: int = 40
    min_known: float = 0.6
    weights: tuple[float, float, float, float] = (0.45, 0.3, 0.2, 0.05)
    quantiles: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)
    sharpness: float = 5.0
    hard_from: float = 3.5


# --- prose ----------------------------------------------------------------------

_FENCED = re.compile(r"(?:```|~~~).*?(?:```|~~~|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_LINK = re.compile(r"[a-z][a-z0-9+.-]*://\S+|\]\([^)\s]*\)")
_TABLE = re.compile(r"(?m)^[ \t]*(?:\|.*|#{1,6} .*)$")
_SEGMENT = re.compile(r"[.!?;:]+(?=[\s\"')*_]|$)|\r?\n[ \t]*\r?\n|\r?\n[ \t]*(?=[-*+>#]|\d+[.)])")
_WORD = re.compile(r"(?<![\w./\\@$#=-])[A-Za-z]+(?:['-][A-Za-z]+)*(?![\w/\\@$=(]|\.\w)")
#: Longer segments are parted into pieces of this many words.
SEGMENT_WORDS = 32


def prose_segments(text: str) -> list[list[str]]:
    """Lower-case words of the segments of a text, without code, links, tables, headings and tags."""
    if "&" in text:
        text = html.unescape(text)
    if "```" in text or "~~~" in text:
        text = _FENCED.sub("\n\n", text)
    if "`" in text:
        text = _INLINE.sub(" ", text)
    if "://" in text or "](" in text:
        text = _LINK.sub(" ", text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "|" in text or "#" in text:
        text = _TABLE.sub("\n", text)
    if not text.isascii():
        text = text.replace("\u200b", "").replace("\xad", "")
    out = []
    for part in _SEGMENT.split(text):
        words = _WORD.findall(part)
        if not words:
            continue
        words = " ".join(words).lower().split()
        if len(words) <= SEGMENT_WORDS + 8:
            out.append(words)
        else:
            out += [words[i : i + SEGMENT_WORDS] for i in range(0, len(words), SEGMENT_WORDS)]
    return out


class _Codes(dict):
    """Word -> code, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = zlib.crc32(word.encode("utf-8", "replace"))
        return code


_CODES = _Codes()


def slots(segments: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table slots of the unigram, bigram and trigram that end at each word, and where segments start.

    The first words of a segment have a fixed word before them.
    """
    lengths = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
    n = int(lengths.sum())
    code = np.fromiter((c for s in segments for c in map(_CODES.__getitem__, s)), dtype=np.uint64, count=n)
    starts = np.cumsum(lengths) - lengths
    before = np.concatenate([[np.uint64(1)], code[:-1]]) if n else code
    before[starts] = 1
    before2 = np.concatenate([[np.uint64(1)], before[:-1]]) if n else code
    before2[starts] = 1
    k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - _SLOT_BITS)
    one = code * k1
    two = (before * k2) ^ one
    three = (before2 * k3) ^ (two * k1)
    fold = lambda x: ((x * k1) >> shift).astype(np.int64)
    return fold(one), fold(two), fold(three), starts


def count_tables(segments: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(order * slots + slot, count) of the n-grams of some segments."""
    one, two, three, _ = slots(segments)
    return np.unique(np.concatenate([one, two + _SLOTS, three + 2 * _SLOTS]), return_counts=True)


@dataclass
class Models:
    """Counts of n-grams by model: tables[order][slot, model]."""

    tables: np.ndarray
    weights: tuple[float, float, float, float]

    @classmethod
    def of(cls, counts: np.ndarray, weights: tuple[float, float, float, float]) -> Models:
        return cls(counts.reshape(3, _SLOTS, LEVELS + 1).astype(np.float32), weights)

    def surprisal(self, segments: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Total surprisal of each segment under each model, its known words and its words."""
        one, two, three, starts = slots(segments)
        c1, c2, c3 = (self.tables[i][s] for i, s in enumerate((one, two, three)))
        totals = self.tables[0].sum(axis=0) + 1
        first = np.zeros(len(one), dtype=bool)
        first[starts] = True
        ctx1 = np.vstack([np.zeros((1, LEVELS + 1), np.float32), c1[:-1]]) if len(one) else c1
        ctx2 = np.vstack([np.zeros((1, LEVELS + 1), np.float32), c2[:-1]]) if len(one) else c2
        ctx1[first] = 0
        ctx2[first] = 0
        w3, w2, w1, w0 = self.weights
        p = w3 * np.minimum(1, c3 / np.maximum(ctx2, 1)) + w2 * np.minimum(1, c2 / np.maximum(ctx1, 1)) + w1 * c1 / totals + w0 * np.float32(1e-4)
        known = (c1[:, :LEVELS].sum(axis=1) >= 2).astype(np.int64)
        lengths = np.diff(np.concatenate([starts, [len(one)]]))
        if not len(starts):
            return np.zeros((0, LEVELS + 1)), np.zeros(0), np.zeros(0)
        return np.add.reduceat(-np.log(p), starts, axis=0), np.add.reduceat(known, starts), lengths


def surprisal_quantiles(per_word: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, quantiles: tuple[float, ...]) -> np.ndarray:
    """quantile x document x model of the surprisal per word of the segments of each document, weighted by words.

    owner: the document of each segment, ascending; documents without segments get nan.
    """
    out = np.full((len(quantiles), n, per_word.shape[1]), np.nan)
    mass = np.bincount(owner, weights=weight, minlength=n)
    has = mass > 0
    before = np.cumsum(mass) - mass
    for model in range(per_word.shape[1]):
        order = np.lexsort((per_word[:, model], owner))
        reached = np.cumsum(weight[order])
        value = per_word[order, model]
        for k, q in enumerate(quantiles):
            # Half a word less, so that sums of words that are a little off stay in their document.
            at = np.searchsorted(reached, before[has] + np.maximum(q * mass[has] - 0.5, 0.25))
            out[k, has, model] = value[at]
    return out


def document_scores(models: Models, documents: list[list[list[str]]], options: LevelOptions) -> tuple[np.ndarray, np.ndarray]:
    """The level expected from the surprisal distributions of each document (nan without prose), and its words of prose."""
    flat = [s for d in documents for s in d]
    owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    total, known, lengths = models.surprisal(flat)
    score, words = np.full(len(documents), np.nan), np.zeros(len(documents), dtype=np.int64)
    if not len(flat):
        return score, words
    prose = (known >= options.min_known * lengths) & (total.argmin(axis=1) != EVALUATION)
    if not prose.any():
        return score, words
    owner, weight = owner[prose], lengths[prose].astype(np.int64)
    words = np.bincount(owner, weights=weight, minlength=len(documents)).astype(np.int64)
    per_word = total[prose][:, :LEVELS] / weight[:, None]
    level = surprisal_quantiles(per_word, weight, owner, len(documents), options.quantiles).mean(axis=0)
    has = words > 0
    share = np.exp(-options.sharpness * (level[has] - level[has].min(axis=1, keepdims=True)))
    score[has] = (share * np.arange(1, LEVELS + 1)).sum(axis=1) / share.sum(axis=1)
    return score, words


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function that fits y best (pool adjacent violators)."""
    at, place = np.unique(x, return_inverse=True)
    mass = np.bincount(place, weights=w)
    mean = np.bincount(place, weights=w * y) / mass
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(at, mean, mass):
        blocks.append([xi, yi, wi, xi])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([b[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2], a[3]])
    knots = [(b[3], b[1]) for b in blocks] + [(b[0], b[1]) for b in blocks]
    knots.sort()
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


# --- training and scoring on Spark ------------------------------------------------

_COUNT_SCHEMA = "fold int, model int, slot bigint, n bigint"
LEVEL_SCHEMA = "doc_id bigint, prose_words int, score double, reading_level double"


def _fold(options: LevelOptions) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(options.folds)).cast("int")


def _labelled(documents: DataFrame, labels: DataFrame, options: LevelOptions) -> DataFrame:
    """doc_id, text, level (mean over raters), raters, fold of a bounded sample of labelled documents."""
    rated = (
        labels.where("doc_id is not null and reading_level between 1 and 5")
        .distinct()
        .groupBy("doc_id")
        .agg(F.avg("reading_level").alias("level"), F.count("*").alias("raters"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(options.max_labelled)
    )
    # At most max_labelled rows of three numbers are broadcast.
    return documents.where("text is not null").select("doc_id", "text").join(F.broadcast(rated), "doc_id").withColumn("fold", _fold(options))


def _dense(keys: np.ndarray, models: np.ndarray, n: np.ndarray) -> np.ndarray:
    table = np.zeros((3 * _SLOTS, LEVELS + 1), dtype=np.float32)
    np.add.at(table, (keys, models), n)
    return table


@dataclass
class LevelModel:
    """Sparse counts by fold (those of evaluation wording in every fold's total)."""

    folds: np.ndarray
    models: np.ndarray
    slots: np.ndarray
    counts: np.ndarray
    options: LevelOptions

    def without(self, fold: int) -> Models:
        """Models trained on all folds but one."""
        keep = self.folds != fold
        return Models.of(_dense(self.slots[keep], self.models[keep], self.counts[keep]), self.options.weights)


def fit(documents: DataFrame, labels: DataFrame, items: DataFrame | None, options: LevelOptions = LevelOptions()) -> tuple[Broadcast, tuple[np.ndarray, np.ndarray]] | None:
    """The broadcast LevelModel trained on the labelled documents, and the knots of the regression; None without prose.

    At most max_labelled documents are counted, and however many those are there is one
    number for each fold, level and table slot, so the model has a fixed greatest size.

    items: evaluation items (item_text, answer_text), a held-out set of fixed size.
    """
    sample = cut_lineage(_labelled(documents, labels, options))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[tuple[int, int], list[list[str]]] = {}
            for text, level, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "level", "fold"))):
                parts.setdefault((fold, int(level + 0.5) - 1), []).extend(prose_segments(text))
            for (fold, model), segments in parts.items():
                if segments:
                    key, n = count_tables(segments)
                    arrays = [pa.array(np.full(len(key), fold), pa.int32()), pa.array(np.full(len(key), model), pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["fold", "model", "slot", "n"])

    rows = sample.mapInArrow(count, _COUNT_SCHEMA).groupBy("fold", "model", "slot").agg(F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return None
    columns = [rows.column(c).to_numpy() for c in ("fold", "model", "slot", "n")]
    held = [] if items is None else [s for r in items.select("item_text", "answer_text").toLocalIterator() for t in r if t for s in prose_segments(t)]
    if held:
        key, n = count_tables(held)
        more = (np.full(len(key), -1), np.full(len(key), EVALUATION), key, n)
        columns = [np.concatenate([a, b]) for a, b in zip(columns, more)]
    model = LevelModel(columns[0], columns[1], columns[2].astype(np.int64), columns[3].astype(np.float32), options)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, folds = batch.column("text").to_pylist(), batch.column("fold").to_numpy()
            scores = np.full(len(texts), np.nan)
            for fold in set(folds.tolist()):
                at = np.flatnonzero(folds == fold)
                found, words = document_scores(sent.value.without(fold), [prose_segments(texts[i]) for i in at], options)
                scores[at] = np.where(words > 0, found, np.nan)
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64()), batch.column("level"), batch.column("raters")], names=["score", "level", "raters"])

    held_out = sample.repartition(documents.sparkSession.sparkContext.defaultParallelism, "doc_id").mapInArrow(score, "score double, level double, raters bigint").toArrow()
    x, y, w = (held_out.column(c).to_numpy() for c in ("score", "level", "raters"))
    use = ~np.isnan(x)
    if not use.any():
        return None
    return sent, isotonic(x[use], y[use], w[use].astype(float))


def grade(documents: DataFrame, labels: DataFrame, items: DataFrame | None = None, options: LevelOptions = LevelOptions()) -> DataFrame:
    """Reading level of every document with enough English prose (LEVEL_SCHEMA, one row per document).

    reading_level and score are null where there is less prose than min_words, as in
    code, logs, listings and texts of other languages, and for null or empty texts.
    Whole texts are read. Ratings outside 1 to 5 and null ones are ignored, repeated
    ones count once. Without usable ratings no document is graded. Every document is
    scored by models trained on other folds, so a rating never grades its own document.
    """
    named = documents.select("doc_id", "text").where("doc_id is not null").withColumn("fold", _fold(options))
    fitted = fit(documents, labels, items, options)
    if fitted is None:
        return named.select("doc_id", F.lit(0).alias("prose_words"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("reading_level"))
    sent, knots = fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[int, Models] = {}
        for batch in batches:
            ids, texts, folds = batch.column("doc_id").to_numpy(), batch.column("text").to_pylist(), batch.column("fold").to_numpy()
            for fold in range(options.folds):
                mine = np.flatnonzero(folds == fold)
                for at in range(0, len(mine), 500):
                    if fold not in models:
                        models[fold] = sent.value.without(fold)
                    part = mine[at : at + 500]
                    score, words = document_scores(models[fold], [prose_segments(texts[i]) if texts[i] else [] for i in part], options)
                    graded = (words >= options.min_words) & ~np.isnan(score)
                    level = np.interp(np.where(graded, score, 0.0), *knots)
                    arrays = [pa.array(ids[part], pa.int64()), pa.array(words, pa.int32()), pa.array(score, pa.float64(), mask=~graded), pa.array(level, pa.float64(), mask=~graded)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "prose_words", "score", "reading_level"])

    return named.mapInArrow(run, LEVEL_SCHEMA)


def demanding(levels: DataFrame, options: LevelOptions = LevelOptions()) -> DataFrame:
    """doc_id of the documents graded at the two upper levels of the scale."""
    return levels.where(F.col("reading_level") >= options.hard_from).select("doc_id").distinct()


def profile(levels: DataFrame, documents: DataFrame) -> DataFrame:
    """source, reading_level (rounded, null where not graded), documents, prose_words."""
    return (
        levels.join(documents.where("doc_id is not null").select("doc_id", "source"), "doc_id")
        .groupBy("source", F.round("reading_level").cast("int").alias("reading_level"))
        .agg(F.count("*").alias("documents"), F.sum("prose_words").alias("prose_words"))
    )
