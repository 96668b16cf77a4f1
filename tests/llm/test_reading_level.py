import random

import numpy as np

from diffloom.llm.reading_level import LevelOptions, demanding, fit, grade, isotonic, profile, prose_segments, surprisal_quantiles

DOCS = "doc_id long, text string, lang string, source string, score int"
LABELS = "doc_id long, reading_level int, rater string"
WORDS = {1: "we fix the old box and you can keep it in the bag today".split(), 3: "the scheduler normalises every manifest before the first request reaches the endpoint".split(), 5: "notwithstanding dialectical presuppositions the epistemological apparatus circumscribes metalinguistic equivocation".split()}


def document(level, rng, n=12):
    return ". ".join(" ".join(rng.choice(WORDS[level]) for _ in range(10)).capitalize() for _ in range(n)) + "."


def test_grades_held_out_documents(spark):
    rng = random.Random(1)
    rows, labels, hard = [], [], set()
    for i in range(180):
        level = (1, 3, 5)[i % 3]
        rows.append((i, document(level, rng), "xx", "essay", 0))
        if i < 120:
            labels += [(i, level, "r1"), (i, min(5, max(1, level + rng.choice([-1, 0, 0, 0, 1]))), "r2")] * 2
        if level == 5:
            hard.add(i)
    extra = {200: None, 201: "", 202: document(5, rng, 2), 203: "```\n" + document(5, rng) + "\n```", 204: "Die kleine Abfrage meldet nun die Fassung vor jeder Datei. " * 20, 205: "2024-01-01 INFO job=7 took=3ms\n" * 200, 206: document(1, rng) + "\n```js\n" + document(5, rng) + "\n```\n"}
    rows += [(k, v, "en", None, 0) for k, v in extra.items()] + [(None, "x", "en", "s", 0)]
    labels += [(0, None, "r3"), (5, 99, "r3"), (777, 5, "r1"), (None, 5, "r1")]
    docs, rated = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    items = spark.createDataFrame([("Between hunks someone let it merge twice", None)], "item_text string, answer_text string")
    levels = grade(docs, rated, items)
    got = {r.doc_id: r for r in levels.collect()}
    assert len(got) == 187
    assert {r.doc_id for r in demanding(levels).collect()} == hard
    for k in (200, 201, 202, 203, 204, 205):
        assert got[k].reading_level is None
    assert got[206].reading_level < 2.5
    assert sum(r.documents for r in profile(levels, docs).collect()) == 187


def test_without_labels_nothing_is_graded(spark):
    docs = spark.createDataFrame([(1, "some text here", "en", "s", 0)], DOCS)
    empty = spark.createDataFrame([], LABELS)
    assert [(r.doc_id, r.reading_level) for r in grade(docs, empty).collect()] == [(1, None)]
    assert grade(docs.where("false"), empty).count() == 0


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x, y, w = rng.integers(0, 8, 12).astype(float), rng.normal(size=12), rng.uniform(0.5, 2, 12)
        kx, ky = isotonic(x, y, w)
        fit = np.interp(np.unique(x), kx, ky)
        assert np.all(np.diff(fit) >= -1e-9)
        means = np.array([np.average(y[x == v], weights=w[x == v]) for v in np.unique(x)])
        mass = np.array([w[x == v].sum() for v in np.unique(x)])
        n = len(means)
        best = np.array([max(min(np.average(means[i : j + 1], weights=mass[i : j + 1]) for j in range(k, n)) for i in range(k + 1)) for k in range(n)])
        assert np.allclose(fit, best)


def test_prose_leaves_out_code_links_and_tables():
    text = "# Title\nPlain words here. See `code` and https://x.example/a?b=c now.\n| a | b |\n```\nx = 1\n```\nLast one"
    assert prose_segments(text) == [["plain", "words", "here"], ["see", "and", "now"], ["last", "one"]]
    assert prose_segments("") == [] and LevelOptions().max_labelled > 0


def test_surprisal_quantiles_against_brute_force():
    rng = np.random.default_rng(8)
    n, quantiles = 6, (0.1, 0.25, 0.5, 0.75, 0.9)
    owner = np.sort(rng.choice([0, 1, 3, 4], 40))
    weight, value = rng.integers(1, 30, 40), rng.normal(size=(40, 5))
    got = surprisal_quantiles(value, weight, owner, n, quantiles)
    for d in range(n):
        for model in range(5):
            words = np.sort(np.repeat(value[owner == d, model], weight[owner == d]))
            for k, q in enumerate(quantiles):
                if len(words):
                    place = max(0, int(np.ceil(q * len(words) - 0.5)) - 1)
                    assert got[k, d, model] == words[place]
                else:
                    assert np.isnan(got[k, d, model])


def test_a_bound_on_labelled_documents_bounds_what_is_sent(spark):
    rng = random.Random(2)
    rows = [(i, document((1, 3, 5)[i % 3], rng), "xx", "essay", 0) for i in range(240)]
    sizes = []
    for n in (120, 240):
        docs = spark.createDataFrame(rows[:n], DOCS)
        labels = spark.createDataFrame([(i, (1, 3, 5)[i % 3], "r") for i in range(n)], LABELS)
        options = LevelOptions(max_labelled=60)
        sent, _ = fit(docs, labels, None, options)
        sizes.append(sent.value.counts.sum())
        got = {r.doc_id: r.reading_level for r in grade(docs, labels, None, options).collect()}
        assert all(abs(got[i] - (1, 3, 5)[i % 3]) < 0.5 for i in range(n))
    # Sixty documents of 120 words: as many n-grams of each order, however many documents are labelled.
    assert sizes == [60 * 120 * 3] * 2
