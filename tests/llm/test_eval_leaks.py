import base64
import random

from diffloom.llm.eval_leaks import LeakOptions, _blocks, align, aligned, best_run, find_leaks
from diffloom.llm.normalise import words

DOCS = "doc_id long, text string, item_id int"
ITEMS = "item_id long, suite string, item_text string, answer_text string, text string"
ITEM = "Between hunks 584 and 410 of Datada, someone let Kelilol build twice per payload, whereupon Hefafan reported primary messages in 3 unrelated diffs. Nothing in Cafi may merge a lazy tree."
ANSWER = "Only Daviwan: its legacy order outlives Sila by 86 clocks, whereas Jozatix will split every pending buffer."
SHARED = "Read the change summary below and answer in one or two sentences, using only facts that the summary states and nothing from memory."
TOK = ITEM.split()


def marked(parts, n):
    """item_id, words and own of texts, by looking at every window of every text."""
    windows = [{tuple(seq[i : i + n]) for i in range(len(seq) - n + 1)} for _, seq in parts]
    out = []
    for k, (item, seq) in enumerate(parts):
        others = set().union(*(w for j, w in enumerate(windows) if parts[j][0] != item))
        own = [not any(tuple(seq[j : j + n]) in others for j in range(max(0, i - n + 1), min(i, len(seq) - n) + 1)) for i in range(len(seq))]
        out.append((item, seq, own))
    return out


def variants():
    drop = [w for i, w in enumerate(TOK) if i % 4 != 2]
    swap = [w if i % 5 else "zzz" for i, w in enumerate(TOK)]
    return {
        1: ITEM, 2: ITEM.upper(), 3: "\r\n".join(TOK), 4: " ".join(f"**{w}**" if i % 2 else f"`{w}`" for i, w in enumerate(TOK)), 5: ITEM.replace("a", "а").replace("e", "е"), 6: ITEM.replace(",", "&#44;<br/>"), 7: "​".join(ITEM.split(" ")).replace("​", " ​"),
        8: " ".join(drop), 9: " ".join(swap), 10: "x y z " + " ".join(TOK[5:19]) + " more text", 11: ITEM.lower().replace(",", "").replace(".", ""), 12: "intro\n\n// " + "\n// ".join(" ".join(TOK[i : i + 5]) for i in range(0, len(TOK), 5)), 13: "pre " + ANSWER,
    }


HARMLESS = {50: " ".join(TOK[:8]) + " and then something else entirely happened here today", 51: SHARED, 52: SHARED + " " + " ".join(TOK[:6]), 53: "", 54: None, 55: "plain words " * 30_000, 56: " ".join(w for i, w in enumerate(TOK) if i % 4 in (0, 3)), 57: " ".join(reversed(TOK))}


def test_variants_and_scraps(spark):
    docs = {**variants(), **HARMLESS}
    items = [(1, "s", SHARED + "\n\n" + ITEM, ANSWER, ""), (2, "s", SHARED + "\n\nWhich queue does Tavo open first given 12 lists?", None, ""), (3, "s", None, None, ""), (None, "s", ITEM, None, "")]
    found = find_leaks(spark.createDataFrame([(k, v, 0) for k, v in docs.items()] * 2, DOCS), spark.createDataFrame(items, ITEMS))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == sorted((k, 1) for k in variants())


def test_blocks_give_the_same(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, "s", " ".join(rng.choice(vocabulary) for _ in range(40)), None, "") for i in range(12)]
    docs = []
    for d in range(40):
        noise = [rng.choice(vocabulary) for _ in range(60)]
        if d % 2:
            seq = items[d % 12][2].split()
            noise[20:20] = seq[5 : 5 + rng.choice([6, 20])]
        docs.append((d, " ".join(noise), 0))
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = [sorted((r.doc_id, r.item_id) for r in find_leaks(a, b, o).collect()) for o in (LeakOptions(), LeakOptions(block_words=100))]
    want = sorted((d, i) for d, t, _ in docs for i, _, s, *_ in items if any(" ".join(s.split()[k : k + 12]) in t for k in range(29)))
    assert got[0] == got[1] and set(want) <= set(got[0])
    assert find_leaks(a.where("false"), b).count() == 0 and find_leaks(a, b.where("false")).count() == 0


def brute(a, b):
    best, h = 0, [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if b[i - 1] == a[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_against_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(1, 25))] for _ in range(2))
        score, path = align(a, [True] * len(a), b)
        assert score == brute(a, b)
        assert all(b[i] == a[j] for i, j in path) and path == sorted(path)


def test_shared_wording_and_words():
    seqs = marked([(1, words(SHARED + " " + ITEM)), (2, words(SHARED))], 6)
    assert not any(seqs[1][2]) and sum(seqs[0][2]) == len(words(ITEM))
    assert words("Été  für 10%20<b>A</b>") == ["ete", "fur", "10", "20", "a"] and words(None) == []


def test_passages_of_word_pairs_that_other_items_hold(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(14)]
    items = [(i, "s", " ".join(rng.choice(vocabulary) for _ in range(40)), None, "") for i in range(30)]
    docs, want = [], set()
    told = marked([(i, words(t)) for i, _, t, *_ in items], 6)
    blocks = [seq for block in _blocks(spark.createDataFrame(items, ITEMS), LeakOptions(block_words=200)) for seq in block]
    assert sorted((s.item_id, s.words, s.own) for s in blocks) == sorted(told)
    for s in blocks:
        for kind, gram in (("one", lambda w, i: w[i : i + 2]), ("skip", lambda w, i: w[i : i + 3 : 2]), ("three", lambda w, i: w[i : i + 3])):
            n = len(gram(s.words, 0))
            for i in range(len(s.words) - 2):
                others = any(gram(o, j) == gram(s.words, i) for k, o, _ in told if k != s.item_id for j in range(len(o) - 1) if len(gram(o, j)) == n)
                assert getattr(s, kind)[i] == (not others)
    for i, seq, own in told:
        for start in range(0, 28, 4):
            if all(own[start : start + 12]):
                for changed in (None, 2, 9):
                    passage = [w if k != changed else "other" for k, w in enumerate(seq[start : start + 12])]
                    want.add((len(docs), i))
                    docs.append((len(docs), " ".join(["before"] * 20 + passage + ["after"] * 20), 0))
    found = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert len(want) > 300 and {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_frames_that_items_fill_differently_are_no_passages(spark):
    frame = "so {} of its {} ended {} overnight while the {} kept {} of them for every {} in the {} and {} more"
    rng = random.Random(5)
    filled = [frame.format(*(f"{rng.choice('bdfg')}{rng.randrange(10**6)}" for _ in range(8))) for _ in range(9)]
    items = spark.createDataFrame([(i, "s", t, None, "") for i, t in enumerate(filled[:8])], ITEMS)
    assert find_leaks(spark.createDataFrame([(1, filled[8], 0)], DOCS), items).count() == 0


def test_last_line_of_wrapped_base64_is_read():
    for text in (ITEM, " ".join(TOK[:12])):
        for width in (60, 64, 76):
            raw = base64.b64encode(text.encode()).decode()
            lines = [raw[i : i + width] for i in range(0, len(raw), width)]
            assert " ".join(words(text)) in " ".join(words("see\n" + "\n".join(lines) + "\nend")) and " ".join(words(text)) in " ".join(words("\r\n".join(lines)))
    raw = base64.b64encode(b"x" * 45 + b" of plain text ").decode()
    assert len(raw) % 4 == 0 and words(raw + "\nhello there")[-2:] == ["hello", "there"] and "plain" in words(raw + "\nhello there")


def test_passages_over_several_tiles_and_second_best_ones(spark):
    seq = [f"w{i}" for i in range(700)]
    items = spark.createDataFrame([(1, "s", " ".join(seq), None, "")], ITEMS)
    doc = ["x"] * 50 + seq[20:660] + ["y"] * 50
    got = [find_leaks(spark.createDataFrame([(1, " ".join(doc), 0)], DOCS), items, LeakOptions(tile_words=t)).collect() for t in (5000, 100)]
    assert [(r.run_words, r.matched_words, r.first_word) for g in got for r in g] == [(640, 640, 50)] * 2
    block = next(_blocks(items, LeakOptions()))[0]
    # Equal words far apart make the better alignment, but no passage.
    scattered = [w for i in range(100, 145) for w in (seq[i], *(["z"] if i % 4 else ["z"] * 4))]
    doc = scattered + ["q"] * 30 + seq[300:312]
    met = [(d, int(w[1:])) for d, w in enumerate(doc) if w in seq[300:311] or w in seq[100:145]]
    found = aligned(block, doc, met, LeakOptions())
    assert found and found[0] >= 12


def test_markup_and_encodings_of_any_length():
    tag = '<img alt="' + "x " * 400 + '">'
    assert words(f"one {tag}two") == ["one", "two"] and words("one <!-- " + "z " * 400 + "-->two") == ["one", "two"]
    spread = "%41" + "a" * 80 + "%42" + "b" * 80 + "%43"
    assert words(spread) == ["a" + "a" * 80 + "b" + "b" * 80 + "c"]
    raw = base64.b64encode(" ".join(TOK[:12]).encode()).decode()
    for width in (24, 40, 48):
        lines = "\n".join(raw[i : i + width] for i in range(0, len(raw), width))
        assert " ".join(words(" ".join(TOK[:12]))) in " ".join(words("see\n" + lines + "\nend"))
    assert words("if a <b and c> d") == ["if", "a", "d"] and len(words("<a " * 20_000 + "= " * 20_000)) == 20_000
