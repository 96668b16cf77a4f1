import random

from hypothesis import given, settings
from hypothesis import strategies as st

from diffloom.llm.pack_containers import assign_containers, container_fill, pack, token_lengths, tokenizer, TOKENIZER

DOCS = "doc_id long, text string, tokens int, rank string"
KINDS = "container_kind string, capacity_tokens int, tokens string"


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25), st.integers(60, 80))
def test_pack_places_every_item_within_capacity(counts, capacity):
    bins = pack(counts, capacity)
    placed: dict[int, int] = {}
    for b in bins:
        assert b.number > 0 and sum(s * k for s, k in b.contents) <= capacity
        assert sum(k for s, k in b.contents if 3 * s > capacity) <= 2
        for s, k in b.contents:
            placed[s] = placed.get(s, 0) + k * b.number
    assert placed == counts
    total = sum(s * n for s, n in counts.items())
    assert sum(b.number for b in bins) <= 2 * total / capacity + 1  # no two containers could be poured together


def test_full_containers_with_mixed_sizes():
    rng = random.Random(2)
    counts: dict[int, int] = {}
    for _ in range(5000):
        s = rng.choice([rng.randint(1, 20), rng.randint(1, 100), rng.randint(30, 60)])
        counts[s] = counts.get(s, 0) + 1
    assert sum(b.number for b in pack(counts, 100)) <= sum(s * n for s, n in counts.items()) / 100 * 1.03 + 1


def test_assignment_keeps_documents_whole(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([1, 3, 8, 8, 8, 20, 70]))) for _ in range(300)]
    rows = [(i, t, 0, "clash") for i, t in enumerate(texts)] + [(900, None, 0, ""), (901, "", 0, ""), (None, "x", 0, "")]
    docs = spark.createDataFrame(rows, DOCS)
    kinds = spark.createDataFrame([("a", 16, ""), ("b", 64, ""), ("b", 64, ""), (None, 5, ""), ("zero", 0, "")], KINDS)
    got = assign_containers(docs, kinds).collect()
    encode = tokenizer(TOKENIZER).encode_ordinary
    for kind, capacity in (("a", 16), ("b", 64)):
        mine = [r for r in got if r.container_kind == kind]
        used: dict[int, int] = {}
        for r in mine:
            used[r.container_id] = used.get(r.container_id, 0) + r.tokens
        assert sorted(used) == list(range(len(used))) and max(used.values()) <= capacity
        for i, t in enumerate(texts):
            n = len(encode(t))
            parts = sorted((r.piece_ord, r.start_token, r.tokens) for r in mine if r.doc_id == i)
            assert sum(p[2] for p in parts) == n and len(parts) == max(1, -(-n // capacity))
            assert [p[1] for p in parts] == [capacity * k for k in range(len(parts))]
    assert {r.container_kind for r in got} == {"a", "b"} and {r.doc_id for r in got} == set(range(300))
    fill = container_fill(assign_containers(docs, kinds), kinds).collect()
    assert all(r.free_tokens >= 0 and r.documents > 0 for r in fill)
    assert assign_containers(docs.where("false"), kinds).count() == 0 and assign_containers(docs, kinds.where("false")).count() == 0


def test_salted_ranks_are_dense(spark):
    from diffloom.llm.pack_containers import ranked_lengths

    lengths = spark.range(2000).selectExpr("id as doc_id", "if(id % 10 = 0, 3L, 7L) as tokens")
    rows = ranked_lengths(lengths, 1800, rank_rows=100).collect()
    for n in (3, 7):
        ranks = sorted(r["rank"] for r in rows if r.tokens == n)
        assert ranks == list(range(len(ranks)))


def test_special_token_text_is_ordinary(spark):
    one = token_lengths(spark.createDataFrame([(1, "<|endoftext|>", 0, "")], DOCS)).first()
    assert one.tokens == len(tokenizer(TOKENIZER).encode_ordinary("<|endoftext|>")) > 1
