import random

from hypothesis import given, settings
from hypothesis import strategies as st

from diffloom.llm.split_oversized import BLOCK_LIMITS, cut_block, piece_checks, plan_cuts, segment_lengths, split_oversized

LINES = "changeset_id string, path string, hunk_ord int, line_ord int, kind string, old_no int, new_no int, text string, max_chars string"
OPTIONS = "changeset_id string, max_chars int, overlap_lines int, unified int"
SIGN = {"add": "+", "del": "-"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(2, 40), min_size=1, max_size=60), st.integers(40, 120), st.integers(0, 4), st.randoms())
def test_plan_keeps_limit_and_order(sizes, limit, overlap, rng):
    strengths = [rng.randint(0, 3) for _ in sizes]
    ends, repeats = plan_cuts(sizes, strengths, list(range(len(sizes))), limit, overlap)
    assert ends[-1] == len(sizes) and ends == sorted(set(ends)) and repeats[0] == 0
    for start, end, again in zip([0, *ends], ends, repeats):
        assert 0 <= again <= min(overlap, start) and sum(sizes[start - again : end]) <= limit
        assert again == min(overlap, start) or sum(sizes[start - again - 1 : start + 1]) > limit
    assert len(ends) == fewest(sizes, limit, overlap)


def fewest(sizes, limit, overlap):
    """The least number of pieces, by trying every end."""
    n = len(sizes)
    best = [0] + [n + 1] * n
    for start in range(n):
        again = max(0, start - overlap)
        while again < start and sum(sizes[again : start + 1]) > limit:
            again += 1
        for end in range(start + 1, n + 1):
            if sum(sizes[again:end]) > limit:
                break
            best[end] = min(best[end], best[start] + 1)
    return best[n]


def test_overlap_counts_lines_not_parts():
    lines = [(0, 0, "add", "a" * 8, False), (0, 1, "add", "b" * 46, False), (0, 2, "add", "c" * 8, False), (0, 3, "add", "d" * 8, False)]
    pieces = cut_block(lines, 40, 1)
    assert all(p[7] <= 40 for p in pieces) and "".join(p[9][p[6] :].replace("\n", "").replace("+", "") for p in pieces) == "".join(x[3] for x in lines)
    assert all(p[5] <= 1 for p in pieces)


@given(st.text(min_size=1, max_size=300), st.integers(1, 50))
def test_segments_cover_the_line(text, room):
    lengths = segment_lengths(text, room)
    assert sum(lengths) == len(text) and all(0 < n <= room for n in lengths)


def test_cuts_at_hunks_then_blocks():
    lines = [(h, i, "ctx", f"line {h} {i}", False) for h in range(4) for i in range(10)]
    pieces = cut_block(lines, 120, 0)
    assert [p[8] for p in pieces] == ["hunk"] * 4
    block = [(0, i, "add", "" if i % 5 == 4 else f"    value {i}", False) for i in range(20)]
    assert all(p[8] in ("block", "hunk") for p in cut_block(block, 120, 1))


def rebuilt(rows):
    own = ""
    for r in sorted(rows, key=lambda r: r.piece_ord):
        own += r.text[r.repeated_chars :]
        assert len(r.text) == r.size <= max(r.max_chars, 3)
    return own


def test_pieces_of_tables_with_nulls_and_repeats(spark):
    rng = random.Random(1)
    rows = []
    for path, n in (("big", 300), ("small", 3)):
        for i in range(n):
            rows.append(("c", path, i // 7, i % 7, rng.choice(["add", "del", "ctx"]), None, None, rng.choice([None, "", "é" * 5, "x = 1", "}"]), "clash"))
    rows += rows[:100] + [("c", None, 0, 0, "add", None, None, "x", ""), ("n", "big", 0, 0, "add", None, None, "y" * 99, ""), ("u", "big", 0, 0, "add", None, None, "y" * 99, "")]
    options = spark.createDataFrame([("c", 100, 2, 3), ("n", None, 0, 3)], OPTIONS)
    pieces = split_oversized(spark.createDataFrame(rows, LINES), options).collect()
    assert {(p.changeset_id, p.path) for p in pieces} == {("c", "big")}
    want = "".join(f"{SIGN.get(k, ' ')}{t or ''}\n" for _, k, t in sorted({((r[2], r[3]), r[4], r[7]) for r in rows if r[:2] == ("c", "big")}))
    assert rebuilt(pieces) == want
    checks = piece_checks(spark.createDataFrame(pieces)).collect()
    assert [(r.chars, r.faults, r.first_hunk, r.first_line, r.last_hunk, r.last_line) for r in checks] == [(len(want) - 2 * want.count("\n"), 0, 0, 0, 299 // 7, 299 % 7)]
    assert split_oversized(spark.createDataFrame([], LINES), options).count() == 0


def test_giant_item_is_cut_in_blocks_with_overlap(spark):
    n = 4000
    rows = [("c", "p", i // 20, i % 20, "add", None, None, f"line number {i}", "") for i in range(n)]
    pieces = sorted(split_oversized(spark.createDataFrame(rows, LINES), spark.createDataFrame([("c", 60, 1, 3)], OPTIONS)).collect(), key=lambda p: p.piece_ord)
    assert len({p.block for p in pieces}) > n * 15 // (60 * BLOCK_LIMITS) // 2
    assert rebuilt(pieces) == "".join(f"+line number {i}\n" for i in range(n))
    for a, b in zip(pieces, pieces[1:]):
        assert b.repeated_lines == 1 and a.text.split("\n")[-2] == b.text.split("\n")[0]


def test_one_very_long_line(spark):
    rows = [("c", "p", 0, 0, "add", None, None, "word " * 2000, "")]
    pieces = split_oversized(spark.createDataFrame(rows, LINES), spark.createDataFrame([("c", 500, 3, 3)], OPTIONS)).collect()
    assert all(p.size <= 500 for p in pieces) and 20 <= len(pieces) <= 22


def test_overlap_after_chunks_larger_than_a_block(spark):
    n = 1600
    rows = [("c", "p", 0, i, "add", None, None, f"line number {i} " + "x" * 30, "") for i in range(n)]
    pieces = sorted(split_oversized(spark.createDataFrame(rows, LINES), spark.createDataFrame([("c", 120, 1, 3)], OPTIONS)).collect(), key=lambda p: p.piece_ord)
    assert len({p.block for p in pieces}) == 4 and 512 * 45 > 120 * BLOCK_LIMITS
    for a, b in zip(pieces, pieces[1:]):
        assert b.repeated_lines == 1 and a.text.split("\n")[-2] == b.text.split("\n")[0]
