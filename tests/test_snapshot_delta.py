import json
import random
from datetime import datetime

import pytest

from diffloom.operators.snapshot_delta import DeltaOptions, canonical_json, pair_hash, peel, snapshot_changes

RUNS = "facts_path string, since_path string, extra int, loaded_at timestamp"
FINDINGS = "row_id long, facts_path string, finding_id string, finding_type string, category string, confidence string, tags array<string>, evidence array<struct<file string, excerpt string, line int>>, payload string, loaded_at timestamp, vh long, key string"
T0 = datetime(2024, 1, 1)


def finding(row, path, fid, payload="{}", tags=None, at=T0, evidence=None):
    return (row, path, fid, "t", "c", None, tags, evidence, payload, at, 7, "clash")


def test_canonical_json_ignores_spelling_only():
    a = canonical_json('{"b": 1.0, "a": [1, 2], "n": null, "generatedAt": "x", "s": "\\u00e9"}')
    assert a == canonical_json('{"a":[1,2.0],\n"s":"é","b":1}')
    assert a != canonical_json('{"a":[2,1],"s":"é","b":1}')
    assert canonical_json('{"x": {"generatedAt": 1}}') != canonical_json('{"x": {}}')
    assert canonical_json("no json") == "raw:no json" and canonical_json(None) == ""


def brute(runs, rows):
    paths = {r[0] for r in runs if r[0]}
    best = {}
    for r in rows:
        if r[2] and r[1]:
            k, o = (r[1], r[2]), (r[9] or datetime.min, r[0])
            if k not in best or o > best[k][0]:
                best[k] = (o, json.dumps([r[3:8], canonical_json(r[8])], default=str))
    out = set()
    for new, since, *_ in runs:
        old = since and since.replace("\\", "/").removeprefix("./")
        if new and old in paths and old != new:
            ids = {i for p, i in best if p in (new, old)}
            for i in ids:
                a, b = best.get((new, i)), best.get((old, i))
                kind = "added" if not b else "removed" if not a else "changed" if a[1] != b[1] else None
                if kind:
                    out.add((new, i, kind))
    return out


@pytest.mark.parametrize("options", [DeltaOptions(), DeltaOptions(bucket_rows=16, widths=(2, 4, 64)), DeltaOptions(bucket_rows=512, widths=(1,))])
def test_against_brute_force(spark, options):
    rng = random.Random(3)
    rows, n = [], 0
    for snap in range(4):
        for i in range(300):
            if rng.random() < 0.9:
                for _ in range(1 + (rng.random() < 0.1)):
                    n += 1
                    payload = json.dumps({"v": i if rng.random() < 0.8 else snap, "generatedAt": snap}, indent=rng.choice([None, 1]))
                    rows.append(finding(n, f"f/{snap}", f"id{i}" if rng.random() < 0.98 else rng.choice([None, ""]), payload, at=rng.choice([T0, datetime(2024, 2, 2), None]), evidence=[("a", "b", None)]))
    rows += rows[:50]
    runs = [("f/0", None, 1, T0), ("f/1", "./f/0", 1, T0), ("f/1", "./f/0", 1, datetime(2025, 1, 1)), ("f/2", "f/1", 1, T0), ("f/3", "f//x/../2", 1, T0), ("f/4", "f/3", 1, T0), ("f/5", "missing", 1, T0), (None, "f/1", 1, T0)]
    got = snapshot_changes(spark.createDataFrame(runs, RUNS), spark.createDataFrame(rows, FINDINGS), options).collect()
    want = brute([(a, b.replace("f//x/../2", "f/2") if b else b) for a, b, *_ in runs], rows)
    assert {(r.facts_path, r.finding_id, r.change_kind) for r in got} == want
    assert len(got) == len(want)


def test_empty_tables(spark):
    assert snapshot_changes(spark.createDataFrame([], RUNS), spark.createDataFrame([], FINDINGS)).collect() == []
    runs = spark.createDataFrame([("a", None, 1, T0), ("b", "a", 1, T0)], RUNS)
    assert snapshot_changes(runs, spark.createDataFrame([], FINDINGS)).collect() == []
    one = snapshot_changes(runs, spark.createDataFrame([finding(1, "b", "x")], FINDINGS)).collect()
    assert [(r.facts_path, r.finding_id, r.change_kind) for r in one] == [("b", "x", "added")]


def test_hash_is_spark_hash_and_peel_reports_failure(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit(11).cast("long"), F.lit(-5).cast("long"), F.lit(77).cast("long")).alias("h")).first().h
    assert got & ((1 << 64) - 1) == pair_hash(11, -5, 77)
    assert peel([(0, 2, 1, 1, 1)], 11, 4) == (False, [])
    assert peel([], 11, 4) == (True, [])
