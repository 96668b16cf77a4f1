import json
from datetime import datetime

from diffloom.operators.nested_tables import flat_children, label, node_table, read_json, typed_tables

SCHEMA = "delivery_id long, log_id string, delivered_at timestamp, log_json string, pre int, name string"


def rows(*texts, log="a"):
    return [(i, log, datetime(2024, 1, 1 + i), t, 0, "clash") for i, t in enumerate(texts)]


def found(spark, data):
    return sorted((r.log_id, r.run_ord, r.result_ord, r.child_kind, r.child_key) for r in flat_children(spark.createDataFrame(data, SCHEMA)).collect())


LOG = {"runs": [None, {"results": [{"locations": [{}, None, {"x": {"locations": [1]}}], "partialFingerprints": {"a": "1", "b": None}}, None, {"locations": {"p": 1}}, "text", {"locations": None}]}]}
WANT = [("a", 1, 0, "fingerprint", "a"), ("a", 1, 0, "location", "0"), ("a", 1, 0, "location", "2"), ("a", 1, 0, "result", "-"), ("a", 1, 2, "location", "0"), ("a", 1, 2, "result", "-"), ("a", 1, 3, "result", "-"), ("a", 1, 4, "result", "-")]


def test_shapes_and_wrappings(spark):
    for text in (json.dumps(LOG), "\ufeff \n" + json.dumps(LOG, indent=1), json.dumps(json.dumps(LOG)), json.dumps(LOG["runs"])):
        assert found(spark, rows(text)) == WANT
    one = found(spark, rows(json.dumps(LOG["runs"][1])))
    assert one == [(a, 0, *rest) for a, _, *rest in WANT]


def test_latest_readable_delivery_holds(spark):
    empty = json.dumps({"runs": []})
    assert found(spark, rows(json.dumps(LOG), "<html>", "{\"runs\": [", None, "", "\"no json\"", "17")) == WANT
    assert found(spark, rows(json.dumps(LOG), empty)) == []
    assert found(spark, [(1, None, None, json.dumps(LOG), 0, ""), (2, "b", None, empty, 0, ""), (3, "b", None, json.dumps(LOG), 0, "")]) == [("b", *w[1:]) for w in WANT]
    assert found(spark, []) == []


def test_intervals_nest():
    nodes = label("a", LOG)
    assert [n[1] for n in nodes] == list(range(len(nodes))) and sorted(n[2] for n in nodes) == list(range(len(nodes)))
    for a in nodes:
        for b in nodes:
            inside = a[1] < b[1] and b[2] < a[2]
            apart = a[1] > b[1] or a[2] < b[2] or a is b
            assert inside or apart
    assert sum(n[4] == "location" for n in nodes) == 4 and nodes[0][4] == "log"


def test_deep_and_long_texts(spark):
    deep = "[" * 100_000 + "]" * 100_000
    assert read_json(deep) is None
    many = json.dumps({"results": [{"locations": [{}] * 3}] * 5000})
    assert flat_children(spark.createDataFrame(rows(deep, many), SCHEMA)).count() == 20_000
    assert node_table(spark.createDataFrame(rows(many), SCHEMA), ("run",)).count() == 1


def test_tables_by_type_join_by_intervals(spark):
    log = {"runs": [{"results": [{"ruleId": "R1", "level": "note", "locations": [{"x": 1}], "partialFingerprints": {"a": "f\"1"}}, {"ruleId": "R2"}]}]}
    tables = typed_tables(spark.createDataFrame(rows(json.dumps(log)) * 2, SCHEMA))
    run, results = tables["run"].collect(), {r.rule_id: r for r in tables["result"].collect()}
    assert len(run) == 1 and {r.run_pre for r in results.values()} == {run[0].pre} and results["R1"].level == "note"
    place, prints = tables["location"].collect(), tables["fingerprint"].collect()
    assert [(r.result_pre, r.fields) for r in place] == [(results["R1"].pre, {"x": "1"})]
    assert [(r.result_pre, r.name, r.value) for r in prints] == [(results["R1"].pre, "a", 'f"1')]
    assert found(spark, rows(json.dumps(log)) * 2) == [("a", 0, 0, "fingerprint", "a"), ("a", 0, 0, "location", "0"), ("a", 0, 0, "result", "-"), ("a", 0, 1, "result", "-")]
