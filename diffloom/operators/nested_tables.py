"""Deeply nested records as related flat tables (problem 4).

Each record is walked once, depth first, and every node gets a pre-order and a
post-order number. A node lies inside another exactly when its interval does, so the
node tables are linked by comparing two numbers and need no path strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffloom.runtime import semi_join

NODE_SCHEMA = "log_id string, pre int, post int, depth int, node_type string, ord int, name string, is_null boolean, value string, fields map<string,string>"


def read_json(text: str | None):
    """The object or array in a text, however it is wrapped; None if there is none.

    A byte-order mark, blanks around the text, and JSON that was encoded again as a
    JSON string (any number of times) are unwrapped. Too deeply nested or broken text
    counts as unreadable.
    """
    for _ in range(8):
        if not isinstance(text, str):
            return text if isinstance(text, (dict, list)) else None
        try:
            text = json.loads(text.strip().lstrip("\ufeff").strip())
        except (ValueError, RecursionError):
            return None
    return None


@F.pandas_udf(T.BooleanType())
def is_readable(texts: pd.Series) -> pd.Series:
    return pd.Series([read_json(t) is not None for t in texts], dtype="bool")


def latest_readable(logs: DataFrame) -> DataFrame:
    """log_id, log_json of the latest readable delivery of each log (delivered_at, null earliest, then delivery_id).

    Deliveries are chosen by their keys, aggregated on the map side, and only chosen texts
    go on. A log delivered once needs no test, as it has nothing to fall back on. A
    repeated delivery is kept as often as it is delivered.
    """
    keys = logs.where("log_id is not null and log_json is not null").select("log_id", "delivery_id", "delivered_at", "log_json")
    latest = F.max(F.struct("delivered_at", "delivery_id")).getField("delivery_id").alias("delivery_id")
    per_log = keys.groupBy("log_id").agg(F.count_distinct("delivery_id").alias("n"), latest)
    several = semi_join(keys, per_log.where("n > 1"), ["log_id"]).where(is_readable("log_json")).groupBy("log_id").agg(latest)
    chosen = per_log.where("n = 1").select("log_id", "delivery_id").unionByName(several)
    return semi_join(keys, chosen, ["log_id", "delivery_id"]).select("log_id", "log_json")


def _as_runs(value):
    if isinstance(value, list):
        return value
    if "runs" in value:
        runs = value["runs"]
        return runs if isinstance(runs, list) else [] if runs is None else [runs]
    return [value]


#: (type of the parent, key) -> type of the entries below it.
_TYPES = {("log", "runs"): "run", ("run", "results"): "result", ("result", "locations"): "location", ("result", "partialFingerprints"): "fingerprint"}

_TYPED = {*_TYPES.values()}


def label(log_id: str, value) -> list[tuple]:
    """All nodes of one record as rows of NODE_SCHEMA, in pre-order."""
    rows: list[list] = []
    clock = 0
    stack: list[tuple] = [({"runs": _as_runs(value)}, "log", 0, None, 0, False)]
    while stack:
        node, kind, ord_, name, depth, leaving = stack.pop()
        if leaving:
            rows[node][2] = clock
            clock += 1
            continue
        scalar = not isinstance(node, (dict, list))
        own = {k: v if isinstance(v, str) else json.dumps(v) for k, v in node.items() if not isinstance(v, (dict, list)) and v is not None} if isinstance(node, dict) and kind in _TYPED else None
        rows.append([log_id, len(rows), 0, depth, kind, ord_, name, node is None, json.dumps(node) if scalar else None, own])
        stack.append((len(rows) - 1, kind, ord_, name, depth, True))
        below: list[tuple] = []
        if isinstance(node, dict):
            for i, (key, child) in enumerate(node.items()):
                entry = _TYPES.get((kind, key))
                if kind == "fingerprint*":
                    below.append((child, "fingerprint", i, key, depth + 1, False))
                elif entry == "fingerprint":
                    below.append((child, "fingerprint*" if isinstance(child, dict) else "value", i, key, depth + 1, False))
                elif entry and isinstance(child, dict):
                    below.append((child, entry, 0, key, depth + 1, False))
                else:
                    below.append((child, entry + "*" if entry and isinstance(child, list) else "value", i, key, depth + 1, False))
        elif isinstance(node, list):
            kind_below = kind[:-1] if kind.endswith("*") else "value"
            below = [(child, kind_below, i, name, depth + 1, False) for i, child in enumerate(node)]
        stack.extend(reversed(below))
    return [tuple(r) for r in rows]


def node_table(logs: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Labelled nodes of the latest readable delivery of each log (NODE_SCHEMA).

    node_type is log, run, result, location, fingerprint, or value for anything else;
    a type ending in * is the container of such nodes. types keeps only those types.
    Null entries are nodes of their own with is_null set; they keep their place. fields
    holds the scalar members of runs, results, locations and fingerprints.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for log_id, text in zip(batch["log_id"], batch["log_json"]):
                value = read_json(text)
                if value is None:
                    continue
                rows = label(log_id, value)
                out += rows if types is None else [r for r in rows if r[4] in types]
                if len(out) > 20000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    return latest_readable(logs).mapInPandas(run, NODE_SCHEMA)


def linked_results(nodes: DataFrame) -> DataFrame:
    """Each run, result, location and fingerprint with the place of its run and result.

    The enclosing run and result of a node are those whose interval contains its own.
    Nodes of one type never overlap, so the enclosing one is the last that began
    before; whether it contains the node is checked with the post-order number. One
    log is one text of one row, so its nodes are bounded by that row.
    """
    order = Window.partitionBy("log_id").orderBy("pre")
    last = lambda kind: F.last(F.when(F.col("node_type") == kind, F.struct("pre", "post", "ord")), ignorenulls=True).over(order)
    inside = lambda c: (F.col(f"{c}.pre") <= F.col("pre")) & (F.col("post") <= F.col(f"{c}.post"))
    # A delivery that is repeated has every node twice; one exchange by log serves both steps.
    once = nodes.where(F.col("node_type").isin("run", "result", "location", "fingerprint")).repartition("log_id").dropDuplicates(["log_id", "pre"])
    return (
        once
        .withColumn("in_run", last("run"))
        .withColumn("in_result", last("result"))
        .withColumn("run_ord", F.when(inside("in_run"), F.col("in_run.ord")))
        .withColumn("result_ord", F.when(inside("in_result"), F.col("in_result.ord")))
        .withColumn("run_pre", F.when(inside("in_run"), F.col("in_run.pre")))
        .withColumn("result_pre", F.when(inside("in_result"), F.col("in_result.pre")))
        .drop("in_run", "in_result")
    )


def typed_tables(logs: DataFrame) -> dict[str, DataFrame]:
    """One table per type (run, result, location, fingerprint) of log_id, pre, post, ord, fields and what is its own.

    A row's parent is the one of the table above whose interval holds its own: run_pre and
    result_pre name it, so the tables join on (log_id, pre). Results have rule_id, level
    and run_pre, locations result_pre, fingerprints result_pre, name and value.
    """
    nodes = node_table(logs, ("run", "result", "location", "fingerprint"))
    linked = linked_results(nodes.where("not is_null or node_type in ('run', 'result')")).where("not is_null")
    of = lambda kind, *more: linked.where(F.col("node_type") == kind).select("log_id", "pre", "post", "ord", *more, "fields")
    member = lambda name: F.element_at("fields", F.lit(name))
    return {
        "run": of("run"),
        "result": of("result", "run_pre", member("ruleId").alias("rule_id"), member("level").alias("level")).where("run_pre is not null"),
        "location": of("location", "result_pre").where("result_pre is not null"),
        "fingerprint": of("fingerprint", "result_pre", "name", F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v").alias("value")).where("result_pre is not null"),
    }


def flat_children(logs: DataFrame) -> DataFrame:
    """log_id, run_ord, result_ord, child_kind, child_key of every result, location and fingerprint.

    Null entries are left out but keep their place. Empty or unreadable logs give no
    rows, as does a log without runs or results.
    """
    nodes = node_table(logs, ("run", "result", "location", "fingerprint"))
    linked = linked_results(nodes.where("not is_null or node_type in ('run', 'result')"))
    key = F.when(F.col("node_type") == "result", "-").when(F.col("node_type") == "location", F.col("ord").cast("string")).otherwise(F.col("name"))
    return (
        linked.where("node_type <> 'run' and not is_null and run_ord is not null and result_ord is not null")
        .select("log_id", "run_ord", "result_ord", F.col("node_type").alias("child_kind"), key.alias("child_key"))
    )
