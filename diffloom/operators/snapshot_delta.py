"""What changed between full snapshots (problem 2).

Every snapshot is summarised by invertible Bloom lookup tables, one per hash bucket.
Two snapshots are compared by subtracting their tables and peeling the difference,
so only cells that differ travel to the comparison; rows are touched again only to
turn recovered key hashes back into keys. Buckets that cannot be peeled, or whose
digest disagrees with what was peeled, are redone with larger tables and other hash
seeds; what is left after the last table is compared row by row.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffloom.runtime import cut_lineage

DIGEST_CELL = -1
#: Sub-table widths of the successive attempts (three sub-tables each). The last is
#: wide enough for every row of two full buckets to differ.
WIDTHS = (32, 160, 1024)
BUCKET_ROWS = 256
_MASK21 = (1 << 21) - 1
_MASK64 = (1 << 64) - 1


# --- canonical content -------------------------------------------------------


def _canonical(value):
    if isinstance(value, dict):
        return {k: _canonical(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_canonical(v) for v in value]
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def canonical_json(text: str | None, ignore: tuple[str, ...] = ("generatedAt",)) -> str:
    """One spelling per content.

    Key order, blanks, escapes and 1 against 1.0 do not matter, null fields equal
    absent ones, array order counts, top-level keys in ``ignore`` are dropped. Text
    that is no JSON stands for itself; null gives the empty string.
    """
    if text is None:
        return ""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return "raw:" + text
    if isinstance(value, dict):
        for key in ignore:
            value.pop(key, None)
    return json.dumps(_canonical(value), sort_keys=True, separators=(",", ":"))


@F.pandas_udf(T.LongType())
def canonical_json_hash(texts: pd.Series) -> pd.Series:
    """64-bit hash of canonical_json."""
    digest = hashlib.blake2b
    return pd.Series(
        [
            int.from_bytes(digest(canonical_json(t).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            for t in texts
        ],
        dtype="int64",
    )


def relative_path(path: Column) -> Column:
    """A path without blanks around it, './', '//', and 'x/../'; null stays null."""
    parts = F.split(F.regexp_replace(F.trim(path), r"\\", "/"), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p.isin("", "."), acc)
        .when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.when(path.isNotNull(), F.concat(F.when(F.trim(path).startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/")))


# --- sketch --------------------------------------------------------------------


def _hash_long(value: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<Q", value & _MASK64), seed & _MASK64)


def pair_hash(seed: int, key: int, val: int) -> int:
    """The same as Spark's xxhash64(lit(seed), key, val), unsigned."""
    return _hash_long(val, _hash_long(key, _hash_long(seed, 42)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _spark_pair_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), F.col("kh"), F.col("vh"))


def _cells(seed: int, width: int) -> Column:
    """The three cells of a row, and the digest cell of its bucket."""
    c = _spark_pair_hash(seed)
    place = lambda i: (
        F.shiftrightunsigned(c, 21 * i).bitwiseAND(F.lit(_MASK21)) % F.lit(width) + F.lit(i * width)
    ).cast("int")
    sub = [F.struct(place(i).alias("cell"), F.col("kh").alias("kx"), F.col("vh").alias("vx"), c.alias("cx")) for i in range(3)]
    digest = F.struct(
        F.lit(DIGEST_CELL).alias("cell"),
        _spark_pair_hash(seed + 1).alias("kx"),
        _spark_pair_hash(seed + 2).alias("vx"),
        F.lit(0).cast("long").alias("cx"),
    )
    return F.array(*sub, digest)


def _bucket(buckets: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col("kh")), 1) % buckets


def peel(cells: list[tuple[int, int, int, int, int]], seed: int, width: int) -> tuple[bool, list[tuple[int, int, int]]]:
    """Recover (key hash, value hash, sign) from subtracted cells.

    Input: (cell, count, key xor, value xor, check xor). The flag says whether all
    cells came out empty and the bucket's digest agrees with the recovered pairs.
    """
    state = {c: [n, k & _MASK64, v & _MASK64, x & _MASK64] for c, n, k, v, x in cells if c != DIGEST_CELL}
    digest = next(([n, k & _MASK64, v & _MASK64] for c, n, k, v, _ in cells if c == DIGEST_CELL), [0, 0, 0])
    found: list[tuple[int, int, int]] = []
    queue = list(state)
    while queue:
        n, k, v, x = state.get(queue.pop(), (0, 0, 0, 0))
        if n not in (1, -1) or pair_hash(seed, _signed(k), _signed(v)) != x:
            continue
        found.append((_signed(k), _signed(v), n))
        for i in range(3):
            at = ((x >> (21 * i)) & _MASK21) % width + i * width
            cell = state.setdefault(at, [0, 0, 0, 0])
            cell[0] -= n
            cell[1] ^= k
            cell[2] ^= v
            cell[3] ^= x
            queue.append(at)
        if len(found) > 3 * width + 3:
            return False, []
    for k, v, n in found:
        digest[0] -= n
        digest[1] ^= pair_hash(seed + 1, k, v)
        digest[2] ^= pair_hash(seed + 2, k, v)
    done = digest == [0, 0, 0] and all(c == [0, 0, 0, 0] for c in state.values())
    return done, found if done else []


def _peeled(diff: DataFrame, seed: int, width: int) -> DataFrame:
    """(pid, bucket, kh, sign) of each recovered pair; sign 0 marks a failed bucket."""
    grouped = diff.groupBy("pid", "bucket").agg(F.collect_list(F.struct("cell", "n", "kx", "vx", "cx")).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pid, bucket, cells in zip(batch["pid"], batch["bucket"], batch["cells"]):
                ok, found = peel([(c["cell"], c["n"], c["kx"], c["vx"], c["cx"]) for c in cells], seed, width)
                if ok:
                    out += [(pid, bucket, k, sign) for k, _, sign in found]
                else:
                    out.append((pid, bucket, 0, 0))
            yield pd.DataFrame(out, columns=["pid", "bucket", "kh", "sign"])

    return grouped.mapInPandas(run, "pid long, bucket long, kh long, sign int")


def _aggregate_cells(rows: DataFrame, keys: list[str], seed: int, width: int) -> DataFrame:
    return (
        rows.select(*keys, F.explode(_cells(seed, width)).alias("c"))
        .groupBy(*keys, "c.cell")
        .agg(F.count("*").alias("n"), F.bit_xor("c.kx").alias("kx"), F.bit_xor("c.vx").alias("vx"), F.bit_xor("c.cx").alias("cx"))
    )


def _subtract(signed: DataFrame) -> DataFrame:
    return (
        signed.groupBy("pid", "bucket", "cell")
        .agg(F.sum(F.col("n") * F.col("side")).alias("n"), *[F.bit_xor(c).alias(c) for c in ("kx", "vx", "cx")])
        .where("n <> 0 or kx <> 0 or vx <> 0 or cx <> 0")
    )


@dataclass(frozen=True)
class DeltaOptions:
    """bucket_rows: rows per hash bucket aimed at; widths: sub-table widths by attempt."""

    bucket_rows: int = BUCKET_ROWS
    widths: tuple[int, ...] = WIDTHS


def keyed_delta(rows: DataFrame, pairs: DataFrame, options: DeltaOptions = DeltaOptions()) -> DataFrame:
    """Added, removed and changed keys of pairs of snapshots.

    rows: snapshot string, key string, kh long (hash of key), vh long (hash of the
    content), one row per snapshot and key. pairs: newer string, older string, pid
    long. Result: pid, newer, older, key, change_kind. Rows are used several times:
    pass something materialised.
    """
    count = rows.groupBy("snapshot").agg(F.count("*").alias("n_rows"))
    most = F.greatest(F.coalesce("n_new", F.lit(0)), F.coalesce("n_old", F.lit(0)))
    sized = (
        pairs.join(count.select(F.col("snapshot").alias("newer"), F.col("n_rows").alias("n_new")), "newer", "left")
        .join(count.select(F.col("snapshot").alias("older"), F.col("n_rows").alias("n_old")), "older", "left")
        .select("pid", "newer", "older", F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), most / F.lit(float(options.bucket_rows)))))).cast("long").alias("buckets"))
    )
    sized = cut_lineage(sized)
    sides = sized.select("pid", F.col("newer").alias("snapshot"), "buckets", F.lit(1).alias("side")).unionByName(
        sized.select("pid", F.col("older").alias("snapshot"), "buckets", F.lit(-1).alias("side"))
    )
    wanted = sides.select("snapshot", "buckets").distinct()
    sketched = rows.join(wanted, "snapshot").withColumn("bucket", _bucket(F.col("buckets")))
    cells = _aggregate_cells(sketched, ["snapshot", "buckets", "bucket"], 11, options.widths[0])
    result = cut_lineage(_peeled(_subtract(sides.join(cells, ["snapshot", "buckets"])), 11, options.widths[0]))
    found = [result.where("sign <> 0")]
    failed = result.where("sign = 0").select("pid", "bucket")
    for attempt, width in enumerate(options.widths[1:], 2):
        if failed.isEmpty():
            break
        again = rows.join(failed.join(sides, "pid"), "snapshot").where(_bucket(F.col("buckets")) == F.col("bucket"))
        cells = _aggregate_cells(again, ["pid", "bucket", "side"], 11 * attempt, width)
        result = cut_lineage(_peeled(_subtract(cells), 11 * attempt, width))
        found.append(result.where("sign <> 0"))
        failed = result.where("sign = 0").select("pid", "bucket")
    if not failed.isEmpty():
        left = rows.join(failed.join(sides, "pid"), "snapshot").where(_bucket(F.col("buckets")) == F.col("bucket"))
        both = left.groupBy("pid", "bucket", "kh").agg(
            F.max(F.when(F.col("side") == 1, F.col("vh"))).alias("v_new"), F.max(F.when(F.col("side") == -1, F.col("vh"))).alias("v_old")
        )
        differ = both.where(~F.col("v_new").eqNullSafe(F.col("v_old")))
        signs = F.filter(F.array(F.when(F.col("v_new").isNotNull(), F.lit(1)), F.when(F.col("v_old").isNotNull(), F.lit(-1))), lambda x: x.isNotNull())
        found.append(differ.select("pid", "bucket", "kh", F.explode(signs).alias("sign")))
    pairs_found = found[0]
    for more in found[1:]:
        pairs_found = pairs_found.unionByName(more)
    kinds = pairs_found.groupBy("pid", "kh").agg(F.max("sign").alias("hi"), F.min("sign").alias("lo"))
    kinds = kinds.withColumn("change_kind", F.when(F.col("hi") != F.col("lo"), "changed").when(F.col("hi") == 1, "added").otherwise("removed"))
    at = F.when(F.col("change_kind") == "removed", F.col("older")).otherwise(F.col("newer"))
    return (
        kinds.join(sized, "pid")
        .withColumn("snapshot", at)
        .join(rows.select("snapshot", "kh", "key"), ["snapshot", "kh"])
        .select("pid", "newer", "older", "key", "change_kind")
    )


def snapshot_changes(runs: DataFrame, findings: DataFrame, options: DeltaOptions = DeltaOptions()) -> DataFrame:
    """Findings added, removed or changed between each run and the snapshot it names.

    Result: facts_path, since_path (normalised), finding_id, change_kind; distinct.
    Runs whose since_path is null or names no delivered snapshot are left out; rows
    without finding_id are ignored; of several rows of one finding the one with the
    latest loaded_at (null is earliest), then the greatest row_id, holds. A snapshot
    without findings is empty. Further columns of either table are ignored.
    """
    paths = runs.select(F.col("facts_path").alias("older"), relative_path(F.col("facts_path")).alias("at")).where("older is not null").distinct()
    pairs = (
        runs.where("facts_path is not null and since_path is not null")
        .select(F.col("facts_path").alias("newer"), relative_path(F.col("since_path")).alias("at"))
        .distinct()
        .join(paths, "at")
        .where("newer <> older")
        .select("newer", "older", F.xxhash64("newer", "older").alias("pid"))
    )
    fixed = F.to_json(F.struct("finding_type", "category", "confidence", "tags", "evidence"))
    rows = (
        findings.where("facts_path is not null and finding_id is not null and finding_id <> ''")
        .select(
            F.col("facts_path").alias("snapshot"),
            F.col("finding_id").alias("key"),
            F.struct("loaded_at", "row_id").alias("order"),
            F.xxhash64(fixed, canonical_json_hash("payload")).alias("vh"),
        )
        .groupBy("snapshot", "key")
        .agg(F.max_by("vh", "order").alias("vh"))
        .withColumn("kh", F.xxhash64("key"))
    )
    delta = keyed_delta(cut_lineage(rows), pairs, options)
    return delta.select(F.col("newer").alias("facts_path"), F.col("older").alias("since_path"), F.col("key").alias("finding_id"), "change_kind").distinct()
