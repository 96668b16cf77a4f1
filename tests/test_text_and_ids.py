import hashlib
import re

from diffloom.functions import text as T
from diffloom.operators import identity as I
from pyspark.sql import functions as F

LINES = ["token = 'abc def'", 'password: "x"', "secret=zzz,next", "const apiKey = process.env.K;", "sk_live_" + "a" * 30, "AKIA" + "B" * 16, "plain", "", "hash " + "f" * 40, "v " + "f" * 40, "ghp_" + "A" * 36, "auth_token: q }", None]


def brute_secrets(s):
    for p, to in T.REDACT_SECRETS:
        s = re.sub(p, re.sub(r"\$(\d)", r"\\g<\1>", to), s)
    return s


def brute_line(s):
    s = re.sub(r"(ghp_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]+)", "<redacted-github-token>", s)
    for k in T.SECRET_KEYS:
        s = re.sub(rf"(?i)({k})\s*=\s*['\"]?([^'\"\s}}<]+)['\"]?", r"\1=<redacted>", s)
        s = re.sub(rf"(?i)({k})\s*:\s*['\"]?([^'\"\s,}}<]+)['\"]?", r"\1: <redacted>", s)
    if not any(w in s for w in ("<redacted", "hash", "checksum")):
        s = re.sub(r"\b[a-zA-Z0-9+/=]{32,}\b", "<redacted-value>", s)
    return s


def test_redactors_against_brute_force(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "t string")
    for r in df.select("t", T.redact_secrets(F.col("t")).alias("a"), T.redact_line(F.col("t")).alias("b")).collect():
        assert r.a == (None if r.t is None else brute_secrets(r.t))
        assert r.b == (None if r.t is None else brute_line(r.t))


def test_excerpt(spark):
    df = spark.createDataFrame([(["// c", "  x ", "y"],), (["", "# only"],), ([],), (["a" * 300],), ([" \u2003lead"],)], "l array<string>")
    assert [r.e for r in df.select(T.representative_excerpt(F.col("l")).alias("e")).collect()] == ["x", "", "", "a" * 197 + "...", "lead"]


def test_ids(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a", "b"],)], "ids array<string>")
    got = {r.f for r in df.select(I.flag_id(F.lit("k"), F.col("ids")).alias("f")).collect()}
    assert got == {"flag.k#" + hashlib.sha256(b"k:a,b").hexdigest()[:12]}


def test_delta_of_equal_sides_is_empty_and_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 5, "z")], "k string, o int, v string")
    one = I.last_wins(df, ["k"], ["o"])
    assert sorted((r.k, r.v) for r in one.collect()) == [("a", "y"), ("b", None)]
    assert I.delta_by_id(one, one, ["k"], "v").count() == 0
    other = spark.createDataFrame([("a", "q"), ("c", "w")], "k string, v string")
    assert sorted((r.k, r.change) for r in I.delta_by_id(one.select("k", "v"), other, ["k"], "v").collect()) == [("a", "changed"), ("b", "removed"), ("c", "added")]
