import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluation as E
from quillspark.operators import quantiles as Q


def linear(xs, q):
    xs = sorted(xs)
    place = q * (len(xs) - 1)
    a, z = math.floor(place), math.ceil(place)
    return xs[a] if a == z else (z - place) * xs[a] + (place - a) * xs[z]


def kinds():
    rng = random.Random(1)
    yield "even", [rng.random() for _ in range(400)]
    yield "ties", [float(rng.randint(0, 5)) for _ in range(400)]
    yield "far", [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(400)]
    yield "near", [1.0 + k * 2.0**-52 for k in range(40)]
    yield "outlier", [*(rng.gauss(0, 1) for _ in range(2000)), 1e308, -1e308, 0.0, -0.0]
    yield "one", [4.5]
    yield "two", [1.0, 2.0]
    yield None, [3.0, -2.0, 7.0]


@pytest.mark.parametrize(("buckets", "broadcast"), [(1024, 100_000), (32, 0)])
def test_quantiles_are_exact(spark, monkeypatch, buckets, broadcast):
    monkeypatch.setattr(Q, "BUCKETS", buckets)
    monkeypatch.setattr(Q, "BROADCAST_BRACKETS", broadcast)
    every = list(kinds())
    rows = [(g, x) for g, xs in every for x in xs] + [("even", None), ("even", float("nan")), ("even", float("inf")), ("none", None)]
    if broadcast == 0:
        rows, every = [r for r in rows if r[0] in ("even", "two")], [e for e in every if e[0] in ("even", "two")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    at = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = {(r["g"], r["name"]): r for r in Q.quantiles(df, ["g"], {"x": F.col("x"), "less": -F.col("x")}, at).collect()}
    assert {k for k, r in got.items() if r["n"]} == {(g, name) for g, _ in every for name in ("x", "less")}
    for g, xs in every:
        for name, sign in (("x", 1), ("less", -1)):
            assert got[g, name]["n"] == len(xs)
            assert got[g, name]["q"] == [linear([sign * x for x in xs], q) for q in at], (g, name)


def test_a_pass_holds_buckets_only(spark):
    n = 2_000_000
    df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("double").alias("x"), (F.col("id") % 4).alias("lang"))
    want = {}
    for lang in range(4):
        got = np.sort(np.array([r[0] for r in df.filter(f"lang = {lang}").select("x").collect()]))
        want[lang] = [float(np.quantile(got, q)) for q in E.QUARTILES]
    got = {r["lang"]: r for r in E.describe(df, ["lang"], "x").collect()}
    for lang in range(4):
        assert got[lang]["n"] == n // 4 and [got[lang][c] for c in ("q25", "q50", "q75")] == pytest.approx(want[lang], rel=1e-12)
    plan = E.describe(df, ["lang"], "x")._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_empty_groups(spark):
    df = spark.createDataFrame([("a", None), (None, 1.0)], "g string, x double")
    rows = {r["g"]: r for r in E.describe(df, ["g"], "x").collect()}
    assert rows["a"]["n"] == 0 and rows["a"]["q50"] is None and rows[None]["q25"] == 1.0
    assert E.describe(df.limit(0), ["g"], "x").count() == 0
    empty = {r["metric"]: r["value"] for r in E.report(df.limit(0).select(F.col("x").alias("a"), F.col("x").alias("b")), cer=("a", "b")).collect()}
    assert len(empty) == 13
