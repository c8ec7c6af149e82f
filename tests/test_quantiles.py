"""Exact quantiles of large and small groups against numpy; places in an order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reconlake.operators.quantiles import quantiles
from reconlake.plans.ordinals import numbered

QS = {"lo": 0.05, "mid": 0.5, "hi": 0.975, "first": 0.0, "last": 1.0}


@pytest.mark.parametrize("small", [1, 7, 1 << 16])
def test_groups_equal_numpy(spark, small):
    r = np.random.default_rng(4)
    groups = {
        "normal": r.normal(size=900), "ties": r.integers(0, 3, 500).astype(float), "one": np.array([2.5]), "two": np.array([1.0, 4.0]), "same": np.full(300, 7.0),
        "wide": 10.0 ** r.uniform(-300, 300, 400), "outlier": np.append(r.uniform(0, 1e-9, 200), [1e300, -1e300]), None: r.normal(size=60), "signs": np.array([-0.0, 0.0, -1.0, 1.0] * 9),
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("none", None), ("none", None), ("same", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x["g"]: x for x in quantiles(df, ["g"], "v", QS, small).collect()}
    assert got.keys() == groups.keys() | {"none"}
    assert all(got["none"][n] is None for n in QS)
    for g, x in groups.items():
        for n, q in QS.items():
            assert got[g][n] == pytest.approx(np.quantile(x, q), rel=1e-12, abs=1e-300), (g, n)
    whole = quantiles(df, [], "v", QS, small).first()
    every = np.concatenate(list(groups.values()))
    assert all(whole[n] == pytest.approx(np.quantile(every, q), rel=1e-12) for n, q in QS.items())
    assert quantiles(df.limit(0), ["g"], "v", QS, small).collect() == []


def test_not_a_number_is_above_all(spark):
    df = spark.createDataFrame([(float(k),) for k in range(50)] + [(float("nan"),)], "v double")
    got = quantiles(df, [], "v", {"a": 0.5, "z": 1.0}, 5).first()
    assert got["a"] == 25 and np.isnan(got["z"])


def test_one_large_group(spark):
    df = spark.range(400_000).select(F.lit("g").alias("g"), F.expr("cast((id * 7919) % 400000 as double) / 7").alias("v"))
    got = quantiles(df, ["g"], "v", {"p5": 0.05, "mid": 0.5}, 500).first()
    assert got["mid"] == pytest.approx(399_999 / 14) and got["p5"] == pytest.approx(0.05 * 399_999 / 7)


def test_places_in_an_order(spark):
    df = spark.range(5000).selectExpr("id", "sha2(cast(id as string), 256) h", "CASE WHEN id % 9 = 0 THEN NULL ELSE id % 4 END k").repartition(6)
    got = numbered(df, ["k", "h"], "n").collect()
    want = sorted(got, key=lambda r: (r["k"] is not None, r["k"] or 0, r["h"]))
    assert [r["n"] for r in want] == list(range(5000)) and got[0].asDict().keys() == {"id", "h", "k", "n"}
    assert numbered(df.limit(0), ["h"]).collect() == []
