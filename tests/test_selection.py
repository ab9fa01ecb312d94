from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import metrics, selection

POINTS = {"q10": 0.1, "median": 0.5, "q90": 0.9, "top": 1.0}


def made(seed=1):
    rnd = random.Random(seed)
    draw = {
        "even": lambda: rnd.random(), "long tail": lambda: 10 ** (rnd.random() * 600 - 300), "few": lambda: float(rnd.randrange(3)), "signs": lambda: rnd.choice([-1, 1]) * 1.7e308 * rnd.random(), "same": lambda: 7.0, None: lambda: rnd.gauss(0, 1),
        "close": lambda: 1.0 + rnd.randrange(50) * 2.0**-52, "tiny": lambda: rnd.randrange(40) * 5e-324,
    }
    rows = [(k, "x", f()) for k, f in draw.items() for _ in range(700)] + [("one", "x", 3.0), ("two", "x", 3.0), ("two", "x", 4.0), ("nulls", "x", None), ("inf", "x", float("inf"))] + [("inf", "x", 1.0)] * 600
    return rows


def stats(df):
    return df.groupBy("g", "h").agg(F.count("v").alias("n"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))


@pytest.mark.parametrize(("limit", "steps"), [(1 << 18, 256), (60, 16)])
def test_quantiles_equal_those_of_sorted_values(spark, limit, steps):
    rows = made()
    df = spark.createDataFrame(rows, "g string, h string, v double").repartition(3)
    got = {r.g: r for r in selection.with_quantiles(stats(df), df, ["g", "h"], "v", POINTS, limit, steps).collect()}
    assert set(got) == {r[0] for r in rows}
    for g, row in got.items():
        x = np.sort([v for k, _, v in rows if k == g and v is not None])
        for name, p in POINTS.items():
            if not len(x):
                assert row[name] is None
                continue
            at = (len(x) - 1) * p
            lo, hi = x[int(np.floor(at))], x[int(np.ceil(at))]
            assert row[name] == pytest.approx(lo if lo == hi else lo + (hi - lo) * (at - np.floor(at)), rel=1e-12, abs=0) or row[name] == hi


def test_summaries_of_large_groups(spark, monkeypatch):
    rows = [(i % 2, float(i * i % 997)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, v double")
    want = sorted(metrics.summarize_distribution(df, ["k"], "v").collect())
    plain = sorted(metrics.distribution_quantiles(df, ["k"], ["v"]).collect())
    refine = selection.exact_quantiles
    monkeypatch.setattr(selection, "exact_quantiles", lambda df, keys, value, points, stats, limit, steps: refine(df, keys, value, points, stats, 200, 8))
    assert sorted(metrics.summarize_distribution(df, ["k"], "v").collect()) == want
    assert sorted(metrics.distribution_quantiles(df, ["k"], ["v"]).collect()) == plain
    assert [r["median"] for r in want] == [float(np.median([v for k, v in rows if k == g])) for g in (0, 1)]
