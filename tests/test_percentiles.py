"""Exact percentiles by narrowing histograms against Spark's own."""

import random

import pytest
from pyspark.sql import functions as F

from vecshift.operators import telemetry
from vecshift.operators.percentiles import exact_percentiles

POINTS = (0.0, 0.05, 0.5, 0.9, 0.95, 0.99, 1.0)


def both(df, by, **options):
    names = list(by)
    want = df.where("NOT isnan(x) OR x IS NULL").groupBy(*names).agg(F.count("x").alias("n"), F.expr(f"percentile(x, array({', '.join(map(str, POINTS))}))").alias("p")).collect()
    got = exact_percentiles(df, "x", POINTS, by, **options).collect()
    row = lambda r: (tuple(str(r[c]) for c in names), r.n, None if r.p is None or r.p[0] is None else [pytest.approx(v, rel=1e-12, abs=1e-300) for v in r.p])
    value = lambda r: (tuple(str(r[c]) for c in names), r.n, None if r.p is None or r.p[0] is None else list(r.p))
    return sorted(map(value, got), key=str), sorted(map(row, want), key=lambda r: r[0])


@pytest.mark.parametrize("few", [100_000, 20])
def test_equals_percentile(spark, few):
    rng = random.Random(1)
    rows = []
    for g in ("even", "skewed", "ties", "one", "pair", None):
        n = {"one": 1, "pair": 2}.get(g, 700)
        for _ in range(n):
            x = {"skewed": 10 ** rng.uniform(-12, 12), "ties": float(rng.choice([1, 1, 1, 2, 5]))}.get(g, rng.gauss(0, 100))
            rows.append((g, x))
    rows += [("empty", None), ("even", float("nan")), ("even", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got, want = both(df, ("g",), few=few, ranges=16)
    assert [x[:2] for x in sorted(got, key=lambda r: r[0])] == [x[:2] for x in want]
    for a, b in zip(sorted(got, key=lambda r: r[0]), want, strict=True):
        assert a == b


def test_without_groups_extremes_and_errors(spark):
    df = spark.createDataFrame([(x,) for x in [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 3.0] * 9], "x double")
    got, want = both(df, (), few=3, ranges=4)
    assert got == want
    assert exact_percentiles(df.limit(0), "x", (0.5,)).first().n == 0
    with pytest.raises(Exception, match="infinite"):
        exact_percentiles(df.unionByName(spark.createDataFrame([(float("inf"),)], "x double")), "x", (0.5,)).collect()
    with pytest.raises(ValueError):
        exact_percentiles(df, "x", (1.5,))


def test_latency_summary_is_the_same_for_large_groups(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.gauss(50, 9) if rng.random() > 0.05 else None) for _ in range(600)], "g string, ms double")
    for by in ((), ("g",)):
        one, two = (sorted(map(str, telemetry.latency_summary(df, "ms", by, few=few).collect())) for few in (10_000, 40))
        assert one == two and len(one) == (3 if by else 1)
