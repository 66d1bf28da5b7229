"""Long series, cut into ranges, give what short ones give."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmed.operators import findings, fuzzy, graph, lab, scan, trend
from quillmed.operators.fuzzy import fuzzify, fuzzy_sets, universe

HUGE = 1 << 40


@pytest.fixture(scope="module")
def events(spark):
    rng, rows, start = random.Random(5), [], dt.datetime(2024, 1, 1)
    for entity, test, n in ((1, "hot", 400), (1, "a", 3), (2, "b", 1), (None, "hot", 90), (3, "ties", 120)):
        for i in range(n):
            day = rng.randrange(3) if test == "ties" else rng.randrange(40)  # many points of one time
            rows.append((entity, test, start + dt.timedelta(days=day, minutes=0 if test == "ties" else rng.randrange(500)), float(rng.randrange(0, 60)), len(rows)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "entity long, test string, ts timestamp_ntz, value double, ord long").repartition(3).cache()


@pytest.fixture(autouse=True)
def small_ranges(monkeypatch):
    real = scan.cut
    monkeypatch.setattr(scan, "cut", lambda rows, key, order, total, size=0: real(rows, key, order, total, 37))


def canon(v):
    return round(v, 7) if isinstance(v, float) else tuple(map(canon, v)) if isinstance(v, list) else v


def rows(df):
    return sorted((tuple((c, str(canon(r[c]))) for c in sorted(df.columns)) for r in df.collect()))


def profiled(df, long):
    return trend.profile(df, 20.0, 40.0, long=long)


BINS = lambda df: trend.resample(df, "48 hours").withColumn("value", F.when(F.col("bin") % 3 != 0, F.col("value"))).drop("ts")
CASES = {
    "ewma": lambda d, n: trend.with_ewma(d, 3, long=n), "wide ewma": lambda d, n: trend.with_ewma(d, 30, long=n), "slope": lambda d, n: trend.with_slope(d, long=n), "fluctuation": lambda d, n: trend.with_fluctuation(d, 10.0, long=n),
    "spikes": lambda d, n: trend.spike_limits(d, "value", 50.0, long=n), "profile": profiled, "segments": lambda d, n: trend.segments(profiled(d, HUGE), long=n), "steps": lambda d, n: findings.steps(d, long=n),
    "hold out": lambda d, n: fuzzy.hold_out(d, long=n), "rules": lambda d, n: fuzzy.rule_base(fuzzify(d, fuzzy_sets(universe(d))), long=n),
    "interpolate": lambda d, n: trend.interpolate(BINS(d), long=min(n, 5) if n < HUGE else n), "fill": lambda d, n: trend.fill(BINS(d), long=min(n, 5) if n < HUGE else n),
    "labels": lambda d, n: graph.unique_labels(d.select("ord", F.concat(F.coalesce("test", F.lit("-")), F.when(F.col("ord") % 40 == 0, "_3").otherwise("")).alias("name")), "name", ["ord"], ["a", "hot_2"], n),
    "dates": lambda d, n: lab.fill_dates(d.select("test", "ord", F.when(F.col("ord") % 45 == 0, F.col("ts").cast("string")).otherwise("-").alias("Date")), "test", ["ord"], long=n)}


@pytest.mark.parametrize("name", CASES)
def test_ranges_give_what_one_window_gives(events, name):
    assert rows(CASES[name](events, 50)) == rows(CASES[name](events, HUGE))


def test_ewma_follows_its_definition(events):
    got = {(r["entity"], r["test"], r["ord"]): r["ewma"] for r in trend.with_ewma(events, 3, long=50).collect()}
    series = {}
    for r in sorted(events.collect(), key=lambda r: (r["ts"], r["ord"])):
        s, n = series.get((r["entity"], r["test"]), (0.0, 0.0))
        s, n = s * 0.5 + r["value"], n * 0.5 + 1
        series[r["entity"], r["test"]] = s, n
        assert got[r["entity"], r["test"], r["ord"]] == pytest.approx(s / n, rel=1e-12)


def test_long_blocks_of_ewma(spark):
    values = [float((k * 7919) % 101 - 50) for k in range(3000)]
    d = spark.createDataFrame([(1, "x", dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), None if k % 11 == 3 else v, k) for k, v in enumerate(values)], "entity long, test string, ts timestamp_ntz, value double, ord long")
    s = n = 0.0
    for k, r in enumerate(trend.with_ewma(d).orderBy("ts").collect()):
        if k % 11 != 3:
            s, n = s * 0.5 + values[k], n * 0.5 + 1
        assert r["ewma"] == pytest.approx(s / n, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("long", [0, 60, HUGE])
def test_quantiles_are_exact(events, long):
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["entity"], r["test"]): r["q"] for r in scan.quantiles(events, ["entity", "test"], "value", shares, long=long).collect()}
    own = {}
    for r in events.collect():
        own.setdefault((r["entity"], r["test"]), []).append(r["value"])
    assert got.keys() == own.keys()
    for k, q in got.items():
        assert q == pytest.approx(np.quantile(own[k], shares).tolist())
        assert q[3] == pytest.approx(statistics.median(own[k]))


def test_one_value_is_no_hot_spot(spark):
    d = spark.range(5000).select(F.lit(1).alias("k"), F.when(F.col("id") < 4999, 7.0).otherwise(9.0).alias("value"))
    assert scan.quantiles(d, ["k"], "value", [0.25, 0.75], long=10).first()["q"] == [7.0, 7.0]
    assert scan.quantiles(d.limit(0), ["k"], "value", [0.5], long=10).count() == 0


def test_no_window_holds_a_long_series(events):
    rest, hot, total = scan.apart(events, ["entity", "test"], 50)
    assert total == 610 and rest.count() == 4
    sizes = [r["count"] for r in scan.cut(hot, ["entity", "test"], ["ts", "ord"], total).groupBy("entity", "test", "_range").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 120
