"""Fuzzy forecasting, one model per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .findings import SERIES, in_order
from .scan import LONG, bound, carried, over_ranges, over_series


def hold_out(df: DataFrame, key=SERIES, long: int | None = LONG) -> DataFrame:
    """Rows with back = 1 for the last point (held out), 2 for the last known, and so on. A range of a long series counts on from the rows after it."""
    key = list(key)
    place = lambda k: F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("ts"), F.desc("ord"))).cast("long")

    def ranged(r: DataFrame) -> DataFrame:
        c = carried(r, key, {"n": F.count("*")}, {"_later": lambda s, before, after: F.coalesce(F.sum(s).over(after), F.lit(0))}, {"_later": "n"})
        return c.withColumn("back", place([*key, "_range"]) + F.col("_later"))

    return over_ranges(df, lambda d: d.withColumn("back", place(key)), ranged, key, long=long)


def universe(train: DataFrame, key=SERIES) -> DataFrame:
    """Umin, umax (a tenth of the range beyond the data), mean, sample deviation, and cuts: mean -/+ 2, 1, 0.5 deviations."""
    spread = F.max("value") - F.min("value")
    g = train.groupBy(*key).agg((F.min("value") - 0.1 * spread).alias("umin"), (F.max("value") + 0.1 * spread).alias("umax"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), spread.alias("spread"), F.count("*").alias("n"))
    return g.withColumn("cuts", F.array(*(F.col("mean") + k * F.coalesce("sd", F.lit(0.0)) for k in (-2.0, -1.0, -0.5, 0.5, 1.0, 2.0))))


def fuzzy_sets(uni: DataFrame, key=SERIES) -> DataFrame:
    """Seven triangles (idx, a, b, c) per series; feet two edges apart, peak at their middle."""
    e = F.concat(F.array("umin"), F.col("cuts"), F.array("umax"))
    feet = [F.struct(F.lit(i).alias("idx"), e[lo].alias("a"), e[hi].alias("c")) for i, (lo, hi) in enumerate(((0, 1), (0, 2), (1, 3), (2, 4), (3, 5), (4, 6), (5, 7)), 1)]
    s = uni.select(*key, F.explode(F.array(*feet)).alias("s"))
    return s.select(*key, "s.idx", "s.a", ((F.col("s.a") + F.col("s.c")) / 2).alias("b"), "s.c")


def fuzzify(points: DataFrame, sets: DataFrame, key=SERIES) -> DataFrame:
    """Each point's set of greatest membership, ties to the lowest; all memberships 0 (and any series of zero width) give set 1."""
    up = (F.col("value") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0))
    down = (F.col("c") - F.col("value")) / F.nullif(F.col("c") - F.col("b"), F.lit(0.0))
    member = F.greatest(F.lit(0.0), F.when(up.isNotNull() & down.isNotNull(), F.least(up, down)))
    m = points.join(sets.hint("shuffle_merge"), list(key)).withColumn("m", F.round(F.coalesce(member, F.lit(0.0)), 9))
    best = F.max(F.struct("m", (-F.col("idx")).alias("i")))
    return m.groupBy(*key, "ts", "ord", "value").agg((-best["i"]).alias("state"))


def rule_base(states: DataFrame, key=SERIES, long: int | None = LONG) -> DataFrame:
    """How often a state is followed by another."""
    nxt = over_series(states, lambda d, k: d.withColumn("next", F.lead("state").over(in_order(k))), key, ahead=1, long=long).where("next is not null")
    return nxt.groupBy(*key, "state", "next").agg(F.count("*").alias("times"))


def forecast(df: DataFrame, key=SERIES, long: int | None = LONG) -> DataFrame:
    """A row per series of two points or more: state, forecast, direction, abnormal, abs_error, ape.

    The forecast is the mean of the successors' peaks, weighted by their counts, null without a
    rule; a constant series forecasts its value. abnormal: error above twice the deviation of
    the training points. ape is in percent, infinite for an actual value of 0.
    """
    long = bound(df, key, long)
    held = hold_out(df, key, long)
    train = held.where("back > 1")
    uni = universe(train, key)
    sets = fuzzy_sets(uni, key)
    states = fuzzify(train.select(*key, "ts", "ord", "value"), sets, key)
    rules = rule_base(states, key, long)
    peaks = rules.join(sets.select(*key, F.col("idx").alias("next"), "b").hint("shuffle_merge"), [*key, "next"])
    means = peaks.groupBy(*key, "state").agg((F.sum(F.col("times") * F.col("b")) / F.sum("times")).alias("guess"))
    now = states.groupBy(*key).agg(F.max_by(F.struct("state", "value"), F.struct("ts", "ord")).alias("p")).select(*key, "p.state", F.col("p.value").alias("known"))
    actual = held.where("back = 1").select(*key, F.col("value").alias("actual"))
    m = now.join(means.hint("shuffle_merge"), [*key, "state"], "left").join(uni.select(*key, "sd", "spread"), list(key)).join(actual, list(key))
    m = m.withColumn("forecast", F.when(F.col("spread") == 0, F.col("known")).otherwise(F.col("guess")))
    err = F.abs(F.col("actual") - F.col("forecast"))
    way = F.when(F.col("forecast") > F.col("known"), "Upward").when(F.col("forecast") < F.col("known"), "Downward").when(F.col("forecast").isNotNull(), "Unchanged")
    ape = F.when(err.isNotNull(), F.when(F.col("actual") == 0, F.lit(float("inf"))).otherwise(100 * err / F.abs("actual")))
    return m.select(*key, "state", "known", "actual", "forecast", way.alias("direction"), (err > 2 * F.col("sd")).alias("abnormal"), err.alias("abs_error"), ape.alias("ape"))
