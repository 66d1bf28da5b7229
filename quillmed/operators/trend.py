"""Trend analysis of series (T1-T17). All windows of a series share one partitioning, so they share one exchange; long series are cut into ranges (scan.py)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .findings import SERIES, in_order
from .scan import LONG, bound, carried, null_safe, over_ranges, over_series, quantiles, with_edges
from .store import sized, written


def range_label(value: Column, low: float, high: float) -> Column:
    """T1."""
    return F.when(value < low, "LOW").when(value > high, "HIGH").otherwise("NORMAL")


def ewma_depth(span: int) -> int:
    """Rows after which a weight falls below 2**-53 of the first."""
    return math.ceil(53 * math.log(2) / -math.log(1 - 2 / (span + 1)))


def ewma_block(span: int) -> int:
    """Rows over which weights of a running sum stay within doubles."""
    return max(1, int(150 * math.log(10) / -math.log(1 - 2 / (span + 1))))


def add_ewma(df: DataFrame, value: str = "value", span: int = 3, key=SERIES, blocks: bool = True) -> DataFrame:
    """T2 within one window: adds ewma. Null values take no weight; it is null before the first value.

    Weighted sums run on from row to row: weights grow instead of falling, so that one running sum serves all rows. Rows are
    counted into blocks in which the weights stay within doubles, so of the blocks before only the last one matters; blocks False: no series is longer than a block."""
    decay, block = 1 - 2 / (span + 1), ewma_block(span)
    so_far = in_order(key).rowsBetween(Window.unboundedPreceding, 0)
    c = df.withColumn("_c", F.count(value).over(so_far))
    total = (1 - F.pow(F.lit(decay), F.col("_c"))) / (1 - decay)
    if not blocks:
        s = F.sum(F.col(value) * F.pow(F.lit(1 / decay), F.col("_c") - 1)).over(so_far) * F.pow(F.lit(decay), F.col("_c") - 1)
        return c.withColumn("ewma", F.when(F.col("_c") > 0, s / total)).drop("_c")
    c = c.withColumn("_r", F.pmod(F.col("_c") - 1, F.lit(block))).withColumn("_b", F.floor((F.col("_c") - 1) / block))
    own = F.sum(F.col(value) * F.pow(F.lit(1 / decay), F.col("_r"))).over(Window.partitionBy(*key, "_b").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("_s", own * F.pow(F.lit(decay), F.col("_r")))
    c = c.withColumn("_p", F.when(F.col("_c") > block, F.last(F.when(F.col("_r") == block - 1, F.struct("_s", "_b")), ignorenulls=True).over(so_far)))
    # a block's last row sees itself; what it lacks of the block before weighs 1e-150
    c = c.withColumn("_q", F.when(F.col("_p._b") < F.col("_b"), F.col("_p._s")).otherwise(0.0))
    s = F.col("_s") + F.coalesce("_q", F.lit(0.0)) * F.pow(F.lit(decay), F.col("_r") + 1)
    return c.withColumn("ewma", F.when(F.col("_c") > 0, s / total)).drop("_c", "_r", "_b", "_s", "_p", "_q")


def with_ewma(df: DataFrame, span: int = 3, key=SERIES, long: int | None = LONG) -> DataFrame:
    """Adds ewma, the bias-adjusted exponentially weighted mean, for series of any length. A range of a long series looks
    back so many rows that what lies before them weighs less than 2**-53."""
    if bound(df, key, ewma_block(span) if long is None else min(long, ewma_block(span))) is None:
        return add_ewma(df, "value", span, key, blocks=False)
    return over_series(df, lambda d, k: add_ewma(d, "value", span, k), key, back=ewma_depth(span), long=long)


def spike_limits(df: DataFrame, deviation: str = "deviation", most: float = 108.0, key=SERIES, long: int | None = LONG) -> DataFrame:
    """Per series the smaller of `most` and 1.5 times the inter-quartile range of deviations."""
    q = quantiles(df, key, deviation, [0.25, 0.75], long)
    return q.select(*key, F.least(F.lit(most), 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("spike"))


#: Differences below this share of a value come from the order in which doubles are added, and decide no label.
NOISE = 1e-9


def spike_status(status: Column, deviation: Column, spike: Column, value: Column | None = None) -> Column:
    """T4: sharp changes override the range label. With value, a deviation beyond the limit by less than NOISE of the value is none: in a series that stands
    still both are rests of rounding."""
    beyond = F.abs(deviation) - spike > (F.lit(0.0) if value is None else NOISE * F.abs(value))
    return F.when(beyond & (deviation > 0), "SHARP_RISE").when(beyond & (deviation < 0), "SHARP_DROP").otherwise(status)


def profile(df: DataFrame, low: float, high: float, span: int = 3, most: float = 108.0, key=SERIES, long: int | None = LONG) -> DataFrame:
    """T1-T4 and T7, T8 in one pass over each series: ewma, deviation, spike, status, slope, slope_label."""
    short = bound(df, key, ewma_block(span) if long is None else min(long, ewma_block(span))) is None

    def base(d: DataFrame, k) -> DataFrame:
        d = add_ewma(d, "value", span, k, not short).withColumn("deviation", F.col("value") - F.col("ewma"))
        return d.withColumn("slope", moving_slope(k)).withColumn("slope_label", slope_label(F.col("slope")))

    def labelled(d: DataFrame) -> DataFrame:
        return d.withColumn("status", spike_status(range_label(F.col("value"), low, high), F.col("deviation"), F.col("spike"), F.col("value")))

    def plain(d: DataFrame) -> DataFrame:
        q = F.percentile("deviation", [0.25, 0.75]).over(Window.partitionBy(*key))  # on the same partitioning, so no join
        return labelled(base(d, key).withColumn("_q", q).withColumn("spike", F.least(F.lit(most), 1.5 * (F.col("_q")[1] - F.col("_q")[0]))).drop("_q"))

    def ranged(r: DataFrame) -> DataFrame:
        known = written(base(with_edges(r, key, ("ts", "ord"), ewma_depth(span)), [*key, "_range"]).where("not _edge"), "profile")
        return labelled(null_safe(known, spike_limits(known, "deviation", most, key, 0), list(key)))

    return over_ranges(df, plain, ranged, key, long=None if short else long)


def dickey_fuller(df: DataFrame, critical: float = -2.86, least: int = 5, key=SERIES) -> DataFrame:
    """Regression of the change on the previous value with intercept and no lags; its t-ratio
    against the published 5 % value. Null for fewer than `least` changes or no variation."""
    prev = lambda d, k: d.withColumn("x", F.lag("value").over(in_order(k)))
    d = over_series(df, prev, key, back=1).withColumn("y", F.col("value") - F.col("x")).where("x is not null")
    g = d.groupBy(*key).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    rest = (F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2)
    t = F.when((F.col("n") >= least) & (F.col("sxx") > 0) & (rest > 0), F.col("b") / F.sqrt(rest / F.col("sxx")))
    return g.select(*key, "n", t.alias("t_ratio")).withColumn("stationary", F.col("t_ratio") < critical)


def day_number(ts: str = "ts") -> Column:
    return F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("double")


def moving_slope(key=SERIES, rows: int = 3) -> Column:
    """Least-squares slope of the last `rows` values against the day; null before, and when all fall on one day."""
    w = in_order(key).rowsBetween(1 - rows, 0)
    flat = F.max(day_number()).over(w) == F.min(day_number()).over(w)
    return F.when((F.count("value").over(w) >= rows) & ~flat, F.regr_slope("value", day_number()).over(w))


def with_slope(df: DataFrame, rows: int = 3, key=SERIES, long: int | None = LONG) -> DataFrame:
    """Adds slope, for series of any length."""
    return over_series(df, lambda d, k: d.withColumn("slope", moving_slope(k, rows)), key, back=rows - 1, long=long)


def slope_label(slope: Column, flat: float = 0.1, digits: int = 9) -> Column:
    """T8. Slopes are compared as rounded to `digits`: a slope of exactly `flat` comes out a rest of rounding above or below it, as its sums were added."""
    slope = F.round(slope, digits)
    return F.when(slope.isNull(), "UNKNOWN").when(F.abs(slope) < flat, "STABLE").when(slope >= flat, "UP").otherwise("DOWN")


def told_apart(df: DataFrame, key=SERIES, long: int | None = LONG) -> DataFrame:
    """df with ord made unique in its series: ord and a number among the rows of one ts and ord, by value. Where rows are repeated, sorts may put
    either one first, and runs (T9) would hang on it, since each has an ewma and a slope of its own. long None: it is known that no series is long."""
    alike = Window.partitionBy(*key, "ts", "ord").orderBy("value")
    dealt = df.repartition(*key) if long is None else df  # then the windows over series need no other exchange
    return dealt.withColumn("_copy", F.row_number().over(alike)).withColumn("ord", F.struct("ord", "_copy")).drop("_copy")


def segments(df: DataFrame, key=SERIES, long: int | None = LONG) -> DataFrame:
    """Runs of equal slope_label (UNKNOWN left out): start, rows, counts of each status. Of a long series each range counts its runs from the
    number of runs before it; a run may go over several ranges. The order (ts, ord) must be unique (told_apart)."""
    key = list(key)

    def marked(d: DataFrame, k) -> DataFrame:
        return d.withColumn("_new", F.coalesce((F.lag("slope_label").over(in_order(k)) != F.col("slope_label")).cast("int"), F.lit(1)))

    def numbered(d: DataFrame, k) -> DataFrame:
        return d.withColumn("run", F.sum("_new").over(in_order(k).rowsBetween(Window.unboundedPreceding, 0)))

    def ranged(r: DataFrame) -> DataFrame:
        m = written(marked(with_edges(r, key, ("ts", "ord"), 1), [*key, "_range"]).where("not _edge").drop("_edge"), "segments")
        n = carried(m, key, {"runs": F.sum("_new")}, {"_upto": lambda s, before, after: F.coalesce(F.sum(s).over(before), F.lit(0))}, {"_upto": "runs"})
        return numbered(n, [*key, "_range"]).withColumn("run", F.col("run") + F.col("_upto"))

    runs = over_ranges(df.where("slope_label <> 'UNKNOWN'"), lambda d: numbered(marked(d, key), key), ranged, key, long=long)
    counts = {s: F.sum((F.col("status") == s).cast("long")) for s in ("NORMAL", "LOW", "HIGH", "SHARP_RISE", "SHARP_DROP")}
    return runs.groupBy(*key, "run").agg(F.first("slope_label").alias("label"), F.min("ts").alias("start"), F.count("*").alias("steps"), F.array_sort(F.collect_set("status")).alias("statuses"), *(v.alias(s.lower()) for s, v in counts.items()))


def commentary(df: DataFrame) -> DataFrame:
    """A sentence per segment and the first remark that fits its label and statuses."""
    has = lambda s: F.array_contains("statuses", s)
    label = F.col("label")
    remark = (F.when((label == "UP") & has("SHARP_RISE"), "Rising with sharp jumps.").when((label == "DOWN") & ~has("SHARP_DROP"), "Steady decline.")
              .when((label == "STABLE") & has("HIGH"), "Stable but high.").when((label == "DOWN") & has("LOW"), "Falling to low values.")
              .when((label == "UP") & has("HIGH"), "Rising to high values."))
    base = F.format_string("From %s %s for %d steps.", F.date_format("start", "yyyy-MM-dd"), label, F.col("steps"))
    return df.withColumn("comment", F.concat_ws(" ", base, remark))


def fluctuation(limit: float, rows: int = 3, key=SERIES) -> Column:
    """FLUCTUATING if the rolling sample deviation is above the limit; null before `rows` values."""
    w = in_order(key).rowsBetween(1 - rows, 0)
    sd = F.when(F.count("value").over(w) >= rows, F.stddev_samp("value").over(w))
    return F.when(sd > limit, "FLUCTUATING").when(sd.isNotNull(), "STABLE")


def with_fluctuation(df: DataFrame, limit: float, rows: int = 3, key=SERIES, long: int | None = LONG) -> DataFrame:
    """Adds fluctuation, for series of any length."""
    return over_series(df, lambda d, k: d.withColumn("fluctuation", fluctuation(limit, rows, k)), key, back=rows - 1, long=long)


def recent(df: DataFrame, interval: str = "INTERVAL 3 MONTHS", key=SERIES) -> DataFrame:
    """Rows later than the series' last time less the interval. Last times are one row a series, so a long series isn't brought together."""
    last = df.groupBy(*key).agg(F.max("ts").alias("_last"))
    return null_safe(df, last, list(key)).where(F.col("ts") > F.col("_last") - F.expr(interval)).drop("_last")


def period_summary(df: DataFrame, name: str, key=SERIES) -> DataFrame:
    """Per series counts of slope labels, the share of fluctuating rows, and its wording."""
    rate = 100 * F.avg((F.coalesce("fluctuation", F.lit("")) == "FLUCTUATING").cast("double"))
    n = lambda s: F.sum((F.col("slope_label") == s).cast("long"))
    g = df.groupBy(*key).agg(n("UP").alias("up"), n("DOWN").alias("down"), n("STABLE").alias("stable"), rate.alias("rate"))
    word = F.when(F.col("rate") > 50, "significant").when(F.col("rate") > 20, "moderate").otherwise("stable")
    return g.select(F.lit(name).alias("period"), *key, "up", "down", "stable", "rate", word.alias("wording"))


def resample(df: DataFrame, width: str, key=SERIES) -> DataFrame:
    """Means of bins of `width` (an interval of days or hours) from midnight of the first day; empty bins stay, with a null value."""
    seconds = F.lit(_seconds(width)).cast("long")
    start = df.groupBy(*key).agg(F.date_trunc("day", F.min("ts")).cast("timestamp").alias("start"), F.max("ts").cast("timestamp").alias("last"))
    bin_of = lambda t: F.floor((F.unix_micros(t) - F.unix_micros("start")) / (seconds * 1000000)).cast("long")
    spine = start.select(*key, "start", F.explode(F.sequence(F.lit(0).cast("long"), bin_of(F.col("last")))).alias("bin"))
    means = df.join(start.hint("shuffle_merge"), list(key)).groupBy(*key, bin_of(F.col("ts").cast("timestamp")).alias("bin")).agg(F.avg("value").alias("value"))
    at = F.timestamp_micros(F.unix_micros("start") + F.col("bin") * seconds * 1000000).cast("timestamp_ntz")
    return spine.join(means.hint("shuffle_merge"), [*key, "bin"], "left").select(*key, "bin", at.alias("ts"), "value")


def _seconds(width: str) -> int:
    n, unit = width.lower().split()
    return int(n) * {"hour": 3600, "day": 86400}[unit.rstrip("s")]


def _beside(df: DataFrame, key, known: Column, long: int | None) -> DataFrame:
    """Adds _p, the last known at or before a bin, and _n, the first known at or after it. A range of a long series takes those of the ranges beside it where it has none."""
    key = list(key)

    def add(d: DataFrame, k) -> DataFrame:
        w = Window.partitionBy(*k).orderBy("bin")
        back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        return d.withColumn("_p", F.last(known, ignorenulls=True).over(back)).withColumn("_n", F.first(known, ignorenulls=True).over(ahead))

    def ranged(r: DataFrame) -> DataFrame:
        least, most = F.min_by(known, F.when(known.isNotNull(), F.col("bin"))), F.max_by(known, F.when(known.isNotNull(), F.col("bin")))
        take = {"_before": lambda s, before, after: F.last(s, ignorenulls=True).over(before), "_after": lambda s, before, after: F.first(s, ignorenulls=True).over(after)}
        c = carried(r, key, {"last": most, "first": least}, take, {"_before": "last", "_after": "first"})
        return add(c, [*key, "_range"]).withColumn("_p", F.coalesce("_p", "_before")).withColumn("_n", F.coalesce("_n", "_after"))

    return over_ranges(df, lambda d: add(d, key), ranged, key, ("bin",), long)


def interpolate(df: DataFrame, key=SERIES, long: int | None = LONG) -> DataFrame:
    """Linear by bin between known bins; after the last known one its value; before the first null."""
    m = _beside(df, key, F.when(F.col("value").isNotNull(), F.struct("bin", "value")), long)
    p, n = F.col("_p"), F.col("_n")
    line = p["value"] + (n["value"] - p["value"]) * (F.col("bin") - p["bin"]) / F.nullif(n["bin"] - p["bin"], F.lit(0).cast("long"))
    return m.withColumn("value", F.coalesce("value", F.when(p.isNotNull(), F.coalesce(line, p["value"])))).select(df.columns)


def fill(df: DataFrame, key=SERIES, long: int | None = LONG) -> DataFrame:
    """Forward, then backward."""
    m = _beside(df, key, F.when(F.col("value").isNotNull(), F.struct("bin", "value")), long)
    return m.withColumn("value", F.coalesce("_p.value", "_n.value")).select(df.columns)


def keep_mapped(df: DataFrame, mapping: DataFrame, key=SERIES) -> DataFrame:
    """mapping(test, name): rename mapped series, drop others and those without any value."""
    m = df.join(sized(mapping), "test")
    known = m.where("value is not null").select(*key).distinct()
    same = reduce(lambda a, b: a & b, (m[k].eqNullSafe(known[k]) for k in key))
    return m.join(known.hint("shuffle_merge"), same, "left_semi").drop("test").withColumnRenamed("name", "test")
