"""Findings per series of measurements (B1-B13). A series is (entity, test); its order is (ts, ord)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmed.functions.scalars import day_span

from .scan import LONG, carried, over_ranges, with_edges
from .store import sized, written

SERIES = ("entity", "test")
#: Theil-Sen pairs the points of series of so many points at most; slopes of longer ones are counted, not made.
ALL_PAIRS = 200
#: Whole days fit into so many binary digits (2800 years).
DAY_BITS = 20
#: Guesses of a step of the search for a median slope, and how close to it the search ends, relative to the spread of values.
GUESSES, CLOSE = 15, 1e-13
#: Points of one running count.
RUN = 50_000


def in_order(key=SERIES):
    return Window.partitionBy(*key).orderBy("ts", "ord")


def context_label() -> Column:
    """B1 as an aggregate: 'Unknown' without rows, 'Current' for one, else 'Last N Months' of 30 days, N at least
    1 and rounded half to even."""
    days = day_span(F.max("ts"), F.min("ts"))
    return (F.when(F.count("ts") == 0, "Unknown").when(F.count("ts") == 1, "Current")
            .otherwise(F.concat(F.lit("Last "), F.greatest(F.lit(1), F.bround(days / 30).cast("int")).cast("string"), F.lit(" Months"))))


def context(df: DataFrame, key=SERIES) -> DataFrame:
    """B1."""
    return df.groupBy(*key).agg(context_label().alias("context"))


def steps(df: DataFrame, key=SERIES, long: int | None = LONG) -> DataFrame:
    """Successive differences: prev_ts, prev_value, step and pair_no (1 for the first pair), for series of any length."""
    key = list(key)

    def add(d: DataFrame, k, counted: Column) -> DataFrame:
        w = in_order(k)
        return d.withColumn("prev_ts", F.lag("ts").over(w)).withColumn("prev_value", F.lag("value").over(w)).withColumn("pair_no", (counted - 1).cast("long")).withColumn("step", F.col("value") - F.col("prev_value"))

    def ranged(r: DataFrame) -> DataFrame:
        c = carried(r, key, {"n": F.count("*")}, {"_upto": lambda s, before, after: F.coalesce(F.sum(s).over(before), F.lit(0))}, {"_upto": "n"})
        k = [*key, "_range"]
        own = F.sum((~F.col("_edge")).cast("int")).over(in_order(k).rowsBetween(Window.unboundedPreceding, 0))
        return add(with_edges(c, key, ("ts", "ord"), 1), k, own + F.col("_upto")).where("not _edge")

    return over_ranges(df, lambda d: add(d, key, F.row_number().over(in_order(key))), ranged, key, long=long)


def monotonic(df: DataFrame, key=SERIES) -> DataFrame:
    """B2: rising / falling if all successive differences are positive / negative; null for one point."""
    return steps(df, key).groupBy(*key).agg(F.bool_and(F.col("step") > 0).alias("rising"), F.bool_and(F.col("step") < 0).alias("falling"))


def theil_sen(df: DataFrame, key=SERIES, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """Median of the slopes per day of all pairs of points on different days (whole elapsed days since the
    series' first point); 0 without a pair. Series of up to all_pairs points pair their points; longer ones, however
    long, get the same median by counting slopes."""
    key = list(key)
    shape = df.groupBy(*key).agg(F.count("*").alias("n"), F.min("ts").alias("since"))
    points = df.join(shape.hint("shuffle_merge"), key).select(*key, "value", "ts", "ord", "n", day_span(F.col("ts"), F.col("since")).alias("day"))
    short = points.where(F.col("n") <= all_pairs).select(*key, "day", "value", F.row_number().over(in_order(key)).alias("i"))
    a, b = short.alias("a"), short.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]) & (F.col("a.i") < F.col("b.i"))
    slope = (F.col("b.value") - F.col("a.value")) / F.nullif(F.col("b.day") - F.col("a.day"), F.lit(0))
    pairs = a.join(b, on).select(*(F.col(f"a.{k}").alias(k) for k in key), slope.alias("slope")).where("slope is not null")
    medians = pairs.groupBy(*key).agg(F.percentile("slope", 0.5).alias("slope"))
    if not shape.where(F.col("n") > all_pairs).isEmpty():
        medians = medians.unionByName(counted_slopes(points.where(F.col("n") > all_pairs), key))
    return shape.select(*key).join(medians.hint("shuffle_merge"), key, "left").select(*key, F.coalesce("slope", F.lit(0.0)).alias("slope"))


def _slopes_up_to(points: DataFrame, key: list[str]) -> DataFrame:
    """points(key.., n, last, day, value, guess) -> (key.., guess, c): pairs of different days whose slope is at most the guess.

    A pair has at most that slope where the later point's rest (value - guess * day) is at most the earlier's. At the
    highest binary digit in which two days differ the earlier has a 0 and the later a 1, under equal higher digits: so the
    pairs of each digit are a running count of ones in the order of rest, and no pair is made. A running count goes over
    ranges of rest, of some RUN points each, whose sums are laid end to end; so no task holds a long series."""
    digit = F.array(*(F.struct(F.lit(k).alias("bit"), F.shiftright("day", k + 1).alias("high"), F.shiftright("day", k).bitwiseAND(F.lit(1)).alias("late")) for k in range(DAY_BITS)))
    rest = points.withColumn("rest", F.col("value") - F.col("guess") * F.col("day"))
    ends = F.percentile_approx("rest", [0.01, 0.99], 1000)  # a few far rests don't widen the ranges of all others
    reach = rest.groupBy(*key, "guess").agg(ends.alias("e")).select(*key, "guess", F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))
    placed = rest.join(reach.hint("shuffle_merge"), [*key, "guess"])
    parts = F.ceil(F.col("n") / RUN)
    part = F.coalesce(F.least(F.floor(F.greatest(F.lit(0.0), F.col("rest") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * parts), parts - 1), F.lit(0))
    used = F.filter(digit, lambda x: F.pow(F.lit(2.0), x["bit"]) <= F.col("last"))
    each = placed.select(*key, "guess", "rest", part.alias("part"), F.explode(used).alias("x")).select(*key, "guess", "rest", "part", "x.*")
    cell = [*key, "guess", "bit", "high"]
    sums = each.groupBy(*cell, "part").agg(F.sum("late").alias("late"))
    earlier = F.coalesce(F.sum("late").over(Window.partitionBy(*cell).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*cell, "part", earlier.alias("earlier"))
    inner = Window.partitionBy(*cell, "part").orderBy("rest", F.desc("late")).rowsBetween(Window.unboundedPreceding, 0)  # equal rests are pairs: the later day first
    counted = each.withColumn("inner", F.sum("late").over(inner)).where("late = 0").join(sums.hint("shuffle_merge"), [*cell, "part"])
    return counted.groupBy(*key, "guess").agg(F.sum(F.col("inner") + F.col("earlier")).alias("c"))


def counted_slopes(points: DataFrame, key: list[str]) -> DataFrame:
    """The median slope of each series of points(key.., n, day, value), for series of any length: the two middle slopes
    (one, if their number is odd) are enclosed ever more closely, counting the slopes up to GUESSES guesses for all series in a step."""
    pts = points.where("value is not null").select(*key, "n", F.col("day").cast("long").alias("day"), "value")
    pts = written(pts, "slopes")
    days = pts.groupBy(*key, "day").agg(F.count("*").alias("c"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    size = days.groupBy(*key).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("ties"), F.max("day").alias("last"), (F.max("hi") - F.min("lo")).alias("spread"))
    pairs = ((F.col("m") * F.col("m") - F.col("ties")) / 2).cast("long")
    size = size.withColumn("pairs", pairs).where("pairs > 0")
    middle = F.array_distinct(F.array(F.floor((F.col("pairs") + 1) / 2), F.floor(F.col("pairs") / 2) + 1))
    edge = F.col("spread") * (1 + 1e-9) + 1e-300
    state = written(size.select(*key, "last", "spread", F.explode(middle).alias("want"), (-edge).alias("low"), edge.alias("high")), "slopes")
    moves = F.col("high") - F.col("low") > F.lit(CLOSE) * F.col("spread")
    while not (open_ := state.where(moves)).isEmpty():
        between = F.transform(F.sequence(F.lit(1), F.lit(GUESSES)), lambda g: F.col("low") + (F.col("high") - F.col("low")) * g / (GUESSES + 1))
        guesses = written(open_.select(*key, "last", "want", F.explode(between).alias("guess")), "slopes")
        asked = guesses.select(*key, "last", "guess").distinct()
        counts = _slopes_up_to(pts.join(asked.hint("shuffle_merge"), key), key)
        met = guesses.join(counts.hint("shuffle_merge"), [*key, "guess"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
        new = met.groupBy(*key, "want").agg(F.max(F.when(F.col("c") < F.col("want"), F.col("guess"))).alias("_low"), F.min(F.when(F.col("c") >= F.col("want"), F.col("guess"))).alias("_high"))
        state = written(state.join(new.hint("shuffle_merge"), [*key, "want"], "left")
                        .select(*key, "last", "spread", "want", F.coalesce("_low", "low").alias("low"), F.coalesce("_high", "high").alias("high")), "slopes")
    return state.groupBy(*key).agg(F.avg((F.col("low") + F.col("high")) / 2).alias("slope"))


#: What a row of bounds may say of a test.
BOUNDS = {"per_day_high": "double", "rate_low": "double", "rate_high": "double", "rate_unit": "string", "low": "double", "high": "double"}


def summary(df: DataFrame, bounds: DataFrame | None = None, key=SERIES, **also: Column) -> DataFrame:
    """B1-B4, B11 and the last point of each series together: key, n, context, slope, trend, rate, rate_status, value and ts of the last point, the
    columns of BOUNDS that bounds(test, ..) gives (null for the others), and the aggregates of also. One grouped pass over the steps of the series; only the slopes are joined."""
    at = F.struct("ts", "ord")
    one = steps(df, key).groupBy(*key).agg(
        context_label().alias("context"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), day_span(F.max("ts"), F.min("ts")).alias("d"), F.bool_and(F.col("step") > 0).alias("rising"),
        F.bool_and(F.col("step") < 0).alias("falling"), F.min_by("value", at).alias("v0"), F.max_by(F.struct("value", "ts"), at).alias("p"), *(c.alias(k) for k, c in also.items()))
    s = one.join(theil_sen(df, key), list(key)).withColumn("v1", F.col("p.value"))
    s = s.join(sized(bounds), "test", "left") if bounds is not None else s
    s = s.withColumns({c: F.lit(None).cast(t) for c, t in BOUNDS.items() if c not in s.columns})
    s = with_rate(s.withColumn("trend", trend_label()))
    return s.select(*key, "n", "context", "slope", "trend", "rate", "rate_status", F.col("p.value").alias("value"), F.col("p.ts").alias("ts"), *BOUNDS, *also)


def trend_label() -> Column:
    """No Trend, Up, Down, Stable or Fluctuating, from n, rising, falling, slope, lo, hi, d (days) and per_day_high."""
    spread, mid = F.col("hi") - F.col("lo"), (F.col("hi") + F.col("lo")) / 2
    limit = (F.when(F.coalesce("per_day_high", F.lit(0.0)) != 0, F.col("per_day_high")).when(spread == 0, 0.0)
             .otherwise(0.2 * spread / F.greatest(F.lit(1), F.col("d"))))
    near = F.coalesce(spread / F.nullif(mid, F.lit(0.0)) < 0.05, F.lit(False))
    return (F.when(F.col("n") < 2, "No Trend").when(F.col("rising"), "Up").when(F.col("falling"), "Down")
            .when(F.col("slope") > limit, "Up").when(F.col("slope") < -limit, "Down").when(near, "Stable").otherwise("Fluctuating"))


def trend(df: DataFrame, bounds: DataFrame | None = None, key=SERIES) -> DataFrame:
    """B4. bounds(test, per_day_high) may give the slope's threshold."""
    return summary(df, bounds, key).select(*key, "n", "slope", "trend")


def status(value: Column, low: Column, high: Column) -> Column:
    """Low, Normal or High with inclusive bounds; Unknown without any bound."""
    return (F.when(low.isNull() & high.isNull(), "Unknown").when(value < low, "Low").when(value > high, "High").otherwise("Normal"))


def latest(df: DataFrame, key=SERIES, extra: tuple[str, ...] = ()) -> DataFrame:
    """The last point of each series: value and ts (and extra columns of that row)."""
    got = df.groupBy(*key).agg(F.max_by(F.struct("value", "ts", *extra), F.struct("ts", "ord")).alias("p"))
    return got.select(*key, *(F.col(f"p.{c}").alias(c) for c in ("value", "ts", *extra)))


def latest_status(df: DataFrame, bounds: DataFrame, key=SERIES) -> DataFrame:
    """bounds(test, low, high) win over the row's own low and high wherever a test has a row there."""
    p = latest(df, key, ("low", "high")).join(sized(bounds.select("test", F.col("low").alias("m_low"), F.col("high").alias("m_high"), F.lit(True).alias("known"))), "test", "left")
    pick = lambda c: F.when(F.col("known"), F.col(f"m_{c}")).otherwise(F.col(c))
    return p.select(*key, "value", status(F.col("value"), pick("low"), pick("high")).alias("status"))


def critical_bounds(dims: DataFrame) -> DataFrame:
    """Adds critical_low and critical_high, inferred from two aggregates agg_low and agg_high
    by the side of the normal range (low, high) on which each lies; of two on one side the one
    closer to normal counts. Aggregates on neither side: two are (min, max), one is the upper bound if the normal range has an upper side."""
    a, b, lo, hi = (F.col(c) for c in ("agg_low", "agg_high", "low", "high"))
    above = lambda x: F.coalesce(x > hi, F.lit(False))
    under = lambda x: F.coalesce(x < lo, F.lit(False)) & ~above(x)
    low = F.greatest(F.when(under(a), a), F.when(under(b), b))
    high = F.least(F.when(above(a), a), F.when(above(b), b))
    neither = low.isNull() & high.isNull()
    both, one = a.isNotNull() & b.isNotNull(), F.coalesce(a, b)
    return dims.withColumns({
        "critical_low": F.when(~neither, low).when(both, F.least(a, b)).when(hi.isNull(), one),
        "critical_high": F.when(~neither, high).when(both, F.greatest(a, b)).when(hi.isNotNull(), one)})


def first_breach(df: DataFrame, key=SERIES) -> DataFrame:
    """The first point beyond critical_low / critical_high (strict), low tested before high."""
    kind = F.when(F.col("value") < F.col("critical_low"), "Low").when(F.col("value") > F.col("critical_high"), "High")
    hit = df.withColumn("kind", kind).where("kind is not null")
    return hit.groupBy(*key).agg(F.min_by(F.struct("kind", "ts"), F.struct("ts", "ord")).alias("b")).select(*key, F.col("b.kind").alias("kind"), F.col("b.ts").alias("at"))


def rule_breach(df: DataFrame, rules: DataFrame, key=SERIES) -> DataFrame:
    """The first (point, rule) whose absolute bound is passed. rules(test, rule_no, comp, low,
    high, unit, upper_normal): rules in percent, points or symptomatic don't apply; a bound in
    multiples of the upper normal limit is scaled by it."""
    unit = F.lower(F.coalesce("unit", F.lit("")))
    used = rules.where(~F.rlike(unit, F.lit("%|points|percentage|percent|symptomatic")))
    scale = F.when(F.rlike(unit, F.lit("uln|×")), F.col("upper_normal")).otherwise(F.lit(1.0))
    kind = (F.when(F.col("comp").isin(">", ">=") & (F.col("value") > F.col("r_low") * scale), "High")
            .when(F.col("comp").isin("<", "<=") & (F.col("value") < F.col("r_high") * scale), "Low"))
    r = used.select("test", "rule_no", "comp", F.col("low").alias("r_low"), F.col("high").alias("r_high"), "unit", "upper_normal")
    hit = df.join(sized(r), "test").withColumn("kind", kind).where("kind is not null")
    return hit.groupBy(*key).agg(F.min_by(F.struct("kind", "ts"), F.struct("ts", "ord", "rule_no")).alias("b")).select(*key, F.col("b.kind").alias("kind"), F.col("b.ts").alias("at"))


def rate_breach(df: DataFrame, rules: DataFrame, key=SERIES) -> DataFrame:
    """The first (pair, rule) of successive points whose change per day, in percent or
    absolute by the rule's unit, reaches the rule's per_day_low; its sign says High or Low, its date is the later point's."""
    days = F.greatest(F.lit(1), day_span(F.col("ts"), F.col("prev_ts")))
    per_day = F.col("step") / days
    percent = F.coalesce(100 * F.col("step") / F.nullif(F.col("prev_value"), F.lit(0.0)) / days, F.lit(0.0))
    unit = F.trim(F.coalesce("unit", F.lit("")))
    rate = F.when(unit == "%", percent).when((unit != "") & (F.lower(unit) != "persistent"), per_day)
    r = rules.where("per_day_low is not null").select("test", "rule_no", "unit", "per_day_low")
    hit = steps(df, key).where("prev_ts is not null").join(sized(r), "test").withColumn("rate", rate).where(F.abs("rate") >= F.col("per_day_low"))
    first = F.min_by(F.struct(F.when(F.col("rate") > 0, "High").otherwise("Low").alias("kind"), "ts"), F.struct("pair_no", "rule_no"))
    return hit.groupBy(*key).agg(first.alias("b")).select(*key, F.col("b.kind").alias("kind"), F.col("b.ts").alias("at"))


def critical_status(df: DataFrame, rules: DataFrame, key=SERIES) -> DataFrame:
    """The breach of B7, else of B8, else of B9, for every series that has one."""
    found = [f.select(*key, F.struct(F.lit(k).alias("rank"), "kind", "at").alias("b")) for k, f in enumerate((first_breach(df, key), rule_breach(df, rules, key), rate_breach(df, rules, key)))]
    best = reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.min("b").alias("b"))
    return best.select(*key, F.col("b.kind").alias("kind"), F.col("b.at").alias("at"))


def with_rate(m: DataFrame) -> DataFrame:
    """B11 on rows with n, v0, v1, d (days), rate_low, rate_high and rate_unit: adds rate and rate_status."""
    change = (F.col("v1") - F.col("v0")) / F.greatest(F.lit(1), F.col("d"))
    rate = F.when(F.rlike(F.coalesce("rate_unit", F.lit("")), F.lit("%|percent")), 100 * change / F.nullif(F.abs("v0"), F.lit(0.0))).otherwise(change)
    m = m.withColumn("rate", F.when(F.col("n") > 1, rate))
    s = F.when(F.col("rate").isNotNull() & (F.col("rate_low").isNotNull() | F.col("rate_high").isNotNull()), status(F.abs("rate"), F.col("rate_low"), F.col("rate_high")))
    return m.withColumn("rate_status", s)


def average_rate(df: DataFrame, bounds: DataFrame, key=SERIES) -> DataFrame:
    """Change per day from the first to the last point and its status. bounds(test,
    rate_low, rate_high, rate_unit): in percent the change is relative to the first value, null if that is 0. One point has no rate."""
    order = F.struct("ts", "ord")
    ends = df.groupBy(*key).agg(F.count("*").alias("n"), F.min_by("value", order).alias("v0"), F.max_by("value", order).alias("v1"), day_span(F.max("ts"), F.min("ts")).alias("d"))
    return with_rate(ends.join(sized(bounds), "test", "left")).select(*key, "rate", "rate_status")


#: Ratio, numerator, denominator, and what the numerator is taken from the denominator (or null).
RATIOS = (("BUN/Creatinine", "BUN", "Creatinine", None), ("Albumin/Globulin", "Albumin", "Total Protein", "Albumin"), ("Total/HDL Cholesterol", "Total Cholesterol", "HDL", None))


def ratios(df: DataFrame, definitions=RATIOS, entity: str = "entity") -> DataFrame:
    """Ratios of the latest values per entity, dated by the numerator. A denominator less a
    third test must be positive, any other must not be 0."""
    at = F.struct("ts", "ord")
    of = lambda t, c: F.max_by(c, at).alias("x") if t is None else F.max_by(F.when(F.col("test") == t, F.col(c)), F.when(F.col("test") == t, at))
    aggs, out = [], []
    for k, (_, top, bottom, less) in enumerate(definitions):
        aggs += [of(top, "value").alias(f"t{k}"), of(top, "ts").alias(f"d{k}"), of(bottom, "value").alias(f"b{k}"), (of(less, "value") if less else F.lit(None).cast("double")).alias(f"l{k}")]
    wide = df.groupBy(entity).agg(*aggs)
    for k, (name, _, _, less) in enumerate(definitions):
        base = F.col(f"b{k}") - F.col(f"l{k}") if less else F.col(f"b{k}")
        out.append(wide.select(entity, F.lit(name).alias("ratio"), (F.col(f"t{k}") / F.when(base > 0 if less else base != 0, base)).alias("value"), F.col(f"d{k}").alias("at")).where("value is not null"))
    return reduce(DataFrame.unionByName, out)


def report(df: DataFrame, bounds: DataFrame, key=SERIES) -> DataFrame:
    """One row per series: its points in order, context, trend, status, rate and bounds."""
    points = F.array_sort(F.collect_list(F.struct("ts", "ord", "value")))
    s = summary(df, bounds.select("test", *(c for c in BOUNDS if c in bounds.columns)), key, points=points)
    return s.select(*key, "points", "context", "n", "slope", "trend", "value", status(F.col("value"), F.col("low"), F.col("high")).alias("status"), "rate", "rate_status", "low", "high")
