"""Queries T1-T17 and D1-D10 over the events series."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmed.operators import fuzzy as D
from quillmed.operators import trend as T
from quillmed.operators.scan import LONG, bound

from .base import SERIES, query, rows, series

LABEL = "CASE WHEN value < 20 THEN 'LOW' WHEN value > 80 THEN 'HIGH' ELSE 'NORMAL' END"
W = "PARTITION BY entity, test ORDER BY ts, ord"
TERMS = 54  # as T2 says: later terms weigh less than 2 ** -53
EWMA = (f"SELECT *, (" + " + ".join(f"coalesce(lag(value, {i}) OVER w, 0) * {0.5 ** i!r}" for i in range(TERMS)) + ") / (" +
        " + ".join(f"(CASE WHEN lag(value, {i}) OVER w IS NULL THEN 0 ELSE {0.5 ** i!r} END)" for i in range(TERMS)) + f") AS ewma FROM ({SERIES}) WINDOW w AS ({W})")
DAY = "date_diff('day', DATE '1970-01-01', ts::DATE)::DOUBLE"
SLOPE = f"""SELECT *, CASE WHEN slope IS NULL THEN 'UNKNOWN' WHEN abs(round(slope, 9)) < 0.1 THEN 'STABLE' WHEN round(slope, 9) >= 0.1 THEN 'UP' ELSE 'DOWN' END AS slope_label FROM (
 SELECT *, CASE WHEN count(value) OVER w >= 3 AND max(d) OVER w <> min(d) OVER w THEN regr_slope(value, d) OVER w END AS slope FROM (SELECT *, {DAY} AS d FROM ({EWMA})) WINDOW w AS ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""
PROFILE = f"""SELECT p.*, value - ewma AS deviation, spike, CASE WHEN value - ewma - spike > 1e-9 * abs(value) THEN 'SHARP_RISE' WHEN ewma - value - spike > 1e-9 * abs(value) THEN 'SHARP_DROP' ELSE {LABEL} END AS status FROM ({SLOPE}) p JOIN (
 SELECT entity, test, least(108.0, 1.5 * (quantile_cont(value - ewma, 0.75) - quantile_cont(value - ewma, 0.25))) AS spike FROM ({EWMA}) GROUP BY entity, test) q USING (entity, test)"""


def profile(spark, sf_dir):
    return T.profile(series(spark, sf_dir), 20.0, 80.0)


def _long(spark, sf_dir):
    """Whether any series is long, seen from the table, not from what is made of it."""
    return bound(series(spark, sf_dir), ("entity", "test"))


@query("t01_range_label", f"SELECT ord, {LABEL} AS label FROM ({SERIES})")
def t01(spark, sf_dir):
    return series(spark, sf_dir).select("ord", T.range_label(F.col("value"), 20.0, 80.0).alias("label"))


@query("t02_ewma", f"SELECT ord, round(ewma, 6) AS ewma, round(value - ewma, 6) AS deviation FROM ({EWMA})")
def t02(spark, sf_dir):
    p = T.with_ewma(series(spark, sf_dir))
    return p.select("ord", F.round("ewma", 6).alias("ewma"), F.round(F.col("value") - F.col("ewma"), 6).alias("deviation"))


@query("t03_spike_limits", f"SELECT DISTINCT entity, test, round(spike, 6) AS spike FROM ({PROFILE})")
def t03(spark, sf_dir):
    d = T.with_ewma(series(spark, sf_dir)).withColumn("deviation", F.col("value") - F.col("ewma"))
    return T.spike_limits(d, long=_long(spark, sf_dir)).withColumn("spike", F.round("spike", 6))


@query("t04_spike_status", f"SELECT ord, status FROM ({PROFILE})")
def t04(spark, sf_dir):
    return profile(spark, sf_dir).select("ord", "status")


@query("t05_abnormal_events", f"SELECT entity, test, ts, value, status FROM ({PROFILE}) WHERE status <> 'NORMAL'")
def t05(spark, sf_dir):
    return profile(spark, sf_dir).where("status <> 'NORMAL'").select("entity", "test", "ts", "value", "status")


@query("t06_stationarity", f"""
SELECT entity, test, n, round(t, 5) AS t_ratio, t < -2.86 AS stationary FROM (SELECT *, CASE WHEN n >= 5 AND sxx > 0 AND rest > 0 THEN b / sqrt(rest / sxx) END AS t FROM (
 SELECT entity, test, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / nullif(count(*) - 2, 0) AS rest FROM (
 SELECT entity, test, lag(value) OVER w AS x, value - lag(value) OVER w AS y FROM ({SERIES}) WINDOW w AS ({W})) WHERE x IS NOT NULL GROUP BY entity, test))""")
def t06(spark, sf_dir):
    return T.dickey_fuller(series(spark, sf_dir)).withColumn("t_ratio", F.round("t_ratio", 5))


@query("t07_moving_slope", f"SELECT ord, round(slope, 9) AS slope FROM ({SLOPE})")
def t07(spark, sf_dir):
    return T.with_slope(series(spark, sf_dir)).select("ord", F.round("slope", 9).alias("slope"))


@query("t08_slope_label", f"SELECT ord, slope_label FROM ({SLOPE})")
def t08(spark, sf_dir):
    return T.with_slope(series(spark, sf_dir)).select("ord", T.slope_label(F.col("slope")).alias("slope_label"))


#: Rows of one time and id are told apart by value, so that runs don't hang on how a sort leaves repeated rows.
APART = f"(SELECT * REPLACE (row_number() OVER ({W}, value NULLS FIRST) AS ord) FROM ({SERIES}))"
RUNS = f"""SELECT entity, test, run, min(slope_label) AS label, min(ts) AS start, count(*) AS steps, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, count(*) FILTER (WHERE status = 'HIGH') AS high, count(*) FILTER (WHERE status = 'LOW') AS low
 FROM (SELECT *, sum(new) OVER (PARTITION BY entity, test ORDER BY ts, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, coalesce((lag(slope_label) OVER ({W}) <> slope_label)::INTEGER, 1) AS new FROM ({PROFILE.replace(f"({SERIES})", APART)}) WHERE slope_label <> 'UNKNOWN')) GROUP BY entity, test, run"""


def _runs(spark, sf_dir):
    long = _long(spark, sf_dir)
    return T.segments(T.profile(T.told_apart(series(spark, sf_dir), long=long), 20.0, 80.0), long=long)


@query("t09_segments", RUNS)
def t09(spark, sf_dir):
    return _runs(spark, sf_dir).select("entity", "test", "run", "label", "start", "steps", F.array_join("statuses", ",").alias("statuses"), "high", "low")


@query("t10_commentary", f"""
SELECT entity, test, run, concat_ws(' ', 'From ' || strftime(start, '%Y-%m-%d') || ' ' || label || ' for ' || steps || ' steps.', CASE WHEN label = 'UP' AND statuses LIKE '%SHARP_RISE%' THEN 'Rising with sharp jumps.'
 WHEN label = 'DOWN' AND statuses NOT LIKE '%SHARP_DROP%' THEN 'Steady decline.' WHEN label = 'STABLE' AND high > 0 THEN 'Stable but high.' WHEN label = 'DOWN' AND low > 0 THEN 'Falling to low values.' WHEN label = 'UP' AND high > 0 THEN 'Rising to high values.' END) AS comment FROM ({RUNS})""")
def t10(spark, sf_dir):
    return T.commentary(_runs(spark, sf_dir)).select("entity", "test", "run", "comment")


FLUCT = f"""SELECT *, CASE WHEN sd > 30 THEN 'FLUCTUATING' WHEN sd IS NOT NULL THEN 'STABLE' END AS fluctuation FROM (
 SELECT *, CASE WHEN count(value) OVER w >= 3 THEN stddev_samp(value) OVER w END AS sd FROM ({SLOPE}) WINDOW w AS ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


@query("t11_fluctuation", f"SELECT ord, fluctuation FROM ({FLUCT})")
def t11(spark, sf_dir):
    return T.with_fluctuation(series(spark, sf_dir), 30.0).select("ord", "fluctuation")


@query("t12_recent", f"SELECT ord FROM (SELECT *, max(ts) OVER (PARTITION BY entity, test) AS last FROM ({SERIES})) WHERE ts > last - INTERVAL 7 DAYS")
def t12(spark, sf_dir):
    return T.recent(series(spark, sf_dir), "INTERVAL 7 DAYS").select("ord")


SUMMARY = """SELECT '{name}' AS period, entity, test, count(*) FILTER (WHERE slope_label = 'UP') AS up, count(*) FILTER (WHERE slope_label = 'DOWN') AS down, count(*) FILTER (WHERE slope_label = 'STABLE') AS stable,
 round(100 * avg(CASE WHEN fluctuation = 'FLUCTUATING' THEN 1.0 ELSE 0.0 END), 6) AS rate, CASE WHEN 100 * avg(CASE WHEN fluctuation = 'FLUCTUATING' THEN 1.0 ELSE 0.0 END) > 50 THEN 'significant' WHEN 100 * avg(CASE WHEN fluctuation = 'FLUCTUATING' THEN 1.0 ELSE 0.0 END) > 20 THEN 'moderate' ELSE 'stable' END AS wording FROM ({src}) GROUP BY entity, test"""


@query("t13_period_summary", SUMMARY.format(name="all", src=FLUCT) + " UNION ALL " + SUMMARY.format(name="recent", src=f"SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY entity, test) AS last FROM ({FLUCT})) WHERE ts > last - INTERVAL 7 DAYS"))
def t13(spark, sf_dir):
    f = T.with_slope(T.with_fluctuation(series(spark, sf_dir), 30.0, long=(n := _long(spark, sf_dir))), long=n).withColumn("slope_label", T.slope_label(F.col("slope")))
    both = T.period_summary(f, "all").unionByName(T.period_summary(T.recent(f, "INTERVAL 7 DAYS"), "recent"))
    return both.withColumn("rate", F.round("rate", 6))


BINS = f"""SELECT s.entity, s.test, s.bin, s.start + to_hours((s.bin * 48)::INTEGER) AS ts, m.value FROM (
 SELECT entity, test, start, unnest(range(0, floor((epoch_us(last) - epoch_us(start)) / (48 * 3600 * 1000000.0))::BIGINT + 1)) AS bin FROM (SELECT entity, test, date_trunc('day', min(ts))::TIMESTAMP AS start, max(ts) AS last FROM ({SERIES}) GROUP BY entity, test)) s
 LEFT JOIN (SELECT e.entity, e.test, floor((epoch_us(ts) - epoch_us(start)) / (48 * 3600 * 1000000.0))::BIGINT AS bin, avg(value) AS value FROM ({SERIES}) e JOIN (SELECT entity, test, date_trunc('day', min(ts))::TIMESTAMP AS start FROM ({SERIES}) GROUP BY entity, test) f ON e.entity = f.entity AND e.test = f.test GROUP BY ALL) m
 ON s.entity = m.entity AND s.test = m.test AND s.bin = m.bin"""


@query("t14_resample", f"SELECT entity, test, bin, ts, round(value, 6) AS value FROM ({BINS})")
def t14(spark, sf_dir):
    return T.resample(series(spark, sf_dir), "48 hours").withColumn("value", F.round("value", 6))


KNOWN = f"""SELECT *, last_value(CASE WHEN value IS NOT NULL THEN bin END IGNORE NULLS) OVER (PARTITION BY entity, test ORDER BY bin ROWS UNBOUNDED PRECEDING) AS pb, last_value(value IGNORE NULLS) OVER (PARTITION BY entity, test ORDER BY bin ROWS UNBOUNDED PRECEDING) AS pv,
 first_value(CASE WHEN value IS NOT NULL THEN bin END IGNORE NULLS) OVER (PARTITION BY entity, test ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nb, first_value(value IGNORE NULLS) OVER (PARTITION BY entity, test ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM ({{src}})"""
HOLES = f"SELECT entity, test, bin, CASE WHEN bin % 4 <> 0 THEN value END AS value FROM ({BINS})"


def _holes(spark, sf_dir):
    return T.resample(series(spark, sf_dir), "48 hours").withColumn("value", F.when(F.col("bin") % 4 != 0, F.col("value"))).drop("ts")


def _bins(spark, sf_dir):
    """Whether any series has many bins: seen from its first and last time."""
    days = series(spark, sf_dir).groupBy("entity", "test").agg(F.datediff(F.max("ts"), F.min("ts")).alias("n"))
    return None if days.where(F.col("n") / 2 > LONG - 2).isEmpty() else LONG


@query("t15_interpolate", f"SELECT entity, test, bin, round(coalesce(value, CASE WHEN pb IS NOT NULL THEN coalesce(pv + (nv - pv) * (bin - pb) / nullif(nb - pb, 0), pv) END), 6) AS value FROM ({KNOWN.format(src=HOLES)})")
def t15(spark, sf_dir):
    return T.interpolate(_holes(spark, sf_dir), long=_bins(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("t16_fill", f"SELECT entity, test, bin, round(coalesce(pv, nv), 6) AS value FROM ({KNOWN.format(src=HOLES)})")
def t16(spark, sf_dir):
    return T.fill(_holes(spark, sf_dir), long=_bins(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("t17_keep_mapped", f"""
SELECT entity, name AS test, bin, round(value, 6) AS value FROM (SELECT h.*, name, count(value) OVER (PARTITION BY entity, test) AS known FROM ({HOLES}) h JOIN (VALUES ('click', 'Clicks'), ('error', 'Errors')) v(t, name) ON test = t) WHERE known > 0""")
def t17(spark, sf_dir):
    m = rows(spark, "test string, name string", ("click", "Clicks"), ("error", "Errors"))
    return T.keep_mapped(_holes(spark, sf_dir), m).select("entity", "test", "bin", F.round("value", 6).alias("value"))


HELD = f"SELECT *, row_number() OVER (PARTITION BY entity, test ORDER BY ts DESC, ord DESC) AS back FROM ({SERIES})"
TRAIN = f"SELECT * FROM ({HELD}) WHERE back > 1"
UNI = f"SELECT entity, test, min(value) - 0.1 * (max(value) - min(value)) AS umin, max(value) + 0.1 * (max(value) - min(value)) AS umax, avg(value) AS mean, stddev_samp(value) AS sd, max(value) - min(value) AS spread, count(*) AS n FROM ({TRAIN}) GROUP BY entity, test"
EDGES = f"SELECT *, [umin, mean - 2 * z, mean - z, mean - 0.5 * z, mean + 0.5 * z, mean + z, mean + 2 * z, umax] AS e FROM (SELECT *, coalesce(sd, 0) AS z FROM ({UNI}))"
SETS = f"SELECT entity, test, idx, a, (a + c) / 2 AS b, c FROM (SELECT entity, test, idx, e[lo] AS a, e[hi] AS c FROM ({EDGES}), (VALUES (1, 1, 2), (2, 1, 3), (3, 2, 4), (4, 3, 5), (5, 4, 6), (6, 5, 7), (7, 6, 8)) v(idx, lo, hi))"
STATES = f"""SELECT entity, test, ts, ord, value, idx AS state FROM (SELECT t.entity, t.test, ts, ord, value, idx, round(coalesce(CASE WHEN b <> a AND c <> b THEN greatest(0, least((value - a) / (b - a), (c - value) / (c - b))) END, 0), 9) AS m FROM ({TRAIN}) t JOIN ({SETS}) s ON t.entity = s.entity AND t.test = s.test)
 QUALIFY row_number() OVER (PARTITION BY entity, test, ord ORDER BY m DESC, idx) = 1"""
BASE = f"SELECT entity, test, state, nxt AS next, count(*) AS times FROM (SELECT *, lead(state) OVER ({W}) AS nxt FROM ({STATES})) WHERE nxt IS NOT NULL GROUP BY ALL"
FORECAST = f"""SELECT n.entity, n.test, n.state, known, actual, CASE WHEN spread = 0 THEN known ELSE guess END AS forecast, sd FROM (SELECT entity, test, max_by(state, ts) AS state, max_by(value, ts) AS known FROM ({STATES}) GROUP BY entity, test) n
 LEFT JOIN (SELECT r.entity, r.test, r.state, sum(times * b) / sum(times) AS guess FROM ({BASE}) r JOIN ({SETS}) s ON r.entity = s.entity AND r.test = s.test AND r.next = s.idx GROUP BY ALL) g ON n.entity = g.entity AND n.test = g.test AND n.state = g.state
 JOIN (SELECT entity, test, sd, spread FROM ({UNI})) u ON n.entity = u.entity AND n.test = u.test JOIN (SELECT entity, test, value AS actual FROM ({HELD}) WHERE back = 1) a ON n.entity = a.entity AND n.test = a.test"""


def _train(spark, sf_dir):
    return D.hold_out(series(spark, sf_dir)).where("back > 1")


@query("d01_hold_out", f"SELECT entity, test, max(value) FILTER (WHERE back = 1) AS actual, max(value) FILTER (WHERE back = 2) AS known FROM ({HELD}) GROUP BY entity, test")
def d01(spark, sf_dir):
    h = D.hold_out(series(spark, sf_dir))
    pick = lambda k: F.max(F.when(F.col("back") == k, F.col("value")))
    return h.groupBy("entity", "test").agg(pick(1).alias("actual"), pick(2).alias("known"))


@query("d02_universe", f"SELECT entity, test, round(umin, 6) AS umin, round(umax, 6) AS umax FROM ({UNI})")
def d02(spark, sf_dir):
    return D.universe(_train(spark, sf_dir)).select("entity", "test", F.round("umin", 6).alias("umin"), F.round("umax", 6).alias("umax"))


@query("d03_cut_points", f"SELECT entity, test, i::INTEGER AS i, round(e[i + 2], 6) AS cut FROM ({EDGES}), range(6) r(i)")
def d03(spark, sf_dir):
    return D.universe(_train(spark, sf_dir)).select("entity", "test", F.posexplode("cuts").alias("i", "cut")).withColumn("cut", F.round("cut", 6))


@query("d04_fuzzy_sets", f"SELECT entity, test, idx, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM ({SETS})")
def d04(spark, sf_dir):
    return D.fuzzy_sets(D.universe(_train(spark, sf_dir))).select("entity", "test", "idx", *(F.round(x, 6).alias(x) for x in "abc"))


def _states(spark, sf_dir):
    t = _train(spark, sf_dir).select("entity", "test", "ts", "ord", "value")
    return D.fuzzify(t, D.fuzzy_sets(D.universe(t)))


@query("d05_fuzzify", f"SELECT ord, state FROM ({STATES})")
def d05(spark, sf_dir):
    return _states(spark, sf_dir).select("ord", "state")


@query("d06_rule_base", BASE)
def d06(spark, sf_dir):
    return D.rule_base(_states(spark, sf_dir), long=_long(spark, sf_dir))


@query("d07_forecast", f"SELECT entity, test, state, round(forecast, 6) AS forecast FROM ({FORECAST})")
def d07(spark, sf_dir):
    return D.forecast(series(spark, sf_dir)).select("entity", "test", "state", F.round("forecast", 6).alias("forecast"))


@query("d08_direction", f"SELECT entity, test, CASE WHEN forecast > known THEN 'Upward' WHEN forecast < known THEN 'Downward' WHEN forecast IS NOT NULL THEN 'Unchanged' END AS direction FROM ({FORECAST})")
def d08(spark, sf_dir):
    return D.forecast(series(spark, sf_dir)).select("entity", "test", "direction")


@query("d09_abnormal", f"SELECT entity, test, abs(actual - forecast) > 2 * sd AS abnormal FROM ({FORECAST})")
def d09(spark, sf_dir):
    return D.forecast(series(spark, sf_dir)).select("entity", "test", "abnormal")


@query("d10_errors", f"SELECT entity, test, round(abs(actual - forecast), 6) AS abs_error, round(CASE WHEN forecast IS NOT NULL THEN CASE WHEN actual = 0 THEN 'inf'::DOUBLE ELSE 100 * abs(actual - forecast) / abs(actual) END END, 5) AS ape FROM ({FORECAST})")
def d10(spark, sf_dir):
    return D.forecast(series(spark, sf_dir)).select("entity", "test", F.round("abs_error", 6).alias("abs_error"), F.round("ape", 5).alias("ape"))
