"""Queries B1-B13 and the flagship: findings per (user, event type) series."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmed.operators import findings as B

from .base import SERIES, query, rows, series
from .lab_plans import REFS_SQL, refs

DAYS = "floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0)"
SPAN = DAYS.format(a="max(ts)", b="min(ts)")
CONTEXT = f"""SELECT entity, test, CASE count(*) WHEN 1 THEN 'Current' ELSE 'Last ' || greatest(1, round_even({SPAN} / 30, 0)::INTEGER) || ' Months' END AS context
FROM ({SERIES}) GROUP BY entity, test"""
STEPS = f"""SELECT *, lag(ts) OVER w AS prev_ts, lag(value) OVER w AS prev_value, row_number() OVER w - 1 AS pair_no, value - lag(value) OVER w AS step
FROM ({SERIES}) WINDOW w AS (PARTITION BY entity, test ORDER BY ts, ord)"""
MONO = f"SELECT entity, test, bool_and(step > 0) AS rising, bool_and(step < 0) AS falling FROM ({STEPS}) GROUP BY entity, test"
POINTS = f"""SELECT entity, test, value, {DAYS.format(a='ts', b='min(ts) OVER (PARTITION BY entity, test)')} AS day FROM ({SERIES})"""
SLOPES = f"""SELECT s.entity, s.test, coalesce(m.slope, 0.0)::DOUBLE AS slope FROM (SELECT DISTINCT entity, test FROM ({SERIES})) s LEFT JOIN (
  SELECT a.entity, a.test, quantile_cont((b.value - a.value) / (b.day - a.day), 0.5) AS slope
  FROM ({POINTS}) a JOIN ({POINTS}) b ON a.entity = b.entity AND a.test = b.test AND a.day < b.day GROUP BY a.entity, a.test) m ON s.entity = m.entity AND s.test = m.test"""


def trend_sql(per_day: str = "NULL::DOUBLE") -> str:
    return f"""SELECT entity, test, n, slope, CASE WHEN n < 2 THEN 'No Trend' WHEN rising THEN 'Up' WHEN falling THEN 'Down' WHEN slope > lim THEN 'Up'
 WHEN slope < -lim THEN 'Down' WHEN (hi + lo) <> 0 AND (hi - lo) / ((hi + lo) / 2) < 0.05 THEN 'Stable' ELSE 'Fluctuating' END AS trend FROM (
 SELECT *, CASE WHEN coalesce({per_day}, 0) <> 0 THEN {per_day} WHEN hi = lo THEN 0 ELSE 0.2 * (hi - lo) / greatest(1, days) END AS lim FROM
 (SELECT entity, test, count(*) AS n, min(value) AS lo, max(value) AS hi, {SPAN} AS days FROM ({SERIES}) GROUP BY entity, test) g
 JOIN ({MONO}) m USING (entity, test) JOIN ({SLOPES}) s USING (entity, test))"""


LAST = f"SELECT entity, test, max_by(value, ts) AS value FROM ({SERIES}) GROUP BY entity, test"
STATUS = "CASE WHEN {lo} IS NULL AND {hi} IS NULL THEN 'Unknown' WHEN {v} < {lo} THEN 'Low' WHEN {v} > {hi} THEN 'High' ELSE 'Normal' END"
RATE = f"""SELECT entity, test, CASE WHEN count(*) > 1 THEN (max_by(value, ts) - min_by(value, ts)) / greatest(1, {SPAN}) END AS rate, abs(min_by(value, ts)) AS v0 FROM ({SERIES}) GROUP BY entity, test"""
BOTH = f"(SELECT test, low::DOUBLE AS low, high::DOUBLE AS high FROM {REFS_SQL} WHERE ref_ord = 1)"
RANGE = "CASE WHEN value < 20 THEN 'LOW' WHEN value > 80 THEN 'HIGH' ELSE 'NORMAL' END"


def bounds(spark):
    return refs(spark).where("ref_ord = 1").select("test", "low", "high")


@query("b01_context", CONTEXT)
def b01(spark, sf_dir):
    return B.context(series(spark, sf_dir))


@query("b02_monotonic", MONO)
def b02(spark, sf_dir):
    return B.monotonic(series(spark, sf_dir))


@query("b03_theil_sen", f"SELECT entity, test, round(slope, 6) AS slope FROM ({SLOPES})")
def b03(spark, sf_dir):
    return B.theil_sen(series(spark, sf_dir)).withColumn("slope", F.round("slope", 6))


@query("b04_trend", f"SELECT entity, test, n, round(slope, 6) AS slope, trend FROM ({trend_sql()})")
def b04(spark, sf_dir):
    return B.trend(series(spark, sf_dir)).withColumn("slope", F.round("slope", 6))


@query("b05_latest_status", f"""
SELECT l.entity, l.test, l.value, {STATUS.format(v='l.value', lo='CASE WHEN r.test IS NOT NULL THEN r.low ELSE 30 END', hi='CASE WHEN r.test IS NOT NULL THEN r.high ELSE 70 END')} AS status
FROM ({LAST}) l LEFT JOIN {BOTH} r ON l.test = r.test""")
def b05(spark, sf_dir):
    own = series(spark, sf_dir).withColumn("low", F.lit(30.0)).withColumn("high", F.lit(70.0))
    return B.latest_status(own, bounds(spark))


CRIT = (("click", 10.0, 60.0, 5.0, 90.0), ("view", 5.0, 50.0, 80.0, 70.0), ("error", None, 40.0, 30.0, None), ("purchase", 20.0, None, 15.0, 10.0), ("signup", None, None, 9.0, None))
CRIT_SCHEMA = "test string, low double, high double, agg_low double, agg_high double"


def _nulls(v):
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


CRIT_SQL = "(SELECT column0 AS test, column1::DOUBLE AS low, column2::DOUBLE AS high, column3::DOUBLE AS agg_low, column4::DOUBLE AS agg_high FROM (VALUES " + ", ".join("(" + ", ".join(map(_nulls, r)) + ")" for r in CRIT) + ") AS t(column0, column1, column2, column3, column4))"
CRIT_BOUNDS = f"""SELECT test, low, high, CASE WHEN cl IS NOT NULL OR ch IS NOT NULL THEN cl WHEN agg_low IS NOT NULL AND agg_high IS NOT NULL THEN least(agg_low, agg_high) WHEN high IS NULL THEN coalesce(agg_low, agg_high) END AS critical_low,
 CASE WHEN cl IS NOT NULL OR ch IS NOT NULL THEN ch WHEN agg_low IS NOT NULL AND agg_high IS NOT NULL THEN greatest(agg_low, agg_high) WHEN high IS NOT NULL THEN coalesce(agg_low, agg_high) END AS critical_high FROM (
 SELECT *, greatest(CASE WHEN agg_low < low AND NOT coalesce(agg_low > high, false) THEN agg_low END, CASE WHEN agg_high < low AND NOT coalesce(agg_high > high, false) THEN agg_high END) AS cl,
  least(CASE WHEN agg_low > high THEN agg_low END, CASE WHEN agg_high > high THEN agg_high END) AS ch FROM {CRIT_SQL})"""


def _crit(spark):
    return B.critical_bounds(rows(spark, CRIT_SCHEMA, *CRIT)).select("test", "low", "high", "critical_low", "critical_high")


@query("b06_critical_bounds", f"SELECT e.event_type AS test, c.critical_low, c.critical_high, count(*) AS n FROM events e JOIN ({CRIT_BOUNDS}) c ON e.event_type = c.test GROUP BY ALL")
def b06(spark, sf_dir):
    c = _crit(spark)
    return series(spark, sf_dir).join(F.broadcast(c), "test").groupBy("test", "critical_low", "critical_high").agg(F.count("*").alias("n"))


B7 = f"""SELECT entity, test, min_by(kind, ts) AS kind, min(ts) AS at FROM (SELECT s.entity, s.test, s.ts, CASE WHEN value < critical_low THEN 'Low' WHEN value > critical_high THEN 'High' END AS kind
 FROM ({SERIES}) s JOIN ({CRIT_BOUNDS}) c ON s.test = c.test) WHERE kind IS NOT NULL GROUP BY entity, test"""


def _critical(spark, sf_dir):
    return series(spark, sf_dir).join(F.broadcast(_crit(spark).select("test", "critical_low", "critical_high")), "test")


@query("b07_first_breach", B7)
def b07(spark, sf_dir):
    return B.first_breach(_critical(spark, sf_dir))


RULES = (("click", 0, ">", 2.0, None, "×ULN", 60.0, None), ("click", 1, ">", 20.0, None, "%", 60.0, 40.0), ("view", 0, "<", None, 3.0, "mg", None, 15.0), ("error", 0, ">=", 60.0, None, "persistent", 40.0, 1.0), ("signup", 0, ">", 150.0, None, "", None, 9.0))
RULES_SQL = "(SELECT c0 AS test, c1 AS rule_no, c2 AS comp, c3::DOUBLE AS low, c4::DOUBLE AS high, c5 AS unit, c6::DOUBLE AS upper_normal, c7::DOUBLE AS per_day_low FROM (VALUES " + ", ".join("(" + ", ".join(map(_nulls, r)) + ")" for r in RULES) + ") t(c0, c1, c2, c3, c4, c5, c6, c7))"


def rules(spark):
    return rows(spark, "test string, rule_no int, comp string, low double, high double, unit string, upper_normal double, per_day_low double", *RULES)


B8 = f"""SELECT entity, test, arg_min(kind, k) AS kind, arg_min(ts, k) AS at FROM (SELECT s.entity, s.test, s.ts, epoch_us(s.ts) * 10 + rule_no AS k,
 CASE WHEN comp IN ('>', '>=') AND value > low * sc THEN 'High' WHEN comp IN ('<', '<=') AND value < high * sc THEN 'Low' END AS kind FROM ({SERIES}) s JOIN (
 SELECT *, CASE WHEN unit LIKE '%ULN%' THEN upper_normal ELSE 1.0 END AS sc FROM {RULES_SQL} WHERE unit NOT LIKE '%!%%' ESCAPE '!') r ON s.test = r.test) WHERE kind IS NOT NULL GROUP BY entity, test"""


@query("b08_rule_breach", B8)
def b08(spark, sf_dir):
    return B.rule_breach(series(spark, sf_dir), rules(spark))


B9 = f"""SELECT entity, test, arg_min(CASE WHEN rate > 0 THEN 'High' ELSE 'Low' END, k) AS kind, arg_min(ts, k) AS at FROM (SELECT s.entity, s.test, s.ts, pair_no * 10 + rule_no AS k, per_day_low,
 CASE WHEN unit = '%' THEN coalesce(100 * step / nullif(prev_value, 0) / d, 0) WHEN unit <> '' AND unit <> 'persistent' THEN step / d END AS rate FROM (
 SELECT *, greatest(1, {DAYS.format(a='ts', b='prev_ts')}) AS d FROM ({STEPS}) WHERE prev_ts IS NOT NULL) s JOIN {RULES_SQL} r ON s.test = r.test) WHERE abs(rate) >= per_day_low GROUP BY entity, test"""


@query("b09_rate_breach", B9)
def b09(spark, sf_dir):
    return B.rate_breach(series(spark, sf_dir), rules(spark))


@query("b10_critical_status", f"""SELECT entity, test, arg_min(kind, r) AS kind, arg_min("at", r) AS at FROM (SELECT *, 0 AS r FROM ({B7}) UNION ALL SELECT *, 1 FROM ({B8}) UNION ALL SELECT *, 2 FROM ({B9})) GROUP BY entity, test""")
def b10(spark, sf_dir):
    return B.critical_status(_critical(spark, sf_dir), rules(spark))


RATES = (("click", 0.5, 5.0, "%"), ("view", 0.1, 2.0, "mg"), ("error", None, 1.0, None))
RATES_SQL = "(SELECT c0 AS test, c1::DOUBLE AS rate_low, c2::DOUBLE AS rate_high, c3 AS rate_unit FROM (VALUES " + ", ".join("(" + ", ".join(map(_nulls, r)) + ")" for r in RATES) + ") t(c0, c1, c2, c3))"
B11 = f"""SELECT entity, test, rate, CASE WHEN rate IS NOT NULL AND (rate_low IS NOT NULL OR rate_high IS NOT NULL) THEN {STATUS.format(v='abs(rate)', lo='rate_low', hi='rate_high')} END AS rate_status FROM (
 SELECT a.entity, a.test, CASE WHEN rate_unit = '%' THEN 100 * rate / nullif(v0, 0) ELSE rate END AS rate, rate_low, rate_high FROM ({RATE}) a LEFT JOIN {RATES_SQL} b ON a.test = b.test)"""


@query("b11_average_rate", f"SELECT entity, test, round(rate, 6) AS rate, rate_status FROM ({B11})")
def b11(spark, sf_dir):
    r = rows(spark, "test string, rate_low double, rate_high double, rate_unit string", *RATES)
    return B.average_rate(series(spark, sf_dir), r).withColumn("rate", F.round("rate", 6))


@query("b12_ratios", f"""
WITH w AS (SELECT entity, max_by(value, ts) FILTER (WHERE test = 'click') AS c, max(ts) FILTER (WHERE test = 'click') AS cd, max_by(value, ts) FILTER (WHERE test = 'view') AS v, max(ts) FILTER (WHERE test = 'view') AS vd,
 max_by(value, ts) FILTER (WHERE test = 'error') AS e FROM ({SERIES}) GROUP BY entity)
SELECT entity, 'click/view' AS ratio, round(c / v, 6) AS value, cd AS at FROM w WHERE c IS NOT NULL AND v <> 0
UNION ALL SELECT entity, 'view/rest', round(v / (e - v), 6), vd FROM w WHERE e - v > 0""")
def b12(spark, sf_dir):
    made = (("click/view", "click", "view", None), ("view/rest", "view", "error", "view"))
    return B.ratios(series(spark, sf_dir), made).withColumn("value", F.round("value", 6))


@query("b13_report", f"""
SELECT g.entity, g.test, g.n_points, g.points, c.context, t.trend, {STATUS.format(v='l.value', lo='r.low', hi='r.high')} AS status, round(a.rate, 6) AS rate, r.low, r.high FROM
 (SELECT entity, test, count(*) AS n_points, string_agg(round(value * 100)::BIGINT::VARCHAR, ' ' ORDER BY ts, ord) AS points FROM ({SERIES}) GROUP BY entity, test) g
 JOIN ({CONTEXT}) c USING (entity, test) JOIN ({trend_sql()}) t USING (entity, test) JOIN ({LAST}) l USING (entity, test) JOIN ({RATE}) a USING (entity, test) LEFT JOIN {BOTH} r ON g.test = r.test""")
def b13(spark, sf_dir):
    b = bounds(spark).withColumns({"per_day_high": F.lit(None).cast("double"), "rate_low": F.lit(None).cast("double"), "rate_high": F.lit(None).cast("double"), "rate_unit": F.lit(None).cast("string")})
    r = B.report(series(spark, sf_dir), b)
    text = F.array_join(F.transform("points", lambda p: F.round(p["value"] * 100).cast("long").cast("string")), " ")
    return r.select("entity", "test", F.size("points").cast("long").alias("n_points"), text.alias("points"), "context", "trend", "status", F.round("rate", 6).alias("rate"), "low", "high")


@query("flagship", f"""
SELECT t.entity, t.test, t.n, c.context, round(t.slope, 6) AS slope, t.trend, round(a.rate, 6) AS rate, l.value AS last_value, {RANGE.replace('value', 'l.value')} AS last_label FROM ({trend_sql()}) t
 JOIN ({CONTEXT}) c USING (entity, test) JOIN ({RATE}) a USING (entity, test) JOIN ({LAST}) l USING (entity, test)""")
def flagship(spark, sf_dir):
    """One row per series: context, trend, rate and the label of the last value."""
    label = F.when(F.col("value") < 20, "LOW").when(F.col("value") > 80, "HIGH").otherwise("NORMAL")
    return B.summary(series(spark, sf_dir)).select("entity", "test", "n", "context", F.round("slope", 6).alias("slope"), "trend", F.round("rate", 6).alias("rate"), F.col("value").alias("last_value"), label.alias("last_label"))
