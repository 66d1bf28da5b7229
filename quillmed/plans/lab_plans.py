"""Queries A1-A20: lab shaping over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmed.functions import scalars as S
from quillmed.operators import lab

from .base import SERIES, query, rows, series, table

REPORT = """SELECT event_id, user_id, event_type,
  CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN event_id % 3 = 1 THEN '-' ELSE ' ' END AS d,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE 'u' || (event_id % 5) END AS unit FROM events"""


def _report(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(F.col("event_id") % 3 == 1, "-").otherwise(" ")
    return e.select("event_id", "user_id", "event_type", "value", day.alias("d"),
                    F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("event_id") % 5).cast("string"))).alias("unit"))


@query("a01_harmonise", f"""
SELECT event_id, d AS "Date", event_type AS "Test", unit AS "Unit", CASE WHEN event_id % 2 = 0 THEN '1 - 2' END AS "RefRange" FROM ({REPORT})""")
def a01(spark, sf_dir):
    r = _report(spark, sf_dir)
    old = r.where("event_id % 2 = 0").select("event_id", F.col("d").alias("Tarih"), F.col("event_type").alias("Test"), F.col("unit").alias("Birim"), F.lit("1 - 2").alias("Referans Aralığı"))
    new = r.where("event_id % 2 = 1").select("event_id", F.col("d").alias("Date"), F.col("event_type").alias("Test Name"), F.col("unit").alias("Result Unit"))
    return lab.harmonise([old, new])


@query("a02_fill_dates", f"""
SELECT event_id, user_id, last_value(nullif(nullif(trim(d), '-'), '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM ({REPORT})""")
def a02(spark, sf_dir):
    return lab.fill_dates(_report(spark, sf_dir), "user_id", ["event_id"], "d").select("event_id", "user_id", "d")


@query("a03_first_seen", f"""
SELECT event_type, min_by(unit, event_id) AS unit, min_by(d, event_id) AS d FROM ({REPORT}) GROUP BY event_type""")
def a03(spark, sf_dir):
    return lab.first_seen(_report(spark, sf_dir), "event_type", ["unit", "d"], F.col("event_id"))


#: The weeks of the given tables, for the SQL; the query finds its own.
WEEKS = ["2024-01-01 00:00", "2024-01-08 00:00", "2024-01-15 00:00", "2024-01-22 00:00", "2024-01-29 00:00"]
WIDE = "SELECT entity, test, " + ", ".join(
    f"min_by(value, ord) FILTER (WHERE strftime(date_trunc('week', ts), '%Y-%m-%d %H:%M') = '{w}') AS \"{w}\"" for w in WEEKS) + f" FROM ({SERIES}) GROUP BY entity, test"


def _wide(spark, sf_dir):
    return lab.pivot_dates(series(spark, sf_dir), ["entity", "test"], F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd HH:mm"), "value", F.col("ord"))


@query("a04_pivot_dates", WIDE)
def a04(spark, sf_dir):
    return _wide(spark, sf_dir)


@query("a05_unpivot_dates", f"SELECT * FROM (UNPIVOT ({WIDE}) ON " + ", ".join(f'"{w}"' for w in WEEKS) + " INTO NAME datetime_str VALUE raw_value)")
def a05(spark, sf_dir):
    return lab.unpivot_dates(_wide(spark, sf_dir), ["entity", "test"])


DIRTY = """SELECT l_orderkey, l_partkey, l_linenumber, CASE l_linenumber
  WHEN 1 THEN CAST(l_quantity AS INTEGER) || ',' || l_linenumber WHEN 2 THEN ' ' || CAST(l_quantity AS INTEGER) || '.5 '
  WHEN 3 THEN '1' || chr(8239) || CAST(l_quantity AS INTEGER) || chr(160) WHEN 4 THEN 'Negatif (-)' WHEN 5 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS raw,
  CASE l_linenumber WHEN 1 THEN '< ' || CAST(l_quantity AS INTEGER) || ',5' WHEN 2 THEN '>= 1' WHEN 3 THEN CAST(l_quantity AS INTEGER) || ' - ' || (CAST(l_quantity AS INTEGER) + 3)
  WHEN 4 THEN '<' || CAST(l_quantity AS INTEGER) WHEN 5 THEN ' - 7,25' WHEN 6 THEN '0 - 1.75 IU' ELSE 'a - b - c' END AS rng FROM lineitem"""


def _dirty(spark, sf_dir):
    n, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    raw = (F.when(k == 1, F.concat(n, F.lit(","), k.cast("string"))).when(k == 2, F.concat(F.lit(" "), n, F.lit(".5 ")))
           .when(k == 3, F.concat(F.lit("1\u202f"), n, F.lit("\u00a0"))).when(k == 4, "Negatif (-)").when(k == 5, "").otherwise(n))
    up = (F.col("l_quantity").cast("int") + 3).cast("string")
    rng = (F.when(k == 1, F.concat(F.lit("< "), n, F.lit(",5"))).when(k == 2, ">= 1").when(k == 3, F.concat(n, F.lit(" - "), up))
           .when(k == 4, F.concat(F.lit("<"), n)).when(k == 5, " - 7,25").when(k == 6, "0 - 1.75 IU").otherwise("a - b - c"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", raw.alias("raw"), rng.alias("rng"))


@query("a06_parse_value", f"""SELECT l_orderkey, l_partkey, l_linenumber,
 TRY_CAST(replace(replace(replace(trim(raw), ',', '.'), chr(8239), ''), chr(160), '') AS DOUBLE) AS value FROM ({DIRTY})""")
def a06(spark, sf_dir):
    return _dirty(spark, sf_dir).select("l_orderkey", "l_partkey", "l_linenumber", S.parse_value(F.col("raw")).alias("value"))


@query("a07_parse_range", f"""
WITH s AS (SELECT *, trim(replace(rng, ',', '.')) AS s FROM ({DIRTY})),
p AS (SELECT *, split_part(s, ' ', 1) AS op, TRY_CAST(split_part(s, ' ', 2) AS DOUBLE) AS num, len(string_split(s, '-')) AS n,
      trim(split_part(s, '-', 1)) AS a, trim(split_part(s, '-', 2)) AS b FROM s),
q AS (SELECT *, op NOT IN ('<', '<=', '>', '>=') AND n = 2 AND (a = '' OR TRY_CAST(a AS DOUBLE) IS NOT NULL) AND (b = '' OR TRY_CAST(b AS DOUBLE) IS NOT NULL) AS pair FROM p)
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN op IN ('>', '>=') THEN num WHEN pair THEN TRY_CAST(a AS DOUBLE) END AS low,
       CASE WHEN op IN ('<', '<=') THEN num WHEN pair THEN TRY_CAST(b AS DOUBLE) END AS high FROM q""")
def a07(spark, sf_dir):
    return _dirty(spark, sf_dir).withColumn("r", S.parse_range(F.col("rng"))).select("l_orderkey", "l_partkey", "l_linenumber", "r.low", "r.high")


@query("a08_parse_time", """
SELECT event_id, date_trunc('minute', ts) AS at, value FROM events WHERE event_id % 4 <> 0""")
def a08(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", F.when(F.col("event_id") % 4 == 0, "12/31/2024").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm")))
    return e.select("event_id", S.parse_time(F.col("s")).alias("at"), "value").dropna(subset=["at", "value"])


@query("a09_clean_name", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS name FROM documents")
def a09(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.clean_name(F.col("text")).alias("name"))


NAMES = (("red widget", "Widget, red", 1), ("Small Ring", "Ring, small", 2), ("small ring", "Ring, S", 3), ("blue bolt", "Bolt, blue", 4), ("large gear", "Gear, large", 5))
NAMES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in NAMES) + ") AS d(key, value, ord)"
PARTS = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN '  Item  (' || upper(p_name) || ')' ELSE p_name || ' x' END AS name FROM part"""


@query("a10_map_names", f"""
WITH p AS (SELECT p_partkey, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS c FROM ({PARTS})),
k AS (SELECT *, lower(c) AS low, lower(replace(nullif(regexp_extract(c, '\\(([^)]*)\\)', 1), ''), ' ', '')) AS abbr FROM p)
SELECT p_partkey, coalesce((SELECT min_by(value, ord) FROM {NAMES_SQL} WHERE key = c), (SELECT min_by(value, ord) FROM {NAMES_SQL} WHERE lower(key) = low),
  (SELECT min_by(value, ord) FROM {NAMES_SQL} WHERE lower(replace(key, ' ', '')) = abbr), c) AS mapped FROM k""")
def a10(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.upper("p_name")).when(k == 2, F.concat(F.lit("  Item  ("), F.upper("p_name"), F.lit(")"))).otherwise(F.concat("p_name", F.lit(" x")))
    d = rows(spark, "key string, value string, ord int", *NAMES)
    return lab.map_names(table(spark, sf_dir, "part").withColumn("name", name), "name", d).select("p_partkey", "mapped")


@query("a11_union_dedupe", """
WITH u AS (SELECT event_type AS test, date_trunc('day', ts) AS day, floor(value / 10) AS value, event_id, 0 AS src FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT event_type, date_trunc('day', ts), floor(value / 10), event_id, 1 FROM events WHERE event_id % 2 = 1)
SELECT test, day, value::BIGINT AS value, event_id FROM u QUALIFY row_number() OVER (PARTITION BY test, day, value ORDER BY src, event_id) = 1""")
def a11(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("test"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.floor(F.col("value") / 10).alias("value"), "event_id")
    return lab.stack_first([e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")], ["test", "day", "value"], ["event_id"])


@query("a12_strict_mapping", """
SELECT n_nationkey, v.value AS mapped FROM nation JOIN (VALUES ('NATION_1', 'one'), ('NATION_7', 'seven'), ('NATION_21', 'twenty-one')) AS v(key, value) ON n_name = key""")
def a12(spark, sf_dir):
    m = rows(spark, "key string, value string", ("NATION_1", "one"), ("NATION_7", "seven"), ("NATION_21", "twenty-one"))
    return lab.strict_mapping(table(spark, sf_dir, "nation"), "n_name", m).select("n_nationkey", "mapped")


@query("a13_stack_catalogues", """
WITH u AS (SELECT s_nationkey AS nation, s_acctbal AS bound, s_suppkey AS k, 0 AS src FROM supplier UNION ALL SELECT c_nationkey, c_acctbal, c_custkey, 1 FROM customer)
SELECT nation, bound, k FROM u QUALIFY row_number() OVER (PARTITION BY nation ORDER BY src, k) = 1""")
def a13(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bound"), F.col("s_suppkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bound"), F.col("c_custkey").alias("k"))
    return lab.stack_first([s, c], ["nation"], ["k"])


@query("a14_join_thresholds", """
SELECT o_orderkey AS result_id, o_totalprice AS value, c_acctbal AS threshold FROM orders JOIN customer ON o_custkey = c_custkey""")
def a14(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return lab.join_thresholds(o, c, F.col("o_custkey") == F.col("c_custkey"), {"o_orderkey": "result_id", "o_totalprice": "value", "c_acctbal": "threshold"})


@query("a15_parse_rules", """
SELECT event_id, i::INTEGER AS rule_no, CASE i WHEN 0 THEN '>' ELSE '<' END AS comp, CASE i WHEN 0 THEN (event_id % 50)::DOUBLE END AS low, CASE i WHEN 1 THEN 5.5 END::DOUBLE AS high
FROM events, (VALUES (0), (1)) v(i) WHERE event_id % 10 <> 3""")
def a15(spark, sf_dir):
    text = F.when(F.col("event_id") % 10 == 3, "not json").otherwise(F.format_string('[{"comp": ">", "low": %d, "unit": "%%"}, {"comp": "<", "high": 5.5, "unit": null}]', F.col("event_id") % 50))
    return lab.parse_rules(table(spark, sf_dir, "events").select("event_id", text.alias("rules")), "rules").select("event_id", "rule_no", "comp", "low", "high")


FACTORS = (("mg/dL", "g/L", 0.01), ("g/L", "mg/dL", 100.0), ("ng/mL", "mg/dL", 0.0001), ("U/L", "kU/L", 0.001))
UNITS = ("mg/dL", "G / L;old", "ng/ml", "U/L", "x10^9/L")


@query("a16_convert_units", """
WITH e AS (SELECT event_id, value, (event_id % 5)::INTEGER AS u, CASE WHEN event_id % 2 = 0 THEN 'mg/dL' ELSE 'g/L' END AS target FROM events),
n AS (SELECT *, CASE u WHEN 0 THEN 'mg/dl' WHEN 1 THEN 'g/l' WHEN 2 THEN 'ng/ml' WHEN 3 THEN 'u/l' ELSE 'x10^9/l' END AS f FROM e)
SELECT event_id, round(CASE WHEN f = 'mg/dl' AND target = 'g/L' THEN value * 0.01 WHEN f = 'g/l' AND target = 'mg/dL' THEN value * 100 WHEN f = 'ng/ml' AND target = 'mg/dL' THEN value * 0.0001 ELSE value END, 8) AS converted FROM n""")
def a16(spark, sf_dir):
    unit = F.get(F.array(*map(F.lit, UNITS)), (F.col("event_id") % 5).cast("int"))
    e = table(spark, sf_dir, "events").withColumn("unit", unit).withColumn("target", F.when(F.col("event_id") % 2 == 0, "mg/dL").otherwise("g/L"))
    f = rows(spark, "unit_from string, unit_to string, factor double", *FACTORS)
    return lab.convert_units(e, "value", "unit", "target", f, "converted").select("event_id", F.round("converted", 8).alias("converted"))


REFS = (("click", "Both", 1, 10.0, 60.0), ("click", "Female", 2, 12.0, 55.0), ("view", "Male", 1, 5.0, 50.0), ("view", "Female", 2, 6.0, 45.0), ("error", "Both", 1, 0.0, 40.0), ("purchase", "Male", 1, 20.0, 90.0))
REFS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', {c}, {d}, {e})" for a, b, c, d, e in REFS) + ") AS r(test, ref_sex, ref_ord, low, high)"


def refs(spark):
    return rows(spark, "test string, ref_sex string, ref_ord int, low double, high double", *REFS)


@query("a17_pick_reference", f"""
WITH s AS (SELECT DISTINCT user_id AS entity, event_type AS test, CASE user_id % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'Male' END AS sex FROM events)
SELECT entity, s.test, ref_sex, low::DOUBLE AS low, high::DOUBLE AS high FROM s JOIN {REFS_SQL} ON s.test = r.test
QUALIFY row_number() OVER (PARTITION BY entity, s.test ORDER BY CASE WHEN sex IS NOT NULL AND lower(sex) = lower(ref_sex) THEN 0 WHEN lower(ref_sex) = 'both' THEN 1 ELSE 2 END, ref_ord) = 1""")
def a17(spark, sf_dir):
    s = series(spark, sf_dir).select("entity", "test").distinct().withColumn("sex", F.when(F.col("entity") % 3 == 0, "female").when(F.col("entity") % 3 == 1, "Male"))
    return lab.pick_reference(s, refs(spark), ["test"], "sex", ["entity", "test"]).select("entity", "test", "ref_sex", "low", "high")


@query("a18_target_unit", f"""
SELECT user_id, event_type, coalesce(CASE event_type WHEN 'click' THEN 'g/L' END, max_by(unit, event_id) FILTER (WHERE trim(unit) <> '')) AS target_unit
FROM ({REPORT}) GROUP BY user_id, event_type""")
def a18(spark, sf_dir):
    r = _report(spark, sf_dir).withColumn("meta", F.when(F.col("event_type") == "click", "g/L"))
    return lab.target_units(r, ["user_id", "event_type"], "unit", "event_id", "meta")


@query("a19_repair_scale", """
WITH b AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN value * 1000 WHEN 1 THEN value / 1000 ELSE value END AS v FROM events),
d AS (SELECT event_id, CASE WHEN v > 100 * 4.0 AND v / 1000 <= 100 * 4.0 THEN v / 1000 ELSE v END AS v FROM b)
SELECT event_id, round(CASE WHEN v > 0 AND v < 2.0 / 100 THEN v * 1000 ELSE v END, 6) AS value FROM d""")
def a19(spark, sf_dir):
    k = F.col("event_id") % 5
    v = F.when(k == 0, F.col("value") * 1000).when(k == 1, F.col("value") / 1000).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.round(lab.repair_scale(v, F.lit(2.0), F.lit(4.0)), 6).alias("value"))


@query("a20_complete_rows", """
SELECT event_id FROM events WHERE event_id % 3 <> 1 AND event_id % 7 <> 0""")
def a20(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 1, F.col("ts")).alias("Date"), F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("event_type")).alias("Test"), F.col("value").alias("Value"))
    return lab.complete_rows(e).select("event_id")


#: The whole long table, from report rows to converted and repaired measurements with their bounds.
@query("j1_lab_long_table", f"""
WITH e AS (SELECT user_id AS entity, event_type AS test, ts, event_id, replace(CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) || ',5', '.', ',') AS raw FROM events),
p AS (SELECT entity, test, ts, event_id, TRY_CAST(replace(raw, ',', '.') AS DOUBLE) AS v FROM e),
s AS (SELECT p.*, low, high, row_number() OVER (PARTITION BY entity, p.test, event_id ORDER BY CASE WHEN lower(ref_sex) = 'both' THEN 1 ELSE 2 END, ref_ord) AS n FROM p JOIN {REFS_SQL} ON p.test = r.test)
SELECT entity, test, ts, event_id, v AS value, low::DOUBLE AS low, high::DOUBLE AS high FROM s WHERE n = 1""")
def j1(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("test"), "ts", "event_id", F.concat(F.floor("value").cast("string"), F.lit(",5")).alias("raw"))
    p = e.withColumn("value", S.parse_value(F.col("raw"))).where("value is not null").withColumn("sex", F.lit(None).cast("string"))
    dims = lab.pick_reference(p.select("test", "sex").distinct(), refs(spark), ["test"], "sex", ["test"]).select("test", "low", "high")
    m = p.join(F.broadcast(dims), "test")  # one row per test of the fixed catalogue
    return m.select("entity", "test", "ts", "event_id", lab.repair_scale(F.col("value"), F.col("low"), F.col("high")).alias("value"), "low", "high")
