"""Queries of the ingest jobs J1, J5, J6: accepted rows, and both sides by reason."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmed.operators import ingest
from quillmed.operators.spans import tokenise

from .base import query, rows, table
from .span_plans import PRED, pred, sents

#: Reports are users, their rows events; faults are strewn in by the event's number.
RAW = """SELECT user_id AS report, event_id AS row, CASE WHEN user_id % 3 = 0 THEN 'F' WHEN user_id % 3 = 1 THEN 'M' END AS sex, CASE WHEN event_id % 11 = 0 THEN '31/12/2024' WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN event_id % 3 = 1 THEN '-' ELSE ' ' END AS d,
 CASE WHEN event_id % 13 = 0 THEN ' ' WHEN event_id % 17 = 0 THEN 'mystery' WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS test, CASE WHEN event_id % 7 = 0 THEN 'Negatif (-)' WHEN event_id % 19 = 0 THEN floor(value)::INTEGER || '000,5' ELSE floor(value)::INTEGER || ',5' END AS v,
 CASE WHEN event_id % 5 = 0 THEN 'g/L' WHEN event_id % 5 = 1 THEN '' ELSE 'mg/dL' END AS unit FROM events"""
REFS = (("click", "both", 1, 1.0, 50.0, "mg/dL"), ("click", "F", 2, 2.0, 40.0, "mg/dL"), ("view", "M", 1, 3.0, 60.0, None), ("view", "both", 2, 3.0, 70.0, None), ("error", "both", 1, None, None, None), ("signup", "both", 1, 0.5, 9.0, None))
FACTORS = (("g/L", "mg/dL", 100.0), ("mg/dL", "g/L", 0.01))
LAB = f"""WITH raw AS ({RAW}), f AS (SELECT *, last_value(nullif(nullif(trim(d), '-'), '') IGNORE NULLS) OVER (PARTITION BY report ORDER BY row) AS filled, lower(trim(test)) AS t FROM raw),
p AS (SELECT *, try_strptime(filled, '%Y-%m-%d %H:%M') AS ts, TRY_CAST(replace(v, ',', '.') AS DOUBLE) AS value FROM f),
r AS (SELECT *, CASE WHEN t = '' THEN 'no test' WHEN t NOT IN ('click', 'view', 'error', 'signup') THEN 'unknown test' WHEN ts IS NULL THEN 'no time' WHEN value IS NULL THEN 'no value' ELSE 'accepted' END AS reason FROM p)"""


def _lab(spark, sf_dir):
    n = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("report"), n.alias("row"), F.when(F.col("user_id") % 3 == 0, "F").when(F.col("user_id") % 3 == 1, "M").alias("sex"),
        F.when(n % 11 == 0, "31/12/2024").when(n % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(n % 3 == 1, "-").otherwise(" ").alias("d"),
        F.when(n % 13 == 0, " ").when(n % 17 == 0, "mystery").when(n % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("test"),
        F.when(n % 7 == 0, "Negatif (-)").when(n % 19 == 0, F.concat(F.floor("value").cast("string"), F.lit("000,5"))).otherwise(F.concat(F.floor("value").cast("string"), F.lit(",5"))).alias("v"),
        F.when(n % 5 == 0, "g/L").when(n % 5 == 1, "").otherwise("mg/dL").alias("unit"))
    one = e.where("row % 2 = 0").select("report", "row", "sex", F.col("d").alias("Tarih"), F.col("test").alias("Test"), F.col("v").alias("Değer"), F.col("unit").alias("Birim"), F.lit("1 - 9").alias("Referans Aralığı"))
    two = e.where("row % 2 <> 0").select("report", "row", "sex", F.col("d").alias("Date"), F.col("test").alias("Test Name"), F.col("v").alias("Value"), F.col("unit").alias("Unit"), F.lit("1 - 9").alias("Reference Value"))
    dictionary = rows(spark, "key string, value string, ord int", *((t, t, k) for k, t in enumerate(("click", "view", "error", "signup", "purchase"))))
    refs = rows(spark, "test string, ref_sex string, ref_ord int, low double, high double, ref_unit string", *REFS)
    return ingest.lab_long_table([one, two], dictionary, refs, rows(spark, "unit_from string, unit_to string, factor double", *FACTORS))


@query("j1_ingest_outcome", f"{LAB} SELECT reason, count(*) AS n, count(*) AS observed, sum(row)::BIGINT AS keys FROM r GROUP BY reason")
def j1_outcome(spark, sf_dir):
    done = _lab(spark, sf_dir)
    return ingest.outcome(done._replace(accepted=done.accepted.withColumnRenamed("ord", "row")), "row")


@query("j1_ingest", f"""{LAB}, a AS (SELECT * FROM r WHERE reason = 'accepted'),
u AS (SELECT report, t, CASE WHEN t = 'click' THEN 'mg/dL' ELSE max_by(unit, row) FILTER (WHERE unit <> '') END AS target FROM a GROUP BY report, t),
b AS (SELECT a.*, target, CASE WHEN unit = 'g/L' AND target = 'mg/dL' THEN value * 100 WHEN unit = 'mg/dL' AND target = 'g/L' THEN value * 0.01 ELSE value END AS w,
 CASE a.t WHEN 'click' THEN CASE WHEN sex = 'F' THEN 2.0 ELSE 1.0 END WHEN 'view' THEN 3.0 WHEN 'signup' THEN 0.5 ELSE 1.0 END AS low, CASE a.t WHEN 'click' THEN CASE WHEN sex = 'F' THEN 40.0 ELSE 50.0 END WHEN 'view' THEN CASE WHEN sex = 'M' THEN 60.0 ELSE 70.0 END WHEN 'signup' THEN 9.0 ELSE 9.0 END AS high
 FROM a JOIN u ON a.report = u.report AND a.t = u.t), d AS (SELECT *, CASE WHEN w > 100 * high AND w / 1000 <= 100 * high THEN w / 1000 ELSE w END AS x FROM b)
SELECT report AS entity, t AS test, ts, row AS ord, round(CASE WHEN x > 0 AND x < low / 100 THEN x * 1000 ELSE x END, 6) AS value, target AS unit, low::DOUBLE AS low, high::DOUBLE AS high FROM d""")
def j1(spark, sf_dir):
    return _lab(spark, sf_dir).accepted.withColumn("value", F.round("value", 6))


#: Spans of the tagger, one in seven without its last character, others shifted, of an unknown label or of a sentence that isn't there.
@query("j5_ingest_outcome", f"""
SELECT reason, count(*) AS n, count(*) AS observed, sum(doc_id)::BIGINT AS keys FROM (SELECT doc_id, CASE WHEN (start + sent_id) % 11 = 0 THEN 'no sentence' WHEN (start + sent_id) % 5 = 2 THEN 'unknown label' WHEN (start + sent_id) % 7 = 1 THEN 'bad bounds'
 WHEN (start + sent_id) % 3 = 0 THEN 'other text' ELSE 'accepted' END AS reason FROM ({PRED})) GROUP BY reason""")
def j5_outcome(spark, sf_dir):
    return ingest.outcome(_spans(spark, sf_dir), "doc_id")


def _spans(spark, sf_dir):
    n = F.col("start") + F.col("sent_id")
    p = pred(spark, sf_dir).select("doc_id", F.when(n % 11 == 0, -1).otherwise(F.col("sent_id")).alias("sent_id"), F.when(n % 7 == 1, F.col("start") - 100_000).otherwise(F.col("start")).alias("start"), "end",
                                   F.when(n % 5 == 2, "OTHER").otherwise(F.col("label")).alias("label"), F.when(n % 3 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"))
    return ingest.annotations(p, sents(spark, sf_dir).withColumn("tokens", tokenise(F.col("sentence"))), ("LONG", "ART"))


@query("j6_ingest_outcome", """
SELECT CASE event_id % 6 WHEN 1 THEN 'no object' WHEN 2 THEN 'invalid' WHEN 3 THEN 'unknown field' WHEN 4 THEN 'no predicate' ELSE 'accepted' END AS reason, count(*) AS n, count(*) AS observed, sum(event_id)::BIGINT AS keys FROM events GROUP BY reason""")
def j6_outcome(spark, sf_dir):
    k = F.col("event_id") % 6
    text = (F.when(k == 0, 'Sure: ```json\n{"id": "F1", "predicate": "is",}\n```').when(k == 1, "none").when(k == 2, '{"predicate": }').when(k == 3, '{"predicate": "p", "weight": 1}').when(k == 4, '{"id": "F2"}')
            .otherwise('x {"predicate": "q", "tuple": []} y'))
    return ingest.outcome(ingest.fragments(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text"), "event_id")
