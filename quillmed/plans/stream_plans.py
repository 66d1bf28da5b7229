"""Queries X1-X3: streams over the events and conversations files, run with the availableNow trigger."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmed.operators.dialog import STOP
from quillmed.operators.store import shared_dir
from quillmed.streaming import jobs

from .base import query, table


def _run(spark, stream):
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    jobs.run_available(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _stream(spark, sf_dir, name):
    """A table as a stream, be it one file or a folder of files. A finished table has no order of files, so all of it is one batch: cut into batches, rows of
    files that come late would fall behind the watermark."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern: a stream takes no plain path of a file


def _events(spark, sf_dir):
    return _stream(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("test"), "ts", "value")


@query("x01_critical_alerts", """
WITH s AS (SELECT user_id AS entity, event_type AS test, ts, value, lag(ts) OVER w AS pt, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
r AS (SELECT *, (value - pv) / greatest(1, floor((epoch_us(ts) - epoch_us(pt)) / 86400000000.0)) AS rate FROM s)
SELECT entity, test, ts, CASE WHEN value < 2 THEN 'Low' ELSE 'High' END AS kind, 'bounds' AS rule FROM s WHERE value < 2 OR value > 150 UNION ALL SELECT entity, test, ts, CASE WHEN rate > 0 THEN 'High' ELSE 'Low' END, 'rate' FROM r WHERE abs(rate) >= 60""")
def x01(spark, sf_dir):
    return _run(spark, jobs.critical_alerts(_events(spark, sf_dir), 2.0, 150.0, 60.0)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("x02_conversation_outcomes", """
WITH c AS (SELECT conv_id, turn, role, 1704067200 + conv_id * 60 + turn AS sec, CASE WHEN role = 'user' AND turn > 1 AND conv_id % 3 = 0 THEN 'Done.' ELSE text END AS text FROM conversations),
g AS (SELECT conv_id, count(*)::INTEGER AS turns, min_by(trim(text), turn) FILTER (WHERE role = 'user' AND trim(text) <> '') AS complaint, bool_or(role = 'user' AND text = 'Done.') AS stopped, max(sec) AS last FROM c GROUP BY conv_id)
SELECT conv_id, turns, complaint, CASE WHEN stopped THEN 'stop' ELSE 'timeout' END AS ended FROM g WHERE stopped OR last + 3600 < (SELECT max(sec) FROM c) - 600""")
def x02(spark, sf_dir):
    return _run(spark, jobs.conversation_outcomes(_chat(spark, sf_dir), STOP))


def _chat(spark, sf_dir):
    text = F.when((F.col("role") == "user") & (F.col("turn") > 1) & (F.col("conv_id") % 3 == 0), "Done.").otherwise(F.col("text"))
    return _stream(spark, sf_dir, "conversations").withColumn("text", text).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")))


@query("x02_kept_turns", """
WITH c AS (SELECT conv_id, turn::INTEGER AS turn, role, 1704067200 + conv_id * 60 + turn AS sec, CASE WHEN role = 'user' AND turn > 1 AND conv_id % 3 = 0 THEN 'Done.' ELSE text END AS text FROM conversations),
g AS (SELECT conv_id, bool_or(role = 'user' AND text = 'Done.') AS stopped, max(sec) AS last FROM c GROUP BY conv_id)
SELECT conv_id, turn, role, text, CASE WHEN stopped THEN 'stop' ELSE 'timeout' END AS ended FROM c JOIN g USING (conv_id) WHERE stopped OR last + 3600 < (SELECT max(sec) FROM c) - 600""")
def x02_turns(spark, sf_dir):
    return _run(spark, jobs.conversation_outcomes(_chat(spark, sf_dir), STOP, turns=True))


@query("x03_tumbling_means", """
SELECT entity, test, start, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT user_id AS entity, event_type AS test, value, TIMESTAMP '1970-01-01' + to_days((2 * (date_diff('day', DATE '1970-01-01', ts::DATE) // 2))::INTEGER) AS start FROM events)
WHERE start + INTERVAL 2 DAYS <= (SELECT max(ts) FROM events) - INTERVAL 6 HOURS GROUP BY entity, test, start""")
def x03(spark, sf_dir):
    return _run(spark, jobs.tumbling_means(_events(spark, sf_dir), "2 days", "6 hours")).withColumn("mean", F.round("mean", 6))
