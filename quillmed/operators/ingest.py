"""Ingest jobs (J1, J5, J6): one pass over raw rows writes what is accepted and what is rejected, with the reason."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillmed.functions.scalars import clean_name, parse_range, parse_time, parse_value

from . import lab
from .graph import FACT_FIELDS, extract_json
from .scan import LONG
from .store import shared_dir, sized

#: Name of the count of accepted rows.
ACCEPTED = "accepted"


class Ingest(NamedTuple):
    """accepted: rows that break no rule; rejected: the others, with reason; counts: rows by reason, and accepted ones, observed while they were written."""

    accepted: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def ingest(df: DataFrame, rules: dict[str, Column], name: str = "ingest", path: str | None = None) -> Ingest:
    """Rows of df by the first rule they break (reason to condition; a condition that is null isn't met). Both sides are written in one
    pass, under path or in the shared folder, side by side; the counts are taken in that pass, too."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    reason = F.coalesce(*(F.when(c, F.lit(r)) for r, c in rules.items()), F.lit(None).cast("string"))
    marked, seen = df.withColumn("reason", reason), Observation(f"{name}-{uuid.uuid4().hex}")
    each = [F.count_if(F.col("reason") == r).alias(f"n{k}") for k, r in enumerate(rules)]
    marked = marked.observe(seen, F.count_if(F.col("reason").isNull()).alias("ok"), *each)
    marked.withColumn("side", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")).write.partitionBy("side").parquet(path)
    got = seen.get
    back = spark.read.schema(marked.withColumn("side", F.lit("")).schema).parquet(path)
    return Ingest(back.where("side = 'accepted'").drop("reason", "side"), back.where("side = 'rejected'").drop("side"), {ACCEPTED: got["ok"]} | {r: got[f"n{k}"] for k, r in enumerate(rules)})


def lab_long_table(reports: list[DataFrame], dictionary: DataFrame, refs: DataFrame, factors: DataFrame, headers: dict[str, str] = lab.HEADERS, long: int | None = LONG) -> Ingest:
    """Report tables (report, row, sex and Date, Test, Value, Unit, RefRange under any known header) -> measurements: entity (the report), test, ts, ord, value, unit, low, high.

    Headers are made common, dates filled downwards, names cleaned and mapped. Rejected are rows without a test, of a test that refs doesn't know, without a readable time, and without a
    readable value. The others get the bounds of refs(test, ref_sex, ref_ord, low, high, ref_unit) for their sex, or else of their own range, the unit of refs or the
    latest of their series, values converted by factors(unit_from, unit_to, factor) and repaired in scale."""
    rows = lab.fill_dates(lab.harmonise(reports, headers), "report", ["row"], long=long)
    named = lab.map_names(rows.withColumn("Test", clean_name(F.col("Test"))), "Test", dictionary, "test_name")
    known = refs.select(F.col("test").alias("test_name")).distinct().withColumn("_known", F.lit(True))
    typed = named.join(sized(known), "test_name", "left").withColumn("ts", parse_time(F.col("Date"))).withColumn("value", parse_value(F.col("Value"))).withColumn("_own", parse_range(F.col("RefRange")))
    done = ingest(typed, {"no test": F.coalesce("Test", F.lit("")) == "", "unknown test": F.col("_known").isNull(), "no time": F.col("ts").isNull(), "no value": F.col("value").isNull()}, "lab")
    dims = lab.pick_reference(done.accepted.select(F.col("test_name").alias("test"), "sex").distinct(), refs, ["test"], "sex", ["test", "sex"]).select(F.col("test").alias("test_name"), F.col("sex").alias("_sex"), "low", "high", "ref_unit")
    met = done.accepted.join(sized(dims), (done.accepted["test_name"] == dims["test_name"]) & done.accepted["sex"].eqNullSafe(dims["_sex"])).drop(dims["test_name"])
    units = lab.target_units(met, ["report", "test_name"], "Unit", "row", "ref_unit").withColumnsRenamed({"report": "_report", "test_name": "_test"})
    aimed = met.join(units.hint("shuffle_merge"), met["report"].eqNullSafe(units["_report"]) & (met["test_name"] == units["_test"]))
    low, high = F.coalesce("low", "_own.low"), F.coalesce("high", "_own.high")
    out = lab.convert_units(aimed, "value", "Unit", "target_unit", factors, "_value")
    out = out.select(F.col("report").alias("entity"), F.col("test_name").alias("test"), "ts", F.col("row").alias("ord"), lab.repair_scale(F.col("_value"), low, high).alias("value"), F.col("target_unit").alias("unit"), low.alias("low"), high.alias("high"))
    return done._replace(accepted=out)


def annotations(spans: DataFrame, sents: DataFrame, labels: tuple[str, ...]) -> Ingest:
    """spans(doc_id, sent_id, start, end, label, text), by token, of sents(doc_id, sent_id, tokens): rejected are those of no known sentence, without or with an unknown label, with
    bounds outside the sentence or empty, and whose text isn't that of the tokens between the bounds."""
    m = spans.join(sents.select("doc_id", "sent_id", "tokens").hint("shuffle_merge"), ["doc_id", "sent_id"], "left")
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.size("tokens"))
    own = F.array_join(F.when(inside, F.slice("tokens", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))), " ")
    rules = {"no sentence": F.col("tokens").isNull(), "unknown label": ~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "bad bounds": ~F.coalesce(inside, F.lit(False)), "other text": ~own.eqNullSafe(F.col("text"))}
    done = ingest(m, rules, "annotations")
    return done._replace(accepted=done.accepted.drop("tokens"), rejected=done.rejected.drop("tokens"))


def fragments(responses: DataFrame, text: str) -> Ingest:
    """Responses with a column of text -> json: rejected are those without an object, with one that isn't JSON, with fields that a fact doesn't have, and without a predicate."""
    json = extract_json(F.col(text))
    fields = F.json_object_keys("json")
    rules = {"no object": F.col("json").isNull(), "invalid": F.try_parse_json("json").isNull(), "unknown field": F.size(F.array_except(fields, F.array(*map(F.lit, FACT_FIELDS)))) > 0,
             "no predicate": F.coalesce(F.trim(F.get_json_object("json", "$.predicate")), F.lit("")) == ""}
    return ingest(responses.withColumn("json", json), rules, "fragments")


def outcome(done: Ingest, key: str) -> DataFrame:
    """(reason, n, observed, keys): rows of either side as written, counted, what was observed of them, and the sum of their keys."""
    spark = done.accepted.sparkSession
    both = done.accepted.select(F.lit(ACCEPTED).alias("reason"), F.col(key).alias("k")).unionAll(done.rejected.select("reason", F.col(key)))
    seen = spark.createDataFrame(list(done.counts.items()), "reason string, observed long")
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum("k").cast("long").alias("keys")).join(F.broadcast(seen), "reason").select("reason", "n", "observed", "keys")
