"""What the third review found: labels at their limits, tables that are folders, whole results."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmed.operators import biblio, dialog, trend
from quillmed.plans import registry

SQL, RUN = registry.oracle_sql(), registry.queries()


def agrees(spark, folder, name):
    c = duckdb.connect()
    for t in os.listdir(folder):
        path = f"{folder}/{t}"
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = RUN[name](spark, str(folder))
    cols = ", ".join(f'"{x}"' for x in df.columns)
    text = lambda rows: sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)
    got = text(df.collect())
    assert got and got == text(c.sql(f"select {cols} from ({SQL[name]})").fetchall())


@pytest.mark.parametrize("slope, label", [(0.09999999999999998, "UP"), (0.1, "UP"), (-0.09999999999999998, "DOWN"), (-0.1, "DOWN"), (0.0999, "STABLE"), (None, "UNKNOWN")])
def test_a_slope_at_the_limit_is_labelled_by_its_value(spark, slope, label):
    assert spark.range(1).select(trend.slope_label(F.lit(slope).cast("double"))).first()[0] == label


@pytest.mark.parametrize("name", ["t04_spike_status", "t05_abnormal_events"])
def test_rests_of_rounding_are_no_sharp_changes(spark, small, tmp_path, name):
    duckdb.sql(f"copy (select * replace (event_id + r * 100000 as event_id) from '{small}/events.parquet', range(60) x(r)) to '{tmp_path}/events.parquet' (format parquet)")
    agrees(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["x01_critical_alerts", "x02_conversation_outcomes", "x02_kept_turns"])
def test_streams_read_tables_that_are_folders(spark, small, tmp_path, name):
    for t, key in (("events", "event_id"), ("conversations", "conv_id")):
        os.mkdir(tmp_path / f"{t}.parquet")
        for k in range(3):  # later keys first
            duckdb.sql(f"copy (select * from '{small}/{t}.parquet' where {key} % 3 = {2 - k}) to '{tmp_path}/{t}.parquet/part-{k}.parquet' (format parquet)")
    agrees(spark, tmp_path, name)


def test_gates_of_every_relation_for_every_entity(spark):
    c = spark.createDataFrame([("1", "a", "NOT", "x"), ("2", "a", "AND", "y"), ("2", "b", "AND", "y"), ("3", "b", "OR", "z")], "relation string, cause string, logic string, effect string")
    f = spark.createDataFrame([(1, "a", True), (2, "c", True), (3, "b", False), (1, "b", True)], "entity long, cause string, flag boolean")
    got = {(r["entity"], r["relation"]): r["holds"] for r in dialog.evaluate_gates(c, f, every=True).collect()}
    assert got == {(e, r): h for e, hs in ((1, (False, True, True)), (2, (True, False, False)), (3, (True, False, False))) for r, h in zip("123", hs)}


def test_link_outcome_shows_the_least_keys_without_a_link(spark):
    d = spark.createDataFrame([(k, "u" if k % 3 == 0 else None) for k in range(90)], "id long, link string")
    got = {r["status"]: (r["n"], r["sample"]) for r in biblio.link_outcome(d, "id", "link", 4).collect()}
    assert got == {"found": (30, None), "missing": (60, "1,2,4,5")}


def test_pairs_of_roles_whose_names_read_alike(spark):
    from collections import Counter

    from quillmed.operators import graph

    facts = {1: ("p", [("a", "x"), ("b", "y"), ("b", "z"), ("c", None)]), 2: ("p", [("b", "y"), ("a", "x")]), 3: ("p]:x:[b", [("a", "x"), ("c", "y")]), 4: ("x", [("a", "x"), ("b]:p]:x:[b", "y")]), 5: ("p", [("a]:p", "x"), ("b", "y"), ("a", "x")])}
    r = spark.createDataFrame([(1, str(k), p, role, x) for k, (p, rs) in facts.items() for role, x in rs], "doc long, fact_id string, predicate string, role string, entity string").withColumns({"literal": F.lit(None).cast("string"), "datatype": F.lit(None).cast("string")})
    want = Counter((x, f"[{a}]:{p}:[{b}]", y) for p, rs in facts.values() for a, x in rs for b, y in rs if a != b)
    got = graph.role_pairs(r)
    assert Counter({(t["s"], t["p"], t["o"]): t["n"] for t in got.collect()}) == want and got.count() == len(want)
    assert got._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 4  # facts and pairs are grouped once each, in two halves
