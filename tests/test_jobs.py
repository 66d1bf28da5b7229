"""Streams over several batches, ingest jobs, relation instances and schemaless attributes."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quillmed.operators import bayes, biblio, dialog, graph, ingest, store
from quillmed.streaming import jobs


def batches(spark, tmp_path, schema, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run(spark, stream, tmp_path):
    jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def test_alerts_carry_the_last_value_over_batches(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    schema = "entity long, test string, ts timestamp, value double"
    s = batches(spark, tmp_path, schema, [[(1, "a", at(3), 50.0), (1, "a", at(1), 10.0), (2, "a", at(1), 200.0)], [(1, "a", at(4), 150.0), (1, "a", at(5), 1.0)]])
    got = {(r["entity"], r["ts"].day, r["kind"], r["rule"]) for r in run(spark, jobs.critical_alerts(s, 2.0, 120.0, 60.0, "30 days"), tmp_path)}
    assert got == {(2, 1, "High", "bounds"), (1, 4, "High", "bounds"), (1, 4, "High", "rate"), (1, 5, "Low", "bounds"), (1, 5, "Low", "rate")}


@pytest.mark.parametrize("turns", [False, True])
def test_conversations_keep_their_turns_over_batches(spark, tmp_path, turns):
    start = dt.datetime(2024, 1, 1)
    row = lambda c, turn, role, text, minutes: (c, turn, role, text, start + dt.timedelta(minutes=minutes))
    schema = "conv_id long, turn int, role string, text string, ts timestamp"
    parts = [[row(1, 1, "user", " it hurts ", 0), row(1, 0, "assistant", "hello", 0), row(2, 0, "user", None, 1), row(3, 0, "assistant", "hi", 2)],
             [row(1, 2, "assistant", "where?", 5), row(2, 1, "user", "fever", 6)], [row(1, 3, "user", "Stop.", 8)], [row(9, 0, "user", "late one", 500)]]
    out = jobs.conversation_outcomes(batches(spark, tmp_path, schema, parts), ("stop",), "1 minute", 60 * 60_000, turns)
    got = run(spark, out, tmp_path)
    if turns:
        assert sorted((r["conv_id"], r["turn"], r["text"] or "", r["ended"]) for r in got) == [
            (1, 0, "hello", "stop"), (1, 1, " it hurts ", "stop"), (1, 2, "where?", "stop"), (1, 3, "Stop.", "stop"), (2, 0, "", "timeout"), (2, 1, "fever", "timeout"), (3, 0, "hi", "timeout")]
    else:
        assert sorted((r["conv_id"], r["turns"], r["complaint"] or "", r["ended"]) for r in got) == [(1, 4, "it hurts", "stop"), (2, 2, "fever", "timeout"), (3, 1, "", "timeout")]


def test_ingest_writes_both_sides_once(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "b"), (5, "")], "id long, x string")
    done = ingest.ingest(d, {"null": F.col("x").isNull(), "empty": F.col("x") == "", "short": F.length("x") < 2})
    assert done.counts == {"accepted": 0, "null": 1, "empty": 2, "short": 2}
    assert {(r["id"], r["reason"]) for r in done.rejected.collect()} == {(1, "short"), (2, "null"), (3, "empty"), (4, "short"), (5, "empty")}
    assert done.accepted.count() == 0 and done.accepted.columns == ["id", "x"]
    none = ingest.ingest(d.limit(0), {"null": F.col("x").isNull()})
    assert none.counts == {"accepted": 0, "null": 0} and none.rejected.count() == 0


def test_fragments_say_why_they_are_rejected(spark):
    texts = ["```json\n{\"predicate\": \"p\",}\n```", "none", None, "{\"predicate\" }", "{\"predicate\": \"p\", \"odd\": 1}", "{\"id\": 1}", "{\"predicate\": \" \"}"]
    done = ingest.fragments(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text")
    assert {r["id"]: r["reason"] for r in done.rejected.collect()} == {1: "no object", 2: "no object", 3: "invalid", 4: "unknown field", 5: "no predicate", 6: "no predicate"}
    assert [r["id"] for r in done.accepted.collect()] == [0]


def brute_flatten(v, path, arrays):
    items = v.items() if isinstance(v, dict) else enumerate(v)
    for k, x in items:
        at = f"{path}_{k}" if path else str(k)
        if isinstance(x, dict) or arrays and isinstance(x, list):
            yield from brute_flatten(x, at, arrays)
        else:
            yield at, x


@pytest.mark.parametrize("arrays", [False, True])
def test_json_is_flattened_without_a_schema(spark, arrays):
    texts = ['{"a": {"b": 1, "c": {"d": null, "e": []}}, "l": [1, {"x": "y"}, [true]], "s": "t\\"u"}', "{}", "[1, 2]", "7", "no json", None, '{"a": 1.5, "b": "x"}']
    got = graph.flatten_json(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", arrays=arrays).collect()
    want = set()
    for k, t in enumerate(texts):
        v = json.loads(t) if t and t != "no json" else None
        if isinstance(v, dict) or arrays and isinstance(v, list):
            want |= {(k, p, None if x is None else x if isinstance(x, str) else json.dumps(x, separators=(",", ":"))) for p, x in brute_flatten(v, "", arrays)}
    assert {(r["id"], r["path"], r["value"]) for r in got} == want and len(got) == len(want)


def test_relations_have_roles_types_and_instances(spark):
    e = spark.createDataFrame([(1, "r", "subject", "A"), (1, "r", "object", "zz"), (1, "r", "by", "B"), (1, "r", "by", "B"), (1, "r", "w", "5"), (2, "r", "by", "7"), (3, "q", "w", None)], "edge long, relation string, key string, value string")
    parts = graph.relation_parts(e, spark.createDataFrame([("A", "T1"), ("B", "T2"), ("B", "T0")], "id string, type string"))
    assert {(r["relation"], r["key"], r["part"], tuple(r["types"] or ()), r["kind"], r["n"]) for r in graph.relation_schema(parts).collect()} == {
        ("r", "subject", "role", ("T1",), None, 1), ("r", "object", "role", ("Unknown",), None, 1), ("r", "by", "role", ("T0",), None, 2), ("r", "w", "attribute", (), "long", 1), ("r", "by", "attribute", (), "long", 1)}
    got = {r["edge"]: (r["roles"], r["attributes"]) for r in graph.relation_instances(parts).collect()}
    assert got == {1: ({"subject": ["A"], "object": ["zz"], "by": ["B"]}, {"w": ["5"]}), 2: ({}, {"by": ["7"]})}


def test_mentions_cost_no_product(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(60)}) + ["", "Ü"]
    sents = [(d, s, None if s == 7 else "".join(rng.choices("abcÜ ", k=40))) for d in (1, 2, 3) for s in range(30)]
    n = spark.createDataFrame([(d, x) for d in (1, 2) for x in names] + [(1, "a"), (1, None)], "doc_id long, name string")
    got = {tuple(r) for r in graph.mentions(spark.createDataFrame(sents, "doc_id long, sent_id int, sentence string"), n, sentences=4, most=9).collect()}
    assert got == {(d, s, x) for d, s, t in sents if t is not None and d < 3 for x in names if x in t}


def test_gates_on_absent_findings(spark):
    c = spark.createDataFrame([("1", "a", "NOT", "x"), ("2", "a", "AND", "y"), ("2", "b", "AND", "y"), ("3", "b", "NAND", "z")], "relation string, cause string, logic string, effect string")
    f = spark.createDataFrame([(1, "a", True), (2, "c", True), (3, "b", False), (1, "b", True)], "entity long, cause string, flag boolean")
    got = {(r["entity"], r["relation"]): r["holds"] for r in dialog.evaluate_gates(c, f).collect()}
    assert got == {(1, "1"): False, (1, "2"): True, (1, "3"): False, (2, "1"): True, (2, "3"): True, (3, "1"): True, (3, "3"): True}


def test_scores_of_any_set_of_observed_columns(spark):
    rng = random.Random(2)
    combos = [(a, b, c) for a in "xy" for b in "uv" for c in "pq"]
    p = [rng.random() for _ in combos]
    j = spark.createDataFrame([(*s, x / sum(p)) for s, x in zip(combos, p)], "a string, b string, c string, p double")
    ev = [(k, rng.choice(["x", "y", None, " "]), rng.choice(["u", "v", "None", None]), rng.choice(["p", "q", None, "odd"])) for k in range(40)]
    got = {(r["id"], r["variable"], r["state"]): r["p"] for r in bayes.score(spark.createDataFrame(ev, "id long, a string, b string, c string"), "id", ["a", "b", "c"], j).collect()}
    for k, *seen in ev:
        seen = [None if s in (None, " ", "None") else s for s in seen]
        fit = [(s, x) for s, x in zip(combos, p) if all(o is None or o == v for o, v in zip(seen, s))]
        for i, var in enumerate("abc"):
            for state in {s[i] for s in combos}:
                part = sum(x for s, x in fit if s[i] == state)
                assert got.get((k, var, state), 0.0) == pytest.approx(part / sum(x for _, x in fit) if fit else 0.0)


def test_unresolved_keys_and_byte_bounds(spark):
    d = spark.createDataFrame([(k % 60, "u" if k % 3 == 0 else None) for k in range(90)], "id long, link string")
    assert {r["id"] for r in biblio.unresolved(d, "id", "link").collect()} == {k for k in range(60) if k % 3}
    wide = spark.range(50).select("id", F.repeat(F.lit("x"), 100_000).alias("t"))
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().logical().toString()
    assert hinted(store.sized(wide)) and not hinted(store.sized(wide, most_bytes=1 << 20)) and not hinted(store.sized(wide, most=49))
