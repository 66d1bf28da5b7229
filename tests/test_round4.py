"""What the reports of round 3 found: repeated rows, files of documents, near copies, sizes."""

import os

import duckdb
import numpy as np
import pytest

from quillmed.llm import near_copies
from quillmed.operators import graph
from quillmed.plans import base, registry
from quillmed.sources import files

from test_round3 import agrees


@pytest.mark.parametrize("name", ["t09_segments", "t10_commentary"])
def test_runs_do_not_hang_on_how_repeated_rows_are_sorted(spark, small, tmp_path, name):
    duckdb.sql(f"COPY (SELECT e.* FROM '{small.replace('0.001', '0.01')}/events.parquet' e, range(6)) TO '{tmp_path}/events.parquet'")
    agrees(spark, tmp_path, name)


def test_sketches_leave_out_no_pair_and_keep_few_others():
    rng, similarity = np.random.default_rng(3), 0.8
    for n in (1, 5, 64, 300, 2000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for part in (1.0, 0.9, 0.8, 0.5, 0.0):
            b = np.unique(np.concatenate((a[:int(part * n)], rng.integers(0, 1 << 63, n - int(part * n), np.uint64))))
            shared, most = len(np.intersect1d(a, b)), near_copies.may_share(near_copies.sketch(a, np), near_copies.sketch(b, np), np)
            assert shared <= most
            assert n < 64 or part > 0.5 or most < similarity / (1 + similarity) * 2 * n
    many = np.arange(1 << 16, dtype=np.uint64) << np.uint64(40)  # all in one cell
    assert near_copies.may_share(near_copies.sketch(many, np), near_copies.sketch(many[:60000], np), np) >= 60000


def test_documents_come_back_whole_from_a_few_files(spark, tmp_path):
    texts = ["a\nb\r\nc", "", " ", None, "nul\x00 end\x00", '{"path": "x"} ퟿\U0001f600', "\n"]
    docs = spark.createDataFrame([(f"d/{k}", t) for k, t in enumerate(texts * 50)], "path string, text string")
    files.write_documents(docs.coalesce(2), str(tmp_path / "texts"))
    assert len([f for f in (tmp_path / "texts").iterdir() if f.name.startswith("part-")]) == 2
    assert sorted(map(str, files.read_bundles(spark, str(tmp_path / "texts")).collect())) == sorted(map(str, docs.collect()))


def test_s04_writes_no_file_for_each_document(spark, small):
    place = spark.conf.get("spark.checkpoint.dir")
    count = lambda: sum(len(f) for _, _, f in os.walk(place))
    before = count()
    n = registry.queries()["s04_documents"](spark, small).count()
    assert n >= 200 and count() - before < n / 4


def test_links_of_large_tables_are_dealt_by_their_rows(spark, small, monkeypatch):
    """With few rows for a task, shuffles get more tasks than Spark's own number, and the queries still agree with their SQL."""
    monkeypatch.setattr(base, "TASK_ROWS", 500)
    for name in ("k11_merge_links", "k12_rewrite_link_arguments", "k16_argument_pairs", "k23_link_edges", "s09_export_links"):
        df = registry.queries()[name](spark, small)
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
        agrees(spark, small, name)


def test_instances_of_relations_take_one_exchange(spark):
    parts = spark.createDataFrame([("e", "r", "k", "v", "role", "T"), ("e", "r", "k", "w", "role", "T"), ("e", "r", "a", "x", "attribute", None)], "edge string, relation string, key string, value string, part string, type string")
    found = graph.relation_instances(parts)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r["roles"], r["attributes"]) for r in found.collect()] == [({"k": ["v", "w"]}, {"a": ["x"]})]
