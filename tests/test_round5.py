"""What the reports of round 3 found, continued: memory of Python tasks, what is shuffled."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmed.llm.store import written
from quillmed.operators import biblio
from quillmed.operators.store import ALL_KEYS
from quillmed.operators.store import written as kept
from quillmed.plans import base, graph_plans, registry

from test_round3 import agrees


def test_rows_that_are_all_long_reach_python_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    long = spark.range(0, 48, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = [r["n"] for r in written(long.mapInArrow(sizes, "n long"), "batches", 500).collect()]
    assert sum(got) >= 48 << 20 and max(got) < 12 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_an_index_of_words_is_made_inside_the_row(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b a  b\nc\tb A"), (2, ""), (3, None), (4, "x" ), (4, "y y"), (None, "ä ß ä"), (5, "w " * 20000)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    agrees(spark, tmp_path, "p04_abstract_text")
    df = registry.queries()["p04_abstract_text"](spark, str(tmp_path))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    index = spark.createDataFrame([(["b", "a", "b"],), ([],)], "w array<string>").select(biblio.inverted_index(F.col("w")).alias("i"))
    assert [r["i"] for r in index.collect()] == [{"a": [1], "b": [0, 2]}, {}]


def test_facts_are_dealt_by_document_before_their_ids_are_made(spark, small, tmp_path):
    f = graph_plans.facts(spark, small)
    grouped = f.groupBy("doc", "fact_id").count()
    dealt = [x for x in grouped._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert dealt and not any("fact_id" in x for x in dealt)
    before = spark.conf.get(ALL_KEYS)
    both = f.join(f.select("doc", "fact_id", F.lit(1).alias("one")).hint("shuffle_merge"), ["doc", "fact_id"])
    got = kept(both, "both", as_dealt=True)
    assert spark.conf.get(ALL_KEYS) == before and got.count() == both.count() > 0


@pytest.mark.parametrize("name", ["k02_clean_roles", "k07_rekey_facts", "k11_merge_links", "k12_rewrite_link_arguments", "k20_hub_edges", "k26_schema_profile"])
def test_queries_of_facts_agree_in_many_small_tasks(spark, small, monkeypatch, name):
    monkeypatch.setattr(base, "TASK_ROWS", 300)
    agrees(spark, small, name)
