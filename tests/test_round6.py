"""What the reports of round 4 found: what is shuffled and how long it takes on large tables."""

import pytest
from pyspark.sql import functions as F

from quillmed.operators import graph, translation
from quillmed.plans import base, registry
from quillmed.sources import files

from test_round3 import agrees


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]


@pytest.mark.parametrize("coded", [0, 3, 200])
def test_nested_facts_hand_on_their_roles_where_they_lie(spark, small, monkeypatch, coded):
    monkeypatch.setattr(graph, "CODED", coded, raising=False)
    monkeypatch.setattr(base, "TASK_ROWS", 300)
    agrees(spark, small, "k15_nested_facts")
    dealt = exchanges(registry.queries()["k15_nested_facts"](spark, small))
    assert dealt and not any("fact_id" in x for x in dealt)


def test_paths_that_meet_lend_their_roles_twice(spark):
    facts = spark.createDataFrame([(1, f, "p") for f in "fabx"] + [(1, "x", None), (2, "x", "z")], "doc int, fact_id string, predicate string")
    roles = spark.createDataFrame([(1, "x", "who", "A", None, None), (1, "x", None, "B", None, None), (2, "x", "who", "C", None, None)], "doc int, fact_id string, role string, entity string, literal string, datatype string")
    args = spark.createDataFrame([(1, "f", "a", True), (1, "f", "b", True), (1, "a", "x", True), (1, "b", "x", True), (2, "x", "x", False)], "doc int, fact_id string, arg string, nested boolean")
    got = sorted((r["doc"], r["fact_id"], r["role"], r["label"]) for r in graph.nested_roles(roles, facts, args).where("role is not null and predicate is not null").collect())
    two = [(1, "f", "fact_arg", "p"), (1, "f", "fact_arg->fact_arg", "p"), (1, "f", "fact_arg->fact_arg->who", "A")]
    assert got == sorted([*two, *two, (1, "a", "fact_arg", "p"), (1, "a", "fact_arg->who", "A"), (1, "b", "fact_arg", "p"), (1, "b", "fact_arg->who", "A"), (1, "x", "who", "A"), (2, "x", "who", "C"), (2, "x", "fact_arg", "z")])


def test_annotation_files_are_read_as_their_lines_say_without_a_shuffle(spark, tmp_path):
    texts = ["#FORMAT=x\n\n#Text=before any\n1-1\t0-1\tA\t_\n#Doc=7\n0-0\t0-1\tlost\t_\n#Text=a\r\n1-1\t0-1\ta\tX[1]\t\t\n# skipped\n1-2\t2-3\tb\t_\textra\nshort\tline\n\n#Text=empty\n\n#Doc=9\r\n#Text=c\n1-1\t0-1\tc\t_\n#Doc=7\n#Text=again\n1-1\t0-5\tagain\tY\n",
             "#Doc=1\n#Text=#Doc=2\n1-1\t0-1\t#\t_", "", "#Doc=3"]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.tsv").write_bytes(text.encode())
    raw = files.read_documents(spark, str(tmp_path)).select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))
    named = F.when(F.startswith("line", F.lit("#Doc=")), F.substring("line", 6, 1 << 30))
    lines = raw.withColumn("doc", F.last(named, ignorenulls=True).over(graph.Window.partitionBy("path").orderBy("n")))
    want = files.parse_tsv(lines, ["path", "doc"], "n")
    got = files.read_tsv(spark, str(tmp_path))
    key = lambda df: sorted(map(str, (tuple(r) for r in df.select(*want.columns).collect())))
    assert len(key(want)) == 6 and key(got) == key(want) and not exchanges(got)


def test_the_round_trip_shuffles_only_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "DOCUMENTS", 2)
    rows = [(1, "ab  1x, 😀é\t.\n\n  \n q#Doc=4"), (2, None), (3, ""), (4, "the internationalisation\r\nde la #Text=x\r\n"), (5, "x" * 5 + " y" * 3000 + "\n#"), (-6, "\f   a b"), (7, "a\n" * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    agrees(spark, tmp_path, "s05_s08_annotation_round_trip")
    assert not exchanges(registry.queries()["s05_s08_annotation_round_trip"](spark, str(tmp_path)))


@pytest.mark.parametrize("digits", [0, 2, 9])
def test_ranks_at_the_limits_of_rounding_are_exact(spark, monkeypatch, digits):
    monkeypatch.setattr(translation, "BLOCK", 40)
    monkeypatch.setattr(translation, "LIST", 3)
    steps = [0.5, 1.5, 2.5, 0.005, 0.015, 1.005, 5e-10, 1.0000000005, 0.0, 3.0]
    v = [[float(s)] for s in steps for _ in range(30)] + [[s + e] for s in steps for e in (1e-9, -1e-9, 4e-10, 1e-12)]
    e = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "id long, v array<double>")
    q = spark.createDataFrame([(k, "tail", [0.0], [0.0], k) for k in range(0, len(v), 30)], "query long, side string, h array<double>, r array<double>, true_id long")
    score = F.round(F.round(graph.translation_score(F.col("h"), F.col("r"), F.col("v")), 9), digits)
    every = q.crossJoin(e).withColumn("s", score)
    own = every.where("id = true_id").select("query", F.col("s").alias("own"))
    want = {r["query"]: (r["n"], r["a"] + 1, r["a"] + r["t"]) for r in every.join(own, "query").groupBy("query").agg(F.count("*").alias("n"), F.count_if(F.col("s") > F.col("own")).alias("a"), F.count_if(F.col("s") == F.col("own")).alias("t")).collect()}
    assert {r["query"]: (r["n"], r["optimistic"], r["pessimistic"]) for r in graph.true_ranks(q, e, digits).collect()} == want


def test_few_pairs_leave_the_tasks_that_bound_them(spark):
    e = spark.createDataFrame([(k, [float(k % 50), 1.0]) for k in range(2000)], "id long, v array<double>")  # every vector forty times
    q = spark.createDataFrame([(k, [float(k), 0.0], [0.25, 0.0]) for k in range(20)], "query long, h array<double>, r array<double>")
    placed, pivots, stats = translation._cells(e)
    asked = translation._asked(q, pivots, stats, 5)
    assert translation._pairs(asked, placed, stats, [], translation._nearest(5), 5).count() <= 20 * 5 * 2 * len(stats) < translation._pairs(asked, placed, stats, []).count() * 20
    assert [(r["id"], r["rank"]) for r in graph.rank_tails(q, e, 5).where("query = 7").orderBy("rank").collect()] == [(7, 1), (57, 2), (107, 3), (157, 4), (207, 5)]


@pytest.mark.parametrize("name, shuffled", [("k23_link_edges", 0), ("k16_argument_pairs", 1), ("k20_hub_edges", 1)])
def test_links_and_facts_stay_dealt_by_document(spark, small, monkeypatch, name, shuffled):
    monkeypatch.setattr(base, "TASK_ROWS", 300)
    agrees(spark, small, name)
    dealt = [x for x in exchanges(registry.queries()[name](spark, small)) if "hashpartitioning" in x and "custkey" not in x and "orderkey" not in x]
    assert len(dealt) == shuffled


def test_links_with_nulls_and_equal_labels(spark):
    links = spark.createDataFrame([(1, "l1", "p", ["a", "b", "a", None]), (1, "l2", None, ["l1", "c"]), (None, "l3", "p", ["a", "b"]), (2, "l1", "q", ["a"])], "doc int, id string, predicate string, arguments array<string>")
    nodes = spark.createDataFrame([(1, "b", "TimestampNode"), (1, "a", "TimestampNode"), (1, "p", "PredicateNode"), (1, None, "TimestampNode"), (None, "b", "x"), (2, "a", "x"), (3, "q", "x")], "doc int, id string, type string")
    got = sorted((r["doc"], r["src"], r["dst"], r["label"]) for r in graph.link_edges(links, nodes).collect())
    assert got == [(1, "l1", "b", "argument"), (1, "l1", "p", "predicate"), (1, "l2", "l1", "argument"), (2, "l1", "a", "argument")]
    labels = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "b", None), (1, "l1", "y"), (1, "c", "z"), (None, "a", "w"), (2, "b", "v")], "doc int, id string, label string")
    pairs = {(r["s"], r["p"], r["o"]): r["n"] for r in graph.argument_pairs(links.withColumn("suffix", F.lit("#")).where("predicate is not null").unionByName(links.where("id = 'l2'").withColumns({"predicate": F.lit("q"), "suffix": F.lit(None).cast("string")})), labels).collect()}
    assert pairs == {("x", "p#", "x"): 4, ("x", "p#", None): 2, (None, "p#", "x"): 2, ("y", "q", "z"): 1, ("z", "q", "y"): 1}


def test_a_vertex_of_two_documents_is_counted_once(spark, small, tmp_path):
    for t in ("lineitem", "orders", "part", "customer", "supplier"):
        d = spark.read.parquet(f"{small}/{t}.parquet")
        (d.unionAll(d.withColumn("o_custkey", F.col("o_custkey") + 1)) if t == "orders" else d).write.parquet(str(tmp_path / f"{t}.parquet"))
    agrees(spark, tmp_path, "k20_hub_edges")


def test_pairs_that_cannot_tie_are_only_counted(spark):
    e = spark.createDataFrame([(k, [float(k % 50) / 7, 1.0]) for k in range(2000)], "id long, v array<double>")
    q = spark.createDataFrame([(k, "tail", [k / 3, 0.0], [0.25, 0.0], -k / 5, k / 5 - 0.02, k / 5 + 0.02) for k in range(1, 20)], "query long, side string, h array<double>, r array<double>, own double, low double, limit double")
    placed, pivots, stats = translation._cells(e)
    asked = translation._asked(q, pivots, stats, None)
    got = translation._pairs(asked, placed, stats, ["side", "own"], translation._against(2), 1)
    assert got.where("id is not null").count() == 0 and got.count() <= 19 * len(stats)
