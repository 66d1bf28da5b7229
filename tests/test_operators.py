"""Small hand-made cases: quirks, fixtures and properties."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmed.functions import scalars as S
from quillmed.operators import bayes, biblio, dialog, findings, fuzzy, graph, lab, spans, trend
from quillmed.sources import files


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def series(spark, *values, entity=1, test="x"):
    return spark.createDataFrame([(entity, test, day(i), v, i) for i, v in enumerate(values)], "entity long, test string, ts timestamp_ntz, value double, ord long")


def test_parse_values_and_ranges(spark):
    d = spark.createDataFrame([("1,5", "< 50"), (" 856.176 ", "> 1,5"), ("1\u202f200", "32 - 48"), ("Negatif (-)", " - 7"), (None, None), ("", "<5"), ("x", "0 - 1.75 IU"), ("3", "a - b - c")], "v string, r string")
    got = d.select(S.parse_value(F.col("v")).alias("v"), S.parse_range(F.col("r")).alias("r")).collect()
    assert [r["v"] for r in got] == [1.5, 856.176, 1200.0, None, None, None, None, 3.0]
    assert [(r["r"]["low"], r["r"]["high"]) for r in got] == [(None, 50.0), (1.5, None), (32.0, 48.0), (None, 7.0), (None, None), (None, None), (None, None), (None, None)]


def test_wide_csv_with_breaks_round_trips(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text('Test,2024-03-12 08:59,Unit\n"Bakır\n(Cu)","9,99",U/L\nB,,\n', encoding="utf-8")
    df = files.read_wide_csv(spark, str(path), ["Test", "2024-03-12 08:59", "Unit"])
    long = lab.unpivot_dates(df, ["Test", "Unit"])
    assert [tuple(r) for r in long.collect()] == [("Bakır\n(Cu)", "U/L", "2024-03-12 08:59", "9,99")]


def test_metadata_csv_defaults(spark, tmp_path):
    path = tmp_path / "meta.csv"
    head = "Test Name,sex,normal_low,normal_high,normal_unit,normal_comp,normal_change_low,normal_change_high,normal_change_unit,normal_change_time_days,normal_change_per_day_low,normal_change_per_day_high,sharp_change_parsed,sharp_change_aggregated_low,sharp_change_aggregated_high"
    path.write_text(head + "\nA,,1.5,3,U/L,,,,,,,,,,\nB,female,,3,,,,,,,,,\"[{\"\"comp\"\": \"\">\"\"}]\",,\n", encoding="utf-8")
    got = files.read_metadata_csv(spark, str(path)).select("test", "sex", "normal_low", "sharp_change_parsed").collect()
    assert [tuple(r) for r in got] == [("A", "Both", 1.5, None), ("B", "Female", None, '[{"comp": ">"}]')]


def test_graph_json_and_fact_cleaning(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"graph_type": "t",\n "facts": [{"id": "F1", "predicate": "p", "tuple": [{"role": "r", "val": "5", "type": "int"}, {"role": "s"}]}, {"id": "F2", "predicate": "q"}]}')
    f = files.read_graph_json(spark, str(tmp_path / "f.json")).select(F.lit("d").alias("doc"), F.explode("facts").alias("f"))
    facts = f.select("doc", F.col("f.id").alias("fact_id"))
    roles = f.select("doc", F.col("f.id").alias("fact_id"), F.explode("f.tuple").alias("t")).select("doc", "fact_id", "t.*")
    assert [r["fact_id"] for r in graph.clean_facts(facts, roles, roles.limit(0)).collect()] == ["F1"]
    assert {(r["role"], r["literal"], r["datatype"]) for r in graph.clean_roles(roles).collect()} == {("r", "5", "int"), ("s", "unknown", None)}


def test_triples_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "p", "b"), ("c", "q", "d")], "head string, relation string, tail string")
    for kind in ("csv", "json", "parquet"):
        files.write_table(df, str(tmp_path / kind), kind)
    files.write_table(df.coalesce(1), str(tmp_path / "tsv"), "tsv")
    assert files.read_triples(spark, str(tmp_path / "tsv")).where("head <> 'head'").count() == 2
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == spark.read.json(str(tmp_path / "json")).count() == 2
    files.write_table(df, str(tmp_path / "by"), "parquet", ["relation"])
    assert spark.read.parquet(str(tmp_path / "by")).where("relation = 'p'").count() == 1


def test_annotation_files_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(7, 0, "Fever and cough."), (7, 1, "No pain")], "doc_id int, sent_id int, sentence string")
    t = spans.token_table(s).withColumn("tag", F.when(F.col("token").isin("Fever", "cough"), "SYM").otherwise("_")).join(s, ["doc_id", "sent_id"])
    files.write_tsv(t, str(tmp_path / "out"))
    text = "\n".join(p.read_text() for p in (tmp_path / "out").rglob("*.txt"))
    assert text.splitlines()[:4] == ["#Doc=7", "#Text=Fever and cough.", "1-1\t0-5\tFever\tSYM", "1-2\t6-9\tand\t_"]
    (tmp_path / "one.tsv").write_text("#FORMAT=WebAnno TSV 3.3\n\n" + text + "\nbad line\n")
    back = files.read_tsv(spark, str(tmp_path / "one.tsv"))
    assert back.count() == 6 and {r["token"] for r in back.where("tag = 'SYM'").collect()} == {"Fever", "cough"} and {r["doc"] for r in back.collect()} == {"7"}
    many = t.unionAll(t.withColumn("doc_id", F.lit(8))).unionAll(t.withColumn("doc_id", F.lit(30)))
    files.write_tsv(many, str(tmp_path / "many"), documents=1)
    again = files.read_tsv(spark, str(tmp_path / "many"))
    assert {(r["doc"], r["n"]) for r in again.groupBy("doc").agg(F.count("*").alias("n")).collect()} == {("7", 6), ("8", 6), ("30", 6)} and again.select("path").distinct().count() > 1
    (tmp_path / "bare.tsv").write_text("#Text=No pain\n1-1\t0-2\tNo\t_\n")
    assert files.read_tsv(spark, str(tmp_path / "bare.tsv")).first()["doc"] is None


def test_scores_count_empty_sentences(spark):
    sents = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "doc_id int, sent_id int")
    span = "doc_id int, sent_id int, start int, end int, label string"
    g = spark.createDataFrame([(1, 0, 0, 1, "A"), (1, 0, 2, 3, "B")], span)
    p = spark.createDataFrame([(1, 0, 0, 1, "A"), (1, 1, 0, 1, "A")], span)
    m = spans.macro(spans.sentence_scores(g, p, sents)).first()
    assert (m["n"], m["tp"], m["fp"], m["fn"]) == (3, 1, 1, 1) and abs(m["recall"] - 0.5 / 3) < 1e-12
    assert spans.macro(spans.sentence_scores(g, p, sents), skip_empty=True).first()["n"] == 2


def test_trend_labels(spark):
    label = lambda *v: findings.trend(series(spark, *v)).first()["trend"]
    assert label(1.0) == "No Trend" and label(1.0, 2.0, 3.0) == "Up" and label(3.0, 2.0) == "Down"
    assert label(100.0, 101.0, 101.0, 100.0) == "Stable" and label(1.0, 9.0, 1.0, 9.0, 1.0) == "Fluctuating"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 50), min_size=2, max_size=8))
def test_rising_series_trend_up(spark, gaps):
    values, at = [], 0.0
    for g in gaps:
        at += g
        values.append(at)
    assert findings.trend(series(spark, *values)).first()["trend"] == "Up"


def test_status_without_bounds_is_unknown(spark):
    d = series(spark, 5.0).withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
    assert findings.latest_status(d, spark.createDataFrame([], "test string, low double, high double")).first()["status"] == "Unknown"


def slope_by_hand(points):
    """points: (hours since the first one, value)."""
    import statistics

    slopes = [(y - x) / (int(b // 24) - int(a // 24)) for k, (a, x) in enumerate(points) for b, y in points[k + 1:] if int(a // 24) != int(b // 24)]
    return statistics.median(slopes) if slopes else 0.0


def test_theil_sen_takes_whole_days_and_series_of_any_length(spark, monkeypatch):
    import random

    monkeypatch.setattr(findings, "GUESSES", 63)

    rng, made = random.Random(3), {}
    for e, (n, step) in enumerate(((3, 18), (7, 5), (40, 7), (41, 30), (230, 11), (12, 0), (60, 1))):
        at = sorted(rng.randrange(max(1, n * step)) for _ in range(n))
        made[e] = [(h - at[0], float(rng.randrange(20)) if e % 2 else rng.gauss(0, 5) + h / 9) for h in at]
    rows = [(e, "x", day(0) + dt.timedelta(hours=h), v, k) for e, pts in made.items() for k, (h, v) in enumerate(pts)]
    d = spark.createDataFrame(rows, "entity long, test string, ts timestamp_ntz, value double, ord long")
    for limit in (200, 10):
        for r in findings.theil_sen(d, all_pairs=limit).collect():
            assert abs(r["slope"] - slope_by_hand(made[r["entity"]])) < 1e-9


def test_a_series_of_six_thousand_points_has_a_slope(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(findings, "RUN", 1000)
    monkeypatch.setattr(findings, "GUESSES", 7)
    monkeypatch.setattr(findings, "CLOSE", 1e-10)
    rng = np.random.default_rng(4)
    days, values = np.arange(6000) // 2, rng.normal(size=6000) + np.arange(6000) * 0.01
    d = spark.createDataFrame([(1, "x", day(int(a)), float(v), k) for k, (a, v) in enumerate(zip(days, values))], "entity long, test string, ts timestamp_ntz, value double, ord long")
    i, j = np.triu_indices(6000, 1)
    apart = days[j] != days[i]
    want = np.median((values[j] - values[i])[apart] / (days[j] - days[i])[apart])
    assert abs(findings.theil_sen(d).first()["slope"] - want) < 1e-8


def test_ewma_matches_recurrence(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    got = [r["e"] for r in trend.with_ewma(series(spark, *values)).withColumnRenamed("ewma", "e").orderBy("ts").collect()]
    num = den = 0.0
    for v, e in zip(values, got):
        num, den = v + 0.5 * num, 1 + 0.5 * den
        assert abs(num / den - e) < 1e-12


def test_constant_series_forecasts_itself(spark):
    f = fuzzy.forecast(series(spark, 4.0, 4.0, 4.0, 6.0)).first()
    assert (f["state"], f["forecast"], f["direction"]) == (1, 4.0, "Unchanged")


def test_resample_keeps_empty_bins_and_fills(spark):
    d = series(spark, 1.0, 2.0).unionByName(spark.createDataFrame([(1, "x", day(9), 8.0, 9)], "entity long, test string, ts timestamp_ntz, value double, ord long"))
    r = trend.resample(d, "3 days")
    assert [x["value"] for x in r.orderBy("bin").collect()] == [1.5, None, None, 8.0]
    assert [round(x["value"], 6) for x in trend.interpolate(r).orderBy("bin").collect()] == [1.5, 3.666667, 5.833333, 8.0]


def test_tags_and_spans_round_trip(spark):
    t = spark.createDataFrame([(1, 0, i, w, tag) for i, (w, tag) in enumerate([("a", "X[1]"), ("b", "X[1]"), ("c", "_"), ("d", "Y|Z"), ("e", "X[2]")])], "doc_id int, sent_id int, pos int, token string, tag string")
    s = spans.tags_to_spans(t)
    assert {(r["start"], r["end"], r["label"], r["text"]) for r in s.collect()} == {(0, 2, "X", "a b"), (3, 4, "Y", "d"), (4, 5, "X", "e")}
    again = spans.tags_to_spans(spans.spans_to_tags(t.drop("tag"), s))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in s.collect()}


def test_closure_cuts_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    got = {(r["root"], r["node"]) for r in graph.closure(e, 5).collect()}
    assert ("a", "d") in got and ("d", "a") not in got
    assert {r["variable"] for r in bayes.cycles(e).collect()} == {"a", "b", "c"}


def test_posterior_sums_to_one_and_reverses(spark):
    d = spark.createDataFrame([("r", "w")] * 3 + [("r", "d")] + [("s", "d")] * 4, "rain string, grass string")
    j = bayes.joint([bayes.fit(d, "rain"), bayes.fit(d, "grass", ["rain"])])
    p = {r["state"]: r["p"] for r in bayes.posterior(j, "rain", {"grass": "w", "other": ""}).collect()}
    assert p == {"r": 1.0, "s": 0.0} or p == {"r": 1.0}
    assert abs(sum(r["p"] for r in bayes.posterior(j, "rain", {}).collect()) - 1) < 1e-12


def test_links_resolve(spark):
    d = spark.createDataFrame([("https://h.org/a/b.html?x=1", h) for h in ("c.pdf", "/c.pdf", "//o.org/c.pdf", "http://z.org/c.pdf")], "url string, h string")
    got = [r[0] for r in d.select(biblio.resolve(F.col("url"), F.col("h"))).collect()]
    assert got == ["https://h.org/a/c.pdf", "https://h.org/c.pdf", "https://o.org/c.pdf", "http://z.org/c.pdf"]
    html = '<a href="x"></a><iframe src="v.pdf"></iframe><meta http-equiv="refresh" content="0; url=/r.pdf"><a class="k" href="q">Full PDF</a>'
    p = spark.createDataFrame([(1, "http://h.org/", html)], "id int, url string, html string")
    assert [(r["kind"], r["link"]) for r in biblio.candidate_links(p, "id", "pdf").orderBy("rank").collect()] == [("iframe", "http://h.org/v.pdf"), ("refresh", "http://h.org/r.pdf"), ("anchor", "http://h.org/q")]


def test_gates(spark):
    d = spark.createDataFrame([(g, n, k) for g in ("-", "NOT", "AND", "OR", "XOR", "NAND", "NOR", "NXOR") for n, k in ((2, 0), (2, 1), (2, 2))], "g string, n int, k int")
    got = {(r["g"], r["k"]): r["v"] for r in d.withColumn("v", dialog.gate(F.col("g"), F.col("n"), F.col("k"))).collect()}
    assert [got["XOR", k] for k in (0, 1, 2)] == [False, True, False] and [got["NXOR", k] for k in (0, 1, 2)] == [True, False, True]
    assert [got["NAND", k] for k in (0, 1, 2)] == [True, True, False]


def test_row_order_never_matters(spark):
    d = series(spark, 5.0, 3.0, 8.0, 2.0, 9.0)
    a, b = (trend.profile(x, 4.0, 7.0).orderBy("ord").collect() for x in (d, d.orderBy(F.desc("value"))))
    assert a == b


def label_by_hand(names, reserved):
    used, out = set(reserved), []
    for n in names:
        stem = n.strip().lower().replace(" ", "_").replace("-", "_")
        k, label = 0, stem
        while label in used:
            k += 1
            label = f"{stem}_{k}"
        used.add(label)
        out.append(label)
    return out


def test_labels_are_unique_in_order(spark):
    import random

    rng = random.Random(2)
    for names in (["a", "a", "a_1"], ["a_1", "a", "a", "A"], ["rule", "rule_1", "Rule", "x"], [rng.choice(["a", "a_1", "a_1_1", "b", "b_2", "rule", "a 2"]) for _ in range(60)]):
        d = spark.createDataFrame(list(enumerate(names)), "k int, name string")
        got = [r["unique_label"] for r in graph.unique_labels(d, "name", ["k"], ["rule"]).orderBy("k").collect()]
        assert got == label_by_hand(names, ["rule"]) and len(set(got)) == len(got)


def test_links_differ_in_any_field(spark):
    schema = "doc int, id string, link_type string, predicate string, arguments array<string>, truth_value array<double>, attributes map<string,string>"
    one = ["E", "p", ["a", "b"], [0.5], {"k": "1", "m": "2"}]
    rows = [(1, "x1", *one), (1, "x2", *one[:4], {"m": "2", "k": "1"}), (1, "x3", *one[:3], [0.9], one[4]), (1, "x4", *one[:4], {"k": "2"}), (1, "x5", *one[:3], None, one[4]), (2, "x1", *one)]
    got = {(r["doc"], r["id"]): (r["canonical"], r["first"]) for r in graph.merge_links(spark.createDataFrame(rows, schema), ["id"]).collect()}
    assert got == {(1, "x1"): ("L1", True), (1, "x2"): ("L1", False), (1, "x3"): ("L2", True), (1, "x4"): ("L3", True), (1, "x5"): ("L4", True), (2, "x1"): ("L1", True)}


def test_arguments_that_are_no_strings_go(spark):
    d = spark.createDataFrame([('["a", 1, {"b": "c"}, null, "2", ["x"], true]',), ("[]",), ("nothing",), (None,)], "j string")
    assert [r["a"] for r in d.select(graph.string_arguments(F.col("j")).alias("a")).collect()] == [["a", "2"], [], None, None]


def test_nested_facts_lend_their_roles(spark):
    facts = spark.createDataFrame([(1, "f", "p"), (1, "g", "q"), (1, "h", "r")], "doc int, fact_id string, predicate string")
    roles = spark.createDataFrame([(1, "f", "p", "who", "A", None, None), (1, "g", "q", "what", None, "5", "int"), (1, "h", "r", "who", "C", None, None)], "doc int, fact_id string, predicate string, role string, entity string, literal string, datatype string")
    args = spark.createDataFrame([(1, "f", "g", True), (1, "g", "h", True), (1, "h", "f", True), (1, "f", "lost", False)], "doc int, fact_id string, arg string, nested boolean")
    of_f = {(r["role"], r["label"]) for r in graph.nested_roles(roles, facts, args).where("fact_id = 'f'").collect()}
    assert of_f == {("who", "A"), ("fact_arg", "q"), ("fact_arg->what", "5/int"), ("fact_arg->fact_arg", "r"), ("fact_arg->fact_arg->who", "C"), ("fact_arg->fact_arg->fact_arg", "p")}
    triples = {(r["s"], r["p"], r["o"]) for r in graph.nested_role_pairs(roles, facts, args).collect()}
    assert ("A", "[who]:p:[fact_arg->what]", "5/int") in triples and ("q", "[fact_arg]:p:[who]", "A") in triples


def test_span_arrays_agree_with_span_rows(spark):
    tags = ["X[1]", "X[1]", "_", "Y|Z", "X[2]", "X", "X", "_", "", "Y"]
    d = spark.createDataFrame([(1, 0, [f"t{k}" for k in range(10)], tags), (1, 1, [], []), (2, 0, ["a"], ["_"])], "doc_id int, sent_id int, tokens array<string>, tags array<string>")
    inside = spans.span_rows(d.withColumn("spans", spans.spans_in_place(F.col("tokens"), F.col("tags"))))
    t = d.select("doc_id", "sent_id", F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "z")).select("doc_id", "sent_id", "pos", F.col("z.tokens").alias("token"), F.col("z.tags").alias("tag"))
    rows = spans.tags_to_spans(t)
    assert {tuple(r) for r in inside.collect()} == {tuple(r) for r in rows.select(*inside.columns).collect()} and inside.count() == 5


def test_row_priors_replace_the_root(spark):
    age = spark.createDataFrame([("young", 0.6), ("old", 0.4)], "age string, p double")
    ill = spark.createDataFrame([("young", "yes", 0.1), ("young", "no", 0.9), ("old", "yes", 0.5), ("old", "no", 0.5)], "age string, ill string, p double")
    e = spark.createDataFrame([(1, None, "yes", None), (2, None, "yes", {"young": 0.2, "old": 0.8}), (3, None, None, {"young": 1.0, "old": 0.0}), (4, "old", None, {"young": 0.2, "old": 0.8})], "k int, age string, ill string, prior map<string,double>")
    got = {(r["k"], r["variable"], r["state"]): r["p"] for r in bayes.score_with_priors(e, "k", ["age", "ill"], {"age": age, "ill": ill}, {"age": "prior"}).collect()}
    assert abs(got[1, "age", "old"] - 0.2 / 0.26) < 1e-12 and abs(got[2, "age", "old"] - 0.4 / 0.42) < 1e-12
    assert abs(got[3, "ill", "yes"] - 0.1) < 1e-12 and got[4, "ill", "no"] == 0.5 and got[4, "age", "old"] == 1.0


def test_any_number_of_queries_is_ranked(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(1300, 3))
    e = spark.createDataFrame([(k, [float(x) for x in v[k]]) for k in range(1300)], "id int, v array<double>")
    q = e.select(F.col("id").alias("query"), F.col("v").alias("h"), F.array(*(F.lit(0.0),) * 3).alias("r"))
    top = graph.rank_tails(q, e, 1).collect()
    assert len(top) == 1300 and all(r["id"] == r["query"] for r in top)
    r = graph.true_ranks(q.withColumn("side", F.lit("tail")).withColumn("true_id", F.col("query")), e)
    assert r.where("optimistic = 1 and pessimistic = 1 and n = 1300").count() == 1300
