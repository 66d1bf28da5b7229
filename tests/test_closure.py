"""Reachability, cycles and dependency order at any depth."""

import itertools

import pytest

from quillmed.operators import bayes, graph, reach
from quillmed.plans import registry


def edges(spark, pairs):
    return spark.createDataFrame(list(pairs), "parent long, child long")


def brute_reach(pairs):
    out_of, found = {}, {}
    for p, c in pairs:
        if None not in (p, c) and p != c:
            out_of.setdefault(p, set()).add(c)
    for root in out_of:
        level, d = {root: (root,)}, 0
        seen = {root}
        while level:
            d += 1
            nxt = {}
            for n, path in level.items():
                for c in out_of.get(n, ()):
                    if c not in seen:
                        nxt[c] = min(nxt.get(c, path + (c,)), path + (c,))
            found |= {(root, n): (d, path) for n, path in nxt.items()}
            seen |= set(nxt)
            level = nxt
    return found


#: Chains, cycles that refer to cycles, a diamond, self references, repeated and null rows.
ODD = [(1, 2), (2, 3), (3, 2), (4, 5), (5, 6), (6, 6), (7, 8), (8, 9), (9, 7), (9, 2), (10, 7), (11, 10), (12, 4), (13, 14), (13, 15), (14, 16), (15, 16), (13, 16), (13, 16), (None, 3), (3, None), (17, 99)]


def test_reach_equals_brute_force(spark):
    got = reach.reach(edges(spark, ODD), paths=True).collect()
    want = brute_reach(ODD)
    assert {(r["root"], r["node"]): (r["depth"], tuple(r["path"])) for r in got} == want and len(got) == len(want)
    assert {(r["root"], r["node"]) for r in graph.closure(edges(spark, ODD), 2).collect()} == {k for k, (d, _) in want.items() if d <= 2}
    assert reach.reach(edges(spark, [])).count() == 0


def test_many_paths_make_no_more_rows(spark):
    layers = [range(3 * k, 3 * k + 3) for k in range(7)]
    pairs = [p for a, b in zip(layers, layers[1:]) for p in itertools.product(a, b)]
    assert graph.closure(edges(spark, pairs)).count() == sum(3 * 3 * k for k in range(7))


@pytest.mark.parametrize("small", [0, 1000])
def test_components_and_cycles(spark, monkeypatch, small):
    monkeypatch.setattr(reach, "SMALL_CORE", small)
    got = {r["node"]: r["component"] for r in reach.strong_components(edges(spark, ODD)).collect()}
    assert got == {2: 2, 3: 2, 7: 7, 8: 7, 9: 7}


def test_cycles_of_a_network(spark):
    assert {r["variable"] for r in bayes.cycles(edges(spark, ODD)).collect()} == {2, 3, 6, 7, 8, 9}
    assert bayes.cycles(edges(spark, [(1, 2)])).count() == 0 == bayes.cycles(edges(spark, [])).count()


def levels(spark, ids, pairs):
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    return {r["id"]: (r["level"], r["cycle"]) for r in graph.dependency_levels(nodes, edges(spark, pairs)).collect()}


def test_every_fact_stands_after_what_it_refers_to(spark):
    got = levels(spark, [*range(1, 18), 5, None], ODD)
    assert set(got) == set(range(1, 18))
    for p, c in ODD:
        if p is not None and c in got and p != c and (got[p][1] is None or got[p][1] != got[c][1]):
            assert got[p][0] > got[c][0], (p, c)
    early = {13: 2, 14: 1, 15: 1, 16: 0}
    assert {k: got[k] for k in early} == {k: (v, None) for k, v in early.items()}
    assert got[2] == got[3] == (3, 2) and got[6] == (3, 6) and got[5] == (4, None) and got[4] == (5, None) and got[12] == (6, None)
    assert got[7] == got[8] == got[9] == (4, 7) and got[10] == (5, None) and got[11] == (6, None) and got[1] == (4, None)
    assert got[17] == (3, None)  # refers to a fact that isn't there


def test_levels_without_cycles_or_rows(spark):
    assert levels(spark, range(13), [(k, k + 1) for k in range(12)]) == {k: (12 - k, None) for k in range(13)}
    assert levels(spark, [1, 2], []) == {1: (0, None), 2: (0, None)} and levels(spark, [], [(1, 2)]) == {}


def test_joins_of_a_round_leave_edges_where_they_are(spark):
    from quillmed.operators.store import placed

    e = placed(edges(spark, [(k, k + 1) for k in range(20)]), "parent")
    plan = spark.range(5).withColumnRenamed("id", "parent").join(e.hint("shuffle_merge"), "parent")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["k13_closure", "k32_dependency_levels"])
def test_queries_follow_eight_digit_keys(spark, tmp_path, name):
    keys = [12345678 // 10**k for k in range(8)] + [*range(3, 8), 15, 30, 31, 52]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = registry.queries()[name](spark, str(tmp_path))
    assert got.where("root = 12345678").count() == 7 if name == "k13_closure" else got.where("id = 12345678").first()["level"] == 7
