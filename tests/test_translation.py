"""Ranks by translation distance: pivots prune, results stay exact."""

import numpy as np
import pytest

from quillmed.operators import graph, translation


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6)) * 20
    v = np.concatenate((centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6)), np.repeat(centres[:1], 300, axis=0)))  # a third of all are one vector
    return v, spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>").repartition(4)


def asked(spark, v):
    rng = np.random.default_rng(5)
    rows = [(q, "tail" if q % 2 else "head", v[q].tolist(), rng.normal(size=6).tolist(), int(rng.integers(0, len(v)))) for q in range(0, 900, 30)]
    return rows, spark.createDataFrame(rows, "query long, side string, h array<double>, r array<double>, true_id long")


def scores(v, h, r):
    return np.round(-np.sqrt(((np.array(h) + np.array(r) - v) ** 2).sum(axis=1)), 9)


def test_tails_equal_brute_force(spark, vectors, monkeypatch):
    v, e = vectors
    rows, q = asked(spark, v)
    monkeypatch.setattr(translation, "BLOCK", 50)
    monkeypatch.setattr(translation, "LIST", 4)
    monkeypatch.setattr(translation, "LISTS", 2)
    got = {}
    for r in graph.rank_tails(q, e, 7).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], r["score"]))
    assert len(got) == len(rows)
    for query, _, h, rel, _ in rows:
        s = scores(v, h, rel)
        order = sorted(range(len(v)), key=lambda k: (-s[k], k))[:7]
        assert [(k, i) for k, i, _ in sorted(got[query])] == [(k + 1, i) for k, i in enumerate(order)]


@pytest.mark.parametrize("digits", [1, 9])
def test_true_ranks_equal_brute_force(spark, vectors, digits):
    v, e = vectors
    rows, q = asked(spark, v)
    got = {(r["query"], r["side"]): (r["n"], r["optimistic"], r["pessimistic"], r["realistic"]) for r in graph.true_ranks(q, e, digits).collect()}
    for query, side, h, rel, true in rows:
        s = np.round(scores(v, h, rel), digits)
        above, ties = int((s > s[true]).sum()), int((s == s[true]).sum())
        assert got[query, side] == (len(v), above + 1, above + ties, (above + 1 + above + ties) / 2)


def test_few_pairs_are_scored(spark, vectors):
    v, e = vectors
    rows, q = asked(spark, v)
    placed, pivots, stats = translation._cells(e)
    pairs = translation._pairs(translation._asked(q.select("query", "h", "r"), pivots, stats, 5), placed, stats, []).count()
    assert pairs < 0.35 * len(rows) * len(v)


def test_few_entities(spark):
    e = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, v array<double>")
    q = spark.createDataFrame([(9, "head", [0.0, 0.0], [0.0, 0.0], 2)], "query long, side string, h array<double>, r array<double>, true_id long")
    assert [(r["id"], r["score"], r["rank"]) for r in graph.rank_tails(q, e, 5).orderBy("rank").collect()] == [(1, 0.0, 1), (2, -5.0, 2)]
    assert graph.true_ranks(q, e).first()["optimistic"] == 2
    assert graph.rank_tails(q, e.limit(0), 5).count() == 0 == graph.rank_tails(q.limit(0), e, 5).count()
