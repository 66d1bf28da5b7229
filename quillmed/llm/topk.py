"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Vectors of a bucket (candidates) and of a block (queries).
BUCKET = 4096
BLOCK = 1024
#: Squared lengths of one level differ by this factor at most.
LEVEL = 1.05
#: A table of levels is broadcast up to this many rows (all doubles have 15,000 levels for a dimension).
FEW_LEVELS = 100_000
#: Local cosine thresholds from which coordinates prune more than lengths do.
COORDINATES_FROM = 0.3


def _numbers(np, column, dim):
    """(rows, dim) int64 of a list column without nulls."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    return flat.reshape(-1, dim) if len(flat) else np.zeros((0, dim), np.int64)


def _bounds(np, q, t):
    """Range of a unit vector's coordinate, given the query's unit coordinate q, that allows a cosine of t or more."""
    if t <= -1:
        return -1.0, 1.0
    root = float(np.sqrt(max(0.0, (1 - t * t) * (1 - q * q))))
    low = -1.0 if q < 0 and q <= -t else q * t - root
    high = 1.0 if q > 0 and q >= t else q * t + root
    return low - 1e-9, high + 1e-9


def search_bucket(np, ids, vecs, q_ids, qs, floors, k, same_table=True):
    """The k best rows of one bucket for each query: lists (query position, id, score).

    floors[i] is a score that the query's k-th best is known to reach, or None. The bucket's
    local cosine threshold is floor / (query length * greatest length of the bucket): above 1
    nothing here can matter; when high, the query's largest coordinate prunes; when low, rows
    too short to reach the floor go. What is left is verified by whole integer products.
    """
    if not len(ids):
        return []
    lengths = np.sqrt((vecs.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -lengths))
    ids, vecs, lengths = ids[order], vecs[order], lengths[order]
    unit = vecs / np.maximum(lengths, 1e-300)[:, None]
    exact = float(np.abs(vecs.astype(np.float64)).max(initial=0)) * float(np.abs(qs.astype(np.float64)).max(initial=0)) * vecs.shape[1] < 2.0**52
    table = vecs.astype(np.float64) if exact else vecs.astype(object)
    sorted_by: dict = {}
    out = []
    for i in range(len(q_ids)):
        q = qs[i]
        q_len = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        floor, rows = floors[i], None
        if floor is not None and floor > 0 and q_len > 0:
            safe = floor * (1 - 1e-9) - 1e-6
            t = safe / (q_len * max(lengths[0], 1e-300))
            if t > 1 + 1e-9:
                continue
            if t >= COORDINATES_FROM:
                f = int(np.argmax(np.abs(q)))
                if f not in sorted_by:
                    by = np.argsort(unit[:, f], kind="stable")
                    sorted_by[f] = by, unit[by, f]
                by, values = sorted_by[f]
                low, high = _bounds(np, float(q[f]) / q_len, min(t, 1.0))
                rows = by[np.searchsorted(values, low):np.searchsorted(values, high, side="right")]
            else:
                rows = slice(0, int(np.searchsorted(-lengths, -safe / q_len, side="right")))
        part = slice(None) if rows is None else rows
        cand = ids[part]
        scores = table[part] @ (q.astype(np.float64) if exact else q.astype(object))
        if not exact:
            scores = np.maximum(np.minimum(scores, (1 << 63) - 1), -(1 << 63))
        keep = cand != q_ids[i]
        cand, scores = cand[keep], scores[keep]
        if floor is not None:
            keep = scores >= floor
            cand, scores = cand[keep], scores[keep]
        if len(cand) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k] if exact else sorted(scores)[-k]
            keep = scores >= kth
            cand, scores = cand[keep], scores[keep]
        best = sorted(zip((-int(s) for s in scores), cand.tolist()))[:k]
        out += [(int(q_ids[i]), int(c), -s) for s, c in best]
    return out


def vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v array<long>, len2): components floor(scale * x), x as double. Vectors that are
    null, or hold a null or non-finite component, take no part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    ok = embeddings.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(~F.coalesce(bad, F.lit(False)))
    v = ok.select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))
    return v.withColumn("len2", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))


def _level(len2: Column) -> Column:
    """The level of a squared length: higher for longer vectors."""
    return F.floor(F.log(len2 + 1) / math.log(LEVEL)).cast("int")


def ahead_of(level: str) -> Column:
    """The sum of n over higher levels of the dimension."""
    return F.coalesce(F.sum("n").over(Window.partitionBy("dim").orderBy(F.desc(level)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _near(df: DataFrame) -> DataFrame:
    """A written table with a row for each level or dimension as the small side of a join: its size is checked."""
    return F.broadcast(df) if df.count() <= FEW_LEVELS else df.hint("shuffle_merge")


def top_k(embeddings: DataFrame, is_query, k: int = 5, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row chosen by is_query the k highest integer
    inner products among all other rows, ties to the smaller vec_id.

    Levels hold vectors of like length and are cut into buckets. Blocks of queries first meet the
    longest vectors (two buckets' worth at most), which gives every query a score that its k-th best reaches, and so the
    least length that can still matter to it. Queries are then dealt into blocks by that length, and
    only buckets of that level or above are copied for a block: pairs are pruned before
    anything is copied. Inside a pair the bucket's local cosine threshold prunes further. All
    tables of levels and blocks stay tables; blocks meet buckets by an equality join, each
    bucket returns its k best at most, and those are ranked per query.

    Rows alike in vec_id and vector are one. A vec_id with several different vectors asks with
    each, and its answers are ranked together; rows that share the query's vec_id are its own, never
    candidates. Vectors whose dimension differs from the query's share no bucket with it. Fewer
    than k other rows give as many as there are. Components beyond the range of a long are cut
    to it (by floor), and so are scores.
    """
    rows = written(vectors(embeddings), "topk-vectors")
    if not rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rows = written(rows.dropDuplicates(["vec_id", "v"]), "topk-vectors")
    rows = rows.withColumn("dim", F.size("v")).withColumn("level", _level(F.col("len2")))

    # levels, longest first; `ahead` counts the longer vectors
    by_level = rows.groupBy("dim", "level").agg(F.count("*").alias("n"))
    levels = written(by_level.withColumn("ahead", ahead_of("level")).withColumn("parts", F.ceil(F.col("n") / bucket).cast("int")), "topk-levels")
    whole, some = F.col("ahead") + F.col("n") <= bucket, F.col("ahead") < bucket
    dealt = (rows.join(_near(levels), ["dim", "level"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
             .withColumn("head", whole | (some & (F.col("part") == 0))).select("vec_id", "v", "dim", "level", "part", "head"))
    queries = rows.where(is_query)
    n_blocks = max(1, math.ceil(queries.count() / block))
    asked = written(queries.select("vec_id", "v", "len2", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block")), "topk-queries")
    schema = "query_id long, dim int, vec_id long, score long"

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        dim = key[0].as_py()
        cand = left.column("vec_id").to_numpy(), _numbers(np, left.column("v").combine_chunks(), dim)
        q = right.column("vec_id").to_numpy(), _numbers(np, right.column("v").combine_chunks(), dim)
        got = search_bucket(np, *cand, *q, right.column("floor").to_pylist(), k)
        cols = list(zip(*got)) if got else [(), (), ()]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array([dim] * len(got), pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["query_id", "dim", "vec_id", "score"])

    # every block meets the longest vectors
    used = written(asked.groupBy("dim").agg(F.collect_set("block").alias("blocks")), "topk-blocks")  # a row for each dimension, a number for `block` queries
    first = dealt.where("head").join(_near(used), "dim").select("dim", F.explode("blocks").alias("block"), "vec_id", "v")
    opening = asked.select("dim", "block", "vec_id", "v", F.lit(None).cast("long").alias("floor"))
    head = written(first.groupBy("dim", "block").cogroup(opening.groupBy("dim", "block")).applyInArrow(run, schema), "topk-head")
    floors = head.groupBy("query_id", "dim").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)

    # queries by the least length that matters to them
    need = F.greatest(F.lit(0.0), F.coalesce(F.col("floor") / F.nullif(F.sqrt("len2"), F.lit(0.0)), F.lit(0.0))) * (1 - 1e-6)
    known = (asked.drop("block").join(floors.select(F.col("query_id").alias("vec_id"), "dim", "floor").hint("shuffle_merge"), ["vec_id", "dim"], "left")
             .withColumn("needs", _level(need * need)))
    known = written(known, "topk-known")
    wanted = known.groupBy("dim", "needs").agg(F.count("*").alias("n"))
    wanted = written(wanted.withColumn("ahead", ahead_of("needs")), "topk-needs")
    spot = F.col("ahead") + F.pmod(F.xxhash64("vec_id"), F.col("n"))
    blocked = written(known.join(_near(wanted), ["dim", "needs"]).select("dim", "vec_id", "v", "floor", "needs", F.floor(spot / block).cast("int").alias("block")), "topk-blocked")
    blocks = blocked.groupBy("dim", "block").agg(F.min("needs").alias("level"))

    # a level's blocks are those from `from_block` on, as blocks are numbered by falling needs
    line = Window.partitionBy("dim").orderBy("level").rangeBetween(Window.unboundedPreceding, 0)
    both = blocks.select("dim", "level", "block").unionByName(levels.where(~whole).select("dim", "level", F.lit(None).cast("int").alias("block")))
    met = both.withColumn("from_block", F.min("block").over(line)).where("block is null and from_block is not null").select("dim", "level", "from_block")
    last = blocks.groupBy("dim").agg(F.max("block").alias("last_block"))
    meets = written(met.join(last.hint("shuffle_merge"), "dim").join(levels.select("dim", "level", "parts").hint("shuffle_merge"), ["dim", "level"]), "topk-meets")
    copies = (dealt.where("not head").join(_near(meets.drop("parts")), ["dim", "level"])
              .select("dim", "level", "part", F.explode(F.sequence("from_block", "last_block")).alias("block"), "vec_id", "v"))
    table = written(meets.groupBy("dim").agg(F.collect_list(F.struct("level", "from_block", "parts")).alias("levels")), "topk-table")  # a row for each dimension
    mine = F.filter("levels", lambda x: x["from_block"] <= F.col("block"))
    asks = (blocked.join(_near(table), "dim").select("dim", "block", "vec_id", "v", "floor", F.explode(mine).alias("l"))
            .select("dim", F.col("l.level").alias("level"), F.explode(F.sequence(F.lit(0), F.col("l.parts") - 1)).alias("part"), "block", "vec_id", "v", "floor"))
    pair = ["dim", "level", "part", "block"]
    rest = copies.groupBy(*pair).cogroup(asks.groupBy(*pair)).applyInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (head.unionAll(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
