"""Translation distances pruned exactly by pivots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Pivots at most; there are about as many as the root of the number of entities. They are the entities of least hash.
MOST_PIVOTS = 256
#: Entities of a block of a cell, queries of a list, and lists that meet a block in one task, by expectation.
BLOCK, LIST, LISTS = 4096, 256, 8
#: Distances are sums in doubles: bounds give way by this share of them.
SLACK = 1e-9


def translation_score(h: Column, r: Column, t: Column) -> Column:
    """-|h + r - t| for vectors of doubles."""
    d = F.zip_with(F.zip_with(h, r, lambda a, b: a + b), t, lambda a, b: a - b)
    return -F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def _cells(entities: DataFrame) -> tuple[DataFrame, list, list]:
    """(id, v, cell, d): each entity with its nearest pivot and the distance to it; the pivots, and for each cell how many entities and the range of their distances."""
    import numpy as np

    n = entities.count()
    few = entities.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, max(1, math.isqrt(n)))).select("v").toArrow()
    pivots = np.array(few["v"].to_pylist(), float)  # bounded
    shared = entities.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches):
        import pyarrow as pa

        p = shared.value
        for b in batches:
            v = np.array(b.column("v").to_pylist(), float).reshape(len(b), -1)
            best, at = np.full(len(b), np.inf), np.zeros(len(b), np.int32)
            for k, one in enumerate(p):
                d = np.sqrt(((v - one) ** 2).sum(axis=1))
                nearer = d < best
                best[nearer], at[nearer] = d[nearer], k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(best)], names=[*b.schema.names, "cell", "d"])

    kind = dict(entities.dtypes)["id"]
    placed = written(entities.select("id", "v").mapInArrow(nearest, f"id {kind}, v array<double>, cell int, d double"), "cells")
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect() if n else []  # a row for each pivot at most
    return placed, pivots, [(r["cell"], r["n"], r["lo"], r["hi"]) for r in stats]


def _asked(queries: DataFrame, pivots, stats: list, k: int | None) -> DataFrame:
    """queries with limit, cells (those that can hold an entity within the limit, with the query's distance to their pivots) and sure (entities of cells that surely are
    nearer than `low`, which are not among cells). With k the limit is a distance that the k-th nearest doesn't exceed; without, queries have limit and low."""
    import numpy as np

    cell, n, lo, hi = (np.array(x) for x in zip(*stats)) if stats else (np.zeros(0, int),) * 4
    shared = queries.sparkSession.sparkContext.broadcast((pivots, cell, n, lo, hi))
    names = [c for c in queries.columns if c not in ("limit", "low")]

    def bound(batches):
        import pyarrow as pa

        p, cell, n, lo, hi = shared.value
        for b in batches:
            cells, sure, limits = [], [], []
            for row in b.to_pylist():
                d = np.sqrt(((p - (np.array(row["h"]) + np.array(row["r"]))) ** 2).sum(axis=1))[cell] if len(cell) else np.zeros(0)
                near, far = np.maximum(0, np.maximum(d - hi, lo - d)), (d + hi) * (1 + SLACK)
                if k is None:
                    limit, inside = row["limit"], far < row["low"]
                else:
                    order = np.argsort(far, kind="stable")
                    enough = int(np.searchsorted(np.cumsum(n[order]), k))
                    limit, inside = float(far[order[enough]]) if enough < len(order) else math.inf, np.zeros(len(cell), bool)
                use = (near <= limit * (1 + SLACK) + SLACK) & ~inside
                cells.append([{"cell": int(c), "dq": float(x)} for c, x in zip(cell[use], d[use])])
                sure.append(int(n[inside].sum()))
                limits.append(limit)
            kind = pa.list_(pa.struct([("cell", pa.int32()), ("dq", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(cells, kind), pa.array(sure, pa.int64()), pa.array(limits, pa.float64())], names=[*names, "cells", "sure", "limit"])

    ddl = ", ".join(f"{c} {t}" for c, t in queries.dtypes if c in names)
    return written(queries.mapInArrow(bound, f"{ddl}, cells array<struct<cell: int, dq: double>>, sure long, limit double"), "asked")


def _matrix(lists):
    import numpy as np

    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(flat) else np.zeros((len(lists), 0))


def _scored(v, q, i, j):
    """Scores of pairs (i of q, j of v), summed up in the order of components as translation_score does, so to the bit the same."""
    import numpy as np

    s = np.zeros(len(i))
    for c in range(v.shape[1]):
        x = q[i, c] - v[j, c]
        s += x * x
    return -np.sqrt(s)


def _meeting(names: list[str], pick, most: int | None):
    """What a task does with a block of entities and lists of queries: bounds of all distances by a product of matrices, of which pick(near, far, possible, field) tells
    the pairs to score and, for each query, how many surely are above and tied; of pairs of one query and score the `most` least ids stay, n being how many there were."""
    def meet(left, right):
        import numpy as np
        import pyarrow as pa

        ids, v, d = left["id"].combine_chunks(), _matrix(left["v"].combine_chunks()), left["d"].to_numpy()
        every, parts, size = right["qs"].combine_chunks().flatten(), [], (v ** 2).sum(axis=1)
        order = np.argsort(np.array(ids.to_pylist()), kind="stable")  # by id
        ids, v, d, size = ids.take(pa.array(order)), v[order], d[order], size[order]
        for start in range(0, len(every), LIST):
            some = every.slice(start, LIST)
            field = lambda name, some=some: some.field(name).to_numpy(zero_copy_only=False)
            q = _matrix(some.field("q"))
            sums = (q ** 2).sum(axis=1)[:, None] + size
            square, error = sums - 2 * (q @ v.T), 16 * (v.shape[1] + 8) * np.finfo(float).eps * sums
            near, far = np.sqrt(np.maximum(square - error, 0)), np.sqrt(np.maximum(square, 0) + error)
            possible = np.abs(field("dq")[:, None] - d) <= (field("limit") * (1 + SLACK) + SLACK)[:, None]
            mask, above, ties = pick(near, far, possible, field)
            i, j = np.nonzero(mask)
            score = _scored(v, q, i, j)
            by = np.lexsort((j, score, i))
            i, j, score = i[by], j[by], score[by]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (score[1:] != score[:-1])
            first = np.flatnonzero(new)
            run = np.diff(np.append(first, len(i)))
            kept = np.arange(len(i)) - np.repeat(first, run) < (len(i) if most is None else most)
            i, j, score, n = i[kept], j[kept], score[kept], np.repeat(run, run)[kept]
            sure = np.flatnonzero(above + ties)
            at = pa.array(np.concatenate((i, sure)))
            absent, none = pa.nulls(len(sure)), np.zeros(len(i), np.int64)
            parts.append(pa.table([*(some.field(c).take(at) for c in names), pa.concat_arrays([ids.take(pa.array(j)), absent.cast(ids.type)]), pa.concat_arrays([pa.array(score), absent.cast(pa.float64())]),
                                   pa.array(np.concatenate((n, np.zeros(len(sure), np.int64)))), pa.array(np.concatenate((none, above[sure]))), pa.array(np.concatenate((none, ties[sure])))], names=[*names, "id", "score", "n", "above", "ties"]))
        return pa.concat_tables(parts) if parts else pa.table({})

    return meet


def _possible(near, far, possible, field):
    import numpy as np

    none = np.zeros(len(near), np.int64)
    return possible, none, none


def _pairs(asked: DataFrame, placed: DataFrame, stats: list, extra: list[str], pick=_possible, most: int | None = None) -> DataFrame:
    """Query and entity pairs that neither the pivots nor pick decide, with their exact score: (query, .., id, score, n, above, ties); see _meeting. A cell's entities are dealt into blocks and its queries into
    lists, so that a cell that holds a third of all, or that all queries ask for, is spread over many tasks."""
    spark = asked.sparkSession
    lists = max(1, -(-asked.count() // LIST))
    ways = max(1, -(-lists // LISTS))
    blocks = F.broadcast(spark.createDataFrame([(c, -(-n // BLOCK)) for c, n, _, _ in stats] or [(0, 1)], "cell int, blocks int"))  # a row for each pivot at most
    q = F.zip_with("h", "r", lambda a, b: a + b).alias("q")
    each = asked.select("query", q, "limit", *extra, F.explode("cells").alias("c")).withColumn("_list", F.pmod(F.xxhash64("query"), F.lit(lists)).cast("int"))
    listed = each.groupBy(F.col("c.cell").alias("cell"), "_list").agg(F.collect_list(F.struct("query", "q", "limit", *extra, F.col("c.dq").alias("dq"))).alias("qs"))
    listed = written(listed, "asked-lists").join(blocks, "cell").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("_way", F.pmod("_list", F.lit(ways)))
    own = placed.join(blocks, "cell").withColumn("_block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    names, key = ["query", *extra], ["cell", "_block", "_way"]
    kinds = {**dict(asked.dtypes), **dict(placed.dtypes)}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in (*names, "id")) + ", score double, n long, above long, ties long"
    dealt = listed.select(*key, "qs").groupBy(*key)
    return own.select(*key, "id", "v", "d").groupBy(*key).cogroup(dealt).applyInArrow(_meeting(names, pick, most), ddl)


def _nearest(k: int):
    def pick(near, far, possible, field):
        import numpy as np

        none = np.zeros(len(near), np.int64)
        if not near.size:
            return possible, none, none
        last = min(k, near.shape[1]) - 1
        bound = np.partition(np.where(possible, far, np.inf), last, axis=1)[:, last] * (1 + 1e-12) + 2e-9  # rounded scores that are equal lie closer
        return possible & (near <= bound[:, None]), none, none
    return pick


def rank_tails(queries: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """queries(query, h, r) against entities(id, v): the k best tails of each (query, id, score, rank), ties to the lesser id, for any number of
    queries. Entities are grouped by their nearest pivot; by the triangle inequality a group whose every entity is farther than the k-th can be is never met, nor is
    an entity whose own distance to the pivot says so. Of all others a task bounds the distances and scores those that can be among its k best, so ranks are exact."""
    placed, pivots, stats = _cells(entities)
    pairs = _pairs(_asked(queries.select("query", "h", "r"), pivots, stats, k), placed, stats, [], _nearest(k), k)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return pairs.select("query", "id", F.round("score", 9).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _against(digits: int):
    """Pairs whose score, rounded to digits, could be equal to the own one or not; all others are counted."""
    half = 0.5 * 10.0 ** -digits

    def pick(near, far, possible, field):
        import numpy as np

        own = -field("own")
        unsure = 1e-9 + 1e-12 * np.abs(own)
        inner, outer = (own - half)[:, None], (own + half)[:, None]
        unsure = unsure[:, None]
        above, below = possible & (far < inner - unsure), near > outer + unsure
        tied = possible & (near > inner + unsure) & (far < outer - unsure)
        return possible & ~above & ~below & ~tied, above.sum(axis=1).astype(np.int64), tied.sum(axis=1).astype(np.int64)
    return pick


def true_ranks(queries: DataFrame, entities: DataFrame, digits: int = 9) -> DataFrame:
    """queries(query, side, h, r, true_id) -> optimistic, pessimistic and realistic rank of the true entity among all
    entities, scores rounded to `digits`. Groups of entities that are surely nearer than the true one are only counted, those surely farther are left
    out, and entities likewise; of the rest a task bounds the distances and scores those that could tie. Only counts of better and equal scores are shuffled, never a ranking."""
    own = entities.select(F.col("id").alias("true_id"), F.col("v").alias("_t"))
    score = F.round(F.round(translation_score(F.col("h"), F.col("r"), F.col("_t")), 9), digits)
    margin = 10.0 ** -digits + 1e-9  # rounded scores that are equal lie closer
    asked = written(queries.join(own.hint("shuffle_merge"), "true_id").withColumn("own", score).drop("_t"), "true-scores")
    placed, pivots, stats = _cells(entities)
    total = sum(n for _, n, _, _ in stats)
    asked = _asked(asked.select("query", "side", "h", "r", "own", (-F.col("own") - margin).alias("low"), (-F.col("own") + margin).alias("limit")), pivots, stats, None)
    p = _pairs(asked, placed, stats, ["side", "own"], _against(digits), 1).withColumn("score", F.round(F.round("score", 9), digits))
    counted = lambda sure, by: F.sum(F.col(sure) + F.when(by, F.col("n")).otherwise(0)).alias(sure)
    counts = p.groupBy("query", "side").agg(counted("above", F.col("score") > F.col("own")), counted("ties", F.col("score") == F.col("own")))
    g = asked.select("query", "side", "sure").join(counts.hint("shuffle_merge"), ["query", "side"], "left").select("query", "side", F.lit(total).cast("long").alias("n"), (F.col("sure") + F.coalesce("above", F.lit(0))).alias("above"), F.coalesce("ties", F.lit(0)).alias("ties"))
    opt, pes = F.col("above") + 1, F.col("above") + F.col("ties")
    return g.select("query", "side", "n", opt.alias("optimistic"), pes.alias("pessimistic"), ((opt + pes) / 2).alias("realistic"))
