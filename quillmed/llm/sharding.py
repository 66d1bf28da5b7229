"""Balanced sharding by label propagation under capacity quotas (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import hot_keys, spread_join, written

#: Bytes that every row costs beside its text.
ROW_BYTES = 16
#: Steps in which a shard's movers are accepted; the acceptance tables have shards x STEPS rows.
STEPS = 1024


def _hash_step(*cols, seed: int, steps: int = STEPS):
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(steps)).cast("int")


def _loads(state: DataFrame, n_shards: int) -> list[int]:
    got = {r["shard"]: r["load"] for r in state.groupBy("shard").agg(F.sum("size").alias("load")).collect()}
    return [got.get(s, 0) for s in range(n_shards)]


def _per_shard(spark, values: list, name: str, kind: str) -> DataFrame:
    """A table of one row per shard: its size is the number of shards, so it is broadcast."""
    return F.broadcast(spark.createDataFrame(list(enumerate(values)), f"shard int, {name} {kind}"))


def _propagate(state: DataFrame, hot: DataFrame | None, n_shards: int, capacity: float, seed: int) -> DataFrame:
    """One round: rows of a group move to the shard where most of its bytes are, as far as that
    shard's quota goes. A group's vote is summed by (group, shard): copies add no pairs. Groups
    larger than an eighth of a shard are let in row by row, others whole."""
    spark = state.sparkSession
    votes = state.where("grouped").groupBy("gk", "shard").agg(F.sum("size").alias("bytes"))
    wish = (votes.groupBy("gk").agg(F.max(F.struct("bytes", (-F.col("shard")).alias("s"))).alias("best"),
                                    F.sum("bytes").alias("group_bytes"), F.count("*").alias("spread"))
            .where("spread > 1").select("gk", (-F.col("best.s")).alias("wish"), "group_bytes"))
    big = F.col("group_bytes") > capacity / 8
    asked = (spread_join(state, wish, "gk", hot, "left")
             .withColumn("step", F.when(big, _hash_step("gk", "doc_id", seed=seed)).otherwise(_hash_step("gk", seed=seed)))
             .withColumn("mover", F.coalesce(F.col("wish") != F.col("shard"), F.lit(False))))
    asked = written(asked, "shard-asked")
    loads = _loads(state, n_shards)
    room = _per_shard(spark, [max(0.0, 1.05 * capacity - x) for x in loads], "room", "double")
    steps = asked.where("mover").groupBy(F.col("wish").alias("shard"), "step").agg(F.sum("size").alias("bytes"))
    upto = steps.withColumn("upto", F.sum("bytes").over(Window.partitionBy("shard").orderBy("step")))
    cuts = upto.join(room, "shard").where("upto <= room").groupBy("shard").agg(F.max("step").alias("cut"))
    cut = {r["shard"]: r["cut"] for r in cuts.collect()}  # one row per shard
    table = _per_shard(spark, [cut.get(s, -1) for s in range(n_shards)], "cut", "int").withColumnRenamed("shard", "wish")
    moved = asked.join(table, "wish", "left").withColumn("shard", F.when(F.col("mover") & (F.col("step") <= F.col("cut")), F.col("wish")).otherwise(F.col("shard")))
    return written(moved.select("doc_id", "size", "crc", "gk", "grouped", "shard"), "shard-state")


def _level(state: DataFrame, n_shards: int, capacity: float, seed: int) -> DataFrame:
    """Move rows from shards above capacity to shards below. Ungrouped rows go first, then small
    groups; rows are taken in hashed steps up to the surplus, and the steps, laid end to end,
    fall into the deficits laid end to end. Only tables of shards x steps are ever ordered."""
    spark = state.sparkSession
    loads = _loads(state, n_shards)
    surplus = [x - capacity for x in loads]
    over = _per_shard(spark, [max(0.0, x) for x in surplus], "surplus", "double")
    step = F.when(~F.col("grouped"), _hash_step("doc_id", "crc", seed=seed)).otherwise(STEPS + _hash_step("gk", "doc_id", seed=seed))
    marked = state.join(over, "shard").withColumn("step", F.when(F.col("size") <= F.col("surplus"), step))
    sums = marked.where("step is not null").groupBy("shard", "step").agg(F.sum("size").alias("bytes"), F.first("surplus").alias("surplus"))
    line = Window.partitionBy("shard").orderBy("step")
    taken = sums.withColumn("upto", F.sum("bytes").over(line)).where("upto <= surplus")
    ahead = taken.withColumn("mid", F.col("upto") - F.col("bytes") / 2).select("shard", "step", "mid", "bytes")
    outs = {r["shard"]: r["b"] for r in ahead.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    before, total = [], 0.0
    for s in range(n_shards):
        before.append(total)
        total += float(outs.get(s, 0))
    if total == 0:
        return state
    lacks = [max(0.0, -x) for x in surplus]
    scale, ends, at = total / (sum(lacks) or 1.0), [], 0.0
    for x in lacks:
        at += x * scale
        ends.append(at)
    spot = F.col("mid") + F.col("before")
    target = F.coalesce(*[F.when((spot < e) & F.lit(x > 0), F.lit(s)) for s, (e, x) in enumerate(zip(ends, lacks))], F.lit(max(range(n_shards), key=lacks.__getitem__)))
    route = F.broadcast(ahead.join(_per_shard(spark, before, "before", "double"), "shard")
                        .select("shard", "step", target.cast("int").alias("target")))  # at most shards x 2 x STEPS rows
    moved = marked.join(route, ["shard", "step"], "left").withColumn("shard", F.coalesce("target", "shard"))
    return written(moved.select("doc_id", "size", "crc", "gk", "grouped", "shard"), "shard-state")


def shard(docs: DataFrame, n_shards: int = 40, rounds: int = 2, passes: int = 6) -> DataFrame:
    """Law `bytes`: (doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row.

    Rows start in hashed shards; `rounds` of label propagation draw equal texts together under
    quotas; then at most `passes` of levelling even the bytes to within half a percent or as far
    as whole rows allow. Null texts count as empty ones and are a group with them. A group that
    is larger than a shard spreads over several. Fewer rows than shards leave shards empty, an
    empty table gives an empty result, and repeated rows are rows of their own. A very long text
    counts with all its bytes; one that alone is larger than a shard makes its shard that large.
    Only doc_id and text are read, so other columns may have any names.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(text).alias("crc"), F.unhex(F.md5(text)).alias("gk"))
    slim = written(slim, "shard-slim")
    n, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    capacity = total / n_shards
    many = written(slim.groupBy("gk").agg(F.count("*").alias("n")).where("n > 1"), "shard-groups")
    hot = hot_keys(many, "gk", n)
    state = written(spread_join(slim, many.select("gk", F.lit(True).alias("grouped")), "gk", hot, "left")
                    .select("doc_id", "size", "crc", "gk", F.coalesce("grouped", F.lit(False)).alias("grouped"),
                            _hash_step("doc_id", "crc", seed=7, steps=n_shards).alias("shard")), "shard-state")
    for k in range(rounds):
        state = _propagate(state, hot, n_shards, capacity, seed=100 + k)
    for k in range(passes):
        loads = _loads(state, n_shards)
        if not n or max(loads) - min(loads) <= 0.005 * capacity:
            break
        state = _level(state, n_shards, capacity, seed=200 + k)
    # slots: rows are numbered within hashed parts of a shard, after the rows of earlier parts
    parts = max(1, n // (n_shards * 4000))
    dealt = state.withColumn("part", _hash_step("doc_id", "crc", seed=300, steps=parts))
    sizes = dealt.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    first = sizes.withColumn("first", F.sum("rows").over(Window.partitionBy("shard").orderBy("part")) - F.col("rows")).drop("rows")
    numbered = dealt.withColumn("n", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "crc", "size")))
    return (numbered.join(first.hint("shuffle_merge"), ["shard", "part"])
            .select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
