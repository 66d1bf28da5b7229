"""Intermediate tables of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A caller's table is broadcast up to this many rows.
MOST_BROADCAST = 100_000
#: And up to so many bytes of JSON.
MOST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


#: If false, tables dealt alike by some keys of a join are joined as they lie; else they are dealt again by all keys.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def written(df: DataFrame, name: str, as_dealt: bool = False) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends there, and Spark knows the true size. as_dealt: its joins
    take tables that are dealt by some of their keys, such as the document, as they are."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(ALL_KEYS)
    if as_dealt:
        spark.conf.set(ALL_KEYS, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ALL_KEYS, before)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys and checkpointed in the shared folder: lineage ends there, and a join on these keys doesn't shuffle it again."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan doesn't hand its partitioning on to the checkpoint
    try:
        return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def spread(df: DataFrame, tasks: int | None, *keys) -> DataFrame:
    """df dealt by keys over a stated number of tasks; df itself, where Spark's number is enough (None)."""
    return df if tasks is None else df.repartition(tasks, *keys)


def sized(df: DataFrame, most: int = MOST_BROADCAST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """df as the small side of a join: broadcast if its rows are few and their bytes, too, both counted over the first rows; else merged by a shuffle."""
    text = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    n, size = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(text), F.lit(0))).first()
    return F.broadcast(df) if n <= most and size <= most_bytes else df.hint("shuffle_merge")


def in_blocks(rows: DataFrame, items: DataFrame, size: int = 1000) -> DataFrame:
    """Every row of rows with every row of a stated set of items, by an equality join on blocks of some `size` items: a row is copied once for each block."""
    n = items.count()
    blocks = max(1, -(-n // size))
    dealt = items.withColumn("_block", F.pmod(F.xxhash64(*items.columns), F.lit(blocks)).cast("int")).groupBy("_block").agg(F.collect_list(F.struct(*items.columns)).alias("_items"))
    dealt = written(dealt, "blocks")
    copied = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = copied.join(sized(dealt), "_block").select(*rows.columns, F.explode("_items").alias("_i"))
    return met.select(*rows.columns, "_i.*")
