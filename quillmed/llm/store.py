"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot with more than one in HOT_SHARE of all rows (and LEAST_HOT at least), so at most HOT_SHARE keys are.
HOT_SHARE, LEAST_HOT = 10_000, 500
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch may all be long (copies of a long text meet in one): so its bytes are bounded, too.
BATCH_BYTES, MOST_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Spark then deletes the files of a query's shuffles when the query ends; a written table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that written() has made in this process, in order.
made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode, where it is unset (tests), a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write df once to the shared folder and return a reader of it: lineage ends there, so a
    lost executor costs a re-read, and Spark knows the true size for later joins. Python functions
    are handed MOST_BATCH_BYTES at a time, and no more than `batch` rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    own = {BATCH_BYTES: str(MOST_BATCH_BYTES), CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more, wherever the shared folder lies."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        made.remove(p)


def done(spark: SparkSession, start: int, *names: str) -> None:
    """Delete the tables of these names that were made since made had `start` entries; no later step reads them."""
    drop(spark, [p for p in made[start:] if p.rsplit("/", 1)[1].startswith(tuple(f"{n}-" for n in names))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_keys(sizes: DataFrame, key: str, total: int) -> DataFrame | None:
    """(key, _parts) of the hot keys of sizes(key, n), and over how many tasks their rows are dealt; None if there are none."""
    bound = max(LEAST_HOT, total // HOT_SHARE)
    hot = written(sizes.where(F.col("n") > bound).select(key, F.ceil(F.col("n") / bound).cast("int").alias("_parts")), "hot-keys")
    return None if hot.isEmpty() else hot


def spread_join(rows: DataFrame, small: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with small (one row per key). A hot key's rows are dealt over several tasks and its
    row of small is copied for each, so no task holds a whole hot key."""
    if hot is None:
        return rows.join(small.hint("shuffle_merge"), key, how)
    few = F.broadcast(hot)  # at most HOT_SHARE keys
    salt = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts")).cast("int"), F.lit(0))
    dealt = rows.join(few, key, "left").withColumn("_salt", salt).drop("_parts")
    copied = small.join(few, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied.hint("shuffle_merge"), [key, "_salt"], how).drop("_salt")
