"""Registration of queries with their DuckDB SQL, and adapters of the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, by: str) -> DataFrame:
    """df itself, or, if its files make fewer tasks than the cluster runs at once, its rows dealt over that many."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, by)


#: Rows of a table that one task of a shuffle is given.
TASK_ROWS = 250_000


def tasks(df: DataFrame) -> int | None:
    """Of a table of very many rows, how many tasks its shuffles need so that none holds more than some TASK_ROWS; None where Spark's own number is enough."""
    n = -(-df.count() // TASK_ROWS)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as measurements: entity, test, ts, value, ord."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("test"), "ts", "value", F.col("event_id").alias("ord"))


#: The same in SQL, for the oracle.
SERIES = "SELECT user_id AS entity, event_type AS test, ts, value, event_id AS ord FROM events"


def rows(spark: SparkSession, schema: str, *values) -> DataFrame:
    """A small inline table."""
    return spark.createDataFrame(list(values), schema)
