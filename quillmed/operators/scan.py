"""Windows over series of any length: a long series is cut into ranges of its order, and what a range must know of the others is carried to it.

Windows of a series need its rows in one task. So series of over `long` rows are dealt by ranges of (key, order), whose limits Spark takes from a
sample; a range then is a partition of the windows like a short series. Frames of a few rows get copies of the rows beside the range; totals, last known
values and the like are summed up for each range and carried along the ranges, of which a series has its length / the size of a partition. Series that are
not long take neither the exchange nor the write.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import sized, written

#: A series of more rows is cut.
LONG = 200_000
#: Rows of a range, by expectation.
RANGE = 50_000


def bound(df: DataFrame, key, long: int | None = LONG) -> int | None:
    """long, or None if no series of df has more rows: then nothing made of these rows needs to look again."""
    return None if long is None or df.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > long).isEmpty() else long


def apart(df: DataFrame, key, long: int | None = LONG) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of the other series, rows of the long ones or None, rows of the long ones counted). long None: it is known that no series is long."""
    key = list(key)
    if bound(df, key, long) is None:
        return df, None, 0
    sizes = written(df.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > long), "long-series")
    total = sizes.agg(F.sum("_n")).first()[0]
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(sizes[k]) for k in key))
    few = sized(sizes)  # at most rows / long
    return df.join(few, same, "left_anti"), df.join(few, same, "left_semi"), total


def cut(rows: DataFrame, key, order, total: int, size: int = RANGE) -> DataFrame:
    """rows with _range, which numbers the ranges of (key, order) they were dealt by. Written, so that the numbers hold when a task runs again."""
    parts = max(2, -(-total // size))
    return written(rows.repartitionByRange(parts, *key, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def with_edges(ranges: DataFrame, key, order, back: int = 0, ahead: int = 0) -> DataFrame:
    """ranges and, for each, copies of the `back` rows before it and the `ahead` rows after it in its series, marked by _edge."""
    key, names = list(key), ranges.columns
    out = [ranges.withColumn("_edge", F.lit(False))]
    row = F.struct(*(c for c in names if c != "_range"))
    for n, first_ones in ((back, False), (ahead, True)):
        if not n:
            continue
        by = [F.col(c) if first_ones else F.desc(c) for c in order]
        near = ranges.withColumn("_k", F.row_number().over(Window.partitionBy(*key, "_range").orderBy(*by))).where(F.col("_k") <= n)
        lists = near.groupBy(*key, "_range").agg(F.array_sort(F.collect_list(F.struct("_k", row.alias("r")))).alias("_l"))
        beside = Window.partitionBy(*key).orderBy(F.col("_range") if first_ones else F.desc("_range")).rowsBetween(1, n)  # each has a row at least
        copies = lists.withColumn("_c", F.slice(F.flatten(F.collect_list("_l").over(beside)), 1, n))
        flat = copies.select("_range", F.explode_outer("_c").alias("_c")).where("_c is not null")
        out.append(flat.select(*(F.col("_range") if c == "_range" else F.col(f"_c.r.{c}").alias(c) for c in names), F.lit(True).alias("_edge")))
    return reduce(DataFrame.unionByName, out)


def over_series(df: DataFrame, add: Callable[[DataFrame, list[str]], DataFrame], key, order=("ts", "ord"), back: int = 0, ahead: int = 0, long: int | None = LONG, size: int = RANGE) -> DataFrame:
    """add(df, key) for windows by key whose frames reach at most `back` rows back and `ahead` rows ahead. add keeps rows and columns and adds columns."""
    key = list(key)
    rest, hot, total = apart(df, key, long)
    if hot is None:
        return add(df, key)
    done = add(with_edges(cut(hot, key, order, total, size), key, order, back, ahead), [*key, "_range"]).where("not _edge")
    plain = add(rest, key)
    return plain.unionByName(done.select(plain.columns))


def carried(ranges: DataFrame, key, states: dict[str, Column], take: dict[str, Callable], of: dict[str, str]) -> DataFrame:
    """ranges with the columns of take, of what the other ranges of its series hold: states are aggregates of one range; take makes a column of the state
    that `of` names for it, given the windows of all ranges before and after."""
    key = list(key)
    w = Window.partitionBy(*key).orderBy("_range")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    each = ranges.groupBy(*key, "_range").agg(*(v.alias(f"_s_{k}") for k, v in states.items()))
    known = each.select(*key, "_range", *(f(F.col(f"_s_{of[k]}"), before, after).alias(k) for k, f in take.items()))
    return null_safe(ranges, known, [*key, "_range"])


def over_ranges(df: DataFrame, plain: Callable[[DataFrame], DataFrame], ranged: Callable[[DataFrame], DataFrame], key, order=("ts", "ord"), long: int | None = LONG, size: int = RANGE) -> DataFrame:
    """plain(rows of short series) and ranged(ranges of long ones) together."""
    rest, hot, total = apart(df, key, long)
    if hot is None:
        return plain(df)
    short = plain(rest)
    return short.unionByName(ranged(cut(hot, key, order, total, size)).select(short.columns))


def quantiles(df: DataFrame, key, value: str, shares: list[float], long: int | None = LONG, size: int = RANGE) -> DataFrame:
    """(key.., q): the exact quantiles of value at shares, between two values by their distance; nulls don't count.

    For a long series no task holds all its values: equal values are counted first, the distinct ones dealt by ranges, and the running count of the
    ranges shows which of them hold the wanted ranks; only these are counted through."""
    key = list(key)
    given = df.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_v"))
    few = lambda d: d.groupBy(*key).agg(F.percentile("_v", shares).alias("q"))
    rest, hot, _ = apart(given, key, long)
    if hot is None:
        return few(given)
    cells = written(hot.groupBy(*key, "_v").agg(F.count("*").alias("_c")), "quantile-cells")
    ranges = cut(cells, key, ["_v"], cells.count(), size)
    each = ranges.groupBy(*key, "_range").agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy(*key)
    each = each.select(*key, "_range", "_c", (F.sum("_c").over(w.orderBy("_range")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_all"))
    at = lambda s: F.lit(float(s)) * (F.col("_all") - 1)
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(high).alias("high"), (F.ceil(at(s)) if high else F.floor(at(s))).alias("rank"), (at(s) - F.floor(at(s))).alias("part")) for k, s in enumerate(shares) for high in (False, True)))
    held = F.filter(wanted, lambda x: (x["rank"] >= F.col("_before")) & (x["rank"] < F.col("_before") + F.col("_c")))
    asked = written(each.select(*key, "_range", "_before", held.alias("w")).where(F.size("w") > 0), "quantile-ranks")  # at most two ranges for each share
    met = null_safe(ranges, asked, [*key, "_range"])
    upto = F.sum("_c").over(Window.partitionBy(*key, "_range").orderBy("_v")) + F.col("_before")
    found = met.withColumn("_upto", upto).select(*key, "_v", "_upto", (F.col("_upto") - F.col("_c")).alias("_from"), F.explode("w").alias("w")).where("w.rank >= _from and w.rank < _upto")
    pick = lambda k, high: F.max(F.when((F.col("w.k") == k) & (F.col("w.high") == F.lit(high)), F.col("_v")))
    part = lambda k: F.max(F.when(F.col("w.k") == k, F.col("w.part")))
    q = F.array(*(pick(k, False) * (1 - part(k)) + pick(k, True) * part(k) for k in range(len(shares))))
    return few(rest).unionByName(found.groupBy(*key).agg(q.alias("q")))


def null_safe(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """a joined with b on columns of the same names, where nulls are equal."""
    named = b.select(*(F.col(k).alias(f"_j_{k}") for k in on), *(c for c in b.columns if c not in on))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in on))
    return a.join(named.hint("shuffle_merge"), same).drop(*(f"_j_{k}" for k in on))
