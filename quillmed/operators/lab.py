"""Lab shaping: from report tables to one long table of measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmed.functions.scalars import bracket_text, clean_name, plain_hyphens

from .scan import LONG, carried, over_ranges
from .store import sized

#: Report headers in two languages.
HEADERS = {
    "Tarih": "Date", "Date": "Date", "Test": "Test", "Test Name": "Test",
    "Değer": "Value", "Result": "Value", "Value": "Value",
    "Birim": "Unit", "Result Unit": "Unit", "Unit": "Unit",
    "Referans Aralığı": "RefRange", "Reference Value": "RefRange", "RefRange": "RefRange",
}


def harmonise(tables: list[DataFrame], headers: dict[str, str] = HEADERS) -> DataFrame:
    """A1: rename the headers of every report table to common ones and stack the tables; a column that a table lacks is null."""
    renamed = [t.withColumnsRenamed({c: headers[c] for c in t.columns if c in headers}) for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)


def fill_dates(df: DataFrame, report: str, order: list[str], date: str = "Date", long: int | None = LONG) -> DataFrame:
    """A2: a date that is '-' or blank is that of the line above it in the same report. A range of a long report takes the last date of the ranges before it where it has none."""
    given = F.nullif(F.nullif(F.trim(date), F.lit("-")), F.lit(""))
    above = lambda *k: F.last(given, ignorenulls=True).over(Window.partitionBy(*k).orderBy(*order))

    def ranged(r: DataFrame) -> DataFrame:
        last = F.max_by(given, F.when(given.isNotNull(), F.struct(*order)))
        c = carried(r, [report], {"last": last}, {"_before": lambda s, before, after: F.last(s, ignorenulls=True).over(before)}, {"_before": "last"})
        return c.withColumn(date, F.coalesce(above(report, "_range"), F.col("_before"))).drop("_before")

    return over_ranges(df, lambda d: d.withColumn(date, above(report)), ranged, [report], order, long)


def first_seen(df: DataFrame, key: str, values: list[str], order: Column) -> DataFrame:
    """A3: the values of the first row of each key."""
    got = df.groupBy(key).agg(F.min_by(F.struct(*values), order).alias("v"))
    return got.select(key, *(F.col(f"v.{c}").alias(c) for c in values))


#: A pivot makes a column for each header: more than this are refused, as no table can be so wide.
MOST_HEADERS = 10_000


def pivot_dates(df: DataFrame, keys: list[str], header: Column, value: str, order: Column) -> DataFrame:
    """A4: one row per key, one column per header that the rows hold, with the first non-null value."""
    given = df.where(F.col(value).isNotNull()).withColumn("_h", header)
    headers = [r["_h"] for r in given.select("_h").distinct().orderBy("_h").limit(MOST_HEADERS + 1).collect()]  # names of columns
    if len(headers) > MOST_HEADERS:
        raise ValueError("too many headers for columns")
    return given.groupBy(*keys).pivot("_h", headers).agg(F.min_by(value, order))


def unpivot_dates(wide: DataFrame, ids: list[str]) -> DataFrame:
    """A5: wide to long; value columns are those whose header has a digit and a hyphen; null cells go."""
    cols = [c for c in wide.columns if c not in ids and any(x.isdigit() for x in c) and "-" in c]
    return wide.unpivot(ids, cols, "datetime_str", "raw_value").where("raw_value is not null")


def map_names(df: DataFrame, name: str, dictionary: DataFrame, out: str = "mapped") -> DataFrame:
    """A10: dictionary(key, value, ord): exact name, else case-insensitive, else the text of the
    first bracket pair, else the cleaned name. The earliest entry wins."""
    first = lambda k, n: sized(dictionary.groupBy(k.alias(n)).agg(F.min_by("value", "ord").alias(f"{n}_value")))
    key = F.col("key")
    plain = F.lower(F.replace(key, F.lit(" "), F.lit("")))
    cleaned = df.withColumn("_clean", clean_name(F.col(name)))
    cleaned = cleaned.withColumn("_low", F.lower("_clean")).withColumn("_abbr", F.lower(F.replace(bracket_text(F.col("_clean")), F.lit(" "), F.lit(""))))
    return (cleaned.join(first(key, "_clean"), "_clean", "left").join(first(F.lower(key), "_low"), "_low", "left").join(first(plain, "_abbr"), "_abbr", "left")
            .withColumn(out, F.coalesce("_clean_value", "_low_value", "_abbr_value", "_clean"))
            .drop("_clean", "_low", "_abbr", "_clean_value", "_low_value", "_abbr_value"))


def stack_first(parts: list[DataFrame], key: list[str], order: list | None = None) -> DataFrame:
    """Stack tables; of rows that agree in the key the one of the earliest table stays."""
    ranked = reduce(DataFrame.unionByName, [p.withColumn("_source", F.lit(k)) for k, p in enumerate(parts)])
    first = Window.partitionBy(*key).orderBy("_source", *(order or []))
    return ranked.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_source")


def strict_mapping(df: DataFrame, name: str, mapping: DataFrame, out: str = "mapped") -> DataFrame:
    """mapping(key, value): rows whose name is no key are dropped. Names and keys are compared with plain hyphens."""
    known = mapping.select(plain_hyphens(F.col("key")).alias("_key"), F.col("value").alias(out))
    return df.join(sized(known), plain_hyphens(F.col(name)) == F.col("_key")).drop("_key")


def join_thresholds(results: DataFrame, thresholds: DataFrame, on: Column, columns: dict[str, str]) -> DataFrame:
    """Results that have a threshold row, projected and renamed by columns (source name -> name). Both sides may be large."""
    return results.join(thresholds.hint("shuffle_merge"), on).select(*(F.col(a).alias(b) for a, b in columns.items()))


RULE = "STRUCT<part: STRING, comp: STRING, low: DOUBLE, high: DOUBLE, unit: STRING, time_days: DOUBLE, per_day_low: DOUBLE, per_day_high: DOUBLE>"


def parse_rules(df: DataFrame, text: str) -> DataFrame:
    """A row for each rule of a JSON list (rule_no from 0, and the fields of the rule); text that is no such list gives none."""
    others = [c for c in df.columns if c != text]
    parsed = df.select(*others, F.posexplode_outer(F.from_json(text, f"ARRAY<{RULE}>")).alias("rule_no", "_r"))
    return parsed.where("_r.comp is not null").select(*others, "rule_no", "_r.*")


def convert_unit(value: Column, factor: Column) -> Column:
    """An unknown pair of units leaves the value as it is."""
    return F.coalesce(value * factor, value)


def unit_key(c: Column) -> Column:
    """The form in which units are compared: the part before ';', no blanks, lower case."""
    return F.lower(F.replace(F.get(F.split(c, ";"), 0), F.lit(" "), F.lit("")))


def convert_units(df: DataFrame, value: str, unit: str, target: str, factors: DataFrame, out: str) -> DataFrame:
    """factors(unit_from, unit_to, factor)."""
    known = factors.select(unit_key(F.col("unit_from")).alias("_from"), unit_key(F.col("unit_to")).alias("_to"), "factor")
    keyed = df.withColumn("_from", unit_key(F.col(unit))).withColumn("_to", unit_key(F.col(target)))
    return keyed.join(sized(known), ["_from", "_to"], "left").withColumn(out, convert_unit(F.col(value), F.col("factor"))).drop("_from", "_to", "factor")


def pick_reference(df: DataFrame, dims: DataFrame, key: list[str], sex: str, per: list[str]) -> DataFrame:
    """Of the reference rows of a test the one for the patient's sex, else for both, else the
    first; without a known sex, for both, else the first. dims has ref_sex and ref_ord."""
    fits = F.when(F.col(sex).isNotNull() & (F.lower(sex) == F.lower("ref_sex")), 0).when(F.lower("ref_sex") == "both", 1).otherwise(2)
    best = Window.partitionBy(*per).orderBy(fits, "ref_ord")
    return df.join(sized(dims), key).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def target_units(df: DataFrame, key: list[str], unit: str, ts: str, meta_unit: str) -> DataFrame:
    """Per series the metadata's unit, else the latest unit that is not blank."""
    latest = F.max_by(F.when(F.trim(unit) != "", F.col(unit)), F.when(F.trim(unit) != "", F.col(ts)))
    return df.groupBy(*key).agg(F.coalesce(F.first(meta_unit, ignorenulls=True), latest).alias("target_unit"))


def repair_scale(value: Column, low: Column, high: Column) -> Column:
    """A value above 100 times the upper bound is divided by 1000 if that brings it within
    100 times the bound; then a positive value below a hundredth of the lower bound is multiplied by 1000."""
    down = F.when((value > 100 * high) & (value / 1000 <= 100 * high), value / 1000).otherwise(value)
    return F.when((down > 0) & (down < low / 100), down * 1000).otherwise(down)


def complete_rows(df: DataFrame, needed: tuple[str, ...] = ("Date", "Test", "Value")) -> DataFrame:
    """Rows whose needed cells are filled; a table that lacks a needed column gives none."""
    if any(c not in df.columns for c in needed):
        return df.limit(0)
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in needed]))
