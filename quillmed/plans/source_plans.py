"""Queries S1-S3, S6 and S7: driver tables are written out in each form and read back through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmed.operators.store import shared_dir
from quillmed.sources import files

from .base import query, table


def _path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


WIDE = ["Test", "2024-03-12 08:59", "Unit", "Reference Range"]


@query("s01_wide_csv", """SELECT c_name || chr(10) || '("' || c_mktsegment || '")' AS "Test", replace(round(c_acctbal)::BIGINT || ',5', '-', '- ') AS "2024-03-12 08:59", CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'U/L' END AS "Unit", '< ' || c_nationkey AS "Reference Range" FROM customer""")
def s01(spark, sf_dir):
    c, path = table(spark, sf_dir, "customer"), _path(spark, "wide")
    value = F.replace(F.concat(F.round("c_acctbal").cast("long").cast("string"), F.lit(",5")), F.lit("-"), F.lit("- "))
    cells = (F.concat("c_name", F.lit('\n("'), "c_mktsegment", F.lit('")')), value, F.when(F.col("c_custkey") % 3 != 0, "U/L"), F.concat(F.lit("< "), F.col("c_nationkey")))
    files.write_table(c.select(*(x.alias(n) for x, n in zip(cells, WIDE))), path, "csv")
    return files.read_wide_csv(spark, path, WIDE)


@query("s02_metadata_csv", """SELECT p_name || ' ' || p_partkey AS test, CASE p_partkey % 3 WHEN 0 THEN 'Both' WHEN 1 THEN 'Female' ELSE 'Male' END AS sex, p_size::DOUBLE AS normal_low, CASE WHEN p_partkey % 2 = 0 THEN p_size + 0.5 END::DOUBLE AS normal_high, '[{"comp": ">", "low": ' || p_size || '}]' AS sharp_change_parsed FROM part""")
def s02(spark, sf_dir):
    k, path = F.col("p_partkey"), _path(spark, "metadata")
    given = {"Test Name": F.concat("p_name", F.lit(" "), k), "sex": F.when(k % 3 == 1, " female").when(k % 3 == 2, "MALE"), "normal_low": F.col("p_size").cast("double"), "normal_high": F.when(k % 2 == 0, F.col("p_size") + 0.5),
             "sharp_change_parsed": F.concat(F.lit('[{"comp": ">", "low": '), F.col("p_size"), F.lit("}]"))}
    names = [c.split("`")[1] if "`" in c else c.split()[0] for c in files.METADATA.replace("\n", "").split(", ")]
    files.write_table(table(spark, sf_dir, "part").select(*(given.get(n.strip(), F.lit(None).cast("string")).alias(n.strip()) for n in names)), path, "csv")
    return files.read_metadata_csv(spark, path).select("test", "sex", "normal_low", "normal_high", "sharp_change_parsed")


#: Customers stand for facts, a hundred of them for a fragment.
@query("s03_graph_json", """SELECT 'SENT_' || c_custkey // 100 AS sentence_id, 'F' || c_custkey AS id, c_mktsegment AS predicate, 'nation' AS role, 'N' || c_nationkey AS entity FROM customer""")
def s03(spark, sf_dir):
    c, path = table(spark, sf_dir, "customer"), _path(spark, "graphs")
    fact = F.struct(F.concat(F.lit("F"), F.col("c_custkey")).alias("id"), F.col("c_mktsegment").alias("predicate"), F.array(F.struct(F.lit("nation").alias("role"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("entity"))).alias("tuple"))
    f = c.groupBy(F.expr("c_custkey div 100").alias("fragment")).agg(F.collect_list(fact).alias("facts"))
    files.write_graph_json(f.select("fragment", F.lit("N-tuple").alias("graph_type"), "facts", F.struct(F.concat(F.lit("SENT_"), F.col("fragment")).alias("sentence_id")).alias("metadata")), path, "fragment")
    g = files.read_graph_json(spark, path).select("metadata.sentence_id", F.explode("facts").alias("f"))
    return g.select("sentence_id", "f.id", "f.predicate", F.explode("f.tuple").alias("t")).select("sentence_id", "id", "predicate", "t.role", "t.entity")


@query("s06_triples", "SELECT 'O' || o_orderkey AS head, o_orderstatus AS relation, 'C' || o_custkey AS tail FROM orders")
def s06(spark, sf_dir):
    path = _path(spark, "triples")
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey")).alias("head"), F.col("o_orderstatus").alias("relation"), F.concat(F.lit("C"), F.col("o_custkey")).alias("tail"))
    files.write_table(o, path, "tsv", header=False)
    return files.read_triples(spark, path)


@query("s07_sinks", "SELECT kind, c_nationkey AS nation, count(*) AS n, sum(c_custkey)::BIGINT AS keys, min(c_name) AS least FROM customer, (VALUES ('csv'), ('tsv'), ('json'), ('parquet')) k(kind) GROUP BY ALL")
def s07(spark, sf_dir):
    c, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), _path(spark, "sinks")
    schema, back = "c_custkey BIGINT, c_name STRING, c_nationkey BIGINT", []
    for kind in ("csv", "tsv", "json", "parquet"):
        files.write_table(c, f"{path}/{kind}", kind, ["c_nationkey"])
        read = spark.read.schema(schema)
        got = {"csv": lambda p: read.csv(p, header=True), "tsv": lambda p: read.csv(p, header=True, sep="\t"), "json": read.json, "parquet": read.parquet}[kind](f"{path}/{kind}")
        back.append(got.groupBy(F.lit(kind).alias("kind"), F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.min("c_name").alias("least")))
    return back[0].unionByName(back[1]).unionByName(back[2]).unionByName(back[3])
