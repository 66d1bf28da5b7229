"""Queries K1-K42 and S9: lineitem rows stand for facts, orders for sentences, customers for documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmed.functions.scalars import kebab, md5_bucket
from quillmed.operators import graph as K
from quillmed.operators.store import spread, written
from quillmed.sources import files

from .base import query, table, tasks

FACTS = """SELECT o_custkey AS doc, l_orderkey AS sent, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER), l_returnflag) AS fact_id, l_returnflag AS predicate, l_partkey, l_suppkey, l_quantity, l_linenumber, l_linestatus,
 l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
ROLES = f"""SELECT doc, sent, fact_id, predicate, 'part' AS role, 'P' || l_partkey AS entity, NULL::VARCHAR AS literal, NULL::VARCHAR AS datatype FROM ({FACTS})
 UNION ALL SELECT doc, sent, fact_id, predicate, 'supplier', 'S' || l_suppkey, NULL, NULL FROM ({FACTS}) UNION ALL SELECT doc, sent, fact_id, predicate, 'quantity', NULL, CAST(l_quantity AS INTEGER)::VARCHAR, CASE WHEN l_linenumber % 2 = 0 THEN 'int' END FROM ({FACTS})"""
#: Entities: local ids restart in each sentence (order); names are part brands, types depend on where they occur.
ENTS = f"""SELECT doc, sent, 'P' || l_partkey AS id, p_brand AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'Product' ELSE 'Item' END AS type, fact_id FROM ({FACTS}) JOIN part ON l_partkey = p_partkey"""


def _fact_id():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), "l_returnflag")


def _joined(spark, sf_dir):
    """Lines with their order's customer, and how many tasks these need."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem")
    n = tasks(li)
    f = spread(li, n, "l_orderkey").join(spread(o, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return f, n or int(spark.conf.get("spark.sql.shuffle.partitions"))


def facts(spark, sf_dir, by_doc=True):
    """Facts, dealt by document before their long ids are made: so whatever is grouped by document and more needs no further shuffle."""
    f, n = _joined(spark, sf_dir)
    return (f.repartition(n, "o_custkey") if by_doc else f).select(F.col("o_custkey").alias("doc"), F.col("l_orderkey").alias("sent"), _fact_id().alias("fact_id"), F.col("l_returnflag").alias("predicate"),
                                                                   "l_partkey", "l_suppkey", "l_quantity", "l_linenumber", "l_linestatus", "l_shipdate")


def roles(spark, sf_dir):
    none = F.lit(None).cast("string")
    role = lambda n, e, lit, d: F.struct(F.lit(n).alias("role"), e.alias("entity"), lit.alias("literal"), d.alias("datatype"))
    three = F.array(role("part", F.concat(F.lit("P"), F.col("l_partkey")), none, none), role("supplier", F.concat(F.lit("S"), F.col("l_suppkey")), none, none),
                    role("quantity", none, F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "int")))
    return facts(spark, sf_dir).select("doc", "sent", "fact_id", "predicate", F.explode(three).alias("r")).select("doc", "sent", "fact_id", "predicate", "r.*")


def entities(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    f, n = _joined(spark, sf_dir)
    named = f.join(p, F.col("l_partkey") == F.col("p_partkey")).repartition(n, "o_custkey")
    return named.select(F.col("o_custkey").alias("doc"), F.col("l_orderkey").alias("sent"), F.concat(F.lit("P"), F.col("l_partkey")).alias("id"), F.col("p_brand").alias("name"), F.when(F.col("l_linenumber") % 2 == 0, "Product").otherwise("Item").alias("type"), _fact_id().alias("fact_id"))


RESP = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{"k": 1,}' || chr(10) || '```' WHEN 1 THEN 'x ' || props || ' y' WHEN 2 THEN 'none' WHEN 3 THEN '{"k": }' ELSE '{"k": [1, 2,], }' END AS text, props FROM events"""


def responses(spark, sf_dir):
    k = F.col("event_id") % 5
    text = F.when(k == 0, 'Sure:\n```json\n{"k": 1,}\n```').when(k == 1, F.concat(F.lit("x "), "props", F.lit(" y"))).when(k == 2, "none").when(k == 3, '{"k": }').otherwise('{"k": [1, 2,], }')
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"), "props")


@query("k01_parse_responses", f"""
WITH j AS (SELECT event_id, regexp_replace(coalesce(nullif(regexp_extract(text, '```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1, 's'), ''), nullif(regexp_extract(text, '(\\{{.*\\}})', 1, 's'), '')), ',\\s*([}}\\]])', '\\1', 'g') AS json FROM ({RESP}))
SELECT event_id, json, CASE WHEN json IS NULL THEN 'no object' WHEN NOT json_valid(json) THEN 'invalid' END AS reason FROM j""")
def k01(spark, sf_dir):
    return K.parse_responses(responses(spark, sf_dir), "text").select("event_id", "json", "reason")


@query("k02_clean_roles", f"""
SELECT doc, count(*) AS n, count(*) FILTER (WHERE lit = 'unknown') AS placeholders, count(dt) AS typed, sum(sent)::BIGINT AS sentences FROM (
 SELECT doc, sent, CASE WHEN l_linenumber = 3 THEN 'unknown' ELSE CAST(l_quantity AS INTEGER)::VARCHAR END AS lit, CASE WHEN l_linenumber % 2 = 0 THEN 'int' END AS dt FROM ({FACTS}) WHERE l_linenumber <> 7) GROUP BY doc""")
def k02(spark, sf_dir):
    f, k = facts(spark, sf_dir), F.col("l_linenumber")
    none, q = F.lit(None).cast("string"), F.col("l_quantity").cast("int").cast("string")
    r = f.where("l_linenumber <> 7").select("doc", "fact_id", none.alias("entity"), F.when(k == 1, q).alias("literal"), F.when(k == 2, q).alias("value"), F.when(k == 4, q).alias("val"), F.when(k > 4, q).alias("amount"), none.alias("datatype"), F.when(k % 2 == 0, "int").alias("type"))
    fragments = f.select("doc", F.col("sent").alias("fragment"), F.col("sent").alias("sentence_id")).distinct()
    own = f.select("doc", F.col("sent").alias("fragment"), "fact_id", F.when(k != 5, F.col("sent")).alias("sent"))  # some facts lack their sentence
    kept = K.clean_facts(own, r, r.limit(0), fragments)
    c = K.clean_roles(r).join(kept.select("doc", "fact_id").distinct(), ["doc", "fact_id"], "left_semi")
    counts = c.groupBy("doc").agg(F.count("*").alias("n"), F.sum((F.col("literal") == "unknown").cast("long")).alias("placeholders"), F.count("datatype").alias("typed"))
    return written(counts.join(kept.groupBy("doc").agg(F.sum("sent").alias("sentences")), "doc"), "clean-roles", as_dealt=True)


@query("k03_default_truth", "SELECT l_returnflag AS predicate, l_linestatus, CASE WHEN l_linenumber = 1 THEN 0.1 WHEN l_returnflag = 'A' THEN 0.9 WHEN l_returnflag = 'R' THEN 0.7 ELSE 0.5 END::DOUBLE AS truth, count(*) AS n FROM lineitem GROUP BY ALL")
def k03(spark, sf_dir):
    own = F.when(F.col("l_linenumber") == 1, F.array(F.lit(0.1)))
    li = table(spark, sf_dir, "lineitem").withColumn("truth", K.truth_scalar(K.default_truth(own, F.col("l_returnflag"), {"A": 0.9, "R": 0.7}), "first"))
    return li.groupBy(F.col("l_returnflag").alias("predicate"), "l_linestatus", "truth").agg(F.count("*").alias("n"))


@query("k04_integrity", f"""
SELECT violation, count(*) AS n FROM (SELECT 'empty role' AS violation FROM ({FACTS}) WHERE l_linenumber = 1 UNION ALL SELECT 'datatype without literal' FROM ({FACTS}) WHERE l_linenumber IN (1, 2)) GROUP BY violation
UNION ALL SELECT 'unknown field ' || f, count(*) FROM (SELECT unnest(CASE WHEN l_linenumber = 5 THEN ['extra'] WHEN l_linenumber = 6 THEN ['Id', 'note'] END) AS f FROM ({FACTS})) GROUP BY f
UNION ALL SELECT 'roles and arguments', count(DISTINCT fact_id) FROM ({FACTS}) WHERE l_linenumber = 3 UNION ALL SELECT 'neither', count(DISTINCT fact_id) FROM ({FACTS}) WHERE l_linenumber = 4""")
def k04(spark, sf_dir):
    f, k = facts(spark, sf_dir), F.col("l_linenumber")
    r = f.where("l_linenumber <> 4").select("doc", "fact_id", F.lit("part").alias("role"), F.when(k > 2, F.col("l_partkey").cast("string")).alias("entity"), F.when(k == 2, None).otherwise(F.lit(None)).cast("string").alias("literal"), F.when(k <= 2, "int").alias("datatype"), k.alias("k"))
    r = r.withColumn("entity", F.when(F.col("k") == 2, "x").otherwise(F.col("entity")))
    bad = K.role_violations(r).select("violation")
    wrong = K.fact_violations(f.select("doc", "fact_id").distinct(), r, f.where("l_linenumber = 3").select("doc", "fact_id")).select("violation")
    more = F.when(k == 5, ', "extra": 1').when(k == 6, ', "Id": "x", "note": {"tuple": []}').otherwise("")
    raw = f.select("doc", "fact_id", F.concat(F.lit('{"id": "F1", "predicate": "p", "truth_value": [0.5]'), more, F.lit("}")).alias("json"))
    odd = K.unknown_fields(raw, "json").select(F.concat(F.lit("unknown field "), "field"))
    return bad.unionAll(wrong).unionAll(odd).groupBy("violation").agg(F.count("*").alias("n"))


@query("k05_default_date", r"SELECT doc_id, make_date(coalesce(TRY_CAST(nullif(regexp_extract(text, '\b((?:19|20)\d{2})\b', 1), '') AS INTEGER), 1900), 1, 1) AS day FROM documents")
def k05(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.default_date(F.col("text")).alias("day"))


MERGED = f"SELECT doc, name, type, 'E' || row_number() OVER (PARTITION BY doc ORDER BY sent, fact_id) AS new_id FROM (SELECT * FROM ({ENTS}) QUALIFY row_number() OVER (PARTITION BY doc, name ORDER BY sent, fact_id, type) = 1)"


def merged(spark, sf_dir):
    return K.merge_names(entities(spark, sf_dir), F.col("name"), "type", ["sent", "fact_id", "type"], "E")


@query("k06_merge_entities", MERGED)
def k06(spark, sf_dir):
    return merged(spark, sf_dir)


@query("k07_rekey_facts", f"""
SELECT f.doc, f.new_id, count(m.new_id) AS renamed, min(coalesce(m.new_id, r.entity)) AS least FROM (SELECT DISTINCT doc, sent, fact_id, 'F' || dense_rank() OVER (PARTITION BY doc ORDER BY sent, fact_id) || '_' || sent || '_' || doc AS new_id FROM ({FACTS})) f
 JOIN ({ROLES}) r ON f.doc = r.doc AND f.fact_id = r.fact_id LEFT JOIN (SELECT DISTINCT e.doc, e.sent, e.id, m.new_id FROM ({ENTS}) e JOIN ({MERGED}) m ON e.doc = m.doc AND e.name = m.name) m ON r.doc = m.doc AND r.sent = m.sent AND r.entity = m.id GROUP BY f.doc, f.new_id""")
def k07(spark, sf_dir):
    f = K.rekey_facts(facts(spark, sf_dir).select("doc", "sent", "fact_id").distinct(), ["sent", "fact_id"])
    local = entities(spark, sf_dir).select("doc", "sent", "id", "name").distinct()
    r = K.rewrite_roles(roles(spark, sf_dir), local, merged(spark, sf_dir))
    out = r.join(f.select("doc", "fact_id", "new_id").hint("shuffle_merge"), ["doc", "fact_id"]).groupBy("doc", "new_id").agg(F.sum(F.startswith("entity", F.lit("E")).cast("long")).alias("renamed"), F.min("entity").alias("least"))
    return written(out, "rekeyed", as_dealt=True)


@query("k08_rewrite_arguments", f"""
WITH f AS (SELECT doc, sent, fact_id, l_linenumber, dense_rank() OVER (PARTITION BY doc ORDER BY sent, fact_id) AS n FROM ({FACTS})), i AS (SELECT DISTINCT doc, sent, 'F' || l_linenumber AS id, max('N' || n) AS new_id FROM f GROUP BY ALL)
SELECT f.doc, f.fact_id, count(*) AS n, max(coalesce(i.new_id, 'F' || (f.l_linenumber + 1))) AS arg FROM f LEFT JOIN i ON f.doc = i.doc AND f.sent = i.sent AND i.id = 'F' || (f.l_linenumber + 1) GROUP BY f.doc, f.fact_id""")
def k08(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("n", F.dense_rank().over(K.Window.partitionBy("doc").orderBy("sent", "fact_id")))
    ids = f.groupBy("doc", "sent", F.concat(F.lit("F"), F.col("l_linenumber")).alias("id")).agg(F.max(F.concat(F.lit("N"), F.col("n"))).alias("new_id"))
    a = f.select("doc", "sent", "fact_id", F.lit(0).alias("pos"), F.concat(F.lit("F"), F.col("l_linenumber") + 1).alias("arg"))
    return K.rewrite_args(a, ids).groupBy("doc", "fact_id").agg(F.count("*").alias("n"), F.max("arg").alias("arg"))


@query("k09_document_metadata", """
SELECT doc, string_agg(sentence_id, ',' ORDER BY n) AS sentences, sum(c)::BIGINT AS fragments, (SELECT string_agg(DISTINCT y, ',' ORDER BY y) FROM (SELECT o_custkey, 'PM' || o_orderkey % 3 AS y FROM orders) WHERE o_custkey = doc) AS sources, (SELECT string_agg(DISTINCT y, ',' ORDER BY y) FROM (SELECT o_custkey, year(o_orderdate)::VARCHAR AS y FROM orders) WHERE o_custkey = doc) AS years FROM (SELECT o_custkey AS doc, 'SENT_' || o_orderkey AS sentence_id, o_orderkey AS n, count(*) AS c FROM orders GROUP BY ALL) GROUP BY doc""")
def k09(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.concat(F.lit("SENT_"), F.col("o_orderkey")).alias("sentence_id"), F.concat(F.lit("PM"), F.col("o_orderkey") % 3).alias("source_id"), F.year("o_orderdate").cast("string").alias("year"))
    return K.document_metadata(o)


@query("k10_merge_nodes", f"""
SELECT doc, name, type, 'N' || row_number() OVER (PARTITION BY doc ORDER BY sent, fact_id) AS new_id FROM (SELECT doc, sent, fact_id, type, CASE WHEN name = 'Brand#1' THEN id ELSE name END AS name FROM ({ENTS}) QUALIFY row_number() OVER (PARTITION BY doc, CASE WHEN name = 'Brand#1' THEN id ELSE name END ORDER BY sent, fact_id, type) = 1)""")
def k10(spark, sf_dir):
    e = entities(spark, sf_dir).withColumn("name", F.when(F.col("name") == "Brand#1", " ").otherwise(F.col("name")))
    return K.merge_names(e, F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("id")), "type", ["sent", "fact_id", "type"], "N")


LINKS = f"SELECT DISTINCT doc, sent, fact_id AS id, 'EvaluationLink' AS link_type, predicate, 'S' || l_suppkey AS a, 'Q' || CAST(l_quantity AS INTEGER) AS b, CASE WHEN l_linenumber % 2 = 0 THEN 0.9 ELSE 0.5 END AS tv, l_linestatus AS line FROM ({FACTS})"
#: All fields of a link but its id.
FIELDS = "doc, predicate, a, b, tv, line"


def _tasks(spark, sf_dir):
    return tasks(table(spark, sf_dir, "lineitem"))


def links(spark, sf_dir):
    """Distinct links; they are told apart by what they are made of, which is far shorter."""
    own = facts(spark, sf_dir).select("doc", "sent", F.col("fact_id").alias("id"), "predicate", F.concat(F.lit("S"), F.col("l_suppkey")).alias("a"), F.concat(F.lit("Q"), F.col("l_quantity").cast("int")).alias("b"), F.when(F.col("l_linenumber") % 2 == 0, 0.9).otherwise(0.5).alias("tv"), F.col("l_linestatus").alias("line"))
    own = own.distinct()
    return own.select("doc", "sent", "id", F.lit("EvaluationLink").alias("link_type"), "predicate", F.array("a", "b").alias("arguments"), F.array("tv").alias("truth_value"), F.array(F.struct(F.lit("line").alias("key"), F.col("line").alias("value"))).alias("attributes"))


@query("k11_merge_links", f"""
SELECT l.doc, l.id, 'L' || m.n AS canonical, l.id = m.id AS first FROM ({LINKS}) l JOIN (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY id) AS n FROM (SELECT * FROM ({LINKS}) QUALIFY row_number() OVER (PARTITION BY {FIELDS} ORDER BY id) = 1)) m
 ON l.doc = m.doc AND l.predicate = m.predicate AND l.a = m.a AND l.b = m.b AND l.tv = m.tv AND l.line = m.line""")
def k11(spark, sf_dir):
    return K.merge_links(links(spark, sf_dir), ["id"]).select("doc", "id", "canonical", "first")


@query("k12_rewrite_link_arguments", f"""
WITH m AS (SELECT l.doc, l.sent, l.id, 'L' || k.n AS new_id FROM ({LINKS}) l JOIN (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY id) AS n FROM (SELECT * FROM ({LINKS}) QUALIFY row_number() OVER (PARTITION BY {FIELDS} ORDER BY id) = 1)) k ON l.doc = k.doc AND l.predicate = k.predicate AND l.a = k.a AND l.b = k.b AND l.tv = k.tv AND l.line = k.line)
SELECT doc, id AS fact_id, new_id AS arg FROM m UNION ALL SELECT doc, id, 'missing' FROM m""")
def k12(spark, sf_dir):
    m = K.merge_links(links(spark, sf_dir), ["id"])
    given = F.concat(F.lit('["'), F.col("id"), F.lit('", 7, {"arguments": []}, "missing", null, ["x"], true]'))
    a = m.select("doc", "sent", F.col("id").alias("fact_id"), F.posexplode(K.string_arguments(given)).alias("pos", "arg"))
    return K.rewrite_args(a, m.select("doc", "sent", "id", F.col("canonical").alias("new_id"))).select("doc", "fact_id", "arg")


#: Orders refer to the order of their key without its last digit. Two cycles, 3 and 30, and 5 and 52, of which the second refers to the first; 4 refers to 31, and 7 to 15.
MORE = ((7, 15), (3, 30), (5, 52), (52, 3), (4, 31))
CHAIN = "SELECT o_orderkey AS parent, o_orderkey // 10 AS child FROM orders WHERE o_orderkey >= 10 UNION ALL VALUES " + ", ".join(map(str, MORE))
CLOSURE = f"""WITH RECURSIVE e AS ({CHAIN}), c AS (SELECT parent AS root, child AS node, 1 AS depth, [parent, child] AS path FROM e WHERE parent <> child UNION ALL SELECT root, e.child, depth + 1, list_append(path, e.child) FROM c JOIN e ON c.node = e.parent WHERE NOT list_contains(path, e.child))"""


def chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey >= 10").select(F.col("o_orderkey").alias("parent"), F.expr("o_orderkey div 10").alias("child"))
    return o.unionAll(spark.createDataFrame(list(MORE), "parent long, child long"))


@query("k13_closure", f"{CLOSURE} SELECT root, node, min(depth) AS depth, array_to_string(min_by(path, {{'d': depth, 'p': path}}), '/') AS path FROM c GROUP BY root, node")
def k13(spark, sf_dir):
    return K.closure(chain(spark, sf_dir), paths=True).select("root", "node", "depth", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"))


@query("k14_lookup", f"""
SELECT DISTINCT 'P' || p_partkey AS id, CASE WHEN p_size = 1 THEN 'P' || p_partkey ELSE p_brand END AS label, 'node' AS kind FROM part UNION SELECT DISTINCT fact_id, predicate, 'fact' FROM ({FACTS})
UNION SELECT DISTINCT lit, lit, 'literal' FROM (SELECT CASE WHEN datatype IS NOT NULL THEN literal || '/' || datatype ELSE literal END AS lit FROM ({ROLES}) WHERE literal IS NOT NULL)""")
def k14(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("id"), F.when(F.col("p_size") == 1, " ").otherwise(F.col("p_brand")).alias("name"))
    return K.lookup(n, facts(spark, sf_dir, by_doc=False), roles(spark, sf_dir))


def role_names(spark, sf_dir):
    """Roles and predicates, read off the lines: no facts are joined for them."""
    return table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.lit("part"), F.lit("supplier"), F.lit("quantity"), "l_returnflag"))).distinct()


LABEL = "coalesce({t}.entity, CASE WHEN {t}.datatype IS NOT NULL THEN {t}.literal || '/' || {t}.datatype ELSE {t}.literal END)"


@query("k15_role_pairs", f"""
SELECT {LABEL.format(t='a')} AS s, '[' || a.role || ']:' || a.predicate || ':[' || b.role || ']' AS p, {LABEL.format(t='b')} AS o, count(*) AS n FROM ({ROLES}) a JOIN ({ROLES}) b ON a.doc = b.doc AND a.fact_id = b.fact_id AND a.role <> b.role GROUP BY ALL""")
def k15(spark, sf_dir):
    return K.role_pairs(roles(spark, sf_dir), role_names(spark, sf_dir))


#: Arguments: facts 2 and 4 of a sentence refer to the next one, facts 4 and 5 hold the next one itself.
ARGS = f"SELECT DISTINCT a.doc, a.fact_id, b.fact_id AS arg, a.l_linenumber > 3 AS nested FROM ({FACTS}) a JOIN ({FACTS}) b ON a.doc = b.doc AND a.sent = b.sent AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_linenumber IN (2, 4, 5)"
NESTED = f"""WITH a AS ({ARGS}), f AS (SELECT DISTINCT doc, fact_id, predicate FROM ({FACTS})),
o AS (SELECT doc, fact_id, role, {LABEL.format(t='r')} AS label FROM ({ROLES}) r UNION ALL SELECT a.doc, a.fact_id, 'fact_arg', f.predicate FROM a JOIN f ON a.doc = f.doc AND a.arg = f.fact_id),
d AS (SELECT DISTINCT doc, fact_id, arg FROM a WHERE nested),
r AS (SELECT * FROM o UNION ALL SELECT d.doc, d.fact_id, 'fact_arg->' || role, label FROM d JOIN o ON d.doc = o.doc AND d.arg = o.fact_id
 UNION ALL SELECT d.doc, d.fact_id, 'fact_arg->fact_arg->' || role, label FROM d JOIN d e ON d.doc = e.doc AND d.arg = e.fact_id JOIN o ON e.doc = o.doc AND e.arg = o.fact_id)
SELECT x.label AS s, '[' || x.role || ']:' || f.predicate || ':[' || y.role || ']' AS p, y.label AS o, count(*) AS n FROM r x JOIN r y ON x.doc = y.doc AND x.fact_id = y.fact_id AND x.role <> y.role JOIN f ON x.doc = f.doc AND x.fact_id = f.fact_id GROUP BY ALL"""


def fact_args(f):
    nxt = F.collect_set("fact_id").over(K.Window.partitionBy("doc", "sent").orderBy("l_linenumber").rangeBetween(1, 1))
    held = f.withColumn("args", nxt).where("l_linenumber in (2, 4, 5)")
    return held.select("doc", "fact_id", F.explode("args").alias("arg"), (F.col("l_linenumber") > 3).alias("nested")).distinct()


@query("k15_nested_facts", NESTED)
def k15_nested(spark, sf_dir):
    f = facts(spark, sf_dir)
    return K.nested_role_pairs(roles(spark, sf_dir), f, fact_args(f), _tasks(spark, sf_dir), role_names(spark, sf_dir))


@query("k16_argument_pairs", f"""
WITH p AS (SELECT doc, id, predicate || '#' AS p, a AS s, b AS o FROM ({LINKS}) UNION ALL SELECT doc, id, predicate || '#', b, a FROM ({LINKS})) SELECT s, p, o, count(*) AS n FROM p GROUP BY ALL""")
def k16(spark, sf_dir):
    ls = links(spark, sf_dir)
    labels = ls.select("doc", F.explode("arguments").alias("id")).distinct().withColumn("label", F.col("id"))
    return K.argument_pairs(ls.withColumn("suffix", F.lit("#")), labels, _tasks(spark, sf_dir))


PROV = "SELECT predicate AS s, '{p}' AS p, ({c})::VARCHAR AS o, count(*) AS n FROM ({f}) GROUP BY ALL"


@query("k17_provenance", " UNION ALL ".join(PROV.format(p=p, c=c, f=FACTS) for p, c in (("has_timestamp", "strftime(l_shipdate, '%Y-%m')"), ("has_sentence", "sent"), ("has_truth_value", "l_linenumber")))
       + " UNION ALL SELECT o_orderstatus, 'has_context', strftime(o_orderdate, '%Y-%m'), count(*) FROM orders GROUP BY ALL")
def k17(spark, sf_dir):
    own = K.provenance(facts(spark, sf_dir, by_doc=False).select("predicate", F.date_format("l_shipdate", "yyyy-MM").alias("day"), "sent", F.col("l_linenumber").alias("truth")))
    o = table(spark, sf_dir, "orders")
    evaluations = o.select(F.col("o_custkey").alias("doc"), F.concat(F.lit("V"), "o_orderkey").alias("id"), F.col("o_orderstatus").alias("predicate"))
    labels = o.select(F.col("o_custkey").alias("doc"), F.concat(F.lit("T"), "o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("label"))  # sentences have none here
    return own.unionByName(K.context_triples(members(spark, sf_dir), evaluations, labels))


MEMBERS = """SELECT o_custkey AS doc, 'C' || o_orderkey AS link, 0 AS pos, 'T' || o_orderkey AS member, 'TimestampNode' AS member_type, strftime(o_orderdate, '%Y-%m-%d') AS name FROM orders
 UNION ALL SELECT o_custkey, 'C' || o_orderkey, 1, 'S' || o_orderkey, 'ConceptNode', 'SENT_' || o_orderkey FROM orders UNION ALL SELECT o_custkey, 'C' || o_orderkey, 2, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'V' END || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'AndLink' ELSE 'EvaluationLink' END, NULL FROM orders
 UNION ALL SELECT o_custkey, 'A' || o_orderkey, 0, 'V' || o_orderkey, 'EvaluationLink', NULL FROM orders WHERE o_orderkey % 2 = 0"""


def members(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = lambda p: F.concat(p if not isinstance(p, str) else F.lit(p), F.col("o_orderkey"))
    even = F.col("o_orderkey") % 2 == 0
    row = lambda link, pos, member, kind, name: F.struct(link.alias("link"), F.lit(pos).alias("pos"), member.alias("member"), kind.alias("member_type"), name.alias("name"))
    none = F.lit(None).cast("string")
    ms = F.array(row(s("C"), 0, s("T"), F.lit("TimestampNode"), F.date_format("o_orderdate", "yyyy-MM-dd")), row(s("C"), 1, s("S"), F.lit("ConceptNode"), s("SENT_")),
                 row(s("C"), 2, F.when(even, s("A")).otherwise(s("V")), F.when(even, "AndLink").otherwise("EvaluationLink"), none), F.when(even, row(s("A"), 0, s("V"), F.lit("EvaluationLink"), none)))
    return o.select(F.col("o_custkey").alias("doc"), F.explode(ms).alias("m")).where("m is not null").select("doc", "m.*")


@query("k18_contexts", """
SELECT o_custkey AS doc, 'C' || o_orderkey AS link, strftime(o_orderdate, '%Y-%m-%d') AS timestamp, 'SENT_' || o_orderkey AS sentence, o_custkey || '/V' || o_orderkey AS evaluation FROM orders
UNION ALL SELECT o_custkey, 'A' || o_orderkey, NULL, NULL, o_custkey || '/V' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0""")
def k18(spark, sf_dir):
    return K.contexts(members(spark, sf_dir))


@query("k19_truth_scalar", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value / 2 ELSE value END AS second, value AS first FROM events")
def k19(spark, sf_dir):
    tv = F.when(F.col("event_id") % 3 == 0, F.array("value", F.col("value") / 2)).otherwise(F.array("value"))
    return table(spark, sf_dir, "events").select("event_id", K.truth_scalar(tv).alias("second"), K.truth_scalar(tv, "first").alias("first"))


HUB = f"""SELECT DISTINCT 'D' || doc AS src, 'S' || sent AS dst, 'has_sentence' AS label FROM ({FACTS}) UNION ALL SELECT 'S' || sent, 'F' || fact_id, 'has_fact' FROM ({FACTS}) UNION ALL SELECT 'F' || fact_id, 'E' || entity, role FROM ({ROLES}) WHERE entity IS NOT NULL
 UNION ALL SELECT 'F' || fact_id, 'F' || arg, 'argument' FROM ({ARGS})"""


def hub(spark, sf_dir):
    f = facts(spark, sf_dir)
    args = fact_args(f).select("doc", "fact_id", "arg").unionAll(f.select("doc", "fact_id", F.lit("gone")))  # some exist, some don't
    return K.hub_edges(f.select("doc").distinct(), f, roles(spark, sf_dir), args)


@query("k20_hub_edges", f"SELECT label, src, count(*) AS n, min(dst) AS least FROM ({HUB}) GROUP BY label, src")
def k20(spark, sf_dir):
    """Counts of a vertex are made inside its document, and take one row to meet those of other documents."""
    own = hub(spark, sf_dir).groupBy("doc", "src", "label").agg(F.count("*").alias("n"), F.min("dst").alias("least"))
    shown = own.groupBy("doc", "src").agg(F.collect_list(F.struct("label", "n", "least")).alias("x")).drop("doc")
    dealt = shown.repartition(_tasks(spark, sf_dir) or int(spark.conf.get("spark.sql.shuffle.partitions")), "src")
    return dealt.select("src", F.explode("x").alias("x")).groupBy(F.col("x.label").alias("label"), "src").agg(F.sum("x.n").alias("n"), F.min("x.least").alias("least"))


NAMES21 = "SELECT doc_id, w[i] AS name FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS w FROM documents), unnest(range(1, len(w) + 1)) r(i)"


@query("k21_mentions", f"""
SELECT DISTINCT s.doc_id, s.sent_id, n.name FROM (SELECT doc_id, (i - 1)::INTEGER AS sent_id, s[i] AS sentence FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS r(i)) s JOIN ({NAMES21}) n ON s.doc_id = n.doc_id AND contains(s.sentence, n.name)""")
def k21(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    names = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), 0))).alias("name"))
    return K.mentions(d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent_id", "sentence")), names)


@query("k22_sentence_nodes", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'SentenceNode' ELSE 'ConceptNode' END AS type, CASE WHEN o_orderkey % 2 = 0 THEN 'SENT_' || o_orderkey ELSE 'c' || o_orderkey END AS name FROM orders")
def k22(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x:SENT_"), F.col("o_orderkey"))).otherwise(F.concat(F.lit("c"), F.col("o_orderkey")))
    return K.clean_sentence_nodes(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("ConceptNode").alias("type"), name.alias("name")))


@query("k23_link_edges", f"""
WITH f AS (SELECT doc, min(a) AS t FROM ({LINKS}) GROUP BY doc) SELECT l.doc, dst, id AS src, label FROM (SELECT doc, id, a AS dst, 'argument' AS label FROM ({LINKS}) UNION ALL SELECT doc, id, predicate, 'predicate' FROM ({LINKS}) WHERE predicate <> 'N') l JOIN f ON l.doc = f.doc WHERE dst <> t""")
def k23(spark, sf_dir):
    ls = links(spark, sf_dir)
    node = lambda i, kind: F.struct(i.alias("id"), F.lit(kind).alias("type"))
    two = F.array(node(F.get("arguments", F.lit(0)), "TimestampNode"), node(F.when(F.col("predicate") != "N", F.col("predicate")), "PredicateNode"))
    nodes = ls.select("doc", F.explode(two).alias("n")).select("doc", "n.*").where("type = 'TimestampNode' or id is not null").distinct()
    return K.link_edges(ls, nodes)


VERT = "SELECT 'D' || c_custkey AS id, 'Document' AS class FROM customer UNION ALL SELECT 'S' || o_orderkey, 'Sentence' FROM orders"
EDGE = "SELECT 'D' || o_custkey AS src, 'S' || o_orderkey AS dst FROM orders WHERE o_orderkey % 3 <> 0"


def small_graph(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    v = c.select(F.concat(F.lit("D"), F.col("c_custkey")).alias("id"), F.lit("Document").alias("class")).unionAll(o.select(F.concat(F.lit("S"), F.col("o_orderkey")), F.lit("Sentence")))
    return v, o.where("o_orderkey % 3 <> 0").select(F.concat(F.lit("D"), F.col("o_custkey")).alias("src"), F.concat(F.lit("S"), F.col("o_orderkey")).alias("dst"))


@query("k24_summary", f"SELECT 'class:' || class AS what, count(*) AS n FROM ({VERT}) GROUP BY class UNION ALL SELECT 'edges', count(*) FROM ({EDGE}) UNION ALL SELECT 'isolated', count(*) FROM ({VERT}) WHERE id NOT IN (SELECT src FROM ({EDGE}) UNION SELECT dst FROM ({EDGE}))")
def k24(spark, sf_dir):
    return K.summary(*small_graph(spark, sf_dir))


@query("k25_connected", f"SELECT id, class FROM ({VERT}) WHERE id IN (SELECT src FROM ({EDGE}) UNION SELECT dst FROM ({EDGE}))")
def k25(spark, sf_dir):
    return K.connected(*small_graph(spark, sf_dir))


@query("k26_schema_profile", f"""
SELECT CASE WHEN r.entity IS NULL THEN 'literal' ELSE coalesce(e.type, '?') END AS type, predicate, role, count(*) AS participation, max(multi) AS max_multiplicity, bool_or(literal IS NOT NULL) AS literal_role
FROM (SELECT *, count(*) OVER (PARTITION BY doc, fact_id, role) AS multi FROM ({ROLES})) r LEFT JOIN (SELECT doc, id, min(type) AS type FROM ({ENTS}) GROUP BY doc, id) e ON r.doc = e.doc AND r.entity = e.id GROUP BY ALL""")
def k26(spark, sf_dir):
    e = entities(spark, sf_dir).groupBy("doc", "id").agg(F.min("type").alias("type"))
    return K.schema_profile(roles(spark, sf_dir), e)


@query("k27_unique_labels", r"""
WITH s AS (SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[\s-]+', '_', 'g') AS stem FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) - CASE WHEN stem IN ('red_widget', 'small_ring') THEN 0 ELSE 1 END AS k FROM s)
SELECT p_partkey, CASE WHEN k = 0 THEN stem ELSE stem || '_' || k END AS unique_label FROM n""")
def k27(spark, sf_dir):
    return K.unique_labels(table(spark, sf_dir, "part"), "p_name", ["p_partkey"], ["red_widget", "small_ring"]).select("p_partkey", "unique_label")


@query("k28_kebab", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'n' || p_partkey || '-' ELSE '' END || regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') || '-' || replace(p_name, ' ', '-') AS id FROM part")
def k28(spark, sf_dir):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit("_ "))).otherwise(""), "p_type", F.lit("/"), "p_name", F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", kebab(raw).alias("id"))


@query("k29_flatten_attributes", "SELECT event_id, value AS m_value, user_id AS m_who_user, event_type AS m_who_kind FROM events")
def k29(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.struct("value", F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("who")).alias("m"))
    return K.flatten_attributes(e)


@query("k29_flatten_json", """
SELECT event_id, path, kind, value FROM (SELECT event_id, unnest(['m_value', 'm_who_user', 'm_who_kind', 'tags', 'mixed', 'none']) AS path,
 unnest(['BIGINT', 'BIGINT', 'STRING', 'ARRAY', CASE event_id % 3 WHEN 0 THEN 'BOOLEAN' WHEN 1 THEN 'STRING' ELSE 'BIGINT' END, 'VOID']) AS kind,
 unnest([floor(value)::BIGINT::VARCHAR, user_id::VARCHAR, event_type, '[1,"a"]', CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'x' ELSE '7' END, NULL]) AS value FROM events WHERE event_id % 10 <> 0)""")
def k29_json(spark, sf_dir):
    k = F.col("event_id") % 3
    mixed = F.when(k == 0, "true").when(k == 1, '"x"').otherwise("7")
    text = F.format_string('{"m": {"value": %d, "who": {"user": %d, "kind": "%s", "more": {}}}, "tags": [1, "a"], "mixed": %s, "none": null}', F.floor("value"), "user_id", "event_type", mixed)
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "no {json").otherwise(text).alias("text"))
    return K.flatten_json(e, "event_id", "text")


ATTRS = """SELECT event_type AS owner, 'k' AS key, props AS value FROM events UNION ALL SELECT event_type, 'id', event_id::VARCHAR FROM events UNION ALL SELECT event_type, 'mixed', CASE WHEN event_id % 2 = 0 THEN '1.5' ELSE '2' END FROM events
 UNION ALL SELECT event_type, 'day', strftime(ts, '%Y-%m-%d') FROM events UNION ALL SELECT event_type, 'odd', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'FALSE' END FROM events UNION ALL SELECT event_type, 'any', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '7' END FROM events"""


def attrs(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    kv = F.map_from_arrays(F.array(*map(F.lit, ("k", "id", "mixed", "day", "odd", "any"))), F.array("props", F.col("event_id").cast("string"), F.when(even, "1.5").otherwise("2"), F.date_format("ts", "yyyy-MM-dd"), F.when(even, "true").otherwise("FALSE"), F.when(even, "true").otherwise("7")))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("owner"), F.explode(kv).alias("key", "value"))


@query("k30_attribute_kinds", "SELECT DISTINCT owner, key, CASE key WHEN 'k' THEN 'string' WHEN 'id' THEN 'long' WHEN 'mixed' THEN 'double' WHEN 'day' THEN 'datetime' WHEN 'odd' THEN 'boolean' ELSE 'string' END AS kind FROM (" + ATTRS + ")")
def k30(spark, sf_dir):
    return K.attribute_kinds(attrs(spark, sf_dir))


#: Keys of an edge: subject, tag (a supplier of even number is known) and note (a part number on every third line, which is known, else a tax).
PARTS31 = """SELECT edge, relation, key, value, CASE WHEN key = 'subject' OR known THEN 'role' ELSE 'attribute' END AS part, CASE WHEN known THEN type WHEN key = 'subject' THEN 'Unknown' END AS type FROM (
 SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS edge, l_returnflag AS relation, k.key, k.value, s.s_suppkey IS NOT NULL OR p.p_partkey IS NOT NULL AS known, CASE WHEN s.s_suppkey IS NOT NULL THEN 'Supplier' ELSE 'Part' END AS type
 FROM lineitem, LATERAL (VALUES ('subject', 'P' || l_partkey), ('tag', 'S' || l_suppkey), ('note', CASE WHEN l_linenumber % 3 = 0 THEN 'P' || l_partkey ELSE 'n' || l_tax END)) k(key, value)
 LEFT JOIN supplier s ON k.value = 'S' || s.s_suppkey AND s.s_suppkey % 2 = 0 LEFT JOIN part p ON k.value = 'P' || p.p_partkey AND p.p_partkey % 5 <> 0)"""


def relation_parts(spark, sf_dir):
    note = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("P"), F.col("l_partkey"))).otherwise(F.concat(F.lit("n"), F.col("l_tax")))
    kv = F.map_from_arrays(F.array(*map(F.lit, ("subject", "tag", "note"))), F.array(F.concat(F.lit("P"), F.col("l_partkey")), F.concat(F.lit("S"), F.col("l_suppkey")), note))
    e = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("edge"), F.col("l_returnflag").alias("relation"), F.explode(kv).alias("key", "value"))
    ids = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"), F.lit("Supplier").alias("type"))
    return K.relation_parts(e, ids.unionAll(table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.concat(F.lit("P"), F.col("p_partkey")), F.lit("Part"))), _tasks(spark, sf_dir))


@query("k31_relation_parts", PARTS31)
def k31_parts(spark, sf_dir):
    return relation_parts(spark, sf_dir)


@query("k31_relation_schema", f"""
SELECT relation, key, part, string_agg(DISTINCT type, ',' ORDER BY type) AS types, CASE WHEN part = 'attribute' THEN 'string' END AS kind, count(*) AS n FROM ({PARTS31}) GROUP BY relation, key, part""")
def k31_schema(spark, sf_dir):
    return K.relation_schema(relation_parts(spark, sf_dir)).withColumn("types", F.array_join("types", ","))


#: A duplicated line makes one edge.
@query("k31_relation_instances", f"""
SELECT edge, relation, coalesce(string_agg(key || '=' || v, ';' ORDER BY key) FILTER (WHERE part = 'role'), '') AS roles, coalesce(string_agg(key || '=' || v, ';' ORDER BY key) FILTER (WHERE part = 'attribute'), '') AS attributes
FROM (SELECT edge, relation, part, key, string_agg(DISTINCT value, ',' ORDER BY value) AS v FROM ({PARTS31}) GROUP BY ALL) GROUP BY edge, relation""")
def k31(spark, sf_dir):
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], ","))), ";").alias(c)
    return K.relation_instances(relation_parts(spark, sf_dir), _tasks(spark, sf_dir)).select("edge", "relation", shown("roles"), shown("attributes"))


@query("k32_dependency_levels", f"""
{CLOSURE}, r AS (SELECT DISTINCT root, node FROM c), own AS (SELECT o_orderkey AS id FROM orders), cyc AS (SELECT x.root AS id, least(x.root, min(x.node)) AS comp FROM r x JOIN r y ON x.root = y.node AND x.node = y.root GROUP BY x.root),
late AS (SELECT id FROM cyc UNION SELECT root FROM r JOIN cyc ON node = id), early AS (SELECT own.id, coalesce(max(depth), 0) AS level FROM own LEFT JOIN c ON root = own.id WHERE own.id NOT IN (SELECT id FROM late) GROUP BY own.id),
named AS (SELECT late.id, comp, coalesce(comp, late.id) AS spot FROM late LEFT JOIN cyc USING (id)), ce AS (SELECT DISTINCT p.spot AS parent, k.spot AS child FROM e JOIN named p ON p.id = e.parent JOIN named k ON k.id = e.child WHERE p.spot <> k.spot),
up AS (SELECT DISTINCT spot, 0 AS depth FROM named UNION SELECT ce.parent, depth + 1 FROM up JOIN ce ON ce.child = up.spot)
SELECT id, level::INTEGER AS level, NULL::BIGINT AS cycle FROM early UNION ALL SELECT id, (max(depth) + 1 + (SELECT max(level) FROM early))::INTEGER, comp FROM named JOIN up USING (spot) GROUP BY id, comp""")
def k32(spark, sf_dir):
    return K.dependency_levels(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), chain(spark, sf_dir))


@query("k33_simplify", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'plain:' || o_orderstatus END AS label FROM orders")
def k33(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("[a]:"), "o_orderpriority", F.lit(":[b]"))).otherwise(F.concat(F.lit("plain:"), "o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", K.simplify(raw).alias("label"))


TRIPLES = "SELECT o_orderkey::VARCHAR AS s, o_orderstatus AS p, o_custkey::VARCHAR AS o, ('0x' || substr(md5(o_orderkey || ':' || o_custkey), 1, 8))::BIGINT % 100 AS b FROM orders"


@query("k34_split_triples", f"""
WITH t AS (SELECT *, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'valid' ELSE 'test' END AS part FROM ({TRIPLES})) SELECT s, p, o, part FROM t UNION ALL SELECT o, p || '_inverse', s, part FROM t WHERE part = 'train'""")
def k34(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("s"), F.col("o_orderstatus").alias("p"), F.col("o_custkey").cast("string").alias("o"))
    return K.split_triples(t, md5_bucket(F.concat_ws(":", "s", "o"), 100))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


DIST = "round(-sqrt(list_sum(list_transform(list_zip(q.h, q.r, e.v), lambda z: (z[1] + z[2] - z[3]) * (z[1] + z[2] - z[3])))), 9)"
VEC = "(SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


@query("k35_rank_tails", f"""
WITH s AS (SELECT q.id AS query, e.id, {DIST} AS score FROM (SELECT a.id, a.v AS h, b.v AS r FROM {VEC} a JOIN {VEC} b ON b.id = a.id + 1 WHERE a.id % 100 = 0) q, {VEC} e)
SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 10""")
def k35(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = v.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("v").alias("h")).join(v.select((F.col("id") - 1).alias("query"), F.col("v").alias("r")), "query")
    return K.rank_tails(q, v, 10)


RANKS = f"""WITH s AS (SELECT q.id AS query, CASE WHEN q.id % 200 = 0 THEN 'head' ELSE 'tail' END AS side, e.id AS candidate, round({DIST}, 2) AS score, e.id = q.id + 2 AS is_true FROM (SELECT a.id, a.v AS h, b.v AS r FROM {VEC} a JOIN {VEC} b ON b.id = a.id + 1 WHERE a.id % 100 = 0) q, {VEC} e),
r AS (SELECT s.query, s.side, count(*) AS n, count(*) FILTER (WHERE s.score > t.score) AS above, count(*) FILTER (WHERE s.score = t.score) AS ties FROM s JOIN s t ON s.query = t.query AND t.is_true GROUP BY ALL), x AS (SELECT side, n, (above + 1 + above + ties) / 2 AS rank FROM r), b AS (SELECT * FROM x UNION ALL SELECT 'both', n, rank FROM x)"""


@query("k36_rank_metrics", f"""
{RANKS} SELECT side, round(avg(rank), 9) AS mr, round(avg(1 / rank), 9) AS mrr, round(median(rank), 9) AS median, avg((rank <= 1)::INTEGER) AS hits_1, avg((rank <= 3)::INTEGER) AS hits_3, avg((rank <= 5)::INTEGER) AS hits_5, avg((rank <= 10)::INTEGER) AS hits_10, round(1 - (avg(rank) - 1) / avg((n - 1) / 2), 9) AS amri FROM b GROUP BY side""")
def k36(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = v.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("v").alias("h")).join(v.select((F.col("id") - 1).alias("query"), F.col("v").alias("r")), "query")
    q = q.select("query", F.when(F.col("query") % 200 == 0, "head").otherwise("tail").alias("side"), "h", "r", (F.col("query") + 2).alias("true_id"))
    return K.rank_metrics(K.true_ranks(q, v, 2)).withColumns({c: F.round(c, 9) for c in ("mr", "mrr", "median", "amri")})


@query("k37_verbalise", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id || ' is shown ' || event_type WHEN 1 THEN 'is shown: ' || user_id || ', ' || event_type || ', x' END AS text FROM events")
def k37(spark, sf_dir):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 3
    args = F.when(k == 0, F.array(u, "event_type")).when(k == 1, F.array(u, F.col("event_type"), F.lit("x"))).otherwise(F.array(u))
    return table(spark, sf_dir, "events").select("event_id", K.verbalise(args, F.lit("is_shown")).alias("text"))


@query("k38_parse_relation_lines", "SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS source, event_type AS relation, user_id || '|' || event_id AS entities FROM events WHERE event_id % 4 > 1")
def k38(spark, sf_dir):
    k = F.col("event_id") % 4
    line = F.when(k == 0, "# note: a").when(k == 1, "has_timestamp: x").otherwise(F.format_string("%s: %d, %d", "event_type", "user_id", "event_id"))
    got = K.parse_relation_lines(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("n"), line.alias("line")))
    return got.withColumn("entities", F.array_join("entities", "|"))


@query("k39_attribute_triples", "SELECT event_id AS id, 'has-attr' AS p, 'kind' AS key, event_type AS value, false AS numeric FROM events UNION ALL SELECT event_id, 'has-attr', 'user', user_id::VARCHAR, true FROM events")
def k39(spark, sf_dir):
    return K.attribute_triples(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.create_map(F.lit("kind"), "event_type", F.lit("user"), F.col("user_id").cast("string")).alias("attributes")))


@query("k40_single_answer", f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN '1,' WHEN 1 THEN trim(split_part(rtrim(props, '}}'), ':', 2)) WHEN 3 THEN '' WHEN 4 THEN '[1, 2,],' END AS answer, CASE event_id % 5 WHEN 1 THEN trim(split_part(rtrim(props, '}}'), ':', 2))::INTEGER END AS number FROM events")
def k40(spark, sf_dir):
    value, number = K.single_answer(F.col("text"))
    return responses(spark, sf_dir).select("event_id", value.alias("answer"), number.alias("number"))


@query("k41_reference_check", "SELECT count(*) AS total, count(DISTINCT c) AS distinct_ids, count(*) FILTER (WHERE l_partkey % 10 = 0) AS orphans, min(c) FILTER (WHERE l_partkey % 10 = 0) AS sample FROM (SELECT l_partkey, 'P' || l_partkey AS c FROM lineitem)")
def k41(spark, sf_dir):
    children = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey")).alias("child"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("id"), "p_partkey")
    return K.reference_check(children, p.where("p_partkey % 10 in (1, 2, 3, 4, 5)").select("id"), p.where("p_partkey % 10 > 5").select("id"))


@query("k42_study_metadata", "SELECT c_custkey AS doc, c_mktsegment AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Study' ELSE 'Drug' END AS type, CASE WHEN c_custkey % 2 = 0 THEN 'src' || n_nationkey END AS source_id, CASE WHEN c_custkey % 2 = 0 THEN 2000 + n_nationkey END AS year FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def k42(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("src"), F.col("n_nationkey")).alias("source_id"), (F.col("n_nationkey") + 2000).alias("year"))
    docs = c.select("c_custkey", "c_nationkey").join(n, "c_nationkey", "left").select(F.col("c_custkey").alias("doc"), "source_id", "year")
    e = c.select(F.col("c_custkey").alias("doc"), F.col("c_mktsegment").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "Study").otherwise("Drug").alias("type"))
    return K.study_metadata(e, docs)


@query("s09_export_nodes", "SELECT p_partkey % 10 AS doc, CASE WHEN p_partkey % 4 = 0 THEN 'anon_' || substr(md5('ConceptNode|' || p_brand), 1, 12) ELSE 'P' || p_partkey END AS id, 'ConceptNode' AS type, p_brand AS name, p_size / 50.0 AS tv_strength, CASE WHEN p_partkey % 2 = 0 THEN 0.5 END::DOUBLE AS tv_confidence FROM part")
def s09_nodes(spark, sf_dir):
    k = F.col("p_partkey")
    tv = F.when(k % 2 == 0, F.array(F.col("p_size") / 50.0, F.lit(0.5))).otherwise(F.array(F.col("p_size") / 50.0))
    n = table(spark, sf_dir, "part").select((k % 10).alias("doc"), F.when(k % 4 != 0, F.concat(F.lit("P"), k)).alias("id"), F.lit("ConceptNode").alias("type"), F.col("p_brand").alias("name"), tv.alias("truth_value"))
    return files.export_nodes(n)


@query("s09_export_links", f"SELECT doc, CASE WHEN length(id) % 2 = 0 THEN id ELSE 'anon_' || substr(md5('EvaluationLink|' || predicate || '|' || a || '|' || b), 1, 12) END AS id, 'EvaluationLink' AS link_type, predicate AS name, a || '|' || b AS children FROM ({LINKS})")
def s09(spark, sf_dir):
    ls = links(spark, sf_dir)
    return files.export_links(ls.select("doc", F.when(F.length("id") % 2 == 0, F.col("id")).alias("id"), "link_type", F.col("predicate").alias("name"), F.col("arguments").alias("children")))
