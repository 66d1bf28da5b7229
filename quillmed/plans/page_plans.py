"""Queries P1-P11 over pages, documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmed.operators import biblio as P

from .base import query, table


@query("p01_flatten_articles", """
SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'NA' ELSE source END AS title, CASE WHEN doc_id % 4 = 0 THEN 'NA' ELSE text END AS abstract, lang AS language, CASE WHEN doc_id % 2 = 0 THEN 'PMC' || doc_id ELSE 'NA' END AS pmc, CASE WHEN doc_id % 5 = 0 THEN 'NA' ELSE '10.1/' || doc_id END AS doi FROM documents""")
def p01(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    one = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    ids = F.filter(F.array(F.when(k % 2 == 0, one("pmc", F.concat(F.lit("PMC"), k))), F.when(k % 5 != 0, one("doi", F.concat(F.lit("10.1/"), k)))), lambda x: x.isNotNull())
    a = d.select(k.alias("id"), F.when(k % 3 != 0, F.col("source")).alias("title"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("text"), F.lit("second"))).alias("abstracts"), F.array("lang").alias("languages"), ids.alias("ids"))
    return P.flatten_articles(a)


@query("p02_with_doi", "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def p02(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "NA").when(F.col("doc_id") % 7 != 0, "10.1/x").alias("doi"))
    return P.with_doi(d).select("doc_id")


@query("p03_work_metadata", """
SELECT doc_id AS id, source AS title, (doc_id % 4)::INTEGER AS n_references, 0 AS n_related, lang || ' (0.50); ' || source || ' (0.25)' AS concepts, source || '; ' || lang AS authors, CASE WHEN doc_id % 2 = 0 THEN 'https://doi.org/10.1/' || doc_id END AS link FROM documents""")
def p03(spark, sf_dir):
    k = F.col("doc_id")
    concept = lambda n, s: F.struct(n.alias("display_name"), F.lit(s).alias("score"))
    author = lambda n: F.struct(F.struct(n.alias("display_name")).alias("author"))
    d = table(spark, sf_dir, "documents").select(k.alias("id"), F.col("source").alias("title"), F.array_repeat(F.lit("W"), (k % 4).cast("int")).alias("referenced_works"), F.lit(None).cast("array<string>").alias("related_works"),
                                                 F.array(concept(F.col("lang"), 0.5), concept(F.col("source"), 0.25)).alias("concepts"), F.array(author(F.col("source")), author(F.col("lang"))).alias("authorships"),
                                                 F.when(k % 2 == 0, F.concat(F.lit("https://doi.org/10.1/"), k)).alias("doi"))
    return P.work_metadata(d)


@query("p04_abstract_text", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\S+'), ' ') AS ordered, len(regexp_extract_all(text, '\S+'))::INTEGER AS n_repeated FROM documents WHERE len(regexp_extract_all(text, '\S+')) > 0")
def p04(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\n\f\r]+"), 0)
    index = table(spark, sf_dir, "documents").select("doc_id", words.alias("words")).where(F.size("words") > 0).select("doc_id", P.inverted_index(F.col("words")).alias("index"))
    return index.select("doc_id", P.abstract_text(F.col("index")).alias("ordered"), F.size(F.split(P.abstract_text(F.col("index"), False), " ")).alias("n_repeated"))


@query("p05_open_access", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def p05(spark, sf_dir):
    k = F.col("doc_id")
    return P.open_access(table(spark, sf_dir, "documents").select("doc_id", F.struct(F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("is_oa")).alias("open_access"))).select("doc_id")


@query("p06_top_cited", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def p06(spark, sf_dir):
    return P.top_cited(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, "o_totalprice", "o_orderkey")


RESOLVE = """CASE WHEN regexp_matches({h}, '^https?://') THEN {h} WHEN starts_with({h}, '//') THEN regexp_extract(url, '^(https?:)', 1) || {h} WHEN starts_with({h}, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || {h}
 ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/(?:[^?#]*/)?)', 1), ''), '/') || {h} END"""
HIT = """list_filter(regexp_extract_all(html, '<a[^>]+href="([^"]*)"', 1), lambda h: contains(h, 'an'))[1]"""


@query("p07_first_link", f"SELECT page_id, CASE WHEN h IS NOT NULL THEN {RESOLVE.format(h='h')} END AS link FROM (SELECT page_id, url, {HIT} AS h FROM pages)")
def p07(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.first_link(F.col("html"), F.col("url"), "an").alias("link"))


@query("p08_candidate_links", f"""
SELECT page_id, (i - 1)::INTEGER AS rank, 'anchor' AS kind, {RESOLVE.format(h='h')} AS link FROM (SELECT page_id, url, i, regexp_extract(t[i], 'href="([^"]*)"', 1) AS h FROM (SELECT page_id, url, list_filter(regexp_extract_all(html, '<a[^>]+href="[^"]*"[^>]*>[^<]*'), lambda x: contains(lower(x), 'the')) AS t FROM pages), unnest(range(1, len(t) + 1)) r(i))""")
def p08(spark, sf_dir):
    return P.candidate_links(table(spark, sf_dir, "pages"), "page_id", "the")


@query("p09_file_name", r"""
SELECT page_id, CASE WHEN n = '' THEN 'download' ELSE n END || '.pdf' AS name FROM (SELECT page_id, regexp_replace(list_last(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', ''), '/')), '[^A-Za-z0-9._-]', '_', 'g') AS n FROM pages)""")
def p09(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.file_name(F.col("url")).alias("name"))


@query("p10_doi_of", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '10.1000/' || page_id END AS doi FROM pages")
def p10(spark, sf_dir):
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://dx.doi.org/10.1000/"), F.col("page_id"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", P.doi_of(link).alias("doi"))


def _links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.first_link(F.col("html"), F.col("url"), "an").alias("link"))


@query("p11_link_outcome", f"""
WITH s AS (SELECT page_id, CASE WHEN {HIT} IS NULL THEN 'missing' ELSE 'found' END AS status FROM pages) SELECT status, count(*) AS n, CASE WHEN status = 'missing' THEN (SELECT string_agg(page_id, ',' ORDER BY page_id) FROM (SELECT page_id FROM s WHERE status = 'missing' ORDER BY page_id LIMIT 20)) END AS sample FROM s GROUP BY status""")
def p11(spark, sf_dir):
    return P.link_outcome(_links(spark, sf_dir), "page_id", "link")


@query("p11_unresolved", f"SELECT page_id FROM pages GROUP BY page_id HAVING count({HIT}) = 0")
def p11_unresolved(spark, sf_dir):
    return P.unresolved(_links(spark, sf_dir), "page_id", "link")
