"""Bibliographic selection and page links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_articles(df: DataFrame) -> DataFrame:
    """Articles with abstracts, languages and ids(type, value) -> flat rows; 'NA' where something is missing."""
    pick = lambda kind: F.coalesce(F.get(F.filter("ids", lambda x: x["type"] == kind), 0)["value"], F.lit("NA"))
    na = lambda c: F.coalesce(c, F.lit("NA"))
    return df.select("id", na(F.col("title")).alias("title"), na(F.get("abstracts", F.lit(0))).alias("abstract"), na(F.get("languages", F.lit(0))).alias("language"), pick("pmc").alias("pmc"), pick("doi").alias("doi"))


def with_doi(df: DataFrame, doi: str = "doi") -> DataFrame:
    """P2."""
    return df.where(F.col(doi).isNotNull() & (F.col(doi) != "NA"))


def work_metadata(df: DataFrame) -> DataFrame:
    """Counts of references and related works, joined concepts and authors, link from the DOI."""
    return df.select("id", "title", F.size(F.coalesce("referenced_works", F.array())).alias("n_references"), F.size(F.coalesce("related_works", F.array())).alias("n_related"),
                     F.array_join(F.transform("concepts", lambda x: F.format_string("%s (%.2f)", x["display_name"], x["score"])), "; ").alias("concepts"),
                     F.array_join(F.transform("authorships", lambda a: a["author"]["display_name"]), "; ").alias("authors"),
                     F.when(F.col("doi").isNotNull(), F.concat(F.lit("https://doi.org/"), F.regexp_replace("doi", "^https?://doi.org/", ""))).alias("link"))


def inverted_index(words: Column) -> Column:
    """word -> positions, ascending, of an array of words without nulls: words are sorted with their positions, and each run of one word is an entry. All inside the row."""
    with_ = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  value is made once, though f uses it for every element
    run = lambda s, a, b: F.struct(F.get(s, a)["w"].alias("w"), F.transform(F.slice(s, a + 1, b - a), lambda y: y["p"]).alias("at"))
    entries = lambda s, starts: F.transform(starts, lambda a, k: run(s, a, F.coalesce(F.get(starts, k + 1), F.size(s))))
    first = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["w"] != x["w"]), i)), lambda i: i.isNotNull())
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    return F.map_from_entries(with_(placed, lambda s: with_(first(s), lambda starts: entries(s, starts))))


def abstract_text(index: Column, ordered: bool = True) -> Column:
    """Text from word -> positions; in order of positions, or (ordered=False) each word as often as it occurs."""
    entries = F.map_entries(index)
    if ordered:
        flat = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
        return F.array_join(F.transform(F.array_sort(flat), lambda x: x["w"]), " ")
    return F.array_join(F.flatten(F.transform(entries, lambda e: F.array_repeat(e["key"], F.size(e["value"])))), " ")


def open_access(df: DataFrame) -> DataFrame:
    """P5."""
    return df.where(F.coalesce(F.col("open_access.is_oa"), F.lit(False)))


def top_cited(df: DataFrame, n: int, cited: str, key: str) -> DataFrame:
    """The n most cited, ties by key."""
    return df.orderBy(F.desc(cited), key).limit(n)


def resolve(base: Column, href: Column) -> Column:
    """A link against its page's address: absolute, protocol-relative, root-relative, or relative to the page's folder."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(base, r"^https?://[^/?#]+(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/")))
    return (F.when(F.rlike(href, F.lit("^https?://")), href).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^(https?:)", 1), href))
            .when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(folder, href)))


def anchors(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<a[^>]+href="([^"]*)"'), 1)


def first_link(html: Column, url: Column, part: str) -> Column:
    """The first anchor whose address holds `part`, resolved; null without one."""
    hit = F.get(F.filter(anchors(html), lambda h: F.contains(h, F.lit(part))), 0)
    return F.when(hit.isNotNull(), resolve(url, hit))


#: Places of a document's address in a page, in order of preference.
PLACES = (("iframe", '<iframe[^>]+src="([^"]*)"'), ("embed", '<embed[^>]+src="([^"]*)"'), ("object", '<object[^>]+data="([^"]*)"'), ("refresh", '<meta[^>]+content="[^";]*;\\s*url=([^"]*)"'))


def candidate_links(df: DataFrame, key: str, part: str) -> DataFrame:
    """(key, rank, kind, link): frames, embeds, objects and refreshes, then anchors whose address or text holds `part`; nothing is fetched."""
    def place(kind: str, rx: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(rx), 1), lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("u")))

    parts = [place(kind, rx) for kind, rx in PLACES]
    tags = F.regexp_extract_all("html", F.lit('<a[^>]+href="[^"]*"[^>]*>[^<]*'), 0)
    hit = F.filter(tags, lambda t: F.contains(F.lower(t), F.lit(part.lower())))
    parts.append(F.transform(hit, lambda t: F.struct(F.lit("anchor").alias("kind"), F.regexp_extract(t, 'href="([^"]*)"', 1).alias("u"))))
    return df.select(key, "url", F.posexplode(F.concat(*parts)).alias("rank", "c")).select(key, F.col("rank"), "c.kind", resolve(F.col("url"), F.col("c.u")).alias("link"))


def file_name(url: Column, suffix: str = ".pdf") -> Column:
    """Last part of the path, decoded, with unsafe characters as '_' and the suffix."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^https?://[^/]*", "")
    last = F.element_at(F.split(path, "/"), -1)
    name = F.regexp_replace(F.coalesce(F.try_url_decode(last), last), r"[^A-Za-z0-9._-]", "_")
    base = F.when(name == "", "download").otherwise(name)
    return F.when(F.endswith(F.lower(base), F.lit(suffix)), base).otherwise(F.concat(base, F.lit(suffix)))


def doi_of(link: Column) -> Column:
    """P10: the path of a link whose host is of the DOI resolver."""
    return F.when(F.rlike(link, F.lit(r"^https?://[^/]*doi\.org/")), F.nullif(F.regexp_extract(link, r"^https?://[^/]*doi\.org/+(.*)$", 1), F.lit("")))


def link_outcome(df: DataFrame, key: str, link: str, sample: int = 20) -> DataFrame:
    """(status, n, sample): how many links were found, how many are missing, and the least keys without one; unresolved() gives them all."""
    status = F.when(F.col(link).isNotNull(), "found").otherwise("missing")
    s = df.select(status.alias("status"), key)
    least = s.where("status = 'missing'").orderBy(key).limit(sample).groupBy("status").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("sample"))
    return s.groupBy("status").agg(F.count("*").alias("n")).join(F.broadcast(least), "status", "left")


def unresolved(df: DataFrame, key: str, link: str) -> DataFrame:
    """Every key that has a row but no row with a link, once: what a next attempt takes."""
    return df.groupBy(key).agg(F.count(link).alias("_n")).where("_n = 0").select(key)
