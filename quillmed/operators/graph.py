"""Knowledge-graph ingest, merge, flattening and profiling (K1-K42). Everything is keyed by document, so work partitions by it; ids count within a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmed.functions.scalars import label_stem

from .reach import dependency_levels, reach  # noqa: F401  K32 is one of them
from .scan import LONG, bound, carried, over_ranges, quantiles
from .store import spread, written
from .translation import rank_tails, translation_score, true_ranks  # noqa: F401  K35, K36


# ---- ingest
def extract_json(text: Column) -> Column:
    """K1: the fenced block, else the text from the first to the last brace; trailing commas go; null without any."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.regexp_replace(F.coalesce(fenced, bare), r",\s*([}\]])", "$1")


def parse_responses(df: DataFrame, text: str) -> DataFrame:
    """K1 as a job: adds json and reason (null for accepted rows)."""
    out = df.withColumn("json", extract_json(F.col(text)))
    reason = F.when(F.col("json").isNull(), "no object").when(F.try_parse_json("json").isNull(), "invalid")
    return out.withColumn("reason", reason)


def clean_roles(roles: DataFrame) -> DataFrame:
    """K2: literal and datatype from their aliases, as far as roles has them; a role with neither entity nor literal gets a placeholder."""
    first = lambda names: F.coalesce(*(c for c in names if c in roles.columns))
    literals, kinds = ("literal", "value", "val", "amount"), ("datatype", "data_type", "type")
    literal = first(literals)
    blank = F.col("entity").isNull() & (F.coalesce(literal, F.lit("")) == "")
    return roles.withColumn("literal", F.when(blank, "unknown").otherwise(literal)).withColumn("datatype", first(kinds)).drop(*literals[1:], *kinds[1:])


def clean_facts(facts: DataFrame, roles: DataFrame, args: DataFrame, fragments: DataFrame | None = None) -> DataFrame:
    """K2: facts that have a role or an argument. A fact without a sentence gets that of its fragment: fragments(doc, fragment, sentence_id)."""
    known = roles.select("doc", "fact_id").unionByName(args.select("doc", "fact_id"))
    kept = facts.join(known.hint("shuffle_merge"), ["doc", "fact_id"], "left_semi")
    if fragments is None:
        return kept
    own = fragments.select("doc", "fragment", F.col("sentence_id").alias("_sent"))
    return kept.join(own.hint("shuffle_merge"), ["doc", "fragment"], "left").withColumn("sent", F.coalesce("sent", "_sent")).drop("_sent")


def default_truth(truth: Column, predicate: Column, defaults: dict[str, float], other: float = 0.5) -> Column:
    """K3."""
    table = F.create_map(*(x for k, v in defaults.items() for x in (F.lit(k), F.array(F.lit(v)))))
    return F.coalesce(truth, F.try_element_at(table, predicate), F.array(F.lit(other)))


def role_violations(roles: DataFrame) -> DataFrame:
    """K4: rows of broken rules: a role needs an entity or a literal; a datatype needs a literal."""
    blank = F.trim(F.coalesce("literal", F.lit(""))) == ""
    v = F.array_compact(F.array(F.when(F.col("entity").isNull() & blank, "empty role"), F.when(F.col("datatype").isNotNull() & blank, "datatype without literal")))
    return roles.select("doc", "fact_id", "role", F.explode(v).alias("violation"))


#: The fields that a fact may have.
FACT_FIELDS = ("id", "predicate", "timestamp", "truth_value", "sentence_id", "tuple", "arguments")


def unknown_fields(raw: DataFrame, json: str, allowed: tuple[str, ...] = FACT_FIELDS) -> DataFrame:
    """K4: rows of fields of a JSON object that the model doesn't know: the columns of raw but json, and field."""
    extra = F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))
    return raw.select(*(c for c in raw.columns if c != json), F.explode(extra).alias("field"))


def fact_violations(facts: DataFrame, roles: DataFrame, args: DataFrame) -> DataFrame:
    """K4: a fact has roles or arguments, not both and not neither."""
    has = lambda d, n: d.select("doc", "fact_id").distinct().withColumn(n, F.lit(True))
    m = facts.select("doc", "fact_id").join(has(roles, "r").hint("shuffle_merge"), ["doc", "fact_id"], "left").join(has(args, "a").hint("shuffle_merge"), ["doc", "fact_id"], "left")
    v = F.when(F.col("r").isNotNull() & F.col("a").isNotNull(), "roles and arguments").when(F.col("r").isNull() & F.col("a").isNull(), "neither")
    return m.withColumn("violation", v).where("violation is not null").select("doc", "fact_id", "violation")


def default_date(text: Column) -> Column:
    """K5: 1 January of the first year 19xx or 20xx in the text, else of 1900."""
    year = F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).try_cast("int")
    return F.make_date(F.coalesce(year, F.lit(1900)), F.lit(1), F.lit(1))


# ---- merge
def merge_names(df: DataFrame, name: Column, kind: str, order: list[str], prefix: str) -> DataFrame:
    """One row per (doc, name): the first occurrence's kind, and an id prefix1.. in order of first occurrence."""
    named = df.withColumn("name", name)
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("doc", "name").orderBy(*order))).where("_n = 1")
    new = F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy("doc").orderBy(*order)).cast("string"))
    return first.withColumn("new_id", new).select("doc", "name", F.col(kind).alias("type"), "new_id")


def rekey_facts(facts: DataFrame, order: list[str]) -> DataFrame:
    """K7: new id F{n}_{sentence}_{doc}, n within the document."""
    n = F.row_number().over(Window.partitionBy("doc").orderBy(*order))
    return facts.withColumn("new_id", F.format_string("F%d_%s_%s", n, F.col("sent").cast("string"), F.col("doc").cast("string")))


def rewrite_roles(roles: DataFrame, local: DataFrame, merged: DataFrame) -> DataFrame:
    """K7: role entity by (doc, sentence, local id) -> name -> merged id; unknown ids stay."""
    ids = local.select("doc", "sent", "id", "name").join(merged.select("doc", "name", "new_id"), ["doc", "name"]).select("doc", "sent", F.col("id").alias("entity"), F.col("new_id").alias("_to"))
    return roles.join(ids.hint("shuffle_merge"), ["doc", "sent", "entity"], "left").withColumn("entity", F.coalesce("_to", "entity")).drop("_to")


def rewrite_args(args: DataFrame, ids: DataFrame, tasks: int | None = None) -> DataFrame:
    """Arguments (doc, sent, fact_id, pos, arg) through ids (doc, sent, id, new_id); unknown ones stay. tasks: of its shuffles, if Spark's number is too small."""
    args, m = (spread(d, tasks, "doc", "sent", "arg") for d in (args, ids.select("doc", "sent", F.col("id").alias("arg"), "new_id")))
    return args.join(m.hint("shuffle_merge"), ["doc", "sent", "arg"], "left").withColumn("arg", F.coalesce("new_id", "arg")).drop("new_id")


def string_arguments(json: Column) -> Column:
    """The strings of a JSON array; numbers, objects and other things that are no strings are dropped. Null for other text."""
    parsed = F.when(F.startswith(F.ltrim(json), F.lit("[")), F.try_parse_json(json))
    items = F.filter(parsed.cast("array<variant>"), lambda x: x.isNotNull() & (F.schema_of_variant(x) == "STRING"))
    return F.transform(items, lambda x: x.cast("string"))


def document_metadata(fragments: DataFrame) -> DataFrame:
    """K9: sentences in numeric order, number of fragments, source ids and years in order, per document."""
    num = F.regexp_extract("sentence_id", r"_(\d+)", 1).try_cast("int")
    s = fragments.withColumn("n", num)
    ids = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("n", "sentence_id"))), lambda x: x["sentence_id"]), ",")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return s.groupBy("doc").agg(ids.alias("sentences"), F.count("*").alias("fragments"), listed("source_id").alias("sources"), listed("year").alias("years"))


def merge_links(links: DataFrame, order: list[str], tasks: int | None = None) -> DataFrame:
    """Links (doc, sent, id and the fields of a link: type, predicate, arguments, truth value,
    attributes ..) after node rewriting: rows equal in every field but the id get one canonical id
    L1..; returns doc, id, canonical and first (True for the row that stays). Attributes are a map or an array of its entries, in any order.
    All windows are of a document, so one exchange serves them. tasks: of it, if Spark's number is too small."""
    kinds = dict(links.dtypes)
    entries = lambda c: F.array_sort(F.map_entries(c) if kinds[c].startswith("map") else c)
    fields = [entries(c).alias(c) if c == "attributes" else F.col(c) for c in sorted(links.columns) if c not in ("doc", "sent", "id")]
    key = F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    same = Window.partitionBy("doc", "_key")
    m = spread(links.withColumn("_key", key), tasks, "doc").withColumn("_n", F.row_number().over(same.orderBy(*order))).withColumn("_first", F.min(F.struct(*order)).over(same))
    number = F.dense_rank().over(Window.partitionBy("doc").orderBy("_first", "_key"))
    return m.withColumn("canonical", F.concat(F.lit("L"), number.cast("string"))).withColumn("first", F.col("_n") == 1).drop("_key", "_n", "_first")


# ---- recursion
def closure(edges: DataFrame, depth: int | None = None, paths: bool = False) -> DataFrame:
    """edges(parent, child) -> (root, node, depth): everything that a root reaches, once, at its least depth; with paths also the least
    of the shortest paths. As in nested copies of a reference that is shown where it is first met, a graph of many paths stays small."""
    return reach(edges, depth, paths)


# ---- flattening
def lookup(nodes: DataFrame, facts: DataFrame, roles: DataFrame) -> DataFrame:
    """Id -> label of nodes (blank name: the id), facts and distinct literals."""
    n = nodes.select("id", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("id")).alias("label"), F.lit("node").alias("kind"))
    f = facts.select(F.col("fact_id").alias("id"), F.col("predicate").alias("label"), F.lit("fact").alias("kind"))
    lit = roles.where("literal is not null").select(literal_label().alias("id")).distinct().select("id", F.col("id").alias("label"), F.lit("literal").alias("kind"))
    return n.unionByName(f).unionByName(lit).distinct()


def literal_label() -> Column:
    return F.when(F.col("datatype").isNotNull(), F.concat_ws("/", "literal", "datatype")).otherwise(F.col("literal"))


#: Names of roles and predicates that pairs are counted under as numbers; pairs of other names carry them spelled out.
CODED = 200


def role_pairs(roles: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Per fact every ordered pair of different roles as a triple (s, '[r1]:pred:[r2]', o), with counts. The pairing is within a fact's few roles.
    names: roles and predicates (one column) that are worth a number; else those of the table."""
    r = roles.select("doc", "fact_id", "predicate", "role", F.coalesce("entity", literal_label()).alias("label"))
    known = _coded(r.select("role").unionAll(r.select("predicate")) if names is None else names)
    return _pair_up(r.where("role is not null").groupBy("doc", "fact_id", "predicate").agg(F.collect_list(F.struct("role", "label")).alias("r")), known)


def _coded(names: DataFrame, depth: int = 0) -> list[str]:
    """Up to CODED names without brackets; with depth also as they read below so many nested facts."""
    few = names.toDF("name").where(~F.rlike("name", F.lit(r"[\[\]]"))).distinct().limit(CODED).collect()  # bounded
    own = [*sorted(r["name"] for r in few), "fact_arg"]
    return list(dict.fromkeys("fact_arg->" * k + n for k in range(depth + 1) for n in own))[:CODED]


def _pair_up(facts: DataFrame, names: list[str]) -> DataFrame:
    """Pairs of facts(predicate, r: array of role, label) are shuffled once, and a pair and its reverse as one row, which both are read off after counting; the row has
    a number for predicate and roles, where all three are among names. Other pairs go both ways and by the name they make: names with brackets
    could read alike when put together, but never like those among names, which have no more brackets than are put in."""
    known, base = F.array(*map(F.lit, names)).cast("array<string>"), len(names) + 1
    code = lambda c: F.coalesce(F.array_position(known, c), F.lit(0)).cast("int")
    coded = facts.select("predicate", code(F.col("predicate")).alias("k"), F.transform("r", lambda x: F.struct(code(x["role"]).alias("k"), x["role"].alias("role"), x["label"].alias("label"))).alias("r"))
    both = coded.select("predicate", "k", "r", F.explode_outer("r").alias("x")).select("predicate", "k", "x", F.explode_outer("r").alias("y"))  # a plain explode would make the roles twice
    plain = (F.col("k") > 0) & (F.col("x.k") > 0) & (F.col("y.k") > 0)
    spelled = F.format_string("[%s]:%s:[%s]", "x.role", "predicate", "y.role")
    a = both.where(F.when(plain, F.col("x.k") < F.col("y.k")).otherwise(F.col("x.role") != F.col("y.role"))).select(
        F.col("x.label").alias("s"), F.col("y.label").alias("o"), F.when(plain, (F.col("k") * base + F.col("x.k")) * base + F.col("y.k")).alias("c"), F.when(~plain, spelled).alias("p"))
    n = a.groupBy("s", "o", "c", "p").agg(F.count("*").alias("n"))
    at = lambda number: F.get(known, F.expr(number) - 1)
    x, p, y = at(f"c div {base} % {base}"), at(f"c div {base * base}"), at(f"c % {base}")
    triple = lambda s, p, o: F.struct(F.col(s).alias("s"), p.alias("p"), F.col(o).alias("o"), F.col("n"))
    name = lambda one, two: F.concat(F.lit("["), one, F.lit("]:"), p, F.lit(":["), two, F.lit("]"))
    ways = F.when(F.col("c").isNull(), F.array(triple("s", F.col("p"), "o"))).otherwise(F.array(triple("s", name(x, y), "o"), triple("o", name(y, x), "s")))
    return n.select(F.explode_outer(ways).alias("t")).select("t.*")


def _with_roles(roles: DataFrame, facts: DataFrame, args: DataFrame, tasks: int | None = None) -> tuple[DataFrame, int]:
    """(doc, fact_id, predicate, r: array of role, label) with all of nested_roles, and how deep facts are nested. Only what facts ask of the facts they hold is shuffled: each fact
    hands on its roles or its predicate to those that asked, inside its document. So roles and facts that are dealt by document over `tasks` tasks (None: Spark's number) stay where they are."""
    args = written(args.select("doc", "fact_id", "arg", "nested"), "fact-args", as_dealt=True)
    down = written(args.where("nested").select("doc", F.col("fact_id").alias("node"), F.col("arg").alias("child")).distinct(), "fact-nested")
    level = down.select("doc", F.col("node").alias("root"), F.col("child").alias("node"), F.lit("fact_arg->").alias("prefix"), F.array("node", "child").alias("path"))
    levels = []
    while not level.isEmpty():
        levels.append(level.select("doc", "root", "node", "prefix"))
        nxt = level.join(down.hint("shuffle_merge"), ["doc", "node"]).where(~F.array_contains("path", F.col("child")))
        level = written(nxt.select("doc", "root", F.col("child").alias("node"), F.concat("prefix", F.lit("fact_arg->")).alias("prefix"), F.array_append("path", F.col("child")).alias("path")), "fact-level")
    ask = lambda root, name, whole: F.struct(F.col(root).alias("root"), name.alias("name"), F.lit(whole).alias("whole")).alias("ask")
    asks = [args.select("doc", F.col("arg").alias("fact_id"), ask("fact_id", F.lit("fact_arg"), False))]
    if levels:
        paths = reduce(DataFrame.unionByName, levels)
        held = args.select("doc", F.col("fact_id").alias("node"), "arg")
        asks += [paths.select("doc", F.col("node").alias("fact_id"), ask("root", F.col("prefix"), True)),
                 paths.join(held.hint("shuffle_merge"), ["doc", "node"]).select("doc", F.col("arg").alias("fact_id"), ask("root", F.concat("prefix", F.lit("fact_arg")), False))]
    asks = reduce(DataFrame.unionByName, asks).repartition(tasks or int(args.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc")
    role = F.struct("role", F.coalesce("entity", literal_label()).alias("label")).alias("r")
    parts = [roles.select("doc", "fact_id", role).where("r.label is not null"), facts.select("doc", "fact_id", F.struct("predicate").alias("p")), asks]
    own = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("doc", "fact_id").agg(F.collect_list("r").alias("r"), F.collect_set("p").alias("p"), F.collect_list("ask").alias("asks"))
    below = lambda a: F.transform("r", lambda x: F.struct(F.concat(a["name"], x["role"]).alias("role"), x["label"].alias("label")))
    argument = lambda a: F.transform(F.filter("p", lambda x: x["predicate"].isNotNull()), lambda x: F.struct(a["name"].alias("role"), x["predicate"].alias("label")))
    none = F.slice("p", 1, 0)
    given = F.transform("asks", lambda a: F.struct(a["root"].alias("fact_id"), F.when(a["whole"], below(a)).otherwise(argument(a)).alias("r"), none.alias("p")))
    handed = own.where("doc is not null and fact_id is not null").select("doc", F.explode_outer(F.concat(F.array(F.struct("fact_id", "r", "p")), given)).alias("g")).select("doc", "g.*")
    out = handed.groupBy("doc", "fact_id").agg(F.flatten(F.collect_list("r")).alias("r"), F.flatten(F.collect_list("p")).alias("p"))
    return out.select("doc", "fact_id", "r", F.explode("p").alias("p")).select("doc", "fact_id", F.col("p.predicate").alias("predicate"), "r"), len(levels)


def nested_roles(roles: DataFrame, facts: DataFrame, args: DataFrame, tasks: int | None = None) -> DataFrame:
    """Roles (doc, fact_id, predicate, role, label) of facts(doc, fact_id, predicate): their own ones; `fact_arg`
    for each argument that is a known fact; and of an argument that holds the fact itself (nested), its
    roles under the prefix `fact_arg->`, to any depth along a path (a written frontier, cycles cut). args(doc, fact_id, arg, nested)."""
    held, _ = _with_roles(roles, facts, args, tasks)
    return held.select("doc", "fact_id", "predicate", F.explode_outer("r").alias("x")).where("x is not null").select("doc", "fact_id", "predicate", "x.*")


def nested_role_pairs(roles: DataFrame, facts: DataFrame, args: DataFrame, tasks: int | None = None, names: DataFrame | None = None) -> DataFrame:
    """K15 over nested facts: pairs of nested_roles, with counts. tasks: over which roles and facts are dealt by document, if not Spark's number; names: as in role_pairs."""
    held, depth = _with_roles(roles, facts, args, tasks)
    return _pair_up(held, _coded(roles.select("role").unionAll(facts.select("predicate")) if names is None else names, depth))


def _same(key: str):
    """All rows of a document that share a key. Rows dealt by document stay where they are; a join by document and key would deal them again."""
    return Window.partitionBy("doc").orderBy(key).rangeBetween(Window.currentRow, Window.currentRow)


def _known(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose document and key are among keys(doc, key); neither may be null."""
    every = rows.withColumn("_is", F.lit(False)).unionByName(keys.select("doc", key, F.lit(True).alias("_is")), allowMissingColumns=True)
    there = F.max(F.col("_is") & F.col("doc").isNotNull() & F.col(key).isNotNull()).over(_same(key))
    return every.withColumn("_there", there).where("_there and not _is").drop("_is", "_there")


def argument_pairs(links: DataFrame, labels: DataFrame, tasks: int | None = None) -> DataFrame:
    """Links (doc, id, predicate, suffix, arguments) -> ordered pairs of different labelled arguments under predicate and suffix. Labels are found inside the document; only pairs are shuffled, a pair and its
    reverse as one row. tasks: of that shuffle, if Spark's number is too small."""
    e = links.select("doc", "id", F.concat("predicate", F.coalesce("suffix", F.lit(""))).alias("p"), F.explode("arguments").alias("node"), F.lit(False).alias("named"))
    every = e.unionByName(labels.select("doc", F.col("id").alias("node"), F.lit(True).alias("named"), F.struct("label").alias("l")), allowMissingColumns=True)
    own = every.withColumn("l", F.collect_list("l").over(_same("node"))).withColumn("named", F.col("named") | F.col("doc").isNull() | F.col("node").isNull()).where("not named")
    both = own.select("doc", "id", "p", "node", F.explode_outer("l").alias("l")).where("l is not null").groupBy("doc", "id", "p").agg(F.collect_list(F.struct("node", F.col("l.label").alias("label"))).alias("r"))
    a = both.select("p", "r", F.explode("r").alias("x")).select("p", "x", F.explode("r").alias("y")).where("x.node < y.node").select("p", F.array_sort(F.array("x.label", "y.label")).alias("l"))
    n = spread(a.select(F.col("l")[0].alias("s"), "p", F.col("l")[1].alias("o")), tasks, "s", "p", "o").groupBy("s", "p", "o").agg(F.count("*").alias("n"))
    way = lambda s, o, n: F.struct(F.col(s).alias("s"), F.col("p"), F.col(o).alias("o"), n.alias("n"))
    ways = F.when(F.col("s").eqNullSafe(F.col("o")), F.array(way("s", "o", F.col("n") * 2))).otherwise(F.array(way("s", "o", F.col("n")), way("o", "s", F.col("n"))))
    return n.select(F.explode_outer(ways).alias("t")).select("t.*")


def provenance(facts: DataFrame) -> DataFrame:
    """has_timestamp, has_sentence and has_truth_value triples of each fact, with counts."""
    cells = F.array(*(F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for p, c in (("has_timestamp", "day"), ("has_sentence", "sent"), ("has_truth_value", "truth"))))
    t = facts.select(F.col("predicate").alias("s"), F.explode(cells).alias("t")).where("t.o is not null")
    return t.groupBy("s", "t.p", "t.o").agg(F.count("*").alias("n"))


def context_triples(members: DataFrame, evaluations: DataFrame, labels: DataFrame) -> DataFrame:
    """(s, 'has_context', o) with counts: the predicate of a context link's evaluation (K18), and the labels of its
    first two members that have one. evaluations(doc, id, predicate), labels(doc, id, label)."""
    of = contexts(members).where("evaluation is not null").select("doc", "link", F.col("evaluation").alias("node"))
    named = evaluations.select(F.concat_ws("/", "doc", "id").alias("node"), "predicate")
    around = members.where("pos < 2").join(labels.select("doc", F.col("id").alias("member"), "label").hint("shuffle_merge"), ["doc", "member"]).select("doc", "link", "label")
    t = of.join(named.hint("shuffle_merge"), "node").join(around.hint("shuffle_merge"), ["doc", "link"])
    return t.groupBy(F.col("predicate").alias("s"), F.lit("has_context").alias("p"), F.col("label").alias("o")).agg(F.count("*").alias("n"))


def contexts(members: DataFrame, depth: int | None = None) -> DataFrame:
    """members(doc, link, pos, member, member_type, name) of context links -> per context link its
    timestamp, its sentence (by type or by form of the name) and the first evaluation among the other members or beneath them."""
    stamp = (F.col("member_type") == "TimestampNode") | F.rlike(F.coalesce("name", F.lit("")), F.lit(r"^\d{4}-\d{2}-\d{2}"))
    sent = (F.col("member_type") == "SentenceNode") | F.startswith(F.coalesce("name", F.lit("")), F.lit("SENT_"))
    top = members.groupBy("doc", "link").agg(F.min_by("name", F.when(stamp & (F.col("pos") < 2), F.col("pos"))).alias("timestamp"), F.min_by("name", F.when(sent & (F.col("pos") < 2), F.col("pos"))).alias("sentence"))
    edge = members.select(F.concat_ws("/", "doc", "link").alias("parent"), F.concat_ws("/", "doc", "member").alias("child"), "pos", "member_type")
    reach = closure(edge.select("parent", "child").distinct(), depth).join(edge.where("member_type = 'EvaluationLink'").groupBy(F.col("child").alias("node")).agg(F.min("pos").alias("pos")).hint("shuffle_merge"), "node")
    first = reach.groupBy("root").agg(F.min_by("node", F.struct("depth", "pos", "node")).alias("evaluation"))
    return top.withColumn("root", F.concat_ws("/", "doc", "link")).join(first.hint("shuffle_merge"), "root", "left").drop("root")


def truth_scalar(truth: Column, pick: str = "second") -> Column:
    """K19: 'second' takes the second element if there is one, else the first; 'first' the first."""
    one = F.get(truth, 0)
    return F.coalesce(F.get(truth, 1), one) if pick == "second" else one


# ---- graphs
def hub_edges(docs: DataFrame, facts: DataFrame, roles: DataFrame, args: DataFrame) -> DataFrame:
    """Doc -> sentence -> fact -> entity (role) and fact -> fact edges (doc, src, dst, label), only to vertices that exist. Tables dealt by document stay so."""
    f = facts.select("doc", "sent", "fact_id")
    edge = lambda d, s, t, label: d.select("doc", s.alias("src"), t.alias("dst"), label.alias("label"))
    v = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    role = edge(roles.where("entity is not null"), v("F", "fact_id"), v("E", "entity"), F.col("role")).withColumn("_v", F.col("src"))
    arg = edge(args, v("F", "fact_id"), v("F", "arg"), F.lit("argument")).withColumn("_v", F.col("dst"))
    met = _known(role.unionByName(arg), f.select("doc", v("F", "fact_id").alias("_v")), "_v").drop("_v")
    return reduce(DataFrame.unionByName, [edge(f.select("doc", "sent").distinct(), v("D", "doc"), v("S", "sent"), F.lit("has_sentence")), edge(f, v("S", "sent"), v("F", "fact_id"), F.lit("has_fact")), met])


#: Sentences of a document, and names of a document, that one automaton meets at most, by expectation.
SENTENCES, NAMES = 2000, 20_000


def mentions(sents: DataFrame, names: DataFrame, sentences: int = SENTENCES, most: int = NAMES) -> DataFrame:
    """(doc_id, sent_id, name) where an entity's name of the same document occurs in a sentence (case-sensitive substring), once each. Null
    sentences and names don't count; an empty name is in every sentence.

    A document's names make one automaton, which reads each sentence once: the cost is the length of texts and names plus the hits, not their product.
    Sentences and names of a long document are dealt into blocks, and each pair of blocks is a row of its own."""
    known = names.where("name is not null").select("doc_id", "name").distinct()
    n = known.groupBy("doc_id").agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    dealt = known.join(n.hint("shuffle_merge"), "doc_id").withColumn("_part", F.pmod(F.xxhash64("name"), F.col("_parts")).cast("int"))
    lists = dealt.groupBy("doc_id", "_part").agg(F.collect_list("name").alias("names"))
    asked = sents.where("sentence is not null").join(n.hint("shuffle_merge"), "doc_id").withColumn("_block", F.floor(F.col("sent_id") / sentences))
    blocks = asked.groupBy("doc_id", "_block", "_parts").agg(F.collect_list(F.struct("sent_id", "sentence")).alias("sents"))
    copied = blocks.select("doc_id", "sents", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))

    def find(batches):
        import ahocorasick
        import pyarrow as pa

        for b in batches:
            docs, at, found = [], [], []
            for doc, own, listed in zip(b.column("doc_id").to_pylist(), b.column("sents").to_pylist(), b.column("names").to_pylist()):
                a = ahocorasick.Automaton()
                for name in listed:
                    if name:
                        a.add_word(name, name)
                a.make_automaton()
                for s in own:
                    hits = {name for _, name in a.iter(s["sentence"])} if len(a) else set()
                    hits |= {""} & set(listed)
                    docs += [doc] * len(hits)
                    at += [s["sent_id"]] * len(hits)
                    found += sorted(hits)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, b.schema.field("doc_id").type), "sent_id": pa.array(at, b.schema.field("sents").type.value_type.field("sent_id").type), "name": pa.array(found, pa.string())})

    met = copied.join(lists.hint("shuffle_merge"), ["doc_id", "_part"]).select("doc_id", "sents", "names")
    kinds = dict(sents.dtypes)
    return met.mapInArrow(find, f"doc_id {kinds['doc_id']}, sent_id {kinds['sent_id']}, name string").distinct()


def clean_sentence_nodes(nodes: DataFrame) -> DataFrame:
    """A node whose name holds 'SENT_' is a sentence node, named from there on."""
    at = F.instr("name", "SENT_")
    return nodes.withColumn("type", F.when(at > 0, "SentenceNode").otherwise(F.col("type"))).withColumn("name", F.when(at > 0, F.substring(F.col("name"), at, F.length("name"))).otherwise(F.col("name")))


def link_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Link -> argument and link -> predicate edges (doc, src, dst, label) to vertices that exist, without the document's first timestamp node. Links and nodes dealt by document stay where they are."""
    end = lambda c, label: F.struct(c.alias("dst"), F.lit(label).alias("label"))
    ends = F.concat(F.transform("arguments", lambda x: end(x, "argument")), F.array(end(F.col("predicate"), "predicate"), end(F.col("id"), None)))
    e = links.select("doc", F.col("id").alias("src"), F.explode_outer(ends).alias("e")).select("doc", "src", "e.dst", "e.label")  # a vertex has no label
    every = e.unionByName(nodes.select("doc", F.col("id").alias("dst"), "type"), allowMissingColumns=True)
    there = F.max(F.col("label").isNull() & F.col("doc").isNotNull() & F.col("dst").isNotNull()).over(_same("dst"))
    first = F.min(F.when(F.col("type") == "TimestampNode", F.col("dst"))).over(Window.partitionBy("doc").orderBy("dst").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = every.withColumns({"_there": there, "_first": first})
    return met.where(F.col("_there") & F.col("label").isNotNull() & ~F.col("dst").eqNullSafe(F.col("_first"))).select("doc", "dst", "src", "label")


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    touched = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    return vertices.join(touched, "id", "left_anti")


def connected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that have an edge."""
    touched = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    return vertices.join(touched, "id", "left_semi")


def summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): vertices per class, edges, isolated vertices."""
    per = vertices.groupBy(F.concat(F.lit("class:"), "class").alias("what")).agg(F.count("*").alias("n"))
    return per.unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n")).unionByName(isolated(vertices, edges).agg(F.count("*").alias("n")).select(F.lit("isolated").alias("what"), "n"))


# ---- profile
def schema_profile(roles: DataFrame, entities: DataFrame) -> DataFrame:
    """(type, predicate, role): participation, greatest multiplicity of the role in a fact, and whether it holds literals.

    Rows are counted by fact, role and entity, then by entity, before entities' types are looked up; so what meets the types is a row for each entity, predicate and role."""
    multi = F.count("*").over(Window.partitionBy("doc", "fact_id", "role"))
    each = roles.select("doc", "fact_id", "role", "predicate", "entity", F.col("literal").isNotNull().alias("lit")).withColumn("multi", multi)
    per = each.groupBy("doc", "entity", "predicate", "role").agg(F.count("*").alias("c"), F.max("multi").alias("multi"), F.bool_or("lit").alias("lit"))
    m = per.join(entities.select("doc", F.col("id").alias("entity"), F.col("type")).hint("shuffle_merge"), ["doc", "entity"], "left")
    return m.groupBy(F.when(F.col("entity").isNotNull(), F.coalesce("type", F.lit("?"))).otherwise("literal").alias("type"), "predicate", "role").agg(
        F.sum("c").alias("participation"), F.max("multi").alias("max_multiplicity"), F.bool_or("lit").alias("literal_role"))


def unique_labels(df: DataFrame, label: str, order: list[str], reserved: list[str], long: int | None = LONG) -> DataFrame:
    """Normalised labels made unique, in the given order: a row takes its stem, or the stem with the least number,
    that no earlier row and no reserved word has.

    Rows of one stem start with numbers by their rank. While a label has several rows the first one keeps it, the others
    and the later rows of their stems move on; this ends at what taking the rows one by one gives. The order must be unique. A stem of very many
    rows is numbered by ranges of the order, from the number of rows before each."""
    base = df.withColumn("_stem", label_stem(F.col(label))).withColumn("_at", F.struct(*order))
    long, key = bound(base, ["_stem"], long), ["_stem"]

    def place(d: DataFrame, k: list[str], before: Column) -> DataFrame:
        return d.withColumn("_n", F.row_number().over(Window.partitionBy(*k).orderBy("_at")) + before)

    def placed_after(r: DataFrame) -> DataFrame:
        c = carried(r, key, {"n": F.count("*")}, {"_upto": lambda s, before, after: F.coalesce(F.sum(s).over(before), F.lit(0))}, {"_upto": "n"})
        return place(c, [*key, "_range"], F.col("_upto"))

    def follow(d: DataFrame, k: list[str]) -> DataFrame:
        return d.withColumn("_k", F.max(F.col("_k") - F.col("_n")).over(Window.partitionBy(*k).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n"))

    def followed_after(r: DataFrame) -> DataFrame:
        c = carried(r, key, {"m": F.max(F.col("_k") - F.col("_n"))}, {"_most": lambda s, before, after: F.max(s).over(before)}, {"_most": "m"})
        return follow(c, [*key, "_range"]).withColumn("_k", F.greatest("_k", F.col("_most") + F.col("_n")))

    first = over_ranges(base.select("_stem", "_at"), lambda d: place(d, key, F.lit(0).cast("long")), placed_after, key, ["_at"], long)
    state = written(first.withColumn("_k", F.when(F.col("_stem").isin(*reserved), F.col("_n")).otherwise(F.col("_n") - 1)), "labels")
    named = F.when(F.col("_k") == 0, F.col("_stem")).otherwise(F.concat_ws("_", "_stem", F.col("_k").cast("string")))
    while True:
        shown = state.withColumn("_label", named)
        held = shown.groupBy("_label").agg(F.min("_at").alias("_first"), F.count("*").alias("_c")).where((F.col("_c") > 1) | F.col("_label").isin(*reserved))
        held = written(held, "labels-held")
        if held.isEmpty():
            break
        met = shown.join(held.hint("shuffle_merge"), "_label", "left")
        moved = F.col("_k") + F.coalesce((F.col("_c").isNotNull() & ((F.col("_at") != F.col("_first")) | F.col("_label").isin(*reserved))).cast("int"), F.lit(0))
        state = written(over_ranges(met.withColumn("_k", moved).select("_stem", "_at", "_n", "_k"), lambda d: follow(d, key), followed_after, key, ["_n"], long), "labels")
    return base.join(state.select("_stem", "_at", named.alias("unique_label")).hint("shuffle_merge"), ["_stem", "_at"]).select(*df.columns, "unique_label")


def flatten_attributes(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs to columns named by their path, from the schema alone."""
    def walk(schema, path):
        for f in schema.fields:
            at = [*path, f.name]
            if f.dataType.typeName() == "struct":
                yield from walk(f.dataType, at)
            else:
                yield at
    return df.select(*(F.col(".".join(f"`{x}`" for x in p)).alias(sep.join(p)) for p in walk(df.schema, [])))


def flatten_json(df: DataFrame, key: str, text: str, sep: str = "_", arrays: bool = False) -> DataFrame:
    """K29 without a schema: (key, path, kind, value) for every leaf of the JSON objects in text, path being the names on its way; value is the leaf as text, null for a JSON
    null. Arrays are leaves, as JSON, or with arrays are walked, too, by position. Kinds may differ from row to row: BOOLEAN, BIGINT,
    DOUBLE or DECIMAL, STRING, VOID, ARRAY. Text that is no JSON, or no object (or array, if they are walked), gives no rows; nor do empty objects.

    A level of all rows is exploded at a time, until no objects are left: so there are as many rounds as the deepest text has levels."""
    spark = df.sparkSession
    inner = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")) | F.lit(arrays) & F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
    level, out = df.select(F.col(key), F.lit(None).cast("string").alias("path"), F.try_parse_json(text).alias("v")).where(inner), None
    while True:
        kids = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("_pos", "_key", "_value"))
        path = F.concat_ws(sep, "path", F.coalesce("_key", F.col("_pos").cast("string")))
        level = written(kids.select(key, path.alias("path"), F.col("_value").alias("v")), "json-level")
        leaves = level.where(~F.coalesce(inner, F.lit(False)))
        kind = F.regexp_extract(F.schema_of_variant("v"), r"^(\w+)", 1)
        leaf = leaves.select(key, "path", kind.alias("kind"), F.when(kind == "STRING", F.col("v").cast("string")).when(kind != "VOID", F.to_json("v")).alias("value"))
        out = leaf if out is None else out.unionAll(leaf)
        level = level.where(inner)
        if level.isEmpty():
            return out


#: Attribute types from the narrowest to the widest.
KINDS = ("boolean", "long", "double", "datetime", "string")


def infer_kind(c: Column) -> Column:
    """Rank in KINDS of one text value."""
    return (F.when(F.lower(c).isin("true", "false"), 0).when(F.rlike(c, F.lit(r"^[+-]?\d+$")), 1).when(F.rlike(c, F.lit(r"^[+-]?\d*\.\d+([eE][+-]?\d+)?$")), 2)
            .when(F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?$")), 3).otherwise(4))


def attribute_kinds(attrs: DataFrame) -> DataFrame:
    """attrs(owner, key, value) -> one kind per (owner, key): the common one; long and double give double, any other mix string."""
    g = attrs.where("value is not null").groupBy("owner", "key").agg(F.min(infer_kind(F.col("value"))).alias("lo"), F.max(infer_kind(F.col("value"))).alias("hi"))
    rank = F.when(F.col("lo") == F.col("hi"), F.col("hi")).when((F.col("lo") == 1) & (F.col("hi") == 2), 2).otherwise(4)
    return g.select("owner", "key", F.get(F.array(*map(F.lit, KINDS)), rank).alias("kind"))


def relation_parts(edges: DataFrame, ids: DataFrame, tasks: int | None = None) -> DataFrame:
    """edges(edge, relation, key, value) -> the same with part and type: a value that is a known id of ids(id, type) makes its key a role, played
    by that id's type; subject and object always are roles ('Unknown' if the id isn't known); any other key is an attribute. Null values go.
    tasks: of the join, if Spark's number is too small."""
    known = ids.groupBy(F.col("id").alias("value")).agg(F.min("type").alias("_type"), F.lit(True).alias("_known"))
    given = edges.where("value is not null").select("edge", "relation", "key", "value")
    m = spread(given, tasks, "value").join(spread(known, tasks, "value").hint("shuffle_merge"), "value", "left")
    role = F.coalesce("_known", F.lit(False)) | F.col("key").isin("subject", "object")
    return m.select("edge", "relation", "key", "value", F.when(role, "role").otherwise("attribute").alias("part"), F.when(role, F.coalesce("_type", F.lit("Unknown"))).alias("type"))


def relation_schema(parts: DataFrame) -> DataFrame:
    """K31 over the table: (relation, key, part, types, kind, n): each role of a relation with the sorted types of its players, each attribute with the kind of its values (K30). A key may be both."""
    roles = parts.where("part = 'role'").groupBy("relation", "key").agg(F.array_sort(F.collect_set("type")).alias("types"), F.count("*").alias("n"))
    own = parts.where("part = 'attribute'").select(F.col("relation").alias("owner"), "key", "value")
    counts = own.groupBy("owner", "key").agg(F.count("*").alias("n"))
    kinds = attribute_kinds(own).join(counts.hint("shuffle_merge"), ["owner", "key"])
    return (roles.select("relation", "key", F.lit("role").alias("part"), "types", F.lit(None).cast("string").alias("kind"), "n")
            .unionByName(kinds.select(F.col("owner").alias("relation"), "key", F.lit("attribute").alias("part"), F.lit(None).cast("array<string>").alias("types"), "kind", "n")))


def relation_instances(parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row for each edge: (edge, relation, roles, attributes), maps of a key to its sorted values; empty without any. Parts are
    dealt by edge, so that both groupings take one exchange. tasks: of it, if Spark's number is too small."""
    dealt = parts.repartition("edge", "relation") if tasks is None else spread(parts, tasks, "edge", "relation")
    each = dealt.groupBy("edge", "relation", "part", "key").agg(F.array_sort(F.collect_set("value")).alias("values"))
    entry = lambda p: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("key", "values")))))
    return each.groupBy("edge", "relation").agg(entry("role").alias("roles"), entry("attribute").alias("attributes"))


# ---- triples and ranking
def simplify(label: Column) -> Column:
    """The text between the first two colons, else the whole."""
    return F.coalesce(F.nullif(F.regexp_extract(label, r"^[^:]*:([^:]+):", 1), F.lit("")), label)


def split_triples(triples: DataFrame, bucket: Column) -> DataFrame:
    """Bucket 0-99 of each triple -> train (80), valid (10), test (10); training triples also reversed."""
    t = triples.withColumn("part", F.when(bucket < 80, "train").when(bucket < 90, "valid").otherwise("test"))
    back = t.where("part = 'train'").select(F.col("o").alias("s"), F.concat("p", F.lit("_inverse")).alias("p"), F.col("s").alias("o"), "part")
    return t.select("s", "p", "o", "part").unionByName(back)


def _from_scores(m: DataFrame) -> DataFrame:
    g = m.groupBy("query", "side").agg(F.sum((F.col("score") > F.col("own")).cast("long")).alias("above"), F.sum((F.col("score") == F.col("own")).cast("long")).alias("ties"), F.count("*").alias("n"))
    opt, pes = F.col("above") + 1, F.col("above") + F.col("ties")
    return g.select("query", "side", "n", opt.alias("optimistic"), pes.alias("pessimistic"), ((opt + pes) / 2).alias("realistic"))


def ranks(scores: DataFrame) -> DataFrame:
    """scores(query, side, candidate, score, is_true) -> optimistic, pessimistic and realistic rank of each true candidate, and how many there were."""
    true = scores.where("is_true").select("query", "side", F.col("score").alias("own"))
    return _from_scores(scores.join(true.hint("shuffle_merge"), ["query", "side"]))


def rank_metrics(r: DataFrame, rank: str = "realistic", hits: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Mean rank, mean reciprocal rank, median, hits@k and the chance-adjusted mean-rank index, by side and for both."""
    r = written(r, "ranks")
    both = r.unionByName(r.withColumn("side", F.lit("both")))
    x = F.col(rank)
    aggs = [F.avg(x).alias("mr"), F.avg(1 / x).alias("mrr"), *(F.avg((x <= k).cast("double")).alias(f"hits_{k}") for k in hits)]
    middle = quantiles(both, ["side"], rank, [0.5]).select("side", F.col("q")[0].alias("median"))  # a side has as many rows as there are queries
    return both.groupBy("side").agg(*aggs, (1 - (F.avg(x) - 1) / F.avg((F.col("n") - 1) / 2)).alias("amri")).join(middle, "side")


# ---- text forms
def verbalise(args: Column, predicate: Column) -> Column:
    """K37: 'a pred b' for two arguments, a joined list for more, null for fewer; underscores are blanks."""
    p = F.translate(predicate, "_", " ")
    return F.when(F.size(args) == 2, F.concat_ws(" ", F.get(args, 0), p, F.get(args, 1))).when(F.size(args) > 2, F.concat(p, F.lit(": "), F.array_join(args, ", ")))


def parse_relation_lines(lines: DataFrame) -> DataFrame:
    """lines(doc, n, line) such as 'relation: a, b' -> doc, source (running number of kept lines), relation, entities; bookkeeping lines (starting with '#' or 'has_') are skipped."""
    kept = lines.where(~F.startswith("line", F.lit("#")) & ~F.startswith("line", F.lit("has_")) & F.contains("line", F.lit(": ")))
    source = F.row_number().over(Window.partitionBy("doc").orderBy("n"))
    return kept.select("doc", source.alias("source"), F.regexp_extract("line", "^([^:]+): ", 1).alias("relation"), F.split(F.regexp_extract("line", "^[^:]+: (.*)$", 1), ", ").alias("entities"))


def attribute_triples(links: DataFrame) -> DataFrame:
    """(id, 'has-attr', key, value, numeric) of each attribute of a link."""
    e = links.select("id", F.explode("attributes").alias("key", "value"))
    return e.select("id", F.lit("has-attr").alias("p"), "key", "value", F.rlike("value", F.lit(r"^-?\d+(\.\d+)?$")).alias("numeric"))


def single_answer(text: Column) -> tuple[Column, Column]:
    """Text after the first colon of the first {...}, and its integer form if it has one."""
    body = F.nullif(F.regexp_extract(text, r"\{([^}]*)\}", 1), F.lit(""))
    value = F.trim(F.get(F.split(body, ":", 2), 1))
    return value, value.try_cast("int")


def reference_check(children: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Of child ids: how many, how many distinct, how many in neither table, and the least such."""
    known = nodes.select("id").unionAll(links.select("id")).distinct()
    lost = children.select(F.col("child").alias("id")).join(known, "id", "left_anti")
    return children.agg(F.count("*").alias("total"), F.countDistinct("child").alias("distinct_ids")).join(F.broadcast(lost.agg(F.count("*").alias("orphans"), F.min("id").alias("sample"))))


def study_metadata(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Source id and year of the document for entities of type Study, null for others."""
    m = entities.join(docs.select("doc", "source_id", "year"), "doc", "left")
    only = lambda c: F.when(F.col("type") == "Study", F.col(c)).alias(c)
    return m.select(*entities.columns, only("source_id"), only("year"))
