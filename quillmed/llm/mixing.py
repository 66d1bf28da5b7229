"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: No source gives more than this many times its own size.
MOST = 2.0
#: Slot t has the point frac(t * golden ratio), as a multiple of 2**-31; the step is odd, so no point repeats early.
SPAN = 1 << 31
GOLDEN = 1327217885
#: A table of one row per source is broadcast up to this many sources; beyond, rows are shuffled to it.
FEW_SOURCES = 10_000
ROWS_A_PART = 1000
#: Where the schedule misses a target by so many blocks at most, the last blocks are cut or the next ones added.
REMAINDER = 4
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, weight, target.

    Sources by code point, null last, take the weights in turn. Targets follow the weights until
    a source meets its limit; the excess is reshared by weight until none is above: the level L
    of sum(min(limit, L * weight)) = share * total, found from sums over sources in the order
    in which they meet their limits. One row per source is all that is ordered.
    """
    everything = Window.partitionBy()
    ranked = (sizes.withColumn("turn", F.row_number().over(everything.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
              .withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("turn", F.lit(len(weights)))))
              .withColumn("most", F.lit(most) * F.col("source_size")))
    order = everything.orderBy(F.col("most") / F.col("weight"), "turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = (ranked.withColumn("need", F.lit(share) * F.sum("source_size").over(everything))
              .withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
              .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
              .withColumn("level", (F.col("need") - F.col("full")) / F.col("open")))
    # the first source in that order whose limit is not met has the level of all later ones
    level = F.min(F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("turn"), F.col("level").alias("level")))).over(everything)["level"]
    return filled.withColumn("target", F.coalesce(F.least(F.col("most"), level * F.col("weight")), "most")).select("source", "turn", "source_size", "weight", "target")


def _running(df: DataFrame, key: str, order: list, value: str, parts: int, name: str) -> DataFrame:
    """Adds the sum of value over earlier rows of the key in the order (part, *order). Rows are
    summed within hashed parts of a key; sums of parts are then laid end to end, so that a key
    that holds a third of all rows is not one task's work."""
    sums = df.groupBy(key, "part").agg(F.sum(value).alias("s"))
    first = sums.withColumn("first", F.sum("s").over(Window.partitionBy(key).orderBy("part")) - F.col("s")).drop("s")
    inner = F.sum(value).over(Window.partitionBy(key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return df.withColumn(name, inner).join(first.hint("shuffle_merge"), [key, "part"]).withColumn(name, F.col(name) + F.col("first")).drop("first")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)).cast("long")


def schedule(plan: DataFrame, slots: int, step: int = GOLDEN) -> DataFrame:
    """plan(turn, target) -> (turn, slot, rank): each slot's source, and its rank among the slots of that source.

    Slot t goes to the source on whose part of the cumulative targets the point frac(t * golden
    ratio) falls. Parts are integers of SPAN; a point's bin finds its source by an equality join.
    """
    few = plan.count() <= FEW_SOURCES
    grown = F.sum("target").over(Window.partitionBy().orderBy("turn"))
    cum = (plan.withColumn("hi", F.round(grown / F.greatest(F.sum("target").over(Window.partitionBy()), F.lit(1e-300)) * float(SPAN)).cast("long"))
           .withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy().orderBy("turn")), F.lit(0)).cast("long")))
    wide = SPAN >> 12
    reach = written(cum.where("hi > lo").select("turn", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide))).alias("bin")), "mix-reach")
    points = (plan.sparkSession.range(slots).withColumnRenamed("id", "slot")
              .withColumn("point", F.pmod(F.pmod("slot", F.lit(SPAN)) * F.lit(step), F.lit(SPAN)))
              .withColumn("bin", F.floor(F.col("point") / wide)))
    drawn = points.join(F.broadcast(reach) if few else reach.hint("shuffle_merge"), "bin").where("point >= lo and point < hi").select("turn", "slot")
    parts = max(1, -(-slots // ROWS_A_PART))
    dealt = drawn.withColumn("part", F.floor(F.col("slot") * parts / slots)).withColumn("one", F.lit(1).cast("long"))
    return _running(dealt, "turn", ["slot"], "one", parts, "rank").select("turn", "slot", "rank")


def mix(docs: DataFrame, seed: int = 17, keep: list[str] = (), step: int = GOLDEN) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, taken, start, first_slot and
    epochs (for each pass over its source that takes words of it: struct(pass, words, slot)).

    Each source's documents are shuffled by a hash and laid end to end as one stream of words,
    which is cut into blocks of equal token count and starts again when it ends. The r-th slot
    that the schedule draws for a source takes block r of its stream: the join of slots with
    blocks decides which words are taken. What the draws of a source miss of its target, or
    pass it by, is at most REMAINDER blocks; these are added after the last slot or cut. A
    source that is further off (as with a step that spreads badly) keeps what was drawn, but
    never more than `MOST` times its size.

    Null texts and texts without words have size 0 and give nothing; null is a source, the last.
    Repeated rows are documents of their own. A table without words has targets of 0.
    """
    slim = docs.select(F.col("doc_id").cast("long"), word_count(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("_text"), *keep)
    slim = written(slim.withColumn("dice", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("_text").cast("string")))).drop("_text"), "mix-slim")
    n, words = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    plan = written(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    block = max(1, int(SHARE * words) // max(1, 4 * n))  # about four slots a document, at any size
    slots = max(1, int(SHARE * words) // block)
    few = plan.count() <= FEW_SOURCES
    near = (lambda df: F.broadcast(df)) if few else (lambda df: df.hint("shuffle_merge"))

    drawn = written(schedule(plan, slots, step), "mix-schedule")
    counts = drawn.groupBy("turn").agg(F.count("*").alias("blocks"))
    have, limit = F.coalesce("blocks", F.lit(0)) * block, F.floor("target").cast("long")
    close = F.abs(have - limit) <= REMAINDER * block
    quota = F.when(close, limit).otherwise(F.least(have, F.floor(F.lit(MOST) * F.col("source_size")).cast("long")))
    plan = written(plan.join(counts.hint("shuffle_merge"), "turn", "left").select("source", "turn", "source_size", "target", F.coalesce("blocks", F.lit(0)).alias("blocks"), quota.alias("quota")), "mix-quota")
    more = (plan.where(F.col("quota") > F.col("blocks") * block)
            .select("turn", F.explode(F.sequence("blocks", F.floor((F.col("quota") - 1) / block))).alias("rank")).select("turn", (F.lit(slots) + F.col("rank")).alias("slot"), "rank"))
    taking = drawn.unionByName(more)

    # streams: every document's place among its source's words
    key = plan.select(F.col("source").alias("of"), "turn", "source_size", "target", "quota")
    deal = slim.join(near(key), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    deal = deal.withColumn("part", F.pmod(F.conv(F.substring("dice", 1, 8), 16, 10).cast("long"), F.lit(max(1, -(-n // ROWS_A_PART)))))
    placed = written(_running(deal, "turn", ["dice", "doc_id", "size"], "size", n, "start"), "mix-placed")

    # blocks that a document meets in each pass, and the slots that take them
    passes = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("quota") / F.greatest(F.col("source_size"), F.lit(1))) - 1)
    met = (placed.where("size > 0 and quota > 0").select("turn", "start", "size", "quota", "source_size", F.explode(passes).alias("pass"))
           .withColumn("from", F.col("pass") * F.col("source_size") + F.col("start"))
           .withColumn("to", F.least(F.col("from") + F.col("size"), "quota")).where("from < to"))
    opened = met.select("turn", "start", "size", "pass", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))).alias("rank"))
    took = (opened.join(taking.hint("shuffle_merge"), ["turn", "rank"])
            .withColumn("words", F.least("to", (F.col("rank") + 1) * block) - F.greatest("from", F.col("rank") * block)))
    each = [(p, F.col("pass") == p) for p in range(int(-(-MOST // 1)))]
    spans = took.groupBy("turn", "start", "size").agg(
        F.sum("words").alias("taken"), F.min("slot").alias("first_slot"),
        F.array_compact(F.array(*(F.when(F.sum(F.when(at, F.col("words"))).isNotNull(), F.struct(F.lit(p).alias("pass"), F.sum(F.when(at, F.col("words"))).alias("words"), F.min(F.when(at, F.col("slot"))).alias("slot"))) for p, at in each))).alias("epochs"))
    out = placed.join(spans.hint("shuffle_merge"), ["turn", "start", "size"], "left")  # words of two rows never start at one place
    return out.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "start", "first_slot", "epochs", *keep)


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of docs, in the order of the schedule's slots: a row for each pass
    that takes words of a document, with the words it takes (whole texts but for a source's last one).
    Rows alike in doc_id, source and text take one after the other, each with its own other columns;
    a row without words or beyond its source's words goes. All columns of docs keep their names and
    values (n_chars follows the text), whatever they are called.
    """
    key = ["doc_id", "source", "hash"]
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("hash")]
    parts = mix(docs.select("doc_id", "text", "source", F.xxhash64("text").alias("hash")), seed, ["hash"])
    take = F.when(F.col("taken") > 0, F.struct("first_slot", "start", "size", "epochs"))
    takes = written(parts.groupBy(*key).agg(F.count("*").alias("copies"), F.sort_array(F.collect_list(take)).alias("takes"), F.max("first_slot").alias("last")).where("size(takes) > 0"), "mix-takes")
    last, copied = takes.agg(F.max("last"), F.max("copies")).first()
    same = lambda c: F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}"))
    met = docs.select(F.struct("*").alias("row"), *own).alias("d").join(takes.alias("t").hint("shuffle_merge"), same("doc_id") & same("source") & (F.col("d.hash") == F.col("t.hash")))
    at = F.row_number().over(Window.partitionBy(*(F.col(f"t.{c}") for c in key)).orderBy(F.xxhash64("row"))) - 1 if (copied or 0) > 1 else F.lit(0)
    rows = met.select("row", "takes", at.alias("at")).select("row", F.get("takes", "at").alias("take")).where("take is not null").select("row", F.col("take.size").alias("size"), F.explode("take.epochs").alias("e"))
    some = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1), F.col("e.words").cast("int")), "")
    cut = rows.select("row", F.col("e.slot").alias("slot"), F.when(F.col("e.words") < F.col("size"), some).otherwise(F.col("row.text")).alias("text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.least(F.floor(F.col("slot") * tasks / ((last or 0) + 1)), F.lit(tasks - 1)).cast("int")
    ordered = cut.repartitionById(tasks, dealt).sortWithinPartitions("slot")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return ordered.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
