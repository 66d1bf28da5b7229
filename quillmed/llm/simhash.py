"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import hot_keys, spread_join, written

#: Fingerprints link at this many differing bits or fewer.
MAX_DISTANCE = 2
SEED = 42
WORDS = 3


def _fingerprint(text: str | None, words: int, h, np) -> int:
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    sums, n = np.zeros(64, np.int64), len(parts) - k + 1
    for at in range(0, n, 65536):  # long texts pass in pieces
        to = min(at + 65536, n)
        spans = zip(starts[at:to].tolist(), ends[at + k - 1:to + k - 1].tolist())
        hashes = np.array([h(flat[s:e], SEED) for s, e in spans], dtype="<u8")
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): 64-bit SimHash of every row's whole text; columns of longs in keep go along.

    Null and blank texts have fingerprint 0. Fewer than `words` words make one shingle.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            fps = [_fingerprint(t.as_py(), words, xxhash.xxh64_intdigest, np) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *keep])

    return docs.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{c} long" for c in keep)]))


def links(prints: DataFrame) -> DataFrame:
    """prints(fp) distinct -> edges(u, v) that connect all fingerprints at distance <= 2.

    Each fingerprint has two 32-bit segments. For each segment the Hamming ball of radius 1 is
    enumerated beside the other segment as it is, and every (segment, other segment) key is
    entered in one table. Two fingerprints at distance <= 2 meet at a key at least once: one
    that differs by <= 1 bit from each. A key has at most 65 fingerprints, whatever the size of
    a group of copies, so matches join the smallest fingerprint of their key and the
    distance of each edge is verified in full; no key emits all pairs.
    """
    half = (1 << 32) - 1
    low, high = F.col("fp").bitwiseAND(F.lit(half)), F.shiftrightunsigned("fp", 32)
    ball = lambda seg: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: seg.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    own = F.array(F.struct(low.alias("lo"), high.alias("hi")))
    keys = F.concat(own, F.transform(ball(low), lambda x: F.struct(x.alias("lo"), high.alias("hi"))),
                    F.transform(ball(high), lambda x: F.struct(low.alias("lo"), x.alias("hi"))))
    dealt = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a slim table has few parts, its keys are 65 times as many
    return (dealt.select("fp", F.explode_outer(keys).alias("key"))
            .groupBy("key").agg(F.collect_list("fp").alias("members"))
            .where(F.size("members") > 1)
            .select(F.array_min("members").alias("u"), F.explode("members").alias("v"))
            .where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE))
            .distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (smallest doc_id reachable by links).

    Work on links is done once for each distinct fingerprint, so copies of a text add nothing.
    Rows whose doc_id is null keep their row; they don't name a component unless alone in it.
    An empty table gives an empty result. Very long texts are hashed in pieces, whole. Only doc_id
    and text are read, so other columns may have any names.
    """
    prints = written(fingerprints(docs), "simhash-fp")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-class")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    edges = written(links(classes.select("fp")), "simhash-links")
    roots = connected_components(edges)
    known = classes.join(roots.withColumnRenamed("node", "fp").hint("shuffle_merge"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    names = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    comp = written(known.join(names.hint("shuffle_merge"), "root").select("fp", "component_id"), "simhash-comp")
    return spread_join(prints, comp, "fp", hot_keys(classes, "fp", total)).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component: that of its least (doc_id, text hash), missing doc_ids
    last; of rows equal in both, the least by all columns. Other columns of docs pass as they are.

    Without a similarity texts link by their fingerprints alone. With one, a link also needs that
    Jaccard similarity of the sets of word shingles: fingerprints within MAX_DISTANCE are verified, and
    so are pairs that share a band of least hashes, as fingerprints of pairs near 0.8 differ in
    about ten bits, more than balls can reach.
    """
    hashed = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("th", F.xxhash64("text"))
    if similarity is not None:
        from .near_copies import representatives as verified

        return verified(docs, hashed, words, similarity)
    prints = written(fingerprints(hashed, words, keep=("th",)), "simhash-rows")
    own = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "th")).alias("own")
    classes = written(prints.groupBy("fp").agg(own), "simhash-own")
    roots = connected_components(written(links(classes.select("fp")), "simhash-links")).withColumnRenamed("node", "fp")
    grouped = classes.join(roots.hint("shuffle_merge"), "fp", "left")
    kept = written(grouped.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("own").alias("own")).select(F.col("own.doc_id").alias("_d"), F.col("own.th").alias("_t")), "simhash-kept")
    at = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))
    same = hashed.join(kept.hint("shuffle_merge"), at, "left_semi")
    return same.groupBy("doc_id", "th").agg(F.min(F.struct(*hashed.columns)).alias("r")).select("r.*").select(*docs.columns)
