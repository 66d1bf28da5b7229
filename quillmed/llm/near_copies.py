"""Near copies by the Jaccard similarity of their word shingles: SimHash fingerprints and MinHash bands find most groups, prefixes
of the shingle sets every pair between groups that these missed; whole shingle sets verify all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .simhash import links
from .store import done, made, written

#: A pair of similarity 0.8 shares no band in 1 of 14,000 cases ((1 - 0.8 ** ROWS) ** BANDS).
BANDS, ROWS = 24, 5
SEED = 42
#: Up to so many members all pairs are candidates; beyond, each member meets two centres.
SMALL = 4
#: Distinct texts whose shingles are counted to order prefixes; shingles that LEAST_COMMON of them or more hold come last, the commonest at the very end.
#: Any order finds all pairs; this one keeps common shingles out of prefixes. At most MOST_COMMON of them are handed to the tasks.
SAMPLE, LEAST_COMMON, MOST_COMMON = 20_000, 3, 200_000
#: Members of a shingle that are paired in one row; those of a commoner one are paired block by block.
BLOCK = 256
#: Least cells of a sketch, and the count at which a cell stays.
CELLS, FULL = 64, 255
#: Rows of whole texts or sets that a Python task takes at a time.
BATCH_ROWS = 500
#: Counted first; more candidates than this are joined by a shuffle.
MOST_BROADCAST = 300_000


def _shingles(text: str | None, words: int, h, np):
    """Sorted distinct hashes of the runs of `words` words; fewer words are one run, no words none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = min(words, len(parts))
    runs = (b" ".join(parts[i:i + k]) for i in range(len(parts) - k + 1)) if parts else ()
    return np.unique(np.fromiter((h(r, SEED) for r in runs), np.uint64))


def _bands(s, a, b, h, np) -> list[int]:
    if not len(s):
        return []
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, ((s[None, at:at + 2048] ^ b) * a).min(axis=1))
    return np.array([h(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def _print(s, np) -> int:
    """64-bit SimHash of a set of shingle hashes: a bit is 1 if set in over half of them; 0 for none."""
    ones = sum(np.unpackbits(s[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for at in range(0, len(s), 65536))
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0]) if len(s) else 0


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """docs(doc_id, th, text) -> (doc_id, th, set, fp, bands): a hash of every row's shingle set, its fingerprint, and hashes of its bands."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        h, rng = xxhash.xxh64_intdigest, np.random.default_rng(SEED)
        a, b = (rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * 2 + 1 for _ in range(2))
        for batch in batches:
            sets, fps, bands = [], [], []
            for t in batch.column(2):
                s = _shingles(t.as_py(), words, h, np)
                sets.append(h(s.tobytes(), SEED))
                fps.append(_print(s, np))
                bands.append(_bands(s, a, b, h, np))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "th", "set", "fp", "bands"])

    return docs.mapInArrow(run, "doc_id long, th long, set long, fp long, bands array<long>")


def _centres(m: Column, key: Column) -> Column:
    """The least member, the same in all bands, and one that differs by band."""
    return F.array(F.element_at(m, 1), F.element_at(m, (F.pmod(key, F.size(m)) + 1).cast("int")))


def _pairs(m: Column, key: Column) -> Column:
    pair = lambda u, v: F.struct(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
    meet = F.when(F.size(m) <= SMALL, m).otherwise(_centres(m, key))
    return F.flatten(F.transform(meet, lambda u: F.transform(F.filter(m, lambda v: u != v), lambda v: pair(u, v))))


def print_candidates(classes: DataFrame) -> DataFrame:
    """classes(set, fp) -> (u, v): each text meets the least one of its fingerprint, and of two fingerprints at
    distance MAX_DISTANCE or less the least texts meet."""
    least = written(classes.groupBy("fp").agg(F.min("set").alias("least"), F.count("*").alias("n")), "near-prints-least")
    edges = links(least.select("fp"))
    side = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")).hint("shuffle_merge")
    between = edges.join(side("u"), "u").join(side("v"), "v").select(F.col("_u").alias("a"), F.col("_v").alias("b"))
    within = classes.join(least.where("n > 1").hint("shuffle_merge"), "fp").select(F.col("set").alias("a"), F.col("least").alias("b"))
    return between.unionAll(within).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def band_candidates(classes: DataFrame) -> DataFrame:
    """classes(set, bands) -> (u, v) that share a band. Each part of a band is paired by itself, then the
    members or centres of its parts; candidates grow in proportion to the members of a band, not to their square.
    There are as many parts as rows in a part of a band that all rows share, so no task holds a whole band."""
    n_parts = max(64, int(classes.count() ** 0.5))
    keyed = classes.select("set", F.explode("bands").alias("key"))
    parts = (keyed.groupBy("key", F.pmod("set", F.lit(n_parts)).alias("part"))
             .agg(F.array_sort(F.collect_list("set")).alias("m")))
    parts = written(parts.select("key", "m"), "near-parts")
    m, key = F.col("m"), F.col("key")
    up = parts.select("key", F.explode(F.when(F.size(m) <= SMALL, m).otherwise(F.array_distinct(_centres(m, key)))).alias("set"))
    whole = up.groupBy("key").agg(F.array_sort(F.collect_list("set")).alias("m"))
    both = parts.where(F.size("m") > 1).unionByName(whole.where(F.size("m") > 1))
    return both.select(F.explode_outer(_pairs(m, key)).alias("p")).where("p is not null").select("p.u", "p.v")


def _similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """pairs(u, v, a, b): those whose shingle sets a, b have the Jaccard similarity or more."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                n = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= similarity * max(len(a), len(b)) - 1e-9 else 0
                keep.append(n >= similarity * (len(a) + len(b) - n) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """docs(set, text) -> (set, s): the sorted shingle hashes as bytes."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            s = [_shingles(t.as_py(), words, xxhash.xxh64_intdigest, np).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.binary())], names=["set", "s"])

    return docs.select("set", "text").mapInArrow(run, "set long, s binary")


def common_shingles(docs: DataFrame, words: int, sample: int = SAMPLE):
    """Hashes of the shingles that are common among some `sample` distinct texts of docs(th, text), in ascending order of hash, and their ranks from 1, the rarest first."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_shingles(t.as_py(), words, xxhash.xxh64_intdigest, np).view(np.int64))], names=["h"])

    share = max(1, docs.agg(F.approx_count_distinct("th")).first()[0] // sample)
    texts = docs.where(F.pmod(F.xxhash64("th"), F.lit(share)) == 0).dropDuplicates(["th"]).select("text")
    counts = texts.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COMMON)
    found = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    h = np.array([r["h"] for r in reversed(found)], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], order + 1


def sketch(s, np) -> bytes:
    """Counts of the hashes of a set in cells by their lowest bits, half to as many cells as hashes. The least counts of two sets, summed over the cells, are no fewer than what they share."""
    cells = max(CELLS, 1 << (len(s) // 2).bit_length())
    return np.minimum(np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells), FULL).astype(np.uint8).tobytes()


def may_share(x: bytes, y: bytes, np) -> int:
    """The most hashes that sets of these sketches may share."""
    a, b = (np.frombuffer(z, np.uint8).astype(np.int64) for z in sorted((x, y), key=len))
    if (a == FULL).any() or (b == FULL).any():  # counts that were cut don't tell
        return 1 << 60
    return int(np.minimum(a, b.reshape(-1, len(a)).sum(axis=0)).sum())


def prefixes(docs: DataFrame, words: int, similarity: float, common) -> DataFrame:
    """docs(set, text) -> (set, size, keys, sketch): of a text's n shingles the first n - ceil(similarity * n) + 1 in one order of all shingles: rare ones by hash, then common ones.
    Two sets of this similarity share at least ceil(similarity * n) shingles, so one at least of each one's prefix is in the other's."""
    def run(batches):
        import math

        import numpy as np
        import pyarrow as pa
        import xxhash

        h, rank = common
        for batch in batches:
            sizes, keys, sketches = [], [], []
            for t in batch.column(1):
                s = _shingles(t.as_py(), words, xxhash.xxh64_intdigest, np)
                sketches.append(sketch(s, np))
                if len(h):
                    at = np.minimum(np.searchsorted(h, s), len(h) - 1)
                    s = s[np.argsort(np.where(h[at] == s, rank[at], 0), kind="stable")]
                sizes.append(len(s))
                keys.append(s[:len(s) - math.ceil(similarity * len(s) - 1e-9) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["set", "size", "keys", "sketch"])

    return docs.select("set", "text").mapInArrow(run, "set long, size int, keys array<long>, sketch binary")


def _sketched(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(u, v) whose sketches leave room for the similarity. sets(set, size, sketch)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = [may_share(x, y, np) >= similarity / (1 + similarity) * (n + m) - 1e-6 for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")))]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, n, x: sets.select(F.col("set").alias(c), F.col("size").alias(n), F.col("sketch").alias(x)).hint("shuffle_merge")
    met = pairs.join(side("u", "n", "x"), "u").join(side("v", "m", "y"), "v")
    return met.select("u", "v", "n", "m", "x", "y").mapInArrow(run, "u long, v long")


def prefix_candidates(sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """sets(set, size, keys, root, ..) -> (u, v): all pairs of different roots that share a shingle of their prefixes and may have the similarity by their
    sizes and by what follows the shingle in both. Members of a shingle are dealt over blocks, and each two blocks meet in a row of their own."""
    keyed = sets.select("set", "size", "root", F.posexplode("keys").alias("at", "key")).repartition("key")
    alike = Window.partitionBy("key")
    counted = keyed.withColumns({"n": F.count("*").over(alike), "least": F.min("root").over(alike), "most": F.max("root").over(alike)}).where("least < most")
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = written(counted.select("key", "set", "size", "root", "at", parts.alias("parts"), F.pmod(F.xxhash64("set"), parts).cast("int").alias("part")), "near-members")
    member = F.struct("set", "size", "root", "at", "part").alias("m")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    few = dealt.where("parts = 1").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), member)
    many = dealt.where("parts > 1").withColumn("other", other).select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), member)
    rows = few.unionAll(many).groupBy("key", "i", "j").agg(F.collect_list("m").alias("ms")).where(F.size("ms") > 1)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i, j, ms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s, size, root, at, part = (c.to_numpy(zero_copy_only=False) for c in ms.values.flatten())
                a, b = np.nonzero(part == i)[0], np.nonzero(part == j)[0]
                size, at = size.astype(np.float64), at.astype(np.float64)
                rest = size - at  # the shingle itself, and those after it
                need = similarity / (1 + similarity) * (size[a][:, None] + size[b][None, :]) - 1e-6
                fits = (root[a][:, None] != root[b][None, :]) & (np.minimum(rest[a][:, None], rest[b][None, :]) >= need)
                x, y = np.nonzero(fits & (np.minimum(size[a][:, None], size[b][None, :]) >= similarity * np.maximum(size[a][:, None], size[b][None, :]) - 1e-6))
                x, y = s[a[x]], s[b[y]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["u", "v"])

    return rows.select("i", "j", "ms").mapInArrow(run, "u long, v long").distinct()


def _at(docs: DataFrame, owners: DataFrame, how: str = "inner") -> DataFrame:
    """docs with th, joined with owners by (doc_id, th); a missing doc_id equals a missing one."""
    o = owners.withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    return docs.join(o, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), how).drop("_d", "_t")


def _verified(pairs: DataFrame, classes: DataFrame, hashed: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the written pairs(u, v) whose whole shingle sets have the similarity."""
    nodes = pairs.select(F.col("u").alias("set")).union(pairs.select("v")).distinct()
    owners = written(classes.join(nodes.hint("shuffle_merge"), "set", "left_semi").select("set", "own.doc_id", "own.th"), "near-owners")
    owners = F.broadcast(owners) if owners.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else owners.hint("shuffle_merge")
    texts = _at(hashed.select("doc_id", "th", "text"), owners)
    sets = written(shingle_sets(texts, words).groupBy("set").agg(F.first("s").alias("s")), "near-sets", BATCH_ROWS)
    left = pairs.join(sets.select(F.col("set").alias("u"), F.col("s").alias("a")).hint("shuffle_merge"), "u")
    met = left.join(sets.select(F.col("set").alias("v"), F.col("s").alias("b")).hint("shuffle_merge"), "v")
    return written(_similar(met, similarity), "near-links", BATCH_ROWS)


#: Tables that nothing reads once the pairs verified are connected.
VERIFIED = ("near-pairs", "near-owners", "near-sets", "near-links")


def representatives(docs: DataFrame, hashed: DataFrame, words: int, similarity: float) -> DataFrame:
    """docs with one row of each group that texts of this similarity of word shingles connect: that of the least
    (doc_id, text hash), missing doc_ids last. Texts without words are one group. hashed: docs with th."""
    spark, start = docs.sparkSession, len(made)
    prints = written(signatures(hashed.select("doc_id", "th", "text"), words), "near-prints", BATCH_ROWS)
    rows = prints.groupBy("set", "doc_id", "th").agg(F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    own = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "th", "n")).alias("own")
    classes = written(rows.groupBy("set").agg(own, F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-class")
    done(spark, start, "near-prints")
    pairs = written(band_candidates(classes.select("set", "bands")).unionAll(print_candidates(classes.select("set", "fp"))).distinct(), "near-pairs")
    done(spark, start, "near-parts", "near-prints-least")
    roots = written(connected_components(_verified(pairs, classes, hashed, words, similarity)).withColumnRenamed("node", "set"), "near-roots")
    done(spark, start, *VERIFIED)
    grouped = classes.select("set", "own").join(roots.hint("shuffle_merge"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    # each distinct text once, its prefix from the text of its owner
    texts = _at(hashed.select("doc_id", "th", "text"), grouped.select("set", "own.doc_id", "own.th").hint("shuffle_merge"))
    first = prefixes(texts, words, similarity, common_shingles(hashed.select("th", "text"), words)).dropDuplicates(["set"])
    first = written(first.join(grouped.select("set", "root").hint("shuffle_merge"), "set"), "near-prefixes", BATCH_ROWS)
    pairs = written(prefix_candidates(first, similarity), "near-rest", BATCH_ROWS)
    done(spark, start, "near-members")
    pairs = written(_sketched(pairs, first, similarity), "near-pairs", BATCH_ROWS)
    done(spark, start, "near-rest", "near-prefixes")
    missed = _verified(pairs, classes, hashed, words, similarity)
    if not missed.isEmpty():
        every = missed.unionAll(roots.select(F.col("set").alias("u"), F.col("root").alias("v")))
        roots = connected_components(every).withColumnRenamed("node", "set")
        grouped = classes.select("set", "own").join(roots.hint("shuffle_merge"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    kept = written(grouped.groupBy("root").agg(F.min("own").alias("own")).select("own.doc_id", "own.th", "own.n"), "near-kept")
    stay = _at(hashed, kept.where("n = 1").select("doc_id", "th").hint("shuffle_merge"), "left_semi")
    again = kept.where("n > 1").select("doc_id", "th")
    if again.limit(1).count():
        same = _at(hashed, again.hint("shuffle_merge"), "left_semi")
        stay = stay.unionByName(same.groupBy("doc_id", "th").agg(F.min(F.struct(*hashed.columns)).alias("r")).select("r.*"))
    return stay.select(*docs.columns)
