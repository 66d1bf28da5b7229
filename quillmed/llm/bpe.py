"""Byte-level BPE encoding and decoding by Spark higher-order functions."""

from __future__ import annotations

import base64
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_rules import let
from .store import written

#: Entries of the table of frequent words.
DICTIONARY = 1 << 19
#: Words of more bytes than this are merged by a heap, in n log n steps, where a fold would take n * n.
LONGEST = 64
NONE = (1 << 31) - 1


def java_pattern(pattern: str) -> str:
    """The pattern with Unicode white space, which Java's own \\s doesn't hold."""
    return pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def constants(df: DataFrame, **values: Column):
    """df and a function use(body): body gets the values by name, each a constant of the plan (the
    result of a query that runs once), bound outside of all inner functions."""
    given = df.withColumn("_constants", F.struct(*(v.alias(k) for k, v in values.items())))
    return given, lambda body: let(F.col("_constants"), body)


class Vocabulary:
    """The rank map as constant values of a plan: buckets of (bytes -> rank), buckets of (pair of
    ranks -> rank of the two pieces together), and the pieces by rank. Their size is that of the vocabulary file."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1 << 14):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        table: list[dict] = [{} for _ in range(buckets)]
        pairs: list[dict] = [{} for _ in range(buckets)]
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            table[zlib.crc32(piece) % buckets][piece] = rank
            pieces[rank] = piece
            for k in range(1, len(piece)):
                a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
                if a is not None and b is not None:
                    pairs[(a * 31 + b) % buckets][(a << 32) + b] = rank
        schema = T.StructType([T.StructField("ranks", T.ArrayType(T.MapType(T.BinaryType(), T.IntegerType()))),
                               T.StructField("pairs", T.ArrayType(T.MapType(T.LongType(), T.IntegerType()))), T.StructField("pieces", T.ArrayType(T.BinaryType()))])
        row = spark.createDataFrame([(table, pairs, pieces)], schema, verifySchema=False)
        #: What folding needs; ranks of whole words are a constant of their own, as not all plans need them.
        self.values = {"pairs": row.select("pairs").scalar(), "pieces": row.select(F.transform("pieces", lambda p: F.hex(p)).alias("p")).scalar()}
        self.ranks, self.buckets, self.pieces = row.select("ranks").scalar(), buckets, pieces
        self.singles = [ranks[bytes([b])] for b in range(256)]

    def coder(self, given: Column, whole: bool) -> Coder:
        return Coder(given["ranks"] if whole else None, given["pairs"], given["pieces"], self.buckets, self.singles)


class Coder:
    """Expressions on one word, given the constants of a vocabulary."""

    def __init__(self, ranks: Column | None, pairs: Column, pieces: Column, buckets: int, singles: list[int]):
        self.ranks, self.pairs, self.pieces, self.buckets, self.singles = ranks, pairs, pieces, buckets, F.lit(singles).cast("array<int>")

    def rank(self, piece: Column) -> Column:
        return F.get(self.ranks, (F.crc32(piece) % self.buckets).cast("int"))[piece]

    def pair(self, a: Column, b: Column) -> Column:
        """Rank of two neighbouring pieces together, NONE without one."""
        key = a.cast("long") * (1 << 32) + b
        return F.coalesce(F.get(self.pairs, (a * 31 + b) % self.buckets)[key], F.lit(NONE))

    def encode(self, word: Column) -> Column:
        """The ids of one word given as bytes: its own rank, else ranked merges folded over its byte array. The
        leftmost pair of lowest rank merges first, until no pair has a rank. The state holds
        the ranks t of the pieces and the ranks r of neighbouring pieces together."""
        def merge(s: Column, m: Column, p: Column) -> Column:
            t, r = s["t"], s["r"]
            gone = F.when(p < F.size(r), p).otherwise(p - 1)
            pieces = F.transform(t, lambda x, i: F.when(i == p - 1, m).otherwise(x))
            together = F.transform(r, lambda x, i: F.when(i == p - 2, self.pair(F.get(t, p - 2), m)).when((i == p - 1) & (p < F.size(r)), self.pair(m, F.get(t, p + 1))).otherwise(x))
            return F.struct(F.filter(pieces, lambda x, i: i != p).alias("t"), F.filter(together, lambda x, i: i != gone).alias("r"))

        def step(s: Column, _: Column) -> Column:
            low = lambda m: F.when(m == NONE, s).otherwise(let(F.array_position(s["r"], m).cast("int"), lambda p: merge(s, m, p)))
            return let(F.coalesce(F.array_min(s["r"]), F.lit(NONE)), low)

        def fold(w: Column) -> Column:
            n = F.length(w)
            one = lambda chars: F.transform(F.sequence(F.lit(1), n), lambda i: F.get(self.singles, F.ascii(F.substring(chars, i, F.lit(1)))))
            singles = let(F.decode(w, "ISO-8859-1"), one)  # a character for each byte
            start = lambda t: F.struct(t.alias("t"), F.transform(F.sequence(F.lit(0), n - 2), lambda i: self.pair(F.get(t, i), F.get(t, i + 1))).alias("r"))
            merged = F.aggregate(F.sequence(F.lit(1), n - 1), let(singles, start), step, lambda s: s["t"])
            return F.when(n > 1, merged).when(n == 1, singles).otherwise(F.array().cast("array<int>"))

        if self.ranks is None:
            return let(word, fold)
        return let(word, lambda w: let(self.rank(w), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(fold(w))))

    def decode_hex(self, ids: Column) -> Column:
        """The hex form of the ids' pieces, one after the other."""
        return F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), "")


def ids_hex(ids: Column) -> Column:
    """Ids as little-endian unsigned 32-bit integers, in hex."""
    def one(i: Column) -> Column:
        return let(F.lpad(F.hex(i.cast("long")), 8, "0"), lambda h: F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))))
    return F.array_join(F.transform(ids, one), "")


def _coded(vocab: Coder, word: Column) -> Column:
    return let(vocab.encode(F.encode(word, "UTF-8")), lambda ids: F.struct(ids_hex(ids).alias("ids"), vocab.decode_hex(ids).alias("bytes")))


def frequent(docs: DataFrame, vocab: Vocabulary, pattern: str, size: int = DICTIONARY):
    """The most frequent distinct words of all texts (at most `size` of at most LONGEST bytes, by
    counts over the whole table), encoded and decoded once each: an Arrow table (word, ids, bytes)."""
    # a plain explode would have its array made once more, for a filter on its size
    words = docs.select(F.explode_outer(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("word")).where("word is not null")
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST)), "bpe-words")
    by_count = counts.groupBy("n").agg(F.count("*").alias("words"))
    upto = by_count.withColumn("upto", F.sum("words").over(Window.orderBy(F.desc("n"))))
    cut = upto.where(F.col("upto") <= size).agg(F.min("n")).first()[0]
    kept = counts.where(F.col("n") >= (cut or NONE)).select("word")
    sheets = kept.groupBy(F.pmod(F.hash("word"), F.lit(1024)).alias("sheet")).agg(F.collect_list("word").alias("words"))  # at most size / 1024 or so each
    given, use = constants(sheets.repartition(64, "sheet"), ranks=vocab.ranks, **vocab.values)
    each = use(lambda k: F.transform("words", lambda w: F.struct(w.alias("word"), _coded(vocab.coder(k, True), w).alias("c"))))
    coded = given.select(F.explode_outer(each).alias("x"))
    return written(coded.select("x.word", F.unhex("x.c.ids").alias("ids"), F.unhex("x.c.bytes").alias("bytes")), "bpe-coded").toArrow()


def _with_pieces(known, pieces: list[bytes]):
    """The table of known words and, for each other word that is a piece of the vocabulary, its one id."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words, ids = [], []
    for rank, piece in enumerate(pieces):
        try:
            words.append(piece.decode())
            ids.append(rank)
        except UnicodeDecodeError:  # part of a character is never a word
            continue
    own = pa.table([pa.array(words, pa.string()), pa.array([i.to_bytes(4, "little") for i in ids], pa.binary()), pa.array([w.encode() for w in words], pa.binary())], names=["word", "ids", "bytes"])
    known = known.cast(own.schema)
    return pa.concat_tables([known, own.filter(pc.invert(pc.is_in(own["word"], known["word"])))]).combine_chunks()


def merge_by_heap(word: bytes, ranks: dict) -> list[int]:
    """The ids of one long word: the leftmost pair of lowest rank merges first. Pieces are linked by position; a
    heap holds the pairs, and entries of pieces that have changed since are passed over."""
    from heapq import heapify, heappop, heappush

    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a piece is known by its start; before: start of the one to the left
    alive = [True] * n
    pairs = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapify(pairs)

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i:end[j]])) is not None:
            heappush(pairs, (r, i, end[j]))

    while pairs:
        _, i, to = heappop(pairs)
        if not alive[i] or end[i] >= to or end[end[i]] != to:
            continue
        alive[end[i]], end[i] = False, to
        if to < n:
            before[to] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


def _long_words(pa, pc, flat, index, known: int, pieces: list[bytes]):
    """The distinct long words among those not known, their ids and their decoded bytes; index of each word in the known, the long and (last) all others."""
    far = pa.array(index == known)
    is_long = pc.and_(far, pc.greater(pc.binary_length(flat), LONGEST))
    words = flat.filter(is_long).dictionary_encode()
    if not len(words):
        return index, pa.array([], pa.binary()), pa.array([], pa.binary())
    ranks = {p: r for r, p in enumerate(pieces) if p}
    ids = [merge_by_heap(w.encode(), ranks) for w in words.dictionary.to_pylist()]
    index = index.copy()
    index[far.to_numpy(zero_copy_only=False)] = known + len(ids)
    index[is_long.to_numpy(zero_copy_only=False)] = known + words.indices.to_numpy(zero_copy_only=False)
    return index, pa.array([b"".join(i.to_bytes(4, "little") for i in x) for x in ids], pa.binary()), pa.array([b"".join(pieces[i] for i in x) for x in ids], pa.binary())


def _segments(np, pa, words, index, codes):
    """Codes of the known words of each document, cut at its other words: a list of binary runs
    per document, one more than it has other words."""
    lost = np.flatnonzero(index == len(codes) - 1)
    starts = words.offsets.to_numpy() - words.offsets[0].as_py()
    at = np.concatenate((starts[:-1], lost))
    at = at[np.argsort(at, kind="stable")]  # a document's start goes before its first word
    taken = codes.take(pa.array(index))
    offsets = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4) if len(taken) else np.zeros(1, np.int32)
    runs = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(offsets[at], offsets[-1]).astype(np.int32)), taken.buffers()[2] if len(taken) else pa.py_buffer(b"")])
    before = np.searchsorted(lost, starts)
    return pa.ListArray.from_arrays(pa.array((before + np.arange(len(starts))).astype(np.int32)), runs), lost, before


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] = ()) -> DataFrame:
    """doc_id, n_tokens, ids (binary), decoded (binary) of every row's whole text, and the columns of keep.

    Words are the pattern's matches. The frequent distinct words are folded once; their codes and
    the vocabulary's pieces are a table of bounded size, which every task holds to look words up by Arrow's hash index. Any other
    word is folded once for each document, or merged by a heap if it is longer than LONGEST, so every
    text is encoded in full and the table's bound only shifts work. Null and empty texts have no ids.
    """
    vocab, java, own = Vocabulary(docs.sparkSession, path), java_pattern(pattern), [f"_{c}" for c in keep]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(F.col(c).alias(f"_{c}") for c in keep))
    shared = docs.sparkSession.sparkContext.broadcast(_with_pieces(frequent(rows, vocab, java), vocab.pieces))
    pieces_of = docs.sparkSession.sparkContext.broadcast(vocab.pieces)  # of the size of the vocabulary file

    def look_up(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        none = pa.array([b""], pa.binary())
        known = shared.value["word"].combine_chunks()
        ids, pieces = (shared.value[c].chunks for c in ("ids", "bytes"))
        plain_ids, plain_pieces = (pa.concat_arrays([*c, none]) for c in (ids, pieces))
        for b in batches:
            words = b.column("words")
            flat = words.flatten()
            index = pc.fill_null(pc.index_in(flat, known), len(known)).to_numpy(zero_copy_only=False)
            index, long_ids, long_bytes = _long_words(pa, pc, flat, index, len(known), pieces_of.value)
            some = len(long_ids) > 0
            codes, lost, before = _segments(np, pa, words, index, pa.concat_arrays([*ids, long_ids, none]) if some else plain_ids)
            decoded, _, _ = _segments(np, pa, words, index, pa.concat_arrays([*pieces, long_bytes, none]) if some else plain_pieces)
            # each document's other words once, and for each cut which of them stands there
            coded = flat.take(pa.array(lost)).dictionary_encode()
            doc = np.repeat(np.arange(len(words)), np.diff(before))
            pair, which = np.unique(doc * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            first = np.searchsorted(pair, np.arange(len(words) + 1) * max(1, len(coded.dictionary)))
            rare = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), coded.dictionary.take(pa.array(pair % max(1, len(coded.dictionary)))))
            cuts = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array((which - first[doc]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(b.schema.names, b.columns) if n != "words"), codes, decoded, rare, cuts], names=[*(n for n in b.schema.names if n != "words"), "ids", "bytes", "rare", "cuts"])

    found = rows.select("doc_id", *own, F.regexp_extract_all("text", F.lit(java), 0).alias("words"))
    schema = T.StructType([*(f for f in found.schema if f.name != "words"), T.StructField("ids", T.ArrayType(T.BinaryType())), T.StructField("bytes", T.ArrayType(T.BinaryType())), T.StructField("rare", T.ArrayType(T.StringType())), T.StructField("cuts", T.ArrayType(T.IntegerType()))])
    given, use = constants(found.mapInArrow(look_up, schema), **vocab.values)
    joined = lambda runs, c, name: F.array_join(F.zip_with(runs, F.transform("cuts", lambda i: F.get(c[name], i)), lambda a, x: F.concat(F.hex(a), F.coalesce(x, F.lit("")))), "").alias(name)
    coded = use(lambda k: let(F.transform("rare", lambda w: _coded(vocab.coder(k, False), w)), lambda c: F.struct(joined("ids", c, "ids"), joined("bytes", c, "bytes"))))
    return (given.select("doc_id", coded.alias("j"), *own)
            .select("doc_id", F.unhex("j.ids").alias("ids"), F.unhex("j.bytes").alias("decoded"), *own)
            .select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded", *(F.col(f"_{c}").alias(c) for c in keep)))
