"""Suffix-array dedup: remove bytes covered by a long string that also starts earlier."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Length of the strings, and of the anchors by which equal strings meet.
LENGTH, GRAM = 100, 32
#: Contexts of a shard (a context is LENGTH to 2 * LENGTH - GRAM bytes), and of one anchor in a shard.
SHARD, HOT = 4096, 2048
#: Anchors that this many rows of a sample of so many documents share are dealt by their surroundings too; only the dealing rests on the sample.
HEAVY, HEAVY_SAMPLE = 16, 1 << 14
#: Documents are handled in runs of about this many bytes.
RUN = 1 << 19
_LOW = -(1 << 63)


def _tables(np, n):
    """Powers of an odd base and of its inverse, modulo 2**64."""
    base = np.uint64(0xD6E8FEB86659FD93)
    inv = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        one = np.ones(1, np.uint64)
        return (np.multiply.accumulate(np.concatenate((one, np.full(n, base)))), np.multiply.accumulate(np.concatenate((one, np.full(n, inv)))))


def _mix(np, h):
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _sums(np, data, up, salt):
    """Prefix sums that give the hash of any substring."""
    rng = np.random.default_rng(salt)
    code = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(code[data] * up[:len(data)])))


def _sliding_min(np, h, width):
    """Leftmost place of the least value in every window of h: blockwise minima from both sides."""
    n = len(h)
    top = np.uint64((1 << 64) - 1)
    m = -(-n // width) * width
    v = np.full(m, top)
    v[:n] = h
    grid, place = v.reshape(-1, width), np.arange(m).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1)
    new = np.ones(grid.shape, bool)
    new[:, 1:] = grid[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, place, -1), axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    behind_at = np.minimum.accumulate(np.where(grid == behind, place, m)[:, ::-1], axis=1)[:, ::-1].ravel()
    ahead, behind = ahead.ravel(), behind.ravel()
    p = np.arange(n - width + 1)
    return np.where(behind[p] <= ahead[p + width - 1], behind_at[p], ahead_at[p + width - 1])


def anchors(np, texts, up, down):
    """For a run of texts: (text, anchor place in it, first and last start it owns, anchor hash, two
    hashes of its surroundings). The anchor of a LENGTH-byte string is its GRAM-byte substring of
    least hash, the leftmost if several; equal strings have equal anchors at equal offsets. The
    surroundings are all bytes that decide or lie in the strings an anchor can own, so where
    they agree, those strings agree one by one."""
    width = LENGTH - GRAM + 1
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < LENGTH:
        return None
    with np.errstate(over="ignore"):
        sums = _sums(np, data, up, 1)
        n = len(data) - GRAM + 1
        gram = _mix(np, (sums[GRAM:] - sums[:-GRAM]) * down[:n])
        own = _sliding_min(np, gram, width)
        starts = np.arange(len(own))
        text = np.searchsorted(ends, starts, side="right")
        ok = starts + LENGTH <= ends[text]
        starts, own, text = starts[ok], own[ok], text[ok]
        if not len(starts):
            return None
        first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1))))
        last = np.concatenate((first[1:], [len(starts)])) - 1
        a, t = own[first], text[first]
        begin = ends[t] - np.array([len(x) for x in texts])[t]
        left, right = np.maximum(a - (LENGTH - GRAM), begin), np.minimum(a + LENGTH, ends[t])
        shape = (a - left).astype(np.uint64) * np.uint64(1000003) + (right - a).astype(np.uint64)
        around = []
        for own_sums in (sums, _sums(np, data, up, 4)):
            around.append(_mix(np, (own_sums[right] - own_sums[left]) * down[left] + shape).view(np.int64))
    return t, a - begin, a - starts[first], a - starts[last], gram[a].view(np.int64), *around


def _doc(docs: DataFrame):
    """Columns doc and tag, which name a document: doc_id (null: the lowest number), and where ids repeat or
    are missing a hash of the text, which tells rows of one id apart; rows alike in both are one document."""
    text = F.coalesce("text", F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW))
    repeated = not docs.select(doc.alias("doc")).groupBy("doc").agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col("doc") == _LOW)).isEmpty()
    return doc.alias("doc"), (F.xxhash64(text) if repeated else F.lit(0).cast("long")).alias("tag"), text.alias("text")


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """One row per anchor: key, around, around2, doc, tag, at (place and owned starts in one number), sure.
    Within a run of rows the later of equal surroundings are known to repeat; they are `sure`,
    and are dealt by a number of their own, so that a passage in a third of all documents
    sends one row per run to its anchor's task."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        up = down = np.zeros(0)
        for b in batches:
            doc, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
            found, texts, size, base = [], [], 0, 0
            for i, t in enumerate(b.column(2)):
                texts.append(t.as_py().encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= RUN or i + 1 == len(b):
                    if len(up) <= size:
                        up, down = _tables(np, size + 1)
                    got = anchors(np, texts, up, down)
                    if got is not None:
                        found.append((got[0] + base, *got[1:]))
                    base, texts, size = i + 1, [], 0
            if not found:
                continue
            t, a, lo, hi, key, around, other = (np.concatenate(c) for c in zip(*found))
            d, g, at = doc[t], tag[t], (a << 14) | (lo << 7) | hi
            order = np.lexsort((at, g, d, other, around, key))
            d, g, at, key, around, other = d[order], g[order], at[order], key[order], around[order], other[order]
            same = np.concatenate(([False], (key[1:] == key[:-1]) & (around[1:] == around[:-1]) & (other[1:] == other[:-1])))
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(d))))
            sure = same & ((d != d[head]) | (g != g[head]) | (at != at[head]))
            with np.errstate(over="ignore"):
                key = np.where(sure, _mix(np, (at ^ (d << 20)).view(np.uint64)).view(np.int64), key)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.where(sure, 0, around), np.where(sure, 0, other), d, g, at, sure)], names=["key", "around", "around2", "doc", "tag", "at", "sure"])

    return docs.mapInArrow(run, "key long, around long, around2 long, doc long, tag long, at long, sure boolean")


def _spans():
    """First and last start of a row's owned strings."""
    place = F.shiftright("at", 14)
    return ((place - F.shiftright("at", 7).bitwiseAND(F.lit(127))).alias("lo"), (place - F.col("at").bitwiseAND(F.lit(127))).alias("hi"))


def _contexts(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """asked(doc, tag, lo, hi, shard, hot) -> the same with `bytes`, the strings' text."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for d, g, t, spots in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = t.encode("utf-8", "surrogatepass")
                out += [(d, g, s["lo"], s["shard"], s["hot"], raw[s["lo"]:s["hi"] + LENGTH]) for s in spots]
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc", "tag", "lo", "shard", "hot", "bytes"])

    by_doc = asked.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi", "shard", "hot")).alias("spots"))
    return (docs.join(by_doc.hint("shuffle_merge"), ["doc", "tag"]).select("doc", "tag", "text", "spots")
            .mapInArrow(run, "doc long, tag long, lo long, shard long, hot boolean, bytes binary"))


def search_shard(doc, tag, lo, hot, pieces):
    """Repeats within one shard, by its suffix array and common prefixes.

    Returns arrays (piece, first start, last start) of the runs of starts whose string also starts earlier in the
    shard, and (piece, start, two hashes of the string) of the other starts of hot pieces, whose anchor has pieces in other shards too."""
    import numpy as np

    from .suffix_array import common_prefixes, suffix_array

    sizes = np.array([len(p) for p in pieces])
    joined = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    text = joined.astype(np.uint16) + 2
    text[ends] = 1
    text = np.concatenate((text, np.zeros(1, np.uint16)))
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes + 1)
    offset = (np.arange(len(joined)) - np.repeat(ends - sizes, sizes + 1)).astype(np.int32)
    left = np.concatenate((ends[piece] - np.arange(len(joined)), [0])).astype(np.int32)
    sa = suffix_array(text, LENGTH)
    shared = common_prefixes(np.concatenate((joined, np.zeros(LENGTH + 9, np.uint8))), sa, left, LENGTH)
    order = np.lexsort((tag, doc))
    rank = np.empty(len(doc), np.int64)
    d, g = doc[order], tag[order]
    rank[order] = np.concatenate(([0], np.cumsum((d[1:] != d[:-1]) | (g[1:] != g[:-1]))))
    use = sa[left[sa] >= LENGTH]
    group = np.cumsum(shared[use] < LENGTH)
    where = (rank[piece[use]] << 32) | (lo[piece[use]] + offset[use])
    nothing = np.zeros(0, np.int64)
    if not len(use):
        return (nothing,) * 3, (nothing,) * 4
    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.repeat(np.minimum.reduceat(where, cut), np.diff(np.concatenate((cut, [len(use)]))))
    repeat = np.zeros(len(text), bool)
    repeat[use] = where > least
    at = np.flatnonzero(repeat)
    marks = (nothing,) * 3
    if len(at):
        head = np.concatenate(([True], (at[1:] != at[:-1] + 1)))
        first, last = at[head], at[np.concatenate((head[1:], [True]))]
        marks = piece[first], lo[piece[first]] + offset[first], lo[piece[last]] + offset[last]
    rest = np.flatnonzero((left[:-1] >= LENGTH) & ~repeat[:-1] & hot[piece]) if hot.any() else at[:0]
    opened = (nothing,) * 4
    if len(rest):
        up, down = _tables(np, len(joined) + 1)
        with np.errstate(over="ignore"):
            both = []
            for salt in (2, 3):
                s = _sums(np, joined, up, salt)
                both.append(_mix(np, (s[rest + LENGTH] - s[rest]) * down[rest]).view(np.int64))
        opened = piece[rest], lo[piece[rest]] + offset[rest], *both
    return marks, opened


def _searched(contexts: DataFrame) -> DataFrame:
    def run(shard):
        import numpy as np
        import pyarrow as pa

        doc, tag, lo = (shard.column(c).to_numpy() for c in ("doc", "tag", "lo"))
        hot = np.array(shard.column("hot").to_pylist(), bool)
        (p, a, z), (q, b, *hashes) = search_shard(doc, tag, lo, hot, shard.column("bytes").to_pylist())
        at = np.concatenate((p, q)).astype(np.int64)
        none = pa.nulls(len(p), pa.int64())
        cols = [pa.array(doc[at]), pa.array(tag[at]), *(pa.array(np.concatenate(c).astype(np.int64)) for c in ((a, b), (z, b))), *(pa.concat_arrays([none, pa.array(h, pa.int64())]) for h in hashes)]
        return pa.table(cols, names=["doc", "tag", "lo", "hi", "h1", "h2"])

    return contexts.groupBy("shard").applyInArrow(run, "doc long, tag long, lo long, hi long, h1 long, h2 long")


def repeats(docs: DataFrame) -> DataFrame:
    """docs(doc, tag, text) -> (doc, tag, lo, hi): runs of starts whose LENGTH-byte string also
    starts earlier anywhere in the table.

    1. Every string belongs to its anchor; anchors meet by hash, those that very many rows share also by
       their surroundings, so that no task holds such a group. An occurrence whose whole
       surroundings (told apart by 128 bits) have an earlier equal is done: all its strings repeat.
    2. Of each distinct surroundings of an anchor only the first occurrence is left. Where an
       anchor has several, their texts go to the anchor's shard, whose suffix array (induced
       sorting) and permuted common prefixes find the strings that repeat there.
    3. Anchors with more than HOT distinct surroundings are spread over several shards; the
       strings that are first in their shard meet once more by hash.
    """
    share = min(1.0, HEAVY_SAMPLE / max(1, docs.count()))
    heavy = written(_anchor_rows(docs.sample(share, seed=1)).where("not sure").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HEAVY).select("key", F.lit(True).alias("heavy")), "suffix-heavy")
    # the sample has some 60 anchors a document, so at most 60 * HEAVY_SAMPLE / HEAVY keys
    rows = (_anchor_rows(docs).join(F.broadcast(heavy), "key", "left")
            .withColumn("deal", F.when(F.col("heavy"), F.col("around")).otherwise(0)).repartition("key", "deal"))  # one exchange for all windows
    alike = Window.partitionBy("key", "deal", "around", "around2").orderBy("doc", "tag", "at")
    marked = rows.withColumn("first", (F.rank().over(alike) == 1) & (F.row_number().over(alike) == 1))
    # rank 1 twice means rows of one document: the same place, listed once
    marked = marked.withColumn("n", F.sum(F.col("first").cast("long")).over(Window.partitionBy("key", "deal")))
    kept = marked.withColumn("again", F.rank().over(alike) > 1).where("sure or again or (first and (n > 1 or heavy))")
    found = written(kept.select("key", "doc", "tag", *_spans(), (F.col("sure") | F.col("again")).alias("repeat"), "n", "heavy"), "suffix-anchors")
    whole = written(found.where("heavy and not repeat").groupBy("key").agg(F.count("*").alias("all")), "suffix-heavy-n")
    asked = found.where("not repeat").join(F.broadcast(whole), "key", "left").withColumn("n", F.coalesce("all", "n"))  # at most the heavy keys
    total = found.where("not repeat").count()
    shards = max(1, -(-total // SHARD))
    parts = F.ceil(F.col("n") / HOT)
    salt = F.when(F.col("n") > HOT, F.pmod(F.xxhash64("doc", "lo"), parts)).otherwise(F.lit(0))
    dealt = asked.select("doc", "tag", "lo", "hi", F.pmod(F.xxhash64("key", salt), F.lit(shards)).alias("shard"), (F.col("n") > HOT).alias("hot"))
    searched = written(_searched(_contexts(dealt, docs)), "suffix-searched")
    same = Window.partitionBy("h1", "h2").orderBy("doc", "tag", "lo")
    late = searched.where("h1 is not null").withColumn("r", F.rank().over(same)).where("r > 1")
    out = found.where("repeat").select("doc", "tag", "lo", "hi")
    return out.unionAll(searched.where("h1 is null").select("doc", "tag", "lo", "hi")).unionAll(late.select("doc", "tag", "lo", "hi"))


def removal(n: int, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte spans covered by the strings that start in the runs (first, last)."""
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + LENGTH)
        else:
            out.append([lo, hi + LENGTH])
    return [(a, min(b, n)) for a, b in out]


def whole_chars(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the characters of which they hold only some bytes."""
    part = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    out = []
    for a, z in spans:
        while part(a):
            a += 1
        while part(z) and z > a:
            z -= 1
        if a < z:
            out.append((a, z))
    return out


def dedup(docs: DataFrame, keep: list[str] = (), chars: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (removed byte ranges), kept (binary), and
    the columns of keep. With chars, spans leave characters whole and kept is valid UTF-8.

    Null and short texts lose nothing. Rows of one doc_id with different texts are different
    documents, ordered by a hash of the text; rows alike in both are one document and get the
    same result; a null doc_id comes before all others. Other columns pass untouched.
    """
    doc, tag, text = _doc(docs)
    runs = repeats(docs.select(doc, tag, text)).groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    rows = docs.select(doc, tag, text, *(F.col(c).alias(f"_{c}") for c in keep))
    kinds = dict(docs.dtypes)

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            sizes, spans, kept = [], [], []
            for t, r in zip(b.column("text"), b.column("runs")):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                gone = removal(len(raw), [(x["lo"], x["hi"]) for x in r.as_py() or []])
                gone = whole_chars(raw, gone) if chars else gone
                at, parts = 0, []
                for a, z in gone:
                    parts.append(raw[at:a])
                    at = z
                parts.append(raw[at:])
                sizes.append(len(raw))
                spans.append([{"start": a, "end": z} for a, z in gone])
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), *(b.column(f"_{c}") for c in keep)], names=["doc", "n_bytes", "spans", "kept", *keep])

    done = (rows.join(runs.hint("shuffle_merge"), ["doc", "tag"], "left")
            .mapInArrow(run, "doc long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary" + "".join(f", {c} {kinds[c]}" for c in keep)))
    return done.withColumn("doc_id", F.when(F.col("doc") != _LOW, F.col("doc"))).drop("doc")
