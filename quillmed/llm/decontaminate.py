"""Benchmark decontamination by a broadcast set of hashed test n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import BLOCK_BYTES, item_blocks, split_words

#: Words of a window.
WINDOW = 10
#: Odd multiplier of the windows' rolling hash, and bits of the table that is asked first.
FACTOR, FILTER_BITS = 0x9E3779B97F4A7C15, 20


class Windows:
    """The windows of a block of items: words as numbers, and for each length the sorted hashes, the windows' words and
    the items of each window. Made on the driver, of the size of the block, and broadcast."""

    def __init__(self, block: list, n: int):
        import numpy as np

        found: dict[tuple, set] = {}
        for item, words in block:
            k = min(n, len(words))
            for at in range(len(words) - k + 1 if k else 0):
                found.setdefault(tuple(words[at:at + k]), set()).add(item)
        self.vocabulary = sorted({w for window in found for w in window})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.by_length = []
        for k in sorted({len(w) for w in found}):
            own = [w for w in found if len(w) == k]
            words = np.array([[number[x] for x in w] for w in own], np.int64)
            keys = window_hash(np, words.ravel(), np.arange(len(own)) * k, k)
            order = np.argsort(keys, kind="stable")
            keys, words = keys[order], words[order]
            table = np.zeros(1 << FILTER_BITS, bool)
            table[keys >> np.uint64(64 - FILTER_BITS)] = True
            items = [sorted(i for i in found[own[j]] if i is not None) for j in order.tolist()]
            ends = np.cumsum([0, *map(len, items)])
            self.by_length.append((k, keys, words, table, ends, np.array([i for x in items for i in x], np.int64)))


def window_hash(np, numbers, at, k):
    """A 64-bit hash of the k word numbers from each position of at."""
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = (h + numbers[at + j].astype(np.uint64) + np.uint64(1)) * np.uint64(FACTOR)
        h ^= h >> np.uint64(29)
    return h


def _ranges(np, begin, end):
    """All numbers of the ranges begin..end, and which range each comes from."""
    n = end - begin
    which = np.repeat(np.arange(len(begin)), n)
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum())), which


def find(np, pc, pa, windows: Windows, vocabulary, words, rows):
    """Whether each word is hit, and the (row, item) pairs of occurring windows, distinct. A hash only proposes a window; its words decide."""
    number = pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    unknown = np.concatenate(([0], np.cumsum(number < 0)))
    cover, pairs = np.zeros(len(number) + 1, np.int64), []
    for k, keys, own, table, ends, items in windows.by_length:
        last = len(number) - k + 1
        if last <= 0:
            continue
        at = np.flatnonzero((unknown[k:] == unknown[:last]) & (rows[k - 1:] == rows[:last]))
        h = window_hash(np, number, at, k)
        near = table[h >> np.uint64(64 - FILTER_BITS)]
        at, h = at[near], h[near]
        window, which = _ranges(np, np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right"))
        at = at[which]
        same = (number[at[:, None] + np.arange(k)] == own[window]).all(axis=1)
        at, window = at[same], window[same]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + k, -1)
        seen = np.unique(np.stack((rows[at], window), axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        item, which = _ranges(np, ends[seen[:, 1]], ends[seen[:, 1] + 1])
        pairs.append(np.stack((seen[which, 0], items[item]), axis=1))
    found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    return np.cumsum(cover[:-1]) > 0, found


def _scan(rows: DataFrame, windows: Windows) -> DataFrame:
    """rows with the hits of one block of items added to n_hit, spans and items."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)  # made of one block of items
    names = rows.columns

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(shared.value.vocabulary, pa.binary())
        for b in batches:
            words, row, start, end = split_words(b.column("_text"))
            hit, found = find(np, pc, pa, shared.value, known, words, row)
            own = {c: b.column(c) for c in names}
            old = own["_spans"]
            if len(old.flatten()):  # of the blocks before
                spans = old.flatten()
                of = np.repeat(np.arange(len(b)), np.diff(old.offsets.to_numpy()))
                size = int(end.max(initial=0)) + 1
                near = np.searchsorted(of * size + spans.field("start").to_numpy(), row * size + start, "right") - 1
                hit |= (near >= 0) & (of[near] == row) & (start < spans.field("end").to_numpy()[near])
            edge = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
            first = hit & (edge | ~np.concatenate(([False], hit[:-1])))
            last = hit & np.concatenate((edge[1:] | ~hit[1:], [True])) if len(row) else hit
            spans = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(end[last])], names=["start", "end"])
            at = np.searchsorted(row[first], np.arange(len(b) + 1)).astype(np.int32)
            old = own["_items"]
            held = np.stack((np.repeat(np.arange(len(b)), np.diff(old.offsets.to_numpy())), old.flatten().to_numpy(zero_copy_only=False)), axis=1)
            found = np.unique(np.concatenate((found, held)), axis=0)
            own |= {"_n_words": pa.array(np.bincount(row, minlength=len(b)).astype(np.int64)), "_n_hit": pa.array(np.bincount(row[hit], minlength=len(b)).astype(np.int64)),
                    "_spans": pa.ListArray.from_arrays(pa.array(at), spans), "_items": pa.ListArray.from_arrays(pa.array(np.searchsorted(found[:, 0], np.arange(len(b) + 1)).astype(np.int32)), pa.array(found[:, 1]))}
            yield pa.RecordBatch.from_arrays([own[c] for c in names], names=names)

    return rows.mapInArrow(scan, rows.schema)


def scan(docs: DataFrame, items: DataFrame, n: int = WINDOW, keep: list[str] = (), most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, n_words, n_hit, spans (byte ranges start, end of maximal runs of hit words), items (ids of items of which a window occurs, each once), and
    the columns of keep, for every row of docs(doc_id, text).

    A window is n consecutive words of an item; an item of fewer words, but not none, is one window. Words are those of split_words, of whole texts.
    A row is a document, whatever its doc_id. Null and empty texts have no words and no hits. An item without id hits words but is not among items. Rows that share an item_id
    are one item with the windows of all. Columns of docs that keep doesn't name go, so clashing names are harmless; a name of keep must not be one of the results'.

    The windows' hashes are broadcast in blocks of bounded bytes of items; where there are several, each block's pass is written for the next.
    Documents are never shuffled.
    """
    rows = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep), F.lit(0).cast("long").alias("_n_words"), F.lit(0).cast("long").alias("_n_hit"),
                       F.array().cast("array<struct<start: bigint, end: bigint>>").alias("_spans"), F.array().cast("array<bigint>").alias("_items"))
    for place, block in enumerate(item_blocks(items, most)):
        rows = _scan(written(rows, "decontaminate") if place else rows, Windows(block, n))
    return rows.select(F.col("_doc").alias("doc_id"), F.col("_text").alias("text"), *(F.col(f"_keep_{c}").alias(c) for c in keep), F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def without_spans(text, spans):
    """The text without the byte ranges of spans. Spans start and end beside ASCII characters or at the text's ends, so no character is cut."""
    data = F.encode(text, "UTF-8")
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
    end = lambda i: F.coalesce(F.get(spans, i)["start"], F.octet_length(text).cast("long"))
    parts = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.decode(F.substring(data, (begin(i) + 1).cast("int"), (end(i) - begin(i)).cast("int")), "UTF-8"))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(parts, ""))


def clean(docs: DataFrame, items: DataFrame, remove: str = "spans", n: int = WINDOW) -> DataFrame:
    """docs without what items contaminate. remove 'documents': rows with a hit go. 'spans': texts lose the byte ranges of hit words, and nothing
    else. Other columns stay as they are."""
    names = docs.columns
    others = [c for c in names if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", *(F.col(c).alias(f"extra{k}") for k, c in enumerate(others)))
    found = scan(plain, items, n, keep=[f"extra{k}" for k in range(len(others))])
    if remove == "documents":
        out = found.where("n_hit = 0")
    elif remove == "spans":
        out = found.withColumn("text", without_spans(F.col("text"), F.col("spans")))
    else:
        raise ValueError("remove is 'spans' or 'documents'")
    return out.select("doc_id", "text", *(F.col(f"extra{k}").alias(c) for k, c in enumerate(others))).select(*names)
