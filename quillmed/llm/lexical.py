"""Ranked lexical search by presence masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .words import item_blocks, split_words

#: Documents whose masks are grouped together.
CHUNK = 4096


def _postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the whole text), terms (indexes of the vocabulary, ascending) and tfs (occurrences), a row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # made of one block of items

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(shared.value, pa.binary())
        for b in batches:
            words, rows, _, _ = split_words(b.column("text"))
            term = pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False)
            n = np.bincount(rows, minlength=len(b))
            held = term >= 0
            pair, tf = np.unique(rows[held] * max(1, len(known)) + term[held], return_counts=True)
            at = pa.array(np.searchsorted(pair, np.arange(len(b) + 1) * max(1, len(known))).astype(np.int32))
            lists = (pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (pair % max(1, len(known)), tf))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def group_masks(np, present):
    """present: (terms, documents) of 0 and 1. The distinct masks of matched terms, as (masks, terms), and which of them each document has.
    Bits of eight terms go into a byte and eight bytes into a word; words are folded into one number each, exactly."""
    packed = np.packbits(present, axis=0)
    words = np.zeros((-(-len(packed) // 8) * 8, packed.shape[1]), np.uint8)
    words[:len(packed)] = packed
    words = np.ascontiguousarray(words.reshape(-1, 8, packed.shape[1]).transpose(0, 2, 1)).view(np.uint64)[:, :, 0]
    which = np.zeros(present.shape[1], np.int64)
    for w in words:
        _, own = np.unique(w, return_inverse=True)
        _, which = np.unique(which * (int(own.max(initial=0)) + 1) + own, return_inverse=True)
    first = np.zeros(int(which.max(initial=-1)) + 1, np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    return present[:, first].T, which


def search_chunk(np, items, doc, terms, worth, floors, k):
    """Offers (item, document, score) of one chunk that reach their item's floor, at most what is evaluated before it is safe to stop.

    doc, terms, worth: a posting's document (ascending, from 0), its term and what the term adds to the document's score. items: arrays of terms.
    floors[i]: a score that item i's k-th best is known to reach. A mask's greatest score is the sum of the greatest worths
    that its terms have in the chunk. Masks are evaluated by descending greatest score until none can reach the floor."""
    n_docs, n_terms = int(doc[-1]) + 1, max(int(terms.max()), max((int(t[-1]) for t in items if len(t)), default=0)) + 1
    best = np.zeros(n_terms, np.int64)
    np.maximum.at(best, terms, worth)
    bits = np.zeros((n_terms, -(-n_docs // 8)), np.uint8)  # a bitmap of documents for each term
    np.bitwise_or.at(bits, (terms, doc >> 3), (128 >> (doc & 7)).astype(np.uint8))
    begin = np.searchsorted(doc, np.arange(n_docs + 1))
    wanted = np.zeros(n_terms, bool)
    for i, own in enumerate(items):
        own = own[best[own] > 0]
        if not len(own):
            continue
        masks, which = group_masks(np, np.unpackbits(bits[own], axis=1, count=n_docs))
        greatest = masks.astype(np.int64) @ best[own]
        order = np.argsort(-greatest, kind="stable")
        members, sizes = np.argsort(which, kind="stable"), np.bincount(which, minlength=len(masks))
        start = np.cumsum(sizes) - sizes
        wanted[own] = True
        floor, kept, at, step = max(1, floors[i]), np.zeros(0, np.int64), 0, k
        while at < len(order) and greatest[order[at]] >= floor:
            upto = at + int(np.searchsorted(np.cumsum(sizes[order[at:]]), step)) + 1
            upto = max(at + 1, min(upto, at + int(np.count_nonzero(greatest[order[at:upto]] >= floor))))
            found = np.concatenate([members[start[g]:start[g] + sizes[g]] for g in order[at:upto]])
            lens = begin[found + 1] - begin[found]
            posting = np.repeat(begin[found] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            use = wanted[terms[posting]]
            score = np.zeros(len(found), np.int64)
            np.add.at(score, np.repeat(np.arange(len(found)), lens)[use], worth[posting[use]])
            good = score >= floor
            yield i, found[good], score[good]
            kept = np.sort(np.concatenate((kept, score[good])))[::-1][:k]
            if len(kept) == k:
                floor = max(floor, int(kept[-1]))
            at, step = upto, step * 2
        wanted[own] = False


def _best(postings: DataFrame, items: list, weights: list[int], n_docs: int, n_all: int, k: int) -> DataFrame:
    """Each task's k best documents of each item: item (its place in items), doc_id, score."""
    shared = postings.sparkSession.sparkContext.broadcast(([sorted(t) for t in items], weights))  # made of one block of items

    def search(batches):
        import numpy as np
        import pyarrow as pa

        own, w = [np.array(t, np.int64) for t in shared.value[0]], np.array(shared.value[1], np.int64)
        floors = [0] * len(own)
        heaps: list[list] = [[] for _ in own]
        for b in batches:
            for at in range(0, len(b), CHUNK):
                part = b.slice(at, CHUNK)
                lists = part.column("terms")
                doc = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                if not len(doc):
                    continue
                terms = lists.flatten().to_numpy().astype(np.int64)
                tf = part.column("tfs").flatten().to_numpy().astype(np.int64)
                m = 10 + 90 * part.column("n").to_numpy() * n_docs // n_all
                worth = w[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                ids = part.column("doc_id").to_pylist()
                for i, found, score in search_chunk(np, own, doc, terms, worth, floors, k):
                    heaps[i] += [(-s, ids[d] is None, ids[d] or 0) for d, s in zip(found.tolist(), score.tolist())]
                    heaps[i] = sorted(heaps[i])[:k]
                    if len(heaps[i]) == k:
                        floors[i] = -heaps[i][-1][0]
        rows = [(i, None if none else d, -s) for i, h in enumerate(heaps) for s, none, d in h]
        yield pa.RecordBatch.from_pydict({"item": pa.array([r[0] for r in rows], pa.int32()), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.int64())})

    return postings.select("doc_id", "n", "terms", "tfs").mapInArrow(search, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of docs(doc_id, text) that score best for each of items(item_id, text).

    Terms are ASCII letters (A-Z lower-cased), digits and all characters beyond ASCII, in maximal runs of the whole text. With N documents that have
    terms, L terms in all, n terms in a document, df documents with a term and tf occurrences: a term weighs floor(1000 ln((2N + 2) / (2 df + 1))), and adds
    weight * (10^9 tf div (1000 tf + 8 (10 + 90 n N div L))). A document is one row, whatever its doc_id: rows of one doc_id rank side by side. Equal scores go by doc_id,
    null last. Rows that share an item_id are one item with the terms of all of them, null being an id like any other. Null and empty texts have no
    terms; items without terms, and those that no document meets, have no rows. Other columns are not looked at, so their names may clash.

    Items come in blocks of bounded bytes, and the documents are read once for each block: terms of the block are counted, then each task groups its documents by
    presence mask in chunks and keeps its k best of each item, so k rows an item and task are shuffled.
    """
    spark, found = docs.sparkSession, []
    for block in item_blocks(items):
        terms_of: dict = {}
        for i, words in block:
            terms_of.setdefault(i, set()).update(words)
        vocabulary = sorted(set().union(*terms_of.values()))
        if not vocabulary:
            continue
        postings = written(_postings(docs, vocabulary), "lexical-postings")
        n_docs, n_all = postings.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        held = postings.select(F.explode_outer("terms").alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
        weight = held.select("term", F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1))).alias("w"))
        w = {r["term"]: r["w"] for r in weight.toLocalIterator()}  # a row for each term of the block at most
        place = {t: j for j, t in enumerate(vocabulary)}
        ids = list(terms_of)
        best = _best(postings, [[place[t] for t in terms_of[i]] for i in ids], [w.get(j, 0) for j in range(len(vocabulary))], n_docs, n_all, k)
        names = F.broadcast(spark.createDataFrame([(j, i) for j, i in enumerate(ids)], "item int, item_id long"))  # the items of one block
        found.append(best.join(names, "item").select("item_id", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return reduce(DataFrame.unionAll, found).withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
