"""The pipeline's near-duplicate stage against all pairs."""

import random

import corpus_pipeline as cp
from quillmed.llm import near_copies, simhash


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts, least=0.8):
    sets, root = list(map(shingles, texts)), list(range(len(texts)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def edited_copies():
    rng, texts = random.Random(5), ["", "  ", "two words", "two words"]
    for n in (20, 60, 100, 200, 400):
        for _ in range(12):
            t = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(t))
            for edits in (1, 1, 2, n // 50 + 1, n // 25 + 1, n // 10):
                c = list(t)
                for at in rng.sample(range(n), min(edits, n)):
                    c[at] = "new"
                texts.append(" ".join(c))
    base = [f"b{k}" for k in range(300)]
    for _ in range(150):  # one large group
        c = list(base)
        for at in rng.sample(range(300), 3):
            c[at] = f"x{rng.randrange(99)}"
        texts.append(" ".join(c))
    return texts


def test_stage_keeps_one_of_each_group_of_edited_copies(spark):
    texts = edited_copies()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in cp.one_of_each_group(spark, docs, None).collect()]
    assert sorted(kept) == sorted(set(brute_groups(texts)))
    assert cp.one_of_each_group(spark, docs.limit(0), None).count() == 0


def test_representatives_are_rows_not_ids(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, b), (2, a), (2, c), (2, c), (None, d), (None, d), (None, b), (None, None), (7, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([(1, a), (1, b), (2, c), (7, " "), (-1, d)])
    for found in (cp.one_of_each_group(spark, docs, None), simhash.representatives(docs)):
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in found.collect()) == want


def templates():
    """Texts of one template, all just below the similarity, and 60 pairs just above it among them."""
    base = [f"t{k}" for k in range(200)]
    return [" ".join(base + [f"o{k}.{i}" for i in range(9)] + [f"e{k}.{far}.{i}" for i in range(21)]) for k in range(60) for far in (0, 1)]


def test_no_pair_of_texts_alike_is_left_out(spark):
    texts = templates()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in cp.one_of_each_group(spark, docs, None).collect()]
    assert sorted(kept) == sorted(set(brute_groups(texts)))


def test_prefixes_find_all_pairs_in_blocks_of_any_size(spark):
    import numpy as np
    import xxhash

    texts = list(dict.fromkeys(edited_copies()[4:] + templates()))
    sets = [near_copies._shingles(t, 5, xxhash.xxh64_intdigest, np) for t in texts]
    alike = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(c := np.intersect1d(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(c)) - 1e-9}
    docs = spark.createDataFrame(list(enumerate(texts)), "set long, text string")
    common = near_copies.common_shingles(docs.selectExpr("set as th", "text"), 5)
    assert len(common[0])
    for order in (common, (np.array([], np.uint64), np.array([], np.int64))):
        first = near_copies.prefixes(docs, 5, 0.8, order).selectExpr("*", "set as root")
        for block in (7, 1000):
            assert alike <= {(r["u"], r["v"]) for r in near_copies.prefix_candidates(first, 0.8, block).collect()}
