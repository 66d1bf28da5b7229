"""Lexical search, decontamination and tokenizer alignment against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmed.llm import alignment, decontaminate, lexical, words

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(6000))
ITEM = "The quick brown fox jumps over the lazy dog and then it rests a while in the sun"
TEXTS = [None, "", "  \n.", "One", "alpha beta gamma, DELTA " * 3, "alpha beta gamma, DELTA " * 3, f"intro {ITEM.upper()} outro", f"x {ITEM} y {ITEM}. z", "the quick brown fox jumps over the lazy dog", LONG, LONG + " " + ITEM, "Ünïcödé ẞ wörds　here ünïcödé",
         "short item", "a short item here", "fox " * 50, "it rests a while in the sun and more and then it rests a while in the sun and more"]
ITEMS = [(1, ITEM), (2, "Short, item"), (3, None), (4, ""), (5, "ünïcödé ẞ WÖRDS　here"), (6, "it rests a while in the sun and more and then"), (None, "alpha beta"), (7, "nothing of this occurs"), (2, "One"), (1, ITEM), (10, "fox")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", 1.5, "clash", 7) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "s", 1.5, "clash", 7), (None, ITEM, None, 0.0, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, rank string, n_words int").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def split(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(docs, items, k):
    own = [(d, split(t)) for d, t in docs if split(t)]
    n, total = len(own), sum(len(t) for _, t in own)
    df = Counter(x for _, t in own for x in set(t))
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(split(t)) if t else set()
    out = []
    for i, asked in terms.items():
        scored = []
        for d, t in own:
            tf, m = Counter(t), 10 + 90 * len(t) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in asked if tf[x])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_equals_brute_force(docs, items, k):
    got = lexical.search(docs, items, k).collect()
    assert Counter(map(tuple, got)) == brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS, k)


def test_search_without_rows(docs, items):
    assert lexical.search(docs.limit(0), items).count() == 0 == lexical.search(docs, items.limit(0)).count()
    assert lexical.search(docs.where("text = ''"), items).count() == 0


def test_search_in_blocks_of_items(docs, items, monkeypatch):
    whole = Counter(map(tuple, lexical.search(docs, items).collect()))
    monkeypatch.setattr(lexical, "item_blocks", lambda d: words.item_blocks(d, 60))
    assert Counter(map(tuple, lexical.search(docs, items).collect())) == whole


def test_masks_and_safe_stop():
    rng = np.random.default_rng(3)
    for m in (1, 7, 9, 70):
        present = (rng.random((m, 300)) < 0.3).astype(np.uint8)
        masks, which = lexical.group_masks(np, present)
        assert (masks[which] == present.T).all() and len({tuple(x) for x in masks.tolist()}) == len(masks)
    held = rng.random((2000, 40)) < np.linspace(0.02, 0.5, 40)
    doc, terms = np.nonzero(held)
    worth = rng.integers(1, 50, len(doc)) * (41 - terms)
    own = [np.arange(40), np.arange(0, 40, 3), np.array([39])]
    offers = list(lexical.search_chunk(np, own, doc, terms, worth, [0, 0, 0], 5))
    for i, t in enumerate(own):
        score = np.zeros(2000, np.int64)
        use = np.isin(terms, t)
        np.add.at(score, doc[use], worth[use])
        got = sorted((s for j, _, found in offers if j == i for s in found.tolist()), reverse=True)[:5]
        assert got == sorted(score.tolist(), reverse=True)[:5]
        assert all(score[d] == s for j, at, found in offers if j == i for d, s in zip(at.tolist(), found.tolist()))
    assert sum(len(at) for j, at, _ in offers if j == 0) < 1000  # most masks are never evaluated


def brute_hits(text, items, n=10):
    own, hit, found = split(text), set(), set()
    for i, t in items:
        asked = split(t) if t else []
        k = min(n, len(asked))
        windows = {tuple(asked[j:j + k]) for j in range(len(asked) - k + 1)} if k else set()
        for at in range(len(own) - k + 1 if k else 0):
            if tuple(own[at:at + k]) in windows:
                hit |= set(range(at, at + k))
                found |= {i} - {None}
    return len(own), len(hit), frozenset(found)


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_decontamination_equals_brute_force(docs, items, most):
    got = decontaminate.scan(docs, items, keep=["source"], most=most).collect()
    want = Counter((r["doc_id"], r["source"], *brute_hits(r["text"], ITEMS)) for r in docs.collect())
    assert Counter((r["doc_id"], r["source"], r["n_words"], r["n_hit"], frozenset(r["items"])) for r in got) == want
    for r in got:
        assert len(set(r["items"])) == len(r["items"])
        inside = [split((r["text"] or "").encode()[a:b].decode()) for a, b in r["spans"]]
        assert sum(map(len, inside)) == r["n_hit"]
    assert decontaminate.scan(docs.limit(0), items).count() == 0
    assert {r["n_hit"] for r in decontaminate.scan(docs, items.limit(0)).collect()} == {0}


def test_hits_are_removed(docs, items):
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = decontaminate.clean(docs, items, "spans")
    assert got.columns == docs.columns and got.count() == docs.count()
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert by[6] == "intro  outro" and by[7] == "x  y . z" and by[8] == "the quick brown  jumps over the lazy dog" and by[4] == whole[4].replace("alpha beta", "") and by[0] is None and by[9] == LONG
    left = decontaminate.clean(docs, items, "documents")
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(r["doc_id"] for r in docs.collect() if not brute_hits(r["text"], ITEMS)[1] and r["doc_id"] is not None)


def test_a_hash_only_proposes(monkeypatch):
    import pyarrow as pa
    import pyarrow.compute as pc

    monkeypatch.setattr(decontaminate, "window_hash", lambda np, numbers, at, k: np.full(len(at), 1 << 60, np.uint64))
    w = decontaminate.Windows([(1, [b"a", b"b", b"c"]), (2, [b"c", b"b", b"a"]), (3, [b"b"])], 2)
    text, rows, _, _ = words.split_words(pa.array(["a b a c", "c b"]))
    hit, found = decontaminate.find(np, pc, pa, w, pa.array(w.vocabulary, pa.binary()), text, rows)
    assert hit.tolist() == [True, True, True, False, True, True]
    assert sorted(map(tuple, found.tolist())) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]


ODD = ["", " ", "a ", " a", "a  b", "a\n b \n\n c", "▁x y", "x　 y z", "é   b", "<s> </s> <unk> <|endoftext|> <0x41>", "中文文字没有空格" * 50, "\x01 a\x1c b \x7f c", "don't  we'll 123 456.78 \t x\r\n",
       "😀 😀😀 z", "Привет мир слово", "x" * 5000 + " y", "a  b᠎ c d", " " * 20 + "x" + " " * 20, "﻿a b", "a\u0085 b", None, "some words and some more words", "some words and some more words"]


@pytest.fixture(scope="module")
def paths():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute_align(enc, t):
    full = (" " + t).encode() if t else b""
    a, b = (enc.a.encode(" " + t, add_special_tokens=False).ids, enc.b.encode(t)) if t else ([], [])
    la, lb = [enc.bytes_a[i] for i in a], [enc.bytes_b[i] for i in b]
    if not t or b"".join(la) != full or b"".join(lb) != full:
        return 0, 0, 0, 0, "", Counter()
    ends = lambda x: np.cumsum([len(p) for p in x]).tolist()
    ea, eb = ends(la), ends(lb)
    links = Counter()
    i = j = 0
    while i < len(a) and j < len(b):
        links[a[i], b[j]] += 1
        step_a, step_b = ea[i] <= eb[j], eb[j] <= ea[i]
        i, j = i + step_a, j + step_b
    groups, start = [], 0
    for e in sorted(set(ea) & set(eb)):
        groups.append(",".join(str(x) for x, y in zip(a, ea) if start < y <= e) + "|" + ",".join(str(x) for x, y in zip(b, eb) if start < y <= e))
        start = e
    return len(a), len(b), len(groups), sum(links.values()), ";".join(groups), links


@pytest.mark.parametrize("part, chunk, frequent", [(1 << 16, 1 << 13, 1 << 20), (64, 7, 1 << 20), (40, 5, 3), (200, 1, 0)])
def test_alignment_equals_brute_force(spark, paths, part, chunk, frequent):
    enc = alignment.encoders(*paths)
    rows = list(enumerate(ODD)) + [(5, ODD[5]), (None, "no id"), (100, " ".join(f"word{i} and" for i in range(700)))]
    want = {t: brute_align(enc, t) for _, t in rows}
    counts = Counter(p for _, t in rows for p in want[t][5])
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    extra = lambda links: (sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()))
    d = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, groups string, part int").repartition(3)
    got = alignment.align(d, *paths, part=part, chunk=chunk, frequent=frequent).collect()
    assert Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"], r["n_best"], r["count_sum"]) for r in got) == Counter((i, *want[t][:5], *extra(want[t][5])) for i, t in rows)
    assert alignment.align(d.limit(0), *paths).count() == 0


def test_digest(spark, paths):
    d = spark.createDataFrame([(1, "Hello there  world"), (2, None)], "doc_id long, text string")
    texts, digests = ({r["doc_id"]: r["groups"] for r in alignment.align(d, *paths, texts=x).collect()} for x in (True, False))
    assert digests[1] == hashlib.sha256(texts[1].encode()).hexdigest() and digests[2] == texts[2] == ""


def test_fragments_are_a_monoid(paths):
    enc = alignment.encoders(*paths)
    text = " Unbelievably  intertwined tokenizations, übergroß 中文 and\nmore" * 3
    data = text.encode()
    _, (a, ae, _), (b, be, _) = enc.encode(data, np.array([0, len(data)]))
    edges = np.arange(1, len(data) + 1)
    own = alignment.range_fragments(np, enc.names, edges, a, ae, b, be)
    shown = lambda f: [x.tolist() if hasattr(x, "tolist") else [y.tolist() for y in x] if isinstance(x, tuple) else x for x in f]
    left = right = alignment.identity(np)
    for f in own:
        left = alignment.compose(np, enc.names, left, f)
    for f in reversed(own):
        right = alignment.compose(np, enc.names, f, right)
    assert shown(left) == shown(right) == shown(alignment.tree(np, enc.names, own)) == shown(alignment.range_fragments(np, enc.names, np.array([len(data)]), a, ae, b, be)[0])
    rng = np.random.default_rng(1)
    for _ in range(50):
        i, j, k, m = np.sort(rng.integers(0, len(own) + 1, 4)).tolist()
        x, y, z = (alignment.tree(np, enc.names, own[p:q]) for p, q in ((i, j), (j, k), (k, m)))
        c = lambda p, q: alignment.compose(np, enc.names, p, q)
        assert shown(c(c(x, y), z)) == shown(c(x, c(y, z)))
