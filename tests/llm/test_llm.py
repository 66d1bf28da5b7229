"""The ten operators against brute force, round trips and held-out rows, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmed.llm import bpe, mixing, quality_cnn, quality_rules, sampling, sharding, simhash, suffix_array, suffix_dedup, token_counts, topk, toxicity
from quillmed.llm import queries as Q


LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(6000))
PASSAGE = "The shared passage runs on for well over one hundred bytes so that every copy of it is found again, café included, to its end."


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "   \n ", "One", "alpha beta gamma delta " * 3, "alpha beta gamma delta " * 3, PASSAGE + " first tail", "Intro words. " + PASSAGE, "xx " + PASSAGE + " yy " + PASSAGE,
             LONG, LONG + " end", "Ünïcödé ẞ words　here", "a" * 300, "# sym * bols $ % | <x>\nline\nline\n\nline two words", "alpha beta gamma delta " * 3]
    rows = [(i, t, ["s1", "s2", None, "s1"][i % 4], 7.0, "clash") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id here at all", None, 1.0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, shard string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(t):
    return (t or "").encode().split()


def test_sharding(docs, none):
    got = sharding.shard(docs, n_shards=3).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 3
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(none).count() == 0


def test_shards_are_even_and_keep_copies_together(spark):
    rows = [(i, f"text number {i} " * (i % 7 + 1)) for i in range(600)] + [(1000 + i, f"copy {i // 5}") for i in range(200)]
    d, cut = spark.createDataFrame(rows, "doc_id long, text string"), {}
    for rounds in (0, 2):  # without propagation rows stay where a hash put them
        load, groups = Counter(), defaultdict(list)
        for r in sharding.shard(d, n_shards=4, rounds=rounds).collect():
            load[r["shard"]] += r["size"]
            if r["doc_id"] >= 1000:
                groups[r["text_crc32"]].append(r["shard"])
        assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 4
        cut[rounds] = sum(a != b for g in groups.values() for i, a in enumerate(g) for b in g[i + 1:])
    assert cut[2] < 0.3 * cut[0]


def brute_quality(t):
    import re

    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i:i + 5])].append(i)
    cover = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(docs, none):
    got = quality_rules.score(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter((r["doc_id"], *brute_quality(r["text"])) for r in docs.collect())
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in got)
    assert quality_rules.score(none).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts_follow_edits(docs, none, tokenizer):
    path, pattern, enc = tokenizer
    edits = [(0, 0, "start "), (5, 9, " café's 12\n"), (40, 700, "x"), (10_000_000, 10_000_001, " end"), (3, 3, None)]
    e = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).cast("string").alias("replacement")) for a, b, c in edits))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in token_counts.recount(token_counts.build(docs, path, pattern, leaf=64).withColumn("e", e), "e", path, pattern, leaf=64).collect():
        t = texts[r["doc_id"]]
        assert r["n_tokens"] == len(enc.encode_ordinary(t))
        for a, b, c in edits:
            a = min(a, len(t))
            t = t[:a] + (c or "") + t[max(a, min(b, len(t))):]
        assert r["edited_tokens"] == len(enc.encode_ordinary(t)) and r["edited_chars"] == len(t)
    assert token_counts.build(none, path, pattern).count() == 0


def test_leaves_are_cut_anew_after_edits(tokenizer):
    _, _, enc = tokenizer
    count = lambda t: len(enc.encode_ordinary(t))
    rng, text = np.random.default_rng(7), "some words of a text that goes on " * 40
    lens = token_counts.leaves(text, 64)
    ends = np.cumsum(lens).tolist()
    tree = token_counts.tree_of([count(text[e - n:e]) for e, n in zip(ends, lens)])
    for k in range(40):
        at = int(rng.integers(0, len(text) + 1))
        new = ["", "x", " more words of another text" * 12, "\n\n"][k % 4]
        text, _ = token_counts.apply_edit(text, lens, tree, at, at + int(rng.integers(0, 200)), new, count, 64)
        assert token_counts.total(tree) == count(text) and sum(lens) == len(text) and len(tree) == 2 * len(lens)
        assert max(lens) < 64 + 64


@pytest.mark.parametrize("repeated", [suffix_array.REPEATED, 0, 1 << 60])  # as shipped, always by recursion, never
def test_suffix_arrays(monkeypatch, repeated):
    monkeypatch.setattr(suffix_array, "REPEATED", repeated)
    rng = np.random.default_rng(1)
    for k in range(120):
        t = np.concatenate((rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(1, 50))) if k % 3 else np.tile(rng.integers(1, 4, 2), 15), [0])).astype(np.uint16)
        assert suffix_array.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def brute_repeats(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = t.encode()
        cov = bytearray(len(b))
        for p in range(len(b) - 99):
            g = b[p:p + 100]
            if g in seen:
                cov[p:p + 100] = b"\1" * 100
            seen.add(g)
        out[d] = bytes(x for x, c in zip(b, cov) if not c)
    return out


def test_suffix_dedup(spark, docs, none, monkeypatch):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = brute_repeats([(r["doc_id"], r["text"] or "") for r in unique.collect()])
    for hot, heavy in ((2048, 16), (1, 16), (2, 1), (2048, 2)):  # a low one spreads anchors over several shards, or deals them by their surroundings
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
        monkeypatch.setattr(suffix_dedup, "SHARD", 8192 if hot > 1 else 3)
        assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.dedup(unique).collect()} == want
    all_rows = suffix_dedup.dedup(docs).collect()
    assert len(all_rows) == docs.count()
    assert len({bytes(r["kept"]) for r in all_rows if r["doc_id"] == 6}) == 1
    assert suffix_dedup.dedup(none).count() == 0
    whole = suffix_dedup.dedup(unique, chars=True).collect()
    assert all(bytes(r["kept"]).decode() is not None for r in whole)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)) * rng.uniform(0.1, 3, size=(300, 1))
    v[10] = v[11] = v[12]
    rows = [(i, [float(x) for x in v[i]], "clash") for i in range(300)] + [(300, None, "x"), (301, [1.0, None, 2.0], "x"), (302, [float("nan")] * 8, "x"), (303, [float("inf")] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, bucket string")
    q = np.floor(256.0 * v.astype(np.float32).astype(np.float64)).astype(np.int64)
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, bucket=40, block=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for i in range(0, 300, 10):
        s = q @ q[i]
        assert got[i] == [(j, int(s[j])) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:5]]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_with_repeated_and_huge_vectors(spark):
    rng = np.random.default_rng(12)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(40)]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (5, rows[5][1]), (10, [3.0, 1.0, 0.0, 0.5]), (60, [1e30, -1e30, 1.0, 2.0]), (61, [1.0, 2.0]), (62, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = sorted({(i, tuple(max(-2**63, min(2**63 - 1, int(np.floor(256.0 * x)))) for x in e)) for i, e in rows})
    for bucket, block in ((4096, 1024), (4, 2)):
        got = defaultdict(list)
        for r in topk.top_k(df, F.col("vec_id") % 10 == 0, bucket=bucket, block=block).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        for q in {i for i, _ in v if i % 10 == 0}:
            want = [(j, max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))) for i, a in v if i == q for j, b in v if j != q and len(a) == len(b)]
            assert got[q] == sorted(want, key=lambda t: (-t[1], t[0]))[:5]


def test_top_k_prunes_before_copying(spark):
    """Short vectors meet no block whose queries need longer ones, and nothing is lost."""
    rng = np.random.default_rng(13)
    v = rng.normal(size=(3000, 8))
    v *= (np.arange(3000)[::-1, None] + 1) ** 2 / 3000 ** 2 / np.linalg.norm(v, axis=1)[:, None] * 4
    df = spark.createDataFrame([(k, [float(x) for x in v[k]]) for k in range(3000)], "vec_id long, embedding array<double>")
    q = np.floor(256.0 * v).astype(np.int64)
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, bucket=100, block=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for i in range(0, 3000, 50):
        s = q @ q[i]
        assert got[i] == [(j, int(s[j])) for j in sorted((j for j in range(3000) if j != i), key=lambda j: (-s[j], j))[:5]]


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    total, by = sum(r["size"] for r in got), defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert Counter(r["size"] for r in got) == Counter(len(words(r["text"])) for r in docs.collect())
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        assert v[0]["target"] <= 2 * v[0]["source_size"] and abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 1
        assert all(r["taken"] == sum(e["words"] for e in r["epochs"] or []) and (r["taken"] == 0) == (r["first_slot"] is None) for r in v)
    assert Counter((r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()) == Counter((r["doc_id"], r["taken"]) for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mix(docs.where("size(split(text, ' ')) < 1")).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixing.mixed(none).count() == 0
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)


def brute_mix(sizes, step):
    """sizes: (source, [sizes in stream order]) -> taken words by source, from the points one by one."""
    total = {s: sum(v) for s, v in sizes.items()}
    target = dict(zip(total, mixing_targets(list(total.values()))))
    n, words_ = sum(map(len, sizes.values())), sum(total.values())
    block = max(1, int(1.5 * words_) // (4 * n))
    slots = max(1, int(1.5 * words_) // block)
    ends, at = [], 0.0
    for s in total:
        at += target[s]
        ends.append((s, round(at / sum(target.values()) * mixing.SPAN)))
    drawn = Counter()
    for t in range(slots):
        point = t * step % mixing.SPAN
        drawn[next(s for s, e in ends if point < e)] += 1
    out = {}
    for s in total:
        have = drawn[s] * block
        out[s] = int(target[s]) if abs(have - int(target[s])) <= mixing.REMAINDER * block else min(have, 2 * total[s])
    return out


def mixing_targets(sizes):
    weights, most = [(5, 2, 1)[k % 3] for k in range(len(sizes))], [2 * x for x in sizes]
    low, high = 0.0, float(sum(most)) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(m, level * w) for m, w in zip(most, weights)) < 1.5 * sum(sizes) else (low, level)
    return [min(m, low * w) for m, w in zip(most, weights)]


def test_the_schedule_decides_the_mix(spark):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 60))), f"s{int(rng.integers(0, 9)) // 2}") for k in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {s: [len(t.split()) for _, t, x in rows if x == s] for s in sorted({s for _, _, s in rows})}
    total = Counter({s: sum(v) for s, v in sizes.items()})
    for step in (mixing.GOLDEN, 1, 3):  # the others spread badly
        got, want = Counter(), brute_mix(sizes, step)
        for r in mixing.mix(d, step=step).collect():
            got[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 2 * r["size"]
        assert all(abs(got[s] - want[s]) <= 1 for s in sizes)
        off = max(abs(got[s] - t) / t for s, t in zip(sizes, mixing_targets(list(total.values()))))
        assert off < 0.01 if step == mixing.GOLDEN else off > 0.2


def test_mixed_rows_follow_the_slots(spark, tmp_path):
    rows = [(k, f"text {k} " * (k % 5 + 1), f"s{k % 3}", k) for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    first = {(r["doc_id"], e["pass"]): e["slot"] for r in mixing.mix(d).collect() for e in r["epochs"] or []}
    at = [r["doc_id"] for r in mixing.mixed(d).collect()]
    seen, slots = Counter(), []
    for i in at:  # a document's passes come in order
        slots.append(first[i, seen[i]])
        seen[i] += 1
    assert slots == sorted(slots) and sum(seen.values()) == len(first)
    assert all(r["slot"] == r["doc_id"] for r in mixing.mixed(d).collect())


def brute_simhash(t):
    import xxhash

    w = (t or "").encode().lower().split()
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in fps}


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).where("doc_id is not null").collect()
    want = {r["doc_id"]: brute_simhash(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in got} == want
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(want)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 6").count() == 1


def test_simhash_links_form_chains(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-2**63, 2**63 - 1, 20)]
    fps = set(base)
    for b in base[:6]:
        x = b
        for k in range(12):
            x ^= 1 << int(rng.integers(0, 63))
            x ^= 1 << int(rng.integers(0, 63))
            fps.add(x)
    table = {i: f for i, f in enumerate(sorted(fps))}
    edges = simhash.links(spark.createDataFrame([(f,) for f in table.values()], "fp long"))
    assert all(bin((r["u"] ^ r["v"]) & (2**64 - 1)).count("1") <= 2 for r in edges.collect())
    roots = {r["node"]: r["root"] for r in simhash.connected_components(edges).collect()}
    want = brute_components({i: f & (2**64 - 1) for i, f in table.items()})
    groups = defaultdict(set)
    for i, f in table.items():
        groups[want[i]].add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def labelled(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")


def test_quality_cnn_held_out(spark, docs, none):
    d, y = labelled(spark, "/root/testdata/sf0.01")
    got = {r["doc_id"]: r for r in quality_cnn.score(d, y).collect()}
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in y.collect() if got[r["doc_id"]]["held_out"]]
    assert held and sum(a == b for a, b in held) >= 0.9 * len(held)
    assert quality_cnn.score(none, y.limit(0)).count() == 0
    assert all(0 <= r["score"] <= 1 for r in quality_cnn.score(docs, y.limit(0)).collect())


def test_toxicity_held_out(spark, docs, none):
    d, y = labelled(spark, "/root/testdata/sf0.01")
    got = {r["doc_id"]: r for r in toxicity.score(d, y).collect()}
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in y.collect() if got[r["doc_id"]]["held_out"]]
    assert not any(b for a, b in held if not a) and sum(b for a, b in held if a) >= 0.75 * sum(a for a, _ in held)
    rows = toxicity.score(docs, y.limit(0)).collect()
    assert len(rows) == docs.count() and not any(r["predicted"] for r in rows)
    assert toxicity.score(none, y).count() == 0


def test_maximal_segments_match_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        x = [float(v) if v > 0 else -1.0 for v in rng.integers(-3, 4, 14)]
        got = toxicity.segments({i: v for i, v in enumerate(x) if v > 0}, -1.0)
        best = max((sum(x[a:b]) for a in range(14) for b in range(a + 1, 15)), default=0)
        assert (max((s for _, _, s in got), default=0) == pytest.approx(max(best, 0))) and all(s == pytest.approx(sum(x[a:b])) for a, b, s in got)


def test_bpe(docs, none, tokenizer):
    path, pattern, enc = tokenizer
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in bpe.encode(docs, path, pattern, keep=["score"]).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode()
    assert bpe.encode(none, path, pattern).count() == 0


def test_long_words_merge_in_n_log_n(spark, tokenizer):
    path, pattern, enc = tokenizer
    rng = np.random.default_rng(14)
    letters = lambda n: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, n))
    texts = [letters(200_000), "a" * 70_000, letters(65), letters(64), letters(70) + " " + letters(70), "ü" * 500 + " x", "!" * 3000 + letters(100)]
    ranks = {p: r for r, p in enumerate(bpe.Vocabulary(spark, path).pieces) if p}
    for t in texts[2:]:
        assert [i for w in t.split(" ") for i in bpe.merge_by_heap(w.encode(), ranks)] == [i for w in t.split(" ") for i in enc._encode_single_piece(w)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(d, path, pattern).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and bytes(r["decoded"]) == texts[r["doc_id"]].encode()


def test_lone_hits_stay_apart_however_many():
    n = 100_000
    found = toxicity.segments({10 * k: 1.0 + k % 3 for k in range(n)}, -0.5)
    assert found == [(10 * k, 10 * k + 1, pytest.approx(1.0 + k % 3)) for k in range(n)]


def test_queries_are_registered():
    names = set(Q.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}


def test_pipeline_keeps_all_columns_and_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline as cp

    clash = ["score", "passages", "kept", "spans", "n_bytes", "doc", "_hash", "row", "th", "tag", "slot", "evidence"]
    d = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    d = d.select("*", *(F.concat(F.lit(c + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in clash))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (d, d.limit(0)):
        now = cp.written(start, "odd")
        for name, stage in cp.STAGES[:4]:
            now = cp.written(stage(spark, now, str(tmp_path)), f"odd-{name}")
            assert now.dtypes == start.dtypes
            assert all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in now.collect() for c in clash)
        left = now.collect()
        out = cp.STAGES[4][1](spark, now, str(tmp_path)).collect()
        assert len(out) == len(left) and (len(left) > 0) == (start is d)


def test_pipeline_catches_planted_cases(spark, small, tmp_path):
    import corpus_pipeline as cp

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = d.orderBy("doc_id").first()
    bad = "you stupid idiot loser scum moron pathetic worthless clown trash disgusting " * 4
    plant = spark.createDataFrame([(900001, first["text"], "en", "src0", 1), (900002, bad + first["text"][:400], "en", "src1", 1)], d.schema)
    y = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    y.write.parquet(str(tmp_path / "labels.parquet"))
    d.unionByName(plant).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES[:4]:
        docs = cp.written(stage(spark, docs, str(tmp_path)), f"test-{name}")
        assert docs.columns == d.columns
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert 900002 not in seen["toxicity"] and 900001 in seen["toxicity"] and 900001 not in seen["simhash_near_dedup"]
    assert first["doc_id"] in seen["mixing"]
    import hashlib

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = Counter((r["doc_id"], bytes(r["ids"]), r["decoded_sha256"]) for r in cp.STAGES[4][1](spark, docs, str(tmp_path)).collect())
    ids = lambda t: enc.encode_ordinary(t)
    assert coded == Counter((r["doc_id"], struct.pack(f"<{len(ids(r['text']))}I", *ids(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in docs.collect())


def test_samples_are_bounded_by_rows(spark):
    d = spark.createDataFrame([(k % 4, f"text {k}") for k in range(100)], "doc_id long, text string")
    y = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    for n, want in ((1, 2), (5, 3)):
        got = sampling.sample(d, y, "toxic", F.lit(True), n).collect()
        assert len(got) == want and all(r["text"] == min(f"text {k}" for k in range(r["doc_id"], 100, 4)) for r in got)
    assert {r["doc_id"] for r in sampling.sample(d, y, "toxic", F.lit(True), 5).collect()} == {0, 1, 3}


def test_extreme_value_law_is_the_likelihood_estimate(spark):
    rng = np.random.default_rng(8)
    model = toxicity.Model(weights={b"bad": 1.0}, other=-0.5)
    texts = ["x " * int(n) + "bad " * int(k) for n, k in zip(rng.integers(10, 200, 300), np.maximum(0, rng.gumbel(0, 2, 300).round()))]
    lam, k = toxicity.extreme_value_law(spark.createDataFrame([(t,) for t in texts], "text string"), model)
    n, s = np.array([len(t.split()) for t in texts], float), np.array([t.count("bad") for t in texts], float)
    def likelihood(lam, k):
        return (s > 0).sum() * np.log(k * lam) - lam * s[s > 0].sum() - k * (n * np.exp(-lam * s)).sum()
    assert all(likelihood(lam, k) >= likelihood(lam * a, k * b) - 1e-2 for a in (0.9, 1, 1.1) for b in (0.9, 1, 1.1))
    assert toxicity.extreme_value_law(spark.createDataFrame([("x y",)], "text string"), model) == (1.0, 0.25)


def test_quality_forward_pass_matches_brute_force():
    rng = np.random.default_rng(9)
    C = quality_cnn
    net = C.Net(rng.normal(size=(256, C.DIM)).astype(np.float32), rng.normal(size=(C.WIDTH * C.DIM, C.FILTERS)).astype(np.float32), rng.normal(size=C.FILTERS).astype(np.float32), rng.normal(size=C.FILTERS).astype(np.float32), 0.3)
    net.embed[0] = 0
    texts = [b"", b"short", bytes(rng.integers(32, 126, 700, dtype=np.uint8)), bytes(rng.integers(32, 126, 256, dtype=np.uint8))]
    for t, got in zip(texts, C.features(net, texts)):
        hops = -(-(len(t) + C.WIDTH) // C.HOP)
        padded = t + bytes(hops * C.HOP + C.WIDTH - len(t))
        pooled = []
        for h in range(hops):
            best = np.zeros(C.FILTERS)
            for at in range(h * C.HOP, (h + 1) * C.HOP, C.STRIDE):
                if at < max(1, len(t)):
                    x = np.concatenate([net.embed[b] for b in padded[at:at + C.WIDTH]])
                    best = np.maximum(best, x @ net.conv + net.bias)
            pooled.append(best)
        z = [np.maximum(pooled[h], pooled[min(h + 1, hops - 1)]) @ net.out + net.shift for h in range(hops)]
        assert got == pytest.approx([np.mean(z), max(z), min(z)], rel=1e-3, abs=1e-3)


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    from quillmed.llm import store

    monkeypatch.setattr(store, "LEAST_HOT", 10)
    rows = spark.createDataFrame([(k % 3 and k, k) for k in range(300)], "fp long, n long")
    small = rows.select("fp").distinct().withColumn("name", F.col("fp") * 2)
    hot = store.hot_keys(rows.groupBy("fp").agg(F.count("*").alias("n")), "fp", 300)
    assert [(r["fp"], r["_parts"]) for r in hot.collect()] == [(0, 10)]
    for how in ("inner", "left"):
        got = store.spread_join(rows, small.where("fp <> 4"), "fp", hot, how).collect()
        assert Counter((r["fp"], r["n"], r["name"]) for r in got) == Counter((k % 3 and k, k, None if (k % 3 and k) == 4 else 2 * (k % 3 and k)) for k in range(300) if how == "left" or k != 4)
    copies = spark.createDataFrame([(k, "same text" if k % 3 else f"text {k}") for k in range(300)], "doc_id long, text string")
    got = sharding.shard(copies, n_shards=4).collect()
    assert len(got) == 300 and {r["doc_id"] for r in got} == set(range(300))
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(copies).collect()}[2] == 1
