"""Cross-tokenizer alignment by an associative monoid of fragments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Bytes of a part, which one task encodes, and of a chunk, which makes one fragment.
PART, CHUNK = 1 << 16, 1 << 13
#: Fragments that one task composes at a time.
FAN = 16
#: Bytes of text whose words are encoded together, and distinct words that a task remembers.
SLICE, REMEMBERED = 1 << 20, 1 << 18
#: Words that are handed to a tokenizer in one run.
RUN = 256
#: Pairs of ids whose counts are broadcast.
FREQUENT = 1 << 20
#: Last bytes of characters beyond ASCII that may be white space.
MAYBE_BLANK = (0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF)


class Fragment(NamedTuple):
    """The alignment of a byte range. Tokens belong to the range that their last byte is in, with the byte offset of their end.

    prefix, suffix: (A ids, A ends, B ids, B ends). If no byte offset of the range ends tokens of both sides, all tokens are in the prefix and closed is False. Else the prefix goes up to the
    first such offset, the suffix begins after the last, and between are closed groups: their text, how many there are, tokens of both sides in them,
    and the id pairs of their links, each once, with how often."""

    closed: bool
    prefix: tuple
    text: bytes
    n_groups: int
    n_a: int
    n_b: int
    pairs: object
    times: object
    suffix: tuple


def _joined(np, x, y):
    return tuple(np.concatenate((a, b)) for a, b in zip(x, y))


def _nothing(np):
    return tuple(np.zeros(0, np.int64) for _ in range(4))


def identity(np) -> Fragment:
    none = np.zeros(0, np.int64)
    return Fragment(False, _nothing(np), b"", 0, 0, 0, none, none, _nothing(np))


class Names:
    """The decimal ids of both sides with each sign that may follow: ',' and then '|' behind the last id of A, ';' behind that of B."""

    def __init__(self, np, n_a: int, n_b: int):
        self.offset, self.n_a, self.n_b = 2 * n_a, n_a, n_b
        self.texts = np.array([b"%d%c" % (i, c) for i in range(n_a) for c in b",|"] + [b"%d%c" % (i, c) for i in range(n_b) for c in b",;"], object)
        self.lens = np.array([len(t) for t in self.texts], np.int64)


def _counted(np, pairs, times):
    """Pairs, each once and ascending, and the sums of their times."""
    own, at = np.unique(pairs, return_inverse=True)
    return own, np.bincount(at, weights=times, minlength=len(own)).astype(np.int64)


def _distinct(np, x):
    """The values of x, ascending, and how often each stands in it."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))
    return x[at], np.diff(at, append=len(x))


def _meet(np, ae, be):
    """For each A token the B token that its last byte lies in and whether both end there, and the same for each B token."""
    with_b = np.searchsorted(be, ae)
    last_a = be[np.minimum(with_b, len(be) - 1)] == ae if len(be) else np.zeros(len(ae), bool)
    last_b = np.zeros(len(be), bool)
    last_b[with_b[last_a]] = True
    return with_b, last_a, np.searchsorted(ae, be), last_b


def _order(np, names: Names, a, last_a, group_a, b, last_b, group_b, n):
    """Places of names.texts in the order of the n groups: a group's A tokens, then its B tokens."""
    upto_a, n_b = np.cumsum(np.bincount(group_a, minlength=n)), np.bincount(group_b, minlength=n)
    order = np.zeros(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]] = 2 * a + last_a
    order[np.arange(len(b)) + upto_a[group_b]] = names.offset + 2 * b + last_b
    return order


def _groups(np, last):
    return np.cumsum(last) - last


def _close(np, names: Names, a, ae, b, be):
    """Text, number and links of the groups of a run that begins and ends at a common offset. Each offset where a token ends
    is the end of one link, of the tokens of either side that its byte lies in."""
    with_b, last_a, with_a, last_b = _meet(np, ae, be)
    n = int(last_a.sum())
    order = _order(np, names, a, last_a, _groups(np, last_a), b, last_b, _groups(np, last_b), n)
    own = ~last_b
    pairs = np.concatenate(((a << 32) | b[with_b], (a[with_a[own]] << 32) | b[own]))
    return b"".join(names.texts[order].tolist()), n, *_distinct(np, pairs)


def range_fragments(np, names: Names, edges, a, ae, b, be) -> list[Fragment]:
    """A fragment for each byte range that ends at an offset of edges (ascending), given the tokens of all ranges in order. A range's fragment rests on its own tokens alone."""
    with_b, last_a, with_a, last_b = _meet(np, ae, be)
    common = ae[last_a]
    of = np.searchsorted(edges, common)
    first, last = np.searchsorted(of, np.arange(len(edges))), np.searchsorted(of, np.arange(len(edges)), "right") - 1
    closed = last >= first
    n = len(common)
    from_to = []  # for either side, where a range's prefix, closed groups and suffix begin, and where its tokens end
    for ends in (ae, be):
        to = np.searchsorted(ends, edges, "right")
        inner = [np.where(closed, np.searchsorted(ends, common[np.minimum(at, n - 1)], "right"), to) if n else to for at in (first, np.maximum(last, 0))]
        from_to.append(np.stack((np.concatenate(([0], to[:-1])), *inner, to), axis=1))
    sizes = [x[:, 2] - x[:, 1] for x in from_to]
    i, j = (np.repeat(x[:, 1] - np.cumsum(m) + m, m) + np.arange(int(m.sum())) for x, m in zip(from_to, sizes))  # tokens of closed groups
    order = _order(np, names, a[i], last_a[i], _groups(np, last_a)[i], b[j], last_b[j], _groups(np, last_b)[j], n)
    text = b"".join(names.texts[order].tolist())
    byte = np.concatenate(([0], np.cumsum(names.lens[order])))
    upto = byte[np.concatenate(([0], np.cumsum(sum(sizes))))].tolist()
    both, own = names.n_a * names.n_b, ~last_b[j]
    ranges = [np.repeat(np.arange(len(edges)) * both, m) for m in sizes]
    key, times = _distinct(np, np.concatenate((ranges[0] + a[i] * names.n_b + b[with_b[i]], ranges[1][own] + a[with_a[j[own]]] * names.n_b + b[j[own]])))
    begin = np.searchsorted(key, np.arange(len(edges) + 1) * both).tolist()
    pairs = ((key % both // names.n_b) << 32) | key % names.n_b
    out = []
    for k, (is_closed, n_groups, (a0, a1, a2, a3), (b0, b1, b2, b3)) in enumerate(zip(closed.tolist(), (last - first).tolist(), from_to[0].tolist(), from_to[1].tolist())):
        ends = (a[a0:a1], ae[a0:a1], b[b0:b1], be[b0:b1]), (a[a2:a3], ae[a2:a3], b[b2:b3], be[b2:b3])
        out.append(Fragment(is_closed, ends[0], text[upto[k]:upto[k + 1]], max(0, n_groups), a2 - a1, b2 - b1, pairs[begin[k]:begin[k + 1]], times[begin[k]:begin[k + 1]], ends[1]))
    return out


def compose(np, names: Names, x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges together; associative, with identity() as its unit."""
    if not y.closed:
        return x._replace(suffix=_joined(np, x.suffix, y.prefix)) if x.closed else x._replace(prefix=_joined(np, x.prefix, y.prefix))
    if not x.closed:
        return y._replace(prefix=_joined(np, x.prefix, y.prefix))
    a, ae, b, be = _joined(np, x.suffix, y.prefix)
    text, n, pairs, times = _close(np, names, a, ae, b, be)
    pairs, times = _counted(np, np.concatenate((x.pairs, pairs, y.pairs)), np.concatenate((x.times, times, y.times)))
    return Fragment(True, x.prefix, x.text + text + y.text, x.n_groups + n + y.n_groups, x.n_a + len(a) + y.n_a, x.n_b + len(b) + y.n_b, pairs, times, y.suffix)


def tree(np, names: Names, parts: list[Fragment]) -> Fragment:
    """Neighbours are composed in rounds, so that no long fragment is copied for each short one."""
    while len(parts) > 1:
        parts = [compose(np, names, *parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else identity(np)


def whole(np, names: Names, f: Fragment) -> Fragment:
    """The fragment of a whole text: its start and end are common offsets without tokens."""
    edge = identity(np)._replace(closed=True)
    return compose(np, names, edge, f) if f.closed else f


class Encoders:
    """Both tokenizers, the lengths of their pieces in bytes, and the words that were encoded last."""

    def __init__(self, path_a: str, path_b: str):
        import os

        import numpy as np
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in _byte_signs().items()}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.len_a, self.len_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id("▁")
        self.names = Names(np, len(self.bytes_a), len(self.bytes_b))
        safe = np.ones(256, bool)  # last bytes of a character that is surely not white space
        safe[:0x21], safe[0x7F], safe[list(MAYBE_BLANK)] = False, False, False
        self.safe = safe
        self.known: dict[bytes, int] = {}
        self._forget(np)

    def _forget(self, np):
        self.known.clear()
        self.ids, self.counts, self.ok = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2, np.zeros(0, bool)

    def _run(self, np, words: list[bytes], text: bytes, sides):
        """(ids, ids of each word) of either side for words that were encoded as one text; None where bytes or ends of words don't come back."""
        ends_of, out = np.cumsum([len(w) for w in words]), []
        for ids, pieces, lens in zip(sides, (self.bytes_a, self.bytes_b), (self.len_a, self.len_b)):
            if b"".join([pieces[i] for i in ids]) != text:
                return None
            ids = np.array(ids, np.int64)
            ends = np.cumsum(lens[ids])
            at = np.searchsorted(ends, ends_of)
            if (ends[at] != ends_of).any():
                return None
            out.append((ids, np.diff(at, prepend=-1)))
        return out

    def _encode(self, texts: list[bytes]):
        """Ids of both sides of texts that begin with a blank: A takes it, B adds it itself."""
        plain = [t.decode() for t in texts]
        coded_b = iter(self.b.encode([t[1:] for t in plain if len(t) > 1], num_threads=1))
        return [(e.ids, next(coded_b) if len(t) > 1 else [self.blank]) for t, e in zip(plain, self.a.encode_batch_fast(plain, add_special_tokens=False))]

    def words(self, np, words: list[bytes]):
        """Places of distinct words in the table of encoded ones. Neither side joins a word that surely ends in no white space with a next one, so such words are encoded in runs."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self._forget(np)
            new = words
        new = sorted(new, key=lambda w: not self.safe[w[-1]])
        n_safe = sum(bool(self.safe[w[-1]]) for w in new)
        runs = [new[i:min(i + RUN, n_safe)] for i in range(0, n_safe, RUN)] + [[w] for w in new[n_safe:]]
        found: list = []
        for run, text, sides in zip(runs, texts := [b"".join(r) for r in runs], self._encode(texts)):
            got = self._run(np, run, text, sides)
            if got is None and len(run) > 1:
                for w, own in zip(run, self._encode(run)):
                    found.append(([w], self._run(np, [w], w, own)))
            else:
                found.append((run, got))
        lost = [(np.zeros(0, np.int64), np.zeros(1, np.int64))] * 2
        at = len(self.ok)
        for run, _ in found:
            self.known.update(zip(run, range(at, at + len(run))))
            at += len(run)
        for side in (0, 1):
            self.ids[side] = np.concatenate((self.ids[side], *((got or lost)[side][0] for _, got in found)))
            self.counts[side] = np.concatenate((self.counts[side], *((got or lost)[side][1] for _, got in found)))
        self.ok = np.concatenate((self.ok, *(np.full(len(run), got is not None) for run, got in found)))
        return np.array([self.known[w] for w in words], np.int64)

    def encode(self, data: bytes, offsets):
        """Of texts that lie one after the other, each with its blank in front: whether both sides give its bytes back, and for either side ids, ends (bytes of data), and
        where each text's tokens begin. Neither tokenizer joins a character that is no white space with a blank behind it, so texts are cut there
        into words, and distinct words are encoded once."""
        import numpy as np
        import pyarrow as pa

        buf = np.frombuffer(data, np.uint8)
        cut = buf == 0x20
        cut[1:] &= self.safe[buf[:-1]]
        cut[offsets[:-1]] = True
        starts = np.append(np.flatnonzero(cut), len(buf)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        place = self.words(np, coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        first = np.searchsorted(starts, offsets)
        wrong = np.concatenate(([0], np.cumsum(~self.ok[place])))
        out = []
        for side, lens in enumerate((self.len_a, self.len_b)):
            at, n = np.cumsum(self.counts[side]) - self.counts[side], self.counts[side][place]
            upto = np.concatenate(([0], np.cumsum(n)))
            own = self.ids[side][np.repeat(at[place] - upto[:-1], n) + np.arange(upto[-1])]
            # counted from each word's start: a word whose bytes don't come back leaves the others right
            size = np.concatenate(([0], np.cumsum(lens[own])))
            ends = size[1:] + np.repeat(starts[:-1] - size[upto[:-1]], n)
            out.append((own, ends, upto[first]))
        return wrong[first[1:]] == wrong[first[:-1]], *out


def _byte_signs() -> dict[int, str]:
    """Byte-level vocabularies write a printable byte as its character, the others as the characters from 256 on, in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(plain))}


def fragments(enc: Encoders, texts: list[bytes], chunk: int) -> Iterator[Fragment | None]:
    """The fragment of each text, which has its blank in front; None if the bytes don't come back. Byte ranges of
    `chunk` bytes make fragments of their own, which are composed."""
    import numpy as np

    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    ok, *sides = enc.encode(b"".join(texts), offsets)
    kept = []
    for ids, ends, at in sides:
        good = np.repeat(ok, np.diff(at))
        kept += [ids[good], ends[good]]
    edges = [np.append(np.arange(i + chunk, j, chunk), j) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    parts = range_fragments(np, enc.names, np.concatenate(edges), *kept)
    at = 0
    for good, own in zip(ok.tolist(), edges):
        yield tree(np, enc.names, parts[at:at + len(own)]) if good else None
        at += len(own)


#: Encoders of this Python worker, which runs many tasks.
_own: dict[tuple[str, str], Encoders] = {}


def encoders(path_a: str, path_b: str) -> Encoders:
    if (path_a, path_b) not in _own:
        _own[path_a, path_b] = Encoders(path_a, path_b)
    return _own[path_a, path_b]


FRAGMENT = ("closed boolean, a0 array<long>, ae0 array<long>, b0 array<long>, be0 array<long>, text binary, n_groups long, n_a long, n_b long, pairs array<long>, times array<long>, "
            "a1 array<long>, ae1 array<long>, b1 array<long>, be1 array<long>")
RESULT = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def _result(np, names: Names, f: Fragment | None, texts: bool) -> dict:
    """Columns of a whole text; groups: their text, or its digest."""
    f = whole(np, names, f or identity(np))
    text = f.text[:-1]
    groups = "" if not text else text.decode() if texts else hashlib.sha256(text).hexdigest()
    return {"n_a": f.n_a, "n_b": f.n_b, "n_groups": f.n_groups, "n_links": int(f.times.sum()), "groups": groups, "pairs": f.pairs, "times": f.times}


def _as_row(f: Fragment) -> dict:
    return dict(zip((c.split()[0] for c in FRAGMENT.split(", ")), (f.closed, *f.prefix, f.text, f.n_groups, f.n_a, f.n_b, f.pairs, f.times, *f.suffix)))


def _from_row(np, r: dict) -> Fragment:
    arrays = lambda names: tuple(np.array(r[n], np.int64) for n in names)
    return Fragment(r["closed"], arrays(("a0", "ae0", "b0", "be0")), r["text"], r["n_groups"], r["n_a"], r["n_b"], *arrays(("pairs", "times")), arrays(("a1", "ae1", "b1", "be1")))


def _schema(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(pa, rows: list[dict], schema):
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _groups_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of some `most` bytes together."""
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def safe_cut(text: str, at: int) -> int:
    """The next place from `at` on where a text can be cut: before a blank that follows no white space and isn't the text's end; else its length."""
    while 0 < (at := text.find(" ", at)) < len(text) - 1:
        if not text[at - 1].isspace():
            return at
        at += 1
    return len(text)


def _encode_parts(rows: DataFrame, path_a: str, path_b: str, chunk: int, final: bool, texts: bool) -> DataFrame:
    """rows with text (its blank in front left out) replaced by the columns of a fragment, or of a whole text where final."""
    own = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    ddl = ", ".join([*own, "ok boolean", RESULT if final else FRAGMENT])
    schema = _schema(ddl)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        enc = encoders(path_a, path_b)
        for b in batches:
            data, others = b.column("text").cast(pa.binary()), b.drop_columns(["text"]).to_pylist()
            for i, j in _groups_of(pc.binary_length(data).to_pylist(), SLICE):
                out = []
                for row, f in zip(others[i:j], fragments(enc, [b" " + t for t in data.slice(i, j - i).to_pylist()], chunk)):
                    out.append(row | {"ok": f is not None} | (_result(np, enc.names, f, texts) if final else _as_row(f or identity(np))))
                yield _batch(pa, out, schema)

    return rows.mapInArrow(run, ddl)


def _compose_parts(parts: DataFrame, path_a: str, path_b: str, levels: int, texts: bool) -> DataFrame:
    """One row for each text of parts(_row, doc_id, part, ok and a fragment's columns): levels of FAN neighbours are composed, each level spread over all tasks."""
    kept = "_row long, doc_id long, part long, ok boolean, "

    def composed(last: bool):
        schema = _schema(kept + (RESULT if last else FRAGMENT))

        def meet(table):
            import numpy as np
            import pyarrow as pa

            names = encoders(path_a, path_b).names
            rows = sorted(table.to_pylist(), key=lambda r: r["part"])
            good = all(r["ok"] for r in rows)
            f = tree(np, names, [_from_row(np, r) for r in rows]) if good else identity(np)
            own = {"_row": rows[0]["_row"], "doc_id": rows[0]["doc_id"], "part": rows[0]["part"] // FAN, "ok": good}
            return pa.Table.from_batches([_batch(pa, [own | (_result(np, names, f, texts) if last else _as_row(f))], schema)])

        return meet

    for level in range(levels):
        last = level == levels - 1
        parts = parts.groupBy("_row", F.floor(F.col("part") / FAN).alias("_up")).applyInArrow(composed(last), kept + (RESULT if last else FRAGMENT))
    return parts.drop("part")


def _whole_texts(docs: DataFrame, path_a: str, path_b: str, part: int, chunk: int, texts: bool) -> DataFrame:
    """_row, doc_id, ok and the columns of a whole text for each row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = rows.where((F.octet_length("text") <= part) & (F.col("text") != ""))
    empty = rows.where("text = ''").select("_row", "doc_id", F.lit(False).alias("ok"), *(F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")), F.lit("").alias("groups"), *(F.array().cast("array<long>").alias(c) for c in ("pairs", "times")))
    whole_ones = _encode_parts(short, path_a, path_b, chunk, True, texts)

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                t, at, k = r["text"], 0, 0
                while at < len(t):
                    end = safe_cut(t, at + part // 4)  # a character has four bytes at most
                    yield pa.RecordBatch.from_pydict({"_row": pa.array([r["_row"]], pa.int64()), "doc_id": pa.array([r["doc_id"]], pa.int64()), "part": pa.array([k], pa.int64()), "text": pa.array([t[at + (k > 0):end]], pa.string())})
                    at, k = end, k + 1

    # written, so that the rows' numbers and parts don't change when a task runs again
    parts = written(rows.where(F.octet_length("text") > part).mapInArrow(cut, "_row long, doc_id long, part long, text string"), "align-parts")
    most = parts.agg(F.max("part")).first()[0]
    if most is None:
        return whole_ones.unionByName(empty)
    levels = 1
    while FAN ** levels <= most:
        levels += 1
    spread = parts.repartition(F.col("_row"), F.col("part"))
    coded = _encode_parts(spread, path_a, path_b, chunk, False, texts)
    return reduce(DataFrame.unionByName, [whole_ones, empty, _compose_parts(coded, path_a, path_b, levels, texts)])


def _link_counts(aligned: DataFrame, frequent: int):
    """(frequent pairs and their counts, all counts, greatest count of each A id): in how many documents each id pair is linked."""
    pairs = aligned.select(F.explode_outer("pairs").alias("pair")).where("pair is not null")
    counts = written(pairs.groupBy("pair").agg(F.count("*").alias("n")), "align-counts")
    by_count = counts.groupBy("n").agg(F.count("*").alias("pairs"))
    upto = by_count.withColumn("upto", F.sum("pairs").over(Window.orderBy(F.desc("n"))))  # a row for each distinct count
    cut = upto.where(F.col("upto") <= frequent).agg(F.min("n")).first()[0]
    known = counts.where(F.col("n") >= cut) if cut is not None else counts.limit(0)
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("best"))
    return known.toArrow(), counts, best


def align(docs: DataFrame, path_a: str, path_b: str, part: int = PART, chunk: int = CHUNK, frequent: int = FREQUENT, texts: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row of docs(doc_id, text): how a byte-level BPE (A, a JSON file) and a
    piece BPE with byte fallback (B, a model file) cut a blank and the text.

    Byte offsets where tokens of both sides end cut them into groups; groups: 'a1,a2|b1;a3|b2,b3' in decimal ids, or its SHA-256 (texts False; '' without tokens). A link is a pair of an A
    and a B token whose bytes overlap; an id pair's count is the number of documents in which it is linked; n_best are the links whose count is the highest of their A id,
    count_sum the sum of counts over links. Null and empty texts, and texts whose bytes don't come back from both sides, have no tokens: zeros and ''.
    A row is a document, whatever its doc_id; the other columns go, so their names are harmless.

    Texts of over `part` bytes are cut where neither tokenizer joins anything, as far as they have such places; their parts are encoded in tasks of their own and composed FAN at a time by
    a tree of exchanges. Within a part each byte range of `chunk` bytes gives a fragment. The last composition holds a whole text's groups, as their digest needs them in one row.
    Counts of the `frequent` commonest pairs are broadcast, and so is the greatest count of each A id; the other pairs are rare, so their counts are joined by a shuffle.
    """
    spark = docs.sparkSession
    aligned = written(_whole_texts(docs, path_a, path_b, part, chunk, texts), "aligned")
    known, counts, best = _link_counts(aligned, frequent)
    greatest = best.toArrow()  # a row for each id of A's vocabulary at most
    shared = spark.sparkContext.broadcast((known, greatest))

    def look_up(batches):
        import numpy as np
        import pyarrow as pa

        table, top = shared.value
        keys, n = table["pair"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(keys)
        keys, n = np.append(keys[order], -1), np.append(n[order], 0)
        highest = np.zeros(int(np.max(top["a"].to_numpy(), initial=0)) + 1, np.int64)
        highest[top["a"].to_numpy()] = top["best"].to_numpy()
        for b in batches:
            lists = b.column("pairs")
            pair, times = lists.flatten().to_numpy(zero_copy_only=False), b.column("times").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
            at = np.searchsorted(keys[:-1], pair)
            found = keys[at] == pair
            count = np.where(found, n[at], 0)
            is_best = found & (count == highest[pair >> 32]) if len(pair) else found
            sums = [np.zeros(len(b), np.int64) for _ in range(2)]
            np.add.at(sums[0], row, times * count)
            np.add.at(sums[1], row[is_best], times[is_best])
            off = pa.array(np.searchsorted(row[~found], np.arange(len(b) + 1)).astype(np.int32))
            rest = pa.StructArray.from_arrays([pa.array(pair[~found]), pa.array(times[~found])], names=["pair", "times"])
            own = {c: b.column(c) for c in ("_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")}
            own |= {"n_best": pa.array(sums[1]), "count_sum": pa.array(sums[0]), "rare": pa.ListArray.from_arrays(off, rest)}
            yield pa.RecordBatch.from_arrays(list(own.values()), names=list(own))

    ddl = "_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long, rare array<struct<pair: long, times: long>>"
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    # rows are numbered anew, in the written table, as the numbers above come from several reads of docs
    done = aligned.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times").mapInArrow(look_up, ddl)
    if counts.count() == known.num_rows:
        return done.select(columns)
    done = written(done, "align-looked-up")
    rare = done.select("_row", F.explode_outer("rare").alias("r")).where("r is not null").select("_row", "r.*")
    met = rare.join(counts.hint("shuffle_merge"), "pair").join(best.withColumnRenamed("a", "_a").hint("shuffle_hash"), F.shiftright("pair", 32) == F.col("_a"))
    more = met.groupBy("_row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    both = done.drop("rare").join(more.hint("shuffle_merge"), "_row", "left")
    return both.withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0))).select(columns)
