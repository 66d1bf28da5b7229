"""Edit-aware token counts: segment trees over runs of pre-tokens.

The cut rule fits patterns in which no match goes on from a non-space to a blank, as the usual byte-level ones
(`PATTERN` of the tokenizers here); for another pattern it must be checked. A text without blanks is one leaf, so an
edit there encodes it whole. An edit copies the text (a string) but encodes only the leaves around it.
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A leaf holds this many characters at least, and ends where a space follows a non-space: there
#: every match of the pattern ends, and what follows is matched as if the text began there.
LEAF = 512
_CUT = re.compile(r"\S(?=[ \t\r\n])")
_EDIT = "array<struct<start:int,end:int,replacement:string>>"
_coders: dict = {}


def leaves(text: str, size: int = LEAF) -> list[int]:
    """Lengths of the leaves of a text; their concatenation is the text."""
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + size - 1)
        to = m.end() if m else len(text)
        out.append(to - at)
        at = to
    return out or [0]


def tree_of(counts: list[int]) -> list[int]:
    """Subtree sums: node i has the children 2i and 2i + 1, leaf k is node len(counts) + k."""
    n = len(counts)
    tree = [0] * n + list(counts)
    for i in range(n - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def total(tree: list[int]) -> int:
    return tree[1]


def set_leaf(tree: list[int], k: int, value: int) -> None:
    """Change one leaf and the sums above it."""
    i = len(tree) // 2 + k
    step = value - tree[i]
    while i >= 1:
        tree[i] += step
        i //= 2


def apply_edit(text: str, lens: list[int], tree: list[int], start: int, end: int, new: str, count, leaf: int = LEAF) -> tuple[str, int]:
    """Replace text[start:end] by new; lens and tree are brought up to date in place. Only the
    leaves from that of the character before the edit to that of the character after it are
    encoded again: the leaf bounds beyond them keep both their neighbours. The run is cut into
    leaves anew; where their number stays, only the sums above them change, else the sums are
    added up again. Returns the text and the characters encoded."""
    start = max(0, min(start, len(text)))
    end = max(start, min(end, len(text)))
    at, first, last, lo, hi = 0, None, 0, 0, 0
    for k, n in enumerate(lens):
        if first is None and (at + n > max(0, start - 1) or k == len(lens) - 1):
            first, lo = k, at
        at += n
        if first is not None:
            last, hi = k, at
            if at > end:
                break
    edited = text[:start] + new + text[end:]
    run = edited[lo:hi + len(new) - (end - start)]
    own, counts, at = leaves(run, leaf), [], 0
    for n in own:
        counts.append(count(run[at:at + n]))
        at += n
    old, n_old = tree[len(lens):], last + 1 - first
    lens[first:last + 1] = own
    if len(own) == n_old:
        for k, c in enumerate(counts):
            set_leaf(tree, first + k, c)
    else:
        old[first:last + 1] = counts
        tree[:] = tree_of(old)
    return edited, len(run)


def _coder(key, ranks, pattern):
    if key not in _coders:
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _coders[key] = lambda text: len(coder.encode_ordinary(text))
    return _coders[key]


def _ranks(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))})


def build(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """docs with lens and tree: the segment tree of each row's whole text. Null texts count as
    empty; an empty text has one leaf of 0 tokens. Other columns pass through, but for columns that are named lens and tree already: these are replaced."""
    ranks = _ranks(docs.sparkSession, path)
    rows = docs.drop("lens", "tree")

    def run(batches):
        import pyarrow as pa

        count = _coder(path, ranks.value, pattern)
        for b in batches:
            lens, trees = [], []
            for t in b.column("text"):
                text, at, own = t.as_py() or "", 0, []
                lens.append(leaves(text, leaf))
                for n in lens[-1]:
                    own.append(count(text[at:at + n]))
                    at += n
                trees.append(tree_of(own))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lens, pa.list_(pa.int32())), pa.array(trees, pa.list_(pa.int64()))], names=[*b.schema.names, "lens", "tree"])

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("lens", T.ArrayType(T.IntegerType())), T.StructField("tree", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema)


def recount(trees: DataFrame, edits: str, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, n_leaves, edited_tokens, encoded_chars, edited_chars) from rows with
    text, lens, tree and a column `edits` of (start, end, replacement) in characters, applied in
    order, each to the result of the last. Null edits or a null replacement change or insert
    nothing; ranges are cut to the text."""
    ranks = _ranks(trees.sparkSession, path)

    def run(batches):
        import pyarrow as pa

        count = _coder(path, ranks.value, pattern)
        for b in batches:
            out = []
            for t, ls, tr, es in zip(b.column("text"), b.column("lens"), b.column("tree"), b.column("edits")):
                text, lens, tree, done = t.as_py() or "", ls.as_py(), tr.as_py(), 0
                before, n_leaves = total(tree), len(lens)
                for e in es.as_py() or []:
                    text, n = apply_edit(text, lens, tree, e["start"], e["end"], e["replacement"] or "", count, leaf)
                    done += n
                out.append((before, n_leaves, total(tree), done, len(text)))
            cols = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_tokens", "n_leaves", "edited_tokens", "encoded_chars", "edited_chars"])

    return (trees.select(F.col("doc_id").cast("long"), "text", "lens", "tree", F.col(edits).cast(_EDIT).alias("edits"))
            .mapInArrow(run, "doc_id long, n_tokens long, n_leaves long, edited_tokens long, encoded_chars long, edited_chars long"))
