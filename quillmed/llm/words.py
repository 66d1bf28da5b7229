"""Words of whole texts as Arrow arrays, and benchmark items in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of item texts that one block holds, by expectation; what is broadcast is made of one block.
BLOCK_BYTES = 4 << 20


def split_words(column):
    """The words of a string column: maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z
    lower-cased; null has none. Gives the words as one binary array, the row of each, its first byte within its row
    and the byte after its last. A word is made of the same bytes whichever characters they form, so bytes decide."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    small = np.zeros(256, np.uint8)  # 0: no byte of a word
    for b in range(256):
        if b >= 0x80 or chr(b).isalnum():
            small[b] = b + 32 if 0x41 <= b <= 0x5A else b
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    low = small[np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = low != 0
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(low[inside])])
    return words, rows, starts - offsets[rows], ends - offsets[rows]


def item_blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(item_id, its words in order) of items(item_id, text), a row each, in blocks that hold some `most` bytes of text. The bytes
    are counted first; rows that share an item_id are in one block. An item isn't split, so `most` is at least one item's text."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most))
    for b in range(n):
        block = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b)).toArrow().combine_chunks()
        ids, texts = block["item_id"].to_pylist(), block["text"].combine_chunks()
        words, row, _, _ = split_words(texts)
        of: list[list[bytes]] = [[] for _ in ids]
        for w, r in zip(words.to_pylist(), row.tolist()):
            of[r].append(w)
        yield list(zip(ids, of))
