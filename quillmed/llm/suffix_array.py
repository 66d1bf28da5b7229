"""Suffix arrays by induced sorting, in numpy: whole buckets are induced at a time."""

from __future__ import annotations

import numpy as np

#: A reduced string is sorted by recursion if its names stand this many times on average. Each bucket of names costs
#: numpy calls: always recursing takes 10.3 s for a shard of 1.1 million characters with 8192 contexts, pairing names 0.75 s.
REPEATED = 64


def _types(text):
    """True where a suffix is smaller than the next one (S-type); the last one is S-type."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    small = np.ones(n, bool)
    small[:-1] = step[nearest] > 0
    return small


def _put(sa, preds, chars, ends, direction):
    """Append preds, in order, to the buckets of their characters."""
    order = np.argsort(chars, kind="stable")
    c, p = chars[order], preds[order]
    cut = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    sizes = np.diff(np.concatenate((cut, [len(c)])))
    rank = np.arange(len(c)) - np.repeat(cut, sizes)
    base = ends[c[cut]]
    sa[np.repeat(base, sizes) + rank if direction > 0 else np.repeat(base, sizes) - 1 - rank] = p
    ends[c[cut]] += direction * sizes


def _induce(text, small, starts, lms):
    """The order of all suffixes from that of the leftmost S-type ones (lms, in order)."""
    sa = np.full(len(text), -1, np.int32)
    sigma = len(starts) - 1
    heads, tails = starts[:-1].copy(), starts[1:].copy()
    lms_at = np.searchsorted(text[lms], np.arange(sigma + 1))
    for c in range(sigma):  # larger types: from what stands before, left to right
        done = starts[c]
        while True:
            block = sa[done:heads[c]]
            done = heads[c]
            if len(block):
                preds = block[block > 0] - 1
            elif lms_at[c] < lms_at[c + 1]:
                preds = lms[lms_at[c]:lms_at[c + 1]]
                preds = preds[preds > 0] - 1
                lms_at[c] = lms_at[c + 1]
            else:
                break
            preds = preds[~small[preds]]
            if len(preds):
                _put(sa, preds, text[preds], heads, 1)
    sa[0] = len(text) - 1
    for c in range(sigma - 1, -1, -1):  # smaller types: from what stands after, right to left
        done, larger = starts[c + 1], heads[c]
        while True:
            block = sa[tails[c]:done][::-1]
            done = tails[c]
            if not len(block):
                if larger <= starts[c]:
                    break
                block, larger = sa[starts[c]:larger][::-1], starts[c]
            preds = block[block > 0] - 1
            preds = preds[small[preds]]
            if len(preds):
                _put(sa, preds, text[preds], tails, -1)
    return sa


def _reduced_order(names, reach):
    """Order of the suffixes of the reduced string: by recursion where names repeat, else neighbours' names
    are paired and named again, each round a string of half the depth, until names are unique or `reach` names deep."""
    m, kinds, rank, depth = len(names), int(names.max()) + 1, names.astype(np.int64), 1
    if kinds < m and m >= REPEATED * kinds:
        return suffix_array(names, reach)
    while True:
        order = np.argsort(rank, kind="stable")
        if depth >= reach or m < 2 or not (rank[order][1:] == rank[order][:-1]).any():
            return order
        after = np.full(m, -1, np.int64)
        after[:m - depth] = rank[depth:]
        key = rank * (m + 2) + after + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(m, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        depth *= 2


def suffix_array(text, depth: int = 1 << 40):
    """Order of the suffixes of an array of small numbers that ends with its only 0;
    suffixes that agree in their first `depth` characters may stand in any
    order. Suffixes are classified, the leftmost S-type substrings are sorted by inducing and named,
    the string of names is sorted in the same way, and its order induces that of all suffixes."""
    text = np.asarray(text)
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    small = _types(text)
    starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))))
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    rough = lms[np.argsort(text[lms], kind="stable")]
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = _induce(text, small, starts, rough)
    ordered = sa[is_lms[np.maximum(sa, 0)] & (sa >= 0)]
    # names: neighbours in the order get one name if they agree character by character
    length = np.diff(np.concatenate((lms, [n - 1]))) + 1
    place = np.empty(n, np.int32)
    place[lms] = np.arange(len(lms))
    a = place[ordered]
    fresh = np.concatenate(([True], length[a][1:] != length[a][:-1]))
    at, off = np.flatnonzero(~fresh), 0
    while len(at):
        differs = text[lms[a[at]] + off] != text[lms[a[at - 1]] + off]
        fresh[at[differs]] = True
        off += 1
        at = at[~differs & (length[a[at]] > off)]
    names = np.empty(len(lms), np.int64)
    names[a] = np.cumsum(fresh) - 1
    order = _reduced_order(names, max(2, depth // 2 + 2))
    return _induce(text, small, starts, lms[order])


def common_prefixes(data, sa, left, most: int):
    """Permuted common prefixes: at text position j, the length (up to `most`) that suffix j
    shares with the suffix before it in the order; positions with fewer than `most` bytes left
    in their piece, or whose predecessor has, get 0. data: bytes, with `most` spare at its end."""
    before = np.full(len(sa), -1, np.int32)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(len(sa), np.int16)
    j = np.flatnonzero((left >= most) & (before >= 0))
    phi = before[j]
    keep = left[phi] >= most
    j, phi = j[keep], phi[keep]
    words = np.array(np.ndarray((len(data) - 7,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,)))
    at = 0
    while len(j) and at < most:
        x = words[j + at] ^ words[phi + at]
        run = np.full(len(j), 8, np.int16)
        odd = x != 0
        lowest = x[odd] & (~x[odd] + np.uint64(1))
        run[odd] = (np.log2(lowest.astype(np.float64)).astype(np.int16)) // 8
        out[j] += run
        go = ~odd
        j, phi, at = j[go], phi[go], at + 8
    return np.minimum(out, most)
