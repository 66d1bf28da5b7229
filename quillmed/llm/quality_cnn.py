"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import sample

#: Bound of the training sample: labelled rows of each class, lowest hashes first. Their whole texts are learnt from.
SAMPLE_PER_CLASS = 2000
EPOCHS = 6
#: Shape: bytes of a filter, step between windows, embedding size, filters; a chunk is two hops, so chunks overlap by half.
WIDTH, STRIDE, DIM, FILTERS, HOP = 12, 4, 6, 24, 256


@dataclass
class Net:
    embed: object
    conv: object
    bias: object
    out: object
    shift: float = 0.0
    mix: tuple = (0.0, 1.0, 0.0, 0.0)  # doc logit from (1, mean, max, min) of chunk logits


def hops(net: Net, flat, valid):
    """Pooled filter responses of each hop of a padded byte buffer: (len / HOP, FILTERS). Works
    through slices of the buffer, so memory doesn't grow with a text's length."""
    import numpy as np

    n, per, out = len(flat) // HOP, HOP // STRIDE, []
    padded = np.concatenate([flat, np.zeros(WIDTH, np.uint8)])
    for at in range(0, n, 512):
        to = min(at + 512, n)
        x = net.embed[padded[at * HOP:to * HOP + WIDTH]]
        rows = (to - at) * per
        win = np.lib.stride_tricks.as_strided(x, (rows, WIDTH * DIM), (x.strides[0] * STRIDE, x.strides[1]))
        z = np.maximum(np.ascontiguousarray(win) @ net.conv + net.bias, 0)
        z *= valid[at * HOP:to * HOP:STRIDE, None]
        out.append(z.reshape(to - at, per, FILTERS).max(axis=1))
    return np.concatenate(out) if out else np.zeros((0, FILTERS), np.float32)


def chunk_logits(net: Net, texts: list[bytes]):
    """(logits of all chunks, first chunk of each text): chunk i of a text covers hops i and i + 1."""
    import numpy as np

    sizes = np.array([-(-(len(t) + WIDTH) // HOP) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat, valid = np.zeros(starts[-1] * HOP, np.uint8), np.zeros(starts[-1] * HOP, np.float32)
    for t, s in zip(texts, starts):
        flat[s * HOP:s * HOP + len(t)] = np.frombuffer(t, np.uint8)
        valid[s * HOP:s * HOP + max(1, len(t))] = 1
    h = hops(net, flat, valid)
    after = np.concatenate([h[1:], h[-1:]])
    after[starts[1:] - 1] = h[starts[1:] - 1]  # the last hop of a text has no later one
    return np.maximum(h, after) @ net.out + net.shift, starts[:-1]


def features(net: Net, texts: list[bytes]):
    """(mean, max, min) of the chunk logits of each whole text."""
    import numpy as np

    z, starts = chunk_logits(net, texts)
    z = z.astype(np.float64)
    sizes = np.diff(np.concatenate((starts, [len(z)])))
    return np.stack([np.add.reduceat(z, starts) / sizes, np.maximum.reduceat(z, starts), np.minimum.reduceat(z, starts)], axis=1)


def training_chunks(text: bytes) -> list[bytes]:
    """The whole text in chunks laid end to end."""
    return [text[at:at + 2 * HOP + WIDTH] for at in range(0, max(1, len(text)), 2 * HOP)]


def train(chunks: list[bytes], labels: list[int], shares: list[float], seed: int = 5) -> Net:
    """Fit the filters on chunks under their documents' labels. A chunk counts by its share of its
    document, so a document counts once however long it is, and both classes count alike."""
    import numpy as np

    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.5, (256, DIM)).astype(np.float32), rng.normal(0, 0.15, (WIDTH * DIM, FILTERS)).astype(np.float32),
              np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, FILTERS).astype(np.float32))
    net.embed[0] = 0
    if len(set(labels)) < 2:
        net.mix = (4.0 if not labels or labels[0] else -4.0, 0.0, 0.0, 0.0)
        return net
    span, size = 2 * HOP + WIDTH, 2 * HOP
    data, target = np.stack([np.frombuffer(c.ljust(span, b"\0"), np.uint8) for c in chunks]), np.array(labels, np.float32)
    share = np.array(shares)
    per_class = np.array([share[target == c].sum() for c in (0, 1)])
    weight = (share * (len(target) / (2 * per_class))[target.astype(int)]).astype(np.float32)
    names, windows = ("embed", "conv", "bias", "out", "shift"), size // STRIDE
    moment = {k: [0.0, 0.0] for k in names}
    offsets, step = np.arange(WIDTH), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(data))
        for at in range(0, len(order), 64):
            pick = order[at:at + 64]
            b, y, w = data[pick], target[pick], weight[pick]
            x = net.embed[b]
            win = np.lib.stride_tricks.as_strided(x, (len(b), windows, WIDTH * DIM), (x.strides[0], x.strides[1] * STRIDE, x.strides[2]))
            z = np.ascontiguousarray(win) @ net.conv + net.bias
            best = z.argmax(axis=1)
            top = np.take_along_axis(z, best[:, None, :], axis=1)[:, 0]
            pooled = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.shift, -30, 30)))
            g = ((p - y) * w / len(b)).astype(np.float32)
            down = g[:, None] * net.out * (top > 0)
            chosen = win[np.arange(len(b))[:, None], best]  # (b, filters, width * dim)
            grad = {"conv": np.einsum("bf,bfd->df", down, chosen), "bias": down.sum(axis=0), "out": pooled.T @ g, "shift": g.sum()}
            at_bytes = b[np.arange(len(b))[:, None, None], (best * STRIDE)[:, :, None] + offsets]
            back = down[:, :, None, None] * net.conv.T.reshape(1, FILTERS, WIDTH, DIM)
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], at_bytes.ravel(), back.reshape(-1, DIM))
            grad["embed"][0] = 0
            step += 1
            for k in names:
                m = moment[k]
                m[0] = 0.9 * m[0] + 0.1 * grad[k]
                m[1] = 0.999 * m[1] + 0.001 * grad[k] ** 2
                move = 0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32) if k != "shift" else float(net.shift - move))
    return net


def fit_mix(net: Net, found, labels: list[int]) -> tuple:
    """Logistic coefficients of a document's label on (mean, max, min) of its chunk logits."""
    import numpy as np

    x = np.concatenate([np.ones((len(found), 1)), found], axis=1)
    y, beta = np.array(labels, float), np.array([0.0, 1.0, 0.0, 0.0])
    ridge = np.eye(4) * 0.1
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ beta)
    return tuple(float(v) for v in beta)


def train_rows():
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Net:
    """Train on at most per_class labelled rows of each class. The driver gets the whole texts of
    these rows as chunks, then three numbers of each."""
    import numpy as np

    rows = sample(docs, labels, "quality", train_rows(), per_class)

    def drawn(batches):
        import pyarrow as pa

        for b in batches:
            got = [(d.as_py(), k, c, y.as_py(), 1 / len(cs)) for d, t, y in zip(b.column(0), b.column(1), b.column(2)) for cs in [training_chunks(_bytes(t))] for k, c in enumerate(cs)]
            cols = list(zip(*got)) if got else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "at", "chunk", "label", "share"])

    chunks = rows.select("doc_id", "text", "label").mapInArrow(drawn, "doc_id long, at int, chunk binary, label int, share double").orderBy("doc_id", "at").collect()
    net = train([bytes(r["chunk"]) for r in chunks], [r["label"] for r in chunks], [r["share"] for r in chunks])
    if len({r["label"] for r in chunks}) == 2:
        found = measured(rows, net, ["label"]).orderBy("doc_id", "mean").collect()
        net.mix = fit_mix(net, np.array([[r["mean"], r["high"], r["low"]] for r in found]), [r["label"] for r in found])
    return net


def _bytes(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def measured(docs: DataFrame, net: Net, keep: list[str] = ()) -> DataFrame:
    """doc_id, mean, high, low of the chunk logits of each row's whole text, and columns of keep."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kinds = dict(docs.dtypes)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            parts, group, held = [], [], 0
            for t in b.column("text"):
                group.append(_bytes(t))
                held += len(group[-1])
                if held >= 1 << 19:
                    parts.append(features(shared.value, group))
                    group, held = [], 0
            if group:
                parts.append(features(shared.value, group))
            f = np.concatenate(parts) if parts else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(f[:, i], pa.float64()) for i in range(3)), *(b.column(c) for c in keep)], names=["doc_id", "mean", "high", "low", *keep])

    return docs.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(run, "doc_id long, mean double, high double, low double" + "".join(f", {c} {kinds[c]}" for c in keep))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts are scored as one blank window. Rows are scored one by one, so repeated
    rows agree. Without labels of both classes the score is one constant.
    """
    net = fit(docs, labels)
    b0, b1, b2, b3 = map(F.lit, net.mix)
    z = b0 + b1 * F.col("mean") + b2 * F.col("high") + b3 * F.col("low")
    scored = measured(docs, net).withColumn("score", F.round(1 / (1 + F.exp(-z)), 6))
    return scored.select("doc_id", (~train_rows()).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
