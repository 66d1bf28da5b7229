"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import sample
from .store import written

#: Bound of the training sample: labelled rows of each class, lowest hashes first.
SAMPLE_PER_CLASS = 10_000
PRIOR = 500.0
#: A token is kept if the likelihood ratio (G squared) of its documents by class is above this.
MIN_G2 = 20.0
#: Segments whose expected number by chance is below this are significant.
SIGNIFICANT = 0.05

#: ASCII letters and digits stay (lower-cased), bytes of other scripts stay, all else separates tokens.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass
class Model:
    """weights: token -> log-odds; other: score of any other token; lam and k: parameters of the
    extreme-value law; fit: logistic coefficients on (best segment, segments)."""

    weights: dict = field(default_factory=dict)
    other: float = -0.01
    lam: float = 1.0
    k: float = 0.1
    fit: tuple = (0.0, 0.0, 0.0)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def segments(scores, other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence in which position p scores
    scores[p], or `other` < 0 where p is absent; linear in the number of positive positions. Each open segment knows the
    last one before it with a smaller sum on its left, so that those between are never looked at again."""
    found: list[list] = []  # start, end, sum before, sum after, place of the last one with a smaller sum before
    total, last = 0.0, 0
    for p in sorted(scores):
        total += (p - last) * other
        last = p + 1
        cell = [p, p + 1, total, total + scores[p]]
        total += scores[p]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= cell[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= cell[3]:
                found.append([*cell, j])
                break
            cell, before = [found[j][0], cell[1], found[j][2], cell[3]], found[j][4]
            del found[j:]
            j = before
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


def scored(text: str | None, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    """(number of tokens, all maximal-scoring segments) of a whole text."""
    words = tokens(text)
    hits = {p: w for p, w in enumerate(map(model.weights.get, words)) if w is not None}
    return len(words), segments(hits, model.other) if hits else []


def passages(text: str | None, model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """(evidence of the best segment, all significant segments) of a whole text. Evidence is
    lam * score - ln(k * n): minus the log of the expected number of such segments by chance."""
    import math

    n, found = scored(text, model)
    if not found:
        return 0.0, []
    floor = math.log(model.k * n)
    all_found = [(a, b, model.lam * s - floor) for a, b, s in found]
    return max(0.0, max(e for _, _, e in all_found)), [x for x in all_found if x[2] > -math.log(SIGNIFICANT)]


def _novelty(words: list[bytes]) -> int:
    """Smallest hash of five-word windows: near copies mostly share it."""
    import xxhash

    return min((xxhash.xxh64_intdigest(b" ".join(words[i:i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def train_rows():
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def extreme_value_law(clean: DataFrame, model: Model) -> tuple[float, float]:
    """(lam, k) of P(best score of n tokens < s) = exp(-k * n * exp(-lam * s)), by maximum likelihood over
    clean rows (a row without a segment says that its best score is under 0). For a given lam the best k is
    the number of rows with a segment over the sum of n * exp(-lam * s); lam is searched. model.lam stays if no clean row has a segment."""
    import numpy as np

    shared = clean.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [scored(t.as_py(), shared.value) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([max((s for *_, s in found), default=None) for _, found in got], pa.float64())], names=["n", "s"])

    rows = clean.select("text").mapInArrow(run, "n long, s double").collect()  # two numbers for each row of the sample
    n, s = np.array([r["n"] for r in rows], float), np.array([r["s"] or 0.0 for r in rows])
    best = s[s > 0]
    if not len(best):
        return model.lam, 0.5 / max(1.0, n.sum())  # half a row stands for none
    rate = lambda lam: len(best) / max(1e-9, float((n * np.exp(-lam * s)).sum()))
    likelihood = lambda lam: len(best) * np.log(rate(lam) * lam) - lam * best.sum()
    lam = max(np.geomspace(0.05, 4, 200), key=likelihood)
    return float(lam), rate(lam)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Log-odds of tokens in toxic and clean training rows under an informative Dirichlet prior, the
    parameters of the extreme-value law from clean rows, then a logistic fit of the label on the
    evidence of the same rows. Near copies count once. The model holds every token that passes
    MIN_G2; each stands in several of the sample's rows, so the sample's bound bounds it."""
    import numpy as np

    rows = sample(docs, labels, "toxic", train_rows(), per_class)

    def keyed(batches):
        import pyarrow as pa

        for b in batches:
            keys = [_novelty(tokens(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), b.column(2)], names=["doc_id", "key", "label"])

    first = (rows.select("doc_id", "text", "label").mapInArrow(keyed, "doc_id long, key long, label int")
             .groupBy("key", "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    distinct = rows.join(F.broadcast(first), "doc_id")  # at most two per_class ids

    def counted(batches):
        from collections import Counter

        import pyarrow as pa

        for b in batches:
            n, d = (Counter(), Counter()), (Counter(), Counter())
            for t, y in zip(b.column(0), b.column(1)):
                words = tokens(t.as_py())
                n[y.as_py()].update(words)
                d[y.as_py()].update(set(words))
            names = list(set(n[0]) | set(n[1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array([c[w] for w in names], pa.int64()) for c in (n[0], n[1], d[0], d[1]))], names=["token", "n0", "n1", "d0", "d1"])

    counts = written(distinct.select("text", "label").mapInArrow(counted, "token binary, n0 long, n1 long, d0 long, d1 long")
                     .groupBy("token").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "d0", "d1"))), "toxic-counts")
    n0, n1 = counts.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    docs_of = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n0 or not n1:
        return Model(fit=(-4.0 if n0 or not n1 else 4.0, 0.0, 0.0))
    alpha = F.lit(PRIOR) * (F.col("n0") + F.col("n1")) / F.lit(float(n0 + n1))
    odds = lambda n, total: F.log((F.col(n) + alpha) / (F.lit(total + PRIOR) - F.col(n) - alpha))
    seen, rate = F.col("d0") + F.col("d1"), docs_of[1] / (docs_of[0] + docs_of[1])
    part = lambda n, share: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (seen * F.lit(share)))).otherwise(0.0)
    top = (counts.withColumn("w", odds("n1", n1) - odds("n0", n0))
           .withColumn("g2", 2 * (part("d1", rate) + part("d0", 1 - rate)))
           .where((F.col("g2") > MIN_G2) & (F.col("w") > 1))
           .orderBy(F.desc("g2"), "token").select("token", "w", "n0", "n1").collect())
    model = Model(weights={bytes(r["token"]): r["w"] for r in top})
    share1, share0 = sum(r["n1"] for r in top) / n1, sum(r["n0"] for r in top) / n0
    model.other = min(-1e-3, float(np.log1p(-min(share1, 0.5)) - np.log1p(-min(share0, 0.5))))
    if top:
        model.lam, model.k = extreme_value_law(distinct.where("label = 0"), model)
    known = evidence(rows, model).select("evidence", "n_segments", "label").collect()  # two per_class rows
    x = np.array([[1.0, r["evidence"], np.log1p(r["n_segments"])] for r in known])
    y = np.array([float(r["label"]) for r in known])
    model.fit = _logistic(x, y)
    if model.fit[2] < 0:  # more passages never make a text less toxic
        model.fit = (*_logistic(x[:, :2], y), 0.0)
    return model


def _logistic(x, y) -> tuple:
    import numpy as np

    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6, 1e-2, 1e-2][:x.shape[1]]) * max(1, len(y) / 100)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ beta)
    return tuple(float(b) for b in beta)


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """docs with evidence, n_segments and passages; columns of docs with these names give way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tokens of the bounded sample
    rows = docs.drop("evidence", "n_segments", "passages")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("evidence", T.DoubleType())]))
    added = [T.StructField("evidence", T.DoubleType()), T.StructField("n_segments", T.IntegerType()), T.StructField("passages", spans)]

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))
        for b in batches:
            got = [passages(t.as_py(), shared.value) for t in b.column("text")]
            cols = [pa.array([e for e, _ in got], pa.float64()), pa.array([len(s) for _, s in got], pa.int32()),
                    pa.array([[{"start": a, "end": z, "evidence": e} for a, z, e in s] for _, s in got], span)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "evidence", "n_segments", "passages"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score, predicted, n_segments and passages (token ranges); columns of
    docs with these names give way.

    Null and empty texts hold no passage and get the score of no evidence. Rows are scored one
    by one, so repeated rows agree. Without labels of both classes no token is toxic and the
    score is one constant. An empty table gives an empty result.
    """
    model = fit(docs, labels)
    b0, b1, b2 = model.fit
    prob = 1 / (1 + F.exp(-(F.lit(b0) + F.lit(b1) * F.col("evidence") + F.lit(b2) * F.log1p("n_segments"))))
    return (evidence(docs, model).withColumn("score", prob)
            .withColumn("held_out", ~train_rows()).withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0)))
