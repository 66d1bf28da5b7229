"""The corpus pipeline: toxicity, near-duplicates, suffix-array dedup, mixing, encoding."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from quillmed.llm import bpe, mixing, simhash, suffix_dedup, toxicity
from quillmed.llm.store import drop, made, table, written

#: The columns of documents; the stages know no others.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def any_columns(stage):
    """A stage that keeps every other column of docs as it is: these go through under neutral names, so none meets a name that a stage uses itself."""
    @wraps(stage)
    def run(spark, docs, sf_dir):
        names = docs.columns
        plain = [c if c in COLUMNS else f"extra{k}" for k, c in enumerate(names)]
        return stage(spark, docs.toDF(*plain), sf_dir).toDF(*names)

    return run


@any_columns
def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity operator predicts to be toxic go; it learns from this stage's documents."""
    return toxicity.score(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


@any_columns
def one_of_each_group(spark, docs, sf_dir):
    """The document of smallest doc_id stays of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.representatives(docs, words=5, similarity=0.8)


@any_columns
def drop_repeated_passages(spark, docs, sf_dir):
    """Texts lose the bytes of strings that also start earlier; a text of which nothing is left goes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = suffix_dedup.dedup(docs, keep=others, chars=True).where("n_bytes = 0 or length(kept) > 0")
    out = kept.withColumn("text", F.decode("kept", "UTF-8"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@any_columns
def mix_sources(spark, docs, sf_dir):
    """A row for each pass over its source that takes words of a document, in the order of the schedule's slots."""
    return mixing.mixed(docs)


def encode(spark, docs, sf_dir):
    """doc_id, source, n_tokens, ids (little-endian 32-bit) and a digest of the decoded bytes."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["source"])
    return found.select("doc_id", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply STAGES in order to documents; each result is written and read again, and then the tables
    that the stage wrote on its way, and the result of the stage before, are deleted."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        start = len(made)
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(spark, before + made[start:-1])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
