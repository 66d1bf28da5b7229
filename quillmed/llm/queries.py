"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, lexical, mixing, quality_cnn, quality_rules, sharding, simhash, suffix_dedup, token_counts, topk, toxicity
from .store import table


def op1_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    found = quality_rules.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        *(F.round(c, 6).alias(c) for c in ("mean_word_chars", "symbol_ratio", "stop_ratio", "dup_line_ratio")))


def op3_token_counts(spark, sf_dir):
    """Counts before and after an edit in the middle of every text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    trees = token_counts.build(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    middle = (F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    edit = F.struct(middle.alias("start"), (middle + 12).alias("end"), F.concat(F.lit("edit of "), F.col("doc_id").cast("string")).alias("replacement"))
    return token_counts.recount(trees.withColumn("change", F.array(edit)), "change", path, public_tokenizers.PATTERN)


def op4_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
          FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op6_mixing(spark, sf_dir):
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op7_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality_cnn(spark, sf_dir):
    return quality_cnn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark, sf_dir):
    found = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_segments")


def op10_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
own AS (SELECT row, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM own),
tf AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(t) AS term FROM own) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
           FROM asked JOIN weight USING (term) JOIN tf USING (term), whole GROUP BY item_id, row, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op12_decontamination(spark, sf_dir):
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
w AS (SELECT DISTINCT item_id, least(10, len(t)) AS k, array_to_string(t[i:i + least(10, len(t)) - 1], ' ') AS win
      FROM (SELECT item_id, t, unnest(range(1, greatest(len(t) - 9, 1) + 1)) AS i FROM b WHERE len(t) > 0)),
ks AS (SELECT DISTINCT k FROM w),
spots AS (SELECT row, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM d, ks WHERE len(t) >= k),
hits AS (SELECT row, i, spots.k AS k, item_id FROM spots JOIN w ON spots.k = w.k AND array_to_string(t[i:i + spots.k - 1], ' ') = win),
words AS (SELECT row, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS j FROM hits) GROUP BY row),
items AS (SELECT row, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""


def op13_alignment(spark, sf_dir):
    import public_tokenizers

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), *paths, texts=False).withColumnRenamed("groups", "groups_sha256")


def queries() -> dict:
    return {"op1_sharding": op1_sharding, "op2_quality_rules": op2_quality_rules, "op3_token_counts": op3_token_counts, "op4_suffix_dedup": op4_suffix_dedup, "op5_top_k": op5_top_k, "op6_mixing": op6_mixing, "op7_simhash": op7_simhash, "op8_quality_cnn": op8_quality_cnn, "op9_toxicity": op9_toxicity, "op10_bpe": op10_bpe,
            "op11_lexical_search": op11_lexical_search, "op12_decontamination": op12_decontamination, "op13_alignment": op13_alignment}


def oracle_sql() -> dict[str, str]:
    return {"op5_top_k": OP5_SQL, "op11_lexical_search": OP11_SQL, "op12_decontamination": OP12_SQL}
