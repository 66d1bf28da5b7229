"""Quality rules: a threshold table compiled into one projection (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words, the word pattern, and the symbols that are counted.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Common function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or from at have an "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur se ce il elle avec "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es werden aus "
    "el los del las por con una su para al lo como más o pero sus si").split()
WINDOW = 5

#: metric, comparison that must hold, bound. A rule whose metric is null holds.
RULES = (
    ("mean_word_chars", ">=", 2.0),
    ("mean_word_chars", "<=", 15.0),
    ("symbol_ratio", "<=", 0.10),
    ("stop_ratio", ">=", 0.04),
    ("dup_line_ratio", "<=", 0.30),
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also when body uses it in inner functions."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows of `window` words found twice or more in the array."""
    def marked(runs: Column) -> Column:
        ordered = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(
            F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)), x["i"])), lambda i: i.isNotNull()))
        steps = lambda p: F.transform(p, lambda i, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - i, F.lit(window))))
        return let(let(ordered, twice), lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x))

    def counted(hashes: Column) -> Column:
        n = F.size(hashes)
        runs = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window)))
        return F.when(n < window, F.lit(0)).otherwise(
            let(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(marked(r))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), counted)


def compile_rules(rules=RULES) -> Column:
    """One boolean expression from a threshold table."""
    checks = [F.coalesce(F.col(m) >= F.lit(b) if op == ">=" else F.col(m) <= F.lit(b), F.lit(True)) for m, op, b in rules]
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def score(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the base counts, the ratios of the rules, base_failed and kept; one row per row.

    Null texts count as empty; an empty text has 0 words, null ratios, and fails the base rule.
    Lines that hold no word are never duplicates. Other columns are not read. A very long text is
    one row of one task, with an array of all its words.
    """
    text = F.coalesce("text", F.lit(""))
    counts = lambda t: let(F.regexp_extract_all(t, F.lit(WORD), 0), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).alias("n_stop"),
        repeated_words(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    base = docs.select(
        "doc_id", counts(text).alias("c"), line_counts.alias("l"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    flat = base.select("doc_id", "c.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "c.n_repeat_words", "c.n_stop", "l.n_lines")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return (flat.withColumn("base_failed", failed)
            .withColumns({"mean_word_chars": share("word_chars", "n_words"), "symbol_ratio": share("n_symbols", "word_chars"),
                          "stop_ratio": share("n_stop", "n_words"), "dup_line_ratio": share("n_dup_lines", "n_lines")})
            .withColumn("kept", ~F.col("base_failed") & compile_rules(rules)))
