"""Sources and sinks (S1-S9): every scan has an explicit schema, so no pass is spent on inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METADATA = """`Test Name` STRING, sex STRING, normal_low DOUBLE, normal_high DOUBLE, normal_unit STRING, normal_comp STRING, normal_change_low DOUBLE, normal_change_high DOUBLE,
 normal_change_unit STRING, normal_change_time_days DOUBLE, normal_change_per_day_low DOUBLE, normal_change_per_day_high DOUBLE, sharp_change_parsed STRING, sharp_change_aggregated_low DOUBLE, sharp_change_aggregated_high DOUBLE"""
FACT = """graph_type STRING, entities ARRAY<STRUCT<id: STRING, name: STRING, type: STRING>>, facts ARRAY<STRUCT<id: STRING, predicate: STRING, timestamp: STRING, truth_value: STRING, sentence_id: STRING,
 tuple: ARRAY<STRUCT<role: STRING, entity: STRING, literal: STRING, value: STRING, val: STRING, amount: STRING, datatype: STRING, type: STRING>>, arguments: ARRAY<STRING>>>, metadata STRUCT<sentence_id: STRING, source_sentence: STRING>"""


def read_wide_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All strings; quoted cells may hold line breaks and doubled quotes."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=", ".join(f"`{c}` STRING" for c in columns), enforceSchema=False)


def read_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed bounds; sex in title case, 'Both' where it is blank."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=METADATA, enforceSchema=False)
    sex = F.coalesce(F.nullif(F.initcap(F.trim("sex")), F.lit("")), F.lit("Both"))
    return raw.withColumn("sex", sex).withColumnRenamed("Test Name", "test")


def read_graph_json(spark: SparkSession, path: str, schema: str = FACT) -> DataFrame:
    """S3: one graph fragment per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_documents(docs: DataFrame, path: str) -> None:
    """docs(path, text) as files of many documents, each a line of JSON with its path, as S4 reads bundles: a file for each document costs far more than its text."""
    docs.select("path", "text").write.mode("overwrite").json(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """S4 of bundled documents: (path, text), one row per document, whatever bytes its text holds; a null text stays null."""
    return spark.read.schema("path STRING, text STRING").json(path)


def parse_tsv(lines: DataFrame, key: list[str], order: str) -> DataFrame:
    """Annotation lines (key, order, line) to sentences and tokens: key, sent_no, sentence,
    pos, span (offsets), token, tag. A '#Text=' line opens a sentence, other '#' lines and lines of fewer than four cells are skipped, trailing tabs dropped."""
    w = Window.partitionBy(*key).orderBy(order)
    head = F.startswith(F.col("line"), F.lit("#Text="))
    marked = lines.withColumn("sent_no", F.sum(head.cast("int")).over(w))
    marked = marked.withColumn("sentence", F.last(F.when(head, F.substring("line", 7, 1 << 30)), ignorenulls=True).over(w))
    cells = marked.where(~F.startswith(F.col("line"), F.lit("#"))).withColumn("c", F.split(F.regexp_replace("line", r"\t+$", ""), "\t")).where("size(c) >= 4 and sent_no > 0")
    pos = F.row_number().over(Window.partitionBy(*key, "sent_no").orderBy(order)) - 1
    return cells.select(*key, "sent_no", "sentence", pos.alias("pos"), F.col("c")[1].alias("span"), F.col("c")[2].alias("token"), F.col("c")[3].alias("tag"))


def read_tsv_sentences(spark: SparkSession, path: str) -> DataFrame:
    """S5 over files, a row for each sentence: path, doc (of the '#Doc=' line above, null without one), sent_no, sentence and tokens, an array of (span, token, tag). Lines are parse_tsv's, but
    a file is cut into documents, sentences and lines inside its row, where they stand in order: nothing is shuffled or sorted. Sentences of a document that a file names twice are numbered on."""
    first = lambda c: F.regexp_replace(F.substring_index(c, "\n", 1), r"\r\z", "")
    sections = F.transform(F.split(F.concat(F.lit("\n"), "text"), "\r?\n#Doc="), lambda s, k: F.struct(F.when(k > 0, first(s)).alias("doc"), F.split(s, "\r?\n#Text=").alias("sentences")))
    docs = read_documents(spark, path).select("path", sections.alias("s"))
    names = F.transform("s", lambda x: x["doc"])
    above = F.transform("s", lambda x, k: F.aggregate(F.slice("s", F.lit(1), k), F.lit(0), lambda n, y: n + F.when(y["doc"] == x["doc"], F.size(y["sentences"]) - 1).otherwise(0)))
    docs = docs.withColumn("above", F.when(F.size(F.array_distinct(names)) < F.size("s"), above))
    one = docs.select("path", F.posexplode_outer("s").alias("k", "s"), "above").select("path", "s.doc", F.coalesce(F.get("above", F.col("k")), F.lit(0)).alias("above"), F.posexplode_outer("s.sentences").alias("i", "text"))
    lines = one.where("i > 0").select("path", "doc", (F.col("above") + F.col("i")).alias("sent_no"), F.split("text", "\r?\n").alias("lines"))
    full = lambda x: F.when(F.endswith(x, F.lit("\t")), F.regexp_replace(x, r"\t+$", "")).otherwise(x)
    cells = F.filter(F.transform(F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda x: ~F.startswith(x, F.lit("#"))), lambda x: F.split(full(x), "\t")), lambda c: F.size(c) >= 4)
    return lines.select("path", "doc", "sent_no", F.get("lines", F.lit(0)).alias("sentence"),
                        F.explode_outer(F.array(F.transform(cells, lambda c: F.struct(c[1].alias("span"), c[2].alias("token"), c[3].alias("tag"))))).alias("tokens"))  # made once, though filters look at its size


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """S5 over files: path, doc and the columns of parse_tsv, a row for each token."""
    s = read_tsv_sentences(spark, path).select("path", "doc", "sent_no", "sentence", F.posexplode_outer("tokens").alias("pos", "t")).where("t is not null")
    return s.select("path", "doc", "sent_no", "sentence", "pos", "t.span", "t.token", "t.tag")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """S6."""
    return spark.read.csv(path, sep="\t", schema="head STRING, relation STRING, tail STRING", quote="")


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] = (), header: bool = True) -> None:
    """Csv, tsv, json or parquet, by partition columns if given. Cells of csv may hold quotes and line breaks, cells of tsv none."""
    w = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    {"csv": lambda: w.csv(path, header=header, escape='"'), "tsv": lambda: w.csv(path, header=header, sep="\t", quote=""), "json": lambda: w.json(path), "parquet": lambda: w.parquet(path)}[kind]()


def tsv_lines(tokens: DataFrame) -> DataFrame:
    """Tokens (doc_id, sent_id, sentence, pos, token, start, end, tag) as annotation lines (doc_id, sent_id, k, line): a text line, one line per token, a blank line."""
    body = tokens.select("doc_id", "sent_id", (F.col("pos") + 1).alias("k"), F.concat_ws("\t", F.concat_ws("-", F.col("sent_id") + 1, F.col("pos") + 1), F.concat_ws("-", "start", "end"), "token", "tag").alias("line"))
    edge = tokens.groupBy("doc_id", "sent_id").agg(F.first("sentence").alias("sentence"), F.max("pos").alias("last"))
    head = edge.select("doc_id", "sent_id", F.lit(0).alias("k"), F.concat(F.lit("#Text="), "sentence").alias("line"))
    tail = edge.select("doc_id", "sent_id", (F.col("last") + 2).alias("k"), F.lit("").alias("line"))
    return reduce(DataFrame.unionByName, [head, body, tail])


#: Documents of an annotation file, by expectation: a file is read whole.
DOCUMENTS = 500


def tsv_block(sent_id: Column, sentence: Column, tokens: Column, tags: Column) -> Column:
    """S8 inside a row: the lines of a sentence with its arrays of tokens (token, start, end) and tags, as one text."""
    body = F.zip_with(F.transform(tokens, lambda t, k: F.struct(t.alias("t"), k.alias("k"))), tags, lambda t, tag: F.concat_ws("\t", F.concat_ws("-", sent_id + 1, t["k"] + 1), F.concat_ws("-", t["t"]["start"], t["t"]["end"]), t["t"]["token"], tag))
    return F.array_join(F.concat(F.array(F.concat(F.lit("#Text="), sentence)), body, F.array(F.lit(""))), "\n")


def write_tsv(tokens: DataFrame, path: str, documents: int = DOCUMENTS) -> None:
    """Files of some `documents` documents, in order; a document lies in one file, under a line '#Doc=' with its id."""
    write_tsv_lines(tsv_lines(tokens), path, documents)


def write_tsv_lines(lines: DataFrame, path: str, documents: int = DOCUMENTS) -> None:
    """S8 of lines (doc_id, sent_id, k, line); a line may be a whole sentence's block."""
    names = lines.select("doc_id").distinct().select("doc_id", F.lit(-1).alias("sent_id"), F.lit(0).alias("k"), F.concat(F.lit("#Doc="), F.col("doc_id").cast("string")).alias("line"))
    files = max(1, -(-lines.select(F.approx_count_distinct("doc_id")).first()[0] // documents))
    lines.unionByName(names).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "sent_id", "k").select("line").write.mode("overwrite").text(path)


#: A Python task is handed so many bytes of sentences at a time.
BATCH_BYTES, MOST_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _blocks(batches):
    """Texts of sentences: a line with the sentence (under one with the document, for its first), one for each token, a blank one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    shown = lambda numbers: pa.array(numbers).cast(pa.string())
    for b in batches:
        pieces, starts = b.column("pieces").flatten(), b.column("pieces").offsets.to_numpy()
        starts = starts - starts[0]
        of = np.repeat(np.arange(len(b)), np.diff(starts))
        n = pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n)
        before = np.concatenate(([0], ends))[starts[:-1]]
        at = ends - n - before[of] + b.column("base").to_numpy(zero_copy_only=False)[of]
        token = ~pc.is_in(pc.utf8_slice_codeunits(pieces, 0, 1), value_set=pa.array(list(" \t\n\x0b\f\r"))).to_numpy(zero_copy_only=False)
        count = np.concatenate(([0], np.cumsum(token)))
        kept = count[starts]
        pos, of, keep = count[1:][token] - kept[of[token]], of[token], pa.array(token)
        number = b.column("sent_id").to_numpy(zero_copy_only=False)[of] + 1
        lines = pc.binary_join_element_wise(shown(number), "-", shown(pos), "\t", shown(at[token]), "-", shown((at + n)[token]), "\t", pieces.filter(keep), "\t", b.column("tags").flatten().filter(keep), "\n", "")
        body = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), lines), "")
        doc = pc.binary_join_element_wise("#Doc=", pc.fill_null(b.column("doc_id").cast(pa.string()), ""), "\n", "")
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pc.if_else(pc.equal(b.column("sent_id"), 0), doc, ""), "#Text=", b.column("sentence"), "\n", body, "")], names=["line"])


def write_tsv_sentences(sents: DataFrame, path: str) -> None:
    """S8 of whole documents: sents (doc_id, sent_id, sentence, base, pieces, tags) dealt by document, pieces being what makes a sentence up, tokens and blanks, with a tag for each, and base the place of the sentence in its
    document. A task writes a file of its documents under a line '#Doc=' each, every sentence (numbered from 0) with a line for each token."""
    spark = sents.sparkSession
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(MOST_BATCH_BYTES))
    try:
        sents.select("doc_id", "sent_id", "sentence", "base", "pieces", "tags").sortWithinPartitions("doc_id", "sent_id").mapInArrow(_blocks, "line string").write.mode("overwrite").text(path)
    finally:
        spark.conf.set(BATCH_BYTES, before)


def child_key(*cols: Column) -> Column:
    """A stable id for an unnamed node or link: a hash of its content."""
    return F.concat(F.lit("anon_"), F.substring(F.md5(F.concat_ws("|", *cols)), 1, 12))


def write_graph_json(fragments: DataFrame, path: str, key: str) -> None:
    """One file for each fragment, as S3 reads them."""
    body = F.to_json(F.struct(*(c for c in fragments.columns if c != key)))
    fragments.select(key, body.alias("value")).repartition(key).write.mode("overwrite").partitionBy(key).text(path)


def export_nodes(nodes: DataFrame) -> DataFrame:
    """nodes(doc, id, type, name, truth_value) as table rows with the truth value's strength and confidence; a node without an id gets one from its content."""
    return nodes.select("doc", F.coalesce("id", child_key(F.col("type"), F.coalesce("name", F.lit("")))).alias("id"), "type", "name", F.get("truth_value", F.lit(0)).alias("tv_strength"), F.get("truth_value", F.lit(1)).alias("tv_confidence"))


def export_links(links: DataFrame, sep: str = "|") -> DataFrame:
    """links(doc, id, link_type, name, children) as table rows with joined child ids; a link without an id gets one from its content."""
    joined = F.array_join("children", sep)
    return links.select("doc", F.coalesce("id", child_key(F.col("link_type"), F.coalesce("name", F.lit("")), joined)).alias("id"), "link_type", "name", joined.alias("children"))
