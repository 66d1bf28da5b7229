"""Conversation outcomes (I1-I6) and causal relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import in_blocks, sized, written

#: Tags that hold reasoning, in the order in which they are tried, and phrases that end an intake.
REASONING = ("think", "thinking", "reasoning", "analysis", "thought")
STOP = ("done", "finished", "no more", "that's all")


def transcripts(df: DataFrame) -> DataFrame:
    """conv_id, turns, transcript in order of turns."""
    line = F.concat_ws(": ", "role", F.coalesce("text", F.lit("")))
    return df.withColumn("line", line).groupBy("conv_id").agg(F.count("*").alias("turns"), F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY turn)").alias("transcript"))


def split_reasoning(text: Column, tags=REASONING) -> tuple[Column, Column]:
    """(reasoning, answer): of the first tag that occurs all matches are joined and taken out of the answer."""
    reasoning, answer = F.lit(""), F.trim(text)
    for t in reversed(tags):
        rx = f"(?is)<{t}>(.*?)</{t}>"
        hit = F.rlike(text, F.lit(rx))
        reasoning = F.when(hit, F.array_join(F.transform(F.regexp_extract_all(text, F.lit(rx), 1), lambda x: F.trim(x)), "\n")).otherwise(reasoning)
        answer = F.when(hit, F.trim(F.regexp_replace(text, rx, ""))).otherwise(answer)
    return reasoning, answer


def payload(text: Column) -> tuple[Column, Column]:
    """(json, status): first '{' to last '}'; 'complete' if it parses."""
    body = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return body, F.when(F.try_parse_json(body).isNotNull(), "complete").otherwise("error")


def outcomes(df: DataFrame, stop=STOP, least: int = 3) -> DataFrame:
    """Per conversation: the first user turn that is a stop phrase, user turns with text,
    whether it may be complete (`least` messages or more), and the first complaint."""
    text = F.trim(F.coalesce("text", F.lit("")))
    user = (F.col("role") == "user") & (text != "")
    ended = user & F.rtrim(F.lower(text), F.lit(".!")).isin(*stop)
    return df.groupBy("conv_id").agg(
        F.min(F.when(ended, F.col("turn"))).alias("stop_turn"), F.sum(user.cast("long")).alias("steps"),
        (F.count("*") >= least).alias("eligible"), F.min_by(F.when(user, text), F.when(user, F.col("turn"))).alias("complaint"))


RELATION = "ARRAY<STRUCT<causes: ARRAY<STRING>, logic: STRING, linguistic_probability_reference: STRING, effect: STRING>>"


def parse_relations(df: DataFrame, text: str) -> DataFrame:
    """Relations from a response: the fence goes, a lone object becomes a list; reason tells what was rejected."""
    body = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)^.*?```(?:json)?", ""), r"(?s)```.*$", ""))
    listed = F.when(F.startswith(body, F.lit("{")), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    parsed = F.from_json(listed, RELATION)
    return df.withColumn("relations", parsed).withColumn("reason", F.when(F.coalesce(F.size(parsed), F.lit(0)) < 1, "invalid"))


def explode_causes(df: DataFrame, key: str) -> DataFrame:
    """R2: (key, relation, pos, cause, effect, logic, term)."""
    r = df.select(key, F.posexplode_outer("relations").alias("relation", "r")).where("r is not null")
    return r.select(key, "relation", F.posexplode("r.causes").alias("pos", "cause"), F.col("r.effect").alias("effect"), F.col("r.logic").alias("logic"), F.col("r.linguistic_probability_reference").alias("term"))


def gate(logic: Column, n: Column, k: Column) -> Column:
    """Does a gate of n causes hold if k of them are true."""
    return (F.when(logic == "-", k == 1).when(logic == "NOT", k == 0).when(logic == "AND", k == n).when(logic == "OR", k >= 1).when(logic == "XOR", k == 1)
            .when(logic == "NAND", k < n).when(logic == "NOR", k == 0).when(logic == "NXOR", (k == 0) | (k == n)))


#: Gates that hold where none of their causes is found.
ABSENT = ("NOT", "NAND", "NOR", "NXOR")


def evaluate_gates(causes: DataFrame, findings: DataFrame, every: bool = False) -> DataFrame:
    """causes(relation, cause, logic, effect) over findings(entity, cause, flag) -> (entity, relation, effect, holds): whether a relation's gate
    holds, for each relation of which the entity shows a cause, and, of the other relations, those whose gate holds without any; with every, each relation for each entity. Absent findings are false.

    Causes meet findings by an equality join; only relations that hold without findings (with every, all) meet every entity, in blocks."""
    total = written(causes.groupBy("relation", "logic", "effect").agg(F.count("*").alias("n")), "relations")
    hit = findings.where("flag").select("entity", "cause").distinct().join(sized(causes.select("cause", "relation", "logic", "effect")), "cause").groupBy("entity", "relation", "logic", "effect").agg(F.count("*").alias("k"))
    hit = written(hit, "relations-hit")
    met = hit.join(sized(total), ["relation", "logic", "effect"]).select("entity", "relation", "effect", gate(F.col("logic"), F.col("n"), F.col("k")).alias("holds"))
    bare = F.coalesce(gate(F.col("logic"), F.col("n"), F.lit(0)), F.lit(False))
    none = in_blocks(findings.select("entity").distinct(), total.withColumn("bare", bare).where(F.lit(every) | F.col("logic").isin(*ABSENT) & F.col("bare")))
    rest = none.join(hit.select("entity", "relation", "logic", "effect").hint("shuffle_merge"), ["entity", "relation", "logic", "effect"], "left_anti")
    return met.unionByName(rest.select("entity", "relation", "effect", F.col("bare").alias("holds")))
