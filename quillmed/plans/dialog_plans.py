"""Queries I1-I6, R1-R3 and X1-X3 (batch runs of the streaming jobs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmed.operators import dialog as I

from .base import query, rows, table

CONV = """SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn > 1 AND conv_id % 3 = 0 THEN 'Done.' WHEN role = 'user' AND conv_id % 7 = 0 AND turn = 0 THEN ' ' WHEN role = 'assistant' AND conv_id % 4 = 0 THEN '<think> a' || turn || ' </think>' || text || '<think>b</think>'
 WHEN role = 'assistant' AND conv_id % 4 = 1 THEN text || ' {"turn": ' || turn || CASE WHEN turn % 4 = 1 THEN '' ELSE '}' END ELSE text END AS text FROM conversations"""


def conversations(spark, sf_dir):
    t, c, r = F.col("turn"), F.col("conv_id"), F.col("role")
    text = (F.when((r == "user") & (t > 1) & (c % 3 == 0), "Done.").when((r == "user") & (c % 7 == 0) & (t == 0), " ")
            .when((r == "assistant") & (c % 4 == 0), F.concat(F.lit("<think> a"), t.cast("string"), F.lit(" </think>"), F.col("text"), F.lit("<think>b</think>")))
            .when((r == "assistant") & (c % 4 == 1), F.concat(F.col("text"), F.lit(' {"turn": '), t.cast("string"), F.when(t % 4 == 1, "").otherwise("}"))).otherwise(F.col("text")))
    return table(spark, sf_dir, "conversations").withColumn("text", text)


@query("i01_transcripts", f"SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM ({CONV}) GROUP BY conv_id")
def i01(spark, sf_dir):
    return I.transcripts(conversations(spark, sf_dir))


@query("i02_split_reasoning", f"""
SELECT conv_id, turn, CASE WHEN text LIKE '<think>%' THEN 'a' || turn || chr(10) || 'b' ELSE '' END AS reasoning, CASE WHEN text LIKE '<think>%' THEN trim(regexp_replace(text, '<think>.*?</think>', '', 'g')) ELSE trim(text) END AS answer FROM ({CONV})""")
def i02(spark, sf_dir):
    reasoning, answer = I.split_reasoning(F.col("text"))
    return conversations(spark, sf_dir).select("conv_id", "turn", reasoning.alias("reasoning"), answer.alias("answer"))


@query("i03_payload", f"""
SELECT conv_id, turn, json, CASE WHEN json IS NOT NULL AND json_valid(json) THEN 'complete' ELSE 'error' END AS status FROM (SELECT *, nullif(regexp_extract(text, '\\{{.*\\}}', 0, 's'), '') AS json FROM ({CONV}))""")
def i03(spark, sf_dir):
    body, status = I.payload(F.col("text"))
    return conversations(spark, sf_dir).select("conv_id", "turn", body.alias("json"), status.alias("status"))


OUT = f"""SELECT conv_id, min(turn) FILTER (WHERE u AND rtrim(lower(trim(text)), '.!') IN ('done', 'finished', 'no more', 'that''s all')) AS stop_turn, count(*) FILTER (WHERE u) AS steps, count(*) >= 3 AS eligible, min_by(trim(text), turn) FILTER (WHERE u) AS complaint
 FROM (SELECT *, role = 'user' AND trim(text) <> '' AS u FROM ({CONV})) GROUP BY conv_id"""


@query("i04_stop_turn", f"SELECT conv_id, stop_turn FROM ({OUT})")
def i04(spark, sf_dir):
    return I.outcomes(conversations(spark, sf_dir)).select("conv_id", "stop_turn")


@query("i05_steps", f"SELECT conv_id, steps, eligible FROM ({OUT})")
def i05(spark, sf_dir):
    return I.outcomes(conversations(spark, sf_dir)).select("conv_id", "steps", "eligible")


@query("i06_complaint", f"SELECT conv_id, complaint FROM ({OUT})")
def i06(spark, sf_dir):
    return I.outcomes(conversations(spark, sf_dir)).select("conv_id", "complaint")


def responses(spark, sf_dir):
    k = F.col("event_id") % 4
    obj = F.format_string('{"causes": ["%s", "u%d"], "logic": "AND", "linguistic_probability_reference": "likely (often)", "effect": "e"}', "event_type", "user_id")
    text = F.when(k == 0, F.concat(F.lit("Here:\n```json\n["), obj, F.lit("]\n```\nbye"))).when(k == 1, obj).when(k == 2, "nothing").otherwise(F.concat(F.lit("["), obj, F.lit(","), obj, F.lit("]")))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query("r01_parse_relations", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS n, CASE WHEN event_id % 4 = 2 THEN 'invalid' END AS reason FROM events")
def r01(spark, sf_dir):
    r = I.parse_relations(responses(spark, sf_dir), "text")
    return r.select("event_id", F.when(F.col("reason").isNull(), F.size("relations")).otherwise(0).alias("n"), "reason")


@query("r02_explode_causes", """
SELECT event_id, r::INTEGER AS relation, p::INTEGER AS pos, CASE p WHEN 0 THEN event_type ELSE 'u' || user_id END AS cause, 'e' AS effect, 'AND' AS logic, 'likely (often)' AS term FROM events, (VALUES (0), (1)) x(r), (VALUES (0), (1)) y(p) WHERE event_id % 4 <> 2 AND (r = 0 OR event_id % 4 = 3)""")
def r02(spark, sf_dir):
    return I.explode_causes(I.parse_relations(responses(spark, sf_dir), "text").where("reason is null"), "event_id")


RULES = (("r1", "click", "AND", "x"), ("r1", "view", "AND", "x"), ("r2", "click", "XOR", "y"), ("r2", "error", "XOR", "y"), ("r3", "signup", "NOT", "z"), ("r4", "view", "NXOR", "w"), ("r4", "error", "NXOR", "w"), ("r5", "purchase", "-", "v"), ("r6", "view", "NAND", "s"), ("r6", "signup", "NAND", "s"), ("r7", "view", "NOR", "t"), ("r7", "click", "NOR", "t"), ("r8", "error", "OR", "q"), ("r8", "click", "OR", "q"))
RULES_SQL = "(VALUES " + ", ".join(str(r) for r in RULES) + ") AS c(relation, cause, logic, effect)"


@query("r03_evaluate_gates", f"""
WITH f AS (SELECT user_id AS entity, event_type AS cause, max(value) > 120 AS flag FROM events GROUP BY ALL), k AS (SELECT e.entity, c.relation, any_value(c.logic) AS logic, any_value(c.effect) AS effect, count(*) AS n, count(*) FILTER (WHERE f.flag) AS k FROM (SELECT DISTINCT entity FROM f) e CROSS JOIN {RULES_SQL} LEFT JOIN f ON f.entity = e.entity AND f.cause = c.cause GROUP BY ALL)
SELECT entity, relation, effect, CASE logic WHEN '-' THEN k = 1 WHEN 'NOT' THEN k = 0 WHEN 'AND' THEN k = n WHEN 'OR' THEN k >= 1 WHEN 'XOR' THEN k = 1 WHEN 'NAND' THEN k < n WHEN 'NOR' THEN k = 0 ELSE k = 0 OR k = n END AS holds FROM k""")
def r03(spark, sf_dir):
    f = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("cause")).agg((F.max("value") > 120).alias("flag"))
    return I.evaluate_gates(rows(spark, "relation string, cause string, logic string, effect string", *RULES), f, every=True)
