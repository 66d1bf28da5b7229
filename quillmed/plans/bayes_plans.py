"""Queries G1-G10 over orders, customers and expert tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmed.operators import bayes as G

from .base import query, rows, table

CODES = {"F": "filled", "O": "open"}
DATA = "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS status, o_orderpriority AS priority, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey"


def data(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", G.encode(F.col("o_orderstatus"), CODES).alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"))


USED = f"SELECT * FROM ({DATA}) WHERE status IS NOT NULL AND NOT (segment = 'MACHINERY' AND priority = '5-LOW')"
FIT = f"""SELECT segment, priority, status, CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 1 / count(*) OVER w END AS p FROM (SELECT g.*, coalesce(c.n, 0) AS n FROM
 (SELECT * FROM (SELECT DISTINCT segment FROM ({USED})), (SELECT DISTINCT priority FROM ({USED})), (SELECT DISTINCT status FROM ({USED}))) g LEFT JOIN (SELECT segment, priority, status, count(*) AS n FROM ({USED}) GROUP BY ALL) c USING (segment, priority, status)) WINDOW w AS (PARTITION BY segment, priority)"""


def used(spark, sf_dir):
    return data(spark, sf_dir).where("status is not null and not (segment = 'MACHINERY' and priority = '5-LOW')")


@query("g01_encode", f"SELECT o_orderkey, status FROM ({DATA})")
def g01(spark, sf_dir):
    return data(spark, sf_dir).select("o_orderkey", "status")


@query("g02_fit", f"SELECT segment, priority, status, round(p, 9) AS p FROM ({FIT})")
def g02(spark, sf_dir):
    return G.fit(used(spark, sf_dir), "status", ["segment", "priority"]).select("segment", "priority", "status", F.round("p", 9).alias("p"))


#: An expert network of five variables as rows (variable's state and its parents' states, p).
AGE = (("young", 0.6), ("old", 0.4))
SMOKE = (("young", "yes", 0.3), ("young", "no", 0.7), ("old", "yes", 0.4), ("old", "no", 0.6))
HEART = tuple((a, s, h, p if h == "ill" else round(1 - p, 6)) for a, s, p in (("young", "yes", 0.15), ("young", "no", 0.05), ("old", "yes", 0.5), ("old", "no", 0.25)) for h in ("ill", "well"))
PAIN = (("ill", "yes", 0.8), ("ill", "no", 0.2), ("well", "yes", 0.1), ("well", "no", 0.9))
ECG = (("ill", "abnormal", 0.7), ("ill", "normal", 0.3), ("well", "abnormal", 0.2), ("well", "normal", 0.8))


def _values(data, names):
    vals = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in data)
    return f"(SELECT {', '.join(names[:-1])}, p::DOUBLE AS p FROM (VALUES {vals}) t({', '.join(names)}))"


TABLES = {"age": (AGE, ["age", "p"]), "smoke": (SMOKE, ["age", "smoke", "p"]), "heart": (HEART, ["age", "smoke", "heart", "p"]), "pain": (PAIN, ["heart", "pain", "p"]), "ecg": (ECG, ["heart", "ecg", "p"])}
JOINT = ("SELECT a.age, s.smoke, h.heart, q.pain, e.ecg, a.p * s.p * h.p * q.p * e.p AS p FROM " + _values(*TABLES["age"]) + " a JOIN " + _values(*TABLES["smoke"]) + " s ON a.age = s.age JOIN "
         + _values(*TABLES["heart"]) + " h ON a.age = h.age AND s.smoke = h.smoke JOIN " + _values(*TABLES["pain"]) + " q ON q.heart = h.heart JOIN " + _values(*TABLES["ecg"]) + " e ON e.heart = h.heart")


def network(spark) -> dict:
    return {k: rows(spark, ", ".join(f"{n} {'double' if n == 'p' else 'string'}" for n in names), *vals) for k, (vals, names) in TABLES.items()}


def expert_joint(spark):
    return G.joint(list(network(spark).values()))


#: Evidence rows come from the orders table, so the work follows its size.
EVID = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'old' WHEN 'O' THEN 'None' END AS age, CASE WHEN o_orderkey % 3 = 0 THEN 'yes' WHEN o_orderkey % 3 = 1 THEN ' ' END AS smoke, CASE WHEN o_orderkey % 5 < 2 THEN 'yes' WHEN o_orderkey % 5 = 2 THEN 'no' END AS pain FROM orders"""


def evidence(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "old").when(F.col("o_orderstatus") == "O", "None").alias("age"),
                                                 F.when(k % 3 == 0, "yes").when(k % 3 == 1, " ").alias("smoke"), F.when(k % 5 < 2, "yes").when(k % 5 == 2, "no").alias("pain"))


CLEAN = f"SELECT o_orderkey, nullif(nullif(trim(age), ''), 'None') AS age, nullif(nullif(trim(smoke), ''), 'None') AS smoke, nullif(nullif(trim(pain), ''), 'None') AS pain FROM ({EVID})"


def score_sql(joint: str) -> str:
    return f"""SELECT o_orderkey, variable, state, sum(p) / sum(sum(p)) OVER (PARTITION BY o_orderkey, variable) AS p FROM (SELECT c.o_orderkey, unnest(['age', 'smoke', 'heart', 'pain', 'ecg']) AS variable, unnest([j.age, j.smoke, j.heart, j.pain, j.ecg]) AS state, j.p FROM ({CLEAN}) c JOIN ({joint}) j
 ON (c.age IS NULL OR c.age = j.age) AND (c.smoke IS NULL OR c.smoke = j.smoke) AND (c.pain IS NULL OR c.pain = j.pain)) GROUP BY o_orderkey, variable, state"""


@query("g03_expert_tables", f"SELECT o.o_orderkey, h.heart, h.p FROM (SELECT * FROM ({CLEAN}) WHERE age IS NOT NULL AND smoke IS NOT NULL) o JOIN {_values(*TABLES['heart'])} h ON o.age = h.age AND o.smoke = h.smoke")
def g03(spark, sf_dir):
    e = G.clean_evidence(evidence(spark, sf_dir), ["age", "smoke", "pain"])
    return e.join(F.broadcast(network(spark)["heart"]), ["age", "smoke"]).select("o_orderkey", "heart", "p")


#: A table with faults: a combination without rows, one state missing, one probability wrong.
@query("g04_validate", f"""SELECT segment, priority, round(sum(p), 9) AS total, count(status) AS states, abs(sum(p) - 1) < 1e-6 AND count(status) = 2 AS valid FROM (
 SELECT segment, priority, status, CASE WHEN segment = 'FURNITURE' AND status = 'open' THEN p + 0.5 ELSE p END AS p FROM ({FIT}) WHERE NOT (segment = 'BUILDING' AND priority = '1-URGENT') AND NOT (segment = 'MACHINERY' AND status = 'open' AND priority <> '5-LOW')) GROUP BY segment, priority
UNION ALL SELECT DISTINCT segment, priority, NULL::DOUBLE, 0, false FROM ({FIT}) WHERE segment = 'BUILDING' AND priority = '1-URGENT'""")
def g04(spark, sf_dir):
    u = used(spark, sf_dir)
    cpt = G.fit(u, "status", ["segment", "priority"])
    bad = cpt.where("not (segment = 'BUILDING' and priority = '1-URGENT') and not (segment = 'MACHINERY' and status = 'open' and priority <> '5-LOW')")
    bad = bad.withColumn("p", F.when((F.col("segment") == "FURNITURE") & (F.col("status") == "open"), F.col("p") + 0.5).otherwise(F.col("p")))
    missing = G.uncovered(bad, {"segment": u.select("segment").distinct(), "priority": u.select("priority").distinct()})
    lost = missing.select("segment", "priority", F.lit(None).cast("double").alias("total"), F.lit(0).cast("long").alias("states"), F.lit(False).alias("valid"))
    return G.validate(bad, "status", ["segment", "priority"], 2).select(*lost.columns).unionByName(lost)


FITTED = f"""SELECT s.segment, q.priority, f.status, s.p * q.p * f.p AS p FROM (SELECT segment, count(*) / sum(count(*)) OVER () AS p FROM ({USED}) GROUP BY segment) s JOIN (SELECT segment, priority, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY segment) AS p FROM
 (SELECT * FROM (SELECT DISTINCT segment FROM ({USED})), (SELECT DISTINCT priority FROM ({USED}))) LEFT JOIN (SELECT segment, priority, count(*) AS n FROM ({USED}) GROUP BY ALL) USING (segment, priority)) q ON s.segment = q.segment JOIN ({FIT}) f ON f.segment = s.segment AND f.priority = q.priority"""


def fitted(spark, sf_dir):
    u = used(spark, sf_dir)
    return G.joint([G.fit(u, "segment"), G.fit(u, "priority", ["segment"]), G.fit(u, "status", ["segment", "priority"])])


@query("g05_marginals", f"SELECT variable, state, round(sum(p), 9) AS p FROM (SELECT unnest(['segment', 'priority', 'status']) AS variable, unnest([segment, priority, status]) AS state, p FROM ({FITTED})) GROUP BY ALL")
def g05(spark, sf_dir):
    return G.marginals(fitted(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query("g06_posterior", f"SELECT segment AS state, round(sum(p) / sum(sum(p)) OVER (), 9) AS p FROM ({FITTED}) WHERE status = 'open' AND priority = '1-URGENT' GROUP BY segment")
def g06(spark, sf_dir):
    return G.posterior(fitted(spark, sf_dir), "segment", {"status": "open", "priority": "1-URGENT"}).withColumn("p", F.round("p", 9))


@query("g07_score", f"SELECT o_orderkey, variable, state, round(p, 9) AS p FROM ({score_sql(JOINT)})")
def g07(spark, sf_dir):
    return G.score(evidence(spark, sf_dir), "o_orderkey", ["age", "smoke", "pain"], expert_joint(spark)).select("o_orderkey", "variable", "state", F.round("p", 9).alias("p"))


OTHER = (("young", 0.1), ("old", 0.9))


@query("g08_override_priors", f"SELECT o_orderkey, state, round(p, 9) AS p FROM ({score_sql(JOINT.replace(_values(*TABLES['age']), _values(OTHER, ['age', 'p'])))}) WHERE variable = 'heart'")
def g08(spark, sf_dir):
    n = G.override_priors(network(spark), {"age": rows(spark, "age string, p double", *OTHER)})
    s = G.score(evidence(spark, sf_dir), "o_orderkey", ["age", "smoke", "pain"], G.joint(list(n.values())))
    return s.where("variable = 'heart'").select("o_orderkey", "state", F.round("p", 9).alias("p"))


@query("g08_row_priors", f"SELECT o_orderkey, variable, state, round(p, 9) AS p FROM ({score_sql(JOINT)}) WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, variable, state, round(p, 9) FROM ({score_sql(JOINT.replace(_values(*TABLES['age']), _values(OTHER, ['age', 'p'])))}) WHERE o_orderkey % 2 <> 0")
def g08_rows(spark, sf_dir):
    own = F.create_map(*(F.lit(x) for kv in OTHER for x in kv))
    e = evidence(spark, sf_dir).withColumn("prior", F.when(F.col("o_orderkey") % 2 != 0, own))
    return G.score_with_priors(e, "o_orderkey", ["age", "smoke", "pain"], network(spark), {"age": "prior"}).select("o_orderkey", "variable", "state", F.round("p", 9).alias("p"))


@query("g09_clean_evidence", CLEAN)
def g09(spark, sf_dir):
    return G.clean_evidence(evidence(spark, sf_dir), ["age", "smoke", "pain"])


COMBOS = ("BUILDING/1-URGENT", "HOUSEHOLD/5-LOW")


@query("g10_present", "SELECT status, " + ", ".join(f"max(round(p, 3)) FILTER (WHERE segment || '/' || priority = '{c}') AS \"{c}\"" for c in COMBOS) + f" FROM ({FIT}) GROUP BY status")
def g10(spark, sf_dir):
    return G.present(G.fit(used(spark, sf_dir), "status", ["segment", "priority"]), "status", ["segment", "priority"], list(COMBOS))
