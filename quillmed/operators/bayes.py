"""Discrete Bayesian networks as tables (G1-G10). A table of a variable has one column per parent, the variable's own column, and p."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reach import on_cycles
from .store import sized, written


def encode(c: Column, codes: dict[str, str]) -> Column:
    """G1: categories by a map; unknown ones are null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), c)


def states_grid(counts: DataFrame, columns: list[str]) -> DataFrame:
    """Every combination of the columns' states: lists of states are constants of the plan, exploded one after the other."""
    spark, out = counts.sparkSession, None
    for c in columns:
        states = counts.agg(F.array_sort(F.collect_set(c)).alias("s"))  # the states of one variable
        out = states.select(F.explode("s").alias(c)) if out is None else out.select("*", F.explode(states.scalar()).alias(c)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return out


def fit(df: DataFrame, variable: str, parents: list[str] = ()) -> DataFrame:
    """P(variable | parents) by counts over the full grid of observed states; a combination of
    parent states without rows gets the uniform distribution. Counting combines before the shuffle; all that follows has a row per combination of states."""
    parents = list(parents)
    used = df.dropna(subset=[variable, *parents])
    counts = written(used.groupBy(*parents, variable).agg(F.count("*").alias("n")), "cpt-counts")
    grid = states_grid(counts, [variable, *parents])
    full = grid.join(counts.hint("shuffle_merge"), [*parents, variable], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    total = F.sum("n").over(w)
    return full.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(1 / F.count("*").over(w))).drop("n")


def validate(cpt: DataFrame, variable: str, parents: list[str], states: int) -> DataFrame:
    """Per parent combination: the sum of p, the number of states, and whether both are as they should be."""
    g = cpt.groupBy(*parents) if parents else cpt.groupBy()
    return g.agg(F.round(F.sum("p"), 9).alias("total"), F.count(variable).alias("states")).withColumn("valid", (F.abs(F.col("total") - 1) < 1e-6) & (F.col("states") == states))


def uncovered(cpt: DataFrame, states: dict[str, DataFrame]) -> DataFrame:
    """Combinations of the parents' states that the table has no row for. states: each parent's own table, with a column of its name."""
    grid = None
    for p, t in states.items():
        every = t.agg(F.array_sort(F.collect_set(p)).alias("s"))
        grid = every.select(F.explode("s").alias(p)) if grid is None else grid.select("*", F.explode(every.scalar()).alias(p))
    return grid.join(cpt.select(*states).distinct().hint("shuffle_merge"), list(states), "left_anti")


def cycles(edges: DataFrame) -> DataFrame:
    """(variable) of each variable that reaches itself along edges(parent, child): those of strongly connected components, and those that name themselves as a parent."""
    return on_cycles(edges).select(F.col("node").alias("variable"))


def joint(cpts: list[DataFrame]) -> DataFrame:
    """The product of the tables, joined on shared variables: one row per combination of states. A table that shares
    none (a root) is a list in the plan, exploded."""
    out = None
    for k, t in enumerate(cpts):
        t = t.withColumnRenamed("p", f"p{k}")
        shared = [c for c in t.columns if out is not None and c in out.columns]
        if out is None:
            out = t
        elif shared:
            out = out.join(sized(t), shared)
        else:
            rows = t.agg(F.collect_list(F.struct(*t.columns))).scalar()
            out = out.select("*", F.explode(rows).alias("_r")).select(*out.columns, "_r.*")
    ps = [f"p{k}" for k in range(len(cpts))]
    return out.withColumn("p", reduce(lambda a, b: a * b, map(F.col, ps))).drop(*ps)


def long_form(j: DataFrame, p: Column = None) -> DataFrame:
    names = [c for c in j.columns if c != "p"]
    pairs = F.array(*(F.struct(F.lit(n).alias("variable"), F.col(n).alias("state")) for n in names))
    return j.select(F.explode(pairs).alias("v"), (p if p is not None else F.col("p")).alias("p")).select("v.variable", "v.state", "p")


def marginals(j: DataFrame) -> DataFrame:
    """Prior probability of every state of every variable."""
    return long_form(j).groupBy("variable", "state").agg(F.sum("p").alias("p"))


def posterior(j: DataFrame, query: str, evidence: dict[str, str]) -> DataFrame:
    """P(query | evidence); blank evidence is none."""
    seen = {k: v for k, v in evidence.items() if v not in (None, "", "None")}
    kept = j.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in seen.items()], F.lit(True)))
    g = kept.groupBy(F.col(query).alias("state")).agg(F.sum("p").alias("p"))
    return g.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy()))


def clean_evidence(df: DataFrame, columns: list[str]) -> DataFrame:
    """Blank and 'None' are no evidence."""
    return df.withColumns({c: F.nullif(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("None")) for c in columns})


def _observed(columns: list[str]) -> Column:
    """Which columns are observed, as a number."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), F.lit(1 << k)).otherwise(0) for k, c in enumerate(columns)], F.lit(0))


def posteriors(j: DataFrame, columns: list[str], masks: Column, keep: list[str] = ()) -> DataFrame:
    """Sums of the joint for every set of observed columns in masks, by what they show: _m, a column _c for each of columns (null where the set
    leaves it out), _k_c for each of keep, variable, state, p. All sets are summed up in one aggregation, as grouping sets are."""
    pairs = F.array(*(F.struct(F.lit(n).alias("variable"), F.col(n).alias("state")) for n in j.columns if n != "p"))
    sets = j.select("*", F.explode_outer(masks).alias("_m")).where("_m is not null")
    shown = [F.when(F.shiftright("_m", k).bitwiseAND(F.lit(1)) == 1, F.col(c)).alias(f"_{c}") for k, c in enumerate(columns)]
    named = [F.col(c).alias(f"_k_{c}") for c in keep]
    by = ["_m", *(f"_{c}" for c in columns), *(f"_k_{c}" for c in keep), "variable", "state"]
    return sets.select("_m", *shown, *named, F.explode(pairs).alias("v"), "p").select("_m", *(f"_{c}" for c in columns), *(f"_k_{c}" for c in keep), "v.variable", "v.state", "p").groupBy(*by).agg(F.sum("p").alias("p"))


def score(evidence: DataFrame, key: str, columns: list[str], j: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Evidence rows (null: not observed) -> posterior of every state of every variable of
    each row; observed ones come out as 1 or 0. Whatever sets of columns the rows observe, the evidence is read once, the joint is summed up for all
    these sets at once, and rows meet the sums by one equality join on the set and what they show, nulls included. Posteriors are
    normalised before the join, so nothing is shuffled after it. Nothing is refused: a large table is joined by a shuffle."""
    cleaned = written(clean_evidence(evidence, columns).select(key, *columns, *keep).withColumn("_m", _observed(columns)), "evidence")
    masks = cleaned.agg(F.collect_set("_m")).scalar()  # one for each set of columns at most
    t = posteriors(j, columns, masks, keep)
    if not keep:
        t = t.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("_m", *(f"_{c}" for c in columns), "variable")))
    t = written(t.withColumnRenamed("_m", "_set"), "posteriors")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns], F.col("_m") == F.col("_set"))
    return cleaned.join(sized(t), on).select(key, *keep, *(f"_k_{c}" for c in keep), "variable", "state", "p")


def score_with_priors(evidence: DataFrame, key: str, columns: list[str], cpts: dict[str, DataFrame], priors: dict[str, str]) -> DataFrame:
    """G8 for each row: priors names, for a root variable, the column of evidence with the row's own prior (a map of
    state to probability; null: the table's). The joint leaves the root's factor out, sums are kept by the root's
    state, and each row weighs them by its prior."""
    flat = {v: t.withColumn("p", F.lit(1.0)) if v in priors else t for v, t in cpts.items()}
    marked = joint(list(flat.values()))
    roots = list(priors)
    asked = evidence.withColumnsRenamed({c: f"_p_{v}" for v, c in priors.items()})
    j = marked.withColumns({f"_p_{v}": F.col(v) for v in roots})
    met = _by_root(asked, key, columns, j, roots)
    weight = F.lit(1.0)
    for v in roots:
        usual = cpts[v].agg(F.map_from_entries(F.collect_list(F.struct(v, "p")))).scalar()
        weight = weight * F.coalesce(F.try_element_at(F.coalesce(F.col(f"_p_{v}"), usual), F.col(f"_k__p_{v}")), F.lit(0.0))
    g = met.groupBy(key, "variable", "state").agg(F.sum(F.col("p") * weight).alias("p"))
    return g.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(key, "variable")))


def _by_root(asked: DataFrame, key: str, columns: list[str], j: DataFrame, roots: list[str]) -> DataFrame:
    got = score(asked, key, columns, j, keep=[f"_p_{v}" for v in roots])
    return got.where(~F.startswith("variable", F.lit("_p_")))


def override_priors(cpts: dict[str, DataFrame], priors: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Root tables replaced by given ones, for all rows."""
    return {**cpts, **priors}


def present(cpt: DataFrame, variable: str, parents: list[str], combinations: list[str]) -> DataFrame:
    """One row per state, one column per parent combination (states joined by '/'), 3 decimals."""
    labelled = cpt if "_c" in cpt.columns else cpt.withColumn("_c", F.concat_ws("/", *parents))
    return labelled.groupBy(variable).pivot("_c", combinations).agg(F.round(F.first("p"), 3))
