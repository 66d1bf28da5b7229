"""Reachability, cycles and dependency order of directed graphs: edges(parent, child), parent referring to child.

Nothing here makes a row for each path. Every loop follows a written frontier until it is empty, so a lost executor costs one round;
edges are dealt by the key of the join once and checkpointed so, and no round shuffles them again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import placed, written


#: A core of so few edges has at most a million pairs of nodes, so its components are read off what reaches what, in fewer rounds.
SMALL_CORE = 1000


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select("parent", "child").where("parent is not null and child is not null and parent <> child").distinct()


def reach(edges: DataFrame, depth: int | None = None, paths: bool = False) -> DataFrame:
    """(root, node, depth): every node that a root reaches, once, with the least number of steps; with paths also the least of the shortest paths, as
    an array. A root isn't listed under itself. A depth ends the search sooner. Self references and rows with a null end don't count.

    Each round doubles the depth: with all pairs of up to L steps known, a pair of L + 1 to 2 L steps has a node at exactly L steps on its way. So the
    frontier of pairs at L steps is joined with the pairs known, and pairs that are known go; rounds grow with the logarithm of the depth,
    and there are at most nodes times nodes rows, however many paths the graph has."""
    first = _plain(edges).select(F.col("parent").alias("root"), F.col("child").alias("node"), F.lit(1).alias("depth"), *([F.array("parent", "child").alias("path")] if paths else []))
    known, far = written(first, "reach"), 1
    while depth is None or far < depth:
        edge = known.where(F.col("depth") == far)
        if edge.isEmpty():
            break
        ahead = known.select(F.col("root").alias("_mid"), F.col("node").alias("_to"), F.col("depth").alias("_more"), *([F.col("path").alias("_rest")] if paths else []))
        met = edge.withColumnRenamed("node", "_mid").join(ahead.hint("shuffle_merge"), "_mid").where("_to <> root")
        if depth is not None:
            met = met.where(F.col("_more") <= depth - far)
        met = met.select("root", F.col("_to").alias("node"), (F.col("_more") + far).alias("depth"), *([F.concat("path", F.slice("_rest", F.lit(2), F.size("_rest"))).alias("path")] if paths else []))
        least = met.groupBy("root", "node").agg(*([F.min(F.struct("depth", "path")).alias("m")] if paths else [F.min("depth").alias("depth")]))
        new = (least.select("root", "node", "m.*") if paths else least).join(known.select("root", "node").hint("shuffle_merge"), ["root", "node"], "left_anti")
        known, far = known.unionAll(written(new.select(known.columns), "reach")), 2 * far
    return known


def peel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, level), rest): nodes that refer to nothing have level 0, the others one more than the greatest level they refer to; rest are
    the edges of nodes that have no level because they are on a cycle or rest on one. Only nodes of edges are listed.

    A round takes the references to the last level away, and only what is left goes into the next round; nodes that lose their last reference are the next level."""
    left = written(_plain(edges), "peel")
    ready = left.select(F.col("child").alias("id")).distinct().join(left.select(F.col("parent").alias("id")).distinct().hint("shuffle_merge"), "id", "left_anti")
    levels = [written(ready.withColumn("level", F.lit(0)), "peel-level")]
    ready = levels[0].select("id")
    while not ready.isEmpty():
        met = ready.select(F.col("id").alias("child"), F.lit(True).alias("_met"))
        done = written(left.join(met.hint("shuffle_merge"), "child", "left").withColumn("_met", F.coalesce("_met", F.lit(False))), "peel")
        ready = done.groupBy(F.col("parent").alias("id")).agg(F.bool_and("_met").alias("_done")).where("_done").select("id")
        levels.append(ready.withColumn("level", F.lit(len(levels))))
        left = done.where("not _met").select("parent", "child")
    return reduce(DataFrame.unionAll, levels), left


def _trim(edges: DataFrame) -> DataFrame:
    """The edges without those that start where none ends, or end where none starts; again and again."""
    n = edges.count()
    while n:
        starts, ends = edges.select(F.col("parent").alias("child")).distinct(), edges.select(F.col("child").alias("parent")).distinct()
        edges = written(edges.join(ends.hint("shuffle_merge"), "parent", "left_semi").join(starts.hint("shuffle_merge"), "child", "left_semi").select("parent", "child"), "trim")
        now = edges.count()
        if now == n:
            break
        n = now
    return edges


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles of several nodes: component is the least node of those that reach each other.

    What can be on no cycle is trimmed. If little is left, nodes that reach each other are paired. Else every node takes the least node that reaches it as its colour; of a
    colour, the nodes that reach the one it is named after are a component. Each time at least one component for each colour goes."""
    left, found = _trim(written(_plain(edges), "components")), []
    while not left.isEmpty():
        if left.count() <= SMALL_CORE:
            to = written(reach(left).select("root", "node"), "core")
            back = to.select(F.col("node").alias("root"), F.col("root").alias("node")).hint("shuffle_merge")
            mutual = to.join(back, ["root", "node"]).groupBy("root").agg(F.min("node").alias("least"))
            found.append(mutual.select(F.col("root").alias("node"), F.least("root", "least").alias("colour")))
            break
        out_of = placed(left, "parent")
        nodes = left.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
        colour = written(nodes.withColumn("colour", F.col("node")), "colours")
        moved = colour
        while not moved.isEmpty():
            offer = moved.withColumnRenamed("node", "parent").join(out_of.hint("shuffle_merge"), "parent").groupBy(F.col("child").alias("node")).agg(F.min("colour").alias("_offer"))
            both = written(colour.join(offer.hint("shuffle_merge"), "node", "left").withColumn("new", F.least("colour", "_offer")), "colours")
            colour, moved = both.select("node", F.col("new").alias("colour")), both.where("new <> colour").select("node", F.col("new").alias("colour"))
        tint = lambda c: colour.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour")).hint("shuffle_merge")
        inside = left.join(tint("parent"), "parent").join(tint("child"), "child").where("parent_colour = child_colour").select("parent", "child")
        into = placed(inside, "child")
        members = level = written(colour.where("node = colour"), "members")
        while not level.isEmpty():
            back = level.withColumnRenamed("node", "child").join(into.hint("shuffle_merge"), "child").select(F.col("parent").alias("node"), "colour").distinct()
            level = written(back.join(members.select("node").hint("shuffle_merge"), "node", "left_anti"), "members")
            members = members.unionAll(level)
        found.append(members)
        gone = lambda c: members.select(F.col("node").alias(c)).hint("shuffle_merge")
        left = _trim(written(left.join(gone("parent"), "parent", "left_anti").join(gone("child"), "child", "left_anti").select("parent", "child"), "components"))
    if not found:
        return _plain(edges).select(F.col("parent").alias("node"), F.col("parent").alias("component")).limit(0)
    every = written(reduce(DataFrame.unionAll, found).select("node", F.col("colour").alias("component")), "components")
    several = every.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return every.join(several.hint("shuffle_merge"), "component", "left_semi").select("node", "component")


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node) of each node that reaches itself, by a cycle or by a reference to itself."""
    loops = edges.where("parent = child").select(F.col("parent").alias("node"))
    return strong_components(edges).select("node").unionAll(loops).distinct()


def dependency_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level, cycle) of each distinct id of nodes: every node stands above all that it refers to. cycle is the least node of its cycle, null for most.

    Nodes that rest on no cycle have the length of their longest chain of references. All others come after these: a cycle's nodes share a level,
    and what refers to a cycle, other cycles included, stands above it. An id that isn't among nodes is never there, so what refers to it comes
    last, too, as if it rested on a cycle. A node that refers to itself is a cycle of its own."""
    ids = nodes.select("id").where("id is not null").distinct()
    known = ids.withColumnRenamed("id", "child")
    own = written(edges.select("parent", "child").where("parent is not null and child is not null").distinct().join(ids.withColumnRenamed("id", "parent").hint("shuffle_merge"), "parent", "left_semi"), "order-edges")
    lost = own.join(known.hint("shuffle_merge"), "child", "left_anti").select(F.col("parent").alias("node"))
    loops = own.where("parent = child").select(F.col("parent").alias("node"))
    never = written(lost.unionAll(loops).distinct(), "order-never")
    plain = own.where("parent <> child").join(known.hint("shuffle_merge"), "child", "left_semi").select("parent", "child")
    levels, rest = peel(plain)
    if never.isEmpty():
        late = rest.select(F.col("parent").alias("id")).distinct()
    else:  # what refers to one of these can't be placed either
        late = rest.select(F.col("parent").alias("id")).unionAll(never.select(F.col("node").alias("id")))
        late = late.unionAll(_up(plain, never).select(F.col("node").alias("id"))).distinct()
    late = written(late, "order-late")
    first = ids.join(late.hint("shuffle_merge"), "id", "left_anti").join(levels.hint("shuffle_merge"), "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"), F.lit(None).cast(dict(ids.dtypes)["id"]).alias("cycle"))
    if late.isEmpty():
        return first
    among = lambda c: late.withColumnRenamed("id", c).hint("shuffle_merge")
    inner = written(plain.join(among("parent"), "parent", "left_semi").join(among("child"), "child", "left_semi").select("parent", "child"), "order-inner")
    of = written(strong_components(inner).unionAll(loops.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component")), "order-cycles")
    name = lambda c: of.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")).hint("shuffle_merge")
    between = inner.join(name("parent"), "parent", "left").join(name("child"), "child", "left").select(F.coalesce("_parent", "parent").alias("parent"), F.coalesce("_child", "child").alias("child"))
    above, _ = peel(between)  # no cycles are left among components
    base = (first.agg(F.max("level")).first()[0] if not first.isEmpty() else -1) + 1
    last = late.join(of.select(F.col("node").alias("id"), F.col("component").alias("cycle")).hint("shuffle_merge"), "id", "left").withColumn("_at", F.coalesce("cycle", "id"))
    last = last.join(above.select(F.col("id").alias("_at"), "level").hint("shuffle_merge"), "_at", "left").select("id", (F.coalesce("level", F.lit(0)) + base).alias("level"), "cycle")
    return first.unionByName(last)


def _up(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node) of starts and of all that refer to them, directly or not."""
    into = placed(edges, "child")
    found = level = starts
    while not level.isEmpty():
        back = level.withColumnRenamed("node", "child").join(into.hint("shuffle_merge"), "child").select(F.col("parent").alias("node")).distinct()
        level = written(back.join(found.hint("shuffle_merge"), "node", "left_anti"), "order-up")
        found = found.unionAll(level)
    return found
