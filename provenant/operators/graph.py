"""Walks over edge tables: bounded and unbounded closure, chain positions, levels, fixpoints.

Every routine is a loop of joins whose rounds end in a written table, so the plan stays small and a lost
executor costs one round. No round collects rows to the driver; only row counts come back.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.session import cut, cut_counted, release


def walk(
    starts: DataFrame,
    edges: DataFrame,
    *,
    max_hops: int | None = None,
    hops_per_round: int = 8,
    long: bool = False,
) -> DataFrame:
    """Nodes reached from each start: ``(root, node, depth)``, depth the least number of hops.

    ``starts`` has (root, node), ``edges`` has (src, dst). A round makes several hops in one plan: rows of
    the last depth meet the edges, all others pass through, and one grouping per hop keeps the least depth.
    What a round reaches is compared with what was known at its end, so cycles end the loop.

    With many starts, or ``long`` ways to go, and no bound, the distance per round is doubled instead, as long
    as the doubled edges stay few: see ``_walk_doubling``.
    """
    known, found = cut_counted(starts.select("root", "node").distinct().withColumn("depth", F.lit(0)))
    steps, n_edges = cut_counted(edges.select("src", "dst").distinct())
    if max_hops is None and (long or found * 100 >= n_edges):
        return _walk_doubling(known, steps, n_edges)
    rounds, frontier, depth = [known], known, 0
    while found and (max_hops is None or depth < max_hops):
        hops = hops_per_round if max_hops is None else min(hops_per_round, max_hops - depth)
        reached = frontier.withColumn("open", F.lit(True))
        for _ in range(hops):
            # No hop number in the plan: the generated code is the same for every hop and round.
            here = F.struct("node", "depth", F.lit(False).alias("open"))
            there = F.when(F.col("dst").isNotNull(), F.struct(
                F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("open")))
            reached = (
                reached.join(steps, (F.col("node") == F.col("src")) & F.col("open"), "left")
                .select("root", F.explode(F.array_compact(F.array(here, there))).alias("n"))
                .groupBy("root", "n.node").agg(F.min("n.depth").alias("depth"), F.bool_and("n.open").alias("open"))
            )
        seen = _union(rounds).select("root", "node")
        new, found = cut_counted(reached.join(seen, ["root", "node"], "left_anti"))
        rounds.append(new.select("root", "node", "depth"))
        depth += hops
        # What was first met inside this round was already expanded in it, except on its last hop.
        frontier = new.filter("open").select("root", "node", "depth")
    return _union(rounds)


def _doubled(jumps: DataFrame, limit: int) -> tuple[DataFrame, int] | None:
    """Pairs two jumps apart, or None when there would be more than ``limit`` before removing duplicates.

    The number is known exactly before the join: the sum of in-degree times out-degree.
    """
    into = jumps.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    out = jumps.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    pairs = into.join(out, "id").agg(F.sum(F.col("i").cast("double") * F.col("o"))).first()[0] or 0
    if pairs > limit:
        return None
    ahead = jumps.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    return cut_counted(jumps.join(ahead, F.col("dst") == F.col("mid")).select("src", F.col("end").alias("dst")).distinct())


def _walk_doubling(known: DataFrame, steps: DataFrame, n_edges: int) -> DataFrame:
    """Reach of every root, window by window: nodes less than d hops away, met with the pairs d hops apart.

    While the pairs can be doubled the window doubles with them; after that windows of one length follow
    each other. A node's least depth lies in the window it is first found in, and a window that finds
    nothing new is the end, on cycles too.
    """
    limit = max(4 * n_edges, 100_000)
    jumps, length, growing = steps, 1, True
    rounds, source = [known], known
    while True:
        moved = (
            source.join(jumps, F.col("node") == F.col("src"))
            .select("root", F.col("dst").alias("node"), (F.col("depth") + length).alias("depth"))
            .groupBy("root", "node").agg(F.min("depth").alias("depth"))
        )
        seen = _union(rounds).select("root", "node")
        new, found = cut_counted(moved.join(seen, ["root", "node"], "left_anti"))
        if found == 0:
            return _union(rounds)
        rounds.append(new)
        if growing:
            doubled = _doubled(jumps, limit)
            growing = doubled is not None
            if growing:
                release(jumps)
                jumps, length = doubled[0], 2 * length
                source = _union(rounds)
                if doubled[1] == 0:
                    return source
                continue
            # Windows of this length from here on: the last one found starts the next.
        source = new


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def chase(nodes: DataFrame) -> DataFrame:
    """Follow one pointer per node to its end: ``(id, root, dist, state)``.

    ``nodes`` has (id, prev, is_root); ids are unique. Pointer doubling: every round joins the open
    pointers to the table of all pointers and doubles the distance, so a chain of n takes log2(n)
    rounds. ``state`` is root (an is_root node is reached), gap (prev names no node) or cycle.
    """
    # done: 0 open, 1 reached a root, 2 dead end
    pointers, total = cut_counted(
        nodes.select(
            "id",
            F.when(F.col("is_root") | F.col("prev").isNull(), F.col("id")).otherwise(F.col("prev")).alias("to"),
            F.when(F.col("is_root") | F.col("prev").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
            F.when(F.col("is_root"), 1).when(F.col("prev").isNull(), 2).otherwise(0).alias("done"),
        )
    )
    closed = [pointers.filter("done <> 0")]
    for _ in range(max(1, math.ceil(math.log2(max(total, 2)))) + 1):
        ahead = pointers.select(
            F.col("id").alias("a_id"), F.col("to").alias("a_to"), F.col("dist").alias("a_dist"),
            F.col("done").alias("a_done"),
        )
        moved = (
            pointers.filter("done = 0")
            .join(ahead, F.col("to") == F.col("a_id"), "left")
            .select(
                "id",
                F.coalesce("a_to", "to").alias("to"),
                (F.col("dist") + F.coalesce("a_dist", F.lit(0))).alias("dist"),
                F.when(F.col("a_id").isNull(), 2).otherwise(F.col("a_done")).alias("done"),
            )
        )
        moved, n = cut_counted(moved)
        if n == 0:
            pointers = moved
            break
        closed.append(moved.filter("done <> 0"))
        # Later rounds only ever jump to open pointers or to closed ones that are final.
        pointers = _union([moved, *closed[:-1]])
    open_ids = pointers.filter("done = 0")
    return _union([*closed, open_ids]).select(
        "id",
        F.when(F.col("done") == 1, F.col("to")).alias("root"),
        F.when(F.col("done") == 1, F.col("dist")).alias("dist"),
        F.when(F.col("done") == 1, "root").when(F.col("done") == 2, "gap").otherwise("cycle").alias("state"),
        F.col("to").alias("ends_at"),
    )


def levels(nodes: DataFrame, edges: DataFrame, *, levels_per_round: int = 8) -> DataFrame:
    """Longest-path level of every node ``(id, level)``; null for nodes on or behind a cycle.

    What no edge leads to, and what no edge leads from, is placed by one join before and one after the rounds, which see only what lies
    between. They double the distance while the doubled edges stay few, else place level by level.
    """
    steps, n_edges = cut_counted(edges.select("src", "dst").filter("src <> dst").distinct())
    nodes = nodes.select("id").distinct()
    heads, ends = steps.select(F.col("src").alias("id")).distinct(), steps.select(F.col("dst").alias("id")).distinct()
    # of each node with edges: does one lead from it, does one lead to it
    sides = cut(heads.withColumn("out", F.lit(True)).join(ends.withColumn("into", F.lit(True)), "id", "full"))
    within, n_within = cut_counted(sides.filter("out AND into").select("id"))
    inner, n_inner = cut_counted(steps.join(within.select(F.col("id").alias("src")), "src", "left_semi").join(within.select(F.col("id").alias("dst")), "dst", "left_semi"))
    first = sides.filter("into IS NULL").select(F.col("id").alias("src"))
    begun = steps.join(first, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    best = cut(within.join(begun.withColumn("begun", F.lit(True)), "id", "left").select("id", F.when(F.col("begun"), one).otherwise(zero).alias("level")))
    bound, limit = n_within + 1, max(4 * n_inner, 100_000)
    jumps, length, n_jumps = inner, 1, n_inner
    # best = the longest path of fewer than length edges, and the one before it; a jump of this length adds it to the best of where it starts.
    while n_jumps and length <= bound:
        ahead = (best.join(jumps, F.col("id") == F.col("src"))
                 .select(F.col("dst").alias("id"), (F.col("level") + length).alias("level")))
        last, best = best, cut(best.unionByName(ahead).groupBy("id").agg(F.max("level").alias("level")))
        release(last)
        doubled = _doubled(jumps, limit)
        if doubled is None:
            return _levels_by_peeling(nodes, steps, levels_per_round)
        release(jumps)
        (jumps, n_jumps), length = doubled, 2 * length
    best = best.select("id", F.when(F.col("level") < bound, F.col("level")).alias("level"))
    # the last nodes: one more than the highest before them, none if one of those has none
    last = sides.filter("out IS NULL").select(F.col("id").alias("dst"))
    from_within = steps.join(last, "dst", "left_semi").join(best.select(F.col("id").alias("src"), "level"), "src").select("dst", "level")
    highest = F.when(F.count(F.lit(1)) == F.count("level"), F.max("level") + 1)
    ended = from_within.groupBy(F.col("dst").alias("id")).agg(highest.alias("level"), F.lit(True).alias("known"))
    placed = best.withColumn("known", F.lit(True)).unionByName(ended).unionByName(
        last.select(F.col("dst").alias("id")).join(ended.select("id"), "id", "left_anti").select("id", one.alias("level"), F.lit(True).alias("known")))
    return nodes.join(placed, "id", "left").select("id", F.when(F.col("known"), F.col("level")).otherwise(zero).alias("level"))


def _levels_by_peeling(nodes: DataFrame, edges: DataFrame, levels_per_round: int) -> DataFrame:
    """A node is placed when all edges into it have been seen. Only the edges of the nodes just placed are
    read, so all rounds together read each edge once; a round places several levels in one plan.
    """
    degree = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("degree"))
    edges = cut(edges.join(degree, "dst"))
    none = F.lit(None).cast("bigint")
    first, n = cut_counted(nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
                           .select("id", F.lit(0).cast("bigint").alias("level"), none.alias("seen"), none.alias("degree")))
    placed, state, level = [first.select("id", "level")], first, 0
    while n:
        for at in range(level, level + levels_per_round):
            itself = F.struct("id", "level", "seen", "degree")
            met = F.when(F.col("dst").isNotNull(), F.struct(
                F.col("dst").alias("id"), none.alias("level"), F.lit(1).cast("bigint").alias("seen"),
                F.col("in_degree").alias("degree")))
            state = (
                state.join(edges.withColumnRenamed("degree", "in_degree"),
                           (F.col("id") == F.col("src")) & (F.col("level") == at), "left")
                .select(F.explode(F.array_compact(F.array(itself, met))).alias("n"))
                .groupBy("n.id").agg(F.max("n.level").alias("level"), F.sum("n.seen").alias("seen"),
                                     F.max("n.degree").alias("degree"))
                .withColumn("level", F.coalesce("level", F.when(F.col("seen") == F.col("degree"), F.lit(at + 1).cast("bigint"))))
            )
        state, _ = cut_counted(state.filter(F.col("level").isNull() | (F.col("level") > level)))
        placed.append(state.filter("level IS NOT NULL").select("id", "level"))
        level += levels_per_round
        state = state.filter(F.col("level").isNull() | (F.col("level") == level))
        n = 0 if state.filter(F.col("level") == level).isEmpty() else 1
    return nodes.join(_union(placed), "id", "left")


def producible(given: DataFrame, makes: DataFrame, needs: DataFrame) -> DataFrame:
    """Items that are given or can be made from what is: ``(item, round)``.

    ``makes`` has (maker, item), ``needs`` has (maker, item); a maker can run when all it needs is there.
    Monotone: a round adds items until none comes; items that need each other are never added.
    """
    needs = cut(needs.select("maker", "item").distinct())
    makes = cut(makes.select("maker", "item").distinct())
    have, _ = cut_counted(given.select("item").distinct().withColumn("round", F.lit(0)))
    step = 0
    while True:
        step += 1
        blocked = needs.join(have, "item", "left_anti").select("maker").distinct()
        new, n = cut_counted(
            makes.join(blocked, "maker", "left_anti")
            .select("item")
            .distinct()
            .join(have, "item", "left_anti")
            .withColumn("round", F.lit(step))
        )
        if n == 0:
            return have
        have = have.unionByName(new)
