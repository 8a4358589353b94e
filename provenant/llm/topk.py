"""Exact top-k inner products by aggregation of sorted lists without random access.

1. Equal vectors are one entry with its smallest ids, one more than wanted. Entries lie in blocks by their hash, numbered by their
   smallest id; for each dimension a block has one list of (component, entry) in order of the component: the table of lists.
2. A query reads the lists of a block from the end at which its own component makes the products greatest, all in equal steps,
   and never looks an entry up. What it has read of an entry gives the entry bounds: what is unread adds at most the products at
   the places reached, and at least minus the length of the unread part (lists carry the squared length with the entry)
   times the length of the query's part. Many queries read the lists of a block together.
3. An entry whose upper bound is below the k-th best lower bound, or below the floor of step 5, is an outsider. Reading ends when all but ``LEFT`` entries of the block,
   the unseen ones included, are outsiders, or at the end of the lists.
4. The entries left over get their final scores by one join with the vectors.
5. Blocks are taken in passes, each of ``GROWTH`` times as many blocks as all before; a pass starts with the k-th best final score of those
   before as its floor, so that all passes but the first leave few entries to resolve, however many blocks there are.

Defined results: see ``scaled.usable`` for the rows that take part. Rows that repeat an id with another vector are rows of their own, as queries (ranks
from 1 for each) and as candidates. Ties go to the smaller id; with fewer candidates all are returned; an empty table gives an empty table. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import stored
from provenant.llm.scaled import matrix

WANTED = 5
BLOCK = 4096
QUERIES_AT_ONCE = 1024
# Steps in which the lists of a block are read.
STEPS = 16
# Entries of a block that one query may leave to the join; reading goes on until there are no more.
LEFT = 16
GROWTH = 16


def entries_of(vectors: DataFrame, wanted: int = WANTED) -> DataFrame:
    """``block``, ``entry``, ``v``, ``ids``: each different vector once with its smallest ids; entries of a block are numbered from 0."""
    # the limit on ranks works before the shuffle too, so copies of one vector do not travel
    first = vectors.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= wanted + 1)
    merged = stored(first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    blocks = -(-merged.count() // BLOCK)
    placed = merged.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(max(1, blocks))))
    return stored(placed.withColumn("entry", F.row_number().over(Window.partitionBy("block").orderBy(F.col("ids")[0], "v")) - 1))


def sorted_lists(entries: DataFrame) -> DataFrame:
    """``block``, ``dim``, ``components``, ``members``, ``masses``: a block's entries in order of one component, with their squared lengths."""

    def sort(block: pa.Table) -> pa.Table:
        v, member = matrix(block["v"]), block["entry"].to_numpy()
        mass = (v.astype(np.float64) ** 2).sum(axis=1)
        order = np.argsort(v, axis=0, kind="stable").T
        nested = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * v.shape[0]), pa.array(a.ravel(), t))
        return pa.Table.from_arrays(
            [pa.array(np.full(len(order), block["block"][0].as_py()), pa.int64()), pa.array(np.arange(len(order)), pa.int32()),
             nested(np.take_along_axis(v.T, order, axis=1), pa.int32()), nested(member[order], pa.int32()), nested(mass[order], pa.float64())],
            ["block", "dim", "components", "members", "masses"])

    return entries.select("block", "entry", "v").groupBy("block").applyInArrow(
        sort, "block long, dim int, components array<int>, members array<int>, masses array<double>")


class Lists:
    """The sorted lists of one block, read in equal steps from both ends for a group of queries at once."""

    def __init__(self, components: np.ndarray, members: np.ndarray, masses: np.ndarray):
        self.dims, self.rows = components.shape
        self.components, self.members, self.masses = components.astype(np.float32), members.astype(np.int64), masses

    def left_over(self, queries: np.ndarray, wanted: int, floors: np.ndarray, left: int = LEFT):
        """For each query its number, the entries that may be among the ``wanted`` best and reach its floor, and how deep it read.

        ``top`` and ``bottom`` hold what has been read from either end, with zeros for the rest, and ``above`` and ``below`` mark what has not. A query reads
        the top of a list where its component is positive, the bottom where it is negative, and no list where it is zero.
        """
        n, step, where = self.rows, max(1, -(-self.rows // STEPS)), np.arange(self.dims)[:, None]
        top, bottom = np.zeros((n, self.dims), np.float32), np.zeros((n, self.dims), np.float32)
        above, below = np.ones((n, self.dims), np.float32), np.ones((n, self.dims), np.float32)
        length = np.full(n, self.masses.max(initial=0.0))
        up, down, floors = np.maximum(queries, 0).astype(np.float32), np.minimum(queries, 0).astype(np.float32), floors.astype(np.float64)
        # bounds are sums of rounded products; they are never off by more than this
        slack = (1.0 + 1e-4 * np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1) * self.masses.max(initial=0.0)))[:, None]
        asking = np.arange(len(queries))
        for start in range(0, n, step):
            stop = min(n, start + step)
            for read, unread, reads in ((top, above, slice(n - stop, n - start)), (bottom, below, slice(start, stop))):
                who = self.members[:, reads]
                read[who, where], unread[who, where] = self.components[:, reads], 0
                length[who] = self.masses[:, reads]
            u, d = up[asking], down[asking]
            got = u @ top.T + d @ bottom.T
            floor = floors[asking, None]
            if n > wanted and np.isneginf(floor).any():
                # what is unread of an entry has the rest of its length, and adds at least minus that times the query's length there
                rest = length - ((u > 0).astype(np.float32) @ np.square(top).T + (d < 0).astype(np.float32) @ np.square(bottom).T)
                share = np.square(u) @ above.T + np.square(d) @ below.T
                low = got - np.sqrt(np.maximum(rest, 0.0) * np.maximum(share, 0.0))
                # one more than wanted, as one of them may be the query itself
                floor = np.maximum(floor, np.partition(low, n - wanted - 1, axis=1)[:, [n - wanted - 1]] - slack[asking])
            ahead = (u * self.components[:, n - stop]) @ above.T + (d * self.components[:, stop - 1]) @ below.T
            inside = got + ahead + slack[asking] >= floor
            ended = np.flatnonzero((inside.sum(axis=1) <= left) | (stop == n))
            for i in ended:
                found = np.flatnonzero(inside[i])
                if stop == n and len(found) > wanted + 1:
                    # all is read, so scores are known and ties are decided: entries are numbered by their smallest id
                    scores = top[found].astype(np.int64) @ queries[asking[i]].astype(np.int64)
                    found = np.sort(found[np.lexsort((found, -scores))[: wanted + 1]])
                yield int(asking[i]), found, stop
            asking = np.delete(asking, ended)
            if not len(asking):
                return


def _search(given: pa.Table, asked: pa.Table, wanted: int) -> pa.Table:
    who, where, depth, b = [], [], [], 0
    if given.num_rows and asked.num_rows:
        given, b = given.sort_by("dim"), given["block"][0].as_py()
        block = Lists(matrix(given["components"]), matrix(given["members"]), matrix(given["masses"]))
        numbers = asked["query"].to_numpy()
        floors = np.array([-np.inf if f is None else float(f) for f in asked["floor"].to_pylist()])
        for i, inside, stop in block.left_over(matrix(asked["qv"]), wanted, floors):
            who.append(np.full(len(inside), numbers[i]))
            where.append(inside)
            depth.append(np.full(len(inside), stop / block.rows))
    join = lambda a, t: pa.array(np.concatenate(a) if a else [], t)
    who = join(who, pa.int64())
    return pa.Table.from_arrays([who, pa.array(np.full(len(who), b), pa.int64()), join(where, pa.int32()), join(depth, pa.float64())], ["query", "block", "entry", "depth"])


def _product(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, x: s + x)


def best(vectors: DataFrame, is_query: str = "id % 50 = 0", wanted: int = WANTED) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``wanted`` rows of greatest inner product among ``vectors(id, v)``."""
    spark = vectors.sparkSession
    vectors = stored(vectors.select("id", "v"))
    entries = entries_of(vectors, wanted)
    blocks = (entries.agg(F.max("block")).first()[0] or 0) + 1
    index = stored(sorted_lists(entries))
    # a query is a number of its own, as an id may stand for several vectors
    queries = stored(vectors.where(is_query).select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("query_id"), F.col("v").alias("qv")))
    groups = -(-queries.count() // QUERIES_AT_ONCE)
    queries = queries.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(max(1, groups))))
    found = spark.createDataFrame([], "query long, vec_id long, score long, rank int")
    start = 0
    per_query = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    while start < blocks:
        stop = min(blocks, max(1, start * GROWTH))
        floors = found.groupBy("query").agg(F.when(F.count("score") >= wanted, F.min("score")).alias("floor"))
        span = F.explode(F.sequence(F.lit(start), F.lit(stop - 1)).cast("array<long>"))
        # the stated query set against all rows, in blocks
        asked = queries.join(floors, "query", "left").select("query", "qv", "floor", "group", span.alias("block"))
        lists_here = index.where(F.col("block").between(start, stop - 1)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(1, groups) - 1)).cast("array<long>")))
        left = lists_here.groupBy("group", "block").cogroup(asked.groupBy("group", "block")).applyInArrow(
            lambda given, asked: _search(given, asked, wanted), "query long, block long, entry int, depth double")
        scored = (
            left.select("query", "block", "entry")
            .join(entries.where(F.col("block").between(start, stop - 1)), ["block", "entry"])
            .join(queries.select("query", "query_id", "qv"), "query")
            .select("query", "query_id", (F.col("qv") == F.col("v")).alias("same"), _product("qv", "v").alias("score"), F.explode("ids").alias("vec_id"))
            .where("NOT same OR vec_id <> query_id")
            .select("query", "vec_id", "score")
        )
        ranked = scored.unionByName(found.select("query", "vec_id", "score")).withColumn("rank", F.row_number().over(per_query))
        found = stored(ranked.where(F.col("rank") <= wanted))
        start = stop
    return found.join(queries.select("query", "query_id"), "query").select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
  FROM e AS q JOIN e ON e.vec_id <> q.vec_id OR e.v <> q.v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
