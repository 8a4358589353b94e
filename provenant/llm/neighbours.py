"""Nearest neighbours by multi-index hashing of learned binary codes.

1. Equal vectors are one entry with its smallest ids, one more than the neighbours asked for, so that a vector of which
   there are many copies is stored and compared once.
2. Rotations are learned by iterative quantisation (ITQ) on at most ``SAMPLE`` entries, those with the smallest hashes; each gives
   as many bits as there are dimensions, and ``BITS`` bits are reached with several rotations. All entries are coded.
3. Entries lie in blocks. A block has one inverted table for each substring of 8 bits of the code. If two codes are within a
   Hamming radius r, then in one of m substrings they are within r // m; all values that near are probed, and the entries found are
   those within the radius. If they are fewer than the neighbours asked for, the radius grows until they are not or the block ends.
4. Found entries are ranked by the cosine of the original vectors in double precision; each block sends its best per query.

Defined results: vectors that are null, zero, or hold null or non-finite components, or differ in length from the longest common kind,
take no part; null ids are no queries and no candidates; rows that repeat a vec_id are candidates once for each different vector; ties go to the smaller
vec_id; with fewer candidates all are returned; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import lists, stored

NEIGHBOURS = 5
BITS = 128
SUBSTRING = 8
RADIUS = 58
SAMPLE = 10_000
ITERATIONS = 30
BLOCK = 8192
QUERIES_AT_ONCE = 256

_BYTES = np.arange(256, dtype=np.uint8)
_APART = np.bitwise_count(_BYTES[:, None] ^ _BYTES[None, :])


def learn_rotations(sample: np.ndarray, bits: int = BITS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotations (dimensions by bits) that bring the rotated sample near the corners of a cube."""
    d = sample.shape[1]
    mean = sample.mean(axis=0)
    centred, random, found = sample - mean, np.random.default_rng(seed), []
    axes = np.linalg.svd(centred.T @ centred)[0]
    projected = centred @ axes
    for _ in range(-(-bits // d)):
        turn = np.linalg.qr(random.standard_normal((d, d)))[0]
        for _ in range(ITERATIONS):
            u, _, v = np.linalg.svd(np.sign(projected @ turn).T @ projected)
            turn = (u @ v).T
        found.append(axes @ turn)
    return mean, np.concatenate(found, axis=1)[:, :bits]


def codes_of(vectors: np.ndarray, mean: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    return np.packbits((vectors - mean) @ rotations > 0, axis=1)


class Block:
    """Inverted tables of the substrings of a block's codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.orders = [np.argsort(c, kind="stable") for c in codes.T]
        self.bounds = [np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, self.orders, strict=True)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Entries whose code is within ``radius``: by the pigeonhole principle one substring is within its share."""
        near = np.zeros(len(self.codes), bool)
        for value, order, bounds in zip(code, self.orders, self.bounds, strict=True):
            probes = np.flatnonzero(_APART[value] <= radius // len(code))
            counts = bounds[probes + 1] - bounds[probes]
            ends = np.cumsum(counts)
            near[order[np.arange(ends[-1]) + np.repeat(bounds[probes] - (ends - counts), counts)]] = True
        found = np.flatnonzero(near)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1) <= radius]

    def at_least(self, code: np.ndarray, radius: int, number: int) -> np.ndarray:
        while True:
            found = self.within(code, radius)
            if len(found) >= number or radius >= 8 * len(code):
                return found
            radius += len(code)


def _matrix(column) -> np.ndarray:
    values, offsets = lists(column)
    return values[offsets[0] : offsets[-1]].astype(np.float64).reshape(len(offsets) - 1, -1)


def usable(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id``, ``v``: the vectors that take part."""
    given = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    finite = given.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return finite.where(F.size("v") == _dimensions(finite))


def _dimensions(vectors: DataFrame) -> int:
    counted = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return counted["d"] if counted else 1


def nearest(vectors: DataFrame, is_query: str = "id % 50 = 0", neighbours: int = NEIGHBOURS, radius: int = RADIUS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's nearest found among ``vectors(id, v)``."""
    spark = vectors.sparkSession
    entries = stored(
        # -0.0 + 0.0 is 0.0, so that equal vectors have equal keys
        vectors.select("id", F.transform("v", lambda x: x + 0.0).alias("v")).withColumn("part", F.pmod("id", F.lit(64)))
        .groupBy("v", "part").agg(F.slice(F.array_sort(F.collect_set("id")), 1, neighbours + 1).alias("ids"))
        .groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, neighbours + 1).alias("ids"))
    )
    n = entries.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r.v for r in entries.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toLocalIterator()])
    mean, rotations = learn_rotations(sample)

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                codes = codes_of(_matrix(batch.column("v")), mean, rotations)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "code"])

    blocks = -(-n // BLOCK)
    index = stored(entries.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks))).mapInArrow(coded, "v array<double>, ids array<long>, block long, code binary"))
    asked = vectors.where(is_query).select(F.col("id").alias("query_id"), F.transform("v", lambda x: x + 0.0).alias("v")).distinct()
    asked = asked.join(index.select("v", "code"), "v").select("query_id", F.col("v").alias("qv"), F.col("code").alias("qcode")).withColumn("g", F.pmod("query_id", F.lit(max(1, blocks // 8))))
    # every query meets every block, in groups of queries; this is the stated query set against all rows, in blocks
    asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    placed = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks // 8) - 1)).cast("array<long>")))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left, right, neighbours, radius)

    found = (
        placed.groupBy("group", "block").cogroup(asked.groupBy("g", "b"))
        .applyInArrow(search, "query_id long, found array<struct<score: double, vec_id: long>>")
    )
    # the best of all blocks; a repeated pair of ids (rows that repeat an id with other vectors) keeps its best score
    best = (
        found.select("query_id", F.explode("found").alias("f")).groupBy("query_id", F.col("f.vec_id").alias("vec_id")).agg(F.max("f.score").alias("score"))
        .groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, neighbours).alias("best"))
    )
    return best.select("query_id", F.posexplode("best").alias("i", "b")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _search(left: pa.Table, right: pa.Table, neighbours: int, radius: int) -> pa.Table:
    out_ids, out = [], []
    if left.num_rows and right.num_rows:
        vectors, ids = _matrix(left["v"]), left["ids"].to_pylist()
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        width = len(left["code"][0].as_py())
        block = Block(np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(-1, width))
        queries = _matrix(right["qv"])
        for query, v, code in zip(right["query_id"].to_pylist(), queries, right["qcode"].to_pylist(), strict=True):
            near = block.at_least(np.frombuffer(code, np.uint8), radius, neighbours + 1)
            scores = (vectors[near] * v).sum(axis=1) / (lengths[near] * np.sqrt((v * v).sum()))
            few = np.argsort(-scores, kind="stable")
            # entries that may tie with the last wanted one stay in
            least = scores[few[min(neighbours, len(few) - 1)]]
            pairs = sorted((-float(s), i) for s, e in zip(scores[few], near[few], strict=True) if s >= least for i in ids[e] if i != query)[:neighbours]
            out_ids.append(query)
            out.append([{"score": -s, "vec_id": i} for s, i in pairs])
    return pa.Table.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))], ["query_id", "found"])
