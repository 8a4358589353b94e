"""Hard negatives from blocks in the order of a Hilbert curve, chosen by the bounds of their zone maps.

1. Rows get the number of their cell on a Hilbert curve through the ``DIMS`` dimensions that vary most, are sorted by it over all files,
   and cut into blocks of ``BLOCK`` rows: one Parquet row each, with ids, labels and vectors, and a zone map beside them, which is the least
   and greatest component of each dimension, and the labels.
2. An anchor's home is the block it lies in. It gives the anchor a floor: the score of the last of its first rows there.
3. By interval arithmetic the zone map bounds the scores of a block's rows with an anchor. Only blocks of the right labels whose
   upper bound reaches the floor, and for windows whose bounds meet one of them, are read for the anchor; zone maps alone are read to
   tell which, and blocks travel only to the groups of anchors that need them.
4. Positives are found so first; they give the windows in which negatives are found in the same way.

Scores are whole numbers throughout. Defined results: see ``scaled.usable`` for the rows that take part, and a null label takes no part. Rows that
repeat an id with another vector or label are rows of their own, as anchors and as candidates; rows with the anchor's id are not its candidates.
Ties go to the smaller id. With fewer candidates all are returned; an anchor without positives, or a positive without negatives, has no row; a negative
positive score leaves its window empty. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import list_column, stored
from provenant.llm.scaled import matrix

POSITIVES = 5
NEGATIVES = 10
# Shares of the positive's score between which a negative's must lie, in hundredths.
LOW, HIGH = 30, 90
BLOCK = 1024
DIMS, CELL_BITS = 8, 7
ANCHORS_AT_ONCE = 1024
ZONES_AT_ONCE = 1024
BLOCKS_A_FILE = 16

_ZONE = "block long, lo array<int>, hi array<int>, labels array<long>"
_ROWS = "ids array<long>, row_labels array<long>, asks array<boolean>, v binary"


def hilbert(cells: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells``, whole numbers below 2 ** bits, by Skilling's transform."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    place = np.zeros_like(t)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows(id, label, v, asks)`` in the order of the curve, written to the shared folder: zone map, ids, labels and vectors."""
    spread = (
        rows.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("spread"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
        .orderBy(F.desc("spread"), "dim").limit(DIMS).collect()
    )
    dims, low = [r.dim for r in spread], np.array([r.lo for r in spread], np.float64)
    width = np.array([r.hi - r.lo + 1 for r in spread], np.float64)
    n = spread[0].n if spread else 0

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                cells = ((matrix(batch.column("v"))[:, dims] - low) / width * 2**CELL_BITS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells), pa.int64())], [*batch.schema.names, "place"])

    def cut(batches):
        held, number = [], 0
        first = TaskContext.get().partitionId() << 24
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield _block(whole.slice(0, BLOCK), first + number)
                held, number = whole.slice(BLOCK).to_batches(), number + 1
        if sum(b.num_rows for b in held):
            yield _block(pa.Table.from_batches(held), first + number)

    files = max(1, -(-n // (BLOCK * BLOCKS_A_FILE)), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK)))
    # the id as a second key, so that copies of one vector, which have one place, spread over files
    ordered = rows.mapInArrow(placed, "id long, label long, v array<int>, asks boolean, place long").repartitionByRange(files, "place", "id").sortWithinPartitions("place", "id", "label")
    return stored(ordered.mapInArrow(cut, f"{_ZONE}, {_ROWS}"))


def _block(rows: pa.Table, number: int) -> pa.RecordBatch:
    v, labels = matrix(rows["v"]), rows["label"].to_numpy()
    one = lambda a, t: pa.array([a], pa.list_(t))
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), one(v.min(axis=0), pa.int32()), one(v.max(axis=0), pa.int32()), one(np.unique(labels), pa.int64()),
         one(rows["id"].to_numpy(), pa.int64()), one(labels, pa.int64()), one(rows["asks"].to_numpy(), pa.bool_()), pa.array([v.astype("<i4").tobytes()], pa.binary())],
        ["block", "lo", "hi", "labels", "ids", "row_labels", "asks", "v"])


def _products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: by floats where those are exact, else by integers."""
    a, r = np.abs(anchors).max(initial=0), np.abs(rows).max(initial=0)
    if float(a) * float(r) * anchors.shape[1] < 2**53:
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return anchors.astype(np.int64) @ rows.T.astype(np.int64)


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that each anchor can have with a vector of each zone."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return _products(up, lo) + _products(down, hi), _products(up, hi) + _products(down, lo)


class _Block:
    def __init__(self, ids, labels, data: bytes):
        self.ids, self.labels = np.asarray(ids, np.int64), np.asarray(labels, np.int64)
        self.v = np.frombuffer(data, "<i4").reshape(len(self.ids), -1)

    def positives(self, ident: int, label: int, scores: np.ndarray, floor, wanted: int) -> list[tuple[int, int]]:
        """(score, id) of the first rows of the anchor's label that reach the floor."""
        fit = (self.labels == label) & (self.ids != ident)
        if floor is not None:
            fit &= scores >= floor
        return self._first(np.flatnonzero(fit), scores, wanted)

    def negatives(self, ident: int, label: int, scores: np.ndarray, window, wanted: int) -> list[tuple[int, int]]:
        """(score, id) of the first rows of other labels in the window (least, greatest, floor)."""
        least, greatest, floor = window
        fit = (self.labels != label) & (self.ids != ident) & (scores <= greatest) & (scores >= (least if floor is None else max(least, floor)))
        return self._first(np.flatnonzero(fit), scores, wanted)

    def _first(self, at: np.ndarray, scores: np.ndarray, wanted: int) -> list[tuple[int, int]]:
        return [(int(scores[i]), int(self.ids[i])) for i in at[np.lexsort((self.ids[at], -scores[at]))[:wanted]]]


_FOUND = "anchor long, positive int, score long, id long"


def _out(found: list[tuple[int, int, int, int]]) -> pa.Table:
    columns = list(zip(*found, strict=True)) or [[], [], [], []]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor", "positive", "score", "id"])


def _asked(table: pa.Table) -> list[tuple]:
    """anchor, id, label and windows of each row; a window is (number, least, greatest, floor)."""
    windows = [[(w["number"], w["least"], w["greatest"], w["floor"]) for w in ws] for ws in table["windows"].to_pylist()]
    return list(zip(table["anchor"].to_pylist(), table["id"].to_pylist(), table["label"].to_pylist(), windows, strict=True))


def _read(block: _Block, asked: pa.Table, wanted: int, positives: bool) -> pa.Table:
    found = []
    scores = _products(matrix(asked["av"]), block.v)
    for row, (anchor, ident, label, windows) in zip(scores, _asked(asked), strict=True):
        for number, least, greatest, floor in windows:
            first = block.positives(ident, label, row, floor, wanted) if positives else block.negatives(ident, label, row, (least, greatest, floor), wanted)
            found += [(anchor, number, s, i) for s, i in first]
    return _out(found)


def _needed(zones: pa.Table, asked: pa.Table, positives: bool) -> list[list[int]]:
    """For each anchor, which of the zones it must read, its home left out."""
    lo, hi = matrix(zones["lo"]), matrix(zones["hi"])
    low, high = bounds(matrix(asked["av"]), lo, hi)
    numbers, labels, masks, out = zones["block"].to_numpy(), [set(x) for x in zones["labels"].to_pylist()], {}, []
    for least_here, most_here, home, (_, _, label, windows) in zip(low, high, asked["home"].to_pylist(), _asked(asked), strict=True):
        if label not in masks:
            masks[label] = np.array([label in x if positives else x != {label} for x in labels])
        fits = masks[label] & (numbers != home)
        meets = np.zeros(len(numbers), bool)
        for _, least, greatest, floor in windows:
            here = np.ones(len(numbers), bool) if floor is None else most_here >= floor
            meets |= here if positives else here & (most_here >= least) & (least_here <= greatest)
        out.append(np.flatnonzero(fits & meets))
    return out


def chosen(blocks: DataFrame, anchors: DataFrame, positives: bool) -> DataFrame:
    """``group``, ``block``, ``anchor``: the blocks that each anchor's windows must read, told from the zone maps alone."""
    zones = blocks.select("block", "lo", "hi", "labels")
    n, groups = zones.count(), _groups(anchors)
    chunks = max(1, -(-n // ZONES_AT_ONCE))
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<long>"))
    zones = zones.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks))).withColumn("group", spread(groups))

    def choose(zones: pa.Table, asked: pa.Table) -> pa.Table:
        who, where = [], []
        if zones.num_rows and asked.num_rows:
            numbers = zones["block"].to_numpy()
            for anchor, at in zip(asked["anchor"].to_pylist(), _needed(zones, asked, positives), strict=True):
                who.append(np.full(len(at), anchor, np.int64))
                where.append(numbers[at])
        join = lambda a: pa.array(np.concatenate(a) if a else [], pa.int64())
        group = asked["group"][0].as_py() if asked.num_rows else 0
        who = join(who)
        return pa.Table.from_arrays([pa.array([group] * len(who), pa.int64()), join(where), who], ["group", "block", "anchor"])

    # the stated anchors against the zone maps of all blocks, in blocks of both
    return zones.groupBy("group", "chunk").cogroup(anchors.withColumn("chunk", spread(chunks)).groupBy("group", "chunk")).applyInArrow(choose, "group long, block long, anchor long")


def _groups(anchors: DataFrame) -> int:
    return (anchors.agg(F.max("group")).first()[0] or 0) + 1


def _found(blocks: DataFrame, anchors: DataFrame, need: DataFrame, wanted: int, positives: bool) -> DataFrame:
    """What the anchors' windows find in the blocks of ``need(group, block, anchor)``; a block is read only for groups that need it."""
    # keys under other names, as both sides come from one table
    asked = need.withColumnsRenamed({"group": "asked_group", "block": "asked_block"}).join(anchors.drop("group"), "anchor")
    given = blocks.join(need.select("group", "block").distinct(), "block").select("group", "block", "ids", "row_labels", "v")

    def read(given: pa.Table, asked: pa.Table) -> pa.Table:
        if not given.num_rows or not asked.num_rows:
            return _out([])
        block = _Block(given["ids"][0].as_py(), given["row_labels"][0].as_py(), given["v"][0].as_py())
        return _read(block, asked, wanted, positives)

    return given.groupBy("group", "block").cogroup(asked.groupBy("asked_group", "asked_block")).applyInArrow(read, _FOUND)


def _first_of(found: DataFrame, wanted: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= wanted)


_ANCHOR = "anchor long, id long, label long, av array<int>, home long"
_EVERY = "array(struct(0 AS number, CAST(NULL AS long) AS least, CAST(NULL AS long) AS greatest, CAST(NULL AS long) AS floor))"


def _anchors(blocks: DataFrame) -> DataFrame:
    """The rows that ask, each under a number of its own, with the block they lie in and one open window."""

    def pick(batches):
        for batch in batches:
            for number, ids, labels, asks, data in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "row_labels", "asks", "v")), strict=True):
                at = np.flatnonzero(np.array(asks, bool))
                if len(at):
                    block = _Block(ids, labels, data)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number * BLOCK + at, pa.int64()), pa.array(block.ids[at], pa.int64()), pa.array(block.labels[at], pa.int64()),
                         list_column(block.v[at].ravel(), np.full(len(at), block.v.shape[1]), pa.int32()), pa.array(np.full(len(at), number), pa.int64())],
                        ["anchor", "id", "label", "av", "home"])

    anchors = stored(blocks.select("block", "ids", "row_labels", "asks", "v").mapInArrow(pick, _ANCHOR))
    groups = max(1, -(-anchors.count() // ANCHORS_AT_ONCE))
    return anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups))).withColumn("windows", F.expr(_EVERY))


def _home(anchors: DataFrame) -> DataFrame:
    return anchors.select("group", F.col("home").alias("block"), "anchor")


def _floored(anchors: DataFrame, found: DataFrame, wanted: int) -> DataFrame:
    """``anchors`` whose windows have the last score found for them as a floor, where as many as wanted were found."""
    floors = found.groupBy("anchor", "positive").agg(F.count("score").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= wanted)
    by_number = floors.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("positive", "floor"))).alias("floors"))
    with_floor = F.transform("windows", lambda w: w.withField("floor", F.try_element_at("floors", w["number"])))
    return anchors.join(by_number, "anchor", "left").withColumn("windows", with_floor).drop("floors")


def _search(blocks: DataFrame, anchors: DataFrame, wanted: int, positives: bool) -> DataFrame:
    """First the anchors' homes, then the blocks whose bounds reach the floors found there."""
    home = stored(_found(blocks, anchors, _home(anchors), wanted, positives))
    anchors = stored(_floored(anchors, home, wanted))
    beyond = _found(blocks, anchors, stored(chosen(blocks, anchors, positives)), wanted, positives)
    return stored(_first_of(home.unionByName(beyond), wanted))


def mine(rows: DataFrame, is_anchor: str = "id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` from ``rows(id, label, v)``."""
    rows = rows.where("label IS NOT NULL").select("id", F.col("label").cast("long").alias("label"), "v", F.coalesce(F.expr(is_anchor), F.lit(False)).alias("asks"))
    blocks = blocks_of(stored(rows))
    anchors = _anchors(blocks)
    near = _search(blocks, anchors, positives, True).select("anchor", F.col("rank").alias("positive"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    # whole numbers s with low * p <= 100 * s <= high * p
    window = F.struct(F.col("positive").alias("number"), F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, 100)) DIV 100)").alias("least"),
                      F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) DIV 100").alias("greatest"), F.lit(None).cast("long").alias("floor"))
    windows = near.select("anchor", window.alias("w")).where("w.least <= w.greatest").groupBy("anchor").agg(F.collect_list("w").alias("windows"))
    far = _search(blocks, stored(anchors.drop("windows").join(windows, "anchor")), negatives, False)
    ids = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return far.select("anchor", "positive", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id")).join(near, ["anchor", "positive"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label AS label, e.id, e.label AS other, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score FROM e AS a JOIN e ON e.id <> a.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE other = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE other <> label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10"""
