"""Near-duplicate classes by BagMinHash signatures of word shingles and verified multiset overlap.

A document is the multiset of its shingles of five words; two documents are linked if their weighted Jaccard similarity
(sum of smaller over sum of larger multiplicities) is at least the threshold, and a class is what links connect.

1. Signatures. Each shingle has a Poisson process of points (time, slot, weight level) for the unit of weight 0..1 and for each octave
   1..2, 2..4, 4..8 and so on, with the octave's length as its rate. A point's place in its octave is found by halving it again and
   again; the point counts if it lies below the shingle's weight. A slot keeps its earliest point, so two documents agree in a slot
   with a probability equal to their similarity. The processes run up to a time by which all slots are probably taken, and on
   for the documents of which some are not; a heavy weight costs a process per octave and not one per unit.
2. Equal multisets are one text, represented by the smallest doc_id. ``BANDS`` bands of ``ROWS`` slots are keys; a pair at 0.8
   shares none with a probability of 4e-8, and texts that share one are candidates.
3. Within a key no pairs are enumerated. In the first round one member is compared with all others; then classes are joined, and
   keys that hold one class are closed. In later rounds centres among the members outside a key's largest class, first a sample
   in the largest key of each text and then all, are compared with the members of other classes: pair by pair where a key has few members, else in blocks of centres and
   members, which give a spanning forest of what they link. A centre has met all and leaves its key, and a key is closed
   once those left are of one class. Then no link between classes is left untested.
4. A comparison first looks at 8-bit prints of the slots (six standard errors below the threshold), then counts the
   multiset overlap exactly.

Defined results: documents without words, and rows without a doc_id, are classes of their own (the latter's class_id is null); a text of fewer
than five words is one shingle; rows that share a doc_id are one document, and join the classes of its texts. An empty table gives
an empty table. Other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import list_column, rows, stored, without, words
from provenant.llm.substrings import _BASE, WordHashes, window_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 56, 6
SLOTS = BANDS * ROWS
DEVIATIONS = 6
# Distinct shingles that are worked on at once; bounds a task's memory.
AT_ONCE = 40_000
# Members of a key up to which its pairs are listed; centres and members of a block beyond that.
FEW = 16
CENTRES, MEMBERS = 512, 4096

SIGNATURE = "doc long, h1 long, h2 long, n int, keys array<long>, prints binary"
_NEVER = np.uint64(2**64 - 1)
_G, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(found: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and how often each occurs."""
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(window_hashes(known.of(found)[0], min(SHINGLE, len(found)), _BASE), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """Earliest times per slot (a row for each bag that is not empty), as whole multiples of 2**-40."""
    owner = np.repeat(np.arange(len(bags)), [len(k) for k, _ in bags])
    keys, weights = np.concatenate([k for k, _ in bags]), np.concatenate([w for _, w in bags])
    totals = np.bincount(owner, weights, minlength=len(bags))
    octaves, parts = 0, []
    while True:
        low = 0 if octaves == 0 else 1 << octaves - 1
        at = np.flatnonzero(weights > low)
        if not len(at):
            break
        parts.append((owner[at], _mix(keys[at] + np.array([octaves], np.uint64) * _G), weights[at], np.full(len(at), low), np.full(len(at), float(max(low, 1)))))
        octaves += 1
    owner, seed, weights, low, rate = (np.concatenate(c) for c in zip(*parts, strict=True))
    first = np.full(len(bags) * slots, _NEVER)
    horizon = slots * (np.log(slots) + 1.5) / totals
    time, drawn = np.zeros(len(owner), np.uint64), np.zeros(len(owner), np.uint64)
    active = np.arange(len(owner))
    while len(active):
        # about as many points as the time that is left has, for all processes at once
        left = rate[active] * (horizon[owner[active]] - time[active] * 2.0**-40)
        n = np.ceil(left + np.sqrt(left) + 1).astype(np.int64)
        ends = np.cumsum(n)
        of = np.repeat(active, n)
        place = (np.arange(ends[-1]) - np.repeat(ends - n, n)).astype(np.uint64) + np.repeat(drawn[active], n)
        u = _mix(seed[of] + (place + np.uint64(1)) * _G)
        waits = (-np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[of] * 2.0**40).astype(np.uint64)
        # in whole numbers, so that sums do not depend on what else is in the batch
        sums = np.cumsum(waits)
        before = np.concatenate([np.zeros(1, np.uint64), sums[ends[:-1] - 1]]) if len(ends) > 1 else np.zeros(1, np.uint64)
        times = sums - np.repeat(before - time[active], n)
        v = _mix(u ^ _M1)
        slot = ((v >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        # bit by bit from the highest: which half of the octave, which quarter, and so on
        level = low[of] + ((v & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate[of]).astype(np.int64)
        inside = level < weights[of]
        np.minimum.at(first, owner[of][inside] * slots + slot[inside], times[inside])
        time[active], drawn[active] = times[ends - 1], drawn[active] + n.astype(np.uint64)
        # points after the horizon are kept as well, but a slot's earliest one is only sure up to it
        going_on = time * 2.0**-40 <= horizon[owner]
        while not going_on.any():
            unsure = (first.reshape(-1, slots).max(axis=1) * 2.0**-40) > horizon
            if not unsure.any():
                break
            horizon[unsure] *= 1.5
            going_on = time * 2.0**-40 <= horizon[owner]
        active = np.flatnonzero(going_on)
    return first.reshape(-1, slots)


def _signed_batches(batches):
    known = WordHashes()
    held, pending = 0, []
    for doc, text in rows(batches, "doc", "text"):
        bag = shingles(words(text), known)
        if len(bag[0]):
            pending.append((doc, bag))
            held += len(bag[0])
        if held >= AT_ONCE:
            yield _signature_rows(pending)
            held, pending = 0, []
    if pending:
        yield _signature_rows(pending)


def _signature_rows(pending) -> pa.RecordBatch:
    mixed = _mix(signatures([bag for _, bag in pending]))
    keys = np.zeros((len(pending), BANDS), np.uint64)
    for r in range(ROWS):
        keys = (keys ^ mixed.reshape(-1, BANDS, ROWS)[:, :, r]) * _G
        keys ^= keys >> np.uint64(29)
    keys = _mix(keys + np.arange(BANDS, dtype=np.uint64))
    prints = (mixed >> np.uint64(56)).astype(np.uint8)
    whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.tobytes() + c.tobytes()) for _, (k, c) in pending), "<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in pending], pa.int64()), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()),
         pa.array([int(c.sum()) for _, (_, c) in pending], pa.int32()),
         list_column(keys.ravel().view(np.int64), np.full(len(pending), BANDS), pa.int64()), pa.array([p.tobytes() for p in prints], pa.binary())],
        ["doc", "h1", "h2", "n", "keys", "prints"])


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def _likely(threshold: float):
    least = SLOTS * (threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / SLOTS))

    def likely(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("prints_a", "prints_b"))
            kept = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    return likely


def _linked(threshold: float):
    def linked(batches):
        known = WordHashes()
        bag = functools.lru_cache(2)(lambda text: shingles(words(text), known))
        for batch in batches:
            found = [(a, b) for a, b, s, t in rows([batch], "a", "b", "text_a", "text_b") if overlap(bag(s), shingles(words(t), known)) >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return linked


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label``: the smallest node of what the ``edges(a, b)`` connect."""
    edges = stored(edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())
    both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("before"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        moved = stored(lower.join(jump, "next", "left").select("node", "before", F.least("next", F.coalesce("beyond", "next")).alias("label")))
        labels = moved.select("node", "label")
        if moved.where("label <> before").limit(1).count() == 0:
            return labels


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``doc_id``, its number of shingles, its class (smallest doc_id) and the number of rows in that class."""
    text = F.col("text").cast("string")
    given = docs.select(F.col("doc_id").cast("long").alias("doc"), text.alias("text"))
    signed = stored(given.where("doc IS NOT NULL AND text IS NOT NULL").mapInArrow(_signed_batches, SIGNATURE))
    texts = signed.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.min("n").alias("n"))
    members = signed.select("doc", "h1", "h2", "n").join(texts.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc", "n", "rep")
    reps = signed.join(texts.select("h1", "h2", F.col("rep").alias("doc")), ["h1", "h2", "doc"]).select(F.col("doc").alias("node"), "keys", "prints")
    found = _classes_of_texts(given, signed, reps, members, threshold)
    of_docs = (
        members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .groupBy("doc").agg(F.min(F.coalesce("label", "rep")).alias("class_id"), F.max("n").cast("long").alias("n"))
    )
    rows_of = given.select("doc").join(of_docs, "doc", "left").select("doc", F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"))
    sizes = rows_of.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return rows_of.join(sizes, "class_id", "left").select(
        F.col("doc").alias("doc_id"), "n_shingles", "class_id", F.when(F.col("doc").isNull(), 1).otherwise(F.col("class_size")).cast("long").alias("class_size"))


def _classes_of_texts(given, signed, reps, members, threshold) -> DataFrame:
    spread = reps.select(F.explode("keys").alias("key"), "node")
    shared = spread.groupBy("key").agg(F.count("*").alias("times"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    held = stored(spread.join(shared, "key").distinct().select("key", "node", F.col("node").alias("label")))
    nodes = held.select("node").distinct()
    prints = stored(reps.join(nodes, "node", "left_semi").select("node", "prints"))
    bodies = stored(given.join(nodes.withColumnRenamed("node", "doc"), "doc", "left_semi").distinct())
    # several texts of one doc_id belong together from the start
    links = members.where("doc <> rep").join(members.select("doc", F.col("rep").alias("other")).distinct(), "doc").where("rep < other").selectExpr("rep AS a", "other AS b")
    labels, rounds = components(links), 0
    while True:
        held = held.drop("label").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        mixed = held.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("n")).where("l < h").select("key", "n")
        held = stored(held.join(mixed, "key").select("key", "node", "label", "n"))
        if held.limit(1).count() == 0:
            return labels
        met = held
        if rounds == 1:
            # a first sample of centres meets each text once, in its largest key, and leaves no key for that
            most = held.groupBy("node").agg(F.max(F.struct("n", "key")).alias("m")).select("node", F.col("m.key").alias("key"))
            met = stored(held.join(most, ["key", "node"]))
        drawn = stored(_drawn(met, rounds))
        small = F.col("n") <= FEW if rounds else F.lit(True)
        edges = _pair_by_pair(met.where(small), drawn.where(small), prints, bodies, threshold)
        if rounds:
            edges = edges.unionByName(_in_blocks(met.where(~small), drawn.where(~small), bodies, threshold))
        links = stored(links.unionByName(edges))
        labels, rounds = components(links), rounds + 1
        held = (held if rounds == 2 else held.join(drawn.selectExpr("key", "centre AS node"), ["key", "node"], "left_anti")).select("key", "node", "label")


def _drawn(held: DataFrame, rounds: int) -> DataFrame:
    """``key, centre, from, n``: at first one member of each key; then 16 of those outside its largest class; then all of them."""
    if rounds == 0:
        least = held.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "label", "n")).alias("m"))
        return least.select("key", F.col("m.node").alias("centre"), F.col("m.label").alias("from"), F.col("m.n").alias("n"))
    largest = (held.groupBy("key", "label").agg(F.count("*").alias("of")).groupBy("key")
               .agg(F.max(F.struct(F.col("of"), -F.col("label"))).alias("m")).select("key", (-F.col("m.col2")).alias("main")))
    outside = held.join(largest, "key").where("label <> main")
    if rounds == 1:
        per_key = outside.groupBy("key").agg(F.count("*").alias("out"), F.min(F.xxhash64("node")).alias("lowest"))
        even = F.xxhash64("node", F.lit(7)) / F.lit(2.0**64) + 0.5
        outside = outside.join(per_key, "key").where((F.col("n") <= FEW) | (F.xxhash64("node") == F.col("lowest")) | (even < F.lit(16.0) / F.col("out")))
    return outside.select("key", F.col("node").alias("centre"), F.col("label").alias("from"), "n")


def _pair_by_pair(held, drawn, prints, bodies, threshold) -> DataFrame:
    pairs = (
        drawn.select("key", "centre", "from").join(held.select("key", "node", "label"), "key").where("label <> `from`")
        .selectExpr("least(centre, node) AS a", "greatest(centre, node) AS b").distinct()
    )
    likely = (
        pairs.join(prints.selectExpr("node AS a", "prints AS prints_a"), "a").join(prints.selectExpr("node AS b", "prints AS prints_b"), "b")
        .mapInArrow(_likely(threshold), "a long, b long")
    )
    return (
        stored(likely).join(bodies.selectExpr("doc AS b", "text AS text_b"), "b").join(bodies.selectExpr("doc AS a", "text AS text_a"), "a")
        .mapInArrow(_linked(threshold), "a long, b long")
    )


def _in_blocks(held, drawn, bodies, threshold) -> DataFrame:
    """Links between centres and members of the same keys, found in blocks of bounded size."""
    sizes = drawn.groupBy("key").agg(F.count("*").alias("c"))
    blocks = lambda n, of: F.ceil(F.col(n) / of).cast("int")
    block = lambda node, n, of: F.pmod(F.hash(node), blocks(n, of))
    every = lambda n, of: F.explode(F.sequence(F.lit(0), blocks(n, of) - 1))
    members = (
        held.join(sizes, "key").select("key", "node", "label", block("node", "n", MEMBERS).alias("mb"), every("c", CENTRES).alias("cb"))
        .join(bodies.select(F.col("doc").alias("node"), "text"), "node")
    )
    centres = (
        drawn.join(sizes, "key").select(F.col("key").alias("k"), F.col("centre").alias("node"), F.col("from").alias("label"), every("n", MEMBERS).alias("m"), block("centre", "c", CENTRES).alias("c"))
        .join(bodies.select(F.col("doc").alias("node"), F.col("text").alias("body")), "node")
    )

    def linked(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _forest(left, right, threshold) if left.num_rows and right.num_rows else []
        return pa.Table.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return members.groupBy("key", "mb", "cb").cogroup(centres.groupBy("k", "m", "c")).applyInArrow(linked, "a long, b long")


def _units(bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each unit of weight of each shingle as a value of its own, and whose it is: common units are the overlap."""
    keys, weights = np.concatenate([k for k, _ in bags]), np.concatenate([w for _, w in bags])
    owner = np.repeat(np.repeat(np.arange(len(bags)), [len(k) for k, _ in bags]), weights)
    ends = np.cumsum(weights)
    level = np.arange(ends[-1]) - np.repeat(ends - weights, weights)
    return _mix(np.repeat(keys, weights) + level.astype(np.uint64) * _M2), owner


def _forest(left: pa.Table, right: pa.Table, threshold: float) -> list[tuple[int, int]]:
    """Links of a block that connect different classes, as few as do so."""
    known = WordHashes()
    bags = [shingles(words(t), known) for t in left["text"].to_pylist()]
    nodes, labels = left["node"].to_pylist(), left["label"].to_pylist()
    units, owner = _units(bags)
    order = np.argsort(units, kind="stable")
    units, owner = units[order], owner[order]
    totals = np.bincount(owner, minlength=len(bags))
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    for centre, label, text in zip(*(right[c].to_pylist() for c in ("node", "label", "body")), strict=True):
        own, _ = _units([shingles(words(text), known)])
        low, high = np.searchsorted(units, own), np.searchsorted(units, own, side="right")
        n = high - low
        ends = np.cumsum(n)
        common = np.bincount(owner[np.arange(ends[-1]) + np.repeat(low - (ends - n), n)], minlength=len(bags))
        for i in np.flatnonzero(common / (totals + len(own) - common) >= threshold):
            a, b = root(label), root(labels[i])
            if a != b:
                parent[a] = b
                out.append((centre, nodes[i]))
    return out


def representatives(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of each class: the one of its smallest doc_id, and among rows that repeat that id the least by all columns."""
    found = classes(docs, threshold)
    kept = without(docs, found.where("class_id <> doc_id").select("doc_id"))
    twice = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.limit(1).count() == 0:
        return kept
    order = Window.partitionBy("doc_id").orderBy(*(c for c in docs.columns if c != "doc_id"))
    least = kept.join(twice, "doc_id", "left_semi").withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")
    return without(kept, twice).unionByName(least)
