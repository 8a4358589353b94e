"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the model goes on after a blank marker that follows another character (``crossing_pieces`` looks through
the whole vocabulary, and a model with such pieces is refused), and the model changes no characters before it
segments. A text, with its leading marker, therefore falls into chunks, each a run of markers and what follows up to the
next marker, and merges never cross their borders.

1. One pass over the texts numbers the chunks in blocks of whole documents. A block's row has its documents, the numbers in
   order of position, and its distinct chunks, sorted within shares by the chunk's hash. These rows are bucketed by block.
2. The shares of all blocks are dealt out by share, so that each distinct chunk is segmented once, by the library, in the one
   task that has its share, and its ids are sent to the blocks that hold it.
3. Ids return to the bucketed blocks, which are not shuffled again, and are put in order of position there.

Defined results: a null text is an empty one and has no ids; rows that repeat a document are encoded each; a chunk of any
length is one key; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import itertools
import re
import uuid

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm.common import Codes, code_array, list_column, new_folder, rows

MARK = "▁"
# A block is full at so many chunks, letters or documents, whichever comes first.
BLOCK_CHUNKS = 1_500_000
BLOCK_LETTERS = 64 << 20
BLOCK_DOCS = 200_000
# Documents, and letters of their texts, that are handed on at once.
ROWS_AT_ONCE = 500
LETTERS_AT_ONCE = 32 << 20
# A task keeps the ids of the distinct chunks of one share at a time.
SHARES_A_PARTITION = 4

BLOCK = "block long, docs array<long>, counts array<int>, width int, codes binary, ranks binary, shares array<struct<share: int, n: int, chunks: binary>>"
TABLE = "place long, share int, n int, ids binary, odd array<struct<i: int, decoded: string>>"
ENCODED = "doc_id long, ids array<int>, decoded string"
_chunks = re.compile(" +[^ ]*").findall


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def crossing_pieces(processor) -> list[str]:
    """Pieces in which a marker follows another character."""
    return [p for p in map(processor.id_to_piece, range(processor.get_piece_size())) if re.search(f"[^{MARK}]{MARK}", p)]


def _check(processor) -> None:
    if crossing := crossing_pieces(processor):
        raise ValueError(f"pieces cross blank markers: {crossing[:5]}")
    if processor.encode_as_pieces("a  ") != [*processor.encode_as_pieces("a"), MARK * 2]:
        raise ValueError("the model changes blanks, so chunks cannot be segmented alone")


def chunks_of(text: str | None) -> list[str]:
    return _chunks(" " + text.replace(MARK, " ")) if text else []


def segment(processor, chunk: str) -> list[int]:
    """Ids of one chunk; the library adds the first marker itself, except for an empty text."""
    return processor.encode(chunk[1:]) if len(chunk) > 1 else [processor.piece_to_id(MARK)]


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """Ids of ``docs(doc_id, text)`` as the library gives them, and the text it decodes them to."""
    _check(load(model))
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # the model file, whose size the vocabulary fixes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = parts * SHARES_A_PARTITION
    blocks = _bucketed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_blocks(shares), BLOCK))

    def segmented(batches):
        processor, last, known = load(shipped.value), None, {}
        for batch in batches:
            for place, share, n, packed in rows([batch], "place", "share", "n", "chunks"):
                if share != last:
                    last, known = share, {}
                ids, odd = [], []
                for i, chunk in enumerate(_unpacked(packed)):
                    if chunk not in known:
                        found = segment(processor, chunk)
                        surface = " " + processor.decode(found)
                        known[chunk] = (np.array(found, np.int32), None if surface == chunk else surface)
                    found, surface = known[chunk]
                    ids.append(found)
                    if surface is not None:
                        odd.append({"i": i, "decoded": surface})
                sizes = np.array([len(i) for i in ids], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place]), pa.array([share], pa.int32()), pa.array([n], pa.int32()),
                     pa.array([zstandard.compress(_planes(np.concatenate([sizes, *ids])))], pa.binary()),
                     pa.array([odd], pa.list_(pa.struct([("i", pa.int32()), ("decoded", pa.string())])))],
                    ["place", "share", "n", "ids", "odd"])

    table = (
        blocks.select(F.col("block").alias("place"), F.explode("shares").alias("s")).select("place", "s.share", "s.n", "s.chunks")
        .repartition(parts, "share").sortWithinPartitions("share").mapInArrow(segmented, TABLE)
    )
    return blocks.groupBy("block").cogroup(table.groupBy("place")).applyInArrow(_joined, ENCODED)


def _packed(chunks: list[str]) -> bytes:
    """Chunks hold no marker (theirs are blanks), so it can part them."""
    return zstandard.compress(MARK.join(chunks).encode())


def _unpacked(packed: bytes) -> list[str]:
    return zstandard.decompress(packed).decode().split(MARK)


def _planes(values: np.ndarray, width: int = 4) -> bytes:
    """Little-endian bytes, those of like weight together, as they compress better."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def _values(planes: bytes, width: int = 4) -> np.ndarray:
    out = np.zeros(len(planes) // width, np.int64)
    for k, plane in enumerate(np.frombuffer(planes, np.uint8).reshape(width, -1)):
        out |= plane.astype(np.int64) << 8 * k
    return out


def _bucketed(blocks: DataFrame) -> DataFrame:
    """A table whose files are bucketed by block, so that the join that follows moves only the other side."""
    spark: SparkSession = blocks.sparkSession
    name, n = f"blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    (blocks.write.bucketBy(n, "block").option("compression", "zstd").option("path", new_folder(spark))
     .format("parquet").saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files lie in a folder of their own
    return table


def _blocks(shares: int):
    def blocks(batches):
        number = TaskContext.get().partitionId() << 32
        vocabulary, docs, parts, held, letters = Codes(), [], [], 0, 0
        for doc_id, text in rows(batches, "doc_id", "text"):
            docs.append(doc_id)
            parts.append(code_array(vocabulary, chunks_of(text)))
            held += len(parts[-1])
            letters += len(text or "")
            if held >= BLOCK_CHUNKS or letters >= BLOCK_LETTERS or len(docs) >= BLOCK_DOCS:
                yield _block(number, vocabulary, docs, parts, shares)
                vocabulary, docs, parts, held, letters, number = Codes(), [], [], 0, 0, number + 1
        if docs:
            yield _block(number, vocabulary, docs, parts, shares)

    return blocks


def _block(number: int, vocabulary: Codes, docs: list, parts: list[np.ndarray], shares: int) -> pa.RecordBatch:
    keyed = sorted((xxhash.xxh32_intdigest(chunk) % shares, chunk, code) for chunk, code in vocabulary.items())
    found = np.concatenate(parts)
    # the more frequent, the smaller the number: high bytes are mostly zero then and compress well
    ranks = np.empty(len(keyed), np.int64)
    ranks[np.argsort(-np.bincount(found, minlength=len(keyed)), kind="stable")] = np.arange(len(keyed))
    codes = ranks[found]
    width = 1 + sum(len(keyed) > 1 << bits for bits in (8, 16, 24))
    packed = [{"share": share, "n": len(chunks), "chunks": _packed(chunks)}
              for share, chunks in ((s, [c for _, c, _ in group]) for s, group in itertools.groupby(keyed, key=lambda k: k[0]))]
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int32())),
         pa.array([width], pa.int32()), pa.array([_planes(codes, width)], pa.binary()),
         pa.array([_planes(ranks[[code for _, _, code in keyed]], width)], pa.binary()),
         pa.array([packed], pa.list_(pa.struct([("share", pa.int32()), ("n", pa.int32()), ("chunks", pa.binary())])))],
        ["block", "docs", "counts", "width", "codes", "ranks", "shares"],
    )


def _joined(blocks: pa.Table, table: pa.Table) -> pa.Table:
    docs, counts = blocks["docs"][0].as_py(), np.array(blocks["counts"][0].as_py(), np.int64)
    codes, ranks = (_values(blocks[c][0].as_py(), blocks["width"][0].as_py()) for c in ("codes", "ranks"))
    shares, chunks, sizes, flat = blocks["shares"][0].as_py(), [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    back = {r["share"]: r for r in table.to_pylist()}
    if back.keys() != {s["share"] for s in shares}:
        raise RuntimeError(f"{len(back)} of {len(shares)} shares of a block have ids")
    for s in shares:
        surfaces, r = _unpacked(s["chunks"]), back[s["share"]]
        for other in r["odd"]:
            surfaces[other["i"]] = other["decoded"]
        chunks += surfaces
        values = _values(zstandard.decompress(r["ids"]))
        sizes.append(values[: s["n"]])
        flat.append(values[s["n"] :])
    sizes, flat = np.concatenate(sizes), np.concatenate(flat).astype(np.int32)
    first = np.cumsum(sizes) - sizes
    by_rank = np.argsort(ranks)
    sizes, first, chunks = sizes[by_rank], first[by_rank], [chunks[i] for i in by_rank]
    bounds, batches = np.concatenate([[0], np.cumsum(counts)]), []
    written = np.concatenate([[0], np.cumsum(np.array([len(c) for c in chunks], np.int64)[codes])])[bounds]
    a = 0
    while a < len(docs):
        # one document at least, else no more letters than a column of texts can hold
        b = max(a + 1, min(a + ROWS_AT_ONCE, len(docs), int(np.searchsorted(written, written[a] + LETTERS_AT_ONCE, side="right")) - 1))
        here = codes[bounds[a] : bounds[b]]
        n = sizes[here]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[here] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[bounds[a : b + 1] - bounds[a]]
        named = here.tolist()
        texts = ["".join(map(chunks.__getitem__, named[s:e]))[1:] for s, e in zip((bounds[a:b] - bounds[a]).tolist(), (bounds[a + 1 : b + 1] - bounds[a]).tolist(), strict=True)]
        batches.append(pa.RecordBatch.from_arrays(
            [pa.array(docs[a:b], pa.int64()), list_column(ids, np.diff(edges), pa.int32()), pa.array(texts, pa.string())],
            ["doc_id", "ids", "decoded"]))
        a = b
    return pa.Table.from_batches(batches)


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
