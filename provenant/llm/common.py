"""What several operators of this subpackage share: tables in the shared folder, words, arrays."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.session import app_folder

# A-Z in lower case; every other ASCII byte that is neither a digit nor a-z becomes a blank.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_SPACES = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the one that driver and executors share; it is removed when the program ends."""
    return f"{app_folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once, compressed, to the shared folder and read back; a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: str | None) -> list[bytes]:
    """Words of letters, digits and bytes above ASCII, A-Z in lower case, as UTF-8."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Words between blanks (0x20, 0x09 to 0x0D), unchanged, as UTF-8."""
    return text.encode().translate(_SPACES).split() if text else []


class Codes(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def code_array(codes: dict, items: list) -> np.ndarray:
    return np.fromiter(map(codes.__getitem__, items), np.int32, len(items))


def rows(batches, *columns: str):
    """Tuples of the named columns, row by row."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row's list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    return column.values.to_numpy(zero_copy_only=False), offsets


def fresh(df: DataFrame, name: str) -> str:
    """A column name beginning with ``name`` that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not among ``ids``; null ids equal null ids."""
    name = fresh(docs, "gone")
    gone = ids.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
