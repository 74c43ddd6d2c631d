"""What the operators of this subpackage share: reading tables, cutting lineage, Arrow buffers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop  # noqa: F401  for the operators
from . import vec


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of 64 bits that a filter of keys has at most: some 40 MB where it is broadcast, whatever the number of keys.
FILTER_ROWS = 1 << 20


def may_meet(docs: DataFrame, on: list[Column], keys: DataFrame, name: str) -> DataFrame:
    """docs with a boolean column of that name: true where `on` is among the rows of keys (a written table; its first columns), and for few other rows. A table of
    bits (one for each hash of a key, FILTER_ROWS * 64 at most) is broadcast, so that wide rows need not be dealt out; where keys outgrow the bits, more of the other rows are true."""
    word_name, mask = unused([*docs.columns, *keys.columns, name], "_word", "_mask")
    bits = 64 << min(FILTER_ROWS.bit_length() - 1, max(4, (keys.count() // 4).bit_length()))
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(bits))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    word = lambda at: F.shiftright(at, 6)
    at = place([F.col(k) for k in keys.columns[: len(on)]])
    masks = keys.select(word(at).alias(word_name), bit(at).alias(mask)).groupBy(word_name).agg(F.bit_or(mask).alias(mask))
    at = place(on)
    met = docs.join(F.broadcast(masks), word(at) == masks[word_name], "left")
    return met.select(*[docs[c] for c in docs.columns], F.coalesce(masks[mask].bitwiseAND(bit(at)) != 0, F.lit(False)).alias(name))


def with_keys(docs: DataFrame, on: list[Column], keys: DataFrame, how: str, exact: list[Column] | None = None) -> DataFrame:
    """The rows of docs whose `on` is (how="left_semi") or isn't (how="left_anti") among the rows of keys, a written table; null equals null. exact: further
    expressions, for further columns of keys, that only rows whose `on` may be there are asked for. Only rows that may_meet the keys are dealt out to the
    exact join; the others are decided in the scan."""
    (may,) = unused([*docs.columns, *keys.columns], "_may")
    met = may_meet(docs, on, keys, may)
    same = None
    for mine, theirs in zip([*on, *(exact or [])], keys.columns, strict=True):
        one = mine.eqNullSafe(keys[theirs])
        same = one if same is None else same & one
    asked = met.where(F.col(may)).drop(may).join(keys.hint("shuffle_hash"), same, how)
    return asked if how == "left_semi" else met.where(~F.col(may)).drop(may).unionByName(asked)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, changed where a column has them already (Spark tells names apart without regard to case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: the worker lives on, and its next tasks have other shapes."""
    vec.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Bytes of an Arrow batch (one row at least). Spark's own bound, 64 MB, is met in the JVM and in the worker, for each task and in both directions.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow over batches of BATCH_BYTES, after which the worker gives its memory back. Lower bounds that the session has already stay."""
    conf = df.sparkSession.conf
    if conf.get(BATCH) == "67108864b":
        conf.set(BATCH, BATCH_BYTES)

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values in one array, and len + 1 offsets into it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of_texts(offsets: np.ndarray, most: int):
    """Index ranges of consecutive values that hold at most `most` bytes together (one value at least)."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


def ascii_lower(column):
    """A-Z to a-z, no other letter, as a column expression."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
