"""What several operators share: names, null-safe columns, skew-safe lookups."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes that a broadcast lookup may have, proven by counting its rows and the
#: bytes of its texts.
BROADCAST_BYTES = 1 << 20
#: Bytes of Arrow rows that are turned into Python objects at once.
SLICE_BYTES = 4 << 20
#: Keys that may be called hot; a key is if it has over one row in so many.
HOT_KEYS, HOT_LEAST = 1000, 500


def c(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the letter case."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SLICE_BYTES, of one row at least."""
    rows = max(1, b.num_rows * SLICE_BYTES // max(1, b.nbytes))
    return (b.slice(lo, rows) for lo in range(0, b.num_rows, rows))


def tidy() -> None:
    """Give memory back that the allocators of a worker keep: other stages share
    the worker, and its executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the C library that has it


def map_frames(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """mapInPandas whose whole numbers stay whole numbers next to nulls, and whose
    frames are small in bytes.

    A column with nulls arrives as Python objects instead of floats, so that no
    64-bit id loses digits. A batch of long texts or lists is cut into frames of
    about SLICE_BYTES, for Python objects take several times that."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One thread: a pool would hold memory for each of its threads.
        frames = (x.to_pandas(integer_object_nulls=True, use_threads=False, deduplicate_objects=False) for b in found for x in slices(b))
        for out in run(frames):
            if not len(out):  # an empty column of lists has no type of its own
                continue
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False, nthreads=1)
        tidy()

    return df.mapInArrow(batches, struct)


def broadcast_if_small(lookup: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a lookup for broadcast if a count of its rows and of the bytes of
    its texts proves it small; else leave the join to a shuffle, whose skewed
    partitions adaptive execution splits. ``lookup`` should be a written table,
    so that the count is cheap."""
    wide = [F.coalesce(F.octet_length(c(f.name)), F.lit(0)) for f in lookup.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    fixed = 16 + 8 * len(lookup.columns)
    first = lookup.select(sum(wide, F.lit(fixed)).alias("size")).limit(most_bytes // fixed + 1)
    r = first.agg(F.sum("size").alias("size")).first()
    return F.broadcast(lookup) if (r["size"] or 0) <= most_bytes else lookup


def join_hot(left: DataFrame, right: DataFrame, on: str, weight: str) -> DataFrame:
    """Inner join with a written table of unique keys, whose column ``weight``
    says how many rows of ``left`` each key has.

    Hot keys, over one row in HOT_KEYS each and so at most HOT_KEYS of them, are
    broadcast: their rows stay where they are. All other keys shuffle."""
    total = right.agg(F.sum(weight).alias("n")).first().n or 0
    cut = max(HOT_LEAST, total // HOT_KEYS)
    hot = right.where(F.col(weight) > cut)
    if not hot.limit(1).count():
        return left.join(broadcast_if_small(right), on)
    # Spark gives the two reads of each side columns of their own.
    warm = left.join(F.broadcast(hot.select(F.col(on).alias("__hot"))), F.col(on) == F.col("__hot"), "left_anti")
    rest = warm.join(broadcast_if_small(right.where(F.col(weight) <= cut)), on)
    return left.join(F.broadcast(hot), on).unionByName(rest)


@functools.lru_cache(maxsize=8)
def lower_table() -> bytes:
    """Byte table that lower-cases A-Z and leaves all else."""
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""
