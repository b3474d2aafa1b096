"""What several operators of this subpackage need."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.plans.shared import FILTER_BITS, is_small

#: Rows and bytes of one Arrow batch: texts may be long, and a batch is held in memory.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20

#: Bytes of a text that are split into words at once.
SLICE_BYTES = 1 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")

def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small; a smaller setting of the session stays.

    Spark reads the setting when a plan runs, after the operator has returned, so it is not
    put back; other queries of the session only get smaller batches.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_rows(df: DataFrame, row: Callable[..., tuple], schema) -> DataFrame:
    """``row(*columns)`` over Arrow batches; it returns one tuple of the output for each row."""
    bounded_batches(df.sparkSession)
    out = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            made = [row(*values) for values in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = list(zip(*made, strict=True)) if made else [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out.types, strict=True)], schema=out)

    return df.mapInArrow(batches, schema)


def as_row(df: DataFrame, **named: Column) -> DataFrame:
    """Each row of ``df`` as one struct column ``row``, beside named columns of it, so no name of the caller's can clash.

    ``select("row.*")`` gives the rows back.
    """
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(n) for n, c in named.items()))


def lookup(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join to a table with one row a key, null keys matching null.

    ``small``, which should be stored, is counted first: within the bounds of ``is_small`` it
    is broadcast, and beyond that both sides shuffle and adaptive execution splits hot keys.
    Its key columns are dropped from the result, its other names must be new to ``df``.
    """
    renamed = small.select(*(F.col(k).alias(f"__key_{k}") if k in keys else F.col(k) for k in small.columns))
    if is_small(renamed):
        renamed = F.broadcast(renamed)
    on = [df[k].eqNullSafe(renamed[f"__key_{k}"]) for k in keys]
    return df.join(renamed, on, how).drop(*(f"__key_{k}" for k in keys))


def byte_slices(text: bytes | None, length: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in order, in pieces of about ``length`` bytes; each but the first begins with white space."""
    start, text = 0, text or b""
    while len(text) - start > length:
        cut = _BLANK.search(text, start + length)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def word_slices(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, ``[^\\x20\\x09-\\x0D]+``, which is what bytes are split at, slice by slice."""
    for part in byte_slices(text):
        yield part.split()


def hash_filter(df: DataFrame, column: str, members: int):
    """A bitmap of the hashes in a column, 64 bits for each of ``members`` and FILTER_BITS (64 MB) at most.

    Bits are set by a distributed aggregation; what reaches the driver is the bitmap alone.
    """
    import numpy as np

    bits = min(FILTER_BITS, 1 << max(16, (64 * max(members, 1) - 1).bit_length()))
    place = F.pmod(F.col(column), F.lit(bits)) + 1  # buckets count from 1
    maps = df.select(place.alias("__at")).groupBy(F.bitmap_bucket_number("__at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__at")).alias("bits"))
    found = np.zeros((bits >> 15, 4096), np.uint8)
    for r in maps.collect():  # rows of 4096 bytes, as many as the bound allows
        found[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return found.ravel()


def may_hold(bitmap, hashes):
    """Whether each 64-bit hash may be among the members of a filter; never false for one that is."""
    at = hashes & (8 * len(bitmap) - 1)
    return bitmap[at >> 3] >> (at & 7) & 1 > 0
