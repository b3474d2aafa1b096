"""K-mer extraction: a numpy kernel over Arrow batches, and the universe of k-mers."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import sequence as sq

Syncmer = tuple[int, int] | None  # (s, t)

#: Bases that the kernel takes at once: its arrays stay in the cache.
PIECE = 1 << 18

# Sizes of universes of canonical k-mers, (k, s, t) to number.
KNOWN_UNIVERSES = {(15, 9, 2): 63_439_162}


def checked(k: int, syncmer: Syncmer) -> None:
    """k-mers fit 32 bits, and a syncmer's offset lies within the k-mer."""
    if not 1 <= k <= 16:
        raise ValueError("k must be from 1 to 16")
    if syncmer and not (1 <= syncmer[0] <= k and 0 <= syncmer[1] <= k - syncmer[0]):
        raise ValueError("s must be at most k, and t at most k - s")


@lru_cache(maxsize=1)
def _codes():
    """Base codes by byte; 255 for every other byte."""
    import numpy as np

    table = np.full(256, 255, np.uint8)
    for i, pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
        for base in pair:
            table[ord(base)] = i
    return table


def canonical_codes(sequence: bytes, k: int, syncmer: Syncmer):
    """Positions and canonical codes of the k-mers of one byte string, in order.

    Any byte but a base ends a k-mer, so many sequences can be joined by a separator.
    """
    import numpy as np

    raw = _codes()[np.frombuffer(sequence, np.uint8)]
    n = len(raw) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(raw == 255)])
    at = np.flatnonzero(bad[k:] == bad[:-k])
    base = raw.astype(np.uint32)
    made = 0  # windows of the length so far, doubled or longer by one for each binary digit of k
    for digit in bin(k)[2:]:
        if made:
            m = len(base) - 2 * made + 1
            forward, reverse = forward[:m] << (2 * made) | forward[made : made + m], reverse[:m] | reverse[made : made + m] << (2 * made)
            made *= 2
        if digit == "1":
            m = len(base) - made
            ends = base[made : made + m]
            forward, reverse = (forward[:m] << 2 | ends, reverse[:m] | (3 - ends) << (2 * made)) if made else (base, 3 - base)
            made += 1
    code = np.minimum(forward, reverse)[at].astype(np.int64)
    if syncmer:
        s, t = syncmer
        mask = (1 << 2 * s) - 1
        least, where = None, None
        for i in range(k - s + 1):  # from the right, so a later equal one does not replace the right-most
            small = code >> (2 * i) & mask
            if least is None:
                least, where = small, np.zeros(len(code), np.int64)
            else:
                where[small < least] = i
                least = np.minimum(least, small)
        keep = (k - s) - where == t
        at, code = at[keep], code[keep]
    return at, code


def _pieces(texts: list[bytes], k: int):
    """Sequences joined to pieces of about PIECE bytes: ``(bytes, begins, rows, offsets)``.

    A longer sequence is cut with an overlap, so every window lies in just one piece.
    """
    parts: list[bytes] = []
    rows: list[int] = []
    offsets: list[int] = []
    size = 0
    for row, text in enumerate(texts):
        for start in range(0, max(len(text) - k + 1, 1), PIECE):
            part = text[start : start + PIECE + k - 1]
            if parts and size + len(part) > PIECE:
                yield _joined(parts, rows, offsets)
                parts, rows, offsets, size = [], [], [], 0
            parts.append(part), rows.append(row), offsets.append(start)
            size += len(part) + 1
    if parts:
        yield _joined(parts, rows, offsets)


def _joined(parts: list[bytes], rows: list[int], offsets: list[int]):
    import numpy as np

    return b"\n".join(parts), np.cumsum([0] + [len(p) + 1 for p in parts[:-1]]), np.array(rows), np.array(offsets)


def _extracted(batch: pa.RecordBatch, column: int, k: int, syncmer: Syncmer, prepare: Callable[[str], bytes] | None = None):
    """For each piece of a batch: the row, the position and the code of each k-mer, in order."""
    import numpy as np

    plain = prepare or (lambda text: text.encode("latin-1", "replace"))
    for raw, begins, rows, offsets in _pieces([plain(t or "") for t in batch.column(column).to_pylist()], k):
        at, code = canonical_codes(raw, k, syncmer)
        part = np.repeat(np.arange(len(begins)), np.diff(np.searchsorted(at, np.append(begins, len(raw)))))  # positions ascend
        yield rows[part], at - begins[part] + offsets[part], code


def kmers(df: DataFrame, keys: list[str], seq_col: str, k: int, syncmer: Syncmer = None, positions: bool = False, repeats: bool = True) -> DataFrame:
    """One row ``(*keys, [pos,] kmer)`` for each k-mer.

    Without ``repeats``, which excludes ``positions``, a row's k-mers leave the kernel once
    for each piece of about PIECE bases; rows with the same keys may still give the same ones.
    """
    checked(k, syncmer)
    if positions and not repeats:
        raise ValueError("positions tell repeats apart")
    schema = T.StructType([df.schema[c] for c in keys] + [T.StructField("pos", T.LongType())] * positions + [T.StructField("kmer", T.LongType())])

    def batches(source):
        import numpy as np

        for batch in source:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for row, pos, code in _extracted(part, len(keys), k, syncmer):
                    if not repeats:
                        once = np.unique(row << 32 | code)  # codes fit 32 bits
                        row, code = once >> 32, once & 0xFFFFFFFF
                    ids = [part.column(i).take(pa.array(row)) for i in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*ids, *([pa.array(pos)] if positions else []), pa.array(code)], names=schema.names)

    return df.select(*keys, seq_col).mapInArrow(batches, schema)


def kmer_counts(df: DataFrame, keys: list[str], seq_col: str, k: int, syncmer: Syncmer = None) -> DataFrame:
    """``(*keys, kmer, times)``: the k-mers of each row, counted where the row is read.

    Each row also gives one with a null k-mer and no times, so rows without k-mers stay. The
    counts of a k-mer in a row longer than PIECE may come in parts.
    """
    checked(k, syncmer)
    schema = T.StructType([df.schema[c] for c in keys] + [T.StructField("kmer", T.LongType()), T.StructField("times", T.LongType(), False)])

    def batches(source):
        import numpy as np

        for batch in source:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [part.column(i) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*ids, pa.nulls(part.num_rows, pa.int64()), pa.array(np.zeros(part.num_rows, np.int64))], names=schema.names)
                for row, _, code in _extracted(part, len(keys), k, syncmer):
                    once, times = np.unique(row << 32 | code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(once >> 32)) for c in ids), pa.array(once & 0xFFFFFFFF), pa.array(times)], names=schema.names)

    return df.select(*keys, seq_col).mapInArrow(batches, schema)


def kmers_sql(df: DataFrame, keys: list[str], seq_col: str, k: int, syncmer: Syncmer = None) -> DataFrame:
    """The same rows with positions, by built-in functions only."""
    checked(k, syncmer)
    rows = df.select(*keys, F.explode(sq.windows(F.col(seq_col), k)).alias("w")).select(*keys, F.col("w.pos").cast("long").alias("pos"), F.col("w.word").alias("word"))
    rows = rows.withColumn("canonical", sq.canonical(F.col("word")))
    if syncmer:
        rows = rows.where(sq.syncmer_position(F.col("canonical"), k, syncmer[0]) == syncmer[1])
    return rows.withColumn("kmer", sq.encode(F.col("canonical")))


def universe(spark: SparkSession, k: int, syncmer: Syncmer = None) -> DataFrame:
    """``(total)``: canonical k-mers, or those that are syncmers with the left-most least s-mer."""
    checked(k, syncmer)
    if syncmer and syncmer[0] == k:
        syncmer = None
    if syncmer is None:
        return spark.range(1).select(F.lit((4**k + (4 ** (k // 2) if k % 2 == 0 else 0)) // 2).cast("long").alias("total"))
    if (k, *syncmer) in KNOWN_UNIVERSES:
        return spark.range(1).select(F.lit(KNOWN_UNIVERSES[k, *syncmer]).cast("long").alias("total"))
    s, t = syncmer
    code = F.col("id")

    def small(i: int) -> Column:
        return F.shiftright(code, 2 * (k - s - i)).bitwiseAND((1 << 2 * s) - 1)

    reverse = sum((F.lit(3) - F.shiftright(code, 2 * j).bitwiseAND(3)) * 4 ** (k - 1 - j) for j in range(k))
    first = (F.lit(True) if t == 0 else F.least(*(small(i) for i in range(t)), F.lit(1 << 2 * s)) > small(t)) & (F.lit(True) if t == k - s else F.least(*(small(i) for i in range(t + 1, k - s + 1)), F.lit(1 << 2 * s)) >= small(t))
    return spark.range(4**k).where((code <= reverse) & first).agg(F.count("*").alias("total"))
