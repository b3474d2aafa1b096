"""Sets that are alike, found by parts of them that are equal.

K-mers are hashed, and the range of hashes is cut in m equal parts. Two sets that differ in d k-mers
differ in d parts at most, so at least m - d parts hold just the same in both. m depends on the class of sizes
of the larger set alone. It gives a signature for each of its parts; the smaller one gives as many of its
own, the rarest, as must have one that agrees, whatever the others do. So no pair is lost. Where
m allows, the smaller one gives more, and that many pairs of signatures must agree.

An entry is a signature of 40 bits, a code of three bits, whose power of two is the number that must agree, and
two bits for what the set may be: 0 the larger one, 1 either, 2 the smaller one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import packed as pk
from tessera.operators.kmers import Syncmer, _extracted, checked

#: Ratio of sizes of a class, and parts for each k-mer in which two sets of it may differ.
GROWTH, SPARE = 1.6, 1.25
#: Bits of signatures, and of them those that tell the part of the shuffle.
SIGNATURE, PART_BITS = 40, 10
#: Bits of buckets of k-mers whose rarity is known; slices in which it is added up.
BUCKET_BITS, SLICES = 20, 64
#: Entries that a task sorts at once, pairs that it makes at once, and those that it holds before it passes them on.
HELD, MADE, PAIRS = 1 << 22, 1 << 19, 1 << 21
#: Bits of a set's bitmap of parity.
PARITY = 2048
_EPS = 1e-9


@dataclass(frozen=True)
class Sets:
    """One row a file, and what gives ``(row, k-mers)`` of a batch of them; k-mers may come in any order, with repeats."""

    rows: DataFrame  # the file comes first
    read: Callable[[pa.RecordBatch], Iterator[tuple]]


def of_postings(postings: DataFrame, file_col: str) -> Sets:
    """Of rows ``(file_col, kmer)``, which are shuffled for it."""

    def read(batch: pa.RecordBatch):
        for at, kmers in enumerate(batch.column("kmers")):
            yield at, kmers.values.to_numpy()

    return Sets(postings.where(F.col(file_col).isNotNull()).groupBy(F.col(file_col).alias("file")).agg(F.collect_list("kmer").alias("kmers")), read)


def of_records(records: DataFrame, k: int, syncmer: Syncmer = None, file_col: str = "file_idx", seq_col: str = "seq") -> Sets | None:
    """Read from the sequences each time, without a shuffle; none, if a file has several records."""
    checked(k, syncmer)
    rows = records.where(F.col(file_col).isNotNull()).select(F.col(file_col).alias("file"), F.col(seq_col).alias("seq"))
    if rows.groupBy("file").count().where("count > 1").limit(1).count():
        return None

    def read(batch: pa.RecordBatch):
        import numpy as np

        for start in range(0, batch.num_rows, 256):
            some = batch.slice(start, 256)
            row, code = (np.concatenate(c) for c in zip(*((r, c) for r, _, c in _extracted(some, 1, k, syncmer)), strict=True))
            upto = np.searchsorted(row, np.arange(some.num_rows + 1))
            for at in range(some.num_rows):
                yield start + at, code[upto[at] : upto[at + 1]]

    return Sets(rows, read)


def mixed(x):
    """A permutation of 64-bit numbers."""
    import numpy as np

    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _classes() -> list[int]:
    """The least size of each class."""
    made = [1]
    while made[-1] < 1 << 34:
        made.append(max(made[-1] + 1, math.ceil(made[-1] * GROWTH)))
    return made


CLASSES = _classes()


def signatures(hashes, weight, least: float):
    """Entries of a set of sorted hashes; the parts of most ``weight``, one number a hash, are its rarest."""
    import numpy as np

    differ = lambda size: int((1 - least) / (1 + least) * size + _EPS)  # noqa: E731  of two sets with so many k-mers in all
    n, most = len(hashes), int(len(hashes) / least + _EPS)
    top = (hashes >> np.uint64(32)).astype(np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes))])
    heavy = np.concatenate([[0.0], np.cumsum(weight)])
    c, made = int(np.searchsorted(CLASSES, n, side="right")) - 1, []
    own = c
    while CLASSES[c] <= most:
        largest = CLASSES[c + 1] - 1
        m = math.ceil(SPARE * differ(2 * largest)) + 1
        at = np.searchsorted(top, -(-(np.arange(m + 1) << 32) // m))
        found = mixed(sums[at[1:]] - sums[at[:-1]] + mixed(np.arange(m) + (c << 40))) >> np.uint64(64 - SIGNATURE) << np.uint64(5)
        d = differ(n + min(largest, most))
        code = min(7, max(0, (min(d // 16, m - d)).bit_length() - 1))
        take = min(m, d + (1 << code))
        chosen = np.argpartition(heavy[at[:-1]] - heavy[at[1:]], take - 1)[:take]
        if c == own:
            found[chosen] |= np.uint64(code << 2 | 1)
        else:
            found = found[chosen] | np.uint64(code << 2 | 2)
        made.append(found)
        c += 1
    return np.concatenate(made).astype(np.int64)


def marks(sets: Sets, kind) -> DataFrame:
    """``(file, n, a, b)`` with 128 bits of hashes of each set that is not empty, and rows ``(slice, held)`` of how often buckets of k-mers occur."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("file", kind), *(T.StructField(c, T.LongType()) for c in ("n", "a", "b")), T.StructField("slice", T.IntegerType()), T.StructField("held", T.BinaryType())])

    read = sets.read  # a task gets this alone

    def batches(source):
        import numpy as np

        seen = np.zeros(1 << BUCKET_BITS, np.uint32)
        for batch in source:
            made, held = [], []
            for at, kmers in read(batch):
                hashes = pk._once(mixed(kmers))
                if len(hashes):
                    held.append(hashes >> np.uint64(64 - BUCKET_BITS))
                    made.append((at, len(hashes), int(mixed(hashes).sum().view(np.int64)), int(mixed(~hashes).sum().view(np.int64))))
                if sum(map(len, held)) > 1 << BUCKET_BITS or held and at == batch.num_rows - 1:
                    seen += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(seen)).astype(np.uint32)
                    held = []
            if held:
                seen += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(seen)).astype(np.uint32)
            if made:
                at, *rest = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in rest), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], names=schema.names)
        each = [pa.compress(s.tobytes(), codec="zstd", asbytes=True) for s in np.split(seen, SLICES)]
        kinds = [f.type for f in _arrow(schema)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(SLICES, t) for t in kinds[:4]), pa.array(range(SLICES), pa.int32()), pa.array(each, pa.binary())], names=schema.names)

    return sets.rows.mapInArrow(batches, schema)


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def weights(marked: DataFrame) -> bytes:
    """For each bucket of k-mers a class of rarity, in one byte; which one a set takes for rare decides speed alone."""
    import numpy as np

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(pa.decompress(c.as_py(), decompressed_size=4 << BUCKET_BITS >> 6, codec="zstd", asbytes=True), np.uint32).astype(np.int64) for c in table.column("held"))
        rank = np.clip(255 - 8 * np.log2(total + 1), 1, 255).astype(np.uint8)
        return pa.table({"slice": table.column("slice").slice(0, 1), "rank": pa.array([rank.tobytes()], pa.binary())})

    found = marked.where("slice is not null").select("slice", "held").groupBy("slice").applyInArrow(add, "slice int, rank binary").collect()
    made = np.full((SLICES, (1 << BUCKET_BITS) // SLICES), 255, np.uint8)
    for r in found:
        made[r["slice"]] = np.frombuffer(r["rank"], np.uint8)
    return made.tobytes()


def entries(sets: Sets, least: float, rare: bytes) -> DataFrame:
    """``(part, packed)``: entries that another set's may agree with, packed as postings are; the rest goes where parts meet."""
    low_bits = SIGNATURE - PART_BITS + 5

    read = sets.read  # a task gets this alone

    def extract(source):
        import numpy as np

        rank = np.frombuffer(rare, np.uint8).astype(np.float64)
        # a set that lacks a k-mer of s of N sets is told by it with log(N/s); N is near the most frequent one's
        rank = (rank - rank.min()) / 8 + 0.01
        held, files, n = [], [], 0

        def passed():
            names, place = np.unique(np.array(files, np.int64), return_inverse=True)
            key = np.concatenate([e * len(names) + p for e, p in zip(held, place.tolist(), strict=True)])
            key.sort()
            low = key // len(names)
            place = key - low * len(names)
            upto = np.searchsorted(low, np.arange((1 << PART_BITS) + 1) << low_bits)
            low &= (1 << low_bits) - 1
            made = np.flatnonzero(np.diff(upto))
            each = [pk.pack(low[upto[p] : upto[p + 1]], place[upto[p] : upto[p + 1]], names) for p in made]
            for at in range(0, len(made), 64):
                yield pa.RecordBatch.from_arrays([pa.array(made[at : at + 64], pa.int32()), pa.array(each[at : at + 64], pa.binary())], names=["part", "packed"])

        for batch in source:
            ids = pk._ids(batch.column(0)).tolist()
            for at, kmers in read(batch):
                hashes = pk._once(mixed(kmers))
                if len(hashes):
                    made = signatures(hashes, rank[hashes >> np.uint64(64 - BUCKET_BITS)], least)
                    held.append(made), files.append(ids[at])
                    n += len(made)
                    if n >= HELD:
                        yield from passed()
                        held, files, n = [], [], 0
        if n:
            yield from passed()

    def merge(table: pa.Table) -> pa.Table:
        import numpy as np

        chunks = [pk.unpack(c.as_buffer().to_pybytes()) for c in table.column("packed")]
        names = np.unique(np.concatenate([c[2] for c in chunks]))
        key = np.concatenate([low * len(names) + np.searchsorted(names, mine)[place] for low, place, mine in chunks])
        del chunks
        key.sort()
        low = key // len(names)
        place = key - low * len(names)
        begins = np.flatnonzero(np.concatenate([[True], low[1:] >> 5 != low[:-1] >> 5]))
        may = low & 3
        count = lambda some: np.add.reduceat(some.astype(np.int64), begins)
        smaller, larger, either = count(may >= 1), count(may <= 1), count(may == 1)
        kept = np.repeat(smaller * larger > either, np.diff(np.append(begins, len(low))))  # some pair of two sets
        made = [pk.pack(low[kept], place[kept], names)] if kept.any() else []
        return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(made), pa.int32()), "packed": pa.array(made, pa.binary())})

    return sets.rows.mapInArrow(extract, "part int, packed binary").groupBy("part").applyInArrow(merge, "part int, packed binary")


def met(stored: DataFrame) -> DataFrame:
    """``(x, y, n, code)``: how many entries of x as the smaller and y as the larger set agree; a pair's rows are to be added up."""

    def batches(source):
        import numpy as np

        held, waiting, kinds = [], 0, (pa.int64(), pa.int64(), pa.int32(), pa.int8())

        def added():
            x, y, n, code = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((y, x))
            x, y, n, code = x[order], y[order], n[order], code[order]
            begins = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            return x[begins], y[begins], np.add.reduceat(n, begins).astype(np.int32), np.maximum.reduceat(code, begins)

        def row(columns):
            for at in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)], t) for c, t in zip(columns, kinds, strict=True)], names=["x", "y", "n", "code"])

        for batch in source:
            for data in batch.column("packed"):
                low, place, names = pk.unpack(data.as_buffer().to_pybytes())
                nth = np.cumsum(np.concatenate([[0], low[1:] >> 5 != low[:-1] >> 5]))
                small, large = np.flatnonzero(low & 3 >= 1), np.flatnonzero(low & 3 <= 1)
                first, last = np.searchsorted(nth[large], nth[small]), np.searchsorted(nth[large], nth[small], side="right")
                upto = np.concatenate([[0], np.cumsum(last - first)])
                at = 0
                while at < len(small):
                    end = max(at + 1, int(np.searchsorted(upto, upto[at] + MADE, side="right")) - 1)
                    each = (last - first)[at:end]
                    x = np.repeat(small[at:end], each)
                    y = large[np.repeat(first[at:end] - upto[at:end] + upto[at], each) + np.arange(len(x))]
                    two = place[x] != place[y]
                    x, y = x[two], y[two]
                    if len(x):
                        held.append((names[place[x]], names[place[y]], np.ones(len(x), np.int32), (low[x] >> 2 & 7).astype(np.int8)))
                        waiting += len(x)
                    if waiting >= PAIRS:
                        held = [added()]
                        waiting = len(held[0][0])
                        if waiting >= PAIRS // 2:
                            yield from row(held.pop())
                            waiting = 0
                    at = end
        if held:
            yield from row(added())

    return stored.mapInArrow(batches, "x long, y long, n int, code byte")


def contents(sets: Sets, kind) -> DataFrame:
    """``(file, n, bits, packed)``: each set's size, its bitmap of parity and its k-mers."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("file", kind), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("packed", T.BinaryType())])

    read = sets.read  # a task gets this alone

    def batches(source):
        import numpy as np

        for batch in source:
            made = []
            for at, kmers in read(batch):
                kmers = pk._once(np.array(kmers, np.int64))
                place = (mixed(kmers) >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64)
                bits = np.packbits((np.bincount(place, minlength=PARITY) & 1).astype(np.uint8)).tobytes()
                made.append((at, len(kmers), bits, pack_set(kmers)))
                if len(made) >= 256 or at == batch.num_rows - 1:
                    rows, n, bits, packed = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(packed, pa.binary())], names=schema.names)
                    made = []

    return sets.rows.mapInArrow(batches, schema)


def pack_set(kmers) -> bytes:
    """Sorted k-mers of one set."""
    import numpy as np

    steps = np.diff(kmers, prepend=0)
    width = pk._width(steps) if len(steps) else 1
    return bytes([width]) + pa.compress(pk._planes(steps, width), codec="zstd", asbytes=True)


def unpack_set(data: bytes, n: int):
    import numpy as np

    width = data[0]
    raw = pa.decompress(data[1:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.cumsum(pk._from_planes(raw, n, width)).astype(np.int64)
