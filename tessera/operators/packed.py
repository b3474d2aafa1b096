"""Postings in packed form: one row holds all postings of a part of the k-mers.

K-mers are mixed by an odd factor, which is a permutation of the codes, and the upper bits of
what it gives are the part. A posting is one number, lower bits times files plus the file's
place; the sorted numbers are kept as differences, byte by byte, compressed. Tasks sort what
they extract and pass on a row for each part; the rows of a part meet once, where repeats go.
So postings are shuffled once, at one to three bytes, and lists are there without a second shuffle.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators import rle
from tessera.operators.kmers import Syncmer, _extracted, checked

#: Bits of a part's number at most, and postings that a task sorts at once.
PART_BITS, HELD = 10, 1 << 22
#: Postings of lists that are taken at once, and sums of files that a task holds.
TAKEN, SUMS = 1 << 20, 1 << 22
#: Lots of files in which hits of reads meet.
LOTS = 256
#: Files whose pairs a task adds up in one matrix, and lists that are multiplied at once.
MATRIX, AT_ONCE = 512, 8192
MIX = 0x9E3779B1
UNMIX = pow(MIX, -1, 1 << 32)
#: Stands for a null file.
NONE = -(1 << 63)
_HEAD = struct.Struct("<qQQBB")


def low_bits(k: int) -> int:
    """Bits of a mixed code below its part."""
    return max(0, 2 * k - PART_BITS)


def _planes(values, width: int) -> bytes:
    import numpy as np

    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(raw: bytes, n: int, width: int):
    import numpy as np

    found = np.zeros((n, 8), np.uint8)
    found[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return found.view("<u8").ravel()


def _width(values) -> int:
    return max(1, -(-int(values.max()).bit_length() // 8))


def pack(low, place, names) -> bytes:
    """Postings sorted by ``low`` and ``place``, an index into the increasing ``names``."""
    import numpy as np

    there = np.zeros(len(names), bool)
    there[place] = True
    files = names[there]
    key = low * len(files) + (np.cumsum(there) - 1)[place]
    steps = np.diff(key, prepend=0).astype(np.uint64)
    gaps = np.diff(files.view(np.uint64), prepend=files.view(np.uint64)[:1])
    widths = _width(steps), _width(gaps)
    body = pa.compress(_planes(steps, widths[0]) + _planes(gaps, widths[1]), codec="zstd", asbytes=True)
    return _HEAD.pack(int(files[0]), len(key), len(files), *widths) + body


def unpack(data: bytes):
    """``(low, place, names)`` as they were packed."""
    import numpy as np

    first, n, files, wide, gap = _HEAD.unpack_from(data)
    raw = pa.decompress(data[_HEAD.size :], decompressed_size=n * wide + files * gap, codec="zstd", asbytes=True)
    key = np.cumsum(_from_planes(raw[: n * wide], n, wide)).astype(np.int64)
    names = (np.cumsum(_from_planes(raw[n * wide :], files, gap)) + np.uint64(first & (1 << 64) - 1)).view(np.int64)
    low = key // files
    return low, key - low * files, names


def _once(key):
    """Sorted numbers without repeats; ``key`` is sorted in place."""
    import numpy as np

    key.sort()
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def _ids(column):
    import numpy as np

    return column.cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int64)


def packed(records: DataFrame, k: int, syncmer: Syncmer = None, file_col: str = "file_idx", seq_col: str = "seq", prepare: Callable[[str], bytes] | None = None) -> DataFrame:
    """``(part, kmers, n, packed)``: the set of k-mers of each file, over all its records.

    ``prepare`` makes the sequence from what the column holds, where it is read.
    """
    checked(k, syncmer)
    bits, mask = low_bits(k), (1 << 2 * k) - 1
    schema = "part int, packed binary"

    def extract(source):
        import numpy as np

        codes, rows, names, n, seen = [], [], [], 0, 0

        def once():
            """Postings of the codes so far without repeats, sorted: ``(mixed codes, places, files)``."""
            files, place = np.unique(np.concatenate(names), return_inverse=True)
            key = _once(np.concatenate(codes) * len(files) + place[np.concatenate(rows)])
            low = key // len(files)
            return low, key - low * len(files), files

        def passed(low, place, files):
            upto = np.searchsorted(low, np.arange((mask >> bits) + 2) << bits)
            low &= (1 << bits) - 1
            made = np.flatnonzero(np.diff(upto))
            each = [pack(low[upto[p] : upto[p + 1]], place[upto[p] : upto[p + 1]], files) for p in made]
            for at in range(0, len(made), 64):
                yield pa.RecordBatch.from_arrays([pa.array(made[at : at + 64], pa.int32()), pa.array(each[at : at + 64], pa.binary())], names=["part", "packed"])

        for batch in source:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                for row, _, code in _extracted(some, 1, k, syncmer, prepare):
                    rows.append(row + seen), codes.append((code.astype(np.uint64) * np.uint64(MIX) & np.uint64(mask)).astype(np.int64))
                    n += len(code)
                names.append(_ids(some.column(0)))
                seen += some.num_rows
                if n >= HELD:
                    low, place, files = once()
                    if len(low) <= HELD // 2:  # mostly repeats: what is left goes on
                        codes, rows, names, n, seen = [low], [place], [files], len(low), len(files)
                    else:
                        yield from passed(low, place, files)
                        codes, rows, names, n, seen = [], [], [], 0, 0
        if n:
            yield from passed(*once())

    def merge(table: pa.Table) -> pa.Table:
        import numpy as np

        chunks = [unpack(c.as_buffer().to_pybytes()) for c in table.column("packed")]
        names = np.unique(np.concatenate([c[2] for c in chunks]))
        total = np.empty(sum(len(c[0]) for c in chunks), np.int64)
        at = 0
        while chunks:
            low, place, mine = chunks.pop()
            total[at : at + len(low)] = low * len(names) + np.searchsorted(names, mine)[place]
            at += len(low)
        key = _once(total)
        low = key // len(names)
        kmers = 1 + np.count_nonzero(low[1:] != low[:-1])
        row = [[table.column("part")[0].as_py()], [kmers], [len(key)], [pack(low, key - low * len(names), names)]]
        return pa.table([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "kmers", "n", "packed"])

    found = records.select(file_col, seq_col).mapInArrow(extract, schema)
    return found.groupBy("part").applyInArrow(merge, "part int, kmers long, n long, packed binary")


def _lists(source, k: int):
    """``(kmers, offsets, files)`` of whole lists, about TAKEN postings at once: small parts together, large ones in pieces."""
    import numpy as np

    bits, mask = low_bits(k), (1 << 2 * k) - 1
    held, waiting = [], 0

    def joined():
        kmer, n, files = (np.concatenate(c) for c in zip(*held, strict=True))
        return kmer, np.concatenate([[0], np.cumsum(n)]), files

    for batch in source:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("packed"), strict=True):
            low, place, names = unpack(data.as_buffer().to_pybytes())
            begins = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            mixed = (low[begins] | part << bits).astype(np.uint64)
            kmer = (mixed * np.uint64(UNMIX) & np.uint64(mask)).astype(np.int64)
            begins = np.append(begins, len(low))
            del low
            at = 0
            while at < len(kmer):
                upto = max(at + 1, int(np.searchsorted(begins, begins[at] + TAKEN, side="right")) - 1)
                held.append((kmer[at:upto], np.diff(begins[at : upto + 1]), names[place[begins[at] : begins[upto]]]))
                waiting += begins[upto] - begins[at]
                if waiting >= TAKEN // 2:
                    yield joined()
                    held, waiting = [], 0
                at = upto
    if held:
        yield joined()


def _named(files, kind: pa.DataType) -> pa.Array:
    found = pa.array(files, mask=files == NONE) if (files == NONE).any() else pa.array(files)
    return found.cast(kind)


def postings(stored: DataFrame, k: int, kind: T.DataType, file_col: str = "file_idx") -> DataFrame:
    """``(file_col, kmer)``"""
    arrow = to_arrow_type(kind)

    def batches(source):
        import numpy as np

        for kmer, offsets, files in _lists(source, k):
            each = np.repeat(kmer, np.diff(offsets))
            for at in range(0, len(each), 1 << 16):
                yield pa.RecordBatch.from_arrays([_named(files[at : at + (1 << 16)], arrow), pa.array(each[at : at + (1 << 16)])], names=[file_col, "kmer"])

    return stored.mapInArrow(batches, T.StructType([T.StructField(file_col, kind), T.StructField("kmer", T.LongType())]))


@dataclass(frozen=True)
class Packed:
    """Postings in packed form, and what they are read by."""

    stored: DataFrame
    k: int
    kind: T.DataType
    file_col: str = "file_idx"

    @property
    def rows(self) -> DataFrame:
        return postings(self.stored, self.k, self.kind, self.file_col)


def products(stored: DataFrame, k: int, kind: T.DataType, files: list[int], from_file: int | None = None) -> DataFrame:
    """``(i, j, shared)``, i >= j, of at most MATRIX files: common k-mers, and on the diagonal all of a file.

    Lists are multiplied where they lie, so each task passes on one sum a pair. With ``from_file``,
    only rows i >= it and the diagonal.
    """
    if len(files) > MATRIX:
        raise ValueError(f"a matrix holds {MATRIX} files at most")
    arrow = to_arrow_type(kind)

    def batches(source):
        import numpy as np

        known = np.array(sorted(files), np.int64)
        sums = np.zeros((len(known), len(known)), np.int64)
        for _, offsets, found in _lists(source, k):
            row, place = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), np.minimum(np.searchsorted(known, found), len(known) - 1)
            there = known[place] == found
            row, place = row[there], place[there]
            for at in range(0, len(offsets) - 1, AT_ONCE):
                first, last = np.searchsorted(row, (at, at + AT_ONCE))
                bits = np.zeros((AT_ONCE, len(known)), np.float32)
                bits[row[first:last] - at, place[first:last]] = 1
                sums += np.rint(bits.T @ bits).astype(np.int64)
        i, j = np.nonzero(np.tril(sums))
        n = sums[i, j]
        keep = (known[i] >= from_file) | (i == j) if from_file is not None else np.ones(len(i), bool)
        yield pa.RecordBatch.from_arrays([pa.array(known[i[keep]]).cast(arrow), pa.array(known[j[keep]]).cast(arrow), pa.array(n[keep])], names=["i", "j", "shared"])

    schema = T.StructType([T.StructField("i", kind), T.StructField("j", kind), T.StructField("shared", T.LongType())])
    return (stored if files else stored.limit(0)).mapInArrow(batches if files else lambda source: iter(()), schema).groupBy("i", "j").agg(F.sum("shared").alias("shared"))


def sizes(stored: DataFrame, k: int, kind: T.DataType, file_col: str = "file_idx", level: int | None = None) -> DataFrame:
    """``(file_col, n_kmers, total)``: the number and the sum of each file's k-mers; of what lossy compression leaves, with ``level``."""
    arrow = to_arrow_type(kind)

    def batches(source):
        import numpy as np

        held: list[tuple] = []

        def added():
            names, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n, total = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            np.add.at(n, at, np.concatenate([h[1] for h in held]))
            np.add.at(total, at, np.concatenate([h[2] for h in held]))
            return names, n, total

        def row(names, n, total):
            return pa.RecordBatch.from_arrays([_named(names, arrow), pa.array(n), pa.array(total)], names=[file_col, "n_kmers", "total"])

        waiting = 0
        for kmer, offsets, files in _lists(source, k):
            if level:
                files, offsets = rle.decode_lists(*rle.lossy_lists(*rle.encode_lists(files, offsets), level))
            names, at = np.unique(files, return_inverse=True)
            n, total = np.bincount(at, minlength=len(names)), np.zeros(len(names), np.int64)
            np.add.at(total, at, np.repeat(kmer, np.diff(offsets)))
            held.append((names, n, total))
            waiting += len(names)
            if waiting >= SUMS:
                held = [added()]
                waiting = 0
                if len(held[0][0]) >= SUMS:
                    yield row(*held.pop())
        if held:
            yield row(*added())

    schema = T.StructType([T.StructField(file_col, kind), T.StructField("n_kmers", T.LongType()), T.StructField("total", T.LongType())])
    return stored.mapInArrow(batches, schema).groupBy(file_col).agg(F.sum("n_kmers").alias("n_kmers"), F.sum("total").alias("total"))


def hits(stored: DataFrame, k: int, kind: T.DataType, asked: DataFrame, file_col: str = "file_idx") -> DataFrame:
    """``(row, file_col, x)`` for ``asked`` of (row, kmer, times), which is broadcast: the sum of times of a row's k-mers that a file has.

    Lists are matched where they lie. A task adds up what it finds, and its sums are shuffled packed.
    """
    row_col, arrow = asked.columns[0], to_arrow_type(kind)
    bits, mask = low_bits(k), (1 << 2 * k) - 1

    def dealt(source):
        import numpy as np

        for batch in source:
            row, kmer, times = (c.to_numpy() for c in batch.columns)
            mixed = (kmer.astype(np.uint64) * np.uint64(MIX) & np.uint64(mask)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in ((mixed >> bits).astype(np.int32), mixed & (1 << bits) - 1, row, times)], names=["part", "low", "row", "times"])

    by_part = asked.mapInArrow(dealt, "part int, low long, row long, times long").groupBy("part").agg(F.collect_list(F.struct("low", "row", "times")).alias("asked"))

    def match(source):
        import numpy as np

        held, waiting = [], 0

        def added():
            row, file, x = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((file, row))
            row, file, x = row[order], file[order], x[order]
            begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (file[1:] != file[:-1])]))
            return row[begins], file[begins], np.add.reduceat(x, begins)

        def passed(row, file, x):
            lot = (file.astype(np.uint64) * np.uint64(MIX) >> np.uint64(7)).astype(np.int64) % LOTS
            order = np.argsort(lot, kind="stable")
            upto = np.searchsorted(lot[order], np.arange(LOTS + 1))
            for n in np.flatnonzero(np.diff(upto)).tolist():
                here = order[upto[n] : upto[n + 1]]
                rows, low = np.unique(row[here], return_inverse=True)
                names, place = np.unique(file[here], return_inverse=True)
                width = _width(x[here])
                sums = bytes([width]) + pa.compress(_planes(x[here], width), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([rows.tobytes()], pa.binary()), pa.array([pack(low, place, names)], pa.binary()), pa.array([sums], pa.binary())], names=["lot", "rows", "packed", "sums"])

        for batch in source:
            for data, wanted in zip(batch.column("packed"), batch.column("asked"), strict=True):
                low, place, names = unpack(data.as_buffer().to_pybytes())
                mine, row, times = (wanted.values.field(c).to_numpy() for c in ("low", "row", "times"))
                first, last = np.searchsorted(low, mine), np.searchsorted(low, mine, side="right")
                upto = np.concatenate([[0], np.cumsum(last - first)])
                at = 0
                while at < len(mine):
                    end = max(at + 1, int(np.searchsorted(upto, upto[at] + TAKEN, side="right")) - 1)
                    each = (last - first)[at:end]
                    found = np.repeat(first[at:end] - upto[at:end] + upto[at], each) + np.arange(each.sum())
                    if len(found):
                        held.append((np.repeat(row[at:end], each), names[place[found]], np.repeat(times[at:end], each)))
                        waiting += len(found)
                    if waiting >= SUMS:
                        held = [added()]
                        waiting = len(held[0][0])
                        if waiting >= SUMS // 2:
                            yield from passed(*held.pop())
                            waiting = 0
                    at = end
        if held:
            yield from passed(*added())

    def add(table: pa.Table) -> pa.Table:
        import numpy as np

        made = []
        for rows, data, sums in zip(table.column("rows"), table.column("packed"), table.column("sums"), strict=True):
            low, place, names = unpack(data.as_buffer().to_pybytes())
            raw = sums.as_buffer().to_pybytes()
            x = _from_planes(pa.decompress(raw[1:], decompressed_size=len(low) * raw[0], codec="zstd", asbytes=True), len(low), raw[0])
            made.append((np.frombuffer(rows.as_buffer(), np.int64)[low], names[place], x.astype(np.int64)))
        row, file, x = (np.concatenate(c) for c in zip(*made, strict=True))
        order = np.lexsort((file, row))
        row, file, x = row[order], file[order], x[order]
        begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (file[1:] != file[:-1])]))
        return pa.table([pa.array(row[begins]), _named(file[begins], arrow), pa.array(np.add.reduceat(x, begins))], names=[row_col, file_col, "x"])

    schema = T.StructType([T.StructField(row_col, T.LongType()), T.StructField(file_col, kind), T.StructField("x", T.LongType())])
    met = stored.select("part", "packed").join(F.broadcast(by_part), "part").select("packed", "asked")
    return met.mapInArrow(match, "lot int, rows binary, packed binary, sums binary").groupBy("lot").applyInArrow(add, schema)


def lengths(stored: DataFrame, k: int) -> DataFrame:
    """``(n_files, n_kmers, total)``: how many k-mers have lists of a length, and the sum of these."""

    def batches(source):
        import numpy as np

        for kmer, offsets, _ in _lists(source, k):
            n, at = np.unique(np.diff(offsets), return_inverse=True)
            total = np.zeros(len(n), np.int64)
            np.add.at(total, at, kmer)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(np.bincount(at)), pa.array(total)], names=["n_files", "n_kmers", "total"])

    found = stored.mapInArrow(batches, "n_files long, n_kmers long, total long")
    return found.groupBy("n_files").agg(F.sum("n_kmers").alias("n_kmers"), F.sum("total").alias("total"))


def blocks(stored: DataFrame, k: int, level: int | None = None) -> DataFrame:
    """``(kmer, blocks)``: compressed lists, lossy with ``level``."""

    def batches(source):
        for kmer, offsets, files in _lists(source, k):
            made = rle.encode_lists(files, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(kmer), rle._nested(*(rle.lossy_lists(*made, level) if level else made))], names=["kmer", "blocks"])

    return stored.mapInArrow(batches, "kmer long, blocks array<int>")


def block_totals(stored: DataFrame, k: int) -> DataFrame:
    """One row ``(set_bits, naive_runs, blocks)`` of the compressed lists."""

    def batches(source):
        for _, offsets, files in _lists(source, k):
            made, _ = rle.encode_lists(files, offsets)
            sums = rle.ones_of(made).sum(), len(rle.run_lists(files, offsets)[0]), len(made)
            yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int64()) for s in sums], names=["set_bits", "naive_runs", "blocks"])

    found = stored.mapInArrow(batches, "set_bits long, naive_runs long, blocks long")
    return found.agg(*(F.sum(c).alias(c) for c in found.columns))
