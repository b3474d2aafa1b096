"""Posting lists as 16-bit blocks, and their lossy compression.

Fixed values of the format: 00 and 14 bits: a run of zeros; 01 and 14 bits: a run of ones;
1 and 15 bits: a literal, the lowest bit for the lowest index.

The functions take many lists at once, flat with offsets, as Arrow holds them. Blocks depend
on those before them as far back as a run of CERTAIN positions, which ends a block wherever one
began, or, in lossy compression, a block that stays as it is. There lists are cut; all pieces
advance by one block a step, so there are as many steps as the longest piece has blocks, and
each is a few numpy operations.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

LONGEST, LITERAL_BITS = (1 << 14) - 1, 15
ONES, LITERAL = 1 << 14, 1 << 15
#: Lists and positions share one 64-bit key; positions are below this.
SPAN = 40
#: A literal ends at most 14 positions within a run; from here on 15 are left, which are a block.
CERTAIN = 2 * LITERAL_BITS - 1

# Most ones of a literal that goes at one saved block and at two, by level.
MOST_ONES = {1: (0, 1), 2: (1, 2), 3: (2, 4)}


def _keys(values, offsets):
    """``list << SPAN | value``, increasing wherever each list increases."""
    import numpy as np

    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) << SPAN | values


def _offsets(lists, n):
    import numpy as np

    return np.concatenate([[0], np.cumsum(np.bincount(lists, minlength=n))]).astype(np.int64)


def increasing_lists(values, offsets):
    """``(values, offsets)`` without any index that is not above all before it in its list."""
    import numpy as np

    keys = _keys(values, offsets)
    before = np.concatenate([[-1], np.maximum.accumulate(keys)[:-1]]) if len(keys) else keys
    keep = keys > before
    return values[keep], _offsets(keys[keep] >> SPAN, len(offsets) - 1)


def run_lists(values, offsets):
    """``(list, end, bit)`` of the runs, none longer than LONGEST, in order; ``end`` is exclusive."""
    import numpy as np

    values, offsets = increasing_lists(values, offsets)
    keys = _keys(values, offsets)
    first = np.concatenate([[True], keys[1:] != keys[:-1] + 1]) if len(keys) else np.empty(0, bool)
    begin, end = keys[first], keys[np.concatenate([first[1:], [True]])] + 1 if len(keys) else keys
    lists = begin >> SPAN
    before = np.where(np.concatenate([[-1], lists[:-1]]) == lists, np.concatenate([[0], end[:-1]]), lists << SPAN)
    starts, ends = np.column_stack([before, begin]).ravel(), np.column_stack([begin, end]).ravel()
    pieces = -(-(ends - starts) // LONGEST)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    upto = np.minimum(np.repeat(starts, pieces) + (nth + 1) * LONGEST, np.repeat(ends, pieces))
    return np.repeat(np.repeat(lists, 2), pieces), upto & ((1 << SPAN) - 1), np.repeat(np.tile([0, 1], len(lists)), pieces)


def encode_lists(values, offsets):
    """``(blocks, offsets)``: short runs share literals; a run that starts a block and fills one stays a run."""
    import numpy as np

    n = len(offsets) - 1
    values, offsets = increasing_lists(values, offsets)
    lists, ends, bits = run_lists(values, offsets)
    edges = lists << SPAN | ends
    upto = _offsets(lists, n)[1:]  # after the last run of each list
    new = np.concatenate([[True], lists[1:] != lists[:-1]]) if len(lists) else np.empty(0, bool)
    before = np.where(new, 0, np.concatenate([[0], ends[:-1]])) if len(lists) else ends
    first = np.flatnonzero(new | np.concatenate([[False], ends[:-1] - before[:-1] >= CERTAIN])) if len(lists) else np.empty(0, np.int64)
    now, pos = lists[first], before[first]
    stop = ends[np.append(first[1:], len(ends)) - 1] if len(first) else ends
    made: list[tuple] = []
    while len(now):
        at = np.searchsorted(edges, now << SPAN | pos, side="right")  # the run that holds the position
        left, last = ends[at] - pos, at + 1 == upto[now]
        run = (left >= LITERAL_BITS) | last
        made.append((now << SPAN | pos, np.where(run, ONES * bits[at] | left, LITERAL), run))
        pos = np.where(run, ends[at], pos + LITERAL_BITS)
        more = pos < stop
        now, pos, stop = now[more], pos[more], stop[more]
    if not made:
        return np.empty(0, np.int64), np.zeros(n + 1, np.int64)
    key, block, run = (np.concatenate(c) for c in zip(*made, strict=True))
    order = np.argsort(key)
    key, block, run = key[order], block[order], run[order]
    ones = _keys(values, offsets)
    of = np.searchsorted(key, ones, side="right") - 1
    within = ~run[of]
    block += np.bincount(of[within], weights=1 << (ones - key[of])[within], minlength=len(block)).astype(np.int64)
    return block, _offsets(key >> SPAN, n)


def decode_lists(blocks, offsets):
    """``(values, offsets)`` of the ones that blocks hold."""
    import numpy as np

    n = len(offsets) - 1
    lists = np.repeat(np.arange(n), np.diff(offsets))
    literal, run = blocks & LITERAL > 0, blocks & (LITERAL | ONES) == ONES
    width = np.where(literal, LITERAL_BITS, blocks & LONGEST)
    begin = np.cumsum(width) - width
    begin -= np.repeat(begin[offsets[:-1].clip(max=max(len(blocks) - 1, 0))], np.diff(offsets)) if len(blocks) else 0
    at, bit = np.nonzero(blocks[literal][:, None] >> np.arange(LITERAL_BITS) & 1)
    long = np.repeat(begin[run], width[run]) + np.arange(width[run].sum()) - np.repeat(np.cumsum(width[run]) - width[run], width[run])
    keys = np.sort(np.concatenate([lists[literal][at] << SPAN | begin[literal][at] + bit, np.repeat(lists[run], width[run]) << SPAN | long]))
    return keys & ((1 << SPAN) - 1), _offsets(keys >> SPAN, n)


def one_ranges(blocks, offsets):
    """``(list, begin, end)`` of the runs of ones that blocks hold, which may touch; nothing is expanded."""
    import numpy as np

    lists = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    literal, run = blocks & LITERAL > 0, blocks & (LITERAL | ONES) == ONES
    width = np.where(literal, LITERAL_BITS, blocks & LONGEST)
    upto = np.concatenate([[0], np.cumsum(width)])
    at = upto[:-1] - upto[offsets[:-1]][lists]
    bits = np.zeros((np.count_nonzero(literal), LITERAL_BITS + 2), np.int8)
    bits[:, 1:-1] = blocks[literal][:, None] >> np.arange(LITERAL_BITS) & 1
    edge = np.diff(bits, axis=1)
    (row, first), (_, last) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    begin = at[literal][row]
    return np.concatenate([lists[literal][row], lists[run]]), np.concatenate([begin + first, at[run]]), np.concatenate([begin + last, at[run] + width[run]])


def weighted_counts(blocks, offsets, groups, weights):
    """``(group, index, sum)``: for each group and index, the weights of the group's lists that hold it.

    Runs add their weight where they begin and take it off where they end, so a run costs the same
    at any length; only the sums that are not zero are written out, once for each index.
    """
    import numpy as np

    lists, begin, end = one_ranges(blocks, offsets)
    keep = end > begin
    of, weight = groups[lists[keep]] << SPAN, weights[lists[keep]]
    key, change = np.concatenate([of | begin[keep], of | end[keep]]), np.concatenate([weight, -weight])
    order = np.argsort(key)
    key, level = key[order], np.cumsum(change[order])
    last = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [False]])) if len(key) else np.empty(0, np.int64)
    last = last[level[last] > 0]
    width = key[last + 1] - key[last]
    upto = np.cumsum(width)
    index = np.repeat((key[last] & ((1 << SPAN) - 1)) - (upto - width), width) + np.arange(upto[-1] if len(upto) else 0)
    return np.repeat(key[last] >> SPAN, width), index, np.repeat(level[last], width)


def ones_of(blocks):
    """The number of ones of each block."""
    import numpy as np

    return np.where(blocks & LITERAL > 0, np.bitwise_count(blocks & (LITERAL - 1)), np.where(blocks & ONES > 0, blocks & LONGEST, 0)).astype(np.int64)


def checked(level: int) -> int:
    if level not in MOST_ONES:
        raise ValueError("the level must be 1, 2 or 3")
    return level


def lossy_lists(blocks, offsets, level: int):
    """``(blocks, offsets)``: literals of few ones beside runs of zeros become part of these runs, if that saves blocks."""
    import numpy as np

    one, two = MOST_ONES[checked(level)]
    least = 0 if level == 3 else 1
    stays = (blocks >= ONES) & ((blocks & LITERAL == 0) | (np.bitwise_count(blocks & (LITERAL - 1)) > max(one, two)))
    whole, offsets = offsets, np.unique(np.concatenate([offsets, np.flatnonzero(stays) + 1]))
    n = len(offsets) - 1
    out, used = np.zeros(len(blocks), np.int64), np.zeros(n, np.int64)
    padded = np.append(blocks, LITERAL)
    now = np.flatnonzero(np.diff(offsets))
    at = offsets[:-1].copy()
    while len(now):
        block, place = padded[at[now]], offsets[now] + used[now]
        at[now] += 1
        previous = np.where(used[now] > 0, out[place - 1], LITERAL)
        following = np.where(at[now] < offsets[now + 1], padded[at[now]], LITERAL)
        before, after = previous < ONES, following < ONES
        total = LITERAL_BITS + np.where(before, previous, 0) + np.where(after, following, 0)
        saved = before.astype(np.int64) + after + 1 - -(-total // LONGEST)
        ones = np.bitwise_count(block & (LITERAL - 1))
        sparse = (saved >= 1) & ((ones >= 1) & (ones <= one) | (saved == 2) & (ones >= least) & (ones <= two))
        goes = (block & LITERAL > 0) & sparse
        place -= goes & before
        at[now] += goes & after
        out[place] = np.where(goes, np.minimum(total, LONGEST), block)
        long = goes & (total > LONGEST)
        out[place[long] + 1] = total[long] - LONGEST
        used[now] = place - offsets[now] + 1 + long
        now = now[at[now] < offsets[now + 1]]
    kept = np.concatenate([[0], np.cumsum(used)])
    nth = np.arange(kept[-1]) - np.repeat(kept[:-1], used)
    return out[np.repeat(offsets[:-1], used) + nth], kept[np.searchsorted(offsets, whole)]


def _one(values):
    import numpy as np

    flat = np.array(list(values), np.int64)
    return flat, np.array([0, len(flat)], np.int64)


def increasing(indices) -> list[int]:
    return increasing_lists(*_one(indices))[0].tolist()


def runs(indices) -> list[tuple[int, int]]:
    """Runs of one list as (bit, length)."""
    _, ends, bits = run_lists(*_one(indices))
    return [(b, e - s) for b, e, s in zip(bits.tolist(), ends.tolist(), [0, *ends.tolist()], strict=False)]


def encode(indices) -> list[int]:
    return encode_lists(*_one(indices))[0].tolist()


def decode(blocks) -> list[int]:
    return decode_lists(*_one(blocks))[0].tolist()


def lossy(blocks, level: int) -> list[int]:
    return lossy_lists(*_one(blocks), level)[0].tolist()


def _flat(lists: pa.Array):
    import numpy as np

    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.int64)
    return values, offsets - offsets[0]


def _nested(values, offsets) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


@arrow_udf(T.ArrayType(T.IntegerType()))
def encode_udf(lists: pa.Array) -> pa.Array:
    return _nested(*encode_lists(*_flat(lists)))


@arrow_udf(T.ArrayType(T.IntegerType()))
def decode_udf(blocks: pa.Array) -> pa.Array:
    return _nested(*decode_lists(*_flat(blocks)))


@arrow_udf(T.BinaryType())
def narrow_udf(blocks: pa.Array) -> pa.Array:
    """Blocks as bytes, two for each."""
    values, offsets = _flat(blocks)
    return pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer((2 * offsets).astype("<i4")), pa.py_buffer(values.astype("<u2"))])


@arrow_udf(T.ArrayType(T.IntegerType()))
def wide_udf(blocks: pa.Array) -> pa.Array:
    import numpy as np

    if not len(blocks):
        return pa.array([], pa.list_(pa.int32()))
    offsets = np.frombuffer(blocks.buffers()[1], "<i4")[blocks.offset : blocks.offset + len(blocks) + 1].astype(np.int64)
    values = np.frombuffer(blocks.buffers()[2] or b"", "<u2", (offsets[-1] - offsets[0]) // 2, offsets[0]) if offsets[-1] > offsets[0] else np.empty(0, "<u2")
    return _nested(values.astype(np.int64), (offsets - offsets[0]) // 2)


@arrow_udf(T.LongType())
def naive_runs_udf(lists: pa.Array) -> pa.Array:
    import numpy as np

    return pa.array(np.bincount(run_lists(*_flat(lists))[0], minlength=len(lists)))


@arrow_udf(T.LongType())
def set_bits_udf(blocks: pa.Array) -> pa.Array:
    import numpy as np

    values, offsets = _flat(blocks)
    upto = np.concatenate([[0], np.cumsum(ones_of(values))])
    return pa.array(upto[offsets[1:]] - upto[offsets[:-1]])


def weighted(df: DataFrame, group: str | None, weight: str | None) -> DataFrame:
    """``([group,] file_idx, n)`` of rows ``([group,] blocks[, weight])``, added up for each Arrow batch; callers add up batches."""
    columns = [c for c in (group, "blocks", weight) if c]
    schema = T.StructType([*([df.schema[group]] if group else []), T.StructField("file_idx", T.IntegerType()), T.StructField("n", T.LongType())])

    def batches(source):
        import numpy as np

        for batch in source:
            held = dict(zip(columns, batch.columns, strict=True))
            keys, of = np.unique(held[group].to_numpy(zero_copy_only=False), return_inverse=True) if group else (None, np.zeros(batch.num_rows, np.int64))
            times = held[weight].to_numpy(zero_copy_only=False) if weight else np.ones(batch.num_rows, np.int64)
            found, index, n = weighted_counts(*_flat(held["blocks"]), of, times)
            yield pa.RecordBatch.from_arrays([*([pa.array(keys[found])] if group else []), pa.array(index, pa.int32()), pa.array(n)], names=schema.names)

    return df.select(*columns).mapInArrow(batches, schema)


def lossy_udf(level: int):
    checked(level)

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def apply(blocks: pa.Array) -> pa.Array:
        return _nested(*lossy_lists(*_flat(blocks), level))

    return apply
