import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import rle

U = lambda bits: rle.LITERAL | int(bits, 2)
O = lambda n: rle.ONES | n  # noqa: E731, E741

# indices, blocks, what is left at levels 1, 2, 3 (fixed values)
GOLDEN = [
    ([0, 8, 64, 65], [U("100000001"), 49, O(2)], [0, 8, 64, 65], [0, 8, 64, 65], [64, 65]),
    ([1, 36, 65], [U("10"), 21, U("1"), U("100000000000000")], [1, 36, 65], [], []),
    ([15, 16, 17, 18, 19], [15, O(5)], [15, 16, 17, 18, 19], [15, 16, 17, 18, 19], [15, 16, 17, 18, 19]),
    ([40], [40, O(1)], [40], [40], [40]),
    ([0], [O(1)], [0], [0], [0]),
    ([16390], [16383, U("10000000")], [16390], [16390], [16390]),
    ([20, 60], [20, U("1"), 25, O(1)], [60], [60], [60]),
    ([20, 21, 60], [20, U("11"), 25, O(1)], [20, 21, 60], [60], [60]),
    ([20, 23, 26, 29, 100], [20, U("1001001001"), 65, O(1)], [20, 23, 26, 29, 100], [20, 23, 26, 29, 100], [100]),
]


@pytest.mark.parametrize("case", GOLDEN)
def test_golden(case):
    indices, blocks, *left = case
    assert rle.encode(indices) == blocks
    assert rle.decode(blocks) == indices
    assert [rle.decode(rle.lossy(blocks, n)) for n in (1, 2, 3)] == left


# The format list by list, to hold the form for many lists against.
LONGEST, LITERAL_BITS, ONES, LITERAL = rle.LONGEST, rle.LITERAL_BITS, rle.ONES, rle.LITERAL


def plain_increasing(indices) -> list[int]:
    """What remains if every index that is not above all before it is skipped."""
    kept: list[int] = []
    for i in indices:
        if not kept or i > kept[-1]:
            kept.append(int(i))
    return kept


def plain_runs(indices) -> list[tuple[int, int]]:
    """Runs as (bit, length), none longer than LONGEST."""
    found: list[tuple[int, int]] = []

    def add(bit: int, length: int) -> None:
        while length > 0:
            found.append((bit, min(length, LONGEST)))
            length -= LONGEST

    begin = end = 0  # the open run of ones is [begin, end)
    done = 0
    for i in [*plain_increasing(indices), None]:
        if i is not None and i == end and end > begin:
            end += 1
            continue
        if end > begin:
            add(1, end - begin)
            done = end
        if i is not None:
            add(0, i - done)
            begin, end = i, i + 1
    return found


def plain_to_blocks(found: list[tuple[int, int]]) -> list[int]:
    """Short runs share literals; a run that starts a block and fills one stays a run."""
    blocks: list[int] = []
    bits = width = pieces = 0
    for bit, length in found:
        if pieces:
            fill = min(length, LITERAL_BITS - width)
            bits |= ((1 << fill) - 1) * bit << width
            width, pieces, length = width + fill, pieces + 1, length - fill
            if width == LITERAL_BITS:
                blocks.append(LITERAL | bits)
                bits = width = pieces = 0
        if length >= LITERAL_BITS:
            blocks.append(ONES * bit | length)
        elif length:
            bits, width, pieces = ((1 << length) - 1) * bit, length, 1
    if pieces == 1:
        blocks.append(ONES * (bits & 1) | width)
    elif pieces:
        blocks.append(LITERAL | bits)
    return blocks


def plain_encode(indices) -> list[int]:
    return plain_to_blocks(plain_runs(indices))


def plain_decode(blocks) -> list[int]:
    found: list[int] = []
    at = 0
    for block in map(int, blocks):
        if block & LITERAL:
            found += [at + i for i in range(LITERAL_BITS) if block >> i & 1]
            at += LITERAL_BITS
        else:
            if block & ONES:
                found += range(at, at + (block & LONGEST))
            at += block & LONGEST
    return found


def plain_sparse(level: int, ones: int, saved: int) -> bool:
    """Whether a literal of so many ones goes, if that saves so many blocks."""
    if level not in (1, 2, 3):
        raise ValueError("the level must be 1, 2 or 3")
    most = {1: (0, 1), 2: (1, 2), 3: (2, 4)}[level]  # ones at one saved block, at two
    least = 0 if level == 3 else 1
    return saved >= 1 and (1 <= ones <= most[0] or saved == 2 and least <= ones <= most[1])


def plain_lossy(blocks, level: int) -> list[int]:
    """Literals of few ones beside runs of zeros become part of these runs."""
    out: list[int] = []
    rest = [int(b) for b in blocks][::-1]
    zeros = lambda b: b < ONES
    while rest:
        block = rest.pop()
        if block & LITERAL:
            before = out[-1] if out and zeros(out[-1]) else None
            after = rest[-1] if rest and zeros(rest[-1]) else None
            total = LITERAL_BITS + (before or 0) + (after or 0)
            saved = (before is not None) + (after is not None) + 1 - -(-total // LONGEST)
            if plain_sparse(level, (block & ~LITERAL).bit_count(), saved):
                if before is not None:
                    out.pop()
                if after is not None:
                    rest.pop()
                out += [min(total, LONGEST)] + [total - LONGEST] * (total > LONGEST)
                continue
        out.append(block)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 300), st.integers(0, 70_000)), max_size=60), max_size=12))
def test_many_lists_at_once(lists):
    flat = lambda of: (np.array([x for v in of for x in v], np.int64), np.cumsum([0, *map(len, of)], dtype=np.int64))
    apart = lambda found: [found[0][a:b].tolist() for a, b in zip(found[1], found[1][1:], strict=False)]
    blocks = [plain_encode(v) for v in lists]
    assert apart(rle.encode_lists(*flat(lists))) == blocks
    assert apart(rle.decode_lists(*flat(blocks))) == [plain_decode(b) for b in blocks]
    assert np.bincount(rle.run_lists(*flat(lists))[0], minlength=len(lists)).tolist() == [len(plain_runs(v)) for v in lists]
    for level in (1, 2, 3):
        assert apart(rle.lossy_lists(*flat(blocks), level)) == [plain_lossy(b, level) for b in blocks]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 200), st.integers(0, 70_000)), max_size=80))
def test_round_trip_and_subset(indices):
    kept = rle.increasing(indices)
    blocks = rle.encode(indices)
    assert rle.decode(blocks) == kept
    assert all(0 <= b < 1 << 16 for b in blocks)
    assert sum(n for bit, n in rle.runs(indices) if bit) == len(kept)
    for level in (1, 2, 3):
        out = rle.lossy(blocks, level)
        assert set(rle.decode(out)) <= set(kept)
        assert len(out) <= len(blocks)


def test_long_runs():
    assert rle.encode(range(20_000)) == [O(16383), O(3617)]
    assert rle.encode([40_000]) == [16383, 16383, 7234, O(1)]
    assert rle.decode(rle.encode(range(5, 40_000))) == list(range(5, 40_000))
    assert rle.encode([]) == []


def test_level(spark):
    with pytest.raises(ValueError):
        rle.lossy_udf(4)
    df = spark.createDataFrame([([20, 60],), ([],)], "files array<int>").select(rle.encode_udf("files").alias("b"))
    assert [r[0] for r in df.select(rle.decode_udf(rle.lossy_udf(1)("b"))).collect()] == [[60], []]
