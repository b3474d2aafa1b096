"""Words of many texts at once: places and hashes by numpy, without an object for each word."""

from __future__ import annotations

from functools import lru_cache

#: Bytes of texts that are hashed at once, about.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def white_space():
    """Which bytes are white space: blank, tab, line feed, vertical tab, form feed, carriage return."""
    import numpy as np

    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return space


def _powers(base: int, n: int):
    import numpy as np

    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


@lru_cache(maxsize=2)
def _tables(n: int):
    """64 bits for each byte, and powers of a base and of its inverse for n bytes."""
    import numpy as np

    return mixed(np.arange(1, 257).astype(np.uint64)), _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)


def mixed(h):
    """All bits of 64-bit integers spread over all others."""
    import numpy as np

    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return h ^ h >> np.uint64(31)


def spans(raw, begins, blank):
    """``(start, end, counts)`` of the words of texts that lie one after another in ``raw``, and how many each text has.

    ``begins`` are the places of the texts, the first one 0; ``blank`` tells for each byte value whether it parts words.
    """
    import numpy as np

    word = ~blank[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = begins[(begins > 0) & (begins < len(raw))]
    first[inner], last[inner - 1] = word[inner], word[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.diff(np.searchsorted(start, np.append(begins, len(raw))))


def span_hashes(raw, start, end):
    """A hash of each span: the difference of two running sums of bytes times powers, set back to the span's first byte."""
    import numpy as np

    bits, power, inverse = _tables(PIECE << (max(len(raw) - 1, 0) // PIECE).bit_length())
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bits[raw] * power[: len(raw)])])
    return mixed((upto[end] - upto[start]) * inverse[start])


def portions(offsets, length: int):
    """Ranges of texts of about ``length`` bytes together, by their offsets; a longer text is a range of its own."""
    import numpy as np

    at = 0
    while at < len(offsets) - 1:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + length, side="right")) - 1)
        yield at, upto
        at = upto


def flat_bytes(texts):
    """``(bytes, offsets)`` of a column of texts; a null is empty."""
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.binary())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets


def within(starts, sizes):
    """Positions of all items of ranges, one range after another."""
    import numpy as np

    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)
