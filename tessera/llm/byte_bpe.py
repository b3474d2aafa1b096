"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The library does the merges. A text longer than SLICE characters is first cut where
no match of the pattern can span: before a single space that stands between two
characters that are not white space. Every alternative of the pattern takes a space
at its start only, so the matches, and with them the ids, are those of the whole text.

Defined cases: a null text is encoded as the empty text (no ids, no bytes); very long
texts are encoded whole; rows do not depend on each other, so no ties arise; repeated rows
give repeated results; an empty table gives an empty one; other columns than the named ones
are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from tessera.llm.common import map_rows

#: Characters of a text that the library gets at once, unless no safe boundary comes.
SLICE = 1 << 16

_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, loaded once in each worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def slices(text: str, length: int = SLICE) -> Iterator[str]:
    """The text in order, in pieces that end at safe boundaries."""
    start = 0
    while len(text) - start > length:
        cut = _BOUNDARY.search(text, start + length)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str | None, rank_file: str, pattern: str, length: int = SLICE) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    enc = encoding(rank_file, pattern)
    return b"".join(enc.encode_to_numpy(piece, disallowed_special=()).astype("<u4").tobytes() for piece in slices(text or "", length) if piece)


def decode_ids(ids: bytes, rank_file: str, pattern: str) -> bytes:
    """The raw bytes; they need not be valid UTF-8 if the ids are only part of a text."""
    import numpy as np

    return encoding(rank_file, pattern).decode_bytes(np.frombuffer(ids, "<u4").tolist())


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens long, ids binary)``: ids as in ``encode_text``."""
    kind = dict(df.dtypes)[id_col]

    def row(key, text):
        ids = encode_text(text, rank_file, pattern)
        return key, len(ids) // 4, ids

    return map_rows(df.select(id_col, text_col), row, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, n_tokens, ids, decoded binary)`` from what ``encode`` gave."""
    kind = dict(df.dtypes)[id_col]

    def row(key, n, ids):
        return key, n, ids, decode_ids(ids, rank_file, pattern)

    return map_rows(df.select(id_col, "n_tokens", "ids"), row, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids, decoded)``: ``encode`` and ``decode`` in one pass of one worker a task."""
    kind = dict(df.dtypes)[id_col]

    def row(key, text):
        ids = encode_text(text, rank_file, pattern)
        return key, len(ids) // 4, ids, decode_ids(ids, rank_file, pattern)

    return map_rows(df.select(id_col, text_col), row, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")
