"""Token counts by a two-tier lookup of pre-tokens, without any shuffle of pre-tokens.

A text is cut into pre-tokens at boundaries which no piece of the vocabulary spans:
before a space that follows another character than a space, and before each line feed.
The merges of one pre-token then cannot depend on another, so the counts add up to the
library's count for the whole text. ``Counter.__init__`` checks the vocabulary for it;
if a piece spans such a boundary, whole texts go to the library instead.

Tier one is a broadcast table of the lengths of frequent pre-tokens, at most
FREQUENT entries of at most LONGEST characters. Tier two is each worker's own cache,
emptied at CACHED entries; only what both miss is encoded.

The frequent pre-tokens come from the first Arrow batch of at most SAMPLE partitions, which
are spread evenly over all. They only speed up the lookup: every text is counted in full, and
the counts do not depend on the sample.

Defined cases: a null text counts as the empty text (0 bytes, 0 tokens); very long texts are
counted whole; rows do not depend on each other, so no ties arise; repeated rows give
repeated results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import collections
import re
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import bounded_batches, map_rows

FREQUENT = 1 << 16
LONGEST = 32
SAMPLE = 8
CACHED = 1 << 19

_SEGMENT = re.compile(" +[^ \n]*|\n[^ \n]*")
_SPACE_MARK = "▁"


class Counter(dict):
    """Pre-token to number of tokens; a missing one is looked up in tier one, else encoded."""

    def __init__(self, model_file: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.frequent: dict[str, int] = {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        probe = ["a", "a b", "a\nb", " a", "a  b", "\n"]
        self.separable = not any(_SPACE_MARK in p.lstrip(_SPACE_MARK) or "\n" in p[:-1] or "\n" in p[1:] for p in pieces) and all(self._sum(x) == len(self.model.encode(x)) for x in probe)

    def _encode(self, segment: str) -> int:
        if segment[0] == "\n":  # the model puts one space mark before the text
            return len(self.model.encode(segment)) - 1
        return len(self.model.encode(segment[1:])) if len(segment) > 1 else 1

    def __missing__(self, segment: str) -> int:
        n = self.frequent.get(segment)
        if n is None:
            n = self._encode(segment)
        if len(segment) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[segment] = n
        return n

    def _sum(self, text: str) -> int:
        return sum(map(self.__getitem__, _SEGMENT.findall(f" {text.replace(_SPACE_MARK, ' ')}")))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return self._sum(text) if self.separable else len(self.model.encode(text))


@lru_cache(maxsize=2)
def counter(model_file: str) -> Counter:
    return Counter(model_file)


def frequent_lengths(df: DataFrame, model_file: str, text_col: str = "text", partitions: int = SAMPLE) -> dict[str, int]:
    """Lengths of the pre-tokens seen most often in the first Arrow batches of some partitions, at most FREQUENT."""
    bounded_batches(df.sparkSession)

    def count(source):
        for batch in islice(source, 1):
            seen = collections.Counter()
            for text in batch.column(0).to_pylist():
                seen.update(_SEGMENT.findall(f" {text or ''}"))
            top = [(s, n) for s, n in seen.most_common(FREQUENT // 4) if len(s) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array([[s for s, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["segments", "n"])

    counted = df.select(text_col).mapInArrow(count, "segments array<string>, n array<long>").rdd
    every = counted.getNumPartitions()
    chosen = sorted({i * every // partitions for i in range(min(partitions, every))} if every > partitions else range(every))
    seen: collections.Counter = collections.Counter()
    for r in df.sparkSession.sparkContext.runJob(counted, list, chosen) if chosen else []:  # other partitions are not touched
        seen.update(dict(zip(r.segments, r.n, strict=True)))
    known = Counter(model_file)
    return {s: known[s] for s, n in seen.most_common(FREQUENT) if n > 1}


def count_tokens(df: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes long, n_tokens long, over_limit boolean)``."""
    kind = dict(df.dtypes)[id_col]
    table = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, model_file, text_col))

    def row(key, text):
        known = counter(model_file)
        if not known.frequent:
            known.frequent = table.value
        n = known.count(text)
        return key, len((text or "").encode()), n, n > limit

    return map_rows(df.select(id_col, text_col), row, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
