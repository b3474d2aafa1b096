"""Removal of passages that repeat across documents, found by difference-cover anchors.

A window is ``window`` consecutive words of one document. The words of every window whose
word sequence also starts earlier (in a document with a smaller id, or earlier in the same
one) are removed; windows are judged on the input.

1. Anchors: a difference cover modulo a period v holds, for every distance d, two members that
   differ by d modulo v. Two equal windows thus share an offset below v at which both stand on
   a cover position, so runs of ``window - v + 1`` words are hashed at cover positions only: 4
   of 13 for windows of 20 words. Their counts are combined where they are read.
2. Extension: a window is looked at only if it contains an anchor that occurs twice, and then
   by 96 bits of the words of the whole window. Windows that repeat one of their own document are
   told there. For the others the first document of each sequence comes from an aggregation with
   map-side partial minima and is joined back, so a frequent passage is neither collected nor
   paired with itself, and adaptive execution may split its side of the join.
3. Windows that are not first are merged to spans of words for each document, and cut.

Repeated anchors reach the tasks as a filter of at most FILTER_BITS bits. Beyond SEMI_JOIN
of them the filter would let most windows pass, so anchors are then joined by hash instead.
A document whose whole text also stands under a smaller id is a copy: it takes part in
neither step, since all its windows start earlier.

Defined cases: a null text has no words; a text of fewer words than a window keeps all;
a null id is larger than all others; rows with one id and different texts are different
documents, ordered by a hash of their texts; rows with one id and text are one document, and
each of them gets its result; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded_batches, byte_slices, hash_filter, lookup, may_hold, word_slices
from tessera.llm.words import PIECE, flat_bytes, portions, span_hashes, spans, white_space
from tessera.plans.shared import FILTER_BITS, written

# Difference covers by their period, each a perfect difference set.
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Words of an anchor at least, unless windows are shorter.
ANCHOR_WORDS = 8
#: Repeated anchors up to which the filter is used: 16 bits or more for each.
SEMI_JOIN = FILTER_BITS // 16
#: Bits of an anchor's hash; two that clash only cost the look at their windows.
ANCHOR_BITS = 48
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


def period(window: int) -> int:
    """The longest period that leaves anchors of ANCHOR_WORDS words."""
    if window < 1:
        raise ValueError("a window has one word at least")
    return max(v for v in COVERS if v == 1 or window - v + 1 >= ANCHOR_WORDS)


def word_hashes(texts: pa.Array) -> Iterator:
    """A hash for each word of each text, in order; texts are hashed in pieces of about PIECE bytes."""
    import numpy as np

    data, offsets = flat_bytes(texts)
    for begin, end in portions(offsets, PIECE):
        raw = data[offsets[begin] : offsets[end]]
        if len(raw) > PIECE:  # one long text
            parts = [(np.frombuffer(p, np.uint8), np.zeros(1, np.int64)) for p in byte_slices(raw.tobytes(), PIECE)]
            yield np.concatenate([span_hashes(p, *spans(p, at, white_space())[:2]) for p, at in parts])
        else:
            first, last, sizes = spans(raw, offsets[begin:end] - offsets[begin], white_space())
            yield from np.split(span_hashes(raw, first, last), np.cumsum(sizes)[:-1])


def rolling(words, width: int, base: int):
    """Hashes of all runs of ``width`` words, by doubling: as many steps as ``width`` has bits."""
    import numpy as np

    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    run, size, made, have = words, 1, None, 0
    while True:
        if width & size:
            if made is None:
                made = run
            else:
                n = max(len(run) - have, 0)
                made = made[:n] * power(size) + run[have : have + n]
            have += size
        if have == width:
            return made[: max(len(words) - width + 1, 0)]
        n = max(len(run) - size, 0)
        run = run[:n] * power(size) + run[size : size + n]
        size *= 2


def anchors(words, window: int):
    """``(positions, hashes)`` of the runs at cover positions."""
    import numpy as np

    v = period(window)
    every = rolling(words, window - v + 1, BASES[0]) >> np.uint64(64 - ANCHOR_BITS)
    at = (np.arange(0, len(every), v)[:, None] + np.array(COVERS[v])).ravel()
    at = at[at < len(every)]
    return at, every[at].astype(np.int64)


def _anchor_counts(docs: DataFrame, window: int) -> DataFrame:
    """``(anchor, n)``, counted for each Arrow batch where the texts are read."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in source:
            found = [anchors(words, window)[1] for words in word_hashes(batch.column(0))]
            once, n = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(once), pa.array(n)], names=["anchor", "n"])

    return docs.select("text").mapInArrow(count, "anchor long, n long")


def _anchor_positions(docs: DataFrame, window: int) -> DataFrame:
    """``(owner, at, anchor)``, one row for each anchor."""
    schema = T.StructType([docs.schema["owner"], T.StructField("at", T.LongType()), T.StructField("anchor", T.LongType())])

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i, words in enumerate(word_hashes(batch.column(1))):
                at, hashes = anchors(words, window)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(at), pa.int64())), pa.array(at), pa.array(hashes)], names=schema.names)

    return docs.select("owner", "text").mapInArrow(place, schema)


def _windows(docs: DataFrame, window: int, known=None) -> DataFrame:
    """``(owner, start, w1, w2, again)`` of the windows that contain a repeated anchor; ``again`` if an earlier one of the document is equal.

    ``known`` is the broadcast filter; without it the positions stand in the column ``ats``.
    """
    listed = known is None
    schema = T.StructType([docs.schema["owner"], *(T.StructField(c, t) for c, t in (("start", T.IntegerType()), ("w1", T.LongType()), ("w2", T.IntegerType()), ("again", T.BooleanType())))])
    names, v = schema.names, period(window)

    def extend(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in source:
            rows, starts, first, second, repeats = [], [], [], [], []
            ats = batch.column(1).to_pylist() if listed else None
            for i, words in enumerate(word_hashes(batch.column(batch.num_columns - 1))):
                if len(words) < window:
                    continue
                if listed:
                    at = np.array(ats[i] or [], np.int64)
                else:
                    at, hashes = anchors(words, window)
                    at = at[may_hold(known.value, hashes)]
                if not len(at):
                    continue
                upto = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(words)))])
                n = len(words) - window + 1
                start = np.flatnonzero(upto[v : v + n] > upto[:n])
                if len(start):
                    w1 = rolling(words, window, BASES[0])[start].view(np.int64)
                    again = np.ones(len(start), bool)
                    again[np.unique(w1, return_index=True)[1]] = False
                    rows.append(np.full(len(start), i)), starts.append(start.astype(np.int32)), first.append(w1), repeats.append(again)
                    second.append((rolling(words, window, BASES[1])[start] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), *(pa.array(np.concatenate(c)) for c in (starts, first, second, repeats))], names=names)

    return docs.select("owner", *(["ats"] if listed else []), "text").mapInArrow(extend, schema)


def _merged(starts: DataFrame, window: int) -> DataFrame:
    """``(owner, spans)``: windows of each document merged; a list is no longer than its document."""
    schema = T.StructType([starts.schema["owner"], T.StructField("spans", SPANS)])

    def merge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in source:
            spans = []
            for found in batch.column(1).to_pylist():
                at = np.unique(np.array(found, np.int64))
                new = np.concatenate([[True], np.diff(at) > window])
                spans.append([{"begin": int(b), "end": int(e) + window} for b, e in zip(at[new], at[np.concatenate([new[1:], [True]])], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))], names=schema.names)

    return starts.groupBy("owner").agg(F.collect_list("start").alias("starts")).mapInArrow(merge, schema)


def _marked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, owner, copy, text)``: ``owner`` orders documents, and ``copy`` marks texts found whole under a smaller id.

    A whole number as id makes one wide integer, whose minima aggregate by hash: the id, or 2^63
    for null, and 62 bits that tell texts of one id apart. Other ids make a struct.
    """
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(1), text_col).alias("h1"), F.xxhash64(F.lit(2), text_col).alias("h2"), F.col(text_col).alias("text"))
    keys = docs.select("id", "h1", "h2")
    texts = keys.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first", F.lit(True).alias("several"))
    ids = keys.groupBy("id").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).where("least <> most").select("id", F.lit(True).alias("shared"))
    known = lookup(lookup(docs, written(texts, "texts"), ["h1", "h2"]), written(ids, "ids"), ["id"])
    copy = F.coalesce(F.col("several"), F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first"))
    tie = F.when(F.col("shared"), F.shiftrightunsigned("h1", 2)).otherwise(F.lit(0))
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        wide = lambda c: c.cast("decimal(38,0)")
        owner = wide(wide(F.coalesce(wide(F.col("id")), wide(F.lit(str(1 << 63))))) * wide(F.lit(1 << 62)) + wide(tie))
    else:
        owner = F.struct(F.col("id").isNull().alias("last"), "id", tie.alias("tie"))
    return known.select("id", owner.alias("owner"), copy.alias("copy"), "text")


def _spans(docs: DataFrame, window: int, most: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    own = docs.where("not copy")
    repeated = written(_anchor_counts(own, window).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    members = repeated.count()
    if members <= most:
        known = docs.sparkSession.sparkContext.broadcast(hash_filter(repeated, "anchor", members))
        windows = _windows(own, window, known)
    else:
        ats = _anchor_positions(own, window).join(repeated, "anchor", "left_semi").groupBy("owner").agg(F.collect_list("at").alias("ats"))
        windows = _windows(lookup(own, written(ats, "positions"), ["owner"], "inner"), window)
    owners = windows.where("not again").groupBy("w1", "w2").agg(F.min("owner").alias("first"), F.max("owner").alias("final"))
    firsts = written(owners.where("first <> final").select("w1", "w2", "first"), "firsts")
    later = windows.join(firsts, ["w1", "w2"], "left").where(F.col("again") | F.coalesce(F.col("owner") != F.col("first"), F.lit(False)))
    return written(_merged(later.select("owner", "start"), window), "spans")


def repeated_spans(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", most: int = SEMI_JOIN) -> DataFrame:
    """``(id_col, spans)``: for each row that is no whole copy, the word spans, end exclusive, that windows repeated from earlier cover."""
    docs = _marked(df, id_col, text_col)
    return lookup(docs.where("not copy"), _spans(docs, window, most), ["owner"], "inner").select(F.col("id").alias(id_col), "spans")


def remove_repeats(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", most: int = SEMI_JOIN) -> DataFrame:
    """``(id_col, n_words long, n_removed long, text)``: the words that stay, joined by one space."""
    docs = _marked(df, id_col, text_col)
    found = lookup(docs, _spans(docs, window, most), ["owner"])
    schema = T.StructType([docs.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])

    def kept(spans, copy: bool, text: bytes | None):
        words = [w for part in word_slices(text) for w in part]
        if copy:
            spans = [{"begin": 0, "end": len(words)}] if len(words) >= window else []
        parts, upto = [], 0
        for s in spans or []:
            parts += words[upto : s["begin"]]
            upto = s["end"]
        parts += words[upto:]
        return len(words), len(words) - len(parts), b" ".join(parts)

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            made = [kept(*row) for row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True)]
            n, removed, text = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], names=schema.names)

    done = found.select("id", "spans", "copy", "text").mapInArrow(cut, schema)
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", "text")
