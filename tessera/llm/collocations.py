"""Phrases that occur together far more often than their parts: suffix arrays of word ids.

1. A task cuts its texts into shards of about SHARD words. The words of a shard become ids by
   64-bit hashes of their language and bytes, and a suffix array to the depth of the longest phrase is built by prefix doubling in numpy, with the
   number of words that each suffix shares with the one before it. Shards are stored once.
2. For each length n, the intervals of a shard's suffix array whose suffixes share n words are
   its phrases of n words with their counts. Counts are merged by a hash of language and phrase; a
   phrase is frequent only if both phrases of n - 1 words in it are, so a filter of the frequent
   hashes, of at most FILTER_BITS bits, keeps most others out of the next length's shuffle.
3. The phrases whose hashes are frequent leave the shards as text once, and their counts are merged
   by language and phrase: hashes and filters only ever let more pass, and these counts decide.
4. Frequent phrases are joined to their parts and scored in decimals of 38 digits.

Texts are bytes with A-Z in lower case, cut at ``.,;:!?``, line feeds, vertical tabs, form feeds
and carriage returns; words are what blanks and tabs leave.

Defined cases: a null text is empty and a null language is ``und``, together with texts that name it;
texts without words give nothing; a text longer than a shard goes on in the next one, with the words
that phrases across the border need; repeated rows count each time; equal scores are ordered by
count and then by phrase; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, byte_slices, hash_filter, may_hold
from tessera.llm.words import BASE, flat_bytes, mixed, portions, span_hashes, spans, white_space, within
from tessera.plans.shared import if_small, written

#: Words of a shard, but for the rest of the texts that fill it, and bytes that are added at once. Stored rows
#: stay below a megabyte, of which readers and writers hold several.
SHARD, PIECE = 1 << 15, 1 << 17
#: Hashes that a task holds before it adds up equal ones, and rows of an Arrow batch of counts.
HELD, ROWS = 1 << 20, 1 << 16
#: Shards of a counting task, about: the more it sees, the fewer rows it passes on.
TASK_SHARDS = 512
#: Bits of a phrase's hash; phrases that clash only cost a look at their text.
PHRASE_BITS = 48
#: Buckets of candidates whose first rows are taken before those of a language meet.
BUCKETS = 32

# Bytes that end a piece.
ENDS = b".,;:!?\n\v\f\r"


@lru_cache(maxsize=1)
def _byte_kinds():
    """Lower case of each byte, which bytes part words, and which of these end a piece."""
    import numpy as np

    lower, ends = np.arange(256).astype(np.uint8), np.zeros(256, bool)
    lower[65:91] += 32
    ends[list(ENDS)] = True
    return lower, ends | white_space(), ends


def suffix_array(ids, depth: int):
    """``(order, shared)``: all positions by their first ``depth`` ids, and how many of these each shares with the one before."""
    import numpy as np

    n = len(ids)
    ranks = {1: np.concatenate([ids.astype(np.int64), np.zeros(2 * depth, np.int64)])}

    def doubled(rank, step):
        key = rank * (rank.max() + 1) + np.concatenate([rank[step:], np.zeros(step, np.int64)])
        order = np.argsort(key)
        new, key = np.empty(len(rank), np.int64), key[order]
        new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        return new, order

    width, order = 1, np.argsort(ranks[1]) if depth == 1 else None
    while 2 * width <= depth:
        ranks[2 * width], order = doubled(ranks[width], width)
        width *= 2
    if width < depth:
        _, order = doubled(ranks[width], depth - width)
    order = order[order < n]
    shared = np.zeros(n, np.int64)
    for w in sorted(ranks, reverse=True):
        same = ranks[w][order[1:] + shared[1:]] == ranks[w][order[:-1] + shared[1:]]
        shared[1:] += w * same
    return order, np.minimum(shared, depth)


class _Shard:
    """Hashes of words in order, with 0 before a word that begins a piece, and where the words stand in the bytes added."""

    def __init__(self):
        self.hashes: list = []
        self.places: list = []  # begin, size and language of each hash
        self.raw: list = []
        self.langs: dict[str, int] = {}
        self.size = self.length = 0

    def _hold(self, raw, hashes, begin, size, lang) -> None:
        import numpy as np

        self.raw.append(raw)
        self.hashes.append(hashes)
        self.places.append(np.stack([begin + self.length, size, lang]))
        self.size += len(hashes)
        self.length += len(raw)

    def add(self, raw, begins, langs: list[str], new: bool, ended: bool = True) -> bool:
        """Adds texts that lie one after another; returns whether a piece ends after their last word.

        The first of them goes on from what was added before unless it is ``new``; ``ended`` tells if a
        piece ended there.
        """
        import numpy as np

        lower, blank, ends = _byte_kinds()
        raw = lower[raw]
        start, end, counts = spans(raw, begins, blank)
        upto = np.concatenate([[0], np.cumsum(ends[raw])])
        if not len(start):
            return new or ended or bool(upto[-1] > 0)
        row = np.repeat(np.arange(len(begins)), counts)
        hashes = _in_language(span_hashes(raw, start, end), langs, row)
        cut = upto[start] > upto[np.concatenate([[0], end[:-1]])]
        cut[1:] |= row[1:] != row[:-1]
        cut[0] |= new or ended or row[0] > 0
        at = np.flatnonzero(cut)
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs])[row]
        self._hold(raw, *(np.insert(c, at, 0) for c in (hashes, start, end - start, lang)))
        return bool(upto[-1] > upto[end[-1]])

    def next(self, depth: int) -> tuple[_Shard, int]:
        """A shard that begins with the words which phrases over the border need, and their number."""
        import numpy as np

        made, last = _Shard(), depth - 1
        if not last:
            return made, 0
        hashes, (begin, size, lang) = np.concatenate(self.hashes[-depth:]), np.concatenate(self.places[-depth:], axis=1)
        whole = np.flatnonzero(hashes[-last:] == 0)
        last = min(last, len(hashes)) - (whole[-1] + 1 if len(whole) else 0)
        if last:
            begin, size = begin[-last:], size[-last:]
            made.langs = dict(self.langs)
            made._hold(np.concatenate(self.raw)[within(begin, size)], hashes[-last:], np.cumsum(size) - size, size, lang[-last:])
        return made, int(last)

    def row(self, ahead: int, depth: int) -> pa.RecordBatch:
        """The shard as a row; its last ``ahead`` words are begun in the next shard."""
        import numpy as np

        given = np.concatenate([*self.hashes, np.zeros(depth, np.uint64)])
        known, first, ids = np.unique(given, return_index=True, return_inverse=True)
        ids, first = ids.astype(np.int32), first[1:]
        order, shared = suffix_array(ids, depth)
        # a suffix that is left out may share more with both neighbours than they show: the least decides
        keep = (order < len(ids) - depth - ahead) & (ids[order] > 0)
        at = np.flatnonzero(keep)
        shared = np.minimum.reduceat(shared[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1])) if len(at) else shared[:0]
        begin, size, lang = np.concatenate(self.places, axis=1)
        counted = np.bincount(lang[: len(lang) - ahead][given[: len(lang) - ahead] > 0], minlength=len(self.langs))
        text = np.concatenate(self.raw)[within(begin[first], size[first])]
        words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size[first])]).astype(np.int32)), pa.py_buffer(text)])
        kind = "<u2" if len(ids) < 1 << 16 else "<i4"
        packed = [ids.astype(kind), order[at].astype(kind), shared.astype(np.int8), known, lang[first].astype("<i4")]
        lists = [pa.array([list(self.langs)], pa.list_(pa.string())), pa.array([counted.tolist()], pa.list_(pa.int64())), pa.ListArray.from_arrays([0, len(words)], words)]
        return pa.RecordBatch.from_arrays([*(pa.array([v.tobytes()], pa.binary()) for v in packed), *lists], names=list(_SHARD))


_SHARD = {"ids": "binary", "suffixes": "binary", "shared": "binary", "hashes": "binary", "lang_of": "binary", "langs": "array<string>", "totals": "array<long>", "words": "array<string>"}


def _in_language(hashes, langs: list[str], row):
    """Hashes that tell a word of one language from the same word of another; never 0."""
    import numpy as np
    import xxhash

    known = {lang: xxhash.xxh64_intdigest(lang) for lang in set(langs)}
    made = mixed(hashes ^ np.array([known[lang] for lang in langs], np.uint64)[row])
    made[made == 0] = 1
    return made


def shards(df: DataFrame, lang_col: str = "lang", text_col: str = "text", depth: int = 5, size: int = SHARD) -> DataFrame:
    """One row a shard: ids of words, the suffix array and shared lengths as packed integers, and the words."""
    bounded_batches(df.sparkSession)

    def build(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        shard = _Shard()
        for batch in source:
            langs, (data, offsets) = batch.column(0).to_pylist(), flat_bytes(batch.column(1))
            for begin, end in portions(offsets, PIECE):
                text, ended, first = data[offsets[begin] : offsets[end]], True, True
                if len(text) <= PIECE:
                    shard.add(text, offsets[begin:end] - offsets[begin], langs[begin:end], True)
                else:  # one long text
                    for part in byte_slices(text.tobytes(), PIECE):
                        if not first and shard.size >= size:
                            made, ahead = (_Shard(), 0) if ended else shard.next(depth)
                            yield shard.row(ahead, depth)
                            shard = made
                        ended = shard.add(np.frombuffer(part, np.uint8), np.zeros(1, np.int64), langs[begin:end], first, ended)
                        first = False
                if shard.size >= size:
                    yield shard.row(0, depth)
                    shard = _Shard()
        if shard.size:
            yield shard.row(0, depth)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return df.select(lang.alias("lang"), F.col(text_col).alias("text")).mapInArrow(build, ", ".join(f"{c} {t}" for c, t in _SHARD.items()))


def _phrase_hashes(words, ids, at, n: int):
    """Hashes of the phrases of ``n`` words at some positions."""
    import numpy as np

    made = np.zeros(len(at), np.uint64)
    for j in range(n):
        made = made * np.uint64(BASE) + words[ids[at + j]]
    return (made >> np.uint64(64 - PHRASE_BITS)).view(np.int64)


def _phrases(batch: pa.RecordBatch, row: int, n: int, known):
    """``(ids, hashes, positions, counts)``: the intervals of a shard that are phrases of ``n`` words, both whose parts of n - 1 words ``known`` may hold."""
    import numpy as np

    shared = np.frombuffer(batch.column(2)[row].as_buffer(), np.int8)
    order = batch.column(1)[row].as_buffer()
    kind = "<u2" if order.size == 2 * len(shared) else "<i4"
    ids, order, hashes = (np.frombuffer(b, k) for b, k in ((batch.column(0)[row].as_buffer(), kind), (order, kind), (batch.column(3)[row].as_buffer(), np.uint64)))
    begin = np.flatnonzero(shared < n)
    size = np.diff(np.append(begin, len(order)))
    at = order[begin].astype(np.int64)
    ends = np.flatnonzero(ids == 0)
    whole = ends[np.searchsorted(ends, at)] - at >= n
    at, size = at[whole], size[whole]
    for step in (0, 1) if known is not None else ():
        held = may_hold(known.value, _phrase_hashes(hashes, ids, at + step, n - 1))
        at, size = at[held], size[held]
    return ids, hashes, at, size


def _hash_counts(stored: DataFrame, n: int, known=None) -> DataFrame:
    """``(h, n)`` of the phrases of ``n`` words of each shard."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[tuple] = []

        def added() -> tuple:
            h, n = (np.concatenate(c) for c in zip(*held, strict=True))
            h, at = np.unique(h, return_inverse=True)
            return h, np.bincount(at, n, len(h)).astype(np.int64)

        def rows(h, n):
            for i in range(0, len(h), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + ROWS]), pa.array(n[i : i + ROWS])], names=["h", "n"])

        for batch in source:
            for row in range(batch.num_rows):
                ids, hashes, at, size = _phrases(batch, row, n, known)
                held.append((_phrase_hashes(hashes, ids, at, n), size))
            if sum(len(h) for h, _ in held) > HELD:
                held = [added()]
                if len(held[0][0]) > HELD // 2:
                    yield from rows(*held.pop())
        if held:
            yield from rows(*added())

    return stored.select("ids", "suffixes", "shared", "hashes").mapInArrow(count, "h long, n long")


def phrase_counts(stored: DataFrame, known: list, longest: int) -> DataFrame:
    """``(lang, len, phrase, n)`` of phrases that the filter of their length may hold; ``known`` has one for each, or none for all."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        for batch in source:
            for n in range(1, longest + 1):
                found, held_ids = [], []
                for row in range(batch.num_rows):
                    ids, hashes, at, size = _phrases(batch, row, n, known[n - 2] if known and n > 1 else None)
                    h = _phrase_hashes(hashes, ids, at, n)
                    held = may_hold(known[n - 1].value, h) if known else np.ones(len(h), bool)
                    found.append((h[held], size[held], at[held], np.full(np.count_nonzero(held), row)))
                    held_ids.append(ids)
                h, size, at, row = (np.concatenate(c) for c in zip(*found, strict=True))
                _, first, same = np.unique(h, return_index=True, return_inverse=True)  # one of each in the batch
                size, at, row = np.bincount(same, size, len(first)).astype(np.int64), at[first], row[first]
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    some = order[cuts[r] : cuts[r + 1]]
                    ids, lang_of = held_ids[r].astype(np.int64), np.frombuffer(batch.column(4)[r].as_buffer(), "<i4")
                    langs, words = (batch.column(c)[r].values for c in (5, 7))
                    parts = [words.take(pa.array(ids[at[some] + j] - 1)) for j in range(n)]
                    phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang_of[ids[at[some]] - 1])), pa.array(np.full(len(some), n, np.int32)), phrase, pa.array(size[some])], names=["lang", "len", "phrase", "n"])

    return stored.mapInArrow(count, "lang string, len int, phrase string, n long").groupBy("lang", "len", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(df: DataFrame, least: int, longest: int = 5, lang_col: str = "lang", text_col: str = "text", size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``(lang, len, phrase, n)`` of phrases of 1 to ``longest`` words that occur ``least`` times, and ``(lang, total)``, all words."""
    pages = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "10", "compression": "zstd"}  # else a page is held for a hundred rows
    stored = written(shards(df, lang_col, text_col, longest, size), "shards", **pages)
    stored = stored.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // TASK_SHARDS)))
    known: list = []
    for n in range(1, longest + 1):
        counted = _hash_counts(stored, n, known[-1] if known else None).groupBy("h").agg(F.sum("n").alias("n"))
        level = written(counted.where(F.col("n") >= least).select("h"), f"phrases-{n}")
        known.append(df.sparkSession.sparkContext.broadcast(hash_filter(level, "h", level.count())))
    every = written(phrase_counts(stored, known, longest).where(F.col("n") >= least), "phrases")
    by_lang = stored.select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("total"))
    return every, written(by_lang.where("total > 0"), "totals")


def collocations(df: DataFrame, least: int = 100, longest: int = 5, top: int | None = 2000, percent: int = 100, lang_col: str = "lang", text_col: str = "text", size: int = SHARD) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``, the best phrases of each language (all without ``top``).

    A phrase that occurs a times is cut after each of its words; with l and r, the counts of both
    parts, and n, all words of the language, a cut scores floor(1000 a n / (l r)), and the lowest
    cut counts, the first of equal ones. A phrase within a longer one that occurs at least
    ``percent`` hundredths as often is dropped, whether that one is itself dropped or not; since
    counts fall with length, the phrases one word longer decide.
    """
    every, totals = frequent_phrases(df, least, longest, lang_col, text_col, size)
    words = F.split("phrase", " ")
    part = lambda begin, n: F.array_join(F.slice(words, begin, n), " ")
    phrases = every.where("len > 1")
    cuts = phrases.select("lang", "phrase", "len", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("len") - F.col("k")).alias("right"))
    known = if_small(every.select("lang", "phrase", "n"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)), ["lang", side])
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.join(if_small(totals.withColumnRenamed("total", "n")), "lang")
    over, under = (exact("a") * exact("n") * F.lit(1000)).cast("decimal(38,0)"), (exact("l") * exact("r")).cast("decimal(38,0)")
    cuts = cuts.withColumns({"over": over, "under": under}).withColumn("score", F.expr("over div under"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("c")).select("lang", "phrase", "c.score", "c.l", "c.r", "c.a", "c.n")
    inner = phrases.where("len > 2").select("lang", "n", F.explode(F.array(part(F.lit(1), F.col("len") - 1), part(F.lit(2), F.col("len") - 1))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(if_small(written(longer, "longer")), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")
    return _ranked(kept, top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _ranked(scored: DataFrame, top: int | None) -> DataFrame:
    """Ranks in each language; with ``top``, the best of BUCKETS parts are taken first, so few rows meet."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top:
        bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
        scored = scored.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top).drop("bucket", "rank")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top) if top else ranked
