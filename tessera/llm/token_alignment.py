"""Groups of tokens of two tokenizers that cover the same bytes, and how often their ids meet.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library and encodes a space and the text;
B is a ``sentencepiece`` model, which puts that space before the text itself. Each byte gets a
label: none, A (a token of A ends there), B, or both. A regular expression takes the spans up to
each label *both*; the labels in a span are the tokens of a group. Every token of A in a group is
linked to every token of B in it.

Texts are cut before single spaces between two characters that are not white space. No match
of A's pattern and no piece of B reaches over such a place, so both tokenizers end a token there
and a segment's groups depend on it alone. Workers keep the groups of segments they have met,
up to CACHED characters and links, and align the new ones of a batch together. A text with a
segment whose bytes do not come back is aligned whole instead.

Counts of id pairs are numbers of rows that hold the pair linked. Each task adds up its own
before the shuffle. The TABLE most frequent pairs are broadcast and looked up where the links
are; links of rarer pairs are joined to the counts by pair, so the table of counts may have any
size.

Defined cases: texts that are null, empty, or whose joined tokens of A or B are not a space and
the text have no tokens: zeros, and an empty string of groups. Rows do not depend on each other's
ids: repeated rows and null ids count as rows. Ties for an A id's highest count all count as best.
Very long texts are aligned whole, segment by segment; an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded_batches
from tessera.plans.shared import if_small, written

#: Characters and links of segments that a worker keeps.
CACHED = 20_000_000
#: Uses of a segment since the last clearing by which it stays at the next.
KEPT_USES = 3
#: Characters of texts that are aligned at once.
CHARS = 1 << 20
#: Id pairs that a task adds up before it passes them on.
PAIRS = 1 << 21
#: Id pairs with counts that are broadcast at most: 17 bytes each.
TABLE = 1 << 20
#: Links of one group up to which they are written out one by one.
SMALL_GROUP = 1 << 10

_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
_SPAN = re.compile(rb"[^x]*x")
#: Labels of bytes by their bits: 1 for an end in A, 2 for an end in B.
_LABELS = bytes.maketrans(b"\x00\x01\x02\x03", b".abx")


def byte_alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters are themselves, and the rest follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _within(starts, sizes):
    """Positions of all items of ranges, one range after another."""
    import numpy as np

    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the segments met so far."""

    def __init__(self, a_file: str, b_file: str):
        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = byte_alphabet()
        self.a_bytes = [bytes(map(letters.__getitem__, t)) if set(t := self.a.id_to_token(i) or "") <= letters.keys() else t.encode() for i in range(self.a.get_vocab_size())]
        byte = lambda i: bytes([int(self.b.id_to_piece(i)[1:-1], 16)])
        self.b_bytes = [byte(i) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.vocab_size())]
        inner = re.compile(r"[^▁]▁")
        self.separable = not any(inner.search(self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        self.written = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;\n"]
        self.known, self.groups = {}, []
        self.forget()

    def forget(self, least: int | None = None) -> None:
        """Forgets the segments met, but for those used ``least`` times since this was last called."""
        import numpy as np

        kept = np.flatnonzero(self.used[: len(self.groups)] >= least) if least else np.empty(0, np.int64)
        stats = self.stats[kept] if least else np.empty((0, 6), np.int64)  # tokens of A and B, groups, links; begin and size in pairs
        self.pairs = self.pairs[:, _within(stats[:, 4], stats[:, 5])] if least else np.empty((2, 0), np.int64)  # a << 32 | b, and times
        stats[:, 4] = np.cumsum(stats[:, 5]) - stats[:, 5]
        again = dict(zip(kept.tolist(), range(len(kept)), strict=True))
        self.known: dict[str, int] = {s: again[i] for s, i in self.known.items() if i in again} if least else {}
        self.groups: list[str | None] = [self.groups[i] for i in again]  # None: the bytes do not come back
        self.chars = sum(map(len, self.known)) + sum(len(g or "") for g in self.groups)
        self.stats, self.used = stats, np.zeros(len(kept), np.int64)

    def learn(self, segments: list[str]) -> None:
        """Aligns new segments, each of which begins with a space."""
        import numpy as np

        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in segments], num_threads=1)
        raw = [s.encode() for s in segments]
        if not (self._same(a, self.a_bytes, self.a_sizes, raw) and self._same(b, self.b_bytes, self.b_sizes, raw)):
            good = [self._same([x], self.a_bytes, self.a_sizes, [r]) and self._same([y], self.b_bytes, self.b_sizes, [r]) for x, y, r in zip(a, b, raw, strict=True)]
        else:
            good = [True] * len(raw)
        first, stats = len(self.groups), np.zeros((len(segments), 6), np.int64)
        made = iter(self._aligned([x for x, g in zip(a, good, strict=True) if g], [y for y, g in zip(b, good, strict=True) if g], stats, np.flatnonzero(good)))
        self.known.update(zip(segments, range(first, first + len(segments)), strict=True))
        self.groups += [next(made) if g else None for g in good]
        self.chars += sum(map(len, segments)) + sum(len(g or "") for g in self.groups[first:])
        self.stats = np.concatenate([self.stats, stats])
        self.used = np.concatenate([self.used, np.zeros(len(segments), np.int64)])

    @staticmethod
    def _same(ids: list[list[int]], pieces: list[bytes], sizes, raw: list[bytes]) -> bool:
        """Whether the tokens of each segment are its bytes."""
        import numpy as np

        ends = np.cumsum(list(map(len, ids)))
        flat = np.fromiter((i for x in ids for i in x), np.int64, ends[-1])
        upto = np.concatenate([[0], np.cumsum(sizes[flat])])
        return np.array_equal(upto[ends], np.cumsum(list(map(len, raw)))) and b"".join(map(pieces.__getitem__, flat.tolist())) == b"".join(raw)

    def _aligned(self, a: list[list[int]], b: list[list[int]], stats, rows) -> list[str]:
        """The groups of segments as text; fills ``stats`` and adds to ``pairs``."""
        import numpy as np

        if not a:
            return []
        n_a, n_b = (np.array(list(map(len, t)), np.int64) for t in (a, b))
        a, b = (np.fromiter((i for x in t for i in x), np.int64, n) for t, n in ((a, n_a.sum()), (b, n_b.sum())))
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        labels = np.zeros(a_ends[-1], np.uint8)
        labels[a_ends - 1] |= 1
        labels[b_ends - 1] |= 2
        counts: dict[bytes, tuple[int, int]] = {}
        sizes = []
        for span in _SPAN.findall(labels.tobytes().translate(_LABELS)):
            if span not in counts:
                counts[span] = span.count(b"a") + 1, span.count(b"b") + 1
            sizes.append(counts[span])
        g_a, g_b = np.array(sizes, np.int64).T
        upto_a, upto_b = np.cumsum(g_a), np.cumsum(g_b)
        ends = np.searchsorted(upto_a, np.cumsum(n_a)) + 1  # groups up to the end of each segment
        begins = np.concatenate([[0], ends[:-1]])
        links = np.concatenate([[0], np.cumsum(g_a * g_b)])
        keys, times, of = self._links(a, b, g_a, g_b, upto_a, upto_b)
        sized = np.bincount(np.searchsorted(ends, of, side="right"), minlength=len(ends))
        stats[rows] = np.column_stack([n_a, n_b, ends - begins, links[ends] - links[begins], self.pairs.shape[1] + np.cumsum(sized) - sized, sized])
        self.pairs = np.concatenate([self.pairs, np.stack([keys, times])], axis=1)
        place_a = np.arange(len(a)) + np.repeat(upto_b - g_b, g_a)
        place_b = np.arange(len(b)) + np.repeat(upto_a, g_b)
        code_a, code_b, code = 2 * a, 2 * len(self.a_bytes) + 3 * b, np.empty(len(a) + len(b), np.int64)
        code_a[upto_a - 1] += 1
        code_b[upto_b - 1] += 1
        code_b[upto_b[ends - 1] - 1] += 1
        code[place_a], code[place_b] = code_a, code_b
        return "".join(map(self.written.__getitem__, code.tolist())).split("\n")[:-1]

    @staticmethod
    def _links(a, b, g_a, g_b, upto_a, upto_b):
        """``(pair, times, group)`` in the order of groups; large groups give each pair of ids once."""
        import numpy as np

        small = g_a * g_b <= SMALL_GROUP
        group = np.repeat(np.arange(len(g_a)), g_a)
        tokens = np.flatnonzero(small[group])
        per = g_b[group[tokens]]
        keys = np.repeat(a[tokens] << 32, per) | b[_within((upto_b - g_b)[group[tokens]], per)]
        of, times = np.repeat(group[tokens], per), np.ones(len(keys), np.int64)
        if small.all():
            return keys, times, of
        parts = [(keys, times, of)]
        for g in np.flatnonzero(~small).tolist():
            (x, n), (y, m) = (np.unique(t[u - k : u], return_counts=True) for t, u, k in ((a, upto_a[g], g_a[g]), (b, upto_b[g], g_b[g])))
            parts.append((((x << 32)[:, None] | y).ravel(), np.outer(n, m).ravel(), np.full(len(x) * len(y), g)))
        keys, times, of = map(np.concatenate, zip(*parts, strict=True))
        order = np.argsort(of, kind="stable")
        return keys[order], times[order], of[order]

    def align(self, texts: list[str | None]):
        """For each text the four numbers and the groups; and ``(text, pair, times)``, sorted, each pair once a text."""
        import numpy as np

        if self.chars + self.pairs.shape[1] > CACHED:
            self.forget(KEPT_USES)
            if self.chars + self.pairs.shape[1] > CACHED // 2:
                self.forget()
        cut = [(_BOUNDARY.split(f" {t}") if self.separable else [f" {t}"]) if t else [] for t in texts]
        for _ in range(2):
            new = list(dict.fromkeys(s for segments in cut for s in segments if s not in self.known))
            if new:
                self.learn(new)
            odd = [i for i, segments in enumerate(cut) if len(segments) > 1 and any(self.groups[self.known[s]] is None for s in segments)]
            if not odd:
                break
            for i in odd:
                cut[i] = [f" {texts[i]}"]
        found = [[self.known[s] for s in segments] for segments in cut]
        found = [f if f and self.groups[f[0]] is not None else [] for f in found]
        of = np.repeat(np.arange(len(texts)), list(map(len, found)))
        at = np.fromiter((i for f in found for i in f), np.int64, len(of))
        numbers = np.stack([np.bincount(of, self.stats[at, c], len(texts)).astype(np.int64) for c in range(4)], axis=1)
        self.used += np.bincount(at, minlength=len(self.used))
        once, n = np.unique(of << 40 | at, return_counts=True)
        of, at = once >> 40, once & ((1 << 40) - 1)
        sizes = self.stats[at, 5]
        where = _within(self.stats[at, 4], sizes)
        text, pair, times = np.repeat(of, sizes), self.pairs[0, where], self.pairs[1, where] * np.repeat(n, sizes)
        order = np.lexsort([pair, text])
        text, pair, times = text[order], pair[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])])) if len(text) else np.empty(0, np.int64)
        times = np.add.reduceat(times, new) if len(new) else times
        return numbers, [";".join([self.groups[i] for i in f]) for f in found], text[new], pair[new], times


@lru_cache(maxsize=1)
def aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def align(df: DataFrame, a_file: str, b_file: str, keys: list[str], text_col: str = "text") -> DataFrame:
    """``(*keys, n_a, n_b, n_groups, n_links, groups, a_ids, b_ids, times)``

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``. The last three columns hold the linked id pairs of a
    row, each once and in order, as little-endian unsigned 32-bit integers.
    """
    bounded_batches(df.sparkSession)
    numbers, packed = ("n_a", "n_b", "n_groups", "n_links"), ("a_ids", "b_ids", "times")
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in numbers), T.StructField("groups", T.StringType()), *(T.StructField(c, T.BinaryType()) for c in packed)])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known = aligner(a_file, b_file)
        for batch in source:
            texts = batch.column(len(keys)).to_pylist()
            for begin, end in _portions(texts):
                counted, groups, text, pair, times = known.align(texts[begin:end])
                cuts = np.searchsorted(text, np.arange(end - begin + 1)) * 4
                parts = [c.astype("<u4").tobytes() for c in (pair >> 32, pair & 0xFFFFFFFF, times)]
                lists = [pa.array([p[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()) for p in parts]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begin, end - begin) for i in range(len(keys))), *(pa.array(c) for c in counted.T.copy()), pa.array(groups), *lists], names=schema.names)

    return df.select(*keys, text_col).mapInArrow(batches, schema)


def _unpacked(batch: pa.RecordBatch, *columns: int):
    """The flat values of columns of packed integers, and the row of each value."""
    import numpy as np

    lists = [batch.column(c).to_pylist() for c in columns]
    sizes = [len(x) // 4 for x in lists[0]]
    return [np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in lists], np.repeat(np.arange(len(sizes)), sizes)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(a, b, n)``: rows that hold the pair linked."""

    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def merged():
            keys, n = (np.concatenate(c) for c in zip(*held, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, n).astype(np.int64)

        def made(keys, n):
            return pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n)], names=["a", "b", "n"])

        held: list[tuple] = []
        for batch in source:
            (a, b), _ = _unpacked(batch, 0, 1)
            held.append(np.unique(a << 32 | b, return_counts=True))
            if sum(len(h[0]) for h in held) > PAIRS:
                held = [merged()]
                if len(held[0][0]) > PAIRS // 2:
                    yield made(*held.pop())
        if held:
            yield made(*merged())

    return aligned.select("a_ids", "b_ids").mapInArrow(add, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least count of the pairs that are broadcast; counts are looked at in at most 64 * 16 classes."""
    size = F.floor(F.log2("n") * 16).cast("int")
    classes = sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect(), key=lambda r: -r["size"])
    least, seen = (classes[0]["least"] + (1 << 60) if classes else 1), 0
    for r in classes:
        seen += r["pairs"]
        if seen > most:
            break
        least = r["least"]
    return least


def link_totals(aligned: DataFrame, keys: list[str], most: int = TABLE) -> DataFrame:
    """``(*keys, n_best, count_sum)`` of stored rows of ``align``, over all links of a row.

    ``keys`` must tell rows apart. A link is best if its pair's count is the highest of its A id.
    """
    import numpy as np

    counts = written(pair_counts(aligned), "pairs")
    tops = written(counts.groupBy("a").agg(F.max("n").alias("top")), "tops")  # one row for each id of A
    counts = counts.join(if_small(tops), "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))
    least = _frequent(counts, most)
    rows = counts.where(F.col("n") >= least).toArrow()
    table = np.stack([rows["a"].to_numpy() << 32 | rows["b"].to_numpy(), rows["n"].to_numpy() * 2 + rows["best"].to_numpy(zero_copy_only=False)]) if rows.num_rows else np.empty((2, 0), np.int64)
    known = aligned.sparkSession.sparkContext.broadcast(table[:, np.argsort(table[0])])
    schema = T.StructType([*(aligned.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in ("n_best", "count_sum", "a", "b", "times"))])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pairs, n = known.value
        for batch in source:
            (a, b, times), of = _unpacked(batch, *range(len(keys), len(keys) + 3))
            key = a << 32 | b
            at = np.searchsorted(pairs, key).clip(max=max(len(pairs) - 1, 0))
            hit = pairs[at] == key if len(pairs) else np.zeros(len(key), bool)
            found = np.where(hit, n[at], 0) if len(pairs) else np.zeros(len(key), np.int64)
            sums = []
            for value in (found & 1, found >> 1):
                upto = np.concatenate([[0], np.cumsum(value * times)])
                ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
                sums.append(upto[ends[1:]] - upto[ends[:-1]])
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *map(pa.array, sums), none, none, none], names=schema.names)
            if not hit.all():
                rest = ~hit
                rows = pa.array(of[rest])
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(keys))), none, none, *(pa.array(c[rest]) for c in (a, b, times))], names=schema.names)

    done = aligned.select(*keys, "a_ids", "b_ids", "times").mapInArrow(batches, schema)
    whole = counts.where(F.col("n") < least).isEmpty()
    if whole:
        return done.select(*keys, "n_best", "count_sum")
    done = written(done, "links")
    asked = done.where("a is not null").select(*keys, "a", "b", "times").join(counts.where(F.col("n") < least), ["a", "b"])
    rare = asked.select(*keys, (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return done.where("a is null").select(*keys, "n_best", "count_sum").unionByName(rare).groupBy(*keys).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned_links(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", most: int = TABLE) -> DataFrame:
    """``(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of each row.

    Linked pairs are stored once; the groups, several times as long as the texts, by their digest.
    """
    marked = df.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col), F.col(text_col))
    groups = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    stored = written(align(marked, a_file, b_file, ["__row", id_col], text_col).withColumn("groups_sha256", groups).drop("groups"), "aligned")
    totals = link_totals(stored, ["__row"], most)
    return stored.drop("a_ids", "b_ids", "times").join(totals, "__row").drop("__row")
