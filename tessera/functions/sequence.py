"""Sequence expressions over built-in functions: the readable twins of the k-mer kernel.

Codes take two bits a base, A 0, C 1, G 2, T 3, the first base most significant. For words
of one length the order of strings is the order of codes, so canonical words need no
numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = ("ACGT" * 7)[:26] * 2


def letters_as_bases(text: Column) -> Column:
    """Text as a sequence: letters become bases in turn, everything else goes."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z]", ""), ALPHABET, BASES)


_TO_BASES = bytes.maketrans(ALPHABET.encode(), BASES.encode())
_NO_LETTERS = bytes(b for b in range(256) if chr(b) not in ALPHABET)


def letters_as_bytes(text: str) -> bytes:
    """``letters_as_bases`` of one text, for tasks in Python."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_BASES, _NO_LETTERS)


def letters_and_breaks(text: Column) -> Column:
    """As ``letters_as_bases``, but a blank becomes N, which ends k-mers."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z ]", ""), ALPHABET + " ", BASES + "N")


def base_code(base: Column) -> Column:
    """0 to 3 for a base of either case, else null."""
    at = F.instr(F.lit("ACGT"), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1)


def reverse_complement(word: Column) -> Column:
    return F.reverse(F.translate(F.upper(word), "ACGT", "TGCA"))


def canonical(word: Column) -> Column:
    return F.least(F.upper(word), reverse_complement(word))


def encode(word: Column) -> Column:
    return F.conv(F.translate(F.upper(word), "ACGT", "0123"), 4, 10).cast("long")


def decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def windows(seq: Column, k: int) -> Column:
    """``array<struct<pos, word>>`` of the windows that hold bases only, in order."""
    every = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - k + 1)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(every, lambda i: F.struct((i - 1).alias("pos"), F.upper(F.substring(seq, i, F.lit(k))).alias("word")))
    return F.filter(cut, lambda w: w["word"].rlike("^[ACGT]+$"))


def smers(word: Column, k: int, s: int, from_right: bool) -> Column:
    at = F.sequence(F.lit(1), F.lit(k - s + 1))
    return F.transform(F.reverse(at) if from_right else at, lambda i: F.substring(word, i, F.lit(s)))


def syncmer_position(word: Column, k: int, s: int, rightmost: bool = True) -> Column:
    """Offset from the left of the least s-mer; between equal ones the right-most, or left-most, counts."""
    found = smers(word, k, s, rightmost)
    first = F.array_position(found, F.array_min(found)) - 1
    return (k - s) - first if rightmost else first


def chop(text: Column, length: int = 180) -> Column:
    return F.substring(text, 1, length)


def fragments(seq: Column, longest: int, overlap: int) -> Column:
    """``array<struct<idx, start, end, seq>>``: equal parts, each widened by half the overlap."""
    n = F.greatest(F.ceil(F.length(seq) / F.lit(longest)), F.lit(1)).cast("int")
    part = F.ceil(F.length(seq) / n).cast("int")
    half = overlap // 2
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            i.alias("idx"),
            F.greatest(F.lit(0), i * part - half).alias("start"),
            F.least(i * part + part + half, F.length(seq)).alias("end"),
            F.substring(seq, F.greatest(F.lit(0), i * part - half) + 1, F.least(i * part + part + half, F.length(seq)) - F.greatest(F.lit(0), i * part - half)).alias("seq"),
        ),
    )


def split_name(name: Column, record: Column, fragment: Column | None = None) -> Column:
    """The last extension is replaced by the record's number and, if given, the fragment's."""
    stem = F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")
    return F.concat_ws(".", stem, record.cast("string"), *([fragment.cast("string")] if fragment is not None else []))


def shown_path(path: Column, split_dir: str = "split") -> Column:
    """The file's name, after the name of the folder for split files if it lies there."""
    parts = F.split(path, "/")
    return F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 2) == split_dir), F.concat_ws("/", F.lit(split_dir), F.element_at(parts, -1))).otherwise(F.element_at(parts, -1))


def rescaled(x: Column, n: Column, trials: int) -> Column:
    """Hits out of ``trials``, halves rounded up; reads of fewer k-mers keep theirs."""
    return F.when(n > trials, F.floor(x * trials / n + 0.5)).otherwise(x).cast("long")
