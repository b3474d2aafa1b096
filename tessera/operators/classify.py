"""Reads to files: the file whose number of shared k-mers is least likely by chance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions.binomial import ln_tail
from tessera.functions.sequence import rescaled
from tessera.operators import packed as pk
from tessera.operators import rle
from tessera.operators.index import Index
from tessera.operators.kmers import Syncmer, kmer_counts
from tessera.plans.shared import if_small, is_small, written


#: Tells records apart: paired reads and repeated rows may share an id.
ROW = "__record"


def read_kmers(reads: DataFrame, k: int, syncmer: Syncmer = None, read_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """``(__record, read_col, kmer, times)``, and for each record a row with a null k-mer.

    Records are numbered where they are read and their k-mers counted there, so nothing is
    shuffled. Stored, since hits and sizes both need it and the numbers must not change.
    """
    marked = reads.select(F.monotonically_increasing_id().alias(ROW), read_col, seq_col)
    return written(kmer_counts(marked, [ROW, read_col], seq_col, k, syncmer), "read-kmers")


def read_sizes(counted: DataFrame, read_col: str = "read_id") -> DataFrame:
    """``(__record, read_col, n)``: all k-mers of each record, whether a file has them or not."""
    return counted.groupBy(ROW, read_col).agg(F.sum("times").alias("n"))


def hits(counted: DataFrame, postings: DataFrame) -> DataFrame:
    """``(__record, file_idx, x)``

    Few reads are broadcast to the postings, which then need no shuffle; beyond the counted
    bound both sides shuffle by k-mer, and adaptive execution splits frequent ones.
    """
    asked = counted.where("kmer is not null").select(ROW, "kmer", "times")
    return postings.join(if_small(asked), "kmer").groupBy(ROW, "file_idx").agg(F.sum("times").alias("x"))


#: K-mers up to which a scan of stored lists is told what to look for, so it skips the other buckets.
FEW_KMERS = 1 << 12


def list_hits(counted: DataFrame, lists: DataFrame) -> DataFrame:
    """``(__record, file_idx, x)`` from compressed lists, which are not expanded.

    Stored lists are bucketed by k-mer, so only reads shuffle to meet them, and few k-mers read
    their own buckets alone. Blocks then go to counts record by record for each Arrow batch.
    """
    asked = counted.where("kmer is not null").select(ROW, "kmer", "times")
    few = [r["kmer"] for r in asked.select("kmer").distinct().limit(FEW_KMERS + 1).collect()]
    if len(few) <= FEW_KMERS:
        lists = lists.where(F.col("kmer").isin(few))
    met = lists.join(if_small(asked), "kmer").select(ROW, "blocks", "times")
    return rle.weighted(met, ROW, "times").groupBy(ROW, "file_idx").agg(F.sum("n").alias("x"))


def index_hits(counted: DataFrame, index: Index) -> DataFrame:
    """``(__record, file_idx, x)``; few reads meet packed postings where these lie, and the sums are shuffled packed."""
    if index.lists is not None:
        return list_hits(counted, index.lists)
    if index.packed is not None:
        asked = counted.where("kmer is not null").select(ROW, "kmer", "times")
        if is_small(asked):
            return pk.hits(index.packed, index.k, index.files.schema["file_idx"].dataType, asked)
    return hits(counted, index.pairs)


def candidates(found: DataFrame, sizes: DataFrame, files: DataFrame, trials: int) -> DataFrame:
    """Hits above expectation (x > n p, unscaled), with ``xs``, the hits out of ``trials``."""
    known = if_small(files.where("p > 0").select("file_idx", "n_kmers", "p"))
    joined = found.join(if_small(sizes), ROW).join(known, "file_idx")
    return joined.where(F.col("x") > F.col("n") * F.col("p")).withColumn("xs", rescaled(F.col("x"), F.col("n"), trials))


def tails(wanted: DataFrame, trials: int, zero_sorts_last: bool = True) -> DataFrame:
    """``(p, xs, lsf)`` once for each pair that occurs, however many reads share it."""
    return wanted.select("p", "xs").distinct().withColumn("lsf", ln_tail(F.col("p"), F.col("xs"), trials, zero_sorts_last))


def winners(scored: DataFrame, decimals: int | None = None) -> DataFrame:
    """The least tail of each record; between equal ones the first file.

    ``decimals`` rounds ln p first, which makes other engines' last digits irrelevant.
    """
    least = F.col("lsf") if decimals is None else F.round("lsf", decimals)
    order = Window.partitionBy(ROW).orderBy(least, "file_idx")
    return scored.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def scored(counted: DataFrame, index: Index, trials: int = 100, zero_sorts_last: bool = True, read_col: str = "read_id") -> DataFrame:
    """Candidates of counted reads, with ln of their tails as ``lsf``."""
    wanted = written(candidates(index_hits(counted, index), read_sizes(counted, read_col), index.files, trials), "candidates")
    return wanted.join(if_small(tails(wanted, trials, zero_sorts_last)), ["p", "xs"])


def classify(
    reads: DataFrame, index: Index, exponent: int = 12, trials: int = 100, zero_sorts_last: bool = True, read_col: str = "read_id", seq_col: str = "seq", decimals: int | None = None
) -> DataFrame:
    """``(flag, read, taxid, file)`` for every record; C below 10^-exponent, else U, 0 and ``-``."""
    counted = read_kmers(reads, index.k, index.syncmer, read_col, seq_col)
    best = winners(scored(counted, index, trials, zero_sorts_last, read_col), decimals).where(F.col("lsf") < -exponent * math.log(10))
    named = best.select(ROW, "file_idx").join(if_small(index.files.select("file_idx", "taxid", "file")), "file_idx").drop("file_idx")
    every = counted.where("kmer is null").select(ROW, read_col)
    return every.join(named, ROW, "left").select(
        F.when(F.col("file").isNull(), "U").otherwise("C").alias("flag"), read_col, F.coalesce("taxid", F.lit(0)).cast("long").alias("taxid"), F.coalesce("file", F.lit("-")).alias("file")
    )


def observed(reads: DataFrame, seq_col: str = "seq") -> tuple[DataFrame, Observation]:
    """``reads`` that count themselves, and their bases, in the pass that classifies them."""
    seen = Observation()
    return reads.observe(seen, F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum(F.length(seq_col)), F.lit(0)).alias("bases")), seen


def statistics(reads: DataFrame, seq_col: str = "seq") -> DataFrame:
    return reads.agg(F.count("*").alias("reads"), F.coalesce(F.sum(F.length(seq_col)), F.lit(0)).alias("bases"))


def throughput(counts: DataFrame, seconds: float) -> DataFrame:
    """``statistics`` with reads and millions of bases a second."""
    rate = lambda c, unit: F.try_divide(F.col(c), F.lit(float(seconds) * unit))
    return counts.withColumns({"seconds": F.lit(float(seconds)), "reads_per_second": rate("reads", 1), "mbp_per_second": rate("bases", 1e6)})
