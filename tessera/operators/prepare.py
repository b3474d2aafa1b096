"""File tables: taxids of files, splitting of long files, chopping of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import sequence as sq


def budget(k: int) -> int:
    """The longest sequence that goes unsplit: a tenth of the universe of canonical k-mers."""
    total = (4**k + (4 ** (k // 2) if k % 2 == 0 else 0)) // 2
    return int(total * 0.1 + 0.5)


def last_wins(rows: DataFrame, key: str, line: str) -> DataFrame:
    """Of rows with one key, the one with the highest line number."""
    best = Window.partitionBy(key).orderBy(F.desc(line))
    return rows.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def first_records(records: DataFrame) -> DataFrame:
    """``(file, id)``: the first record of each file, by number or else by place."""
    return records.groupBy("file").agg(F.min_by("id", "record_idx" if "record_idx" in records.columns else "at").alias("id"))


def with_numbers(records: DataFrame) -> DataFrame:
    """``records`` with ``record_idx``, from 0 in each file; without it, records are ordered by ``at``.

    Only names and places meet in a file's task, not sequences.
    """
    if "record_idx" in records.columns:
        return records
    number = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    return records.join(records.select("file", "at").withColumn("record_idx", number), ["file", "at"])


def with_taxids(files: DataFrame, taxids: DataFrame | None, strict: bool = True) -> DataFrame:
    """``files`` (with ``id``) and ``taxid``. Without a map all are 0; with one, a missing id is an error."""
    if taxids is None:
        return files.withColumn("taxid", F.lit(0).cast("long"))
    joined = files.join(taxids.select("id", "taxid"), "id", "left")
    value = F.coalesce("taxid", F.raise_error(F.concat(F.lit("no taxid for "), F.coalesce("id", F.lit("null")))).cast("long")) if strict else F.coalesce("taxid", F.lit(0))
    return joined.withColumn("taxid", value.cast("long"))


def file_lengths(records: DataFrame) -> DataFrame:
    return records.groupBy("file").agg(F.sum(F.length("seq")).alias("bases"))


def split_files(records: DataFrame, longest: int, overlap: int) -> DataFrame:
    """Records of files over ``longest`` become files of their own, and long records fragments.

    ``(file, name, id, desc, seq, split)``: ``name`` is the new file's, or the old one's.
    """
    sized = records.join(file_lengths(records), "file")
    whole = sized.where(F.col("bases") <= longest).select("file", F.col("file").alias("name"), "id", "desc", "seq", F.lit(False).alias("split"))
    big = with_numbers(sized.where(F.col("bases") > longest))
    kept = big.where(F.length("seq") <= longest).select("file", sq.split_name(F.col("file"), F.col("record_idx")).alias("name"), "id", "desc", "seq", F.lit(True).alias("split"))
    cut = big.where(F.length("seq") > longest).select("file", "record_idx", "id", F.explode(sq.fragments(F.col("seq"), longest, overlap)).alias("f"))
    cut = cut.select(
        "file", sq.split_name(F.col("file"), F.col("record_idx"), F.col("f.idx")).alias("name"), "id",
        F.concat(F.col("f.start").cast("string"), F.lit(".."), F.col("f.end").cast("string")).alias("desc"), F.col("f.seq").alias("seq"), F.lit(True).alias("split"),
    )
    return whole.unionByName(kept).unionByName(cut)


def file_table(records: DataFrame, taxids: DataFrame | None, longest: int, overlap: int, split_dir: str = "split") -> tuple[DataFrame, DataFrame]:
    """The table ``(file, taxid)`` and the records to write for files that were split."""
    found = with_taxids(first_records(records), taxids)
    parts = split_files(records, longest, overlap)
    clash = parts.where("split").groupBy("name").agg(F.count("*").alias("n")).where("n > 1").take(1)
    if clash:
        raise ValueError(f"two split files would be named {clash[0]['name']}")
    names = parts.select("file", "name", "split").distinct().join(found.select("file", "taxid"), "file")
    shown = F.when(F.col("split"), F.concat(F.lit(f"{split_dir}/"), F.element_at(F.split("name", "/"), -1))).otherwise(sq.shown_path(F.col("name"), split_dir))
    return names.select(shown.alias("file"), "taxid"), parts.where("split").drop("file")


def chopped(reads: DataFrame, length: int = 180) -> DataFrame:
    """The first bases of each read, and of its qualities if it has any."""
    for c in ("seq", "qual"):
        if c in reads.columns:
            reads = reads.withColumn(c, sq.chop(F.col(c), length))
    return reads
