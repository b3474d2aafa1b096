"""Sources and sinks: FASTA, FASTQ, tables of names and taxids, classifications."""

from __future__ import annotations

import hashlib
import logging
import os
import posixpath
import sys
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.shared import if_small, written
from tessera.sources.records import opened, register

# Extensions of FASTA files, told apart by case.
FASTA_ENDINGS = (".fna", ".fasta", ".fa")
FASTA_GLOB = "*.{fna,fasta,fa}"
FASTA_PATTERNS = "*.fna|*.fasta|*.fa"


def fasta_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, bytes)`` of the FASTA files that lie in a folder, without its subfolders."""
    return spark.read.format("binaryFile").option("pathGlobFilter", FASTA_GLOB).load(folder).select("path", F.col("length").alias("bytes"))


def plain_path(path: Column) -> Column:
    """A path as files are named; the hidden metadata column has it percent-encoded."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _lines(reader: DataFrameReader, path: str) -> DataFrame:
    """``(file, __block, value)`` of text files, which are split into blocks."""
    text = reader.text(path)
    return text.select(plain_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("__block"), "value")


def _in_files(lines: DataFrame, name: str = "line") -> DataFrame:
    """``lines`` with each one's number in its file, from 0.

    A line's place within its block is known where it is read, so no line is shuffled or
    sorted: only the numbers of lines of the blocks are. The lines are stored with their
    places, because a second scan may split the files otherwise once executors came or went.
    """
    placed = written(lines.withColumn("__at", F.monotonically_increasing_id()), "lines")
    blocks = placed.groupBy("file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "__block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__start"))
    return placed.join(if_small(written(starts, "blocks")), ["file", "__block"]).withColumn(name, F.col("__at") + F.col("__start")).drop("__at", "__block", "__start")


def read_fasta(spark: SparkSession, path: str, mode: str = "FAILFAST", glob: str | None = FASTA_PATTERNS, recursive: bool = False) -> DataFrame:
    """``(file, at, id, desc, seq)``; ``at`` is the byte where a record starts in its file.

    A record without an id, or text before the first record of a file, is bad: FAILFAST raises,
    DROP leaves it out, and STOP leaves out it and what follows in its file.
    """
    return _handled(_records(spark, "fasta", path, glob, recursive), mode, "FASTA")


def read_fastq(spark: SparkSession, path: str, mode: str = "DROP") -> DataFrame:
    """``(file, at, id, desc, seq, qual)``; sequences and qualities may span lines.

    A record that lost a line is bad alone: framing goes on at the next record.
    """
    return _handled(_records(spark, "fastq", path), mode, "FASTQ")


def stream_fastq(spark: SparkSession, path: str, mode: str = "DROP", most_bytes: int | None = None) -> DataFrame:
    """The records of FASTQ files in a folder as files come and grow; a record that is still being written waits.

    ``most_bytes`` bounds what a micro-batch takes; modes are DROP and FAILFAST.
    """
    if mode == "STOP":
        raise ValueError("a stream cannot stop at a bad record; use FAILFAST")
    register(spark)
    reader = spark.readStream.format("fastq")
    return _handled((reader.option("maxBytesPerTrigger", most_bytes) if most_bytes else reader).load(path), mode, "FASTQ")


def _records(spark: SparkSession, kind: str, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    register(spark)
    reader = spark.read.format(kind).option("recursive", str(recursive).lower())
    return (reader.option("glob", glob) if glob else reader).load(path)


def _handled(rows: DataFrame, mode: str, what: str) -> DataFrame:
    if mode == "DROP":
        return rows.where("not bad").drop("bad")
    if mode == "FAILFAST":
        return rows.where(F.when(F.col("bad"), F.raise_error(F.concat(F.lit(f"bad {what} record in "), F.col("file"))).cast("boolean")).otherwise(True)).drop("bad")
    if mode != "STOP":
        raise ValueError("the mode must be FAILFAST, DROP or STOP")
    first = written(rows.where("bad").groupBy("file").agg(F.min("at").alias("__bad")), "bad-records")
    return rows.join(if_small(first), "file", "left").where("__bad is null or at < __bad").drop("__bad", "bad")


def parse_taxids(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(id, taxid)`` of lines with a name, a tab and an unsigned number; other lines go.

    Further columns are ignored. Other columns of ``lines`` stay, such as a line number.
    """
    parts = F.split(value, "\t")
    number = F.get(parts, F.lit(1))
    good = lines.where(number.rlike(r"^\+?[0-9]+$") & F.expr("try_cast(split(`%s`, '\t')[1] AS decimal(38, 0))" % value).between(0, 2**63 - 1))
    return good.select(*[c for c in lines.columns if c != value], parts[0].alias("id"), number.cast("long").alias("taxid"))


def read_taxids(spark: SparkSession, path: str) -> DataFrame:
    """``(line, id, taxid)``; ``line`` is the number of the line, through all files by name."""
    lines = _in_files(_lines(spark.read, path))
    sizes = lines.groupBy("file").agg(F.count("*").alias("__n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = sizes.select("file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return parse_taxids(lines.join(if_small(written(starts, "files")), "file").select((F.col("line") + F.col("__start")).alias("line"), "value"))


def write_fasta(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    head = F.concat(F.lit(">"), F.col("id"), F.coalesce(F.concat(F.lit(" "), F.col("desc")), F.lit("")))
    records.select(F.concat_ws("\n", head, "seq").alias("value")).write.mode(mode).text(path)


def write_split_fasta(parts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder ``name=...`` with one FASTA file for each split file.

    Files are so many that tasks write them where they stay. Their names are made from what they
    hold, so a task that runs again writes the same ones; ``_SUCCESS`` comes last.
    """
    from pyarrow import fs

    system, inner, _ = opened(path)
    there = system.get_file_info(inner).type != fs.FileType.NotFound
    if there and mode in ("error", "errorifexists"):
        raise FileExistsError(path)
    if there and mode == "ignore":
        return
    if there and mode == "overwrite":
        system.delete_dir(inner)
    system.create_dir(inner)

    def write(source):
        target, folder, _ = opened(path)
        n = 0
        for batch in source:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                text = value.encode() + b"\n"
                inside = posixpath.join(folder, f"name={quote(name, safe='')}")
                target.create_dir(inside)
                with target.open_output_stream(posixpath.join(inside, f"part-{hashlib.md5(text).hexdigest()}.txt")) as out:
                    out.write(text)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    head = F.concat(F.lit(">"), F.col("id"), F.coalesce(F.concat(F.lit(" "), F.col("desc")), F.lit("")))
    rows = parts.select(F.element_at(F.split("name", "/"), -1).alias("name"), F.concat_ws("\n", head, "seq").alias("value"))
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one number
    with system.open_output_stream(posixpath.join(inner, "_SUCCESS")):
        pass


def read_split_fasta(spark: SparkSession, path: str, split_dir: str = "split") -> DataFrame:
    """Records of split files, named as in the table of files."""
    found = read_fasta(spark, path, "STOP", None, recursive=True)
    return found.withColumn("file", F.concat(F.lit(f"{split_dir}/"), plain_path(F.regexp_extract("file", "name=([^/]+)/[^/]*$", 1))))


def _entries(spark: SparkSession, folder: str) -> list:
    """The entries of a folder, as the file system lists them: ``(name, is a file)``."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(found)
    return [(e.getPath().getName(), e.isFile()) for e in listed]


def known_files(spark: SparkSession, folder: str, split: str | None = None, split_dir: str = "split") -> DataFrame:
    """``(file)``: names of the FASTA files of a folder, empty ones too, and of split files, from listings alone."""
    names = [n for n, is_file in _entries(spark, folder) if is_file and n.endswith(FASTA_ENDINGS)]
    if split:
        names += [f"{split_dir}/{unquote(n.removeprefix('name='))}" for n, is_file in _entries(spark, split) if not is_file and n.startswith("name=")]
    return spark.createDataFrame([(n,) for n in names], "file string")


def write_fastq(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    head = F.concat(F.lit("@"), F.col("id"), F.coalesce(F.concat(F.lit(" "), F.col("desc")), F.lit("")))
    records.select(F.concat_ws("\n", head, F.col("seq"), F.lit("+"), F.col("qual")).alias("value")).write.mode(mode).text(path)


def write_rows(df: DataFrame, columns: list[str], path: str, mode: str = "errorifexists", order: str | None = None) -> None:
    """Lines with tabs; with ``order``, one file in that order (for small tables)."""
    lines = df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("value"), *([order] if order else []))
    if order:
        lines = lines.coalesce(1).sortWithinPartitions(order).select("value")
    lines.write.mode(mode).text(path)


def read_classification(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("flag"), parts[1].alias("read_id"), parts[2].cast("long").alias("taxid"), parts[3].alias("file"))


def is_folder(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(found) and fs.getFileStatus(found).isDirectory()


def output_path(spark: SparkSession, out: str, extension: str) -> str:
    """In a folder ``out/extension``; else ``out`` with its last extension replaced."""
    if is_folder(spark, out):
        return posixpath.join(out, extension)
    return f"{posixpath.splitext(out)[0]}.{extension}"


def logs(level: str | None = None) -> logging.Logger:
    """Information to standard output, warnings and errors to standard error."""
    found = logging.getLogger("tessera")
    if not found.handlers:
        low, high = logging.StreamHandler(sys.stdout), logging.StreamHandler(sys.stderr)
        low.addFilter(lambda r: r.levelno < logging.WARNING)
        high.setLevel(logging.WARNING)
        found.handlers = [low, high]
    found.setLevel(level or os.environ.get("TESSERA_LOG", "INFO"))
    return found
