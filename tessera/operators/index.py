"""The index: postings (kmer, file), their inverted lists, and each file's share of the universe."""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import packed as pk
from tessera.operators import rle
from tessera.operators.kmers import Syncmer, kmers, universe
from tessera.plans.shared import shuffles_freed, written
from tessera.sources.snapshots import Snapshot, commit, new_folder, opened, versions

#: Lists and postings of a bucket of a stored index, about, and buckets at most.
BUCKET_ROWS, BUCKET_POSTINGS, MOST_BUCKETS = 1 << 20, 1 << 24, 1 << 16


def file_kmers(records: DataFrame, k: int, syncmer: Syncmer = None, file_col: str = "file_idx", seq_col: str = "seq") -> DataFrame:
    """The set of k-mers of each file, over all its records: ``(file_col, kmer)``."""
    kind = records.schema[file_col].dataType
    if not isinstance(kind, T.IntegralType):
        return kmers(records, [file_col], seq_col, k, syncmer, repeats=False).distinct()
    return pk.postings(pk.packed(records, k, syncmer, file_col, seq_col), k, kind, file_col)


def stored_kmers(records: DataFrame, k: int, syncmer: Syncmer = None, file_col: str = "file_idx", seq_col: str = "seq") -> DataFrame:
    """The same rows, computed once and stored in packed form."""
    kind = records.schema[file_col].dataType
    if not isinstance(kind, T.IntegralType):
        return written(file_kmers(records, k, syncmer, file_col, seq_col), "postings")
    return pk.postings(written(pk.packed(records, k, syncmer, file_col, seq_col), "postings"), k, kind, file_col)


def cardinalities(postings: DataFrame, file_col: str = "file_idx") -> DataFrame:
    return postings.groupBy(file_col).agg(F.count("*").alias("n_kmers"))


def shares(postings: DataFrame, total: int, files: DataFrame | None = None, file_col: str = "file_idx") -> DataFrame:
    """``(file_col, n_kmers, p)``; files of ``files`` without postings keep p = 0."""
    return with_shares(cardinalities(postings, file_col), total, files, file_col)


def with_shares(counted: DataFrame, total: int, files: DataFrame | None = None, file_col: str = "file_idx") -> DataFrame:
    """``shares`` of ``(file_col, n_kmers)``."""
    if total <= 0:
        raise ValueError("the universe is empty")
    if files is not None:
        counted = files.select(file_col).distinct().join(counted, file_col, "left").na.fill(0, ["n_kmers"])
    return counted.withColumn("p", F.col("n_kmers") / F.lit(total))


def inverted(postings: DataFrame, file_col: str = "file_idx") -> DataFrame:
    """``(kmer, files)``, the files in ascending order; a list is at most as long as there are files."""
    return postings.groupBy("kmer").agg(F.sort_array(F.collect_list(file_col)).alias("files"))


def compressed(lists: DataFrame) -> DataFrame:
    """``(kmer, blocks)``"""
    return lists.select("kmer", rle.encode_udf("files").alias("blocks"))


def lossy(blocks: DataFrame, level: int) -> DataFrame:
    return blocks.select("kmer", rle.lossy_udf(level)("blocks").alias("blocks"))


def expanded(blocks: DataFrame, file_col: str = "file_idx") -> DataFrame:
    return blocks.select("kmer", F.explode(rle.decode_udf("blocks")).alias(file_col))


def size_totals(lists: DataFrame) -> DataFrame:
    """One row: runs before literals, blocks, and the set bits that the blocks hold."""
    sized = compressed(lists.select("kmer", "files")).select(F.size("blocks").alias("blocks"), rle.set_bits_udf("blocks").alias("set_bits"))
    runs = lists.agg(F.sum(rle.naive_runs_udf("files")).alias("naive_runs"))
    return sized.agg(F.sum("set_bits").alias("set_bits"), F.sum("blocks").alias("blocks")).join(runs, how="full", on=F.lit(True)).select("set_bits", "naive_runs", "blocks")


def set_bits(postings: DataFrame) -> DataFrame:
    """One row ``(set_bits, kmers)``; lists are counted, not built."""
    return postings.groupBy("kmer").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("set_bits"), F.count("*").alias("kmers"))


def list_cardinalities(lists: DataFrame) -> DataFrame:
    """``(file_idx, n_kmers)`` of compressed lists, from their runs."""
    return rle.weighted(lists, None, None).groupBy("file_idx").agg(F.sum("n").alias("n_kmers"))


def buckets_for(kmers: int, postings: int = 0) -> int:
    """A power of two, for BUCKET_ROWS lists and BUCKET_POSTINGS of theirs in each bucket or fewer."""
    return min(MOST_BUCKETS, max(8, 1 << max(0, -(-kmers // BUCKET_ROWS) - 1, -(-postings // BUCKET_POSTINGS) - 1).bit_length()))


def _write_bucketed(lists: DataFrame, path: str, buckets: int) -> None:
    """One file a bucket, sorted by k-mer. Spark's own writer of buckets needs a name, which is given up at once.

    Blocks have 16 bits, and are shuffled as such.
    """
    spark, name = lists.sparkSession, f"tessera_{uuid.uuid4().hex}"
    dealt = lists.select("kmer", rle.narrow_udf("blocks").alias("blocks")).repartition(buckets, "kmer").select("kmer", rle.wide_udf("blocks").alias("blocks"))
    try:
        dealt.write.format("parquet").bucketBy(buckets, "kmer").sortBy("kmer").option("path", path).option("compression", "zstd").saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # it is external: its files stay


def _read_bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A table of the session over the folder, whose buckets spare joins by k-mer an exchange and the scan what no k-mer asks for."""
    name = f"tessera_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (kmer BIGINT, blocks ARRAY<INT>) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


@dataclass
class Index:
    """Postings, the file table with p, and the parameters that reads must share.

    A built index, or one saved packed, has ``packed`` postings, and ``pairs`` (kmer, file_idx), read from them. A lossy
    or otherwise loaded one has ``lists``, (kmer, blocks): these are stored, bucketed by k-mer, and reads are
    matched against them as they are. What is made from packed postings is made when it is read.
    """

    files: DataFrame  # file_idx, file, taxid, n_kmers, p
    k: int
    syncmer: Syncmer
    total: int
    pairs: DataFrame | None = None
    lists: DataFrame | None = None
    stored: Snapshot | None = None
    packed: DataFrame | None = None  # part, kmers, n, packed

    @property
    def postings(self) -> DataFrame:
        """``(kmer, file_idx)``"""
        return self.pairs if self.pairs is not None else expanded(self.lists)

    @property
    def compressed(self) -> DataFrame:
        """``(kmer, blocks)``"""
        if self.lists is not None:
            return self.lists
        return compressed(inverted(self.pairs)) if self.packed is None else pk.blocks(self.packed, self.k)

    @staticmethod
    def build(records: DataFrame, files: DataFrame, k: int = 15, syncmer: Syncmer = (9, 2)) -> Index:
        """``records``: file_idx, seq. ``files``: file_idx, file, taxid.

        The postings are written to the shared folder once, packed, as p and every later query
        read them.
        """
        if syncmer and syncmer[0] == k:
            syncmer = None
        total = universe(records.sparkSession, k, syncmer).first()["total"]
        kind = records.schema["file_idx"].dataType
        packed = written(pk.packed(records, k, syncmer), "postings")
        counted = with_shares(pk.sizes(packed, k, kind).drop("total"), total)
        known = files.select("file_idx", "file", "taxid").join(counted, "file_idx", "left").na.fill({"n_kmers": 0, "p": 0.0})
        return Index(written(known, "files"), k, syncmer, total, pairs=pk.postings(packed, k, kind).select("kmer", "file_idx"), packed=packed)

    def lossy(self, level: int) -> Index:
        """Lists after lossy compression, with each file's p counted anew from their blocks."""
        if self.packed is None:
            kept = written(lossy(self.compressed, level), "lists")
            counted = list_cardinalities(kept)
        else:
            kept = pk.blocks(self.packed, self.k, rle.checked(level))
            counted = pk.sizes(self.packed, self.k, self.files.schema["file_idx"].dataType, level=level).drop("total")
        counted = counted.withColumn("p", F.col("n_kmers") / F.lit(self.total))
        files = self.files.drop("n_kmers", "p").join(counted, "file_idx", "left").na.fill({"n_kmers": 0, "p": 0.0})
        return Index(written(files, "files"), self.k, self.syncmer, self.total, lists=kept, packed=self.packed)

    def with_taxid(self, file: str, taxid: int) -> Index:
        """One file's taxid changed; an unknown file or the same value is an error."""
        found = [r["taxid"] for r in self.files.where(F.col("file") == file).select("taxid").take(2)]
        if len(found) != 1:
            raise KeyError(f"{file} is not in the index once")
        if found[0] == taxid:
            raise ValueError(f"{file} has the taxid {taxid} already")
        return replace(self, files=self.files.withColumn("taxid", F.when(F.col("file") == file, F.lit(taxid)).otherwise(F.col("taxid"))))

    def save(self, path: str, mode: str = "errorifexists", packed: bool = False) -> None:
        """A new version of the index at ``path``; lists that it holds already are not written again.

        Lists are bucketed by k-mer, which shuffles them; with ``packed``, the postings of a built index stay as they
        are: that takes least disk, and few reads are matched where they lie, while many shuffle both sides.
        """
        spark = self.files.sparkSession
        if mode != "overwrite" and versions(spark, path):
            raise FileExistsError(path)
        stored_so = self.stored is not None and self.stored.path == path
        if "packed" in self.stored.folders if stored_so else packed:
            if self.packed is None or self.lists is not None:
                raise ValueError("only an index as it was built is packed")
            properties = {"k": self.k, "syncmer": self.syncmer, "total": self.total}
            with shuffles_freed(spark):
                commit(spark, path, {"packed": self.stored.folders["packed"] if stored_so else self.packed, "files": self.files}, properties, mode)
            return
        if self.stored and self.stored.path == path:
            folder, buckets = self.stored.folders["lists"], self.stored.properties["buckets"]
        else:
            if self.packed is None:
                lists = written(self.compressed, "lists") if self.lists is None else self.lists
                size = lists.agg(F.count("*").alias("kmers"), F.coalesce(F.sum(F.size("blocks")), F.lit(0)).alias("n")).first()
            else:
                lists = self.compressed
                size = self.packed.agg(F.coalesce(F.sum("kmers"), F.lit(0)).alias("kmers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
            folder, buckets = new_folder("lists"), buckets_for(size["kmers"], size["n"])
            _write_bucketed(lists, posixpath.join(path, folder), buckets)
        properties = {"k": self.k, "syncmer": self.syncmer, "total": self.total, "buckets": buckets}
        commit(spark, path, {"lists": folder, "files": self.files}, properties, mode)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> Index:
        found = opened(spark, path, version)
        meta = found.properties
        if "packed" in found.folders:
            files, packed = found.table("files"), found.table("packed")
            pairs = pk.postings(packed, meta["k"], files.schema["file_idx"].dataType).select("kmer", "file_idx")
            return Index(files, meta["k"], tuple(meta["syncmer"]) if meta["syncmer"] else None, meta["total"], pairs=pairs, stored=found, packed=packed)
        lists = _read_bucketed(spark, found.folder("lists"), meta["buckets"])
        return Index(found.table("files"), meta["k"], tuple(meta["syncmer"]) if meta["syncmer"] else None, meta["total"], lists=lists, stored=found)
