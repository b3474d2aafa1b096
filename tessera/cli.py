"""Commands: ``python -m tessera.cli COMMAND ...`` (submit with the cluster's own settings)."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import classify as cl
from tessera.operators import distance as di
from tessera.operators import index as ix
from tessera.operators import ordering as od
from tessera.operators import prepare as pr
from tessera.plans.shared import if_small, numbered, scratch, written
from tessera.sources import formats as fm
from tessera.sources.snapshots import commit, opened


def _syncmer(args) -> tuple[int, int] | None:
    return None if args.s == args.k else (args.s, args.t)


def _file_table(spark: SparkSession, path: str) -> DataFrame:
    rows = numbered(fm.read_taxids(spark, path), "line", name="file_idx")
    return rows.select(F.col("file_idx").cast("int").alias("file_idx"), F.col("id").alias("file"), "taxid")


def _records(spark: SparkSession, folder: str, files: DataFrame, split: str | None = None) -> DataFrame:
    """Records of the listed files, in ``folder`` or among split files; a bad record ends its file.

    A listed file that is in neither is an error.
    """
    missing = [r["file"] for r in files.join(fm.known_files(spark, folder, split), "file", "left_anti").select("file").take(5)]
    if missing:
        raise FileNotFoundError(f"listed, but not in {folder}: {', '.join(missing)}")
    found = fm.read_fasta(spark, folder, mode="STOP").withColumn("file", F.element_at(F.split("file", "/"), -1))
    if split:
        found = found.unionByName(fm.read_split_fasta(spark, split))
    return found.join(if_small(files), "file").select("file_idx", "seq")


def file2taxid(spark, a):
    records = fm.read_fasta(spark, a.folder)
    taxids = pr.last_wins(fm.read_taxids(spark, a.map), "id", "line") if a.map else None
    table, parts = pr.file_table(records, taxids, pr.budget(a.k), a.overlap)
    fm.write_rows(table.orderBy("file"), ["file", "taxid"], fm.output_path(spark, a.out, "f2t"), "overwrite", order="file")
    fm.write_split_fasta(parts, fm.output_path(spark, a.out, "split"), "overwrite")


def pairwise(spark, a):
    files = _file_table(spark, a.table)
    postings = ix.stored_kmers(_records(spark, a.folder, files, a.split), a.k, _syncmer(a))
    _write_distances(di.distances(postings, files), files, fm.output_path(spark, a.out, "pd"))


def _write_distances(dist: DataFrame, files: DataFrame, path: str) -> None:
    """A new version, so a matrix may replace the one that it was computed from."""
    commit(files.sparkSession, path, {"distances": dist, "files": files}, mode="overwrite")


def _distances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    found = opened(spark, path)
    return found.table("distances"), found.table("files")


def extend(spark, a):
    old, old_files = _distances(spark, a.pd)
    n = old_files.count()
    new_files = _file_table(spark, a.table).withColumn("file_idx", (F.col("file_idx") + n).cast("int"))
    files = old_files.unionByName(new_files)
    records = _records(spark, a.old_folder, old_files, a.split).unionByName(_records(spark, a.new_folder, new_files, a.split))
    _write_distances(di.extended(old, ix.stored_kmers(records, a.k, _syncmer(a)), files, n), files, fm.output_path(spark, a.out, "pd"))


def order(spark, a):
    dist, files = _distances(spark, a.pd)
    tour = od.ordering(dist, a.start)
    fm.logs().info("tour: %s", od.tour_statistics(tour, dist).first().asDict())
    fm.write_rows(od.ordered_files(tour, files), ["file", "taxid"], fm.output_path(spark, a.out, "o.f2t"), "overwrite", order="pos")


def build(spark, a):
    files = _file_table(spark, a.table)
    ix.Index.build(_records(spark, a.folder, files, a.split), files, a.k, _syncmer(a)).save(fm.output_path(spark, a.out, "db"), "overwrite")


def build_lossy(spark, a):
    ix.Index.load(spark, a.db).lossy(a.level).save(fm.output_path(spark, a.out, "cdb"), "overwrite")


def classify(spark, a):
    reads, seen = cl.observed(fm.read_fastq(spark, a.reads).select(F.col("id").alias("read_id"), "seq"))
    began = time.time()
    done = cl.classify(reads, ix.Index.load(spark, a.db), a.e, a.n)
    fm.write_rows(done, ["flag", "read_id", "taxid", "file"], fm.output_path(spark, a.out, "r2f"), "overwrite")
    seconds = time.time() - began
    fm.logs().info("classified: %s", cl.throughput(spark.createDataFrame([seen.get], "reads long, bases long"), seconds).first().asDict())


def chop(spark, a):
    if a.fasta:
        fm.write_fasta(pr.chopped(fm.read_fasta(spark, a.reads, "STOP", None), a.length), fm.output_path(spark, a.out, "chopped.fasta"), "overwrite")
    else:
        fm.write_fastq(pr.chopped(fm.read_fastq(spark, a.reads, "STOP"), a.length), fm.output_path(spark, a.out, "chopped.fastq"), "overwrite")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(required=True)

    def command(name, run, *positional, kmers=False, **options):
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for p in positional:
            c.add_argument(p, type=int if p == "level" else str)
        c.add_argument("-o", "--out", default=".")
        if kmers:
            for flag, value in (("k", 15), ("s", 9), ("t", 2)):
                c.add_argument(f"-{flag}", type=int, default=value)
        for flag, value in options.items():
            c.add_argument(f"--{flag}", default=value, **({"action": "store_true"} if value is False else {"type": type(value)} if value is not None else {}))
        return c

    c = command("file2taxid", file2taxid, "folder", overlap=1_000_000, map=None)
    c.add_argument("-k", type=int, default=15)
    command("pairwise-distances", pairwise, "table", "folder", kmers=True, split=None)
    command("extend-distances", extend, "pd", "table", "new_folder", "old_folder", kmers=True, split=None)
    command("order", order, "pd", start=0)
    command("build", build, "table", "folder", kmers=True, split=None)
    command("build-lossy", build_lossy, "level", "db")
    c = command("classify", classify, "db", "reads")
    c.add_argument("-e", type=int, default=12)
    c.add_argument("-n", type=int, default=100)
    command("chop-reads", chop, "reads", length=180, fasta=False)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    with scratch():
        args.run(SparkSession.builder.appName("tessera").getOrCreate(), args)


if __name__ == "__main__":
    main()
