"""Greedy orderings of files by distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.shared import written

#: Nearest files of each one that the driver holds, 12 bytes each.
NEAREST = 64


def greedy_tour(dist: DataFrame, start: int = 0, nearest: int = NEAREST) -> list[int]:
    """From ``start`` always to the nearest file not seen, the lowest index between equals.

    A tour is sequential, but needs no matrix: the driver holds the ``nearest`` others of each file
    by distance and index. The first of them that is not seen is the nearest of all; only where all
    are seen, the file's own row is read from the stored matrix, which is clustered by file.
    """
    import numpy as np

    if nearest < 1:
        raise ValueError("one nearest file is held at least")
    last = dist.agg(F.max("i").alias("last")).first()["last"]
    if last is None:
        return []
    n = last + 1
    if not 0 <= start < n:
        raise ValueError("the start is no file")
    ends = dist.where("i <> j").select("i", "j", "dist")
    both = ends.select(F.col("i").alias("file"), F.col("j").alias("other"), "dist").unionByName(ends.select(F.col("j").alias("file"), F.col("i").alias("other"), "dist"))
    rows = written(both.repartitionByRange("file").sortWithinPartitions("file", "dist", "other"), "rows")
    order = Window.partitionBy("file").orderBy("dist", "other")
    short = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("file", "rank", "other").toArrow()
    near = np.full((n, min(nearest, max(n - 1, 1))), -1, np.int64)
    if short.num_rows:
        near[short["file"].to_numpy(), short["rank"].to_numpy() - 1] = short["other"].to_numpy()
    left, tour = np.ones(n, bool), [start]
    left[start] = False
    while len(tour) < n:
        at = tour[-1]
        known = near[at][near[at] >= 0]
        unseen = known[left[known]]
        if not len(unseen):
            row = rows.where(F.col("file") == at).orderBy("dist", "other").select("other").toArrow()["other"].to_numpy()
            unseen = row[left[row]]
        tour.append(int(unseen[0]))
        left[tour[-1]] = False
    return tour


def ordering(dist: DataFrame, start: int = 0, nearest: int = NEAREST) -> DataFrame:
    """``(pos, file_idx)``"""
    return dist.sparkSession.createDataFrame(list(enumerate(greedy_tour(dist, start, nearest))), "pos long, file_idx long")


def steps(order: DataFrame, dist: DataFrame) -> DataFrame:
    """``(pos, file_idx, step)``: each file with the distance from the one before it, but the first."""
    before = order.withColumn("last", F.lag("file_idx").over(Window.orderBy("pos"))).where("last is not null")
    ends = before.withColumn("i", F.greatest("file_idx", "last")).withColumn("j", F.least("file_idx", "last"))
    return ends.join(dist, ["i", "j"]).select("pos", "file_idx", F.col("dist").alias("step"))


def tour_statistics(order: DataFrame, dist: DataFrame) -> DataFrame:
    """One row ``(length, mean_step)``; the mean is null for fewer than two files."""
    return steps(order, dist).agg(F.coalesce(F.sum("step"), F.lit(0)).alias("length"), F.try_divide(F.sum("step"), F.count("*")).alias("mean_step"))


def ordered_files(order: DataFrame, files: DataFrame) -> DataFrame:
    """``(pos, file, taxid)``"""
    return order.join(files, "file_idx").select("pos", "file", "taxid")
