"""Set algebra of k-mer sets: intersections, distances, similarities."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators import packed as pk
from tessera.operators import parts as ps
from tessera.operators.components import breadth_first, connected_components
from tessera.operators.index import inverted
from tessera.plans.shared import if_small, written


#: Files of one side of a tile.
TILE = 256
#: Files of a list, in all and for each tile that it may touch, from which tiles take it.
LONG, PER_TILE = 64, 16
#: Lists that are multiplied at once, and tiles of sums that a task holds before it passes them on.
TILE_LISTS, HELD = 512, 64
#: Ids of files that are broadcast at most; files and k-mers of a block of similar sets.
BROADCAST_IDS, BLOCK_FILES, BLOCK_KMERS = 1 << 22, 256, 1 << 20


def intersections(postings: DataFrame, file_col: str = "file_idx", from_file: int | None = None, long: int = LONG) -> DataFrame:
    """``(i, j, shared)`` for pairs i > j that share a k-mer; with ``from_file``, only rows i >= it.

    The postings are shuffled once, to their lists. Lists that many k-mers share count once, with
    the number of these k-mers as weight. Short lists give their pairs. A long list would give the
    square of its length; such lists are bits of tiles of files by lists, whose products add up
    pairs, so their work is bounded by tiles. Tiles are of 256 by 256 files.
    """
    lists = inverted(postings, file_col).where(F.size("files") > 1).groupBy("files").agg(F.count("*").alias("weight"))
    lists = written(lists, "lists")  # both ways read them
    touched = F.floor(F.element_at("files", -1) / TILE) - F.floor(F.element_at("files", 1) / TILE) + 1
    dense = (F.size("files") >= long) & (F.size("files") >= PER_TILE * touched)
    firsts = lists.where(~dense).select("weight", "files", F.posexplode("files").alias("at", "i")).where("at > 0")
    if from_file is not None:
        firsts = firsts.where(F.col("i") >= from_file)
    both = firsts.select("i", F.explode(F.slice("files", F.lit(1), F.col("at"))).alias("j"), "weight")
    return both.unionByName(_tiled(lists.where(dense), postings.schema[file_col].dataType, from_file)).groupBy("i", "j").agg(F.sum("weight").alias("shared"))


def _tiled(lists: DataFrame, kind: T.DataType, from_file: int | None) -> DataFrame:
    """``(i, j, weight)`` of long lists, added up by each task as far as it holds tiles."""

    def multiply(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sums: dict[tuple[int, int], object] = {}

        def passed() -> pa.RecordBatch:
            parts = []
            for (x, y), held in sums.items():
                i, j = np.nonzero(np.tril(held, -1) if x == y else held)
                parts.append((i + x * TILE, j + y * TILE, held[i, j].astype(np.int64)))
            sums.clear()
            i, j, n = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.empty(0, np.int64)] * 3
            keep = i >= from_file if from_file is not None else np.ones(len(i), bool)
            return pa.RecordBatch.from_arrays([pa.array(i[keep], arrow), pa.array(j[keep], arrow), pa.array(n[keep])], names=["i", "j", "weight"])

        for batch in source:
            for at in range(0, batch.num_rows, TILE_LISTS):
                files, weights = (c.slice(at, TILE_LISTS) for c in batch.columns)
                row, file = files.value_parent_indices().to_numpy(), files.flatten().to_numpy().astype(np.int64)
                root = np.sqrt(weights.to_numpy().astype(np.float64))
                tiles = {}
                for t in np.unique(file // TILE).tolist():
                    here = file // TILE == t
                    tiles[t] = np.zeros((len(files), TILE))
                    tiles[t][row[here], file[here] % TILE] = root[row[here]]
                for x, bits in tiles.items():
                    if from_file is not None and (x + 1) * TILE <= from_file:
                        continue
                    for y in tiles:
                        if y <= x:
                            made = np.rint(bits.T @ tiles[y])  # sums of whole weights, below 2^53
                            sums[x, y] = sums[x, y] + made if (x, y) in sums else made
                            if len(sums) >= HELD:
                                yield passed()
        if sums:
            yield passed()

    arrow = to_arrow_type(kind)
    schema = T.StructType([T.StructField("i", kind), T.StructField("j", kind), T.StructField("weight", T.LongType())])
    return lists.select("files", "weight").mapInArrow(multiply, schema)


def pairs(postings: DataFrame | pk.Packed, files: DataFrame, file_col: str = "file_idx", from_file: int | None = None) -> DataFrame:
    """The lower triangle with diagonal: ``(i, j, n_i, n_j, shared)``.

    The result itself is all pairs of files by definition; the file table, not the k-mers,
    is paired for it. Files without k-mers take part. Packed postings of no more files than a matrix
    holds are multiplied where they are stored; only sums are shuffled.
    """
    counted = None
    if isinstance(postings, pk.Packed):
        ids = [r[0] for r in files.select(file_col).where(F.col(file_col).isNotNull()).distinct().limit(pk.MATRIX + 1).collect()]
        if len(ids) <= pk.MATRIX:
            counted = written(pk.products(postings.stored, postings.k, postings.kind, ids, from_file), "products")
        else:
            postings = postings.rows.join(files.select(file_col).distinct(), file_col, "left_semi")
    if counted is None:
        shared, sizes = intersections(postings, file_col, from_file), postings.groupBy(file_col).agg(F.count("*").alias("n"))
    else:
        shared, sizes = counted.where("i <> j"), counted.where("i = j").select(F.col("i").alias(file_col), F.col("shared").alias("n"))
    sizes = files.select(file_col).join(sizes, file_col, "left").na.fill(0, ["n"])
    left = sizes.select(F.col(file_col).alias("i"), F.col("n").alias("n_i"))
    if from_file is not None:
        left = left.where(F.col("i") >= from_file)
    grid = left.join(sizes.select(F.col(file_col).alias("j"), F.col("n").alias("n_j")), F.col("i") >= F.col("j"))
    found = grid.join(shared, ["i", "j"], "left")
    return found.select("i", "j", "n_i", "n_j", F.when(F.col("i") == F.col("j"), F.col("n_i")).otherwise(F.coalesce("shared", F.lit(0))).alias("shared"))


def distances(postings: DataFrame | pk.Packed, files: DataFrame, file_col: str = "file_idx", from_file: int | None = None) -> DataFrame:
    """``(i, j, dist)``: sizes of symmetric differences."""
    return pairs(postings, files, file_col, from_file).select("i", "j", (F.col("n_i") + F.col("n_j") - 2 * F.col("shared")).alias("dist"))


def extended(old: DataFrame, postings: DataFrame | pk.Packed, files: DataFrame, n_old: int, file_col: str = "file_idx") -> DataFrame:
    """The old rows as they are, and rows for files from ``n_old`` on."""
    return old.select("i", "j", "dist").unionByName(distances(postings, files, file_col, n_old))


def ragged(dist: DataFrame) -> DataFrame:
    """``(i, row)``, the distances to 0..i in order."""
    return dist.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "dist"))).alias("r")).select("i", F.col("r.dist").alias("row"))


def similarities(postings: DataFrame | pk.Packed, files: DataFrame, file_col: str = "file_idx") -> DataFrame:
    """``(i, j, shared, united, jaccard)``; null for two empty sets, 1 on the diagonal."""
    united = F.col("n_i") + F.col("n_j") - F.col("shared")
    value = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.try_divide(F.col("shared"), united))
    return pairs(postings, files, file_col).select("i", "j", "shared", united.alias("united"), value.alias("jaccard"))


def same_sets(marked: DataFrame) -> DataFrame:
    """``(file, n, one)``: the number of k-mers of each file, and the least file with the same ones, by 128 bits of their hashes."""
    found = marked.where("slice is null").select("file", "n", "a", "b")
    least = found.groupBy("n", "a", "b").agg(F.min("file").alias("one"))
    return found.join(least, ["n", "a", "b"]).select("file", "n", "one")


def _as_sets(postings: DataFrame | ps.Sets, file_col: str) -> ps.Sets:
    if isinstance(postings, ps.Sets):
        return postings
    found = ps.of_postings(postings, file_col)
    return ps.Sets(written(found.rows, "sets"), found.read)


def similar_candidates(postings: DataFrame | ps.Sets, least: float, file_col: str = "file_idx") -> DataFrame:
    """``(i, j)``, i > j: pairs that may have Jaccard >= ``least``, among them all that do."""
    return _candidates(_as_sets(postings, file_col), least)[0].select("i", "j")


def _candidates(sets: ps.Sets, least: float, marked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The candidates ``(i, j)``, and ``(file, n, bits, packed)`` of their sets.

    Parts of sets that are equal meet by signatures (``parts``). Pairs whose sizes, or whose bitmaps of
    parity, differ by more than the sets may are left out.
    """
    if not 0 < least <= 1:
        raise ValueError("the least similarity is above 0 and 1 at most")
    kind = sets.rows.schema[0].dataType
    rare = ps.weights(written(ps.marks(sets, kind), "marks") if marked is None else marked)
    stored = written(ps.entries(sets, least, rare), "entries")
    agree = ps.met(stored).groupBy("x", "y").agg(F.sum("n").alias("n"), F.max("code").alias("code")).where(F.col("n") >= F.pow(F.lit(2), F.col("code")))
    pairs = written(agree.select(F.greatest("x", "y").cast(kind).alias("i"), F.least("x", "y").cast(kind).alias("j")).distinct(), "met")
    asked = pairs.select(F.col("i").alias("file")).union(pairs.select(F.col("j").alias("file"))).distinct()
    held = written(ps.contents(ps.Sets(sets.rows.join(if_small(asked, BROADCAST_IDS), "file", "left_semi"), sets.read), kind), "contents")

    def close(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in source:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("bits_i", "bits_j"))
                a, b = batch.column("n_i").to_numpy(), batch.column("n_j").to_numpy()
                kept = np.bitwise_count(x ^ y).sum(1) <= (a + b) * (1 - least) / (1 + least) + 1e-6
                kept &= np.minimum(a, b) >= least * np.maximum(a, b) - 1e-6
                yield batch.select(["i", "j"]).filter(pa.array(kept))

    for x in ("i", "j"):
        pairs = pairs.join(if_small(held.select(F.col("file").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))), x)
    pair = T.StructType([T.StructField("i", kind), T.StructField("j", kind)])
    return pairs.select("i", "j", "n_i", "n_j", "bits_i", "bits_j").mapInArrow(close, pair), held


def _counted(asked: DataFrame, held: DataFrame, least: float, kind: T.DataType) -> DataFrame:
    """``(i, j, shared, jaccard)`` of candidates that are similar.

    Files that share their least partner are dealt to blocks, and pairs to tiles of two blocks, so that
    a set is moved once for each of its tiles, not for each of its pairs; a task's group holds a few tiles.
    """
    ends = asked.select(F.col("i").alias("file"), "j").union(asked.select(F.col("j"), F.col("j")))
    sized = held.select("file", "n")
    near = ends.groupBy("file").agg(F.min("j").alias("lead")).join(sized, "file")
    blocks = near.groupBy("lead").agg(F.greatest(F.ceil(F.count("*") / BLOCK_FILES), F.ceil(F.sum("n") / BLOCK_KMERS)).alias("blocks"))
    near = written(near.join(blocks, "lead").select("file", "n", F.xxhash64("lead", F.pmod(F.xxhash64(F.lit(5), "file"), F.col("blocks"))).alias("block")), "blocks")
    total = near.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-total // BLOCK_KMERS))
    side = lambda x: near.select(F.col("file").alias(x), F.col("block").alias(f"block_{x}"))
    tiled = asked.join(side("i"), "i").join(side("j"), "j")
    tiled = written(tiled.select("i", "j", F.pmod(F.xxhash64("block_i", "block_j"), F.lit(groups)).alias("group")), "tiles")
    moved = tiled.select(F.col("group").alias("lot"), F.col("i").alias("file")).union(tiled.select("group", "j")).distinct().join(held.select("file", "n", "packed"), "file")

    def count(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        import numpy as np

        known = {f: (p, n) for f, p, n in zip(*(sets.column(c).to_pylist() for c in ("file", "packed", "n")), strict=True)}
        opened: dict = {}

        def kmers(file):
            if file not in opened:
                opened[file] = ps.unpack_set(*known[file])
            return opened[file]

        pairs = pairs.select(["i", "j"]).sort_by("i")
        i, j = pairs.column("i").to_pylist(), pairs.column("j").to_pylist()
        shared, jaccard, at = [], [], 0
        while at < len(i):
            mine, end, size = kmers(i[at]), at, 0
            while end < len(i) and i[end] == i[at] and size < 1 << 22:
                size += known[j[end]][1]
                end += 1
            others = [kmers(x) for x in j[at:end]]
            begins = np.cumsum([0] + [len(x) for x in others[:-1]])
            every = np.concatenate(others)
            there = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            for n, other in zip(np.add.reduceat(there.astype(np.int64), begins).tolist(), others, strict=True):
                shared.append(n)
                jaccard.append(n / (len(mine) + len(other) - n))
            at = end
        made = pairs.combine_chunks().append_column("shared", pa.array(shared, pa.int64())).append_column("jaccard", pa.array(jaccard, pa.float64()))
        return made.filter(pa.array([x >= least for x in jaccard], pa.bool_()))

    schema = T.StructType([T.StructField("i", kind), T.StructField("j", kind), T.StructField("shared", T.LongType()), T.StructField("jaccard", T.DoubleType())])
    return tiled.groupBy("group").cogroup(moved.groupBy("lot")).applyInArrow(count, schema)


def similar_pairs(postings: DataFrame | ps.Sets, least: float, file_col: str = "file_idx") -> DataFrame:
    """``(i, j, shared, jaccard)``, i > j, of pairs with Jaccard >= ``least``: candidates, counted exactly.

    Files of equal sets are one until their pairs are known.
    """
    sets = _as_sets(postings, file_col)
    kind = sets.rows.schema[0].dataType
    marked = written(ps.marks(sets, kind), "marks")
    of = written(same_sets(marked), "same")
    ones = of.where(F.col("file") == F.col("one")).select("file")
    asked, held = _candidates(ps.Sets(sets.rows.join(if_small(ones, BROADCAST_IDS), "file", "left_semi"), sets.read), least, marked)
    found = written(_counted(written(asked, "candidates"), held, least, kind), "found")
    member = lambda name, one: of.select(F.col("file").alias(name), F.col("one").alias(one))
    apart = found.select(F.col("i").alias("p"), F.col("j").alias("q"), "shared", "jaccard").join(member("x", "p"), "p").join(member("y", "q"), "q")
    apart = apart.select(F.greatest("x", "y").alias("i"), F.least("x", "y").alias("j"), "shared", "jaccard")
    alike = of.select(F.col("file").alias("i"), "one", "n").join(member("j", "one"), "one").where("i > j")
    return apart.unionByName(alike.select("i", "j", F.col("n").alias("shared"), F.lit(1.0).alias("jaccard")))


def similar_groups(postings: DataFrame, files: DataFrame, least: float, file_col: str = "file_idx") -> DataFrame:
    """``(file_col, component)``: components of the graph of pairs with Jaccard >= ``least``."""
    if least <= 0:
        return files.select(file_col).withColumn("component", F.lit(files.agg(F.min(file_col)).first()[0]))
    edges = similar_pairs(postings, least, file_col).select(F.col("i").alias("u"), F.col("j").alias("v"))
    found = connected_components(edges).withColumnRenamed("node", file_col)
    return files.select(file_col).join(found, file_col, "left").select(file_col, F.coalesce("component", file_col).alias("component"))


def similar_groups_in_order(postings: DataFrame, files: DataFrame, least: float, file_col: str = "file_idx") -> DataFrame:
    """``(component, pos, file_col, level, parent)``: the members of each component breadth first from its least one."""
    edges = written(similar_pairs(postings, least, file_col).select(F.col("i").alias("u"), F.col("j").alias("v")), "edges") if least > 0 else None
    if edges is None:
        raise ValueError("the least similarity is above 0")
    found = breadth_first(edges).withColumnRenamed("node", file_col)
    alone = files.select(file_col).distinct().join(found, file_col, "left_anti")
    return found.unionByName(alone.select(F.col(file_col).alias("component"), F.lit(0).cast("long").alias("pos"), file_col, F.lit(0).alias("level"), F.lit(None).cast(files.schema[file_col].dataType).alias("parent")))
