"""Approximate nearest neighbours by additive quantisation.

1. A vector is approximated by the sum of one word from each of several codebooks, whose
   words have the full dimension. The codebooks start from k-means on residuals and are
   refined by least squares over the codes; they are fitted on at most SAMPLE rows, taken
   in the order of a hash of their ids, less their medians and in units of their spread, so
   neither an offset nor very large or small numbers blur the codes. Every row is encoded by
   a beam search and stored with the squared norm of its approximation.
2. Rows with one vector become one, with its ``k + 1`` least ids, so copies neither crowd
   others out nor cost more than one.
3. A query scores a block of codes by table lookups, |x'|^2 - 2 sum_m <q, c_m>. Blocks hold
   codes, norms and digests only, and are dealt by hash, so of the best of all a block has its
   share and a margin of six standard deviations. The best of all blocks are the query's
   shortlist. Unless a length is given, it is measured: for PROBES queries the exact neighbours
   are found among all rows, equal distances by id, and the shortlist is as long as the places that
   RECALL of them take by their codes, behind rows of equal codes, and half as long again. No size
   bounds it; a length of the number of rows makes the search exact.
4. The shortlists are joined to the vectors and ranked by exact distances in double
   precision; the vectors that stay are expanded to their ids.

Queries and codes meet in tasks of at most BLOCK_ROWS codes and BLOCK_QUERIES queries,
whatever the numbers of rows.

Defined cases: vectors that are null, zero, of another length than most fitted ones, or
with null or non-finite components take no part, neither as queries nor as candidates; a
null id takes no part; of query rows with one id the one whose vector has the least digest
is taken; a row is no candidate for a query of its own id; repeated rows are one candidate,
rows with one id and other vectors are candidates of their own; ties go to smaller ids; too
few candidates give fewer rows; an empty table gives an empty one; other columns are read
by ``is_query`` only. Vectors may be of any length that a row can hold.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.shared import written

SAMPLE = 16_384
CODEWORDS, BEAM = 64, 4
#: Codebooks for each two dimensions: one, within these bounds.
FEWEST_BOOKS, MOST_BOOKS = 8, 64
#: Codes and queries of one task at most, and rows that the kernels take at once.
BLOCK_ROWS, BLOCK_QUERIES, CHUNK = 1 << 17, 1 << 14, 1024
#: Queries whose exact neighbours are found to measure the shortlist, and the share of these that it must hold.
PROBES, RECALL = 64, 0.98
#: Bound of shifted components: squares stay within floats of 32 bits.
FARTHEST = 1e15
#: Stands for no other id.
OWN = (1 << 63) - 1


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class Quantiser:
    """Codebooks of shape (books, words, dimension), for vectors less ``centre``, in units of ``scale``."""

    books: object
    centre: object = 0.0
    scale: float = 1.0

    @property
    def dimension(self) -> int:
        return self.books.shape[2]

    def shifted(self, x):
        """Vectors as the codebooks take them; differences keep their order."""
        import numpy as np

        return np.clip((x - self.centre) / self.scale, -FARTHEST, FARTHEST)

    def encode(self, x, beam: int = BEAM):
        """Codes (n, books) of the best sums that a beam search finds."""
        import numpy as np

        return np.concatenate([self._encoded(x[i : i + CHUNK], beam) for i in range(0, len(x), CHUNK)]) if len(x) else np.zeros((0, len(self.books)), np.uint8)

    def _encoded(self, x, beam: int):
        import numpy as np

        n = len(x)
        left = x[:, None, :].astype(np.float32)  # residuals of the partial sums kept for each row
        error = (left**2).sum(2)  # of the residual itself, so near words are told apart however far the first ones were
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in self.books.astype(np.float32):
            flat = (error[:, :, None] - 2 * left @ book.T + (book**2).sum(1)).reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            parent, word = best // len(book), best % len(book)
            left = np.take_along_axis(left, parent[:, :, None], 1) - book[word]
            error = (left**2).sum(2)
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        return codes[np.arange(n), error.argmin(1)]

    def decode(self, codes):
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))


def _sums(x, labels, n: int):
    """Sums of the rows of ``x`` by label, and the numbers of rows."""
    import numpy as np

    order, counts = np.argsort(labels, kind="stable"), np.bincount(labels, minlength=n)
    found = np.zeros((n, x.shape[1]), x.dtype)
    begins = np.cumsum(counts) - counts
    found[counts > 0] = np.add.reduceat(x[order], begins[counts > 0], axis=0)
    return found, counts


def fit(x, codebooks: int | None = None, codewords: int = CODEWORDS, rounds: int = 2, seed: int = 5) -> Quantiser:
    """Codebooks for the rows of ``x``: residual k-means, then least squares over the codes."""
    import numpy as np

    rnd = np.random.Generator(np.random.PCG64(seed))
    codebooks = codebooks or min(MOST_BOOKS, max(FEWEST_BOOKS, x.shape[1] // 2))
    words = max(1, min(codewords, len(x)))
    left, books = x.astype(np.float32), []
    for _ in range(codebooks):
        book = left[rnd.choice(len(left), words, replace=False)].copy()
        for _ in range(8):
            sums, n = _sums(left, ((book**2).sum(1) - 2 * left @ book.T).argmin(1), words)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
        left = left - book[((book**2).sum(1) - 2 * left @ book.T).argmin(1)]
        books.append(book)
    found = Quantiser(np.array(books, np.float64))
    for _ in range(rounds):
        codes = found.encode(x).astype(np.int64)
        gram, right = np.zeros((codebooks, words, codebooks, words)), np.zeros((codebooks, words, x.shape[1]))
        for m in range(codebooks):
            right[m] = _sums(x, codes[:, m], words)[0]
            for other in range(m + 1):
                both = np.bincount(codes[:, m] * words + codes[:, other], minlength=words * words).reshape(words, words)
                gram[m, :, other], gram[other, :, m] = both, both.T
        size = codebooks * words
        solved = np.linalg.solve(gram.reshape(size, size) + 1e-3 * np.eye(size), right.reshape(size, -1) + 1e-3 * found.books.reshape(size, -1))
        found = Quantiser(solved.reshape(codebooks, words, -1))
    return found


def fit_on(vectors: DataFrame, id_col: str, vector_col: str, sample: int = SAMPLE) -> Quantiser | None:
    """The quantiser of a bounded sample; None where no vector is usable."""
    import numpy as np

    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col, F.xxhash64(vector_col)).limit(sample).select(vector_col).toArrow()
    lists = rows.column(0).to_pylist()
    if not lists:
        return None
    sizes = [len(v) for v in lists]
    width = max(set(sizes), key=lambda n: (sizes.count(n), n)) if len(set(sizes)) > 1 else sizes[0]
    x = np.array([v for v in lists if len(v) == width], np.float64)
    centre = np.median(x, axis=0)
    spread = np.abs(x - centre).max(axis=1)
    scale = float(np.median(spread)) or float(spread.max()) or 1.0
    plain = Quantiser(None, centre, scale)
    return replace(plain, books=fit(plain.shifted(x)).books)


def index(vectors: DataFrame, quantiser: Quantiser, id_col: str, vector_col: str, is_query: Column) -> DataFrame:
    """``(id, asked, key, v, codes, norm)`` of every usable row: a digest of the vector, and the vector in its own precision."""
    width = quantiser.dimension
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) == width) & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asked"), F.col(vector_col).cast("array<double>").alias("v"))

    def batches(source):
        import numpy as np
        import xxhash

        for batch in source:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                kept = np.ascontiguousarray(x, "<f4" if single else "<f8")
                raw, first, of = np.unique(kept.view(np.dtype((np.void, kept.itemsize * width))).ravel(), return_index=True, return_inverse=True)
                codes = quantiser.encode(quantiser.shifted(x[first]))
                keys, norms = [xxhash.xxh3_128_digest(r.tobytes()) for r in raw], (quantiser.decode(codes) ** 2).sum(1)
                each = [pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("asked"), *(c.take(pa.array(of)) for c in each)], names=["id", "asked", "key", "v", "codes", "norm"])

    return rows.mapInArrow(batches, "id long, asked boolean, key binary, v binary, codes binary, norm double")


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str, rows: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def _searcher(quantiser: Quantiser, kind: str, most: int):
    """The ``most`` best rows of a block for each query, by lookup tables."""

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        import numpy as np

        made = []
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by("key")  # so that equal scores give the same rows again
            codes = np.ascontiguousarray(_matrix(rows.column("codes"), "u1", rows.num_rows).T).astype(np.intp)
            norms, n = rows.column("norm").to_numpy(), min(most, rows.num_rows)
            keys = rows.column("key").combine_chunks()
            for query, q in zip(queries.column("id").to_pylist(), quantiser.shifted(_matrix(queries.column("v"), kind, queries.num_rows).astype(np.float64)), strict=True):
                score = norms.copy()
                for table, code in zip(-2 * quantiser.books @ q, codes, strict=True):
                    score += table[code]
                near = np.argpartition(score, n - 1)[:n]
                made.append(pa.record_batch([pa.array(np.full(n, query)), keys.take(pa.array(near)), pa.array(score[near])], names=["query_id", "key", "near"]))
        kinds = pa.schema([("query_id", pa.int64()), ("key", pa.binary()), ("near", pa.float64())])
        return pa.Table.from_batches([b.cast(kinds) for b in made], kinds)

    return search


def _measured(pairs: DataFrame, kind: str) -> DataFrame:
    """``(query_id, key, score)`` of pairs with both vectors: Euclidean distances in double precision."""

    def batches(source):
        import numpy as np

        for batch in source:
            if batch.num_rows:
                a, b = (_matrix(batch.column(c), kind, batch.num_rows).astype(np.float64) for c in ("v", "q"))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("key"), pa.array(np.sqrt(((a - b) ** 2).sum(1)))], names=["query_id", "key", "score"])

    return pairs.select("query_id", "key", "v", "q").mapInArrow(batches, "query_id long, key binary, score double")


def needed(once: DataFrame, asked: DataFrame, quantiser: Quantiser, kind: str, k: int, probes: int = PROBES, recall: float = RECALL) -> int:
    """How long a shortlist must be to hold ``recall`` of the ``k`` exact neighbours of some queries.

    Two scans of all rows: one for the neighbours, of which a task passes on ``k`` a query, and one
    that counts for each neighbour how many rows do not come after it by their codes.
    """
    import numpy as np

    chosen = asked.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(probes).select("id", "v").toArrow()
    if not chosen.num_rows:
        return k
    ids, q = chosen.column("id").to_numpy(), _matrix(chosen.column("v"), kind, chosen.num_rows).astype(np.float64)
    near_q = quantiser.shifted(q)
    tables = -2 * np.einsum("mwd,qd->mqw", quantiser.books, near_q)

    def by_codes(batch):
        codes = _matrix(batch.column("codes"), "u1", batch.num_rows)
        found = np.repeat(batch.column("norm").to_numpy()[None], len(ids), 0)
        for table, code in zip(tables, codes.T, strict=True):
            found += table[:, code]
        return found

    def others(batch):
        """The least id of each row that is not the query's own; ``OWN`` where there is none."""
        ids_of = batch.column("ids").to_pylist()
        least = np.array([x[0] for x in ids_of], np.int64)
        after = np.array([x[1] if len(x) > 1 else OWN for x in ids_of], np.int64)
        return np.where(least[None] == ids[:, None], after[None], least[None])

    def neighbours(source):
        """``k`` of a task for each probe, by distances as the result has them, then id."""
        best = [np.empty((0, 3))] * len(ids)
        named = [np.empty(0, np.int64)] * len(ids)
        for batch in source:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), kind, batch.num_rows).astype(np.float64)
            x = quantiser.shifted(v)
            size = (x**2).sum(1)
            about, by, other = size[None] - 2 * near_q @ x.T, by_codes(batch), others(batch)
            about[other == OWN] = np.inf
            for p in range(len(ids)):
                few = np.flatnonzero(about[p] < np.inf)
                if len(few) > k:  # what rounding may have put behind the k-th is measured, too
                    bound = np.partition(about[p], k - 1)[k - 1]
                    few = few[about[p][few] <= bound + 1e-12 * (size[few] + (near_q[p] ** 2).sum())]
                exact = np.sqrt(((v[few] - q[p]) ** 2).sum(1))
                made = np.concatenate([best[p], np.stack([np.full(len(few), p), exact, by[p][few]], 1)])
                name = np.concatenate([named[p], other[p][few]])
                order = np.lexsort((name, made[:, 1]))[:k]
                best[p], named[p] = made[order], name[order]
        rows, names = np.concatenate(best), np.concatenate(named)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int64)), pa.array(rows[:, 1]), pa.array(names), pa.array(rows[:, 2])], names=["probe", "exact", "least", "near"])

    rows = once.select("v", "codes", "norm", "ids")
    place = F.row_number().over(Window.partitionBy("probe").orderBy("exact", "least"))
    true = rows.mapInArrow(neighbours, "probe long, exact double, least long, near double").withColumn("nth", place).where(F.col("nth") <= k).select("probe", "near").toArrow()
    probe, near = true.column("probe").to_numpy(), true.column("near").to_numpy()
    if not len(probe):
        return k

    def before(source):
        total = np.zeros(len(probe), np.int64)
        for batch in source:
            if batch.num_rows:
                score = np.sort(np.where(others(batch) != OWN, by_codes(batch), np.inf), axis=1)
                total += [np.searchsorted(score[p], s + 1e-9 * abs(s), side="right") for p, s in zip(probe, near, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(probe))), pa.array(total)], names=["nth", "n"])

    counted = rows.mapInArrow(before, "nth long, n long").groupBy("nth").agg(F.sum("n").alias("n")).toArrow()
    places = np.sort(counted.column("n").to_numpy())
    return int(1.5 * places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + k


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, shortlist: int | None = None
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each query, by distance, then id.

    ``shortlist`` is the number of distinct vectors that are ranked exactly for a query; by default it is measured.
    """
    spark = vectors.sparkSession
    quantiser = fit_on(vectors, id_col, vector_col)
    if quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    rows = written(index(vectors, quantiser, id_col, vector_col, is_query), "codes")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    ids = rows.select("key", "id").distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    once = written(rows.groupBy("key").agg(F.first("v").alias("v"), F.first("codes").alias("codes"), F.first("norm").alias("norm")).join(ids, "key"), "vectors")
    asked = written(rows.where("asked").groupBy("id").agg(F.min("key").alias("key")).join(once.select("key", "v"), "key"), "queries")

    n, m = once.count(), asked.count()
    block = min(block_rows, max(4096, -(-n // spark.sparkContext.defaultParallelism)))
    parts, lots = max(1, -(-n // block)), max(1, -(-m // block_queries))
    wanted = min(n, max(shortlist or needed(once, asked, quantiser, kind, k), k + 1))
    share = wanted / parts
    most = wanted if parts == 1 else min(wanted, int(share + 6 * share**0.5 + 9))
    upto = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
    dealt = lambda c, x, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(x)).cast("int")
    left = once.select("key", "codes", "norm", dealt("key", parts, 1).alias("part")).withColumn("lot", upto(lots))
    right = asked.select("id", "v", dealt("id", lots, 3).alias("lot")).withColumn("part", upto(parts))
    found = left.groupBy("part", "lot").cogroup(right.groupBy("part", "lot")).applyInArrow(_searcher(quantiser, kind, most), "query_id long, key binary, near double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("near", "key"))
    short = written(found.withColumn("nth", best).where(F.col("nth") <= wanted).select("query_id", "key"), "shortlists")

    others = ~((F.size("ids") == 1) & (F.col("ids")[0] == F.col("query_id")))  # of what only the query has, nothing is a candidate
    pairs = short.join(once.select("key", "v", "ids"), "key").where(others).select("query_id", "key", "v").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    place = F.rank().over(Window.partitionBy("query_id").orderBy("score"))
    kept = _measured(pairs, kind).withColumn("place", place).where(F.col("place") <= k).join(once.select("key", "ids"), "key")
    each = kept.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
