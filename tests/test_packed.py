"""Packed postings against plain sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import sequence as sq
from tessera.operators import distance as di
from tessera.operators import packed as pk
from tessera.operators import rle
from tessera.operators.index import Index, buckets_for, file_kmers
from tessera.operators.kmers import canonical_codes, kmers


@pytest.mark.parametrize("k", [3, 11, 16])
def test_postings_are_the_sets_of_files(spark, k, monkeypatch):
    monkeypatch.setattr(pk, "TAKEN", 7)
    rnd = np.random.default_rng(3)
    rows = [(i, "".join(rnd.choice(list("ACGTN"), n))) for i, n in ((-5, 300), (7, 40), (7, 200), (2**40, 90), (None, 50), (9, 2))]
    want = {(i, int(c)) for i, seq in rows for c in canonical_codes(seq.encode(), k, None)[1]}
    made = pk.packed(spark.createDataFrame(rows, "file_idx long, seq string").repartition(3), k)
    got = [tuple(r) for r in pk.postings(made, k, T.LongType()).collect()]
    assert len(got) == len(want) and set(got) == want
    sizes = {r["file_idx"]: (r["n_kmers"], r["total"]) for r in pk.sizes(made, k, T.LongType()).collect()}
    assert sizes == {i: (len(c), sum(c)) for i in {i for i, _ in want} for c in [[c for j, c in want if j == i]]}
    assert sum(r["n_files"] * r["n_kmers"] for r in pk.lengths(made, k).collect()) == len(want)


def test_postings_are_shuffled_once(spark):
    made = pk.lengths(pk.packed(spark.createDataFrame([(1, "ACGTACGTTTA")], "file_idx long, seq string"), 5), 5)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(part") == 1 and "hashpartitioning(kmer" not in plan


def test_long_lists_are_cut_where_blocks_are_certain():
    rnd = np.random.default_rng(1)
    sparse = np.flatnonzero(rnd.random(40_000) < 0.02)
    whole = rle.encode_lists(sparse, np.array([0, len(sparse)]))[0]
    assert rle.decode(whole) == sparse.tolist()
    assert rle.lossy(whole.tolist(), 2) == rle.lossy_lists(whole, np.array([0, len(whole)]), 2)[0].tolist()


def test_lossy_index_of_packed_postings_equals_that_of_lists(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, "".join(rnd.choice(list("ACGT"), 120))) for i in range(60)]
    records = spark.createDataFrame(rows, "file_idx long, seq string")
    files = spark.createDataFrame([(i, f"f{i}", 0) for i, _ in rows], "file_idx long, file string, taxid long")
    index = Index.build(records, files, 4, None)
    plain = Index(index.files, 4, None, index.total, pairs=index.pairs)
    for level in (1, 2, 3):
        a, b = index.lossy(level), plain.lossy(level)
        assert sorted(map(str, a.compressed.collect())) == sorted(map(str, b.compressed.collect()))
        assert sorted(map(str, a.files.collect())) == sorted(map(str, b.files.select(*a.files.columns).collect()))


def test_buckets_follow_postings():
    assert buckets_for(1000) == 8 and buckets_for(1000, 1 << 30) == 64


def test_pairs_of_packed_postings(spark):
    """Products of packed lists are the pairs of the plain ones, and texts are read as their letters."""
    rnd = random.Random(31)
    rows = [(3 * (n % 7) + 2 if n % 11 else None, "".join(rnd.choice("abcdefghij é.K\n") for _ in range(rnd.randrange(400)))) for n in range(60)]
    records = spark.createDataFrame(rows, "file_idx int, text string")
    files = spark.createDataFrame([(n,) for n in [*range(2, 23, 3), 40, 1]], "file_idx int")
    stored = pk.packed(records, 5, seq_col="text", prepare=sq.letters_as_bytes)
    held = pk.Packed(stored, 5, records.schema["file_idx"].dataType)
    plain = file_kmers(records.select("file_idx", sq.letters_as_bases(F.col("text")).alias("seq")), 5)
    for least in (None, 8):
        want = sorted(map(tuple, di.pairs(plain, files, from_file=least).collect()))
        assert sorted(map(tuple, di.pairs(held, files, from_file=least).collect())) == want
    few = files.where("file_idx < 9")
    assert sorted(map(tuple, di.pairs(held, few).collect())) == sorted(map(tuple, di.pairs(plain.where("file_idx < 9"), few).collect()))
    assert di.pairs(held, files.where("false")).count() == 0


def test_repeats_go_on_with_what_follows(spark, monkeypatch):
    """A task passes its postings on when they are many, not when most of them are repeats."""
    rows = [(n % 3, "ACGTTGCAAC" * 40) for n in range(200)]
    records = spark.createDataFrame(rows, "file_idx int, seq string").coalesce(1)
    monkeypatch.setattr(pk, "HELD", 2000)
    want = sorted({tuple(r) for r in kmers(records, ["file_idx"], "seq", 6).collect()})
    assert sorted(map(tuple, file_kmers(records, 6).collect())) == want


def test_a_packed_index_is_saved_as_it_lies(spark, tmp_path):
    """Postings are taken over, not made to lists, and reads find what they find in bucketed lists."""
    from tessera.operators import classify as cl

    rnd = random.Random(5)
    records = spark.createDataFrame([(f, "".join(rnd.choice("ACGT") for _ in range(1500))) for f in range(30)], "file_idx int, seq string")
    files = records.selectExpr("file_idx", "concat('f', file_idx) AS file", "CAST(1 AS long) AS taxid")
    index = Index.build(records, files, 6, None)
    reads = records.selectExpr("CAST(file_idx AS long) AS read_id", "substring(seq, 100, 300) AS seq").where("read_id < 9")
    index.save(f"file://{tmp_path}/db", packed=True), index.save(f"file://{tmp_path}/lists")
    again, lists = (Index.load(spark, f"file://{tmp_path}/{x}") for x in ("db", "lists"))
    assert again.lists is None and sorted(map(tuple, again.packed.collect())) == sorted(map(tuple, index.packed.collect()))
    assert sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, lists.postings.collect()))
    counted = cl.read_kmers(reads, 6)
    found = cl.index_hits(counted, again)
    want = sorted(map(tuple, cl.index_hits(counted, lists).collect()))
    assert want and sorted(map(tuple, found.select(cl.ROW, "file_idx", "x").collect())) == want
    changed = again.with_taxid("f3", 7)
    changed.save(f"file://{tmp_path}/db", "overwrite")
    last = Index.load(spark, f"file://{tmp_path}/db")
    assert last.stored.folders["packed"] == again.stored.folders["packed"] and last.files.where("taxid = 7").count() == 1
    with pytest.raises(ValueError, match="built"):
        index.lossy(1).save(f"file://{tmp_path}/thin", packed=True)


def test_files_of_shuffles_go_with_their_query(spark):
    from tessera.plans.shared import written

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: disk.getAllFiles().mkString("\n").count("/shuffle_")
    before = held()
    written(spark.range(1000).repartition(7).groupBy("id").count(), "freed")
    assert held() <= before
