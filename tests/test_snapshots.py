"""Tables are replaced as one, also by what is computed from them."""

import os

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.operators.index import Index
from tessera.sources import snapshots


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/it"


def numbers(spark, n):
    return spark.range(n).select(F.col("id").alias("n"))


def test_a_version_replaces_the_one_it_is_computed_from(spark, path):
    first = snapshots.commit(spark, path, {"n": numbers(spark, 5), "same": numbers(spark, 2)}, {"k": 1})
    held = first.table("n")
    second = snapshots.commit(spark, path, {"n": first.table("n").union(numbers(spark, 3)), "same": first.folders["same"]}, {"k": 2}, "overwrite")
    assert second.version == 2 and second.folders["same"] == first.folders["same"]
    assert snapshots.opened(spark, path).table("n").count() == 8 and snapshots.opened(spark, path).properties == {"k": 2}
    assert held.count() == 5 and snapshots.opened(spark, path, 1).table("n").count() == 5
    with pytest.raises(FileExistsError):
        snapshots.commit(spark, path, {"n": numbers(spark, 1)})
    with pytest.raises(ValueError, match="mode"):
        snapshots.commit(spark, path, {"n": numbers(spark, 1)}, mode="append")
    assert snapshots.vacuum(spark, path) == [first.folders["n"]]
    assert snapshots.versions(spark, path) == [2] and snapshots.opened(spark, path).table("same").count() == 2


def test_a_save_that_fails_leaves_the_version_before(spark, path):
    snapshots.commit(spark, path, {"n": numbers(spark, 5)})
    with pytest.raises(Exception, match="not today"):
        snapshots.commit(spark, path, {"n": numbers(spark, 3).withColumn("x", F.raise_error(F.lit("not today")))}, mode="overwrite")
    assert snapshots.versions(spark, path) == [1] and snapshots.opened(spark, path).table("n").count() == 5
    assert len(snapshots.vacuum(spark, path)) == 1  # what the failed save left
    with pytest.raises(FileNotFoundError):
        snapshots.opened(spark, f"{path}-other")
    with pytest.raises(ValueError, match="one version"):
        snapshots.vacuum(spark, path, 0)


def test_one_of_two_writers_is_refused(spark, path, monkeypatch):
    snapshots.commit(spark, path, {"n": numbers(spark, 1)})
    known = snapshots.versions
    monkeypatch.setattr(snapshots, "versions", lambda *a: known(*a)[:-1] or [0])  # what a writer sees that began before the last version
    with pytest.raises(snapshots.VersionConflict):
        snapshots.commit(spark, path, {"n": numbers(spark, 9)}, mode="overwrite")
    monkeypatch.undo()
    assert snapshots.opened(spark, path).table("n").count() == 1


def test_a_manifest_that_is_being_written_is_no_version(spark, path):
    snapshots.commit(spark, path, {"n": numbers(spark, 4)})
    with open(f"{path[7:]}/_versions/00000002.json", "w") as f:
        f.write('{"folders": {"n"')
    assert snapshots.opened(spark, path).version == 1
    assert snapshots.commit(spark, path, {"n": numbers(spark, 6)}, mode="overwrite").version == 3


def test_an_index_is_changed_in_its_own_place(spark, path):
    files = spark.createDataFrame([(0, "a", 1), (1, "b", 2)], "file_idx int, file string, taxid long")
    records = spark.createDataFrame([(0, "ACGTTGCAATCGGATA"), (1, "TTTACGGACCA")], "file_idx int, seq string")
    Index.build(records, files, 5, None).save(path)
    before = Index.load(spark, path)
    want = sorted(map(tuple, before.postings.collect()))
    before.with_taxid("b", 7).save(path, "overwrite")
    after = Index.load(spark, path)
    assert sorted(map(tuple, after.files.select("file", "taxid").collect())) == [("a", 1), ("b", 7)]
    assert after.stored.folders["lists"] == before.stored.folders["lists"] and sorted(map(tuple, after.postings.collect())) == want
    after.lossy(1).save(path, "overwrite")
    assert sorted(map(tuple, Index.load(spark, path, 1).postings.collect())) == want and Index.load(spark, path).stored.version == 3
    with pytest.raises(FileExistsError):
        after.save(path)


def test_a_matrix_is_extended_in_its_own_place(spark, tmp_path):
    """Both commands with the same output, as by default."""
    (tmp_path / "seqs").mkdir()
    for name, seq in (("a", "ACGTTGCAATCGG"), ("b", "TTTACGGACCA"), ("c", "GGGACCATTACG")):
        (tmp_path / "seqs" / f"{name}.fna").write_text(f">{name}\n{seq}\n")
    (tmp_path / "old").write_text("a.fna\t1\nb.fna\t2\n")
    (tmp_path / "new").write_text("c.fna\t3\n")
    here = os.getcwd()
    os.chdir(tmp_path)
    try:
        t = f"file://{tmp_path}"
        cli.main(["pairwise-distances", f"{t}/old", f"{t}/seqs", "-k", "5", "-s", "5", "-o", t])
        cli.main(["extend-distances", f"{t}/pd", f"{t}/new", f"{t}/seqs", f"{t}/seqs", "-k", "5", "-s", "5", "-o", t])
        cli.main(["pairwise-distances", f"{t}/all", f"{t}/seqs", "-k", "5", "-s", "5", "-o", f"{t}/x.pd"]) if (tmp_path / "all").write_text("a.fna\t1\nb.fna\t2\nc.fna\t3\n") else None
    finally:
        os.chdir(here)
    found, whole = (snapshots.opened(spark, f"{t}/{p}").table("distances") for p in ("pd", "x.pd"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect())) and found.count() == 6
