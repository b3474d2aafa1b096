import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.sources import formats as fm
from tessera.sources.snapshots import opened
from tessera.streaming.reads import classify_stream


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fna").write_text(">r1 first one\nACGT\nAC\n>r2\nGG\n")
    (tmp_path / "b.fa").write_text(">r3\r\nTT\r\n")
    (tmp_path / "c.txt").write_text(">no\nAA\n")
    (tmp_path / "d.FA").write_text(">no\nAA\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.fna").write_text(">no\nAA\n")
    rows = fm.read_fasta(spark, f"file://{tmp_path}").collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.at, r.id, r.desc, r.seq) for r in rows) == [("a.fna", 0, "r1", "first one", "ACGTAC"), ("a.fna", 22, "r2", None, "GG"), ("b.fa", 0, "r3", None, "TT")]
    assert fm.fasta_files(spark, f"file://{tmp_path}").count() == 2


def test_bad_records(spark, tmp_path):
    (tmp_path / "a.fna").write_text(">r1\nAC\n> \nGG\n>r3\nTT\n")
    read = lambda mode: sorted(r.id for r in fm.read_fasta(spark, f"file://{tmp_path}", mode).collect())
    assert read("DROP") == ["r1", "r3"]
    assert read("STOP") == ["r1"]
    with pytest.raises(Exception, match="bad FASTA record"):
        read("FAILFAST")
    (tmp_path / "x.fastq").write_text("@a b\nACGT\n+\n@@@@\n@c\nACG\n+\nII\n@d\nA\n+\nI\n")
    assert [(r.id, r.desc, r.seq, r.qual) for r in fm.read_fastq(spark, f"file://{tmp_path}/x.fastq").orderBy("at").collect()] == [("a", "b", "ACGT", "@@@@"), ("d", None, "A", "I")]


def test_taxid_lines(spark, tmp_path):
    (tmp_path / "t").write_text("name\ttaxid\na\t1\tmore\nb\nc\t-1\nd\t+7\ne\t 5 \nf\t99999999999999999999\n")
    assert [(r.line, r.id, r.taxid) for r in fm.read_taxids(spark, f"file://{tmp_path}/t").collect()] == [(1, "a", 1), (4, "d", 7)]


def test_output_path(spark, tmp_path):
    assert fm.output_path(spark, f"file://{tmp_path}", "db") == f"file://{tmp_path}/db"
    assert fm.output_path(spark, f"file://{tmp_path}/a.b", "split.db") == f"file://{tmp_path}/a.split.db"


def test_numbers_do_not_depend_on_blocks(spark, tmp_path):
    """Small blocks, so records and lines lie across them; a name with a blank and a plus."""
    (tmp_path / "in").mkdir()
    fasta = [(f"r{i}", "ACGT" * (i % 7) + "A" * (i % 3)) for i in range(300)]
    (tmp_path / "in" / "a b+c.fna").write_text("".join(f">{i}\n{s}\n" for i, s in fasta))
    (tmp_path / "in" / "z.fna").write_text(">last\nAC\n")
    reads = [(f"q{i}", "ACGT" * (1 + i % 9)) for i in range(300)]
    (tmp_path / "x.fastq").write_text("".join(f"@{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in reads) + "\n\n")
    (tmp_path / "t").write_text("".join(f"name{i}\t{i}\n" for i in range(500)))
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    earlier = [fm.read_fasta(spark, f"file://{tmp_path}/in/a*"), fm.read_fastq(spark, f"file://{tmp_path}/x.fastq", "FAILFAST")]
    spark.conf.set(key, "700")
    try:
        rows = fm.read_fasta(spark, f"file://{tmp_path}/in").collect()
        framed = fm.read_fastq(spark, f"file://{tmp_path}/x.fastq", "FAILFAST")
        assert fm._lines(spark.read, f"file://{tmp_path}/x.fastq").rdd.getNumPartitions() > 5
        assert [(r.id, r.seq) for r in sorted(framed.collect(), key=lambda r: r.at)] == reads
        assert [(r.line, r.id) for r in sorted(fm.read_taxids(spark, f"file://{tmp_path}/t").collect())] == [(i, f"name{i}") for i in range(500)]
        for made, want in zip(earlier, (fasta, reads), strict=True):  # files are split otherwise by now, as after the loss of an executor
            assert [(r.id, r.seq) for r in sorted(made.collect(), key=lambda r: r.at)] == want
    finally:
        spark.conf.set(key, before)
    assert [(r.id, r.seq) for r in sorted((r for r in rows if r.file.endswith("/a b+c.fna")), key=lambda r: r.at)] == fasta
    assert [(r.at, r.id) for r in rows if r.file.endswith("/z.fna")] == [(0, "last")]


def test_a_listed_file_that_is_missing_is_an_error(spark, tmp_path):
    (tmp_path / "seqs").mkdir()
    (tmp_path / "seqs" / "a b.fna").write_text(">a\nACGTTGCAAC\n")
    (tmp_path / "seqs" / "empty.fna").write_text("")
    t = f"file://{tmp_path}"
    (tmp_path / "f2t").write_text("a b.fna\t1\nempty.fna\t2\n")
    cli.main(["build", f"{t}/f2t", f"{t}/seqs", "-o", f"{t}/ok", "-k", "5", "-s", "5"])
    from tessera.operators.index import Index

    assert [(r.file, r.n_kmers) for r in Index.load(spark, f"{t}/ok.db").files.orderBy("file_idx").collect()] == [("a b.fna", 4), ("empty.fna", 0)]
    (tmp_path / "f2t").write_text("a b.fna\t1\ngone.fna\t2\n")
    with pytest.raises(FileNotFoundError, match="gone.fna"):
        cli.main(["build", f"{t}/f2t", f"{t}/seqs", "-o", f"{t}/bad", "-k", "5", "-s", "5"])


def test_mates_are_classified_apart(spark, tmp_path):
    import random

    from tessera.operators.classify import classify, statistics, throughput
    from tessera.operators.index import Index

    rnd = random.Random(4)
    genomes = ["".join(rnd.choice("ACGT") for _ in range(600)) for _ in range(2)]
    index = Index.build(spark.createDataFrame(list(enumerate(genomes)), "file_idx int, seq string"), spark.createDataFrame([(0, "f0", 10), (1, "f1", 11)], "file_idx int, file string, taxid long"), 9, None)
    (tmp_path / "r.fastq").write_text("".join(f"@frag {m}\n{g[50:150]}\n+\n{'I' * 100}\n" for m, g in enumerate(genomes)) + "@frag 2\nACG\n+\nIII\n")
    reads = fm.read_fastq(spark, f"file://{tmp_path}/r.fastq").select(F.col("id").alias("read_id"), "seq")
    for source in (reads, reads.repartition(3)):
        assert sorted(map(tuple, classify(source, index).collect())) == [("C", "frag", 10, "f0"), ("C", "frag", 11, "f1"), ("U", "frag", 0, "-")]
    rates = throughput(statistics(reads), 2).first()
    assert (rates.reads, rates.bases, rates.reads_per_second, round(rates.mbp_per_second * 1e6, 6)) == (3, 203, 1.5, 101.5)


def test_commands(spark, tmp_path, monkeypatch):
    import random

    rnd = random.Random(3)
    genomes = {n: "".join(rnd.choice("ACGT") for _ in range(900)) for n in "abc"}
    (tmp_path / "seqs").mkdir()
    for n, g in genomes.items():
        (tmp_path / "seqs" / f"{n}.fna").write_text(f">{n}\n{g}\n")
    (tmp_path / "map").write_text("a\t5\nb\t6\nc\t7\n")
    (tmp_path / "reads.fastq").write_text("".join(f"@{n}\n{g[100:190]}\n+\n{'I' * 90}\n" for n, g in genomes.items()))
    for folder in ("o1", "out", "chop"):
        (tmp_path / folder).mkdir()
    t = f"file://{tmp_path}"
    cli.main(["file2taxid", f"{t}/seqs", "--map", f"{t}/map", "-o", f"{t}/o1", "-k", "11"])
    cli.main(["pairwise-distances", f"{t}/o1/f2t", f"{t}/seqs", "-o", f"{t}/pd", "-k", "11", "-s", "7"])
    cli.main(["order", f"{t}/pd.pd", "-o", f"{t}/tour"])
    cli.main(["build", f"{t}/tour.o.f2t", f"{t}/seqs", "-o", f"{t}/db", "-k", "11", "-s", "11"])
    cli.main(["classify", f"{t}/db.db", f"{t}/reads.fastq", "-o", f"{t}/out"])
    rows = {r.read_id: r.taxid for r in fm.read_classification(spark, f"{t}/out/r2f").collect()}
    assert rows == {"a": 5, "b": 6, "c": 7}
    cli.main(["build-lossy", "1", f"{t}/db.db", "-o", f"{t}/less"])
    assert opened(spark, f"{t}/less.cdb").table("files").count() == 3
    cli.main(["extend-distances", f"{t}/pd.pd", f"{t}/o1/f2t", f"{t}/seqs", f"{t}/seqs", "-o", f"{t}/pd2", "-k", "11", "-s", "7"])
    assert opened(spark, f"{t}/pd2.pd").table("distances").count() == 21
    cli.main(["chop-reads", f"{t}/reads.fastq", "--length", "10", "-o", f"{t}/chop"])
    assert {len(r.seq) for r in fm.read_fastq(spark, f"{t}/chop/chopped.fastq").collect()} == {10}


def test_split_files_are_found_again(spark, tmp_path):
    (tmp_path / "seqs").mkdir()
    (tmp_path / "seqs" / "a.fna").write_text(f">a\n{'ACGTTGCA' * 20}\n>b\nACGGT\n")
    (tmp_path / "seqs" / "c.fna").write_text(">c\nACGTTGCAAC\n")
    (tmp_path / "o").mkdir()
    t = f"file://{tmp_path}"
    cli.main(["file2taxid", f"{t}/seqs", "-o", f"{t}/o", "-k", "5", "--overlap", "10"])
    names = sorted(r.id for r in fm.read_taxids(spark, f"{t}/o/f2t").collect())
    assert names == ["c.fna", "split/a.0.0", "split/a.0.1", "split/a.0.2", "split/a.0.3", "split/a.1"]
    cli.main(["pairwise-distances", f"{t}/o/f2t", f"{t}/seqs", "--split", f"{t}/o/split", "-o", f"{t}/pd", "-k", "5", "-s", "5"])
    assert opened(spark, f"{t}/pd.pd").table("distances").where("i <> j").count() == 15
    index = fm.read_split_fasta(spark, f"{t}/o/split")
    assert sorted((r.file, len(r.seq)) for r in index.collect()) == [("split/a.0.0", 45), ("split/a.0.1", 50), ("split/a.0.2", 50), ("split/a.0.3", 45), ("split/a.1", 5)]


def test_stream_equals_batch(spark, tmp_path):
    from tessera.operators.classify import classify
    from tessera.operators.index import Index

    files = spark.createDataFrame([(0, "f", 3)], "file_idx int, file string, taxid long")
    index = Index.build(spark.createDataFrame([(0, "ACGTTGCAATCGGATACCGATTAGCATCGGACT")], "file_idx int, seq string"), files, 5, None)
    reads = spark.createDataFrame([(f"r{i}", "ACGTTGCAATCGGATACC"[i:]) for i in range(6)], "read_id string, seq string")
    reads.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    classify_stream(stream, index, f"file://{tmp_path}/out", f"file://{tmp_path}/mark", 2).awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, classify(reads, index, 2).collect()))


def test_split_query_numbers_records_as_its_sql(spark):
    from tessera.plans.queries import queries

    found = queries()["k3_split_fasta"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["file", "record_idx", "id", "desc", "seq"]
    assert {r["record_idx"] for r in found.select("record_idx").distinct().collect()} == {0}
