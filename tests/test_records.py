"""FASTA and FASTQ by ranges of bytes, and files that grow."""

import random
import re

import pytest

from tessera.sources import formats as fm
from tessera.sources import records as rc


def in_ranges(path, length, parse=rc.fastq_records):
    made = []
    for part in rc.ranges([(f, 0, n) for f, n in rc.listed(str(path), None)], length):
        system, inner, _ = rc.opened(part.file)
        with system.open_input_file(inner) as source:
            made += [(part.file, *row) for row in parse(source, part)]
    return made


def messy(seed, n=120):
    """FASTQ text with what goes wrong, and the records that are whole in it."""
    rnd = random.Random(seed)
    text, good, before = ["no record\n\n"], [], 9
    for i in range(n):
        kind = rnd.randrange(9)
        if kind == 2 and before < 4:  # qualities left alone may be taken for a lost header
            kind = 5
        before = kind
        size = 2 * rnd.randrange(6, 35) + (kind == 0)  # so the line after lost qualities has another length
        seq, qual = ("".join(rnd.choice(letters) for _ in range(size)) for letters in ("ACGTN", "@+IA!>#"))
        if kind == 0:
            text.append(f"@r{i}\n{seq}\n+\n")  # lost qualities
        elif kind == 1:
            text.append(f"@r{i}\n+\n{qual}\n")  # lost sequence
        elif kind == 2:
            text.append(f"{seq}\n+\n{qual}\n")  # lost header
        elif kind == 3:
            text.append(f"@r{i}\n{seq}\n+\n{qual}x\n")  # too many qualities
        else:
            half, end = size // 2, rnd.choice(("\n", "\r\n"))
            folds = [(seq[:half], qual[:half]), (seq[half:], qual[half:])] if kind == 4 else [(seq, qual)]
            text.append("\n" * (kind == 5) + f"@r{i} d e{end}" + "".join(s + end for s, _ in folds) + f"+r{i}{end}" + "".join(q + end for _, q in folds))
            good.append((f"r{i}", "d e", seq, qual))
    return "".join(text), good


@pytest.mark.parametrize("seed", range(12))
def test_fastq_ranges(tmp_path, seed, monkeypatch):
    text, good = messy(seed)
    (tmp_path / "x.fastq").write_bytes(text.encode())
    monkeypatch.setattr(rc, "FETCH", 64)
    whole = in_ranges(tmp_path, 0)
    shown = [(r[2].decode(), r[3].decode(), r[4].decode(), r[6].decode()) for r in whole if not r[5]]
    assert shown == good
    for length in (1, 13, 100, 1000):
        try:
            assert in_ranges(tmp_path, length) == whole or [r for r in in_ranges(tmp_path, length) if not r[5]] == [r for r in whole if not r[5]]
        except ValueError as ambiguous:
            assert "split=false" in str(ambiguous)


def test_ranges_that_do_not_meet_are_an_error(tmp_path):
    """Folded qualities that look like a record: a range that starts within them cannot know."""
    text = "@a\nACGT\nACGT\nACGT\nACGT\n+\n@b12\nACGT\n+ab4\nIIII\n@c\nA\n+\nI\n"
    (tmp_path / "x.fastq").write_text(text)
    assert [r[2] for r in in_ranges(tmp_path, 0)] == [b"a", b"c"]
    with pytest.raises(ValueError, match="split=false"):
        in_ranges(tmp_path, 1)


@pytest.mark.parametrize("next_", ["@d7\nACGT\n+\n@III\n", "\r\n@d8\nAC\nGT\n+\n@I\n@I\n", "@d10\nAAC\n+\n@d7\nACGT\n+\n@III\n"])
def test_lost_qualities_as_long_as_the_next_head(tmp_path, next_):
    """The record that lost them goes alone, also where the one after it lost its own."""
    lost = f"@d5\n{'C' * len(next_.split(chr(10))[0])}\n+\n"
    (tmp_path / "x.fastq").write_bytes(f"@d1\nAC\n+\n@@\n{lost}{next_}@d9\nT\n+\n@".encode())
    good = ["d1", "d8" if "d8" in next_ else "d7", "d9"]
    whole = [r for r in in_ranges(tmp_path, 0) if not r[5]]
    assert [r[2].decode() for r in whole] == good
    for length in (1, 7, 20):
        assert [r for r in in_ranges(tmp_path, length) if not r[5]] == whole
    # qualities that look like a head stay, where no record follows from them or its id is of another kind
    (tmp_path / "x.fastq").write_bytes(b"@d1\nACG\n+\n@d7\n@d2\nACG\n+\n@II\nCC\n+\nII\n@d3\nACG\n+\n@d4")
    assert [r[2].decode() for r in in_ranges(tmp_path, 0) if not r[5]] == ["d1", "d2", "d3"]


def test_a_growing_file_waits_for_what_tells_lost_qualities(tmp_path):
    path, first = tmp_path / "x.fastq", b"@d1\nAC\n+\nII\n"
    path.write_bytes(first + b"@d5\nACG\n+\n@d7\nAC")
    assert rc.last_record(str(path), 0, path.stat().st_size) == len(first)
    path.write_bytes(first + b"@d5\nACG\n+\n@d7\nAC\n+\nII\n")
    assert rc.last_record(str(path), 0, path.stat().st_size) == path.stat().st_size
    assert [r[2] for r in in_ranges(tmp_path, 0) if not r[5]] == [b"d1", b"d7"]


def test_reads_without_bases(tmp_path):
    (tmp_path / "x.fastq").write_text("@a\n\n+\n\n@b\nA\n+\nI\n@c\n\n+")
    assert [(r[2], r[4]) for r in in_ranges(tmp_path, 0) if not r[5]] == [(b"a", b""), (b"b", b"A"), (b"c", b"")]


@pytest.mark.parametrize("length", [0, 1, 7, 40])
def test_fasta_ranges(tmp_path, length, monkeypatch):
    monkeypatch.setattr(rc, "FETCH", 16)
    rnd = random.Random(length)
    made = [(f"r{i}", "d" if i % 3 else None, "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(90)))) for i in range(40)]
    text = "\n\n" + "".join(f">{i}{' ' + d if d else ''}\r\n" + "".join(f"{line}\n" for line in re.findall(".{1,17}", s)) for i, d, s in made)
    (tmp_path / "x.fna").write_bytes(text.encode())
    found = in_ranges(tmp_path, length, rc.fasta_records)
    assert [(r[2].decode(), r[3] and r[3].decode(), r[4].decode()) for r in found] == made and not any(r[5] for r in found)


def test_text_before_the_first_fasta_record_is_bad(spark, tmp_path):
    (tmp_path / "a.fna").write_text("text\nACGT\n>r1\nAC\n")
    read = lambda mode: [r.id for r in fm.read_fasta(spark, f"file://{tmp_path}", mode).collect()]
    assert read("DROP") == ["r1"] and read("STOP") == []
    with pytest.raises(Exception, match="bad FASTA record"):
        read("FAILFAST")


def test_each_byte_is_read_about_once(tmp_path, monkeypatch):
    (tmp_path / "x.fastq").write_text("".join(f"@r{i}\n{'ACGT' * 9}\n+\n{'I' * 36}\n" for i in range(4000)))
    (_, size), read = rc.listed(str(tmp_path), None)[0], []
    system = rc.opened(str(tmp_path))[0]

    class Counted:
        def __init__(self, source):
            self.source = source

        def read_at(self, n, at):
            read.append(n)
            return self.source.read_at(n, at)

    monkeypatch.setattr(rc, "FETCH", 1 << 12)
    with system.open_input_file(str(tmp_path / "x.fastq")) as source:
        n = sum(len(list(rc.fastq_records(Counted(source), part))) for part in rc.ranges([("x", 0, size)], size // 4))
    assert n == 4000 and size <= sum(read) < size + 4 * 4 * (1 << 12)


def test_as_sources_of_a_session(spark, tmp_path):
    text, good = messy(99)
    for name in ("a.fastq", "b.fastq", ".hidden", "_SUCCESS"):
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "empty.fastq").write_text("")
    rc.register(spark)
    df = spark.read.format("fastq").option("rangeBytes", 900).load(f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() > 6
    assert sorted((r.file[-7:], r.id, r.seq, r.qual) for r in df.where("not bad").collect()) == sorted((f, i, s, q) for f in ("a.fastq", "b.fastq") for i, _, s, q in good)
    assert {r.file for r in spark.read.format("fastq").option("glob", "b*|c*").load(str(tmp_path)).collect()} == {f"file://{tmp_path}/b.fastq"}
    assert spark.read.format("fastq").load(f"file://{tmp_path}/*pty.fastq").collect() == []
    with pytest.raises(Exception, match="bad FASTQ record"):
        fm.read_fastq(spark, f"file://{tmp_path}/a.fastq", "FAILFAST").collect()
    first = min(r.at for r in df.where("bad and file like '%/a.fastq'").collect())
    assert first == 0 and fm.read_fastq(spark, f"file://{tmp_path}/a.fastq", "STOP").count() == 0


def test_a_stream_of_growing_files(spark, tmp_path):
    """Bytes come in pieces that end anywhere; the stream is stopped and started again."""
    text, good = messy(5)
    source, out, mark = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    source.mkdir()
    raw, cuts = text.encode(), [0, 700, 701, 2500, len(text)]
    for n, (b, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        for name in ("a", "b") if n else ("a",):
            with open(source / f"{name}.fastq", "ab") as f:
                f.write(raw[:e] if name == "b" and n == 1 else raw[b:e])
        stream = fm.stream_fastq(spark, f"file://{source}").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
        stream.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted((r.file[-7:], r.id, r.seq, r.qual) for r in got) == sorted((f, i, s, q) for f in ("a.fastq", "b.fastq") for i, _, s, q in good)
    batch = fm.read_fastq(spark, f"file://{source}").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r[c] for c in got[0].__fields__) for r in batch)


def test_admission_limit(tmp_path):
    text = "".join(f"@r{i}\n{'A' * 40}\n+\n{'I' * 40}\n" for i in range(100)) + f"@long\n{'C' * 5000}\n+\n{'I' * 5000}\n@end\nA\n+\nI\n@torn\nAC"
    (tmp_path / "x.fastq").write_text(text)
    reader = rc.GrowingReader({"path": str(tmp_path), "maxBytesPerTrigger": "1000"}, rc.fastq_records, ["file", "at", "id", "desc", "seq", "bad", "qual"])
    start, ids, batches = reader.initialOffset(), [], 0
    while (end := reader.latestOffset()) != start:
        for part in reader.partitions(start, end):
            ids += [i for b in reader.read(part) for i in b.column(2).to_pylist()]
        reader.commit(end)
        start, batches = end, batches + 1
    assert ids == [f"r{i}" for i in range(100)] + ["long", "end"] and batches > 8
    (tmp_path / "x.fastq").write_text(text + "G\n+\nIII\n")
    end = reader.latestOffset()
    assert [i for part in reader.partitions(start, end) for b in reader.read(part) for i in b.column(2).to_pylist()] == ["torn"]


def test_small_files_share_a_task():
    parts = rc.ranges([(f"f{i}", 0, 100) for i in range(1000)] + [("long", 0, 5000)], 1000)
    made = rc.dealt(parts, 1000, 7)
    assert [r for m in made for r in m.ranges] == parts and len(made) == 143 + 5
    assert all(len(m.ranges) <= 7 and sum(r.end - r.begin for r in m.ranges) <= 1000 for m in made)
