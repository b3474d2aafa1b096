import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import sequence as sq
from tessera.operators import kmers as km

# Golden k-mers of a published test sequence, two bits a letter.
GOLDEN_SEQ = "CGATTAAAGATAGAAATACACGNTGCGAGCAATCAAATT"
GOLDEN = """01_10_00_11_11_00_00_00_10_00_11_00_10_00
10_00_11_11_00_00_00_10_00_11_00_10_00_00
00_11_11_00_00_00_10_00_11_00_10_00_00_00
00_11_11_11_01_11_00_11_01_11_11_11_00_00
11_00_00_00_10_00_11_00_10_00_00_00_11_00
00_00_00_10_00_11_00_10_00_00_00_11_00_01
00_00_10_00_11_00_10_00_00_00_11_00_01_00
00_10_00_11_00_10_00_00_00_11_00_01_00_01
01_10_11_10_11_00_11_11_11_01_11_00_11_01
11_10_01_10_00_10_01_00_00_11_01_00_00_00
00_11_11_11_10_00_11_11_10_01_11_01_10_01
00_00_11_11_11_10_00_11_11_10_01_11_01_10""".split()
CODES = [int(g.replace("_", ""), 2) for g in GOLDEN]
SYNCMERS = {0: [2, 3, 5, 6, 7, 8, 10, 11], 1: [1, 4]}


@pytest.mark.parametrize("t", [None, 0, 1])
def test_golden_kmers(spark, t):
    want = CODES if t is None else [CODES[i] for i in SYNCMERS[t]]
    syncmer = None if t is None else (12, t)
    assert km.canonical_codes(GOLDEN_SEQ.encode(), 14, syncmer)[1].tolist() == want
    rows = km.kmers_sql(spark.createDataFrame([(1, GOLDEN_SEQ)], "id int, seq string"), ["id"], "seq", 14, syncmer)
    assert [r.kmer for r in rows.orderBy("pos").collect()] == want


@pytest.mark.parametrize(("k", "syncmer"), [(1, None), (5, None), (6, (3, 0)), (6, (3, 3)), (7, (7, 0)), (16, (5, 4))])
def test_kernel_equals_sql(spark, k, syncmer):
    rnd = random.Random(k)
    texts = [("x", "".join(rnd.choice("ACGTacgtN-é") if rnd.random() < 0.2 else rnd.choice("ACGT") for _ in range(rnd.randrange(90)))) for _ in range(40)]
    rows = [(i, *t) for i, t in enumerate(texts)] + [(90, "x", None), (91, "x", "")]
    df = spark.createDataFrame(rows, "id int, kmer_ string, seq string")
    got = sorted(map(tuple, km.kmers(df, ["id"], "seq", k, syncmer, positions=True).collect()))
    assert got == sorted((r.id, r.pos, r.kmer) for r in km.kmers_sql(df, ["id"], "seq", k, syncmer).collect())
    once = sorted(map(tuple, km.kmers(df, ["id"], "seq", k, syncmer, repeats=False).collect()))
    assert once == sorted({(i, kmer) for i, _, kmer in got})


def plain_universe(k, s, t):
    def letters(code):
        return "".join("ACGT"[code >> 2 * (k - 1 - i) & 3] for i in range(k))

    n = 0
    for code in range(4**k):
        w = letters(code)
        rc = w[::-1].translate(str.maketrans("ACGT", "TGCA"))
        small = [w[i : i + s] for i in range(k - s + 1)]
        n += w <= rc and small.index(min(small)) == t
    return n


def test_universe(spark):
    for k, s, t in [(3, 2, 1), (4, 2, 0), (5, 3, 2), (5, 5, 0), (6, 3, 1)]:
        assert km.universe(spark, k, (s, t)).first()["total"] == plain_universe(k, s, t), (k, s, t)
    assert km.universe(spark, 15).first()["total"] == 536870912
    assert km.universe(spark, 15, (9, 2)).first()["total"] == 63439162
    assert km.universe(spark, 4).first()["total"] == (4**4 + 4**2) // 2


@pytest.mark.parametrize(("k", "syncmer"), [(0, None), (17, None), (5, (6, 0)), (5, (3, 3))])
def test_arguments(k, syncmer):
    with pytest.raises(ValueError):
        km.checked(k, syncmer)


def test_scalars(spark):
    row = spark.range(1).select(
        sq.base_code(F.lit("g")).alias("g"), sq.base_code(F.lit("N")).alias("n"), sq.encode(F.lit("ACGT")).alias("code"), sq.decode(F.lit(27), 4).alias("word"),
        sq.split_name(F.lit("a.b.fna"), F.lit(2)).alias("name"), sq.shown_path(F.lit("/r/split/x.0")).alias("split"), sq.shown_path(F.lit("/r/seqs/x.fna")).alias("plain"),
        sq.rescaled(F.lit(5), F.lit(200), 100).alias("half_up"), sq.rescaled(F.lit(5), F.lit(100), 100).alias("kept"),
        sq.fragments(F.lit("ACGTACGTAC"), 4, 2).alias("parts"),
    ).first()
    assert (row.g, row.n, row.code, row.word) == (2, None, 27, "ACGT")
    assert (row.name, row.split, row.plain) == ("a.b.2", "split/x.0", "x.fna")
    assert (row.half_up, row.kept) == (3, 5)
    assert [(p.start, p.end, p.seq) for p in row.parts] == [(0, 5, "ACGTA"), (3, 9, "TACGTA"), (7, 10, "TAC")]
