import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions import binomial as bi
from tessera.operators import classify as cl
from tessera.operators import distance as di
from tessera.operators import ordering as od
from tessera.operators import prepare as pr
from tessera.operators.index import Index
from tessera.operators.kmers import canonical_codes
from tessera.plans import queries

rnd = random.Random(11)
GENOMES = ["".join(rnd.choice("ACGT") for _ in range(700)) for _ in range(5)]


@pytest.fixture(scope="module")
def index(spark):
    files = spark.createDataFrame([(i, f"f{i}.fna", 100 + i) for i in range(6)], "file_idx int, file string, taxid long")
    records = spark.createDataFrame([(i, g[:400]) for i, g in enumerate(GENOMES)] + [(i, g[380:]) for i, g in enumerate(GENOMES)] + [(4, GENOMES[0][:200]), (5, "ACG")], "file_idx int, seq string")
    return Index.build(records, files, 9, None)


def plain_classify(index_sets, total, reads, trials, exponent, zero_last):
    out = {}
    for name, seq in reads:
        codes = canonical_codes(seq.encode(), 9, None)[1].tolist()
        n, best = len(codes), None
        for f, have in sorted(index_sets.items()):
            x, p = sum(c in have for c in codes), len(have) / total
            if x > n * p:
                xs = math.floor(x * trials / n + 0.5) if n > trials else x
                tail = sum(math.comb(trials, j) * p**j * (1 - p) ** (trials - j) for j in range(xs + 1, trials + 1))
                value = math.log(tail) if tail > 0 else (0.0 if zero_last else -math.inf)
                if best is None or round(value, 9) < best[0]:
                    best = (round(value, 9), f)
        out[name] = f"f{best[1]}.fna" if best and best[0] < -exponent * math.log(10) else "-"
    return out


@pytest.mark.parametrize("zero_last", [True, False])
def test_classify(spark, index, zero_last):
    reads = [(f"r{i}", GENOMES[i % 5][i * 7 : i * 7 + 90]) for i in range(8)] + [("exact", GENOMES[2][:500]), ("short", "ACGT"), ("none", None), ("noise", "".join(rnd.choice("ACGT") for _ in range(120)))]
    reads += [("mixed", GENOMES[1][:60] + "N" + GENOMES[3][:80]), ("repeat", GENOMES[0][:30] * 5)]
    sets: dict = {}
    for r in index.postings.collect():
        sets.setdefault(r.file_idx, set()).add(r.kmer)
    want = plain_classify(sets, index.total, [(n, s or "") for n, s in reads], 100, 12, zero_last)
    rows = cl.classify(spark.createDataFrame(reads, "read_id string, seq string"), index, 12, 100, zero_last).collect()
    assert {r.read_id: r.file for r in rows} == want
    assert len(rows) == len(reads)
    assert want["exact"] == ("-" if zero_last else "f2.fna")
    assert all((r.flag, r.taxid) == (("U", 0) if r.file == "-" else ("C", 100 + int(r.file[1]))) for r in rows)


def test_index_keeps_and_changes(spark, index, tmp_path):
    index.save(f"file://{tmp_path}/db")
    again = Index.load(spark, f"file://{tmp_path}/db")
    assert sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, index.postings.select("kmer", "file_idx").collect()))
    assert again.files.where("file_idx = 5").first()["p"] == 0
    assert again.with_taxid("f1.fna", 5).files.where("file = 'f1.fna'").first()["taxid"] == 5
    with pytest.raises(ValueError):
        index.with_taxid("f1.fna", 101)
    with pytest.raises(KeyError):
        index.with_taxid("none", 1)
    less = index.lossy(3)
    assert less.postings.count() <= index.postings.count()
    assert less.files.count() == 6


def test_distances_orders_groups(spark):
    rows = [(f, k) for f in range(7) for k in {rnd.randrange(40) for _ in range(5 + 3 * f)}] + [(8, k) for k in range(0, 40, 2)] + [(9, k) for k in range(0, 38, 2)]
    sets: dict = {f: {k for g, k in rows if g == f} for f in range(10)}
    postings = spark.createDataFrame(rows, "file_idx int, kmer long")
    files = spark.createDataFrame([(f,) for f in range(10)], "file_idx int")
    dist = {(r.i, r.j): r.dist for r in di.distances(postings, files).collect()}
    assert dist == {(i, j): len(sets[i] ^ sets[j]) for i in range(10) for j in range(i + 1)}
    old = di.distances(postings.where("file_idx < 6"), files.where("file_idx < 6"))
    assert {(r.i, r.j): r.dist for r in di.extended(old, postings, files, 6).collect()} == dist
    d = di.distances(postings, files)
    tour, seen = [3], {3}
    while len(tour) < 10:
        tour.append(min((f for f in range(10) if f not in seen), key=lambda f: (dist[max(f, tour[-1]), min(f, tour[-1])], f)))
        seen.add(tour[-1])
    assert od.greedy_tour(d, 3) == tour
    stats = od.tour_statistics(od.ordering(d, 3), d).first()
    assert stats.length == sum(dist[max(a, b), min(a, b)] for a, b in zip(tour, tour[1:], strict=False))
    assert stats.mean_step == pytest.approx(stats.length / 9)
    one = spark.createDataFrame([(0, 0, 0)], "i int, j int, dist long")
    assert od.tour_statistics(od.ordering(one), one).first().mean_step is None
    groups = {r.file_idx: r.component for r in di.similar_groups(postings, files, 0.6).collect()}
    label = {f: f for f in range(10)}
    for _ in range(10):
        for a in range(10):
            for b in range(10):
                if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6:
                    label[a] = label[b] = min(label[a], label[b])
    assert groups == label
    assert di.similarities(postings, files).where("i = 7 and j = 7").first().jaccard == 1


def test_long_lists_go_by_tiles(spark, monkeypatch):
    """Both ways of counting pairs agree, over the borders of tiles too."""
    sets = {f: {k for k in range(60) if rnd.random() < (0.9 if f % 3 else 0.1)} for f in rnd.sample(range(40), 25)}
    postings = spark.createDataFrame([(f, k) for f, s in sets.items() for k in s], "file_idx int, kmer long")
    by_hand = {(i, j): len(sets[i] & sets[j]) for i in sets for j in sets if i > j and sets[i] & sets[j]}
    monkeypatch.setattr(di, "PER_TILE", 0)
    for tile, held in ((256, 64), (7, 3)):
        monkeypatch.setattr(di, "TILE", tile), monkeypatch.setattr(di, "HELD", held), monkeypatch.setattr(di, "TILE_LISTS", 5)
        for long in (2, 10, 1000):
            found = di.intersections(postings, long=long)
            assert {(r.i, r.j): r.shared for r in found.collect()} == by_hand and found.schema["i"].dataType.typeName() == "integer"
            assert {(r.i, r.j): r.shared for r in di.intersections(postings, from_file=20, long=long).collect()} == {p: n for p, n in by_hand.items() if p[0] >= 20}


@pytest.mark.parametrize("least", [0.05, 0.5, 0.8, 1.0])
def test_similar_pairs_and_their_candidates(spark, least):
    base = [{rnd.randrange(400) for _ in range(rnd.randrange(1, 60))} for _ in range(8)]
    sets = {f: {k for k in base[f % 8] if rnd.random() < 0.93} | {1000 * f + x for x in range(f % 3)} | {7} for f in range(32)}
    sets[40] = sets[41] = {5}
    postings = spark.createDataFrame([(f, k) for f, s in sets.items() for k in s], "file_idx int, kmer long")
    want = {(i, j): len(sets[i] & sets[j]) for i in sets for j in sets if i > j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least}
    assert {(r.i, r.j): r.shared for r in di.similar_pairs(postings, least).collect()} == want
    asked = {(r.i, r.j) for r in di.similar_candidates(postings, least).collect()}
    sharing = sum(bool(sets[i] & sets[j]) for i in sets for j in sets if i > j)
    assert want.keys() <= asked and (least < 0.5 or len(asked) < sharing / 2)
    with pytest.raises(ValueError, match="similarity"):
        di.similar_candidates(postings, 0)


def test_breadth_first_order(spark):
    from tessera.operators.components import breadth_first

    edges = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)} | {(100 + i, 101 + i) for i in range(9)} | {(3, 3)}
    near: dict = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v), near.setdefault(v, set()).add(u)
    want, seen = [], set()
    for root in sorted(near):
        if root in seen:
            continue
        queue, level, parent = [root], {root: 0}, {root: None}
        for u in queue:
            for v in sorted(near[u]):
                if v not in level:
                    level[v], parent[v] = level[u] + 1, u
                    queue.append(v)
        seen |= set(queue)
        want += [(root, i, u, level[u], parent[u]) for i, u in enumerate(queue)]
    given = spark.createDataFrame([*edges, (None, 4), (5, None), (102, 101)], "u int, v int")
    found = breadth_first(given).select("component", "pos", "node", "level", "parent")
    assert sorted(map(tuple, found.collect())) == sorted(want)
    with pytest.raises(RuntimeError, match="deeper"):
        breadth_first(given, 2)
    assert breadth_first(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("nearest", [1, 2, 5, 64])
def test_tours_of_short_lists(spark, nearest):
    n = 30
    dist = {(i, j): 0 if i == j else rnd.randrange(1, 40) for i in range(n) for j in range(i + 1)}
    tour = [2]
    while len(tour) < n:
        tour.append(min((f for f in range(n) if f not in tour), key=lambda f: (dist[max(f, tour[-1]), min(f, tour[-1])], f)))
    given = spark.createDataFrame([(*p, d) for p, d in dist.items()], "i int, j int, dist long")
    assert od.greedy_tour(given, 2, nearest) == tour


def saved_lossy(spark, tmp_path, monkeypatch, broadcast):
    from tessera.operators import classify as cl
    from tessera.plans import shared

    if not broadcast:
        monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(cl, "if_small", lambda df: df)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(400)) for _ in range(40)]
    seqs = [s if i % 3 else seqs[0][:300] + s[:100] for i, s in enumerate(seqs)]
    files = spark.createDataFrame([(i, f"f{i}", i + 1) for i in range(40)], "file_idx int, file string, taxid long")
    index = Index.build(spark.createDataFrame(list(enumerate(seqs)), "file_idx int, seq string"), files, 7, None).lossy(2)
    index.save(f"file://{tmp_path}/db")
    reads = spark.createDataFrame([(f"r{i}", seqs[i][20 * (i % 9) : 20 * (i % 9) + 150]) for i in range(40)], "read_id string, seq string")
    return cl, index, Index.load(spark, f"file://{tmp_path}/db"), reads


@pytest.mark.parametrize("broadcast", [True, False])
def test_lists_are_matched_as_they_are_stored(spark, tmp_path, monkeypatch, broadcast):
    cl, index, saved, reads = saved_lossy(spark, tmp_path, monkeypatch, broadcast)
    counted = cl.read_kmers(reads, 7)
    key = lambda df: sorted(map(tuple, df.collect()))
    found = cl.list_hits(counted, saved.lists)
    assert key(found) == key(cl.hits(counted, index.postings)) and found.count() > 40
    plain = Index(index.files, 7, None, index.total, pairs=index.postings)
    assert key(cl.classify(reads, saved, 3)) == key(cl.classify(reads, plain, 3))
    if not broadcast:  # the reads alone are shuffled to meet the stored lists
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            joined = saved.lists.join(counted.where("kmer is not null"), "kmer")
            plan = joined._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert plan.count("Exchange hashpartitioning(kmer") == 1 and "Bucketed: true" in plan


def test_few_kmers_read_their_own_buckets(spark, tmp_path, monkeypatch):
    """The files of all other buckets are spoiled, and nobody looks."""
    import glob

    from pyspark.sql import types as T

    cl, _, saved, _ = saved_lossy(spark, tmp_path, monkeypatch, True)
    kmer = saved.lists.where(F.size("blocks") > 0).first()["kmer"]
    counted = spark.createDataFrame([(0, "r", kmer, 2)], T.StructType().add(cl.ROW, "long").add("read_id", "string").add("kmer", "long").add("times", "long"))
    want = sorted(map(tuple, cl.list_hits(counted, saved.lists).collect()))
    bucket = spark.range(1).select(F.expr(f"pmod(hash({kmer}L), {saved.stored.properties['buckets']})")).first()[0]
    files = glob.glob(f"{tmp_path}/db/lists-*/part-*")
    assert len(files) == 8
    for f in files:
        if f"_{bucket:05d}.c000" not in f:
            with open(f, "r+b") as out:
                out.truncate(10)
    assert want and sorted(map(tuple, cl.list_hits(counted, Index.load(spark, f"file://{tmp_path}/db").lists).collect())) == want
    monkeypatch.setattr(cl, "FEW_KMERS", 0)
    with pytest.raises(Exception, match="part-"):
        cl.list_hits(counted, Index.load(spark, f"file://{tmp_path}/db").lists).collect()


def test_blocks_are_smaller_than_postings(spark, tmp_path):
    """Many files that share their k-mers: runs in place of one row for each posting."""
    import os

    files = spark.createDataFrame([(i, f"f{i}", 0) for i in range(300)], "file_idx int, file string, taxid long")
    seq = "".join(rnd.choice("ACGT") for _ in range(3000))
    index = Index.build(spark.createDataFrame([(i, seq) for i in range(300)], "file_idx int, seq string"), files, 9, None)
    index.save(f"file://{tmp_path}/db")
    index.postings.write.parquet(f"file://{tmp_path}/postings")
    size = lambda top: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names if f.endswith(".parquet"))
    stored = Index.load(spark, f"file://{tmp_path}/db")
    assert size(f"{tmp_path}/db/{stored.stored.folders['lists']}") < size(f"{tmp_path}/postings") / 3


def test_observed_reads(spark):
    from tessera.operators import classify as cl

    reads, seen = cl.observed(spark.createDataFrame([("a", "ACGT"), ("b", None), ("c", "AC")], "read_id string, seq string"))
    reads.write.format("noop").mode("overwrite").save()
    assert seen.get == {"reads": 3, "bases": 6}


def test_binomial(spark):
    df = spark.range(21).select("id", F.exp(bi.ln_tail(F.lit(0.05), F.col("id"), 20, False)).alias("sf"))
    for r in df.collect():
        assert r.sf == pytest.approx(sum(math.comb(20, j) * 0.05**j * 0.95 ** (20 - j) for j in range(r.id + 1, 21)), abs=1e-12)
    want = {1e-4: 4, 1e-3: 7, 0.011: 14, 0.05: 26, 0.1: 36}  # fixed values for 10^-12 of 100 trials
    got = spark.createDataFrame([(p,) for p in want], "p double").select("p", bi.smallest_significant(F.col("p"), 100, 12).alias("x"))
    assert {r.p: r.x for r in got.collect()} == want
    tiny = spark.range(1).select(bi.ln_tail(F.lit(1e-4), F.lit(99), 100).alias("v")).first().v
    assert tiny == pytest.approx(100 * math.log(1e-4))
    big = spark.range(1).select(bi.big_exp(F.lit(1e-12)).alias("b"), bi.big_exp(F.lit(0.0)).alias("z"), bi.big_from_ln(F.lit(-2000.0)).alias("far")).first()
    assert (big.b.exp, round(big.b.mant, 7)) == (-40, 1.0995116)
    assert (big.z.exp, big.z.mant) == (0, 0.0)
    assert 1 <= big.far.mant < 2 and math.log(big.far.mant) + big.far.exp * math.log(2) == pytest.approx(-2000)


def test_big_functions(spark):
    rows = spark.createDataFrame([(v,) for v in (1e-300, 0.03, 1.0, 2.5, 7e250)], "v double").select("v", bi.big_exp(F.col("v")).alias("b"))
    tiny = lambda b: bi.big_square(bi.big_square(b))
    found = rows.select("v", *(bi.ln_of_big(f(F.col("b"))).alias(n) for n, f in (("root", bi.big_sqrt), ("fourth", tiny), ("power", lambda b: bi.big_power(b, 3.5))))).collect()
    for r in found:
        assert (r.root, r.fourth, r.power) == pytest.approx((math.log(r.v) / 2, math.log(r.v) * 4, math.log(r.v) * 3.5))
    e = spark.range(1).select(bi.ln_of_big(bi.big_exp_of(bi.big_exp(F.lit(-5000.0)))).alias("v"), bi.big_power(bi.big_exp(F.lit(0.0)), 2)["mant"].alias("z")).first()
    assert e.v == pytest.approx(-5000) and e.z == 0
    less = spark.range(1).select(*(bi.big_less(bi.big_exp(F.lit(a)), bi.big_exp(F.lit(b))).alias(n) for n, a, b in (("x", 1.0, 1.5), ("y", 1e-9, 0.0), ("z", 0.0, 1e-9)))).first()
    assert (less.x, less.y, less.z) == (True, True, False)


def test_long_sequences_are_cut_without_loss(spark, monkeypatch):
    from tessera.operators import kmers as km

    rows = [(0, "".join(rnd.choice("ACGTN") if i % 50 == 0 else rnd.choice("ACGT") for i in range(900))), (1, "ACGTACGTAC"), (2, "AC"), (3, None)]
    df = spark.createDataFrame(rows, "id int, seq string")
    whole = km.kmers(df, ["id"], "seq", 5, positions=True).collect()
    for piece in (1, 7, 64):
        assert [x for raw, begins, r, o in km._pieces([b"ACGTACGTAC"], 5) for x in r]
        monkeypatch.setattr(km, "PIECE", piece)
        texts = [(s or "").encode() for _, s in rows]
        found = []
        for raw, begins, row, offset in km._pieces(texts, 5):
            at, code = canonical_codes(raw, 5, None)
            part = [sum(b <= a for b in begins) - 1 for a in at]
            found += [(int(row[p]), int(a - begins[p] + offset[p]), int(c)) for p, a, c in zip(part, at, code, strict=True)]
        assert sorted(found) == sorted((r.id, r.pos, r.kmer) for r in whole)
    counts = Counter((r.id, r.kmer) for r in whole)
    got = km.kmer_counts(df, ["id"], "seq", 5).where("times > 0").groupBy("id", "kmer").agg(F.sum("times").alias("n")).collect()
    assert {(r.id, r.kmer): r.n for r in got} == counts


def test_shared_tables_and_numbers(spark):
    from tessera.plans import shared

    df = spark.range(1000).withColumn("t", F.col("id").cast("string"))
    assert shared.is_small(df) and not shared.is_small(df, 999) and not shared.is_small(df, size=100) and shared.is_small(df.where("false"))
    for rows, members in ((100, df.where("id % 10 = 0")), (0, df.where("false"))):
        found = shared.maybe_in(df, F.col("t"), members, F.col("t"), rows)
        assert found.columns == [*df.columns, "__maybe"] and found.count() == 1000
        assert found.where("id % 10 = 0 and not __maybe").count() == 100 - rows and found.where("__maybe").count() <= 1.2 * rows
    assert shared.numbered(df.repartition(7), F.desc("id")).where("number <> 999 - id").count() == 0
    exists = lambda t: t.path and shared.Written.__module__ and spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.path))
    with shared.scratch():
        inner = []
        kept = shared.settled(lambda: inner.append(shared.Written(df, "inner")) or inner[0].df.where("id < 5"), "kept")
        assert kept.df.count() == 5 and exists(kept) and not exists(inner[0])
    assert not exists(kept)


def test_taxids_and_splits(spark):
    taxids = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], "id string, taxid long, line long")
    assert {r.id: r.taxid for r in pr.last_wins(taxids, "id", "line").collect()} == {"a": 2, "b": 3}
    files = spark.createDataFrame([("x.fna", "a"), ("y.fna", "q")], "file string, id string")
    with pytest.raises(Exception, match="no taxid for q"):
        pr.with_taxids(files, taxids).collect()
    assert {r.taxid for r in pr.with_taxids(files, None).collect()} == {0}
    records = spark.createDataFrame([("x.fna", 0, "a", None, "A" * 30), ("x.fna", 1, "b", None, "C" * 5), ("y.fna", 0, "b", "d", "G" * 8)], "file string, record_idx int, id string, desc string, seq string")
    table, parts = pr.file_table(records, pr.last_wins(taxids, "id", "line"), 12, 4)
    assert Counter(map(tuple, table.collect())) == Counter([("split/x.0.0", 2), ("split/x.0.1", 2), ("split/x.0.2", 2), ("split/x.1", 2), ("y.fna", 3)])
    assert {(r.name, r.desc, len(r.seq)) for r in parts.collect()} == {("x.0.0", "0..12", 12), ("x.0.1", "8..22", 14), ("x.0.2", "18..30", 12), ("x.1", None, 5)}
    clash = spark.createDataFrame([("x.fna", 0, "a", None, "A" * 10), ("x.fna", 1, "a", None, "A" * 10), ("x.fa", 0, "a", None, "C" * 10), ("x.fa", 1, "a", None, "C" * 10)], records.schema)
    with pytest.raises(ValueError):
        pr.file_table(clash, None, 12, 4)


def test_entry_imports_and_runs(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["flag", "read_id", "taxid", "file"]
    assert rows.where("flag = 'C'").count() == 14
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_exponents_just_below_a_power_of_two(spark, tmp_path):
    """The logarithm of such values rounds to a whole number, in SQL and in the query."""
    rows = [(n, 1, p / 100, d / 100) for n, (p, d) in enumerate((round(100 * 2.0**e / (abs(d - 5) / 100)) + o, d) for e in range(-8, 18) for d in range(11) if d != 5 for o in (-1, 0, 1))]
    made = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double")
    made.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = queries.QUERIES["m5_big_exp"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.execute(queries.SQL["m5_big_exp"]).fetchall())
    assert any(0 < abs(r.mant) < 1 for r in got)


def test_equal_sets_are_one_until_their_pairs_are_known(spark, monkeypatch):
    """Copies give all their pairs, but meet others once."""
    base = [rnd.sample(range(5000), 60) for _ in range(4)]
    near = [[*b[:-2], 9000 + n] for n, b in enumerate(base)]
    sets = {100 * c + n: s for c in range(5) for n, s in enumerate(base + near)}
    postings = spark.createDataFrame([(f, k) for f, s in sets.items() for k in s], "file_idx int, kmer long")
    seen = []
    plain = di._candidates
    monkeypatch.setattr(di, "_candidates", lambda *a: seen.append(plain(*a)) or seen[0])
    got = {(r.i, r.j): (r.shared, r.jaccard) for r in di.similar_pairs(postings, 0.8).collect()}
    want = {}
    for i, a in sets.items():
        for j, b in sets.items():
            shared = len(set(a) & set(b))
            if i > j and shared >= 0.8 * (len(a) + len(b) - shared):
                want[i, j] = (shared, shared / (len(a) + len(b) - shared))
    assert got == want and len(want) > 100
    assert seen[0][1].count() == 8


def test_parts_that_agree_lose_no_pair():
    """As many of the smaller set's entries as asked for agree with the larger set's, also where both differ at the limit."""
    import numpy as np

    from tessera.operators import parts as ps

    rng = np.random.default_rng(3)
    for least in (0.3, 0.8, 0.95):
        for n in (*range(1, 30), 61, 200, 1000, 4001):
            for more in range(3):  # what differs is in the larger set, in the smaller one, or in both
                spare = int(n / least + 1e-9) - n
                lost = (0, n - int(np.ceil(least * n - 1e-9)), int((1 - least) / (1 + least) * n))[more]
                codes = rng.choice(1 << 22, n + spare + lost, replace=False)
                a, b = codes[:n], (codes[: n + spare], codes[lost:n], codes[lost : n + lost])[more]
                small, large = sorted((np.sort(ps.mixed(x)) for x in (a, b)), key=len)
                if not len(small):
                    continue
                assert len(np.intersect1d(small, large)) >= least * len(np.union1d(small, large)) - 1e-6
                x, y = (ps.signatures(h, rng.random(len(h)), least) for h in (small, large))
                mine, other = x[x & 3 >= 1], set((y[y & 3 <= 1] >> 5).tolist())
                agree = [e for e in mine.tolist() if e >> 5 in other]
                assert agree and len(agree) >= 1 << (max(agree) >> 2 & 7)


def test_similar_texts_are_read_where_they_are(spark, tmp_path):
    """What the query stores and what is shuffled stay near the size of the texts: neither postings nor sets are moved."""
    import os

    from tessera.operators import index as ix
    from tessera.plans import queries

    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 9))) for _ in range(4000)]
    texts = [" ".join(rnd.choice(words) for _ in range(2500)) for _ in range(150)]
    texts += [t.replace(words[n], "x", 3) for n, t in enumerate(texts[:20])] + texts[:5] + ["", "abc", " ".join(texts[0].split()[:2200])]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    sizes, plain = {}, queries.written

    def watched(df, name, **options):
        found = plain(df, name, **options)
        path = found.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        sizes[name] = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path))
        return found

    with pytest.MonkeyPatch.context() as patched:
        for module in (queries, di, ix):
            patched.setattr(module, "written", watched)
        got = queries.QUERIES["f15_similar_pairs"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.execute(queries.SQL["f15_similar_pairs"]).fetchall()) and len(got) >= 25
    assert "postings" not in sizes and sum(n for name, n in sizes.items() if name != "marks") < 0.6 * sum(map(len, texts))
