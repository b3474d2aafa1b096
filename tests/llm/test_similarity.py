import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import additive_ann, ngram_jaccard, queries
from tests.llm.data import EMPTY, documents, prose, texts


def near_texts():
    rnd = random.Random(31)
    made = texts()
    base = prose(rnd, 150).split()
    for i in range(120):  # a group of near copies with links that are not transitive
        words = list(base)
        for _ in range(rnd.randrange(0, 5)):
            words[rnd.randrange(len(words))] = f"w{i}x{rnd.randrange(9)}"
        made.append(" ".join(words[: rnd.choice([150, 150, 140, 120])]))
    passage = prose(rnd, 60)
    made += [prose(rnd, rnd.randrange(2, 60)) + " " + passage for _ in range(30)]
    return made


def plain_classes(rows, size=5, threshold=0.8):
    sets = [set(ngram_jaccard.shingles(t, size).tolist()) for _, t in rows]
    label, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and shared >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                if a != b:
                    label = [min(a, b) if x in (a, b) else x for x in label]
    least = defaultdict(list)
    for i, x in enumerate(label):
        least[x].append(rows[i][0])
    return Counter((rows[i][0], min(least[label[i]]), links[i]) for i in range(len(rows)))


@pytest.mark.parametrize("options", [{}, {"block_docs": 7, "block_shingles": 900}])
def test_classes_equal_brute_force(spark, options):
    df = documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(near_texts())])
    got = ngram_jaccard.jaccard_classes(df, **options).collect()
    assert Counter(map(tuple, got)) == plain_classes([(r.doc_id, r.text) for r in df.collect()])


def test_blocks_without_documents_add_no_links(spark):
    rnd = random.Random(17)
    rows = []
    for f in range(8):  # families of three long texts and three blocks, of which most leave one empty
        words = prose(rnd, 300).split()
        for c in range(3):
            rows.append((3 * f + c, " ".join([*words, f"f{f}", f"c{c}"]), "en", "s", 0))
    df = documents(spark, rows).dropDuplicates(["doc_id"])
    got = ngram_jaccard.jaccard_classes(df, block_shingles=120).collect()
    assert Counter(map(tuple, got)) == plain_classes([(r.doc_id, r.text) for r in df.collect()])
    assert {r.n_links for r in got} == {2}


def test_hot_buckets_are_joined_whole(spark):
    """Buckets dealt over blocks find the links that their stars miss."""
    rnd = random.Random(23)
    rows = []
    for f in range(6):
        base = prose(rnd, 120).split()
        for c in range(25):
            words = list(base)
            for _ in range(rnd.randrange(0, 9)):
                words[rnd.randrange(120)] = f"w{f}x{c}x{rnd.randrange(99)}"
            rows.append((25 * f + c, " ".join(words), "en", "s", 0))
    df = documents(spark, rows).dropDuplicates(["doc_id"])
    got = ngram_jaccard.jaccard_classes(df, bucket_docs=4).collect()
    assert Counter(map(tuple, got)) == plain_classes([(r.doc_id, r.text) for r in df.collect()])


def test_passages_in_common_cost_no_more_than_a_row_a_band(spark, monkeypatch):
    """A chain in which neighbours share a third, and all a passage: work grows with the documents, and no text moves."""
    stored = {}

    def recorded(df, name):
        made = ngram_jaccard_written(df, name)
        stored[name] = stored.get(name, 0) + made.count()
        return made

    ngram_jaccard_written = ngram_jaccard.written
    monkeypatch.setattr(ngram_jaccard, "written", recorded)
    seen = {}
    for n in (500, 2000):
        stored.clear()
        word = lambda i, k: f"w{i}x{k}"
        passages = [" ".join(word(i, k) for k in range(40)) for i in range(n + 1)]
        common = " ".join(f"all{k}" for k in range(15))
        df = spark.createDataFrame([(i, f"{passages[i]} {common} {passages[i + 1]}") for i in range(n)], "doc_id long, text string")
        got = ngram_jaccard.jaccard_classes(df).collect()
        assert len(got) == n and all(r.class_id == r.doc_id and r.n_links == 0 for r in got)
        seen[n] = dict(stored)
    assert seen[2000]["members"] == seen[2000]["links"] == 0
    for name, rows in seen[2000].items():
        assert rows <= 5 * seen[500].get(name, 0) + 50, name


def test_other_sizes_and_empty(spark):
    df = documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(near_texts()[:80])])
    got = ngram_jaccard.jaccard_classes(df, size=2, threshold=0.9).collect()
    assert Counter(map(tuple, got)) == plain_classes([(r.doc_id, r.text) for r in df.collect()], 2, 0.9)
    assert ngram_jaccard.jaccard_classes(documents(spark, EMPTY)).count() == 0


def test_one_of_each_stays(spark):
    df = documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(near_texts())])
    kept = ngram_jaccard.drop_near_duplicates(df)
    want = {c for _, c, _ in plain_classes([(r.doc_id, r.text) for r in df.collect()])}
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("options", [{}, {"block_docs": 2, "block_shingles": 100}])
def test_one_of_near_copies_under_one_id_stays(spark, options):
    rnd = random.Random(9)
    a, b = prose(rnd, 80), prose(rnd, 80)
    rows = [(1, a), (1, a + " end"), (1, "begin " + a), (1, a + " end"), (2, a), (1, b), (3, b + " end"), (1, ""), (1, None), (None, prose(rnd, 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in ngram_jaccard.drop_near_duplicates(df, **options).collect()]
    assert len(kept) == 5 and {(1, b), (1, ""), (1, None), rows[-1]} < set(kept)
    assert sum(i == 1 and a in (t or "") for i, t in kept) == 1


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_rows_without_an_id_take_part(spark, kind):
    rnd = random.Random(8)
    a, b, c, d = (prose(rnd, 80) for _ in range(4))
    near = lambda t: t + " end"
    rows = [(1, a), (None, near(a)), (None, b), (None, near(b)), (None, None), (None, ""), (7, c), (7, d), (8, near(c)), (7, c)]
    made = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class_id int")
    df = made.withColumn("doc_id", F.col("doc_id").cast(kind))
    got = ngram_jaccard.jaccard_classes(df).collect()
    assert len(got) == len(rows)
    assert Counter(None if r.doc_id is None else int(r.doc_id) for r in got) == Counter(i for i, _ in rows)
    assert sorted(r.n_links for r in got) == [0, 0, 0, 1, 1, 1, 1, 2, 2, 2]
    assert sum(r.doc_id is None and str(r.class_id) == "1" for r in got) == 1
    kept = ngram_jaccard.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    texts_kept = [r.text for r in kept.collect()]
    assert len(texts_kept) == 6 and {a, c, d, None, ""} < set(texts_kept)
    assert len({b, near(b)} & set(texts_kept)) == 1


def test_pruning_keeps_what_may_reach_the_threshold():
    least = ngram_jaccard.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 0.8 * ngram_jaccard.HASHES
    rnd = np.random.Generator(np.random.PCG64(1))
    lost = 0
    for _ in range(2000):
        equal = rnd.random(ngram_jaccard.HASHES) < 0.8
        lost += any(equal[: (k + 1) * ngram_jaccard.STEP].sum() < m for k, m in enumerate(least))
    assert lost <= 2


def test_minhash_estimates_similarity():
    rnd = random.Random(2)
    errors = []
    for _ in range(200):
        words = prose(rnd, 200).split()
        other = list(words)
        for _ in range(rnd.randrange(1, 12)):
            other[rnd.randrange(200)] = str(rnd.random())
        a, b = (ngram_jaccard.shingles(" ".join(w), 5) for w in (words, other))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((ngram_jaccard.minhashes(a) == ngram_jaccard.minhashes(b)).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def vectors(spark, n=1500, copies=400):
    rnd = np.random.Generator(np.random.PCG64(3))
    x = rnd.normal(size=(n, 16)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(n)] + [(5000 + i, x[7].tolist()) for i in range(copies)]
    rows += [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] + [1.0] * 15), (9300, [float("inf")] + [1.0] * 15), (9400, [1.0] * 3), (9500, [None] + [1.0] * 15), (None, x[0].tolist()), (100, x[100].tolist())]
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, label int, score double")


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 300, "block_queries": 7}])
def test_neighbours(spark, blocks):
    df = vectors(spark)
    got = additive_ann.nearest(df, F.col("vec_id") % 100 == 0, 10, **blocks).collect()
    rows = {(r.vec_id, tuple(r.embedding)) for r in df.where("embedding is not null and vec_id is not null").collect()}
    usable = [(i, np.array(v, np.float64)) for i, v in rows if None not in v and len(v) == 16 and np.isfinite(np.array(v, np.float64)).all() and any(v)]
    queries_ = {i: v for i, v in usable if i % 100 == 0}
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    assert set(by) == set(queries_)
    hits = 0
    for q, found in by.items():
        assert [r.rank for r in found] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        exact = sorted((float(np.sqrt(((v - queries_[q]) ** 2).sum())), i) for i, v in usable if i != q)
        known = {i: d for d, i in exact}
        assert all(r.score == pytest.approx(known[r.vec_id], abs=1e-12) and r.vec_id != q for r in found)
        hits += len({i for _, i in exact[:10]} & {r.vec_id for r in found})
    assert hits >= 0.9 * 10 * len(by)


def test_copies_of_a_query_crowd_nothing_out(spark):
    near, far = [1.0, 0.0, 0.5], [1.0, 0.25, 0.5]
    rows = [(100, near)] * 12 + [(200, near)] * 2 + [(7, far), (300, [9.0, 9.0, 9.0]), (100, [1.0, 0.0, 0.75]), (8, near)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for source in (df, df.repartition(5), df.union(df)):
        got = additive_ann.nearest(source, F.col("vec_id").isin(100, 200), 3).collect()
        by = {q: [(r.vec_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (100, 200)}
        first = {r.vec_id for r in got if r.query_id == 100}
        assert by[200] == [(8, 0.0), (100, 0.0), (7, 0.25)]
        assert 100 not in first and {8, 200, 7} == first
    again = additive_ann.nearest(df.repartition(5), F.col("vec_id") == 100, 3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, additive_ann.nearest(df, F.col("vec_id") == 100, 3).collect()))


def test_shortlist_is_small(spark):
    """A few hundred of many vectors, from several blocks, still hold nine in ten of the nearest."""
    rnd = np.random.Generator(np.random.PCG64(8))
    x = rnd.normal(size=(12_000, 24)).astype(np.float32) @ rnd.normal(size=(24, 24)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": list(range(len(x))), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}))
    got = additive_ann.nearest(df, F.col("vec_id") % 100 == 0, 10, block_rows=4096).collect()
    assert len(got) == 1200
    queries_ = x[::100].astype(np.float64)
    exact = ((queries_**2).sum(1)[:, None] + (x.astype(np.float64) ** 2).sum(1) - 2 * queries_ @ x.T.astype(np.float64))
    exact[np.arange(120), np.arange(120) * 100] = np.inf
    truth = np.argsort(exact, 1)[:, :10]
    assert sum(r.vec_id in truth[r.query_id // 100] for r in got) >= 0.9 * 1200


@pytest.mark.parametrize("size, offset", [(1e-25, 0.0), (1e25, 0.0), (1.0, 1e5)])
def test_nearest_of_any_size(spark, size, offset):
    """Numbers whose squares leave floats, and an offset, are no reason to miss what is nearest."""
    rnd = np.random.Generator(np.random.PCG64(9))
    x = (offset + size * rnd.normal(size=(1500, 12))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": list(range(len(x))), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}))
    got = additive_ann.nearest(df, F.col("vec_id") % 100 == 0, 10).collect()
    wide = x.astype(np.float64)
    exact = ((wide[::100, None] - wide[None]) ** 2).sum(2)
    exact[np.arange(15), np.arange(15) * 100] = np.inf
    truth = np.argsort(exact, 1, kind="stable")[:, :10]
    assert sum(r.vec_id in truth[r.query_id // 100] for r in got) >= 0.9 * 150


def test_few_or_no_vectors(spark):
    df = vectors(spark)
    assert additive_ann.nearest(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    few = additive_ann.nearest(df.where("vec_id in (100, 3, 9000)"), F.col("vec_id") == 100).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(100, 1, 3)]


def test_planned_copies_come_by_id(spark):
    got = additive_ann.nearest(vectors(spark).where("vec_id >= 5000 or vec_id = 7"), F.col("vec_id") == 5000, 4).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(7, 0.0), (5001, 0.0), (5002, 0.0), (5003, 0.0)]


def test_query_covers_every_row(spark, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: vectors(spark))
    assert queries.neighbours(spark, "").select("query_id").distinct().count() > 15
