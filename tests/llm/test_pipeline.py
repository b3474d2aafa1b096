import base64
import hashlib
import random
import struct
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, ngram_jaccard, pii, queries
from tests.llm.data import documents, prose
from tests.llm.test_relational_operators import plain_quality, plain_targets
from tests.llm.test_similarity import plain_classes
from tests.llm.test_text_operators import plain_spans

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stored(spark, tmp_path, rows, labels):
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def plain_redacted(text):
    """Base kinds by their patterns; the test's texts hold no others."""
    spans = sorted((a, b, k) for k, v in plain_spans(text or "").items() for a, b in v)
    for a, b, k in reversed(spans):
        text = f"{text[:a]}[{k.upper()}]{text[b:]}"
    return text


def plain_order(doc_id, text, seed=17):
    """The engine's seeded hash: each value is hashed with the hash before it as seed; nulls are passed over."""
    mark = xxhash.xxh64_intdigest(text.encode(), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    h = h if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), h)
    h = xxhash.xxh64_intdigest(struct.pack("<Q", mark), h)
    return h - (1 << 64 if h >> 63 else 0)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rnd = random.Random(61)
    rows, labels = [], []
    for i in range(180):
        text, bad = prose(rnd, rnd.randrange(12, 60)), i % 5 == 0
        text = " ".join(w.upper() + "!!" for w in text.split()) if bad else text + (f" mail me{i}@site.org or 10.0.{i}.7" if i % 9 == 1 else "")
        rows.append((i, text, rnd.choice(["en", "de"]), rnd.choice(["a", "b", "b", "b", None]), len(text)))
        labels.append((i, int(not bad), 0))
    base = rows[1][1].split() * 2
    for i in range(25):  # near copies, and exact ones of two rows
        words = list(base)
        words[i % len(words)] = f"x{i}"
        rows.append((300 + i, " ".join(words), "en", "b", 0))
    rows += [(400 + i, rows[2][1], "en", "a", 0) for i in range(5)] + [rows[2], rows[3], (500, None, "en", "a", 0), (501, "", "de", None, 0), (501, "", "de", None, 0)]
    folder = stored(spark, tmp_path, rows, labels)

    odds = plain_quality(rows, {i: q for i, q, _ in labels})
    assert min(abs(v + 1) for v in odds) > 1e-6
    good = [r for r, v in zip(rows, odds, strict=True) if v >= -1]
    classes = plain_classes([(r[0], r[1]) for r in good])
    least = {c for _, c, _ in classes}
    unique = {r[0]: r for r in good if r[0] in least}  # ids are unique but for repeated rows
    redacted = [(i, plain_redacted(t), lang, s) for i, t, lang, s, _ in unique.values()]
    assert sum(t != unique[i][1] for i, t, _, _ in redacted) > 10

    now = spark.read.parquet(f"{folder}/documents.parquet")
    for want, (name, stage) in zip((Counter((r[0], r[1]) for r in good), Counter((i, r[1]) for i, r in unique.items()), Counter((i, t) for i, t, _, _ in redacted)), corpus_pipeline.STAGES, strict=False):
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        assert Counter((r.doc_id, r.text) for r in now.collect()) == want, name

    mixed = Counter(r.doc_id for r in corpus_pipeline.mix(spark, now, folder).collect())
    assert mixed == Counter(r.doc_id for r in corpus_pipeline.mix(spark, now.repartition(5), folder).collect())
    size, taken, lengths = Counter(), Counter(), defaultdict(list)
    for i, t, _, s in redacted:
        n = len((t or "").split())
        size[s] += n
        taken[s] += n * mixed[i]
        lengths[s, n].append((plain_order(i, t or ""), mixed[i]))
    targets = plain_targets(size, (3, 1, 2), 1.5, 2.0)
    longest = max(n for _, n in lengths)
    for s, target in targets.items():
        assert abs(taken[s] - target) <= longest / 8
    for (s, n), found in lengths.items():  # whole passes, and once more those that come first by the hash
        found.sort()
        passes = min(int(targets[s] // size[s]), 2) if size[s] and n else 0
        more = sum(c - passes for _, c in found)
        assert [c for _, c in found] == [passes + 1] * more + [passes] * (len(found) - more)

    with open(public_tokenizers.path(queries.RANK_FILE), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, _, _ in redacted:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += mixed[i]
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == +want


@pytest.mark.parametrize("case", ["empty", "no labels", "one kind", "nulls"])
def test_pipeline_takes_odd_tables(spark, tmp_path, case):
    rnd = random.Random(3)
    rows = [] if case == "empty" else [(i, prose(rnd, 30), "en", f"s{i % 3}", 0) for i in range(30)]
    if case == "nulls":
        rows += [(None, prose(rnd, 30), None, None, None), (None, None, None, None, None), (None, None, None, None, None), (7, "y" * 70_000, "en", "s1", 0)]
    labels = {"one kind": [(i, 1, 0) for i in range(20)], "nulls": [(None, None, None), (1, 1, None), (2, 0, 0)]}.get(case, [])
    folder = stored(spark, tmp_path, rows, labels)
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert (got.count() == 0) == (case == "empty")


def test_pipeline_equals_its_operators(spark, tmp_path):
    rnd = random.Random(41)
    rows, labels = [], []
    for i in range(160):
        text, bad = prose(rnd, rnd.randrange(12, 80)), i % 6 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text + (" mail me@site.org" if i % 10 == 1 else ""), "en", f"s{i % 3}", 0))
        labels.append((i, int(not bad), 0))
    rows += [(300 + i, rows[1][1], "en", "s1", 0) for i in range(20)] + [(400, None, "en", None, 0), (401, "", "de", "s0", 0)]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"])
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    folder = f"file://{tmp_path}"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "personal data", "source mixing", "byte-level BPE"]

    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, folder)
        assert after.columns == docs.columns, name
        after.write.parquet(f"{folder}/{name.replace(' ', '')}")
        now = spark.read.parquet(f"{folder}/{name.replace(' ', '')}")
        seen.append(now)
    quality, unique, redacted, mixed = seen
    good = {r.doc_id for r in quality.collect()}
    assert all((i % 6 == 0) != (i in good) for i in range(160))
    classes = ngram_jaccard.jaccard_classes(quality).collect()
    assert {r.doc_id for r in unique.collect()} == {r.class_id for r in classes}
    assert not {300, 319} & {r.doc_id for r in unique.collect()}
    texts = {r.doc_id: r.text for r in unique.collect()}
    assert {r.doc_id: r.text for r in redacted.collect()} == {i: pii.redact(t, pii.find(t)) for i, t in texts.items()}
    assert {r.doc_id for r in mixed.collect()} <= set(texts)
    last = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, queries.byte_bpe_digests(mixed).collect()))


@pytest.mark.parametrize("stage", range(4))
def test_columns_may_have_any_names(spark, tmp_path, stage):
    """The names that operators use inside come back with the caller's values, and change no decision."""
    rnd = random.Random(17)
    made = [prose(rnd, rnd.randrange(3, 60)) for _ in range(60)]
    made += [made[2], made[3] + " tail", " | ".join("WIN!!" for _ in range(30)), None]
    plain_rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(made)]
    folder = stored(spark, tmp_path, plain_rows, [(i, int("WIN" not in (t or "")), 0) for i, t in enumerate(made) if i % 2 == 0])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ("__source", "__size", "__hash", "__copies", "__times", "__chunk", "__each", "__passes", "__cut", "__some", "__tied", "__row", "__maybe", "__stays", "__h", "__id", "__text", "__host", "__path", "__odds", "__n", "__x", "__words", "row", "id", "host", "path", "odds", "p", "kept", "alone", "key")
    odd = docs.select("*", *(F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names))
    run = corpus_pipeline.STAGES[stage][1]
    found, want = run(spark, odd, folder), run(spark, docs, folder)
    assert found.columns == odd.columns and found.count() > 10
    assert Counter(map(tuple, found.select(*docs.columns).collect())) == Counter(map(tuple, want.collect()))
    assert all(r[n] == f"{n} of {r.doc_id}" for r in found.collect() for n in names)


def test_passes_are_whole(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="whole number"):
        mixing.plan(docs, most=1.7)
