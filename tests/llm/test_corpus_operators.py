"""Collocations, repeated passages and token alignment against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tessera.llm import collocations, queries, substring_dedup, token_alignment
from tests.llm.data import EMPTY, documents, prose, texts

A, B = (public_tokenizers.path(f) for f in (queries.BYTE_FILE, queries.PIECE_FILE))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def phrases_by_hand(docs, least, longest, top, percent):
    count, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    count[lang, tuple(words[i : i + n])] += 1
    made = []
    for (lang, p), a in count.items():
        if len(p) < 2 or a < least:
            continue
        if any(len(q) > len(p) and qn >= least and 100 * qn >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), qn in count.items() if other == lang):
            continue
        score, _, left, right = min((1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
        made.append((lang, " ".join(p), a, left, right, total[lang], score))
    out = []
    for lang in {m[0] for m in made}:
        best = sorted((m for m in made if m[0] == lang), key=lambda m: (-m[6], -m[2], m[1].encode()))[:top]
        out += [(lang, i + 1, *m[1:]) for i, m in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("size", "top", "percent", "held"), [(1 << 20, 2000, 100, 1 << 21), (40, 7, 100, 100), (1, 2000, 60, 3)])
def test_collocations(spark, monkeypatch, size, top, percent, held):
    monkeypatch.setattr(collocations, "HELD", held)
    given = documents(spark)
    by_hand = phrases_by_hand([(r["lang"], r["text"]) for r in given.collect()], 3, 5, top, percent)
    found = collocations.collocations(given, 3, 5, top, percent, size=size)
    assert by_hand and rows(found) == by_hand


@pytest.mark.parametrize("size", [1, 50, 1 << 19])
def test_collocations_of_long_texts(spark, monkeypatch, size):
    """Texts that are cut into many slices and shards lose no phrase at their borders."""
    rnd = random.Random(5)
    docs = [("en", prose(rnd, 900)), ("en", prose(rnd, 3)), ("de", f" . {prose(rnd, 300)}"), ("en", "!" * 99), ("en", None), ("de", prose(rnd, 400).replace(" ", " . ")), ("de", "river stone blue " * 200)]
    monkeypatch.setattr(collocations, "PIECE", 97)
    given = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string").coalesce(1)
    stored = collocations.shards(given, size=size)
    made = stored.collect()
    assert len(made) > 20 or size > 50
    stored, by_hand = spark.createDataFrame(made, stored.schema), Counter()
    for n in range(1, 6):
        for lang, text in docs:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").lower()):
                words = piece.split()
                by_hand.update((lang, n, " ".join(words[i : i + n])) for i in range(len(words) - n + 1))
    assert {(r.lang, r["len"], r.phrase): r.n for r in collocations.phrase_counts(stored, [], 5).collect()} == by_hand
    totals = Counter()
    for r in made:
        totals.update(dict(zip(r.langs, r.totals, strict=True)))
    assert +totals == +Counter({x: sum(c for (y, n, _), c in by_hand.items() if (y, n) == (x, 1)) for x in ("en", "de")})


def test_suffix_array():
    rnd = np.random.default_rng(3)
    for n, kinds, depth in ((200, 3, 5), (50, 1, 5), (1, 2, 4), (300, 2, 7), (120, 4, 1)):
        ids = rnd.integers(1, kinds + 1, n).astype(np.int32)
        ids[rnd.random(n) < 0.1] = 0
        ids = np.concatenate([ids, np.zeros(depth, np.int32)])
        order, shared = collocations.suffix_array(ids, depth)
        run = lambda i: (*ids[i : i + depth].tolist(), *[0] * depth)[:depth]  # noqa: B023, E731
        assert sorted(order.tolist()) == list(range(len(ids)))
        assert [run(i) for i in order] == sorted(run(i) for i in order)
        for x in range(1, len(order)):
            p, q = run(order[x - 1]), run(order[x])
            assert shared[x] == next((j for j in range(depth) if p[j] != q[j]), depth)


def kept_by_hand(docs, window):
    """Rows in the order of ids, nulls last; ids are told apart here."""
    first, out = {}, {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    ranked = sorted(range(len(split)), key=lambda k: (split[k][0] is None, split[k][0]))
    for k in ranked:
        for s in range(len(split[k][1]) - window + 1):
            first.setdefault(tuple(split[k][1][s : s + window]), (split[k][0], s))
    for k, (i, words) in enumerate(split):
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] != (i, s):
                gone |= set(range(s, s + window))
        out[k] = (i, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    return sorted(out.values(), key=repr)


def passages(seed, n=60):
    rnd = random.Random(seed)
    shared = [prose(rnd, rnd.randrange(15, 60)) for _ in range(6)]
    made = []
    for i in range(n):
        parts = [prose(rnd, rnd.randrange(0, 40))]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(shared), prose(rnd, rnd.randrange(0, 12))]
        made.append((i, " ".join(parts)))
    made += [(100, made[4][1]), (101, made[4][1]), (-5, made[9][1]), (102, "a " * 500), (103, None), (104, ""), (105, "x"), (None, made[7][1]), (106, shared[0]), (106, shared[0])]
    return made


@pytest.mark.parametrize(("window", "most"), [(20, 1 << 20), (20, 0), (5, 1 << 20), (31, 0), (1, 1 << 20)])
def test_repeated_passages(spark, window, most):
    docs = passages(2)
    given = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, id string, tie long")
    assert rows(substring_dedup.remove_repeats(given, window, most=most)) == kept_by_hand(docs, window)


def test_ids_of_other_kinds(spark):
    docs = [(None if i is None else f"{i:04d}" if i >= 0 else "-", t) for i, t in passages(11)]
    given = spark.createDataFrame(docs, "name string, body string")
    assert rows(substring_dedup.remove_repeats(given, 20, "name", "body")) == kept_by_hand(docs, 20)
    ends = [(2**63 - 1, "a b c d"), (-(2**63), "x a b c d"), (None, "a b c d e")]
    found = substring_dedup.remove_repeats(spark.createDataFrame(ends, "doc_id long, text string"), 3)
    assert rows(found) == kept_by_hand(ends, 3)


def test_word_hashes(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(12)
    given = [None, "", " \n", "x", " a  b\tc\x0bd ", "é漢 \x85 \u3000z"] + ["".join(rnd.choice("ab \n\x1c") for _ in range(rnd.randrange(60))) for _ in range(300)]
    whole = pa.array(given, pa.string())
    seen = {}
    for piece in (1 << 20, 50):
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        for part in (whole, whole.slice(7, 90)):
            for text, found in zip(part.to_pylist(), substring_dedup.word_hashes(part), strict=True):
                words = (text or "").encode().split()
                assert len(found) == len(words) and all(seen.setdefault(w, h) == h for w, h in zip(words, found.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen) > 100


def test_texts_that_share_an_id_are_told_apart(spark):
    rnd = random.Random(8)
    long = prose(rnd, 50)
    given = spark.createDataFrame([(1, long), (1, f"{long} tail"), (None, f"head {long}"), (None, "other")], "doc_id long, text string")
    found = rows(substring_dedup.remove_repeats(given, 20))
    assert sorted(r[2] for r in found) == [0, 0, 50, 50]
    spans = substring_dedup.repeated_spans(given, 20).collect()
    assert sorted((s["begin"], s["end"]) for r in spans for s in r["spans"]) in ([(0, 50), (1, 51)],)


def test_every_cover_hits_every_distance():
    for v, cover in substring_dedup.COVERS.items():
        assert {(x - y) % v for x in cover for y in cover} == set(range(v))
    assert [substring_dedup.period(w) for w in (1, 13, 14, 20, 28, 50)] == [1, 1, 7, 13, 21, 31]
    with pytest.raises(ValueError, match="one word"):
        substring_dedup.period(0)


def test_rolling_hashes():
    words = np.random.default_rng(1).integers(0, 2**63, 90).astype(np.uint64)
    for width in (1, 2, 7, 20, 90, 91):
        by_hand = [sum(int(words[i + j]) * pow(12345677, width - 1 - j, 2**64) for j in range(width)) % 2**64 for i in range(90 - width + 1)]
        assert substring_dedup.rolling(words, width, 12345677).tolist() == by_hand


def aligned_by_hand(docs):
    """The contract, on whole texts by the libraries."""
    known = token_alignment.Aligner(A, B)
    per_doc, pairs = [], Counter()
    for i, text in docs:
        a = known.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = known.b.encode(text) if text else []
        pieces = [known.a_bytes[x] for x in a], [known.b_bytes[x] for x in b]
        if not text or b"".join(pieces[0]) != f" {text}".encode() or b"".join(pieces[1]) != f" {text}".encode():
            per_doc.append((i, 0, 0, [], Counter()))
            continue
        ends = [set(np.cumsum(list(map(len, p))).tolist()) for p in pieces]
        groups, at, sides = [], [0, 0], ([], [])
        x = y = 0
        for end in sorted(ends[0] & ends[1]):
            sides = ([], [])
            while at[0] < end:
                sides[0].append(a[x])
                at[0] += len(pieces[0][x])
                x += 1
            while at[1] < end:
                sides[1].append(b[y])
                at[1] += len(pieces[1][y])
                y += 1
            groups.append(sides)
        links = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        pairs.update(links.keys())
        per_doc.append((i, len(a), len(b), groups, links))
    top = Counter()
    for (p, _), n in pairs.items():
        top[p] = max(top[p], n)
    out = []
    for i, n_a, n_b, groups, links in per_doc:
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        best = sum(n for pair, n in links.items() if pairs[pair] == top[pair[0]])
        out.append((i, n_a, n_b, len(groups), sum(links.values()), best, sum(n * pairs[pair] for pair, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


ODD = ["a▁b is odd", "double  blanks   here \n\n x", "\tTabs\tand\r\nlines ", " leading", "<|endoftext|> </s> <s> plain", "\x00\x1c y \x85 z　 w", "日本語のテキスト 漢字かな交じり文 😀😀 👩‍👩‍👧", "'s 're don't I'll", "नमस्ते दुनिया", "yyyyyyyy" * 900, "١٢٣ 456 ७८"]


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_token_alignment(spark, monkeypatch, most):
    monkeypatch.setattr(token_alignment, "CHARS", 2000)
    docs = list(enumerate(texts(4, 25) + ODD)) + [(3, "repeated id"), (None, "no id"), (None, "no id")]
    given = spark.createDataFrame([(i, t, "clash", 7) for i, t in docs], "doc_id long, text string, n_a string, __pair long")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(token_alignment.aligned_links(given, A, B, most=most).select(*columns)) == aligned_by_hand(docs)


def test_segments_are_those_of_whole_texts():
    known = token_alignment.Aligner(A, B)
    rnd = random.Random(6)
    letters = " \n\t\x1c\x85　ab'sZ1.漢😀é▁<|>/-"
    for _ in range(300):
        given = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(5)]
        numbers, groups, *_ = known.align(given)
        for text, n, g in zip(given, numbers, groups, strict=True):
            a, b = known.a.encode(f" {text}", add_special_tokens=False).ids, known.b.encode(text)
            same = [b"".join(t[i] for i in ids) for t, ids in ((known.a_bytes, a), (known.b_bytes, b))] == [f" {text}".encode()] * 2
            if not text or not same:
                assert n.tolist() == [0, 0, 0, 0] and g == ""
            else:
                parts = [p.split("|") for p in g.split(";")]
                assert [i for p in parts for i in map(int, p[0].split(","))] == a and [i for p in parts for i in map(int, p[1].split(","))] == b
        if rnd.random() < 0.1:
            known.forget(2)


def test_large_groups_and_clearing(monkeypatch):
    known = token_alignment.Aligner(A, B)
    given = [t for t in texts(9, 20) if t]
    plain = known.align(given)
    monkeypatch.setattr(token_alignment, "SMALL_GROUP", 0)
    monkeypatch.setattr(token_alignment, "CACHED", 3000)
    for _ in range(3):
        again = known.align(given)
        assert plain[1] == again[1] and all(np.array_equal(x, y) for x, y in zip((plain[0], *plain[2:]), (again[0], *again[2:]), strict=True))


@pytest.mark.parametrize("name", ["op11_collocations", "op12_substring_dedup", "op13_token_alignment"])
def test_empty_tables_and_sql(spark, tmp_path, name):
    for folder, made in (("none", EMPTY), ("some", [(i, t, None if i % 5 == 0 else "en", "s", 0) for i, t in passages(3)[:-3]])):
        many = made * 40 if name == "op11_collocations" else made
        spark.createDataFrame(many, SCHEMA).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        found = queries.queries()[name](spark, f"{tmp_path}/{folder}")
        if name in queries.oracle_sql():
            con = duckdb.connect()
            con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{folder}/documents.parquet/*.parquet'")
            by_sql = con.sql(f"SELECT {', '.join(found.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
            assert rows(found) == sorted(by_sql, key=repr) and bool(by_sql) == bool(made)
        else:
            assert found.count() == len(made)
