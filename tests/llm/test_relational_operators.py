import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F


from tessera.llm import chat_format, mixing, quality_bayes, queries, url_filter
from tessera.llm.words import BASE
from tests.llm.data import EMPTY, documents, prose


def tables(monkeypatch, **found):
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: found[name])


def in_duckdb(sql, **found):
    con = duckdb.connect()
    for name, df in found.items():
        con.register(f"{name}_a", df.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_a")
    done = con.execute(sql)
    columns = [c[0] for c in done.description]
    return sorted(map(repr, ([dict(zip(columns, r, strict=True))[c] for c in sorted(columns)] for r in done.fetchall())))


def plain(df):
    return sorted(map(repr, ([r[c] for c in sorted(df.columns)] for r in df.collect())))


# URL filters


def pages(spark):
    rnd = random.Random(3)
    link = lambda u: f'<html><head><link href="{u}" rel="canonical"></head>'
    rows = [
        (1, "https://a.example.net/x", link("http://b.example.org/es/1")), (2, "http://c.example.net/y?q=1", '<meta http-equiv="refresh" content="0; url=https://a.example.net/x">'),
        (3, "http://d.example.net/", link("/z")), (4, "http://d.example.net/z#f", link("http://shop.com/de/4")), (5, "http://d.example.net/other", None),
        (6, None, "<p>"), (7, "no scheme", link("http://example.org/en/1")), (8, "HTTP://WWW.Example.ORG/en/12", ""), (9, "http://q.com/fr/de/", link("http://a.example.net/x")),
        (10, "http://notexample.org/es/", ""), (11, "://", ""), (12, "http://example.com", ""), (13, "x://h/p://q/r?s#t", ""), (14, "http://e.net/1", link("http://f.net/2?a=1&amp;b=2")), (15, "http://f.net/2?a=1&b=2", link("//example.org/en/1x")),
        (16, "http://up.net/1", link("http://example.org/fine")), (17, "http://up.net/2", link("http://up.net/1")), (18, "http://up.net/3", link("http://shop.com/de/9")), (19, "http://up.net/3", link("http://up.net/2")),
    ]
    rows += [(100 + i, f"http://h{rnd.randrange(8)}.net/{rnd.randrange(5)}", link(f"http://h{rnd.randrange(8)}.{rnd.choice(['net', 'com', 'org'])}/{rnd.choice(['de', 'fr', '1', '2'])}/")) for i in range(60)]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows + rows[:2]], "page_id long, url string, html string, host string, verdict string")


def test_urls_equal_sql(spark, monkeypatch):
    df = pages(spark)
    tables(monkeypatch, pages=df)
    got = queries.url_filters(spark, "")
    assert plain(got) == in_duckdb(queries.URLS_SQL, pages=df.select("page_id", "url", "html"))
    by = {r.page_id: r for r in got.collect()}
    assert (by[1].verdict, by[1].by_class, by[2].verdict) == ("allow", True, "allow")  # a page of the class is allowed explicitly
    assert (by[3].verdict, by[4].verdict, by[5].verdict) == ("block", "block", "allow")
    assert (by[6].host, by[6].path, by[6].rule, by[6].verdict) == ("", "", None, "allow")
    assert (by[8].host, by[8].rule, by[8].verdict) == ("www.example.org", "example.org/en/1", "block")
    assert (by[10].rule, by[13].host, by[13].path) == ("org/", "h", "/p://q/r")
    assert (by[14].verdict, by[15].verdict) == ("block", "block")
    assert by[17].verdict == by[18].verdict == "allow"  # allow goes before block in a class
    tables(monkeypatch, pages=df.where("false"))
    assert queries.url_filters(spark, "").count() == 0


def test_long_rule_lists_give_the_same(spark, monkeypatch):
    df = pages(spark)
    few = url_filter.filter_urls(df, queries.URL_RULES)
    monkeypatch.setattr(url_filter, "COMPILED", 1)
    assert plain(url_filter.filter_urls(df, queries.URL_RULES)) == plain(few)


def test_redirect_table(spark):
    df = spark.createDataFrame([(1, "http://x.net/1"), (2, "http://x.net/2")], "page_id long, url string")
    hops = spark.createDataFrame([("http://x.net/1", "http://y.net/a"), ("http://y.net/a", "http://bad.com/de/"), (None, "http://x.net/2")], "src string, dst string")
    got = url_filter.filter_urls(df, queries.URL_RULES, hops, html_col=None)
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow"}


def test_relative_targets(spark):
    want = {
        "g": "http://a.net/b/c/g", "./g": "http://a.net/b/c/g", "g/": "http://a.net/b/c/g/", "/g": "http://a.net/g", "//g.net/x": "http://g.net/x", "?y=1&amp;z": "http://a.net/b/c/d.html?y=1&z",
        "g?y#s": "http://a.net/b/c/g?y#s", "..": "http://a.net/b/", "../": "http://a.net/b/", "../g": "http://a.net/b/g", "../..": "http://a.net/", "../../../g": "http://a.net/g", "/./g": "http://a.net/g",
        ".": "http://a.net/b/c/", "./g/.": "http://a.net/b/c/g/", "g/../h": "http://a.net/b/c/h", "g?y=../x": "http://a.net/b/c/g?y=../x", "go?to=http://b.net/": "http://a.net/b/c/go?to=http://b.net/",
        "https://x.org/a/../b": "https://x.org/a/../b", "#top": None, "mailto:me": None,
    }
    rows = [(t, "http://a.net/b/c/d.html?q#f", f'<link rel="canonical" href="{t}">') for t in want]
    rows += [("bare", "http://a.net", '<meta http-equiv="refresh" content="0; url=index.html">'), ("none", "no scheme", '<link rel="canonical" href="g">')]
    df = spark.createDataFrame(rows, "target string, url string, html string")
    got = {r.target: r.found for r in df.select("target", url_filter.page_targets(F.col("url"), F.col("html")).alias("found")).collect()}
    assert got == {t: [u] if u else [] for t, u in want.items()} | {"bare": ["http://a.net/index.html"], "none": []}


def test_attributes_are_read_one_by_one(spark):
    want = {
        "<link rel=stylesheet href=http://shop.com/de/canonical.css>": [], '<link title="rel=canonical" href="http://x.net/">': [], "<link rel=canonical href=http://x.net/a?b=c>": ["http://x.net/a?b=c"],
        "<LINK HREF='http://x.net/1' data-href='http://no.net/' REL='Next CANONICAL'>": ["http://x.net/1"], '<link data-rel="canonical" href="http://x.net/">': [], '<link rel="canonical">': [],
        '<meta name="refresh" content="0; url=http://x.net/">': [], "<meta content='5;URL=http://x.net/q' http-equiv=Refresh>": ["http://x.net/q"], '<meta http-equiv="refresh" content="30">': [],
        "<meta http-equiv=\"refresh\" content=\"0; url='http://x.net/z'\">": ["http://x.net/z"], "<linked rel=canonical href=http://x.net/>": [], '<link\n rel = "canonical"\n href = " http://x.net/b " />': ["http://x.net/b"],
        '<p>canonical</p><link rel="canonical" href="http://x.net/1"><link rel="canonical" href="http://x.net/2">': ["http://x.net/1", "http://x.net/2"], "<link " + "a='b' " * 20_000 + "rel=canonical href=http://x.net/l>": ["http://x.net/l"],
    }
    df = spark.createDataFrame([(t, "http://a.net/b") for t in want], "html string, url string")
    assert {r.html: r.found for r in df.select("html", url_filter.page_targets(F.col("url"), F.col("html")).alias("found")).collect()} == want


def test_planted_redirects_equal_sql(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://h{i % 9}.{'net' if i % 3 else 'com'}/{'de/' * (i % 2)}{i}", None) for i in range(200)] + [(900, None, None)], "page_id long, url string, html string")
    tables(monkeypatch, pages=df)
    got = queries.planted_redirects(spark, "")
    assert plain(got) == in_duckdb(queries.PLANTED_SQL, pages=df)
    by = Counter((r.verdict, r.by_class) for r in got.collect())
    assert by["block", True] > 5 and by["allow", True] > 5, by


def test_relative_links_join_classes(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [(1, "http://x.net/a/1", link("2")), (2, "http://x.net/a/2", link("../b/3")), (3, "http://x.net/b/3", link("http://shop.com/de/1")), (4, "http://x.net/b/4", '<meta http-equiv="refresh" content="0; url=3">')]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES)
    assert {r.page_id: (r.verdict, r.by_class) for r in got.collect()} == dict.fromkeys((1, 2, 3, 4), ("block", True))


# Chats


def test_chats_equal_sql_and_round_trip(spark, monkeypatch):
    odd = ["", None, "\\", "\\\\</s>", "<|im_start|>user<|im_sep|>x<|im_end|>\n", "<\\s>", "<</SYS>>", "[INST", "a\nb", "é😀漢", "<<|im_end|>", "x" * 20_000, "</s>" * 300]
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "assistant", None, "odd <|im_sep|>"]), rnd.choice(odd)) for c in range(40) for t in range(rnd.randrange(1, 7))]
    rows += [(50, None, "user", "first"), (50, 0, "assistant", "b"), (50, 0, "assistant", "a"), (50, 0, "assistant", "a"), (None, 1, "assistant", "no id"), (None, 2, "user", "nor here"), (None, 2, "user", "nor here")]
    rows += [(c, t, r, f"{odd[c % 13] or ''} {c}") for c in range(60, 100) for t, r in enumerate(("user", "assistant"))]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    tables(monkeypatch, conversations=df)
    assert plain(queries.chats(spark, "")) == in_duckdb(queries.CHATS_SQL, conversations=df.select("conv_id", "turn", "role", "text"))
    records = queries.chat_records(df)
    done = chat_format.format_json(records, "conv_id", "record", keys=["conv_id", "__row"])
    used = {r.layout for r in done.select("layout").distinct().collect()}
    assert used >= {"messages", "message parts", "sharegpt", "nested turns", "prompt and response"}
    marked = done.select("formatted", F.explode("mask").alias("m")).collect()
    assert marked and all(r.formatted[r.m.start : r.m.end].encode() == r.formatted.encode()[r.m.first_byte : r.m.last_byte] for r in marked)
    done = done.select("conv_id", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want[c].append((r or "", x or ""))
    for r in done.where("conv_id is not null").collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")
    assert sorted(tuple(r.turns[0]) for r in done.where("conv_id is null").collect()) == [("assistant", "no id"), ("user", "nor here"), ("user", "nor here")]
    tables(monkeypatch, conversations=df.where("false"))
    assert [r.conv_id for r in queries.chats(spark, "").collect()] == [-1]


def test_layouts_by_fingerprint(spark):
    known = list(chat_format.LAYOUTS)
    prints = [chat_format.fingerprint_of(p) for v in chat_format.LAYOUTS.values() for p in chat_format.paths_of(v)]
    assert len(set(prints)) == len(prints) - 1  # two layouts share their empty list
    rows = [(i, chat_format.example_record(n)) for i, n in enumerate(known)]
    first_without = '{"messages": [{"role": "system"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": null}]}'
    rows += [(90, "no json"), (91, None), (92, "[1]"), (93, '{"other": 1}'), (94, '{"prompt": "p", "response": "r", "id": 7, "meta": {"a": [1]}}'), (95, '{"messages": []}'), (96, first_without)]
    rows += [(97, '{"prompt": "p", "response": "r", "messages": []}'), (98, '{"messages": [{"role": "user", "content": "a", "weight": 1}]}'), (98, chat_format.example_record("messages")), (None, chat_format.example_record("dialog")), (None, "{}")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id long, record string, layout string, formatted string")
    got = {}
    for r in chat_format.format_json(df, "id", "record").withColumn("turns", chat_format.read_back(F.col("formatted"))).collect():
        got.setdefault(r.id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)  # nothing is dropped
    assert [got[i][0].layout for i in range(len(known))] == known
    assert all([t.role for t in got[i][0].turns][-1] == "assistant" for i in range(len(known)))
    assert [tuple(t) for t in got[known.index("message parts")][0].turns] == [tuple(t) for t in got[known.index("nested turns")][0].turns] == [("user", "a"), ("assistant", "b")]
    assert [got[i][0].layout for i in (90, 91, 92, 93, 94, 97)] == [None, None, None, None, "prompt and response", None]
    assert (got[95][0].formatted, got[95][0].mask) == ("", []) and got[95][0].layout in ("messages", "message parts")
    assert [tuple(t) for t in got[96][0].turns] == [("system", ""), ("user", "q"), ("assistant", "")]
    assert sorted(str(r.layout) for r in got[98]) == ["None", "messages"] and sorted(str(r.layout) for r in got[None]) == ["None", "dialog"]
    assert all(r.formatted is None and r.mask is None for x in got.values() for r in x if r.layout is None)


def test_field_paths_are_nested(spark):
    cases = {
        '{"a": {"b": [{"c": 1}, {"d": [[true], [{"e": "x"}]]}]}, "f": null}': ["a.b[].c", "a.b[].d[][]", "f"],
        '{"x y": "q\\": {[,", "`t`": {"u": "\\\\"}, "STRING": ["a: b", 1.5]}': ["STRING[]", "`t`.u", "x y"],
        '{"m": [{"k": "' + "long: {\\u0022 " * 200_000 + '"}], "n": {}}': ["m[].k"], "{}": [], "[1]": None, "x": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "record string")
    got = {r.record: r.p for r in df.select("record", chat_format.field_paths(F.col("record")).alias("p")).collect()}
    assert got == cases


def test_one_long_conversation_is_linear(spark):
    """A text beyond the parser's usual bound, and very many turns."""
    rows = [(1, 0, "user", "é" * 22_000_000), (1, 1, "assistant", "ok")] + [(2, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat_format.format_json(queries.chat_records(df), "conv_id", "record", keys=["conv_id", "__row"])
    got = {r.conv_id: r for r in done.select("conv_id", "layout", F.size(chat_format.read_back(F.col("formatted"))).alias("n"), F.length("formatted").alias("chars"), chat_format.masked_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    assert (got[1].n, got[1].loss, got[2].n) == (2, "ok", 30_000) and got[1].chars > 22_000_000
    assert got[2].loss == "".join(f"turn {i}" for i in range(1, 30_000, 2))


# Mixing


def plain_targets(sizes, weights, share, most):
    """One source at a time goes to its limit, the one furthest above it first."""
    found, left, total = {}, dict(sizes), share * sum(sizes.values())
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [weights[i % len(weights)] for i in range(len(sizes))], strict=True))
    while left:
        now = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        worst = max(left, key=lambda s: now[s] - most * left[s])
        if now[worst] <= most * left[worst]:
            return found | now
        found[worst] = most * left.pop(worst)
        total -= found[worst]
    return found


def test_targets(spark):
    rnd = random.Random(4)
    cases = [{}, {"a": 0, None: 0}, {"a": 100, "b": 10, "c": 40, "d": 50}, {"Z": 5, "a": 1, "é": 900, None: 40}]
    cases += [{f"s{i}": int(10 ** rnd.uniform(0, 6)) for i in range(200)}]
    for sizes in cases:
        for weights, share, most in (((3, 1, 2), 1.5, 2.0), ((1, 100), 3.0, 2.0))[: 1 + len(sizes) // 200]:
            sums = spark.createDataFrame(list(sizes.items()), "__source string, source_size long")
            got = {r["__source"]: r.target for r in mixing.targets(sums, weights, share, most).collect()}
            assert got == pytest.approx(plain_targets(sizes, weights, share, most))


def test_fit_counts_finds_exact_sums():
    rnd = random.Random(9)
    for _ in range(150):
        counts = {rnd.randrange(1, 30): rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 9))}
        whole = sum(n * c for n, c in counts.items())
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = rnd.randrange(whole + 1)
        taken = mixing.fit_counts(counts, budget)
        got = sum(n * c for n, c in taken.items())
        assert all(0 <= c <= counts[n] for n, c in taken.items())
        assert got <= budget and budget - got <= max(counts)
        if budget in sums and whole <= 4 * max(counts):
            assert got == budget
    assert mixing.fit_counts({3: 1000, 5: 1000}, 4001) and sum(n * c for n, c in mixing.fit_counts({3: 1000, 5: 1000}, 4001).items()) == 4001


def test_mixture(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(i, prose(rnd, rnd.randrange(0, 40)) if i % 9 else None, "en", rnd.choice(["a", "b", "b", "b", "Z", None]), 0) for i in range(400)]
    rows += [(1000 + i, "same size here", "en", "hot", 0) for i in range(300)]
    df = documents(spark, rows)
    tables(monkeypatch, documents=df)
    got = queries.mixture(spark, "").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.mixture(spark, "").collect()))
    assert len(got) == df.count()
    source = {r[0]: r[3] for r in rows}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert all(r.source_size == size[source[r.doc_id]] for r in got)
    assert target == pytest.approx(plain_targets(size, (3, 1, 2), 1.5, 2.0))
    assert all(abs(taken[s] - target[s]) <= 3 for s in size)
    made = mixing.mix(df)
    assert made.columns == df.columns
    want = Counter()
    for r in got:
        want[r.doc_id] += r.taken
    assert Counter({i: n for i, n in want.items() if n}) == sum((Counter({r.doc_id: len((r.text or "").split())}) for r in made.collect()), Counter())
    assert plain(queries.mixture_targets(spark, "")) == in_duckdb(queries.TARGETS_SQL, documents=df.select("doc_id", "text", "source"))
    tables(monkeypatch, documents=documents(spark, EMPTY))
    assert queries.mixture(spark, "").count() == 0


def test_mixture_of_repeated_and_null_ids(spark):
    rows = [(7, f"one length w{i}", "en", "a", 0) for i in range(40)] + [(None, f"no id here w{i}", "en", "b", 0) for i in range(40)]
    rows += [(9, "copies of one row", "en", "c", 0)] * 30 + [(9, "copies of one row", "de", "c", 0)] * 10 + [(i, f"unique w{i}", "en", "c", 0) for i in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for weights, share in (((3, 1, 2), 1.5), ((1, 5, 3), 0.4), ((1, 1, 4), 1.1)):
        planned = mixing.plan(df, weights, share).collect()
        made = mixing.mix(df, weights, share).collect()
        assert len(planned) == len(rows)
        named, want, target = {120: "a", 160: "b", 220: "c"}, Counter(), {}
        for r in planned:
            want[named[r.source_size]] += r.taken
            target[named[r.source_size]] = r.target
        size = Counter()
        for r in made:
            size[r.source] += len(r.text.split())
        assert all(size[s] == want[s] and abs(size[s] - target[s]) <= 4 for s in "abc")
        distinct = Counter((r.doc_id, r.text) for r in made if r.source != "c")
        for source in "ab":
            copies = [distinct[i, t] for i, t, _, s, _ in rows if s == source]
            assert max(copies) - min(copies) <= 1
        assert Counter(made) == Counter(mixing.mix(df, weights, share).collect())


# Quality classifier


def test_quality_on_held_out_rows(spark):
    rnd = random.Random(21)
    rows, labels = [], []
    for i in range(600):
        good = rnd.random() < 0.8
        text = prose(rnd, rnd.randrange(15, 90))
        rows.append((i, text if good else " | ".join(w.upper() + "!!" for w in text.split()), "en", f"s{i % 5}" if i % 50 else None, 0))
        if i < 300:
            labels.append((i, int(good)))
    rows += [(900, None, None, None, 0), (901, "", "en", "s1", 0), (902, prose(rnd, 20_000), "en", "rare", 0)]
    good = {r[0]: "!!" not in (r[1] or "") for r in rows}
    df, marks = documents(spark, rows), spark.createDataFrame([*labels, (5000, 1), (901, None)], "doc_id long, quality int")
    done = queries.quality_scores(df, marks, carry=df.columns)
    got = done.collect()
    assert len(got) == df.count() and set(df.columns) < set(done.columns)
    held = [r for r in got if 300 <= r.doc_id < 600]
    assert sum(r.quality_kept == good[r.doc_id] for r in held) >= 0.98 * len(held)
    assert next(r.quality_kept for r in got if r.doc_id == 902)
    narrow = {r.doc_id: r.log_odds for r in queries.quality_scores(df, marks).collect()}
    assert all(narrow[r.doc_id] == pytest.approx(r.log_odds) for r in got)
    empty = documents(spark, EMPTY)
    for docs, labels in ((empty, marks), (empty, marks.where("false")), (df, marks.where("false")), (df, marks.where("quality = 1"))):
        undecided = queries.quality_scores(docs, labels).collect()
        assert len(undecided) == docs.count() and all(r.quality_kept and abs(r.log_odds) < 1e-9 for r in undecided)
        assert queries.keep_quality(docs, labels).count() == docs.count()


def plain_features(text):
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text or ""), [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n, chars = len(words), len(text or "")
    of = lambda pattern: len(regex.findall(pattern, text or ""))
    per = lambda a, b: a / max(b, 1)
    return [
        math.log1p(n) / 5, min(per(chars, n), 40) / 10, per(of(r"\p{Lu}"), chars) * 5, min(per(of("[#*$%&<>]"), n), 3), min(per(of("[!?]"), n), 3), per(of("[0-9]"), chars) * 5,
        min(per(of(r"\|"), n) * 3, 3), per(len(set(words)), n), 1 - per(len(set(lines)), len(lines)), math.log1p(per(n, len(lines))) / 3,
    ]


def plain_mixed(h):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> shift) * factor % 2**64
    return h ^ h >> 31


def plain_grams(text):
    """Shares of 512 buckets of hashed words and pairs, times their scale."""
    bits = [plain_mixed(b + 1) for b in range(256)]
    words = [plain_mixed(sum(bits[c] * pow(BASE, i, 2**64) for i, c in enumerate(w)) % 2**64) for w in (text or "").encode().lower().split()]
    grams = words + [plain_mixed((a * BASE + b) % 2**64) for a, b in zip(words, words[1:], strict=False)]
    found = np.zeros(512)
    for g in grams:
        found[g >> 55] += 1
    return found / max(len(grams), 1) * 20


def strength(sites):
    """Pseudo-counts from (n, rate, mean)."""
    whole = sum(n * m * (1 - m) for n, _, m in sites)
    between = max(sum(n * (r - m) ** 2 for n, r, m in sites) - sum(m * (1 - m) for _, _, m in sites), 0) / whole
    return min(max(1 / max(between, 1e-6) - 1, 1), 1e4)


def plain_quality(rows, known):
    """Log-odds of rows (id, text, path, host, ...) by the labels known of some ids."""
    x = np.array([plain_features(r[1]) for r in rows])
    fit = [i for i, r in enumerate(rows) if r[0] in known]
    means, scales = x[fit].mean(0), np.maximum(x[fit].std(0), 1e-6)
    grams = np.array([plain_grams(r[1]) for r in rows])
    z, y = np.column_stack([(x - means) / scales, grams, np.ones(len(x))]), np.array([known[rows[i][0]] for i in fit], float)
    rough = np.column_stack([z[fit, :10], np.float16(grams[fit] / 20).astype(float) * 20, np.ones(len(fit))])  # the fit has shares in half precision
    w = np.zeros(z.shape[1])
    penalty = np.array([1.0] * (z.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-rough @ w))
        w -= np.linalg.solve((rough.T * (p * (1 - p))) @ rough + np.diag(penalty), rough.T @ (p - y) + penalty * w)
    odds = np.clip(z @ w, -12, 12)
    p = 1 / (1 + np.exp(-odds))
    hosts, paths = defaultdict(list), defaultdict(list)
    for r, v in zip(rows, p, strict=True):
        hosts[r[3]].append(v), paths[r[3], r[2]].append(v)
    mean = p.mean()
    s1 = strength([(len(v), np.mean(v), mean) for v in hosts.values()])
    posterior = {h: (sum(v) + s1 * mean) / (len(v) + s1) for h, v in hosts.items()}
    s2 = strength([(len(v), np.mean(v), posterior[k[0]]) for k, v in paths.items()])
    found = []
    for r, o, v in zip(rows, odds, p, strict=True):
        host, path = hosts[r[3]], paths[r[3], r[2]]
        rate = (sum(path) - v + s2 * (sum(host) - v + s1 * mean) / (len(host) - 1 + s1)) / (len(path) - 1 + s2)
        found.append(o + 0.5 * (math.log(rate / (1 - rate)) - math.log(mean / (1 - mean))))
    return found


def test_quality_query_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        good = rnd.random() < (0.9 if i % 3 else 0.4)
        text = prose(rnd, rnd.randrange(5, 60))
        host = rnd.choice(["big", "big", "big", "mid", None, f"sparse{i}"])  # a sixth of the hosts have one document
        rows.append((i, text if good else " | ".join(w.upper() + "!" * rnd.randrange(3) for w in text.split()), rnd.choice(["en", "de", None]), host, 0))
        if i % 2:
            labels.append((i, int(good) if rnd.random() < 0.95 else int(not good)))
    rows += [(900, None, "en", "big", 0), (901, "", None, None, 0), (902, "é\n\né\n!", "de", "mid", 0), (None, "no id", "en", "big", 0)]
    df = spark.createDataFrame([(*r, 1, 2.0, True) for r in rows + rows[:3]], "doc_id long, text string, lang string, source string, n_chars long, n int, good double, host_n boolean")
    tables(monkeypatch, documents=df, labels=spark.createDataFrame(labels, "doc_id long, quality int"))
    every = rows + rows[:3]
    want = [(r[0], v) for r, v in zip(every, plain_quality(every, dict(labels)), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, r.log_odds) for r in queries.quality(spark, "").collect()), key=key)
    want.sort(key=key)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [v for _, v in got] == pytest.approx([v for _, v in want], abs=1e-6)
    kept = queries.keep_quality(df, queries.table(spark, "", "labels"))
    assert kept.columns == df.columns and kept.count() == sum(v >= -1 for _, v in want)
    known_docs = df.dropDuplicates(["doc_id"])
    tables(monkeypatch, documents=known_docs, labels=queries.table(spark, "", "labels"))
    assert plain(queries.site_posteriors(spark, "")) == in_duckdb(queries.SITES_SQL, documents=known_docs, labels=queries.table(spark, "", "labels"))


def test_words_tell_texts_that_look_alike(spark):
    """Texts of the same shape, which no surface feature parts: the words decide."""
    rnd = random.Random(31)
    kinds = (("river", "stones", "walked", "bluest"), ("bonus", "casino", "winner", "cheaps"))
    rows = [(i, " ".join(rnd.choice(kinds[i % 2]) for _ in range(40)), "en", f"s{i % 3}", 0) for i in range(400)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    got = queries.quality_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), labels).collect()
    assert all(r.quality_kept == (r.doc_id % 2 == 0) for r in got if r.doc_id >= 200)


def test_sites_change_decisions(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "t", "en" if i % 3 else None, f"s{i % 4}", 0) for i in range(700)], "doc_id long, text string, lang string, source string, n_chars long")
    tables(monkeypatch, documents=docs)
    done = queries.site_decisions(spark, "")
    assert plain(done) == in_duckdb(queries.DECISIONS_SQL, documents=docs)
    rows = done.collect()
    dense, sparse = ([r for r in rows if r.host.startswith("sparse") == x] for x in (False, True))
    assert any(r.text_kept and not r.kept for r in dense) and any(r.kept and not r.text_kept for r in dense)
    assert sparse and all(r.kept == r.text_kept for r in sparse)


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 0.9)] * 300 + [("big", "q", 0.1)] * 100 + [("tiny", "p", 0.0)]
    prior, sites = quality_bayes.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r.host, r.path): r for r in sites.collect()}
    assert prior.mean == pytest.approx((270 + 10) / 401)
    big = got["big", "p"]
    assert big.n == 300 and abs(big.host_posterior - 0.7) < 0.01
    assert 0.0 < got["tiny", "p"].host_posterior < prior.mean
