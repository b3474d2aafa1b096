"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import additive_ann, byte_bpe, chat_format, collocations, mixing, ngram_jaccard, pii, quality_bayes, quality_rules, substring_dedup, token_alignment, token_counts, url_filter
from tessera.plans.shared import written
from tessera.session import table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"
BYTE_FILE = "byte_bpe_50k.json"
TOKEN_LIMIT = 4096

#: (action, host, path)
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def planted_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with links planted in them, and hops between hubs, so that classes decide."""
    n = F.col("page_id")
    link = F.when(n % 4 == 0, F.concat(F.lit('<link title="rel=canonical" rel="next Canonical" href="/hub/../hub'), (n % 7).cast("string"), F.lit('/./x?a=1&amp;b=2">')))
    link = link.when(n % 4 == 1, F.concat(F.lit("<meta content='0; url=http://hub"), (n % 11).cast("string"), F.lit(".net/x' http-equiv=refresh>")))
    link = link.when(n % 4 == 2, F.lit("<link rel=stylesheet href=http://shop.com/de/canonical.css>")).otherwise(F.concat(F.lit("<link href=//hub"), (n % 5).cast("string"), F.lit(".net/x rel=canonical>")))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.when(n % 2 == 0, F.concat(F.lit("http://site"), (n % 13).cast("string"), F.lit(".net/a/"), n.cast("string"))).otherwise(F.col("url")), F.lit("")).alias("url"), link.alias("html"))
    j = F.col("id")
    end = F.when(j % 3 == 0, F.concat(F.lit("http://shop.com/de/"), j.cast("string"))).when(j % 3 == 1, F.concat(F.lit("http://www.example.org/ok/"), j.cast("string"))).otherwise(F.concat(F.lit("http://plain.net/"), j.cast("string")))
    hops = spark.range(11).select(F.concat(F.lit("http://hub"), j.cast("string"), F.lit(".net/x")).alias("src"), end.alias("dst"))
    hops = hops.unionByName(spark.range(7).select(F.concat(F.lit("https://site3.net/hub"), j.cast("string"), F.lit("/x?a=1&b=2")).alias("src"), F.concat(F.lit("http://hub"), (j + 4).cast("string"), F.lit(".net/x")).alias("dst")))
    return url_filter.filter_urls(pages, URL_RULES, hops)


def quality_scores(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """A document's host is its source, and its path the language section in it."""
    model = quality_bayes.fit_text_model(docs, labels)
    return quality_bayes.score(docs, model, F.col("source"), F.col("lang"), carry=carry)


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_bayes.keep(docs, quality_bayes.fit_text_model(docs, labels), F.col("source"), F.col("lang"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def site_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy of priors over labelled documents, with the labels as evidence."""
    known = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("p"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"))
    _, sites = quality_bayes.site_posteriors(docs.join(known, "doc_id"))
    return sites.select("host", "path", "n", "host_n", *(F.round(c, 9).alias(c) for c in ("good", "host_good", "host_posterior", "path_posterior")))


def site_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sites do to given evidence: one host in eleven has a single document; most documents of the others are clear, and a fifth is in doubt."""
    n = F.col("doc_id")
    clear = F.when(F.pmod(F.regexp_extract("source", "([0-9]+)", 1).cast("int"), F.lit(2)) == 0, 3.0).otherwise(-3.0)
    host = F.when(n % 11 == 0, F.concat(F.lit("sparse"), n.cast("string"))).otherwise(F.col("source"))
    odds = F.when(n % 5 == 0, ((n % 7) - 4) / 2 + 0.1).otherwise(clear)
    judged = quality_bayes.with_sites(written(table(spark, sf_dir, "documents").select("doc_id", host.alias("host"), F.col("lang").alias("path"), odds.alias("odds")), "odds"))
    return judged.select("doc_id", "host", (F.col("odds") >= quality_bayes.KEEP_LOG_ODDS).alias("text_kept"), "kept", F.round("log_odds", 6).alias("log_odds"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"), (3, 1, 2), 1.5, 2.0)


def mixture_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets alone, which SQL can tell."""
    return mixture(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def byte_bpe_digests(docs: DataFrame) -> DataFrame:
    back = byte_bpe.round_trip(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(table(spark, sf_dir, "documents"))


def chat_records(turns: DataFrame) -> DataFrame:
    """Conversations as JSON records of five layouts, dealt by a hash of their ids: ``(conv_id, __row, record)``."""
    folded = chat_format.fold_turns(turns, "conv_id", "turn", "role", "text")
    said = F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    folded = folded.withColumn("turns", said).withColumn("dealt", F.pmod(F.xxhash64("conv_id"), F.lit(5)))
    plain = F.forall("turns", lambda t: t["role"].isin("user", "assistant", "system"))
    pair = (F.size("turns") == 2) & (F.get("turns", F.lit(0))["role"] == "user") & (F.get("turns", F.lit(1))["role"] == "assistant")
    listed = lambda f: F.transform("turns", f)
    name = lambda r: F.when(r == "user", F.lit("human")).when(r == "assistant", F.lit("gpt")).otherwise(r)
    messages = F.struct(listed(lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))
    parts = F.struct(listed(lambda t: F.struct(t["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), t["text"].alias("text"))).alias("content"))).alias("messages"))
    share = F.struct(listed(lambda t: F.struct(name(t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations"), F.lit(1).alias("score"))
    prompt = F.struct(F.get("turns", F.lit(0))["text"].alias("prompt"), F.get("turns", F.lit(1))["text"].alias("response"))
    nested = F.struct(F.struct(listed(lambda t: F.struct(F.struct(t["role"].alias("role")).alias("author"), t["text"].alias("message"))).alias("turns")).alias("conversation"))
    dealt = F.col("dealt")
    record = F.when((dealt == 0) & plain, F.to_json(share)).when((dealt == 1) & pair, F.to_json(prompt)).when(dealt <= 2, F.to_json(parts)).when(dealt == 3, F.to_json(nested)).otherwise(F.to_json(messages))
    return folded.select("conv_id", "__row", record.alias("record"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.arrays_zip(F.array(F.lit(0), F.lit(1)).cast("array<bigint>").alias("turn"), F.array(F.lit("user"), F.lit("assistant")).alias("role"))).alias("t"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    ).select("conv_id", "t.turn", "t.role", "text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    done = chat_format.format_json(chat_records(turns), "conv_id", "record", keys=["conv_id", "__row"])
    turns_back = chat_format.read_back(F.col("formatted"))
    done = done.select("conv_id", "layout", "formatted", turns_back.alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed_rules"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    spans = lambda f: F.array_join(F.transform(F.filter("found", f), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(spans(lambda s: s["kind"].isin(*pii.BASE)), 256).alias("base_sha256"), spans(lambda s: F.lit(True)).alias("spans"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_FILE), TOKEN_LIMIT)


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), 100, 5, 2000, 100)


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned_links(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_FILE), public_tokenizers.path(PIECE_FILE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": near_duplicates,
        "op2_url_filters": url_filters,
        "op3_quality_classifier": quality,
        "op4_additive_ann": neighbours,
        "op5_source_mixing": mixture,
        "op6_byte_bpe": byte_bpe_round_trip,
        "op7_chat_formatting": chats,
        "op8_quality_rules": rules,
        "op9_personal_data": personal_data,
        "op10_token_counts": tokens,
        "op11_collocations": phrases,
        "op12_substring_dedup": repeats,
        "op13_token_alignment": alignment,
        "op2_redirects": planted_redirects,
        "op3_site_posteriors": site_posteriors,
        "op3_site_decisions": site_decisions,
        "op5_targets": mixture_targets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": NEAR_SQL, "op2_url_filters": URLS_SQL, "op2_redirects": PLANTED_SQL, "op7_chat_formatting": CHATS_SQL, "op8_quality_rules": RULES_SQL, "op3_site_posteriors": SITES_SQL, "op3_site_decisions": DECISIONS_SQL, "op5_targets": TARGETS_SQL, "op11_collocations": PHRASES_SQL, "op12_substring_dedup": REPEATS_SQL}


NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS found FROM documents),
w AS (SELECT r, doc_id, CASE WHEN len(found) = 0 AND text <> '' THEN [text] ELSE found END AS words FROM d),
s AS (SELECT DISTINCT r, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS i, b.r AS j, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT i, j FROM p JOIN n x ON x.r = i JOIN n y ON y.r = j WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach(u, v) AS (SELECT r, r FROM d UNION SELECT q.u, e.j FROM reach q JOIN e ON q.v = e.i),
least AS (SELECT u, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = v GROUP BY u),
deg AS (SELECT i, count(*) AS n_links FROM e GROUP BY i)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links FROM d JOIN least ON u = d.r LEFT JOIN deg ON deg.i = d.r
"""

SITES_SQL = """
WITH x AS (SELECT source AS host, lang AS path, quality::DOUBLE AS p FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
paths AS (SELECT host, path, count(*) AS n, sum(p) AS good FROM x GROUP BY host, path),
hosts AS (SELECT host, count(*) AS host_n, sum(p) AS host_good FROM x GROUP BY host),
g AS (SELECT least(greatest(sum(host_good) / sum(host_n), 1e-4), 1 - 1e-4) AS mean FROM hosts),
hb AS (SELECT greatest(sum(host_n * (host_good / host_n - mean) ** 2) - sum(mean * (1 - mean)), 0) / sum(host_n * mean * (1 - mean)) AS b FROM hosts, g),
hs AS (SELECT least(greatest(1 / greatest(b, 1e-6) - 1, 1.0), 1e4) AS s FROM hb),
hp AS (SELECT host, host_n, host_good, (host_good + s * mean) / (host_n + s) AS host_posterior FROM hosts, g, hs),
b AS (SELECT p.host, path, n, good, host_n, host_good, host_posterior FROM paths p JOIN hp ON p.host IS NOT DISTINCT FROM hp.host),
pb AS (SELECT greatest(sum(n * (good / n - host_posterior) ** 2) - sum(host_posterior * (1 - host_posterior)), 0) / sum(n * host_posterior * (1 - host_posterior)) AS b FROM b),
ps AS (SELECT least(greatest(1 / greatest(b, 1e-6) - 1, 1.0), 1e4) AS s FROM pb)
SELECT host, path, n, host_n, round(good, 9) AS good, round(host_good, 9) AS host_good, round(host_posterior, 9) AS host_posterior, round((good + s * host_posterior) / (n + s), 9) AS path_posterior FROM b, ps
"""

DECISIONS_SQL = """
WITH o AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'sparse' || doc_id ELSE source END AS host, lang AS path, CASE WHEN doc_id % 5 = 0 THEN ((doc_id % 7) - 4) / 2.0::DOUBLE + 0.1::DOUBLE WHEN regexp_extract(source, '[0-9]+')::INTEGER % 2 = 0 THEN 3.0 ELSE -3.0 END::DOUBLE AS odds FROM documents),
x AS (SELECT *, 1 / (1 + exp(-odds)) AS p FROM o),
paths AS (SELECT host, path, count(*) AS n, sum(p) AS good FROM x GROUP BY host, path),
hosts AS (SELECT host, count(*) AS host_n, sum(p) AS host_good FROM x GROUP BY host),
g AS (SELECT least(greatest(sum(host_good) / sum(host_n), 1e-4), 1 - 1e-4) AS mean FROM hosts),
hs AS (SELECT least(greatest(1 / greatest(greatest(sum(host_n * (host_good / host_n - mean) ** 2) - sum(mean * (1 - mean)), 0) / sum(host_n * mean * (1 - mean)), 1e-6) - 1, 1.0), 1e4) AS hs FROM hosts, g),
b AS (SELECT p.host, path, n, good, host_n, host_good, (host_good + hs * mean) / (host_n + hs) AS hp FROM paths p JOIN hosts h ON p.host IS NOT DISTINCT FROM h.host, g, hs),
ps AS (SELECT least(greatest(1 / greatest(greatest(sum(n * (good / n - hp) ** 2) - sum(hp * (1 - hp)), 0) / sum(n * hp * (1 - hp)), 1e-6) - 1, 1.0), 1e4) AS ps FROM b),
r AS (
  SELECT doc_id, x.host, odds, mean, least(greatest((good - p + ps * (host_good - p + hs * mean) / (host_n - 1 + hs)) / (n - 1 + ps), 1e-6), 1 - 1e-6) AS rate
  FROM x JOIN b ON x.host IS NOT DISTINCT FROM b.host AND x.path IS NOT DISTINCT FROM b.path, g, hs, ps),
l AS (SELECT doc_id, host, odds, odds + 0.5 * (ln(rate / (1 - rate)) - ln(mean / (1 - mean))) AS lo FROM r)
SELECT doc_id, host, odds >= -1 AS text_kept, lo >= -1 AS kept, round(lo, 6) AS log_odds FROM l
"""

TARGETS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, list_extract([3, 1, 2], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER)::DOUBLE AS w FROM d GROUP BY source),
whole AS (SELECT 1.5::DOUBLE * sum(source_size) AS t, sum(w) AS w FROM s),
fill(t, w) AS (
  SELECT t, w FROM whole
  UNION
  SELECT any_value(whole.t) - coalesce(sum(2.0::DOUBLE * source_size) FILTER (f.t * s.w > 2 * source_size * f.w), 0), coalesce(sum(s.w) FILTER (f.t * s.w <= 2 * source_size * f.w), 0) FROM fill f, s, whole GROUP BY f.t, f.w),
level AS (SELECT arg_min(t, w) AS t, min(w) AS w FROM fill),
targets AS (SELECT source, source_size, CASE WHEN l.t * s.w > 2 * source_size * l.w THEN 2.0 * source_size ELSE l.t * s.w / l.w END AS target FROM s, level l)
SELECT doc_id, size, source_size, round(target::DOUBLE, 6) AS target FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
"""

_URLS = r"""
p AS (
  SELECT page_id, url, coalesce(html, '') AS html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2), '') AS path
  FROM given),
tags AS (
  SELECT url, host, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM p WHERE html ILIKE '%canonical%' OR html ILIKE '%refresh%'),
attributes AS (SELECT *, regexp_extract_all(tag, '(?s)[^\s"''<>/=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>][^\s>]*))?') AS a FROM tags),
raw AS (
  SELECT url, host, path, lower(tag[2:5]) AS kind, list_filter(a, lambda x: regexp_matches(x, '(?i)^rel\s*='))[1] AS rel, list_filter(a, lambda x: regexp_matches(x, '(?i)^href\s*='))[1] AS href,
    list_filter(a, lambda x: regexp_matches(x, '(?i)^http-equiv\s*='))[1] AS equiv, list_filter(a, lambda x: regexp_matches(x, '(?i)^content\s*='))[1] AS content FROM attributes),
plain AS (
  SELECT url, host, path, kind, trim(regexp_replace(regexp_replace(rel, '(?s)^[^=]*=\s*', ''), '(?s)^(["''])(.*)["'']$', '\2')) AS rel, trim(regexp_replace(regexp_replace(href, '(?s)^[^=]*=\s*', ''), '(?s)^(["''])(.*)["'']$', '\2')) AS href,
    trim(regexp_replace(regexp_replace(equiv, '(?s)^[^=]*=\s*', ''), '(?s)^(["''])(.*)["'']$', '\2')) AS equiv, trim(regexp_replace(regexp_replace(content, '(?s)^[^=]*=\s*', ''), '(?s)^(["''])(.*)["'']$', '\2')) AS content FROM raw),
found AS (
  SELECT url, host, path, replace(CASE WHEN kind = 'link' AND list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical') THEN href
    WHEN kind = 'meta' AND lower(equiv) = 'refresh' THEN regexp_extract(content, '(?i)(?:^|[;,\s])url\s*=\s*["'']?([^"''\s]*)', 1) END, '&amp;', '&') AS t FROM plain),
aimed AS (
  SELECT url, host, t, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, path,
    CASE WHEN starts_with(t, '/') THEN t ELSE '/' || regexp_extract(path, '(?s)^/(.*/)?', 1) || t END AS whole FROM found),
folded AS (
  SELECT *, regexp_extract(whole, '(?s)^[^?#]*') AS way, regexp_extract(whole, '(?s)[?#].*$') AS rest,
    list_reduce(string_split(regexp_extract(whole, '(?s)^[^?#]*'), '/')[2:], lambda d, s: CASE WHEN s = '.' THEN d WHEN s = '..' THEN regexp_replace(d, '/[^/]*$', '') ELSE d || '/' || s END, '') AS d FROM aimed),
links AS (
  SELECT url AS src, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$') OR host = '' THEN NULL
    WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '?') THEN scheme || '://' || host || path || t
    ELSE scheme || '://' || host || CASE WHEN d = '' THEN '/' ELSE d END || CASE WHEN d <> '' AND regexp_matches(way, '/\.\.?$') THEN '/' ELSE '' END || rest END AS dst FROM folded
  UNION ALL SELECT src, dst FROM hops),
urls AS (SELECT url FROM p UNION SELECT dst FROM links WHERE dst IS NOT NULL UNION SELECT src FROM links WHERE src IS NOT NULL),
parts AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2) AS path, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3) AS query FROM urls),
nodes AS (SELECT url, host, path, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM parts),
rules(action, host, prefix) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
ruled AS (
  SELECT n.url, n.node, arg_max(r.action, length(r.host || r.prefix)) AS action, arg_max(r.host || r.prefix, length(r.host || r.prefix)) AS rule
  FROM nodes n LEFT JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.prefix) GROUP BY n.url, n.node),
edges AS (
  SELECT DISTINCT a.node AS u, b.node AS v FROM links l JOIN nodes a ON l.src = a.url JOIN nodes b ON l.dst = b.url WHERE a.node <> b.node),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(u, least) AS (SELECT u, least(u, min(v)) FROM both_ways GROUP BY u UNION SELECT b.u, r.least FROM reach r JOIN both_ways b ON r.u = b.v WHERE r.least < b.u),
label AS (SELECT u AS node, min(least) AS component FROM reach GROUP BY u),
linked AS (SELECT DISTINCT url FROM (SELECT src AS url FROM links WHERE dst IS NOT NULL UNION SELECT dst FROM links WHERE src IS NOT NULL)),
class_ AS (SELECT component, min(x.action) AS by_class FROM label JOIN ruled x USING (node) JOIN linked USING (url) WHERE x.action IS NOT NULL GROUP BY component),
decided AS (SELECT node, by_class FROM label JOIN class_ USING (component))
SELECT p.page_id, p.host, p.path, x.rule, coalesce(x.action, d.by_class, 'allow') AS verdict, x.action IS NULL AND d.by_class IS NOT NULL AS by_class
FROM p LEFT JOIN ruled x ON p.url = x.url LEFT JOIN decided d ON x.node = d.node
"""

URLS_SQL = f"WITH RECURSIVE given AS (SELECT page_id, url, html FROM pages), hops(src, dst) AS (SELECT NULL::VARCHAR, NULL::VARCHAR WHERE false), {_URLS}"

PLANTED_SQL = f"""WITH RECURSIVE given AS (
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://site' || (page_id % 13) || '.net/a/' || page_id ELSE url END AS url,
    CASE page_id % 4 WHEN 0 THEN '<link title="rel=canonical" rel="next Canonical" href="/hub/../hub' || (page_id % 7) || '/./x?a=1&amp;b=2">' WHEN 1 THEN '<meta content=''0; url=http://hub' || (page_id % 11) || '.net/x'' http-equiv=refresh>'
      WHEN 2 THEN '<link rel=stylesheet href=http://shop.com/de/canonical.css>' ELSE '<link href=//hub' || (page_id % 5) || '.net/x rel=canonical>' END AS html FROM pages),
hops(src, dst) AS (
  SELECT 'http://hub' || j || '.net/x', CASE j % 3 WHEN 0 THEN 'http://shop.com/de/' || j WHEN 1 THEN 'http://www.example.org/ok/' || j ELSE 'http://plain.net/' || j END FROM range(11) t(j)
  UNION ALL SELECT 'https://site3.net/hub' || j || '/x?a=1&b=2', 'http://hub' || (j + 4) || '.net/x' FROM range(7) t(j)), {_URLS}"""

CHATS_SQL = r"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(replace(role, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])|(<)(</?SYS>>)', '\1\3\5\\\2\4\6', 'g'))
    + length(regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])|(<)(</?SYS>>)', '\1\3\5\\\2\4\6', 'g')) + 12 + 10 + 11 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, alone
"""

RULES_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
five AS (
  SELECT r, i, words[i:i + 4] AS five FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM five) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS s(k) GROUP BY r),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, len(regexp_extract_all(text, '(?m)^[ \t]*[-*•]')) AS n_bullet_lines,
    len(list_filter(words, lambda x: x IN ('the', 'of', 'and', 'to', 'in', 'is', 'that', 'be', 'have', 'with', 'for', 'it', 'der', 'die', 'das', 'und', 'ist', 'nicht', 'von', 'mit', 'zu', 'den', 'le', 'la', 'les', 'de', 'des', 'et', 'en', 'un', 'une', 'que', 'el', 'los', 'las', 'y', 'por', 'con', 'no', 'se', 'The', 'Of', 'And', 'To', 'In', 'Is', 'That', 'Be', 'Have', 'With', 'For', 'It', 'Der', 'Die', 'Das', 'Und', 'Ist', 'Nicht', 'Von', 'Mit', 'Zu', 'Den', 'Le', 'La', 'Les', 'De', 'Des', 'Et', 'En', 'Un', 'Une', 'Que', 'El', 'Los', 'Las', 'Y', 'Por', 'Con', 'No', 'Se'))) AS n_stop_words,
    len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words
  FROM w LEFT JOIN covered c USING (r)),
j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    coalesce(word_chars, 0) / greatest(n_words, 1) AS mean_chars FROM m),
f AS (
  SELECT *, list_filter([CASE WHEN mean_chars < 1.5 OR mean_chars > 30 THEN 'word length' END, CASE WHEN n_symbols / greatest(n_words, 1) > 0.3 THEN 'symbols' END,
    CASE WHEN n_words >= 50 AND n_stop_words / n_words < 0.02 THEN 'stop words' END, CASE WHEN n_dup_lines / greatest(n_lines, 1) > 0.5 THEN 'repeated lines' END,
    CASE WHEN n_bullet_lines / greatest(n_lines, 1) > 0.9 THEN 'bullet lines' END, CASE WHEN n_letter_words / greatest(n_words, 1) < 0.5 THEN 'words with a letter' END], lambda x: x IS NOT NULL) AS failed FROM j)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept,
  array_to_string(failed, ',') AS failed_rules FROM f
"""

PHRASES_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, len, array_to_string(w[i:i + len - 1], ' ') AS phrase FROM (SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM p, range(1, 6) AS s(len))),
f AS (SELECT lang, len, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT lang, len, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE len > 1 AND n >= 100),
cuts AS (SELECT lang, len, phrase, a, w, unnest(range(1, len)) AS k FROM c),
scored AS (
  SELECT x.lang, x.len, x.phrase, a, l.n AS l, r.n AS r, t.n, k, (1000::HUGEINT * a * t.n // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts x JOIN t USING (lang) JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:k], ' ') AND l.len = k
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[k + 1:], ' ') AND r.len = x.len - k),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
within AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, len - m + 2)) AS i FROM c, range(2, 5) AS s(m) WHERE m < len) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest LEFT JOIN within USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY rank <= 2000
"""

REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT r, i FROM g QUALIFY rank() OVER (PARTITION BY run ORDER BY doc_id NULLS LAST, i) > 1),
covered AS (SELECT DISTINCT r, i + k AS i FROM later, range(20) AS s(k)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
