"""URL filters with redirect equivalence.

A rule is a host and a path prefix with an action. It fits its host and all subdomains
if the URL's path starts with the rule's path; the longest rule wins, and allow wins
between rules of one length. URLs joined by redirects (an optional table, and meta
refreshes in the pages) and by canonical links form classes, which are the connected
components of these edges. A URL without a rule of its own takes the decision of its
class: allow if any member is explicitly allowed, else block if any is blocked. A rule
of its own always goes first.

Only built-in functions run here. Pages are scanned once for links, which are stored. Nodes
are 128-bit digests of host, path and query, so the components hold no long strings.

Defined cases: a null URL, or one without ``://``, has an empty host and path, meets no
rule and is no node; a null page has no edges; very long pages are read whole; between rules
of one length, and within a class, allow wins, so no ties are left; repeated rows give
repeated results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lookup
from tessera.operators.components import connected_components
from tessera.plans.shared import written

#: Rules up to this number are compiled into one expression, beyond it they are joined.
COMPILED = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_TAG = r"(?is)<(?:link|meta)\s[^>]*>"
_ATTRIBUTE = r"""(?s)[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""
_REFRESH = r"""(?i)(?:^|[;,\s])url\s*=\s*["']?([^"'\s]*)"""


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """A digest of the URL without scheme and fragment; null where there is no host."""
    return F.when(host_of(url) != "", F.unhex(F.md5(F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), F.regexp_extract(url, _URL, 3)))))


def _ordered(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))


def with_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]], url: Column) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``action`` of (action, host, path) rules."""
    df = df.withColumns({"host": host_of(url), "path": path_of(url)})
    if len(rules) > COMPILED:
        return _joined(df, rules)
    hit = F.lit(None).cast("struct<rule: string, action: string>")
    for action, host, path in reversed(_ordered(rules)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        hit = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(action).alias("action"))).otherwise(hit)
    return df.withColumn("__hit", hit).withColumns({"rule": F.col("__hit.rule"), "action": F.col("__hit.action")}).drop("__hit")


def _joined(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """For long lists: distinct hosts and paths against the rules by each suffix of the host."""
    spark = df.sparkSession
    listed = spark.createDataFrame([(r[1], r[2], r[0], n) for n, r in enumerate(_ordered(rules))], "suffix string, prefix string, action string, n long")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = df.select("host", "path").distinct()
    best = (
        urls.withColumn("suffix", F.explode(suffixes))
        .join(listed, "suffix")
        .where(F.col("path").startswith(F.col("prefix")))
        .groupBy("host", "path")
        .agg(F.min(F.struct("n", F.concat("suffix", "prefix").alias("rule"), "action")).alias("hit"))
        .select("host", "path", "hit.rule", "hit.action")
    )
    return df.join(best, ["host", "path"], "left")


def _without_dots(path: Column) -> Column:
    """An absolute path without its ``.`` and ``..`` segments, as RFC 3986 removes them."""
    segments = F.split(path, "/")
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    left = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(left, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(left) > 0), "/").otherwise(""))


def _attribute(attributes: Column, name: str) -> Column:
    """The value of a tag's first attribute of a name, without its quotes; empty if there is none."""
    first = F.get(F.filter(attributes, lambda x: x.rlike(rf"(?i)^{name}\s*=")), F.lit(0))
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(first, r"(?s)^[^=]*=\s*", ""), r"(?s)^([\"'])(.*)[\"']$", "$2")), F.lit(""))


def _target(tag: Column) -> Column:
    """What one tag refers to as a canonical link or a refresh; empty if it is neither."""

    def of(found: Column) -> Column:
        canonical = tag.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(_attribute(found, "rel")), r"\s+"), "canonical")
        refresh = tag.rlike("(?i)^<meta") & (F.lower(_attribute(found, "http-equiv")) == "refresh")
        return F.when(canonical, _attribute(found, "href")).when(refresh, F.regexp_extract(_attribute(found, "content"), _REFRESH, 1)).otherwise("")

    return F.get(F.transform(F.array(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))), of), F.lit(0))


def page_targets(url: Column, html: Column) -> Column:
    """Absolute targets of a page's canonical links and meta refreshes.

    Attributes are read one by one, so values and other attributes are not taken for them.
    Relative targets are resolved against the page's URL; a ``base`` element is not read.
    Fragments alone and schemes without a host give none.
    """
    page = F.coalesce(html, F.lit(""))
    tags = F.regexp_extract_all(page, F.lit(_TAG), F.lit(0))
    found = F.when(F.lower(page).rlike("canonical|refresh"), F.transform(tags, _target)).otherwise(F.array().cast("array<string>"))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/(.*/)?", 1))
    within = lambda t: F.concat(site, _without_dots(F.regexp_extract(t, r"(?s)^[^?#]*", 0)), F.regexp_extract(t, r"(?s)[?#].*$", 0))
    absolute = lambda t: (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$") | (host_of(url) == ""), F.lit(None).cast("string"))
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), within(t))
        .when(t.startswith("?"), F.concat(site, path_of(url), t))
        .otherwise(within(F.concat(folder, t)))
    )
    return F.array_compact(F.transform(F.transform(found, lambda t: F.replace(t, F.lit("&amp;"), F.lit("&"))), absolute))


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html"
) -> DataFrame:
    """``(id_col, host, path, rule, verdict, by_class)``.

    ``redirects`` has the columns ``src`` and ``dst``, both URLs. ``by_class`` says that
    the decision came from the class of the URL.
    """
    read = pages.select(id_col, F.col(url_col).alias("__url"), *([F.col(html_col).alias("__html")] if html_col else []))
    links = read.select(F.col("__url").alias("src"), F.explode(page_targets(F.col("__url"), F.col("__html"))).alias("dst")) if html_col else None
    if redirects is not None:
        more = redirects.select("src", "dst")
        links = more if links is None else links.unionByName(more)
    ruled = with_rule(read.select(id_col, "__url"), rules, F.col("__url"))
    if links is not None:
        edges = written(links.where("src is not null and dst is not null").distinct(), "links")
        classes = written(connected_components(edges.select(node_of(F.col("src")).alias("u"), node_of(F.col("dst")).alias("v"))), "classes")
        ends = edges.select(F.explode(F.array("src", "dst")).alias("__url")).distinct()
        decided = with_rule(ends, rules, F.col("__url")).where("action is not null").select(node_of(F.col("__url")).alias("node"), "action")
        verdicts = classes.join(decided, "node").groupBy("component").agg(F.min("action").alias("by"))  # 'allow' sorts before 'block'
        of_node = written(classes.join(verdicts, "component").select(F.col("node").alias("__node"), "by"), "verdicts")
        ruled = lookup(ruled.withColumn("__node", F.when(F.col("action").isNull(), node_of(F.col("__url")))).drop("__url"), of_node, ["__node"])
    else:
        ruled = ruled.withColumn("by", F.lit(None).cast("string"))
    return ruled.select(
        id_col, "host", "path", "rule", F.coalesce("action", "by", F.lit(default)).alias("verdict"), (F.col("action").isNull() & F.col("by").isNotNull()).alias("by_class")
    )
