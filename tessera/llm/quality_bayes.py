"""Quality by hierarchical empirical Bayes.

1. A logistic regression gives each document the probability that it is good. Its evidence is
   how often the words and pairs of neighbouring words fall into each of BUCKETS buckets of a
   hash, and ten surface features, which are built-in expressions. It is fitted on at most
   FIT_ROWS labelled rows, taken in the order of a hash of their ids.
2. Sites are hosts, and paths within hosts. Their rates of good documents have beta
   priors: the posterior mean of a host shrinks to the global mean, that of a path to
   its host's, each by a strength estimated from the spread between sites (method of
   moments over grouped sums). A sparse site thus stays near its prior.
3. The log-odds of a document are those of its text plus SITE_WEIGHT times the shift of
   its path's posterior against the global mean. The document's own evidence is taken
   out of its site's sums first, so a single document does not confirm itself.

Texts are scanned once: what is kept of them is stored with its log-odds. Sums go through
map-side partial aggregation, so a host with a third of all rows costs one row a task. The
tables of sites are joined by broadcast only up to a counted size.

Defined cases: a null text is the empty text, which has features like any other; very long
texts are scored whole; null hosts and paths are sites of their own; repeated rows count
each time, in the fit too, up to its bound; equal log-odds get equal decisions, so no ties
arise; without labels of both kinds, or without any, nothing tells texts apart and all have
log-odds of zero; an empty table gives an empty one; other columns are not read, and of
carried columns those named like a result give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import bounded_batches, lookup
from tessera.llm.quality_rules import SPACES, words_of
from tessera.llm.words import BASE, PIECE, flat_bytes, mixed, portions, span_hashes, spans, white_space
from tessera.plans.shared import written

#: Labelled rows that the text classifier is fitted on, at most.
FIT_ROWS = 20_000
SITE_WEIGHT = 0.5
#: Documents whose posterior log-odds are below this are rejected: doubtful ones stay.
KEEP_LOG_ODDS = -1.0
#: Buckets of hashed words and pairs, a power of two, and the scale of their shares beside the surface features.
BUCKETS, GRAM_SCALE = 1 << 9, 20.0
#: Log-odds of one text stay within this, so that sums of probabilities stay informative.
MOST = 12.0

FEATURES = ("log_words", "word_chars", "upper", "symbols", "marks", "digits", "pipes", "distinct", "repeated_lines", "line_words")


def features(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """Arrays to compute first, and the features over them, by name."""
    text = F.coalesce(text, F.lit(""))
    words, lines = F.col("__words"), F.col("__lines")
    n, chars = F.size(words), F.length(text)
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    first = {"__words": words_of(text), "__lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")}
    return first, {
        "log_words": F.log1p(n.cast("double")) / 5,
        "word_chars": F.least(per(chars, n), F.lit(40)) / 10,
        "upper": per(F.regexp_count(text, F.lit(r"\p{Lu}")), chars) * 5,
        "symbols": F.least(per(F.regexp_count(text, F.lit(r"[#*$%&<>]")), n), F.lit(3)),
        "marks": F.least(per(F.regexp_count(text, F.lit("[!?]")), n), F.lit(3)),
        "digits": per(F.regexp_count(text, F.lit("[0-9]")), chars) * 5,
        "pipes": F.least(per(F.regexp_count(text, F.lit(r"\|")), n) * 3, F.lit(3)),
        "distinct": per(F.size(F.array_distinct(words)), n),
        "repeated_lines": 1 - per(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": F.log1p(per(n, F.size(lines))) / 3,
    }


def gram_counts(texts: pa.Array, buckets: int = BUCKETS):
    """For each text, how often each bucket is met by its words and pairs of neighbours, and how many there are in all.

    Words are bytes between white space with A-Z in lower case; ``(row, bucket, n)`` and ``(row) -> total``.
    """
    import numpy as np

    lower = np.arange(256).astype(np.uint8)
    lower[65:91] += 32
    data, offsets = flat_bytes(texts)
    rows, grams = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for begin, end in portions(offsets, PIECE):
        raw = lower[data[offsets[begin] : offsets[end]]]
        start, stop, counts = spans(raw, offsets[begin:end] - offsets[begin], white_space())
        words, row = span_hashes(raw, start, stop), np.repeat(np.arange(begin, end), counts)
        pair = row[1:] == row[:-1]
        grams += [words, mixed(words[:-1] * np.uint64(BASE) + words[1:])[pair]]
        rows += [row, row[1:][pair]]
    rows = np.concatenate(rows)
    key, n = np.unique(rows * buckets + (np.concatenate(grams) >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.int64), return_counts=True)
    return key // buckets, key % buckets, n, np.maximum(np.bincount(rows, minlength=len(texts)), 1)


def gram_evidence(weights: tuple[float, ...]):
    """A function of a text column: the mean weight of its hashed words and pairs, scaled as in the fit."""

    @arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        import numpy as np

        row, bucket, n, total = gram_counts(texts, len(weights))
        return pa.array(np.bincount(row, np.array(weights)[bucket] * n, len(texts)) * GRAM_SCALE / total)

    return evidence


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` and one array column ``__x`` of the features."""
    first, found = features(F.col(text_col))
    return df.withColumns(first).withColumn("__x", F.array(*(found[k].cast("double") for k in FEATURES))).drop("__words", "__lines")


@dataclass(frozen=True)
class TextModel:
    """Weights of the surface features, and of the buckets of hashed words and pairs."""

    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    grams: tuple[float, ...] = ()

    def judged(self, df: DataFrame) -> DataFrame:
        """``df`` with ``odds``, the log-odds of its column ``text``; other names must differ from ``__x`` and the like."""
        bounded_batches(df.sparkSession)
        found = with_features(df, "text")
        total = F.lit(self.bias)
        for i, (m, s, w) in enumerate(zip(self.means, self.scales, self.weights, strict=True)):
            total = total + (F.get(F.col("__x"), F.lit(i)) - F.lit(m)) * F.lit(w / s)
        if any(self.grams):
            total = total + gram_evidence(self.grams)(F.coalesce("text", F.lit("")))
        return found.withColumn("odds", F.greatest(F.least(total, F.lit(MOST)), F.lit(-MOST))).drop("__x")


def fit_text_model(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, ridge: float = 1.0, buckets: int = BUCKETS
) -> TextModel:
    """Ridge logistic regression by Newton steps on a bounded sample of labelled rows.

    At most ``rows`` labels are taken, and of the rows that have them, which repeated ids
    may multiply, at most ``rows`` again. The driver gets features and counts of buckets, no texts.
    """
    import numpy as np

    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(rows)
    joined = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text")).join(F.broadcast(chosen), "__id")

    @arrow_udf("binary")
    def counted(texts: pa.Array) -> pa.Array:
        row, bucket, n, total = gram_counts(texts, buckets)
        dense = np.zeros((len(texts), buckets), np.float16)  # a kilobyte a row for the driver
        dense[row, bucket] = n / total[row]
        return pa.array([r.tobytes() for r in dense], pa.binary())

    featured = with_features(joined, "__text").select("__id", "__x", "__y", counted("__text").alias("__grams"))
    found = featured.orderBy(F.xxhash64("__id"), F.xxhash64("__x"), "__id", "__y").limit(rows).toPandas()
    y = found["__y"].to_numpy() if len(found) else np.empty(0)
    if len(set(y.tolist())) < 2:
        return TextModel((0.0,) * len(FEATURES), (1.0,) * len(FEATURES), (0.0,) * len(FEATURES), 0.0)
    x = np.array(found["__x"].tolist())
    means, scales = x.mean(0), np.maximum(x.std(0), 1e-6)
    grams = np.frombuffer(b"".join(found["__grams"]), np.float16).reshape(len(y), buckets)
    w, penalty = np.zeros(x.shape[1] + buckets + 1), np.diag([ridge] * (x.shape[1] + buckets) + [1e-6])

    def parts():
        for i in range(0, len(y), 1024):
            some = slice(i, i + 1024)
            yield np.column_stack([(x[some] - means) / scales, grams[some].astype(np.float64) * GRAM_SCALE, np.ones(len(y[some]))]), y[some]

    for _ in range(30):
        curve, slope = penalty.copy(), -penalty @ w
        for z, wanted in parts():
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            curve += (z * (p * (1 - p))[:, None]).T @ z
            slope += z.T @ (wanted - p)
        step = np.linalg.solve(curve, slope)
        w += step
        if abs(step).max() < 1e-6:
            break
    n = x.shape[1]
    return TextModel(tuple(means.tolist()), tuple(scales.tolist()), tuple(w[:n].tolist()), float(w[-1]), tuple(w[n:-1].tolist()))


@dataclass(frozen=True)
class SitePrior:
    """The global mean, and the strengths (pseudo-counts) of the two levels of priors."""

    mean: float
    host_strength: float
    path_strength: float


def _strength(sites: DataFrame, mean: Column, n: str = "n", rate: str = "rate") -> float:
    """Pseudo-counts of a beta prior from the spread of rates round their own means."""
    got = sites.agg(
        F.sum(F.col(n) * (F.col(rate) - mean) ** 2).alias("spread"), F.sum(mean * (1 - mean)).alias("noise"), F.sum(F.col(n) * mean * (1 - mean)).alias("whole"), F.count("*").alias("sites")
    ).first()
    if not got["sites"] or not got["whole"]:
        return 1.0
    between = max(got["spread"] - got["noise"], 0.0) / got["whole"]  # share of the variance that lies between sites
    return min(max(1 / max(between, 1e-6) - 1, 1.0), 1e4)


def site_posteriors(scored: DataFrame) -> tuple[SitePrior, DataFrame]:
    """From ``host``, ``path`` and ``p``: the priors, and per (host, path) the sums and posteriors."""
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "sites")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")), "hosts")
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    mean = min(max((total["good"] or 0.0) / total["n"], 1e-4), 1 - 1e-4) if total["n"] else 0.5
    rated = hosts.withColumn("rate", F.col("host_good") / F.col("host_n"))
    host_strength = _strength(rated, F.lit(mean), "host_n")
    posterior = (F.col("host_good") + host_strength * mean) / (F.col("host_n") + host_strength)
    both = lookup(paths, hosts.withColumn("host_posterior", posterior), ["host"])
    path_strength = _strength(both.withColumn("rate", F.col("good") / F.col("n")), F.col("host_posterior"))
    path_posterior = (F.col("good") + path_strength * F.col("host_posterior")) / (F.col("n") + path_strength)
    return SitePrior(mean, host_strength, path_strength), both.withColumn("path_posterior", path_posterior)


RESULTS = ("site_host", "site_path", "text_p", "host_posterior", "path_posterior", "log_odds", "quality_kept")


def with_sites(odds: DataFrame, site_weight: float = SITE_WEIGHT, keep_log_odds: float = KEEP_LOG_ODDS) -> DataFrame:
    """Stored rows of ``host``, ``path`` and ``odds``, with what the sites make of them.

    Adds ``p`` of the text alone, ``host_rate`` and ``path_rate`` without the row's own evidence,
    ``log_odds`` and ``kept``. Other columns stay.
    """
    p = 1 / (1 + F.exp(-F.col("odds")))
    prior, sites = site_posteriors(odds.select("host", "path", p.alias("p")))
    known = written(sites.select("host", "path", *(F.col(c).alias(f"sum_{c}") for c in ("n", "good", "host_n", "host_good"))), "sums")
    host_rate = (F.col("sum_host_good") - p + prior.host_strength * prior.mean) / (F.col("sum_host_n") - 1 + prior.host_strength)
    path_rate = F.greatest(F.least((F.col("sum_good") - p + prior.path_strength * F.col("host_rate")) / (F.col("sum_n") - 1 + prior.path_strength), F.lit(1 - 1e-6)), F.lit(1e-6))
    shift = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - F.log(F.lit(prior.mean / (1 - prior.mean)))
    judged = lookup(odds, known, ["host", "path"]).withColumn("host_rate", host_rate).withColumn("path_rate", path_rate).withColumn("log_odds", F.col("odds") + site_weight * shift)
    return judged.withColumns({"p": p, "kept": F.col("log_odds") >= keep_log_odds}).drop("sum_n", "sum_good", "sum_host_n", "sum_host_good")


def _judged(docs: DataFrame, model: TextModel, host: Column, path: Column, site_weight: float, keep_log_odds: float, text_col: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` as the struct ``row``, and the results of ``with_sites``."""
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(text_col).alias("text"), host.alias("host"), path.alias("path"))
    return with_sites(written(model.judged(base).select("row", "host", "path", "odds"), "log-odds"), site_weight, keep_log_odds)


def score(docs: DataFrame, model: TextModel, host: Column, path: Column, site_weight: float = SITE_WEIGHT, keep_log_odds: float = KEEP_LOG_ODDS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``id_col``, ``site_host``, ``site_path``, ``text_p``, posteriors of the site, ``log_odds`` and ``quality_kept``.

    ``carry`` names further columns of ``docs`` to keep beside these.
    """
    columns = [c for c in dict.fromkeys([id_col, *(carry or [])]) if c not in RESULTS]
    done = _judged(docs, model, host, path, site_weight, keep_log_odds, text_col, columns)
    inner = ("host", "path", "p", "host_rate", "path_rate", "log_odds", "kept")
    return done.select("row.*", *(F.col(c).alias(name) for c, name in zip(inner, RESULTS, strict=True)))


def keep(docs: DataFrame, model: TextModel, host: Column, path: Column, site_weight: float = SITE_WEIGHT, keep_log_odds: float = KEEP_LOG_ODDS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns as they are, whatever their names."""
    return _judged(docs, model, host, path, site_weight, keep_log_odds, text_col, docs.columns).where("kept").select("row.*")
