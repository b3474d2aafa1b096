"""Mixing sources to target weights by fitting budgets with subset sums.

Sizes are counted by exact length. A source's target is met by whole passes over it
and, for what is left of the budget, a set of its documents for one more pass. That
set is found on counts by length alone: each length first gives its share of the budget,
rounded down, and a bounded-knapsack dynamic program over the other documents of each
length fills the rest, which is at most a few times the longest document. Then each
length's count of documents is selected in the order of a seeded hash.

The selection is a threshold: the documents of a source and length up to a hash are taken.
The first bits of the hash deal them over buckets, counts by bucket tell which bucket is cut,
and only this one is ranked, so a length that a third of all rows share is spread over a
thousand groups. The thresholds, one row for each source and length, are all that is joined
to the documents, whose texts are not shuffled.

Targets are found by aggregates over the table of sources, whatever their number. One task
has the distinct lengths of one source, at most as many as its longest document has words,
and the program takes 24 bytes for each word of that document.

Defined cases: a null text has size 0; very long texts are counted whole; null is a source
of its own and comes last; a document of size 0 is never taken; repeated rows are documents
of their own, also where ids are null or repeat; of rows with one hash, which equal rows
have, a part is taken by the order of their other columns; an empty table gives an empty one;
other columns are not read by ``plan``. Reruns agree, since only rows and the seed decide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_row, lookup
from tessera.plans.shared import numbered, written

#: Bits of the hash that deal a length's documents over 32 buckets, and each of these over 32.
BITS = (5, 10)
#: Copies that one row is repeated to at a time.
REPEATS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sums: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``(__source, source_size, target)`` from ``(__source, source_size)``.

    Sources in order of their code points, null last, take the weights in turn and get
    ``share`` of all words by weight, none above ``most`` times its size. What the limits cut
    off is shared again by weight among the others until none is above. A source above its
    limit stays so, because the level only rises; each round is one aggregation.
    """
    ranked = numbered(sums.select("__source", "source_size"), F.col("__source").isNull(), "__source", name="__nth")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__nth") % len(weights) + 1).cast("int"))
    table = written(ranked.select("__source", "source_size", weight.alias("__weight")), "sources")
    limit = F.col("source_size") * F.lit(float(most))
    first = table.agg(F.sum("source_size").alias("size"), F.sum("__weight").alias("weight")).first()
    whole = share * (first["size"] or 0)
    total, left = whole, first["weight"] or 0.0
    while True:
        above = F.lit(total) * F.col("__weight") > limit * F.lit(left)
        got = table.agg(F.sum(F.when(above, limit)).alias("limits"), F.sum(F.when(~above, F.col("__weight"))).alias("weight")).first()
        now = (whole - (got["limits"] or 0.0), got["weight"] or 0.0)
        if now == (total, left):
            break
        total, left = now
        if not left:
            break
    level = F.lit(total) * F.col("__weight") / F.lit(left) if left else limit
    return table.select("__source", "source_size", F.when(above, limit).otherwise(level).alias("target"))


def fit_counts(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their sizes add up near ``budget``.

    The proportional part keeps the mix of lengths; the dynamic program is over sums up
    to a bound of a few times the longest length, whatever the budget.
    """
    import numpy as np

    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    whole = sum(n * c for n, c in counts.items())
    budget = max(0, min(budget, whole))
    if not whole or not budget:
        return {}
    longest = max(counts)
    even = max(0, budget - 4 * longest)  # the rest leaves the program a choice
    taken = {n: c * even // whole for n, c in counts.items()}
    left = budget - sum(n * t for n, t in taken.items())
    for n in sorted(counts, reverse=True):  # each length's rounding leaves at most one document; take the long ones now
        if left < 6 * longest:
            break
        more = min(counts[n] - taken[n], 1, left // n)
        taken[n] += more
        left -= n * more
    items = []
    for n in sorted(counts, reverse=True):
        free, step = min(counts[n] - taken[n], left // n), 1
        while free > 0:
            items.append((n, min(step, free)))
            free -= min(step, free)
            step *= 2
    reached = np.full(left + 1, -1, np.int32)  # the item that first reached each sum
    reached[0] = len(items)
    for k, (n, c) in enumerate(items):
        if reached[left] >= 0:
            break
        if n * c <= left:
            new = (reached[: left + 1 - n * c] >= 0) & (reached[n * c :] < 0)
            reached[n * c :][new] = k
    at = int(np.flatnonzero(reached >= 0).max())
    while at:
        n, c = items[reached[at]]
        taken[n] += c
        at -= n * c
    return {n: t for n, t in taken.items() if t}


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``docs`` with ``__source``, ``__size`` and ``__hash``, which decides the order of selection."""
    return docs.withColumns({"__source": F.col(source_col).cast("string"), "__size": words(F.col(text_col)), "__hash": F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col))})


def _cuts(sized: DataFrame, weights, share, most, seed) -> DataFrame:
    """``(__source, __size, __passes, __source_size, __target, __cut, __some)``, a row for each source and length.

    All documents are taken ``__passes`` times, and those with a hash up to ``__cut`` once
    more; but if ``__some`` is above 0, only so many of those whose hash is ``__cut`` itself.
    """
    if most != int(most):
        raise ValueError("most is a whole number of passes")
    keys = ["__source", "__size"]
    groups = written(sized.groupBy(*keys, "__hash").agg(F.count("*").alias("__n")), "mixture")
    lengths = written(groups.groupBy(*keys).agg(F.sum("__n").alias("__n")), "lengths")
    sums = lengths.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__n")).alias("source_size"))
    wanted = targets(sums, weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(0).cast("long")
    budget = F.when(passes < most, F.rint(F.col("target") - passes * F.col("source_size"))).otherwise(0).cast("long")
    sources = written(wanted.select("__source", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), passes.alias("__passes"), budget.alias("__budget")), "targets")

    def fit(pdf):
        extra = fit_counts(dict(zip(pdf["__size"].tolist(), pdf["__n"].tolist(), strict=True)), int(pdf["__budget"].iloc[0]))
        return pdf[["__source", "__size"]].assign(__quota=[extra.get(n, 0) for n in pdf["__size"].tolist()])

    fitted = lookup(lengths, sources.select("__source", "__budget"), ["__source"]).groupBy("__source").applyInPandas(fit, "__source string, __size long, __quota long")
    quotas = written(fitted, "quotas")
    upto = lambda order: F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = lambda df, order: df.withColumn("__before", upto(order)).where((F.col("__before") < F.col("__room")) & (F.col("__room") <= F.col("__before") + F.col("__n")))
    cut, above = quotas.where("__quota > 0").select(*keys, F.col("__quota").alias("__room")), []
    for bits in BITS:  # a window has the parts of one bucket only
        hashed = groups.withColumn("__bucket", F.shiftright("__hash", 64 - bits))
        if above:
            hashed = hashed.withColumn("__above", F.shiftright("__hash", 64 - above[-1]))
        asked = lookup(hashed, cut, [*keys, *(["__above"] if above else [])], "inner")
        per = asked.groupBy(*keys, "__bucket").agg(F.sum("__n").alias("__n"), F.first("__room").alias("__room"))
        cut = written(reached(per, "__bucket").select(*keys, F.col("__bucket").alias("__above"), (F.col("__room") - F.col("__before")).alias("__room")), "cut-buckets")
        above.append(bits)
    last = reached(lookup(groups.withColumn("__above", F.shiftright("__hash", 64 - BITS[-1])), cut, [*keys, "__above"], "inner"), "__hash")
    left = F.col("__room") - F.col("__before")
    cuts = written(last.select(*keys, F.col("__hash").alias("__cut"), F.when(left < F.col("__n"), left).otherwise(0).alias("__some")), "cuts")
    every = lookup(lookup(lengths.select(*keys), sources.drop("__budget"), ["__source"]), cuts, keys)
    return written(every.withColumn("__passes", F.when(F.col("__size") > 0, F.col("__passes")).otherwise(0)), "thresholds")


def _decided(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """``sized`` with the thresholds, ``__copies`` and ``__tied``: rows of which only some are taken once more."""
    joined = lookup(sized, cuts, ["__source", "__size"])
    tied = F.coalesce((F.col("__hash") == F.col("__cut")) & (F.col("__some") > 0), F.lit(False))
    more = F.coalesce((F.col("__hash") <= F.col("__cut")) & ~tied, F.lit(False)).cast("long")
    return joined.withColumns({"__copies": F.col("__passes") + more, "__tied": tied})


def _parted(tied: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """Equal rows of ``tied`` by their keys: ``__n`` of them, ``__extra`` taken once more."""
    same = ["__source", "__size"]
    groups = tied.groupBy(*same, *keys).agg(F.count("*").alias("__n"), F.first("__some").alias("__some"), *(F.first(c).alias(c) for c in carry))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*same).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumn("__extra", F.greatest(F.least(F.col("__some") - before, F.col("__n")), F.lit(0)))


def _repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, at least once; no long array is made."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / REPEATS)))
    chunks = df.withColumn("__times", times).withColumn("__chunk", first)
    each = F.sequence(F.lit(1).cast("long"), F.least(F.lit(REPEATS).cast("long"), F.col("__times") - F.col("__chunk") * REPEATS))
    return chunks.withColumn("__each", F.explode(each)).drop("__times", "__chunk", "__each")


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id_col, size, source_size, target, taken)``; ``taken`` counts words with repeats.

    ``most`` is a whole number of passes; another one is refused. The texts are scanned once.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    sized = written(_sized(named, "id", "text", "source", seed).select(F.col("id").alias("__id"), "__source", "__size", "__hash"), "sizes")
    cuts = _cuts(sized, weights, share, most, seed)
    rows = _decided(sized, cuts)
    carry = ["__source_size", "__target", "__passes"]
    groups = _parted(rows.where("__tied"), ["__id", "__hash"], carry)
    parts = F.array(*(F.struct(n.alias("rows"), c.alias("copies")) for n, c in ((F.col("__extra"), F.col("__passes") + 1), (F.col("__n") - F.col("__extra"), F.col("__passes")))))
    apart = groups.withColumn("__part", F.explode(F.filter(parts, lambda p: p["rows"] > 0))).withColumn("__copies", F.col("__part.copies"))
    wanted = ["__id", "__size", "__source_size", "__target", "__copies"]
    both = rows.where("not __tied").select(*wanted).unionByName(_repeated(apart, F.col("__part.rows")).select(*wanted))
    return both.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: rows of ``docs`` as often as ``plan`` takes them; all columns stay.

    Of rows that no column tells apart, the copies that only some are taken for come from one.
    Columns may have any names.
    """
    given = as_row(docs, id=F.col(id_col), text=F.col(text_col), source=F.col(source_col))
    read = _sized(given, "id", "text", "source", seed).drop("id", "text", "source")
    cuts = _cuts(written(read.select("__source", "__size", "__hash"), "sizes"), weights, share, most, seed)
    rows = _decided(read, cuts)
    made = _repeated(rows.where("__copies > 0"), F.col("__copies")).select("row.*")
    if cuts.where("__some > 0").isEmpty():
        return made
    hashed = [F.col("row")[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    tied = rows.where("__tied").withColumns({"__row": F.xxhash64(*hashed), "__row2": F.xxhash64(F.lit(seed), *hashed)})
    extra = written(_parted(tied, ["__row", "__row2"], []).where("__extra > 0").select("__row", "__row2", "__extra"), "tied")
    one = lookup(tied, extra, ["__row", "__row2"], "inner").dropDuplicates(["__row", "__row2"])
    return made.unionByName(_repeated(one, F.col("__extra")).select("row.*"))
