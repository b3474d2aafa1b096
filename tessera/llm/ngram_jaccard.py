"""Near duplicates by the Jaccard similarity of word n-grams, with Bayesian pruning.

1. One Arrow pass gives each document a 128-bit key of its set of shingles (n-grams of
   lower-cased words, five words by default; a shorter text is one shingle), its bands of
   MinHash values and a byte of each value. Documents with equal keys form a class of copies
   at similarity 1; only one representative of each goes on, with the number of its copies.
2. Representatives that share a band are linked to the least of that bucket, a star and not
   all pairs. With 40 bands of 6 values a pair at the threshold of 0.8 has no common band
   with a probability of about 5e-6.
3. The MinHash bytes of a link's ends are compared 16 at a time. Under a uniform prior the
   posterior of the similarity after m of n equal values is Beta(m+1, n-m+1); a link is
   dropped once the posterior probability of reaching the threshold is below ``tolerance``.
   (Unequal values with equal bytes only keep more.) In a bucket whose documents are not all
   joined by then, those that are not are compared with each other in the same way. What is
   left makes families by connected components, so texts that share a passage, but are not
   near the threshold, form none, and no text has moved so far.
4. The members' texts, found by a filter of bounded size, are verified exactly on the sets of
   shingles, after the same pruning on whole MinHash values. A small family is one group. A
   larger one is dealt over blocks by the number of shingles, since the threshold bounds the
   ratio of sizes, and by hash within a size; a group compares two blocks and returns, for
   each document, the number of links and a root, never the pairs. The final classes are the
   connected components over these.

Result: one row a document with ``class_id`` (the least id in its connected component)
and ``n_links`` (other documents at the threshold or above, copies counted).

Defined cases: a null or empty text has no shingles and is alone in its class; a text
without a word character is one shingle, the text itself; very long texts are compared
whole; repeated rows are copies of each other; the least id names a class, so ties do not
arise; a row without an integer or string id takes part like any other, under a stand-in
made from its text that follows all usual ids, and only a class without any id shows a
stand-in as ``class_id``; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_row, bounded_batches, lookup, map_rows
from tessera.operators.components import connected_components
from tessera.plans.shared import maybe_in, written

BANDS, ROWS, STEP = 40, 6, 16
HASHES = BANDS * ROWS
#: Bounds of one group of step 4: documents and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 1_000_000
#: Shingles of small families that share a group, on average.
PACK_SHINGLES = 400_000
#: Documents of a bucket that are compared in one group.
BUCKET_DOCS = 2000

#: Words whose hashes a worker keeps; it starts over when they are so many.
CACHED_WORDS = 1 << 17

_WORD = re.compile(r"\w+")


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


@lru_cache(maxsize=1)
def _random():
    """Fixed pseudo-random multipliers and masks of the hash functions."""
    import numpy as np

    rnd = np.random.Generator(np.random.PCG64(20240229))
    odd = lambda n, kind: rnd.integers(0, np.iinfo(kind).max, n, dtype=kind, endpoint=True) | kind(1)
    return {"place": odd(64, np.uint64), "times": odd(HASHES, np.uint32)[:, None], "plus": odd(HASHES, np.uint32)[:, None], "band": odd(ROWS, np.uint64)}


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int):
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import numpy as np

    if not text:
        return np.empty(0, np.uint64)
    words = _WORD.findall(text.lower()) or [text]
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    place = _random()["place"]
    width = min(size, len(h))
    made = sum((h[i : len(h) - width + 1 + i] * place[i] for i in range(width)), np.full(len(h) - width + 1, width, np.uint64))
    return np.unique(_mixed(made))


def class_key(found) -> bytes:
    """128 bits that tell sets of shingles apart."""
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def minhashes(found):
    import numpy as np

    r, least = _random(), None
    for i in range(0, len(found), 2048):
        part = (found[i : i + 2048] >> np.uint64(32)).astype(np.uint32)
        now = ((part ^ r["plus"]) * r["times"]).min(axis=1)
        least = now if least is None else np.minimum(least, now)
    return least


def bands(signature):
    import numpy as np

    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    return _mixed((rows * _random()["band"]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each multiple of STEP compared values, the matches that keep a pair.

    For a uniform prior, P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    found = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append(m)
    return tuple(found)


def with_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__id``, the id or its stand-in, and ``__hash`` of the text."""
    kind, mark = dict(docs.dtypes)[id_col], F.xxhash64(text_col)
    if kind == "string":
        given = F.coalesce(id_col, F.concat(F.lit("\U0010ffff"), F.hex(mark)))
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        given = F.coalesce(F.col(id_col).cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(mark, 2))
    else:
        given = F.col(id_col)
    return docs.withColumns({"__id": given, "__hash": mark})


def sketch(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, given, mark, key, n, bands, bytes)``: the id with stand-ins and as it is, a hash of the text, and its sketch, null where there is no shingle."""
    marked = with_ids(docs, id_col, text_col)
    kinds = dict(marked.dtypes)

    def row(doc_id, given, mark, text):
        found = shingles(text, size)
        if not len(found):
            return doc_id, given, mark, None, None, None, None
        values = minhashes(found)
        return doc_id, given, mark, class_key(found), len(found), bands(values).tolist(), values.astype("u1").tobytes()

    schema = f"doc_id {kinds['__id']}, given {kinds[id_col]}, mark long, key binary, n long, bands array<long>, bytes binary"
    return map_rows(marked.select("__id", id_col, "__hash", text_col), row, schema)


def _bytes(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _likely(pairs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``(u, v)`` of the links that may reach the threshold; ``pairs`` has both ends' sizes and bytes."""

    def batches(source):
        import numpy as np

        for batch in source:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy() for c in ("n_u", "n_v"))
            left = np.flatnonzero(np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)
            a, b = _bytes(batch.column("bytes_u")), _bytes(batch.column("bytes_v"))
            left, _ = _pruned(left, lambda at, part: (a[at, part] == b[at, part]).sum(axis=1), threshold, tolerance)
            yield batch.select(["u", "v"]).take(pa.array(left))

    return pairs.select("u", "v", "n_u", "n_v", "bytes_u", "bytes_v").mapInArrow(batches, "u binary, v binary")


def _pruned(left, equal_in, threshold: float, tolerance: float):
    """What is left of the candidates after comparing their values step by step, and their matches."""
    import numpy as np

    equal = np.zeros(len(left), np.int64)
    for k, enough in enumerate(least_matches(threshold, tolerance)):
        if not len(left):
            break
        equal += equal_in(left, slice(k * STEP, (k + 1) * STEP))
        keep = equal >= enough
        left, equal = left[keep], equal[keep]
    return left, equal


def _joiner(threshold: float, tolerance: float):
    """Links ``(u, v)`` between parts of a bucket: as few as join what may reach the threshold."""

    def join(group: pa.Table) -> pa.Table:
        import numpy as np

        group = group.sort_by([("n", "ascending"), ("key", "ascending")])
        n, values, named = group.column("n").to_numpy(), _bytes(group.column("bytes")), group.column("part").to_pylist()
        blocks = group.column("block").to_numpy()
        place = group.column("task")[0].as_py().split(".")[1:]
        between = place[0] != place[1]
        part = np.unique(np.array(named, object), return_inverse=True)[1]
        out = []
        for i in range(len(n)):
            last = np.searchsorted(n, n[i] / threshold + 1e-9, side="right")
            left = np.arange(i + 1, last)
            left = left[part[left] != part[i]]
            if between:
                left = left[blocks[left] != blocks[i]]
            left, _ = _pruned(left, lambda at, step, i=i: (values[at, step] == values[i, step]).sum(axis=1), threshold, tolerance)
            for j in left.tolist():
                if part[j] != part[i]:
                    out.append((named[i], named[j]))
                    part[part == part[j]] = part[i]
        return pa.table([pa.array([u for u, _ in out], pa.binary()), pa.array([v for _, v in out], pa.binary())], names=["u", "v"])

    return join


def _families(reps: DataFrame, threshold: float, tolerance: float, bucket_docs: int) -> DataFrame:
    """``(key, family)`` of representatives that are joined to others by links which may reach the threshold."""
    bands_ = reps.select("key", F.explode("bands").alias("band"))
    repeated = written(bands_.groupBy("band").agg(F.count("*").alias("rows")).where("rows > 1").select("band"), "bands")
    shared = maybe_in(bands_, F.col("band"), repeated, F.col("band"), repeated.count()).where("__maybe").select("band", "key")
    buckets = written(shared.join(repeated, "band"), "buckets")
    heads = buckets.groupBy("band").agg(F.min("key").alias("head"))
    star = buckets.join(heads, "band").where("key <> head").select(F.col("key").alias("u"), F.col("head").alias("v")).distinct()
    star = written(star, "stars")
    ends = buckets.select("key").distinct()
    signed = written(maybe_in(reps, F.col("key"), ends, F.col("key"), ends.count()).where("__maybe").select("key", "n", "bytes"), "bytes")
    side = lambda c: signed.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("bytes").alias(f"bytes_{c}"))
    links = written(_likely(star.join(side("u"), "u").join(side("v"), "v"), threshold, tolerance), "links")
    joined = written(connected_components(links), "joined")

    parted = written(buckets.join(joined.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("component", "key").alias("part")), "parts")
    # a bucket of two was compared by its star; buckets of the same documents are compared once
    known = parted.groupBy("band").agg(F.count("*").alias("docs"), F.min("part").alias("least"), F.max("part").alias("most"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("set"))
    open_ = written(known.where("docs > 2 and least <> most").groupBy("docs", "set").agg(F.min("band").alias("band")).select("band", "docs"), "open")
    if open_.isEmpty():
        return joined.select(F.col("node").alias("key"), F.col("component").alias("family"))
    blocks = F.ceil(F.col("docs") / F.lit(bucket_docs))
    rows = parted.join(open_, "band").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", F.lit(11)), F.col("blocks")))
    name = lambda j: F.concat_ws(".", F.col("band").cast("string"), F.least("block", j).cast("string"), F.greatest("block", j).cast("string"))
    rows = rows.withColumn("task", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), name)))
    groups = rows.select("task", "block", "key", "part").join(signed, "key").groupBy("task")
    more = written(connected_components(groups.applyInArrow(_joiner(threshold, tolerance), "u binary, v binary")), "joined-parts")
    whole = more.select(F.col("node").alias("part"), F.col("component").alias("whole"))
    every = joined.select(F.col("node").alias("key"), F.col("component").alias("part")).union(more.select("node", "node")).distinct()
    return every.join(whole, "part", "left").select("key", F.coalesce("whole", "part").alias("family"))


def _links(sides, sets, signatures, copies, threshold, tolerance):
    """Links of each document and a root of each: pairs of one family, or of two blocks of it."""
    import numpy as np

    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    links, root = [0] * n, list(range(n))

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    for at, i in enumerate(order):
        last = np.searchsorted(ordered, sizes[i] / threshold + 1e-9, side="right")
        left = order[at + 1 : last]
        if sides is not None:
            left = left[sides[left] != sides[i]]
        left, _ = _pruned(left, lambda at, part, i=i: (signatures[at, part] == signatures[i, part]).sum(axis=1), threshold, tolerance)
        for j in left.tolist():
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared >= threshold * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                links[i] += copies[j]
                links[j] += copies[i]
                a, b = top(int(i)), top(j)
                root[max(a, b)] = min(a, b)
    return links, [top(i) for i in range(n)]


def _verifier(size: int, threshold: float, tolerance: float):
    def verify(group: pa.Table) -> pa.Table:
        import numpy as np

        group = group.sort_by([("family", "ascending"), ("rep", "ascending"), ("key", "ascending")])
        columns = {c: group.column(c).to_pylist() for c in ("group", "family", "key", "rep", "copies", "side", "split", "text")}
        out = {"key": [], "links": [], "root": [], "class_id": [], "split": []}
        rows = list(range(len(columns["key"])))
        while rows:
            family = columns["family"][rows[0]]
            here = [i for i in rows[: next((k for k, i in enumerate(rows) if columns["family"][i] != family), len(rows))]]
            rows = rows[len(here) :]
            kept, sets, seen = [], [], set()
            for i in here:
                found = shingles(columns["text"][i], size)
                key = columns["key"][i]  # ids may repeat: the text must be the representative's
                if key not in seen and len(found) and class_key(found) == key:
                    seen.add(key), kept.append(i), sets.append(found)
            sides = np.array([columns["side"][i] for i in kept])
            split = columns["split"][here[0]]
            place = columns["group"][here[0]].split(".")[1:]  # a block may be empty, so the sides present do not tell
            between = split and place[:2] != place[2:]
            links, roots = _links(sides if between else None, sets, np.array([minhashes(s) for s in sets]), [columns["copies"][i] for i in kept], threshold, tolerance)
            out["key"] += [columns["key"][i] for i in kept]
            out["links"] += links
            out["root"] += [columns["key"][kept[r]] for r in roots]
            out["class_id"] += [columns["rep"][kept[r]] for r in roots]
            out["split"] += [split] * len(kept)
        return pa.table([pa.array(out["key"], pa.binary()), pa.array(out["links"], pa.int64()), pa.array(out["root"], pa.binary()), pa.array(out["class_id"], group.schema.field("rep").type), pa.array(out["split"], pa.bool_())], names=list(out))

    return verify


def _grouped(members: DataFrame, threshold: float, block_docs: int, block_shingles: int) -> DataFrame:
    """Members with the ``task`` and ``side`` of each group of step 4 that they take part in."""
    sizes = members.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    large = written(sizes.where((F.col("docs") > block_docs) | (F.col("shingles") > 2 * block_shingles)), "large-families")
    members = lookup(members, large.select("family", F.lit(True).alias("split")), ["family"]).na.fill(False, ["split"])
    total = (members.agg(F.sum("n")).first()[0] or 0) - (large.agg(F.sum("shingles")).first()[0] or 0)
    packs = max(1, -(-total // PACK_SHINGLES))
    small = members.where("not split").withColumn("task", F.array(F.concat(F.lit("p"), F.pmod(F.xxhash64("family"), F.lit(packs)).cast("string")))).withColumn("side", F.lit("a"))
    width = F.log(F.lit(1.01 / threshold))
    parts = members.where("split").withColumn("g", F.floor(F.log("n") / width))
    blocks = parts.groupBy("family", "g").agg(F.greatest(F.ceil(F.count("*") / F.lit(block_docs)), F.ceil(F.sum("n") / F.lit(block_shingles))).alias("blocks"))
    near = (
        blocks.join(blocks.select("family", (F.col("g") + 1).alias("g"), F.col("blocks").alias("below")), ["family", "g"], "left")
        .join(blocks.select("family", (F.col("g") - 1).alias("g"), F.col("blocks").alias("above")), ["family", "g"], "left")
        .na.fill(0, ["below", "above"])
    )
    parts = lookup(parts, written(near, "family-blocks"), ["family", "g"]).withColumn("i", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")))
    name = lambda g, i, h, j: F.concat_ws(".", F.hex("family"), g.cast("string"), i.cast("string"), h.cast("string"), j.cast("string"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    g, i = F.col("g"), F.col("i")
    same = F.transform(upto(F.col("blocks")), lambda j: name(g, F.least(i, j), g, F.greatest(i, j)))
    below = F.transform(upto(F.col("below")), lambda j: name(g - 1, j, g, i))
    above = F.transform(upto(F.col("above")), lambda j: name(g, i, g + 1, j))
    parts = parts.withColumn("task", F.concat(same, below, above)).withColumn("side", F.concat_ws(".", g.cast("string"), i.cast("string")))
    wanted = ["family", "key", "rep", "mark", "copies", "split", "side", "task"]
    return small.select(*wanted).unionByName(parts.select(*wanted))


def jaccard_classes(
    docs: DataFrame,
    size: int = 5,
    threshold: float = 0.8,
    tolerance: float = 1e-6,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_docs: int = BLOCK_DOCS,
    block_shingles: int = BLOCK_SHINGLES,
    bucket_docs: int = BUCKET_DOCS,
) -> DataFrame:
    """``(id_col, class_id, n_links)``, one row for each row of ``docs``."""
    found = _classes(docs, size, threshold, tolerance, id_col, text_col, block_docs, block_shingles, bucket_docs)
    return found.select(F.col("given").alias(id_col), "class_id", "n_links")


def _classes(docs: DataFrame, size: int, threshold: float, tolerance: float, id_col: str, text_col: str, block_docs: int, block_shingles: int, bucket_docs: int) -> DataFrame:
    """``(doc_id, given, mark, class, class_id, n_links)``; ``class`` tells classes apart, null where there is no shingle."""
    bounded_batches(docs.sparkSession)
    sketched = written(sketch(docs, size, id_col, text_col), "sketch")
    keyed = sketched.where("key is not null")
    kind = dict(sketched.dtypes)["doc_id"]
    firsts = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "bands", "bytes")))
    firsts = written(firsts, "representatives")
    reps = firsts.select("key", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark"), "copies", "n")
    families = _families(firsts.select("key", "n", "bands", "bytes"), threshold, tolerance, bucket_docs)
    members = written(families.join(reps, "key"), "members")
    tasks = _grouped(members, threshold, block_docs, block_shingles)
    texts = with_ids(docs.select(id_col, text_col), id_col, text_col).select(F.col("__id").alias("rep"), F.col("__hash").alias("mark"), F.col(text_col).alias("text"))
    wanted = maybe_in(texts, F.struct("rep", "mark"), members, F.struct("rep", "mark"), members.count()).where("__maybe").groupBy("rep", "mark").agg(F.first("text").alias("text"))
    groups = tasks.join(wanted, ["rep", "mark"]).select("*", F.explode("task").alias("group")).drop("task", "mark")
    verified = written(groups.groupBy("group").applyInArrow(_verifier(size, threshold, tolerance), f"key binary, links long, root binary, class_id {kind}, split boolean"), "verified")
    whole = verified.where("not split").select("key", "links", F.col("root").alias("class"), "class_id")
    parts = verified.where("split")
    joined = written(connected_components(parts.select(F.col("key").alias("u"), F.col("root").alias("v"))), "split-classes")
    least = joined.join(reps, joined["node"] == reps["key"]).groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = joined.join(least, "component").select(F.col("node").alias("key"), F.col("component").alias("class"), "class_id")
    split = parts.groupBy("key").agg(F.sum("links").alias("links")).join(classes, "key", "left")
    linked = whole.unionByName(split.select("key", "links", "class", "class_id"))
    copied = reps.join(linked, "key", "left").where("copies > 1 or class is not null").select(
        "key", F.coalesce("class", "key").alias("class"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    # a document that is neither copied nor linked is its own class, and needs no row here
    found = lookup(sketched.select("doc_id", "given", "mark", "key"), written(copied, "classes"), ["key"])
    return found.select("doc_id", "given", "mark", F.coalesce("class", "key").alias("class"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(
    docs: DataFrame,
    size: int = 5,
    threshold: float = 0.8,
    tolerance: float = 1e-6,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_docs: int = BLOCK_DOCS,
    block_shingles: int = BLOCK_SHINGLES,
    bucket_docs: int = BUCKET_DOCS,
) -> DataFrame:
    """One row of each class, the one with the least id; all columns stay.

    Of rows with the same id and text one is kept; rows with the same id and other texts
    are documents of their own, and of those of one class the least hash of the text stays.
    Documents that are alone in their class are told by a filter and pass without a shuffle.
    Columns may have any names.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _classes(named, size, threshold, tolerance, "id", "text", block_docs, block_shingles, bucket_docs)
    alone = F.when(F.col("class").isNull(), F.struct("doc_id", "mark"))
    labelled = written(found.select("doc_id", "mark", "class", alone.alias("alone")), "labelled")
    groups = labelled.groupBy("class", "alone").agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "mark")).alias("first")).where("rows > 1")
    groups = written(groups.select("class", "alone", "first"), "groups")
    rows = lookup(labelled, groups, ["class", "alone"], "inner").groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__hash")).agg(F.first((F.struct("doc_id", "mark") == F.col("first"))).alias("__stays"))
    rows = written(rows, "grouped")
    pair = F.struct("__id", "__hash")
    given = with_ids(as_row(docs, id=F.col(id_col), text=F.col(text_col)), "id", "text").select("row", "__id", "__hash")
    marked = maybe_in(given, pair, rows, pair, rows.count())
    once = marked.where("__maybe").dropDuplicates(["__id", "__hash"]).join(rows, ["__id", "__hash"], "left").where("coalesce(__stays, true)")
    return marked.where("not __maybe").select("row.*").unionByName(once.select("row.*"))
