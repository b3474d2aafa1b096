"""Tables that cut lineage, written to the folder which driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset,
as in local tests, a folder of the local machine is taken; a cluster without the
setting is refused, because executors could not read each other's files.

A table lives until ``drop``, the end of the ``scratch`` block it was written in, or,
outside of any, the end of the driver's Python.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import lru_cache

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_scope: ContextVar[list[Written] | None] = ContextVar("scope", default=None)
_kept: list[Written] = []


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tessera-')}"


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_dir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the files of a query's shuffles when the query has ended.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is stored within leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


class Written:
    """A DataFrame stored as Parquet in the shared folder; ``drop`` deletes it."""

    def __init__(self, df: DataFrame, name: str, scope: list[Written] | None = None, **options):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        here = scope if scope is not None else _scope.get()
        (_kept if here is None else here).append(self)
        with shuffles_freed(self.spark):
            df.write.options(**options).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written within are deleted at the end, so results must be stored before."""
    token = _scope.set(made := [])
    try:
        yield
    finally:
        _scope.reset(token)
        for t in made:
            t.drop()


@atexit.register
def _clean() -> None:
    for t in _kept:
        with suppress(Py4JError, OSError, AttributeError):  # the JVM may be gone, or the session stopped
            t.drop()


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` computed once, kept in the shared folder and read back; options are the writer's."""
    return Written(df, name, **options).df


def settled(make: Callable[[], DataFrame], name: str) -> Written:
    """What ``make`` gives, stored; the tables that it wrote on the way are deleted."""
    outer = _scope.get()
    with scratch():
        return Written(make(), name, _kept if outer is None else outer)


#: Rows, and bytes of texts and lists, up to which a side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df``, counted now, has at most ``rows`` rows and ``size`` bytes of texts and lists."""
    kinds = {c: k for c, k in df.dtypes if k in ("string", "binary") or k.startswith("array")}
    wide = [F.coalesce(F.size(F.col(f"`{c}`")) * 16 if k.startswith("array") else F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, k in kinds.items()]
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(wide, F.lit(0)).cast("long")), F.lit(0)).alias("size")).first()
    return got["n"] <= rows and got["size"] <= size


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is small; else unmarked."""
    return F.broadcast(df) if is_small(df, rows) else df


#: Bits of the largest filter, of which 4096 bytes are a row: 64 MB.
FILTER_BITS = 1 << 29


def maybe_in(df: DataFrame, key: Column, members: DataFrame, member: Column, rows: int, flag: str = "__maybe") -> DataFrame:
    """``df`` with a boolean ``flag``, true wherever ``key`` is among the members, and rarely elsewhere.

    A filter of one hash by built-in bitmaps: about 64 bits a member, at most FILTER_BITS in
    all, so what is broadcast has a bound whatever the number of ``rows`` of ``members``.
    """
    bits = min(FILTER_BITS, 1 << max(16, (64 * max(rows, 1) - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.lit(23), c), F.lit(bits))
    maps = members.select(place(member).alias("__h")).groupBy(F.bitmap_bucket_number("__h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__h")).alias("__bits"))
    probed = df.withColumn("__h", place(key)).withColumn("__probe", F.bitmap_bucket_number("__h")).join(F.broadcast(maps), F.col("__probe") == F.col("__bucket"), "left")
    at = F.bitmap_bit_position("__h")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return probed.withColumn(flag, hit).drop("__h", "__probe", "__bucket", "__bits")


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """``df`` with dense numbers from 0 in the given order, which must be total for reruns to agree.

    Rows are sorted by range; only the counts of partitions meet in one place.
    """
    placed = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    number = F.col("__offset") + F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, number).drop("__part", "__offset", "__at")
