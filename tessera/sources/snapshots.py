"""Folders of tables that change as one: new versions are written beside the old and then named.

A version is a manifest, ``_versions/00000007.json``, that names the folder of each table and some
properties. Tables are written to new folders first, and the manifest is created last, by a create
that fails if the name is taken; so a save that fails leaves the version before it, a table may be
computed from the version that it replaces, and of two writers one is refused. Readers keep the
folders of the version that they opened. A table that did not change is named again, not copied.

``vacuum`` deletes folders that only older versions than the ones to keep name.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_VERSIONS = "_versions"


class VersionConflict(RuntimeError):
    """Another writer named a version since this one began."""


def _system(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _text(spark: SparkSession, path: str) -> str:
    fs, at = _system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a folder, oldest first."""
    fs, at = _system(spark, posixpath.join(path, _VERSIONS))
    names = [e.getPath().getName() for e in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


@dataclass
class Snapshot:
    """One version: its tables, the folders that hold them, and its properties."""

    spark: SparkSession
    path: str
    version: int
    folders: dict[str, str]
    properties: dict = field(default_factory=dict)

    def folder(self, name: str) -> str:
        return posixpath.join(self.path, self.folders[name])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.folder(name))


def current(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """The newest version, or the one asked for; none in a folder without any.

    A manifest that is still being written is no version yet.
    """
    for n in reversed(versions(spark, path) if version is None else [version]):
        try:
            found = json.loads(_text(spark, posixpath.join(path, _VERSIONS, f"{n:08d}.json")))
        except json.JSONDecodeError:
            continue
        return Snapshot(spark, path, n, found["folders"], found["properties"])
    return None


def opened(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    found = current(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"no version in {path}")
    return found


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame | str], properties: dict | None = None, mode: str = "errorifexists") -> Snapshot:
    """Writes tables as the next version; a folder's name in place of a table takes it over.

    A DataFrame is written as Parquet; for other layouts, write to ``new_folder`` and give its
    name. Modes are ``errorifexists`` and ``overwrite``.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("the mode must be errorifexists or overwrite")
    before = versions(spark, path)
    if before and mode != "overwrite":
        raise FileExistsError(path)
    folders = {}
    for name, made in tables.items():
        folders[name] = made if isinstance(made, str) else new_folder(name)
        if not isinstance(made, str):
            made.write.parquet(posixpath.join(path, folders[name]))
    number = max(before, default=0) + 1
    fs, at = _system(spark, posixpath.join(path, _VERSIONS, f"{number:08d}.json"))
    try:
        stream = fs.create(at, False)
    except Py4JJavaError as taken:
        if not fs.exists(at):
            raise
        raise VersionConflict(f"version {number} of {path} was written meanwhile") from taken
    try:
        stream.write(json.dumps({"folders": folders, "properties": properties or {}}).encode())
    finally:
        stream.close()
    return Snapshot(spark, path, number, folders, properties or {})


def new_folder(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex}"


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Deletes the folders that none of the last ``keep`` versions names, and what failed saves left; their names.

    No writer may be at work, and readers of older versions must be done.
    """
    if keep < 1:
        raise ValueError("one version stays at least")
    known = versions(spark, path)
    held = {f for n in known[-keep:] for f in opened(spark, path, n).folders.values()}
    fs, at = _system(spark, path)
    names = [e.getPath().getName() for e in fs.listStatus(at) if e.isDirectory()]
    gone = [n for n in names if n not in held and re.search(r"-[0-9a-f]{32}$", n)]  # only what new_folder named
    for n in known[:-keep]:
        fs.delete(_system(spark, posixpath.join(path, _VERSIONS, f"{n:08d}.json"))[1], False)
    for name in gone:
        fs.delete(_system(spark, posixpath.join(path, name))[1], True)
    return sorted(gone)
