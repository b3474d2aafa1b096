"""``spark.read.format("fasta")`` and ``("fastq")``, and ``spark.readStream.format("fastq")``.

Files are planned as ranges of bytes and read once each, without a stored copy or a shuffle. A
range begins at the first record that starts in it and ends where the next range begins, so
records are whole, wherever the cuts fall.

FASTQ has no mark that begins records only: qualities may start with ``@``. A record is a line
with ``@`` and an id, one or more lines of letters, a line with ``+``, and as many lines of
qualities with as many characters as the letters. From a place that is no record, framing
goes on with the next line; so a record that lost or gained a line is left behind alone, and blank
lines between records are nothing. Where qualities were lost, the next record's first line may have the
right length by chance; it is told by its id, which begins as the one before up to the first digit, and by
the letters and the ``+`` below it. A range starts at the first record so defined at or after its
first byte; the range before it frames on from its own start and must arrive at just that place. If
it does not, the file is ambiguous there, which is an error that names ``split=false`` as the way out: then
each file is one range.

Both give ``(file, at, id, desc, seq[, qual], bad)``: ``at`` is the byte at which a record starts, and
orders a file. What could not be framed is one row with ``bad`` for each run of lines, with the id that
the first line shows, if any.

Options: ``rangeBytes`` (128 MB), ``split`` (true), ``glob`` for names in a folder, ``recursive`` (false), and
``maxBytesPerTrigger`` for streams. Files are opened by ``pyarrow.fs``: local paths, hdfs, s3 and gs.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE = 128 << 20
#: Small files that one task reads.
MOST_FILES = 512
#: Bytes that are fetched at once.
FETCH = 4 << 20
#: Characters and rows of an Arrow batch, but for its last record.
BATCH_CHARS, BATCH_ROWS = 8 << 20, 4096
#: Bytes at the end of a growing file that are looked at for its last whole record, at first.
TAIL = 1 << 20

_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz.-*"
_BLANKS = b" \t\r\n\v\f"
_HEAD = re.compile(rb"(\S*)\s*(.*?)\r?$", re.S)
#: What ids of a file begin with alike.
_STEM = re.compile(rb"[^0-9]*")


def opened(path: str):
    """``(file system, path in it, prefix of full names)``"""
    from pyarrow import fs

    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + path[5:].lstrip("/"), "file://"
        system, inner = fs.FileSystem.from_uri(path)
        return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return fs.LocalFileSystem(), posixpath.abspath(path), "file://"


def listed(path: str, glob: str | None, recursive: bool = False) -> list[tuple[str, int]]:
    """Full names and sizes of a file, of the files in a folder, or of those that a pattern names.

    ``glob`` has patterns for names, with ``|`` between them.
    """
    from pyarrow import fs

    system, inner, prefix = opened(path)
    if any(c in posixpath.basename(inner) for c in "*?["):
        inner, glob = posixpath.dirname(inner), posixpath.basename(inner)
        if any(c in inner for c in "*?["):
            raise ValueError("only the last part of a path may be a pattern")
    found = system.get_file_info(inner)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [found] if found.is_file else system.get_file_info(fs.FileSelector(inner, recursive=recursive))
    names = lambda i: i.is_file and (found.is_file or (not i.base_name.startswith((".", "_")) and any(fnmatch.fnmatchcase(i.base_name, g) for g in (glob or "*").split("|"))))
    return sorted((prefix + i.path, i.size) for i in infos if names(i))


@dataclass
class Range(InputPartition):
    """The records that start from ``begin`` on and before ``end``."""

    file: str
    begin: int
    end: int
    size: int
    last: bool


def ranges(files: list[tuple[str, int, int]], length: int) -> list[Range]:
    """Ranges of ``(file, begin, end)``, all of about one length."""
    made = []
    for file, begin, end in files:
        n = max(1, -(-(end - begin) // length)) if length else 1
        cuts = [begin + (end - begin) * i // n for i in range(n + 1)]
        made += [Range(file, b, e, end, e == end) for b, e in zip(cuts[:-1], cuts[1:], strict=True) if e > b]
    return made


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    ranges: list[Range]


def dealt(parts: list[Range], length: int = RANGE, files: int = MOST_FILES) -> list[Ranges]:
    """Neighbouring ranges together, up to ``length`` bytes and ``files`` ranges, so small files share a task."""
    made, size = [], 0
    for part in parts:
        size += part.end - part.begin
        if not made or size > length or len(made[-1].ranges) >= files:
            made.append(Ranges([]))
            size = part.end - part.begin
        made[-1].ranges.append(part)
    return made


class Lines:
    """The lines of a file from the first one that starts at or after ``at``, with their places.

    Lines are numbered from 0; those before ``forget`` are let go.
    """

    def __init__(self, source, at: int, size: int):
        self.source, self.size = source, size
        self.lines: list[bytes] = []
        self.starts: list[int] = []
        self.gone = 0
        self.parts: list[bytes] = []
        self.next = self.start = max(at - 1, 0)
        if at:  # the line that the byte before belongs to is another range's
            while not self.starts and self._fetch():
                pass
            if self.starts:
                del self.lines[0], self.starts[0]

    def _fetch(self) -> bool:
        if self.next >= self.size:
            return False
        piece = self.source.read_at(min(FETCH, self.size - self.next), self.next)
        if not piece:
            raise OSError("the file is shorter than it was")
        self.next += len(piece)
        self.parts.append(piece)
        ended = self.next >= self.size
        if b"\n" in piece or ended:
            made = b"".join(self.parts).split(b"\n")
            rest = made.pop()
            if ended and rest:
                made.append(rest)
                rest = b""
            for line in made:
                self.lines.append(line)
                self.starts.append(self.start)
                self.start += len(line) + 1
            self.parts = [rest]
        return True

    def line(self, i: int) -> bytes | None:
        while i - self.gone >= len(self.lines):
            if not self._fetch():
                return None
        return self.lines[i - self.gone]

    def at(self, i: int) -> int:
        """Where a line starts; after the last one, the end of the file."""
        return self.starts[i - self.gone] if self.line(i) is not None else self.size

    def forget(self, i: int) -> None:
        if i - self.gone > 50_000:
            del self.lines[: i - self.gone], self.starts[: i - self.gone]
            self.gone = i


def _head(line: bytes) -> tuple[bytes, bytes | None]:
    name, desc = _HEAD.match(line, 1).groups()
    return name, desc or None


def _is_head(lines: Lines, q: int, name: bytes) -> bool | None:
    """Whether a line of qualities is the head of a record whose id is like ``name``; none, if the file ends before that is known."""
    line = lines.line(q)
    if not line or line[:1] != b"@" or not (other := _head(line)[0]) or _STEM.match(other)[0] != _STEM.match(name)[0]:
        return False
    j = q + 1
    while (line := lines.line(j)) is not None and line[:1] != b"+":
        if line.rstrip(b"\r").translate(None, _LETTERS):
            return False
        j += 1
    return None if line is None else j > q + 1


def framed(lines: Lines, i: int, ended: bool = True):
    """The FASTQ record that starts at line ``i``: ``(line after it, id, desc, seq, qual)``, or none.

    Unless the file has ``ended``, a record that later lines may show to have lost its qualities is none.
    """
    head = lines.line(i)
    if not head or head[:1] != b"@" or head[1:2].strip(_BLANKS) == b"":
        return None
    j, seq, n = i + 1, [], 0
    while True:
        line = lines.line(j)
        if line is None:
            return None
        if line[:1] == b"+":
            break
        line = line.rstrip(b"\r")
        if line.translate(None, _LETTERS):
            return None
        seq.append(line)
        n += len(line)
        j += 1
    qual = []
    for j in range(j + 1, j + 1 + len(seq)):  # noqa: B020
        line = lines.line(j)
        if line is None:
            if n:
                return None
            line = b""
        qual.append(line.rstrip(b"\r"))
        if len(qual[-1]) > n:
            return None
    if not seq or sum(map(len, qual)) != n:
        return None
    name = _head(head)[0]
    for q in range(j + 1 - len(seq), j + 1):
        if (lost := _is_head(lines, q, name)) or lost is None and not ended:
            return None
    return j + 1, *_head(head), b"".join(seq), b"".join(qual)


def first_record(source, at: int, size: int) -> int:
    """The place of the first FASTQ record at or after a byte, or the end."""
    lines, i = Lines(source, at, size), 0
    while lines.line(i) is not None and not framed(lines, i):
        i += 1
        lines.forget(i)
    return lines.at(i)


def fastq_records(source, part: Range) -> Iterator[tuple]:
    """``(at, id, desc, seq, bad, qual)``"""
    begin = first_record(source, part.begin, part.size) if part.begin else 0
    if begin >= part.end and not part.last:
        return
    stop = part.size if part.last else first_record(source, part.end, part.size)
    lines, i, bad = Lines(source, begin, part.size), 0, None
    while lines.at(i) < stop:
        at, found = lines.at(i), framed(lines, i)
        if found:
            if bad:
                yield bad
            bad = None
            yield at, found[1], found[2], found[3], False, found[4]
            i = found[0]
        else:
            line = lines.line(i)
            if line.strip(_BLANKS) and not bad:
                name = _head(line)[0] if line[:1] == b"@" else b""
                bad = at, name, None, b"", True, None
            i += 1
        lines.forget(i)
    if lines.at(i) != stop:
        raise ValueError(f"records of {part.file} overlap at byte {stop}: read it with the option split=false")
    if bad:
        yield bad


def fasta_records(source, part: Range) -> Iterator[tuple]:
    """``(at, id, desc, seq, bad)``"""
    lines, i = Lines(source, part.begin, part.size), 0
    while (line := lines.line(i)) is not None and line[:1] != b">":
        if part.begin == 0 and line.strip(_BLANKS):  # text before the first record of the file
            yield lines.at(i), b"", None, b"", True
            while (line := lines.line(i)) is not None and line[:1] != b">":
                i += 1
                lines.forget(i)
            break
        i += 1
        lines.forget(i)
    while (line := lines.line(i)) is not None and lines.at(i) < part.end:
        at, seq = lines.at(i), []
        i += 1
        while (rest := lines.line(i)) is not None and rest[:1] != b">":
            seq.append(rest)
            i += 1
            lines.forget(i)
        name, desc = _head(line)
        yield at, name, desc, b"".join(seq).translate(None, _BLANKS), not name


class _Reader:
    """What batch and stream readers share."""

    def __init__(self, options, records, columns: Sequence[str]):
        self.path, self.glob = options.get("path"), options.get("glob")
        if not self.path:
            raise ValueError("give a path")
        yes = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.length = int(options.get("rangeBytes", RANGE)) if yes("split", True) else 0
        self.limit = int(options.get("maxBytesPerTrigger", 0))
        self.recursive = yes("recursive", False)
        self.records, self.columns = records, columns

    def read(self, part: Range | Ranges | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a plan without any partition
            return
        text = pa.string()
        kinds = [text, pa.int64(), text, text, text, pa.bool_(), text][: len(self.columns)]
        rows, chars = [], 0

        def batch():
            files, *columns = zip(*rows, strict=True)
            made = [pa.array(files, text)]
            for values, kind in zip(columns, kinds[1:], strict=True):
                made.append(pa.array([v if v is None else v.decode("utf-8", "replace") for v in values], text) if kind == text else pa.array(values, kind))
            return pa.RecordBatch.from_arrays(made, names=self.columns)

        for one in part.ranges if isinstance(part, Ranges) else [part]:
            system, inner, _ = opened(one.file)
            with system.open_input_file(inner) as source:
                for row in self.records(source, one):
                    rows.append((one.file, *row))
                    chars += len(row[3])
                    if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield batch()
                        rows, chars = [], 0
        if rows:
            yield batch()


class RecordReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Range]:
        return dealt(ranges([(f, 0, n) for f, n in listed(self.path, self.glob, self.recursive)], self.length), self.length or RANGE)


def last_record(file: str, begin: int, size: int) -> int:
    """Where the last whole FASTQ record that ``begin`` leads to ends; only the end of the file is read, if that shows one."""
    system, inner, _ = opened(file)
    tail = TAIL
    with system.open_input_file(inner) as source:
        while True:
            at = max(begin, size - tail)
            lines, i, end = Lines(source, at, size), 0, None
            while lines.line(i) is not None:
                found = framed(lines, i, ended=False)
                if found and (lines.line(found[0]) is not None or source.read_at(1, size - 1) == b"\n"):
                    i, end = found[0], lines.at(found[0])
                else:
                    i += 1
                lines.forget(i)
            if end is not None or at == begin:
                return begin if end is None else end
            tail *= 8


class GrowingReader(_Reader, DataSourceStreamReader):
    """Records of files as they grow; an offset is the end of the last whole record of each file.

    ``maxBytesPerTrigger`` holds from the first batch on; the first batch after a restart takes all that
    has arrived, since Spark does not say where it starts before it asks where it may end.
    """

    at: dict | None = None

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def latestOffset(self) -> dict:
        ends, left = dict(self.at or {}), self.limit or None
        for file, size in listed(self.path, self.glob, self.recursive):
            begin = ends.get(file, 0)
            if size <= begin or left is not None and self.at is not None and left <= 0:
                continue
            upto = min(size, begin + left) if left is not None and self.at is not None else size
            end = last_record(file, begin, upto)
            while end == begin and upto < size:  # a record longer than the limit is read whole
                upto = min(size, begin + 8 * (upto - begin))
                end = last_record(file, begin, upto)
            if end > begin:
                ends[file] = end
                left = None if left is None else left - (end - begin)
        return ends

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = dict(end)
        return ranges([(f, start.get(f, 0), e) for f, e in sorted(end.items()) if e > start.get(f, 0)], self.length)

    def commit(self, end: dict) -> None:
        self.at = dict(end)


_SCHEMA = "file string, at long, id string, desc string, seq string, bad boolean"


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options, fasta_records, schema.names)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return f"{_SCHEMA}, qual string"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options, fastq_records, schema.names)

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options, fastq_records, schema.names)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    for source in (FastaSource, FastqSource):
        spark.dataSource.register(source)
