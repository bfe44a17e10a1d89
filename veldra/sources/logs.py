"""Scan histories, checklists and trackers as a data source of Spark.  S10 to S15, S24, K12, G1.

    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("veldra_log").option("kind", "history").load(folder)
    spark.readStream.format("veldra_log").option("kind", "pending").load(folder)

A partition is a byte range of a file, so large files are read by many tasks.  Filters on equality are taken over by the
reader, which then makes no other rows.  The stream's offset is the length that each file had, so what is appended to a
file later comes with a later batch; it only reads a file up to its last whole line.  Files are opened through Arrow's
file systems, local or remote ones, by the path's scheme.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from veldra.sources.files import HISTORY, tracker_columns

SCHEMAS = {
    "history": HISTORY,
    "pending": "url string, company string, title string",
    "tracker": "num int, date string, company string, role string, score string, status string, pdf string, report string, notes string, location string, via string",
}
#: Bytes of a partition.
SPLIT = 16 << 20

_PENDING = re.compile(r"^- \[ \] (\S+) \| ([^|]*) \| ([^|]*)")
_SCORE = re.compile(r"^(?:\d+(?:\.\d+)?/5|N/A|DUP)$")


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in a range of bytes; ``end`` is also where the file ends for this read."""

    path: str
    start: int
    end: int
    size: int
    #: of a tracker, places of the columns
    head: dict[str, int] | None = None


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def files(path: str) -> dict[str, int]:
    """Path -> length of a folder's files, or of the one file; hidden ones aside."""
    from pyarrow import fs

    system, at = _open(path)
    scheme = path[: -len(at)] if path.endswith(at) else ""
    info = system.get_file_info(at)
    found = system.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    return {scheme + f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


def ranges(lengths: dict[str, int], since: dict[str, int] | None = None, split: int = SPLIT) -> list[Range]:
    since = since or {}
    return [Range(p, a, min(a + split, n), n) for p, n in lengths.items() for a in range(since.get(p, 0), n, split)]


def lines(part: Range) -> Iterator[str]:
    """Lines that begin in the range, without their ends."""
    system, at = _open(part.path)
    with system.open_input_file(at) as f:
        first = part.start
        if first:
            # a line that began before the range is another's: the byte before tells
            f.seek(first - 1)
            rest = b""
            while b"\n" not in rest and (more := f.read(64 << 10)):
                rest += more
            first = first + rest.find(b"\n") if b"\n" in rest else part.size
        f.seek(first)
        held = b""
        while first < part.end and (more := f.read(min(1 << 20, part.size - first - len(held)))):
            held += more
            *whole, held = held.split(b"\n")
            for line in whole:
                if first >= part.end:
                    return
                first += len(line) + 1
                yield line.rstrip(b"\r").decode("utf-8", "replace")
        if held and first < part.end:
            yield held.rstrip(b"\r").decode("utf-8", "replace")


class Parser:
    def __init__(self, kind: str, at: dict[str, int] | None = None):
        self.kind, self.at = kind, at or {}

    def row(self, line: str) -> tuple | None:
        if self.kind == "history":
            cells = line.split("\t")
            return tuple([*(c or None for c in cells), *[None] * 9][:9]) if line else None
        if self.kind == "pending":
            m = _PENDING.match(line)
            return tuple(x.strip(" ") for x in m.groups()) if m else None
        if not line.startswith("|"):
            return None
        cells = [c.strip() for c in line.split("|")]
        at = self.at
        if len(cells) <= max(at.values()) or not re.fullmatch(r"[+-]?\d+", cells[at["num"]]):
            return None
        get = lambda k: cells[at[k]] if k in at else ""
        score, status = get("score"), get("status")
        known = lambda x: bool(_SCORE.match(x.replace("**", "")))
        if not known(score) and known(status):
            score, status = status, score
        return (int(get("num")), get("date"), get("company"), get("role"), score, status, *(get(k) for k in ("pdf", "report", "notes", "location", "via")))


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "veldra_log"

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def _kind(self) -> str:
        kind = self.options.get("kind", "history")
        if kind not in SCHEMAS:
            raise ValueError(f"kind must be one of {', '.join(SCHEMAS)}")
        return kind

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self._kind(), self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogStream(self._kind(), self.options, schema)


class _Reading:
    def __init__(self, kind: str, options: dict[str, Any], schema: StructType):
        self.kind, self.path, self.split = kind, options["path"], int(options.get("split", SPLIT))
        self.names = schema.fieldNames()
        self.wanted: list[tuple[int, Any]] = []

    def planned(self, lengths: dict[str, int], since: dict[str, int] | None = None) -> list[Range]:
        """Ranges of the files; a tracker's headings stand in its first lines, where only the first range sees them."""
        parts = ranges(lengths, since, self.split)
        if self.kind == "tracker":
            first = lambda p: [x for _, x in zip(range(200), lines(Range(p, 0, lengths[p], lengths[p])), strict=False)]
            heads = {p: tracker_columns(first(p)) for p in {r.path for r in parts}}
            for r in parts:
                r.head = heads[r.path]
        return parts

    def read(self, partition: Range) -> Iterator[tuple]:
        parser = Parser(self.kind, partition.head)
        for line in lines(partition) if partition.size else ():
            row = parser.row(line)
            if row is not None and all(row[k] == v for k, v in self.wanted):
                yield row


class LogReader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]):
        """Equality of a column with a value is taken over; Spark keeps the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.value is not None:
                self.wanted.append((self.names.index(f.attribute[0]), f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        return self.planned(files(self.path)) or [Range(self.path, 0, 0, 0)]


class LogStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The length of each file up to its last whole line."""
        return {p: n for p, size in files(self.path).items() if (n := _whole(p, size))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.planned(end, start)

    def commit(self, end: dict) -> None:
        """Files are only appended to; there is nothing to let go of."""


def _whole(path: str, size: int) -> int:
    system, at = _open(path)
    with system.open_input_file(at) as f:
        end = size
        while end > 0:
            start = max(0, end - (64 << 10))
            f.seek(start)
            k = f.read(end - start).rfind(b"\n")
            if k >= 0:
                return start + k + 1
            end = start
    return 0


def read_log(spark, path: str, kind: str, split: int = SPLIT):
    """Batch rows of a folder's logs, with filters on equality pushed to the reader, which Spark asks the session to
    allow."""
    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("veldra_log").option("kind", kind).option("split", split).load(path)


def stream_log(spark, path: str, kind: str):
    """The same as a stream."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("veldra_log").option("kind", kind).load(path)
