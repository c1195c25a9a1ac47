"""A Python data source for folders of mail archives and eDiscovery exports, batch and stream.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("case_archive").load("s3://bucket/cases")

Files below the path, at any depth: `.mbox` mail archives, `.eml` mails, `.jsonl` records one a line,
as in `part-*.json` files that Spark writes, and `items*.json` arrays of eDiscovery records.  Mail archives and line files are cut into ranges
of RANGE_BYTES, each a task; a mail or line belongs to the range that it starts in.  Filters on
custodian (the first folder, without `custodian=`), file and kind choose files before any is opened; Spark applies all
others.  As a stream, new files come once, in order of modification time, then name.

Paths are any that pyarrow's file systems reach.
"""

from __future__ import annotations

import email
import email.policy
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
)
from pyspark.sql.types import StructType

from caseloom.sources.files import record_text

SCHEMA = "custodian string, file string, kind string, position long, subject string, sender string, sent string, text string"
RANGE_BYTES = 32 << 20
KINDS = {".mbox": "mail_archive", ".eml": "mail", ".jsonl": "record_lines", ".json": "record_items"}
#: Columns whose filters choose files.
BY_FILE = ("custodian", "file", "kind")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Part(InputPartition):
    """A range of a file."""

    path: str
    file: str
    kind: str
    start: int
    stop: int


@dataclass(frozen=True)
class Found:
    path: str
    file: str
    kind: str
    size: int
    changed: int

    @property
    def custodian(self) -> str:
        return _custodian(self.file)


def _custodian(file: str) -> str:
    return file.split("/")[0].removeprefix("custodian=") if "/" in file else ""


def _kind(name: str) -> str | None:
    kind = KINDS.get(posixpath.splitext(name)[1].lower())
    if kind == "record_items" and not name.lower().startswith("items"):
        return "record_lines" if name.startswith("part-") else None
    return kind


def listed(path: str) -> list[Found]:
    """The files below path that this source reads, by name."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    out = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        kind = _kind(posixpath.basename(info.path)) if info.type == fs.FileType.File else None
        hidden = any(p.startswith(("_", ".")) for p in posixpath.relpath(info.path, root).split("/"))
        if kind and not hidden:
            out.append(Found(info.path, posixpath.relpath(info.path, root), kind, info.size, info.mtime_ns or 0))
    return sorted(out, key=lambda f: f.file)


def _parts(files: list[Found], size: int) -> list[Part]:
    out = []
    for f in files:
        step = size if f.kind in ("mail_archive", "record_lines") else max(f.size, 1)
        out += [Part(f.path, f.file, f.kind, at, min(at + step, f.size)) for at in range(0, max(f.size, 1), step)]
    return out


def _lines_from(stream, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that start at or after start."""
    at = start
    if start:  # the line that goes on at start is that of the range before
        stream.seek(start - 1)
        at = start - 1 + len(stream.readline())
    while line := stream.readline():
        yield at, line
        at += len(line)


def _mail_row(raw: bytes) -> tuple:
    mail = email.message_from_bytes(raw, policy=email.policy.default)
    body = mail.get_body(preferencelist=("plain", "html"))
    try:
        text = body.get_content() if body else ""
    except (LookupError, UnicodeError):  # an unknown or wrong character set
        text = (body.get_payload(decode=True) or b"").decode("utf-8", "replace")
    return str(mail["subject"] or ""), str(mail["from"] or ""), str(mail["date"] or ""), text.strip()


def _record_row(record: dict) -> tuple:
    first = lambda *names: next((str(record[n]) for n in names if record.get(n)), "")
    return first("Subject/Title"), first("Sender/Author", "Sender"), first("Date", "Email date sent"), record_text(record)


def _rows(stream, part: Part) -> Iterator[tuple[int, tuple]]:
    """(position, row) of a range: the byte it starts at, or its number in an array."""
    if part.kind == "mail":
        yield 0, _mail_row(stream.read())
    elif part.kind == "record_items":
        items = json.loads(stream.read().decode("utf-8", "replace"))
        for n, record in enumerate(items if isinstance(items, list) else []):
            if isinstance(record, dict):
                yield n, _record_row(record)
    elif part.kind == "record_lines":
        for at, line in _lines_from(stream, part.start):
            if at >= part.stop:
                return
            try:
                record = json.loads(line)
            except ValueError:  # a malformed line is left out
                continue
            if isinstance(record, dict):
                yield at, _record_row(record)
    else:  # a mail starts with "From " after an empty line
        before = stream.before(part.start)
        start, mail = None, []
        empty = not part.start or before.endswith((b"\n\n", b"\n\r\n", b"\n\r"))
        for at, line in _lines_from(stream, part.start):
            if empty and line.startswith(b"From "):
                if start is not None:
                    yield start, _mail_row(b"".join(mail))
                if at >= part.stop:
                    return
                start, mail = at, []
            elif start is not None:
                mail.append(line[1:] if line.startswith(b">From ") else line)
            elif at >= part.stop:
                return
            empty = not line.strip()
        if start is not None:
            yield start, _mail_row(b"".join(mail))


class _Reading:
    """What batch and stream readers share."""

    path: str

    def read(self, part: Part) -> Iterator[tuple]:
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        custodian = _custodian(part.file)
        with system.open_input_file(part.path) as stream:
            for position, row in _rows(_Buffered(stream), part):
                yield (custodian, part.file, part.kind, position, *row)


class _Buffered:
    """Lines of a random-access file, read in blocks."""

    def __init__(self, stream, block: int = 1 << 20) -> None:
        self._stream, self._block, self._held = stream, block, b""

    def seek(self, at: int) -> None:
        self._stream.seek(at)
        self._held = b""

    def before(self, at: int, size: int = 4) -> bytes:
        """The bytes right before a place."""
        self.seek(max(0, at - size))
        out = self._stream.read(min(at, size))
        self.seek(0)
        return out

    def read(self) -> bytes:
        return self._held + self._stream.read()

    def readline(self) -> bytes:
        parts, at = [], self._held.find(b"\n")
        while at < 0:
            parts.append(self._held)
            self._held = self._stream.read(self._block)
            if not self._held:
                return b"".join(parts)
            at = self._held.find(b"\n")
        line, self._held = self._held[: at + 1], self._held[at + 1 :]
        return b"".join([*parts, line])


class ArchiveReader(_Reading, DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in BY_FILE:
                self.wanted.append((f.attribute[0], frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f  # Spark applies it

    def partitions(self) -> list[Part]:
        files = [f for f in listed(self.path) if all(getattr(f, column) in values for column, values in self.wanted)]
        return _parts(files, self.size) or [Part("", "", "", 0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        return super().read(part) if part.path else iter(())


class ArchiveStream(_Reading, DataSourceStreamReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1, "file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max(((f.changed, f.file) for f in listed(self.path)), default=(-1, ""))
        return {"changed": last[0], "file": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        place = lambda o: (o["changed"], o["file"])
        return _parts([f for f in listed(self.path) if place(start) < (f.changed, f.file) <= place(end)], self.size)


class ArchiveSource(DataSource):
    """Options: path, and range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "case_archive"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        path = self.options.get("path")
        if not path:
            raise ValueError("path is required")
        return path, int(self.options.get("range_bytes", RANGE_BYTES))

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(*self._options())

    def streamReader(self, schema: StructType) -> ArchiveStream:  # noqa: N802
        return ArchiveStream(*self._options())


def register(spark) -> None:
    """Make the source known to a session and let filters reach it."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set(PUSHDOWN, "true")
