"""Logs of server-sent event lines as a data source of Spark's, for tables and for streams.

    event_log.register(spark)
    event_log.read(spark, folder, types=["answer"], files=["2024-01-*"])
    spark.readStream.format("event_log").load(folder)

A folder holds append-only files of event lines. Every line that starts with ``data: `` and holds a JSON
object is a row (file, at, type, event, problem): the file's name, the line's place in bytes, the object's
``type``, its text. Lines of other kinds, and those whose JSON cannot be read, are left out; with the option
``broken`` set to ``keep`` the latter are rows with type ``broken``, the line as event and a problem.

Files are cut into pieces of ``splitBytes``; small ones share a task. A line belongs to the piece in which it
starts. The options ``files`` (JSON array of names, a * at the end stands for any ending) choose files before any is
opened, ``types`` (JSON array) drops other rows before they leave the reader. With ``pushDown`` set to ``true``
Spark hands over its own conditions on these two columns. Scans of one loaded table seem to
share a reader (seen on Spark 4.1.2), so such a table must not be read twice with different conditions in one plan; hence the option. A stream's offset is one place per file, always behind a whole line, so what is being
written waits for its end. A piece that cannot be read is an error; with ``onError`` set to ``rows``
it gives, after the rows that could be read, one of type ``unreadable`` with its first place and the
problem, and the other pieces are read.

The files are opened by tasks through ``pyarrow.fs``, so their folder must be one that it and the tasks reach.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

NAME = "event_log"
SCHEMA = "file string, at long, type string, event string, problem string"
ARROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("type", pa.string()), ("event", pa.string()), ("problem", pa.string())])
#: Bytes of a piece and of one read; rows of a batch.
SPLIT, STEP, ROWS = 64 << 20, 1 << 20, 8192
MARK = b"data: "


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there; ``file:/x`` is read like ``file:///x``."""
    if path.startswith("file:"):
        path = "/" + unquote(path[5:]).lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def sizes(path: str) -> dict[str, int]:
    """Bytes of every file in a folder, by name; hidden ones and those that start with _ are not data."""
    system, at = opened(path)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return {i.base_name: i.size for i in found if i.type == fs.FileType.File and i.base_name[0] not in "._"}


@dataclass(frozen=True)
class Piece:
    """The lines of a file that start at ``start`` or later and before ``end``."""

    name: str
    start: int
    end: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece] = field(default_factory=list)

    def __init__(self, pieces: list[Piece]):
        super().__init__(None)
        self.pieces = pieces


def shared_out(spans: dict[str, tuple[int, int]], split: int) -> list[Pieces]:
    """Spans (start, end) of files as tasks of about ``split`` bytes: long spans cut, short ones together."""
    out, room = [], 0
    for name, (start, end) in sorted(spans.items()):
        for at in range(start, end, split):
            piece = Piece(name, at, min(at + split, end))
            if not out or piece.end - piece.start > room:
                out.append(Pieces([]))
                room = split
            out[-1].pieces.append(piece)
            room -= piece.end - piece.start
    return out


def lines(system: fs.FileSystem, path: str, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(place, line) of a piece, read in steps; one line at a time is whole in memory."""
    with system.open_input_file(f"{path}/{piece.name}") as source:
        at = piece.start
        if at > 0:  # the line that covers the byte before belongs to the piece before
            source.seek(at - 1)
            at -= 1
            while part := source.read(STEP):
                end = part.find(b"\n")
                at += len(part) if end < 0 else end + 1
                if end >= 0:
                    break
        source.seek(at)
        rest: list[bytes] = []
        while at < piece.end and (part := source.read(STEP)):
            *whole, last = part.split(b"\n")
            for line in whole:
                line = b"".join([*rest, line])
                rest = []
                if at >= piece.end:
                    return
                yield at, line
                at += len(line) + 1
            rest.append(last)
        if rest and at < piece.end and any(rest):
            yield at, b"".join(rest)


def whole_lines(path: str, name: str, start: int, size: int) -> int:
    """The place behind the last line end of a file between ``start`` and ``size``; ``start`` where there is none."""
    system, at = opened(path)
    with system.open_input_file(f"{at}/{name}") as source:
        end = size
        while end > start:
            begin = max(start, end - STEP)
            source.seek(begin)
            found = source.read(end - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return start


def parsed(line: bytes, keep_broken: bool) -> tuple[str | None, str, str | None] | None:
    """(type, event, problem) of a line, or None where it is no event."""
    if not line.startswith(MARK):
        return None
    text = line[len(MARK):].decode("utf-8", "replace").rstrip("\r")
    try:
        found = json.loads(text)
        if not isinstance(found, dict):
            raise ValueError("no object")
    except (ValueError, RecursionError) as error:
        return ("broken", text, str(error)) if keep_broken else None
    kind = found.get("type")
    return (kind if isinstance(kind, str) or kind is None else json.dumps(kind), text, None)


class _Reading:
    """What reading a table and a stream share: options and the rows of a task."""

    def __init__(self, options: CaseInsensitiveDict):
        self.path = options["path"].rstrip("/")
        self.split = int(options.get("splitBytes", SPLIT))
        self.broken = options.get("broken", "drop")
        self.on_error = options.get("onError", "fail")
        named = json.loads(options.get("types", "null"))
        self.types: set[str] | None = None if named is None else set(named)
        self.files: list[str] | None = json.loads(options.get("files", "null"))
        if self.split < 1 or self.broken not in ("drop", "keep") or self.on_error not in ("fail", "rows"):
            raise ValueError(f"splitBytes {self.split}, broken {self.broken}, onError {self.on_error}: not an option of {NAME}")

    def chosen(self, name: str) -> bool:
        return self.files is None or any(name.startswith(f[:-1]) if f.endswith("*") else name == f for f in self.files)

    def sizes(self) -> dict[str, int]:
        return {n: size for n, size in sizes(self.path).items() if self.chosen(n)}

    def rows(self, piece: Piece) -> Iterator[tuple]:
        system, path = opened(self.path)
        try:
            for at, line in lines(system, path, piece):
                found = parsed(line, self.broken == "keep")
                if found is not None and (self.types is None or found[0] in self.types):
                    yield (piece.name, at, *found)
        except OSError as error:
            if self.on_error == "fail":
                raise
            if self.types is None or "unreadable" in self.types:
                yield piece.name, piece.start, "unreadable", None, type(error).__name__

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        batch: list[tuple] = []
        for piece in partition.pieces:
            for row in self.rows(piece):
                batch.append(row)
                if len(batch) == ROWS:
                    yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, r)) for r in batch], ARROW)
                    batch = []
        if batch:
            yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, r)) for r in batch], ARROW)


class TableReader(_Reading, DataSourceReader):
    """All files as they are when the query is planned."""

    def partitions(self) -> list[Pieces]:
        return shared_out({n: (0, size) for n, size in self.sizes().items()}, self.split) or [Pieces([])]


class PushedReader(TableReader):
    """A reader that takes Spark's conditions on files and types."""

    def __init__(self, options: CaseInsensitiveDict):
        super().__init__(options)
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("file",):
                self.pushed.append(f)
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("type",):
                types = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.types = types if self.types is None else self.types & types
            else:
                yield f

    def chosen(self, name: str) -> bool:
        def holds(f: Filter) -> bool:
            if isinstance(f, StringStartsWith):
                return name.startswith(f.value)
            return name in f.value if isinstance(f, In) else name == f.value

        return super().chosen(name) and all(holds(f) for f in self.pushed)


class StreamReader(_Reading, DataSourceStreamReader):
    """What is appended: an offset is {file: place behind its last whole line}."""

    def __init__(self, options: CaseInsensitiveDict):
        super().__init__(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        for name, size in self.sizes().items():
            if size > self.known.get(name, 0):
                self.known[name] = whole_lines(self.path, name, self.known.get(name, 0), size)
        return {n: at for n, at in sorted(self.known.items()) if at}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return shared_out({n: (start.get(n, 0), at) for n, at in end.items() if at > start.get(n, 0)}, self.split)

    def commit(self, end: dict) -> None:
        """Offsets are places in files that stay, so nothing is given up."""


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushedReader if self.options.get("pushDown") == "true" else TableReader)(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(EventLog)


def read(spark: SparkSession, path: str, types: list[str] | None = None, files: list[str] | None = None, **options: str | int) -> DataFrame:
    """A log as a table, of some types and files where they are named."""
    register(spark)
    chosen = {n: json.dumps(v) for n, v in (("types", types), ("files", files)) if v is not None}
    return spark.read.format(NAME).options(**chosen, **options).load(path)


def until_done(events: DataFrame, stream: str = "file", order: str = "at") -> DataFrame:
    """Events without those after the first ``done`` of their stream, by partial sums of one row a stream."""
    ends = events.where("type = 'done'").groupBy(stream).agg(F.min(order).alias("_end"))
    return events.join(ends, stream, "left").where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_end")


def write(events: DataFrame, path: str, value: str = "event") -> None:
    """Appends event lines to a folder, a new file of it for each task."""
    events.select(F.regexp_replace(value, r"\n+$", "").alias("value")).write.mode("append").text(path)
