"""Log files that grow, as a stream of lines, and a sink of one folder of JSON lines for each cycle.

Spark's own file stream takes a file once, whole; logs are written to for hours.  This
source keeps for each file how far it has been read, up to the last line that is
complete, so each line is read once, also after a restart.  A file's new part is read in
ranges by several tasks.  Files are opened by Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import datetime
import fnmatch
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

SCHEMA = "value string, file_path string, file_block_start bigint, file_time timestamp, row_id bigint"
_BLOCK = 1 << 22


def open_path(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what comes before its paths as Spark writes them: ``file:`` or scheme://)."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path, "file:"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path.split("://", 1)[0] + "://"


@dataclass
class Pieces(InputPartition):
    """What one task reads."""

    pieces: list


@dataclass
class Piece:
    """Bytes of a file: the lines that begin from ``low`` to before ``high``; ``whole`` says that one begins at low."""

    path: str
    low: int
    high: int
    whole: bool
    time: float


def lines_between(f, low: int, high: int, whole: bool) -> Iterator[tuple[list[int], list[bytes]]]:
    """(first bytes, lines) of the lines that begin in the range, a block at a time; a line that goes on beyond ``high`` is read to its end."""
    at, rest = (low if whole else low - 1), b""
    f.seek(at)
    skip = not whole  # what precedes the first line's end is the previous range's
    while at < high:
        block = f.read(_BLOCK)
        data = rest + block
        if not block:
            return  # an unfinished line isn't read
        found = data.split(b"\n")
        rest = found.pop()
        starts, lines = [], []
        for line in found:
            if at >= high:
                break
            if skip:
                skip = False
            elif line not in (b"", b"\r"):
                starts.append(at)
                lines.append(line)
            at += len(line) + 1
        yield starts, lines


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["paths"])
        self.pattern = options.get("pattern", "*.jsonl")
        self.split = int(options.get("splitbytes", str(32 << 20)))
        self.known: dict[str, tuple[int, int]] = {}  # path: (size, end of the last complete line)

    def files(self) -> dict[str, tuple[int, float]]:
        """Size and time of change by path."""
        out = {}
        for root in self.roots:
            system, inner, scheme = open_path(root)
            for f in system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)):
                if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern):
                    out[scheme + f.path] = (f.size, f.mtime.timestamp() if f.mtime else 0.0)
        return out

    def _complete(self, path: str, size: int) -> int:
        """Where the last complete line ends."""
        if path in self.known and self.known[path][0] == size:
            return self.known[path][1]
        system, inner, _ = open_path(path)
        end, to = 0, size
        with system.open_input_file(inner) as f:
            while to > 0:
                low = max(0, to - (1 << 16))
                f.seek(low)
                at = f.read(to - low).rfind(b"\n")
                if at >= 0:
                    end = low + at + 1
                    break
                to = low
        self.known[path] = (size, end)
        return end

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self, *_) -> dict:
        return {"files": {p: self._complete(p, size) for p, (size, _) in sorted(self.files().items())}}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        """Ranges of ``split`` bytes, small ones together.  A file that got shorter was written anew and is read from its beginning."""
        times, out = self.files(), []
        for path, to in end["files"].items():
            low = start["files"].get(path, 0)
            low = 0 if low > to else low
            cuts = [*range(low, to, self.split), to]
            out += [Piece(path, a, b, a == low, times.get(path, (0, 0.0))[1]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        tasks, size = [Pieces([])], 0
        for p in out:
            if size and size + p.high - p.low > self.split:
                tasks.append(Pieces([]))
                size = 0
            tasks[-1].pieces.append(p)
            size += p.high - p.low
        return tasks

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            yield from self._lines(piece)

    def _lines(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        system, inner, _ = open_path(piece.path)
        when = datetime.datetime.fromtimestamp(piece.time, datetime.timezone.utc)
        with system.open_input_file(inner) as f:
            for starts, found in lines_between(f, piece.low, piece.high, piece.whole):
                n = len(starts)
                values = pa.array([b.removesuffix(b"\r").decode("utf-8", "replace") for b in found], pa.string())
                yield pa.RecordBatch.from_arrays([values, pa.array([piece.path] * n, pa.string()), pa.array([0] * n, pa.int64()), pa.array([when] * n, pa.timestamp("us", "UTC")), pa.array(starts, pa.int64())], ["value", "file_path", "file_block_start", "file_time", "row_id"])

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class TailSource(DataSource):
    """Options: paths (a JSON list), pattern, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "tokentally_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class CycleWriter(DataSourceStreamWriter):
    """Each task writes its rows aside; commit moves them to ``batch=<number>``, once: a batch that runs again after its commit changes nothing."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, rows) -> WriterCommitMessage:
        system, inner, _ = open_path(self.path)
        name, out = f"{inner}/_pending/{uuid.uuid4().hex}.json", None
        try:
            for row in rows:
                if out is None:
                    system.create_dir(f"{inner}/_pending", recursive=True)
                    out = system.open_output_stream(name)
                out.write((json.dumps(row.asDict(True), default=str, ensure_ascii=False) + "\n").encode())
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        system, inner, _ = open_path(self.path)
        target = f"{inner}/batch={batchId}"
        if system.get_file_info(f"{target}/_done").type == fs.FileType.File:
            return self.abort(messages, batchId)
        system.create_dir(target, recursive=True)
        system.delete_dir_contents(target)  # what a commit that broke off has left
        for k, m in enumerate(m for m in messages if m is not None and m.file):
            system.move(m.file, f"{target}/part-{k}.json")
        with system.open_output_stream(f"{target}/_done"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        system, _, _ = open_path(self.path)
        for m in messages:
            if m is not None and m.file and system.get_file_info(m.file).type == fs.FileType.File:
                system.delete_file(m.file)


class CycleSink(DataSource):
    """Option: path, a folder."""

    @classmethod
    def name(cls) -> str:
        return "tokentally_cycles"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return CycleWriter(self.options)


def register(spark: SparkSession) -> None:
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    spark.dataSource.register(TailSource)
    spark.dataSource.register(CycleSink)


def tail(spark: SparkSession, paths: list[str], pattern: str = "*.jsonl", split_bytes: int = 32 << 20) -> DataFrame:
    """Lines of all files below ``paths``, and whatever is added to them, with the columns of files.lines().

    row_id is the line's first byte, so (file_path, row_id) is the order of lines.  A last line
    without a newline waits for it.  The checkpoint holds an entry for each file.
    """
    register(spark)
    return spark.readStream.format("tokentally_tail").option("paths", json.dumps(paths)).option("pattern", pattern).option("splitBytes", str(split_bytes)).load()


def cycles(spark: SparkSession, folder: str) -> DataFrame:
    """What the sink has committed: value (a JSON object), batch."""
    return spark.read.schema("value string, batch bigint").option("basePath", folder).text(f"{folder}/batch=*/part-*.json")
