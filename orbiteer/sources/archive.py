"""Files of text, zipped or not, as a data source that streams lines: ``spark.read.format("text_members")``.

A zip file's first text member is unpacked as it is read, so a file of any size takes the memory of one batch of lines.  Text
that isn't zipped is read in ranges of bytes, side by side."""

from __future__ import annotations

import codecs
import fnmatch
import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of files that one task reads, and of a range of text that isn't zipped: at most SPLIT; fewer, but at least LEAST, where
#: that leaves no task without any.
SPLIT, LEAST = 64 << 20, 2 << 20
#: Text to a byte of a zip, roughly, by which a zip's share of a task counts.
UNPACKED = 5
#: Lines of a batch, and bytes that are split into lines at once.
LINES, BLOCK = 20_000, 1 << 20

SCHEMA = "path string, member string, offset long, line_no long, line string, error string"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if uri.startswith("file:") else uri)


def _is_zip(file) -> bool:
    """By its first bytes: an entry, or the end of an archive without any."""
    start = file.read(4)
    file.seek(0)
    return start in (b"PK\x03\x04", b"PK\x05\x06")


def listed(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of all files in a folder, or of those that a pattern in the last part of a path fits."""
    system, place = opened(uri)
    parent, _, last = place.rpartition("/")
    if re.search(r"[*?\[]", last):
        found = [i for i in system.get_file_info(fs.FileSelector(parent or "/")) if fnmatch.fnmatchcase(i.base_name, last)]
    else:
        found = [system.get_file_info(place)]
        if found[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(f"{uri} doesn't exist")
    files = []
    for info in found:
        inside = system.get_file_info(fs.FileSelector(info.path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        files += [i for i in inside if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
    prefix = uri[: len(uri) - len(place)] if uri.endswith(place) else ""
    return sorted((prefix + i.path, i.size) for i in files)


@dataclass
class Pieces(InputPartition):
    """Ranges of bytes (path, first, end) that one task reads; a zip file is one range."""

    ranges: list[tuple[str, int, int]]

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class Lines(DataSourceReader):
    def __init__(self, paths: list[str], split: int, tasks: int = 1):
        self.paths, self.split, self.tasks = paths, split, tasks

    def partitions(self) -> list[Pieces]:
        """Files of up to ``split`` bytes go together; a longer one is a partition by itself, or several if it isn't a zip.  If
        that makes fewer than ``tasks``, ranges are shorter."""
        files = [f for uri in self.paths for f in listed(uri)]
        split = min(self.split, max(LEAST, sum(size for _, size in files) // max(1, self.tasks)))
        ranges = []
        for path, size in files:
            system, place = opened(path)
            step = split
            if size > step:
                with system.open_input_file(place) as file:
                    step = size if _is_zip(file) else step
            ranges += [(path, a, min(size, a + step)) for a in range(0, max(1, size), max(1, step))]
        out: list[Pieces] = []
        held = 0
        weight = lambda r: (r[2] - r[1]) * (UNPACKED if r[0].lower().endswith(".zip") else 1)
        for r in sorted(ranges, key=weight, reverse=True):
            size = max(weight(r), split // 64)  # to open a file costs, too
            if not out or held + size > split:
                out.append(Pieces([]))
                held = 0
            out[-1].ranges.append(r)
            held += size
        return out or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for path, first, end in partition.ranges:
            yield from _file(path, first, end)


def _file(path: str, first: int, end: int) -> Iterator[pa.RecordBatch]:
    """Batches of the lines of a range; what can't be read is a row with an error, after the lines before."""
    member, batches = None, _Batches(path, first)
    try:
        system, place = opened(path)
        with system.open_input_file(place) as file:
            if first == 0 and _is_zip(file):
                with zipfile.ZipFile(file) as archive:
                    member = next((n for n in archive.namelist() if n.lower().endswith(".txt")), None)
                    if member is None:
                        yield batches.single(None)
                    else:
                        with archive.open(member) as raw:
                            yield from batches.all(member, _unpacked(raw))
            else:
                member = place.rsplit("/", 1)[-1]
                yield from batches.all(member, _range(file, first, end))
    except Exception as error:  # one file's failure is a row
        yield batches.single(member, f"{type(error).__name__}: {error}"[:240])


def _unpacked(raw) -> Iterator[list[str]]:
    """The lines of a member, a block at a time, and those before a failure."""
    decoder = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")("replace"), True)
    held, size = [], 0
    try:
        while data := raw.read1(8192):
            held.append(text := decoder.decode(data))
            size += len(text)
            if size >= BLOCK and "\n" in text:
                *lines, rest = "".join(held).split("\n")
                held, size = [rest], len(rest)
                yield lines
    except Exception:
        yield "".join(held).split("\n")[:-1]
        raise
    yield _ended("".join([*held, decoder.decode(b"", True)]))


def _ended(text: str) -> list[str]:
    """The lines of a text; a last one needs no line feed."""
    lines = text.split("\n")
    return lines if lines[-1] else lines[:-1]


def _range(file, first: int, end: int) -> Iterator[list[str]]:
    """The lines that begin in a range of bytes, a block at a time; one that begins before belongs to the range before."""
    file.seek(max(0, first - 1))
    buffered = io.BufferedReader(file, BLOCK)
    at = max(0, first - 1)
    if first:
        at += len(buffered.readline())
    while at < end and (data := buffered.read(min(BLOCK, end - at))):
        if not data.endswith(b"\n"):
            data += buffered.readline()
        at += len(data)
        plain = data.replace(b"\r\n", b"\n")
        yield _ended(plain.decode("utf-8", "replace")) if b"\r" not in plain else list(_mixed(data))


def _mixed(data: bytes) -> Iterator[str]:
    """Lines of which some end in, or are parted by, a carriage return alone."""
    for line in io.BytesIO(data):
        text = line.decode("utf-8", "replace")
        yield from (x.rstrip("\r\n") for x in (text.splitlines() if b"\r" in line.rstrip(b"\r\n") else (text,)))


class _Batches:
    """Record batches of a range's lines, which are counted on."""

    def __init__(self, path: str, offset: int):
        self.path, self.offset, self.next = path, offset, 0

    def all(self, member: str, blocks: Iterator[list[str]]) -> Iterator[pa.RecordBatch]:
        for lines in blocks:
            for at in range(0, len(lines), LINES):
                yield self._made(member, lines[at : at + LINES], None)

    def single(self, member: str | None, error: str | None = None) -> pa.RecordBatch:
        return self._made(member, [None], error)

    def _made(self, member: str | None, lines: list[str | None], error: str | None) -> pa.RecordBatch:
        n, first = len(lines), self.next
        self.next += n
        same = lambda value, kind: pa.repeat(pa.scalar(value, kind), n)
        columns = [same(self.path, pa.string()), same(member, pa.string()), same(self.offset, pa.int64()), pa.array(np.arange(first, self.next)), pa.array(lines, pa.string()), same(error, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class TextMembers(DataSource):
    """Option ``paths``: a JSON list, or ``path``; ``split``: bytes of files that a task reads at most; ``tasks``: how many should have
    some."""

    @classmethod
    def name(cls) -> str:
        return "text_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Lines:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return Lines(paths, int(self.options.get("split", SPLIT)), int(self.options.get("tasks", 1)))


def stream_lines(spark: SparkSession, paths: str | list[str], split: int = SPLIT) -> DataFrame:
    """(path, member, offset, line_no, line, error) of files, folders or patterns of them.

    A zip's lines are those of its first member that ends in ".txt"; without one it has a row with a null member.  A file that
    isn't a zip has its own name as its member, and its lines are counted from each ``offset`` where a range begins.  A file
    that can't be read, or not to its end, has a row with an error.  The files must be where pyarrow's file systems reach
    them (local, HDFS, S3 and the like); ``sources.text.read_lines`` takes whatever Spark reads, but holds files whole."""
    spark.dataSource.register(TextMembers)
    return spark.read.format("text_members").option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).option("split", split).option("tasks", spark.sparkContext.defaultParallelism).load()


def _packed(folder: str, member: str):
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, place = opened(folder)
        name = f"part-{context.partitionId():05d}"
        beside = f"{place}/.{name}-{context.taskAttemptId()}"
        with system.open_output_stream(beside) as out, zipfile.ZipFile(_Unseekable(out), "w", zipfile.ZIP_DEFLATED) as archive, archive.open(f"{name}{member}", "w", force_zip64=True) as text:
            for batch in batches:
                text.write("".join([f"{line or ''}\n" for line in batch.column(0).to_pylist()]).encode())
        system.move(beside, f"{place}/{name}.zip")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.zip"])], names=["path"])

    return run


class _Unseekable(io.RawIOBase):
    """A stream that zipfile writes to without going back."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        raise io.UnsupportedOperation("tell")


def write_archives(lines: DataFrame, folder: str, member: str = ".txt") -> list[str]:
    """Writes the one text column of ``lines`` as a zip for each partition, each with one member, streaming; returns their paths.
    A task that is repeated writes its file again in the same place."""
    system, place = opened(folder)
    system.create_dir(place)
    return [r["path"] for r in lines.mapInArrow(_packed(folder, member), "path string").collect()]
