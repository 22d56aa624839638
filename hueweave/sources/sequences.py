"""Sequence files: manifests, and a data source of FASTA and FASTQ files, plain or gzipped, batch and streaming."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a file that one task reads, where the file can be split; smaller files share a task.
SPLIT = 64 << 20
BLOCK = 1 << 20
GZIP = b"\x1f\x8b"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(color, path): one file a line; the color is the line's place among those that are not blank.

    A manifest is a list of names, read whole as one row so that the order is exact. An empty one is an error.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    out = whole.select(F.posexplode(lines)).select(F.col("pos").alias("color"), F.trim("col").alias("path"))
    if out.isEmpty():
        raise ValueError(f"no input files in {path}")
    return out


def read_sequences(spark: SparkSession, manifest: DataFrame, permissive: bool = False, split: int = SPLIT) -> DataFrame:
    """(color, seq) of every record of the manifest's files; names are taken as they are, hidden or with any characters.

    A missing file is an error; with ``permissive`` it is skipped and its color stays unused. A file that the manifest names
    twice has two colors. See ``SequenceFiles`` for the forms.
    """
    files = sized([(r["color"], r["path"]) for r in manifest.collect()], permissive)  # names only, one for each input file
    spark.dataSource.register(SequenceFiles)
    return spark.read.format("sequences").options(files=json.dumps(files), split=str(split)).load()


def stream_sequences(spark: SparkSession, manifest: str, permissive: bool = False) -> DataFrame:
    """A stream of (color, seq): the records of the files that a growing manifest names, each line once, in a batch with those that came with it."""
    spark.dataSource.register(SequenceFiles)
    return spark.readStream.format("sequences").options(manifest=manifest, permissive=str(permissive).lower()).load()


class SequenceFiles(DataSource):
    """``sequences``: (color, seq) of the records of files.

    Options: ``files``, a JSON list of [color, path, bytes], or ``manifest``, the path of a list of names; ``permissive`` and ``split``. Paths
    are local (shared by all executors) or URIs that Arrow's file systems open (file, hdfs, viewfs, s3, gs). A file is gzipped if
    its first bytes say so, whatever its name. Records begin with ``>`` or ``@`` at the begin of a line; the sequence is the
    lines up to the next record or a line that begins with ``+``, whose qualities are as many characters as the sequence. Only
    line ends are dropped. Plain and block-gzipped FASTA is split by byte ranges; other gzip and FASTQ files are one task's each,
    read as streams.
    """

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return "color int, seq string"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options)


@dataclass
class Task(InputPartition):
    #: (color, path, start, end); a file read whole has end -1
    parts: list[tuple[int, str, int, int]]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the name there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def manifest_lines(path: str) -> list[str]:
    system, name = opened(path)
    with system.open_input_stream(name, compression=None) as f:
        return [x.strip() for x in f.read().decode().splitlines() if x.strip()]


def sized(files: list[tuple[int, str]], permissive: bool) -> list[tuple[int, str, int]]:
    """(color, path, bytes) of the files that are there; a missing one is an error unless ``permissive``."""
    out, by = [], {}
    for _, path in files:
        system, name = opened(path)
        by.setdefault((path.split("://")[0] if "://" in path else "", system.type_name), (system, []))[1].append((path, name))
    known = {p: i.size for system, names in by.values() for (p, _), i in zip(names, system.get_file_info([n for _, n in names]), strict=True) if i.is_file}
    missing = [p for _, p in files if p not in known]
    if missing and not permissive:
        raise FileNotFoundError(min(missing))
    return [(color, path, known[path]) for color, path in files if path in known]


def plan(files: list[tuple[int, str, int]], split: int) -> list[Task]:
    """Tasks of about ``split`` bytes. Only files larger than that are looked into."""
    tasks: list[Task] = []
    held, total = [], 0
    for color, path, size in files:
        if size > split and splits(*opened(path)):
            tasks += [Task([(color, path, at, min(at + split, size))]) for at in range(0, size, split)]
            continue
        held.append((color, path, 0, -1))
        total += size
        if total >= split:
            tasks.append(Task(held))
            held, total = [], 0
    return [*tasks, Task(held)] if held else tasks


def splits(system: fs.FileSystem, name: str) -> bool:
    """Whether a file is plain or block-gzipped and begins with ``>``."""
    with system.open_input_file(name) as f:
        head = f.read_at(1 << 16, 0)
    if head.startswith(GZIP):
        if not block_size(head):
            return False
        head = zlib.decompressobj(31).decompress(head)
    return head.lstrip().startswith(b">")


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.permissive, self.split = options.get("permissive", "false") == "true", int(options.get("split", SPLIT))
        self.files = json.loads(options["files"]) if "files" in options else sized(list(enumerate(manifest_lines(options["manifest"]))), self.permissive)

    def partitions(self) -> list[Task]:
        return plan(self.files, self.split)

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return batches(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets count the manifest's lines."""

    def __init__(self, options: dict):
        self.manifest, self.permissive, self.split = options["manifest"], options.get("permissive", "false") == "true", int(options.get("split", SPLIT))

    def initialOffset(self) -> dict:
        return {"lines": 0}

    def latestOffset(self) -> dict:
        return {"lines": len(manifest_lines(self.manifest))}

    def partitions(self, start: dict, end: dict) -> list[Task]:
        return plan(sized(list(enumerate(manifest_lines(self.manifest)))[start["lines"] : end["lines"]], self.permissive), self.split)

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return batches(partition)


def batches(task: Task) -> Iterator[pa.RecordBatch]:
    colors, seqs, size = [], [], 0
    for color, path, start, end in task.parts:
        system, name = opened(path)
        with system.open_input_file(name) as f:
            for seq in records(lines(f, start), start, end):
                colors.append(color)
                seqs.append(seq)
                size += len(seq)
                if size > 1 << 22:
                    yield _batch(colors, seqs)
                    colors, seqs, size = [], [], 0
    if seqs:
        yield _batch(colors, seqs)


def _batch(colors: list[int], seqs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(colors, pa.int32()), pa.array([s.decode("latin-1") for s in seqs], pa.string())], ["color", "seq"])


def block_size(head: bytes) -> int:
    """Size of a block-gzip block that begins with ``head``; 0 if none does."""
    if len(head) < 18 or not head.startswith(b"\x1f\x8b\x08\x04"):
        return 0
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        n = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return 0


def blocks(f: pa.NativeFile, start: int) -> Iterator[tuple[int, int, bytes]]:
    """(place, step, content) of a file from ``start`` on, unzipped: the byte at ``i`` counts as being at ``place + step * i``. Zipped content is where its block begins."""
    size = f.size()
    head = f.read_at(1 << 16, 0)
    if not head.startswith(GZIP):
        while start < size:
            data = f.read_at(BLOCK, start)
            yield start, 1, data
            start += len(data)
    elif start or block_size(head):
        start = next_block(f, start, size)
        while start < size:
            n = block_size(f.read_at(64, start))
            if not n:
                raise ValueError(f"no block at {start}")
            yield start, 0, zlib.decompress(f.read_at(n, start), 31)
            start += n
    else:
        unzip, at = zlib.decompressobj(31), 0
        while at < size:
            data = f.read_at(BLOCK, at)
            at += len(data)
            yield 0, 0, unzip.decompress(data)
            if unzip.eof:
                at -= len(unzip.unused_data)
                if f.read_at(2, at) != GZIP:  # what follows the last member does not count
                    return
                unzip = zlib.decompressobj(31)
        raise EOFError("a gzip member has no end")


def next_block(f: pa.NativeFile, start: int, size: int) -> int:
    """The first place from ``start`` on where a block begins that another follows, or the file's end."""
    while start < size:
        data = f.read_at(1 << 18, start)
        at = data.find(b"\x1f\x8b\x08\x04")
        while at >= 0:
            n = block_size(f.read_at(64, start + at))
            if n and (start + at + n == size or block_size(f.read_at(64, start + at + n))):
                return start + at
            at = data.find(b"\x1f\x8b\x08\x04", at + 1)
        start += max(1, len(data) - 3)
    return size


def lines(f: pa.NativeFile, start: int) -> Iterator[tuple[bytes, int]]:
    """(line, place of its end) of a file's content from ``start`` on."""
    rest: list[bytes] = []
    for place, step, data in blocks(f, start):
        *whole, last = data.split(b"\n")
        at = -1
        for x in whole:
            at += len(x) + 1
            if rest:
                x, rest = b"".join([*rest, x]), []
            yield x, place + step * at
        rest.append(last)
    if any(rest):
        yield b"".join(rest), 1 << 62


def records(found: Iterator[tuple[bytes, int]], start: int = 0, end: int = -1) -> Iterator[bytes]:
    """The sequences of records. Of a split file, those whose ``>`` follows a line end from ``start`` up to ``end``, and of the first part the one at its begin."""
    seq: list[bytes] | None = None
    quality, ended = 0, -1
    if start:
        ended = next(found, (b"", -1))[1]  # the rest of a line
    for line, place in found:
        if seq is None and 0 <= end <= ended:
            return
        if quality > 0:
            quality -= len(line.rstrip(b"\r"))
        elif line[:1] in (b">", b"@") and line:
            if seq is not None:
                yield b"".join(seq)
            if 0 <= end <= ended:
                return
            seq = [] if line[:1] == b">" or not start or seq is not None else None
        elif line[:1] == b"+" and seq is not None:
            whole = b"".join(seq)
            yield whole
            quality, seq = len(whole), None
        elif seq is not None:
            seq.append(line.rstrip(b"\r"))
        elif not start and (b">" in line or b"@" in line):
            seq = []
        ended = place
    if seq is not None:
        yield b"".join(seq)
