"""Packed artifacts that can be read in place: color sets with succinct offsets, and run ends with rank and select.

Both are data sources. Each task writes files of rows that follow each other in id order; the commit writes ``index.json``,
one entry a file, so what a lost or repeated task has left behind is never read.
"""

from __future__ import annotations

import json
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from hueweave.functions.codec import decode, encode
from hueweave.functions.succinct import BLOCK, BitVector, Monotone, directory, packed_bits
from hueweave.sources.sequences import opened

#: Rows of a file at most: what a writing task holds is 8 bytes for each set of a file, or a 64th of its bits.
MOST_SETS, MOST_UNITIGS = 1 << 21, 1 << 30
#: Bytes that a reading task takes at once.
SLICE = 1 << 20
INDEX = "index.json"
FOOT = struct.Struct("<QQ")


@dataclass
class File:
    """Rows ``first`` to ``first + n - 1``. Of run ends also the set bits and the last one's id (-1: none)."""

    name: str
    first: int
    n: int
    ones: int = 0
    last: int = -1


@dataclass
class Written(WriterCommitMessage):
    files: list[File]


def write_run_ends(numbered: DataFrame, path: str) -> None:
    """Write the run ends of unitigs (unitig_id, run_end), a bit each. Ids must be dense from 0; a folder that has an index is an error."""
    _write(numbered.select(F.col("unitig_id").alias("id"), "run_end"), RunEnds, path)


def write_color_sets(sets: DataFrame, n_colors: int, path: str) -> None:
    """Write color sets (cid, colors), hybrid codes bit to bit. Ids must be dense from 0; a folder that has an index is an error."""
    _write(sets.select(F.col("cid").alias("id"), "colors"), PackedColorSets, path, n_colors=str(n_colors))


def _write(rows: DataFrame, source: type[DataSource], path: str, **options: str) -> None:
    spark = rows.sparkSession
    spark.dataSource.register(source)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, "id").sortWithinPartitions("id")
    placed.write.format(source.name()).options(path=path, **options).mode("append").save()


class Folder:
    """A folder of packed files, and how its rows are found."""

    def __init__(self, path: str):
        self.path = path
        self.system, self.root = opened(path)

    def name(self, file: str) -> str:
        return f"{self.root.rstrip('/')}/{file}"

    @property
    def taken(self) -> bool:
        return self.system.get_file_info(self.name(INDEX)).type != fs.FileType.NotFound

    def index(self) -> tuple[list[File], dict]:
        with self.system.open_input_stream(self.name(INDEX), compression=None) as f:
            got = json.loads(f.read())
        return [File(**x) for x in got["files"]], got["options"]


class Writer(DataSourceArrowWriter):
    """Writes files of at most ``most`` rows; what a file holds is up to ``put`` and ``close``."""

    most = 0

    def __init__(self, options: dict):
        self.folder, self.kept = options["path"], {k: options[k] for k in ("n_colors",) if k in options}
        if Folder(self.folder).taken:
            raise FileExistsError(f"{self.folder} has an index")

    def begin(self) -> None: ...

    def put(self, f: pa.NativeFile, column: pa.Array) -> None: ...

    def close(self, f: pa.NativeFile, file: File) -> None: ...

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, files, f = Folder(self.folder), [], None
        folder.system.create_dir(folder.root, recursive=True)
        for b in iterator:
            while b.num_rows:
                first = b.column(0)[0].as_py()
                if f is None:
                    files.append(File(f"part-{uuid.uuid4().hex}", first, 0))
                    f = folder.system.open_output_stream(folder.name(files[-1].name), compression=None)
                    self.begin()
                file = files[-1]
                own, b = b.slice(0, self.most - file.n), b.slice(self.most - file.n)
                ids = own.column(0).to_numpy()
                if own.column(0).null_count or (ids != file.first + file.n + np.arange(len(ids))).any():
                    raise ValueError(f"ids do not follow each other after {file.first + file.n - 1}")
                self.put(f, own.column(1))
                file.n += len(ids)
                if file.n == self.most:
                    self.close(f, file)
                    f.close()
                    f = None
        if f is not None:
            self.close(f, files[-1])
            f.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((x for m in messages if m for x in m.files), key=lambda x: x.first)
        ends = [0, *(x.first + x.n for x in files)]
        if [x.first for x in files] != ends[:-1]:
            raise ValueError("ids are not dense from 0")
        folder = Folder(self.folder)
        folder.system.create_dir(folder.root, recursive=True)
        with folder.system.open_output_stream(folder.name(INDEX), compression=None) as f:
            f.write(json.dumps({"files": [asdict(x) for x in files], "options": self.kept}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        folder = Folder(self.folder)
        for file in (x for m in messages if m for x in m.files):
            folder.system.delete_file(folder.name(file.name))


class RunEndWriter(Writer):
    """Bits in blocks, then their directory."""

    most = MOST_UNITIGS

    def begin(self) -> None:
        self.rest, self.entries, self.ones, self.place, self.last = np.zeros(0, bool), [np.zeros(1, np.int64)], 0, 0, -1

    def _out(self, f: pa.NativeFile, bits: np.ndarray) -> None:
        packed = packed_bits(bits)
        counts = directory(packed)
        self.entries.append(self.ones + counts[1:])
        self.ones += int(counts[-1])
        f.write(packed)

    def put(self, f: pa.NativeFile, column: pa.Array) -> None:
        bits = column.to_numpy(zero_copy_only=False).astype(bool)
        on = np.flatnonzero(bits)
        self.last = self.place + int(on[-1]) if len(on) else self.last
        self.place += len(bits)
        bits = np.concatenate([self.rest, bits])
        whole = len(bits) // BLOCK * BLOCK
        self._out(f, bits[:whole])
        self.rest = bits[whole:]

    def close(self, f: pa.NativeFile, file: File) -> None:
        self._out(f, self.rest)
        f.write(np.concatenate(self.entries).astype("<i8").tobytes())
        file.ones, file.last = self.ones, file.first + self.last if self.ones else -1


class ColorSetWriter(Writer):
    """Codes bit to bit, then where each begins, then the footer: bytes of the codes and number of sets."""

    most = MOST_SETS

    def __init__(self, options: dict):
        super().__init__(options)
        self.n_colors = int(options["n_colors"])

    def begin(self) -> None:
        self.rest, self.begins, self.at, self.bytes = np.zeros(0, np.uint8), [np.zeros(1, np.int64)], 0, 0

    def put(self, f: pa.NativeFile, column: pa.Array) -> None:
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
        for i in range(0, len(column), 256):
            coded = [encode(flat[a:b], self.n_colors) for a, b in zip(ends[i : i + 256], ends[i + 1 : i + 257])]
            self.begins.append(self.at + np.cumsum([n for _, n in coded]))
            self.at = int(self.begins[-1][-1])
            bits = np.concatenate([self.rest, *(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")[:n] for x, n in coded)])
            whole = len(bits) // 8 * 8
            f.write(np.packbits(bits[:whole], bitorder="little").tobytes())
            self.rest, self.bytes = bits[whole:], self.bytes + whole // 8

    def close(self, f: pa.NativeFile, file: File) -> None:
        f.write(np.packbits(self.rest, bitorder="little").tobytes())
        f.write(Monotone.pack(np.concatenate(self.begins)))
        f.write(FOOT.pack(self.bytes + bool(len(self.rest)), file.n))


class RunEndFiles:
    """Which unitigs a color set has, and the reverse, from single bits. ``read`` counts bytes."""

    def __init__(self, path: str):
        self.folder = Folder(path)
        self.files, _ = self.folder.index()
        self.ahead = np.concatenate([[0], np.cumsum([x.ones for x in self.files], dtype=np.int64)]).tolist()
        self.read = 0

    def _bits(self, i: int) -> BitVector:
        f = self.folder.system.open_input_file(self.folder.name(self.files[i].name))

        def read(at: int, n: int) -> bytes:
            self.read += n
            return f.read_at(n, at)

        return BitVector(read, self.files[i].n)

    def _end(self, cid: int) -> int:
        i = bisect_right(self.ahead, cid) - 1
        if cid < 0 or i >= len(self.files):
            raise IndexError(cid)
        return self.files[i].first + self._bits(i).select(cid - self.ahead[i])

    def unitigs(self, cid: int) -> range:
        """The ids of a color set's unitigs."""
        return range(self._end(cid - 1) + 1 if cid else 0, self._end(cid) + 1)

    def cid(self, unitig: int) -> int:
        """The color set of a unitig."""
        i = bisect_right([x.first for x in self.files], unitig) - 1
        if i < 0 or unitig >= self.files[i].first + self.files[i].n:
            raise IndexError(unitig)
        return self.ahead[i] + self._bits(i).rank(unitig - self.files[i].first)


class ColorSetFiles:
    """Single color sets. ``read`` counts bytes."""

    def __init__(self, path: str):
        self.folder = Folder(path)
        self.files, options = self.folder.index()
        self.n_colors, self.read = int(options["n_colors"]), 0

    def open(self, i: int) -> tuple[pa.NativeFile, Monotone]:
        f = self.folder.system.open_input_file(self.folder.name(self.files[i].name))

        def read(at: int, n: int) -> bytes:
            self.read += n
            return f.read_at(n, at)

        codes, _ = FOOT.unpack(read(f.size() - FOOT.size, FOOT.size))
        return f, Monotone(read, codes)

    def colors(self, cid: int) -> np.ndarray:
        i = bisect_right([x.first for x in self.files], cid) - 1
        if i < 0 or cid >= self.files[i].first + self.files[i].n:
            raise IndexError(cid)
        f, begins = self.open(i)
        begin, end = begins[cid - self.files[i].first], begins[cid - self.files[i].first + 1]
        n = (end + 7) // 8 - begin // 8
        self.read += n
        return decode(shifted(f.read_at(n, begin // 8), begin % 8, begin % 8 + end - begin), self.n_colors)

    def slices(self, i: int) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first id, sets) of a file, some megabytes of codes at a time."""
        f, begins = self.open(i)
        begins = begins.all()
        at = 0
        while at < len(begins) - 1:
            to = max(at + 1, min(int(np.searchsorted(begins, begins[at] + 8 * SLICE)), at + 4096, len(begins) - 1))
            byte = int(begins[at]) // 8
            data = f.read_at((int(begins[to]) + 7) // 8 - byte, byte)
            yield self.files[i].first + at, [decode(shifted(data, int(a) - 8 * byte, int(b) - 8 * byte), self.n_colors) for a, b in zip(begins[at:to], begins[at + 1 : to + 1])]
            at = to


def shifted(data: bytes, begin: int, end: int) -> bytes:
    """Bits ``begin`` to ``end`` of data, from the lowest bit of the first byte on."""
    part = int.from_bytes(data[begin // 8 : (end + 7) // 8], "little") >> begin % 8
    return part.to_bytes((end - begin) // 8 + 2, "little")


@dataclass
class Part(InputPartition):
    i: int
    cids: list[int] | None = None


class RunEnds(DataSource):
    """``run_ends``: (cid, unitig_start, num_unitigs) of each color set; written from (id, run_end)."""

    @classmethod
    def name(cls) -> str:
        return "run_ends"

    def schema(self) -> str:
        return "cid long, unitig_start long, num_unitigs long"

    def reader(self, schema) -> DataSourceReader:
        return RunEndReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> RunEndWriter:
        return RunEndWriter(self.options)


class PackedColorSets(DataSource):
    """``packed_color_sets``: (cid, colors), all, or those of the option ``cids``, a JSON list; written from (id, colors) with the option ``n_colors``."""

    @classmethod
    def name(cls) -> str:
        return "packed_color_sets"

    def schema(self) -> str:
        return "cid long, colors array<int>"

    def reader(self, schema) -> DataSourceReader:
        return ColorSetReader(self.options["path"], json.loads(self.options.get("cids", "null")))

    def writer(self, schema, overwrite: bool) -> ColorSetWriter:
        return ColorSetWriter(self.options)


class RunEndReader(DataSourceReader):
    """A task a file: places of its set bits, which need nothing of other files but the index."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(i) for i in range(len(Folder(self.path).index()[0]))]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        folder = Folder(self.path)
        files, _ = folder.index()
        if partition is None or not files:  # an empty folder has one task without a part
            return
        file, before = files[partition.i], files[: partition.i]
        cid, end = sum(x.ones for x in before), max((x.last for x in before), default=-1)
        with folder.system.open_input_file(folder.name(file.name)) as f:
            size = -(-file.n // BLOCK) * BLOCK // 8
            for at in range(0, size, SLICE):
                bits = np.unpackbits(np.frombuffer(f.read_at(min(SLICE, size - at), at), np.uint8), bitorder="little")
                ends = file.first + 8 * at + np.flatnonzero(bits)
                starts = np.concatenate([[end], ends[:-1]])[: len(ends)] + 1
                yield pa.RecordBatch.from_arrays([pa.array(cid + np.arange(len(ends))), pa.array(starts), pa.array(ends - starts + 1)], ["cid", "unitig_start", "num_unitigs"])
                cid, end = cid + len(ends), int(ends[-1]) if len(ends) else end


class ColorSetReader(DataSourceReader):
    """A task a file; of chosen ids, a task for each file that has some, which reads their bits alone."""

    def __init__(self, path: str, cids: list[int] | None):
        self.path, self.cids = path, cids

    def partitions(self) -> list[Part]:
        files, _ = Folder(self.path).index()
        if self.cids is None:
            return [Part(i) for i in range(len(files))]
        own = [sorted({c for c in self.cids if x.first <= c < x.first + x.n}) for x in files]
        return [Part(i, cids) for i, cids in enumerate(own) if cids]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files = ColorSetFiles(self.path)
        if partition.cids is not None:
            yield _sets(partition.cids, [files.colors(c) for c in partition.cids])
            return
        for first, sets in files.slices(partition.i):
            yield _sets(range(first, first + len(sets)), sets)


def _sets(cids: list[int] | range, sets: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate([np.zeros(0, np.int64), *sets]).astype(np.int32)
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["cid", "colors"])
