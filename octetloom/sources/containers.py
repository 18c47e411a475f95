"""Container files as Python data sources: ``yaz0``, ``tree``, ``archive``, ``records`` and ``raw``; ``yaz0`` and ``raw`` write files too.

    register(spark)
    spark.read.format("yaz0").load("/data/*.szs")
    spark.read.format("records").option("fields", "a:u32,b:u16").load("/data/table.bin")

Paths are local, or URIs of any store that ``pyarrow.fs`` knows and all
executors reach (``file:``, ``hdfs:``, ``s3:``, ``gs:``); their last part may be
a pattern, and a folder stands for its files. A compressed file or container is
one split; tables of records are split by ranges, which are all that is read.
For any other store read ``binaryFile`` and use the operators on its content.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from octetloom.codec import archive, lz, tree
from octetloom.errors import DecodeError
from octetloom.functions.primitives import TYPES


#: Files that a commit moves at a time.
COMMITTERS = 16


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    paths: list[tuple[str, str]]


def _store(spec: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    if ":/" in spec:
        return pafs.FileSystem.from_uri(spec)
    return pafs.LocalFileSystem(), os.path.abspath(spec)


def _paths(options) -> list[str]:
    return [p for p, _ in _sized_paths(options)]


def _sized_paths(options) -> list[tuple[str, int]]:
    """The files that the option ``path`` names, as they are named there (a URI stays one), with their sizes: one listing for all."""
    spec = options.get("path", "")
    if not spec:
        return []
    store, path = _store(spec)
    head = spec[: len(spec) - len(path)] if spec.endswith(path) else spec.partition(":")[0] + "://" if ":/" in spec else ""
    folder, _, pattern = path.rpartition("/")
    info = store.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [(head + path, info.size)]
    if info.type == pafs.FileType.Directory:
        folder, pattern = path, "*"
    found = store.get_file_info(pafs.FileSelector(folder or "/", allow_not_found=True))
    return sorted((head + f.path, f.size) for f in found if f.type == pafs.FileType.File and fnmatch(f.base_name, pattern) and not f.base_name.startswith((".", "_")))


class _FileReader(DataSourceReader):
    """Rows of each file; a fault gives a row with its code, or fails the query in ``strict`` mode."""

    def __init__(self, options) -> None:
        self.options, self.files = options, _paths(options)
        self.strict = options.get("mode", "lenient") == "strict"

    def partitions(self) -> list[File]:
        return [File(p) for p in self.files] or [File("")]

    def rows(self, path: str, raw: bytes) -> Iterator[tuple]:
        raise NotImplementedError

    def faulty(self, path: str, code: str) -> tuple:
        raise NotImplementedError

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.path:
            return
        store, path = _store(partition.path)
        with store.open_input_file(path) as f:
            raw = f.read()
        try:
            yield from self.rows(partition.path, raw)
        except DecodeError as e:
            if self.strict:
                raise
            yield self.faulty(partition.path, e.code)


class _Yaz0Reader(_FileReader):
    def rows(self, path, raw):
        d = lz.decode(raw, self.options.get("endian", "BE"), int(self.options.get("limit", str(lz.OUTPUT_LIMIT))))
        yield path, d.header.decompressed_size, d.header.alignment, d.data, d.overshoot, None

    def faulty(self, path, code):
        return path, None, None, None, None, code


class Yaz0Source(DataSource):
    """One row per file: its header and decoded bytes."""

    @classmethod
    def name(cls) -> str:
        return "yaz0"

    def schema(self) -> str:
        return "path string, decompressed_size bigint, alignment bigint, data binary, overshoot int, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Yaz0Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options, overwrite, lambda data: lz.encode(data, int(self.options.get("alignment", "0")), self.options.get("endian", "BE")))


class _TreeReader(_FileReader):
    def rows(self, path, raw):
        if self.options.get("compressed", "false") == "true":
            raw = lz.decode(raw).data
        for idx, offset, s, ended in tree.table_strings(raw, self.options.get("table", "key")):
            yield path, idx, offset, s, s.decode(self.options.get("charset", "ISO-8859-1"), "replace"), not ended, None

    def faulty(self, path, code):
        return path, None, None, None, None, None, code


class TreeSource(DataSource):
    """One row per string of a table of each file."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, idx int, offset bigint, raw binary, value string, unterminated boolean, error string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _ArchiveReader(_FileReader):
    def rows(self, path, raw):
        for i, (e, name, data) in enumerate(archive.members(raw)):
            yield path, i, e.filename_hash, e.sequence, None if name is None else name.decode("ISO-8859-1"), data, None

    def faulty(self, path, code):
        return path, None, None, None, None, None, code


class ArchiveSource(DataSource):
    """One row per member of each archive."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "path string, idx int, filename_hash bigint, sequence int, name string, data binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)


def _fields(options) -> list[tuple[str, str]]:
    return [tuple(f.strip().split(":")) for f in options["fields"].split(",")]


class _RecordReader(DataSourceReader):
    """Fixed-width records, in splits of ``split_records``; options ``first`` and ``count`` pick records by number, and only their bytes are read.

    Filters are not pushed into the reader: Spark keeps a Python reader with the
    filters of one query for the next query over the same DataFrame, which may
    have none.
    """

    def __init__(self, options) -> None:
        self.options, self.files, self.fields = options, _sized_paths(options), _fields(options)
        self.width = sum(TYPES[k][0] for _, k in self.fields)
        self.low = int(options.get("first", "0"))
        self.high = self.low + int(options["count"]) if "count" in options else None

    def partitions(self):
        step, out = int(self.options.get("split_records", "1000000")), []
        for p, size in self.files:
            n = size // self.width
            high = n if self.high is None else min(n, self.high)
            out += [(p, a, min(a + step, high)) for a in range(self.low, high, step)]
        # Small files share a split.
        splits, held = [[]], 0
        for r in out:
            if held and held + r[2] - r[1] > step:
                splits.append([])
                held = 0
            splits[-1].append(r)
            held += r[2] - r[1]
        return [_Ranges(x) for x in splits]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        names, firsts, counts, raws, held = [], [], [], [], 0
        for name, first, last in partition.ranges:
            for a in range(first, last, BATCH_RECORDS):
                store, path = _store(name)
                with store.open_input_file(path) as f:
                    raw = f.read_at((min(a + BATCH_RECORDS, last) - a) * self.width, a * self.width)
                n = len(raw) // self.width
                names.append(name)
                firsts.append(a)
                counts.append(n)
                raws.append(raw[: n * self.width])
                held += n
                if held >= BATCH_RECORDS:
                    yield self.batch(names, firsts, counts, raws)
                    names, firsts, counts, raws, held = [], [], [], [], 0
        if held:
            yield self.batch(names, firsts, counts, raws)

    def batch(self, names: list[str], firsts: list[int], counts: list[int], raws: list[bytes]) -> pa.RecordBatch:
        """The records of some stretches: by file, first number, number of records and bytes."""
        table = np.frombuffer(b"".join(raws), np.uint8).reshape(-1, self.width)
        file = np.repeat(np.arange(len(names)), counts)
        idx = np.arange(len(table)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(firsts, counts)
        cols, at, endian = [pa.array(names, pa.string()).take(pa.array(file)), pa.array(idx, pa.int64())], 0, self.options.get("endian", "BE")
        for _, kind in self.fields:
            size = TYPES[kind][0]
            cols.append(_column(table[:, at : at + size], kind, endian))
            at += size
        return pa.RecordBatch.from_arrays(cols, ["path", "idx", *(n for n, _ in self.fields)])


#: Records decoded at a time.
BATCH_RECORDS = 20_000
_NUMPY = {"u8": "u1", "i8": "i1", "u16": "u2", "i16": "i2", "u32": "u4", "i32": "i4", "u64": "u8", "i64": "i8", "f32": "f4", "f64": "f8"}
_ARROW = {"smallint": pa.int16(), "tinyint": pa.int8(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}


def _column(raw: np.ndarray, kind: str, endian: str) -> pa.Array:
    """The primitives whose bytes are the rows of ``raw``."""
    n, size = raw.shape
    if kind == "bool":
        return pa.array(raw[:, 0] != 0)
    if kind in ("u128", "i128"):
        ordered = np.ascontiguousarray(raw if endian == "BE" else raw[:, ::-1])
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), n, [None, pa.py_buffer(ordered)]).cast(pa.binary())
    if kind == "u24":
        a, b, c = (raw[:, i].astype(np.int32) for i in ((0, 1, 2) if endian == "BE" else (2, 1, 0)))
        return pa.array(a << 16 | b << 8 | c)
    values = np.ascontiguousarray(raw).view((">" if endian == "BE" else "<") + _NUMPY[kind])[:, 0]
    if kind == "u64":
        words = np.zeros((n, 2), "<u8")
        words[:, 0] = values
        return pa.Array.from_buffers(pa.decimal128(20, 0), n, [None, pa.py_buffer(words)])
    return pa.array(values.astype(_ARROW[TYPES[kind][1]].to_pandas_dtype()))


@dataclass
class _Ranges(InputPartition):
    """Stretches of files to read: (path, first record, last)."""

    ranges: list[tuple[str, int, int]]


class RecordSource(DataSource):
    """One row per record, by the option ``fields`` (``name:primitive`` with commas)."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "path string, idx bigint, " + ", ".join(f"`{n}` {TYPES[k][1]}" for n, k in _fields(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(self.options)


class _FileWriter(DataSourceWriter):
    """Writes rows (name, data) as files: under temporary names in tasks, moved when the job commits.

    In mode ``overwrite`` the files that were there before and are not written
    again go at commit; without it a folder that holds files is an error.
    """

    def __init__(self, options, overwrite: bool, encode) -> None:
        self.folder, self.overwrite, self.encode = options["path"], overwrite, encode
        if self.there() and not overwrite:
            raise FileExistsError(self.folder)

    def there(self) -> list[str]:
        store, folder = _store(self.folder)
        return [f.path for f in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.type == pafs.FileType.File and not f.base_name.startswith(".")]

    def write(self, rows) -> Written:
        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        done = []
        for row in rows:
            name = os.path.basename(row["name"])
            own = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(self.encode(bytes(row["data"])))
            done.append((own, f"{folder}/{name}"))
        return Written(done)

    def commit(self, messages) -> None:
        store, _ = _store(self.folder)
        before = set(self.there())
        written: dict[str, list[str]] = {}
        for own, final in (pair for m in messages if m for pair in m.paths):
            written.setdefault(final, []).append(own)

        def place(final: str) -> None:
            if final in before:
                store.delete_file(final)
            for own in written[final]:
                store.move(own, final)

        # Stores answer many requests at a time.
        with ThreadPoolExecutor(COMMITTERS) as pool:
            for _ in pool.map(place, written):
                pass
            for _ in pool.map(store.delete_file, before - written.keys() if self.overwrite else ()):
                pass

    def abort(self, messages) -> None:
        store, _ = _store(self.folder)
        for m in messages:
            for own, _ in m.paths if m else ():
                if store.get_file_info(own).type == pafs.FileType.File:
                    store.delete_file(own)


class RawSource(DataSource):
    """Files as they are: one row per file, and a sink for rows (name, data)."""

    @classmethod
    def name(cls) -> str:
        return "raw"

    def schema(self) -> str:
        return "path string, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _RawReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options, overwrite, bytes)


class _RawReader(_FileReader):
    def rows(self, path, raw):
        yield path, raw


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in (Yaz0Source, TreeSource, ArchiveSource, RecordSource, RawSource):
        spark.dataSource.register(source)
