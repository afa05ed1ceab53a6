"""Splat files as Spark data sources: ``spark.read.format("splat_ply")`` and ``"splat_records"``, and the same to write;
``"splat_packed"``, compressed PLY files, to read only.

Rows of all have a fixed size, so a file is read in ranges of rows, by as many tasks as it has ranges; only its header
is looked at beforehand. Written are folders of files of at most ``rows`` rows each: tasks write below a folder of their
own, and a file moves to its place when all tasks are done, so lost or repeated tasks leave nothing.

Options: ``path``, a file or a folder (any file system that pyarrow opens); ``rows`` of a range or a file; to read,
``columns``: names, comma-separated, that are parsed (the others are null).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from scenemill.sources.splat_files import CHUNK_ROWS, COLUMNS, packed_layout, parse_elements, parse_header, unpacked

ROWS, BATCH, HEAD = 1 << 18, 1 << 16, 1 << 16
RECORD = np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 4), ("q", "u1", 4)])
COLORS = ["color_0", "color_1", "color_2"]
NORMALS = ["nx", "ny", "nz"]
HARMONICS = 45
PLY_SCHEMA = "path string, row_index long, " + ", ".join(f"{c} float" for c in [*COLUMNS, *COLORS, *NORMALS]) + ", sh_rest array<float>"
RECORD_SCHEMA = "path string, row_index long, " + ", ".join(f"{c} float" for c in [*COLUMNS[:3], *COLUMNS[6:], *COLORS])
_FLOATS = pa.list_(pa.float32())


def _open(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


def _list(path: str, suffix: str) -> list[tuple[str, int]]:
    """(file, bytes) by name; of a folder those with the suffix whose names begin with no dot or underscore."""
    store, root = _open(path)
    info = store.get_file_info(root)
    if info.type == files.FileType.File:
        return [(info.path, info.size)]
    if info.type == files.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(files.FileSelector(root))
    return sorted((f.path, f.size) for f in found if f.type == files.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._")


def ply_columns(path: str, row: np.dtype) -> dict[str, list[str]]:
    """Which properties make which column; what a splat needs and the file doesn't have is an error."""
    kinds = {n: row.fields[n][0].str[1:] for n in row.names}
    floats = lambda names: all(kinds.get(n) == "f4" for n in names)
    missing = [c for c in COLUMNS if not c.startswith("f_dc") and kinds.get(c) != "f4"]
    if missing:
        raise ValueError(f"{path} has no float {', '.join(missing)}")
    out = {c: [c] for c in COLUMNS if not c.startswith("f_dc")}
    normals = [n for n in (*NORMALS, "nxx") if n in kinds]
    if normals:
        if len(normals) != 3 or not floats(normals):
            raise ValueError(f"{path} has some normals only")
        out |= {c: [n] for c, n in zip(NORMALS, ["nxx" if "nxx" in kinds else "nx", "ny", "nz"], strict=True)}
    rest = sorted((n for n in kinds if n.startswith("f_rest_")), key=lambda n: int(n[7:]))
    harmonics, plain = [f"f_dc_{i}" for i in range(3)], ["red", "green", "blue"]
    if floats(harmonics):
        if rest and (rest != [f"f_rest_{i}" for i in range(HARMONICS)] or not floats(rest)):
            raise ValueError(f"{path} has not all {HARMONICS} harmonics")
        return out | {c: [c] for c in harmonics} | ({"sh_rest": rest} if rest else {})
    if floats(plain) or all(kinds.get(n) == "u1" for n in plain):
        return out | {c: [n] for c, n in zip(COLORS, plain, strict=True)}
    raise ValueError(f"{path} has no colours")


@dataclass
class Range(InputPartition):
    path: str
    first: int
    rows: int
    body: int
    count: int


class _Reader(DataSourceReader):
    """Plans ranges of rows; a range is read in batches."""

    suffix = ""
    exact = True  # whether a file ends with its rows

    def __init__(self, schema, options: dict):
        self.names, self.options = [f.name for f in schema.fields], dict(options)
        asked = options.get("columns")
        self.asked = {c.strip() for c in asked.split(",")} if asked else set(self.names)
        unknown = self.asked - set(self.names)
        if unknown:
            raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")

    def layout(self, path: str, head: bytes, size: int) -> tuple[int, int, int]:
        """(rows, bytes before them, bytes of a row; 0 for lines)"""
        raise NotImplementedError

    def values(self, path: str, raw: bytes, part: Range) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        most, out = int(self.options.get("rows", ROWS)), []
        for path, size in _list(self.options["path"], self.suffix):
            store, _ = _open(self.options["path"])
            with store.open_input_file(path) as f:
                head = f.read(min(size, HEAD))
            count, body, width = self.layout(path, head, size)
            if width and (size < body + count * width or self.exact and size > body + count * width):
                raise ValueError(f"{path} doesn't hold {count} whole rows")
            step = most if width else max(1, count)
            out += [Range(path, i, min(step, count - i), body, count) for i in range(0, count, step)]
        return out or [Range("", 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        store, _ = _open(self.options["path"])
        with store.open_input_file(part.path) as f:
            for first, made in self.values(part.path, f, part):
                n = len(next(iter(made.values())))
                columns = []
                for c in self.names:
                    if c == "path":
                        columns.append(pa.array([part.path] * n, pa.string()))
                    elif c == "row_index":
                        columns.append(pa.array(np.arange(first, first + n), pa.int64()))
                    elif c == "sh_rest":
                        own = made.get(c) if c in self.asked else None
                        flat = None if own is None else pa.array(own.reshape(-1).astype(np.float32))
                        columns.append(pa.nulls(n, _FLOATS) if own is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * own.shape[1], pa.int32()), flat))
                    elif c in made and c in self.asked:
                        columns.append(pa.array(made[c].astype(np.float32), pa.float32()))
                    else:
                        columns.append(pa.nulls(n, pa.float32()))
                yield pa.RecordBatch.from_arrays(columns, self.names)


class _PlyReader(_Reader):
    suffix = ".ply"

    def layout(self, path, head, size):
        if b"end_header" not in head:
            raise ValueError(f"{path} has no header within {HEAD} bytes")
        kind, count, row, body = parse_header(head)
        ply_columns(path, row)
        return count, body, 0 if kind == "ascii" else row.itemsize

    def values(self, path, f, part):
        kind, count, row, body = parse_header(f.read(part.body))
        named = ply_columns(path, row)
        wanted = {c: names for c, names in named.items() if c in self.asked} or {"x": ["x"]}
        shaped = lambda rows: {c: rows[names[0]] if c != "sh_rest" else np.stack([rows[n] for n in names], 1) for c, names in wanted.items()}
        if kind == "ascii":
            lines = pa.BufferReader(f.read()).read().decode("ascii").split("\n")[: part.rows]
            rows = np.array([tuple(float(x) for x in line.split()) for line in lines], dtype=[(n, "f8") for n in row.names])
            if len(rows) != count:
                raise ValueError(f"{path} doesn't hold {count} whole rows")
            yield 0, shaped(rows)
            return
        f.seek(body + part.first * row.itemsize)
        for at in range(part.first, part.first + part.rows, BATCH):
            n = min(BATCH, part.first + part.rows - at)
            yield at, shaped(np.frombuffer(f.read(n * row.itemsize), row))


class _RecordReader(_Reader):
    suffix = ".splat"

    def layout(self, path, head, size):
        return size // RECORD.itemsize, 0, RECORD.itemsize

    def values(self, path, f, part):
        f.seek(part.first * RECORD.itemsize)
        for at in range(part.first, part.first + part.rows, BATCH):
            r = np.frombuffer(f.read(min(BATCH, part.first + part.rows - at) * RECORD.itemsize), RECORD)
            alpha = np.clip(r["c"][:, 3] / 255.0, 1e-6, 1 - 1e-6)
            out = {c: r["p"][:, k] for k, c in enumerate("xyz")} | {f"scale_{k}": np.log(r["s"][:, k]) for k in range(3)}
            out |= {f"rot_{k}": (r["q"][:, k].astype(float) - 128) / 128 for k in range(4)} | {c: r["c"][:, k] for k, c in enumerate(COLORS)}
            yield at, out | {"opacity": np.log(alpha / (1 - alpha))}


class _PackedReader(_Reader):
    """Vertices of a range with the chunks they lie in; elements after the vertices are not read."""

    suffix = ".ply"
    exact = False

    def layout(self, path, head, size):
        if b"end_header" not in head:
            raise ValueError(f"{path} has no header within {HEAD} bytes")
        kind, elements, body = parse_elements(head)
        at, count, row = packed_layout(path, elements, kind, body)["vertex"]
        return count, at, row.itemsize

    def values(self, path, f, part):
        kind, elements, body = parse_elements(f.read(HEAD))
        known = packed_layout(path, elements, kind, body)
        (start, _, chunk), (at, _, row) = known["chunk"], known["vertex"]
        for first in range(part.first, part.first + part.rows, BATCH):
            n = min(BATCH, part.first + part.rows - first)
            low, high = first // CHUNK_ROWS, (first + n - 1) // CHUNK_ROWS
            f.seek(start + low * chunk.itemsize)
            chunks = np.frombuffer(f.read((high - low + 1) * chunk.itemsize), chunk)
            f.seek(at + first * row.itemsize)
            rows = np.frombuffer(f.read(n * row.itemsize), row)
            yield first, unpacked(chunks, np.arange(first, first + n) // CHUNK_ROWS - low, rows)


@dataclass
class Written(WriterCommitMessage):
    task: int
    names: list[str]
    rows: int


class _Writer(DataSourceArrowWriter):
    suffix = ""

    def __init__(self, schema, options: dict, overwrite: bool):
        self.path, self.most, self.overwrite = options["path"], int(options.get("rows", ROWS)), overwrite
        self.names = [f.name for f in schema.fields]
        self.folder = f"_temporary-{uuid.uuid4().hex}"
        self.check()

    def check(self) -> None:
        raise NotImplementedError

    def encode(self, table: pa.Table) -> bytes:
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        store.create_dir(f"{root}/{self.folder}", recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        held, size, names, total = [], 0, [], 0

        def flush() -> None:
            table = pa.Table.from_batches(held)
            name = f"{attempt}-{len(names)}"
            with store.open_output_stream(f"{root}/{self.folder}/{name}") as f:
                f.write(self.encode(table))
            names.append(name)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, self.most - size)
                held.append(part)
                at, size, total = at + part.num_rows, size + part.num_rows, total + part.num_rows
                if size == self.most:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return Written(task, names, total)

    def commit(self, messages) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        there = [f.path for f in store.get_file_info(files.FileSelector(root)) if f.base_name.endswith(self.suffix)]
        start = 0 if self.overwrite else len(there)
        if self.overwrite:
            for path in there:
                store.delete_file(path)
        names = [n for m in sorted((m for m in messages if m is not None), key=lambda m: m.task) for n in m.names]
        for k, name in enumerate(names):
            store.move(f"{root}/{self.folder}/{name}", f"{root}/part-{start + k:06}{self.suffix}")
        self._clear(store, root)

    def abort(self, messages) -> None:
        self._clear(*_open(self.path))

    def _clear(self, store, root) -> None:
        if store.get_file_info(f"{root}/{self.folder}").type == files.FileType.Directory:
            store.delete_dir(f"{root}/{self.folder}")


def _column(table: pa.Table, name: str) -> np.ndarray:
    own = table.column(name)
    if own.null_count:
        raise ValueError(f"{name} is null in a row to be written")
    return own.to_numpy(zero_copy_only=False)


class _PlyWriter(_Writer):
    suffix = ".ply"

    def check(self):
        missing = [c for c in COLUMNS if c not in self.names]
        if missing:
            raise ValueError(f"no columns {', '.join(missing)}")

    def encode(self, table):
        rest = [f"f_rest_{i}" for i in range(HARMONICS)] if "sh_rest" in self.names else []
        order = [*COLUMNS[:6], *rest, *COLUMNS[6:]]
        rows = np.zeros(table.num_rows, [(c, "<f4") for c in order])
        for c in COLUMNS:
            rows[c] = _column(table, c)
        if rest:
            values = np.stack(_column(table, "sh_rest"))
            if values.shape[1] != HARMONICS:
                raise ValueError(f"sh_rest has not {HARMONICS} numbers")
            for i, c in enumerate(rest):
                rows[c] = values[:, i]
        head = "".join(f"property float {c}\n" for c in order)
        return f"ply\nformat binary_little_endian 1.0\nelement vertex {len(rows)}\n{head}end_header\n".encode() + rows.tobytes()


class _RecordWriter(_Writer):
    suffix = ".splat"

    def check(self):
        missing = [c for c in [*COLUMNS[:3], *COLUMNS[6:], *COLORS] if c not in self.names]
        if missing:
            raise ValueError(f"no columns {', '.join(missing)}")

    def encode(self, table):
        rows, whole = np.zeros(table.num_rows, RECORD), lambda v: np.clip(np.rint(v), 0, 255).astype(np.uint8)
        for k, c in enumerate("xyz"):
            rows["p"][:, k] = _column(table, c)
            rows["s"][:, k] = np.exp(_column(table, f"scale_{k}"))
            rows["c"][:, k] = whole(_column(table, COLORS[k]))
        rows["c"][:, 3] = whole(255 / (1 + np.exp(-_column(table, "opacity").astype(float))))
        for k in range(4):
            rows["q"][:, k] = whole(_column(table, f"rot_{k}").astype(float) * 128 + 128)
        return rows.tobytes()


class SplatPly(DataSource):
    """Splats of PLY files: colours as harmonics (f_dc_*, sh_rest) or plain (color_*, 0 to 255), normals where there are any."""

    @classmethod
    def name(cls) -> str:
        return "splat_ply"

    def schema(self) -> str:
        return PLY_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PlyReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PlyWriter(schema, self.options, overwrite)


class SplatRecords(DataSource):
    """Splats of 32-byte records: logarithmic scales, logit opacities, colours from 0 to 255."""

    @classmethod
    def name(cls) -> str:
        return "splat_records"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _RecordWriter(schema, self.options, overwrite)


class SplatPacked(DataSource):
    """Splats of compressed PLY files: as ``splat_records``, unpacked from chunks of 256 vertices."""

    @classmethod
    def name(cls) -> str:
        return "splat_packed"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PackedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    spark.dataSource.register(SplatPly)
    spark.dataSource.register(SplatRecords)
    spark.dataSource.register(SplatPacked)
