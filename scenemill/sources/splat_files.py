"""Splat files: PLY and 32-byte records in, filtered PLY out. A file is parsed by one task, in batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: PLY's names of number types.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
COLUMNS = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
SCHEMA = "path string, row_index long, " + ", ".join(f"{c} float" for c in COLUMNS) + ", sh_rest array<float>"
_BATCH = 65_536


def parse_header(raw: bytes) -> tuple[str, int, np.dtype, int]:
    """(format, vertices, row type, offset of the first row) of a PLY file with one vertex element first."""
    end = raw.index(b"end_header")
    body = raw.index(b"\n", end) + 1
    kind, count, fields, own = "", 0, [], False
    for line in raw[:end].decode("ascii").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            own = words[1] == "vertex"
            count = int(words[2]) if own else count
        elif words[:1] == ["property"] and own:
            if words[1] == "list":
                raise ValueError("list properties of vertices are not supported")
            fields.append((words[2], TYPES[words[1]]))
    order = ">" if kind == "binary_big_endian" else "<"
    return kind, count, np.dtype([(n, order + t) for n, t in fields]), body


def _frame(path: str, first: int, rows: np.ndarray) -> pd.DataFrame:
    names = rows.dtype.names
    out = pd.DataFrame({"path": path, "row_index": np.arange(first, first + len(rows))})
    for c in COLUMNS:
        out[c] = rows[c].astype(np.float32) if c in names else None
    rest = sorted((n for n in names if n.startswith("f_rest_")), key=lambda n: int(n[7:]))
    out["sh_rest"] = list(np.stack([rows[n].astype(np.float32) for n in rest], 1)) if rest else None
    return out


def read_splat_ply(spark: SparkSession, paths: str) -> DataFrame:
    """(path, row_index, position, colour, opacity, scale, rotation, sh_rest) of ascii or binary PLY files."""

    def fn(batches):
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                kind, count, row, body = parse_header(raw)
                if kind == "ascii":
                    lines = raw[body:].decode("ascii").split("\n")[:count]
                    rows = np.array([tuple(float(x) for x in line.split()) for line in lines], dtype=[(n, "f8") for n in row.names])
                else:
                    rows = np.frombuffer(raw, row, count, body)
                for i in range(0, count, _BATCH):
                    yield _frame(path, i, rows[i : i + _BATCH])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(fn, SCHEMA)


def read_splat_binary(spark: SparkSession, paths: str) -> DataFrame:
    """Splats of 32-byte records: linear scales become logarithms, alpha a logit, the quaternion bytes numbers."""
    record = np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 4), ("q", "u1", 4)])

    def fn(batches):
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                if len(raw) % record.itemsize:
                    raise ValueError(f"{path} does not hold whole records")
                rows = np.frombuffer(raw, record)
                for i in range(0, len(rows), _BATCH):
                    r = rows[i : i + _BATCH]
                    alpha = np.clip(r["c"][:, 3] / 255.0, 1e-6, 1 - 1e-6)
                    parts = {f"scale_{k}": np.log(r["s"][:, k]) for k in range(3)} | {f"rot_{k}": (r["q"][:, k].astype(float) - 128) / 128 for k in range(4)}
                    parts |= {c: r["p"][:, k] for k, c in enumerate("xyz")} | {f"color_{k}": r["c"][:, k].astype(np.int16) for k in range(3)}
                    yield pd.DataFrame({"path": path, "row_index": np.arange(i, i + len(r)), **parts, "opacity": np.log(alpha / (1 - alpha))})

    names = [f"scale_{k}" for k in range(3)] + [f"rot_{k}" for k in range(4)] + list("xyz")
    schema = "path string, row_index long, " + ", ".join(f"{c} float" for c in names) + ", color_0 short, color_1 short, color_2 short, opacity float"
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(fn, schema)


def filter_ply(spark: SparkSession, paths: str, selection: DataFrame) -> DataFrame:
    """(path, content, rows, low, high): PLY files with the selected rows only, in order and byte for byte.

    selection: (path, row_index), each row once. Files must be binary and little-endian and have the 14 float
    properties of COLUMNS; only the vertex count changes in the header. The bounds are those of the kept positions. A
    file is one task's; splat_source writes files of bounded size.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    chosen = selection.groupBy("path").agg(F.array_sort(F.collect_list("row_index")).alias("keep"))

    def fn(batches):
        for b in batches:
            out = []
            for path, raw, keep in zip(b["path"], b["content"], b["keep"], strict=True):
                kind, count, row, body = parse_header(raw)
                if kind != "binary_little_endian" or len(raw) != body + count * row.itemsize or not len(keep) or max(keep) >= count:
                    raise ValueError(f"{path} can't be filtered")
                missing = [c for c in COLUMNS if c not in row.names or row[c].str != "<f4"]
                if missing:
                    raise ValueError(f"{path} has no float {', '.join(missing)}")
                if min(keep) < 0 or len(set(keep)) < len(keep):
                    raise ValueError(f"{path}: a row is selected twice, or has no place")
                rows = np.frombuffer(raw, row, count, body)[np.asarray(keep)]
                head = raw[:body].replace(f"element vertex {count}".encode(), f"element vertex {len(rows)}".encode(), 1)
                p = np.stack([rows[c].astype(float) for c in "xyz"], 1)
                out.append((path, head + rows.tobytes(), len(rows), p.min(axis=0).tolist(), p.max(axis=0).tolist()))
            yield pd.DataFrame(out, columns=["path", "content", "rows", "low", "high"])

    return files.join(chosen, "path").mapInPandas(fn, "path string, content binary, rows long, low array<double>, high array<double>")


#: Elements and properties of compressed PLY files, and vertices of a chunk.
CHUNK_ROWS = 256
PACKED = ["packed_position", "packed_rotation", "packed_scale", "packed_color"]


def parse_elements(raw: bytes) -> tuple[str, list[tuple[str, int, np.dtype]], int]:
    """(format, [(element, rows, row type)], offset of the first row) of a PLY file without lists."""
    end = raw.index(b"end_header")
    kind, found = "", []
    for line in raw[:end].decode("ascii").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            found.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            if words[1] == "list":
                raise ValueError("list properties are not supported")
            found[-1][2].append((words[2], TYPES[words[1]]))
    order = ">" if kind == "binary_big_endian" else "<"
    return kind, [(name, n, np.dtype([(c, order + t) for c, t in fields])) for name, n, fields in found], raw.index(b"\n", end) + 1


def _unpack(packed: np.ndarray) -> np.ndarray:
    """Three numbers from 0 to 1 of 11, 10 and 11 bits."""
    v = packed.astype(np.int64)
    return np.stack([(v >> 21 & 2047) / 2047, (v >> 11 & 1023) / 1023, (v & 2047) / 2047], 1).astype(np.float32)


def _unpack_rotation(packed: np.ndarray) -> np.ndarray:
    """w x y z of the place of the largest part (2 bits) and the other three (10 bits each)."""
    v = packed.astype(np.int64)
    three = np.stack([(v >> s & 1023) / 1023 - 0.5 for s in (20, 10, 0)], 1) * np.sqrt(2.0)
    largest, out = (v >> 30 & 3).astype(np.int64), np.empty((len(v), 4))
    out[np.arange(len(v)), largest] = np.sqrt(np.maximum(0, 1 - (three**2).sum(axis=1)))
    for k in range(4):
        own = largest == k
        out[np.ix_(own, [i for i in range(4) if i != k])] = three[own]
    return out.astype(np.float32)


def packed_layout(path: str, elements: list[tuple[str, int, np.dtype]], kind: str, body: int) -> dict[str, tuple[int, int, np.dtype]]:
    """Element -> (offset, rows, row type) of a compressed file; any other file is an error."""
    if kind == "ascii":
        raise ValueError(f"{path} is not binary")
    out = {}
    for name, n, row in elements:
        out[name] = (body, n, row)
        body += n * row.itemsize
    if "chunk" not in out or "vertex" not in out or any(p not in (out["vertex"][2].names or ()) for p in PACKED):
        raise ValueError(f"{path} is not a compressed file")
    if out["vertex"][1] > CHUNK_ROWS * out["chunk"][1]:
        raise ValueError(f"{path} has vertices without a chunk")
    return out


def unpacked(chunks: np.ndarray, c: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of packed vertices r, whose chunks are chunks[c]."""
    ends = lambda kind, axes: [np.stack([chunks[f"{e}{kind}_{x}"][c] for x in axes], 1) for e in ("min", "max")]
    lerp = lambda low, high, t: low + t * (high - low)
    rgba = np.stack([r["packed_color"].astype(np.int64) >> s & 255 for s in (24, 16, 8, 0)], 1) / 255
    color = rgba[:, :3].astype(np.float32)
    if all(f"{e}_{x}" in chunks.dtype.names for e in ("min", "max") for x in "rgb"):
        color = lerp(*ends("", "rgb"), color)
    alpha = np.clip(rgba[:, 3], 1e-6, 1 - 1e-6)
    groups = {"{}": lerp(*ends("", "xyz"), _unpack(r["packed_position"])), "scale_{}": lerp(*ends("_scale", "xyz"), _unpack(r["packed_scale"]))}
    groups |= {"rot_{}": _unpack_rotation(r["packed_rotation"]), "color_{}": color * 255}
    out = {name.format("xyz"[k] if name == "{}" else k): values[:, k] for name, values in groups.items() for k in range(values.shape[1])}
    return out | {"opacity": np.log(alpha / (1 - alpha))}


def read_compressed_ply(spark: SparkSession, paths: str) -> DataFrame:
    """(path, row_index, x, y, z, scale_0 to 2, rot_0 to 3, color_0 to 2, opacity) of compressed PLY files.

    Vertices are packed in chunks of 256, each with the ranges of its positions, logarithmic scales and, maybe,
    colours. Colours are 0 to 255; the opacity is the logit of the packed alpha, kept within 1e-6 of 0 and 1.
    A file is one task here; the data source ``splat_packed`` reads ranges of its rows.
    """
    names = [*"xyz", *[f"scale_{i}" for i in range(3)], *[f"rot_{i}" for i in range(4)], *[f"color_{i}" for i in range(3)], "opacity"]

    def fn(batches):
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                kind, elements, body = parse_elements(raw)
                chunks, rows = (np.frombuffer(raw, row, n, at) for at, n, row in (packed_layout(path, elements, kind, body)[e] for e in ("chunk", "vertex")))
                for i in range(0, len(rows), _BATCH):
                    r = rows[i : i + _BATCH]
                    made = pd.DataFrame({n: v.astype(np.float32) for n, v in unpacked(chunks, np.arange(i, i + len(r)) // CHUNK_ROWS, r).items()})
                    yield made.assign(path=path, row_index=np.arange(i, i + len(r)))[["path", "row_index", *names]]

    schema = "path string, row_index long, " + ", ".join(f"{c} float" for c in names)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(fn, schema)
