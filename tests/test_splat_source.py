"""Splat files written and read by ranges of rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenemill.sources import splat_files
from scenemill.sources import splat_source as source
from scenemill.sources.splat_files import COLUMNS


@pytest.fixture(scope="module")
def registered(spark):
    source.register(spark)
    return spark


def ply(kind, fields, rows):
    """A file with these (name, PLY type, numpy type) and rows."""
    order = ">" if kind == "binary_big_endian" else "<"
    head = f"ply\nformat {kind} 1.0\ncomment made\nelement vertex {len(rows)}\n" + "".join(f"property {t} {n}\n" for n, t, _ in fields) + "end_header\n"
    if kind == "ascii":
        return head.encode() + "\n".join(" ".join(map(str, r)) for r in rows).encode() + b"\n"
    return head.encode() + np.array([tuple(r) for r in rows], [(n, order + k) for n, _, k in fields]).tobytes()


NEEDED = [c for c in COLUMNS if not c.startswith("f_dc")]
REAL = lambda names: [(n, "float", "f4") for n in names]


def test_ranges_of_one_file(registered, tmp_path):
    rng = np.random.default_rng(1)
    names = [*COLUMNS, *(f"f_rest_{i}" for i in range(45))]
    rows = rng.normal(size=(1000, len(names))).astype(np.float32)
    for kind in ("binary_little_endian", "binary_big_endian"):
        (tmp_path / f"{kind}.ply").write_bytes(ply(kind, REAL(names), rows))
        df = registered.read.format("splat_ply").option("rows", 130).load(str(tmp_path / f"{kind}.ply"))
        assert df.rdd.getNumPartitions() == 8
        got = df.orderBy("row_index").toPandas()
        assert got["row_index"].tolist() == list(range(1000)) and np.array_equal(got[COLUMNS].to_numpy(np.float32), rows[:, : len(COLUMNS)])
        assert np.array_equal(np.stack(got["sh_rest"]), rows[:, len(COLUMNS) :]) and got["color_0"].isna().all() and got["nx"].isna().all()
    some = registered.read.format("splat_ply").option("columns", "x,opacity").load(str(tmp_path))
    assert some.count() == 2000 and some.where("x is not null and opacity is not null and y is null and sh_rest is null").count() == 2000


def test_plain_colours_and_normals(registered, tmp_path):
    base = [[float(i + k) for k in range(len(NEEDED))] for i in range(5)]
    normals = [[0.0, 1.0, float(i)] for i in range(5)]
    colours = [[i, 100 + i, 255] for i in range(5)]
    for kind in ("ascii", "binary_little_endian"):
        for t, k in (("uchar", "u1"), ("float", "f4")):
            path = tmp_path / f"{kind}-{t}.ply"
            fields = [*REAL(NEEDED), *REAL(["nxx", "ny", "nz"]), *[(c, t, k) for c in ("red", "green", "blue")]]
            path.write_bytes(ply(kind, fields, [a + b + c for a, b, c in zip(base, normals, colours, strict=True)]))
            got = registered.read.format("splat_ply").load(str(path)).orderBy("row_index").toPandas()
            assert np.array_equal(got[["color_0", "color_1", "color_2"]].to_numpy(), colours) and np.array_equal(got[["nx", "ny", "nz"]].to_numpy(), normals)
            assert np.array_equal(got[NEEDED].to_numpy(), base) and got["f_dc_0"].isna().all()


def test_files_that_are_no_splats(registered, tmp_path):
    dc = [f"f_dc_{i}" for i in range(3)]
    bad = {
        "colours": REAL(NEEDED), "normals": REAL([*NEEDED, *dc, "nx"]), "harmonics": REAL([*NEEDED, *dc, "f_rest_0"]),
        "opacity": REAL([c for c in [*NEEDED, *dc] if c != "opacity"]), "mixed": [*REAL(NEEDED), ("red", "uchar", "u1"), ("green", "float", "f4"), ("blue", "float", "f4")],
    }
    for name, fields in bad.items():
        (tmp_path / f"{name}.ply").write_bytes(ply("binary_little_endian", fields, [[0] * len(fields)]))
        with pytest.raises(Exception, match=f"{name}.ply has"):
            registered.read.format("splat_ply").load(str(tmp_path / f"{name}.ply")).count()
    whole = ply("binary_little_endian", REAL([*NEEDED, *dc]), [[0] * 14] * 3)
    (tmp_path / "short.ply").write_bytes(whole[:-1])
    with pytest.raises(Exception, match="whole rows"):
        registered.read.format("splat_ply").load(str(tmp_path / "short.ply")).count()


def splats(spark, n):
    own = spark.range(n).select(*[(F.col("id") * (k + 1) % 97 / 8).cast("float").alias(c) for k, c in enumerate(COLUMNS)], "id")
    return own.withColumn("sh_rest", F.transform(F.sequence(F.lit(0), F.lit(44)), lambda i: (F.col("id") + i).cast("float")))


def test_write_and_read_back(registered, tmp_path):
    df, path = splats(registered, 1003).repartitionByRange(3, "id"), str(tmp_path / "out")
    df.drop("id").write.format("splat_ply").option("rows", 200).mode("append").save(path)
    assert len(os.listdir(path)) == 6 and all(f.startswith("part-") for f in os.listdir(path))
    back = registered.read.format("splat_ply").load(path)
    key = lambda d: sorted((tuple(r[c] for c in COLUMNS), tuple(r.sh_rest)) for r in d.collect())
    assert key(back) == key(df)
    df.limit(10).drop("id").write.format("splat_ply").mode("append").save(path)
    assert registered.read.format("splat_ply").load(path).count() == 1013
    df.limit(7).drop("id").write.format("splat_ply").mode("overwrite").save(path)
    assert registered.read.format("splat_ply").load(path).count() == 7


def test_a_failed_write_leaves_no_file(registered, tmp_path):
    path = str(tmp_path / "out")
    torn = splats(registered, 500).withColumn("x", F.when(F.col("id") < 499, F.col("x"))).drop("id")
    with pytest.raises(Exception, match="x is null"):
        torn.write.format("splat_ply").option("rows", 50).mode("append").save(path)
    assert not os.path.exists(path) or not os.listdir(path)


def test_records(registered, tmp_path):
    rng = np.random.default_rng(2)
    values = {**{c: rng.normal(size=300) for c in ("x", "y", "z", "scale_0", "scale_1", "scale_2")}, "opacity": rng.uniform(-4, 4, 300)}
    values |= {f"rot_{k}": rng.integers(-128, 128, 300) / 128 for k in range(4)} | {f"color_{k}": rng.integers(0, 256, 300) for k in range(3)}
    rows = [tuple(float(v[i]) for v in values.values()) for i in range(300)]
    df = registered.createDataFrame(rows, ", ".join(f"{c} float" for c in values)).coalesce(1)
    path = str(tmp_path / "out")
    df.write.format("splat_records").mode("append").save(path)
    assert os.path.getsize(f"{path}/part-000000.splat") == 300 * 32
    got = registered.read.format("splat_records").option("rows", 64).load(path).orderBy("row_index").toPandas()
    for c, v in values.items():
        assert np.allclose(got[c], v, atol=0.03 if c == "opacity" else 1e-5, rtol=0.03 if c == "opacity" else 1e-5), c


def test_filter_refuses_doubled_rows_and_other_files(registered, tmp_path):
    rows = [[float(i)] * len(COLUMNS) for i in range(4)]
    (tmp_path / "a.ply").write_bytes(ply("binary_little_endian", REAL(COLUMNS), rows))
    (tmp_path / "b.ply").write_bytes(ply("binary_little_endian", REAL(COLUMNS[:-1]), [r[1:] for r in rows]))
    for name, chosen, message in (("a", [1, 1], "twice"), ("a", [4], "filtered"), ("b", [1], "has no float rot_3")):
        selection = registered.createDataFrame([(f"file:{tmp_path}/{name}.ply", i) for i in chosen], "path string, row_index long")
        with pytest.raises(Exception, match=message):
            splat_files.filter_ply(registered, f"{tmp_path}/{name}.ply", selection).collect()


def test_packed_files_by_ranges(spark, tmp_path):
    """Ranges across chunks, with and without colours of chunks and with an element after the vertices."""
    rng = np.random.default_rng(21)
    for name, colours, tail in (("a", False, 0), ("b", True, 9)):
        ends = [f"{e}{k}_{x}" for e in ("min", "max") for k, axes in (("", "xyz"), ("_scale", "xyz"), *((("", "rgb"),) if colours else ())) for x in axes]
        chunks, rows = rng.normal(size=(3, len(ends))).astype("<f4"), rng.integers(0, 2**32, size=(700, 4), dtype=np.uint32)
        packed = ["packed_position", "packed_rotation", "packed_scale", "packed_color"]
        head = "element chunk 3\n" + "".join(f"property float {c}\n" for c in ends) + "element vertex 700\n" + "".join(f"property uint {c}\n" for c in packed)
        head += f"element sh {tail}\nproperty uchar f_rest_0\n" if tail else ""
        (tmp_path / f"{name}.ply").write_bytes(f"ply\nformat binary_little_endian 1.0\n{head}end_header\n".encode() + chunks.tobytes() + rows.tobytes() + bytes(tail))
    source.register(spark)
    got = spark.read.format("splat_packed").option("path", str(tmp_path)).option("rows", 100).load()
    assert got.rdd.getNumPartitions() == 14
    whole = splat_files.read_compressed_ply(spark, str(tmp_path / "*.ply")).toPandas()
    made = got.toPandas()
    for own in (whole, made):
        own["path"] = own["path"].str[-5:]
        own.sort_values(["path", "row_index"], inplace=True, ignore_index=True)
    assert len(made) == 1400 and np.allclose(made[whole.columns].drop(columns="path").to_numpy(), whole.drop(columns="path").to_numpy())
    some = spark.read.format("splat_packed").option("path", str(tmp_path)).option("columns", "x").load().agg({"x": "count", "y": "count"}).first()
    assert sorted(some) == [0, 1400]
    (tmp_path / "a.ply").write_bytes((tmp_path / "a.ply").read_bytes()[:-1])
    with pytest.raises(Exception, match="whole rows"):
        spark.read.format("splat_packed").option("path", str(tmp_path / "a.ply")).load().collect()
