"""Quaternions, poses and camera models as column arithmetic (world to camera, w x y z)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def rotation(w: Column, x: Column, y: Column, z: Column) -> tuple[Vector, Vector, Vector]:
    """Rows of the matrix of a unit quaternion."""
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def centre(rows: tuple[Vector, Vector, Vector], t: Vector) -> Vector:
    """Camera centre: minus the transposed rotation times t."""
    return tuple(-(rows[0][i] * t[0] + rows[1][i] * t[1] + rows[2][i] * t[2]) for i in range(3))


def project(model: Column, params: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Pixel of the normalised image point (u, v); null for a model that is not known."""
    p = lambda i: F.get(params, F.lit(i))
    r2 = u * u + v * v
    r = F.sqrt(r2)
    simple, radial = 1 + p(3) * r2, 1 + p(3) * r2 + p(4) * r2 * r2
    spread = 1 + p(4) * r2 + p(5) * r2 * r2
    open_u = u * spread + 2 * p(6) * u * v + p(7) * (r2 + 2 * u * u)
    open_v = v * spread + 2 * p(7) * u * v + p(6) * (r2 + 2 * v * v)
    a = F.atan(r)
    a2 = a * a
    bent = a * (1 + p(4) * a2 + p(5) * a2 * a2 + p(6) * a2 * a2 * a2 + p(7) * a2 * a2 * a2 * a2)
    bend = F.when(r > 1e-12, bent / r).otherwise(F.lit(1.0))
    x = (
        F.when(model == "SIMPLE_PINHOLE", p(0) * u + p(1))
        .when(model == "PINHOLE", p(0) * u + p(2))
        .when(model == "SIMPLE_RADIAL", p(0) * u * simple + p(1))
        .when(model == "RADIAL", p(0) * u * radial + p(1))
        .when(model == "OPENCV", p(0) * open_u + p(2))
        .when(model == "OPENCV_FISHEYE", p(0) * u * bend + p(2))
    )
    y = (
        F.when(model == "SIMPLE_PINHOLE", p(0) * v + p(2))
        .when(model == "PINHOLE", p(1) * v + p(3))
        .when(model == "SIMPLE_RADIAL", p(0) * v * simple + p(2))
        .when(model == "RADIAL", p(0) * v * radial + p(2))
        .when(model == "OPENCV", p(1) * open_v + p(3))
        .when(model == "OPENCV_FISHEYE", p(1) * v * bend + p(3))
    )
    return x, y


def quaternion(r: tuple[Vector, Vector, Vector]) -> Column:
    """w x y z of the matrix with these rows, as an array; its first part that is not 0 is positive."""
    # Four times the square of each part; the largest one is the safe divisor.
    squares = [1 + r[0][0] + r[1][1] + r[2][2], 1 + r[0][0] - r[1][1] - r[2][2], 1 - r[0][0] + r[1][1] - r[2][2], 1 - r[0][0] - r[1][1] + r[2][2]]
    product = {
        (0, 1): r[2][1] - r[1][2], (0, 2): r[0][2] - r[2][0], (0, 3): r[1][0] - r[0][1],
        (1, 2): r[0][1] + r[1][0], (1, 3): r[0][2] + r[2][0], (2, 3): r[1][2] + r[2][1],
    }
    parts = [F.array(*[squares[k] if k == i else product[min(i, k), max(i, k)] for i in range(4)]) for k in range(4)]
    largest = F.greatest(*squares)
    best = F.when(squares[0] == largest, parts[0]).when(squares[1] == largest, parts[1]).when(squares[2] == largest, parts[2]).otherwise(parts[3])
    sign = F.signum(F.get(F.filter(best, lambda x: x != 0), F.lit(0)))
    return F.transform(best, lambda x: x * sign / (2 * F.sqrt(largest)))


def world_to_camera(matrix: Column) -> dict[str, Column]:
    """qw to qz, tx to tz and ``valid`` of a camera-to-world matrix with x right, y up and z backwards.

    The matrix is row-major with four columns (three or four rows). The result looks along z with y down. It is
    valid if its axes are orthonormal within 1e-3 and not mirrored; the quaternion's first part that is not 0 is positive.
    """
    m = lambda i, j: F.get(matrix, F.lit(4 * i + j))
    turn = (1.0, -1.0, -1.0)
    r = [tuple(m(j, i) * turn[i] for j in range(3)) for i in range(3)]
    t = tuple(-dot(r[i], (m(0, 3), m(1, 3), m(2, 3))) for i in range(3))
    ok: Column = F.lit(True)
    for i in range(3):
        for j in range(i, 3):
            ok = ok & (F.abs(dot(r[i], r[j]) - float(i == j)) <= 1e-3)
    cross = (r[1][1] * r[2][2] - r[1][2] * r[2][1], r[1][2] * r[2][0] - r[1][0] * r[2][2], r[1][0] * r[2][1] - r[1][1] * r[2][0])
    ok = F.coalesce(ok & (dot(r[0], cross) > 0), F.lit(False))
    q = quaternion(r)
    return {**{f"q{c}": F.get(q, F.lit(i)) for i, c in enumerate("wxyz")}, **{f"t{c}": t[i] for i, c in enumerate("xyz")}, "valid": ok}
