"""Vectors as columns and arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance_sq(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    dx, dy, dz = ax - bx, ay - by, az - bz
    return dx * dx + dy * dy + dz * dz


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vector(v: Column) -> Column:
    """The vector at length 1; null if it is not longer than 1e-6."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 1e-6, F.transform(v, lambda x: x / norm))


def cross(a: Column, b: Column) -> Column:
    x, y = (lambda i: F.get(a, i)), (lambda i: F.get(b, i))
    return F.array(x(1) * y(2) - x(2) * y(1), x(2) * y(0) - x(0) * y(2), x(0) * y(1) - x(1) * y(0))


def centroid(points: Column) -> Column:
    """Mean of array<array<double>> of three components."""
    n = F.size(points)
    part = lambda i: F.aggregate(points, F.lit(0.0), lambda s, p: s + F.get(p, i)) / n
    return F.when(n > 0, F.array(part(0), part(1), part(2)))


def plane_normal(points: Column) -> Column:
    """The unit normal of the plane through the centroid and the first pair of points not in line with it; null if there is none."""
    arms = F.transform(points, lambda p: F.zip_with(p, centroid(points), lambda a, b: a - b))
    normals = F.flatten(F.transform(arms, lambda a, i: F.transform(F.filter(arms, lambda b, j: j > i), lambda b: unit_vector(cross(a, b)))))
    return F.get(F.filter(normals, lambda n: n.isNotNull()), 0)


def with_planes(df: DataFrame, points: str) -> DataFrame:
    """``df`` with the centroid and :func:`plane_normal` of its column ``points`` (two or more); rows without a plane go.

    Each number is a column of its own, worked out once; only where the first pair is in line with the centroid are all pairs made."""
    at = lambda i, k: F.get(F.get(points, i), k)
    part = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + F.get(p, k)) / F.size(points)
    out = df.withColumns({f"__c{k}": part(k) for k in range(3)})
    out = out.withColumns({f"__{v}{k}": at(i, k) - F.col(f"__c{k}") for i, v in enumerate("ab") for k in range(3)})
    out = out.withColumns({f"__n{k}": F.col(f"__a{(k + 1) % 3}") * F.col(f"__b{(k + 2) % 3}") - F.col(f"__a{(k + 2) % 3}") * F.col(f"__b{(k + 1) % 3}") for k in range(3)})
    out = out.withColumn("__len", F.sqrt(sum((F.col(f"__n{k}") * F.col(f"__n{k}") for k in range(1, 3)), F.col("__n0") * F.col("__n0"))))
    normal = F.when(F.col("__len") > 1e-6, F.array(*[F.col(f"__n{k}") / F.col("__len") for k in range(3)])).otherwise(plane_normal(F.col(points)))
    # a filter on it would be pushed down, and work out everything above for each of its uses
    return out.select(*df.columns, F.array(*[F.col(f"__c{k}") for k in range(3)]).alias("centroid"), F.explode(F.filter(F.array(normal), lambda n: n.isNotNull())).alias("normal"))


def docking_box(n: Column, lo: list[Column], hi: list[Column], mean: list[Column], margin: float = 8.0, least: float = 14.0) -> Column:
    """struct(center, size): the centroid, and each extent plus a margin, at least ``least``; without atoms 0 and 20."""
    return F.struct(
        F.when(n > 0, F.array(*mean)).otherwise(F.array(*[F.lit(0.0)] * 3)).alias("center"),
        F.when(n > 0, F.array(*[F.greatest(b - a + margin, F.lit(least)) for a, b in zip(lo, hi, strict=True)])).otherwise(F.array(*[F.lit(20.0)] * 3)).alias("size"),
    )


def rotation(u: Column) -> Column:
    """The rotation matrix (array of rows) of a uniformly random quaternion, from an array of three numbers in [0, 1)."""
    at = lambda i: F.get(u, i)
    turn = lambda i: 2 * math.pi * at(i)
    x, y = F.sqrt(1 - at(0)) * F.sin(turn(1)), F.sqrt(1 - at(0)) * F.cos(turn(1))
    z, w = F.sqrt(at(0)) * F.sin(turn(2)), F.sqrt(at(0)) * F.cos(turn(2))
    square = lambda a, b: 1 - 2 * (a * a + b * b)
    plus, minus = (lambda a, b, c: 2 * (a * b + w * c)), (lambda a, b, c: 2 * (a * b - w * c))
    return F.array(F.array(square(y, z), minus(x, y, z), plus(x, z, y)), F.array(plus(x, y, z), square(x, z), minus(y, z, x)), F.array(minus(x, z, y), plus(y, z, x), square(x, y)))


def seeded(seed: Column, n: int = 3) -> Column:
    """``n`` numbers in [0, 1) drawn from a seed: the same ones wherever it runs."""
    return F.array(*[F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(1 << 52)) / float(1 << 52) for i in range(n)])


def rotated(points: Column, matrix: Column) -> Column:
    return F.transform(points, lambda p: F.transform(matrix, lambda row: dot(row, p)))
