"""Column expressions of 3-D geometry. Each stays inside Spark's generated code.

Prefixes name triples of columns: xyz("a_") is (a_x, a_y, a_z).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def xyz(prefix: str = "") -> Vec:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dist2(a: Vec, b: Vec) -> Column:
    d = sub(a, b)
    return dot(d, d)


def distance(a: Vec, b: Vec) -> Column:
    return F.sqrt(dist2(a, b))


def l1(a: Vec, b: Vec) -> Column:
    d = sub(a, b)
    return F.abs(d[0]) + F.abs(d[1]) + F.abs(d[2])


def kernel(r: Column, h: float) -> Column:
    """exp(-r^2 / (h/4)^2), for L1 distances r."""
    return F.exp(-(r * r) / F.lit((h / 4) ** 2))


def is_finite(a: Vec) -> Column:
    """False for null, NaN and infinite coordinates."""
    inf = F.lit(float("inf"))
    return F.coalesce(F.abs(a[0]) < inf, F.lit(False)) & F.coalesce(F.abs(a[1]) < inf, F.lit(False)) & F.coalesce(F.abs(a[2]) < inf, F.lit(False))


def segment_distance(p: Vec, a: Vec, b: Vec) -> Column:
    """Distance of p to segment ab; a segment without length is its point."""
    v = sub(b, a)
    length2 = dot(v, v)
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(sub(p, a), v) / F.when(length2 > 0, length2)))).otherwise(0.0)
    return distance(p, tuple(q + t * w for q, w in zip(a, v, strict=True)))


def clamp_length(d: Vec, most: float) -> Vec:
    """d, shortened to length `most` where it is longer."""
    length = F.sqrt(dot(d, d))
    scale = F.when(length > most, F.lit(most) / F.when(length > most, length)).otherwise(1.0)
    return tuple(c * scale for c in d)


def symmetric_eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Vec:
    """Ascending eigenvalues of a symmetric 3x3 matrix in closed form (trigonometric solution)."""
    q = (xx + yy + zz) / 3
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)
    p = F.sqrt(p2 / 6)
    a, b, c, d, e, f = ((v / F.when(p > 0, p)) for v in (xx - q, yy - q, zz - q, xy, xz, yz))
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    high = q + 2 * p * F.cos(phi)
    low = q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    flat = ~(p > 0)
    return F.when(flat, q).otherwise(low), F.when(flat, q).otherwise(3 * q - high - low), F.when(flat, q).otherwise(high)


def heron_area(a: Column, b: Column, c: Column) -> Column:
    s = (a + b + c) / 2
    return F.sqrt(F.greatest(F.lit(0.0), s * (s - a) * (s - b) * (s - c)))


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    n = cross(sub(b, a), sub(c, a))
    return F.sqrt(dot(n, n)) / 2


def half_cotan(opposite2: Column, other2: Column, third2: Column, area: Column) -> Column:
    """Half the cotangent of the angle opposite an edge, from squared lengths; null for a flat triangle."""
    return (other2 + third2 - opposite2) / (8 * F.when(area > 0, area))


def corner_angle(opposite: Column, left: Column, right: Column) -> Column:
    q = (left * left + right * right - opposite * opposite) / (2 * F.when(left * right > 0, left * right))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q)))


def circumradius(a: Column, b: Column, c: Column) -> Column:
    area = heron_area(a, b, c)
    return a * b * c / (4 * F.when(area > 0, area))


def without_component(v: Vec, n: Vec) -> Vec:
    """v without its part along unit vector n: its projection to the tangent plane."""
    along = dot(v, n)
    return tuple(p - along * q for p, q in zip(v, n, strict=True))
