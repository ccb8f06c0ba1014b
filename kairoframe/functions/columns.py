"""Column factories: bands, scores, vectors and quaternions. All are plain expressions inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, ...]


def band(value: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """The name of the first band whose (exclusive) upper bound is above the value; null stays null."""
    chosen = reduce(lambda rest, b: F.when(value < b[0], b[1]).otherwise(rest), reversed(bounds), F.lit(last))
    return F.when(value.isNotNull(), chosen)


def unit_score(value: Column, low: float, high: float) -> Column:
    """0 at low and below, 1 at high and above, linear between; 0 everywhere if the bounds are not in order."""
    if high <= low:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(0.0)).otherwise(a / b)


def component(array: str, i: int) -> Column:
    return F.get(array, F.lit(i)).cast("double")


def vector(array: str, first: int, n: int = 3) -> Vector:
    return tuple(component(array, first + i) for i in range(n))


def add(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b))


def subtract(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b))


def scale(a: Vector, s: Column | float) -> Vector:
    return tuple(x * s for x in a)


def dot(a: Vector, b: Vector) -> Column:
    return reduce(lambda x, y: x + y, (x * y for x, y in zip(a, b)))


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Vector) -> Vector:
    """Zero for the zero vector."""
    n = length(a)
    return tuple(F.when(n > 0, x / n).otherwise(F.lit(0.0)) for x in a)


def lerp(a: Vector, b: Vector, t: Column | float) -> Vector:
    return tuple(x + (y - x) * t for x, y in zip(a, b))


def conjugate(q: Vector) -> Vector:
    return (-q[0], -q[1], -q[2], q[3])


def product(a: Vector, b: Vector) -> Vector:
    """The turn that b and then a make together."""
    xyz = add(add(scale(b[:3], a[3]), scale(a[:3], b[3])), cross(a[:3], b[:3]))
    return (*xyz, a[3] * b[3] - dot(a[:3], b[:3]))


def rotate(q: Vector, v: Vector) -> Vector:
    """v turned by the unit quaternion q = (x, y, z, w)."""
    u, w = q[:3], q[3]
    t = scale(cross(u, v), 2.0)
    return add(add(v, scale(t, w)), cross(u, t))


def euler_xyz(q: Vector) -> Vector:
    x, y, z, w = q
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (x * z + w * y) * 2.0))
    return (
        F.atan2((w * x - y * z) * 2.0, F.lit(1.0) - (x * x + y * y) * 2.0),
        F.asin(sine),
        F.atan2((w * z - x * y) * 2.0, F.lit(1.0) - (y * y + z * z) * 2.0),
    )


def slerp(a: Vector, b: Vector, t: Column | float) -> Vector:
    """The short way round; linear where the two are almost equal."""
    cosine = dot(a, b)
    near = tuple(F.when(cosine < 0, -x).otherwise(x) for x in b)
    angle = F.acos(F.least(F.lit(1.0), F.abs(cosine)))
    sine = F.sin(angle)
    one = F.when(sine > 1e-6, F.sin(angle * (F.lit(1.0) - t)) / sine).otherwise(F.lit(1.0) - t)
    two = F.when(sine > 1e-6, F.sin(angle * t) / sine).otherwise(F.lit(1.0) * t)
    return tuple(x * one + y * two for x, y in zip(a, near))


def free_flight(p: Vector, v: Vector, dt: Column, gravity: float) -> Vector:
    """Where a body in free flight is after dt (gravity along the third axis, negative: down)."""
    return (p[0] + v[0] * dt, p[1] + v[1] * dt, p[2] + v[2] * dt + dt * dt * (0.5 * gravity))


def axis_angle(axis: Vector, angle: Column) -> Vector:
    """The unit quaternion of a turn by ``angle`` about a unit axis."""
    half = angle * 0.5
    return (*(x * F.sin(half) for x in axis), F.cos(half))


def angle_between(a: Vector, b: Vector) -> Column:
    """The angle of the turn from one unit quaternion to another."""
    return F.acos(F.least(F.lit(1.0), F.abs(dot(a, b)))) * 2.0


def segment_distance(p: Vector, a: Vector, b: Vector) -> Column:
    """The distance of a point to the segment from a to b."""
    along = subtract(b, a)
    size = dot(along, along)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(size > 0, dot(subtract(p, a), along) / size).otherwise(F.lit(0.0))))
    return length(subtract(p, lerp(a, b, share)))


def box_distance(p: Vector, centre: Vector, q: Vector, half: tuple[float, float, float]) -> Column:
    """The distance of a point to a box with the given half sizes, turned by the unit quaternion q about its centre; 0 inside."""
    local = rotate(conjugate(q), subtract(p, centre))
    return length(tuple(F.greatest(F.lit(0.0), F.abs(x) - h) for x, h in zip(local, half)))


def boost_percent(raw: Column) -> Column:
    """A boost amount of 0 to 255 in hundredths."""
    return raw * 100.0 / 255.0


def boost_raw(percent: Column) -> Column:
    return percent * 255.0 / 100.0


def title_case(name: Column) -> Column:
    """A stream's name for people: snake_case to Words."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def without_prefix(name: Column, prefix: str) -> Column:
    return F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 20)).otherwise(name)
