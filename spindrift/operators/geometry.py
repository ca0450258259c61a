"""Rotations, body and head frames and angles, as expressions over columns of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Matrix = tuple[Vector, Vector, Vector]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit_vector(a: Vector, least: float = 0.0) -> Vector:
    """The direction of a vector; null if it isn't longer than ``least``."""
    length = F.when(norm(a) > least, norm(a))
    return a[0] / length, a[1] / length, a[2] / length


def times(m: Matrix, v: Vector) -> Vector:
    return dot(m[0], v), dot(m[1], v), dot(m[2], v)


def transposed(m: Matrix) -> Matrix:
    return tuple(tuple(m[j][i] for j in range(3)) for i in range(3))


def product(a: Matrix, b: Matrix) -> Matrix:
    columns = transposed(b)
    return tuple(tuple(dot(row, c) for c in columns) for row in a)


def rotation(axis: str, angle: Column) -> Matrix:
    """Rotation about x, y or z by an angle in radians."""
    c, s, one, no = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    return {"x": ((one, no, no), (no, c, -s), (no, s, c)), "y": ((c, no, s), (no, one, no), (-s, no, c)), "z": ((c, -s, no), (s, c, no), (no, no, one))}[axis]


def euler_matrix(angles: Vector, order: str = "xyz") -> Matrix:
    """The rotations about the named axes, multiplied in that order; ``angles`` are those about x, y and z."""
    turns = [rotation(axis, angles["xyz".index(axis)]) for axis in order]
    return product(product(turns[0], turns[1]), turns[2])


def planar_frame(v: Vector, least: float = 0.001) -> Matrix:
    """Rows: the vector laid flat, z x that, and z; null for a vector of under 1 mm."""
    zero, one = v[0] * 0, v[0] * 0 + 1
    x = unit_vector((v[0], v[1], zero), least)
    z = (zero, zero, one)
    return x, cross(z, x), z


def body_frame(v: Vector, least: float = 0.001) -> Matrix:
    """Rows: the vector's direction, its flat normal, and their cross product."""
    x = unit_vector(v, least)
    y = unit_vector((-x[1], x[0], x[0] * 0))
    return x, y, cross(x, y)


def head_frame(x: Vector, z: Vector) -> Matrix:
    x, z = unit_vector(x), unit_vector(z)
    return x, cross(z, x), z


def relative(frame: Matrix, head: Matrix) -> Matrix:
    """Each axis of the head, seen from a body frame."""
    return tuple(times(frame, axis) for axis in head)


def euler_angles(m: Matrix) -> Vector:
    """Angles about x, y and z of a matrix (radians), with the fallback where y is near a right angle."""
    (r11, r12, r13), (r21, r22, r23), (_, _, r33) = m
    t = F.sqrt(r33 * r33 + r23 * r23)
    free = t > 1e-4
    return F.when(free, F.atan2(-r23, r33)).otherwise(F.lit(0.0)), F.atan2(r13, t), F.when(free, F.atan2(-r12, r11)).otherwise(F.atan2(r21, r22))


def back_angles(v: Vector) -> tuple[Column, Column]:
    """Pitch and azimuth (radians) of a direction in the body frame."""
    return -F.atan2(v[2], F.sqrt(v[0] * v[0] + v[1] * v[1])), F.atan2(v[1], v[0])


def exponential_map(m: Matrix) -> Vector:
    """Axis times angle of a rotation matrix; zero for none. Half turns, whose axis this can't tell, are null."""
    angle = F.acos(F.greatest(F.least((m[0][0] + m[1][1] + m[2][2] - 1) / 2, F.lit(1.0)), F.lit(-1.0)))
    scale = F.when(angle < 1e-8, F.lit(0.0)).when(F.sin(angle) > 1e-8, angle / (2 * F.sin(angle)))
    return (m[2][1] - m[1][2]) * scale, (m[0][2] - m[2][0]) * scale, (m[1][0] - m[0][1]) * scale


def valid_angles(roll: Column, azimuth: Column, up: Column, limit: float = 0.9) -> tuple[Column, Column]:
    """Roll and azimuth mean nothing where the head points straight up or down."""
    fine = F.abs(up) <= limit
    return F.when(fine, roll), F.when(fine, azimuth)


def distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(sum((F.pow(p - q, 2) for p, q in zip(a, b, strict=True)), F.lit(0.0)))


def probe_position(start: Vector, inserted: Column, alpha: Column, beta: Column, across: Column, along: Column, right: Column, middle: float = 35.0) -> Vector:
    """AP, ML and DV (mm) of a site of an implanted probe.

    The probe enters at ``start`` (AP, ML, DV), is ``inserted`` mm deep and leans by ``alpha``
    from the vertical, towards ``beta`` (degrees). ``across`` and ``along`` are the site's place on
    the probe (micrometres), counted from its left edge and its tip. On the right side the lean
    goes outward by the cosine of ``beta`` and backward by its sine; on the left side it goes
    forward by the cosine and inward by the sine. A site beside the ``middle`` line is moved by
    its distance times the root of two, with the sign that its side has.
    """
    a, b = F.radians(alpha), F.radians(beta)
    depth = inserted - along / 1000
    lean = F.sin(a) * depth
    beside = F.when(right, across - middle).otherwise(middle - across) * F.lit(2**0.5 / 1000)
    ap = F.when(right, -lean * F.sin(b)).otherwise(lean * F.cos(b))
    ml = F.when(right, lean * F.cos(b)).otherwise(-lean * F.sin(b))
    return start[0] + ap + beside, start[1] + ml + beside, start[2] - F.cos(a) * depth


def onto_x(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Azimuth and pitch (radians) that turn a direction onto the x axis."""
    return F.atan2(y, x), F.atan2(z, F.sqrt(x * x + y * y))
