"""Geometry and lattice arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def squared_distance(a, b) -> Column:
    """Sum of squared differences of two equally long coordinate lists, as doubles: squares of whole numbers overflow."""
    total = None
    for p, q in zip(a, b):
        d = _c(p).cast("double") - _c(q).cast("double")
        total = d * d if total is None else total + d * d
    return total


def distance(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def compass_angle(root_x, root_y, base_x, base_y) -> Column:
    """Degrees between the base-to-root direction in xy and (0,1); mirrored when x > 0."""
    dx, dy = _c(root_x) - _c(base_x), _c(root_y) - _c(base_y)
    norm = F.sqrt(dx * dx + dy * dy)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dy / F.nullif(norm, F.lit(0.0))))
    theta = F.degrees(F.acos(cosine))
    return F.when(dx > 0, 360.0 - theta).otherwise(theta)


def direction_angle(u, v) -> Column:
    """Degrees between two unit vectors given as coordinate lists."""
    dot = None
    for p, q in zip(u, v):
        dot = _c(p) * _c(q) if dot is None else dot + _c(p) * _c(q)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def direction_code(i, j, k) -> Column:
    """Code 0..26 of a neighbour offset with components -1, 0, 1; 13 is the voxel itself."""
    return (9 * (_c(k) + 1) + 3 * (_c(j) + 1) + (_c(i) + 1)).cast("int")


def code_to_offset(code) -> tuple[Column, Column, Column]:
    c = _c(code)
    return (
        (F.pmod(c, F.lit(3)) - 1).cast("int"),
        (F.pmod(F.floor(c / 3), F.lit(3)) - 1).cast("int"),
        (F.floor(c / 9) - 1).cast("int"),
    )


def linear_index(x, y, z, nx, ny) -> Column:
    """Position in x-fastest order."""
    row = _c(nx).cast("bigint")
    return _c(x).cast("bigint") + _c(y) * row + _c(z) * row * _c(ny)


def index_to_xyz(index, nx, ny) -> tuple[Column, Column, Column]:
    i, plane = _c(index), _c(nx) * _c(ny)
    z = F.floor(i / plane)
    rest = i - z * plane
    return (rest % _c(nx)).cast("int"), F.floor(rest / _c(nx)).cast("int"), z.cast("int")


def nearest_voxel(pos, dim) -> Column:
    """Index of the voxel centre next to a fractional index, kept inside the lattice."""
    base = F.floor(_c(pos))
    return F.when((_c(pos) - base > 0.5) & (base < _c(dim) - 1), base + 1).otherwise(base).cast("int")


def world_to_index(pos, low, voxel) -> Column:
    return (_c(pos) - _c(low)) / _c(voxel)


def in_ellipsoid(p, centre, widths) -> Column:
    """Whether a point lies in an axis-parallel ellipsoid; widths below 1e-5 are an error."""
    total, bad = None, None
    for a, b, w in zip(p, centre, widths):
        term = (_c(a) - _c(b)) / _c(w)
        total = term * term if total is None else total + term * term
        bad = (_c(w) < 1e-5) if bad is None else bad | (_c(w) < 1e-5)
    return F.when(bad, F.raise_error(F.lit("ellipsoid width below 1e-5")).cast("boolean")).otherwise(total <= 1)


def gaussian2d(x, y, mean_x, mean_y, sigma_x, sigma_y, peak) -> Column:
    u = (_c(x) - _c(mean_x)) / _c(sigma_x)
    v = (_c(y) - _c(mean_y)) / _c(sigma_y)
    return _c(peak) * F.exp(-0.5 * (u * u + v * v))


def traversal_cost(length, a, b, weight=100.0, power=1.0, top=255.0) -> Column:
    """Cost of stepping between two voxels: bright pairs are cheap, dark pairs dear."""
    mean = 0.5 * (F.least(F.lit(float(top)), _c(a)) + F.least(F.lit(float(top)), _c(b)))
    ratio = F.lit(float(weight)) / (1e-4 + mean)
    return _c(length) + (ratio if power == 1.0 else F.pow(ratio, F.lit(float(power))))


def flood_priority(value, dist, mode: str) -> Column:
    """Priority of a flood front: plain value, value damped by distance, or distance only."""
    v, d = _c(value), _c(dist)
    if mode == "value":
        return v
    if mode == "value_over_distance":
        return v / (d + 1)
    if mode == "distance":
        return F.lit(1.0) / (d + 1)
    raise ValueError(f"unknown priority mode {mode}")


def time_colour(t, min_t, max_t) -> tuple[Column, Column, Column]:
    """White-to-red ramp over the time range; a single step is plain red."""
    span = _c(max_t) - _c(min_t)
    g = F.when(span > 0, (_c(t) - _c(min_t)) / span).otherwise(F.lit(1.0))
    return F.lit(1.0), 1.0 - g, 1.0 - g


def window_radius(radius, voxel) -> Column:
    """A world radius in whole voxels, rounded half up."""
    return F.floor(_c(radius) / _c(voxel) + 0.5).cast("int")


def slice_channel(z, step) -> Column:
    """Channel a slice of an interleaved stack belongs to: the s with (z+s) % step = 0."""
    return F.pmod(-_c(z), _c(step)).cast("int")


def clamp(value, low, high) -> Column:
    return F.greatest(_c(low), F.least(_c(high), _c(value)))


def radial_samples(directions: int = 20, radii: int = 12, spacing: float = 0.1) -> Column:
    """Array of planar sample offsets: the centre and ``directions`` rays of ``radii`` points."""
    ray = F.transform(
        F.sequence(F.lit(0), F.lit(directions * radii - 1)),
        lambda i: F.struct(
            ((i % radii + 1) * spacing * F.cos(F.floor(i / radii) * (2 * math.pi / directions))).alias("u"),
            ((i % radii + 1) * spacing * F.sin(F.floor(i / radii) * (2 * math.pi / directions))).alias("v"),
        ),
    )
    centre = F.array(F.struct(F.lit(0.0).alias("u"), F.lit(0.0).alias("v")))
    return F.concat(centre, ray)


def plane_basis(nx, ny, nz) -> tuple[list[Column], list[Column]]:
    """Two unit vectors spanning the plane normal to a unit vector.

    The z axis is projected into the plane; when it is parallel to the normal, the x axis is.
    """
    n = [_c(nx), _c(ny), _c(nz)]
    flat = F.abs(n[2]) > 1 - 1e-6
    axis = [F.when(flat, 1.0).otherwise(0.0), F.lit(0.0), F.when(flat, 0.0).otherwise(1.0)]
    dot = axis[0] * n[0] + axis[1] * n[1] + axis[2] * n[2]
    raw = [a - dot * b for a, b in zip(axis, n)]
    size = F.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2])
    u = [r / size for r in raw]
    v = [n[1] * u[2] - n[2] * u[1], n[2] * u[0] - n[0] * u[2], n[0] * u[1] - n[1] * u[0]]
    return u, v
