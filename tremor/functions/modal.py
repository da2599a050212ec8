"""Column functions of modal analysis; mode shapes are two arrays of doubles, real and imaginary parts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mac(ar: Column, ai: Column, br: Column, bi: Column) -> Column:
    """Modal assurance criterion of two complex shapes."""
    re, im = dot(ar, br) + dot(ai, bi), dot(ai, br) - dot(ar, bi)
    return (re * re + im * im) / ((dot(ar, ar) + dot(ai, ai)) * (dot(br, br) + dot(bi, bi)))


def mpc(re: Column, im: Column) -> Column:
    """Modal phase collinearity: |sum v^2|^2 / (sum |v|^2)^2."""
    a, b, c = dot(re, re) - dot(im, im), 2 * dot(re, im), dot(re, re) + dot(im, im)
    return (a * a + b * b) / (c * c)


def mean_phase(re: Column, im: Column) -> Column:
    """Mean phase in degrees, 0 to 180: direction of the largest principal axis of the points (re, im)."""
    angle = F.degrees(0.5 * F.atan2(2 * dot(re, im), dot(re, re) - dot(im, im)))
    return F.when(angle < 0, angle + 180).otherwise(angle)


def mpd(re: Column, im: Column) -> Column:
    """Mean phase deviation in degrees, weighted by magnitude."""
    phase = F.radians(mean_phase(re, im))
    c, s = F.cos(phase), F.sin(phase)
    size = F.zip_with(re, im, lambda x, y: F.sqrt(x * x + y * y))
    off = F.zip_with(re, im, lambda x, y: F.when(x * x + y * y > 0, F.sqrt(x * x + y * y) * F.acos(F.least(F.lit(1.0), F.abs(x * c + y * s) / F.sqrt(x * x + y * y)))).otherwise(0.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    return F.degrees(total(off) / total(size))


def phase_spread(re: Column, im: Column, about: str, weighted: bool = True) -> tuple[Column, Column]:
    """(mean phase 0 to 180, deviation) in degrees by the spread of the components' phases.

    ``about``: 'ortho' turns the shape by its orthogonal regression line and takes phases from -90 to 90 about their plain mean; 'arithm' takes
    phases folded to 0 to 180 about their mean.  Weights are magnitudes."""
    size = F.zip_with(re, im, lambda x, y: F.sqrt(x * x + y * y))
    weight = size if weighted else F.transform(size, lambda v: F.lit(1.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    mean = lambda a, w: total(F.zip_with(a, w, lambda v, x: v * x)) / total(w)
    if about == "ortho":
        turn = F.atan2(2 * dot(re, im), dot(re, re) - dot(im, im)) / 2
        c, s = F.cos(turn), F.sin(turn)
        phase = F.zip_with(re, im, lambda x, y: F.degrees(F.atan2(y * c - x * s, x * c + y * s)))
        phase = F.transform(phase, lambda p: F.when(p > 90, p - 180).when(p < -90, p + 180).otherwise(p))
        at, centre = F.degrees(turn), total(phase) / F.size(phase)
    elif about == "arithm":
        phase = F.zip_with(re, im, lambda x, y: F.degrees(F.atan2(y, x)))
        phase = F.transform(phase, lambda p: F.when(p < 0, p + 180).otherwise(p))
        at = centre = mean(phase, weight)
    else:
        raise ValueError(f"unknown regression {about!r}")
    away = F.sqrt(mean(F.transform(phase, lambda p: (p - centre) * (p - centre)), weight))
    return F.when(at < 0, at + 180).otherwise(at), away


def frequency(re: Column, im: Column, rate: Column) -> Column:
    """Natural frequency from a discrete eigenvalue."""
    a, b = F.abs(F.atan2(im, re)), 0.5 * F.log(re * re + im * im)
    return rate * F.sqrt(a * a + b * b) / (2 * math.pi)


def damping(re: Column, im: Column) -> Column:
    """Damping ratio in per cent from a discrete eigenvalue."""
    a, b = F.abs(F.atan2(im, re)), 0.5 * F.log(re * re + im * im)
    return 100 * F.abs(b) / F.sqrt(a * a + b * b)


def relative(a: Column, b: Column) -> Column:
    """|a - b| over the larger magnitude."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b))


def direction(azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    """Unit vector of a direction in degrees."""
    az, el = F.radians(azimuth), F.radians(elevation)
    return F.cos(el) * F.cos(az), F.cos(el) * F.sin(az), F.sin(el)


def nearly_equal(a: Column, b: Column, digits: int = 5) -> Column:
    return (a * 10**digits).cast("bigint") == (b * 10**digits).cast("bigint")


def rotated(re: Column, im: Column) -> tuple[Column, Column]:
    """A shape turned so that its largest component is real and positive; its size stays."""
    size = F.transform(F.arrays_zip(re.alias("a"), im.alias("b")), lambda z: z["a"] * z["a"] + z["b"] * z["b"])
    at = F.array_position(size, F.array_max(size)).cast("int")
    a, b = F.element_at(re, at), F.element_at(im, at)
    norm = F.sqrt(a * a + b * b)
    return F.zip_with(re, im, lambda x, y: (x * a + y * b) / norm), F.zip_with(re, im, lambda x, y: (y * a - x * b) / norm)


def as_displacements(re: Column, im: Column, quantity: Column, f: Column) -> tuple[Column, Column]:
    """A shape with components of accelerations and velocities as displacements: a / -w^2, v i / w; ``quantity``: array of their names."""
    w = 2 * math.pi * f
    z = F.arrays_zip(re.alias("a"), im.alias("b"), quantity.alias("q"))
    kind = lambda x, accel, velo, disp: F.when(x["q"] == "accel", accel).when(x["q"] == "velo", velo).otherwise(disp)
    return F.transform(z, lambda x: kind(x, -x["a"] / (w * w), -x["b"] / w, x["a"])), F.transform(z, lambda x: kind(x, -x["b"] / (w * w), x["a"] / w, x["b"]))
