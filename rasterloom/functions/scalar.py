"""Column functions: complex numbers, polynomials, special functions, geodesy, ionosphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A_WGS84, E2_WGS84 = 6378137.0, 0.0066943799901
LIGHT = 299792458.0


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def power(re: Column, im: Column) -> Column:
    return re * re + im * im


def times_conjugate(re1: Column, im1: Column, re2: Column, im2: Column) -> tuple[Column, Column]:
    return re1 * re2 + im1 * im2, im1 * re2 - re1 * im2


def rotated(re: Column, im: Column, angle: Column) -> tuple[Column, Column]:
    """(re, im) times exp(j * angle)."""
    return re * F.cos(angle) - im * F.sin(angle), re * F.sin(angle) + im * F.cos(angle)


def wrapped(angle: Column) -> Column:
    return F.atan2(F.sin(angle), F.cos(angle))


def decibel(x: Column) -> Column:
    return F.when(x > 0, 10 * F.log10(x))


def linear(x: Column) -> Column:
    """The power ratio of x decibels."""
    return F.pow(F.lit(10.0), x / 10)


def snap(x: Column, interval: float) -> Column:
    """The next multiple of interval: upwards, not to the nearest."""
    return F.ceil(x / interval) * interval


def sinc(x: Column) -> Column:
    px = x * math.pi
    return F.when(F.abs(px) < 1e-8, F.lit(1.0)).otherwise(F.sin(px) / px)


def horner(x: Column, coefficients: list[float]) -> Column:
    """c0 + c1 x + c2 x^2 + ..."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + float(c)
    return out


def derivative(coefficients: list[float]) -> list[float]:
    return [i * c for i, c in enumerate(coefficients)][1:] or [0.0]


def poly2d(x: Column, y: Column, coefficients: list[list[float]]) -> Column:
    """Sum of c[i][j] x**i y**j by Horner's rule in both."""
    out = horner(y, coefficients[-1])
    for row in reversed(coefficients[:-1]):
        out = out * x + horner(y, row)
    return out


def tukey(place: Column, n: int, flat: float) -> Column:
    """Window of n samples that is 1 over a share ``flat`` of its middle and falls along a cosine."""
    away, inner = F.abs(place - (n - 1) / 2), flat * n / 2
    return F.when(away <= inner, 1.0).otherwise(0.5 * (1 + F.cos(math.pi * (away - inner) / (n / 2 - inner))))


def cosine_window(place: Column, n: int, a: float) -> Column:
    return a - (1 - a) * F.cos(2 * math.pi * place / (n - 1))


def bartlett(x: Column, half: float) -> Column:
    return F.greatest(1 - F.abs(x) / half, F.lit(0.0))


def parabola(left: Column, middle: Column, right: Column) -> tuple[Column, Column]:
    """Place (from the middle sample) and height of the peak of the parabola through three."""
    bend = left - 2 * middle + right
    return F.try_divide(0.5 * (left - right), bend), middle - F.try_divide(0.125 * (left - right) * (left - right), bend)


def steps(state: Column, step, rounds: int) -> Column:
    """A fixed number of steps on a column, as one expression that does not grow with them."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, lambda x, _: step(x))


def newton(f, slope, start: Column, rounds: int) -> Column:
    return steps(start.cast("double"), lambda x: x - F.coalesce(F.try_divide(f(x), slope(x)), F.lit(0.0)), rounds)


def secant(f, a: Column, b: Column, rounds: int) -> Column:
    def step(s: Column) -> Column:
        fa, fb = f(s["a"]), f(s["b"])
        move = F.coalesce(F.try_divide(fb * (s["b"] - s["a"]), fb - fa), F.lit(0.0))
        return F.struct(s["b"].alias("a"), (s["b"] - move).alias("b"))

    return steps(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")), step, rounds)["b"]


def bisection(f, a: Column, b: Column, rounds: int) -> Column:
    """The root between a and b, where f has different signs."""

    def step(s: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        left = F.signum(f(s["a"])) * F.signum(f(mid)) <= 0
        return F.struct(F.when(left, s["a"]).otherwise(mid).alias("a"), F.when(left, mid).otherwise(s["b"]).alias("b"))

    out = steps(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")), step, rounds)
    return (out["a"] + out["b"]) / 2


def bessel_i0(x: Column, terms: int = 30) -> Column:
    """Power series of the modified Bessel function of order 0; full precision to |x| of about 15."""
    q = x * x / 4
    return horner(q, [1 / math.factorial(k) ** 2 for k in range(terms)])


def next_power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long")


def east_radius(lat: Column) -> Column:
    s = F.sin(lat)
    return A_WGS84 / F.sqrt(1 - E2_WGS84 * s * s)


def north_radius(lat: Column) -> Column:
    s = F.sin(lat)
    return A_WGS84 * (1 - E2_WGS84) / F.pow(1 - E2_WGS84 * s * s, F.lit(1.5))


def to_ecef(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    r = east_radius(lat)
    return (r + height) * F.cos(lat) * F.cos(lon), (r + height) * F.cos(lat) * F.sin(lon), (r * (1 - E2_WGS84) + height) * F.sin(lat)


def to_llh(x: Column, y: Column, z: Column, rounds: int = 5) -> tuple[Column, Column, Column]:
    """Longitude, latitude, height by a fixed number of latitude corrections (below 1e-9 m after five)."""
    p = F.sqrt(x * x + y * y)
    lat = steps(F.atan2(z, p * (1 - E2_WGS84)), lambda lat: F.atan2(z + east_radius(lat) * E2_WGS84 * F.sin(lat), p), rounds)
    return F.atan2(y, x), lat, p * F.cos(lat) + z * F.sin(lat) - A_WGS84 * F.sqrt(1 - E2_WGS84 * F.sin(lat) * F.sin(lat))


def dispersive_pair(low: Column, high: Column, f0: float, fl: float, fh: float) -> tuple[Column, Column]:
    """Dispersive and non-dispersive phase from two sub-bands: the inverse of [[fl/f0, f0/fl], [fh/f0, f0/fh]]."""
    a, b, c, d = f0 / fl, fl / f0, f0 / fh, fh / f0
    det = a * d - b * c
    return (low * d - high * b) / det, (high * a - low * c) / det


def quaternion_product(p: list[Column], q: list[Column]) -> list[Column]:
    a, b, c, d = p
    e, f, g, h = q
    return [a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e]


def rotated_vector(q: list[Column], v: list[Column]) -> list[Column]:
    """v turned by the unit quaternion q: v + 2 w (u x v) + 2 u x (u x v)."""
    w, *u = q
    t = [2 * (u[1] * v[2] - u[2] * v[1]), 2 * (u[2] * v[0] - u[0] * v[2]), 2 * (u[0] * v[1] - u[1] * v[0])]
    return [v[0] + w * t[0] + u[1] * t[2] - u[2] * t[1], v[1] + w * t[1] + u[2] * t[0] - u[0] * t[2], v[2] + w * t[2] + u[0] * t[1] - u[1] * t[0]]


def bistatic_delay(distance: Column) -> Column:
    return 2 * distance / LIGHT


def dry_delay(height: Column, cosine: Column, zenith: float = 2.3, scale: float = 6000.0) -> Column:
    return zenith * F.exp(-height / scale) / cosine
