"""Map projections, local frames, baselines and windows as columns; the radar range equations as vectorised solvers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import A_WGS84, E2_WGS84, bessel_i0

E = math.sqrt(E2_WGS84)


def _isometric(lat: Column) -> Column:
    s = E * F.sin(lat)
    return F.tan(math.pi / 4 - lat / 2) / F.pow((1 - s) / (1 + s), F.lit(E / 2))


def polar_stereographic(lon: Column, lat: Column, lon0: float, true_lat: float) -> tuple[Column, Column]:
    """North polar stereographic map coordinates; scale is true at latitude ``true_lat`` (all in radians)."""
    s = math.sin(true_lat)
    t = math.tan(math.pi / 4 - true_lat / 2) / ((1 - E * s) / (1 + E * s)) ** (E / 2)
    rho = A_WGS84 * math.cos(true_lat) / math.sqrt(1 - E2_WGS84 * s * s) / t * _isometric(lat)
    return rho * F.sin(lon - lon0), -rho * F.cos(lon - lon0)


def equal_area(lon: Column, lat: Column, lon0: float, true_lat: float) -> tuple[Column, Column]:
    """Cylindrical equal-area map coordinates."""
    s = math.sin(true_lat)
    k0 = math.cos(true_lat) / math.sqrt(1 - E2_WGS84 * s * s)
    e = E * F.sin(lat)
    q = (1 - E2_WGS84) * (F.sin(lat) / (1 - e * e) - F.log((1 - e) / (1 + e)) / (2 * E))
    return (lon - lon0) * A_WGS84 * k0, q * (A_WGS84 / (2 * k0))


def transverse_mercator(lon: Column, lat: Column, lon0: float, scale: float = 0.9996, east: float = 500_000.0) -> tuple[Column, Column]:
    """Transverse Mercator by Krüger's series to the third order of the flattening: below a millimetre within a UTM zone."""
    f = 1 - math.sqrt(1 - E2_WGS84)
    n = f / (2 - f)
    radius = A_WGS84 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    c = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(lat)) - c * F.atanh(c * F.sin(lat)))
    xi, eta = F.atan2(t, F.cos(lon - lon0)), F.atanh(F.sin(lon - lon0) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return east + scale * radius * x, scale * radius * y


def east_north_up(lon: Column, lat: Column, v: list[Column]) -> tuple[Column, Column, Column]:
    """The components of an earth-fixed vector to east, north and up."""
    x, y, z = v
    return (
        y * F.cos(lon) - x * F.sin(lon),
        z * F.cos(lat) - F.sin(lat) * (x * F.cos(lon) + y * F.sin(lon)),
        z * F.sin(lat) + F.cos(lat) * (x * F.cos(lon) + y * F.sin(lon)),
    )


def baseline(reference: list[Column], secondary: list[Column], target: list[Column]) -> tuple[Column, Column]:
    """Length along the reference's line of sight to the target, and across it."""
    b = [s - r for s, r in zip(secondary, reference, strict=True)]
    look = [t - r for t, r in zip(target, reference, strict=True)]
    dot = lambda p, q: sum((x * y for x, y in zip(p[1:], q[1:], strict=True)), p[0] * q[0])
    parallel = dot(b, look) / F.sqrt(dot(look, look))
    return parallel, F.sqrt(F.greatest(dot(b, b) - parallel * parallel, F.lit(0.0)))


def kaiser(place: Column, n: int, beta: float) -> Column:
    """Kaiser window of n samples at place 0 .. n - 1."""
    x = 2.0 * place / (n - 1) - 1
    return bessel_i0(beta * F.sqrt(F.greatest(1 - x * x, F.lit(0.0)))) / float(np.i0(beta))


def raised_cosine(place: Column, n: int, pedestal: float) -> Column:
    return 1 - (1 - pedestal) * F.pow(F.sin(math.pi * (place / (n - 1) - 0.5)), F.lit(2.0))


def inside(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether (x, y) lies in a polygon: an odd number of edges crosses the ray to greater x."""
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            cut = x1 + (y - y1) * ((x2 - x1) / (y2 - y1))
            crossed = crossed + (((y >= min(y1, y2)) & (y < max(y1, y2)) & (x < cut))).cast("int")
    return crossed % 2 == 1


def circular_orbit(t: np.ndarray, radius: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and velocities on a polar circular orbit."""
    c, s = np.cos(rate * t), np.sin(rate * t)
    zero = np.zeros_like(t)
    return radius * np.stack([c, zero, s], -1), radius * rate * np.stack([-s, zero, c], -1)


def geo2rdr(target: np.ndarray, radius: float, rate: float, rounds: int = 25, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Zero-Doppler time and slant range of targets (n, 3), by Newton steps on all rows at once; nan where it fails."""
    t = np.arctan2(target[:, 2], target[:, 0]) / rate + 0.3
    for _ in range(rounds):
        p, v = circular_orbit(t, radius, rate)
        look = target - p
        step = (look * v).sum(1) / ((v * v).sum(1) + rate * rate * (look * p).sum(1))
        t = t + step
        if np.abs(step).max(initial=0.0) < tolerance:
            break
    p, v = circular_orbit(t, radius, rate)
    look = target - p
    bad = np.abs((look * v).sum(1)) > 1e-3 * np.sqrt((look * look).sum(1))
    return np.where(bad, np.nan, t), np.where(bad, np.nan, np.sqrt((look * look).sum(1)))


def rdr2geo(t: np.ndarray, slant: np.ndarray, height: np.ndarray, right: bool, radius: float, rate: float, rounds: int = 30) -> np.ndarray:
    """Targets (n, 3) at zero Doppler, a slant range and an ellipsoidal height, looking right or left of the track."""
    p, v = circular_orbit(t, radius, rate)
    up = p / radius
    along = v / np.sqrt((v * v).sum(1, keepdims=True))
    side = np.cross(along, up) * (1 if right else -1)
    ground = np.full(len(t), A_WGS84) + height
    b = A_WGS84 * math.sqrt(1 - E2_WGS84)
    for _ in range(rounds):
        cosine = np.clip((radius**2 + slant**2 - ground**2) / (2 * radius * slant), -1, 1)
        sine = np.sqrt(1 - cosine**2)
        out = p + slant[:, None] * (side * sine[:, None] - up * cosine[:, None])
        r = np.sqrt((out * out).sum(1))
        lat = np.arctan2(out[:, 2], np.hypot(out[:, 0], out[:, 1]) * (1 - E2_WGS84))
        for _ in range(5):
            n = A_WGS84 / np.sqrt(1 - E2_WGS84 * np.sin(lat) ** 2)
            lat = np.arctan2(out[:, 2] + n * E2_WGS84 * np.sin(lat), np.hypot(out[:, 0], out[:, 1]))
        h = np.hypot(out[:, 0], out[:, 1]) * np.cos(lat) + out[:, 2] * np.sin(lat) - A_WGS84 * np.sqrt(1 - E2_WGS84 * np.sin(lat) ** 2)
        ground = np.maximum(r + height - h, b / 2)
    return out
