"""Vectors, rotations, local and antenna frames, peg coordinates, viewing angles and inverse projections as columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import E, east_north_up, equal_area, polar_stereographic, transverse_mercator
from .scalar import A_WGS84, E2_WGS84, LIGHT, east_radius, north_radius, steps, to_ecef, to_llh

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    n = norm(a)
    return a[0] / n, a[1] / n, a[2] / n


def plus(a: Vector, b: Vector, k: Column | float = 1.0) -> Vector:
    return a[0] + b[0] * k, a[1] + b[1] * k, a[2] + b[2] * k


def through(matrix: list[list[Column]], v: Vector) -> Vector:
    return tuple(dot(tuple(row), v) for row in matrix)  # type: ignore[return-value]


def plane(a: Vector, b: Vector, c: Vector) -> Vector:
    """The unit normal of the plane through three points."""
    return unit(cross(plus(b, a, -1.0), plus(c, a, -1.0)))


def from_axis(angle: Column, axis: Vector) -> list[Column]:
    """The unit quaternion that turns by an angle about an axis."""
    u = unit(axis)
    return [F.cos(angle / 2), *(F.sin(angle / 2) * x for x in u)]


def slerp(p: list[Column], q: list[Column], t: Column) -> list[Column]:
    """The turn at share t on the shorter way from unit quaternion p to q; nearly equal ones are mixed linearly."""
    d = sum((a * b for a, b in zip(p[1:], q[1:], strict=True)), p[0] * q[0])
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(d), F.lit(1.0)))
    close = angle < 1e-6
    a = F.when(close, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * angle), F.sin(angle)))
    b = F.when(close, t).otherwise(F.try_divide(F.sin(t * angle), F.sin(angle))) * sign
    mixed = [a * x + b * y for x, y in zip(p, q, strict=True)]
    n = F.sqrt(sum((x * x for x in mixed[1:]), mixed[0] * mixed[0]))
    return [x / n for x in mixed]


def from_euler(yaw: Column, pitch: Column, roll: Column) -> list[Column]:
    """The quaternion of a turn by yaw about z, then pitch about the new y, then roll about the new x."""
    cy, sy, cp, sp, cr, sr = F.cos(yaw / 2), F.sin(yaw / 2), F.cos(pitch / 2), F.sin(pitch / 2), F.cos(roll / 2), F.sin(roll / 2)
    return [cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy]


def to_euler(q: list[Column]) -> tuple[Column, Column, Column]:
    """Yaw, pitch and roll of a unit quaternion."""
    w, x, y, z = q
    pitch = F.asin(F.least(F.greatest(2 * (w * y - z * x), F.lit(-1.0)), F.lit(1.0)))
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)), pitch, F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))


def heading(lon: Column, lat: Column, v: Vector) -> Column:
    """Direction of travel from north, to the east."""
    east, north, _ = east_north_up(lon, lat, list(v))
    return F.atan2(east, north)


def north_east_down(lon: Column, lat: Column, v: Vector) -> Vector:
    e, n, u = east_north_up(lon, lat, list(v))
    return n, e, -u


def north_west_up(lon: Column, lat: Column, v: Vector) -> Vector:
    e, n, u = east_north_up(lon, lat, list(v))
    return n, -e, u


def track_cross_nadir(p: Vector, v: Vector) -> tuple[Vector, Vector, Vector]:
    """Unit vectors along track, across it, and to the centre of the earth."""
    nadir = tuple(-x for x in unit(p))
    across = unit(cross(nadir, v))
    return unit(cross(across, nadir)), across, nadir  # type: ignore[arg-type,return-value]


def normal(lon: Column, lat: Column) -> Vector:
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def directed_radius(heading: Column, lat: Column) -> Column:
    """Radius of curvature of the ellipsoid in a direction (Euler)."""
    e, n = east_radius(lat), north_radius(lat)
    return e * n / (e * F.cos(heading) * F.cos(heading) + n * F.sin(heading) * F.sin(heading))


def on_ellipse(lon: Column, lat: Column) -> Vector:
    return to_ecef(lon, lat, F.lit(0.0))


def viewing_angles(p: Vector, v: Vector, look: Vector) -> tuple[Column, Column]:
    """Azimuth (from the track, to the left) and look angle (from the ellipsoid's downward normal) of a line of sight."""
    lon, lat, _ = to_llh(*p)
    n = normal(lon, lat)
    left = unit(cross(n, v))
    ahead = unit(cross(left, n))
    return F.atan2(dot(left, look), dot(ahead, look)), F.acos(-dot(n, look) / norm(look))


def incidence(lon: Column, lat: Column, to_platform: Vector) -> Column:
    """Angle between the ellipsoid's normal at a target and the way to the platform."""
    return F.acos(dot(normal(lon, lat), to_platform) / norm(to_platform))


def look_from_range(slant: Column, platform: Column, ground: Column) -> tuple[Column, Column]:
    """Look and incidence angle on a sphere: distances of platform and ground from its centre, and the range between them."""
    look = F.acos((slant * slant + platform * platform - ground * ground) / (2 * slant * platform))
    inc = math.pi - F.acos((slant * slant + ground * ground - platform * platform) / (2 * slant * ground))
    return look, inc


def range_along(p: Vector, look: Vector) -> Column:
    """Distance to the ellipsoid along a line of sight; null where it misses."""
    d = unit(look)
    a2, b2 = A_WGS84**2, A_WGS84**2 * (1 - E2_WGS84)
    a = (d[0] * d[0] + d[1] * d[1]) / a2 + d[2] * d[2] / b2
    b = (d[0] * p[0] + d[1] * p[1]) / a2 + d[2] * p[2] / b2
    c = (p[0] * p[0] + p[1] * p[1]) / a2 + p[2] * p[2] / b2 - 1
    root = b * b - a * c
    out = -(b + F.sqrt(F.when(root >= 0, root))) / a
    return F.when(out > 0, out)


def doppler_of(look: Vector, v: Vector, wavelength: float) -> Column:
    return 2 / wavelength * dot(v, look) / norm(look)


#: Angles of an antenna frame to a unit vector and back, by kind of grid.
def antenna_vector(kind: str, el: Column, az: Column) -> Vector:
    if kind == "el_and_az":
        angle, turn = F.sqrt(el * el + az * az), F.atan2(az, el)
        return F.sin(angle) * F.cos(turn), F.sin(angle) * F.sin(turn), F.cos(angle)
    if kind == "el_over_az":
        return F.sin(el) * F.cos(az), F.sin(az), F.cos(el) * F.cos(az)
    if kind == "az_over_el":
        return F.sin(el), F.cos(el) * F.sin(az), F.cos(el) * F.cos(az)
    if kind == "theta_phi":
        return F.sin(el) * F.cos(az), F.sin(el) * F.sin(az), F.cos(el)
    raise ValueError(f"no such grid: {kind}")


def antenna_angles(kind: str, v: Vector) -> tuple[Column, Column]:
    x, y, z = unit(v)
    bounded = lambda c: F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))
    if kind == "el_and_az":
        angle, turn = F.acos(bounded(z)), F.atan2(y, x)
        return angle * F.cos(turn), angle * F.sin(turn)
    if kind == "el_over_az":
        return F.atan2(x, z), F.asin(bounded(y))
    if kind == "az_over_el":
        return F.asin(bounded(x)), F.atan2(y, z)
    if kind == "theta_phi":
        return F.acos(bounded(z)), F.atan2(y, x)
    raise ValueError(f"no such grid: {kind}")


def _turned(q: list[Column], v: Vector, back: bool = False) -> Vector:
    from .scalar import rotated_vector

    q = [q[0], *(-x for x in q[1:])] if back else q
    return tuple(rotated_vector(q, list(v)))  # type: ignore[return-value]


def antenna_to_ground(kind: str, el: Column, az: Column, p: Vector, q: list[Column]) -> tuple[Vector, Column]:
    """Where an antenna direction meets the ellipsoid from a platform with attitude q (antenna to earth), and how far."""
    look = _turned(q, antenna_vector(kind, el, az))
    r = range_along(p, look)
    return plus(p, look, r), r


def ground_to_antenna(kind: str, target: Vector, p: Vector, q: list[Column]) -> tuple[Column, Column]:
    return antenna_angles(kind, _turned(q, plus(target, p, -1.0), back=True))


def antenna_range_doppler(kind: str, el: Column, az: Column, p: Vector, v: Vector, q: list[Column], wavelength: float) -> tuple[Column, Column]:
    look = _turned(q, antenna_vector(kind, el, az))
    return range_along(p, look), doppler_of(look, v, wavelength)


def sphere_xyz(r: Column, az: Column, p: Vector, q: list[Column], radius: Column) -> Vector:
    """The point at range r and antenna azimuth az on a sphere of a radius, below a platform with attitude q; azimuth over elevation."""
    look, _ = look_from_range(r, norm(p), radius)
    nadir = tuple(-x for x in unit(p))
    down = _turned(q, nadir, back=True)  # type: ignore[arg-type]
    # elevation at which the look angle from nadir holds, for the given azimuth: one turn of the plane
    a = F.sqrt(down[0] * down[0] + (down[1] * F.sin(az) + down[2] * F.cos(az)) ** 2)
    phase = F.atan2(down[0], down[1] * F.sin(az) + down[2] * F.cos(az))
    el = phase + F.acos(F.least(F.cos(look) / a, F.lit(1.0)))
    return plus(p, _turned(q, antenna_vector("az_over_el", el, az)), r)


class Peg:
    """Along-track, cross-track and height (s, c, h) about a peg point with a heading, on the sphere that fits the ellipsoid there."""

    def __init__(self, lon: float, lat: float, heading: float):
        co, so, cl, sl, ch, sh = math.cos(lon), math.sin(lon), math.cos(lat), math.sin(lat), math.cos(heading), math.sin(heading)
        up = (cl * co, cl * so, sl)
        east, north = (-so, co, 0.0), (-sl * co, -sl * so, cl)
        ahead = tuple(sh * e + ch * n for e, n in zip(east, north, strict=True))
        left = tuple(-ch * e + sh * n for e, n in zip(east, north, strict=True))
        self.axes = (up, ahead, left)
        n = A_WGS84 / math.sqrt(1 - E2_WGS84 * sl * sl)
        m = A_WGS84 * (1 - E2_WGS84) / (1 - E2_WGS84 * sl * sl) ** 1.5
        self.radius = n * m / (n * ch * ch + m * sh * sh)
        ground = (n * cl * co, n * cl * so, n * (1 - E2_WGS84) * sl)
        self.centre = tuple(g - self.radius * u for g, u in zip(ground, up, strict=True))

    def to_xyz(self, s: Column, c: Column, h: Column) -> Vector:
        a, b, r = s / self.radius, c / self.radius, self.radius + h
        local = (r * F.cos(b) * F.cos(a), r * F.cos(b) * F.sin(a), r * F.sin(b))
        return tuple(self.centre[i] + sum((local[k] * self.axes[k][i] for k in (1, 2)), local[0] * self.axes[0][i]) for i in range(3))  # type: ignore[return-value]

    def to_sch(self, x: Column, y: Column, z: Column) -> Vector:
        v = x - self.centre[0], y - self.centre[1], z - self.centre[2]
        u, a, b = (v[0] * k[0] + v[1] * k[1] + v[2] * k[2] for k in self.axes)
        r = F.sqrt(u * u + a * a + b * b)
        return self.radius * F.atan2(a, u), self.radius * F.asin(b / r), r - self.radius


def from_polar(x: Column, y: Column, lon0: float, true_lat: float, rounds: int = 8) -> tuple[Column, Column]:
    """Longitude and latitude of north polar stereographic coordinates, by a fixed number of steps."""
    s = math.sin(true_lat)
    t0 = math.tan(math.pi / 4 - true_lat / 2) / ((1 - E * s) / (1 + E * s)) ** (E / 2)
    t = F.hypot(x, y) * t0 * math.sqrt(1 - E2_WGS84 * s * s) / (A_WGS84 * math.cos(true_lat))

    def step(lat: Column) -> Column:
        return math.pi / 2 - 2 * F.atan(t * F.pow((1 - E * F.sin(lat)) / (1 + E * F.sin(lat)), F.lit(E / 2)))

    return lon0 + F.atan2(x, -y), steps(math.pi / 2 - 2 * F.atan(t), step, rounds)


def from_equal_area(x: Column, y: Column, lon0: float, true_lat: float, rounds: int = 8) -> tuple[Column, Column]:
    """Longitude and latitude of cylindrical equal-area coordinates, by Newton's steps on the authalic function."""
    s = math.sin(true_lat)
    k0 = math.cos(true_lat) / math.sqrt(1 - E2_WGS84 * s * s)
    q = 2 * k0 * y / A_WGS84

    def step(lat: Column) -> Column:
        n = F.sin(lat)
        w = 1 - E2_WGS84 * n * n
        return lat + w * w / (2 * F.cos(lat)) * (q / (1 - E2_WGS84) - n / w + F.log((1 - E * n) / (1 + E * n)) / (2 * E))

    return lon0 + x / (A_WGS84 * k0), steps(F.asin(F.least(F.greatest(q / 2, F.lit(-1.0)), F.lit(1.0))), step, rounds)


def from_transverse_mercator(x: Column, y: Column, lon0: float, scale: float = 0.9996, east: float = 500_000.0, rounds: int = 5) -> tuple[Column, Column]:
    """Longitude and latitude of transverse Mercator coordinates: the series turned about step by step, then the latitude from the conformal one."""
    f = 1 - math.sqrt(1 - E2_WGS84)
    n = f / (2 - f)
    radius = A_WGS84 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    u, v = y / (scale * radius), (x - east) / (scale * radius)

    def step(s: Column) -> Column:
        a, b = u, v
        for j, k in enumerate(alpha, 1):
            a = a - k * F.sin(2 * j * s["xi"]) * F.cosh(2 * j * s["eta"])
            b = b - k * F.cos(2 * j * s["xi"]) * F.sinh(2 * j * s["eta"])
        return F.struct(a.alias("xi"), b.alias("eta"))

    s = steps(F.struct(u.alias("xi"), v.alias("eta")), step, rounds)
    sine = F.sin(s["xi"]) / F.cosh(s["eta"])
    lat = steps(F.asin(sine), lambda lat: F.asin(F.tanh(F.atanh(sine) + E * F.atanh(E * F.sin(lat)))), 6)
    return lon0 + F.atan2(F.sinh(s["eta"]), F.cos(s["xi"])), lat


def projection(epsg: int) -> tuple[Callable[[Column, Column], tuple[Column, Column]], Callable[[Column, Column], tuple[Column, Column]]]:
    """Forward and inverse functions (radians to map units and back) of a code: longitude and latitude in degrees, UTM, polar stereographic, equal-area."""
    if epsg == 4326:
        return (lambda lon, lat: (F.degrees(lon), F.degrees(lat))), (lambda x, y: (F.radians(x), F.radians(y)))
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        south, zone = epsg > 32700, epsg % 100
        lon0 = math.radians(6 * zone - 183)
        shift = 10_000_000.0 if south else 0.0

        def ahead(lon: Column, lat: Column) -> tuple[Column, Column]:
            x, y = transverse_mercator(lon, lat, lon0)
            return x, y + shift

        return ahead, lambda x, y: from_transverse_mercator(x, y - shift, lon0)
    if epsg in (3413, 3995):
        lon0, lat0 = (math.radians(-45), math.radians(70)) if epsg == 3413 else (0.0, math.radians(71))
        return (lambda lon, lat: polar_stereographic(lon, lat, lon0, lat0)), (lambda x, y: from_polar(x, y, lon0, lat0))
    if epsg == 3031:

        def south_ahead(lon: Column, lat: Column) -> tuple[Column, Column]:
            x, y = polar_stereographic(lon, -lat, 0.0, math.radians(71))
            return x, -y

        def south_back(x: Column, y: Column) -> tuple[Column, Column]:
            lon, lat = from_polar(x, -y, 0.0, math.radians(71))
            return lon, -lat

        return south_ahead, south_back
    if epsg == 6933:
        return (lambda lon, lat: equal_area(lon, lat, 0.0, math.radians(30))), (lambda x, y: from_equal_area(x, y, 0.0, math.radians(30)))
    raise ValueError(f"no projection of code {epsg}")


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates of one code in another: back to longitude and latitude, and forth."""
    return projection(target)[0](*projection(source)[1](x, y))


def code_of(lon: Column, lat: Column) -> Column:
    """The code of the projection for a place in degrees: polar from 75 degrees on, else UTM by zone."""
    east = F.when(lon >= 180, lon - 360).otherwise(lon)
    zone = F.rint((east + 177) / 6).cast("int")
    return F.when(lat >= 75, 3413).when(lat <= -75, 3031).when(lat > 0, 32601 + zone).otherwise(32701 + zone)


def margin_degrees(kilometres: float, lat: Column) -> tuple[Column, Column]:
    """A margin in degrees of latitude and of longitude at a latitude in degrees, on a degree of 111 km."""
    step = F.lit(kilometres / 111.0)
    return step, step / F.cos(F.radians(lat))


def across_dateline(west: Column, east: Column) -> Column:
    """Boxes (west, east) in degrees that do not cross 180 degrees: the box itself, or its two parts; a crossing box spans over 180 degrees as given."""
    box = lambda a, b: F.struct(a.alias("west"), b.alias("east"))
    return F.when(east - west > 180, F.array(box(east, F.lit(180.0)), box(F.lit(-180.0), west))).otherwise(F.array(box(west, east)))


def trihedral_rcs(side: Column, elevation: Column, azimuth: Column, wavelength: float) -> Column:
    """Radar cross-section of a triangular trihedral for a direction in its own frame: elevation from its base, azimuth from one wall."""
    p = F.array_sort(F.array(F.sin(elevation), F.cos(elevation) * F.cos(azimuth), F.cos(elevation) * F.sin(azimuth)))
    a, b, c = (F.get(p, F.lit(i)) for i in range(3))
    lit = a + b > c
    area = F.when(lit, a + b + c - 2 / F.nullif(a + b + c, F.lit(0.0))).otherwise(4 * a * b / (a + b + c))
    return 4 * math.pi * F.pow(side, F.lit(4)) / wavelength**2 * area * area


def ground_spacing(spacing: float, incidence: Column) -> Column:
    return spacing / F.sin(incidence)


def ground_speed(v: Column, platform: Column, ground: Column) -> Column:
    return v * ground / platform


def aperture_time(wavelength: float, slant: Column, resolution: float, v: Column, ground_v: Column) -> Column:
    """How long a target must be seen for an azimuth resolution."""
    return wavelength * slant / (2 * resolution) * 1.0 / F.sqrt(v * ground_v)


def two_way(distance: Column) -> Column:
    return 2 * distance / LIGHT
