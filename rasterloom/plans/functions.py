"""Queries of scalar functions: frames, angles, projections, ionosphere, dates, names and arrays, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import atmosphere as A
from ..functions import frames as V
from ..functions import scalar as S
from ..functions import text as T
from ..sources.rasters import table
from .imaging import _SIGHT, _sight
from .raster import _GEO, IMAGE, REAL, R, image, places, query, real
from .samples import D

A0, E2 = 6378137.0, 0.0066943799901


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(16)))


_VEC = "WITH v AS (SELECT vec_id AS id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS v{i}" for i in range(16)) + " FROM embeddings)"


@query(f"{_VEC} SELECT id, {R('v0*v3 + v1*v4 + v2*v5', 'dot')}, {R('v1*v5 - v2*v4', 'cx')}, {R('v2*v3 - v0*v5', 'cy')}, {R('v0*v4 - v1*v3', 'cz')}, {R('sqrt(v0*v0 + v1*v1 + v2*v2)', 'norm')}, {R('v0*v3 + v1*v4 + v2*v5', 'm0')}, {R('v6*v3 + v7*v4 + v8*v5', 'm1')}, {R('((v4-v1)*(v8-v2) - (v5-v2)*(v7-v1)) / sqrt(pow((v4-v1)*(v8-v2) - (v5-v2)*(v7-v1), 2) + pow((v5-v2)*(v6-v0) - (v3-v0)*(v8-v2), 2) + pow((v3-v0)*(v7-v1) - (v4-v1)*(v6-v0), 2))', 'px')} FROM v")
def vector_algebra(spark, sf_dir):
    c = [F.col(f"v{i}") for i in range(9)]
    a, b, d = tuple(c[:3]), tuple(c[3:6]), tuple(c[6:9])
    x = V.cross(a, b)
    m = V.through([list(a), list(d), list(d)], b)
    return _vectors(spark, sf_dir).select("id", V.dot(a, b).alias("dot"), x[0].alias("cx"), x[1].alias("cy"), x[2].alias("cz"), V.norm(a).alias("norm"), m[0].alias("m0"), m[1].alias("m1"), V.plane(a, b, d)[0].alias("px"))


_NQ = "sqrt(v0*v0 + v1*v1 + v2*v2 + v3*v3)"
_NP = "sqrt(v4*v4 + v5*v5 + v6*v6 + v7*v7)"


@query(
    f"{_VEC}, q AS (SELECT id, v0 / {_NQ} AS a, v1 / {_NQ} AS b, v2 / {_NQ} AS c, v3 / {_NQ} AS d, v4 / {_NP} AS e, v5 / {_NP} AS f, v6 / {_NP} AS g, v7 / {_NP} AS h, v8, v9, v10 FROM v), s AS (SELECT *, abs(a*e + b*f + c*g + d*h) AS k, CASE WHEN a*e + b*f + c*g + d*h < 0 THEN -1 ELSE 1 END AS sg FROM q) "
    f"SELECT id, {R('(1 - 2*(c*c + d*d)) * v8 + 2*(b*c - a*d) * v9 + 2*(b*d + a*c) * v10', 'x')}, {R('2*(b*c + a*d) * v8 + (1 - 2*(b*b + d*d)) * v9 + 2*(c*d - a*b) * v10', 'y')}, {R('(sin(0.7 * acos(k)) * a + sin(0.3 * acos(k)) * sg * e) / sin(acos(k))', 'slerp')}, {R('v11', 'yaw')}, {R('v12', 'pitch')}, {R('v13', 'roll')} FROM s JOIN (SELECT id, v11 / 3 AS v11, v12 / 4 AS v12, v13 / 3 AS v13 FROM v) USING (id)"
)
def quaternions(spark, sf_dir):
    """A vector turned, a turn between two, and Euler angles there and back."""
    n = lambda i: F.sqrt(sum((F.col(f"v{j}") * F.col(f"v{j}") for j in range(i + 1, i + 4)), F.col(f"v{i}") * F.col(f"v{i}")))
    p, q = [F.col(f"v{i}") / n(0) for i in range(4)], [F.col(f"v{i}") / n(4) for i in range(4, 8)]
    x = S.rotated_vector(p, [F.col("v8"), F.col("v9"), F.col("v10")])
    angles = V.to_euler(V.from_euler(F.col("v11") / 3, F.col("v12") / 4, F.col("v13") / 3))
    return _vectors(spark, sf_dir).select("id", x[0].alias("x"), x[1].alias("y"), V.slerp(p, q, F.lit(0.3))[0].alias("slerp"), *(a.alias(k) for a, k in zip(angles, ("yaw", "pitch", "roll"), strict=True)))


@query(
    f"{_SIGHT} SELECT id, {R('atan2(dy * cos(lon) - dx * sin(lon), dz * cos(lat) - sin(lat) * (dx * cos(lon) + dy * sin(lon)))', 'heading')}, {R('-(dz * sin(lat) + cos(lat) * (dx * cos(lon) + dy * sin(lon))) / far', 'down')}, {R('-(dy * cos(lon) - dx * sin(lon)) / far', 'west')}, {R('acos((dx * cos(lat) * cos(lon) + dy * cos(lat) * sin(lon) + dz * sin(lat)) / far)', 'incidence')}, {R('2 / 0.24 * (100 * dx - 50 * dy + 7000 * dz) / far', 'doppler')} FROM d"
)
def local_frames(spark, sf_dir):
    d = tuple(F.col(f"s{c}") - F.col(c) for c in "xyz")
    u = V.unit(d)
    lon, lat = F.col("lon"), F.col("lat")
    v = F.lit(100.0), F.lit(-50.0), F.lit(7000.0)
    return _sight(spark, sf_dir).select("id", V.heading(lon, lat, d).alias("heading"), V.north_east_down(lon, lat, u)[2].alias("down"), V.north_west_up(lon, lat, u)[1].alias("west"), V.incidence(lon, lat, d).alias("incidence"), V.doppler_of(d, v, 0.24).alias("doppler"))


@query(
    f"WITH g AS ({_GEO}), n AS (SELECT *, {A0} / sqrt(1 - {E2} * sin(lat) ** 2) AS e, {A0} * (1 - {E2}) / pow(1 - {E2} * sin(lat) ** 2, 1.5) AS m FROM g) SELECT id, round(e, 3) + 0.0 AS east, round(m, 3) + 0.0 AS north, round(1 / (cos(0.7) ** 2 / m + sin(0.7) ** 2 / e), 3) + 0.0 AS directed, round(e * (1 - {E2}) * sin(lat), 3) + 0.0 AS z FROM n", 3
)
def ellipsoid_radii(spark, sf_dir):
    lon, lat = F.col("lon"), F.col("lat")
    return places(spark, sf_dir).select("id", S.east_radius(lat).alias("east"), S.north_radius(lat).alias("north"), V.directed_radius(F.lit(0.7), lat).alias("directed"), V.on_ellipse(lon, lat)[2].alias("z"))


@query(
    f"{_SIGHT}, u AS (SELECT *, lon + 0.05 AS sl, (sx * sx + sy * sy + sz * sz) ** 0.5 AS r FROM d), t AS (SELECT *, -sin(sl) AS ax, cos(sl) AS ay FROM u) SELECT id, {R('sy / r * 7000 - sz / r * -50', 'kx')}, round(acos((far * far + r * r - rg * rg) / (2 * far * r)), 6) + 0.0 AS look, round(pi() - acos((far * far + rg * rg - r * r) / (2 * far * rg)), 6) + 0.0 AS incidence FROM (SELECT *, sqrt(x*x + y*y + z*z) AS rg FROM t)"
)
def sphere_angles(spark, sf_dir):
    """The cross product of platform and velocity as the frame of track, cross and nadir has it, and angles from ranges."""
    p = F.col("sx"), F.col("sy"), F.col("sz")
    ground = V.norm((F.col("x"), F.col("y"), F.col("z")))
    far = V.norm(tuple(F.col(f"s{c}") - F.col(c) for c in "xyz"))
    look, inc = V.look_from_range(far, V.norm(p), ground)
    side = V.cross(V.unit(p), (F.lit(100.0), F.lit(-50.0), F.lit(7000.0)))
    return _sight(spark, sf_dir).select("id", side[0].alias("kx"), look.alias("look"), inc.alias("incidence"))


@query(f"{_SIGHT} SELECT id, CAST(0 AS DOUBLE) AS along, CAST(1 AS DOUBLE) AS nadir, CAST(0 AS DOUBLE) AS skew, round(far, 2) + 0.0 AS reach FROM d", 2)
def track_frame(spark, sf_dir):
    """Track, cross and nadir are at right angles; the ellipsoid's range along a line of sight to a place on it is the distance."""
    p = F.col("sx"), F.col("sy"), F.col("sz")
    t, c, n = V.track_cross_nadir(p, (F.lit(100.0), F.lit(-50.0), F.lit(7000.0)))
    ground = V.on_ellipse(F.col("lon"), F.col("lat"))
    look = V.plus(ground, p, -1.0)
    far = V.norm(tuple(F.col(f"s{k}") - F.col(k) for k in "xyz"))
    gap = V.range_along(p, look) - V.norm(look)
    return _sight(spark, sf_dir).select("id", V.dot(t, n).alias("along"), (-V.dot(n, V.unit(p))).alias("nadir"), V.dot(c, t).alias("skew"), (far + gap).alias("reach"))


@query(f"{_SIGHT} SELECT id, {R('lon', 'lon')}, {R('lat', 'lat')}, CAST(0 AS DOUBLE) AS height FROM d", 6)
def range_to_ellipsoid(spark, sf_dir):
    """Ground points found again along the lines of sight to them."""
    p = F.col("sx"), F.col("sy"), F.col("sz")
    look = V.plus(V.on_ellipse(F.col("lon"), F.col("lat")), p, -1.0)
    x = _sight(spark, sf_dir).select("id", *(c.alias(k) for k, c in zip("abc", V.plus(p, V.unit(look), V.range_along(p, look)), strict=True)))
    lon, lat, h = S.to_llh(F.col("a"), F.col("b"), F.col("c"))
    return x.select("id", lon.alias("lon"), lat.alias("lat"), F.round(h, 4).alias("height"))


_EPSG = (4326, 32633, 32733, 3413, 3031, 6933)


@query(f"SELECT id, code, {D('0.2 + (id % 7) * 0.02', 'lon')}, {D('CASE WHEN code IN (32733, 3031) THEN -1 ELSE 1 END * (0.3 + (id % 11) * 0.1)', 'lat')} FROM (SELECT s_suppkey AS id, unnest([4326, 32633, 32733, 3413, 3031, 6933]) AS code FROM supplier)")
def projections_there_and_back(spark, sf_dir):
    x = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (0.2 + F.col("s_suppkey") % 7 * 0.02).alias("lon"), (0.3 + F.col("s_suppkey") % 11 * 0.1).alias("lat"))
    out = None
    for code in _EPSG:
        ahead, back = V.projection(code)
        lat = -F.col("lat") if code in (32733, 3031) else F.col("lat")
        a, b = ahead(F.col("lon"), lat)
        y = x.select("id", a.alias("x"), b.alias("y"))
        lon, lat = back(F.col("x"), F.col("y"))
        y = y.select("id", F.lit(code).alias("code"), lon.alias("lon"), lat.alias("lat"))
        out = y if out is None else out.unionByName(y)
    return out


@query(f"SELECT id, CASE WHEN lat >= 75 THEN 3413 WHEN lat <= -75 THEN 3031 WHEN lat > 0 THEN 32601 + CAST(round_even((lon + 177) / 6, 0) AS INTEGER) ELSE 32701 + CAST(round_even((lon + 177) / 6, 0) AS INTEGER) END AS code, {R('2.5 / 111 / cos(radians(lat))', 'margin')}, CASE WHEN lon > 90 THEN 2 ELSE 1 END AS boxes FROM (SELECT id, degrees(lon) AS lon, degrees(lat) AS lat FROM ({_GEO}))")
def map_codes(spark, sf_dir):
    x = places(spark, sf_dir).select("id", F.degrees("lon").alias("lon"), F.degrees("lat").alias("lat"))
    box = V.across_dateline(F.when(F.col("lon") > 90, -170.0).otherwise(0.0), F.when(F.col("lon") > 90, 175.0).otherwise(10.0))
    return x.select("id", V.code_of(F.col("lon"), F.col("lat")).alias("code"), V.margin_degrees(2.5, F.col("lat"))[1].alias("margin"), F.size(box).alias("boxes"))


@query(f"SELECT s_suppkey AS id, kind, {D('(s_suppkey % 9 - 4) * 0.03', 'el')}, {D('(s_suppkey % 5 + 1) * 0.04', 'az')} FROM supplier, (SELECT unnest(['el_and_az', 'el_over_az', 'az_over_el']) AS kind)")
def antenna_grids(spark, sf_dir):
    """Antenna angles there and back."""
    out = None
    el, az = (F.col("s_suppkey") % 9 - 4) * F.lit(0.03), (F.col("s_suppkey") % 5 + 1) * F.lit(0.04)
    for kind in ("el_and_az", "el_over_az", "az_over_el"):
        v = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), *(c.alias(k) for k, c in zip("xyz", V.antenna_vector(kind, el, az), strict=True)))
        a, b = V.antenna_angles(kind, (F.col("x"), F.col("y"), F.col("z")))
        v = v.select("id", F.lit(kind).alias("kind"), a.alias("el"), b.alias("az"))
        out = v if out is None else out.unionByName(v)
    return out


@query(f"WITH g AS ({_GEO}) SELECT id, {D('(id % 13 - 6) * 0.01', 'el')}, {D('(id % 7 - 3) * 0.005', 'az')}, true AS on_ground, true AS on_sphere FROM g")
def antenna_geometry(spark, sf_dir):
    """From antenna angles to the ground, and back; on the sphere of the ground point's radius the same place."""
    el, az = (F.col("id") % 13 - 6) * F.lit(0.01), (F.col("id") % 7 - 3) * F.lit(0.005)
    lon, lat = F.col("lon"), F.col("lat")
    p = S.to_ecef(lon, lat, F.lit(740_000.0))
    x = places(spark, sf_dir).select("id", "lon", "lat", el.alias("el"), az.alias("az"), *(c.alias(k) for k, c in zip("xyz", p, strict=True)))
    p = F.col("x"), F.col("y"), F.col("z")
    # the antenna looks down: its z axis to the centre of the earth, turned from the earth's z axis about the axis between them
    down = tuple(-c for c in V.unit(p))
    axis = V.cross((F.lit(0.0), F.lit(0.0), F.lit(1.0)), down)
    q = V.from_axis(F.acos(down[2]), axis)
    x = x.select("id", "el", "az", "x", "y", "z", *(c.alias(f"q{i}") for i, c in enumerate(q)))
    q = [F.col(f"q{i}") for i in range(4)]
    ground, r = V.antenna_to_ground("az_over_el", F.col("el"), F.col("az"), p, q)
    x = x.select("*", *(c.alias(f"g{k}") for k, c in zip("xyz", ground, strict=True)), r.alias("r"))
    g = F.col("gx"), F.col("gy"), F.col("gz")
    el, az = V.ground_to_antenna("az_over_el", g, p, q)
    e2 = 1 - E2
    on = F.abs(g[0] * g[0] + g[1] * g[1] + g[2] * g[2] / e2 - A0 * A0) < 1.0e3
    s = V.sphere_xyz(F.col("r"), F.col("az"), p, q, V.norm(g))
    near = F.abs(V.norm(V.plus(s, p, -1.0)) - F.col("r")) < 1e-3
    return x.select("id", el.alias("el"), az.alias("az"), on.alias("on_ground"), (near & (F.abs(V.norm(s) - V.norm(g)) < 1e-2)).alias("on_sphere"))


@query("SELECT s_suppkey AS id, round(CAST(s_suppkey * 137 % 20000 - 10000 AS DOUBLE), 3) + 0.0 AS s, round(CAST(s_suppkey * 71 % 30000 - 15000 AS DOUBLE), 3) + 0.0 AS c, round(s_acctbal, 3) + 0.0 AS h FROM supplier", 3)
def peg_coordinates(spark, sf_dir):
    """Coordinates about a peg point, to the earth's frame and back."""
    peg = V.Peg(0.3, 0.7, 1.1)
    k = F.col("s_suppkey")
    x = table(spark, sf_dir, "supplier").select(k.alias("id"), *(c.alias(n) for n, c in zip("xyz", peg.to_xyz((k * 137 % 20000 - 10000).cast("double"), (k * 71 % 30000 - 15000).cast("double"), F.col("s_acctbal")), strict=True)))
    s, c, h = peg.to_sch(F.col("x"), F.col("y"), F.col("z"))
    return x.select("id", s.alias("s"), c.alias("c"), h.alias("h"))


def _rcs_sql() -> str:
    p = "[sin(el), cos(el) * cos(az), cos(el) * sin(az)]"
    return f"WITH d AS (SELECT p_partkey AS id, 1 + p_size * 0.05 AS side, radians(5 + p_partkey % 60) AS el, radians(3 + p_partkey % 80) AS az FROM part), s AS (SELECT id, side, list_sort({p}) AS v FROM d), k AS (SELECT id, side, v[1] AS a, v[2] AS b, v[3] AS c FROM s) SELECT id, {D('4 * pi() * pow(side, 4) / pow(0.24, 2) * pow(CASE WHEN a + b > c THEN a + b + c - 2 / (a + b + c) ELSE 4 * a * b / (a + b + c) END, 2)', 'rcs', 3)} FROM k"


@query(_rcs_sql(), 3)
def reflector_cross_section(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rcs = V.trihedral_rcs(1 + F.col("p_size") * 0.05, F.radians(5 + F.col("p_partkey") % 60), F.radians(3 + F.col("p_partkey") % 80), 0.24)
    return p.select(F.col("p_partkey").alias("id"), rcs.alias("rcs"))


@query(f"SELECT id, {D('6.25 / sin(0.3 + (id % 9) * 0.05)', 'spacing')}, {D('7500 * 6371000.0 / (7100000 + h)', 'speed')}, {D('0.24 * (800000 + h) / (2 * 5.0) / sqrt(7500 * 6800)', 'aperture')}, {D('2 * (800000 + h) / 299792458.0 * 1000', 'delay')}, {D('2.3 * exp(-h / 6000) / cos(0.5)', 'dry')}, CAST(pow(2, ceil(log2(1 + id * 37 % 5000))) AS BIGINT) AS fft FROM ({_GEO})")
def sensor_arithmetic(spark, sf_dir):
    k, h = F.col("id"), F.col("h")
    return places(spark, sf_dir).select(
        "id", V.ground_spacing(6.25, 0.3 + k % 9 * 0.05).alias("spacing"), V.ground_speed(F.lit(7500.0), 7_100_000 + h, F.lit(6_371_000.0)).alias("speed"), V.aperture_time(0.24, 800_000 + h, 5.0, F.lit(7500.0), F.lit(6800.0)).alias("aperture"),
        (S.bistatic_delay(800_000 + h) * 1000).alias("delay"), S.dry_delay(h, F.cos(F.lit(0.5))).alias("dry"), S.next_power_of_two(1 + k * 37 % 5000).alias("fft"),
    )


_F0, _F1, _FL, _FH = 1.2575e9, 1.2935e9, 1.2475e9, 1.2675e9


@query(
    f"WITH {IMAGE}, p AS (SELECT line, pixel, re * 9 AS d, im * 7 AS n FROM cx) SELECT line, pixel, {R('d', 'd1')}, {R('n', 'n1')}, {R('d', 'd2')}, {R('n', 'n2')}, CAST(pixel % 3 - 1 AS DOUBLE) AS common, CAST(line % 3 - 1 AS DOUBLE) AS differ, CAST(pixel % 3 - 1 AS DOUBLE) AS common_lh, CAST(line % 3 - 1 AS DOUBLE) AS differ_lh FROM p"
)
def ionosphere_methods(spark, sf_dir):
    """Phases made of known parts and whole turns: the parts and turns are found again by every method."""
    x = image(spark, sf_dir).select("line", "pixel", (F.col("re") * 9).alias("d"), (F.col("im") * 7).alias("n"))
    d, n = F.col("d"), F.col("n")
    main, side = n + d, _F1 / _F0 * n + _F0 / _F1 * d
    a, b = A.main_side(_F0, _F1, main, side), A.main_difference(_F0, _F1, main, side)
    c, k = (F.col("pixel") % 3 - 1), (F.col("line") % 3 - 1)
    turned = A.jumps_main_difference(_F0, _F1, d, n, main + 2 * math.pi * c, side + 2 * math.pi * (c + k))
    low, high = _FL / _F0 * n + _F0 / _FL * d, _FH / _F0 * n + _F0 / _FH * d
    split = A.jumps_low_high(_F0, _FL, _FH, d, n, low + 2 * math.pi * c, high + 2 * math.pi * (c + k))
    sided = A.jumps_main_side(_F0, _F1, d, n, main, side + 2 * math.pi * k)
    # the sum of low and high leaves the common turns by a small part of the difference in frequency
    return x.select("line", "pixel", a[0].alias("d1"), a[1].alias("n1"), b[0].alias("d2"), b[1].alias("n2"), turned[0].alias("common"), sided[1].alias("differ"), split[0].alias("common_lh"), split[1].alias("differ_lh"))


@query(f"SELECT id, {D('40.31 * 1e16 * (10 + id % 7 - (2 + id % 3)) / pow(1.2575e9, 2) / cos(0.6)', 'delay')}, {D('4 * pi() / 0.24 * 0.05 * (id % 5) / cos(0.6)', 'phase')}, {D('0.01 * (id % 3) * 0.6 + 0.02 * 0.1 - 0.03 * 0.79', 'tide')} FROM ({_GEO})")
def atmospheric_delays(spark, sf_dir):
    k = F.col("id")
    content = A.below_orbit(10.0 + k % 7, 2.0 + k % 3)
    tide = A.tide_along_sight(0.01 * (k % 3), F.lit(0.02), F.lit(-0.03), (F.lit(0.6), F.lit(0.1), F.lit(0.79)))
    return places(spark, sf_dir).select("id", A.content_delay(content, 1.2575e9, F.lit(0.6)).alias("delay"), A.slant_difference(F.lit(2.0), 2.0 + 0.05 * (k % 5), F.lit(0.6), 0.24).alias("phase"), tide.alias("tide"))


@query(
    "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') AS compact, CASE event_id % 4 WHEN 0 THEN 'SH' WHEN 1 THEN 'DH' WHEN 2 THEN 'QP' ELSE 'XX' END AS code, 'P_' || event_type || '_' || strftime(ts, '%Y%m%dT%H%M%S') AS granule, CAST(event_id AS VARCHAR) || CASE WHEN event_id % 100 BETWEEN 11 AND 13 THEN 'th' WHEN event_id % 10 = 1 THEN 'st' WHEN event_id % 10 = 2 THEN 'nd' WHEN event_id % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal, strftime(ts, '%Y-%m-%d %H:%M:%S') AS found, 'ground_track_velocity' AS snake, 'groundTrackVelocity' AS camel, 'a b c' AS flat, round(CAST(event_id % 7 AS DOUBLE) + 0.5, 6) + 0.0 AS second, CASE WHEN event_id % 2 = 0 THEN 'latitude_longitude' ELSE 'transverse_mercator' END AS mapping FROM events"
)
def product_names(spark, sf_dir):
    e, k, ts = table(spark, sf_dir, "events"), F.col("event_id"), F.col("ts")
    pols = F.when(k % 4 == 0, F.array(F.lit("HH"))).when(k % 4 == 1, F.array(F.lit("HV"), F.lit("HH"))).when(k % 4 == 2, F.array(*(F.lit(p) for p in ("VV", "HH", "VH", "HV")))).otherwise(F.array(F.lit("VH")))
    granule = T.granule_id([F.lit("P"), F.col("event_type"), T.compact_date(ts)])
    values = T.numbers(F.concat(F.lit("1.5, "), (k % 7 + 0.5).cast("string"), F.lit("  x")))
    return e.select(
        "event_id", T.compact_date(ts).alias("compact"), T.polarisation_code(pols).alias("code"), granule.alias("granule"), T.ordinal(k).alias("ordinal"), F.date_format(F.get(T.dates_in(granule), F.lit(0)), "yyyy-MM-dd HH:mm:ss").alias("found"),
        T.snake(F.lit("groundTrackVelocity")).alias("snake"), T.camel(F.lit("ground_track_velocity")).alias("camel"), T.unwrapped(F.lit("a\n   b\n c ")).alias("flat"), F.get(values, F.lit(1)).alias("second"), T.grid_mapping(F.when(k % 2 == 0, 4326).otherwise(32633)).alias("mapping"),
    )


@query(
    f"SELECT event_id, strftime(to_timestamp(CAST(epoch_us(date_trunc('day', ts)) // 1000000 + CAST(ceil((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 600e6) AS BIGINT) * 600 AS DOUBLE)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS snapped, {D('(epoch_us(ts) - epoch_us(TIMESTAMP ' + chr(39) + '2024-01-10 00:00:00' + chr(39) + ')) / 1e6', 'since')}, CAST(event_id * 977 // 86400 AS BIGINT) AS days, CAST(event_id * 977 % 86400 // 3600 AS BIGINT) AS hours, CAST(event_id * 977 % 3600 // 60 AS BIGINT) AS minutes, {D('event_id * 977 % 60', 'rest')} FROM events"
)
def spans_of_time(spark, sf_dir):
    ts, span = F.col("ts"), T.parts_of_span((F.col("event_id") * 977).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(T.from_midnight(ts, 600), "yyyy-MM-dd'T'HH:mm:ss").alias("snapped"), T.seconds_since(ts, "2024-01-10 00:00:00").alias("since"), *(c.alias(k) for k, c in zip(("days", "hours", "minutes", "rest"), span, strict=True)))


@query(f"WITH {REAL} SELECT line, count(*) + 5 AS padded, 7 AS blocks, CAST(4 AS INTEGER) AS last, CASE WHEN line % 2 = 0 THEN '{{\"real\":1.5,\"imag\":-2.0}}' ELSE '{{\"real\":0.0,\"imag\":1.0}}' END AS json FROM px GROUP BY line")
def array_generators(spark, sf_dir):
    from ..sources.rasters import line_arrays

    x = line_arrays(real(spark, sf_dir))
    parts = T.blocks(F.col("values"), 10)
    even = F.col("line") % 2 == 0
    z = T.complex_json(F.when(even, 1.5).otherwise(0.0), F.when(even, -2.0).otherwise(1.0))
    return x.select("line", F.size(T.padded(F.col("values"), 2, 3)).cast("long").alias("padded"), F.size(parts).alias("blocks"), F.size(F.element_at(parts, -1)).alias("last"), z.alias("json"))


@query(f"WITH {REAL} SELECT line, pixel, {R('1 + 2 * value + 3 * (pixel / 64.0) - value * value + 0.5 * value * (pixel / 64.0)', 'value')}, {R('CASE WHEN abs(pixel - 31.5) <= 16 THEN 1.0 ELSE 0.5 * (1 + cos(pi() * (abs(pixel - 31.5) - 16) / 16)) END', 'tukey')}, {R('0.54 - 0.46 * cos(2 * pi() * pixel / 63)', 'cosine')}, {R('greatest(0, 1 - abs(value))', 'bartlett')} FROM px")
def windows_and_surfaces(spark, sf_dir):
    p, v = F.col("pixel"), F.col("value")
    return real(spark, sf_dir).select("line", "pixel", S.poly2d(v, p / 64.0, [[1.0, 3.0], [2.0, 0.5], [-1.0, 0.0]]).alias("value"), S.tukey(p, 64, 0.5).alias("tukey"), S.cosine_window(p, 64, 0.54).alias("cosine"), S.bartlett(v, 1.0).alias("bartlett"))


@query(f"SELECT s_suppkey AS id, {R('sqrt(2.0 + s_suppkey % 17)', 'newton')}, {R('sqrt(2.0 + s_suppkey % 17)', 'secant')}, {R('sqrt(2.0 + s_suppkey % 17)', 'bisection')} FROM supplier")
def root_finders(spark, sf_dir):
    a = 2.0 + F.col("s_suppkey") % 17
    f, df = (lambda x: x * x - a), (lambda x: 2 * x)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), S.newton(f, df, a, 12).alias("newton"), S.secant(f, F.lit(1.0), a, 16).alias("secant"), S.bisection(f, F.lit(0.0), a, 60).alias("bisection"))


@query(f"WITH {REAL}, k AS (SELECT line, pixel, value, lag(value) OVER (PARTITION BY line ORDER BY pixel) AS l, lead(value) OVER (PARTITION BY line ORDER BY pixel) AS r FROM px) SELECT line, pixel, {R('pixel + 0.5 * (l - r) / (l - 2 * value + r)', 'place')}, {R('value - 0.125 * pow(l - r, 2) / (l - 2 * value + r)', 'height')} FROM k WHERE l < value AND r < value")
def parabola_peaks(spark, sf_dir):
    from ..operators.stencils import along

    v = F.col("value")
    x = real(spark, sf_dir).withColumns({"l": F.lag("value").over(along()), "r": F.lead("value").over(along())}).where("l < value and r < value")
    place, height = S.parabola(F.col("l"), v, F.col("r"))
    return x.select("line", "pixel", (F.col("pixel") + place).alias("place"), height.alias("height"))


@query("SELECT i AS place, round(CAST(-3 + 0.25 * i AS DOUBLE), 9) + 0.0 AS linear, round(pow(10.0, -2 + i / 20.0), 9) + 0.0 AS logarithmic, round(CAST(1.0 / 81 AS DOUBLE), 9) + 0.0 AS box, CASE WHEN i = 40 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS delta, round(exp(-pow(i - 40, 2) / 50.0) / (SELECT sum(exp(-pow(j - 40, 2) / 50.0)) FROM range(81) r(j)), 9) + 0.0 AS gauss FROM range(81) r(i)", 9)
def axes_and_kernels(spark, sf_dir):
    from ..functions import generators as G

    x = G.linspace(spark, -3.0, 0.25, 81, "linear").join(G.logspace(spark, -2.0, 0.05, 81, "logarithmic"), "place")
    for name, values in (("box", G.boxcar(81)), ("delta", G.delta(81)), ("gauss", G.gaussian(81, 5.0))):
        x = x.join(spark.createDataFrame(list(enumerate(values)), f"place long, {name} double"), "place")
    return x
