"""Queries of numeric kernels and radar geometry, each with its SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import generators as N
from ..operators import geometry as G
from ..operators import kernels as K
from ..operators import unwrap
from ..sources import rasters
from ..sources.rasters import table
from .raster import IMAGE, REAL, R, query, real
from .samples import D, circle

_WAVE = 0.24


def lines(spark, sf_dir):
    return rasters.line_arrays(real(spark, sf_dir))


def complex_lines(spark, sf_dir):
    """The image's lines as two arrays."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda k: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.get("embedding", 2 * i + k).cast("double"))
    return e.select(F.col("vec_id").alias("line"), part(0).alias("re"), part(1).alias("im"))


def _response(n: int, low: float, high: float) -> list[tuple[float, float]]:
    """The circular impulse response of a band."""
    import numpy as np

    h = np.fft.ifft(K.band(n, low, high))
    return [(float(x.real), float(x.imag)) for x in h]


def _band_sql(low: float, high: float) -> str:
    h = _response(32, low, high)
    table_ = f"h AS (SELECT unnest(range(32)) AS d, unnest({[a for a, _ in h]!r}) AS a, unnest({[b for _, b in h]!r}) AS b)"
    return f"{IMAGE}, {table_}, bp AS (SELECT x.line, o.o AS pixel, sum(x.re * a - x.im * b) AS re, sum(x.re * b + x.im * a) AS im FROM cx x, (SELECT unnest(range(32)) AS o) o JOIN h ON h.d = (o.o - x.pixel + 32) % 32 GROUP BY 1, 2)"


@query(f"WITH {_band_sql(-0.2, 0.15)} SELECT line, CAST(pixel AS INTEGER) AS pixel, {R('re', 're')}, {R('im', 'im')} FROM bp")
def band_pass(spark, sf_dir):
    x = K.band_pass(complex_lines(spark, sf_dir), -0.2, 0.15)
    return x.select("line", F.posexplode(F.arrays_zip("re", "im")).alias("pixel", "z")).select("line", "pixel", "z.re", "z.im")


@query(f"WITH {_band_sql(0.1, 0.35)}, d AS (SELECT line, pixel, re, im, -2 * pi() * 0.225 * pixel AS g FROM bp WHERE pixel % 4 = 0) SELECT line, CAST(pixel // 4 AS INTEGER) AS pixel, {R('re * cos(g) - im * sin(g)', 're')}, {R('re * sin(g) + im * cos(g)', 'im')} FROM d")
def split_spectrum(spark, sf_dir):
    x = K.split_spectrum(complex_lines(spark, sf_dir), 0.1, 0.35)
    return x.select("line", F.posexplode(F.arrays_zip("re", "im")).alias("pixel", "z")).select("line", "pixel", "z.re", "z.im")


@query(f"WITH {_band_sql(-0.15, 0.25)} SELECT line, CAST(pixel AS INTEGER) AS pixel, {R('re', 're')}, {R('im', 'im')} FROM bp")
def common_band(spark, sf_dir):
    """Bands of width 0.5 about 0 and 0.1 have -0.15 to 0.25 in common."""
    x = complex_lines(spark, sf_dir).withColumns({"f1": F.lit(0.0), "f2": F.lit(0.1)})
    y = K.common_band(x, "f1", "f2", 0.5)
    return y.select("line", F.posexplode(F.arrays_zip("re", "im")).alias("pixel", "z")).select("line", "pixel", "z.re", "z.im")


@query(f"WITH {REAL}, p AS (SELECT line, value, pixel / 64.0 + 0.002 * (pixel % 5) AS pos FROM px) SELECT line, CAST(k AS INTEGER) AS bin, {R('sum(value * cos(2 * pi() * k * pos))', 're')}, {R('-sum(value * sin(2 * pi() * k * pos))', 'im')} FROM p, range(16) r(k) GROUP BY 1, 2")
def nonuniform_spectrum(spark, sf_dir):
    x = lines(spark, sf_dir).withColumn("place", F.transform("values", lambda _, i: i / 64.0 + 0.002 * (i % 5)))
    y = K.nonuniform_spectrum(x, 16)
    return y.select("line", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z")).select("line", "bin", "z.re", "z.im")


@query(f"WITH {REAL}, t AS (SELECT line // 8 AS ty, pixel // 16 AS tx, line % 8 AS y, pixel % 16 AS x, value FROM px WHERE line < (SELECT (max(line) + 1) // 8 * 8 FROM px)), k AS (SELECT ky, kx FROM range(8) a(ky), range(16) b(kx)) SELECT ty, CAST(tx AS BIGINT) AS tx, CAST(ky AS INTEGER) AS ky, CAST(kx AS INTEGER) AS kx, round(pow(sum(value * cos(2 * pi() * (ky * y / 8.0 + kx * x / 16.0))), 2) + pow(sum(value * sin(2 * pi() * (ky * y / 8.0 + kx * x / 16.0))), 2), 5) + 0.0 AS power FROM t, k GROUP BY ALL", 5)
def tile_spectrum(spark, sf_dir):
    return K.spectrum2d(K.tiles(lines(spark, sf_dir), 8, 16), 8, 16)


@query(f"WITH {REAL} SELECT line, CAST(pixel * 4 AS INTEGER) AS place, {R('value', 'value')} FROM px")
def upsampled_lines(spark, sf_dir):
    """Four times the samples: every fourth is the old one."""
    return K.upsampled(lines(spark, sf_dir), 4).select("line", F.posexplode("values").alias("place", "value")).where("place % 4 = 0")


@query(f"WITH {REAL} SELECT line, pixel, {R('value', 'value')} FROM px WHERE pixel BETWEEN 3 AND 59 AND line BETWEEN 4 AND (SELECT max(line) - 5 FROM px)")
def resampled_whole(spark, sf_dir):
    """An image resampled by whole samples is the image moved; tests hold parts of a sample against closed forms."""
    x = lines(spark, sf_dir).select(F.col("line"), F.col("values").alias("re"), F.transform("values", lambda _: F.lit(0.0)).alias("im"))
    y = K.resampled(x, lambda i, j: i * 0.0 + 1.0, lambda i, j: j * 0.0 - 2.0, 4, 64)
    y = y.select((F.col("line") + 1).alias("line"), F.posexplode("re").alias("pixel", "value")).select("line", (F.col("pixel") - 2).cast("long").alias("pixel"), "value")
    last = rasters.shape(table(spark, sf_dir, "embeddings"))[0] - 1
    return y.where((F.col("pixel") >= 3) & (F.col("pixel") <= 59) & (F.col("line") >= 4) & (F.col("line") <= last - 5))


@query("SELECT ty * 4 + tx AS id, CAST(2 AS DOUBLE) AS dy, CAST(-1 AS DOUBLE) AS dx, CAST(1 AS DOUBLE) AS correlation FROM (SELECT unnest(range((SELECT CAST((max(vec_id) + 1) // 16 AS BIGINT) FROM embeddings))) AS ty), range(4) t(tx)", 0)
def image_matching(spark, sf_dir):
    """Chips cut from windows two lines down and one pixel left of their middle are found there."""
    tiled = K.tiles(lines(spark, sf_dir), 16, 16).select((F.col("ty") * 4 + F.col("tx")).alias("id"), F.col("values").alias("window"))
    cells = [(3 + 2 + y) * 16 + 3 - 1 + x for y in range(10) for x in range(10)]
    chip = F.transform(F.array(*(F.lit(c) for c in cells)), lambda i: F.get("window", i))
    return K.match2d(tiled.withColumn("chip", chip), 10, 10, 3).select("id", "dy", "dx", "correlation")


@query("SELECT vec_id AS id, CAST(16 AS DOUBLE) AS y, CAST(16 AS DOUBLE) AS x, round(pow(1 + vec_id % 5, 2), 3) + 0.0 AS peak, CAST(1.75 AS DOUBLE) AS y_width, CAST(1.75 AS DOUBLE) AS x_width FROM embeddings", 3)
def point_targets(spark, sf_dir):
    """Band-limited point targets of known place and height: found, with the width of their band."""
    place = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: i)
    tap = lambda d: F.when(d == 0, 1.0).otherwise(F.sin(math.pi * d * 0.5) / (16 * F.sin(math.pi * d / 32)) * F.cos(math.pi * d / 32))
    z = F.transform(place, lambda i: tap(F.floor(i / 32) - 16) * tap(i % 32 - 16) * (1 + F.col("vec_id") % 5))
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), z.alias("re"), F.transform(place, lambda _: F.lit(0.0)).alias("im"))
    got = K.point_targets(x, 32, 32, 8)
    return got.select("id", "y", "x", "peak", (F.round(F.col("y_width") * 4) / 4).alias("y_width"), (F.round(F.col("x_width") * 4) / 4).alias("x_width"))


@query(f"WITH {REAL}, a AS (SELECT line, pixel, 0.05 * line + 0.31 * pixel + 0.4 * value AS v FROM px) SELECT line, CAST(pixel AS INTEGER) AS pixel, {R('v - (SELECT v - atan2(sin(v), cos(v)) FROM a WHERE line = 0 AND pixel = 0)', 'value')}, CAST(1 AS INTEGER) AS component FROM a")
def phase_unwrapping(spark, sf_dir):
    """A smooth surface, wrapped, comes back but for whole turns of its first sample."""
    x = real(spark, sf_dir).withColumn("v", 0.05 * F.col("line") + 0.31 * F.col("pixel") + 0.4 * F.col("value"))
    x = x.withColumn("value", F.atan2(F.sin("v"), F.cos("v")))
    return unwrap.unwrapped(rasters.line_arrays(x), 64)


@query(f"WITH {REAL}, k AS (SELECT p_partkey AS id, p_partkey % 400 AS line, 5 + p_size * 1.04 AS pos FROM part), t AS (SELECT id, pos, line, CAST(ceil(pos - 2) AS BIGINT) + j AS i FROM k, range(4) r(j)), w AS (SELECT t.id, value, abs(pos - i) AS m FROM t JOIN px ON px.line = t.line AND px.pixel = i) SELECT id, {R('sum(value * CASE WHEN m <= 1 THEN 1.5*m*m*m - 2.5*m*m + 1 WHEN m < 2 THEN -0.5*(m*m*m - 5*m*m + 8*m - 4) ELSE 0 END)', 'cubic')}, {R('sum(value * greatest(1 - m, 0))', 'linear')} FROM w GROUP BY 1")
def interpolation_kernels(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 400).alias("line"), (5 + F.col("p_size") * 1.04).alias("at"))
    x = p.join(lines(spark, sf_dir), "line")
    return x.select("id", N.interpolated(F.col("values"), F.col("at"), N.cubic(), 4).alias("cubic"), N.interpolated(F.col("values"), F.col("at"), N.linear(), 4).alias("linear"))


_TARGET = "SELECT s_suppkey AS id, -0.02 - (s_suppkey % 23) * 0.0015 AS lon, 0.12 + (s_suppkey % 41) * 0.015 AS lat, CAST(s_suppkey % 9 * 100 AS DOUBLE) AS h FROM supplier"


def _targets(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (-0.02 - k % 23 * 0.0015).cast("double").alias("lon"), (0.12 + k % 41 * 0.015).cast("double").alias("lat"), (k % 9 * 100).cast("double").alias("h"))


_XYZ = f"g AS ({_TARGET}), n AS (SELECT *, 6378137.0 / sqrt(1 - 0.0066943799901 * sin(lat) ** 2) AS r FROM g), x AS (SELECT id, lon, lat, h, (r + h) * cos(lat) * cos(lon) AS x, (r + h) * cos(lat) * sin(lon) AS y, (r * (1 - 0.0066943799901) + h) * sin(lat) AS z FROM n)"


@query(f"WITH {_XYZ}, t AS (SELECT id, x, y, z, atan2(z, x) / 0.00105 AS t FROM x) SELECT id, round(t, 4) + 0.0 AS time, round(sqrt(pow(x - 7100000 * cos(0.00105 * t), 2) + y * y + pow(z - 7100000 * sin(0.00105 * t), 2)), 3) + 0.0 AS slant FROM t", 4)
def ground_to_radar(spark, sf_dir):
    """Zero-Doppler time and range of targets on an orbit of state vectors; on a circle both have a closed form."""
    x = G.to_radar(_targets(spark, sf_dir), G.orbit_of(circle(spark)), _WAVE, right=False)
    return x.select("id", "time", F.round("slant", 3).alias("slant"))


@query(f"WITH g AS ({_TARGET}) SELECT id, {D('lon', 'lon')}, {D('lat', 'lat')}, CAST(0 AS DOUBLE) AS h FROM g", 6)
def radar_to_ground(spark, sf_dir):
    """Targets on the ellipsoid, to radar and back to the ground."""
    orbit = G.orbit_of(circle(spark))
    there = G.to_radar(_targets(spark, sf_dir).withColumn("h", F.lit(0.0)), orbit, _WAVE, right=False)
    return G.to_ground(there, orbit, _WAVE, right=False).select("id", "lon", "lat", F.round("h", 3).alias("h"))


@query(f"WITH g AS ({_TARGET}) SELECT id, {D('lon', 'lon')}, {D('lat', 'lat')}, round(CAST(500 + 3000 * (lat - 0.1) AS DOUBLE), 2) + 0.0 AS h FROM g", 6)
def radar_to_terrain(spark, sf_dir):
    """Targets on a slope: found again on the terrain, not on the ellipsoid."""
    import numpy as np

    orbit = G.orbit_of(circle(spark))
    lon, lat = np.linspace(-0.1, 0.05, 40), np.linspace(0.1, 0.8, 90)
    terrain = G.Terrain(lon, lat, np.repeat((500 + 3000 * (lat - 0.1))[:, None], 40, axis=1))
    there = G.to_radar(_targets(spark, sf_dir).withColumn("h", 500 + 3000 * (F.col("lat") - 0.1)), orbit, _WAVE, right=False)
    return G.to_ground(there, orbit, _WAVE, terrain, right=False).select("id", "lon", "lat", F.round("h", 2).alias("h"))


_FLAT = _XYZ.replace("CAST(s_suppkey % 9 * 100 AS DOUBLE) AS h", "CAST(0 AS DOUBLE) AS h")


@query(f"WITH {_FLAT}, t AS (SELECT id, lon, lat, x, y, z, atan2(z, x) AS a FROM x), s AS (SELECT *, 7100000 * cos(a) - x AS dx, -y AS dy, 7100000 * sin(a) - z AS dz FROM t), u AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS far FROM s) SELECT id, {R('acos((dx*cos(lat)*cos(lon) + dy*cos(lat)*sin(lon) + dz*sin(lat)) / far)', 'incidence')}, {R('(dy*cos(lon) - dx*sin(lon)) / far', 'east')}, {R('(dz*cos(lat) - sin(lat)*(dx*cos(lon) + dy*sin(lon))) / far', 'north')}, round(7455 * sqrt(x*x + y*y + z*z) / 7100000, 4) + 0.0 AS ground_speed FROM u", 6)
def map_grid_layers(spark, sf_dir):
    x = G.grid_layers(_targets(spark, sf_dir), G.orbit_of(circle(spark)), _WAVE, right=False)
    return x.select("id", "incidence", "east", "north", F.round("ground_speed", 4).alias("ground_speed"))


@query(f"WITH {_FLAT}, t AS (SELECT id, lon, lat, x, y, z, atan2(z, x) AS a FROM x), s AS (SELECT *, 7100000 * cos(a) - x AS dx, -y AS dy, 7100000 * sin(a) - z AS dz FROM t), u AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS far FROM s) SELECT id, {D('lon', 'lon')}, {R('acos((dx*cos(lat)*cos(lon) + dy*cos(lat)*sin(lon) + dz*sin(lat)) / far)', 'incidence')}, {R('acos((dx*cos(lat)*cos(lon) + dy*cos(lat)*sin(lon) + dz*sin(lat)) / far)', 'local_incidence')}, {R('(dy*cos(lon) - dx*sin(lon)) / far', 'east')} FROM u", 6)
def topographic_layers(spark, sf_dir):
    """From radar to the ground with its layers; on the ellipsoid local and ellipsoidal incidence agree."""
    orbit = G.orbit_of(circle(spark))
    there = G.to_radar(_targets(spark, sf_dir).withColumn("h", F.lit(0.0)), orbit, _WAVE, right=False)
    return G.layers(there, orbit, _WAVE, right=False).select("id", "lon", "incidence", "local_incidence", "east")


@query(f"WITH g AS ({_TARGET}) SELECT id, true AS same FROM g")
def other_radar(spark, sf_dir):
    """Samples of one acquisition in another on the same orbit are the same samples."""
    orbit = G.orbit_of(circle(spark))
    there = G.to_radar(_targets(spark, sf_dir).withColumn("h", F.lit(0.0)), orbit, _WAVE, right=False)
    again = G.to_other_radar(there, orbit, orbit, _WAVE, right=False).withColumnsRenamed({"time": "t2", "slant": "r2"})
    return there.join(again, "id").select("id", ((F.abs(F.col("time") - F.col("t2")) < 2e-6) & (F.abs(F.col("slant") - F.col("r2")) < 1e-2)).alias("same"))


@query(f"WITH {_XYZ}, t AS (SELECT id, x, y, z, atan2(z, x) AS a FROM x), s AS (SELECT id, sqrt(pow(x - 7100000 * cos(a), 2) + y*y + pow(z - 7100000 * sin(a), 2)) AS r1, sqrt(pow(x - 7100200 * cos(a), 2) + y*y + pow(z - 7100200 * sin(a), 2)) AS r2 FROM t) SELECT id, round((r1*r1 + 40000 - r2*r2) / (2 * r1), 2) + 0.0 AS parallel FROM s", 2)
def orbit_baselines(spark, sf_dir):
    """Two circles 200 m apart, one above the other."""
    a = F.col("id") * 0.0105
    high = spark.range(91).select((F.col("id") * 10.0).alias("t"), (7_100_200 * F.cos(a)).alias("x"), F.lit(0.0).alias("y"), (7_100_200 * F.sin(a)).alias("z"), (-7455.21 * F.sin(a)).alias("vx"), F.lit(0.0).alias("vy"), (7455.21 * F.cos(a)).alias("vz"))
    return G.baselines(_targets(spark, sf_dir), G.orbit_of(circle(spark)), G.orbit_of(high), _WAVE, right=False).select("id", "parallel")
