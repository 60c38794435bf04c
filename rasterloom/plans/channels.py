"""Queries of antenna channels, sets, sorts, polygons and interpolators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frames as V
from ..functions import scalar as S
from ..operators import antenna as A
from ..operators import joins
from ..sources.rasters import line_arrays, table
from .imaging import _SIGHT, _sight
from .raster import IMAGE, REAL, R, image, query, real
from .samples import D

_CH = f"{IMAGE}, ch AS (SELECT line, pixel // 4 AS pixel, pixel % 4 AS channel, (pixel // 4) % 3 AS angle, re, im FROM cx)"
_PT = "pt AS (SELECT c AS channel, a AS angle, 1.0 + c AS r, 0.5 * a - c AS i FROM range(4) x(c), range(3) y(a)), wt AS (SELECT channel, angle, r / sqrt(sum(r*r + i*i) OVER (PARTITION BY angle)) AS wr, -i / sqrt(sum(r*r + i*i) OVER (PARTITION BY angle)) AS wi FROM pt)"


@query(f"WITH {_CH}, {_PT} SELECT line, pixel, {R('sum(re * wr - im * wi)', 're')}, {R('sum(re * wi + im * wr)', 'im')} FROM ch JOIN wt USING (channel, angle) GROUP BY 1, 2")
def beamforming(spark, sf_dir):
    p = F.col("pixel")
    samples = image(spark, sf_dir).select("line", F.floor(p / 4).alias("pixel"), (p % 4).alias("channel"), (F.floor(p / 4) % 3).alias("angle"), "re", "im")
    patterns = spark.range(12).select((F.col("id") % 4).alias("channel"), F.floor(F.col("id") / 4).alias("angle")).select("channel", "angle", (1.0 + F.col("channel")).alias("re"), (0.5 * F.col("angle") - F.col("channel")).alias("im"))
    return A.beamformed(samples, A.weights(patterns))


@query(f"WITH {IMAGE}, s AS (SELECT c AS channel, c * 7 AS start, c * 7 + 10 AS stop FROM range(4) r(c)), m AS (SELECT line, pixel, min(channel) AS channel FROM cx JOIN s ON pixel >= start AND pixel < stop GROUP BY 1, 2) SELECT line, pixel, channel, {R('re * (channel + 1)', 're')}, {R('im', 'im')} FROM m JOIN cx USING (line, pixel)")
def one_tap_channels(spark, sf_dir):
    spans = spark.range(4).select(F.col("id").alias("channel"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 10).alias("stop"))
    x = image(spark, sf_dir).withColumn("channel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return A.one_tap(x.withColumn("re", F.col("re") * (F.col("channel") + 1)), spans)


@query()
def interference_removed(spark, sf_dir):
    return A.without_interference(image(spark, sf_dir), 16, 4.0)


@query("SELECT DISTINCT CASE WHEN n = 2 AND i = 2 THEN 'B' ELSE freq END AS freq, pol, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY freq, pol ORDER BY lo + hi) AS i, count(*) OVER (PARTITION BY freq, pol) AS n FROM (SELECT DISTINCT 'A' AS freq, p_brand AS pol, CAST(p_partkey % 2 * 40 AS DOUBLE) AS lo, CAST(p_partkey % 2 * 40 + 20 * (p_partkey % 3) AS DOUBLE) AS hi FROM part WHERE p_partkey % 3 <> 2) WHERE lo < hi)")
def regular_channel_sets(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").where(k % 3 != 2)
    lo = (k % 2 * 40).cast("double")
    return A.regular_channels(p.select(F.lit("A").alias("freq"), F.col("p_brand").alias("pol"), lo.alias("lo"), (lo + 20 * (k % 3)).alias("hi")))


@query(f"WITH t AS (SELECT p_partkey AS id, CAST(p_partkey % 20 - 5 AS DOUBLE) AS x, CAST(p_size % 15 - 4 AS DOUBLE) AS y, 6.0 AS w, 5.0 AS h FROM part) SELECT id, CAST(30 AS DOUBLE) AS area, {D('greatest(least(x + w, 10) - greatest(x, 0), 0) * greatest(least(y + h, 8) - greatest(y, 0), 0)', 'common')} FROM t")
def polygon_overlap(spark, sf_dir):
    x, y = (F.col("p_partkey") % 20 - 5).cast("double"), (F.col("p_size") % 15 - 4).cast("double")
    corner = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    poly = F.array(corner(0.0, 0.0), corner(6.0, 0.0), corner(6.0, 5.0), corner(0.0, 5.0))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), poly.alias("p"))
    return p.select("id", A.polygon_area(F.col("p")).alias("area"), A.polygon_area(A.clipped(F.col("p"), (0.0, 0.0, 10.0, 8.0))).alias("common"))


@query(f"WITH {REAL}, o AS (SELECT line, list(value ORDER BY value, pixel) AS k, list(pixel ORDER BY value, pixel) AS v, median(value) AS m, arg_max(pixel, value * value) AS peak FROM px GROUP BY 1) SELECT line, {R('k[1]', 'first')}, CAST(v[1] AS INTEGER) AS place, greatest(len(list_filter(k, lambda x: x <= 0.05)) - 1, 0) AS below, {R('m', 'median')}, CAST(peak AS INTEGER) AS peak FROM o")
def sorted_lines(spark, sf_dir):
    x = line_arrays(real(spark, sf_dir))
    v = F.col("values")
    keys, places = A.joint_sort(v, F.sequence(F.lit(0), F.size(v) - 1))
    x = x.select("line", "values", keys.alias("k"), places.alias("p"))
    n = F.size("k")
    median = (F.get("k", ((n - 1) / 2).cast("int")) + F.get("k", (n / 2).cast("int"))) / 2
    power = F.transform("values", lambda a, i: F.struct((a * a).alias("p"), i.alias("i")))
    return x.select("line", F.get("k", F.lit(0)).alias("first"), F.get("p", F.lit(0)).alias("place"), A.last_not_over(F.col("k"), F.lit(0.05)).cast("long").alias("below"), median.alias("median"), F.array_max(power)["i"].alias("peak"))


def _grid_sql(kind: str) -> str:
    probes = "q AS (SELECT p_partkey AS id, p_size * 0.61 AS y, p_partkey % 613 / 10.0 AS x FROM part)"
    if kind == "nearest":
        return f"WITH {REAL}, {probes} SELECT id AS probe, {R('value', 'value')} FROM q JOIN px ON line = least(CAST(round(y) AS BIGINT), 31) AND pixel = least(CAST(round(x) AS BIGINT), 63)"
    k = lambda c: f"CASE WHEN abs({c}) <= 1 THEN 1.5 * abs({c}) ** 3 - 2.5 * abs({c}) ** 2 + 1 WHEN abs({c}) < 2 THEN -0.5 * (abs({c}) ** 3 - 5 * abs({c}) ** 2 + 8 * abs({c}) - 4) ELSE 0 END"
    return f"WITH {REAL}, {probes}, t AS (SELECT id, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, CAST(floor(y) AS BIGINT) + i - 1 AS a, CAST(floor(x) AS BIGINT) + j - 1 AS b FROM q, range(4) r(i), range(4) s(j)), w AS (SELECT id, ({k('(y - a)')}) * ({k('(x - b)')}) AS w, least(greatest(a, 0), 31) AS a, least(greatest(b, 0), 63) AS b FROM t) SELECT id AS probe, {R('sum(w * value)', 'value')} FROM w JOIN px ON line = a AND pixel = b GROUP BY 1"


def _grid(spark, sf_dir, kind: str):
    grid = real(spark, sf_dir).where("line < 32").select(F.col("line").alias("iy"), F.col("pixel").alias("ix"), F.col("value").alias("v"))
    probes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("probe"), (F.col("p_size") * 0.61).alias("y"), (F.col("p_partkey") % 613 / 10.0).alias("x"))
    return joins.INTERPOLATORS[kind](probes, grid, 32, 64)


@query(_grid_sql("nearest"))
def nearest_lookup(spark, sf_dir):
    return _grid(spark, sf_dir, "nearest")


@query(_grid_sql("bicubic"))
def bicubic_lookup(spark, sf_dir):
    return _grid(spark, sf_dir, "bicubic")


_TAPS = A.low_pass(11, 0.2)


@query(f"WITH {REAL}, h AS (SELECT unnest(range(11)) AS k, unnest({_TAPS!r}) AS h), o AS (SELECT DISTINCT line, i FROM px, range(43) r(i)), s AS (SELECT o.line, o.i, sum(value * h * 2) AS v FROM o JOIN h ON (o.i * 3 + 5 - k) % 2 = 0 JOIN px ON px.line = o.line AND px.pixel * 2 = o.i * 3 + 5 - k GROUP BY 1, 2) SELECT line, CAST(i AS INTEGER) AS place, {R('v', 'value')} FROM s")
def multirate_filter(spark, sf_dir):
    x = line_arrays(real(spark, sf_dir))
    return x.select("line", F.posexplode(A.multirate(F.col("values"), _TAPS, 2, 3)).alias("place", "value"))


@query(f"{_SIGHT}, far_ AS (SELECT *, lon + 0.05 AS sl FROM d), a AS (SELECT id, cos(lat) * cos(sl) AS nx, cos(lat) * sin(sl) AS ny, sin(lat) AS nz, -dx AS lx, -dy AS ly, -dz AS lz, far FROM far_) SELECT id, {R('acos(-(nx * lx + ny * ly + nz * lz) / far)', 'look')} FROM a")
def imaging_angles(spark, sf_dir):
    p = F.col("sx"), F.col("sy"), F.col("sz")
    look = tuple(F.col(c) - F.col(f"s{c}") for c in "xyz")
    _, angle = V.viewing_angles(p, (F.lit(100.0), F.lit(-50.0), F.lit(7000.0)), look)
    return _sight(spark, sf_dir).select("id", angle.alias("look"))


@query(f"WITH {IMAGE} SELECT line, pixel, {R('atan2(sin(re * 9), cos(re * 9))', 'wrapped')} FROM cx")
def wrapped_phase(spark, sf_dir):
    return image(spark, sf_dir).select("line", "pixel", S.wrapped(F.col("re") * 9).alias("wrapped"))
