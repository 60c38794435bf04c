"""Queries of geometry, spatial joins, interference and set operations, each with its SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as S
from ..operators import imaging, kernels
from ..sources import rasters
from ..sources.rasters import table
from .raster import _GEO, IMAGE, REAL, R, image, places, query, real

E2 = 0.0066943799901
_E = math.sqrt(E2)
_A = 6378137.0


def _stereo_sql(lat0: float) -> str:
    s = math.sin(lat0)
    t = math.tan(math.pi / 4 - lat0 / 2) / ((1 - _E * s) / (1 + _E * s)) ** (_E / 2)
    k = _A * math.cos(lat0) / math.sqrt(1 - E2 * s * s) / t
    return f"{k!r} * tan(pi() / 4 - lat / 2) / pow((1 - {_E!r} * sin(lat)) / (1 + {_E!r} * sin(lat)), {_E / 2!r})"


@query(f"WITH g AS ({_GEO}), r AS (SELECT *, {_stereo_sql(math.radians(70))} AS rho FROM g WHERE lat > 0) SELECT id, round(rho * sin(lon - {math.radians(-45)!r}), 3) + 0.0 AS x, round(-rho * cos(lon - {math.radians(-45)!r}), 3) + 0.0 AS y FROM r", 3)
def projection_polar(spark, sf_dir):
    x, y = G.polar_stereographic(F.col("lon"), F.col("lat"), math.radians(-45), math.radians(70))
    return places(spark, sf_dir).where("lat > 0").select("id", x.alias("x"), y.alias("y"))


_K0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)


@query(f"WITH g AS ({_GEO}) SELECT id, round({_A * _K0!r} * lon, 3) + 0.0 AS x, round({_A / (2 * _K0)!r} * {1 - E2!r} * (sin(lat) / (1 - {E2} * sin(lat) * sin(lat)) - ln((1 - {_E!r} * sin(lat)) / (1 + {_E!r} * sin(lat))) / {2 * _E!r}), 3) + 0.0 AS y FROM g", 3)
def projection_equal_area(spark, sf_dir):
    x, y = G.equal_area(F.col("lon"), F.col("lat"), 0.0, math.radians(30))
    return places(spark, sf_dir).select("id", x.alias("x"), y.alias("y"))


def _utm_sql() -> str:
    f = 1 - math.sqrt(1 - E2)
    n = f / (2 - f)
    r = 0.9996 * _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    c = 2 * math.sqrt(n) / (1 + n)
    east = " + ".join(["eta", *(f"{k!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, k in enumerate(a, 1))])
    north = " + ".join(["xi", *(f"{k!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, k in enumerate(a, 1))])
    return (
        f"WITH g AS (SELECT id, lat, (id % 61 - 30) * 0.0017 AS d FROM ({_GEO})), t AS (SELECT *, sinh(atanh(sin(lat)) - {c!r} * atanh({c!r} * sin(lat))) AS t FROM g), "
        f"u AS (SELECT id, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM t) SELECT id, round(500000 + {r!r} * ({east}), 3) + 0.0 AS x, round({r!r} * ({north}), 3) + 0.0 AS y FROM u"
    )


@query(_utm_sql(), 3)
def projection_transverse(spark, sf_dir):
    x, y = G.transverse_mercator((F.col("id") % 61 - 30) * 0.0017, F.col("lat"), 0.0)
    return places(spark, sf_dir).select("id", x.alias("x"), y.alias("y"))


_SIGHT = f"""WITH g AS ({_GEO}), n AS (SELECT *, {_A} / sqrt(1 - {E2} * sin(lat) * sin(lat)) AS r FROM g),
p AS (SELECT id, lon, lat, (r + h) * cos(lat) * cos(lon) AS x, (r + h) * cos(lat) * sin(lon) AS y, (r * {1 - E2!r} + h) * sin(lat) AS z,
 (r + 700000) * cos(lat) * cos(lon + 0.05) AS sx, (r + 700000) * cos(lat) * sin(lon + 0.05) AS sy, (r * {1 - E2!r} + 700000) * sin(lat) AS sz FROM n),
d AS (SELECT *, sx - x AS dx, sy - y AS dy, sz - z AS dz, sqrt((sx - x) ** 2 + (sy - y) ** 2 + (sz - z) ** 2) AS far FROM p)"""


def _sight(spark, sf_dir):
    here = S.to_ecef(F.col("lon"), F.col("lat"), F.col("h"))
    there = S.to_ecef(F.col("lon") + 0.05, F.col("lat"), F.lit(700_000.0))
    names = ("x", "y", "z", "sx", "sy", "sz")
    return places(spark, sf_dir).select("id", "lon", "lat", *(c.alias(n) for n, c in zip(names, (*here, *there), strict=True)))


@query(f"{_SIGHT} SELECT id, {R('(dy * cos(lon) - dx * sin(lon)) / far', 'east')}, {R('(dz * cos(lat) - sin(lat) * (dx * cos(lon) + dy * sin(lon))) / far', 'north')}, {R('(dz * sin(lat) + cos(lat) * (dx * cos(lon) + dy * sin(lon))) / far', 'up')} FROM d")
def line_of_sight(spark, sf_dir):
    d = [F.col(f"s{c}") - F.col(c) for c in "xyz"]
    far = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    enu = G.east_north_up(F.col("lon"), F.col("lat"), [c / far for c in d])
    return _sight(spark, sf_dir).select("id", *(c.alias(n) for n, c in zip(("east", "north", "up"), enu, strict=True)))


_B = ("(30.0 + id % 7)", "(-20.0)", "(50.0 - id % 5)")
_PAR = f"(({_B[0]} * -dx + {_B[1]} * -dy + {_B[2]} * -dz) / far)"


@query(f"{_SIGHT} SELECT id, round({_PAR}, 4) + 0.0 AS parallel, round(sqrt({_B[0]} ** 2 + {_B[1]} ** 2 + {_B[2]} ** 2 - {_PAR} ** 2), 4) + 0.0 AS across FROM d", 4)
def baselines(spark, sf_dir):
    first = [F.col(c) for c in ("sx", "sy", "sz")]
    step = (30.0 + F.col("id") % 7, F.lit(-20.0), 50.0 - F.col("id") % 5)
    parallel, across = G.baseline(first, [a + b for a, b in zip(first, step, strict=True)], [F.col(c) for c in "xyz"])
    return _sight(spark, sf_dir).select("id", parallel.alias("parallel"), across.alias("across"))


@query(
    f"WITH {REAL}, q AS (SELECT line, pixel, value, 1.0 / pow(0.5 + pixel % 3, 2) AS q FROM px) SELECT line, pixel, {R('sum(q * value) OVER w / sum(q) OVER w', 'value')}, {R('1 / sqrt(sum(q) OVER w)', 'sigma')} FROM q WINDOW w AS (PARTITION BY line ORDER BY pixel ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
)
def sigma_filter(spark, sf_dir):
    return imaging.sigma_weighted(real(spark, sf_dir).withColumn("sigma", 0.5 + F.col("pixel") % 3), 2)


@query(
    f"WITH {REAL}, h AS (SELECT line, pixel, CASE WHEN (line + pixel) % 9 <> 0 THEN value END AS v FROM px), a AS (SELECT *, sum(v) OVER w AS s, count(v) OVER w AS n FROM h WINDOW w AS (PARTITION BY line ORDER BY pixel ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT line, pixel, {R('coalesce(v, sum(s) OVER d / sum(n) OVER d)', 'value')} FROM a WINDOW d AS (PARTITION BY pixel ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
)
def gap_fill(spark, sf_dir):
    x = real(spark, sf_dir)
    return imaging.local_mean_fill(x.withColumn("value", F.when((F.col("line") + F.col("pixel")) % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value"))), 1)


_POW = f"{REAL}, p AS (SELECT line, pixel, value * value + 0.01 AS v FROM px)"


@query(
    f"WITH {_POW}, m AS (SELECT pixel, avg(v) OVER (PARTITION BY pixel ORDER BY line ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM p), s AS (SELECT pixel, avg(m) AS a, stddev_pop(m) AS d FROM m GROUP BY 1) SELECT pixel, count(*) FILTER ((m - a) / d > 1.5) AS hits, {R('max((m - a) / d)', 'highest')} FROM m JOIN s USING (pixel) GROUP BY 1"
)
def narrowband_interference(spark, sf_dir):
    return imaging.narrowband_hits(real(spark, sf_dir).withColumn("value", F.col("value") * F.col("value") + 0.01), 4, 1.5)


@query(
    f"WITH {_POW}, m AS (SELECT line, CAST(pixel AS DOUBLE) AS x, 10 * log10(avg(v) OVER (PARTITION BY line ORDER BY pixel ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS m FROM p), f AS (SELECT line, regr_slope(m, x) AS k, regr_intercept(m, x) AS b FROM m GROUP BY 1), e AS (SELECT line, m - b - k * x AS r FROM m JOIN f USING (line)), s AS (SELECT line, stddev_pop(r) AS d FROM e GROUP BY 1) SELECT line, count(*) FILTER (r / d > 1.5) AS hits FROM e JOIN s USING (line) GROUP BY 1"
)
def wideband_interference(spark, sf_dir):
    return imaging.wideband_hits(real(spark, sf_dir).withColumn("value", F.col("value") * F.col("value") + 0.01), 3, 1.5)


@query(
    f"WITH c AS (SELECT (p_partkey % 97) * 0.31 AS y0, (p_partkey % 97) * 0.31 + 0.4 + p_size * 0.03 AS y1, p_partkey % 89 * 0.27 AS x0, p_partkey % 89 * 0.27 + 1.3 AS x1, p_retailprice AS value FROM part), e AS (SELECT *, unnest(range(CAST(floor(y0) AS BIGINT), CAST(ceil(y1) AS BIGINT))) AS line FROM c), g AS (SELECT *, unnest(range(CAST(floor(x0) AS BIGINT), CAST(ceil(x1) AS BIGINT))) AS pixel FROM e), w AS (SELECT *, (least(line + 1, y1) - greatest(line, y0)) * (least(pixel + 1, x1) - greatest(pixel, x0)) AS w FROM g) SELECT line, pixel, round(sum(w * value) / sum(w), 5) + 0.0 AS value, round(sum(w), 5) + 0.0 AS looks FROM w GROUP BY 1, 2", 5
)
def area_projection(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    y, x = F.col("p_partkey") % 97 * F.lit(0.31), F.col("p_partkey") % 89 * F.lit(0.27)
    return imaging.area_geocode(p.select(y.alias("y0"), (y + 0.4 + F.col("p_size") * 0.03).alias("y1"), x.alias("x0"), (x + 1.3).alias("x1"), F.col("p_retailprice").alias("value")))


@query(
    "WITH f AS (SELECT p_partkey % 83 * 0.37 AS y, p_partkey % 79 * 0.41 AS x, p_retailprice AS a FROM part), g AS (SELECT *, CAST(floor(y) AS BIGINT) AS i, CAST(floor(x) AS BIGINT) AS j FROM f), n AS (SELECT i + di AS line, j + dj AS pixel, a * (CASE WHEN di = 1 THEN y - i ELSE 1 - y + i END) * (CASE WHEN dj = 1 THEN x - j ELSE 1 - x + j END) AS v FROM g, range(2) a(di), range(2) b(dj)) SELECT line, pixel, round(sum(v), 5) + 0.0 AS area FROM n GROUP BY 1, 2", 5
)
def facet_scatter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return imaging.scatter(p.select((F.col("p_partkey") % 83 * F.lit(0.37)).alias("y"), (F.col("p_partkey") % 79 * F.lit(0.41)).alias("x"), F.col("p_retailprice").alias("area")))


_PH = 4 * math.pi * 0.3 / 0.24


@query(
    f"WITH {IMAGE}, t AS (SELECT vec_id AS target, vec_id AS mid, CAST(vec_id % 20 AS DOUBLE) AS near FROM embeddings), x AS (SELECT target, re, im, pixel, near + CAST((line - mid) * (line - mid) AS DOUBLE) / 18 AS place FROM t JOIN cx ON line BETWEEN mid - 4 AND mid + 4) SELECT target, {R(f'sum(re * cos({_PH!r} * place) - im * sin({_PH!r} * place))', 're')}, {R(f'sum(re * sin({_PH!r} * place) + im * cos({_PH!r} * place))', 'im')}, count(*) AS pulses FROM x WHERE floor(place) = pixel GROUP BY 1"
)
def back_projection(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("target"), F.col("vec_id").alias("at"), (F.col("vec_id") % 20).cast("double").alias("near"))
    return imaging.back_projection(image(spark, sf_dir), ids, 4, 0.24, 0.3)


@query(
    "WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t, value FROM events), n AS (SELECT user_id, t, value FROM e WHERE event_type <> 'view' AND value IS NOT NULL), a AS (SELECT p.user_id, p.event_id, p.t, n.t AS t0, n.value AS v0 FROM (SELECT * FROM e WHERE event_type = 'view') p ASOF LEFT JOIN n ON p.user_id = n.user_id AND p.t >= n.t), b AS (SELECT a.*, m.t AS t1, m.value AS v1 FROM a ASOF LEFT JOIN n m ON a.user_id = m.user_id AND a.t < m.t) SELECT user_id, event_id AS probe, round(CASE WHEN t0 IS NULL OR t1 - t < t - t0 THEN v1 ELSE v0 END, 6) + 0.0 AS value FROM b"
)
def nearest_node(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    nodes = e.where("event_type <> 'view' and value is not null").select("user_id", "t", F.col("value").alias("v"))
    return imaging.nearest(e.where("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("probe")), nodes, "user_id")


_SQUARE = [(0.0, 0.0), (40.0, -5.0), (60.0, 30.0), (25.0, 18.0), (5.0, 45.0)]


def _inside_sql() -> str:
    edges = []
    for (x1, y1), (x2, y2) in zip(_SQUARE, _SQUARE[1:] + _SQUARE[:1], strict=True):
        edges.append(f"CASE WHEN y >= {min(y1, y2)} AND y < {max(y1, y2)} AND x < {x1} + (y - {y1}) * {(x2 - x1) / (y2 - y1)!r} THEN 1 ELSE 0 END")
    return f"WITH p AS (SELECT p_partkey AS id, CAST(p_partkey % 67 - 2 AS DOUBLE) AS x, CAST(p_size - 4 AS DOUBLE) AS y FROM part) SELECT id, ({' + '.join(edges)}) % 2 = 1 AS inside FROM p"


@query(_inside_sql())
def point_in_polygon(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 67 - 2.0).alias("x"), (F.col("p_size") - 4.0).alias("y"))
    return p.select("id", G.inside(F.col("x"), F.col("y"), _SQUARE).alias("inside"))


@query(
    f"SELECT i AS place, {R('(SELECT sum(pow(6.25 * (1 - pow(2.0 * i / 63 - 1, 2)) / 4 * 1.0, k) / pow(CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE), 2)) FROM range(25) k(k)) / (SELECT sum(pow(6.25 / 4, k) / pow(CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE), 2)) FROM range(25) k(k))', 'kaiser')}, {R('1 - 0.7 * pow(sin(pi() * (i / 63.0 - 0.5)), 2)', 'cosine')}, {R('cos(pi() * 4e5 * pow((i - 31.5) / 1e4, 2))', 're')}, {R('sin(pi() * 4e5 * pow((i - 31.5) / 1e4, 2))', 'im')} FROM range(64) t(i)"
)
def windows_and_chirp(spark, sf_dir):
    i = F.col("id")
    angle = math.pi * 4e5 * F.pow((i - 31.5) / 1e4, F.lit(2.0))
    return spark.range(64).select(i.alias("place"), G.kaiser(i, 64, 2.5).alias("kaiser"), G.raised_cosine(i, 64, 0.3).alias("cosine"), F.cos(angle).alias("re"), F.sin(angle).alias("im"))


@query(
    "SELECT l_returnflag AS flag, l_linestatus AS status, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n, round(avg(l_quantity), 6) + 0.0 AS mean, round(stddev_samp(l_quantity), 6) + 0.0 AS deviation FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"
)
def stats_rollup(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").rollup(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return x.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("deviation"))


_SETS = "WITH a AS (SELECT DISTINCT n_regionkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000), b AS (SELECT DISTINCT n_regionkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 3000)"


@query(f"{_SETS} SELECT 'both' AS kind, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'second', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a)")
def channel_sets(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    a = table(spark, sf_dir, "customer").where("c_acctbal > 5000").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("k"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("k"))
    kinds = {"both": a.intersect(b), "first": a.subtract(b), "second": b.subtract(a)}
    both, first, second = (x.select(F.lit(k).alias("kind"), "k") for k, x in kinds.items())
    return both.unionByName(first).unionByName(second)


@query("SELECT c_custkey, 'C_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '_' || upper(substr(c_mktsegment, 1, 4)) AS granule, CASE WHEN regexp_matches(c_mktsegment, '^[A-M]') THEN 'low' ELSE 'high' END AS half FROM customer")
def granule_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat_ws("_", F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.upper(F.substring("c_mktsegment", 1, 4)))
    return c.select("c_custkey", name.alias("granule"), F.when(F.col("c_mktsegment").rlike("^[A-M]"), "low").otherwise("high").alias("half"))


@query(
    f"WITH {REAL}, s AS (SELECT line, pixel, sign(value) AS v FROM px), c AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN NULL ELSE pixel END AS f FROM s WINDOW w AS (PARTITION BY line ORDER BY pixel)), l AS (SELECT *, last_value(f IGNORE NULLS) OVER (PARTITION BY line ORDER BY pixel ROWS UNBOUNDED PRECEDING) AS label FROM c) SELECT line, label, count(*) AS size FROM l GROUP BY 1, 2 HAVING count(*) >= 3"
)
def line_regions(spark, sf_dir):
    x = imaging.line_regions(real(spark, sf_dir).withColumn("value", F.signum("value")))
    return x.where("size >= 3 and label = pixel").select("line", "label", "size")


@query(
    f"WITH {REAL} SELECT line, CAST(k AS INTEGER) AS bin, round(pow(sum(value * cos(2 * pi() * k * pixel / 64)), 2) + pow(sum(value * sin(2 * pi() * k * pixel / 64)), 2), 5) + 0.0 AS power FROM px, range(64) t(k) GROUP BY 1, 2", 5
)
def line_spectrum(spark, sf_dir):
    return kernels.spectrum(rasters.line_arrays(real(spark, sf_dir)))


@query(f"WITH {REAL} SELECT line, CAST(j AS INTEGER) AS place, {R('sum(value * CASE WHEN j = pixel THEN 1.0 ELSE 0.0 END)', 'value')} FROM (SELECT line, (pixel + 3) % 64 AS pixel, value FROM px), range(64) t(j) GROUP BY 1, 2")
def shifted_lines(spark, sf_dir):
    """By whole samples here, so that SQL can say it; tests hold parts of a sample against closed forms."""
    x = kernels.shifted(rasters.line_arrays(real(spark, sf_dir)), 3.0)
    return x.select("line", F.posexplode("values").alias("place", "value"))


@query()
def eigen_interference(spark, sf_dir):
    return imaging.eigen_interference(image(spark, sf_dir), 16, 8.0)


def _newton_sql(steps: int = 12) -> str:
    """Zero-Doppler times on a circular polar orbit by so many Newton steps, as the operator takes them."""
    r, w = 7.1e6, 1.05e-3
    p = f"{r!r} * cos({w!r} * t)", f"{r!r} * sin({w!r} * t)"
    v = f"-{r * w!r} * sin({w!r} * t)", f"{r * w!r} * cos({w!r} * t)"
    along = f"((x - {p[0]}) * {v[0]} + (z - {p[1]}) * {v[1]})"
    inward = f"((x - {p[0]}) * {p[0]} + (z - {p[1]}) * {p[1]})"
    parts = [f"WITH g AS (SELECT id, (id % 9 - 4) * 0.01 AS lon, lat, h FROM ({_GEO})), n AS (SELECT *, {_A} / sqrt(1 - {E2} * sin(lat) * sin(lat)) AS n FROM g), s0 AS (SELECT id, (n + h) * cos(lat) * cos(lon) AS x, (n + h) * cos(lat) * sin(lon) AS y, (n * {1 - E2!r} + h) * sin(lat) AS z, atan2((n * {1 - E2!r} + h) * sin(lat), (n + h) * cos(lat) * cos(lon)) / {w!r} + 0.3 AS t FROM n)"]
    parts += [f"s{i + 1} AS (SELECT id, x, y, z, t + {along} / ({(r * w) ** 2!r} + {w * w!r} * {inward}) AS t FROM s{i})" for i in range(steps)]
    return ", ".join(parts) + f" SELECT id, {R('t', 'time')}, round(sqrt(pow(x - {p[0]}, 2) + y * y + pow(z - {p[1]}, 2)), 3) + 0.0 AS slant FROM s{steps}"


@query(_newton_sql())
def radar_coordinates(spark, sf_dir):
    xyz = S.to_ecef((F.col("id") % 9 - 4) * 0.01, F.col("lat"), F.col("h"))
    x = imaging.radar_coordinates(places(spark, sf_dir).select("id", *(c.alias(n) for c, n in zip(xyz, "xyz", strict=True))))
    return x.select("id", "time", F.round("slant", 3).alias("slant"))
