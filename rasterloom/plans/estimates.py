"""Queries of estimators, stencils and masks, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import estimators as E
from ..sources.rasters import table
from .raster import _QUAD, IMAGE, REAL, WHOLE, R, image, quad, query, real, shape
from .samples import D


@query(f"WITH {IMAGE} SELECT count(*) AS n, {R('min(re)', 'low_re')}, {R('max(re)', 'high_re')}, {R('avg(re)', 'mean_re')}, {R('stddev_samp(re)', 'deviation_re')}, {R('min(im)', 'low_im')}, {R('max(im)', 'high_im')}, {R('avg(im)', 'mean_im')}, {R('stddev_samp(im)', 'deviation_im')} FROM cx WHERE line % 32 <> pixel")
def part_statistics(spark, sf_dir):
    x = image(spark, sf_dir)
    return E.part_stats(x.withColumn("im", F.when(F.col("line") % 32 == F.col("pixel"), F.lit(float("nan"))).otherwise(F.col("im"))))


@query(f"SELECT {R('min(s_acctbal)', 'low')}, {R('max(s_acctbal)', 'high')}, {R('avg(s_acctbal)', 'mean')} FROM supplier WHERE s_suppkey % 4 > 0")
def height_extent(spark, sf_dir):
    return E.extent(table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 4 == 0, -9999.0).otherwise(F.col("s_acctbal")).alias("value")), -9999.0)


@query(f"WITH {IMAGE}, {WHOLE.format(l=3, p=5, t='cx')} SELECT line // 3 AS line, pixel // 5 AS pixel, {R('sum(re * (1 + pixel % 3)) / sum(1 + pixel % 3)', 're')}, {R('sum(im * (1 + pixel % 3)) / sum(1 + pixel % 3)', 'im')}, {D('sum(1 + pixel % 3)', 'weight')} FROM cx, lim WHERE line // 3 < lim.l AND pixel // 5 < lim.p GROUP BY 1, 2")
def weighted_complex_looks(spark, sf_dir):
    return E.weighted_looks(image(spark, sf_dir).withColumn("weight", 1.0 + F.col("pixel") % 3), 3, 5, shape(spark, sf_dir, 2))


@query(f"WITH {REAL}, {WHOLE.format(l=2, p=2, t='px')} SELECT line // 2 AS line, pixel // 2 AS pixel, round(coalesce(avg(value) FILTER (value > 0), CAST(-9999 AS DOUBLE)), 6) + 0.0 AS mean, count(*) FILTER (value > 0) AS n FROM px, lim WHERE line // 2 < lim.l AND pixel // 2 < lim.p GROUP BY 1, 2")
def looks_without_nodata(spark, sf_dir):
    x = real(spark, sf_dir).withColumn("value", F.when(F.col("value") > 0, F.col("value")).otherwise(-9999.0))
    return E.looks_without(x, 2, 2, shape(spark, sf_dir), -9999.0)


@query(f"WITH {REAL} SELECT pixel AS x, {R('avg(value)', 'v')} FROM px GROUP BY 1")
def averaged_table(spark, sf_dir):
    return E.averaged_table(real(spark, sf_dir).select(F.col("line").alias("y"), F.col("pixel").alias("x"), F.col("value").alias("v")), "x")


@query(f"WITH {IMAGE}, w AS (SELECT line // 20 AS id, re, im, abs(pixel % 7 - 3.0) AS w FROM cx) SELECT id, {D('sum(w * re) / sum(w)', 're')}, {D('sum(w * im) / sum(w)', 'im')}, {D('sum(w) * 4', 'looks')} FROM w GROUP BY 1")
def polygon_mean(spark, sf_dir):
    return E.polygon_mean(image(spark, sf_dir).select(F.floor(F.col("line") / 20).alias("id"), "re", "im", (F.col("pixel") % 7 - 3.0).alias("weight")), 4.0)


_HITS = f"{REAL}, h AS (SELECT line, pixel, CAST(floor(abs(value) * 10) AS BIGINT) AS nb, CAST(floor(abs(value) * 7) AS BIGINT) AS wb FROM px)"


@query(f"WITH {_HITS}, q AS (SELECT quantile_cont(nb, 0.9) AS a, quantile_cont(wb, 0.9) AS b FROM h) SELECT line, pixel, nb > a OR wb > b AS mask FROM h, q")
def interference_mask(spark, sf_dir):
    v = F.abs("value")
    return E.interference_mask(real(spark, sf_dir).select("line", "pixel", F.floor(v * 10).alias("nb"), F.floor(v * 7).alias("wb")), 0.1)


@query(f"WITH {REAL}, b AS (SELECT line, pixel // 16 AS b, max(CAST(value > 0.3 AS INTEGER)) AS f FROM px GROUP BY 1, 2) SELECT {R('avg(f)', 'likelihood')}, count(*) AS n FROM b")
def interference_likelihood(spark, sf_dir):
    return E.interference_share(real(spark, sf_dir).select("line", F.floor(F.col("pixel") / 16).alias("block"), (F.col("value") > 0.3).alias("flag")))


_SIGNS = f"{IMAGE}, s AS (SELECT line, pixel, CASE WHEN re < 0 THEN -1.0 ELSE 1.0 END AS i, CASE WHEN im < 0 THEN -1.0 ELSE 1.0 END AS q FROM cx), l AS (SELECT *, lag(i) OVER w AS i0, lag(q) OVER w AS q0 FROM s WINDOW w AS (PARTITION BY pixel ORDER BY line))"


@query(f"WITH {_SIGNS}, m AS (SELECT pixel, sin(pi() / 2 * avg(i * i0)) AS ii, sin(pi() / 2 * avg(q * q0)) AS qq, sin(pi() / 2 * avg(q * i0)) AS qi, sin(pi() / 2 * avg(i * q0)) AS iq FROM l WHERE i0 IS NOT NULL GROUP BY 1) SELECT pixel, {R('1500 / (2 * pi()) * atan2(qi - iq, ii + qq)', 'doppler')} FROM m")
def doppler_by_sign(spark, sf_dir):
    return E.doppler_by_sign(image(spark, sf_dir), 1500.0)


@query(f"WITH {IMAGE}, p AS (SELECT a.line, a.pixel, a.re*b.re + a.im*b.im AS x, a.im*b.re - a.re*b.im AS y FROM cx a JOIN cx b ON a.line = b.line AND b.pixel = 31 - a.pixel), l AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY pixel ORDER BY line)), m AS (SELECT pixel, avg(x*x0 + y*y0) AS u, avg(y*x0 - x*y0) AS v FROM l WHERE x0 IS NOT NULL GROUP BY 1) SELECT pixel, {R('1500 / (2 * pi() * 0.5) * atan2(v, u)', 'doppler')} FROM m")
def doppler_by_looks(spark, sf_dir):
    x = image(spark, sf_dir)
    other = x.select("line", (31 - F.col("pixel")).alias("pixel"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    return E.doppler_by_looks(x.join(other, ["line", "pixel"]), 1500.0, 0.5)


_GAPS = f"{IMAGE}, l AS (SELECT pixel // 8 AS block, re - lag(re) OVER w AS dr, im - lag(im) OVER w AS di FROM cx WINDOW w AS (PARTITION BY pixel ORDER BY line)), g AS (SELECT block, dr*dr + di*di AS p FROM l WHERE dr IS NOT NULL)"


@query(f"WITH {_GAPS}, m AS (SELECT block, avg(p) AS m FROM g GROUP BY 1) SELECT block, {R('avg(p) / 2', 'noise')} FROM g JOIN m USING (block) WHERE sqrt(p) < 2 * sqrt(m) GROUP BY 1")
def noise_trimmed(spark, sf_dir):
    return E.noise_trimmed(image(spark, sf_dir), 8)


@query()
def noise_by_eigenvalue(spark, sf_dir):
    return E.noise_by_eigenvalue(image(spark, sf_dir), 8)


@query(f"WITH {_QUAD}, c AS (SELECT line // 50 AS block, vh_re-hv_re AS a, vh_im-hv_im AS b, hh_re+vv_re AS c, hh_im+vv_im AS d FROM q), m AS (SELECT block, avg(a*a + b*b) AS x, avg(c*c + d*d) AS y, avg((a*c + b*d) / (c*c + d*d)) AS s FROM c GROUP BY 1) SELECT block, {R('0.5 * sign(s) * atan(sqrt(x / y))', 'rotation')}, {R('sqrt(x + y)', 'magnitude')} FROM m")
def faraday_by_powers(spark, sf_dir):
    return E.faraday_by_powers(quad(spark, sf_dir), 50)


@query(f"WITH {_QUAD}, c AS (SELECT line // 10 AS id, line, pixel, vh_re-hv_re AS a, vh_im-hv_im AS b, hh_re+vv_re AS c, hh_im+vv_im AS d FROM q), r AS (SELECT id, (a*c + b*d) / (c*c + d*d) AS r, row_number() OVER (PARTITION BY id ORDER BY c*c + d*d DESC, line, pixel) AS i FROM c) SELECT id, {R('0.5 * atan(r)', 'rotation')} FROM r WHERE i = 1")
def faraday_of_reflector(spark, sf_dir):
    return E.faraday_of_reflector(quad(spark, sf_dir).withColumn("id", F.floor(F.col("line") / 10)))


@query(f"WITH {_QUAD}, m AS (SELECT line // 50 AS block, avg(vh_re*hv_re + vh_im*hv_im) AS x, avg(vh_im*hv_re - vh_re*hv_im) AS y, avg(hv_re*hv_re + hv_im*hv_im) AS p FROM q GROUP BY 1) SELECT block, {R('sqrt(x*x + y*y) / p', 'amplitude')}, {R('atan2(y, x)', 'phase')} FROM m")
def channel_imbalance(spark, sf_dir):
    return E.channel_imbalance(quad(spark, sf_dir), 50)


@query(f"WITH {IMAGE} SELECT pixel // 4 AS block, {R('10 * log10(avg(re*re + im*im))', 'power')} FROM cx GROUP BY 1")
def echo_pattern(spark, sf_dir):
    return E.echo_pattern(image(spark, sf_dir), 4)


def _parabola_sql() -> str:
    s = ", ".join([*(f"sum(pow(x, {k})) AS s{k}" for k in range(5)), *(f"sum(pow(x, {k}) * y) AS t{k}" for k in range(3))])
    det = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"
    m, t = [["s0", "s1", "s2"], ["s1", "s2", "s3"], ["s2", "s3", "s4"]], ["t0", "t1", "t2"]
    top = [det(*[[t[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]) for k in range(3)]
    return f"WITH {REAL}, p AS (SELECT line // 5 AS g, pixel / 64.0 AS x, value AS y FROM px), s AS (SELECT g, {s} FROM p GROUP BY 1) SELECT g AS \"group\", " + ", ".join(f"round({top[k]} / {det(*m)}, 4) + 0.0 AS c{k}" for k in range(3)) + " FROM s"


@query(_parabola_sql(), 4)
def polynomial_fit(spark, sf_dir):
    x = E.polynomial_fit(real(spark, sf_dir).select(F.floor(F.col("line") / 5).alias("group"), (F.col("pixel") / 64.0).alias("x"), F.col("value").alias("y")), 2)
    return x.select("group", *(F.col("coefficients")[k].alias(f"c{k}") for k in range(3)))


@query("SELECT CAST(g AS BIGINT) AS \"group\", CAST(3 AS DOUBLE) AS c0, CAST(2 + g AS DOUBLE) AS c1, CAST(-1 AS DOUBLE) AS c2, CAST(0.5 AS DOUBLE) AS c3, CAST(g AS DOUBLE) AS c4, CAST(-0.25 AS DOUBLE) AS c5 FROM range(4) r(g)", 4)
def bivariate_fit(spark, sf_dir):
    """A surface of known coefficients over the raster's places, found again."""
    g, x, y = F.floor(F.col("line") % 4), F.col("line") % 29 / 29.0, F.col("pixel") / 64.0
    v = 3 + (2 + g) * y - x + 0.5 * y * y + g * x * y - 0.25 * x * x
    p = E.bivariate_fit(real(spark, sf_dir).select(g.alias("group"), x.alias("x"), y.alias("y"), v.alias("v")), 2)
    return p.select("group", *(F.col("coefficients")[k].alias(f"c{k}") for k in range(6)))


@query(f"WITH {REAL} SELECT {R('min(value)', 'low')}, {R('max(value)', 'high')} FROM px WHERE (line + pixel) % 3 = 0")
def masked_extrema(spark, sf_dir):
    return E.masked_extrema(real(spark, sf_dir).withColumn("mask", (F.col("line") + F.col("pixel")) % 3 == 0))


@query(f"SELECT p_brand AS swath, {R('min(p_retailprice)', 't0')}, {R('max(p_retailprice + p_size)', 't1')} FROM part GROUP BY 1")
def spans_union(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return E.spans_union(p.select(F.col("p_brand").alias("swath"), F.col("p_retailprice").alias("t0"), (F.col("p_retailprice") + F.col("p_size")).alias("t1")), "swath")


@query(f"WITH v AS (SELECT event_type AS \"group\", value FROM events WHERE value IS NOT NULL), m AS (SELECT \"group\", median(value) AS median FROM v GROUP BY 1) SELECT \"group\", {R('median', 'median')}, {R('median(abs(value - median))', 'mad')} FROM v JOIN m USING (\"group\") GROUP BY \"group\", m.median")
def median_deviation(spark, sf_dir):
    return E.median_deviation(table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("group"), "value"))


@query(f"WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap FROM events) SELECT user_id, round(1 / avg(gap), 7) + 0.0 AS mean, round(1 / min(gap), 7) + 0.0 AS highest FROM g WHERE gap > 0 GROUP BY 1", 7)
def repetition_frequency(spark, sf_dir):
    return E.repetition(table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")), "user_id")


@query("SELECT l_returnflag AS product, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS channels FROM lineitem GROUP BY 1")
def channels_of_product(spark, sf_dir):
    x = E.values_of(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("product"), "l_linestatus"), "product", "l_linestatus")
    return x.select("product", F.array_join("values", ",").alias("channels"))


_W = "CASE WHEN (line + 2 * pixel) % 7 = 0 THEN 0.0 ELSE 1.0 + pixel % 2 END"


def _smooth_sql() -> str:
    a, r = "OVER (PARTITION BY line ORDER BY pixel)", "OVER (PARTITION BY pixel ORDER BY line)"
    row = lambda c, w: f"0.25 * coalesce(lag({c}) {w}, 0) + 0.5 * {c} + 0.25 * coalesce(lead({c}) {w}, 0)"
    return f"WITH {REAL}, w AS (SELECT *, {_W} AS w, {_W} * value AS x FROM px), a AS (SELECT line, pixel, w, {row('x', a)} AS x1, {row('w', a)} AS w1 FROM w), b AS (SELECT line, pixel, w, {row('x1', r)} AS s, {row('w1', r)} AS n FROM a) SELECT line // 2 AS line, pixel // 3 AS pixel, CASE WHEN w = 0 THEN NULL WHEN n = 0 THEN 0.0 ELSE round(CAST(s / n AS DOUBLE), 6) + 0.0 END AS value FROM b WHERE line % 2 = 0 AND pixel % 3 = 0"


@query(_smooth_sql())
def masked_filter(spark, sf_dir):
    w = F.when((F.col("line") + 2 * F.col("pixel")) % 7 == 0, 0.0).otherwise(1.0 + F.col("pixel") % 2)
    k = [0.25, 0.5, 0.25]
    return E.smoothed(real(spark, sf_dir).withColumn("weight", w), k, k, (2, 3))


_NINE = "SELECT a.line, a.pixel, median(b.value) AS m FROM px a, (SELECT unnest([-1, 0, 1]) AS dl), (SELECT unnest([-1, 0, 1]) AS dp), lim, px b WHERE b.line = least(greatest(a.line + dl, 0), lim.l) AND b.pixel = least(greatest(a.pixel + dp, 0), 63) GROUP BY 1, 2"


@query(f"WITH {REAL}, lim AS (SELECT max(line) AS l FROM px), n AS ({_NINE}) SELECT line, pixel, {R('m', 'value')} FROM n")
def median_filter_2d(spark, sf_dir):
    return E.median2d(real(spark, sf_dir))


@query(f"WITH {REAL}, lim AS (SELECT max(line) AS l FROM px), n AS ({_NINE}), d AS (SELECT line, pixel, value - m AS d FROM px JOIN n USING (line, pixel)), s AS (SELECT stddev_pop(d) AS s FROM d) SELECT line, pixel, abs(d) < 3 * s AS valid FROM d, s")
def outlier_mask(spark, sf_dir):
    return E.outlier_mask(real(spark, sf_dir))


@query(f"WITH {REAL}, a AS (SELECT line, pixel, sum(value) OVER (PARTITION BY line ORDER BY pixel ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM px) SELECT line, pixel, {R('sum(s) OVER (PARTITION BY pixel ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 25', 'value')} FROM a")
def boxcar_filter(spark, sf_dir):
    return E.boxcar(real(spark, sf_dir), 2)


def _gradient_sql() -> str:
    g = [math.exp(-(k * k) / 1.5) for k in (-1, 0, 1)]
    a, r = "OVER (PARTITION BY line ORDER BY pixel)", "OVER (PARTITION BY pixel ORDER BY line)"
    row = lambda c, w: f"{g[0]!r} * coalesce(lag({c}) {w}, 0) + {g[1]!r} * coalesce({c}, 0) + {g[2]!r} * coalesce(lead({c}) {w}, 0) AS {c}"
    names = ("xr", "xi", "yr", "yi")
    return (
        f"{IMAGE}, lim AS (SELECT max(line) + 1 AS n FROM cx), l AS (SELECT *, lag(re) {a} AS lr, lag(im) {a} AS li, lag(re) {r} AS ur, lag(im) {r} AS ui FROM cx), z AS (SELECT line, pixel, re*lr + im*li AS xr, im*lr - re*li AS xi, re*ur + im*ui AS yr, im*ur - re*ui AS yi FROM l), "
        f"c AS (SELECT line, pixel, {', '.join(row(x, a) for x in names)} FROM z), d AS (SELECT line, pixel, {', '.join(row(x, r) for x in names)} FROM c), "
        "gr AS (SELECT line, pixel, CASE WHEN line > 1 AND line < n - 1 AND pixel > 1 AND pixel < 31 THEN atan2(xi, xr) ELSE CAST(0 AS DOUBLE) END AS gx, CASE WHEN line > 1 AND line < n - 1 AND pixel > 1 AND pixel < 31 THEN atan2(yi, yr) ELSE CAST(0 AS DOUBLE) END AS gy FROM d, lim)"
    )


@query(f"WITH {_gradient_sql()} SELECT line, pixel, {R('gx', 'across')}, {R('gy', 'along')} FROM gr")
def smooth_gradient(spark, sf_dir):
    return E.smooth_gradient(image(spark, sf_dir), 3, shape(spark, sf_dir, 2))


@query(f"WITH {_gradient_sql()}, s AS (SELECT avg(re*re + im*im) AS m, stddev_pop(re*re + im*im) AS d FROM cx, lim WHERE line >= 16 AND line < n - 16 AND pixel >= 4 AND pixel < 28 AND (line - 16) % 4 = 0 AND (pixel - 4) % 4 = 0) SELECT line, pixel, abs(gx) > 2.5 OR re*re + im*im > m + 1.5 * d AND pixel % 10 / 10.0 < 0.8 AS neutron FROM cx JOIN gr USING (line, pixel), s")
def neutrons(spark, sf_dir):
    size = shape(spark, sf_dir, 2)
    x = image(spark, sf_dir)
    g = E.smooth_gradient(x, 3, size).select("line", "pixel", "across")
    return E.neutrons(x.join(g, ["line", "pixel"]).withColumn("corr", F.col("pixel") % 10 / 10.0), size, 2.5, 1.5, 0.8, (16, 4))


def _hits_sql(width: int, cut: float, axis: str, group: str, detrend: bool) -> str:
    m = f"avg(v) OVER (PARTITION BY {group} ORDER BY {axis} ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)"
    n = f"count(*) OVER (PARTITION BY {group} ORDER BY {axis} ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)"
    rest = f"f AS (SELECT {axis}, regr_slope(m, CAST({group} AS DOUBLE)) AS a, regr_intercept(m, CAST({group} AS DOUBLE)) AS b FROM m1 GROUP BY 1), m2 AS (SELECT line, pixel, m - b - a * {group} AS m FROM m1 JOIN f USING ({axis}))" if detrend else "m2 AS (SELECT * FROM m1)"
    return (
        f"WITH {REAL}, p AS (SELECT line, pixel, value * value + 0.01 AS v FROM px), m0 AS (SELECT line, pixel, {m} AS m, {n} AS n FROM p), m1 AS (SELECT line, pixel, {'log10(m)' if detrend else 'm'} AS m FROM m0 WHERE n = {width}), {rest}, "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY {axis} ORDER BY m) AS i, count(*) OVER (PARTITION BY {axis}) AS k FROM m2), s AS (SELECT {axis}, avg(m) AS mu, stddev_pop(m) AS sd FROM r WHERE i > round_even(k * 0.05, 0) AND i <= k - round_even(k * 0.05, 0) GROUP BY 1), "
        f"h AS (SELECT line, pixel, CAST(m - mu > {cut!r} * sd AS INTEGER) AS h FROM m2 JOIN s USING ({axis})), a AS (SELECT p.line, p.pixel, h FROM p LEFT JOIN h USING (line, pixel)) "
        f"SELECT line, pixel, coalesce(CAST(sum(h) OVER (PARTITION BY {group} ORDER BY {axis} ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW) AS BIGINT), 0) AS hits FROM a"
    )


@query(_hits_sql(5, E.normal_quantile(0.98), "line", "pixel", False))
def narrowband_hits(spark, sf_dir):
    return E.sharp_hits(real(spark, sf_dir).withColumn("value", F.col("value") * F.col("value") + 0.01), 5, 0.02, 0.1)


@query(_hits_sql(7, E.normal_quantile(0.98), "pixel", "line", True))
def wideband_hits(spark, sf_dir):
    return E.sharp_hits(real(spark, sf_dir).withColumn("value", F.col("value") * F.col("value") + 0.01), 7, 0.02, 0.1, "pixel", "line", True)


@query(f"WITH {REAL}, v AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY abs(value) DESC, pixel) - 1 AS i, 10 * log10(abs(value)) AS d FROM px WHERE value <> 0), s AS (SELECT line, i, lead(d) OVER (PARTITION BY line ORDER BY i) - d AS s FROM v) SELECT line AS \"group\", CAST(coalesce(max(i + 1) FILTER (i < 12 AND s < -0.6), 0) AS INTEGER) AS signals FROM s GROUP BY 1")
def eigenvalue_slope(spark, sf_dir):
    x = real(spark, sf_dir).where("value <> 0").groupBy(F.col("line").alias("group")).agg(F.reverse(F.array_sort(F.collect_list(F.abs("value")))).alias("values"))
    return E.last_steep(x, 0.6, 12)


def _edges_sql() -> str:
    a, r = "OVER (PARTITION BY line ORDER BY pixel)", "OVER (PARTITION BY pixel ORDER BY line)"
    return (
        f"WITH {REAL}, b AS (SELECT line, pixel, lead(value) {a} - lag(value) {a} AS d, lead(value) {a} + 2 * value + lag(value) {a} AS s FROM px), c AS (SELECT line, pixel, lag(d) {r} + 2 * d + lead(d) {r} AS gx, lead(s) {r} - lag(s) {r} AS gy FROM b), "
        "g AS (SELECT *, sqrt(gx*gx + gy*gy) AS g, (CAST(round(atan2(gy, gx) / (pi() / 4)) AS BIGINT) + 8) % 4 AS t FROM c), "
        "n AS (SELECT x.line, x.pixel, x.g, greatest(coalesce(p.g, 0), coalesce(q.g, 0)) AS m FROM g x LEFT JOIN g p ON p.line = x.line - CASE WHEN x.t = 0 THEN 0 ELSE 1 END AND p.pixel = x.pixel - CASE x.t WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END LEFT JOIN g q ON q.line = x.line + CASE WHEN x.t = 0 THEN 0 ELSE 1 END AND q.pixel = x.pixel + CASE x.t WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END) "
        f"SELECT line, pixel, {R('g', 'strength')} FROM n WHERE g > 1.5 AND g >= m"
    )


@query(_edges_sql())
def edges(spark, sf_dir):
    return E.edges(real(spark, sf_dir), 1.5)


@query(f"WITH {REAL}, l AS (SELECT *, value < lag(value) OVER w AND value < lead(value) OVER w AS low FROM px WINDOW w AS (PARTITION BY line ORDER BY pixel)), p AS (SELECT line, pixel AS peak FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY value DESC, pixel) AS i FROM px) WHERE i = 1) SELECT line, peak, max(pixel) FILTER (low AND pixel < peak) AS \"left\", min(pixel) FILTER (low AND pixel > peak) AS \"right\" FROM l JOIN p USING (line) GROUP BY 1, 2")
def nulls_beside_peak(spark, sf_dir):
    return E.nulls_beside_peak(real(spark, sf_dir))


@query(f"WITH RECURSIVE {REAL}, m AS (SELECT line, pixel FROM px WHERE value > 0.05 AND line < 60), r(l0, p0, line, pixel) AS (SELECT line, pixel, line, pixel FROM m UNION SELECT r.l0, r.p0, m.line, m.pixel FROM r JOIN m ON abs(m.line - r.line) + abs(m.pixel - r.pixel) = 1), g AS (SELECT l0 AS line, p0 AS pixel, count(*) AS size, min(line * 64 + pixel) AS first FROM r GROUP BY 1, 2) SELECT line, pixel, size, first AS region FROM g WHERE size >= 4")
def large_regions(spark, sf_dir):
    found = E.regions(real(spark, sf_dir).where("line < 60").select("line", "pixel", (F.col("value") > 0.05).alias("mask")), 4)
    first = found.groupBy("region").agg(F.min(F.col("line") * 64 + F.col("pixel")).alias("first"))
    return found.join(first, "region").select("line", "pixel", "size", F.col("first").alias("region"))
