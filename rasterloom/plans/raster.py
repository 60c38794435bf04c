"""Queries of the raster engine over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates, joins, kernels, pixelwise, stencils
from ..sources import rasters
from ..sources.rasters import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

REAL = "px AS (SELECT vec_id AS line, CAST(p AS BIGINT) AS pixel, CAST(embedding[p + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(p))"
IMAGE = "cx AS (SELECT vec_id AS line, CAST(p AS BIGINT) AS pixel, CAST(embedding[2 * p + 1] AS DOUBLE) AS re, CAST(embedding[2 * p + 2] AS DOUBLE) AS im FROM embeddings, range(32) t(p))"
PAIR = f"{IMAGE}, pr AS (SELECT a.line, a.pixel, a.re, a.im, b.re AS re2, b.im AS im2 FROM cx a JOIN cx b ON a.line = b.line - 1 AND a.pixel = b.pixel)"
WHOLE = "lim AS (SELECT (max(line) + 1) // {l} AS l, (max(pixel) + 1) // {p} AS p FROM {t})"


def real(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.real_raster(table(spark, sf_dir, "embeddings"))


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.complex_raster(table(spark, sf_dir, "embeddings"))


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image(spark, sf_dir).withColumn("line", F.col("line") - 1)


def shape(spark: SparkSession, sf_dir: str, parts: int = 1) -> tuple[int, int]:
    return rasters.shape(table(spark, sf_dir, "embeddings"), parts=parts)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, -0 to 0: sums depend on their order in the last bits."""
    return df.select(*((near(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def near(c: str, digits: int) -> Column:
    """F.round of a column of doubles, without its decimals where the value is not near a half: a whole number below 2**53 over a power of ten is the same double."""
    x = F.col(c) * 10.0**digits
    whole = F.rint(x)
    return F.when((F.abs(x) < 1e12) & (F.abs(x - whole) < 0.499), whole / 10.0**digits).otherwise(F.round(c, digits))


def query(sql: str | None = None, digits: int = 6):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def R(x: str, name: str) -> str:  # noqa: N802
    return f"round({x}, 6) + 0.0 AS {name}"


_IFG = f"WITH {PAIR}, {WHOLE.format(l=4, p=4, t='pr')} SELECT line // 4 AS line, pixel // 4 AS pixel, avg(re*re2 + im*im2) AS a, avg(im*re2 - re*im2) AS b, avg(re*re + im*im) AS p1, avg(re2*re2 + im2*im2) AS p2 FROM pr, lim WHERE line // 4 < lim.l AND pixel // 4 < lim.p GROUP BY 1, 2"


@query(f"SELECT line, pixel, {R('a', 're')}, {R('b', 'im')}, {R('atan2(b, a)', 'phase')}, {R('sqrt(a*a + b*b) / sqrt(p1 * p2)', 'coherence')} FROM ({_IFG})")
def interferogram_multilook(spark, sf_dir):
    lines = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line"), F.col("embedding").alias("values"))
    height, width = shape(spark, sf_dir, 2)
    both = pixelwise.pair_lines(lines, lines.withColumn("line", F.col("line") - 1))
    return aggregates.multilook_interferogram(both, 4, 4, (height - 1, width))


@query(f"WITH {PAIR} SELECT line, pixel, {R('re*re2 + im*im2', 're')}, {R('im*re2 - re*im2', 'im')} FROM pr")
def interferogram(spark, sf_dir):
    return pixelwise.interferogram(image(spark, sf_dir), second(spark, sf_dir))


@query(f"WITH {IMAGE} SELECT line, pixel, {R('sqrt(re*re + im*im)', 'amplitude')}, {R('atan2(im, re)', 'phase')}, {R('re*re + im*im', 'power')} FROM cx")
def amplitude_phase(spark, sf_dir):
    x = image(spark, sf_dir)
    return x.select("line", "pixel", F.hypot("re", "im").alias("amplitude"), S.phase(F.col("re"), F.col("im")).alias("phase"), S.power(F.col("re"), F.col("im")).alias("power"))


@query(f"WITH {IMAGE}, a AS (SELECT *, -4 * pi() * 7.5 / 0.24 * ((pixel % 5) * 0.01 + 2.0 / 7.5) AS g FROM cx) SELECT line, pixel, {R('re*cos(g) - im*sin(g)', 're')}, {R('re*sin(g) + im*cos(g)', 'im')} FROM a")
def flatten(spark, sf_dir):
    x = image(spark, sf_dir)
    offsets = x.select("line", "pixel", ((F.col("pixel") % 5) * 0.01).alias("offset"))
    return pixelwise.flatten(x, offsets, 7.5, 0.24, 2.0)


@query(f"WITH {PAIR} SELECT line, pixel, {R('0.5*(re + re2)', 're')}, {R('0.5*(im + im2)', 'im')} FROM pr")
def symmetrise(spark, sf_dir):
    return pixelwise.symmetrise(image(spark, sf_dir), second(spark, sf_dir))


@query(f"WITH {IMAGE}, m AS (SELECT *, sqrt(re*re + im*im) AS m FROM cx) SELECT line, pixel, {R('re * least(greatest(m, 0.5), 1.5) / m', 're')}, {R('im * least(greatest(m, 0.5), 1.5) / m', 'im')} FROM m")
def clip_magnitude(spark, sf_dir):
    return pixelwise.clip_magnitude(image(spark, sf_dir), 0.5, 1.5)


@query(f"WITH {REAL} SELECT (line - 1) // 3 AS line, (pixel - 2) // 5 AS pixel, {R('value', 'value')} FROM px WHERE line >= 1 AND pixel >= 2 AND (line - 1) % 3 = 0 AND (pixel - 2) % 5 = 0")
def decimate(spark, sf_dir):
    return pixelwise.decimate(real(spark, sf_dir), 3, 5, 1, 2)


@query(f"WITH {REAL}, {WHOLE.format(l=3, p=5, t='px')} SELECT line // 3 AS line, pixel // 5 AS pixel, {R('sum(value)', 'total')}, {R('avg(value)', 'mean')} FROM px, lim WHERE line // 3 < lim.l AND pixel // 5 < lim.p GROUP BY 1, 2")
def multilook(spark, sf_dir):
    return aggregates.multilook(real(spark, sf_dir), 3, 5, shape(spark, sf_dir))


@query(f"WITH {REAL}, {WHOLE.format(l=3, p=5, t='px')} SELECT line // 3 AS line, pixel // 5 AS pixel, {R('sum(value * (pixel % 3)) / sum(pixel % 3)', 'mean')}, {R('CAST(sum(pixel % 3) AS DOUBLE)', 'weight')} FROM px, lim WHERE line // 3 < lim.l AND pixel // 5 < lim.p GROUP BY 1, 2")
def multilook_weighted(spark, sf_dir):
    return aggregates.multilook_weighted(real(spark, sf_dir).withColumn("weight", (F.col("pixel") % 3).cast("double")), 3, 5, shape(spark, sf_dir))


@query(f"WITH {IMAGE}, {WHOLE.format(l=2, p=8, t='cx')} SELECT line // 2 AS line, pixel // 8 AS pixel, {R('avg(re*re + im*im)', 'power')} FROM cx, lim WHERE line // 2 < lim.l AND pixel // 8 < lim.p GROUP BY 1, 2")
def multilook_power(spark, sf_dir):
    return aggregates.multilook_power(image(spark, sf_dir), 2, 8, shape(spark, sf_dir, 2))


@query(f"WITH {REAL}, h AS (SELECT CASE WHEN line % 64 <> pixel THEN value END AS v FROM px) SELECT count(v) AS n, {R('min(v)', 'low')}, {R('max(v)', 'high')}, {R('avg(v)', 'mean')}, {R('stddev_samp(v)', 'deviation')} FROM h")
def real_stats(spark, sf_dir):
    x = real(spark, sf_dir)
    return aggregates.real_stats(x.withColumn("value", F.when(F.col("line") % 64 == F.col("pixel"), F.lit(float("nan"))).otherwise(F.col("value"))))


_MOD = f"{IMAGE}, m AS (SELECT *, sqrt(re*re + im*im) AS m FROM cx)"


@query(f"WITH {_MOD}, lo AS (SELECT re, im FROM m ORDER BY m, line, pixel LIMIT 1), hi AS (SELECT re, im FROM m ORDER BY m DESC, line DESC, pixel DESC LIMIT 1), a AS (SELECT count(*) AS n, avg(re) AS r, avg(im) AS i, stddev_samp(m) AS d FROM m) SELECT n, {R('lo.re', 'low_re')}, {R('lo.im', 'low_im')}, {R('hi.re', 'high_re')}, {R('hi.im', 'high_im')}, {R('r', 'mean_re')}, {R('i', 'mean_im')}, {R('d', 'deviation')} FROM a, lo, hi")
def complex_stats(spark, sf_dir):
    return aggregates.complex_stats(image(spark, sf_dir))


@query("SELECT round(100.0 * count(*) FILTER (m BETWEEN 0 AND 7 AND m & 1 <> 0) / count(*) FILTER (m BETWEEN 0 AND 7), 2) + 0.0 AS shadow, round(100.0 * count(*) FILTER (m BETWEEN 0 AND 7 AND m & 2 <> 0) / count(*) FILTER (m BETWEEN 0 AND 7), 2) + 0.0 AS layover, round(100.0 * count(*) FILTER (m BETWEEN 0 AND 7 AND m & 4 <> 0) / count(*) FILTER (m BETWEEN 0 AND 7), 2) + 0.0 AS water FROM (SELECT l_partkey % 10 AS m FROM lineitem)")
def mask_percentages(spark, sf_dir):
    return aggregates.mask_percentages(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 10).alias("mask")))


_LAG = f"WITH {IMAGE}, l AS (SELECT *, lag(re) OVER (PARTITION BY pixel ORDER BY line) AS re2, lag(im) OVER (PARTITION BY pixel ORDER BY line) AS im2 FROM cx)"


@query(f"{_LAG}, a AS (SELECT pixel, avg(re*re2 + im*im2) AS x, avg(im*re2 - re*im2) AS y, sqrt(avg(re*re + im*im) * avg(re2*re2 + im2*im2)) AS p FROM l WHERE re2 IS NOT NULL GROUP BY 1) SELECT pixel, {R('1500.0 / (2 * pi()) * atan2(y, x)', 'doppler')}, {R('sqrt(x*x + y*y) / p', 'correlation')} FROM a")
def doppler_by_correlation(spark, sf_dir):
    return aggregates.doppler_by_correlation(image(spark, sf_dir), 1500.0)


@query(f"{_LAG} SELECT pixel // 8 AS block, {R('avg((re-re2)*(re-re2) + (im-im2)*(im-im2)) / 2', 'noise')} FROM l WHERE re2 IS NOT NULL GROUP BY 1")
def noise_power(spark, sf_dir):
    return aggregates.noise_power(image(spark, sf_dir), 8)


@query(f"WITH r AS (SELECT event_type AS \"group\", value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT \"group\", {R('avg(value)', 'mean')}, {R('stddev_pop(value)', 'deviation')} FROM r WHERE i > round_even(n * 0.1, 0) AND i <= n - round_even(n * 0.1, 0) GROUP BY 1", 6)
def trimmed_mean(spark, sf_dir):
    return aggregates.trimmed(table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("group"), "value"), 0.2)


_QUAD = "q AS (SELECT vec_id AS line, CAST(p AS BIGINT) AS pixel, " + ", ".join(f"CAST(embedding[8 * p + {i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate("hh_re hh_im hv_re hv_im vh_re vh_im vv_re vv_im".split())) + " FROM embeddings, range(8) t(p))"


def quad(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pixel"), "embedding")
    names = "hh_re hh_im hv_re hv_im vh_re vh_im vv_re vv_im".split()
    return x.select("line", F.col("pixel").cast("long").alias("pixel"), *(F.get("embedding", F.col("pixel") * 8 + i).cast("double").alias(n) for i, n in enumerate(names)))


@query(f"WITH {_QUAD}, c AS (SELECT line // 50 AS block, vh_re-hv_re-hh_im-vv_im AS a, vh_im-hv_im+hh_re+vv_re AS b, hv_re-vh_re-hh_im-vv_im AS c, hv_im-vh_im+hh_re+vv_re AS d FROM q), m AS (SELECT block, avg(a*c + b*d) AS x, avg(b*c - a*d) AS y FROM c GROUP BY 1) SELECT block, {R('0.25 * atan2(y, x)', 'rotation')} FROM m")
def faraday_rotation(spark, sf_dir):
    return aggregates.faraday_rotation(quad(spark, sf_dir), 50)


_COV = ", ".join(f"{R(f'avg({p}_re*{q}_re + {p}_im*{q}_im)', f'{p}{q}_re')}, {R(f'avg({p}_im*{q}_re - {p}_re*{q}_im)', f'{p}{q}_im')}" for i, p in enumerate(("hh", "hv", "vv")) for q in ("hh", "hv", "vv")[i:])


@query(f"WITH {_QUAD} SELECT line // 100 AS block, {_COV} FROM q GROUP BY 1")
def covariance_terms(spark, sf_dir):
    return aggregates.covariance(quad(spark, sf_dir), ["hh", "hv", "vv"], 100)


@query(f"WITH {REAL} SELECT line AS \"group\", {R('regr_slope(value, pixel)', 'slope')}, {R('regr_intercept(value, pixel)', 'intercept')} FROM px GROUP BY 1")
def line_fit(spark, sf_dir):
    return aggregates.line_fit(real(spark, sf_dir).select(F.col("line").alias("group"), F.col("pixel").cast("double").alias("x"), F.col("value").alias("y")))


@query(f"WITH {IMAGE} SELECT {R('min(re)', 'x0')}, {R('max(re)', 'x1')}, {R('min(im)', 'y0')}, {R('max(im)', 'y1')} FROM cx")
def bounding_box(spark, sf_dir):
    return aggregates.bounds(image(spark, sf_dir).select(F.col("re").alias("x"), F.col("im").alias("y")))


@query(f"WITH {REAL} SELECT line, pixel, {R('value', 'value')} FROM px ORDER BY px.value DESC, line, pixel LIMIT 1")
def peak(spark, sf_dir):
    return aggregates.peak(real(spark, sf_dir))


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30 00:00:00') WHERE i = 1")
def latest_before(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return aggregates.latest_before(orders, "o_custkey", "o_orderdate", "1996-06-30 00:00:00")


_K = "[0.25, 0.5, 0.25]"


def _conv(table_: str, part: str, order: str) -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY {order})"
    a, b = f"lag(value) {w}", f"lead(value) {w}"
    return f"SELECT line, pixel, (0.25 * coalesce({a}, 0) + 0.5 * value + 0.25 * coalesce({b}, 0)) / (0.5 + CASE WHEN {a} IS NULL THEN 0 ELSE 0.25 END + CASE WHEN {b} IS NULL THEN 0 ELSE 0.25 END) AS value FROM {table_}"


@query(f"WITH {REAL}, a AS ({_conv('px', 'line', 'pixel')}), b AS ({_conv('a', 'pixel', 'line')}) SELECT line, pixel, {R('value', 'value')} FROM b")
def filter2d(spark, sf_dir):
    return stencils.filter2d(real(spark, sf_dir), [0.25, 0.5, 0.25], [0.25, 0.5, 0.25])


def phases(spark, sf_dir):
    return image(spark, sf_dir).select("line", "pixel", F.atan2("im", "re").alias("phase"))


_PH = f"{IMAGE}, ph AS (SELECT line, pixel, atan2(im, re) AS a, lead(atan2(im, re)) OVER (PARTITION BY line ORDER BY pixel) AS b, lead(atan2(im, re)) OVER (PARTITION BY pixel ORDER BY line) AS d FROM cx), qd AS (SELECT *, lead(b) OVER (PARTITION BY pixel ORDER BY line) AS c FROM ph)"


@query(f"WITH {_PH} SELECT line, pixel, {R('atan2(sin(b - a), cos(b - a))', 'across')}, {R('atan2(sin(d - a), cos(d - a))', 'along')} FROM ph")
def phase_gradient(spark, sf_dir):
    return stencils.gradient(phases(spark, sf_dir))


@query(f"WITH {_PH} SELECT line, pixel, CAST(round((a-b)/(2*pi())) + round((b-c)/(2*pi())) + round((c-d)/(2*pi())) + round((d-a)/(2*pi())) AS INTEGER) AS residue FROM qd WHERE c IS NOT NULL AND d IS NOT NULL")
def phase_residues(spark, sf_dir):
    return stencils.residues(phases(spark, sf_dir))


@query(f"WITH {REAL}, a AS (SELECT line, pixel, sum(value) OVER (PARTITION BY line ORDER BY pixel ROWS UNBOUNDED PRECEDING) AS v FROM px) SELECT line, pixel, {R('sum(v) OVER (PARTITION BY pixel ORDER BY line ROWS UNBOUNDED PRECEDING)', 'value')} FROM a")
def summed_area_table(spark, sf_dir):
    return stencils.summed_area(real(spark, sf_dir))


@query(f"WITH {REAL} SELECT line, pixel, {R('avg(value) OVER w', 'mean')}, {R('stddev_pop(value) OVER w', 'deviation')} FROM px WINDOW w AS (PARTITION BY line ORDER BY pixel ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def moving_statistics(spark, sf_dir):
    return stencils.moving(real(spark, sf_dir), 3)


@query(f"WITH {REAL} SELECT line, pixel, {R('median(value) OVER (PARTITION BY line ORDER BY pixel ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'value')} FROM px")
def median_filter(spark, sf_dir):
    return stencils.median_along(real(spark, sf_dir), 2)


@query(f"WITH {REAL}, s AS (SELECT line, pixel, CAST(sign(value) AS INTEGER) AS v FROM px), c AS (SELECT *, lag(v) OVER (PARTITION BY line ORDER BY pixel) AS before FROM s) SELECT line, pixel, before, v AS value FROM c WHERE before <> v")
def value_changes(spark, sf_dir):
    return stencils.changes(real(spark, sf_dir).withColumn("value", F.signum("value").cast("int")))


@query(f"WITH {REAL}, b AS (SELECT *, lag(value) OVER (PARTITION BY line ORDER BY pixel) AS v0 FROM px) SELECT line, {R('pixel - 1 + v0 / (v0 - value)', 'root')} FROM b WHERE (v0 < 0) <> (value < 0)")
def zero_crossings(spark, sf_dir):
    return stencils.zero_crossings(real(spark, sf_dir)).select("line", "root")


@query(f"WITH {REAL}, g AS (SELECT line, pixel, pixel + 3 * value AS e, pixel * 2 + 4 * value AS s FROM px) SELECT line, pixel, CASE WHEN e <= max(e) OVER p THEN 1 ELSE 0 END + CASE WHEN pixel <= max(pixel) OVER n OR pixel >= min(pixel) OVER f THEN 2 ELSE 0 END AS mask FROM g WINDOW p AS (PARTITION BY line ORDER BY pixel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY line ORDER BY s, pixel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY line ORDER BY s, pixel ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")
def layover_shadow(spark, sf_dir):
    x = real(spark, sf_dir)
    return stencils.layover_shadow(x.select("line", "pixel", F.col("pixel").alias("cross"), (F.col("pixel") + 3 * F.col("value")).alias("elevation"), (F.col("pixel") * 2 + 4 * F.col("value")).alias("slant")))


@query(f"WITH {REAL}, j AS (SELECT line, pixel, value * 5 AS v, coalesce(round((lag(value * 5) OVER (PARTITION BY line ORDER BY pixel) - value * 5) / 2.0), 0) AS j FROM px) SELECT line, pixel, {R('v + 2.0 * sum(j) OVER (PARTITION BY line ORDER BY pixel ROWS UNBOUNDED PRECEDING)', 'value')} FROM j")
def unwrap_steps(spark, sf_dir):
    return stencils.unwrap_steps(real(spark, sf_dir).withColumn("value", F.col("value") * 5), 2.0)


@query("SELECT user_id, event_id AS probe, round(CASE WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (t - t0) / (t1 - t0) * (v1 - v0) ELSE coalesce(v0, v1) END, 6) + 0.0 AS value FROM (WITH e AS (SELECT user_id, event_id, event_type, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS t, value FROM events), n AS (SELECT user_id, t, value FROM e WHERE event_type <> 'view' AND value IS NOT NULL), a AS (SELECT p.user_id, p.event_id, p.t, n.t AS t0, n.value AS v0 FROM (SELECT * FROM e WHERE event_type = 'view') p ASOF LEFT JOIN n ON p.user_id = n.user_id AND p.t >= n.t) SELECT a.*, m.t AS t1, m.value AS v1 FROM a ASOF LEFT JOIN n m ON a.user_id = m.user_id AND a.t < m.t)")
def bracket_interpolation(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6)
    nodes = e.where("event_type <> 'view' and value is not null").select("user_id", "t", F.col("value").alias("v"))
    return joins.interpolated(e.where("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("probe")), nodes, "user_id")


@query(f"WITH {REAL} SELECT line, pixel, CASE WHEN pixel >= line % 7 AND pixel < 20 + line % 11 THEN 1 WHEN pixel >= 15 AND pixel < 50 - line % 5 THEN 2 ELSE 0 END AS swath FROM px")
def sub_swath(spark, sf_dir):
    lines = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line"))
    swaths = lines.select(F.lit(1).alias("swath"), "line", (F.col("line") % 7).alias("start"), (20 + F.col("line") % 11).alias("stop"))
    swaths = swaths.unionByName(lines.select(F.lit(2).alias("swath"), "line", F.lit(15).cast("long").alias("start"), (50 - F.col("line") % 5).alias("stop")))
    return joins.sub_swath(real(spark, sf_dir).select("line", "pixel"), swaths)


_BANDS = "SELECT p_brand AS pol, p_partkey AS name, p_retailprice AS lo, p_retailprice + p_size AS hi, p_partkey % 2 AS side FROM part"


@query(f"WITH b AS ({_BANDS}) SELECT a.pol, a.name, c.name AS name2, {R('greatest(a.lo, c.lo)', 'lo')}, {R('least(a.hi, c.hi)', 'hi')} FROM b a JOIN b c USING (pol) WHERE a.side = 0 AND c.side = 1 AND a.lo < c.hi AND c.lo < a.hi")
def band_overlaps(spark, sf_dir):
    b = table(spark, sf_dir, "part").select(F.col("p_brand").alias("pol"), F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + F.col("p_size")).alias("hi"))
    return joins.band_overlaps(b.where("name % 2 = 0"), b.where("name % 2 = 1"))


@query("WITH p AS (SELECT event_id AS pulse, CAST(epoch_us(ts) AS DOUBLE) / 1e6 - 1704067200 AS t FROM events) SELECT a.pulse, round(b.t - 5.0 - a.t, 4) + 0.0 AS begin, round(b.t + 5.0 - a.t, 4) + 0.0 AS \"end\" FROM p a JOIN p b ON b.t > a.t AND b.t BETWEEN a.t + 60.0 - 5.0 AND a.t + 600.0 + 5.0", 4)
def transmit_gaps(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6 - 1704067200
    return joins.gap_mask(table(spark, sf_dir, "events").select(F.col("event_id").alias("pulse"), t.alias("t")), 60.0, 600.0, 5.0)


@query(f"WITH {REAL}, q AS (SELECT p_partkey AS probe, least(greatest(p_size * 0.7 - 2, 0.0), 31.0) AS y, least(greatest(p_retailprice / 20 - 20, 0.0), 63.0) AS x FROM part), f AS (SELECT *, least(CAST(floor(y) AS BIGINT), 30) AS i, least(CAST(floor(x) AS BIGINT), 62) AS j FROM q) SELECT probe, {R('sum(abs(1 - (px.line - i) - (y - i)) * abs(1 - (px.pixel - j) - (x - j)) * value)', 'value')} FROM f JOIN px ON px.line BETWEEN i AND i + 1 AND px.pixel BETWEEN j AND j + 1 GROUP BY 1")
def bilinear_lookup(spark, sf_dir):
    grid = real(spark, sf_dir).where("line < 32").select(F.col("line").alias("iy"), F.col("pixel").alias("ix"), F.col("value").alias("v"))
    probes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("probe"), (F.col("p_size") * 0.7 - 2).alias("y"), (F.col("p_retailprice") / 20 - 20).alias("x"))
    return joins.lut2d(probes, grid, 32, 64)


_GEO = "SELECT s_suppkey AS id, radians((s_suppkey * 37 % 360) - 180.0) AS lon, radians((s_suppkey * 13 % 170) - 85.0) AS lat, s_acctbal / 10 AS h FROM supplier"


def places(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.radians(k * 37 % 360 - 180.0).alias("lon"), F.radians(k * 13 % 170 - 85.0).alias("lat"), (F.col("s_acctbal") / 10).alias("h"))


@query(f"WITH g AS ({_GEO}), r AS (SELECT *, 6378137.0 / sqrt(1 - 0.0066943799901 * sin(lat) * sin(lat)) AS r FROM g) SELECT id, round((r + h) * cos(lat) * cos(lon), 4) + 0.0 AS x, round((r + h) * cos(lat) * sin(lon), 4) + 0.0 AS y, round((r * (1 - 0.0066943799901) + h) * sin(lat), 4) + 0.0 AS z FROM r", 4)
def geodetic_to_cartesian(spark, sf_dir):
    x, y, z = S.to_ecef(F.col("lon"), F.col("lat"), F.col("h"))
    return places(spark, sf_dir).select("id", x.alias("x"), y.alias("y"), z.alias("z"))


@query(f"WITH g AS ({_GEO}) SELECT id, {R('lon', 'lon')}, {R('lat', 'lat')}, {R('h', 'h')} FROM g")
def geodetic_round_trip(spark, sf_dir):
    xyz = S.to_ecef(F.col("lon"), F.col("lat"), F.col("h"))
    at = places(spark, sf_dir).select("id", *(c.alias(n) for c, n in zip(xyz, "xyz", strict=True)))
    lon, lat, h = S.to_llh(F.col("x"), F.col("y"), F.col("z"))
    return at.select("id", lon.alias("lon"), lat.alias("lat"), h.alias("h"))


_F0, _FL, _FH = 1.27e9, 1.24e9, 1.30e9
_DET = _F0 / _FL * _FH / _F0 - _FL / _F0 * _F0 / _FH


@query(f"WITH {PAIR} SELECT line, pixel, {R(f'(re * {_FH / _F0!r} - re2 * {_FL / _F0!r}) / {_DET!r}', 'dispersive')}, {R(f'(re2 * {_F0 / _FL!r} - re * {_F0 / _FH!r}) / {_DET!r}', 'non_dispersive')} FROM pr", 6)
def ionosphere_split(spark, sf_dir):
    low = image(spark, sf_dir).select("line", "pixel", F.col("re").alias("value"))
    return pixelwise.dispersive(low, low.withColumn("line", F.col("line") - 1), _F0, _FL, _FH)


@query(f"WITH {REAL} SELECT line, pixel, {R('1 + 2 * value - 0.5 * value * value + 0.125 * value * value * value', 'value')}, {R('2 - value + 0.375 * value * value', 'slope')} FROM px")
def polynomial(spark, sf_dir):
    c = [1.0, 2.0, -0.5, 0.125]
    v = F.col("value")
    return real(spark, sf_dir).select("line", "pixel", S.horner(v, c).alias("value"), S.horner(v, S.derivative(c)).alias("slope"))


@query(f"WITH {REAL} SELECT line, pixel, {R('CASE WHEN abs(value * pi()) < 1e-8 THEN 1.0 ELSE sin(value * pi()) / (value * pi()) END', 'sinc')}, {R('ceil(value / 0.25) * 0.25', 'snapped')}, {R('CASE WHEN value > 0 THEN 10 * log10(value) END', 'decibel')} FROM px")
def scalar_functions(spark, sf_dir):
    v = F.col("value")
    return real(spark, sf_dir).select("line", "pixel", S.sinc(v).alias("sinc"), S.snap(v, 0.25).cast("double").alias("snapped"), S.decibel(v).alias("decibel"))


@query("SELECT event_id, CAST(dayofyear(ts) AS INTEGER) AS day, CAST(isodow(ts) AS INTEGER) AS weekday, CAST(epoch_us(ts) // 1000000 % 86400 AS BIGINT) AS second, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def date_time(spark, sf_dir):
    ts = F.col("ts")
    second = F.unix_micros(ts.cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.dayofyear(ts).alias("day"), (F.weekday(ts) + 1).alias("weekday"), (F.expr("unix_micros(cast(ts as timestamp)) div 1000000") % 86400).alias("second"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso")
    )


_MATCH = f"""WITH {REAL}, k AS (SELECT unnest(range(17)) AS k), c AS (SELECT line, pixel, value - avg(value) OVER (PARTITION BY line) AS a FROM px WHERE pixel BETWEEN 8 AND 55),
b AS (SELECT line - 1 AS line, pixel, value FROM px), w AS (SELECT b.line, k, pixel - k AS q, value - avg(value) OVER (PARTITION BY b.line, k) AS b FROM b, k WHERE pixel - k BETWEEN 0 AND 47),
s AS (SELECT line, k, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS s FROM w JOIN c USING (line) WHERE pixel - 8 = q GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY s DESC, k) AS r, lag(s) OVER (PARTITION BY line ORDER BY k) AS l, lead(s) OVER (PARTITION BY line ORDER BY k) AS n FROM s)
SELECT line, {R('k - 8 + CASE WHEN k BETWEEN 1 AND 15 AND l - 2 * s + n <> 0 THEN 0.5 * (l - n) / (l - 2 * s + n) ELSE 0 END', 'offset')}, {R('s', 'correlation')} FROM t WHERE r = 1"""


@query(_MATCH)
def line_matching(spark, sf_dir):
    lines = rasters.line_arrays(real(spark, sf_dir))
    pairs = lines.select("line", F.col("values").alias("a")).join(lines.select((F.col("line") - 1).alias("line"), F.col("values").alias("b")), "line")
    return kernels.match(pairs, 8)


@query(f"WITH {REAL}, k AS (SELECT i, pi() * 8 * pow(i / 16.0, 2) AS g FROM range(16) r(i)) SELECT line, CAST(pixel - i AS INTEGER) AS place, {R('sum(value * cos(g))', 're')}, {R('sum(-value * sin(g))', 'im')} FROM px, k WHERE pixel - i BETWEEN 0 AND 48 GROUP BY 1, 2")
def range_compression(spark, sf_dir):
    import numpy as np

    t = np.arange(16) / 16
    x = kernels.compressed(rasters.line_arrays(real(spark, sf_dir)), np.exp(1j * math.pi * 8 * t * t))
    return x.select("line", F.posexplode(F.arrays_zip("re", "im")).alias("place", "z")).select("line", "place", "z.re", "z.im")
