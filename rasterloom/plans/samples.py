"""Queries of predicates, masks, grids and lookups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import lookups, pixelwise
from ..operators import predicates as P
from ..sources.rasters import table
from .raster import _GEO, IMAGE, PAIR, REAL, R, image, places, query, real



def D(x: str, name: str, digits: int = 6) -> str:  # noqa: N802
    """A double, where DuckDB would make a decimal."""
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0 AS {name}"


@query(f"WITH {IMAGE}, b AS (SELECT *, -2 * pi() * (10 + 0.5 * pixel) * line / 1500.0 AS g FROM cx) SELECT line, pixel, {R('re * cos(g) - im * sin(g)', 're')}, {R('re * sin(g) + im * cos(g)', 'im')} FROM b")
def baseband(spark, sf_dir):
    carrier = spark.range(32).select(F.col("id").alias("pixel"), (10 + 0.5 * F.col("id")).alias("doppler"))
    return P.baseband(image(spark, sf_dir), carrier, 1500.0)


@query(
    f"WITH {REAL} SELECT line, pixel, CASE WHEN value >= pow(10.0, -0.6) THEN round(value, 6) + 0.0 END AS factor, pixel % 7 <> 3 AS data, {R('least(greatest(value, -0.5), 0.75)', 'clamped')}, {R('pow(10.0, value / 10)', 'linear')}, value IS NULL OR value < -1 OR value > 1 AS invalid, {D('pixel * 0.1 * 7000 * 0.001', 'along')}, {R('value * 6.25', 'slant')} FROM px"
)
def sample_masks(spark, sf_dir):
    v = F.col("value")
    holed = F.when(F.col("pixel") % 7 == 3, F.lit(float("nan"))).otherwise(v)
    return real(spark, sf_dir).select(
        "line", "pixel", F.nanvl(P.at_least_decibel(v, -6.0), F.lit(None).cast("double")).alias("factor"), P.is_data(holed, float("nan")).alias("data"), P.clamp(v, -0.5, 0.75).alias("clamped"),
        S.linear(v).alias("linear"), P.outside(v, -1.0, 1.0).alias("invalid"), P.along_track_metres(F.col("pixel") * F.lit(0.1), F.lit(7000.0), 0.001).alias("along"), P.slant_metres(v, 6.25).alias("slant"),
    )


@query(f"WITH {REAL}, e AS (SELECT line, pixel, value, abs(value) AS m, floor(log2(abs(value))) AS r FROM px), f AS (SELECT *, pow(2.0, CASE WHEN pow(2.0, r) > m THEN r - 1 WHEN pow(2.0, r + 1) <= m THEN r + 1 ELSE r END - 10) AS u FROM e) SELECT line, pixel, round(CASE WHEN m > 0 THEN sign(value) * floor(m / u) * u ELSE value END, 12) + 0.0 AS value FROM f", 12)
def truncated_mantissa(spark, sf_dir):
    return real(spark, sf_dir).select("line", "pixel", P.truncated(F.col("value"), 10).alias("value"))


@query(
    f"WITH e AS (SELECT user_id AS sat, event_id, epoch_us(ts) / 1e6 - 1704067200 AS t FROM events), w AS (SELECT *, row_number() OVER o AS i, min(t) OVER s AS lo, max(t) OVER s AS hi, count(*) OVER s AS n FROM e WINDOW o AS (PARTITION BY sat ORDER BY t), s AS (PARTITION BY sat)), b AS (SELECT sat, coalesce(max(i) FILTER (t < 600000), 1) AS a, coalesce(min(i) FILTER (t > 1200000), max(n)) AS z FROM w GROUP BY 1) SELECT sat, event_id, {R('t', 't')} FROM w JOIN b USING (sat) WHERE lo <= 600000 AND hi >= 1200000 AND i >= a - 1 AND i <= z + 1"
)
def cropped_orbit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    return P.crop(e.select(F.col("user_id").alias("sat"), "event_id", t.alias("t")), 600_000.0, 1_200_000.0, 1)


_GRID = "SELECT p_partkey AS id, p_retailprice AS s, p_size * 0.5 AS d, CAST(p_size * 3 AS BIGINT) AS n FROM part"


@query(
    f"WITH g AS ({_GRID}) SELECT id, {R('s + 2 * d', 'slice_start')}, n - 7 AS slice_n, {D('s + 1.0 * d', 'look_start')}, {D('d * 3', 'look_spacing')}, n // 3 AS look_n, {D('d / 4', 'up_spacing')}, n * 4 AS up_n, {R('s - 3 * d', 'moved_start')}, n + 6 AS moved_n, d > 0 AND n > 5 AND s > 0 AS valid FROM g"
)
def grid_algebra(spark, sf_dir):
    g = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("s"), (F.col("p_size") * 0.5).alias("d"), (F.col("p_size") * 3).cast("long").alias("n"))
    s, d, n = F.col("s"), F.col("d"), F.col("n")
    part, look, up, moved = P.sliced(s, d, F.lit(2), n - 5), P.looked_down(s, d, n, 3), P.upsampled(s, d, n, 4), P.offset(s, d, n, F.lit(-3), F.lit(6))
    valid = P.valid_grid(F.lit(0.24), F.lit(1500.0), d, n - 5, n, s)
    return g.select("id", part[0].alias("slice_start"), (n - 7).alias("slice_n"), look[0].alias("look_start"), look[1].alias("look_spacing"), look[2].alias("look_n"), up[1].alias("up_spacing"), up[2].alias("up_n"), moved[0].alias("moved_start"), moved[2].alias("moved_n"), valid.alias("valid"))


@query(f"WITH {IMAGE} SELECT line, pixel, CASE WHEN pixel >= line % 7 AND pixel < 12 + line % 5 OR pixel >= 20 AND pixel < 30 THEN round(re, 6) + 0.0 ELSE CAST(-1 AS DOUBLE) END AS re, CASE WHEN pixel >= line % 7 AND pixel < 12 + line % 5 OR pixel >= 20 AND pixel < 30 THEN round(im, 6) + 0.0 ELSE CAST(0 AS DOUBLE) END AS im FROM cx")
def filled_gaps(spark, sf_dir):
    lines = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line"))
    a = lines.select("line", (F.col("line") % 7).alias("start"), (12 + F.col("line") % 5).alias("stop"))
    b = lines.select("line", F.lit(20).cast("long").alias("start"), F.lit(30).cast("long").alias("stop"))
    none = lines.select("line", F.lit(31).cast("long").alias("start"), F.lit(31).cast("long").alias("stop"))
    return P.fill_gaps(image(spark, sf_dir), a.unionByName(b).unionByName(none), -1.0, 0.0)


@query(
    "SELECT s_suppkey AS id, s_suppkey % 8 <> 0 AS any_use, s_suppkey % 8 & 6 <> 0 AS calibration, abs(atan2(sin(radians(s_acctbal) - 1.0), cos(radians(s_acctbal) - 1.0))) <= radians(20) AS heading FROM supplier"
)
def reflector_filters(spark, sf_dir):
    v = F.col("s_suppkey") % 8
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), P.usable(v).alias("any_use"), P.usable(v, P.RADIOMETRY | P.GEOMETRY).alias("calibration"), P.heads_to(F.radians("s_acctbal"), 1.0).alias("heading"))


@query(
    "SELECT o_orderkey AS id, o_orderdate >= TIMESTAMP '1993-01-01' AND coalesce(o_orderdate + INTERVAL 1 HOUR <= CASE WHEN o_orderkey % 3 > 0 THEN TIMESTAMP '1997-06-30' END, true) AS valid FROM orders"
)
def calibration_dates(spark, sf_dir):
    t = F.col("o_orderdate")
    before = F.when(F.col("o_orderkey") % 3 > 0, F.lit("1997-06-30").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), P.calibrated(t, t + F.expr("interval 1 hour"), F.lit("1993-01-01").cast("timestamp_ntz"), before).alias("valid"))


@query("SELECT event_id, event_type AS path FROM events WHERE event_type = 'view'")
def noise_lines(spark, sf_dir):
    return P.noise_only(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("path")), "view")


_CORNERS = [(0.0, 0.0), (40.0, -5.0), (60.0, 30.0), (25.0, 18.0), (5.0, 45.0)]


def _buffer_sql() -> str:
    cross, near = [], []
    for (x1, y1), (x2, y2) in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1], strict=True):
        dx, dy = x2 - x1, y2 - y1
        cross.append(f"CASE WHEN y >= {min(y1, y2)} AND y < {max(y1, y2)} AND x < {x1} + (y - {y1}) * {dx / dy!r} THEN 1 ELSE 0 END")
        s = f"least(greatest(((x - {x1}) * {dx} + (y - {y1}) * {dy}) / {dx * dx + dy * dy}, 0.0), 1.0)"
        near.append(f"pow(x - {x1} - {s} * {dx}, 2) + pow(y - {y1} - {s} * {dy}, 2) <= 9.0")
    return f"WITH p AS (SELECT p_partkey AS id, CAST(p_partkey % 67 - 2 AS DOUBLE) AS x, p_size - 4.25 AS y FROM part) SELECT id FROM p WHERE ({' + '.join(cross)}) % 2 = 1 OR {' OR '.join(near)}"


@query(_buffer_sql())
def footprint_buffer(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 67 - 2.0).alias("x"), (F.col("p_size") - 4.25).alias("y"))
    return lookups.in_footprint(p, _CORNERS, 3.0).select("id")


@query(f"WITH {PAIR} SELECT line, pixel, CASE WHEN pixel % 5 = 0 OR line % 7 = 0 THEN -9999.0 ELSE round(re + re2, 6) + 0.0 END AS value FROM pr UNION ALL SELECT line, pixel, CAST(-9999 AS DOUBLE) FROM cx WHERE line = 0 - 1 OR line = (SELECT max(line) FROM cx) UNION ALL SELECT line - 1, pixel, CAST(-9999 AS DOUBLE) FROM cx WHERE line = 0")
def sum_of_valid(spark, sf_dir):
    x = image(spark, sf_dir).select("line", "pixel", F.when(F.col("pixel") % 5 == 0, -9999.0).otherwise(F.col("re")).alias("value"))
    y = image(spark, sf_dir).select((F.col("line") - 1).alias("line"), "pixel", F.when((F.col("line") - 1) % 7 == 0, -9999.0).otherwise(F.col("re")).alias("value"))
    return pixelwise.sum_valid(x, y, -9999.0)


@query(f"WITH {REAL}, m AS (SELECT line, pixel, CAST(pixel % 9 AS INTEGER) AS mask, (line + pixel) % 4 = 0 AS water FROM px) SELECT line, pixel, CASE WHEN water AND pixel < 60 AND mask BETWEEN 0 AND 3 THEN mask + 4 ELSE mask END AS mask FROM m")
def water_mask(spark, sf_dir):
    x = real(spark, sf_dir)
    mask = x.select("line", "pixel", (F.col("pixel") % 9).cast("int").alias("mask"))
    water = x.where("pixel < 60").select("line", "pixel", ((F.col("line") + F.col("pixel")) % 4 == 0).alias("water"))
    return pixelwise.add_water(mask, water)


@query(f"WITH {IMAGE} SELECT line, pixel, {D('(line * 7 + pixel) % 16 * 0.25 - 2', 're')}, {D('(line + pixel * 3) % 16 * 0.25 - 2', 'im')} FROM cx")
def decoded_samples(spark, sf_dir):
    codes = image(spark, sf_dir).select("line", "pixel", ((F.col("line") * 7 + F.col("pixel")) % 16).alias("r"), ((F.col("line") + F.col("pixel") * 3) % 16).alias("i"))
    return pixelwise.decode(codes, spark.range(16).select(F.col("id").alias("code"), (F.col("id") * 0.25 - 2).alias("level")))


@query(
    f"WITH {REAL}, t AS (SELECT id, (degrees(lat) + 85) / 170 * 30 AS y, (degrees(lon) + 180) / 360 * 70 - 2 AS x FROM ({_GEO})), c AS (SELECT id, y, least(greatest(x, 0.0), 63.0) AS x FROM t), f AS (SELECT *, least(CAST(floor(y) AS BIGINT), 30) AS i, least(CAST(floor(x) AS BIGINT), 62) AS j FROM c) SELECT id AS probe, {R('sum(abs(1 - (px.line - i) - (y - i)) * abs(1 - (px.pixel - j) - (x - j)) * value)', 'value')} FROM f JOIN px ON px.line BETWEEN i AND i + 1 AND px.pixel BETWEEN j AND j + 1 GROUP BY 1"
)
def relocated_raster(spark, sf_dir):
    grid = real(spark, sf_dir).where("line < 32").select(F.col("line").alias("iy"), F.col("pixel").alias("ix"), F.col("value").alias("v"))
    at = places(spark, sf_dir).select(F.col("id").alias("probe"), F.degrees("lat").alias("north"), F.degrees("lon").alias("east"))
    return P.relocated(at, grid, F.col("north"), F.col("east"), (32, 64), (-85.0, -180.0 + 2 * 360 / 70), (170 / 30, 360 / 70))


_NODES = "WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 - 1704067200 AS t, value FROM events), n AS (SELECT user_id, t, value AS v FROM e WHERE event_type <> 'view' AND value IS NOT NULL), p AS (SELECT * FROM e WHERE event_type = 'view')"


def _probes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200)
    nodes = e.where("event_type <> 'view' and value is not null").select("user_id", "t", F.col("value").alias("v"))
    return e.where("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("probe")), nodes


@query(
    f"{_NODES}, r AS (SELECT user_id, t, v, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i, count(*) OVER (PARTITION BY user_id) AS k FROM n), s AS (SELECT a.user_id, a.t AS ta, a.v AS va, b.t AS tb, b.v AS vb, a.i, a.k FROM r a JOIN r b ON a.user_id = b.user_id AND b.i = a.i + 1), j AS (SELECT p.user_id, p.event_id AS probe, p.t, s.* EXCLUDE (user_id) FROM p JOIN s ON p.user_id = s.user_id AND (p.t >= ta OR i = 1) AND (p.t < tb OR i = k - 1)) SELECT user_id, probe, round(va + (t - ta) * (vb - va) / (tb - ta), 4) + 0.0 AS value FROM j UNION ALL SELECT user_id, event_id, round(v, 4) + 0.0 FROM p JOIN r USING (user_id) WHERE k = 1", 4
)
def table_lookup(spark, sf_dir):
    return lookups.lut1d(*_probes(spark, sf_dir), "user_id")


@query(
    f"{_NODES}, r AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM n), a AS (SELECT p.user_id, p.event_id, p.t, r.i AS i0, r.t AS t0 FROM p ASOF LEFT JOIN r ON p.user_id = r.user_id AND p.t >= r.t), b AS (SELECT a.*, m.i AS i1, m.t AS t1 FROM a ASOF LEFT JOIN r m ON a.user_id = m.user_id AND a.t < m.t) SELECT user_id, event_id AS probe, CASE WHEN t0 IS NULL OR t1 - t < t - t0 THEN i1 ELSE i0 END AS pulse FROM b"
)
def nearest_pulse(spark, sf_dir):
    probes, nodes = _probes(spark, sf_dir)
    return lookups.pulse_index(probes, nodes, "user_id", nearest=True)


@query("WITH b AS (SELECT o_orderkey AS block, o_totalprice AS b0, o_totalprice + 200 AS b1 FROM orders), s AS (SELECT c_custkey AS span, c_acctbal * 40 AS s0, c_acctbal * 40 + 150 AS s1 FROM customer) SELECT block, span FROM b JOIN s ON b0 <= s1 AND s0 <= b1")
def overlapping_blocks(spark, sf_dir):
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block"), F.col("o_totalprice").alias("b0"), (F.col("o_totalprice") + 200).alias("b1"))
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("span"), (F.col("c_acctbal") * 40).alias("s0"), (F.col("c_acctbal") * 40 + 150).alias("s1"))
    return lookups.block_overlaps(b, s, 200.0)


@query(
    "WITH p AS (SELECT event_id AS pulse, epoch_us(ts) / 1e6 - 1704067200 AS t FROM events), g AS (SELECT a.pulse, greatest(0, CAST(round((b.t - a.t - 60.0 - 5.0) * 0.1) AS BIGINT)) AS a, least(60, CAST(round((b.t + 20.0 + 5.0 - a.t - 60.0) * 0.1) AS BIGINT)) AS b FROM p a JOIN p b ON b.t >= a.t AND b.t - 5.0 <= a.t + 60.0 + 60 / 0.1 WHERE round((b.t - a.t - 65.0) * 0.1) <= 60 AND round((b.t + 25.0 - a.t - 60.0) * 0.1) >= 0), k AS (SELECT pulse, unnest(range(60)) AS bin FROM p), f AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.pulse = k.pulse AND bin >= a AND bin < b)), r AS (SELECT pulse, bin, bin - row_number() OVER (PARTITION BY pulse ORDER BY bin) AS d FROM f) SELECT pulse, min(bin) AS begin, max(bin) + 1 AS \"end\" FROM r GROUP BY pulse, d"
)
def receive_windows(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    return lookups.receivable(table(spark, sf_dir, "events").select(F.col("event_id").alias("pulse"), t.alias("t")), 60.0, 0.1, 60, 20.0, 5.0)


@query(
    f"WITH p AS (SELECT epoch_us(ts) / 1e6 - 1704067200 AS a, coalesce(value, 0) AS re, CAST(event_id % 10 AS DOUBLE) AS im FROM events), o AS (SELECT i AS out, i * 7200.0 AS t FROM range(300) r(i)), x AS (SELECT out, 1 - abs(a - t) / 9000 AS w, re, im FROM o JOIN p ON abs(a - t) < 9000) SELECT out, {R('sum(w * re) / sum(w)', 're')}, {R('sum(w * im) / sum(w)', 'im')}, count(*) AS pulses FROM x GROUP BY 1"
)
def presum(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    samples = e.select(t.alias("t"), F.coalesce("value", F.lit(0.0)).alias("re"), (F.col("event_id") % 10).cast("double").alias("im"))
    return lookups.presummed(samples, spark.range(300).select(F.col("id").alias("out"), (F.col("id") * 7200.0).alias("t")), 9000.0)


_HOLES = f"{REAL}, v AS (SELECT line, pixel, CASE WHEN (line * 5 + pixel * 3) % 11 >= 4 THEN value END AS value FROM px)"
_AROUND = "j AS (SELECT a.line, a.pixel, b.line AS l, b.pixel AS p, b.value, (a.line - b.line) ** 2 + (a.pixel - b.pixel) ** 2 AS d FROM v a JOIN v b ON b.line BETWEEN a.line - 3 AND a.line + 3 AND b.pixel BETWEEN a.pixel - 3 AND a.pixel + 3 WHERE a.value IS NULL AND b.value IS NOT NULL)"


def _holed(spark, sf_dir):
    return real(spark, sf_dir).withColumn("value", F.when((F.col("line") * 5 + F.col("pixel") * 3) % 11 >= 4, F.col("value")))


@query(f"WITH {_HOLES}, {_AROUND}, n AS (SELECT line, pixel, arg_min(value, d * 1e12 + l * 1e6 + p) AS near FROM j GROUP BY 1, 2) SELECT v.line, v.pixel, {R('coalesce(v.value, near)', 'value')} FROM v LEFT JOIN n USING (line, pixel)")
def nearest_valid(spark, sf_dir):
    return lookups.nearest_fill(_holed(spark, sf_dir), 3)


@query(f"WITH {_HOLES}, {_AROUND}, n AS (SELECT line, pixel, sum(exp(-d / 2 * 0.5) * value) / sum(exp(-d / 2 * 0.5)) AS near FROM j GROUP BY 1, 2) SELECT v.line, v.pixel, {R('coalesce(v.value, near)', 'value')} FROM v LEFT JOIN n USING (line, pixel)")
def distance_fill(spark, sf_dir):
    return lookups.distance_fill(_holed(spark, sf_dir), 3, 0.5)


@query(f"WITH g AS (SELECT id, lon, lat FROM ({_GEO})), c AS (SELECT *, unnest([-500.0, 0.0, 3000.0, 9000.0]) AS height FROM g) SELECT id, CAST(height AS DOUBLE) AS height, round(({6378137.0} / sqrt(1 - 0.0066943799901 * sin(lat) ** 2) * (1 - 0.0066943799901) + height) * sin(lat), 3) + 0.0 AS z FROM c", 3)
def metadata_cube(spark, sf_dir):
    x = lookups.cube(places(spark, sf_dir).select("id", "lon", "lat"), [-500.0, 0.0, 3000.0, 9000.0])
    return x.select("id", "height", S.to_ecef(F.col("lon"), F.col("lat"), F.col("height"))[2].alias("z"))


@query(f"WITH {REAL}, t AS (SELECT p_partkey AS target, p_partkey % 400 AS tl, p_size AS tp FROM part) SELECT target, line - tl AS dl, pixel - tp AS dp, {R('value', 'value')} FROM t JOIN px ON line BETWEEN tl - 2 AND tl + 2 AND pixel BETWEEN tp - 2 AND tp + 2")
def target_chips(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"), (F.col("p_partkey") % 400).alias("tl"), F.col("p_size").cast("long").alias("tp"))
    return lookups.chips(t, real(spark, sf_dir), 2)


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def channels_present(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lookups.having(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), wanted, ["l_orderkey"])


@query(f"WITH {IMAGE} SELECT 'real' AS band, line, pixel, {R('re', 'value')} FROM cx UNION ALL SELECT 'imaginary', line, pixel, {R('im', 'value')} FROM cx")
def stacked_bands(spark, sf_dir):
    x = image(spark, sf_dir)
    parts = [x.select("line", "pixel", F.col(c).alias("value")) for c in ("re", "im")]
    return lookups.summed_bands(parts, ["real", "imaginary"])


def _hermite_sql() -> str:
    """The degree-seven polynomial through four vectors ten seconds apart, on a circle."""
    terms = {c: [] for c in ("x", "z", "vx", "vz")}
    for i in range(4):
        h = " * ".join(f"(u - {j}) / {float(i - j)}" for j in range(4) if j != i)
        s = sum(1 / (i - j) for j in range(4) if j != i)
        dh = "(" + " + ".join(f"{1 / (i - j)!r}" + "".join(f" * (u - {k}) / {float(i - k)}" for k in range(4) if k not in (i, j)) for j in range(4) if j != i) + ")"
        f0, f1 = f"(1 - 2 * {s!r} * (u - {i}))", f"(10 * (u - {i}))"
        a = f"(k + {i}) * 0.0105"
        for c, pos, vel in (("x", f"7100000 * cos({a})", f"-7455 * sin({a})"), ("z", f"7100000 * sin({a})", f"7455 * cos({a})")):
            terms[c].append(f"pow({h}, 2) * ({f0} * {pos} + {f1} * {vel})")
            terms[f"v{c}"].append(f"({h}) * ((2 * ({f0} * {dh} - {s!r} * ({h}))) * {pos} / 10 + (({h}) + 2 * {dh} * (u - {i})) * {vel})")
    out = ", ".join(f"round({' + '.join(v)}, 3) + 0.0 AS {c}" for c, v in terms.items())
    return f"WITH p AS (SELECT event_id AS probe, (event_id * 37 % 9001) / 10.0 AS t FROM events), q AS (SELECT *, least(greatest(CAST(ceil(t / 10) AS BIGINT) - 2, 0), 87) AS k FROM p), r AS (SELECT probe, k, t / 10 - k AS u FROM q) SELECT probe, {out}, CAST(0 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS vy FROM r"


def circle(spark, n: int = 91):
    a = F.col("id") * 0.0105
    zero = F.lit(0.0)
    return spark.range(n).select((F.col("id") * 10.0).alias("t"), (7_100_000 * F.cos(a)).alias("x"), zero.alias("y"), (7_100_000 * F.sin(a)).alias("z"), (-7455 * F.sin(a)).alias("vx"), zero.alias("vy"), (7455 * F.cos(a)).alias("vz"))


@query(_hermite_sql(), 3)
def orbit_interpolation(spark, sf_dir):
    probes = table(spark, sf_dir, "events").select(F.col("event_id").alias("probe"), (F.col("event_id") * 37 % 9001 / 10.0).alias("t"))
    return lookups.orbit_at(probes, circle(spark))


@query("SELECT event_id AS probe, round(7100000 * cos((event_id * 37 % 9001) * 0.000105), 2) + 0.0 AS x, CAST(0 AS DOUBLE) AS y, round(7100000 * sin((event_id * 37 % 9001) * 0.000105), 2) + 0.0 AS z, round(-745.5 * sin((event_id * 37 % 9001) * 0.000105), 2) + 0.0 AS vx, CAST(0 AS DOUBLE) AS vy, round(745.5 * cos((event_id * 37 % 9001) * 0.000105), 2) + 0.0 AS vz FROM events", 2)
def orbit_legendre(spark, sf_dir):
    """Positions and velocities by nine-point polynomials: to a centimetre what the circle itself has."""
    slow = circle(spark).withColumns({"vx": F.col("vx") / 10, "vz": F.col("vz") / 10})
    probes = table(spark, sf_dir, "events").select(F.col("event_id").alias("probe"), (F.col("event_id") * 37 % 9001 / 10.0).alias("t"))
    return lookups.orbit_at(probes, slow, "legendre")

