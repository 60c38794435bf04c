"""Queries of whole chains, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import workflows as W
from ..sources.rasters import table
from .raster import _QUAD, PAIR, WHOLE, R, quad, query, shape

_LOOKS = f"{PAIR}, {WHOLE.format(l=2, p=2, t='pr')}, k AS (SELECT line // 2 AS line, pixel // 2 AS pixel, avg(re*re2 + im*im2) AS a, avg(im*re2 - re*im2) AS b, sqrt(avg(re*re + im*im) * avg(re2*re2 + im2*im2)) AS p FROM pr, lim WHERE line // 2 < lim.l AND pixel // 2 < lim.p GROUP BY 1, 2)"


def _boxcar(c: str) -> str:
    return f"sum({c}) OVER (PARTITION BY pixel ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 9"


@query(f"WITH {_LOOKS}, r AS (SELECT line, pixel, sum(a) OVER w AS a, sum(b) OVER w AS b, sqrt(a*a + b*b) / p AS c FROM k WINDOW w AS (PARTITION BY line ORDER BY pixel ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), f AS (SELECT line, pixel, {_boxcar('a')} AS re, {_boxcar('b')} AS im, c FROM r) SELECT line, pixel, {R('re', 're')}, {R('im', 'im')}, {R('atan2(im, re)', 'phase')}, {R('c', 'coherence')} FROM f")
def filtered_interferogram(spark, sf_dir):
    """The first steps of the interferometry chain: join, looks, coherence, filter."""
    height, width = shape(spark, sf_dir, 2)
    lines = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line"), F.col("embedding").alias("values"))
    tables = {"reference": lines, "secondary": lines.withColumn("line", F.col("line") - 1)}
    tables["interferogram"] = W._looks(tables, {"lines": 2, "pixels": 2, "shape": (height - 1, width)})
    return W._smooth(tables, {"half": 1})


@query()
def interferometry_chain(spark, sf_dir):
    """To unwrapped phase; tests hold the steps against closed forms."""
    height, width = shape(spark, sf_dir, 2)
    lines = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line"), F.col("embedding").alias("values"))
    tables = {"reference": lines, "secondary": lines.withColumn("line", F.col("line") - 1)}
    options = {"lines": 2, "pixels": 2, "shape": (height - 1, width), "coherence": 0.2, "reach": 6}
    for name, step in W.INTERFEROMETRY.steps:
        tables[name] = step(tables, options)
    return tables["unwrap"]


@query(
    f"WITH {_QUAD}, c AS (SELECT line * 0.3 AS y0, line * 0.3 + 0.8 AS y1, pixel * 0.4 AS x0, pixel * 0.4 + 0.9 AS x1, hh_re*hh_re + hh_im*hh_im AS v FROM q), e AS (SELECT *, unnest(range(CAST(floor(y0) AS BIGINT), CAST(ceil(y1) AS BIGINT))) AS line FROM c), g AS (SELECT *, unnest(range(CAST(floor(x0) AS BIGINT), CAST(ceil(x1) AS BIGINT))) AS pixel FROM e), w AS (SELECT line, pixel, v, CAST(least(line + 1, y1) - greatest(line, y0) AS DOUBLE) * CAST(least(pixel + 1, x1) - greatest(pixel, x0) AS DOUBLE) AS w FROM g) SELECT line, pixel, round(sum(w * v) / sum(w), 5) + 0.0 AS value, round(sum(w), 5) + 0.0 AS looks FROM w GROUP BY 1, 2", 5
)
def covariance_chain(spark, sf_dir):
    tables = {"quad": quad(spark, sf_dir)}
    for name, step in W.COVARIANCE.steps:
        tables[name] = step(tables, {"lines": 20})
    return tables["geocode"]
