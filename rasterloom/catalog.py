"""All queries of the raster engine by name, with their SQL."""

from __future__ import annotations

from .plans import channels, estimates, flows, functions, imaging, kernels, raster, samples  # noqa: F401  they add their queries to raster's


def queries() -> dict:
    return dict(raster.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(raster.SQL)
