"""Radar geometry on real orbits: image to ground and back, layers, geocoding and terrain correction.

An orbit and a terrain tile are of a fixed bounded size and go to every task with the
function; rows are only read, mapped and written, so nothing is shuffled but what is summed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import orbits as O
from ..functions.orbits import Orbit, dot
from .kernels import resample_tile

Doppler = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Samples of a terrain tile at most: 128 MB of doubles. A larger model is cut into tiles and the rows dealt to them.
CELLS = 1 << 24


class Terrain:
    """Heights on a regular grid of longitude and latitude in radians, bilinear; a fixed height outside."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, height: np.ndarray, outside: float = 0.0):
        if height.size > CELLS:
            raise ValueError("a terrain tile has too many samples: cut it")
        self.lon, self.lat, self.height, self.outside = lon, lat, height, outside

    def __call__(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        x = (lon - self.lon[0]) / (self.lon[1] - self.lon[0])
        y = (lat - self.lat[0]) / (self.lat[1] - self.lat[0])
        with np.errstate(invalid="ignore"):
            inside = (x >= 0) & (x <= len(self.lon) - 1) & (y >= 0) & (y <= len(self.lat) - 1)
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        i, j = np.minimum(y.astype(int), len(self.lat) - 2), np.minimum(x.astype(int), len(self.lon) - 2)
        u, v, h = y - i, x - j, self.height
        out = (1 - u) * ((1 - v) * h[i, j] + v * h[i, j + 1]) + u * ((1 - v) * h[i + 1, j] + v * h[i + 1, j + 1])
        return np.where(inside, out, self.outside)


def orbit_of(vectors: DataFrame, method: str = "hermite") -> Orbit:
    """The orbit of a table of state vectors (t, x, y, z, vx, vy, vz) of bounded length."""
    rows = vectors.orderBy("t").limit(O.MOST + 1).collect()
    if len(rows) > O.MOST:
        raise ValueError(f"an orbit has at most {O.MOST} state vectors; crop it first")
    return Orbit(np.array([[r[c] for c in ("t", "x", "y", "z", "vx", "vy", "vz")] for r in rows], float), method)


def _mapped(rows: DataFrame, names: list[str], kernel: Callable[..., dict[str, np.ndarray]], out: list[str]) -> DataFrame:
    """The rows' id with what kernel makes of their columns, all rows of a batch at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = kernel(*(pdf[c].to_numpy(float) for c in names))
            yield pd.DataFrame({"id": pdf["id"], **{c: got[c] for c in out}})

    return rows.select("id", *names).mapInPandas(run, "id long, " + ", ".join(f"{c} double" for c in out))


def to_radar(places: DataFrame, orbit: Orbit, wavelength: float, doppler: Doppler | None = None, right: bool = True) -> DataFrame:
    """Azimuth time and slant range of places (id, lon, lat, h; radians and metres); nan where none is found."""

    def kernel(lon: np.ndarray, lat: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
        t, r = O.geo2rdr(O.to_xyz(lon, lat, h), orbit, wavelength, doppler, right)
        return {"time": t, "slant": r}

    return _mapped(places, ["lon", "lat", "h"], kernel, ["time", "slant"])


def to_ground(samples: DataFrame, orbit: Orbit, wavelength: float, terrain: Callable | None = None, doppler: Doppler | None = None, right: bool = True) -> DataFrame:
    """Longitude, latitude and height of radar samples (id, time, slant) on the terrain."""

    def kernel(t: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
        return dict(zip(("lon", "lat", "h"), O.rdr2geo(t, r, orbit, wavelength, terrain, doppler, right), strict=True))

    return _mapped(samples, ["time", "slant"], kernel, ["lon", "lat", "h"])


def to_other_radar(samples: DataFrame, first: Orbit, second: Orbit, wavelength: float, terrain: Callable | None = None, right: bool = True) -> DataFrame:
    """Where the samples (id, time, slant) of one acquisition lie in another: time and slant there."""

    def kernel(t: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
        xyz = O.to_xyz(*O.rdr2geo(t, r, first, wavelength, terrain, None, right))
        return dict(zip(("time", "slant"), O.geo2rdr(xyz, second, wavelength, None, right), strict=True))

    return _mapped(samples, ["time", "slant"], kernel, ["time", "slant"])


def layers(samples: DataFrame, orbit: Orbit, wavelength: float, terrain: Callable | None = None, right: bool = True, step: float = 1e-5) -> DataFrame:
    """Ground place, incidence, heading, local incidence, projection angle, line of sight (east, north) and amplitude of samples (id, time, slant).

    The terrain's slope comes from its heights a step of longitude and latitude to either side.
    """

    def kernel(t: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
        lon, lat, h = O.rdr2geo(t, r, orbit, wavelength, terrain, None, right)
        xyz = O.to_xyz(lon, lat, h)
        p, v = orbit(t)
        look = p - xyz
        look /= np.sqrt(dot(look, look))[:, None]
        east = np.stack([-np.sin(lon), np.cos(lon), np.zeros_like(lon)], -1)
        north = np.stack([-np.sin(lat) * np.cos(lon), -np.sin(lat) * np.sin(lon), np.cos(lat)], -1)
        up = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)
        e, n, u = dot(look, east), dot(look, north), dot(look, up)
        height = terrain or (lambda a, b: np.zeros_like(a))
        radius = np.sqrt(dot(xyz, xyz))
        dx = (height(lon + step, lat) - height(lon - step, lat)) / (2 * step * radius * np.cos(lat))
        dy = (height(lon, lat + step) - height(lon, lat - step)) / (2 * step * radius)
        size = np.sqrt(dx * dx + dy * dy + 1)
        local = np.arccos(np.clip((u - dx * e - dy * n) / size, -1, 1))
        side = np.cross(look, v)
        side /= np.sqrt(dot(side, side))[:, None]
        psi = np.arccos(np.clip((dot(side, up) - dx * dot(side, east) - dy * dot(side, north)) / size, -1, 1))
        sine = np.abs(np.sin(local)) + 0.1 * np.abs(np.cos(local))
        return {
            "lon": lon, "lat": lat, "h": h, "incidence": np.arccos(np.clip(u, -1, 1)), "heading": np.arctan2(dot(v, east), dot(v, north)), "local_incidence": local,
            "local_psi": psi, "east": e, "north": n, "amplitude": np.log10(np.maximum(1e-5, 0.01 * np.cos(local) / sine)),
        }

    return _mapped(samples, ["time", "slant"], kernel, ["lon", "lat", "h", "incidence", "heading", "local_incidence", "local_psi", "east", "north", "amplitude"])


def grid_layers(places: DataFrame, orbit: Orbit, wavelength: float, terrain: Callable | None = None, right: bool = True) -> DataFrame:
    """Radar time, range, incidence, look angle, line of sight and ground speed of map places (id, lon, lat), on the terrain."""

    def kernel(lon: np.ndarray, lat: np.ndarray) -> dict[str, np.ndarray]:
        h = terrain(lon, lat) if terrain else np.zeros_like(lon)
        xyz = O.to_xyz(lon, lat, h)
        t, r = O.geo2rdr(xyz, orbit, wavelength, None, right)
        p, v = orbit(t)
        look = p - xyz
        far = np.sqrt(dot(look, look))
        up = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)
        east = np.stack([-np.sin(lon), np.cos(lon), np.zeros_like(lon)], -1)
        north = np.cross(up, east)
        reach = np.sqrt(dot(p, p))
        return {
            "time": t, "slant": r, "h": h, "incidence": np.arccos(dot(look, up) / far), "look": np.arccos(dot(look, p) / (far * reach)), "east": dot(look, east) / far, "north": dot(look, north) / far,
            "ground_speed": np.sqrt(dot(v, v)) * np.sqrt(dot(xyz, xyz)) / reach,
        }

    return _mapped(places, ["lon", "lat"], kernel, ["time", "slant", "h", "incidence", "look", "east", "north", "ground_speed"])


def baselines(places: DataFrame, first: Orbit, second: Orbit, wavelength: float, right: bool = True) -> DataFrame:
    """Baseline along the first's line of sight and across it (positive above) at places (id, lon, lat, h)."""

    def kernel(lon: np.ndarray, lat: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
        xyz = O.to_xyz(lon, lat, h)
        (p, v), (q, _) = first(O.geo2rdr(xyz, first, wavelength, None, right)[0]), second(O.geo2rdr(xyz, second, wavelength, None, right)[0])
        look = xyz - p
        r1, r2, b = np.sqrt(dot(look, look)), np.sqrt(dot(xyz - q, xyz - q)), np.sqrt(dot(q - p, q - p))
        cosine = np.divide(r1**2 + b**2 - r2**2, 2 * r1 * b, out=np.ones_like(b), where=b > 0)
        along = b * cosine
        across = np.sqrt(np.maximum(b * b - along * along, 0))
        sign = np.where(dot(np.cross(look, q - p), v) > 0, 1.0, -1.0)
        return {"parallel": along, "across": sign * across}

    return _mapped(places, ["lon", "lat", "h"], kernel, ["parallel", "across"])


def perimeter(t0: float, t1: float, r0: float, r1: float, points: int, spark) -> DataFrame:
    """Samples (id, time, slant) along the edges of a radar grid, once around."""
    k = F.col("id") % points / points
    side = F.floor(F.col("id") / points)
    time = F.when(side == 0, t0).when(side == 1, t0 + k * (t1 - t0)).when(side == 2, t1).otherwise(t1 - k * (t1 - t0))
    slant = F.when(side == 0, r0 + k * (r1 - r0)).when(side == 1, r1).when(side == 2, r1 - k * (r1 - r0)).otherwise(r0)
    return spark.range(4 * points).select("id", time.cast("double").alias("time"), slant.cast("double").alias("slant"))


def geocoded_slc(image: DataFrame, places: DataFrame, orbit: Orbit, wavelength: float, start: float, prf: float, near: float, spacing: float, block: int = 512, terrain: Callable | None = None, taps: int = 8) -> DataFrame:
    """A complex image of lines (line, re, im) at map places (id, lon, lat), with the range phase taken off.

    Places get their line and pixel first; they and the lines meet by blocks of lines, each with
    the lines that the taps reach, and are interpolated there by a sinc.
    """
    at = grid_layers(places, orbit, wavelength, terrain).where(~F.isnan("time"))
    at = at.select("id", ((F.col("time") - start) * prf).alias("y"), ((F.col("slant") - near) / spacing).alias("x"), "slant")
    at = at.withColumn("block", F.floor(F.col("y") / block))
    lines = image.withColumn("block", F.explode(F.sequence(F.floor((F.col("line") - taps) / block), F.floor((F.col("line") + taps) / block))))

    def run(key: tuple, wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted) or not len(held):
            return pd.DataFrame({"id": [], "re": [], "im": []})
        held = held.sort_values("line")
        first, n = int(held["line"].iloc[0]), max(len(a) for a in held["re"])
        z = np.zeros((int(held["line"].iloc[-1]) - first + 1, n), complex)
        for i, a, b in zip(held["line"], held["re"], held["im"], strict=True):
            z[int(i) - first, : len(a)] = np.asarray(a, float) + 1j * np.asarray(b, float)
        out = resample_tile(z, wanted["y"].to_numpy(float) - first, wanted["x"].to_numpy(float), taps)
        out *= np.exp(4j * math.pi / wavelength * wanted["slant"].to_numpy(float))
        return pd.DataFrame({"id": wanted["id"], "re": out.real, "im": out.imag})

    return at.groupBy("block").cogroup(lines.groupBy("block")).applyInPandas(run, "id long, re double, im double")


def terrain_factor(samples: DataFrame, orbit: Orbit, wavelength: float, terrain: Callable) -> DataFrame:
    """Area factor of each radar sample (id, time, slant): the ground area it sees, projected along the line of sight, over a flat one."""
    x = layers(samples, orbit, wavelength, terrain)
    return x.select("id", (F.sin("incidence") / F.greatest(F.sin("local_incidence"), F.lit(1e-3))).alias("factor"))
