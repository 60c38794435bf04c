"""Ionosphere and troposphere as columns: two bands to dispersive and other phase, unwrapping errors, electron content."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of delay of one electron per square metre, times the frequency squared; electrons in a content unit.
DELAY, UNIT = 40.31, 1e16


def _solved(a: float, b: float, c: float, d: float, u: Column, v: Column) -> tuple[Column, Column]:
    """x, y of a x + b y = u, c x + d y = v."""
    det = a * d - b * c
    return (d * u - b * v) / det, (a * v - c * u) / det


def main_side(f0: float, f1: float, main: Column, side: Column) -> tuple[Column, Column]:
    """Dispersive and non-dispersive phase from the main band and a side band."""
    other, dispersive = _solved(1.0, 1.0, f1 / f0, f0 / f1, main, side)
    return dispersive, other


def main_difference(f0: float, f1: float, main: Column, side: Column) -> tuple[Column, Column]:
    """Dispersive and non-dispersive phase from the main band and its difference to a side band."""
    return _solved(1.0, 1.0, (f1 - f0) / f1, (f0 - f1) / f0, main, main - side)


TWO_PI = 2 * math.pi


def jumps_main_difference(f0: float, f1: float, dispersive: Column, other: Column, main: Column, side: Column) -> tuple[Column, Column]:
    """Whole turns by which both unwrapped phases are off, and those by which they differ."""
    differ = F.rint(((1 - f1 / f0) * other + (1 - f0 / f1) * dispersive + side - main) / TWO_PI)
    return F.rint((main - other - dispersive) / TWO_PI), differ


def jumps_main_side(f0: float, f1: float, dispersive: Column, other: Column, main: Column, side: Column) -> tuple[Column, Column]:
    _, differ = jumps_main_difference(f0, f1, dispersive, other, main, side)
    both = main + side - (1 + f1 / f0) * other - (1 + f0 / f1) * dispersive
    return F.rint((both - TWO_PI * differ) / (2 * TWO_PI)), differ


def jumps_low_high(f0: float, fl: float, fh: float, dispersive: Column, other: Column, low: Column, high: Column) -> tuple[Column, Column]:
    gap = fh - fl
    differ = F.rint((high - low - gap / f0 * other + f0 * gap / (fh * fl) * dispersive) / TWO_PI)
    return F.rint((low + high - 2 * other - 2 * dispersive) / (2 * TWO_PI) - differ / 2), differ


def below_orbit(total: Column, above: Column) -> Column:
    """Electron content between ground and platform."""
    return total - above


def content_delay(content: Column, frequency: float, incidence: Column) -> Column:
    """Slant range delay in metres of a vertical electron content in content units."""
    return DELAY * UNIT * content / frequency**2 / F.cos(incidence)


def slant_difference(reference: Column, secondary: Column, incidence: Column, wavelength: float) -> Column:
    """Phase between two zenith delays along the line of sight."""
    return 4 * math.pi / wavelength * (secondary - reference) / F.cos(incidence)


def tide_along_sight(east: Column, north: Column, up: Column, look: tuple[Column, Column, Column]) -> Column:
    """A displacement's part along a unit line of sight."""
    return east * look[0] + north * look[1] + up * look[2]
