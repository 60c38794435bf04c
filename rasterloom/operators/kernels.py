"""Numeric kernels on whole lines and tiles: Arrow batches in, lines of equal length stacked, one NumPy call for all of them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stacks(columns: list[pd.Series]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The rows whose arrays have equal lengths, and those arrays as one array (rows, length) per column."""
    arrays = [[np.asarray(x if x is not None else [], float) for x in c] for c in columns]
    size = np.array([[len(x) for x in c] for c in arrays]).T.reshape(len(arrays[0]), len(columns))
    for shape in np.unique(size, axis=0):
        rows = np.flatnonzero((size == shape).all(axis=1))
        yield rows, [np.array([c[i] for i in rows]).reshape(len(rows), n) for c, n in zip(arrays, shape, strict=True)]


def on_lines(lines: DataFrame, names: list[str], kernel: Callable[..., tuple[np.ndarray, ...]], out: list[str], key: str = "line") -> DataFrame:
    """Applies kernel, from arrays (rows, n) to arrays (rows, m), to the array columns of every line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: list[list] = [[None] * len(pdf) for _ in out]
            for rows, arrays in stacks([pdf[c] for c in names]) if len(pdf) else ():
                for column, result in zip(got, kernel(*arrays), strict=True):
                    for i, x in zip(rows.tolist(), result, strict=True):
                        column[i] = x
            yield pd.DataFrame({key: pdf[key], **{c: pd.Series(x, index=pdf.index, dtype=object) for c, x in zip(out, got, strict=True)}})

    return lines.select(key, *names).mapInPandas(run, f"{key} long, " + ", ".join(f"{c} array<double>" for c in out))


def spectrum(lines: DataFrame) -> DataFrame:
    """Power spectrum of each line (line, values), unnormalised: one row per frequency bin."""
    x = on_lines(lines, ["values"], lambda v: (np.abs(np.fft.fft(v, axis=1)) ** 2 if v.shape[1] else v,), ["power"])
    return x.select("line", F.posexplode("power").alias("bin", "power"))


def tiles(lines: DataFrame, height: int, width: int) -> DataFrame:
    """Whole tiles of a raster of lines (line, values): ty, tx, values in raster order; partial ones at the edges are dropped."""
    n = F.floor(F.size("values") / width).cast("int")
    x = lines.select("line", F.posexplode(F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("values", i * width + 1, width)))).alias("tx", "part"))
    x = x.withColumn("ty", F.floor(F.col("line") / height)).groupBy("ty", "tx").agg(F.array_sort(F.collect_list(F.struct("line", "part"))).alias("rows"))
    return x.where(F.size("rows") == height).select("ty", "tx", F.flatten(F.transform("rows", lambda r: r["part"])).alias("values"))


def spectrum2d(tiled: DataFrame, height: int, width: int) -> DataFrame:
    """Power spectrum of each tile: ty, tx, ky, kx, power."""
    x = tiled.withColumn("id", F.struct("ty", "tx")).select(F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"), "values")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.array([np.asarray(a, float) for a in pdf["values"]]).reshape(len(pdf), height, width)
            p = np.abs(np.fft.fft2(v)) ** 2
            yield pd.DataFrame({"ty": pdf["ty"], "tx": pdf["tx"], "power": list(p.reshape(len(pdf), -1))})

    out = x.mapInPandas(run, "ty long, tx long, power array<double>").select("ty", "tx", F.posexplode("power").alias("k", "power"))
    return out.select("ty", "tx", F.floor(F.col("k") / width).cast("int").alias("ky"), (F.col("k") % width).alias("kx"), "power")


def compressed(lines: DataFrame, replica: np.ndarray, mode: str = "valid") -> DataFrame:
    """Range compression: correlation of each line with a complex replica by FFT; mode full, valid or same."""
    m = len(replica)

    def kernel(x: np.ndarray) -> tuple[np.ndarray, ...]:
        n = x.shape[1]
        if n < (m if mode == "valid" else 1):
            return (np.empty((len(x), 0)),) * 2
        size = 1 << (n + m - 2).bit_length()
        y = np.fft.ifft(np.fft.fft(x, size) * np.conj(np.fft.fft(replica, size)))
        y = np.concatenate([y[:, size - m + 1 :], y[:, :n]], axis=1)  # from the first sample the replica's end meets
        first, length = {"full": (0, n + m - 1), "valid": (m - 1, n - m + 1), "same": ((m - 1) // 2, n)}[mode]
        y = y[:, first : first + length]
        return y.real, y.imag

    return on_lines(lines, ["values"], kernel, ["re", "im"])


def match(pairs: DataFrame, search: int) -> DataFrame:
    """Offset of b (array) against a within +-search samples by normalised correlation, refined by a parabola."""

    def kernel(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        chip = a[:, search : a.shape[1] - search]
        chip = chip - chip.mean(1, keepdims=True)
        part = np.lib.stride_tricks.sliding_window_view(b, chip.shape[1], axis=1)[:, : 2 * search + 1]
        part = part - part.mean(2, keepdims=True)
        norm = np.sqrt((chip**2).sum(1)[:, None] * (part**2).sum(2))
        score = np.divide((part * chip[:, None]).sum(2), norm, out=np.zeros_like(norm), where=norm > 0)
        k, rows = score.argmax(1), np.arange(len(score))
        left, mid, right = (score[rows, np.clip(k + d, 0, 2 * search)] for d in (-1, 0, 1))
        bend = left - 2 * mid + right
        shift = np.divide(0.5 * (left - right), bend, out=np.zeros_like(bend), where=(k > 0) & (k < 2 * search) & (bend != 0))
        return (k - search + shift)[:, None], mid[:, None]

    x = on_lines(pairs, ["a", "b"], kernel, ["offset", "correlation"])
    return x.select("line", F.col("offset")[0].alias("offset"), F.col("correlation")[0].alias("correlation"))


def shifted(lines: DataFrame, shift: float) -> DataFrame:
    """Each line (line, values) moved by ``shift`` samples, circularly, by a phase ramp over its spectrum."""

    def kernel(x: np.ndarray) -> tuple[np.ndarray]:
        if not x.shape[1]:
            return (x,)
        f = np.fft.fftfreq(x.shape[1])
        ramp = np.where(np.abs(f) == 0.5, np.cos(np.pi * shift), np.exp(-2j * np.pi * f * shift))
        return (np.fft.ifft(np.fft.fft(x) * ramp).real,)

    return on_lines(lines, ["values"], kernel, ["values"])


def upsampled(lines: DataFrame, factor: int) -> DataFrame:
    """Each line with ``factor`` times the samples, by zeros put into the middle of its spectrum."""

    def kernel(x: np.ndarray) -> tuple[np.ndarray]:
        n = x.shape[1]
        if not n:
            return (x,)
        half = np.where((np.arange(n // 2 + 1) * 2 == n) & (factor > 1), 0.5, 1.0)
        return (np.fft.irfft(np.fft.rfft(x) * half, n * factor) * factor,)

    return on_lines(lines, ["values"], kernel, ["values"])


def band(n: int, low: float, high: float, taper: float = 0.0) -> np.ndarray:
    """The weights of n FFT bins for frequencies in cycles a sample: 1 within [low, high], down along a cosine of width ``taper`` beyond."""
    f = np.fft.fftfreq(n)
    away = np.maximum(np.maximum(low - f, f - high), 0.0)
    if not taper:
        return (away == 0).astype(float)
    return np.where(away < taper, 0.5 * (1 + np.cos(np.pi * away / taper)), 0.0)


def band_pass(lines: DataFrame, low: float, high: float, taper: float = 0.0) -> DataFrame:
    """Each complex line (line, re, im) with the frequencies outside [low, high] taken out: boxcar, or with cosine flanks."""

    def kernel(re: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, ...]:
        if not re.shape[1]:
            return re, im
        z = np.fft.ifft(np.fft.fft(re + 1j * im) * band(re.shape[1], low, high, taper))
        return z.real, z.imag

    return on_lines(lines, ["re", "im"], kernel, ["re", "im"])


def common_band(lines: DataFrame, centre1: str, centre2: str, width: float) -> DataFrame:
    """Azimuth common band of a column kept as a line (line, re, im, and two Doppler centres in cycles a sample): what both spectra hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            re, im = [], []
            for a, b, f1, f2 in zip(pdf["re"], pdf["im"], pdf[centre1], pdf[centre2], strict=True):
                z, f = np.asarray(a, float) + 1j * np.asarray(b, float), np.fft.fftfreq(max(1, len(a)))
                keep = (np.abs((f - f1 + 0.5) % 1 - 0.5) <= width / 2) & (np.abs((f - f2 + 0.5) % 1 - 0.5) <= width / 2)
                y = np.fft.ifft(np.fft.fft(z) * keep) if len(a) else z
                re.append(y.real)
                im.append(y.imag)
            yield pd.DataFrame({"line": pdf["line"], "re": re, "im": im})

    return lines.select("line", "re", "im", centre1, centre2).mapInPandas(run, "line long, re array<double>, im array<double>")


def split_spectrum(lines: DataFrame, low: float, high: float, taper: float = 0.0) -> DataFrame:
    """A sub-band of each complex line, moved to zero frequency and down to the samples it needs."""
    middle = (low + high) / 2

    def kernel(re: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, ...]:
        n = re.shape[1]
        if not n:
            return re, im
        z = np.fft.ifft(np.fft.fft(re + 1j * im) * band(n, low, high, taper)) * np.exp(-2j * np.pi * middle * np.arange(n))
        step = max(1, int(1 / max(high - low, 1e-9)))
        z = z[:, ::step]
        return z.real, z.imag

    return on_lines(lines, ["re", "im"], kernel, ["re", "im"])


def nonuniform_spectrum(lines: DataFrame, bins: int) -> DataFrame:
    """Fourier sums of samples at any places: lines (line, place, values), place in periods, to bins 0 .. bins - 1, by one matrix product a length."""

    def kernel(place: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        out = np.empty((len(x), bins), complex)
        for k in range(bins):
            out[:, k] = (x * np.exp(-2j * np.pi * k * place)).sum(1)
        return out.real, out.imag

    return on_lines(lines, ["place", "values"], kernel, ["re", "im"])


def sinc_taps(fraction: np.ndarray, taps: int = 8, beta: float = 5.0) -> np.ndarray:
    """Weights of the ``taps`` samples about a place that lies ``fraction`` after the middle left one: a Kaiser-tapered sinc, summing to 1."""
    k = np.arange(taps) - (taps // 2 - 1)
    x = fraction[..., None] - k
    w = np.sinc(x) * np.i0(beta * np.sqrt(np.maximum(0.0, 1 - (x / (taps / 2)) ** 2))) / np.i0(beta)
    return w / w.sum(-1, keepdims=True)


def resample_tile(z: np.ndarray, y: np.ndarray, x: np.ndarray, taps: int = 8, doppler: np.ndarray | None = None) -> np.ndarray:
    """A complex tile at places (y, x) by a separable sinc; 0 where the taps leave the tile. doppler (cycles a line, by column) is taken off before and put back."""
    rows, columns = z.shape
    base = z if doppler is None else z * np.exp(-2j * np.pi * np.arange(rows)[:, None] * doppler[None, :])
    iy, ix = np.floor(y).astype(int), np.floor(x).astype(int)
    wy, wx = sinc_taps(y - iy, taps), sinc_taps(x - ix, taps)
    at = np.arange(taps) - (taps // 2 - 1)
    ty, tx = iy[..., None] + at, ix[..., None] + at
    inside = (ty[..., 0] >= 0) & (ty[..., -1] < rows) & (tx[..., 0] >= 0) & (tx[..., -1] < columns)
    ty, tx = np.clip(ty, 0, rows - 1), np.clip(tx, 0, columns - 1)
    out = (base[ty[..., :, None], tx[..., None, :]] * wy[..., :, None] * wx[..., None, :]).sum((-1, -2))
    if doppler is not None:
        out *= np.exp(2j * np.pi * y * np.interp(x, np.arange(columns), doppler))
    return np.where(inside, out, 0)


def resampled(image: DataFrame, line_offset: Callable[[np.ndarray, np.ndarray], np.ndarray], pixel_offset: Callable[[np.ndarray, np.ndarray], np.ndarray], reach: int, block: int = 512, taps: int = 8) -> DataFrame:
    """A complex image of lines (line, re, im) at (line + line_offset, pixel + pixel_offset), functions of line and pixel.

    Lines are dealt into blocks, each with the lines that offsets of up to ``reach`` and the
    taps reach to, so a task holds one block.
    """
    halo = reach + taps
    dealt = image.withColumn("block", F.explode(F.sequence(F.floor((F.col("line") - halo) / block), F.floor((F.col("line") + halo) / block))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line")
        n = max(len(a) for a in pdf["re"])
        first, last = int(pdf["line"].iloc[0]), int(pdf["line"].iloc[-1])
        z = np.zeros((last - first + 1, n), complex)
        for i, a, b in zip(pdf["line"], pdf["re"], pdf["im"], strict=True):
            z[int(i) - first, : len(a)] = np.asarray(a, float) + 1j * np.asarray(b, float)
        own = pdf["line"][(pdf["line"] // block) == key[0]].to_numpy()
        rows, columns = np.meshgrid(own, np.arange(n), indexing="ij")
        out = resample_tile(z, rows + line_offset(rows, columns) - first, columns + pixel_offset(rows, columns), taps)
        return pd.DataFrame({"line": own, "re": pd.Series(list(out.real), dtype=object), "im": pd.Series(list(out.imag), dtype=object)})

    return dealt.groupBy("block").applyInPandas(run, "line long, re array<double>, im array<double>")


def correlation_surface(chip: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Normalised correlation of a chip with every part of a larger window of its size, by FFT and summed-area tables."""
    h, w = chip.shape
    size = [1 << (n - 1).bit_length() for n in window.shape]
    c = chip - chip.mean()
    top = np.fft.irfft2(np.fft.rfft2(window, size) * np.conj(np.fft.rfft2(c, size)), size)[: window.shape[0] - h + 1, : window.shape[1] - w + 1]

    def sums(x: np.ndarray) -> np.ndarray:
        t = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return t[h:, w:] - t[:-h, w:] - t[h:, :-w] + t[:-h, :-w]

    var = sums(window**2) - sums(window) ** 2 / (h * w)
    norm = np.sqrt(np.maximum(var, 0) * (c**2).sum())
    return np.divide(top, norm, out=np.zeros_like(top), where=norm > 1e-12 * max(1.0, float(np.abs(window).max()) ** 2))


def peak_of(surface: np.ndarray) -> tuple[float, float, float]:
    """The place of the largest value, refined by a quadratic surface over its neighbours, and that value."""
    i, j = np.unravel_index(surface.argmax(), surface.shape)
    y, x = float(i), float(j)
    if 0 < i < surface.shape[0] - 1 and 0 < j < surface.shape[1] - 1:
        s = surface[i - 1 : i + 2, j - 1 : j + 2]
        gy, gx = (s[2, 1] - s[0, 1]) / 2, (s[1, 2] - s[1, 0]) / 2
        hyy, hxx = s[2, 1] - 2 * s[1, 1] + s[0, 1], s[1, 2] - 2 * s[1, 1] + s[1, 0]
        hxy = (s[2, 2] - s[2, 0] - s[0, 2] + s[0, 0]) / 4
        det = hyy * hxx - hxy * hxy
        if det > 1e-12 and hyy < 0:
            y += float(np.clip((hxy * gx - hxx * gy) / det, -1, 1))
            x += float(np.clip((hxy * gy - hyy * gx) / det, -1, 1))
    return y, x, float(surface[i, j])


def match2d(chips: DataFrame, height: int, width: int, search: int) -> DataFrame:
    """Offsets of windows against chips: rows (id, chip, window), arrays in raster order, the window ``search`` larger on every side.

    Returns id, dy, dx (of the best place from the middle), correlation, snr (peak over the
    mean of the rest of the surface, squared) and the variance of the surface about its peak.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, chip, window in zip(pdf["id"], pdf["chip"], pdf["window"], strict=True):
                s = correlation_surface(np.asarray(chip, float).reshape(height, width), np.asarray(window, float).reshape(height + 2 * search, width + 2 * search))
                y, x, best = peak_of(s)
                rest = (np.sum(s**2) - best**2) / max(1, s.size - 1)
                rows.append((key, y - search, x - search, best, best**2 / rest if rest > 0 else 0.0, float(s.var())))
            yield pd.DataFrame(rows, columns=["id", "dy", "dx", "correlation", "snr", "variance"])

    return chips.select("id", "chip", "window").mapInPandas(run, "id long, dy double, dx double, correlation double, snr double, variance double")


def cut_of(power: np.ndarray, level: float) -> float:
    """The width of the main lobe of a cut at a share ``level`` of its peak, by linear interpolation."""
    k = int(power.argmax())
    edges = []
    for step in (-1, 1):
        i = k
        while 0 < i < len(power) - 1 and power[i] > level * power[k]:
            i += step
        a, b = power[i - step], power[i]
        edges.append(i - step + step * ((a - level * power[k]) / (a - b) if a != b else 0.0))
    return edges[1] - edges[0]


def point_target(z: np.ndarray, factor: int = 16) -> dict[str, float]:
    """Impulse response of a complex chip: peak place, width at half power, peak and integrated side-lobe ratio in dB, along lines (y) and pixels (x)."""
    n, m = z.shape
    spread = np.fft.fft2(z)
    rows, columns = np.fft.fftfreq(n, 1 / n).astype(int), np.fft.fftfreq(m, 1 / m).astype(int)
    # one direction after the other, so that the columns that are all zero are not gone through
    tall = np.zeros((n * factor, m), complex)
    tall[rows] = spread
    big = np.zeros((n * factor, m * factor), complex)
    big[:, columns] = np.fft.ifft(tall, axis=0)
    big = np.fft.ifft(big, axis=1) * factor**2
    power = big.real**2 + big.imag**2
    i, j = np.unravel_index(power.argmax(), power.shape)
    out = {"y": i / factor, "x": j / factor, "peak": float(power[i, j]), "phase": float(np.angle(big[i, j]))}
    for name, cut in (("y", power[:, j]), ("x", power[i, :])):
        k = int(cut.argmax())
        out[f"{name}_width"] = cut_of(cut, 0.5) / factor
        low = k
        while low > 0 and cut[low - 1] < cut[low]:
            low -= 1
        high = k
        while high < len(cut) - 1 and cut[high + 1] < cut[high]:
            high += 1
        side = np.concatenate([cut[:low], cut[high + 1 :]])
        main = cut[low : high + 1].sum()
        out[f"{name}_pslr"] = 10 * math.log10(side.max() / cut[k]) if len(side) and side.max() > 0 else -math.inf
        out[f"{name}_islr"] = 10 * math.log10(side.sum() / main) if len(side) and side.sum() > 0 else -math.inf
    return out


def point_targets(chips: DataFrame, height: int, width: int, factor: int = 16) -> DataFrame:
    """point_target of every chip (id, re, im; arrays in raster order)."""
    names = ["y", "x", "peak", "phase", "y_width", "y_pslr", "y_islr", "x_width", "x_pslr", "x_islr"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [point_target((np.asarray(a, float) + 1j * np.asarray(b, float)).reshape(height, width), factor) for a, b in zip(pdf["re"], pdf["im"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], **{c: [x[c] for x in found] for c in names}})

    return chips.select("id", "re", "im").mapInPandas(run, "id long, " + ", ".join(f"{c} double" for c in names))


def notch(lines: DataFrame, cut: float) -> DataFrame:
    """Each complex line without the frequencies whose power, over all lines of its block, stands out by ``cut`` deviations from the median.

    Blocks of BLOCK lines have one spectrum; it is counted in columns, and only the bins found go to the lines.
    """
    spectra = on_lines(lines, ["re", "im"], lambda re, im: (np.abs(np.fft.fft(re + 1j * im, axis=1)) ** 2 if re.shape[1] else re,), ["power"])
    power = spectra.select(F.floor(F.col("line") / BLOCK).alias("block"), F.posexplode("power").alias("bin", "p")).groupBy("block", "bin").agg(F.avg("p").alias("p"))
    w = Window.partitionBy("block")
    x = power.withColumn("m", F.median("p").over(w)).withColumn("dev", F.median(F.abs(F.col("p") - F.col("m"))).over(w) * 1.4826)
    bad = x.where(F.col("p") > F.col("m") + cut * F.col("dev")).groupBy("block").agg(F.collect_list(F.col("bin").cast("double")).alias("bad"))
    both = lines.withColumn("block", F.floor(F.col("line") / BLOCK)).join(bad, "block", "left")

    def kernel(re: np.ndarray, im: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, ...]:
        z = np.fft.fft(re + 1j * im, axis=1) if re.shape[1] else re
        for row, b in zip(z, bins, strict=True):
            row[b.astype(int)] = 0
        z = np.fft.ifft(z, axis=1) if re.shape[1] else z
        return z.real, z.imag

    return on_lines(both.withColumn("bad", F.coalesce("bad", F.array().cast("array<double>"))), ["re", "im", "bad"], kernel, ["re", "im"])


#: Lines that one notch spectrum is taken over.
BLOCK = 256
