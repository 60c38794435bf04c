"""Secrets in texts: fixed patterns, and a randomness test battery for tokens of any form.

A candidate is a long run of key-like characters with letters among them. Its encoding is
inferred from its alphabet (hex, base32, base36, base62, base64); a run that mixes
alphabets, as NAME=value or a path does, is split and its parts are candidates. The battery
asks whether the token looks uniform in that alphabet: chi-squared on coarse symbol
classes, runs above and below the middle, and serial correlation. A second p-value says
how likely natural text would look that random: a bound by the likelihood ratio of the
uniform model against a character-pair model counted over all texts, so it falls with
length. Benjamini-Hochberg over all candidates of the corpus sets its cut.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_LEAST = 20
_VALUE = re.compile(r"[^=]+(?:=+\Z)?")
#: A part between these holds base64url, base64, or letters and digits only.
_PARTS = [re.compile(r"[^/+]+"), re.compile(r"[^_-]+"), re.compile(r"[^/+_-]+")]
_ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}
_ALPHABETS = [
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef"),
    ("base32", re.compile(r"[A-Z2-7]+=*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", re.compile(r"[0-9a-z]+|[0-9A-Z]+"), "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", re.compile(r"[0-9A-Za-z]+"), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", re.compile(r"[0-9A-Za-z+/]+=*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", re.compile(r"[0-9A-Za-z_-]+=*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed kinds: (kind, start, end) in code points, leftmost and non-overlapping per kind, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], _ORDER[x[0]], x[2]))


def inferred(token: str) -> tuple[str, str] | None:
    """The narrowest encoding whose alphabet holds the token, and that alphabet."""
    for name, form, letters in _ALPHABETS:
        if form.fullmatch(token):
            return name, letters
    return None


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str, letters: str) -> float:
    """The least of three p-values for a token that is uniform over its alphabet, corrected for their number."""
    token = token.rstrip("=")
    if token.isupper() and letters[-1].islower() and letters[10:11].islower():
        token = token.lower()
    place = {c: i for i, c in enumerate(letters)}
    x = np.array([place[c] for c in token], float)
    n, m = len(x), len(letters)
    groups = max(2, min(8, n // 5))
    seen = np.bincount((x * groups // m).astype(int), minlength=groups)
    want = np.bincount(np.arange(m) * groups // m, minlength=groups) * n / m
    chi = float(((seen - want) ** 2 / want).sum())
    k = groups - 1  # Wilson and Hilferty's normal form of chi-squared
    z = ((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    p1 = 0.5 * math.erfc(z / math.sqrt(2))
    above = x >= m / 2
    up = int(above.sum())
    down = n - up
    p2 = 0.0
    if up and down:
        runs = 1 + int((above[1:] != above[:-1]).sum())
        mean = 1 + 2 * up * down / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p2 = _normal_tail((runs - mean) / math.sqrt(var))
    y = x - (m - 1) / 2
    p3 = _normal_tail(float((y[1:] * y[:-1]).sum()) / (math.sqrt(n - 1) * (m * m - 1) / 12))
    return min(1.0, 3 * min(p1, p2, p3))


def _natural(m: re.Match) -> str:
    return " " if any(c.isdigit() for c in m[0]) else m[0]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character pairs of all texts outside their candidates: bytes of 7 bits, anything else as 0."""
    hold("secrets")
    total = np.zeros(1 << 14, np.int64)
    for batch in batches:
        for text in batch["text"]:
            x = np.frombuffer(_TOKEN.sub(_natural, text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
            x = np.where(x < 128, x, 0).astype(np.int64)
            total += np.bincount(x[:-1] * 128 + x[1:], minlength=1 << 14)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])


def _split(token: str) -> list[tuple[int, int]]:
    """The parts of a run that fits no alphabet: between '=', and of those that still fit none, between the other signs."""
    out = []
    for v in _VALUE.finditer(token):
        if inferred(v[0]):
            out.append(v.span())
        else:
            out += sorted({(v.start() + m.start(), v.start() + m.end()) for x in _PARTS for m in x.finditer(v[0])})
    return [(b, e) for b, e in out if e - b >= _LEAST]


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """Key-like runs with letters, or the parts of those that mix alphabets: (start, end, token, alphabet). Parts may overlap."""
    out = []
    for m in _TOKEN.finditer(text):
        for b, e in [(0, len(m[0]))] if inferred(m[0]) else _split(m[0]):
            token = m[0][b:e]
            if any(c.isalpha() for c in token) and (kind := inferred(token)):
                out.append((m.start() + b, m.start() + e, token, kind[1]))
    return out


def _open(text: str, base: list[tuple[str, int, int]] | None = None) -> list[tuple[int, int, str, str]]:
    """The candidates that no span of the fixed kinds touches: those that the battery decides on."""
    found = candidates(text)
    if not found:
        return found
    base = base_spans(text) if base is None else base
    return [x for x in found if not any(b < x[1] and x[0] < e for _, b, e in base)]


def natural_p(token: str, letters: str, logs: np.ndarray) -> float:
    """A bound on how likely natural text is to look as random: exp(-log likelihood ratio), at most 1."""
    x = np.frombuffer(token.encode(), np.uint8).astype(np.int64)
    natural = float(logs[x[:-1] * 128 + x[1:]].sum())
    return math.exp(min(0.0, natural + (len(x) - 1) * math.log(len(letters))))


def _model(pairs: np.ndarray) -> np.ndarray:
    """Log probabilities of a character given the one before it."""
    table = pairs.reshape(128, 128).astype(float) + 0.5
    return np.log(table / table.sum(axis=1, keepdims=True)).ravel()


def _tested(logs: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("secrets")
        for batch in batches:
            p = []
            for text in batch["text"]:
                for _, _, token, letters in _open(text.as_py() or ""):
                    p.append(-math.log10(max(1e-300, natural_p(token, letters, logs))) if battery(token, letters) >= least else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array((np.array(p) * 10).astype(np.int64))], ["bin"])

    return run


class _Finder:
    """All spans of a text, and the text without them."""

    def __init__(self, logs: np.ndarray, least: float, cut: float):
        self.logs, self.least, self.cut = logs, least, cut

    def __call__(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        base = base_spans(text)
        random = [(b, e) for b, e, token, letters in _open(text, base) if battery(token, letters) >= self.least and natural_p(token, letters, self.logs) <= self.cut]
        spans = base + [("random", b, e) for b, e in random if not any(x <= b and e <= y and (x, y) != (b, e) for x, y in random)]
        return base, sorted(spans, key=lambda x: (x[1], _ORDER[x[0]], x[2]))


def without(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with <SECRET> for each span; overlapping spans as one."""
    out, done = [], 0
    for _, b, e in spans:
        if e > done:
            out += [text[done : max(b, done)], "<SECRET>" if b >= done else ""]
            done = e
    return "".join(out) + text[done:]


def _told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def _found(logs: np.ndarray, least: float, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("secrets")
        find = _Finder(logs, least, cut)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for raw in part["text"]:
                    text = raw.as_py()
                    base, spans = find(text or "")
                    counts = [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
                    rows.append((*counts, hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans), without(text, spans) if spans else text))
                kinds = [pa.int64()] * 3 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean"])

    return run


def _redacted(logs: np.ndarray, least: float, cut: float, text: int, length: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("secrets")
        find = _Finder(logs, least, cut)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, new = part[text].to_pylist(), list(part.columns)
                spans = [find(x)[1] if x else [] for x in texts]
                texts = [without(x, s) if s else x for x, s in zip(texts, spans, strict=True)]
                new[text] = pa.array(texts, part.schema[text].type)
                if length is not None:
                    n = [len(x) if s else n for x, s, n in zip(texts, spans, part[length].to_pylist(), strict=True)]
                    new[length] = pa.array(n, part.schema[length].type)
                yield pa.RecordBatch.from_arrays(new, schema=part.schema)

    return run


def _fitted(docs: DataFrame, rate: float, least: float) -> tuple[np.ndarray, float]:
    """The model of natural text and the cut of the false-discovery control, over all texts."""
    pairs = np.zeros(1 << 14, np.int64)
    for x in docs.select("text").mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[x["pair"]] = x["n"]
    logs = _model(pairs)
    # p-values in bins of a tenth of a power of ten: at most 3001 rows however many candidates
    bins = docs.select("text").mapInArrow(_tested(logs, least), "bin long").groupBy("bin").agg(F.count("*").alias("n")).collect()
    total = sum(x["n"] for x in bins)
    cut, above = 0.0, 0
    for x in sorted(bins, key=lambda x: -x["bin"]):
        above += x["n"]
        p = 10 ** (-x["bin"] / 10)
        if p <= rate * above / total:
            cut = p
    return logs, cut


def scan(docs: DataFrame, rate: float = 0.01, least: float = 1e-3) -> DataFrame:
    """Finds secrets in every text.

    rate is the share of false discoveries allowed among the tokens that the battery adds,
    least the p-value below which a token counts as not random. Returns one row per row of
    docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end) and clean (the
    text with <SECRET> for each span, overlapping spans as one). Null and empty texts have no
    span and stay as they are; an empty table gives an empty result; repeated rows are
    scanned each; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    logs, cut = _fitted(docs, rate, least)
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, clean string"
    return docs.mapInArrow(_found(logs, least, cut), shape)


def redact(docs: DataFrame, rate: float = 0.01, least: float = 1e-3) -> DataFrame:
    """docs with <SECRET> for every secret in its texts, row by row whatever the doc_id.

    An integer column n_chars follows a changed text; all else, and rows without a secret,
    null and empty texts among them, stay as they are. Columns may have any name.
    """
    logs, cut = _fitted(docs, rate, least)
    names = docs.columns
    length = names.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("bigint", "int") else None
    return docs.mapInArrow(_redacted(logs, least, cut, names.index("text"), length), docs.schema)
