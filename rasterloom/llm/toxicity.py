"""Toxicity scores by a counterfactually regularised classifier.

Logistic regression on the presence of words and word beginnings. Each labelled text that
names a group is held against its counterfactuals: the same text with that term swapped for
each other group's, all its features with it. The squared change of the whole score is part
of the loss, so the mention of a group alone moves no score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, hold, written

#: Labelled rows of either label that training takes at most, first by a hash of doc_id.
ROWS = 4000
TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees"), ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)
_WORD = re.compile(r"[^\W\d_]+")
BITS = 20
#: Features of the model at most, those that tell the labels apart best; a few hundred do so significantly.
FEATURES = 50_000


def _hash(x: str) -> int:
    return zlib.crc32(x.encode()) & ((1 << BITS) - 1)


def features(word: str) -> tuple[int, ...]:
    """The word itself and, of longer ones, its first four and five letters."""
    return (_hash(word), *(_hash(f"{word[:n]}*") for n in (4, 5) if len(word) > n))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swaps(words: set[str], group: dict[str, tuple[str, ...]]) -> Iterator[tuple[set[int], set[int]]]:
    """For every named term and every other term of its group: the features the swapped text has not and has anew."""
    named = sorted(words & group.keys())
    if not named:
        return
    count: dict[int, int] = {}
    for w in words:
        for f in features(w):
            count[f] = count.get(f, 0) + 1
    for w in named:
        lost = {f for f in features(w) if count[f] == 1}
        for x in group[w]:
            if x != w:
                new = set(features(x))
                yield lost - new, new - count.keys()


def _counted(group: dict[str, tuple[str, ...]]):
    """Of a partition's texts, how many of either label have each feature, and whether a swap moves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity")
        have, moved = np.zeros((2, 1 << BITS), np.int64), np.zeros(1 << BITS, bool)
        for batch in batches:
            for y, text in zip(batch["toxic"].to_pylist(), batch["text"], strict=True):
                words = _words(text.as_py())
                have[y, list({f for w in words for f in features(w)})] += 1
                for gone, come in swaps(words, group):
                    moved[[*gone, *come]] = True
        some = np.flatnonzero(have.any(axis=0) | moved)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(have[1, some]), pa.array(have[0, some]), pa.array(moved[some])], ["feature", "in1", "in0", "moved"])

    return run


def _chosen(chosen: np.ndarray, group: dict[str, tuple[str, ...]]):
    """The places in ``chosen`` of a text's features, and of those that each of its swaps takes and brings, with the swap's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity")
        place = {f: i for i, f in enumerate(chosen.tolist())}
        for batch in batches:
            have, gone, come, pairs = [], [], [], []
            for text in batch["text"]:
                words = _words(text.as_py())
                have.append(np.array(sorted({place[f] for w in words for f in features(w) if f in place}), np.int32).tobytes())
                each = list(swaps(words, group))
                gone.append(np.array([(i, place[f]) for i, (x, _) in enumerate(each) for f in sorted(x) if f in place], np.int32).tobytes())
                come.append(np.array([(i, place[f]) for i, (_, x) in enumerate(each) for f in sorted(x) if f in place], np.int32).tobytes())
                pairs.append(len(each))
            lists = [pa.array(x, pa.binary()) for x in (have, gone, come)]
            yield pa.RecordBatch.from_arrays([batch["toxic"], *lists, pa.array(pairs, pa.int32())], ["toxic", "have", "gone", "come", "pairs"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, groups: tuple[tuple[str, ...], ...] = TERMS, fairness: float = 30.0, ridge: float = 1e-3, steps: int = 400) -> tuple[dict[int, float], float]:
    """Weights by feature and an intercept, learnt from labels.toxic of rows that are not held out.

    At most ``rows`` rows of either label are taken: enough for the few hundred features
    that matter, whatever the corpus size. Each row counts for as many as its label has per
    row taken, so the rate of toxic rows, and with it the scores, are those of all labels.
    The features that tell the labels apart are found before anything comes to the driver,
    which gets those alone. fairness weighs the mean squared change of the score over all
    swaps of an identity term.
    """
    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    named = named.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id"), "doc_id"
    some = named.where("toxic = 1").orderBy(*order).limit(rows).unionByName(named.where("toxic = 0").orderBy(*order).limit(rows))
    full = {x["toxic"]: x["count"] for x in named.groupBy("toxic").count().collect()}
    # no more than 2 * rows rows of 12 bytes
    taken = written(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("toxic", "text"), "taken")
    group = {w: g for g in groups for w in g}
    met = {x["toxic"]: x["count"] for x in taken.groupBy("toxic").count().collect()}
    n1, n0 = met.get(1, 0), met.get(0, 0)
    if not n1 or not n0:
        return {}, (4.0 if n1 else -4.0)
    found = taken.mapInArrow(_counted(group), "feature long, in1 long, in0 long, moved boolean").groupBy("feature")
    found = found.agg(F.sum("in1").alias("in1"), F.sum("in0").alias("in0"), F.max("moved").alias("moved"))
    p = (F.col("in1") + F.col("in0")) / float(n1 + n0)
    z = F.abs(F.col("in1") / float(n1) - F.col("in0") / float(n0)) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    found = found.where(F.col("moved") | (z > 4.5) & (F.col("in1") + F.col("in0") >= 8))
    found = found.orderBy(F.desc("moved"), z.desc(), "feature").limit(FEATURES)
    chosen = np.sort(np.array([x["feature"] for x in found.select("feature").collect()], np.int64))
    s1, s0 = max(1.0, full[1] / rows), max(1.0, full[0] / rows)
    if not len(chosen):
        return {}, float(np.log(s1 * n1 / (s0 * n0)))
    table = taken.mapInArrow(_chosen(chosen, group), "toxic int, have binary, gone binary, come binary, pairs int").toPandas()
    drop(taken)
    y = table["toxic"].to_numpy(float)
    stands = np.where(y == 1, s1, s0)
    stands /= stands.mean()
    have = [np.frombuffer(x, np.int32) for x in table["have"]]
    row, col = np.repeat(np.arange(len(have)), [len(x) for x in have]), np.concatenate(have)
    first = np.cumsum(table["pairs"]) - table["pairs"]

    def moves(name: str) -> tuple[np.ndarray, np.ndarray]:
        """The swap and the feature of each change, swaps counted through all texts."""
        lists = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in table[name]]
        flat = np.concatenate(lists)
        return flat[:, 0] + np.repeat(first.to_numpy(), [len(x) for x in lists]), flat[:, 1]

    (from_pair, gone), (to_pair, come), n = moves("gone"), moves("come"), int(table["pairs"].sum())
    w, b = np.zeros(len(chosen)), 0.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):  # Adam on the whole sample
        score = np.bincount(row, w[col], len(y)) + b
        miss = stands * (1 / (1 + np.exp(-score)) - y)
        grad = np.bincount(col, miss[row], len(w)) / len(y) + ridge * w
        if n:
            change = fairness / n * (np.bincount(to_pair, w[come], n) - np.bincount(from_pair, w[gone], n))
            grad += np.bincount(come, change[to_pair], len(w)) - np.bincount(gone, change[from_pair], len(w))
        g = np.append(grad, miss.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return dict(zip(chosen.tolist(), w.tolist(), strict=True)), float(b)


class _Scorer:
    """Scores of texts, with the weights of words that were met before."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        scores, known, weights = [], self.known, self.weights
        for text in texts:
            seen: set[int] = set()
            for w in _words(text.as_py()):
                f = known.get(w)
                if f is None:
                    if len(known) >= 300_000:
                        known.clear()
                    f = known[w] = tuple(x for x in features(w) if x in weights)
                if f:
                    seen.update(f)
            scores.append(self.bias + sum(weights[x] for x in sorted(seen)))
        return 1 / (1 + np.exp(-np.clip(np.array(scores), -500, 500)))


def _score(weights: dict[int, float], bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity")
        score = _Scorer(weights, bias)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score(batch["text"]), pa.float64())], ["doc_id", "score"])

    return run


def _below(weights: dict[int, float], bias: float, cut: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity")
        score = _Scorer(weights, bias)
        for batch in batches:
            yield batch.filter(pa.array(score(batch[text]) < cut))

    return run


def score(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """Scores every text: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts get the score of a text without known words. A null doc_id is not
    held out and never trains. Without labels of both kinds all scores are near 0, or near 1
    if all labels are 1. Repeated rows get equal scores, and a doc_id with several labels
    counts as toxic if one is. An empty table gives an empty result. Only doc_id and text are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    weights, bias = fit(docs, labels, **fitting)
    out = docs.select("doc_id", "text").mapInArrow(_score(weights, bias), f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, cut: float = 0.5, **fitting) -> DataFrame:
    """docs without the rows scored ``cut`` or more, whatever their doc_id; the rest as they are, with all columns."""
    return docs.mapInArrow(_below(*fit(docs, labels, **fitting), cut, "text"), docs.schema)
