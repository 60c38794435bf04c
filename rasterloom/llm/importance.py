"""Quality selection by importance resampling over hashed n-grams.

Two bag-of-n-gram models over ``buckets`` hash buckets, one of the target texts and one of
all texts, give each document a log importance weight; Gumbel noise added to it turns the
largest k keys into a sample without replacement in proportion to the weights. The log
weight is the log of the ratio of the two models' probabilities for the document, that is
the sum over its n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .minhash import _HASHES, _mix

BUCKETS = 1 << 14
#: Target documents that the target model is fitted on at most, first by a hash of doc_id; their ids alone are broadcast.
TARGETS = 20_000


def features(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of a text's words and word pairs; words are split at ASCII white space after lower-casing A-Z."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    pairs = _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, wanted in zip(batch["text"], batch["wanted"].to_pylist(), strict=True):
                n = np.bincount(features(text.as_py(), buckets), minlength=buckets)
                raw += n
                if wanted:
                    target += n
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return run


def _score(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(x.as_py(), len(ratio)) for x in batch["text"]]
            n = pa.array([len(x) for x in got], pa.int64())
            weight = pa.array([float(ratio[x].sum()) for x in got], pa.float64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], n, weight], ["doc_id", "n_features", "log_weight"])

    return run


def _largest(keys: DataFrame, k: int, few: int = 20_000) -> float:
    """The k-th largest of column key: counts in 4096 bins, narrowed until a bin holds few rows or one value."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        inside = keys.where(F.col("key").between(low, high))
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            return low
        bins = inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(4095)).alias("bin")).agg(
            F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        for row in sorted(bins.collect(), key=lambda x: -x["bin"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        low, high = row["low"], row["high"]
        if row["n"] <= few:
            rest = sorted((x["key"] for x in keys.where(F.col("key").between(low, high)).select("key").collect()), reverse=True)
            return rest[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, targets: int = TARGETS, seed: int = 3) -> DataFrame:
    """Draws documents whose n-grams resemble those of the documents labelled quality 1.

    share is the part of the documents to keep, by default the part of the labels that are 1.
    The raw model counts all documents; the target model at most ``targets`` labelled ones,
    some thousand n-grams for each bucket, so that their ids can be broadcast at any size and
    no text is shuffled. Returns one row per row of docs: doc_id, n_features, log_weight (the
    sum of the log ratios of its n-grams), key, kept. Null, empty and wordless texts have
    weight 0 and are drawn by noise alone; equal keys at the cut are all kept; labels that
    are null or of no document are ignored; without any label nothing is known and all
    weights are 0; rows that repeat a doc_id count and are drawn each, with equal noise; an
    empty table gives an empty result. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    rows, good = labels.where("quality is not null").agg(F.count("*"), F.sum(F.col("quality").cast("double"))).first()
    share = share if share is not None else ((good or 0) / rows if rows else 1.0)
    wanted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(targets).withColumn("wanted", F.lit(True))
    # no more than ``targets`` ids
    counts = docs.join(F.broadcast(wanted), "doc_id", "left").select("text", "wanted").mapInArrow(_count(buckets), "bucket long, raw long, target long")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for x in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[x["bucket"]], target[x["bucket"]] = x["raw"], x["target"]
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    scored = docs.mapInArrow(_score(ratio if target.any() else np.zeros(buckets)), f"doc_id {kind}, n_features long, log_weight double")
    bits = F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    noise = -F.log(-F.log((bits + 0.5) / float(1 << 52)))
    scored = written(scored.withColumn("key", F.col("log_weight") + noise), "scored")
    n = scored.count()
    k = min(n, math.ceil(n * share))
    if not k:
        return scored.withColumn("kept", F.lit(False))
    return scored.withColumn("kept", F.col("key") >= F.lit(_largest(scored, k)))
