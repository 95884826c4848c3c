"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Lower-cased words give character 3- to 5-grams that know whether they begin or end their word, hashed into ``BUCKETS``. Over all labelled
rows each n-gram's documents are counted per class; the ``FEATURES`` n-grams of the highest chi-square are kept with their log-count
ratio. A logistic regression on presence times ratio is fitted on at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the id.

Null and empty texts have no n-grams and score the intercept. Without rows of both classes every text scores the share of the class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sealcheck.llm import common, textscan
from sealcheck.llm.unitmemo import ragged

BUCKETS, FEATURES, SAMPLE_ROWS = 1 << 20, 4096, 20_000
SIZES = (3, 4, 5)
SMOOTHING, PENALTY, STEPS, RATE, LEAST_DOCS = 1.0, 0.5, 400, 0.05, 3


def word_grams(scan: textscan.Scan, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, bucket) of the n-grams of the words from ``start`` to ``end``; a shorter word is one n-gram."""
    points = np.flatnonzero((scan.data & 0xC0) != 0x80)
    first, last = np.searchsorted(points, start), np.searchsorted(points, end)
    points = np.append(points, len(scan.data))
    owners, buckets = [], []
    for size in SIZES:
        n = np.maximum(last - first - size + 1, 0)
        if size == SIZES[0]:
            n = np.maximum(n, 1)
        owner = np.repeat(np.arange(len(start)), n)
        at = ragged(first, n)
        stop = np.minimum(at + size, last[owner])
        hashes = scan.hashes(points[at], points[stop])
        hashes = textscan.mix(hashes ^ ((at == first[owner]).astype(np.uint64) + (stop == last[owner]).astype(np.uint64) * np.uint64(2)))
        owners.append(owner)
        buckets.append((hashes % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def text_grams(texts: list[bytes], feature_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, or (text, feature) where ``feature_of`` maps buckets to features and -1 to none."""
    scan = textscan.Scan(texts, lower=True)
    if not len(scan.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = scan.word_hashes()
    _, first, back = np.unique(words, return_index=True, return_inverse=True)
    owner, gram = word_grams(scan, scan.start[first], scan.end[first])
    if feature_of is not None:
        gram = feature_of[gram]
        owner, gram = owner[gram >= 0], gram[gram >= 0]
    order = np.argsort(owner, kind="stable")
    owner, gram = owner[order], gram[order]
    count = np.bincount(owner, minlength=len(first))
    at = np.cumsum(count) - count
    pairs = np.unique(scan.doc * len(first) + back)         # each word once per text
    doc, word = pairs // len(first), pairs % len(first)
    width = BUCKETS if feature_of is None else int(feature_of.max(initial=0)) + 1
    found = np.unique(np.repeat(doc, count[word]) * width + gram[ragged(at[word], count[word])])
    return found // width, found % width


@dataclass
class Model:
    feature_of: np.ndarray      # feature of a bucket, -1 for none
    weights: np.ndarray         # weight times log-count ratio
    intercept: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        doc, feature = text_grams(texts, self.feature_of)
        return sigmoid(np.bincount(doc, self.weights[feature], len(texts)) + self.intercept)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """Documents of each class (columns pos, neg) per bucket that any of the (text, label) rows has."""
    schema = T.StructType([common.long_field("bucket"), common.long_field("pos"), common.long_field("neg")])

    def count(batches):
        totals = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for first, texts in textscan.chunked(batch.column("text")):
                doc, bucket = text_grams(texts)
                own = label[first + doc] == 1
                totals[1] += np.bincount(bucket[own], minlength=BUCKETS)
                totals[0] += np.bincount(bucket[~own], minlength=BUCKETS)
        held = np.flatnonzero(totals.sum(0))
        for a in range(0, len(held), 1 << 16):
            part = held[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(totals[1][part]), pa.array(totals[0][part])], names=schema.names)

    summed = labelled.select("text", "label").mapInArrow(count, schema).groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return summed.where(F.col("pos") + F.col("neg") >= LEAST_DOCS)


def best_grams(counts: DataFrame, n_pos: int, n_neg: int) -> pd.DataFrame:
    """The FEATURES buckets of the highest chi-square, by bucket."""
    seen = F.col("pos") + F.col("neg")
    expected = seen * (n_pos / (n_pos + n_neg))
    gap = F.col("pos") - expected
    chi = gap * gap / expected + gap * gap / (seen - expected)
    return counts.withColumn("chi", chi).orderBy(F.desc("chi"), "bucket").limit(FEATURES).toPandas().sort_values("bucket")


def fit_logistic(rows: np.ndarray, features: np.ndarray, values: np.ndarray, label: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and intercept under an L2 penalty on the weights, by steps scaled per coordinate (Adam), which texts with very
    many n-grams do not slow down."""
    n = len(label)
    theta = np.zeros(width + 1)
    theta[-1] = np.log((label.sum() + 0.5) / (n - label.sum() + 0.5))
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for i in range(1, STEPS + 1):
        error = sigmoid(np.bincount(rows, values * theta[features], n) + theta[-1]) - label
        slope = np.append(np.bincount(features, values * error[rows], width) + PENALTY * theta[:-1], error.sum()) / n
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        theta = theta - RATE * (1 - i / (STEPS + 1)) * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.999**i)) + 1e-9)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled rows; null ids and labels other than 0 and 1 are left out, repeated rows count each time."""
    # labels grow with the texts, so they meet by a merge join at every size
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("label"))
    labelled = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text")).join(known.hint("merge"), "_id")
    classes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    n_pos, n_neg = classes.get(1, 0), classes.get(0, 0)
    none = np.full(BUCKETS, -1, np.int32)
    best = best_grams(gram_counts(labelled), n_pos, n_neg) if n_pos and n_neg else None
    if best is None or not len(best):
        return Model(none, np.zeros(1), float(np.log((n_pos + 0.5) / (n_neg + 0.5))))
    pos, neg = best["pos"].to_numpy(float), best["neg"].to_numpy(float)
    ratio = np.log((pos + SMOOTHING) / (n_pos + 2 * SMOOTHING)) - np.log((neg + SMOOTHING) / (n_neg + 2 * SMOOTHING))
    feature_of = none.copy()
    feature_of[best["bucket"].to_numpy()] = np.arange(len(best))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "label").limit(sample_rows)
    sample = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")

    def hits(texts: list[bytes]) -> dict[str, list]:
        doc, feature = text_grams(texts, feature_of)
        return {"features": np.split(feature.astype(np.int32), np.searchsorted(doc, np.arange(1, len(texts))))}

    rows = common.map_texts(sample, "text", ["_id", "label"], hits, [T.StructField("features", T.ArrayType(T.IntegerType()))])
    held = rows.select("row.*", "out.features").toPandas().sort_values(["_id", "label"])
    sizes = held["features"].map(len).to_numpy()
    features = np.concatenate([np.asarray(f, np.int64) for f in held["features"]] or [np.zeros(0, np.int64)])
    label_of = held["label"].to_numpy(float)
    weights, intercept = fit_logistic(np.repeat(np.arange(len(held)), sizes), features, ratio[features], label_of, len(best))
    return Model(feature_of, weights * ratio, float(intercept))


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``out.score``. The model has a fixed size (a number per bucket and feature) and is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return common.map_texts(docs, text, docs.columns if keep is None else keep, lambda texts: {"score": held.value.score(texts)},
                            [T.StructField("score", T.DoubleType())])


def fold(id_column: Column, parts: int) -> Column:
    return F.pmod(F.crc32(id_column.cast("string")), F.lit(parts))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = fit(docs, labels)
    return scored(docs, model, keep=["doc_id"]).select(
        "row.doc_id", F.coalesce(fold(F.col("row.doc_id"), 5) == 0, F.lit(False)).alias("held_out"), F.col("out.score").alias("score"),
        (F.col("out.score") >= 0.5).cast("int").alias("predicted"))
