"""Isolation forest over the session features.

Each tree needs 256 rows and draws them by hash from all sessions; a threshold on the hash keeps
the rows that are copied to twice what the trees take, and every tree is grown in its own group of
at most 256 rows. Scoring walks the (bounded) trees over Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from sealcheck.operators.features import feature_columns
from sealcheck.operators.ranks import exact_percentiles
from sealcheck.session import staged

TREES, SAMPLE, CONTAMINATION = 180, 256, 0.08
_NODE = "tree int, node int, feature int, cut double, left int, right int, depth_value double"


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[tuple] = [None]
    todo = [(0, np.arange(len(rows)), 0)]
    while todo:
        node, members, depth = todo.pop()
        part = rows[members]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0))
        if depth >= limit or len(members) <= 1 or not len(spread):
            nodes[node] = (-1, 0.0, -1, -1, depth + _average_path(len(members)))
            continue
        feature = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, feature].min(), part[:, feature].max()))
        goes_left = part[:, feature] <= cut
        left, right = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[node] = (feature, cut, left, right, 0.0)
        todo += [(left, members[goes_left], depth + 1), (right, members[~goes_left], depth + 1)]
    return nodes


@dataclass
class AnomalyModel:
    trees: list          # (feature, cut, left, right, depth_value) arrays per tree
    sample: int
    offset: float = -0.5

    def raw(self, values: np.ndarray) -> np.ndarray:
        """Negative isolation score per row; lower is stranger."""
        total = np.zeros(len(values))
        rows = np.arange(len(values))
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(values), dtype=np.int64)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                at = node[inner]
                goes_left = values[rows[inner], feature[at]] <= cut[at]
                node[inner] = np.where(goes_left, left[at], right[at])
            total += value[node]
        return -np.exp2(-(total / len(self.trees)) / _average_path(self.sample))


def _raw_scores(model_data):
    @F.pandas_udf("double")
    def score(columns: pd.DataFrame) -> pd.Series:
        return pd.Series(model_data.value.raw(columns.to_numpy(dtype=float)))
    return score


def fit_anomaly(rows: DataFrame, identity: list[str], trees: int = TREES, sample: int = SAMPLE,
                contamination: float = CONTAMINATION, seed: int = 42) -> AnomalyModel:
    """Grow the forest on ``rows`` (the LOW ones) and place the contamination threshold."""
    columns = feature_columns()
    rows = staged(rows.select(*identity, *columns), "sampled")       # counted, sampled and scored
    n = rows.count()
    size = min(sample, n)
    key = F.concat_ws("|", *identity)
    # every tree draws from all rows: those of its lowest hashes. A row lists the trees it may fall to before it is copied.
    bound = min(2**63 - 1, (2**63 - 1) * 2 * size // max(n, 1))
    luck = lambda tree: F.xxhash64("key", tree, F.lit(seed)).bitwiseAND(F.lit(2**63 - 1))
    drawn = (rows.select(*columns, key.alias("key"))
             .withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: luck(t) <= bound)))
             .withColumn("luck", luck(F.col("tree"))))
    place = F.row_number().over(W.partitionBy("tree").orderBy("luck", "key"))
    groups = drawn.withColumn("place", place).filter(F.col("place") <= size)
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        part = part.sort_values("place")
        nodes = _grow(part[columns].to_numpy(dtype=float), np.random.default_rng(seed + tree), limit)
        return pd.DataFrame([(tree, i, *node) for i, node in enumerate(nodes)],
                            columns=["tree", "node", "feature", "cut", "left", "right", "depth_value"])

    grown = groups.groupBy("tree").applyInPandas(grow, _NODE).toPandas()   # trees * 511 nodes at most
    packed = []
    for _, part in grown.sort_values(["tree", "node"]).groupby("tree"):
        packed.append((part["feature"].to_numpy(np.int64), part["cut"].to_numpy(float), part["left"].to_numpy(np.int64),
                       part["right"].to_numpy(np.int64), part["depth_value"].to_numpy(float)))
    model = AnomalyModel(packed, size)
    raw = raw_scores(rows.select(*columns), model).select(F.lit("all").alias("group"), "raw")
    model.offset = exact_percentiles(raw, "group", "raw", [contamination]).first()["percentile"]
    return model


def raw_scores(features: DataFrame, model: AnomalyModel) -> DataFrame:
    data = features.sparkSession.sparkContext.broadcast(model)    # bounded: trees * 511 nodes
    return features.withColumn("raw", _raw_scores(data)(F.struct(*feature_columns())))


def score_anomaly(features: DataFrame, model: AnomalyModel) -> DataFrame:
    """Add ml_anomalous (decision below zero) and ml_anomaly_score in [0, 1], four decimals."""
    decision = F.col("raw") - F.lit(model.offset)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) - decision))
    return (raw_scores(features, model)
            .withColumn("ml_anomalous", decision < 0)
            .withColumn("ml_anomaly_score", F.bround(clipped, 4)).drop("raw"))
