"""Random forests of unlimited depth, all trees and all held-out folds grown level by level as Spark aggregates.

A fold is the training set without one capture. Every fold draws the same bootstrap weights and the same candidate features at a node,
so folds share a node as long as they chose the same splits on the way to it: a node is the history of its splits. Per level

* one aggregate counts classes by (tree, node, feature, bin, capture); the counts of a fold are the total without its own capture's;
* cumulated along the bins they give every split of every fold; folds that choose alike go on together, others part;
* the rows follow the splits. A capture's rows meet the leaf of the fold that never saw them, which is their vote;
* a node of at most ``LOCAL_ROWS`` rows is finished by the task that holds it, by the same rules.

Without folds there is one forest of all rows, which ``forest_blocks`` grows on packed rows by the same rules.

Nothing but the cut points of the features (a few hundred numbers) reaches the driver. Weights are integers and scores are compared with
fixed rules, so any engine that follows them grows the same trees.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sealcheck.operators.features import feature_columns
from sealcheck.operators.ranks import exact_percentiles
from sealcheck.session import discard, staged

CLASSES = ("CRITICAL", "HIGH", "LOW", "MEDIUM")     # sorted, as the trained model lists them
#: Ranges of a feature's values that a split can part.
BINS = 32
#: Features tried at a node; where none of them can part its rows the next as many are tried.
CANDIDATES = 5
LEAST_LEAF = 2
#: Class weights are in thousandths, votes in millionths.
WEIGHT_UNIT, VOTE_UNIT = 1_000, 1_000_000
#: Nodes of a model that are broadcast for scoring (26 bytes each); of larger ones a task holds trees of about as many.
BROADCAST_NODES = 2_000_000
#: Rows that a task scores by its trees then.
SCORED_ROWS = 1_000_000
#: A node as scoring needs it: places of its children in its tree (-1: a leaf), the test, the votes.
_RECORD = np.dtype([("left", "<i4"), ("right", "<i4"), ("feature", "i1"), ("bin", "i1"), *[(f"v{i}", "<i4") for i in range(len(CLASSES))]])
#: Rows of a node that one task may hold.
LOCAL_ROWS = 5_000
ROOT = "root"
NO_FOLD = ""


def poisson_steps() -> list[int]:
    """A draw below the first number counts 0, below the second 1 and so on: the Poisson distribution of mean 1 over 32 bits."""
    steps, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        steps.append(int(2**32 * total))
    return steps


def draw(key: Column) -> Column:
    """Poisson count of a text key."""
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return sum((F.when(u >= step, 1).otherwise(0) for step in poisson_steps()), F.lit(0))


def feature_cuts(rows: DataFrame, bins: int = BINS) -> list[list[float]]:
    """Ascending cut points of each feature: its distinct percentiles. A value's bin is the number of cuts below it."""
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(feature_columns())])
    found = exact_percentiles(rows.select(F.explode(pairs).alias("p")).select("p.*"), "feature", "value", [i / bins for i in range(1, bins)])
    cuts: list[set[float]] = [set() for _ in feature_columns()]
    for r in found.collect():           # features * bins
        cuts[r["feature"]].add(r["percentile"])
    return [sorted(c) for c in cuts]


def binned(cuts: list[list[float]]) -> Column:
    """The bin of every feature, as one array."""
    return F.array(*[sum((F.when(F.col(c) > cut, 1).otherwise(0) for cut in own), F.lit(0)).cast("tinyint")
                     for c, own in zip(feature_columns(), cuts)])


@dataclass(frozen=True)
class Grown:
    """``nodes``: (tree, node, fold, depth, kind, feature, bin, left_node, right_node, rows, v0..v3). ``votes``: (capture, session_id, label, v0..v3)
    of the rows that met a leaf of the fold without them; ``cuts`` are the features' cut points."""
    nodes: DataFrame
    votes: DataFrame | None
    cuts: list[list[float]]


def _child(node: Column, *parts) -> Column:
    return F.substring(F.md5(F.concat_ws("|", node, *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])), 1, 16)


_SUMS, _VOTES = [f"n{i}" for i in range(len(CLASSES))], [f"v{i}" for i in range(len(CLASSES))]


def _fold_weights(points: DataFrame, folds: bool) -> DataFrame:
    """(fold, w0..w3): balanced weights of what is left without the fold's capture."""
    counts = points.groupBy("capture", "base").agg(*[F.sum(F.when(F.col("label") == i, F.col("copies")).otherwise(0)).alias(n) for i, n in enumerate(_SUMS)])
    total = counts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _SUMS]).first()
    if folds:
        left = counts.where("not base").select(F.col("capture").alias("fold"), *[(F.lit(total[n]) - F.col(n)).alias(n) for n in _SUMS])
    else:
        left = points.sparkSession.createDataFrame([(NO_FOLD, *total)], "fold string, " + ", ".join(f"{n} bigint" for n in _SUMS))
    n, k = sum(F.col(c) for c in _SUMS), sum(F.when(F.col(c) > 0, 1).otherwise(0) for c in _SUMS)
    return left.select("fold", *[F.when(F.col(c) > 0, F.floor(WEIGHT_UNIT * n / (k * F.col(c)))).otherwise(0).cast("bigint").alias(f"w{i}")
                                 for i, c in enumerate(_SUMS)])


def _candidates(frontier: DataFrame) -> DataFrame:
    """(tree, node, features): the candidates of each active node, in order."""
    digest = lambda i: F.md5(F.concat_ws("|", F.col("tree").cast("string"), "salt", i.cast("string")))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(len(feature_columns()) - 1)), lambda i: F.struct(digest(i).alias("d"), i.alias("i"))))
    return (frontier.select("tree", "node", "salt", "attempt").distinct()
            .select("tree", "node", F.transform(F.slice(order, F.col("attempt") * CANDIDATES + 1, F.lit(CANDIDATES)), lambda s: s["i"]).alias("features")))


def _counts(state: DataFrame, frontier: DataFrame) -> DataFrame:
    """(tree, node, place, feature, bin, capture, n0..n3, cnt): weight of each class and drawn rows."""
    drawn = state.where("w > 0").join(_candidates(frontier), ["tree", "node"])
    seen = drawn.select("tree", "node", "capture", "label", "w", "cnt", F.posexplode("features").alias("place", "feature"), "bins")
    return seen.groupBy("tree", "node", "place", "feature", F.element_at("bins", F.col("feature") + 1).cast("int").alias("bin"), "capture").agg(
        *[F.sum(F.when(F.col("label") == i, F.col("w")).otherwise(0)).alias(n) for i, n in enumerate(_SUMS)], F.sum("cnt").alias("cnt"))


def _best_splits(own: DataFrame, frontier: DataFrame, weights: DataFrame) -> DataFrame:
    """(tree, node, fold, best, n0..n3, cnt, w0..w3): counts of each fold at each of its nodes, and its best split or null."""
    keys = ["tree", "node", "place", "feature", "bin"]
    total = own.groupBy(keys).agg(*[F.sum(c).alias(f"t_{c}") for c in (*_SUMS, "cnt")])
    mine = own.withColumnRenamed("capture", "fold")
    left = total.join(frontier.select("tree", "node", "fold"), ["tree", "node"]).join(mine, [*keys, "fold"], "left")
    left = left.select(*keys, "fold", *[(F.col(f"t_{c}") - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in (*_SUMS, "cnt")]).where("cnt > 0")
    group = Window.partitionBy("tree", "node", "fold", "place")
    so_far = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = left.select(*keys, "fold", *[F.sum(c).over(so_far).alias(f"l_{c}") for c in (*_SUMS, "cnt")], *[F.sum(c).over(group).alias(f"p_{c}") for c in (*_SUMS, "cnt")])
    sums = sums.join(weights, "fold")

    def side(prefix: str):
        """(sum of squares, sum) of the weighted class counts."""
        w = [((F.col(f"l_{n}") if prefix == "l" else F.col(f"p_{n}") - F.col(f"l_{n}")) * F.col(f"w{i}")).cast("double") for i, n in enumerate(_SUMS)]
        return w[0] * w[0] + w[1] * w[1] + w[2] * w[2] + w[3] * w[3], w[0] + w[1] + w[2] + w[3]

    (ls, lw), (rs, rw) = side("l"), side("r")
    valid = (F.col("l_cnt") >= LEAST_LEAF) & (F.col("p_cnt") - F.col("l_cnt") >= LEAST_LEAF)
    score = F.when(valid, ls / lw + rs / rw)
    rank = F.when(valid, F.struct(score.alias("score"), (-F.col("place")).alias("place"), (-F.col("bin")).alias("bin")))
    return sums.groupBy("tree", "node", "fold").agg(
        F.max_by(F.when(valid, F.struct("feature", "bin")), rank).alias("best"), *[F.max(f"p_{n}").alias(n) for n in _SUMS], F.max("p_cnt").alias("cnt"),
        *[F.first(f"w{i}").alias(f"w{i}") for i in range(len(CLASSES))])


def walked(nodes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The place in ``nodes`` (records of left, right, feature, bin, the root first) where each row of bins ends."""
    left, right, feature, cut = (np.ascontiguousarray(nodes[c]) for c in ("left", "right", "feature", "bin"))
    flat, width = bins.ravel(), bins.shape[1]
    place = np.zeros(len(bins), np.int64)
    going = np.arange(len(bins)) if left[0] >= 0 else np.zeros(0, np.int64)
    while len(going):
        at = place[going]
        at = np.where(flat[going * width + feature[at]] <= cut[at], left[at], right[at])
        place[going] = at
        going = going[left[at] >= 0]
    return place


def grow(rows: DataFrame, label: str, trees: int, folds: bool, base: DataFrame | None = None, seed: int = 42, local_rows: int | None = None) -> Grown:
    """Grow ``trees`` trees on ``rows`` (capture, session_id, f_*, a label, and copy_no where rows are repeated).

    With ``folds`` every capture has a forest of its own that leaves it out, and its rows' votes come with it; otherwise one forest takes
    all. Rows of ``base`` are part of every fold. Rows without a class are left out. Nodes of at most ``local_rows`` rows are finished in a task.
    """
    points, cuts = _points(rows, label, base)
    if not folds:
        from sealcheck.operators import forest_blocks
        weights = np.array(_fold_weights(points, False).first()[1:], float)
        return Grown(forest_blocks.one_forest(points, weights, trees, seed, local_rows or forest_blocks.PART_ROWS), None, cuts)
    tries, local_rows = -(-len(feature_columns()) // CANDIDATES), local_rows or LOCAL_ROWS
    weights = staged(_fold_weights(points, folds), "weights")
    state = staged(_bootstrap(points, trees, seed), "rows")
    frontier = weights.select("fold", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(ROOT).alias("node"),
                              F.lit(ROOT).alias("salt"), F.lit(0).alias("attempt"))
    nodes, votes, depth = [], [], 0
    while True:
        sizes = staged(state.groupBy("tree", "node").agg((F.count(F.lit(1)) > local_rows).alias("large")), "sizes")
        found = sizes.agg(F.count_if("large").alias("large"), F.count_if(~F.col("large")).alias("small")).first()
        if found["small"]:
            small = sizes.where("not large").select("tree", "node")
            done = staged(_finished(state.join(small, ["tree", "node"]), frontier.join(small, ["tree", "node"]).join(weights, "fold"), depth, tries), "finished")
            nodes.append(done.where("kind <> 'vote'").select(*_NODE_COLUMNS))
            votes.append(done.where("kind = 'vote'").select(F.col("fold").alias("capture"), "session_id", "label", *_VOTES))
            if not found["large"]:
                break
            large = sizes.where("large").select("tree", "node")
            before, frontier = state, frontier.join(large, ["tree", "node"], "left_semi")
            state = staged(state.join(large, ["tree", "node"], "left_semi"), "rows")
            discard(before)
        elif not found["large"]:        # no rows at all
            nodes.append(_outcome(frontier.join(weights, "fold").select("*", *[F.lit(None).cast("bigint").alias(n) for n in (*_SUMS, "cnt")],
                                                                        F.lit(None).cast("struct<feature:int,bin:int>").alias("best")), tries)
                         .withColumn("depth", F.lit(depth)).select(*_NODE_COLUMNS))
            votes.append(state.select("capture", "session_id", "label", *[F.lit(0).cast("bigint").alias(v) for v in _VOTES]))
            break
        own = staged(_counts(state, frontier), "counts")        # summed up over captures, and met again by its own fold
        best = frontier.join(_best_splits(own, frontier, weights), ["tree", "node", "fold"], "left")
        out = staged(_outcome(best, tries).withColumn("depth", F.lit(depth)), "nodes")
        discard(own)
        nodes.append(out.select(*_NODE_COLUMNS))
        met = out.where("kind = 'leaf'").select("tree", "node", F.col("fold").alias("capture"), *_VOTES)
        met = state.join(met, ["tree", "node", "capture"]).groupBy("capture", "session_id", "label")
        votes.append(staged(met.agg(*[F.sum(v).alias(v) for v in _VOTES]), "votes"))
        open_nodes = out.where("kind <> 'leaf'")
        moves = open_nodes.select("tree", "node", "feature", "bin", "left_node", "right_node").distinct()
        goes_left = F.col("right_node").isNull() | (F.element_at("bins", F.col("feature") + 1) <= F.col("bin"))
        before = state
        state = staged(state.join(moves, ["tree", "node"]).select(
            "tree", F.when(goes_left, F.col("left_node")).otherwise(F.col("right_node")).alias("node"), "capture", "session_id", "label", "bins", "w", "cnt"), "rows")
        discard(before)
        if state.isEmpty():
            break
        again, child = F.col("kind") == "retry", F.explode(F.array_compact(F.array("left_node", "right_node")))
        frontier = open_nodes.select("tree", "fold", "salt", "attempt", "kind", child.alias("node")).select(
            "fold", "tree", "node", F.when(again, F.col("salt")).otherwise(F.col("node")).alias("salt"), F.when(again, F.col("attempt") + 1).otherwise(0).alias("attempt"))
        depth += 1
    return Grown(_all_of(nodes), _all_of(votes), cuts)


_NODE_COLUMNS = ["tree", "node", "fold", "depth", "kind", "rows", "feature", "bin", "left_node", "right_node", *_VOTES]
_FINISHED = ("tree int, node string, fold string, depth int, kind string, rows bigint, feature int, bin int, left_node string, right_node string, "
             "v0 bigint, v1 bigint, v2 bigint, v3 bigint, session_id string, label int")


def _finished(state: DataFrame, frontier: DataFrame, depth: int, tries: int) -> DataFrame:
    """Nodes, and votes (kind ``vote``, the capture as fold), of everything below the nodes of ``state``."""
    n_features = len(feature_columns())

    def hashed(*parts) -> str:
        return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()

    def splits(rows: dict[str, np.ndarray], at: np.ndarray, features: list[int], own_capture: np.ndarray, weights: np.ndarray):
        """Per fold: class counts, drawn rows, and its best score and (feature, bin), all candidates at once."""
        at = at[rows["w"][at] > 0]
        if len(own_capture) == 1:
            at = at[rows["capture"][at] != own_capture[0]]
            present, capture = np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        else:
            present, capture = np.unique(rows["capture"][at], return_inverse=True)
        k, n = len(features), max(1, len(present))
        cell = (capture[:, None] * k + np.arange(k)) * BINS + rows["bins"][at[:, None], features]
        by_class = np.bincount((cell * 4 + rows["label"][at][:, None]).ravel(), np.repeat(rows["w"][at], k), n * k * BINS * 4).reshape(n, k, BINS, 4)
        by_row = np.bincount(cell.ravel(), np.repeat(rows["cnt"][at], k), n * k * BINS).reshape(n, k, BINS)
        left = np.repeat(by_class.sum(axis=0)[None], len(own_capture), axis=0)
        seen = np.repeat(by_row.sum(axis=0)[None], len(own_capture), axis=0)
        place = np.minimum(np.searchsorted(present, own_capture), n - 1)
        held = np.flatnonzero(present[place] == own_capture) if len(present) else np.zeros(0, np.int64)
        left[held] -= by_class[place[held]]
        seen[held] -= by_row[place[held]]
        there = seen > 0
        left, seen = left.cumsum(axis=2), seen.cumsum(axis=2)
        counts, drawn = left[:, 0, -1], seen[:, 0, -1]
        valid = there & (seen >= LEAST_LEAF) & (drawn[:, None, None] - seen >= LEAST_LEAF)
        lw = left * weights[:, None, None]
        rw = (counts[:, None, None] - left) * weights[:, None, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            rated = [(x[..., 0] * x[..., 0] + x[..., 1] * x[..., 1] + x[..., 2] * x[..., 2] + x[..., 3] * x[..., 3])
                     / (x[..., 0] + x[..., 1] + x[..., 2] + x[..., 3]) for x in (lw, rw)]
        rated = np.where(valid, rated[0] + rated[1], -np.inf).reshape(len(own_capture), -1)
        top = rated.argmax(axis=1)
        return counts, drawn, rated[np.arange(len(top)), top], np.stack([np.array(features)[top // BINS], top % BINS], axis=1)

    def finish(rows: pd.DataFrame, opened: pd.DataFrame) -> pd.DataFrame:
        captures = {c: i for i, c in enumerate(sorted(set(rows["capture"])))}
        held = {"bins": np.stack(rows["bins"].to_numpy()).astype(np.int16), "capture": rows["capture"].map(captures).to_numpy(),
                **{c: rows[c].to_numpy(np.int64) for c in ("label", "w", "cnt")}}
        tree, folds = int(rows["tree"].iloc[0]), opened["fold"].to_numpy()
        own_capture = np.array([captures.get(f, -1) for f in folds])
        weights = opened[[f"w{i}" for i in range(4)]].to_numpy(float)
        made: list[tuple] = []
        todo = [(rows["node"].iloc[0], opened["salt"].iloc[0], int(opened["attempt"].iloc[0]), depth, np.arange(len(rows)), np.arange(len(folds)))]
        while todo:
            node, salt, attempt, level, at, who = todo.pop()
            order = sorted((hashed(tree, salt, i), i) for i in range(n_features))[attempt * CANDIDATES:(attempt + 1) * CANDIDATES]
            counts, drawn, score, chosen = splits(held, at, [i for _, i in order], own_capture[who], weights[who])
            children: dict[tuple[int, int] | None, list[int]] = {}
            for k, fold in enumerate(who):
                n_rows, weighted = int(drawn[k]), [int(c) * int(w) for c, w in zip(counts[k], weights[fold])]
                over = (counts[k] > 0).sum() <= 1 or n_rows < 2 * LEAST_LEAF
                if not over and score[k] > -np.inf:
                    feature, bin_ = map(int, chosen[k])
                    children.setdefault((feature, bin_), []).append(fold)
                    made.append((tree, node, folds[fold], level, "split", n_rows, feature, bin_, hashed(node, feature, bin_, "l")[:16], hashed(node, feature, bin_, "r")[:16],
                                 None, None, None, None, None, None))
                elif not over and attempt + 1 < tries:
                    children.setdefault(None, []).append(fold)
                    made.append((tree, node, folds[fold], level, "retry", n_rows, None, None, hashed(node, "retry")[:16], None, None, None, None, None, None, None))
                else:
                    whole = sum(weighted)
                    votes = [VOTE_UNIT * w // whole if whole else 0 for w in weighted]
                    made.append((tree, node, folds[fold], level, "leaf", n_rows, None, None, None, None, *votes, None, None))
                    for i in at[held["capture"][at] == own_capture[fold]].tolist():
                        made.append((tree, node, folds[fold], level, "vote", None, None, None, None, None, *votes, rows["session_id"].iloc[i], int(held["label"][i])))
            for split, group in children.items():
                if split is None:
                    todo.append((hashed(node, "retry")[:16], salt, attempt + 1, level + 1, at, np.array(group)))
                    continue
                low = held["bins"][at, split[0]] <= split[1]
                for side, part in (("l", at[low]), ("r", at[~low])):
                    child = hashed(node, *split, side)[:16]
                    todo.append((child, child, 0, level + 1, part, np.array(group)))
        names = [c.split()[0] for c in _FINISHED.split(", ")]
        frame = pd.DataFrame(made, columns=names)
        whole = ["tree", "depth", "rows", "feature", "bin", *_VOTES, "label"]
        return frame.astype({c: "Int64" for c in whole})

    return state.groupBy("tree", "node").cogroup(frontier.groupBy("tree", "node")).applyInPandas(finish, _FINISHED)


def _points(rows: DataFrame, label: str, base: DataFrame | None) -> tuple[DataFrame, list[list[float]]]:
    """(capture, session_id, base, label, copies, bins) and the cut points."""
    def tidy(part: DataFrame, is_base: bool) -> DataFrame:
        copy_no = F.col("copy_no") if "copy_no" in part.columns else F.lit(1)
        return part.select("capture", "session_id", F.lit(is_base).alias("base"), F.col(label).alias("label"), copy_no.cast("int").alias("copy_no"), *feature_columns())

    both = tidy(rows, False) if base is None else tidy(rows, False).unionByName(tidy(base, True))
    single = staged(both.where(F.col("label").isin(*CLASSES)).groupBy("capture", "session_id", "base").agg(
        F.first(F.array_position(F.array(*map(F.lit, CLASSES)), F.col("label")) - 1).cast("int").alias("label"), F.max("copy_no").alias("copies"),
        *[F.first(c).alias(c) for c in feature_columns()]), "points")
    cuts = feature_cuts(single)
    return single.select("capture", "session_id", "base", "label", "copies", binned(cuts).alias("bins")), cuts


def _bootstrap(points: DataFrame, trees: int, seed: int) -> DataFrame:
    """Every row at the root of every tree, with its weight and how many of its copies were drawn. Rows that were not are walked too."""
    key = F.concat_ws("|", "capture", "session_id", "copy_no", "tree", F.lit(str(seed)))
    drawn = (points.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
             .withColumn("d", draw(key)))
    drawn = drawn.groupBy("tree", "capture", "session_id", "base").agg(
        F.first("label").alias("label"), F.first("bins").alias("bins"), F.sum("d").cast("int").alias("w"), F.count_if(F.col("d") > 0).cast("int").alias("cnt"))
    return drawn.select("tree", F.lit(ROOT).alias("node"), F.when(F.col("base"), F.concat(F.lit("base|"), "capture")).otherwise(F.col("capture")).alias("capture"),
                        "session_id", "label", "bins", "w", "cnt")


def _outcome(best: DataFrame, tries: int) -> DataFrame:
    """What becomes of each fold at each of its nodes: a split, a retry with the next candidates, or a leaf with its votes."""
    classes = sum(F.when(F.col(n) > 0, 1).otherwise(0) for n in _SUMS)
    over = F.coalesce(classes <= 1, F.lit(True)) | (F.col("cnt") < 2 * LEAST_LEAF)
    kind = F.when(over, "leaf").when(F.col("best").isNotNull(), "split").when(F.col("attempt") + 1 < tries, "retry").otherwise("leaf")
    weighted = [F.coalesce(F.col(n) * F.col(f"w{i}"), F.lit(0)) for i, n in enumerate(_SUMS)]
    whole = weighted[0] + weighted[1] + weighted[2] + weighted[3]
    split, leaf = F.col("kind") == "split", F.col("kind") == "leaf"
    return best.withColumn("kind", kind).select(
        "tree", "node", "fold", "salt", "attempt", "kind", F.coalesce("cnt", F.lit(0)).alias("rows"),
        F.when(split, F.col("best.feature")).alias("feature"), F.when(split, F.col("best.bin")).alias("bin"),
        *[F.when(leaf, F.when(whole > 0, F.floor(F.lit(VOTE_UNIT) * w / whole)).otherwise(0)).cast("bigint").alias(v) for v, w in zip(_VOTES, weighted)],
        F.when(split, _child(F.col("node"), F.col("best.feature"), F.col("best.bin"), "l")).when(F.col("kind") == "retry", _child(F.col("node"), "retry")).alias("left_node"),
        F.when(split, _child(F.col("node"), F.col("best.feature"), F.col("best.bin"), "r")).alias("right_node"))


def _all_of(parts: list[DataFrame]) -> DataFrame:
    one = parts[0]
    for other in parts[1:]:
        one = one.unionByName(other)
    return one


def verdict(trees: int) -> tuple[Column, Column]:
    """(class, confidence in percent with two decimals) of summed votes v0..v3; the first of equal classes."""
    best = F.greatest(*_VOTES)
    at = F.array_position(F.array(*[F.col(v) for v in _VOTES]), best).cast("int")
    return F.element_at(F.array(*map(F.lit, CLASSES)), at), F.bround(best * 100 / (trees * VOTE_UNIT), 2)


def held_out_classes(grown: Grown, trees: int) -> DataFrame:
    """(capture, session_id, label, ml_class) by the votes of the fold that left the capture out."""
    summed = grown.votes.groupBy("capture", "session_id", "label").agg(*[F.sum(v).alias(v) for v in _VOTES])
    return summed.select("capture", "session_id", F.element_at(F.array(*map(F.lit, CLASSES)), F.col("label") + 1).alias("label"), verdict(trees)[0].alias("ml_class"))


@dataclass(frozen=True)
class ForestModel:
    """One forest: ``nodes`` as grown, the features' cut points and the number of trees."""
    nodes: DataFrame
    cuts: list[list[float]]
    trees: int

    def votes(self, features: DataFrame) -> DataFrame:
        """``features`` with the summed votes v0..v3 of all trees."""
        if self.nodes.count() <= BROADCAST_NODES:
            return self._broadcast_votes(features)
        return self._joined_votes(features)

    def packed_trees(self) -> DataFrame:
        """(tree, nodes): the nodes of a tree as records, its root first. Names become places in the task that holds the tree."""
        def pack(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("depth", kind="stable")
            place = pd.Series(np.arange(len(part)), index=part["node"])
            nodes = np.zeros(len(part), _RECORD)
            nodes["left"] = part["left_node"].map(place).fillna(-1)
            nodes["right"] = np.where(part["right_node"].isna(), nodes["left"], part["right_node"].map(place).fillna(-1))
            nodes["feature"], nodes["bin"] = part["feature"].fillna(0), part["bin"].fillna(-1)
            for v in _VOTES:
                nodes[v] = part[v].fillna(0)
            return pd.DataFrame({"tree": [int(part["tree"].iloc[0])], "nodes": [nodes.tobytes()]})

        wanted = self.nodes.select("tree", "node", "depth", "feature", "bin", "left_node", "right_node", *_VOTES)
        return wanted.groupBy("tree").applyInPandas(pack, "tree int, nodes binary")

    def _broadcast_votes(self, features: DataFrame) -> DataFrame:
        trees = [bytes(r["nodes"]) for r in self.packed_trees().collect()]
        held = features.sparkSession.sparkContext.broadcast(trees)

        @F.pandas_udf(", ".join(f"{v} bigint" for v in _VOTES))
        def walk(bins: pd.Series) -> pd.DataFrame:
            values = np.stack(bins.to_numpy()) if len(bins) else np.zeros((0, 1), np.int64)
            total = np.zeros((len(bins), len(_VOTES)), np.int64)
            for tree in held.value:
                nodes = np.frombuffer(tree, _RECORD)
                met = nodes[walked(nodes, values)]
                for i, v in enumerate(_VOTES):
                    total[:, i] += met[v]
            return pd.DataFrame(total, columns=_VOTES)

        return features.withColumn("_v", walk(binned(self.cuts))).select(*[F.col(f"`{c}`") for c in features.columns], "_v.*")

    def _joined_votes(self, features: DataFrame) -> DataFrame:
        """The same without a whole model in any task: parts of the rows meet some trees each, and their votes are summed."""
        spark, width = features.sparkSession, len(self.cuts)
        rows = staged(features.withColumn("_row", F.monotonically_increasing_id()), "features")
        trees = staged(self.packed_trees(), "trees")
        sizes = sorted(((r["size"], r["tree"]) for r in trees.select("tree", (F.length("nodes") / _RECORD.itemsize).cast("int").alias("size")).collect()), reverse=True)
        parts = max(1, -(-rows.count() // SCORED_ROWS))
        groups = min(len(sizes), max(-(-sum(n for n, _ in sizes) // BROADCAST_NODES), -(-2 * spark.sparkContext.defaultParallelism // parts)))
        group_of = spark.createDataFrame([(tree, i % groups) for i, (_, tree) in enumerate(sizes)], "tree int, group int")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    ids, bins = b.column("_row").to_numpy(), b.column("bins").flatten().to_numpy().astype(np.uint8)
                    yield pa.RecordBatch.from_pydict({"first": ids[:1], "ids": [ids.tobytes()], "bins": [bins.tobytes()]})

        def walk(model: pa.Table, blocks: pa.Table) -> pa.Table:
            ids = np.frombuffer(b"".join(blocks.column("ids").to_pylist()), np.int64)
            bins = np.frombuffer(b"".join(blocks.column("bins").to_pylist()), np.uint8).reshape(len(ids), width)
            total = np.zeros((len(_VOTES), len(ids)), np.int64)
            for tree in model.column("nodes").to_pylist() if len(ids) else ():
                nodes = np.frombuffer(tree, _RECORD)
                place = walked(nodes, bins)
                for i, v in enumerate(_VOTES):
                    total[i] += nodes[v][place]
            return pa.table({"_row": ids, **dict(zip(_VOTES, total))})

        blocks = rows.select("_row", binned(self.cuts).alias("bins")).mapInArrow(pack, "first bigint, ids binary, bins binary")
        blocks = blocks.select(F.pmod(F.xxhash64("first"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "ids", "bins")
        model = trees.join(F.broadcast(group_of), "tree").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "group", "nodes")     # a row per tree
        keys = ["part", "group"]
        sides = [side.repartition(parts * groups, *keys).groupBy(*keys) for side in (model, blocks)]
        votes = sides[0].cogroup(sides[1]).applyInArrow(walk, "_row bigint, " + ", ".join(f"{v} bigint" for v in _VOTES))
        return rows.join(votes.groupBy("_row").agg(*[F.sum(v).alias(v) for v in _VOTES]), "_row").drop("_row")
