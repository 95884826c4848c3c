"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its emission score is linear in threshold tests of its own statistics and of both neighbours'; a transition
score links neighbouring lines. Weights maximise the penalised likelihood of the labelled texts, where each line carries the
label of its text, on all lines of at most ``SAMPLE_ROWS`` texts chosen by a hash of the id. The
forward-backward marginals of all lines of a whole text, weighted by line length, make its mean goodness; two numbers fitted on
the same sample turn that into a score.

Null and empty texts have no line with a word and score the share of good labels. Blank lines are no lines. Without labels of both
kinds every text scores that share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from sealcheck.llm import common, textscan
from sealcheck.llm.toxicity import fold, sigmoid

SAMPLE_ROWS = 6_000
CUTS, STEPS, RATE, PENALTY = 7, 120, 0.1, 2.0

_SYMBOL, _UPPER, _DIGIT, _MARK, _POINT = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"!?")] = True
_POINT[0:128] = True
_POINT[192:256] = True
STATISTICS = ["words", "chars_per_word", "symbols_per_word", "upper_share", "digit_share", "marks_per_word", "distinct_share", "repeat_share", "seen_before"]


def line_statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics per line with a word, its text, its length in bytes), lines in order."""
    scan = textscan.Scan(texts)
    start, end, doc = scan.lines()
    first, last = np.searchsorted(scan.start, start), np.searchsorted(scan.start, end)
    shown = last > first
    start, end, doc, first, last = start[shown], end[shown], doc[shown], first[shown], last[shown]
    n_words = (last - first).astype(float)
    words = scan.word_hashes()
    line_of = np.repeat(np.arange(len(first)), last - first)
    words = words[first[0]:] if len(first) else words
    salt = textscan.mix(np.arange(1, len(first) + 1).astype(np.uint64))
    _, once = np.unique(words ^ salt[line_of], return_index=True)
    again = np.append(False, (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])) if len(words) else np.zeros(0, bool)
    _, first_line = np.unique(scan.hashes(start, end) ^ textscan.mix(doc.astype(np.uint64) + np.uint64(7)), return_index=True)
    seen = np.ones(len(first))
    seen[first_line] = 0

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask[scan.data])])
        return (sums[end] - sums[start]).astype(float)

    chars = np.maximum(share(_POINT), 1)
    found = np.stack([n_words, chars / n_words, share(_SYMBOL) / n_words, share(_UPPER) / chars, share(_DIGIT) / chars, share(_MARK) / n_words,
                      np.bincount(line_of[once], minlength=len(first)) / n_words, np.bincount(line_of[again], minlength=len(first)) / n_words,
                      seen], axis=1) if len(first) else np.zeros((0, len(STATISTICS)))
    return found, doc, (end - start).astype(float)


def chain_marginals(emission: np.ndarray, doc: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once, each a run of equal ``doc``.

    ``emission`` is the score of good against bad per line, ``transition[i, j]`` that of state i before j. Returns P(good) per line, the
    expected transition counts, and the log normaliser of all chains.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    length = np.diff(np.append(begin, n))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    alive = np.searchsorted(-length, -np.arange(length[0]), "left")     # chains longer than t
    score = np.stack([np.zeros(n), emission], axis=1)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))

    def fold_in(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis)
        return top + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis))

    for t in range(length[0]):
        at = begin[:alive[t]] + t
        forward[at] = score[at] if t == 0 else score[at] + fold_in(forward[at - 1][:, :, None] + transition, 1)
    for t in range(length[0] - 2, -1, -1):
        at = begin[:alive[t + 1]] + t
        backward[at] = fold_in(transition + (score[at + 1] + backward[at + 1])[:, None, :], 2)
    ends = begin + length - 1
    normal = fold_in(forward[ends], 1)
    of_line = np.repeat(normal, length)
    lines = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(n)
    log_z = np.zeros(n)
    log_z[lines] = of_line
    good = np.exp(forward[:, 1] + backward[:, 1] - log_z)
    after = np.flatnonzero(np.append(False, doc[1:] == doc[:-1]))
    joint = np.exp(forward[after - 1][:, :, None] + transition + (score[after] + backward[after])[:, None, :] - log_z[after][:, None, None])
    return good, joint.sum(0), float(normal.sum())


@dataclass
class Model:
    cuts: list[np.ndarray]          # thresholds of each statistic
    tables: list[np.ndarray]        # per statistic: (previous, own, next) x bin
    bias: float
    transition: np.ndarray
    scale: tuple[float, float]      # score = sigmoid(a * mean goodness + b)
    share: float                    # score of a text without lines

    def bins(self, statistics: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, statistics[:, i], "left") for i, c in enumerate(self.cuts)], axis=1)

    def emission(self, bins: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.bias)
        inside = doc[1:] == doc[:-1]
        for i, table in enumerate(self.tables):
            own = bins[:, i]
            out += table[1][own]
            out[1:] += np.where(inside, table[0][own[:-1]], 0)
            out[:-1] += np.where(inside, table[2][own[1:]], 0)
        return out

    def goodness(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(length-weighted mean of P(good), whether the text has lines) per text."""
        statistics, doc, length = line_statistics(texts)
        good, _, _ = chain_marginals(self.emission(self.bins(statistics), doc), doc, self.transition)
        weight = np.bincount(doc, length, len(texts))
        return np.bincount(doc, length * good, len(texts)) / np.maximum(weight, 1), weight > 0

    def score(self, texts: list[bytes]) -> np.ndarray:
        mean, has_lines = self.goodness(texts)
        return np.where(has_lines, sigmoid(self.scale[0] * mean + self.scale[1]), self.share)


def train(statistics: np.ndarray, doc: np.ndarray, length: np.ndarray, label: np.ndarray) -> Model:
    """Fit on lines of texts; ``label`` is per text (``doc`` numbers them from 0, ascending)."""
    share = (label.sum() + 1) / (len(label) + 2)
    cuts = [np.unique(np.quantile(statistics[:, i], np.linspace(0, 1, CUTS + 2)[1:-1])) if len(statistics) else np.zeros(0) for i in range(len(STATISTICS))]
    # rates that are mostly zero still need a test between zero and more
    cuts = [np.unique(np.append(c, 0.0)) for c in cuts]
    model = Model(cuts, [np.zeros((3, len(c) + 1)) for c in cuts], 0.0, np.zeros((2, 2)), (0.0, float(np.log(share / (1 - share)))), share)
    if not len(doc) or label.min() == label.max():
        return model
    bins, y = model.bins(statistics), label[doc].astype(float)
    inside = doc[1:] == doc[:-1]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[:-1][inside].astype(int), y[1:][inside].astype(int)), 1)
    # both kinds of text weigh the same, and so does every text, however many lines it has
    n_lines = np.bincount(doc, minlength=len(label)).astype(float)
    parts = [t for table in model.tables for t in (table[0], table[1], table[2])]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in parts] + [[np.zeros(1), np.zeros(1)], [np.zeros((2, 2)), np.zeros((2, 2))]]
    bias = np.zeros(1)
    n = len(y)
    for step in range(1, STEPS + 1):
        model.bias = float(bias[0])
        good, expected, _ = chain_marginals(model.emission(bins, doc), doc, model.transition)
        error = good - y
        slopes = []
        for i, table in enumerate(model.tables):
            own, size = bins[:, i], table.shape[1]
            slopes += [np.bincount(own[:-1], np.where(inside, error[1:], 0), size), np.bincount(own, error, size),
                       np.bincount(own[1:], np.where(inside, error[:-1], 0), size)]
        slopes = [(s + PENALTY * p) / n for s, p in zip(slopes, parts)] + [np.array([error.sum() / n]), (expected - pairs + PENALTY * model.transition) / n]
        for value, slope, held in zip([*parts, bias, model.transition], slopes, state):
            held[0][...] = 0.9 * held[0] + 0.1 * slope
            held[1][...] = 0.99 * held[1] + 0.01 * slope**2
            value -= RATE * (1 - step / (STEPS + 1)) * held[0] / (1 - 0.9**step) / (np.sqrt(held[1] / (1 - 0.99**step)) + 1e-8)
    model.bias = float(bias[0])
    good, _, _ = chain_marginals(model.emission(bins, doc), doc, model.transition)
    has_lines = n_lines > 0
    mean = np.bincount(doc, length * good, len(label))[has_lines] / np.bincount(doc, length, len(label))[has_lines]
    model.scale = _calibrate(mean, label[has_lines].astype(float))
    return model


def _calibrate(mean: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the mean goodness, by Newton steps with a small penalty."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * mean + b)
        w = p * (1 - p) + 1e-6
        slope = np.array([(mean * (p - label)).sum() + 0.01 * a, (p - label).sum()])
        bend = np.array([[(w * mean**2).sum() + 0.01, (w * mean).sum()], [(w * mean).sum(), w.sum()]])
        da, db = np.linalg.solve(bend, slope)
        a, b = a - float(np.clip(da, -5, 5)), b - float(np.clip(db, -5, 5))
    return a, b


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "label").limit(sample_rows)
    sample = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")

    def lines(texts: list[bytes]) -> dict[str, list]:
        found, doc, length = line_statistics(texts)
        rows = []
        for i in range(len(texts)):
            own = np.flatnonzero(doc == i)
            rows.append(np.column_stack([found[own], length[own]]).ravel())
        return {"lines": rows}

    held = common.map_texts(sample, "text", ["_id", "label"], lines, [T.StructField("lines", T.ArrayType(T.DoubleType()))])
    held = held.select("row.*", "out.lines").toPandas().sort_values(["_id", "label"])
    width = len(STATISTICS) + 1
    blocks = [np.asarray(x, float).reshape(-1, width) for x in held["lines"]]
    rows = np.concatenate([*blocks, np.zeros((0, width))])
    return train(rows[:, :-1], np.repeat(np.arange(len(blocks)), [len(b) for b in blocks]), rows[:, -1], held["label"].to_numpy(int))


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``out.score``."""
    return common.map_texts(docs, text, docs.columns if keep is None else keep, lambda texts: {"score": model.score(texts)},
                            [T.StructField("score", T.DoubleType())])


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2)
    model = fit(docs, labels)
    return scored(docs, model, keep=["doc_id"]).select(
        "row.doc_id", F.coalesce(fold(F.col("row.doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("out.score").alias("score"),
        (F.col("out.score") >= 0.7).cast("int").alias("predicted"))
