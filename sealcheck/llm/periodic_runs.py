"""Runs of repeated words: maximal stretches whose words repeat at their smallest period, found by multi-scale minimizers.

A run has at least ``LEAST_WORDS`` words and ``LEAST_TURNS`` periods. Periods up to ``SHORT`` are found by comparing the words with those
so many places before. Longer ones fall into scales. At the scale of length g all stretches of g words are hashed, and a stretch is
sampled where its hash is the least of a window of stretches. A run whose period p has p <= g holds p different stretches of g words,
so a stretch is first seen again p words later; and it is long enough that a whole window lies in it a period before its end, so some
sampled stretch is sampled again there. Neighbours among equal sampled stretches therefore seed every run, and their number grows with the
text and not with its square. Seeds are extended to both sides by comparing hashes of doubling length; what results is compared word
by word, and dropped where a smaller period does it too.

Null, empty and short texts have no runs. Repeated rows and rows without an id are treated row by row; a long text is scanned alone,
with memory in proportion to it. Columns of the input sit in ``row`` and clash with nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sealcheck.llm import common, textscan

LEAST_WORDS, LEAST_TURNS = 24, 3
#: Periods found by direct comparison.
SHORT = 8
_RUN = T.StructType([common.long_field("start"), common.long_field("length"), common.long_field("period")])


def _least(period):
    return np.maximum(LEAST_WORDS, LEAST_TURNS * period)


def lag_runs(words: np.ndarray, period: int, first: int = 0) -> np.ndarray:
    """(start, end, period) of all stretches of ``words`` that repeat at ``period`` and are long enough for a run."""
    same = np.zeros(max(len(words) - period, 0) + 2, np.int8)
    same[1:-1] = words[period:] == words[:max(len(words) - period, 0)]
    edge = np.flatnonzero(np.diff(same))
    start, end = edge[0::2], edge[1::2] + period
    long = end - start >= _least(period)
    return np.stack([first + start[long], first + end[long], np.full(int(long.sum()), period)], axis=1)


def sampled(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least hash of some ``window`` places in a row."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)

    def slide(values: np.ndarray, best: np.ufunc) -> np.ndarray:
        """The best of each ``window`` values in a row."""
        reach = 1
        while 2 * reach <= window:
            values, reach = best(values[:-reach], values[reach:]), 2 * reach
        return best(values[:len(values) - (window - reach)], values[window - reach:]) if window > reach else values

    lows = slide(hashes, np.minimum)
    # a place is sampled if the highest of the lows around it is its own
    around = slide(np.concatenate([np.zeros(window - 1, np.uint64), lows, np.zeros(window - 1, np.uint64)]), np.maximum)
    return np.flatnonzero(around == hashes)


def _seeds(prefix: textscan.PrefixHash, doc_start: np.ndarray, doc_end: np.ndarray, before: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of neighbours among equal sampled stretches of ``length`` words, more than ``before`` and at most ``length`` apart."""
    fit = doc_end - doc_start >= LEAST_TURNS * (before + 1)
    start, size = doc_start[fit], doc_end[fit] - doc_start[fit] - length + 1
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    hashes = prefix.of(at, at + length)
    chosen = sampled(hashes, 2 * (before + 1) - length + 1)
    order = chosen[np.argsort(hashes[chosen], kind="stable")]
    same = hashes[order[1:]] == hashes[order[:-1]]
    place, distance = at[order[:-1][same]], (at[order[1:]] - at[order[:-1]])[same]
    wanted = (distance > before) & (distance <= length)
    return place[wanted], distance[wanted]


def _extend(prefix: textscan.PrefixHash, size: int, place: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretch around each seed that repeats at its distance."""
    left, right = place.copy(), place.copy()
    for step in (1 << k for k in range(size.bit_length(), -1, -1)):
        at = np.flatnonzero(left >= step)
        a, b = left[at] - step, left[at] + distance[at]
        left[at[prefix.of(a, a + step) == prefix.of(b - step, b)]] -= step
        at = np.flatnonzero(right + distance + step <= size)
        a, b = right[at], right[at] + distance[at]
        right[at[prefix.of(a, a + step) == prefix.of(b, b + step)]] += step
    return left, right + distance


def _smallest(words: np.ndarray, start: int, end: int, period: int) -> bool:
    """No divisor of the period is a period; a smaller period of a run always divides it."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            lag = period // prime
            if np.array_equal(words[start:start + period], words[start + lag:start + lag + period]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def find_runs(words: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), in order of start and period, of all runs in the texts at ``doc_start`` to ``doc_end``.

    ``words`` are numbers from 1; between texts stands a number that occurs nowhere else.
    """
    found = [lag_runs(words, period) for period in range(1, SHORT + 1)]
    longest = int((doc_end - doc_start).max()) if len(doc_start) else 0
    if longest > LEAST_TURNS * SHORT:
        prefix, before = textscan.PrefixHash(words), SHORT
        while LEAST_TURNS * (before + 1) <= longest:
            length = before + before // 2
            place, distance = _seeds(prefix, doc_start, doc_end, before, length)
            start, end = _extend(prefix, len(words), place, distance)
            rows = np.stack([start, end, distance], axis=1)[end - start >= _least(distance)]
            for a, b, p in np.unique(rows, axis=0).tolist():
                if np.array_equal(words[a:b - p], words[a + p:b]):
                    found.append(np.array([[a, b, p]]))
                else:                   # two stretches of equal hash: compare the whole text
                    doc = np.searchsorted(doc_end, a, "right")
                    found.append(lag_runs(words[doc_start[doc]:doc_end[doc]], p, int(doc_start[doc])))
            before = length
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[[_smallest(words, *row) for row in rows.tolist()]] if len(rows) else rows.reshape(0, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def scan(texts: list[list[bytes]]) -> tuple[list[list[dict[str, int]]], list[bytes]]:
    """Per text (a list of words) its runs, and the words that are kept, joined by one space. Of each run the first period stays."""
    number: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    doc_start = np.cumsum(sizes + 1) - sizes - 1
    words = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    for start, size, text in zip(doc_start.tolist(), sizes.tolist(), texts):
        words[start:start + size] = [number.setdefault(w, len(number) + 1) for w in text]
    words[doc_start + sizes] = len(number) + 1 + np.arange(len(texts))
    rows = find_runs(words, doc_start, doc_start + sizes)
    doc = np.searchsorted(doc_start, rows[:, 0], "right") - 1
    runs: list[list[dict[str, int]]] = [[] for _ in texts]
    dropped: dict[int, np.ndarray] = {}
    for i, (start, end, period) in zip(doc.tolist(), rows.tolist()):
        start, end = start - int(doc_start[i]), end - int(doc_start[i])
        runs[i].append({"start": start, "length": end - start, "period": period})
        dropped.setdefault(i, np.zeros(len(texts[i]), bool))[start + period:end] = True
    kept = [b" ".join(text if i not in dropped else [w for w, gone in zip(text, dropped[i].tolist()) if not gone]) for i, text in enumerate(texts)]
    return runs, kept


def with_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, change: Callable[..., list[bytes]] | None = None,
              inputs: tuple[Column, ...] = ()) -> DataFrame:
    """Columns ``row`` and ``out``: ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``change`` may alter the words of each text first; it gets them and the values of ``inputs``.
    """
    def work(texts: list[bytes], *values: list) -> dict[str, list]:
        words = [t.split() for t in texts]          # white space of bytes is [\x20\x09-\x0D]
        if change is not None:
            words = [change(*given) for given in zip(words, *values)]
        runs, kept = scan(words)
        return {"runs": runs, "collapsed": [k.decode() for k in kept]}

    fields = [T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())]
    return common.map_texts(docs, text, docs.columns if keep is None else keep, work, fields, inputs=inputs)


def highest_exponent(runs: Column) -> Column:
    """The run of the greatest length / period, the first of equal ones; null without runs."""
    return F.aggregate(runs, F.lit(None).cast(_RUN), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def repeated_tail(words: list[bytes], h: int | None) -> list[bytes]:
    """The study's texts: every tenth repeats a part of itself to its end."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (1 + (n - a) // p))[:n - a]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_runs(docs, keep=["doc_id"], change=repeated_tail, inputs=(F.crc32(F.col("doc_id").cast("string")),))
    best = found.select("row.doc_id", "out.runs", "out.collapsed", highest_exponent(F.col("out.runs")).alias("best"))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
