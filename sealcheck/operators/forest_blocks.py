"""One forest without held-out folds, grown on rows that are packed once.

The folds of ``forest`` need counts by capture and a row per tree and level. A forest of all rows needs neither: its rows are packed into blocks
with their bins, classes and bootstrap weights of all trees, and no row is written again while the trees grow. Per level

* a task walks its blocks through the splits so far and counts classes by (node, feature, bin) for the nodes of more than ``PART_ROWS`` drawn rows;
* the counts are summed by node, a best split per node reaches the driver: no more than trees * drawn rows / ``PART_ROWS`` of them a level;
* when no node is larger, the rows of the smaller ones are dealt out in parts of about ``PART_ROWS`` rows, and the tasks that hold them grow the rest.

Draws, candidates, scores and names are those of ``forest``, so the trees are the same.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sealcheck.operators.features import feature_columns
from sealcheck.operators.forest import BINS, CANDIDATES, CLASSES, LEAST_LEAF, NO_FOLD, ROOT, VOTE_UNIT, poisson_steps, walked
from sealcheck.session import discard, staged

#: Drawn rows that one task may hold while it finishes nodes (some 250 bytes each).
PART_ROWS = 200_000
#: Rows of a block, nodes that are counted in one pass, nodes that are rated at once.
BLOCK_ROWS, PASS_NODES, RATED_NODES = 4_096, 8_192, 2_048
#: Rows of the points that a task packs.
TASK_ROWS = 50_000

N, CELLS = len(CLASSES), CANDIDATES * BINS
LEAF, SPLIT, RETRY = "leaf", "split", "retry"
_BLOCK = "kind string, bins binary, label binary, w binary, cnt binary"
_PART = f"part int, units binary, {_BLOCK}"
_NODE = ("tree int, node string, fold string, depth int, kind string, rows bigint, feature int, bin int, left_node string, right_node string, "
         "v0 bigint, v1 bigint, v2 bigint, v3 bigint")
_NODE_ARROW = pa.schema([("tree", pa.int32()), ("node", pa.string()), ("fold", pa.string()), ("depth", pa.int32()), ("kind", pa.string()), ("rows", pa.int64()),
                         ("feature", pa.int32()), ("bin", pa.int32()), ("left_node", pa.string()), ("right_node", pa.string()), *[(f"v{i}", pa.int64()) for i in range(N)]])
_TOP = np.dtype([("left", "<i4"), ("right", "<i4"), ("feature", "i1"), ("bin", "i1"), ("slot", "<i4")])


def child_name(*parts) -> str:
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:16]


def candidate_order(tree: int, salt: str) -> list[int]:
    start = f"{tree}|{salt}|".encode()
    return sorted(range(len(feature_columns())), key=lambda i: (hashlib.md5(start + b"%d" % i).digest(), i))


def candidates(order: list[int], attempt: int) -> list[int]:
    """The features of an attempt; a short last one repeats its last feature, which changes no choice as the first of equals wins."""
    found = order[attempt * CANDIDATES:(attempt + 1) * CANDIDATES]
    return (found + found[-1:] * CANDIDATES)[:CANDIDATES]


def best_splits(ids: np.ndarray, by_class: np.ndarray, by_row: np.ndarray, counts: np.ndarray, drawn: np.ndarray, weights: np.ndarray):
    """(score, place, bin, drawn rows to the left) of each node's best split, score -inf where none is valid.

    ``ids`` are the ascending (node, place, bin) cells that hold drawn rows, every node has some; ``by_class`` and ``by_row`` their sums.
    """
    node, line = ids // CELLS, ids // BINS
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    size = np.diff(np.r_[first, len(ids)])
    left, seen = by_class.cumsum(axis=0), by_row.cumsum()
    left -= np.repeat(np.concatenate([np.zeros((1, N)), left[first[1:] - 1]]), size, axis=0)
    seen -= np.repeat(np.r_[0, seen[first[1:] - 1]], size)
    valid = (seen >= LEAST_LEAF) & (drawn[node] - seen >= LEAST_LEAF)
    score = np.full(len(ids), -np.inf)
    some = np.flatnonzero(valid)
    sides = []
    for side in (left[some], counts[node[some]] - left[some]):
        x = (side * weights).T
        sides.append((x[0] * x[0] + x[1] * x[1] + x[2] * x[2] + x[3] * x[3]) / (x[0] + x[1] + x[2] + x[3]))
    score[some] = sides[0] + sides[1]
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    top = np.maximum.reduceat(score, start)
    hits = np.flatnonzero(score == np.repeat(top, np.diff(np.r_[start, len(ids)])))
    hits = hits[np.r_[True, node[hits[1:]] != node[hits[:-1]]]]         # the first place and bin among equals
    return top, ids[hits] // BINS % CANDIDATES, ids[hits] % BINS, seen[hits]


def closed(counts: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Is a node a leaf, whatever its candidates are?"""
    return ((counts > 0).sum(axis=1) <= 1) | (drawn < 2 * LEAST_LEAF)


def leaf_votes(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    weighted = np.rint(counts).astype(np.int64) * weights.astype(np.int64)
    return VOTE_UNIT * weighted // np.maximum(weighted.sum(axis=1), 1)[:, None]


# ------------------------------------------------------------------ blocks
def packed_points(points: DataFrame, trees: int, seed: int, rows: int) -> DataFrame:
    """Blocks of points with the bootstrap weight and the drawn copies of each row in each tree, tree by tree."""
    steps = np.array(poisson_steps(), np.int64)
    tails = [f"{tree}|{seed}".encode() for tree in range(trees)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = hashlib.md5
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                bins = part.column("bins").flatten().to_numpy().astype(np.uint8)
                copies = part.column("copies").to_numpy()
                row = np.repeat(np.arange(len(copies)), copies)
                keys = [f"{key}{copy}|".encode() for key, n in zip(part.column("key").to_pylist(), copies.tolist()) for copy in range(1, n + 1)]
                kind = np.min_scalar_type(len(steps) * int(copies.max()))
                w, cnt = np.zeros((2, trees, len(copies)), kind)
                for tree, tail in enumerate(tails):
                    u = np.frombuffer(b"".join([md5(key + tail).digest() for key in keys]), ">u4")[::4].astype(np.int64)
                    drawn = np.searchsorted(steps, u, side="right")
                    w[tree] = np.bincount(row, drawn, len(copies))
                    cnt[tree] = np.bincount(row, drawn > 0, len(copies))
                label = part.column("label").to_numpy().astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"kind": [kind.str], "bins": [bins.tobytes()], "label": [label.tobytes()], "w": [w.tobytes()], "cnt": [cnt.tobytes()]})

    parallelism = points.sparkSession.sparkContext.defaultParallelism
    parts = max(2 * parallelism, -(-rows // TASK_ROWS))
    keyed = points.where("copies > 0").select(F.concat_ws("|", "capture", "session_id", F.lit("")).alias("key"), "label", "copies", "bins")
    return staged(keyed.repartition(parts).mapInArrow(pack, _BLOCK), "blocks")


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(bins, label, w, cnt) of each block of a batch; w and cnt have a line per tree where a block has several."""
    for row in batch.to_pylist():
        label = np.frombuffer(row["label"], np.uint8)
        bins = np.frombuffer(row["bins"], np.uint8).reshape(len(label), -1)
        yield bins, label, *[np.frombuffer(row[c], row["kind"]).reshape(-1, len(label)) for c in ("w", "cnt")]


def counted(blocks: DataFrame, tops: dict[int, np.ndarray], features: np.ndarray, weights: np.ndarray) -> list:
    """Of each node with a slot: its counts, drawn rows and best split. ``features`` has the candidates of each slot; a tree's slots are neighbours."""
    spark = blocks.sparkSession
    held = spark.sparkContext.broadcast((tops, features))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, features = held.value
        sums = np.zeros((len(features) * CELLS, N + 1))
        for batch in batches:
            for bins, label, w, cnt in unpacked(batch):
                for tree, top in tops.items():
                    at = np.flatnonzero(w[tree])
                    slot = top["slot"][walked(top, bins[at])]
                    at, slot = at[slot >= 0], slot[slot >= 0]
                    if not len(at):
                        continue
                    low, high = int(slot.min()) * CELLS, (int(slot.max()) + 1) * CELLS
                    cell = (slot[:, None] * CANDIDATES + np.arange(CANDIDATES)) * BINS + bins[at[:, None], features[slot]] - low
                    sums[low:high, :N] += np.bincount((cell * N + label[at][:, None]).ravel(), np.repeat(w[tree][at], CANDIDATES), (high - low) * N).reshape(-1, N)
                    sums[low:high, N] += np.bincount(cell.ravel(), np.repeat(cnt[tree][at], CANDIDATES), high - low)
        lines = sums.reshape(len(features), -1)
        seen = np.flatnonzero(lines.any(axis=1))
        for i in range(0, len(seen), 512):
            yield pa.RecordBatch.from_pydict({"slot": pa.array(seen[i:i + 512], pa.int32()), "sums": [lines[k].tobytes() for k in seen[i:i + 512]]})

    def choose(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x, float) for x in table.column("sums").to_pylist()).reshape(-1, N + 1)
        counts, drawn = sums[:BINS].sum(axis=0)[None, :N], sums[:BINS, N].sum()[None]
        ids = np.flatnonzero(sums[:, N])
        score, place, cut, left = best_splits(ids, sums[ids, :N], sums[ids, N], counts, drawn, weights)
        found = score[0] > -np.inf
        return pa.table({"slot": table.column("slot")[:1].combine_chunks(), "counts": pa.array([counts[0].tolist()], pa.list_(pa.float64())), "drawn": pa.array(drawn.astype(np.int64)),
                         "place": pa.array([int(place[0]) if found else None], pa.int32()), "bin": pa.array([int(cut[0])], pa.int32()), "to_left": pa.array(left.astype(np.int64))})

    summed = blocks.mapInArrow(count, "slot int, sums binary").groupBy("slot")
    found = summed.applyInArrow(choose, "slot int, counts array<double>, drawn bigint, place int, bin int, to_left bigint").collect()
    held.unpersist()
    return found


# ------------------------------------------------------------------ growing
def one_forest(points: DataFrame, weights: np.ndarray, trees: int, seed: int, part_rows: int = PART_ROWS) -> DataFrame:
    """The nodes of ``trees`` trees over (capture, session_id, label, copies, bins)."""
    spark = points.sparkSession
    tries = -(-len(feature_columns()) // CANDIDATES)
    size = points.agg(F.count("*").alias("rows"), F.coalesce(F.sum("copies"), F.lit(0)).alias("copies")).first()
    blocks = packed_points(points, trees, seed, size["rows"])
    #: A tree's splits so far: (left, right, feature, bin) of its nodes, those without a child are open or closed.
    grown: list[list[list[int]]] = [[[-1, -1, 0, -1]] for _ in range(trees)]
    opened = [(tree, 0, ROOT, ROOT, 0, 0, size["copies"]) for tree in range(trees)]
    units, made = [], []
    while opened:
        units += [o for o in opened if o[-1] <= part_rows]
        large = [o for o in opened if o[-1] > part_rows]
        opened = []
        for at in range(0, len(large), PASS_NODES):
            group = large[at:at + PASS_NODES]
            tops = {}
            for slot, (tree, place, *_) in enumerate(group):
                if tree not in tops:
                    tops[tree] = np.array([(*n, -1) for n in grown[tree]], _TOP)
                tops[tree]["slot"][place] = slot
            features = np.array([candidates(candidate_order(tree, salt), attempt) for tree, _, _, salt, attempt, *_ in group])
            found = {r["slot"]: r for r in counted(blocks, tops, features, weights)}
            for slot, (tree, place, node, salt, attempt, depth, _) in enumerate(group):
                r = found.get(slot, {"counts": [0] * N, "drawn": 0, "place": None})
                counts, drawn = np.array([r["counts"]]), r["drawn"]
                over, own = bool(closed(counts, np.array([drawn]))[0]), grown[tree]
                if not over and r["place"] is not None:
                    feature, cut = int(features[slot, r["place"]]), r["bin"]
                    names = [child_name(node, feature, cut, side) for side in "lr"]
                    made.append((tree, node, NO_FOLD, depth, SPLIT, drawn, feature, cut, *names, *[None] * N))
                    own[place] = [len(own), len(own) + 1, feature, cut]
                    for name, rows in zip(names, (r["to_left"], drawn - r["to_left"])):
                        opened.append((tree, len(own), name, name, 0, depth + 1, rows))
                        own.append([-1, -1, 0, -1])
                elif not over and attempt + 1 < tries:
                    name = child_name(node, RETRY)
                    made.append((tree, node, NO_FOLD, depth, RETRY, drawn, None, None, name, None, *[None] * N))
                    own[place] = [len(own), len(own), 0, -1]
                    opened.append((tree, len(own), name, salt, attempt + 1, depth + 1, drawn))
                    own.append([-1, -1, 0, -1])
                else:
                    made.append((tree, node, NO_FOLD, depth, LEAF, drawn, None, None, None, None, *leaf_votes(counts, weights)[0].tolist()))
        opened.sort()       # a tree's slots are neighbours
    upper = [spark.createDataFrame(made, _NODE)] if made else []
    lower = [staged(finished(blocks, grown, units, weights, tries, part_rows), "finished")] if units else []
    discard(blocks)
    return reduce(DataFrame.unionByName, upper + lower)


def dealt(units: list[tuple], parts: int) -> list[int]:
    """A part for each unit, the largest units first, each to the part with the fewest rows."""
    load, part = [(0, p) for p in range(parts)], [0] * len(units)
    for i in sorted(range(len(units)), key=lambda i: -units[i][-1]):
        rows, part[i] = load[0]
        heapq.heapreplace(load, (rows + units[i][-1], part[i]))
    return part


def finished(blocks: DataFrame, grown: list[list[list[int]]], units: list[tuple], weights: np.ndarray, tries: int, part_rows: int) -> DataFrame:
    """Everything below ``units``: (tree, place, node, salt, attempt, depth, rows)."""
    spark = blocks.sparkSession
    parts = min(len(units), max(4 * spark.sparkContext.defaultParallelism, -(-sum(u[-1] for u in units) // part_rows)))
    part_of = np.array(dealt(units, parts), np.int32)
    tops: dict[int, np.ndarray] = {}
    for unit, (tree, place, *_) in enumerate(units):
        if tree not in tops:
            tops[tree] = np.array([(*n, -1) for n in grown[tree]], _TOP)
        tops[tree]["slot"][place] = unit
    held = spark.sparkContext.broadcast((tops, part_of))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, part_of = held.value
        names = [c.split()[0] for c in _PART.split(", ")]
        for batch in batches:
            for bins, label, w, cnt in unpacked(batch):
                out: list[tuple] = []
                for tree, top in tops.items():
                    at = np.flatnonzero(w[tree])
                    unit = top["slot"][walked(top, bins[at])]
                    at, unit = at[unit >= 0], unit[unit >= 0]
                    part = part_of[unit]
                    for p in np.unique(part):
                        mine, of = at[part == p], unit[part == p]
                        out.append((int(p), of.tobytes(), w.dtype.str, bins[mine].tobytes(), label[mine].tobytes(), w[tree][mine].tobytes(), cnt[tree][mine].tobytes()))
                    if len(out) >= 64:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=_PART_ARROW)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=_PART_ARROW)

    def finish(rows: pa.Table, opened: pa.Table) -> pa.Table:
        pieces = [p for b in rows.to_batches() for p in zip(unpacked(b), b.column("units").to_pylist())]
        stack = lambda parts, empty: np.concatenate(parts) if parts else empty
        bins = stack([p[0][0] for p in pieces], np.zeros((0, len(feature_columns())), np.uint8))
        label = stack([p[0][1] for p in pieces], np.zeros(0, np.uint8))
        w, cnt = (stack([p[0][i][0] for p in pieces], np.zeros(0)).astype(float) for i in (2, 3))
        unit = stack([np.frombuffer(p[1], np.int32) for p in pieces], np.zeros(0, np.int32))
        starts = opened.sort_by("unit").to_pydict()
        return below(bins, label, w, cnt, np.searchsorted(np.array(starts["unit"]), unit), starts, weights, tries)

    starts = spark.createDataFrame([(int(part_of[i]), i, tree, node, salt, attempt, depth) for i, (tree, _, node, salt, attempt, depth, _) in enumerate(units)],
                                   "part int, unit int, tree int, node string, salt string, attempt int, depth int")
    rows = blocks.mapInArrow(deal, _PART).repartition(parts, "part").groupBy("part")
    return rows.cogroup(starts.repartition(parts, "part").groupBy("part")).applyInArrow(finish, _NODE)


_PART_ARROW = pa.schema([("part", pa.int32()), ("units", pa.binary()), ("kind", pa.string()), *[(c, pa.binary()) for c in ("bins", "label", "w", "cnt")]])


def below(bins: np.ndarray, label: np.ndarray, w: np.ndarray, cnt: np.ndarray, slot: np.ndarray, starts: dict[str, list], weights: np.ndarray, tries: int) -> pa.Table:
    """All nodes from ``starts`` (lists of tree, node, salt, attempt, depth) down, level by level; ``slot`` is the start of each row."""
    width = bins.shape[1]
    flat, label = bins.ravel(), label.astype(np.int64)
    tree, names, salts, attempts, depth = (starts[c] for c in ("tree", "node", "salt", "attempt", "depth"))
    orders: list[list[int] | None] = [None] * len(names)
    at = np.argsort(slot, kind="stable")
    slot = slot[at]
    tables: list[pa.Table] = []
    while names:
        n = len(names)
        counts = np.bincount(slot * N + label[at], w[at], n * N).reshape(n, N)
        drawn = np.bincount(slot, cnt[at], n)
        inner = np.flatnonzero(~closed(counts, drawn))
        going = np.full(n, -1)
        going[inner] = np.arange(len(inner))
        slot = going[slot]
        at, slot = at[slot >= 0], slot[slot >= 0]
        for i in inner.tolist():
            orders[i] = orders[i] or candidate_order(tree[i], salts[i])
        features = np.array([candidates(orders[i], attempts[i]) for i in inner.tolist()], np.int64).reshape(-1, CANDIDATES)
        score, place, cut = rated(flat, width, label, w, cnt, at, slot, features, counts[inner], drawn[inner], weights)
        feature, found = features[np.arange(len(inner)), place], score > -np.inf

        kind = [LEAF] * n
        for i, split in zip(inner.tolist(), found.tolist()):
            kind[i] = SPLIT if split else RETRY if attempts[i] + 1 < tries else LEAF
        columns = {"feature": np.zeros(n, np.int32), "bin": np.zeros(n, np.int32)}
        columns["feature"][inner], columns["bin"][inner] = feature, cut
        left, right = [None] * n, [None] * n
        after: tuple[list, ...] = ([], [], [], [], [], [])      # tree, name, salt, attempt, depth, order
        base = np.full(len(inner), -1)
        for j, (i, f, c) in enumerate(zip(inner.tolist(), feature.tolist(), cut.tolist())):
            if kind[i] == SPLIT:
                base[j] = len(after[0])
                left[i], right[i] = child_name(names[i], f, c, "l"), child_name(names[i], f, c, "r")
                for name in (left[i], right[i]):
                    _append(after, tree[i], name, name, 0, depth[i] + 1, None)
            elif kind[i] == RETRY:
                base[j] = len(after[0])
                left[i] = child_name(names[i], RETRY)
                _append(after, tree[i], left[i], salts[i], attempts[i] + 1, depth[i] + 1, orders[i])
        votes, leaf, split = leaf_votes(counts, weights), *[np.array([k == own for k in kind]) for own in (LEAF, SPLIT)]
        tables.append(pa.table([
            pa.array(tree, pa.int32()), names, [NO_FOLD] * n, pa.array(depth, pa.int32()), kind, drawn.astype(np.int64), *[pa.array(columns[c], mask=~split) for c in ("feature", "bin")],
            pa.array(left, pa.string()), pa.array(right, pa.string()), *[pa.array(votes[:, i], mask=~leaf) for i in range(N)]], schema=_NODE_ARROW))
        if len(inner):
            to_right = found[slot] & (flat[at * width + feature[slot]] > cut[slot])
            slot = base[slot]
            at, slot = at[slot >= 0], (slot + to_right)[slot >= 0]
            order = np.argsort(slot, kind="stable")
            at, slot = at[order], slot[order]
        tree, names, salts, attempts, depth, orders = after
    return pa.concat_tables(tables)


def _append(lists: tuple[list, ...], *values) -> None:
    for own, value in zip(lists, values):
        own.append(value)


def rated(flat, width, label, w, cnt, at, slot, features, counts, drawn, weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, place and bin of the best split of each node; ``slot`` ascends."""
    found = []
    bounds = np.searchsorted(slot, np.arange(len(features) + 1))
    for low in range(0, len(features), RATED_NODES):
        high = min(len(features), low + RATED_NODES)
        rows = slice(bounds[low], bounds[high])
        own, here = slot[rows] - low, at[rows]
        cell = (own[:, None] * CANDIDATES + np.arange(CANDIDATES)) * BINS + flat[(here * width)[:, None] + features[slot[rows]]]
        there = np.zeros((high - low) * CELLS, bool)
        there[cell] = True
        ids = np.flatnonzero(there)
        number = np.empty(len(there), np.int32)
        number[ids] = np.arange(len(ids))
        cell = number[cell]
        by_class = np.bincount((cell * N + label[here][:, None]).ravel(), np.repeat(w[here], CANDIDATES), len(ids) * N).reshape(-1, N)
        by_row = np.bincount(cell.ravel(), np.repeat(cnt[here], CANDIDATES), len(ids))
        found.append(best_splits(ids, by_class, by_row, counts[low:high], drawn[low:high], weights)[:3])
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
