"""Best-fit packing of token pieces into sequences by bin completion.

Texts are encoded, closed by an end id and cut at the capacity only where they are longer. Pieces are dealt by a hash into groups
of bounded size. In a group best-fit-decreasing gives the incumbent; where it misses the lower bound, branch and bound fills one
sequence after another around the largest piece left, tries the undominated fillings with the least waste first, and gives up a
branch when the waste so far leaves no room to beat the incumbent. The search ends at the bound, when all fillings are tried, or after a number of fillings that grows with the group, so
a packing is never worse than best fit. Groups are independent: at most one sequence per group is lost against one large packing.

Null and empty texts are the end id alone. Rows without an id, with the same id or with the same text are packed row by row.
"""

from __future__ import annotations

import functools
import itertools
import math
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from sealcheck.llm import common, textscan
from sealcheck.llm.unitmemo import UnitMemo

CAPACITY, END_ID = 4096, 1
#: Pieces of a group on average; fillings tried in a group, and more for each of its sequences.
GROUP_PIECES, NODES, NODES_PER_SEQUENCE = 20_000, 4_000, 4
#: Steps towards the next filling that count as one filling tried.
STEPS = 1024
#: Units handed to the tokenizer at once; the library keeps far more than the ids of each.
ENCODED_AT_ONCE = 8192
#: Bytes of text scanned at once; the arrays made beside them take many times as much.
CHUNK_BYTES = 1 << 18


@functools.lru_cache(maxsize=2)
def _memo(path: str) -> UnitMemo:
    from tokenizers import Tokenizer
    # a task has one core: the library's own threads would spend more on handing out short units than on encoding them
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for at in range(0, len(units), ENCODED_AT_ONCE):
            found = [e.ids for e in tokenizer.encode_batch_fast([u.decode() for u in units[at:at + ENCODED_AT_ONCE]], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    return UnitMemo(encode, lower=True)


def token_pieces(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids: little-endian unsigned 32-bit ids) of every text.

    The tokenizer has to lower-case texts and never join across white space, as the public word-level BPE does: words are
    encoded apart and once each.
    """
    def work(texts: list[bytes]) -> dict[str, list]:
        scan = textscan.Scan(texts, lower=True)
        ids, sizes = _memo(tokenizer_path).ids_of(scan.word_hashes(), scan.start, scan.end, scan.data)
        edge = np.concatenate([[0], np.cumsum(sizes)])[scan.first_word]
        out = []
        for i in range(scan.n):
            own = np.append(ids[edge[i]:edge[i + 1]], end_id).astype("<u4")
            out.append([own[a:a + capacity].tobytes() for a in range(0, len(own), capacity)])
        return {"pieces": out}

    found = common.map_texts(docs, text, [id_column], work, [T.StructField("pieces", T.ArrayType(T.BinaryType()))],
                             CHUNK_BYTES)
    rows = found.select(F.col(f"row.`{id_column}`").alias("doc_id"), F.posexplode("out.pieces").alias("piece", "ids"))
    return rows.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"),
                       (F.octet_length("ids") / 4).cast("long").alias("length"), "ids")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit-decreasing: lists of positions in ``lengths``, one per sequence."""
    order = np.argsort(-lengths, kind="stable")
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0                       # bit r is set where a sequence with room r is open
    bins: list[list[int]] = []
    for item in order.tolist():
        size = int(lengths[item])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            target = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, target = capacity, len(bins)
            bins.append([])
        bins[target].append(item)
        left = room - size
        if left:
            open_bins[left].append(target)
            rooms |= 1 << left
    return bins


def fillings(sizes: list[int], left: Counter, head: int, room: int, slack: int, shared: dict) -> Iterator[tuple[int, ...] | None]:
    """All undominated sets of pieces for the ``room`` beside ``head`` that waste at most ``slack``, least waste first, made as they are asked for.

    ``sizes`` lists the sizes left, descending; both they and ``left`` may change in between but are as they were at each call. A set
    is dominated where a piece left could still join it or take the place of a smaller one: the larger set wastes less, so it came
    before. Sums that the smaller sizes can reach are bits of a number, so no branch is entered that ends without a set. None stands
    for STEPS steps without one. ``shared`` keeps the sums of the search's latest level, others make them anew.
    """
    me, mask = object(), (1 << (room + 1)) - 1

    def free(size: int) -> int:
        return left[size] - (size == head)

    def table() -> tuple[list[tuple[int, int]], list[int]]:
        if shared.get("owner") is not me:
            own = [(s, free(s)) for s in sizes[_place(sizes, room):] if free(s)]
            sums = [1] * (len(own) + 1)
            for i in range(len(own) - 1, -1, -1):
                (size, n), bits, many = own[i], sums[i + 1], 1
                n = min(n, room // size)
                while n:
                    many = min(many, n)
                    bits |= bits << (size * many)
                    n, many = n - many, many * 2
                sums[i] = bits & mask
            shared.update(owner=me, own=own, sums=sums)
        return shared["own"], shared["sums"]

    def dominated(chosen: list[int], waste: int) -> bool:
        used = Counter(chosen)
        for low in {0, *chosen}:
            at = _place(sizes, low + waste)
            while at < len(sizes) and sizes[at] > low:
                if free(sizes[at]) > used[sizes[at]]:
                    return True
                at += 1
        return False

    # one piece or two that fill the room need no sums
    quick = set()
    if free(room) > 0:
        quick.add((room,))
        yield (room,)
    for size in sizes[_place(sizes, room - 1):]:
        other = room - size
        if other > size:
            break
        if free(size) > 0 and free(other) > (size == other):
            quick.add((size, other))
            yield (size, other)
            break
    target, steps = room, 0
    while target >= max(0, room - slack):
        own, sums = table()
        target = (sums[0] & ((1 << (target + 1)) - 1)).bit_length() - 1
        if target < room - slack:
            return
        todo: list = [(0, target, None)]        # place, sum to reach, pieces so far as a linked list
        while todo:
            steps += 1
            if steps % STEPS == 0:
                yield None
                own, sums = table()
            i, need, pieces = todo.pop()
            if need:
                size, n = own[i]
                todo += [(i + 1, need - c * size, (size, c, pieces) if c else pieces) for c in range(min(n, need // size) + 1)
                         if sums[i + 1] >> (need - c * size) & 1]
                continue
            chosen: list[int] = []
            while pieces:
                size, c, pieces = pieces
                chosen[:0] = [size] * c
            if tuple(chosen) not in quick and not (target < room and dominated(chosen, room - target)):
                yield tuple(chosen)
                own, sums = table()
        target -= 1


def complete_bins(lengths: np.ndarray, capacity: int, incumbent: int, nodes: int = NODES) -> list[list[int]] | None:
    """Sequences of sizes, fewer than ``incumbent``, or None where there are none or ``nodes`` fillings did not find them."""
    total, bound = int(lengths.sum()), math.ceil(int(lengths.sum()) / capacity)
    goal = incumbent - 1
    if goal < bound:
        return None
    allowed = goal * capacity - total
    left = Counter(lengths.tolist())
    sizes = sorted(left, reverse=True)
    placed: list[list[int]] = []
    stack: list[tuple[Iterator[tuple[int, ...] | None], int]] = []     # fillings not tried yet, waste before this sequence
    waste, shared = 0, {}

    def take(values, sign: int) -> None:
        for v in values:
            left[v] += sign
            if sign < 0 and not left[v]:
                at = _place(sizes, v)
                del sizes[at]
            elif sign > 0 and left[v] == 1:
                sizes.insert(_place(sizes, v), v)

    while sizes:
        head = sizes[0]
        stack.append((fillings(sizes, left, head, capacity - head, allowed - waste, shared), waste))
        while stack:
            options, before = stack[-1]
            if len(placed) == len(stack):       # undo what this level tried last
                take(placed.pop(), 1)
            if nodes <= 0:
                return None
            try:
                chosen = next(options)
            except StopIteration:
                stack.pop()
                continue
            nodes -= 1
            if chosen is None:
                continue
            placed.append([sizes[0], *chosen])
            take(placed[-1], -1)
            waste = before + capacity - sum(placed[-1])
            break
        if not stack:
            return None
    return placed


def _place(sizes: list[int], value: int) -> int:
    """First place of a descending list whose size is at most ``value``."""
    lo, hi = 0, len(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        if sizes[mid] > value:
            lo = mid + 1
        else:
            hi = mid
    return lo


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece of one group."""
    bins = best_fit(lengths, capacity)
    budget = nodes + NODES_PER_SEQUENCE * len(bins)
    while True:
        better = complete_bins(lengths, capacity, len(bins), budget)
        if better is None:
            break
        by_size: dict[int, list[int]] = {}
        for item, size in enumerate(lengths.tolist()):
            by_size.setdefault(size, []).append(item)
        bins = [[by_size[size].pop() for size in sequence] for sequence in better]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, items in enumerate(bins):
        at = 0
        for item in items:
            sequence[item], offset[item] = number, at
            at += int(lengths[item])
    return sequence, offset


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY,
         group_pieces: int = GROUP_PIECES, nodes: int = NODES, n_pieces: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths are 1 to ``capacity``. ``n_pieces`` saves a count where it is known."""
    n = pieces.count() if n_pieces is None else n_pieces
    groups = max(1, math.ceil(n / group_pieces))
    source = pieces.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    schema = T.StructType([*pieces.schema.fields, common.long_field("sequence_id"), common.long_field("offset")])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([length, *order], ascending=False, kind="stable")
        sequence, offset = pack_lengths(group[length].to_numpy(np.int64), capacity, nodes)
        out = group.assign(sequence_id=(group["_group"].to_numpy(np.int64) << 32) + sequence, offset=offset)
        return out[schema.names]

    return source.groupBy("_group").applyInPandas(run, schema)


def packed_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The pieces' digests and their places."""
    pieces = token_pieces(docs, tokenizer_path)
    with common.tidy_shuffles(docs.sparkSession):       # whole texts go to Python and their ids come back, a thousand documents at once
        narrow = common.stage(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(narrow)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packed_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
