"""Token counts of a sentence-piece BPE vocabulary by rank-synchronous array merging.

A text gets one space in front, as the library adds it, and is cut into pre-tokens where no piece of the vocabulary reaches across:
before white space here, and inside a pre-token between letters that stand side by side in no piece. Each distinct pre-token of a worker
is counted once. Its symbols lie in one ragged array with those of all others; every step finds the lowest rank of each sequence and
contracts all pairs of that rank at once, from the left. Where a pair made in the step ranks no higher, the step is done again with
the leftmost pair alone, so the result is that of contracting one pair after the other. What survives is counted, a letter outside
the vocabulary as its bytes.

Null and empty texts have no tokens. Special strings are ordinary text, as the library's default has it. Repeated rows, rows without
an id and texts of any length are counted row by row.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sealcheck.llm import common, textscan
from sealcheck.llm.unitmemo import UnitMemo

TOKEN_LIMIT = 4096
CHUNK_BYTES = 2 << 20
_SPACE, _MARK = ord(" "), 0x2581
_NO_RANK = np.int64(2**62)


class Counter:
    """Merge table of a vocabulary. ``pieces`` (text, score) are its ordinary ones, the mark U+2581 standing for a space."""

    def __init__(self, pieces: list[tuple[str, float]]):
        texts = [t.replace(chr(_MARK), " ") for t, _ in pieces]
        number = {t: i for i, t in enumerate(texts)}
        letters = sorted({c for t in texts for c in t})
        for c in letters:           # letters that only occur inside pieces are symbols too
            number.setdefault(c, len(number))
        #: Symbols of letters outside the vocabulary: one per length in bytes.
        self.unknown = len(number)
        self.of_letter = self.unknown + np.digitize(np.arange(0x110000), [0x80, 0x800, 0x10000]).astype(np.int32)
        self.of_letter[list(map(ord, letters))] = [number[c] for c in letters]
        self.weight = np.ones(self.unknown + 4, np.int64)
        self.weight[self.unknown:] = 1, 2, 3, 4
        for c in letters:
            if number[c] >= len(texts):
                self.weight[number[c]] = len(c.encode())
        # equal scores share a rank; the order among them is the place alone
        scores = sorted({s for _, s in pieces}, reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        pairs = {}
        for i, (text, (_, score)) in enumerate(zip(texts, pieces)):
            for cut in range(1, len(text)):
                left, right = number.get(text[:cut]), number.get(text[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank[score] << 32 | i
        self.pair = np.array(sorted(pairs), np.int64)
        self.into = np.array([pairs[p] for p in sorted(pairs)], np.int64)
        self.beside = np.unique(np.array([ord(a) << 32 | ord(b) for t in texts for a, b in zip(t, t[1:])], np.int64))
        #: No piece reaches from another letter across a space, so texts can be cut there.
        self.cut_at_space = not any(" " in t.lstrip(" ") for t in texts)
        self.long_run = self._long_run([t for t in texts if len(t) > 1 and " " in t], {t: rank[s] for t, (_, s) in zip(texts, pieces)}, len(scores))
        self.memo = UnitMemo(self._memo_counts)

    def _long_run(self, spaced: list[str], rank: dict[str, int], ranks: int) -> int:
        """Length of the spaces that become one token at the start of a long run of spaces and grow no further; 0 where that is not so."""
        runs = [t for t in spaced if not t.strip(" ")]
        if not self.cut_at_space or not runs or any(rank[t] < ranks - 1 for t in runs) or any(rank[t] == ranks - 1 for t in rank if t.strip(" ")):
            return 0
        period = max(map(len, runs))
        if any(t.startswith("  ") for t in spaced if t.strip(" ")):
            return 0
        counts, _ = self._contract([np.array([self.of_letter[_SPACE]] * n) for n in range(1, 4 * period)])
        return period if counts[period - 1] == 1 and (counts[period:] == counts[:-period] + 1).all() else 0

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | piece for each pair of symbols, or no rank."""
        if not len(self.pair):
            return np.full(len(left), _NO_RANK)
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        return np.where(self.pair[at] == wanted, self.into[at], _NO_RANK)

    def _contract(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, int]:
        """(tokens of each sequence, steps)."""
        size = np.fromiter(map(len, sequences), np.int64, len(sequences))
        symbol = np.concatenate(sequences).astype(np.int64) if len(sequences) else np.zeros(0, np.int64)
        return self.contract(symbol, size)

    def contract(self, symbol: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, int]:
        """The same for symbols end to end and the length of each sequence (at least 1)."""
        counts = np.zeros(len(size), np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        best = self._beside(symbol, owner)
        steps = 0
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            low = np.minimum.reduceat(best, first) >> 32
            dense = np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]]))
            done = low == _NO_RANK >> 32
            if done.any():
                over = done[dense]
                counts += np.bincount(owner[over], weights=self.weight[symbol[over]], minlength=len(size)).astype(np.int64)
                symbol, owner, best = symbol[~over], owner[~over], best[~over]
                continue
            steps += 1
            hit = best >> 32 == low[dense]
            take = self._apart(hit, owner)
            merged = self._merge(symbol, owner, best, take)
            again = self._too_early(merged, low, dense, take)
            if again is not None:
                firsts = take & (np.cumsum(take) - np.maximum.accumulate(np.where(np.concatenate([[True], owner[1:] != owner[:-1]]),
                                                                                  np.cumsum(take) - take, 0)) == 1)
                merged = self._merge(symbol, owner, best, np.where(again[dense], firsts, take))
            symbol, owner, best = merged[:3]
        return counts, steps

    def _beside(self, symbol: np.ndarray, owner: np.ndarray) -> np.ndarray:
        best = np.full(len(symbol), _NO_RANK)
        at = np.flatnonzero(owner[1:] == owner[:-1])
        best[at] = self._ranks(symbol[at], symbol[at + 1])
        return best

    @staticmethod
    def _apart(hit: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Of hits side by side, whose pairs overlap, every second from the left."""
        at = np.arange(len(hit))
        starts = hit & ~np.concatenate([[False], hit[:-1] & (owner[1:] == owner[:-1])])
        return hit & ((at - np.maximum.accumulate(np.where(starts, at, 0))) % 2 == 0)

    def _merge(self, symbol: np.ndarray, owner: np.ndarray, best: np.ndarray, take: np.ndarray):
        """(symbols, owners, ranks, places whose rank is new) after contracting the pairs at ``take``."""
        keep = np.concatenate([[True], ~take[:-1]])
        symbol = np.where(take, best & 0xFFFFFFFF, symbol)[keep]
        owner, best, changed = owner[keep], best[keep], take[keep]
        changed[:-1] |= changed[1:]
        new = np.flatnonzero(changed)
        best[new] = _NO_RANK
        pair = new[new < len(symbol) - 1]
        pair = pair[owner[pair] == owner[pair + 1]]
        best[pair] = self._ranks(symbol[pair], symbol[pair + 1])
        return symbol, owner, best, pair

    @staticmethod
    def _too_early(merged, low: np.ndarray, dense: np.ndarray, take: np.ndarray) -> np.ndarray | None:
        """Sequences that contracted several pairs though a new pair ranks no higher than those."""
        _, owner, best, pair = merged
        several = np.bincount(dense[take], minlength=len(low)) > 1
        own = np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]]))[pair]
        early = np.zeros(len(low), bool)
        early[own[best[pair] >> 32 <= low[own]]] = True
        early &= several
        return early if early.any() else None

    def count_units(self, units: list[bytes]) -> np.ndarray:
        """Tokens of each unit, a pre-token with a plain space for each mark."""
        extra = np.zeros(len(units), np.int64)
        if self.long_run:
            for i, unit in enumerate(units):
                run = len(unit) - len(unit.lstrip(b" "))
                if run > 4 * self.long_run:
                    extra[i] = run // self.long_run - 2
                    units[i] = unit[extra[i] * self.long_run:]
        letters = np.frombuffer(b"".join(u.decode().encode("utf-32-le") for u in units), np.uint32).astype(np.int64)
        size = np.fromiter((len(u.decode()) for u in units), np.int64, len(units))
        unit = np.repeat(np.arange(len(units)), size)
        wanted = letters[:-1] << 32 | letters[1:]
        at = np.minimum(np.searchsorted(self.beside, wanted), max(len(self.beside) - 1, 0))
        joined = (self.beside[at] == wanted if len(self.beside) else np.zeros(len(wanted), bool)) & (unit[1:] == unit[:-1])
        start = np.flatnonzero(np.concatenate([[True], ~joined]))
        counts, _ = self.contract(self.of_letter[letters].astype(np.int64), np.diff(np.append(start, len(letters))))
        return extra + np.bincount(unit[start], weights=counts, minlength=len(units)).astype(np.int64)

    def _memo_counts(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.count_units(units).astype(np.uint32), np.ones(len(units), np.int64)

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        mark = chr(_MARK).encode()
        shown = [b" " + t.replace(mark, b" ") if t else b"" for t in texts]
        scan = textscan.Scan(shown)
        edge = np.zeros(len(scan.data) + 1, bool)
        edge[scan.doc_start] = True
        if self.cut_at_space:
            space = scan.data == _SPACE
            edge[1:-1] |= space[1:] & ~space[:-1]
        start = np.flatnonzero(edge)[:-1]
        end = np.append(start[1:], len(scan.data))
        doc = scan.docs_of(start)
        end = np.minimum(end, scan.doc_start[doc + 1] - 1)
        some = end > start
        start, end, doc = start[some], end[some], doc[some]
        counts, _ = self.memo.ids_of(scan.hashes(start, end), start, end, scan.data)
        return np.bincount(doc, weights=counts, minlength=scan.n).astype(np.int64)


@functools.lru_cache(maxsize=2)
def counter(model_path: str) -> Counter:
    """The counter of a BPE model file with byte fallback and plain normalisation."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Counter(pieces)


def with_token_counts(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``out`` (n_bytes, n_tokens)."""
    def work(texts: list[bytes]) -> dict[str, list | np.ndarray]:
        return {"n_bytes": np.fromiter(map(len, texts), np.int64, len(texts)), "n_tokens": counter(model_path).count(texts)}
    return common.map_texts(docs, text, docs.columns if keep is None else keep, work, [common.long_field("n_bytes"), common.long_field("n_tokens")],
                            CHUNK_BYTES)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"]).select(
        "row.doc_id", "out.n_bytes", "out.n_tokens", (F.col("out.n_tokens") > TOKEN_LIMIT).alias("over_limit"))
