"""Byte-level BPE encoding and decoding by DuckDB inside each partition.

Texts are cut into units before white space and between ASCII letters and punctuation, where the split pattern always cuts too, and
every distinct unit of a worker is split and encoded once. A recursive query holds a row per (word, position); each step joins neighbouring
positions with the merge table, finds each word's leftmost pair of minimum rank and contracts it, until no word has a pair left.
Decoding joins token rows with the vocabulary and aggregates them in order.

Null is the empty text, which has no ids and decodes to no bytes. No special tokens exist: their strings are ordinary text.
Pieces over ``LONG_PIECE`` bytes, whose rows would be read once per merge, are contracted with a heap instead, to the same ids.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sealcheck.llm import common, textscan
from sealcheck.llm.unitmemo import UnitMemo, ragged

CHUNK_BYTES = 1 << 20
#: Bytes of pieces in one recursive query, token rows in one decoding query.
QUERY_BYTES, QUERY_TOKENS = 384 << 10, 512 << 10
LONG_PIECE = 256
#: Distinct units a worker remembers.
MEMO_UNITS = 1_500_000
#: White space beyond ASCII, in UTF-8: such texts are one unit.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_LETTER, _PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION[33:48] = _PUNCTUATION[58:65] = _PUNCTUATION[91:97] = _PUNCTUATION[123:127] = True

#: One step: `hit` has each word's lowest (rank, position), `after` adds what follows the pair. Positions stay gapless, so a row
#: knows its right neighbour's id and no sort is needed.
_CONTRACT = """
WITH RECURSIVE state(step, word, pos, id, next_id) AS (
  SELECT 0, word, pos, id, next_id FROM letters
  UNION ALL
  SELECT * FROM (
    WITH hit AS (
      SELECT word, min(rank * 1048576 + pos) AS best FROM state JOIN merges ON pair = id::BIGINT * 4294967296 + next_id GROUP BY word),
    after AS (
      SELECT hit.word AS w, (best & 1048575)::INT AS place, (best >> 20)::INT AS merged, state.next_id AS following
      FROM hit JOIN state ON state.word = hit.word AND state.pos = (best & 1048575)::INT + 1)
    SELECT step + 1, word, CASE WHEN pos > place THEN pos - 1 ELSE pos END, CASE WHEN pos = place THEN merged ELSE id END,
           CASE WHEN pos = place THEN following WHEN pos = place - 1 THEN merged ELSE next_id END
    FROM state JOIN after ON word = w WHERE pos <> place + 1)
)
SELECT word, pos, id FROM state QUALIFY step = max(step) OVER (PARTITION BY word) ORDER BY word, pos
"""
_DECODE = "SELECT doc, string_agg(bytes, '' ORDER BY pos) AS text FROM tokens JOIN vocabulary USING (id) GROUP BY doc"


class Codec:
    """Vocabulary and merge table of a rank file, in a DuckDB database of this process."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex
        with open(ranks_path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        keys = np.array(list(self.pairs), np.int64).reshape(-1, 2)
        self._table("merge_rows", {"pair": keys[:, 0] * 2**32 + keys[:, 1], "rank": np.array(list(self.pairs.values()), np.int64)})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        # a character per byte, so that any bytes can be text inside the database
        self._table("vocabulary_rows", {"id": pa.array(list(self.ranks.values()), pa.int64()),
                                        "bytes": pa.array([t.decode("latin-1") for t in self.ranks])})
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_rows")
        self.memo = UnitMemo(self.encode_units, MEMO_UNITS)

    def _table(self, name: str, columns: dict) -> None:
        self.db.register(name, pa.table(columns))

    def contract(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids per piece) of distinct pieces, by the recursive query."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), length)
        pos = ragged(np.zeros(len(pieces), np.int64), length).astype(np.int32)
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        last = np.append(word[1:] != word[:-1], True)
        self._table("letters", {"word": word, "pos": pos, "id": ids, "next_id": pa.array(np.append(ids[1:], 0), mask=last)})
        found = self.db.sql(_CONTRACT).to_arrow_table()
        return found["id"].to_numpy().astype(np.uint32), np.bincount(found["word"].to_numpy(), minlength=len(pieces))

    def contract_long(self, piece: bytes) -> list[int]:
        """The same for one long piece: a heap of pairs by (rank, position)."""
        ids, after = [int(self.of_byte[b]) for b in piece], list(range(1, len(piece) + 1))
        before, alive = list(range(-1, len(piece) - 1)), [True] * len(piece)
        heap = [(self.pairs[p], i, *p) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j == len(ids) or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (ids[a], ids[b]) in self.pairs:
                    heapq.heappush(heap, (self.pairs[ids[a], ids[b]], a, ids[a], ids[b]))
        return [x for x, keep in zip(ids, alive) if keep]

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        use: list[int] = []
        per_unit = np.zeros(len(units), np.int64)
        for i, unit in enumerate(units):
            pieces = self.pattern.findall(unit.decode())
            per_unit[i] = len(pieces)
            use += [number.setdefault(p, len(number)) for p in pieces]
        distinct = [p.encode() for p in number]
        done: dict[int, list[int]] = {}
        todo: list[int] = []
        for i, piece in enumerate(distinct):
            known = self.ranks.get(piece)
            if known is not None:
                done[i] = [known]
            elif len(piece) > LONG_PIECE:
                done[i] = self.contract_long(piece)
            else:
                todo.append(i)
        size = np.zeros(len(distinct), np.int64)
        parts, at, used = [], np.zeros(len(distinct), np.int64), 0
        for i, ids in done.items():
            size[i], at[i] = len(ids), used
            parts.append(np.array(ids, np.uint32))
            used += len(ids)
        held, block = 0, []
        for k, i in enumerate(todo):
            block.append(i)
            held += len(distinct[i])
            if held >= QUERY_BYTES or k == len(todo) - 1:
                ids, sizes = self.contract([distinct[j] for j in block])
                size[block] = sizes
                at[block] = used + np.cumsum(sizes) - sizes
                parts.append(ids)
                used += len(ids)
                held, block = 0, []
        pool = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        use_at = np.array(use, np.int64)
        counts = size[use_at] if len(use_at) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(counts)])
        edge = np.concatenate([[0], np.cumsum(per_unit)])
        return pool[ragged(at[use_at], counts)] if len(use_at) else pool[:0], total[edge[1:]] - total[edge[:-1]]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        scan = textscan.Scan(texts)
        stop = scan.doc_start[1:] - 1
        # the split pattern never joins a word and the white space after it, nor ASCII letters and the punctuation after them
        cuts = np.flatnonzero(_LETTER[scan.data[:-1]] & _PUNCTUATION[scan.data[1:]]) + 1
        edges = np.union1d(np.concatenate([scan.end, cuts]), np.concatenate([scan.doc_start, stop]))
        starts, ends = edges[:-1], edges[1:]
        docs = scan.docs_of(starts)
        wide = np.array([bool(_WIDE_SPACE.search(t)) for t in texts])
        stays = (starts < stop[docs]) & ~wide[docs]
        whole = np.flatnonzero(wide)
        starts, ends = np.concatenate([starts[stays], scan.doc_start[whole]]), np.concatenate([ends[stays], stop[whole]])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        ids, sizes = self.memo.ids_of(scan.hashes(starts, ends), starts, ends, scan.data)
        edge = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, scan.doc_start)]
        return [ids[edge[i]:edge[i + 1]] for i in range(scan.n)]

    def decode(self, texts: list[np.ndarray]) -> list[bytes]:
        """Bytes of each text's ids."""
        out: list[bytes] = [b""] * len(texts)
        first = 0
        while first < len(texts):
            last, held = first, 0
            while last < len(texts) and (last == first or held + len(texts[last]) <= QUERY_TOKENS):
                held += len(texts[last])
                last += 1
            sizes = np.fromiter(map(len, texts[first:last]), np.int64, last - first)
            if held:
                self._table("tokens", {"doc": np.repeat(np.arange(first, last), sizes), "pos": np.arange(held),
                                       "id": np.concatenate(texts[first:last]).astype(np.int64)})
                found = self.db.sql(_DECODE).to_arrow_table()
                for doc, text in zip(found["doc"].to_pylist(), found["text"].to_pylist()):
                    out[doc] = text.encode("latin-1")
            first = last
        return out


@functools.lru_cache(maxsize=1)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``out.ids``: little-endian unsigned 32-bit ids."""
    def work(texts: list[bytes]) -> dict[str, list]:
        return {"ids": [ids.astype("<u4").tobytes() for ids in codec(ranks_path, pattern).encode(texts)]}
    return common.map_texts(docs, text, docs.columns if keep is None else keep, work, [T.StructField("ids", T.BinaryType())], CHUNK_BYTES)


def decoded(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``out.bytes`` of binary ids."""
    def work(texts: list[bytes]) -> dict[str, list]:
        return {"bytes": codec(ranks_path, pattern).decode([np.frombuffer(t, "<u4") for t in texts])}
    return common.map_texts(rows, ids, rows.columns if keep is None else keep, work, [T.StructField("bytes", T.BinaryType())], CHUNK_BYTES)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row``, ``out.ids`` and ``out.bytes``: both of the above in one worker, which then holds one codec."""
    def work(texts: list[bytes]) -> dict[str, list]:
        own = codec(ranks_path, pattern)
        ids = own.encode(texts)
        return {"ids": [i.astype("<u4").tobytes() for i in ids], "bytes": own.decode(ids)}
    fields = [T.StructField("ids", T.BinaryType()), T.StructField("bytes", T.BinaryType())]
    return common.map_texts(docs, text, docs.columns if keep is None else keep, work, fields, CHUNK_BYTES)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    both = round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
    return both.select("row.doc_id", (F.octet_length("out.ids") / 4).cast("long").alias("n_tokens"), F.sha2("out.ids", 256).alias("ids_sha256"),
                       F.sha2("out.bytes", 256).alias("decoded_sha256"))
