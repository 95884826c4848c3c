"""Byte-level BPE against the public library, packing against its rules."""

import os
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers import ODD_TEXTS, empty_documents, odd_documents
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sealcheck.llm import bytebpe, packing, textscan

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["  a  b\n\nc  ", "foo\xa0  bar　x", " \n ", "it's we'll 123 4567!!  ...", "\x1c a\x1cb", "x" * 700 + " " + "zq" * 300, "漢字 🙂🙂 é, è.",
         "a\tb \t c", "<|endoftext|> <|startoftext|>x", "a,b;c 'tis he'd'S"]


@pytest.fixture(scope="module")
def codec():
    return bytebpe.codec(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=80, deadline=None)
@given(texts=st.lists(st.text(max_size=40) | st.text(alphabet="ab'st \n\xa0.,1", max_size=40), min_size=1, max_size=4))
def test_same_ids_as_the_library(codec, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids = codec.encode([t.encode() for t in texts])
    assert [i.tolist() for i in ids] == [library.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def test_fixed_cases_and_long_pieces(codec, library):
    assert [i.tolist() for i in codec.encode([t.encode() for t in TEXTS])] == [library.encode_ordinary(t) for t in TEXTS]
    word = b"abcabcab" * 20
    assert codec.contract([word])[0].tolist() == codec.contract_long(word)


def test_round_trip_in_spark(spark):
    docs = odd_documents(spark)
    ids = bytebpe.encoded(docs, RANKS, public_tokenizers.PATTERN, keep=["doc_id"]).select("row.doc_id", "out.ids")
    back = bytebpe.decoded(ids, RANKS, public_tokenizers.PATTERN, keep=["doc_id"]).select("row.doc_id", "out.bytes")
    found = {r["doc_id"]: bytes(r["bytes"]).decode() for r in back.collect()}
    assert all(found[i] == (t or "") for i, t in enumerate(ODD_TEXTS)) and len(found) == len(ODD_TEXTS) + 1
    assert bytebpe.encoded(empty_documents(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_pieces_are_the_library_ids(spark):
    texts = [*ODD_TEXTS, *TEXTS]
    tokenizer = Tokenizer.from_file(WORDS)
    pieces = packing.token_pieces(odd_documents(spark, texts), WORDS).orderBy("doc_id", "piece").collect()
    for i, text in enumerate(texts):
        own = b"".join(bytes(p["ids"]) for p in pieces if p["doc_id"] == i)
        assert np.frombuffer(own, "<u4").tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    assert all(p["length"] == packing.CAPACITY for p in pieces if (p["doc_id"], p["piece"] + 1) in {(q["doc_id"], q["piece"]) for q in pieces})


def valid(lengths, sequence, offset, capacity):
    for s in set(sequence.tolist()):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own], kind="stable")]
        assert offset[own].tolist() == (np.cumsum(lengths[own]) - lengths[own]).tolist() and lengths[own].sum() <= capacity
    return len(set(sequence.tolist()))


def test_bin_completion_beats_best_fit():
    lengths = np.array([8, 7, 6, 5, 4, 4, 3, 3, 2, 2, 1, 5, 5, 5] * 2) * 100
    assert len(packing.best_fit(np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6]), 61)) == 4
    # best fit decreasing needs 4 sequences here, an exact packing needs 3
    hard = np.array([51, 27, 26, 23, 23, 24, 28, 48, 50])
    best = len(packing.best_fit(hard, 100))
    sequence, offset = packing.pack_lengths(hard, 100)
    assert best == 4 and valid(hard, sequence, offset, 100) == 3
    sequence, offset = packing.pack_lengths(lengths, 1000)
    assert valid(lengths, sequence, offset, 1000) == -(-lengths.sum() // 1000)


def fewest(lengths, capacity):
    """Exact number of sequences: per set of pieces, the fewest sequences and the least use of the last one."""
    best = [(1, 0)] + [(99, 0)] * (2 ** len(lengths) - 1)
    for chosen in range(1, 2 ** len(lengths)):
        for i, size in enumerate(lengths):
            if chosen >> i & 1:
                n, used = best[chosen ^ 1 << i]
                best[chosen] = min(best[chosen], (n, used + size) if used + size <= capacity else (n + 1, size))
    return best[-1][0]


def test_search_tries_every_filling():
    hard = np.array([500, 480, 470, 377, 333, 203, 187, 161, 153, 136])
    sequence, offset = packing.pack_lengths(hard, 1000)
    assert len(packing.best_fit(hard, 1000)) == 4 and valid(hard, sequence, offset, 1000) == 3
    random = np.random.default_rng(7)
    for _ in range(60):
        lengths = random.integers(60, 420, 10)
        sequence, offset = packing.pack_lengths(lengths, 600)
        assert valid(lengths, sequence, offset, 600) == fewest(lengths.tolist(), 600), lengths


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40))
def test_any_packing_is_valid(values):
    lengths = np.array(values)
    sequence, offset = packing.pack_lengths(lengths, 50, 300)
    assert valid(lengths, sequence, offset, 50) <= len(packing.best_fit(lengths, 50))


def test_packed_documents(spark):
    docs = odd_documents(spark)
    rows = packing.packed_documents(docs, WORDS).toPandas()
    pieces = packing.token_pieces(docs, WORDS).select("doc_id", "piece", F.col("ids")).collect()
    assert sorted(rows["ids_crc32"]) == sorted(zlib.crc32(bytes(p["ids"])) for p in pieces)
    valid(rows["length"].to_numpy(), rows["sequence_id"].to_numpy(), rows["offset"].to_numpy(), packing.CAPACITY)
    assert packing.packed_documents(empty_documents(spark), WORDS).count() == 0


def test_packing_hands_bounded_batches_to_python_and_to_the_tokenizer(spark, monkeypatch):
    import public_tokenizers
    import tokenizers

    from sealcheck.llm import common, packing

    seen, stage = [], common.stage
    monkeypatch.setattr(common, "stage", lambda df, name: (seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), stage(df, name))[1])
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 2
    assert seen == ["1000"]

    real, calls = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []

    class Counted:
        from_file = staticmethod(lambda path: Counted())

        def encode_batch_fast(self, units, **options):
            calls.append(len(units))
            return real.encode_batch_fast(units, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    units = [f"unit{i}".encode() for i in range(packing.ENCODED_AT_ONCE + 5)]
    ids, sizes = packing._memo.__wrapped__(public_tokenizers.path("word_bpe_49k.json")).encode(units)
    assert calls == [packing.ENCODED_AT_ONCE, 5]
    whole = [e.ids for e in real.encode_batch([u.decode() for u in units], add_special_tokens=False)]
    assert ids.tolist() == [i for one in whole for i in one] and sizes.tolist() == [len(one) for one in whole]


def test_the_tokenizer_starts_no_threads_of_its_own():
    program = """if True:
        import os, sys
        from sealcheck.llm import packing
        memo = packing._memo(sys.argv[1])
        before = len(os.listdir("/proc/self/task"))
        memo.encode([f"unit{i}".encode() for i in range(2000)])
        print(len(os.listdir("/proc/self/task")) - before)
    """
    plain = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")}
    found = subprocess.run([sys.executable, "-c", program, WORDS], env=plain, cwd=Path(packing.__file__).parents[2], capture_output=True, text=True, timeout=120)
    assert found.stdout.strip() == "0", found.stdout + found.stderr


def test_many_texts_are_scanned_a_little_at_a_time(spark, monkeypatch):
    from sealcheck.llm import common

    scan = textscan.Scan
    real, works, scanned = common.map_texts, [], []
    monkeypatch.setattr(common, "map_texts", lambda docs, text, keep, work, fields, *chunk: (works.append((work, chunk)), real(docs, text, keep, work, fields, *chunk))[1])
    packing.token_pieces(odd_documents(spark), WORDS)
    monkeypatch.setattr(packing.textscan, "Scan", lambda texts, **options: (scanned.append(sum(map(len, texts))), scan(texts, **options))[1])
    texts = pa.array(["some words of a text " * 500] * 100)
    (work, chunk), = works
    found = [p for _, part in textscan.chunked(texts, *chunk) for p in work(part)["pieces"]]
    assert max(scanned) <= 1 << 18 and sum(scanned) == 100 * 500 * 21 and found == [found[0]] * 100
