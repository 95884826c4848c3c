"""Texts that collide under every polynomial modulo 2**64 must not collide here."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sealcheck.llm import bytebpe, fingerprints, ngram_join, packing, quality_rules, textscan, unitmemo

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_hashes_differ_and_ignore_the_place(pair):
    scan = textscan.Scan([f"{a} x {b}".encode() for a, b in (pair, pair[::-1])])
    words = scan.word_hashes()
    assert len(set(words.tolist())) == 3 and words[0] == words[5] and words[2] == words[3]
    long = np.full(1 << 21, 2**31 - 2, np.uint32)
    assert textscan.PrefixHash(long).of(np.array([0, 5]), np.array([9, 14])).tolist()[0] == textscan.PrefixHash(long[:9]).of(np.array([0]), np.array([9]))[0]


def test_counts_and_sketches(pair):
    found = quality_rules.count_text([f"{pair[0]}\n{pair[1]}\n{pair[0]}".encode()])
    assert found["n_dup_lines"][0] == 1 and found["n_distinct_words"][0] == 2
    a, b = fingerprints.sketches([w.encode() for w in pair])
    assert a.tolist() != b.tolist()


def test_joined_documents(spark, pair):
    rows = [(i, w) for i, w in enumerate(pair)]
    found = ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {0: 0, 1: 1}


def test_ids(spark, pair):
    codec = bytebpe.codec(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert [i.tolist() for i in codec.encode([w.encode() for w in pair])] == [library.encode_ordinary(w) for w in pair]
    words = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.token_pieces(spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string"), words).collect()
    for i, word in enumerate(pair):
        own = b"".join(bytes(p["ids"]) for p in sorted(pieces, key=lambda p: p["piece"]) if p["doc_id"] == i)
        assert np.frombuffer(own, "<u4").tolist() == [*Tokenizer.from_file(words).encode(word, add_special_tokens=False).ids, 1]


def test_memo_compares_bytes():
    seen = []

    def encode(units):
        seen.extend(units)
        return np.array([x for u in units for x in u], np.uint32), np.array([len(u) for u in units], np.int64)

    memo = unitmemo.UnitMemo(encode, lower=True)
    data = np.frombuffer(b"abcABCabdxyzw", np.uint8)
    start, end = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 13])
    for _ in range(2):
        ids, sizes = memo.ids_of(np.full(4, 7, np.uint64), start, end, data)        # one hash for all
        assert bytes(ids.astype(np.uint8)) == b"abcabcabdxyzw" and sizes.tolist() == [3, 3, 3, 4]
    assert seen.count(b"abc") == 1
