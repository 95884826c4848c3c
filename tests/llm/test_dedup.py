"""Line dedup and the n-gram join against brute force."""

import itertools
import random

from helpers import PROSE, SCHEMA, UPPER, empty_documents, odd_documents, shingles

from sealcheck.llm import line_dedup, ngram_join

SPACE = " \t\n\x0b\x0c\r"


def brute_lines(rows):
    first = {}
    key = lambda line: line.strip(SPACE).translate(UPPER)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), doc_id), doc_id)
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if doc_id is None or first.get(key(line), doc_id) >= doc_id]
        out[doc_id] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_line_dedup_over_many_batches(spark):
    docs = odd_documents(spark)
    want = brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    for batches, fanout in ((1, 3), (5, 2)):
        found = line_dedup.with_clean_text(docs, batches=batches, fanout=fanout)
        assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in found.select("row.doc_id", "out.*").collect()} == want
    assert line_dedup.with_clean_text(empty_documents(spark)).count() == 0


def test_runs_are_compacted_and_disjoint(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=2)
    for batch in range(5):
        runs.absorb(spark.createDataFrame([(batch, h, h) for h in range(batch, batch + 4)], "doc_id long, h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    rows = {r["h1"]: r["first_doc"] for r in runs.hashes().collect()}
    assert rows == {h: max(0, h - 3) for h in range(8)} and runs.hashes().count() == 8
    runs.drop()


def near_copies(seed):
    """Groups of near copies at similarities around the threshold, passages that many texts share, and short texts."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(4):
        base = [word() for _ in range(pick.choice([12, 60, 150]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(pick.randint(0, 5)):
                copy[pick.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(40)] + passage) for _ in range(30)]
    texts += ["one two three", "one two three four", "One Two Three", "a b c d e", "a b c d e f"]
    return texts


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            group[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_join_against_all_pairs(spark):
    rows = list(enumerate(near_copies(7)))
    docs = spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in rows], SCHEMA)
    want = brute_components(rows)
    for options in ({}, {"frequent_above": 2, "rounds": 3}, {"frequent_above": 3, "broadcast_tokens": 0, "rounds": 1}):
        found = ngram_join.join_documents(docs, **options)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == want, options


def test_signatures_meet_wherever_sets_link():
    """Without Spark: linked pairs always share a signature, whichever tokens are called frequent."""
    import numpy as np
    rng = np.random.default_rng(11)
    for _ in range(400):
        n = int(rng.integers(4, 120))
        base = rng.integers(1, 2**63, n, dtype=np.uint64)
        a, b = base.copy(), base.copy()
        for s in (a, b):
            for _ in range(int(rng.integers(0, n // 9 + 2))):
                s[rng.integers(n)] = rng.integers(1, 2**63)
        a, b = np.unique(a), np.unique(b[: len(b) - int(rng.integers(0, 3))])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            frequent = {int(t) for t in base[rng.random(n) < rng.random()]}
            flags = [np.array([int(t) in frequent for t in s], bool) for s in (a, b)]
            assert len(np.intersect1d(ngram_join.signatures(a, flags[0]), ngram_join.signatures(b, flags[1])))


def test_join_on_odd_rows(spark):
    docs = odd_documents(spark)
    found = {r["doc_id"]: r for r in ngram_join.join_documents(docs).collect()}
    assert found[0]["n_shingles"] == 0 and found[0]["component_id"] == 0 and found[1]["component_id"] == 1
    assert found[6]["component_id"] == found[7]["component_id"] == found[8]["component_id"] == 6 and found[None]["component_id"] is None
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and {7, 8}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert ngram_join.join_documents(empty_documents(spark)).count() == 0
    assert ngram_join.one_of_each(empty_documents(spark)).count() == 0
