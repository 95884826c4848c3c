import collections

import numpy as np
import pyarrow as pa
from helpers import ODD_TEXTS, WORD, shingles
from hypothesis import given, settings, strategies as st

from sealcheck.llm import quality_rules, textscan

TEXT = st.text(alphabet="ab AB\n\t\x0b#é", max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_words_and_shingle_sets(texts):
    scan = textscan.Scan([t.encode() for t in texts], lower=True)
    assert np.bincount(scan.doc, minlength=len(texts)).tolist() == [len(WORD.findall(t)) for t in texts]
    sets = scan.shingle_sets()
    for i, a in enumerate(texts):
        assert len(sets[i]) == len(shingles(a))
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(shingles(a) & shingles(b))


def counts(text):
    words = WORD.findall(text)
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_quality_counts(texts):
    found = quality_rules.count_text([t.encode() for t in texts])
    assert [[int(found[c][i]) for c in quality_rules.COUNTS[:5]] for i in range(len(texts))] == [counts(t) for t in texts]


def test_chunks_cover_every_row_once():
    rows = [t for t in ODD_TEXTS for _ in range(3)]
    found = [(first, len(texts)) for first, texts in textscan.chunked(pa.array(rows), 100)]
    assert sum(n for _, n in found) == len(rows) and [f for f, _ in found] == list(np.cumsum([0] + [n for _, n in found[:-1]]))
