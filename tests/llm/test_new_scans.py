"""Token counts against the library, periodic runs and fill-in-middle against brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import ODD_TEXTS, WORD, empty_documents, odd_documents
from hypothesis import given, settings, strategies as st

from sealcheck.llm import common, fill_middle, periodic_runs, registry, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = st.text(alphabet="  abthe\t\n▁.12é漢🙂<s>", max_size=60)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


# ------------------------------------------------------------------ token counts
@settings(max_examples=150, deadline=None)
@given(st.lists(LETTERS | st.text(alphabet="ab ", max_size=60), min_size=1, max_size=5))
def test_token_counts_are_the_library_ones(library, texts):
    assert token_counts.counter(MODEL).count([t.encode() for t in texts]).tolist() == [len(library.encode(t)) for t in texts]


def test_fixed_token_counts(library):
    texts = [" " * n for n in (1, 15, 16, 17, 63, 64, 65, 1000, 1001)] + ["x" + " " * 333 + "y", "a" * 3000, "ab" * 2000, "<s> </s> <unk>", "▁▁ ▁", "\x00", "the" * 999]
    assert token_counts.counter(MODEL).count([t.encode() for t in texts]).tolist() == [len(library.encode(t)) for t in texts]


def one_by_one(text, score):
    """Contract the best pair, the leftmost of equal ones, until none is left."""
    symbols = list(text)
    while True:
        pairs = [(-score[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in score]
        if not pairs:
            return len([s for s in symbols if s in score]) + sum(len(s.encode()) for s in symbols if s not in score)
        i = min(pairs)[1]
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=2, max_size=5), unique=True, max_size=14), st.lists(st.text(alphabet="abcd", min_size=1, max_size=25), min_size=1, max_size=4),
       st.randoms())
def test_any_order_of_ranks(pieces, texts, random):
    """Also vocabularies whose longer pieces rank before their parts, and equal ranks."""
    score = {p: float(random.randrange(6)) for p in [*pieces, "a", "b"]}
    found = token_counts.Counter(list(score.items())).count_units([t.encode() for t in texts])
    assert found.tolist() == [one_by_one(t, score) for t in texts]


def test_token_counts_of_odd_rows(spark, library):
    rows = token_counts.with_token_counts(odd_documents(spark), MODEL).select("row.doc_id", "row.row", "row.out", "out.n_tokens", "out.n_bytes").collect()
    assert len(rows) == len(ODD_TEXTS) + 1
    for r in rows:
        text = (ODD_TEXTS[r["doc_id"]] or "") if r["doc_id"] is not None else "a text without an id"
        assert (r["n_tokens"], r["n_bytes"]) == (len(library.encode(text)), len(text.encode()))
    assert token_counts.with_token_counts(empty_documents(spark), MODEL).count() == 0


def test_token_count_query(spark, small_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in common.table(spark, small_dir, "documents").collect()}
    rows = registry.QUERIES["op11_token_counts"](spark, small_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 4096, len(texts[r["doc_id"]].encode()))


# ------------------------------------------------------------------ periodic runs
def brute_runs(words):
    found = []
    for period in range(1, len(words) // 3 + 1):
        start = None
        for i in range(len(words) - period + 1):
            if i < len(words) - period and words[i] == words[i + period]:
                start = i if start is None else start
                continue
            if start is not None:
                run = words[start:i + period]
                smaller = any(run[d:] == run[:-d] for d in range(1, period))
                if len(run) >= max(24, 3 * period) and not smaller:
                    found.append((start, len(run), period))
            start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@st.composite
def repetitive(draw):
    words = draw(st.lists(st.sampled_from("abc"), max_size=40))
    for _ in range(draw(st.integers(0, 3))):
        base = draw(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=40))
        size, at = draw(st.integers(2 * len(base), 5 * len(base))), draw(st.integers(0, len(words)))
        words[at:at] = (base * 5)[:size]
    return words


@settings(max_examples=200, deadline=None)
@given(st.lists(repetitive(), min_size=1, max_size=4))
def test_runs_are_those_of_brute_force(texts):
    runs, kept = periodic_runs.scan([[w.encode() for w in t] for t in texts])
    for text, own, collapsed in zip(texts, runs, kept):
        want = brute_runs(text)
        assert [(r["start"], r["length"], r["period"]) for r in own] == want and collapsed.decode() == collapse(text, want)


def test_long_runs():
    random = np.random.default_rng(5)
    for period in (8, 9, 12, 13, 100, 333, 5000):
        base = [b"w%d" % i for i in random.permutation(period)]
        text = [b"x", b"y"] + (base * 4)[:3 * period + period // 2 + 24] + [b"z"] * 5
        runs, _ = periodic_runs.scan([text, text[::-1], []])
        size = max(3 * period + period // 2 + 24, 0) if period > 34 else min(4 * period, 3 * period + period // 2 + 24)
        want = [{"start": 2, "length": size, "period": period}] if size >= max(24, 3 * period) else []
        assert runs[0] == want and len(runs[1]) == len(want) and runs[2] == []
    assert periodic_runs.scan([])[0] == [] and periodic_runs.scan([[b"a"] * 24])[0] == [[{"start": 0, "length": 24, "period": 1}]]


def test_equal_hashes_are_compared_by_word(monkeypatch):
    monkeypatch.setattr(periodic_runs.textscan.PrefixHash, "of", lambda self, start, end: (np.asarray(end) - start).astype(np.uint64))
    base = [b"w%d" % i for i in range(10)]
    text = [b"p", b"q", b"r"] + base * 4
    runs, _ = periodic_runs.scan([text])
    assert all(text[r["start"]:r["start"] + r["length"] - r["period"]] == text[r["start"] + r["period"]:r["start"] + r["length"]] for r in runs[0])


def test_runs_of_odd_rows(spark):
    rows = periodic_runs.with_runs(odd_documents(spark)).select("row.doc_id", "row.out", "out.runs", "out.collapsed").collect()
    assert len(rows) == len(ODD_TEXTS) + 1
    for r in rows:
        words = WORD.findall((ODD_TEXTS[r["doc_id"]] or "") if r["doc_id"] is not None else "a text without an id")
        own = [tuple(x) for x in r["runs"]]
        if len(words) < 1000:
            assert own == brute_runs(words)
        assert r["collapsed"] == collapse(words, own)
    assert any(len(r["runs"]) for r in rows) and periodic_runs.with_runs(empty_documents(spark)).count() == 0


def test_periodic_run_query(spark, small_dir):
    docs = {r["doc_id"]: WORD.findall(r["text"] or "") for r in common.table(spark, small_dir, "documents").collect()}
    rows = registry.QUERIES["op12_periodic_runs"](spark, small_dir).collect()
    assert len(rows) == len(docs) and any(r["n_runs"] for r in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        words, h = docs[r["doc_id"]], zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        if n > 1500:
            continue
        runs = brute_runs(words)
        best = max(runs, key=lambda x: (x[1] * 10**9 // x[2], -x[0], -x[2]), default=(None, None, None))
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join("%d,%d,%d\n" % x for x in runs)) and r["collapsed_sha256"] == sha(collapse(words, runs))


# ------------------------------------------------------------------ fill in the middle
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_form(text, draw):
    tokens = TOKEN.findall(text)
    a, b = sorted(h % (len(tokens) + 1) for h in draw[:2])
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or draw[2] % 100 >= 50:
        return len(tokens), "plain", text, None, None
    if draw[3] % 100 < 80:
        return len(tokens), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return len(tokens), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab \n\té漢🙂<P>\xa0", max_size=40), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4)), min_size=1, max_size=6))
def test_forms_are_those_of_brute_force(cases):
    texts = [t.encode() for t, _ in cases]
    found = fill_middle.transform(texts, [d for _, d in cases])
    for i, (text, draw) in enumerate(cases):
        own = tuple(found[k][i] for k in ("n", "form", "output", "prefix_chars", "middle_chars"))
        assert (*own[:2], own[2].decode(), *own[3:]) == brute_form(text, draw)
        assert fill_middle.restore(found["output"][i], found["form"][i]) == texts[i]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), min_size=1, max_size=300))
def test_ranks(symbols):
    matrix, values = fill_middle.WaveletMatrix(np.array(symbols, np.uint8), 3), np.array(symbols)
    at = np.arange(len(symbols) + 1)
    for s in range(8):
        want = np.concatenate([[0], np.cumsum(values == s)])
        assert matrix.rank(s, at).tolist() == want.tolist()
    both = np.concatenate([[0], np.cumsum((values == 3) | (values == 6))])
    count = np.arange(both[-1] + 1)
    assert matrix.first_with((3, 6), count).tolist() == np.searchsorted(both, count).tolist()


def test_forms_of_odd_rows(spark):
    rows = fill_middle.with_forms(odd_documents(spark), rate=100).select("row.doc_id", "row.out", "out.*").collect()
    assert len(rows) == len(ODD_TEXTS) + 1
    for r in rows:
        text = (ODD_TEXTS[r["doc_id"]] or "") if r["doc_id"] is not None else "a text without an id"
        assert r["restored"] == text and r["n"] == len(TOKEN.findall(text))
        assert r["form"] == "plain" if not text or r["doc_id"] is None else r["form"] in ("psm", "spm")
    assert fill_middle.with_forms(empty_documents(spark)).count() == 0
