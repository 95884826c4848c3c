"""Fill-in-the-middle texts, cut at token boundaries that a wavelet matrix over character classes locates.

Each byte has a class of three bits: word or white space, last byte of a word, first byte of a code point. The matrix answers how
many bytes of a class lie before a place. Ranks of the two classes that end a word add up to the boundaries before a place, those of
the three that begin a code point to the characters; bisection on the boundary count finds both cuts of all texts at once.

A token is white space with the word behind it, or white space at the end. Null and empty texts have no tokens and stay plain, as
does a text that holds a marker and a row without an id. Repeated rows and texts of any length are treated row by row. Columns of
the input sit in ``row`` and clash with nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sealcheck.llm import common, textscan

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of texts that are transformed, and of those the percent that begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80
SEED = "42"
#: Classes by what their bits say: 4 word, 2 last byte of a word, 1 first byte of a code point.
ENDS, BEGINS = (6, 7), (1, 5, 7)


class WaveletMatrix:
    """Symbols of ``bits`` bits; level by level those with a zero bit go before those with a one."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self.levels = len(symbols), []
        for bit in range(bits - 1, -1, -1):
            ones = symbols >> bit & 1
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(self.size // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((bit, words, before, self.size - int(before[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are ``symbol``."""
        low, high = np.zeros_like(at), at
        for bit, words, before, zeros in self.levels:
            ones_low, ones_high = _ones(words, before, low), _ones(words, before, high)
            if symbol >> bit & 1:
                low, high = zeros + ones_low, zeros + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return high - low

    def ranks(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(symbol, at) for symbol in symbols)

    def first_with(self, symbols: tuple[int, ...], count: np.ndarray) -> np.ndarray:
        """The shortest start of the sequence that holds ``count`` of the symbols, by bisection; the whole where none does."""
        low, high = np.zeros_like(count), np.full_like(count, self.size)
        for _ in range(self.size.bit_length()):
            middle = (low + high) // 2
            enough = self.ranks(symbols, middle) >= count
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return low


def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    block, bit = at >> 6, (at & 63).astype(np.uint64)
    return before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << bit) - np.uint64(1)))


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte; the last one is taken to be white space."""
    word = ~textscan.SPACE[data]
    ends = word & np.append(~word[1:], True)
    begins = (data & 0xC0) != 0x80
    return word * np.uint8(4) + ends * np.uint8(2) + begins * np.uint8(1)


class Cutter:
    """Token boundaries of some texts."""

    def __init__(self, texts: list[bytes]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(lengths + 1) - lengths - 1
        self.end = self.start + lengths
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.matrix = WaveletMatrix(classes(data), 3)
        self.before = self.matrix.ranks(ENDS, self.start)
        self.words = self.matrix.ranks(ENDS, self.end) - self.before
        #: A text that ends in white space has a token more than it has words.
        self.tokens = self.words + ((lengths > 0) & textscan.SPACE[data[self.end - 1]])

    def place(self, count: np.ndarray) -> np.ndarray:
        """Where each text's first ``count`` tokens end, from the start of the text."""
        at = self.matrix.first_with(ENDS, self.before + count)
        return np.where(count == 0, self.start, np.where(count > self.words, self.end, at)) - self.start

    def characters(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code points between two places of each text."""
        return self.matrix.ranks(BEGINS, self.start + end) - self.matrix.ranks(BEGINS, self.start + start)


def restore(output: bytes, form: str | None) -> bytes:
    """The text that became ``output``."""
    if form == "psm":
        prefix, rest = output[len(PREFIX):].split(SUFFIX)
        suffix, middle = rest.split(MIDDLE)
    elif form == "spm":
        suffix, rest = output[len(SUFFIX):].split(PREFIX)
        prefix, middle = rest.split(MIDDLE)
    else:
        return output
    return prefix + middle + suffix


def transform(texts: list[bytes], draws: list[list[int] | None], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> dict[str, list]:
    """Form, output, tokens and characters of prefix and middle; ``draws`` are four numbers per text, or None for a plain one."""
    cutter = Cutter(texts)
    n = cutter.tokens
    h = np.array([d or [0, 0, 100, 0] for d in draws], np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
    first, second = cutter.place(cuts[:, 0]), cutter.place(cuts[:, 1])
    in_prefix, in_middle = cutter.characters(np.zeros_like(first), first), cutter.characters(first, second)
    out: dict[str, list] = {"n": n.tolist(), "form": [], "output": [], "prefix_chars": [], "middle_chars": []}
    for i, (text, draw, a, b) in enumerate(zip(texts, draws, first.tolist(), second.tolist())):
        plain = not text or draw is None or draw[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
        form = "plain" if plain else "spm" if draw[3] % 100 < suffix_first else "psm"
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        out["form"].append(form)
        out["output"].append(text if plain else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle if form == "psm"
                             else SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle)
        out["prefix_chars"].append(None if plain else int(in_prefix[i]))
        out["middle_chars"].append(None if plain else int(in_middle[i]))
    return out


def draw_columns(id_column: str, seed: str = SEED) -> Column:
    """Four numbers per row from the digest of seed and id; null without an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_column}`").cast("string")), 256)
    numbers = F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])
    return F.when(F.col(f"`{id_column}`").isNotNull(), numbers)


def with_forms(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep: list[str] | None = None, rate: int = RATE,
               suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """Columns ``row`` and ``out``: n (tokens), form, output, restored, prefix_chars, middle_chars."""
    def work(texts: list[bytes], draws: list[list[int] | None]) -> dict[str, list]:
        found = transform(texts, draws, rate, suffix_first)
        found["restored"] = [restore(o, f) for o, f in zip(found["output"], found["form"])]
        return {k: [v.decode() for v in vs] if k in ("output", "restored") else vs for k, vs in found.items()}

    fields = [common.long_field("n"), T.StructField("form", T.StringType()), T.StructField("output", T.StringType()),
              T.StructField("restored", T.StringType()), common.long_field("prefix_chars"), common.long_field("middle_chars")]
    return common.map_texts(docs, text, docs.columns if keep is None else keep, work, fields, inputs=(draw_columns(id_column, seed),))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_forms(docs, keep=["doc_id"]).select(
        "row.doc_id", "out.n", "out.form", "out.prefix_chars", "out.middle_chars", F.sha2("out.output", 256).alias("output_sha256"),
        F.sha2("out.restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS d FROM documents),
drawn AS (
  SELECT doc_id, t, regexp_extract_all(t, '[ 	-]*[^ 	-]+|[ 	-]+') AS w,
    ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM texts),
cuts AS (
  SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
