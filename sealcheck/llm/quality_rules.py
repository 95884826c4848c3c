"""Quality rules: a learned decision list over text statistics.

Sequential covering: each rule is a conjunction of threshold tests grown on two thirds of the labelled rows that no earlier rule
covers, by information gain, and pruned on the other third. Rules are learned for the rejected class until a pruned rule is
no longer precise; what no rule covers is kept. The list becomes one ordered ``CASE WHEN`` expression, evaluated by Spark.

Null and empty texts have zero in every count and zero in every rate; they fail the base rules and are rejected. Rows without
an id, repeated rows and ties are treated row by row. Without labelled rows of both classes the list is empty and keeps all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sealcheck.llm import common, textscan

#: Labelled rows the list is fitted on at most, in the order of a hash of their id.
SAMPLE_ROWS = 20_000
MAX_RULES, MAX_TESTS, CUTS = 12, 4, 48
#: Fewer words fail the base rules.
LEAST_WORDS = 50
#: A rule must hit the rejected class this often among the pruning rows it covers, and cover this many.
LEAST_PRECISION, LEAST_COVERED = 0.8, 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines", "n_upper", "n_digits", "n_marks",
          "n_distinct_words"]
#: Rates the rules test, as SQL over the counts.
RATES = {
    "words": "n_words", "symbols_per_word": "n_symbols / n_words", "chars_per_word": "word_chars / n_words",
    "dup_line_share": "n_dup_lines / n_text_lines", "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars", "digit_share": "n_digits / word_chars", "marks_per_word": "n_marks / n_words",
    "distinct_share": "n_distinct_words / n_words", "words_per_line": "n_words / n_text_lines",
}

_SYMBOL, _UPPER, _DIGIT, _MARK, _LETTER = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"!?")] = True
#: First bytes of code points that are not white space.
_LETTER[33:128] = True
_LETTER[0:9] = True
_LETTER[14:32] = True
_LETTER[192:256] = True


def count_text(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Every count of ``COUNTS`` per text; words are ``[^\\x20\\x09-\\x0D]+``."""
    scan = textscan.Scan(texts)
    n, doc = scan.n, scan.doc
    owner_salt = textscan.mix(np.arange(1, n + 1).astype(np.uint64))

    def bytes_in(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask[scan.data])])
        return sums[scan.doc_start[1:]] - sums[scan.doc_start[:-1]]

    words = scan.word_hashes()
    _, first = np.unique(words ^ owner_salt[doc], return_index=True)
    at, grams = scan.windows(words, 3)
    repeated = np.zeros(len(words), bool)
    if len(at):
        _, back, times = np.unique(grams ^ owner_salt[doc[at]], return_inverse=True, return_counts=True)
        hit = at[times[back] > 1]
        for i in range(3):
            repeated[hit + i] = True
    start, end, line_doc = scan.lines()
    shown = np.searchsorted(scan.start, start) < np.searchsorted(scan.start, end)
    lines = scan.hashes(start[shown], end[shown]) ^ owner_salt[line_doc[shown]]
    _, first_line = np.unique(lines, return_index=True)
    n_text_lines = np.bincount(line_doc[shown], minlength=n)
    return {
        "n_words": np.bincount(doc, minlength=n), "word_chars": bytes_in(_LETTER), "n_symbols": bytes_in(_SYMBOL),
        "n_dup_lines": n_text_lines - np.bincount(line_doc[shown][first_line], minlength=n),
        "n_repeat_words": np.bincount(doc[repeated], minlength=n), "n_text_lines": n_text_lines, "n_upper": bytes_in(_UPPER),
        "n_digits": bytes_in(_DIGIT), "n_marks": bytes_in(_MARK), "n_distinct_words": np.bincount(doc[first], minlength=n)}


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (struct of ``keep``, by default all columns) and ``out`` (struct of ``COUNTS``)."""
    return common.map_texts(docs, text, docs.columns if keep is None else keep, count_text, [common.long_field(c) for c in COUNTS])


def rate_columns(counts: str = "out") -> list[Column]:
    """The rates as doubles; zero where the divisor is zero."""
    columns = []
    for name, sql in RATES.items():
        parts = [F.col(f"{counts}.{c}").cast("double") for c in sql.split(" / ")]
        value = parts[0] if len(parts) == 1 else F.when(parts[1] > 0, parts[0] / parts[1]).otherwise(F.lit(0.0))
        columns.append(value.alias(name))
    return columns


def base_failed(counts: str = "out") -> Column:
    n, repeat = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < LEAST_WORDS) | (100 * repeat > 50 * n)


@dataclass(frozen=True)
class Test:
    rate: str
    above: bool
    cut: float

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.rate] > self.cut if self.above else values[self.rate] <= self.cut

    def column(self, rates: dict[str, Column]) -> Column:
        return rates[self.rate] > F.lit(self.cut) if self.above else rates[self.rate] <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.rate} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = list[Test]


def _covered(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for test in rule:
        hit &= test.covers(values)
    return hit


def _grow(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the test of the highest information gain until only bad rows are covered or no test gains."""
    rule: Rule = []
    rows = np.arange(len(bad))
    while len(rule) < MAX_TESTS and not bad[rows].all():
        p, n = bad[rows].sum(), (~bad[rows]).sum()
        before = np.log2(p / (p + n))
        best, best_gain = None, 1e-9
        for rate, all_values in values.items():
            held = all_values[rows]
            cuts = np.unique(np.quantile(held, np.linspace(0, 1, CUTS + 2)[1:-1]))
            order = np.sort(held[bad[rows]]), np.sort(held[~bad[rows]])
            low_p, low_n = (np.searchsorted(side, cuts, "right") for side in order)
            for above in (True, False):
                hit_p, hit_n = (p - low_p, n - low_n) if above else (low_p, low_n)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(hit_p > 0, hit_p * (np.log2(hit_p / (hit_p + hit_n)) - before), -1)
                at = int(np.argmax(gain)) if len(gain) else -1
                if at >= 0 and gain[at] > best_gain:
                    best, best_gain = Test(rate, above, float(cuts[at])), gain[at]
        if best is None:
            break
        rule.append(best)
        rows = rows[best.covers({k: v[rows] for k, v in values.items()})]
    return rule


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop final tests while that raises (bad - good) / covered on the pruning rows."""
    def worth(tests: Rule) -> float:
        hit = _covered(tests, values, len(bad))
        return (bad[hit].sum() - (~bad[hit]).sum()) / hit.sum() if hit.any() else -1.0
    best = max(range(len(rule), 0, -1), key=lambda k: worth(rule[:k]), default=0)
    return rule[:best]


def learn_rules(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules for the rejected class. ``values`` holds a row per labelled document in an order that carries no meaning."""
    rules: list[Rule] = []
    left = np.arange(len(bad))
    while len(rules) < MAX_RULES and bad[left].sum() >= LEAST_COVERED and not bad[left].all():
        pruning = np.arange(len(left)) % 3 == 2
        grow, prune = left[~pruning], left[pruning]
        if not bad[grow].any():
            break
        rule = _grow({k: v[grow] for k, v in values.items()}, bad[grow])
        if not rule:
            break
        rule = _prune(rule, {k: v[prune] for k, v in values.items()}, bad[prune])
        held = {k: v[left] for k, v in values.items()}
        hit = _covered(rule, held, len(left))
        own = _covered(rule, {k: v[prune] for k, v in values.items()}, len(prune))
        if hit.sum() < LEAST_COVERED or bad[left][hit].mean() < LEAST_PRECISION or (own.any() and bad[prune][own].mean() < LEAST_PRECISION):
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality",
        sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from at most ``sample_rows`` labelled rows, chosen and ordered by a hash of the id; label 0 is the rejected class."""
    wanted = (labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull())
              .select(F.col(id_column).alias("_id"), F.col(label).alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample_rows))
    labelled = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text")).join(F.broadcast(wanted), "_id")
    counted = with_counts(labelled, keep=["_id", "_label"]).select("row.*", *rate_columns()).toPandas()
    counted = counted.assign(_order=textscan.mix(counted["_id"].to_numpy().astype(np.uint64))).sort_values(["_order", "_id", "_label"])
    return learn_rules({rate: counted[rate].to_numpy(float) for rate in RATES}, (counted["_label"] == 0).to_numpy())


def verdict(rules: list[Rule], counts: str = "out") -> Column:
    """The list as an ordered conditional: false at the first rule that holds, else true."""
    rates = dict(zip(RATES, rate_columns(counts)))
    chain: Column | None = None
    for rule in rules:
        holds = rule[0].column(rates)
        for test in rule[1:]:
            holds = holds & test.column(rates)
        chain = F.when(holds, F.lit(False)) if chain is None else chain.when(holds, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def kept(rules: list[Rule], counts: str = "out") -> Column:
    return F.when(base_failed(counts), F.lit(False)).otherwise(verdict(rules, counts))


def keep_documents(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows whose text passes, with the columns they came with."""
    return with_counts(docs, text).where(kept(rules)).select("row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, common.table(spark, sf_dir, "labels"))
    return with_counts(docs, keep=["doc_id"]).select(
        "row.doc_id", "out.n_words", "out.word_chars", "out.n_symbols", "out.n_dup_lines", "out.n_repeat_words",
        base_failed().alias("base_failed"), kept(rules).alias("kept"))
