"""Quality rules, line field and toxicity on odd rows, empty tables and separable labels."""

import numpy as np
import pytest
from helpers import ODD_TEXTS, PROSE, empty_documents, labels, odd_documents
from pyspark.sql import functions as F

from sealcheck.llm import line_crf, quality_rules, toxicity


def test_rules_recover_a_conjunction():
    rng = np.random.default_rng(3)
    values = {rate: rng.random(3000) for rate in quality_rules.RATES}
    bad = (values["upper_share"] > 0.7) & (values["repeat_share"] > 0.5)
    rules = quality_rules.learn_rules(values, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= quality_rules._covered(rule, values, 3000)
    assert (hit == bad).mean() > 0.97


def test_rules_on_odd_rows(spark):
    docs = odd_documents(spark)
    rules = [[quality_rules.Test("symbols_per_word", True, 0.1), quality_rules.Test("words", True, 3.0)]]
    found = {r["doc_id"]: r for r in quality_rules.with_counts(docs).select("row.doc_id", "out.*", quality_rules.kept(rules).alias("kept")).collect()}
    assert len(found) == len(ODD_TEXTS) + 1 and not found[0]["kept"] and not found[1]["kept"] and found[9]["n_words"] == 50000
    assert found[9]["n_repeat_words"] == 50000 and not found[9]["kept"]
    kept = quality_rules.keep_documents(docs, rules)
    assert kept.columns == docs.columns
    assert quality_rules.keep_documents(empty_documents(spark), rules).count() == 0


def test_empty_tables_learn_nothing(spark):
    none = labels(spark, [], "quality")
    assert quality_rules.fit(empty_documents(spark), none) == []
    assert quality_rules.fit(odd_documents(spark), labels(spark, [(3, 1), (4, None), (None, 0), (6, 7)], "quality")) == []


def few_texts():
    rng = np.random.default_rng(5)
    words = PROSE.split()
    good = [" ".join(rng.choice(words, 40)) + "\n" + " ".join(rng.choice(words, 30)) for _ in range(60)]
    return good, [g.upper().replace(" ", "!! ") for g in good]


def test_line_field_separates(spark):
    good, bad = few_texts()
    docs = odd_documents(spark, [*good, *bad])
    known = labels(spark, [(i, 1) for i in range(60)] + [(i, 0) for i in range(60, 120)], "quality")
    model = line_crf.fit(docs.where("doc_id % 3 <> 0"), known)
    scores = {r["doc_id"]: r["score"] for r in line_crf.scored(docs, model).select("row.doc_id", "out.score").collect()}
    assert min(scores[i] for i in range(0, 60, 3)) > max(scores[i] for i in range(60, 120, 3))
    odd = [r["score"] for r in line_crf.scored(odd_documents(spark), model, keep=[]).select("out.score").collect()]
    assert len(odd) == len(ODD_TEXTS) + 1 and all(0 <= s <= 1 for s in odd)
    assert line_crf.scored(empty_documents(spark), model).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        emission, transition = rng.normal(size=n), rng.normal(size=(2, 2))
        states = np.array(np.meshgrid(*[[0, 1]] * n)).reshape(n, -1).T
        weight = np.exp(states @ emission + sum(transition[states[:, i], states[:, i + 1]] for i in range(n - 1)) if n > 1 else states @ emission)
        good, _, normal = line_crf.chain_marginals(np.concatenate([emission, emission]), np.repeat([0, 1], n), transition)
        want = (states * weight[:, None]).sum(0) / weight.sum()
        assert np.allclose(good, np.tile(want, 2)) and np.isclose(normal, 2 * np.log(weight.sum()))


def test_one_class_scores_its_share(spark):
    model = line_crf.fit(odd_documents(spark), labels(spark, [(3, 1), (6, 1)], "quality"))
    assert model.score([b"", b"x"]).tolist() == pytest.approx([0.75, 0.75])


def test_toxicity_separates(spark):
    good, _ = few_texts()
    docs = odd_documents(spark, [*good, *[g.replace(" fox ", " stupidoid ", 1) + " stupidoid" for g in good]])
    known = labels(spark, [(i, 0) for i in range(60)] + [(i, 1) for i in range(60, 120)], "toxic")
    model = toxicity.fit(docs.where("doc_id % 3 <> 0"), known)
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).select("row.doc_id", "out.score").collect()}
    assert all((scores[i] >= 0.5) == (i >= 60) for i in range(120))
    odd = toxicity.scored(odd_documents(spark), model).select("out.score")
    assert odd.count() == len(ODD_TEXTS) + 1 and odd.where("score BETWEEN 0 AND 1").count() == odd.count()
    none = toxicity.fit(empty_documents(spark), labels(spark, [], "toxic"))
    assert none.score([b"", b"abc"]).tolist() == pytest.approx([0.5, 0.5])


def test_folds_are_not_learned_from(spark):
    ids = spark.range(200).select(F.col("id").alias("doc_id"))
    import zlib
    assert {r[0] for r in ids.where(toxicity.fold(F.col("doc_id"), 5) == 0).collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_all_lines_of_a_labelled_text_are_fitted_on(spark, monkeypatch):
    seen, train = [], line_crf.train

    def watched(found, doc, length, label):
        seen.append((np.bincount(doc).tolist(), length[doc == 0].tolist()))
        return train(found, doc, length, label)

    monkeypatch.setattr(line_crf, "train", watched)
    text = "\n".join(["#### $$$$"] * 100 + ["a good line of plain words"] * 100)
    model = line_crf.fit(odd_documents(spark, [text, "one line\nand another"]), labels(spark, [(0, 0), (1, 1)], "quality"))
    assert seen == [([200, 2], [9.0] * 100 + [26.0] * 100)]
    low, high = model.score([text.encode(), b"one line\nand another"])
    assert low < high
