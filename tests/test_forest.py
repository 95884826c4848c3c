"""Forests against the statement that grows them in DuckDB."""

import pytest
from pyspark.sql import functions as F

from checks import compare, oracle, spark_queries as sq
from sealcheck.operators import forest, triage
from sealcheck.operators.features import feature_columns

TREES = 5
KEYS = ["tree", "node", "fold"]


@pytest.fixture(scope="module")
def training(spark, small_dir):
    from sealcheck.session import staged
    return staged(sq.training(spark, small_dir), "training")


def facts(nodes):
    return sorted(tuple(r) for r in nodes.select(*KEYS, "kind", "rows", "feature", "bin", "v0", "v1", "v2", "v3").collect())


def stated(small_dir, folds, score=None):
    db = compare.connect(small_dir)
    rows = db.execute(oracle.forest_rows("SELECT * FROM grown WHERE tag IN ('out', 'vote')", oracle.REPEATED, folds, TREES, score)).df().astype(object)
    return rows.where(rows.notna(), None)


@pytest.mark.parametrize("local_rows", [forest.LOCAL_ROWS, 20])
def test_folds_are_those_of_the_statement(training, small_dir, local_rows):
    grown = forest.grow(training, "label", TREES, folds=True, local_rows=local_rows)
    want = stated(small_dir, True)
    nodes = want[want["tag"] == "out"]
    number = lambda v: None if v is None else int(v)
    assert facts(grown.nodes) == sorted(
        (int(r.tree), r.node, r.fold, r.kind, int(r.n_rows), number(r.feature), number(r.bin), number(r.v0), number(r.v1), number(r.v2), number(r.v3)) for r in nodes.itertuples())
    votes = want[want["tag"] == "vote"].groupby(["fold", "session_id"])[["v0", "v1", "v2", "v3"]].sum()
    got = grown.votes.groupBy("capture", "session_id").agg(*[F.sum(v).alias(v) for v in ("v0", "v1", "v2", "v3")]).collect()
    assert {(r[0], r[1]): tuple(r[2:]) for r in got} == {k: tuple(map(int, v)) for k, v in zip(votes.index, votes.to_numpy())}


def test_a_fold_never_sees_its_capture(training):
    """Growing without the capture gives the fold's splits, up to the cut points, which are made from all rows."""
    grown = forest.grow(training, "label", 2, folds=True)
    name = training.first()["capture"]
    held = grown.nodes.where(F.col("fold") == name)
    other = training.withColumn("label", F.when(F.col("capture") == name, "LOW").otherwise(F.col("label")))
    again = forest.grow(other, "label", 2, folds=True).nodes.where(F.col("fold") == name)
    assert facts(held) == facts(again)


def test_models(training, spark):
    model = triage.fit_risk(training, trees=TREES)
    rows = training.where("copy_no = 1")
    scored = triage.score_risk(rows, model)
    assert scored.columns == [*rows.columns, "ml_class", "ml_confidence"]
    assert scored.where("ml_class = label").count() > 0.9 * rows.count()
    votes = ["capture", "session_id", "v0", "v1", "v2", "v3"]
    assert sorted(model._joined_votes(rows).select(votes).collect()) == sorted(model.votes(rows).select(votes).collect())
    assert model.nodes.agg(F.max("depth")).first()[0] > 6
    assert model.nodes.where("kind = 'leaf' AND rows < 2").count() == 0


def test_base_rows_are_in_every_fold(training):
    name = training.first()["capture"]
    own, base = training.where(F.col("capture") == name), training.where(F.col("capture") != name)
    scored = triage.leave_one_capture_out(own, trees=TREES, base=base).collect()
    assert [r["capture"] for r in scored] == [name] and scored[0]["correct"] > 0


def test_nothing_to_grow_on(spark, training):
    none = training.limit(0)
    assert triage.leave_one_capture_out(none, trees=2).count() == 0
    one = training.limit(1)
    assert triage.score_risk(one, triage.fit_risk(one, trees=2)).count() == 1
    unknown = training.limit(4).withColumn("label", F.lit(None).cast("string"))
    assert triage.leave_one_capture_out(unknown, trees=2).count() == 0


def test_poisson_steps():
    steps = forest.poisson_steps()
    assert steps == sorted(steps) and abs(steps[0] / 2**32 - 0.36788) < 1e-5 and len(feature_columns()) == 26


def test_the_driver_gets_records_and_no_names(training):
    model = triage.fit_risk(training, trees=TREES)
    packed = model.packed_trees().collect()
    assert len(packed) == TREES
    assert sum(len(r["nodes"]) for r in packed) == 26 * model.nodes.count()


def test_training_rows_are_chosen_before_they_are_scored(training, spark, small_dir):
    whole = sq.training_of(sq.scored(spark, small_dir))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, training.select(whole.columns).collect()), key=str)
