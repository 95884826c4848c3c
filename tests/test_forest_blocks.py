"""One forest on packed rows against the statement in DuckDB, the folds' code and the draws of Spark, on rows made here."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import forest_sql
from sealcheck.operators import forest, forest_blocks, triage
from sealcheck.operators.features import feature_columns
from sealcheck.tables import FEATURES

TREES = 4
COLUMNS = ["tree", "node", "depth", "kind", "rows", "feature", "bin", "left_node", "right_node", "v0", "v1", "v2", "v3"]


def made_rows(n: int, seed: int = 1) -> pd.DataFrame:
    """Some features are constant, so that candidates are tried again; a fifth of the labels is noise."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        values = [float(r.randrange(1 + (k * 7) % 40)) if k % 3 else 1.5 for k in range(len(FEATURES))]
        known = sum(values[k] > 3 for k in (4, 5, 7, 8, 10)) % 4
        rows.append((f"cap-{i % 5}", f"s{i}", 1 + i % 2, forest.CLASSES[known if r.random() < 0.8 else r.randrange(4)], *values))
    return pd.DataFrame(rows, columns=["capture", "session_id", "copy_no", "label", *feature_columns()])


@pytest.fixture(scope="module")
def table():
    return made_rows(700)


@pytest.fixture(scope="module")
def rows(spark, table):
    return spark.createDataFrame(table)


def facts(nodes):
    return sorted(map(tuple, nodes.select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("local_rows", [None, 60])
def test_trees_are_those_of_the_statement(rows, table, local_rows):
    db = duckdb.connect()
    db.register("own", table)
    columns = {n: f"f_{n}" for n in FEATURES}
    sql = forest_sql.forest("SELECT * FROM own", columns, TREES, False)
    want = db.execute(f"WITH RECURSIVE {sql} SELECT tree, node, kind, n_rows, feature, bin, v0, v1, v2, v3 FROM grown WHERE tag = 'out'").fetchall()
    got = forest.grow(rows, "label", TREES, folds=False, local_rows=local_rows).nodes
    got = got.select("tree", "node", "kind", "rows", "feature", "bin", "v0", "v1", "v2", "v3").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r["kind"] for r in got} == {"leaf", "split", "retry"}


def test_nodes_do_not_depend_on_where_they_are_finished(rows):
    whole = forest.grow(rows, "label", TREES, folds=False)
    assert whole.votes is None and whole.nodes.where("fold <> ''").count() == 0
    for local_rows in (5, 100):
        assert facts(forest.grow(rows, "label", TREES, folds=False, local_rows=local_rows).nodes) == facts(whole.nodes)


def test_a_forest_is_the_fold_of_a_capture_that_adds_nothing(monkeypatch, spark, table):
    """With the same cut points the fold that leaves out a capture is the forest of the others."""
    monkeypatch.setattr(forest, "feature_cuts", lambda rows: [[k + 0.5 for k in range(forest.BINS - 1)] for _ in feature_columns()])
    other = table.iloc[:1].assign(capture="other")
    grown = forest.grow(spark.createDataFrame(pd.concat([table, other])), "label", TREES, folds=True)
    alone = forest.grow(spark.createDataFrame(table), "label", TREES, folds=False)
    assert facts(grown.nodes.where("fold = 'other'")) == facts(alone.nodes)


def staged_rows(monkeypatch):
    """(name, rows) of what is staged from now on."""
    seen = []

    def spy(df, name, real=forest.staged):
        out = real(df, name)
        seen.append((name, out.count()))
        return out

    for module in (forest, forest_blocks):
        monkeypatch.setattr(module, "staged", spy)
    return seen


def test_no_row_is_written_for_a_tree(monkeypatch, rows, table):
    seen = staged_rows(monkeypatch)
    model = triage.fit_risk(rows, trees=40)
    nodes = model.nodes.count()
    assert [(name, n) for name, n in seen if name != "finished" and n > len(table)] == [] and dict(seen)["finished"] <= nodes
    monkeypatch.setattr(forest, "BROADCAST_NODES", nodes // 4)
    seen.clear()
    model.votes(rows)
    assert seen and max(n for _, n in seen) <= len(table)


def test_a_large_model_is_walked_in_groups_of_trees(monkeypatch, rows, table):
    model = triage.fit_risk(rows, trees=TREES)
    votes = ["session_id", "v0", "v1", "v2", "v3"]
    want = sorted(map(tuple, model.votes(rows).select(votes).collect()))
    monkeypatch.setattr(forest, "BROADCAST_NODES", 10)
    monkeypatch.setattr(forest, "SCORED_ROWS", 300)
    found = model.votes(rows)
    assert found.columns == [*rows.columns, "v0", "v1", "v2", "v3"]
    assert sorted(map(tuple, found.select(votes).collect())) == want and len(want) == len(table)
    assert model.votes(rows.limit(0)).count() == 0


def test_packed_draws_are_those_of_the_expression(spark):
    points = spark.createDataFrame(
        [(None, "a", 1), ("cap", None, 2), (None, None, 1), ("", "b", 30), ("c" * 200, "ü|x", 3), *[(f"cap-{i % 3}", f"s{i}", 1) for i in range(50)]],
        "capture string, session_id string, copies int").select(
        "*", F.lit(False).alias("base"), F.lit(1).alias("label"), F.array(*[F.lit(k).cast("tinyint") for k in range(26)]).alias("bins"))
    want = forest._bootstrap(points, TREES, 42).groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("w", "cnt"))).alias("all")).collect()
    got = {tree: [] for tree in range(TREES)}
    for batch in forest_blocks.packed_points(points, TREES, 42, 55).toArrow().to_batches():
        for bins, label, w, cnt in forest_blocks.unpacked(batch):
            assert (bins == np.arange(26)).all() and (label == 1).all()
            for tree in got:
                got[tree] += zip(w[tree].tolist(), cnt[tree].tolist())
    assert {t: sorted(x) for t, x in got.items()} == {r["tree"]: [tuple(x) for x in r["all"]] for r in want}


def test_pure_and_empty_nodes(spark, rows, table):
    """A node above the bound that needs no split is closed where it is counted."""
    one_class = rows.withColumn("label", F.lit("HIGH"))
    nodes = forest.grow(one_class, "label", 3, folds=False, local_rows=10).nodes.collect()
    assert [(r["node"], r["kind"], r["v1"]) for r in nodes] == [("root", "leaf", 1_000_000)] * 3
    none = forest.grow(rows.limit(0), "label", 3, folds=False).nodes.collect()
    assert [(r["kind"], r["rows"], r["v0"]) for r in none] == [("leaf", 0, 0)] * 3


def test_units_are_dealt_evenly():
    units = [(0, 0, "n", "n", 0, 0, size) for size in (90, 10, 50, 40, 60, 50)]
    load = [0, 0, 0]
    for unit, part in zip(units, forest_blocks.dealt(units, 3)):
        load[part] += unit[-1]
    assert load == [100, 100, 100]
