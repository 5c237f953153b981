"""Forest over binned cells: planted structure, the whole table, and size that does not follow the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealflux.operators import cell_forest as T


@pytest.fixture(scope="module")
def rows(spark):
    """Label 1 where a > 5 and b is odd, a twentieth turned round; c is noise; two rows lack a feature."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(2000):
        a, b, c = float(rng.uniform(0, 10)), int(rng.integers(0, 6)), float(rng.normal())
        y = int(a > 5 and b % 2 == 1)
        data.append((i, None if i == 7 else a, b, float("nan") if i == 8 else c, y if rng.random() > 0.05 else 1 - y))
    return spark.createDataFrame(data, "id long, a double, b int, c double, y int").persist()


FEATURES = ["a", "b", "c"]


def test_planted_structure_is_found_on_every_row(rows):
    train = rows.where("id % 5 > 0")
    scored, importance = T.fit_and_score(train, rows, FEATURES, "y", trees=40)
    got = {r.id: r for r in scored.collect()}
    assert len(got) == 2000 and all(got[i].score is None and got[i].prediction is None for i in (7, 8))
    test = [r for r in got.values() if r.id % 5 == 0 and r.score is not None]
    assert np.mean([r.prediction == int(r.a > 5 and r.b % 2 == 1) for r in test]) > 0.9
    assert all(0 <= r.score <= 1 and r.prediction == float(r.score > 0.5) for r in test)
    assert sum(r.importance for r in importance.collect()) == pytest.approx(1, abs=1e-9)
    again, _ = T.fit_and_score(train.orderBy(F.desc("id")).repartition(7), rows, FEATURES, "y", trees=40)
    assert {r.id: r.score for r in again.collect()} == {i: r.score for i, r in got.items()}


def test_importances_rank_the_planted_features(rows):
    got = {r.feature: r for r in T.importances(rows, FEATURES, "y", "id", trees=20).collect()}
    assert set(got) == set(FEATURES) and sorted(r.rank for r in got.values()) == [1, 2, 3]
    assert got["c"].permutation_importance < min(got["a"].permutation_importance, got["b"].permutation_importance)


def test_a_tree_reads_cells_and_not_rows(spark):
    """Forty times the rows, the same cells, which are all that a tree's group holds."""
    sizes = []
    for copies in (1, 40):
        df = spark.range(300 * copies).select((F.col("id") % 300 % 20).alias("a"), (F.col("id") % 300 % 7).alias("b"), (F.col("id") % 3 == 0).cast("int").alias("y"))
        known = df.select(T.cell_of(["a", "b"], T.edges_of(df, ["a", "b"])).alias("cell"))
        sizes.append(known.distinct().count())
    assert sizes[0] == sizes[1] == 140
    with pytest.raises(ValueError):
        T.fit_and_score(df, df, ["a", "b", "a", "b"], "y")


def test_one_tree_against_counts():
    """Without a bootstrap that changes proportions, a split on the only feature gives each side's share."""

    class Whole:
        def poisson(self, n):
            return n

        def random(self, shape):
            return np.zeros(shape)

    chance, gained = T.grow(np.array([[0], [1], [2]]), np.array([8, 8, 0]), np.array([0, 0, 4]), 30, Whole())
    assert chance.tolist() == [0.0, 0.0, 1.0] and gained.tolist() == [1.0]
    chance, _ = T.grow(np.array([[0], [1]]), np.array([3, 1]), np.array([1, 3]), 0, Whole())
    assert chance.tolist() == [0.5, 0.5]


def test_class_chances_follow_unordered_text_and_weigh_rows(spark):
    # Text b and d are class x, a and c class y, null class z; the last cell is only asked for.
    rows = [("a", 1, "y", True, 40), ("b", 1, "x", True, 40), ("c", 2, "y", True, 40), ("d", 2, "x", True, 40), (None, 2, "z", True, 40)]
    rows += [("b", 2, "y", False, 1000), ("e", None, None, True, 5), ("d", 2, "x", True, 2)]
    cells = spark.createDataFrame(rows, "t string, h int, y string, learn boolean, n long")
    scored, classes = T.class_chances(cells, ["t", "h"], "y", F.col("learn"), "n", trees=30)
    got = scored.collect()
    assert classes == ["x", "y", "z"] and len(got) == len(rows)
    for r in got:
        assert abs(sum(r.probability) - 1) < 1e-6 or r.t == "e"
        if r.learn and r.y:
            assert classes[int(np.argmax(r.probability))] == r.y


def test_classes_split_text_by_impurity():
    # In alphabetical order no single split gains; in order of impurity one does.
    bins = np.array([[0], [1], [2]])
    counts = np.array([[9, 5, 9], [0, 5, 0]])

    class Whole:
        def poisson(self, n):
            return n

        def random(self, shape):
            return np.zeros(shape)

    apart, _ = T.grow_classes(bins, counts, 1, Whole(), [True])
    along, _ = T.grow_classes(bins, counts, 1, Whole())
    assert apart[0].tolist() == [1.0, 0.5, 1.0] and along[0].tolist() != apart[0].tolist()
