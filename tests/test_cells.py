"""Trees fitted on weighted cells instead of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.operators import cells, training

C = F.col


@pytest.fixture(scope="module")
def rows(spark):
    """Own training rows: two known outcomes, imputed values, weights of two sizes."""
    spread = spark.range(4000).select(
        "id", *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 10_000).alias(name) for k, name in enumerate(contract.FEATURES)])
    steps = {"age": 70, "bmi": 400, "cholesterol": 3, "smoker": 3}
    values = spread.withColumns({name: F.floor(C(name) * steps.get(name, 2)).cast("double") for name in contract.FEATURES})
    values = values.withColumn("smoker", F.when(C("id") % 50 == 0, C("smoker") + C("age") / 100).otherwise(C("smoker")))
    risk = C("age") + 20 * C("hypertension") + 12 * C("diabetes") + F.pmod(F.xxhash64("id", F.lit("label")), F.lit(40))
    return values.select(*contract.FEATURES, (risk >= 75).cast("int").alias("label_heart"), (1.0 + C("id") % 2).alias("fit_weight")).localCheckpoint()


def nodes(model):
    return [tree.toDebugString.split("\n", 1)[1] for tree in model.trees]


def test_boosted_trees_of_cells_are_those_of_rows(spark, rows):
    from_rows = training.new_estimator(training.BOOSTED, "label_heart", 4).fit(training.assemble(rows))
    from_cells = training.fit_estimator(training.new_estimator(training.BOOSTED, "label_heart", 4), rows, "label_heart")
    shape = lambda model: [[part.split("Predict")[0] for part in tree.split("\n")] for tree in nodes(model)]
    assert shape(from_cells) == shape(from_rows)
    both = training.raw_probability(from_rows, rows).withColumnRenamed("raw_probability", "one").drop("features")
    off = training.raw_probability(from_cells, both).agg(F.max(F.abs(C("one") - C("raw_probability")))).first()[0]
    assert off < 1e-9
    np.testing.assert_allclose(from_cells.featureImportances.toArray(), from_rows.featureImportances.toArray(), atol=1e-9)


def test_cells_hold_every_row_and_do_not_grow_with_copies(spark, rows):
    cuts = cells.candidate_cuts(rows)
    one = cells.cells(rows, cuts, "label_heart")
    many = cells.cells(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(6)))).drop("copy"), cuts, "label_heart")
    assert one.agg(F.sum("rows")).first()[0] == 4000 and many.agg(F.sum("rows")).first()[0] == 24000
    assert many.count() == one.count() < 4000
    age = cuts[contract.FEATURES.index("age")]
    binned = rows.groupBy("age").count().collect()
    by_bin = {r["bin_age"]: r["n"] for r in one.groupBy("bin_age").agg(F.sum("rows").alias("n")).collect()}
    expected = {}
    for r in binned:
        expected[sum(cut < r["age"] for cut in age)] = expected.get(sum(cut < r["age"] for cut in age), 0) + r["count"]
    assert by_bin == expected


def test_forest_of_cells_ranks_like_one_of_rows(spark, rows):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    heavy = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("copy").localCheckpoint()
    measure = BinaryClassificationEvaluator(labelCol="label_heart")
    fitted = [fit(training.new_estimator(training.FOREST, "label_heart", 20)) for fit in (
        lambda e: e.fit(training.assemble(heavy)), lambda e: training.fit_estimator(e, heavy, "label_heart"))]
    area = [measure.evaluate(model.transform(training.assemble(rows))) for model in fitted]
    assert area[1] > 0.9 and abs(area[0] - area[1]) < 0.01
    model = fitted[1]
    assert model.getNumTrees == 20 and 6 < max(tree.depth for tree in model.trees) <= training.FOREST_DEPTH
    assert sum(model.featureImportances.toArray()) == pytest.approx(1)
    sizes = [[sum(tree.numNodes for tree in m.trees) / 20, max(tree.depth for tree in m.trees)] for m in fitted]
    assert sizes[1][0] == pytest.approx(sizes[0][0], rel=0.15)


def test_a_cell_is_drawn_like_its_rows():
    """Ten trees of one cell of 900 rows and of 900 cells of a row: the same leaves but for the draws."""
    x = np.array([[0, 1]], np.uint8)
    one = [cells.grow_tree(x, np.array([0, 1]), np.ones(2), np.array([900, 100]), 3, 5, k) for k in range(10)]
    wide = np.repeat(x, [900, 100], axis=1)
    many = [cells.grow_tree(wide, np.repeat([0, 1], [900, 100]), np.ones(1000), np.ones(1000, int), 3, 5, k) for k in range(10)]
    for trees in (one, many):
        drawn = np.array([t["drawn"].to_numpy()[0] for t in trees])
        assert 930 < drawn.mean() < 1070 and 10 < drawn.std() < 60
        assert all(list(t["feature"]) == [0, -1, -1] and t["drawn"][0] == t["drawn"][1] + t["drawn"][2] for t in trees)
    # too few rows on one side
    assert len(cells.grow_tree(x, np.array([0, 1]), np.ones(2), np.array([900, 0]), 3, 5, 1)) == 1
