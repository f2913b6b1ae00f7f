"""Contributions worked out once for the rows of a cell."""

import numpy as np
from pyspark.sql import functions as F
from test_scale import random_trees

from pulsegrid import contract
from pulsegrid.operators import attribution


def test_tables_equal_rows():
    rng = np.random.default_rng(5)
    for features, depth in ((1, 3), (2, 6), (4, 7), (5, 9)):
        trees = random_trees(rng, features, depth, 3)
        values = [np.sort(rng.normal(size=n)) for n in (4, 1, 6, 2, 3)[:features]]
        found = attribution.slab_contributions(attribution.leaf_boxes(trees, features), values)
        x = np.stack([axis.ravel() for axis in np.meshgrid(*values, indexing="ij")], axis=1)
        np.testing.assert_allclose(found.reshape(features, -1).T, attribution.contributions(trees, x), atol=1e-10)


def test_every_row_gets_its_cells_contributions(spark):
    """Repeated rows, values at a cut, and slabs of several features; the same as row by row, and few cells are worked out."""
    rng = np.random.default_rng(6)
    features = len(contract.FEATURES)
    trees = random_trees(rng, features, 5, 4)
    trees.cut[:] = np.round(trees.cut)  # cuts among the values
    data = np.clip(np.round(rng.normal(size=(300, features))), -1, 1)
    schema = "id int, " + ", ".join(f"{name} double" for name in contract.FEATURES)
    df = spark.createDataFrame([(k // 2, *map(float, data[k // 2])) for k in range(600)], schema)
    found = attribution.cell_contributions(df, trees, "c_")
    assert found.columns == [*df.columns, *[f"c_{name}" for name in contract.FEATURES]] and found.count() == 600
    rows = found.orderBy("id").collect()
    x = np.array([[row[name] for name in contract.FEATURES] for row in rows])
    assert np.array_equal(x, np.repeat(data[:300], 2, axis=0))
    np.testing.assert_allclose([[row[f"c_{name}"] for name in contract.FEATURES] for row in rows], attribution.contributions(trees, x), atol=1e-10)
    assert attribution.cell_contributions(df.limit(0), trees, "c_").agg(F.count("*")).first()[0] == 0
