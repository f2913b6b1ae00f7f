"""Scores, measures and assessments worked out once for the rows of a cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.operators import attribution, cells, evaluation, splitting, training

C = F.col
STEPS = {"age": 60, "bmi": 300, "cholesterol": 3, "smoker": 3}


@pytest.fixture(scope="module")
def rows(spark):
    """Own rows, 4,000 people of whom every one comes three times, with gaps."""
    spread = spark.range(12_000).select("id", (C("id") % 4000).alias("k")).select("id", "k", *[
        F.floor(F.pmod(F.xxhash64("k", F.lit(n)), F.lit(10_000)) / 10_000 * STEPS.get(name, 2)).cast("double").alias(name)
        for n, name in enumerate(contract.FEATURES)])
    risk = C("age") + 20 * C("hypertension") + F.pmod(F.xxhash64("id", F.lit("label")), F.lit(40))
    gaps = {name: F.when(C("k") % step != 0, C(name)) for name, step in (("bmi", 19), ("age", 23), ("smoker", 31))}
    return spread.withColumns({"label_heart": (risk >= 65).cast("int"), "label_stroke": (risk >= 85).cast("int"), "sample_weight": 1.0 + C("id") % 2}).withColumns(
        gaps).select(C("id").alias("resident_id"), *contract.FEATURES, "label_heart", "label_stroke", "sample_weight").localCheckpoint()


@pytest.fixture(scope="module")
def trained(rows):
    return training.train_models(rows, rounds=2, trees=3)


def test_rounds_share_what_they_start_from(rows, monkeypatch):
    """The table is split once for each outcome, however many rounds there are."""
    calls = []
    plain = splitting.stratified_split
    monkeypatch.setattr(splitting, "stratified_split", lambda df, label, *more: calls.append(label) or plain(df, label, *more))
    _, log = training.train_models(rows, rounds=2, trees=1)
    assert sorted(calls) == ["label_heart", "label_stroke"] and len(log) == 4


def test_scores_of_cells_are_those_of_rows(spark, rows, trained, monkeypatch):
    models, _ = trained
    sizes = []
    plain = training.raw_probability
    monkeypatch.setattr(training, "raw_probability", lambda estimator, df: sizes.append(df.count()) or plain(estimator, df))
    twice = rows.unionByName(rows.limit(5))  # copies stay
    found = training.score_both(twice, models)
    assert found.columns == [*rows.columns, "heart_probability", "heart_label", "stroke_probability", "stroke_label"]
    assert len(sizes) == 2 and max(sizes) < 4000  # as many as there are cells
    by_row = twice
    for target in training.TARGETS:
        by_row = training.score_target(by_row, models[target])
    assert found.exceptAll(by_row).count() == 0 and found.count() == by_row.count() == 12_005


def test_held_out_measures_are_those_of_rows(rows, trained):
    models, log = trained
    for target, label in training.TARGETS.items():
        parted = splitting.stratified_split(rows, label, "resident_id")
        test = training.score_target(parted.filter(C("split") == "test"), models[target])
        by_row = evaluation.evaluate(test, label, f"{target}_label", f"{target}_probability").first().asDict()
        for entry in (entry for entry in log if entry["target"] == target):
            assert {name: entry[name] for name in by_row} == pytest.approx(by_row, abs=1.1e-4)
            assert entry["test_rows"] == test.count() and entry["test_positives"] == test.filter(C(label) == 1).count()


def test_numbers_stand_for_bins(spark):
    cuts = [[0.5], [], [1.0, 2.0], [0.5], [0.5], [0.5], [-1.0, 0.0, 3.0], [], [2.0]]
    rng = np.random.default_rng(3)
    data = np.round(rng.normal(scale=2, size=(200, 9)))
    df = spark.createDataFrame([tuple(map(float, line)) for line in data], ", ".join(f"{n} double" for n in contract.FEATURES))
    found = cells.with_values(cells.numbered(df, cuts, "cell").select("cell", *[C(n).alias(f"was_{n}") for n in contract.FEATURES]), cuts, "cell").collect()
    for row in found:
        for name, ends in zip(contract.FEATURES, cuts, strict=True):
            assert [row[name] <= cut for cut in ends] == [row[f"was_{name}"] <= cut for cut in ends]
    assert not cells.countable([list(range(2**20))] * 9) and cells.countable([list(range(31))] * 9)


def test_too_many_slabs_are_explained_by_cell(spark, rows, trained, tmp_path, monkeypatch):
    model = trained[0]["heart"]
    trees = attribution.tree_arrays(spark, model.estimator, str(tmp_path / "t"))
    filled = model.imputer.transform(rows)
    slabs = attribution.cell_contributions(filled, trees, "c_")
    monkeypatch.setattr(attribution, "MAX_SLABS", 0)
    monkeypatch.setattr(cells, "BROADCAST_CELLS", 0)
    single = attribution.cell_contributions(filled, trees, "d_")
    off = F.greatest(*[F.abs(C(f"c_{name}") - C(f"d_{name}")) for name in contract.FEATURES])
    both = slabs.join(single, "resident_id").agg(F.max(off).alias("off"), F.count("*").alias("n")).first()
    assert both.n == 12_000 and both.off < 1e-9
