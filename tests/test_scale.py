"""Exact results under skew, many slices, repeats and retries; shape of the plans."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions import cleaning
from pulsegrid.operators import attribution, evaluation, imputation, population, quantiles, regions, registry, splitting, training
from pulsegrid.sources.tables import residents
from pulsegrid.streaming import ingest

C = F.col
SF_DIR = "/root/testdata/sf0.001"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9, allow_subnormal=False), min_size=1, max_size=60), st.floats(0, 1))
def test_quantiles_equal_numpy(spark, values, share):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    found = quantiles.exact_quantiles(df, {"x": share}, interpolate=True)["x"]
    assert found == pytest.approx(float(np.quantile(values, share)), rel=1e-9, abs=1e-6)


def test_quantiles_with_one_dominant_value(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BUCKETS", 3)
    values = [7.0] * 40 + [float(k) ** 3 for k in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values)
    ranks = list(range(0, 100, 9))
    assert quantiles.values_at_ranks(df, {"x": ranks})["x"] == {r: ordered[r] for r in ranks}


def test_running_totals_over_many_slices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    scores = np.round(rng.beta(1, 12, 3000), 3)
    scores[:1000] = 0.011
    labels = (rng.random(3000) < scores * 3).astype(int)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, labels)], "s double, y int")
    points = evaluation.score_points(df, "y", "s")
    whole = sorted(map(tuple, evaluation.running_totals(points).collect()))
    measures = evaluation.ranking_measures(points).first()
    monkeypatch.setattr(evaluation, "SLICE_POINTS", 10)
    assert sorted(map(tuple, evaluation.running_totals(points).collect())) == whole
    assert evaluation.ranking_measures(points).first() == measures
    pairs = [(a > b) + 0.5 * (a == b) for a in scores[labels == 1] for b in scores[labels == 0]]
    assert measures.roc_auc == pytest.approx(np.mean(pairs), abs=5e-5)


def test_keys_at_ranks_go_deeper(spark, monkeypatch):
    monkeypatch.setattr(splitting, "DIGITS", 1)
    monkeypatch.setattr(splitting, "SORTED_ROWS", 3)
    df = spark.range(500).select((C("id") % 3 == 0).cast("int").alias("y"), splitting.hash_key("id", 1).alias("k"))
    keys = {y: sorted(r.k for r in df.collect() if r.y == y) for y in (0, 1)}
    ranks = {0: [1, 17, 333], 1: [50, 167]}
    found = splitting.keys_at_ranks(df, "y", "k", ranks)
    assert all(found[y][r] == keys[y][r - 1] for y in ranks for r in ranks[y])


def test_split_and_oversampling_sizes(spark):
    df = spark.range(1003).select("id", (C("id") < 23).cast("int").alias("y"))
    parted = splitting.stratified_split(df, "y", "id")
    sizes = {(r.split, r.y): r["rows"] for r in splitting.split_sizes(parted, "y").collect()}
    assert sum(n for (s, _), n in sizes.items() if s == "test") == math.ceil(1003 * 0.2)
    assert sizes["test", 1] in (4, 5)
    fit = parted.filter("split = 'fit'")
    grown, added = splitting.oversample(fit, "y")
    positives = sizes["fit", 1]
    assert added == min(int(sizes["fit", 0] * 0.15), positives * 3) - positives
    assert grown.count() == fit.count() + added
    assert grown.filter("y = 1").join(fit.filter("y = 1"), "id", "left_anti").count() == 0


def test_extra_rows_of_the_published_run():
    # 646,097 rows split twice by a fifth, with a stroke rate of 0.020709 in the test part, gave 17,124 added rows.
    counts = {0: 646097 - 13379, 1: 13379}
    test = splitting.class_sizes(counts, 0.2)
    assert sum(test.values()) == 129220 and round(test[1] / 129220, 6) == 0.020709
    rest = {v: counts[v] - test[v] for v in counts}
    calibrate = splitting.class_sizes(rest, 0.2)
    fit = {v: rest[v] - calibrate[v] for v in counts}
    assert splitting.extra_rows(fit[1], fit[0]) == 17124


def _ridge_rows(x, y):
    """Row-wise ridge regression with evidence-based strength, for comparison."""
    rows = len(y)
    xc, yc = x - x.mean(0), y - y.mean()
    u, s, vt = np.linalg.svd(xc, full_matrices=False)
    noise, strength, old = 1 / (np.var(y) + np.finfo(float).eps), 1.0, None

    def weights():
        return vt.T @ ((vt @ (xc.T @ yc)) / (s**2 + strength / noise))

    for _ in range(300):
        w = weights()
        error = ((yc - xc @ w) ** 2).sum()
        used = (noise * s**2 / (strength + noise * s**2)).sum()
        strength = (used + 2e-6) / ((w**2).sum() + 2e-6)
        noise = (rows - used + 2e-6) / (error + 2e-6)
        if old is not None and np.abs(old - w).sum() < 1e-3:
            break
        old = w
    w = weights()
    return w, y.mean() - x.mean(0) @ w


def test_imputation_equals_row_wise_rounds(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(400, 9)) @ rng.normal(size=(9, 9)) + rng.normal(size=9) * 5
    gaps = rng.random((400, 9)) < np.array([0.3, 0, 0.1, 0.2, 0, 0.05, 0.4, 0.1, 0.15])
    data = np.where(gaps, np.nan, base)
    schema = "id int, " + ", ".join(f"{name} double" for name in contract.FEATURES)
    df = spark.createDataFrame(
        [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(data)], schema)
    model = imputation.fit_chained_imputer(df)
    found = np.array([list(r)[1:] for r in model.transform(df).orderBy("id").collect()])

    filled = np.where(gaps, np.nanmean(data, 0), data)
    limit = 1e-3 * np.nanmax(np.abs(data))
    rounds = 0
    for rounds in range(1, 11):
        before = filled.copy()
        for k in np.argsort(gaps.sum(0), kind="stable"):
            others = [j for j in range(9) if j != k]
            known = ~gaps[:, k]
            w, b = _ridge_rows(filled[known][:, others], filled[known, k])
            if gaps[:, k].any():
                filled[gaps[:, k], k] = filled[gaps[:, k]][:, others] @ w + b
        if np.abs(filled - before).max() < limit:
            break
    assert model.rounds == rounds
    np.testing.assert_allclose(found, filled, rtol=1e-6, atol=1e-6)
    assert np.array_equal(found[~gaps], base[~gaps])


@pytest.fixture(scope="module")
def small_models(spark):
    df = cleaning.training_table(cleaning.clean(residents(spark, SF_DIR)))
    models, log = training.train_models(df, rounds=1, trees=4)
    return df, models, log


def test_models_train_score_and_reload(spark, small_models, tmp_path):
    df, models, log = small_models
    assert {entry["target"] for entry in log} == {"heart", "stroke"}
    assert all(entry["roc_auc"] > 0.8 for entry in log)
    scored = training.score_both(df, models)
    assert scored.count() == df.count()
    assert scored.filter("heart_probability < 0 or heart_probability > 1").count() == 0
    assert scored.select(df.columns).exceptAll(df).count() == 0
    root = str(tmp_path)
    registry.activate(spark, root, registry.register(spark, models, root, "small"))
    loaded, manifest = registry.load_active(spark, root)
    again = training.score_both(df, loaded)
    assert scored.exceptAll(again).count() == 0
    assert {r.target: r.threshold for r in manifest.collect()} == {t: m.threshold for t, m in models.items()}
    runs = training.append_runs(spark, log, str(tmp_path / "runs"))
    assert training.append_runs(spark, log, str(tmp_path / "runs")).count() == 2 * len(log)
    assert set(runs.columns) >= {"roc_auc", "decision_threshold"}


def test_imputer_sees_only_the_fit_part(spark):
    df = cleaning.training_table(cleaning.clean(residents(spark, SF_DIR)))
    parted = splitting.stratified_split(df, "label_heart", "resident_id")
    wild = parted.withColumn("bmi", F.when(C("split") == "fit", C("bmi")).otherwise(F.lit(1e6)))
    first = imputation.fit_chained_imputer(parted.filter("split = 'fit'"))
    second = imputation.fit_chained_imputer(wild.filter("split = 'fit'"))
    np.testing.assert_allclose(first.maps, second.maps, rtol=1e-9, atol=1e-9)


def test_registry_keeps_the_old_version_after_a_torn_write(spark, small_models, tmp_path):
    _, models, _ = small_models
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        registry.load_active(spark, root)
    first = registry.register(spark, models, root, "first")
    assert registry.active_version(spark, root) is None
    registry.activate(spark, root, first)
    torn = registry.register(spark, models, root, "torn")
    for part in (tmp_path / "versions" / torn / "heart" / "imputer").glob("part-*"):
        part.write_bytes(b"half of it")
    with pytest.raises(ValueError, match="differ"):
        registry.activate(spark, root, torn)
    assert registry.active_version(spark, root) == first and registry.load_active(spark, root)[0].keys() == {"heart", "stroke"}
    unfinished = registry.register(spark, {"heart": models["heart"]}, root, "half")
    with pytest.raises(ValueError, match="one model per target"):
        registry.activate(spark, root, unfinished)
    second = registry.register(spark, models, root, "second")
    registry.activate(spark, root, second)
    registry.activate(spark, root, first)  # back again
    assert registry.active_version(spark, root) == first
    with pytest.raises(Exception, match="exist"):
        training.save_model(spark, models["heart"], f"{root}/versions/{first}/heart")


def test_best_round(spark):
    runs = spark.createDataFrame([("r_round1", 1, "heart", 0.7), ("r_round2", 2, "heart", 0.9), ("r_round3", 3, "heart", 0.9), ("r_round1", 1, "stroke", 0.8)],
                                 "run_label string, round int, target string, roc_auc double")
    assert sorted(tuple(r) for r in registry.best_rounds(runs).collect()) == [("heart", "r_round2", 2, 0.9), ("stroke", "r_round1", 1, 0.8)]


def known_mean(trees, node, x, known):
    """Output of a tree when only some features are known, by the definition."""
    if trees.feature[node] < 0:
        return trees.value[node]
    children = trees.left[node], trees.right[node]
    if trees.feature[node] in known:
        return known_mean(trees, children[int(x[trees.feature[node]] > trees.cut[node])], x, known)
    return sum(trees.share[child] * known_mean(trees, child, x, known) for child in children)


def shapley(trees, x, feature, features):
    others, total = [k for k in range(features) if k != feature], 0.0
    for size in range(features):
        factor = math.factorial(size) * math.factorial(features - size - 1) / math.factorial(features)
        for known in itertools.combinations(others, size):
            total += factor * sum(known_mean(trees, root, x, {*known, feature}) - known_mean(trees, root, x, set(known)) for root in trees.roots)
    return total


def random_trees(rng, features, depth, count):
    """Trees that split on a feature again and again along a path."""
    nodes = []

    def grow(level):
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, 1.0, float(rng.normal())])
        if level < depth and (level < 2 or rng.random() < 0.8):
            share = float(rng.uniform(0.05, 0.95))
            nodes[at][:2] = int(rng.integers(0, features)), float(rng.normal())
            nodes[at][2], nodes[at][3] = grow(level + 1), grow(level + 1)
            nodes[nodes[at][2]][4], nodes[nodes[at][3]][4] = share, 1 - share
        return at

    roots = [grow(0) for _ in range(count)]
    columns = [np.array(c) for c in zip(*nodes)]
    return attribution.Trees(np.array(roots), *columns)


def test_contributions_equal_the_definition():
    rng = np.random.default_rng(11)
    for features, depth in ((1, 3), (2, 6), (4, 10), (5, 7)):
        trees = random_trees(rng, features, depth, 3)
        x = rng.normal(size=(6, features))
        found = attribution.contributions(trees, x)
        outputs = [sum(known_mean(trees, root, row, set(range(features))) for root in trees.roots) for row in x]
        np.testing.assert_allclose(found.sum(1) + trees.expected, outputs, atol=1e-10)
        expected = [[shapley(trees, row, f, features) for f in range(features)] for row in x]
        np.testing.assert_allclose(found, expected, atol=1e-10)


def test_tree_contributions_are_shapley_values(spark, small_models, tmp_path):
    from pyspark.ml.functions import vector_to_array

    df, models, _ = small_models
    model = models["stroke"]
    trees = attribution.tree_arrays(spark, model.estimator, str(tmp_path / "m"))
    filled = model.imputer.transform(df).limit(20)
    explained = training.assemble(attribution.tree_contributions(filled, trees, "c_"))
    rows = model.estimator.transform(explained).withColumn("raw", vector_to_array("rawPrediction")[1]).collect()
    for row in rows:
        parts = [row[f"c_{name}"] for name in contract.FEATURES]
        assert sum(parts) + trees.expected == pytest.approx(row.raw, abs=1e-9)
    x = [rows[0][name] for name in contract.FEATURES]
    for feature in (0, 5):
        assert rows[0][f"c_{contract.FEATURES[feature]}"] == pytest.approx(shapley(trees, x, feature, 9), abs=1e-9)


def test_deep_forest_adds_up(spark, small_models, tmp_path):
    """Depth ten, where a table per leaf and subset of features would not fit."""
    df, _, _ = small_models
    model = training.train_target(df, "heart", training.FOREST, trees=5)
    assert model.estimator.getNumTrees == 5 and max(t.depth for t in model.estimator.trees) > 6
    trees = attribution.tree_arrays(spark, model.estimator, str(tmp_path / "f"))
    explained = attribution.tree_contributions(model.imputer.transform(df), trees, "c_")
    rows = training.raw_probability(model.estimator, explained).select(
        (sum((F.col(f"c_{n}") for n in contract.FEATURES), F.lit(trees.expected)) - F.col("raw_probability")).alias("off")).agg(F.max(F.abs("off")).alias("most"), F.count("*").alias("n"))
    found = rows.first()
    assert found.most < 1e-9 and found.n == df.count()


def test_isotonic_points_equal_rows(spark):
    rng = np.random.default_rng(2)
    scores = np.round(rng.random(400), 2)
    labels = (rng.random(400) < scores).astype(int)
    df = spark.createDataFrame(
        [(float(s), int(y), 1.0) for s, y in zip(scores, labels)], "raw_probability double, y int, w double")
    points = training.calibration_points(df, "y", "w")
    fitted = training.calibrated(training.fit_calibrator(points), points, "p").orderBy("raw_probability").collect()
    blocks = []
    for s in sorted(set(scores)):
        chosen = labels[scores == s]
        blocks.append([chosen.mean(), len(chosen), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    expected = [mean for mean, _, n in blocks for _ in range(n)]
    np.testing.assert_allclose([r.p for r in fitted], expected, atol=1e-9)


def test_stream_retries_and_repeats(spark, tmp_path):
    df = spark.createDataFrame([(i % 50, "2026-01" if i % 2 else "2026-02", i % 50) for i in range(200)],
                               "id int, period string, value int").repartition(6)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(source)
    stream = ingest.read_stream(spark, source, df.schema, files_per_batch=1)
    ingest.ingest_unique(stream, ["id", "period"], "period", target, str(tmp_path / "c1"))
    assert ingest.read_unique(spark, target, df.schema).count() == df.select("id", "period").distinct().count()
    # a second run over the same files with a lost checkpoint changes nothing
    ingest.ingest_unique(stream, ["id", "period"], "period", target, str(tmp_path / "c2"))
    assert ingest.read_unique(spark, target, df.schema).count() == df.select("id", "period").distinct().count()
    with pytest.raises(ValueError, match="period"):
        ingest.ingest_unique(stream, ["id"], "period", target, str(tmp_path / "c3"))


def scanned_files(df):
    """Number of files that the scans of an executed plan opened, by the SQL metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan
    leaves = plan.collectLeaves()
    files = [leaves.apply(i).metrics().get("numFiles") for i in range(leaves.size())]
    return sum(m.get().value() for m in files if m.isDefined())


def test_batch_reads_only_its_buckets(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2026-0{1 + i % 3}", i) for i in range(600)], "id int, period string, value int")
    source, target, key = str(tmp_path / "in"), str(tmp_path / "out"), ["id", "period"]
    df.coalesce(1).write.parquet(source)
    ingest.ingest_unique(ingest.read_stream(spark, source, df.schema), key, "period", target, str(tmp_path / "c"), buckets=16)
    stored = ingest.stored_rows(spark, target, df.schema)
    every = scanned_files(stored.select(*key))
    row = df.filter("id = 7").withColumn("b", ingest.bucket_of(key, 16)).first()
    one = ingest.known_keys(stored, key, "period", [(row.period, row.b)], 10**9)
    assert every >= 48 and scanned_files(one) <= every / 40 and {r.id for r in one.collect()} >= {7}
    ingest.compact(spark, target, df.schema, "period")
    compacted = ingest.stored_rows(spark, target, df.schema)
    assert sorted(ingest.read_unique(spark, target, df.schema).collect()) == sorted(df.collect())
    assert scanned_files(ingest.known_keys(compacted, key, "period", [(row.period, row.b)], 10**9)) == 1
    df.withColumn("value", F.lit(0)).unionByName(df.limit(1).withColumn("id", F.lit(1000))).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_unique(ingest.read_stream(spark, source, df.schema), key, "period", target, str(tmp_path / "c"), buckets=16)
    rows = ingest.read_unique(spark, target, df.schema).collect()
    assert len(rows) == 601 and all(r.value == r.id for r in rows if r.id < 600)


class Stopped(Exception):
    pass


def test_watermark_ingest_restarts_and_keeps_late_rows(spark, tmp_path, monkeypatch):
    """A stop between batches; rows later than the bound end among the rejected, repeats within it nowhere."""
    schema = "id int, at timestamp, file int"
    source, target, rejected, progress = (str(tmp_path / n) for n in ("in", "out", "late", "c"))
    files = [[(1, "2026-01-01"), (2, "2026-01-02")], [(1, "2026-01-01"), (3, "2026-03-01")], [(4, "2026-03-02")], [(5, "2026-01-05"), (2, "2026-01-02"), (3, "2026-03-01")]]
    landed = []
    for number, rows in enumerate(files):
        frame = spark.createDataFrame([(i, number, d) for i, d in rows], "id int, file int, d string")
        frame.select("id", F.to_timestamp("d").alias("at"), "file").coalesce(1).write.mode("append").parquet(source)
        landed += [(i, number) for i, _ in rows]
    real, calls = ingest._run, []

    def stopping(stream, write, checkpoint, mode="append"):
        def once(batch, number):
            if number == 2 and not calls:
                calls.append(number)
                raise Stopped
            write(batch, number)
        real(stream, once, checkpoint, mode)

    monkeypatch.setattr(ingest, "_run", stopping)
    schema = spark.read.parquet(source).schema
    def run():
        ingest.ingest_within_watermark(spark, source, schema, ["id"], "at", "10 days", target, rejected, progress, files_per_batch=1)

    with pytest.raises(Exception, match="Stopped"):
        run()
    run()
    run()  # nothing new
    accepted = sorted((r.id, r.file) for r in ingest.read_accepted(spark, target, schema).collect())
    late = sorted((r.id, r.file) for r in ingest.read_rejected(spark, rejected, schema).collect())
    assert calls == [2] and accepted == [(1, 0), (2, 0), (3, 1), (4, 2)] and late == [(5, 3)]


def test_counters_in_update_mode(spark, tmp_path, monkeypatch):
    """Late files and a retried batch: the counters are those of all rows, and a batch stores only the groups it changed."""
    df = residents(spark, SF_DIR).select("data_period", "district", "label_heart", "label_stroke")
    source, target, progress, keys = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), ["data_period", "district"]
    periods = sorted(r.data_period for r in df.select("data_period").distinct().collect())
    middle = periods[len(periods) // 2]
    df.filter(C("data_period") > middle).coalesce(1).write.parquet(source)
    real = ingest._run

    def twice(stream, write, checkpoint, mode="append"):
        real(stream, lambda batch, number: (write(batch, number), write(batch, number)), checkpoint, mode)

    monkeypatch.setattr(ingest, "_run", twice)
    ingest.ingest_counters(ingest.read_stream(spark, source, df.schema), keys, target, progress)
    df.filter(C("data_period") <= middle).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_counters(ingest.read_stream(spark, source, df.schema), keys, target, progress)
    report = ingest.current_report(spark, keys, target)
    expected = regions.region_report(df, keys)
    assert report.exceptAll(expected).count() == 0 and report.count() == expected.count()
    second = spark.read.parquet(target).filter("batch_id = 1")
    assert second.filter(C("data_period") > middle).count() == 0 and second.count() > 0


def attacked(cells, total, minimum=5):
    """What a reader learns about the hidden sizes from a known total: for each, the most it may be. None if nothing is hidden."""
    hidden = sum(1 for n in cells if n is None)
    held = total - sum(n for n in cells if n is not None)
    return None if not hidden else held - (hidden - 1)


@pytest.mark.parametrize("seed", range(4))
def test_hidden_sizes_do_not_follow_from_totals(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {(d, c): int(n) for d in range(30) for c, n in enumerate(rng.choice([1, 1, 2, 3, 4, 5, 6, 9, 30], rng.integers(1, 7)))}
    sizes |= {(90, 0): 4, (91, 0): 1, (91, 1): 1, (91, 2): 1, (92, 0): 3, (92, 1): 6, (93, 0): 2, (93, 1): 40, (93, 2): 7, (None, 0): 2, (None, 1): 8}
    rows = [(d, c, 1, 0) for (d, c), n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "district int, community_id int, label_heart int, label_stroke int")
    report = regions.region_report(df, ["district", "community_id"]).collect()
    totals = {r.district: r.residents for r in regions.parent_report(df, ["district", "community_id"]).collect()}
    cells = {}
    for r in report:
        assert (r.residents is None) == r.suppressed == (r.heart_rate is None)
        assert r.residents in (None, sizes[r.district, r.community_id]) and (r.suppressed or r.residents >= 5)
        cells.setdefault(r.district, []).append(r.residents)
    assert len(report) == len(sizes) and totals.keys() == cells.keys()
    for district, shown in cells.items():
        real = sorted(n for (d, _), n in sizes.items() if d == district)
        if totals[district] is not None:
            most = attacked(shown, totals[district])
            assert most is None or (most >= 5 and shown.count(None) >= 2), (district, shown)
            assert totals[district] == sum(real)
        else:
            assert all(n is None for n in shown)  # only where no community is left to hide
        spare = sum(1 for n in shown if n is None) - sum(1 for n in real if n < 5)
        assert spare in (0, 1)  # never more hidden than one cell needs
    by_district = {d: {r.community_id: r.residents for r in report if r.district == d} for d in (92, 93, None)}
    assert by_district[92] == {0: None, 1: None} and by_district[93] == {0: None, 1: 40, 2: None} and by_district[None] == {0: None, 1: None}
    assert totals[90] is None and totals[91] is None and totals[92] == 9


def test_summary_totals_do_not_show_a_hidden_district(spark):
    def summary(sizes):
        rows = [("r", d, 1, 0) for d, n in sizes.items() for _ in range(n)]
        df = spark.createDataFrame(rows, "region string, district string, label_heart int, label_stroke int")
        return regions.population_summary(df, {}).first()

    one = summary({"a": 9, "b": 2, "c": 6})
    assert one.total_residents == 17 and not one.totals_suppressed
    assert [(r.region, r.residents, r.suppressed, r.risk_metric_source) for r in one.region_analysis] == [
        ("a", 9, False, "labels"), ("b", None, True, "labels"), ("c", None, True, "labels")]
    two = summary({"a": 9, "b": 4, "c": 3})  # either of the two may be anything from one to six
    assert two.total_residents == 16 and [r.residents for r in two.region_analysis] == [9, None, None]
    none = summary({"a": 3})
    assert none.total_residents is None and none.heart_risk_rate is None and none.totals_suppressed
    assert summary({"a": 4, "b": 1}).total_residents is None and summary({"a": 9, "b": 7}).total_residents == 16


def test_counters_do_not_depend_on_partitions(spark):
    df = residents(spark, SF_DIR)
    one = regions.region_report(df.repartition(1), ["district"]).collect()
    seven = regions.region_report(df.orderBy(F.rand(1)).repartition(7), ["district"]).collect()
    assert one == seven


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    df = residents(spark, SF_DIR)
    assert "TakeOrderedAndProject" in plan_of(population.top_follow_ups(df, 10))
    path = str(tmp_path / "layer")
    df.write.parquet(path)
    layer = spark.read.parquet(path)
    scan = plan_of(population.follow_ups(population_columns(layer)).select("resident_id"))
    assert "GreaterThanOrEqual(age,65)" in scan and "phone" not in scan.split("ReadSchema")[1]
    rates = plan_of(population.district_report(layer))
    assert "partial_count" in rates


def population_columns(layer):
    return layer.select("resident_id", *contract.POPULATION_COLUMNS)


def test_no_cartesian_or_python_rows(spark):
    from pulsegrid.plans.catalog import QUERIES

    for name in ("a02_district_report", "a09_suppressed_communities", "j07_scenario_comparison", "w02_top_factors",
                 "m01_stratified_split", "w01_latest_records"):
        plan = plan_of(QUERIES[name](spark, SF_DIR))
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name
    assert "WindowGroupLimit" in plan_of(QUERIES["w01_latest_records"](spark, SF_DIR))


def test_advice_adds_no_exchange_to_the_records(spark):
    from pulsegrid.plans.advice_queries import graded_records
    from pulsegrid.plans.catalog import QUERIES

    source = plan_of(graded_records(spark, SF_DIR)).count("Exchange hashpartitioning")
    for name in ("j01_matching_rules", "w05_best_rule_per_factor", "w06_action_plan"):
        assert plan_of(QUERIES[name](spark, SF_DIR)).count("Exchange hashpartitioning") == source, name


def test_a_batch_writes_one_file_per_period_and_bucket(spark, tmp_path):
    """However many tasks hold its rows."""
    rows = spark.range(0, 6000, 1, 12).select("id", F.concat(F.lit("2024-0"), (C("id") % 3 + 1).cast("string")).alias("month"))
    rows.write.parquet(str(tmp_path / "in"))
    for turn in ("first", "second"):
        stream = ingest.read_stream(spark, str(tmp_path / "in"), rows.schema, files_per_batch=12)
        ingest.ingest_unique(stream, ["id", "month"], "month", str(tmp_path / turn), str(tmp_path / f"{turn}-progress"), buckets=4)
        assert len(list((tmp_path / turn).glob("batches/*/month=*/bucket=*/part-*"))) == 3 * 4
        ingest.compact(spark, str(tmp_path / turn), rows.schema, "month")
        assert len(list((tmp_path / turn).glob("generation-1/month=*/bucket=*/part-*"))) == 3 * 4
        assert ingest.read_unique(spark, str(tmp_path / turn), rows.schema).exceptAll(rows).isEmpty()
