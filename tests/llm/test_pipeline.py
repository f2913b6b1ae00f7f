"""The pipeline's stages: what goes, what stays, and that each decision takes effect."""

import corpus_pipeline
import numpy as np
import pytest
from pulsegrid.llm import decontaminate, near_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"t{i}" for i in rng.integers(0, 10**6, n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    one = text(100)
    rows = [(1, one), (2, one), (3, one + " tail"), (4, text(80)), (5, text(20) + " " + item + " " + text(20)), (6, "a b token=abcdefgh c"), (None, text(9)), (7, None)]
    return spark.createDataFrame([(i, t, "en", f"s{k}", len(t or ""), k) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, spans int")


def test_stages(spark, docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    unique = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert {r.doc_id for r in unique.collect()} == {1, 4, 5, 6, 7, None} and unique.columns == docs.columns
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert {r.doc_id for r in clean.collect()} == {1, 2, 3, 4, 6, 7, None}
    safe = corpus_pipeline.redact_secrets(spark, docs, SF)
    assert safe.schema == docs.schema or safe.dtypes == docs.dtypes
    changed = {r.doc_id: (r.text, r.n_chars, r.spans) for r in safe.collect()}
    assert changed[6] == ("a b [REDACTED] c", 16, 5) and changed[7][0] is None


def test_run(spark):
    packed = corpus_pipeline.run(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in packed}
    assert kept <= {r.doc_id for r in table.select("doc_id").collect()} and len(kept) > 100
    left = table.filter(table.doc_id.isin(sorted(kept)))
    assert near_dedup.classify(left).filter("not kept").count() == 0
    assert decontaminate.find(left, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
