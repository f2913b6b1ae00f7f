"""Every checked query against its SQL on the smallest tables; the others by properties elsewhere."""

import pytest
from compare import compare, connect

from pulsegrid.plans.catalog import CHECKS, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], CHECKS[name], SF_DIR) == []


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_file_hashes(spark):
    import hashlib
    import os

    rows = {r.file_name: r for r in QUERIES["s09_file_hashes"](spark, SF_DIR).collect()}
    assert len(rows) == 14
    for name, row in rows.items():
        with open(os.path.join(SF_DIR, name), "rb") as stream:
            assert row.sha256 == hashlib.sha256(stream.read()).hexdigest()
