"""Every query with SQL equals it on the smallest tables."""

from __future__ import annotations

import pytest

from coordshift.plans.queries import ORACLE, QUERIES
from tests.oracle import database, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE[name]) == ""


def test_alignment_status_has_a_row_for_each(spark):
    got = QUERIES["lift_alignment_status"](spark, SF)
    assert got.count() == 1500
    assert {r["lo"] for r in got.select("lo").distinct().collect()} <= {"L_L", "L_UM", "UM_L", "UM_UM"}


def test_identity_reads_the_texts_once(spark):
    """Blocks and letters come from what was made of the texts, not from the texts again."""
    files = QUERIES["chain_identity"](spark, SF).inputFiles()
    assert files and all("/letters-" in f for f in files)
