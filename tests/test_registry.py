import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
QUICK = (
    "permit_at_capture", "rule_in_force", "parcel_match", "plan_comparison", "boundary_hits", "request_keys", "image_pairs",
    "open_close", "mask_difference", "raster_quality", "judged_actions", "hash_chain", "custody_report", "descriptor_matches",
)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql_twin(spark, name):
    ok, _took, note = compare(spark, connect(ROOT), ROOT, name, QUERIES, ORACLE)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
