"""Registered queries against their SQL: a quick choice on the smallest data, or every one (ORACLE_ALL=1)."""

import os

import pytest

import __spark_entry__ as entry_points
import check_oracle

SF = "/root/testdata/sf0.01" if os.environ.get("ORACLE_ALL") else "/root/testdata/sf0.001"
QUICK = ("a2_politician_rollup a5_cluster_aggregate a6_cluster_people c3_cluster_highlights c4_largest_highlights c5_transaction_browse "
         "c6_filing_browse c9_resolve_house c10_resolve_senate c11_house_snapshot j6_evidence_exists o5_politician_sort q1_date_flags "
         "q4_apply_verifications q6_apply_amendment_links w1_prev_date x2_resolve_person_id x9_flag_messages").split()
NAMES = sorted(entry_points.queries()) if os.environ.get("ORACLE_ALL") else QUICK


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("given tables are not here")
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    ok, _, _, message = check_oracle.compare(spark, db, SF, name, entry_points.queries()[name], entry_points.oracle_sql().get(name))
    assert ok, message


def test_entry_and_names(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
