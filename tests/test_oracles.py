"""Every registered query of the library against its SQL, on the smallest driver tables."""

import pytest

from foliant.plans import registry
from tests.compare import differences, duck

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, con, name):
    assert differences(spark, con, sf, registry.queries()[name], ORACLES[name]) == ""


#: Queries without SQL, and the tests that say what they give.
TESTED = {
    "G29_document_report": "test_edits", "G29_report_warnings": "test_edits", "G30_table_stats": "test_edits", "J9_merge_detections": "test_edits",
    "N5_rewrite_refs": "test_structure", "S3_ingest_docx": "test_structure", "T5_legends": "test_records",
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_query_without_sql_has_rows_and_tests_of_its_own(spark, sf, name):
    assert name in TESTED and registry.queries()[name](spark, sf).count() > 0
