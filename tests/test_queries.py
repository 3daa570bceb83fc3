"""Registered queries against their checking SQL on the smallest data."""

import pytest
from compare import compare, duck

from streetgrove.plans import catalog

SF = "/root/testdata/sf0.001"
CHECKED = (
    "audit_summary", "species_norms", "term_diversity", "planting_value", "curb_stations", "validate_spacing", "planting_schedule", "schedule_sink",
    "edit_marks_fold", "classification_report", "symbol_dictionary_join", "unit_decide", "inventory_name_match", "law_quote_check", "geojson_layer_scan", "soil_polygons",
)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_checking_sql(spark, con, name):
    ok, message, rows, *_ = compare(spark, con, SF, name)
    assert ok, message


def test_every_checking_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
