"""Every registered query against its DuckDB twin, and properties of the plans."""

import pytest
from compare import compare, duck
from conftest import SF

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", list(entry.queries()))
def test_query(spark, con, key):
    result, *_ = compare(spark, con, key, SF, entry.queries()[key], ORACLES.get(key))
    assert result.startswith(("ok", "rows")), result


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def plan(spark, key):
    df = entry.queries()[key](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", [
    "link_patients", "drug_interaction", "lab_trend", "quality_metrics", "readmission_risk", "executive_summary",
    "analyze_cohort", "omop_visit", "omop_measurement", "map_entity", "cohort_build", "deid_report"])
def test_no_cross_products(spark, key):
    text = plan(spark, key)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_used(spark):
    text = plan(spark, "top_conditions")
    assert "ReadSchema: struct<condition_concept_id:bigint>" in text
    text = plan(spark, "cohort_transplant_patients")
    assert "EqualTo(drug_concept_id,950637)" in text


def test_text_operators_need_no_python_workers(spark):
    for key in ("phi_detect", "note_extract", "record_process", "clinical_entities"):
        text = plan(spark, key)
        assert "Python" not in text and "Arrow" not in text
