"""A third of all rows on one patient: results stay whole and the hot key is split."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from clinspan.operators import insights
from registry.inputs import Inputs

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    # the few rows here would end up in one partition, which one task writes and none can split
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def hot(spark):
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    x = Inputs(spark, SF)
    third = F.when(F.pmod(F.xxhash64("encounter_id"), F.lit(3)) == 0, "HIS-00000000").otherwise(
        F.col("source_patient_id"))
    x.encounter = x.encounter.withColumn("source_patient_id", third)
    x.observation = x.observation.withColumn("source_patient_id", third)
    yield x
    for key in SMALL:
        spark.conf.unset(key)


def test_hot_patient(hot):
    attached = hot.deid_observation.groupBy("source_system").count()
    assert sum(r["count"] for r in attached.collect()) == hot.observation.count()
    assert "skew=true" in attached._jdf.queryExecution().executedPlan().toString()
    tables = hot.cdm
    for name, key in (("measurement", "measurement_id"), ("visit_occurrence", "visit_occurrence_id"),
                      ("condition_occurrence", "condition_occurrence_id"), ("drug_exposure", "drug_exposure_id")):
        low, high, distinct, rows = getattr(tables, name).agg(
            F.min(key), F.max(key), F.count_distinct(key), F.count("*")).first()
        assert (low, high, distinct) == (1, rows, rows)
    biggest = tables.measurement.groupBy("person_id").count().orderBy(F.desc("count")).first()
    assert biggest["count"] > tables.measurement.count() / 4
    assert insights.analyze_patients(tables).count() == tables.person.count()
