"""Stored CDM tables lie by person; persons with very many rows lie apart; ids and logs survive repeated runs."""

import re

import pytest

from pyspark.sql import functions as F

from clinspan.operators import cohort, ids, insights
from clinspan.plans import pipeline
from registry.inputs import inputs
from registry.settings import DEID, TOKENS

SF = "/root/testdata/sf0.001"


def answers(tables, as_of):
    made = {
        "trends": insights.lab_trends(tables), "people": insights.analyze_patients(tables, as_of, "concept"),
        "quality": insights.quality_metrics(tables), "risk": insights.readmission_risk(tables, as_of),
        "cardiac": cohort.members(tables, cohort.named_cohort("elderly_cardiac"), as_of),
        "log": cohort.run_log(tables, list(cohort.NAMED_COHORTS.values()), as_of)}
    return {name: sorted(map(str, df.collect())) for name, df in made.items()}


@pytest.fixture(scope="module")
def given(spark):
    return inputs(spark, SF)


def run(given, tmp_path):
    return pipeline.run(given.patient, given.encounter, given.observation, TOKENS, DEID, str(tmp_path / "cdm"))[0]


def test_work_per_person_shuffles_no_measurements(given):
    tables, as_of = given.cdm, given.as_of
    for df, exchanges in (
            (insights.lab_trends(tables), 0), (insights.readmission_risk(tables, as_of), 0), (insights.quality_metrics(tables), 0),
            (cohort.members(tables, cohort.named_cohort("ckd_on_dialysis"), as_of), 0),
            (cohort.latest_measurement(tables.measurement, ["person_id", "measurement_source_value"]), 0),
            (insights.analyze_patients(tables, as_of), 1)):  # of the counts of findings, one row per person and task
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        found = re.findall(r"Exchange (?:hash|range)partitioning.*\n.*", plan)
        assert len(found) == exchanges and all("partial_count" in f or "HashAggregate" in f or "Codegen" in f for f in found), plan
        assert "Bucketed: true" in plan


def test_persons_with_very_many_rows_lie_apart(spark, given, tmp_path, monkeypatch):
    want = answers(run(given, tmp_path / "one"), given.as_of)
    monkeypatch.setattr(pipeline, "MANY_ROWS", 25)
    tables = run(given, tmp_path / "two")
    even, rest = tables.parts
    assert rest.measurement.count() and even.measurement.count()
    assert not even.person.join(rest.person, "person_id", "left_semi").count()
    assert answers(tables, given.as_of) == want


def test_tables_are_read_by_a_session_that_did_not_write_them(spark, given, tmp_path):
    folder = str(tmp_path / "cdm")
    want = answers(run(given, tmp_path), given.as_of)
    for name in ("person", "measurement", "drug_exposure"):
        spark.sql(f"DROP TABLE {pipeline._named(folder, name)}")
    tables = pipeline.read_cdm(folder)
    assert answers(tables, given.as_of) == want
    assert "Bucketed: true" in insights.lab_trends(tables)._jdf.queryExecution().executedPlan().toString()


def test_ids_survive_new_data(spark, tmp_path):
    path = str(tmp_path / "map")

    def batch(low, high):
        rows = spark.range(low, high).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
        return {r.key: r.id for r in ids.remembered_ids(rows.union(rows).union(spark.sql("SELECT CAST(NULL AS string)")), "key", path, "id").collect()}

    one = batch(0, 100)
    assert sorted(one.values()) == list(range(1, 101))
    two = batch(50, 170)
    assert {k: two[k] for k in one} == one and sorted(two.values()) == list(range(1, 171))
    assert batch(50, 170) == two and batch(0, 0) == two
    # a run that failed leaves a folder that was not committed; it counts for nothing, and the next run writes it anew
    failed = tmp_path / "map" / f"batch-{len(list((tmp_path / 'map').glob('batch-*'))):06d}"
    spark.range(500, 505).select(F.lit("lost").alias("key"), F.col("id")).write.parquet(str(failed))
    (failed / "_SUCCESS").unlink()
    three = batch(0, 180)
    assert "lost" not in three and {k: three[k] for k in two} == two and sorted(three.values()) == list(range(1, 181))


def test_persons_keep_their_ids_when_records_come(spark, given, tmp_path):
    path, some = str(tmp_path / "map"), given.patient.where("src_ord % 4 <> 1")
    first, second = ({r.patient_token: r.person_id for r in pipeline.person_links(p, TOKENS, path).collect()} for p in (some, given.patient))
    assert len(second) > len(first) and all(second[t] == i for t, i in first.items())
    assert sorted(second.values()) == list(range(1, len(second) + 1))


def test_a_repeated_run_is_logged_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "run int, cohort_name string")
    assert cohort.read_log(path) is None
    assert cohort.append_log(rows, path, "x") and not cohort.append_log(rows, path, "x")
    (tmp_path / "log" / "run_id=broken").mkdir()  # a run that was lost before its commit
    assert cohort.append_log(rows, path, "broken") and not cohort.append_log(rows.limit(1), path, "broken")
    log = cohort.read_log(path)
    assert sorted((r.batch, r.run_id, r.run) for r in log.collect()) == [(1, "x", 1), (1, "x", 2), (2, "broken", 1), (2, "broken", 2)]
    assert [(r.batch, r.run) for r in cohort.recent_runs(log, 3).collect()] == [(2, 2), (2, 1), (1, 2)]


def test_all_cohorts_in_one_pass(given):
    """Masks over one vector of criteria give the members that joins give, also beyond 60 criteria."""
    C = cohort.Criterion
    ages = [cohort.Cohort(f"over {a}", "", [C("age", "age", "greater_than", a)], [C("gender", "gender", "equals", "male")] * (a % 2)) for a in range(20, 90)]
    some = [*cohort.NAMED_COHORTS.values(), *ages, cohort.Cohort(
        "labs", "", [C("visit_type", "visit", "equals", "inpatient"), C("diagnosis", "condition", "in", ["ckd", "heart_failure"])],
        [C("lab_value", "hba1c", "greater_than", 7.0), C("lab_value", "creatinine", "between", 1.0, 9.0), C("medication", "drug", "exists", "metformin")])]
    log = cohort.run_log(given.cdm, some, given.as_of)
    got = [(r.run, r.included, r.excluded, r.final_cohort) for r in log.collect()]
    want = [(i, cohort.included(given.cdm, c, given.as_of).count(), cohort.excluded(given.cdm, c, given.as_of).count())
            for i, c in enumerate(some, 1) if not 15 < i < 70]
    assert [g for g in got if not 15 < g[0] < 70] == [(i, a, b, a - b) for i, a, b in want]
    assert sum(b for *_, b in want) > 0
    plan = log._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \S+_measurement\[", plan)) == 1
    assert len(re.findall(r"FileScan parquet \S+_condition_occurrence\[", plan)) == 1


@pytest.mark.parametrize("many", [pipeline.MANY_ROWS, 25])
def test_rows_are_counted_as_tables_are_written(spark, given, tmp_path, monkeypatch, many):
    monkeypatch.setattr(pipeline, "MANY_ROWS", many)
    folder = str(tmp_path / "cdm")
    done = pipeline.process(given.patient, given.encounter, given.observation, TOKENS, DEID, folder)
    assert {n: t.count() for n, t in done.tables.tables().items()}.items() <= done.counts.items()
    assert done.counts["deid_patient"] == done.people.count() and pipeline.read_counts(folder) == done.counts
    sources = given.patient, given.encounter, given.observation, done.tables, done.people, TOKENS
    told, counted = (pipeline.step_report(*sources, counts=c) for c in (done.counts, None))
    assert sorted(told.collect()) == sorted(counted.collect())
    assert folder not in told._jdf.queryExecution().executedPlan().toString()


def test_an_upload_reports_rows_it_counted(spark, tmp_path):
    (tmp_path / "in.csv").write_text("patient_id,first_name,last_name,date_of_birth,gender\n1,Ann,Lee,1980-01-02,F\n2,Bob,Ray,1970-01-02,M\n")
    _, done = pipeline.upload(str(tmp_path / "in.csv"), TOKENS, DEID, str(tmp_path / "out"))
    assert (done.counts["patients"], done.counts["person_index"], done.counts["observations"], done.counts["measurement"]) == (2, 2, 0, 0)
