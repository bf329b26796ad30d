import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from registry.settings import DEID, TOKENS
from clinspan.operators import analytics, cdm, cohort, deid, insights, linkage

PATIENT = ("src_ord bigint, source_system string, source_patient_id string, national_id string, first_name string,"
           " last_name string, date_of_birth date, gender string, region string, email string, mrn string")


def patients(spark, *rows):
    base = dict(src_ord=1, source_system="HIS", source_patient_id="p1", national_id="1", first_name="Nora",
                last_name="Al-Noor", date_of_birth=dt.date(1980, 5, 1), gender="female", region=None, email=None, mrn=None)
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], PATIENT)


def test_name_variants_in_four_systems_get_one_token(spark):
    rows = patients(
        spark, dict(), dict(src_ord=2, source_patient_id="p2", first_name=" NORA", last_name="Noor"),
        dict(src_ord=3, source_patient_id="p3", last_name="al noor"),
        dict(src_ord=4, source_patient_id="p4", last_name="No-or"))
    check = linkage.linkage_check(linkage.with_token(rows, TOKENS).withColumn("g", F.lit(1)), ["g"]).first()
    assert (check.records_found, check.unique_tokens_generated, check.successfully_linked) == (4, 1, True)


def test_missing_id_or_other_gender_gives_another_token(spark):
    rows = patients(spark, dict(), dict(source_patient_id="p2", national_id=None),
                    dict(source_patient_id="p3", gender="male"), dict(source_patient_id="p4", national_id=""))
    tokens = [r.patient_token for r in linkage.with_token(rows, TOKENS).orderBy("source_patient_id").collect()]
    assert len(set(tokens)) == 3 and tokens[1] == tokens[3]


def test_last_record_of_a_source_id_decides_its_token(spark):
    rows = patients(spark, dict(), dict(src_ord=2, gender="male"))
    tokened = linkage.with_token(rows, TOKENS)
    assert linkage.token_map(tokened).first().patient_token == tokened.where("src_ord = 2").first().patient_token
    assert linkage.linkage_statistics(tokened).first().total_unique_tokens == 2


def test_age_cap_and_birth_year_switch(spark):
    rows = patients(spark, dict(date_of_birth=dt.date(1930, 1, 1)),
                    dict(src_ord=2, source_patient_id="p2", date_of_birth=dt.date(1930, 1, 2)))
    links = linkage.token_map(linkage.with_token(rows, TOKENS))
    still = replace(DEID, date_shift_range=(0, 0))
    old, young = deid.deid_patient(rows, links, still).orderBy("src_ord").collect()
    assert (old.age_group, old.age_at_data_collection, old.year_of_birth) == ("90+", None, 1841)
    assert (young.age_group, young.age_at_data_collection, young.year_of_birth) == (None, 89, 1930)
    assert young.region is None
    plain = deid.deid_patient(rows, links, replace(still, legacy_yob=False)).orderBy("src_ord").first()
    assert plain.year_of_birth == 1930


def test_person_consistent_shift(spark):
    rows = patients(spark, dict(), dict(src_ord=2, source_patient_id="p2"))
    links = linkage.token_map(linkage.with_token(rows, TOKENS))
    years = {r.year_of_birth for r in deid.deid_patient(rows, links, replace(DEID, shift_key="token")).collect()}
    assert len(years) == 1


def test_surrogates_number_each_sex_class(spark):
    rows = patients(spark, *[dict(src_ord=i, source_patient_id=f"p{i}", gender=g)
                             for i, g in enumerate(["male", "female", "unknown", "male", "other"])])
    names = {r.surrogate_id for r in deid.surrogate_names(rows).collect()}
    assert names == {"Patient_M0001", "Patient_M0002", "Patient_F0001", "Patient_F0002", "Patient_F0003"}


# --- CDM -------------------------------------------------------------------------------------

T0 = dt.datetime(2020, 1, 1)


def deid_inputs(spark, encounters=(), observations=()):
    people = spark.createDataFrame(
        [(1, "PT-AAAAAAAAAAAAAAA1", "male", 1950), (2, "PT-AAAAAAAAAAAAAAA1", "female", 1951)],
        "src_ord bigint, patient_token string, gender string, year_of_birth int")
    enc = spark.createDataFrame(
        [(f"e{i}", "PT-AAAAAAAAAAAAAAA1", kind, T0, end, diagnosis) for i, (kind, end, diagnosis) in enumerate(encounters)],
        "encounter_id string, patient_token string, encounter_type string, admission_date timestamp_ntz,"
        " discharge_date timestamp_ntz, admission_diagnosis string")
    obs = spark.createDataFrame(
        [(f"o{i}", token, kind, code, T0) for i, (token, kind, code) in enumerate(observations)],
        "observation_id string, patient_token string, observation_type string, observation_code string,"
        " observation_datetime timestamp_ntz")
    for c, t in (("value_numeric", "double"), ("value_text", "string"), ("value_unit", "string"),
                 ("reference_range_low", "double"), ("reference_range_high", "double"), ("route", "string"), ("dose", "string")):
        obs = obs.withColumn(c, F.lit(None).cast(t))
    return people, enc, obs


def test_cdm_keeps_unmapped_codes_and_drops_missing_ones(spark):
    tables = cdm.build(*deid_inputs(
        spark,
        [("telehealth", None, "Check (Z09)"), ("icu", T0 + dt.timedelta(days=2), "no code"), ("inpatient", None, None)],
        [("PT-AAAAAAAAAAAAAAA1", "lab_result", "718-7"), ("PT-AAAAAAAAAAAAAAA1", "lab_result", "x"),
         ("PT-AAAAAAAAAAAAAAA1", "lab_result", None), ("PT-AAAAAAAAAAAAAAA1", "medication", ""),
         ("PT-BBBBBBBBBBBBBBB1", "medication", "1191")]))
    assert [(r.person_id, r.gender_concept_id) for r in tables.person.collect()] == [(1, 8507)]
    assert sorted(r.visit_concept_id for r in tables.visit_occurrence.collect()) == [9201, 9202, 32037]
    assert {str(r.visit_end_date) for r in tables.visit_occurrence.collect()} == {"2020-01-01", "2020-01-03"}
    assert [(r.condition_source_value, r.condition_concept_id) for r in tables.condition_occurrence.collect()] == [("Z09", 0)]
    assert sorted(r.measurement_concept_id for r in tables.measurement.collect()) == [0, 3000963]
    # a token met only in observations gets an id as well
    assert [(r.person_id, r.drug_concept_id) for r in tables.drug_exposure.collect()] == [(2, 1112807)]
    full = cdm.conform(tables.person, "person")
    assert full.first().race_concept_id == 0 and full.first().location_id is None


# --- cohorts and findings --------------------------------------------------------------------


def small_cdm(spark, people=(), visits=(), conditions=(), labs=(), drugs=()):
    return cdm.Cdm(
        spark.createDataFrame(list(people), "person_id bigint, gender_concept_id bigint, year_of_birth int"),
        spark.createDataFrame([(i, *v) for i, v in enumerate(visits)],
                              "visit_occurrence_id bigint, person_id bigint, visit_concept_id bigint").withColumn(
            "visit_start_date", F.lit("2020-01-01").cast("date")),
        spark.createDataFrame(list(conditions), "person_id bigint, condition_concept_id bigint, condition_source_value string"),
        spark.createDataFrame(
            [(i, *v) for i, v in enumerate(labs)],
            "measurement_id bigint, person_id bigint, measurement_concept_id bigint, measurement_source_value string,"
            " measurement_datetime timestamp, value_as_number double, unit_source_value string"),
        spark.createDataFrame(list(drugs), "person_id bigint, drug_concept_id bigint, drug_source_value string"))


def day(n):
    return T0 + dt.timedelta(days=n)


def ids(df):
    return sorted(r.person_id for r in df.collect())


def test_cohort_criteria(spark):
    data = small_cdm(
        spark, [(1, 8507, 1956), (2, 8532, 1955), (3, 8551, 1990)], [(1, 9203), (3, 9201)],
        [(1, 84114007, "I50.9"), (2, 84114007, "I50.9")],
        [(1, 3004410, "4548-4", day(1), 9.0, "%"), (1, 3004410, "4548-4", day(2), None, "%"),
         (2, 3004410, "4548-4", day(1), 8.0, "%"), (2, 3004410, "4548-4", day(1), 5.0, "%")],
        [(3, 950637, "42316")])
    C = cohort.Criterion
    assert ids(cohort.members(data, cohort.Cohort("all", ""))) == [1, 2, 3]
    assert ids(cohort.members(data, cohort.named_cohort("elderly_cardiac"))) == [2]
    high = C("lab_value", "hba1c", "greater_than", 7.0)
    # a latest value that is NULL never matches; of two equal times the first measurement counts
    assert ids(cohort.matching_persons(data, high)) == [2]
    no_er = cohort.Cohort("x", "", [], [C("visit_type", "v", "exists", "emergency"), C("medication", "d", "equals", 950637)])
    assert ids(cohort.members(data, no_er)) == [2] and ids(cohort.excluded(data, no_er)) == [1, 3]
    for bad in (C("diagnosis", "c", "not_in", ["ckd"]), C("gender", "g", "in", ["male"]), C("age", "a", "exists", 1),
                C("medication", "d", "in", ["insulin"]), C("colour", "c", "equals", 1)):
        with pytest.raises(ValueError):
            cohort.matching_persons(data, bad)
    with pytest.raises(ValueError):
        cohort.named_cohort("nobody")
    empty = cohort.statistics(data, data.person.select("person_id").where("person_id > 9")).first()
    assert empty.error == "Empty cohort" and empty.total_count == 0


def series(person, *values, code="2160-0"):
    return [(person, 3016723, code, day(i), v, "mg/dL" if i else None) for i, v in enumerate(values)]


def test_trends_need_three_strictly_monotone_values(spark):
    labs = (series(1, 1.0, 2.0) + series(2, 1.0, 2.0, 3.0) + series(3, 3.0, 2.0, 1.0) + series(4, 1.0, 1.0, 2.0)
            + series(5, 1.0, None, 2.0, 3.5) + series(6, 1.0, 3.0, 2.0) + series(7, 5.0, 4.0, None))
    data = small_cdm(spark, labs=labs)
    found = {r.person_id: (r.direction, r.n, r.first_value, r.last_value, r.unit) for r in insights.lab_trend(data.measurement).collect()}
    assert found == {2: ("rising", 3, 1.0, 3.0, "mg/dL"), 3: ("declining", 3, 3.0, 1.0, "mg/dL"),
                     5: ("rising", 3, 1.0, 3.5, "mg/dL")}
    texts = {r.person_id: r for r in insights.trend_findings(data.measurement).collect()}
    assert texts[5].title == "Rising Trend: Creatinine (2160-0)"
    assert texts[5].evidence == ["Serial values (3 measurements): [1.0, ..., 3.5] mg/dL"]
    assert texts[5].recommendations[0].startswith("Assess renal function")
    values = insights.trend_values(data.measurement, insights.lab_trend(data.measurement))
    assert [r.value for r in values.where("person_id = 5").orderBy("measurement_id").collect()] == [1.0, 2.0, 3.5]


def test_evidence_of_a_long_series_has_one_form(spark):
    data = small_cdm(spark, labs=series(1, *[float(i) for i in range(5000)]))
    assert insights.trend_findings(data.measurement).first().evidence == [
        "Serial values (5000 measurements): [0.0, ..., 4999.0] mg/dL"]
    assert insights.trend_values(data.measurement, insights.lab_trend(data.measurement)).count() == 5000


def test_all_values_of_a_person_are_rows(spark):
    rows = spark.createDataFrame([(1, f"c{i:02}") for i in range(25)] + [(1, "c03"), (2, None)], "person_id bigint, v string")
    assert insights.person_values(rows, "v").where("person_id = 1").count() == 25
    assert [r.value for r in insights.person_values(rows, "v").where("person_id = 2").collect()] == ["Unknown"]


def test_one_series_holding_most_rows_is_cut_and_chained(spark):
    values = [float(i) for i in range(600)]
    broken = values[:300] + [299.0] + values[301:]
    labs = series(1, *values) + series(2, *reversed(values)) + series(3, *broken) + series(4, 1.0, 2.0, 3.0)
    found = {r.person_id: (r.direction, r.n) for r in insights.lab_trend(small_cdm(spark, labs=labs).measurement).collect()}
    assert found == {1: ("rising", 600), 2: ("declining", 600), 4: ("rising", 3)}


def test_drug_rules(spark):
    data = small_cdm(
        spark, labs=[(1, 3016723, "2160-0", day(0), None, None), (1, 3016723, "2160-0", day(1), 5.5, None),
                     (1, 3016723, "2160-0", day(2), 9.0, None), (2, 3016723, "2160-0", day(2), 9.0, None)],
        drugs=[(1, 0, "11289"), (1, 0, "1191"), (1, 0, "860975"), (1, 0, "1191"), (2, 0, "11289"), (3, 0, "Ibuprofen"), (3, 0, "11289")])
    pairs = {(r.person_id, r.drug1, r.drug2) for r in insights.drug_interactions(data.drug_exposure).collect()}
    assert pairs == {(1, "warfarin", "aspirin"), (3, "warfarin", "ibuprofen")}
    assert insights.metformin_creatinine(data.drug_exposure, data.measurement).count() == 0
    high, = insights.metformin_creatinine(data.drug_exposure, data.measurement, "concept").collect()
    assert (high.person_id, high.value_as_number) == (1, 5.5)


def test_critical_values_by_name_and_by_concept(spark):
    data = small_cdm(spark, labs=[(1, 3000963, "Hemoglobin A", day(0), 6.9, None), (1, 3000963, "718-7", day(0), 7.0, None),
                                  (1, 3000963, "718-7", day(0), 20.5, None), (1, 3016723, "x", day(0), 0.1, None)])
    named = insights.critical_lab_findings(data.measurement).collect()
    assert [r.title for r in named] == ["Critical Low Hemoglobin"]
    assert named[0].description == "Hemoglobin value of 6.9 g/dL is critically low (threshold: 7.0)"
    assert named[0].recommendations[-1] == "Confirm with a repeat measurement before acting"
    coded = {r.title for r in insights.critical_lab_findings(data.measurement, "concept").collect()}
    assert coded == {"Critical Low Hemoglobin", "Critical High Hemoglobin"}


def test_risk_levels(spark):
    data = small_cdm(spark, people=[(i, 8507, 1980) for i in range(1, 6)])
    rows = [(2, "medium")] * 1 + [(3, "medium")] * 2 + [(4, "high")] * 2 + [(5, "info")]
    found = spark.createDataFrame(rows, "person_id bigint, severity string")
    assert {r.person_id: (r.score, r.level) for r in insights.risk_score(data, found).collect()} == {
        1: (0, "Minimal"), 2: (5, "Low"), 3: (10, "Medium"), 4: (20, "High"), 5: (0, "Minimal")}


def test_empty_tables_give_neutral_measures(spark):
    data = small_cdm(spark)
    assert [(r.numerator, r.denominator, r.rate, r.status) for r in insights.quality_metrics(data).collect()] == [
        (0, 1, 0.0, "gap")] * 4
    assert {r.denominator for r in analytics.data_quality(data).collect()} == {1}
    assert analytics.totals(data).first().total_persons == 0


def test_summary_lists_at_most_ten_values(spark):
    data = small_cdm(spark, [(1, 8507, 1980), (2, 8532, 1990)], conditions=[(1, 0, f"C{i:02}") for i in range(14)] * 3)
    one, two = insights.patient_summary(data).orderBy("person_id").collect()
    assert one.active_conditions == [f"C{i:02}" for i in range(10)]
    assert (two.total_visits, two.earliest_visit, two.current_medications) == (0, "N/A", [])
