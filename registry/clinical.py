"""Queries over the clinical tables: linkage, de-identification, CDM, cohorts, findings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from clinspan.fixed import rules
from clinspan.functions import normalize as nz
from clinspan.functions.redact import redact_note
from clinspan.functions.secure import hashed_id, shift_days
from clinspan.operators import analytics, cdm, cohort, deid, ids, ingest, insights, linkage
from clinspan.session import shared_dir
from clinspan.sources import export
from registry.oracle_views import AGE, _redact, shift
from registry.queries import joined, query

# --- scalar functions ------------------------------------------------------------------------


@query("normalize_name", """SELECT src_ord, replace(replace(replace(replace(
    upper(trim(first_name)), 'AL-', ''), 'AL ', ''), ' ', ''), '-', '') AS first_name,
    replace(replace(replace(replace(upper(trim(last_name)), 'AL-', ''), 'AL ', ''), ' ', ''), '-', '') AS last_name
    FROM fx_patient""")
def _(x):
    return x.patient.select("src_ord", nz.normalize_name(F.col("first_name")).alias("first_name"),
                            nz.normalize_name(F.col("last_name")).alias("last_name"))


@query("composite_key", "SELECT src_ord, composite_key FROM keyed")
def _(x):
    return x.tokened.select("src_ord", "composite_key")


@query("patient_token", "SELECT src_ord, patient_token FROM tok")
def _(x):
    return x.tokened.select("src_ord", "patient_token")


DATE_SHAPES = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y"]
TIME_SHAPES = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%d/%m/%Y %H:%M:%S",
               "%d/%m/%Y", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y"]
SPARK_SHAPES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "T": "'T'"}


def _spark_shape(shape: str) -> str:
    for a, b in SPARK_SHAPES.items():
        shape = shape.replace(a, b)
    return shape


def _written(column, key, shapes):
    """A date written in the layout picked by the key, every 11th as an impossible text."""
    text = F.lit("31/31/2020")
    for i, shape in enumerate(shapes):
        text = F.when(key % len(shapes) == i, F.date_format(column, _spark_shape(shape))).otherwise(text)
    return F.when(key % 11 == 5, "2020-02-30").when(key % 13 == 5, " ").otherwise(text)


def _written_sql(column, key, shapes):
    arms = " ".join(f"WHEN {i} THEN strftime({column}, '{s}')" for i, s in enumerate(shapes))
    return (f"CASE WHEN {key} % 11 = 5 THEN '2020-02-30' WHEN {key} % 13 = 5 THEN ' '"
            f" ELSE CASE {key} % {len(shapes)} {arms} END END")


def _parsed_sql(text, shapes):
    return "coalesce(" + ", ".join(f"try_strptime(trim({text}), '{s}')" for s in shapes) + ")"


@query("parse_date", f"""SELECT o_orderkey, cast(cast({_parsed_sql('txt', DATE_SHAPES)} AS date) AS varchar) AS parsed
    FROM (SELECT o_orderkey, {_written_sql('o_orderdate', 'o_orderkey', DATE_SHAPES)} AS txt FROM orders)""")
def _(x):
    text = _written(F.col("o_orderdate"), F.col("o_orderkey"), DATE_SHAPES)
    return x.table("orders").select("o_orderkey", nz.parse_date(text).alias("parsed"))


@query("parse_datetime", f"""SELECT o_orderkey, cast({_parsed_sql('txt', TIME_SHAPES)} AS varchar) AS parsed
    FROM (SELECT o_orderkey, {_written_sql("(o_orderdate + (o_orderkey % 24) * interval '1' hour)", 'o_orderkey', TIME_SHAPES)}
          AS txt FROM orders)""")
def _(x):
    at = F.col("o_orderdate") + F.make_dt_interval(hours=F.col("o_orderkey").cast("int") % 24)
    text = _written(at, F.col("o_orderkey"), TIME_SHAPES)
    return x.table("orders").select("o_orderkey", nz.parse_datetime(text).alias("parsed"))


GENDER_WORDS = ["M", "male", "Man ", "boy", "f", "Female", "WOMAN", " girl", "x", ""]


def _word(key):
    return F.element_at(F.array(*[F.lit(w) for w in GENDER_WORDS]), (key % 10 + 1).cast("int"))


@query("parse_gender", f"""SELECT c_custkey, CASE
    WHEN upper(trim(w)) IN ('M','MALE','MAN','BOY') THEN 'male'
    WHEN upper(trim(w)) IN ('F','FEMALE','WOMAN','GIRL') THEN 'female' ELSE 'other' END AS gender
    FROM (SELECT c_custkey, {GENDER_WORDS!r}[c_custkey % 10 + 1] AS w FROM customer)""")
def _(x):
    return x.table("customer").select(
        "c_custkey", nz.parse_gender(_word(F.col("c_custkey"))).alias("gender"))


INSTITUTES = ["KFSHRC", "King Fahd Medical City ", "riyadh military hospital", "Unknown Clinic",
              "King Khalid University Hospital", "King Abdulaziz Medical City", ""]


@query("map_source_system", f"""SELECT c_custkey, CASE lower(trim(w))
    WHEN 'king fahd medical city' THEN 'LAB' WHEN 'riyadh military hospital' THEN 'EMR'
    WHEN 'king khalid university hospital' THEN 'ICU' WHEN 'king abdulaziz medical city' THEN 'RAD'
    ELSE 'HIS' END AS source_system
    FROM (SELECT c_custkey, {INSTITUTES!r}[c_custkey % 7 + 1] AS w FROM customer)""")
def _(x):
    name = F.element_at(F.array(*[F.lit(w) for w in INSTITUTES]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return x.table("customer").select("c_custkey", nz.source_system(name).alias("source_system"))


@query("diagnosis_string", """SELECT o_orderkey, CASE
    WHEN o_orderkey % 4 = 0 THEN 'Sepsis (A41.9)' WHEN o_orderkey % 4 = 1 THEN 'Sepsis'
    WHEN o_orderkey % 4 = 2 THEN 'ICD: A41.9' ELSE 'Not specified' END AS diagnosis FROM orders""")
def _(x):
    code = F.when(F.col("o_orderkey") % 2 == 0, " A41.9")
    text = F.when(F.col("o_orderkey") % 4 < 2, "Sepsis ").otherwise("")
    return x.table("orders").select("o_orderkey", nz.diagnosis_string(code, text).alias("diagnosis"))


@query("date_shift", f"""SELECT source_patient_id, {shift('source_patient_id')} AS days,
    cast(date_of_birth + cast({shift('source_patient_id')} AS int) AS varchar) AS shifted FROM fx_patient""")
def _(x):
    days = shift_days(F.col("source_patient_id"), x.deid_config)
    return x.patient.select("source_patient_id", days.alias("days"),
                            F.date_add("date_of_birth", days).alias("shifted"))


@query("age_generalize", f"""SELECT src_ord, least({AGE}, 89) AS age, {AGE} > 89 AS generalized FROM fx_patient""")
def _(x):
    age = nz.age_on(F.col("date_of_birth"), x.as_of)
    return x.patient.select("src_ord", F.least(age, F.lit(89)).alias("age"), (age > 89).alias("generalized"))


@query("year_of_birth_deid", f"""SELECT src_ord, year(date_of_birth + cast({shift('source_patient_id')} AS int))
    - CASE WHEN {AGE} > 89 THEN 89 ELSE 0 END AS legacy_year,
    CASE WHEN {AGE} > 89 THEN 1930 ELSE year(date_of_birth + cast({shift('source_patient_id')} AS int)) END AS plain_year
    FROM fx_patient""")
def _(x):
    legacy = x.deid_patient.select("src_ord", F.col("year_of_birth").alias("legacy_year"))
    plain = deid.deid_patient(x.patient, x.links, replace(x.deid_config, legacy_yob=False))
    return legacy.join(plain.select("src_ord", F.col("year_of_birth").alias("plain_year")), "src_ord")


@query("hash_id", "SELECT encounter_id, substr(sha256(encounter_id), 1, 12) AS hashed FROM fx_encounter")
def _(x):
    return x.encounter.select("encounter_id", hashed_id(F.col("encounter_id")).alias("hashed"))


@query("extract_icd_code", r"""SELECT encounter_id,
    nullif(regexp_extract(admission_diagnosis, '\(([A-Z]\d{2}\.?\d*)\)', 1), '') AS icd_code FROM fx_encounter""")
def _(x):
    return x.encounter.select("encounter_id", nz.icd_code(F.col("admission_diagnosis")).alias("icd_code"))


@query("map_gender_concept", """SELECT src_ord, CASE gender WHEN 'male' THEN 8507 WHEN 'female' THEN 8532
    ELSE 8551 END AS concept_id FROM fx_patient""")
def _(x):
    return x.patient.select("src_ord", cdm.gender_concept(F.col("gender")).alias("concept_id"))


@query("map_visit_concept", """SELECT encounter_id, CASE encounter_type WHEN 'inpatient' THEN 9201
    WHEN 'emergency' THEN 9203 WHEN 'icu' THEN 32037 ELSE 9202 END AS concept_id FROM fx_encounter""")
def _(x):
    return x.encounter.select("encounter_id", cdm.visit_concept(F.col("encounter_type")).alias("concept_id"))


@query("lab_display", """SELECT observation_id, coalesce(lab || ' (' || code || ')', observation_code) AS display
    FROM fx_observation LEFT JOIN lab_names ON code = observation_code WHERE observation_type = 'lab_result'""")
def _(x):
    labs = x.observation.where("observation_type = 'lab_result'").select("observation_id", "observation_code")
    return insights.lab_display(labs, "observation_code").select("observation_id", "display")


@query("patient_display", """SELECT person_id, 'Patient ' || person_id || ' (' || (2020 - year_of_birth) || 'y '
    || CASE gender_concept_id WHEN 8507 THEN 'M' WHEN 8532 THEN 'F' ELSE 'U' END || ', '
    || coalesce(r, 'Unknown') || ')' AS display_name
    FROM person JOIN (SELECT patient_token, region AS r, row_number() OVER (
        PARTITION BY patient_token ORDER BY src_ord DESC) AS rn FROM dp) ON patient_token = person_source_value
    WHERE rn = 1""")
def _(x):
    return analytics.patient_list(x.cdm, x.people, x.as_of).select("person_id", "display_name")


@query("percent_string", """SELECT l_suppkey, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*) * 100, 1) AS rate,
    cast(round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*) * 100, 1) AS varchar) || '%' AS text
    FROM lineitem GROUP BY 1""")
def _(x):
    counts = x.table("lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("part"), F.count("*").alias("whole"))
    part, whole = F.col("part"), F.col("whole")
    return counts.select("l_suppkey", nz.percent(part, whole).alias("rate"),
                         nz.percent_text(part, whole).alias("text"))


# --- filters ---------------------------------------------------------------------------------


@query("has_token_filter", """SELECT encounter_id FROM fx_encounter JOIN tmap USING (source_patient_id)
    WHERE source_patient_id IN (SELECT source_patient_id FROM fx_patient WHERE region IS NOT NULL)""")
def _(x):
    known = x.tokened.where(F.col("region").isNotNull())
    return linkage.attach(x.encounter, linkage.token_map(known)).select("encounter_id")


def _criterion(key, sql, *criteria):
    @query(key, sql)
    def _(x, criteria=criteria):
        rows = None
        for i, c in enumerate(criteria, start=1):
            hit = cohort.matching_persons(x.cdm, c, x.as_of).select(F.lit(i).alias("criterion"), "person_id")
            rows = hit if rows is None else rows.unionByName(hit)
        return rows


C = cohort.Criterion
_criterion("age_predicate", """SELECT 1 AS criterion, person_id FROM person WHERE 2020 - year_of_birth = 50
    UNION ALL SELECT 2, person_id FROM person WHERE 2020 - year_of_birth > 64
    UNION ALL SELECT 3, person_id FROM person WHERE 2020 - year_of_birth < 18
    UNION ALL SELECT 4, person_id FROM person WHERE 2020 - year_of_birth BETWEEN 30 AND 40""",
    C("age", "age", "equals", 50), C("age", "age", "greater_than", 64),
    C("age", "age", "less_than", 18), C("age", "age", "between", 30, 40))
_criterion("gender_predicate", """SELECT 1 AS criterion, person_id FROM person WHERE gender_concept_id = 8532
    UNION ALL SELECT 2, person_id FROM person WHERE gender_concept_id = 8507""",
    C("gender", "gender", "equals", "female"), C("gender", "gender", "equals", 8507))
_LATEST = """(SELECT person_id, value_as_number AS v FROM (SELECT *, row_number() OVER (PARTITION BY person_id
    ORDER BY measurement_datetime DESC, measurement_id) AS rn FROM meas WHERE measurement_concept_id = {}) WHERE rn = 1)"""
_criterion("lab_predicate", f"""SELECT 1 AS criterion, person_id FROM {_LATEST.format(3004410)} WHERE v > 7
    UNION ALL SELECT 2, person_id FROM {_LATEST.format(3000963)} WHERE v < 7
    UNION ALL SELECT 3, person_id FROM {_LATEST.format(3016723)} WHERE v BETWEEN 2 AND 5
    UNION ALL SELECT 4, person_id FROM {_LATEST.format(3004501)} WHERE v = 3""",
    C("lab_value", "hba1c", "greater_than", 7.0), C("lab_value", "hemoglobin", "less_than", 7.0),
    C("lab_value", "creatinine", "between", 2.0, 5.0), C("lab_value", "glucose", "equals", 3.0))
_criterion("condition_exists", """SELECT DISTINCT 1 AS criterion, person_id FROM cond WHERE condition_concept_id = 44054006
    UNION ALL SELECT DISTINCT 2, person_id FROM cond WHERE condition_concept_id IN (709044004, 46177005)""",
    C("diagnosis", "condition", "exists", "diabetes"), C("diagnosis", "condition", "in", ["ckd", "esrd"]))
_criterion("medication_exists", """SELECT DISTINCT 1 AS criterion, person_id FROM drug WHERE drug_concept_id = 950637
    UNION ALL SELECT DISTINCT 2, person_id FROM drug WHERE drug_concept_id = 1112807""",
    C("medication", "drug", "exists", "tacrolimus"), C("medication", "drug", "equals", 1112807))
_criterion("visit_exists", """SELECT DISTINCT 1 AS criterion, person_id FROM visit WHERE visit_concept_id = 9203
    UNION ALL SELECT DISTINCT 2, person_id FROM visit WHERE visit_concept_id = 9201""",
    C("visit_type", "visit", "exists", "emergency"), C("visit_type", "visit", "equals", "inpatient"))


@query("lab_critical", "SELECT measurement_id, person_id, lab, direction, value_as_number, unit FROM crit")
def _(x):
    return insights.critical_labs(x.cdm.measurement, "concept").select(
        "measurement_id", "person_id", "lab", "direction", "value_as_number", "unit")


@query("lab_critical_source_value", """SELECT measurement_id, l.lab, value_as_number
    FROM (SELECT m.*, coalesce(lab, measurement_source_value) AS named FROM meas m LEFT JOIN lab_names ON code = measurement_source_value) m
    JOIN (VALUES ('hemoglobin', 7.0, 20.0), ('potassium', 2.5, 6.5), ('sodium', 120.0, 160.0), ('glucose', 50.0, 500.0),
        ('creatinine', NULL, 10.0), ('platelets', 20.0, NULL)) AS l(lab, low, high)
    ON contains(lower(named), l.lab) AND (value_as_number < low OR value_as_number > high)""")
def _(x):
    """Results under the names of their labs, as sources without codes write them."""
    named = insights.lab_display(x.cdm.measurement).withColumn("measurement_source_value", F.col("lab_name"))
    return insights.critical_labs(named).select("measurement_id", "lab", "value_as_number")


# --- joins and linkage -----------------------------------------------------------------------


@query("token_attach", """SELECT observation_id, patient_token FROM fx_observation JOIN tmap USING (source_patient_id)""")
def _(x):
    return linkage.attach(x.observation, linkage.token_map(x.tokened)).select("observation_id", "patient_token")


_LINKED = """SELECT patient_token, count(*) AS source_records, count(DISTINCT source_system) AS source_systems_count,
    coalesce(any_value(e.n), 0) AS total_encounters, coalesce(any_value(o.n), 0) AS total_observations,
    cast(least(min(date_of_birth), any_value(e.lo)) AS varchar) AS earliest_record_date,
    cast(greatest(max(date_of_birth), any_value(e.hi)) AS varchar) AS latest_record_date
    FROM fx_patient JOIN tmap USING (source_patient_id)
    LEFT JOIN (SELECT patient_token, count(*) AS n, min(cast(admission_date AS date)) AS lo,
        max(cast(admission_date AS date)) AS hi FROM fx_encounter JOIN tmap USING (source_patient_id) GROUP BY 1) e
        USING (patient_token)
    LEFT JOIN (SELECT patient_token, count(*) AS n FROM fx_observation JOIN tmap USING (source_patient_id) GROUP BY 1) o
        USING (patient_token) GROUP BY patient_token"""


@query("link_patients", _LINKED)
def _(x):
    return linkage.linked_patient(x.tokened, x.encounter, x.observation)


@query("linked_record_assemble", """SELECT 'source_record' AS member, patient_token, source_patient_id AS id
    FROM fx_patient JOIN tmap USING (source_patient_id)
    UNION ALL SELECT 'encounter', patient_token, encounter_id FROM fx_encounter JOIN tmap USING (source_patient_id)
    UNION ALL SELECT 'observation', patient_token, observation_id FROM fx_observation JOIN tmap USING (source_patient_id)""")
def _(x):
    links = linkage.token_map(x.tokened)

    def member(rows, kind, column):
        return rows.select(F.lit(kind).alias("member"), "patient_token", F.col(column).alias("id"))

    return (member(linkage.linked_source_record(x.tokened), "source_record", "source_patient_id")
            .unionByName(member(linkage.attach(x.encounter, links), "encounter", "encounter_id"))
            .unionByName(member(linkage.attach(x.observation, links), "observation", "observation_id")))


@query("record_date_span", f"SELECT patient_token, earliest_record_date, latest_record_date FROM ({_LINKED})")
def _(x):
    return linkage.linked_patient(x.tokened, x.encounter, x.observation).select(
        "patient_token", "earliest_record_date", "latest_record_date")


@query("linkage_groups", """SELECT t.patient_token, record_count, src_ord, source_system, source_patient_id, mrn,
    first_name || ' ' || last_name AS name, cast(date_of_birth AS varchar) AS dob
    FROM fx_patient JOIN tmap t USING (source_patient_id)
    JOIN (SELECT patient_token, count(*) AS record_count FROM fx_patient JOIN tmap USING (source_patient_id)
          GROUP BY 1 HAVING count(*) > 1) g USING (patient_token)""")
def _(x):
    return linkage.linkage_groups(x.tokened)


@query("linkage_statistics", """SELECT count(*) AS total_unique_tokens, cast(sum(n) AS bigint) AS total_patient_records,
    count(*) FILTER (WHERE n > 1) AS patients_with_multi_system_records,
    round(sum(n) / count(*), 2) AS average_records_per_patient
    FROM (SELECT patient_token, count(DISTINCT source_patient_id) AS n FROM tok GROUP BY 1)""")
def _(x):
    return linkage.linkage_statistics(x.tokened)


@query("link_distribution", """SELECT n AS records, count(*) AS tokens FROM (
    SELECT patient_token, count(DISTINCT source_patient_id) AS n FROM tok GROUP BY 1) GROUP BY 1""")
def _(x):
    return linkage.link_distribution(x.tokened)


@query("token_lookup", """SELECT DISTINCT patient_token, source_patient_id FROM tok""")
def _(x):
    return linkage.token_lookup(x.tokened)


@query("linkage_check", """SELECT person, count(*) AS records_found, count(DISTINCT patient_token) AS unique_tokens_generated,
    count(DISTINCT patient_token) = 1 AS successfully_linked,
    CASE WHEN count(DISTINCT patient_token) = 1 THEN min(patient_token) END AS common_token
    FROM (SELECT *, src_ord - CASE WHEN src_ord % 10 < 4 THEN src_ord % 10 ELSE 0 END AS person FROM tok) GROUP BY 1""")
def _(x):
    key = F.col("src_ord")
    person = key - F.when(key % 10 < 4, key % 10).otherwise(0)
    return linkage.linkage_check(x.tokened.withColumn("person", person), ["person"])


@query("dataset_summary", """SELECT (SELECT count(*) FROM fx_patient) AS total_patient_records,
    (SELECT count(DISTINCT patient_token) FROM tmap) AS unique_individuals,
    (SELECT count(*) FROM fx_encounter) AS total_encounters,
    (SELECT count(*) FROM fx_observation) AS total_observations""")
def _(x):
    return analytics.dataset_summary(x.tokened, x.encounter, x.observation)


def _lookup_query(key, sql, build):
    query(key, sql)(build)


_lookup_query("icd_to_snomed", r"""SELECT encounter_id, icd_code, coalesce(cid, 0) AS concept_id FROM (
    SELECT encounter_id, nullif(regexp_extract(admission_diagnosis, '\(([A-Z]\d{2}\.?\d*)\)', 1), '') AS icd_code
    FROM fx_encounter) LEFT JOIN icd ON icd_code = code""",
    lambda x: cdm.icd_to_snomed(x.encounter.select(
        "encounter_id", nz.icd_code(F.col("admission_diagnosis")).alias("icd_code"))).select(
        "encounter_id", "icd_code", F.col("condition_concept_id").alias("concept_id")))
_lookup_query("loinc_to_concept", """SELECT observation_id, observation_code, coalesce(cid, 0) AS concept_id
    FROM fx_observation LEFT JOIN loinc ON observation_code = code WHERE observation_type = 'lab_result'""",
    lambda x: cdm.loinc_to_concept(x.observation.where("observation_type = 'lab_result'").select(
        "observation_id", "observation_code")).select(
        "observation_id", "observation_code", F.col("measurement_concept_id").alias("concept_id")))
_lookup_query("rxnorm_to_concept", """SELECT observation_id, observation_code, coalesce(cid, 0) AS concept_id
    FROM fx_observation LEFT JOIN rxn ON observation_code = code WHERE observation_type = 'medication'""",
    lambda x: cdm.rxnorm_to_concept(x.observation.where("observation_type = 'medication'").select(
        "observation_id", "observation_code")).select(
        "observation_id", "observation_code", F.col("drug_concept_id").alias("concept_id")))


@query("region_lookup", """SELECT person_id, coalesce(r, 'Unknown') AS region FROM person
    JOIN (SELECT patient_token, region AS r, row_number() OVER (
        PARTITION BY patient_token ORDER BY src_ord DESC) AS rn FROM dp) ON patient_token = person_source_value
    WHERE rn = 1""")
def _(x):
    return analytics.region_lookup(x.cdm, x.people).select("person_id", "region")


@query("drug_interaction", "SELECT person_id, drug1, drug2, warning FROM interactions")
def _(x):
    return insights.drug_interactions(x.cdm.drug_exposure).select("person_id", "drug1", "drug2", "warning")


@query("drug_lab_interaction", """SELECT person_id, measurement_id, value_as_number FROM (
    SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY measurement_id) AS rn FROM meas
    WHERE measurement_concept_id = 3016723 AND value_as_number > 4.0
      AND person_id IN (SELECT person_id FROM taken WHERE drug = 'metformin')) WHERE rn = 1""")
def _(x):
    return insights.metformin_creatinine(x.cdm.drug_exposure, x.cdm.measurement, "concept").select(
        "person_id", "measurement_id", "value_as_number")


# --- ordered operators -----------------------------------------------------------------------


@query("latest_measurement", """SELECT person_id, measurement_source_value, measurement_id, value_as_number,
    cast(measurement_datetime AS varchar) AS measurement_datetime FROM latest""")
def _(x):
    return cohort.latest_measurement(x.cdm.measurement, ["person_id", "measurement_source_value"]).select(
        "person_id", "measurement_source_value", "measurement_id", "value_as_number", "measurement_datetime")


@query("lab_trend", "SELECT person_id, measurement_source_value, n, first_value, last_value, direction, unit FROM trend")
def _(x):
    return insights.lab_trends(x.cdm)


@query("lab_trend_values", """SELECT s.person_id, s.measurement_source_value, s.measurement_id,
    round(s.value_as_number, 2) AS value, t.n FROM steps s JOIN trend t USING (person_id, measurement_source_value)""")
def _(x):
    found = insights.lab_trends(x.cdm)
    return insights.trend_values(x.cdm.measurement, found).drop("measurement_datetime")


@query("recommendation_lookup", "SELECT person_id, measurement_source_value, direction, advice AS actions FROM trend_actions")
def _(x):
    return insights.trend_actions(insights.lab_display(insights.lab_trends(x.cdm))).select(
        "person_id", "measurement_source_value", "direction", joined("actions"))


@query("first_per_key", """SELECT patient_token, arg_min(source_patient_id, src_ord) AS source_patient_id FROM tok GROUP BY 1""")
def _(x):
    from clinspan.operators.ids import first_row
    return first_row(x.tokened, ["patient_token"], [F.col("src_ord")]).select("patient_token", "source_patient_id")


@query("surrogate_name", "SELECT source_patient_id, surrogate_id FROM names")
def _(x):
    return deid.surrogate_names(x.patient).select("source_patient_id", "surrogate_id")


@query("person_id", "SELECT patient_token, person_id FROM pidx")
def _(x):
    return cdm.person_index(x.deid_patient, x.deid_encounter, x.deid_observation)


_KEPT = "row_number() OVER (ORDER BY sha256(patient_token))"


@query("remembered_ids", f"""SELECT patient_token, {_KEPT} AS id FROM (SELECT DISTINCT patient_token FROM tok WHERE src_ord % 3 <> 0)
    UNION ALL SELECT patient_token, {_KEPT} + (SELECT count(DISTINCT patient_token) FROM tok WHERE src_ord % 3 <> 0) AS id
    FROM (SELECT DISTINCT patient_token FROM tok WHERE patient_token NOT IN (SELECT patient_token FROM tok WHERE src_ord % 3 <> 0))""")
def _(x):
    """Ids of the tokens of two uploads: those of the first stay when all records come."""
    folder = shared_dir("id_map")
    first = x.tokened.where(F.col("src_ord") % 3 != 0)
    ids.remembered_ids(first, "patient_token", folder, "id")
    return ids.remembered_ids(x.tokened, "patient_token", folder, "id")


@query("row_ids", """SELECT encounter_id AS source, row_number() OVER (ORDER BY encounter_id) AS id FROM de
    UNION ALL SELECT observation_id, row_number() OVER (ORDER BY observation_id) FROM dob""")
def _(x):
    from clinspan.operators.ids import dense_id
    visits = dense_id(x.deid_encounter.select(F.col("encounter_id").alias("source")), F.col("source"), "id")
    results = dense_id(x.deid_observation.select(F.col("observation_id").alias("source")), F.col("source"), "id")
    return visits.unionByName(results)


# --- de-identification -----------------------------------------------------------------------


@query("deid_patient", """SELECT src_ord, patient_token, source_system, surrogate_id, year_of_birth, age_group,
    age_at_data_collection, gender, region FROM dp""")
def _(x):
    return x.deid_patient.drop("person_id")


_ENC = """encounter_id, patient_token, source_system, encounter_type, cast(admission_date AS varchar) AS admission_date,
    cast(discharge_date AS varchar) AS discharge_date, department, chief_complaint, admission_diagnosis,
    discharge_diagnosis, clinical_notes, temperature_celsius, heart_rate_bpm, blood_pressure_systolic,
    blood_pressure_diastolic, respiratory_rate, oxygen_saturation, weight_kg, height_cm"""


@query("deid_encounter", f"SELECT {_ENC} FROM de")
def _(x):
    return x.deid_encounter.select("*", "vitals.*").drop("person_id", "vitals")


@query("deid_observation", """SELECT * EXCLUDE (person_id, observation_datetime),
    cast(observation_datetime AS varchar) AS observation_datetime FROM dob""")
def _(x):
    return x.deid_observation.drop("person_id")


@query("note_redact", f"SELECT encounter_id, {_redact('safe')} AS redacted FROM fx_encounter")
def _(x):
    return x.encounter.select("encounter_id", redact_note(F.col("clinical_notes")).alias("redacted"))


@query("note_redact_legacy", f"SELECT encounter_id, {_redact('legacy')} AS redacted FROM fx_encounter")
def _(x):
    return x.encounter.select("encounter_id", redact_note(F.col("clinical_notes"), "legacy").alias("redacted"))


@query("deid_report", """SELECT (SELECT count(*) FROM dp) AS total_patients_deidentified,
    (SELECT count(DISTINCT source_patient_id) FROM (SELECT source_patient_id FROM fx_patient
        UNION ALL SELECT source_patient_id FROM fx_encounter UNION ALL SELECT source_patient_id FROM fx_observation)
        JOIN tmap USING (source_patient_id)) AS total_date_shifts_applied,
    (SELECT count(*) FROM names WHERE surrogate_id LIKE '%_M%') AS male_surrogates,
    (SELECT count(*) FROM names WHERE surrogate_id LIKE '%_F%') AS female_surrogates,
    'PDPL-Compliant + HiPS' AS method, 18 AS identifier_categories, -365 AS date_shift_low, 365 AS date_shift_high,
    89 AS age_threshold, true AS surrogate_names, true AS location_generalization, true AS clinical_notes_redaction""")
def _(x):
    return deid.deid_report(x.patient, x.encounter, x.observation, x.links, x.deid_config)


@query("deid_action_summary", """SELECT action, count(*) AS count FROM (
    SELECT unnest(['replaced_name_with_surrogate', 'removed_direct_identifiers',
        CASE WHEN age_group IS NOT NULL THEN 'generalized_age_over_89' ELSE 'shifted_dates_year_only' END,
        'removed_contact_info', CASE WHEN region IS NOT NULL THEN 'generalized_location_to_region' END,
        'removed_mrn_used_token']) AS action FROM dp) WHERE action IS NOT NULL GROUP BY 1""")
def _(x):
    return deid.action_summary(x.deid_patient, x.deid_config)


@query("deid_before_after", """SELECT p.src_ord, trim(concat_ws(' ', first_name, middle_name, last_name), '') AS name, national_id,
    cast(date_of_birth AS varchar) AS date_of_birth, phone_number AS phone, email,
    address_line1 || ', ' || city || ', ' || coalesce(p.region, 'None') AS address, mrn,
    'Full name (first, middle, last); National ID (Iqama); Exact date of birth (month + day); Phone number'
        || CASE WHEN email IS NOT NULL THEN '; Email address' ELSE '' END
        || '; Street address; City; Postal code; Medical record number (MRN)' AS phi_removed,
    CASE WHEN email IS NOT NULL THEN 9 ELSE 8 END AS identifiers_removed_count,
    patient_token, surrogate_id, year_of_birth, age_group, dp.region AS kept_region
    FROM fx_patient p JOIN dp ON p.src_ord = dp.src_ord""")
def _(x):
    rows = deid.before_after(x.patient, x.links, x.deid_config)
    return rows.select(*[c for c in rows.columns if c != "phi_removed"], joined("phi_removed"))


@query("deid_before_after_upload", """SELECT name, date_of_birth, cast(year_of_birth AS varchar) AS year_of_birth, n FROM (
    SELECT trim(first_name) || ' ' || trim(last_name) AS name, cast(born AS varchar) AS date_of_birth, year(born) AS year_of_birth, 1 AS n
    FROM (SELECT *, CASE WHEN patient_id = '' THEN 'k' || row_key ELSE patient_id END AS who FROM fx_csv
          WHERE trim(first_name) <> '' AND trim(last_name) <> '' AND trim(date_of_birth) NOT IN ('31/31/1999', ''))
    GROUP BY who, first_name, last_name, born)""")
def _(x):
    """Each patient of an upload of several files next to the birth year of the same record."""
    still = replace(x.deid_config, date_shift_range=(0, 0), age_threshold=200)
    people = x.ingested.patients
    links = linkage.token_map(linkage.with_token(people, x.tokens_config))
    return deid.before_after(people, links, still).select(
        "name", "date_of_birth", F.col("year_of_birth").cast("string").alias("year_of_birth"), F.lit(1).alias("n"))


@query("deid_csv_write", """SELECT patient_token, surrogate_id, gender, cast(year_of_birth AS varchar) AS year_of_birth,
    CAST(NULL AS varchar) AS month_of_birth, cast(age_at_data_collection AS varchar) AS age_at_data_collection, region,
    de.source_system, encounter_id, encounter_type, strftime(admission_date, '%Y-%m-%dT%H:%M:%S') AS admission_date,
    strftime(discharge_date, '%Y-%m-%dT%H:%M:%S') AS discharge_date, department, chief_complaint, admission_diagnosis,
    clinical_notes FROM de LEFT JOIN (
    SELECT * EXCLUDE (source_system) FROM (SELECT *, row_number() OVER (PARTITION BY patient_token ORDER BY src_ord DESC) AS rn
        FROM dp) WHERE rn = 1) USING (patient_token)""")
def _(x):
    folder = shared_dir("deid_csv")
    export.write_deid_csv(export.deid_csv_rows(x.deid_patient, x.deid_encounter), folder)
    return x.spark.read.options(header=True, escape='"').csv(folder)


# --- CDM -------------------------------------------------------------------------------------


@query("omop_person", "SELECT * FROM person")
def _(x):
    return x.mapped.person


@query("omop_visit", """SELECT visit_occurrence_id, person_id, visit_concept_id, cast(visit_start_date AS varchar) AS visit_start_date,
    cast(visit_start_datetime AS varchar) AS visit_start_datetime, cast(visit_end_date AS varchar) AS visit_end_date,
    cast(visit_end_datetime AS varchar) AS visit_end_datetime, visit_type_concept_id, visit_source_value FROM visit""")
def _(x):
    return x.mapped.visit_occurrence


@query("omop_condition", """SELECT * REPLACE (cast(condition_start_date AS varchar) AS condition_start_date,
    cast(condition_start_datetime AS varchar) AS condition_start_datetime) FROM cond""")
def _(x):
    return x.mapped.condition_occurrence


@query("omop_measurement", """SELECT * REPLACE (cast(measurement_date AS varchar) AS measurement_date,
    cast(measurement_datetime AS varchar) AS measurement_datetime) FROM meas""")
def _(x):
    return x.mapped.measurement


@query("omop_drug", """SELECT * REPLACE (cast(drug_exposure_start_date AS varchar) AS drug_exposure_start_date,
    cast(drug_exposure_start_datetime AS varchar) AS drug_exposure_start_datetime,
    cast(drug_exposure_end_date AS varchar) AS drug_exposure_end_date) FROM drug""")
def _(x):
    return x.mapped.drug_exposure


_REPORT = """SELECT 'patient -> person' AS transformation, count(*) AS rows, CAST(NULL AS bigint) AS mapped FROM dp
    UNION ALL SELECT 'encounter -> visit_occurrence', count(*), NULL FROM visit
    UNION ALL SELECT 'diagnosis -> condition_occurrence', count(*), count(*) FILTER (WHERE condition_concept_id <> 0) FROM cond
    UNION ALL SELECT 'lab_result -> measurement', count(*), count(*) FILTER (WHERE measurement_concept_id <> 0) FROM meas
    UNION ALL SELECT 'medication -> drug_exposure', count(*), count(*) FILTER (WHERE drug_concept_id <> 0) FROM drug"""


@query("omop_report", _REPORT)
def _(x):
    return cdm.cdm_report(x.people, x.cdm)


@query("omop_mapping_demo", r"""SELECT 'patient' AS data_type, 'PERSON' AS omop_table, patient_token AS source_id,
    CASE gender WHEN 'male' THEN 8507 WHEN 'female' THEN 8532 ELSE 8551 END AS concept_id,
    'Gender ''' || gender || ''' -> concept_id ' || CASE gender WHEN 'male' THEN 8507 WHEN 'female' THEN 8532 ELSE 8551 END
        || '; Token -> person_source_value' AS mappings_applied FROM dp
    UNION ALL SELECT 'encounter', 'VISIT_OCCURRENCE', visit_source_value, visit_concept_id,
    'Type ''' || encounter_type || ''' -> concept_id ' || visit_concept_id
        || coalesce('; ICD-10 ''' || icd_code || ''' -> SNOMED concept_id ' || coalesce(cid, 0), '')
    FROM (SELECT visit_source_value, visit_concept_id, encounter_type,
        nullif(regexp_extract(de.admission_diagnosis, '\(([A-Z]\d{2}\.?\d*)\)', 1), '') AS icd_code
        FROM visit JOIN de ON encounter_id = visit_source_value) LEFT JOIN icd ON icd_code = code
    UNION ALL SELECT 'lab_result', 'MEASUREMENT', observation_id, coalesce(cid, 0),
    'LOINC ''' || observation_code || ''' -> concept_id ' || coalesce(cid, 0)
    FROM dob LEFT JOIN loinc ON observation_code = code WHERE observation_type = 'lab_result' AND observation_code <> ''
    UNION ALL SELECT 'medication', 'DRUG_EXPOSURE', observation_id, coalesce(cid, 0),
    'RxNorm ''' || observation_code || ''' -> concept_id ' || coalesce(cid, 0)
    FROM dob LEFT JOIN rxn ON observation_code = code WHERE observation_type = 'medication' AND observation_code <> ''""")
def _(x):
    rows = cdm.mapping_demo(x.deid_patient, x.deid_encounter, x.deid_observation)
    return rows.select("data_type", "omop_table", "source_id", "concept_id", joined("mappings_applied"))


# --- cohorts ---------------------------------------------------------------------------------

_MEMBERS = {
    "all_patients": "SELECT person_id FROM person",
    "diabetic_patients": "SELECT DISTINCT person_id FROM cond WHERE condition_concept_id = 44054006",
    "ckd_on_dialysis": "SELECT DISTINCT person_id FROM cond WHERE condition_concept_id IN (709044004, 46177005)",
    "transplant_patients": "SELECT DISTINCT person_id FROM drug WHERE drug_concept_id = 950637",
    "oncology_patients": "SELECT DISTINCT person_id FROM cond WHERE condition_concept_id IN (93143009, 254837009, 118601006)",
    "elderly_cardiac": """SELECT person_id FROM person WHERE 2020 - year_of_birth > 64 AND person_id IN (
        SELECT person_id FROM cond WHERE condition_concept_id = 84114007)""",
}
for _name, _sql in _MEMBERS.items():
    query(f"cohort_{_name}", _sql)(
        lambda x, name=_name: cohort.members(x.cdm, cohort.named_cohort(name), x.as_of))

_TRIAL = cohort.Cohort(
    "Diabetics without transplant or lymphoma", "Adult diabetics without tacrolimus or lymphoma",
    [C("diagnosis", "condition", "exists", "diabetes"), C("age", "age", "between", 18, 95)],
    [C("diagnosis", "condition", "in", ["lymphoma", "leukemia"]), C("medication", "drug", "exists", "tacrolimus")])
_IN = """(SELECT person_id FROM person WHERE 2020 - year_of_birth BETWEEN 18 AND 95 AND person_id IN (
    SELECT person_id FROM cond WHERE condition_concept_id = 44054006))"""
_OUT = """(SELECT person_id FROM cond WHERE condition_concept_id IN (118601006, 93143009) UNION
    SELECT person_id FROM drug WHERE drug_concept_id = 950637)"""


@query("include_all", f"SELECT person_id FROM {_IN}")
def _(x):
    return cohort.included(x.cdm, _TRIAL, x.as_of)


@query("exclude_any", f"SELECT person_id FROM {_IN} WHERE person_id IN {_OUT}")
def _(x):
    return cohort.excluded(x.cdm, _TRIAL, x.as_of)


@query("cohort_exclusion", f"SELECT person_id FROM {_IN} WHERE person_id NOT IN {_OUT}")
def _(x):
    return cohort.members(x.cdm, _TRIAL, x.as_of)


def _stats_sql(members: str) -> str:
    return f"""SELECT count(*) AS total_count, count(*) FILTER (WHERE gender_concept_id = 8507) AS male_count,
    count(*) FILTER (WHERE gender_concept_id = 8532) AS female_count,
    round(count(*) FILTER (WHERE gender_concept_id = 8507) / count(*) * 100, 1) AS male_percentage,
    round(sum(2020 - year_of_birth) / count(*), 1) AS age_mean, min(2020 - year_of_birth) AS age_min,
    max(2020 - year_of_birth) AS age_max, cast(sum(coalesce(v, 0)) AS bigint) AS total_visits,
    round(sum(coalesce(v, 0)) / count(*), 1) AS visits_per_person, cast(sum(coalesce(c, 0)) AS bigint) AS total_conditions,
    round(sum(coalesce(c, 0)) / count(*), 1) AS conditions_per_person, CAST(NULL AS varchar) AS error
    FROM person LEFT JOIN (SELECT person_id, count(*) AS v FROM visit GROUP BY 1) USING (person_id)
    LEFT JOIN (SELECT person_id, count(*) AS c FROM cond GROUP BY 1) USING (person_id)
    WHERE person_id IN ({members})"""


@query("cohort_statistics", _stats_sql(_MEMBERS["diabetic_patients"]))
def _(x):
    return cohort.statistics(x.cdm, cohort.members(x.cdm, cohort.named_cohort("diabetic_patients")), x.as_of)


@query("cohort_build", f"""SELECT '{_TRIAL.name}' AS cohort_name, '{_TRIAL.description}' AS description,
    total_count AS member_count, *, 'diagnosis.condition exists diabetes; age.age between 18' AS inclusion,
    'diagnosis.condition in lymphoma,leukemia; medication.drug exists tacrolimus' AS exclusion
    FROM ({_stats_sql(f"SELECT person_id FROM {_IN} WHERE person_id NOT IN {_OUT}")})""")
def _(x):
    return cohort.build(x.cdm, _TRIAL, x.as_of)


_RUNS = [(cohort.NAMED_COHORTS[n].name, m) for n, m in _MEMBERS.items()] * 2


@query("run_log", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT {i} AS run, '{name}' AS cohort_name, (SELECT count(*) FROM person) AS total_persons,
    (SELECT count(*) FROM ({sql})) AS included, CAST(0 AS bigint) AS excluded, (SELECT count(*) FROM ({sql})) AS final_cohort"""
    for i, (name, sql) in enumerate(_RUNS, start=1)) + f") WHERE run > {len(_RUNS) - 10}")
def _(x):
    """Every named cohort twice, which is more than a report shows; the run is logged again, which changes nothing."""
    folder = shared_dir("run_log")
    named = [cohort.NAMED_COHORTS[n] for n in _MEMBERS] * 2
    for _ in range(2):
        cohort.append_log(cohort.run_log(x.cdm, named, x.as_of), folder, "named")
    return cohort.recent_runs(cohort.read_log(folder)).drop("batch", "run_id")


@query("analysis_log", """SELECT 'all' AS item, '' AS patient_token, count(*) AS n FROM person
    UNION ALL SELECT 'recent', person_source_value, coalesce(n, 0) FROM person
        LEFT JOIN (SELECT person_id, count(*) AS n FROM findings GROUP BY 1) USING (person_id)
        WHERE person_id > (SELECT max(person_id) - 5 FROM person)""")
def _(x):
    folder = shared_dir("analysis_log")
    cohort.append_log(insights.analysis_log(x.cdm, "concept"), folder, "all")
    log = cohort.read_log(folder)
    total = log.agg(F.lit("all").alias("item"), F.lit("").alias("patient_token"), F.count("*").alias("n"))
    return total.unionByName(cohort.recent_runs(log, 5).select(
        F.lit("recent").alias("item"), "patient_token", F.col("insights_generated").alias("n")))


# --- analytics -------------------------------------------------------------------------------


@query("analytics_totals", """SELECT (SELECT count(*) FROM person) AS total_persons, (SELECT count(*) FROM visit) AS total_visits,
    (SELECT count(*) FROM cond) AS total_conditions, (SELECT count(*) FROM meas) AS total_measurements,
    (SELECT count(*) FROM drug) AS total_drug_exposures""")
def _(x):
    return analytics.totals(x.cdm)


@query("condition_frequency", "SELECT condition_concept_id AS concept_id, count(*) AS count FROM cond GROUP BY 1")
def _(x):
    return analytics.frequency(x.cdm.condition_occurrence, "condition_concept_id")


@query("drug_frequency", "SELECT drug_concept_id AS concept_id, count(*) AS count FROM drug GROUP BY 1")
def _(x):
    return analytics.frequency(x.cdm.drug_exposure, "drug_concept_id")


TOP_CONDITIONS = """SELECT concept_id, count, coalesce(label, 'SNOMED ' || concept_id) AS name FROM (
    SELECT condition_concept_id AS concept_id, count(*) AS count FROM cond GROUP BY 1
    ORDER BY count DESC, concept_id LIMIT 10) LEFT JOIN condition_names ON cid = concept_id"""


@query("top_conditions", TOP_CONDITIONS)
def _(x):
    return analytics.top_conditions(x.cdm)


@query("top_medications", """SELECT concept_id, count, coalesce(label, 'RxNorm ' || concept_id) AS name FROM (
    SELECT drug_concept_id AS concept_id, count(*) AS count FROM drug GROUP BY 1
    ORDER BY count DESC, concept_id LIMIT 10) LEFT JOIN alias_names ON cid = concept_id""")
def _(x):
    return analytics.top_medications(x.cdm)


@query("top5_percent_conditions", """SELECT name, count, cast(round(count / (SELECT count(*) FROM cond) * 100, 1) AS varchar) || '%' AS percentage
    FROM (SELECT coalesce(label, 'ICD-10 ' || condition_source_value) AS name, count(*) AS count FROM cond
    LEFT JOIN condition_names ON cid = condition_concept_id GROUP BY 1 ORDER BY count DESC, name LIMIT 5)""")
def _(x):
    return analytics.top_condition_shares(x.cdm)


@query("top5_percent_medications", """SELECT name, count, cast(round(count / (SELECT count(*) FROM drug) * 100, 1) AS varchar) || '%' AS percentage
    FROM (SELECT coalesce(cname, 'RxNorm ' || drug_source_value) AS name, count(*) AS count FROM drug
    LEFT JOIN rxn ON cid = drug_concept_id GROUP BY 1 ORDER BY count DESC, name LIMIT 5)""")
def _(x):
    return analytics.top_medication_shares(x.cdm)


@query("patient_list", """SELECT person_id, 2020 - year_of_birth AS age,
    CASE gender_concept_id WHEN 8507 THEN 'Male' WHEN 8532 THEN 'Female' ELSE 'Unknown' END AS gender,
    coalesce(r, 'Unknown') AS region, 'Patient ' || person_id || ' (' || (2020 - year_of_birth) || 'y '
    || CASE gender_concept_id WHEN 8507 THEN 'M' WHEN 8532 THEN 'F' ELSE 'U' END || ', '
    || coalesce(r, 'Unknown') || ')' AS display_name
    FROM person JOIN (SELECT patient_token, region AS r, row_number() OVER (
        PARTITION BY patient_token ORDER BY src_ord DESC) AS rn FROM dp) ON patient_token = person_source_value
    WHERE rn = 1 ORDER BY person_id""")
def _(x):
    return analytics.patient_list(x.cdm, x.people, x.as_of)


_QUALITY = """SELECT 'demographics_completeness' AS metric, 'Demographics Completeness' AS name,
    count(*) FILTER (WHERE gender_concept_id <> 0 AND year_of_birth <> 0) AS numerator, greatest(count(*), 1) AS denominator, 90 AS t FROM person
    UNION ALL SELECT 'snomed_mapping', 'Diagnosis → SNOMED Mapping', count(*) FILTER (WHERE condition_concept_id > 0), greatest(count(*), 1), 80 FROM cond
    UNION ALL SELECT 'loinc_mapping', 'Labs → LOINC Mapping', count(*) FILTER (WHERE measurement_concept_id > 0), greatest(count(*), 1), 80 FROM meas
    UNION ALL SELECT 'rxnorm_mapping', 'Medications → RxNorm Mapping', count(*) FILTER (WHERE drug_concept_id > 0), greatest(count(*), 1), 80 FROM drug"""


@query("data_quality", f"""SELECT metric, name, numerator, denominator, round(numerator / denominator * 100, 1) AS rate,
    CASE WHEN round(numerator / denominator * 100, 1) >= t THEN 'good' ELSE 'needs_attention' END AS status FROM ({_QUALITY})""")
def _(x):
    return analytics.data_quality(x.cdm)


@query("data_quality_score", f"SELECT round(sum(round(numerator / denominator * 100, 1)) / 4, 1) AS overall_quality_score FROM ({_QUALITY})")
def _(x):
    return analytics.data_quality_score(x.cdm)


_MEASURES = """SELECT * FROM (
    SELECT 'diabetes_hba1c_monitoring' AS metric, 'Diabetes HbA1c Monitoring' AS name, '% of diabetic patients with HbA1c documented' AS description, 90 AS target,
        (SELECT count(*) FROM (SELECT DISTINCT person_id FROM cond WHERE regexp_matches(lower(condition_source_value), 'diabetes|e11'))) AS d,
        (SELECT count(DISTINCT person_id) FROM meas WHERE regexp_matches(lower(measurement_source_value), 'hba1c|4548-4')
            AND person_id IN (SELECT person_id FROM cond WHERE regexp_matches(lower(condition_source_value), 'diabetes|e11'))) AS numerator
    UNION ALL SELECT 'hypertension_bp_control', 'Hypertension BP Control', '% of hypertensive patients with BP < 140/90', 70,
        (SELECT count(*) FROM (SELECT DISTINCT person_id FROM cond WHERE regexp_matches(lower(condition_source_value), 'hypertension|i10'))),
        (SELECT count(DISTINCT person_id) FROM meas WHERE regexp_matches(lower(measurement_source_value), 'systolic') AND value_as_number < 140
            AND person_id IN (SELECT person_id FROM cond WHERE regexp_matches(lower(condition_source_value), 'hypertension|i10')))
    UNION ALL SELECT 'ckd_monitoring', 'CKD Monitoring', '% of CKD patients with eGFR/creatinine monitoring', 85,
        (SELECT count(*) FROM (SELECT DISTINCT person_id FROM cond WHERE regexp_matches(lower(condition_source_value), 'chronic kidney|ckd|n18'))),
        (SELECT count(DISTINCT person_id) FROM meas WHERE regexp_matches(lower(measurement_source_value), 'egfr|creatinine')
            AND person_id IN (SELECT person_id FROM cond WHERE regexp_matches(lower(condition_source_value), 'chronic kidney|ckd|n18')))
    UNION ALL SELECT 'heart_failure_acei', 'Heart Failure ACE/ARB Therapy', '% of HF patients on ACE inhibitor or ARB', 80,
        (SELECT count(*) FROM (SELECT DISTINCT person_id FROM cond WHERE regexp_matches(lower(condition_source_value), 'heart failure|i50'))),
        (SELECT count(DISTINCT person_id) FROM drug WHERE regexp_matches(lower(drug_source_value), 'lisinopril|enalapril|ramipril|losartan|valsartan')
            AND person_id IN (SELECT person_id FROM cond WHERE regexp_matches(lower(condition_source_value), 'heart failure|i50'))))"""


@query("quality_metrics", f"""SELECT metric, name, description, target, numerator, greatest(d, 1) AS denominator,
    round(numerator / greatest(d, 1) * 100, 1) AS rate,
    CASE WHEN numerator / greatest(d, 1) >= target / 100 THEN 'met' ELSE 'gap' END AS status FROM ({_MEASURES})""")
def _(x):
    return insights.quality_metrics(x.cdm)


_OVERVIEW = f"""SELECT round(sum(round(numerator / greatest(d, 1) * 100, 1)) / 4, 1) AS overall_quality_score,
    count(*) FILTER (WHERE numerator / greatest(d, 1) < target / 100) AS gaps_identified,
    count(*) FILTER (WHERE numerator / greatest(d, 1) >= target / 100) AS metrics_met,
    (SELECT count(*) FROM person) AS total_patients FROM ({_MEASURES})"""


@query("quality_overview", _OVERVIEW)
def _(x):
    return insights.quality_overview(x.cdm)


def _readmission(creatinine: str, potassium: str, hemoglobin: str) -> str:
    return f"""SELECT person_id, score AS readmission_risk_score,
    CASE WHEN score >= 16 THEN 'High' WHEN score >= 6 THEN 'Medium' ELSE 'Low' END AS risk_level,
    CASE WHEN score >= 16 THEN 'red' WHEN score >= 6 THEN 'orange' ELSE 'green' END AS color,
    concat_ws('; ', CASE WHEN i >= 2 THEN 'Frequent Hospitalizations: ' || i || ' admissions' END,
        CASE WHEN dr >= 5 THEN 'Polypharmacy: ' || dr || ' medications' END,
        CASE WHEN co >= 3 THEN 'Multiple Comorbidities: ' || co || ' conditions' END,
        CASE WHEN cr THEN 'Critical Lab Values: Abnormal values detected' END,
        CASE WHEN age > 75 THEN 'Advanced Age: Age ' || age END) AS risk_factors,
    CASE WHEN score >= 16 THEN 'Consider care management enrollment' ELSE 'Standard follow-up' END AS recommendation
    FROM (SELECT *, CASE WHEN i >= 2 THEN 10 ELSE 0 END + CASE WHEN dr >= 5 THEN 5 ELSE 0 END
        + CASE WHEN co >= 3 THEN 5 ELSE 0 END + CASE WHEN cr THEN 5 ELSE 0 END + CASE WHEN age > 75 THEN 3 ELSE 0 END AS score
      FROM (SELECT person_id, 2020 - year_of_birth AS age, coalesce(inpatient, 0) AS i, coalesce(dr, 0) AS dr,
        coalesce(co, 0) AS co, coalesce(cr, false) AS cr FROM person LEFT JOIN vcount USING (person_id)
      LEFT JOIN (SELECT person_id, count(DISTINCT drug_source_value) AS dr FROM drug GROUP BY 1) USING (person_id)
      LEFT JOIN (SELECT person_id, count(DISTINCT condition_source_value) AS co FROM cond GROUP BY 1) USING (person_id)
      LEFT JOIN (SELECT person_id, bool_or(value_as_number <> 0 AND (({creatinine} AND value_as_number > 4)
            OR ({potassium} AND (value_as_number < 3 OR value_as_number > 6))
            OR ({hemoglobin} AND value_as_number < 8))) AS cr FROM meas GROUP BY 1) USING (person_id)))"""


_BY_ID = _readmission(*[f"measurement_concept_id = {i}" for i in (3016723, 3023103, 3000963)])
_BY_TEXT = _readmission(*[f"contains(lower(measurement_source_value), '{n}')"
                          for n in ("creatinine", "potassium", "hemoglobin")])


def _risk_rows(rows):
    factors = F.transform("risk_factors", lambda f: F.concat(f["factor"], F.lit(": "), f["detail"]))
    return rows.withColumn("risk_factors", F.array_join(factors, "; "))


@query("readmission_risk", _BY_TEXT)
def _(x):
    return _risk_rows(insights.readmission_risk(x.cdm, x.as_of))


@query("readmission_risk_concept", _BY_ID)
def _(x):
    return _risk_rows(insights.readmission_risk(x.cdm, x.as_of, "concept"))


@query("executive_summary", f"""SELECT p AS unique_patients, s AS source_records_ingested, greatest(s - p, 0) AS duplicate_records_linked,
    (SELECT count(*) FROM visit) AS total_visits, (SELECT count(*) FROM cond) AS total_conditions,
    (SELECT count(*) FROM meas) AS total_lab_results, (SELECT count(*) FROM drug) AS total_medications,
    overall_quality_score AS quality_score, gaps_identified, metrics_met, h AS high_risk_patients,
    cast(round(h / greatest(p, 1) * 100, 1) AS varchar) || '%' AS high_risk_percentage
    FROM (SELECT (SELECT count(*) FROM person) AS p, (SELECT count(*) FROM fx_patient) AS s,
        (SELECT count(*) FROM ({_BY_TEXT}) WHERE risk_level = 'High') AS h), ({_OVERVIEW})""")
def _(x):
    return analytics.executive_summary(x.cdm, x.patient, x.as_of)


# --- findings --------------------------------------------------------------------------------


@query("diabetes_control", "SELECT person_id, value_as_number, controlled FROM control")
def _(x):
    return insights.diabetes_control(x.cdm.condition_occurrence, x.cdm.measurement).select(
        "person_id", "value_as_number", "controlled")


@query("frequent_visits", """SELECT person_id, 'Frequent Emergency Visits' AS title,
    'Patient has ' || emergency || ' emergency department visits' AS description,
    'ED visits: ' || emergency || '; Total visits: ' || visits AS evidence FROM vcount WHERE emergency >= 2
    UNION ALL SELECT person_id, 'Frequent Hospitalizations', 'Patient has ' || inpatient || ' inpatient admissions',
    'Inpatient admissions: ' || inpatient FROM vcount WHERE inpatient >= 2""")
def _(x):
    return insights.frequent_visits(x.cdm.visit_occurrence).select(
        "person_id", "title", "description", joined("evidence"))


@query("insight_union", "SELECT person_id, type, severity, title, count(*) AS n FROM findings GROUP BY ALL")
def _(x):
    return insights.finding_titles(x.cdm, "concept").groupBy("person_id", "type", "severity", "title").agg(
        F.count("*").alias("n"))


def _said(actions: list[str]) -> str:
    return "'" + "; ".join(actions).replace("'", "''") + "'"


_DETAILS = f"""SELECT c.person_id, 'alert' AS type, 'high' AS severity,
        'Critical ' || upper(c.direction[1]) || c.direction[2:] || ' ' || upper(lab[1]) || lab[2:] AS title,
        upper(lab[1]) || lab[2:] || ' value of ' || c.value_as_number || ' ' || unit || ' is critically ' || c.direction
            || ' (threshold: ' || limit_text || ')' AS description,
        'Lab result: ' || c.value_as_number || ' ' || unit AS evidence,
        coalesce(actions, 'Urgent clinical review of the critically ' || c.direction || ' ' || lab
            || '; Evaluate the likely cause of the abnormal ' || lab) || '; Confirm with a repeat measurement before acting' AS recommendations,
        cast(measurement_concept_id AS varchar) AS relevant_concepts
        FROM crit c JOIN meas m ON m.measurement_id = c.measurement_id LEFT JOIN critical_advice a USING (lab, direction)
    UNION ALL SELECT person_id, 'observation', 'medium',
        CASE direction WHEN 'rising' THEN 'Rising' ELSE 'Declining' END || ' Trend: ' || display,
        'Monotonic ' || CASE direction WHEN 'rising' THEN 'upward' ELSE 'downward' END || ' trend in ' || display || ' across ' || n
            || ' serial measurements (' || round(first_value, 2) || ' → ' || round(last_value, 2) || ' ' || unit || ')',
        trim('Serial values (' || n || ' measurements): [' || round(first_value, 2) || ', ..., ' || round(last_value, 2) || '] ' || unit), advice, ''
        FROM trend_actions
    UNION ALL SELECT person_id, 'alert', 'medium', 'Potential Drug Interaction', warning,
        'Concurrent medications: ' || drug1 || ', ' || drug2, {_said(rules.DRUG_PAIR_ACTIONS)}, '' FROM interactions
    UNION ALL SELECT person_id, 'alert', 'high', 'Metformin Contraindication', '{rules.METFORMIN_TEXT}',
        'Creatinine: ' || arg_min(value_as_number, measurement_id) || ' mg/dL; Metformin prescribed', {_said(rules.METFORMIN_ACTIONS)}, ''
        FROM meas WHERE measurement_concept_id = 3016723 AND value_as_number > 4.0
          AND person_id IN (SELECT person_id FROM taken WHERE drug = 'metformin') GROUP BY 1
    UNION ALL SELECT person_id, 'quality_metric', CASE WHEN controlled THEN 'info' ELSE 'medium' END,
        CASE WHEN controlled THEN 'Diabetes Well Controlled' ELSE 'Diabetes Control Gap' END,
        'HbA1c of ' || value_as_number || CASE WHEN controlled THEN '% is at goal (<7%)' ELSE '% exceeds target of <7% for diabetic patients' END,
        'Latest HbA1c: ' || value_as_number || CASE WHEN controlled THEN '%' ELSE '%; Diagnosis: Diabetes mellitus' END,
        CASE WHEN controlled THEN {_said(rules.DIABETES_GOAL_ACTIONS)} ELSE {_said(rules.DIABETES_GAP_ACTIONS)} END, '44054006' FROM control
    UNION ALL SELECT person_id, 'observation', 'medium', 'Frequent Emergency Visits',
        'Patient has ' || emergency || ' emergency department visits', 'ED visits: ' || emergency || '; Total visits: ' || visits,
        {_said(rules.EMERGENCY_ACTIONS)}, '9203' FROM vcount WHERE emergency >= 2
    UNION ALL SELECT person_id, 'observation', 'medium', 'Frequent Hospitalizations', 'Patient has ' || inpatient || ' inpatient admissions',
        'Inpatient admissions: ' || inpatient, {_said(rules.INPATIENT_ACTIONS)}, '9201' FROM vcount WHERE inpatient >= 2"""


@query("insight_details", _DETAILS)
def _(x):
    rows = insights.all_findings(x.cdm, "concept")
    return rows.select("person_id", "type", "severity", "title", "description", joined("evidence"),
                       joined("recommendations"), F.array_join(
                           F.col("relevant_concepts").cast("array<string>"), ",").alias("relevant_concepts"))


@query("patient_summary", """SELECT person_id, 2020 - year_of_birth AS age,
    CASE gender_concept_id WHEN 8507 THEN 'Male' WHEN 8532 THEN 'Female' ELSE 'Unknown' END AS gender,
    coalesce(tv, 0) AS total_visits, coalesce(ac, '') AS active_conditions, coalesce(cm, '') AS current_medications,
    coalesce(lc, 0) AS recent_lab_count, coalesce(ev, 'N/A') AS earliest_visit, coalesce(lv, 'N/A') AS latest_visit
    FROM person LEFT JOIN (SELECT person_id, count(*) AS tv, cast(min(visit_start_date) AS varchar) AS ev,
        cast(max(visit_start_date) AS varchar) AS lv FROM visit GROUP BY 1) USING (person_id)
    LEFT JOIN (SELECT person_id, count(DISTINCT measurement_source_value) AS lc FROM meas GROUP BY 1) USING (person_id)
    LEFT JOIN (SELECT person_id, array_to_string(list_sort(list(DISTINCT condition_source_value))[1:10], '; ') AS ac FROM cond GROUP BY 1) USING (person_id)
    LEFT JOIN (SELECT person_id, array_to_string(list_sort(list(DISTINCT drug_source_value))[1:10], '; ') AS cm FROM drug GROUP BY 1) USING (person_id)""")
def _(x):
    rows = insights.patient_summary(x.cdm, x.as_of)
    return rows.withColumns({c: F.array_join(c, "; ") for c in ("active_conditions", "current_medications")})


_RISK = """SELECT person_id, score, CASE WHEN score >= 20 THEN 'High' WHEN score >= 10 THEN 'Medium'
    WHEN score > 0 THEN 'Low' ELSE 'Minimal' END AS level,
    CASE WHEN score >= 20 THEN 'red' WHEN score >= 10 THEN 'orange' WHEN score > 0 THEN 'yellow' ELSE 'green' END AS color,
    h AS high_severity_findings, m AS medium_severity_findings, l AS low_severity_findings, n AS findings
    FROM (SELECT person_id, coalesce(h, 0) * 10 + coalesce(m, 0) * 5 + coalesce(l, 0) AS score, coalesce(h, 0) AS h,
        coalesce(m, 0) AS m, coalesce(l, 0) AS l, coalesce(n, 0) AS n FROM person LEFT JOIN (
        SELECT person_id, count(*) FILTER (WHERE severity = 'high') AS h, count(*) FILTER (WHERE severity = 'medium') AS m,
            count(*) FILTER (WHERE severity = 'low') AS l, count(*) AS n FROM findings GROUP BY 1) USING (person_id))"""


@query("risk_score", _RISK)
def _(x):
    return insights.risk_score(x.cdm, insights.finding_titles(x.cdm, "concept"))


@query("analyze_patients", f"""SELECT r.*, 2020 - year_of_birth AS age, coalesce(visits, 0) AS total_visits
    FROM ({_RISK}) r JOIN person USING (person_id) LEFT JOIN vcount USING (person_id)""")
def _(x):
    rows = insights.analyze_patients(x.cdm, x.as_of, "concept")
    return rows.select("person_id", "score", "level", "color", "high_severity_findings",
                       "medium_severity_findings", "low_severity_findings", "findings", "age", "total_visits")


_DIABETICS = _MEMBERS["diabetic_patients"]
_FINDINGS = f"""SELECT title AS finding, count, cast(round(count / (SELECT count(*) FROM ({_DIABETICS})) * 100, 1) AS varchar) || '%' AS prevalence
    FROM (SELECT title, count(*) AS count FROM findings WHERE person_id IN ({_DIABETICS}) GROUP BY 1 ORDER BY count DESC, title LIMIT 10)"""


@query("cohort_findings", _FINDINGS)
def _(x):
    people = cohort.members(x.cdm, cohort.named_cohort("diabetic_patients"))
    return insights.cohort_findings(people, insights.title_counts(x.cdm, people, "concept"))


_STUDIES = f"""SELECT 'Cohort Study Opportunity' AS title, 'Cohort of ' || n || ' patients available for retrospective analysis' AS description,
    'Outcomes analysis; Treatment pattern analysis; Risk factor identification' AS suggested_analyses
    FROM (SELECT count(*) AS n FROM ({_DIABETICS})) WHERE n >= 10
    UNION ALL SELECT 'Quality Improvement Study', 'Identified ' || n || ' quality metric gaps',
    'Care gap closure intervention; Best practice implementation; Outcome measurement'
    FROM (SELECT count(*) AS n FROM findings WHERE type = 'quality_metric' AND person_id IN ({_DIABETICS})) WHERE n > 0"""


@query("research_opportunities", _STUDIES)
def _(x):
    people = cohort.members(x.cdm, cohort.named_cohort("diabetic_patients"))
    rows = insights.research_opportunities(people, insights.title_counts(x.cdm, people, "concept"))
    return rows.select("title", "description", joined("suggested_analyses"))


@query("analyze_cohort", f"""SELECT 'top finding' AS section, finding AS item, count || ' (' || prevalence || ')' AS detail FROM ({_FINDINGS})
    UNION ALL SELECT 'research opportunity', title, description FROM ({_STUDIES})""")
def _(x):
    people = cohort.members(x.cdm, cohort.named_cohort("diabetic_patients"))
    found = insights.title_counts(x.cdm, people, "concept")
    top = insights.cohort_findings(people, found).select(
        F.lit("top finding").alias("section"), F.col("finding").alias("item"),
        F.concat(F.col("count").cast("string"), F.lit(" ("), "prevalence", F.lit(")")).alias("detail"))
    return top.unionByName(insights.research_opportunities(people, found).select(
        F.lit("research opportunity").alias("section"), F.col("title").alias("item"),
        F.col("description").alias("detail")))


# --- CSV ingest ------------------------------------------------------------------------------

from registry import csv_queries  # noqa: E402,F401
