"""The pipeline stages as DuckDB views, written independently of the Spark operators."""

from __future__ import annotations

import re

from clinspan.fixed import concepts, patterns, rules
from registry import fixture_sql as fx
from registry.settings import DEID, TOKENS


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def rows(name_columns: str, data) -> str:
    body = ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in data)
    return f"SELECT * FROM (VALUES {body}) AS v({name_columns})"


def _fixture(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


_cfg = TOKENS
_pad = _cfg.secret_key.ljust(64, b"\0")
_IPAD = bytes(b ^ 0x36 for b in _pad).hex()
_OPAD = bytes(b ^ 0x5C for b in _pad).hex()
_SALT = _cfg.salt.hex()
_SECRET = DEID.shift_secret


def clean(column: str) -> str:
    return ("replace(replace(replace(replace(trim(upper(coalesce(" + column
            + ", '')), ' '), 'AL-', ''), 'AL ', ''), ' ', ''), '-', '')")


def shift(key: str) -> str:
    return f"(cast(('0x' || substr(sha256('{_SECRET}' || {key}), 1, 8)) AS bigint) % 731 - 365)"


AGE = ("(2020 - year(date_of_birth) - CASE WHEN strftime(date_of_birth, '%m%d') > '0101'"
       " THEN 1 ELSE 0 END)")


def _redact(order: str) -> str:
    steps = list(patterns.NOTE_REDACTIONS)
    if order == "safe":
        steps = steps[1:] + steps[:1]
    expr = "clinical_notes"
    for pattern, mask in steps:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(mask)}, 'gi')"
    return expr


VIEWS: dict[str, str] = {
    "fx_patient": _fixture(fx.PATIENT),
    "fx_encounter": _fixture(fx.ENCOUNTER),
    "fx_observation": _fixture(fx.OBSERVATION),
    "fx_note": _fixture(fx.NOTE),
    "fx_csv": _fixture(fx.CSV),
    "keyed": f"""SELECT *, concat_ws('|',
        CASE WHEN national_id <> '' THEN 'NID:' || national_id END,
        'DOB:' || strftime(date_of_birth, '%Y%m%d'),
        'NAME:' || {clean('first_name')} || {clean('last_name')},
        'GEN:' || gender) AS composite_key FROM fx_patient""",
    "tok": f"""SELECT *, 'PT-' || upper(substr(sha256(unhex('{_OPAD}') || unhex(
        sha256(unhex('{_IPAD}') || unhex('{_SALT}') || encode(composite_key)))), 1, 16)) AS patient_token
        FROM keyed""",
    "tmap": "SELECT source_patient_id, arg_max(patient_token, src_ord) AS patient_token FROM tok GROUP BY 1",
    "pidx": """SELECT patient_token, row_number() OVER (ORDER BY patient_token) AS person_id
        FROM (SELECT DISTINCT patient_token FROM tmap)""",
    "links": "SELECT * FROM tmap JOIN pidx USING (patient_token)",
    "names": """SELECT source_patient_id, 'Patient_' || cls || lpad(cast(row_number() OVER (
        PARTITION BY cls ORDER BY sha256(source_patient_id)) AS varchar), 4, '0') AS surrogate_id
        FROM (SELECT source_patient_id, CASE WHEN arg_min(gender, src_ord) = 'male' THEN 'M' ELSE 'F' END AS cls
              FROM fx_patient GROUP BY 1)""",
    "dp": f"""SELECT src_ord, person_id, patient_token, source_system, surrogate_id,
        year(date_of_birth + cast({shift('source_patient_id')} AS int))
            - CASE WHEN {AGE} > 89 THEN 89 ELSE 0 END AS year_of_birth,
        CASE WHEN {AGE} > 89 THEN '90+' END AS age_group,
        CASE WHEN {AGE} <= 89 THEN {AGE} END AS age_at_data_collection,
        gender, nullif(region, '') AS region
        FROM fx_patient JOIN links USING (source_patient_id) JOIN names USING (source_patient_id)""",
    "de": f"""SELECT person_id, patient_token, substr(sha256(encounter_id), 1, 12) AS encounter_id,
        source_system, encounter_type,
        admission_date + {shift('source_patient_id')} * interval '1' day AS admission_date,
        discharge_date + {shift('source_patient_id')} * interval '1' day AS discharge_date,
        department, chief_complaint, admission_diagnosis, discharge_diagnosis,
        {_redact('safe')} AS clinical_notes,
        temperature_celsius, heart_rate_bpm, blood_pressure_systolic, blood_pressure_diastolic,
        respiratory_rate, oxygen_saturation, weight_kg, height_cm
        FROM fx_encounter JOIN links USING (source_patient_id)""",
    "dob": f"""SELECT person_id, patient_token, substr(sha256(observation_id), 1, 12) AS observation_id,
        source_system, observation_type, observation_code, observation_code_system, observation_name,
        observation_datetime + {shift('source_patient_id')} * interval '1' day AS observation_datetime,
        value_numeric, value_text, value_unit, reference_range_low, reference_range_high,
        abnormal_flag, dose, route, frequency
        FROM fx_observation JOIN links USING (source_patient_id)""",
    "icd": rows("code, cid, cname", concepts.ICD_TO_SNOMED),
    "loinc": rows("code, cid, cname", concepts.LOINC_CONCEPTS),
    "rxn": rows("code, cid, cname", concepts.RXNORM_CONCEPTS),
    "person": """SELECT person_id,
        CASE gender WHEN 'male' THEN 8507 WHEN 'female' THEN 8532 ELSE 8551 END AS gender_concept_id,
        year_of_birth, patient_token AS person_source_value, gender AS gender_source_value
        FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY src_ord) AS rn FROM dp)
        WHERE rn = 1""",
    "visit": """SELECT row_number() OVER (ORDER BY encounter_id) AS visit_occurrence_id, person_id,
        CASE encounter_type WHEN 'inpatient' THEN 9201 WHEN 'outpatient' THEN 9202
             WHEN 'emergency' THEN 9203 WHEN 'icu' THEN 32037 ELSE 9202 END AS visit_concept_id,
        cast(admission_date AS date) AS visit_start_date, admission_date AS visit_start_datetime,
        cast(coalesce(discharge_date, admission_date) AS date) AS visit_end_date,
        discharge_date AS visit_end_datetime, 44818518 AS visit_type_concept_id,
        encounter_id AS visit_source_value, admission_diagnosis FROM de""",
    "cond": r"""SELECT row_number() OVER (ORDER BY visit_source_value) AS condition_occurrence_id,
        person_id, coalesce(cid, 0) AS condition_concept_id, visit_start_date AS condition_start_date,
        visit_start_datetime AS condition_start_datetime, 32817 AS condition_type_concept_id,
        visit_occurrence_id, icd_code AS condition_source_value
        FROM (SELECT *, nullif(regexp_extract(admission_diagnosis, '\(([A-Z]\d{2}\.?\d*)\)', 1), '') AS icd_code
              FROM visit) LEFT JOIN icd ON icd_code = code WHERE icd_code IS NOT NULL""",
    "meas": """SELECT row_number() OVER (ORDER BY observation_id) AS measurement_id, person_id,
        coalesce(cid, 0) AS measurement_concept_id, cast(observation_datetime AS date) AS measurement_date,
        observation_datetime AS measurement_datetime, 44818702 AS measurement_type_concept_id,
        value_numeric AS value_as_number, value_unit AS unit_source_value,
        reference_range_low AS range_low, reference_range_high AS range_high,
        observation_code AS measurement_source_value
        FROM dob LEFT JOIN loinc ON observation_code = code
        WHERE observation_type = 'lab_result' AND observation_code <> ''""",
    "drug": """SELECT row_number() OVER (ORDER BY observation_id) AS drug_exposure_id, person_id,
        coalesce(cid, 0) AS drug_concept_id, cast(observation_datetime AS date) AS drug_exposure_start_date,
        observation_datetime AS drug_exposure_start_datetime,
        cast(observation_datetime AS date) AS drug_exposure_end_date, 38000177 AS drug_type_concept_id,
        value_text AS sig, route AS route_source_value, dose AS dose_unit_source_value,
        observation_code AS drug_source_value
        FROM dob LEFT JOIN rxn ON observation_code = code
        WHERE observation_type = 'medication' AND observation_code <> ''""",
    "condition_names": rows("cid, label", concepts.CONDITION_NAMES),
    "alias_names": rows("label, cid", concepts.COHORT_ALIASES),
    "lab_names": rows("code, lab", rules.LAB_NAMES),
    "pairs": rows("drug1, drug2, warning", rules.DRUG_PAIRS),
    "latest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id, measurement_source_value
        ORDER BY measurement_datetime DESC, measurement_id) AS rn FROM meas) WHERE rn = 1""",
    "steps": """SELECT *, lag(value_as_number) OVER w AS prev, row_number() OVER w AS rn
        FROM meas WHERE value_as_number IS NOT NULL
        WINDOW w AS (PARTITION BY person_id, measurement_source_value
                     ORDER BY measurement_datetime, measurement_id)""",
    "units": """SELECT person_id, measurement_source_value, unit_source_value AS unit FROM (
        SELECT *, row_number() OVER (PARTITION BY person_id, measurement_source_value
            ORDER BY measurement_datetime, measurement_id) AS rn
        FROM meas WHERE unit_source_value <> '') WHERE rn = 1""",
    "trend": """SELECT person_id, measurement_source_value, n, first_value, last_value, direction,
        coalesce(unit, '') AS unit FROM (
        SELECT person_id, measurement_source_value, count(*) AS n,
            max(CASE WHEN rn = 1 THEN value_as_number END) AS first_value,
            arg_max(value_as_number, rn) AS last_value,
            CASE WHEN bool_and(prev IS NULL OR value_as_number > prev) THEN 'rising'
                 WHEN bool_and(prev IS NULL OR value_as_number < prev) THEN 'declining' END AS direction
        FROM steps GROUP BY 1, 2) LEFT JOIN units USING (person_id, measurement_source_value)
        WHERE n >= 3 AND direction IS NOT NULL""",
    "taken": """SELECT DISTINCT person_id, CASE lower(drug_source_value) WHEN '11289' THEN 'warfarin'
        WHEN '1191' THEN 'aspirin' WHEN '860975' THEN 'metformin' WHEN '42316' THEN 'tacrolimus'
        ELSE lower(drug_source_value) END AS drug FROM drug""",
    "interactions": """SELECT a.person_id, drug1, drug2, warning FROM pairs
        JOIN taken a ON a.drug = drug1 JOIN taken b ON b.drug = drug2 AND a.person_id = b.person_id""",
    "diabetic": """SELECT DISTINCT person_id FROM cond WHERE condition_concept_id = 44054006
        OR contains(lower(condition_source_value), 'diabetes')""",
    "control": """SELECT person_id, value_as_number, value_as_number <= 7.0 AS controlled FROM (
        SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY measurement_datetime DESC,
            measurement_id) AS rn FROM meas
        WHERE contains(lower(measurement_source_value), 'hba1c') OR contains(measurement_source_value, '4548-4'))
        WHERE rn = 1 AND value_as_number IS NOT NULL AND person_id IN (SELECT person_id FROM diabetic)""",
    "vcount": """SELECT person_id, count(*) AS visits,
        count(*) FILTER (WHERE visit_concept_id = 9201) AS inpatient,
        count(*) FILTER (WHERE visit_concept_id = 9203) AS emergency FROM visit GROUP BY 1""",
    "limits": rows("lab, low, high, unit", [
        (lab, low and float(low), high and float(high), unit) for lab, low, high, unit in rules.CRITICAL_LABS]),
    "limit_text": rows("lab, low_text, high_text", [row[:3] for row in rules.CRITICAL_LABS]),
    "lab_ids": rows("lab, cid", [("hemoglobin", 3000963), ("potassium", 3023103), ("sodium", 3019550),
                                 ("glucose", 3004501), ("creatinine", 3016723), ("platelets", 3024929)]),
    "crit": """SELECT person_id, measurement_id, lab, 'low' AS direction, value_as_number, unit, low_text AS limit_text
        FROM meas JOIN lab_ids ON cid = measurement_concept_id JOIN limits USING (lab) JOIN limit_text USING (lab)
        WHERE value_as_number < low UNION ALL
        SELECT person_id, measurement_id, lab, 'high', value_as_number, unit, high_text
        FROM meas JOIN lab_ids ON cid = measurement_concept_id JOIN limits USING (lab) JOIN limit_text USING (lab)
        WHERE value_as_number > high""",
    "trend_advice": rows("lab, direction, actions", [(l, d, "; ".join(a)) for l, d, a in rules.TREND_ACTIONS]),
    "critical_advice": rows("lab, direction, actions", [(l, d, "; ".join(a)) for l, d, a in rules.CRITICAL_ACTIONS]),
    "trend_text": """SELECT t.*, coalesce(lab, t.measurement_source_value) AS lab_name,
        coalesce(lab || ' (' || code || ')', t.measurement_source_value) AS display
        FROM trend t LEFT JOIN lab_names ON code = t.measurement_source_value""",
    "trend_actions": """SELECT x.*, coalesce(actions, 'Correlate the ' || CASE x.direction WHEN 'rising' THEN 'increase' ELSE 'decrease' END
        || ' in ' || lab_name || ' with the patient''s clinical course; Repeat ' || lab_name || ' to confirm the trend before acting') AS advice
        FROM trend_text x LEFT JOIN trend_advice a ON a.lab = lower(lab_name) AND a.direction = x.direction""",
    "trend_list": """SELECT s.person_id, s.measurement_source_value,
        string_agg(cast(round(value_as_number, 2) AS varchar), ', ' ORDER BY rn) AS vals
        FROM steps s JOIN trend USING (person_id, measurement_source_value) GROUP BY 1, 2""",
    # severity and title of every finding, by concept match
    "findings": """
        SELECT person_id, 'alert' AS type, 'high' AS severity,
               'Critical ' || upper(direction[1]) || direction[2:] || ' ' || upper(lab[1]) || lab[2:] AS title FROM crit
        UNION ALL SELECT person_id, 'observation', 'medium',
               CASE direction WHEN 'rising' THEN 'Rising' ELSE 'Declining' END || ' Trend: ' ||
               coalesce(lab || ' (' || code || ')', measurement_source_value)
               FROM trend LEFT JOIN lab_names ON code = measurement_source_value
        UNION ALL SELECT person_id, 'alert', 'medium', 'Potential Drug Interaction' FROM interactions
        UNION ALL SELECT DISTINCT person_id, 'alert', 'high', 'Metformin Contraindication' FROM meas
               WHERE measurement_concept_id = 3016723 AND value_as_number > 4.0
                 AND person_id IN (SELECT person_id FROM taken WHERE drug = 'metformin')
        UNION ALL SELECT person_id, 'quality_metric', CASE WHEN controlled THEN 'info' ELSE 'medium' END,
               CASE WHEN controlled THEN 'Diabetes Well Controlled' ELSE 'Diabetes Control Gap' END FROM control
        UNION ALL SELECT person_id, 'observation', 'medium', 'Frequent Emergency Visits' FROM vcount WHERE emergency >= 2
        UNION ALL SELECT person_id, 'observation', 'medium', 'Frequent Hospitalizations' FROM vcount WHERE inpatient >= 2""",
}


def with_views(query: str) -> str:
    """Prefix the views a query needs, directly or through other views, in definition order."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"(?<![\w.']){name}(?![\w'])", sql):
                needed.add(name)
                visit(VIEWS[name])

    visit(query)
    parts = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + query if parts else query
