"""Clinical source tables derived from the given business tables, as portable SQL.

The same text runs in Spark (with DataFrames bound to the table names) and in DuckDB (over its
pre-registered views), so both engines start from the same records.
"""

from __future__ import annotations

PERSON = "(c_custkey - CASE WHEN c_custkey % 10 < 4 THEN c_custkey % 10 ELSE 0 END)"


def pick(values: list[str], index: str) -> str:
    joined = "~".join(v.replace("'", "''") for v in values)
    return f"split_part('{joined}', '~', cast({index} as int) + 1)"


SYSTEMS = ["HIS", "LAB", "EMR", "PHARMACY", "RAD", "ICU"]
FIRST_NAMES = ["Adam", "Nora", "Karim", "Lina", "Yusuf", "Hana", "Samir", "Dina"]
LAST_NAMES = ["Al-Noor", "Haddad", "Al Amin", "Saleh", "Al-Karim", "Nasser", "Khoury"]

PATIENT = f"""
SELECT c_custkey AS src_ord,
       {pick(SYSTEMS, 'c_custkey % 6')} AS source_system,
       {pick(SYSTEMS, 'c_custkey % 6')} || '-' || lpad(cast(c_custkey AS string), 8, '0') AS source_patient_id,
       CASE WHEN {PERSON} % 11 = 7 THEN NULL
            ELSE cast(1000000000 + {PERSON} * 7919 AS string) END AS national_id,
       CASE c_custkey % 10
            WHEN 1 THEN upper({pick(FIRST_NAMES, PERSON + ' % 8')})
            WHEN 2 THEN ' ' || {pick(FIRST_NAMES, PERSON + ' % 8')}
            ELSE {pick(FIRST_NAMES, PERSON + ' % 8')} END AS first_name,
       CASE WHEN c_custkey % 4 = 0 THEN 'M.' END AS middle_name,
       {pick(LAST_NAMES, PERSON + ' % 7')} AS last_name,
       date '1925-01-01' + cast(({PERSON} * 37) % 32000 AS int) AS date_of_birth,
       CASE WHEN {PERSON} % 19 = 0 THEN 'unknown' WHEN {PERSON} % 2 = 0 THEN 'male'
            ELSE 'female' END AS gender,
       '05' || lpad(cast(c_custkey AS string), 8, '0') AS phone_number,
       CASE WHEN c_custkey % 3 <> 0
            THEN 'user' || cast(c_custkey AS string) || '@mail.example' END AS email,
       cast(c_custkey % 900 + 1 AS string) || ' Palm Street' AS address_line1,
       {pick(['Northgate', 'Easton', 'Westbrook'], 'c_custkey % 3')} AS city,
       CASE WHEN {PERSON} % 13 <> 0
            THEN 'REGION_' || cast(c_nationkey % 5 AS string) END AS region,
       lpad(cast(c_custkey % 100000 AS string), 5, '0') AS postal_code,
       'MRN-' || cast(100000 + c_custkey AS string) AS mrn
FROM {{customer}}
"""

# description (code) of the mapped diagnoses, one unmapped code, one text without a code
DIAGNOSES = [
    "Acute lymphoid leukemia (C91.0)", "Breast cancer (C50.9)", "Chronic kidney disease (N18.9)",
    "Type 2 diabetes (E11.9)", "Hypertension (I10)", "Coronary disease (I25.10)",
    "Heart failure (I50.9)", "Cirrhosis (K74.60)", "End stage renal disease (N18.6)",
    "Sickle cell disease (D57.1)", "Thalassemia (D56.1)", "Liver cancer (C22.0)",
    "Colon cancer (C18.9)", "Lymphoma (C85.9)", "Multiple myeloma (C90.0)",
    "Marrow transplant (Z94.81)", "Kidney transplant (Z94.0)", "Liver transplant (Z94.4)",
    "Pneumonia (J18.9)", "Sepsis (A41.9)", "Kidney injury (N17.9)", "Stroke (I63.9)",
    "Infarction (I21.9)", "Embolism (I26.99)", "Vein thrombosis (I82.40)", "Follow-up (Z09)",
    "General weakness",
]
ENCOUNTER_TYPES = ["emergency", "inpatient", "icu", "outpatient", "outpatient"]
TYPE_EXPR = (
    "CASE WHEN o_orderkey % 50 = 0 THEN 'telehealth' ELSE "
    + pick(ENCOUNTER_TYPES, "cast(substr(o_orderpriority, 1, 1) AS int) - 1") + " END"
)
NOTE_EXPR = (
    "'Seen by Dr. ' || " + pick(FIRST_NAMES, "o_orderkey % 8") + " || ' Haddad for '"
    " || " + pick(["hypertension", "type 2 diabetes mellitus", "chest pain", "pneumonia"], "o_orderkey % 4")
    + " || '. No evidence of heart failure. Takes aspirin and metformin. Phone ' ||"
    " cast(2000000000 + o_orderkey AS string) || ', mail user' || cast(o_custkey AS string) ||"
    " '@mail.example, MRN-' || cast(100000 + o_custkey AS string) || '.'"
)

ENCOUNTER = f"""
SELECT 'ENC-' || lpad(cast(o_orderkey AS string), 10, '0') AS encounter_id,
       {pick(SYSTEMS, 'o_custkey % 6')} AS source_system,
       {pick(SYSTEMS, 'o_custkey % 6')} || '-' || lpad(cast(o_custkey AS string), 8, '0') AS source_patient_id,
       {TYPE_EXPR} AS encounter_type,
       o_orderdate + (o_orderkey % 24) * interval '1' hour AS admission_date,
       CASE WHEN {TYPE_EXPR} IN ('outpatient', 'telehealth') THEN NULL
            ELSE o_orderdate + (o_orderkey % 24) * interval '1' hour
                 + (o_orderkey % 21 + 1) * interval '1' day END AS discharge_date,
       {pick(['Cardiology', 'Oncology', 'Nephrology', 'General'], 'o_orderkey % 4')} AS department,
       'Dr. ' || {pick(LAST_NAMES, 'o_orderkey % 7')} AS attending_physician,
       {pick(['Chest pain', 'Fatigue', 'Follow-up'], 'o_orderkey % 3')} AS chief_complaint,
       CASE WHEN o_orderkey % 28 < 27 THEN {pick(DIAGNOSES, 'o_orderkey % 28')} END AS admission_diagnosis,
       CASE WHEN {TYPE_EXPR} NOT IN ('outpatient', 'telehealth') AND o_orderkey % 28 < 27
            THEN {pick(DIAGNOSES, 'o_orderkey % 28')} END AS discharge_diagnosis,
       {NOTE_EXPR} AS clinical_notes,
       36.0e0 + (o_orderkey % 30) / 10.0e0 AS temperature_celsius,
       cast(60 + o_orderkey % 60 AS int) AS heart_rate_bpm,
       cast(100 + o_orderkey % 70 AS int) AS blood_pressure_systolic,
       cast(60 + o_orderkey % 40 AS int) AS blood_pressure_diastolic,
       cast(12 + o_orderkey % 10 AS int) AS respiratory_rate,
       CASE WHEN o_orderkey % 9 <> 0 THEN 90.0e0 + o_orderkey % 10 END AS oxygen_saturation,
       50.0e0 + o_orderkey % 50 AS weight_kg,
       150.0e0 + o_orderkey % 45 AS height_cm
FROM {{orders}}
"""

LOINC_CODES = ["718-7", "6690-2", "777-3", "2160-0", "3094-0", "2345-7", "4548-4", "2951-2",
               "2823-3", "1742-6", "1920-8", "1975-2", "1751-7", "5902-2", "6301-6", "9999-9"]
LAB_UNITS = ["g/dL", "10*9/L", "10*9/L", "mg/dL", "mg/dL", "mg/dL", "%", "mEq/L", "mEq/L",
             "U/L", "U/L", "mg/dL", "g/dL", "s", "ratio", "unit"]
RXNORM_CODES = ["860975", "314076", "617311", "329528", "904453", "1191", "847230", "4603",
                "11289", "42316", "68149", "227718", "26225", "7052", "000000"]
IS_DRUG = "l_linenumber % 3 = 0"

OBSERVATION = f"""
SELECT 'OBS-' || cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-'
           || cast(l_partkey AS string) || '-' || cast(l_suppkey AS string) AS observation_id,
       {pick(SYSTEMS, 'o_custkey % 6')} AS source_system,
       {pick(SYSTEMS, 'o_custkey % 6')} || '-' || lpad(cast(o_custkey AS string), 8, '0') AS source_patient_id,
       'ENC-' || lpad(cast(l_orderkey AS string), 10, '0') AS encounter_id,
       CASE WHEN {IS_DRUG} THEN 'medication' ELSE 'lab_result' END AS observation_type,
       CASE WHEN {IS_DRUG} AND l_suppkey % 16 < 15 THEN {pick(RXNORM_CODES, 'l_suppkey % 16')}
            WHEN NOT ({IS_DRUG}) AND l_partkey % 17 < 16 THEN {pick(LOINC_CODES, 'l_partkey % 17')}
            END AS observation_code,
       CASE WHEN {IS_DRUG} THEN 'RxNorm' ELSE 'LOINC' END AS observation_code_system,
       CASE WHEN {IS_DRUG} THEN 'Drug ' || cast(l_suppkey % 16 AS string)
            ELSE 'Lab ' || cast(l_partkey % 17 AS string) END AS observation_name,
       CASE WHEN {IS_DRUG} OR l_partkey % 29 = 0 THEN NULL
            ELSE round(l_quantity * 0.3e0, 2) END AS value_numeric,
       CASE WHEN {IS_DRUG} THEN 'take ' || cast(l_suppkey % 3 + 1 AS string) || ' daily' END AS value_text,
       CASE WHEN NOT ({IS_DRUG}) AND l_partkey % 17 < 16 AND l_partkey % 5 <> 0
            THEN {pick(LAB_UNITS, 'l_partkey % 17')} END AS value_unit,
       CASE WHEN NOT ({IS_DRUG}) THEN 2.0e0 END AS reference_range_low,
       CASE WHEN NOT ({IS_DRUG}) THEN 12.0e0 END AS reference_range_high,
       CASE WHEN NOT ({IS_DRUG}) AND l_quantity > 40 THEN 'H' END AS abnormal_flag,
       l_shipdate + l_linenumber * interval '1' hour AS observation_datetime,
       'Dr. ' || {pick(LAST_NAMES, 'l_suppkey % 7')} AS performing_provider,
       CASE WHEN {IS_DRUG} THEN cast((l_suppkey % 4 + 1) * 5 AS string) || 'mg' END AS dose,
       CASE WHEN {IS_DRUG} THEN 'oral' END AS route,
       CASE WHEN {IS_DRUG} THEN 'daily' END AS frequency
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
"""

# our own clinical snippets; the documents themselves hold invented words only
SNIPPETS = [
    "HISTORY OF PRESENT ILLNESS:\\nAdmitted with chest pain and shortness of breath. Known type 2"
    " diabetes mellitus and hypertension. Troponin I elevated; coronary angiography showed"
    " left anterior descending stenosis.",
    "PAST MEDICAL HISTORY:\\nMyocardial infarction in 2015, s/p percutaneous coronary"
    " intervention. Congestive heart failure. Takes aspirin 81 mg of Ecotrin and lisinopril.",
    "FAMILY HISTORY:\\nFather had heart attack at 60. Mother with diabetes mellitus and HTN."
    " Sister is well.",
    "ASSESSMENT:\\nThere is no evidence of\\npulmonary congestion. Denies dyspnea. Acute kidney"
    " injury resolved. Pneumonia ruled out!\\n\\nPLAN:\\nContinue metformin 500 mg of Glucophage.",
    "MOLECULAR RESULTS:\\nEGFR exon 19 deletion detected. ALK negative, KRAS wild-type. PD-L1 TPS"
    " 60%. Lung adenocarcinoma, poorly differentiated. EGFR mutation analysis by NGS.",
    "MEDICATIONS:\\nMetformin, Lipitor, clopidogrel, heparin 5000 units of saline. Blood pressure:"
    " 142/88. HR 98 bpm. SpO2 94%. Temp 37.2 C. RR 18. Weight 82 kg.",
    "LABS:\\nHbA1c 8.1, creatinine 1.4, LDL cholesterol 130, glucose 180, BNP 400, troponin 0.8."
    " ECG with ST depression; echocardiogram shows anterior hypokinesis. CXR clear.",
    "PATIENT: Mr. Karim Haddad\\nMRN: 884213 DOB: 03/14/1956 National ID: 1098765432 Phone:"
    " 555-123-4567. Email k.haddad@mail.example, see https://portal.example/x from 10.20.30.40."
    " Lives at 12 Palm Street, Springfield, TX 12345. Aged 93 years. VIN: 1HGCM82633A004352.",
]


def note_sql(newline: str) -> str:
    arms = " ".join(
        "WHEN {} THEN {}".format(
            i, " || {} || ".format(newline).join("'" + p + "'" for p in s.split("\\n")))
        for i, s in enumerate(SNIPPETS))
    return (f"SELECT doc_id, CASE doc_id % {len(SNIPPETS)} {arms} END || {newline} || {newline}"
            " || text AS text, lang FROM {documents}")


NOTE = note_sql("chr(10)")


# an upload: one row per order; every 23rd without a first name, every 29th with a bad birth date,
# every 17th without a patient id, every 19th without any encounter column
INSTITUTES = ["KFSHRC", "King Fahd Medical City", "riyadh military hospital", "Unknown Clinic"]
NO_ENCOUNTER = "o_orderkey % 19 = 0"
CSV = f"""
SELECT o_orderkey AS row_key,
       CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'P' || cast(o_custkey AS string) END AS patient_id,
       cast(1000000000 + o_custkey AS string) AS national_id,
       CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE {pick(FIRST_NAMES, 'o_custkey % 8')} END AS first_name,
       {pick(LAST_NAMES, 'o_custkey % 7')} AS last_name,
       CASE WHEN o_orderkey % 29 = 0 THEN '31/31/1999' WHEN o_orderkey % 31 = 0 THEN ''
            WHEN o_orderkey % 2 = 0
            THEN cast(date '1940-01-01' + cast((o_custkey * 37) % 20000 AS int) AS string)
            ELSE substr(cast(date '1940-01-01' + cast((o_custkey * 37) % 20000 AS int) AS string), 9, 2) || '/'
              || substr(cast(date '1940-01-01' + cast((o_custkey * 37) % 20000 AS int) AS string), 6, 2) || '/'
              || substr(cast(date '1940-01-01' + cast((o_custkey * 37) % 20000 AS int) AS string), 1, 4) END AS date_of_birth,
       date '1940-01-01' + cast((o_custkey * 37) % 20000 AS int) AS born,
       CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'Woman' END AS gender,
       CASE WHEN o_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex,
       {pick(INSTITUTES, 'o_custkey % 4')} AS source_system,
       {pick(['HIS', 'LAB', 'EMR', 'HIS'], 'o_custkey % 4')} AS sys,
       CASE WHEN {NO_ENCOUNTER} OR o_orderkey % 5 = 0 THEN '' ELSE 'E' || cast(o_orderkey AS string) END AS encounter_id,
       CASE WHEN {NO_ENCOUNTER} OR o_orderkey % 4 = 0 THEN '' ELSE 'inpatient' END AS encounter_type,
       CASE WHEN {NO_ENCOUNTER} OR o_orderkey % 7 = 0 THEN ''
            ELSE substr(cast(o_orderdate AS string), 1, 10) || ' 08:30:00' END AS admission_date,
       CASE WHEN {NO_ENCOUNTER} OR o_orderkey % 3 = 0 THEN ''
            ELSE substr(cast(o_orderdate AS string), 1, 10) END AS discharge_date,
       CASE WHEN {NO_ENCOUNTER} OR o_orderkey % 6 = 0 THEN '' ELSE 'Cardiology' END AS department,
       CASE WHEN {NO_ENCOUNTER} OR o_orderkey % 2 = 0 THEN '' ELSE 'I50.9' END AS diagnosis_code,
       CASE WHEN {NO_ENCOUNTER} OR o_orderkey % 9 < 4 THEN '' ELSE 'Heart failure, "acute"' END AS diagnosis_description,
       CASE WHEN o_orderkey % 8 = 0 THEN 'Fatigue' ELSE '' END AS chief_complaint,
       CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'First line, with comma' || chr(10) || 'second "line" '
            || cast(o_orderkey AS string) END AS clinical_notes
FROM {{orders}}
"""
# canonical column -> header the file uses
CSV_HEADERS = {
    "patient_id": "ID", "national_id": "NID", "first_name": "First", "last_name": "Last-Name",
    "date_of_birth": "DOB", "gender": " Sex ", "source_system": "Source System",
    "encounter_id": "Encounter ID", "encounter_type": "encounter_type", "admission_date": "Admit Date",
    "discharge_date": "Discharge", "department": "Dept", "diagnosis_code": "ICD10",
    "diagnosis_description": "Diagnosis", "chief_complaint": "Chief Complaint", "clinical_notes": "Notes",
}
# headers of the other make of files, where they differ
OTHER_HEADERS = {"first_name": "FirstName", "last_name": "lastname", "date_of_birth": "Birth-Date", "department": "department"}

# the file a CSV row is written to, where files hold ranges of keys
CSV_FILE = "(row_key div 10000)"
# Lines of CSV files with a quoted line break in every third record; the first line of each file is its header.
STRAY_HEADER = "ID,first_name,last_name,DOB,Sex,City,Notes"
STRAY_LINES = f"""
SELECT row_key, CASE WHEN row_number() OVER (PARTITION BY {CSV_FILE} ORDER BY row_key) = 1
                     THEN '{STRAY_HEADER}' || chr(10) ELSE '' END || line AS value
FROM (SELECT o_orderkey AS row_key, 'P' || o_orderkey || ',Ann "Annie",' ||
             CASE o_orderkey % 4 WHEN 0 THEN '"Lee"-Ray' WHEN 1 THEN '"a ""b"" c"' WHEN 2 THEN 'O"Hara' ELSE 'Kay' END ||
             ',1950-01-01,F,' || CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 7 || '" tall' ELSE '"x, y"' END || ',' ||
             CASE o_orderkey % 3 WHEN 0 THEN '"one' || chr(10) || chr(10) || 'two ""' || o_orderkey || '""' || '"' WHEN 1 THEN 'six"' ELSE '' END AS line
      FROM {{orders}})
"""
