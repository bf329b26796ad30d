"""Queries over a CSV written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinspan.operators import ingest
from clinspan.operators.tables import union_all
from clinspan.plans import pipeline
from clinspan.session import shared_dir
from clinspan.sources import csv_in, export
from registry.queries import query



@query("csv_read", """SELECT count(*) AS records, count(*) FILTER (WHERE first_name = '') AS blank_first_names,
    cast(sum(length(clinical_notes)) AS bigint) AS note_chars FROM fx_csv""")
def _(x):
    return x.csv.records.agg(
        F.count("*").alias("records"),
        F.count_if(F.coalesce("first_name", F.lit("")) == "").alias("blank_first_names"),
        F.sum(F.length(F.coalesce("clinical_notes", F.lit("")))).alias("note_chars"))


@query("csv_header_normalize", """SELECT name, cast(sum(length(v)) AS bigint) AS chars FROM (
    SELECT 'date_of_birth' AS name, date_of_birth AS v FROM fx_csv UNION ALL SELECT 'gender', gender FROM fx_csv
    UNION ALL SELECT 'department', department FROM fx_csv UNION ALL SELECT 'diagnosis_code', diagnosis_code FROM fx_csv)
    GROUP BY 1""")
def _(x):
    names = ["date_of_birth", "gender", "department", "diagnosis_code"]
    return x.csv.records.unpivot([], names, "name", "v").groupBy("name").agg(
        F.sum(F.length(F.coalesce("v", F.lit("")))).alias("chars"))


@query("csv_required_columns", """SELECT error, count(*) AS files, cast(sum(n) AS bigint) AS rows, cast(sum(good) AS bigint) AS valid_rows FROM (
    SELECT CASE row_key % 4 WHEN 3 THEN 'File must be UTF-8 encoded' WHEN 2 THEN 'Missing required columns: date_of_birth, gender'
        ELSE '' END AS error, row_key // 10000 AS file, count(*) FILTER (WHERE row_key % 4 < 2) AS n,
        count(*) FILTER (WHERE row_key % 4 < 2 AND trim(first_name) <> '' AND trim(last_name) <> ''
            AND trim(date_of_birth) NOT IN ('31/31/1999', '')) AS good FROM fx_csv GROUP BY 1, 2) GROUP BY 1""")
def _(x):
    files = ingest.ingest(csv_in.read_csv(x.mixed_upload), x.as_of).files
    return files.groupBy(F.coalesce("file_error", F.lit("")).alias("error")).agg(
        F.count("*").alias("files"), F.sum("row_count").alias("rows"), F.sum("valid_row_count").alias("valid_rows"))


_NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY row_key // 10000 ORDER BY row_key) + 1 AS row FROM fx_csv)"


@query("record_ordinal", f"SELECT row, national_id, clinical_notes FROM {_NUMBERED}")
def _(x):
    return csv_in.read_csv(x.ordered_upload).records.select(
        "row", "national_id", F.coalesce("clinical_notes", F.lit("")).alias("clinical_notes"))


@query("csv_stray_quotes", """SELECT 'P' || o_orderkey AS patient_id, 'Ann "Annie"' AS first_name,
    CASE o_orderkey % 4 WHEN 0 THEN 'Lee-Ray' WHEN 1 THEN 'a "b" c' WHEN 2 THEN 'O"Hara' ELSE 'Kay' END AS last_name,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 7 || '" tall' ELSE 'x, y' END AS city,
    CASE o_orderkey % 3 WHEN 0 THEN 'one' || chr(10) || chr(10) || 'two "' || o_orderkey || '"' WHEN 1 THEN 'six"' ELSE '' END AS notes,
    row_number() OVER (PARTITION BY o_orderkey // 10000 ORDER BY o_orderkey) + 1 AS row FROM orders""")
def _(x):
    return csv_in.read_csv(x.stray_upload).records.select(
        "patient_id", "first_name", "last_name", "city", F.coalesce("clinical_notes", F.lit("")).alias("notes"), "row")


_ERRORS = """SELECT 'Missing first_name' AS m FROM fx_csv WHERE trim(first_name) = ''
    UNION ALL SELECT 'Missing last_name' FROM fx_csv WHERE trim(last_name) = ''
    UNION ALL SELECT 'Invalid or missing date_of_birth ''' || trim(date_of_birth) || ''''
    FROM fx_csv WHERE trim(date_of_birth) IN ('31/31/1999', '')"""
_GOOD = "trim(first_name) <> '' AND trim(last_name) <> '' AND trim(date_of_birth) NOT IN ('31/31/1999', '')"


@query("patient_row_validate", f"SELECT m AS message, count(*) AS n FROM ({_ERRORS}) GROUP BY 1")
def _(x):
    rows = ingest.complete(x.csv.records)
    return rows.select(F.explode(ingest.row_errors()).alias("message")).groupBy("message").agg(
        F.count("*").alias("n"))


_PRESENT = """(encounter_id <> '' OR encounter_type <> '' OR admission_date <> '' OR department <> ''
    OR diagnosis_code <> '' OR diagnosis_description <> '')"""


@query("encounter_presence", f"SELECT row_key, {_PRESENT} AS present FROM fx_csv")
def _(x):
    return x.csv_rows.select("row_key", ingest.has_encounter().alias("present"))


_DEFAULTS = """coalesce(nullif(trim(encounter_type), ''), 'outpatient') AS encounter_type,
    coalesce(nullif(trim(department), ''), 'General') AS department,
    coalesce(nullif(trim(chief_complaint), ''), nullif(trim(diagnosis_description), ''), 'Not specified') AS chief_complaint,
    cast(coalesce(try_strptime(trim(admission_date), '%Y-%m-%d %H:%M:%S'), TIMESTAMP '2020-01-01') AS varchar) AS admission_date,
    CASE WHEN trim(diagnosis_code) <> '' AND trim(diagnosis_description) <> '' THEN trim(diagnosis_description) || ' (' || trim(diagnosis_code) || ')'
         WHEN trim(diagnosis_description) <> '' THEN trim(diagnosis_description)
         WHEN trim(diagnosis_code) <> '' THEN 'ICD: ' || trim(diagnosis_code) ELSE 'Not specified' END AS admission_diagnosis,
    cast(try_strptime(trim(discharge_date), '%Y-%m-%d') AS varchar) AS discharge_date"""


@query("encounter_defaults", f"SELECT row_key, {_DEFAULTS} FROM fx_csv WHERE {_PRESENT}")
def _(x):
    wanted = ["encounter_type", "department", "chief_complaint", "admission_date",
              "admission_diagnosis", "discharge_date"]
    return x.csv_rows.where(ingest.has_encounter()).select(
        "row_key", *ingest.encounter_columns(x.as_of)).select("row_key", *wanted)


@query("csv_ingest_patients", f"""SELECT CASE WHEN patient_id = '' THEN 'generated' ELSE patient_id END AS id,
    any_value(trim(first_name)) AS first_name, any_value(last_name) AS last_name,
    any_value(cast(born AS varchar)) AS date_of_birth, any_value(sex) AS gender, any_value(sys) AS source_system, count(DISTINCT grp) AS n
    FROM (SELECT *, CASE WHEN patient_id = '' THEN row_key ELSE -1 END AS grp FROM fx_csv) WHERE {_GOOD}
    GROUP BY patient_id, CASE WHEN patient_id = '' THEN row_key END""")
def _(x):
    rows = x.ingested.patients
    generated = F.col("source_patient_id").startswith("CSV-PAT-")
    return rows.select(
        F.when(generated, "generated").otherwise(F.col("source_patient_id")).alias("id"), "first_name",
        "last_name", "date_of_birth", "gender", "source_system", F.lit(1).cast("bigint").alias("n"))


@query("csv_ingest_encounters", f"""SELECT CASE WHEN encounter_id = '' THEN 'generated' ELSE encounter_id END AS id,
    sys AS source_system, {_DEFAULTS} FROM fx_csv WHERE {_GOOD} AND {_PRESENT}""")
def _(x):
    generated = F.col("encounter_id").startswith("CSV-ENC-")
    return x.ingested.encounters.select(
        F.when(generated, "generated").otherwise(F.col("encounter_id")).alias("id"), "source_system",
        "encounter_type", "department", "chief_complaint", "admission_date", "admission_diagnosis",
        "discharge_date")


@query("generated_ids", f"""SELECT 'patient' AS kind, count(*) AS n, 'CSV-PAT-00000001' AS first_id,
    'CSV-PAT-' || lpad(cast(count(*) AS varchar), 8, '0') AS last_id FROM fx_csv WHERE {_GOOD} AND trim(patient_id) = ''
    UNION ALL SELECT 'encounter', count(*), 'CSV-ENC-0000000001', 'CSV-ENC-' || lpad(cast(count(*) AS varchar), 10, '0')
    FROM fx_csv WHERE {_GOOD} AND {_PRESENT} AND trim(encounter_id) = ''""")
def _(x):
    def line(rows, kind, column, prefix):
        made = rows.where(F.col(column).startswith(prefix)).select(column).distinct()
        return made.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"),
                        F.min(column).alias("first_id"), F.max(column).alias("last_id"))

    return line(x.ingested.patients, "patient", "source_patient_id", "CSV-PAT-").unionByName(
        line(x.ingested.encounters, "encounter", "encounter_id", "CSV-ENC-"))


@query("csv_issues", f"""SELECT level, 'Row ' || row || ': ' || m AS message FROM (SELECT 'error' AS level, row, unnest(list_filter([
        CASE WHEN trim(first_name) = '' THEN 'Missing first_name' END, CASE WHEN trim(last_name) = '' THEN 'Missing last_name' END,
        CASE WHEN trim(date_of_birth) IN ('31/31/1999', '') THEN 'Invalid or missing date_of_birth ''' || trim(date_of_birth) || '''' END],
        lambda e: e IS NOT NULL)) AS m FROM {_NUMBERED}
    UNION ALL SELECT 'warning', row, 'Missing admission_date, using current date' FROM {_NUMBERED}
    WHERE {_GOOD} AND {_PRESENT} AND trim(admission_date) = '')""")
def _(x):
    return x.ordered.issues.select("level", "message")


@query("file_success", f"""SELECT (SELECT count(*) FROM fx_csv) AS row_count, (SELECT count(*) FROM fx_csv WHERE {_GOOD}) AS valid_row_count,
    (SELECT count(DISTINCT CASE WHEN patient_id = '' THEN 'k' || row_key ELSE patient_id END) FROM fx_csv WHERE {_GOOD}) AS patients,
    (SELECT count(*) FROM ({_ERRORS})) AS errors, CAST(NULL AS varchar) AS file_error, true AS success""")
def _(x):
    return x.ingested.summary


@query("upload_pipeline", f"""SELECT 'persons' AS item, count(DISTINCT national_id) AS n FROM fx_csv WHERE {_GOOD}
    UNION ALL SELECT 'visits', count(*) FROM fx_csv WHERE {_GOOD} AND {_PRESENT}
    UNION ALL SELECT 'conditions', count(*) FROM fx_csv WHERE {_GOOD} AND {_PRESENT} AND diagnosis_code <> '' AND diagnosis_description <> ''
    UNION ALL SELECT 'measurements', 0 UNION ALL SELECT 'drugs', 0
    UNION ALL SELECT concat_ws(', ', sex, sys, encounter_type, department, chief_complaint, admission_diagnosis), count(*) FROM (
        SELECT {_DEFAULTS}, sex, sys FROM fx_csv WHERE {_GOOD} AND {_PRESENT}) GROUP BY 1""")
def _(x):
    """From uploaded files to CDM tables and the file to hand out."""
    folder = shared_dir("handed_out")
    _, done = pipeline.upload(x.upload, x.tokens_config, x.deid_config)
    export.write_deid_csv(export.deid_csv_rows(done.people, done.encounters), folder)
    handed_out = x.spark.read.options(header=True, escape='"', multiLine=True).csv(folder)
    names = {"persons": "person", "visits": "visit_occurrence", "conditions": "condition_occurrence",
             "measurements": "measurement", "drugs": "drug_exposure"}
    rows = [getattr(done.tables, table).agg(F.lit(item).alias("item"), F.count("*").alias("n")) for item, table in names.items()]
    shown = ["gender", "source_system", "encounter_type", "department", "chief_complaint", "admission_diagnosis"]
    return union_all([*rows, handed_out.groupBy(F.concat_ws(", ", *shown).alias("item")).agg(F.count("*").alias("n"))])
