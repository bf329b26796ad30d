"""Turning CSV records into patients, encounters and a list of issues."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspan.config import DEFAULT_AS_OF
from clinspan.functions import normalize as nz
from clinspan.operators.ids import first_row, number_in_order
from clinspan.operators.tables import side_by_side, union_all
from clinspan.session import stored
from clinspan.sources.csv_in import EMPTY_FILE, KNOWN_COLUMNS, RawCsv

PRESENCE_COLUMNS = ["encounter_id", "encounter_type", "admission_date", "department",
                    "diagnosis_code", "diagnosis_description"]
PATIENT_TEXTS = ["national_id", "first_name", "middle_name", "last_name", "family_name",
                 "phone_number", "email", "address_line1", "city", "region", "postal_code", "mrn"]
NO_PATIENTS = "No valid patient records found in CSV"
NO_ADMISSION = "Missing admission_date, using current date"


@dataclass(frozen=True)
class Ingested:
    patients: DataFrame
    encounters: DataFrame
    issues: DataFrame
    summary: DataFrame
    files: DataFrame


def complete(records: DataFrame) -> DataFrame:
    """Records with every known column; a missing column or value is the empty text."""
    return records.select(
        *[c for c in records.columns if c not in KNOWN_COLUMNS],
        *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in records.columns else F.lit("").alias(c)
          for c in KNOWN_COLUMNS])


def row_errors() -> Column:
    """What keeps a record from becoming a patient, as an array of messages."""
    dob = F.trim("date_of_birth")
    return F.array_compact(F.array(
        F.when(F.trim("first_name") == "", "Missing first_name"),
        F.when(F.trim("last_name") == "", "Missing last_name"),
        F.when(nz.parse_date(dob).isNull(),
               F.concat(F.lit("Invalid or missing date_of_birth '"), dob, F.lit("'")))))


def has_encounter() -> Column:
    """Whether any encounter column holds a value."""
    found = F.lit(False)
    for column in PRESENCE_COLUMNS:
        found = found | (F.coalesce(F.col(column), F.lit("")) != "")
    return found


def encounter_columns(as_of: dt.date = DEFAULT_AS_OF) -> list[Column]:
    """Encounter fields of a record with their defaults."""
    def value(column: str, default) -> Column:
        return F.coalesce(nz.blank_to_null(F.col(column)), default)

    diagnosis = nz.diagnosis_string(F.col("diagnosis_code"), F.col("diagnosis_description"))
    discharge = nz.parse_datetime(F.col("discharge_date"))
    admission = nz.parse_datetime(F.col("admission_date"))
    today = F.lit(as_of.isoformat()).cast("timestamp_ntz")
    return [
        value("encounter_type", F.lit("outpatient")).alias("encounter_type"),
        F.coalesce(admission, today).alias("admission_date"), discharge.alias("discharge_date"),
        value("department", F.lit("General")).alias("department"),
        value("chief_complaint", value("diagnosis_description", F.lit("Not specified"))).alias("chief_complaint"),
        diagnosis.alias("admission_diagnosis"),
        F.when(discharge.isNotNull(), diagnosis).alias("discharge_diagnosis"),
        nz.blank_to_null(F.col("clinical_notes")).alias("clinical_notes"),
        admission.isNull().alias("admission_missing"),
    ]


def ingest(raw: RawCsv, as_of: dt.date = DEFAULT_AS_OF) -> Ingested:
    """Patients (first valid record per id), encounters, messages, a one-row summary and a row per file.

    ``src_ord`` names a record by its file and row, so it is unique over all files.
    """
    records = stored("numbered-records", _with_patient_id(complete(raw.records).withColumn("errors", row_errors())))
    numbered = records.where(F.size("errors") == 0)
    first = first_row(numbered, ["source_patient_id"], [F.col("file"), F.col("row")]).withColumn(
        "source_system", nz.source_system(F.col("source_system")))
    patients = first.select(
        "source_system", "source_patient_id", *[nz.blank_to_null(F.col(c)).alias(c) for c in PATIENT_TEXTS],
        nz.parse_date(F.col("date_of_birth")).alias("date_of_birth"),
        nz.parse_gender(F.col("gender")).alias("gender"), "file",
        F.concat("file", F.lit("#"), F.lpad(F.col("row").cast("string"), 12, "0")).alias("src_ord"))
    found = numbered.where(has_encounter()).drop("source_system").select(
        "file", "row", "source_patient_id", "encounter_id", *encounter_columns(as_of))
    encounters = _with_encounter_id(found).join(
        first.select("source_patient_id", "source_system"), "source_patient_id")
    told = union_all([
        records.select("file", "row", F.lit("error").alias("level"), F.explode("errors").alias("message")),
        found.where("admission_missing").select(
            "file", "row", F.lit("warning").alias("level"), F.lit(NO_ADMISSION).alias("message")),
    ]).withColumn("message", F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(": "), "message"))
    rejected = raw.files.where(F.col("error").isNotNull())
    issues = told.unionByName(rejected.select(
        "file", F.lit(1).cast("bigint").alias("row"), F.lit("error").alias("level"), F.col("error").alias("message")))
    return Ingested(patients, encounters.drop("admission_missing"), issues, _summary(records, patients, raw.files),
                    _by_file(records, raw.files))


def _numbered_id(rows: DataFrame, column: str, pattern: str, out: str, among: Column | None = None) -> DataFrame:
    """The given id, or a generated one numbered in record order where it is blank (``among`` the rows it accepts)."""
    blank = F.trim(column) == ""
    numbered = number_in_order(rows, "file", "row", blank if among is None else blank & among, "_new")
    made = F.when(F.col("_new").isNotNull(), F.format_string(pattern, F.col("_new")))
    return numbered.withColumn(out, F.coalesce(made, F.trim(column))).drop("_new")


def _with_patient_id(rows: DataFrame) -> DataFrame:
    return _numbered_id(rows, "patient_id", "CSV-PAT-%08d", "source_patient_id", F.size("errors") == 0)


def _with_encounter_id(rows: DataFrame) -> DataFrame:
    return _numbered_id(rows, "encounter_id", "CSV-ENC-%010d", "encounter_id")


def _counts() -> list[Column]:
    return [F.count("*").alias("row_count"), F.count_if(F.size("errors") == 0).alias("valid_row_count"),
            F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("row_errors")]


def _summary(records: DataFrame, patients: DataFrame, files: DataFrame) -> DataFrame:
    """Counts over all files, and whether the upload counts as read: any valid row, or no error at all."""
    counts = side_by_side(
        records.agg(*_counts()), patients.agg(F.count("*").alias("patients")),
        files.agg(F.count("error").alias("rejected"), F.count_if(F.col("error").isNull()).alias("accepted"),
                  F.min("error").alias("first_error")))
    none = F.col("patients") == 0
    all_rejected = F.col("accepted") == 0
    errors = F.col("row_errors") + F.col("rejected") + F.when(none & ~all_rejected, 1).otherwise(0)
    return counts.select(
        "row_count", "valid_row_count", "patients", errors.alias("errors"),
        F.when(none, F.when(all_rejected, F.coalesce("first_error", F.lit(EMPTY_FILE))).otherwise(NO_PATIENTS)).alias("file_error"),
        ((errors == 0) & ~all_rejected | (F.col("valid_row_count") > 0)).alias("success"))


def _by_file(records: DataFrame, files: DataFrame) -> DataFrame:
    """Counts of each file, its error if it is rejected, and whether it counts as read."""
    counts = files.join(records.groupBy("file").agg(*_counts()), "file", "left").fillna(
        0, ["row_count", "valid_row_count", "row_errors"])
    none = F.col("valid_row_count") == 0
    return counts.select(
        "file", "row_count", "valid_row_count",
        (F.col("row_errors") + F.when(none, 1).otherwise(0)).alias("errors"),
        F.coalesce("error", F.when(none, NO_PATIENTS)).alias("file_error"), (~none).alias("success"))
