"""De-identification of patients, encounters and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspan.config import DeidConfig
from clinspan.fixed import concepts as fixed
from clinspan.functions.normalize import age_on
from clinspan.functions.redact import redact_note
from clinspan.functions.secure import hashed_id, shift_datetime, shift_days
from clinspan.operators.ids import dense_id, first_row
from clinspan.operators.linkage import attach
from clinspan.operators.tables import side_by_side

VITALS = [
    "temperature_celsius", "heart_rate_bpm", "blood_pressure_systolic",
    "blood_pressure_diastolic", "respiratory_rate", "oxygen_saturation", "weight_kg", "height_cm",
]


def _shift(config: DeidConfig) -> Column:
    key = {"source": "source_patient_id", "token": "patient_token"}[config.shift_key]
    return shift_days(F.col(key), config)


def _extra(links: DataFrame) -> list[str]:
    return [c for c in links.columns if c not in ("source_patient_id", "patient_token")]


def surrogate_names(patients: DataFrame) -> DataFrame:
    """``Patient_M0001`` / ``Patient_F0001`` per source patient id, numbered per sex class.

    Numbers follow the hash of the id instead of arrival order.
    """
    one = first_row(patients.select("source_patient_id", "gender", "src_ord"),
                    ["source_patient_id"], [F.col("src_ord")])
    classed = one.select(
        "source_patient_id", F.when(F.col("gender") == "male", "M").otherwise("F").alias("sex_class"))
    numbered = dense_id(classed, F.sha2("source_patient_id", 256), "number",
                        within="sex_class", unique=True)
    return numbered.select(
        "source_patient_id", "sex_class",
        F.concat(F.lit("Patient_"), F.col("sex_class"),
                 F.format_string("%04d", F.col("number"))).alias("surrogate_id"))


def _masked(patients: DataFrame, links: DataFrame, config: DeidConfig) -> DataFrame:
    """Patient records with their token and, in columns of their own, their de-identified values."""
    rows = attach(patients, links)
    if config.use_surrogate_names:
        rows = rows.join(surrogate_names(patients), "source_patient_id")
    else:
        rows = rows.withColumn("surrogate_id", F.lit(None).cast("string"))
    age = age_on(F.col("date_of_birth"), config.as_of)
    capped = age > config.age_threshold
    shifted = F.year(F.date_add("date_of_birth", _shift(config)))
    if config.legacy_yob:
        capped_year = shifted - config.age_threshold
    else:
        capped_year = F.lit(config.as_of.year - config.age_threshold - 1)
    region = F.nullif("region", F.lit("")) if config.generalize_location else F.lit(None).cast("string")
    return rows.withColumns({
        "year_of_birth": F.when(capped, capped_year).otherwise(shifted), "age_group": F.when(capped, "90+"),
        "age_at_data_collection": F.when(~capped, age), "kept_region": region})


def deid_patient(patients: DataFrame, links: DataFrame, config: DeidConfig) -> DataFrame:
    """Patients without direct identifiers: token, surrogate, birth year or age group, sex, region."""
    return _masked(patients, links, config).select(
        "src_ord", *_extra(links), "patient_token", "source_system", "surrogate_id", "year_of_birth", "age_group",
        "age_at_data_collection", "gender", F.col("kept_region").alias("region"))


def _complete(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows with the named columns; one that the source lacks, as an upload does, is NULL."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})


def _shifted(rows: DataFrame, links: DataFrame, config: DeidConfig, *times: str) -> DataFrame:
    """Attach tokens and move the named datetimes by the days of their source id (or token)."""
    rows = attach(rows, links)
    days = _shift(config)
    return rows.withColumns({t: shift_datetime(F.col(t), days) for t in times})


def deid_encounter(encounters: DataFrame, links: DataFrame, config: DeidConfig) -> DataFrame:
    """Encounters with hashed id, shifted dates and masked notes, without the provider.

    Hashing and masking happen before the join, at the parallelism of the scan, so only reduced
    rows are shuffled.
    """
    encounters = _complete(encounters, {v: "double" for v in VITALS})
    note = F.lit(None).cast("string")
    if config.redact_clinical_notes:
        note = F.nullif(redact_note(F.col("clinical_notes"), config.redact_order, config.strict_case),
                        F.lit(""))
    reduced = encounters.select(
        "source_patient_id", hashed_id(F.col("encounter_id")).alias("encounter_id"),
        "source_system", "encounter_type", "admission_date", "discharge_date", "department",
        "chief_complaint", "admission_diagnosis", "discharge_diagnosis",
        note.alias("clinical_notes"), F.struct(*VITALS).alias("vitals"))
    kept = [c for c in reduced.columns if c != "source_patient_id"]
    return _shifted(reduced, links, config, "admission_date", "discharge_date").select(
        *_extra(links), "patient_token", *kept)


def deid_observation(observations: DataFrame, links: DataFrame, config: DeidConfig) -> DataFrame:
    """Observations with hashed id and shifted time, without encounter and provider."""
    reduced = observations.select(
        "source_patient_id", hashed_id(F.col("observation_id")).alias("observation_id"),
        "source_system", "observation_type", "observation_code", "observation_code_system",
        "observation_name", "observation_datetime", "value_numeric", "value_text", "value_unit",
        "reference_range_low", "reference_range_high", "abnormal_flag", "dose", "route", "frequency")
    kept = [c for c in reduced.columns if c != "source_patient_id"]
    return _shifted(reduced, links, config, "observation_datetime").select(
        *_extra(links), "patient_token", *kept)


def patient_actions(deid_patients: DataFrame, config: DeidConfig) -> DataFrame:
    """One row per patient record and action taken on it."""
    named = "replaced_name_with_surrogate" if config.use_surrogate_names else "removed_name"
    actions = F.array_compact(F.array(
        F.lit(named), F.lit("removed_direct_identifiers"),
        F.when(F.col("age_group").isNotNull(), "generalized_age_over_89")
         .otherwise("shifted_dates_year_only"),
        F.lit("removed_contact_info"),
        F.when(F.col("region").isNotNull(), "generalized_location_to_region"),
        F.lit("removed_mrn_used_token")))
    return deid_patients.select("patient_token", F.explode(actions).alias("action"))


def action_summary(deid_patients: DataFrame, config: DeidConfig) -> DataFrame:
    return patient_actions(deid_patients, config).groupBy("action").agg(F.count("*").alias("count"))


def deid_report(patients: DataFrame, encounters: DataFrame, observations: DataFrame,
                links: DataFrame, config: DeidConfig) -> DataFrame:
    """One row: records de-identified, ids whose dates moved, surrogates per sex class, settings."""
    totals = attach(patients.select("source_patient_id"), links).agg(
        F.count("*").alias("total_patients_deidentified"))
    ids = [attach(t.select("source_patient_id").distinct(), links).select("source_patient_id")
           for t in (patients, encounters, observations)]
    shifted = ids[0].unionByName(ids[1]).unionByName(ids[2]).distinct().agg(
        F.count("*").alias("total_date_shifts_applied"))
    one = first_row(attach(patients.select("source_patient_id", "gender", "src_ord"), links),
                    ["source_patient_id"], [F.col("src_ord")])
    sexes = one.agg(
        F.count_if(F.col("gender") == "male").alias("male_surrogates"),
        F.count_if(F.col("gender") != "male").alias("female_surrogates"))
    if not config.use_surrogate_names:
        sexes = sexes.select(F.lit(0).cast("bigint").alias("male_surrogates"),
                             F.lit(0).cast("bigint").alias("female_surrogates"))
    low, high = config.date_shift_range
    return side_by_side(totals, shifted, sexes).select(
        "*", F.lit(fixed.DEID_METHOD).alias("method"),
        F.lit(len(fixed.SENSITIVE_IDENTIFIERS)).alias("identifier_categories"),
        F.lit(low).alias("date_shift_low"), F.lit(high).alias("date_shift_high"),
        F.lit(config.age_threshold).alias("age_threshold"),
        F.lit(config.use_surrogate_names).alias("surrogate_names"),
        F.lit(config.generalize_location).alias("location_generalization"),
        F.lit(config.redact_clinical_notes).alias("clinical_notes_redaction"))


# FIXED VALUES: wording of the before/after comparison
REMOVED_ALWAYS_FIRST = [
    "Full name (first, middle, last)", "National ID (Iqama)",
    "Exact date of birth (month + day)", "Phone number",
]
REMOVED_EMAIL = "Email address"
REMOVED_ALWAYS_LAST = ["Street address", "City", "Postal code", "Medical record number (MRN)"]


def before_after(patients: DataFrame, links: DataFrame, config: DeidConfig) -> DataFrame:
    """Identifying values next to their de-identified form, with the list of removed identifiers.

    Both come out of one row, so they cannot belong to different records.
    """
    removed = F.array_compact(F.array(
        *[F.lit(x) for x in REMOVED_ALWAYS_FIRST],
        F.when(F.col("email") != "", REMOVED_EMAIL),
        *[F.lit(x) for x in REMOVED_ALWAYS_LAST]))
    part = {c: F.coalesce(F.nullif(c, F.lit("")), F.lit("None"))
            for c in ("address_line1", "city", "region")}
    return _masked(patients, links, config).select(
        "src_ord",
        F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in ("first_name", "middle_name", "last_name")])
         .alias("name"),
        "national_id", "date_of_birth", F.col("phone_number").alias("phone"), "email",
        F.concat_ws(", ", part["address_line1"], part["city"], part["region"]).alias("address"),
        "mrn", removed.alias("phi_removed"), F.size(removed).alias("identifiers_removed_count"),
        "patient_token", "surrogate_id", "year_of_birth", "age_group", "kept_region")
