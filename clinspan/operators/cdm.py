"""Mapping de-identified rows to the OMOP common data model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspan.fixed import concepts as fixed
from clinspan.functions.normalize import icd_code
from clinspan.operators.ids import dense_id, first_row
from clinspan.operators.tables import union_all
from clinspan.session import constant_table


TABLES = ("person", "visit_occurrence", "condition_occurrence", "measurement", "drug_exposure")


@dataclass(frozen=True)
class Cdm:
    """The five tables. ``by_person``: their rows lie by person, and no person has very many, so work per person needs no
    shuffle. ``parts``: the same rows as tables without a person in common, where some persons have very many."""

    person: DataFrame
    visit_occurrence: DataFrame
    condition_occurrence: DataFrame
    measurement: DataFrame
    drug_exposure: DataFrame
    by_person: bool = False
    parts: tuple[Cdm, ...] = ()

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def each(self, work: Callable[[Cdm], DataFrame]) -> DataFrame:
        """``work``, whose result for a person depends on that person's rows only, done on every part."""
        return union_all([work(part) for part in self.parts or (self,)])


# FIXED VALUES: declared columns a table has beyond the populated ones; "=0" marks a zero default
DECLARED = {
    "person": "month_of_birth int, day_of_birth int, birth_datetime timestamp_ntz, race_concept_id bigint=0, ethnicity_concept_id bigint=0, location_id bigint, provider_id bigint, care_site_id bigint, race_source_value string, ethnicity_source_value string",
    "visit_occurrence": "provider_id bigint, care_site_id bigint, visit_source_concept_id bigint=0, admitted_from_concept_id bigint=0, admitted_from_source_value string, discharged_to_concept_id bigint=0, discharged_to_source_value string, preceding_visit_occurrence_id bigint",
    "condition_occurrence": "condition_end_date date, condition_end_datetime timestamp_ntz, condition_status_concept_id bigint=0, stop_reason string, provider_id bigint, visit_detail_id bigint, condition_source_concept_id bigint=0, condition_status_source_value string",
    "measurement": "measurement_time string, operator_concept_id bigint=0, value_as_concept_id bigint=0, unit_concept_id bigint=0, provider_id bigint, visit_occurrence_id bigint, visit_detail_id bigint, measurement_source_concept_id bigint=0, value_source_value string",
    "drug_exposure": "drug_exposure_end_datetime timestamp_ntz, verbatim_end_date date, stop_reason string, refills int, quantity double, days_supply int, route_concept_id bigint=0, lot_number string, provider_id bigint, visit_occurrence_id bigint, visit_detail_id bigint, drug_source_concept_id bigint=0",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Add the declared columns of a CDM table that no source fills."""
    for declared in DECLARED[table].split(", "):
        name, kind = declared.split(" ")
        if name not in df.columns:
            kind, _, default = kind.partition("=")
            df = df.withColumn(name, F.lit(int(default) if default else None).cast(kind))
    return df


def person_index(*token_tables: DataFrame) -> DataFrame:
    """person_id 1..N for every token met in any of the tables, in token order."""
    tokens = token_tables[0].select("patient_token")
    for table in token_tables[1:]:
        tokens = tokens.unionByName(table.select("patient_token"))
    return dense_id(tokens.distinct(), F.substring("patient_token", 4, 16), "person_id", unique=True)


def _with_person(rows: DataFrame, index: DataFrame | None) -> DataFrame:
    return rows if "person_id" in rows.columns else rows.join(index, "patient_token")


def _lookup(rows: DataFrame, code: str, mapping: list, concept: str, name: str) -> DataFrame:
    """Left lookup of a source code; unmapped codes keep their row with concept 0."""
    table = constant_table(f"{code} string, {concept} bigint, {name} string", mapping)
    return rows.join(table, code, "left").withColumn(concept, F.coalesce(concept, F.lit(0).cast("bigint")))


def icd_to_snomed(rows: DataFrame, code: str = "icd_code") -> DataFrame:
    return _lookup(rows.withColumnRenamed(code, "icd_code"), "icd_code", fixed.ICD_TO_SNOMED,
                   "condition_concept_id", "concept_name")


def loinc_to_concept(rows: DataFrame, code: str = "observation_code") -> DataFrame:
    return _lookup(rows.withColumnRenamed(code, "observation_code"), "observation_code",
                   fixed.LOINC_CONCEPTS, "measurement_concept_id", "concept_name")


def rxnorm_to_concept(rows: DataFrame, code: str = "observation_code") -> DataFrame:
    return _lookup(rows.withColumnRenamed(code, "observation_code"), "observation_code",
                   fixed.RXNORM_CONCEPTS, "drug_concept_id", "concept_name")


def gender_concept(gender):
    known = F.create_map(*[F.lit(x) for pair in fixed.GENDER_CONCEPTS for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(gender, F.lit(""))),
                      F.lit(fixed.UNKNOWN_GENDER_CONCEPT)).cast("bigint")


def visit_concept(encounter_type):
    known = F.create_map(*[F.lit(x) for pair in fixed.VISIT_CONCEPTS for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(encounter_type, F.lit(""))),
                      F.lit(fixed.DEFAULT_VISIT_CONCEPT)).cast("bigint")


def person(deid_patients: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """One PERSON row per token; the first source record fills it."""
    rows = _with_person(deid_patients, index).select(
        "person_id", "src_ord", "patient_token", "gender", "year_of_birth")
    first = first_row(rows, ["person_id"], [F.col("src_ord")])
    return first.select(
        "person_id", gender_concept(F.col("gender")).alias("gender_concept_id"),
        F.coalesce("year_of_birth", F.lit(1900)).alias("year_of_birth"),
        F.col("patient_token").alias("person_source_value"),
        F.coalesce("gender", F.lit("unknown")).alias("gender_source_value"))


def _visits(deid_encounters: DataFrame, index: DataFrame | None, unique_ids: bool = False) -> DataFrame:
    """Encounter columns both visits and conditions need, with both ids from one numbering pass."""
    rows = _with_person(deid_encounters, index).select(
        "person_id", "encounter_id", "encounter_type", "admission_date", "discharge_date",
        icd_code(F.col("admission_diagnosis")).alias("icd_code"))
    return dense_id(rows, F.col("encounter_id"), "visit_occurrence_id", unique=unique_ids,
                    also={"condition_occurrence_id": F.col("icd_code").isNotNull()})


def _visit_rows(visits: DataFrame) -> DataFrame:
    return visits.select(
        "visit_occurrence_id", "person_id",
        visit_concept(F.col("encounter_type")).alias("visit_concept_id"),
        F.to_date("admission_date").alias("visit_start_date"),
        F.col("admission_date").alias("visit_start_datetime"),
        F.to_date(F.coalesce("discharge_date", "admission_date")).alias("visit_end_date"),
        F.col("discharge_date").alias("visit_end_datetime"),
        F.lit(fixed.VISIT_TYPE_CONCEPT).cast("bigint").alias("visit_type_concept_id"),
        F.col("encounter_id").alias("visit_source_value"))


def _condition_rows(visits: DataFrame) -> DataFrame:
    return icd_to_snomed(visits.where(F.col("icd_code").isNotNull())).select(
        "condition_occurrence_id", "person_id", "condition_concept_id",
        F.to_date("admission_date").alias("condition_start_date"),
        F.col("admission_date").alias("condition_start_datetime"),
        F.lit(fixed.CONDITION_TYPE_CONCEPT).cast("bigint").alias("condition_type_concept_id"),
        "visit_occurrence_id", F.col("icd_code").alias("condition_source_value"))


def visit_occurrence(deid_encounters: DataFrame, index: DataFrame | None = None) -> DataFrame:
    return _visit_rows(_visits(deid_encounters, index))


def condition_occurrence(deid_encounters: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Conditions from coded admission diagnoses; a text without a code gives no row."""
    return _condition_rows(_visits(deid_encounters, index))


def _coded(deid_observations: DataFrame, kind: str) -> DataFrame:
    return deid_observations.where((F.col("observation_type") == kind)
                                   & (F.coalesce("observation_code", F.lit("")) != ""))


def measurement(deid_observations: DataFrame, index: DataFrame | None = None, unique_ids: bool = False) -> DataFrame:
    """Coded lab results."""
    rows = _with_person(_coded(deid_observations, "lab_result"), index).select(
        "person_id", "observation_id", "observation_code", "observation_datetime", "value_numeric",
        "value_unit", "reference_range_low", "reference_range_high")
    numbered = dense_id(rows, F.col("observation_id"), "measurement_id", unique=unique_ids)
    return loinc_to_concept(numbered).select(
        "measurement_id", "person_id", "measurement_concept_id",
        F.to_date("observation_datetime").alias("measurement_date"),
        F.col("observation_datetime").alias("measurement_datetime"),
        F.lit(fixed.MEASUREMENT_TYPE_CONCEPT).cast("bigint").alias("measurement_type_concept_id"),
        F.col("value_numeric").alias("value_as_number"),
        F.col("value_unit").alias("unit_source_value"),
        F.col("reference_range_low").alias("range_low"),
        F.col("reference_range_high").alias("range_high"),
        F.col("observation_code").alias("measurement_source_value"))


def drug_exposure(deid_observations: DataFrame, index: DataFrame | None = None, unique_ids: bool = False) -> DataFrame:
    """Coded medications; an exposure ends on the day it starts."""
    rows = _with_person(_coded(deid_observations, "medication"), index).select(
        "person_id", "observation_id", "observation_code", "observation_datetime", "value_text",
        "route", "dose")
    numbered = dense_id(rows, F.col("observation_id"), "drug_exposure_id", unique=unique_ids)
    day = F.to_date("observation_datetime")
    return rxnorm_to_concept(numbered).select(
        "drug_exposure_id", "person_id", "drug_concept_id",
        day.alias("drug_exposure_start_date"),
        F.col("observation_datetime").alias("drug_exposure_start_datetime"),
        day.alias("drug_exposure_end_date"),
        F.lit(fixed.DRUG_TYPE_CONCEPT).cast("bigint").alias("drug_type_concept_id"),
        F.col("value_text").alias("sig"), F.col("route").alias("route_source_value"),
        F.col("dose").alias("dose_unit_source_value"),
        F.col("observation_code").alias("drug_source_value"))


def build(deid_patients: DataFrame, deid_encounters: DataFrame, deid_observations: DataFrame,
          keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df, unique: tuple[str, ...] = ()) -> Cdm:
    """The five populated tables. Inputs may already carry ``person_id``; otherwise it is assigned
    over the tokens of all three. ``keep`` may store the numbered encounters, which visits and
    conditions share. ``unique`` names ids declared to be unique ("encounter_id", "observation_id"), which spares their rows a shuffle."""
    inputs = (deid_patients, deid_encounters, deid_observations)
    index = None
    if not all("person_id" in t.columns for t in inputs):
        index = person_index(*inputs)
        inputs = tuple(t.drop("person_id") for t in inputs)
    patients, encounters, observations = inputs
    visits = keep("numbered_encounter", _visits(encounters, index, "encounter_id" in unique))
    one_each = "observation_id" in unique
    return Cdm(person(patients, index), _visit_rows(visits), _condition_rows(visits),
               measurement(observations, index, one_each), drug_exposure(observations, index, one_each))


def cdm_report(deid_patients: DataFrame, cdm: Cdm) -> DataFrame:
    """Transformation counts per ``source -> target`` and how many found a concept.

    Every patient record counts as one transformation; visits report no concept.
    """
    def line(rows: DataFrame, name: str, concept: str | None) -> DataFrame:
        mapped = F.count_if(F.col(concept) != 0) if concept else F.lit(None).cast("bigint")
        return rows.agg(F.lit(name).alias("transformation"), F.count("*").alias("rows"),
                        mapped.alias("mapped"))

    lines = [
        line(deid_patients, "patient -> person", None),
        line(cdm.visit_occurrence, "encounter -> visit_occurrence", None),
        line(cdm.condition_occurrence, "diagnosis -> condition_occurrence", "condition_concept_id"),
        line(cdm.measurement, "lab_result -> measurement", "measurement_concept_id"),
        line(cdm.drug_exposure, "medication -> drug_exposure", "drug_concept_id"),
    ]
    report = lines[0]
    for other in lines[1:]:
        report = report.unionByName(other)
    return report


def mapping_demo(deid_patients: DataFrame, deid_encounters: DataFrame,
                 deid_observations: DataFrame) -> DataFrame:
    """Each source row next to its target table, concept and the mappings applied, as text."""
    patient = deid_patients.select(
        F.lit("patient").alias("data_type"), F.lit("PERSON").alias("omop_table"),
        F.col("patient_token").alias("source_id"),
        gender_concept(F.col("gender")).alias("concept_id"),
        F.array(F.format_string("Gender '%s' -> concept_id %d", F.col("gender"),
                                gender_concept(F.col("gender"))),
                F.lit("Token -> person_source_value")).alias("mappings_applied"))
    coded = icd_to_snomed(deid_encounters.withColumn("icd_code", icd_code(F.col("admission_diagnosis"))))
    encounter = coded.select(
        F.lit("encounter").alias("data_type"), F.lit("VISIT_OCCURRENCE").alias("omop_table"),
        F.col("encounter_id").alias("source_id"),
        visit_concept(F.col("encounter_type")).alias("concept_id"),
        F.array_compact(F.array(
            F.format_string("Type '%s' -> concept_id %d", F.col("encounter_type"),
                            visit_concept(F.col("encounter_type"))),
            F.when(F.col("icd_code").isNotNull(),
                   F.format_string("ICD-10 '%s' -> SNOMED concept_id %d", F.col("icd_code"),
                                   F.col("condition_concept_id"))))).alias("mappings_applied"))
    parts = [patient, encounter]
    for kind, lookup, concept, table, vocabulary in (
            ("lab_result", loinc_to_concept, "measurement_concept_id", "MEASUREMENT", "LOINC"),
            ("medication", rxnorm_to_concept, "drug_concept_id", "DRUG_EXPOSURE", "RxNorm")):
        parts.append(lookup(_coded(deid_observations, kind)).select(
            F.lit(kind).alias("data_type"), F.lit(table).alias("omop_table"),
            F.col("observation_id").alias("source_id"), F.col(concept).alias("concept_id"),
            F.array(F.format_string(f"{vocabulary} '%s' -> concept_id %d", F.col("observation_code"),
                                    F.col(concept))).alias("mappings_applied")))
    demo = parts[0]
    for part in parts[1:]:
        demo = demo.unionByName(part)
    return demo
