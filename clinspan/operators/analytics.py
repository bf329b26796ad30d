"""Population counts, rankings and data quality over the CDM tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspan.config import DEFAULT_AS_OF
from clinspan.fixed import concepts as fixed
from clinspan.functions.normalize import gender_label, percent, percent_text
from clinspan.operators import insights
from clinspan.operators.cdm import Cdm
from clinspan.operators.ids import first_row
from clinspan.operators.linkage import token_map
from clinspan.operators.tables import side_by_side, union_all
from clinspan.session import constant_table


def dataset_summary(tokened: DataFrame, encounters: DataFrame, observations: DataFrame) -> DataFrame:
    return side_by_side(
        tokened.agg(F.count("*").alias("total_patient_records")),
        token_map(tokened).agg(F.count_distinct("patient_token").alias("unique_individuals")),
        encounters.agg(F.count("*").alias("total_encounters")),
        observations.agg(F.count("*").alias("total_observations")))


def totals(cdm: Cdm) -> DataFrame:
    """Row counts of the five tables."""
    return side_by_side(
        cdm.person.agg(F.count("*").alias("total_persons")),
        cdm.visit_occurrence.agg(F.count("*").alias("total_visits")),
        cdm.condition_occurrence.agg(F.count("*").alias("total_conditions")),
        cdm.measurement.agg(F.count("*").alias("total_measurements")),
        cdm.drug_exposure.agg(F.count("*").alias("total_drug_exposures")))


def frequency(rows: DataFrame, concept: str) -> DataFrame:
    return rows.groupBy(F.col(concept).alias("concept_id")).agg(F.count("*").alias("count"))


def _named(counts: DataFrame, names: list[tuple], fallback: str) -> DataFrame:
    table = constant_table("concept_id bigint, name string", names)
    return counts.join(table, "concept_id", "left").withColumn(
        "name", F.coalesce("name", F.concat(F.lit(fallback), F.col("concept_id").cast("string"))))


def top_conditions(cdm: Cdm, k: int = 10) -> DataFrame:
    """Most frequent condition concepts; equal counts go to the lower concept id."""
    top = frequency(cdm.condition_occurrence, "condition_concept_id").orderBy(
        F.col("count").desc(), "concept_id").limit(k)
    return _named(top, fixed.CONDITION_NAMES, "SNOMED ")


def top_medications(cdm: Cdm, k: int = 10) -> DataFrame:
    """Most frequent drug concepts, named by their cohort alias."""
    top = frequency(cdm.drug_exposure, "drug_concept_id").orderBy(
        F.col("count").desc(), "concept_id").limit(k)
    return _named(top, [(i, n) for n, i in fixed.COHORT_ALIASES], "RxNorm ")


def _shares(rows: DataFrame, concept: str, source: str, names: list[tuple], prefix: str,
            k: int) -> DataFrame:
    """The k most frequent display names with their share of all rows.

    Counting goes by concept and source code first, so names are looked up once per code.
    """
    table = constant_table(f"{concept} bigint, label string", names)
    by_code = rows.groupBy(concept, source).agg(F.count("*").alias("n"))
    text = F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit(prefix), F.col(source))).otherwise("Unknown")
    by_name = (by_code.join(table, concept, "left").withColumn("name", F.coalesce("label", text))
               .groupBy("name").agg(F.sum("n").alias("count")))
    whole = by_code.agg(F.sum("n")).scalar()
    return by_name.orderBy(F.col("count").desc(), "name").limit(k).select(
        "name", "count", percent_text(F.col("count"), whole).alias("percentage"))


def top_condition_shares(cdm: Cdm, k: int = 5) -> DataFrame:
    return _shares(cdm.condition_occurrence, "condition_concept_id", "condition_source_value",
                   fixed.CONDITION_NAMES, "ICD-10 ", k)


def top_medication_shares(cdm: Cdm, k: int = 5) -> DataFrame:
    return _shares(cdm.drug_exposure, "drug_concept_id", "drug_source_value",
                   [(i, n) for _, i, n in fixed.RXNORM_CONCEPTS], "RxNorm ", k)


def region_lookup(cdm: Cdm, deid_patients: DataFrame) -> DataFrame:
    """Region per person from the last source record of the person's token."""
    last = first_row(deid_patients.select("patient_token", "region", "src_ord"),
                     ["patient_token"], [F.col("src_ord").desc()])
    regions = last.select(F.col("patient_token").alias("person_source_value"), "region")
    return cdm.person.join(regions, "person_source_value", "left").withColumn(
        "region", F.coalesce("region", F.lit("Unknown")))


def patient_list(cdm: Cdm, deid_patients: DataFrame, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """All persons with age, sex, region and a display label, sorted by id."""
    age = F.lit(as_of.year) - F.col("year_of_birth")
    gender = gender_label(F.col("gender_concept_id"))
    return region_lookup(cdm, deid_patients).select(
        "person_id", age.alias("age"), gender.alias("gender"), "region",
        F.format_string("Patient %d (%dy %s, %s)", F.col("person_id"), age,
                        F.substring(gender, 1, 1), F.col("region")).alias("display_name"),
    ).orderBy("person_id")


# FIXED VALUES: data-quality measures with the rate from which they are good
QUALITY_LINES = [
    ("demographics_completeness", "Demographics Completeness", 90),
    ("snomed_mapping", "Diagnosis → SNOMED Mapping", 80),
    ("loinc_mapping", "Labs → LOINC Mapping", 80),
    ("rxnorm_mapping", "Medications → RxNorm Mapping", 80),
]


def data_quality(cdm: Cdm) -> DataFrame:
    """Completeness and mapping rates, one row per measure; an empty table counts as one row."""
    complete = (F.col("gender_concept_id") != 0) & (F.col("year_of_birth") != 0)
    sources = [
        (cdm.person, complete),
        (cdm.condition_occurrence, F.col("condition_concept_id") > 0),
        (cdm.measurement, F.col("measurement_concept_id") > 0),
        (cdm.drug_exposure, F.col("drug_concept_id") > 0),
    ]

    def line(fixed_row: tuple, rows: DataFrame, good: Column) -> DataFrame:
        key, name, target = fixed_row
        counts = rows.agg(F.count_if(good).alias("numerator"),
                          F.greatest(F.count("*"), F.lit(1)).alias("denominator"))
        rate = percent(F.col("numerator"), F.col("denominator"))
        return counts.select(
            F.lit(key).alias("metric"), F.lit(name).alias("name"), "numerator", "denominator",
            rate.alias("rate"),
            F.when(rate >= target, "good").otherwise("needs_attention").alias("status"))

    return union_all([line(f, *s) for f, s in zip(QUALITY_LINES, sources)])


def data_quality_score(cdm: Cdm) -> DataFrame:
    """Mean of the four rates, summed in their declared order."""
    rates = data_quality(cdm).agg(*[
        F.max(F.when(F.col("metric") == key, F.col("rate"))).alias(key) for key, _, _ in QUALITY_LINES])
    keys = [F.col(key) for key, _, _ in QUALITY_LINES]
    return rates.select(
        F.round((keys[0] + keys[1] + keys[2] + keys[3]) / 4, 1).alias("overall_quality_score"))


def executive_summary(cdm: Cdm, source_patients: DataFrame, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """One row of headline figures; the two top-five lists are tables of their own."""
    quality = insights.quality_overview(cdm).select(
        F.col("overall_quality_score").alias("quality_score"), "gaps_identified", "metrics_met")
    risk = insights.readmission_risk(cdm, as_of).agg(
        F.count_if(F.col("risk_level") == "High").alias("high_risk_patients"))
    row = side_by_side(
        totals(cdm), source_patients.agg(F.count("*").alias("source_records_ingested")), quality, risk)
    people = F.col("total_persons")
    return row.select(
        people.alias("unique_patients"), "source_records_ingested",
        F.greatest(F.col("source_records_ingested") - people, F.lit(0)).alias("duplicate_records_linked"),
        "total_visits", "total_conditions", F.col("total_measurements").alias("total_lab_results"),
        F.col("total_drug_exposures").alias("total_medications"),
        "quality_score", "gaps_identified", "metrics_met", "high_risk_patients",
        percent_text(F.col("high_risk_patients"), F.greatest(people, F.lit(1))).alias("high_risk_percentage"))
