"""Linking source records of one person by keyed token."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspan.config import TokenConfig
from clinspan.functions.normalize import composite_key
from clinspan.functions.secure import patient_token


def with_token(patients: DataFrame, config: TokenConfig) -> DataFrame:
    """Patient records with their composite key and token."""
    key = composite_key(F.col("national_id"), F.col("date_of_birth"), F.col("first_name"),
                        F.col("last_name"), F.col("gender"))
    return (patients.withColumn("composite_key", key)
            .withColumn("patient_token", patient_token(F.col("composite_key"), config)))


def token_map(tokened: DataFrame) -> DataFrame:
    """One token per source patient id; the last record of an id decides."""
    return tokened.groupBy("source_patient_id").agg(
        F.max_by("patient_token", "src_ord").alias("patient_token"))


def attach(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows joined with the token (and whatever else ``links`` holds) of their source patient.

    Rows without a token drop out. A source patient with very many rows is split by adaptive skew
    handling, since ``links`` has one row per id.
    """
    return rows.join(links, "source_patient_id")


def linkage_groups(tokened: DataFrame, minimum: int = 2) -> DataFrame:
    """The records of every token with at least ``minimum`` records, one row per record.

    A token with very many records stays spread over tasks: only its count is aggregated.
    """
    current = tokened.drop("patient_token").join(token_map(tokened), "source_patient_id")
    sizes = (current.groupBy("patient_token").agg(F.count("*").alias("record_count"))
             .where(F.col("record_count") >= minimum))
    return current.join(sizes, "patient_token").select(
        "patient_token", "record_count", "src_ord", "source_system", "source_patient_id", "mrn",
        F.concat_ws(" ", "first_name", "last_name").alias("name"),
        F.col("date_of_birth").alias("dob"))


def _ids_per_token(tokened: DataFrame) -> DataFrame:
    return (tokened.select("patient_token", "source_patient_id").distinct()
            .groupBy("patient_token").agg(F.count("*").alias("records")))


def linkage_statistics(tokened: DataFrame) -> DataFrame:
    """One row: tokens, linked source ids, tokens with several ids, mean ids per token."""
    return _ids_per_token(tokened).agg(
        F.count("*").alias("total_unique_tokens"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_patient_records"),
        F.count_if(F.col("records") > 1).alias("patients_with_multi_system_records"),
        F.coalesce(F.round(F.sum("records") / F.nullif(F.count("*"), F.lit(0)), 2), F.lit(0.0))
         .alias("average_records_per_patient"))


def link_distribution(tokened: DataFrame) -> DataFrame:
    """Number of tokens per number of linked source ids."""
    return _ids_per_token(tokened).groupBy("records").agg(F.count("*").alias("tokens"))


def linked_patient(tokened: DataFrame, encounters: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per person: record, encounter and observation counts and the record date span.

    Member records are the row tables of :func:`linked_source_record` and :func:`attach`; they are
    not packed into arrays, as one person's rows may not fit one task. Encounters and observations
    are counted per source id first, so the joins see one row per id and never multiply each other.
    """
    links = token_map(tokened)
    people = linked_source_record(tokened).groupBy("patient_token").agg(
        F.count("*").alias("source_records"),
        F.count_distinct("source_system").alias("source_systems_count"),
        F.min("date_of_birth").alias("_born_first"), F.max("date_of_birth").alias("_born_last"))
    visits = attach(encounters.groupBy("source_patient_id").agg(
        F.count("*").alias("_n"), F.min("admission_date").alias("_lo"),
        F.max("admission_date").alias("_hi")), links).groupBy("patient_token").agg(
        F.sum("_n").alias("_encounters"), F.to_date(F.min("_lo")).alias("_first"),
        F.to_date(F.max("_hi")).alias("_last"))
    results = attach(observations.groupBy("source_patient_id").agg(F.count("*").alias("_n")), links).groupBy(
        "patient_token").agg(F.sum("_n").alias("_observations"))
    return (people.join(visits, "patient_token", "left").join(results, "patient_token", "left")
            .select("patient_token", "source_records", "source_systems_count",
                    F.coalesce("_encounters", F.lit(0)).alias("total_encounters"),
                    F.coalesce("_observations", F.lit(0)).alias("total_observations"),
                    F.least("_born_first", "_first").alias("earliest_record_date"),
                    F.greatest("_born_last", "_last").alias("latest_record_date")))


def linked_source_record(tokened: DataFrame) -> DataFrame:
    """Source records with the token their source id ends up with."""
    return tokened.drop("patient_token").join(token_map(tokened), "source_patient_id").select(
        "patient_token", "source_system", "source_patient_id", "mrn", "date_of_birth", "src_ord")


def linkage_check(tokened: DataFrame, group: list[str]) -> DataFrame:
    """Per group of records expected to be one person: did they get exactly one token?"""
    return tokened.groupBy(*group).agg(
        F.count("*").alias("records_found"),
        F.count_distinct("patient_token").alias("unique_tokens_generated"),
        F.min("patient_token").alias("common_token"),
    ).withColumn("successfully_linked", F.col("unique_tokens_generated") == 1).withColumn(
        "common_token", F.when(F.col("successfully_linked"), F.col("common_token")))


def token_lookup(tokened: DataFrame) -> DataFrame:
    """Every (token, source patient id) pair ever seen, for lookups in both directions."""
    return tokened.select("patient_token", "source_patient_id").distinct()
