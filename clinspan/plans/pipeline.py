"""The pipeline from source records to stored CDM tables, and its step report."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clinspan.config import DeidConfig, TokenConfig
from clinspan.fixed import concepts as fixed
from clinspan.operators import cdm, deid, ingest, linkage, notes
from clinspan.operators.ids import remembered_ids
from clinspan.operators.tables import side_by_side, union_all
from clinspan.session import active, shared_dir, sql_literal
from clinspan.sources import csv_in


def _unstored(name: str, table: DataFrame) -> DataFrame:
    return table


def person_links(patients: DataFrame, tokens: TokenConfig, id_map: str | None = None,
                 keep: Callable[[str, DataFrame], DataFrame] = _unstored) -> DataFrame:
    """source_patient_id, patient_token, person_id: one join attaches both ids to a fact table.

    Facts only keep tokens of this map, so numbering its tokens numbers all of them. With ``id_map``, a folder, persons of
    earlier runs keep their ids and new ones get the next. ``keep`` stores the ids of the persons met here.
    """
    links = linkage.token_map(linkage.with_token(patients, tokens))
    if id_map is None:
        index = cdm.person_index(links)
    else:
        index = remembered_ids(links, "patient_token", id_map, "person_id", F.substring("patient_token", 4, 16))
        index = index.join(links.select("patient_token").distinct(), "patient_token", "left_semi")
    return links.join(keep("person_index", index), "patient_token")


def _seen(table: DataFrame) -> tuple[DataFrame, Observation]:
    """A table whose rows are counted while it is written.

    Counting is the last step, in the tasks that write: of those each counts once, however often it is tried, while the
    tasks of a stage before a shuffle may run, and count, again after an executor is lost.
    """
    seen = Observation()
    return table.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _keeper(folder: str, counts: dict[str, int]) -> Callable[[str, DataFrame], DataFrame]:
    """A function that stores a table below a folder and notes how many rows it has."""
    def keep(name: str, table: DataFrame) -> DataFrame:
        table, seen = _seen(table)
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        counts[name] = seen.get["rows"]
        return active().read.parquet(f"{folder}/{name}")

    return keep


#: A person with more rows than this in one table lies apart from the others.
MANY_ROWS = 1_000_000


def crowded_persons(*facts: DataFrame) -> DataFrame:
    """Persons with very many rows in one of the tables; only a few can have them."""
    counts = [t.groupBy("person_id").agg(F.count("*").alias("n")) for t in facts]
    return union_all(counts).where(F.col("n") > MANY_ROWS).select("person_id").distinct()


def _named(folder: str, name: str) -> str:
    """The name of a stored table in the session's catalog, which knows how its rows lie."""
    return f"cdm_{hashlib.sha256(folder.encode()).hexdigest()[:16]}_{name}"


def write_cdm(tables: cdm.Cdm, folder: str, crowded: DataFrame | None = None, buckets: int | None = None,
              counts: dict[str, int] | None = None) -> cdm.Cdm:
    """Write the five tables, with all their declared columns, as Parquet and return readers over them.

    Rows lie in ``buckets`` by person (as many as shuffle partitions), so that what groups or joins by person later reads
    its columns and shuffles nothing; losing an executor costs a re-read instead of a re-run of linkage and
    de-identification. A bucket is read by one task, so the rows of ``crowded`` persons lie apart, in no buckets.
    ``counts`` takes the number of rows written of each table.
    """
    counts = {} if counts is None else counts
    buckets = buckets or int(active().conf.get("spark.sql.shuffle.partitions"))
    apart = crowded is not None and not crowded.isEmpty()
    for name, table in tables.tables().items():
        table = rows = cdm.conform(table, name)
        counts[name] = 0
        if apart:
            rows = table.join(F.broadcast(crowded), "person_id", "left_anti")
            rest, seen = _seen(table.join(F.broadcast(crowded), "person_id", "left_semi"))
            rest.write.mode("overwrite").parquet(f"{folder}/crowded/{name}")
            counts[name] = seen.get["rows"]
        dealt, seen = _seen(rows.repartition(buckets, "person_id"))
        dealt.write.mode("overwrite").bucketBy(buckets, "person_id").sortBy("person_id").option(
            "path", f"{folder}/{name}").saveAsTable(_named(folder, name))
        counts[name] += seen.get["rows"]
    active().range(1).select(F.lit(buckets).alias("buckets"), F.lit(apart).alias("apart")).write.mode("overwrite").parquet(
        f"{folder}/layout")
    return read_cdm(folder)


def read_cdm(folder: str) -> cdm.Cdm:
    """The tables stored in a folder, also by another session."""
    spark = active()
    layout = spark.read.parquet(f"{folder}/layout").first()

    def table(name: str) -> DataFrame:
        if not spark.catalog.tableExists(_named(folder, name)):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{folder}/{name}").schema)
            spark.sql(f"CREATE TABLE {_named(folder, name)} ({columns}) USING parquet CLUSTERED BY (person_id) SORTED BY (person_id)"
                      f" INTO {layout.buckets} BUCKETS LOCATION {sql_literal(f'{folder}/{name}')}")
        return spark.table(_named(folder, name))

    even = cdm.Cdm(**{name: table(name) for name in cdm.TABLES}, by_person=True)
    if not layout.apart:
        return even
    rest = cdm.Cdm(**{name: spark.read.parquet(f"{folder}/crowded/{name}") for name in cdm.TABLES})
    return cdm.Cdm(**{n: t.unionByName(getattr(rest, n)) for n, t in even.tables().items()}, parts=(even, rest))


#: What an upload has no values of: column and type of an observation.
OBSERVATION = (
    "observation_id string, source_patient_id string, source_system string, observation_type string, observation_code string,"
    " observation_code_system string, observation_name string, observation_datetime timestamp_ntz, value_numeric double,"
    " value_text string, value_unit string, reference_range_low double, reference_range_high double, abnormal_flag string,"
    " dose string, route string, frequency string")


@dataclass(frozen=True)
class Processed:
    """Stored results: CDM tables, de-identified patients and encounters, and the rows of each table, counted as it was
    written."""

    tables: cdm.Cdm
    people: DataFrame
    encounters: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


def read_counts(folder: str) -> dict[str, int]:
    """The rows of the tables that :func:`process` stored in a folder, a dozen of them, also in another session."""
    return {row.table: row.rows for row in active().read.parquet(f"{folder}/counts").collect()}


def process(patients: DataFrame, encounters: DataFrame, observations: DataFrame | None,
            tokens: TokenConfig, settings: DeidConfig, folder: str | None = None, unique: tuple[str, ...] = (),
            id_map: str | None = None, counts: dict[str, int] | None = None) -> Processed:
    """Link, de-identify, map and store.

    Whatever several tables start from is written once below ``folder`` and read back. There may be no
    observations, and columns that a source lacks count as NULL. ``unique`` is explained at ``cdm.build``,
    ``id_map`` at :func:`person_links`. ``counts`` are
    rows of source tables, if known.
    """
    folder, counts = folder or shared_dir("cdm"), dict(counts or {})
    if observations is None:
        observations, counts = active().createDataFrame([], OBSERVATION), {**counts, "observations": 0}
    keep = _keeper(folder, counts)
    links = keep("person_links", person_links(patients, tokens, id_map, keep))
    people = keep("deid_patient", deid.deid_patient(patients, links, settings))
    visits = keep("deid_encounter", deid.deid_encounter(encounters, links, settings))
    facts = keep("deid_observation", deid.deid_observation(observations, links, settings))
    tables = cdm.build(people, visits, facts, keep, unique)
    stored = write_cdm(tables, folder, keep("crowded_persons", crowded_persons(visits, facts)), counts=counts)
    active().createDataFrame(list(counts.items()), "table string, rows long").coalesce(1).write.mode("overwrite").parquet(
        f"{folder}/counts")
    return Processed(stored, people, visits, counts)


def run(patients: DataFrame, encounters: DataFrame, observations: DataFrame | None,
        tokens: TokenConfig, settings: DeidConfig, folder: str | None = None,
        unique: tuple[str, ...] = ()) -> tuple[cdm.Cdm, DataFrame]:
    """The stored tables and the de-identified patients of :func:`process`."""
    done = process(patients, encounters, observations, tokens, settings, folder, unique)
    return done.tables, done.people


def upload(path: str, tokens: TokenConfig, settings: DeidConfig, folder: str | None = None) -> tuple[ingest.Ingested, Processed]:
    """Take in a CSV file or a folder of them, de-identify and map it. Rejected files and rows are in the
    issues; ``export.deid_csv_rows(done.people, done.encounters)`` is the file to hand out."""
    folder = folder or shared_dir("upload")
    got = ingest.ingest(csv_in.read_csv(path), settings.as_of)
    counts: dict[str, int] = {}
    keep = _keeper(folder, counts)
    patients, encounters = keep("patients", got.patients), keep("encounters", got.encounters)
    return got, process(patients, encounters, None, tokens, settings, f"{folder}/cdm", counts=counts)


# FIXED VALUES: step names
STEPS = [
    "Clinical Text Extraction & SNOMED Annotation", "Data Generation",
    "Patient Linkage (Tokenization)", "De-identification (PDPL + HiPS)",
    "OMOP CDM Transformation", "Cohort & Analytics Ready",
]


def step_report(patients: DataFrame, encounters: DataFrame, observations: DataFrame,
                tables: cdm.Cdm, people: DataFrame, tokens: TokenConfig,
                threshold: float = 0.5, counts: dict[str, int] | None = None) -> DataFrame:
    """The counts of the six steps, one row per step and figure.

    ``counts`` (of :class:`Processed`, or :func:`read_counts`) are rows counted while the tables were written; a table
    named there is not read again. Notes are searched here.
    """
    counts = counts or {}
    texts = encounters.where(F.coalesce("clinical_notes", F.lit("")) != "").select(
        F.col("encounter_id").alias("doc_id"), F.col("clinical_notes").alias("text"))
    rollup = notes.notes_rollup(notes.extract(texts, threshold))
    stored = tables.tables()

    def told(name: str, figure: str, table: DataFrame, rows: Column | None = None) -> DataFrame:
        if name in counts:
            return active().range(1).select(F.lit(counts[name]).alias(figure))
        return table.agg((F.count("*") if rows is None else rows).alias(figure))

    row = side_by_side(
        rollup, told("patients", "total_patient_records", patients),
        told("person_index", "unique_individuals", linkage.token_map(linkage.with_token(patients, tokens)),
             F.count_distinct("patient_token")),
        told("encounters", "total_encounters", encounters), told("observations", "total_observations", observations),
        told("deid_patient", "records_deidentified", people),
        *[told(name, figure, stored[name]) for name, figure in (
            ("person", "total_persons"), ("visit_occurrence", "total_visits"), ("condition_occurrence", "total_conditions"),
            ("measurement", "total_measurements"), ("drug_exposure", "total_drug_exposures"))])
    unique, records = F.col("unique_individuals"), F.col("total_patient_records")
    figures = [
        [("entities_linked", F.col("entities_linked")), ("clinical_notes_processed", F.col("notes")),
         ("candidate_spans", F.col("candidate_spans")), ("snomed_concepts", F.col("snomed_concepts"))],
        [("unique_patients", unique), ("source_records", records),
         ("encounters", F.col("total_encounters")), ("observations", F.col("total_observations"))],
        [("unique_patients", unique), ("source_records_linked", records),
         ("duplicate_records_linked", F.greatest(records - unique, F.lit(0)))],
        [("unique_patients", unique), ("records_deidentified", F.col("records_deidentified"))],
    ] + [[("unique_patients", F.col("total_persons")), ("visits", F.col("total_visits")),
          ("conditions", F.col("total_conditions")), ("measurements", F.col("total_measurements")),
          ("drugs" if last else "drug_exposures", F.col("total_drug_exposures"))]
         for last in (True, False)]
    lines = F.array(*[
        F.struct(F.lit(number).alias("step"), F.lit(name).alias("name"),
                 F.lit(figure).alias("figure"), value.cast("bigint").alias("value"))
        for number, (name, values) in enumerate(zip(STEPS, figures), start=1)
        for figure, value in values])
    return row.select(F.inline(lines)).withColumn(
        "method", F.when(F.col("step") == 4, fixed.DEID_METHOD))
