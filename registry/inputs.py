"""Lazy access to the given tables, the clinical fixtures and the pipeline stages built on them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspan.config import DEFAULT_AS_OF
from clinspan.operators import cdm, deid, ingest, linkage, notes
from clinspan.plans import pipeline
from clinspan.session import shared_dir
from clinspan.sources import csv_in
from registry import fixture_sql as fx
from registry.settings import DEID, TOKENS

FOLDERS = 64  # of files, at least, where there are rows enough
SPREAD_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey", "documents": "doc_id"}


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.as_of = DEFAULT_AS_OF
        self.tokens_config = TOKENS
        self.deid_config = DEID

    def table(self, name: str) -> DataFrame:
        """A given table. Those of much work per row are dealt out by their key where their files make fewer splits
        than there are cores; otherwise the scan's own splits carry the work, without a shuffle."""
        table, cores = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"), self.spark.sparkContext.defaultParallelism
        few = name in SPREAD_KEYS and table.rdd.getNumPartitions() < cores
        return table.repartition(cores, SPREAD_KEYS[name]) if few else table

    def _derive(self, sql: str, *names: str) -> DataFrame:
        return self.spark.sql(sql, **{n: self.table(n) for n in names})

    @cached_property
    def patient(self) -> DataFrame:
        return self._derive(fx.PATIENT, "customer")

    @cached_property
    def encounter(self) -> DataFrame:
        return self._derive(fx.ENCOUNTER, "orders")

    @cached_property
    def observation(self) -> DataFrame:
        return self._derive(fx.OBSERVATION, "lineitem", "orders")

    @cached_property
    def note(self) -> DataFrame:
        return self._derive(fx.NOTE, "documents")

    @cached_property
    def csv_rows(self) -> DataFrame:
        return self._derive(fx.CSV, "orders")

    def write_csv(self, folder: str, rows: DataFrame, names: dict[str, str], encoding: str = "UTF-8",
                  file_of: str | None = None) -> str:
        """Add CSV files of some rows, with ``names`` (column -> header) in that order, to a folder; one for each value of
        ``file_of``, in the order of its keys, where that is given."""
        columns = [F.col(c).alias(h) for c, h in names.items()]
        if file_of:
            rows = rows.withColumn("file", F.expr(file_of)).repartition(
                self.spark.sparkContext.defaultParallelism, "file").sortWithinPartitions("file", "row_key")
            columns.append("file")
        out = rows.select(*columns).write.mode("append").options(
            header=True, escape='"', encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        (out.partitionBy("file") if file_of else out).csv(folder)
        return folder

    @cached_property
    def upload(self) -> str:
        """The CSV rows as files of two makes: informal headers, and other aliases in the reverse order."""
        folder, half = shared_dir("upload"), F.col("row_key") % 3 == 0
        other = dict(reversed([(c, fx.OTHER_HEADERS.get(c, h)) for c, h in fx.CSV_HEADERS.items()]))
        self.write_csv(folder, self.csv_rows.where(~half), fx.CSV_HEADERS)
        return self.write_csv(folder, self.csv_rows.where(half), other)

    @cached_property
    def mixed_upload(self) -> str:
        """Good files beside some without required columns and some that are not UTF-8, each of a range of keys."""
        folder, rows, kind = shared_dir("upload"), self.csv_rows, F.col("row_key") % 4
        few = {c: h for c, h in fx.CSV_HEADERS.items() if c not in ("date_of_birth", "gender")}
        latin = rows.where(kind == 3).withColumn("first_name", F.lit("Zo\u00eb"))
        self.write_csv(folder, rows.where(kind < 2), fx.CSV_HEADERS, file_of=f"'good-' || {fx.CSV_FILE}")
        self.write_csv(folder, rows.where(kind == 2), few, file_of=f"'few-' || {fx.CSV_FILE}")
        return self.write_csv(folder, latin, fx.CSV_HEADERS, "ISO-8859-1", file_of=f"'latin-' || {fx.CSV_FILE}")

    @cached_property
    def ordered_upload(self) -> str:
        """The CSV rows in order of their key, a file for each range of keys, so that row numbers are known."""
        return self.write_csv(shared_dir("upload"), self.csv_rows, fx.CSV_HEADERS, file_of=fx.CSV_FILE)

    @cached_property
    def stray_upload(self) -> str:
        """Lines as people type them: quotes inside values, doubled ones, text after a closing quote, line breaks."""
        folder = shared_dir("upload")
        lines = self._derive(fx.STRAY_LINES, "orders").withColumn("file", F.expr(fx.CSV_FILE)).repartition(
            self.spark.sparkContext.defaultParallelism, "file")
        lines.sortWithinPartitions("file", "row_key").select("value", "file").write.partitionBy("file").text(folder)
        return folder

    @cached_property
    def ordered(self) -> ingest.Ingested:
        return ingest.ingest(csv_in.read_csv(self.ordered_upload), self.as_of)

    @cached_property
    def csv(self) -> csv_in.RawCsv:
        return csv_in.read_csv(self.upload)

    @cached_property
    def ingested(self) -> ingest.Ingested:
        return ingest.ingest(self.csv, self.as_of)

    @cached_property
    def extracted(self) -> DataFrame:
        return notes.extract(self.note.select("doc_id", "text"))

    @cached_property
    def tokened(self) -> DataFrame:
        return linkage.with_token(self.patient, self.tokens_config)

    @cached_property
    def links(self) -> DataFrame:
        return pipeline.person_links(self.patient, self.tokens_config)

    @cached_property
    def deid_patient(self) -> DataFrame:
        return deid.deid_patient(self.patient, self.links, self.deid_config)

    @cached_property
    def deid_encounter(self) -> DataFrame:
        return deid.deid_encounter(self.encounter, self.links, self.deid_config)

    @cached_property
    def deid_observation(self) -> DataFrame:
        return deid.deid_observation(self.observation, self.links, self.deid_config)

    @cached_property
    def mapped(self) -> cdm.Cdm:
        """The CDM tables computed from the given tables, not stored."""
        return cdm.build(self.deid_patient, self.deid_encounter, self.deid_observation, unique=("encounter_id",))

    @cached_property
    def _stored(self) -> pipeline.Processed:
        return pipeline.process(self.patient, self.encounter, self.observation, self.tokens_config,
                                self.deid_config, unique=("encounter_id",))

    @property
    def cdm(self) -> cdm.Cdm:
        """The CDM tables as the pipeline stored them in the shared folder."""
        return self._stored.tables

    @property
    def people(self) -> DataFrame:
        """The stored de-identified patient records."""
        return self._stored.people

    @property
    def counts(self) -> dict[str, int]:
        """The rows of the stored tables, counted as they were written."""
        return self._stored.counts


def write_texts(rows: DataFrame, folder: str) -> list[str]:
    """One file per row (part, text) below a folder, and the folders that hold them.

    Where the folder is local to all tasks they open the files themselves: Hadoop starts a ``chmod`` process for each file it
    creates there without its native library. A task attempt has folders of its own, and names them when it is through, so
    what a failed one left is in none of those returned.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        rows.write.partitionBy("part").options(**{
            "lineSep": "\x00", "maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}).text(folder)
        return [f"{folder}/part=*"]
    local, several = path.toUri().getPath(), -(-FOLDERS // spark.sparkContext.defaultParallelism)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, number = uuid.uuid4().hex, 0
        for batch in batches:
            for text in batch["text"].to_pylist():
                to = f"{local}/part={attempt}-{number % several}"
                if number < several:
                    os.makedirs(to)
                with open(f"{to}/part-{number:09d}.txt", "xb", buffering=0) as file:
                    file.write((text or b"") + b"\x00")
                number += 1
        made = [f"part={attempt}-{k}" for k in range(min(number, several))]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["folder"])

    made = rows.select(F.col("text").cast("binary")).mapInArrow(write, "folder string").collect()
    return [f"{folder}/{row.folder}" for row in made]


def portable(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, so both engines return the same values."""
    kinds = ("date", "timestamp_ntz", "timestamp")
    return df.select(*[
        F.col(f"`{f.name}`").cast("string").alias(f.name)
        if f.dataType.simpleString() in kinds else F.col(f"`{f.name}`")
        for f in df.schema.fields])


_CACHE: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """One set of inputs per application and data folder, so the stored CDM is written once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = Inputs(spark, sf_dir)
    return _CACHE[key]
