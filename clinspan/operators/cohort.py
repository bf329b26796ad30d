"""Cohort definitions and their evaluation over the CDM tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspan.config import DEFAULT_AS_OF
from clinspan.fixed import concepts as fixed
from clinspan.operators.cdm import Cdm
from clinspan.operators.ids import first_row
from clinspan.operators.tables import side_by_side, union_all
from clinspan.session import active, complete, exists

ALIASES = dict(fixed.COHORT_ALIASES)


@dataclass(frozen=True)
class Criterion:
    """``kind`` is diagnosis, medication, lab_value, age, gender or visit_type."""

    kind: str
    field: str
    operator: str
    value: Any
    value_high: Any = None


@dataclass(frozen=True)
class Cohort:
    name: str
    description: str
    include: list[Criterion] = field(default_factory=list)
    exclude: list[Criterion] = field(default_factory=list)


# FIXED VALUES: the named cohorts
NAMED_COHORTS = {
    "all_patients": Cohort("All Patients", "All patients in the dataset"),
    "diabetic_patients": Cohort(
        "Diabetic Patients", "Patients with Type 2 Diabetes diagnosis",
        [Criterion("diagnosis", "condition", "exists", "diabetes")]),
    "ckd_on_dialysis": Cohort(
        "CKD Patients on Dialysis", "Patients with CKD/ESRD potentially on dialysis",
        [Criterion("diagnosis", "condition", "in", ["ckd", "esrd"])]),
    "transplant_patients": Cohort(
        "Transplant Recipients", "Patients on immunosuppression (likely transplant)",
        [Criterion("medication", "drug", "exists", "tacrolimus")]),
    "oncology_patients": Cohort(
        "Oncology Patients", "Patients with cancer diagnoses",
        [Criterion("diagnosis", "condition", "in", ["leukemia", "breast_cancer", "lymphoma"])]),
    "elderly_cardiac": Cohort(
        "Elderly Cardiac Patients", "Patients 65+ with heart failure",
        [Criterion("age", "age", "greater_than", 64),
         Criterion("diagnosis", "condition", "exists", "heart_failure")]),
}


def concept(value: Any) -> Any:
    """A short name as its concept id; anything else unchanged."""
    return ALIASES.get(value, value) if isinstance(value, str) else value


def _compare(column, c: Criterion):
    if c.operator == "equals":
        return column == c.value
    if c.operator == "greater_than":
        return column > c.value
    if c.operator == "less_than":
        return column < c.value
    if c.operator == "between":
        return column.between(c.value, c.value_high)
    raise ValueError(f"operator {c.operator!r} is not supported for {c.kind}")


def _flag(column: str, c: Criterion, several: bool = False) -> Column:
    if c.operator in ("exists", "equals"):
        return F.col(column) == concept(c.value)
    if c.operator == "in" and several:
        return F.col(column).isin([concept(v) for v in c.value])
    raise ValueError(f"operator {c.operator!r} is not supported for {c.kind}")


def _having(rows: DataFrame, column: str, c: Criterion, several: bool = False) -> DataFrame:
    return rows.where(_flag(column, c, several)).select("person_id").distinct()


def latest_measurement(measurements: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row per key; equal times go to the lower measurement id."""
    return first_row(measurements, keys, [F.col("measurement_datetime").desc(), F.col("measurement_id")])


def matching_persons(cdm: Cdm, c: Criterion, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Distinct person ids meeting one criterion."""
    if c.kind == "age":
        age = F.lit(as_of.year) - F.col("year_of_birth")
        return cdm.person.where(_compare(age, c)).select("person_id")
    if c.kind == "gender":
        if c.operator != "equals":
            raise ValueError(f"operator {c.operator!r} is not supported for gender")
        return cdm.person.where(F.col("gender_concept_id") == concept(c.value)).select("person_id")
    if c.kind == "diagnosis":
        return _having(cdm.condition_occurrence, "condition_concept_id", c, several=True)
    if c.kind == "medication":
        return _having(cdm.drug_exposure, "drug_concept_id", c)
    if c.kind == "visit_type":
        return _having(cdm.visit_occurrence, "visit_concept_id", c)
    if c.kind == "lab_value":
        labs = cdm.measurement.where(F.col("measurement_concept_id") == concept(c.field)).select(
            "person_id", "measurement_datetime", "measurement_id", "value_as_number")
        return latest_measurement(labs, ["person_id"]).where(
            _compare(F.col("value_as_number"), c)).select("person_id")
    raise ValueError(f"unknown criterion kind {c.kind!r}")


def included(cdm: Cdm, cohort: Cohort, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Persons meeting every inclusion criterion; without criteria, everyone."""
    def of(part: Cdm) -> DataFrame:
        people = part.person.select("person_id")
        for c in cohort.include:
            people = people.join(matching_persons(part, c, as_of), "person_id", "left_semi")
        return people

    return cdm.each(of)


def excluded(cdm: Cdm, cohort: Cohort, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Included persons meeting any exclusion criterion."""
    if not cohort.exclude:
        return cdm.person.select("person_id").limit(0)
    return cdm.each(lambda part: included(part, cohort, as_of).join(
        union_all([matching_persons(part, c, as_of) for c in cohort.exclude]), "person_id", "left_semi"))


def members(cdm: Cdm, cohort: Cohort, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Included persons without those excluded."""
    if not cohort.exclude:
        return included(cdm, cohort, as_of)
    return cdm.each(lambda part: included(part, cohort, as_of).join(
        union_all([matching_persons(part, c, as_of) for c in cohort.exclude]), "person_id", "left_anti"))


def named_cohort(name: str) -> Cohort:
    if name not in NAMED_COHORTS:
        raise ValueError(f"unknown query {name!r}; available: {', '.join(NAMED_COHORTS)}")
    return NAMED_COHORTS[name]


def _rows_of(people: DataFrame, rows: DataFrame, total: str) -> DataFrame:
    """Number of rows belonging to the given persons, counted per person before the join."""
    counts = rows.groupBy("person_id").agg(F.count("*").alias("_n"))
    return people.join(counts, "person_id").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(total))


def statistics(cdm: Cdm, people: DataFrame, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """One row of demographic and clinical figures; an empty cohort gets an error text."""
    age = F.lit(as_of.year) - F.col("year_of_birth")
    ages = cdm.person.join(people, "person_id", "left_semi").agg(
        F.count("*").alias("total_count"),
        F.count_if(F.col("gender_concept_id") == 8507).alias("male_count"),
        F.count_if(F.col("gender_concept_id") == 8532).alias("female_count"),
        F.sum(age).alias("_ages"), F.min(age).alias("age_min"), F.max(age).alias("age_max"))
    row = side_by_side(ages, _rows_of(people, cdm.visit_occurrence, "total_visits"),
                       _rows_of(people, cdm.condition_occurrence, "total_conditions"))
    size = F.nullif(F.col("total_count"), F.lit(0))
    return row.select(
        "total_count", "male_count", "female_count",
        F.round(F.col("male_count") / size * 100, 1).alias("male_percentage"),
        F.round(F.col("_ages") / size, 1).alias("age_mean"), "age_min", "age_max",
        "total_visits", F.round(F.col("total_visits") / size, 1).alias("visits_per_person"),
        "total_conditions",
        F.round(F.col("total_conditions") / size, 1).alias("conditions_per_person"),
        F.when(F.col("total_count") == 0, "Empty cohort").alias("error"))


def build(cdm: Cdm, cohort: Cohort, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """One row: name, description, member count, statistics and the criteria."""
    people = members(cdm, cohort, as_of)

    def echo(criteria: list[Criterion]) -> str:
        return "; ".join(
            f"{c.kind}.{c.field} {c.operator} "
            + (",".join(map(str, c.value)) if isinstance(c.value, list) else str(c.value))
            for c in criteria)

    return statistics(cdm, people, as_of).select(
        F.lit(cohort.name).alias("cohort_name"), F.lit(cohort.description).alias("description"),
        F.col("total_count").alias("member_count"), "*",
        F.lit(echo(cohort.include)).alias("inclusion"),
        F.lit(echo(cohort.exclude)).alias("exclusion"))


_WORD = 60  # criteria per number of bits


def criterion_bits(cdm: Cdm, criteria: list[Criterion], as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """For every person, which criteria the person meets, as bits of ``bits_0``, ``bits_1``, ...: criterion ``i`` is bit
    ``i % 60`` of ``bits_{i // 60}``.

    Each table is read once for all criteria, and OR-ed per person before anything is shuffled.
    """
    by_kind: dict[str, list[tuple[int, Criterion]]] = {}
    for i, c in enumerate(criteria):
        by_kind.setdefault(c.kind, []).append((i, c))
    words = range(len(criteria) // _WORD + 1)

    def bits(rows: DataFrame, flags: dict[int, Column]) -> DataFrame:
        def word(w: int) -> Column:
            made = F.lit(0).cast("long")
            for i, met in flags.items():
                if i // _WORD == w:
                    made = made.bitwiseOR(F.when(met, F.lit(1 << i % _WORD)).otherwise(F.lit(0)).cast("long"))
            return made.alias(f"bits_{w}")
        return rows.select("person_id", *[word(w) for w in words])

    def of(part: Cdm) -> DataFrame:
        found = []
        people = {}
        for i, c in by_kind.get("age", []):
            people[i] = _compare(F.lit(as_of.year) - F.col("year_of_birth"), c)
        for i, c in by_kind.get("gender", []):
            if c.operator != "equals":
                raise ValueError(f"operator {c.operator!r} is not supported for gender")
            people[i] = F.col("gender_concept_id") == concept(c.value)
        found.append(bits(part.person, people))
        for kind, table, column in (("diagnosis", part.condition_occurrence, "condition_concept_id"),
                                    ("medication", part.drug_exposure, "drug_concept_id"),
                                    ("visit_type", part.visit_occurrence, "visit_concept_id")):
            if kind in by_kind:
                found.append(bits(table, {i: _flag(column, c, kind == "diagnosis") for i, c in by_kind[kind]}))
        if "lab_value" in by_kind:
            wanted = {concept(c.field) for _, c in by_kind["lab_value"]}
            labs = part.measurement.where(F.col("measurement_concept_id").isin(list(wanted))).select(
                "person_id", "measurement_concept_id", "measurement_datetime", "measurement_id", "value_as_number")
            found.append(bits(latest_measurement(labs, ["person_id", "measurement_concept_id"]), {
                i: (F.col("measurement_concept_id") == concept(c.field)) & _compare(F.col("value_as_number"), c)
                for i, c in by_kind["lab_value"]}))
        met = union_all(found).groupBy("person_id").agg(*[F.bit_or(f"bits_{w}").alias(f"bits_{w}") for w in words])
        return part.person.select("person_id").join(met, "person_id")

    unknown = by_kind.keys() - {"age", "gender", "diagnosis", "medication", "visit_type", "lab_value"}
    if unknown:
        raise ValueError(f"unknown criterion kind {sorted(unknown)[0]!r}")
    return cdm.each(of)


def memberships(cdm: Cdm, cohorts: list[Cohort], as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """For every person, ``included`` and ``excluded``: arrays of whether each cohort's criteria include the person, and
    whether they then exclude the person. All cohorts are masks over one vector of criteria."""
    criteria: list[Criterion] = []
    for c in (c for cohort in cohorts for c in (*cohort.include, *cohort.exclude)):
        if c not in criteria:
            criteria.append(c)

    def met(wanted: list[Criterion], every: bool) -> Column:
        places = {criteria.index(c) for c in wanted}
        held = F.lit(every)
        for w in {i // _WORD for i in places}:
            mask = sum(1 << i % _WORD for i in places if i // _WORD == w)
            here = F.col(f"bits_{w}").bitwiseAND(F.lit(mask).cast("long"))
            held = (held & (here == mask)) if every else (held | (here != 0))
        return held

    inside = [met(cohort.include, True) for cohort in cohorts]
    return criterion_bits(cdm, criteria, as_of).select(
        "person_id", F.array(*inside).alias("included"),
        F.array(*[i & met(cohort.exclude, False) for i, cohort in zip(inside, cohorts)]).alias("excluded"))


def run_log(cdm: Cdm, cohorts: list[Cohort], as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """One row per cohort run: persons in total, included, excluded and in the final cohort. All runs are one pass."""
    people = memberships(cdm, cohorts, as_of)
    places = range(len(cohorts))
    counts = people.agg(F.count("*").alias("total_persons"), *[
        F.count_if(F.col(kind)[i]).alias(f"{kind}_{i}") for i in places for kind in ("included", "excluded")])
    lines = F.array(*[F.struct(
        F.lit(i + 1).alias("run"), F.lit(cohort.name).alias("cohort_name"), F.col("total_persons"),
        F.col(f"included_{i}").alias("included"), F.col(f"excluded_{i}").alias("excluded"),
        (F.col(f"included_{i}") - F.col(f"excluded_{i}")).alias("final_cohort")) for i, cohort in enumerate(cohorts)])
    return counts.select(F.inline(lines))


def read_log(path: str) -> DataFrame | None:
    """All committed rows of a log, with the ``run_id`` and ``batch`` of the run that added them."""
    spark = active()
    if not exists(path):
        return None
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    folders = [f"{path}/{n}" for n in sorted(f.getPath().getName() for f in found) if n.startswith("run_id=") and complete(f"{path}/{n}")]
    return spark.read.option("basePath", path).schema(spark.read.parquet(folders[0]).schema.add("run_id", "string")).parquet(
        *folders) if folders else None


def append_log(entries: DataFrame, path: str, run_id: str) -> bool:
    """Add run-log rows (of cohorts or of patient analyses) to the log at ``path``, once per ``run_id``.

    A run's rows are one folder, which counts when its write is committed: a run that failed is written anew, a repeated
    one changes nothing (and gives False). ``batch`` numbers the runs in the order in which they were added.
    """
    folder = f"{path}/run_id={run_id}"
    if complete(folder):
        return False
    log = read_log(path)
    last = 0 if log is None else log.agg(F.max("batch")).first()[0] or 0
    entries.withColumn("batch", F.lit(last + 1)).write.mode("overwrite").parquet(folder)
    return True


def recent_runs(log: DataFrame, last: int = 10) -> DataFrame:
    """The most recent entries of a log, as reports show them."""
    return log.orderBy(F.col("batch").desc(), F.col("run").desc()).limit(last)
