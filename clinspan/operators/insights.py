"""Rule-based findings per person, risk scores and population quality measures.

A finding is one row: person_id, type, severity, title, description, evidence, recommendations,
relevant_concepts. Persons are never gathered into one task; all rules are joins and aggregates.

The ``match`` argument chooses how labs and drugs are recognised: ``"source_value"`` looks for the
rule's name inside the source code text, ``"concept"`` compares concept ids.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspan.config import DEFAULT_AS_OF
from clinspan.fixed import concepts, rules
from clinspan.functions.normalize import gender_label, percent, percent_text
from clinspan.operators.cdm import Cdm
from clinspan.operators.cohort import latest_measurement
from clinspan.operators.ids import first_row
from clinspan.operators.tables import side_by_side, union_all
from clinspan.session import constant_table

LAB_CONCEPT = {name.lower(): cid for _, cid, name in concepts.LOINC_CONCEPTS} | dict(concepts.COHORT_ALIASES)
DRUG_CONCEPT = {name.lower(): cid for _, cid, name in concepts.RXNORM_CONCEPTS}


def finding(rows: DataFrame, kind: str, severity, title, description, evidence: Column,
            recommendations: Column, relevant: Column | None = None) -> DataFrame:
    def text(value):
        return F.lit(value) if isinstance(value, str) else value

    return rows.select(
        "person_id", F.lit(kind).alias("type"), text(severity).alias("severity"),
        text(title).alias("title"), text(description).alias("description"),
        evidence.alias("evidence"), recommendations.alias("recommendations"),
        (F.array().cast("array<bigint>") if relevant is None else relevant).alias("relevant_concepts"))


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _is_lab(lab: str, match: str) -> Column:
    if match == "concept":
        return F.col("measurement_concept_id") == LAB_CONCEPT[lab]
    return F.contains(F.lower("measurement_source_value"), F.lit(lab))


# --- labs ------------------------------------------------------------------------------------

def _critical_actions(lab: str, direction: str) -> list[str]:
    for name, way, actions in rules.CRITICAL_ACTIONS:
        if (name, way) == (lab, direction):
            return actions + [rules.CRITICAL_CONFIRM]
    return [f"Urgent clinical review of the critically {direction} {lab}",
            f"Evaluate the likely cause of the abnormal {lab}", rules.CRITICAL_CONFIRM]


def critical_labs(measurements: DataFrame, match: str = "source_value") -> DataFrame:
    """Values beyond a critical limit, one row per value and limit crossed."""
    limits = []
    for lab, low, high, unit in rules.CRITICAL_LABS:
        for direction, limit_text in (("low", low), ("high", high)):
            if limit_text is not None:
                limits.append(F.struct(
                    F.lit(lab).alias("lab"), F.lit(direction).alias("direction"),
                    F.lit(float(limit_text)).alias("limit"), F.lit(limit_text).alias("limit_text"),
                    F.lit(unit).alias("unit"),
                    F.lit(LAB_CONCEPT[lab]).cast("bigint").alias("concept"),
                    _texts(_critical_actions(lab, direction)).alias("actions")))

    def crossed(rule: Column) -> Column:
        value = F.col("value_as_number")
        same = (F.col("measurement_concept_id") == rule["concept"] if match == "concept"
                else F.contains(F.lower("measurement_source_value"), rule["lab"]))
        return same & F.when(rule["direction"] == "low", value < rule["limit"]).otherwise(
            value > rule["limit"])

    return measurements.where(F.col("value_as_number").isNotNull()).select(
        "person_id", "measurement_id", "measurement_concept_id", "value_as_number",
        F.inline(F.filter(F.array(*limits), crossed)))


def critical_lab_findings(measurements: DataFrame, match: str = "source_value") -> DataFrame:
    name = F.initcap("lab")
    value = F.concat(F.col("value_as_number").cast("string"), F.lit(" "), F.col("unit"))
    return finding(
        critical_labs(measurements, match), "alert", "high",
        F.concat(F.lit("Critical "), F.initcap("direction"), F.lit(" "), name),
        F.concat(name, F.lit(" value of "), value, F.lit(" is critically "), F.col("direction"),
                 F.lit(" (threshold: "), F.col("limit_text"), F.lit(")")),
        F.array(F.concat(F.lit("Lab result: "), value)), F.col("actions"),
        F.array("measurement_concept_id"))


_SERIES = ["person_id", "measurement_source_value"]
_IN_TIME = ["measurement_datetime", "measurement_id"]


def _runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of values in order of time: how many, the ends, the first unit, and whether they only rise or fall.

    NULL values and units are skipped: min_by and max_by leave out rows whose order is NULL.
    """
    earlier = Window.partitionBy(*keys).orderBy(*_IN_TIME).rowsBetween(Window.unboundedPreceding, -1)
    step = rows.withColumn("_prev", F.last("value", ignorenulls=True).over(earlier))
    valued = F.when(F.col("value").isNotNull(), F.struct(*_IN_TIME))
    return step.groupBy(*keys).agg(
        F.count("value").alias("n"), F.min_by("value", valued).alias("first"), F.max_by("value", valued).alias("last"),
        F.min_by("unit", F.when(F.col("unit").isNotNull(), F.struct(*_IN_TIME))).alias("unit"),
        F.coalesce(F.bool_and(F.col("value") > F.col("_prev")), F.lit(True)).alias("up"),
        F.coalesce(F.bool_and(F.col("value") < F.col("_prev")), F.lit(True)).alias("down"))


def _chained(rows: DataFrame) -> DataFrame:
    """The same for series of any length: rows are range-partitioned by (person, lab, time, id), so even one enormous
    series is cut into consecutive pieces of different tasks, and the pieces of a series (at most one per partition)
    are chained."""
    cut = rows.repartitionByRange(*_SERIES, *_IN_TIME).withColumn("_piece", F.spark_partition_id())
    along = Window.partitionBy(*_SERIES).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    chained = _runs(cut, [*_SERIES, "_piece"]).withColumn("_last", F.last("last", ignorenulls=True).over(along))

    def place(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.col("_piece"))

    return chained.groupBy(*_SERIES).agg(
        F.sum("n").alias("n"), F.min_by("first", place("first")).alias("first"), F.max_by("last", place("last")).alias("last"),
        F.min_by("unit", place("unit")).alias("unit"),
        F.bool_and(F.col("up") & F.coalesce(F.col("first") > F.col("_last"), F.lit(True))).alias("up"),
        F.bool_and(F.col("down") & F.coalesce(F.col("first") < F.col("_last"), F.lit(True))).alias("down"))


def lab_trend(measurements: DataFrame, minimum: int = rules.MIN_TREND_LENGTH, by_person: bool = False) -> DataFrame:
    """Per person and lab: series of non-NULL values that only rise or only fall over time.

    ``by_person``: the rows lie by person, none of whom has very many, so series are read where they lie.
    """
    rows = measurements.select(*_SERIES, *_IN_TIME, F.col("value_as_number").alias("value"),
                               F.nullif("unit_source_value", F.lit("")).alias("unit"))
    series = _runs(rows, _SERIES) if by_person else _chained(rows)
    return series.where((F.col("n") >= minimum) & (F.col("up") | F.col("down"))).select(
        *_SERIES, "n", F.col("first").alias("first_value"), F.col("last").alias("last_value"),
        F.when(F.col("up"), "rising").otherwise("declining").alias("direction"),
        F.coalesce("unit", F.lit("")).alias("unit"))


def lab_trends(cdm: Cdm) -> DataFrame:
    """The trends of stored tables."""
    return cdm.each(lambda part: lab_trend(part.measurement, by_person=part.by_person))


def trend_values(measurements: DataFrame, trends: DataFrame) -> DataFrame:
    """The member values of found series, one row per value."""
    keys = ["person_id", "measurement_source_value"]
    return measurements.where(F.col("value_as_number").isNotNull()).select(
        *keys, "measurement_datetime", "measurement_id",
        F.round("value_as_number", 2).alias("value")).join(trends.select(*keys, "n"), keys)


def lab_display(rows: DataFrame, code: str = "measurement_source_value") -> DataFrame:
    """Add ``lab_name`` and ``display``: ``Name (code)`` for known LOINC codes, else the code."""
    names = constant_table(f"{code} string, _name string", rules.LAB_NAMES)
    return rows.join(names, code, "left").select(
        *rows.columns, F.coalesce("_name", F.col(code)).alias("lab_name"),
        F.when(F.col("_name").isNotNull(), F.concat("_name", F.lit(" ("), F.col(code), F.lit(")")))
         .otherwise(F.col(code)).alias("display"))


def trend_actions(trends: DataFrame) -> DataFrame:
    """Add ``actions``: the specific ones of (lab, direction), else two sentences naming the lab."""
    table = constant_table("_lab string, direction string, _actions array<string>", rules.TREND_ACTIONS)
    verb = F.when(F.col("direction") == "rising", "increase").otherwise("decrease")
    general = F.array(
        F.concat(F.lit("Correlate the "), verb, F.lit(" in "), F.col("lab_name"),
                 F.lit(" with the patient's clinical course")),
        F.concat(F.lit("Repeat "), F.col("lab_name"), F.lit(" to confirm the trend before acting")))
    keyed = trends.withColumn("_lab", F.lower("lab_name"))
    return keyed.join(table, ["_lab", "direction"], "left").withColumn(
        "actions", F.coalesce("_actions", general)).drop("_lab", "_actions")


def trend_findings(measurements: DataFrame, by_person: bool = False) -> DataFrame:
    """Trend findings. Evidence names the number, first and last value and unit of a series, whatever its
    length; the values are the rows of :func:`trend_values`."""
    rows = trend_actions(lab_display(lab_trend(measurements, by_person=by_person)))
    ends = [F.round(c, 2).cast("string") for c in ("first_value", "last_value")]
    rising = F.col("direction") == "rising"
    return finding(
        rows, "observation", "medium",
        F.concat(F.when(rising, "Rising Trend: ").otherwise("Declining Trend: "), F.col("display")),
        F.trim(F.concat(
            F.lit("Monotonic "), F.when(rising, "upward").otherwise("downward"), F.lit(" trend in "),
            F.col("display"), F.lit(" across "), F.col("n").cast("string"),
            F.lit(" serial measurements ("), ends[0], F.lit(" → "), ends[1], F.lit(" "),
            F.col("unit"), F.lit(")"))),
        F.array(F.trim(F.concat(F.lit("Serial values ("), F.col("n").cast("string"),
                                F.lit(" measurements): ["), ends[0], F.lit(", ..., "), ends[1], F.lit("] "), F.col("unit")))),
        F.col("actions"))


# --- drugs -----------------------------------------------------------------------------------

def person_drugs(drugs: DataFrame) -> DataFrame:
    """Distinct drugs per person under the names the rules use."""
    names = constant_table("_code string, _name string", rules.RULE_DRUG_NAMES)
    code = drugs.select("person_id", F.lower(F.coalesce("drug_source_value", F.lit(""))).alias("_code"))
    return code.distinct().join(names, "_code", "left").select(
        "person_id", F.coalesce("_name", "_code").alias("drug")).distinct()


def drug_interactions(drugs: DataFrame) -> DataFrame:
    """Pairs of interacting drugs a person takes.

    Only drugs named in a rule can pair up, so all others leave first, and a person has a handful of them at most.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("drug1"), F.lit(b).alias("drug2"), F.lit(text).alias("warning"))
                      for a, b, text in rules.DRUG_PAIRS])
    named = sorted({d for a, b, _ in rules.DRUG_PAIRS for d in (a, b)})
    taken = person_drugs(drugs).where(F.col("drug").isin(named)).groupBy("person_id").agg(F.collect_set("drug").alias("taken"))
    return taken.select("person_id", F.inline(F.filter(
        pairs, lambda p: F.array_contains("taken", p["drug1"]) & F.array_contains("taken", p["drug2"]))))


def interaction_findings(drugs: DataFrame) -> DataFrame:
    return finding(
        drug_interactions(drugs), "alert", "medium", "Potential Drug Interaction", F.col("warning"),
        F.array(F.concat(F.lit("Concurrent medications: "), F.col("drug1"), F.lit(", "), F.col("drug2"))),
        _texts(rules.DRUG_PAIR_ACTIONS))


def metformin_creatinine(drugs: DataFrame, measurements: DataFrame, match: str = "source_value") -> DataFrame:
    """People on metformin with a creatinine above 4.0: their first such value."""
    on_metformin = person_drugs(drugs).where(F.col("drug") == "metformin").select("person_id")
    high = measurements.where(_is_lab("creatinine", match) & (F.col("value_as_number") > 4.0)).select(
        "person_id", "measurement_id", "value_as_number")
    return first_row(high, ["person_id"], [F.col("measurement_id")]).join(
        on_metformin, "person_id", "left_semi")


def metformin_findings(drugs: DataFrame, measurements: DataFrame, match: str = "source_value") -> DataFrame:
    return finding(
        metformin_creatinine(drugs, measurements, match), "alert", "high",
        "Metformin Contraindication", rules.METFORMIN_TEXT,
        F.array(F.concat(F.lit("Creatinine: "), F.col("value_as_number").cast("string"), F.lit(" mg/dL")),
                F.lit("Metformin prescribed")),
        _texts(rules.METFORMIN_ACTIONS))


# --- care quality and visits -----------------------------------------------------------------

def diabetes_control(conditions: DataFrame, measurements: DataFrame) -> DataFrame:
    """Latest HbA1c of each diabetic person; a latest value that is NULL gives no row."""
    diabetic = conditions.where(
        (F.col("condition_concept_id") == 44054006)
        | F.contains(F.lower("condition_source_value"), F.lit("diabetes"))).select("person_id").distinct()
    hba1c = measurements.where(
        F.contains(F.lower("measurement_source_value"), F.lit("hba1c"))
        | F.contains("measurement_source_value", F.lit("4548-4"))).select(
        "person_id", "measurement_datetime", "measurement_id", "value_as_number")
    return (latest_measurement(hba1c, ["person_id"]).where(F.col("value_as_number").isNotNull())
            .join(diabetic, "person_id", "left_semi")
            .withColumn("controlled", F.col("value_as_number") <= 7.0))


def diabetes_findings(conditions: DataFrame, measurements: DataFrame) -> DataFrame:
    value = F.col("value_as_number").cast("string")
    ok = F.col("controlled")
    latest = F.concat(F.lit("Latest HbA1c: "), value, F.lit("%"))
    return finding(
        diabetes_control(conditions, measurements), "quality_metric",
        F.when(ok, "info").otherwise("medium"),
        F.when(ok, "Diabetes Well Controlled").otherwise("Diabetes Control Gap"),
        F.when(ok, F.concat(F.lit("HbA1c of "), value, F.lit("% is at goal (<7%)")))
         .otherwise(F.concat(F.lit("HbA1c of "), value,
                             F.lit("% exceeds target of <7% for diabetic patients"))),
        F.when(ok, F.array(latest)).otherwise(F.array(latest, F.lit("Diagnosis: Diabetes mellitus"))),
        F.when(ok, _texts(rules.DIABETES_GOAL_ACTIONS)).otherwise(_texts(rules.DIABETES_GAP_ACTIONS)),
        F.array(F.lit(44054006).cast("bigint")))


def visit_counts(visits: DataFrame) -> DataFrame:
    return visits.groupBy("person_id").agg(
        F.count("*").alias("visits"),
        F.count_if(F.col("visit_concept_id") == 9201).alias("inpatient"),
        F.count_if(F.col("visit_concept_id") == 9203).alias("emergency"))


def frequent_visits(visits: DataFrame) -> DataFrame:
    """Findings for two or more emergency visits and two or more admissions."""
    counts = visit_counts(visits)
    emergency, inpatient = F.col("emergency").cast("string"), F.col("inpatient").cast("string")
    return finding(
        counts.where(F.col("emergency") >= 2), "observation", "medium", "Frequent Emergency Visits",
        F.concat(F.lit("Patient has "), emergency, F.lit(" emergency department visits")),
        F.array(F.concat(F.lit("ED visits: "), emergency),
                F.concat(F.lit("Total visits: "), F.col("visits").cast("string"))),
        _texts(rules.EMERGENCY_ACTIONS), F.array(F.lit(9203).cast("bigint")),
    ).unionByName(finding(
        counts.where(F.col("inpatient") >= 2), "observation", "medium", "Frequent Hospitalizations",
        F.concat(F.lit("Patient has "), inpatient, F.lit(" inpatient admissions")),
        F.array(F.concat(F.lit("Inpatient admissions: "), inpatient)),
        _texts(rules.INPATIENT_ACTIONS), F.array(F.lit(9201).cast("bigint"))))


# --- all findings of a person ----------------------------------------------------------------

def all_findings(cdm: Cdm, match: str = "source_value") -> DataFrame:
    return cdm.each(lambda part: union_all([
        critical_lab_findings(part.measurement, match),
        trend_findings(part.measurement, part.by_person),
        interaction_findings(part.drug_exposure),
        metformin_findings(part.drug_exposure, part.measurement, match),
        diabetes_findings(part.condition_occurrence, part.measurement),
        frequent_visits(part.visit_occurrence)]))


def finding_titles(cdm: Cdm, match: str = "source_value") -> DataFrame:
    """Type, severity and title of all findings: what scores and rankings need."""
    return all_findings(cdm, match).select("person_id", "type", "severity", "title")


def of_people(cdm: Cdm, people: DataFrame) -> Cdm:
    """The tables cut to some persons, so that rules run on a cohort only."""
    ids = people.select("person_id")

    def cut(part: Cdm) -> dict[str, DataFrame]:
        return {name: table.join(ids, "person_id", "left_semi") for name, table in part.tables().items()}

    return Cdm(**cut(cdm), by_person=cdm.by_person, parts=tuple(Cdm(**cut(p), by_person=p.by_person) for p in cdm.parts))


def risk_score(cdm: Cdm, findings: DataFrame) -> DataFrame:
    """Severity-weighted score per person; people without findings score 0."""
    counts = findings.groupBy("person_id").agg(
        F.count("*").alias("findings"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity") == "medium").alias("medium"),
        F.count_if(F.col("severity") == "low").alias("low"))
    rows = cdm.person.select("person_id").join(counts, "person_id", "left").fillna(0)
    score = F.col("high") * 10 + F.col("medium") * 5 + F.col("low")
    return rows.select(
        "person_id", score.alias("score"),
        F.when(score >= 20, "High").when(score >= 10, "Medium").when(score > 0, "Low")
         .otherwise("Minimal").alias("level"),
        F.when(score >= 20, "red").when(score >= 10, "orange").when(score > 0, "yellow")
         .otherwise("green").alias("color"),
        F.col("high").alias("high_severity_findings"),
        F.col("medium").alias("medium_severity_findings"),
        F.col("low").alias("low_severity_findings"), "findings")


def person_values(rows: DataFrame, column: str) -> DataFrame:
    """Every distinct value of a person, one row each, numbered in order of the value."""
    distinct = rows.select("person_id", F.coalesce(column, F.lit("Unknown")).alias("value")).distinct()
    return distinct.withColumn("rank", F.row_number().over(Window.partitionBy("person_id").orderBy("value")))


def _few_values(rows: DataFrame, column: str, out: str, k: int) -> DataFrame:
    """Up to k distinct values per person, the smallest ones, as an array."""
    return person_values(rows, column).where(F.col("rank") <= k).groupBy("person_id").agg(
        F.array_sort(F.collect_list("value")).alias(out))


def patient_summary(cdm: Cdm, as_of: dt.date = DEFAULT_AS_OF, k: int = 10) -> DataFrame:
    """Age, sex, visit figures, up to ``k`` conditions and drugs, and the number of labs per person. All
    conditions and drugs are the rows of :func:`person_values`."""
    return cdm.each(lambda part: _summary(part, as_of, k))


def _summary(cdm: Cdm, as_of: dt.date, k: int) -> DataFrame:
    visits = cdm.visit_occurrence.groupBy("person_id").agg(
        F.count("*").alias("total_visits"),
        F.min("visit_start_date").cast("string").alias("earliest_visit"),
        F.max("visit_start_date").cast("string").alias("latest_visit"))
    labs = cdm.measurement.groupBy("person_id").agg(
        F.count_distinct("measurement_source_value").alias("recent_lab_count"))
    none = F.array().cast("array<string>")
    rows = cdm.person
    for part in (visits, labs,
                 _few_values(cdm.condition_occurrence, "condition_source_value", "active_conditions", k),
                 _few_values(cdm.drug_exposure, "drug_source_value", "current_medications", k)):
        rows = rows.join(part, "person_id", "left")
    return rows.select(
        "person_id", (F.lit(as_of.year) - F.col("year_of_birth")).alias("age"),
        gender_label(F.col("gender_concept_id")).alias("gender"),
        F.coalesce("total_visits", F.lit(0)).alias("total_visits"),
        F.coalesce("active_conditions", none).alias("active_conditions"),
        F.coalesce("current_medications", none).alias("current_medications"),
        F.coalesce("recent_lab_count", F.lit(0)).alias("recent_lab_count"),
        F.coalesce("earliest_visit", F.lit("N/A")).alias("earliest_visit"),
        F.coalesce("latest_visit", F.lit("N/A")).alias("latest_visit"))


def analyze_patients(cdm: Cdm, as_of: dt.date = DEFAULT_AS_OF, match: str = "source_value") -> DataFrame:
    """Summary and risk of every person; the findings themselves are :func:`all_findings`."""
    return cdm.each(lambda part: patient_summary(part, as_of).join(risk_score(part, finding_titles(part, match)), "person_id"))


def analysis_log(cdm: Cdm, match: str = "source_value") -> DataFrame:
    """One row per analysed person: the run (persons in order of their id), the token and the findings made.
    ``cohort.append_log`` stores such rows, ``cohort.recent_runs(log, 5)`` shows the latest."""
    counts = finding_titles(cdm, match).groupBy("person_id").agg(F.count("*").alias("insights_generated"))
    return cdm.person.select("person_id", F.col("person_source_value").alias("patient_token")).join(
        counts, "person_id", "left").select(
        F.col("person_id").alias("run"), "patient_token", F.coalesce("insights_generated", F.lit(0)).alias("insights_generated"))


def title_counts(cdm: Cdm, people: DataFrame, match: str = "source_value") -> DataFrame:
    """How often each finding occurs in a cohort: the one table both cohort reports start from."""
    return finding_titles(of_people(cdm, people), match).groupBy("type", "title").agg(F.count("*").alias("count"))


def cohort_findings(people: DataFrame, counts: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent finding titles of a cohort with count and prevalence.

    Prevalence relates findings, not people, to the cohort size, so it can exceed 100 %.
    """
    top = counts.groupBy("title").agg(F.sum("count").alias("count")).orderBy(F.col("count").desc(), "title").limit(k)
    size = people.agg(F.count("*")).scalar()
    return top.select(F.col("title").alias("finding"), "count",
                      percent_text(F.col("count"), size).alias("prevalence"))


def research_opportunities(people: DataFrame, counts: DataFrame) -> DataFrame:
    """Study suggestions: any cohort of ten or more, any quality finding."""
    size = people.agg(F.count("*").alias("n")).where("n >= 10").select(
        F.lit("Cohort Study Opportunity").alias("title"),
        F.concat(F.lit("Cohort of "), F.col("n").cast("string"),
                 F.lit(" patients available for retrospective analysis")).alias("description"),
        _texts(rules.STUDY_ANALYSES).alias("suggested_analyses"))
    gaps = counts.where(F.col("type") == "quality_metric").agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("n")).where("n > 0").select(
        F.lit("Quality Improvement Study").alias("title"),
        F.concat(F.lit("Identified "), F.col("n").cast("string"),
                 F.lit(" quality metric gaps")).alias("description"),
        _texts(rules.IMPROVEMENT_ANALYSES).alias("suggested_analyses"))
    return size.unionByName(gaps)


# --- population measures ---------------------------------------------------------------------

def _mentions(column: str, words: list[str]) -> Column:
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def quality_metrics(cdm: Cdm) -> DataFrame:
    """Four care measures: people with the condition and, among them, those with the evidence.

    Every table is reduced to one row of flags per person before anything is joined.
    """
    def flags(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
        return rows.groupBy("person_id").agg(
            *[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in made.items()])

    has, lab, drug = {}, {}, {}
    for key, _, _, _, condition_words, table, words in rules.QUALITY_MEASURES:
        has[f"has_{key}"] = _mentions("condition_source_value", condition_words)
        if table == "drug":
            drug[f"ok_{key}"] = _mentions("drug_source_value", words)
        else:
            hit = _mentions("measurement_source_value", words)
            if table == "measurement_below_140":
                hit = hit & (F.col("value_as_number") < 140)
            lab[f"ok_{key}"] = hit
    people = cdm.each(lambda part: flags(part.condition_occurrence, has)
                      .join(flags(part.measurement, lab), "person_id", "left")
                      .join(flags(part.drug_exposure, drug), "person_id", "left"))
    counts = people.agg(*[
        F.count_if(c).alias(n)
        for key, *_ in rules.QUALITY_MEASURES
        for n, c in ((f"n_{key}", F.col(f"has_{key}") & F.col(f"ok_{key}")),
                     (f"d_{key}", F.col(f"has_{key}")))])
    lines = F.array(*[
        F.struct(F.lit(key).alias("metric"), F.lit(name).alias("name"),
                 F.lit(text).alias("description"), F.col(f"n_{key}").alias("numerator"),
                 F.greatest(F.col(f"d_{key}"), F.lit(1)).alias("denominator"),
                 F.lit(target).alias("target"))
        for key, name, text, target, *_ in rules.QUALITY_MEASURES])
    share = F.col("numerator") / F.col("denominator")
    return counts.select(F.inline(lines)).select(
        "*", percent(F.col("numerator"), F.col("denominator")).alias("rate"),
        F.when(share >= F.col("target") / 100, "met").otherwise("gap").alias("status"))


def quality_overview(cdm: Cdm) -> DataFrame:
    """Mean rate (summed in declared order), number of persons, measures met and missed."""
    keys = [m[0] for m in rules.QUALITY_MEASURES]
    per_key = quality_metrics(cdm).agg(
        *[F.max(F.when(F.col("metric") == k, F.col("rate"))).alias(k) for k in keys],
        F.count_if(F.col("status") == "gap").alias("gaps_identified"),
        F.count_if(F.col("status") == "met").alias("metrics_met"))
    total = F.col(keys[0])
    for k in keys[1:]:
        total = total + F.col(k)
    return side_by_side(
        per_key.select(F.round(total / len(keys), 1).alias("overall_quality_score"),
                       "gaps_identified", "metrics_met"),
        cdm.person.agg(F.count("*").alias("total_patients")))


def readmission_risk(cdm: Cdm, as_of: dt.date = DEFAULT_AS_OF, match: str = "source_value") -> DataFrame:
    """Five-factor readmission score of every person. Zero lab values are ignored."""
    value = F.nullif(F.col("value_as_number"), F.lit(0.0))
    critical = ((_is_lab("creatinine", match) & (value > 4.0))
                | (_is_lab("potassium", match) & ((value < 3.0) | (value > 6.0)))
                | (_is_lab("hemoglobin", match) & (value < 8.0)))

    def figures(part: Cdm) -> DataFrame:
        rows = part.person.select("person_id", (F.lit(as_of.year) - F.col("year_of_birth")).alias("age"))
        for counted in (
                visit_counts(part.visit_occurrence).select("person_id", "inpatient"),
                part.drug_exposure.groupBy("person_id").agg(F.count_distinct("drug_source_value").alias("drugs")),
                part.condition_occurrence.groupBy("person_id").agg(F.count_distinct("condition_source_value").alias("conditions")),
                part.measurement.groupBy("person_id").agg(F.bool_or(critical).alias("critical"))):
            rows = rows.join(counted, "person_id", "left")
        return rows

    rows = cdm.each(figures)
    # FIXED VALUES: factor name, condition, detail, points
    factors = [
        ("Frequent Hospitalizations", F.col("inpatient") >= 2,
         F.concat(F.col("inpatient").cast("string"), F.lit(" admissions")), 10),
        ("Polypharmacy", F.col("drugs") >= 5,
         F.concat(F.col("drugs").cast("string"), F.lit(" medications")), 5),
        ("Multiple Comorbidities", F.col("conditions") >= 3,
         F.concat(F.col("conditions").cast("string"), F.lit(" conditions")), 5),
        ("Critical Lab Values", F.col("critical"), F.lit("Abnormal values detected"), 5),
        ("Advanced Age", F.col("age") > 75, F.concat(F.lit("Age "), F.col("age").cast("string")), 3),
    ]
    found = F.array_compact(F.array(*[
        F.when(met, F.struct(F.lit(name).alias("factor"), detail.alias("detail"),
                             F.lit(points).alias("points")))
        for name, met, detail, points in factors]))
    scored = rows.select("person_id", found.alias("risk_factors")).withColumn(
        "readmission_risk_score",
        F.aggregate("risk_factors", F.lit(0), lambda total, f: total + f["points"]))
    score = F.col("readmission_risk_score")
    level = F.when(score >= 16, "High").when(score >= 6, "Medium").otherwise("Low")
    return scored.select(
        "person_id", "readmission_risk_score", level.alias("risk_level"),
        F.when(score >= 16, "red").when(score >= 6, "orange").otherwise("green").alias("color"),
        "risk_factors",
        F.when(score >= 16, "Consider care management enrollment")
         .otherwise("Standard follow-up").alias("recommendation"))
