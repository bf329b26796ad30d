"""Exports: de-identified CSV, entity CSV and JSON, annotated HTML, audit text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspan.fixed import concepts, lexicon
from clinspan.functions import spans
from clinspan.operators import notes
from clinspan.operators.ids import first_row


def deid_csv_rows(people: DataFrame, encounters: DataFrame) -> DataFrame:
    """One row per encounter with its patient (the token's last record), or the patients alone when
    there are no encounters. On columns both have, the encounter's value counts."""
    last = first_row(people, ["patient_token"], [F.col("src_ord").desc()]).select(
        "patient_token", "surrogate_id", "gender", "year_of_birth", "age_at_data_collection", "region")
    rows = encounters.join(last, "patient_token", "left").withColumn(
        "month_of_birth", F.lit(None).cast("int")).select(*concepts.DEID_CSV_COLUMNS)
    kinds = dict(rows.dtypes)
    alone = people.where(~encounters.select(F.lit(1)).exists()).select(*[
        (F.col(c) if c in people.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in concepts.DEID_CSV_COLUMNS])
    return rows.unionByName(alone)


# quotes are doubled, and blanks around a value are part of it
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_deid_csv(rows: DataFrame, path: str) -> None:
    rows.write.options(**_CSV, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss").csv(path)


def entity_csv_rows(extracted: DataFrame) -> DataFrame:
    def yes(flag: str) -> Column:
        return F.when(F.col(flag), "yes").otherwise("no").alias(flag)

    return notes.entity_rows(extracted).select(
        "doc_id", F.col("text").alias("span_text"), F.col("entity_type_label").alias("entity_type"),
        "layer", "vocabulary", "concept", "code", "confidence", yes("negated"), yes("historical"),
        "subject", F.trim(F.translate("context", "\n", " ")).alias("context"))


def write_entity_csv(rows: DataFrame, path: str) -> None:
    rows.select(*lexicon.ENTITY_CSV_COLUMNS).write.options(**_CSV).csv(path)


def operation_array(extracted: DataFrame) -> DataFrame:
    """The audit trail of each note as one array (always eight steps), made inside the note's row."""
    return notes.stats(extracted).select("doc_id", notes.operation_steps().alias("operations"))


def entity_json(extracted: DataFrame) -> DataFrame:
    """One JSON document per note: text, stats, vocabularies, audit trail, entities."""
    shown = F.transform("entities", lambda e: e.withField("confidence", F.round(e["confidence"], 2)))
    rows = notes.stats(extracted, "text", shown.alias("entities"))
    keys = [c for c in rows.columns if c not in ("doc_id", "vocabularies_used", "text", "entities")]
    return rows.select("doc_id", F.to_json(F.struct(
        F.col("text").alias("source_note"), F.struct(*keys).alias("stats"),
        "vocabularies_used", notes.operation_steps().alias("operations"), "entities")).alias("json"))


def write_json(documents: DataFrame, path: str) -> None:
    documents.select("json").write.text(path)


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def annotated_html(extracted: DataFrame) -> DataFrame:
    """The note as HTML with one marked span per entity."""
    def marked(e: Column, text: Column) -> Column:
        style = F.concat(
            F.lit("background:"), e["color"], F.lit("22;border:1px solid "), e["color"],
            F.lit("66;border-radius:3px;padding:0 2px;"),
            F.when(e["negated"], "text-decoration:line-through;").otherwise(""),
            F.when(e["historical"], "font-style:italic;").otherwise(""))
        title = F.concat(_escaped(e["concept"]), F.lit(" ["), e["vocabulary"], F.lit(" "), e["code"],
                         F.lit("] conf="), F.round(e["confidence"], 2).cast("string"))
        return F.concat(F.lit('<span style="'), style, F.lit('" title="'), title, F.lit('">'),
                        _escaped(text), F.lit("</span>"))

    body = spans.replace_spans(F.col("text"), F.col("entities"), marked, _escaped)
    page = F.concat(
        F.lit('<!doctype html><html><head><meta charset="utf-8"><title>Annotated note</title></head>'
              '<body style="font-family:monospace;white-space:pre-wrap;line-height:1.8">'),
        body, F.lit("</body></html>"))
    return extracted.select("doc_id", page.alias("html"))


def operations_text(extracted: DataFrame) -> DataFrame:
    """The audit trail of each note as plain text."""
    lines = F.transform("operations", lambda o: F.concat(
        F.lit("["), o["step"].cast("string"), F.lit("] "), o["operation"], F.lit("\n      "), o["detail"],
        F.lit("  (count: "), o["count"].cast("string"), F.lit(")")))
    return notes.stats(extracted).withColumn("operations", notes.operation_steps()).select(
        "doc_id", F.concat(
            F.lit("CLINICAL TEXT EXTRACTION — OPERATIONS / AUDIT LOG\nThreshold: "),
            F.col("threshold").cast("string"), F.lit("\n\n"), F.array_join(lines, "\n"),
            F.lit("\n\nVocabularies used: "), F.array_join("vocabularies_used", ", ")).alias("log"))
