"""Dictionary entities in clinical notes, linked to vocabularies, with context flags.

Everything about one note is computed from its own text inside one row: no shuffle, no Python. All
dictionary phrases are found in a single pass by one look-ahead pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspan.fixed import lexicon as fixed
from clinspan.functions import spans
from clinspan.functions.normalize import word_count
from clinspan.session import sql_literal

_CLASS = {name: (label, layer, colour) for name, label, layer, colour in fixed.ENTITY_CLASSES}
_BORDER = "A-Za-z0-9"


TRIGGERS = {phrase: concept for concept in fixed.CONCEPTS for phrase in concept[0]}
TRIGGER_PATTERN = "(?iu)" + spans.phrase_pattern(
    list(TRIGGERS), f"(?<![{_BORDER}])", f"(?![{_BORDER}])")


def candidates_within(phrase: str) -> list[str]:
    """Phrases that also match wherever ``phrase`` does, at the same start: itself and every
    shorter phrase it begins with, up to a border."""
    return [p for p in TRIGGERS
            if phrase.startswith(p) and (p == phrase or not re.match(f"[{_BORDER}]", phrase[len(p)]))]


def _confidence(phrase: str) -> float:
    _, _, _, _, term, _, confidence, _ = TRIGGERS[phrase]
    return max(0.0, min(confidence + (0.02 if phrase == term.lower() else 0.0), 0.99))


def _concept_of(phrase: Column) -> Column:
    """The concept that a phrase is linked to."""
    names = ("entity_type, entity_type_label, layer, color, vocabulary, code, concept, semantic_tag,"
             " confidence, note")
    return spans.constant_value({
        key: spans.struct_sql(names, (kind, *_CLASS[kind], vocabulary, code, term, tag, _confidence(key), note))
        for key, (_, kind, vocabulary, code, term, tag, _, note) in TRIGGERS.items()}, phrase)


def phrase_key(text: Column) -> Column:
    return F.replace(F.lower(F.upper(text)), F.lit("i" + chr(0x307)), F.lit("i"))  # spans.folded_sql


def sentences(text: str) -> Column:
    """Sentence spans: up to a run of ``.!?`` before white space, or a blank line."""
    return F.filter(F.expr(spans.pieces_sql(text, "(?dU)" + fixed.SENTENCE_END)),
                    lambda s: s["text"].rlike(r"(?U)\S"))


def sections(text: str) -> Column:
    """Upper-case header lines as (start, end, name)."""
    found = spans.find_spans(text, "(?dmU)" + fixed.SECTION_HEADER)
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.regexp_replace(s["text"], F.lit(r"(?U)^\s+|\s*:$"), F.lit("")).alias("name")))


def phrase_starts(text: str) -> Column:
    """The longest dictionary phrase at every position where one starts."""
    return F.expr(spans.starts_sql(text, TRIGGER_PATTERN))


def candidate_count(starts: Column) -> Column:
    counts = {p: (len(candidates_within(p)),) for p in TRIGGERS}
    return F.aggregate(starts, F.lit(0).cast("bigint"),
                       lambda n, s: n + spans.constant_value(counts, phrase_key(s["text"])))


def candidates(notes: DataFrame) -> DataFrame:
    """Every phrase occurrence before overlaps are resolved, one row each."""
    table = spans.constant_map({
        p: "array(" + ", ".join(spans.struct_sql("trigger, length, confidence", (c, len(c), _confidence(c)))
                                for c in candidates_within(p)) + ")" for p in TRIGGERS})
    starts = spans.rows_of(notes.select("doc_id", phrase_starts("text").alias("found")), "found", "doc_id")
    within = starts.select("doc_id", "start", F.element_at(table, phrase_key(F.col("text"))).alias("within"))
    return spans.rows_of(within, "within", "doc_id", "start").select(
        "doc_id", "start", (F.col("start") + F.col("length")).alias("end"), "trigger", "confidence")


def _flat(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("\n"), F.lit(" ")))


def _any_cue(text: Column, cues: list[str]) -> Column:
    """Whether a text holds a cue; one that holds another cue need not be looked for."""
    needed = [cue for cue in cues if not any(other != cue and other in cue for other in cues)]
    return text.rlike(spans.any_of(needed))


def _flags(span: Column, sentence: Column, section: Column, concept: Column) -> Column:
    """negated, historical and subject of one entity inside its sentence and section."""
    text, at = sentence["text"], span["start"] - sentence["start"]
    width = span["end"] - span["start"]
    read = F.struct(
        _flat(text).alias("flat"), F.lower(section).alias("header"),
        _flat(spans.slice_text(text, F.greatest(at - fixed.CHARS_BEFORE, F.lit(0)), at)).alias("before"),
        _flat(spans.slice_text(text, at + width, at + width + fixed.CHARS_AFTER)).alias("after"))

    def flags(t: Column) -> Column:
        flat, header = t["flat"], t["header"]
        family = F.contains(header, F.lit("family history")) | _any_cue(flat, fixed.FAMILY_CUES)
        present = F.contains(header, F.lit("present illness")) | F.contains(flat, F.lit("present illness"))
        past = (F.contains(header, F.lit("past")) | F.contains(header, F.lit("pmh"))
                | _any_cue(flat, fixed.HISTORY_CUES))
        negated = _any_cue(t["before"], fixed.NEGATION_BEFORE) | _any_cue(t["after"], fixed.NEGATION_AFTER)
        return spans.let(F.struct(family.alias("family"), negated.alias("negated")), lambda f: F.struct(
            f["negated"].alias("negated"), (~f["family"] & ~present & past).alias("historical"),
            F.when(f["family"] & (concept["layer"] == "clinical"), "family").otherwise("patient").alias("subject")))

    return spans.let(read, flags)


def _linked(found: Column, p: Column) -> Column:
    """Resolved spans with concept, context flags and the sentence around them, from the parts of a note."""
    def placed(span: Column) -> Column:
        here = spans.last_started(p["sentences"], p["sentence_index"], span["start"])
        here = F.when(span["start"] < here["end"], here)
        header = spans.last_started(p["sections"], p["section_index"], span["start"])
        return F.struct(
            span.alias("span"), _concept_of(phrase_key(span["text"])).alias("concept"),
            F.coalesce(here, F.struct(span["start"].alias("start"), span["start"].alias("end"),
                                      F.lit("").alias("text"))).alias("sentence"),
            F.coalesce(header["name"], F.lit("")).alias("section"))

    def flagged(e: Column) -> Column:
        return F.struct(e.alias("found"), _flags(e["span"], e["sentence"], e["section"], e["concept"]).alias("flags"))

    def entity(f: Column) -> Column:
        e, flags = f["found"], f["flags"]
        span, concept = e["span"], e["concept"]
        return F.struct(
            span["text"].alias("text"), concept["entity_type"].alias("entity_type"),
            concept["entity_type_label"].alias("entity_type_label"), concept["layer"].alias("layer"),
            concept["color"].alias("color"), span["start"].alias("start"), span["end"].alias("end"),
            concept["vocabulary"].alias("vocabulary"), concept["code"].alias("code"),
            concept["concept"].alias("concept"), concept["semantic_tag"].alias("semantic_tag"),
            concept["confidence"].alias("confidence"),
            *[flags[n].alias(n) for n in ("negated", "historical", "subject")],
            F.regexp_replace(e["sentence"]["text"], F.lit(r"(?U)^\s+|\s+$"), F.lit("")).alias("context"),
            concept["note"].alias("note"))

    return F.transform(F.transform(F.transform(found, placed), flagged), entity)


def extract(notes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Notes (doc_id, text) with their entities and stage counts.

    Adds ``entities`` (those at or above the threshold, clamped to 0..1, in text order),
    ``sentence_count``, ``section_count``, ``candidate_spans`` and ``entities_linked``.
    """
    threshold = max(0.0, min(float(threshold), 1.0))
    starts = spans.starts_sql("text", TRIGGER_PATTERN)
    kept = f"get(transform(array({starts}), f -> named_struct('starts', f, 'kept', {spans.disjoint_sql('f', spans.SPAN)})), 0)"
    parts = F.struct(sentences("text").alias("sentences"), sections("text").alias("sections"),
                     F.expr(kept).alias("phrases"))

    def result(p: Column) -> Column:
        return F.struct(
            F.size(p["sentences"]).alias("sentence_count"), F.size(p["sections"]).alias("section_count"),
            candidate_count(p["phrases"]["starts"]).alias("candidate_spans"),
            _linked(p["phrases"]["kept"], p).alias("linked"))

    def indexed(p: Column) -> Column:
        length = F.length("text")
        return spans.let(F.struct(
            p["sentences"].alias("sentences"), p["sections"].alias("sections"), p["phrases"].alias("phrases"),
            spans.block_index(p["sentences"], length).alias("sentence_index"),
            spans.block_index(p["sections"], length).alias("section_index")), result)

    found = notes.withColumn("_note", spans.let(parts, indexed))
    return found.select(
        *notes.columns, F.col("_note.sentence_count").alias("sentence_count"),
        F.col("_note.section_count").alias("section_count"),
        F.col("_note.candidate_spans").alias("candidate_spans"),
        F.size("_note.linked").alias("entities_linked"),
        F.filter("_note.linked", lambda e: e["confidence"] >= threshold).alias("entities"),
        F.lit(threshold).alias("threshold"))


def entity_rows(extracted: DataFrame) -> DataFrame:
    """One row per entity, confidence rounded for display."""
    return spans.rows_of(extracted, "entities", "doc_id").withColumn(
        "confidence", F.round("confidence", 2))


def _count(condition) -> Column:
    return F.size(F.filter("entities", condition))


def stats(extracted: DataFrame, *more) -> DataFrame:
    """The figures of one note, one row per note, with ``more`` columns of the note if asked for."""
    return extracted.select(
        *more, "doc_id", F.length("text").alias("characters"), word_count(F.col("text")).alias("words"),
        F.col("sentence_count").alias("sentences"), F.col("section_count").alias("sections"),
        "candidate_spans", "entities_linked",
        F.size("entities").alias("entities_passed_threshold"),
        (F.col("entities_linked") - F.size("entities")).alias("entities_below_threshold"),
        _count(lambda e: e["negated"]).alias("negated_entities"),
        _count(lambda e: e["historical"]).alias("historical_entities"),
        _count(lambda e: e["subject"] == "family").alias("family_entities"),
        _count(lambda e: e["layer"] == "clinical").alias("clinical_layer"),
        _count(lambda e: e["layer"] == "molecular").alias("molecular_layer"),
        F.array_sort(F.array_distinct("entities.vocabulary")).alias("vocabularies_used"),
        "threshold")


def notes_rollup(extracted: DataFrame) -> DataFrame:
    """Corpus totals, one row."""
    zero = F.lit(0).cast("bigint")
    return extracted.agg(
        F.count("*").alias("notes"),
        F.coalesce(F.sum("candidate_spans"), zero).alias("candidate_spans"),
        F.coalesce(F.sum(F.size("entities")), zero).alias("entities_linked"),
        F.coalesce(F.sum(_count(lambda e: e["vocabulary"] == "SNOMED CT")), zero).alias("snomed_concepts"))


def operation_steps() -> Column:
    """The eight-step audit trail of a note, as an array made of its figures."""
    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    c = F.col
    limit = F.format_string("%.2f", c("threshold"))
    # FIXED VALUES: step names and wording
    steps = [
        (F.lit("Document parsed"),
         text(c("characters"), " characters, ", c("words"), " tokens ingested"), c("characters")),
        (F.lit("Segmentation"),
         text("Split into ", c("sentences"), " sentences across ", c("sections"), " sections"), c("sentences")),
        (F.lit("Named-entity recognition (MedCAT-style)"),
         text(c("candidate_spans"), " candidate spans detected"), c("candidate_spans")),
        (F.lit("Overlap resolution"),
         text(c("entities_linked"), " spans retained after longest-match resolution"), c("entities_linked")),
        (F.lit("Entity linking"),
         text("Linked to SNOMED CT / HGNC / HGVS / ClinVar / LOINC (", F.size("vocabularies_used"),
              " vocabularies)"), c("entities_linked")),
        (F.lit("Context detection (MetaCAT-style)"),
         text("Negation=", c("negated_entities"), ", Historical=", c("historical_entities"),
              ", Family=", c("family_entities")), c("entities_passed_threshold")),
        (text("Confidence threshold ≥ ", limit),
         text(c("entities_passed_threshold"), " entities passed, ", c("entities_below_threshold"),
              " below threshold"), c("entities_passed_threshold")),
        (F.lit("Structured export ready"),
         F.lit("Entities available as CSV / JSON / annotated HTML; flow into de-id → OMOP → cohort"),
         c("entities_passed_threshold")),
    ]
    return F.array(*[
        F.struct(F.lit(i).alias("step"), name.alias("operation"), detail.alias("detail"),
                 count.cast("bigint").alias("count"))
        for i, (name, detail, count) in enumerate(steps, start=1)])


def operations(note_stats: DataFrame) -> DataFrame:
    """The eight-step audit trail of each note, one row per step."""
    return note_stats.select("doc_id", F.inline(operation_steps()))
