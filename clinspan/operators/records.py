"""Clinical entities, vocabulary mappings and masked identifiers of whole text records."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspan.fixed import patterns as fixed
from clinspan.functions import spans
from clinspan.functions.normalize import word_count
from clinspan.operators import phi, terminology
from clinspan.session import sql_literal

ENTITY = "struct<start:int,shorter:int,place:int,`end`:int,type:string,text:string,confidence:double>"
# FIXED VALUES: mapping bucket per entity class
BUCKETS = [("condition", "conditions"), ("diagnosis", "conditions"), ("medication", "medications"),
           ("procedure", "procedures"), ("lab_test", "lab_tests"), ("lab_value", "lab_tests"),
           ("vital_sign", "vital_signs"), ("symptom", "symptoms")]


def _word_lists() -> dict[int, list[str]]:
    """Place -> phrases of the patterns that are plain lists of words between word borders."""
    lists = {}
    for place, (_, _, pattern) in enumerate(fixed.ENTITY_PATTERNS):
        plain = re.fullmatch(r"\\b\(([^()\\]+)\)\\b", pattern)
        if plain:
            lists[place] = plain.group(1).lower().split("|")
    return lists


def _phrase_table(lists: dict[int, list[str]]) -> tuple[list[str], dict[str, str]]:
    """All phrases, and for each the hits it stands for: per pattern, the first alternative that is
    the phrase itself or a beginning of it that ends at a word border."""
    phrases = sorted({p for alternatives in lists.values() for p in alternatives})
    table = {}
    for phrase in phrases:
        hits = []
        for place, alternatives in lists.items():
            kind, confidence, _ = fixed.ENTITY_PATTERNS[place]
            short = next((a for a in alternatives if phrase.startswith(a)
                          and not re.match(r"\w", phrase[len(a):])), None)
            if short:
                hits.append(spans.struct_sql("place, length, type, confidence",
                                             (place, len(short), kind, confidence)))
        table[phrase] = f"array({', '.join(hits)})"
    return phrases, table


def _phrase_hits(text: str) -> str:
    """Hits of all word-list patterns out of one pass over the text."""
    phrases, table = _phrase_table(_word_lists())
    starts = spans.starts_sql(text, "(?iuU)" + spans.phrase_pattern(phrases, r"\b", r"\b"))
    known = "map(" + ", ".join(f"{sql_literal(k)}, {v}" for k, v in table.items()) + ")"
    hit = """named_struct('start', n.start, 'shorter', cast(-t.length AS int), 'place', cast(t.place AS int),
        'end', cast(n.start + t.length AS int), 'type', t.type, 'text', substring(n.text, 1, cast(t.length AS int)),
        'confidence', t.confidence)"""
    every = f"flatten(transform({starts}, n -> transform(element_at({known}, {spans.folded_sql('n.text')}), t -> {hit})))"
    # matches of one pattern never overlap each other: the earlier one wins
    own = spans.disjoint_sql("filter(hs, h -> h.place = k)", ENTITY)
    return f"""get(transform(array({every}), hs ->
        flatten(transform(array_distinct(transform(hs, h -> h.place)), k -> {own}))), 0)"""


def clinical_entities(records: DataFrame, text: str = "text", out: str = "entities") -> DataFrame:
    """Add the entities of a text: hits of all class patterns by start, longest first, without
    overlaps; equal hits go to the earlier pattern."""
    hits = [_phrase_hits(text)]
    lists = _word_lists()
    for place, (kind, confidence, pattern) in enumerate(fixed.ENTITY_PATTERNS):
        if place not in lists:
            fields = (f"named_struct('start', {{start}}, 'shorter', {{start}} - {{end}}, 'place', {place}, "
                      f"'end', {{end}}, 'type', '{kind}', 'text', {{text}}, 'confidence', {confidence!r}D)")
            found = spans.find_sql(text, "(?iuU)" + pattern, fields, ENTITY)
            hits.append(spans.only_if_any("_folded", fixed.ENTITY_NEEDS[place], found, ENTITY))
    merged = f"array_sort(flatten(array({', '.join(hits)})))"
    folded = records.select("*", F.expr(spans.folded_sql(text)).alias("_folded"))
    return folded.select(*records.columns, F.expr(spans.disjoint_sql(merged, ENTITY)).alias(out))


def entity_rows(records: DataFrame) -> DataFrame:
    """One row per entity with the characters around it."""
    found = clinical_entities(records)
    reach = fixed.ENTITY_CONTEXT_CHARS
    # the context is cut inside the row, so the text is not copied to every entity
    cut = found.select("doc_id", F.transform("entities", lambda e: F.struct(
        e["text"].alias("text"), e["type"].alias("type"), e["start"].alias("start"), e["end"].alias("end"),
        e["confidence"].alias("confidence"),
        spans.slice_text(F.col("text"), F.greatest(e["start"] - reach, F.lit(0)),
                         e["end"] + reach).alias("context"))).alias("found"))
    return spans.rows_of(cut, "found", "doc_id")


def process(records: DataFrame, known_names: Sequence[str] = (), skip_empty: bool = True) -> DataFrame:
    """Records (doc_id, text) with everything found in them, one row each, made inside the row.

    ``entities`` carry their vocabulary entry, mapping bucket and the characters around them; ``mappings`` lists
    the mapped ones by bucket; ``phi`` are the identifiers, ``phi_summary`` their number and types.
    """
    found = phi.detect(clinical_entities(records), known_names=known_names)
    buckets = F.create_map(*[F.lit(x) for pair in BUCKETS for x in pair])
    reach = fixed.ENTITY_CONTEXT_CHARS

    def entity(e: Column) -> Column:
        best = F.get(terminology.mappings(e["type"], e["text"], skip_empty), F.lit(0))
        return spans.let(best, lambda m: F.struct(
            e["text"].alias("text"), e["type"].alias("type"), e["start"].alias("start"), e["end"].alias("end"),
            e["confidence"].alias("confidence"), F.element_at(buckets, e["type"]).alias("bucket"),
            m["term"].alias("normalized_term"), m["code"].alias("terminology_code"),
            m["system"].alias("terminology_system"),
            spans.slice_text(F.col("text"), F.greatest(e["start"] - reach, F.lit(0)), e["end"] + reach).alias("context")))

    names = list(dict.fromkeys(b for _, b in BUCKETS))
    told = found.select(
        "doc_id", phi.mask(F.col("text"), F.col("phi")).alias("deidentified_text"),
        F.transform("entities", entity).alias("entities"), "phi", F.length("text").alias("character_count"),
        word_count(F.col("text")).alias("word_count"))

    def in_bucket(name: str) -> Column:
        return F.filter("entities", lambda e: e["bucket"] == name)

    types = F.array_distinct("phi.type")
    return told.select(
        "*", F.size("entities").alias("entities_extracted"), F.size("phi").alias("phi_detected"),
        F.size("entities").alias("terminology_mappings"), *[F.size(in_bucket(n)).alias(n) for n in names],
        F.struct(*[in_bucket(n).alias(n) for n in names]).alias("mappings"),
        F.struct(F.size("phi").alias("total_phi_found"), types.alias("types_found")).alias("phi_summary"))


def mapped_entities(records: DataFrame, skip_empty: bool = True) -> DataFrame:
    """Entity rows with their vocabulary matches and mapping bucket."""
    buckets = F.create_map(*[F.lit(x) for pair in BUCKETS for x in pair])
    return terminology.map_entities(entity_rows(records), skip_empty=skip_empty).withColumn(
        "bucket", F.element_at(buckets, F.col("type")))
