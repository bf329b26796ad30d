"""Detection and masking of personal identifiers in text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspan.fixed import patterns as fixed
from clinspan.functions import spans
from clinspan.session import sql_literal

HIT = "struct<start:int,rank:double,place:int,`end`:int,type:string,text:string,confidence:double>"

_ORDERED = f"struct<start:int,back:int,place:int,`end`:int,hit:{HIT}>"


_LABEL = "named_struct('rank', {rank!r}D, 'place', {place}, 'type', '{kind}', 'confidence', {confidence!r}D)"
_MADE = ("named_struct('start', {start}, 'rank', g.label.rank, 'place', g.label.place, 'end', {end}, "
         "'type', g.label.type, 'text', {text}, 'confidence', g.label.confidence)")


def _label(place: int, kind: str, confidence: float) -> str:
    return _LABEL.format(rank=-confidence, place=place, kind=kind, confidence=confidence)


def _known_names(text: str, folded: str, known: Sequence[str]) -> str:
    """All known names in one pass; no two of them start at the same place."""
    if not known:
        return f"cast(array() AS array<{HIT}>)"
    names = [name.lower() for name in known]
    starts = spans.starts_sql(text, "(?iu)" + spans.phrase_pattern(names, "", ""))
    made = _MADE.format(start="n.start", end="n.`end`", text="n.text")
    label = f"named_struct('label', {_label(0, 'name', fixed.KNOWN_NAME_CONFIDENCE)}, 'found', {starts})"
    found = f"get(transform(array({label}), g -> transform(g.found, n -> {made})), 0)"
    return spans.only_if_any(folded, names, found, HIT)


def _hits(text: str, folded: str, digits: str, unmarked: str, known: Sequence[str]) -> str:
    """Raw hits as SQL, one array each: the known names, then each pattern in detection order."""
    rows = []
    for i, (kind, pattern) in enumerate(fixed.PHI_PATTERNS):
        needs = []
        if i in fixed.PHI_NEEDS_DIGITS:
            needs.append(f"{digits} >= {fixed.PHI_NEEDS_DIGITS[i]}")
        if i in fixed.PHI_NEEDS:
            needs.append(spans.holds_any(folded, fixed.PHI_NEEDS[i]))
        if i in fixed.PHI_NEEDS_PART:
            needs.append(f"rlike({text}, {sql_literal('(?iuU)' + fixed.PHI_NEEDS_PART[i])})")
        if pattern in fixed.PHI_REQUIRED_TAILS:
            needs.append(f"rlike({text}, {sql_literal('(?iuU)' + fixed.PHI_REQUIRED_TAILS[pattern])})")
        first = f"(?=[{fixed.PHI_FIRST[i]}])" if i in fixed.PHI_FIRST else ""
        run = "(?iuU)" + first + fixed.PHI_FLAT_FORMS.get(pattern, pattern)
        rows.append((run, " and ".join(needs) or None, _label(i + 1, kind, fixed.PHI_CONFIDENCE)))
    return f"concat(array({_known_names(text, folded, known)}), {spans.find_each_sql(unmarked, rows, _MADE, HIT)})"


def _digits_in_a_row(text: str) -> str:
    """The most digits in a row in a text, as far as patterns ask for them; longer runs are looked for where shorter ones are."""
    found, longer = "", sorted(set(fixed.PHI_NEEDS_DIGITS.values()), reverse=True)
    for run in longer:
        pattern = sql_literal(f"(?U)\\d{{{run}}}")
        found = f"if(rlike({text}, {pattern}), {f'greatest({run}, {found})' if found else run}, 0)"
    return found


def detect(notes: DataFrame, text: str = "text", out: str = "phi", known_names: Sequence[str] = ()) -> DataFrame:
    """Add the identifiers of a text in reading order; ``known_names`` are found wherever they stand.

    A hit lying inside a hit of an earlier pattern is dropped (known names never are). A dropped
    hit lies in a kept one, so it is enough to compare with the raw earlier hits. Of the rest, hits
    are taken by start, then confidence, then pattern order, as long as they do not overlap.
    """
    folded = notes.select("*", F.expr(spans.folded_sql(text)).alias("_folded"), F.expr(spans.unmarked(text)).alias("_unmarked"),
                          F.expr(_digits_in_a_row(text)).alias("_digits"))
    # a projection of its own: the patterns run once, whatever refers to their hits below
    raw = folded.select(*notes.columns, F.expr(_hits(text, "_folded", "_digits", "_unmarked", known_names)).alias("_hits"))
    # only the patterns that hit are walked, by their place among those
    hit = "filter(_hits, g -> size(g) > 0)"
    ordered = (f"array_sort(flatten(transform({hit}, (g, n) -> transform(g, h -> "
               "named_struct('start', h.start, 'back', -h.`end`, 'place', n, 'end', h.`end`, 'hit', h)))))")
    # the furthest end of each pattern's hits so far: at least the same start, and longer ones first
    first = f"array_repeat(-1, size({hit}))"
    following = "transform(t.v, (m, i) -> if(i = x.place, greatest(m, x.`end`), m))"
    outside = "not exists(slice(t.v, 1, x.place), m -> m >= x.`end`)"
    free = spans.walked_sql(ordered, _ORDERED, first, following, outside)
    merged = f"array_sort(transform({free}, x -> x.hit))"
    return raw.select(*notes.columns, F.expr(spans.disjoint_sql(merged, HIT)).alias(out))


def _masks() -> Column:
    return F.create_map(*[F.lit(x) for pair in fixed.PHI_MASKS for x in pair])


def mask(text: Column, detections: Column) -> Column:
    """The text with every detection replaced by the mask of its type."""
    masks = _masks()
    return spans.replace_spans(text, detections, lambda d, _: F.element_at(masks, d["type"]))


def phi_rows(detected: DataFrame) -> DataFrame:
    """One row per detection with its replacement."""
    return spans.rows_of(detected, "phi", "doc_id").select(
        "doc_id", "text", "type", "start", "end", "confidence",
        F.element_at(_masks(), F.col("type")).alias("replacement"))


def summary(detected: DataFrame) -> DataFrame:
    """Detections per note as a map type -> list, and the types found in reading order."""
    types = F.array_distinct("phi.type")

    def listed(kind: Column) -> Column:
        return F.transform(F.filter("phi", lambda d: d["type"] == kind), lambda d: F.struct(
            d["text"].alias("text"), F.element_at(_masks(), d["type"]).alias("replacement"),
            d["confidence"].alias("confidence")))

    return detected.select(
        "doc_id", F.size("phi").alias("total_phi_found"),
        F.map_from_arrays(types, F.transform(types, listed)).alias("phi_by_type"),
        types.alias("types_found"))


def type_counts(detected: DataFrame) -> DataFrame:
    """Detections and notes per identifier type over the corpus."""
    per_note = spans.rows_of(detected, "phi", "doc_id").groupBy("doc_id", "type").agg(
        F.count("*").alias("n"))
    return per_note.groupBy("type").agg(F.sum("n").alias("detections"), F.count("*").alias("notes"))
