"""Span expressions over one text, evaluated row by row inside Spark.

One ``regexp_replace`` brackets every match with two marker characters; splitting at the marker
then yields the matches with their offsets, so each pattern costs a single pass over the text.
Offsets count code points from 0 and the end is exclusive.

The expressions are stated as SQL text: a query may hold dozens of them, and parsing one string is
far cheaper than assembling it call by call. ``text`` arguments are SQL expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspan.session import sql_literal

OPEN, CLOSE = "\x01", "\x02"
SPAN = "struct<start:int,`end`:int,text:string>"
SPAN_FIELDS = "named_struct('start', {start}, 'end', {end}, 'text', {text})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once, however often the body (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unmarked(text: str) -> str:
    """The text with stray marker characters swapped for others of the same regex class."""
    for marker, other in ((OPEN, chr(3)), (CLOSE, chr(4))):
        text = f"replace({text}, {sql_literal(marker)}, {sql_literal(other)})"
    return text


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


CHUNK = 256  # elements of a walk whose notes are copied at each step


def _chunks(array: str) -> str:
    return (f"transform(sequence(0, cast(greatest(size({array}) - 1, 0) div {CHUNK} AS int)), "
            f"k -> slice({array}, k * {CHUNK} + 1, {CHUNK}))")


def _starts(pieces: str, length: str) -> str:
    """Running start of each piece ``q`` of an array.

    Sums are noted in a comma-separated text, since appending to an array would copy all its elements at
    every step. The text is copied too, so it is kept short: each chunk of pieces has one, and the chunks'
    own starts are summed in the same way.
    """
    def summed(array: str, item: str, size: str) -> str:
        return (f"aggregate({array}, named_struct('at', 0, 'all', ''), (s, {item}) -> named_struct("
                f"'at', s.at + {size}, 'all', concat(s.all, s.at, ',')))")

    local = f"transform({_chunks(pieces)}, c -> {summed('c', 'q', length)})"
    bases = "split(" + summed("ls", "l", "l.at") + ".all, ',')"
    shifted = ("flatten(transform(ls, (l, n) -> transform(filter(split(l.all, ','), t -> t <> ''), "
               "t -> cast(t AS int) + cast(os[n] AS int))))")
    return _let(local, "ls", _let(bases, "os", shifted))


def _cut(unmarked_text: str, pattern: str, group: int) -> str:
    """The text, free of markers, cut before each match; each piece but the first starts with its match and ``CLOSE``."""
    marked = (f"regexp_replace({unmarked_text}, {sql_literal(pattern)}, "
              f"{sql_literal(f'{OPEN}${group}{CLOSE}')})")
    return f"split({marked}, {sql_literal(OPEN)}, -1)"


def _placed(pieces: str, inserted: bool, fields: str, kind: str) -> str:
    close = sql_literal(CLOSE)
    width = f"(instr(q, {close}) - 1)"
    # the first piece has no bracket; an inserted match is a copy that takes no room
    room = f"if(instr(q, {close}) = 0, length(q), length(q) - " + (f"1 - {width})" if inserted else "1)")
    start = "b.at[i + 1]"
    made = fields.format(start=start, end=f"({start} + {width})", text=f"substring_index(q, {close}, 1)")
    found = _let(f"named_struct('p', p, 'at', {_starts('p', room)})", "b",
                 f"transform(slice(b.p, 2, size(b.p)), (q, i) -> {made})")
    return _let(pieces, "p", f"if(size(p) > 1, {found}, cast(array() AS array<{kind}>))")


def _located(text: str, pattern: str, group: int, inserted: bool, fields: str, kind: str) -> str:
    return _placed(_cut(unmarked(text), pattern, group), inserted, fields, kind)


def find_each_sql(unmarked_text: str, patterns: list[tuple[str, str | None, str]], fields: str, kind: str) -> str:
    """The matches of each of the (pattern, condition, label) rows, one array per row.

    ``condition`` is SQL that says whether the pattern can match at all; ``label`` is a struct that ``fields`` reads as
    ``g.label``. Offsets are worked out by one expression for all patterns: with one for each, making the plan of some
    dozens of patterns takes longer than running them. ``unmarked_text`` has been through :func:`unmarked`.
    """
    def pieces(pattern: str, condition: str | None) -> str:
        cut = _cut(unmarked_text, pattern, 0)
        return cut if condition is None else f"if({condition}, {cut}, cast(array() AS array<string>))"

    rows = ", ".join(f"named_struct('label', {label}, 'p', {pieces(pattern, condition)})"
                     for pattern, condition, label in patterns)
    return f"transform(array({rows}), g -> {_placed('g.p', False, fields, kind)})"


def find_sql(text: str, pattern: str, fields: str = SPAN_FIELDS, kind: str = SPAN) -> str:
    """All non-overlapping matches as an array; ``fields`` builds one element from its offsets."""
    return _located(text, pattern, 0, False, fields, kind)


def starts_sql(text: str, pattern: str) -> str:
    """Positions where the look-ahead ``pattern`` holds, with the text its group 1 captured.

    The pattern matches the empty string, so captured texts may overlap each other.
    """
    return _located(text, pattern, 1, True, SPAN_FIELDS, SPAN)


def find_spans(text: str, pattern: str) -> Column:
    """All non-overlapping matches of ``pattern`` as an array of (start, end, text)."""
    return F.expr(find_sql(text, pattern))


def pieces_sql(text: str, pattern: str) -> str:
    """Contiguous (start, end, text) pieces that each end with a match of ``pattern``."""
    cut = (f"split(regexp_replace({unmarked(text)}, {sql_literal(pattern)}, "
           f"{sql_literal('$0' + OPEN)}), {sql_literal(OPEN)}, -1)")
    start = "b.at[i]"
    made = SPAN_FIELDS.format(start=start, end=f"({start} + length(q))", text="q")
    return _let(cut, "p", _let(f"named_struct('p', p, 'at', {_starts('p', 'length(q)')})", "b",
                               f"transform(b.p, (q, i) -> {made})"))


def walked_sql(sorted_spans: str, kind: str, first: str, following: str, keep: str) -> str:
    """The spans ``x`` that ``keep`` accepts on a walk in their order; ``t.v`` is the walk's state, ``first`` and
    then what ``following`` makes of it and each span.

    The walk notes one character per span, by chunks, and the spans are filtered by it.
    """
    chunk = (f"aggregate(c, named_struct('v', s.v, 'f', ''), (t, x) -> named_struct('v', {following}, "
             f"'f', concat(t.f, if({keep}, '1', '0'))))")
    flags = (f"split(aggregate({_chunks('xs')}, named_struct('v', {first}, 'f', ''), (s, c) -> "
             + _let(chunk, "r", "named_struct('v', r.v, 'f', concat(s.f, r.f))") + ", s -> s.f), '')")
    kept = _let(f"named_struct('xs', xs, 'f', {flags})", "b", "filter(b.xs, (x, i) -> b.f[i] = '1')")
    return _let(f"cast({sorted_spans} AS array<{kind}>)", "xs", f"if(size(xs) = 0, xs, {kept})")


def disjoint_sql(sorted_spans: str, kind: str) -> str:
    """Walk spans in their given order and keep each that starts at or after the last kept end."""
    return walked_sql(sorted_spans, kind, "0", "if(x.start >= t.v, x.`end`, t.v)", "x.start >= t.v")


BLOCK_BITS = 8


def block_index(items: Column, length: Column) -> Column:
    """For each block of 2^BLOCK_BITS characters, how many of the ``items``, ordered by start, start at or before its
    first character."""
    def blocks(low: Column, high: Column) -> Column:
        top = (1 << BLOCK_BITS) - 1
        return F.shiftright(high + top, BLOCK_BITS) - F.shiftright(low + top, BLOCK_BITS)

    end = length + (2 << BLOCK_BITS)
    ahead = F.array_repeat(F.lit(0), blocks(F.lit(0), F.coalesce(F.get(items, F.lit(0))["start"], end)))
    return F.concat(ahead, F.flatten(F.transform(items, lambda s, i: F.array_repeat(
        i + 1, blocks(s["start"], F.coalesce(F.get(items, i + 1)["start"], end))))))


def last_started(items: Column, index: Column, at: Column) -> Column:
    """The last of the ``items`` that starts at or before ``at``, by their block index; NULL if there is none."""
    block = F.shiftright(at, BLOCK_BITS)
    low = F.greatest(F.get(index, block), F.lit(1))
    few = F.slice(items, low, F.greatest(F.get(index, block + 1) - low + 1, F.lit(0)))
    return F.try_element_at(F.filter(few, lambda s: s["start"] <= at), F.lit(-1))


def folded_sql(text: str) -> str:
    """Lower case the way case-insensitive matching folds letters (through upper case)."""
    return f"replace(lower(upper({text})), {sql_literal('i' + chr(0x307))}, 'i')"


def phrase_pattern(phrases: list[str], before: str, after: str) -> str:
    """Zero-width pattern for the places where a phrase starts; group 1 is the longest phrase.

    ``before`` and ``after`` are the border conditions. Phrases are grouped by first character so a
    position tries few of them.
    """
    return f"{before}(?=({any_of(phrases)}){after})"


def any_of(phrases: list[str]) -> str:
    """Pattern for the longest of the phrases that stands at a place."""
    by_first: dict[str, list[str]] = {}
    for phrase in sorted(phrases, key=len, reverse=True):
        by_first.setdefault(phrase[0], []).append(phrase[1:])
    return "|".join(
        f"{_escape(first)}(?:{'|'.join(_escape(rest) for rest in group)})"
        for first, group in sorted(by_first.items()))


def _escape(phrase: str) -> str:
    return re.sub(r"([.()+*?\[\]{}|^$\\])", r"\\\1", phrase)


def only_if_any(folded: str, needed: list[str], found: str, kind: str) -> str:
    """``found`` if the folded text holds one of the needed parts, else no spans at all.

    A pattern that cannot match without a literal part is not run on texts that lack it.
    """
    return f"if({holds_any(folded, needed)}, {found}, cast(array() AS array<{kind}>))"


def holds_any(folded: str, needed: list[str]) -> str:
    """Whether the folded text holds one of the needed parts."""
    return "(" + " or ".join(f"contains({folded}, {sql_literal(part)})" for part in needed) + ")"


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` up to ``end`` (0-based, end exclusive)."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def replace_spans(text: Column, found: Column, piece: Callable[[Column, Column], Column],
                  between: Callable[[Column], Column] = lambda part: part) -> Column:
    """The text with each of the ordered, disjoint spans replaced by ``piece(span, its text)``.

    ``between`` maps the parts outside spans. The text is cut into characters once: a substring call
    per span would walk the text from its beginning every time.
    """
    def part(chars: Column, start: Column, end: Column) -> Column:
        return F.array_join(F.slice(chars, start + 1, F.greatest(end - start, F.lit(0))), "")

    def rebuilt(p: Column) -> Column:
        chars, all_spans = p["chars"], p["spans"]

        def one(span: Column, i: Column) -> Column:
            before = F.coalesce(F.get(all_spans, i - 1)["end"], F.lit(0))
            return F.concat(between(part(chars, before, span["start"])),
                            piece(span, part(chars, span["start"], span["end"])))

        last = F.coalesce(F.try_element_at(all_spans, F.lit(-1))["end"], F.lit(0))
        return F.concat(F.array_join(F.transform(all_spans, one), ""),
                        between(part(chars, last, F.size(chars))))

    cut = F.struct(F.split(text, "", -1).alias("chars"), found.alias("spans"))
    return F.when(F.size(found) == 0, between(text)).otherwise(let(cut, rebuilt))


def rows_of(df: DataFrame, spans: str, *keep: str) -> DataFrame:
    """One row per element of a struct array, next to the columns to keep.

    The outer form plus a filter on the result: for the plain form Spark adds a "not empty" filter
    below, which would compute the whole array a second time.
    """
    fields = df.schema[spans].dataType.elementType.names
    rows = df.select(*keep, F.explode_outer(spans).alias("_row")).where(F.col("_row").isNotNull())
    return rows.select(*keep, *[F.col("_row")[f].alias(f) for f in fields])


def struct_sql(names: str, row: tuple) -> str:
    """A constant struct as SQL text."""
    pairs = zip(names.split(", "), row)
    return "named_struct(" + ", ".join(f"'{n}', {sql_literal(v)}" for n, v in pairs) + ")"


def constant_map(pairs: dict) -> Column:
    """A constant map; values are SQL texts or plain values in a one-tuple."""
    return F.expr("map(" + ", ".join(
        f"{sql_literal(k)}, {sql_literal(v[0]) if isinstance(v, tuple) else v}"
        for k, v in pairs.items()) + ")")


def constant_value(pairs: dict, key: Column) -> Column:
    """What a constant map has for a key, or NULL. A map is searched from its first entry on, so the keys are dealt by their
    first character to as many small ones as there are such characters."""
    by_first: dict[int, dict] = {}
    for k, v in pairs.items():
        by_first.setdefault(ord(k[0]), {})[k] = v
    firsts = sorted(by_first)
    place = {c: firsts.index(c) for c in firsts}
    if max(firsts) > 127:
        return F.element_at(constant_map(pairs), key)
    places = F.expr("array(" + ", ".join(str(place.get(c, -1)) for c in range(128)) + ")")
    maps = F.array(*[constant_map(by_first[c]) for c in firsts])
    return F.element_at(F.get(maps, F.get(places, F.ascii(key))), key)
