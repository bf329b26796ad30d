"""Column expressions for names, dates, genders and display strings."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinspan.fixed import concepts as fixed
from clinspan.functions.spans import let

# FIXED VALUES: accepted date and datetime layouts, tried in this order
DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "M-d-yyyy"]
DATETIME_FORMATS = [
    "yyyy-M-d H:m:s", "yyyy-M-d", "yyyy-M-d'T'H:m:s",
    "d/M/yyyy H:m:s", "d/M/yyyy", "M/d/yyyy H:m:s", "M/d/yyyy",
]
MALE_WORDS = ["M", "MALE", "MAN", "BOY"]
FEMALE_WORDS = ["F", "FEMALE", "WOMAN", "GIRL"]


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def normalize_name(value: Column) -> Column:
    """Upper case without the article ``AL`` (before a hyphen or blank), blanks and hyphens."""
    name = F.trim(F.upper(F.coalesce(value, F.lit(""))))
    for part in ("AL-", "AL ", " ", "-"):
        name = F.replace(name, F.lit(part), F.lit(""))
    return name


def composite_key(national_id: Column, birth: Column, first: Column, last: Column,
                  gender: Column) -> Column:
    """The text a patient token is computed from; a missing national id is left out."""
    return F.concat_ws(
        "|",
        F.when(national_id != "", F.concat(F.lit("NID:"), national_id)),
        F.concat(F.lit("DOB:"), F.date_format(birth, "yyyyMMdd")),
        F.concat(F.lit("NAME:"), normalize_name(first), normalize_name(last)),
        F.concat(F.lit("GEN:"), gender),
    )


def _shape(layout: str) -> str:
    """What every text of a layout looks like. A failed parse costs an exception, a look at the shape next to nothing."""
    fields = {"yyyy": r"[-+]?\d{4,}", "'T'": "T", **dict.fromkeys("MdHms", r"[-+]?\d+")}
    return "(?i)^" + re.sub("yyyy|'T'|[MdHms]", lambda m: fields[m[0]], layout) + r"\z"


def _first_parse(value: Column, formats: list[str]) -> Column:
    text = blank_to_null(value)
    # years have four digits, every other field one or two
    text = F.when(~text.rlike(r"(?<!\d)(\d{3}|\d{5,})(?!\d)"), text)

    def parsed(t: Column) -> Column:
        return F.coalesce(*[F.when(t.rlike(_shape(f)), F.try_to_timestamp(t, F.lit(f))) for f in formats])

    return let(text, parsed)


def parse_date(value: Column) -> Column:
    return _first_parse(value, DATE_FORMATS).cast("date")


def parse_datetime(value: Column) -> Column:
    return _first_parse(value, DATETIME_FORMATS).cast("timestamp_ntz")


def parse_gender(value: Column) -> Column:
    word = F.upper(F.trim(value))
    return (F.when(word.isin(MALE_WORDS), "male")
            .when(word.isin(FEMALE_WORDS), "female")
            .otherwise("other"))


def source_system(value: Column) -> Column:
    """Institute name to source system code."""
    name = F.lower(F.trim(value))
    known = F.create_map(*[F.lit(x) for pair in fixed.SOURCE_SYSTEMS for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(name, F.lit(""))),
                      F.lit(fixed.DEFAULT_SOURCE_SYSTEM))


def diagnosis_string(code: Column, description: Column) -> Column:
    code, text = blank_to_null(code), blank_to_null(description)
    return (F.when(code.isNotNull() & text.isNotNull(), F.concat(text, F.lit(" ("), code, F.lit(")")))
            .when(text.isNotNull(), text)
            .when(code.isNotNull(), F.concat(F.lit("ICD: "), code))
            .otherwise("Not specified"))


def icd_code(diagnosis: Column) -> Column:
    """The first parenthesised ICD-10 code of a diagnosis text, or NULL."""
    return F.nullif(F.regexp_extract(diagnosis, r"\(([A-Z]\d{2}\.?\d*)\)", 1), F.lit(""))


def age_on(birth: Column, as_of: dt.date) -> Column:
    """Completed years between a birth date and ``as_of``."""
    before_birthday = (F.month(birth) * 100 + F.dayofmonth(birth)) > as_of.month * 100 + as_of.day
    return F.lit(as_of.year) - F.year(birth) - before_birthday.cast("int")


def percent_text(part: Column, whole: Column) -> Column:
    return F.concat(percent(part, whole).cast("string"), F.lit("%"))


def percent(part: Column, whole: Column) -> Column:
    return F.round(part / whole * 100, 1)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))


def gender_label(concept: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in fixed.GENDER_LABELS for x in pair])
    return F.coalesce(F.try_element_at(known, concept.cast("int")), F.lit("Unknown"))
