"""Masking of identifiers in clinical notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinspan.fixed.patterns import NOTE_REDACTIONS


def redact_note(text: Column, order: str = "safe", strict_case: bool = False) -> Column:
    """Replace identifiers one pattern after the other; each sees the previous result.

    ``order="legacy"`` masks names first, which can tear an e-mail address apart; ``"safe"``
    masks the structured identifiers first and names last.
    """
    if order not in ("safe", "legacy"):
        raise ValueError(f"unknown redaction order {order!r}")
    names, rest = NOTE_REDACTIONS[:1], NOTE_REDACTIONS[1:]
    for pattern, mask in (names + rest if order == "legacy" else rest + names):
        flags = "(?U)" if strict_case and mask == "[NAME]" else "(?iuU)"
        text = F.regexp_replace(text, F.lit(flags + pattern), F.lit(mask))
    return text
