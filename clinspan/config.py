"""Settings the operators take: secrets, the as-of date and the documented switches."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

DEFAULT_AS_OF = dt.date(2020, 1, 1)


@dataclass(frozen=True, kw_only=True)
class TokenConfig:
    """Key and salt of the patient token. There are no defaults: whoever knows them can recompute tokens."""

    secret_key: bytes = field(repr=False)
    salt: bytes = field(repr=False)
    use_salt: bool = True


@dataclass(frozen=True, kw_only=True)
class DeidConfig:
    shift_secret: str = field(repr=False)  # whoever knows it can undo the date shifts
    date_shift_range: tuple[int, int] = (-365, 365)
    age_threshold: int = 89
    use_surrogate_names: bool = True
    generalize_location: bool = True
    redact_clinical_notes: bool = True
    as_of: dt.date = DEFAULT_AS_OF
    # "source" shifts each source record on its own, "token" shifts a person consistently
    shift_key: str = "source"
    # True subtracts the age cap from the shifted birth year of people over the cap
    legacy_yob: bool = True
    # "safe" masks structured identifiers before names, "legacy" masks names first
    redact_order: str = "safe"
    # names must really be capitalised instead of matching any two words
    strict_case: bool = False
