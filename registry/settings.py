"""Test values the registered queries and the tests use: secrets and known names. The library has none."""

from __future__ import annotations

from clinspan.config import DeidConfig, TokenConfig

TOKENS = TokenConfig(secret_key=b"test-key-not-for-production-use!", salt=b"test-salt-16byte")
DEID = DeidConfig(shift_secret="test-shift-secret")

# FIXED VALUES: known names whose hits the expected results hold
KNOWN_NAMES = [
    "Fatima Abdullah Al-Rashid",
    "Fatima Al-Rashid",
    "Mrs. Al-Rashid",
    "Al-Rashid, Fatima",
    "Mohammed Al-Rashid",
    "Dr. Khalid Al-Habib",
    "Khalid Al-Habib",
    "Dr. Ahmed Al-Zahrani",
    "Ahmed Al-Zahrani",
    "Dr. Omar Al-Qahtani",
    "Omar Al-Qahtani",
]
