"""Keyed and plain hashes: patient tokens, per-patient date shifts, hashed record ids."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinspan.config import DeidConfig, TokenConfig

_BLOCK = 64


def hmac_sha256_hex(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 out of two ``sha2`` calls; the two key pads are computed once on the driver."""
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(_BLOCK, b"\0")
    inner_pad = bytes(b ^ 0x36 for b in padded)
    outer_pad = bytes(b ^ 0x5C for b in padded)
    inner = F.sha2(F.concat(F.lit(inner_pad), message), 256)
    return F.sha2(F.concat(F.lit(outer_pad), F.unhex(inner)), 256)


def patient_token(key_text: Column, config: TokenConfig) -> Column:
    message = key_text.cast("binary")
    if config.use_salt:
        message = F.concat(F.lit(config.salt), message)
    digest = hmac_sha256_hex(message, config.secret_key)
    return F.concat(F.lit("PT-"), F.upper(F.substring(digest, 1, 16)))


def shift_days(key: Column, config: DeidConfig) -> Column:
    """Days by which all dates of one key move: constant per key, spread over the range."""
    low, high = config.date_shift_range
    digest = F.sha2(F.concat(F.lit(config.shift_secret), key), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return (F.pmod(number, F.lit(high - low + 1)) + low).cast("int")


def shift_datetime(value: Column, days: Column) -> Column:
    return value + F.make_dt_interval(days)


def hashed_id(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 12)
