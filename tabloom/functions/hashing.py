"""Reproducible pseudo-random choices from a row key.

Every random decision is a function of ``md5(key || ':' || seed)``, so neither
partitioning nor a retried task can change a result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 15 hex digits are 60 bits: positive in a signed 64-bit integer.
_HEX_DIGITS = 15
_SCALE = float(16**_HEX_DIGITS)


def hash_text(key: str | Column, seed: int | str) -> Column:
    """md5 hex text of ``key:seed``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def hash_long(text: Column) -> Column:
    """First 60 bits of a hex digest as a non-negative long."""
    return F.conv(F.substring(text, 1, _HEX_DIGITS), 16, 10).cast("bigint")


def hash_unit(text: Column) -> Column:
    """A hex digest as a number in [0, 1)."""
    return hash_long(text) / F.lit(_SCALE)


def hash_cell(text: Column, digits: int) -> Column:
    """Leading hex digits as an integer; orders like the text itself."""
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("bigint")


def _is_low(buckets: int) -> bool:
    """Whether the last seven hex digits alone decide: a power of two that divides 16 ** 7."""
    return buckets & (buckets - 1) == 0 and buckets <= 1 << 28


def md5_bucket(value: Column, buckets: int) -> Column:
    """md5 of the text, read as one number, modulo any count of buckets below 2^31."""
    if not 0 < buckets < 1 << 31:
        raise ValueError("buckets must be between 1 and 2^31 - 1")
    digest, rest = F.md5(value), F.lit(0).cast("bigint")
    if _is_low(buckets):
        return (F.conv(F.substring(digest, 26, 7), 16, 10).cast("bigint") % buckets).cast("int")
    # the remainder is folded through the 32 digits, 28 bits at a time
    for first, digits in ((1, 4), (5, 7), (12, 7), (19, 7), (26, 7)):
        part = F.conv(F.substring(digest, first, digits), 16, 10).cast("bigint")
        rest = (rest * (1 << 4 * digits) + part) % buckets
    return rest.cast("int")


def md5_bucket_sql(value: str, buckets: int) -> str:
    """``md5_bucket`` as an expression that fitted stages can keep."""
    if not 0 < buckets < 1 << 31:
        raise ValueError("buckets must be between 1 and 2^31 - 1")
    if _is_low(buckets):
        return f"(CAST(conv(substring(md5({value}), 26, 7), 16, 10) AS BIGINT) % {buckets}L)"
    rest = "0L"
    for first, digits in ((1, 4), (5, 7), (12, 7), (19, 7), (26, 7)):
        part = f"CAST(conv(substring(md5({value}), {first}, {digits}), 16, 10) AS BIGINT)"
        rest = f"(({rest} * {1 << 4 * digits}L + {part}) % {buckets}L)"
    return rest
