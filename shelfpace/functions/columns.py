"""Column expressions shared by the operators. All are safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label for missing numbers in the sentinel form, offset inside the logarithm.
MISSING = -1.0
LOG_OFFSET = 0.001


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is zero."""
    return F.try_divide(numerator, denominator)


def selling_rate(sold: Column, minutes: Column) -> Column:
    """Units per active minute; 0 without active minutes."""
    return F.when(minutes > 0, F.try_divide(sold, minutes)).otherwise(F.lit(0.0))


def activity_flag(minutes: Column) -> Column:
    return F.when(minutes > 0, 1).otherwise(0)


def domain_name(raw: Column) -> Column:
    """Text after the last hyphen (all of it when there is none)."""
    return F.regexp_replace(raw, "^.*-", "")


def missing_to_null(value: Column) -> Column:
    return F.when((value != MISSING) & ~F.isnan(value), value)


def log_stock(value: Column) -> Column:
    """ln(value + 0.001); null for missing, NaN and values outside the logarithm's domain."""
    known = missing_to_null(value)
    return F.when(known + LOG_OFFSET > 0, F.ln(known + LOG_OFFSET))


def hash_text(key: Column, seed: int) -> Column:
    """Hex digest of key and seed: the same on every run, engine and partitioning."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def in_hash_share(key: Column, share: float, seed: int) -> Column:
    """True for about ``share`` of all keys; every row of a key gets the same answer."""
    if share >= 1.0:
        return F.lit(True)
    limit = f"{max(0, round(share * 2**32)):08x}"
    return F.substring(hash_text(key, seed), 1, 8) < F.lit(limit)
