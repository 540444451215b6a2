"""Number and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(value: Column, low: float, high: float) -> Column:
    """`value` kept within bounds; null and not-a-number become the lower bound."""
    number = F.when(F.isnan(value), None).otherwise(value)
    return F.least(F.greatest(F.coalesce(number, F.lit(low)), F.lit(low)), F.lit(high))


def fixed(value: Column, places: int = 2) -> Column:
    """`value` rounded by its exact binary value, halves away from zero, as a double.

    The number format rounds the exact value with halves to even; exact halves are the odd
    multiples of a power of two and are rounded here.
    """
    size = F.abs(value)
    eighths = size * 2 ** (places + 1)
    half = (eighths == F.floor(eighths)) & (F.floor(eighths) % 2 == 1)
    nearest = F.call_function("format_number", size, F.lit("0." + "0" * places)).cast("double")
    whole = F.when(half, (F.floor(size * 10**places) + 1) / 10**places).otherwise(nearest)
    return F.when(value < 0, -whole).otherwise(whole)


def polynomial_hash(text: Column) -> Column:
    """The absolute value of the base-31 hash of `text` in signed 32-bit steps.

    Each step multiplies in 32 bits and adds the code of a character without wrapping; of
    a character outside the basic plane the first half of its pair counts.
    """
    code = lambda c: F.when(F.ascii(c) > 0xFFFF, F.lit(0xD800) + F.shiftright(F.ascii(c) - 0x10000, 10)).otherwise(F.ascii(c))
    step = lambda h, c: F.pmod(h * 31 + (1 << 31), F.lit(1 << 32)) - (1 << 31) + code(c)
    return F.abs(F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise(step(h, c))))


def isbn13_valid(code: Column) -> Column:
    """True for thirteen digits whose check digit fits."""
    bare = F.regexp_replace(code, "[^0-9]", "")
    total = F.lit(0)
    for k in range(13):
        total = total + F.substring(bare, k + 1, 1).try_cast("int") * (3 if k % 2 else 1)
    return F.coalesce((F.length(bare) == 13) & (total % 10 == 0), F.lit(False))


def _ten_sum(bare: Column, places: int) -> Column:
    total = F.lit(0)
    for k in range(places):
        sign = F.substring(bare, k + 1, 1)
        total = total + F.when(sign == "X", 10).otherwise(sign.try_cast("int")) * (10 - k)
    return total


def isbn10_valid(code: Column) -> Column:
    """True for nine digits and a check digit or X that fits."""
    bare = F.regexp_replace(F.upper(code), "[^0-9X]", "")
    return F.coalesce(bare.rlike("^[0-9]{9}[0-9X]$") & (_ten_sum(bare, 10) % 11 == 0), F.lit(False))


def isbn10_of(nine: Column) -> Column:
    """The ten-digit number of nine book digits."""
    check = (11 - _ten_sum(nine, 9) % 11) % 11
    return F.concat(nine, F.when(check == 10, "X").otherwise(check.cast("string")))


def isbn13_of(nine: Column) -> Column:
    """The thirteen-digit number of nine book digits, with prefix 978 and check digit."""
    body = F.concat(F.lit("978"), nine)
    total = F.lit(0)
    for k in range(12):
        total = total + F.substring(body, k + 1, 1).try_cast("int") * (3 if k % 2 else 1)
    return F.concat(body, ((F.lit(10) - total % 10) % 10).cast("string"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """`prefix:` and 24 hexadecimal digits of the hash of all parts, nulls as nothing."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(joined, 256), 1, 24))
