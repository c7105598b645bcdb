"""Column functions over text: lenient integers, user numbers, gender codes, hash keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: user names are five letters of prefix, then digits.
USER_PREFIX_LENGTH = 5

_UNSIGNED_32_BITS = 0xFFFFFFFF
_UNSIGNED_31_BITS = 0x7FFFFFFF


def integer_or_zero(text: Column) -> Column:
    """An optionally signed run of digits as an int; anything else, also overflow, is 0."""
    digits = text.rlike(r"^[+-]?[0-9]+$")
    return F.when(digits, F.coalesce(text.try_cast("int"), F.lit(0))).otherwise(F.lit(0))


def user_number(user: Column) -> Column:
    """``user_000123`` -> 123, so shorter and longer spellings of a number are one user."""
    return integer_or_zero(F.substr(user, F.lit(USER_PREFIX_LENGTH + 1)))


def gender_code(gender: Column) -> Column:
    """m -> 1, f -> 2 in any case; anything else, also NULL, -> 0."""
    letter = F.lower(gender)
    return F.when(letter == "m", F.lit(1)).when(letter == "f", F.lit(2)).otherwise(F.lit(0))


def hash_key31(text: Column) -> Column:
    """Java's ``String.hashCode`` without its sign bit: over UTF-16 code units.

    A letter beyond the Basic Multilingual Plane counts as its two surrogates. Distinct texts
    may collide, so this is a numeric feature and never a join key.
    """

    def folded(key: Column, unit: Column) -> Column:
        return (key * 31 + unit).bitwiseAND(F.lit(_UNSIGNED_32_BITS))

    def letter(key: Column, point: Column) -> Column:
        beyond = point - 0x10000
        high = F.shiftright(beyond, 10) + 0xD800
        low = beyond.bitwiseAND(F.lit(0x3FF)) + 0xDC00
        return F.when(point < 0x10000, folded(key, point)).otherwise(folded(folded(key, high), low))

    start = F.lit(0).cast("long")
    key = F.aggregate(F.split(text, ""), start, lambda so_far, one: letter(so_far, F.ascii(one)))
    return key.bitwiseAND(F.lit(_UNSIGNED_31_BITS)).cast("int")
