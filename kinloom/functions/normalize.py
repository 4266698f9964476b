"""Normalisation of identity attributes as Column expressions.

A missing or unusable value is null.  All functions are null-safe and accept any
text length.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinloom.functions.characters import simplified_table, width_fold

#: Characters for which NFKC changes nothing: most values never reach Python.
_STABLE = r"^[\x{20}-\x{7E}\x{C0}-\x{FF}\x{4E00}-\x{9FFF}]*$"


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return pc.utf8_normalize(values, form="NFKC")


@F.arrow_udf(StringType())
def _fold_case(values: pa.Array) -> pa.Array:
    def fold(s):
        flat = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s).casefold())
        return "".join(c for c in flat if not unicodedata.combining(c))

    return pa.array([None if s is None else fold(s) for s in values.to_pylist()], pa.string())


def null_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text(c: Column) -> Column:
    """NFKC and stripped; null when nothing is left."""
    odd = F.when(~c.rlike(_STABLE), c)
    return null_if_blank(strip(F.coalesce(_nfkc(odd), c)))


def simplified(spark: SparkSession, c: Column) -> Column:
    return F.translate(c, *simplified_table(spark))


def chinese_compact(spark: SparkSession, c: Column) -> Column:
    """Simplified, letters and digits only."""
    return null_if_blank(F.regexp_replace(simplified(spark, text(c)), r"[^\p{L}\p{N}]+", ""))


def english_words(c: Column) -> Column:
    """Case-folded, without accents, words of ASCII letters and digits parted by one space."""
    ascii_only = F.lower(c)
    odd = F.when(c.rlike(r"[^\x{0}-\x{7F}]"), c)
    folded = F.coalesce(_fold_case(odd), ascii_only)
    return null_if_blank(F.trim(F.regexp_replace(folded, "[^0-9a-z]+", " ")))


def english_compact(c: Column) -> Column:
    return F.replace(english_words(c), F.lit(" "), F.lit(""))


def initials(words: Column) -> Column:
    """First characters of space-parted words."""
    return F.array_join(F.transform(F.split(words, " "), lambda w: F.left(w, F.lit(1))), "")


def beyond_ascii(c: Column) -> Column:
    """Whether a text takes more bytes than characters."""
    return F.octet_length(c) > F.length(c)


def fold_width(c: Column) -> Column:
    """Full-width ASCII in its plain form; plain text, nearly all there is, is left alone."""
    return F.when(beyond_ascii(c), F.translate(c, *width_fold())).otherwise(c)


def phone(c: Column) -> Column:
    """Digits without the country prefix 00852, or 852 when more than eight digits."""
    digits = F.regexp_replace(fold_width(c), "[^0-9]", "")
    local = (
        F.when(digits.startswith("00852"), F.substring(digits, 6, 1000))
        .when(digits.startswith("852") & (F.length(digits) > 8), F.substring(digits, 4, 1000))
        .otherwise(digits)
    )
    return null_if_blank(local)


def email(c: Column) -> Column:
    """Lower case; one @, something before it, a dot after it."""
    v = F.lower(F.trim(fold_width(c)))
    return F.when(v.rlike(r"^[^@]+@[^@]*\.[^@]*$"), v)


def birthday_date(c: Column) -> Column:
    """A real date from the first ten characters in one of five formats, else null.

    The formats: year-month-day and day-month-year with hyphens or slashes, and
    yyyymmdd without separators; months and days may lack the leading zero.
    """
    s = F.left(F.trim(fold_width(c)), F.lit(10))
    bare = r"^(\d{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12]\d|0[1-9]|[1-9])$"
    iso = (
        F.when(s.rlike(r"^\d{4}([-/])\d{1,2}\1\d{1,2}$"), F.translate(s, "/", "-"))
        .when(s.rlike(r"^\d{1,2}([-/])\d{1,2}\1\d{4}$"), F.regexp_replace(s, r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$", "$3-$2-$1"))
        .when(s.rlike(bare), F.regexp_replace(s, bare, "$1-$2-$3"))
    )
    return iso.try_cast("date")


def birthday(c: Column) -> Column:
    """ISO text of :func:`birthday_date`."""
    return birthday_date(c).cast("string")


def identifier(c: Column) -> Column:
    """Upper-case letters and digits only."""
    return null_if_blank(F.regexp_replace(F.upper(fold_width(c)), "[^0-9A-Z]+", ""))


def valid_hkid(c: Column) -> Column:
    """Structure and check digit of a Hong Kong identity number; false when missing."""
    v = identifier(c)
    shape = v.rlike(r"^[A-Z]{1,2}\d{6}[0-9A]$")
    one = F.length(v) == 8
    padded = F.when(one, F.concat(F.lit(" "), v)).otherwise(v)

    def at(i: int) -> Column:
        return F.ascii(F.substring(padded, i, 1))

    total = F.when(one, 36 * 9).otherwise((at(1) - 55) * 9) + (at(2) - 55) * 8
    for i, weight in zip(range(3, 9), range(7, 1, -1), strict=True):
        total = total + (at(i) - 48) * weight
    total = total + F.when(F.substring(padded, 9, 1) == "A", 10).otherwise(at(9) - 48)
    return F.coalesce(shape & (total % 11 == 0), F.lit(False))
