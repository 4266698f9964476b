"""Problem 6: text that looks the same but differs in its characters.

A quick check on code-point properties (a character class, evaluated in the JVM)
tells which values hold only characters that are what they show; those pass
through unchanged.  In the others only the unstable segments - each with the
starter before it, which a combining mark may join - are normalised and spliced
back into the text around them.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinloom.functions.characters import (
    APOSTROPHES,
    DASHES,
    INVISIBLE_RANGES,
    han_lookalikes,
    lookalikes,
    ordinary_class,
)

_UNSTABLE = "[^" + ordinary_class() + "]"
_PY_UNSTABLE = regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\U{int(m[1], 16):08x}", _UNSTABLE)
#: An unstable run with its boundary context: the starter before it, and what is ordinary between runs of one word.
_SEGMENT = regex.compile(rf".?{_PY_UNSTABLE}+", regex.DOTALL)
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_INVISIBLE = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE_RANGES) + "]")
_SPACES = regex.compile(r"[\p{Zs}\t\n\r\v\f\u0085\u2028\u2029]")
_PUNCT = {ord(c): "-" for c in DASHES} | {ord(c): "'" for c in APOSTROPHES}
_HAN = regex.compile(r"\p{Han}")
_FOREIGN = regex.compile(r"[\p{L}--[\p{Latin}\p{Han}]]", regex.V1)


def is_unstable(c: Column) -> Column:
    """Quick check: some character is not an ordinary one; null stays null."""
    return c.rlike(_UNSTABLE)


def _normal_segment(segment: str) -> str:
    """Compatibility forms, spaces, dashes and invisible characters of one segment, composed again."""
    flat = _INVISIBLE.sub("", segment)
    flat = unicodedata.normalize("NFKC", flat)
    return _SPACES.sub(" ", flat.translate(_PUNCT))


def _latin_word(word: str) -> str:
    """Look-alike letters to Latin, if every letter of another script in the word is one."""
    alike = lookalikes()
    if any(c in alike for c in word) and all(c in alike for c in _FOREIGN.findall(word)):
        return unicodedata.normalize("NFC", "".join(alike.get(c, c) for c in word))
    return word


def canonical(value: str) -> str:
    """One consistent form of ``value``: NFKC, nothing invisible, plain spaces and hyphens, no look-alikes.

    Words wholly of another script's own letters stay.  Case, misspelling, plain
    spaces and Traditional against Simplified are left alone.
    """
    out = _INVISIBLE.sub("", value) if _INVISIBLE.search(value) else value
    out = _SEGMENT.sub(lambda m: _normal_segment(m[0]), out)
    if _FOREIGN.search(out) or any(c in lookalikes() for c in out):
        out = _WORD.sub(lambda m: _latin_word(m[0]), out)
    if _HAN.search(out) and not regex.search(r"[\p{Hiragana}]", out):
        table = han_lookalikes()
        if all(c in table or _HAN.match(c) or not c.isalpha() for c in out):
            out = "".join(table.get(c, c) for c in out)
    return out


@F.arrow_udf(StringType())
def _canonical(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else canonical(v) for v in values.to_pylist()], pa.string())


def canonical_text(c: Column) -> Column:
    """Canonical form; only values that fail the quick check reach Python.  Null stays null, empty stays empty."""
    return F.coalesce(_canonical(F.when(is_unstable(c), c)), c)


def values_not_ordinary(df: DataFrame, record_id: str, fields: list[str]) -> DataFrame:
    """(record_id, field) of stored values that the canonical form changes.

    Null and empty values are no cases; repeated rows come out as often as they
    stand; further columns are ignored.
    """
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))
    long = df.select(F.col(record_id).alias("record_id"), F.explode(F.filter(pairs, lambda p: is_unstable(p["value"]))).alias("p"))
    long = long.select("record_id", "p.field", "p.value")
    return long.filter(_canonical("value") != F.col("value")).select("record_id", "field")
