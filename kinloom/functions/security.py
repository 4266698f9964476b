"""Output protection: masks, escaping and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: Keys whose contents never leave.
SENSITIVE_KEYS = ("hkid", "hkid_num", "government_id", "identifier", "id_value")
REDACTED = "[REDACTED]"


def mask_identifier(c: Column, visible: int = 3) -> Column:
    """Stars, at least four, before the last ``visible`` characters (the last one of a short value); blank stays blank."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    kept = F.when(F.length(raw) > visible, F.lit(visible)).otherwise(F.lit(1))
    return F.when(raw == "", "").otherwise(F.concat(F.repeat(F.lit("*"), F.greatest(F.lit(4), F.length(raw) - kept)), F.right(raw, kept)))


def safe_html(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def _redacted(c: Column, kind, key: str) -> Column:
    if key.lower() in SENSITIVE_KEYS:
        return F.lit(REDACTED)
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(_redacted(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _redacted(x, kind.elementType, key))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), F.lit(REDACTED)).otherwise(v))
    return c


def redact(df: DataFrame) -> DataFrame:
    """Contents under a sensitive key, at any depth of structs, arrays and maps of text, are replaced."""
    return df.select(*(_redacted(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields))
