"""The per-source formula language, compiled to Columns.

    formula := arithmetic [comparison number]      default comparison: > 0.5
    macro   := @ChineseMatch(x) | @EnglishMatch(x) | @PhoneMatch(x) | @IDMatch(x)
    x       := f"{field} {field}" | "field" | field

A small recursive-descent parser on the driver builds the Column tree; no text is
ever evaluated.  What normalising a record needs is a projection below the join,
so it happens once per record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinloom.functions.characters import pinyin_table
from kinloom.functions.normalize import simplified
from kinloom.functions.security import safe_html
from kinloom.functions.strings import column, indel_ratio, token_set_ratio, token_sort_ratio

MACROS = ("ChineseMatch", "EnglishMatch", "PhoneMatch", "IDMatch")
_LEXEME = re.compile(r'\s*(?:(@\w+)\s*\(\s*(f?"[^"]*"|f?\'[^\']*\'|\w+)\s*\)|(\d+\.?\d*|\.\d+)|(>=|<=|!=|==|>|<)|([-+*/()]))')


@dataclass(frozen=True)
class Slot:
    """One macro call: its fields with the literal text around them."""

    macro: str
    argument: str
    parts: tuple[tuple[str, str], ...]  # ("text" or "field", value)

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(v for kind, v in self.parts if kind == "field")


@dataclass(frozen=True)
class Formula:
    text: str
    slots: tuple[Slot, ...]
    tree: tuple
    comparison: str
    threshold: float

    def chinese_fields(self) -> list[str]:
        return [f for s in self.slots if s.macro == "ChineseMatch" for f in s.fields]

    def english_fields(self) -> list[str]:
        return [f for s in self.slots if s.macro == "EnglishMatch" for f in s.fields]


def _argument(raw: str) -> tuple[tuple[str, str], ...]:
    template = raw.startswith(("f'", 'f"'))
    body = (raw[1:] if template else raw).strip("\"'")
    if not template or not re.search(r"\{\w+\}", body):
        return (("field", body),)
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", body):
        if m.start() > at:
            parts.append(("text", body[at : m.start()]))
        parts.append(("field", m[1]))
        at = m.end()
    if at < len(body):
        parts.append(("text", body[at:]))
    return tuple(parts)


def _lexemes(text: str) -> Iterator[tuple[str, str, str]]:
    at = 0
    while text[at:].strip():
        m = _LEXEME.match(text, at)
        if not m:
            raise ValueError(f"formula: cannot read {text[at : at + 20]!r}")
        at = m.end()
        if m[1]:
            if m[1][1:] not in MACROS:
                raise ValueError(f"formula: no such macro: {m[1]}")
            yield "macro", m[1][1:], m[2]
        elif m[3]:
            yield "number", m[3], ""
        elif m[4]:
            yield "comparison", m[4], ""
        else:
            yield "operator", m[5], ""


def parse(text: str) -> Formula:
    """Raises ValueError on anything outside the grammar."""
    items = list(_lexemes(text))
    slots: list[Slot] = []
    at = 0

    def peek() -> tuple[str, str, str]:
        return items[at] if at < len(items) else ("end", "", "")

    def take() -> tuple[str, str, str]:
        nonlocal at
        at += 1
        return items[at - 1]

    def factor():
        kind, value, argument = peek()
        if kind == "operator" and value in "+-":
            take()
            return ("sign", value, factor())
        if kind == "operator" and value == "(":
            take()
            inner = total()
            if peek()[:2] != ("operator", ")"):
                raise ValueError("formula: a parenthesis is not closed")
            take()
            return inner
        if kind == "number":
            take()
            return ("number", float(value))
        if kind == "macro":
            take()
            slots.append(Slot(value, argument, _argument(argument)))
            return ("slot", len(slots) - 1)
        raise ValueError("formula: a value is missing")

    def product():
        left = factor()
        while peek()[0] == "operator" and peek()[1] in "*/":
            left = (take()[1], left, factor())
        return left

    def total():
        left = product()
        while peek()[0] == "operator" and peek()[1] in "+-":
            left = (take()[1], left, product())
        return left

    tree = total()
    comparison, threshold = ">", 0.5
    if peek()[0] == "comparison":
        comparison = take()[1]
        sign = -1.0 if peek()[:2] == ("operator", "-") else 1.0
        if sign < 0:
            take()
        if peek()[0] != "number":
            raise ValueError("formula: a comparison needs a number")
        threshold = sign * float(take()[1])
    if peek()[0] != "end":
        raise ValueError("formula: something follows its end")
    return Formula(text, tuple(slots), tree, comparison, threshold)


def legacy_phone(c: Column) -> Column:
    """``+CC number`` from (+CC), (CC) or 00CC in front; other numbers as they are.

    After 00 up to four digits are taken for the country code.
    """
    s = F.trim(c)
    return (
        F.when(s.rlike(r"^\+[0-9]"), s)
        .when(s.rlike(r"^\(\+[0-9]+\)"), F.concat(F.lit("+"), F.regexp_extract(s, r"^\(\+([0-9]+)\)\s*(.*)", 1), F.lit(" "), F.trim(F.regexp_extract(s, r"(?s)^\(\+([0-9]+)\)\s*(.*)", 2))))
        .when(s.rlike(r"^\([0-9]+\)"), F.concat(F.lit("+"), F.regexp_extract(s, r"^\(([0-9]+)\)\s*(.*)", 1), F.lit(" "), F.trim(F.regexp_extract(s, r"(?s)^\(([0-9]+)\)\s*(.*)", 2))))
        .when(s.rlike(r"^00[0-9]"), F.concat(F.lit("+"), F.regexp_extract(s, r"^00([0-9]{1,4})\s*(.*)", 1), F.lit(" "), F.trim(F.regexp_extract(s, r"(?s)^00([0-9]{1,4})\s*(.*)", 2))))
        .otherwise(s)
    )


def slot_text(slot: Slot, available: set[str]) -> Column:
    """The slot's text for a record; unknown and null fields are blank."""
    parts = [F.lit(v) if kind == "text" else (F.coalesce(F.col(v).cast("string"), F.lit("")) if v in available else F.lit("")) for kind, v in slot.parts]
    return F.trim(F.concat(*parts))


def prepare(df: DataFrame, formula: Formula) -> DataFrame:
    """``df`` with ``_f<i>`` (and ``_y<i>``, syllables) for every slot: what a record contributes, computed once."""
    spark = df.sparkSession
    available, out = set(df.columns), df
    for i, slot in enumerate(formula.slots):
        text = slot_text(slot, available)
        if slot.macro == "ChineseMatch":
            out = out.withColumn(f"_f{i}", simplified(spark, text))
            out = out.withColumn(f"_y{i}", syllables(spark)(F.col(f"_f{i}")))
        elif slot.macro == "EnglishMatch":
            out = out.withColumn(f"_f{i}", F.lower(text))
        elif slot.macro == "PhoneMatch":
            out = out.withColumn(f"_f{i}", legacy_phone(text))
        else:
            out = out.withColumn(f"_f{i}", F.regexp_replace(F.upper(text), r"[\s\-]", ""))
    return out


def syllables(spark: SparkSession):
    table = spark.sparkContext.broadcast(pinyin_table(spark))  # one entry for each ideograph of the basic block

    def run(values: pa.Array) -> pa.Array:
        own = table.value
        return pa.array([None if v is None else " ".join("".join(f" {own[ch]} " if ch in own else ch for ch in v).split()) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())


def _slot_score(slot: Slot, i: int, left: str, right: str) -> Column:
    a, b = F.col(f"{left}_f{i}"), F.col(f"{right}_f{i}")
    blank = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    if slot.macro == "IDMatch":
        return F.when(~blank & (a == b), 1.0).otherwise(0.0)
    if slot.macro == "EnglishMatch":
        score = column(token_set_ratio, a, b)
    elif slot.macro == "PhoneMatch":
        score = column(indel_ratio, a, b)
    else:
        ya, yb = F.col(f"{left}_y{i}"), F.col(f"{right}_y{i}")
        sounds = F.when((F.coalesce(ya, F.lit("")) != "") & (F.coalesce(yb, F.lit("")) != ""), column(token_sort_ratio, ya, yb)).otherwise(0.0)
        score = F.greatest(column(indel_ratio, a, b), sounds)
    return F.when(blank, 0.0).when(a == b, 1.0).otherwise(score)


def _arithmetic(node: tuple, scores: list[Column]) -> Column:
    kind = node[0]
    if kind == "number":
        return F.lit(node[1])
    if kind == "slot":
        return scores[node[1]]
    if kind == "sign":
        inner = _arithmetic(node[2], scores)
        return -inner if node[1] == "-" else inner
    a, b = _arithmetic(node[1], scores), _arithmetic(node[2], scores)
    return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else F.try_divide(a, b)


def slot_scores(formula: Formula, left: str = "l", right: str = "r") -> list[Column]:
    return [_slot_score(s, i, left, right) for i, s in enumerate(formula.slots)]


def evaluate(formula: Formula, scores: list[Column]) -> tuple[Column, Column]:
    """(score rounded to four places, whether it matches); a division by zero scores 0.0 and matches nothing."""
    raw = _arithmetic(formula.tree, scores)
    t = F.lit(formula.threshold)
    test = {">": raw > t, "<": raw < t, ">=": raw >= t, "<=": raw <= t, "==": raw == t, "!=": raw != t}[formula.comparison]
    return F.coalesce(F.round(raw, 4), F.lit(0.0)), F.coalesce(raw.isNotNull() & test, F.lit(False))


def audit_html(formula: Formula, scores: list[Column], score: Column, left: str = "l", right: str = "r") -> Column:
    """An HTML table of the slots with both values and scores, and the total; all values escaped."""
    rows = []
    for i, slot in enumerate(formula.slots):
        label = " ".join(slot.fields).replace("_", " ").title()
        percent = scores[i] * 100
        colour = F.when(percent >= 70, "green").when(percent >= 40, "orange").otherwise("red")
        rows.append(
            F.concat(
                F.lit("<tr><td>@"), F.lit(slot.macro), F.lit("</td><td>"), safe_html(F.lit(label)), F.lit("</td><td>"),
                safe_html(F.col(f"{left}_f{i}")), F.lit("</td><td>"), safe_html(F.col(f"{right}_f{i}")), F.lit('</td><td class="'), colour, F.lit('">'),
                F.format_string("%.2f%% (%.2f)", percent, scores[i]), F.lit("</td></tr>"),
            )
        )
    trail: list[Column] = []
    text = formula.text
    for i, slot in enumerate(formula.slots):
        before, _, text = text.partition(f"@{slot.macro}({slot.argument})")
        trail += [safe_html(F.lit(before)), F.format_string("%s", F.round(scores[i], 6))]
    trail.append(safe_html(F.lit(text)))
    return F.concat(F.lit("<table>"), *rows, F.lit("</table><code>"), *trail, F.lit("</code> = <b>"), F.format_string("%.3f", score), F.lit("</b>"))
