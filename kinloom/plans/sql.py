"""Building blocks of the checking SQL (DuckDB)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import SparkSession

from kinloom.functions.characters import simplified_table

_FOLDED = [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, *range(0x2E80, 0x2FD6), 0x3000, *range(0xF900, 0xFB00), *range(0xFF01, 0xFF5F)]
_NFKC = [(chr(c), f) for c in _FOLDED if len(f := unicodedata.normalize("NFKC", chr(c))) == 1 and f != chr(c)]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def nfkc(x: str) -> str:
    return f"nfc_normalize(translate({x}, {_quoted(''.join(a for a, _ in _NFKC))}, {_quoted(''.join(b for _, b in _NFKC))}))"


def text(x: str) -> str:
    return f"nullif(regexp_replace({nfkc(x)}, '^\\s+|\\s+$', '', 'g'), '')"


def has_simplified() -> bool:
    return SparkSession.getActiveSession() is not None


def chinese(x: str) -> str:
    table = simplified_table(SparkSession.getActiveSession())
    return f"nullif(regexp_replace(translate({text(x)}, {_quoted(table[0])}, {_quoted(table[1])}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"


def words(x: str) -> str:
    marks = "".join(chr(c) for c in (0x34F, *range(0xFE00, 0xFE10)))
    return f"nullif(trim(regexp_replace(strip_accents(lower({nfkc(f'translate({x}, {_quoted(marks)}, {_quoted(chr(32) * len(marks))})')})), '[^0-9a-z]+', ' ', 'g')), '')"


def phone(x: str) -> str:
    d = f"regexp_replace({nfkc(x)}, '[^0-9]', '', 'g')"
    return f"nullif(CASE WHEN starts_with({d}, '00852') THEN substr({d}, 6) WHEN starts_with({d}, '852') AND length({d}) > 8 THEN substr({d}, 4) ELSE {d} END, '')"


def email(x: str) -> str:
    v = f"lower(trim({nfkc(x)}))"
    return f"CASE WHEN regexp_full_match({v}, '[^@]+@[^@]*\\.[^@]*') THEN {v} END"


def birthday(x: str) -> str:
    b = f"left(trim({x}), 10)"
    return (
        f"CASE WHEN regexp_full_match({b}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN strftime(try_strptime({b}, '%Y-%m-%d'), '%Y-%m-%d')"
        f" WHEN regexp_full_match({b}, '\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') THEN strftime(try_strptime({b}, '%Y/%m/%d'), '%Y-%m-%d')"
        f" WHEN regexp_full_match({b}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN strftime(try_strptime({b}, '%d/%m/%Y'), '%Y-%m-%d')"
        f" WHEN regexp_full_match({b}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') THEN strftime(try_strptime({b}, '%d-%m-%Y'), '%Y-%m-%d')"
        f" WHEN regexp_full_match({b}, '\\d{{8}}') THEN strftime(try_strptime({b}, '%Y%m%d'), '%Y-%m-%d') END"
    )


def identifier(x: str) -> str:
    return f"nullif(regexp_replace(upper({nfkc(x)}), '[^0-9A-Z]+', '', 'g'), '')"


def initials(words_column: str) -> str:
    return f"array_to_string(list_transform(string_split({words_column}, ' '), lambda w: left(w, 1)), '')"


def person() -> str:
    """CTE ``person``: canonical records of ccd_master under the registrations' scopes."""
    return f"""
scoped AS (SELECT source FROM ccd_registration WHERE lower(identifier_scope) = 'global'),
base AS (
  SELECT record_id, nullif(source, '') AS source, modified AS source_modified, ccd_source_key,
         {chinese("nullif(chi_surname, '')")} AS chi_surname, {chinese("nullif(chi_firstname, '')")} AS chi_firstname,
         {words("nullif(eng_surname, '')")} AS eng_surname, {words("nullif(eng_firstname, '')")} AS eng_firstname,
         {phone("nullif(phone_num, '')")} AS phone, {email("nullif(email, '')")} AS email, {birthday("nullif(birthday, '')")} AS birthday,
         {identifier("nullif(hksr_num, '')")} AS hksr_num, {identifier("nullif(hkid, '')")} AS hkid,
         source IS NOT NULL AND source IN (SELECT source FROM scoped) AS comparable
  FROM ccd_master
),
person AS (
  SELECT * EXCLUDE (comparable), comparable, CASE WHEN comparable AND hkid IS NOT NULL THEN 'hkid:' || hkid END AS global_id,
         nullif(coalesce(chi_surname, '') || coalesce(chi_firstname, ''), '') AS chi_full,
         nullif(concat_ws(' ', eng_surname, eng_firstname), '') AS eng_full,
         left(replace(eng_firstname, ' ', ''), 2) AS eng_given_prefix,
         coalesce(chi_surname, replace(eng_surname, ' ', '')) AS surname_key,
         {initials("eng_firstname")} AS eng_initials
  FROM base
)"""


def exact_pairs(max_block: int) -> str:
    """CTEs ``person``, ``keys``, ``allowed``, ``pairs``: candidate pairs over the routes that need no reading of characters."""
    return f"""{person()},
keys AS (
  SELECT DISTINCT * FROM (
    SELECT record_id, source, 'global_id' AS route, 'global_id:hkid:' || hkid AS key FROM person WHERE comparable
    UNION ALL SELECT record_id, source, 'unverified_id', 'unverified_id:hkid:' || hkid FROM person WHERE NOT comparable
    UNION ALL SELECT record_id, source, 'unverified_id', 'unverified_id:hksr_num:' || hksr_num FROM person
    UNION ALL SELECT record_id, source, 'phone', 'phone:' || phone FROM person
    UNION ALL SELECT record_id, source, 'email', 'email:' || email FROM person
    UNION ALL SELECT record_id, source, 'chi_full', 'chi_full:' || chi_full FROM person
    UNION ALL SELECT record_id, source, 'eng_name', 'eng_name:' || replace(eng_surname, ' ', '') || ':' || eng_given_prefix FROM person
    UNION ALL SELECT record_id, source, 'dob_surname', 'dob_surname:' || birthday || ':' || surname_key FROM person
  ) WHERE key IS NOT NULL AND source IS NOT NULL AND record_id IS NOT NULL
),
sizes AS (SELECT route, key, count(DISTINCT record_id) AS n FROM keys GROUP BY route, key),
kept AS (SELECT k.* FROM keys k JOIN sizes s ON s.route = k.route AND s.key = k.key AND s.n BETWEEN 2 AND {max_block}),
pairs AS (
  SELECT l.record_id AS left_id, r.record_id AS right_id, l.source AS left_source, r.source AS right_source,
         list_sort(list(DISTINCT l.route)) AS routes
  FROM kept l JOIN kept r ON l.route = r.route AND l.key = r.key AND l.record_id < r.record_id AND l.source <> r.source
  GROUP BY ALL
)"""
