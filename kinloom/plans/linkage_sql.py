"""SQL of the record-linkage queries, where SQL can express them."""

from __future__ import annotations

from kinloom.plans import sql
from kinloom.plans.linkage import MAX_BLOCK, MAX_PAIRS, SAMPLE, SEED

_P = "ccd_match_evaluation_pair"
_PART = "CASE WHEN CAST('0x' || substr(sha256(name), 1, 8) AS BIGINT) % 5 < 3 THEN 'calibration' ELSE 'held_out' END"
_LABELLED = f"SELECT *, final_label = 'Same' AS y FROM {_P} WHERE final_label IN ('Same', 'Different')"
_BAND = "CASE WHEN baseline_score IS NULL THEN 'unavailable' WHEN baseline_score < 0.55 THEN 'lt_055' WHEN baseline_score < 0.65 THEN '055_065' WHEN baseline_score < 0.75 THEN '065_075' WHEN baseline_score < 0.85 THEN '075_085' ELSE 'gte_085' END"
_STRATUM = f"concat_ws('|', source_pair, {_BAND}, CASE WHEN baseline_tier = tiered_tier THEN 'models_agree' ELSE 'models_disagree' END, CASE WHEN tiered_tier = 'conflict_review' THEN 'id_conflict' ELSE 'no_id_conflict' END, replace(blocking_routes, ',', '+'))"
_SWEEP = """
d AS (SELECT score AS threshold, count(*) FILTER (WHERE y) AS a, count(*) FILTER (WHERE NOT y) AS b FROM s WHERE score IS NOT NULL GROUP BY score),
c AS (SELECT threshold, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER () AS ty, sum(b) OVER () AS ta FROM d WINDOW w AS (ORDER BY threshold DESC)),
r AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(ta - fp AS BIGINT) AS tn, CAST(ty - tp AS BIGINT) AS fn,
             coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(ty, 0), 0) AS recall FROM c),
points AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)
"""
_TIERS = (
    ("baseline_current_flag", "baseline_tier = 'review'"), ("tiered_gated_high", "tiered_tier = 'high'"), ("tiered_gated_review_queue", "tiered_tier IN ('high', 'review')"),
    ("tiered_recoverable_high", "recoverable_tier = 'high'"), ("hybrid_high", "hybrid_tier = 'high'"), ("hybrid_review_queue", "hybrid_tier IN ('high', 'review')"),
)
_HKID = "regexp_replace(upper(hkid), '[^0-9A-Z]+', '', 'g')"


def _tier_sql() -> str:
    one = "SELECT '{m}' AS model, '{part}' AS part, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND NOT y) AS tn, count(*) FILTER (WHERE NOT p AND y) AS fn FROM (SELECT y, coalesce({test}, false) AS p FROM l WHERE {where})"
    parts = [one.format(m=m, part=part, test=t, where=w) for m, t in _TIERS for part, w in (("all_labeled", "true"), ("held_out", f"{_PART} = 'held_out'"))]
    rates = "SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM u"
    return f"WITH l AS ({_LABELLED}), u AS ({' UNION ALL '.join(parts)}), v AS ({rates}) SELECT model, part, tp, fp, tn, fn, round(pr, 9) AS precision, round(re, 9) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 9) AS f1 FROM v"


def _wilson() -> str:
    z = 1.96
    return f"""
WITH g AS (SELECT source_pair, count(*) FILTER (WHERE final_label = 'Same') AS s, count(*) AS n FROM {_P} GROUP BY source_pair),
w AS (SELECT source_pair, (s / n + {z * z} / (2 * n)) / (1 + {z * z} / n) AS c,
             {z} * sqrt((s / n * (1 - s / n) + {z * z} / (4 * n)) / n) / (1 + {z * z} / n) AS r FROM g)
SELECT source_pair, round(greatest(0, c - r), 9) AS low, round(least(1, c + r), 9) AS high FROM w"""


def _plain() -> dict[str, str]:
    masked = "CASE WHEN trim(coalesce({x}, '')) = '' THEN '' ELSE repeat('*', greatest(4, length(trim({x})) - CASE WHEN length(trim({x})) > 3 THEN 3 ELSE 1 END)) || right(trim({x}), CASE WHEN length(trim({x})) > 3 THEN 3 ELSE 1 END) END"
    phone = "trim(coalesce(phone_num, ''))"
    names = ("chi_surname", "chi_firstname", "eng_surname", "eng_firstname", "phone_num", "email", "birthday", "hksr_num", "hkid")

    def shown(side: str, a: str) -> str:
        return masked.format(x=f"{side}.{a}") if a in ("hkid", "hksr_num") else f"coalesce({side}.{a}, '')"

    return {
        "q_hkid_valid": f"""
WITH v AS (SELECT record_id, {_HKID} AS v FROM ccd_master),
w AS (SELECT record_id, v, CASE WHEN length(v) = 8 THEN ' ' || v ELSE v END AS p FROM v)
SELECT record_id, coalesce(regexp_full_match(v, '[A-Z]{{1,2}}\\d{{6}}[0-9A]') AND (
  CASE WHEN length(v) = 8 THEN 324 ELSE (ascii(substr(p, 1, 1)) - 55) * 9 END + (ascii(substr(p, 2, 1)) - 55) * 8
  + {" + ".join(f"(ascii(substr(p, {i}, 1)) - 48) * {w}" for i, w in zip(range(3, 9), range(7, 1, -1), strict=True))}
  + CASE WHEN substr(p, 9, 1) = 'A' THEN 10 ELSE ascii(substr(p, 9, 1)) - 48 END) % 11 = 0, false) AS valid FROM w""",
        "q_legacy_phone_norm": f"""
SELECT record_id, CASE WHEN regexp_matches({phone}, '^\\+[0-9]') THEN {phone}
  WHEN regexp_matches({phone}, '^\\(\\+[0-9]+\\)') THEN '+' || regexp_extract({phone}, '^\\(\\+([0-9]+)\\)\\s*(.*)', 1) || ' ' || trim(regexp_extract({phone}, '^\\(\\+([0-9]+)\\)\\s*(.*)', 2))
  WHEN regexp_matches({phone}, '^\\([0-9]+\\)') THEN '+' || regexp_extract({phone}, '^\\(([0-9]+)\\)\\s*(.*)', 1) || ' ' || trim(regexp_extract({phone}, '^\\(([0-9]+)\\)\\s*(.*)', 2))
  WHEN regexp_matches({phone}, '^00[0-9]') THEN '+' || regexp_extract({phone}, '^00([0-9]{{1,4}})\\s*(.*)', 1) || ' ' || trim(regexp_extract({phone}, '^00([0-9]{{1,4}})\\s*(.*)', 2))
  ELSE {phone} END AS phone FROM ccd_master""",
        "q_mask_redact": f"SELECT record_id, {masked.format(x='hkid')} AS masked, '[REDACTED]' AS hkid FROM ccd_master",
        "q_html_escape": "SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM documents",
        "q_distinct_sources": "SELECT DISTINCT source FROM ccd_master WHERE coalesce(source, '') <> ''",
        "q_source_mapping": """
WITH nine(attribute, col, comparator) AS (VALUES ('chi_surname', 'chi_surname', 'Chinese Name'), ('chi_firstname', 'chi_firstname', 'Chinese Name'), ('eng_surname', 'eng_surname', 'English Name'),
  ('eng_firstname', 'eng_firstname', 'English Name'), ('phone', 'phone_num', 'Phone Exact'), ('email', 'email', 'Email Exact'), ('birthday', 'birthday', 'Birthday Exact'), ('hksr_num', 'hksr_num', 'Identifier Exact'), ('hkid', 'hkid', 'Identifier Exact')),
t AS (SELECT source, trim(split_part(coalesce(sys_fieldname, ''), ':', 1)) AS f FROM ccd_registration),
m AS (SELECT DISTINCT source, CASE f WHEN 'phone_num' THEN 'phone' WHEN 'mobile' THEN 'phone' WHEN 'res_phone' THEN 'phone' ELSE f END AS attribute,
        first_value(f) OVER (PARTITION BY source, CASE f WHEN 'phone_num' THEN 'phone' WHEN 'mobile' THEN 'phone' WHEN 'res_phone' THEN 'phone' ELSE f END ORDER BY CASE f WHEN 'mobile' THEN 1 WHEN 'res_phone' THEN 2 ELSE 0 END) AS f
      FROM t WHERE f IN ('chi_surname', 'chi_firstname', 'eng_surname', 'eng_firstname', 'phone_num', 'mobile', 'res_phone', 'email', 'birthday', 'hksr_num', 'hkid'))
SELECT s.source, n.attribute, coalesce(m.f, n.col) AS "column", n.comparator, 'Unknown' AS scope, 'Unverified' AS reliability, CAST(m.f IS NOT NULL AS INTEGER) AS enabled
FROM (SELECT DISTINCT source FROM ccd_registration) s CROSS JOIN nine n LEFT JOIN m ON m.source = s.source AND m.attribute = n.attribute""",
        "q_unregistered": "SELECT DISTINCT source FROM ccd_master WHERE coalesce(source, '') <> '' AND source NOT IN (SELECT source FROM ccd_registration WHERE coalesce(fuzzymachingscript, '') <> '')",
        "q_snapshot_scan": "SELECT record_id, source, modified FROM ccd_master WHERE source IN (SELECT source FROM ccd_registration) AND modified <= (SELECT max(snapshot_at) FROM ccd_match_evaluation_run WHERE status = 'Completed')",
        "q_latest_by_key": "SELECT source, ccd_source_key, arg_max(record_id, (modified, record_id)) AS record_id FROM ccd_master WHERE source IS NOT NULL GROUP BY source, ccd_source_key",
        "q_stored_strata": f"SELECT name, {_STRATUM} AS stratum FROM {_P}",
        "q_stratified_sample": f"""
WITH s AS (SELECT name, {_STRATUM} AS stratum, sha256('{SEED}:' || left_record || ':' || right_record) AS d FROM {_P}),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY d) AS rn FROM s)
SELECT name, stratum FROM r ORDER BY rn > 1, d LIMIT {SAMPLE}""",
        "q_double_review": f"SELECT name FROM {_P} ORDER BY sha256('double:{SEED}:' || left_record || ':' || right_record) LIMIT 100",
        "q_training_sample": f"""
WITH w AS (SELECT DISTINCT left_record AS record_id FROM {_P} WHERE review_status = 'Needs Adjudication'),
a AS (SELECT DISTINCT m.record_id FROM ccd_master m JOIN w USING (record_id)),
b AS (SELECT DISTINCT record_id FROM ccd_master WHERE record_id NOT IN (SELECT record_id FROM w)),
n AS (SELECT record_id, row_number() OVER (ORDER BY sha256(record_id)) AS rn FROM b)
SELECT record_id FROM a UNION ALL SELECT record_id FROM n WHERE rn <= greatest(0, 5000 - (SELECT count(*) FROM a))""",
        "q_partition": f"SELECT name, {_PART} AS part FROM {_P}",
        "q_threshold_sweep": f"WITH s AS (SELECT y, baseline_score AS score FROM ({_LABELLED})), {_SWEEP} SELECT threshold, tp, fp, tn, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM points",
        "q_thresholds": f"WITH s AS (SELECT y, baseline_score AS score FROM ({_LABELLED})), {_SWEEP} SELECT min(threshold) FILTER (WHERE precision >= 0.9 AND tp + fp >= 30) AS high_threshold, arg_max(threshold, (f1, recall, precision, -threshold)) AS review_threshold FROM points",
        "q_calibration": f"""
WITH l AS (SELECT name, y, probabilistic_score AS score, {_PART} AS part FROM ({_LABELLED}) WHERE probabilistic_available = 1 AND probabilistic_score IS NOT NULL),
s AS (SELECT * FROM l WHERE part = 'calibration'), {_SWEEP},
t AS (SELECT min(threshold) FILTER (WHERE precision >= 0.9 AND tp + fp >= 30) AS h, arg_max(threshold, (f1, recall, precision, -threshold)) AS rv FROM points),
k AS (SELECT count(*) FILTER (WHERE score >= (SELECT h FROM t)) AS n, count(*) FILTER (WHERE y AND score >= (SELECT h FROM t)) AS good FROM l WHERE part = 'held_out'),
o AS (SELECT coalesce(n >= 30 AND good / nullif(n, 0) >= 0.9, false) AS holds FROM k)
SELECT count(*) AS available_pairs, count(*) FILTER (WHERE part = 'calibration') AS calibration_pairs, count(*) FILTER (WHERE part = 'held_out') AS held_out_pairs,
       (SELECT CASE WHEN holds THEN h END FROM t, o) AS high_threshold, (SELECT rv FROM t) AS review_threshold, (SELECT CASE WHEN holds THEN NULL ELSE 'high_tier_disabled' END FROM o) AS warning FROM l""",
        "q_tier_metrics": _tier_sql(),
        "q_hybrid": f"SELECT name, CASE WHEN probabilistic_available IS DISTINCT FROM 1 OR probabilistic_score IS NULL OR tiered_tier = 'conflict_review' THEN tiered_tier WHEN probabilistic_score >= 0.8 AND tiered_tier <> 'low' THEN 'high' WHEN probabilistic_score >= 0.4 THEN 'review' ELSE 'low' END AS tier FROM {_P}",
        "q_kappa": f"""
WITH o AS (SELECT parent, label, row_number() OVER (PARTITION BY parent ORDER BY idx, submitted_at, reviewer, label) AS rn FROM ccd_match_review_label
           WHERE coalesce(is_adjudication, 0) <> 1 AND parent IN (SELECT name FROM {_P} WHERE needs_double_review = 1)),
p AS (SELECT parent, max(label) FILTER (WHERE rn = 1) AS a, max(label) FILTER (WHERE rn = 2) AS b FROM o GROUP BY parent HAVING max(rn) >= 2),
q AS (SELECT * FROM p WHERE coalesce(a, '') <> '' AND coalesce(b, '') <> ''),
e AS (SELECT sum(ca * cb) AS ab FROM (SELECT a AS c, count(*) AS ca FROM q GROUP BY a) x JOIN (SELECT b AS c, count(*) AS cb FROM q GROUP BY b) y USING (c)),
t AS (SELECT count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS o FROM q)
SELECT n, round(CASE WHEN ab / (n * n) < 1 THEN (o - ab / (n * n)) / (1 - ab / (n * n)) ELSE 1 END, 9) AS kappa FROM t, e""",
        "q_wilson": _wilson(),
        "q_review_state": f"""
WITH v AS (SELECT * FROM ccd_match_review_label WHERE label IN ('Same', 'Different', 'Unsure') AND parent IS NOT NULL),
o AS (SELECT parent, reviewer, arg_max(label, (submitted_at, idx, label)) AS label FROM v WHERE coalesce(is_adjudication, 0) <> 1 GROUP BY ALL),
c AS (SELECT parent, count(*) AS n, count(*) FILTER (WHERE label = 'Unsure') AS u, min(label) AS lo, max(label) AS hi FROM o GROUP BY parent),
a AS (SELECT parent, arg_max(label, (submitted_at, idx, label)) AS ruling FROM v WHERE is_adjudication = 1 AND label <> 'Unsure' GROUP BY parent),
s AS (SELECT p.name, coalesce(n, 0) AS n, lo, ruling, CASE WHEN coalesce(n, 0) = 0 THEN 'Unreviewed' WHEN u > 0 THEN 'Needs Adjudication' WHEN n < CASE WHEN needs_double_review = 1 THEN 2 ELSE 1 END THEN 'Partially Reviewed' WHEN lo = hi THEN 'Agreed' ELSE 'Needs Adjudication' END AS st
      FROM {_P} p LEFT JOIN c ON c.parent = p.name LEFT JOIN a ON a.parent = p.name)
SELECT name, n AS n_labels, CASE WHEN st = 'Needs Adjudication' AND ruling IS NOT NULL THEN 'Adjudicated' ELSE st END AS status,
       CASE WHEN st = 'Agreed' THEN lo WHEN st = 'Needs Adjudication' AND ruling IS NOT NULL THEN ruling END AS final_label FROM s""",
        "q_stale": f"SELECT p.name, NOT coalesce(l.modified = p.left_modified_at AND r.modified = p.right_modified_at, false) AS stale FROM {_P} p LEFT JOIN ccd_master l ON l.record_id = p.left_record LEFT JOIN ccd_master r ON r.record_id = p.right_record",
        "q_evidence_view": " UNION ALL ".join(f'SELECT p.name, \'{a}\' AS attribute, {shown("l", a)} AS "left", {shown("r", a)} AS "right" FROM {_P} p JOIN ccd_master l ON l.record_id = p.left_record JOIN ccd_master r ON r.record_id = p.right_record' for a in names),
        "q_components": f"""
WITH RECURSIVE e AS (SELECT left_record AS a, right_record AS b FROM {_P} WHERE tiered_tier = 'high' AND left_record <> right_record),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
reach(v, u) AS (SELECT a, b FROM b UNION SELECT reach.v, b.b FROM reach JOIN b ON b.a = reach.u)
SELECT v AS id, min(u) AS component FROM reach GROUP BY v""",
    }


def _canonical() -> dict[str, str]:
    person, pairs = sql.person(), sql.exact_pairs(MAX_BLOCK)
    attributes = ("chi_surname", "chi_firstname", "eng_surname", "eng_firstname", "phone", "email", "birthday", "hksr_num", "hkid")
    long = " UNION ALL ".join(f"SELECT coalesce(source, '') AS source, '{a}' AS attribute, {a} AS value FROM person" for a in attributes)
    valid = _plain()["q_hkid_valid"].replace("WITH v AS", "v AS", 1).replace("SELECT record_id, coalesce(regexp", ", ok AS (SELECT record_id, coalesce(regexp", 1).replace("AS valid FROM w", "AS valid FROM w)", 1)
    level = "CASE WHEN l.{a} IS NULL OR r.{a} IS NULL THEN 'missing' WHEN l.{a} = r.{a} THEN 'exact' ELSE 'disagree' END AS {a}"
    rank = " ".join(f"WHEN list_contains(routes, '{r}') THEN {i}" for i, r in enumerate(("global_id", "unverified_id", "phone", "email", "chi_full", "dob_surname", "eng_name")))
    projected = " UNION ALL ".join(f"SELECT '{r}' AS route, {r} AS value, source FROM person WHERE source IS NOT NULL AND {r} IS NOT NULL" for r in ("phone", "email", "chi_full"))
    names = f"{pairs}, n AS (SELECT DISTINCT l.eng_full AS a, r.eng_full AS b FROM pairs p JOIN person l ON l.record_id = p.left_id JOIN person r ON r.record_id = p.right_id WHERE l.eng_full IS NOT NULL AND r.eng_full IS NOT NULL)"
    jw = {"eng_full": (0.80, 0.88, 0.95), "birthday": (), "phone": (), "email": ()}

    def fs(name: str, thresholds: tuple) -> str:
        steps = "".join(f" WHEN jaro_winkler_similarity(l.{name}, r.{name}) >= {t} THEN {i + 1}" for i, t in reversed(list(enumerate(thresholds))))
        return f"CASE WHEN l.{name} IS NULL OR r.{name} IS NULL THEN -1 WHEN l.{name} = r.{name} THEN {len(thresholds) + 1}{steps} ELSE 0 END AS g_{name}"

    return {
        "q_person_canonical": f"WITH {person} SELECT * EXCLUDE (comparable) FROM person",
        "q_block_keys": f"WITH {pairs} SELECT record_id, source, route, key FROM keys",
        "q_block_sizes": f"WITH {pairs} SELECT route, count(*) AS n_blocks, max(n) AS largest, CAST(sum(n) AS BIGINT) AS n_keys FROM sizes GROUP BY route",
        "q_skipped_blocks": f"WITH {pairs} SELECT route, substr(sha256(key), 1, 12) AS digest, n FROM sizes WHERE n > {MAX_BLOCK}",
        "q_pairs_multi_route": f"WITH {pairs} SELECT left_id, right_id, array_to_string(routes, '+') AS routes FROM pairs",
        "q_pairs_capped": f"WITH {pairs} SELECT left_id, right_id, array_to_string(routes, '+') AS routes, (SELECT count(*) FROM pairs) >= {MAX_PAIRS} AS truncated FROM pairs ORDER BY CASE {rank} END, left_id, right_id LIMIT {MAX_PAIRS}",
        "q_projected_pairs": f"WITH {person}, k AS ({projected}), s AS (SELECT route, value, source, count(*) AS n FROM k GROUP BY ALL), g AS (SELECT route, value, CAST(sum(n) AS BIGINT) AS n_records, CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) AS n_pairs FROM s GROUP BY route, value) SELECT * FROM g WHERE n_pairs > 0",
        "q_profile": f"""
WITH {person}, {valid},
k AS (SELECT attribute, source, value, count(*) AS n FROM ({long}) GROUP BY ALL),
hk AS (SELECT coalesce(p.source, '') AS source, count(*) FILTER (WHERE ok.valid) AS nv FROM person p JOIN ok ON ok.record_id = p.record_id GROUP BY 1),
g AS (SELECT source, attribute, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0) AS BIGINT) AS present, count(*) FILTER (WHERE value IS NOT NULL) AS distinct_values,
             count(*) FILTER (WHERE value IS NOT NULL AND n > 1) AS duplicate_values, CAST(coalesce(sum(n) FILTER (WHERE value IS NOT NULL AND n > 1), 0) AS BIGINT) AS duplicate_rows FROM k GROUP BY source, attribute)
SELECT g.source, attribute, n_rows, present, round(present / n_rows, 6) AS coverage, distinct_values, duplicate_values, duplicate_rows,
       CASE WHEN attribute = 'hkid' THEN round(coalesce(nv / nullif(present, 0), 0), 6) END AS valid_rate FROM g JOIN hk ON hk.source = g.source""",
        "q_overlap": f"""
WITH {person}, k AS (SELECT DISTINCT source, attribute, value FROM ({long}) WHERE value IS NOT NULL),
x AS (SELECT l.attribute, l.source AS left_source, r.source AS right_source, count(*) AS shared FROM k l JOIN k r ON l.attribute = r.attribute AND l.value = r.value AND l.source < r.source GROUP BY ALL),
s AS (SELECT DISTINCT coalesce(source, '') AS source FROM person), a AS (SELECT unnest([{", ".join(f"'{a}'" for a in attributes)}]) AS attribute)
SELECT a.attribute, l.source AS left_source, r.source AS right_source, coalesce(x.shared, 0) AS shared FROM a CROSS JOIN s l JOIN s r ON l.source < r.source
LEFT JOIN x ON x.attribute = a.attribute AND x.left_source = l.source AND x.right_source = r.source""",
        "q_jaro_winkler": f"WITH {names} SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS jaro_winkler FROM n",
        "q_token_sort_equal": f"WITH {names} SELECT a, b FROM n WHERE a <> b AND list_sort(string_split(a, ' ')) = list_sort(string_split(b, ' '))",
        "q_evidence_exact": f"WITH {pairs} SELECT left_id, right_id, {', '.join(level.format(a=a) for a in ('phone', 'email', 'birthday', 'hksr_num', 'hkid'))} FROM pairs p JOIN person l ON l.record_id = p.left_id JOIN person r ON r.record_id = p.right_id",
        "q_fs_levels_roman": f"WITH {pairs}, g AS (SELECT {', '.join(fs(n, t) for n, t in jw.items())} FROM pairs p JOIN person l ON l.record_id = p.left_id JOIN person r ON r.record_id = p.right_id) SELECT *, count(*) AS n FROM g GROUP BY ALL",
        "q_fs_tf": f"WITH {person} SELECT email AS value, round(count(*) / (SELECT count(email) FROM person), 9) AS tf FROM person WHERE email IS NOT NULL GROUP BY email",
    }


def oracles() -> dict[str, str]:
    """SQL of all queries; those over Chinese names need a session, whose character tables they use."""
    return {**_plain(), **(_canonical() if sql.has_simplified() else {})}
