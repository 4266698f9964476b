"""Behaviour of the core operators on small inputs with known results."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.functions import normalize as norm
from kinloom.functions import security
from kinloom.functions.strings import indel_ratio, jaro_winkler, token_set_ratio, token_sort_ratio
from kinloom.operators import blocking, canonical, clusters, evidence, fellegi, formula, formula_match, metrics, models, profiling, review, sampling
from kinloom.operators import policy as policies
from kinloom.operators.keyed_rank import value_at_position
from kinloom.plans import linkage
from kinloom.sources.stage import Stage

PERSON = "record_id string, source string, ccd_source_key string, chi_surname string, chi_firstname string, eng_surname string, eng_firstname string, phone_num string, email string, birthday string, hkid string, hksr_num string, modified timestamp"
T0 = dt.datetime(2024, 1, 1)


def person(record_id, source, **values):
    names = [c.split()[0] for c in PERSON.split(", ")]
    row = dict.fromkeys(names) | {"record_id": record_id, "source": source, "ccd_source_key": record_id, "modified": T0} | values
    return tuple(row[n] for n in names)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), PERSON)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


# p1


def ranked(spark, rows):
    df = spark.createDataFrame(rows, "k string, t timestamp, id string, _slice string")
    return {r["k"]: r["id"] for r in value_at_position(df, ["k"], "t", "id").collect()}


def test_rank_of_keys_with_ties_nulls_and_repeats(spark):
    at = [T0 + dt.timedelta(days=d) for d in (0, 40, 80, 400)]
    rows = [("a", at[2], "3", ""), ("a", at[0], "1", ""), ("a", at[1], "2", ""), ("b", at[0], "y", ""), ("b", at[0], "x", ""), ("c", None, "n", ""), ("c", at[3], "m", ""), (None, at[0], "z", ""), (None, at[0], "z", "")]
    assert ranked(spark, rows) == {"a": "2", "b": "x", "c": "n", None: "z"}


def test_rank_of_a_hot_key_goes_through_finer_slices(spark):
    rows = [("hot", T0 + dt.timedelta(microseconds=i % 7), f"{i:05d}", "") for i in range(2000)] + [("rare", T0, "r", "")]
    df = spark.createDataFrame(rows, "k string, t timestamp, id string, extra string")
    got = {r["k"]: r["id"] for r in value_at_position(df, ["k"], "t", "id", bound=20, broadcast_rows=0).collect()}
    wanted = sorted((r[1], r[2]) for r in rows if r[0] == "hot")[(2000 - 1) // 2][1]
    assert got == {"hot": wanted, "rare": "r"}


def test_rank_of_an_empty_table(spark):
    assert ranked(spark, []) == {}


# normalisation


@pytest.mark.parametrize(("raw", "wanted"), [("(+852) 1111 1111", "11111111"), ("00852-22222222", "22222222"), ("85212345678", "12345678"), ("85212345", "85212345"), ("", None), (None, None), ("no phone", None)])
def test_phone(spark, raw, wanted):
    assert one(spark, raw, norm.phone) == wanted


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("1980-1-2", "1980-01-02"), ("1980/01/02", "1980-01-02"), ("2/1/1980", "1980-01-02"), ("02-01-1980", "1980-01-02"), ("19800102", "1980-01-02"), ("1980-01-02 00:00:00", "1980-01-02"), ("1980-02-30", None), ("1980-01/02", None), ("1980", None), ("", None), (None, None)],
)
def test_birthday(spark, raw, wanted):
    assert one(spark, raw, norm.birthday) == wanted


def test_hkid_check_digit(spark):
    assert one(spark, "A123456(3)", norm.valid_hkid) is True
    assert one(spark, "A123456(4)", norm.valid_hkid) is False
    assert one(spark, None, norm.valid_hkid) is False


def test_names(spark):
    assert one(spark, "ＣＨＡＮ  Taí-Man", norm.english_words) == "chan tai man"
    assert one(spark, "陳 大文", lambda c: norm.chinese_compact(spark, c)) == "陈大文"
    assert one(spark, "   ", norm.text) is None


def test_email(spark):
    assert one(spark, "P1@Example.com", norm.email) == "p1@example.com"
    assert one(spark, "a@b@c.d", norm.email) is None
    assert one(spark, "@x.y", norm.email) is None


def test_masks_and_escapes(spark):
    assert one(spark, "A123456(3)", security.mask_identifier) == "*******(3)"
    assert one(spark, "AB", security.mask_identifier) == "****B"
    assert one(spark, None, security.mask_identifier) == ""
    assert one(spark, "<script>'&\"", security.safe_html) == "&lt;script&gt;&#x27;&amp;&quot;"
    df = spark.createDataFrame([({"hkid": "A1", "x": "y"}, ("B2", "n"))], "m map<string,string>, s struct<identifier:string,name:string>")
    row = security.redact(df).first()
    assert row["m"] == {"hkid": "[REDACTED]", "x": "y"} and row["s"]["identifier"] == "[REDACTED]" and row["s"]["name"] == "n"


def test_kernels():
    assert indel_ratio("lewenstein", "levenshtein") == pytest.approx(2 * 9 / 21)
    assert indel_ratio("", "") == 1.0
    assert token_sort_ratio("chan tai man", "tai man chan") == 1.0
    assert token_set_ratio("chan tai man", "chan tai man peter") == 1.0
    assert token_set_ratio("", "x") == 0.0
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)


# policy


def test_policy_maps_disables_and_round_trips(spark):
    p = policies.Policy(rules=(policies.Rule("A", "phone", "mobile"), policies.Rule("A", "hkid", scope="global"), policies.Rule("A", "email", enabled=False)), trusted=("hkid",))
    p.validate()
    assert policies.Policy.from_json(p.to_json()) == p
    df = spark.createDataFrame([("A", "1", "2", "a@b.c"), ("B", "1", "2", "a@b.c")], "source string, phone_num string, mobile string, email string")
    rows = df.select("source", p.value(df, "phone").alias("phone"), p.value(df, "email").alias("email"), p.comparable("hkid", F.col("source")).alias("g")).collect()
    assert [tuple(r) for r in rows] == [("A", "2", None, True), ("B", "1", "a@b.c", False)]
    with pytest.raises(ValueError):
        policies.Policy(trusted=("phone",)).validate()
    with pytest.raises(ValueError):
        policies.Policy(rules=(policies.Rule("A", "phone", "mobile"), policies.Rule("A", "phone", "phone_num"))).validate()
    assert p.sources == ("A",)


def test_registration_rows_take_the_least_rank(spark):
    df = spark.createDataFrame([("A", "mobile: Mobile"), ("A", "phone_num: Phone"), ("A", "sex: Sex")], "source string, sys_fieldname string")
    rows = {r["attribute"]: r for r in policies.profile_rows(df).collect()}
    assert len(rows) == 9 and rows["phone"]["column"] == "phone_num" and rows["phone"]["enabled"] == 1 and rows["email"]["enabled"] == 0


# blocking, evidence, models


def pairs_of(spark, policy, *rows):
    records = canonical.with_pinyin(canonical.canonical_records(frame(spark, *rows), policy))
    return blocking.candidate_pairs(records, policy), records


def test_pairs_only_between_sources(spark):
    pairs, _ = pairs_of(spark, policies.Policy(), person("a1", "A", phone_num="(+852) 1111 1111"), person("b1", "B", phone_num="11111111"), person("a2", "A", phone_num="11111111"), person("n1", None, phone_num="11111111"))
    assert sorted((r["left_id"], r["right_id"], tuple(r["routes"])) for r in pairs.collect()) == [("a1", "b1", ("phone",)), ("a2", "b1", ("phone",))]


def test_unverified_identifier_is_a_route(spark):
    pairs, _ = pairs_of(spark, policies.Policy(), person("a1", "A", hksr_num="12345"), person("b1", "B", hksr_num="12345"))
    assert [tuple(r["routes"]) for r in pairs.collect()] == [("unverified_id",)]


def test_large_blocks_are_reported_without_values(spark):
    policy = policies.Policy(max_block=2)
    rows = [person(f"r{i}", "AB"[i % 2], phone_num="11111111") for i in range(4)]
    records = canonical.with_pinyin(canonical.canonical_records(frame(spark, *rows), policy))
    keys = blocking.block_keys(records, policy)
    skipped = blocking.skipped_blocks(blocking.block_sizes(keys), policy).collect()
    assert [(r["route"], r["n"]) for r in skipped] == [("phone", 4)] and "1111" not in skipped[0]["digest"]
    assert blocking.candidate_pairs(records, policy).count() == 0


def test_pairs_come_once_without_an_aggregation_over_pairs(spark):
    rows = [person("r1", "A", email="a@b.hk", phone_num="91234567"), person("r2", "B", email="a@b.hk", phone_num="91234567"), person("r3", "C", phone_num="91234567")]
    rows += [person("r3", "C", email="a@b.hk"), person("r3", "A", birthday="1990-01-01")]  # an id of three rows, two of one source
    policy = policies.Policy()
    records = canonical.with_pinyin(canonical.canonical_records(frame(spark, *rows), policy))
    pairs = blocking.candidate_pairs(records, policy)
    got = sorted((r["left_id"], r["right_id"], r["left_source"], r["right_source"], "+".join(r["routes"])) for r in pairs.collect())
    assert got == [("r1", "r2", "A", "B", "email+phone"), ("r1", "r3", "A", "C", "email+phone"), ("r2", "r3", "B", "C", "email+phone")]
    alone = blocking.candidate_pairs(records.filter("record_id <> 'r3'"), policy)
    plan = alone._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan.split("Join")[0]


def test_cap_is_in_a_fixed_order(spark):
    rows = [person(f"{s}{i}", s, phone_num="22222222") for s in "AB" for i in range(3)]
    pairs, _ = pairs_of(spark, policies.Policy(), *rows)
    capped = blocking.capped_pairs(pairs, policies.Policy(max_pairs=2)).collect()
    assert [(r["left_id"], r["right_id"], r["truncated"]) for r in capped] == [("A0", "B0", True), ("A0", "B1", True)]


def _crowd(spark, policy):
    values = [dict(phone_num=f"9{i % 3}234567", email=f"e{i % 4}@b.hk", eng_surname="CHAN", eng_firstname=["Tai Man", "Man Tai", f"Ta {i}"][i % 3], chi_surname="陳", chi_firstname="大" if i % 2 else None, hksr_num=str(i % 5)) for i in range(24)]
    rows = [person(f"r{i:02d}", "ABC"[i % 7 % 3], **v) for i, v in enumerate(values)]
    return canonical.with_pinyin(canonical.canonical_records(frame(spark, *rows), policy)), rows


def test_pairs_are_counted_by_route_without_being_made(spark, monkeypatch):
    policy = policies.Policy()
    records, _ = _crowd(spark, policy)
    wanted = {r["routes"]: r["n"] for r in blocking.candidate_pairs(records, policy).groupBy(F.array_join("routes", "+").alias("routes")).agg(F.count(F.lit(1)).alias("n")).collect()}
    made = []
    met = blocking.met_pairs
    monkeypatch.setattr(blocking, "met_pairs", lambda found, slots=None, **more: made.append(slots) or met(found, slots, **more))
    for walked in (0, 2, 64):
        monkeypatch.setattr(blocking, "WALKED", walked)
        made.clear()
        got = {r["routes"]: r["n"] for r in blocking.route_counts(records, policy).collect()}
        assert got == wanted
        assert walked or not made


def test_first_pairs_make_few_pairs_behind_the_cap(spark, monkeypatch):
    records, _ = _crowd(spark, policies.Policy())
    made = []
    met = blocking.met_pairs
    monkeypatch.setattr(blocking, "met_pairs", lambda *x, **more: made.append(out := met(*x, **more)) or out)
    for most in (3, 60, 100, 10_000):
        policy = policies.Policy(max_pairs=most)
        wanted = [tuple(r) for r in blocking.capped_pairs(blocking.candidate_pairs(records, policy), policy).collect()]
        made.clear()
        assert [tuple(r) for r in blocking.first_pairs(records, policy).collect()] == wanted
        if most == 3:
            assert sum(m.count() for m in made) < 24


def test_names_of_equal_words_meet_by_their_words(spark):
    policy = policies.Policy()
    records, _ = _crowd(spark, policy)
    names = records.select("record_id", "eng_full")
    pairs = blocking.candidate_pairs(records, policy).join(names.toDF("left_id", "a"), "left_id").join(names.toDF("right_id", "b"), "right_id")
    wanted = {(r["a"], r["b"]) for r in pairs.collect() if r["a"] != r["b"] and sorted(r["a"].split()) == sorted(r["b"].split())}
    words = F.array_join(F.array_sort(F.split("eng_full", " ")), " ")
    got = blocking.met_texts(records, policy, "eng_full", words)
    assert len(wanted) == 2 and {(r["a"], r["b"]) for r in got.collect()} == wanted
    assert "Python" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_budget_skips_what_does_not_fit_and_goes_on(spark):
    blocks = spark.createDataFrame([("phone", "a", 4, 4), ("phone", "b", 9, 9), ("phone", "c", 3, 2)], "route string, value string, n_records bigint, n_pairs bigint")
    assert blocking.within_budget(blocks, ["phone"], max_block=100, budget=7) == [("phone", "a"), ("phone", "c")]


def evidence_of(spark, left, right, policy=None):
    policy = policy or policies.Policy()
    records = canonical.with_pinyin(canonical.canonical_records(frame(spark, person("l", "A", **left), person("r", "B", **right)), policy))
    pair = spark.createDataFrame([("l", "r", "A", "B")], "left_id string, right_id string, left_source string, right_source string")
    return models.compare_models(evidence.pair_evidence(pair, records), policy).first()


def test_levels(spark):
    row = evidence_of(spark, {"chi_surname": "測", "chi_firstname": "試明", "eng_surname": "CHAN", "eng_firstname": "Tai Man", "phone_num": "11111111"}, {"chi_surname": "測", "chi_firstname": "試鳴", "eng_surname": "CHAN", "eng_firstname": "TM", "phone_num": "22222222"})
    assert [row[f"e_{a}"]["level"] for a in ("chi_surname", "chi_firstname", "eng_surname", "eng_firstname", "phone", "email")] == ["exact", "phonetic", "exact", "weak", "disagree", "missing"]
    assert row["e_eng_firstname"]["score"] == 0.55


NAMED = {"chi_surname": "測", "chi_firstname": "試甲", "eng_surname": "EXAMPLE", "eng_firstname": "Person Alpha"}
GLOBAL = policies.Policy(rules=tuple(policies.Rule(s, "hkid", scope="global") for s in "AB"), trusted=("hkid",))


@pytest.mark.parametrize(
    ("left", "right", "policy", "gated", "recoverable"),
    [
        (NAMED, NAMED, None, "review", "review"),
        (NAMED | {"birthday": "1980-01-02"}, NAMED | {"birthday": "1980/01/02"}, None, "high", "high"),
        ({"hkid": "A123456(3)"}, {"hkid": "A1234563"}, GLOBAL, "high", "high"),
        ({"hkid": "A123456(3)"}, {"hkid": "A1234563"}, None, "review", "review"),
        (NAMED | {"hkid": "A1234563", "phone_num": "11111111"}, NAMED | {"hkid": "B9876540", "phone_num": "11111111"}, GLOBAL, "conflict_review", "review"),
        ({"phone_num": "11111111"}, {"phone_num": "22222222"}, None, "low", "low"),
    ],
)
def test_tiers(spark, left, right, policy, gated, recoverable):
    row = evidence_of(spark, left, right, policy)
    assert (row["gated"]["tier"], row["recoverable"]["tier"]) == (gated, recoverable)


def test_hybrid(spark):
    df = spark.createDataFrame([("review", 0.9), ("low", 0.9), ("high", 0.1), ("conflict_review", 0.99), ("high", None)], "t string, p double")
    got = [r[0] for r in df.select(models.hybrid_tier(F.col("t"), F.col("p"), F.lit(0.8), F.lit(0.4))).collect()]
    assert got == ["high", "review", "low", "conflict_review", "high"]


# formulas


def test_formula_grammar():
    f = formula.parse('(@ChineseMatch(f"{a} {b}")*0.5 + @EnglishMatch("c") * 0.4) >= -0.5')
    assert [s.fields for s in f.slots] == [("a", "b"), ("c",)] and (f.comparison, f.threshold) == (">=", -0.5)
    for bad in ("__import__('os')", "@Other(x)", "1 +", "(1", "1 2", "x.y", "2 ** 3"):
        with pytest.raises(ValueError):
            formula.parse(bad)


def test_formula_match_and_replacement(spark):
    rows = frame(spark, person("a1", "A", eng_surname="CHAN", eng_firstname="Tai Man", phone_num="(+852) 11111111"), person("b1", "B", eng_surname="X", eng_firstname="Man Tai", phone_num="(852) 11111111"), person("b2", "B", eng_firstname="Yip", phone_num="2"), person("n", None, eng_firstname="Man Tai"))
    text = '(@EnglishMatch("eng_firstname")*0.6 + @PhoneMatch("phone_num")*0.4) > 0.9'
    assert [r["client_id"] for r in formula_match.match_source(rows, "A", text).collect()] == []  # no shared block: tai / man
    rows = rows.withColumn("eng_firstname", F.when(F.col("record_id") == "b1", "Tai Man").otherwise(F.col("eng_firstname")))
    found = formula_match.match_source(rows, "A", text)
    row = found.first()
    assert (row["parent"], row["client"], row["client_id"], row["idx"], row["score"]) == ("a1", "B", "b1", 1, 1.0)
    assert "EnglishMatch" in row["match_equation"]
    assert formula_match.match_source(rows, "A", "").count() == 0
    assert formula_match.match_source(rows, "A", '1/0*@IDMatch("hkid")').count() == 0
    stored = found.withColumn("client_id", F.lit("old")).unionByName(found.withColumn("parent", F.lit("other")))
    kept = formula_match.replace_matches(stored, found, spark.createDataFrame([("a1",)], "parent string"))
    assert sorted((r["parent"], r["client_id"]) for r in kept.collect()) == [("a1", "b1"), ("other", "b1")]


def written(folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_source_with_a_formula_is_matched(spark, tmp_path):
    rows = frame(spark, *(person(f"{s.lower()}1", s, eng_firstname="Tai Man", modified=T0 + dt.timedelta(days=s == "B")) for s in "ABC"))
    registrations = spark.createDataFrame([("A", '@EnglishMatch("eng_firstname") > 0.5'), ("B", '@EnglishMatch("eng_firstname") > 0.6'), ("C", None)], "source string, fuzzymachingscript string")
    stored = spark.createDataFrame([("a1", "old"), ("c1", "kept")], "parent string, client_id string").selectExpr("parent", "'x' AS mas_client", "'y' AS client", "client_id", "1 AS idx", "0.0D AS score", "'' AS match_equation")
    runs = spark.createDataFrame([("Completed", T0)], "status string, snapshot_at timestamp")
    at = written(tmp_path, ccd_master=rows, ccd_registration=registrations, ccd_master_matching=stored, ccd_match_evaluation_run=runs)
    pairs = {("a1", "b1"), ("a1", "c1"), ("b1", "a1"), ("b1", "c1")}
    assert {(r["parent"], r["client_id"]) for r in linkage.q_formula_matches(spark, at).collect()} == pairs
    assert {(r["parent"], r["client_id"]) for r in linkage.q_replace_matches(spark, at).collect()} == pairs | {("c1", "kept")}
    assert {(r["parent"], r["client_id"]) for r in linkage.q_formula_incremental(spark, at).collect()} == {("b1", "a1"), ("b1", "c1")}


def test_a_cut_block_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(formula_match, "BLOCK", 4)
    rows = frame(spark, *(person(f"{s}{i}", s, chi_firstname="文", eng_firstname=f"Tai {i}") for s in "AB" for i in range(15)))
    found = formula_match.match_source(rows, "A", '@EnglishMatch("eng_firstname") + @ChineseMatch("chi_firstname") > 0.5')
    assert sorted((r["parent"], r["client_id"]) for r in found.collect()) == sorted((f"A{i}", f"B{j}") for i in range(15) for j in range(15))


def test_legacy_phone(spark):
    assert [one(spark, v, formula.legacy_phone) for v in ("+852 1", "(+852) 1", "(852) 1", "0085291234567", "123")] == ["+852 1", "+852 1", "+852 1", "+8529 1234567", "123"]


def test_directional_baseline_takes_the_better_side(spark):
    rows = frame(spark, person("a1", "A", eng_firstname="Tai Man", hkid="X1"), person("b1", "B", eng_firstname="Tai Man", hkid="X2"))
    registrations = spark.createDataFrame([("A", '@IDMatch("hkid") > 0.5'), ("B", '@EnglishMatch("eng_firstname")*0.8 > 0.5')], "source string, fuzzymachingscript string")
    pairs = spark.createDataFrame([("a1", "b1", "A", "B")], "left_id string, right_id string, left_source string, right_source string")
    row = formula_match.directional_baseline(pairs, rows, registrations).first()
    assert (row["score"], row["matches"], row["direction"]) == (0.8, True, "right_source_formula")


def test_a_pair_without_formula_keeps_its_baseline(spark):
    rows = frame(spark, person("a1", "A", eng_firstname="Tai"), person("b1", "B", eng_firstname="Tai"), person("c1", "C", eng_firstname="Tai"))
    registrations = spark.createDataFrame([("A", '@EnglishMatch("eng_firstname")*0.8 > 0.5'), ("B", None)], "source string, fuzzymachingscript string")
    pairs = spark.createDataFrame([("a1", "b1", "A", "B", 0.1, False), ("b1", "c1", "B", "C", 0.7, True)], "left_id string, right_id string, left_source string, right_source string, score double, matches boolean")
    got = {r["left_id"]: (r["score"], r["matches"], r["direction"]) for r in formula_match.baseline_with_formulas(pairs, rows, registrations).collect()}
    assert got == {"a1": (0.8, True, "left_source_formula"), "b1": (0.7, True, "default")}


def test_registered_queries_keep_blocks_above_200(spark, tmp_path):
    rows = frame(spark, *(person(f"{s}{i:03d}", s, eng_surname="CHAN", eng_firstname=f"Tai M{i}") for s in "AB" for i in range(130)))
    at = written(tmp_path, ccd_master=rows, ccd_registration=spark.createDataFrame([("A", "Local", "")], "source string, identifier_scope string, fuzzymachingscript string"))
    assert linkage.q_skipped_blocks(spark, at).count() == 0
    assert linkage.q_pairs_multi_route(spark, at).count() == 130 * 130


def test_exact_evidence_comes_with_the_pairs(spark, tmp_path):
    rows = [person("r1", "A", phone_num="91234567", email="a@b.hk"), person("r2", "B", phone_num="91234567", email="c@b.hk"), person("r3", "C", phone_num="91234567", birthday="1990-01-01"), person("r3", "C", phone_num="81234567")]
    registration = spark.createDataFrame([("A", "Local", "")], "source string, identifier_scope string, fuzzymachingscript string")
    at = written(tmp_path, ccd_master=frame(spark, *rows), ccd_registration=registration)
    got = sorted((r["left_id"], r["right_id"], r["phone"], r["email"], r["birthday"]) for r in linkage.q_evidence_exact(spark, at).collect())
    assert got == [
        ("r1", "r2", "exact", "disagree", "missing"), ("r1", "r3", "disagree", "missing", "missing"), ("r1", "r3", "exact", "missing", "missing"),
        ("r2", "r3", "disagree", "missing", "missing"), ("r2", "r3", "exact", "missing", "missing"),
    ]
    at = written(tmp_path / "own", ccd_master=frame(spark, *rows[:2]), ccd_registration=registration)
    plan = linkage.q_evidence_exact(spark, at)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_evidence_is_gathered_only_where_a_conflict_can_be(spark, tmp_path, monkeypatch):
    same = dict(eng_surname="CHAN", eng_firstname="Tai Man", phone_num="91234567")
    rows = frame(spark, person("r1", "A", hkid="A1234563", **same), person("r2", "B", hkid="B1234560", **same), person("r3", "C", **same))
    scopes = {"global": ["Global", "Global", ""], "local": ["Global", "Local", ""]}
    at = {k: written(tmp_path / k, ccd_master=rows, ccd_registration=spark.createDataFrame([(s, x, "") for s, x in zip("ABC", v, strict=True)], "source string, identifier_scope string, fuzzymachingscript string")) for k, v in scopes.items()}
    assert {tuple(r) for r in linkage.q_cluster_conflicts(spark, at["global"]).collect()} == {("r1", "r2"), ("r1", "r3"), ("r2", "r3")}
    monkeypatch.setattr(evidence, "pair_evidence", None)
    assert linkage.q_cluster_conflicts(spark, at["local"]).collect() == []


# sampling, metrics, review, clusters, profiling


def test_sample_covers_strata_and_repeats(spark):
    df = spark.createDataFrame([(f"l{i}", f"r{i}", "big" if i % 50 else f"s{i}") for i in range(500)], "left_id string, right_id string, stratum string")
    a, b = (sorted(map(tuple, sampling.stratified_sample(d, 40, "x").collect())) for d in (df, df.repartition(7)))
    assert a == b and len(a) == 40 and {r[2] for r in a} == {"big", *(f"s{i}" for i in range(0, 500, 50))}
    assert sampling.stratified_sample(df, 0, "x").count() == 0


def test_a_pair_drawn_twice_represents_its_stratum_once(spark):
    rows = [("a", "b", "s", i) for i in range(9)] + [(f"l{i}", f"r{i}", f"t{i}", 0) for i in range(5)]
    df = spark.createDataFrame(rows, "left_id string, right_id string, stratum string, n int")
    got = sampling.stratified_sample(df, 6, "x").collect()
    assert {r["stratum"] for r in got} == {"s", *(f"t{i}" for i in range(5))}


def test_training_sample_keeps_what_is_required(spark):
    records = spark.createDataFrame([(f"R{i}",) for i in range(100)], "record_id string")
    required = spark.createDataFrame([("R95",), ("R96",), ("nope",)], "record_id string")
    got = {r[0] for r in sampling.training_sample(records, required, 10).collect()}
    assert len(got) == 10 and {"R95", "R96"} <= got


def test_thresholds_need_enough_samples(spark):
    df = spark.createDataFrame([(True, 0.99)] * 5 + [(False, 0.2)] * 10, "label boolean, score double")
    few = metrics.select_thresholds(metrics.sweep(df), least_high=30).first()
    assert few["high_threshold"] is None and few["review_threshold"] == 0.99
    assert metrics.select_thresholds(metrics.sweep(df), least_high=5).first()["high_threshold"] == 0.99


def test_kappa_and_wilson(spark):
    df = spark.createDataFrame([("Same", "Same"), ("Different", "Different"), (None, "Same")], "label_a string, label_b string")
    assert tuple(metrics.cohens_kappa(df).first()) == (2, 1.0)
    assert metrics.cohens_kappa(df.limit(0)).first()["kappa"] is None
    w = spark.createDataFrame([(9, 10), (0, 0)], "s int, n int").select(metrics.wilson_interval(F.col("s"), F.col("n")).alias("w")).collect()
    assert w[0]["w"]["low"] == pytest.approx(0.596, abs=1e-3) and tuple(w[1]["w"]) == (0.0, 0.0)


def test_review_states(spark):
    pairs = spark.createDataFrame([("p1", 1), ("p2", 1), ("p3", 0), ("p4", 1), ("p5", 0)], "name string, needs_double_review int")
    labels = spark.createDataFrame(
        [("p1", 1, "a", "Same", T0, 0), ("p1", 2, "b", "Same", T0, 0), ("p2", 1, "a", "Same", T0, 0), ("p3", 1, "a", "Unsure", T0, 0), ("p3", 2, "z", "Different", T0, 1), ("p4", 1, "a", "Same", T0, 0), ("p4", 2, "b", "Same", T0, 0), ("p4", 3, "b", "Different", T0 + dt.timedelta(1), 0)],
        "parent string, idx int, reviewer string, label string, submitted_at timestamp, is_adjudication int",
    )
    got = {r["name"]: (r["status"], r["final_label"]) for r in review.review_state(pairs, labels).collect()}
    assert got == {"p1": ("Agreed", "Same"), "p2": ("Partially Reviewed", None), "p3": ("Adjudicated", "Different"), "p4": ("Needs Adjudication", None), "p5": ("Unreviewed", None)}


def test_conflicted_triangle(spark):
    df = spark.createDataFrame([("A", "B", "high"), ("B", "C", "review"), ("A", "C", "conflict_review"), ("X", "Y", "high")], "left_id string, right_id string, tier string")
    got = {tuple(r) for r in clusters.inconsistent_pairs(df, Stage(spark, "t")).collect()}
    assert got == {("A", "B"), ("B", "C"), ("A", "C")}


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)], "left_id string, right_id string")
    got = clusters.components(df, Stage(spark, "t"))
    assert got.count() == 61 and [r[0] for r in got.select("component").distinct().collect()] == ["000"]
    assert clusters.components(df.limit(0), Stage(spark, "t")).count() == 0


def test_profile_and_overlap(spark):
    records = canonical.canonical_records(frame(spark, person("a1", "A", phone_num="11111111", hkid="A123456(3)"), person("a2", "A"), person("b1", "B", hkid="A1234563", phone_num="11111111"), person("b2", "B", phone_num="11111111")), policies.Policy())
    rows = {(r["source"], r["attribute"]): r for r in profiling.profile_attributes(records).collect()}
    assert rows["A", "phone"]["coverage"] == 0.5 and rows["B", "phone"]["duplicate_rows"] == 2 and rows["A", "hkid"]["valid_rate"] == 1.0
    shared = {r["attribute"]: r["shared"] for r in profiling.value_overlap(records).collect()}
    assert shared["hkid"] == 1 and shared["email"] == 0 and len(shared) == 9


def test_many_jaro_winklers_are_the_same_numbers(monkeypatch):
    import random

    from kinloom.functions import strings

    draw = random.Random(3)
    texts = ["", "a", "b", "ab" * 40, "martha", "marhta", "陳大文", "陳文大", "大文陳", "𠀀a", "x" * 64]
    texts += sorted({"".join(draw.choice("ab c陳") for _ in range(draw.randint(1, 20))) for _ in range(60)} - set(texts))
    l, r = (np.array(x) for x in zip(*((i, j) for i in range(len(texts)) for j in range(len(texts))), strict=True))
    wanted = [jaro_winkler(texts[i], texts[j]) for i, j in zip(l, r, strict=True)]
    for table in (strings._TABLE, 0):
        monkeypatch.setattr(strings, "_TABLE", table)
        assert strings.JaroWinkler(texts)(l, r).tolist() == wanted


def test_jaro_winkler_of_columns_with_nulls():
    import pyarrow as pa

    from kinloom.functions import strings

    a, b = pa.array(["martha", None, "a", "", "陳大文"], pa.string()), pa.array(["marhta", "b", None, "", "陳文大"], pa.string())
    wanted = [None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    assert strings._jaro_winklers(a, b).to_pylist() == wanted
    assert strings._jaro_winklers(a[:0], b[:0]).to_pylist() == []
    assert strings._jaro_winklers(pa.array([None], pa.string()), b[:1]).to_pylist() == [None]


def test_names_that_may_be_near_are_told_by_numbers_too(spark):
    english = ["ka ming", "kaming", "ming ka", "k m", "km", "kam ing", "siu fong", "siufong", "sf", "tak wah", "an an", "anan", "x"]
    chinese = ["大文", "文大", "大", "小明", "明小", "歐陽大文", "歐阳大文", "李", "陳大"]
    rows = [person(f"r{i}", "AB"[i % 2], eng_firstname=english[i % len(english)], chi_firstname=chinese[i % len(chinese)]) for i in range(26)]
    records = canonical.canonical_records(frame(spark, *rows), policies.policy_from_rows([], name="p"))
    for a in ("eng_firstname", "chi_firstname"):
        values = evidence.numbered_values(records, a, Stage(spark, "test"))
        tells = evidence._tells(a, values)
        x, y = (values.select(*(F.col(c).alias(f"{c}_{n}") for c in values.columns)).join(tells.select(*(F.col(c).alias(f"{c}_{n}") for c in tells.columns if c not in ("mask", "further", "n"))), f"i_{n}") for n in "xy")
        both = x.crossJoin(y).filter("i_x < i_y").select(evidence._may_be_near(a).alias("may"), evidence._tell_near(a).alias("told")).collect()
        assert not [r for r in both if r["may"] and not r["told"]]
        assert any(not r["told"] for r in both) and any(r["may"] for r in both)


def test_patterns_of_blocks_are_those_of_the_pairs(spark, monkeypatch):
    names = [("Chan", "Ka Ming"), ("Chan", "Ka Min"), ("Chan", "Kaming"), ("Chan", "Kai"), ("Wong", "Ka"), (None, None)]
    rows = [person(f"r{i:03d}", "ABC"[i % 3], eng_surname=n[0], eng_firstname=n[1], chi_surname="陳" if i % 2 else None, chi_firstname="大文"[: i % 3], phone_num=f"9123456{i % 4}", email=f"p{i % 5}@x.hk", birthday=f"199{i % 2}-01-02") for i in range(60) for n in [names[i * 7 % 6]]]
    records = canonical.canonical_records(frame(spark, *rows), policies.policy_from_rows([], name="p")).withColumns({f"{c}_pinyin": F.lit(None).cast("string") for c in ("chi_surname", "chi_firstname")})
    p = policies.policy_from_rows([], name="p")
    wanted = fellegi.pattern_counts(fellegi.levels(blocking.candidate_pairs(records, p).select("left_id", "right_id"), records))
    for chunk in (fellegi.CHUNK, 50):
        monkeypatch.setattr(fellegi, "CHUNK", chunk)
        got = fellegi.met_pattern_counts(blocking.blocks(records, p, tuple(n for n, _ in fellegi.COMPARISONS)))
        assert got.columns == wanted.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_fellegi_sunter_ranks_agreement(spark):
    rows = [person(f"{s}{i:03d}", s, eng_surname="CHAN", eng_firstname=f"N{i} M{i * 7 % 13}", phone_num=f"{90000000 + i}", email=f"p{i}@x.y", birthday=f"19{50 + i % 40}-01-0{1 + i % 9}") for i in range(200) for s in "AB"]
    records = canonical.with_pinyin(canonical.canonical_records(frame(spark, *rows), policies.Policy()))
    pairs = blocking.candidate_pairs(records, policies.Policy())
    scored = fellegi.fit_predict(records, pairs, [(("phone",), pairs.filter("array_contains(routes, 'phone')").select("left_id", "right_id"))])
    best = scored.filter("substring(left_id, 2, 3) = substring(right_id, 2, 3)").agg(F.min("probability")).first()[0]
    assert best > 0.99


def test_streamed_changes_replace_matches(spark, tmp_path):
    from kinloom.streaming.incremental import changed_records, current_matches, match_changes

    master = frame(spark, person("a1", "A", eng_firstname="Tai Man"), person("b1", "B", eng_firstname="Tai Man"))
    changes = master.filter("source = 'A'").select("source", "ccd_source_key")
    changes.write.parquet(str(tmp_path / "in"))
    query = match_changes(changed_records(spark, str(tmp_path / "in"), changes.schema), lambda: master, {"A": '@EnglishMatch("eng_firstname") > 0.5'}, str(tmp_path / "out"), str(tmp_path / "chk"))
    query.awaitTermination(120)
    assert [(r["parent"], r["client_id"]) for r in current_matches(spark, str(tmp_path / "out")).collect()] == [("a1", "b1")]


def test_entry_and_registered_queries(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_and_levels_need_no_table_of_pairs(spark, monkeypatch):
    """Values of pairs come with the blocks (F5, F12, F16, F17); an id of several records gives the pairs of each."""
    from kinloom.plans import linkage

    policy = policies.Policy()
    records, rows = _crowd(spark, policy)
    records = records.unionByName(records.filter("record_id = 'r03'").withColumns({"eng_full": F.lit("lee ka"), "phone": F.lit("1")}))
    plain = records.withColumn("chi_surname_pinyin", F.lit(None).cast("string"))
    pairs = blocking.candidate_pairs(plain, policy)
    leveled = {tuple(r) for r in fellegi.pattern_counts(fellegi.levels(pairs.select("left_id", "right_id"), records)).collect()}
    a, b = (records.select(F.col("record_id").alias(f"{n}_id"), F.col("eng_full").alias(n[0])) for n in ("left", "right"))
    names = {tuple(r) for r in pairs.join(a, "left_id").join(b, "right_id").filter("l IS NOT NULL AND r IS NOT NULL").select("l", "r").collect()}
    monkeypatch.setattr(linkage, "_exact", lambda *_: (plain, policy))
    monkeypatch.setattr(linkage, "_pairs", None)
    assert {tuple(r) for r in linkage._name_pairs(spark, "").collect()} == names and any("lee ka" in x for x in names)
    assert {tuple(r) for r in linkage.q_fs_levels(spark, "").collect()} == leveled


@pytest.fixture(scope="module")
def varied(spark):
    """Canonical records of one block in many spellings, one id of two records, without readings and with them, and a policy that trusts two sources."""
    import random

    some = random.Random(5)
    han, words = "陳大文小明玲林名1", ["tai", "man", "ta", "m", "wai", "lap", "mantai", "wa", "tm", "ling lin", "tai tai", "margaret", "margret"]
    policy = policies.policy_from_rows([{"source": s, "attribute": "hkid", "column": "hkid", "scope": "global", "enabled": 1} for s in "AB"], trusted="hkid")

    def text(of, most, by):
        return None if some.random() < 0.1 else by.join(some.choice(of) for _ in range(some.randint(1, most)))

    rows = [
        person(f"r{i % 69:02d}", "ABC"[i % 69 % 3], chi_surname=text(han, 2, ""), chi_firstname=text(han, 4, ""), eng_surname=text(words, 1, " "), eng_firstname=text(words, 3, " "),
               phone_num="91234567", email=f"e{i % 4}@b.hk", birthday=f"199{i % 3}-01-01", hkid=[None, "A1234563", "B1234560"][i // 2 % 3])
        for i in range(70)
    ]
    read = Stage(spark, "varied").write(canonical.with_pinyin(canonical.canonical_records(frame(spark, *rows), policy)))
    return read.withColumns({f"{c}_pinyin": F.lit(None).cast("string") for c in evidence.CHINESE}), read, policy


@pytest.fixture
def numbered(spark, varied, monkeypatch):
    """The varied records as those of the registered queries, without a table of pairs; wanted: evidence gathered pair by pair."""
    plain, read, policy = varied
    wanted = evidence.pair_evidence(blocking.candidate_pairs(plain, policy), read)
    monkeypatch.setattr(linkage, "_exact", lambda *_: (plain, policy))
    monkeypatch.setattr(linkage, "_pairs", None)
    return wanted, policy


@pytest.mark.parametrize("most", [evidence.BROADCAST_NEAR, 0])
def test_evidence_comes_with_the_blocks(spark, numbered, monkeypatch, most):
    """the reasons of every pair, by names numbered and near names found in the blocks."""
    monkeypatch.setattr(evidence, "BROADCAST_NEAR", most)
    wanted = numbered[0].select("left_id", "right_id", *(F.col(f"e_{a}")["reason"].alias(a) for a in evidence.ATTRIBUTES))
    got, wanted_rows = (sorted(map(tuple, df.collect())) for df in (linkage.q_evidence(spark, ""), wanted))
    assert got == wanted_rows and {x for r in got for x in r[2:]} >= {x[2] for a in evidence.NAMES for x in evidence.OUTCOMES[a]}


def test_models_look_at_patterns(spark, numbered):
    """the models of every pair, worked out for each pattern of outcomes."""
    compared = models.compare_models(*numbered)
    wanted = sorted((r["left_id"], r["right_id"], "+".join(r["routes"]), *r["baseline"], r["gated"]["score"], r["gated"]["tier"], "+".join(r["gated"]["reasons"]), r["recoverable"]["tier"]) for r in compared.collect())
    names = ("left_id", "right_id", "routes", "baseline_score", "baseline_tier", "tiered_score", "tiered_tier", "reasons", "recoverable_tier")
    assert sorted(tuple(r[n] for n in names) for r in linkage.q_models(spark, "").collect()) == wanted
    assert {r[6] for r in wanted} >= {"high", "review", "conflict_review"}
    counts = {}
    for r in wanted:
        counts[r[4], r[6], r[8]] = counts.get((r[4], r[6], r[8]), 0) + 1
    assert {(r["baseline_tier"], r["tiered_tier"], r["recoverable_tier"]): r["n"] for r in linkage.q_tier_counts(spark, "").collect()} == counts


@pytest.mark.parametrize("size", [2])
def test_sample_looks_at_the_least_digests_first(spark, numbered, monkeypatch, size):
    """F8: few pairs are scored, and the sample is that of all."""
    compared = models.compare_models(*numbered)
    pair = blocking.source_pair(F.col("left_source"), F.col("right_source"))
    strata = compared.select("left_id", "right_id", sampling.stratum(pair, F.col("baseline.score"), F.col("baseline.tier"), F.col("gated.tier"), F.col("routes")).alias("stratum"))
    wanted = sorted(map(tuple, sampling.stratified_sample(strata, size, linkage.SEED).collect()))
    shares, within = [], sampling.within_share
    monkeypatch.setattr(linkage, "SAMPLE", size)
    monkeypatch.setattr(sampling, "within_share", lambda share, seed: shares.append(share) or within(share, seed))
    assert sorted(map(tuple, linkage.q_sample(spark, "").collect())) == wanted
    assert (shares[-1] < 1) == (size == 2)
