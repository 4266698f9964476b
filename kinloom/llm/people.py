"""Profiles of registrations and the candidate pairs among them, for problems 2 and 4."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.characters import han_fold, latin_fold, pinyin_table, simplified_table
from kinloom.functions.normalize import beyond_ascii, birthday_date
from kinloom.llm.likeness import MISSING, open_likeness
from kinloom.llm.survivor import usable_phone
from kinloom.sources.stage import Stage

PROFILE = ("c", "e", "p", "m", "b")
#: One id in so many goes into the sample that tells hot keys.
SAMPLED = 16
#: Most members of a block that are compared with each other; larger blocks are parted by what their members' names and values share.
BLOCK_BOUND = 100
#: A phone or e-mail of more registrations than this belongs to no person: agreement in it is no evidence. It still gives candidates.
COMMON = 10_000
#: Keys (measured, 8 bytes each) up to this number are broadcast, more are joined by shuffle.
BROADCAST_ROWS = 150_000


def _han_name(spark, surname: Column, given: Column) -> Column:
    both = F.concat(F.coalesce(surname, F.lit("")), F.coalesce(given, F.lit("")))
    odd = both.rlike(r"[^\x{4E00}-\x{9FFF}]")
    folded = F.when(odd, F.regexp_replace(F.translate(both, *han_fold()), r"[^\x{3400}-\x{9FFF}\x{20000}-\x{323AF}]+", "")).otherwise(both)
    return F.translate(folded, *simplified_table(spark))


def _roman(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    plain = F.lower(F.when(beyond_ascii(text), F.translate(text, *latin_fold())).otherwise(text))
    return F.when(plain.rlike("[^a-z]"), F.trim(F.regexp_replace(plain, "[^a-z]+", " "))).otherwise(plain)


def _email_name(c: Column) -> Column:
    """Local part in lower case without punctuation; blank for placeholders."""
    low = F.lower(F.trim(c))
    local = F.translate(F.regexp_extract(low, r"^[^@(\s,;]*", 0), "._-", "")
    return F.when((F.length(local) >= 5) & low.rlike(r"[@0-9]|\(at\)"), local)


def _birth(c: Column, modified: Column) -> Column:
    """Date as yyyymmdd text; a year after ``modified`` is a century late; from 1901 on."""
    day = birthday_date(c)
    day = F.when(F.year(day) > F.coalesce(F.year(modified), F.year(F.current_date())), F.add_months(day, -1200)).otherwise(day)
    return F.when(F.year(day) > 1900, F.replace(day.cast("string"), F.lit("-"), F.lit("")))


# groups of rows in order


def _names_with_new_birthdays(members: list[tuple[str, ...]]) -> list[tuple[str, str, str]]:
    """(Han name, romanised name, birthday), one of the names blank, that the merged members have together and none has alone."""
    had, names, days = set(), [dict(), dict()], {}
    for c, e, _, _, b in members:
        own = [x for x in b.split(";") if x]
        days.update(dict.fromkeys(own))
        for k, text in enumerate((c, e)):
            for x in text.split(";"):
                if x:
                    names[k][x] = None
                    had.update((k, x, y) for y in own)
    return [(x, "", y) if k == 0 else ("", x, y) for k in (0, 1) for x in names[k] for y in days if (k, x, y) not in had]


def merge_in_order(n_keys: int, *, fresh: bool = False):
    """``mapInArrow`` function over (keys.., c, e, p, m, b) in order of the keys: one row a key with the spellings of all its rows.

    Runs of one row, and attributes that are equal in a run, go through as whole
    columns.  What is held of a run that goes on is its distinct spellings.  With
    ``fresh`` the output has a column ``fresh``, and rows where it is true hold a name
    and a birthday that come together by the merge only.
    """
    width = n_keys + len(PROFILE)

    def merged(rows: list[list[str]]) -> list[str]:
        return [";".join(sorted({x for r in rows for x in r[k].split(";") if x})) for k in range(len(PROFILE))]

    def cut(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        first = np.ones(n, bool)
        if n > 1:
            same = np.ones(n - 1, bool)
            for i in range(n_keys):
                column = table.column(i).combine_chunks()
                same &= pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            first[1:] = ~same
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, n))
        heads = table.take(pa.array(starts))
        columns = [heads.column(i).combine_chunks() for i in range(n_keys)] + [pc.fill_null(heads.column(i).combine_chunks(), "") for i in range(n_keys, width)]
        extra: list[list] = [[] for _ in range(width)]
        if len(starts) < n:
            inside = np.flatnonzero(np.repeat(sizes > 1, sizes))
            rows = [pc.fill_null(table.column(i).combine_chunks().take(pa.array(inside)), "") for i in range(n_keys, width)]
            apart = np.zeros(len(inside), bool)  # rows unlike the one before
            for c in rows:
                apart[1:] |= ~pc.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            several = np.flatnonzero(sizes > 1)
            ends = np.cumsum(sizes[several])
            begins = ends - sizes[several]
            apart[begins] = False
            differ = np.flatnonzero(np.add.reduceat(apart.astype(np.int64), begins) > 0)
            values: list[list[str]] = [[] for _ in PROFILE]
            taken = np.concatenate([np.arange(begins[k], ends[k]) for k in differ]) if len(differ) else np.empty(0, np.int64)
            texts = [c.take(pa.array(taken)).to_pylist() for c in rows]
            at = 0
            for k in differ:
                size = int(ends[k] - begins[k])
                distinct = list(dict.fromkeys(zip(*(x[at : at + size] for x in texts), strict=True)))
                at += size
                for i, value in enumerate(merged(distinct)):
                    values[i].append(value)
                if fresh:
                    for c, e, b in _names_with_new_birthdays(distinct):
                        for i in range(n_keys):
                            extra[i].append(columns[i][int(several[k])].as_py())
                        for i, value in enumerate((c, e, "", "", b)):
                            extra[n_keys + i].append(value)
            mask = np.zeros(len(starts), bool)
            mask[several[differ]] = True
            columns[n_keys:] = [pc.replace_with_mask(c, pa.array(mask), pa.array(v, pa.string())) for c, v in zip(columns[n_keys:], values, strict=True)]
        names = list(table.column_names)
        if fresh:
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(len(starts), bool))], names=[*names, "fresh"])
            if extra[0]:
                arrays = [pa.array(x, table.schema.field(i).type) for i, x in enumerate(extra)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.ones(len(extra[0]), bool))], names=[*names, "fresh"])
        else:
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            n = table.num_rows
            if not n:
                continue
            last = np.ones(n, bool)  # rows of the last key, which may go on
            for i in range(n_keys):
                column = table.column(i).combine_chunks()
                last &= pc.equal(column, column[n - 1]).to_numpy(zero_copy_only=False)
            end = n - int(last.sum())
            if end:
                yield from cut(table.slice(0, end))
            held = table.slice(end)
            if held.num_rows > 1:
                held = held.group_by(held.column_names).aggregate([]).select(table.column_names)  # distinct rows, whatever their number
        if held is not None and held.num_rows:
            yield from cut(held)

    return run


_TEXTS = ", ".join(f"{x} string" for x in PROFILE)


def _hot_registrations(rows: DataFrame, stage: Stage) -> DataFrame | None:
    """Hashes of registrations delivered very often, told by a sample of the rows; None where there are none."""
    sampled = rows.filter(F.pmod(F.xxhash64("record_id"), F.lit(SAMPLED)) == 0)
    hot = stage.write(sampled.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 10_000 // SAMPLED).select("_h"))
    return None if hot.isEmpty() else hot


def registration_profiles(master: DataFrame, stage: Stage) -> DataFrame:
    """(id, source, ccd_source_key, c, e, p, m, b), written: all spellings of a registration, joined by ``;``.

    Rows without source or key are left out.  ``id`` numbers the registrations; no
    two share one.  Rows of a registration delivered very often are made distinct beforehand, with
    map-side combining.
    """
    spark = master.sparkSession
    key = ["_h", "source", "ccd_source_key"]
    named = master.filter("coalesce(source, '') <> '' AND ccd_source_key IS NOT NULL").withColumn("_h", F.xxhash64("source", "ccd_source_key"))
    rows = named.select(
        *key,
        _han_name(spark, F.col("chi_surname"), F.col("chi_firstname")).alias("c"),
        _roman(F.col("eng_surname")).alias("_s"),
        _roman(F.col("eng_firstname")).alias("_g"),
        usable_phone(F.col("phone_num")).alias("p"),
        _email_name(F.col("email")).alias("m"),
        _birth(F.col("birthday"), F.col("modified")).alias("b"),
    )
    blank = (F.col("_s") == "") & (F.col("_g") == "")
    rows = rows.select(*key, "c", F.when(~blank, F.concat_ws("|", "_s", "_g")).alias("e"), "p", "m", "b")
    hot = _hot_registrations(named.select("_h", "record_id"), stage)
    if hot is not None:
        rows = rows.join(F.broadcast(hot), "_h", "left_anti").unionByName(rows.join(F.broadcast(hot), "_h", "left_semi").distinct())
    ordered = rows.repartition("_h").sortWithinPartitions(*key)
    one = ordered.mapInArrow(merge_in_order(len(key)), f"_h bigint, source string, ccd_source_key string, {_TEXTS}")
    profiles = stage.write(one.select(F.monotonically_increasing_id().alias("id"), "source", "ccd_source_key", *PROFILE))
    return profiles


def blocked_and_scored(profiles: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """The blocking keys of ``profiles``, of every value whatever its number, and the profiles as they are scored.

    Registrations that share a common phone or e-mail stay candidates; only their
    agreement in it is no evidence.
    """
    keys = stage.write(block_keys(profiles, stage), compression="uncompressed")  # hashes
    return keys, _without_common(profiles, stage)


def _without_common(profiles: DataFrame, stage: Stage) -> DataFrame:
    """``profiles`` with phones and e-mails blank that more than ``COMMON`` registrations hold; for scores, not for blocking."""

    columns = profiles.columns

    def values(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*(F.struct(F.lit(x).alias("kind"), F.col(x).alias("value")) for x in ("p", "m")))).alias("v")).select("v.*").filter("value <> ''")

    sampled = values(profiles.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0))
    suspect = stage.write(sampled.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COMMON // SAMPLED // 2).select("kind", "value"))
    if suspect.isEmpty():
        return profiles
    common = values(profiles).join(F.broadcast(suspect), ["kind", "value"], "left_semi").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COMMON)
    common = stage.write(common.select("kind", "value"))
    for x in ("p", "m"):
        gone = common.filter(F.col("kind") == x).select(F.col("value").alias(x), F.lit(True).alias("_gone"))
        profiles = profiles.join(F.broadcast(gone), x, "left").withColumn(x, F.when(F.col("_gone"), "").otherwise(F.col(x))).drop("_gone")
    return stage.write(profiles.select(columns))


# blocking keys


def _items(c: str) -> Column:
    """The spellings of an attribute; none for a blank one."""
    return F.filter(F.split(F.col(c), ";"), lambda x: x != "")


def _hash(tag: str, *parts: str) -> Column:
    """Key of columns; null where one is blank."""
    known = F.lit(True)
    for x in parts:
        known = known & (F.col(x) != "")
    return F.when(known, F.xxhash64(F.lit(tag), *parts))


def _phone_key() -> list[Column]:
    return [_hash("p", "p")]


def _email_key() -> list[Column]:
    """The address without its last letter, by which people tell their addresses apart."""
    return [_hash("m", "m_stem")]


def _han_keys() -> list[Column]:
    """Birthday with the surname and the character after it; the full name with year, and with month and day."""
    return [_hash("b", "b", "c_head"), _hash("d", "c_full", "b_day"), _hash("y", "c_full", "b_year")]


def _roman_keys() -> list[Column]:
    """Birthday with the initials in order, and with the two last of the words in order; all words in order with year, and with month and day."""
    return [_hash("i", "b", "e_initials"), _hash("w", "b", "e_last"), _hash("d", "e_full", "b_day"), _hash("y", "e_full", "b_year")]


def _with_parts(df: DataFrame) -> DataFrame:
    """``df`` with what the keys are made of, each part once a row, for those of the columns c, e, m, b it has."""
    has = set(df.columns)
    steps: list[dict[str, Column]] = [{}, {}, {}]
    if "c" in has:
        steps[0]["c_full"] = F.when(F.length("c") > 1, F.col("c")).otherwise("")
        steps[1]["c_head"] = F.left("c_full", F.lit(2))
    if "e" in has:
        steps[0]["e_text"] = F.trim(F.translate("e", "|", " "))
        steps[1]["e_words"] = F.sort_array(F.split("e_text", " "))
        words = F.col("e_words")
        steps[2]["e_initials"] = F.regexp_replace(F.array_join(words, " "), "([a-z])[a-z]* ?", "$1")  # words in order have their initials in order
        steps[2]["e_full"] = F.array_join(words, "")
        steps[2]["e_last"] = F.concat(F.coalesce(F.get(words, F.size(words) - 2), F.lit("")), F.get(words, F.size(words) - 1))
    if "m" in has:
        steps[0]["m_stem"] = F.left("m", F.greatest(F.length("m") - 1, F.lit(0)))
    if "b" in has:
        steps[0] |= {"b_year": F.left("b", F.lit(4)), "b_day": F.substring("b", 5, 4)}
    for step in steps:
        df = df.withColumns(step) if step else df
    return df


def _exploded(df: DataFrame, keys: list[Column]) -> DataFrame:
    return _with_parts(df).select("id", F.explode(F.array(*keys)).alias("key")).filter("key IS NOT NULL")


def block_keys(profiles: DataFrame, stage: Stage) -> DataFrame:
    """(id, key): phone; e-mail but for its last letter; birthday with part of a name; full name with year, or with month and day.

    Romanised names go in by their sorted words or initials, so their order does not
    matter.  Profiles with several spellings get the keys of every combination of
    name and birthday.  A key may come out more than once for an id.  Everything is
    compiled: no lambda, no Python.
    """
    single = ~F.concat(*(F.col(x) for x in PROFILE)).contains(";")
    rich = stage.write(profiles.filter(~single).select("id", *PROFILE))

    def each(x: str) -> DataFrame:
        return rich.filter(F.col(x) != "").select("id", "b", F.explode(F.split(x, ";")).alias(x))

    def dated(x: str) -> DataFrame:
        return each(x).filter("b <> ''").select("id", x, F.explode(F.split("b", ";")).alias("b"))

    return reduce(
        DataFrame.unionByName,
        [
            _exploded(profiles.filter(single), [*_phone_key(), *_email_key(), *_han_keys(), *_roman_keys()]),
            _exploded(each("p"), _phone_key()),
            _exploded(each("m"), _email_key()),
            _exploded(dated("c"), _han_keys()),
            _exploded(dated("e"), _roman_keys()),
        ],
    )


def _further_parts() -> Column:
    """Hashes of what two near spellings share: ends of romanised words, Han characters; year, month with day, phone, e-mail."""
    c, e, p, m, b = map(_items, PROFILE)
    words = F.filter(F.flatten(F.transform(e, lambda x: F.split(F.translate(x, "|", " "), " "))), lambda x: x != "")
    parts = F.concat(
        F.transform(words, lambda x: F.xxhash64(F.lit("a"), F.left(x, F.lit(2)))),
        F.transform(words, lambda x: F.xxhash64(F.lit("z"), F.right(x, F.lit(2)))),
        F.transform(F.flatten(F.transform(c, lambda x: F.split(x, ""))), lambda x: F.xxhash64(F.lit("c"), x)),
        F.flatten(F.transform(b, lambda x: F.array(F.xxhash64(F.lit("y"), F.left(x, F.lit(4))), F.xxhash64(F.lit("d"), F.substring(x, 5, 4))))),
        F.transform(p, lambda x: F.xxhash64(F.lit("p"), x)),
        F.transform(m, lambda x: F.xxhash64(F.lit("m"), F.left(x, F.greatest(F.length(x) - 1, F.lit(1))))),
    )
    return F.array_distinct(parts)


def _pairs_in_runs(bound: int):
    """``mapInArrow`` function over rows (key, id) in order of key: pairs within runs of one key, rows of runs beyond ``bound``."""

    def cut(key: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
        edges = np.flatnonzero(np.diff(key)) + 1
        starts = np.concatenate([[0], edges])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        size = np.repeat(sizes, sizes)
        left, right = [], []
        small = size <= bound
        for d in range(1, int(sizes[sizes <= bound].max(initial=1))):
            at = np.flatnonzero((key[:-d] == key[d:]) & small[:-d])
            left.append(ids[at])
            right.append(ids[at + d])
        over = np.flatnonzero(~small)
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        other = a != b
        a, b = a[other], b[other]
        if not len(a) and not len(over):
            return None
        large = np.concatenate([np.zeros(len(a), bool), np.ones(len(over), bool)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.minimum(a, b), key[over]])), pa.array(np.concatenate([np.maximum(a, b), ids[over]])), pa.array(large)], names=["l", "r", "large"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys, ids = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([ids, batch.column(1).to_numpy()])
            if not len(keys):
                continue
            end = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
            if end:
                out = cut(keys[:end], ids[:end])
                keys, ids = keys[end:], ids[end:]
                if out is not None:
                    yield out
        if len(keys) and (out := cut(keys, ids)) is not None:
            yield out

    return run


def _every_pair(rows: DataFrame, piece: int) -> DataFrame:
    """All pairs of members of the blocks of ``rows`` (key, id), each block cut in pieces of about ``piece`` that meet each other in tasks of their own."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("_n"))
    cut = rows.join(sizes, "key").withColumn("_a", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_b")
    a = cut.select("key", F.col("id").alias("l"), "_a", other)
    b = cut.select("key", F.col("id").alias("r"), F.col("_a").alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_a"))
    return a.join(b, ["key", "_a", "_b"]).filter("l < r").select("l", "r")


def candidate_pairs(profiles: DataFrame, stage: Stage, *, bound: int = BLOCK_BOUND, levels: int = 3, keys: DataFrame | None = None) -> DataFrame:
    """Distinct (l, r), l < r, of profiles that share a key, written; tables made on the way are removed.

    No block is dropped.  A sample of the ids tells which keys are held by very
    many; these, and all runs found to be longer than ``bound``, are parted by what
    near spellings share (:func:`_further_parts`), up to ``levels`` times, in a fixed
    order of the parts, so that none is used twice.  Profiles of a large block equal
    in everything go in as one, paired with the others (and these among themselves, up
    to ``bound`` of them).  What is still large after that is compared whole, in pieces
    spread over tasks.
    """
    out, stage = stage, Stage(profiles.sparkSession, "pairs")
    rows = (stage.write(block_keys(profiles, stage), compression="uncompressed") if keys is None else keys).select("key", "id")
    found, parts = [], None
    state = ["key", "id"]
    for level in range(levels + 1):
        sampled = rows.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0)
        hot = stage.write(sampled.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(8, bound // 4)).select("key"))
        n, waiting = hot.count(), None
        if n:
            few = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
            waiting = rows.join(few, "key", "left_semi").select("key", "id")
            rows = rows.join(few, "key", "left_anti")
        ordered = rows.select("key", "id").repartition("key").sortWithinPartitions("key")
        cut = stage.write(ordered.mapInArrow(_pairs_in_runs(bound), "l bigint, r bigint, large boolean"), compression="snappy")
        found.append(cut.filter("NOT large").select("l", "r"))
        over = cut.filter("large").select(F.col("l").alias("key"), F.col("r").alias("id"))
        if not n and over.isEmpty():
            break
        rest = over if waiting is None else over.unionByName(waiting)
        rest = stage.write(rest.distinct())
        stage.drop(hot)
        if level == 0:
            parts = stage.write(profiles.join(rest.select("id").distinct(), "id", "left_semi").select("id", F.md5(F.concat_ws("\t", *PROFILE)).alias("fp"), _further_parts().alias("parts")))
            marked = stage.write(rest.join(parts.select("id", "fp"), "id"))
            alike = marked.groupBy("key", "fp").agg(F.min("id").alias("one"), F.count(F.lit(1)).alias("n"))
            twins = marked.join(alike.filter("n > 1"), ["key", "fp"])
            few, many = twins.filter(F.col("n") <= bound), twins.filter(F.col("n") > bound)
            found.append(few.select("key", "fp", F.col("id").alias("l")).join(few.select("key", "fp", F.col("id").alias("r")), ["key", "fp"]).filter("l < r").select("l", "r"))
            found.append(many.filter("id <> one").select(F.col("one").alias("l"), F.col("id").alias("r")))
            rest = stage.write(alike.select("key", F.col("one").alias("id"), F.lit(-(2**63)).cast("bigint").alias("last")))
        else:
            rest = rest.join(state, ["key", "id"])
        if level == levels:
            found.append(_every_pair(rest.select("key", "id"), 2_000))
            break
        wider = rest.join(parts.select("id", F.explode("parts").alias("part")), "id").filter("part > last")
        state = stage.write(wider.select("id", F.xxhash64("key", "part").alias("key"), F.col("part").alias("last")))
        rows = state
    pairs = out.write(reduce(DataFrame.unionByName, found).distinct())
    stage.close()
    return pairs


# likeness of pairs


def with_profiles(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(l, r, c1.., c2..) for pairs of ids."""
    left = profiles.select(F.col("id").alias("l"), *(F.col(x).alias(f"{x}1") for x in PROFILE))
    right = profiles.select(F.col("id").alias("r"), *(F.col(x).alias(f"{x}2") for x in PROFILE))
    return pairs.join(left.hint("shuffle_hash"), "l").join(right.hint("shuffle_hash"), "r")


def _single(x: str) -> Column:
    return ~F.col(f"{x}1").contains(";") & ~F.col(f"{x}2").contains(";")


def _missing(x: str) -> Column:
    return (F.col(f"{x}1") == "") | (F.col(f"{x}2") == "")


def _spellings(c: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(";"), F.lit(""))) + 1


def _with_birthday_parts(both: DataFrame) -> DataFrame:
    """Adds what :func:`_decided_birthday` compares, each once a pair: years between, and which parts agree."""
    b1, b2 = F.col("b1"), F.col("b2")
    month, day = [F.substring(x, 5, 2) for x in (b1, b2)], [F.substring(x, 7, 2) for x in (b1, b2)]
    return both.withColumns(
        {
            "_apart": F.abs(F.left(b1, F.lit(4)).try_cast("int") - F.left(b2, F.lit(4)).try_cast("int")),
            "_month": month[0] == month[1],
            "_day": day[0] == day[1],
            "_late": (day[0] >= "28") & (day[1] >= "28"),
            "_swapped": (month[0] == day[1]) & (day[0] == month[1]),
        }
    )


def _decided_birthday() -> Column:
    """Likeness of two single birthdays."""
    apart, month, day = (F.col(x) for x in ("_apart", "_month", "_day"))
    return (
        F.when(month & day & ((apart == 1) | (apart % 10 == 0)), 80)
        .when((apart == 1) & month & F.col("_late"), 80)
        .when((apart == 0) & F.col("_swapped"), 80)
        .when((month & day) | ((apart == 0) & (month | day)), 50)
        .when(apart == 0, 20)
        .otherwise(0)
    )


def decided_likeness(pairs: DataFrame, profiles: DataFrame):
    """What equality or arithmetic decides of (name, phone, email, birthday), and a function that adds the rest.

    The likenesses are in hundredths, -1 where missing, null where open.  The function
    takes the pairs and a condition; only open values of pairs that meet it travel to
    Python.  ``n_<likeness>`` tells how many pairs of spellings had the chance to agree.
    """
    spark = profiles.sparkSession
    sounds = spark.sparkContext.broadcast(pinyin_table(spark))  # one entry for each ideograph of the basic block
    both = _with_birthday_parts(with_profiles(pairs, profiles))  # in steps: one expression for all is too large for the JVM to compile
    equal = {x: F.col(f"{x}1") == F.col(f"{x}2") for x in PROFILE}
    name = F.when(equal["c"] & (F.length("c1") > 1), 100).when(_missing("c") & _missing("e"), MISSING)
    phone = F.when(_missing("p"), MISSING).when(equal["p"], 100).when(_single("p"), 0).otherwise(F.when(F.arrays_overlap(F.split("p1", ";"), F.split("p2", ";")), 100).otherwise(0))
    stem = [F.left(x, F.greatest(F.length(x) - 1, F.lit(0))) for x in (F.col("m1"), F.col("m2"))]
    email = F.when(_missing("m"), MISSING).when(equal["m"], 100).when(_single("m"), F.when(stem[0] == stem[1], 60)).when(F.arrays_overlap(F.split("m1", ";"), F.split("m2", ";")), 100)
    birthday = F.when(_missing("b"), MISSING).when(equal["b"], 100).when(_single("b"), _decided_birthday()).when(F.arrays_overlap(F.split("b1", ";"), F.split("b2", ";")), 100)
    several = [(_spellings(f"{x}1") * _spellings(f"{x}2")).alias(f"n_{f}") for x, f in (("p", "phone"), ("m", "email"), ("b", "birthday"))]
    # romanised spellings are mostly variants of each other, so fewer of them count
    several.append(F.when(_missing("c"), F.sqrt(_spellings("e1") * _spellings("e2"))).otherwise(_spellings("c1") * _spellings("c2")).alias("n_name"))
    texts = [f"{x}{i}" for x in "cemb" for i in (1, 2)]
    decided = both.select("l", "r", *several, *texts, name.alias("name"), phone.alias("phone"), email.alias("email"), birthday.alias("birthday"))

    def rest(df: DataFrame, asked: Column) -> DataFrame:
        of = {"c": "name", "e": "name", "m": "email", "b": "birthday"}
        slim = df.select(*(c for c in df.columns if c not in texts), *(F.when(asked & F.col(of[t[0]]).isNull(), F.col(t)).alias(f"_{t}") for t in texts))
        scored = slim.withColumn("_open", open_likeness(sounds)(*(F.col(f"_{t}") for t in texts))).drop(*(f"_{t}" for t in texts))
        return scored.withColumns({f: F.coalesce(F.col(f), F.col("_open")[f]).cast("smallint") for f in ("name", "email", "birthday")})

    return decided, rest


def pair_likeness(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(l, r, name, phone, email, birthday) in hundredths, -1 where missing."""
    decided, rest = decided_likeness(pairs, profiles)
    return rest(decided, F.lit(True)).select("l", "r", "name", F.col("phone").cast("smallint").alias("phone"), "email", "birthday")


def row_pairs(links: DataFrame, profiles: DataFrame, master: DataFrame) -> DataFrame:
    """(left_record, right_record), smaller first, of all rows of linked registrations.

    ``links`` (l, r) are ids of ``profiles``, each pair once.
    """
    wanted = links.select(F.explode(F.array("l", "r")).alias("id")).distinct()
    named = profiles.select("id", "source", "ccd_source_key").join(wanted.hint("shuffle_hash"), "id", "left_semi")
    rows = master.select("record_id", "source", "ccd_source_key").join(named.hint("shuffle_hash"), ["source", "ccd_source_key"]).select("id", "record_id")
    a = rows.select(F.col("id").alias("l"), F.col("record_id").alias("a"))
    b = rows.select(F.col("id").alias("r"), F.col("record_id").alias("b"))
    pairs = links.join(a, "l").join(b, "r").filter("a <> b")
    return pairs.select(F.least("a", "b").alias("left_record"), F.greatest("a", "b").alias("right_record"))
