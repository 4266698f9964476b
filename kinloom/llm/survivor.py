"""Problem 3: the best value of every field of a group of duplicate rows.

:func:`best_values` chooses by priority: the greatest of trust, time and record id.
:func:`voted_values` weighs rows: the values of a group are aligned progressively,
token by token; each column of the alignment is decided by a weighted vote; the
existing value closest to that consensus survives, so lesser values that agree
outvote a better one.  (With weights that double from value to value the vote could
never turn against the best one; a choice by priority needs no vote.)
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from kinloom.functions.normalize import birthday_date, email, fold_width
from kinloom.sources.stage import Stage

#: Rows of one group that one aggregation buffer holds; larger groups are split and merged in rounds.
GROUP_BOUND = 512
#: Numbers typed in place of an unknown one, besides those of one digit only.
DUMMY_PHONES = ("12345678", "87654321", "01234567", "23456789", "98765432")
_TOKENS = re.compile(r"[^\W\d_]+|\d|[\W_]")


def usable_phone(c: Column) -> Column:
    """Eight local digits after dropping separators and the prefix 852, no evident dummy; else null."""
    bare = F.translate(fold_width(c), " \t\n\x0b\f\r()+.-", "")
    local = F.regexp_extract(bare, r"^(?:(?:00)?852)?(\d{8})$", 1)
    return F.when((local != "") & ~local.isin(*DUMMY_PHONES) & ~local.rlike(r"^(\d)\1{7}$"), local)


def usable_email(c: Column) -> Column:
    """One @ with something before it and a dot in the domain; else null."""
    return F.when(~F.trim(c).startswith("@"), email(c))


def usable_birthday(c: Column, modified: Column) -> Column:
    """A real date from 1930 on and not after ``modified`` (any, where that is null); else null."""
    day = birthday_date(c)
    return F.when((day >= F.lit("1930-01-01").cast("date")) & (day <= F.coalesce(modified.cast("date"), F.lit("9999-12-31").cast("date"))), day)


def tokens(value: str) -> list[str]:
    """Words, single digits and single other characters."""
    return _TOKENS.findall(value)


def _align(profile: list[dict[str, int]], ranks: list[str | None], value: list[str], weight: int) -> tuple[list[dict[str, int]], list[str | None]]:
    """Merge ``value`` into the columns of ``profile`` by global alignment against its leading tokens."""
    n, m = len(profile), len(value)
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        cost[i][0] = i
    cost[0] = list(range(m + 1))
    for i in range(1, n + 1):
        row, above, lead = cost[i], cost[i - 1], ranks[i - 1]
        for j in range(1, m + 1):
            row[j] = min(above[j - 1] + (0 if lead == value[j - 1] else 1), above[j] + 1, row[j - 1] + 1)
    i, j, columns = n, m, []
    total = sum(profile[0].values()) if profile else 0
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (0 if ranks[i - 1] == value[j - 1] else 1):
            i, j = i - 1, j - 1
            column = profile[i]
            column[value[j]] = column.get(value[j], 0) + weight
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            column = profile[i]
            column[""] = column.get("", 0) + weight
        else:
            j -= 1
            column = {"": total, value[j]: weight}
        columns.append(column)
    columns.reverse()
    return columns, [max(c, key=c.get) for c in columns]


def _distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def consensus_index(values: list[str], weights: list[int] | None = None) -> int:
    """Index of the value closest to the weighted token consensus of ``values`` (best first).

    Without ``weights`` they double from one value to the next better one.
    """
    weights = weights or [1 << (len(values) - k) for k in range(len(values))]
    parts = [tokens(v) for v in values]
    profile: list[dict[str, int]] = [{t: weights[0]} for t in parts[0]]
    lead: list[str | None] = list(parts[0])
    for part, weight in zip(parts[1:], weights[1:], strict=True):
        profile, lead = _align(profile, lead, part, weight)
    consensus = [t for t in lead if t]
    return min(range(len(parts)), key=lambda k: (_distance(parts[k], consensus), k))


@F.arrow_udf(IntegerType())
def _weighted_consensus(groups: pa.Array, weights: pa.Array) -> pa.Array:
    return pa.array([None if g is None else consensus_index(g, w) for g, w in zip(groups.to_pylist(), weights.to_pylist(), strict=True)], pa.int32())


def best_values(df: DataFrame, keys: list[str], record_id: str, time: str, fields: dict[str, tuple[Column, Column]], *, group_bound: int = GROUP_BOUND) -> DataFrame:
    """``<field>_from`` for each group of at least two rows: ``record_id`` of the row whose value survives.

    ``fields`` gives for each field its usable value (null when unusable) and a
    trust rank; the higher trust, then the later ``time``, then the greater
    ``record_id`` goes first.  ``''`` stands for a group without usable value.
    Rows with a null key belong to no group; null times go last; repeated rows
    count as rows; an empty table gives an empty result.  The greatest is taken
    map-side, so groups of any size need no parts, whatever ``group_bound``.
    """
    at = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(2**62)))
    states = (F.when(v.isNotNull(), F.struct(trust.alias("t"), at.alias("us"), F.col(record_id).alias("id"))).alias(f"_{f}") for f, (v, trust) in fields.items())
    rows = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys, *states)
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.max(f"_{f}").alias(f"_{f}") for f in fields)).filter("_n > 1")
    return groups.select(*keys, *(F.coalesce(F.col(f"_{f}")["id"], F.lit("")).alias(f"{f}_from") for f in fields))


def surviving_contacts(master: DataFrame) -> DataFrame:
    """The surviving phone, e-mail and birthday of every registration delivered more than once."""
    none = F.lit(0)
    return best_values(
        master.select("source", "ccd_source_key", "record_id", "modified", "phone_num", "email", "birthday", "id_checked"),
        ["source", "ccd_source_key"],
        "record_id",
        "modified",
        {
            "phone": (usable_phone(F.col("phone_num")), none),
            "email": (usable_email(F.col("email")), none),
            "birthday": (usable_birthday(F.col("birthday"), F.col("modified")), F.coalesce((F.col("id_checked") == 1).cast("int"), none)),
        },
    )


def voted_values(df: DataFrame, keys: list[str], record_id: str, time: str, fields: dict[str, tuple[Column, Column]], *, group_bound: int = GROUP_BOUND) -> DataFrame:
    """(keys, field, value, weight, of): for each group and field the existing value closest to the token consensus of all its rows.

    Every row votes for its usable value with its weight (``fields`` gives the value,
    null when unusable, and the weight), so several lesser values that agree in a
    token outvote a better one.  Equal values vote together before anything is
    gathered.  Values are aligned from the heaviest to the lightest; ties go to the
    later ``time``, then the greater ``record_id``.  Where a group has more than
    ``group_bound`` different values, parts of it vote first and their winners vote
    with the weight of their part.  ``weight`` is that of the value itself, ``of``
    that of all values.  Null keys belong to no group; groups without usable value
    and empty tables give no rows.
    """
    stage = Stage(df.sparkSession, "vote")
    at = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(2**62)))
    votes = F.array(*(F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"), w.cast("bigint").alias("w")) for f, (v, w) in fields.items()))
    rows = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys, at.alias("us"), F.col(record_id).alias("id"), F.explode(votes).alias("x"))
    by = [*keys, "field"]
    values = rows.select(*keys, "us", "id", "x.*").filter("value IS NOT NULL").groupBy(*by, "value").agg(F.sum("w").alias("w"), F.max(F.struct("us", "id")).alias("best"))
    values = stage.write(values.withColumn("own", F.col("w")))
    while True:
        sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        salt = F.pmod(F.xxhash64("value"), F.ceil(F.col("n") / group_bound)) if most > group_bound else F.lit(0)
        parted = values.join(sizes, by).withColumn("part", salt) if most > group_bound else values.withColumn("part", salt)
        groups = parted.groupBy(*by, "part").agg(F.sort_array(F.collect_list(F.struct("w", "best", "value", "own")), asc=False).alias("g"))
        chosen = F.when(F.size("g") > 1, _weighted_consensus(F.when(F.size("g") > 1, F.col("g")["value"]), F.when(F.size("g") > 1, F.col("g")["w"]))).otherwise(0)
        winner = F.get("g", chosen)
        total = F.aggregate(F.col("g")["w"], F.lit(0).cast("bigint"), lambda a, x: a + x)
        won = groups.select(*by, winner.alias("v"), total.alias("w")).select(*by, "v.value", "w", "v.best", "v.own")
        if most <= group_bound:
            return won.select(*by, "value", F.col("own").alias("weight"), F.col("w").alias("of"))
        values = stage.write(won)


def consensus_contacts(master: DataFrame) -> DataFrame:
    """Phone, e-mail and birthday of every registration by the vote of all its rows; a birthday from a seen document counts threefold."""
    one = F.lit(1)
    return voted_values(
        master.select("source", "ccd_source_key", "record_id", "modified", "phone_num", "email", "birthday", "id_checked"),
        ["source", "ccd_source_key"],
        "record_id",
        "modified",
        {
            "phone": (usable_phone(F.col("phone_num")), one),
            "email": (usable_email(F.col("email")), one),
            "birthday": (usable_birthday(F.col("birthday"), F.col("modified")), F.when(F.col("id_checked") == 1, 3).otherwise(1)),
        },
    )
