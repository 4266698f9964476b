"""How alike two profiles of a person are: name, phone, e-mail and birthday, each in hundredths or missing.

A profile holds for every attribute all spellings seen, joined by ``;``: ``c`` Han
names (simplified), ``e`` romanised names (surname ``|`` given names), ``p`` phones,
``m`` local parts of e-mails without punctuation, ``b`` birthdays as yyyymmdd.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ShortType, StructField, StructType

from kinloom.functions.strings import lcs_length

MISSING = -1
#: Name agreement in hundredths by kind of Han agreement (rows) and of romanised agreement.
#: Han: equal, reordered, same sound, shortened, one character off, other, none at all on one side.
#: Romanised: A agree, P partly, I by initials, U unclear, X unlike, D disagree, - none on one side.
_NAME = {
    "equal": dict(zip("APIUXD-", (100, 100, 100, 100, 100, 100, 100), strict=True)),
    "reordered": dict(zip("APIUXD-", (95, 95, 95, 95, 90, 85, 95), strict=True)),
    "sound": dict(zip("APIUXD-", (95, 90, 85, 80, 80, 45, 80), strict=True)),
    "shortened": dict(zip("APIUXD-", (95, 90, 80, 70, 70, 40, 70), strict=True)),
    "off": dict(zip("APIUXD-", (95, 75, 50, 45, 45, 15, 45), strict=True)),
    "other": dict(zip("APIUXD-", (60, 30, 15, 10, 0, 0, 10), strict=True)),
    "none": dict(zip("APIUXD-", (95, 85, 65, 40, 10, 15, MISSING), strict=True)),
}
_HAN_RANK = ("none", "other", "off", "shortened", "sound", "reordered", "equal")
_ROMAN_RANK = "-XDUIPA"


@lru_cache(300_000)
def indel(a: str, b: str) -> float:
    """2 x longest common subsequence / total length."""
    return 1.0 if a == b else 2 * lcs_length(a, b) / (len(a) + len(b))


@lru_cache(300_000)
def _alike(x: str, y: str) -> float:
    """Likeness of two words: spelling, or a short form of the other."""
    if x == y:
        return 1.0
    if len(x) > 2 and len(y) > 2 and (x.startswith(y) or y.startswith(x)):
        return 0.9
    return indel(x, y) if len(x) > 1 and len(y) > 1 else 0.0


def _pair_off(a: list[str], b: list[str], least: float) -> int:
    """Take greedily out of both lists the words that are alike; how many."""
    n = 0
    for x in list(a):
        best, partner = least, None
        for y in b:
            s = _alike(x, y)
            if s >= best:
                best, partner = s, y
        if partner is not None:
            a.remove(x)
            b.remove(partner)
            n += 1
    return n


@lru_cache(300_000)
def romanised(a: str, b: str) -> str:
    """A agree, P partly, I by initials, U unclear, X unlike, D disagree in one given name while another agrees."""
    if a == b:
        return "A"
    surname_a, _, given_a = a.partition("|")
    surname_b, _, given_b = b.partition("|")
    left, right = f"{surname_a} {given_a}".split(), f"{surname_b} {given_b}".split()
    whole_a, whole_b = "".join(left), "".join(right)
    if whole_a == whole_b or sorted(left) == sorted(right):
        return "A"
    full = _pair_off(left, right, 0.74)
    initials = 0
    for x in list(left):
        for y in right:
            if (len(x) == 1 or len(y) == 1) and x[0] == y[0]:
                left.remove(x)
                right.remove(y)
                initials += 1
                break
    if not left and not right:
        return "A" if not initials else ("P" if full >= 2 else "I")
    if not left or not right:
        return "P" if full >= 2 or (full and initials) else ("I" if full or initials else "U")
    own_a = [x for x in left if len(x) > 1 and not (given_a and x in surname_a.split())]
    own_b = [x for x in right if len(x) > 1 and not (given_b and x in surname_b.split())]
    if full and own_a and own_b and indel("".join(own_a), "".join(own_b)) < 0.6:
        return "D"
    if indel(whole_a, whole_b) >= 0.8:
        return "P"
    if full and own_a and own_b:
        return "D"
    if full >= 2 and not (own_a and own_b):
        return "P"
    return "U" if full or initials else "X"


def han(a: str, b: str, sounds: dict[str, str]) -> str:
    """Kind of agreement of two Han names."""
    if a == b:
        return "equal" if len(a) > 1 else "off"
    if len(a) == len(b):
        if sorted(a) == sorted(b):
            return "reordered"
        differing = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        if len(a) > 1 and all(sounds.get(x, x) == sounds.get(y, y) for x, y in differing):
            return "sound"
        return "off" if len(differing) < len(a) else "other"
    short, long = (a, b) if len(a) < len(b) else (b, a)
    rest = iter(long)
    return "shortened" if all(x in rest for x in short) else ("off" if a[0] == b[0] else "other")


def _best(a: str, b: str, one, rank) -> str:
    """Highest of the kinds of agreement between the spellings of ``a`` and ``b``."""
    top, at = rank[-1], -1
    for x in a.split(";"):
        for y in b.split(";"):
            kind = one(x, y)
            if kind == top:
                return kind
            at = max(at, rank.index(kind))
    return rank[at]


def name(ca: str, cb: str, ea: str, eb: str, sounds: dict[str, str]) -> int:
    if ca == cb and len(ca) > 1:
        return 100
    h = "none"
    if ca and cb:
        if ";" in ca or ";" in cb:
            h = "equal" if any(len(x) > 1 for x in set(ca.split(";")).intersection(cb.split(";"))) else _best(ca, cb, lambda x, y: han(x, y, sounds), _HAN_RANK)
        else:
            h = han(ca, cb, sounds)
    if h == "equal":
        return 100
    if not ea or not eb:
        return _NAME[h]["-"]
    return _NAME[h][_best(ea, eb, romanised, _ROMAN_RANK) if ";" in ea or ";" in eb else romanised(ea, eb)]


@lru_cache(300_000)
def _one_birthday(a: str, b: str) -> int:
    ya, ma, da, yb, mb, db = int(a[:4]), a[4:6], a[6:], int(b[:4]), b[4:6], b[6:]
    apart = abs(ya - yb)
    if a[4:] == b[4:] and (apart == 1 or apart % 10 == 0):
        return 80
    if apart == 1 and ma == mb and int(da) >= 28 and int(db) >= 28:
        return 80
    if apart == 0 and (ma, da) == (db, mb):
        return 80
    if a[4:] == b[4:] or apart == 0 and (ma == mb or da == db):
        return 50
    return 20 if apart == 0 else 0


@lru_cache(300_000)
def _one_email(a: str, b: str) -> int:
    if a[:-1] == b[:-1]:
        return 60
    return 40 if indel(a, b) >= 0.8 else 0


def _several(a: str, b: str, one) -> int:
    return max(100 if x == y else one(x, y) for x in a.split(";") for y in b.split(";"))


_OPEN = StructType([StructField(x, ShortType()) for x in ("name", "email", "birthday")])


def open_likeness(sounds):
    """Column function of (c1, c2, e1, e2, m1, m2, b1, b2): a struct of the likenesses whose inputs are not null.

    Inputs are null where a pair is decided already.  ``sounds`` is a broadcast table
    from ideograph to syllable.
    """

    def run(c1: pa.Array, c2: pa.Array, e1: pa.Array, e2: pa.Array, m1: pa.Array, m2: pa.Array, b1: pa.Array, b2: pa.Array) -> pa.Array:
        table = sounds.value
        names = [None if w is None else name(w, x, y, z, table) for w, x, y, z in zip(c1.to_pylist(), c2.to_pylist(), e1.to_pylist(), e2.to_pylist(), strict=True)]
        emails = [None if x is None else _several(x, y, _one_email) for x, y in zip(m1.to_pylist(), m2.to_pylist(), strict=True)]
        days = [None if x is None else _several(x, y, _one_birthday) for x, y in zip(b1.to_pylist(), b2.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(x, pa.int16()) for x in (names, emails, days)], names=["name", "email", "birthday"])

    return F.arrow_udf(run, _OPEN)
