"""Character tables, generated from Unicode properties by rule."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import SparkSession

#: Code points that show nothing: soft hyphen, joiners, marks of direction, fillers, selectors.
INVISIBLE_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
)
#: Twelve code points of the compatibility block that are unified ideographs nevertheless.
UNIFIED_IN_COMPAT = (0xFA0E, 0xFA0F, 0xFA11, 0xFA13, 0xFA14, 0xFA1F, 0xFA21, 0xFA23, 0xFA24, 0xFA27, 0xFA28, 0xFA29)
#: Blocks of unified ideographs, with the iteration mark and the zero written among them.
HAN_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2EE5D), (0x30000, 0x323AF), (0x3005, 0x3005), (0x3007, 0x3007))
#: Letters of other scripts that look like Latin ones, and the Latin letters they show.
LOOKALIKES = (
    # Cyrillic capitals
    ("АВЕЅІЈКМНОРСТУҮХԌԚԜҺӀЗ", "ABESIJKMHOPCTYYXGQWHI3"),
    # Cyrillic small letters
    ("аеѕіјкорсухһԁԛԝҽґӏүг", "aesijkopcyxhdqwerlyr"),
    # Greek capitals
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺͿ", "ABEZHIKMNOPTYXCMJ"),
    # Greek small letters
    ("αικνορτυχϲϳγ", "aiknoptuxcjy"),
    # letters of the phonetic alphabet, small capitals and dotless forms
    ("ɑɡıȷɩʏʀɴʟɪʜɢʙᴀᴄᴅᴇᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢꜱ", "agijiYRNLIHGBACDEJKMOPTUVWZS"),
    # Armenian, Cherokee and Lisu letters
    ("ՕՍՏօոսցհ", "OUSonugh"),
    ("ᎪᏴᏟᎠᎬᎻᎥᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᎩᏃ", "ABCDEHiJKLMPRSTVWYZ"),
    ("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴꓟ", "BPdDTGKJCZFNLSRVHWXYAEIOUM"),
)
#: Radicals without a decomposition, and Kana and symbols among ideographs, with the ideographs they show.
HAN_LOOKALIKES = (
    ("⻢⻩⻰⻋⻄⻁⻉⻅⻨⻬⻘⻔⻚⻛⻜⻥⻦⻳⺟⺠⻆⻝⻤⺁⺄⺩⺼⻒⻖⻣⻌", "马黄龙车西虎贝见麦齐青门页风飞鱼鸟龟母民角食鬼厂乙王月力阝骨辶"),
    ("ロニハカタエトー〡", "口二八力夕工卜一丨"),
)
#: Dashes and apostrophes shown as the plain ones.
DASHES = "‐‑‒–—―−⁃˗﹘﹣－"
APOSTROPHES = "‘’ʼʹ′＇´`ʻ"


def _chars(ranges) -> list[str]:
    return [chr(c) for a, b in ranges for c in range(a, b + 1)]


@cache
def lookalikes() -> dict[str, str]:
    """Letters of other scripts to the Latin letters they show."""
    out = {}
    for shown, plain in LOOKALIKES:
        out.update(zip(shown, plain, strict=False))
    return out


@cache
def han_lookalikes() -> dict[str, str]:
    out = {}
    for shown, plain in HAN_LOOKALIKES:
        out.update(zip(shown, plain, strict=False))
    return out


@cache
def ordinary_latin_ranges() -> tuple[tuple[int, int], ...]:
    """Latin letters in one piece and of normal width: stable under NFKC and not look-alikes."""
    alike, out = lookalikes(), []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(c)
        if not (unicodedata.category(ch)[0] == "L" and unicodedata.name(ch, "").startswith("LATIN")) or unicodedata.normalize("NFKC", ch) != ch or ch in alike:
            continue
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return tuple((a, b) for a, b in out)


@cache
def ordinary_class() -> str:
    """Inside of a regular-expression class (Java, Python, RE2) of the characters that are what they show."""
    spans = [(0x20, 0x7E), *ordinary_latin_ranges(), *HAN_RANGES, *((c, c) for c in UNIFIED_IN_COMPAT)]
    return "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for a, b in spans)


def _translate(table: dict[str, str | None]) -> tuple[str, str]:
    """Arguments of SQL ``translate``: characters mapped to None are dropped."""
    kept = {k: v for k, v in table.items() if v is not None}
    gone = [k for k, v in table.items() if v is None]
    return "".join(kept) + "".join(gone), "".join(kept.values())


@cache
def latin_fold() -> tuple[str, str]:
    """``translate`` arguments that bring Latin text to unaccented lower-case letters of normal width.

    Look-alikes become the letters they show, combining marks and invisible
    characters go, every space becomes the plain one, dashes become hyphens.
    """
    table: dict[str, str | None] = {}
    for c in [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0xA0, 0xC0), *range(0x2000, 0x2010), 0x202F, 0x205F, 0x3000]:
        ch = chr(c)
        flat = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)).lower()
        if len(flat) == 1 and flat != ch:
            table[ch] = flat
    table.update({"ı": "i", "ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ł": "l", "Ł": "l", "ß": "s"})
    table.update({a: b.lower() for a, b in lookalikes().items()})
    table.update(dict.fromkeys(DASHES, "-"))
    for c in [*range(0x300, 0x370), *(ord(x) for x in _chars(INVISIBLE_RANGES[:-1]))]:
        table[chr(c)] = None
    return _translate(table)


@cache
def han_fold() -> tuple[str, str]:
    """``translate`` arguments that bring compatibility forms of ideographs to the unified ones."""
    table: dict[str, str | None] = dict(han_lookalikes())
    for c in [*range(0x2E80, 0x2FD6), *range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)]:
        flat = unicodedata.normalize("NFKC", chr(c))
        if len(flat) == 1 and flat != chr(c):
            table[chr(c)] = flat
    for ch in _chars(INVISIBLE_RANGES[:-1]):
        table[ch] = None
    return _translate(table)


@cache
def width_fold() -> tuple[str, str]:
    """``translate`` arguments from full-width ASCII and the ideographic space to the plain forms."""
    return _translate({chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"　": " ", " ": " "})


_ICU: dict[str, object] = {}


def simplified_table(spark: SparkSession) -> tuple[str, str]:
    """``translate`` arguments from Traditional to Simplified, from the ICU rules Spark ships (driver only)."""
    if "hans" not in _ICU:
        text = "".join(chr(c) for c in range(0x4E00, 0xA000))
        out = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate(text)
        if len(out) != len(text):
            raise ValueError("the Traditional-Simplified rules are expected to map one character to one")
        pairs = [(a, b) for a, b in zip(text, out, strict=True) if a != b]
        _ICU["hans"] = ("".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return _ICU["hans"]  # type: ignore[return-value]


def pinyin_table(spark: SparkSession) -> dict[str, str]:
    """Ideograph to toneless syllable, from the ICU rules Spark ships (driver only; about 21,000 entries)."""
    if "pinyin" not in _ICU:
        text = [chr(c) for c in range(0x4E00, 0xA000)]
        out = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; Latin-ASCII; Lower").transliterate("\n".join(text))
        _ICU["pinyin"] = {a: b.strip() for a, b in zip(text, out.split("\n"), strict=True) if b.strip() and b.strip() != a}
    return _ICU["pinyin"]  # type: ignore[return-value]


assert sys.maxunicode == 0x10FFFF
