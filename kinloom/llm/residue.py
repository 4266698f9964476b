"""Problem 10: text that is template residue, filler, an error page or a notice about scripts.

A text is cut into segments (lines and sentences).  A multi-pattern automaton finds
all phrases of the lists below in one pass over a segment; what they cover is held
against the letters of the segment that mean anything.  A segment nearly covered is
residue.  One that only speaks of such things is covered little, and an unfilled
slot in a segment that speaks of templates, drafts or the like is no residue.
Filler in no language at all is told by how its words fall into tokens of a public
tokenizer.  A text with any residue segment is excluded.
"""

from __future__ import annotations

from functools import cache, lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, FloatType

from kinloom.llm.tokens import default_vocabulary, tokenizer

#: Phrases of error pages.
ERROR = (
    "bad gateway", "bad request", "unauthorized", "forbidden", "not found", "page not found", "file not found", "method not allowed",
    "not allowed", "request timeout", "request timed out", "gateway timeout", "gateway timed out", "too many requests", "too many calls",
    "internal error", "internal server error", "server error", "service unavailable", "service temporarily unavailable", "server busy",
    "no such record", "no such page", "upstream did not answer", "record service did not answer", "connection refused", "connection reset",
    "connection to the database was lost", "could not connect to the database", "your session has expired", "session expired",
    "you do not have permission to open this page", "access denied", "permission denied", "something broke on our side", "something went wrong",
    "an unexpected error occurred", "an error occurred", "the page you asked for may have been moved or removed", "the page you requested could not be found",
    "this page is not available", "traceback (most recent call last)", "valueerror", "keyerror", "typeerror", "nullpointerexception", "stack trace", "empty response",
    "找不到網頁", "找不到您要的網頁", "找不到頁面", "找不到该页面", "页面不存在", "頁面不存在", "伺服器沒有回應", "服务器没有响应", "服务器内部错误", "伺服器內部錯誤", "伺服器錯誤",
    "服务器错误", "系統繁忙", "系统繁忙", "請稍後再試", "请稍后再试", "登入逾時", "登录超时", "請重新登入", "请重新登录", "連線逾時", "连接超时", "沒有權限", "没有权限", "拒絕存取", "拒绝访问",
)
#: Phrases that come with them and prove nothing alone.
ERROR_SUPPORT = (
    "http", "error", "status", "code", "request id", "gateway", "return to the start page", "please try again in a few minutes", "please try again later",
    "contact the administrator if this happens again", "contact the administrator", "if the problem persists", "in run_match", "file", "line", "worker",
    "如問題持續", "如问题持续", "請聯絡管理員", "请联系管理员", "返回主頁", "返回首页", "编号", "編號", "錯誤", "错误",
)
#: Phrases of notices that scripts are required.
SCRIPTS = (
    "javascript", "scripts", "scripting", "active content", "noscript", "the evidence panel cannot be drawn", "your browser is too old to show this form",
    "啟用 javascript", "启用 javascript", "指令碼", "脚本", "腳本", "cookie 及 javascript", "cookie 和 javascript",
)
SCRIPTS_SUPPORT = (
    "to go on", "you must first", "please", "kindly", "before you continue", "turn on", "switch on", "switched on", "activate", "enable", "allow", "permit", "cookies",
    "in your browser", "your browser", "for this site", "reload", "sign in again", "then", "to see the record", "to view this page", "to continue", "the form cannot be shown without it",
    "see the settings of your browser", "this form needs", "this app cannot start until", "this page needs", "has switched them off", "must be allowed before the record can be shown",
    "is required", "are required", "is allowed", "are off", "is disabled", "are disabled", "upgrade it", "reload after changing your settings", "after changing your settings", "first", "needs", "requires", "page", "site",
    "如要繼續", "如要继续", "請先", "请先", "請", "请", "你必須", "您必須", "你必须", "開啟", "打開", "打开", "启用", "啟用", "允許", "允许", "瀏覽器的", "浏览器的", "您的浏览器", "您的瀏覽器", "瀏覽器", "浏览器",
    "功能", "否則無法顯示表格", "否则无法显示表格", "才能查看记录", "才能查看記錄", "後重新載入", "后重新加载", "以檢視此頁", "以查看此页", "未启用", "未啟用", "无法显示此页", "無法顯示此頁",
    "本頁需要", "本页需要", "才能顯示內容", "才能显示内容", "cookie", "及", "和",
)
#: Filler typed or generated in place of content.
FILLER = (
    "lorem ipsum", "dolor sit amet", "consectetur", "adipiscing elit", "sed do eiusmod", "tempor incididunt", "ut labore et dolore", "magna aliqua",
    "sample paragraph", "sample text", "replace before use", "heading one", "subheading", "body text", "body copy goes here", "about three lines", "type your note here",
    "text to follow", "test test", "asdf", "qwer", "qwerty", "placeholder text", "dummy text", "insert text here", "your text here", "content goes here", "to be completed",
    "此處輸入內容", "此处输入内容", "示例文字", "示範文字", "請替換", "请替换", "測試測試", "测试测试", "在此輸入文字", "在此输入文字", "內容待補", "内容待补", "標題一", "标题一",
)
#: Page furniture that surrounds such pages: it counts as covered and proves nothing.
FURNITURE = ("html", "head", "title", "body", "h1", "home", "records", "runs", "help", "skip to content", "sign in", "主頁", "記錄", "說明")
#: Words that say nothing for or against; they count neither way.
NEUTRAL = frozenset("a an the and or of to in on for is are was be it your this that with as at by".split())
#: Words of sentences that speak of templates, drafts and pages instead of being them.
SPEAKS_OF = regex.compile(
    r"template|\bdraft|stand-in|\bslot\b|\bproof\b|line reading|began with|unfilled|placeholder|export script|was renamed|is filled from|wording|layout|old form|[範范]本|草稿|初稿|模板|佔位|占位|字[樣样]",
    regex.I,
)
_NAME = r"[\p{L}_][\p{L}\p{N}_ .]{0,40}"
#: Unfilled slots in the usual template notations, and values printed by a failed filling.
SLOT = regex.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\{{%\s*{_NAME}\s*%\}}|\$\{{\s*{_NAME}\s*\}}|\[\[\s*{_NAME}\s*\]\]|<<\s*{_NAME}\s*>>|«\s*{_NAME}\s*»|##{_NAME}##"
    rf"|%\({_NAME}\)s|\$?%[\p{{L}}_]+%|__[\p{{L}}][\p{{L}}\p{{N}} _]{{0,38}}__|@@[\p{{L}}_]+|<(?:your|insert|enter|client|the) [^<>\n]{{1,40}}>|\[(?:insert|your|enter)\b[^\[\]\n]{{1,40}}\]|\[[^\[\]\n]{{1,40}} here\]"
    r"|\{\d\}|\[[\p{Han}]{1,12}\]X{2,}|【[請请]填[寫写][^【】\n]{1,12}】|〔[^〔〕\n]{1,12}待填〕|[(（]在此[輸输]入[^()（）\n]{1,12}[)）]|○{2,}[\p{Han}]{0,6}|_{3,}"
    r"|\[object Object\]|\bNaN/NaN|\bInvalid Date\b|\bNone None\b|\b(?:Phone|Birthday|Client|Name|Email): (?:None|NaT|NaN|null|undefined)\b|\bDear (?:undefined|null|None)\b|\bvisiting (?:null|undefined)\b"
    r"|\bX{4,}(?: X{4,})*\b|\b(?:xxxx?x? ){2,}",
    regex.I,
)
_QUOTED = regex.compile(r"'[^'\n]{1,60}'|‘[^’\n]{1,60}’|「[^」\n]{1,60}」|\"[^\"\n]{1,60}\"")
_SEGMENT = regex.compile(r"[^\r\n.!?。！？]*(?:[.!?](?!\s|$|</)[^\r\n.!?。！？]*)*[.!?。！？]*")
_WORD = regex.compile(r"\p{Han}|[\p{L}\p{M}]+(?:[\p{N}_-]*\p{N}[\p{L}\p{N}_-]*)?|[\p{N}][\p{L}\p{N}_-]*")
_LOWER = regex.compile(r"(?<![\p{L}\p{N}_@#$%{<\[/-])\p{Ll}{3,}(?![\p{L}\p{N}_@}>\]/])")
#: Share of a segment's letters that phrases must cover.
COVERED = 0.8
#: Least number of words, and most of them that are single tokens, of text in no language.
NO_LANGUAGE_WORDS, NO_LANGUAGE_KNOWN = 4, 0.4


@cache
def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for proves, phrases in ((True, (*ERROR, *FILLER)), (False, (*ERROR_SUPPORT, *SCRIPTS_SUPPORT, *FURNITURE)), (True, SCRIPTS)):
        for p in phrases:
            machine.add_word(p, (len(p), proves or (p in machine and machine.get(p)[1])))
    machine.make_automaton()
    return machine


def segments(text: str) -> list[str]:
    """Lines and sentences, without white space around them; nothing but white space is no segment."""
    return [s for m in _SEGMENT.finditer(text) if (s := m[0].strip())]


def coverage(segment: str) -> tuple[float, bool]:
    """Share of the telling letters of ``segment`` that phrases cover, and whether one of them proves residue."""
    low = segment.lower().replace("，", ",")
    if len(low) != len(segment):  # a few letters change length in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in segment)
    covered = bytearray(len(low))
    proof = False
    for end, (length, proves) in _automaton().iter(low):
        start = end - length + 1
        if low[start].isascii() and (start and low[start - 1].isalpha() or end + 1 < len(low) and low[end + 1].isalpha() and low[end + 1].isascii()):
            continue  # inside a longer word
        covered[start : end + 1] = b"\1" * length
        proof = proof or proves
    if not proof:
        return 0.0, False
    total = hit = 0
    for m in _WORD.finditer(low):
        word = m[0]
        if any(c.isdigit() for c in word):
            continue  # numbers and codes say nothing
        own = sum(covered[m.start() : m.end()])
        if own == 0 and word in NEUTRAL:
            continue
        total += len(word)
        hit += own
    return (hit / total if total else 0.0), proof


@lru_cache(200_000)
def _one_token(word: str, vocabulary: tuple[str, str]) -> bool:
    return len(tokenizer(*vocabulary).encode(" " + word)) == 1


def _no_language(segment: str, vocabulary: tuple[str, str]) -> bool:
    """Most lower-case words fall into several tokens, as those of no common language do."""
    words = _LOWER.findall(segment)
    if len(words) < NO_LANGUAGE_WORDS:
        return False
    known = sum(_one_token(w, vocabulary) for w in words)
    return known <= NO_LANGUAGE_KNOWN * len(words)


def residue_kind(segment: str, vocabulary: tuple[str, str]) -> str | None:
    """``slot``, ``phrase`` or ``no language`` of a residue segment, else None."""
    if SLOT.search(segment) and not SPEAKS_OF.search(segment):
        outside = _QUOTED.sub(" ", segment)
        if SLOT.search(outside):
            return "slot"
    share, proof = coverage(segment)
    if proof and share >= COVERED:
        return "phrase"
    return "no language" if _no_language(segment, vocabulary) else None


def residue_share(text: str | None, vocabulary: tuple[str, str]) -> float:
    """Share of a text's characters (without white space around segments) in residue segments; 0 without any."""
    if not text:
        return 0.0
    parts = segments(text)
    total = sum(map(len, parts))
    return sum(len(s) for s in parts if residue_kind(s, vocabulary)) / total if total else 0.0


def has_residue(text: Column, vocabulary: tuple[str, str] | None = None) -> Column:
    """True when some segment is residue; false for null, empty and blank text.  Whole texts are read."""
    vocabulary = vocabulary or default_vocabulary()

    def run(values: pa.Array) -> pa.Array:
        return pa.array([bool(v) and any(residue_kind(s, vocabulary) for s in segments(v)) for v in values.to_pylist()], pa.bool_())

    return F.arrow_udf(run, BooleanType())(text)


def share_of_residue(text: Column, vocabulary: tuple[str, str] | None = None) -> Column:
    vocabulary = vocabulary or default_vocabulary()

    def run(values: pa.Array) -> pa.Array:
        return pa.array([residue_share(v, vocabulary) for v in values.to_pylist()], pa.float32())

    return F.arrow_udf(run, FloatType())(text)


def residue_documents(documents: DataFrame) -> DataFrame:
    """doc_id of every document with residue; repeated rows come out as often as they stand."""
    return documents.filter(F.col("text").isNotNull() & has_residue(F.col("text"))).select("doc_id")


def without_residue(documents: DataFrame) -> DataFrame:
    """All documents but those with residue; null, empty and blank texts stay."""
    return documents.filter(~F.coalesce(has_residue(F.col("text")), F.lit(False)))
