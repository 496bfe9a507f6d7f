"""Scalar text functions as Spark columns.

White space is one explicit class everywhere, because engines disagree on
``\\s``: ASCII white space, no-break and ideographic spaces, and the byte order
mark. Word borders are explicit ASCII lookarounds.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the white space class.
SPACES = "\t\n\x0b\f\r" + "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
WS = f"[{SPACES}]"
#: Hyphens and dashes.
DASHES = r"\-" + "".join(map(chr, range(0x2010, 0x2016))) + chr(0x2212)
HAN = r"[一-龥]"
HAN_WIDE = r"[一-鿿]"
CLAUSE = "；"
WARNING = "⚠"
#: Fixed value: the marker of cut notes.
CUT_MARK = "⚠ 说明较多、已保留前若干条，其余从略——请查阅往次校对表并人工整理"
MOST_NOTES = 3
#: Phrases that name no concrete source.
VAGUE_SOURCES = ("网络搜索", "联网搜索", "公开资料", "公开信息", "常识", "据记忆", "模型知识", "未提供", "无来源", "搜索结果", "web search", "common knowledge")
DOMAIN = r"(?i)(?<![A-Za-z0-9_])https?://|(?<![A-Za-z0-9_])www\.|(?<![A-Za-z0-9_])[a-z0-9-]+\.(com|cn|org|net|gov|edu|io|co)(?![A-Za-z0-9_])"


def trim(s: Column) -> Column:
    """Both ends stripped of the white space class."""
    return F.regexp_replace(s, rf"\A{WS}+|{WS}+\z", "")


def content_length(s: Column) -> Column:
    """Han characters plus runs of ASCII letters and digits, in one pass."""
    return F.regexp_count(s, F.lit(f"{HAN}|[A-Za-z0-9]+")).cast("long")


def effective_size(chars: Column, size_bytes: Column, lines: Column) -> Column:
    """characters if known, else from bytes, else from lines."""
    by_bytes = F.when(F.coalesce(size_bytes, F.lit(0)) != 0, F.floor(size_bytes / 2.6 + 0.5))
    return F.coalesce(F.when(chars != 0, chars), by_bytes, F.floor(F.coalesce(lines, F.lit(0)) * 14 + 0.5)).cast("long")


def token_cap(n: Column) -> Column:
    """output tokens allowed for a text of n characters."""
    return F.least(F.lit(96000), F.greatest(F.lit(8000), F.ceil(n * 2.2) + 2048)).cast("long")


def longest_han_run(s: Column) -> Column:
    """F4."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit(f"{HAN_WIDE}+"), F.lit(0)), F.length)), F.lit(0)).cast("long")


def strip_description(s: Column) -> Column:
    """parenthesised remarks removed, then trimmed; null counts as empty."""
    return trim(F.regexp_replace(F.coalesce(s, F.lit("")), "[（(][^）)]*[）)]", ""))


def entity_worth(public: Column, cross_file: Column, variants: Column) -> Column:
    """F6."""
    on = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0)
    return (on(public, 4) + on(cross_file, 2) + on(F.size(variants) >= 2, 1)).cast("long")


def fold_width(s: Column) -> Column:
    """full-width ASCII to plain."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.translate(s, wide, "".join(chr(ord(c) - 0xFEE0) for c in wide))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark lacks."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def search_norm(s: Column) -> Column:
    """F8: compatibility form, without white space, lower case."""
    return F.lower(F.regexp_replace(nfkc(F.coalesce(s, F.lit(""))), WS, ""))


def slug(s: Column, fallback: str = "item") -> Column:
    """F9."""
    cleaned = F.regexp_replace(nfkc(F.coalesce(s, F.lit(""))), r"[^\p{L}\p{N}._-]+", "_")
    cleaned = F.substring(F.regexp_replace(cleaned, r"\A_+|_+\z", ""), 1, 96)
    return F.when(cleaned == "", fallback).otherwise(cleaned)


def safe_name(s: Column, most_chars: int = 80, most_bytes: int = 255) -> Column:
    """a file name: reserved characters to spaces, runs collapsed, outer
    dots and spaces cut, then capped in code points and in UTF-8 bytes without
    splitting a code point."""
    clean = F.regexp_replace(F.coalesce(s, F.lit("")), r'[\\/:*?"<>|\x00-\x1F]+', " ")
    clean = F.regexp_replace(clean, f"{WS}+", " ")
    edges = r"\A[. ]+|[. ]+\z"
    clean = F.substring(F.regexp_replace(clean, edges, ""), 1, most_chars)
    capped = F.aggregate(
        F.split(clean, ""), F.struct(F.lit("").alias("s"), F.lit(True).alias("room")),
        lambda acc, c: F.when(acc["room"] & (F.octet_length(F.concat(acc["s"], c)) <= most_bytes), F.struct(F.concat(acc["s"], c).alias("s"), F.lit(True).alias("room"))).otherwise(F.struct(acc["s"].alias("s"), F.lit(False).alias("room"))),
        lambda acc: acc["s"],
    )
    out = F.regexp_replace(F.when(F.octet_length(clean) <= most_bytes, clean).otherwise(capped), edges, "")
    return F.when(out == "", "untitled").otherwise(out)


def deliverable_name(title: Column, suffix: str) -> Column:
    """the suffix once."""
    return safe_name(F.when(F.endswith(title, F.lit(suffix)), title).otherwise(F.concat(title, F.lit(suffix))))


def title_from_path(path: Column) -> Column:
    """base name without extension and leading date."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.[^.]*\z", "")
    return F.regexp_replace(base, rf"\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(_|{WS})+", "")


def hint_clauses(h: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(h, F.lit("")), CLAUSE, -1), trim), lambda c: c != "")


def merge_hints(*hints: Column) -> Column:
    """A5: distinct clauses in order, warnings after notes, notes capped and marked."""
    clauses = F.array_distinct(F.concat(*map(hint_clauses, hints)))
    plain = F.filter(clauses, lambda c: ~F.contains(c, F.lit(WARNING)))
    warned = F.filter(clauses, lambda c: F.contains(c, F.lit(WARNING)) & (c != CUT_MARK))
    cut = F.array_contains(clauses, CUT_MARK) | (F.size(plain) > MOST_NOTES)
    return F.array_join(F.concat(F.slice(plain, 1, MOST_NOTES), warned, F.when(cut, F.array(F.lit(CUT_MARK))).otherwise(F.array().cast("array<string>"))), CLAUSE)


def trim_hint(h: Column, most: int = 36) -> Column:
    """the first plain clause, shortened, and all warnings."""
    clauses = hint_clauses(h)
    plain = F.filter(clauses, lambda c: ~F.contains(c, F.lit(WARNING)))
    warned = F.filter(clauses, lambda c: F.contains(c, F.lit(WARNING)))
    return F.array_join(F.concat(F.transform(F.slice(plain, 1, 1), lambda c: F.substring(c, 1, most)), warned), CLAUSE)


def occurrences(hay: Column, needle: Column) -> Column:
    """occurrences that do not overlap; an empty needle has none."""
    cut = F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))
    return F.when(F.length(needle) > 0, F.floor(cut / F.length(needle))).otherwise(0).cast("long")


def is_weak_key(s: Column) -> Column:
    """Forms of address and titles that name nobody by themselves."""
    return F.coalesce(s.rlike(rf"\A{HAN}{{1,2}}总\z|(老师|总监|经理|主管)\z|\A(董事长|老板|老板娘|总经理|总裁|创始人|CEO|CFO|CTO|COO|PR|嘉宾|记者|主持人|同事|领导)\z"), F.lit(False))


def is_concrete_source(s: Column) -> Column:
    """Names a site or is long enough, and is no vague phrase."""
    folded = trim(fold_width(F.coalesce(s, F.lit(""))))
    vague = F.exists(F.array(*map(F.lit, VAGUE_SOURCES)), lambda b: F.contains(F.lower(folded), b))
    return (folded != "") & ~vague & (folded.rlike(DOMAIN) | (F.length(folded) >= 6))


def phonetically_suspect(s: Column) -> Column:
    """P5: flag words, or a letter, a separator and a capitalised word."""
    return s.rlike("音|疑似|误写|存疑|待核|同音") | s.rlike(rf"(?<![A-Za-z])[A-Za-z][{DASHES}{SPACES}]+[A-Z][a-z]+")


def ends_with_question(s: Column) -> Column:
    """After trailing comments, quotes and space are taken off, a question mark."""
    bare = F.regexp_replace(s, rf"(<!--[^>]*-->|{WS}|[\"'”’」』）)*_])+\z", "")
    return F.coalesce(bare.rlike(r"[?？]\z"), F.lit(False))


def strip_confidence(s: Column) -> Column:
    """(text, confidence, date) of a line's right side."""
    mark = rf"(\A|[{SPACES}｜])〔(用户钦定|待复核|核实|同指两解)(?:·([0-9]{{4}}-[0-9]{{2}}))?〕{WS}*\z"
    word = F.regexp_extract(s, mark, 2)
    level = F.when(word == "用户钦定", "user").when(word == "待复核", "recheck").when(word == "同指两解", "contested").when(word == "核实", "verified").otherwise("unknown")
    text = F.when(word == "", s).otherwise(F.regexp_replace(F.regexp_replace(s, mark, ""), rf"{WS}+\z", ""))
    return F.struct(text.alias("text"), level.alias("confidence"), F.regexp_extract(s, mark, 3).alias("date"))


def unit_label(value: Column, unit: Column) -> Column:
    """symbols and Latin units touch the number, others get a space."""
    return F.when(F.coalesce(unit, F.lit("")) == "", value).when(unit.rlike("^[%$A-Za-z]"), F.concat(value, unit)).otherwise(F.concat_ws(" ", value, unit))


def section_tags(title: Column) -> Column:
    """a title's parts, eight at most."""
    return F.slice(F.filter(F.transform(F.split(title, r"[\s、，,；;：:/|·—-]+", -1), trim), lambda t: t != ""), 1, 8)


def fraction(hit: Column, total: Column) -> Column:
    """F39."""
    return F.when(total > 0, F.concat(hit.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), F.round(100.0 * hit / total).cast("long").cast("string"), F.lit("%)"))).otherwise("—")


def json_body(s: Column) -> Column:
    """what a reply holds between its outermost braces, without a fence."""
    unfenced = F.regexp_replace(F.regexp_replace(trim(s), r"\A```[a-zA-Z]*\n", ""), r"\n?```\z", "")
    return F.nullif(F.regexp_extract(unfenced, r"(?s)(\{.*\})", 1), F.lit(""))


def cached_tokens(usage: Column) -> Column:
    """cached input tokens in either dialect of a usage record."""
    return F.coalesce(F.get_json_object(usage, "$.prompt_cache_hit_tokens").cast("long"), F.get_json_object(usage, "$.prompt_tokens_details.cached_tokens").cast("long"), F.lit(0))


def relative_path(path: Column, root: str) -> Column:
    """F33."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def numbered_results(results: Column, most: int = 500) -> Column:
    """search results as a numbered list."""
    return F.array_join(F.transform(results, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["title"], F.lit("\n"), r["url"], F.lit("\n"), F.substring(r["snippet"], 1, most))), "\n\n")


def plain_page(html: Column, most: int = 8000) -> Column:
    """A page without scripts, styles and tags, cut to ``most`` characters."""
    s = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style.*?</style>", " ")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    s = F.replace(F.replace(s, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.substring(F.regexp_replace(F.regexp_replace(s, r"[ \t\n\x0B\f\r]+", " "), r"\A | \z", ""), 1, most)


def file_figures(text: Column) -> dict[str, Column]:
    """Lines (of any ending), bytes and content length of a text."""
    return {"n_lines": F.size(F.split(text, r"\r\n|\r|\n", -1)).cast("long"), "n_bytes": F.octet_length(text).cast("long"), "content": content_length(text)}
