"""Number atoms of Chinese prose: values, ranges, units and polarity.

The numeral grammar is stateful, so extraction is a pandas UDF over Arrow
batches; everything after it is joins and aggregates.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: Numerals, scales, units, idioms and polarity words.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
TENS = {"十": 10, "百": 100, "千": 1000}
SCALES = {"万": 10_000, "亿": 100_000_000}
UNITS = ("个月", "个点", "小时", "分钟", "平方米", "公里", "年", "月", "天", "周", "岁", "元", "块", "家", "人", "位", "名", "倍", "次", "款", "台", "吨", "条", "%")
SAME_UNIT = {"块": "元", "位": "人", "名": "人"}
#: Words that hold numerals and are no numbers.
IDIOMS = ("一五一十", "五花八门", "三心二意", "七上八下", "千方百计", "一些", "一下", "一样", "一起", "一直", "一定", "一般", "一点", "一种", "万一", "十分", "一旦", "千万不要", "千万别", "千万要")
POLARITY = ("不到", "超过", "亏损", "下降", "减少", "下滑", "不足", "至少", "最多", "增长", "盈利")
NUMERAL = r"[零〇一二两三四五六七八九十百千万亿]+"
#: An idiom inside a numeral is none: 二万一千 does not hold 万一.
IDIOM = re.compile(rf"(?<![零〇一二两三四五六七八九十百千万亿])(?:{'|'.join(sorted(IDIOMS, key=len, reverse=True))})+")
NUMBER = rf"(?:[0-9]+(?:\.[0-9]+)?|{NUMERAL})"
ATOM = re.compile(rf"(?P<ordinal>第)?(?P<percent>百分之)?(?P<a>{NUMBER})(?: ?(?:到|至|-|~|—) ?(?P<b>{NUMBER}))?(?P<more>[多来几余])? ?(?:个(?=[亿万千]))?(?P<scale>[千百]?[万亿]|千万)?(?:元|人民币|块)?(?P<unit>{'|'.join(UNITS)})?")
DIGIT = "一二两三四五六七八九"
PAIR = re.compile(rf"([{DIGIT}])([{DIGIT}])([十百千]+)?|([{DIGIT}]?十)([{DIGIT}])([{DIGIT}])")
TIMESTAMP = re.compile(r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?")


def numeral(text: str) -> float | None:
    """A numeral's value: positional (二零二三) or by scales (三千五百万)."""
    if re.fullmatch(r"[0-9]+(\.[0-9]+)?", text):
        return float(text)
    if all(c in DIGITS for c in text):
        return float("".join(str(DIGITS[c]) for c in text))
    total, section, digit = 0, 0, None
    for c in text:
        if c in DIGITS:
            digit = DIGITS[c]
        elif c in TENS:
            section += (1 if digit is None else digit) * TENS[c]
            digit = None
        else:
            section += digit or 0
            digit = None
            if SCALES[c] > 10_000 and total:
                total, section = (total + section) * SCALES[c], 0
            else:
                total, section = total + (section or 1) * SCALES[c], 0
    if digit:
        # a last digit after a scale stands for the next lower place only where a zero is said
        section += digit
    return float(total + section)


def _split(han: str) -> tuple[str, str]:
    """A Han numeral without its last scale, and that scale: 八千万 is 八千 and 万."""
    return (han[:-1], han[-1]) if len(han) > 1 and han[-1] in SCALES and not any(c in SCALES for c in han[:-1]) else (han, "")


def extract(text: str | None) -> list[dict]:
    """The atoms of a text, in order: a value or range, its unit with the scale
    folded in, its size, and the word before it that bounds or turns it. Its
    sizes are the value without scale, with each unit that it may be of: after a
    scale, money need not say so."""
    out = []
    plain = TIMESTAMP.sub(lambda m: "\0" * len(m.group()), text or "")
    plain = IDIOM.sub(lambda m: "\0" * len(m.group()), plain)
    for m in ATOM.finditer(plain):
        a, b, scale, unit = m["a"], m["b"], m["scale"] or "", m["unit"] or ""
        rest = m.group()[m.end("a") - m.start() :]
        han = a[0] not in "0123456789"
        if m["ordinal"]:
            continue
        if han and not scale:
            a, scale = _split(a)
        if b and b[0] not in "0123456789" and not scale:
            b, scale = _split(b)
        pair = PAIR.fullmatch(a) if han and not b else None
        if pair and not (pair[3] or pair[4]):
            continue  # two or three, seven or eight
        if pair and pair[3]:
            low, high = numeral(pair[1] + pair[3]), numeral(pair[2] + pair[3])
        elif pair and pair[4]:
            low, high = numeral(pair[4] + pair[5]), numeral(pair[4] + pair[6])
        else:
            low, high = numeral(a), numeral(b) if b else None
        if low is None or m["more"] in ("来", "几"):
            continue
        small = han and not b and not scale and not m["percent"] and low < 10 and not re.search("元|人民币", rest)
        if small and (unit in ("", "人", "家", "次", "名", "位") or "个" in rest and unit not in ("个月", "个点")):
            continue  # a small spoken count
        high = low if high is None else high
        unit = "%" if m["percent"] else "" if m["more"] else SAME_UNIT.get(unit, unit)
        if not unit and not scale and re.search("元|块", rest):
            unit = "元"
        factor = 1
        for c in scale:
            factor *= SCALES.get(c) or TENS[c]
        before = plain[max(0, m.start() - 4) : m.start()]
        polarity = next((w for w in POLARITY if w in before), "")
        value = "-".join(dict.fromkeys(f"{v:.10g}" for v in (low, high)))
        mark = scale + (unit if unit != "元" or not scale else "")
        amount = "-".join(f"{v * factor:.10g}" for v in (low, high))
        sizes = [f"{amount}|{u}" for u in (("", "元") if scale and unit in ("", "元") else (unit,))]
        out.append({"key": f"{value}|{mark}", "value": value, "lo": low * factor, "hi": high * factor, "unit": mark, "polarity": polarity, "sizes": sizes})
    return out


ATOMS = ArrayType(StructType([StructField("key", StringType()), StructField("value", StringType()), StructField("lo", DoubleType()), StructField("hi", DoubleType()), StructField("unit", StringType()), StructField("polarity", StringType()), StructField("sizes", ArrayType(StringType()))]))


@F.pandas_udf(ATOMS)
def number_atoms(text: pd.Series) -> pd.Series:
    return text.map(extract)


def drift(turns: DataFrame, id_col: str) -> DataFrame:
    """Anchored turns (id, turn_no, source, refined) whose atoms were
    dropped, or changed polarity; doubled atoms count once. An atom stays if its
    size is said, with a scale or written out."""
    atoms = lambda c: F.array_distinct(F.transform(number_atoms(F.col(c)), lambda a: F.struct(a["key"], a["polarity"], a["sizes"])))
    rows = turns.select(id_col, "turn_no", atoms("source").alias("s"), atoms("refined").alias("r"))
    said = lambda a: F.exists("r", lambda b: F.arrays_overlap(a["sizes"], b["sizes"]))
    alike = lambda a: F.exists("r", lambda b: F.arrays_overlap(a["sizes"], b["sizes"]) & (a["polarity"] == b["polarity"]))
    lost = F.size(F.array_distinct(F.transform(F.filter("s", lambda a: ~said(a)), lambda a: a["key"])))
    turned = F.size(F.filter("s", lambda a: (a["polarity"] != "") & said(a) & ~alike(a)))
    return rows.select(id_col, "turn_no", lost.cast("long").alias("dropped"), turned.cast("long").alias("polarity_lost")).where("dropped + polarity_lost > 0")


def hedges_lost(source: Column, refined: Column) -> Column:
    """Most of a turn's hedges are gone."""
    return (source >= 2) & (refined * 2 < source)
