"""Numbers written in Han characters, read and written as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits by their place, and scales with their powers of ten.
DIGITS = "零一二三四五六七八九"
SCALES = (("十", 1), ("百", 2), ("千", 3), ("万", 4), ("亿", 8))
#: Other writings of the digits.
SAME = ("〇两", "零二")


def numeral_value(text: Column) -> Column:
    """The value of a numeral as a decimal: by scales (三千五百万), or place by
    place where none is written (二零二三). Null where any other character
    stands, and for an empty or null text. A fold over the characters: below
    the scales of ten thousand a section is summed up, which such a scale then
    multiplies; a digit without a scale stands for itself."""
    chars = F.filter(F.split(F.translate(text, *SAME), ""), lambda c: c != "")
    number = "decimal(30,0)"
    zero = F.lit(0).cast(number)
    digit = lambda c: F.instr(F.lit(DIGITS), c) - 1
    power = lambda c: F.coalesce(*[F.when(c == s, F.lit(10**p).cast("decimal(10,0)")) for s, p in SCALES])

    def state(total, section, last) -> Column:
        return F.struct(total.cast(number).alias("total"), section.cast(number).alias("section"), last.cast("decimal(1,0)").alias("last"))

    def one(s: Column, c: Column) -> Column:
        said = F.coalesce(s["last"], F.lit(0))
        wide = s["section"] + said
        big = power(c) >= 10_000
        over = (power(c) > 10_000) & (s["total"] > 0)
        return (
            F.when(digit(c) >= 0, state(s["total"], s["section"], digit(c)))
            .when(over, state((s["total"] + wide) * power(c), zero, F.lit(None)))
            .when(big, state(s["total"] + F.greatest(wide, F.lit(1)) * power(c), zero, F.lit(None)))
            .otherwise(state(s["total"], s["section"] + F.coalesce(s["last"], F.lit(1)) * power(c), F.lit(None)))
        )

    scaled = F.aggregate(chars, state(zero, zero, F.lit(None)), one, lambda s: (s["total"] + s["section"] + F.coalesce(s["last"], F.lit(0))).cast("decimal(38,0)"))
    plain = F.translate(F.translate(text, *SAME), DIGITS, "0123456789")
    known = text.rlike(f"\\A[{DIGITS}{SAME[0]}{''.join(s for s, _ in SCALES)}]+\\z")
    return F.when(known, F.when(plain.rlike(r"\A[0-9]+\z"), plain.cast("decimal(38,0)")).otherwise(scaled))


def spelled(n: Column) -> Column:
    """A whole number below ten to the twelfth in Han characters, with a zero
    said wherever places are skipped; null for others."""
    four = lambda v: F.lpad(v.cast("string"), 4, "0")

    def section(v: Column) -> Column:
        d = lambda i: F.substring(four(v), i, 1).cast("int")
        said = F.concat(*[F.when(d(i) > 0, F.concat(F.substring(F.lit(DIGITS), d(i) + 1, F.lit(1)), F.lit(unit))).otherwise("零") for i, unit in ((1, "千"), (2, "百"), (3, "十"), (4, ""))])
        return F.regexp_replace(F.regexp_replace(said, "零+", "零"), "零\\z", "")

    n = n.cast("long")
    parts = [F.pmod(F.floor(n / 10**p).cast("long"), F.lit(10_000).cast("long")) for p in (8, 4, 0)]
    said = F.concat(*[F.when(v > 0, F.concat(section(v), F.lit(unit))).otherwise("零") for v, unit in zip(parts, ("亿", "万", ""), strict=True)])
    clean = F.regexp_replace(F.regexp_replace(said, "零+", "零"), "\\A零|零\\z", "")
    return F.when((n >= 0) & (n < 10**12), F.when(n == 0, "零").otherwise(clean))
