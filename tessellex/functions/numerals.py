"""Chinese numerals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and units.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}


def to_int(numeral: Column) -> Column:
    """The number of a numeral; digits 0-9 alone pass through; null for an empty or illegal one.

    A fold over the signs: a digit replaces the one before it, a unit takes the digit (1 without one).
    """
    text = F.trim(numeral)
    digit = F.create_map(*[F.lit(x) for pair in DIGITS.items() for x in pair])
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("num"), F.lit(True).alias("ok"))

    def step(acc: Column, sign: Column) -> Column:
        d, u = F.try_element_at(digit, sign), F.try_element_at(unit, sign)
        return F.struct(
            (acc["sum"] + F.when(u.isNotNull(), F.greatest(acc["num"], F.lit(1)) * u).otherwise(0)).alias("sum"),
            F.when(u.isNotNull(), 0).otherwise(F.coalesce(d, acc["num"])).alias("num"),
            (acc["ok"] & (d.isNotNull() | u.isNotNull())).alias("ok"),
        )

    folded = F.aggregate(F.split(text, ""), start, step, lambda acc: F.when(acc["ok"], acc["sum"] + acc["num"]))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).when(F.length(text) > 0, folded)


def to_numeral(number: Column) -> Column:
    """The numeral of 0 to 9999 in the short style without filling zeros; null beyond."""
    signs = F.array(*[F.lit(x) for x in "一二三四五六七八九"])
    parts = []
    for unit, sign in ((1000, "千"), (100, "百"), (10, "十")):
        d = F.floor(number / unit) % 10
        text = F.concat(F.try_element_at(signs, d.cast("int")), F.lit(sign))
        if unit == 10:  # one ten does without its one
            text = F.when(d == 1, F.lit("十")).otherwise(text)
        parts.append(F.when(d > 0, text).otherwise(""))
    ones = F.when(number % 10 > 0, F.try_element_at(signs, (number % 10).cast("int"))).otherwise("")
    return F.when(number == 0, "零").when(number.between(1, 9999), F.concat(*parts, ones))
