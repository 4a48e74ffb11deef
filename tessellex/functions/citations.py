"""Statute citations in text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numerals import to_int
from .text import strip

# The patterns of citations and of quantities.
_NUM = "[零〇一二三四五六七八九十百千0-9]"
STATUTE = rf"(?U)《([^》]{{2,30}}?)》\s*第\s*({_NUM}{{1,8}})\s*条(?:\s*第\s*({_NUM}{{1,4}})\s*[款项])?"
JUDICIAL = rf"(?U)(最高人民法院[^第。；，]{{1,60}}?)第\s*({_NUM}{{1,8}})\s*条"
LOOSE = r"《[^》]{2,20}》\s*第\s*[0-9一二三四五六七八九十百零〇]+\s*条"
BARE = rf"(?U)(?:^|[^《])第\s*({_NUM}{{1,8}})\s*条"
QUANTITY = r"[零〇一二两三四五六七八九十百千万0-9]{1,6}(?:倍|年|个月|月|日|天|元|万|%|％|小时|周)"
PREFIX = "中华人民共和国"


def _found(text: Column, pattern: str, with_para: bool) -> Column:
    def group(k: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(k))

    zipped = F.arrays_zip(group(1).alias("l"), group(2).alias("a"), (group(3) if with_para else group(2)).alias("p"), group(0).alias("r"))
    return F.transform(
        zipped,
        lambda x: F.struct(
            strip(x["l"]).alias("law"), to_int(x["a"]).alias("article"), (F.when(x["p"] != "", to_int(x["p"])) if with_para else F.lit(None).cast("int")).alias("para"), x["r"].alias("raw")
        ),
    )


def citations(text: Column) -> Column:
    """ARRAY<STRUCT<law, article, para, raw>>: statutes in order, then judicial interpretations; repeats by (law, article, para) once, unreadable articles dropped."""
    none = F.array().cast("array<struct<law:string,article:int,para:int,raw:string>>")
    statutes = F.when(F.contains(text, F.lit("《")) & F.contains(text, F.lit("第")), _found(text, STATUTE, True)).otherwise(none)
    judicial = F.when(F.contains(text, F.lit("最高人民法院")), _found(text, JUDICIAL, False)).otherwise(none)
    read = F.filter(F.concat(statutes, judicial), lambda x: x["article"].isNotNull())

    def key(x: Column) -> Column:
        return F.concat_ws("\u0001", x["law"], x["article"].cast("string"), F.coalesce(x["para"].cast("string"), F.lit("-")))

    # A fold, so that each element sees only what was taken before it.
    folded = F.aggregate(
        read, F.struct(none.alias("out"), F.array().cast("array<string>").alias("seen")),
        lambda acc, x: F.when(F.array_contains(acc["seen"], key(x)), acc).otherwise(F.struct(F.concat(acc["out"], F.array(x)).alias("out"), F.concat(acc["seen"], F.array(key(x))).alias("seen"))),
        lambda acc: acc["out"],
    )
    return F.when(text.isNull(), none).otherwise(folded)


def short_name(title: Column) -> Column:
    """The title without the name of the state."""
    return F.trim(F.replace(title, F.lit(PREFIX), F.lit("")))


def quantities(text: Column) -> Column:
    """The distinct quantities (number and unit) in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(0)))


def lexical_score(answer: Column, article: Column) -> Column:
    """The share of the answer's distinct quantities that the article has too; 1 without any."""
    spans = quantities(F.coalesce(answer, F.lit("")))
    return F.when(F.size(spans) == 0, 1.0).otherwise(F.size(F.filter(spans, lambda s: F.contains(F.coalesce(article, F.lit("")), s))) / F.size(spans))
