"""Problem 1: text that looks the same in one form.

1. Code points that are always the same to a reader get one code: full-width forms, compatibility and
   radical codes of ideographs, every kind of space; invisible ones go; line ends become one code. This runs
   over all text inside Spark's generated code.
2. Script-aware repair of words in which letters of several alphabets meet. Such words are rare; each distinct
   one is repaired once: look-alikes of other scripts are put into its dominant script, the one that most of its
   letters can belong to, and the result is taken if the corpus' own vocabulary of clean words has it; else
   the next script that gives a known word. A word without any stays as it is, and so do words of one script,
   whatever they resemble. Combining marks are composed with their letters.

Two texts look the same if their look keys are equal: the form with every letter that has a Latin twin
as that one. The key needs no vocabulary, so that equal looks meet even where a word has no clean copy or
stands in two scripts.

What a reader can tell apart stays apart: case, numbers of spaces and line ends, raised and encircled
signs, roman numeral signs, other words.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, kept_table, table

# Letters of other alphabets by the Latin letter of the same shape.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜһԁԛԝаеѕіјорсухѵгӀӏҺ", "ABESIJKMHOPCTYXYGQWhdqwaesijopcyxvrIlh"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳνορυϲικα", "ABEZHIKMNOPTYXCjvopucika"))
# Some pairs above only resemble each other; a reader tells them apart.
for _near in "гҺυικα":
    CYRILLIC.pop(_near, None)
    GREEK.pop(_near, None)
ARMENIAN = dict(zip("ՕՍոսօհցզ", "OUnuohgq"))
for _near in "Սսզ":
    ARMENIAN.pop(_near, None)
LATIN_KIN = dict(zip("ɑɡ", "ag"))
ALIKE = {**CYRILLIC, **GREEK, **ARMENIAN, **LATIN_KIN}

# Radical codes without a compatibility form, by the ideograph of the same shape.
RADICALS = dict(zip("⺁⺄⺆⺇⺈⺉⺋⺌⺍⺎⺏⺐⺑⺒⺓⺔⺕⺖⺘⺙⺛⺝⺞⺟⺠⺡⺢⺣⺤⺥⺦⺨⺩⺪⺫⺬⺭⺮⺯⺰⺱⺲⺳⺵⺶⺷⺸⺹⺺⺻⺼⺽⺾⺿⻀", "厂乙冂几𠂊刂卩⺌⺍兀尣尢𡯂巳幺彑彐忄扌攵旡月歺母民氵氺灬爫爫丬犭王疋目示礻𥫗糹纟罓罒𦉪𦉫⺶羊𦍌耂耂肀月臼艹艹艹"))
RADICALS |= dict(zip("⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻍⻎⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻞⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲⻳", "虎衤覀西见角讠贝车辶辶辶钅長镸长门阝雨青韦页风飞食飠飠饣𩠐马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀龟"))
RADICALS = {a: b for a, b in RADICALS.items() if b not in RADICALS}

SPACES = "\t\u000b\u000c               　"


def _invisible() -> str:
    """Format characters, variation selectors, fillers and controls that show nothing; built by rule."""
    codes = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf" and not 0x600 <= c <= 0x605 and c not in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD)]
    codes += [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), 0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0]
    codes += [c for c in [*range(0x20), *range(0x7F, 0xA0)] if chr(c) not in "\t\n\u000b\u000c\r\u0085"]
    return "".join(map(chr, sorted(set(codes))))


INVISIBLE = _invisible()


def _same_codes() -> dict[str, str]:
    """Single codes that look like another one, by rule of their compatibility or canonical forms."""
    out = dict(RADICALS)
    ranges = ((0xFF01, 0xFF5F), (0xFF61, 0xFF9E), (0xFFE0, 0xFFE7), (0x2F00, 0x2FD6), (0xF900, 0xFADA), (0x2F800, 0x2FA1E))
    for low, high in ranges:
        for code in range(low, high):
            to = unicodedata.normalize("NFKC", chr(code))
            if len(to) == 1 and to != chr(code):
                out[chr(code)] = to
    out |= {c: unicodedata.normalize("NFC", c) for c in "ΩKÅ;·`⺟⻳"} | {"⺟": "母", "⻳": "龟", "µ": "μ", "∕": "/", "∶": ":"}
    out |= {c: " " for c in SPACES} | {"\u0085": "\n", " ": "\n", " ": "\n"}
    return {a: b for a, b in out.items() if a != b}


SAME = _same_codes()
COMMON = "，！？：；（）～"
#: A word of letters, marks and digits that has a combining mark, or a letter of Greek, Cyrillic, Armenian or of LATIN_KIN.
WORD = r"[\p{L}\p{M}\p{Nd}&&[^一-鿿㐀-䶿\x{20000}-\x{3FFFF}ぁ-ヿ가-힣]]+"
#: A letter, mark or digit of the scripts told apart here.
ANY = "[0-9A-Za-zÀ-֏]"
SUSPECT = r"[̀-ͯͰ-ϿЀ-ԯ԰-֏ɑɡ]"


def same_codes(text: Column) -> Column:
    """Step 1: one code for what always looks the same. Null stays null.

    Most texts have nothing but ordinary signs and a few full-width marks, for which plain replacement does.
    """
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(SAME[c])), COMMON, text)
    full = F.translate(F.regexp_replace(text, "\r\n?", "\n"), "".join(SAME) + INVISIBLE, "".join(SAME.values()))
    # Ideographs and ASCII in classes of their own: a class is asked part by part for every character.
    return F.when(text.rlike(rf"\A(?:[一-鿿]++|[\n\x20-\x7E]++|[。、《》“”‘’…—【】{COMMON}]++)*+\z"), plain).otherwise(full)


def latin_look(text: Column) -> Column:
    """Every letter that looks like a Latin one as that one, for keys and features; few texts have any."""
    return F.when(text.rlike("[ɐ-֏]"), F.translate(text, "".join(ALIKE), "".join(ALIKE.values()))).otherwise(text)  # all of ALIKE are in that range


_TO_LATIN = str.maketrans(ALIKE)
_FROM_LATIN = {"Cyrillic": str.maketrans({b: a for a, b in CYRILLIC.items()}), "Greek": str.maketrans({b: a for a, b in GREEK.items()})}


def _script(letter: str) -> str:
    if "Ѐ" <= letter <= "ԯ":
        return "Cyrillic"
    if "Ͱ" <= letter <= "Ͽ":
        return "Greek"
    return "Armenian" if "԰" <= letter <= "֏" else "Latin"


def repair(word: str) -> tuple[list[str], str, str]:
    """(the word in each script that all its letters can be put into, the dominant one first; composed word; its look) of one word.

    The list is empty for a word of one script. Letters of LATIN_KIN count as strangers in a Latin word.
    """
    bare = unicodedata.normalize("NFD", word)
    composed, look = unicodedata.normalize("NFC", word), unicodedata.normalize("NFC", bare.translate(_TO_LATIN))
    letters = [c for c in bare if c.isalpha()]
    seen = Counter("kin" if c in LATIN_KIN else _script(c) for c in letters)
    if len(seen) < 2 and "kin" not in seen:
        return [], composed, look
    # Letters without a look-alike show the script for sure; Latin ones without a foreign twin do so for Latin.
    sure = Counter(_script(c) for c in letters if c not in ALIKE and (_script(c) != "Latin" or not any(ord(c) in t for t in _FROM_LATIN.values())))
    out = []
    for script in sorted({*seen, "Latin"} - {"kin"}, key=lambda x: (-sure[x], -seen[x], x != "Latin")):
        to = bare.translate(_TO_LATIN) if script == "Latin" else bare.translate(_TO_LATIN).translate(_FROM_LATIN.get(script, {}))
        if all(_script(c) == script for c in to if c.isalpha()):
            out.append(unicodedata.normalize("NFC", to))
    return out, composed, look


def _suspects(coded: DataFrame) -> DataFrame:
    words = F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))
    return coded.select("_key", "_tbl", F.explode(F.array_distinct(F.filter(words, lambda w: w.rlike(SUSPECT)))).alias("_w"))


def one_form(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(tbl, id, raw, form, look) of all rows of several text columns, given as {name: (rows, key, text)}.

    The vocabulary is that of all given texts together: their words of one script. form and look are null for
    a null text and empty for an empty one (or one of invisible characters only). Repeated rows come out each,
    and rows with the same key keep their own form as long as table and key together name a row; ids are read
    as BIGINT. Further columns of the rows, whatever their names, are ignored. An empty table adds nothing.
    """
    parts = [rows.select(F.lit(name).alias("_tbl"), F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_raw")) for name, (rows, key, text) in tables.items()]
    coded = reduce(DataFrame.unionByName, parts).withColumn("_t", same_codes(F.col("_raw")))
    odd = F.coalesce(F.col("_t").rlike(SUSPECT), F.lit(False))
    rare = kept_table(coded.where(odd))  # texts with a word to look at, written once

    @F.pandas_udf("options array<string>, composed string, look string")
    def repaired(words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repair(w) for w in words], columns=["options", "composed", "look"])

    suspects = _suspects(rare)
    distinct = cut(suspects.groupBy("_w").agg(F.count(F.lit(1)).alias("_n")).withColumn("_r", repaired("_w")).select("_w", "_r.*"))
    # The vocabulary: only words that some repair asks for are looked for, which are of one script.
    asked = distinct.select("_w", F.posexplode("options").alias("_p", "_o"))
    words = F.regexp_extract_all("_t", F.lit(f"{ANY}+"), F.lit(0))
    clean = coded.select(F.explode(F.array_distinct(words)).alias("_o")).join(asked.select("_o").distinct(), "_o", "left_semi").distinct()
    known = asked.join(clean, "_o").groupBy("_w").agg(F.min_by("_o", "_p").alias("_to"))
    fixed = distinct.join(known, "_w", "left").select("_w", F.coalesce("_to", "composed").alias("_to"), "look").where("_w <> _to OR _w <> look")
    pairs = suspects.join(fixed, "_w").groupBy("_tbl", "_key").agg(F.map_from_entries(F.collect_set(F.struct("_w", F.struct("_to", "look")))).alias("_map"))
    pieces = F.regexp_extract_all("_t", F.lit(f"{WORD}|(?:(?!{WORD})[\\s\\S])+"), F.lit(0))

    def mended(which: str) -> Column:
        whole = F.array_join(F.transform("_p", lambda w: F.coalesce(F.try_element_at("_map", w)[which], w)), "")
        return F.when(F.col("_map").isNull(), F.col("_t")).otherwise(whole)

    plain = coded.where(~odd).select("_tbl", "_key", "_raw", F.col("_t").alias("form"), F.col("_t").alias("look"))
    rare = rare.join(pairs, ["_tbl", "_key"], "left").withColumn("_p", F.when(F.col("_map").isNotNull(), pieces))
    rare = rare.select("_tbl", "_key", "_raw", mended("_to").alias("form"), mended("look").alias("look"))
    out = plain.unionByName(rare)
    return out.select(F.col("_tbl").alias("tbl"), F.col("_key").alias("id"), F.col("_raw").alias("raw"), "form", "look")


def look_classes(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): pairs of different strings of one table that look the same, as (tbl, a, b) with a < b, and (tbl, id, string) of the rows that have one of them.

    Only hashes of 128 bits travel. Copies of a string are one member of a class each, and no pairs among themselves.
    """
    def code(c: str) -> Column:
        return F.unhex(F.md5(c))

    hashed = cut(forms.where("raw <> ''").select("tbl", "id", code("look").alias("look"), code("raw").alias("string")))
    strings = hashed.groupBy("tbl", "look", "string").agg(F.count(F.lit(1)).alias("rows"))
    several = strings.groupBy("tbl", "look").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tbl", "look")
    kept = strings.join(several, ["tbl", "look"]).select("tbl", "look", "string")
    classes = kept.withColumnRenamed("string", "a").join(kept.withColumnRenamed("string", "b"), ["tbl", "look"]).where("a < b").select("tbl", "a", "b")
    return classes, hashed.join(several, ["tbl", "look"]).select("tbl", "id", "string")


def look_alikes(forms: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b): pairs of rows of one table that look the same and are different strings, id_a < id_b.

    Strings are paired first, and rows come in only for the result, which has them all.
    """
    classes, members = look_classes(forms)
    left, right = members.select("tbl", F.col("string").alias("a"), F.col("id").alias("x")), members.select("tbl", F.col("string").alias("b"), F.col("id").alias("y"))
    pairs = classes.join(left, ["tbl", "a"]).join(right, ["tbl", "b"])
    return pairs.where("x <> y").select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    return one_form({"laws": (table(spark, folder, "laws"), "law_id", "content"), "contract": (table(spark, folder, "contract"), "case_id", "question")})


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return look_alikes(_forms(spark, folder))


def p1_forms(spark: SparkSession, folder: str) -> DataFrame:
    return _forms(spark, folder).select("tbl", "id", "form")


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows each look-alike string of a class has, and of how many strings the class is."""
    classes, members = look_classes(_forms(spark, folder))
    linked = classes.select("tbl", F.col("a").alias("string")).unionByName(classes.select("tbl", F.col("b").alias("string")))
    links = linked.groupBy("tbl", "string").agg(F.count(F.lit(1)).alias("links"))
    return members.join(links, ["tbl", "string"]).select("tbl", "id", F.lower(F.hex("string")).alias("string"), "links")


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms, "p1_classes": p1_classes}
SQL: dict[str, str] = {}
