"""Column expressions on text: normal forms, hashes, grams, tokens, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An ideograph of the basic block.
CJK = "[一-鿿]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def normalize(text: Column) -> Column:
    """Lower case, letters and digits only. Null stays null."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def text_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(text, 256)


def char_grams(text: Column, n: int = 5) -> Column:
    """All runs of n characters, in order; none for a shorter text."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, runs).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Retrieval terms: pairs of neighbouring ideographs (of the text without all else), runs of 2 to 6 ideographs, words and numbers in lower case."""
    han = F.regexp_replace(text, "[^一-鿿]+", "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(han) - 1, F.lit(1))), lambda i: F.substring(han, i, F.lit(2)))
    pairs = F.when(F.length(han) >= 2, pairs).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[a-zA-Z0-9]+(?:\.[a-zA-Z0-9]+)*"), F.lit(0)), F.lower)
    return F.concat(pairs, F.regexp_extract_all(text, F.lit("[一-鿿]{2,6}"), F.lit(0)), words)


def sentences(text: Column) -> Column:
    """Trimmed sentences with their end marks, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？；.!?;\n])"), strip), lambda s: s != "")


def clauses(text: Column) -> Column:
    """What stands between full stops, semicolons and line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[。；\n]"), strip), lambda s: s != "")


def has_html(text: Column) -> Column:
    return text.rlike("<[a-z]+[ >]")


def has_mojibake(text: Column) -> Column:
    return F.contains(text, F.lit("�"))


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether one of the phrases is in the text."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def count_of(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases are in the text."""
    out = F.lit(0)
    for p in phrases:
        out = out + F.contains(text, F.lit(p)).cast("int")
    return out


def phrases_in(text: Column, phrases: tuple[str, ...]) -> Column:
    """Those of the phrases that are in the text, in their order."""
    return F.filter(F.array(*[F.when(F.contains(text, F.lit(p)), p) for p in phrases]), lambda x: x.isNotNull())
