"""Problem 3: items above a size limit come out as pieces under it, cut at natural boundaries.

One regular expression per row cuts the content: its alternatives are ordered by the strength of the
boundary (rest of the text, line end, sentence end, any character), each with a bounded quantifier that
takes as much as still fits. Character offsets of the cuts give each piece its overlap by looking back at
the stretches before it; the time is linear in the text's length.
All of it is built-in SQL on arrays, without a Python worker and without a shuffle of the content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: The largest number of limits that is broadcast; more are joined by a shuffle.
MAX_TYPES = 100_000
#: Texts in a block of running sums.
BLOCK = 128
LINE_END = r"(?:\r\n|\n|\r(?!\n))"
SENTENCE_END = "[。！？；!?;]"
NEITHER = r"[\n\r。！？；!?;]"


def _cuts(n: Column) -> Column:
    """The alternatives for a stretch of at most ``n`` characters, strongest boundary first.

    A line end or sentence end in the second half is better than one that would leave a short piece; one
    in the first half is still better than none.
    """
    top, half = (n - 1).cast("string"), F.greatest(F.lit(0), (n / 2 - 1).cast("int")).cast("string")
    line = F.greatest(F.lit(0), n - 2).cast("string")
    before = F.least(F.greatest(F.lit(0), (n / 2 - 1).cast("int")), F.greatest(F.lit(0), n - 2)).cast("string")
    return F.concat(
        F.lit(r"[\s\S]{1,"), n.cast("string"), F.lit(r"}\z|[\s\S]{"), before, F.lit(","), line, F.lit("}" + LINE_END + r"|[\s\S]{"), half, F.lit(","), top,
        F.lit("}" + SENTENCE_END + r"|[\s\S]{0,"), line, F.lit("}" + LINE_END + r"|[\s\S]{0,"), top, F.lit("}" + SENTENCE_END + r"|[\s\S]{1,"), n.cast("string"), F.lit("}"),
    )


def split_oversized(
    items: DataFrame, limits: DataFrame, key: str = "law_id", title: str = "title", content: str = "content", kind: str = "type"
) -> DataFrame:
    """Pieces of the items whose title and content together exceed the limit of their type.

    ``limits`` has law_type, max_chars, overlap_chars; its row of null law_type holds for types that are
    null or not listed (without such a row, those items have no limit and are not split). Result: one row
    per piece with ``key``, piece (from 0), pieces, part ('title' or 'content'), piece_text, start (offset of
    the piece's own stretch in its part), overlap (characters repeated from before), cut ('line', 'sentence',
    'character' or 'end'), max_chars and longest_run (the content's longest stretch without line or sentence end).

    A piece is the title, a line end, the overlap and a stretch of content, at most max_chars code points
    together. A null title counts as an empty one, and an empty one takes no line end. A title that leaves
    less than the overlap and a quarter of the limit leads with as much as leaves that; the rest of such a title
    comes first, in pieces of its own without overlap. An overlap above max_chars - 3 leaves no room and is cut to
    that. A limit under 3 counts as 3. Null or empty content has no pieces, unless the title has none of its own either (then
    one). Repeated rows give their pieces each; an empty table gives none. Further columns of the items are
    ignored, whatever their names.
    """
    known = limits.where("law_type IS NOT NULL").groupBy("law_type").agg(F.min("max_chars").alias("_m"), F.min("overlap_chars").alias("_o"))
    # The one default row is a setting, so its two numbers become literals.
    rest = limits.where("law_type IS NULL").agg(F.min("max_chars"), F.min("overlap_chars")).first()
    picked = items.select(
        F.col(key).alias("_key"), F.coalesce(F.col(title), F.lit("")).alias("_title"), F.coalesce(F.col(content), F.lit("")).alias("_content"), F.col(kind).alias("_kind")
    )
    if known.limit(MAX_TYPES + 1).count() <= MAX_TYPES:
        known = F.broadcast(known)
    sized = picked.join(known, F.col("_kind") == F.col("law_type"), "left")
    listed = F.col("law_type").isNotNull()
    big = sized.select(
        "_key", "_title", "_content",
        F.when(listed, F.col("_m")).otherwise(F.lit(rest[0])).alias("_max"),
        F.greatest(F.lit(0), F.coalesce(F.when(listed, F.col("_o")).otherwise(F.lit(rest[1])), F.lit(0))).alias("_overlap"),
    ).where(F.length("_title") + F.length("_content") > F.col("_max"))
    fit = big.withColumn("_top", F.greatest(F.lit(3), F.col("_max"))).withColumn("_back", F.expr("least(_overlap, _top - 3)"))
    fit = fit.withColumn("_left", F.expr("greatest(2, least(_top div 4, _top - 1 - _back)) + _back"))
    fit = fit.withColumn("_led", F.expr("if(length(_title) + 1 + _left <= _top, length(_title), greatest(0, _top - 1 - _left))").cast("int"))
    fit = fit.withColumn("_head", F.expr("if(_led > 0, concat(substring(_title, 1, _led), '\n'), '')"))
    fit = fit.withColumn("_room", F.expr("_top - length(_head)").cast("int")).withColumn("_own", F.expr("_room - _back").cast("int")).withColumn("_back", F.col("_back").cast("int"))
    pattern = F.concat(F.lit(r"\A(?:"), _cuts(F.col("_room")), F.lit(")|(?:"), _cuts(F.col("_own")), F.lit(")"))
    fit = fit.withColumn("_rest", F.regexp_extract_all(F.expr("substring(_title, _led + 1)"), F.concat(F.lit(r"[\s\S]{1,"), F.col("_room").cast("string"), F.lit("}")), F.lit(0)))
    fit = fit.withColumn("_parts", F.regexp_extract_all("_content", pattern, F.lit(0)))
    fit = fit.withColumn("_parts", F.when((F.size("_parts") > 0) | (F.size("_rest") > 0), F.col("_parts")).otherwise(F.array(F.lit(""))))
    fit = _with_starts(fit, "_parts").withColumn("_run", F.array_max(F.transform(F.split("_content", NEITHER), F.length)))
    titled = F.expr("transform(_rest, (t, i) -> struct('title' AS part, t AS body, cast(i * _room AS int) AS start, 0 AS overlap))")
    own = F.transform(F.arrays_zip(F.col("_parts").alias("p"), F.col("_starts").alias("s")), lambda x, i: F.struct(
        F.lit("content").alias("part"), F.concat(_before("_parts", i, "_back"), x["p"]).alias("body"), x["s"].alias("start"), F.least(F.col("_back"), x["s"]).alias("overlap")
    ))
    one = fit.select("_key", "_head", "_max", "_run", F.concat(titled, own).alias("_pieces"))
    # The number of pieces is known before they are exploded, so that no row carries all of them. Each item has a piece;
    # the outer form keeps the optimiser from a filter that would make the pieces twice.
    one = one.select("_key", "_head", "_max", "_run", F.size("_pieces").alias("pieces"), "_pieces")
    one = one.select("_key", "_head", "_max", "_run", "pieces", F.posexplode_outer("_pieces").alias("piece", "_x"))
    body = F.col("_x.body")
    return one.select(
        F.col("_key").alias(key), "piece", "pieces", "_x.part", F.concat("_head", body).alias("piece_text"), "_x.start", "_x.overlap",
        F.when(F.col("piece") + 1 == F.col("pieces"), "end").when(body.rlike(r"[\n\r]\z"), "line").when(body.rlike(SENTENCE_END + r"\z"), "sentence").otherwise("character").alias("cut"),
        F.col("_max").alias("max_chars"), F.col("_run").alias("longest_run"),
    )


def _with_starts(rows: DataFrame, parts: str) -> DataFrame:
    """Adds _starts, the offsets of an array's texts in their concatenation: running sums within blocks, and over the blocks, so that no long array is copied at each step."""
    sums = "aggregate({0}, array(cast({1} AS int)), (a, n) -> concat(a, array(element_at(a, -1) + n)))"
    blocks = f"transform(sequence(0, (size({parts}) - 1) div {BLOCK}), b -> transform(slice({parts}, b * {BLOCK} + 1, {BLOCK}), t -> length(t)))"
    out = rows.withColumn("_lengths", F.expr(f"if(size({parts}) = 0, cast(array() AS array<array<int>>), {blocks})"))
    out = out.withColumn("_upto", F.expr(sums.format("transform(_lengths, b -> aggregate(b, 0, (s, n) -> s + n))", "0")))
    within = f"zip_with(_lengths, slice(_upto, 1, size(_lengths)), (b, u) -> slice({sums.format('b', 'u')}, 1, size(b)))"
    return out.withColumn("_starts", F.expr(f"flatten({within})")).drop("_lengths", "_upto")


def _before(parts: str, i: Column, back: str) -> Column:
    """The last ``back`` characters before the i-th text: of the text before it if that is long enough, else of as many as it takes."""
    texts, want = F.col(parts), F.col(back)
    last = F.try_element_at(texts, i)
    few = F.array_join(F.slice(texts, F.greatest(F.lit(1), i - BLOCK + 1), F.least(i, F.lit(BLOCK))), "")
    enough = F.when(F.length(few) >= want, few).otherwise(F.array_join(F.slice(texts, F.lit(1), i), ""))
    return F.when((i == 0) | (want == 0), "").when(F.length(last) >= want, F.right(last, want)).otherwise(F.right(enough, want))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "laws"), table(spark, folder, "split_limits"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every split law once; its pieces carry the longest stretch that no natural cut can divide."""
    first = p3_pieces(spark, folder).where("piece = 0")  # of the title or the content
    return first.select("law_id", F.when(F.col("longest_run") > F.col("max_chars"), "forced").otherwise("natural").alias("kind"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
SQL = {
    "p3_found": r"""
        SELECT law_id, CASE WHEN list_max(list_transform(regexp_split_to_array(coalesce(content, ''), '[\n\r。！？；!?;]'), lambda x: length(x))) > m
                            THEN 'forced' ELSE 'natural' END AS kind
        FROM (SELECT l.*, coalesce(k.max_chars, (SELECT max_chars FROM split_limits WHERE law_type IS NULL)) AS m
              FROM laws l LEFT JOIN split_limits k ON k.law_type = l.type)
        WHERE coalesce(length(title), 0) + coalesce(length(content), 0) > m""",
}
