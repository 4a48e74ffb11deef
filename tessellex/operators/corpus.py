"""Cleaning, version choice and audit of a law corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..domain import legal
from ..functions.text import has_html, has_mojibake, strip
from .statutes import articles


def clean_content(text: Column) -> Column:
    """Per line without quote marks, images, link targets, contents lists and escapes; blank lines go.

    A contents list opens at a line of at most four characters with 目 and 录 and closes at a line with a
    chapter's head, which stays out as well.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(strip(x), r"^>\s*", ""))

    def mend(x: Column) -> Column:
        x = F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", "")
        x = F.regexp_replace(x, r"\[([^\]]*)\]\([^)]*\)", "$1")
        for a, b in (("　", " "), (r"\<", "〈"), (r"\>", "〉"), (r"\[", "["), (r"\]", "]"), (r"\*", "*"), (r"\_", "_")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return strip(x)

    def step(acc: Column, x: Column) -> Column:
        opens = (F.length(x) <= 4) & F.contains(x, F.lit("目")) & F.contains(x, F.lit("录"))
        closes = acc["toc"] & x.rlike(r"^第.{1,6}章")
        return F.struct(
            F.when(acc["toc"] | opens | (x == ""), acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"),
            F.when(opens, True).when(closes, False).otherwise(acc["toc"]).alias("toc"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("toc"))
    return F.aggregate(F.transform(lines, mend), start, step, lambda acc: F.array_join(acc["out"], "\n"))


def latest_versions(laws: DataFrame, seq: str = "law_id") -> DataFrame:
    """Of each title the row with the largest publish_date (as text), the first one at a tie; rows without title are dropped. ``seq`` names a row; only it travels."""
    named = laws.where("title IS NOT NULL AND title <> ''")
    first = named.groupBy("title").agg(F.max_by(seq, F.struct(F.coalesce("publish_date", F.lit("")), -F.col(seq))).alias(seq)).select(seq)
    return named.join(first, seq, "left_semi")


def preprocess(laws: DataFrame, types: tuple[str, ...] = legal.NATIONAL_TYPES, seq: str = "law_id", least: int = 30) -> DataFrame:
    """Adds clean and reason ('type', 'status', 'title', 'version', 'mojibake', 'short' or null for kept)."""
    scoped = F.when(~F.coalesce(F.col("type").isin(*types), F.lit(False)), "type").when(F.coalesce(F.trim("status"), F.lit("")) != "有效", "status").when(F.coalesce("title", F.lit("")) == "", "title")
    tagged = laws.withColumn("_scope", scoped)
    newest = latest_versions(tagged.where("_scope IS NULL").select(seq, "title", "publish_date"), seq).select(seq, F.lit(True).alias("_newest"))
    tagged = tagged.join(newest, seq, "left").withColumn("clean", F.when(F.col("_newest"), clean_content(F.col("content"))))
    reason = (
        F.when(F.col("_scope").isNotNull(), F.col("_scope")).when(F.col("_newest").isNull(), "version")
        .when(has_mojibake(F.col("clean")), "mojibake").when(F.coalesce(F.length("clean"), F.lit(0)) < least, "short")
    )
    return tagged.withColumn("reason", reason).drop("_scope", "_newest")


def audit(laws: DataFrame) -> DataFrame:
    """A1: one row of counts over a corpus."""
    n = F.size(articles(F.col("content")))
    body, year = F.coalesce("content", F.lit("")), F.when(F.col("publish_date").rlike(r"^[0-9]{4}"), F.col("publish_date"))
    one = laws.agg(
        F.count(F.lit(1)).alias("laws"), F.count_if(F.coalesce(F.trim("title"), F.lit("")) == "").alias("no_title"), F.count_if(F.trim(body) == "").alias("no_content"),
        F.count_if(F.length(F.trim(body)).between(1, 49)).alias("short"), F.count_if(has_html(body)).alias("html"), F.count_if(has_mojibake(body)).alias("mojibake"),
        F.sum(n).alias("articles"), F.count_if(n == 0).alias("no_articles"), F.min(year).alias("first_date"), F.max(year).alias("last_date"),
        (F.count("title") - F.count_distinct("title")).alias("repeated_titles"),
    )
    return one


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """A2: value, count and share of all, null as a value of its own."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows_count"))
    return counts.withColumn("share", F.round(F.col("rows_count") / F.sum("rows_count").over(Window.partitionBy()), 6))


def missing_titles(core: DataFrame, laws: DataFrame, column: str = "title") -> DataFrame:
    """Core titles that the corpus lacks."""
    return core.select(column).distinct().join(laws.select(column), column, "left_anti")


def coverage_gap(ours: DataFrame, official: DataFrame) -> DataFrame:
    """Per type the official number, ours and the gap."""
    n = ours.groupBy(F.col("type").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    return official.join(n, F.col("type") == F.col("_t"), "left").select("type", "official", F.coalesce("_n", F.lit(0)).alias("have"), (F.col("official") - F.coalesce("_n", F.lit(0))).alias("gap"))


def status_label(code: Column) -> Column:
    """P7."""
    out = F.lit(None).cast("string")
    for k, v in legal.STATUS_CODES.items():
        out = F.when(code == k, v).otherwise(out)
    return F.coalesce(out, code.cast("string"))
