"""Packing text into chunks and contexts, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences, strip
from .statutes import articles


def _strings() -> Column:
    return F.array().cast("array<string>")


def pack(parts: Column, most: int, glue: str = "\n") -> Column:
    """Parts in order, put together while they fit into ``most`` characters; a longer part stands alone."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.length(last) + len(glue) + F.length(x) <= most
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(glue), x)))
        return F.when((F.size(acc) > 0) & fits, longer).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(parts, _strings(), step)


def paragraphs(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), strip), lambda x: x != "")


def split_long(text: Column, most: int = 600) -> Column:
    """The text itself if it fits, else its paragraphs packed."""
    return F.when(F.length(text) <= most, F.array(text)).otherwise(pack(paragraphs(text), most))


def chunk_by_article(laws: DataFrame, key: str = "law_id", most: int = 600) -> DataFrame:
    """(key, chunk_no, article, content): one chunk per article, long ones split; paragraphs where there are no articles."""
    read = laws.where("content IS NOT NULL").select(F.col(key), F.col("content").alias("_c"), articles(F.col("content")).alias("_a"))
    none = F.struct(F.lit(None).cast("int").alias("article"), F.lit("").alias("text"))
    whole = F.transform(paragraphs(F.col("_c")), lambda p: F.struct(none["article"].alias("article"), p.alias("text")))
    units = F.when(F.size("_a") > 0, F.col("_a")).otherwise(whole)
    pieces = F.flatten(F.transform(units, lambda u: F.transform(split_long(u["text"], most), lambda t: F.struct(u["article"].alias("article"), t.alias("text")))))
    return read.select(key, F.posexplode(pieces).alias("chunk_no", "_x")).select(key, "chunk_no", "_x.article", F.col("_x.text").alias("content"))


def raft_chunks(laws: DataFrame, key: str = "law_id", most: int = 400) -> DataFrame:
    """Consecutive articles packed up to ``most`` characters, each chunk with the set of its articles."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.length(last["text"]) + 1 + F.length(x["text"]) <= most
        more = F.struct(F.concat(last["text"], F.lit("\n"), x["text"]).alias("text"), F.array_union(last["articles"], F.array(x["article"])).alias("articles"))
        one = F.struct(x["text"].alias("text"), F.array(x["article"]).alias("articles"))
        return F.when((F.size(acc) > 0) & fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(more))).otherwise(F.concat(acc, F.array(one)))

    packed = F.aggregate(articles(F.col("content")), F.array().cast("array<struct<text:string,articles:array<int>>>"), step)
    return laws.where("content IS NOT NULL").select(key, "title", F.posexplode(packed).alias("chunk_no", "_x")).select(key, "title", "chunk_no", F.col("_x.text").alias("content"), F.col("_x.articles").alias("articles"))


def sentence_chunks(text: Column, most: int = 512, overlap: int = 128) -> Column:
    """Sentences packed up to ``most`` characters, each chunk led by whole sentences from the end of the one before, at most ``overlap`` characters; by place, so repeated sentences do no harm."""
    start = F.struct(_strings().alias("done"), _strings().alias("now"))

    def length(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda n, s: n + F.length(s))

    def tail(a: Column) -> Column:
        kept = F.aggregate(
            F.reverse(a), F.struct(_strings().alias("t"), F.lit(True).alias("go")),
            lambda acc, s: F.when(acc["go"] & (length(acc["t"]) + F.length(s) <= overlap), F.struct(F.concat(F.array(s), acc["t"]).alias("t"), F.lit(True).alias("go"))).otherwise(F.struct(acc["t"].alias("t"), F.lit(False).alias("go"))),
        )
        return kept["t"]

    def step(acc: Column, s: Column) -> Column:
        full = (F.size(acc["now"]) > 0) & (length(acc["now"]) + F.length(s) > most)
        flushed = F.struct(F.concat(acc["done"], F.array(F.array_join(acc["now"], ""))).alias("done"), F.concat(tail(acc["now"]), F.array(s)).alias("now"))
        return F.when(full, flushed).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.array(s)).alias("now")))

    return F.aggregate(sentences(text), start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["now"], "")))).otherwise(acc["done"]))


def pack_context(hits: DataFrame, group: str, rank: str, most: int = 2000, least_rest: int = 100, numbered: bool = False) -> DataFrame:
    """(group, context): a heading, then ranked hits as header and body up to ``most`` characters; the last is cut with '...' if more than ``least_rest`` are left for its body, and then the context ends.

    The plain form heads a hit with its title (its source, if it has none); the numbered one, of training records,
    with its place and title.
    """
    if numbered:
        top, glue = "【检索到的法条】", "\n\n"
        header = lambda x, k: F.concat(F.lit("[文档"), k.cast("string"), F.lit("] "), x["t"], F.lit("：\n"))
        name = F.coalesce("title", F.lit(""))
    else:
        top, glue = "【参考法律法规】", "\n"
        header = lambda x, k: F.concat(F.lit("\n--- "), x["t"], F.lit(" ---\n"))
        source = F.coalesce("source", F.lit("法规")) if "source" in hits.columns else F.lit("法规")
        name = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(source)
    lists = hits.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), name.alias("t"), F.coalesce("content", F.lit("")).alias("c")))).alias("_x"))  # at most top-k hits per group
    items = F.transform("_x", lambda x, i: F.struct(header(x, i + 1).alias("h"), x["c"].alias("c")))
    start = F.struct(_strings().alias("out"), F.lit(0).alias("n"), F.lit(False).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        rest = F.lit(most) - acc["n"] - F.length(x["h"])
        whole = F.struct(F.concat(acc["out"], F.array(F.concat(x["h"], x["c"]))).alias("out"), (acc["n"] + F.length(x["h"]) + F.length(x["c"])).alias("n"), F.lit(False).alias("end"))
        part = F.concat(x["h"], F.substring(x["c"], F.lit(1), rest), F.lit("..."))
        cut = F.struct(F.concat(acc["out"], F.array(part)).alias("out"), F.lit(most).alias("n"), F.lit(True).alias("end"))
        stop = F.struct(acc["out"].alias("out"), acc["n"].alias("n"), F.lit(True).alias("end"))
        return F.when(acc["end"], acc).when(F.length(x["c"]) <= rest, whole).when(rest > least_rest, cut).otherwise(stop)

    return lists.select(group, F.concat(F.lit(top + glue), F.aggregate(items, start, step, lambda acc: F.array_join(acc["out"], glue))).alias("context"))


__all__ = ["chunk_by_article", "pack", "pack_context", "paragraphs", "raft_chunks", "sentence_chunks", "split_long"]
