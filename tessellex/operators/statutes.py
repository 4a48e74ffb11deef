"""Articles of laws, the statute index, resolution of law names and the check of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.citations import PREFIX, citations, lexical_score, short_name
from ..functions.numerals import to_int
from ..functions.text import strip

# Fixed value: the head of an article at the start of a line.
HEAD = r"(?U)^\s*第\s*([零〇一二三四五六七八九十百千0-9]{1,8})\s*条"


def articles(content: Column) -> Column:
    """ARRAY<STRUCT<article, text>>: a line that begins with an article's head opens one; later lines belong to it; what stands before the first is dropped, as are blank lines."""
    lines = F.filter(F.transform(F.split(content, r"\r\n|\r|\n"), strip), lambda x: x != "")
    none = F.array().cast("array<struct<article:int,text:string>>")

    def step(acc: Column, line: Column) -> Column:
        head = to_int(F.regexp_extract(line, HEAD, 1))
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["article"].alias("article"), F.concat(last["text"], F.lit("\n"), line).alias("text"))))
        opened = F.concat(acc, F.array(F.struct(head.alias("article"), line.alias("text"))))
        return F.when(head.isNotNull(), opened).when(F.size(acc) > 0, longer).otherwise(acc)

    return F.when(content.isNull(), none).otherwise(F.aggregate(lines, none, step))


def article_rows(laws: DataFrame, key: str = "law_id", content: str = "content") -> DataFrame:
    """(key, pos, article, text): the same by exploding lines and summing heads over them, for very long laws."""
    lines = laws.select(F.col(key).alias("_k"), F.posexplode(F.split(content, r"\r\n|\r|\n")).alias("_p", "_l")).withColumn("_l", strip(F.col("_l"))).where("_l <> ''")
    lines = lines.withColumn("_h", to_int(F.regexp_extract("_l", HEAD, 1)))
    order = Window.partitionBy("_k").orderBy("_p")
    lines = lines.withColumn("_i", F.sum(F.col("_h").isNotNull().cast("int")).over(order)).where("_i > 0")
    grouped = lines.groupBy("_k", "_i").agg(F.max("_h").alias("article"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_l"))), lambda x: x["_l"]), "\n").alias("text"))
    return grouped.select(F.col("_k").alias(key), F.col("_i").cast("int").alias("pos"), "article", "text")


def statute_index(laws: DataFrame, seq: str = "law_id") -> tuple[DataFrame, DataFrame]:
    """(statutes, names). statutes(title, article, text): the last law of a title, the last text of an article.

    names(name, title, rank): each title and its short form with the first law that bears it.
    """
    full = laws.where("title IS NOT NULL AND title <> '' AND content IS NOT NULL AND content <> ''").select("title", F.col(seq).alias("_s"), articles(F.col("content")).alias("_a")).where(F.size("_a") > 0)
    last = full.groupBy("title").agg(F.max_by("_a", "_s").alias("_a"), F.min("_s").alias("_first"))
    rows = last.select("title", F.posexplode("_a").alias("_p", "_x")).groupBy("title", F.col("_x.article").alias("article")).agg(F.max_by("_x.text", "_p").alias("text"))
    names = last.select("title", "_first", F.explode(F.array_distinct(F.array("title", short_name(F.col("title"))))).alias("name"))
    names = names.groupBy("name").agg(F.min_by("title", "_first").alias("title"), F.min("_first").alias("rank"))
    return rows, names


def resolve_names(cited: DataFrame, names: DataFrame, law: str = "law") -> DataFrame:
    """(law, title) of each distinct cited name: its exact title or short form, else the longest title that contains it or is contained in it, else the title that its own short form names, else null.

    The containment test runs only for distinct names without an exact match, over grams of four
    characters that both share, so it needs no cross join.
    """
    wanted = cited.select(F.col(law).alias("_law")).where("_law IS NOT NULL").distinct()
    exact = wanted.join(names.select(F.col("name").alias("_law"), "title"), "_law", "left")
    open_ = exact.where("title IS NULL").select("_law")
    titles = names.where(F.col("name") == F.col("title")).select("title", "rank")

    def grams(c: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))

    # Containment means that the shorter one's first pair of characters is in the longer one.
    near = open_.select("_law", F.explode(grams(F.col("_law"))).alias("_g")).join(titles.select("title", "rank", F.substring("title", 1, 2).alias("_g")), "_g").where(F.contains("_law", "title"))
    far = open_.select("_law", F.substring("_law", 1, 2).alias("_g")).join(titles.select("title", "rank", F.explode(grams(F.col("title"))).alias("_g")), "_g").where(F.contains("title", "_law"))
    best = near.unionByName(far).groupBy("_law").agg(F.max_by("title", F.struct(F.length("title"), -F.col("rank"))).alias("title"))
    short = names.select(F.col("name").alias("_n"), F.col("title").alias("_t"))
    rest = open_.join(best, "_law", "left").join(short, short_name(F.col("_law")) == F.col("_n"), "left").select("_law", F.coalesce("title", "_t").alias("title"))
    resolved = exact.where("title IS NOT NULL").unionByName(rest)
    return resolved.select(F.col("_law").alias(law), "title")


def check_citations(answers: DataFrame, laws: DataFrame, key: str = "case_id", text: str = "answer", seq: str = "law_id", least: float = 0.5) -> DataFrame:
    """One row per citation: key, law, article, para, title, name_matched, article_exists, content_score, valid."""
    statutes, names = statute_index(laws, seq)
    cited = answers.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.posexplode(citations(F.col(text))).alias("pos", "_c")).select("_k", "_t", "pos", "_c.law", "_c.article", "_c.para")
    titled = cited.join(resolve_names(cited, names), "law", "left")
    joined = titled.join(statutes, ["title", "article"], "left")
    score = F.when(F.col("text").isNotNull(), lexical_score(F.col("_t"), F.col("text")))
    return joined.select(
        F.col("_k").alias(key), "pos", "law", "article", "para", "title", F.col("title").isNotNull().alias("name_matched"), F.col("text").isNotNull().alias("article_exists"),
        F.round(score, 6).alias("content_score"), F.coalesce(score >= least, F.lit(False)).alias("valid"),
    )


def verify(answers: DataFrame, laws: DataFrame, key: str = "case_id", text: str = "answer", seq: str = "law_id") -> DataFrame:
    """Per answer: total, valid, invalid citations and nhsr, the share of valid ones (null without any)."""
    per = check_citations(answers, laws, key, text, seq).groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"))
    out = answers.select(key).join(per, key, "left").select(key, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("valid", F.lit(0)).alias("valid"))
    return out.select(key, "total", "valid", (F.col("total") - F.col("valid")).alias("invalid"), F.when(F.col("total") > 0, F.round(F.col("valid") / F.col("total"), 6)).alias("nhsr"))


def nearest_article(asked: DataFrame, statutes: DataFrame) -> DataFrame:
    """(title, wanted, article): the existing article nearest to the wanted one, the smaller at a tie."""
    joined = asked.select("title", F.col("article").alias("wanted")).distinct().join(statutes.select("title", "article"), "title")
    return joined.groupBy("title", "wanted").agg(F.min_by("article", F.struct(F.abs(F.col("article") - F.col("wanted")), F.col("article"))).alias("article"))


def law_summary(statutes: DataFrame) -> DataFrame:
    """(title, articles, n_articles): the sorted article numbers of each law; the titles are the law names."""
    return statutes.groupBy("title").agg(F.sort_array(F.collect_set("article")).alias("articles")).withColumn("n_articles", F.size("articles"))


def embedding_score(a: Column, b: Column) -> Column:
    """C11: cosine of two vectors, with 1e-9 in the denominator."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def available_citations(chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, citations): the distinct 《law》第N条 of each chunk in order."""
    names = F.transform(citations(F.col(text)), lambda c: F.format_string("《%s》第%d条", c["law"], c["article"]))
    return chunks.select(key, F.array_sort(F.array_distinct(names)).alias("citations"))


__all__ = ["PREFIX", "article_rows", "articles", "available_citations", "check_citations", "nearest_article", "resolve_names", "statute_index", "verify"]
