"""Problem 7: mixing sources to target shares of the total size.

Token sizes per cell of source, language and topic are raked by iterative proportional fitting to three
margins: the sources' targets, and the shares that languages and topics shall have of the mix (those they have
of all documents, unless given), with no cell used more often than its source may be. Where the margins
contradict each other, the sources' hold and the others are met as nearly as proportional fitting comes. Each document then comes into the mix as
often as the whole part of its cell's weight says, and once more with the weight's fraction as its
probability; the probabilities are calibrated per source against the sizes in order of the documents'
random numbers, so that a source's share is met to a small part of its size and not just in expectation.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, table
from .byte_bpe import VOCABULARY, encode_texts

#: The endings of law titles by which documents are put under a topic.
TOPICS = ("法", "条例", "办法", "解释", "规则", "规定", "通则", "细则", "决定")
#: The largest number of cells (source x language x topic) that the driver rakes.
MAX_CELLS = 200_000
#: Steps in which a source's random numbers are summed.
STEPS = 1 << 14


def language(lang: Column) -> Column:
    """The main code in lower case: 'zh-x' and 'ZH' are zh; 'und' for null, blank or undetermined."""
    code = F.lower(F.regexp_extract(F.coalesce(lang, F.lit("")), r"^\s*(\p{L}+)", 1))
    return F.when(code == "", "und").otherwise(code)


def topic(title: Column) -> Column:
    """The kind of law that a document is about, by its title's ending; 'other' if there is none."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"[（(][^）)]*[）)]\s*$", "")
    out = F.lit("other")
    for ending in TOPICS:  # the last one wins: 办法 also ends with 法
        out = F.when(bare.endswith(ending), ending).otherwise(out)
    return out


def rake(cells: dict[tuple, float], margins: list[dict], caps: dict, rounds: int = 200) -> dict[tuple, float]:
    """Weights of cells by iterative proportional fitting.

    ``cells`` has the size of each cell, named by a tuple with the source first; ``margins[d]`` the
    target size of each name in place d (names without a target keep their size); ``caps`` the largest
    weight by source. The source margin is fitted last in every round. A source whose size times cap
    is below its target ends with the cap in all its cells. Target 0 gives weight 0.
    """
    weight = {c: 1.0 for c in cells}
    for _ in range(rounds):
        moved = 0.0
        for place in [*range(1, len(margins)), 0]:
            for _ in range(50 if place == 0 else 1):  # what a capped cell cannot give, the source's others do
                sums, free = defaultdict(float), defaultdict(float)
                for c, size in cells.items():
                    sums[c[place]] += size * weight[c]
                    if weight[c] < caps.get(c[0], 1) - 1e-12:
                        free[c[place]] += size * weight[c]
                change = 0.0
                for c in cells:
                    goal = margins[place].get(c[place])
                    cap = caps.get(c[0], 1)
                    if goal is None:
                        continue
                    lack = goal - sums[c[place]]
                    if lack <= 0:
                        new = weight[c] * goal / sums[c[place]] if sums[c[place]] else 0.0
                    elif weight[c] < cap - 1e-12 and free[c[place]]:
                        new = min(cap, weight[c] * (1 + lack / free[c[place]]))
                    else:
                        new = weight[c]
                    change = max(change, abs(new - weight[c]))
                    weight[c] = new
                moved = max(moved, change)
                if change < 1e-12:
                    break
        if moved < 1e-10:
            break
    return weight


def _sized(documents: DataFrame, key: str, vocabulary: str) -> DataFrame:
    picked = documents.select(F.col(key).alias("_key"), "text", F.col("source").alias("_source"), language(F.col("lang")).alias("_lang"), topic(F.col("law_title")).alias("_topic"))
    return encode_texts(picked, "_key", "text", vocabulary, True, ("_source", "_lang", "_topic"))


def _cells(sized: DataFrame) -> list:
    """The tokens of each cell; raises if they are too many for the driver."""
    sizes = sized.groupBy("_source", "_lang", "_topic").agg(F.sum("tokens").alias("tokens")).limit(MAX_CELLS + 1).collect()
    if len(sizes) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic")
    return sizes


def _targets(targets: DataFrame) -> dict:
    """(thousandths, repeats) by source: of one named twice the shares add up and the smaller number of repeats holds; raises if they are too many for the driver."""
    per = targets.groupBy("source").agg(F.sum(F.coalesce("target_pm", F.lit(0))).alias("pm"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("n"))
    rows = per.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} sources with targets")
    return {r["source"]: (r["pm"], r["n"]) for r in rows}


def _plan(sizes: list, wanted: dict, languages: dict[str, float] | None = None, topics: dict[str, float] | None = None) -> tuple[dict[tuple, float], list[tuple]]:
    """Weights of the cells, and the report's rows but for the actual tokens."""
    cells = {(r["_source"], r["_lang"], r["_topic"]): float(r["tokens"]) for r in sizes}
    total, have = sum(r["tokens"] for r in sizes), defaultdict(int)
    for r in sizes:
        have[r["_source"]] += r["tokens"]
    known = {s: wanted.get(s, (0, 0)) for s in {*have, *wanted}}
    reach = {s: min(total * pm / 1000, have[s] * n) for s, (pm, n) in known.items()}
    mixed = sum(reach.values())

    def margin(place: int, shares: dict[str, float] | None) -> dict[str, float]:
        if shares is None:
            shares = defaultdict(float)
            for cell, size in cells.items():
                shares[cell[place]] += size
        whole = sum(shares.values()) or 1.0
        return {name: mixed * x / whole for name, x in shares.items()}

    weights = rake(cells, [reach, margin(1, languages), margin(2, topics)], {s: n for s, (_, n) in known.items()})
    report = [(s, pm, n, have[s], total, have[s] * n * 1000 < total * pm) for s, (pm, n) in known.items()]
    return weights, report


REPORT = "source string, target_pm bigint, max_repeats int, source_tokens bigint, total_tokens bigint, short boolean"


def mix_plan(documents: DataFrame, targets: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per source of either table: target, tokens, and whether even all repeats fall short of it."""
    return documents.sparkSession.createDataFrame(_plan(_cells(_sized(documents, key, vocabulary)), _targets(targets))[1], REPORT)


def mix_sources(
    documents: DataFrame, targets: DataFrame, seed: int = 29, key: str = "doc_id", vocabulary: str = VOCABULARY, languages: dict[str, float] | None = None, topics: dict[str, float] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(mix, report).

    The mix has ``key``, source, tokens and repeats (1 or more) of every document used. The mix is as
    large as all documents, each counted once, less what sources fall short of. The report has one row
    per source, with actual_tokens, actual_pm (thousandths of the mix's tokens) and off_pm, what these are above
    or below the target: where some sources fall short, the others make up more of the mix than their targets.
    ``languages`` and ``topics`` are shares of the mix by name (in proportion; names without one keep what the
    sources give them). Null and empty texts have no tokens; they come in like others. A null source is a source of its own; one without target is left out, one
    without documents falls short. Null max_repeats counts as 1, null target_pm as 0. Repeated rows count
    each. An empty table gives an empty mix. Further columns, whatever their names, are ignored.
    """
    spark = documents.sparkSession
    sized = cut(_sized(documents, key, vocabulary))  # sizes are used four times and dear to make
    sizes = _cells(sized)
    weights, plan = _plan(sizes, _targets(targets), languages, topics)
    whole = {c: math.floor(w + 1e-9) for c, w in weights.items()}
    rows = [(*c, whole[c], max(0.0, w - whole[c])) for c, w in weights.items()]
    per_cell = spark.createDataFrame(rows, "_s string, _l string, _t string, _whole int, _part double")
    same = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_lang") == F.col("_l")) & (F.col("_topic") == F.col("_t"))
    joined = sized.join(F.broadcast(per_cell), same)  # at most MAX_CELLS rows
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_key")), 11) / F.lit(float(1 << 53))
    # A document's place: below 1 it would be drawn by its probability as such; the step that fits the source's size decides.
    drawn = joined.withColumn("_at", F.when(F.col("_part") > 1e-9, F.least(F.floor(u / F.col("_part") * (STEPS // 4)), F.lit(STEPS))))
    need: dict = defaultdict(float)
    for r in sizes:
        c = (r["_source"], r["_lang"], r["_topic"])
        need[c[0]] += max(0.0, weights[c] - whole[c]) * r["tokens"]
    needs = spark.createDataFrame([(s, n) for s, n in need.items()], "_s string, _need double")
    steps = drawn.where("_at IS NOT NULL").groupBy("_source", "_at").agg(F.sum("tokens").alias("_n")).withColumn("_upto", F.sum("_n").over(Window.partitionBy("_source").orderBy("_at")))
    cutoff = steps.join(F.broadcast(needs), F.col("_source").eqNullSafe(F.col("_s"))).where("_upto - _n / 2 <= _need").groupBy("_source").agg(F.max("_at").alias("_last")).withColumnRenamed("_source", "_s2")
    out = drawn.join(F.broadcast(cutoff), F.col("_source").eqNullSafe(F.col("_s2")), "left")
    repeats = F.col("_whole") + F.coalesce((F.col("_at") <= F.col("_last")).cast("int"), F.lit(0))
    mix = out.select(F.col("_key").alias(key), F.col("_source").alias("source"), "tokens", repeats.alias("repeats")).where("repeats > 0")
    actual = mix.groupBy(F.col("source").alias("_src")).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("_n"))
    report = spark.createDataFrame(plan, REPORT).join(F.broadcast(actual), F.col("source").eqNullSafe(F.col("_src")), "left").withColumn("actual_tokens", F.coalesce("_n", F.lit(0)))
    share = F.coalesce(F.col("actual_tokens") * 1000 / F.nullif(F.sum("actual_tokens").over(Window.partitionBy()), F.lit(0)), F.lit(0.0))  # one row per source
    report = report.withColumn("actual_pm", F.round(share, 3)).withColumn("off_pm", F.round(F.col("actual_pm") - F.col("target_pm"), 3))
    report = report.select(*[x.split()[0] for x in REPORT.split(", ")], "actual_tokens", "actual_pm", "off_pm")
    return mix, report


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    plan = mix_plan(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    return plan.where("short").select("source")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


QUERIES = {"p7_found": p7_found, "p7_mix": p7_mix, "p7_report": p7_report}
SQL: dict[str, str] = {}
