"""Reproducible samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw_key(seed: int, key: Column) -> Column:
    """A random but fixed order of rows, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def first_n(rows: DataFrame, n: int, seed: int, seq: str) -> DataFrame:
    """M7, M8: n rows without replacement (a sampling operator: n is the feature)."""
    return rows.orderBy(draw_key(seed, F.col(seq)), seq).limit(n)


def rank_in_groups(rows: DataFrame, group: list[str], order: list[Column | str], buckets: Column) -> DataFrame:
    """Adds _pos, the place in the group's order, and _n, its size, without sorting a whole group in one task.

    Rows are ranked within (group, bucket), where buckets follow the order; the buckets' sizes, summed up, give the rest.
    """
    tagged = rows.withColumn("_b", buckets)
    sizes = tagged.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy(*group)
    sizes = sizes.withColumn("_o", F.sum("_c").over(own.orderBy("_b")) - F.col("_c")).withColumn("_n", F.sum("_c").over(own)).drop("_c")
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group] + [F.col("l._b").eqNullSafe(F.col("r._b"))]
    joined = tagged.alias("l").join(sizes.alias("r"), same).select("l.*", "r._o", "r._n")
    place = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order))
    return joined.withColumn("_pos", place + F.col("_o")).drop("_b", "_o")


def stratified_split(rows: DataFrame, by: str, difficulty: str, seq: str, train: float = 0.7, evaluation: float = 0.15) -> DataFrame:
    """M5: adds split; within each group the easiest 70 % are train, the next 15 % eval, the hardest test."""
    steps = F.floor(F.coalesce(F.col(difficulty), F.lit(0.0)) * 200).cast("int")
    ranked = rank_in_groups(rows, [by], [F.coalesce(F.col(difficulty), F.lit(0.0)), seq], steps)
    a, b = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(evaluation))
    return ranked.withColumn("split", F.when(F.col("_pos") <= a, "train").when(F.col("_pos") <= a + b, "eval").otherwise("test")).drop("_pos", "_n")


def random_split(rows: DataFrame, seed: int, seq: str, train: float = 0.8, evaluation: float = 0.1) -> DataFrame:
    """Adds split by rank of the random key, 80 / 10 / 10."""
    key = draw_key(seed, F.col(seq))
    ranked = rank_in_groups(rows.withColumn("_k", key).withColumn("_g", F.lit(0)), ["_g"], ["_k", seq], F.substring("_k", 1, 3))
    a, b = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(evaluation))
    return ranked.withColumn("split", F.when(F.col("_pos") <= a, "train").when(F.col("_pos") <= a + b, "eval").otherwise("test")).drop("_pos", "_n", "_k", "_g")


def allocation(sizes: dict[str, int], most: int) -> dict[str, int]:
    """M4: rows per category: a least number each, then the rest by size, largest first, of what remains."""
    total = sum(sizes.values())
    if total <= most:
        return dict(sizes)
    least = max(1, most // (4 * max(1, len(sizes))))
    out = {c: min(least, n) for c, n in sizes.items()}
    rest = most - sum(out.values())
    for c in sorted(sizes, key=lambda c: (-sizes[c], c)):
        more = max(0, min(sizes[c] - out[c], int(rest * sizes[c] / total)))
        out[c] += more
        rest -= more
    for c in sorted(sizes, key=lambda c: (-sizes[c], c)):  # what is still left comes from where there are rows
        more = min(sizes[c] - out[c], rest)
        out[c] += more
        rest -= more
    return out


def diversity_sample(rows: DataFrame, by: str, bucket: str, most: int, seed: int, seq: str) -> DataFrame:
    """M4: at most ``most`` rows over all categories, within each 3 : 4 : 3 of easy, medium and hard, topped up from what is left; all rows if there are no more."""
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}  # one row per category
    if sum(counts.values()) <= most:
        return rows
    target = allocation(counts, most)
    plan = rows.sparkSession.createDataFrame([(c, n) for c, n in target.items()], f"_c {rows.schema[by].dataType.simpleString()}, _t int")
    share = F.when(F.col(bucket) == "medium", 0.4).otherwise(0.3)
    key = draw_key(seed, F.col(seq))
    ranked = rank_in_groups(rows.withColumn("_k", key), [by, bucket], ["_k", seq], F.substring("_k", 1, 3)).drop("_n")
    planned = ranked.join(F.broadcast(plan), F.col(by).eqNullSafe(F.col("_c"))).withColumn("_own", F.col("_pos") <= F.floor(F.col("_t") * share))
    order = F.concat(F.when(F.col("_own"), "0").otherwise("1"), F.col("_k"))
    second = rank_in_groups(planned.drop("_pos").withColumn("_k", order), [by], ["_k", seq], F.substring("_k", 1, 4))
    return second.where("_pos <= _t").drop("_pos", "_n", "_c", "_t", "_own", "_k")
