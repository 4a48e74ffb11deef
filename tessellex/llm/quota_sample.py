"""Problem 2: a sample whose cells have given target shares.

Fractional quotas of a two-way table (department x band) are made integer by controlled rounding: a
maximum flow with lower bounds keeps every row margin, every column margin and the total within one of
the fractional table. Each cell then gives exactly its quota of rows, those with the smallest random
keys. The keys' order statistics come from a histogram of key prefixes, so that no cell, however large,
is ever sorted as a whole: only the rows in the one prefix bucket that the quota cuts are ranked.
"""

from __future__ import annotations

from collections import defaultdict, deque
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import table

#: The largest number of target cells that the driver plans quotas for.
MAX_CELLS = 100_000
#: Prefix buckets of the random keys, as a power of two.
PREFIX_BITS = 14


def normal_department(name: Column) -> Column:
    """Without outer blanks of any kind and in lower case."""
    return F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))


def difficulty_band(x: Column) -> Column:
    """easy below 0.3, medium from 0.3, hard from 0.6; null outside 0 to 1, for null and for NaN."""
    usable = x.between(0.0, 1.0) & ~F.isnan(x)
    return F.when(usable & (x < 0.3), "easy").when(usable & (x < 0.6), "medium").when(usable, "hard")


class _Flow:
    """Maximum flow by shortest augmenting paths over a small graph of the driver's."""

    def __init__(self) -> None:
        self.to: dict = defaultdict(dict)

    def arc(self, a, b, room: int) -> None:
        self.to[a][b] = self.to[a].get(b, 0) + room
        self.to[b].setdefault(a, 0)

    def push(self, source, sink) -> int:
        total = 0
        while True:
            before, queue = {source: source}, deque([source])
            while queue and sink not in before:
                at = queue.popleft()
                for nxt, room in self.to[at].items():
                    if room > 0 and nxt not in before:
                        before[nxt] = at
                        queue.append(nxt)
            if sink not in before:
                return total
            path, at = [], sink
            while at != source:
                path.append((before[at], at))
                at = before[at]
            step = min(self.to[a][b] for a, b in path)
            for a, b in path:
                self.to[a][b] -= step
                self.to[b][a] += step
            total += step


def controlled_rounding(cells: dict[tuple, float]) -> dict[tuple, int]:
    """Integers for a fractional two-way table.

    Every entry becomes its floor or ceiling, and so does the sum of every row, of every column and of
    the whole table. Such a table always exists, since the fractional table is itself a feasible flow.
    An entry that is whole up to 1e-9 stays as it is.
    """

    def bounds(x: float) -> tuple[int, int]:
        near = round(x)
        return (near, near) if abs(x - near) < 1e-9 * max(1.0, abs(x)) else (floor(x), ceil(x))

    rows, columns = defaultdict(float), defaultdict(float)
    for (r, c), x in cells.items():
        rows[r] += x
        columns[c] += x
    arcs = [(("row", r), ("column", c), *bounds(x)) for (r, c), x in cells.items()]
    arcs += [("start", ("row", r), *bounds(x)) for r, x in rows.items()]
    arcs += [(("column", c), "end", *bounds(x)) for c, x in columns.items()]
    arcs.append(("end", "start", *bounds(sum(cells.values()))))
    flow, need = _Flow(), 0
    for a, b, low, high in arcs:
        flow.arc(a, b, high - low)
        if low:
            flow.arc("super", b, low)
            flow.arc(a, "sub", low)
            need += low
    if flow.push("super", "sub") != need:
        raise ArithmeticError("no controlled rounding: the table has a negative or infinite entry")
    out = {}
    for (r, c), x in cells.items():
        low, high = bounds(x)
        out[r, c] = high - flow.to["row", r][("column", c)] if high > low else low
    return out


def fractional_quotas(cells: list[dict], size: int) -> dict[tuple, float]:
    """The share of each cell, at least its minimum, at most its rows; what cells lack goes to the others in proportion."""
    low = {(c["department"], c["band"]): min(c["min_rows"], c["usable"]) for c in cells}
    high = {(c["department"], c["band"]): c["usable"] for c in cells}
    share = {(c["department"], c["band"]): c["target_pm"] for c in cells}

    def at(scale: float) -> dict[tuple, float]:
        return {k: min(high[k], max(low[k], scale * share[k])) for k in share}

    size = min(size, sum(high[k] if share[k] else low[k] for k in share))
    lo, hi = 0.0, 1.0
    while sum(at(hi).values()) < size and hi < 1e15:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid).values()) < size else (lo, mid)
    return at(hi)


def _usable(rows: DataFrame, *more: str, department: str, difficulty: str) -> DataFrame:
    picked = rows.select(
        normal_department(F.col(department)).alias("department"),
        difficulty_band(F.col(difficulty).cast("double")).alias("band"),
        *[F.col(c).alias(f"_{k}") for k, c in enumerate(more)],
    )
    return picked.where("department IS NOT NULL AND band IS NOT NULL")


def quota_report(
    rows: DataFrame, targets: DataFrame, size: int | None = None, department: str = "department", difficulty: str = "difficulty"
) -> list[dict]:
    """The plan of the sample: one dict per cell of ``targets``.

    ``size`` is half of all rows, rounded down, unless given. Keys: department, band, target_pm, min_rows,
    usable, needed (the larger of min_rows and the exact share), met, quota. Nulls in target_pm and
    min_rows count as 0; rows of a cell that is named twice count as one cell with the sum of the
    shares and the larger minimum; a cell of null department or band has no usable rows.
    """
    wanted = (
        targets.groupBy("department", "band")
        .agg(F.sum(F.coalesce("target_pm", F.lit(0))).alias("target_pm"), F.max(F.coalesce("min_rows", F.lit(0))).alias("min_rows"))
        .limit(MAX_CELLS + 1)
    )
    counted = _usable(rows, department=department, difficulty=difficulty).groupBy("department", "band").agg(F.count(F.lit(1)).alias("usable"))
    cells = [
        r.asDict() | {"usable": r["usable"] or 0}
        for r in wanted.join(counted.withColumnsRenamed({"department": "d", "band": "b"}), (F.col("department") == F.col("d")) & (F.col("band") == F.col("b")), "left")
        .select("department", "band", "target_pm", "min_rows", "usable")
        .collect()
    ]
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} target cells")
    if size is None:
        size = rows.count() // 2
    for c in cells:
        c["needed"] = max(c["min_rows"], c["target_pm"] * size / 1000)
        c["met"] = c["usable"] * 1000 >= max(c["min_rows"] * 1000, c["target_pm"] * size)
    quotas = controlled_rounding(fractional_quotas(cells, size)) if cells else {}
    return [c | {"quota": quotas[c["department"], c["band"]]} for c in cells]


REPORT = "department string, band string, target_pm bigint, min_rows int, usable bigint, needed double, met boolean, quota bigint"


def report_frame(spark: SparkSession, cells: list[dict]) -> DataFrame:
    """The plan as a table of one row per target cell."""
    names = [x.split()[0] for x in REPORT.split(", ")]
    return spark.createDataFrame([tuple(float(c[n]) if n == "needed" else c[n] for n in names) for c in cells], REPORT)


def quota_sample(
    rows: DataFrame, targets: DataFrame, size: int | None = None, seed: int = 17, key: str = "case_id", department: str = "department", difficulty: str = "difficulty"
) -> tuple[DataFrame, DataFrame]:
    """(sample, report). The sample has ``key``, department and band of exactly ``quota`` rows of each cell.

    A row's random key is a hash of ``seed`` and ``key``; repeated keys keep their own draws by their place
    among equals. Rows with null or unlisted department, or difficulty null, NaN or out of range, are in
    no cell. Other columns of ``rows``, whatever their names, are not touched. An empty table gives an
    empty sample and a report of what is missing.
    """
    spark = rows.sparkSession
    cells = quota_report(rows, targets, size, department, difficulty)
    keyed = _usable(rows, key, department=department, difficulty=difficulty).withColumn("_h", F.xxhash64(F.lit(seed), F.col("_0")))
    keyed = keyed.withColumn("_p", F.shiftrightunsigned("_h", 64 - PREFIX_BITS).cast("int"))
    quotas = spark.createDataFrame([(c["department"], c["band"], c["quota"]) for c in cells if c["quota"]], "department string, band string, _q bigint")
    per = keyed.groupBy("department", "band", "_p").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(quotas), ["department", "band"])
    upto = F.sum("_n").over(Window.partitionBy("department", "band").orderBy("_p"))
    # One row per cell: the bucket that the quota cuts, and how many of its rows belong to the sample.
    edge = per.withColumn("_upto", upto).where("_upto >= _q AND _upto - _n < _q").select("department", "band", F.col("_p").alias("_cut"), (F.col("_q") - F.col("_upto") + F.col("_n")).alias("_rest"))
    near = keyed.join(F.broadcast(edge), ["department", "band"])  # at most one row per target cell
    whole = near.where("_p < _cut")
    rank = F.row_number().over(Window.partitionBy("department", "band").orderBy("_h", "_0"))
    part = near.where("_p = _cut").withColumn("_r", rank).where("_r <= _rest").drop("_r")
    sample = whole.unionByName(part).select(F.col("_0").alias(key), "department", "band")
    return sample, report_frame(spark, cells)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    cells = quota_report(table(spark, folder, "contract"), table(spark, folder, "sample_targets"))
    return report_frame(spark, cells).where(~F.col("met")).select("department", "band")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return report_frame(spark, quota_report(table(spark, folder, "contract"), table(spark, folder, "sample_targets")))


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quota_sample(table(spark, folder, "contract"), table(spark, folder, "sample_targets"))[0]


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_sample": p2_sample}
SQL = {
    "p2_found": r"""
        WITH c AS (SELECT lower(regexp_replace(department, '^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$', '', 'g')) AS department,
                          CASE WHEN difficulty < 0.3 THEN 'easy' WHEN difficulty < 0.6 THEN 'medium' ELSE 'hard' END AS band
                   FROM contract WHERE difficulty BETWEEN 0 AND 1),
             n AS (SELECT department, band, count(*) AS usable FROM c GROUP BY ALL),
             s AS (SELECT count(*) // 2 AS size FROM contract)
        SELECT t.department, t.band FROM sample_targets t CROSS JOIN s LEFT JOIN n ON n.department = t.department AND n.band = t.band
        WHERE 1000 * coalesce(usable, 0) < greatest(1000 * min_rows, target_pm * size)""",
}
