"""Writers of results."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_jsonl(rows: DataFrame, path: str) -> None:
    """K1: JSON lines in UTF-8, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_kept_and_rejected(rows: DataFrame, path: str, reason: str = "reason") -> None:
    """K2: both sides of a filter in one pass, as folders kept=true and kept=false."""
    rows.withColumn("kept", F.col(reason).isNull()).write.mode("overwrite").partitionBy("kept").json(path)


def write_cases(rows: DataFrame, path: str, by: str, seq: str, most: int = 15) -> None:
    """K3: at most ``most`` rows per category (the format's own limit), one folder each."""
    order = Window.partitionBy(by).orderBy(seq)
    rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r").write.mode("overwrite").partitionBy(by).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """K4."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """K5: a small roll-up as a Markdown table; more rows than ``most`` are refused."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in found])


def write_index(postings: DataFrame, totals: DataFrame, path: str) -> None:
    """K6: a BM25 index as parquet, postings sorted by term so that a scan for a term skips row groups."""
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    totals.write.mode("overwrite").parquet(f"{path}/totals")


def write_tokenised(rows: DataFrame, path: str) -> None:
    """K8."""
    rows.write.mode("overwrite").parquet(path)


def knowledge_base_template(path: str, sections: tuple[str, ...] = ("laws", "interpretations", "cases", "guides")) -> None:
    """K9: the folders of a knowledge base, each with a README."""
    for s in sections:
        folder = Path(path) / s
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "README.txt").write_text(f"Put {s} here as .txt files.\n", encoding="utf-8")


def write_report(rows: DataFrame, path: str, name: str = "metrics") -> None:
    """K5, K7: a small roll-up as JSON (with a time stamp, and as the latest) and as Markdown in a local folder."""
    found = [r.asDict(recursive=True) for r in rows.limit(1001).collect()]
    if len(found) > 1000:
        raise ValueError("more than 1000 rows")
    folder = Path(path)
    folder.mkdir(parents=True, exist_ok=True)
    body = json.dumps(found, ensure_ascii=False, indent=2, default=str)
    for stem in (f"{name}_{datetime.now():%Y%m%d_%H%M%S}", f"{name}_latest"):
        (folder / f"{stem}.json").write_text(body, encoding="utf-8")
    (folder / f"{name}.md").write_text(markdown(rows), encoding="utf-8")


def write_csv_with_mark(rows: DataFrame, path: str) -> None:
    """K4: a small roll-up as one CSV file that begins with a byte order mark."""
    rows.limit(100_000).toPandas().to_csv(path, index=False, encoding="utf-8-sig")  # a metrics table is some rows per category
