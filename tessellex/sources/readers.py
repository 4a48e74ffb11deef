"""Readers of the corpus' file formats."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.citations import LOOSE
from ..functions.text import strip


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines; blank and broken ones are dropped, files of the excluded names left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if exclude:
        rows = rows.where(~F.element_at(F.split(F.input_file_name(), "/"), -1).isin(*exclude))
    return rows


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: a file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_case_files(spark: SparkSession, folder: str, schema: str = "question string, answer string, department string, difficulty double") -> DataFrame:
    """A folder of JSON arrays, without all_departments.json; a file's name is the department of rows without one."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*.json").withColumn("_f", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return rows.where("_f <> 'all_departments'").withColumn("department", F.coalesce("department", "_f")).drop("_f")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source, content) of all .txt and .md files below a folder but README ones; source is the first folder's name."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    rest = F.substring_index("path", folder.rstrip("/") + "/", -1)
    rows = rows.withColumn("source", F.when(F.contains(rest, F.lit("/")), F.substring_index(rest, "/", 1)).otherwise("."))
    return rows.where(~F.col("path").rlike(r"(?i)/README\.(txt|md)$") & (strip(F.col("content")) != "")).select("path", "source", "content")


def law_documents(laws: DataFrame) -> DataFrame:
    """(source, content), source being 'title（type）'; empty contents are dropped."""
    return laws.where("content IS NOT NULL AND trim(content) <> ''").select(F.concat(F.coalesce("title", F.lit("")), F.lit("（"), F.coalesce("type", F.lit("")), F.lit("）")).alias("source"), "content")


def docx_text(data: bytes) -> str:
    """The text of a docx file: paragraphs of its text runs, blank ones dropped."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    lines = ("".join(re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", p)) for p in xml.split("</w:p>"))
    return "\n".join(x for x in lines if x.strip())


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of docx files; content is null where a file cannot be read."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for data in batch:
                try:
                    out.append(docx_text(data))
                except (zipfile.BadZipFile, KeyError):
                    out.append(None)
            yield pd.Series(out)

    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("content"))


def read_zipped_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the first .json member (an array) of each zip file; files that cannot be read give none."""

    @F.pandas_udf("string")
    def member(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for data in batch:
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        name = next((n for n in z.namelist() if n.endswith(".json")), None)
                        out.append(z.read(name).decode("utf-8") if name else None)
                except (zipfile.BadZipFile, UnicodeDecodeError):
                    out.append(None)
            yield pd.Series(out)

    found = spark.read.format("binaryFile").load(path).select(member("content").alias("_j"))
    return found.select(F.explode(F.from_json("_j", f"array<struct<{schema}>>")).alias("_x")).select("_x.*")


def benchmark_rows(rows: DataFrame, seq: str) -> DataFrame:
    """Id 'q-i' by order, category from department, empty key points where there are none."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.orderBy(seq)) - 1  # a benchmark is some hundred rows
    return rows.select(F.concat(F.lit("q-"), n).alias("id"), F.col("department").alias("category"), "question", F.array().cast("array<string>").alias("key_points"))


def read_grouped_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: rows of JSON files that are one object of arrays by group, with the group's name as department where a row has none."""
    text = spark.read.text(path, wholetext=True)
    groups = text.select(F.explode(F.from_json("value", f"map<string, array<struct<{schema}>>>")).alias("_g", "_rows"))
    rows = groups.select("_g", F.explode("_rows").alias("_x")).select("_g", "_x.*")
    return (rows.withColumn("department", F.coalesce("department", "_g")) if "department" in rows.columns else rows.withColumn("department", F.col("_g"))).drop("_g")


def inspect(rows: DataFrame, text: str) -> DataFrame:
    """One row per column: type, nulls and distinct values (estimated); for ``text`` its mean length and citations as well."""
    counts = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"n_{c}") for c in rows.columns], *[F.approx_count_distinct(F.col(c).cast("string")).alias(f"d_{c}") for c in rows.columns], F.avg(F.length(text)).alias("_len"), F.sum(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(LOOSE))).alias("_cites"))
    types = dict(rows.dtypes)
    each = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), (F.col("_n") - F.col(f"n_{c}")).alias("nulls"), F.col(f"d_{c}").alias("distinct"), (F.col("_len") if c == text else F.lit(None).cast("double")).alias("mean_length"), (F.col("_cites") if c == text else F.lit(None).cast("bigint")).alias("citations")) for c in rows.columns]
    return counts.select(F.explode(F.array(*each)).alias("_x")).select("_x.*")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, totals) of a written index."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals")


def first_source(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first of the sources that has rows (the last one if none has); a source whose files are missing counts as empty."""
    for k, make in enumerate(sources):
        try:
            rows = make()
            if k + 1 == len(sources) or not rows.isEmpty():
                return rows
        except AnalysisException:
            if k + 1 == len(sources):
                raise
    raise ValueError("no source given")
