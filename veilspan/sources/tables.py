"""Replacement tables: reading them under any of their usual column names, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import xlsx

# Names under which the columns are known, without regard to case, and the names that are written.
UUID_NAMES = ("замена (идентификатор)", "замена", "uuid", "identifier", "replacement", "идентификатор")
VALUE_NAMES = ("исходные данные", "исходное значение", "original_value", "original", "value", "оригинал")
WRITTEN = {"number": "№", "original_value": "Исходные данные", "uuid": "Замена (идентификатор)", "block_id": "ID блока документа"}


def _column(df: DataFrame, names: tuple[str, ...]) -> str:
    by_name = {c.strip().lower(): c for c in reversed(df.columns)}
    for n in names:
        if n in by_name:
            return by_name[n]
    raise ValueError(f"none of the columns {df.columns} is one of {names}")


def replacement_table(df: DataFrame) -> DataFrame:
    """uuid, original_value of a table under any of the known names.

    Both are trimmed; rows where one is missing, empty or `nan` go; of equal uuids the last row counts, as rows come in files.
    """
    rows = df.select(F.trim(F.col(f"`{_column(df, UUID_NAMES)}`").cast("string")).alias("uuid"), F.trim(F.col(f"`{_column(df, VALUE_NAMES)}`").cast("string")).alias("original_value"))
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    for c in ("uuid", "original_value"):
        rows = rows.where(F.col(c).isNotNull() & ~F.lower(c).isin("", "nan"))
    return rows.groupBy("uuid").agg(F.max_by("original_value", "_at").alias("original_value"))


def read_replacements(spark: SparkSession, path: str) -> DataFrame:
    """A replacement table from CSV files, or from workbooks if the path ends in .xlsx."""
    if path.lower().endswith(".xlsx"):
        return replacement_table(xlsx.read_table(spark, path))
    return replacement_table(spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True))


def write_replacements(table: DataFrame, path: str) -> None:
    """A replacement table (number, original_value, uuid, block_id) as CSV files under its usual names."""
    table.select(*(F.col(c).alias(n) for c, n in WRITTEN.items())).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def replacement_workbooks(table: DataFrame) -> DataFrame:
    """doc_id, content: the replacement table (doc_id, number, original_value, uuid, block_id) of each document as a workbook."""
    return xlsx.workbooks(table, "doc_id", "Замены", WRITTEN, "number")


def write_ledger(ledger: DataFrame, path: str) -> None:
    """A ledger (doc_id, ledger) as JSON lines."""
    ledger.select("ledger").write.mode("overwrite").text(path)
