"""Sinks: rows as JSON lines or as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON object per row, in the column ``value``; null fields are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def text_rows(rows: DataFrame, separator: str = "\t") -> DataFrame:
    return rows.select(F.concat_ws(separator, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
