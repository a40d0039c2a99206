"""Where tables come from: Parquet and CSV folders, views, databases over JDBC; what a session holds."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DISTINCT = 10_000


def parquet_tables(spark: SparkSession, folder: str, names: list[str], *, views: bool = False) -> dict[str, DataFrame]:
    """``<folder>/<name>.parquet`` by name, registered as views if asked for."""
    out = {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in names}
    if views:
        for n, df in out.items():
            df.createOrReplaceTempView(n)
    return out


def csv_tables(spark: SparkSession, folder: str, names: list[str], schemas: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """``<folder>/<name>.csv`` with a header; types are inferred where no schema is given."""
    out = {}
    for n in names:
        reader = spark.read.option("header", True)
        schema = (schemas or {}).get(n)
        out[n] = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(f"{folder.rstrip('/')}/{n}.csv")
    return out


def from_spec(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    """A table from a reader specification (format, options, path), as the converters emit them."""
    reader = spark.read.format(spec["format"]).options(**spec.get("options", {}))
    return reader.load(spec["path"]) if spec.get("path") else reader.load()


def session_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Every table and view of the current database."""
    return {t.name: spark.table(t.name) for t in spark.catalog.listTables()}


def describe(tables: Mapping[str, DataFrame]) -> list[dict[str, Any]]:
    """Name, columns (name, type) and number of rows of each table."""
    return [{"table": n, "columns": [(f.name, f.dataType.simpleString()) for f in df.schema], "rows": df.count()} for n, df in tables.items()]


def approx_distinct(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """About how many different values, 10,000 at most: a hint."""
    row = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in columns]).first()
    return {c: min(MAX_DISTINCT, row[c]) for c in columns}
