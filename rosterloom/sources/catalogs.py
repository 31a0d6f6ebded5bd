"""The field dictionary, derived from live schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def dictionary(spark: SparkSession, tables: dict[str, DataFrame], notes: dict[str, str] | None = None) -> DataFrame:
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable, (notes or {}).get(f"{t}.{f.name}")) for t, df in sorted(tables.items()) for f in df.schema]
    return spark.createDataFrame(rows, "tbl string, field string, kind string, nullable boolean, note string").distinct()
