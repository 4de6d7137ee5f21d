"""Accepted table schemas, one small JSON text per table."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from orderloom.sources.files import has_data


def stored_schema(spark: SparkSession, store: str, table: str) -> T.StructType | None:
    path = f"{store}/{table}"
    if not has_data(spark, path):
        return None
    return T.StructType.fromJson(json.loads(spark.read.text(path, wholetext=True).first()[0]))


def accept_schema(spark: SparkSession, store: str, table: str, schema: T.StructType) -> None:
    row = spark.createDataFrame([(schema.json(),)], "value string").coalesce(1)
    row.write.mode("overwrite").text(f"{store}/{table}")
