"""JSON lines and JSON documents."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped and a malformed line fails the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes rows as JSON lines and returns their number, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return int(seen.get["n"])


def append_jsonl(df: DataFrame, path: str) -> int:
    return write_jsonl(df, path, "append")


def reset(spark: SparkSession, *paths: str) -> None:
    """Removes outputs before a batch writes them anew."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document of one object or an array of objects."""
    return spark.read.option("multiLine", "true").json(path)


def write_document(path: str, body: dict | list) -> None:
    """A small report, map or cache as one file."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(body, f, ensure_ascii=False, indent=2)


def read_document(path: str, missing=None):
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        if missing is None:
            raise
        return missing
