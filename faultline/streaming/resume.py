"""Resumable work: what is done is skipped, by an anti-join in batches or by a stream's checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.functions.text import hms
from faultline.functions.values import average_seconds, remaining_seconds


def pending(work: DataFrame, done: DataFrame, key: str = "case_id", limit: int | None = None, order: str = "seq") -> DataFrame:
    """Rows whose key is not done yet; a limit takes the first rows of all work, as they come, before the skip."""
    first = work.orderBy(order).limit(limit) if limit else work
    return first.join(done.select(key).distinct(), key, "left_anti")


def progress(work: DataFrame, done: DataFrame, key: str = "case_id", elapsed: str = "elapsed_seconds") -> DataFrame:
    """One row: totals, percent (halves to even), seconds and estimate. Done keys count even where the work has them no more."""
    total = work.agg(F.count_distinct(key).alias("total_cases"))
    spent = done.groupBy(key).agg(F.max(elapsed).alias("s")).agg(F.count(F.lit(1)).alias("completed_cases"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("elapsed_total_seconds"))
    row = total.crossJoin(spent)  # one row each
    row = row.withColumn("average_seconds", average_seconds(F.col("elapsed_total_seconds"), F.col("completed_cases")))
    row = row.withColumn("remaining_seconds", remaining_seconds(F.col("average_seconds"), F.col("total_cases") - F.col("completed_cases")))
    percent = F.when(F.col("total_cases") > 0, F.bround(F.col("completed_cases") * 100.0 / F.col("total_cases"), 2)).otherwise(0.0)
    return row.withColumns({"percent": percent, "status": F.expr("if(completed_cases >= total_cases, 'completed', 'running')"), "elapsed_hms": hms(F.col("elapsed_total_seconds")), "remaining_hms": hms(F.col("remaining_seconds"))})


def stream_new(spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Processes files of JSON lines that have arrived since the last call, once each, and stops; the checkpoint remembers them.

    A batch that is tried again replaces its own folder, so its rows appear once.
    """
    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
