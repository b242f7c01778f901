"""Tables on the storage that driver and executors share, and connected components on them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a local session gets a temporary one; a cluster has none that all share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        if app not in _OWN_ROOTS:
            _OWN_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="faultline-")
        root = _OWN_ROOTS[app]
    return root.rstrip("/")


class Scratch:
    """Tables written under the shared folder: they cut lineage and outlive any executor.

    ``save`` writes and rereads; ``drop`` removes what no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_seen(self, df: DataFrame, name: str, **what: Column) -> tuple[DataFrame, dict]:
        """``save``, and aggregates of the rows observed on the way."""
        seen = Observation()
        saved = self.save(df.observe(seen, *(c.alias(k) for k, c in what.items())), name)
        return saved, seen.get

    def _path(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        for name in names:
            path, store = self._path(name)
            store.delete(path, True)

    def keep(self, *names: str) -> None:
        """Removes all tables but these."""
        root, store = self._path()
        self.drop(*(n for n in (x.getPath().getName() for x in store.listStatus(root)) if n not in names))


def components(scratch: Scratch, edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges`` (a, b of one ordered type): (node, component), component being the smallest node.

    Large-star and small-star turns alternate until the edges no longer change; each turn is aggregated before
    its shuffle, written to the shared folder and never gathered anywhere. Star-like input settles in two turns.
    """
    marks = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    first = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    (now, state), turn, before = scratch.save_seen(first, f"{label}-0", **marks), 0, None
    while state["n"] and state != before:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        pairs = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = pairs.groupBy("a").agg(F.min("b").alias("m"))
        small = pairs.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b")))
        turn, before = turn + 1, state
        now, state = scratch.save_seen(small.distinct(), f"{label}-{turn}", **marks)
        scratch.drop(f"{label}-{turn - 1}")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
