"""Operator 10, sharding: size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. A tier holds shards within a factor of ``fan_in`` in size; a tier with ``fan_in``
shards or more is merged, by concatenation of whole splits and without a shuffle, into files of about ``target_bytes``; what has
reached half of that is final. Every change writes new files under a name of its own and then puts the next manifest in
force, in one step that fails if the version is there; readers go by a manifest alone and see one version. A row is rewritten once
for each tier it climbs. Files that a merge replaced stay, so that running readers can end; ``sweep`` removes them and
what lost work left.

The manifest holds the columns of all arrivals, so a read opens no file to learn them. Arrivals may have different columns: a read has all of
them, missing values being null; one whose column has another type than before is refused, and nothing of it is kept. Nulls,
ties, repeated rows, empty and very long texts and empty arrivals are stored as they are. Several drivers may append and compact:
of two that change one version one commits, the other gets RuntimeError and can try again.
"""

from __future__ import annotations

import math
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from faultline.llm import files
from faultline.llm.common import Scratch, table


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 512 << 20, fan_in: int = 4, least_bytes: int = 1 << 20):
        self.spark, self.root, self.target, self.fan_in, self.least = spark, root, target_bytes, fan_in, least_bytes
        self.manifests = files.Manifests(root)

    def shards(self) -> list[dict]:
        """The live shards: path below the root and bytes."""
        return self.manifests.latest()[1].get("shards", [])

    def _listed(self, folder: str) -> list[dict]:
        store, base = files.open_store(self.root)
        found = store.get_file_info(pafs.FileSelector(f"{base}/{folder}", recursive=True))
        return sorted(({"path": i.path.removeprefix(f"{base}/"), "bytes": i.size} for i in found if i.base_name.endswith(".parquet")), key=lambda x: x["path"])

    def schema(self) -> StructType:
        """The columns of all arrivals."""
        return StructType.fromJson(self.manifests.latest()[1].get("schema", StructType().jsonValue()))

    def _commit(self, version: int, shards: list[dict], schema: StructType, why: str) -> int:
        self.manifests.commit(version, {"version": version, "change": why, "schema": schema.jsonValue(), "shards": shards})
        return version

    def append(self, rows: DataFrame) -> int:
        """One arrival: its partitions become shards. Returns the version."""
        version, body = self.manifests.latest()
        known = StructType.fromJson(body["schema"]) if body else StructType()
        schema, folder = _united(known, rows.schema), f"data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self._commit(version + 1, body.get("shards", []) + self._listed(folder), schema, "append")

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.least, self.fan_in)) if size > self.least else 0)

    def due(self) -> list[list[dict]]:
        """Tiers with ``fan_in`` unfinished shards or more, the smallest first."""
        tiers: dict[int, list[dict]] = {}
        for s in self.shards():
            if s["bytes"] < self.target // 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return [tiers[k] for k in sorted(tiers) if len(tiers[k]) >= self.fan_in]

    def compact(self) -> int:
        """Merges due tiers until none is; returns the version in force."""
        while due := self.due():
            version, run = self.manifests.latest()[0], due[0]
            parts = max(1, round(sum(s["bytes"] for s in run) / self.target))
            folder = f"data/{uuid.uuid4().hex}"
            self._read(run).coalesce(parts).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            gone = {s["path"] for s in run}
            self._commit(version + 1, [s for s in self.shards() if s["path"] not in gone] + self._listed(folder), self.schema(), "compact")
        return self.manifests.latest()[0]

    def sweep(self) -> int:
        """Removes files that the version in force does not name; readers of older versions must have ended. Returns their number."""
        live, gone = {s["path"] for s in self.shards()}, [s["path"] for s in self._listed("data")]
        gone = [p for p in gone if p not in live]
        for path in gone:
            files.remove(f"{self.root}/{path}")
        return len(gone)

    def _read(self, shards: list[dict]) -> DataFrame:
        return self.spark.read.schema(self.schema()).option("recursiveFileLookup", "true").parquet(*(f"{self.root}/{s['path']}" for s in shards))

    def read(self) -> DataFrame:
        """All rows of the version in force."""
        if not self.manifests.latest()[0]:
            raise ValueError("nothing has been appended")
        return self._read(shards) if (shards := self.shards()) else self.spark.createDataFrame([], self.schema())


def _united(known: StructType, new: StructType) -> StructType:
    """The columns of both; names differ in more than case or have one type."""
    held = {f.name.lower(): f for f in known}
    for f in new:
        old = held.setdefault(f.name.lower(), f)
        if old.name != f.name or old.dataType != f.dataType:
            raise ValueError(f"column {f.name} is {f.dataType.simpleString()}, where the store has {old.name} {old.dataType.simpleString()}")
    return StructType([StructField(f.name, f.dataType, True) for f in held.values()])


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, Scratch(spark, "shards").root, target_bytes=32 << 20)
    arrival = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0))
    for k in range(4):
        store.append(docs.where(arrival == k))
    store.compact()
    return store.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


OP10_SQL = "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents"
