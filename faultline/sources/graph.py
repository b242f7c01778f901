"""Graph sinks: CSV for bulk import, and a property-graph store behind a port."""

from __future__ import annotations

import base64
import json
import re
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from faultline.settings import GraphDatabase
from faultline.sources.jsonl import exists


class GraphStore(Protocol):
    """What a property-graph connection must offer; an instance is made in each task."""

    def ping(self) -> bool: ...
    def clear(self) -> None: ...
    def ensure_unique_id(self) -> None: ...
    def merge_nodes(self, rows: list[dict]) -> None: ...
    def merge_edges(self, rows: list[dict]) -> None: ...


def export_rows(df: DataFrame) -> DataFrame:
    """All columns in alphabetic order as strings; lists as Python writes them, nulls blank."""
    def cell(name: str):
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, ArrayType):
            quoted = F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))) if isinstance(kind.elementType, StringType) else F.transform(c, lambda x: x.cast("string"))
            c = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
        elif isinstance(kind, StructType):
            c = F.to_json(c)
        elif kind.typeName() == "boolean":
            c = F.when(c, "True").otherwise(F.when(~c, "False"))
        return F.coalesce(c.cast("string"), F.lit("")).alias(name)

    return df.select(*(cell(n) for n in sorted(df.columns)))


BOM = "\ufeff"


def export_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts, in parallel; each begins with a byte order mark and has the header."""
    rows = export_rows(df)
    first = rows.columns[0]
    rows.withColumnRenamed(first, BOM + first).write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What ``export_csv`` or ``export_csv_file`` wrote, all columns as strings."""
    rows = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)
    return rows.toDF(*(c.removeprefix(BOM) for c in rows.columns))


def export_csv_file(df: DataFrame, path: str) -> int:
    """One local CSV file with a byte order mark; rows stream through the driver a partition at a time."""
    import csv

    rows, n = export_rows(df), 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        for row in rows.toLocalIterator():
            out.writerow(row)
            n += 1
    return n


def choose(spark: SparkSession, fused: tuple[str, str], raw: tuple[str, str], use_fused: bool | None = None, explicit: bool = False) -> tuple[str, str]:
    """Fused paths if asked for, or if nobody said otherwise and both exist; else raw ones."""
    if use_fused is None:
        use_fused = not explicit and all(exists(spark, p) for p in fused)
    return fused if use_fused else raw


def stored_form(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a store holds after merging: the last row of each node id and of each (source, type, target), without edges that lack an end."""
    def last(df: DataFrame, *key: str) -> DataFrame:
        rest = [c for c in df.columns if c not in key]
        return df.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("_last")).select(*(c if c in key else F.col("_last")[c].alias(c) for c in df.columns))

    nodes = last(nodes, "id")
    ids = nodes.select("id")
    ended = edges.join(ids, edges.source_id == ids.id, "left_semi").join(ids, edges.target_id == ids.id, "left_semi")
    return nodes, last(ended, "source_id", "type", "target_id")


def write_graph(nodes: DataFrame, edges: DataFrame, connect: Callable[[], GraphStore], *, clear: bool = False, batch: int = 1000) -> tuple[int, int]:
    """Merges nodes, then edges, in batches from the tasks."""
    store = connect()
    if clear:
        store.clear()
    store.ensure_unique_id()
    nodes, edges = stored_form(nodes, edges)

    def sender(method: str) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = connect()
            for frame in frames:
                rows = frame.to_dict("records")
                for k in range(0, len(rows), batch):
                    getattr(own, method)(rows[k : k + batch])
                yield pd.DataFrame({"n": [len(rows)]})

        return run

    counts = []
    for df, method in ((nodes, "merge_nodes"), (edges, "merge_edges")):
        counts.append(df.mapInPandas(sender(method), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return counts[0], counts[1]


def check_graph(connect: Callable[[], GraphStore]) -> bool:
    return connect().ping()


LABEL = re.compile(r"\w+")


class HttpGraph:
    """A property-graph database that takes Cypher statements over HTTP in one transaction a call; made in each task."""

    def __init__(self, at: GraphDatabase, database: str = "neo4j", timeout: float = 60.0):
        if not at.uri.startswith(("http://", "https://")):
            raise RuntimeError("the graph database needs an http address")
        self.address, self.timeout = f"{at.uri.rstrip('/')}/db/{database}/tx/commit", timeout
        self.login = base64.b64encode(f"{at.user}:{at.password}".encode()).decode()

    def _post(self, body: dict) -> dict:
        request = urllib.request.Request(self.address, json.dumps(body, default=str).encode(), {"Content-Type": "application/json", "Accept": "application/json", "Authorization": f"Basic {self.login}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def run(self, *statements: tuple[str, dict]) -> list:
        answer = self._post({"statements": [{"statement": s, "parameters": p} for s, p in statements]})
        if answer.get("errors"):
            raise RuntimeError(f"the graph database refuses: {answer['errors'][0]}")
        return answer.get("results", [])

    def ping(self) -> bool:
        try:
            return bool(self.run(("RETURN 1 AS ok", {})))
        except (OSError, ValueError, RuntimeError):
            return False

    def clear(self) -> None:
        self.run(("MATCH (n:KGNode) DETACH DELETE n", {}))

    def ensure_unique_id(self) -> None:
        self.run(("CREATE CONSTRAINT kg_node_id IF NOT EXISTS FOR (n:KGNode) REQUIRE n.id IS UNIQUE", {}))

    @staticmethod
    def _by(rows: list[dict], key: str) -> dict[str, list[dict]]:
        """Rows by a label or type, which Cypher takes as a name only."""
        out: dict[str, list[dict]] = {}
        for r in rows:
            name = str(r.get(key) or "")
            if not LABEL.fullmatch(name):
                raise ValueError(f"{name!r} can't be a {key}")
            out.setdefault(name, []).append({k: x.tolist() if hasattr(x, "tolist") else x for k, x in r.items()})
        return out

    def merge_nodes(self, rows: list[dict]) -> None:
        self.run(*((f"UNWIND $rows AS r MERGE (n:KGNode {{id: r.id}}) SET n:`{name}`, n += r", {"rows": own}) for name, own in self._by(rows, "label").items()))

    def merge_edges(self, rows: list[dict]) -> None:
        self.run(*((f"UNWIND $rows AS r MATCH (a:KGNode {{id: r.source_id}}), (b:KGNode {{id: r.target_id}}) MERGE (a)-[e:`{name}`]->(b) SET e += r", {"rows": own}) for name, own in self._by(rows, "type").items()))
