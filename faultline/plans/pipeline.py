"""The whole experiment: named stages in one session, each written as Parquet, with progress and failure on the first error."""

from __future__ import annotations

import json
import time
import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from faultline.operators import causal, cases, extraction, fusion, graph, privacy
from faultline.settings import Settings
from faultline.sources import documents
from faultline.sources.graph import export_csv
from faultline.sources.jsonl import exists, write_document
from faultline.streaming.resume import pending

Stage = tuple[str, Callable[["Run"], None]]


def seconds_text(seconds: float) -> str:
    s = max(0, round(seconds))
    return f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"


@dataclass
class Run:
    """A session, settings and the tables of one experiment below ``root``."""

    spark: SparkSession
    settings: Settings
    root: str
    sources: Sequence[str] = ()
    connect: Callable = None
    limit: int | None = None
    progress_path: str | None = None
    embed: Callable = None

    def save(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        df.write.mode(mode).parquet(f"{self.root}/{name}")
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        return exists(self.spark, f"{self.root}/{name}")


def clean(run: Run) -> None:
    run.save(cases.build_cases(documents.read_paragraphs(run.spark, *run.sources), run.settings.extraction.min_case_chars), "cases")


def anonymize(run: Run) -> None:
    run.save(privacy.anonymize(run.load("cases")), "anonymized")


def current_cases(run: Run) -> DataFrame:
    return run.load("anonymized" if run.has("anonymized") else "cases")


def extract(run: Run) -> None:
    """Only cases without a result are asked about; results are appended, the case rows last."""
    known = current_cases(run)
    if run.has("results"):
        known = pending(known, run.load("results"), limit=run.limit)
    elif run.limit:
        known = known.orderBy("seq").limit(run.limit)
    if known.isEmpty():
        return
    stamp = f"{time.time_ns()}"
    found = extraction.extract(known, run.connect, run.settings.extraction, lambda d, n: run.save(d, f"held/{stamp}/{n}"))
    for name in ("nodes", "edges", "votes", "results"):
        run.save(found[name], name, "append")


def build(run: Run) -> None:
    if run.has("results"):
        known = run.load("results").select("case_id", "source_file", "title", "seq")
        files = known.select("case_id", "source_file", known.seq.alias("_case"))
        placed = lambda d: d.join(files, "case_id").withColumn("seq", d.seq + 100_000 * files._case).drop("_case")
        nodes, edges = graph.build_from_extraction(known, placed(run.load("nodes")), placed(run.load("edges")))
    else:
        nodes, edges = graph.build_from_cases(current_cases(run))
    run.save(nodes, "entities")
    run.save(edges, "triples")


def embeddings(run: Run, entities: DataFrame) -> DataFrame | None:
    """Vectors of all names to fuse; only those that the cache below ``root`` lacks are asked for. None if embeddings are off, on a dry run or without a service."""
    if not run.settings.fusion.use_embeddings or run.embed is None:
        return None
    try:
        run.embed()
    except RuntimeError:  # no key or address: as in the reference, strings decide and the report says so
        return None
    cached = lambda: run.spark.read.schema("text string, embedding array<double>").parquet(f"{run.root}/embedding_cache")
    known = cached() if run.has("embedding_cache") else run.spark.createDataFrame([], "text string, embedding array<double>")
    fusion.embed_missing(fusion.mention_names(entities), known, run.embed).write.mode("append").parquet(f"{run.root}/embedding_cache")
    return cached()


def fuse(run: Run) -> None:
    entities, triples = run.load("entities"), run.load("triples")
    vectors = embeddings(run, entities)
    how = replace(run.settings.fusion, use_embeddings=vectors is not None)
    alignment = run.save(fusion.fuse(entities, how, vectors), "alignment")
    merged = run.save(fusion.canonical_entities(entities, alignment), "canonical_entities")
    joined = run.save(graph.merge_relationships(graph.remap(triples, alignment)), "canonical_triples")
    found = run.save(fusion.conflicts(entities, alignment), "conflicts")
    report = fusion.fusion_report(entities, triples, merged, joined, found, how)
    run.spark.createDataFrame([(json.dumps(report),)], "report string").write.mode("overwrite").text(f"{run.root}/fusion_report")


def _fused(run: Run) -> tuple[DataFrame, DataFrame]:
    names = ("canonical_entities", "canonical_triples") if run.has("canonical_entities") and run.has("canonical_triples") else ("entities", "triples")
    return run.load(names[0]), run.load(names[1])


def export(run: Run) -> None:
    for df, name in zip(_fused(run), ("nodes", "relationships")):
        export_csv(df, f"{run.root}/export/{name}")


def matrix(run: Run) -> None:
    nodes, edges = _fused(run)
    nodes, edges = nodes.withColumn("case_id", nodes.source_cases[0]) if "case_id" not in nodes.columns else nodes, edges
    edges = edges.withColumn("case_id", edges.source_cases[0]) if "case_id" not in edges.columns else edges
    known = current_cases(run)
    features, outcome, names = run.save(causal.features_long(nodes, edges, known), "features"), run.save(causal.outcomes(nodes, edges, known), "outcomes"), run.save(causal.variables(nodes), "variables")
    columns = [r["column"] for r in names.where("not is_layer_variable").select("column").collect()]  # the header of the wide file
    export_csv(causal.export_matrix(known, outcome, features, columns), f"{run.root}/export/matrix")


def effects(run: Run) -> None:
    nodes, edges = _fused(run)
    nodes = nodes.withColumn("case_id", nodes.source_cases[0]) if "case_id" not in nodes.columns else nodes
    edges = edges.withColumn("case_id", edges.source_cases[0]) if "case_id" not in edges.columns else edges
    results = causal.analyse_batch(nodes, edges, current_cases(run), run.settings.causal)
    run.spark.createDataFrame([(json.dumps(r, ensure_ascii=False, default=str),) for r in results], "value string").write.mode("overwrite").text(f"{run.root}/effects")
    run.spark.createDataFrame([(causal.markdown_report(results, run.settings.causal),)], "value string").write.mode("overwrite").text(f"{run.root}/report")


STAGES: tuple[Stage, ...] = (("clean", clean), ("anonymize", anonymize), ("extract", extract), ("build", build), ("fuse", fuse), ("export", export), ("matrix", matrix), ("effects", effects))


def run_stages(run: Run, stages: Sequence[Stage] = STAGES) -> list[dict]:
    """Runs stages in order and stops at the first failure; says after each step where it is, and keeps a log of each step beside the progress file."""
    done: list[dict] = []

    def tell(status: str, current: str | None) -> None:
        if run.progress_path:
            spent = sum(d["seconds"] for d in done)
            average = spent / len(done) if done else 0.0
            left = average * (len(stages) - len(done))
            write_document(run.progress_path, {"status": status, "current": current, "completed": len(done), "total": len(stages), "percent": round(100 * len(done) / max(1, len(stages)), 2), "elapsed_hms": seconds_text(spent), "remaining_hms": seconds_text(left), "updated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "steps": done})

    def log(name: str, began: float, error: str | None) -> None:
        if run.progress_path:
            write_document(f"{run.progress_path}.logs/{len(done) + 1:02d}_{name}.json", {"step": name, "began_at": datetime.fromtimestamp(began, timezone.utc).isoformat(timespec="seconds"), "seconds": round(time.time() - began, 3), "status": "failed" if error else "completed", "error": error})

    for name, stage in stages:
        tell("running", name)
        began = time.time()
        try:
            stage(run)
        except Exception:
            log(name, began, traceback.format_exc())
            tell("failed", name)
            raise
        log(name, began, None)
        done.append({"name": name, "seconds": round(time.time() - began, 3)})
    tell("completed", None)
    return done
