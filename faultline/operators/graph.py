"""The entity-relation graph: building it from cases and extraction results, checking it, merging its edges and spreading case membership."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import vocabulary as v
from faultline.functions.text import first_filled, node_id, or_empty, stable_id, strip
from faultline.functions.values import case_ids, ordered_list, safe_double, unique_in_order, unique_numbers, vote_ratio

STRINGS = "array<string>"


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; the rank is limited before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_first", rank).where("_first = 1").drop("_first")


def relation_table(spark, relations: Mapping[str, tuple[Sequence[str], Sequence[str]]] = v.RELATIONS) -> DataFrame:
    """The ontology's relations as a dimension of a few rows."""
    return spark.createDataFrame([(k, list(s), list(o)) for k, (s, o) in relations.items()], "type string, subjects array<string>, objects array<string>")


def with_ends(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select(F.col("id").alias("_id"))
    return df.join(ids, F.col("source_id") == F.col("_id"), "left_semi").join(ids, F.col("target_id") == F.col("_id"), "left_semi")


def context_edges(nodes: DataFrame, stated: DataFrame, relations: Mapping[str, str] = v.CONTEXT_RELATIONS) -> DataFrame:
    """Edges from a case to its context entities, by label, that are not stated already."""
    kind = F.create_map(*(F.lit(x) for kv in relations.items() for x in kv))[F.col("label")]
    made = nodes.withColumn("type", kind).where("type is not null").select(F.concat(F.lit("AccidentCase:"), "case_id").alias("source_id"), "type", F.col("id").alias("target_id"), "evidence_text", "case_id", "source_file", "seq")
    return made.join(stated.select("case_id", "source_id", "type", "target_id").distinct(), ["case_id", "source_id", "type", "target_id"], "left_anti")


def build_from_extraction(results: DataFrame, entities: DataFrame, triples: DataFrame, classes: Sequence[str] = v.ENTITY_CLASSES) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extraction results.

    results: case_id, source_file, title, seq. entities: case_id, source_file, id, label, name, evidence_text, needs_review, seq.
    triples: case_id, source_file, source_id, type, target_id, evidence_text, ..., seq. The first mention of an id stands, with its own case alone.
    """
    anchor = F.concat(F.lit("AccidentCase:"), F.col("case_id"))
    known = entities.where(F.col("id").isNotNull() & strip(F.col("label")).isin(*classes)).where((F.col("label") != "AccidentCase") | (F.col("id") == anchor))
    known = known.withColumns({"source_cases": F.array("case_id"), "_made": F.lit(0)})
    cases = results.where(or_empty(F.col("case_id")) != "").select("case_id", "source_file", anchor.alias("id"), F.lit("AccidentCase").alias("label"), first_filled(F.col("title"), F.col("case_id")).alias("name"), F.array("case_id").alias("source_cases"), "seq", F.lit(1).alias("_made"))
    nodes = first_wins(known.unionByName(cases, allowMissingColumns=True), ["id"], ["_made", "seq"]).drop("_made")
    stated = triples.where("coalesce(source_id, '') <> '' and coalesce(type, '') <> '' and coalesce(target_id, '') <> ''")
    # A mention's label and evidence are those of the node that stands for its id.
    mentions = known.select("case_id", "source_file", "id", "seq").join(nodes.select("id", "label", "evidence_text"), "id")
    edges = stated.unionByName(context_edges(mentions, stated), allowMissingColumns=True).withColumn("source_cases", F.array("case_id"))
    return nodes, with_ends(edges, nodes)


def build_from_cases(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of cleaned cases without extraction: the case, its type, consequence, direct cause and measures."""
    anchor = F.concat(F.lit("AccidentCase:"), F.col("case_id"))
    shapes = [("accident_type", "AccidentType", "hasAccidentType", False), ("consequence_text", "Consequence", "hasConsequence", False), ("direct_cause_text", "UnsafeObjectState", "hasDirectCause", True), ("measures_text", "PreventiveMeasure", None, False)]
    said = F.array(*(F.struct(F.lit(k).alias("rank"), strip(F.col(f)).alias("name"), F.lit(label).alias("label"), F.lit(rel).cast("string").alias("type"), F.lit(review).alias("needs_review"), F.col(f).alias("evidence_text")) for k, (f, label, rel, review) in enumerate(shapes, 1)))
    rows = cases.select("case_id", "source_file", "seq", F.explode(said).alias("x")).select("case_id", "source_file", "seq", "x.*").where("name <> ''").withColumn("id", node_id(F.col("label"), F.col("name")))
    anchors = cases.select(anchor.alias("id"), F.lit("AccidentCase").alias("label"), "title", "case_id", "source_file", "seq").withColumnRenamed("title", "name").withColumns({"rank": F.lit(0), "needs_review": F.lit(False)})
    nodes = first_wins(rows.select("id", "label", "name", F.lit(None).cast("string").alias("case_id"), "source_file", "seq", "rank", "needs_review").unionByName(anchors), ["id"], ["seq", "rank"]).drop("rank")
    direct = rows.where("type is not null").select(anchor.alias("source_id"), "type", F.col("id").alias("target_id"), "evidence_text", "case_id", "seq", "rank")
    cause = rows.where("label = 'UnsafeObjectState'").select("case_id", F.col("id").alias("source_id"))
    measures = rows.where("label = 'PreventiveMeasure'").join(cause, "case_id").select("source_id", F.lit("controlledBy").alias("type"), F.col("id").alias("target_id"), "evidence_text", "case_id", "seq", "rank")
    return nodes, direct.unionByName(measures).drop("rank")


def check_relations(edges: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges with the types of their ends, errors, valid and validation_status. ``relations`` is a dimension of the ontology's size."""
    kinds = nodes.select("id", "label")
    typed = edges.join(kinds.select(F.col("id").alias("source_id"), F.col("label").alias("source_type")), "source_id", "left").join(kinds.select(F.col("id").alias("target_id"), F.col("label").alias("target_type")), "target_id", "left")
    typed = typed.join(F.broadcast(relations), "type", "left")
    def unfit(kind: str, allowed: str) -> Column:
        return F.col("subjects").isNotNull() & ~F.array_contains(allowed, F.coalesce(kind, F.lit("")))

    errors = F.array_compact(
        F.array(
            F.when(F.col("subjects").isNull(), "relation_illegal"),
            F.when(unfit("source_type", "subjects"), "subject_type_illegal"),
            F.when(unfit("target_type", "objects"), "object_type_illegal"),
            F.when(strip(or_empty(F.col("evidence_text"))) == "", "evidence_missing"),
        )
    )
    return typed.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0).withColumn("validation_status", F.expr("if(valid, 'valid', 'invalid')")).drop("subjects", "objects")


def graph_validity(checked: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Whether all edges of a scope are valid, and the number of those that are not."""
    return checked.groupBy(*scope).agg(F.coalesce(F.bool_and("valid"), F.lit(True)).alias("valid"), F.count_if(~F.col("valid")).alias("invalid_edges"))


def remap(edges: DataFrame, id_map: DataFrame) -> DataFrame:
    """Ends replaced through (source_entity_id, canonical_id); others stay."""
    for end in ("source_id", "target_id"):
        to = id_map.select(F.col("source_entity_id").alias(end), F.col("canonical_id").alias("_to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges


def merge_relationships(edges: DataFrame, *, lists: bool = True) -> DataFrame:
    """One row for each (source, type, target): weight, distinct cases and evidence, mean confidence, share of yes votes, validity.

    With ``lists`` also the ordered distinct lists. Columns that are missing count as null.
    """
    wanted = {"id": "string", "question_id": "string", "case_id": "string", "source_cases": STRINGS, "evidence_text": "string", "evidence_texts": STRINGS, "confidence": "double", "vote_yes_count": "bigint", "vote_no_count": "bigint", "needs_review": "boolean", "validation_status": "string", "seq": "bigint"}
    rows = edges.withColumns({c: F.lit(None).cast(k) for c, k in wanted.items() if c not in edges.columns})
    rows = rows.where("coalesce(source_id, '') <> '' and coalesce(type, '') <> '' and coalesce(target_id, '') <> ''")
    rows = rows.withColumns({"_cases": unique_in_order(F.array(F.col("case_id")), F.col("source_cases")), "_evidence": unique_in_order(F.array("evidence_text"), F.col("evidence_texts"))})

    def gathered(c: str) -> Column:
        return F.array_distinct(F.flatten(ordered_list(F.col("seq"), F.col(c))))

    def singles(c: str) -> Column:
        return unique_in_order(ordered_list(F.col("seq"), F.col(c)))

    out = rows.groupBy("source_id", "type", "target_id").agg(
        F.count(F.lit(1)).alias("weight"),
        gathered("_cases").alias("source_cases"),
        gathered("_evidence").alias("evidence_texts"),
        F.coalesce(F.avg(safe_double(F.col("confidence"), None)), F.lit(0.0)).alias("avg_confidence"),
        vote_ratio(F.col("vote_yes_count"), F.col("vote_no_count")).alias("vote_yes_ratio"),
        singles("id").alias("source_triple_ids"),
        singles("question_id").alias("question_ids"),
        F.when(F.bool_and(F.coalesce("validation_status", F.lit("valid")) == "valid"), "valid").otherwise("needs_review").alias("validation_status"),
        F.bool_or(F.coalesce("needs_review", F.lit(False))).alias("needs_review"),
    )
    out = out.withColumns({"id": F.concat(F.lit("REL:canonical:"), stable_id(F.col("source_id"), F.col("type"), F.col("target_id"))), "case_count": F.size("source_cases").cast("bigint"), "evidence_count": F.size("evidence_texts").cast("bigint")})
    return out if lists else out.drop("source_cases", "evidence_texts", "source_triple_ids", "question_ids")


def accident_cases(nodes: DataFrame) -> DataFrame:
    """(id, case_id) of accident nodes; one without cases has the last part of its id."""
    own = case_ids(F.col("source_cases"), F.col("case_id"))
    rows = nodes.where("label = 'AccidentCase'").select("id", own.alias("own"))
    return rows.select("id", F.explode(F.when(F.size("own") > 0, F.col("own")).otherwise(F.array(F.substring_index("id", ":", -1)))).alias("case_id"))


def edge_cases(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(edge columns, of_case): an edge's own cases and those of an accident node at its source."""
    own = edges.withColumn("_own", case_ids(F.col("source_cases"), F.col("case_id")))
    at_source = own.join(anchors.select(F.col("id").alias("source_id"), F.col("case_id").alias("of_case")), "source_id", "inner")
    return own.withColumn("of_case", F.explode("_own")).unionByName(at_source).drop("_own")


def _plain_cases(df: DataFrame, *kept: str) -> DataFrame:
    """(kept columns, case_id): the rows' own cases. Only lists that hold something are exploded."""
    one = df.where("coalesce(case_id, '') <> ''").select(*kept, F.col("case_id").cast("string").alias("case_id"))
    many = df.where("size(source_cases) > 0").select(*kept, F.explode("source_cases").alias("case_id")).where("coalesce(case_id, '') <> ''")
    return one.unionByName(many)


def memberships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, case_id), not made distinct: an entity's own cases and those of its edges, one hop far."""
    anchors = accident_cases(nodes)
    known = _plain_cases(edges, "source_id", "target_id").unionByName(edges.select("source_id", "target_id").join(anchors.withColumnRenamed("id", "source_id"), "source_id"))
    through = known.select(F.col("source_id").alias("entity_id"), "case_id").unionByName(known.select(F.col("target_id").alias("entity_id"), "case_id"))
    own = _plain_cases(nodes.withColumnRenamed("id", "entity_id"), "entity_id")
    return own.unionByName(anchors.withColumnRenamed("id", "entity_id")).unionByName(through).where("coalesce(entity_id, '') <> ''")


def memberships_of(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, merge: Callable[[DataFrame], DataFrame] = DataFrame.distinct) -> DataFrame:
    """``memberships`` of the wanted entities (entity_id, ...) alone, with the other columns of ``wanted`` in place of the id.

    Rows meet the wanted entities before anything else, and what goes to the accident nodes is merged: a source of many edges
    that is no accident node stays a row or two in each task. ``merge`` makes rows (source_id, ...) distinct or fewer.
    """
    kept, wanted, anchors = [c for c in wanted.columns if c != "entity_id"], wanted.where("entity_id <> ''"), accident_cases(nodes)
    met = edges.select("source_id", "case_id", "source_cases", F.explode(F.array("source_id", "target_id")).alias("entity_id")).join(wanted, "entity_id")
    through = merge(met.select("source_id", *kept)).join(anchors.withColumnRenamed("id", "source_id"), "source_id").select(*kept, "case_id")
    own = _plain_cases(nodes.select(F.col("id").alias("entity_id"), "case_id", "source_cases").join(wanted, "entity_id"), *kept)
    themselves = anchors.withColumnRenamed("id", "entity_id").join(wanted, "entity_id").select(*kept, "case_id")
    return own.unionByName(themselves).unionByName(_plain_cases(met, *kept)).unionByName(through)


def entity_cases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return memberships(nodes, edges).distinct()


def merge_entities(members: DataFrame) -> DataFrame:
    """Canonical rows of mentions with a ``canonical_id``: ordered distinct lists, any review, mean of distinct confidences; mean and count only where two mentions or more met."""
    def gathered(*cs: str) -> Column:
        each = unique_in_order(*(F.col(c) if dict(members.dtypes).get(c) == STRINGS else F.array(F.col(c).cast("string")) for c in cs if c in members.columns), F.array().cast(STRINGS))
        return F.array_distinct(F.flatten(ordered_list(F.col("seq"), each)))

    confidences = unique_numbers(ordered_list(F.col("seq"), F.col("confidence").cast("double") if "confidence" in members.columns else F.lit(None).cast("double")))
    out = members.groupBy("canonical_id", "label").agg(
        F.min_by("normalized_name", "seq").alias("normalized_name"),
        gathered("name", "normalized_name").alias("aliases"),
        gathered("id").alias("source_entity_ids"),
        gathered("case_id", "source_cases").alias("source_cases"),
        gathered("evidence_text", "evidence_texts").alias("evidence_texts"),
        gathered("source_span_id", "source_span_ids").alias("source_span_ids"),
        gathered("rationale", "rationales").alias("rationales"),
        gathered("vote_summary", "vote_summaries").alias("vote_summaries"),
        confidences.alias("confidence_values"),
        F.bool_or(F.coalesce("needs_review", F.lit(False)) if "needs_review" in members.columns else F.lit(False)).alias("needs_review"),
        F.count(F.lit(1)).alias("_n"),
        F.min("seq").alias("seq"),
    )
    merged = F.col("_n") > 1
    mean = F.when(F.size("confidence_values") > 0, F.aggregate("confidence_values", F.lit(0.0), lambda s, x: s + x) / F.size("confidence_values")).otherwise(0.0)
    return out.withColumns({"avg_confidence": F.when(merged, mean), "mention_count": F.when(merged, F.size("source_entity_ids").cast("bigint")), "name": F.col("normalized_name"), "fusion_status": F.lit("canonical")}).withColumnRenamed("canonical_id", "id").drop("_n")


def summarize_relationships(edges: DataFrame) -> DataFrame:
    """``merge_relationships`` without lists: counts are combined before the shuffle and distinct cases never gather in one row."""
    out = edges.where("source_id is not null and type is not null and target_id is not null").groupBy("source_id", "type", "target_id").agg(
        F.count(F.lit(1)).alias("weight"), F.count_distinct("case_id").alias("case_count"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), vote_ratio(F.col("vote_yes_count"), F.col("vote_no_count")).alias("vote_yes_ratio")
    )
    return out.withColumn("id", F.concat(F.lit("REL:canonical:"), stable_id(F.col("source_id"), F.col("type"), F.col("target_id"))))
