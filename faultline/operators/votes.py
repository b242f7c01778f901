"""Majority votes, their validation against the ontology, and the choice among decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import vocabulary as v
from faultline.functions.text import contains_any, culture_label, normalize_answer, or_empty, strip


def tally(votes: DataFrame, keys: Sequence[str], *, answer: str = "answer", confidence: str = "confidence", order: str = "vote_idx", min_margin: int = 1) -> DataFrame:
    """One decision for each group: counts, majority (a tie is no), margin, accepted, needs_review, and the columns of the
    most confident vote of the majority (the first on a tie; of any vote if none is of the majority)."""
    votes = votes.withColumn(answer, normalize_answer(F.col(answer)))
    group = Window.partitionBy(*keys)
    yes = F.sum(F.when(F.col(answer) == "yes", 1).otherwise(0)).over(group).cast("int")
    counted = votes.withColumns({"yes": yes, "vote_count": F.count(F.lit(1)).over(group).cast("int")}).withColumns({"no": F.expr("vote_count - yes"), "majority": F.expr("if(yes > vote_count - yes, 'yes', 'no')"), "margin": F.expr("abs(2 * yes - vote_count)")})
    of_majority = (F.col(answer) == F.col("majority")).cast("int")
    best = F.row_number().over(group.orderBy(of_majority.desc(), F.coalesce(F.col(confidence).cast("double"), F.lit(0.0)).desc(), F.col(order)))
    return (
        counted.withColumn("_best", best)
        .where("_best = 1")
        .withColumns({answer: F.col("majority"), "accepted": F.expr(f"majority = 'yes' and margin >= {min_margin}"), "needs_review": F.expr(f"margin < {min_margin}"), "min_vote_margin": F.lit(min_margin)})
        .drop("_best", "majority")
    )


def tally_counts(votes: DataFrame, keys: Sequence[str], *, answer: str = "answer", min_margin: int = 1) -> DataFrame:
    """The counts of ``tally`` alone, by one aggregation that is combined before its shuffle."""
    yes = F.count_if(normalize_answer(F.col(answer)) == "yes")
    out = votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("vote_count"), yes.alias("yes"))
    return out.withColumns({"no": F.expr("vote_count - yes"), "margin": F.expr("abs(2 * yes - vote_count)"), "answer": F.expr("if(2 * yes > vote_count, 'yes', 'no')")}).withColumn("accepted", F.expr(f"2 * yes > vote_count and margin >= {min_margin}"))


def culture_errors(evidence: Column, rationale: Column, label: Column) -> Column:
    """The error that the evidence of a cultural defect raises, or null."""
    evidence, rest = or_empty(evidence), F.concat_ws(" ", or_empty(rationale), or_empty(label))
    marked = contains_any(evidence, v.CULTURE_MARKERS)
    anywhere = contains_any(F.concat_ws(" ", evidence, rest), v.CULTURE_MARKERS)
    return F.when(~anywhere, "culture_marker_missing").when(contains_any(evidence, v.MANAGEMENT_MARKERS) & ~marked, "management_evidence_only")


def validate_decisions(decisions: DataFrame, classes: Sequence[str] = v.ENTITY_CLASSES) -> DataFrame:
    """Adds errors (array), valid and validation_status; only a yes has to satisfy the ontology."""
    def blank(name: str) -> Column:
        return strip(or_empty(F.col(name))) == ""

    found = F.array_compact(
        F.array(
            F.when(~or_empty(F.col("entity_type")).isin(*classes), "entity_type_illegal"),
            F.when(blank("label"), "label_missing"),
            F.when(blank("evidence_text"), "evidence_missing"),
            F.when(F.col("entity_type") == "SafetyCultureDefect", culture_errors(F.col("evidence_text"), F.col("rationale"), F.col("label"))),
        )
    )
    errors = F.when(F.col("answer") == "yes", found).otherwise(F.array().cast("array<string>"))
    return decisions.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0).withColumn("validation_status", F.expr("if(valid, 'valid', 'invalid')"))


def decision_score(yes: Column, confidence: Column) -> Column:
    return F.coalesce(yes.cast("double"), F.lit(0.0)) + F.coalesce(confidence.cast("double"), F.lit(0.0))


def dedupe_decisions(decisions: DataFrame, scope: Sequence[str], *, order: str = "seq") -> DataFrame:
    """Of accepted rows of one question, type, relation and standard label the best-scored, the first on a tie, at the place of the first of them; rows not accepted come before all of them. Adds ``pos``, the new order."""
    label = F.when(F.col("accepted"), culture_label(F.col("entity_type"), F.col("label"))).otherwise(F.col("label"))
    key = Window.partitionBy(*scope, "accepted", *(f"_{c}" for c in ("q", "t", "r", "l")))
    marked = decisions.withColumn("accepted", F.coalesce("accepted", F.lit(False))).withColumn("label", label)
    marked = marked.withColumns({"_q": or_empty(F.col("question_id")), "_t": or_empty(F.col("entity_type")), "_r": or_empty(F.col("relation_type")), "_l": or_empty(F.col("label"))})
    best = F.row_number().over(key.orderBy(decision_score(F.col("yes"), F.col("confidence")).desc(), F.col(order)))
    kept = marked.withColumns({"_best": best, "_at": F.min(order).over(key)}).where("not accepted or _best = 1")
    place = F.row_number().over(Window.partitionBy(*scope).orderBy("accepted", F.when(F.col("accepted"), F.col("_at")).otherwise(F.col(order))))
    return kept.withColumn("pos", place).drop("_q", "_t", "_r", "_l", "_best", "_at")


def snapshot() -> Column:
    """The eight fields of a decision that its repair history keeps."""
    return F.struct("question_id", "answer", "label", "entity_type", "relation_type", "evidence_text", "confidence", "needs_review")
