"""The case-by-factor matrix in long form, and effects from it: contingency tables, adjusted linear effects, bootstrap and refuters.

The matrix stays long (case_id, column, value 1); it is pivoted for export alone. Designs are 0/1 columns, so the cells of all
treatments' designs come from one aggregation, and effects, intervals and refuters are computed from the cells: rows drawn
with replacement are a multinomial over them, permuted treatments a draw without replacement. No row is replicated.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import vocabulary as v
from faultline.functions.text import feature_column, is_severe, layer_column, or_empty
from faultline.functions.values import two_sided_p
from faultline.operators.graph import accident_cases, edge_cases, first_wins, memberships_of
from faultline.settings import Causal

OUTCOME = "severe_consequence"
#: So many factor entities at most are gathered and broadcast (some MB).
BROADCAST_FACTORS = 20_000
#: So many columns at most are held as bits of a bigint.
MASK_COLUMNS = 62


# --- the matrix ---


def _labelled(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("label").isin(*v.FEATURE_LABELS)).withColumn("column", feature_column(F.col("label"), F.col("name")))


def variables(nodes: DataFrame) -> DataFrame:
    """One row for each feature column (its first entity names it) and each layer: column, label, name, entity_id, role, is_layer_variable, seq."""
    role = F.when(F.col("label").isin(*v.CAUSAL_LABELS), "causal_factor").otherwise("control")
    features = first_wins(_labelled(nodes), ["column"], ["seq"]).select("column", "label", "name", F.col("id").alias("entity_id"), role.alias("role"), F.lit(False).alias("is_layer_variable"), "seq")
    layers = nodes.sparkSession.createDataFrame([(lb, v.LAYER_NAMES[lb], (1 << 60) + k) for k, lb in enumerate(v.FEATURE_LABELS)], "label string, name string, seq bigint")
    return features.unionByName(layers.select(layer_column(F.col("label")).alias("column"), "label", "name", F.lit("").alias("entity_id"), role.alias("role"), F.lit(True).alias("is_layer_variable"), "seq"))


def features_long(nodes: DataFrame, edges: DataFrame, cases: DataFrame) -> DataFrame:
    """Distinct (case_id, column, label): a factor present in a known case, by the entity's cases or those of its edges.

    Memberships are those of factors alone, cut down to known cases; rows come out dealt by case. Up to ``BROADCAST_FACTORS`` factors are broadcast,
    more meet by a shuffle; up to ``MASK_COLUMNS`` columns are bits of a number, so that rows of an accident node and of a case combine before their shuffles.
    """
    known = _labelled(nodes).select(F.col("id").alias("entity_id"), "column", "label").where("entity_id <> ''").distinct()
    few = known.limit(BROADCAST_FACTORS + 1).collect()
    columns = sorted({(r["column"], r.label) for r in few})
    if len(few) <= BROADCAST_FACTORS and len(columns) <= MASK_COLUMNS:
        return _features_by_mask(nodes, edges, cases, [(r.entity_id, 1 << columns.index((r["column"], r.label))) for r in few], columns)
    wanted = F.broadcast(known) if len(few) <= BROADCAST_FACTORS else known
    # An inner join: a semi join would be pushed below the union and meet the cases once in each branch.
    return memberships_of(nodes, edges, wanted).join(cases.select("case_id").distinct(), "case_id").select("case_id", "column", "label").distinct()


def _features_by_mask(nodes: DataFrame, edges: DataFrame, cases: DataFrame, bits: Sequence[tuple[str, int]], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """``features_long`` with a bit for each of ``columns`` (column, label); one bit more says that a case is known."""
    def united(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.bit_or("mask").alias("mask"))

    stands = F.lit(1 << MASK_COLUMNS).cast("bigint")
    wanted = F.broadcast(nodes.sparkSession.createDataFrame(list(bits), "entity_id string, mask bigint"))
    present = memberships_of(nodes, edges, wanted, lambda rows: united(rows, "source_id")).select("case_id", "mask")
    rows = united(present.unionByName(cases.select("case_id", stands.alias("mask"))), "case_id").where(F.col("case_id").isNotNull() & (F.col("mask").bitwiseAND(stands) != 0))
    each = [F.when(F.col("mask").bitwiseAND(F.lit(1 << k).cast("bigint")) != 0, F.struct(F.lit(c).alias("column"), F.lit(lb).alias("label"))) for k, (c, lb) in enumerate(columns)]
    none = F.array().cast("array<struct<column:string,label:string>>")
    return rows.select("case_id", F.explode(F.array_compact(F.array(*each)) if each else none).alias("x")).select("case_id", "x.column", "x.label")


def outcomes(nodes: DataFrame, edges: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, severe_consequence): by the case's own text, where a null reads None, or by a consequence edge."""
    def text(c: str) -> Column:
        return F.coalesce(c, F.lit("None"))

    own = cases.select("case_id", is_severe(F.concat(text("consequence_text"), text("economic_loss_text"), text("raw_text"))).alias("y"))
    names = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("_name"))
    said = edge_cases(edges.where("type = 'hasConsequence'"), accident_cases(nodes)).join(names, "target_id", "left")
    lists = F.array_join("evidence_texts", " ") if "evidence_texts" in edges.columns else F.lit(None).cast("string")
    evidence = F.coalesce(F.nullif(lists, F.lit("")), F.concat_ws(" ", or_empty(F.col("evidence_text")) if "evidence_text" in edges.columns else F.lit(""), or_empty(F.col("_name"))))
    through = said.select(F.col("of_case").alias("case_id"), is_severe(evidence).alias("y")).where("y = 1").join(cases.select("case_id"), "case_id", "left_semi")
    return own.unionByName(through).groupBy("case_id").agg(F.max("y").alias(OUTCOME))


def layers_long(features: DataFrame) -> DataFrame:
    """(case_id, label, n): distinct factors of a layer in a case; present where n > 0."""
    return features.groupBy("case_id", "label").agg(F.count_distinct("column").alias("n"))


def matrix_long(features: DataFrame) -> DataFrame:
    """Distinct (case_id, column) of features and layers."""
    return features.select("case_id", F.explode(F.array("column", layer_column(F.col("label")))).alias("column")).distinct()


def export_matrix(cases: DataFrame, outcome: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The wide matrix: fixed columns, layers, counts and the given feature columns, each in alphabetic order; absent is 0.

    Features (distinct) are read once: a row counts for its column and for its layer, and one pivot by case holds both.
    """
    labels = sorted(v.FEATURE_LABELS)
    held = features.where("column is not null").select("case_id", F.explode(F.array("column", F.concat(F.lit("n:"), "label"))).alias("key"))
    wide = held.groupBy("case_id").pivot("key", [*(f"n:{lb}" for lb in labels), *sorted(columns)]).agg(F.count(F.lit(1)))
    wide = wide.select("case_id", *(F.col(f"`n:{lb}`").alias(lb) for lb in labels), *(F.col(f"`{c}`") for c in sorted(columns)))
    joined = cases.select("case_id", "title", "source_file").join(outcome, "case_id", "left").join(wide, "case_id", "left")
    zero = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("int")
    return joined.select("case_id", "title", "source_file", zero(OUTCOME).alias(OUTCOME), *((zero(lb) > 0).cast("int").alias(f"layer_{lb}") for lb in labels), *(zero(lb).alias(f"count_{lb}") for lb in labels), *(zero(c).alias(c) for c in sorted(columns)))


def long_form(wide: DataFrame) -> DataFrame:
    """(case_id, column) of the ones in an exported matrix, feature and layer columns alone."""
    columns = [c for c in wide.columns if c.startswith(("x_", "layer_"))]
    return wide.select("case_id", F.explode(F.array_compact(F.array(*(F.when(F.col(f"`{c}`").cast("int") == 1, c) for c in columns)))).alias("column"))


# --- choice of treatments and common causes ---


def supports(matrix: DataFrame, n_cases: int) -> DataFrame:
    """(column, support, n): for all columns of distinct (case_id, column) in one aggregation, combined before its shuffle."""
    return matrix.groupBy("column").agg(F.count("case_id").alias("support")).withColumn("n", F.lit(n_cases).cast("bigint"))


def usable(min_support: int) -> Column:
    return (F.col("support") >= min_support) & (F.col("n") - F.col("support") >= min_support) & (F.col("support") > 0) & (F.col("support") < F.col("n"))


def treatments(variables: DataFrame, support: DataFrame, how: Causal = Causal(), labels: Sequence[str] = v.BATCH_LABELS) -> DataFrame:
    """The variables to analyse: of the given labels, with support enough; layers first, then by support, then in order."""
    known = variables.where(F.col("label").isin(*labels)).join(support, "column").where(F.col("support") >= how.min_support)
    return known.orderBy(F.desc("is_layer_variable"), F.desc("support"), "seq").limit(how.top_k)


def resolve_treatment(value: str, variables: DataFrame) -> dict:
    """The variable that a column, name or entity id names exactly, else the only one whose name contains it."""
    exact = variables.where((F.col("column") == value) | (F.col("name") == value) | (F.col("entity_id") == value)).orderBy("seq").limit(1).collect()
    if exact:
        return exact[0].asDict()
    near = variables.where(F.col("name").contains(value)).orderBy("seq").limit(11).collect()
    if len(near) == 1:
        return near[0].asDict()
    raise ValueError(f"{'ambiguous' if near else 'unknown'} treatment {value!r}: {[r['name'] for r in near[:10]]}")


def common_causes(treatment: DataFrame, variables: DataFrame, support: DataFrame, how: Causal = Causal()) -> DataFrame:
    """(treatment_column, column, support, rank): usable variables of strictly earlier layers or controls, other than the treatment's label and accident types."""
    order = F.create_map(*(F.lit(x) for kv in v.LAYER_ORDER.items() for x in kv))
    t = treatment.select(F.col("column").alias("treatment_column"), F.col("label").alias("t_label"), F.coalesce(order[F.col("label")], F.lit(99)).alias("t_order"))
    c = variables.join(support, "column").where(usable(how.min_support)).where("label <> 'AccidentType'").withColumn("c_order", order[F.col("label")])
    c = c.where(F.col("c_order").isNotNull() | F.col("label").isin(*v.CONTROL_LABELS))
    # Treatments are a few rows (at most top_k), so each meets all candidates.
    pairs = c.join(F.broadcast(t), (F.col("column") != F.col("treatment_column")) & (F.col("label") != F.col("t_label")) & (F.col("c_order").isNull() | (F.col("c_order") < F.col("t_order"))))
    rank = F.row_number().over(Window.partitionBy("treatment_column").orderBy(F.desc("is_layer_variable"), F.desc("support"), "seq"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= how.max_controls).select("treatment_column", "column", "support", "rank")


# --- tables and effects ---


#: Name, treatment and outcome of the cells of a 2 x 2 table.
TABLE_CELLS = (("treated_severe_n", 1, 1), ("treated_nonsevere_n", 1, 0), ("control_severe_n", 0, 1), ("control_nonsevere_n", 0, 0))


def contingency(t: Column, y: Column) -> list[Column]:
    """Aggregates of the 2 x 2 table."""
    return [F.count_if((t == a) & (y == b)).alias(n) for n, a, b in TABLE_CELLS]


def risk_summary(table: DataFrame) -> DataFrame:
    """Adds group sizes, rates and their difference; a rate is null without rows."""
    sized = table.withColumns({"treated_n": F.expr("treated_severe_n + treated_nonsevere_n"), "control_n": F.expr("control_severe_n + control_nonsevere_n")})
    rated = sized.withColumns({"treated_severe_rate": F.expr("try_divide(treated_severe_n, treated_n)"), "control_severe_rate": F.expr("try_divide(control_severe_n, control_n)")})
    return rated.withColumn("unadjusted_risk_difference", F.expr("treated_severe_rate - control_severe_rate"))


def skip_reason(min_support: int) -> Column:
    """Why a treatment is not analysed, the first rule that holds, over the cells of its table; '' if it is."""
    s, cells = "(treated_severe_n + treated_nonsevere_n)", "array(treated_severe_n, treated_nonsevere_n, control_severe_n, control_nonsevere_n)"
    c = "(control_severe_n + control_nonsevere_n)"
    return F.expr(
        f"""CASE WHEN {s} < {min_support} THEN format_string('low_support:%d<min_support:{min_support}', {s})
        WHEN {c} < {min_support} THEN format_string('low_control_support:%d<min_support:{min_support}', {c})
        WHEN {s} = 0 OR {c} = 0 THEN 'treatment_has_no_variation'
        WHEN treated_severe_n + control_severe_n = 0 OR treated_nonsevere_n + control_nonsevere_n = 0 THEN 'outcome_has_no_variation'
        WHEN array_min({cells}) = 0 THEN concat('separation_or_empty_cell:[', array_join(transform({cells}, x -> cast(x as string)), ', '), ']')
        ELSE '' END"""
    )


def moments(columns: Sequence[str], y: str) -> list[Column]:
    """Aggregates of X'X and X'y with an intercept: one pass, combined before any shuffle."""
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    out = [F.sum(x[i] * x[j]).alias(f"xx_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return out + [F.sum(x[i] * F.col(y).cast("double")).alias(f"xy_{i}") for i in range(len(x))]


def solve(row: dict, k: int) -> np.ndarray:
    """Least-squares coefficients of smallest norm from moments of k columns."""
    m = k + 1
    xx = np.array([[row[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)], float)
    return np.linalg.pinv(xx, rcond=1e-10, hermitian=True) @ np.array([row[f"xy_{i}"] for i in range(m)], float)


def linear_effect(wide: DataFrame, treatment: str, y: str, controls: Sequence[str] = ()) -> float:
    columns = [treatment, *controls]
    return float(solve(wide.agg(*moments(columns, y)).first().asDict(), len(columns))[1])


def design_cells(wide: DataFrame, designs: Mapping[str, Sequence[str]], y: str) -> DataFrame:
    """(design, mask, y, n): how many rows of a design have which of its 0/1 columns (bit k: the k-th) and which outcome.

    One aggregation for all designs, combined before its shuffle; a design has 2 ** (columns + 1) rows at most.
    """
    def mask(columns: Sequence[str]) -> Column:
        return functools.reduce(lambda m, kc: m.bitwiseOR(F.shiftleft(F.col(f"`{kc[1]}`").cast("bigint"), kc[0])), enumerate(columns), F.lit(0).cast("bigint"))

    each = F.array(*(F.struct(F.lit(name).alias("design"), mask(columns).alias("mask")) for name, columns in designs.items()))
    return wide.select(F.col(y).cast("int").alias("y"), F.explode(each).alias("d")).groupBy("d.design", "d.mask", "y").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Cells:
    """The cells of one design: its columns (the treatment first), outcome and number of rows of each. All that follows is computed from them."""

    x: np.ndarray
    y: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(rows: Sequence[tuple[int, int, int]], columns: int) -> Cells:
        """From (mask, y, n), in any order."""
        mask, y, n = (np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 3
        return Cells((mask[:, None] >> np.arange(columns) & 1).astype(float), y.astype(float), n)

    def table(self) -> dict[str, int]:
        t = self.x[:, 0]
        return {name: int(self.n[(t == a) & (self.y == b)].sum()) for name, a, b in TABLE_CELLS}

    def effect(self, n: np.ndarray | None = None, x: np.ndarray | None = None) -> float:
        """The treatment's least-squares coefficient (of smallest norm), with other numbers of rows or columns if given."""
        n, x = self.n if n is None else n, self.x if x is None else x
        full = np.column_stack([np.ones(len(x)), x])
        return float((np.linalg.pinv(full.T @ (full * n[:, None]), rcond=1e-10, hermitian=True) @ (full.T @ (n * self.y)))[1])

    def bootstrap(self, times: int, seed: int) -> dict:
        """Percentile interval, standard error and normal p value; rows drawn with replacement fall into cells as a multinomial. Draws without variation are skipped."""
        rng, found = np.random.default_rng(seed), []
        for n in rng.multinomial(self.n.sum(), self.n / self.n.sum(), times):
            held = n > 0
            if len(set(self.x[held, 0])) == 2 == len(set(self.y[held])):
                found.append(self.effect(n))
        if not found:
            return {"bootstrap_n": 0, "ci95_low": None, "ci95_high": None, "bootstrap_se": None, "p_value_normal_approx": None}
        se = float(np.std(found, ddof=1)) if len(found) > 1 else 0.0
        return {"bootstrap_n": len(found), "ci95_low": float(np.quantile(found, 0.025)), "ci95_high": float(np.quantile(found, 0.975)), "bootstrap_se": se, "p_value_normal_approx": two_sided_p(self.effect(), se)}

    def random_cause(self, times: int, seed: int) -> list[float]:
        """Effects with a normal covariate of no meaning: a cell of n rows needs its sum and its sum of squares alone."""
        rng, k, out = np.random.default_rng(seed), self.x.shape[1] + 1, []
        full = np.column_stack([np.ones(len(self.x)), self.x])
        for _ in range(times):
            total = rng.normal(0, np.sqrt(self.n))
            squares = total**2 / self.n + rng.chisquare(np.maximum(self.n - 1, 1)) * (self.n > 1)
            xx = np.zeros((k + 1, k + 1))
            xx[:k, :k] = full.T @ (full * self.n[:, None])
            xx[k, :k] = xx[:k, k] = full.T @ total
            xx[k, k] = squares.sum()
            xy = np.append(full.T @ (self.n * self.y), total @ self.y)
            out.append(float((np.linalg.pinv(xx, rcond=1e-10, hermitian=True) @ xy)[1]))
        return out

    def placebo(self, times: int, seed: int) -> list[float]:
        """Effects of permuted treatments: as many treated rows as before, dealt to the cells of controls and outcome without replacement."""
        rng = np.random.default_rng(seed)
        others, where = np.unique(np.column_stack([self.x[:, 1:], self.y]), axis=0, return_inverse=True)
        rows = np.bincount(where.ravel(), self.n, len(others)).astype(np.int64)
        treated = int(self.n[self.x[:, 0] == 1].sum())
        dealt = Cells(np.column_stack([np.repeat([1.0, 0.0], len(others)), np.tile(others[:, :-1], (2, 1))]), np.tile(others[:, -1], 2), np.tile(rows, 2))
        return [dealt.effect(np.concatenate([m, rows - m])) for m in (deal(rng, rows, treated) for _ in range(times))]


def deal(rng: np.random.Generator, rows: np.ndarray, treated: int) -> np.ndarray:
    """How many of ``treated`` rows each cell gets, drawn one cell after the other without replacement; beyond what the generator's hypergeometric takes, by the binomial that it then equals to a millionth."""
    out, left, rest = np.zeros(len(rows), np.int64), int(rows.sum()), treated
    for k, n in enumerate(rows.tolist()):
        if left < 10**9:
            out[k] = rng.hypergeometric(n, left - n, rest) if rest and n else 0
        else:
            out[k] = min(n, rest, max(rest - (left - n), rng.binomial(n, rest / left)))
        left, rest = left - n, rest - int(out[k])
    return out


def refutation(refuter: str, estimate: float, found: Sequence[float], expected: float) -> dict:
    """The mean of repeated effects, and the two-sided share of them beyond what is expected, ties by half."""
    x = np.array(found)
    above = float(np.mean((x > expected) + 0.5 * (x == expected)))
    return {"refuter": refuter, "estimated_effect": estimate, "new_effect": float(x.mean()), "p_value": 2 * min(above, 1 - above)}


def widen(cases: DataFrame, outcome: DataFrame, matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """case_id, the outcome and the given columns as 0 or 1: the few columns that one design needs."""
    picked = matrix.where(F.col("column").isin(*columns)).groupBy("case_id").agg(*(F.max((F.col("column") == c).cast("int")).alias(c) for c in columns))
    joined = cases.select("case_id").join(outcome, "case_id", "left").join(picked, "case_id", "left")
    return joined.select("case_id", *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in (OUTCOME, *columns)))


def analyse(treatment: dict, cells: Cells, controls: Sequence[str], how: Causal = Causal()) -> dict:
    """Table, adjusted effect, interval and refuters of one treatment; with a reason instead where it is skipped."""
    row = cells.table()
    s, c = row["treated_severe_n"] + row["treated_nonsevere_n"], row["control_severe_n"] + row["control_nonsevere_n"]
    rates = [row[f"{k}_severe_n"] / n if n else None for k, n in (("treated", s), ("control", c))]
    row |= {"treated_n": s, "control_n": c, "treated_severe_rate": rates[0], "control_severe_rate": rates[1], "unadjusted_risk_difference": None if None in rates else rates[0] - rates[1], "skip_reason": why_skipped(row, how.min_support)}
    out = {"treatment": treatment["name"], "treatment_column": treatment["column"], "treatment_label": treatment["label"], "is_layer_variable": treatment["is_layer_variable"], "outcome": OUTCOME, "common_causes": list(controls), "common_cause_count": len(controls), "support": s, "n": s + c, **row}
    if row["skip_reason"]:
        return out | {"run_success": False, "needs_review": True}
    effect = cells.effect()
    refuted = [refutation("random_common_cause", effect, cells.random_cause(how.refuter_n, how.seed), effect), refutation("placebo_treatment_refuter", effect, cells.placebo(how.refuter_n, how.seed), 0.0)]
    return out | {"effect_estimate": effect, "bootstrap": cells.bootstrap(how.bootstrap_n, how.seed), "refutations": refuted, "run_success": True, "causal_quality_pass": bool(controls), "needs_review": not controls}


def why_skipped(table: Mapping[str, int], min_support: int) -> str:
    """``skip_reason`` of one table."""
    cells = [table[name] for name, _, _ in TABLE_CELLS]
    treated, control, severe = sum(cells[:2]), sum(cells[2:]), cells[0] + cells[2]
    rules = (
        (treated < min_support, f"low_support:{treated}<min_support:{min_support}"),
        (control < min_support, f"low_control_support:{control}<min_support:{min_support}"),
        (not treated or not control, "treatment_has_no_variation"),
        (severe in (0, treated + control), "outcome_has_no_variation"),
        (0 in cells, f"separation_or_empty_cell:{cells}"),
    )
    return next((why for holds, why in rules if holds), "")


def analyse_batch(nodes: DataFrame, edges: DataFrame, cases: DataFrame, how: Causal = Causal()) -> list[dict]:
    """All treatments: their columns in one wide table of some dozens, their cells in one aggregation, the rest from the cells."""
    features = features_long(nodes, edges, cases)
    # Supports and variables are a row a column, and are read several times.
    matrix, outcome, known = matrix_long(features).cache(), outcomes(nodes, edges, cases), variables(nodes).cache()
    support = supports(matrix, cases.select("case_id").distinct().count()).cache()
    try:
        chosen = [t.asDict() for t in treatments(known, support, how).collect()]
        causes: dict[str, list[str]] = {}
        for r in common_causes(treatments(known, support, how), known, support, how).orderBy("treatment_column", "rank").collect():
            causes.setdefault(r.treatment_column, []).append(r["column"])
        if not chosen:
            return []
        designs = {t["column"]: [t["column"], *causes.get(t["column"], [])] for t in chosen}
        wide = widen(cases, outcome, matrix, sorted({c for d in designs.values() for c in d}))
        rows: dict[str, list[tuple[int, int, int]]] = {}
        for r in design_cells(wide, designs, OUTCOME).collect():
            rows.setdefault(r.design, []).append((r["mask"], r.y, r.n))
        return [analyse(t, Cells.of(rows.get(t["column"], []), len(designs[t["column"]])), causes.get(t["column"], []), how) for t in chosen]
    finally:
        for held in (support, known, matrix):
            held.unpersist()


# --- graphs and the report ---


def dot_edges(edges: Sequence[tuple[str, str]] = v.CAUSAL_EDGES) -> str:
    return "".join(["digraph G {\n", *(f'  "{a}" -> "{b}";\n' for a, b in edges), "}\n"])


def treatment_edges(treatment: str, outcome: str, causes: Sequence[str]) -> list[tuple[str, str]]:
    """The star of one analysis: treatment to outcome, each cause to both."""
    return [(treatment, outcome), *((c, to) for c in causes for to in (treatment, outcome))]


def treatment_dot(treatment: str, outcome: str, causes: Sequence[str]) -> str:
    return dot_edges(treatment_edges(treatment, outcome, causes))


def markdown_report(results: Sequence[dict], how: Causal = Causal()) -> str:
    def cell(x) -> str:
        return "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)

    done = [r for r in results if r.get("run_success")]
    head = ["# Causal effects", "", f"- outcome: {how.outcome}", f"- minimum support: {how.min_support}", f"- analysed: {len(done)}", f"- skipped: {len(results) - len(done)}", ""]
    columns = ["treatment", "treatment_label", "support", "treated_severe_rate", "control_severe_rate", "unadjusted_risk_difference", "effect_estimate", "ci95_low", "ci95_high", "p_value_normal_approx", "common_cause_count", "skip_reason"]
    rows = ["| " + " | ".join(cell((r | (r.get("bootstrap") or {})).get(c)) for c in columns) + " |" for r in results]
    return "\n".join([*head, "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *rows, ""])
