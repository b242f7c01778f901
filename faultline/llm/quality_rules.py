r"""Operator 6, quality rules: decision lists learned by sequential covering, applied as ordered Spark conditions.

Statistics of each whole text are built-in functions of its word array, so no row leaves its task and nothing is
shuffled. ``learn`` takes a bounded number of labelled rows' statistics (``sample_rows``: those with the least hash of
their id), grows a conjunction of thresholds by information gain on two thirds of them, prunes it on the other third,
removes what it covers and goes on until a rule is no longer precise there. ``condition`` gives the ordered CASE.

Words are ``[^\x20\x09-\x0D]+``. A null or empty text has no words and fails the base rules. Null labels teach
nothing, nor do null ids; several labels of one id count as their least and several rows of an id teach as one, that with the least
statistics; without labels, or with one kind only, there are no rules and the base rules decide alone. Rows are
judged by themselves: ties, repeated rows, equal and null ids get equal verdicts for equal texts. Empty tables give no rows;
further columns of ``documents`` pass through ``keep`` untouched. A text's word array and windows bound a task's memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import salted, table


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it by name in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _places(found: str) -> str:
    """SQL: the words in windows of three that begin at the sorted places ``found``."""
    return f"aggregate(transform({found}, (x, k) -> least(3L, coalesce(get(p, k + 1) - x, 3L))), 0L, (a, x) -> a + x)"


def _window(place: str) -> str:
    return f"slice(w, cast({place} as int) + 1, 3)"


#: Words in 3-word windows found twice or more: windows become hashes that carry their place in the low bits, equal
#: ones stand together after one primitive sort, and the places found are counted with their overlaps. Neighbours of
#: equal hashes are compared word by word; where two differ, the text's windows are sorted and compared as words instead.
_REPEATED = let(
    "shiftleft(1L, length(bin(size(w)))) - 1L",
    "low",
    let(
        "sort_array(transform(sequence(0, size(w) - 3), i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & ~low) | cast(i as bigint)))",
        "s",
        let(
            "filter(s, (x, k) -> (x & ~low) = (get(s, k - 1) & ~low) or (x & ~low) = (get(s, k + 1) & ~low))",
            "h",
            f"""if(exists(transform(h, (x, k) -> (x & ~low) = (get(h, k + 1) & ~low) and {_window("x & low")} <> {_window("get(h, k + 1) & low")}), x -> x),
                {let("sort_array(transform(sequence(0, size(w) - 3), i -> struct(slice(w, i + 1, 3) as v, cast(i as bigint) as i)))", "t",
                    let("sort_array(transform(filter(t, (x, k) -> x.v <=> get(t, k - 1).v or x.v <=> get(t, k + 1).v), x -> x.i))", "p", _places("p")))},
                {let("sort_array(transform(h, x -> x & low))", "p", _places("p"))})""",
        ),
    ),
)

_STATISTICS = let(
    r"array_remove(split(t, '\\s+'), '')",
    "w",
    let(
        r"regexp_replace(t, '[^#*$%&|<>!.\\p{Lu}]+', '')",
        "marks",
        let(
            r"filter(split(t, '\n'), x -> x rlike '\\S')",
            "lines",
            f"""named_struct(
                'n_words', cast(size(w) as bigint),
                'word_chars', cast(length(concat_ws('', w)) as bigint),
                'n_symbols', cast(length(regexp_replace(marks, '[^#*$%&|<>]+', '')) as bigint),
                'n_dup_lines', cast(size(lines) - size(array_distinct(lines)) as bigint),
                'n_repeat_words', if(size(w) < 3, 0L, {_REPEATED}),
                'n_lines', cast(size(lines) as bigint),
                'n_distinct', cast(size(array_distinct(w)) as bigint),
                'n_upper', cast(length(regexp_replace(marks, '[#*$%&|<>!.]+', '')) as bigint),
                'n_cries', cast(length(regexp_replace(marks, '[^!]+', '')) as bigint),
                'n_stops', cast(length(regexp_replace(marks, '[^.]+', '')) as bigint))""",
        ),
    ),
)

#: What the rules may ask about: name to SQL over the statistics ``s``.
FEATURES = {
    "symbols_per_word": "s.n_symbols / greatest(s.n_words, 1L)",
    "cries_per_word": "s.n_cries / greatest(s.n_words, 1L)",
    "upper_share": "s.n_upper / greatest(s.word_chars, 1L)",
    "dup_line_share": "s.n_dup_lines / greatest(s.n_lines, 1L)",
    "repeat_share": "s.n_repeat_words / greatest(s.n_words, 1L)",
    "distinct_share": "s.n_distinct / greatest(s.n_words, 1L)",
    "word_length": "s.word_chars / greatest(s.n_words, 1L)",
    "stops_per_word": "s.n_stops / greatest(s.n_words, 1L)",
    "words_per_line": "s.n_words / greatest(s.n_lines, 1L)",
}
BASE_FAILED = "s.n_words < 50 or 100 * s.n_repeat_words > 50 * s.n_words"


def statistics(text: str) -> Column:
    """The statistics of a text column as a struct."""
    quoted = text.replace("`", "``")
    return F.expr(let(f"coalesce(`{quoted}`, '')", "t", _STATISTICS))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.at_least else '<='} {self.threshold!r}D"

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, list(FEATURES).index(self.feature)]
        return column >= self.threshold if self.at_least else column <= self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int = 4, cuts: int = 48) -> Rule:
    """Adds the threshold of most information gain (FOIL's) until no good row is covered."""
    rule: Rule = ()
    while len(rule) < most and bad.any() and not bad.all():
        before, best, chosen = np.log2(bad.mean()), 1e-9, None
        for k, name in enumerate(FEATURES):
            order = np.argsort(x[:, k], kind="stable")
            v, b = x[order, k], np.cumsum(bad[order])
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, cuts + 2)[1:-1], method="nearest")):
                lo, hi = np.searchsorted(v, cut, "left"), np.searchsorted(v, cut, "right")
                for at_least, p, n in ((True, b[-1] - (b[lo - 1] if lo else 0), len(v) - lo), (False, b[hi - 1], hi)):
                    if p and n < len(v) and (gain := p * (np.log2(p / n) - before)) > best:
                        best, chosen = gain, Condition(name, at_least, float(cut))
        if chosen is None:
            break
        rule += (chosen,)
        held = chosen.holds(x)
        x, bad = x[held], bad[held]
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The first conditions of the rule that cover best: the share of bad rows, smoothed, and on a tie the shorter."""
    def worth(r: Rule) -> float:
        c = _covered(r, x)
        return (int(bad[c].sum()) + 0.2) / (int(c.sum()) + 1)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def cover(x: np.ndarray, bad: np.ndarray, most_rules: int = 12, precision: float = 0.9) -> list[Rule]:
    """Ordered rules that each reject; rows are given in an order independent of their labels, every third one prunes."""
    prune = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    while len(rules) < most_rules and bad[~prune].sum() >= 5:
        rule = _grow(x[~prune], bad[~prune])
        if not rule:
            break
        rule = _prune(rule, x[prune], bad[prune])
        held = _covered(rule, x)
        if not (n := int(held.sum())) or int(bad[held].sum()) < max(5, precision * n):
            break
        rules.append(rule)
        x, bad, prune = x[~held], bad[~held], prune[~held]
    return rules


def learn(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 6_000) -> list[Rule]:
    """Rules from the statistics of ``sample_rows`` labelled rows at most, those that pass the base rules among them."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("_id"))
        .agg(F.min(label).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_rows)
    )
    rows = (
        docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .select("_id", "_label", statistics("_text").alias("s"))
        .groupBy("_id", "_label")
        .agg(F.min(F.struct(F.expr(BASE_FAILED).alias("failed"), *(F.expr(sql).alias(name) for name, sql in FEATURES.items()))).alias("x"))
        .where("not x.failed")
        .select("_label", "x.*", F.xxhash64("_id").alias("_hash"), "_id")
        .orderBy("_hash", "_id")
        .collect()
    )
    x = np.array([[r[name] for name in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    return cover(x, np.array([r["_label"] == 0 for r in rows], bool))


def condition(rules: list[Rule]) -> str:
    """SQL over the statistics ``s``: true to keep; the first rule that holds decides."""
    whens = "".join(f" when {' and '.join(c.sql() for c in rule)} then false" for rule in rules)
    return f"case when {BASE_FAILED} then false{whens} else true end"


def score(docs: DataFrame, rules: list[Rule], *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, all statistics, ``base_failed`` and ``kept``."""
    return docs.select(F.col(id_column), statistics(text).alias("s")).select(id_column, "s.*", F.expr(BASE_FAILED).alias("base_failed"), F.expr(condition(rules)).alias("kept"))


def keep(docs: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    columns, extra = docs.columns, salted(docs)
    held = F.expr(let(f"`{extra}`", "s", condition(rules)))
    return docs.withColumn(extra, statistics(text)).where(held).select(*(f"`{c}`" for c in columns))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
