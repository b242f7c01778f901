"""Functions on numbers, arrays, JSON values and times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two arrays over their common length; 0 where a norm is 0."""
    products = F.zip_with(left.cast("array<double>"), right.cast("array<double>"), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    dot = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)

    def norm(c: Column) -> Column:
        return F.sqrt(F.aggregate(c.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))

    size = norm(left) * norm(right)
    return F.when(size > 0, dot / size).otherwise(F.lit(0.0))


def combined_score(string_score: Column, vector_score: Column, string_weight: float = 0.4, vector_weight: float = 0.6) -> Column:
    return string_score * string_weight + vector_score * vector_weight


def as_list(c: Column) -> Column:
    """A string as an array of one; null and empty as no element."""
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.array(c))


def unique_in_order(*parts: Column) -> Column:
    """The parts' elements, each first occurrence, without nulls and empty strings."""
    whole = F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))
    return F.array_distinct(F.filter(whole, lambda x: x.isNotNull() & (x != "")))


def unique_numbers(whole: Column) -> Column:
    return F.array_distinct(F.filter(whole, lambda x: x.isNotNull()))


def ordered_list(order: Column, value: Column) -> Column:
    """Aggregate: the values as an array in the order given."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])


def safe_double(c: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(default).cast("double"))


def mean_of(c: Column) -> Column:
    """Mean of an array of numbers, 0 without any."""
    return F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)).otherwise(F.lit(0.0))


def vote_ratio(yes: Column, no: Column) -> Column:
    """Aggregate: the share of yes among all votes, 0 without votes."""
    y, n = F.sum(F.coalesce(yes, F.lit(0))), F.sum(F.coalesce(no, F.lit(0)))
    return F.coalesce(F.try_divide(y.cast("double"), (y + n).cast("double")), F.lit(0.0))


def case_ids(source_cases: Column, case_id: Column) -> Column:
    return unique_in_order(source_cases, F.array(case_id.cast("string")))


def entity_type(entity_type: Column, label: Column) -> Column:
    return F.coalesce(F.nullif(entity_type, F.lit("")), F.nullif(label, F.lit("")), F.lit("KGNode"))


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


def running_seconds(started_at: Column) -> Column:
    """Seconds since an ISO time, 0 at least; 0 for what is no time."""
    return F.greatest(F.coalesce(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.try_to_timestamp(started_at)), F.lit(0)), F.lit(0)).cast("double")


def average_seconds(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def remaining_seconds(average: Column, left: Column) -> Column:
    return average * F.greatest(left, F.lit(0))


def two_sided_p(estimate: float, error: float) -> float | None:
    """Normal approximation; Spark has no erfc, and there are a few rows only."""
    return math.erfc(abs(estimate / error) / math.sqrt(2)) if error > 0 else None
