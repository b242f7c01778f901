"""Case segmentation: paragraphs to cases, and cases to their fields, by running sums and fill-forward over ordered rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import vocabulary as v
from faultline.functions.text import join_filled, normalize_text, stable_id, strip, strip_bracket_heading

TITLED = r"(?U)^【案例\s*([0-9０-９]+)】\s*(.+)$"
NUMBERED = r"(?U)^事故案例\s*([0-9]+[-—][0-9]+)\s*$"
SECTION = r"(?U)^【([^】]{2,20})】\s*(.*)$"
INLINE = r"(?U)^([一-龥A-Za-z0-9（）()]+)\s*[:：]\s*(.*)$"
CHAPTER = "^第[一二三四五六七八九十0-9]+[章节篇]"


def sessions(df: DataFrame, starts: Column, partition: Sequence[str], order: Sequence[str], name: str = "session") -> DataFrame:
    """Numbers runs of rows: each row where ``starts`` holds begins the next one; rows before the first have 0."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def fill_forward(df: DataFrame, value: Column, partition: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """The last non-null value up to each row."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def classify(paragraphs: DataFrame) -> DataFrame:
    """Marks headings: ``case_no`` (null for other paragraphs) and ``heading_title``."""
    t = F.col("text")
    titled, numbered = t.rlike(TITLED), t.rlike(NUMBERED)
    return paragraphs.withColumns(
        {
            "case_no": F.when(titled, F.regexp_extract(t, TITLED, 1)).when(numbered, F.regexp_extract(t, NUMBERED, 1)),
            "heading_title": F.when(titled, strip(F.regexp_extract(t, TITLED, 2))),
        }
    )


def split_cases(paragraphs: DataFrame, max_title: int = 120) -> DataFrame:
    """Paragraphs of cases: source_file, file_seq, case_ord, para_no, text, source_case_no, title. What stands before a file's first heading is dropped."""
    rows = sessions(classify(paragraphs), F.col("case_no").isNotNull(), ["file_seq"], ["para_no"], "case_ord").where("case_ord > 0")
    w = Window.partitionBy("file_seq", "case_ord").orderBy("para_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    short = F.when(F.col("case_no").isNull() & (F.length("text") <= max_title), F.col("text"))
    return rows.withColumns(
        {"source_case_no": F.first("case_no").over(w), "title": F.coalesce(F.first("heading_title").over(w), F.first(short, ignorenulls=True).over(w), F.lit(""))}
    ).withColumn("is_heading", F.col("case_no").isNotNull()).drop("case_no", "heading_title")


def parse_cases(parts: DataFrame, aliases: Mapping[str, str] = v.FIELD_ALIASES, fields: Sequence[str] = v.CASE_FIELDS, min_chars: int = 80) -> DataFrame:
    """One row for each case: its identity, its fields ('' where missing), raw_text and ``seq``; shorter cases are dropped."""
    names = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    t = F.col("text")
    section, inline = names[F.regexp_extract(t, SECTION, 1)], names[F.regexp_extract(t, INLINE, 1)]
    body = ~F.col("is_heading")
    rows = parts.withColumns({"own_key": F.when(body, F.coalesce(section, inline)), "own_body": F.when(section.isNotNull(), strip(F.regexp_extract(t, SECTION, 2))).otherwise(strip(F.regexp_extract(t, INLINE, 2)))})
    rows = fill_forward(rows, F.col("own_key"), ["file_seq", "case_ord"], ["para_no"], "key")
    said = F.when(F.col("own_key").isNotNull(), F.col("own_body")).when(body & ~t.rlike(CHAPTER), strip_bracket_heading(t))
    rows = rows.withColumn("said", said)

    def ordered(value: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct("para_no", value.alias("x")))), lambda s: s["x"])

    cases = rows.groupBy("file_seq", "case_ord").agg(
        F.first("source_file").alias("source_file"),
        F.first("source_case_no").alias("source_case_no"),
        F.first("title").alias("title"),
        normalize_text(F.array_join(ordered(F.col("text")), "\n")).alias("raw_text"),
        *(join_filled(ordered(F.when(F.col("key") == f, F.col("said")))).alias(f) for f in fields),
    )
    case_id = F.concat(F.lit("HCA-"), F.substring(stable_id(F.col("source_file"), F.col("source_case_no"), F.col("title")), 1, 10))
    seq = F.col("file_seq").cast("bigint") * (1 << 32) + F.col("case_ord")
    return cases.where(F.length("raw_text") >= min_chars).select(case_id.alias("case_id"), "source_file", "source_case_no", "title", *fields, "raw_text", seq.alias("seq"))


def build_cases(paragraphs: DataFrame, min_chars: int = 80) -> DataFrame:
    return parse_cases(split_cases(paragraphs), min_chars=min_chars)
