"""Word and text files as paragraph rows (source_file, file_seq, para_no, seq, text)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions.text import normalize_paragraph

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "source_file string, para_no int, text string"


def docx_paragraphs(data: bytes) -> list[str]:
    """Body paragraphs, then all table rows with cells joined by `` | ``: tables come last, wherever they stand."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def said(node) -> str:
        return "".join({f"{_W}t": n.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(n.tag, "") for n in node.iter())

    def squeezed(text: str) -> str:
        return " ".join(text.split())

    out = [squeezed(said(p)) for p in body.findall(f"{_W}p")]
    for row in (r for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")):
        cells = ["\n".join(said(p) for p in c.findall(f"{_W}p")) for c in row.findall(f"{_W}tc")]
        out.append(" | ".join(x for x in map(squeezed, cells) if x))
    return [x for x in out if x]


def read_docx(spark: SparkSession, *paths: str) -> DataFrame:
    """Paragraphs of .docx files, read in parallel by file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"]):
                found = docx_paragraphs(bytes(data))
                yield pd.DataFrame({"source_file": PurePosixPath(path).name, "para_no": range(len(found)), "text": found})

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(run, SCHEMA)


def read_text(spark: SparkSession, *paths: str) -> DataFrame:
    """Paragraphs of text files (legacy .doc files are converted to text beforehand): one a line, blank ones dropped."""
    whole = spark.read.text(list(paths), wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"), "value")
    lines = whole.select("source_file", F.filter(F.transform(F.split("value", "\r\n|\r|\n"), normalize_paragraph), lambda x: x != "").alias("lines"))
    return lines.select("source_file", F.posexplode("lines").alias("para_no", "text"))


def read_paragraphs(spark: SparkSession, *paths: str) -> DataFrame:
    """By suffix; all files as one set with ``file_seq`` in the order given and ``seq`` over all."""
    readers, parts = {".docx": read_docx, ".txt": read_text}, None
    for k, path in enumerate(paths):
        suffix = PurePosixPath(path).suffix.lower()
        if suffix == ".doc":
            raise ValueError(f"legacy Word file; convert it to .docx or .txt first: {path}")
        if suffix not in readers:
            raise ValueError(f"unsupported file type: {path}")
        part = readers[suffix](spark, path).withColumn("file_seq", F.lit(k))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return spark.createDataFrame([], SCHEMA + ", file_seq int, seq bigint")
    return parts.withColumn("seq", F.col("file_seq").cast("bigint") * (1 << 32) + F.col("para_no"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``seq`` from an order that identifies rows; meant for dimension tables, as it sorts in one task."""
    return df.withColumn("seq", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
