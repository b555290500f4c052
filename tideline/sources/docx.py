"""Word documents: their paragraphs as rows, and pages that begin at headings.

`docx_paragraphs` reads any store that Spark reads, as binary files whose tasks unpack them. For folders that all machines
mount there is a data source of its own, `spark.read.format("docx")` after `register_docx`, with a partition for each file.
"""

from __future__ import annotations

import glob
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, paragraph int, style string, heading boolean, text string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Paragraphs that are headings whatever their style.
HEADING = r"^(chapter|unit|lesson|section)\s"


def _style_names(book: zipfile.ZipFile) -> dict[str, str]:
    """Names of the styles by their ids; a document without a part for styles has none."""
    if "word/styles.xml" not in book.namelist():
        return {}
    styles = ElementTree.fromstring(book.read("word/styles.xml")).iter(f"{_W}style")
    return {s.get(f"{_W}styleId", ""): name.get(f"{_W}val", "") for s in styles if (name := s.find(f"{_W}name")) is not None}


def _text_of(paragraph: ElementTree.Element) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in paragraph.iter()).strip()


def paragraphs(content: bytes) -> Iterator[tuple[int, str, bool, str]]:
    """(number, style, heading, text) of the paragraphs of a document's body that are not empty; none for a file that is
    not a Word document."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            names = _style_names(book)
            body = ElementTree.fromstring(book.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return
    n = 0
    for p in body.findall(f"{_W}p") if body is not None else ():
        text = _text_of(p)
        if not text:
            continue
        given = p.find(f"{_W}pPr/{_W}pStyle")
        style_id = given.get(f"{_W}val", "") if given is not None else ""
        style = names.get(style_id, style_id)
        yield n, style, "heading" in style.lower() or re.match(HEADING, text, re.I) is not None, text
        n += 1


def docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """path, paragraph, style, heading and text of every paragraph of the .docx files below a path."""

    def unpack(batches):
        for rb in batches:
            for name, content in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                rows = [(name, *p) for p in paragraphs(content.as_buffer().to_pybytes())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string()), strict=True)], names=["path", "paragraph", "style", "heading", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(unpack, SCHEMA)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            found = glob.glob(os.path.join(self.path, "**", "*.docx"), recursive=True)
        else:
            found = glob.glob(self.path)
        return [_File(p) for p in sorted(found)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            content = f.read()
        for row in paragraphs(content):
            yield (partition.path, *row)


class Docx(DataSource):
    """Word files of a folder, or of a pattern, that the driver and all executors mount at the same place."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        if "path" not in self.options:
            raise ValueError("a path is needed")
        return _Reader(self.options["path"])


def register_docx(spark: SparkSession) -> None:
    spark.dataSource.register(Docx)


def logical_pages(lines: DataFrame, key: str, order: str) -> DataFrame:
    """key, page, section and text: the lines between two headings, joined by empty lines, under the heading before them.

    lines: key, order, heading and text. Pages count from 0 and those without a line are none; a text of nothing but
    headings is one page of them. White space around lines is taken off and empty ones are left out.
    """
    full = lines.select(key, order, F.col("heading").alias("_h"), F.trim(F.col("text")).alias("text")).where("text <> ''")
    part = F.sum(F.col("_h").cast("int")).over(Window.partitionBy(key).orderBy(order))
    grouped = full.withColumn("_part", part).groupBy(key, "_part").agg(
        F.max(F.when(F.col("_h"), F.col("text"))).alias("section"),
        F.sort_array(F.collect_list(F.when(~F.col("_h"), F.struct(order, "text")))).alias("body"),
        F.first("text").alias("_any"),
    )
    text = F.array_join(F.transform("body", lambda x: x["text"]), "\n\n")
    some = F.sum(F.when(F.size("body") > 0, 1).otherwise(0)).over(Window.partitionBy(key))
    counted = grouped.withColumn("_some", some)
    page = F.row_number().over(Window.partitionBy(key).orderBy("_part")) - 1
    pages = counted.where(F.size("body") > 0).select(key, page.cast("int").alias("page"), F.substring("section", 1, 160).alias("section"), text.alias("text"))
    only = counted.where("_some = 0").groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_part", "_any"))), lambda x: x["_any"]), "\n\n").alias("text"))
    return pages.unionByName(only.select(key, F.lit(0).alias("page"), F.lit(None).cast("string").alias("section"), "text"))
