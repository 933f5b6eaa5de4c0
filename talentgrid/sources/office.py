"""Texts of uploaded files: plain text and word-processor documents (zip archives of XML), and why a file gives none."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from talentgrid.sources.tables import kind_of

#: What stands for the elements of a document's text (fixed values).
MARKS = {"tab": "\t", "br": "\n", "cr": "\n", "p": "\n\n"}
PARTS = (r"word/header\d*\.xml", r"word/document\.xml", r"word/footer\d*\.xml")


def part_text(xml: bytes) -> str:
    """The runs of one part in order; a paragraph begins with an empty line."""
    out = []
    for node in ElementTree.fromstring(xml).iter():
        name = node.tag.rpartition("}")[2]
        out.append(node.text or "" if name == "t" else MARKS.get(name, ""))
    return "".join(out)


def docx_text(content: bytes | None) -> str | None:
    """The text of a document: headers, body, footers; empty where there is none, null where the bytes aren't such a document."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            names = sorted(archive.namelist())
            if "word/document.xml" not in names:
                return None
            return "".join(part_text(archive.read(n)) for p in PARTS for n in names if re.fullmatch(p, n)).strip()
    except (zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError, RuntimeError, EOFError):
        return None


@F.pandas_udf(StringType())
def docx_texts(contents: pd.Series) -> pd.Series:
    return contents.map(docx_text)


@F.pandas_udf(StringType())
def plain_texts(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: bytes(c or b"").decode("utf-8", "ignore"))


def resume_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text, message) of the files of a folder. Plain text is read as UTF-8, bytes that aren't are left out; PDF files and
    the older binary documents need a converter, so they and files of other kinds have a message and no text.
    Files of no bytes give no row: Spark's file sources skip them."""
    files = spark.read.format("binaryFile").load(path).withColumn("kind", kind_of(F.col("path")))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("content"))
    text = F.when(F.col("kind") == "txt", plain_texts(of("txt"))).when(F.col("kind") == "docx", docx_texts(of("docx")))
    message = F.when(F.col("kind").isNull(), "unsupported file type").when(F.col("kind").isin("pdf", "doc"), "needs a converter").when(F.col("text").isNull(), "not a readable document")
    return files.withColumn("text", text).select("path", "kind", "text", message.alias("message"))
