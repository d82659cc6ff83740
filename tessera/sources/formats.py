"""From files to texts by format, and what is inside them besides text."""

from __future__ import annotations

import io
import unicodedata
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import UnsupportedFormat
from tessera.sources import adapters, blocks, docx

FORMATS = ("docx", "pdf")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, format`` of all accepted files below a path of any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", "content", kind.alias("format")).where(F.col("format").isin(*FORMATS))


def texts(files: DataFrame, format: str) -> DataFrame:
    """``path, text`` of the files of one format; an unknown format is an error."""
    own = files.where(F.col("format") == format)
    if format == "docx":
        return docx.read_texts(own)
    if format == "pdf":
        return blocks.text_of(blocks.pdf_words(adapters.pdf_rows(own))).withColumnRenamed("doc_id", "path")
    raise UnsupportedFormat(f"unsupported format: {format}")


def images(files: DataFrame) -> DataFrame:
    """``path, part, content``: every image inside Word files, each part once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        rows += [(path, n, z.read(n)) for n in z.namelist() if n.startswith("word/media/")]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["path", "part", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, part string, content binary")


def image_texts(pictures: DataFrame) -> DataFrame:
    """``image_id, text`` of images by OCR (needs Tesseract); detection then runs on them as on any text."""
    named = pictures.select(F.concat_ws("#", "path", "part").alias("image_id"), "content")
    return blocks.text_of(blocks.ocr_words(adapters.ocr_rows(named).withColumnRenamed("image_id", "doc_id"))).withColumnRenamed("doc_id", "image_id")


@F.pandas_udf("string")
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode NFKC. It changes lengths, so apply it before detection or not at all; null stays null."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))
