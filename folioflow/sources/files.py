"""Files as tables: recognised words, stored documents, rasters, PDF and image signatures, and sinks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.chars import utf16_length
from . import textfiles
from .snapshots import Snapshots

# Signature window, the least size of an image, the length that is shared as a file.
PDF_WINDOW, MIN_IMAGE_BYTES, SHARE_AS_FILE = 1024, 16, 100_000
WORDS = "page bigint, block int, line int, word_no int, text string, l double, t double, r double, b double, conf double"
RASTERS = "img_id bigint, w int, h int, px array<double>"


def read_words(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Words of recognised pages, from Parquet or JSON lines."""
    return spark.read.schema(WORDS).format(kind).load(path)


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RASTERS).parquet(path)


def read_json_store(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, json) per stored file, for operators.store.load."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("json"))


def looks_like_pdf(content: Column) -> Column:
    """The signature anywhere in the first kilobyte."""
    return F.contains(F.substring(content, 1, PDF_WINDOW), F.lit(b"%PDF"))


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Files with a PDF signature: path, length, content."""
    return spark.read.format("binaryFile").load(path).where(looks_like_pdf(F.col("content"))).select("path", "length", "content")


def big(content: Column, at: int, n: int) -> Column:
    """Big-endian number of n bytes behind offset at."""
    return F.conv(F.hex(F.substring(content, at + 1, n)), 16, 10).cast("bigint")


def little(content: Column, at: int, n: int) -> Column:
    return F.conv(F.concat(*[F.hex(F.substring(content, at + k + 1, 1)) for k in reversed(range(n))]), 16, 10).cast("bigint")


def _jpeg_size(content: Column) -> Column:
    """Size from the frame header of a JPEG, which any number of segments may precede; null input stays null."""

    @arrow_udf("struct<width:bigint,height:bigint>")
    def run(batch: pa.Array) -> pa.Array:
        out = []
        for x in batch:
            data, at, size = memoryview(x.as_buffer() if x.is_valid else b"").cast("B"), 2, None
            while at + 9 <= len(data) and data[at] == 0xFF:
                mark = data[at + 1]
                if mark == 0xFF:  # fill bytes
                    at += 1
                elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 7 : at + 9], "big")
                    size = {"width": w, "height": h} if w and h else None
                    break
                elif mark == 0x01 or 0xD0 <= mark <= 0xD8:  # without a length
                    at += 2
                elif mark in (0xD9, 0xDA):
                    break
                else:
                    at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
            out.append(size)
        return pa.array(out, pa.struct([("width", pa.int64()), ("height", pa.int64())]))

    return run(content)


def image_size(content: Column) -> Column:
    """Size from a PNG, GIF, BMP, JPEG or WebP header alone (width, height); null if it is none or too short. Only
    JPEG content leaves the JVM."""
    head = F.hex(F.substring(content, 1, 16))
    png = head.startswith("89504E470D0A1A0A") & head.endswith("49484452")
    size = lambda w, h: F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    kind, bits = F.substring(head, 25, 8), little(content, 21, 4)
    low = lambda x: x.bitwiseAND(F.lit(0x3FFF))
    webp_size = (
        F.when(kind == "56503858", size(little(content, 24, 3) + 1, little(content, 27, 3) + 1))
        .when(kind == "5650384C", size(low(bits) + 1, low(F.shiftright(bits, 14)) + 1))
        .when(kind == "56503820", size(low(little(content, 26, 2)), low(little(content, 28, 2))))
    )
    jpeg = _jpeg_size(F.when(head.startswith("FFD8FF"), content))
    return (
        F.when(F.octet_length(content) < MIN_IMAGE_BYTES, None).when(png, size(big(content, 16, 4), big(content, 20, 4))).when(head.startswith("47494638"), size(little(content, 6, 2), little(content, 8, 2)))
        .when(head.startswith("424D"), size(little(content, 18, 4), little(content, 22, 4))).when(webp, webp_size).otherwise(jpeg)
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with their header's size (null where unknown); pixels are not decoded."""
    return spark.read.format("binaryFile").load(path).select("path", "length", image_size(F.col("content")).alias("size"))


def share_route(text: Column) -> Column:
    """How a text is shared: long ones, in UTF-16 units, as a file."""
    return F.when(utf16_length(text) > SHARE_AS_FILE, "file").otherwise("inline")


def write_texts(docs: DataFrame, path: str, title: str = "title", id_col: str = "doc_id", text: str = "text") -> None:
    """One UTF-8 file for each document, named by its title, as a whole or not at all; a text's line ends stay its own."""
    textfiles.write(textfiles.named(docs, title, id_col, text), path)


def write_store(stored: DataFrame, path: str, expected: int | None = None) -> int:
    """Stored JSON as the next version of the store at path: readers have the former one until the new one is there whole, and a
    writer whose expected version is no longer the latest gets a Conflict. The new version."""
    return Snapshots(stored.sparkSession, path).write(stored, expected)


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """What write_store() wrote last, or as a version; None before the first write."""
    return Snapshots(spark, path).read(version)
