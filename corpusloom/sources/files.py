"""Binary files as documents: magic and size checks, text decoding, conversion and OCR through injected services."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.sources.shared import written

# --- Fixed values -----------------------------------------------------------------------------------------
MAX_BYTES = 25 * 1024 * 1024
#: format -> (first bytes in hex, converter route).
FORMATS = {
    "docx": (("504B0304",), "office"), "odt": (("504B0304",), "office"), "doc": (("D0CF11E0A1B11AE1",), "office"), "rtf": (("7B5C727466",), "office"),
    "jpg": (("FFD8FF",), "image"), "jpeg": (("FFD8FF",), "image"), "png": (("89504E470D0A1A0A",), "image"), "tif": (("49492A00", "4D4D002A"), "image"),
    "tiff": (("49492A00", "4D4D002A"), "image"), "txt": ((), "office"),
}
PDF = "255044462D"
#: What bytes 80 to 9F are in the code page that old files use; undefined ones become U+FFFD.
CP1252 = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
LEAST_CHARS = 30
# ----------------------------------------------------------------------------------------------------------


def read_files(spark: SparkSession, path: str, pattern: str = "*", most: int = MAX_BYTES) -> DataFrame:
    """(path, length, error_code, content); the content of files that are too large isn't read.

    Spark's reader leaves out files without bytes; what else brings an empty content is invalid_file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    error = F.when(F.col("length") > most, "file_too_large").when(F.col("length") == 0, "invalid_file")
    bad = files.select("path", "length").withColumn("error_code", error).filter("error_code is not null").withColumn("content", F.lit(None).cast("binary"))
    good = files.filter(F.col("length").between(1, most)).select("path", "length", F.lit(None).cast("string").alias("error_code"), "content")
    return good.unionByName(bad)


def starts_with(content: Column, first: str) -> Column:
    """Whether the content begins with these bytes, given in hex."""
    return F.hex(F.substring(content, 1, len(first) // 2)) == first


def magic_error(content: Column, extension: Column) -> Column:
    """invalid_file where the bytes don't fit the extension, unsupported_format for others, else null."""
    out = F.when(extension == "pdf", F.when(~starts_with(content, PDF), "invalid_file"))
    for name, (firsts, _) in FORMATS.items():
        fits = ~F.contains(content, F.lit(b"\x00")) if not firsts else F.lit(False)
        for first in firsts:
            fits = fits | starts_with(content, first)
        out = out.when(extension == name, F.when(~fits, "invalid_file"))
    return out.otherwise("unsupported_format")


def converter_route(extension: Column) -> Column:
    """J12."""
    return F.try_element_at(F.create_map(*(F.lit(x) for k, (_, route) in FORMATS.items() for x in (k, route))), extension)


def decode_text(content: Column) -> Column:
    """UTF-8 where valid, else the old code page; a byte order mark goes."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    old = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), CP1252)
    return F.regexp_replace(F.coalesce(utf8, old), r"^\uFEFF", "")


def extract_text(files: DataFrame, extract: Callable[[bytes], str], ocr: Callable[[bytes], bytes] | None = None, least: int = LEAST_CHARS) -> DataFrame:
    """Files with text, method and error_code; documents with too little text are read again, once, after OCR.

    extract and ocr stand for external services; an exception becomes the row's error_code.
    """
    fields = "path string, text string, method string, error_code string"

    def stage(method: str, prepare: Callable[[bytes], bytes]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for path, content in zip(batch["path"], batch["content"]):
                    try:
                        out.append((path, extract(prepare(content)), method, None))
                    except Exception as error:  # the service's failure belongs to the row
                        out.append((path, None, method, getattr(error, "code", "extraction_failed")))
                yield pd.DataFrame(out, columns=["path", "text", "method", "error_code"])

        return run

    valid = files.filter("error_code is null").select("path", "content")
    first = written(valid.mapInPandas(stage("text", lambda c: c), fields), "files-text")  # the service is asked once
    rejected = files.filter("error_code is not null").select("path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("method"), "error_code")
    if ocr is None:
        return first.unionByName(rejected)
    poor = F.col("error_code").isNull() & (t.meaningful_chars(F.col("text")) < least)
    again = valid.join(first.filter(poor).select("path"), "path", "left_semi").mapInPandas(stage("ocr", ocr), fields)
    return first.filter(~F.coalesce(poor, F.lit(False))).unionByName(again).unionByName(rejected)
