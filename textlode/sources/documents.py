"""Documents from a directory tree: classify, extract, split off errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.functions.markup import chardata_text
from textlode.sources.listing import read_files

# Extensions, compared as written.
MARKUP_EXTENSIONS = ("xhtml", "html", "xml", "svg")
PDF_EXTENSION = "pdf"
UNSUPPORTED = "unsupported"
UNREADABLE = "unreadable"


def read_documents(
    spark: SparkSession, directory: str, strict: bool = False, every_file: bool = True
) -> DataFrame:
    """(doc_id, text, error) of every regular file below ``directory``.

    The document key is the absolute path.  With ``every_file`` false Spark's own listing
    is used: it reads any path that Spark can open, inside the JVM, but leaves out names
    that start with ``_`` or ``.`` and empty files.
    """
    if every_file:
        return extract_documents(read_files(spark, directory), strict)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    )
    return extract_documents(files.select("path", "content"), strict)


def extract_documents(files: DataFrame, strict: bool = False) -> DataFrame:
    """(path, content) -> (doc_id, text, error)."""
    doc_id = F.regexp_replace("path", "^file:(//)?", "")
    kind = classify_format(F.col("doc_id"))
    plain = read_plain_text(F.col("content"))
    text = (
        F.when(kind == "markup", chardata_text(plain, strict))
        .when(kind == "plain", plain)
        .otherwise(F.lit(None).cast("string"))
    )
    error = F.when(kind == "pdf", UNSUPPORTED).when(F.col("content").isNull(), UNREADABLE)
    return files.withColumn("doc_id", doc_id).select(
        "doc_id", text.alias("text"), error.alias("error")
    )


def classify_format(path: Column) -> Column:
    """``markup``, ``pdf`` or ``plain`` by what follows the last dot of the path."""
    extension = F.substring_index(path, ".", -1)
    return (
        F.when(extension.isin(*MARKUP_EXTENSIONS), "markup")
        .when(extension == PDF_EXTENSION, "pdf")
        .otherwise("plain")
    )


def read_plain_text(content: Column) -> Column:
    """Whole content as text; invalid bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def split_read_errors(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable documents, error rows).  Rows without text count as errors."""
    error = F.coalesce("error", F.when(F.col("text").isNull(), UNREADABLE))
    marked = documents.withColumn("error", error)
    good = marked.where(F.col("error").isNull()).select("doc_id", "text")
    bad = marked.where(F.col("error").isNotNull()).select("doc_id", "error")
    return good, bad
