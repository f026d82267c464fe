"""Header list files, target lists and command scripts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions.headers import stripped


def read_header_list(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``(header)`` from a list file, or from the header lines of a FASTA file.

    Names without a ``.txt`` or ``.fasta`` ending get ``.txt``.
    """
    if not name.lower().endswith((".txt", ".fasta")):
        name += ".txt"
    return header_lines(spark.read.text(os.path.join(folder, name)), name.lower().endswith(".fasta"))


def header_lines(lines: DataFrame, fasta: bool) -> DataFrame:
    """Non-blank trimmed lines; for FASTA only the text after ``>``."""
    text = stripped(F.regexp_replace("value", "^\ufeff", ""))
    rows = lines.select(text.alias("header")).where(F.col("header") != "")
    if fasta:
        rows = rows.where(F.col("header").startswith(">")).select(F.expr("substring(header, 2)").alias("header"))
    return rows


def checked_targets(headers: DataFrame) -> DataFrame:
    """Target headers; repeated ones are an error."""
    return headers.groupBy("header").count().select(
        F.when(F.col("count") > 1, F.raise_error(F.concat(F.lit("duplicate target "), "header")))
        .otherwise(F.col("header"))
        .alias("header")
    )
