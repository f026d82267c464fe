"""Tabular hit files of external aligners (12 white-space separated columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions.headers import stripped
from simloom.functions.scores import evalue_score
from simloom.operators.network import canonical_edges
from simloom.plans.numbering import dense_index, id_bucket
from simloom.plans.runtime import computed_once

DEFAULT_EVALUE_COLUMN = 10


def read_hit_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, value)`` in file order."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    return dense_index(raw, "line", [F.col("file"), F.col("block")], [F.col("place")]).select("line", "value")


def _fields(value: Column) -> Column:
    return F.split(stripped(value), r"\s+")


def _data_lines(lines: DataFrame) -> DataFrame:
    text = stripped(F.col("value"))
    return lines.where((text != "") & ~text.startswith("#"))


def parse_numeric_hits(lines: DataFrame, n_sequences: Column | int) -> DataFrame:
    """Strict parse with integer ids: ``(line, i, j, score, ok)``.

    A line is not ``ok`` if it has too few columns, its ids are no integers in
    ``0..n_sequences-1``, or its E-value (column 10) is negative or not finite.
    """
    limit = F.lit(n_sequences) if isinstance(n_sequences, int) else n_sequences
    fields = computed_once(_data_lines(lines), "line", f=_fields(F.col("value")))
    typed = fields.select(
        "line",
        F.size("f").alias("width"),
        F.get("f", F.lit(0)).try_cast("long").alias("i"),
        F.get("f", F.lit(1)).try_cast("long").alias("j"),
        F.get("f", F.lit(DEFAULT_EVALUE_COLUMN)).try_cast("double").alias("evalue"),
    )
    in_range = (F.least("i", "j") >= 0) & (F.greatest("i", "j") < limit)
    finite = (F.col("evalue") >= 0) & (F.col("evalue") < float("inf"))
    ok = F.coalesce(
        (F.col("width") >= 12) & F.col("i").isNotNull() & F.col("j").isNotNull() & in_range & finite, F.lit(False)
    )
    return typed.select("line", "i", "j", F.when(ok, evalue_score(F.col("evalue"))).alias("score"), ok.alias("ok"))


def evalue_column(lines: DataFrame) -> DataFrame:
    """``(column)`` whose tokens most often look like E-values, over all usable lines.

    Ties go to the column seen first; without any such token it is column 10.
    """
    usable = _data_lines(lines).select("line", _fields(F.col("value")).alias("f")).where(F.size("f") >= 3)
    tokens = usable.select("line", F.posexplode("f").alias("pos", "token")).where("pos >= 2")
    looks = F.col("token").rlike(r"^-?\d+(\.\d+)?[eE][+-]?\d+$") | (F.col("token") == "0.0")
    best = (
        tokens.where(looks)
        .groupBy("pos")
        .agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("seen"))
        .agg(F.min(F.struct((-F.col("n")).alias("minus"), "seen", "pos"))["pos"].alias("pos"))
    )
    return best.select(F.coalesce("pos", F.lit(DEFAULT_EVALUE_COLUMN)).alias("column"))


def parse_named_hits(lines: DataFrame, column: int) -> DataFrame:
    """``(line, query, subject, evalue)`` with text ids; the E-value is NULL if unreadable."""
    fields = computed_once(_data_lines(lines), "line", f=_fields(F.col("value")))
    return fields.select(
        "line",
        F.get("f", F.lit(0)).alias("query"),
        F.get("f", F.lit(1)).alias("subject"),
        F.get("f", F.lit(column)).try_cast("double").alias("evalue"),
    ).where("subject IS NOT NULL")


def first_appearance_ids(named: DataFrame) -> DataFrame:
    """``(header, node_id)`` numbered by first appearance, query before subject.

    Self hits and lines with unreadable E-values count too.
    """
    sides = F.array(
        F.struct(F.col("query").alias("header"), (F.col("line") * 2).alias("place")),
        F.struct(F.col("subject").alias("header"), (F.col("line") * 2 + 1).alias("place")),
    )
    first = named.select(F.inline(sides)).groupBy("header").agg(F.min("place").alias("place"))
    return dense_index(first, "node_id", [id_bucket("place")], [F.col("place")]).select("header", "node_id")


def named_network(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and canonical edges of a hit table with text ids; negative E-values are left out."""
    nodes = first_appearance_ids(named)
    query = nodes.select(F.col("header").alias("query"), F.col("node_id").alias("i"))
    subject = nodes.select(F.col("header").alias("subject"), F.col("node_id").alias("j"))
    scored = (
        named.where("evalue >= 0")
        .join(query, "query")
        .join(subject, "subject")
        .select("i", "j", evalue_score(F.col("evalue")).alias("score"))
    )
    return nodes.select("node_id", "header"), canonical_edges(scored)
