"""Metadata sheets (CSV with a name row and a type row) and text reports."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.operators.metadata import export_sheet, sheet_columns

_CSV = {"header": False, "multiLine": True, "quote": '"', "escape": '"'}


def _ordered(raw: DataFrame, *columns) -> DataFrame:
    """Rows in the order of part files and of the places in them: a quoted cell may hold line ends, so a file is read by one task."""
    return raw.select(F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place")).alias("ord"), *columns)


def read_sheet(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``(ord, header, <properties>)`` and the ``(name, type)`` list of a CSV sheet; ``ord`` orders the rows.

    A single file names the properties in its first row and their types in the second. A sheet of many part
    files, as :func:`write_sheet` leaves it, keeps these two rows apart from the data.
    """
    try:
        top = spark.read.csv(f"{path}/columns", **_CSV).orderBy("_c0").collect()
        top, raw = [row[1:] for row in top], spark.read.csv(f"{path}/rows", schema=_text_schema(len(top[0]) - 1), **_CSV)
        leading = 0
    except AnalysisException:
        raw = spark.read.csv(path, **_CSV)
        if len(raw.inputFiles()) != 1:
            raise ValueError(f"{path} has several files, none of which is known to hold the name and type rows") from None
        top, leading = [tuple(row) for row in raw.head(2)], 2
    if len(top) < 2 or len(top[0]) < 2:
        raise ValueError(f"{path} needs a name row, a type row and one property column")
    columns = sheet_columns(list(top[0]), list(top[1]))
    rows = _ordered(raw, *[F.col(name) for name in raw.columns])
    if leading:
        rows = rows.where(F.col("ord.place") >= leading)
    data = rows.select(
        "ord", F.col(raw.columns[0]).alias("header"), *[F.col(raw.columns[k]).alias(name) for k, name, _ in columns]
    )
    return data.where(F.col("header").isNotNull()), [(name, kind) for _, name, kind in columns]


def _text_schema(width: int) -> str:
    return ", ".join(f"_c{k} STRING" for k in range(width))


def write_sheet(nodes: DataFrame, properties: list[str], path: str, keep_empty: bool = False) -> None:
    """Write node metadata as a sheet of any number of part files, with its two leading rows beside them."""
    kinds = {
        p: "number" if isinstance(nodes.schema[p].dataType, T.NumericType) else "text" for p in properties
    }
    lead = nodes.sparkSession.createDataFrame(
        [("0", "", *properties), ("1", "", *[kinds[p] for p in properties])], _text_schema(len(properties) + 2)
    )
    export_sheet(nodes, properties, keep_empty).write.mode("overwrite").csv(f"{path}/rows", emptyValue="", quote='"', escape='"')
    lead.coalesce(1).write.mode("overwrite").csv(f"{path}/columns", emptyValue="")


def membership_fasta(nodes: DataFrame, records: DataFrame, by: str = "clusters", names: list[str] | None = None) -> DataFrame:
    """``(name, ord, value)`` FASTA texts per cluster or group; noise is left out.

    A node in several groups appears once in each.
    """
    if by == "clusters":
        named = nodes.where("cluster <> -1").select(
            "node_id", "header", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("name")
        )
    else:
        named = nodes.select("node_id", "header", F.explode("groups").alias("name"))
        if names is not None:
            named = named.where(F.col("name").isin([n.lower() for n in names]))
    return named.join(records.select("header", "sequence"), "header").select(
        "name", F.col("node_id").alias("ord"), F.concat(F.lit(">"), "header", F.lit("\n"), "sequence").alias("value")
    )


def write_membership_fasta(nodes: DataFrame, records: DataFrame, path: str, by: str = "clusters") -> None:
    """One folder per cluster or group; a large one is split over several part files."""
    texts = membership_fasta(nodes, records, by)
    texts.sortWithinPartitions("name", "ord").select("name", "value").write.mode("overwrite").partitionBy("name").text(path)


def selected_headers(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """Header lines of a selection."""
    return nodes.join(selected.select("node_id"), "node_id", "left_semi").select(F.col("header").alias("value"))


def selected_records(nodes: DataFrame, selected: DataFrame, records: DataFrame) -> DataFrame:
    """FASTA texts of a selection, by full header or else by first token."""
    from simloom.functions.headers import first_token

    chosen = nodes.join(selected.select("node_id"), "node_id", "left_semi").select(
        "node_id", "header", first_token(F.col("header")).alias("token")
    )
    full = records.groupBy("header").agg(F.max_by("sequence", "ord").alias("by_header"))
    token = records.groupBy(first_token(F.col("header")).alias("token")).agg(
        F.max_by(F.struct("header", "sequence"), "ord").alias("by_token")
    )
    return (
        chosen.join(full, "header", "left")
        .join(token, "token", "left")
        .where("by_header IS NOT NULL OR by_token IS NOT NULL")
        .select(
            F.col("node_id").alias("ord"),
            F.concat(
                F.lit(">"),
                F.when(F.col("by_header").isNotNull(), F.col("header")).otherwise(F.col("by_token.header")),
                F.lit("\n"),
                F.coalesce("by_header", "by_token.sequence"),
            ).alias("value"),
        )
    )


def search_lines(ranked: DataFrame) -> DataFrame:
    """``(rank, line)`` of the text report."""
    return ranked.select(
        "rank",
        F.format_string(
            " %-6d | %9.4f | %9.2f | %8d | %8d | %s", "rank", "norm_score", F.col("raw_score").cast("double"), "seq_len", "aln_len", "header"
        ).alias("line"),
    )


def typed_report(report: DataFrame) -> DataFrame:
    """Report rows as text with a leading type row, so that it can be uploaded as metadata."""
    names = report.columns
    kinds = ["" if n == "Node ID" else "number" for n in names]
    lead = report.sparkSession.createDataFrame([(0, *kinds)], "row BIGINT, " + ", ".join(f"`{n}` STRING" for n in names))
    body = report.select(F.col("Rank").cast("bigint").alias("row"), *[F.col(f"`{n}`").cast("string").alias(n) for n in names])
    return lead.unionByName(body)


def alignment_rows(path: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Report rows of aligned residues with ``|`` for equal and ``.`` for different letters."""
    a = first.select(F.col("node_id").alias("i"), F.col("sequence").alias("sa"))
    b = second.select(F.col("node_id").alias("j"), F.col("sequence").alias("sb"))
    letters = path.join(a, "i").join(b, "j").select(
        "i", "j", "row", "col",
        F.substring("sa", F.col("row") + 1, F.lit(1)).alias("ref_aa"),
        F.substring("sb", F.col("col") + 1, F.lit(1)).alias("tar_aa"),
    )
    order = Window.partitionBy("i", "j").orderBy("row")
    return letters.withColumns(
        {
            "pos": F.row_number().over(order),
            "marker": F.when(F.col("ref_aa") == F.col("tar_aa"), "|").otherwise("."),
        }
    )


_SPAN = re.compile(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?")


def mapped_highlights(path: DataFrame, spec: str) -> list[str]:
    """Target positions of a highlight list given in reference positions, ``*`` where none is aligned.

    ``path`` holds one alignment: reference place ``row`` and target place ``col``, from 0. The list (``5, 8-12``) becomes a
    small table, and one range join with the path maps all of its entries.
    """
    entries = [text for text in spec.split(",") if text.strip()]
    spans = [(k, *(int(end or found[1]) - 1 for end in found.groups())) for k, text in enumerate(entries) if (found := _SPAN.fullmatch(text))]
    wanted = path.sparkSession.createDataFrame(spans, "entry INT, low LONG, high LONG")
    mapped = (
        wanted.join(path, F.col("row").between(F.col("low"), F.col("high")))
        .groupBy("entry").agg((F.min("col") + 1).alias("first"), (F.max("col") + 1).alias("last"))
    )
    ends = {row["entry"]: dict.fromkeys((str(row["first"]), str(row["last"]))) for row in mapped.collect()}
    return ["-".join(ends.get(k, "*")) for k in range(len(entries))]
