"""FASTA reading and writing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions.headers import UNICODE_SPACE, clean_header, stripped
from simloom.operators.alignment import alignment_cells
from simloom.operators.sanitize import sanitized_records
from simloom.functions.residues import clean_aligned
from simloom.plans.numbering import dense_index


def joined_lines(text: Column) -> Column:
    """Sequence of several lines: each line stripped, blank lines gone, all joined."""
    lines = F.split(F.translate(text, "\r", "\n"), "\n")
    return F.array_join(F.transform(lines, stripped), "")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, header, sequence)`` in file order.

    Splitting at ``>`` line starts keeps reading parallel within one file. The order of a record
    is its file, split and row within the split; splits are bounded, so numbering them in
    buckets never gathers a file in one task. Lines may end in LF, CR LF or CR; a file with CR alone has
    nothing to split at and is read by one task. A header is its line without the ``>`` and without white space at its end.
    """
    raw = spark.read.text(path, lineSep="\n>").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value"),
    )
    # Only the first record of a file keeps its ">"; text before it is dropped.
    first = raw.groupBy("file").agg(F.min(F.when(F.col("block") == 0, F.col("place"))).alias("first_place"))
    raw = raw.join(first, "file")
    opened = F.when(
        (F.col("block") == 0) & (F.col("place") == F.col("first_place")), F.regexp_replace("value", "^\ufeff", "")
    ).otherwise(F.concat(F.lit(">"), F.col("value")))
    chunks = F.split(F.regexp_replace(opened, "\r\n?", "\n"), rf"(?m)^{UNICODE_SPACE}*>")
    records = raw.select(
        "file", "block", "place", F.posexplode(F.slice(chunks, F.lit(2), F.size(chunks))).alias("part", "record")
    )
    header = F.regexp_replace(F.split_part("record", F.lit("\n"), F.lit(1)), rf"{UNICODE_SPACE}+$", "")
    body = F.regexp_extract("record", r"(?s)^[^\n]*\n(.*)$", 1)
    parsed = records.select("file", "block", "place", "part", header.alias("header"), joined_lines(body).alias("sequence"))
    return dense_index(
        parsed, "ord", [F.col("file"), F.col("block")], [F.col("place"), F.col("part")]
    ).select("ord", "header", "sequence")


def read_sanitized_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records after cleaning, deduplication and renaming."""
    return sanitized_records(read_fasta(spark, path))


def checked_alignment(records: DataFrame) -> DataFrame:
    """Cleaned aligned records ``(row_id, header, sequence)``; unsafe input raises.

    Empty or repeated headers (before or after cleaning), empty records and unequal lengths are
    errors. The checks are aggregates, carried as an assertion on every row.
    """
    cleaned = records.select(
        F.col("ord").alias("row_id"),
        F.col("header").alias("raw"),
        clean_header(F.col("header")).alias("header"),
        clean_aligned(F.col("sequence")).alias("sequence"),
    )
    repeated = F.lit(False)
    for name in ("raw", "header"):
        counts = cleaned.groupBy(name).agg((F.count(F.lit(1)) > 1).alias("twice"))
        repeated = repeated | F.coalesce(counts.agg(F.bool_or("twice")).scalar(), F.lit(False))
    widths = cleaned.agg(F.min(F.length("sequence")).alias("low"), F.max(F.length("sequence")).alias("high"))
    uneven = widths.select(F.col("low") != F.col("high")).scalar()
    problem = (
        F.when(F.trim("raw") == "", "empty alignment header")
        .when(F.col("header") == "", "alignment header is empty after cleaning")
        .when(F.col("sequence") == "", "alignment record without data")
        .when(repeated, "duplicate alignment header")
        .when(uneven, "aligned sequences differ in length")
    )
    checked = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("sequence"))
    return cleaned.select("row_id", "header", checked.alias("sequence"))


def read_alignment_fasta(spark: SparkSession, path: str) -> DataFrame:
    return checked_alignment(read_fasta(spark, path))


def sparse_alignment(aligned: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, cells)`` of aligned records, optionally only the headers in ``keep``."""
    if keep is not None:
        aligned = aligned.join(keep.select("header"), "header", "left_semi")
    return aligned.select("row_id", "header"), alignment_cells(aligned)


def fasta_lines(records: DataFrame) -> DataFrame:
    """One text value per record; written with ``\\n`` between values it is canonical FASTA."""
    return records.select(F.concat(F.lit(">"), "header", F.lit("\n"), "sequence").alias("value"))


def write_fasta(records: DataFrame, path: str, refuse_empty: bool = False) -> None:
    """Write records in ``ord`` order as FASTA part files.

    They are written beside the target, which is replaced only once all of them are there: a failed run leaves the old files as they were.
    """
    if refuse_empty and records.isEmpty():
        raise ValueError("refusing to write an empty FASTA")
    ordered = records.orderBy("ord") if "ord" in records.columns else records
    token = uuid.uuid4().hex
    staged, old = f"{path.rstrip('/')}.{token}.new", f"{path.rstrip('/')}.{token}.old"
    fasta_lines(ordered).write.text(staged)
    session = records.sparkSession
    target, staged, old = (session._jvm.org.apache.hadoop.fs.Path(name) for name in (path, staged, old))
    files = target.getFileSystem(session._jsc.hadoopConfiguration())
    replaced = files.exists(target)
    if replaced and not files.rename(target, old):
        raise OSError(f"cannot replace {path}")
    if not files.rename(staged, target):
        if replaced:
            files.rename(old, target)
        raise OSError(f"cannot publish {path}")
    if replaced:
        files.delete(old, True)


def numbered_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records renamed to their ordinal for an external aligner, and the dictionary back."""
    renamed = records.select("ord", F.col("ord").cast("string").alias("header"), "sequence")
    return renamed, records.select(F.col("ord").alias("node_id"), "header")


