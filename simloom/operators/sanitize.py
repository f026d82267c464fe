"""Cleaning and deduplication of sequence records.

Records are ``(ord BIGINT, header STRING, sequence STRING)``; ``ord`` is the position in the
file and is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.headers import clean_header
from simloom.functions.residues import clean_sequence, masked_symbols, stripped_symbols
from simloom.plans.numbering import dense_index, id_bucket, running_total
from simloom.plans.runtime import computed_once, materialized


def cleaned_records(records: DataFrame) -> DataFrame:
    """Raw and cleaned header and sequence side by side."""
    raw = records.select(
        "ord", F.col("header").alias("raw_header"), F.col("sequence").alias("raw_sequence")
    )
    return computed_once(
        raw,
        *raw.columns,
        header=clean_header(F.col("raw_header")),
        sequence=clean_sequence(F.col("raw_sequence")),
    )


def without_headers_containing(records: DataFrame, text: str) -> DataFrame:
    """Drop records whose header contains a text (case-sensitive; blank keeps all)."""
    if not text.strip():
        return records
    return records.where(~F.contains(F.col("header"), F.lit(text)))


def distinct_sequences(cleaned: DataFrame) -> DataFrame:
    """One row per distinct non-empty sequence with its preferred header.

    The longest header wins, then the smallest. Grouping is by digest, first per header so that
    exact copies collapse before the shuffle even if one sequence holds most records.
    """
    per_header = (
        cleaned.where(F.col("sequence") != "")
        .groupBy(F.sha2("sequence", 256).alias("digest"), "header")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("ord").alias("ord"),
            F.min_by("sequence", "ord").alias("sequence"),
        )
    )
    return (
        per_header.groupBy("digest")
        .agg(
            F.min(F.struct((-F.length("header")).alias("rank"), "header")).alias("best"),
            F.sum("copies").alias("records"),
            F.count(F.lit(1)).alias("headers"),
            F.min("ord").alias("first_ord"),
            F.min_by("sequence", "ord").alias("sequence"),
        )
        .select("sequence", F.col("best.header").alias("header"), "records", "headers", "first_ord")
    )


def unique_headers(sequences: DataFrame) -> DataFrame:
    """Give every distinct sequence its own header and output position.

    ``sequences`` holds ``(header, first_ord, ...)`` with unique ``first_ord``. A header shared by
    several sequences gets suffixes ``_1, _2, ...`` in order of appearance; numbers whose name is
    already a header are skipped. Output order is by first appearance of the header, then of the
    sequence. Numbering runs in buckets, so one header may hold most of the sequences.
    """
    light = sequences.select("header", "first_ord")
    ranked = dense_index(
        light, "rank", [id_bucket("first_ord")], [F.col("first_ord")], within=["header"], start=1
    )
    stem = F.when(F.col("header").endswith("_"), F.col("header")).otherwise(
        F.concat("header", F.lit("_"))
    )
    heads = (
        light.groupBy("header")
        .agg(F.min("first_ord").alias("head_ord"), F.count(F.lit(1)).alias("members"))
        .withColumn("stem", stem)
    )
    # At most two headers share a stem ("x" and "x_"); the later one continues the numbering.
    earlier = Window.partitionBy("stem").orderBy("head_ord").rowsBetween(Window.unboundedPreceding, -1)
    numbered = F.when(F.col("members") > 1, F.col("members")).otherwise(F.lit(0))
    heads = heads.withColumn("used", F.coalesce(F.sum(numbered).over(earlier), F.lit(0)))
    heads = running_total(
        heads, "start", F.col("members"), [id_bucket("head_ord")], [F.col("head_ord")], inclusive=False
    )
    heads = materialized(heads)
    placed = materialized(
        ranked.join(heads, "header").withColumns(
            {"ord": F.col("start") + F.col("rank") - 1, "slot": F.col("used") + F.col("rank")}
        )
    )
    single = placed.where(F.col("members") == 1).withColumn("new_header", F.col("header"))
    shared = placed.where(F.col("members") > 1)
    named = _skip_taken(shared, heads).withColumn(
        "new_header", F.concat("stem", F.col("number").cast("string"))
    )
    renamed = single.unionByName(named.drop("number")).select("first_ord", "ord", "new_header")
    return sequences.join(renamed, "first_ord")


def _skip_taken(shared: DataFrame, heads: DataFrame) -> DataFrame:
    """Turn the n-th wanted slot of a stem into the n-th number whose name is still free."""
    suffix = r"^(.*_)([1-9]\d{0,17})$"
    taken = heads.select(
        F.regexp_extract("header", suffix, 1).alias("stem"),
        F.regexp_extract("header", suffix, 2).try_cast("long").alias("number"),
    ).where(F.col("number").isNotNull())
    stems = heads.where(F.col("members") > 1).select("stem").distinct()
    taken = dense_index(
        taken.join(stems, "stem", "left_semi"),
        "place",
        [id_bucket("number")],
        [F.col("number")],
        within=["stem"],
        start=1,
    )
    # A taken number is passed once more slots are wanted than free numbers lie below it.
    passed = taken.groupBy("stem", (F.col("number") - F.col("place")).alias("at")).agg(
        F.count(F.lit(1)).alias("jump")
    )
    wanted = shared.select("stem", F.col("slot").alias("at"), F.lit(0).cast("long").alias("jump"), F.lit(0).alias("kind"))
    merged = wanted.unionByName(passed.withColumn("kind", F.lit(1)))
    jumps = running_total(
        merged, "jumps", F.col("jump"), [id_bucket("at")], [F.col("at"), F.col("kind")], within=["stem"]
    ).where(F.col("kind") == 0)
    return (
        shared.join(jumps.select("stem", F.col("at").alias("slot"), "jumps"), ["stem", "slot"])
        .withColumn("number", F.col("slot") + F.col("jumps"))
        .drop("jumps")
    )


def sanitized_records(records: DataFrame) -> DataFrame:
    """Clean, deduplicate and rename records: ``(ord, header, sequence)``."""
    # Texts are cleaned and written once; numbering then reads only the small columns.
    unique = unique_headers(materialized(distinct_sequences(cleaned_records(records))))
    return unique.select("ord", F.col("new_header").alias("header"), "sequence")


def sanitize_counters(records: DataFrame) -> DataFrame:
    """One row with the counters of :func:`sanitized_records`."""
    cleaned = cleaned_records(records)
    per_record = cleaned.agg(
        F.count(F.lit(1)).alias("original_records"),
        F.count_if(F.col("header") != F.col("raw_header")).alias("headers_modified"),
        F.count_if(F.col("sequence") != F.col("raw_sequence")).alias("sequences_modified"),
        F.count_if(F.col("sequence") == "").alias("empty_sequences_removed"),
    )
    distinct = distinct_sequences(cleaned)
    per_header = distinct.groupBy("header").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum(F.col("records") - F.col("headers")).alias("copies"),
        F.sum(F.col("headers") - 1).alias("merged"),
    )
    per_sequence = per_header.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("exact_duplicates_removed"),
        F.coalesce(F.sum("merged"), F.lit(0)).alias("different_headers_merged"),
        F.coalesce(F.sum(F.when(F.col("members") > 1, F.col("members"))), F.lit(0)).alias("headers_renamed"),
        F.coalesce(F.sum("members"), F.lit(0)).alias("final_records"),
    )
    both = per_record.unionByName(per_sequence, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in both.columns])


def length_between(records: DataFrame, shortest: int | None, longest: int | None) -> DataFrame:
    """Inclusive length filter; 0 or None switches a bound off."""
    keep = F.lit(True)
    if shortest:
        keep = keep & (F.length("sequence") >= shortest)
    if longest:
        keep = keep & (F.length("sequence") <= longest)
    return records.where(keep)


def length_counters(records: DataFrame, shortest: int | None, longest: int | None) -> DataFrame:
    size = F.length("sequence")
    return records.agg(
        F.count_if(size < (shortest or 0)).alias("too_short"),
        F.count_if((size > longest) if longest else F.lit(False)).alias("too_long"),
    )


def symbol_histogram(records: DataFrame, which: str) -> DataFrame:
    """Count trimmed (``stripped``) or masked (``converted``) symbols over all records."""
    found: Column = {"stripped": stripped_symbols, "converted": masked_symbols}[which](F.col("sequence"))
    return records.select(F.explode(found).alias("symbol")).groupBy("symbol").count()
