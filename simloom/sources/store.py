"""Stored networks, alignments, embeddings and layouts: parquet tables plus one manifest.

Every write puts its tables into a folder of its own and then appends one manifest line that names it. Readers
follow the newest line: a folder without any is an unfinished write, and a rewrite that fails leaves the
former tables as they were. All access goes through Spark, so folders may live on any file system
the cluster knows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions.headers import SAFE_NAME

# Required columns per kind of stored data.
REQUIRED = {
    "blast": {"nodes": ["node_id", "header"], "edges": ["i", "j", "score"]},
    "alignment": {
        "nodes": ["node_id", "header", "seq_len"],
        "edges": ["i", "j", "l_score", "l_len", "g_score", "g_len"],
    },
    "msa": {"rows": ["row_id", "header"], "cells": ["row_id", "col", "aa"]},
    "embeddings": {"embeddings": ["header", "sequence", "embedding"]},
    "layout": {"positions": ["node_id", "header", "x", "y"]},
}
SAVING_MODES = {"float16", "float32"}


class StoreError(ValueError):
    """A stored folder is incomplete or does not fit its manifest."""


@dataclass(frozen=True)
class Stored:
    kind: str
    manifest: dict
    tables: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def network_kind(model_name: str | None) -> str:
    """``blast`` or ``alignment``, decided by the model name alone."""
    if not model_name or not model_name.strip():
        raise StoreError("a network needs a model name")
    return "blast" if model_name.strip().casefold() == "blast" else "alignment"


def write_store(folder: str, kind: str, tables: dict[str, DataFrame], **attributes) -> None:
    """Write the tables of a new version, then publish it."""
    _check(kind, tables)
    spark = next(iter(tables.values())).sparkSession
    last = _published(spark, folder)
    data = f"data-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.option("compression", "zstd").parquet(f"{folder}/{data}/{name}")
    manifest = {"kind": kind, **attributes}
    text = json.dumps({"version": last["version"] + 1 if last else 0, "data": data, "manifest": manifest}, sort_keys=True)
    spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.mode("append").text(f"{folder}/manifest")


def _published(spark: SparkSession, folder: str) -> dict | None:
    """The newest manifest line; a folder has as many as it was written times."""
    try:
        lines = [json.loads(row["value"]) for row in spark.read.text(f"{folder}/manifest").collect()]
    except AnalysisException:
        return None
    return max(lines, key=lambda line: line["version"], default=None)


def read_store(spark: SparkSession, folder: str, kind: str | None = None) -> Stored:
    """Open the newest finished version and check its columns."""
    found = _published(spark, folder)
    if found is None:
        raise StoreError(f"{folder} has no manifest: the write was not finished")
    manifest = found["manifest"]
    if kind is not None and manifest["kind"] != kind:
        raise StoreError(f"{folder} holds {manifest['kind']}, not {kind}")
    tables = {name: spark.read.parquet(f"{folder}/{found['data']}/{name}") for name in REQUIRED[manifest["kind"]]}
    _check(manifest["kind"], tables)
    return Stored(manifest["kind"], manifest, tables)


def _check(kind: str, tables: dict[str, DataFrame]) -> None:
    for name, columns in REQUIRED[kind].items():
        if name not in tables:
            raise StoreError(f"{kind} data needs the table {name!r}")
        missing = [c for c in columns if c not in tables[name].columns]
        if missing:
            raise StoreError(f"table {name!r} lacks {', '.join(missing)}")


def write_network(folder: str, nodes: DataFrame, edges: DataFrame, model_name: str, **attributes) -> None:
    """Store a network; edges are clustered by source, which lets readers skip by ``i``."""
    ordered = edges.repartitionByRange("i", "j").sortWithinPartitions("i", "j")
    kind = network_kind(model_name)
    write_store(folder, kind, {"nodes": nodes, "edges": ordered}, model_name=model_name, **attributes)


def write_alignment(folder: str, rows: DataFrame, cells: DataFrame, **attributes) -> None:
    """Store an alignment; cells are clustered by column, so that queries read few row groups."""
    ordered = cells.repartitionByRange("col", "row_id").sortWithinPartitions("col", "row_id")
    write_store(folder, "msa", {"rows": rows, "cells": ordered}, **attributes)


def read_network(spark: SparkSession, folder: str) -> Stored:
    stored = read_store(spark, folder)
    if stored.kind != network_kind(stored.manifest.get("model_name")):
        raise StoreError(f"{folder} holds {stored.kind}, not a network of its model")
    return stored


def network_scores(network: Stored, score: str = "global") -> DataFrame:
    """Edges as ``(i, j, score, aln_len)``; only the columns of the chosen score are read."""
    if network.kind == "blast":
        return network["edges"].select("i", "j", "score")
    first = score[0]
    return network["edges"].select("i", "j", F.col(f"{first}_score").alias("score"), F.col(f"{first}_len").alias("aln_len"))


def write_embeddings(folder: str, embeddings: DataFrame, model_name: str, saving_mode: str, complete: bool = True) -> None:
    if saving_mode not in SAVING_MODES:
        raise StoreError(f"saving mode must be one of {sorted(SAVING_MODES)}")
    if saving_mode == "float16":
        embeddings = embeddings.withColumn("embedding", half_precision(F.col("embedding")))
    write_store(
        folder, "embeddings", {"embeddings": embeddings}, model_name=model_name, saving_mode=saving_mode, complete=complete
    )


def half_precision(embedding):
    """Round 32-bit values to the nearest 16-bit float (11 significant bits, ties to even)."""

    def half(x):
        exponent = F.floor(F.log2(F.abs(x.cast("double"))))
        step = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(-14)) - 10)
        rounded = F.rint(x.cast("double") / step) * step
        return F.when((x == 0) | F.isnan(x), x.cast("double")).otherwise(rounded).cast("float")

    return F.transform(embedding, lambda v: F.transform(v, half))


def read_embeddings(spark: SparkSession, folder: str, require_complete: bool = True) -> Stored:
    stored = read_store(spark, folder, "embeddings")
    if require_complete and not stored.manifest.get("complete"):
        raise StoreError(f"embedding generation in {folder} is not complete")
    return stored


def reusable(stored: Stored, **attributes) -> bool:
    """Whether stored work carries exactly the wanted identity attributes."""
    return all(stored.manifest.get(name) == value for name, value in attributes.items())


# -- identity ----------------------------------------------------------------------------------


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one input file, read by Spark from wherever it can."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def row_digests(records: DataFrame) -> DataFrame:
    """SHA-256 per record over header and sequence."""
    return records.select("ord", F.sha2(F.concat_ws("\x1f", "header", "sequence"), 256).alias("digest"))


FAN_IN_BITS = 12


def table_fingerprint(records: DataFrame) -> DataFrame:
    """One row ``(records, fingerprint)``: SHA-256 of content and order, whatever the partitioning.

    Digests of ``2**FAN_IN_BITS`` neighbours in the order are joined and digested again, level by level, so no task
    gathers more than that many; three levels below the last suit any number of records.
    """
    level = row_digests(records).select("ord", "digest", F.lit(1).cast("long").alias("n"))
    for last in (False, False, False, True):
        place = F.lit(0).cast("long") if last else F.shiftright(F.col("ord").cast("long"), FAN_IN_BITS)
        parts = F.array_sort(F.collect_list(F.struct("ord", "digest")))
        level = level.groupBy(place.alias("place")).agg(
            F.sha2(F.array_join(F.transform(parts, lambda part: part["digest"]), ""), 256).alias("digest"), F.sum("n").alias("n")
        ).select(F.col("place").alias("ord"), "digest", "n")
    return level.select(F.col("n").alias("records"), F.col("digest").alias("fingerprint"))


def settings_id(settings: dict) -> str:
    """SHA-256 of a set of settings; their order and absent (None) ones do not count."""
    given = {name: value for name, value in settings.items() if value is not None}
    return hashlib.sha256(json.dumps(given, sort_keys=True, allow_nan=False).encode()).hexdigest()


def settings_folder(title: str, settings: dict) -> str:
    """Folder name for work with these settings: a plain title and the start of their id."""
    return re.sub(SAFE_NAME, "_", f"{title}-{settings_id(settings)[:16]}")


def matching_folders(spark: SparkSession, folders: list[str], wanted: dict) -> list[str]:
    """Folders whose layout was made with the wanted settings, by path."""
    found = []
    for folder in sorted(folders):
        try:
            stored = read_store(spark, folder, "layout")
        except StoreError:
            continue
        if stored.manifest.get("settings_id") == settings_id(wanted):
            found.append(folder)
    return found


def next_version(names: list[str]) -> str:
    """Next free ``version_NN`` name."""
    numbers = [int(m.group(1)) for n in names if (m := re.fullmatch(r"version_(\d+)", n, re.IGNORECASE))]
    return f"version_{max(numbers, default=-1) + 1:02d}"


# -- layouts -----------------------------------------------------------------------------------


def write_layout(folder: str, positions: DataFrame, settings: dict) -> None:
    write_store(folder, "layout", {"positions": positions}, settings=settings, settings_id=settings_id(settings))


def read_layout(spark: SparkSession, folder: str, nodes: DataFrame) -> DataFrame:
    """Stored positions; headers and their order must agree with the current network."""
    positions = read_store(spark, folder, "layout")["positions"]
    both = nodes.select("node_id", F.col("header").alias("expected")).join(positions, "node_id", "full")
    bad = both.where(F.col("expected").isNull() | F.col("header").isNull() | (F.col("expected") != F.col("header")))
    if not bad.isEmpty():
        raise StoreError("the stored layout belongs to another network")
    return positions
