"""Query registry and the shared instances of the data model on the given tables.

======== ========================================================================================
nodes    ``part``: header with accession, name and brand; length, price and type as metadata;
         brand number as cluster (25 is noise); type and colour as groups
hits     ``lineitem``: part against (order number mod parts), quantity as score
cells    ``part.p_name`` as aligned text over its whole length, blanks as gaps
records  ``documents``: source and language as header, the whole text as sequence
vectors  ``embeddings``
======== ========================================================================================
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.operators import network
from simloom.plans.runtime import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CTES = {
    "nodes": """
        SELECT p_partkey AS node_id,
               'WP_' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.1 ' || p_name || ' [' || p_brand || ']' AS header,
               p_size AS seq_len, CAST(p_size AS DOUBLE) AS length, p_retailprice AS price, p_type AS kind,
               CASE WHEN p_brand = 'Brand#25' THEN -1 ELSE CAST(substr(p_brand, 7) AS INTEGER) END AS cluster,
               lower(p_type) AS group_a, split_part(p_name, ' ', 1) AS group_b, p_size <> 50 AS visible
        FROM part""",
    "hits": """
        SELECT l_partkey AS i, l_orderkey % (SELECT max(p_partkey) + 1 FROM part) AS j,
               CAST(l_quantity AS FLOAT) AS score, CAST(l_linenumber * 7 AS INTEGER) AS aln_len
        FROM lineitem""",
    "edges": """
        SELECT least(i, j) AS i, greatest(i, j) AS j, max(score) AS score, max(aln_len) AS aln_len
        FROM hits WHERE i <> j GROUP BY ALL""",
    "aligned": """
        SELECT p_partkey AS row_id,
               rpad(replace(upper(p_name), ' ', '-'), CAST((SELECT max(length(p_name)) FROM part) AS INTEGER), '-') AS sequence
        FROM part""",
    "cells": """
        SELECT row_id, CAST(k AS INTEGER) AS col, substr(sequence, k + 1, 1) AS aa
        FROM (SELECT row_id, sequence, unnest(range(length(sequence))) AS k FROM aligned)
        WHERE substr(sequence, k + 1, 1) <> '-'""",
    "counts": "SELECT col, aa, count(*) AS n, min(row_id) AS first_row FROM cells GROUP BY ALL",
    "labels": """
        SELECT col, CAST(row_number() OVER (ORDER BY col) AS VARCHAR) AS label
        FROM (SELECT col, count(*) AS filled FROM cells GROUP BY col)
        WHERE filled >= (SELECT count(*) FROM aligned) * 0.2""",
}
_NEEDS = {"edges": ["hits"], "cells": ["aligned"], "counts": ["cells"], "labels": ["cells"]}


def sql(needs: str, body: str) -> str:
    """A SELECT over the named shared instances."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        add(name)
    parts = [f"{name} AS ({CTES[name]})" for name in ordered]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join([*parts, body[len("WITH RECURSIVE"):].strip()])
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*parts, body[len("WITH"):].strip()])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, oracle: str | None = None):
    """Register ``function(tables)`` as a query, with its SQL if there is one."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


class Tables:
    """The given tables and the shared instances derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        accession = F.concat(F.lit("WP_"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".1 "))
        return self.table("part").select(
            F.col("p_partkey").alias("node_id"),
            F.concat(accession, "p_name", F.lit(" ["), "p_brand", F.lit("]")).alias("header"),
            F.col("p_size").alias("seq_len"),
            F.col("p_size").cast("double").alias("length"),
            F.col("p_retailprice").alias("price"),
            F.col("p_type").alias("kind"),
            F.when(F.col("p_brand") == "Brand#25", -1)
            .otherwise(F.expr("substring(p_brand, 7)").cast("int"))
            .alias("cluster"),
            F.array(F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("groups"),
            (F.col("p_size") != 50).alias("visible"),
        )

    @property
    def n_nodes(self) -> Column:
        return self.table("part").agg(F.count(F.lit(1))).scalar()

    @cached_property
    def hits(self) -> DataFrame:
        n_parts = self.table("part").agg(F.max("p_partkey") + 1).scalar()
        return self.table("lineitem").select(
            F.col("l_partkey").alias("i"),
            (F.col("l_orderkey") % n_parts).alias("j"),
            F.col("l_quantity").cast("float").alias("score"),
            (F.col("l_linenumber") * 7).alias("aln_len"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        """Canonical edges ``(i, j, score)``."""
        return network.canonical_edges(self.hits)

    @cached_property
    def scored_edges(self) -> DataFrame:
        """Canonical edges with an alignment length."""
        return (
            self.hits.where("i <> j")
            .groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
            .agg(F.max("score").alias("score"), F.max("aln_len").alias("aln_len"))
        )

    @cached_property
    def aligned(self) -> DataFrame:
        """Aligned texts ``(row_id, header, sequence)`` of one width."""
        width = self.table("part").agg(F.max(F.length("p_name"))).scalar()
        text = F.replace(F.upper("p_name"), F.lit(" "), F.lit("-"))
        named = self.nodes.select("node_id", "header")
        return (
            self.table("part")
            .select(F.col("p_partkey").alias("row_id"), F.rpad(text, width, F.lit("-")).alias("sequence"))
            .join(named.withColumnRenamed("node_id", "row_id"), "row_id")
        )

    @cached_property
    def rows(self) -> DataFrame:
        return self.nodes.select(F.col("node_id").alias("row_id"), "header")

    @cached_property
    def cells(self) -> DataFrame:
        from simloom.operators.alignment import alignment_cells

        return alignment_cells(self.aligned)

    @cached_property
    def counts(self) -> DataFrame:
        from simloom.operators.alignment import residue_counts

        return residue_counts(self.cells)

    @cached_property
    def labels(self) -> DataFrame:
        """Occupancy labels of the columns filled in at least 20% of the rows."""
        from simloom.operators.alignment import column_occupancy, occupancy_labels

        enough = F.col("filled") >= self.n_nodes * 0.2
        return occupancy_labels(column_occupancy(self.cells).where(enough))

    @cached_property
    def records(self) -> DataFrame:
        """Sequence records ``(ord, header, sequence)``; lines of a text are joined."""
        from simloom.sources.fasta import joined_lines

        return self.table("documents").select(
            F.col("doc_id").alias("ord"),
            F.concat("source", F.lit(" "), "lang").alias("header"),
            joined_lines(F.col("text")).alias("sequence"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label")
