"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. The distinct blocks of the whole corpus are
sorted and numbered, so a block becomes an integer name. Adjacent names are then paired, the distinct
pairs numbered in the same way, and so on until one name is left per text: two texts of one depth have
the same last name exactly if they are equal. Only the first level moves text, once and combined
before the shuffle; all later levels move integers. Everything is DataFrame functions.

Blocks find their names by two 64-bit fingerprints. That no two distinct blocks share them is not assumed
but counted: a clash would give a block two names and thus more rows than blocks, and the naming starts again
with other fingerprints. Pairs of names are joined by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import discard, materialized, text_of
from simloom.plans.runtime import computed_once, materialized_with

BLOCK_BYTES = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that to a text of ASCII bytes, and faster."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _blocks(content: Column, size: int) -> Column:
    """Consecutive blocks of ``size`` bytes; an empty text has one empty block."""
    last = F.greatest(F.floor((F.octet_length(content) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(content, k * size + 1, F.lit(size)))


def _fingerprint(block: Column, salt: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * salt), block), F.xxhash64(block, F.lit(2 * salt + 1))]


def _normalised(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    return computed_once(docs, *keep, norm=ascii_lower(text_of(text)))


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """Number distinct rows: hashing deals them out, a sort in each part orders them, and the part and the place make the name."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame, id_column: str, text: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The rows with a row number, digest and block count, and their first-level names ``(row, pos, blocks, name)``."""
    salt = 0
    while True:
        content = F.col("norm").cast("binary")
        parts = _blocks(content, block_bytes)
        prints = F.transform(parts, lambda b: F.struct(*[h.alias(f"h{k}") for k, h in enumerate(_fingerprint(b, salt))]))
        slim = _normalised(docs.select(F.col(id_column).alias("id"), F.col(text).alias(text)), text, "id").select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.sha2(content, 256).alias("text_sha256"),
            prints.alias("prints"),
        )
        rows = materialized(slim.withColumn("blocks", F.size("prints")))
        blocks = _normalised(docs.select(F.col(text).alias(text)), text).select(F.explode(parts).alias("block"))
        h0, h1 = _fingerprint(F.col("block"), salt)
        distinct = blocks.select(h0.alias("h0"), h1.alias("h1"), "block").distinct()
        names = _named(distinct, "h0", "h1", "block").select("h0", "h1", "name")
        wanted = rows.select("row", "blocks", F.posexplode("prints").alias("pos", "p")).select("row", "blocks", "pos", "p.h0", "p.h1")
        first, seen = materialized_with(
            wanted.join(names, ["h0", "h1"]).select("row", "blocks", "pos", "name"), found=F.count(F.lit(1))
        )
        expected = rows.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
        if seen["found"] == expected:
            return rows, first
        salt += 1


def identities(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(row, id, text_sha256, level, name)``: one row per input row; equal texts, and only they, agree in level and name.

    ``row`` numbers the input rows, so null and repeated ids are kept apart.
    """
    rows, state = _first_names(docs, id_column, text, block_bytes)
    done = state.where("blocks = 1").select("row", F.lit(0).alias("level"), "name")
    state, level = state.where("blocks > 1"), 0
    most = rows.agg(F.max("blocks")).first()[0] or 1
    while most > 1:
        level += 1
        # The names of one text, in order, two by two; the last of an odd number stands alone.
        lists = state.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("names"))
        count = F.size("names")
        pairs = lists.select(
            "row",
            F.ceil(count / 2).cast("int").alias("blocks"),
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(1), count, F.lit(2)),
                    lambda k: F.struct(
                        F.element_at("names", k)["name"].alias("a"),
                        F.when(k < count, F.element_at("names", F.least(k + 1, count))["name"]).otherwise(F.lit(-1)).alias("b"),
                    ),
                )
            ).alias("pos", "pair"),
        ).select("row", "blocks", "pos", "pair.a", "pair.b")
        pairs = materialized(pairs)
        names = _named(pairs.select("a", "b").distinct(), "a", "b")
        joined = materialized(pairs.join(names, ["a", "b"]).select("row", "blocks", "pos", "name"))
        discard(pairs)
        done = done.unionByName(joined.where("blocks = 1").select("row", F.lit(level).alias("level"), "name"))
        state = joined.where("blocks > 1")
        most = (most + 1) // 2
    return rows.select("row", "id", "text_sha256").join(done, "row")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are after lower-casing A-Z; null counts as empty. The row with the largest id stays, a
    null id is smaller than any other. Rows that repeat an id with the same text count in ``group_size`` and share their
    decision.
    """
    named = materialized(identities(docs, id_column, text, block_bytes))
    # Written, so that the join below is a plain one whose hot groups adaptive execution can split.
    groups = materialized(named.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return named.join(groups, ["level", "name"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def without_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of those that repeat an id and text."""
    stay = exact_duplicates(docs, id_column, text).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    keyed = computed_once(docs, "*", __sha=F.sha2(ascii_lower(text_of(text)).cast("binary"), 256))
    same = [F.col("d.__sha") == F.col("s.__sha"), F.col(f"d.{id_column}").eqNullSafe(F.col("s.__id"))]
    kept = keyed.alias("d").join(stay.alias("s"), same, "left_semi")
    return kept.dropDuplicates(["__sha"]).drop("__sha")
