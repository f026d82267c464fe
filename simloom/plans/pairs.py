"""All pairs of a table on a grid of tiles.

Scoring every pair is the definition of some operators. Rows are packed into blocks of bounded size and the blocks
dealt to ``p`` stripes. A tile is a pair of stripes: a task gets the blocks of both once, holds one stripe and lets the other
pass by, so a block travels to ``p`` tiles however many blocks there are, and no pair of blocks is ever stored. There are
about as many tiles as tasks, or more where a stripe would not fit into a task. Only wanted results leave a tile, and no
tile depends on how the values of the rows are distributed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.plans.numbering import id_bucket, running_total
from simloom.plans.runtime import materialized

BLOCK_ROWS = 512
# Blocks of a stripe that a task holds at once.
STRIPE_BLOCKS = 64


@dataclass
class BlockPairs:
    """Every pair of blocks of one table, or of a block of one table with a block of another.

    ``blocks`` has a row per block: ``block``, an array per column and, if two tables are paired, ``side`` (0 or 1).
    """

    blocks: DataFrame
    columns: list[str]
    two_tables: bool
    sizes: tuple[int, int]

    def grid(self, tasks: int) -> tuple[int, int]:
        """Stripes of the rows and of the columns of the grid, for about ``tasks`` tiles."""
        a, b = self.sizes
        if not self.two_tables:
            p = max(math.isqrt(2 * tasks), -(-a // STRIPE_BLOCKS), 1)
            return min(p, max(a, 1)), min(p, max(a, 1))
        # Tiles of about equal height and width move the fewest blocks.
        p = max(1, round(math.sqrt(tasks * a / max(b, 1))), -(-a // STRIPE_BLOCKS))
        p = min(p, max(a, 1))
        return p, min(max(1, -(-tasks // p)), max(b, 1))

    def tiled(self, tasks: int) -> tuple[DataFrame, int]:
        """Blocks with the tile they are sent to and their part in it (0: held, 1: passing by), and the number of tiles."""
        p, q = self.grid(tasks)
        block = F.col("block")
        if self.two_tables:
            held = self.blocks.where("side = 0").withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(q - 1)), lambda c: block % p * q + c)))
            passing = self.blocks.where("side = 1").withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda r: r * q + block % q)))
            return held.unionByName(passing).withColumnRenamed("side", "part"), p * q
        # Above the diagonal: tile (r, c) with r <= c is number r * p - r * (r - 1) / 2 + c - r.
        own = block % p
        number = lambda r, c: (r * p - F.floor(r * (r - 1) / 2) + c - r).cast("int")
        tiles = F.transform(
            F.sequence(F.lit(0), F.lit(p - 1)),
            lambda other: F.struct(number(F.least(own, other), F.greatest(own, other)).alias("tile"), (other < own).cast("int").alias("part")),
        )
        every = self.blocks.select("*", F.inline(tiles))
        return every, p * (p + 1) // 2


def _packed(rows: DataFrame, place: str, columns: list[str], block_rows: float) -> DataFrame:
    entry = F.struct(place, *columns)
    return (
        rows.groupBy(F.floor(F.col(place) / block_rows).cast("int").alias("block"))
        .agg(F.array_sort(F.collect_list(entry)).alias("rows"))
        .select("block", *[F.col(f"rows.{c}").alias(c) for c in columns])
    )


def block_pairs(rows: DataFrame, place: str, columns: list[str], block_rows: float = BLOCK_ROWS) -> BlockPairs:
    """All pairs of blocks of ``rows``; arrays are in ``place`` order.

    ``place`` numbers the rows without gaps from 0, or is a running total of their sizes in units of
    which ``block_rows`` make a block; so no block exceeds that by more than its last row.
    """
    blocks = materialized(_packed(rows, place, columns, block_rows))
    count = blocks.agg(F.max("block")).first()[0]
    return BlockPairs(blocks, columns, False, ((count + 1 if count is not None else 0),) * 2)


def bipartite_pairs(left: DataFrame, right: DataFrame, place: str, columns: list[str], block_rows: float = BLOCK_ROWS) -> BlockPairs:
    """All pairs of a block of ``left`` (``a_`` columns) and a block of ``right`` (``b_`` columns)."""
    sides = [_packed(rows, place, columns, block_rows).withColumn("side", F.lit(k)) for k, rows in enumerate((left, right))]
    blocks = materialized(sides[0].unionByName(sides[1]))
    found = {row[0]: row[1] + 1 for row in blocks.groupBy("side").agg(F.max("block")).collect()}
    return BlockPairs(blocks, columns, True, (found.get(0, 0), found.get(1, 0)))


def map_tiles(pairs: BlockPairs, work: Callable[[Iterator[dict]], Iterable[dict]], schema: str, tasks: int | None = None) -> DataFrame:
    """Run ``work`` once per tile over its pairs of blocks: dicts of numpy inputs ``a_...``, ``b_...``, ``bi`` and ``bj``.

    ``bi`` and ``bj`` are equal only where a block is paired with itself, and the first has the smaller rows within one table.
    """
    session = pairs.blocks.sparkSession
    tiled, count = pairs.tiled(tasks or int(session.conf.get("spark.sql.shuffle.partitions")))
    columns, two_tables = pairs.columns, pairs.two_tables
    # A tile is a task of its own: partition numbers are tiles.
    dealt = tiled.select("tile", "part", "block", *columns).repartitionById(count, F.col("tile")).sortWithinPartitions("part", "block")

    def block_pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[dict] = []
        passed = two_tables
        for batch in batches:
            for k in range(batch.num_rows):
                own = {name: _numpy(batch.column(name)[k]) for name in columns}
                own["block"] = batch.column("block")[k].as_py()
                part = batch.column("part")[k].as_py()
                if part == 0:
                    held.append(own)
                    continue
                passed = True
                for other in held:
                    yield _paired(other, own, columns, two_tables)
        if not passed:  # a tile on the diagonal has one stripe only
            for k, own in enumerate(held):
                for other in held[: k + 1]:
                    yield _paired(other, own, columns, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in work(block_pairs_of(batches)):
            yield pa.RecordBatch.from_pydict(found)

    return dealt.mapInArrow(run, schema)


def _paired(one: dict, other: dict, columns: list[str], two_tables: bool) -> dict:
    if not two_tables and one["block"] > other["block"]:
        one, other = other, one
    given = {"bi": one["block"], "bj": -1 - other["block"] if two_tables else other["block"]}
    for name in columns:
        given[f"a_{name}"], given[f"b_{name}"] = one[name], other[name]
    return given


def map_block_pairs(pairs: BlockPairs, score: Callable[[dict], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Run ``score`` on every block pair; it maps a dict of numpy inputs to output columns."""
    return map_tiles(pairs, lambda given: map(score, given), schema)


def _numpy(value: pa.Scalar):
    """Numpy form of a cell: a list of equal-length lists becomes a matrix."""
    if not isinstance(value, pa.ListScalar):
        return value.as_py()
    inner = value.values
    if not pa.types.is_list(inner.type):
        return inner.to_numpy(zero_copy_only=False)
    if pa.types.is_list(inner.type.value_type):
        return [_numpy(item) for item in inner]
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(inner), -1) if len(inner) else flat.reshape(0, 0)


def matrices(column: pa.Array) -> list[np.ndarray]:
    """A matrix per cell of lists of equal-length lists; the numbers of all cells are taken at once where they have one width."""
    rows = column.flatten()
    widths = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
    if column.null_count or rows.null_count or not len(rows) or widths[0] == 0 or (widths != widths[0]).any():
        return [_numpy(cell) for cell in column]
    flat = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, int(widths[0]))
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return [flat[a:b] if a < b else np.zeros((0, 0), flat.dtype) for a, b in zip([0, *ends[:-1]], ends)]


def upper_triangle(bi: int, bj: int, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the pairs to score; a block against itself counts once."""
    if bi == bj:
        return np.triu_indices(n_a, 1)
    grid = np.indices((n_a, n_b)).reshape(2, -1)
    return grid[0], grid[1]


def place_column(rows: DataFrame, id_column: str, size: Column | None = None) -> DataFrame:
    """Rows with a ``place``: their gap-free number by id, or the ``size`` of all rows before.

    Only ids and sizes are ordered; the rows themselves join their place and never meet in one task.
    """
    weight = F.lit(1).cast("long") if size is None else size
    light = rows.select(F.col(id_column), weight.alias("__size"))
    numbered = running_total(light, "place", F.col("__size"), [id_bucket(id_column)], [F.col(id_column)], inclusive=False)
    return rows.join(numbered.select(id_column, "place"), id_column)


def with_ends(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Pairs ``(i, j, ...)`` with the ``column`` of both ends in ``values`` as ``a`` and ``b``; pairs without both are left out.

    Wide values never travel with a pair. Pairs are dealt once to the tiles of a grid by hashes of both ends, a value goes to one row and one column of tiles,
    and both joins happen inside the tiles. So the shuffle grows with the narrow pairs and the values, and a frequent end is spread over its row.
    """
    p = math.isqrt(2 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1) + 1
    place = lambda end: F.pmod(F.hash(end), F.lit(p))
    every = F.explode(F.sequence(F.lit(0), F.lit(p - 1)))
    dealt = pairs.where("i IS NOT NULL AND j IS NOT NULL").withColumn("__tile", place("i") * p + place("j")).repartition("__tile")
    for end, out, tile in (("i", "a", place("i") * p + F.col("__other")), ("j", "b", F.col("__other") * p + place("j"))):
        side = values.select(F.col("node_id").cast(pairs.schema[end].dataType).alias(end), F.col(column).alias(out)).withColumn("__other", every)
        # The values of a tile are few: they are held, and the pairs pass by unsorted.
        dealt = dealt.join(side.withColumn("__tile", tile).drop("__other").hint("shuffle_hash"), ["__tile", end])
    return dealt.drop("__tile")


# Pairs that a tile gathers before they are worked on.
GATHERED = 1 << 16


def map_ends(pairs: DataFrame, values: DataFrame, column: str, work: Callable[..., Iterable[dict]], schema: str) -> DataFrame:
    """Run ``work`` on the pairs that :func:`with_ends` has, without writing a value beside a pair.

    A tile holds the values of its row and of its column as matrices and lets its pairs pass by: ``work(i, j, a, b, rows, cols)`` gets
    some pairs, both lists of matrices, and which of them belong to each pair. An id that comes several times has a pair with each.
    """
    p = math.isqrt(2 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1) + 1
    place = lambda end: F.pmod(F.hash(end), F.lit(p))
    known = values.where("node_id IS NOT NULL")
    rows = []
    for side, end in enumerate("ij"):
        node, other = F.col("node_id").cast(pairs.schema[end].dataType), F.explode(F.sequence(F.lit(0), F.lit(p - 1)))
        dealt = known.select(node.alias("i"), F.col(column).alias("value"), other.alias("other"))
        tile = F.col("other") * p + place("i") if side else place("i") * p + F.col("other")
        rows.append(dealt.select(tile.alias("tile"), F.lit(side).alias("kind"), F.col("i").cast("long"), F.lit(None).cast("long").alias("j"), "value"))
    given = pairs.where("i IS NOT NULL AND j IS NOT NULL")
    nothing = F.lit(None).cast(values.schema[column].dataType)
    ends = given.select((place("i") * p + place("j")).alias("tile"), F.lit(2).alias("kind"), F.col("i").cast("long"), F.col("j").cast("long"), nothing.alias("value"))
    every = rows[0].unionByName(rows[1]).unionByName(ends)
    dealt = every.repartitionById(p * p, F.col("tile")).sortWithinPartitions("kind").drop("tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, sides in _gathered(batches):
            at, one = _matches(sides[0][0], i)
            if at is not None:
                i, j = i[at], j[at]
            to, other = _matches(sides[1][0], j)
            if to is not None:
                i, j, one = i[to], j[to], one[to]
            if len(i):
                for found in work(i, j, sides[0][1], sides[1][1], one, other):
                    yield pa.RecordBatch.from_pydict(found)

    return dealt.mapInArrow(run, schema)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pairs of a tile, many at a time, with its values: for both sides ids in order and matrices."""
    held: list[list[tuple]] = [[], []]
    sides, waiting, size = None, [], 0
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        for side in (0, 1):
            mine = batch.filter(pa.array(kind == side))
            if mine.num_rows:
                column = mine.column("value")
                known = iter(matrices(column.drop_null()))
                held[side].append((mine.column("i").to_numpy(zero_copy_only=False), [next(known) if v else None for v in column.is_valid().to_pylist()]))
        mine = batch.filter(pa.array(kind == 2))
        if not mine.num_rows:
            continue
        if sides is None:
            sides = [_in_order(parts) for parts in held]
        waiting.append(tuple(mine.column(x).to_numpy(zero_copy_only=False) for x in "ij"))
        size += mine.num_rows
        if size >= GATHERED:
            yield *map(np.concatenate, zip(*waiting)), sides
            waiting, size = [], 0
    if waiting:
        yield *map(np.concatenate, zip(*waiting)), sides


def _in_order(parts: list[tuple]) -> tuple[np.ndarray, list]:
    ids = np.concatenate([part[0] for part in parts]) if parts else np.zeros(0, np.int64)
    every, order = [value for part in parts for value in part[1]], np.argsort(ids, kind="stable")
    return ids[order], [every[k] for k in order]


def _matches(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Where each of ``wanted`` is among ``ids`` in order: places in both, the first None if every one is there once."""
    first, last = np.searchsorted(ids, wanted), np.searchsorted(ids, wanted, "right")
    n = last - first
    if (n == 1).all():
        return None, first
    at = np.repeat(np.arange(len(wanted)), n)
    return at, first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
