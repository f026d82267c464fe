"""Best-fit-decreasing packing of token sequences into windows of a fixed length.

Texts are cut into full windows and a rest. What best fit does depends on lengths alone, and there are at most
``window`` of them, so it is run on the number of pieces of each length: windows that have the same room are one
entry ``(first window, count)``, and all pieces of one length go to the tightest entry in one step. A segment tree over the
remaining capacity finds it. The outcome is the same, window by window, as taking the pieces one at a time. The plan has a few
rows per length however large the corpus is; each piece finds its place by its rank among those of its length, which tasks count
locally and a sum over tasks completes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm.shared import map_rows, materialized
from simloom.llm.tokens import word_encoder

WINDOW = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local long"
PLAN = "length long, rank_from long, rank_to long, first long, each long, base long"


class Rooms:
    """Open windows by remaining capacity; a segment tree answers which is the smallest capacity of at least ``need``."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [False] * (2 * self.size)
        self.entries: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _mark(self, room: int) -> None:
        k = room + self.size
        self.tree[k] = bool(self.entries[room])
        while k > 1:
            k //= 2
            self.tree[k] = self.tree[2 * k] or self.tree[2 * k + 1]

    def add(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.entries[room].append((first, count))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        entry = self.entries[room].pop()
        self._mark(room)
        return entry

    def tightest(self, need: int) -> int | None:
        k = need + self.size
        while not self.tree[k]:
            while k & 1:  # a right child: its parent's subtree has no larger capacities left
                k //= 2
                if k <= 1:
                    return None
            k += 1
            if k >= 2 * self.size:
                return None
        while k < self.size:
            k = 2 * k if self.tree[2 * k] else 2 * k + 1
        return k - self.size


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of :data:`PLAN`: pieces ``rank_from <= rank < rank_to`` of a length go ``each`` to a window, from window ``first`` on, after ``base`` ids.

    Every step uses up an entry or ends its length, and leaves at most three entries, so the plan grows with ``window`` alone.
    """
    rooms, opened, rows = Rooms(window), 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = rooms.tightest(length)
            if room is None:
                each = window // length
                room, first, count = window, opened, -(-left // each)
                opened += count
            else:
                first, count = rooms.take(room)
                each = room // length
            placed = min(left, each * count)
            rows.append((length, rank, rank + placed, first, each, window - room))
            full, some = divmod(placed, each)
            rooms.add(room - each * length, first, full)
            if some:
                rooms.add(room - some * length, first + full, 1)
            used = full + bool(some)
            rooms.add(room, first + used, count - used)
            rank, left = rank + placed, left - placed
    return rows


def pieces(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of every text: full windows, then the rest, each with its rank among those of its length in its task."""

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        part, seen = TaskContext.get().partitionId(), [0] * (window + 1)
        encoder, end = word_encoder(tokenizer), end_id.to_bytes(4, "little")
        for rows in slices:
            out = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local")}
            for (doc_id, _), ids in zip(rows, encoder.encode([row[1] for row in rows])):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    length = len(piece) // 4
                    for name, value in zip(out, (doc_id, start, length, zlib.crc32(piece), total, part, seen[length])):
                        out[name].append(value)
                    seen[length] += 1
            yield out

    return map_rows(docs.select(F.col(id_column).cast("long"), F.col(text)), work, PIECES)


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row per piece.

    A null or empty text is the end token alone. Rows that repeat an id are packed each. The pieces are written once, so that ranks
    stay what they were when an executor is lost.
    """
    spark = docs.sparkSession
    cut = materialized(pieces(docs, tokenizer, id_column, text, window, end_id))
    counts = materialized(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    # At most ``window`` rows reach the driver, and the plan has a few per length.
    histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = spark.createDataFrame(plan(histogram, window), PLAN)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    inside = (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    nth = F.col("rank") - F.col("rank_from")
    return ranked.alias("r").join(F.broadcast(placed).alias("p"), inside).select(
        "doc_id",
        "start",
        "r.length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("each") * F.col("r.length")).cast("long").alias("offset"),
    )
