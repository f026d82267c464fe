"""Near-duplicates by Order MinHash, verified by banded alignment.

The k-mers of a text are its shingles of five words, each labelled with its occurrence number, so that repeats stay apart. A sketch entry takes the
``PICKS`` labelled shingles with the smallest values of one hash function and keeps them in text order: two texts share an entry if they share these shingles
and their order, which follows edit similarity rather than set overlap. Texts that share an entry are candidates.

Similarity is the number of labelled shingles that an alignment within a band matches in order, over the number in either text; a band of a ninth of
both lengths cannot miss a similarity of 0.8. Texts of equal words are one node from the start. In a bucket all members meet one centre first; only members that end
in different classes are compared further, and not where their set distances to the centre (a metric) differ too much, or where either shares too few
shingles with anyone. So copies never become all pairs, and no link between different classes is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import discard, map_rows, materialized
from simloom.llm.words import hash_words, mix, shingle_hashes
from simloom.operators.graph import connected_components

SHINGLE = 5
SIMILARITY = 0.8
ENTRIES = 12
PICKS = 3
BITMAP = 4096
NULL_ID = -(1 << 63)
SEEDS = mix(np.arange(1, ENTRIES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Mix every shingle hash with the number of its earlier occurrences."""
    order = np.argsort(shingles, kind="stable")
    sorted_ = shingles[order]
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    number = np.empty(len(shingles), np.uint64)
    number[order] = np.arange(len(shingles)) - np.repeat(starts, np.diff(np.append(starts, len(shingles))))
    return mix(shingles + number * np.uint64(0xC2B2AE3D27D4EB4F))


def shingles_of(words: np.ndarray) -> np.ndarray:
    """Labelled shingles of a text; a text of fewer words is one shingle."""
    return labelled(shingle_hashes(words, min(SHINGLE, max(len(words), 1))))


def sketch(marks: np.ndarray) -> np.ndarray:
    """The entries of one text: hash of the smallest ``PICKS`` shingles in text order, for each hash function."""
    picks = min(PICKS, len(marks))
    chosen = np.empty((ENTRIES, picks), np.uint64)
    for k, seed in enumerate(SEEDS):
        at = np.argpartition(mix(marks ^ seed), picks - 1)[:picks] if picks < len(marks) else np.arange(picks)
        chosen[k] = marks[np.sort(at)]
    out = np.zeros(ENTRIES, np.uint64)
    for column in chosen.T:
        out = out * np.uint64(0x100000001B3) + column
    return mix(out)


def _text_key(text: str | None, words: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the word sequence, or for the text itself if it has no word."""
    import xxhash

    raw = words.tobytes() if len(words) else (text or "").encode("utf-8", "surrogatepass") + b"\0"
    both = xxhash.xxh3_128_intdigest(raw)
    return (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)


def _row_key(text: Column) -> list[Column]:
    """128 bits that stand for a text as it is; together with the id they tell rows apart that repeat an id or have none."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _each(rows: list[tuple]) -> Iterator[tuple[tuple, np.ndarray, tuple[int, int]]]:
    words, counts = hash_words([row[1] for row in rows])
    cuts = np.concatenate([[0], np.cumsum(counts)])
    for row, a, b in zip(rows, cuts, cuts[1:]):
        yield row, words[a:b], _text_key(row[1], words[a:b])


def aligned_similarity(first: np.ndarray, second: np.ndarray, threshold: float = SIMILARITY) -> tuple[float, float]:
    """``(alignment similarity, set similarity)`` of two sequences of labelled shingles.

    The alignment matches equal shingles in order (longest increasing run of places) inside a band: with similarity s, at most ``(1 - s) / (1 + s)`` of both lengths is unmatched.
    """
    if len(first) > len(second):
        first, second = second, first
    order = np.argsort(second)
    at = np.searchsorted(second[order], first)
    at = order[np.minimum(at, len(second) - 1)]
    match = second[at] == first
    common, total = int(match.sum()), len(first) + len(second)
    loose = common / (total - common)
    if loose < threshold:
        return 0.0, loose
    here, there = np.flatnonzero(match), at[match]
    inside = np.abs(here - there) <= total * (1 - threshold) / (1 + threshold) + 1
    there = there[inside]
    if np.all(there[1:] > there[:-1]):
        kept = len(there)
    else:
        tails: list[int] = []
        for place in there.tolist():
            k = bisect_left(tails, place)
            tails[k : k + 1] = [place]
        kept = len(tails)
    return kept / (total - kept), loose


def _sketches(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    columns = [f"e{k}" for k in range(ENTRIES)]

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        for rows in slices:
            out = {name: [] for name in ("id", "t1", "t2", "k1", "k2")}
            entries = np.zeros((len(rows), ENTRIES), np.int64)
            for k, (row, words, key) in enumerate(_each(rows)):
                for name, value in zip(out, (row[0], *row[2:], *key)):
                    out[name].append(value)
                if len(words):
                    entries[k] = sketch(shingles_of(words)).view(np.int64)
            yield out | {name: entries[:, k] for k, name in enumerate(columns)}

    schema = "id long, t1 long, t2 long, k1 long, k2 long, " + ", ".join(f"{name} long" for name in columns)
    return map_rows(docs.select(F.col(id_column).cast("long"), F.col(text), *_row_key(F.col(text))), work, schema)


def _sequences(docs: DataFrame, wanted: DataFrame, id_column: str, text: str) -> DataFrame:
    """``(node, sequence)`` of the wanted nodes: word hashes of one text for each."""

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        for rows in slices:
            out = {name: [] for name in ("id", "k1", "k2", "sequence")}
            for row, words, key in _each(rows):
                for name, value in zip(out, (row[0], *key, words.astype("<u4").tobytes())):
                    out[name].append(value)
            yield out

    read = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)), F.col(text))
    # The id among the keys keeps a text with very many copies from meeting in one task.
    found = map_rows(read, work, "id long, k1 long, k2 long, sequence binary").join(wanted, ["k1", "k2", "id"])
    return found.dropDuplicates(["node"]).select("node", "sequence")


def _verified(pairs: DataFrame, sequences: DataFrame, threshold: float) -> DataFrame:
    """``(u, v, similarity, distance)``; the distance is that of the sets."""
    side = lambda name: sequences.select(F.col("node").alias(name), F.col("sequence").alias(f"s{name}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "su", "sv")

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        known: dict[int, np.ndarray] = {}

        def marks(node: int, raw: bytes) -> np.ndarray:
            if node not in known:
                if len(known) > 64:
                    known.clear()
                known[node] = shingles_of(np.frombuffer(raw, "<u4").astype(np.uint64))
            return known[node]

        for rows in slices:
            found = [aligned_similarity(marks(u, a), marks(v, b), threshold) for u, v, a, b in rows]
            yield {
                "u": [row[0] for row in rows],
                "v": [row[1] for row in rows],
                "similarity": [a for a, _ in found],
                "distance": [1 - b for _, b in found],
            }

    return map_rows(both, work, "u long, v long, similarity double, distance double")


def _mixed(placed: DataFrame) -> DataFrame:
    """The members of buckets whose members are of more than one class."""
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return placed.join(mixed.select("bucket"), "bucket", "left_semi")


def _shared_counts(texts: DataFrame) -> DataFrame:
    """``(node, own, shared, bits)``: labelled shingles of each text, those among them that another of these texts has too, and a bitmap.

    Two texts cannot have more in common than either shares with anyone, and a bit that one sets and the other does not is a
    shingle they do not share. Both bound the similarity from above without a comparison.
    """

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        for rows in slices:
            own = [shingles_of(np.frombuffer(row[1], "<u4").astype(np.uint64)) for row in rows]
            yield {"node": [row[0] for row in rows], "marks": [marks.view(np.int64) for marks in own], "bits": [_bitmap(marks) for marks in own]}

    marks = materialized(map_rows(texts.select("node", "sequence"), work, "node long, marks array<long>, bits array<long>"))
    each = marks.select("node", F.explode("marks").alias("mark"))
    # Written, so that the join is a plain one and a shingle of very many texts can be split.
    common = materialized(each.groupBy("mark").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("mark"))
    shared = each.join(common, "mark").groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    return marks.select("node", F.size("marks").alias("own"), "bits").join(shared, "node")


def _bitmap(marks: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP, bool)
    bits[(marks % np.uint64(BITMAP)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def _missing(one: str, other: str) -> Column:
    """Bits that one bitmap sets and the other does not: no more than the shingles of the one text that the other lacks."""
    lone = F.zip_with(one, other, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b))))
    return F.aggregate(lone, F.lit(0), lambda total, n: total + n)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per input row: ``doc_id, class_id, class_size, kept``.

    ``class_id`` is the smallest id of the class, null only if all are; ``kept`` marks the row with that id, and one text of it if the class has several under that id. Texts
    without words are in a class with identical texts only; rows that repeat an id with the same text share a decision. Classes are the connected parts of the links of at least ``threshold``.
    """
    return _decisions(docs, id_column, text, threshold).select("doc_id", "class_id", "class_size", "kept")


def _decisions(docs: DataFrame, id_column: str, text: str, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of :func:`near_duplicates` with the key ``t1, t2`` of their text."""
    if threshold < SIMILARITY:
        raise ValueError("the sketch finds links of a similarity of 0.8 and more")
    names = [f"e{k}" for k in range(ENTRIES)]
    rows = materialized(_sketches(docs, id_column, text))
    nodes = materialized(
        rows.groupBy("k1", "k2")
        .agg(F.min(F.coalesce("id", F.lit(NULL_ID))).alias("id"), *[F.max(name).alias(name) for name in names])
        .withColumn("node", F.monotonically_increasing_id())
    )
    entries = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col(name)) for k, name in enumerate(names)]))
    members = nodes.where(" or ".join(f"{name} <> 0" for name in names)).select("node", entries.alias("bucket"))
    # The centre of a bucket is its member whose own buckets hold the most texts: one that others have been edited from, if there is any.
    members = materialized(members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket"))
    typical = members.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = materialized(members.select("bucket", "node").join(typical, "node"))
    heads = ranked.groupBy("bucket").agg(F.max(F.struct("weight", F.xxhash64("node").alias("order"), "node"))["node"].alias("u"))
    shared = materialized(ranked.join(heads, "bucket").select("bucket", "u", F.col("node").alias("v")))
    spokes = shared.where("u <> v").select("u", "v").distinct()
    pairs = materialized(spokes)
    wanted = shared.select(F.col("v").alias("node")).distinct().join(nodes.select("node", "k1", "k2", "id"), "node")
    sequences = materialized(_sequences(docs, wanted, id_column, text))
    first = materialized(_verified(pairs, sequences, threshold))
    links = first.where(F.col("similarity") >= threshold).select(F.col("u").alias("i"), F.col("v").alias("j"))
    touched = materialized(shared.select(F.col("v").alias("node_id")).distinct())
    classes = materialized(connected_components(touched, links))

    # Members of one bucket in different classes, unless their distances to the centre or their counts of shared shingles tell them apart.
    placed = shared.join(first.select("u", "v", "distance"), ["u", "v"], "left").select(
        "bucket", F.col("v").alias("node"), F.coalesce("distance", F.lit(0.0)).alias("distance"), (F.col("u") == F.col("v")).alias("centre")
    )
    placed = placed.join(classes.withColumnRenamed("node_id", "node"), "node")
    open_ = materialized(_mixed(placed).where("not centre"))
    counted = materialized(_shared_counts(open_.select("node").distinct().join(sequences, "node")))
    # Some partner can be left only for a text that shares a share of ``threshold`` of its own shingles.
    able = materialized(_mixed(open_.join(counted.where(F.col("shared") >= threshold * F.col("own")), "node")))
    side = lambda name: able.select("bucket", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "distance", "component", "own", "shared", "bits")])
    common = F.least(F.col("own_u") - _missing("bits_u", "bits_v"), F.col("own_v") - _missing("bits_v", "bits_u"))
    least = threshold / (1 + threshold) * (F.col("own_u") + F.col("own_v"))
    rest = (
        side("u").join(side("v"), "bucket")
        .where(
            (F.col("component_u") < F.col("component_v"))
            & (F.abs(F.col("distance_u") - F.col("distance_v")) <= 1 - threshold + 1e-9)
            & (F.least("shared_u", "shared_v") >= least - 1e-9)
            & (common >= least - 1e-9)
        )
        .select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct()
    )
    second = materialized(_verified(rest, sequences, threshold).where(F.col("similarity") >= threshold))
    if second.take(1):
        more = second.select(F.col("u").alias("i"), F.col("v").alias("j"))
        classes = materialized(connected_components(touched, links.unionByName(more)))
    for scratch in (members, ranked, shared, pairs, sequences, open_, able):
        discard(scratch)

    named = nodes.select("node", "k1", "k2").join(classes.withColumnRenamed("node_id", "node"), "node", "left")
    keyed = rows.select("id", "t1", "t2", "k1", "k2").join(named.select("k1", "k2", F.coalesce("component", "node").alias("part")), ["k1", "k2"])
    keyed = materialized(keyed.select("id", "t1", "t2", "part"))
    # Written, so that the join is a plain one and a class of very many texts can be split.
    sizes = keyed.groupBy("part").agg(F.min(F.struct(F.col("id").isNull(), "id", "t1", "t2")).alias("first"), F.count(F.lit(1)).alias("class_size"))
    sizes = materialized(sizes.select("part", "class_size", F.col("first.id").alias("class_id"), F.col("first.t1").alias("c1"), F.col("first.t2").alias("c2")))
    kept = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2"))
    return keyed.join(sizes, "part").select(F.col("id").alias("doc_id"), "t1", "t2", "class_id", "class_size", kept.alias("kept"))


def without_near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of every class, with all columns. Ids may be null or repeated."""
    decided = materialized(_decisions(docs, id_column, text).select(F.col("doc_id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "kept"))
    t1, t2 = _row_key(docs[text])
    same = docs[id_column].cast("long").eqNullSafe(F.col("__id")) & (t1 == F.col("__t1")) & (t2 == F.col("__t2"))
    stay = docs.join(decided.where("not kept").drop("kept"), same, "left_anti")
    if decided.where("kept").groupBy("__id", "__t1", "__t2").count().where("count > 1").isEmpty():
        return stay
    # Rows that repeat an id with the same text share a decision: one of them stays. Exact deduplication leaves none.
    t1, t2 = _row_key(F.col(text))
    keyed = stay.withColumns({"__id": F.col(id_column).cast("long"), "__t1": t1, "__t2": t2})
    return keyed.dropDuplicates(["__id", "__t1", "__t2"]).drop("__id", "__t1", "__t2")
