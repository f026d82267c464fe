"""Groups of spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols. Words one edit apart have reduced words at most one edit apart, so the full one-edit neighbourhood of each distinct reduced
word, itself included, is generated and joined with the distinct reduced words. Only then do the words themselves meet, those of two neighbouring reduced words, and each pair is
verified on the original strings. A reduced word is a polynomial over 64-bit integers: neighbours are computed from prefix sums without building strings, and two
reduced words that happened to agree would only add pairs that the verification rejects.

Most neighbours are nobody's reduced word. A bitmap of ``2**MAP_BITS`` bits, of one size at any input, tells so before anything is shuffled; false hits end in the join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.exact_dedup import LOWER, UPPER
from simloom.llm.shared import discard, map_rows, materialized, text_of
from simloom.llm.words import BASE, INVERSE, mix
from simloom.plans.runtime import computed_once, materialized_with

SYMBOLS = 8
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
DAMAGED = 31
MAP_BITS = 24
CELLS = 1 << 17
LETTERS = "A-Za-zÀ-ÿ"
REDUCED = "reduced long, word string, n long"


def observed_words(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, damaged: int = DAMAGED) -> DataFrame:
    """``(word, n)``: how often each word of ``min_length`` code points or more occurs.

    A word is a maximal run of letters, A-Z lower-cased. If ``damaged`` divides the CRC-32 h of ``<id>:<run>``, its code point h modulo its length is left out; 0 leaves all runs
    as they are. A null id counts as an empty one.
    """
    runs = F.regexp_extract_all(text_of(text), F.lit(rf"[{LETTERS}]{{{min_length},}}+"), 0)
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    each = computed_once(docs, name=name, runs=runs).select("name", F.explode("runs").alias("run"))
    run = F.translate("run", UPPER, LOWER)
    if damaged:
        each = computed_once(computed_once(each, "name", run=run), "run", h=F.crc32(F.concat("name", F.lit(":"), "run").cast("binary")))
        hole = (F.col("h") % F.length("run")).cast("int")
        broken = F.concat(F.substring("run", F.lit(1), hole), F.substring("run", hole + 2, F.length("run")))
        run = F.when(F.col("h") % damaged == 0, broken).otherwise(F.col("run"))
    return computed_once(each, word=run).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _symbols(codes: np.ndarray, symbols: int) -> np.ndarray:
    """Symbol 1 .. ``symbols`` of each code point."""
    return (mix(codes.astype(np.uint64)) % np.uint64(symbols)) + np.uint64(1)


def _powers(size: int) -> np.ndarray:
    out = np.full(size, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def reduce_words(words: list[str], symbols: int = SYMBOLS, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, symbol matrix)`` of the words of each length, at most ``cells`` letters or one word at a time."""
    by_length: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        by_length.setdefault(len(word), []).append(k)
    for size, all_rows in by_length.items():
        step = max(cells // max(size, 1), 1)
        for k in range(0, len(all_rows), step):
            rows = all_rows[k : k + step]
            codes = np.frombuffer("".join(words[k] for k in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), size)
            yield np.array(rows), _symbols(codes, symbols)


def keys_of(reduced: np.ndarray) -> np.ndarray:
    """Key of each row of symbols: ``sum(symbol[i] * BASE**i)``."""
    return (reduced * _powers(reduced.shape[1])).sum(axis=1, dtype=np.uint64) if reduced.shape[1] else np.zeros(len(reduced), np.uint64)


def neighbour_keys(reduced: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """Keys of the whole one-edit neighbourhood of each row, one row of keys each, with repeats: the row itself, all deletions, replacements and insertions."""
    rows, size = reduced.shape
    powers, inverse = _powers(size + 2), np.uint64(INVERSE)
    terms = reduced * powers[:size]
    before = np.zeros((rows, size + 1), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    key = before[:, -1:]
    deletions = before[:, :-1] + (key - before[:, 1:]) * inverse
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    replaced = (key - terms)[:, :, None] + powers[:size, None] * every
    opened = before + (key - before) * np.uint64(BASE)
    inserted = opened[:, :, None] + powers[: size + 1, None] * every
    return np.concatenate([key, deletions, replaced.reshape(rows, -1), inserted.reshape(rows, -1)], axis=1)


def _slot(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the slots of all keys. Tasks send what they set in pieces of a page, which are joined by ``or`` before they reach the driver."""
    page = 1 << 15

    def pages(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        own = np.zeros(1 << (MAP_BITS - 3), np.uint8)
        for rows in slices:
            slots = _slot(np.array([row[0] for row in rows], np.int64).view(np.uint64))
            np.bitwise_or.at(own, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
        used = [k for k in range(0, len(own), page) if own[k : k + page].any()]
        yield {"page": used, "bits": [own[k : k + page].tobytes() for k in used]}

    def joined(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        found: dict[int, np.ndarray] = {}
        for rows in slices:
            for k, bits in rows:
                found[k] = found.get(k, np.zeros(page, np.uint8)) | np.frombuffer(bits, np.uint8)
        yield {"page": list(found), "bits": [bits.tobytes() for bits in found.values()]}

    schema = "page long, bits binary"
    parts = map_rows(keys, pages, schema, rows=8192)
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for row in map_rows(parts.repartition("page"), joined, schema).collect():  # at most the bitmap itself, 2 MB
        bits[row.page : row.page + page] |= np.frombuffer(row.bits, np.uint8)
    return bits


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``(word, n, near, near_n)``: every word of ``(word, n)`` with each word exactly one edit away, both ways."""

    def reduce(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        for rows in slices:
            keys = np.zeros(len(rows), np.uint64)
            for at, reduced in reduce_words([row[0] for row in rows], symbols):
                keys[at] = keys_of(reduced)
            yield {"reduced": keys.view(np.int64), "word": [row[0] for row in rows], "n": [row[1] for row in rows]}

    words = materialized(map_rows(vocabulary.select("word", "n"), reduce, REDUCED, rows=4096))
    # One word stands for all that share its reduced word.
    distinct = materialized(words.groupBy("reduced").agg(F.min("word").alias("word")))
    bits = words.sparkSession.sparkContext.broadcast(_bitmap(distinct.select("reduced")))

    def neighbours(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        known = bits.value
        for rows in slices:
            own = np.array([row[0] for row in rows], np.int64)
            froms, tos = [], []
            for at, reduced in reduce_words([row[1] for row in rows], symbols, CELLS):
                keys = neighbour_keys(reduced, symbols)
                slots = _slot(keys)
                row, place = np.nonzero(known[slots >> 3] >> (slots & 7).astype(np.uint8) & 1)
                pairs = np.unique(np.stack([own[at[row]], keys[row, place].view(np.int64)], axis=1), axis=0)
                froms.append(pairs[:, 0])
                tos.append(pairs[:, 1])
            yield {"reduced": np.concatenate(froms), "neighbour": np.concatenate(tos)} if froms else {"reduced": [], "neighbour": []}

    near = map_rows(distinct.select("reduced", "word"), neighbours, "reduced long, neighbour long", rows=512)
    classes = near.join(distinct.select(F.col("reduced").alias("neighbour")), "neighbour")
    other = words.select(F.col("reduced").alias("neighbour"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = words.join(classes, "reduced").join(other, "neighbour")
    return pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def _best(name: str, count: str) -> Column:
    """The largest count, of equals the smallest word in code-point order."""
    return F.min(F.struct((-F.col(count)).alias("minus"), F.col(name).alias("word")))


def spelling_groups(vocabulary: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """One row per word of ``(word, n)``: ``word, form, root, n, n_near, form_n``.

    The form of a word is its near word of the largest count (of equals the smallest in code-point order), if that count is at least ``ratio`` times its own, else null. The
    root is where the forms lead to. Counts grow by ``ratio`` with every step, so forms never turn in a circle, and each round doubles the steps taken. An empty table gives no row.
    """
    vocabulary = materialized(vocabulary)
    near = near_words(vocabulary, symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), _best("near", "near_n").alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    formed = vocabulary.join(near, "word", "left").select(
        "word",
        F.when(enough, F.col("best.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, -F.col("best.minus")).alias("form_n"),
    )
    formed = materialized(formed)
    steps = materialized(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = steps.join(further, "root", "left")
        longer = longer.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().cast("int").alias("moved"))
        written, seen = materialized_with(longer, moved=F.max("moved"))
        discard(steps)
        steps = written.drop("moved")
        if not seen["moved"]:
            break
    return formed.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """:func:`spelling_groups` of the words that occur ``min_count`` times or more.

    Null and empty texts have no word; rows that repeat an id or text count each. Very long texts and words are read whole.
    """
    return spelling_groups(observed_words(docs, id_column, text).where(F.col("n") >= min_count))
