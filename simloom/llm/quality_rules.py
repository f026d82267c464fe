"""Quality rules: plain counts reject what is no running text, and a hashed n-gram log-likelihood ratio judges the rest.

Two multinomials over ``2**BITS`` buckets of hashed words and word pairs are counted: one over all documents, one over trusted documents (those labelled
good). A document's score is the mean of ``log(trusted / raw)`` over its grams, so its length does not matter. Half of the trusted documents teach the trusted
multinomial, the other half sets the threshold: at most ``LOST`` of them score below it. Every document is held against that one threshold; nothing is sampled.

Everything is DataFrame functions. Texts are read once, within their rows, and leave their base counts and a 16-bit code a word, which the later passes read. Gram counts are
summed before they travel, at most ``2**BITS`` rows a task, and a text's grams are summed where they are. The log ratios are whole multiples of ``1 / UNIT``, so sums do not
depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm.shared import text_of
from simloom.plans.runtime import computed_once, materialized

BITS = 16
HALF = 1 << (BITS - 1)  # codes are stored as signed 16-bit numbers
PAIR = 1_000_003
UNIT = 4096
SMOOTHING = 0.5
LOST = 0.01
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # words in repeated windows, in a hundred
# The white space between words, and the symbols that count.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _neighbours(column: str, make) -> Column:
    """``make`` of every element of an array and the one after it."""
    size = F.size(column)
    ends = [F.slice(column, F.lit(start), F.greatest(size - 1, F.lit(0))) for start in (1, 2)]
    return F.when(size > 1, F.zip_with(*ends, make)).otherwise(F.array())


def _worded(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep``, the body, its words and a hash of each word."""
    split = docs.select(*keep, text_of(text).alias("body"))
    words = F.filter(F.split("body", f"{BLANK}+"), lambda w: w != "")
    codes = F.transform("words", lambda w: (F.crc32(w.cast("binary")) % (1 << BITS) - HALF).cast("short"))
    return computed_once(computed_once(split, *keep, "body", words=words), *keep, "body", "words", codes=codes)


def _grams(read: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the buckets of every word and of it with the next word, null behind the last word."""
    following = F.slice("codes", F.lit(2), F.size("codes"))
    each = read.select(*keep, F.explode(F.arrays_zip(F.col("codes").alias("word"), following.alias("next"))).alias("w"))
    word, following = (F.col(f"w.{name}").cast("long") + HALF for name in ("word", "next"))
    return each.select(*keep, word.cast("int").alias("word"), ((word * PAIR + following) % (1 << BITS)).cast("int").alias("pair"))


def _counted(worded: DataFrame, *keep: str) -> DataFrame:
    """Base counts of every row.

    Windows are told apart by 64-bit hashes of their words. Only texts with an equal pair of them sort their windows; the places of windows that occur again
    are then walked in order and every one adds the words that the one before did not hold.
    """
    n = F.size("words")
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array())
    lines = F.filter(F.split("body", "\n"), lambda line: line.rlike(WORD))
    first = computed_once(
        worded, *keep, "codes",
        n_words=n.cast("long"),
        word_chars=F.length(F.concat_ws("", "words")).cast("long"),
        n_symbols=F.regexp_count("body", F.lit(SYMBOL)).cast("long"),
        lines=lines,
        windows=windows,
    )
    sorted_windows = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).otherwise(F.array())
    measures = [*keep, "codes", "n_words", "word_chars", "n_symbols"]
    second = computed_once(first, *measures, n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), found=sorted_windows)
    again = F.flatten(_neighbours("found", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    covered = F.aggregate(
        F.sort_array(F.array_distinct(again)),
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
        lambda seen, i: F.struct((seen["words"] + i + WINDOW - F.greatest(seen["end"], i)).alias("words"), (i + WINDOW).alias("end")),
    )["words"]
    third = computed_once(second, *measures, "n_dup_lines", n_repeat_words=covered.cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return third.withColumn("base_failed", failed)


def _read(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``row, doc_id, codes`` and the columns of ``BASE``, written: rows are told apart by ``row``."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    return materialized(_counted(_worded(slim, "text", "doc_id"), "doc_id").select(F.monotonically_increasing_id().alias("row"), "doc_id", "codes", *BASE))


def base_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the columns of ``BASE`` of every row."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    return _counted(_worded(slim, "text", "doc_id"), "doc_id").select("doc_id", *BASE)


def trusted_ids(labels: DataFrame, aside: bool) -> DataFrame:
    """``(doc_id, trusted)``: one row per id with a label of quality 1, of those that teach or of those kept aside (CRC-32 even or odd)."""
    good = labels.where((F.col("quality") == 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == int(aside)))
    return good.select("doc_id").distinct().withColumn("trusted", F.lit(1))


def log_ratios(read: DataFrame, labels: DataFrame) -> DataFrame:
    """``(bucket, ratio)`` of every bucket that occurs: ``log(trusted / raw)`` in whole units, both smoothed; 0 where no document is trusted."""
    # Always by a sort: the ids grow with the corpus, codes are a third of the text, and adaptive execution splits a hot id.
    known = read.select("doc_id", "codes").join(trusted_ids(labels, aside=False).hint("merge"), "doc_id", "left")
    grams = _grams(known.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), "codes"), "trusted")
    buckets = grams.select("trusted", F.explode(F.array("word", "pair")).alias("bucket")).where("bucket IS NOT NULL")
    counted = materialized(buckets.groupBy("bucket").agg(F.sum("trusted").alias("t"), F.count(F.lit(1)).alias("r")))
    trusted, raw = (counted.agg(F.coalesce(F.sum(name), F.lit(0)).alias("n")).scalar() for name in ("t", "r"))
    share = lambda n, total: (F.col(n) + SMOOTHING) / (total + SMOOTHING * (1 << BITS))
    ratio = F.when(trusted > 0, F.round(F.log(share("t", trusted) / share("r", raw)) * UNIT)).otherwise(0)
    return counted.select("bucket", ratio.cast("long").alias("ratio"))


def scores(read: DataFrame, ratios: DataFrame) -> DataFrame:
    """``(row, score)`` of every row with a word: its mean log ratio in units, rounded down.

    The ratios are broadcast: they are ``2**BITS`` rows at most.
    """
    by = {kind: F.broadcast(ratios.select(F.col("bucket").alias(kind), F.col("ratio").alias(f"{kind}_ratio"))) for kind in ("word", "pair")}
    grams = _grams(read, "row").join(by["word"], "word", "left").join(by["pair"], "pair", "left")
    mean = (F.sum("word_ratio") + F.coalesce(F.sum("pair_ratio"), F.lit(0))) / (F.count(F.lit(1)) + F.count("pair"))
    return grams.groupBy("row").agg(F.floor(mean).alias("score"))


def threshold(judged: DataFrame, labels: DataFrame, lost: float = LOST) -> DataFrame:
    """One row ``threshold``: the largest score that at most ``lost`` of the trusted documents kept aside fall short of; null if there are none.

    Scores are whole units, so only their counts come together, one row for each different score.
    """
    known = judged.where(~F.col("base_failed")).select("doc_id", "score").join(trusted_ids(labels, aside=True), "doc_id")
    counts = materialized(known.groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    below = counts.withColumn("below", F.sum("n").over(Window.orderBy("score")) - F.col("n"))
    return below.where(F.col("below") <= lost * counts.agg(F.sum("n")).scalar()).agg(F.max("score").alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the columns of ``BASE``, ``kept`` and ``score``.

    A row that fails a base rule is not kept; any other is if its score reaches the threshold, and always where no trusted document sets one. A null or empty text has no
    word, no score and fails. Rows that repeat an id are judged each by its text; a null id has no label. Lines and windows count as often as they occur. An empty
    table gives no row. Very long texts are worked on within their row, in time that grows with their length (its logarithm more where windows repeat).
    """
    read = _read(docs, id_column, text)
    judged = materialized(read.drop("codes").join(scores(read, log_ratios(read, labels)), "row", "left"))
    reached = F.col("score") >= F.coalesce(threshold(judged, labels).scalar(), F.lit(-(1 << 62)))
    return judged.select("doc_id", *BASE, (~F.col("base_failed") & reached).alias("kept"), (F.col("score") / UNIT).alias("score"))
