"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained with FTRL-proximal.

Features are single words, neighbouring pairs and pairs with one word between them, hashed into ``2**BITS`` places and counted once per text.
FTRL-proximal keeps two sums per place, hence a learning rate for each, and its L1 term leaves most weights exactly zero: the
model that travels to the scoring tasks has the non-zero places only and never more than ``2**BITS`` of them.

Training is online by nature and reads a bounded sample of labelled rows (``max_rows``), the same at every input size; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import map_rows, materialized, release, slices_of
from simloom.llm.words import hash_words, mix

BITS = 20
MAX_ROWS = 20_000
EPOCHS = 5
STRETCH = 1 << 18
THRESHOLD = 0.7
FEATURES = "toxic int, turn long, places binary"
SCORED = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Settings:
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.01


@dataclass
class Weights:
    """Non-zero weights: sorted places and their values, and the bias."""

    places: np.ndarray
    values: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.values
        return out


def held_out(id_column: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _places(words: np.ndarray, owner: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    """Distinct ``text number << BITS | place`` of every gram of a stretch of words, or of those at ``wanted`` places."""
    shift = np.uint64(64 - BITS)
    found = [owner << BITS | (mix(words) >> shift).astype(np.int64)]
    for gap, salt in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        if len(words) > gap:
            same = owner[gap:] == owner[:-gap]
            pairs = mix(words[:-gap][same] * np.uint64(salt) + words[gap:][same])
            found.append(owner[gap:][same] << BITS | (pairs >> shift).astype(np.int64))
    if wanted is not None:  # far fewer are left to sort
        found = [part[wanted[part & ((1 << BITS) - 1)]] for part in found]
    return np.unique(np.concatenate(found))


def gram_places(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, place)`` of every gram of every text, each once, sorted; with ``wanted`` (a flag for each place) of grams at these places only.

    Words are taken ``STRETCH`` at a time, and a stretch begins with the last two words of the one before, so a very long text needs
    memory for its words and its places only.
    """
    words, counts = hash_words(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    out = np.zeros(0, np.int64)
    for k in range(0, len(words), STRETCH):
        part = slice(max(k - 2, 0), k + STRETCH)
        found = _places(words[part], owner[part], wanted)
        out = np.union1d(out, found) if len(out) else found
    return out >> BITS, out & ((1 << BITS) - 1)


class Ftrl:
    """Per-coordinate state of FTRL-proximal; the last place is the bias, which has no penalty."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, free = self.z[at], at == (1 << BITS)
        l1, l2 = np.where(free, 0.0, self.s.l1), np.where(free, 0.0, self.s.l2)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((self.s.beta + np.sqrt(self.n[at])) / self.s.alpha + l2)

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, 1 << BITS)
        w = self.weights(at)
        gradient = sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + gradient * gradient

    def model(self) -> Weights:
        places, values = [], []
        for k in range(0, 1 << BITS, 1 << 16):
            w = self.weights(np.arange(k, min(k + (1 << 16), 1 << BITS)))
            at = np.flatnonzero(w)
            places.append((at + k).astype(np.int32))
            values.append(w[at].astype(np.float32))
        return Weights(np.concatenate(places), np.concatenate(values), float(self.weights(np.array([1 << BITS]))[0]))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS, settings: Settings = Settings()) -> Weights:
    """Weights from at most ``max_rows`` labelled rows outside the held-out part, those with the smallest id hashes.

    Rows without a label or text are left out; an id with several labels has the largest. Of rows that repeat an id and its grams one teaches, and the bound
    holds for rows, however often an id is repeated with other texts. Without any row all weights are zero.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = (
        known.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # At most ``max_rows`` ids and labels are broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id")

    def features(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        for rows in slices:
            owner, place = gram_places([row[1] for row in rows])
            cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
            place = place.astype("<i4")
            yield {
                "toxic": [row[2] for row in rows],
                "turn": [row[0] for row in rows],
                "places": [place[a:b].tobytes() for a, b in zip(cuts, cuts[1:])],
            }

    found = map_rows(texts.select("doc_id", "text", "toxic").where("text IS NOT NULL"), features, FEATURES)
    sample = materialized(found.withColumn("content", F.xxhash64("places")))
    rows = sample.select("turn", "content").distinct().orderBy(F.xxhash64("turn"), "turn", "content").limit(max_rows)
    bounded = sample.join(F.broadcast(rows), ["turn", "content"]).dropDuplicates(["turn", "content"])
    turns = bounded.select("toxic", "turn", "content", "places", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    # One task learns row by row; it holds two sums per place and reads the bounded sample ``epochs`` times.
    ordered = turns.repartition(1).sortWithinPartitions("epoch", F.xxhash64("turn", "epoch"), "turn", "content").select("toxic", "places")

    def learn(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        state = Ftrl(settings)
        for rows in slices:
            for toxic, places in rows:
                state.learn(np.frombuffer(places, "<i4").astype(np.int64), toxic)
        model = state.model()
        yield {"places": [model.places.tobytes()], "weights": [model.values.tobytes()], "bias": [model.bias]}

    found = map_rows(ordered, learn, "places binary, weights binary, bias double").collect()
    if not found:
        return Weights(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    # Bounded by ``2**BITS`` places, a few thousand as a rule.
    return Weights(np.frombuffer(found[0].places, np.int32), np.frombuffer(found[0].weights, np.float32), found[0].bias)


def scores(texts: list[str | None], dense: np.ndarray, bias: float) -> np.ndarray:
    """Probability of each text; every gram counts once however often it occurs."""
    owner, place = gram_places(texts, dense != 0)
    total = np.bincount(owner, dense[place], len(texts))
    return sigmoid(total + bias)


def score(docs: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row. An empty or null text has the score of the bias alone; null and repeated ids are scored each by their text."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        model = shipped.value
        dense = model.dense()
        for rows in slices:
            found = scores([row[2] for row in rows], dense, model.bias)
            yield {
                "doc_id": [row[0] for row in rows],
                "held_out": [row[1] for row in rows],
                "score": found,
                "predicted": (found >= threshold).astype(np.int32),
            }

    return map_rows(docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("h"), "text"), work, SCORED)


def without_toxic(docs: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, all columns as they are."""
    shipped, column = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        model = shipped.value
        dense = model.dense()
        for batch in batches:
            for part in slices_of(batch):
                yield part.filter(pa.array(scores(part.column(column).to_pylist(), dense, model.bias) < threshold))
        release()

    return docs.mapInArrow(run, docs.schema)
