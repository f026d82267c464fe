import random
import zlib

import numpy as np

from llm.helpers import awkward, rows_of
from simloom.llm import toxicity
from simloom.llm.shared import map_rows
from simloom.llm.toxicity import BITS, Ftrl, Settings, Weights, gram_places, score, scores, train, without_toxic

PLAIN, BAD = ["apple", "river", "stone", "cloud", "paper", "green"], ["vile", "rotten"]


def corpus(n, seed=4):
    rnd = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        toxic = int(rnd.random() < 0.3)
        words = [rnd.choice(PLAIN) for _ in range(rnd.randint(5, 60))]
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(BAD)
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    return rows, labels


def test_grams_are_words_pairs_and_skips():
    owner, place = gram_places(["a b c", None, "", "A, b"])
    by_text = {k: set(place[owner == k].tolist()) for k in range(4)}
    assert [len(by_text[k]) for k in range(4)] == [6, 0, 0, 3] and by_text[3] < by_text[0]


def test_update_follows_the_formula():
    """One coordinate by hand: z and n after each row, and the weight they give."""
    own, s = Ftrl(Settings(alpha=0.5, beta=1.0, l1=0.1, l2=0.2)), Settings(alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z = n = bz = bn = 0.0
    weight = lambda z, n, l1, l2: 0.0 if abs(z) <= l1 else -(z - np.sign(z) * l1) / ((s.beta + n**0.5) / s.alpha + l2)
    for label in (1, 0, 1, 1):
        w, b = weight(z, n, s.l1, s.l2), weight(bz, bn, 0, 0)
        g = 1 / (1 + np.exp(-(w + b))) - label
        z += g - ((n + g * g) ** 0.5 - n**0.5) / s.alpha * w
        bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / s.alpha * b
        n, bn = n + g * g, bn + g * g
        own.learn(np.array([7]), label)
    assert np.isclose(own.z[7], z) and np.isclose(own.n[7], n) and np.isclose(own.z[1 << BITS], bz)
    assert np.count_nonzero(own.z) == 2


def test_held_out_accuracy_and_sparsity(spark):
    rows, labels = corpus(1500)
    docs = awkward(spark, rows)
    weights = train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert 0 < len(weights.places) < 500
    truth = dict(labels)
    found = score(docs, weights).collect()
    assert len(found) == len(rows)
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert held and all(r.held_out for r in held) and sum(r.held_out for r in found) == len(held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in found)
    left = {r[0] for r in rows_of(without_toxic(docs, weights), "doc_id")}
    assert left == {r.doc_id for r in found if not r.predicted}
    assert without_toxic(docs, weights).columns == docs.columns


def test_held_out_labels_are_never_used(spark):
    rows, labels = corpus(300)
    flipped = [(k, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t) for k, t in labels]
    schema = "doc_id long, toxic int"
    a, b = (train(awkward(spark, rows), spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert np.array_equal(a.places, b.places) and np.array_equal(a.values, b.values) and a.bias == b.bias


def test_sample_is_bounded(spark, monkeypatch):
    rows, labels = corpus(200)
    seen = []
    original = toxicity.materialized
    monkeypatch.setattr(toxicity, "materialized", lambda df: seen.append(original(df)) or seen[-1])
    train(awkward(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), max_rows=50)
    assert seen[0].count() == 50


def test_awkward_rows(spark):
    rows = [(1, None), (None, "vile"), (2, ""), (3, "stone " * 50_000), (3, "stone " * 50_000)]
    nothing = train(awkward(spark, rows), spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert len(nothing.places) == 0 and nothing.bias == 0
    found = rows_of(score(awkward(spark, rows), nothing), "doc_id", "score", "predicted")
    assert found == [(None, 0.5, 0), (1, 0.5, 0), (2, 0.5, 0), (3, 0.5, 0), (3, 0.5, 0)]
    assert score(awkward(spark, []), nothing).collect() == []


def test_a_gram_counts_once():
    _, place = gram_places(["vile"])
    weights = Weights(place.astype(np.int32), np.ones(1, np.float32), -1.0)
    once, often = scores(["vile", "vile vile vile"], weights.dense(), weights.bias)
    assert once == often


def test_bound_holds_for_rows_that_repeat_an_id(spark, monkeypatch):
    rows, labels = corpus(40)
    rows += [(1, f"apple river number{k % 60}") for k in range(240)]
    learned = []
    original = Ftrl.learn
    monkeypatch.setattr(toxicity, "map_rows", lambda df, work, schema, **more: learned.append(df) or map_rows(df, work, schema, **more))
    train(awkward(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), max_rows=50, epochs=2)
    assert original is Ftrl.learn and learned[-1].count() == 2 * 50


def test_long_texts_by_stretches(monkeypatch):
    text = " ".join(random.Random(1).choice(PLAIN + BAD) for _ in range(1000))
    whole = [x.tolist() for x in gram_places([text, "vile cloud", text[:50]])]
    monkeypatch.setattr(toxicity, "STRETCH", 64)
    assert [x.tolist() for x in gram_places([text, "vile cloud", text[:50]])] == whole


def test_memory_of_a_task(monkeypatch):
    import tracemalloc

    from simloom.llm import words

    def peak(work):
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    monkeypatch.setattr(words, "_powers", {})
    text = "word and other " * 70_000  # about a megabyte, as much as a slice has
    assert peak(lambda: words.hash_words([text])) < 40 << 20
    state = Ftrl(Settings())
    state.learn(np.arange(0, 1 << BITS, 5000), 1)
    assert peak(state.model) < 20 << 20
