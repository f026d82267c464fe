"""Benchmark decontamination: random walks turn edit distance into agreeing positions, sampled positions pick windows, the edit distance decides.

Words are the alphabet. Windows of an item's size begin wherever enough of the item's unchanged runs agree on it: with similarity s, at most (1 - s) of its n words are edits, so a known number of
its runs of ``anchor_words`` words stand unchanged. This bounds the windows, loses none, and leaves nearly all text untouched.

A CGK walk reads a word at every step and goes on by one word or none, as a hash of step and word says. Item and window walk by the same hash, so after an edit they soon read
the same words again, and a small edit distance becomes a small number of steps at which they differ. One repeat samples steps over all of the walk and takes the windows that read what the
item reads there; the next repeat walks by another hash. How often one repeat finds a window with the most edits allowed, of the worst kind in the worst place, was measured by item
length (``WALK_RECALL``), and gives the number of repeats for a target recall. Windows found are verified by edit distance, and the best of all windows around them is reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import map_rows, slices_of
from simloom.llm.words import hash_words, mix, shingle_hashes

SIMILARITY = 0.8
TARGET_RECALL = 0.99
# Share of single repeats that find an item of up to so many words with the most edits allowed: lower than measured for deletions, insertions or
# replacements only, in the first half, the second half or all of the item (0.53 to 30 words, 0.31 to 150, 0.29 to 400, 0.03 at 800 and 1000).
REPEAT_RECALL = 0.2
WALK_RECALL = ((40, 0.35), (200, 0.2), (500, 0.15), (math.inf, 0.025))
SAMPLED = 1
WALK_STEPS = 1.9  # steps a word: two steps read a word on average
CHUNK_PAIRS = 1_000_000
BLOCK_WORDS = 2_000_000
FILTER_BITS = 22
FOUND = "doc_id long, contaminated boolean, item_ids array<long>, similarities array<double>, starts array<long>, lengths array<long>"


def repeats_for(recall: float = TARGET_RECALL, single: float = REPEAT_RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - single))


def edits_allowed(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def anchor_words(n: int, similarity: float) -> int:
    """Length of a run of words that survives unchanged in one place at least, at most three."""
    e = edits_allowed(n, similarity)
    return min(3, -(-(n - e) // (e + 1)))


def walk(words: np.ndarray, starts: np.ndarray, limits: np.ndarray, steps: np.ndarray, seed: int) -> np.ndarray:
    """Outputs of the CGK walk at the given steps (ascending) from every start, one row each; beyond ``limits`` it reads zeros."""
    at, out, wanted = starts.copy(), np.zeros((len(starts), len(steps)), np.uint64), {int(t): k for k, t in enumerate(steps)}
    for t in range(int(steps[-1]) + 1):
        word = np.where(at < limits, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        if t in wanted:
            out[:, wanted[t]] = word
        move = mix(word ^ np.uint64((seed * 0x9E3779B97F4A7C15 + t * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(63)
        at += move.astype(np.int64)
    return out


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """``(edits, start, end)`` of the stretch of ``text`` closest to ``item`` in edit distance."""

    def ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        place = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64)
        for k, word in enumerate(a):
            new = row + 1
            new[1:] = np.minimum(new[1:], row[:-1] + (b != word))
            new[0] = k + 1
            row = np.minimum.accumulate(new - place) + place
        return row

    row = ends(item, text)
    end = int(row.argmin())
    back = ends(item[::-1], text[:end][::-1])
    return int(row[end]), end - int(back.argmin()), end


@dataclass
class Items:
    """A block of benchmark items in the form that tasks use."""

    ids: list
    words: list[np.ndarray]
    similarity: float
    repeats: int
    anchors: dict[int, tuple] = field(default_factory=dict)

    def __post_init__(self):
        by_size: dict[int, list] = {}
        for k, words in enumerate(self.words):
            size = anchor_words(len(words), self.similarity)
            grams = shingle_hashes(words, size)
            by_size.setdefault(size, []).append((grams, np.full(len(grams), k), np.arange(len(grams))))
        for size, parts in by_size.items():
            grams, item, offset = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(grams, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.anchors[size] = (seen, grams[order], item[order], offset[order])

    @cached_property
    def signatures(self) -> "_Signatures":
        """Of every item the signature in every repeat, made where it is first asked for."""
        return _Signatures(self)

    def repeats_of(self, k: int) -> int:
        """Repeats for an item, from those for the recall of a single repeat of ``REPEAT_RECALL``."""
        single = next(share for longest, share in WALK_RECALL if len(self.words[k]) <= longest)
        return math.ceil(self.repeats * math.log(1 - REPEAT_RECALL) / math.log(1 - single))

    @staticmethod
    def signature(words: np.ndarray, starts: np.ndarray, limits: np.ndarray, n: int, repeat: int) -> np.ndarray:
        """Sampled outputs of the walk from every start, for an item of ``n`` words; past ``limits`` a walk reads padding."""
        span = max(1, int(WALK_STEPS * n))
        sampled = np.sort(np.random.default_rng([repeat, n]).choice(span, min(SAMPLED, span), replace=False))
        out = np.zeros(len(starts), np.uint64)
        for column in walk(words, starts, limits, sampled, repeat).T:
            out = mix(out + column)
        return out

    def anchored(self, words: np.ndarray, cuts: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """:meth:`_anchored` of all texts, so many texts at a time, and of one text so many items at a time, that about ``CHUNK_PAIRS`` places of runs are held at once."""
        load = np.zeros(len(words) + 1, np.int64)
        for size, (seen, grams, _, _) in self.anchors.items():
            own = shingle_hashes(words, size)
            at = np.flatnonzero(seen[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            load[at + 1] += np.searchsorted(grams, own[at], "right") - np.searchsorted(grams, own[at], "left")
        load = np.cumsum(load)
        found: dict[tuple[int, int], np.ndarray] = {}
        first = 0
        while first < len(cuts) - 1:
            fits = int(np.searchsorted(load[cuts], load[cuts[first]] + CHUNK_PAIRS, "right")) - 1
            last = max(first + 1, min(fits, len(cuts) - 1))
            part, own_cuts = words[cuts[first] : cuts[last]], cuts[first : last + 1] - cuts[first]
            slices = -(-int(load[cuts[last]] - load[cuts[first]]) // CHUNK_PAIRS) or 1
            bounds = np.linspace(0, len(self.ids), min(slices, len(self.ids)) + 1).astype(np.int64) if self.ids else [0, 0]
            for low, high in zip(bounds, bounds[1:]):
                found.update(((k + first, i), places) for (k, i), places in self._anchored(part, own_cuts, low, high).items())
            first = last
        return found

    def _anchored(self, words: np.ndarray, cuts: np.ndarray, from_item: int, to_item: int) -> dict[tuple[int, int], np.ndarray]:
        """For texts ``words[cuts[k]:cuts[k + 1]]`` and items, the places (in its text) where a window may begin that is similar enough.

        Of an item's runs of ``size`` words, an edit changes ``size`` at most. So enough of them stand unchanged in the text, and each says where
        the item begins to within its number of edits: only places on which that many runs agree are kept.
        """
        texts, items, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        needed, edits = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        for size, (seen, grams, item, offset) in self.anchors.items():
            own = shingle_hashes(words, size)
            at = np.flatnonzero(seen[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            low, high = np.searchsorted(grams, own[at], "left"), np.searchsorted(grams, own[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            if from_item > 0 or to_item < len(self.ids):  # runs of equal grams are in the order of items
                run = np.cumsum(np.concatenate([[0], grams[1:] != grams[:-1]])) * len(self.ids)
                low, high = np.searchsorted(run + item, run[low] + from_item), np.searchsorted(run + item, run[low] + to_item)
            count = high - low
            first = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = np.repeat(at, count)
            text = np.searchsorted(cuts, place, "right") - 1
            whole = place + size <= cuts[text + 1]
            texts.append(text[whole])
            items.append(item[first][whole])
            starts.append((place - offset[first] - cuts[text])[whole])
            for k in np.unique(item).tolist():
                n = len(self.words[k])
                edits[k] = edits_allowed(n, self.similarity)
                needed[k] = max(1, n - size + 1 - size * edits[k])
        text, item, start = (np.concatenate(x) for x in (texts, items, starts))
        order = np.lexsort((start, item, text))
        text, item, start = text[order], item[order], start[order]
        here = np.arange(len(text))
        last = here + needed[item] - 1
        end = np.minimum(last, len(text) - 1)
        agree = (last < len(text)) & (text[end] == text) & (item[end] == item) & (start[end] - start <= 2 * edits[item])
        marks = np.zeros(len(text) + 1, np.int64)
        np.add.at(marks, here[agree], 1)
        np.add.at(marks, last[agree] + 1, -1)
        kept = np.cumsum(marks[:-1]) > 0
        out: dict[tuple[int, int], list[int]] = {}
        for key in zip(text[kept].tolist(), item[kept].tolist(), start[kept].tolist()):
            out.setdefault(key[:2], []).append(key[2])
        found = {}
        for (k, i), places in out.items():
            spread = np.arange(-edits[i], edits[i] + 1)
            around = np.unique(np.add.outer(np.unique(places), spread))
            found[k, i] = around[(around >= 0) & (around < cuts[k + 1] - cuts[k])]
        return found

    def begins(self, words: np.ndarray) -> dict[int, np.ndarray]:
        return {i: places for (_, i), places in self.anchored(words, np.array([0, len(words)])).items()}

    def search_all(self, words: np.ndarray, cuts: np.ndarray) -> dict[int, list[tuple[int, float, int, int]]]:
        """For every text with a hit ``(item, similarity, first word, words)`` of each item's best occurrence."""
        best: dict[tuple[int, int], tuple] = {}
        for k, i, hit in self._walked(words, cuts):
            if (k, i) not in best or hit[1] > best[k, i][1]:
                best[k, i] = hit
        out: dict[int, list] = {}
        for (k, _), hit in sorted(best.items()):
            out.setdefault(k, []).append(hit)
        return out

    def _walked(self, words: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, tuple]]:
        """Verified occurrences. Neighbouring windows are a region; each repeat walks the windows of all regions without an occurrence yet, those of items of one length together."""
        regions = []
        for (k, i), starts in self.anchored(words, cuts).items():
            regions += [_Region(k, i, part) for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(part)]
        repeat = 0
        while regions:
            by_size: dict[int, list[_Region]] = {}
            for region in regions:
                by_size.setdefault(len(self.words[region.item]), []).append(region)
            for n, same in by_size.items():
                sizes = [len(region.starts) for region in same]
                starts = np.concatenate([region.starts + cuts[region.text] for region in same])
                limits = np.repeat([cuts[region.text + 1] for region in same], sizes)
                wanted = np.repeat([self.signatures[region.item][repeat] for region in same], sizes)
                equal = np.split(self.signature(words, starts, limits, n, repeat) == wanted, np.cumsum(sizes)[:-1])
                for region, picked in zip(same, equal):
                    own = words[cuts[region.text] : cuts[region.text + 1]]
                    fresh = region.starts[picked & ~region.seen]
                    region.seen |= picked
                    if len(fresh) and self._occurrence(own, region.item, fresh):
                        region.closed = True
                        yield region.text, region.item, self._occurrence(own, region.item, region.starts)
            repeat += 1
            regions = [region for region in regions if not region.closed and repeat < self.repeats_of(region.item)]

    def search_exactly(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """What :meth:`search` finds if no window is left out: the yardstick of its recall."""
        hits = (self._occurrence(words, i, starts) for i, starts in sorted(self.begins(words).items()))
        return [hit for hit in hits if hit]

    def search(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        return self.search_all(words, np.array([0, len(words)])).get(0, [])

    def _occurrence(self, words: np.ndarray, k: int, starts: np.ndarray) -> tuple[int, float, int, int] | None:
        item = self.words[k]
        best, e, done = None, edits_allowed(len(item), self.similarity), -1
        for start in starts.tolist():
            if start <= done:
                continue
            low, done = max(0, start - e), start + e  # one look covers the windows that begin up to here
            edits, a, b = best_match(item, words[low : done + len(item) + e])
            if edits <= e and (best is None or edits < best[0]):
                best = edits, low + a, b - a
        return (k, 1 - best[0] / len(item), best[1], best[2]) if best else None


@dataclass
class _Region:
    """Neighbouring windows of a text that may hold an item, and those picked so far."""

    text: int
    item: int
    starts: np.ndarray
    closed: bool = False

    def __post_init__(self):
        self.seen = np.zeros(len(self.starts), bool)


class _Signatures:
    """Signatures by item and repeat."""

    def __init__(self, items: Items):
        self.items, self.known = items, {}

    def __getitem__(self, k: int) -> "_ItemSignatures":
        return self.known.setdefault(k, _ItemSignatures(self.items.words[k]))


class _ItemSignatures:
    def __init__(self, words: np.ndarray):
        self.words, self.known = words, {}

    def __getitem__(self, repeat: int) -> np.uint64:
        if repeat not in self.known:
            n = len(self.words)
            self.known[repeat] = Items.signature(self.words, np.array([0]), np.array([n]), n, repeat)[0]
        return self.known[repeat]


def item_blocks(benchmark: DataFrame, similarity: float, recall: float) -> Iterator[Items]:
    """Items in blocks of at most ``BLOCK_WORDS`` words (a longer item alone), so that what is broadcast is bounded however long the benchmark is."""
    ids, words, total = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    for row in rows.toLocalIterator():
        own = hash_words([row.text])[0]
        if not len(own):
            continue
        if ids and total + len(own) > BLOCK_WORDS:
            yield Items(ids, words, similarity, repeats_for(recall))
            ids, words, total = [], [], 0
        ids.append(row.item_id)
        words.append(own)
        total += len(own)
    if ids:
        yield Items(ids, words, similarity, repeats_for(recall))


def _search(docs: DataFrame, items: Items, id_column: str, text: str) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(items)

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        own = shipped.value
        for rows in slices:
            out = {name.split()[0]: [] for name in FOUND.split(", ")}
            words, counts = hash_words([row[1] for row in rows])
            cuts = np.concatenate([[0], np.cumsum(counts)])
            found = own.search_all(words, cuts)
            for k, row in enumerate(rows):
                hits = found.get(k, [])
                columns = [[own.ids[hit[0]] for hit in hits], *[[hit[c] for hit in hits] for c in (1, 2, 3)]]
                for column, value in zip(out.values(), (row[0], bool(hits), *columns)):
                    column.append(value)
            yield out

    return map_rows(docs.select(F.col(id_column).cast("long"), F.col(text)), work, FOUND)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = TARGET_RECALL
) -> DataFrame:
    """One row per document and block of items: ``doc_id, contaminated, item_ids, similarities, starts, lengths`` (places in words).

    An item within the edits allowed is found with at least the given ``recall``, an unchanged one all but surely. Of equally near occurrences the first in its text is reported; rows
    that repeat an id are searched each. A null or empty document has no leak; items without words are left out. A benchmark of one block, the usual case, gives one row per document.
    """
    found = [_search(docs, items, id_column, text) for items in item_blocks(benchmark, similarity, recall)]
    if not found:
        found = [_search(docs, Items([], [], similarity, 0), id_column, text)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more.where("contaminated"))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = TARGET_RECALL) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are; text is read in place, nothing is shuffled."""
    column = docs.columns.index("text")
    out = docs
    for items in item_blocks(benchmark, similarity, recall):
        shipped = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shipped=shipped):
            import pyarrow as pa

            own = shipped.value
            for batch in batches:
                for part in slices_of(batch):
                    words, counts = hash_words(part.column(column).to_pylist())
                    cuts = np.concatenate([[0], np.cumsum(counts)])
                    found = own.search_all(words, cuts)
                    yield part.filter(pa.array([k not in found for k in range(part.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
