"""Alignment of two tokenizers over a corpus, with pair counts behind a minimal perfect hash.

Both token sequences of a text cover the same bytes. Offsets where a token of either ends cut them into groups, and the two tokens that end there are linked. Of two
linked tokens one is an end of the other, so there are at most as many different pairs as both vocabularies have bytes (half a million): whatever is kept by pair is
bounded by the vocabularies, not by the corpus.

The first pass aligns all documents; each task keeps its own pair counts. A minimal perfect hash over the distinct pairs gives each a place in a dense vector. The
tasks' counts become dense vectors, which are summed as a tree, ``FAN`` at a time and in slices. The second pass aligns again and looks the counts up; the pairs
themselves are stored by place too, so a pair that was never counted is told apart and not mistaken for another.

Both tokenizers work on a word and the blanks before it by itself, which is why a word is aligned once, many at a time. Texts with other white space are aligned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import map_rows, materialized
from simloom.llm.words import mix

SHIFT = 16
FAN = 16
SLICE = 8192
KNOWN = 200_000
KNOWN_CHARACTERS = 1 << 23
LONG_WORD = 1000
RUN = 1 << 16
WORD = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
# White space that the byte tokenizer joins with its neighbours, and the character that stands for a blank in pieces.
OTHER = re.compile(r"[^\S \n]|[᠎▁]")
# Fixed value: how the byte-level tokenizer splits a text before it merges bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _byte_characters() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary: itself where it is printable, else the next character from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(other)}}


class Aligner:
    """Aligns a byte-level tokenizer (A, reads a blank and the text) with a piece model (B, puts the blank there itself)."""

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        back = _byte_characters()
        vocabulary, added = self.a.get_vocab(), self.a.get_added_tokens_decoder()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.bytes_a[k] = entry.encode() if k in added else bytes(back[c] for c in entry)
        # The same vocabulary for the encoder that is quicker on many short words: merges are numbered in their order.
        ranks = {entry: k for k, entry in enumerate(self.bytes_a) if k not in added}
        self.quick = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode() for k, piece in enumerate(pieces)
        ]
        if any("▁" in piece.strip("▁") or (piece[:1] != "▁" and "▁" in piece) or "\n" in piece for piece in pieces):
            raise ValueError("a piece holds a blank after another character")
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        names = lambda table, mark: np.array([f"{k}{mark}" for k in range(len(table))], object)
        self.names_a = names(self.bytes_a, ","), names(self.bytes_a, "|")
        self.names_b = names(self.bytes_b, ","), names(self.bytes_b, ";")
        self.blank = self.b.piece_to_id("▁")

    def most_pairs(self) -> int:
        return int(self.size_a.sum() + self.size_b.sum())

    def align(self, words: list[str]) -> "Aligned | None":
        """Alignment of words that follow each other, of which the first begins with a blank or line end; none if either tokenizer does not give their bytes."""
        text = "".join(words)
        body = text.encode()
        if max(map(len, words)) > LONG_WORD:
            a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        else:
            a = np.array(self.quick.encode_ordinary(text), np.int64)
        if text == " ":
            b = np.array([self.blank], np.int64)
        else:
            found = self.b.encode(text[1:] if text[0] == " " else text)
            b = np.array(found if text[0] == " " else found[1:], np.int64)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != body or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != body:
            return None
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        stops = np.cumsum([len(word.encode()) for word in words])
        if not np.isin(stops, common, assume_unique=True).all():
            return None
        last_a, last_b = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
        return Aligned(a, b, last_a, last_b, np.searchsorted(common, stops) + 1)


@dataclass
class Aligned:
    """Tokens of a run of words, the last tokens of each group, and the number of groups up to the end of each word."""

    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    ends: np.ndarray

    def pairs(self) -> np.ndarray:
        return self.a[self.last_a] << SHIFT | self.b[self.last_b]

    def by_word(self, values: np.ndarray) -> np.ndarray:
        """Sums over the groups of each word."""
        total = np.concatenate([[0], np.cumsum(values)])[self.ends]
        return np.diff(total, prepend=0)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each group on either side."""
        return np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)

    def groups(self, own: Aligner) -> list[str]:
        """The groups of each word as text."""
        in_a, in_b = self.tokens()
        names = np.empty(len(self.a) + len(self.b), object)
        # A group's B tokens follow its A tokens: a token moves on by all tokens of the other side before it.
        at_a = np.arange(len(self.a)) + np.repeat(np.cumsum(in_b) - in_b, in_a)
        at_b = np.arange(len(self.b)) + np.repeat(np.cumsum(in_a), in_b)
        names[at_a], names[at_b] = own.names_a[0][self.a], own.names_b[0][self.b]
        names[at_a[self.last_a]], names[at_b[self.last_b]] = own.names_a[1][self.a[self.last_a]], own.names_b[1][self.b[self.last_b]]
        stops = (self.last_a + self.last_b + 2)[self.ends - 1].tolist()
        listed = names.tolist()
        return ["".join(listed[low:high])[:-1] for low, high in zip([0, *stops], stops)]


class Words:
    """Words met so far, by number: a word is aligned once. ``keep`` makes what is kept of newly aligned words."""

    def __init__(self, own: Aligner):
        self.own, self.index, self.count, self.size = own, {}, 0, 0
        self.new: list[Aligned] = []

    @property
    def full(self) -> bool:
        return len(self.index) > KNOWN or self.size > KNOWN_CHARACTERS

    def numbers(self, texts: list[str]) -> list[np.ndarray | None]:
        """The numbers of the words of each text, which in order give the text with a blank before it; none for a text that cannot be aligned. A text that has to be seen whole is one word."""
        split = []
        for text in texts:
            text = " " + text if text else ""
            split.append([text] if text and OTHER.search(text) else _cut_words(text))
        missing = dict.fromkeys(chain.from_iterable(split))
        self._learn([word for word in missing if word not in self.index], {words[0] for words in split if len(words) == 1})
        look = self.index.__getitem__
        numbers = [np.fromiter(map(look, words), np.int64, len(words)) for words in split]
        return [None if len(found) and found.min() < 0 else found for found in numbers]

    def _take(self, words: list[str]) -> None:
        """Number words and keep their alignment; words that cannot be aligned together are tried one by one, and one that cannot be at all has no number."""
        aligned = self.own.align(words) if words else None
        if aligned:
            first = self.count
            self.index.update(zip(words, range(first, first + len(words))))
            self.count += len(words)
            self.new.append(aligned)
        elif len(words) > 1:
            for word in words:
                self._take([word])
        elif words:
            self.index[words[0]] = -1
        self.size += sum(map(len, words))

    def _learn(self, words: list[str], whole: set[str]) -> None:
        """A word begins with its blanks, so words follow each other as one text; those of blanks only, very long ones and whole texts are aligned by themselves."""
        run, size = [], 0
        for word in words:
            if len(word) > LONG_WORD or not word.strip(" \n") or (word in whole and OTHER.search(word)):
                self._take([word])
                continue
            run.append(word)
            size += len(word)
            if size > RUN:
                self._take(run)
                run, size = [], 0
        self._take(run)


def _cut_words(text: str) -> list[str]:
    """Words of a text: each with the blanks and line ends before it."""
    return WORD.findall(text)


@lru_cache(maxsize=2)
def aligner(byte_file: str, piece_file: str) -> Aligner:
    return Aligner(byte_file, piece_file)


class PerfectHash:
    """Minimal perfect hash of 64-bit keys: level after level, keys that fall alone into a bit array stay there, the others go on to the next; a key's number is the rank of its bit."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, first = np.unique(keys).astype(np.int64), 0
        self.size = len(rest)
        while len(rest):
            bits = max(64, 2 * len(rest) + 7 & ~7)
            at = self._slots(rest, len(self.levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            packed = np.packbits(alone, bitorder="little")
            ranks = first + np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            self.levels.append((bits, packed, ranks))
            first += int(alone.sum())
            rest = rest[~alone[at]]
        own = np.unique(keys).astype(np.int64)
        self.keys = np.zeros(self.size, np.int64)
        self.keys[self._places(own)] = own

    @staticmethod
    def _slots(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        salted = mix(keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return (salted % np.uint64(bits)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, packed, ranks) in enumerate(self.levels):
            at = self._slots(keys[open_], level, bits)
            byte, bit = packed[at >> 3], (at & 7).astype(np.uint8)
            here = (byte >> bit & 1).astype(bool)
            below = np.bitwise_count(byte[here] & ((np.uint8(1) << bit[here]) - np.uint8(1)))
            out[open_[here]] = ranks[at[here] >> 3] + below
            open_ = open_[~here]
            if not len(open_):
                break
        return out

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for those that are none of its keys (the stored keys tell)."""
        out = self._places(keys)
        known = out >= 0
        out[known] = np.where(self.keys[out[known]] == keys[known], out[known], -1)
        return out


@dataclass
class PairCounts:
    """Counts of all pairs by place, and whether a pair is the most frequent of its B token."""

    hashed: PerfectHash
    counts: np.ndarray
    best: np.ndarray

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.hashed.places(pairs)
        known = place >= 0
        if not self.hashed.size:
            return np.zeros(len(pairs), np.int64), known
        return np.where(known, self.counts[place], 0), known & self.best[place]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return distinct, total


def local_counts(docs: DataFrame, byte_file: str, piece_file: str, text: str = "text") -> DataFrame:
    """``(pair, n)``: the pair counts of each task, one row per pair and task."""

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        words, times = Words(aligner(byte_file, piece_file)), np.zeros(0, np.int64)
        distinct, total = _summed([], [])

        def flush():
            """Pair counts so far, with those of the words at hand as often as they were met."""
            sizes = [part.by_word(np.ones(len(part.last_a), np.int64)) for part in words.new]
            keys, met = [part.pairs() for part in words.new], np.concatenate([times, np.zeros(words.count - len(times), np.int64)])
            counts = [np.repeat(met, np.concatenate(sizes))] if sizes else []
            return _summed([distinct, *keys], [total, *counts])

        for rows in slices:
            found = [numbers for numbers in words.numbers([row[0] or "" for row in rows]) if numbers is not None]
            met = np.bincount(np.concatenate([np.zeros(0, np.int64), *found]), minlength=words.count)
            met[: len(times)] += times
            times = met
            if words.full:
                distinct, total = flush()
                words, times = Words(words.own), np.zeros(0, np.int64)
        distinct, total = flush()
        yield {"pair": distinct, "n": total}

    return map_rows(docs.select(F.col(text)), work, "pair long, n long")


def _dense(local: DataFrame, hashed: PerfectHash) -> np.ndarray:
    """The counts by place: tasks make dense vectors of what they read, and ``FAN`` vectors at a time become one, slice by slice."""
    import pyarrow as pa

    shipped = local.sparkSession.sparkContext.broadcast(hashed)
    schema = "slice long, node long, counts binary"

    def vectors(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        from pyspark import TaskContext

        table, used = shipped.value, False
        own = np.zeros(table.size, np.int64)
        for rows in slices:
            pairs, n = (np.array(column, np.int64) for column in zip(*rows))
            np.add.at(own, table.places(pairs), n)
            used = True
        parts = range(0, table.size if used else 0, SLICE)
        node = TaskContext.get().partitionId()
        yield {"slice": [k // SLICE for k in parts], "node": [node for _ in parts], "counts": [own[k : k + SLICE].tobytes() for k in parts]}

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
        return pa.table({"slice": group.column("slice")[:1], "node": group.column("parent")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    level = materialized(map_rows(local, vectors, schema, rows=1 << 16))
    while (level.agg(F.max("node")).first()[0] or 0) > 0:
        parents = level.withColumn("parent", F.floor(F.col("node") / FAN))
        level = materialized(parents.groupBy("slice", "parent").applyInArrow(added, schema))
    out = np.zeros(hashed.size, np.int64)
    for row in level.collect():  # one vector in all, bounded by the vocabularies
        out[row.slice * SLICE : row.slice * SLICE + len(row.counts) // 8] = np.frombuffer(row.counts, np.int64)
    return out


def count_pairs(docs: DataFrame, byte_file: str, piece_file: str, text: str = "text") -> PairCounts:
    """Counts of all linked pairs of ``docs``. The pairs that reach the driver are bounded by the bytes of both vocabularies, which is checked."""
    local = materialized(local_counts(docs, byte_file, piece_file, text))
    distinct, most = local.select("pair").distinct(), aligner(byte_file, piece_file).most_pairs()
    keys = np.array([row[0] for row in distinct.limit(most + 1).toLocalIterator()], np.int64)
    if len(keys) > most:
        raise ValueError("more linked pairs than the vocabularies can give")
    hashed = PerfectHash(keys)
    counts = _dense(local, hashed)
    b = hashed.keys & ((1 << SHIFT) - 1)
    highest = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, b, counts)
    return PairCounts(hashed, counts, counts == highest[b])


def align(docs: DataFrame, byte_file: str, piece_file: str, counts: PairCounts, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the A and B ids of each group. Null and empty texts, and those whose tokens do not give the bytes of a blank and the text, have no token: zeros
    and an empty string. ``n_best`` counts links whose pair is the most frequent of its B token in ``counts``, ties included; pairs that ``counts`` does not know count 0 and are no
    best. Rows that repeat an id or text are aligned each; an empty table gives no row; a very long text is a slice of its own, and aligned whole where it holds other white space.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(counts)

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        table, words = shipped.value, Words(aligner(byte_file, piece_file))
        numbers, groups = np.zeros((0, 5), np.int64), []
        for rows in slices:
            if words.full:
                words, numbers, groups = Words(words.own), numbers[:0], []
            split = words.numbers([row[1] or "" for row in rows])
            parts = [numbers]
            for part in words.new:
                n, best = table.look_up(part.pairs())
                columns = (*part.tokens(), np.ones(len(n), np.int64), best, n)
                parts.append(np.stack([part.by_word(column.astype(np.int64)) for column in columns], axis=1))
                groups += part.groups(words.own)
            words.new, numbers = [], np.concatenate(parts)
            totals = np.array([[0] * 5 if at is None else numbers[at].sum(axis=0) for at in split])
            n_a, n_b, n_groups, n_best, count_sum = totals.T
            yield {
                "doc_id": [row[0] for row in rows], "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_groups, "n_best": n_best, "count_sum": count_sum,
                "groups": ["" if at is None else ";".join(map(groups.__getitem__, at.tolist())) for at in split],
            }

    return map_rows(docs.select(F.col(id_column).cast("long"), F.col(text)), work, ALIGNED)
