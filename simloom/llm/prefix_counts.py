"""Exact token counts at every prefix of a text by dynamic programming over the pieces of a byte-pair vocabulary.

The pieces that encode a prefix are those that encode a shorter prefix, then one last piece; a piece may follow another exactly if both,
written together, are encoded as these two. So the count at a prefix is the count where its last piece begins, plus one, and the last
piece is the only one that may follow there. No vocabulary piece holds a blank after another character, hence text between
blanks is independent and a word that was met before keeps its counts.

The counts are stored as one signed byte per character, the change against the prefix before, so that a query about any cut or budget
needs a running sum and no tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import map_rows

MARK = "▁"
KNOWN = 200_000
LONG_WORD = 48
# A run of blanks belongs to the word that follows; line ends are never part of a piece.
SEGMENT = re.compile(r"▁*[^▁\n]+|▁+|\n")
COUNTS = "doc_id long, n_bytes long, n_chars long, n_tokens long, changes binary"


class PrefixCounter:
    """Prefix counts for a piece model whose characters without a piece become one token per byte."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda k: model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)
        # A merge is better the higher its score.
        self.score = {model.id_to_piece(k): model.get_score(k) for k in range(model.get_piece_size()) if not special(k)}
        if any(MARK in piece.strip(MARK) or (MARK in piece and not piece.startswith(MARK)) or "\n" in piece for piece in self.score):
            raise ValueError("a piece holds a blank after another character")
        self.follows: dict[tuple[str, str], bool] = {}
        self.pieces = ahocorasick.Automaton()
        for piece in self.score:
            if len(piece) > 1:
                self.pieces.add_word(piece, piece)
        self.pieces.make_automaton()
        self.known: dict[str, tuple[int, bytes]] = {}
        self.ends: dict[str, int] = {"": 0}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging, the best-scored neighbours first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = max(range(len(scores)), key=scores.__getitem__)
            if scores[best] == -np.inf:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _may_follow(self, last: str, piece: str) -> bool:
        key = (last, piece)
        found = self.follows.get(key)
        if found is None:
            if len(self.follows) > 2 * KNOWN:
                self.follows = {}
            found = self.follows[key] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return found

    def counts(self, text: str) -> list[int]:
        """Token counts of all prefixes of an independent stretch, from the empty one to the whole.

        The automaton names the pieces of two characters or more that end at each character, longest first. The first that may follow the last piece of its own
        beginning is the last piece there; if none may, the character by itself is.
        """
        last, counts, done = [""] * (len(text) + 1), [0] * (len(text) + 1), 0
        follows, single = self.follows, self.score
        for at, piece in self.pieces.iter(text):
            if at < done:
                continue
            while done < at:
                char = last[done + 1] = text[done]
                counts[done + 1] = counts[done] + (1 if char in single else len(char.encode()))
                done += 1
            before = at + 1 - len(piece)
            fits = follows.get((last[before], piece))
            if fits is None:
                fits = self._may_follow(last[before], piece)
            if fits:
                done = at + 1
                last[done], counts[done] = piece, counts[before] + 1
        for k in range(done, len(text)):
            counts[k + 1] = counts[k] + (1 if text[k] in single else len(text[k].encode()))
        return counts

    def segment(self, text: str) -> tuple[int, bytes]:
        """Token count of an independent stretch, and the change of the count at each of its characters."""
        counts = self.counts(text)
        out = counts[-1], bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])
        if len(text) <= LONG_WORD:
            self.known[text] = out
        return out

    def count(self, text: str) -> tuple[int, bytes]:
        """Tokens of the whole text, and the change of the count at each character.

        The model puts a blank before a text; its count falls to the first character.
        """
        if not text:
            return 0, b""
        if len(self.known) > KNOWN:
            self.known = {}
        known, total, parts = self.known, 0, []
        for segment in SEGMENT.findall(MARK + text.replace(" ", MARK)):
            found = known.get(segment) or self.segment(segment)
            total += found[0]
            parts.append(found[1])
        changes = b"".join(parts)
        first = np.frombuffer(changes[:2], np.int8).sum(dtype=np.int8)
        return total, first.tobytes() + changes[2:]

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts: the counts at the ends of their segments, each different segment of the texts gone through once.

        Words between single blanks are all but the first of a line; texts with other blanks are split by the pattern.
        """
        split = []
        for text in texts:
            if not text:
                split.append([])
            elif "  " in text or text[0] == " " or text[-1] == " " or MARK in text or "\n " in text or " \n" in text:
                split.append(SEGMENT.findall(MARK + text.replace(" ", MARK)))
            else:
                split.append((MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" "))
        if len(self.ends) > KNOWN:
            self.ends = {"": 0}
        missing = set(chain.from_iterable(split)).difference(self.ends)
        self.ends.update((segment, self.counts(segment)[-1]) for segment in missing)
        look = self.ends.__getitem__
        out = [sum(map(look, segments)) for segments in split]
        for segment in missing:
            if len(segment) > LONG_WORD:
                del self.ends[segment]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text", changes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_chars, n_tokens, changes``: ``changes`` holds a signed byte per character, or is null where only totals are asked for.

    The sum of the first k changes is the token count of the first k characters. A null or empty text has no change and no token. Rows that repeat an id are counted each; an
    empty table gives no row. Very long texts are counted whole, a slice of their own.
    """

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        own = counter(model)
        for rows in slices:
            texts = [row[1] or "" for row in rows]
            counted = [own.count(value) for value in texts] if changes else [(total, None) for total in own.totals(texts)]
            yield {
                "doc_id": [row[0] for row in rows],
                "n_bytes": [len(value.encode()) for value in texts],
                "n_chars": [len(value) for value in texts],
                "n_tokens": [total for total, _ in counted],
                "changes": [change for _, change in counted],
            }

    return map_rows(docs.select(F.col(id_column).cast("long"), F.col(text)), work, COUNTS)


def tokens_at(changes: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` characters."""
    return int(np.frombuffer(changes[:chars], np.int8).sum(dtype=np.int64))


def longest_within(changes: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens (a longer prefix can have fewer tokens than a shorter one)."""
    counts = np.concatenate([[0], np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)])
    return int(np.flatnonzero(counts <= budget)[-1])
