"""Token ids of whole texts, exact as the tokenizer library gives them, with words encoded once per task.

The tokenizer lower-cases, drops white space and encodes runs of letters, single digits and runs of marks each by itself. So the ids
of a text are those of its runs, one after the other, and each worker keeps the ids of runs, and of what it has met between white space, as bytes. Texts of
common Latin characters are cut into runs here; any other text (combining marks, other scripts, strings that look like special tokens) goes to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np

KNOWN_RUNS = 600_000
LONG_RUN = 64
MARKS = "–—‘’“”„•…€"
# Characters whose lower case is one character, that no normalisation changes, and that are plainly letters, digits or marks.
COMMON = re.compile(rf"[ -~\n\t\rÀ-ÖØ-öø-ÿ{MARKS}]*")
RUN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{{-~{MARKS}]+")


class WordEncoder:
    """Encoder for a tokenizer file with word ends, which splits letters from marks and drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.runs: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _learn(self, runs: list[str]) -> None:
        """Many runs are encoded as one text: a run ends with an end token, and has no other."""
        for k in range(0, len(runs), 1024):
            part = runs[k : k + 1024]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                self.runs.update(zip(part, self.whole(part)))
                continue
            raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.runs.update(zip(part, [raw[a:b] for a, b in zip(at, at[1:])]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        texts = [text or "" for text in texts]
        common = [bool(COMMON.fullmatch(text)) and "<|" not in text for text in texts]
        # No run holds white space: what stands between it is looked up at once, and cut into runs only where it is new.
        split = [text.lower().split() for text, plain in zip(texts, common) if plain]
        if len(self.runs) > KNOWN_RUNS:
            self.runs = {}
        look, plain_ids, new = self.runs.__getitem__, [], []
        for k, words in enumerate(split):
            try:
                plain_ids.append(b"".join(map(look, words)))
            except KeyError:
                plain_ids.append(b"")
                new.append(k)
        missing = set(chain.from_iterable(split[k] for k in new)).difference(self.runs)
        cut = {word: RUN.findall(word) for word in missing if not word.isalpha()}
        runs = missing.difference(cut).union(*cut.values()).difference(self.runs)
        self._learn(list(runs))
        self.runs.update([(word, b"".join(map(look, parts))) for word, parts in cut.items()])
        for k in new:
            plain_ids[k] = b"".join(map(look, split[k]))
        for word in runs.union(cut):
            if len(word) > LONG_RUN:
                del self.runs[word]
        plain_ids = iter(plain_ids)
        other_ids = iter(self.whole([text for text, plain in zip(texts, common) if not plain]))
        return [next(plain_ids if plain else other_ids) for plain in common]


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and tokenizer file."""
    return WordEncoder(path)
