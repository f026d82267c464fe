"""Hashes of all words of a batch of texts at once, as arrays.

A word is a maximal run of ASCII letters or digits and non-ASCII bytes of the lower-cased text. Prefix sums of ``(byte + 1) * B**position`` in 64-bit
arithmetic give the polynomial hash of any stretch, since B is odd and has an inverse; a mixer spreads the bits.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
# A chunk's arrays take some 40 bytes for each of its own.
CHUNK_BYTES = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[*range(48, 58), *range(97, 123)]] = True
_powers = {}


def _power(base: int, size: int) -> np.ndarray:
    """``base**0 .. base**(size - 1)`` modulo 2**64, kept for the next batch."""
    table = _powers.get(base)
    if table is None or len(table) < size:
        table = np.full(max(size, CHUNK_BYTES + 4096), base, np.uint64)
        table[0] = 1
        table = _powers[base] = np.multiply.accumulate(table)
    return table[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunk_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(INVERSE, len(data) + 1)[starts]), starts, ends


def hash_words(texts: list[str | None], spans: bool = False):
    """``(hashes, counts)``: word hashes of all texts one after the other, and the words of each text; null counts as empty.

    With ``spans`` also the byte offsets of each word in its lower-cased text. Longer inputs are worked through in chunks that end between words.
    """
    encoded = [(text or "").lower().encode("utf-8", "surrogatepass") for text in texts]
    lengths = np.array([len(e) + 1 for e in encoded], np.int64)
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    hashes, starts, ends, at = [], [], [], 0
    while at < len(data):
        stop = min(at + CHUNK_BYTES, len(data))
        while stop < len(data) and _WORD[data[stop - 1]]:  # to the next end of a word
            more = np.flatnonzero(~_WORD[data[stop : stop + CHUNK_BYTES]])
            stop = stop + int(more[0]) + 1 if len(more) else min(stop + CHUNK_BYTES, len(data))
        h, s, e = _chunk_words(data[at:stop])
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    hashes, starts = join(hashes, np.uint64), join(starts, np.int64)
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    places = np.searchsorted(starts, firsts)
    counts = np.diff(places)
    if not spans:
        return hashes, counts
    base = np.repeat(firsts[:-1], counts)
    return hashes, counts, starts - base, join(ends, np.int64) - base


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on (as if the array were one text)."""
    total = len(hashes) - size + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(total, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + hashes[k : k + total]
    return mix(out)
