"""Sets of word shingles, computed for many texts at once in numpy.

Words are maximal runs of bytes other than ASCII white space, with A-Z lowered; a shingle
is ``WORDS`` consecutive words; a text of fewer words has the whole sequence as its one
shingle. Words and shingles are 64-bit hashes; a set is sorted and distinct. A word is hashed
8 bytes at a time, mixed after each step, so that no two words collide by their construction;
a long one by BLAKE2b.
"""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
#: texts are hashed together up to about this many bytes, to bound memory
BLOCK_BYTES = 1_000_000
#: longest word that is hashed in steps, in bytes; start value
STEPPED, START = 64, 0x9E3779B97F4A7C15
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
IS_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    h = np.full(n, np.uint64(width))
    for k in range(width):
        h = mix(h * np.uint64(0x165667B19E3779F9) + words[k : k + n])
    return h


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    data = LOWER[np.frombuffer(b" ".join(raw) + b" " * 9, dtype=np.uint8)]
    inside = IS_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    start, end = edges[::2], edges[1::2]
    # the 8 bytes from each position on, as one number
    ahead = np.zeros(len(data) - 7, dtype=np.uint64)
    for k in range(8):
        ahead |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64(START))
    live = np.flatnonzero(size <= STEPPED)
    for at in range(0, STEPPED, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        left = np.minimum(size[live] - at, 8).astype(np.uint64)
        part = ahead[start[live] + at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        h[live] = mix(h[live] * np.uint64(0x165667B19E3779F9) + part)
    for i in np.flatnonzero(size > STEPPED).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h, np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)])))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    start = size = 0
    texts = [t or "" for t in texts]
    for i in range(len(texts) + 1):
        if i == len(texts) or (size and size + len(texts[i]) > BLOCK_BYTES):
            if i > start:
                out += _sets(texts[start:i])
            start, size = i, 0
        if i < len(texts):
            size += len(texts[i])
    return out


def _sets(texts: list[str]) -> list[np.ndarray]:
    words, counts = word_hashes(texts)
    runs = chain(words, WORDS) if len(words) >= WORDS else words[:0]
    out, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            out.append(np.unique(runs[at : at + n - WORDS + 1]))
        else:
            out.append(chain(words[at : at + n], n) if n else words[:0])
        at += n
    return out
