"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Words of similar length advance together, one character position per step. At each
position the substrings that end there are looked up by hash among the sorted piece
keys, and the best last piece is kept as the back pointer of the position.

What "best" means depends on the model. For a unigram model it is the largest sum of
piece scores. The public 32k vocabulary is a BPE model, whose encoding is defined by a
merge order, not by a sum of scores; the search then runs over the same lattice with a
transition constraint: a piece may follow another only if BPE would keep the two apart
when it meets them side by side. Exactly one back pointer per position satisfies it,
and the path is the library's own encoding (tested for equality).

Text rules of the model: a blank is put in front, blanks are written U+2581, and
characters outside the vocabulary become their UTF-8 bytes (byte pieces). Words are
maximal runs of blanks with the following non-blanks; no piece spans two words. Other
white space is kept, so decoding gives back the text exactly; the only exception are
texts that hold U+2581 themselves, which decode with a blank in its place.

Scale: documents are independent; each Arrow batch encodes the distinct words it has
not met yet. The model (0.5 MB) goes to the tasks by value; words are remembered within a
task, at most ``CACHE``.

Defined cases: null and empty texts have no ids and decode to the empty text; ids that
are no pieces raise an error; null document ids and repeated rows are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE = 150_000
#: words searched together, texts encoded together
ROWS, TEXTS = 20_000, 300
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
BASE = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.iinfo(np.int64).max


def _spread(codes: np.ndarray) -> np.ndarray:
    """Code points as well-mixed 64-bit numbers, the digits of the word hash."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _hash(word: str) -> int:
    h = 0
    for d in _spread(np.array([ord(c) for c in word], dtype=np.uint64)).tolist():
        h = (h * int(BASE) + d) & 0xFFFFFFFFFFFFFFFF
    return h


class Sorted:
    """Sorted 64-bit keys with a value each. A table of how many keys begin with each of the
    2**18 highest bit patterns spares most probes of keys that are not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, absent: int):
        at = np.argsort(keys)
        self.keys, self.values, self.absent = keys[at], values[at], absent
        assert len(np.unique(self.keys)) == len(keys)
        self.begin = np.searchsorted(self.keys >> np.uint64(46), np.arange(2**18 + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.begin).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.absent, dtype=np.int64)
        top = (keys >> np.uint64(46)).astype(np.int64)
        first, last = self.begin[top], self.begin[top + 1]
        left = np.flatnonzero(first < last)
        first, last, keys = first[left], last[left], keys[left]
        for _ in range(self.most):
            hit = self.keys[first] == keys
            out[left[hit]] = self.values[first[hit]]
            first = first + 1
            more = ~hit & (first < last)
            left, first, last, keys = left[more], first[more], last[more], keys[more]
            if not len(left):
                break
        return out


class Vocabulary:
    """Sorted piece keys, scores and (for BPE) what each piece was last merged from."""

    def __init__(self, model: bytes, unigram: bool = False):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        byte_of = {int(i): b for b, i in enumerate(self.byte_id)}
        as_bytes = lambda i: bytes([byte_of[i]]) if i in byte_of else b"" if special[i] else self.pieces[i].replace(SPACE, " ").encode()
        self.bytes = np.frombuffer(b"".join(as_bytes(i) for i in range(n)), dtype=np.uint8)
        self.sizes = np.array([len(as_bytes(i)) for i in range(n)], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.unigram = unigram
        usable = [i for i in range(n) if not special[i]]
        ids = {self.pieces[i]: i for i in usable}
        self.longest = max(map(len, ids))
        # rank: single characters are given, longer pieces come into being by falling score
        order = sorted((i for i in usable if len(self.pieces[i]) > 1), key=lambda i: (-self.score[i], i))
        self.rank = np.full(n, -1, dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.left = np.arange(n)
        self.right = np.arange(n)
        if not unigram:
            self._pairs(ids, order)
            usable = [i for i in usable if len(self.pieces[i]) == 1 or self.left[i] != i]
        self.keys = Sorted(np.array([_hash(self.pieces[i]) for i in usable], dtype=np.uint64), np.array(usable, dtype=np.int64), -1)

    def _pairs(self, ids: dict[str, int], order: list[int]) -> None:
        """Merge table (pair of pieces -> rank of their union) and, for every piece that BPE
        can make, its two halves, found by replaying the merges on its own text."""
        merged = {}
        for i in order:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    merged[a, b] = i
        for i in order:
            parts = [ids.get(c, -1) for c in self.pieces[i]]
            while len(parts) > 1:
                best = min(((self.rank[merged[a, b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in merged), default=None)
                if best is None:
                    break
                k = best[1]
                whole = merged[parts[k], parts[k + 1]]
                if whole == i and len(parts) == 2:
                    self.left[i], self.right[i] = parts
                parts[k : k + 2] = [whole]
        pairs = np.array(list(merged), dtype=np.int64).reshape(-1, 2)
        self.unions = Sorted(self._pair(pairs[:, 0], pairs[:, 1]), self.rank[list(merged.values())], NEVER)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _spread((a * len(self.pieces) + b).astype(np.uint64))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps pieces ``a`` and ``b`` apart when they stand side by side.

        The pieces are taken apart in the reverse order of their making. At each stage the
        pair at the seam must not have a union that would have been made earlier than the
        piece undone last; of equal ranks the leftmost is made first. Ids from the number of
        pieces on are unknown characters, which nothing merges with."""
        n = len(self.pieces)
        ok = np.ones(len(a), dtype=bool)
        live = np.flatnonzero((a < n) & (b < n) & (a >= 0))
        x, y, before = a[live], b[live], np.full(len(live), NEVER)
        while len(live):
            joined = self.unions.find(self._pair(x, y)) < before
            ok[live[joined]] = False
            rx, ry = self.rank[x], self.rank[y]
            going = ~joined & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[going], x[going], y[going], rx[going], ry[going]
            undo_left = rx > ry
            before = np.where(undo_left, rx, ry + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return ok

    def search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and the start and number of those of each word; words of similar length
        are searched together."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        by_length = np.argsort(-lengths, kind="stable")
        starts, counts, flat, at, total = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), [], 0, 0
        while at < len(words):
            group = by_length[at : at + max(1, min(ROWS, 2_000_000 // int(lengths[by_length[at]])))]
            ids, n = self._advance([words[i] for i in group.tolist()])
            starts[group], counts[group] = total + np.cumsum(n) - n, n
            flat.append(ids)
            at, total = at + len(group), total + len(ids)
        return np.concatenate(flat), starts, counts

    def _advance(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``words`` by falling length; step i moves all words of at least i characters."""
        n, lengths = len(self.pieces), np.array([len(w) for w in words])
        width = int(lengths[0])
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = np.arange(width)[None, :] < lengths[:, None]
        codes = np.zeros((len(words), width), dtype=np.uint32)
        codes[inside] = flat
        digits = _spread(codes)
        prefix = np.zeros((width + 1, len(words)), dtype=np.uint64)
        for i in range(width):
            prefix[i + 1] = prefix[i] * BASE + digits[:, i]
        power = np.cumprod(np.full(self.longest, BASE, dtype=np.uint64))
        best = np.full((width + 1, len(words)), -np.inf)
        best[0] = 0.0
        last = np.full((width + 1, len(words)), -1, dtype=np.int64)
        back = np.zeros((width + 1, len(words)), dtype=np.int32)
        active = np.searchsorted(-lengths, -np.arange(1, width + 1), side="right")
        for i in range(1, width + 1):
            todo = np.arange(active[i - 1])
            for size in range(min(i, self.longest), 0, -1):
                j = i - size
                piece = self.keys.find(prefix[i, todo] - prefix[j, todo] * power[size - 1])
                if size == 1:
                    piece = np.where(piece < 0, n + codes[todo, i - 1].astype(np.int64), piece)
                hit = piece >= 0
                rows, piece = todo[hit], piece[hit]
                if not len(rows):
                    continue
                if self.unigram:
                    known = np.minimum(piece, n - 1)
                    total = best[j, rows] + np.where(piece < n, self.score[known], self.score.min() - 10.0)
                    better = total > best[i, rows]
                    rows, piece, total = rows[better], piece[better], total[better]
                    best[i, rows] = total
                else:
                    fits = self.apart(last[j, rows], piece)
                    rows, piece = rows[fits], piece[fits]
                    done = np.zeros(len(words), dtype=bool)
                    done[rows] = True
                    todo = todo[~done[todo]]
                last[i, rows], back[i, rows] = piece, j
        # all paths are followed back together
        at, row = lengths.copy(), np.arange(len(words))
        steps = []
        while len(row):
            piece = last[at[row], row]
            steps.append((row, piece))
            at[row] = back[at[row], row]
            row = row[at[row] > 0]
        row, piece = (np.concatenate([s[k] for s in reversed(steps)]) for k in (0, 1))
        order = np.argsort(row, kind="stable")
        row, piece = row[order], piece[order]
        unknown = np.flatnonzero(piece >= n)
        if len(unknown):  # characters that are no pieces become their bytes
            raw = [chr(p - n).encode("utf-8", "surrogatepass") for p in piece[unknown].tolist()]
            size = np.ones(len(piece), dtype=np.int64)
            size[unknown] = [len(r) for r in raw]
            row, piece = np.repeat(row, size), np.repeat(piece, size)
            piece[piece >= n] = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return piece.astype(np.int32), np.bincount(row, minlength=len(words))


class _Numbers(dict):
    """Numbers words in the order in which they are met, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Codec:
    """Encoder with a memory of words, and decoder."""

    def __init__(self, model: bytes, unigram: bool = False):
        self.vocabulary = Vocabulary(model, unigram)
        self._clear()

    def _clear(self):
        self.number = _Numbers()
        self.starts, self.counts, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def forget(self) -> None:
        """At the end of a task."""
        self._clear()
        give_back()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > CACHE:
            self._clear()
        met = []
        for t in texts:
            words = WORD.findall(SPACE + t.replace(" ", SPACE)) if t else []
            met.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words)))
        new, self.number.new = self.number.new, []
        if new:
            ids, starts, counts = self.vocabulary.search(new)
            self.starts, self.counts = np.concatenate([self.starts, starts + len(self.ids)]), np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids])
        out = []
        for at in met:
            count = self.counts[at]
            ends = np.cumsum(count)
            out.append(self.ids[np.repeat(self.starts[at] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)])
        return out

    def decode(self, ids) -> str:
        v, ids = self.vocabulary, np.asarray(ids, dtype=np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(v.sizes):
            raise ValueError("not a piece id")
        count = v.sizes[ids]
        ends = np.cumsum(count)
        raw = v.bytes[np.repeat(v.starts[ids] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        text = raw.tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_CODECS: dict = {}


def codec(model: bytes, unigram: bool = False) -> Codec:
    """One codec per worker process and model."""
    key = (hash(model), unigram)
    if key not in _CODECS:
        _CODECS[key] = Codec(model, unigram)
    return _CODECS[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _blocks(batch: pa.RecordBatch):
    """(slice of the batch, its texts): a bounded number of texts at a time."""
    for at in range(0, len(batch), TEXTS):
        part = batch.slice(at, TEXTS)
        yield part, [t or "" for t in part.column(1).to_pylist()]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else [], type=pa.int32()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``(doc_id, ids array<int>)``, one row per input row."""
    blob = read_model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(blob)
        for batch in batches:
            for part, texts in _blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(c.encode(texts))], names=["doc_id", "ids"])
        c.forget()

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``(doc_id, text)``, one row per input row; null ids give the empty text."""
    blob = read_model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(blob)
        for batch in batches:
            texts = ["" if x is None else c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    d = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``(doc_id, ids, decoded, exact)``: both directions in one pass over the texts;
    ``exact`` tells whether decoding gave back the text."""
    blob = read_model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(blob)
        for batch in batches:
            for part, texts in _blocks(batch):
                ids = c.encode(texts)
                back = [c.decode(x) for x in ids]
                same = pa.array([a == b for a, b in zip(texts, back, strict=True)], type=pa.bool_())
                columns = [part.column(0), _lists(ids), pa.array(back, type=pa.string()), same]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded", "exact"])
        c.forget()

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, ids array<int>, decoded string, exact boolean")
