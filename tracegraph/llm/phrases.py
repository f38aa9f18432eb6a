"""Phrase collocations mined with one FM-index per shard over word ids.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into
words at blanks and tabs. Per language a phrase of 2 to 4 words is a candidate when it occurs
``least`` times or more within pieces, overlaps included. Its score is the lowest over its cuts
of ``floor(2000000 a / (l + r))``; a candidate inside a longer one that is nearly as frequent
(``100 f(longer) >= 80 a``) is dropped; the first ``top`` of each language are returned.

Method: documents become shards of about ``SHARD`` word ids (0 between pieces and documents).
Over each shard stand two truncated FM-indexes (rows sorted by their first ``DEPTH`` ids, the
Burrows-Wheeler transform, counts of smaller ids, ranks): one of the shard, one of the
reversed shard. A phrase is a pair of row intervals, one in each. Extension by a word to the
right reads the transform of the reversed index inside the interval, and moves both intervals
(left: the other way round), so all extensions of all phrases of a length come from one pass.
Counts of shards are added up.

Levels, each leaving out only what cannot be a candidate, as no phrase is more frequent than
its parts:

1. words: counted per (language, word); frequent ones get a number, the others become 0;
2. pairs of frequent words: each shard sends its distinct pairs, packed by hash range; a range
   adds up the counts and answers each shard with those of its pairs that are frequent;
3. triples by extension to the right of frequent pairs, and quadruples by extension of these
   to the left; a new phrase is kept if its new outer pair is frequent too, which is an
   interval that encloses its own. Their counts are added up by the engine.

Containment needs one step only: if a phrase lies in one two words longer that is nearly as
frequent, then so is the phrase one word longer between them.

Scale: text is read once; after that only ids move: shards of bounded size, and pairs by hash
range, with as many ranges as words need. Nothing is gathered per language: the last ranking
takes the first ``top`` of hash parts, then of these. What belongs to a shard is brought to it
by a sort, which can spill, and its rows pass a task one shard at a time; the tables of shards
are written in row groups of a few shards; a shard's phrases are extended ``SLICE`` rows at a
time. So a task's memory depends on a shard, not on how many of them a table has.

Defined cases: null texts are empty; a null language is ``und``; ids play no part and
repeated rows count again; a language or table without candidates gives no rows; a shard is
cut between pieces, so only a single piece longer than ``SHARD`` words makes a longer one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, small_batches, staged

LEAST, TOP, INSIDE, SCALE = 30, 2000, 80, 2_000_000
#: words per shard, longest phrase, ids per hash range of pairs, code points cut at a time
SHARD, DEPTH, RANGE, CHARS = 1 << 20, 4, 2_000_000, 1 << 18
#: index rows extended at a time, most rows with pairs of shards per Arrow batch
SLICE, ROWS = 1 << 17, 64
#: a row is a shard of some MB: without this a writer looks at its size every 100 rows only
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO_DOT = bytes(46 if b in BREAKS else b for b in range(256))
GRAM = [f"w{i}" for i in range(1, DEPTH + 1)]


# ------------------------------------------------------------------ shards


def tokens(texts: list[str]) -> list[bytes]:
    """Words of the texts in order, with ``.`` between pieces and texts."""
    raw = b".".join(t.encode("utf-8", "surrogatepass") for t in texts)
    # bytes.lower() knows A-Z only, split() the ASCII blanks
    return raw.lower().translate(_TO_DOT).replace(b".", b" . ").split()


def shard_cuts(ids: np.ndarray, size: int) -> list[int]:
    """Ends of shards of at least ``size`` ids that end between pieces."""
    gaps = np.flatnonzero(ids == 0)
    cuts, at = [], 0
    while len(ids) - at > size:
        nxt = np.searchsorted(gaps, at + size)
        if nxt == len(gaps):
            break
        at = int(gaps[nxt]) + 1
        cuts.append(at)
    return cuts if cuts and cuts[-1] == len(ids) else [*cuts, len(ids)]


def _shard_rows(vocabulary: list[tuple[str, bytes]], ids: np.ndarray, size: int):
    """(tokens, langs, words, counts) per shard; words are numbered from 1 within it."""
    start = 0
    for end in shard_cuts(ids, size):
        own = ids[start:end]
        start = end
        often = np.bincount(own)
        met = np.flatnonzero(often[1:]) + 1
        if len(met):
            named = [vocabulary[i - 1] for i in met.tolist()]
            langs, words = zip(*[(lang, w.decode("utf-8", "replace")) for lang, w in named], strict=True)
            local = np.zeros(len(often), dtype="<u4")
            local[met] = np.arange(1, len(met) + 1)
            yield local[own].tobytes(), list(langs), list(words), often[met].tolist()


def portions(texts: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in order, in lists of at least ``chars`` code points but for the last."""
    some, n = [], 0
    for text in texts:
        some.append(text)
        n += len(text)
        if n >= chars:
            yield some
            some, n = [], 0
    if some:
        yield some


def shards(docs: DataFrame, text_col: str, lang_col: str, size: int) -> DataFrame:
    """``(shard, tokens, langs, words, counts)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = count(TaskContext.get().partitionId() << 32)
        next_id, ids, held, n_held = count(1), {}, [], 0
        fields = [("shard", pa.int64()), ("tokens", pa.binary()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]

        def flush():
            by_id: list = [None] * sum(len(d) - 1 for d in ids.values())
            for lang, d in ids.items():
                for w, i in d.items():
                    if i:
                        by_id[i - 1] = (lang, w)
            for r in _shard_rows(by_id, np.concatenate(held), size):
                row = (next(number), *r)
                yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, (_, t) in zip(row, fields, strict=True)], names=[n for n, _ in fields])

        for batch in batches:
            by_lang = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang[lang].append(text or "")
            for lang, texts in by_lang.items():
                for some in portions(texts, CHARS):
                    if lang not in ids:
                        ids[lang] = defaultdict(next_id.__next__, {b".": 0})  # no word holds a dot
                    held.append(np.fromiter(map(ids[lang].__getitem__, tokens(some)), dtype=np.uint32))
                    held.append(np.zeros(1, dtype=np.uint32))
                    n_held += len(held[-2]) + 1
                    if n_held >= size:
                        yield from flush()
                        next_id, ids, held, n_held = count(1), {}, [], 0
        if held:
            yield from flush()
        del held, ids
        give_back()

    d = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return d.mapInArrow(cut, "shard long, tokens binary, langs array<string>, words array<string>, counts array<long>")


# ---------------------------------------------------------------- FM-index


def row_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` ids from there on (0 behind the end), then of the
    positions. As many ids as 63 bits hold are one key, with the position too if it fits."""
    n = len(ids)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    per = max(1, min(depth, 63 // bits))
    keys = []
    for at in range(0, depth, per):
        key = np.zeros(n, dtype=np.int64)
        for j in range(at, min(at + per, depth)):
            key <<= bits
            key[: max(n - j, 0)] |= ids[j:].astype(np.int64)
        keys.append(key)
    if len(keys) > 1:
        return np.lexsort(keys[::-1])
    place = max(1, n.bit_length())
    if bits * depth + place <= 63:
        return np.sort(keys[0] << place | np.arange(n)) & ((1 << place) - 1)
    return np.argsort(keys[0], kind="stable")


class Index:
    """Truncated FM-index of ids that begin and end with 0."""

    def __init__(self, ids: np.ndarray, depth: int):
        n = len(ids)
        rows = row_order(ids, depth)
        self.width = int(ids.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=self.width))])
        self.bwt = ids[rows - 1]
        self.n, self.places = n + 1, np.sort(self.bwt.astype(np.int64) * (n + 1) + np.arange(n))

    def rank(self, c: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often ``c`` stands in the transform before ``row``."""
        return np.searchsorted(self.places, c.astype(np.int64) * self.n + row) - self.first[c]

    def extend(self, low: np.ndarray, size: np.ndarray):
        """Of intervals (low, size): per extension by a word the interval's place, the word, the
        new interval, and how many rows of the old one have a smaller word there."""
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.repeat(low - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        key, often = np.unique(owner * self.width + self.bwt[rows], return_counts=True)
        owner, c = key // self.width, key % self.width
        before = np.cumsum(often) - often
        smaller = before - (ends - size)[owner]
        word = c > 0
        owner, c, often, smaller = owner[word], c[word], often[word], smaller[word]
        return owner, c, self.first[c] + self.rank(c, low[owner]), often, smaller


class Phrases:
    """Phrases of one length: ids, occurrences, and intervals in both indexes."""

    def __init__(self, words, size, forward, backward):
        self.words, self.size, self.forward, self.backward = words, size, forward, backward

    def only(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.words[keep], self.size[keep], self.forward[keep], self.backward[keep])


class Bidirectional:
    def __init__(self, ids: np.ndarray, depth: int):
        self.ahead, self.back = Index(ids, depth), Index(ids[::-1], depth)

    def words(self) -> Phrases:
        size = np.diff(self.ahead.first)
        own = np.flatnonzero(size[1:]) + 1
        return Phrases(own[:, None], size[own], self.ahead.first[own], self.back.first[own])

    def right(self, p: Phrases) -> Phrases:
        owner, c, low, size, smaller = self.back.extend(p.backward, p.size)
        return Phrases(np.column_stack([p.words[owner], c]), size, p.forward[owner] + smaller, low)

    def left(self, p: Phrases) -> Phrases:
        owner, c, low, size, smaller = self.ahead.extend(p.forward, p.size)
        return Phrases(np.column_stack([c, p.words[owner]]), size, low, p.backward[owner] + smaller)


def enclosed(low: np.ndarray, outer: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether rows ``low`` lie in one of the disjoint outer intervals (see ``bounds``)."""
    starts, ends = outer
    if not len(starts):
        return np.zeros(len(low), dtype=bool)
    at = np.searchsorted(starts, low, side="right") - 1
    return (at >= 0) & (low < ends[at])


def bounds(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of intervals in order, and the rows behind their last."""
    order = np.argsort(low)
    return low[order], (low + size)[order]


def slices(p: Phrases, rows: int) -> Iterator[Phrases]:
    """The phrases in order, as many at a time as have ``rows`` rows together, one at least."""
    ends = np.cumsum(p.size)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - p.size[at] + rows, side="right")))
        yield p.only(slice(at, to))
        at = to


def longer(ids: np.ndarray, frequent: np.ndarray, rows: int = SLICE) -> Iterator[Phrases]:
    """Triples and quadruples all of whose pairs are in ``frequent`` (rows of two ids), from
    ``rows`` index rows at a time."""
    index = Bidirectional(ids, DEPTH)
    width = index.ahead.width
    wanted = np.unique(frequent[:, 0] * width + frequent[:, 1])
    found = []
    for words in slices(index.words(), rows):
        two = index.right(words)
        key = two.words[:, 0] * width + two.words[:, 1]
        at = np.searchsorted(wanted, key)
        found.append(two.only((at < len(wanted)) & (np.append(wanted, -1)[at] == key)))
    if not found:
        return
    pairs = Phrases(*(np.concatenate([getattr(p, c) for p in found]) for c in ("words", "size", "forward", "backward")))
    del found, wanted
    behind, before = bounds(pairs.backward, pairs.size), bounds(pairs.forward, pairs.size)
    for some in slices(pairs, rows):
        triples = index.right(some)
        triples = triples.only(enclosed(triples.backward, behind))
        four = index.left(triples)
        yield triples
        yield four.only(enclosed(four.forward, before))


# ------------------------------------------------------------------ levels


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with a dense ``id`` from 1: numbers inside partitions, shifted by the sizes of
    those before (a table of one row per partition)."""
    at = staged(words.withColumn("_m", F.monotonically_increasing_id()), "phrase-words")
    part = F.shiftright("_m", 33)
    sizes = at.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = staged(sizes.select("_p", before.alias("_o")), "phrase-offsets")
    d = at.join(F.broadcast(offsets), part == F.col("_p"))
    return d.withColumn("id", F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).drop("_m", "_p", "_o", "_c")


def frequent_words(cut: DataFrame, least: int) -> DataFrame:
    """``(lang, word, f, id)`` of the words that occur ``least`` times."""
    rows = cut.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("x")).select("x.*")
    counted = rows.groupBy(F.col("langs").alias("lang"), F.col("words").alias("word")).agg(F.sum("counts").alias("f"))
    return numbered(counted.where(F.col("f") >= least))


def with_numbers(cut: DataFrame, words: DataFrame) -> DataFrame:
    """``(shard, tokens, ids)``: tokens number the shard's frequent words from 1 (0: others and
    ends of pieces, runs of 0 made one); ``ids[token - 1]`` is the number of the word."""
    rows = cut.select("shard", F.posexplode(F.arrays_zip("langs", "words")).alias("at", "x"))
    own = rows.select("shard", "at", F.col("x.langs").alias("lang"), F.col("x.words").alias("word")).join(words.select("lang", "word", "id"), ["lang", "word"])

    def renumber(cut: pa.Table, own: pa.Table) -> pa.Table:
        kept = []
        if len(own):
            old = np.frombuffer(cut["tokens"][0].as_py(), dtype="<u4")
            at, ids = (own[c].to_numpy() for c in ("at", "id"))
            order = np.argsort(at)
            at, ids = at[order], ids[order]
            new = np.zeros(int(max(old.max(initial=0), at.max() + 1)) + 1, dtype="<u4")
            new[at + 1] = np.arange(1, len(at) + 1)
            t = np.concatenate([new[:1], new[old], new[:1]])
            t = t[np.concatenate([[True], (t[1:] > 0) | (t[:-1] > 0)])]
            kept.append((cut["shard"][0].as_py(), t.tobytes(), ids.astype("<i8").tobytes()))
        give_back()
        names, types = ("shard", "tokens", "ids"), (pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in kept], type=t) for k, t in enumerate(types)], names=names)

    shard = cut.select("shard", "tokens").groupBy("shard")
    return shard.cogroup(own.select(F.col("shard").alias("_shard"), "at", "id").groupBy("_shard")).applyInArrow(renumber, "shard long, tokens binary, ids binary")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def frequent_pairs(coded: DataFrame, least: int, ranges: int, wide: bool) -> DataFrame:
    """``(shard, a, b, f)``, packed: per shard its frequent pairs of word numbers, and, with a
    null shard, all of them once with their counts."""
    kind = "<u8" if wide else "<u4"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids = np.frombuffer(batch.column(2)[i].as_py(), dtype="<i8")
                index = Bidirectional(np.frombuffer(batch.column(1)[i].as_py(), dtype="<u4").astype(np.int32), 2)
                pairs = [(p.words, p.size) for p in map(index.right, slices(index.words(), SLICE))]
                del index
                words, n = (np.concatenate(x) for x in zip(*pairs, strict=True))
                a, b = ids[words[:, 0] - 1], ids[words[:, 1] - 1]
                del pairs, words
                place = (_mix(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)
                order = np.lexsort((b, a, place))
                a, b, n, place = a[order], b[order], n[order], place[order]
                met, at = np.unique(place, return_index=True)
                parts = [[x.tobytes() for x in np.split(y.astype(k), at[1:])] for y, k in ((a, kind), (b, kind), (n, "<u4"))]
                shard = batch.column(0)[i].as_py()
                columns = [pa.array(met, type=pa.int64()), pa.array([shard] * len(met), type=pa.int64()), *[pa.array(p[: len(met)], type=pa.binary()) for p in parts]]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "shard", "a", "b", "n"])
        give_back()

    def answer(rows: pa.Table) -> pa.Table:
        a, b, n = (np.frombuffer(b"".join(rows[c].to_pylist()), dtype=k) for c, k in (("a", kind), ("b", kind), ("n", "<u4")))
        shard, held = rows["shard"].to_numpy(), pc.binary_length(rows["n"]).to_numpy() // 4
        # pairs of numbers of 32 bits are one key
        key = None if wide else a.astype(np.uint64) << np.uint64(32) | b
        order = np.lexsort((b, a)) if wide else np.argsort(key, kind="stable")
        first = np.ones(len(a), dtype=bool)
        first[1:] = False
        for x in (a, b) if wide else (key,):
            x = x[order]
            first[1:] |= x[1:] != x[:-1]
        del x, key
        start = np.flatnonzero(first)
        total = np.add.reduceat(n[order], start, dtype=np.int64)
        keep = total >= least
        often = np.zeros(len(a), dtype=bool)
        often[order] = np.repeat(keep, np.diff(start, append=len(a)))
        out, some = [], order[start[keep]]
        del order, first, n
        if len(some):
            out.append((None, a[some].tobytes(), b[some].tobytes(), total[keep].astype("<i8").tobytes()))
        a, b = a[often], b[often]
        ends = np.cumsum(np.add.reduceat(often, np.cumsum(held) - held, dtype=np.int64))
        for s, at, to in zip(shard.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if to > at:
                out.append((s, a[at:to].tobytes(), b[at:to].tobytes(), None))
        del a, b, often
        table = pa.table([pa.array([r[k] for r in out], type=t) for k, t in enumerate((pa.int64(), *[pa.binary()] * 3))], names=["shard", "a", "b", "f"])
        give_back()
        return table

    sent = coded.mapInArrow(send, "place long, shard long, a binary, b binary, n binary")
    return sent.groupBy("place").applyInArrow(answer, "shard long, a binary, b binary, f binary")


def pair_counts(pairs: DataFrame, wide: bool) -> DataFrame:
    kind = "<u8" if wide else "<u4"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                a, b, f = (np.frombuffer(batch.column(c)[i].as_py(), dtype=k).astype(np.int64) for c, k in ((0, kind), (1, kind), (2, "<i8")))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, f)], names=["w1", "w2", "f"])

    return pairs.where("shard IS NULL").select("a", "b", "f").mapInArrow(unpack, "w1 long, w2 long, f long")


def longer_counts(coded: DataFrame, pairs: DataFrame, least: int, wide: bool) -> DataFrame:
    """``(w1, w2, w3, w4, f)`` of the frequent triples (``w4`` 0) and quadruples."""
    kind = "<u8" if wide else "<u4"
    none = F.lit(None).cast("binary")
    own = pairs.where("shard IS NOT NULL").select("shard", none.alias("tokens"), none.alias("ids"), "a", "b")
    rows = coded.select("shard", "tokens", "ids", none.alias("a"), none.alias("b")).unionByName(own)
    # a shard's ids, then the parts of its frequent pairs
    joined = rows.repartition("shard").sortWithinPartitions("shard", F.col("tokens").isNull())

    def found(t: np.ndarray, ids: np.ndarray, both: list) -> Iterator[pa.RecordBatch]:
        if not both:
            return
        # the shard's words are numbered in the order of its vocabulary, not of ids
        order = np.argsort(ids)
        local = [order[np.searchsorted(ids, np.frombuffer(b"".join(x), dtype=kind).astype(np.int64), sorter=order)] + 1 for x in zip(*both, strict=True)]
        both.clear()
        for p in longer(t, np.column_stack(local)):
            w = ids[p.words - 1]
            columns = [w[:, k] if k < w.shape[1] else np.zeros(len(w), dtype=np.int64) for k in range(DEPTH)]
            for at in range(0, len(w), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in (*columns, p.size)], names=[*GRAM, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, ids, both = None, None, []
        for batch in batches:
            for tokens_, ids_, a, b in zip(*(batch.column(k) for k in range(1, 5)), strict=True):
                if tokens_.is_valid:
                    yield from found(t, ids, both)
                    t = np.frombuffer(tokens_.as_py(), dtype="<u4").astype(np.int32)
                    ids, both = np.frombuffer(ids_.as_py(), dtype="<i8"), []
                else:
                    both.append((a.as_py(), b.as_py()))
        yield from found(t, ids, both)
        give_back()

    grams = joined.mapInArrow(run, ", ".join(f"{c} long" for c in (*GRAM, "n")))
    return grams.groupBy(*GRAM).agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def scored(grams: DataFrame) -> DataFrame:
    """Candidates ``(w1..w4, a, l, r, score)`` that no longer candidate stands for. ``grams``:
    all frequent words (w2 0), pairs, triples and quadruples with their counts ``f``."""
    zero = F.lit(0).cast("long")
    words = F.filter(F.array(*GRAM), lambda x: x > 0)
    c = grams.where("w2 > 0").select(*GRAM, F.col("f").alias("a"), words.alias("_w"))
    part = lambda j, at, size: F.when(F.lit(j) < size, F.get("_w", at + j)).otherwise(zero)
    cuts = c.select("*", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("_k"))
    k, n = F.col("_k"), F.size("_w")
    cuts = cuts.select(*GRAM, "a", "_k", *[part(j, F.lit(0), k).alias(f"_l{j}") for j in range(DEPTH)], *[part(j, k, n - k).alias(f"_r{j}") for j in range(DEPTH)])
    for side, out in (("l", "l"), ("r", "r")):
        of = grams.select(*[F.col(w).alias(f"_{side}{j}") for j, w in enumerate(GRAM)], F.col("f").alias(out))
        cuts = cuts.join(of, [f"_{side}{j}" for j in range(DEPTH)])
    score = F.expr(f"CAST(CAST({SCALE} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    lowest = cuts.withColumn("score", score).groupBy(*GRAM, "a").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_m"))
    lowest = lowest.select(*GRAM, "a", "_m.l", "_m.r", "_m.score")
    # the most frequent extension of each phrase by one word, to either side
    inner = lambda at: F.array(*[part(j, F.lit(at), F.size("_w") - 1) for j in range(DEPTH)])
    ext = c.where("w3 > 0").select("a", F.explode(F.array(inner(0), inner(1))).alias("_p"))
    ext = ext.select(*[F.get("_p", j).alias(w) for j, w in enumerate(GRAM)], "a").groupBy(*GRAM).agg(F.max("a").alias("_more"))
    left = lowest.join(ext, GRAM, "left").where(f"_more IS NULL OR 100 * CAST(_more AS DECIMAL(20,0)) < {INSIDE} * CAST(a AS DECIMAL(20,0))")
    return left.drop("_more")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, shard_words: int = SHARD) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``."""
    spark = docs.sparkSession
    with small_batches(spark):
        cut = staged(shards(docs, text_col, lang_col, shard_words), "phrase-shards", ROW_GROUPS)
    sizes = cut.select(F.explode(F.arrays_zip("langs", "counts")).alias("x"))
    n_words = staged(sizes.groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.counts").alias("n")), "phrase-sizes")
    words = frequent_words(cut, least)
    words = staged(words, "phrase-frequent")
    coded = staged(with_numbers(cut, words), "phrase-coded", ROW_GROUPS)
    seen = coded.agg(F.coalesce(F.sum(F.length("tokens")), F.lit(0)).alias("bytes")).first()
    wide = words.agg(F.max("id")).first()[0] or 0
    wide = wide >= 1 << 32
    ranges = max(1, -(-seen.bytes // 4 // RANGE))
    # a shard is one row of some MB: few rows per Arrow batch
    with small_batches(spark, 1):
        pairs = staged(frequent_pairs(coded, least, ranges, wide), "phrase-pairs")
        two = staged(pair_counts(pairs, wide), "phrase-two")
    with small_batches(spark, min(ranges, ROWS)):  # of a shard there are as many rows with pairs as ranges
        many = staged(longer_counts(coded, pairs, least, wide), "phrase-longer")
    none = F.lit(0).cast("long")
    one = words.select(F.col("id").alias("w1"), *[none.alias(w) for w in GRAM[1:]], "f")
    grams = one.unionByName(two.select("w1", "w2", none.alias("w3"), none.alias("w4"), "f")).unionByName(many)
    found = staged(scored(grams), "phrase-scored")
    named = found.select("*", F.posexplode(F.array(*GRAM)).alias("_at", "id")).where("id > 0").join(words.select("id", "lang", "word"), "id")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ")
    named = named.groupBy(*GRAM, "a", "l", "r", "score").agg(F.first("lang").alias("lang"), text.alias("phrase"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = named.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = first.withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_nth") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(n_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GRAMS = "\n  UNION ALL ".join(
    f"SELECT lang, list_reduce([{', '.join(f'x{j}' for j in range(n))}], lambda x, y: x || ' ' || y) AS g, {n} AS k FROM s WHERE x{n - 1} IS NOT NULL" for n in range(1, DEPTH + 1)
)
ORACLE = rf"""
WITH t AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT row, lang, unnest(ps) AS piece, unnest(range(len(ps))) AS pn FROM t),
q AS (SELECT row, lang, pn, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
w AS (SELECT row, lang, pn, unnest(ws) AS x0, unnest(range(len(ws))) AS i FROM q),
s AS (
  SELECT lang, x0, lead(x0, 1) OVER o AS x1, lead(x0, 2) OVER o AS x2, lead(x0, 3) OVER o AS x3
  FROM w WINDOW o AS (PARTITION BY row, pn ORDER BY i)),
g AS (SELECT lang, g, k, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
c AS (SELECT lang, g, k, f AS a, string_split(g, ' ') AS ws FROM g WHERE k > 1),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM c),
sc AS (
  SELECT cut.lang, cut.g, cut.k, cut.a, j, l.f AS l, r.f AS r, CAST(({SCALE}::HUGEINT * cut.a) // (l.f + r.f) AS BIGINT) AS score
  FROM cut JOIN g l ON l.lang = cut.lang AND l.g = array_to_string(ws[1:j], ' ') JOIN g r ON r.lang = cut.lang AND r.g = array_to_string(ws[j + 1:], ' ')),
low AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
sub AS (
  SELECT lang, array_to_string(ws[b:b + m - 1], ' ') AS g, max(a) AS more FROM (
    SELECT *, unnest(range(1, k - m + 2)) AS b FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
left_ AS (SELECT low.* FROM low LEFT JOIN sub ON sub.lang = low.lang AND sub.g = low.g WHERE more IS NULL OR 100 * more < {INSIDE} * a)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM left_) JOIN n USING (lang) WHERE rank <= {TOP}
"""
