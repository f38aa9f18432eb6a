"""Toxicity by a subsequence string kernel and a linear SVM over Nystrom landmarks.

The kernel (Lodhi et al., 2002, with a bounded span) compares two words by the character
subsequences of length 3 and 4 they share, each weighted by ``DECAY`` to the power of the
stretch it spans, up to ``SPAN`` characters. An insult with inserted or missing characters
still shares most of its subsequences. Landmarks are words of the training texts; with K their
kernel matrix, a word u becomes K^(-1/2) [k(u, z_1) ... k(u, z_m)] (Nystrom), on which a
linear SVM with squared hinge loss is trained.

Labels are given for documents, so the toxic words of a toxic document are found by
multiple-instance rounds: first its words that speak most for toxic documents are positive,
then those the last model finds. A document scores the logistic calibration of its best word.
Misspellings of the witnesses (``misspelt``) are trained on with them, as virtual examples: the
boundary is to hold when letters are put in, left out or changed, not for the plain word alone.

Not done: texts are not cut into sentences, and words are not summed. Landmarks and witnesses
have at least ``LENGTHS[0]`` letters, and witnesses are at least ``RATIO`` times as frequent in
toxic documents; so a text that is toxic by a phrase of ordinary words, or by words of up to
two letters, gives no positive in training and is not known by that phrase in scoring.

Because kernel and SVM are linear in the subsequences of a word, the trained model folds
into one weight per subsequence (a table of 4 MB): scoring a word is a gather over its
subsequences, done once per distinct word and task, and costs nothing per landmark.

Words are lower-cased, accents stripped, look-alike digits and signs read as letters, and
other signs dropped; runs of single letters (``i d i o t``) are read as one word, and so are the
letters between which one and the same stands; words of more than 12 letters are read in overlapping
windows of two lengths, of which the best counts (the short ones find an insult between padding), so
whole texts count. Training uses at most
``SAMPLE`` documents of each label, the ones smallest by a hash, of at most ``SAMPLE_CHARS``
characters each; scoring reads every text whole.

Defined cases: null, empty and wordless texts score as a plain word; without both
labels in the training part every score is the share of toxic labels (0 without labels);
labels of unknown documents and null labels are ignored; a document labelled twice counts
as toxic if any label says so; repeated rows score alike.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

LENGTHS, SPAN, DECAY = (3, 4), 8, 0.8
LANDMARKS, SAMPLE, SAMPLE_CHARS = 384, 1500, 20_000
#: letters and steps of the windows of a word longer than the second
WINDOWS = ((24, 12), (12, 4))
#: witnesses of a toxic text, which must be this many times as frequent there; hardest words
#: of clean texts added per round; weight of the errors
WITNESSES, RATIO, HARD, COST = 2, 5.0, 3000, 4000.0
#: words a worker remembers, and texts it scores at a time: both bound its memory
CACHE, ROWS = 200_000, 256
#: rows of the training matrix that are widened or multiplied at a time: the driver trains
BLOCK = 1024
#: witnesses whose misspellings are trained on, those of most toxic texts
VARIED = 256
THRESHOLD = 0.3
TABLE = 32**3 + 32**4
#: digits and signs read as the letters they look like
LOOKALIKE = dict(zip("013457@$!|", "oieastasil", strict=True))
#: signs around a word, not part of it
EDGE = "!?.,;:|\"'()[]{}<>*&%$#@+-_=/~`"


class _Codes(dict):
    """Code point to the code of its letter, as a character, for str.translate."""

    def __missing__(self, point: int):
        c = LOOKALIKE.get(chr(point), chr(point))
        self[point] = chr(ord(c) - 97) if "a" <= c <= "z" else chr(26 + point % 6) if c.isalnum() else None
        return self[point]


_CODES = _Codes()


def letters(word: str) -> np.ndarray:
    """Codes 0..25 for a-z, 26..31 for other letters and digits; other signs are dropped."""
    w = word.strip(EDGE).lower()
    if not w.isascii():
        w = unicodedata.normalize("NFKD", w)
    return np.frombuffer(w.translate(_CODES).encode("latin-1"), dtype=np.uint8)


def windows(codes: np.ndarray) -> list[np.ndarray]:
    """The units of a word, the whole word (or its first long window) before the others."""
    n = len(codes)
    if n <= WINDOWS[1][0]:
        found = [codes]
    else:
        found = [codes[i : i + size] for size, step in WINDOWS for i in range(0, max(1, n - size + step), step)]
    # one letter between all others separates them, as a sign would
    if n >= 2 * LENGTHS[1] - 1 and (codes[1::2] == codes[1]).all():
        found += windows(codes[::2])
    return found


def misspelt(codes: np.ndarray) -> list[np.ndarray]:
    """Spellings of a word that hide it: a letter put in, left out or changed at every place within
    it, letters put between all of its own, and padding around it. The letters follow from the word."""
    n, seed = len(codes), int(codes.astype(np.int64) @ (np.arange(len(codes)) + 7))
    strange = lambda i: (seed + 11 * i) % 26
    filled = lambda step: np.array([c for i, own in enumerate(codes) for c in (own, strange(i * step))][:-1], dtype=np.uint8)
    pad = np.full(3, strange(0), dtype=np.uint8)
    out = [np.insert(codes, i, strange(i)) for i in range(1, n)] + [np.delete(codes, i) for i in range(1, n - 1) if n > LENGTHS[1]]
    out += [np.concatenate([codes[:i], [strange(i + 5)], codes[i + 1 :]]).astype(np.uint8) for i in range(1, n - 1)]
    out += [filled(0), filled(1), np.concatenate([pad, codes, pad])]
    return [v[: WINDOWS[0][0]] for v in out]


@cache
def places(length: int):
    """Per subsequence length, the positions of all subsequences of a word and their
    weights, scaled so that a word without repeated letters has norm 1."""
    out = []
    for n in LENGTHS:
        at = [(i, *(i + 1 + x for x in rest)) for i in range(length) for rest in combinations(range(min(SPAN, length - i) - 1), n - 1)]
        at = np.array(at, dtype=np.int64).reshape(-1, n)
        out.append((at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)))
    norm = np.sqrt(sum((w**2).sum() for _, w in out)) or 1.0
    return [(at, (w / norm).astype(np.float32)) for at, w in out]


def subsequences(codes: np.ndarray):
    """``codes`` (words, length) to table rows and weights of their subsequences."""
    ids, weights = [], []
    for n, (at, w) in zip(LENGTHS, places(codes.shape[1]), strict=True):
        key = np.zeros((len(codes), len(at)), dtype=np.int64)
        for k in range(n):
            key = key * 32 + codes[:, at[:, k]]
        ids.append(key + (0 if n == LENGTHS[0] else 32**3))
        weights.append(w)
    return np.concatenate(ids, axis=1), np.concatenate(weights)


def by_length(units: list[np.ndarray], rows: int = 500):
    """(indices, matrix) of units of equal length, a bounded number at a time."""
    lengths = np.array([len(u) for u in units], dtype=np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        if n >= LENGTHS[0]:
            for i in range(0, len(at), rows):
                yield at[i : i + rows], np.stack([units[k] for k in at[i : i + rows]])


def values(units: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """The model's value of each unit: its subsequences' weights, summed; a unit too short
    to have any says nothing (minus infinity)."""
    out = np.full(len(units), -np.inf)
    for at, codes in by_length(units):
        ids, w = subsequences(codes)
        out[at] = table[ids] @ w
    return out


def kernel(units: list[np.ndarray], landmarks: list[np.ndarray]) -> np.ndarray:
    """k(unit, landmark) for all pairs, over the subsequences that landmarks have."""
    own = np.concatenate([np.unique(subsequences(z[None, :])[0]) for z in landmarks])
    own = np.unique(own)
    column = np.zeros(TABLE, dtype=np.int32)
    column[own] = np.arange(1, len(own) + 1)
    of = np.zeros((len(own) + 1, len(landmarks)), dtype=np.float32)
    for j, z in enumerate(landmarks):
        ids, w = subsequences(z[None, :])
        np.add.at(of[:, j], column[ids[0]], w)
    out = np.zeros((len(units), len(landmarks)), dtype=np.float32)
    for at, codes in by_length(units, 64):
        ids, w = subsequences(codes)
        for row, cols in zip(at, column[ids], strict=True):
            hit = cols > 0
            out[row] = w[hit] @ of[cols[hit]]
    return out


class Words:
    """What is known of each distinct token: its units and whether it is one letter; with a
    table, the value of its best unit instead of the units."""

    def __init__(self, table: np.ndarray | None = None):
        self.table = table
        self._clear()

    def _clear(self):
        self.number: dict[str, int] = {}
        self.units: list[list[np.ndarray]] = []
        self.value, self.single = np.zeros(0), np.zeros(0, dtype=bool)

    def add(self, texts: list[list[str]]) -> None:
        if self.table is not None and len(self.number) > CACHE:
            self._clear()
        new = list(dict.fromkeys(w for t in texts for w in t if w not in self.number))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        units = [windows(letters(w)) for w in new]
        self.single = np.concatenate([self.single, np.array([len(u[0]) == 1 for u in units], dtype=bool)])
        if self.table is None:
            self.units += units
        else:
            self.value = np.concatenate([self.value, best_of(units, self.table)])

    def read(self, tokens: list[str]):
        """Token numbers, and the units of words spelt in single letters."""
        at = np.fromiter(map(self.number.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        one = np.concatenate([[False], self.single[at], [False]])
        edges = np.flatnonzero(one[1:] != one[:-1])
        runs = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= LENGTHS[0]]
        return at, [u for a, b in runs for u in windows(np.concatenate([letters(w) for w in tokens[a:b]]))]


def best_of(units: list[list[np.ndarray]], table: np.ndarray) -> np.ndarray:
    """The value of the best unit of each word."""
    flat = values([x for u in units for x in u], table)
    starts = np.cumsum([0] + [len(u) for u in units])[:-1]
    return np.maximum.reduceat(flat, starts) if len(flat) else flat


class Model:
    """``table`` of subsequence weights, bias, and the logistic calibration (slope, offset)."""

    def __init__(self, table, bias, slope, offset):
        self.table, self.bias, self.slope, self.offset = table, bias, slope, offset

    def margins(self, texts: list[str], words: Words) -> np.ndarray:
        """Of the best word; of a plain word for a text without any."""
        split = [t.split() for t in texts]
        words.add(split)
        best = np.full(len(texts), -np.inf)
        for i, tokens in enumerate(split):
            if tokens:
                at, spelt = words.read(tokens)
                best[i] = max(words.value[at].max(), values(spelt, self.table).max() if spelt else -np.inf)
        return np.where(np.isfinite(best), best + self.bias, -1.0)

    def score(self, texts: list[str], words: Words) -> np.ndarray:
        return logistic(self.slope * self.margins(texts, words) + self.offset)


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30):
    """Squared-hinge linear SVM with an intercept, by Newton steps on its active set. The second
    derivatives are summed over ``BLOCK`` rows at a time: ``x`` is never copied."""
    d = x.shape[1]
    ridge = np.ones(d + 1)
    ridge[-1] = 1e-6
    v = np.zeros(d + 1)
    slack_of = lambda v: 1 - y * (x @ v[:-1] + v[-1])
    loss = lambda v: 0.5 * (ridge * v * v).sum() + (weight * np.maximum(0, slack_of(v)) ** 2).sum()
    for _ in range(steps):
        slack = slack_of(v)
        on = np.flatnonzero(slack > 0)
        pull = np.where(slack > 0, 2 * weight * y * slack, 0.0)
        grad = ridge * v - np.append(x.T @ pull, pull.sum())
        hess = np.diag(ridge)
        for i in range(0, len(on), BLOCK):
            at = on[i : i + BLOCK]
            xa, wa = np.concatenate([x[at], np.ones((len(at), 1))], axis=1), 2 * weight[at]
            hess += xa.T @ (xa * wa[:, None])
        step, rate, now = np.linalg.solve(hess, grad), 1.0, loss(v)
        while loss(v - rate * step) > now and rate > 1e-4:
            rate /= 2
        v = v - rate * step
        if np.abs(rate * step).max() < 1e-5:
            break
    return v[:-1], v[-1]


def projected(parts: list[np.ndarray], root: np.ndarray) -> np.ndarray:
    """The rows of ``parts``, one below the other, times ``root``: ``BLOCK`` rows are widened at a time."""
    out, at = np.empty((sum(len(p) for p in parts), root.shape[1])), 0
    for p in parts:
        for i in range(0, len(p), BLOCK):
            some = p[i : i + BLOCK]
            out[at : at + len(some)] = some @ root
            at += len(some)
    return out


def calibrate(margin: np.ndarray, y: np.ndarray):
    """Platt's logistic fit with his smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, v = np.stack([margin, np.ones(len(margin))], axis=1), np.zeros(2)
    for _ in range(50):
        p = logistic(x @ v)
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - t) + 1e-6 * v)
        v = v - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(v[0]), 1e-3), float(v[1])


def spread(order, units, most: int, near: float = 0.8) -> list[int]:
    """The first of ``order`` that are not nearly the same (kernel at least ``near``)."""
    chosen: list[int] = []
    held = np.zeros(TABLE, dtype=np.float32)
    for i in order:
        if len(chosen) == most:
            break
        ids, w = subsequences(units[i][0][None, :])
        if float(held[ids[0]] @ w) < near:
            chosen.append(i)
            np.maximum.at(held, ids[0], w)
    return chosen


def batches(texts: list[str]):
    """``ROWS`` texts at a time: the tokens of more are never held."""
    return (texts[i : i + ROWS] for i in range(0, len(texts), ROWS))


def train(texts: list[str], labels: list[int], most: int = LANDMARKS, rounds: int = 4) -> Model:
    y = np.where(np.array(labels, dtype=float) > 0, 1.0, -1.0)
    share = float((y > 0).mean()) if len(y) else 0.0
    plain = Model(np.zeros(TABLE, dtype=np.float32), 0.0, 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else 500.0 if share else -500.0)
    if not 0 < share < 1:
        return plain
    # every fourth document of each label is kept for the calibration
    turn = np.where(y > 0, np.cumsum(y > 0), np.cumsum(y <= 0))
    own = (turn % 4 != 0) | (len(y) < 40)
    words, docs = Words(), []
    for some in batches([t for t, o in zip(texts, own, strict=True) if o]):
        split = [t.split() for t in some]
        words.add(split)
        docs += [np.unique(words.read(t)[0]) for t in split]
    toxic = y[own] > 0
    n = len(words.number)
    counts = np.zeros((2, n))
    for at, t in zip(docs, toxic, strict=True):
        counts[int(t), at] += 1
    a, b = counts[1] + 0.5, counts[0] + 0.5
    odds = np.log(a / (toxic.sum() - counts[1] + 0.5)) - np.log(b / ((~toxic).sum() - counts[0] + 0.5))
    sure = odds / np.sqrt(1 / a + 1 / b)
    fit = np.array([len(u[0]) >= LENGTHS[0] for u in words.units])
    clean = np.flatnonzero(counts[0] > 0)
    # landmarks: words whose presence speaks for toxic documents, and ordinary ones, frequent to rare
    bad = [i for i in np.argsort(-sure, kind="stable")[: 8 * most] if fit[i] and sure[i] > 1]
    usual = [i for i in clean[np.argsort(-counts[0, clean], kind="stable")] if fit[i] and sure[i] <= 1]
    marks = spread(bad, words.units, most * 2 // 3) + spread(usual[:: max(1, len(usual) // (4 * most))], words.units, most // 3)
    if not marks:
        return plain
    landmarks = [words.units[i][0] for i in marks]
    values_, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(float))
    keep = values_ > 1e-3
    root = (vectors[:, keep] / np.sqrt(values_[keep])) @ vectors[:, keep].T  # K^(-1/2)

    # latent rounds: a toxic text is witnessed by its best words, a clean one by all of its words,
    # of which those are kept that the last model finds hardest
    able = fit & (counts[1] / toxic.sum() >= RATIO * counts[0] / max(1, (~toxic).sum()))
    evidence = np.where(able, sure, -np.inf)
    hard = set(clean[:: max(1, len(clean) // HARD)].tolist()) | set(clean[np.argsort(-counts[0, clean], kind="stable")[:HARD]].tolist())
    rows: dict[int, np.ndarray] = {}
    spelt: dict[int, np.ndarray] = {}
    table, bias = np.zeros(TABLE, dtype=np.float32), 0.0
    for _ in range(rounds):
        weight: dict[int, float] = {}
        for at, t in zip(docs, toxic, strict=True):
            if t and len(at):
                top = at[np.argsort(-evidence[at], kind="stable")[:WITNESSES]]
                top = top[(evidence[top] > 0) | (np.arange(len(top)) == 0)]
                for i in top[np.isfinite(evidence[top])].tolist():
                    weight[i] = weight.get(i, 0.0) + 1.0 / len(top)
        if not weight:
            return plain
        pos, neg = sorted(weight), sorted(hard)
        new = [i for i in {*pos, *neg} if i not in rows]
        rows.update(zip(new, kernel([words.units[i][0] for i in new], landmarks), strict=True))
        # virtual examples: the misspellings of a witness share its weight among them
        varied = sorted(pos, key=lambda i: (-weight[i], i))[:VARIED]
        spellings = {i: misspelt(words.units[i][0]) for i in varied if i not in spelt}
        if spellings:
            ends = np.cumsum([len(s) for s in spellings.values()])
            spelt.update(zip(spellings, np.split(kernel([u for s in spellings.values() for u in s], landmarks), ends[:-1]), strict=True))
        x = projected([np.stack([rows[i] for i in pos]), *(spelt[i] for i in varied), np.stack([rows[i] for i in neg])], root)
        ys = np.concatenate([np.ones(len(x) - len(neg)), -np.ones(len(neg))])
        w_pos = np.concatenate([[weight[i] for i in pos], *(np.full(len(spelt[i]), weight[i] / len(spelt[i])) for i in varied)])
        w_neg = np.minimum(counts[0, neg], 100.0)
        v, bias = svm(x, ys, np.concatenate([COST * w_pos / w_pos.sum(), COST * w_neg / w_neg.sum()]))
        folded = np.zeros(TABLE)
        for z, alpha in zip(landmarks, root @ v, strict=True):
            ids, w = subsequences(z[None, :])
            np.add.at(folded, ids[0], alpha * w)
        table = folded.astype(np.float32)
        margin = best_of(words.units, table) + bias
        evidence = np.where(able, margin, -np.inf)
        worst = clean[np.argsort(-margin[clean], kind="stable")[:HARD]]
        hard |= set(worst[margin[worst] > -1].tolist())
    model = Model(table, float(bias), 1.0, 0.0)
    held = ~own if (~own & (y > 0)).any() and (~own & (y <= 0)).any() else own
    known = Words(table)
    margin = np.concatenate([model.margins(some, known) for some in batches([t for t, h in zip(texts, held, strict=True) if h])])
    model.slope, model.offset = calibrate(margin, y[held])
    return model


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, sample_chars: int):
    """At most ``sample`` documents of each label outside the held-out part."""
    marked = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("_toxic"))
    d = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where(F.char_length("_text") <= sample_chars)
    order = [F.xxhash64(F.col(id_col), F.lit("toxicity")), F.col(id_col)]
    ids = None
    for toxic in (0, 1):
        some = marked.where((F.col("_toxic") > 0) == bool(toxic)).orderBy(*order).limit(sample).select(id_col, F.lit(toxic).alias("_y"))
        ids = some if ids is None else ids.unionByName(some)
    # at most 2 * sample rows of two numbers: a proven bound
    return d.join(F.broadcast(ids), id_col).orderBy(*order).select("_text", "_y").limit(2 * sample).toPandas()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    rows = training_sample(docs, labels, id_col, text_col, label_col, sample, sample_chars)
    texts, marks = rows["_text"].tolist(), rows["_y"].tolist()
    del rows
    model = train(texts, marks)
    del texts, marks
    give_back()
    return model


_WORDS: dict = {}


def _forget() -> None:
    _WORDS.clear()
    give_back()


def _scorer(spark, model: Model):
    """A function that scores the texts of a task, keeping what it learns of words until its end."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> np.ndarray:
        m = shared.value
        key = (m.bias, m.slope, m.offset)
        if key not in _WORDS:
            _WORDS.clear()
            _WORDS[key] = Words(m.table)
        some = (texts.slice(at, ROWS).to_pylist() for at in range(0, len(texts), ROWS))
        return np.concatenate([np.zeros(0), *(m.score([t or "" for t in part], _WORDS[key]) for part in some)])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row."""
    scores = _scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(scores(b.column(2)), type=pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], names=["doc_id", "held_out", "score"])
        _forget()

    d = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    scored = d.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, in one
    pass without a join."""
    scores = _scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(b.column(b.schema.get_field_index(text_col))) < threshold))
        _forget()

    return docs.mapInArrow(run, docs.schema)
