"""Operators 11 to 13 against brute-force versions, and their defined cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tests.llm import inputs
from tracegraph.llm import centroids, divergence, phrases


# ------------------------------------------------------------------ phrases
def mined(rows, least, top):
    """The contract of op11, restated with counters."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        c = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = Counter()
        for g, a in c.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], a)
        kept = []
        for g, a in c.items():
            if 100 * inside[g] >= 80 * a and g in inside:
                continue
            cuts = [(2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            kept.append((" ".join(g), a, counts[g[:k]], counts[g[k:]], n[lang], score))
        kept.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(kept[:top])]
    return sorted(out)


def prose(seed, n):
    rnd = random.Random(seed)
    words = ["New", "york", "a", "b", "the", "of", "été", "x-y", "naïve", "😀"]
    ends = [" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "!", " ", "\x0b"]
    texts = ["".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return [(t, rnd.choice(["en", "en", "fr", None])) for t in texts]


@pytest.mark.parametrize("shard, top", [(50, 2000), (1 << 20, 7)])
def test_phrases_equal_brute_force(spark, shard, top):
    rows = prose(1, 150) + [(None, "en"), ("", None), ("a a a a a a a", "en"), ("Ⅷ ⅷ Ⅷ", "de")] * 3
    d = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", *[f"'x' AS `{c}`" for c in ("word", "f", "shard", "rank", "n")])
    got = phrases.phrases(d.repartition(3), least=4, top=top, shard_words=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == mined(rows, 4, top)


def test_phrases_of_empty_and_rare(spark):
    schema = "text string, lang string"
    assert phrases.phrases(spark.createDataFrame([], schema)).collect() == []
    assert phrases.phrases(spark.createDataFrame([("a b c", "en"), (None, None)], schema)).collect() == []


def test_index_counts_and_extensions():
    rnd = np.random.default_rng(5)
    ids = np.concatenate([[0], rnd.integers(0, 4, 400), [0]])
    index = phrases.Bidirectional(ids, 4)
    p = index.words()
    for step in (index.right, index.left, index.right):
        p = step(p)
        n = p.words.shape[1]
        seen = Counter(tuple(g) for g in np.lib.stride_tricks.sliding_window_view(ids, n).tolist() if 0 not in g)
        assert {tuple(w): s for w, s in zip(p.words.tolist(), p.size.tolist(), strict=True)} == dict(seen)
        # intervals of phrases of one length are disjoint in both directions
        for low in (p.forward, p.backward):
            order = np.argsort(low)
            assert (low[order][1:] >= (low + p.size)[order][:-1]).all()


def test_shards_end_between_pieces():
    ids = np.array([1, 2, 0, 3, 4, 5, 0, 6, 7, 8, 9, 0])
    assert phrases.shard_cuts(ids, 3) == [7, 12] and phrases.shard_cuts(ids, 100) == [12]
    assert phrases.shard_cuts(np.ones(9, dtype=int), 2) == [9]


# ---------------------------------------------------------------- centroids
def clustered(rows, k, rounds, dim):
    """The contract of op12 in Python's integers."""
    pts = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            pts.append((i, [math.floor(Fraction(x) * 64) for x in v]))
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in pts if i is not None)
    cs = [v for _, v in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in pts:
            own[near(v)[1]].append(v)
        cs = [[sum(col) // len(own[j]) for col in zip(*own[j])] if own[j] else c for j, c in enumerate(cs)]
    done = [(i, near(v)[1], near(v)[0]) for i, v in pts]
    hold = lambda x: min(x, 2**63 - 1)
    inertia = Counter()
    for _, j, d in done:
        inertia[j] += hold(d)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted([(i, j, hold(d), hold(inertia[j]), hold(sum(inertia.values())), sha[j]) for i, j, d in done], key=repr)


@pytest.mark.parametrize("scale, dim, k", [(1.0, 8, 4), (1e30, 5, 3), (0.05, 3, 16)])
def test_centroids_equal_brute_force(spark, scale, dim, k):
    rnd = random.Random(int(scale) + dim)
    rows = [(i, [rnd.gauss(0, 1) * scale for _ in range(dim)]) for i in range(90)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (200, None), (201, []), (202, [1.0] * (dim - 1)), (203, [None] + [1.0] * (dim - 1)), (204, [float("nan")] * dim), (205, [float("inf")] * dim)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "'x' AS v")
    got = centroids.cluster(d.repartition(4), k=k, dim=dim)
    assert sorted(map(tuple, got.collect()), key=repr) == clustered(rows, k, 3, dim)


def test_centroids_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(None, [1.0, 2.0])]):
        assert centroids.cluster(spark.createDataFrame(rows, schema), dim=2).collect() == []
    got = centroids.cluster(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), dim=2).collect()
    # equal vectors, two equal centroids: the smaller number wins, the empty one stays
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}


def test_threshold_walk_meets_ties():
    lists = centroids.SortedLists([[5, 0], [-5, 0], [0, 5], [0, 5]])
    number, gap = lists.nearest(np.array([[0, 0], [0, 1], [7, 7], [-9, 0]]))
    assert number.tolist() == [0, 2, 0, 1] and gap.tolist() == [25, 16, 53, 16]
    assert [sum(x << (centroids.LIMB * i) for i, x in enumerate(centroids.limbs(n))) for n in (0, -1, 2**200, -(3**150))] == [0, -1, 2**200, -(3**150)]


# --------------------------------------------------------------- divergence
def judged_base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_base_counts_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["a", "bb", "c#", "é😀", " ", " ", "\n", "\t", "\r\n", "|"]) for _ in range(rnd.randint(0, 300))) for _ in range(120)]
    texts += ["a b c d e " * 40, "x " * 9, "one two three four five six seven eight nine ten", "a a a a a a", "\n\n \n", "l\nl\nl\n", "long " * 20000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = divergence.quality(inputs.docs(spark, rows + [(900, None, None, None)]))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    for r in got.collect():
        assert tuple(r[1:7]) == judged_base(texts[r.doc_id] if r.doc_id < 900 else None), r
        assert not (r.base_failed and r.kept)


def shannon(p, q):
    a, b = sum(p), sum(q)
    part = lambda x, m: x * math.log2(x / m) if x else 0.0
    return math.sqrt(max(0.0, sum(part(x / a, (x / a + y / b) / 2) + part(y / b, (x / a + y / b) / 2) for x, y in zip(p, q)) / 2))


def classes_of(t):
    left, out = t, []
    for pattern in divergence.CLASSES.values():
        n = len(left)
        left = re.sub(pattern, "", left)
        out.append(n - len(left))
    return [*out, len(left)]


def test_quality_verdict_is_the_divergence(spark):
    rnd = random.Random(9)
    usual = ["the", "of", "and", "to", "in", "is", "it", "for"]
    rare = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    prose = lambda n: " ".join(rnd.choice(usual) if rnd.random() < 0.5 else rare() for _ in range(n))
    rows = [(i, prose(150), "en", "s") for i in range(40)]
    rows += [(100, " ".join(rare() for _ in range(150)), "en", "s"), (101, " ".join(w + "%%%" for w in prose(150).split()), "en", "s")]
    rows += [(102, " ".join(rare() for _ in range(99)), "en", "s"), (103, prose(150).upper(), None, "s")]
    got = {r.doc_id: r for r in divergence.quality(inputs.docs(spark, rows), common=8).collect()}
    assert all(got[i].kept for i in range(40))
    assert not got[100].kept and got[100].word_distance > 0.35 and got[100].class_distance < 0.32
    assert not got[101].kept and got[102].kept and got[102].word_distance is None
    # the only text of its language is its own reference
    assert got[103].kept and got[103].class_distance == pytest.approx(0, abs=1e-6)
    texts = {i: t for i, t, lang, _ in rows if lang}
    ref = [0] * (len(divergence.CLASSES) + 1)
    for t in texts.values():
        c = classes_of(t)
        ref = [x + y * 1_000_000 // len(t) for x, y in zip(ref, c)]
    for i in (0, 7, 101):
        assert got[i].class_distance == pytest.approx(shannon(classes_of(texts[i]), ref), abs=1e-9)
    df = Counter(w for i, t in texts.items() if len(t.split()) >= 100 for w in set(t.lower().split()))
    top = [w for w, _ in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:8]]
    hist = lambda t: [*(t.lower().split().count(w) for w in top), sum(w not in top for w in t.lower().split())]
    ref = [0] * 9
    for t in texts.values():
        if len(t.split()) >= 100:
            ref = [x + y * 1_000_000 // len(t.split()) for x, y in zip(ref, hist(t))]
    for i in (0, 100):
        assert got[i].word_distance == pytest.approx(shannon(hist(texts[i]), ref), abs=1e-9)


def test_quality_edges(spark):
    got = divergence.quality(inputs.docs(spark)).collect()
    assert len(got) == len(inputs.ROWS) and sum(r.doc_id is None for r in got) == 1
    assert divergence.quality(inputs.docs(spark, [])).collect() == []
    plan = divergence.quality(inputs.docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
    with pytest.raises(ValueError):
        divergence.quality(inputs.docs(spark), common=63)
