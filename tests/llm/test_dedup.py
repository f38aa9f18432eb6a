import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm import inputs
from tracegraph.llm import exact_dedup, line_dedup, ngram_join, shingles
from tracegraph.llm.common import components


def norm(text):
    return re.sub("[ \t-\r]", "", text or "")


def test_exact_dedup_edges(spark):
    got = {}
    for r in exact_dedup.exact_dedup(inputs.docs(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(inputs.ROWS)
    assert got[1][0].keep_id == got[2][0].keep_id == 1 and got[1][0].kept and not got[2][0].kept
    # null, empty and white texts are equal; the one with the most code points stays
    assert {got[i][0].keep_id for i in (4, 5, 6)} == {6} and got[4][0].group_size == 3
    assert [r.kept for r in got[8]] == [True, True] and got[8][0].group_size == 2
    assert got[9][0].group_size == 1 and got[None][0].kept
    for r in (x[0] for x in got.values()):
        text = next(t for i, t, *_ in inputs.ROWS if i == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(norm(text).encode()).hexdigest()


def test_exact_dedup_heavy_hitters_decide_alike(spark):
    rows = [(i, f"t{i % 7}" + " " * (i % 3), "en", "s") for i in range(300)] + [(1000 + i, f"single {i}", "en", "s") for i in range(50)]
    d = inputs.docs(spark, rows)
    by_broadcast, by_shuffle = exact_dedup.exact_dedup(d, heavy=7), exact_dedup.exact_dedup(d, heavy=1, tracked=8)
    cols = ("doc_id", "keep_id", "group_size", "kept")
    assert inputs.rows_of(by_broadcast, *cols) == inputs.rows_of(by_shuffle, *cols)
    kept = exact_dedup.without_copies(d)
    assert kept.columns == d.columns and kept.count() == 57


def test_exact_dedup_empty(spark):
    d = inputs.docs(spark, [])
    assert exact_dedup.exact_dedup(d).collect() == [] and exact_dedup.without_copies(d).collect() == []


def test_exact_dedup_longest_row_without_id(spark):
    """One row stays, by broadcast and by shuffle, when the longest of a group has no id."""
    groups = {"a": 40, "b": 3}
    rows = [(100 * k + i, f"{t} copy", "en", "s") for k, (t, n) in enumerate(groups.items(), 1) for i in range(n)]
    rows += [(None, f"{t}  copy" + " " * j, "en", "s") for t in groups for j in range(3)] + [(None, x, "en", "s") for x in ("c", "c ", "d  ", "d")] + [(7, "d ", "en", "s")]
    d = inputs.docs(spark, rows)
    for heavy in (1, 256):
        got = exact_dedup.exact_dedup(d, heavy=heavy, tracked=max(8, heavy)).collect()
        assert len(got) == len(rows)
        for t in (*[f"{t}copy" for t in groups], "c", "d"):
            group = [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
            assert [(r.doc_id, r.kept) for r in group if r.kept] == [(None, True)] and {r.keep_id for r in group} == {None}
    assert sorted(r.text for r in exact_dedup.without_copies(d).collect()) == ["a  copy  ", "b  copy  ", "c ", "d  "]


def brute_sets(text):
    words = [w for w in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute_components(rows):
    sets = {i: brute_sets(t) for i, t in rows}
    names = sorted(sets)
    comp = {i: i for i in names}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    links = dict.fromkeys(names, 0)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), links[i]) for i in names}


def near_copies(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 40, 90]))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words = words + [rng.choice(vocabulary) for _ in range(rng.randrange(4))]
        rows.append((rng.randrange(10**12) if seed % 2 else i, rng.choice([" ", "\n", " \t"]).join(w.upper() if rng.random() < 0.1 else w for w in words), "en", "s"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_duplicates(inputs.docs(spark, rows)).collect()}
    assert got == brute_components([r[:2] for r in rows])


def test_ngram_join_small_blocks(spark, monkeypatch):
    """Links between many blocks and parts are found as in one."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    monkeypatch.setattr(ngram_join, "PART_DOCS", 5)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rows = near_copies(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_duplicates(inputs.docs(spark, rows)).collect()}
    assert got == brute_components([r[:2] for r in rows])


@pytest.mark.parametrize("seed, block", [(4, 7), (5, 512), (6, 2)])
def test_classes_without_counting_links(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    rows = near_copies(seed)
    got = ngram_join.near_duplicates(inputs.docs(spark, rows), count_links=False)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == {i: x[:2] for i, x in brute_components([r[:2] for r in rows]).items()}


@pytest.mark.parametrize("families, size", [(20, 6), (2, 40)])
def test_what_shares_entries_meets_in_few_blocks(spark, monkeypatch, families, size):
    """Documents that share a passage without being near copies: a family of at most a block is one
    group, and the rows brought together follow the documents, not the pairs of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 12)
    kept, staged = {}, ngram_join.staged
    monkeypatch.setattr(ngram_join, "staged", lambda df, tag: kept.setdefault(tag, staged(df, tag)))
    passage = lambda f: " ".join(f"f{f}w{k}" for k in range(40))
    rows = [(100 * f + i, passage(f) + "".join(f" d{f}i{i}k{k}" for k in range(5)), "en", "s") for f in range(families) for i in range(size)]
    got = ngram_join.near_duplicates(inputs.docs(spark, rows), count_links=False)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == {i: (41, i) for i, *_ in rows}
    members = kept["ngram-members"]
    assert members.select("doc_id").distinct().count() == len(rows)
    # a family of 40 takes 4 blocks of its own, each meets the others at most
    assert members.count() <= len(rows) * (1 if size <= 12 else 4)


def test_words_do_not_collide_by_construction():
    for a, b in (("a", "b"), ("abcdefgh" * 3, "hgfedcba" * 3)):
        for k in range(1, 13):  # Thue-Morse words: equal under any polynomial modulo a power of 2
            one, two = a, b
            for _ in range(k):
                one, two = one + two, two + one
            h, _ = shingles.word_hashes([f"{one} {two} {one.upper()}"])
            assert h[0] != h[1] and h[0] == h[2]
    h, n = shingles.word_hashes([" ".join("x" * i for i in range(1, 200)), "", "é"])
    assert len(set(h.tolist())) == 200 and n.tolist() == [199, 0, 1]


def test_ngram_join_edges(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_duplicates(inputs.docs(spark)).collect()}
    expected = brute_components([(i, t) for i, t, *_ in inputs.ROWS if i is not None])
    assert got == expected and got[4] == (0, 4, 0) and got[9] == (1, 8, 1)
    one = ngram_join.one_of_each(inputs.docs(spark))
    assert sorted(r.doc_id for r in one.collect() if r.doc_id) == sorted(i for i, *_ in inputs.ROWS if i and expected[i][1] == i)
    assert one.columns == inputs.docs(spark).columns and one.where("doc_id IS NULL").count() == 1
    assert ngram_join.near_duplicates(inputs.docs(spark, [])).collect() == []


def test_prefix_tree_equals_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(150):
        base, found = rng.integers(0, 2**63, 30).astype(np.uint64), {}
        for _ in range(rng.integers(2, 14)):
            part = base[rng.random(30) < rng.choice([0.7, 0.9, 0.97, 1])]
            s = np.unique(np.concatenate([part, rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)]))
            found[s.tobytes()] = s
        sets = [s for s in found.values() if len(s)]
        side = None if trial % 2 else np.arange(len(sets)) % 2
        linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        expected = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if (side is None or side[a] != side[b]) and linked(sets[a], sets[b])}
        assert {tuple(sorted(p)) for p in ngram_join.PrefixTree(sets).links(side)} == expected


def test_shingles_of_many_texts_equal_those_of_one():
    texts = [t for _, t, *_ in inputs.ROWS] + ["a b c d e f g", "A B c d e"]
    together, alone = shingles.shingle_sets(texts), [shingles.shingle_sets([t])[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(together, alone, strict=True))
    assert [len(s) for s in together] == [len(brute_sets(t)) for t in texts]


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(300, 340)] + [(7, 7)]
    nodes = sorted({x for p in links for x in p} | {1})
    n, e = spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components(n, e).collect()}
    assert got == {i: 100 if 100 <= i <= 160 else 300 if i >= 300 else i for i in nodes}


def test_line_dedup_edges(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [
        (1, f"head\n{passage}\ntail", "en", "s"),
        (2, f"  {passage.upper()}  \nother line", "en", "s"),
        (3, f"x\n{passage}", "en", "s"),
        (4, passage, "en", "s"),
        (5, f"{passage}\n{passage}\nend", "en", "s"),
        (6, None, "en", "s"),
        (7, "head\n", "en", "s"),
        (None, passage, "en", "s"),
        (8, "😀 " + passage + "\n" + passage, "en", "s"),
        (8, "😀 " + passage + "\n" + passage, "en", "s"),
    ]
    got = {}
    for r in line_dedup.line_dedup(inputs.docs(spark, rows), min_words=10).collect():
        got.setdefault(r.doc_id, []).append(r)
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        for s in r.removed:  # offsets point to the removed unit in the original text
            assert " ".join(text[s.start : s.end].lower().split()) == passage
    clean = {k: v[0].clean_text for k, v in got.items()}
    assert clean == {1: rows[0][1], 2: "other line", 3: "x", 4: "", 5: "end", 6: "", 7: "head\n", None: "", 8: "😀 " + passage}
    assert len(got[8]) == 2 and got[2][0].removed[0].first_doc == 1
    assert line_dedup.line_dedup(inputs.docs(spark, [])).collect() == []
    assert line_dedup.line_dedup(inputs.docs(spark)).count() == len(inputs.ROWS)


def test_line_dedup_short_units(spark):
    """With min_words=1 every unit but a blank one is grouped, and only what is removed goes."""
    rows = [
        (1, "yes\n\n \nyes\nno", "en", "s"),
        (2, "own\n\nNO", "en", "s"),
        (3, "\n\n", "en", "s"),
        (4, "日本語の長い行です", "ja", "s"),
        (5, "日本語の長い行です\n\nlast", "ja", "s"),
    ]
    d = inputs.docs(spark, rows)
    got = {r.doc_id: r.clean_text for r in line_dedup.line_dedup(d, min_words=1).collect()}
    assert got == {1: "yes\n\n \nno", 2: "own\n", 3: "\n\n", 4: rows[3][1], 5: "\nlast"}
    assert {r.doc_id: r.clean_text for r in line_dedup.line_dedup(d).collect()} == {i: t for i, t, *_ in rows}


def test_line_dedup_last_unit_keeps_blank_lines_before(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, passage, "en", "s"), (2, f"x\n\n{passage}", "en", "s")]
    got = {r.doc_id: r.clean_text for r in line_dedup.line_dedup(inputs.docs(spark, rows), min_words=10).collect()}
    assert got == {1: passage, 2: "x\n"}


def test_line_dedup_passages_of_short_and_rewrapped_lines(spark):
    words = [f"w{i}" for i in range(60)]
    wrapped = "\n".join(" ".join(words[i : i + 6]) for i in range(0, 60, 6))
    other = "\n".join(" ".join(words[i : i + 9]) for i in range(0, 60, 9))
    rows = [
        (1, f"start one\n\n{wrapped}\n\nend one", "en", "s"),
        (2, f"start two\n{wrapped}\nend two", "en", "s"),  # the same lines
        (3, f"start three\n\n{other}\n\nend three", "en", "s"),  # the same paragraph, wrapped elsewhere
        (4, f"start four\n{words[0]} w1 w2 w3 w4 w5\nown\n{' '.join(words[6:12])}\nend four", "en", "s"),  # single short lines
        (5, f"start five\n{wrapped.split(chr(10))[0]}\n\n" + "\n".join(wrapped.split("\n")[1:]) + "\nend", "en", "s"),
    ]
    got = {r.doc_id: r for r in line_dedup.line_dedup(inputs.docs(spark, rows)).collect()}
    assert got[1].clean_text == rows[0][1] and got[4].clean_text == rows[3][1]
    assert got[2].clean_text == "start two\nend two" and {r.first_doc for r in got[2].removed} == {1}
    assert got[3].clean_text == "start three\n\n\nend three" and {r.first_doc for r in got[3].removed} == {1}
    assert got[5].clean_text == "start five\n\nend"
    for i, t, *_ in rows:  # what is cut is what the offsets say
        left, at = "", 0
        for r in got[i].removed:
            left, at = left + t[at : r.start], min(len(t), r.end + 1)
        assert left + t[at:] == got[i].clean_text
