import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm import inputs
from tracegraph.llm import pii, sentencepiece_codec as sp, toxicity

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def check_spans(df, rows):
    got = sorted([(r.doc_id, r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in df.collect()], key=repr)
    want = [(i, plain_spans(t)) for i, t in rows]
    assert got == sorted([(i, hashlib.sha256(s.encode()).hexdigest(), s.count(",") + bool(s)) for i, s in want], key=repr)


def test_pii_base_spans_equal_plain_patterns(spark):
    rnd = random.Random(3)
    parts = ["a@b", ".com", "1.2", ".3.4", "4111", "1111 ", "-", "+1 ", "(", ")", "555", "😀", "é", "x", "@", ".", "_", " ", "256", "000"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))), "en", "s") for i in range(300)]
    rows += [(1000, "9" * 30_000, None, None), (1001, "a" * 30_000 + "@b.c", None, None), (1002, "a@b.c " * 2_000, None, None), (1003, "5555 5555 5555 4444 +49 30 1234567 10.0.0.255 10.0.0.256", None, None)]
    check_spans(pii.report(pii.sanitise_spans(inputs.docs(spark, rows + inputs.ROWS))), [r[:2] for r in rows + inputs.ROWS])
    assert pii.report(pii.sanitise_spans(inputs.docs(spark, []))).collect() == []


def test_pii_terms_that_give_an_entity_away(spark):
    rows = [(i, f"note {i} from Zorblax writing to boss@corp.example about case {i}", "en", "s") for i in range(4)]
    rows += [(10 + i, f"plain text number {i} about a case from nobody writing to others", "en", "s") for i in range(40)]
    d = inputs.docs(spark, rows)
    spans = {r.doc_id: r for r in pii.sanitise_spans(d).collect()}
    assert "Zorblax" in [t.value for t in spans[0].terms] and not spans[10].terms
    text = {r.doc_id: r.sanitised for r in pii.sanitise(d).collect()}
    assert text[10] == rows[4][1] and "boss@corp.example" not in text[0] and "Zorblax" not in text[0] and "[EMAIL]" in text[0]


def test_pii_terms_of_entities_met_once(spark):
    """An entity of one document has disclosing terms, wherever they stand in it; copies of it prove no more."""
    common = "plain words of everybody about a case " * 10
    rows = [(1, f"Zorblax {common}write to (one@corp.example) or two@corp.example, {common}Quuxley", "en", "s")]
    rows += [(10 + i, common + f"number {i % 7} and nothing else", "en", "s") for i in range(200)]
    once, copied = ({r.doc_id: r for r in pii.sanitise_spans(inputs.docs(spark, x)).collect()} for x in (rows, rows + [(2, *rows[0][1:])]))
    for got in (once, copied):
        assert all([rows[0][1][t.start : t.end] for t in got[k].terms] == ["Zorblax", "write", "to", "or", "Quuxley"] for k in got if k < 10)
        assert not any(r.terms for k, r in got.items() if k >= 10)
    assert all(0.9 <= t.degree < 0.97 for got in (once, copied) for t in got[1].terms)
    text = {r.doc_id: r.sanitised for r in pii.sanitise(inputs.docs(spark, rows)).collect()}
    assert text[1] == f"[WORD] {common}[WORD] [WORD] ([EMAIL]) [WORD] [EMAIL], {common}[WORD]" and text[10] == rows[1][1]


def test_codec_equals_the_library(spark):
    import sentencepiece

    model = sp.read_model(sp.MODEL)
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), sp.Codec(model)
    texts = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()
    rnd = random.Random(5)
    texts += ["".join(rnd.choice("ab the is\n\t  é😀日wx1.") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    texts += ["", " ", "   x", "a" * 3000, " " * 50, "x" * 17]
    got = codec.encode(texts)
    assert [g.tolist() for g in got] == library.encode(texts, num_threads=1)
    assert [codec.decode(g) for g in got] == texts == [library.decode(g.tolist()) for g in got]


def test_codec_search_is_the_best_path_of_a_unigram_model():
    """Scores of a toy lattice: the batched search against trying every segmentation."""
    codec = sp.Codec(sp.read_model(sp.MODEL), unigram=True)
    v = codec.vocabulary
    rnd = np.random.default_rng(2)
    v.score = -rnd.random(len(v.score)) * 10
    ids = {p: i for i, p in enumerate(v.pieces) if v.keys.find(np.array([sp._hash(p)], dtype=np.uint64))[0] == i}

    def best(word):
        scores = [0.0] + [-np.inf] * len(word)
        for i in range(1, len(word) + 1):
            scores[i] = max([scores[j] + v.score[ids[word[j:i]]] for j in range(i) if word[j:i] in ids], default=-np.inf)
        return scores[-1]

    for word in ["▁hello", "▁theater", "▁international", "abc", "▁a"]:
        flat, starts, counts = v.search([word])
        assert "".join(v.pieces[i] for i in flat) == word
        assert v.score[flat].sum() == pytest.approx(best(word))


def test_codec_edges(spark):
    d = inputs.docs(spark)
    coded = sp.round_trip(d)
    assert coded.count() == len(inputs.ROWS)
    got = {r.doc_id: r for r in coded.collect()}
    assert got[4].ids == [] and got[4].decoded == "" and got[4].exact and got[7].exact
    assert not got[10].exact and got[10].decoded == inputs.ROWS[-1][1].replace("▁", " ")
    back = {r.doc_id: r.text for r in sp.decode(sp.encode(d)).collect()}
    assert back[7] == inputs.LONG and back[5] == ""
    assert sp.round_trip(inputs.docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        sp.codec(sp.read_model(sp.MODEL)).decode([10**6])


def labelled(n, seed=0):
    rnd = random.Random(seed)
    syllables = ["the", "an", "re", "ing", "ou", "st", "ha", "ti", "wor", "less", "and", "er"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["blockhead", "numskull", "dimwit"])
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_toxicity_learns_and_tolerates_gaps():
    rows = labelled(400)
    model = toxicity.train([r[1] for r in rows[:300]], [r[2] for r in rows[:300]])
    words = toxicity.Words(model.table)
    scores = model.score([r[1] for r in rows[300:]], words)
    truth = np.array([r[2] for r in rows[300:]])
    assert ((scores >= 0.3) == (truth == 1)).mean() >= 0.9 and scores[truth == 1].mean() > scores[truth == 0].mean() + 0.5
    clean, plain = model.score(["the hating and restou"], words)[0], model.score(["you blockhead"], words)[0]
    for spelling in ("b l o c k h e a d", "b.l.o.c.k.h.e.a.d", "BLOCKHEAD!!", "bl0ckhead", "block-head", "bloxckhead", "blockheeead", "x" * 50 + "blockhead" + "x" * 50):
        assert model.score([f"you {spelling}"], words)[0] > max(20 * clean, 0.05 * plain), spelling


def test_toxicity_knows_misspelt_and_short_insults():
    """Every spelling is predicted toxic; ordinary words that share letters with insults are not."""
    rows = labelled(400)
    model = toxicity.train([r[1] for r in rows[:300]], [r[2] for r in rows[:300]])
    words = toxicity.Words(model.table)
    hidden = ["bloxckhead", "blokhead", "blockheeead", "bxlxoxcxkxhxexaxd", "b l o c k h e a d", "b.l.o.c.k.h.e.a.d", "bl0ckhead", "block-head"]
    hidden += ["xxxxxxblockheadxxxxxx", "x" * 50 + "blockhead" + "x" * 50, "numzskull", "dimwwit", "dmwit", "nzuzmzszkzuzlzl"]
    for spelling in hidden:
        assert model.score([f"you {spelling}"], words)[0] >= toxicity.THRESHOLD, spelling
    for clean in ("the hating and restou", "overhead", "headless", "blocking the headline", "mamamamama", "x" * 100_000, ""):
        assert model.score([clean], words)[0] < toxicity.THRESHOLD, clean
    short = [(t.replace("blockhead", "oaf").replace("dimwit", "git"), y) for _, t, y in rows]
    model = toxicity.train([t for t, _ in short[:300]], [y for _, y in short[:300]])
    words = toxicity.Words(model.table)
    assert all(model.score([f"you {w}"], words)[0] >= toxicity.THRESHOLD for w in ("oaf", "git", "o a f", "numskull"))
    assert all(model.score([f"you {w}"], words)[0] < toxicity.THRESHOLD for w in ("the", "loaf", "digit"))


def test_misspellings_of_a_word():
    for word in ("oaf", "dimwit", "z" * 24):
        codes = toxicity.letters(word)
        found = toxicity.misspelt(codes)
        assert found and all(3 <= len(v) <= 24 and v.dtype == np.uint8 and v.max() < 32 for v in found)
        assert [v.tolist() for v in found] == [v.tolist() for v in toxicity.misspelt(codes)]
    strange = {"".join(chr(97 + c) for c in v) for v in toxicity.misspelt(toxicity.letters("dimwit"))}
    assert {"dmwit", "diwit", "dimit", "dimwt"} <= strange and sum(len(v) == 7 for v in strange) == 5


def test_toxicity_queries_and_edges(spark):
    rows = [(i, t, "en", "s") for i, t, _ in labelled(200)]
    d = inputs.docs(spark, rows + [(1000 + (i or 500), t, a, b) for i, t, a, b in inputs.ROWS] + [(None, None, None, None)])
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in labelled(200)] + [(0, None, "x"), (None, 1, "x"), (99999, 1, "x"), (4, 1, "x"), (4, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(d, labels)
    got = toxicity.score(d, model).collect()
    assert len(got) == 213 and all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.3) for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    held = [(r.predicted, int(r.doc_id % 4 == 0)) for r in got if r.doc_id is not None and r.doc_id < 200 and r.held_out]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)
    kept = toxicity.without_toxic(d, model)
    assert kept.columns == d.columns and kept.count() == sum(1 - r.predicted for r in got)
    empty = inputs.docs(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).collect() == []
    none = toxicity.score(d, toxicity.fit(d, labels.limit(0))).collect()
    assert {r.predicted for r in none} == {0}


def plain_kernel(a: str, b: str) -> float:
    """The string kernel by its definition: every pair of equal subsequences of 3 and 4 letters
    within a span of 8, each weighted by 0.8 to the power of the letters it spans."""
    from itertools import combinations

    def held(w):
        out, norm = {}, 0.0
        for n in (3, 4):
            for at in combinations(range(len(w)), n):
                span = at[-1] - at[0] + 1
                if span <= 8:
                    key = "".join(w[i] for i in at)
                    out[key] = out.get(key, 0.0) + 0.8**span
                    norm += 0.8 ** (2 * span)
        return out, norm**0.5

    (x, nx), (y, ny) = held(a), held(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / (nx * ny)


def test_string_kernel_equals_its_definition():
    words = ["blockhead", "bloxckhead", "blokhead", "bxlxoxcxkxhxexaxd", "numskull", "abcabcabc", "the"]
    codes = [toxicity.letters(w) for w in words]
    got = toxicity.kernel(codes, codes)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(plain_kernel(a, b), abs=1e-5), (a, b)


def test_training_does_not_copy_its_matrix():
    """The driver trains: a step of the SVM may hold blocks of its rows, not copies of them all."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 48))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=len(x)) > 0.2, 1.0, -1.0)
    weight = np.full(len(x), 0.01)
    tracemalloc.start()
    try:
        w, b = toxicity.svm(x, y, weight)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < x.nbytes
    # a minimum: the gradient of the squared hinge vanishes there
    pull = 2 * weight * y * np.maximum(0, 1 - y * (x @ w + b))
    assert np.abs(w - x.T @ pull).max() < 1e-3 and abs(pull.sum()) < 1e-3
    parts = [x[:5].astype(np.float32), x[:3000].astype(np.float32), x[:0].astype(np.float32)]
    assert np.array_equal(toxicity.projected(parts, np.eye(48)), np.concatenate(parts).astype(float))
