import html
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import inputs
from tracegraph.llm import exact_dedup, html_text, mixing, sentencepiece_codec, topk, toxicity, warc
from tracegraph.llm.common import shared_path, staged

SF = "/root/testdata/sf0.001"


# --- mixing ---------------------------------------------------------------------------


def brute_targets(sizes, cycle=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:  # the excess is reshared by weight until none is above its limit
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] >= most * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
        free -= above
    return target


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(1)
    rows = []
    for source, n in (("a", 3), ("b", 400), ("c", 60), (None, 5), ("e", 900), ("f", 0)):
        rows += [(len(rows) + k, "w " * int(rng.integers(0, 60)), "en", source) for k in range(n)]
    d = inputs.docs(spark, rows)
    got = mixing.mix_sources(d).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    target = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-12)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix_sources(d.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    mixed = mixing.mixture(d)
    assert mixed.columns == d.columns and mixed.count() == sum(r.copies for r in got)


def test_mix_draws_by_inclusion_odds(spark):
    """Over many seeds a document is drawn as often as its inclusion odds say."""
    rows = [(i, "w w", "en", "a" if i < 40 else "b") for i in range(80)]
    d = spark.createDataFrame([(*r, 4.0 if r[0] % 2 else 1.0) for r in rows], "doc_id long, text string, lang string, source string, odds double")
    odd = even = 0
    for seed in range(6):
        for r in mixing.mix_sources(d, odds_col="odds", seed=str(seed)).where("source = 'a'").collect():
            if r.doc_id % 2:
                odd += r.copies
            else:
                even += r.copies
    assert odd > 1.2 * even and odd + even == pytest.approx(6 * 40 * 2 / 3, abs=6)


def test_mix_edges(spark):
    got = mixing.mix_sources(inputs.docs(spark)).collect()
    assert len(got) == len(inputs.ROWS)
    assert {r.size for r in got if r.doc_id in (4, 5, 6)} == {0} and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix_sources(inputs.docs(spark, [])).collect() == [] and mixing.mixture(inputs.docs(spark, [])).collect() == []


# --- top-k ----------------------------------------------------------------------------


def brute_top_k(rows, k, every):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(64 * x) for x in v])
    out = []
    for q in sorted(whole):
        if q % every == 0:
            for own in {tuple(v) for v in whole[q]}:
                scores = [(-sum(a * b for a, b in zip(own, v)), i) for i in whole if i != q for v in whole[i]]
                out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 4)
    monkeypatch.setattr(topk, "FAN", 3)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=8) * (0.01 if i % 3 else 0.0)]) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, rows[0][1]), (1004, rows[0][1]), (1004, rows[0][1]), (1005, [0.5, -0.5]), (1006, [])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    want = brute_top_k(rows, 20, 20)
    for sizes in ({}, {"query_block": 4, "block": 50}):
        assert sorted(tuple(r) for r in topk.top_k(df, **sizes).collect()) == want
    assert topk.top_k(df.limit(0)).collect() == []
    few = df.where("vec_id IN (0, 1, 2)")
    assert topk.top_k(few).count() == 2


def test_top_k_beyond_doubles(spark):
    rows = [(0, [1e30, -1e30]), (1, [1e30, 1e30]), (2, [3.0, 1.0]), (3, [-1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.top_k(df).collect()}
    assert got[3] == -(2**63) and got[2] == 2**63 - 1 and got[1] == 0


# --- WARC -----------------------------------------------------------------------------


def test_warc_round_trip_and_seek_tables(spark):
    same = "<p>" + "x" * 200 + "</p>"
    rows = [(i, f"http://h/{i}?q=ä b\r\nc", "<html>" + str(i) * (i % 50) + "é</html>") for i in range(200)]
    rows += [(300, None, None), (301, "u", ""), (302, "u", same), (303, "u", same), (303, "u", same), (302, "u", same), (304, "u", "short"), (305, "u", "short"), (None, "u", same), (None, "u", "n" * 150)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, payload string")
    folder = shared_path(spark, "warc-test")
    index = warc.write_archive(pages, folder, frame_bytes=700, bundle_bytes=3000)
    got = warc.read_archive(index, folder).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    for i, _, text in rows[:200] + rows[204:208]:
        r = by_id[i][0]
        assert r.payload_bytes == len((text or "").encode())
        if r.record_type == "response":
            assert bytes(r.payload).decode() == text
    assert {(r.record_type, r.refers_to) for r in by_id[302]} == {("response", None)}
    assert [(r.record_type, r.refers_to, r.payload_bytes) for r in by_id[303]] == [("revisit", 302, 207)] * 2
    assert {(r.record_type, r.refers_to) for r in by_id[None]} == {("revisit", 302), ("response", None)}
    assert by_id[304][0].record_type == by_id[305][0].record_type == "response"
    # every bundle ends in a seek table that names its frames
    import zstandard
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    for b in {r.bundle for r in index.collect()}:
        with files.open_input_file(f"{path}/{b}") as f:
            data = f.read()
        frames, at = warc.read_seek_table(data), 0
        starts = {r.frame_start for r in index.where(index.bundle == b).collect()}
        for packed, size, _ in frames:
            assert at in starts and len(zstandard.ZstdDecompressor().decompress(data[at : at + packed])) == size
            at += packed
        assert len(data) == at + 8 + 12 * len(frames) + 9
        # any Zstandard reader sees the whole archive as one stream of records
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert whole.startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(pages.limit(0)).collect() == []
    # tasks follow from the bytes of the archive, and frames are found by the seek tables alone
    unpacked = sum(r["size"] for r in index.collect())
    blind = index.withColumn("frame_start", F.lit(-1).cast("long")).withColumn("frame_size", F.lit(-1).cast("long"))
    for task_bytes in (2000, 10_000):
        again = warc.read_archive(blind, folder, task_bytes)
        assert again.rdd.getNumPartitions() == -(-unpacked // task_bytes)
        key = lambda r: (str(r.page_id), r.record_type, str(r.refers_to), r.payload_digest)
        assert sorted(map(key, again.collect())) == sorted(map(key, got))
    with pytest.raises(ValueError):
        warc.frames_in(pa.BufferReader(b"no bundle at all"))


# --- HTML -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labeller():
    return html_text.train(pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist())


def test_html_blocks_of_broken_pages_take_linear_time():
    import time

    def cost(page):
        best = []
        for _ in range(3):
            begin = time.perf_counter()
            found = html_text.blocks(page)
            best.append(time.perf_counter() - begin)
        return min(best), found

    n = 20_000
    for make in (
        lambda n: '<svg"' * n,
        lambda n: "<a " * n,
        lambda n: '<a "x>"' * n + "'",
        lambda n: "<div>x" * n,
        lambda n: "<b>" * n + "<div>" + "<i>" * n + "</b>" * n,
        lambda n: "<span>" * n + "<hr>x" * n,
        lambda n: "<div>" * n + "</p>" * n,
    ):
        (small, _), (large, _) = cost(make(n)), cost(make(4 * n))
        assert large < 8 * small + 0.2, make(2)
    assert [b.text for b in cost("<div>x" * 50)[1]] == ["x"] * 50


def test_html_blocks_of_odd_marks():
    text = lambda page: [b.text for b in html_text.blocks(page)]
    assert text('<p title="a > b">one</p>two') == ["one", "two"]
    assert text("<p title='never closed>one</p><p>two") == ["one", "two"]
    assert text("1 < 2 <p>3 <4> 5") == ["1 < 2", "3 <4> 5"]
    assert text("a<!-- <p>b</p> -->c<script>if (a<b) '</p>'</script >d<svg/>e<svg><text>f</text></svg>g") == ["acdeg"]
    assert text("a<script>b") == ["a"] and text("a<!-- b") == ["a"] and text("a<p") == ["a<p"]
    linked = html_text.blocks("<p><a href=x>ab</a>cd")[0]
    assert linked.linked == 0.5 and [p.tag for p in linked.around()] == ["p"]


def test_html_text_equals_the_article(spark, labeller):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wrong = 0
    for r in html_text.extract(pages, labeller).join(pages.select("page_id", "html"), "page_id").collect():
        inside = re.search("<article>(.*)</article>", r.html, re.S)[1]
        text = html.unescape(re.sub("<[^>]*>", "", re.sub(r"<(/?(p|h1)|br)>", " ", inside)))
        wrong += " ".join(text.split()) != r.text
        assert r.n_chars == len(r.text)
    assert wrong <= 2


def test_html_boilerplate_of_other_pages(labeller):
    say = "This long paragraph tells the story, with commas, and ends with a full stop."
    page = f"""<html><head><title>t</title><style>p {{}}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class="cookie-notice">We use cookies.</div>
    <main><h1>Head line</h1><p>{say} &amp; &eacute;&nbsp;x<p>In<b>line</b> {say}</main><aside class="sidebar"><p>Most read</p></aside>
    <div id="comments"><div class="comment"><p>First! I do not agree.</p></div></div>
    <form><label>Mail</label><button>Send</button></form><script>if (a < b) x("</p>")</script><footer>(c) us</footer>"""
    found = html_text.blocks(page)
    kept = labeller.labels([html_text.vectors(found)])[0]
    assert " ".join(b.text for b, k in zip(found, kept, strict=True) if k) == f"Head line {say} & é x Inline {say}"


def test_html_edges(spark, labeller):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<!-- never closed <p>x"), (5, "u", "<script>var a"), (6, "u", '<a href="x>y</a> <p'), (None, "u", "</p></div>"), (7, "u", "<p>a" * 3000), (7, "u", "<p>a" * 3000), (8, "u", "<article>" + "word " * 50_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(pages, labeller).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id in (1, 2, 4, 5)} == {1: "", 2: "", 4: "", 5: ""}
    assert html_text.extract(pages.limit(0), html_text.fit(pages.limit(0))).collect() == []


# --- pipeline -------------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark):
    """Every stage against its own definition, on the stage's own input."""
    from tests.llm.test_dedup import brute_components, norm

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    clean = [r for i, r in rows.items() if i not in toxic]
    best = {}
    for r in clean:
        key = norm(r.text)
        best[key] = min(best.get(key, (0, 10**9)), (-len(r.text), r.doc_id))
    single = [r for r in clean if best[norm(r.text)][1] == r.doc_id]
    classes = brute_components([(r.doc_id, r.text) for r in single])
    left = [r for r in single if classes[r.doc_id][1] == r.doc_id]
    taken = {r.doc_id: r.copies for r in mixing.mix_sources(spark.createDataFrame(left, docs.schema)).collect()}
    want = sorted(i for i, n in taken.items() for _ in range(n))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == want and all(r.exact and r.n_tokens == len(r.ids) for r in got)
    codec = sentencepiece_codec.codec(sentencepiece_codec.read_model(sentencepiece_codec.MODEL))
    assert all(codec.decode(r.ids) == rows[r.doc_id].text for r in got)


def test_pipeline_edges(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for rows in (inputs.ROWS, []):
        folder = shared_path(spark, "pipeline-test")
        labels.write.parquet(f"{folder}/labels.parquet")
        inputs.docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
        columns = inputs.docs(spark, rows).columns
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, folder), f"test-{name}")
            assert docs.columns == columns
        assert corpus_pipeline.run(spark, folder).count() == docs.count()
        assert exact_dedup.exact_dedup(docs).count() == docs.count()
