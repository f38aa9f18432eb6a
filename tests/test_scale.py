"""Steps whose shuffles and stages must not hold texts that follow from numbers."""

import glob
import tempfile

from conftest import make_files, make_repos
from pyspark.sql import functions as F

from tracegraph.operators import coverage as C
from tracegraph.plans.trace import trace
from tracegraph.sources import corpus as CO


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _tables(spark):
    d = tempfile.mkdtemp(prefix="tg-scale-", dir="/tmp")
    flags = ["A", "R", "N", None]
    li = [(o, p, s, n, flags[(o + n) % 4]) for o in range(40) for n, (p, s) in enumerate([(43 + o % 5, 2), (44, 3), (None, 2)], 1)]
    li += [(7, 45, 2, None, "A"), (7, None, 2, None, "A"), (None, 45, 2, 1, "A"), (8, 45, None, 1, "A")]
    spark.createDataFrame(li, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_returnflag string").write.parquet(d + "/lineitem.parquet")
    spark.createDataFrame([(p, 1 + p % 3) for p in range(40, 60)] + [(46, 1)], "p_partkey long, p_size int").write.parquet(d + "/part.parquet")
    docs = [(1, "a", "en", "s1"), (2, "b", "fr", "s3"), (3, "c", None, "s1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(1,)], "doc_id long").write.parquet(d + "/labels.parquet")
    return d


def test_corpus_moves_tags_as_numbers(spark):
    """A tag is one row of numbers until its file or footnote is written; the kinds are written
    apart, so no whole text is sorted by a partition column."""
    d = _tables(spark)
    files = CO.corpus_from_tables(spark, d)
    plan = _plan(files)
    windows = [x for x in plan.splitlines() if "Window [row_number" in x and "l_orderkey" in x]
    assert windows and all("tag_name" not in x and "cov_type" not in x for x in windows)
    got = {r.rel_path: r.content for r in files.collect() if r.rel_path}
    src = got["src/s2/c0.go"].split("\n")
    # null line number: no filler line; null part: no tag line; both: neither
    assert src[:2] == ["// order 0 line 1", "// covers [~pkg1/cmp.p43~test]"]
    assert sum(x.startswith("// order") for x in src) == 80 and sum(x.startswith("// covers") for x in src) == 41 and src[-1] == "" and "" not in src[:-1]
    whole = CO.corpus(spark, d)
    assert sorted(map(str, whole.select(*files.columns).collect())) == sorted(map(str, files.collect()))
    kinds = {r.rel_path: r.kind for r in whole.select("rel_path", "kind").collect() if r.rel_path}
    assert all(k == ("md" if p.endswith(".md") else "src") for p, k in kinds.items())
    # part 46 twice: each row has its footnote with the coverers in order of type, file, line
    foot = [x for t in got.values() for x in t.split("\n") if x.startswith("[^") and "/cmp.p46~" in x]
    lines = [x.split("](")[0] for x in foot[0].split(" [")[1:]]
    key = [(x.split(":")[2], x.split(":")[0], int(x.split(":")[1])) for x in lines]
    assert len(foot) == 2 and foot[0].split("]: ")[1] == foot[1].split("]: ")[1] and len(key) == 8 and key == sorted(key)


def test_coverer_lists_are_brought_together_without_texts(spark):
    rows = [("p", f"r{i % 3}", ("impl", "test")[i % 2], f"f{i % 4}", 100 - i, ("h", "h!")[i % 5 == 0]) for i in range(30)]
    rows += [("p", "r0", "impl", "f0", 7, "h!"), ("p", "r0", "impl", "f0", 7, "h"), ("p", "r0", "impl", "f0", 7, "h")]
    new = C.linked(spark.createDataFrame(rows, "package string, name string, cov_type string, file string, line_no int, root_url string"))
    reqs = new.groupBy("package", "name").agg(F.count("*").alias("n_coverers"))
    want = {}
    for r in sorted(new.collect(), key=lambda r: (r.cov_type, r.file, r.line_no, r.url)):
        want.setdefault(r.name, []).append(f"[{r.label}]({r.url})")
    for listed in (0, 10, 1000):  # all numbered, some, none
        got = {r.name: r.coverers for r in C.coverer_texts(new, reqs, listed).collect()}
        assert got == {k: ", ".join(v) for k, v in want.items()}
    plan = _plan(C.coverer_texts(new, reqs))
    assert "Window" not in plan and plan.count("Aggregate [") <= 3


def test_coverer_stage_holds_no_links(spark):
    md = "---\ntrace.package: p\n---\n`~R1~`\n"
    r = trace(make_files(spark, {"a.md": md, "src/a.go": "x [~p/R1~impl]\n"}), make_repos(spark))
    assert r.new_coverers.first().url.endswith("/src/a.go#L1")
    assert glob.glob(r._run_dir + "/new_coverers/*.parquet")
    assert set(spark.read.parquet(r._run_dir + "/new_coverers").columns) == set(C.COVERER_COLS)


def test_rewrite_sorts_natively(spark):
    """``array_sort`` runs a comparison function per pair of lines; ``sort_array`` orders rows."""
    from tracegraph.operators import rewrite as R

    md = "---\ntrace.package: p\n---\nb\n\na\n`~R1~`\n`~R0~`\n"
    files = make_files(spark, {"a.md": md, "src/a.go": "x [~p/R1~impl]\n"})
    r = trace(files, make_repos(spark))
    want = r.docs.first()
    assert [x[:4] for x in want.content.split("\n")] == ["---", "trac", "---", "b", "", "a", "`~R1", "`~R0", "", "[^1]", "[^2]", ""]
    for df in (R.apply_actions(files, r.actions), R.apply_actions_chunked(files, r.actions, 5)):
        assert df.first().content == want.content
        assert "array_sort(" not in _plan(df) and "sort_array(" in _plan(df)


def test_phrase_index_rows_by_packed_keys():
    """The order of rows equals that of one key per id, with few, many and too many bits."""
    import numpy as np

    from tracegraph.llm import phrases as PH

    rng = np.random.default_rng(3)
    for high in (1, 9000, 70_000, 2**31 - 1):
        for depth in (2, 4):
            ids = np.concatenate([[0], rng.integers(0, high + 1, 3000) // rng.choice([1, high], 3000), [0]])
            ahead = [np.concatenate([ids[j:], np.zeros(j, dtype=ids.dtype)]) for j in range(depth)]
            assert (PH.row_order(ids, depth) == np.lexsort(ahead[::-1])).all()
            if high > 70_000:  # an index counts each id below the largest
                continue
            index = PH.Index(ids, depth)
            by_id = np.argsort(index.bwt, kind="stable")
            assert (index.places == index.bwt[by_id] * index.n + by_id).all()


def test_source_files_are_grouped_behind_the_shuffle(spark, monkeypatch):
    """Numbers are dealt out, as many tags to a task at any scale; nothing is listed before."""
    rows = [(1, 7, 1, 5, 1, 2), (1, 3, 2, 8, 0, 1), (2, 4, None, 9, 2, 1), (2, 5, 1, None, 2, 2), (3, None, 1, None, 0, 1), (4, 1, 1, 1, 1, 1001)]
    tags = CO.tag_rows(spark.createDataFrame(rows, "supp long, l_orderkey long, l_linenumber int, l_partkey long, cov_code byte, r long"))
    files = CO.source_files(tags, 3)
    got = {r.rel_path: r.content for r in files.collect()}
    assert got == {
        "src/s1/c0.go": "// order 3 line 2\n// covers [~retired/utest.p8~doc]\n// order 7 line 1\n// covers [~pkg5/utest.p5~impl]\n",
        "src/s2/c0.go": "// covers [~pkg2/it.p9~test]\n// order 5 line 1\n",
        "src/s3/c0.go": "\n",
        "src/s4/c1.go": "// order 1 line 1\n// covers [~pkg1/cmp.p1~impl]\n",
    }
    below = _plan(files).split("RepartitionByExpression")
    assert len(below) == 2 and "collect_list" not in below[1] and "order " not in below[1]
    assert CO.tag_tasks(tags) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(CO, "TASK_TAGS", 1)
    assert CO.tag_tasks(tags.unionByName(tags).unionByName(tags)) == max(spark.sparkContext.defaultParallelism, 18)
