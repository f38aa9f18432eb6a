"""Work that several traces of the same tables have in common is done once."""

import os
import tempfile

from conftest import make_files, make_repos

from tracegraph.operators import coverage as C
from tracegraph.operators import lines as L
from tracegraph.plans.trace import trace
from tracegraph.queries import registry as Q
from tracegraph.sources import corpus as CO


def _tables(spark):
    d = tempfile.mkdtemp(prefix="tg-gate-", dir="/tmp")
    li = [(o, 1 + (o + n) % 30, 1 + o % 3, n, "ARN"[n % 3]) for o in range(60) for n in (1, 2, 3)]
    spark.createDataFrame(li, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_returnflag string").write.parquet(d + "/lineitem.parquet")
    spark.createDataFrame([(p, 1 + p % 12) for p in range(1, 31)], "p_partkey long, p_size int").write.parquet(d + "/part.parquet")
    docs = [(1, "a", "en", "s1"), (2, "b", "fr", "s2"), (3, "c", None, "s1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(1,)], "doc_id long").write.parquet(d + "/labels.parquet")
    return d


def test_corpora_have_their_source_files_in_common(spark):
    d = _tables(spark)
    sources = set()
    for faults in ("syntax", None, "semantic"):
        files = CO.corpus(spark, d, faults)
        want = CO.corpus_from_tables(spark, d, faults=faults)
        assert sorted(map(str, files.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert {r.kind for r in files.select("kind").collect()} == {"md", "src"}
        sources.add(tuple(sorted(files.filter("kind = 'src'").inputFiles())))
    assert len({x for s in sources for x in s if "/kind=src/" in x}) == len([x for x in next(iter(sources)) if "/kind=src/" in x])


def test_phase_gate_shares_stages(spark):
    d = _tables(spark)
    rows = {r.corpus: r for r in Q.phase_gate(spark, d).collect()}
    assert rows["repos"].n_scan_errors == 2 and rows["syntax"].n_scan_errors > 0 and rows["semantic"].n_semantic_errors > 0
    assert rows["clean"].n_coverage == 30 and rows["clean"].n_docs > 0 and rows["clean"].n_scan_errors == rows["clean"].n_semantic_errors == 0
    assert rows["semantic"].n_coverage > 0 and rows["semantic"].n_actions == rows["syntax"].n_coverage == 0
    clean, repos, semantic = Q.traced(spark, d), Q.traced(spark, d, bad_repos=True), Q.traced(spark, d, "semantic")
    stages = [set(os.listdir(r._run_dir)) for r in (clean, repos, semantic)]
    # other repositories: the same Markdown state; other Markdown: its own, but the same tags of source files
    assert [{"md_state", "raw_coverers", "src_tags"} & s for s in stages] == [{"md_state", "raw_coverers", "src_tags"}, set(), {"md_state", "raw_coverers"}]
    # the gate and the report read one table of errors
    assert all("scan_errors" in s for s in stages) and "semantic_errors" in stages[2] and "semantic_errors" not in stages[1]
    own = trace(CO.corpus(spark, d, "semantic"), CO.repos(spark))
    assert sorted(map(str, own.tags.collect())) == sorted(map(str, semantic.tags.collect())) == sorted(map(str, own.all_tags.drop("file_has_site", "file_ignored").collect()))


def test_long_lines_are_found_without_a_row_per_line(spark):
    texts = {"a.go": "x" * 9 + "\nshort\n", "b.go": "short\n\n" + "y" * 12 + "\n" + "z" * 30, "c.go": "none\n" * 9, "d.go": "", "e.go": "é" * 5}
    files = L.file_kind(make_files(spark, texts))
    for limit in (1, 5, 9, 10, 13, 31):
        exploded = L.line_explode(files, (), True, limit).filter("is_long")
        got = L.long_lines(files, limit)
        key = ["path", "kind", "is_long"]
        assert sorted(got.select(*key).collect()) == sorted(exploded.select(*key).collect()), limit
    r = trace(files, make_repos(spark), max_line_bytes=9)
    assert sorted(e.path[-4:] for e in r.errors.collect()) == ["a.go", "b.go", "e.go"]


def test_url_lists_are_compared_without_a_join(spark):
    req = "package string, name string, url string"
    new = spark.createDataFrame([("p", "a", "u"), ("p", "a", "u"), ("p", "a", "v"), ("p", "b", "u"), ("p", "c", None), ("p", "d", "w")], req)
    cur = spark.createDataFrame([("p", "a", "v"), ("p", "a", "u"), ("p", "a", "u"), ("p", "b", "x"), ("p", "c", None), ("p", "e", "u")], req)
    stats = C.requirement_stats(cur, new)
    assert "Join" not in stats._jdf.queryExecution().executedPlan().toString()
    got = {r.name: (r.n_coverers, r.n_current, r.changed) for r in stats.collect()}
    # nulls equal nothing
    assert got == {"a": (3, 3, False), "b": (1, 1, True), "c": (1, 1, True), "d": (1, 0, True), "e": (0, 1, True)}
