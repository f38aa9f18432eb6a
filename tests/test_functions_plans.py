"""Column helpers (URL check, numbering) and plan properties (section 4)."""

from conftest import make_files, make_repos
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracegraph import trace
from tracegraph.functions import text as T
from tracegraph.operators import coverage as C
from tracegraph.operators.numbering import rank_within

URLS = {
    "https://github.com/a/b/blob/main/x.go#L3": None,
    "::x": "missing protocol scheme",
    ":x": "missing protocol scheme",
    "a:b/c": None,  # scheme a, opaque
    "a_b:c": "colon in the first path segment",
    "x/y:z": None,
    "http://h st/x": "invalid user, host or port",
    "http://host:8a/x": "invalid user, host or port",
    "http://host:80/x": None,
    "http://[::1/x": "invalid user, host or port",
    "http://[::1]:80/x": None,
    "http://h/%zz": "invalid percent escape",
    "http://h/a?q=%zz": None,  # the query is not validated
    "http://h/a#%zz": "invalid percent escape",
    "mailto:%zz": None,
    "http://h/a\u0001": "control character",
    "http://u{s@h/x": "invalid user, host or port",
    "http://user:pw@h/x": None,
    "//h/x": None,
    "///x y": None,
    "/a b/c": None,
    "": None,
}


def test_url_fault(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r.url: r.url_fault for r in df.select("url", T.url_fault("url").alias("url_fault")).collect()}
    assert got == URLS


def test_blob_hash_of_raw_bytes(spark):
    import hashlib

    from tracegraph.sources.inventory import content_blob_hash

    raw = b"caf\xe9\n"
    df = spark.createDataFrame([(raw.decode("utf-8", "replace"), bytearray(raw))], "content string, raw binary")
    want = hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest()
    assert content_blob_hash(df).first().blob_hash == want


def test_rank_within_equals_window(spark):
    rows = [(g, k, i) for g in range(3) for k in range(0, 5000, 7) for i in range(2)]
    df = spark.createDataFrame(rows, "g int, k int, i int")
    a = rank_within(df, ["g"], ["k", "i"], F.floor(F.col("k") / 100), out="r")
    b = df.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy("k", "i")))
    j = a.join(b, ["g", "k", "i"])
    assert j.filter(F.col("r") != F.col("r2")).count() == 0 and j.count() == len(rows)


MD = "---\ntrace.package: p\n---\n`~A~`\n"
GO = "x [~p/A~impl]\n"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_jvm_side_and_prune(spark, tmp_path):
    md = "---\ntrace.package: p\n---\n`~A~`\n"
    files = make_files(spark, {"a.md": md, "t.go": "x [~p/A~impl]\n"})
    path = str(tmp_path / "files")
    files.write.parquet(path)
    files = spark.read.parquet(path)
    r = trace(files, make_repos(spark), max_bytes=131072)
    # the size gate, when given, reaches the Parquet scan
    scan = _plan(r.scanned)
    assert "PushedFilters" in scan and "LessThanOrEqual(length,131072)" in scan
    # the stats pass reads no content
    assert "content" not in _plan(r.stats).split("ReadSchema")[1].split("\n")[0]
    for df in (r.md_candidates, r.src_lines, r.md_state, r.tags, r.sites, r.coverage, r.actions, r.docs, r.scan_errors):
        p = _plan(df)
        assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_tags_never_shuffle_by_repository(spark, tmp_path):
    """Few repositories hold all tags: the staged repository table is small enough to be
    broadcast, so tags do not shuffle on ``repo_id``."""
    files = make_files(spark, {"a.md": "---\ntrace.package: p\n---\n`~A~`\n", "t.go": "x [~p/A~impl]\n"})
    r = trace(files, make_repos(spark))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        p = _plan(C.new_coverers(r.registered, r.tags, r.repo_urls))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert "hashpartitioning(repo_id" not in p
    assert "BroadcastExchange" in p


def test_repository_table_is_broadcast_by_its_size_only(spark):
    """Beyond the engine's broadcast threshold the table is joined like any other."""
    r = trace(make_files(spark, {"a.md": MD, "src/a.go": GO}), make_repos(spark))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "BroadcastExchange" not in _plan(r.tags.join(r.repo_urls, "repo_id", "left"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastExchange" in _plan(r.tags.join(r.repo_urls, "repo_id", "left"))


def test_markdown_stage_reads_markdown_partitions_only(spark):
    import tempfile

    from tracegraph.operators.lines import file_kind

    path = tempfile.mkdtemp(prefix="tg-kind-", dir="/tmp") + "/files"
    file_kind(make_files(spark, {"a.md": MD, "src/a.go": GO})).write.partitionBy("kind").parquet(path)
    r = trace(spark.read.parquet(path), make_repos(spark))
    assert "PartitionFilters: [isnotnull(kind" in _plan(r.md_candidates) and "(kind#" in _plan(r.md_candidates)
    assert r.docs.count() == 1 and r.tags.count() == 1


def test_no_coverer_list_outside_written_footnotes(spark):
    r = trace(make_files(spark, {"a.md": MD, "src/a.go": GO}), make_repos(spark), materialize=False)
    for df in (r.coverage, r.ranked_coverers, r.new_coverers, r.semantic_errors):
        assert "collect_list" not in _plan(df)
    assert "collect_list" in _plan(r.actions)


def test_requirement_with_a_third_of_all_tags(spark):
    md = "---\ntrace.package: p\n---\n" + "".join(f"`~R{i}~`\n" for i in range(6))
    go = {f"src/f{k}.go": "".join(f"x [~p/R{0 if i % 3 == 0 else 1 + i % 5}~impl]\n" for i in range(90)) for k in range(10)}
    r = trace(make_files(spark, {"a.md": md, **go}), make_repos(spark))
    got = {}
    for c in r.ranked_coverers.collect():
        got.setdefault(c.name, []).append((c.ord, c.label))
    assert sum(map(len, got.values())) == 900 and len(got["R0"]) == 300
    for rows in got.values():
        rows.sort()
        assert [o for o, _ in rows] == list(range(1, len(rows) + 1))
        key = [(label.split(":")[0], int(label.split(":")[1])) for _, label in rows]
        assert key == sorted(key)


def test_invalid_ignore_pattern_fails_up_front(spark):
    import pytest
    files = make_files(spark, {"a.md": "x\n"})
    with pytest.raises(ValueError):
        trace(files, make_repos(spark), ignore_lines=["(unclosed"])


def test_joined_text_in_buckets_equals_one_list(spark):
    from tracegraph.operators.numbering import joined_text

    rows = [(g, i, f"t{i}") for g, n in (("a", 50), ("b", 1), ("c", 16)) for i in range(n, 0, -1)]
    df = spark.createDataFrame(rows, "g string, ord int, t string")
    want = {g: ", ".join(f"t{i}" for i in range(1, n + 1)) for g, n in (("a", 50), ("b", 1), ("c", 16))}
    for bucket in (1, 7, 16, 1024):
        assert {r.g: r.text for r in joined_text(df, ["g"], "ord", "t", ", ", bucket=bucket).collect()} == want


def test_segmented_windows_hold_a_chunk(spark):
    from tracegraph.operators import lines as L

    files = L.file_kind(make_files(spark, {"a.md": "---\n```\n"}))
    cand = L.candidate_flags(L.line_explode(files, keep_long=True))
    plan = L.segmented_state(cand)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if " Window [" in x or x.lstrip("+-: ").startswith("Window [")]
    assert windows
    for w in windows:  # lines are windowed by chunk, files only over the summaries of chunks
        assert "chunk" in w and ("line_no" not in w or "path" in w and "[root_ord" in w and ", chunk" in w.split("windowspecdefinition")[1])


def test_ignore_patterns_read_as_in_their_dialect(spark):
    """Against an engine of that dialect, line by line; what only Java has is refused."""
    import duckdb
    import pytest
    from pyspark.sql import functions as F

    from tracegraph.functions.dialect import java_pattern

    lines = ["", "abc", "a\x0bb", "a b", "ab\u2028", "tail\r", "x[y", "x]y", "a&&b", "é", "_k9", "A{,2}", "a{,2}", "ÀB", "Ω", "aab", "a.b", "a\\b", "\tq", "-", "^", "foo-bar", "aaaa"]
    patterns = [r"a\sb", r"[\s]b", r"a[\S]b", r"b$", r"l.$", r"[[y]", r"[]y]", r"[^]a-z]", r"a[&&]+b", r"(?P<n>a)b", r"[[:alpha:]]9", r"[[:^alpha:]]", r"[[:word:]]{3}"]
    patterns += [r"\bé", r"é\b", r"a\b", r"k\B9", r"a{,2}", r"(?i)àb", r"(?i:AB)c", r"\pL\pN", r"\p{Greek}", r"\p{^L}", r"\P{Lu}b", r"\Qa.b\E", r"\Qa.", r"\x61{2}b", r"\x{3a9}", r"\141\0*b", r"a{4}", r"a+?b", r"x|-", r"[\]\[]", r"[a^-]$", r"\v", r"\\b", r"}|q"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = df.select("i", *[F.col("line").rlike(java_pattern(p)).alias(f"p{k}") for k, p in enumerate(patterns)]).orderBy("i").collect()
    con = duckdb.connect()
    assert java_pattern(r"(?<n>a)b") == java_pattern(r"(?P<n>a)b")
    for k, p in enumerate(patterns):
        want = [con.execute("SELECT regexp_matches(?, ?)", [x, p]).fetchone()[0] for x in lines]
        assert [r[f"p{k}"] for r in got] == want, p
    for refused in (r"(?=a)", r"(?!a)", r"(?<=a)b", r"(?<!a)b", r"(?>a)", r"(a)\1", r"\k<n>", r"a++", r"a*+", r"a?+", r"a{2}+", r"a{2}{3}", r"a**", r"a\Z", r"\Ga", r"\R", r"\h", r"\cA", r"a{1001}", r"[[:alfa:]]", "[a", "a\\", r"(?U)a+"):
        with pytest.raises(ValueError):
            java_pattern(refused)


def test_coverage_by_type_has_subtotals_in_registry_order(spark):
    from tracegraph.operators import coverage as C
    from tracegraph.sources import inventory as I

    cov = spark.createDataFrame(
        [("p", "it.a", "covrd", 2), ("p", "it.b", "uncvrd", 0), ("p", "cmp.a", "covrd", 1), ("q", "zz", "uncvrd", 0)],
        "package string, name string, status string, n_coverers long",
    )
    rows = lambda types: {(r.package, r.req_type): tuple(r)[2:] for r in C.coverage_by_type(cov, types).collect()}
    got = rows(I.type_registry(spark, "cmp,it")[0])
    assert got == {
        ("p", "cmp"): (0, 0, 1, 1, 1), ("p", "it"): (0, 1, 2, 1, 2), ("q", "zz"): (0, None, 1, 0, 0),
        ("p", None): (1, None, 3, 2, 3), ("q", None): (1, None, 1, 0, 0), (None, None): (3, None, 4, 2, 3),
    }
    assert {k: v[2:] for k, v in rows(None).items()} == {k: v[2:] for k, v in got.items()}
    plan = C.coverage_by_type(cov)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Expand" in plan
