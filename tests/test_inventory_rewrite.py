"""Fixtures F6 (inventory, rows 1-10) and F7 (rewrite, rows 54-61)."""

import os
import tempfile

from conftest import make_files, make_repos
from pyspark.sql import functions as F

from tracegraph import trace
from tracegraph.operators import coverage as C
from tracegraph.sources import inventory as I
from tracegraph.sources.inventory import FILES_SCHEMA


def _files(spark, rows):
    """rows: (root_path, rel_path, length, tracked)."""
    data = [(0, "r1", root, root + "/" + rel, rel, n, "", t) for root, rel, n, t in rows]
    return spark.createDataFrame(data, FILES_SCHEMA)


def test_size_extension_dot_tracked_gates(spark):
    rows = [
        ("/w/r", "a.md", 131072, True),
        ("/w/r", "b.md", 131073, True),
        ("/w/r", "x.MD", 10, True),
        ("/w/r", "x.GO", 10, True),
        ("/w/r", "n.txt", 10, True),
        ("/w/r", ".cfg/a.md", 10, True),
        ("/w/r", "a/.b/c.go", 10, True),
        ("/w/r", "a/.h.md", 10, True),
        ("/w/r", "_u/y.md", 10, True),
        ("/w/r", "u.md", 10, False),
        ("/w/.work", "k.md", 10, True),
    ]
    inv = I.gated_inventory(_files(spark, rows), None, None, 131072)
    got = {r.rel_path: (r.processed, r.scanned) for r in inv.collect()}
    assert got["a.md"] == (True, True) and got["b.md"] == (False, False)
    assert got["x.MD"][1] and got["x.GO"][1] and not got["n.txt"][1] and got["n.txt"][0]
    assert ".cfg/a.md" not in got and "a/.b/c.go" not in got and "k.md" not in got
    assert got["a/.h.md"][1] and got["_u/y.md"][1]
    assert got["u.md"] == (True, False)  # untracked still counts as processed (Q1, Q4)
    ext = I.gated_inventory(_files(spark, [("/w/r", "x.go", 1, True)]), None, ".GO", 131072)
    assert [r.scanned for r in ext.collect()] == [False]  # the list is not lower-cased (Q2)
    stats = I.scan_stats(inv).first()
    assert (stats.processed_files, stats.skipped_files, stats.skipped_bytes) == (7, 1, 131073)
    assert stats.skipped_size == "131.1 kB"


def test_si_bytes_and_blob_hash(spark):
    from tracegraph.functions import text as T

    df = spark.createDataFrame([(999,), (1000,), (274300,), (19000000,), (1250,), (1050,), (1150,), (1350,), (999950,), (0,), (10**18,), (1450000,), (2**62,)], "b bigint")
    got = [r.s for r in df.select(T.si_bytes("b").alias("s")).collect()]
    assert got == ["999 B", "1.0 kB", "274.3 kB", "19.0 MB", "1.2 kB", "1.1 kB", "1.1 kB", "1.4 kB", "1000.0 kB", "0 B", "1.0 EB", "1.4 MB", "4.6 EB"]
    rnd = [i * 7919 * (1 + i % 13) for i in range(1, 4000)] + [50 + 100 * i for i in range(10, 4000)]
    many = spark.createDataFrame([(v,) for v in rnd], "b bigint")
    for r in many.select("b", T.si_bytes("b").alias("s")).collect():
        power = max(p for p in (0, 1, 2, 3) if r.b >= 1000**p)
        assert r.s == (f"{r.b} B" if power == 0 else "%.1f %sB" % (r.b / 1000**power, "_kMG"[power]))
    h = spark.createDataFrame([("abc",)], "content string").select(T.blob_hash("content").alias("h")).first().h
    assert h == "f2ba8f84ab5c1bce84a7b441cb1959cfc7093b7f"  # git hash-object of "abc"


def test_repo_root_url(spark):
    repos = make_repos(
        spark,
        [
            ("a", "/a", "https://github.com/a/b", True, True),
            ("b", "/b", "https://gitlab.com/a/b.git", False, True),
            ("c", "/c", "https://example.org/a/b", True, False),
            ("d", "/d", "https://github.com/a/d", False, False),
        ],
    )
    got = {r.repo_id: (r.root_url, r.url_error) for r in I.repo_root_url(repos).collect()}
    assert got["a"] == ("https://github.com/a/b/blob/main", None)
    assert got["b"] == ("https://gitlab.com/a/b.git/-/blob/master", None)
    assert got["c"] == (None, "no known provider hosts https://example.org/a/b")
    assert got["d"] == (None, "no branch named main or master")


def test_type_list_parsing(spark):
    import pytest

    df, ids = I.type_registry(spark, "it, ,cmp")
    assert ids == ["it", "cmp"] and sorted(r.order_no for r in df.collect()) == [0, 2]
    for bad, named in (("it,it", "it"), ("1a", "1a"), ("b,x y,b,ok", "b, x y")):
        with pytest.raises(ValueError, match=named):
            I.type_registry(spark, bad)
    df, ids = I.type_registry(spark, ",")
    assert ids == [] and df.count() == 0


def test_read_tree_lists_hidden_underscore_and_dot_files(spark):
    root = tempfile.mkdtemp(prefix="tg-tree-", dir="/tmp")
    for rel, text in {"_x/y.md": "a\n", ".x/z.md": "b\n", ".h.md": "c\n", "k.go": "d\n"}.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as fh:
            fh.write(text)
    files = I.read_tree(spark, [(root, "r1")])
    got = sorted(r.rel_path for r in files.collect())
    assert got == [".h.md", "_x/y.md", "k.go"]
    assert files.filter(F.col("rel_path") == "k.go").first().content == "d\n"


def _doc(spark, text, **kw):
    r = trace(make_files(spark, {"d.md": text}), make_repos(spark), **kw)
    d = r.docs.collect()
    return r, (d[0] if d else None)


def test_crlf_file_keeps_crlf(spark):
    _, d = _doc(spark, "---\r\ntrace.package: p\r\n---\r\n`~A~`\r\n")
    assert d.apply_error is None
    assert d.content == "---\r\ntrace.package: p\r\n---\r\n`~A~`uncvrd[^1]❓\r\n\r\n[^1]: `[~p/A~impl]`\r\n"


def test_trailing_blank_lines_trimmed_once(spark):
    _, d = _doc(spark, "---\ntrace.package: p\n---\n`~A~`\n\n\n\n")
    assert d.content == "---\ntrace.package: p\n---\n`~A~`uncvrd[^1]❓\n\n[^1]: `[~p/A~impl]`\n"
    r, d = _doc(spark, "---\ntrace.package: p\n---\n`~A~`uncvrd[^1]❓\n\n[^1]: `[~p/A~impl]`\n\n\n")
    assert r.actions.count() == 0 and d is None  # untouched without actions


def test_bare_site_with_word_keeps_word(spark):
    _, d = _doc(spark, "---\ntrace.package: p\n---\n`~D~`uncvrd tail\n")
    assert d.content.split("\n")[3] == "`~D~`uncvrd[^1]❓uncvrd tail"  # Q17


def test_literal_replacement_text(spark):
    md = "---\ntrace.package: p\n---\n`~A~`covrd[^a$1\\b]✅\n\n[^a$1\\b]: `[~p/A~impl]`\n"
    _, d = _doc(spark, md)
    assert d.apply_error is None
    assert d.content.split("\n")[3] == "`~A~`uncvrd[^a$1\\b]❓"


def test_mixed_eol_misses_lines(spark):
    """With one CRLF the lines are those between CRLFs: an action beyond them is an error."""
    _, d = _doc(spark, "---\r\ntrace.package: p\n---\n`~A~`\n")
    assert d.apply_error == "line 4 lies beyond the end of /w/shop/d.md"
    _, d = _doc(spark, "---\r\ntrace.package: p\r\n---\r\n`~A~`\r\nlast\n")
    assert d.apply_error is None and d.content.endswith("`~A~`uncvrd[^1]❓\r\nlast\n\r\n\r\n[^1]: `[~p/A~impl]`\r\n")


def test_replacement_character_is_ordinary_text(spark):
    _, d = _doc(spark, "---\ntrace.package: p\n---\n`~A~` \ufffd\n")
    assert d.apply_error is None and "❓ \ufffd\n" in d.content


def test_docs_sink_writes_good_documents_and_lists_the_others(spark):
    from tracegraph.sources.inventory import docs_sink

    docs = {"d.md": "---\ntrace.package: p\n---\n`~A~`\n", "e.md": "---\r\ntrace.package: p\n---\n`~B~`\n"}
    r = trace(make_files(spark, docs), make_repos(spark))
    target = tempfile.mkdtemp(prefix="tg-sink-", dir="/tmp") + "/out"
    for mode in ("overwrite", "append"):
        report = docs_sink(r.docs, target, mode)
        assert report.written == 1
        assert [x.path for x in report.failed.collect()] == ["/w/shop/e.md"]
    assert [x.path for x in spark.read.parquet(target).collect()] == ["/w/shop/d.md"] * 2


def test_incremental_sink_writes_what_changed(spark):
    import glob
    import os

    from tracegraph.sources.inventory import docs_sink, sink_documents

    schema = "path string, rel_path string, repo_id string, content string, changed boolean, apply_error string"

    def docs(*rows):
        return spark.createDataFrame([(f"/{repo}/{path}", path, repo, text, ok, error) for repo, path, text, ok, error in rows], schema)

    def files():
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(target + "/repo_id=*/*.parquet")}

    def stored():
        return sorted(((r.repo_id, r.rel_path, r.content) for r in sink_documents(spark, target).collect()), key=str)

    target = tempfile.mkdtemp(prefix="tg-sink-", dir="/tmp") + "/out"
    one, two, none = ("1", "a.md", "A", True, None), ("2", "b.md", "B", True, None), (None, "n.md", "N", True, None)
    start = docs(one, two, none, ("1", "bad.md", "x", True, "no"), ("2", "same.md", "x", False, None))
    report = docs_sink(start, target, "incremental")
    assert report.written == 3 and [r.path for r in report.failed.collect()] == ["/1/bad.md"]
    assert stored() == [("1", "a.md", "A"), ("2", "b.md", "B"), (None, "n.md", "N")]
    before = files()
    assert docs_sink(start, target, "incremental").written == 0 and files() == before
    # one repository changes: only its partition is written
    assert docs_sink(docs(one, ("2", "b.md", "B2", True, None), none), target, "incremental").written == 1
    after = files()
    assert {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)} == {f for f in before.keys() | after.keys() if "repo_id=2" in f}
    # a repository without documents is not read any more, and comes back when it has some
    assert docs_sink(docs(one, none), target, "incremental").written == 0
    assert [r[0] for r in stored()] == ["1", None]
    assert docs_sink(docs(one, two, none), target, "incremental").written == 1
    assert ("2", "b.md", "B") in sink_documents(spark, target).select("repo_id", "rel_path", "content").collect()
    # a run lost before its manifest row was closed is repeated
    lost = spark.createDataFrame([("1", 1, "", 99)], "repo_id string, documents long, digest string, run long")
    lost.write.mode("append").parquet(target + "/_manifest")
    assert docs_sink(docs(one, two, none), target, "incremental").written == 1
    empty = tempfile.mkdtemp(prefix="tg-sink-", dir="/tmp") + "/out"
    assert docs_sink(docs(one).limit(0), empty, "incremental").written == 0


def test_no_limit_by_default(spark):
    long_line, big = "x" * 70_000, "y\n" * 70_000
    md = "---\ntrace.package: p\n---\n" + long_line + "\n`~A~`\n" + big + "`~B~`\n"
    files = {"a.md": md, "src/a.go": big + "x [~p/B~impl]\n"}
    r = trace(make_files(spark, files), make_repos(spark))
    assert {(c.name, c.status) for c in r.coverage.collect()} == {("A", "uncvrd"), ("B", "covrd")}
    assert r.skipped.count() == 0 and r.scan_ok
    limited = trace(make_files(spark, files), make_repos(spark), max_bytes=131072, max_line_bytes=65536)
    assert sorted(x.path for x in limited.skipped.collect()) == ["/w/shop/a.md", "/w/shop/src/a.go"]
    cut = trace(make_files(spark, files), make_repos(spark), max_line_bytes=65536)
    assert [(e.path, e.line_no) for e in cut.errors.collect()] == [("/w/shop/a.md", 0)] and cut.actions.count() == 0


def test_repository_errors_stop_the_run(spark):
    files = make_files(spark, {"a.md": "---\ntrace.package: p\n---\n`~A~`\n", "src/t.go": "x [~p/A~impl]\n"})
    cases = {
        "no known provider hosts https://host.example/a/b": [("r1", "/w/shop", "https://host.example/a/b", True, False)],
        "no branch named main or master": [("r1", "/w/shop", "https://github.com/a/b", False, False)],
        "unknown repository: r1": [("other", "/o", "https://github.com/a/b", True, False)],
    }
    for message, rows in cases.items():
        r = trace(files, make_repos(spark, rows))
        assert [(e.phase, e.path, e.line_no, e.message) for e in r.errors.collect()] == [("scan", "/w/shop", 0, message)]
        assert not r.scan_ok and r.actions.count() == 0 and r.docs.count() == 0


def test_tracked_list_as_a_table(spark):
    files = make_files(spark, {"a.md": "x\n", "b.md": "y\n"}).drop("tracked")
    tracked = spark.createDataFrame([("r1", "b.md"), ("r1", "b.md"), ("r2", "a.md")], "repo_id string, rel_path string")
    assert [r.rel_path for r in I.tracked_semi_join(files, tracked).collect()] == ["b.md"]


def test_read_tree_feeds_trace(spark):
    root = tempfile.mkdtemp(prefix="tg-tree2-", dir="/tmp")
    docs = {"docs/a.md": "---\ntrace.package: p\n---\n`~A~`\n", "src/t.go": "x [~p/A~impl]\n", "big.md": "y" * 200}
    for rel, text in docs.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as fh:
            fh.write(text)
    files = I.read_tree(spark, [(root, "r1")], max_bytes=100)
    assert files.filter(F.col("rel_path") == "big.md").first().content is None
    r = trace(files, make_repos(spark), max_bytes=100)
    assert r.stats.first().skipped_files == 1
    acts = [(a.type, a.line_no) for a in r.actions.orderBy("seq").collect()]
    assert acts == [("Site", 4), ("Footnote", 0)]


def test_folder_source_plans_by_bytes_and_pushes_filters(spark):
    from tracegraph.sources import tree as TR

    root = tempfile.mkdtemp(prefix="tg-tree-", dir="/tmp") + "/shop"
    os.makedirs(root + "/one/.git")
    for i in range(60):  # one folder with all files
        with open(f"{root}/one/f{i:02}.go", "wb") as fh:
            fh.write(b"x" * 1000)
    with open(root + "/one/big.go", "wb") as fh:
        fh.write(b"y" * 50_000 + b"\xff")
    with open(root + "/one/.git/config", "w") as fh:
        fh.write("z")
    files = TR.read_tree(spark, [(root, "r1"), (root + "/one", "r2")], split_bytes=10_000)
    got = files.select("root_ord", "rel_path", "length", F.spark_partition_id().alias("p"), F.length("content").alias("n"), "decodable").collect()
    assert len(got) == 122 and all(r.n == r.length for r in got)
    assert {r.rel_path for r in got if r.root_ord == 1} == {r.rel_path[4:] for r in got if r.root_ord == 0}
    assert [r.decodable for r in got if "big" in r.rel_path] == [False, False] and all(r.decodable for r in got if "big" not in r.rel_path)
    parts = {}
    for r in got:
        parts.setdefault(r.p, []).append(r.length)
    assert len(parts) >= 12 and all(sum(x) - max(x) <= 10_000 for x in parts.values())
    small = files.filter((F.col("length") <= 1000) & F.col("path").endswith("7.go"))
    assert small.count() == 12
    reader = TR.FolderReader({"manifest": "x"})
    from pyspark.sql.datasource import EqualTo, LessThanOrEqual, StringEndsWith

    kept = list(reader.pushFilters([LessThanOrEqual(("length",), 1000), StringEndsWith(("path",), "7.go"), EqualTo(("repo_id",), "r1")]))
    assert [type(f) for f in kept] == [EqualTo]
    assert reader.wanted({"length": 1000, "path": "a7.go"}) and not reader.wanted({"length": 1001, "path": "a7.go"})
    dots = TR.read_tree(spark, [(root, "r1")], dot_folders=True)
    assert dots.filter(F.col("rel_path") == "one/.git/config").count() == 1
    empty = tempfile.mkdtemp(prefix="tg-tree-", dir="/tmp")
    assert TR.read_tree(spark, [(empty, "r1")]).count() == 0


def test_chunked_rewrite_equals_the_whole(spark):
    """Random line ends, blank ends, edits (some of moved or missing lines) and appended
    footnotes: chunks of any size give the documents of one row, errors included."""
    import hashlib
    import random

    from tracegraph.operators import rewrite as R

    rnd = random.Random(5)
    files, acts = [("empty.md", ""), ("ends.md", "\r\n"), ("plain.md", "a\n\r\nb")], []
    for k in range(60):
        ends = rnd.choice([["\n"], ["\r\n"], ["\n", "\r\n", "\r"]])
        lines = [rnd.choice(["`~it.a~`", "- `~x~` é", "[^1]: `[~p/x~impl]`", "", " ", "text", "😀 �"]) for _ in range(rnd.randint(0, 12))]
        files.append((f"{k}.md", "".join(x + rnd.choice(ends) for x in lines) + rnd.choice(["", "end", "`~z~`", "\n\n", "\r\n\r\n"])))
    for path, text in files:
        parts, seq = text.split("\r\n" if "\r\n" in text else "\n"), 0
        for n, line in enumerate([*parts, "beyond"], 1):
            if rnd.random() < (0.7 if "~`" in line or "[^1]: " in line else 0.03):
                seq += 1
                kind, data = ("Site", "`~it.a~`covrd[^1]✅") if "~`" in line else ("Footnote", "[^1]: `[~p/x~impl]` [$1](u)")
                seen = line if rnd.random() < 0.95 else "other"
                acts.append((path, seq, kind, n, "x", data, hashlib.md5(seen.encode()).hexdigest()))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            seq += 1
            acts.append((path, seq, "Footnote" if rnd.random() < 0.9 else "Site", 0, "x", f"[^{seq}]: `[~p/y~impl]`", None))
    f = spark.createDataFrame([(p, t, p != "7.md", "r") for p, t in files], "path string, content string, decodable boolean, repo_id string")
    a = spark.createDataFrame(acts, C.ACTIONS_SCHEMA)
    rows = lambda d: sorted((r.path, r.repo_id, r.content, r.changed, r.apply_error or "") for r in d.collect())
    want = rows(R.apply_actions(f, a))
    assert len(want) > 40 and 5 < sum(bool(r[-1]) for r in want) < 40
    for size in (1, 7, 1 << 20):
        assert rows(R.apply_actions_chunked(f, a, size)) == want, size
    for text in ("\r" * 5000 + "\r\n" * 3 + "x" * 50_000, "a\n" * 20_000):  # long lines do not recurse
        got = R.text_chunks(spark.createDataFrame([("p", text)], "path string, content string"), 100).orderBy("chunk").collect()
        assert got[0].eol.join(x for r in got for x in r._lines) == (text[:-1] if text.endswith("\n") else text)


def test_chunked_rewrite_splits_no_whole_document(spark):
    from tracegraph.operators import rewrite as R

    f = spark.createDataFrame([("p", "a\n")], "path string, content string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    a = spark.createDataFrame([], C.ACTIONS_SCHEMA)
    assert "split(content" in plan(R.apply_actions(f, a))
    chunked = plan(R.apply_actions_chunked(f, a))
    assert "split(text" in chunked and "split(content" not in chunked and "UDF" not in chunked
    windows = [x for x in chunked.splitlines() if x.lstrip("+-: ").startswith("Window [")]
    assert windows and not any("_lines" in w or "content" in w for w in windows)
