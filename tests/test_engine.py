"""Fixtures F1-F5: end to end, line cases, state cases, package mismatch,
semantic and identity rules. Expected rows are written by hand from the rules."""

from conftest import U, make_files, make_repos

from tracegraph import trace

F1_MD = f"""---
trace.package: shop.cart
---

Adding an item `~it.Add~` updates the total.
Removing `~it.Remove~`uncvrd[^1]❓ restores it.
Totals `~cmp.Total~`covrd[^2]✅ are rounded.
Legacy `~cmp.Old~`covered[^x]✅
Lost `~cmp.Lost~`uncvrd[^9]❓

[^1]: `[~shop.cart/it.Remove~impl]`
[^2]: `[~shop.cart/cmp.Total~impl]` [src/t.go:2:impl]({U}/src/t.go#L2)
[^x]: `[~shop.cart/cmp.Old~impl]` [src/gone.go:1:impl]({U}/src/gone.go#L1)
"""
F1_GO = """package shop
// [~shop.cart/cmp.Total~impl]
// [~shop.cart/it.Add~test] and [~shop.cart/it.Add~impl]
[~shop.cart/cmp.Old~impl]
"""


def _run(spark, docs, **kw):
    return trace(make_files(spark, docs), make_repos(spark), **kw)


def _errs(df):
    return sorted((r.code, r.path.split("/")[-1], r.line_no, r.message) for r in df.collect())


def test_f1_end_to_end(spark):
    r = _run(spark, {"docs/a.md": F1_MD, "src/t.go": F1_GO})
    tags = sorted((t.line_no, t.name, t.cov_type) for t in r.tags.collect())
    assert tags == [(2, "cmp.Total", "impl"), (3, "it.Add", "impl"), (3, "it.Add", "test")]
    assert r.errors.count() == 0
    acts = [(a.seq, a.type, a.line_no, a.name, a.data) for a in r.actions.orderBy("seq").collect()]
    assert acts == [
        (1, "Site", 5, "it.Add", "`~it.Add~`covrd[^10]✅"),
        (2, "Footnote", 0, "it.Add",
         f"[^10]: `[~shop.cart/it.Add~impl]` [src/t.go:3:impl]({U}/src/t.go#L3), [src/t.go:3:test]({U}/src/t.go#L3)"),
        (3, "Site", 8, "cmp.Old", "`~cmp.Old~`uncvrd[^x]❓"),
        (4, "Footnote", 13, "cmp.Old", "[^x]: `[~shop.cart/cmp.Old~impl]`"),
        (5, "Footnote", 0, "cmp.Lost", "[^9]: `[~shop.cart/cmp.Lost~impl]`"),
    ]
    doc = r.docs.collect()
    assert len(doc) == 1 and doc[0].apply_error is None
    lines = doc[0].content.split("\n")
    assert lines[4] == "Adding an item `~it.Add~`covrd[^10]✅ updates the total."
    assert lines[7] == "Legacy `~cmp.Old~`uncvrd[^x]❓"
    assert lines[12] == "[^x]: `[~shop.cart/cmp.Old~impl]`"
    assert lines[13].startswith("[^10]: ") and lines[14] == "[^9]: `[~shop.cart/cmp.Lost~impl]`"
    assert lines[15] == "" and len(lines) == 16  # one final LF, no separator before [^10]
    # idempotence: a second run on the rewritten text has nothing to do
    r2 = _run(spark, {"docs/a.md": doc[0].content, "src/t.go": F1_GO})
    assert r2.errors.count() == 0 and r2.actions.count() == 0


F2_MD = """---
trace.package: p
---
`~A~` `~B~`uncvrd[^1]❓
`~1a~`
`~A~`maybe[^1]
`~A~`[^1]
`~C~`uncvrd
`~D~` uncvrd [^1] ❓
[^n]: plain note
[^5]:
"""
F2_GO = """x [~p/a~impl]
[~p/a~impl]
`[~p/a~impl]`
x[~p/a~impl][~p/b~impl]
x [~p/a/b~impl]
"""


def test_f2_line_cases(spark):
    r = _run(spark, {"a.md": F2_MD, "x.go": F2_GO})
    sites = sorted((s.line_no, s.name, s.status_word, s.footnote_id, s.emoji, s.annotated) for s in r.sites.collect())
    assert sites == [
        (5, "1a", "", "", "", False),
        (8, "C", "", "", "", False),
        (9, "D", "uncvrd", "1", "❓", True),
    ]
    assert _errs(r.scan_errors) == [
        ("covstatus", "a.md", 6, "CoverageStatusWord shall be 'covered' or 'uncvrd': maybe"),
        ("covstatus", "a.md", 7, "CoverageStatusWord shall be 'covered' or 'uncvrd': "),
        ("multisites", "a.md", 4, "only one RequirementSite is allowed per line: `~A~`,  `~B~`uncvrd[^1]❓"),
        ("reqident", "a.md", 5, "RequirementName shall be an identifier"),
    ]
    fns = sorted((f.line_no, f.footnote_id, f.package) for f in r.footnotes.collect())
    assert fns == [(10, "n", ""), (11, "5", "")]
    tags = sorted((t.line_no, t.package, t.name, t.cov_type) for t in r.all_tags.collect())
    assert tags == [(1, "p", "a", "impl"), (4, "p", "a", "impl"), (5, "", "", "impl")]
    # scan errors stop the analysis (Q35)
    assert not r.scan_ok and r.coverage.count() == 0 and r.actions.count() == 0


def test_f3_state_cases(spark):
    docs = {
        "a.md": "---\ntrace.package: p\n`~A~`\n",
        "b.md": " ---\ntrace.package: p\n---\n`~A~`\n",
        "c.md": "---\ntrace.package: p\n---\n```\nx [~p/A~t]\n`~A~`\n```\n`~B~`\n",
        "d.md": "---\ntrace.package: p\n---\n``` x [~p/A~t]\n```\n`~A~`\n",
        "f.md": "---\ntrace.package: p\ntrace.package: q\n---\n`~A~`\n",
        "g.md": "---\ntrace.package: 1x\ntrace.package: ignoreme.z\n---\n`~A~` `~B~`\n",
        "i.go": "```\nx [~p/A~t]\n",
    }
    r = _run(spark, docs)
    sites = sorted((s.path.split("/")[-1], s.line_no, s.name) for s in r.sites.collect())
    assert sites == [("b.md", 4, "A"), ("c.md", 8, "B"), ("d.md", 6, "A"), ("f.md", 5, "A")]
    tags = sorted((t.path.split("/")[-1], t.line_no) for t in r.tags.collect())
    assert tags == [("d.md", 4), ("i.go", 2)]
    pk = {p.path.split("/")[-1]: (p.package, p.ignored) for p in r.file_pkgs.collect()}
    assert pk["f.md"] == ("q", False) and pk["g.md"][1] is True and "b.md" not in pk
    assert r.scan_errors.count() == 0  # g.md's pkgident and multisites vanish with the file (Q12)
    assert _errs(r.semantic_errors) == [
        ("nopkgidreqs", "b.md", 4, "markdown file with RequirementSites shall define trace.package")
    ]
    e = _run(spark, {"e.md": "---\ntrace.package: p\n---\n```\n`~A~`\n"})
    assert _errs(e.scan_errors) == [
        ("unmatchedfence", "e.md", 4, "opening code block fence at line 4 has no matching closing fence")
    ]
    h = _run(spark, {"h.md": "---\ntrace.package: p\n---\n`~A~`\n"}, ignore_lines=["^---"])
    assert [x[0] for x in _errs(h.errors)] == ["nopkgidreqs"]


def test_f4_package_mismatch_multiplicity(spark):
    md = "---\ntrace.package: p\n---\n\n`~A~`\n`~B~`uncvrd[^2]\n\n\n\n[^1]: `[~q/A~impl]`\n[^2]: `[~p/B~impl]`\n[^3]: `[~q/C~impl]`\n"
    r = _run(spark, {"a.md": md})
    errs = _errs(r.errors)
    assert [(e[0], e[2]) for e in errs] == [("pkgmismatch", 10), ("pkgmismatch", 10), ("pkgmismatch", 12)]
    assert errs[0][3] == "CoverageFootnote package (q) is not consistent with PackageId in the header (p)"
    assert r.actions.count() == 0  # semantic errors stop apply


def test_f5_duplicates_and_missing_package(spark):
    hdr = "---\ntrace.package: p\n---\n"
    pad = lambda n: "\n" * (n - 4)
    docs = {
        "a.md": hdr + pad(10) + "`~X~`\n",
        "b.md": hdr + pad(20) + "`~X~`\n",
        "c.md": hdr + pad(5) + "`~X~`\n",
        "n.md": "\n" * 9 + "`~Y~`\n\n`~Z~`\n",
    }
    r = _run(spark, docs)
    errs = _errs(r.errors)
    dup = [e for e in errs if e[0] == "dupreqid"]
    assert [(e[1], e[2]) for e in dup] == [("a.md", 10), ("a.md", 10)]
    assert sorted(e[3].split("\t")[-1] for e in dup) == ["/w/shop/b.md:20", "/w/shop/c.md:5"]
    assert [(e[0], e[1], e[2]) for e in errs if e[0] == "nopkgidreqs"] == [("nopkgidreqs", "n.md", 10)]


def test_f5_footnote_ids(spark):
    hdr = "---\ntrace.package: p\n---\n"
    md = hdr + "`~S1~`\n`~S2~`\n" + "".join(
        f"[^{i}]: `[~p/Z{n}~impl]`\n" for n, i in enumerate(["3", "+7", "x", "-2", " 9"])
    )
    md2 = hdr + "`~T~`uncvrd[^21]❓\n`~U~`\n[^19]: `[~p/V~impl]`\n"
    r = _run(spark, {"a.md": md, "b.md": md2})
    ids = sorted((c.path.split("/")[-1], c.name, c.new_footnote_id) for c in r.coverage_all.filter("not annotated").collect())
    assert ids == [("a.md", "S1", "8"), ("a.md", "S2", "9"), ("b.md", "U", "22")]


def test_f5_coverers_and_diff(spark):
    hdr = "---\ntrace.package: p\n---\n"
    md = (
        hdr
        + "`~T~`\n"
        + "`~U~`covrd[^1]✅\n"
        + "`~V~`covered[^2]✅\n"
        + "`~W~`uncvrd[^3]❓\n`~W2~`uncvrd[^3]❓\n\n"
        + f"[^1]: `[~p/U~impl]` [s.go:1:impl]({U}/s.go#L1)\n"
        + f"[^2]: `[~p/V~impl]` [s.go:2:impl]({U}/s.go#L2)\n"
        + "[^3]: `[~p/W~impl]`\n"
    )
    src = "x [~p/U~test]\nx [~p/V~impl]\nx [~p/T~impl] [~p/T~impl]\nx [~p/W~impl]\nx [~p/W2~impl]\n"
    r = _run(spark, {"a.md": md, "s.go": src})
    assert r.errors.count() == 0
    acts = [(a.type, a.line_no, a.name, a.data) for a in r.actions.orderBy("seq").collect()]
    t_fn = f"[^4]: `[~p/T~impl]` [s.go:3:impl]({U}/s.go#L3), [s.go:3:impl]({U}/s.go#L3)"
    assert acts[0] == ("Site", 4, "T", "`~T~`covrd[^4]✅")
    assert acts[1] == ("Footnote", 0, "T", t_fn)  # Q26: two equal coverers
    # U: impl -> test on the same URL changes nothing (Q21); V: legacy word -> site only (Q23)
    assert ("Site", 6, "V", "`~V~`covrd[^2]✅") in acts
    assert not [a for a in acts if a[2] in ("U",)] and not [a for a in acts if a[2] == "V" and a[0] == "Footnote"]
    # Q32: two sites share footnote 3; two footnote actions on line 12, the later one wins
    fn3 = [a for a in acts if a[0] == "Footnote" and a[1] == 12]
    assert [a[2] for a in fn3] == ["W", "W2"]
    text = r.docs.collect()[0].content.split("\n")
    assert text[11] == fn3[1][3]


def test_coverer_order(spark):
    from tracegraph.functions import text as T
    from tracegraph.operators import coverage as C
    from tracegraph.operators.numbering import joined_text

    rows = [("impl", "m.go", 30, "u30", "m.go:30:impl"), ("impl", "m.go", 4, "u4", "m.go:4:impl"), ("test", "a.go", 9, "u9", "a.go:9:test")]
    df = spark.createDataFrame(rows, "cov_type string, file string, line_no int, url string, label string")
    ranked = C.ranked_coverers(df.selectExpr("'p' AS package", "'n' AS name", "*")).withColumn("item", T.coverer_link("label", "url"))
    got = joined_text(ranked, ["package", "name"], "ord", "item", ", ").first().text
    assert got == "[m.go:4:impl](u4), [m.go:30:impl](u30), [a.go:9:test](u9)"


def test_overlapping_roots_make_every_site_a_duplicate(spark):
    md = "---\ntrace.package: p\n---\n`~A~`\n"
    a = make_files(spark, {"a.md": md}, root_ord=0)
    b = make_files(spark, {"a.md": md}, root_ord=1)
    r = trace(a.unionByName(b), make_repos(spark))
    assert [e[0] for e in _errs(r.errors)] == ["dupreqid"]


def test_types_registry(spark):
    md = "---\ntrace.package: p\n---\n`~it.A~`\n`~sys.B~`\n`~C~`maybe[^1]\n"
    r = _run(spark, {"a.md": md}, types="it, ,cmp")
    errs = _errs(r.scan_errors)
    assert ("reqtype", "a.md", 5, "requirement type must be one of [it cmp]: sys.B") in errs
    assert not [e for e in errs if e[0] == "reqtype" and e[2] == 6]  # unknown word stops first (Q16)
    types_df, idents = r.types
    assert sorted(tuple(x) for x in types_df.collect()) == [("cmp", 2), ("it", 0)] and idents == ["it", "cmp"]


def test_analyze_prepared_records(spark):
    """Entry C: the analyser on hand-made records (no text), as in the
    original tool's analyser tests: a bare site after ids 19 and 21 gets 22."""
    from tracegraph.plans.trace import analyze

    sites = spark.createDataFrame(
        [
            (0, "r1", "/w/shop/a.md", "a.md", 5, "p", "A", "21", "uncvrd", "❓", True),
            (0, "r1", "/w/shop/a.md", "a.md", 6, "p", "B", "", "", "", False),
        ],
        "root_ord int, repo_id string, path string, rel_path string, line_no int, package string, name string, "
        "footnote_id string, status_word string, emoji string, annotated boolean",
    )
    footnotes = spark.createDataFrame([(0, "/w/shop/a.md", 9, "19", "p")], "root_ord int, path string, line_no int, footnote_id string, package string")
    coverers = spark.createDataFrame([], "root_ord int, path string, line_no int, cov_ord int, label string, url string")
    tags = spark.createDataFrame(
        [(0, "r1", "/w/shop/t.go", "t.go", 2, "p", "B", "impl")],
        "root_ord int, repo_id string, path string, rel_path string, line_no int, package string, name string, cov_type string",
    )
    res = analyze(sites, footnotes, coverers, tags, make_repos(spark))
    assert res.errors.count() == 0
    acts = [(a.type, a.line_no, a.data) for a in res.actions.orderBy("seq").collect()]
    assert acts[0] == ("Footnote", 0, "[^21]: `[~p/A~impl]`")  # A has no footnote 21 (Q25)
    assert acts[1] == ("Site", 6, "`~B~`covrd[^22]✅")
    assert acts[2][0:2] == ("Footnote", 0) and acts[2][2].startswith("[^22]: `[~p/B~impl]` [t.go:2:impl](")


def test_outputs_do_not_depend_on_row_order_or_partitions(spark):
    b_md = "---\ntrace.package: q\n---\n`~X~`\n`~Y~`uncvrd[^3]❓\n\n[^3]: `[~q/Y~impl]`\n"
    docs = {"docs/a.md": F1_MD, "src/t.go": F1_GO, "docs/b.md": b_md, "src/u.go": "x [~q/X~impl]\nx [~q/Y~test]\n"}
    files = make_files(spark, docs)
    base = trace(files, make_repos(spark))
    want = sorted(tuple(a) for a in base.actions.collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        shuffled = files.orderBy(files.path.desc()).repartition(5)
        got = sorted(tuple(a) for a in trace(shuffled, make_repos(spark)).actions.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == want and len(want) > 0


def test_closed_gate_computes_no_stage(spark):
    """A syntax error: neither analysis nor rewrite writes a stage; a semantic error: analysis only."""
    import os

    md = "---\ntrace.package: {}\n---\n`~A~`\n{}"
    runs = {
        "syntax": (trace(make_files(spark, {"d.md": md.format("1bad", "")}), make_repos(spark)), False),
        "semantic": (trace(make_files(spark, {"d.md": md.format("p", "`~A~`\n")}), make_repos(spark)), True),
        "clean": (trace(make_files(spark, {"d.md": md.format("p", "")}), make_repos(spark)), True),
    }
    for name, (r, analysed) in runs.items():
        n = (r.errors.count(), r.coverage.count(), r.actions.count(), r.docs.count())
        stages = set(os.listdir(r._run_dir))
        assert n == {"syntax": (1, 0, 0, 0), "semantic": (1, 1, 0, 0), "clean": (0, 1, 2, 1)}[name]
        assert ("coverage_all" in stages, "new_coverers" in stages) == (analysed, analysed)
        assert ("actions_all" in stages, "docs" in stages) == (name == "clean", name == "clean")
    # the empty relations have the schema of the stages they stand for
    shut, opened = runs["syntax"][0], runs["clean"][0]
    for what in ("coverage", "actions", "docs"):
        assert getattr(shut, what).dtypes == getattr(opened, what).dtypes, what


def test_edits_are_compare_and_set(spark):
    """On mixed line ends a line number may be that of another site: nothing is edited then."""
    from pyspark.sql import functions as F

    lines = ["---", "trace.package: p", "---", "- `~it.a~` shall."]
    lines += [f"- `~it.{c}~`uncvrd[^{i}]❓ shall." for i, c in enumerate("bcd", 2)]
    lines += [""] + [f"[^{i}]: `[~p/it.{c}~impl]`" for i, c in enumerate("bcd", 2)]
    text = "\n".join(lines[:4]) + "\r\n" + "\r\n".join(lines[4:]) + "\r\n"
    r = trace(make_files(spark, {"mixed.md": text, "good.md": text.replace("\r\n", "\n").replace("it.", "cmp.")}), make_repos(spark))
    docs = {d.path.split("/")[-1]: d for d in r.docs.collect()}
    assert r.analyze_ok and r.actions.filter(F.col("line_no") == 4).count() == 2
    assert docs["mixed.md"].apply_error == "line 4 of /w/shop/mixed.md is not the line that was scanned"
    assert docs["good.md"].apply_error is None and "`~cmp.a~`uncvrd[^5]❓" in docs["good.md"].content
    # the same for a document that changed after the scan
    from tracegraph.operators import rewrite as R

    later = make_files(spark, {"good.md": "\n".join(["new first line", *lines]).replace("it.", "cmp.")}).select("path", "content")
    got = R.apply_actions(later, r.actions).collect()
    assert [d.apply_error for d in got] == ["line 4 of /w/shop/good.md is not the line that was scanned"]
