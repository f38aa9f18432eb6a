"""Random documents built from blocks whose records are known by construction: a block says
which text it adds and which records that text holds in the state in which it stands, so the
expectation never reads the text back."""

import random

from conftest import make_files, make_repos

from tracegraph import trace

# (text, tag, site, footnote, error code); records hold for a line outside header and code
BLOCKS = [
    ("prose only", None, None, None, None),
    ("", None, None, None, None),
    ("`~it.R{k}~`", None, ("it.R{k}", "", "", ""), None, None),
    ("see `~it.R{k}~`uncvrd[^{k}]❓ here", None, ("it.R{k}", "uncvrd", "{k}", "❓"), None, None),
    ("- `~it.R{k}~` covered[^a{k}] ✅", None, ("it.R{k}", "covered", "a{k}", "✅"), None, None),
    ("`~it.R{k}~`covrd[^{k}]", None, ("it.R{k}", "covrd", "{k}", ""), None, None),
    ("`~it.R{k}~`maybe[^{k}]", None, None, None, "covstatus"),
    ("`~it.R{k}~`[^{k}]", None, None, None, "covstatus"),
    ("`~A{k}~` and `~B{k}~`", None, None, None, "multisites"),
    ("`~{k}x~`", None, ("{k}x", "", "", ""), None, "reqident"),
    ("[^{k}]: `[~p/it.R{k}~impl]`", None, None, ("{k}", "p"), None),
    (" [^n{k}]: plain note", None, None, ("n{k}", ""), None),
    ("x [~p/it.R{k}~test] y", ("p", "it.R{k}", "test"), None, None, None),
    ("`[~p/it.R{k}~test]` is quoted", None, None, None, None),
    ("[~p/it.R{k}~test] at the start", None, None, None, None),
]


def build(rng):
    """A document and its expected (ignored, tags, sites, footnotes, errors)."""
    lines, tags, sites, foots, errs = [], set(), set(), set(), set()
    package = rng.choice(["p", "p.q", "ignoreme.p", None])
    if package:
        lines += ["---", f"title: `~it.H~` x [~p/H~impl]", f"trace.package:  {package} ", "---"]
        tags.add((2, "p", "H", "impl"))  # tags count in the header, sites do not
    open_line = None
    for _ in range(rng.randrange(1, 30)):
        if rng.random() < 0.15:
            lines.append(rng.choice(["```", "  ```go"]))
            open_line = len(lines) if open_line is None else None
            continue
        text, tag, site, foot, err = rng.choice(BLOCKS)
        k = rng.randrange(9)
        at = lambda values: tuple(v.format(k=k) for v in values)  # noqa: E731, B023
        lines.append(text.format(k=k))
        if open_line is not None:
            continue
        n = len(lines)
        if tag:
            tags.add((n, *at(tag)))
        if site:
            sites.add((n, *at(site)))
        if foot:
            foots.add((n, *at(foot)))
        if err:
            errs.add((err, n))
    if open_line is not None:
        errs.add(("unmatchedfence", open_line))
    ignored = bool(package) and package.startswith("ignoreme")
    return "\n".join(lines) + rng.choice(["", "\n"]), (ignored, tags, sites, foots, errs)


def test_documents_built_from_known_blocks(spark):
    rng = random.Random(11)
    built = {f"d{i}.md": build(rng) for i in range(80)}
    r = trace(make_files(spark, {name: text for name, (text, _) in built.items()}), make_repos(spark))

    def by_file(df, *cols):
        out = {}
        for row in df.select("path", *cols).collect():
            out.setdefault(row.path.split("/")[-1], set()).add(tuple(row)[1:])
        return out

    tags = by_file(r.all_tags, "line_no", "package", "name", "cov_type")
    sites = by_file(r.sites, "line_no", "name", "status_word", "footnote_id", "emoji")
    foots = by_file(r.footnotes, "line_no", "footnote_id", "package")
    errs = by_file(r.scan_errors, "code", "line_no")
    ignored = {row.path.split("/")[-1] for row in r.ignored_files.collect()}
    for name, (_, want) in built.items():
        assert (name in ignored) == want[0], name
        if want[0]:
            assert name not in sites and name not in errs
            continue
        got = tags.get(name, set()), sites.get(name, set()), foots.get(name, set()), errs.get(name, set())
        assert got == want[1:], name


def test_segmented_state_equals_the_window(spark):
    """Files in chunks of 1, 3 and 1,000 lines, and only some of them in chunks."""
    rng = random.Random(5)
    built = {f"d{i}.md": build(rng)[0] for i in range(60)}
    built |= {"empty.md": "", "dashes.md": "---\n---\n---\n```\n---\n`~A~`", "open.md": "---\n" * 1 + "x\n" * 40 + "trace.package: p\n---\n`~A~`\n```\n"}
    files = make_files(spark, built)

    def rows(**opts):
        s = trace(files, make_repos(spark), **opts).md_state
        return s.columns, sorted(map(str, s.select(*sorted(s.columns)).collect()))

    columns, want = rows()
    for opts in ({"chunk_lines": 1}, {"chunk_lines": 3}, {"chunk_lines": 1000}, {"chunk_lines": 3, "long_bytes": 150}):
        got = rows(**{"long_bytes": 0, **opts})
        assert sorted(got[0]) == sorted(columns) and got[1] == want, opts
