"""Row 62: an annotated corpus rendered from the base tables.

The original tool ships a random corpus generator that writes files to a local
disk. Here the corpus is a *deterministic* Spark job over the TPC-H-like tables,
so that the engine's answers can be derived relationally from the same tables
(the DuckDB oracle never parses the rendered text).

Rendering rules (all shared with the oracle SQL in ``queries/oracle.py``):

* one requirement per ``part`` row ``p``: package ``pkg{p % 7}``, type
  ``it``/``cmp``/``utest`` by ``p % 3``, name ``{type}.p{p}``; it lives in
  ``docs/pkg{p % 7}/s{p_size}/c{p div 7000}.md`` (bounded documents at any
  scale: at most 7,000 / 350 parts per document on dense keys); documents of
  size 50 carry the package ``ignoreme.pkg{n}`` and are therefore dropped;
* layout: 3 header lines and a blank, then per part in key order a prose line
  and a site line (site line = 4 + 2·rn), a blank, the footnotes of variants
  1-3 in rn order, then decoys (a fenced site and tag, a back-quoted tag, a tag
  at column 0);
* annotation variant ``(p div 21) % 5``: 0 bare; 1 ``uncvrd`` with an empty
  footnote; 2 ``covrd`` with the true coverers; 3 legacy ``covered`` with a stale
  coverer; 4 ``uncvrd`` without its footnote;
* one tag per ``lineitem`` row, type A→impl, R→test, else doc; parts whose key
  is a multiple of 4 are tagged under the retired package ``retired`` (their
  tags vanish in the join, the requirement stays uncovered);
* source files ``src/s{suppkey}/c{chunk}.go``, 1,000 tags per file in
  (orderkey, linenumber, partkey, type) order, tag k on line 2k after a filler
  line; suppliers with an even key live in the GitHub repository, odd ones in
  the GitLab one;
* every ``documents`` row becomes a file ``notes/{source}/{lang}/d{id}{ext}``
  (``.md`` en, ``.PY`` fr, ``.yaml`` es, ``.txt`` otherwise); sources ending in 3
  sit in a dot folder; a document is tracked when it has a ``labels`` row.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators.lines import file_kind
from ..operators.numbering import rank_within
from ..session import checkpoint_dir
from .inventory import FILES_SCHEMA, REPOS_SCHEMA

CORPUS_VERSION = "6"
REQ_TYPES = ("it", "cmp", "utest")
DOC_CHUNK = 7000
SRC_FILE_TAGS = 1000
TASK_TAGS = 500_000  # tags that a task brings together into files: bounds its memory
RANK_BUCKET = 1 << 20  # order keys per numbering bucket: bounds both window levels
IGNORED_SIZE = 50
GH = ("gh", "/corpus/gh", "https://github.com/tpch/supply", True, False)
GL = ("gl", "/corpus/gl", "https://gitlab.com/tpch/supply", False, True)
GH_URL = GH[2] + "/blob/main"
GL_URL = GL[2] + "/-/blob/master"
STALE = f"[docs/stale.md:1:impl]({GH_URL}/docs/stale.md#L1)"

# Fault kinds of the faulted corpora, chosen per document by p_size % 10.
SYNTAX_FAULTS = {
    1: "pkgident",
    2: "reqident",
    3: "covstatus_word",
    4: "covstatus_ref",
    5: "urlsyntax",
    6: "multisites",
    7: "unmatchedfence",
    8: "reqtype",
    9: "readline",
}
SEMANTIC_FAULTS = {
    1: "pkgmismatch",
    2: "pkgmismatch",
    3: "pkgmismatch",
    4: "dupreqid",
    5: "dupreqid",
    6: "dupreqid",
    7: "nopkgidreqs",
    8: "nopkgidreqs",
    9: "nopkgidreqs",
}
FAULT_TYPES = "it,cmp,utest"
# Line ends of the ``eol`` corpus, by p_size % 10: CRLF throughout; CRLF after the first line
# only; two blank lines at the end; LF after the first three lines, then CRLF (a tool that cuts
# at CRLF counts three lines less, so a line number there is that of another site).
EOL_CRLF, EOL_MIXED, EOL_BLANK, EOL_SHIFTED = (1, 2), (3, 4), (5, 6), (7, 8)
FAULT_SETS = ("syntax", "semantic", "eol")


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def req_type(key: Column) -> Column:
    return F.when(key % 3 == 0, REQ_TYPES[0]).when(key % 3 == 1, REQ_TYPES[1]).otherwise(REQ_TYPES[2])


#: the same repositories on an unsupported host and without a known branch
BAD_REPOS = (("gh", GH[1], "https://codehost.example/tpch/supply", True, False), ("gl", GL[1], GL[2], False, False))


def repos(spark: SparkSession, bad: bool = False) -> DataFrame:
    return spark.createDataFrame(list(BAD_REPOS) if bad else [GH, GL], REPOS_SCHEMA)


def tracked_list(files: DataFrame) -> DataFrame:
    """The tracked files as a table of their own, ``(repo_id, rel_path)``."""
    return files.filter("tracked").select("repo_id", "rel_path")


#: coverage types by code: in the order of their names, so that codes sort as the names do
COV_TYPES = ("doc", "impl", "test")


def numbered_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags numbered within their supplier (``r``), as numbers only: no text is shuffled."""
    flag = F.col("l_returnflag")
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias("supp"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(flag == "A", 1).when(flag == "R", 2).otherwise(0).cast("tinyint").alias("cov_code"),
    )
    return rank_within(t, ["supp"], ["l_orderkey", "l_linenumber", "l_partkey", "cov_code"],
                       F.floor(F.col("l_orderkey") / RANK_BUCKET), out="r")


def tag_rows(numbered: DataFrame) -> DataFrame:
    """One tag per lineitem, placed in its source file."""
    pk = F.col("l_partkey")
    chunk = F.floor((F.col("r") - 1) / SRC_FILE_TAGS)
    pos = (F.col("r") - 1) % SRC_FILE_TAGS + 1
    return numbered.select(
        "supp",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "cov_code",
        _cov_type(F.col("cov_code")).alias("cov_type"),
        _tag_package(pk).alias("tag_pkg"),
        _req_name(pk).alias("tag_name"),
        chunk.alias("chunk"),
        (2 * pos).cast("int").alias("line_no"),
    ).withColumns({"repo_id": _source_repo(), "rel_path": _source_path()})


def _cov_type(code: Column) -> Column:
    return F.when(code == 1, COV_TYPES[1]).when(code == 2, COV_TYPES[2]).otherwise(COV_TYPES[0])


def _tag_package(pk: Column) -> Column:
    return F.when(pk % 4 == 0, F.lit("retired")).otherwise(F.concat(F.lit("pkg"), _s(pk % 7)))


def _req_name(pk: Column) -> Column:
    return F.concat(req_type(pk), F.lit(".p"), _s(pk))


def _source_repo() -> Column:
    return F.when(F.col("supp") % 2 == 0, F.lit(GH[0])).otherwise(F.lit(GL[0]))


def _source_path() -> Column:
    return F.concat(F.lit("src/s"), _s("supp"), F.lit("/c"), _s("chunk"), F.lit(".go"))


def _file_rows(df: DataFrame, repo_col: Column, rel_col: str) -> DataFrame:
    root_ord = F.when(repo_col == GH[0], F.lit(0)).otherwise(F.lit(1)).cast("int")
    root_path = F.when(repo_col == GH[0], F.lit(GH[1])).otherwise(F.lit(GL[1]))
    return df.select(
        root_ord.alias("root_ord"),
        repo_col.alias("repo_id"),
        root_path.alias("root_path"),
        F.concat(root_path, F.lit("/"), F.col(rel_col)).alias("path"),
        F.col(rel_col).alias("rel_path"),
        F.octet_length("content").cast("bigint").alias("length"),
        "content",
        F.col("tracked").cast("boolean").alias("tracked"),
    )


def _join_lines(lines: Column) -> Column:
    """Sorted (line_no, text) structs to file text with a final LF."""
    return F.concat(F.array_join(F.sort_array(lines)["text"], "\n"), F.lit("\n"))


def source_files(tags: DataFrame, tasks: int | None = None) -> DataFrame:
    """The tags of a file are brought together as numbers, by the numbers it is named after, and
    become text there. They are dealt out before they are grouped: lists of single tags built
    on the side they come from would only be sorted and moved again. ``tasks``: to how many
    tasks (see ``tag_tasks``); otherwise as many as the session has it."""
    numbers = ["line_no", "l_orderkey", "l_linenumber", "l_partkey", "cov_code"]
    keys = ["supp", "chunk"]
    some = tags.select(*keys, *numbers)
    dealt = some.repartition(tasks, *keys) if tasks else some.repartition(*keys)

    def lines(x):
        filler = F.concat(F.lit("// order "), _s(x["l_orderkey"]), F.lit(" line "), _s(x["l_linenumber"]))
        tag = F.concat(F.lit("// covers [~"), _tag_package(x["l_partkey"]), F.lit("/"), _req_name(x["l_partkey"]), F.lit("~"), _cov_type(x["cov_code"]), F.lit("]"))
        # a line with a null is left out
        return F.when(filler.isNotNull() | tag.isNotNull(), F.concat_ws("\n", filler, tag))

    files = dealt.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*numbers))).alias("tags"))
    text = F.concat(F.array_join(F.transform("tags", lines), "\n"), F.lit("\n"))
    files = files.select(_source_repo().alias("repo_id"), _source_path().alias("rel_path"), text.alias("content"), F.lit(True).alias("tracked"))
    return _file_rows(files, F.col("repo_id"), "rel_path")


def tag_tasks(tags: DataFrame) -> int:
    """Tasks for ``source_files`` of staged tags (counted from the footers of their files): a task
    groups about ``TASK_TAGS`` tags at any scale, where the engine would cut tasks by their
    compressed bytes, a small part of what a group takes in memory."""
    return max(tags.sparkSession.sparkContext.defaultParallelism, -(-tags.count() // TASK_TAGS))


def true_coverers(tags: DataFrame) -> DataFrame:
    """Sorted coverer text per part key of the ``covrd`` variant.

    What is brought together is (type, file, line) per coverer, less than the text it becomes;
    tags of other variants are left out before the shuffle."""
    t = tags.filter((F.col("tag_pkg") != "retired") & (variant_of(F.col("l_partkey")) == 2))
    rows = t.groupBy(F.col("l_partkey").alias("p")).agg(F.sort_array(F.collect_list(F.struct("cov_type", "rel_path", "line_no", "repo_id"))).alias("tags"))

    def link(x):
        url = T.coverer_url(F.when(x["repo_id"] == GH[0], F.lit(GH_URL)).otherwise(F.lit(GL_URL)), x["rel_path"], x["line_no"])
        return T.coverer_link(T.coverer_label(x["rel_path"], x["line_no"], x["cov_type"]), url)

    return rows.select("p", F.array_join(F.transform("tags", link), ", ").alias("cov_text"))


def variant_of(p: Column) -> Column:
    return (F.floor(p / 21) % 5).cast("int")


def part_rows(spark: SparkSession, sf_dir: str, header_key: str = P.DEFAULT_HEADER_KEY) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    p = F.col("p_partkey")
    d = part.select(
        p.alias("p"),
        "p_size",
        F.concat(req_type(p), F.lit(".p"), _s(p)).alias("name"),
        F.concat(F.when(F.col("p_size") == IGNORED_SIZE, F.lit(P.IGNORED_PACKAGE_PREFIX + ".pkg")).otherwise(F.lit("pkg")), _s(p % 7)).alias("package"),
        F.concat(F.lit("docs/pkg"), _s(p % 7), F.lit("/s"), _s("p_size"), F.lit("/c"), _s(F.floor(p / DOC_CHUNK)), F.lit(".md")).alias("rel_path"),
        variant_of(p).alias("variant"),
    )
    w = Window.partitionBy("rel_path").orderBy("p")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fn = F.col("variant").isin(1, 2, 3).cast("int")
    return d.select(
        "*",
        F.row_number().over(w).alias("rn"),
        F.count("*").over(whole).alias("k"),
        F.sum(fn).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("j"),
        F.sum(fn).over(whole).alias("m"),
    )


def site_text(name, variant, rn) -> Column:
    ref = F.concat(F.lit("[^"), _s(rn), F.lit("]"))
    ann = (
        F.when(variant == 0, F.lit(""))
        .when(variant.isin(1, 4), F.concat(F.lit(P.STATUS_UNCVRD), ref, F.lit(P.EMOJI_UNCVRD)))
        .when(variant == 2, F.concat(F.lit(P.STATUS_COVRD), ref, F.lit(P.EMOJI_COVERED)))
        .otherwise(F.concat(F.lit(P.STATUS_COVERED), ref, F.lit(P.EMOJI_COVERED)))
    )
    return F.concat(F.lit("- `~"), name, F.lit("~`"), ann, F.lit(" shall hold."))


def fault_lines(faults: str | None, base: Column, p: Column, name: Column, pkg: Column, kind: Column, L) -> Column:
    """Extra line(s) of a faulted document, appended after the decoys."""
    empty = F.array().cast("array<struct<line_no:int,text:string>>")
    if faults in (None, "eol"):
        return empty
    ps = _s(p)
    at = base + 8
    if faults == "syntax":
        cases = {
            2: F.concat(F.lit("- `~1bad.p"), ps, F.lit("~` is not an identifier.")),
            3: F.concat(F.lit("- `~it.w"), ps, F.lit("~`maybe[^z]" + P.EMOJI_UNCVRD + " has an unknown word.")),
            4: F.concat(F.lit("- `~it.r"), ps, F.lit("~`[^z] has no word.")),
            5: F.concat(F.lit("[^u"), ps, F.lit("]: `[~"), pkg, F.lit("/it.u"), ps, F.lit("~impl]` [a:1:impl](::a"), ps,
                        F.lit("), [b:2:impl](http://h st/b"), ps, F.lit(")")),
            6: F.concat(F.lit("- `~it.m"), ps, F.lit("~` and `~it.n"), ps, F.lit("~` twice.")),
            7: F.lit("```"),
            8: F.concat(F.lit("- `~sys.t"), ps, F.lit("~` has an unknown type.")),
            9: F.lit("x" * 70000),
        }
    else:
        cases = {}
        for k in (1, 2, 3):
            cases[k] = F.concat(F.lit("[^f"), ps, F.lit("]: `[~other/it.f"), ps, F.lit("~impl]`"))
        for k in (4, 5, 6):
            cases[k] = F.concat(F.lit("- `~"), name, F.lit("~` again."))
    text = None
    for k, v in cases.items():
        text = F.when(kind == k, v) if text is None else text.when(kind == k, v)
    return F.when(text.isNotNull(), F.array(L(at, text))).otherwise(empty)


def header_line(faults: str | None, header_key: str, pkg: Column, kind: Column) -> Column:
    normal = F.concat(F.lit(header_key + ": "), pkg)
    if faults == "syntax":
        return F.when(kind == 1, F.concat(F.lit(header_key + ": 1"), pkg)).otherwise(normal)
    if faults == "semantic":
        return F.when(kind.isin(7, 8, 9), F.lit("trace.other: x")).otherwise(normal)
    return normal


def document_files(parts: DataFrame, covs: DataFrame, header_key: str = P.DEFAULT_HEADER_KEY, faults: str | None = None) -> DataFrame:
    d = parts.join(covs, "p", "left")
    kind = F.col("p_size") % 10
    rn, k, j, m = F.col("rn"), F.col("k"), F.col("j"), F.col("m")
    v = F.col("variant")
    name, pkg = F.col("name"), F.col("package")
    hint = F.concat(F.lit("[^"), _s(rn), F.lit("]: "), T.footnote_hint(pkg, name))
    foot = (
        F.when(v == 1, hint)
        .when(v == 2, F.when(F.col("cov_text").isNotNull() & (F.col("cov_text") != ""), F.concat(hint, F.lit(" "), F.col("cov_text"))).otherwise(hint))
        .otherwise(F.concat(hint, F.lit(" " + STALE)))
    )

    def L(no, text):
        return F.struct(no.cast("int").alias("line_no"), text.alias("text"))

    base = 5 + 2 * k + m
    per_part = F.array(
        L(3 + 2 * rn, F.concat(F.lit("The part p"), _s("p"), F.lit(" has size "), _s("p_size"), F.lit("."))),
        L(4 + 2 * rn, site_text(name, v, rn)),
    )
    footnote = F.when(v.isin(1, 2, 3), F.array(L(5 + 2 * k + j, foot))).otherwise(F.array().cast("array<struct<line_no:int,text:string>>"))
    doc_lines = F.when(
        rn == 1,
        F.array(
            L(F.lit(1), F.lit("---")),
            L(F.lit(2), header_line(faults, header_key, pkg, kind)),
            L(F.lit(3), F.lit("---")),
            L(F.lit(4), F.lit("")),
            L(5 + 2 * k, F.lit("")),
            L(base + 1, F.lit("")),
            L(base + 2, F.lit("```text")),
            L(base + 3, F.concat(F.lit("- `~"), name, F.lit("~` quoted in code."))),
            L(base + 4, F.concat(F.lit("// [~"), pkg, F.lit("/"), name, F.lit("~impl] inside code"))),
            L(base + 5, F.lit("```")),
            L(base + 6, F.concat(F.lit("Quoted tag `[~"), pkg, F.lit("/"), name, F.lit("~test]` is prose."))),
            L(base + 7, F.concat(F.lit("[~"), pkg, F.lit("/"), name, F.lit("~test] at column zero."))),
        ),
    ).otherwise(F.array().cast("array<struct<line_no:int,text:string>>"))
    extra = F.when(rn == 1, fault_lines(faults, base, F.col("p"), name, pkg, kind, L)).otherwise(
        F.array().cast("array<struct<line_no:int,text:string>>")
    )
    ex = d.select("rel_path", kind.alias("kind"), F.explode(F.concat(per_part, footnote, doc_lines, extra)).alias("l"))
    files = ex.groupBy("rel_path").agg(_join_lines(F.collect_list("l")).alias("content"), F.first("kind").alias("kind"))
    if faults == "eol":
        c, kind = F.col("content"), F.col("kind")
        ends = F.when(kind.isin(*EOL_CRLF), F.replace(c, F.lit("\n"), F.lit("\r\n")))
        # the header of four lines ("---", key, "---", "") stays on LF but for its last line
        head = F.concat(F.substring_index(c, "\n", 3), F.lit("\n"))
        rest = F.substring(c, F.char_length(head) + 1, F.char_length(c))
        ends = ends.when(kind.isin(*EOL_SHIFTED), F.concat(head, F.replace(rest, F.lit("\n"), F.lit("\r\n"))))
        ends = ends.when(kind.isin(*EOL_MIXED), F.concat(F.lit("---\r\n"), F.substring(c, F.lit(5), F.char_length(c))))
        files = files.withColumn("content", ends.when(kind.isin(*EOL_BLANK), F.concat(c, F.lit("\n\n"))).otherwise(c))
    return _file_rows(files.withColumn("tracked", F.lit(True)), F.lit(GH[0]), "rel_path")


def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").withColumn("_l", F.lit(True))
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "fr", ".PY").when(F.col("lang") == "es", ".yaml").otherwise(".txt")
    folder = F.when(F.col("source").endswith("3"), F.concat(F.lit("."), F.col("source"))).otherwise(F.col("source"))
    rel = F.concat(F.lit("notes/"), folder, F.lit("/"), F.col("lang"), F.lit("/d"), _s("doc_id"), ext)
    # labels has at most one row per document; a left join keeps every document
    d = docs.join(labels, "doc_id", "left").select(
        rel.alias("rel_path"), F.col("text").alias("content"), F.coalesce("_l", F.lit(False)).alias("tracked")
    )
    return _file_rows(d, F.lit(GH[0]), "rel_path")


def corpus_from_tables(spark: SparkSession, sf_dir: str, header_key: str = P.DEFAULT_HEADER_KEY,
                       faults: str | None = None) -> DataFrame:
    """The ``files`` table of the rendered corpus (lazy plan). ``faults``:
    ``'syntax'`` or ``'semantic'`` adds one fault per document, chosen by
    ``p_size % 10`` (see ``SYNTAX_FAULTS`` / ``SEMANTIC_FAULTS``); ``'eol'`` varies the
    line ends."""
    parts = corpus_parts(spark, sf_dir, tag_rows(numbered_tags(spark, sf_dir)), header_key, faults)
    return parts["docs"].unionByName(parts["src"]).unionByName(parts["notes"])


def corpus_parts(spark: SparkSession, sf_dir: str, tags: DataFrame, header_key: str = P.DEFAULT_HEADER_KEY, faults: str | None = None,
                 tasks: int | None = None) -> dict:
    """The requirement documents (all Markdown), source files (all ``.go``) and note files."""
    docs = document_files(part_rows(spark, sf_dir, header_key), true_coverers(tags), header_key, faults)
    cols = [f.name for f in FILES_SCHEMA.fields]
    return {"docs": docs.select(*cols), "src": source_files(tags, tasks).select(*cols), "notes": note_files(spark, sf_dir).select(*cols)}


TABLES = ("part", "lineitem", "documents", "labels")
_BUILT: dict = {}


def input_identity(spark: SparkSession, sf_dir: str) -> str:
    """Digest of the input files' names, sizes and times: changed inputs are another corpus."""
    rows = []
    for t in TABLES:
        m = spark.read.parquet(f"{sf_dir}/{t}.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        rows += sorted(str(tuple(r)) for r in m.distinct().collect())
    return hashlib.sha1("\n".join(rows).encode()).hexdigest()[:16]


def corpus(spark: SparkSession, sf_dir: str, faults: str | None = None) -> DataFrame:
    """Materialised corpus for ``sf_dir`` (clean, or with one of ``FAULT_SETS``): written once
    per session to the shared checkpoint folder, partitioned by kind so that a stage that
    needs Markdown only never reads source text. Faults are in Markdown only: the corpora of
    the same tables have their source files in common, ``kind=src`` beside ``kind=md/<faults>``."""
    if faults is not None and faults not in FAULT_SETS:
        raise ValueError(f"unknown fault set: {faults}")
    key = (spark.sparkContext.applicationId, sf_dir, input_identity(spark, sf_dir), faults)
    src = (*key[:3], "kind=src")
    if key not in _BUILT:
        path = _BUILT[src].rsplit("/", 1)[0] if src in _BUILT else checkpoint_dir(spark).rstrip("/") + f"/tracegraph/corpus-{uuid.uuid4().hex[:12]}"
        tags = _tags_once(spark, sf_dir, key[:3])
        parts = corpus_parts(spark, sf_dir, tag_rows(tags), faults=faults, tasks=tag_tasks(tags))
        # one folder per kind, written directly: writing by a partition column would sort whole texts
        notes = file_kind(parts["notes"])
        for kind, files, of, to in (("src", parts["src"], src, f"{path}/kind=src"), ("md", parts["docs"], key, f"{path}/kind=md/{faults}")):
            if of not in _BUILT:
                rows = files.unionByName(notes.filter(F.col("kind") == kind).drop("kind"))
                rows.write.parquet(to)
                _BUILT[of] = to
    return spark.read.option("basePath", _BUILT[src].rsplit("/", 1)[0]).parquet(_BUILT[key], _BUILT[src])


def _tags_once(spark: SparkSession, sf_dir: str, key: tuple) -> DataFrame:
    """The numbered tags, written once per session: every corpus of the same tables has the same."""
    if key not in _BUILT:
        path = checkpoint_dir(spark).rstrip("/") + f"/tracegraph/tags-{uuid.uuid4().hex[:12]}"
        numbered_tags(spark, sf_dir).write.parquet(path)
        _BUILT[key] = path
    return spark.read.parquet(_BUILT[key])
