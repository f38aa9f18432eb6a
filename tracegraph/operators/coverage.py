"""Rows 33-35 and 38-53: requirement identity, site/tag join, coverer lists,
footnote matching, coverage status, diff against recorded footnotes, new
footnote ids and the actions.

Skew notes (a requirement, file or package may hold a large share of rows):

* duplicate detection is a partial aggregation per ``(package, name)`` joined
  back (no window over a hot key);
* the coverage diff compares URL *multisets* through counts per
  ``(package, name, url)`` (one partial aggregation of both sides), so unchanged
  requirements never build a list;
* only requirements that need a footnote rewrite assemble their coverer list. Beyond
  ``LISTED`` coverers numbered rows become text per bucket of ranks and buckets are joined in
  order; shorter lists are brought together as type, file, line and root, less than their text.

Every edit carries the digest of the line that was scanned (``line_digest``), which the
rewrite compares with the line in hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .lines import FILE_KEY
from .numbering import joined_text, rank_within
from .validate import _err

REQ_KEY = ["package", "name"]
SITE_KEY = ["root_ord", "path", "line_no"]


def err_nopkgidreqs(sites_p: DataFrame, header_key: str) -> DataFrame:
    """Row 34: Markdown with sites but no package; line of the first site."""
    bad = sites_p.filter(F.col("package") == "").groupBy(*FILE_KEY).agg(F.min("line_no").alias("line_no"))
    return _err(bad, "analyze", P.ERR_NOPKGIDREQS, F.lit(P.MSG_NOPKGIDREQS + header_key))


def identify(sites_p: DataFrame) -> DataFrame:
    """Rows 33 input: every site of a file with a package, flagged ``is_first``
    when it is the first of its ``(package, name)`` in (root, path, line) order."""
    cand = sites_p.filter(F.col("package") != "")
    firsts = cand.groupBy(*REQ_KEY).agg(F.min(F.struct(*SITE_KEY)).alias("first"))
    j = cand.join(firsts, REQ_KEY)
    is_first = (
        (F.col("root_ord") == F.col("first.root_ord"))
        & (F.col("path") == F.col("first.path"))
        & (F.col("line_no") == F.col("first.line_no"))
    )
    return j.withColumn("is_first", is_first)


def err_dupreqid(ident: DataFrame) -> DataFrame:
    """Row 33: each later site of a known id is an error located at the first
    site and naming the later one (Q33)."""
    dups = ident.filter(~F.col("is_first"))
    msg = F.format_string(
        P.MSG_DUPREQID, F.concat_ws("/", "package", "name"), F.col("path"), F.col("line_no")
    )
    return dups.select(
        F.lit("analyze").alias("phase"),
        F.lit(P.ERR_DUPREQID).alias("code"),
        F.col("first.root_ord").alias("root_ord"),
        F.col("first.path").alias("path"),
        F.col("first.line_no").cast("int").alias("line_no"),
        msg.alias("message"),
    )


def max_footnote_id(ident: DataFrame, footnotes: DataFrame) -> DataFrame:
    """Row 46: largest integer footnote id per file over all its sites and
    footnotes (signs allowed, other ids ignored, floor 0)."""
    files = ident.select(*FILE_KEY).distinct()
    ids = ident.filter(F.col("footnote_id") != "").select(*FILE_KEY, "footnote_id").unionByName(
        footnotes.join(files, FILE_KEY, "left_semi").select(*FILE_KEY, "footnote_id")
    )
    m = ids.groupBy(*FILE_KEY).agg(F.max(T.int_id("footnote_id")).alias("_m"))
    m = files.join(m, FILE_KEY, "left")
    return m.select(*FILE_KEY, F.greatest(F.coalesce("_m", F.lit(0)), F.lit(0)).alias("max_id"))


def digest_of(rows: DataFrame) -> F.Column:
    """The digest of the scanned line; prepared records without text have none."""
    return F.col("line_digest") if "line_digest" in rows.columns else F.lit(None).cast("string")


def footnote_match(reg: DataFrame, footnotes: DataFrame) -> DataFrame:
    """Row 42: per registered site, the first footnote of its file with the
    same id and package (recorded coverers) and the first with the same id in
    any package (line of a footnote rewrite)."""
    f = footnotes.select(*FILE_KEY, "footnote_id", F.col("line_no").alias("f_line"), F.col("package").alias("f_pkg"), digest_of(footnotes).alias("f_digest"))
    s = reg.filter(F.col("footnote_id") != "").select(*SITE_KEY, "footnote_id", "package")
    j = s.join(f, FILE_KEY + ["footnote_id"])
    return j.groupBy(*SITE_KEY).agg(
        F.min("f_line").alias("any_line"),
        F.min_by("f_digest", "f_line").alias("any_digest"),
        F.min(F.when(F.col("f_pkg") == F.col("package"), F.col("f_line"))).alias("match_line"),
    )


def err_pkgmismatch(reg_m: DataFrame, footnotes: DataFrame) -> DataFrame:
    """Row 35 (Q19): per registered site, every footnote of a different package
    that stands before the site's first matching footnote (all of them when
    none matches). Each mismatching footnote counts the sites that stand beyond it, in one
    window over the file's sites and footnotes; the rows per site come from that count.
    Only files with mismatching footnotes (an error condition) take part."""
    mism = footnotes.filter(F.col("package") != F.col("file_package"))
    mism = mism.select(*FILE_KEY, F.col("line_no").alias("f_line"), F.col("package").alias("f_pkg"), F.col("file_package").alias("file_pkg"))
    s = reg_m.join(mism.select(*FILE_KEY).distinct(), FILE_KEY, "left_semi")
    s = s.select(*FILE_KEY, F.coalesce("match_line", F.lit(2**31 - 1)).alias("f_line"), F.lit(1).alias("is_site"))
    both = s.unionByName(mism.withColumn("is_site", F.lit(0)), allowMissingColumns=True)
    beyond = Window.partitionBy(*FILE_KEY).orderBy(F.col("f_line").desc(), "is_site").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("n_sites", F.sum("is_site").over(beyond)).filter((F.col("is_site") == 0) & (F.col("n_sites") > 0))
    pairs = counted.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_sites"))))
    msg = F.format_string(P.MSG_PKGMISMATCH, F.col("f_pkg"), F.col("file_pkg"))
    return _err(pairs, "analyze", P.ERR_PKGMISMATCH, msg, line="f_line")


def site_tag_join(reg: DataFrame, tags: DataFrame) -> DataFrame:
    """Row 38: registered sites left-joined to tags on ``(package, name)``: tags without a
    site vanish, a site without tags stays with nulls on the tag side."""
    s = reg.select(*REQ_KEY, F.col("path").alias("site_path"), F.col("line_no").alias("site_line"))
    t = tags.filter(F.col("name") != "").select(*REQ_KEY, "repo_id", F.col("path").alias("tag_path"), "rel_path", "line_no", "cov_type")
    return s.join(t, REQ_KEY, "left")


def new_coverers(reg: DataFrame, tags: DataFrame, repo_urls: DataFrame) -> DataFrame:
    """Row 39: each pair of site and tag gives a coverer ``rel:line:type`` with its URL."""
    t = site_tag_join(reg, tags).filter(F.col("cov_type").isNotNull())
    t = t.join(repo_urls.select("repo_id", "root_url"), "repo_id", "left")
    return linked(t.withColumnRenamed("rel_path", "file").select(*COVERER_COLS))


#: what a coverer's URL and label are made of; stages and shuffles hold these, not the texts
COVERER_COLS = [*REQ_KEY, "cov_type", "file", "line_no", "root_url"]


def linked(rows: DataFrame) -> DataFrame:
    """``COVERER_COLS`` with the URL and the label."""
    return rows.select(
        *COVERER_COLS,
        T.coverer_url("root_url", "file", "line_no").alias("url"),
        T.coverer_label("file", "line_no", "cov_type").alias("label"),
    )


def current_coverers(reg_m: DataFrame, coverers: DataFrame) -> DataFrame:
    """Row 43: coverers recorded in each site's matching footnote."""
    s = reg_m.filter(F.col("match_line").isNotNull()).select(*FILE_KEY, *REQ_KEY, F.col("match_line").alias("line_no"))
    return s.join(coverers, FILE_KEY + ["line_no"]).select(*REQ_KEY, "cov_ord", "label", "url")


def requirement_stats(cur: DataFrame, new: DataFrame) -> DataFrame:
    """Rows 40, 43, 45 in one pass: per requirement the new and recorded coverer
    counts and whether the two URL lists differ as multisets (Q21). Both sides are counted
    per ``(package, name, url)`` in one aggregation (partial before its shuffle; no sort of
    the URLs), and one aggregation per requirement follows. A null equals nothing on the
    other side, so rows with one are counted by side."""
    key = [*REQ_KEY, "url"]
    odd = F.col("package").isNull() | F.col("name").isNull() | F.col("url").isNull()
    side = lambda rows, is_new: rows.select(*key, F.lit(is_new).alias("_new"), F.when(odd, F.lit(is_new)).alias("_odd"))
    both = side(new, True).unionByName(side(cur, False))
    nn, nc = F.col("n_new"), F.col("n_cur")
    d = both.groupBy(*key, "_odd").agg(F.count(F.when(F.col("_new"), 1)).alias("n_new"), F.count(F.when(~F.col("_new"), 1)).alias("n_cur"))
    return d.groupBy(*REQ_KEY).agg(
        F.sum(nn).cast("bigint").alias("n_coverers"),
        F.sum(nc).cast("bigint").alias("n_current"),
        F.bool_or(nn != nc).alias("changed"),
    )


def ranked_coverers(new: DataFrame) -> DataFrame:
    """Rows 40-41: the coverers of each requirement as rows numbered by type, file, line and
    URL; numbered in two levels, so a requirement with very many tags is no hot task."""
    order = ["cov_type", "file", "line_no", "url"]
    ranked = rank_within(new, REQ_KEY, order, F.struct("cov_type", "file"), out="ord")
    return ranked.select(*REQ_KEY, "ord", "label", "url")


def positions(cov: DataFrame) -> DataFrame:
    """Row 48: position of each registered site among those of its file; the order of its actions."""
    return cov.withColumn("pos", F.row_number().over(Window.partitionBy(*FILE_KEY).orderBy("line_no")))


def coverage(reg_m: DataFrame, new: DataFrame, cur: DataFrame) -> DataFrame:
    """Rows 44, 46, 47: one row per registered requirement with its status, the
    coverer counts, the diff flag and the footnote id to write. ``reg_m`` is the
    registered sites with their footnote match (row 42) and the largest integer
    id of their file (row 46, a window aggregate of the Markdown state)."""
    stats = requirement_stats(cur, new)
    c = reg_m.withColumn("line_digest", digest_of(reg_m)).join(stats, REQ_KEY, "left").withColumnRenamed("file_max_id", "max_id")
    c = c.select(
        *REQ_KEY,
        "root_ord",
        "repo_id",
        "path",
        "rel_path",
        "line_no",
        "status_word",
        "footnote_id",
        "annotated",
        F.col("match_line").isNotNull().alias("has_footnote"),
        "match_line",
        "any_line",
        "line_digest",
        "any_digest",
        F.coalesce("n_coverers", F.lit(0)).cast("bigint").alias("n_coverers"),
        F.coalesce("n_current", F.lit(0)).cast("bigint").alias("n_current"),
        F.coalesce("changed", F.lit(False)).alias("changed"),
        F.coalesce("max_id", F.lit(0)).alias("max_id"),
    )
    c = c.withColumn("status", F.when(F.col("n_coverers") > 0, P.STATUS_COVRD).otherwise(P.STATUS_UNCVRD))
    # Row 47: bare sites take max_id + 1, + 2, ... in line order within their file.
    w = Window.partitionBy(*FILE_KEY, "annotated").orderBy("line_no")
    nxt = (F.col("max_id") + F.row_number().over(w)).cast("string")
    return positions(c.withColumn("new_footnote_id", F.when(F.col("annotated"), F.col("footnote_id")).otherwise(nxt)))


def coverage_by_type(cov: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Row 23: requirements and covered ones per package and type, with subtotals per package and in
    all (``level`` 0, 1, 3). ``order_no`` is the type's place in the registry, null without one. One
    rollup, pre-aggregated before its shuffle; the registry is option text, so it can be broadcast."""
    c = cov.withColumn("req_type", T.requirement_type("name"))
    if types is None:
        c = c.withColumn("order_no", F.lit(None).cast("int"))
    else:
        c = c.join(F.broadcast(types.withColumnRenamed("identifier", "req_type")), "req_type", "left")
    level = F.grouping_id()
    return c.rollup("package", "req_type").agg(
        level.cast("int").alias("level"),
        F.when(level == 0, F.max("order_no")).alias("order_no"),
        F.count("*").alias("n_requirements"),
        F.count(F.when(F.col("status") == P.STATUS_COVRD, 1)).alias("n_covered"),
        F.sum("n_coverers").cast("bigint").alias("n_coverers"),
    )


def site_actions(cov: DataFrame) -> DataFrame:
    """Row 49 (Q23): rewrite a site that is bare or whose word differs."""
    a = cov.filter(~F.col("annotated") | (F.col("status_word") != F.col("status")))
    return a.select(
        "path",
        F.lit(P.ACTION_SITE).alias("type"),
        "pos",
        F.col("line_no").cast("int").alias("line_no"),
        "name",
        T.format_site("name", "status", "new_footnote_id").alias("data"),
        "line_digest",
    )


#: coverers of a requirement that are listed at once; more take numbered buckets
LISTED = 1 << 16


def coverer_texts(new: DataFrame, reqs: DataFrame, listed: int = LISTED) -> DataFrame:
    """Rows 40-41: the text of the sorted coverer list of each of ``reqs`` that has coverers.

    A list of at most ``listed`` coverers is brought together as what its links are made of,
    which is less than its text; only longer ones are numbered and joined in buckets."""
    many = F.col("n_coverers") > listed
    texts = _listed_texts(new.join(reqs.filter(~many).select(*REQ_KEY), REQ_KEY, "left_semi"))
    if reqs.filter(many).isEmpty():
        return texts
    ranked = ranked_coverers(new.join(reqs.filter(many).select(*REQ_KEY), REQ_KEY, "left_semi"))
    item = ranked.withColumn("item", T.coverer_link("label", "url"))
    return texts.unionByName(joined_text(item, REQ_KEY, "ord", "item", ", ", out="coverers"))


def _listed_texts(new: DataFrame) -> DataFrame:
    parts = ["cov_type", "file", "line_no", "root_url"]
    rows = new.select(*COVERER_COLS).groupBy(*REQ_KEY).agg(F.collect_list(F.struct(*parts)).alias("rows"))
    order = lambda x: F.struct(x["cov_type"], x["file"], x["line_no"], T.coverer_url(x["root_url"], x["file"], x["line_no"]).alias("url"))
    link = lambda x: T.coverer_link(T.coverer_label(x["file"], x["line_no"], x["cov_type"]), x["url"])
    items = F.transform(F.sort_array(F.transform("rows", order)), link)
    return rows.select(*REQ_KEY, F.array_join(items, ", ").alias("coverers"))


def footnote_texts(cov: DataFrame, new: DataFrame) -> DataFrame:
    """Row 52: the footnote text of the sites whose footnote is written (URLs changed, or no
    footnote yet). Only these assemble a coverer list: it is the text itself."""
    need = cov.filter(F.col("changed") | ~F.col("has_footnote"))
    a = need.join(coverer_texts(new, need), REQ_KEY, "left")
    return a.withColumn("footnote_text", T.format_footnote("new_footnote_id", "package", "name", "coverers")).drop("coverers")


def footnote_actions(cov: DataFrame, new: DataFrame) -> DataFrame:
    """Row 50 (Q20, Q25): rewrite or append the footnote when its URLs changed
    or when the site has no footnote."""
    rewritten = F.col("annotated") & F.col("any_line").isNotNull()
    return footnote_texts(cov, new).select(
        "path",
        F.lit(P.ACTION_FOOTNOTE).alias("type"),
        "pos",
        F.when(rewritten, F.col("any_line")).otherwise(0).cast("int").alias("line_no"),
        "name",
        F.col("footnote_text").alias("data"),
        F.when(rewritten, F.col("any_digest")).alias("line_digest"),
    )


ACTIONS_SCHEMA = "path string, seq int, type string, line_no int, name string, data string, line_digest string"
COVERAGE_SCHEMA = (
    "package string, name string, root_ord int, repo_id string, path string, rel_path string, line_no int, status_word string, "
    "footnote_id string, annotated boolean, has_footnote boolean, match_line int, any_line int, line_digest string, any_digest string, "
    "n_coverers bigint, n_current bigint, changed boolean, max_id bigint, status string, new_footnote_id string, pos int"
)


def actions(cov: DataFrame, new: DataFrame) -> DataFrame:
    """Rows 48, 53: all actions, numbered per file in (site position, site-before-
    footnote) order."""
    a = site_actions(cov).unionByName(footnote_actions(cov, new))
    order = F.when(F.col("type") == P.ACTION_SITE, 0).otherwise(1)
    w = Window.partitionBy("path").orderBy("pos", order)
    return a.withColumn("seq", F.row_number().over(w).cast("int")).select("path", "seq", "type", "line_no", "name", "data", "line_digest")
