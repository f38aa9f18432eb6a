"""Rows 18-24: record extraction from lines, requirement types, retention.

All extraction is regex work on single rows (``regexp_extract_all`` + ``arrays_zip``
+ ``posexplode``); no Python is involved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .lines import FILE_COLS, FILE_KEY


def extract_tags(lines: DataFrame, extra=()) -> DataFrame:
    """Row 18: every coverage tag of a line (Q13: a tag needs one preceding
    character that is not a backtick; Q14: a name holding ``/`` gives the
    empty id, which joins to nothing but still counts for retention).
    ``extra`` columns of the line are carried along."""
    extra = list(extra)
    cand = lines.filter(F.col("line").contains("[~"))
    # one regex pass; a match is "x[~package/name~type]" with the first "/" and the next "~".
    # Its parts are cut after the explode, where plain columns are compiled
    found = F.regexp_extract_all("line", F.lit(P.TAG), F.lit(0))
    ex = cand.select(*FILE_COLS, "kind", "line_no", *extra, F.posexplode(found).alias("tag_ord", "m"))
    body = F.substring("m", F.lit(4), F.char_length("m") - 4)
    ex = ex.withColumn("b", body).withColumn("p", F.substring_index("b", "/", 1))
    ex = ex.withColumn("rest", F.substring("b", F.char_length("p") + 2, F.char_length("b"))).withColumn("n", F.substring_index("rest", "~", 1))
    cov_type = F.substring("rest", F.char_length("n") + 2, F.char_length("rest"))
    bad = F.col("n").contains("/")
    return ex.select(
        *FILE_COLS,
        "kind",
        "line_no",
        *extra,
        (F.col("tag_ord") + 1).cast("int").alias("tag_ord"),
        F.when(bad, F.lit("")).otherwise(F.col("p")).alias("package"),
        F.when(bad, F.lit("")).otherwise(F.col("n")).alias("name"),
        cov_type.alias("cov_type"),
    )


def record_lines(state: DataFrame) -> DataFrame:
    """Markdown lines that may hold sites and footnotes: outside code and
    header, neither a fence nor a ``---`` line, in a file that is not ignored."""
    return state.filter(F.col("is_record") & ~F.col("file_ignored"))


def site_candidates(records: DataFrame) -> DataFrame:
    """Lines with site matches: the match count, the first two matches and the
    groups of the (only) match when there is exactly one."""
    c = records.filter(F.col("line").contains("`~"))
    c = c.select(*FILE_COLS, "line_no", "line", "file_package", "file_max_id", F.md5("line").alias("line_digest"), F.regexp_extract_all("line", F.lit(P.SITE), 0).alias("_all"))
    c = c.filter(F.size("_all") > 0)
    return c.select(
        *FILE_COLS,
        "line_no",
        F.col("file_package").alias("package"),
        "file_max_id",
        "line_digest",
        F.size("_all").alias("n_sites"),
        F.get("_all", 0).alias("first_match"),
        F.get("_all", 1).alias("second_match"),
        F.regexp_extract("line", P.SITE, 1).alias("name"),
        F.regexp_extract("line", P.SITE, 2).alias("status_word"),
        F.regexp_extract("line", P.SITE, 3).alias("footnote_id"),
        F.regexp_extract("line", P.SITE, 4).alias("emoji"),
    )


def extract_sites(cands: DataFrame) -> DataFrame:
    """Row 19: the one valid site of a line (Q15-Q17). Kept: exactly one match,
    a known status word, and a status word whenever a footnote is referenced."""
    one = cands.filter(F.col("n_sites") == 1)
    ok = F.col("status_word").isin(*P.STATUS_WORDS) & ~((F.col("footnote_id") != "") & (F.col("status_word") == ""))
    return one.filter(ok).select(
        *FILE_COLS,
        "line_no",
        "package",
        "name",
        "footnote_id",
        "status_word",
        "emoji",
        (F.col("footnote_id") != "").alias("annotated"),
        "file_max_id",
        "line_digest",
    )


def footnote_lines(records: DataFrame) -> DataFrame:
    """Lines that are coverage footnotes, with the rest text (group 5)."""
    f = records.filter("is_foot")
    return f.select(
        *FILE_COLS,
        "line_no",
        "file_package",
        F.md5("line").alias("line_digest"),
        F.regexp_extract("line", P.FOOTNOTE, 1).alias("footnote_id"),
        F.regexp_extract("line", P.FOOTNOTE, 2).alias("package"),
        F.regexp_extract("line", P.FOOTNOTE, 5).alias("rest"),
    )


def extract_footnotes(fn_lines: DataFrame) -> DataFrame:
    """Row 20: footnote id and hint package (Q18: any footnote line counts; no
    hint gives the empty package)."""
    return fn_lines.select(*FILE_COLS, "line_no", "footnote_id", "package", "file_package", "line_digest")


def raw_coverers(fn_lines: DataFrame) -> DataFrame:
    """All ``[label](url)`` pairs of footnote rest texts, before URL checks."""
    z = F.arrays_zip(
        F.regexp_extract_all("rest", F.lit(P.COVERER), 1).alias("label"),
        F.regexp_extract_all("rest", F.lit(P.COVERER), 2).alias("url"),
    )
    ex = fn_lines.filter(F.col("rest") != "").select(*FILE_COLS, "line_no", F.posexplode(z).alias("cov_ord", "c"))
    ex = ex.select(
        *FILE_COLS,
        "line_no",
        (F.col("cov_ord") + 1).cast("int").alias("cov_ord"),
        F.col("c.label").alias("label"),
        F.col("c.url").alias("url"),
    )
    return ex.withColumn("url_fault", T.url_fault("url"))


def extract_coverers(raw: DataFrame) -> DataFrame:
    """Row 21: coverers with invalid URLs removed."""
    return raw.filter(F.col("url_fault").isNull()).drop("url_fault")


def retained_markdown(sites: DataFrame) -> DataFrame:
    """Row 24 (Markdown half): Markdown files with at least one site."""
    return sites.select(*FILE_KEY).distinct()


def retained_tags(tags: DataFrame) -> DataFrame:
    """Row 24 applied to tags (Q5): a source tag always keeps its file; a
    Markdown tag counts only when its file has a site (and is not ignored).
    ``tags`` carries the per-file flags of the Markdown state."""
    keep = (F.col("kind") == "src") | (F.col("file_has_site") & ~F.col("file_ignored"))
    return tags.filter(keep).drop("file_has_site", "file_ignored")


def retained_files(files: DataFrame, tags: DataFrame, sites: DataFrame) -> DataFrame:
    """Row 24: files kept for analysis (Markdown with sites, sources with tags)."""
    keep = retained_markdown(sites).unionByName(tags.filter(F.col("kind") == "src").select(*FILE_KEY)).distinct()
    return files.join(keep, FILE_KEY, "left_semi")
