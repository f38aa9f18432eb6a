"""Rows 25-37: syntax and semantic rules (each gives ``errors`` rows), the
error report and the phase gate.

``errors`` schema: ``(phase, code, root_ord, path, line_no, message)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

ERROR_COLS = ["phase", "code", "root_ord", "path", "line_no", "message"]


def _err(df: DataFrame, phase: str, code: str, message, line="line_no") -> DataFrame:
    return df.select(
        F.lit(phase).alias("phase"),
        F.lit(code).alias("code"),
        F.col("root_ord"),
        F.col("path"),
        (F.col(line) if isinstance(line, str) else line).cast("int").alias("line_no"),
        message.alias("message"),
    )


def err_pkgident(pkg_lines: DataFrame) -> DataFrame:
    """Row 25: a header package that is not an identifier (still stored)."""
    bad = pkg_lines.filter(~F.col("file_ignored") & ~T.is_ident("package"))
    return _err(bad, "scan", P.ERR_PKGIDENT, F.concat(F.lit(P.MSG_PKGIDENT), F.col("package")))


def site_errors(cands: DataFrame, identifiers: list[str] | None) -> DataFrame:
    """Rows 26, 27, 29, 31 in one pass over the lines with sites: a requirement name that is
    no identifier (the site is kept), an unknown status word or a footnote reference without
    a word, more than one site on a line (the message quotes the first two), and, when a type
    list is given, a requirement type that it lacks (after the status word, Q16)."""
    one, word = F.col("n_sites") == 1, F.col("status_word")
    known = word.isin(*P.STATUS_WORDS)
    no_word = (F.col("footnote_id") != "") & (word == "")
    several = F.concat(F.lit(P.MSG_MULTISITES), F.col("first_match"), F.lit(P.MSG_MULTISITES_SEP), F.col("second_match"))
    rules = [
        (P.ERR_REQIDENT, one & ~T.is_ident("name"), F.lit(P.MSG_REQIDENT)),
        (P.ERR_COVSTATUS, one & (~known | no_word), F.concat(F.lit(P.MSG_COVSTATUS), word)),
        (P.ERR_MULTISITES, F.col("n_sites") > 1, several),
    ]
    if identifiers is not None:
        listed = T.requirement_type("name").isin(*identifiers) if identifiers else F.lit(False)
        msg = F.format_string(P.MSG_REQTYPE, F.lit(" ".join(identifiers)), F.col("name"))
        rules.append((P.ERR_REQTYPE, one & known & ~listed, msg))
    broken = F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), msg.alias("message"))) for code, cond, msg in rules])
    found = cands.select("root_ord", "path", "line_no", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("e"))
    return found.select(F.lit("scan").alias("phase"), "e.code", "root_ord", "path", F.col("line_no").cast("int").alias("line_no"), "e.message")


def err_urlsyntax(raw_coverers: DataFrame) -> DataFrame:
    """Row 28: a coverer URL that Go's URL parser would reject."""
    bad = raw_coverers.filter(F.col("url_fault").isNotNull())
    msg = F.concat(
        F.lit(P.MSG_URLSYNTAX + 'parse "'), F.col("url"), F.lit('": '), F.col("url_fault"), F.lit(": "), F.col("url")
    )
    return _err(bad, "scan", P.ERR_URLSYNTAX, msg)


def err_unmatchedfence(unmatched: DataFrame) -> DataFrame:
    """Row 30: a fence still open at the end of the file; line of the last opener."""
    msg = F.format_string(P.MSG_UNMATCHEDFENCE, F.col("last_open"))
    return _err(unmatched.filter(~F.col("file_ignored")), "scan", P.ERR_UNMATCHEDFENCE, msg, line="last_open")


def err_repository(inventory: DataFrame, repo_urls: DataFrame) -> DataFrame:
    """Row 7 gate: every repository that has files but no URL (unsupported host, no main or
    master branch, not listed at all) fails the scan, as its coverers would have no link."""
    used = inventory.groupBy("repo_id").agg(F.min("root_ord").alias("root_ord"), F.min("root_path").alias("path"))
    bad = used.join(repo_urls, "repo_id", "left").filter(F.col("root_url").isNull()).withColumn("line_no", F.lit(0))
    unknown = F.concat(F.lit(P.MSG_UNKNOWNREPO), F.coalesce("repo_id", F.lit("")))
    return _err(bad, "scan", P.ERR_REPOSITORY, F.coalesce("url_error", unknown))


def union_errors(parts) -> DataFrame:
    parts = [p.select(*ERROR_COLS) for p in parts if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def error_report(errors: DataFrame) -> DataFrame:
    """Row 36: ``path:line: code: message`` text rows."""
    return errors.select(
        "phase",
        "path",
        "line_no",
        "code",
        F.format_string("%s:%d: %s: %s", "path", "line_no", "code", "message").alias("text"),
    )


def has_rows(df: DataFrame) -> bool:
    """Row 37 helper: one eager job that counts. A clean corpus has to be checked whole anyway,
    and ``isEmpty`` would do that in several jobs over ever more partitions."""
    return df.agg(F.count(F.lit(1))).first()[0] > 0
