"""Rows 11-17: files to numbered lines, ignore patterns, file kind, code-fence
and header state, package of a Markdown file.

Everything up to ``candidate_lines`` is narrow (map-side). ``markdown_state`` is
the only shuffle of this stage: it moves Markdown *candidate* lines (fences,
``---`` lines and lines holding a marker) by file, so prose and code never leave
the map side. A window partition holds the candidate lines of one file of at most
``LONG_BYTES``; longer files take ``segmented_state``, whose windows hold a chunk of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

FILE_KEY = ["root_ord", "path"]
FILE_COLS = ["root_ord", "repo_id", "path", "rel_path"]
#: files of more bytes have their state computed in chunks of this many lines
LONG_BYTES, CHUNK_LINES = 16 << 20, 1 << 16


def file_kind(files: DataFrame) -> DataFrame:
    """Row 13: ``md`` for a lower-cased ``.md`` extension, else ``src``. A table that has the
    column (say, as its partition column) keeps it: then filters on it prune the scan."""
    if "kind" in files.columns:
        return files
    ext = F.lower(F.regexp_extract(F.element_at(F.split(F.col("path"), "/"), -1), "(\\.[^.]*)\\z", 1))
    return files.withColumn("kind", F.when(ext == P.MARKDOWN_EXTENSION, "md").otherwise("src"))


def _segments(files: DataFrame, max_line_bytes: int | None) -> DataFrame:
    """One row per file with its LF segments and the position of the first raw line of
    ``max_line_bytes`` or more (0 when there is none or no limit)."""
    segs = F.split(F.col("content"), "\n", -1)
    too_long = F.transform("_segs", lambda s: F.octet_length(s) >= (max_line_bytes or 0))
    return files.select(
        *FILE_COLS,
        "kind",
        segs.alias("_segs"),
    ).withColumn(
        "_first_long",
        F.lit(0).cast("bigint") if max_line_bytes is None else F.array_position(too_long, True),
    )


def read_errors(lines: DataFrame) -> DataFrame:
    """Row 32: under a line limit, a file holding a raw line that long ends its scan with an
    error of empty code and line 0 (lines before it are still used). ``lines``
    is the output of ``line_explode(..., keep_long=True)``, or ``long_lines``."""
    return lines.filter("is_long").select(
        F.lit("scan").alias("phase"),
        F.lit(P.ERR_READLINE).alias("code"),
        "root_ord",
        "path",
        F.lit(0).alias("line_no"),
        F.lit(P.MSG_READLINE).alias("message"),
    )


def long_lines(files: DataFrame, max_line_bytes: int) -> DataFrame:
    """The overlong lines (``is_long``) that ``line_explode(..., keep_long=True)`` gives, one per
    file at most, without a row for each of the other lines. A shorter file is not split."""
    seg = _segments(files.filter(F.octet_length("content") >= max_line_bytes), max_line_bytes).withColumn("_n", F.size("_segs"))
    last = (F.col("_first_long") == F.col("_n")) & (F.element_at("_segs", -1) == "")
    return seg.filter((F.col("_first_long") > 0) & ~last).select(*FILE_COLS, "kind", F.lit(True).alias("is_long"))


def line_explode(files: DataFrame, ignore_lines=(), keep_long: bool = False, max_line_bytes: int | None = None) -> DataFrame:
    """Row 11 (+ row 12): numbered lines of each file.

    Split on LF, drop the empty segment after a final LF, cut one trailing CR,
    stop before the first line over ``max_line_bytes`` (no limit by default), then drop lines that match any ignore pattern
    (they keep their numbers). ``files`` needs ``kind`` (see ``file_kind``).
    With ``keep_long`` the overlong line itself is kept, flagged ``is_long``, so
    that one pass over the text also yields the read errors."""
    seg = _segments(files, max_line_bytes).withColumn("_n", F.size("_segs"))
    ex = seg.select(*FILE_COLS, "kind", "_n", "_first_long", F.posexplode("_segs").alias("_pos", "_seg"))
    ex = ex.filter(~((F.col("_pos") == F.col("_n") - 1) & (F.col("_seg") == "")))
    is_long = F.col("_pos") + 1 == F.col("_first_long")
    before_long = (F.col("_first_long") == 0) | (F.col("_pos") + 1 < F.col("_first_long"))
    ex = ex.filter(before_long | is_long) if keep_long else ex.filter(before_long)
    line = F.when(F.col("_seg").endswith("\r"), F.expr("substring(_seg, 1, char_length(_seg) - 1)")).otherwise(F.col("_seg"))
    cols = [*FILE_COLS, "kind", (F.col("_pos") + 1).cast("int").alias("line_no"), line.alias("line")]
    if keep_long:
        cols.append(is_long.alias("is_long"))
    out = ex.select(*cols)
    if keep_long:
        return out.filter(F.col("is_long") | ~_ignored(ignore_lines))
    return ignore(out, ignore_lines)


def _ignored(ignore_lines=()):
    hit = F.lit(False)
    for p in list(ignore_lines or ()):
        hit = hit | F.col("line").rlike(p)
    return hit


def ignore(lines: DataFrame, ignore_lines=()) -> DataFrame:
    """Row 12: drop lines that any pattern finds a match in (Java regex)."""
    if not list(ignore_lines or ()):
        return lines
    return lines.filter(~_ignored(ignore_lines))


def candidate_flags(lines: DataFrame, header_key: str = P.DEFAULT_HEADER_KEY) -> DataFrame:
    """Flags computed map-side; a line is a candidate if it can change state
    (fence, ``---``) or hold a record (tag, site, footnote, header key)."""
    line = F.col("line")
    is_md = F.col("kind") == "md"
    return lines.select(
        "*",
        (is_md & line.rlike(P.FENCE)).alias("is_fence"),
        (is_md & (line == "---")).alias("is_dash"),
    ).withColumn(
        "is_cand",
        F.when(
            is_md,
            F.col("is_fence")
            | F.col("is_dash")
            | line.contains("`~")
            | line.contains("[^")
            | line.contains("[~")
            | line.startswith(header_key + ":"),
        ).otherwise(line.contains("[~")),
    )


def markdown_state(md_cand: DataFrame, header_key: str = P.DEFAULT_HEADER_KEY) -> DataFrame:
    """Rows 14-17: code-fence and header state of each Markdown candidate line,
    plus per-file facts as whole-file window aggregates on the same partitioning
    (one shuffle): the package (last header line wins), the ignored flag, whether
    the file has a valid site (retention, Q5) and the unmatched-fence facts.

    ``in_code`` is the state *before* the line (an opening fence line is still
    outside code, a closing one inside); ``in_header`` holds for lines after a
    first line ``---`` up to (not including) the next ``---`` line. Overlong-line
    markers (``is_long``) ride along but never change state."""
    none = F.lit(0)
    s = _line_state(_live_marks(md_cand), FILE_KEY, (none, none, none), header_key)
    whole = Window.partitionBy(*FILE_KEY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    facts = _file_facts(F.last("hdr_pkg", ignorenulls=True), over=whole)
    return s.select("*", *facts).drop("row_id", "valid_site")


def segmented_state(md_cand: DataFrame, header_key: str = P.DEFAULT_HEADER_KEY, chunk_lines: int = CHUNK_LINES, stage=lambda df, name: df) -> DataFrame:
    """``markdown_state`` of files of any length, as a segmented scan: a chunk of lines is
    summed up (fences, ``---`` lines, whether it opens a header), an exclusive prefix over a
    file's summaries gives the state each chunk begins in, and windows over single chunks give
    the states of lines. The facts of a file are partial aggregates joined back. No window
    or group holds more than a chunk of lines or a file's summaries, one row per chunk.

    ``stage(df, name)`` may write the line states, which are read twice."""
    d = _live_marks(md_cand).withColumn("chunk", F.floor((F.col("line_no") - 1) / chunk_lines))
    n = lambda c: F.sum(c.cast("int"))
    sums = d.groupBy(*FILE_KEY, "chunk").agg(
        n(F.col("is_fence")).alias("fences"),
        n(F.col("is_dash") & (F.col("line_no") > 1)).alias("dashes"),
        n(F.col("is_dash") & (F.col("line_no") == 1)).alias("opens"),
    )
    earlier = Window.partitionBy(*FILE_KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_in") for c in ("fences", "dashes", "opens")]
    d = d.join(sums.select(*FILE_KEY, "chunk", *carried), [*FILE_KEY, "chunk"])
    s = _line_state(d, [*FILE_KEY, "chunk"], (F.col("fences_in"), F.col("dashes_in"), F.col("opens_in")), header_key)
    s = stage(s.drop("chunk", "fences_in", "dashes_in", "opens_in"), "md_segments")
    last_pkg = F.max(F.when(F.col("hdr_pkg").isNotNull(), F.struct("line_no", "hdr_pkg")))["hdr_pkg"]
    facts = s.groupBy(*FILE_KEY).agg(*_file_facts(last_pkg))
    return s.join(facts, FILE_KEY).drop("row_id", "valid_site")


def _live_marks(md_cand: DataFrame) -> DataFrame:
    live = ~F.col("is_long")
    return md_cand.withColumn("is_fence", F.col("is_fence") & live).withColumn("is_dash", F.col("is_dash") & live)


def _line_state(d: DataFrame, keys: list[str], carried: tuple, header_key: str) -> DataFrame:
    """State and record flags of the lines of a window by ``keys``; ``carried``: the numbers of
    fences, of later ``---`` lines and of a first line ``---`` that stand before the window."""
    fences_in, dashes_in, opens_in = carried
    w = Window.partitionBy(*keys).orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fences_before = fences_in + F.coalesce(F.sum(F.col("is_fence").cast("int")).over(before), F.lit(0))
    dashes_upto = dashes_in + F.coalesce(F.sum((F.col("is_dash") & (F.col("line_no") > 1)).cast("int")).over(upto), F.lit(0))
    header_open = opens_in + F.max((F.col("is_dash") & (F.col("line_no") == 1)).cast("int")).over(upto)
    s = d.select(
        "*",
        (fences_before % 2 == 1).alias("in_code"),
        ((header_open == 1) & (dashes_upto == 0) & (F.col("line_no") > 1)).alias("in_header"),
    )
    live = ~F.col("is_long")
    pat = P.header_pattern(header_key)
    is_hdr = F.col("in_header") & ~F.col("is_fence") & ~F.col("is_dash") & live & F.col("line").rlike(pat)
    s = s.withColumn("hdr_pkg", F.when(is_hdr, T.utrim(F.regexp_extract("line", pat, 1))))
    rec = ~F.col("in_code") & ~F.col("in_header") & ~F.col("is_fence") & ~F.col("is_dash") & live
    s = s.withColumn("is_record", rec)
    one_site = rec & F.col("line").contains("`~") & (F.size(F.regexp_extract_all("line", F.lit(P.SITE), 0)) == 1)
    word, fid = F.regexp_extract("line", P.SITE, 2), F.regexp_extract("line", P.SITE, 3)
    valid_site = one_site & word.isin(*P.STATUS_WORDS) & ~((fid != "") & (word == ""))
    s = s.withColumn("is_foot", rec & F.col("line").contains("[^") & F.col("line").rlike(P.FOOTNOTE))
    # Row 46: integer ids of the file's sites and footnotes, as strconv.Atoi reads them
    row_id = F.greatest(
        F.when(valid_site & (fid != ""), T.int_id(fid)),
        F.when(F.col("is_foot"), T.int_id(F.regexp_extract("line", P.FOOTNOTE, 1))),
    )
    return s.withColumn("valid_site", valid_site).withColumn("row_id", row_id)


def _file_facts(last_pkg, over=None) -> list:
    """The per-file facts, as aggregates or as window functions."""
    at = (lambda c: c) if over is None else (lambda c: c.over(over))
    return [
        F.greatest(F.coalesce(at(F.max("row_id")), F.lit(0)), F.lit(0)).alias("file_max_id"),
        F.coalesce(at(last_pkg), F.lit("")).alias("file_package"),
        F.coalesce(at(F.max(F.col("hdr_pkg").startswith(P.IGNORED_PACKAGE_PREFIX).cast("int"))), F.lit(0)).cast("boolean").alias("file_ignored"),
        F.coalesce(at(F.max(F.col("valid_site").cast("int"))), F.lit(0)).cast("boolean").alias("file_has_site"),
        at(F.sum(F.col("is_fence").cast("int"))).alias("file_n_fences"),
        at(F.max(F.when(F.col("is_fence") & ~F.col("in_code"), F.col("line_no")))).alias("file_last_open"),
    ]


def package_lines(state: DataFrame) -> DataFrame:
    """Header lines with the package key (row 16 input, row 25 input)."""
    return state.filter(F.col("hdr_pkg").isNotNull()).select(*FILE_COLS, "line_no", F.col("hdr_pkg").alias("package"), "file_ignored")


def package_of_file(state: DataFrame) -> DataFrame:
    """Row 16 + row 17: per Markdown file with a package line, the package (the
    last one wins) and whether it starts with ``ignoreme`` (Q12)."""
    h = state.filter(F.col("hdr_pkg").isNotNull())
    return h.groupBy(*FILE_KEY).agg(F.first("file_package").alias("package"), F.first("file_ignored").alias("ignored"))


def unmatched_fences(state: DataFrame) -> DataFrame:
    """Row 30 input: the last opening fence of a file whose fences do not pair."""
    return state.filter(
        F.col("is_fence") & (F.col("line_no") == F.col("file_last_open")) & (F.col("file_n_fences") % 2 == 1)
    ).select(*FILE_COLS, F.col("line_no").alias("last_open"), "file_ignored")
