"""Rows 54-61: apply the actions to the Markdown text.

Per document, the actions are grouped once by path (edits pre-grouped per line,
in action order) and joined to the document row: two shuffles in all. The edits
are then applied inside the row: each edited line is folded over its actions
(Q32: the later action on a line wins), and the new lines are spliced into the
document with a sort-merge (``sort_array`` of original and edited lines, keep
the edited one per line number), which is O((L + E) log(L + E)) per document.
A document is one row: text and edits of one file fit a task, whatever the corpus. Long documents
are cut into chunks of lines, which are edited each for itself (``apply_actions_chunked``).
With mixed line ends the lines are those between CRLFs, so an action's number may be that of
another line. An edit is therefore compare-and-set: it carries the digest of the line that was
scanned, and is applied only if the line in hand has it; else the document is listed with an
error, beside the others, and is not written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

#: code points of a chunk of a long document
CHUNK_CHARS = 1 << 20


def eol_detect_split(docs: DataFrame) -> DataFrame:
    """Row 54 (Q30): CRLF if the text holds any CRLF, else LF; split on it."""
    crlf = F.col("content").contains("\r\n")
    parts = F.when(crlf, F.split("content", "\r\n", -1)).otherwise(F.split("content", "\n", -1))
    return docs.withColumn("eol", F.when(crlf, F.lit("\r\n")).otherwise(F.lit("\n"))).withColumn("parts", parts)


def trim_trailing_blank(docs: DataFrame) -> DataFrame:
    """Row 55: number of lines kept once trailing blank lines are dropped."""
    last = F.aggregate(
        F.transform("parts", lambda x, i: F.when(T.is_blank(x), F.lit(0)).otherwise(i + 1)),
        F.lit(0),
        lambda a, b: F.greatest(a, b),
    )
    return docs.withColumn("n_keep", last)


def _fold_line(text, acts, path, line_no):
    """Apply the sorted actions of one line to its text; the first failure
    is kept as ``err``. Digests are those of the line before any of them."""
    moved = F.filter(acts, lambda a: a["line_digest"] != F.md5(text))
    init = F.struct(
        text.alias("text"),
        F.when(F.size(moved) > 0, F.format_string(P.MSG_LINE_MOVED, line_no, path)).alias("err"),
        F.get(moved, F.lit(0))["seq"].alias("err_seq"),
    )

    def step(acc, a):
        is_site = a["type"] == P.ACTION_SITE
        matches = F.when(is_site, acc["text"].rlike(P.SITE)).otherwise(acc["text"].rlike(P.FOOTNOTE))
        rep = T.quote_replacement(a["data"])
        replaced = F.when(is_site, F.regexp_replace(acc["text"], F.lit(P.SITE), rep)).otherwise(
            F.regexp_replace(acc["text"], F.lit(P.FOOTNOTE), rep)
        )
        bad = F.format_string(P.MSG_LINE_OTHER, line_no, path)
        return F.when(acc["err"].isNotNull(), acc).otherwise(
            F.when(
                matches,
                F.struct(replaced.alias("text"), acc["err"].alias("err"), acc["err_seq"].alias("err_seq")),
            ).otherwise(F.struct(acc["text"].alias("text"), bad.alias("err"), a["seq"].alias("err_seq")))
        )

    return F.aggregate(acts, init, step)


def action_lists(actions: DataFrame) -> DataFrame:
    """Row 53: per path, the edits grouped by line (actions in seq order) and
    the appended footnotes in seq order. One shuffle by path: the per-line
    grouping runs on the same partitioning."""
    a = actions.repartition("path")
    per_line = a.groupBy("path", "line_no").agg(
        F.sort_array(F.collect_list(F.struct("seq", "type", "data", "line_digest"))).alias("acts"), F.min("seq").alias("first_seq")
    )
    return per_line.groupBy("path").agg(
        F.sort_array(
            F.collect_list(F.when(F.col("line_no") > 0, F.struct("line_no", "first_seq", "acts")))
        ).alias("edits"),
        F.flatten(F.collect_list(F.when(F.col("line_no") == 0, F.col("acts")))).alias("apps"),
    )


def _spliced(d: DataFrame) -> DataFrame:
    """Rows 56, 57, 60: ``_lines`` (kept lines, numbered from ``first`` + 1) and their ``edits`` to
    the edited ``_body`` and the first failure ``_err`` of an edit, as (seq, message)."""
    own = lambda e: e["line_no"] - F.col("first")
    in_range = lambda e: own(e) <= F.size("_lines")
    edits = F.col("edits")
    folded = F.transform(
        F.filter(edits, in_range),
        lambda e: F.struct(
            own(e).alias("at"),
            F.lit(0).alias("pr"),
            _fold_line(F.get(F.col("_lines"), own(e) - 1), e["acts"], F.col("path"), e["line_no"]).alias("r"),
        ),
    )
    d = d.withColumn("_folded", folded)
    orig = F.transform("_lines", lambda x, i: F.struct((i + 1).alias("at"), F.lit(1).alias("pr"), x.alias("t")))
    new = F.transform("_folded", lambda f: F.struct(f["at"].alias("at"), f["pr"].alias("pr"), f["r"]["text"].alias("t")))
    d = d.withColumn("_merged", F.when(edits.isNotNull(), F.sort_array(F.concat(new, orig))))
    kept = F.filter("_merged", lambda x, i: (i == 0) | (F.get(F.col("_merged"), i - 1)["at"] != x["at"]))
    d = d.withColumn("_body", F.when(edits.isNull(), F.col("_lines")).otherwise(F.transform(kept, lambda x: x["t"])))
    fold_errs = F.transform(
        F.filter("_folded", lambda f: f["r"]["err"].isNotNull()), lambda f: F.struct(f["r"]["err_seq"].alias("s"), f["r"]["err"].alias("e"))
    )
    miss_errs = F.transform(
        F.filter(edits, lambda e: ~in_range(e)),
        lambda e: F.struct(
            e["first_seq"].alias("s"), F.format_string(P.MSG_LINE_MISSING, e["line_no"], F.col("path")).alias("e")
        ),
    )
    return d.withColumn("_err", F.try_element_at(F.sort_array(F.concat(fold_errs, miss_errs)), F.lit(1))).drop("_folded", "_merged")


def _finished(d: DataFrame, extra: list[str]) -> DataFrame:
    """Rows 58-60: ``_body`` (texts that ``eol`` joins, whose last line is ``last``) with the
    appended footnotes ``apps`` and one end; the first failing action (in action order) wins."""
    # Row 58: appended footnotes with one separator line when needed.
    apps, last = F.col("apps"), F.col("last")
    app_data = F.coalesce(F.transform(apps, lambda a: a["data"]), F.array().cast("array<string>"))
    need_sep = (F.size("_body") > 0) & ~T.is_blank(last) & ~last.rlike(P.FOOTNOTE) & (F.size(app_data) > 0)
    out = F.when(need_sep, F.concat("_body", F.array(F.lit("")), app_data)).otherwise(F.concat("_body", app_data))
    # Row 59: end with one (original) EOL.
    end = F.coalesce(F.try_element_at(app_data, F.lit(-1)), last)
    fin = F.when(~T.is_blank(end), F.concat(out, F.array(F.lit("")))).otherwise(out)
    # only the reader knows whether bytes were lost in decoding; a text may hold U+FFFD itself
    lost = ~F.col("decodable") if "decodable" in d.columns else F.lit(False)
    lost_err = F.when(lost, F.struct(F.lit(0).alias("s"), F.format_string(P.MSG_UNDECODABLE, F.col("path")).alias("e")))
    wrong = F.try_element_at(F.filter(apps, lambda a: a["type"] != P.ACTION_FOOTNOTE), F.lit(1))
    app_err = F.when(wrong.isNotNull(), F.struct(wrong["seq"].alias("s"), F.format_string(P.MSG_NOT_APPENDED, F.col("path")).alias("e")))
    return d.withColumn("_fin", fin).select(
        "path",
        *extra,
        F.expr("array_join(_fin, eol)").alias("content"),
        F.lit(True).alias("changed"),
        F.array_min(F.array(lost_err, F.col("_err"), app_err))["e"].alias("apply_error"),
    )


def _carried(files: DataFrame) -> list[str]:
    return [c for c in files.columns if c not in ("path", "content", "decodable")]


def apply_actions(files: DataFrame, actions: DataFrame) -> DataFrame:
    """Rows 56-60: rewritten documents ``(path, content, changed, apply_error)``.

    ``files`` holds ``(path, content)`` plus any columns to carry along (for
    example ``repo_id`` and ``rel_path`` for a partitioned sink); only files
    with actions are returned."""
    docs = trim_trailing_blank(eol_detect_split(files.join(action_lists(actions), "path")))
    d = docs.withColumn("_lines", F.slice("parts", 1, F.col("n_keep"))).withColumn("first", F.lit(0))
    return _finished(_spliced(d).withColumn("last", F.try_element_at("_body", F.lit(-1))), _carried(files))


def text_chunks(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Row 54 of long documents: ``(path, eol, chunk, _lines)``. A chunk is ``chunk_chars`` code
    points and what is left of their last line; one pass of a regular expression cuts them all."""
    crlf = F.col("content").contains("\r\n")
    cut = lambda behind, end: F.regexp_extract_all("content", F.lit(f"(?s).{{1,{chunk_chars}}}+(?:{behind}|.*?(?:{end}|\\z))"), 0)
    pieces = F.when(crlf, cut(r"(?<=\r\n)|(?<=\r)\n", r"\r\n")).otherwise(cut(r"(?<=\n)", r"\n"))
    d = docs.select("path", F.when(crlf, F.lit("\r\n")).otherwise(F.lit("\n")).alias("eol"), F.posexplode_outer(pieces).alias("chunk", "text"))
    d = d.withColumn("chunk", F.coalesce("chunk", F.lit(0))).withColumn("text", F.coalesce("text", F.lit("")))
    parts = F.when(F.col("eol") == "\r\n", F.split("text", "\r\n", -1)).otherwise(F.split("text", "\n", -1))
    # behind the end of a chunk's last line begins the next chunk
    return d.select("path", "eol", "chunk", parts.alias("parts"), F.expr("endswith(text, eol)").cast("int").alias("_open")).select(
        "path", "eol", "chunk", F.expr("slice(parts, 1, size(parts) - _open)").alias("_lines")
    )


def chunk_spans(chunks: DataFrame) -> DataFrame:
    """Row 55 of long documents: per chunk the number of lines before it (``first``) and of its lines
    that are kept (``n_keep``; all, unless only blank lines follow). One row per chunk, no text."""
    sums = trim_trailing_blank(chunks.withColumnRenamed("_lines", "parts")).select("path", "chunk", F.size("parts").alias("n"), "n_keep")
    of = Window.partitionBy("path").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(of.orderBy("chunk")), F.lit(0)).cast("int")
    later = F.coalesce(F.max("n_keep").over(of.orderBy(F.col("chunk").desc())), F.lit(0))
    return sums.select("path", "chunk", first.alias("first"), F.when(later > 0, F.col("n")).otherwise(F.col("n_keep")).alias("n_keep"))


def chunk_edits(spans: DataFrame, actions: DataFrame) -> DataFrame:
    """Row 53 of long documents: the edits of each chunk, grouped by line. An edit beyond the last
    line belongs to the last chunk."""
    starts = spans.select("path", (F.col("first") + 1).alias("line_no"), "chunk")
    acts = actions.filter("line_no > 0").select("path", "line_no", F.struct("seq", "type", "data", "line_digest").alias("act"))
    both = starts.unionByName(acts, allowMissingColumns=True)
    w = Window.partitionBy("path").orderBy("line_no", F.col("act").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("chunk", F.last("chunk", ignorenulls=True).over(w)).filter(F.col("act").isNotNull())
    per_line = placed.groupBy("path", "chunk", "line_no").agg(F.sort_array(F.collect_list("act")).alias("acts"), F.min("act.seq").alias("first_seq"))
    return per_line.groupBy("path", "chunk").agg(F.sort_array(F.collect_list(F.struct("line_no", "first_seq", "acts"))).alias("edits"))


def apply_actions_chunked(files: DataFrame, actions: DataFrame, chunk_chars: int = CHUNK_CHARS, stage=lambda df, name: df) -> DataFrame:
    """``apply_actions`` of long documents: the text is cut into chunks that end behind a line,
    each chunk takes its own edits, and the last kept line and the end of the document follow
    from one row per chunk. No array holds the lines of more than a chunk; a whole text is put
    together only as the result row. ``stage(df, name)`` may write the chunks, which are read twice."""
    acted = actions.select("path").distinct()
    edited = files.join(acted, "path", "left_semi")
    chunks = stage(text_chunks(edited, chunk_chars), "doc_chunks")
    spans = chunk_spans(chunks)
    acts = actions.join(edited.select("path"), "path", "left_semi")
    d = chunks.join(spans, ["path", "chunk"]).join(chunk_edits(spans, acts), ["path", "chunk"], "left")
    s = _spliced(d.withColumn("_lines", F.slice("_lines", 1, F.col("n_keep"))))
    held = lambda **cols: F.when(F.size("_body") > 0, F.struct("chunk", *[c.alias(n) for n, c in cols.items()]))
    texts = F.sort_array(F.collect_list(held(text=F.expr("array_join(_body, eol)"))))
    whole = s.groupBy("path").agg(
        F.first("eol").alias("eol"),
        F.transform(texts, lambda t: t["text"]).alias("_body"),
        F.max(held(line=F.try_element_at("_body", F.lit(-1))))["line"].alias("last"),
        F.min("_err").alias("_err"),
    )
    apps = acts.filter("line_no = 0").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("seq", "type", "data", "line_digest"))).alias("apps"))
    docs = edited.drop("content").join(whole, "path").join(apps, "path", "left")
    return _finished(docs, _carried(files))
