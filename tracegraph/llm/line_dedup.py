"""Substring deduplication by line and paragraph hashing.

Units are the lines of a text and its paragraphs (lines between blank lines). A unit is
normalised (lower case, white space, line ends included, runs to one blank, trimmed) and hashed
with SHA-256. Of all units of the corpus with one digest the earliest ranked stays (smallest id,
then text digest, then line); every other one is a repeat.

All non-blank lines take part in the grouping, of any length. What is removed is a passage:
consecutive repeated lines (blank lines between them do not end it) that hold ``min_words``
words together, or a repeated paragraph of as many, which also finds a passage that is wrapped
at other places. Shorter repeats (a greeting, a heading, a common sentence) stay where they
stand between lines of the document's own; ``min_words=1`` removes these too. Removed lines are
reported with their offsets in the original text.

Scale: one narrow row per line (digest, document, number) is staged and aggregated with a
map-side combine; only digests that occur again are joined back, by an ordinary join that the
engine may split for skew. Texts are shuffled once, to be cut; offsets are computed only there.

Defined cases: a null text is an empty one; blank lines are never removed; a null id ranks last;
rows equal in id and text are one document: its units never remove each other across such rows,
and every such row is cut alike; a removed line goes with its line feed; a text all of whose
lines go becomes empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, staged

#: words of a passage; texts a task holds at a time
MIN_WORDS, TEXTS = 40, 200
_WHITE = re.compile("[\x20\x09-\x0d]+")


def normalised(line: str) -> str:
    return _WHITE.sub(" ", line.lower()).strip(" ")


def paragraphs(lines: list[str]) -> list[tuple[int, int]]:
    """(first, behind last) of the runs of non-blank normalised lines."""
    out, start = [], None
    for i, line in enumerate([*lines, ""]):
        if line and start is None:
            start = i
        elif not line and start is not None:
            out.append((start, i))
            start = None
    return out


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def units_of(text: str, min_words: int) -> list[tuple[bool, int, bytes]]:
    """(is a paragraph, number of the first line, digest)."""
    lines = [normalised(x) for x in text.split("\n")]
    out = [(False, i, _digest(x)) for i, x in enumerate(lines) if x]
    for a, b in paragraphs(lines):
        whole = " ".join(lines[a:b])
        if whole.count(" ") + 1 >= min_words:
            out.append((True, a, _digest(whole)))
    return out


def passages(text: str, repeated: list[tuple[bool, int]], min_words: int) -> list[int]:
    """Numbers of the lines to remove, given the text's repeated units."""
    lines = [normalised(x) for x in text.split("\n")]
    again = {no for whole, no in repeated if not whole}
    heads = {no for whole, no in repeated if whole}
    gone = {i for a, b in paragraphs(lines) if a in heads for i in range(a, b)}
    run: list[int] = []
    words = 0
    for i, line in enumerate([*lines, "end"]):
        if i in again:
            run.append(i)
            words += line.count(" ") + 1
        elif line:
            if run and words >= min_words:
                gone.update(run)
            run, words = [], 0
    return sorted(gone)


def cut(text: str, gone: list[int]) -> tuple[str, list[tuple[int, int, int]]]:
    """What stays of the text, and (line, start, end) of what goes, in code points."""
    out, kept, at, lost = [], [], 0, set(gone)
    for i, line in enumerate(text.split("\n")):
        if i in lost:
            out.append((i, at, at + len(line)))
        else:
            kept.append(line)
        at += len(line) + 1
    return "\n".join(kept), out


def _key(id_col: str, text_col: str):
    """A document: its id and 128 bits of its text's SHA-256 (ids may be null or repeated)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("doc_id"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("_text_key")]


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, _text_key, whole, no, first_doc)``: the units (``whole``: a paragraph) of
    which an earlier one exists, and the id of the earliest one's document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                some = batch.slice(at, TEXTS)
                found = [units_of(t or "", min_words) for t in some.column(2).to_pylist()]
                owner = pa.array([i for i, units in enumerate(found) for _ in units], type=pa.int32())
                columns = list(zip(*[u for units in found for u in units], strict=True)) or [[], [], []]
                kinds = (pa.bool_(), pa.int32(), pa.binary())
                own = [some.column(c).take(owner) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "_text_key", "whole", "no", "_digest"])
        give_back()

    kind = dict(docs.select(F.col(id_col).alias("i")).dtypes)["i"]
    d = docs.select(*_key(id_col, text_col), F.col(text_col).alias("_text"))
    units = staged(d.mapInArrow(run, f"doc_id {kind}, _text_key binary, whole boolean, no int, _digest binary"), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_text_key").alias("k"), F.col("no").alias("i"))
    units = units.withColumn("_rank", rank)
    again = units.groupBy("whole", "_digest").agg(F.min("_rank").alias("_first"), F.max("_rank").alias("_last")).where("_first <> _last")
    # staged: the join then has two plain sides, and the engine can split a very common line
    again = staged(again.drop("_last"), "units-again")
    later = units.join(again, ["whole", "_digest"]).where("_rank <> _first")
    return later.select("doc_id", "_text_key", "whole", "no", F.col("_first.d").alias("first_doc"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, removed, clean_text)``, one row per input row; ``removed`` is an array of
    ``(no, start, end, first_doc)`` in text order (``first_doc``: where the line, or else its
    paragraph, was met first)."""
    with small_batches(docs.sparkSession):
        units = repeated_units(docs, id_col, text_col, min_words).distinct()
        kind = dict(units.dtypes)["doc_id"]
        found = F.sort_array(F.collect_list(F.struct("whole", "no", "first_doc"))).alias("_again")
        lists = units.groupBy("doc_id", "_text_key").agg(found).withColumnsRenamed({"doc_id": "_id", "_text_key": "_k"})
        d = docs.select(*_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("clean_text"))
        d = d.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_k")), "left")
        d = d.select("doc_id", F.col("_again.whole").alias("w"), F.col("_again.no").alias("n"), F.col("_again.first_doc").alias("f"), "clean_text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                struct = pa.struct([("no", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("first_doc", batch.schema.field(0).type)])
                for at in range(0, len(batch), TEXTS):
                    some = batch.slice(at, TEXTS)
                    removed, clean = [], []
                    for whole, no, first, text in zip(*[some.column(c).to_pylist() for c in range(1, 5)], strict=True):
                        if whole is None:
                            removed.append([])
                            clean.append(text)
                            continue
                        units = list(zip(whole, no, strict=True))
                        kept, gone = cut(text, passages(text, units, min_words))
                        where = dict(zip(units, first, strict=True))
                        lines, head, source = [normalised(x) for x in text.split("\n")], {}, {}
                        for a, b in paragraphs(lines):
                            head.update(dict.fromkeys(range(a, b), a))
                        for i, _, _ in gone:
                            source[i] = where[False, i] if (False, i) in where else where[True, head[i]]
                        removed.append([{"no": i, "start": s, "end": e, "first_doc": source[i]} for i, s, e in gone])
                        clean.append(kept)
                    columns = [some.column(0), pa.array(removed, type=pa.list_(struct)), pa.array(clean, type=pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "removed", "clean_text"])
            give_back()

        return d.mapInArrow(run, f"doc_id {kind}, removed array<struct<no:int,start:bigint,end:bigint,first_doc:{kind}>>, clean_text string")


ORACLE = rf"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u0 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM l),
u AS (
  SELECT doc_id, no, line,
         CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM u0),
-- lines: consecutive repeats among the lines that are not blank
v AS (
  SELECT *, len(string_split(norm, ' ')) AS words, row_number() OVER (PARTITION BY norm ORDER BY doc_id, no) > 1 AS again,
         no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS para FROM u WHERE norm <> ''),
w AS (SELECT *, sum(CAST(NOT again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY no) AS run FROM v),
x AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, run, again) AS run_words FROM w),
-- paragraphs: lines without a blank one between them
p AS (SELECT doc_id, para, min(no) AS head, string_agg(norm, ' ' ORDER BY no) AS whole FROM v GROUP BY doc_id, para),
q AS (
  SELECT doc_id, para, row_number() OVER (PARTITION BY whole ORDER BY doc_id, head) > 1 AS again FROM p
  WHERE len(string_split(whole, ' ')) >= {MIN_WORDS}),
gone AS (
  SELECT x.doc_id, x.no, x.start, x.line FROM x LEFT JOIN q USING (doc_id, para)
  WHERE (x.again AND run_words >= {MIN_WORDS}) OR coalesce(q.again, false)),
spans AS (
  SELECT doc_id, count(*) AS n_removed,
         string_agg(start || ':' || (start + length(line)), ',' ORDER BY start) AS removed FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS clean FROM u
  WHERE (doc_id, no) NOT IN (SELECT (doc_id, no) FROM gone) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed,
       length(coalesce(clean, '')) AS clean_chars, sha256(coalesce(clean, '')) AS clean_sha256
FROM documents d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
