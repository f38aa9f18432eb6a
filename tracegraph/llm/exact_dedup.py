"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

Texts are equal when identical after deleting ASCII white space. Of equal texts the
row with the most code points in the original text stays, then the smallest id.

A frequent-items sketch of Misra-Gries type (``approx_top_k``) over all digests names
at most ``heavy`` candidates. Their exact counts and winners are computed and
*verified* by one map-side-combined aggregation; at most ``heavy`` winner rows are
broadcast and decide their groups without a shuffle. All other digests take the
ordinary way: aggregate by digest, join back. The sketch only chooses the way a
digest goes, never the result.

Defined cases: a null text is an empty one; empty and all-white texts are equal; a
null id is a row like any other (smallest of ties, never the winner over an id of the
same length); rows without an id are told apart by their original texts, so a winner
without an id stays alone; repeated rows with one id and text are one document and share
its verdict, each counted in ``group_size``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, without

#: deleted before texts are compared
WHITE = " \t\n\x0b\x0c\r"


def _raw(id_col: str, text_col: str):
    """Tells rows without an id apart; null where there is an id."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 256, tracked: int = 8192) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row."""
    return _verdicts(docs, id_col, text_col, heavy, tracked).drop("_raw")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, heavy: int = 256, tracked: int = 8192) -> DataFrame:
    """The columns of ``exact_dedup`` and ``_raw``.

    ``heavy``: most digests decided by broadcast (rows of about 60 bytes, so the
    broadcast is bounded by about ``60 * heavy`` bytes); ``tracked``: counters of the
    sketch, which finds every digest holding over about 1/``tracked`` of the rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.char_length(text).alias("_n"),
            F.sha2(F.translate(text, WHITE, ""), 256).alias("text_sha256"),
            _raw(id_col, text_col).alias("_raw"),
        ),
        "exact",
    )
    top = rows.select(F.expr(f"approx_top_k(text_sha256, {heavy}, {tracked})").alias("_t"))
    candidates = top.select(F.explode("_t").alias("_t")).select(F.col("_t.item").alias("text_sha256"))
    winner = [
        F.max(F.struct(F.col("_n"), (-F.col("doc_id")).alias("_neg"), F.col("_raw"))).alias("_w"),
        F.count(F.lit(1)).alias("group_size"),
    ]
    verdict = ["text_sha256", (-F.col("_w._neg")).alias("keep_id"), "group_size", F.col("_w._raw").alias("_keep_raw")]
    hot = rows.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(*winner)
    hot = staged(hot.select(*verdict).where("group_size > 1"), "exact-hot")
    by_map = rows.join(F.broadcast(hot), "text_sha256")
    rest = rows.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti")
    by_shuffle = rest.join(rest.groupBy("text_sha256").agg(*winner).select(*verdict), "text_sha256")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("_raw") == F.col("_keep_raw"), F.lit(False))
    cols = ["doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "_raw"]
    return by_map.select(*cols).unionByName(by_shuffle.select(*cols))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    dropped = _verdicts(docs, id_col, text_col).where("not kept").select("doc_id", "text_sha256", "_raw")
    digest = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), WHITE, ""), 256)
    return without(docs, [F.col(id_col), digest, _raw(id_col, text_col)], dropped)


ORACLE = r"""
WITH r AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id
  FROM r GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM r JOIN w USING (text_sha256)
"""
