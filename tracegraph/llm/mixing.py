"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources' weights share the words of the whole input; a target stops at
``most`` times its source's words, and the excess goes to the others by weight until
none is above. With ratio r = target / words of the source, every document of it is
taken ``floor(r)`` times for certain; the remaining words, a share p of the source,
are drawn by Pareto order sampling (Rosen, 1997): documents are ranked by their
random odds u / (1 - u) over their inclusion odds p / (1 - p) (times an optional
multiplier per document), and the first of this order are taken once more, as many
as come nearest to the remaining words (the last only if at least half of it fits).
So a source misses its target by half a document at most.

u is a hash of seed and id: reruns and other partitionings give the same sample.

Scale: one narrow row per document. The cut in the order is found by a radix descent:
words per (source, 1/256 of the order), then per 1/256 of the part that holds the cut,
and so on; only the last part (1/2**24 of a source) is sorted. No window ever holds a
source, so a source with a third of all documents is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, private, staged

STEP, LEVELS = 256, 3


def word_count(text):
    """Words of a text: maximal runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS}]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, cycle=(1, 2, 3), most: int = 3) -> DataFrame:
    """``sizes(source, source_size)``, one row per source, to ``(source, source_size,
    target)``. The small table of sources is ordered twice: by code point for the
    weights, and by ``most * size / weight``, the water level at which each reaches
    its limit; the ones that reach it form a prefix of that order."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in cycle]), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))
    s = sizes.withColumn("_w", w.cast("bigint")).withColumn("_cap", F.col("source_size") * most)
    up = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).alias("_words"),
        (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))).alias("_weights"),
    )
    full = F.col("_cap") * F.col("_weights") <= F.col("_words") * F.col("_w")
    s = s.withColumn("_full", full).withColumn("_rank", F.row_number().over(up))
    first = F.min(F.when(~F.col("_full"), F.struct("_rank", "_words", "_weights"))).over(everything)
    s = s.withColumn("_level", first)
    share = F.col("_level._words").cast("double") * F.col("_w") / F.col("_level._weights")
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share)
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    odds_col: str | None = None,
    cycle=(1, 2, 3),
    most: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, one row per input row.

    ``odds_col``: a positive multiplier of a document's inclusion odds (default 1).
    Defined cases: null texts and texts without words have size 0 and take 0 words
    (``copies`` still counts the certain ones); a null source is a source, last in
    order; a null id is hashed as the empty string; repeated rows are separate rows of
    the mix; a source without words has target 0."""
    odds = F.lit(1.0) if odds_col is None else F.coalesce(F.col(odds_col).cast("double"), F.lit(1.0))
    bits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13)
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            odds.alias("_odds"),
            ((F.conv(bits, 16, 10).cast("bigint") + 0.5) / float(2**52)).alias("_u"),
        ),
        "mix",
    )
    plan = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, most), "mix-plan")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = plan.withColumn("_certain", copies)
    plan = plan.withColumn("_rest", F.col("target") - F.col("_certain") * F.col("source_size"))
    plan = plan.withColumn("_p", F.when(F.col("source_size") > 0, F.col("_rest") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumnRenamed("source", "_s")
    ranked = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    # the Pareto key q = (u / (1 - u)) / (odds * p / (1 - p)), as q / (1 + q) in [0, 1]; p = 0 puts nobody in
    a, b = F.col("_u") * (1 - F.col("_p")), (1 - F.col("_u")) * F.col("_odds") * F.col("_p")
    ranked = staged(ranked.withColumn("_key", a / (a + b)).drop("_s", "_odds", "_u"), "mix-ranked")

    cut = plan.select("_s", F.lit(0).cast("bigint").alias("_part"), F.col("_rest").alias("_left"))
    for level in range(1, LEVELS + 1):
        at = lambda n: F.least(F.floor(F.col("_key") * float(STEP**n)), F.lit(STEP**n - 1)).cast("bigint")
        inside = ranked.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (at(level - 1) == F.col("_part")))
        words = inside.groupBy("_s", "_left", at(level).alias("_part")).agg(F.sum("size").alias("_sum"))
        so_far = F.sum("_sum").over(Window.partitionBy("_s").orderBy("_part"))
        words = words.withColumn("_to", so_far).where(F.col("_to") >= F.col("_left"))
        first = words.groupBy("_s").agg(F.min_by(F.struct("_part", (F.col("_left") - F.col("_to") + F.col("_sum")).alias("_left")), "_part").alias("_f"))
        cut = staged(first.select("_s", "_f._part", "_f._left"), f"mix-cut{level}")
    # a source without a cut: nothing is left to draw (p = 0), or rounding put the cut past its end
    j = ranked.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_at", at(LEVELS))
    edge = j.where(F.col("_at") == F.col("_part"))
    order = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("_in", F.sum("size").over(order) - F.col("size") / 2 <= F.col("_left"))
    inner = F.coalesce(F.col("_at") < F.col("_part"), F.col("_rest") > 0)
    sure = j.where(F.col("_part").isNull() | (F.col("_at") != F.col("_part"))).withColumn("_in", inner)
    total = F.col("_certain") + F.when(F.col("_in") & (F.col("_rest") > 0), 1).otherwise(0)
    cols = ["doc_id", "source", "size", "source_size", "target", total.cast("bigint").alias("copies")]
    done = edge.select(*cols).unionByName(sure.select(*cols))
    return done.withColumn("taken", F.col("size") * F.col("copies"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with all their columns.
    Rows equal in id, source and size are taken equally often."""
    mixed = mix_sources(docs, id_col, text_col, source_col, **parameters).where("copies > 0")
    mixed = private(mixed.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")))
    own = [F.col(id_col), F.col(source_col), word_count(F.col(text_col))]
    taken = docs.join(mixed, [a.eqNullSafe(F.col(b)) for a, b in zip(own, mixed.columns)])
    copy = private(mixed.limit(0)).columns[-1]
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(mixed.columns[-1])))
    return taken.withColumn(copy, again).select(docs.columns)


ORACLE = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT) AS w
  FROM r GROUP BY source),
lv AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER up, 0) AS BIGINT) AS words,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER up, 0) AS BIGINT) AS weights
  FROM s WINDOW up AS (ORDER BY 3 * source_size / w::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 3 * source_size * weights <= words * w AS is_full FROM lv),
fr AS (SELECT words AS lw, weights AS lg FROM f WHERE NOT is_full ORDER BY 3 * source_size / w::DOUBLE, source IS NULL, source LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE lw::DOUBLE * w / lg END AS target
  FROM f LEFT JOIN fr ON true),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS certain FROM t),
q AS (
  SELECT *, target - certain * source_size AS rest,
         CASE WHEN source_size > 0 THEN (target - certain * source_size) / source_size ELSE 0 END AS pr FROM p),
k AS (
  SELECT r.doc_id, r.source, r.size, q.source_size, q.target, q.certain, q.rest,
         r.u * (1 - pr) / (r.u * (1 - pr) + (1 - r.u) * pr) AS pkey
  FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY pkey, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2::DOUBLE <= rest AND rest > 0 AS chosen FROM k)
SELECT doc_id, size, source_size, target,
       CAST(size * (certain + CASE WHEN chosen THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
