"""Quality rules by distribution divergence (DataFrame functions only).

Base rules count words, repeated lines and words in repeated 5-word windows. The verdict
beyond them compares two histograms of a document with those of its language:

* character classes (``CLASSES``): share of each class in the code points;
* common words: share of each of the language's ``common`` words (those that most
  documents hold, lower-cased) and of all other words.

The language's reference is the average histogram of its documents that pass the base rules
and are long enough, summed in whole millionths, so that it does not depend on the order of
rows. Distance is Jensen-Shannon's (square root of the divergence in bits: 0 same, 1 disjoint).
A document is rejected when a distance exceeds its limit (``class_limit``, ``word_limit``);
histograms of short texts say little, so texts below ``min_chars`` code points or
``min_words`` words are not judged by that histogram.

Scale: two passes over the text. The first counts in how many documents each word occurs
(partial aggregation; the top words per language are cut before the shuffle by the
engine's group limit), the second turns each text into a narrow row; windows and lines are
compared inside the row, where 64-bit hashes only pick the few windows whose words are then
compared. A row's memory is a few times its text. Tables per language are joined; the engine
broadcasts them by their size in bytes and shuffles narrow rows otherwise.

Defined cases: a null text is an empty one and has no words, so it fails the base rules; a
null language is the language ``und``; a language without reference documents rejects
nothing beyond the base rules; null ids and repeated rows are rows of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, staged

#: characters counted as symbols
SYMBOLS = "#*$%&|<>"
#: character classes, in the order they are taken out of a text; what is left is one more
CLASSES = {
    "lower": "[a-z]+",
    "white": f"[{WS}]+",
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "beyond_ascii": r"[^\x00-\x7F]+",
    "punctuation": r"""[.,;:!?'"()-]+""",
}
#: words compared as one window; least words; most words in repeated windows, in percent
WIDTH, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: common words per language
COMMON = 32
#: least words and code points for a histogram to be judged, and the largest distances allowed.
#: A sample of n from k classes lies about sqrt((k - 1) / (8 n ln 2)) from its own language: 0.24
#: for 100 words, 0.07 for 200 code points; the limits stand well above that
MIN_WORDS, MIN_CHARS, WORD_LIMIT, CLASS_LIMIT = 100, 200, 0.35, 0.32
#: one sign per common word, to count them in a row's text of signs
SIGNS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
PARTS = 1_000_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WS}]+", -1), lambda w: w != "")


def _neighbours(rows: Column, field: str) -> Column:
    """Of structs ``(field, i)``: the ``i`` of those whose field another one has too."""
    same = lambda s: lambda x, j: (F.get(s, j - 1)[field] == x[field]) | (F.get(s, j + 1)[field] == x[field])
    return let(F.sort_array(rows), lambda s: F.transform(F.filter(s, same(s)), lambda x: x["i"]))


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words that stand in a window of ``WIDTH`` words found twice or more. ``words`` and
    ``hashes`` (of the windows) are columns; hashes pick the windows to compare."""
    picked = _neighbours(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))), "h")
    window = lambda i: F.struct(F.array_join(F.slice(words, i + 1, F.lit(WIDTH)), " ").alias("t"), i.alias("i"))
    found = F.sort_array(_neighbours(F.transform(picked, window), "t"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("n"), zero.alias("end"))
    step = lambda acc, i: F.struct((acc["n"] + i + WIDTH - F.greatest(acc["end"], i.cast("bigint"))).alias("n"), (i + WIDTH).cast("bigint").alias("end"))
    covered = F.aggregate(found, start, step, lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(zero)


def window_hashes(words: Column) -> Column:
    at = lambda h, i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)])
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WIDTH), lambda i: at(h, i))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= WIDTH, let(hashed, runs)).otherwise(F.array().cast("array<bigint>"))


def common_words(docs: DataFrame, text_col: str, lang_col: str, common: int, min_words: int) -> DataFrame:
    """``(lang, common)``: per language the words that most documents of at least
    ``min_words`` words hold, in this order (ties by code point)."""
    lang = F.coalesce(F.col(lang_col), F.lit("und"))
    d = docs.select(lang.alias("lang"), words_of(F.lower(F.col(text_col))).alias("_w")).where(F.size("_w") >= min_words)
    counted = d.select("lang", F.explode(F.array_distinct("_w")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    top = counted.withColumn("nth", first).where(F.col("nth") <= common)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("nth", "word"))), lambda x: x["word"])
    return top.groupBy("lang").agg(listed.alias("common"))


def facts(docs: DataFrame, words_by_lang: DataFrame, id_col: str, text_col: str, lang_col: str, common: int) -> DataFrame:
    """One narrow row per document: the base counts and the two histograms as counts."""
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_t"),
    ).join(words_by_lang.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang"), "left")
    d = d.withColumn("_words", words_of(F.col("_t")))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(f"[^{WS}]"))
    left = [F.col("_t")]
    for pattern in CLASSES.values():
        left.append(F.regexp_replace(left[-1], pattern, ""))
    d = d.select(
        "doc_id",
        "lang",
        "_words",
        F.coalesce("common", F.array().cast("array<string>")).alias("_common"),
        window_hashes(F.col("_words")).alias("_h"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.array(*[F.char_length(x) for x in left]).alias("_left"),
        (F.char_length(left[-1]) - F.char_length(F.translate(left[-1], SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    signs = F.array_join(
        F.transform(F.filter(F.transform("_words", lambda w: F.array_position("_common", F.lower(w))), lambda p: p > 0), lambda p: F.substring(F.lit(SIGNS), p.cast("int"), F.lit(1))), ""
    )
    d = d.select("*", signs.alias("_signs"), F.size("_words").cast("bigint").alias("n_words"), repeated_words(F.col("_words"), F.col("_h")).alias("n_repeat_words"))
    of_sign = lambda k: (F.char_length("_signs") - F.char_length(F.replace(F.col("_signs"), F.lit(SIGNS[k]), F.lit("")))).cast("bigint")
    class_counts = [(F.get("_left", k) - F.get("_left", k + 1)).cast("bigint") for k in range(len(CLASSES))]
    return d.select(
        "doc_id",
        "lang",
        "n_words",
        (F.get("_left", 0) - class_counts[1]).cast("bigint").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.array(*class_counts, F.get("_left", len(CLASSES)).cast("bigint")).alias("classes"),
        F.array(*[of_sign(k) for k in range(common)], F.col("n_words") - F.char_length("_signs")).alias("words"),
    )


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def distance(own: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts of one length; null without counts."""

    def part(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def of(p, q):
        m = (p + q) / 2
        return (part(p, m) + part(q, m)) / 2

    def between(a, b):
        terms = F.zip_with(own, reference, lambda x, y: of(x / a, y / b))
        sums = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
        return F.when((a > 0) & (b > 0), F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sums))))

    return let(total(own), lambda a: let(total(reference), lambda b: between(a, b)))


def reference_of(rows: DataFrame, counts: str, size: int, judged: Column) -> DataFrame:
    """``(lang, counts)``: the sum of the judged rows' histograms, each in millionths."""
    n = total(F.col(counts))
    share = rows.where(judged).select("lang", F.col(counts).alias("_c"), n.alias("_n")).where("_n > 0")
    sums = [F.sum(F.expr(f"get(_c, {k}) * {PARTS} div _n")).alias(f"_{k}") for k in range(size)]
    return share.groupBy("lang").agg(*sums).select("lang", F.array(*[f"_{k}" for k in range(size)]).alias(counts))


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    common: int = COMMON,
    min_words: int = MIN_WORDS,
    min_chars: int = MIN_CHARS,
    word_limit: float = WORD_LIMIT,
    class_limit: float = CLASS_LIMIT,
) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, word_distance)``, one row per input row; a distance is null where the
    histogram is not judged."""
    if common > len(SIGNS):
        raise ValueError(f"at most {len(SIGNS)} common words")
    by_lang = staged(common_words(docs, text_col, lang_col, common, min_words), "quality-words")
    rows = facts(docs, by_lang, id_col, text_col, lang_col, common)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = staged(rows.withColumn("base_failed", failed), "quality-rows")
    by_words = ~F.col("base_failed") & (F.col("n_words") >= min_words)
    by_classes = ~F.col("base_failed") & (total(F.col("classes")) >= min_chars)
    refs = reference_of(rows, "words", common + 1, by_words).withColumnRenamed("words", "_rw")
    refs = refs.join(reference_of(rows, "classes", len(CLASSES) + 1, by_classes).withColumnRenamed("classes", "_rc"), "lang", "full")
    # staged: a table of one row per language whose size is known, so it is broadcast if small
    refs = staged(refs.withColumnRenamed("lang", "_lang"), "quality-references")
    j = rows.join(refs, F.col("lang") == F.col("_lang"), "left")
    j = j.withColumn("class_distance", F.when(by_classes, distance(F.col("classes"), F.col("_rc"))))
    j = j.withColumn("word_distance", F.when(by_words, distance(F.col("words"), F.col("_rw"))))
    far = (F.coalesce("class_distance", F.lit(0.0)) > class_limit) | (F.coalesce("word_distance", F.lit(0.0)) > word_limit)
    return j.withColumn("kept", ~F.col("base_failed") & ~far).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"
    )


def _sql() -> str:
    ws = r"\x20\x09-\x0D"
    chars = lambda k, t: f"length(regexp_replace({t}, '[^{k}]', '', 'g'))"
    classes = ["a-z", ws, "A-Z", "0-9"]
    js = """CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(0, least(1, list_sum(list_transform(range(1, len({a}) + 1), lambda i:
      (CASE WHEN {a}[i] > 0 THEN ({a}[i] / list_sum({a})) * log2(({a}[i] / list_sum({a})) / (({a}[i] / list_sum({a}) + {b}[i] / list_sum({b})) / 2)) ELSE 0 END
       + CASE WHEN {b}[i] > 0 THEN ({b}[i] / list_sum({b})) * log2(({b}[i] / list_sum({b})) / (({a}[i] / list_sum({a}) + {b}[i] / list_sum({b})) / 2)) ELSE 0 END) / 2))))) END"""
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^{ws}]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{ws}]')) AS ls
  FROM documents),
df AS (
  SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(list_transform(w, lambda x: lower(x)))) AS word FROM d WHERE len(w) >= {MIN_WORDS})
  GROUP BY lang, word),
top AS (
  SELECT lang, list(word ORDER BY nth) AS common FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS nth FROM df) WHERE nth <= {COMMON} GROUP BY lang),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS g FROM pos WHERE i + {WIDTH - 1} <= len(w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range({WIDTH})) AS k) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, d.lang, CAST(len(w) AS BIGINT) AS n_words, length(t) - {chars(ws, 't')} AS word_chars,
         length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         [{", ".join(chars(c, "t") for c in classes)}, length(regexp_replace(t, '[\x00-\x7F]', '', 'g')),
          length(regexp_replace(t, '[^.,;:!?''"()-]', '', 'g'))] AS c6, length(t) AS n,
         list_transform(range(1, {COMMON + 1}), lambda k: CASE WHEN k <= len(common) THEN len(list_filter(w, lambda x: lower(x) = common[k])) ELSE 0 END) AS w32
  FROM d LEFT JOIN top USING (lang) LEFT JOIN cov USING (doc_id)),
g AS (
  SELECT *, list_append(c6, n - list_sum(c6)) AS c, list_append(w32, n_words - list_sum(w32)) AS wc,
         n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f),
rw AS (
  SELECT lang, list(s ORDER BY i) AS rw FROM (
    SELECT lang, i, sum(wc[i] * {PARTS} // n_words) AS s FROM g, (SELECT unnest(range(1, {COMMON + 2})) AS i)
    WHERE NOT base_failed AND n_words >= {MIN_WORDS} GROUP BY lang, i) GROUP BY lang),
rc AS (
  SELECT lang, list(s ORDER BY i) AS rc FROM (
    SELECT lang, i, sum(c[i] * {PARTS} // n) AS s FROM g, (SELECT unnest(range(1, {len(CLASSES) + 2})) AS i)
    WHERE NOT base_failed AND n >= {MIN_CHARS} GROUP BY lang, i) GROUP BY lang),
x AS (
  SELECT g.*, CASE WHEN NOT base_failed AND n >= {MIN_CHARS} THEN {js.format(a="c", b="rc")} END AS class_distance,
         CASE WHEN NOT base_failed AND n_words >= {MIN_WORDS} THEN {js.format(a="wc", b="rw")} END AS word_distance
  FROM g LEFT JOIN rw USING (lang) LEFT JOIN rc USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(class_distance, 0) <= {CLASS_LIMIT} AND coalesce(word_distance, 0) <= {WORD_LIMIT} AS kept
FROM x
"""


ORACLE = _sql()
