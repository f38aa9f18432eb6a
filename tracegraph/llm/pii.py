"""Personal data by information-theoretic sanitisation (DataFrame functions only).

Base entities are found by pattern: e-mail addresses, IP addresses, payment cards and
telephone numbers. Terms of its documents may give an entity away: over the whole corpus, the
pointwise mutual information PMI(e; t) = log2(n(e,t) N / (n(e) n(t))) of entity e and
term t, counted in documents, is compared with the entity's information content
IC(e) = log2(N / n(e)) (Sanchez, Batet and Viejo, 2013). A term discloses e to the
degree PMI / IC; terms at or above ``disclose`` are added as spans (kind ``term``)
wherever they stand in a document of e. ``sanitise`` replaces base entities by their
kind, generalises disclosing terms to their class and removes those at or above
``remove``.

A context is an entity's surroundings (``window`` code points on both sides), one a
document. A pair seen in ``support`` different contexts is weighed as counted. With fewer
(k), the share of t's documents that hold e, n(e,t) / n(t), is smoothed towards e's share
of all documents, n(e) / N: k parts counted, ``PSEUDO`` parts of the latter for each context
lacking. So an entity met once has disclosing terms, to a lower degree than one met
again (1 - 0.585 / log2 N at most), and copies of one text prove no more than one of them.

Scale: patterns run inside the scan; what is kept per document is its matches and the
text around them, and the text of documents with entities. Pairs are those of an entity
and a term of one document that can reach ``disclose`` by n(e) and n(t) alone, and are
counted with map-side combines. Document counts of terms are taken over the whole
corpus, for the candidate terms only: their distinct words are broadcast when a count
proves them few (``BROADCAST_TERMS``), else all terms are counted and joined.

Defined cases: a null text is an empty one; null ids are kept as they are; rows equal
in id and text are counted once and share their spans; an entity that fills every
document (IC = 0) discloses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, row_key, running, staged

#: kinds in the order in which they are listed. Possessive quantifiers and the look-behind
#: (or \G, the end of the previous match) only spare attempts that must fail: a run of
#: name characters or digits is tried from its start alone, so the scan stays linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARD_HINT = r"[0-9](?:[\x20-]?[0-9]){12}"
IP_HINT = r"[0-9]\.[0-9]"
OCTET = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
BROADCAST_TERMS = 20_000
#: documents counted in place of each context that a pair lacks of its support
PSEUDO = 0.5
SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def matches(text, pattern: str):
    """Leftmost non-overlapping matches as array<struct<start, end, value>>."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    ends = running(F.zip_with(gaps, found, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("bigint")))
    ends = F.slice(ends, 1, F.size(found))
    span = lambda m, e: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("value"))
    return F.zip_with(found, ends, span)


def _digits(v):
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v):
    """Doubled digits, every second from the right, become the sum of their digits."""
    doubled = lambda d: F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
    digits = F.transform(F.filter(F.split(F.reverse(_digits(v)), ""), lambda c: c != ""), lambda c: c.cast("int"))
    parts = F.transform(digits, lambda d, i: F.when(i % 2 == 1, doubled(d)).otherwise(d))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str):
    def digits_between(v, low, high):
        return F.length(_digits(v)).between(low, high)

    return {
        "email": lambda m: F.lit(True),
        "ip": lambda m: F.forall(F.split(m.value, r"\."), lambda p: p.rlike(OCTET)),
        "card": lambda m: F.when(digits_between(m.value, 13, 19), _luhn(m.value)).otherwise(False),
        "phone": lambda m: digits_between(m.value, 9, 15),
    }[kind]


def base_spans(text, kind: str):
    hint = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(IP_HINT), "card": text.rlike(CARD_HINT), "phone": F.contains(text, F.lit("+"))}[kind]
    return F.when(hint, F.filter(matches(text, PATTERNS[kind]), _valid(kind))).otherwise(F.array().cast(SPAN))


def find_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 80) -> DataFrame:
    """``(_key, doc_id, base, text)``: ``base`` holds ``(kind, start, end, value, left, right)``, the
    last two being the ``window`` code points before and after; ``text`` is null without entities."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(row_key(id_col, text_col).alias("_key"), F.col(id_col).alias("doc_id"), text.alias("_text"))
    d = d.select("*", *[base_spans(F.col("_text"), k).alias(f"_{k}") for k in PATTERNS])

    def around(kind):
        def one(m):
            start = F.greatest(F.lit(0), m.start - window)
            left = F.substring(F.col("_text"), (start + 1).cast("int"), (m.start - start).cast("int"))
            right = F.substring(F.col("_text"), (m.end + 1).cast("int"), F.lit(window))
            return F.struct(F.lit(kind).alias("kind"), m.start.alias("start"), m.end.alias("end"), m.value.alias("value"), left.alias("left"), right.alias("right"))

        return F.transform(f"_{kind}", one)

    some = F.concat(*[around(k) for k in PATTERNS])
    any_found = F.greatest(*[F.size(f"_{k}") for k in PATTERNS]) > 0
    return d.select("_key", "doc_id", some.alias("base"), F.when(any_found, F.col("_text")).alias("text"))


def disclosing_terms(docs: DataFrame, entities: DataFrame, text_col: str = "text", disclose: float = 0.9, support: int = 2) -> DataFrame:
    """``(_key, start, end, value, degree)`` of the terms that disclose an entity of their document."""
    found = entities.dropDuplicates(["_key"])
    rows = staged(_terms(found), "pii-terms")

    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    tokens = F.transform(F.split(text, f"[{WS}]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    seen, wanted = docs.select(F.explode(F.array_distinct(tokens)).alias("term")), rows.select("term").distinct()
    few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    if few:
        seen = seen.join(F.broadcast(wanted), "term", "left_semi")
    per_term = seen.groupBy("term").agg(F.count(F.lit(1)).alias("_nt"))
    # an entity has one context a document, so that naming it twice in one is no second witness
    entity = F.concat("_e.kind", F.lit(":"), F.lower("_e.value"))
    held = found.select("_key", F.explode("base").alias("_e")).groupBy("_key", entity.alias("entity")).agg(F.min(F.xxhash64("_e.left", "_e.right")).alias("_ctx"))
    held = staged(held, "pii-held")
    per_entity = staged(held.groupBy("entity").agg(F.count(F.lit(1)).alias("_ne")), "pii-entities")
    total, most = float(max(docs.count(), 1)), float(per_entity.agg(F.max("_ne")).first()[0] or 1)

    def degree(ne, share):
        """Of disclosure, when ``share`` of the documents of a term hold the entity."""
        ic = F.log2(F.lit(total) / ne)
        return F.when(ic > 0, F.log2(share * total / ne) / ic).otherwise(0.0)

    # no pair can disclose more than when all documents of the rarer of the two hold both: what
    # cannot reach ``disclose`` so is left out before pairs are built, first against the most frequent entity
    bound = lambda ne: F.least(ne.cast("double"), F.col("_nt").cast("double")) / F.col("_nt")
    reach = lambda ne: F.log2(bound(ne) * total / ne) >= disclose * F.log2(F.lit(total) / ne) - 1e-9
    per_term = staged(per_term.where(reach(F.lit(most))), "pii-rare")
    held = held.join(per_entity, "entity")
    pairs = rows.select("_key", "term").distinct().join(per_term, "term").join(held, "_key").where(reach(F.col("_ne")))
    pairs = staged(pairs.select("_key", "entity", "term", "_ctx", "_ne", "_nt"), "pii-pairs")

    # documents and different contexts of a pair, in two map-side-combined steps
    both = pairs.groupBy("entity", "term", "_ctx").agg(F.count(F.lit(1)).alias("_n"), F.max("_ne").alias("_ne"), F.max("_nt").alias("_nt"))
    both = both.groupBy("entity", "term").agg(F.sum("_n").alias("_both"), F.count(F.lit(1)).alias("_ctxs"), F.max("_ne").alias("_ne"), F.max("_nt").alias("_nt"))
    missing = F.greatest(F.lit(0), support - F.col("_ctxs")) * PSEUDO
    share = (F.col("_ctxs") * F.col("_both") / F.col("_nt") + missing * F.col("_ne") / total) / (F.col("_ctxs") + missing)
    told = staged(both.select("entity", "term", degree(F.col("_ne"), share).alias("degree")).where(F.col("degree") >= disclose), "pii-told")
    hits = pairs.join(told, ["entity", "term"]).groupBy("_key", "term").agg(F.max("degree").alias("degree"))
    return rows.join(hits, ["_key", "term"]).select("_key", "start", "end", "value", "degree")


def _terms(found: DataFrame) -> DataFrame:
    """``(_key, term, start, end, value)``: the words of the whole documents that overlap no entity."""
    words = found.select("_key", F.explode(matches(F.col("text"), f"[^{WS}]+")).alias("_w")).select("_key", "_w.start", "_w.end", "_w.value")
    spans = found.select("_key", F.explode("base").alias("_b")).select("_key", "_b.start", "_b.end", F.lit(None).cast("string").alias("value"))
    # words do not overlap: a span that starts in a word is the row after it, one that started
    # before it reaches into it if any end so far does; a window holds one document
    order = Window.partitionBy("_key").orderBy("start", F.col("value").isNull())
    ends = F.max(F.when(F.col("value").isNull(), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.when(F.lead("value").over(order).isNull(), F.lead("start").over(order))
    both = words.unionByName(spans).withColumn("_ends", ends).withColumn("_after", after)
    free = both.where("value IS NOT NULL AND coalesce(_ends <= start, true) AND coalesce(_after >= end, true)")
    term = F.regexp_replace(F.lower("value"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return free.select("_key", term.alias("term"), "start", "end", "value").where("term <> ''")


def sanitise_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclose: float = 0.9, support: int = 2, window: int = 80) -> DataFrame:
    """``(_key, doc_id, base, terms)``, one row per input row: the found entities and the
    disclosing terms ``(start, end, value, degree)`` in text order."""
    entities = staged(find_entities(docs, id_col, text_col, window), "pii-base")
    terms = disclosing_terms(docs, entities.where(F.size("base") > 0), text_col, disclose, support)
    terms = terms.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "value", "degree"))).alias("terms"))
    return entities.join(terms, "_key", "left").select("_key", "doc_id", "base", F.coalesce("terms", F.array()).alias("terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclose: float = 0.9, remove: float = 0.97, support: int = 2, window: int = 80) -> DataFrame:
    """``(doc_id, text, sanitised)``: entities become ``[KIND]``, terms ``[NUMBER]`` or ``[WORD]``,
    or nothing at a degree of ``remove`` or more; of overlapping spans the first listed wins."""
    spans = sanitise_spans(docs, id_col, text_col, disclose, support, window).dropDuplicates(["_key"])
    base = F.transform("base", lambda b: F.struct(b.start.alias("start"), b.end.alias("end"), F.concat(F.lit("["), F.upper(b.kind), F.lit("]")).alias("put")))
    kind = lambda t: F.when(t.value.rlike("[0-9]"), "[NUMBER]").otherwise("[WORD]")
    terms = F.transform("terms", lambda t: F.struct(t.start.alias("start"), t.end.alias("end"), F.when(t.degree >= remove, "").otherwise(kind(t)).alias("put")))
    spans = spans.select("_key", F.sort_array(F.concat(base, terms)).alias("_s"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(row_key(id_col, text_col).alias("_key"), F.col(id_col).alias("doc_id"), text.alias("text")).join(spans, "_key")
    cut = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda acc, s: F.when(s.start < acc.at, acc).otherwise(F.struct(s.end.alias("at"), F.concat(acc.out, cut(acc.at, s.start), s.put).alias("out")))
    done = F.aggregate("_s", zero, step, lambda acc: F.concat(acc.out, cut(acc.at, F.char_length("text").cast("bigint"))))
    return d.select("doc_id", "text", done.alias("sanitised"))


def report(spans: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and the list of all spans per document."""
    show = lambda b: F.concat_ws(":", b.kind, b.start, b.end)
    base = F.array_join(F.transform("base", show), ",")
    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t.start, t.end))
    n = lambda k: F.size(F.filter("base", lambda b: b.kind == k)).cast("bigint").alias(f"n_{k}")
    everything = F.array_join(F.concat(F.transform("base", show), terms), ",")
    return spans.select("doc_id", *[n(k) for k in PATTERNS], F.sha2(base, 256).alias("base_sha256"), everything.alias("spans"))
