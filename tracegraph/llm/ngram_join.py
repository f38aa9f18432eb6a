"""Exact Jaccard self-join of word-shingle sets by prefix trees.

Two documents link when |A n B| / |A u B| >= 0.8 on their sets of distinct 5-word
shingles. The result names the class (connected component of links) of every document.

Steps, all exact; with c(n) = ceil(0.8 n) and t(n) = floor(n / 5):

1. Linked sets share at least c(n) shingles, so of the first 2 t(n) + 1 in hash order at
   least t(c(n)) + 1 must occur in some other document (prefix filter). Only documents
   that pass can have a link; shingles are counted packed by hash range, each batch of
   documents sending a shingle once however many of its documents hold it.
2. Equal sets are one class from the start; the smallest document id stands for them.
3. Sets of these representatives are ordered globally by document frequency, rare
   shingles first. Linked sets share one of their first t(n) + 1; those of frequency 1
   find nobody. What remains are the entries (shingle, document).
4. Documents are dealt into blocks by hash; a pair of blocks whose documents share an
   entry at a compatible size becomes one group, and holds the sets of just those
   documents: all documents of one shingle are never brought together, and no pair of
   documents is ever a row.
5. In a group the sets go into a prefix tree, the shingles that many of them hold first,
   so that sets share long paths. One traversal carries the overlaps of all query sets
   with the path so far (computed once for all sets below), and drops a query when the
   lengths that remain cannot make the overlap large enough; a subtree without queries is
   skipped. At the end of a set the overlaps are exact. A spanning forest of the links
   leaves the group.
6. Components by alternating large-star and small-star rounds.

Where only the classes are asked for (``one_of_each``), links that connect nothing new are not
looked for (``class_links``): two rounds first bring documents together by the entry that most
of them share, so families of near copies meet in few blocks and become one component, then
one document per component is left to meet others the same way. Step 4 then takes only
entries whose holders are of several components, and brings a block together only with the
blocks that hold other components; this is exact, as links inside a component are no news.
Here blocks are dealt by family: components that share entries, directly or through others.

Defined cases: null and empty texts and texts without words have an empty set, which
links with nothing, not even another empty one; rows without an id are left out (they
could not be named); rows repeating an id count as one document, the one with the most
shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, give_back, small_batches, staged, without
from .shingles import mix, shingle_sets

NONE = np.uint32(0xFFFFFFFF)
#: documents and bytes of sets per block of step 4; documents per part of step 3
BLOCK_DOCS, BLOCK_BYTES, PART_DOCS = 512, 4 << 20, 2000
#: documents whose sets a task holds at a time in step 1; bytes of text per hash range there
PACK_DOCS, RANGE_BYTES = 1000, 16 << 20
#: most ids that are broadcast to pick texts (8 bytes each); beyond it an ordinary join does it
BROADCAST_IDS = 500_000


def at_least(n):
    """c(n): what a partner of a set of n must share with it."""
    return (4 * n + 4) // 5


def slack(n):
    """t(n): how many members of a set of n a partner may lack."""
    return n // 5


def cut_by_range(tokens: np.ndarray, n_buckets: int) -> np.ndarray:
    """Ends of the hash ranges in sorted ``tokens``."""
    edges = np.array([(k << 64) // n_buckets for k in range(1, n_buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


PACKED = "bucket int, part int, tokens binary, owners binary, base long, ids binary, sizes binary, digests binary, known binary"
COUNTED = "part int, ids binary, sizes binary, digests binary, known binary"


def _packed(bucket, part=None, tokens=None, owners=None, base=None, ids=None, sizes=None, digests=None, known=None):
    raw = lambda a: None if a is None else a.tobytes()
    return (bucket, part, raw(tokens), raw(owners), base, raw(ids), raw(sizes), digests, raw(known))


def by_part(ids: np.ndarray, parts: int):
    """(part, positions) of the ids, dealt by hash."""
    part = (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    met, at = np.unique(part[order], return_index=True)
    return zip(met.tolist(), np.split(order, at[1:]), strict=True)


def _pack_batch(ids: np.ndarray, sets: list[np.ndarray], n_buckets: int, parts: int) -> list[tuple]:
    """Rows of a batch: its documents (with the shingles already known to be shared inside
    the batch), and per hash range the prefix shingles, each once, with its document or,
    if several of the batch hold it, none."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    prefix = [s[: 2 * slack(len(s)) + 1] for s in sets]
    lengths = np.array([len(p) for p in prefix], dtype=np.int64)
    tokens = np.concatenate(prefix) if prefix else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    first = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, dtype=bool)
    run = np.cumsum(first) - 1
    several = np.bincount(run)[run] > 1 if len(tokens) else first
    known = np.bincount(owner[several], minlength=len(sets)).astype(np.int64)
    base = int(ids.min()) if len(ids) else 0
    wide = len(ids) and int(ids.max()) - base >= int(NONE)
    offsets = np.arange(len(ids)) if wide else ids - base
    sent = np.where(several, NONE, offsets[owner].astype(np.uint32))[first]
    tokens = tokens[first]
    ends = cut_by_range(tokens, n_buckets)
    rows = []
    for b in range(n_buckets):
        lo, hi = ends[b], ends[b + 1]
        if lo < hi:
            own = sent[lo:hi]
            if wide:
                met = np.unique(own[own != NONE])
                place = np.where(own == NONE, NONE, np.searchsorted(met, own).astype(np.uint32))
                rows.append(_packed(b, None, tokens[lo:hi], place.astype(np.uint32), None, ids[met]))
            else:
                rows.append(_packed(b, None, tokens[lo:hi], own, base))
    if len(ids):
        for part, at in by_part(ids, parts):
            rows.append(_packed(part, part, ids=ids[at], sizes=sizes[at], digests=b"".join(_digest(sets[i]) for i in at), known=known[at]))
    return rows


def _shared(rows: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Of one hash range: how many of a document's prefix shingles others hold, packed by part
    of the documents; the rows of the documents themselves pass."""
    out, tokens, owners, seen = [], [], [], []
    for part, t, o, base, ids, sizes, digests, known in zip(*[rows[c] for c in ("part", "tokens", "owners", "base", "ids", "sizes", "digests", "known")], strict=True):
        if sizes is not None:
            out.append((int(part), ids, sizes, digests, known))
            continue
        own = np.frombuffer(o, dtype=np.uint32)
        has = own != NONE
        name = np.zeros(len(own), dtype=np.int64)
        name[has] = np.frombuffer(ids, dtype=np.int64)[own[has]] if ids is not None else own[has].astype(np.int64) + int(base)
        tokens.append(np.frombuffer(t, dtype=np.uint64))
        owners.append(name)
        seen.append(has)
    if tokens:
        t, o, s = np.concatenate(tokens), np.concatenate(owners), np.concatenate(seen)
        order = np.argsort(t)
        t, o, s = t[order], o[order], s[order]
        first = np.concatenate([[True], t[1:] != t[:-1]])
        run = np.cumsum(first) - 1
        found, count = np.unique(o[s & (np.bincount(run)[run] > 1)], return_counts=True)
        out += [(part, found[at].tobytes(), None, None, count[at].astype(np.int64).tobytes()) for part, at in by_part(found, parts)] if len(found) else []
    return pd.DataFrame(out, columns=[c.split()[0] for c in COUNTED.split(", ")])


def _documents(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one part: its documents with the counts of all hash ranges added up."""
    whole = lambda column, pick: np.concatenate([np.frombuffer(x, dtype=np.int64) for x in column[pick]])
    own = rows["sizes"].notna()
    names, sizes = whole(rows["ids"], own), whole(rows["sizes"], own)
    digests = b"".join(rows["digests"][own])
    d = pd.DataFrame({"doc_id": names, "n": sizes, "digest": [digests[i * 16 : i * 16 + 16] for i in range(len(names))]})
    d = d.sort_values(["doc_id", "n", "digest"]).drop_duplicates("doc_id", keep="last")
    ids, counts = whole(rows["ids"], slice(None)), whole(rows["known"], slice(None))
    shared = np.zeros(len(d), dtype=np.int64)
    np.add.at(shared, np.searchsorted(d["doc_id"].to_numpy(), ids), counts)
    return d.assign(shared=shared)


def _tidy(result: pd.DataFrame) -> pd.DataFrame:
    """The result of a large group, after the group's memory has been given back."""
    give_back()
    return result


def document_sets(docs: DataFrame, id_col: str, text_col: str, n_buckets: int) -> DataFrame:
    """``(doc_id, n, digest, shared)`` per document (step 1)."""
    # a part gathers counts from every range: fewer parts than ranges keep those rows long
    parts = max(1, n_buckets // 16)
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in PACKED.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PACK_DOCS):
                some = batch.slice(at, PACK_DOCS)
                rows = _pack_batch(some.column(0).to_numpy(), shingle_sets(some.column(1).to_pylist()), n_buckets, parts)
                columns = [pa.array(c, type=kind) for c, (_, kind) in zip(zip(*rows), fields, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])
        give_back()

    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    counted = d.mapInArrow(pack, PACKED).groupBy("bucket").applyInPandas(lambda rows: _tidy(_shared(rows, parts)), COUNTED)
    return counted.groupBy("part").applyInPandas(lambda rows: _tidy(_documents(rows)), "doc_id long, n long, digest binary, shared long")


def _frequencies(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range: document frequencies, returned to each part for its own shingles."""
    tokens = [np.frombuffer(t, dtype=np.uint64) for t in rows["tokens"]]
    sizes = [len(t) for t in tokens]
    t, c = np.concatenate(tokens), np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in rows["counts"]])
    u, inverse = np.unique(t, return_inverse=True)
    df = np.bincount(inverse, weights=c).astype(np.uint32)[inverse]
    out, at = [], 0
    for part, n in zip(rows["part"], sizes, strict=True):
        mine, often = t[at : at + n], df[at : at + n]
        keep = often > 1
        if keep.any():
            out.append((part, mine[keep].tobytes(), often[keep].tobytes()))
        at += n
    return pd.DataFrame(out, columns=["part", "tokens", "counts"])


def _prefix_entries(sets: pd.DataFrame, common: pd.DataFrame) -> pd.DataFrame:
    """Per document of a part, the shingles of its prefix in global order that others hold."""
    found: list[tuple] = []
    if len(common):
        tokens = np.concatenate([np.frombuffer(t, dtype=np.uint64) for t in common["tokens"]])
        often = np.concatenate([np.frombuffer(c, dtype=np.uint32) for c in common["counts"]])
        order = np.argsort(tokens)
        tokens, often = tokens[order], often[order]
        for doc, raw in zip(sets["doc_id"], sets["tokens"], strict=True):
            mine = np.frombuffer(raw, dtype=np.uint64)
            at = np.minimum(np.searchsorted(tokens, mine), len(tokens) - 1)
            held = tokens[at] == mine
            room = slack(len(mine)) + 1 - int((~held).sum())
            if room > 0:
                t, f = mine[held], often[at[held]]
                found.append((doc, len(mine), t[np.lexsort((t, f))[:room]]))
    n = [len(t) for _, _, t in found]
    return pd.DataFrame(
        {
            "token": np.concatenate([t for _, _, t in found]).view(np.int64) if found else np.zeros(0, dtype=np.int64),
            "doc_id": np.repeat(np.array([d for d, _, _ in found], dtype=np.int64), n),
            "n": np.repeat(np.array([s for _, s, _ in found], dtype=np.int64), n),
        }
    )


def prefix_entries(sets: DataFrame, parts: int, n_buckets: int) -> DataFrame:
    """``(token, doc_id, n)`` of step 3 from ``sets(part, doc_id, tokens)``."""

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        u, c = np.unique(np.concatenate([np.frombuffer(t, dtype=np.uint64) for t in rows["tokens"]]), return_counts=True)
        ends, c = cut_by_range(u, n_buckets), c.astype(np.uint32)
        part = int(rows["part"].iloc[0])
        out = [(b, part, u[ends[b] : ends[b + 1]].tobytes(), c[ends[b] : ends[b + 1]].tobytes()) for b in range(n_buckets) if ends[b] < ends[b + 1]]
        return pd.DataFrame(out, columns=["bucket", "part", "tokens", "counts"])

    packed = sets.groupBy("part").applyInPandas(send, "bucket int, part int, tokens binary, counts binary")
    common = packed.groupBy("bucket").applyInPandas(lambda r: _tidy(_frequencies(r)), "part int, tokens binary, counts binary")
    joined = sets.groupBy("part").cogroup(common.groupBy("part"))
    return joined.applyInPandas(lambda s, c: _tidy(_prefix_entries(s, c)), "token long, doc_id long, n long")


class PrefixTree:
    """Sets as sorted ranks (0: the shingle that most sets of the group hold)."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets)
        u, inverse, often = np.unique(tokens, return_inverse=True, return_counts=True)
        rank = np.empty(len(u), dtype=np.int64)
        rank[np.lexsort((u, -often))] = np.arange(len(u))
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        flat = rank[inverse]
        order = np.lexsort((flat, owner))
        self.flat, self.start = flat[order], np.concatenate([[0], np.cumsum(self.sizes)])
        self.width = len(u)
        self.keys = owner[order] * self.width + self.flat
        # who holds a rank: postings[offset[r]:offset[r + 1]]
        by_rank = np.lexsort((owner, flat))
        self.postings, self.offset = owner[by_rank], np.searchsorted(flat[by_rank], np.arange(len(u) + 1))
        paths = [self.flat[self.start[i] : self.start[i + 1]] for i in range(len(sets))]
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.shared = [0] + [self._common(a, b) for a, b in zip(self.paths, self.paths[1:])] + [0]

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def overlaps(self, run: np.ndarray) -> np.ndarray:
        """How many shingles of a run of ranks each set holds."""
        n = self.offset[run + 1] - self.offset[run]
        ends = np.cumsum(n)
        at = np.repeat(self.offset[run] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.postings[at], minlength=len(self.sizes))

    def passed(self, queries: np.ndarray, rank: int) -> np.ndarray:
        """How many shingles of each query have a rank up to ``rank``."""
        return np.searchsorted(self.keys, queries * self.width + rank + 1) - self.start[queries]

    def links(self, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Pairs of linked sets, those of different sides only when sides are given."""
        size, out = self.sizes, []
        everyone = np.arange(len(size))
        stack = [(0, len(self.paths), 0, everyone, np.zeros(len(size), dtype=np.int64))]
        while stack:  # sets lo..hi share a path of depth d; queries with their overlaps so far
            lo, hi, d, queries, overlap = stack.pop()
            if hi - lo == 1:
                down = len(self.paths[lo])
            else:
                down = min(self.shared[lo + 1 : hi])
            if down > d:
                run = self.paths[lo][d:down]
                overlap = overlap + self.overlaps(run)[queries]
                below = size[[self.order[i] for i in range(lo, hi)]]
                a, longest, shortest = size[queries], int(below.max()), int(below.min())
                # 9 * overlap >= 4 * (a + b) is the link; b - down members are still to come, and
                # a query cannot make up for members it has passed without a match
                missed = self.passed(queries, int(run[-1])) - overlap
                able = (9 * (overlap - down) + 5 * longest >= 4 * a) & (9 * (a - missed) >= 4 * (a + shortest))
                queries, overlap = queries[able], overlap[able]
                if not len(queries):
                    continue
            if hi - lo == 1:
                me = self.order[lo]
                other = queries < me if side is None else side[queries] < side[me]
                linked = queries[(9 * overlap >= 4 * (size[queries] + size[me])) & other]
                out += [(int(q), me) for q in linked]
                continue
            cut = [lo] + [i for i in range(lo + 1, hi) if self.shared[i] == down] + [hi]
            stack += [(a, b, down, queries, overlap) for a, b in zip(cut, cut[1:])]
        return out


def forest(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Pairs that connect what all pairs connect."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


GROUP = "a long, b long, links long"


def _group_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one group: pairs (a, b) that connect what its links connect, and per document with
    links a row (a, null, number of documents it links to)."""
    rows = rows.drop_duplicates("doc_id")  # input rows that repeat an id
    ids = rows["doc_id"].to_numpy()
    lo, hi = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
    side = None if lo == hi else (rows["blk"].to_numpy() == hi).astype(np.int64)
    none = np.zeros((0, 2), dtype=np.int64)
    pairs = none
    if len(ids) > 1 and (side is None or side.min() < side.max()):
        tree = PrefixTree([np.frombuffer(t, dtype=np.uint64) for t in rows["tokens"]])
        pairs = np.array(tree.links(side), dtype=np.int64).reshape(-1, 2)
    kept = np.array(forest(pairs.tolist(), len(ids)), dtype=np.int64).reshape(-1, 2) if len(pairs) else none
    copies, links = rows["copies"].to_numpy(), np.zeros(len(ids), dtype=np.int64)
    for x, y in ((0, 1), (1, 0)):
        np.add.at(links, pairs[:, x], copies[pairs[:, y]])
    linked = np.flatnonzero(links)
    found = pd.DataFrame({"a": ids[kept[:, 0]], "b": ids[kept[:, 1]]}, dtype="Int64")
    return pd.concat([found, pd.DataFrame({"a": ids[linked], "links": links[linked]}, dtype="Int64")]).reindex(columns=["a", "b", "links"])


def set_links(sets: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows ``GROUP`` of steps 4 and 5: a spanning forest of the links of each group of blocks,
    and the numbers of links. Two documents meet in one group only, so the numbers add up."""
    alive = entries.groupBy("doc_id").agg(F.max("n").alias("n")).agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
    blocks = max(1, -(-alive.d // BLOCK_DOCS), -(-alive.t * 8 // BLOCK_BYTES))
    e = entries.withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    # partners differ by a factor of at most 1.25 in size: neighbouring size classes
    e = e.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int"))
    held = staged(e.groupBy("token", "cls", "blk").agg(F.count(F.lit(1)).alias("c")), "ngram-held")
    near = held.select("token", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)).alias("cls"), F.col("blk").alias("blk2"), "c")
    # c counts the documents of the other block that the entry meets; in its own block it meets itself too
    near = staged(near.groupBy("token", "cls", "blk2").agg(F.sum("c").alias("c")), "ngram-near")
    met = e.join(near, ["token", "cls"]).where((F.col("blk") != F.col("blk2")) | (F.col("c") > 1))
    met = met.select(F.least("blk", "blk2").alias("lo"), F.greatest("blk", "blk2").alias("hi"), "doc_id", "blk").distinct()
    groups = met.join(sets.select("doc_id", "copies", "tokens"), "doc_id")
    return groups.groupBy("lo", "hi").applyInPandas(lambda rows: _group_links(rows), GROUP)


def blocks_for(docs: int, shingles: int) -> int:
    return max(1, -(-docs // BLOCK_DOCS), -(-shingles * 8 // BLOCK_BYTES))


def _gathered(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Links inside the groups ``members(lo, hi, blk, doc_id)``."""
    groups = members.join(sets.select("doc_id", "copies", "tokens"), "doc_id")
    found = groups.groupBy("lo", "hi").applyInPandas(lambda rows: _group_links(rows), GROUP)
    return found.where("b IS NOT NULL").select("a", "b")


def _dealt_by_entry(entries: DataFrame) -> DataFrame:
    """``members``: every document in the block of the entry that most others share with it."""
    often = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).where("c > 1")
    pick = entries.join(often, "token").groupBy("doc_id").agg(F.max(F.struct("c", "token", "s")).alias("p"), F.max("n").alias("n"))
    pick = staged(pick.select("doc_id", "n", "p.*"), "ngram-picked")
    all_ = pick.agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
    place = F.xxhash64("token", F.pmod(F.xxhash64("doc_id"), _parts("c", "s")))
    blk = F.pmod(place, F.lit(blocks_for(all_.d, all_.t))).cast("int")
    return pick.select("doc_id", blk.alias("blk"), blk.alias("lo"), blk.alias("hi"))


def _parts(docs: str, shingles: str):
    """In how many blocks so many documents with so many shingles are dealt."""
    return F.greatest(F.ceil(F.col(docs) / BLOCK_DOCS), F.ceil(F.col(shingles) * 8 / BLOCK_BYTES))


def _dealt_by_family(e: DataFrame) -> tuple[DataFrame, int]:
    """``(component, own_parts, key, alone, parts)``: by what key, and in how many parts of it, the
    documents of a component are dealt, and the number of blocks.

    Components that share entries, however indirectly, are a family: only they can have links.
    A family of at most a block meets in one block. In a larger one each component goes by the
    entry of its own that most documents hold, so an entry's holders are in few blocks here too."""
    size = e.groupBy("doc_id", "component").agg(F.max("n").alias("n")).groupBy("component").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("t"))
    links = e.select(F.col("component").alias("a"), F.col("first").alias("b"))
    family = components(size.select(F.col("component").alias("id")), links, "ngram-family").select(F.col("id").alias("component"), F.col("component").alias("family"))
    size = staged(size.join(family, "component"), "ngram-sizes")
    families = size.groupBy("family").agg(F.sum("d").alias("d"), F.sum("t").alias("t"))
    families = staged(families, "ngram-families")
    all_ = families.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    large = families.where(_parts("d", "t") > 1).select("family")
    alone = size.join(large, "family", "left_anti").select("component", _parts("d", "t").alias("own_parts"), F.col("family").alias("key"), F.lit(True).alias("alone"), F.lit(1).cast("bigint").alias("parts"))
    inner = size.join(large, "family")
    held = staged(e.join(inner.select("component"), "component", "left_semi").select("token", "component"), "ngram-large")
    often = staged(held.groupBy("token").agg(F.count(F.lit(1)).alias("c")), "ngram-often")
    pick = held.join(often, "token").groupBy("component").agg(F.max(F.struct("c", "token")).alias("p"))
    pick = staged(inner.join(pick.select("component", F.col("p.token").alias("key")), "component"), "ngram-pick")
    load = pick.groupBy("key").agg(F.sum("d").alias("all_d"), F.sum("t").alias("all_t"))
    inside = pick.join(load, "key").select("component", _parts("d", "t").alias("own_parts"), "key", F.lit(False).alias("alone"), _parts("all_d", "all_t").alias("parts"))
    return staged(alone.unionByName(inside), "ngram-dealt"), blocks_for(all_.d, all_.t)


def class_links(sets: DataFrame, entries: DataFrame, rounds: int = 2) -> DataFrame:
    """``(a, b)``: links with the same components as all links."""
    nodes = staged(entries.select(F.col("doc_id").alias("id")).distinct(), "ngram-nodes")
    heads, found = entries, None
    for r in range(rounds):
        new = staged(_gathered(sets, _dealt_by_entry(heads)), f"ngram-round{r}")
        found = new if found is None else found.unionByName(new)
        of = staged(components(nodes, found, f"ngram-cc{r}"), f"ngram-of{r}")
        heads = entries.join(of.where("id = component").select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    # what several components share, and the smallest of them
    e = entries.join(of.withColumnRenamed("id", "doc_id"), "doc_id")
    shared = e.groupBy("token").agg(F.min("component").alias("first"), F.max("component").alias("_b")).where("first <> _b").drop("_b")
    e = staged(e.join(shared, "token"), "ngram-shared")
    dealt, blocks = _dealt_by_family(e)
    place = F.xxhash64("key", "alone", F.pmod(F.xxhash64("component", F.pmod(F.xxhash64("doc_id"), "own_parts")), "parts"))
    blk = F.pmod(place, F.lit(blocks)).cast("int").alias("blk")
    cls = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int").alias("cls")
    e = staged(e.join(dealt, "component").select("token", "doc_id", "component", blk, cls), "ngram-placed")
    # entries held in the same blocks (say, all those of one passage) are looked at together; a
    # mark that two sets of blocks share by chance only brings more documents together
    mark = lambda seed: F.bit_xor(F.xxhash64("blk", "cls", "component", F.lit(seed)))
    marks = e.select("token", "blk", "cls", "component").distinct().groupBy("token").agg(F.struct(mark(1).alias("x"), mark(2).alias("y")).alias("mark"))
    e = staged(e.join(marks, "token").select("mark", "doc_id", "component", "blk", "cls").distinct(), "ngram-marked")
    held = e.groupBy("mark", "blk", "cls").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("c"))
    # a block that holds nothing but the largest component does not look for others: they come to it
    main = e.groupBy("mark", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("mark").agg(F.max(F.struct("c", "component")).alias("m"))
    held = staged(held.join(main.select("mark", F.col("m.component").alias("main")), "mark"), "ngram-holders")
    near = F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)).alias("cls")
    seek = held.where("a <> main OR b <> main").select("mark", F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("blk").alias("blk1"), near)
    meet = seek.join(held.select("mark", "cls", "a", "b", "blk"), ["mark", "cls"]).where("NOT (a = b AND a1 = a AND b1 = b)")
    pairs = meet.select("mark", F.least("blk", "blk1").alias("lo"), F.greatest("blk", "blk1").alias("hi")).distinct()
    sides = pairs.select("*", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("blk"))
    members = sides.join(e.select("mark", "blk", "doc_id"), ["mark", "blk"]).select("lo", "hi", "blk", "doc_id").distinct()
    last = staged(_gathered(sets, staged(members, "ngram-members")), "ngram-last")
    return found.unionByName(last)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)``, one row per document id; ``n_links``
    counts the other documents it links to, copies included, and is left out (with the work for
    it) without ``count_links``."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col, count_links)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, count_links: bool) -> DataFrame:
    spark = docs.sparkSession
    bytes_ = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // RANGE_BYTES))
    info = staged(document_sets(docs, id_col, text_col, n_buckets), "ngram-docs")
    c = F.floor((4 * F.col("n") + 4) / 5)
    passed = info.where((F.col("n") > 0) & (F.col("shared") >= F.floor(c / 5) + 1))
    classes = staged(passed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "ngram-classes")
    n_reps = classes.count()
    parts = max(1, -(-n_reps // PART_DOCS))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 250):
                some = batch.slice(at, 250)
                sets = shingle_sets(some.column(1).to_pylist())
                columns = [some.column(0), pa.array([_digest(s) for s in sets], type=pa.binary()), pa.array([s.tobytes() for s in sets], type=pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "tokens"])
        give_back()

    reps = classes.select(F.col("rep").alias("doc_id"), "digest", "copies")
    wanted = reps.select("doc_id")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(wanted) if n_reps <= BROADCAST_IDS else wanted, "doc_id", "left_semi")
    sets = texts.mapInArrow(sets_of, "doc_id long, digest binary, tokens binary").join(reps, ["doc_id", "digest"])
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(parts)).cast("int").alias("part")
    sets = staged(sets.select(part, "doc_id", "copies", "tokens"), "ngram-sets")
    entries = staged(prefix_entries(sets.select("part", "doc_id", "tokens"), parts, n_buckets), "ngram-entries")
    if not count_links:
        found = components(classes.select(F.col("rep").alias("id")), class_links(sets, entries), "ngram-cc")
        named = staged(classes.join(found.withColumnRenamed("id", "rep"), "rep").select("digest", "component"), "ngram-named")
        return info.join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    links = staged(set_links(sets, entries), "ngram-links")
    found = components(classes.select(F.col("rep").alias("id")), links.where("b IS NOT NULL").select("a", "b"), "ngram-cc")
    number = links.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = classes.join(found.withColumnRenamed("id", "rep"), "rep").join(number, "rep", "left")
    named = staged(named.select("digest", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "ngram-named")
    of = info.join(named, "digest", "left")
    return of.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their class, with all their columns."""
    others = near_duplicates(docs, id_col, text_col, count_links=False).where("component_id <> doc_id").select("doc_id")
    return without(docs, [F.col(id_col).cast("bigint")], others)
