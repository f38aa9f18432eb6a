"""What a task of the phrase query holds depends on a shard, not on the number of shards."""

import io
import random
from collections import Counter
from contextlib import redirect_stdout

import numpy as np
import pyarrow.parquet as pq

from tracegraph.llm import phrases
from tracegraph.llm.common import staged


def plan(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_longer_phrases_come_in_slices():
    rng = random.Random(3)
    ids = np.array([0, *[rng.choice([0, 1, 1, 2, 2, 3, 4]) for _ in range(400)], 0], dtype=np.int32)
    frequent = np.array([(a, b) for a in (1, 2, 3) for b in (1, 2, 3)])
    got, largest = Counter(), 0
    for p in phrases.longer(ids, frequent, rows=16):
        largest = max(largest, len(p.words))
        for w, n in zip(p.words.tolist(), p.size.tolist(), strict=True):
            got[tuple(w)] += n
    want = Counter(tuple(ids[i : i + k].tolist()) for k in (3, 4) for i in range(len(ids) - k + 1) if set(ids[i : i + k].tolist()) <= {1, 2, 3})
    assert got == want
    most = max(Counter(zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True)).values())
    assert largest <= max(16, most)
    assert list(phrases.longer(np.zeros(3, dtype=np.int32), frequent)) == []


def test_slices_and_portions_keep_all_in_order():
    size = np.array([3, 9, 1, 1, 20, 2])
    p = phrases.Phrases(np.arange(6)[:, None], size, np.arange(6), np.arange(6))
    assert [s.size.tolist() for s in phrases.slices(p, 10)] == [[3], [9, 1], [1], [20], [2]]
    assert list(phrases.portions(["ab", "c", "", "defg", "h"], 3)) == [["ab", "c"], ["", "defg"], ["h"]]


def test_no_list_of_a_shards_words_or_pairs_on_the_heap(spark):
    cut = spark.createDataFrame([], "shard long, tokens binary, langs array<string>, words array<string>, counts array<long>")
    coded = phrases.with_numbers(cut, spark.createDataFrame([], "lang string, word string, id long"))
    pairs = spark.createDataFrame([], "shard long, a binary, b binary, f binary")
    for df in (coded, phrases.longer_counts(coded, pairs, 1, False)):
        assert "collect_list" not in plan(df)


def test_row_groups_hold_few_large_rows(spark):
    rows = spark.range(12, numPartitions=1).selectExpr("id", "randstr(2000000, 1) AS text")
    files = staged(rows, "large-rows", phrases.ROW_GROUPS).inputFiles()
    meta = pq.ParquetFile(files[0].removeprefix("file:")).metadata
    assert meta.num_rows == 12 and max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 12 << 20
