"""Benchmark: trace the corpus rendered from ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and print one JSON line.

Measured per run, on a fresh trace (checkpoints are not reused across runs):

* ``extract_tags``   one pass over the text to the retained tag table;
* ``site_tag_join``  identity, site/tag join and coverers;
* ``rewrite``        coverage, diff, ids, actions and rewritten documents;
* ``trace_total``    the sum (the headline ``value``).

The corpus itself (rendering from the tables) is built once and reported as
``corpus_build``. Median of ``$BENCH_RUNS`` (default 5) after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tracegraph.plans.trace import trace  # noqa: E402
from tracegraph.session import get_session  # noqa: E402
from tracegraph.sources import corpus as CO  # noqa: E402


def one_run(spark, files, repos):
    r = trace(files, repos)
    t0 = time.time()
    r.tags.count()
    t1 = time.time()
    r.new_coverers.count()
    t2 = time.time()
    assert r.scan_ok and r.analyze_ok
    r.docs.count()
    t3 = time.time()
    return {"extract_tags": t1 - t0, "site_tag_join": t2 - t1, "rewrite": t3 - t2, "trace_total": t3 - t0}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = get_session(shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    spark.sparkContext.setLogLevel("ERROR")
    t = time.time()
    files = CO.corpus(spark, sf_dir)
    n_files = files.count()
    corpus_sec = time.time() - t
    total_bytes = files.agg(F.sum("length")).first()[0]
    repos = CO.repos(spark)
    one_run(spark, files, repos)  # warm-up
    samples = [one_run(spark, files, repos) for _ in range(runs)]
    med = {k: round(statistics.median(s[k] for s in samples), 3) for k in samples[0]}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(sf)
    except ValueError:
        pass
    out = {
        "metric": "trace_total_sec",
        "value": med["trace_total"],
        "unit": "sec",
        "queries": {**med, "corpus_build": round(corpus_sec, 3)},
        "sf": sf,
        "files": n_files,
        "bytes": total_bytes,
        # throughput of the text pass (tag extraction) and of the whole trace,
        "scan_files_per_sec": round(n_files / med["extract_tags"], 1),
        "scan_mb_per_sec": round(total_bytes / 1e6 / med["extract_tags"], 2),
        "trace_files_per_sec": round(n_files / med["trace_total"], 1),
        "runs": runs,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
