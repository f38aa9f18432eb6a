"""Write PLANS.md: the physical plan skeleton of every trace stage (exchanges,
joins, windows, aggregates, scans with pushed filters and read schema), taken
from a real trace of the corpus rendered from ``sf_dir`` with AQE off so the
static plan is shown."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracegraph.operators import coverage as C  # noqa: E402
from tracegraph.operators import extract as X  # noqa: E402
from tracegraph.operators import lines as L  # noqa: E402
from tracegraph.operators import rewrite as R  # noqa: E402
from tracegraph.plans.trace import trace  # noqa: E402
from tracegraph.session import get_session  # noqa: E402
from tracegraph.sources import corpus as CO  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

KEEP = re.compile(r"(Exchange|Join|Window|HashAggregate|ObjectHashAggregate|SortAggregate|Scan parquet|Generate|BroadcastExchange)")


def skeleton(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.splitlines():
        if not KEEP.search(line):
            continue
        line = re.sub(r"#\d+", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        if "Scan parquet" in line:
            m = re.search(r"(PushedFilters: \[[^\]]*\])", line)
            rs = re.search(r"(ReadSchema: struct<[^>]*>)", line)
            line = line.split("Scan parquet")[0] + "Scan parquet " + " ".join(x.group(1) for x in (m, rs) if x)
        out.append(line[:220])
    return "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    spark.sparkContext.setLogLevel("ERROR")
    files = CO.corpus(spark, sf)
    r = trace(files, CO.repos(spark))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    stages = {
        "1 Markdown state (one pass over Markdown text, window by file)": L.markdown_state(r.md_candidates),
        "2 tag lines of source files (one pass over source text)": r.src_lines,
        "3 tags (retention without joins)": X.retained_tags(r.all_tags),
        "4 identities (partial aggregation + join)": C.identify(r.sites_p),
        "5 footnote match": r.registered.join(C.footnote_match(r.registered, r.footnotes), C.SITE_KEY, "left"),
        "6 new coverers (site/tag join)": C.new_coverers(r.registered, r.tags, r.repo_urls),
        "7 coverage (multiset diff, ids)": C.coverage(r.reg_m, r.new_coverers, r.current_coverers),
        "8 actions": C.actions(r.coverage_all, r.new_coverers),
        "9 rewritten documents": R.apply_actions(r.scanned.filter(F.col("kind") == "md").select("path", "content"), r.actions),
        "scan statistics (no content read)": r.stats,
    }
    parts = ["# PLANS — physical plan skeletons of the trace stages\n",
             "Generated by `python tools/plan_report.py` (AQE off, so the static plan shows). Each stage reads the",
             "previous stages' Parquet tables from the checkpoint folder. Only exchanges, joins, windows, aggregates",
             "and scans are kept.\n"]
    for name, df in stages.items():
        parts.append(f"## {name}\n\n```\n{skeleton(df)}\n```\n")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(parts))


if __name__ == "__main__":
    main()
