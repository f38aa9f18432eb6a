import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    b = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    s = b.getOrCreate()
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="tg-test-ckpt-", dir="/tmp")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s


U = "https://github.com/acme/shop/blob/main"


def make_files(spark, docs, root="/w/shop", repo="r1", root_ord=0, tracked=True):
    """``docs``: {rel_path: text}."""
    rows = []
    for rel, text in docs.items():
        rows.append((root_ord, repo, root, root + "/" + rel, rel, len(text.encode("utf-8")), text, tracked))
    from tracegraph.sources.inventory import FILES_SCHEMA

    return spark.createDataFrame(rows, FILES_SCHEMA)


def make_repos(spark, rows=None):
    from tracegraph.sources.inventory import REPOS_SCHEMA

    rows = rows or [("r1", "/w/shop", "https://github.com/acme/shop", True, False)]
    return spark.createDataFrame(rows, REPOS_SCHEMA)
