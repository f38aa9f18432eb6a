"""Rows 1-10 and 23: file inventory, gates, repository URLs, scan statistics,
type registry, sinks and reports.

``files`` (the primary input) is a table, normally Parquet, with one row per
file under a root: ``(root_ord, repo_id, root_path, path, rel_path, length,
content[, tracked])``. Reading it with column pruning means the gates below run
on ``length`` and ``path`` without touching ``content``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import patterns as P
from ..functions import text as T
from ..functions.dialect import java_pattern
from ..session import checkpoint_dir
from .tree import read_tree  # noqa: F401 (row 1: folders as a files table)

FILES_SCHEMA = Ty.StructType(
    [
        Ty.StructField("root_ord", Ty.IntegerType()),
        Ty.StructField("repo_id", Ty.StringType()),
        Ty.StructField("root_path", Ty.StringType()),
        Ty.StructField("path", Ty.StringType()),
        Ty.StructField("rel_path", Ty.StringType()),
        Ty.StructField("length", Ty.LongType()),
        Ty.StructField("content", Ty.StringType()),
        Ty.StructField("tracked", Ty.BooleanType()),
    ]
)
REPOS_SCHEMA = Ty.StructType(
    [
        Ty.StructField("repo_id", Ty.StringType()),
        Ty.StructField("root", Ty.StringType()),
        Ty.StructField("remote_url", Ty.StringType()),
        Ty.StructField("has_main", Ty.BooleanType()),
        Ty.StructField("has_master", Ty.BooleanType()),
    ]
)


def file_inventory(*roots: DataFrame) -> DataFrame:
    """Row 1: files of several roots, in root order, without de-duplication
    (Q34). Each input is the file table of one root; ``root_ord`` is set to its
    position."""
    out = None
    for i, r in enumerate(roots):
        r = r.withColumn("root_ord", F.lit(i).cast("int"))
        out = r if out is None else out.unionByName(r)
    return out


def folder_segments(path="path", root_path="root_path"):
    """Base name of the root plus the folders between root and file."""
    rel = F.expr(f"substring({path}, char_length({root_path}) + 2)")
    segs = F.split(rel, "/", -1)
    folders = F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))
    root_base = F.element_at(F.split(F.col(root_path), "/", -1), -1)
    return F.concat(F.array(root_base), folders)


def in_dot_folder() -> F.Column:
    """Row 2 (Q3): a folder whose name starts with ``.`` (the root itself
    included) hides everything below it; dot *files* are kept."""
    return F.exists(folder_segments(), lambda s: s.startswith("."))


def dot_folder_prune(files: DataFrame) -> DataFrame:
    return files.filter(~in_dot_folder())


def size_gate(files: DataFrame, max_bytes: int) -> DataFrame:
    """Row 3 (Q1): keep files of at most ``max_bytes`` bytes (strictly larger
    ones are skipped). The predicate reaches the Parquet scan."""
    return files.filter(F.col("length") <= F.lit(max_bytes))


def extension_of(path="path") -> F.Column:
    """``filepath.Ext``: from the last dot of the base name, else empty."""
    base = F.element_at(F.split(F.col(path), "/", -1), -1)
    return F.regexp_extract(base, "(\\.[^.]*)\\z", 1)


def extension_filter(files: DataFrame, extensions: str | None = None) -> DataFrame:
    """Row 4 (Q2): keep ``.md`` and the listed extensions; the file's extension
    is lower-cased, the list is not."""
    return files.filter(extension_ok(extensions))


def extension_ok(extensions: str | None = None) -> F.Column:
    exts = P.parse_extensions(extensions)
    ext = F.lower(extension_of())
    return (ext == P.MARKDOWN_EXTENSION) | ext.isin(*exts)


def tracked_semi_join(files: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """Row 5 (Q4): keep files present in the HEAD tree of their repository,
    given either as a ``(repo_id, rel_path)`` table or a ``tracked`` column."""
    if tracked is not None:
        return files.join(tracked.select("repo_id", "rel_path"), ["repo_id", "rel_path"], "left_semi")
    if "tracked" in files.columns:
        return files.filter(F.coalesce(F.col("tracked"), F.lit(False)))
    return files


def content_blob_hash(files: DataFrame) -> DataFrame:
    """Row 6: git blob id of each file's content; of its raw bytes where the table has them
    (column ``raw``), as a decoded text may have lost some."""
    return files.withColumn("blob_hash", T.blob_hash("raw" if "raw" in files.columns else "content"))


def gated_inventory(files: DataFrame, tracked: DataFrame | None, extensions: str | None, max_bytes: int | None) -> DataFrame:
    """Rows 2-5 as flags, in the tool's order: dot folders are never visited;
    size (under a limit) decides skipped/processed; extension and tracking come after the
    processed count (Q1)."""
    f = dot_folder_prune(files)
    if tracked is not None:
        t = tracked.select("repo_id", "rel_path").dropDuplicates().withColumn("_t", F.lit(True))
        # the tracked list is a per-repository table: joined, never broadcast blindly
        f = f.join(t, ["repo_id", "rel_path"], "left").withColumn("is_tracked", F.coalesce("_t", F.lit(False))).drop("_t")
    elif "tracked" in files.columns:
        f = f.withColumn("is_tracked", F.coalesce(F.col("tracked"), F.lit(False)))
    else:
        f = f.withColumn("is_tracked", F.lit(True))
    processed = F.lit(True) if max_bytes is None else F.col("length") <= F.lit(max_bytes)
    return f.withColumn("processed", processed).withColumn(
        "scanned", processed & extension_ok(extensions) & F.col("is_tracked")
    )


def scan_stats(inv: DataFrame) -> DataFrame:
    """Row 8: processed and skipped files and bytes, with SI texts."""
    agg = inv.agg(
        F.count(F.when(F.col("processed"), 1)).alias("processed_files"),
        F.coalesce(F.sum(F.when(F.col("processed"), F.col("length"))), F.lit(0)).cast("bigint").alias("processed_bytes"),
        F.count(F.when(~F.col("processed"), 1)).alias("skipped_files"),
        F.coalesce(F.sum(F.when(~F.col("processed"), F.col("length"))), F.lit(0)).cast("bigint").alias("skipped_bytes"),
    )
    return agg.select(
        F.col("processed_files").cast("bigint"),
        "processed_bytes",
        T.si_bytes("processed_bytes").alias("processed_size"),
        F.col("skipped_files").cast("bigint"),
        "skipped_bytes",
        T.si_bytes("skipped_bytes").alias("skipped_size"),
    )


def repo_root_url(repos: DataFrame) -> DataFrame:
    """Row 7 (Q36): base URL of each repository from remote, provider and
    branch; ``url_error`` says why there is none. ``main`` is tried before
    ``master``; GitHub before GitLab; the remote is used verbatim."""
    branch = F.when(F.col("has_main"), F.lit(P.BRANCHES[0])).when(F.col("has_master"), F.lit(P.BRANCHES[1]))
    remote = F.col("remote_url")
    (gh, gh_path), (gl, gl_path) = P.PROVIDERS
    url = F.when(branch.isNull(), F.lit(None)).when(remote.contains(gh), F.concat(remote, F.lit(gh_path), branch)).when(
        remote.contains(gl), F.concat(remote, F.lit(gl_path), branch)
    )
    err = F.when(branch.isNull(), F.lit(P.MSG_NO_BRANCH)).when(
        ~remote.contains(gh) & ~remote.contains(gl), F.concat(F.lit(P.MSG_NO_PROVIDER), remote)
    )
    return repos.select("repo_id", url.alias("root_url"), err.alias("url_error"))


def type_registry(spark: SparkSession, text: str):
    """Row 23 (Q37): ``(identifier, order_no)`` per listed type, and the list. ``order_no`` is the
    position in the option text. All unusable entries are reported at once."""
    listed = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",", -1)).alias("order_no", "entry"))
    listed = listed.select(T.utrim("entry").alias("identifier"), "order_no").filter("identifier <> ''")
    times = F.count(F.lit(1)).over(Window.partitionBy("identifier"))
    # option text: as many rows as it has commas
    rows = listed.select("*", (T.is_ident("identifier") & (times == 1)).alias("usable")).orderBy("order_no").collect()
    bad = sorted({r.identifier for r in rows if not r.usable})
    if bad:
        raise ValueError(P.MSG_BAD_TYPES % ", ".join(bad))
    return spark.createDataFrame([(r.identifier, r.order_no) for r in rows], "identifier string, order_no int"), [r.identifier for r in rows]


def ignore_patterns(spark: SparkSession, patterns) -> tuple[str, ...]:
    """Ignore patterns as Java patterns; unusable ones fail up front."""
    found = []
    for p in patterns or ():
        try:
            found.append(java_pattern(p))
            spark.range(1).select(F.lit("").rlike(found[-1])).collect()
        except Exception as e:  # the engine wraps the syntax error of the pattern
            raise ValueError(f"invalid pattern '{p}': {e}") from None
    return tuple(found)


@dataclass
class SinkReport:
    """``written``: number of documents written; ``failed``: ``(path, apply_error)`` of the others."""

    written: int
    failed: DataFrame


DOC_COLS = ("path", "rel_path", "repo_id", "content")
MANIFEST_SCHEMA = "repo_id string, documents long, digest string, run long"


def docs_sink(docs: DataFrame, target: str, mode: str = "overwrite") -> SinkReport:
    """Row 9: write the changed documents that could be edited as a table (never in
    place), partitioned by repository when the documents carry ``repo_id``, and list the
    ones with an ``apply_error``: one bad document does not hold up the others.

    ``mode="incremental"`` compares each repository with the manifest of earlier runs and
    writes the partitions of those that differ; nothing, if none does. Read it by
    ``sink_documents``. One run at a time may write to a target."""
    failed = docs.filter(F.col("apply_error").isNotNull()).select("path", "apply_error")
    cols = [c for c in DOC_COLS if c in docs.columns]
    out = docs.filter(F.col("changed") & F.col("apply_error").isNull()).select(*cols)
    if mode == "incremental":
        return SinkReport(_write_changes(out, target), failed)
    written = out.count()
    w = out.write.mode(mode)
    if "repo_id" in cols:
        w = w.partitionBy("repo_id")
    w.parquet(target)
    return SinkReport(written, failed)


def _manifest(spark: SparkSession, target: str) -> DataFrame:
    """``(repo_id, documents, digest, run)`` of the last run that wrote each repository."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).parquet(target.rstrip("/") + "/_manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    last = rows.groupBy("repo_id").agg(F.max(F.struct("run", "documents", "digest")).alias("m"))
    return last.select("repo_id", "m.documents", "m.digest", "m.run")


def _write_changes(out: DataFrame, target: str) -> int:
    """Writes the partitions of the repositories that differ from the manifest. Their rows in
    it are opened (no digest) before and closed after, so that the next run repeats what a
    lost run has left open.

    A repository's digest is the sum of its documents' digests, so it needs no order and is
    pre-aggregated in the tasks that read them."""
    spark = out.sparkSession
    if "repo_id" not in out.columns:
        raise ValueError("the incremental sink is partitioned by repo_id")
    md5 = F.md5(F.concat(F.octet_length("path").cast("string"), F.lit(":"), "path", F.coalesce("content", F.lit(""))))
    half = lambda at: F.sum(F.conv(F.substring(md5, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    now = out.groupBy("repo_id").agg(F.count(F.lit(1)).alias("documents"), F.concat_ws("-", half(1), half(16)).alias("digest"))
    known = _manifest(spark, target).select(F.col("repo_id").alias("_repo"), F.col("digest").alias("_digest"), "run")
    both = now.join(known, F.col("repo_id").eqNullSafe(F.col("_repo")), "full_outer")
    differs = both.filter(~F.coalesce("digest", F.lit("")).eqNullSafe(F.coalesce("_digest", F.lit(""))))
    path = checkpoint_dir(spark).rstrip("/") + "/tracegraph/sink-" + uuid.uuid4().hex[:12]
    # one row per repository that is written; a repository without documents now is only noted
    differs.select(
        F.coalesce("repo_id", "_repo").alias("repo_id"),
        F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"),
        F.coalesce("digest", F.lit("")).alias("digest"),
        (F.coalesce("run", F.lit(0)) + 2).cast("bigint").alias("run"),
    ).write.parquet(path)
    changes = spark.read.schema(MANIFEST_SCHEMA).parquet(path)
    total = changes.agg(F.count(F.lit(1)).alias("repos"), F.sum("documents").alias("documents")).first()
    if not total["repos"]:
        return 0
    manifest = target.rstrip("/") + "/_manifest"
    opened = changes.withColumn("digest", F.lit("")).withColumn("run", F.col("run") - 1)
    opened.write.mode("append").parquet(manifest)
    if total["documents"]:
        due = changes.filter("documents > 0").select(F.col("repo_id").alias("_repo"))
        rows = out.join(due, F.col("repo_id").eqNullSafe(F.col("_repo")), "left_semi")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(target)
    changes.write.mode("append").parquet(manifest)
    return total["documents"]


def sink_documents(spark: SparkSession, target: str) -> DataFrame:
    """The documents of an incremental sink: those of repositories that, by the manifest, have
    any. (A repository that has none any more keeps its old partition, which nobody reads.)"""
    rows = spark.read.schema("path string, rel_path string, content string, repo_id string").parquet(target)
    live = _manifest(spark, target).filter("documents > 0").select(F.col("repo_id").alias("_repo"))
    return rows.join(live, F.col("repo_id").eqNullSafe(F.col("_repo")), "left_semi")


def action_report(actions: DataFrame) -> DataFrame:
    """Row 10 / 61: human-readable actions (dry run)."""
    return actions.select(
        "path",
        "seq",
        F.format_string("Action\n\t%s\n\t%s:%d\n\tRequirement: %s\n\tData: %s", "type", "path", "line_no", "name", "data").alias(
            "text"
        ),
    )
