"""Folder trees as a ``files`` table: a distributed listing, and a Spark data source whose
partitions are planned by bytes.

1. ``list_tree`` lists folders level by level: the folders of a level are rows, tasks list
   them and give files and deeper folders. Every name is seen, also ``_x`` and ``.x``, which
   Spark's own file listing hides.
2. ``planned`` deals the listed files into parts of about ``split_bytes`` (a larger file is a
   part of its own), so that one folder with very many files becomes many tasks, and writes the
   listing by part below the shared checkpoint folder.
3. ``FolderSource`` reads: a partition per part, each opening its own listing and then its files
   in batches of bounded bytes. Comparisons of ``length`` and ``path`` are pushed into the
   listing, so that a file they exclude is never opened.

Paths go through ``pyarrow.fs``: folders on a shared mount or on any store that it knows.
"""

from __future__ import annotations

import operator
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from ..session import checkpoint_dir

LISTING = "root_ord int, repo_id string, root_path string, path string, rel_path string, length bigint"
SCHEMA = LISTING + ", content string, tracked boolean, decodable boolean"
#: bytes of files per partition, bytes of texts per batch, folder entries per batch
SPLIT_BYTES, BATCH_BYTES, PAGE = 64 << 20, 8 << 20, 1000


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _stage_path(spark: SparkSession, tag: str) -> str:
    return checkpoint_dir(spark).rstrip("/") + f"/tracegraph/{tag}-{uuid.uuid4().hex[:12]}"


def _list(dot_folders: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, folder = opened(row["path"])
                found = sorted(system.get_file_info(pafs.FileSelector(folder)), key=lambda x: x.base_name)
                for at in range(0, len(found), PAGE):
                    columns = [[] for _ in range(7)]
                    for x in found[at : at + PAGE]:
                        is_folder = x.type == pafs.FileType.Directory
                        if is_folder and not dot_folders and x.base_name.startswith("."):
                            continue
                        path = posixpath.join(row["path"], x.base_name)
                        rel = posixpath.join(row["rel_path"], x.base_name) if row["rel_path"] else x.base_name
                        for c, v in zip(columns, (row["root_ord"], row["repo_id"], row["root_path"], path, rel, x.size, is_folder), strict=True):
                            c.append(v)
                    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
                    names = [f.split()[0] for f in LISTING.split(", ")] + ["is_folder"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def list_tree(spark: SparkSession, roots: list[tuple[str, str]], dot_folders: bool = False) -> DataFrame:
    """Files below ``roots`` (folder, repository): the columns of ``LISTING``. Folders whose name
    starts with a dot, a root included, are left out with all they hold unless asked for."""
    start = []
    for i, (root, repo_id) in enumerate(roots):
        system, folder = opened(root)
        if system.get_file_info(folder).type != pafs.FileType.Directory:
            raise FileNotFoundError(f"no folder to read: {root}")
        if dot_folders or not posixpath.basename(root.rstrip("/")).startswith("."):
            start.append((i, repo_id, root.rstrip("/"), root.rstrip("/"), "", None))
    level = spark.createDataFrame(start, LISTING)
    found = spark.createDataFrame([], LISTING)
    while not level.isEmpty():
        path = _stage_path(spark, "listing")
        some = level.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
        some.mapInArrow(_list(dot_folders), LISTING + ", is_folder boolean").write.parquet(path)
        entries = spark.read.parquet(path)
        found = found.unionByName(entries.where("NOT is_folder").drop("is_folder"))
        level = entries.where("is_folder").drop("is_folder")
    return found


def planned(listing: DataFrame, split_bytes: int = SPLIT_BYTES) -> str:
    """Writes the listing by part and returns its path. The bytes of a part are at most
    ``split_bytes`` and one file: files are dealt by hash into buckets of about that many
    bytes, in which a running sum cuts parts."""
    total = listing.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first().b
    bucket = F.pmod(F.xxhash64("root_ord", "path"), F.lit(max(1, -(-total // split_bytes))))
    before = Window.partitionBy("_bucket").orderBy("path", "root_ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = listing.withColumn("_bucket", bucket)
    cut = F.floor(F.coalesce(F.sum("length").over(before), F.lit(0)) / split_bytes)
    path = _stage_path(listing.sparkSession, "manifest")
    placed = placed.withColumn("part", F.concat_ws("-", "_bucket", cut)).drop("_bucket")
    placed.repartition("part").write.partitionBy("part").parquet(path)
    return path


class Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


COMPARED = {
    EqualTo: operator.eq,
    GreaterThan: operator.gt,
    GreaterThanOrEqual: operator.ge,
    LessThan: operator.lt,
    LessThanOrEqual: operator.le,
    StringStartsWith: str.startswith,
    StringEndsWith: str.endswith,
    StringContains: str.__contains__,
}


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest = options["manifest"]
        self.max_bytes = int(options["max_bytes"]) if "max_bytes" in options else None
        self.pushed: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in COMPARED and f.attribute in (("length",), ("path",)):
                self.pushed.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        system, folder = opened(self.manifest)
        found = system.get_file_info(pafs.FileSelector(folder))
        return [Part(posixpath.join(self.manifest, x.base_name)) for x in found if x.base_name.startswith("part=")] or [Part("")]

    def wanted(self, row: dict) -> bool:
        return all(COMPARED[kind](row[name], value) for name, kind, value in self.pushed)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=k) for n, k in zip(names, kinds, strict=True)], names=names)

        rows, size = [], 0
        for row in listed(partition.path) if partition.path else []:
            if not self.wanted(row):
                continue
            row.update(content=None, tracked=True, decodable=True)
            if self.max_bytes is None or row["length"] <= self.max_bytes:
                system, path = opened(row["path"])
                with system.open_input_stream(path) as stream:
                    raw = stream.read()
                row["content"] = raw.decode("utf-8", errors="replace")
                row["decodable"] = row["content"].encode("utf-8") == raw
                size += len(raw)
            rows.append(row)
            if size >= BATCH_BYTES or len(rows) >= PAGE:
                yield batch(rows)
                rows, size = [], 0
        yield batch(rows)


def listed(folder: str) -> Iterator[dict]:
    """Rows of the listing of a part."""
    system, path = opened(folder)
    for x in system.get_file_info(pafs.FileSelector(path)):
        if x.base_name.endswith(".parquet"):
            with system.open_input_file(x.path) as f:
                for group in pq.ParquetFile(f).iter_batches(PAGE):
                    yield from group.to_pylist()


class FolderSource(DataSource):
    """Options: ``manifest`` (a folder that ``planned`` wrote), ``max_bytes`` (larger files are
    listed without their text)."""

    @classmethod
    def name(cls) -> str:
        return "tracegraph_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def read_tree(spark: SparkSession, roots: list[tuple[str, str]], max_bytes: int | None = None, dot_folders: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The files below ``roots`` as a ``files`` table. Files above ``max_bytes`` keep their length
    (for the statistics) but no text; ``decodable`` is false where bytes were no UTF-8 and had
    to be replaced. The listing is taken now, texts are read when the table is."""
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(FolderSource.name()).option("manifest", planned(list_tree(spark, roots, dot_folders), split_bytes))
    return (reader if max_bytes is None else reader.option("max_bytes", str(max_bytes))).load()


def write_tree(files: DataFrame, target: str) -> DataFrame:
    """Writes every file as ``target/{base name of its root}/{rel_path}`` in tasks and returns
    ``(root, n)``: the number of files per base name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for row in batch.to_pylist():
                base = posixpath.basename(row["root_path"].rstrip("/"))
                system, path = opened(posixpath.join(target, base, row["rel_path"]))
                system.create_dir(posixpath.dirname(path), recursive=True)
                # a task that is repeated writes the same bytes again
                with system.open_output_stream(path) as out:
                    out.write((row["content"] or "").encode("utf-8"))
                roots.append(base)
            yield pa.RecordBatch.from_arrays([pa.array(roots, type=pa.string())], names=["root"])

    rows = files.select("root_path", "rel_path", "content").mapInArrow(run, "root string")
    return rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
