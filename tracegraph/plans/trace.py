"""``trace()``: the whole dataflow as one lazy plan per output.

files ─ gates ─ lines ─┬─ source lines ─ tags (map-side)
                       └─ Markdown candidate lines ─ window by file (shuffle 1)
                             ├─ header packages, fences, tags
                             └─ sites, footnotes, coverers
sites ─ identity by (package, name) ─ join tags by (package, name) (shuffle 2)
      ─ footnote match, ids, actions by file (shuffle 3) ─ rewrite

Stages are cut with tables written into the shared ``spark.checkpoint.dir``
(Parquet, one folder per run): Markdown and source text are each read **once** into
small tables, and every later output reads the entity, coverage and action tables
instead of re-reading the corpus (the rewrite reads Markdown again). This also keeps each plan small
for the optimizer and lets a lost executor recompute one stage, not the run.

Phase gates (Q35) are eager one-row checks evaluated when an analysis or rewrite output is
first asked for, before any of its stages: behind a closed gate stands an empty relation of
the stage's schema, and nothing of the stage is computed or written.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import coverage as C
from ..operators import extract as X
from ..operators import lines as L
from ..operators import rewrite as R
from ..operators import validate as V
from ..session import checkpoint_dir
from ..sources import inventory as I


@dataclass
class TraceOptions:
    extensions: str | None = None
    ignore_lines: tuple = ()
    types: str | None = None
    header_key: str = P.DEFAULT_HEADER_KEY
    max_bytes: int | None = None
    max_line_bytes: int | None = None
    long_bytes: int = L.LONG_BYTES
    chunk_lines: int = L.CHUNK_LINES
    chunk_chars: int = R.CHUNK_CHARS


@dataclass
class TraceResult:
    """Lazy outputs of one trace. DataFrames are built on first access."""

    files: DataFrame
    repos: DataFrame
    tracked: DataFrame | None = None
    options: TraceOptions = field(default_factory=TraceOptions)
    materialize: bool = True
    #: stages shared by traces under equal options: of the same files (with other repositories),
    #: and of the same source files (with other Markdown)
    of_files: dict = field(default_factory=dict)
    of_sources: dict = field(default_factory=dict)

    @cached_property
    def _run_dir(self) -> str:
        import uuid

        return checkpoint_dir(self.files.sparkSession).rstrip("/") + "/tracegraph/run-" + uuid.uuid4().hex[:12]

    def _stage(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Cut the lineage at a stage boundary: write the stage once as Parquet
        into the shared checkpoint folder and read it back (one computation,
        column pruning downstream, survives executor loss)."""
        if not self.materialize:
            return df
        name = name or sys._getframe(1).f_code.co_name
        path = self._run_dir + "/" + name
        sc = df.sparkSession.sparkContext
        sc.setJobDescription(f"tracegraph stage {name}")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            sc.setJobDescription(None)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _shared(self, stages: dict, name: str, make) -> DataFrame:
        if name not in stages:
            stages[name] = make()
        return stages[name]

    # ---------------------------------------------------------------- scan
    @cached_property
    def inventory(self) -> DataFrame:
        """Files under the roots with the gate columns (rows 1-5)."""
        return I.gated_inventory(self.files, self.tracked, self.options.extensions, self.options.max_bytes)

    @cached_property
    def stats(self) -> DataFrame:
        return I.scan_stats(self.inventory)

    @cached_property
    def skipped(self) -> DataFrame:
        """The files that a size limit left out; none without a limit."""
        return self.inventory.filter(~F.col("processed")).select("path", "length")

    @cached_property
    def scanned(self) -> DataFrame:
        """Files that pass every gate, with their kind (rows 3-5, 13)."""
        return L.file_kind(self.inventory.filter("scanned"))

    @cached_property
    def repo_urls(self) -> DataFrame:
        """Row 7: one row per repository. Staged, so that its size in bytes is known where
        it is joined: a small list is broadcast and tags do not move by ``repo_id``."""
        return self._stage(I.repo_root_url(self.repos))

    @cached_property
    def lines(self) -> DataFrame:
        """Row 11-12: numbered, non-ignored lines with candidate flags (lazy;
        the trace itself reads ``md_candidates`` and ``src_lines``)."""
        return L.candidate_flags(self._exploded(self.scanned), self.options.header_key)

    def _exploded(self, files: DataFrame, keep_long: bool = False) -> DataFrame:
        return L.line_explode(files, self.options.ignore_lines, keep_long, self.options.max_line_bytes)

    @cached_property
    def md_candidates(self) -> DataFrame:
        """Candidate lines of the Markdown files plus overlong-line markers (one pass over
        the Markdown text)."""
        return self._candidates(self._markdown)

    @cached_property
    def _markdown(self) -> DataFrame:
        return self.scanned.filter(F.col("kind") == "md")

    def _candidates(self, files: DataFrame) -> DataFrame:
        ex = self._exploded(files, keep_long=True)
        c = L.candidate_flags(ex, self.options.header_key)
        return c.filter(F.col("is_cand") | F.col("is_long"))

    @cached_property
    def src_lines(self) -> DataFrame:
        """Lines with tags of the source files (one pass over the source text); a file
        without the opening of a tag is dropped whole before it is cut into lines."""
        src = self.scanned.filter((F.col("kind") == "src") & F.col("content").contains("[~"))
        return self._exploded(src).filter(F.col("line").contains("[~"))

    @cached_property
    def md_state(self) -> DataFrame:
        """Stage 2: Markdown candidate lines with fence and header state and
        the per-file facts (package, ignored, has a site, fence pairing). Files of more than
        ``long_bytes`` are computed in chunks of lines, if there are any."""
        return self._shared(self.of_files, "md_state", self._md_state)

    def _md_state(self) -> DataFrame:
        key = self.options.header_key
        if not self._has_long:
            return self._stage(L.markdown_state(self.md_candidates, key), "md_state")
        short, long = (self._candidates(files) for files in self._by_length(self._markdown))
        chunked = L.segmented_state(long, key, self.options.chunk_lines, self._stage)
        return self._stage(L.markdown_state(short, key).unionByName(chunked), "md_state")

    @cached_property
    def _has_long(self) -> bool:
        return not self._by_length(L.file_kind(self.files).filter(F.col("kind") == "md"))[1].isEmpty()

    def _by_length(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The files of at most and of more than ``long_bytes``."""
        long = F.coalesce(F.col("length") > self.options.long_bytes, F.lit(False))
        return files.filter(~long), files.filter(long)

    @cached_property
    def pkg_lines(self) -> DataFrame:
        return L.package_lines(self.md_state)

    @cached_property
    def file_pkgs(self) -> DataFrame:
        """Rows 16-17: package and ignored flag of Markdown files with a package line."""
        return L.package_of_file(self.md_state)

    @cached_property
    def ignored_files(self) -> DataFrame:
        return self.md_state.filter("file_ignored").select(*L.FILE_KEY).distinct()

    @cached_property
    def all_tags(self) -> DataFrame:
        """Row 18 over every scanned file (before retention), with the
        per-file flags the retention rule needs."""
        src = self.src_lines.withColumn("file_has_site", F.lit(True)).withColumn("file_ignored", F.lit(False))
        cols = L.FILE_COLS + ["kind", "line_no", "line", *self._FLAGS]
        return X.extract_tags(src.select(*cols).unionByName(self._md_lines.select(*cols)), extra=self._FLAGS)

    _FLAGS = ("file_has_site", "file_ignored")

    @property
    def _md_lines(self) -> DataFrame:
        return self.md_state.filter(~F.col("in_code") & ~F.col("is_long"))

    @cached_property
    def records(self) -> DataFrame:
        return X.record_lines(self.md_state)

    @cached_property
    def site_cands(self) -> DataFrame:
        # map-only over the staged Markdown state: recomputed, not written
        return X.site_candidates(self.records)

    @cached_property
    def sites(self) -> DataFrame:
        """Row 19 (files with an ignored package are already left out)."""
        return X.extract_sites(self.site_cands)

    @cached_property
    def fn_lines(self) -> DataFrame:
        return X.footnote_lines(self.records)

    @cached_property
    def footnotes(self) -> DataFrame:
        return X.extract_footnotes(self.fn_lines)

    @cached_property
    def raw_coverers(self) -> DataFrame:
        return self._shared(self.of_files, "raw_coverers", lambda: self._stage(X.raw_coverers(self.fn_lines), "raw_coverers"))

    @cached_property
    def coverers(self) -> DataFrame:
        return X.extract_coverers(self.raw_coverers)

    @cached_property
    def tags(self) -> DataFrame:
        """Row 24 applied: tags of retained files (Q5), minus ignored files. Those of source
        files, which always keep their file, are a stage of their own."""
        md = X.extract_tags(self._md_lines, extra=self._FLAGS)
        return self.src_tags.unionByName(self._stage(X.retained_tags(md), "tags"))

    @cached_property
    def src_tags(self) -> DataFrame:
        return self._shared(self.of_sources, "src_tags", lambda: self._stage(X.extract_tags(self.src_lines), "src_tags"))

    @cached_property
    def types(self):
        if self.options.types is None or self.options.types == "":
            return None, None
        spark = self.files.sparkSession
        return I.type_registry(spark, self.options.types)

    @cached_property
    def scan_errors(self) -> DataFrame:
        """Rows 25-32 minus files with an ignored package (Q12)."""
        parts = [
            V.err_pkgident(self.pkg_lines),
            V.site_errors(self.site_cands, self.types[1]),
            V.err_urlsyntax(self.raw_coverers),
            V.err_unmatchedfence(L.unmatched_fences(self.md_state)),
        ]
        if self.options.max_line_bytes is not None:
            src = L.long_lines(self.scanned.filter(F.col("kind") == "src"), self.options.max_line_bytes)
            parts += [L.read_errors(src), L.read_errors(self.md_state.filter(~F.col("file_ignored")))]
        parts.append(V.err_repository(self.inventory, self.repo_urls))
        # the gate and the report read the same rows: found once
        return self._stage(V.union_errors(parts))

    # ------------------------------------------------------------- analyze
    @cached_property
    def sites_p(self) -> DataFrame:
        """Sites with the package of their file (carried from the Markdown state)."""
        return self.sites

    @cached_property
    def ident(self) -> DataFrame:
        return self._stage(C.identify(self.sites_p))

    @cached_property
    def registered(self) -> DataFrame:
        return self.ident.filter("is_first").drop("first", "is_first")

    @cached_property
    def fmatch(self) -> DataFrame:
        return C.footnote_match(self.registered, self.footnotes)

    @cached_property
    def reg_m(self) -> DataFrame:
        return self._stage(self.registered.join(self.fmatch, C.SITE_KEY, "left"))

    @cached_property
    def new_coverers(self) -> DataFrame:
        # staged without the texts that follow from the other columns
        rows = C.new_coverers(self.registered, self.tags, self.repo_urls).select(*C.COVERER_COLS)
        return C.linked(self._stage(rows, "new_coverers"))

    @cached_property
    def ranked_coverers(self) -> DataFrame:
        """Rows 40-41: numbered coverer rows of every registered requirement."""
        return C.ranked_coverers(self.new_coverers)

    @cached_property
    def current_coverers(self) -> DataFrame:
        return C.current_coverers(self.reg_m, self.coverers)

    @cached_property
    def semantic_errors(self) -> DataFrame:
        parts = [
            C.err_nopkgidreqs(self.sites_p, self.options.header_key),
            C.err_dupreqid(self.ident),
            C.err_pkgmismatch(self.reg_m, self.footnotes),
        ]
        return self._stage(V.union_errors(parts))

    @cached_property
    def coverage_all(self) -> DataFrame:
        """Coverage before the phase gate."""
        return self._stage(C.coverage(self.reg_m, self.new_coverers, self.current_coverers))

    @cached_property
    def actions_all(self) -> DataFrame:
        return self._stage(C.actions(self.coverage_all, self.new_coverers))

    # --------------------------------------------------------------- gates
    @cached_property
    def scan_ok(self) -> bool:
        return not V.has_rows(self.scan_errors)

    @cached_property
    def analyze_ok(self) -> bool:
        return self.scan_ok and not V.has_rows(self.semantic_errors)

    @cached_property
    def errors(self) -> DataFrame:
        """Syntax errors if any, else semantic errors (Q35)."""
        return self.scan_errors if not self.scan_ok else self.semantic_errors

    def _nothing(self, schema) -> DataFrame:
        """A closed gate: the stage's schema without the stage."""
        return self.files.sparkSession.createDataFrame([], schema)

    @cached_property
    def coverage(self) -> DataFrame:
        return self.coverage_all if self.scan_ok else self._nothing(C.COVERAGE_SCHEMA)

    @cached_property
    def coverage_by_type(self) -> DataFrame:
        """Row 23: rollup of the coverage by package and type, types in registry order."""
        return C.coverage_by_type(self.coverage, self.types[0])

    @cached_property
    def actions(self) -> DataFrame:
        return self.actions_all if self.analyze_ok else self._nothing(C.ACTIONS_SCHEMA)

    @cached_property
    def docs(self) -> DataFrame:
        """Rewritten Markdown documents (rows 54-60); empty when gated."""
        if not self.analyze_ok:
            return self._nothing("path string, repo_id string, rel_path string, content string, changed boolean, apply_error string")
        cols = ["path", "repo_id", "rel_path", "content", *[c for c in ("decodable",) if c in self.files.columns]]
        if not self._has_long:
            return self._stage(R.apply_actions(self._markdown.select(*cols), self.actions))
        short, long = (files.select(*cols) for files in self._by_length(self._markdown))
        chunked = R.apply_actions_chunked(long, self.actions, self.options.chunk_chars, self._stage)
        return self._stage(R.apply_actions(short, self.actions).unionByName(chunked), "docs")


def trace(files: DataFrame, repos: DataFrame, *, tracked: DataFrame | None = None, extensions: str | None = None,
          ignore_lines=(), types: str | None = None, header_key: str = P.DEFAULT_HEADER_KEY,
          max_bytes: int | None = None, max_line_bytes: int | None = None, long_bytes: int = L.LONG_BYTES,
          chunk_lines: int = L.CHUNK_LINES, chunk_chars: int = R.CHUNK_CHARS, materialize: bool = True) -> TraceResult:
    """Trace requirements of a corpus.

    ``files``: ``(root_ord, repo_id, root_path, path, rel_path, length, content[, tracked])``;
    ``repos``: ``(repo_id, root, remote_url, has_main, has_master)``;
    ``tracked``: optional ``(repo_id, rel_path)`` table (else the ``tracked``
    column, else every file is tracked). Whole files and lines are read; ``max_bytes``
    and ``max_line_bytes`` set the original tool's limits when wanted. The state of Markdown
    files of more than ``long_bytes`` is computed in chunks of ``chunk_lines`` lines, and they are
    rewritten in chunks of ``chunk_chars`` code points."""
    opts = TraceOptions(extensions, I.ignore_patterns(files.sparkSession, ignore_lines), types, header_key, max_bytes, max_line_bytes, long_bytes, chunk_lines, chunk_chars)
    return TraceResult(files, repos, tracked, opts, materialize)


@dataclass
class AnalysisResult:
    errors: DataFrame
    coverage: DataFrame
    actions: DataFrame


def analyze(sites: DataFrame, footnotes: DataFrame, coverers: DataFrame, tags: DataFrame, repos: DataFrame) -> AnalysisResult:
    """Entry C: analysis of prepared entity tables, without any text.

    ``sites``: ``(root_ord, repo_id, path, rel_path, line_no, package, name,
    footnote_id, status_word, emoji, annotated)`` (``package`` is the file's);
    ``footnotes``: ``(root_ord, path, line_no, footnote_id, package)``;
    ``coverers``: ``(root_ord, path, line_no, cov_ord, label, url)``;
    ``tags``: ``(root_ord, repo_id, path, rel_path, line_no, package, name, cov_type)``.
    Outputs are lazy; ``actions`` is empty when there are semantic errors."""
    file_pkg = sites.select(*L.FILE_KEY, F.col("package").alias("file_package")).dropDuplicates(L.FILE_KEY)
    fns = footnotes.join(file_pkg, L.FILE_KEY)
    run = TraceResult(sites, repos)
    max_ids = C.max_footnote_id(sites.filter(F.col("package") != ""), fns).withColumnRenamed("max_id", "file_max_id")
    ident = run._stage(C.identify(sites.join(max_ids, L.FILE_KEY, "left")), "ident")
    reg = ident.filter("is_first").drop("first", "is_first")
    reg_m = run._stage(reg.join(C.footnote_match(reg, fns), C.SITE_KEY, "left"), "reg_m")
    new = C.linked(run._stage(C.new_coverers(reg, tags, run.repo_urls).select(*C.COVERER_COLS), "new_coverers"))
    cur = C.current_coverers(reg_m, coverers)
    errors = V.union_errors(
        [V.err_repository(tags.withColumn("root_path", F.col("repo_id")), run.repo_urls), C.err_nopkgidreqs(sites, P.DEFAULT_HEADER_KEY), C.err_dupreqid(ident), C.err_pkgmismatch(reg_m, fns)]
    )
    cov = run._stage(C.coverage(reg_m, new, cur), "coverage")
    acts = C.actions(cov, new)
    return AnalysisResult(errors, cov, acts if not V.has_rows(errors) else acts.limit(0))
