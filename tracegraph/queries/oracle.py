"""DuckDB oracle SQL: the answer of each registered query derived from the
base tables (``part``, ``lineitem``, ``documents``, ``labels``) by the rendering
rules of ``sources/corpus.py``, without parsing any rendered text.

All integers are BIGINT and every computed column is aliased to the name the
Spark query uses."""

from __future__ import annotations

from ..functions import patterns as P

GH_URL = "https://github.com/tpch/supply/blob/main"
GL_URL = "https://gitlab.com/tpch/supply/-/blob/master"
KEY = P.DEFAULT_HEADER_KEY

TYPE_OF = "(CASE {k} % 3 WHEN 0 THEN 'it' WHEN 1 THEN 'cmp' ELSE 'utest' END)"

BASE = f"""
o_req AS (
  SELECT p_partkey AS p, p_size,
    {TYPE_OF.format(k='p_partkey')} || '.p' || CAST(p_partkey AS VARCHAR) AS name,
    (CASE WHEN p_size = 50 THEN 'ignoreme.pkg' ELSE 'pkg' END) || CAST(p_partkey % 7 AS VARCHAR) AS package,
    'docs/pkg' || CAST(p_partkey % 7 AS VARCHAR) || '/s' || CAST(p_size AS VARCHAR) || '/c'
      || CAST(p_partkey // 7000 AS VARCHAR) || '.md' AS rel_path,
    CAST((p_partkey // 21) % 5 AS BIGINT) AS variant
  FROM part),
o_reqn AS (
  SELECT *, '/corpus/gh/' || rel_path AS path,
    row_number() OVER (PARTITION BY rel_path ORDER BY p) AS rn,
    count(*) OVER (PARTITION BY rel_path) AS k,
    sum(CASE WHEN variant IN (1, 2, 3) THEN 1 ELSE 0 END)
      OVER (PARTITION BY rel_path ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS j,
    sum(CASE WHEN variant IN (1, 2, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY rel_path) AS m
  FROM o_req),
o_li AS (
  SELECT l_suppkey AS supp, l_orderkey, l_linenumber, l_partkey,
    CASE l_returnflag WHEN 'A' THEN 'impl' WHEN 'R' THEN 'test' ELSE 'doc' END AS cov_type
  FROM lineitem),
o_tg AS (
  SELECT *, row_number() OVER (PARTITION BY supp ORDER BY l_orderkey, l_linenumber, l_partkey, cov_type) AS r
  FROM o_li),
o_tag AS (
  SELECT l_partkey, l_orderkey, l_linenumber, cov_type, supp,
    CASE WHEN l_partkey % 4 = 0 THEN 'retired' ELSE 'pkg' || CAST(l_partkey % 7 AS VARCHAR) END AS package,
    {TYPE_OF.format(k='l_partkey')} || '.p' || CAST(l_partkey AS VARCHAR) AS name,
    'src/s' || CAST(supp AS VARCHAR) || '/c' || CAST((r - 1) // 1000 AS VARCHAR) || '.go' AS rel_path,
    CAST(2 * ((r - 1) % 1000 + 1) AS BIGINT) AS line_no,
    CASE WHEN supp % 2 = 0 THEN '/corpus/gh/' ELSE '/corpus/gl/' END AS root_dir,
    CASE WHEN supp % 2 = 0 THEN '{GH_URL}' ELSE '{GL_URL}' END AS root_url
  FROM o_tg),
o_site AS (
  SELECT *, CAST(4 + 2 * rn AS BIGINT) AS line_no,
    CASE WHEN variant IN (1, 2, 3) THEN CAST(5 + 2 * k + j AS BIGINT) END AS fn_line,
    CASE WHEN variant = 0 THEN '' ELSE CAST(rn AS VARCHAR) END AS footnote_id,
    CASE variant WHEN 0 THEN '' WHEN 1 THEN 'uncvrd' WHEN 4 THEN 'uncvrd' WHEN 2 THEN 'covrd' ELSE 'covered' END AS status_word,
    CASE variant WHEN 0 THEN '' WHEN 1 THEN '❓' WHEN 4 THEN '❓' ELSE '✅' END AS emoji
  FROM o_reqn WHERE p_size <> 50),
o_cov AS (
  SELECT s.package, s.name, s.path AS site_path, s.line_no AS site_line, t.root_dir || t.rel_path AS tag_path,
    t.cov_type, t.rel_path AS file, t.line_no,
    t.root_url || '/' || t.rel_path || '#L' || CAST(t.line_no AS VARCHAR) AS url,
    t.rel_path || ':' || CAST(t.line_no AS VARCHAR) || ':' || t.cov_type AS label
  FROM o_site s JOIN o_tag t ON s.package = t.package AND s.name = t.name),
o_covtext AS (
  SELECT package, name, count(*) AS n,
    string_agg('[' || label || '](' || url || ')', ', ' ORDER BY cov_type, file, line_no, url) AS cov_text
  FROM o_cov GROUP BY package, name),
o_truecov AS (
  SELECT t.l_partkey AS p,
    string_agg('[' || t.rel_path || ':' || CAST(t.line_no AS VARCHAR) || ':' || t.cov_type || '](' || t.root_url || '/'
      || t.rel_path || '#L' || CAST(t.line_no AS VARCHAR) || ')', ', '
      ORDER BY t.cov_type, t.rel_path, t.line_no, t.root_url || '/' || t.rel_path || '#L' || CAST(t.line_no AS VARCHAR)) AS cov_text
  FROM o_tag t WHERE t.package <> 'retired' GROUP BY t.l_partkey),
o_stat AS (
  SELECT s.*, CAST(coalesce(c.n, 0) AS BIGINT) AS n_cov, coalesce(c.cov_text, '') AS cov_text,
    CASE WHEN coalesce(c.n, 0) > 0 THEN 'covrd' ELSE 'uncvrd' END AS status,
    max(CASE WHEN s.variant <> 0 THEN s.rn ELSE 0 END) OVER (PARTITION BY s.rel_path) AS max_id
  FROM o_site s LEFT JOIN o_covtext c ON s.package = c.package AND s.name = c.name),
o_fid AS (
  SELECT *,
    CASE WHEN variant = 0 THEN CAST(max_id + row_number() OVER (PARTITION BY rel_path, variant = 0 ORDER BY rn) AS VARCHAR)
         ELSE footnote_id END AS new_fid,
    variant IN (0, 4) OR variant = 3 OR (variant = 1 AND n_cov > 0) AS needs_fn,
    variant = 0 OR (variant IN (1, 4) AND n_cov > 0) OR (variant = 2 AND n_cov = 0) OR variant = 3 AS needs_site
  FROM o_stat),
o_fmt AS (
  SELECT *,
    '`~' || name || '~`' || status || '[^' || new_fid || ']' || (CASE WHEN status = 'covrd' THEN '✅' ELSE '❓' END) AS site_data,
    '[^' || new_fid || ']: `[~' || package || '/' || name || '~impl]`' || (CASE WHEN n_cov > 0 THEN ' ' || cov_text ELSE '' END) AS fn_data
  FROM o_fid),
o_act AS (
  SELECT path, 'Site' AS type, line_no AS site_line, 0 AS ord, line_no, name, site_data AS data FROM o_fmt WHERE needs_site
  UNION ALL
  SELECT path, 'Footnote' AS type, line_no AS site_line, 1 AS ord,
    CAST(CASE WHEN variant IN (1, 3) THEN fn_line ELSE 0 END AS BIGINT) AS line_no, name, fn_data AS data
  FROM o_fmt WHERE needs_fn),
o_actions AS (
  SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY site_line, ord) AS BIGINT) AS seq, type, line_no, name, data
  FROM o_act),
o_docline AS (
  SELECT r.path, r.rel_path, CAST(3 + 2 * r.rn AS BIGINT) AS line_no,
    'The part p' || CAST(r.p AS VARCHAR) || ' has size ' || CAST(r.p_size AS VARCHAR) || '.' AS text
  FROM o_reqn r
  UNION ALL
  SELECT r.path, r.rel_path, CAST(4 + 2 * r.rn AS BIGINT),
    '- `~' || r.name || '~`' || (CASE r.variant WHEN 0 THEN '' WHEN 1 THEN 'uncvrd[^' || CAST(r.rn AS VARCHAR) || ']❓'
      WHEN 4 THEN 'uncvrd[^' || CAST(r.rn AS VARCHAR) || ']❓' WHEN 2 THEN 'covrd[^' || CAST(r.rn AS VARCHAR) || ']✅'
      ELSE 'covered[^' || CAST(r.rn AS VARCHAR) || ']✅' END) || ' shall hold.'
  FROM o_reqn r
  UNION ALL
  SELECT r.path, r.rel_path, CAST(5 + 2 * r.k + r.j AS BIGINT),
    '[^' || CAST(r.rn AS VARCHAR) || ']: `[~' || r.package || '/' || r.name || '~impl]`'
      || (CASE r.variant WHEN 1 THEN '' WHEN 2 THEN coalesce(' ' || tc.cov_text, '')
          ELSE ' [docs/stale.md:1:impl]({GH_URL}/docs/stale.md#L1)' END)
  FROM o_reqn r LEFT JOIN o_truecov tc ON r.p = tc.p WHERE r.variant IN (1, 2, 3)
  UNION ALL
  SELECT r.path, r.rel_path,
    CAST(CASE WHEN v.off <= 4 THEN v.off WHEN v.off = 5 THEN 5 + 2 * r.k ELSE 5 + 2 * r.k + r.m + (v.off - 5) END AS BIGINT),
    replace(replace(v.t, '{{PKG}}', r.package), '{{NAME}}', r.name)
  FROM o_reqn r, (VALUES
      (1, '---'), (2, '{KEY}: {{PKG}}'), (3, '---'), (4, ''), (5, ''), (6, ''), (7, '```text'),
      (8, '- `~{{NAME}}~` quoted in code.'), (9, '// [~{{PKG}}/{{NAME}}~impl] inside code'), (10, '```'),
      (11, 'Quoted tag `[~{{PKG}}/{{NAME}}~test]` is prose.'), (12, '[~{{PKG}}/{{NAME}}~test] at column zero.')) v(off, t)
  WHERE r.rn = 1),
o_srcline AS (
  SELECT root_dir || rel_path AS path, rel_path, line_no - 1 AS line_no,
    '// order ' || CAST(l_orderkey AS VARCHAR) || ' line ' || CAST(l_linenumber AS VARCHAR) AS text FROM o_tag
  UNION ALL
  SELECT root_dir || rel_path, rel_path, line_no, '// covers [~' || package || '/' || name || '~' || cov_type || ']' FROM o_tag),
o_note AS (
  SELECT d.doc_id, d.text AS content,
    'notes/' || (CASE WHEN d.source LIKE '%3' THEN '.' || d.source ELSE d.source END) || '/' || d.lang || '/d'
      || CAST(d.doc_id AS VARCHAR)
      || (CASE d.lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.PY' WHEN 'es' THEN '.yaml' ELSE '.txt' END) AS rel_path,
    d.source LIKE '%3' AS dotted, l.doc_id IS NOT NULL AS tracked,
    d.lang IN ('en', 'fr', 'es') AS ext_ok, CAST(strlen(d.text) AS BIGINT) AS length
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
o_files AS (
  SELECT CAST(0 AS BIGINT) AS root_ord, '/corpus/gh/' || rel_path AS path, rel_path,
    string_agg(text, chr(10) ORDER BY line_no) || chr(10) AS content, FALSE AS dotted, TRUE AS tracked, TRUE AS ext_ok,
    CASE WHEN rel_path LIKE 'docs/%' THEN 'md' ELSE 'src' END AS kind
  FROM (SELECT rel_path, line_no, text FROM o_docline UNION ALL SELECT rel_path, line_no, text FROM o_srcline
        WHERE path LIKE '/corpus/gh/%') GROUP BY rel_path
  UNION ALL
  SELECT CAST(1 AS BIGINT), '/corpus/gl/' || rel_path, rel_path, string_agg(text, chr(10) ORDER BY line_no) || chr(10),
    FALSE, TRUE, TRUE, 'src'
  FROM o_srcline WHERE path LIKE '/corpus/gl/%' GROUP BY rel_path
  UNION ALL
  SELECT CAST(0 AS BIGINT), '/corpus/gh/' || rel_path, rel_path, content, dotted, tracked, ext_ok,
    CASE WHEN rel_path LIKE '%.md' THEN 'md' ELSE 'src' END
  FROM o_note),
o_scanned AS (
  SELECT *, CAST(strlen(content) AS BIGINT) AS length FROM o_files
  WHERE NOT dotted AND ext_ok AND tracked),
o_lines AS (
  SELECT path, rel_path, kind, CAST(i AS BIGINT) AS line_no, parts[i] AS line
  FROM (SELECT path, rel_path, kind, string_split(content, chr(10)) AS parts FROM o_files),
       generate_series(1, len(parts)) t(i)
  WHERE NOT (i = len(parts) AND parts[i] = '')),
o_newdoc AS (
  SELECT l.path, l.line_no,
    coalesce(a_fn.data, CASE WHEN a_s.data IS NOT NULL THEN '- ' || a_s.data || ' shall hold.' END, l.text) AS text
  FROM o_docline l
  LEFT JOIN o_actions a_s ON a_s.path = l.path AND a_s.line_no = l.line_no AND a_s.type = 'Site'
  LEFT JOIN o_actions a_fn ON a_fn.path = l.path AND a_fn.line_no = l.line_no AND a_fn.type = 'Footnote'
  WHERE l.path IN (SELECT path FROM o_actions)
  UNION ALL
  SELECT a.path, b.last_line + 1, ''
  FROM (SELECT DISTINCT path FROM o_actions WHERE line_no = 0) a
  JOIN (SELECT path, max(line_no) AS last_line FROM o_docline GROUP BY path) b ON a.path = b.path
  UNION ALL
  SELECT a.path, b.last_line + 1 + row_number() OVER (PARTITION BY a.path ORDER BY a.seq), a.data
  FROM o_actions a JOIN (SELECT path, max(line_no) AS last_line FROM o_docline GROUP BY path) b ON a.path = b.path
  WHERE a.line_no = 0),
o_docs AS (
  SELECT path, string_agg(text, chr(10) ORDER BY line_no) || chr(10) AS content FROM o_newdoc GROUP BY path),
o_fault AS (
  SELECT r.*, r.p_size % 10 AS fk, CAST(5 + 2 * r.k + r.m + 8 AS BIGINT) AS at_line, CAST(r.p AS VARCHAR) AS ps
  FROM o_reqn r WHERE r.rn = 1 AND r.p_size <> 50),
o_synerr AS (
  SELECT 'scan' AS phase, path, CAST(2 AS BIGINT) AS line_no, 'pkgident' AS code,
    'PackageId shall be an identifier: 1' || package AS message FROM o_fault WHERE fk = 1
  UNION ALL SELECT 'scan', path, at_line, 'reqident', 'RequirementName shall be an identifier' FROM o_fault WHERE fk = 2
  UNION ALL SELECT 'scan', path, at_line, 'reqtype', 'requirement type must be one of [it cmp utest]: 1bad.p' || ps
    FROM o_fault WHERE fk = 2
  UNION ALL SELECT 'scan', path, at_line, 'covstatus', 'CoverageStatusWord shall be ''covered'' or ''uncvrd'': maybe'
    FROM o_fault WHERE fk = 3
  UNION ALL SELECT 'scan', path, at_line, 'covstatus', 'CoverageStatusWord shall be ''covered'' or ''uncvrd'': '
    FROM o_fault WHERE fk = 4
  UNION ALL SELECT 'scan', path, at_line, 'urlsyntax',
    'the URL provided is invalid: parse "::a' || ps || '": missing protocol scheme: ::a' || ps FROM o_fault WHERE fk = 5
  UNION ALL SELECT 'scan', path, at_line, 'urlsyntax',
    'the URL provided is invalid: parse "http://h st/b' || ps || '": invalid user, host or port: http://h st/b' || ps
    FROM o_fault WHERE fk = 5
  UNION ALL SELECT 'scan', path, at_line, 'multisites',
    'only one RequirementSite is allowed per line: `~it.m' || ps || '~`,  `~it.n' || ps || '~`' FROM o_fault WHERE fk = 6
  UNION ALL SELECT 'scan', path, at_line, 'unmatchedfence',
    'opening code block fence at line ' || CAST(at_line AS VARCHAR) || ' has no matching closing fence' FROM o_fault WHERE fk = 7
  UNION ALL SELECT 'scan', path, at_line, 'reqtype', 'requirement type must be one of [it cmp utest]: sys.t' || ps
    FROM o_fault WHERE fk = 8
  UNION ALL SELECT 'scan', path, CAST(0 AS BIGINT), '', 'Error reading file: token too long' FROM o_fault WHERE fk = 9),
o_semerr AS (
  SELECT 'analyze' AS phase, f.path, f.at_line AS line_no, 'pkgmismatch' AS code,
    'CoverageFootnote package (other) is not consistent with PackageId in the header (' || f.package || ')' AS message
  FROM o_fault f JOIN o_site s ON s.path = f.path WHERE f.fk IN (1, 2, 3) AND s.variant IN (0, 4)
  UNION ALL
  SELECT 'analyze', path, CAST(6 AS BIGINT), 'dupreqid',
    'duplicate RequirementId detected:' || chr(10) || chr(9) || package || '/' || name || chr(10) || chr(9) || path || ':'
      || CAST(at_line AS VARCHAR)
  FROM o_fault WHERE fk IN (4, 5, 6)
  UNION ALL
  SELECT 'analyze', path, CAST(6 AS BIGINT), 'nopkgidreqs', 'markdown file with RequirementSites shall define {KEY}'
  FROM o_fault WHERE fk IN (7, 8, 9))
"""


def q(select: str) -> str:
    return "WITH " + BASE.strip() + "\n" + select


ORACLE = {
    # --- flagship --------------------------------------------------------
    "coverage_status": q("""
SELECT package, name, status, n_cov AS n_coverers FROM o_stat"""),
    # --- 2.1 sources, sinks, inventory ------------------------------------
    "file_inventory": q("""
SELECT root_ord, path, CAST(strlen(content) AS BIGINT) AS length FROM o_files"""),
    "dot_folder_prune": q("""
SELECT path FROM o_files WHERE NOT dotted"""),
    "size_gate": q("""
SELECT path, CAST(strlen(content) AS BIGINT) AS length FROM o_files WHERE NOT dotted AND strlen(content) <= 16384"""),
    "extension_filter": q("""
SELECT path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM o_files WHERE NOT dotted AND ext_ok"""),
    "tracked_semi_join": q("""
SELECT path, rel_path FROM o_files WHERE NOT dotted AND tracked"""),
    "content_blob_hash": q("""
SELECT path, sha1(encode('blob ' || CAST(strlen(content) AS VARCHAR)) || '\\x00'::BLOB || encode(content)) AS blob_hash
FROM o_files"""),
    "repo_root_url": q(f"""
SELECT path, CASE WHEN root_ord = 0 THEN '{GH_URL}' ELSE '{GL_URL}' END AS root_url FROM o_files"""),
    "err_repository": q("""
SELECT DISTINCT CASE root_ord WHEN 0 THEN '/corpus/gh' ELSE '/corpus/gl' END AS path, CAST(0 AS BIGINT) AS line_no, '' AS code,
  CASE root_ord WHEN 0 THEN 'no known provider hosts https://codehost.example/tpch/supply'
    ELSE 'no branch named main or master' END AS message
FROM o_files WHERE NOT dotted"""),
    "scan_stats": q("""
SELECT *, CASE WHEN processed_bytes < 1000 THEN processed_bytes || ' B' WHEN processed_bytes < 1000000 THEN printf('%.1f kB', processed_bytes / 1e3)
    WHEN processed_bytes < 1000000000 THEN printf('%.1f MB', processed_bytes / 1e6) ELSE printf('%.1f GB', processed_bytes / 1e9) END AS processed_size,
  CASE WHEN skipped_bytes < 1000 THEN skipped_bytes || ' B' WHEN skipped_bytes < 1000000 THEN printf('%.1f kB', skipped_bytes / 1e3)
    WHEN skipped_bytes < 1000000000 THEN printf('%.1f MB', skipped_bytes / 1e6) ELSE printf('%.1f GB', skipped_bytes / 1e9) END AS skipped_size
FROM (SELECT CAST(count(*) FILTER (WHERE strlen(content) <= 131072) AS BIGINT) AS processed_files,
  CAST(coalesce(sum(strlen(content)) FILTER (WHERE strlen(content) <= 131072), 0) AS BIGINT) AS processed_bytes,
  CAST(count(*) FILTER (WHERE strlen(content) > 131072) AS BIGINT) AS skipped_files,
  CAST(coalesce(sum(strlen(content)) FILTER (WHERE strlen(content) > 131072), 0) AS BIGINT) AS skipped_bytes
FROM o_files WHERE NOT dotted)"""),
    "docs_sink": q("""
SELECT path, CAST(strlen(c) AS BIGINT) AS length, md5(c) AS md5
FROM (SELECT d.path, CASE WHEN r.p_size % 10 IN (1, 2) THEN replace(d.content, chr(10), chr(13) || chr(10)) ELSE d.content END AS c
  FROM o_docs d JOIN o_reqn r ON r.path = d.path AND r.rn = 1 WHERE r.p_size % 10 NOT IN (3, 4, 7, 8)
  UNION ALL
  SELECT f.path, '---' || chr(13) || chr(10) || substr(f.content, 5) || repeat(chr(13) || chr(10), 2) || a.data || chr(13) || chr(10)
  FROM o_files f JOIN o_reqn r ON r.path = f.path AND r.rn = 1
  JOIN (SELECT path, max(line_no) AS edited, string_agg(data, chr(13) || chr(10) ORDER BY seq) AS data FROM o_actions GROUP BY path) a
    ON a.path = f.path
  WHERE r.p_size % 10 IN (3, 4) AND a.edited = 0
  UNION ALL
  SELECT f.path, l.head || replace(substr(f.content, length(l.head) + 1), chr(10), chr(13) || chr(10))
    || chr(13) || chr(10) || a.data || chr(13) || chr(10)
  FROM o_files f JOIN o_reqn r ON r.path = f.path AND r.rn = 1
  JOIN (SELECT path, string_agg(text || chr(10), '' ORDER BY line_no) AS head FROM o_docline WHERE line_no <= 3 GROUP BY path) l ON l.path = f.path
  JOIN (SELECT path, max(line_no) AS edited, string_agg(data, chr(13) || chr(10) ORDER BY seq) AS data FROM o_actions GROUP BY path) a
    ON a.path = f.path
  WHERE r.p_size % 10 IN (7, 8) AND a.edited = 0)"""),
    "action_report": q("""
SELECT path, seq, 'Action' || chr(10) || chr(9) || type || chr(10) || chr(9) || path || ':' || CAST(line_no AS VARCHAR)
  || chr(10) || chr(9) || 'Requirement: ' || name || chr(10) || chr(9) || 'Data: ' || data AS text
FROM o_actions"""),
    # --- 2.2 lines, extraction --------------------------------------------
    "line_explode": q("""
SELECT path, line_no, line FROM o_lines"""),
    "ignore_lines": q("""
SELECT path, CAST(count(*) AS BIGINT) AS n_kept FROM o_lines WHERE NOT regexp_matches(line, '^// order ')
GROUP BY path"""),
    "ignore_lines_dialect": q(r"""
SELECT path, CAST(count(*) AS BIGINT) AS n_kept FROM o_lines
WHERE NOT regexp_matches(line, '(?P<head>^//[[:space:]]order )\d*[05[]\b|^---$|~[^[:^alpha:]]+\.{2}|a{,2}')
GROUP BY path"""),
    "file_kind": q("""
SELECT path, kind FROM o_files"""),
    "fence_state": q("""
SELECT path, CAST(5 + 2 * k + m + d AS BIGINT) AS line_no FROM o_reqn, (VALUES (3), (4), (5)) v(d) WHERE rn = 1"""),
    "header_state": q("""
SELECT path, CAST(2 AS BIGINT) AS line_no FROM o_reqn WHERE rn = 1"""),
    "package_of_file": q("""
SELECT path, package, package LIKE 'ignoreme%' AS ignored FROM o_reqn WHERE rn = 1"""),
    "ignored_package_drop": q("""
SELECT path FROM o_reqn WHERE rn = 1 AND p_size = 50"""),
    "extract_tags": q("""
SELECT root_dir || rel_path AS path, line_no, CAST(1 AS BIGINT) AS tag_ord, package, name, cov_type FROM o_tag"""),
    "extract_sites": q("""
SELECT path, line_no, name, footnote_id, status_word, emoji, variant <> 0 AS annotated FROM o_site"""),
    "extract_footnotes": q("""
SELECT path, fn_line AS line_no, footnote_id, package FROM o_site WHERE variant IN (1, 2, 3)"""),
    "extract_coverers": q(f"""
SELECT s.path, s.fn_line AS line_no,
  CAST(row_number() OVER (PARTITION BY s.path, s.fn_line ORDER BY c.cov_type, c.file, c.line_no, c.url) AS BIGINT) AS cov_ord,
  c.label, c.url
FROM o_site s JOIN o_cov c ON s.package = c.package AND s.name = c.name WHERE s.variant = 2
UNION ALL
SELECT path, fn_line, CAST(1 AS BIGINT), 'docs/stale.md:1:impl', '{GH_URL}/docs/stale.md#L1' FROM o_site WHERE variant = 3"""),
    "requirement_type": q("""
SELECT path, line_no, package, name, split_part(name, '.', 1) AS req_type FROM o_site"""),
    "type_registry": q("""
SELECT path, line_no, split_part(name, '.', 1) AS req_type,
  CAST(CASE split_part(name, '.', 1) WHEN 'it' THEN 0 WHEN 'cmp' THEN 1 ELSE 2 END AS BIGINT) AS order_no
FROM o_site"""),
    "coverage_by_type": q("""
SELECT package, req_type, CAST(grouping(package, req_type) AS BIGINT) AS level,
  CAST(CASE WHEN grouping(package, req_type) = 0 THEN CASE req_type WHEN 'it' THEN 0 WHEN 'cmp' THEN 1 ELSE 2 END END AS BIGINT) AS order_no,
  CAST(count(*) AS BIGINT) AS n_requirements, CAST(count(*) FILTER (WHERE status = 'covrd') AS BIGINT) AS n_covered,
  CAST(sum(n_cov) AS BIGINT) AS n_coverers
FROM (SELECT package, split_part(name, '.', 1) AS req_type, status, n_cov FROM o_stat)
GROUP BY ROLLUP (package, req_type)"""),
    "retained_files": q("""
SELECT DISTINCT path, 'md' AS kind FROM o_site
UNION ALL
SELECT DISTINCT root_dir || rel_path, 'src' FROM o_tag"""),
    # --- 2.4 joins, aggregation, windows, diff ------------------------------
    "site_tag_join": q("""
SELECT s.package, s.name, s.path AS site_path, s.line_no AS site_line, c.tag_path, c.line_no AS tag_line, c.cov_type
FROM o_site s LEFT JOIN o_cov c ON c.package = s.package AND c.name = s.name"""),
    "coverer_build": q("""
SELECT package, name, label, url FROM o_cov"""),
    "new_coverer_list": q("""
SELECT package, name,
  CAST(row_number() OVER (PARTITION BY package, name ORDER BY cov_type, file, line_no, url) AS BIGINT) AS ord, label, url
FROM o_cov"""),
    "coverer_sort": q("""
SELECT package, name,
  CAST(row_number() OVER (PARTITION BY package, name ORDER BY cov_type, file, line_no, url) AS BIGINT) AS ord, label
FROM o_cov"""),
    "first_footnote_match": q("""
SELECT path, line_no, fn_line AS match_line FROM o_site WHERE variant IN (1, 2, 3)"""),
    "current_coverer_list": q(f"""
SELECT s.path, s.line_no, s.variant IN (1, 2, 3) AS has_footnote,
  CAST(CASE s.variant WHEN 2 THEN c.ord WHEN 3 THEN 1 END AS BIGINT) AS cov_ord,
  CASE s.variant WHEN 2 THEN c.label WHEN 3 THEN 'docs/stale.md:1:impl' END AS label,
  CASE s.variant WHEN 2 THEN c.url WHEN 3 THEN '{GH_URL}/docs/stale.md#L1' END AS url
FROM o_stat s LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY package, name ORDER BY cov_type, file, line_no, url) AS ord FROM o_cov) c
  ON s.variant = 2 AND c.package = s.package AND c.name = s.name"""),
    "coverage_diff": q("""
SELECT package, name, (variant IN (0, 1, 4) AND n_cov > 0) OR variant = 3 AS changed FROM o_stat"""),
    "max_footnote_id": q("""
SELECT DISTINCT path, CAST(max_id AS BIGINT) AS max_id FROM o_stat"""),
    "next_footnote_id": q("""
SELECT path, line_no, new_fid AS footnote_id FROM o_fid WHERE variant = 0"""),
    "position_order": q("""
SELECT path, line_no, CAST(rn AS BIGINT) AS pos FROM o_site"""),
    "site_actions": q("""
SELECT path, line_no, name, data FROM o_actions WHERE type = 'Site'"""),
    "footnote_actions": q("""
SELECT path, line_no, name, data FROM o_actions WHERE type = 'Footnote'"""),
    "format_site": q("""
SELECT path, line_no, site_data AS site_text FROM o_fmt"""),
    "format_footnote": q("""
SELECT package, name, fn_data AS footnote_text FROM o_fmt WHERE needs_fn"""),
    "actions_by_file": q("""
SELECT path, seq, type, line_no, name, data FROM o_actions"""),
    "dry_run": q("""
SELECT path, CAST(count(*) AS BIGINT) AS n_actions, CAST(count(*) FILTER (WHERE type = 'Site') AS BIGINT) AS n_site,
  CAST(count(*) FILTER (WHERE type = 'Footnote') AS BIGINT) AS n_footnote
FROM o_actions GROUP BY path"""),
    # --- 2.5 rewrite -------------------------------------------------------
    # LF and CRLF throughout: one part per line; cut at CRLF: behind the first of mixed ends
    "eol_detect_split": q("""
SELECT DISTINCT r.path, CASE WHEN r.p_size % 10 IN (1, 2, 3, 4, 7, 8) THEN chr(13) || chr(10) ELSE chr(10) END AS eol,
  CAST(CASE WHEN r.p_size % 10 IN (3, 4) THEN 2 WHEN r.p_size % 10 IN (5, 6) THEN 15 + 2 * r.k + r.m
    WHEN r.p_size % 10 IN (7, 8) THEN 10 + 2 * r.k + r.m ELSE 13 + 2 * r.k + r.m END AS BIGINT) AS n_parts
FROM o_reqn r JOIN o_actions a ON r.path = a.path"""),
    "trim_trailing_blank": q("""
SELECT DISTINCT r.path, CAST(12 + 2 * r.k + r.m AS BIGINT) AS n_keep
FROM o_reqn r JOIN o_actions a ON r.path = a.path"""),
    "rewrite_site": q("""
SELECT a.path, a.line_no, '- ' || a.data || ' shall hold.' AS text FROM o_actions a WHERE a.type = 'Site'"""),
    "rewrite_footnote": q("""
SELECT path, line_no, data AS text FROM o_actions WHERE type = 'Footnote' AND line_no > 0"""),
    "append_footnotes": q("""
SELECT n.path, n.line_no, n.text FROM o_newdoc n
JOIN (SELECT path, max(line_no) AS last_line FROM o_docline GROUP BY path) b ON n.path = b.path
WHERE n.line_no > b.last_line"""),
    # the first edit: cut at CRLF, all that follows the only one is one line, and behind three LF
    # another line has the number of the one that was scanned, or none has
    "apply_check": q("""
SELECT a.path, CASE WHEN r.p_size % 10 IN (3, 4) OR a.line_no > 9 + 2 * r.k + r.m THEN 'line ' || a.line_no || ' lies beyond the end of ' || a.path
  ELSE 'line ' || a.line_no || ' of ' || a.path || ' is not the line that was scanned' END AS apply_error
FROM o_actions a JOIN o_reqn r ON r.path = a.path AND r.rn = 1
WHERE r.p_size % 10 IN (3, 4, 7, 8) AND a.line_no > 0
QUALIFY row_number() OVER (PARTITION BY a.path ORDER BY a.seq) = 1"""),
    "final_newline": q("""
SELECT path, CAST(strlen(content) AS BIGINT) AS length, md5(content) AS md5 FROM o_docs"""),
    # --- 2.3 validation rules (faulted corpora) ---------------------------
    **{
        name: q(f"""
SELECT path, line_no, code, message FROM {src} WHERE code = '{code}'""")
        for name, src, code in [
            ("err_pkgident", "o_synerr", "pkgident"),
            ("err_reqident", "o_synerr", "reqident"),
            ("err_covstatus", "o_synerr", "covstatus"),
            ("err_urlsyntax", "o_synerr", "urlsyntax"),
            ("err_multisites", "o_synerr", "multisites"),
            ("err_unmatchedfence", "o_synerr", "unmatchedfence"),
            ("err_reqtype", "o_synerr", "reqtype"),
            ("err_readline", "o_synerr", ""),
            ("err_dupreqid", "o_semerr", "dupreqid"),
            ("err_nopkgidreqs", "o_semerr", "nopkgidreqs"),
            ("err_pkgmismatch", "o_semerr", "pkgmismatch"),
        ]
    },
    "error_report": q("""
SELECT phase, path, line_no, code, path || ':' || CAST(line_no AS VARCHAR) || ': ' || code || ': ' || message AS text
FROM (SELECT * FROM o_synerr UNION ALL SELECT * FROM o_semerr)"""),
    "phase_gate": q("""
SELECT 'clean' AS corpus, CAST(0 AS BIGINT) AS n_scan_errors, CAST(0 AS BIGINT) AS n_semantic_errors,
  (SELECT CAST(count(*) AS BIGINT) FROM o_stat) AS n_coverage, (SELECT CAST(count(*) AS BIGINT) FROM o_actions) AS n_actions,
  (SELECT CAST(count(DISTINCT path) AS BIGINT) FROM o_actions) AS n_docs
UNION ALL
SELECT 'repos', (SELECT CAST(count(DISTINCT root_ord) AS BIGINT) FROM o_files WHERE NOT dotted), 0, 0, 0, 0
UNION ALL
SELECT 'syntax', (SELECT CAST(count(*) AS BIGINT) FROM o_synerr), 0, 0, 0, 0
UNION ALL
SELECT 'semantic', 0, (SELECT CAST(count(*) AS BIGINT) FROM o_semerr),
  (SELECT CAST(count(*) AS BIGINT) FROM o_site WHERE p_size % 10 NOT IN (7, 8, 9)), 0, 0"""),
    # --- 2.6 workload builder ---------------------------------------------
    "corpus_from_tables": q("""
SELECT path, CAST(strlen(content) AS BIGINT) AS length, md5(content) AS md5 FROM o_files"""),
}
# other ways to the same rows
ORACLE["docs_sink_incremental"] = ORACLE["docs_sink"]
for _name in ("fence_state", "header_state", "package_of_file"):
    ORACLE[_name + "_segmented"] = ORACLE[_name]
for _name in ("final_newline", "docs_sink", "apply_check"):
    ORACLE[_name + "_chunked"] = ORACLE[_name]
