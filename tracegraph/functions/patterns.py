"""Fixed values of the annotation language.

Everything in this module must stay equal to the behaviour of the original tool
for results to agree: the grammar of sites, footnotes, coverers and tags, the
closed vocabularies, the default extension list, the size limits and the
message texts of the error codes. Patterns are written in the Java regex dialect
that Spark's ``rlike`` / ``regexp_extract*`` / ``regexp_replace`` use:

* ``WS`` spells out ASCII white space (Java's ``\\s`` also matches VT);
* ``(?d)`` (UNIX_LINES) makes ``.`` stop only at LF, never at CR, U+0085,
  U+2028 or U+2029;
* ``\\z`` is the true end of input (Java's ``$`` also matches before a final CR).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the original tool's).
# ---------------------------------------------------------------------------

# Markdown header key (callers pass ``header_key`` to read files written with another)
DEFAULT_HEADER_KEY = "trace.package"
IGNORED_PACKAGE_PREFIX = "ignoreme"

STATUS_COVRD = "covrd"
STATUS_COVERED = "covered"  # legacy word, still accepted on input
STATUS_UNCVRD = "uncvrd"
STATUS_WORDS = ("", STATUS_COVRD, STATUS_COVERED, STATUS_UNCVRD)
EMOJI_COVERED = "✅"  # ✅
EMOJI_UNCVRD = "❓"  # ❓
HINT_COVERAGE_TYPE = "impl"  # footnote hints always end in this type

ACTION_SITE = "Site"
ACTION_FOOTNOTE = "Footnote"

MARKDOWN_EXTENSION = ".md"
DEFAULT_EXTENSIONS = (
    ".c,.cpp,.cs,.dart,.fs,.go,.h,.hpp,.java,.js,.jsx,.kt,.m,.md,.php,.py,"
    ".rb,.rs,.scala,.sql,.swift,.ts,.tsx,.vsql,.yaml,.yml"
)
# Limits of the original tool; here they are options, off unless given.
MAX_FILE_BYTES = 128 * 1024  # files strictly larger are skipped
MAX_LINE_BYTES = 64 * 1024  # a raw line this long (or longer) ends the scan of its file

WS = "[\\t\\n\\f\\r ]"  # Go's \s

SITE = (
    "`~([^~]+)~`"
    "(?:" + WS + "*([a-zA-Z]+)?" + WS + "*\\[\\^([^\\]]+)\\]" + WS + "*(✅|❓)?)?"
)
FOOTNOTE = (
    "(?d)^" + WS + "*\\[\\^([^\\]]+)\\]:" + WS + "*"
    "(?:`\\[~([^~/]+)/([^~]+)~([^\\]]+)?\\]`)?"
    "(?:" + WS + "*(.+))?" + WS + "*\\z"
)
COVERER = "\\[([^\\]]+)\\]\\(([^)]+)\\)"
TAG = "[^`]\\[~([^/]+)/([^~]+)~([^\\]]+)\\]"
FENCE = "^" + WS + "*```"
IDENT = "^[a-zA-Z][a-zA-Z0-9_]*(?:\\.[a-zA-Z][a-zA-Z0-9_]*)*\\z"
# strings.TrimSpace: Unicode white space (ASCII controls, NEL, Z categories).
USPACE = "[\\t\\n\\x0B\\f\\r\\x{85}\\p{Z}]"
INT_ID = "^[+-]?[0-9]+\\z"  # strconv.Atoi syntax

ERR_PKGIDENT = "pkgident"
ERR_REQIDENT = "reqident"
ERR_COVSTATUS = "covstatus"
ERR_URLSYNTAX = "urlsyntax"
ERR_MULTISITES = "multisites"
ERR_UNMATCHEDFENCE = "unmatchedfence"
ERR_REQTYPE = "reqtype"
ERR_READLINE = ""  # read errors carry no code and line 0
ERR_REPOSITORY = ""  # a repository without a usable URL: no code, line 0
ERR_DUPREQID = "dupreqid"
ERR_NOPKGIDREQS = "nopkgidreqs"
ERR_PKGMISMATCH = "pkgmismatch"

MSG_PKGIDENT = "PackageId shall be an identifier: "
MSG_REQIDENT = "RequirementName shall be an identifier"
MSG_COVSTATUS = "CoverageStatusWord shall be 'covered' or 'uncvrd': "
MSG_URLSYNTAX = "the URL provided is invalid: "
MSG_MULTISITES = "only one RequirementSite is allowed per line: "
MSG_MULTISITES_SEP = ",  "
MSG_UNMATCHEDFENCE = "opening code block fence at line %d has no matching closing fence"
MSG_REQTYPE = "requirement type must be one of [%s]: %s"
MSG_READLINE = "Error reading file: token too long"
MSG_UNKNOWNREPO = "unknown repository: "
MSG_DUPREQID = "duplicate RequirementId detected:\n\t%s\n\t%s:%d"
MSG_NOPKGIDREQS = "markdown file with RequirementSites shall define "
MSG_PKGMISMATCH = "CoverageFootnote package (%s) is not consistent with PackageId in the header (%s)"

# Why a document or repository cannot be used: words of our own, free to change.
MSG_LINE_MOVED = "line %d of %s is not the line that was scanned"
MSG_LINE_OTHER = "line %d of %s holds nothing that this action could replace"
MSG_LINE_MISSING = "line %d lies beyond the end of %s"
MSG_NOT_APPENDED = "only footnotes can be appended to %s"
MSG_UNDECODABLE = "%s holds bytes that are no UTF-8"
MSG_NO_BRANCH = "no branch named main or master"
MSG_NO_PROVIDER = "no known provider hosts "
MSG_BAD_TYPES = "requirement types are no identifiers or are repeated: %s"

# Git providers and branches, tested in this order.
PROVIDERS = (("github.com", "/blob/"), ("gitlab.com", "/-/blob/"))
BRANCHES = ("main", "master")


def header_pattern(header_key: str = DEFAULT_HEADER_KEY) -> str:
    """``^<key>:\\s*(.+)$`` for a literal header key."""
    return "(?d)^" + java_quote(header_key) + ":" + WS + "*(.+)\\z"


def java_quote(text: str) -> str:
    """Literal text as a Java regex (``Pattern.quote``)."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def parse_extensions(extensions: str | None) -> list[str]:
    """Comma list as the tool reads it: trimmed, not lower-cased (Q2)."""
    text = extensions if extensions else DEFAULT_EXTENSIONS
    return [e.strip() for e in text.split(",")]
