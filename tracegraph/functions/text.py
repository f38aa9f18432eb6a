"""Column-level helpers: every function maps Columns to a Column and stays
JVM-side (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c) -> Column:
    """``strings.TrimSpace``: cut Unicode white space at both ends."""
    return F.regexp_replace(col(c), "^" + P.USPACE + "+|" + P.USPACE + "+\\z", "")


def is_blank(c) -> Column:
    return col(c).rlike("^" + P.USPACE + "*\\z")


def is_ident(c) -> Column:
    return col(c).rlike(P.IDENT)


def requirement_type(name) -> Column:
    """First dot segment of a requirement name (row 22)."""
    return F.substring_index(col(name), ".", 1)


def int_id(c) -> Column:
    """Integer value of a footnote id as ``strconv.Atoi`` reads it, else NULL
    (a leading blank or an overflow gives NULL, as in the tool)."""
    c = col(c)
    stripped = F.regexp_replace(c, "^[+]", "")
    return F.when(c.rlike(P.INT_ID), stripped.try_cast("bigint"))


def emoji_for(status) -> Column:
    s = col(status)
    return F.when(s.isin(P.STATUS_COVERED, P.STATUS_COVRD), F.lit(P.EMOJI_COVERED)).otherwise(F.lit(P.EMOJI_UNCVRD))


def format_site(name, status, footnote_id) -> Column:
    """`` `~name~`status[^id]emoji `` (row 51)."""
    return F.concat(F.lit("`~"), col(name), F.lit("~`"), col(status), F.lit("[^"), col(footnote_id), F.lit("]"), emoji_for(status))


def footnote_hint(package, name) -> Column:
    return F.concat(F.lit("`[~"), col(package), F.lit("/"), col(name), F.lit("~" + P.HINT_COVERAGE_TYPE + "]`"))


def coverer_label(rel_path, line_no, cov_type) -> Column:
    return F.concat_ws(":", col(rel_path), col(line_no).cast("string"), col(cov_type))


def coverer_url(root_url, rel_path, line_no) -> Column:
    return F.concat(col(root_url), F.lit("/"), col(rel_path), F.lit("#L"), col(line_no).cast("string"))


def coverer_link(label, url) -> Column:
    """``[label](url)``."""
    return F.concat(F.lit("["), col(label), F.lit("]("), col(url), F.lit(")"))


def format_footnote(footnote_id, package, name, coverers) -> Column:
    """``[^id]: `[~pkg/name~impl]` [label](url), …`` (row 52); ``coverers`` is the joined text."""
    head = F.concat(F.lit("[^"), col(footnote_id), F.lit("]: "), footnote_hint(package, name))
    return F.when(F.coalesce(col(coverers), F.lit("")) != "", F.concat(head, F.lit(" "), col(coverers))).otherwise(head)


def quote_replacement(c) -> Column:
    """Literal replacement text for ``regexp_replace`` (quote ``\\`` and ``$``)."""
    return F.regexp_replace(col(c), "([\\\\$])", "\\\\$1")


def blob_hash(content) -> Column:
    """Git blob id: SHA-1 of ``blob <bytes>\\0<content>`` (row 6)."""
    c = col(content)
    header = F.concat(F.lit("blob "), F.octet_length(c).cast("string"), F.lit("\u0000"))
    return F.sha1(F.concat(F.encode(header, "UTF-8"), c.cast("binary")))


SCHEME = "[a-zA-Z][a-zA-Z0-9+.-]*:"
HOST_CHAR = "[A-Za-z0-9\\-_.~!$&'()*+,;=<>\"]|[^\\x00-\\x7f]|%25|%[89A-Fa-f][0-9A-Fa-f]"
AUTHORITY = (
    f"(?s)^(?:{SCHEME})?//(?:[A-Za-z0-9\\-._:~!$&'()*+,;=%@]*@)?"
    f"(?:\\[[^\\]/?#]*\\]|(?:{HOST_CHAR})*)(?::[0-9]*)?(?:[/?#].*)?\\z"
)
BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"
# A URL of this shape always parses: http(s) scheme, plain host, optional port,
# path and fragment without '%' escapes or control bytes.
PLAIN_URL = "^https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~!$&'()*+,;=:@/-]*)?(?:#[A-Za-z0-9._~!$&'()*+,;=:@/?-]*)?\\z"


def url_fault(url) -> Column:
    """Why a URL does not parse, else NULL (row 28); predicates in the parser's order, in
    words of our own. Query strings and the rest of opaque URLs are not checked."""
    u = col(url)
    path = F.substring_index(F.substring_index(u, "#", 1), "?", 1)
    fragment = F.regexp_extract(u, "(?s)^[^#]*#(.*)\\z", 1)
    opaque = u.rlike("^" + SCHEME + "(?!/)")
    fault = (
        F.when(u.rlike("^[^#]*[\\x00-\\x1f\\x7f]"), "control character")
        .when(u.startswith(":"), "missing protocol scheme")
        .when(~opaque & u.rlike("^(?!" + SCHEME + ")(?!/)[^/?#]*:"), "colon in the first path segment")
        .when(u.rlike("^(?:" + SCHEME + ")?//") & ~u.rlike("^///") & ~u.rlike(AUTHORITY), "invalid user, host or port")
        .when((~opaque & path.rlike(BAD_ESCAPE)) | fragment.rlike(BAD_ESCAPE), "invalid percent escape")
    )
    return F.when(~u.rlike(PLAIN_URL), fault)


SI_UNITS = ("kB", "MB", "GB", "TB", "PB", "EB")


def si_bytes(c) -> Column:
    """Byte count in SI text: whole bytes below 1000, else one decimal of the largest unit
    that gives at least 1, rounded half to even on the binary quotient.

    With x the quotient as a double and q the tenths cut off, the tenths go up when
    20 x > 2 q + 1, or on equality when q is odd; (16 x - (2 q + 1)) + 4 x has the sign of
    that difference without rounding."""
    v = col(c).cast("bigint")
    text = F.concat(v.cast("string"), F.lit(" B"))
    for power, unit in enumerate(SI_UNITS, 1):
        size = F.lit(1000**power).cast("bigint")
        left = v % size
        whole = ((v - left) / size).cast("bigint")
        q = whole * 10 + F.floor(left / F.lit(1000**power // 10).cast("bigint"))
        x = v.cast("double") / size
        beyond = (16 * x - (2 * q + 1)) + 4 * x
        tenths = q + F.when((beyond > 0) | ((beyond == 0) & (q % 2 == 1)), 1).otherwise(0)
        shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" " + unit))
        text = F.when(v >= size, shown).otherwise(text)
    return text
