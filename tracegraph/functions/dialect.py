"""Ignore patterns come in the linear-time dialect of the original tool's users. Java, which
``rlike`` speaks, reads some of it otherwise (white space, POSIX classes, line ends, ``[`` within
a class, named groups) and has more (look-around, back-references, atomic groups, possessive
repetition). ``java_pattern`` rewrites the first and refuses the second, so that a pattern means
here what it means there. Not taken either, though that dialect has it: the ungreedy flag ``U``."""

from __future__ import annotations

import re

from . import patterns as P

SPACE = "\\t\\n\\f\\r "
WORD_EDGE = "(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))"
NO_WORD_EDGE = "(?:(?<=\\w)(?=\\w)|(?<!\\w)(?!\\w))"
#: escapes with one meaning, outside and inside a class
OUTSIDE = {"s": f"[{SPACE}]", "S": f"[^{SPACE}]", "b": WORD_EDGE, "B": NO_WORD_EDGE, "A": "\\A", "z": "\\z"}
INSIDE = {"s": SPACE, "S": "\\S\\x0B"}
PLAIN = {c: "\\" + c for c in "aftnrdDwW"} | {"v": "\\x0B"}
POSIX = {c.lower(): c for c in ("Alnum", "Alpha", "ASCII", "Blank", "Cntrl", "Digit", "Graph", "Lower", "Print", "Punct", "Upper", "XDigit")}

ESCAPE = r"\\(?:[pP](?:\{\^?\w+\}|\w)|x(?:\{[0-9a-fA-F]+\}|[0-9a-fA-F]{2})|[1-7][0-7]{1,2}|0[0-7]{0,2}|.)"
TOKEN = re.compile(
    rf"(?s)(?P<quote>\\Q.*?(?:\\E|\Z))|(?P<escape>{ESCAPE})"
    rf"|(?P<set>\[\^?\]?(?:\[:\^?\w+:\]|{ESCAPE}|[^\]\\])*\])"
    r"|(?P<named>\(\?P?<\w+>)|(?P<flags>\(\?[ims]*(?:-[ims]+)?[:)])|(?P<special>\(\?)"
    r"|(?P<repeat>(?:[*+?]|\{\d+(?:,\d*)?\})\??(?P<more>[*+?]|\{\d+(?:,\d*)?\})?)|(?P<other>.)"
)
IN_SET = re.compile(rf"(?s)\[:(?P<no>\^?)(?P<posix>\w+):\]|(?P<escape>{ESCAPE})|(?P<other>.)")
MOST_REPEATS = 1000


def _escape(text: str, own: dict[str, str]) -> str:
    body = text[1:]
    if body[0] in "pP":
        name = body[1:].strip("{}")
        no = (body[0] == "P") != name.startswith("^")
        name = name.lstrip("^")
        return ("\\P{" if no else "\\p{") + (name if len(name) <= 2 else "Is" + name) + "}"
    if body[0] == "x" and len(body) > 1:
        return f"\\x{{{body[1:].strip('{}')}}}"
    if body[0] == "0" or len(body) > 1:
        return f"\\x{{{int(body, 8):x}}}"
    found = own.get(body, PLAIN.get(body))
    if found is None and (body.isalnum() or not body.isascii()):
        raise ValueError(f"\\{body} is not supported")
    return found or "\\" + body


def _set(text: str) -> str:
    start = 2 if text.startswith("[^") else 1
    out = []
    for m in IN_SET.finditer(text[start:-1]):
        if m["posix"] == "word":
            out.append("\\W" if m["no"] else "\\w")
        elif m["posix"]:
            if m["posix"] not in {**POSIX, "space": ""}:
                raise ValueError(f"[:{m['posix']}:] is no class")
            out.append(("\\P{" if m["no"] else "\\p{") + POSIX.get(m["posix"], "Space") + "}")
        elif m["escape"]:
            out.append(_escape(m["escape"], INSIDE))
        else:  # only - and a leading ^ mean anything within a class
            out.append("\\" + m["other"] if m["other"] in "[]&^" else m["other"])
    return text[:start] + "".join(out) + "]"


def java_pattern(pattern: str) -> str:
    """The Java pattern that finds a match in the same lines; ``ValueError`` for what the dialect
    does not have. Syntax errors that both share are left to Java."""
    out = ["(?d)"]
    for m in TOKEN.finditer(pattern):
        text = m[0]
        if m["quote"]:
            out.append(P.java_quote(text[2:].removesuffix("\\E")))
        elif m["escape"]:
            out.append(_escape(text, OUTSIDE))
        elif m["set"]:
            out.append(_set(text))
        elif m["named"]:
            out.append("(")
        elif m["flags"]:
            on, sep, off = text[2:-1].partition("-")
            fold = lambda f: f.replace("i", "iu")
            out.append("(?" + fold(on) + sep + fold(off) + text[-1])
        elif m["special"]:
            raise ValueError("groups that look around or do not give back are not supported")
        elif m["repeat"]:
            if m["more"]:
                raise ValueError(f"{text} repeats a repetition")
            if any(int(n) > MOST_REPEATS for n in re.findall(r"\d+", text)):
                raise ValueError(f"{text} repeats more than {MOST_REPEATS} times")
            out.append(text)
        else:
            out.append("\\" + text if text in "{}[]\\" else text)
            if text in "[\\":
                raise ValueError(f"{text} has no end")
    return "".join(out)
