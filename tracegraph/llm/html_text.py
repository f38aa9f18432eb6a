"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags (inline tags do not
cut; a line break does). Each block becomes a vector: the tags it stands in, its own tag,
the hashed words of class, id and role of its ancestors, the hashed words of its text, and
a few numbers (length, share of link text, position). A bidirectional LSTM in numpy reads
the sequence of a whole page and labels every block, so a block is judged by what stands
before and after it. The blocks labelled as article are the text.

Training is by weak labels, on at most ``SAMPLE`` pages (the ones smallest by a hash) of at
most ``SAMPLE_CHARS`` characters: blocks inside an article or main element, and in nothing
that names itself a menu, notice, advert and so on, are article. Each sampled page is also
varied: its article goes into other containers, and blocks of known kind (side bars,
notices, comments, forms, ...) made of words of the sample are put around and into it, so
that kinds of boilerplate are known which the sample lacks. Labelling reads whole pages.

Defined cases: null and empty pages give the empty text; broken mark-up never fails (an
unclosed comment, script or style reaches to the end, unknown closing tags are ignored,
a ``<`` that opens no tag is text; a quote that is never closed does not hide the end of its
tag); without any page to learn from nothing is labelled. Training takes at most 200,000 words
for made blocks and pages of at most 400 blocks (``TRAIN_WORDS``, ``TRAIN_BLOCKS``).
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, row_key

SAMPLE, SAMPLE_CHARS, VARIANTS, EPOCHS, HIDDEN = 160, 40_000, 4, 14, 16
#: bounds of the training data only
TRAIN_WORDS, TRAIN_BLOCKS = 200_000, 400
#: pages labelled together
BATCH = 256
NAMED = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: elements whose content is no text of the page
RAW = frozenset("script style template noscript svg title iframe object".split())
RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input".split())
#: tags with a place of their own in the vector
TAGS = "html head body article main section div nav header footer aside form ul ol li dl dt dd table tr td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption a button label select option textarea fieldset details summary address center".split()
TAG_AT = {t: i for i, t in enumerate(TAGS)}
#: what an opening tag closes: paragraphs end at any block, items at the next item
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES = {tag: (*tags, "p") for tag, tags in CLOSES.items()}
WALLS = frozenset("html body article main section div nav header footer aside form ul ol dl table blockquote figure fieldset details td th".split())
ATTRS, WORDS, NUMBERS = 128, 32, 6
#: words whose bucket is remembered
WORD_MEMORY = 200_000
WIDTH = 2 * len(TAGS) + ATTRS + WORDS + NUMBERS


class _Buckets(dict):
    """Hash bucket of a word; forgets everything when it grows large."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: str) -> int:
        if len(self) > WORD_MEMORY:
            self.clear()
        self[word] = at = zlib.crc32(word.lower().encode("utf-8", "replace")) % self.n
        return at


ATTR_AT, WORD_AT = _Buckets(ATTRS), _Buckets(WORDS)


class Path:
    """An open element and, through ``up``, those around it. What a block's vector needs of its
    path is kept as bit masks, so that a step costs the same at any depth."""

    __slots__ = ("up", "tag", "names", "tag_bits", "name_bits", "last")

    def __init__(self, up: Path | None, tag: str, names: tuple):
        self.up, self.tag, self.names = up, tag, names
        at = TAG_AT.get(tag)
        self.tag_bits = (up.tag_bits if up else 0) | (0 if at is None else 1 << at)
        self.last = (up.last if up else None) if at is None else at
        self.name_bits = up.name_bits if up else 0
        for n in names:
            self.name_bits |= 1 << ATTR_AT[n]


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Path | None, text: str, linked: float):
        self.path, self.text, self.linked = path, text, linked

    def around(self) -> Iterator[Path]:
        """The elements it stands in, innermost first."""
        at = self.path
        while at is not None:
            yield at
            at = at.up


class TagEnds:
    """Finds the ``>`` of a tag: the first one outside quotes or, if a quote is never closed,
    the first one at all. Quotes from which no end was found are remembered, so that all
    tags of a page together take time in proportion to its length."""

    def __init__(self, page: str):
        self.page, self.last, self.hopeless = page, page.rfind(">"), set()

    def find(self, start: int) -> tuple[int, bool]:
        """Position of the ``>`` (-1: there is none) and whether it is outside quotes."""
        if start > self.last:
            return -1, False
        at, seen = start, []
        while True:
            m = STOP.search(self.page, at)
            if m is not None and m[0] == ">":
                return m.start(), True
            if m is None or m.start() in self.hopeless:
                break
            seen.append(m.start())
            at = self.page.find(m[0], m.end()) + 1
            if not at:
                break
        self.hopeless.update(seen)
        return self.page.find(">", start), False


def tags_of(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``(start, end, "/" of a closing tag, name, attributes)`` of all mark-up, in page order;
    the name is empty for comments, declarations and elements without text."""
    ends, at, size = TagEnds(page), page.find("<"), len(page)
    while at >= 0:
        end, slash, tag, inner = 0, "", "", ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            end = end if end > 2 else size
        elif page[at : at + 9].upper() == "<![CDATA[":
            end = page.find("]]>", at + 9) + 3
            end = end if end > 2 else size
        elif m := NAMED.match(page, at + 1):
            close, whole = ends.find(m.end())
            if close >= 0:
                end, slash, tag, inner = close + 1, m[1], m[2].lower(), page[m.end() : close]
                if whole and not slash and tag in RAW:
                    if not (tag == "svg" and inner.endswith("/")):
                        after = RAW_END[tag].search(page, end)
                        end = after.end() if after else size
                    tag = ""
        elif page[at + 1 : at + 2] in ("!", "?", "/") and at < ends.last:
            end = page.find(">", at) + 1
        if end:
            yield at, end, slash, tag, inner
        at = page.find("<", end or at + 1)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, with decoded text and white space as single blanks. Time and
    memory are in proportion to the page, however deep its elements are nested."""
    out: list[Block] = []
    stack: list[Path] = []
    depths: dict[str, list[int]] = {}  # of every tag that is open
    walls: list[int] = []  # depths of the open elements that end what is inside them
    parts: list[str] = []
    linked = at = 0

    def cut():
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(stack[-1] if stack else None, text, linked / max(1, sum(map(len, parts)))))
        parts.clear()
        linked = 0

    def say(text: str):
        nonlocal linked
        if text:
            parts.append(text)
            if depths.get("a"):
                linked += len(text)

    def close(depth: int):
        while len(stack) > depth:
            depths[stack.pop().tag].pop()
        while walls and walls[-1] >= depth:
            walls.pop()

    def innermost(tag: str) -> int:
        open_at = depths.get(tag)
        return open_at[-1] if open_at else -1

    for start, end, slash, tag, inner in tags_of(page):
        say(page[at:start])
        at = end
        if not tag:
            continue
        wall = walls[-1] if walls else -1
        if tag not in INLINE:
            cut()
        if slash:
            depth = innermost(tag)
            if depth >= 0 and (tag not in INLINE or wall <= depth):
                close(depth)
            continue
        if tag not in INLINE:
            depth = max(map(innermost, CLOSES[tag])) if tag in CLOSES else innermost("p")
            if depth >= 0 and depth >= wall:
                close(depth)
        if tag not in VOID and not inner.endswith("/"):
            words = {w.lower() for g in ATTRIBUTE.findall(inner) for w in NAME.findall("".join(g))} if inner else ()
            depths.setdefault(tag, []).append(len(stack))
            if tag in WALLS:
                walls.append(len(stack))
            stack.append(Path(stack[-1] if stack else None, tag, tuple(sorted(words))))
    say(page[at:])
    cut()
    return out


def bits(mask: int) -> list[int]:
    """Positions of the set bits."""
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


def vectors(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), WIDTH), dtype=np.float32)
    own, attrs, words, numbers = len(TAGS), 2 * len(TAGS), 2 * len(TAGS) + ATTRS, WIDTH - NUMBERS
    for row, b in zip(x, page, strict=True):
        if b.path is not None:
            row[bits(b.path.tag_bits)] = 1.0
            if b.path.last is not None:
                row[own + b.path.last] = 1.0
            row[[attrs + i for i in bits(b.path.name_bits)]] = 1.0
        tokens = b.text.split()
        row[words:numbers] = np.bincount([WORD_AT[w] for w in tokens], minlength=WORDS)
        row[words:numbers] /= len(tokens)
        row[numbers:] = (np.log1p(len(tokens)) / 5, b.linked, min(1.0, b.text.count(",") / len(tokens)), b.text[-1] in ".!?", len(tokens) < 5, 1.0)
    if len(page):
        x[:, -1] = np.linspace(-1, 1, len(page))
    return x


# --- the network ----------------------------------------------------------------------


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def lstm(x, w, u, b, keep: bool):
    """One direction over (steps, pages, width); returns hidden states and what BPTT needs."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN), dtype=np.float32), np.zeros((pages, HIDDEN), dtype=np.float32)
    z, hs, trace = x @ w + b, np.zeros((steps, pages, HIDDEN), dtype=np.float32), []
    for t in range(steps):
        g = z[t] + h @ u
        gates, new = sigmoid(g[:, : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before_h, before_c = h, c
        c = f * c + i * new
        out = np.tanh(c)
        h = o * out
        hs[t] = h
        if keep:
            trace.append((i, f, o, new, before_h, before_c, out))
    return hs, trace


def lstm_back(x, u, trace, grad):
    dw = np.zeros((x.shape[2], 4 * HIDDEN), dtype=np.float32)
    du, db = np.zeros_like(u), np.zeros(4 * HIDDEN, dtype=np.float32)
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(len(trace) - 1, -1, -1):
        i, f, o, new, before_h, before_c, out = trace[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - out * out)
        dg = np.concatenate([dc * new * i * (1 - i), dc * before_c * f * (1 - f), dh * out * o * (1 - o), dc * i * (1 - new * new)], axis=1)
        dw += x[t].T @ dg
        du += before_h.T @ dg
        db += dg.sum(axis=0)
        dh, dc = dg @ u.T, dc * f
    return dw, du, db


def batch_of(pages: list[np.ndarray]):
    """Padded (steps, pages, width), lengths, and the index that turns each page around."""
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((int(lengths.max()), len(pages), WIDTH), dtype=np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    t = np.arange(len(x))[:, None]
    return x, lengths, np.where(t < lengths, lengths - 1 - t, t)


class Labeller:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for side in "fb":
            self.p["w" + side], self.p["u" + side] = draw(WIDTH, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN)
            self.p["b" + side] = np.zeros(4 * HIDDEN, dtype=np.float32)
            self.p["b" + side][HIDDEN : 2 * HIDDEN] = 1.0
        self.p["out"], self.p["bias"] = draw(2 * HIDDEN), np.zeros(1, dtype=np.float32)

    def forward(self, x, turn, keep=False):
        p, cols = self.p, np.arange(x.shape[1])
        ahead, trace_f = lstm(x, p["wf"], p["uf"], p["bf"], keep)
        turned = x[turn, cols]
        back, trace_b = lstm(turned, p["wb"], p["ub"], p["bb"], keep)
        both = np.concatenate([ahead, back[turn, cols]], axis=2)
        return both @ p["out"] + p["bias"], both, turned, trace_f, trace_b

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is article, pages of similar length together."""
        out: list = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            # a bounded number of padded cells per batch
            n = max(1, min(BATCH, 20_000 // len(pages[order[-1]])))
            some, order = order[-n:], order[:-n]
            x, lengths, turn = batch_of([pages[i] for i in some])
            z = self.forward(x, turn)[0]
            for k, i in enumerate(some):
                out[i] = z[: lengths[k], k] > 0
        return out

    def fit(self, pages: list[np.ndarray], truth: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7):
        rng, moment, step = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            chunks = [order[i : i + 32] for i in range(0, len(order), 32)]
            for chunk in chunks:
                x, lengths, turn = batch_of([pages[i] for i in chunk])
                y = np.zeros(x.shape[:2], dtype=np.float32)
                for k, i in enumerate(chunk):
                    y[: len(truth[i]), k] = truth[i]
                inside = np.arange(len(x))[:, None] < lengths
                z, both, turned, trace_f, trace_b = self.forward(x, turn, keep=True)
                dz = np.where(inside, sigmoid(z) - y, 0).astype(np.float32) / max(1, inside.sum()) * 20
                grad = {"out": np.einsum("tp,tph->h", dz, both), "bias": dz.sum(keepdims=True).reshape(1)}
                dboth, cols = dz[:, :, None] * self.p["out"], np.arange(x.shape[1])
                grad["wf"], grad["uf"], grad["bf"] = lstm_back(x, self.p["uf"], trace_f, dboth[:, :, :HIDDEN])
                grad["wb"], grad["ub"], grad["bb"] = lstm_back(turned, self.p["ub"], trace_b, dboth[:, :, HIDDEN:][turn, cols])
                step += 1
                for k, g in grad.items():
                    m, v = moment[k]
                    g = np.clip(g + 1e-4 * self.p[k], -1, 1)
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    eps_rate = rate * (1 - epoch / (epochs + 1))
                    self.p[k] -= eps_rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        return self


# --- training pages -------------------------------------------------------------------

#: names by which boilerplate calls itself, by kind
KINDS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager topbar toolbar tabs",
    "header": "header masthead banner logo branding tagline",
    "footer": "footer copyright legal colophon imprint bottom",
    "side": "sidebar aside widget related recommended popular trending archive tags categories more",
    "notice": "cookie cookies consent notice notification alert gdpr privacy popup modal overlay paywall subscribe warning",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion adsense commercial partner teaser",
    "form": "form search login signup newsletter subscription contact feedback poll survey",
    "comment": "comment comments reply replies discussion disqus respond thread reader guestbook",
    "share": "share sharing social follow like tweet author byline meta",
}
BOILERPLATE = frozenset(w for ws in KINDS.values() for w in ws.split()) - {"header", "author", "byline", "meta", "more", "like", "thread", "reader"}
TAGS_OF = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"], "notice": ["div", "section", "aside"], "advert": ["div", "aside", "section"], "form": ["form", "div"], "comment": ["div", "section", "ol"], "share": ["div", "ul"]}
CONTAINERS = ["<article>", '<main>', '<main id="main"><article class="post">', '<div class="content"><article>', '<div id="content">', '<div class="article-body">', '<section class="entry-content">', '<div class="post">', '<div role="main">', '<div class="main-text">', "<article itemprop=\"articleBody\">"]


def is_article(b: Block) -> bool:
    """The weak label of a block of a real page."""
    tags, names = {p.tag for p in b.around()}, {n for p in b.around() for n in p.names}
    return bool({"article", "main"} & tags) and not {"nav", "aside", "footer", "form", "button", "select", "textarea"} & tags and not BOILERPLATE & names


def variants(page: str, words: list[str], rng: np.random.Generator, n: int):
    """Made pages with the article paragraphs of a real one: (blocks, labels)."""
    mine = [b.text for b in blocks(page) if is_article(b)]
    esc = lambda s: entities.escape(s)
    some = lambda lo, hi: " ".join(words[i] for i in rng.integers(0, len(words), int(rng.integers(lo, hi))))

    def name(kind):
        ws = KINDS[kind].split()
        w = ws[int(rng.integers(len(ws)))]
        w = [w, f"{w}-box", f"site-{w}", f"{w}s", f"{w} block", f"the{w.title()}"][int(rng.integers(6))]
        return [f' class="{w}"', f' id="{w}"', f' class="x {w}"'][int(rng.integers(3))]

    def piece(kind):
        tag = TAGS_OF[kind][int(rng.integers(len(TAGS_OF[kind])))]
        plain = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5
        head = f"<{tag}{'' if plain else name(kind)}>"
        if kind == "menu" or (kind in ("side", "share", "footer") and rng.random() < 0.5):
            items = "".join(f'<li><a href="#">{esc(some(1, 4))}</a></li>' for _ in range(int(rng.integers(2, 8))))
            body = items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind == "form":
            body = f'<label>{esc(some(1, 3))}</label><input type="text"><button>{esc(some(1, 3))}</button>' + (f"<p>{esc(some(3, 12))}.</p>" if rng.random() < 0.5 else "")
        elif kind == "comment":
            one = lambda: f'<div class="comment"><b>{esc(some(1, 3))}</b><p>{esc(some(5, 40))}.</p></div>'
            body = (f"<h3>{esc(some(1, 3))}</h3>" if rng.random() < 0.5 else "") + "".join((one() if rng.random() < 0.6 else f"<p>{esc(some(5, 40))}.</p>") for _ in range(int(rng.integers(1, 6))))
        else:
            body = esc(some(2, 25)) + "." if rng.random() < 0.5 else f"<p>{esc(some(2, 25))}.</p>" + (f"<p>{esc(some(2, 25))}.</p>" if rng.random() < 0.3 else "")
        return f"{head}{body}</{tag}>"

    kinds = list(KINDS)
    for _ in range(n):
        before = [k for k in ("header", "menu", "notice", "advert", "form", "side") if rng.random() < 0.5]
        after = [k for k in ("share", "side", "comment", "advert", "form", "footer", "notice") if rng.random() < 0.5]
        mark = "\x01"  # what follows it is article
        paragraphs = list(mine) if mine else [some(10, 60) + "." for _ in range(int(rng.integers(1, 8)))]
        paragraphs = [p for p in paragraphs if rng.random() < 0.9] or paragraphs[:1]
        if rng.random() < 0.3:  # short ones, and short ones said again and again
            paragraphs = [some(1, 5) + "." if rng.random() < 0.5 else p for p in paragraphs]
            at = int(rng.integers(len(paragraphs)))
            paragraphs[at:at] = [some(1, 5) + "."] * int(rng.integers(1, 25))
        inner = []
        for i, p in enumerate(paragraphs):
            tag = "h1" if i == 0 and rng.random() < 0.6 else ["p", "p", "p", "p", "div", "h2", "li", "blockquote", "td"][int(rng.integers(9))]
            wrap = {"li": ("<ul>", "</ul>"), "td": ("<table><tr>", "</tr></table>")}.get(tag, ("", ""))
            inner.append(f"{wrap[0]}<{tag}>{mark}{esc(p)}</{tag}>{wrap[1]}")
            if rng.random() < 0.08:
                inner.append(piece(kinds[int(rng.integers(len(kinds)))]))
        box = CONTAINERS[int(rng.integers(len(CONTAINERS)))] if rng.random() < 0.9 else ""
        close = "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", box)))
        made = blocks(f"<html><body>{''.join(map(piece, before))}{box}{''.join(inner)}{close}{''.join(map(piece, after))}</body></html>")
        labels = np.array([mark in b.text for b in made], dtype=np.float32)
        for b in made:
            b.text = b.text.replace(mark, "").strip() or "."
        yield made, labels


def train(pages: list[str], seed: int = 7) -> Labeller:
    rng, model = np.random.default_rng(seed), Labeller(seed)
    cut = [blocks(p) for p in pages]
    words = [w for page in cut for b in page for w in b.text.split()][:TRAIN_WORDS]
    if not words:
        return model
    xs, ys = [], []
    for page, found in zip(pages, cut, strict=True):
        labels = np.array([is_article(b) for b in found], dtype=np.float32)
        if labels.any():
            xs.append(vectors(found))
            ys.append(labels)
        for made, known in variants(page, words, rng, VARIANTS):
            xs.append(vectors(made))
            ys.append(known)
    keep = [i for i in range(len(xs)) if 0 < len(xs[i]) <= TRAIN_BLOCKS]
    return model.fit([xs[i] for i in keep], [ys[i] for i in keep])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Labeller:
    p = pages.where(F.char_length(html_col).between(1, sample_chars)).select(row_key(id_col, html_col).alias("key"), F.col(html_col).alias("html"))
    # the keys are chosen first, so that tasks send numbers to the driver, not pages
    chosen = p.select("key").distinct().orderBy("key").limit(sample)
    rows = p.join(F.broadcast(chosen), "key").dropDuplicates(["key"]).orderBy("key").collect()
    return train([r.html for r in rows])


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per input row."""
    shared = pages.sparkSession.sparkContext.broadcast(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Labeller()
        m.p = shared.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                cut = [blocks(h or "") for h in some.column(2).to_pylist()]
                kept = m.labels([vectors(c) for c in cut])
                text = [" ".join(b.text for b, k in zip(c, ks, strict=True) if k) for c, ks in zip(cut, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(text, type=pa.string())], names=["page_id", "url", "text"])
        give_back()

    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = p.mapInArrow(run, f"page_id {dict(p.dtypes)['page_id']}, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))
