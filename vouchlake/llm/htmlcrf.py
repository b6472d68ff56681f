"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags,
each with its open ancestors. The field has two states (main text, the rest), emission
weights over ancestor tags, ancestor class and id words and text features, and
transition weights. It is trained on labelled pages (`labelled_pages`: our own page
layouts, every block labelled where it is laid out) by maximum likelihood, and decoded
by Viterbi.

Comments, scripts, styles and other raw elements hold no blocks. An svg, iframe, object,
select, video, audio or canvas ends with its tag if that closes itself, else at its end
tag, else (none before the next of its kind) at the next block-level tag, so that nothing
after it is lost. Formulas in MathML are part of their sentence. Character references
are decoded, white space within a block becomes one space, and the blocks of the main
text are joined in page order by one space. Null and empty html give an empty text, as
do pages without main text. Of broken markup, unclosed elements end with their parent and stray end
tags are passed over; a quote counts only directly after =, so a stray one swallows nothing;
a tag that nothing ends is text. Reading takes one pass, whatever is broken (`tokens`). Rows repeat as often as they
come; extra columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .samples import read_table

WIDTH = 1 << 12  # of the hashed features
_MEMO = 50_000
#: Elements whose whole content is no text of the page.
RAW = ("script", "style", "template", "textarea")
#: Elements whose content is another medium or a control; often left open.
EMBEDDED = ("iframe", "svg", "object", "canvas", "select", "video", "audio")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose semantics annotation".split()
)
BLOCK_LEVEL = "p|div|h[1-6]|article|section|main|header|footer|nav|aside|ul|ol|li|table|tr|td|th|form|blockquote|pre|figure|body|html"
#: A start tag of the first kind ends an open element of the same kind.
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: What stands between a tag's name and its end. A quoted value stands directly after =; elsewhere quotes are letters like others.
_MARKS = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>""")
_ONE_MARK = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_MEDIA_NEXT = {name: re.compile(rf"<{name}(?=[\s/>])|(</{name}\s*>)", re.I) for name in EMBEDDED}
_BLOCK = re.compile(rf"</?(?:{BLOCK_LEVEL})(?=[\s/>])", re.I)
_NAMING = ("class", "id", "role")
_PART = re.compile(r"[a-z]+|\d+")


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name or "" for what is no element, whether it ends one, marks), from left to right in one pass.

    A tag whose quotes leave it open up to the end of the page ends at its next > instead, and
    from there quotes no longer count on that page; without any > left, the rest is text. So
    each place is passed a bounded number of times, however broken the page is.
    """
    at, quotes = 0, True
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        named = _NAME.match(page, at)
        if named is None and page[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            continue
        end = -1
        if named and quotes:
            if m := _MARKS.match(page, named.end()):
                end = m.end()
            else:
                quotes = False
        if end < 0:
            end = page.find(">", named.end() if named else at) + 1
            if not end:
                return
        if named is None:
            yield at, end, "", False, ""
            at = end
            continue
        name, closing = named[1].lower(), page[at + 1] == "/"
        marks = page[named.end() : end - 1]
        if not closing and name in _RAW_END:
            m = _RAW_END[name].search(page, end)
            end, name = m.end() if m else len(page), ""
        elif not closing and name in _MEDIA_NEXT:
            if not marks.endswith("/"):
                m = _MEDIA_NEXT[name].search(page, end)
                if not (m and m[1]):
                    m = _BLOCK.search(page, end)
                    end = m.start() if m else len(page)
                else:
                    end = m.end()
            name = ""
        yield at, end, name, closing, marks
        at = end


def names_in(marks: str) -> str:
    """The words of a tag's class, id and role."""
    if not marks or not any(n in (low := marks.lower()) for n in _NAMING):
        return ""
    return " ".join(_PART.findall(" ".join(a or b or c for name, a, b, c in _ONE_MARK.findall(low) if name in _NAMING)))


class Paths:
    """Open elements with their ancestors, each as a number; 0 is the page itself."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple[int, str, str], int] = {}
        self.parent = [-1]
        self.inherited: list[frozenset[int]] = [frozenset()]
        self.features: list[frozenset[int]] = [frozenset({_hash("depth0")})]

    def child(self, parent: int, tag: str, names: str) -> int:
        key = parent, tag, names
        if (n := self.known.get(key)) is None:
            n = self.known[key] = len(self.parent)
            above, own = self.inherited[parent], {_hash(f"in {tag}"), *(_hash(f"named {w}") for w in names.split())}
            above = above if own <= above else above | own
            self.parent.append(parent)
            self.inherited.append(above)
            self.features.append(above | {_hash(f"own {tag}")})
        return n


@dataclass
class Block:
    """Text between block-level tags; path: the innermost open element, as a number of Paths."""

    path: int
    text: str
    linked: int


def blocks_of(page: str, paths: Paths) -> list[Block]:
    stack: list[tuple[str, int]] = [("", 0)]
    open_: Counter[str] = Counter()
    out: list[Block] = []
    text: list[str] = []
    linked, links, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                out.append(Block(stack[-1][1], " ".join(words), linked))
            text.clear()
        linked = 0

    for start, end, name, closing, marks in tokens(page):
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if links:
                linked += len(piece)
        at = end
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif name == "a":
                links = 0 if closing else 1
            continue
        flush()
        if closing:
            if open_[name]:
                while True:
                    other, _ = stack.pop()
                    open_[other] -= 1
                    if other == name:
                        break
        elif name not in VOID:
            if stack[-1][0] == "p" or name in CLOSES_ITSELF and stack[-1][0] == name:
                open_[stack.pop()[0]] -= 1
            if not marks.endswith("/"):
                stack.append((name, paths.child(stack[-1][1], name, names_in(marks))))
                open_[name] += 1
        links = 0
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) % WIDTH


def text_features(blocks: list[Block], paths: Paths) -> list[tuple[int, ...]]:
    """Of each block: length, share of link text, closing mark and sign of a rights line, in bins; then the neighbours' lengths and whether they share its place."""
    size = [0, *(min(len(b.text).bit_length(), 10) for b in blocks), 0]
    place = [paths.parent[b.path] if b.path else 0 for b in blocks]
    out = []
    for k, b in enumerate(blocks):
        n = len(b.text)
        out.append(
            (
                size[k + 1], min(4, 5 * b.linked // max(n, b.linked, 1)), ".!?\"'):;,".find(b.text[-1]) >= 0, "©" in b.text, size[k], size[k + 2],
                bool(k) and place[k - 1] == place[k], k + 1 < len(blocks) and place[k + 1] == place[k],
            )
        )
    return out


def _text_ids(values: tuple[int, ...]) -> set[int]:
    return {_hash(f"text {k} {int(v)}") for k, v in enumerate(values)}


@dataclass(frozen=True)
class Field:
    """weights: what each feature speaks for main text; moves[a, b]: from state a to b; start: of state 1."""

    weights: np.ndarray
    moves: np.ndarray
    start: float

    def decode(self, emissions: list[float]) -> list[int]:
        """The likeliest states (Viterbi), given what each block speaks for state 1."""
        if not emissions:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        zero, one, back = 0.0, self.start + emissions[0], []
        for e in emissions[1:]:
            from0, from1 = one + m10 > zero + m00, one + m11 > zero + m01
            zero, one = (one + m10 if from0 else zero + m00), (one + m11 if from1 else zero + m01) + e
            back.append((from0, from1))
        state = int(one > zero)
        states = [state]
        for step in reversed(back):
            state = int(step[state])
            states.append(state)
        return states[::-1]


def train(pages: list[tuple[list[set[int]], list[int]]], steps: int = 120, rate: float = 0.15, l2: float = 0.02) -> Field:
    """Maximum likelihood by forward-backward over all pages at once, with Adam."""
    longest = max(len(y) for _, y in pages)
    x = np.zeros((len(pages), longest, WIDTH), np.float32)
    y = np.zeros((len(pages), longest), np.int64)
    on = np.zeros((len(pages), longest), bool)
    for p, (features, labels) in enumerate(pages):
        for t, f in enumerate(features):
            x[p, t, list(f)] = 1.0
        y[p, : len(labels)], on[p, : len(labels)] = labels, True
    used = np.flatnonzero(x.any(axis=(0, 1)))
    x = x[:, :, used]
    w = np.zeros(len(used) + 5)
    m, v = np.zeros_like(w), np.zeros_like(w)
    pair = on[:, 1:]
    for step in range(1, steps + 1):
        moves, start = w[-5:-1].reshape(2, 2), w[-1]
        e = np.zeros((*y.shape, 2))
        e[:, :, 1] = x @ w[:-5].astype(np.float32)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0] + [0, start]
        for t in range(1, longest):
            step_in = np.logaddexp(forward[:, t - 1, None, 0] + moves[0], forward[:, t - 1, None, 1] + moves[1])
            forward[:, t] = np.where(on[:, t, None], step_in + e[:, t], forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = backward[:, t + 1] + e[:, t + 1]
            backward[:, t] = np.where(on[:, t + 1, None], np.logaddexp(moves[:, 0] + ahead[:, None, 0], moves[:, 1] + ahead[:, None, 1]), 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        one = np.where(on, np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]), 0.0)
        both = np.exp(
            forward[:, :-1, :, None] + moves[None, None] + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ) * pair[:, :, None, None]
        grad = np.empty_like(w)
        grad[:-5] = np.tensordot((one - y * on).astype(np.float32), x, axes=([0, 1], [0, 1]))
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        grad[-5:-1] = (both.sum(axis=(0, 1)) - seen).ravel()
        grad[-1] = (one[:, 0] - y[:, 0]).sum()
        grad = grad / len(pages) + l2 * w / 10
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(WIDTH)
    weights[used] = w[:-5]
    return Field(weights, w[-5:-1].reshape(2, 2).copy(), float(w[-1]))


# ---- labelled pages


class _Layout:
    """Lays out one page and notes the label of every text it places."""

    def __init__(self, seed: int, plain: float = 0.4):
        """plain: the share of pages whose main text has no telling wrapper."""
        self.rng = np.random.default_rng(seed)
        self.plain = plain
        self.main: set[str] = set()
        self.n = 0

    def pick(self, *options: str) -> str:
        return options[self.rng.integers(len(options))]

    def words(self, least: int, most: int) -> str:
        self.n += 1
        n = int(self.rng.integers(least, most + 1))
        sizes = self.rng.integers(2, 10, n)
        return " ".join("".join(chr(97 + c) for c in self.rng.integers(0, 26, s)) for s in sizes).capitalize() + f" q{self.n}"

    def text(self, least: int, most: int, main: bool, stop: float = 0.9) -> str:
        t = self.words(least, most) + ("." if self.rng.random() < stop else "")
        if main:
            self.main.add(t)
        return t

    def links(self, wrap: str = "li") -> str:
        return "".join(f'<{wrap}><a href="/{k}">{self.text(1, 3, False, 0.1)}</a></{wrap}>' for k in range(int(self.rng.integers(2, 8))))

    def paragraph(self) -> str:
        r = self.rng.random()
        t = self.text(1, 4, True) if r < 0.15 else self.text(5, 25, True) if r < 0.5 else self.text(25, 160, True)
        if self.rng.random() < 0.15:
            t = t.replace(" ", " <b>", 1) + "</b>"
        if self.rng.random() < 0.15:
            t = t.replace(" ", ' <a href="/x">', 1) + "</a>"
        return f"<p>{t}" + ("</p>" if self.rng.random() < 0.85 else "")

    def body(self) -> str:
        parts = [f"<h1>{self.text(2, 10, True, 0.3)}</h1>"] if self.rng.random() < 0.8 else []
        for _ in range(int(self.rng.integers(1, 9))):
            r = self.rng.random()
            if r < 0.76:
                parts.append(self.paragraph())
            elif r < 0.84:
                parts.append(f"<h{self.rng.integers(2, 4)}>{self.text(1, 6, True, 0.1)}</h2>")
            elif r < 0.9:
                parts.append("<ul>" + "".join(f"<li>{self.text(2, 20, True, 0.5)}</li>" for _ in range(3)) + "</ul>")
            elif r < 0.92:
                parts.append(f"<pre>{self.text(5, 60, True, 0.5)}</pre>")
            elif r < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{self.text(1, 6, True, 0.1)}</td><td>{self.text(1, 12, True, 0.2)}</td></tr>" for _ in range(3)) + "</table>")
            elif r < 0.96:
                parts.append(f"<blockquote><p>{self.text(5, 40, True)}</p></blockquote>")
            else:
                parts.append(f'<div class="{self.pick("ad", "advert", "promo", "ad-slot", "sponsored")}">{self.text(2, 20, False)}</div>')
        return "".join(parts)

    def boilerplate(self, place: str) -> str:
        t = self.text
        kinds = {
            "top": (
                lambda: f"<nav><ul>{self.links()}</ul></nav>",
                lambda: f'<div class="{self.pick("menu", "navbar", "nav main-nav", "navigation", "breadcrumb")}"><ul>{self.links()}</ul></div>',
                lambda: f'<header class="{self.pick("site-header", "page-header", "masthead", "top")}"><h1>{t(1, 3, False, 0)}</h1><p>{t(2, 9, False, 0.4)}</p></header>',
                lambda: f"<header><div>{t(1, 4, False, 0.2)}</div><nav>{self.links('span')}</nav></header>",
                lambda: f'<div class="{self.pick("cookie-notice", "cookie-banner", "notice", "consent", "alert banner", "gdpr")}"><p>{t(6, 40, False)}</p><button>{t(1, 2, False, 0)}</button></div>',
                lambda: f'<div class="{self.pick("ad", "ads", "advert", "advertisement", "banner-ad", "sponsor")}">{t(1, 25, False)}</div>',
                lambda: f'<form class="{self.pick("search", "login", "")}"><label>{t(1, 3, False, 0)}</label><input name="q"><button>{t(1, 2, False, 0)}</button></form>',
            ),
            "bottom": (
                lambda: f"<footer>&copy; {t(1, 20, False)}</footer>",
                lambda: f'<footer class="{self.pick("site-footer", "page-footer", "")}"><p>{t(3, 30, False)}</p><ul>{self.links()}</ul></footer>',
                lambda: f'<div class="{self.pick("footer", "foot", "copyright", "legal")}"><p>&copy; {t(3, 25, False)}</p></div>',
                lambda: f'<aside class="{self.pick("sidebar", "side", "")}"><h3>{t(1, 4, False, 0)}</h3><p>{t(4, 40, False)}</p><ul>{self.links()}</ul></aside>',
                lambda: f'<div class="{self.pick("sidebar", "widget", "right-rail", "related", "recommended", "share", "social", "newsletter", "subscribe")}"><h4>{t(1, 4, False, 0)}</h4><p>{t(3, 30, False)}</p></div>',
                lambda: f'<section class="{self.pick("comments", "comment-list", "discussion", "responses")}"><h3>{t(1, 3, False, 0)}</h3>'
                + "".join(f'<div class="comment"><p>{t(3, 50, False)}</p></div>' for _ in range(int(self.rng.integers(1, 5)))) + "</section>",
                lambda: f'<div id="{self.pick("comments", "disqus", "comments-area", "reader-comments")}"><ul>' + "".join(f"<li><p>{t(3, 50, False)}</p></li>" for _ in range(3)) + "</ul></div>",
                lambda: f'<form action="/post"><p>{t(2, 12, False)}</p><input type="text"></form>',
                lambda: f'<div class="{self.pick("ad", "ads", "advert", "sponsored")}"><p>{t(2, 25, False)}</p></div>',
            ),
        }[place]
        n = int(self.rng.integers(1, 4))
        return "".join(kinds[k]() for k in self.rng.choice(len(kinds), n, replace=False))

    def name(self) -> str:
        """A class that says nothing."""
        return "".join(chr(97 + c) for c in self.rng.integers(0, 26, self.rng.integers(1, 8))) + self.pick("", "", "-1", "12", "_x")

    def plain_wrapper(self) -> tuple[str, str]:
        """Wrappers without telling names, nested, at times a layout table."""
        open_, close = "", ""
        for _ in range(int(self.rng.integers(1, 4))):
            tag = self.pick("div", "div", "div", "section", "td")
            marks = self.pick("", f' class="{self.name()}"', f' class="{self.name()} {self.name()}"', f' id="{self.name()}"')
            one, end = (f"<table><tr><td{marks}>", "</td></tr></table>") if tag == "td" else (f"<{tag}{marks}>", f"</{tag}>")
            open_, close = open_ + one, end + close
        return open_, close

    def page(self) -> str:
        head = f"<head><meta charset='utf-8'><title>{self.text(2, 10, False, 0.3)}</title><style>p{{}}</style></head>" if self.rng.random() < 0.9 else ""
        open_, close = (
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"),
            ('<div class="content">', "</div>"), ('<div class="post-body entry">', "</div>"), ('<div id="story">', "</div>"),
            ('<article class="post">', "</article>"), ('<div id="main"><div class="article-body">', "</div></div>"), ('<section class="article">', "</section>"),
        )[self.rng.integers(10)]
        if self.plain and self.rng.random() < self.plain:
            open_, close = self.plain_wrapper()
        inside = self.boilerplate("bottom") if self.rng.random() < 0.15 else ""
        return f"<html>{head}<body>{self.boilerplate('top')}{open_}{self.body()}{inside}{close}{self.boilerplate('bottom')}</body></html>"


def labelled_pages(n: int = 320) -> list[tuple[str, set[str]]]:
    """(html, texts of its main blocks) of n laid out pages; the same at every call."""
    out = []
    for seed in range(n):
        layout = _Layout(seed)
        out.append((layout.page(), layout.main))
    return out


def sequences(pages: list[tuple[str, set[str]]]) -> list[tuple[list[set[int]], list[int]]]:
    """Feature sets and labels of the blocks of labelled pages."""
    out, paths = [], Paths()
    for page, main in pages:
        blocks = blocks_of(page, paths)
        said = text_features(blocks, paths)
        out.append(([paths.features[b.path] | _text_ids(w) for b, w in zip(blocks, said)], [int(b.text in main) for b in blocks]))
    return [p for p in out if p[1]]


def fit(n_pages: int = 320) -> Field:
    return train(sequences(labelled_pages(n_pages)))


class Extractor:
    """A trained field with its sums of weights remembered by path and by text features."""

    def __init__(self, model: Field):
        self.model, self.paths, self.places, self.texts = model, Paths(), {}, {}

    def _sum(self, memo: dict, key, ids) -> float:
        if len(memo) > _MEMO:
            memo.clear()
        value = memo[key] = float(self.model.weights[sorted(ids)].sum())
        return value

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        if len(self.paths.parent) > _MEMO:
            self.paths.clear()
        blocks = blocks_of(page, self.paths)
        emissions = []
        for b, words in zip(blocks, text_features(blocks, self.paths)):
            features = self.paths.features[b.path]
            here = self.places.get(features)
            if here is None:
                here = self._sum(self.places, features, features)
            own = self.texts.get(words)
            if own is None:
                own = self._sum(self.texts, words, _text_ids(words))
            emissions.append(here + own)
        return " ".join(b.text for b, s in zip(blocks, self.model.decode(emissions)) if s)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    model = model or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(model)
        for b in batches:
            texts = [extractor.text(p) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
