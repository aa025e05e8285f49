"""Main-text extraction: a linear-chain CRF over the leaf blocks of a page's DOM.

A tolerant tokenizer walks the markup once, keeps the stack of open elements and cuts
the page into leaf blocks: runs of text between block-level tags. Scripts, styles,
comments, declarations and elements that are not shown are dropped on the way, also from
the middle of a block. What an element inherits is a state shared by all elements alike,
so time and memory are linear in the page, however deep it is nested. Each block
has features of its ancestors (tags, words of class, id and role) and of its text
(length, share of link text, punctuation, place). The CRF labels blocks as content or
not; it is trained by gradient ascent in numpy on generated labelled pages of many
layouts and decoded by Viterbi, exactly.

A block's ancestors are those of its first shown text. Text of kept blocks: character references decoded, white space inside a block turned
into one space, trimmed, blocks joined by a newline in page order. A null or empty page,
or one without content, gives an empty text. A tag cut off by the page's end is dropped.
Repeated rows are treated alike; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_of, small_batches

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z)) | <!\[CDATA\[.*?(?:\]\]>|\Z) | <[!?][^>]*+(?:>|\Z)
    | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    | </?(?P<torn>[a-zA-Z])[^>]*+(?:>|\Z) | </?\Z | (?P<text>[^<]++|<)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""(?<![a-zA-Z-])(?:([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))|(hidden)(?![a-zA-Z-]))""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")

#: Fixed values of HTML: elements by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style title textarea noscript template svg iframe object select canvas audio video head".split())
RAW = frozenset("script style title textarea iframe".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
IN_HEAD = frozenset("base basefont bgsound html link meta noframes noscript script style template title".split())
SCOPE = frozenset("ul ol dl table menu div article section body main aside nav td th blockquote form button caption noscript object select svg template".split())


#: Elements that are features by name; all others share one.
NAMED = BLOCK | HIDDEN | frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q s samp small span strike strong sub sup time tt u var wbr".split())


class State:
    """What an element and its ancestors amount to; elements alike in it share one."""

    __slots__ = ("marks", "leaf", "main", "header", "inner", "hidden", "below", "features")

    def __init__(self, marks: frozenset, leaf: str, main: bool, header: bool, inner: bool, hidden: bool):
        self.marks, self.leaf, self.main, self.header, self.inner, self.hidden = marks, leaf, main, header, inner, hidden
        self.below: dict[tuple, State] = {}
        self.features: list[str] | None = None

    def key(self) -> tuple:
        return self.marks, self.leaf, self.main, self.header, self.inner, self.hidden

    def child(self, tag: str, attr: str) -> State:
        """The state of an element in this one."""
        words = words_of_attributes(attr) if attr and not attr.isspace() else ()
        found = self.below.get((tag, words))
        if found is None:
            marks = {f"in:{tag if tag in NAMED else 'other'}"}
            for w in words:
                if w == "hidden":
                    marks.add("hidden")
                elif w in GROUP:
                    marks |= {f"group:{GROUP[w]}", f"word:{w}"}
            new = State(
                self.marks if marks <= self.marks else self.marks | marks, tag if tag in BLOCK else self.leaf, self.main or tag in ("article", "main"), self.header or tag == "header",
                self.inner or tag == "header" and self.main and not self.header, self.hidden or tag in HIDDEN or NOT_SHOWN in words,
            )
            found = self.below[tag, words] = _STATES.setdefault(new.key(), new)
        return found


_STATES: dict[tuple, State] = {}
NOT_SHOWN = "not shown"


def root_state() -> State:
    """The state above all elements; states are forgotten where too many have come together."""
    if len(_STATES) > 20_000:
        _STATES.clear()
    new = State(frozenset(), "", False, False, False, False)
    return _STATES.setdefault(new.key(), new)


class Block:
    __slots__ = ("state", "parts", "linked", "size", "text")

    def __init__(self, state: State):
        self.state, self.parts, self.linked, self.size, self.text = state, [], 0, 0, ""


@lru_cache(maxsize=20_000)
def words_of_attributes(attr: str) -> tuple[str, ...]:
    """Known lower-case words of class, id and role, ``hidden`` of an element for the eye only, ``not shown`` of one that is not displayed."""
    out = set()
    for name, a, b, c, bare in _ATTR.findall(attr):
        value, name = a or b or c, name.lower()
        if bare or name == "hidden" or name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.add(NOT_SHOWN)
        elif name == "aria-hidden" and value == "true":
            out.add("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            out |= {w.lower() for w in _WORD.findall(value)} & GROUP.keys()
    return tuple(sorted(out))


class Stack:
    """Open elements, with the places of each tag, of block elements and of those that end a search."""

    def __init__(self):
        self.tags: list[str] = []
        self.states = [root_state()]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def last(self, tag: str) -> int:
        held = self.at.get(tag)
        return held[-1] if held else -1

    def push(self, tag: str, attr: str) -> None:
        k = len(self.tags)
        self.tags.append(tag)
        self.states.append(self.states[-1].child(tag, attr))
        self.at.setdefault(tag, []).append(k)
        if tag in BLOCK:
            self.blocks.append(k)
        if tag in SCOPE:
            self.scopes.append(k)

    def close(self, k: int) -> None:
        """Close element ``k`` and all in it."""
        while len(self.tags) > k:
            self.at[self.tags.pop()].pop()
            self.states.pop()
        for held in (self.blocks, self.scopes):
            while held and held[-1] >= k:
                held.pop()

    def imply(self, tag: str) -> None:
        """Close what a block-level start tag ends: a paragraph, or an item of its own kind."""
        k = max(self.last(t) for t in ("p", *CLOSES.get(tag, ())))
        if k >= 0 and k >= (self.scopes[-1] if self.scopes else -1):
            self.close(k)

    def end(self, tag: str) -> None:
        k = self.last(tag)
        if k >= 0 and (tag in BLOCK or tag in HIDDEN or k > (self.blocks[-1] if self.blocks else -1)):
            self.close(k)


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order."""
    page = page or ""
    stack = Stack()
    out: list[Block] = []
    now: Block | None = None
    at = 0
    scan = _TOKEN.match
    size = len(page)
    while at < size:
        m = scan(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            if stack.last("head") >= 0 and not text.isspace():
                stack.close(stack.last("head"))
            state = stack.states[-1]
            if state.hidden:
                continue
            if now is None:
                if text.isspace():
                    continue
                now = Block(state)
                out.append(now)
            now.parts.append(text)
            now.size += len(text)
            if stack.last("a") >= 0:
                now.linked += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in BLOCK and not stack.states[-1].hidden:
                now = None
            stack.end(tag)
            continue
        if stack.last("head") >= 0 and tag not in IN_HEAD:
            stack.close(stack.last("head"))
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", close.end()) + 1 if close else 0
            at = at or size
            continue
        if tag == "br":
            if now:
                now.parts.append(" ")
            continue
        if tag in BLOCK:
            now = now if stack.states[-1].hidden else None
            stack.imply(tag)
        attr = m["attr"]
        if tag not in VOID and not attr.endswith("/"):
            stack.push(tag, attr)
    kept = []
    for b in out:
        text = "".join(b.parts)
        b.text = _SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()
        if b.text:
            kept.append(b)
    return kept


# --- features ---------------------------------------------------------------------

#: Words of class and id names that pages commonly use for each purpose.
NAMES = {
    "advert": "ad ads adv advert advertisement adsbygoogle sponsor sponsored promo promotion banner dfp".split(),
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toolbar topbar skip tabs toc".split(),
    "aside": "sidebar aside widget related recommended trending popular more rail teaser".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay disclaimer toast message privacy".split(),
    "form": "form newsletter subscribe signup login search register contact input".split(),
    "comment": "comment comments commentlist reply replies discussion disqus respond".split(),
    "edge": "header footer masthead logo copyright colophon legal bottom social share sharing byline meta tags author".split(),
    "body": "article content post entry story main body text prose markdown page".split(),
}
GROUP = {w: g for g, words in NAMES.items() for w in words}
NOISE = frozenset([f"group:{g}" for g in NAMES if g != "body"] + [f"in:{t}" for t in "nav aside footer form button label menu".split()] + ["hidden"])


def path_features(state: State) -> list[str]:
    if state.features is None:
        out = set(state.marks)
        out.add(f"leaf:{state.leaf}")
        if state.leaf in ("h1", "h2", "h3", "h4", "h5", "h6"):
            out.add("heading")
        if state.main:
            out.add("inside")
        if state.inner:
            out.add("inner header")
        elif state.header and not state.main:
            out.add("outer header")
        noise = bool(out & NOISE) or state.header and not state.inner
        out.add(f"noise:{noise} inside:{state.main} body:{'group:body' in out}")
        state.features = sorted(out)
    return state.features


def text_features(b: Block, i: int, n: int) -> list[str]:
    t, words = b.text, b.text.count(" ") + 1
    share = b.linked / max(1, b.size)
    return [
        f"words:{min(7, words.bit_length())}",
        f"links:{0 if share == 0 else 1 if share < 0.5 else 2}",
        f"stop:{t[-1] in '.!?:;…»”'}",
        f"copy:{t[0] == '©'}",
        "place:first" if i == 0 else "place:last" if i == n - 1 else "place:mid",
        "always",
    ]


# --- labelled pages -----------------------------------------------------------------

_MARK = "\ue000"
_PARTS = "th er on an re in ti es of eau le que aux un der sch ung keit ver ó ción ado rr é ü".split()


def labelled_page(r: Random) -> str:
    """A generated page; every content block holds one private-use mark."""

    def word() -> str:
        w = "".join(r.choices(_PARTS, k=r.randint(1, 3)))
        return w + r.choice(["", "", "", "", "", ",", "&amp;", "***"])

    def prose(n: int) -> str:
        return " ".join(word() for _ in range(n)).capitalize() + r.choice([".", ".", ".", "!", "?", ""])

    def content(a: int, b: int) -> str:
        return _MARK + prose(r.randint(a, b))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{prose(r.randint(1, 3))}</a></li>' for _ in range(n))

    def name(kind: str) -> str:
        w = r.choice(NAMES[kind])
        return r.choice([f'class="{w}"', f'id="{w}"', f'class="{r.choice(["box", "col", "site", "js"])}-{w}"', f'class="{w} {r.choice(["wide", "left", "dark"])}"'])

    def noise(kind: str) -> str:
        n = r.randint
        if kind == "menu":
            return r.choice([f"<nav><ul>{links(n(2, 8))}</ul></nav>", f"<div {name('menu')}><ul>{links(n(2, 8))}</ul></div>", f'<div role="navigation">{prose(2)} | <a href="#">{prose(1)}</a></div>'])
        if kind == "aside":
            return r.choice([f"<aside><h3>{prose(2)}</h3><p>{prose(n(3, 40))}</p><ul>{links(n(1, 4))}</ul></aside>", f"<div {name('aside')}><h4>{prose(2)}</h4><p>{prose(n(2, 40))}</p></div>"])
        if kind == "comment":
            inner = "".join(f"<li><p>{prose(n(2, 40))}</p></li>" for _ in range(n(1, 3)))
            return r.choice([f"<section {name('comment')}><h3>{prose(2)}</h3><ol>{inner}</ol></section>", f"<div {name('comment')}><p>{prose(n(2, 50))}</p><div {name('comment')}>{prose(n(2, 30))}</div></div>"])
        if kind == "form":
            return r.choice([f'<form action="/s"><label>{prose(2)}</label><input name="q"><button>{prose(1)}</button></form>', f"<div {name('form')}><p>{prose(n(3, 25))}</p><form><input><button>{prose(1)}</button></form></div>"])
        if kind == "footer":
            return r.choice([f"<footer>&copy; {word()}.example.com &middot; {prose(n(2, 12))}</footer>", f"<footer><p>{prose(n(2, 30))}</p><ul>{links(3)}</ul></footer>", f"<div {name('edge')}><p>&copy; {n(1990, 2030)} {prose(n(2, 20))}</p></div>"])
        if kind == "header":
            return r.choice([f'<header><a href="/">{prose(2)}</a><p>{prose(n(2, 9))}</p></header>', f"<header><h1>{prose(2)}</h1></header>", f"<div {name('edge')}>{prose(n(1, 8))}</div>"])
        if kind == "hidden":
            return f'<div style="display:none">{prose(n(2, 30))}</div>'
        return r.choice([f"<div {name(kind)}>{prose(n(2, 40))}</div>", f"<div {name(kind)}><p>{prose(n(2, 60))}</p><a href='#'>{prose(1)}</a></div>", f"<section {name(kind)}><p>{prose(n(2, 40))}</p></section>"])

    def body() -> str:
        out = [f"<h1>{content(2, 12)}</h1>" if r.random() < 0.8 else f"<header><h1>{content(2, 12)}</h1></header>"]
        for _ in range(r.randint(1, 9)):
            x = r.random()
            if x < 0.55:
                out.append(f"<p>{content(1, 90)}</p>")
            elif x < 0.62:
                out.append(f"<p><b>{content(1, 40)}<br>")
            elif x < 0.69:
                out.append(f"<h{(k := r.randint(2, 4))}>{content(1, 9)}</h{k}>")
            elif x < 0.76:
                out.append("<ul>" + "".join(f"<li>{content(1, 20)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif x < 0.80:
                out.append(f"<blockquote>{content(3, 40)}</blockquote>")
            elif x < 0.84:
                out.append("<table>" + "".join(f"<tr><td>{content(1, 4)}</td><td>{content(1, 4)}</td></tr>" for _ in range(2)) + "</table>")
            elif x < 0.88:
                out.append(f'<figure><img src="x.png"><figcaption>{content(2, 20)}</figcaption></figure>')
            elif x < 0.92:
                out.append(f'<p>{content(3, 30)} <a href="/x">{word()}</a> {prose(4)}</p>')
            else:
                out.append(noise(r.choice(["advert", "advert", "aside", "form", "notice"])))
        return "".join(out)

    inner = body()
    shell = r.choice(["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", "<div {n}>{}</div>", "<div {n}><div {n}>{}</div></div>", "<section {n}>{}</section>", "<div>{}</div>"])
    shell = shell.replace("{n}", name("body"))
    before = [noise(k) for k in r.sample(["header", "menu", "notice", "advert", "form", "hidden", "menu"], r.randint(1, 4))]
    after = [noise(k) for k in r.sample(["comment", "aside", "form", "advert", "menu", "notice", "hidden"], r.randint(0, 4))]
    if r.random() < 0.9:
        after.append(noise("footer"))
    page = "".join(before) + shell.replace("{}", inner) + "".join(after)
    return f"<!DOCTYPE html><html><head><title>{prose(4)}</title></head><body>{page}</body></html>"


# --- the chain ----------------------------------------------------------------------


class Chain:
    """Weights of features for content against the rest, and of the four transitions."""

    def __init__(self, weights: dict[str, float], trans: np.ndarray, start: np.ndarray):
        self.w, self.trans, self.start = weights, trans, start
        self.paths: dict[State, float] = {}

    def emit(self, b: Block, i: int, n: int) -> float:
        p = self.paths.get(b.state)
        if p is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            p = self.paths[b.state] = sum(self.w.get(f, 0.0) for f in path_features(b.state))
        return p + sum(self.w.get(f, 0.0) for f in text_features(b, i, n))

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi labels; ties go to the rest."""
        if not blocks:
            return []
        (aa, ab), (ba, bb) = self.trans.tolist()
        n, back = len(blocks), []
        s0, s1 = float(self.start[0]), float(self.start[1]) + self.emit(blocks[0], 0, n)
        for i in range(1, n):
            e = self.emit(blocks[i], i, n)
            to0, to1 = (s0 + aa, s1 + ba), (s0 + ab, s1 + bb)
            back.append((to0[1] > to0[0], to1[1] > to1[0]))
            s0, s1 = max(to0), max(to1) + e
        label = s1 > s0
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


@lru_cache(maxsize=2)
def train(pages: int = 1000, rounds: int = 250, seed: int = 8) -> Chain:
    """Maximum likelihood with a small Gaussian prior, by Adam over all generated pages."""
    r = Random(seed)
    docs = [blocks_of(labelled_page(r)) for _ in range(pages)]
    index: dict[str, int] = {}
    long = max(len(d) for d in docs)
    rows, cols, lab, live = [], [], np.zeros((pages, long)), np.zeros((pages, long))
    for k, d in enumerate(docs):
        for i, b in enumerate(d):
            lab[k, i], live[k, i] = _MARK in b.text, 1
            b.text = b.text.replace(_MARK, "") or "x"
            for f in [*path_features(b.state), *text_features(b, i, len(d))]:
                rows.append(k * long + i)
                cols.append(index.setdefault(f, len(index)))
    rows, cols = np.array(rows), np.array(cols)
    w, trans, start = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
    params = [w, trans, start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    both = np.stack([1 - lab, lab], axis=2)
    for step in range(1, rounds + 1):
        e = np.zeros((pages, long, 2))
        e[:, :, 1] = np.bincount(rows, w[cols], pages * long).reshape(pages, long)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, long):
            nxt = np.logaddexp(alpha[:, t - 1, :1] + trans[0], alpha[:, t - 1, 1:] + trans[1]) + e[:, t]
            alpha[:, t] = np.where(live[:, t, None] > 0, nxt, alpha[:, t - 1])
        for t in range(long - 2, -1, -1):
            x = e[:, t + 1] + beta[:, t + 1]
            nxt = np.logaddexp(x[:, :1] + trans[:, 0], x[:, 1:] + trans[:, 1])
            beta[:, t] = np.where(live[:, t + 1, None] > 0, nxt, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        g = [np.bincount(cols, ((lab - p[:, :, 1]) * live).ravel()[rows], len(index)) / pages, np.zeros((2, 2)), (both - p)[:, 0].mean(axis=0)]
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(alpha[:, :-1, a] + trans[a, b] + e[:, 1:, b] + beta[:, 1:, b] - z[:, None])
                g[1][a, b] = ((both[:, :-1, a] * both[:, 1:, b] - pair) * live[:, 1:]).sum() / pages
        for k, q in enumerate(params):
            d = g[k] - 5e-5 * q
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d**2
            q += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Chain(dict(zip(index, w.tolist())), trans, start)


def main_text(page: str | None, chain: Chain) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, keep in zip(blocks, chain.decode(blocks)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    spark = pages.sparkSession
    small_batches(spark)
    chain = train()
    held = spark.sparkContext.broadcast((chain.w, chain.trans, chain.start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Chain(*held.value)
        for b in batches:
            texts = [main_text(x, c) for x in ids_of(b, "html")]
            cols = [pa.array(ids_of(b, "page_id"), pa.int64()), b.column(b.schema.get_field_index("url")), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
