"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags, with inline tags left out.  Each
block is a vector of hashed tag path (tags with their classes and ids, from the root), hashed words
and a few measures (length, share of link text, place in the page).  A bidirectional LSTM in numpy
reads the vectors in page order and gives each block the probability of being main text, so every
decision sees the blocks before and after it.  Blocks from 0.5 on make the text.

There are no hand-made labels.  The model is trained on at most ``SAMPLE`` pages (those with the
smallest hash of page_id, one row each, of at most ``SAMPLE_BYTES``) whose markup says what a block is:
inside article or main, and not in a menu, header, footer, sidebar, notice, advert, form or comment
section.  In training, a part of the pages has the telling tags of its paths replaced by div, so that
the words, the measures and the context must carry the label too.  Where no page of the sample has an
article or main, blocks outside such sections that are long enough and not mostly links teach instead.

Scripts, styles, comments, titles and other content that is no text never become blocks.  The head
ends where the first body element or text starts, whether or not its tags are there.  Only script and
style reach to the end of the page when their end tag is missing; of other such elements nothing is
skipped, but for the words that follow a title up to the next tag.
Inference sorts a batch's pages by length and pads only among neighbours.

Cutting a page takes time in proportion to its length: a tag's end is found once, what is behind the
last end of a tag is text, and nested elements share their paths.

Defined cases: a null or empty html, and a page without main text, give an empty text with 0
characters; rows that repeat are extracted alike; unclosed and stray tags end with the block or
element around them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from postlens.llm.wordhash import U, word_pieces
from postlens.session import ship

SAMPLE = 300                       # pages that the labeller learns from
SAMPLE_BYTES = 1 << 20
PLAIN_CHARS, PLAIN_LINKED = 40, 0.5          # a block that teaches without article or main
PATH, WORDS, MEASURES = 32, 32, 5
INPUT = PATH + WORDS + MEASURES
HIDDEN = 16
EPOCHS = 6
BATCH = 20

# fixed values: names in HTML
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style")
SKIP = ("title", "noscript", "template", "svg", "iframe", "object", "textarea", "select")
CLOSED_BY = {"p": frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 section article footer header nav aside form pre blockquote main".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
MAIN = re.compile(r"^(article|main)\b")
ASIDE = re.compile(r"^(?i:nav|header|footer|aside|form|menu|button|dialog|fieldset)\b|[.#](?:[\w-]*(?:[-_]|(?<=[a-z0-9])(?=[A-Z])))?"
                   r"(?i:(?:ad|ads|advert\w*|banner|cookie|consent|notice|promo|sidebar|menu|nav|footer|header|comments?|share|social|related|breadcrumbs?)(?![a-z]))")

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"(?:^|\s)(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW}
_SKIP_TAG = {x: re.compile(rf"<(/?){x}(?=[\s/>])", re.I) for x in SKIP}
_STOP = re.compile(r"[>\"']")


class Path:
    """The open elements of a block: its own and, through ``above``, those around it."""

    __slots__ = ("above", "name", "main", "aside", "vector", "hidden")

    def __init__(self, above: Path | None, name: str):
        self.above, self.name = above, name
        self.main = bool(above and above.main) or bool(MAIN.search(name))
        self.aside = bool(above and above.aside) or bool(ASIDE.search(name))
        self.vector = self.hidden = None

    def names(self) -> tuple[str, ...]:
        out, at = [], self
        while at.above is not None:
            out.append(at.name)
            at = at.above
        return tuple(reversed(out))


@dataclass
class Block:
    path: Path
    text: str
    linked: int                    # characters inside links


class Tags:
    """Where the tags of a page end: at the first > outside quotes.  A quote that is never closed is no
    quote; after a tag that would have no end, quotes count for nothing."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.quotes = True

    def end(self, at: int) -> int:
        """Place behind the > of the tag at ``at``, or -1."""
        if at > self.last[">"]:
            return -1
        k = at
        while self.quotes:
            m = _STOP.search(self.page, k)
            if m is None:
                self.quotes = False
            elif m.group() == ">":
                return m.end()
            else:
                k = m.end()
                if self.last[m.group()] >= k:
                    k = self.page.find(m.group(), k) + 1
        return self.page.find(">", at) + 1


def ends(page: str, name: str, tags: Tags) -> dict[int, int]:
    """Where each element ``name`` that has an end tag starts, and where that end tag does."""
    out, open_ = {}, []
    for m in _SKIP_TAG[name].finditer(page):
        if m.group(1):
            if open_:
                out[open_.pop()] = m.start()
        else:
            end = tags.end(m.end())
            if end > 0 and not page[m.end():end - 1].rstrip().endswith("/"):
                open_.append(m.start())
    return out


def blocks(page: str) -> list[Block]:
    """Blocks with text of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []             # (tag, path up to it; inline tags have that around them)
    open_: dict[str, int] = {}                     # how many of each tag are in the stack
    root = Path(None, "")
    parts: list[str] = []
    linked = links = 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1][1] if stack else root, text, linked))
        parts, linked = [], 0

    def pop():
        open_[stack.pop()[0]] -= 1

    tags, at, closed = Tags(page), 0, {}
    while at < len(page):
        start = page.find("<", at)
        if start != at:
            start = len(page) if start < 0 else start
            parts.append(page[at:start])
            linked += (start - at) * bool(links)
            at = start
            continue
        if page.startswith("<!--", at):
            at = page.find("-->", at) + 3 if page.find("-->", at) >= 0 else len(page)
            continue
        m = _NAME.match(page, at)
        end = tags.end(m.end()) if m else page.find(">", at) + 1 if page[at + 1:at + 2] in ("!", "?", "/") and at < tags.last[">"] else 0
        if end <= 0:
            parts.append("<")
            linked += bool(links)
            at += 1
            continue
        begin, at = at, end
        if m is None:
            continue
        name, rest = m.group(2).lower(), page[m.end():end - 1]
        if m.group(1):
            if name in INLINE:
                links -= name == "a" and links > 0
            else:
                flush()
            if open_.get(name):
                if name in INLINE:
                    k = len(stack) - 1
                    while stack[k][0] != name and stack[k][0] in INLINE:
                        k -= 1
                    if stack[k][0] == name:
                        while len(stack) > k:
                            pop()
                else:
                    while stack[-1][0] != name:
                        pop()
                    pop()
            continue
        if name in RAW:
            flush()
            stop = _RAW_END[name].search(page, at)
            at = stop.start() if stop else len(page)
            continue
        if name in SKIP:
            flush()
            if name not in closed:
                closed[name] = ends(page, name, tags)
            stop = closed[name].get(begin, -1)
            if stop < 0 and name == "title":
                stop = page.find("<", at)
            at = max(at, stop)
            continue
        if name == "head":
            flush()
            continue
        if name in VOID:
            if name in ("br", "hr", "wbr"):
                parts.append(" " if name != "wbr" else "")
            continue
        if name in INLINE:
            links += name == "a"
        else:
            flush()
            links = 0
            while stack and stack[-1][0] in INLINE:
                pop()
            while stack and name in CLOSED_BY.get(stack[-1][0], ()):
                pop()
                while stack and stack[-1][0] in INLINE:
                    pop()
        if not rest.rstrip().endswith("/"):
            above = stack[-1][1] if stack else root
            if name not in INLINE:
                marks = "".join(("." if a.lower() == "class" else "#") + v for a, *vs in _ATTR.findall(rest) for v in "".join(vs).split())
                above = Path(above, name + marks)
            stack.append((name, above))
            open_[name] = open_.get(name, 0) + 1
    flush()
    return out


def label(b: Block) -> int:
    """What the page's own markup says."""
    return int(b.path.main and not b.path.aside)


def plain_label(b: Block) -> int:
    """What length, links and the names of sections say, where there is no article or main."""
    return int(not b.path.aside and len(b.text) >= PLAIN_CHARS and b.linked < PLAIN_LINKED * len(b.text))


def _slot(name: str) -> tuple[int, float]:
    h = zlib.crc32(name.encode())
    return h % PATH, 1.0 if h >> 16 & 1 else -1.0


def hidden_name(x: str) -> str:
    """The element without what tells: semantic tags as div, no classes."""
    return "div" if MAIN.search(x) or ASIDE.search(x) or "." in x or "#" in x else x


def path_vector(path: Path, hidden: bool = False) -> np.ndarray:
    """Signed hashes of the tags on a path, with and without classes and ids; kept on the path, so that
    nested elements add one tag each."""
    kept = "hidden" if hidden else "vector"
    todo, at = [], path
    while at.above is not None and getattr(at, kept) is None:
        todo.append(at)
        at = at.above
    v = getattr(at, kept) if at.above is not None else np.zeros(PATH, np.float32)
    for at in reversed(todo):
        v = v.copy()
        part = hidden_name(at.name) if hidden else at.name
        for name in sorted({part, part.split(".")[0].split("#")[0]}):
            s, sign = _slot(name)
            v[s] += sign
        setattr(at, kept, v)
    return v


def vectors(pages: list[list[Block]], hidden: bool = False) -> list[np.ndarray]:
    """(blocks, INPUT) of each page; ``hidden``: the paths don't tell."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), INPUT), np.float32)
    if flat:
        for piece in word_pieces(pa.array([b.text for b in flat], pa.large_string()), lower=True, strip=True):
            h = piece.hash
            slot = PATH + (h % U(WORDS)).astype(np.int64)
            sign = np.where(h >> U(63), 1.0, -1.0)
            rows = piece.row + piece.doc_of()
            n = np.maximum(np.diff(piece.bounds), 1)
            np.add.at(x, (rows, slot), sign / np.sqrt(n)[piece.doc_of()])
    at = 0
    out = []
    for p in pages:
        for i, b in enumerate(p):
            x[at + i, :PATH] = path_vector(b.path, hidden)
            x[at + i, PATH + WORDS:] = (np.log1p(len(b.text)) / 6, b.linked / max(len(b.text), 1), i / max(len(p), 1), 1 / (i + 1), 1 / (len(p) - i))
        out.append(x[at:at + len(p)])
        at += len(p)
    return out


def _sig(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM and a logistic layer."""

    def __init__(self, seed: int = 7):
        r = np.random.RandomState(seed)
        s = 1 / np.sqrt(INPUT + HIDDEN)
        self.p = {}
        for d in "fb":
            self.p["W" + d] = r.normal(0, s, (INPUT + HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p["V"] = r.normal(0, 0.3, (2 * HIDDEN, 1))
        self.p["v"] = np.zeros(1)

    def _run(self, x, mask, d):
        """x (time, pages, INPUT), mask (time, pages): hidden states and what the gradient needs."""
        w, c = self.p["W" + d], self.p["c" + d]
        T, n, _ = x.shape
        h, cell = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        drive = x @ w[:INPUT] + c
        hs, saved = np.zeros((T, n, HIDDEN)), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            z = drive[t] + h @ w[INPUT:]
            i, f, o = _sig(z[:, :HIDDEN]), _sig(z[:, HIDDEN:2 * HIDDEN]), _sig(z[:, 2 * HIDDEN:3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            new = f * cell + i * g
            tc = np.tanh(new)
            saved.append((t, h, cell, i, f, o, g, tc, m))
            h, cell = np.where(m, o * tc, h), np.where(m, new, cell)
            hs[t] = h
        return hs, saved

    def forward(self, x, mask):
        hf, sf = self._run(x, mask, "f")
        hb, sb = self._run(x, mask, "b")
        both = np.concatenate([hf, hb], 2)
        return _sig((both @ self.p["V"])[:, :, 0] + self.p["v"]), both, (sf, sb)

    def gradient(self, x, mask, y):
        prob, both, (sf, sb) = self.forward(x, mask)
        d = (prob - y) * mask / max(mask.sum(), 1)
        g = {"V": np.tensordot(both, d, ((0, 1), (0, 1)))[:, None], "v": np.array([d.sum()])}
        back = d[:, :, None] * self.p["V"][:, 0]
        for k, saved, own in (("f", sf, back[:, :, :HIDDEN]), ("b", sb, back[:, :, HIDDEN:])):
            w = self.p["W" + k]
            gw, gc = np.zeros_like(w), np.zeros_like(self.p["c" + k])
            dh, dc = np.zeros_like(own[0]), np.zeros_like(own[0])
            for t, h, cell, i, f, o, gate, tc, m in reversed(saved):
                a = dh + own[t]
                hot = a * m
                c = (dc * m) + hot * o * (1 - tc ** 2)
                dz = np.concatenate([c * gate * i * (1 - i), c * cell * f * (1 - f), hot * tc * o * (1 - o), c * i * (1 - gate ** 2)], 1)
                gw += np.concatenate([x[t], h], 1).T @ dz
                gc += dz.sum(0)
                dh = np.where(m, dz @ w[INPUT:].T, a)
                dc = np.where(m, c * f, dc)
            g["W" + k], g["c" + k] = gw, gc
        return g

    def fit(self, data: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 11) -> None:
        r = np.random.RandomState(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(data))
            for a in range(0, len(order), BATCH):
                part = [data[i] for i in order[a:a + BATCH]]
                x, mask = padded([p[0] for p in part])
                y = np.zeros(mask.shape)
                for k, (_, t) in enumerate(part):
                    y[:len(t), k] = t
                step += 1
                for k, g in self.gradient(x, mask, y).items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - 0.02 * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)

    def label(self, pages: list[np.ndarray], together: int = 64) -> list[np.ndarray]:
        """Probability of each block of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        for a in range(0, len(order), together):
            part = [i for i in order[a:a + together] if len(pages[i])]
            if part:
                x, mask = padded([pages[i] for i in part])
                prob = self.forward(x, mask)[0]
                for k, i in enumerate(part):
                    out[i] = prob[:len(pages[i]), k]
        return out


def padded(pages: list[np.ndarray]):
    T = max(len(p) for p in pages)
    x, mask = np.zeros((T, len(pages), INPUT)), np.zeros((T, len(pages)), bool)
    for k, p in enumerate(pages):
        x[:len(p), k], mask[:len(p), k] = p, True
    return x, mask


def train(pages: DataFrame, bound: int = SAMPLE) -> Labeller:
    """Learn from at most ``bound`` pages; the shuffle ranks ids, and only the sample's html moves."""
    fit = pages.select("page_id", "html").where(F.col("page_id").isNotNull() & (F.octet_length("html") <= SAMPLE_BYTES))
    ids = fit.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(bound)
    rows = fit.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).collect()
    every = [p for p in (blocks(r["html"]) for r in sorted(rows, key=lambda r: r["page_id"])) if p]
    says = label if any(label(b) for p in every for b in p) else plain_label
    model = Labeller()
    cut = [p for p in every if any(says(b) for b in p)]
    if cut:
        y = [np.array([says(b) for b in p], float) for p in cut]
        masked = vectors(cut, hidden=True)
        data = list(zip(vectors(cut), y, strict=True)) + [d for k, d in enumerate(zip(masked, y, strict=True)) if k % 3 == 0]
        model.fit(data)
    return model


def main_text(pages: list[str], model: Labeller) -> list[str]:
    cut = [blocks(p) for p in pages]
    return [" ".join(b.text for b, q in zip(p, prob, strict=True) if q >= 0.5)
            for p, prob in zip(cut, model.label(vectors(cut)), strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    spark = pages.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(pages))

    @arrow_udf("string")
    def text(page: pa.Array) -> pa.Array:
        out = []
        for a in range(0, len(page), 256):
            out += main_text([p.as_py() or "" for p in page[a:a + 256]], model.value)
        return pa.array(out, pa.string())
    return (pages.select("page_id", "url", text("html").alias("text"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))
