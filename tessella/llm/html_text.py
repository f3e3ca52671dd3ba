"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with
its path of open elements.  A bidirectional LSTM in numpy reads, for the blocks
of a page in order, hashed path vectors (tags, class, id and role words), hashed
word vectors and a few shares, and labels every block with the whole page as its
context.  Blocks labelled main are the text.

Training is part of the operator: ``SAMPLE_PAGES`` pages (a documented bound,
taken by hash order) whose markup names its main part give weakly labelled
pages and the words for made-up layouts (menus, notices, adverts, forms,
sidebars and comments in and around the main part) with known labels.

Scale.  One narrow pass picks the sample; pages are then labelled where they are
read, in batches of bounded size, without a shuffle; the weights that travel are
about ten thousand numbers.

Defined results.  A null or empty page has no text.  Broken markup is read as
far as it goes: unclosed elements end with their parent.  Repeated rows each get
their row.  An empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.registry import query, table

SAMPLE_PAGES, MADE_UP_PAGES, HIDDEN, EPOCHS = 100, 400, 16, 6
PATH_DIMS, WORD_DIMS = 96, 24
DIMS = PATH_DIMS + WORD_DIMS + 6

_OPENED = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|([!?/]))")
_PLAIN = re.compile(r"[^>\"']*")
_RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "template", "iframe", "svg", "noscript")}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var br img wbr input".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = frozenset("ul ol dl table tbody select".split())
#: Of a block's ancestors the nearest so many make its path.
PATH_ELEMENTS = 64


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: tuple, text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


def _element(name: str, attrs: str) -> tuple:
    if not attrs or "=" not in attrs:
        return (name,)
    words = [w.lower() for m in _ATTR.finditer(attrs) for w in _WORDS.findall(m[2] or m[3] or m[4] or "")]
    return (name, *words)


def _tags(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name or None, is it an end tag, attributes) of tags, comments,
    declarations and whole elements without text, in one pass.

    A quote without a second one is a character like others.  A tag that nothing
    closes is text, and so is all after it.
    """
    at, size = 0, len(html)
    last = {q: html.rfind(q) for q in "\"'"}
    last_close = html.rfind(">")
    while (at := html.find("<", at)) >= 0:
        m = _OPENED.match(html, at)
        if m is None:
            at += 1
            continue
        start, name = at, m[3]
        if m[1]:
            end = html.find("-->", at + 4)
            at = size if end < 0 else end + 3
            yield start, at, None, False, ""
            continue
        if at > last_close:
            at += 1  # only a comment can follow
            continue
        if name is None:
            at = html.find(">", m.end()) + 1
            if not at:
                return
            yield start, at, None, False, ""
            continue
        i = m.end()
        while True:
            i = _PLAIN.match(html, i).end()
            if i == size:
                return
            if html[i] == ">":
                break
            i = html.find(html[i], i + 1) + 1 if i < last[html[i]] else i + 1
        at = i + 1
        raw = None if m[2] else _RAW.get(name.lower())
        if raw is not None:
            closed = raw.search(html, at)
            at = closed.end() if closed else size
            yield start, at, None, False, ""
        else:
            yield start, at, name.lower(), bool(m[2]), html[m.end() : i]


class _Stack:
    """Open elements, with the places of each name and of those that are blocks."""

    def __init__(self) -> None:
        self.elements: list[tuple] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, element: tuple) -> None:
        at = len(self.elements)
        self.elements.append(element)
        self.places.setdefault(element[0], []).append(at)
        if element[0] not in _INLINE:
            self.blocks.append(at)

    def cut(self, size: int) -> None:
        while len(self.elements) > size:
            name = self.elements.pop()[0]
            self.places[name].pop()
            if name not in _INLINE:
                self.blocks.pop()

    def top(self, names: frozenset | set) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def open(self, name: str) -> bool:
        return bool(self.places.get(name))

    def path(self) -> tuple:
        return tuple(self.elements[i] for i in self.blocks[-PATH_ELEMENTS:])

    def ended_by(self, name: str) -> int | None:
        """The place from which a new block ends what is open: an open paragraph, an
        item the item before it within the same list or table."""
        ends = _CLOSES.get(name)
        if ends is None:
            top = self.blocks[-1] if self.blocks else -1
            return top if top >= 0 and self.elements[top][0] == "p" else None
        within = self.top(_HOLDS)
        found = []
        for n in (*ends, "p"):
            held = self.places.get(n, [])
            k = bisect_right(held, within)
            if k < len(held):
                found.append(held[k])
        return min(found, default=None)


def blocks(html: str) -> list[Block]:
    """Leaf blocks of a page in order; texts decoded, white space collapsed."""
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    links: list[str] = []

    def end_block() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(stack.path(), text, min(len(text), sum(map(len, links)))))
            parts.clear()
            links.clear()

    at = 0
    for start, end, name, closing, attrs in _tags(html):
        if start > at:
            piece = html[at:start]
            parts.append(piece)
            if stack.open("a"):
                links.append(piece)
        at = end
        if name is None:
            continue
        inline = name in _INLINE
        if not inline:
            end_block()
        if closing:
            if stack.open(name):
                stack.cut(stack.places[name][-1])
            continue
        if name == "br":
            parts.append(" ")
        if name in _VOID:
            continue
        if not inline and (place := stack.ended_by(name)) is not None:
            stack.cut(place)
        if not attrs.endswith("/") or inline:
            stack.push(_element(name, attrs))
    if at < len(html):
        parts.append(html[at:])
    end_block()
    return out


# ------------------------------------------------------------------- features

_paths: dict[tuple, np.ndarray] = {}


def _path_vector(path: tuple) -> np.ndarray:
    got = _paths.get(path)
    if got is None:
        got = np.zeros(PATH_DIMS, np.float32)
        for depth, element in enumerate(reversed(path)):
            for word in element:
                got[zlib.crc32(word.encode()) % PATH_DIMS] += 1.0 if depth < 2 else 0.7
        if len(_paths) < 20_000:
            _paths[path] = got
    return got


def features(page: list[Block]) -> np.ndarray:
    """One row per block."""
    x = np.zeros((len(page), DIMS), np.float32)
    total = sum(len(b.text) for b in page) or 1
    done = 0
    for row, b in zip(x, page):
        row[:PATH_DIMS] = _path_vector(b.path)
        words = b.text.lower().split()
        codes = [zlib.crc32(w.encode()) % WORD_DIMS for w in words]
        row[PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount(codes, minlength=WORD_DIMS) / (0.5 * len(words) ** 0.5 + 0.5) * 0.3
        n = len(b.text)
        row[-6:] = (
            np.log1p(n) / 6, b.linked / n, (b.text.count(".") + b.text.count(",")) / n * 5,
            done / total, n / total, 1.0,
        )
        done += n
    return x


# ----------------------------------------------------------------------- LSTM


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {"out": rng.normal(0, 0.3, (2 * HIDDEN, 1)), "bias": np.zeros(1)}
    for d in "fb":
        w[d + "x"] = rng.normal(0, DIMS**-0.5, (DIMS, 4 * HIDDEN))
        w[d + "h"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        w[d + "c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(x: np.ndarray, mask: np.ndarray, w: dict, d: str, keep: bool = False):
    """Hidden states (time, batch, HIDDEN); padding leaves the state as it is."""
    steps, batch, _ = x.shape
    z_in = x @ w[d + "x"] + w[d + "c"]
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    out, tape = np.empty((steps, batch, HIDDEN), np.float32), []
    for t in range(steps):
        z = z_in[t] + h @ w[d + "h"]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        new_c = f * c + i * g
        squashed = np.tanh(new_c)
        m = mask[t][:, None]
        if keep:
            tape.append((i, f, o, g, c, squashed, h))
        c = m * new_c + (1 - m) * c
        h = m * (o * squashed) + (1 - m) * h
        out[t] = h
    return out, tape


def _back(x: np.ndarray, mask: np.ndarray, w: dict, d: str, tape: list, grad: np.ndarray, into: dict) -> None:
    steps, batch, _ = x.shape
    dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    dz_all = np.empty((steps, batch, 4 * HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, c, squashed, h = tape[t]
        m = mask[t][:, None]
        dh = dh + grad[t]
        dnew_h, dnew_c = m * dh, m * dc
        do = dnew_h * squashed
        dnew_c = dnew_c + dnew_h * o * (1 - squashed**2)
        dz = np.concatenate([dnew_c * g * i * (1 - i), dnew_c * c * f * (1 - f), do * o * (1 - o), dnew_c * i * (1 - g**2)], 1)
        dz_all[t] = dz
        into[d + "h"] += h.T @ dz
        dh = (1 - m) * dh + dz @ w[d + "h"].T
        dc = (1 - m) * dc + dnew_c * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    into[d + "x"] += x.reshape(-1, DIMS).T @ flat
    into[d + "c"] += flat.sum(0)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def scores(pages: list[np.ndarray], w: dict) -> list[np.ndarray]:
    """Probability of being main for every block of every page."""
    if not pages:
        return []
    x, mask = _padded(pages)
    ahead, _ = _run(x, mask, w, "f")
    behind = _run(x[::-1], mask[::-1], w, "b")[0][::-1]
    p = _sigmoid(np.concatenate([ahead, behind], 2) @ w["out"] + w["bias"])[:, :, 0]
    return [p[: len(page), k] for k, page in enumerate(pages)]


def train(pages: list[np.ndarray], labels: list[np.ndarray], seed: int = 7, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights by back-propagation through time and Adam; fixed seed."""
    rng = np.random.default_rng(seed)
    w = new_weights(rng)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    by_length = sorted(range(len(pages)), key=lambda k: len(pages[k]))
    groups = [by_length[a : a + 16] for a in range(0, len(by_length), 16)]
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask = _padded([pages[k] for k in groups[g]])
            y = np.zeros_like(mask)
            for col, k in enumerate(groups[g]):
                y[: len(labels[k]), col] = labels[k]
            ahead, tape_f = _run(x, mask, w, "f", True)
            back_x, back_mask = np.ascontiguousarray(x[::-1]), np.ascontiguousarray(mask[::-1])
            behind, tape_b = _run(back_x, back_mask, w, "b", True)
            both = np.concatenate([ahead, behind[::-1]], 2)
            p = _sigmoid(both @ w["out"] + w["bias"])[:, :, 0]
            d_logit = ((p - y) * mask / mask.sum())[:, :, None].astype(np.float32)
            grads = {k: np.zeros_like(v) for k, v in w.items()}
            grads["out"] = both.reshape(-1, 2 * HIDDEN).T @ d_logit.reshape(-1, 1)
            grads["bias"] = d_logit.sum((0, 1))
            d_both = d_logit * w["out"][:, 0]
            _back(x, mask, w, "f", tape_f, d_both[:, :, :HIDDEN], grads)
            _back(back_x, back_mask, w, "b", tape_b, np.ascontiguousarray(d_both[::-1, :, HIDDEN:]), grads)
            step += 1
            rate = 0.02 * (1 - 0.8 * epoch / epochs)
            for k, v in w.items():
                gk = np.clip(grads[k], -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * gk
                second[k] = 0.99 * second[k] + 0.01 * gk**2
                v -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


# -------------------------------------------------------------- training pages

MAIN_TAGS = frozenset({"article", "main"})
OTHER_WORDS = frozenset(
    "nav menu header footer aside sidebar form head title ad ads advert advertisement sponsored promo banner cookie consent notice comment comments reply replies share related breadcrumb breadcrumbs widget newsletter subscribe".split()
)
_MARK = "\ue000"


def weak_labels(page: list[Block]) -> np.ndarray | None:
    """1 for blocks in the part that the markup names main; None without one."""
    y = np.zeros(len(page), np.float32)
    for k, b in enumerate(page):
        where = next((i for i, e in enumerate(b.path) if e[0] in MAIN_TAGS), None)
        if where is not None and not any(w in OTHER_WORDS for e in b.path[where + 1 :] for w in e):
            y[k] = 1
    return y if y.any() else None


def made_up_page(rng: np.random.Generator, texts: list[str]) -> str:
    """A page of random layout; the texts of its main part begin with a mark."""
    pick = lambda *of: of[int(rng.integers(len(of)))]
    chance = lambda p: bool(rng.random() < p)

    def words(lo: int, hi: int) -> str:
        got: list[str] = []
        n = int(rng.integers(lo, hi + 1))
        while len(got) < n:
            got += texts[int(rng.integers(len(texts)))].split()
        return " ".join(got[:n])

    def links(lo: int, hi: int) -> str:
        return "".join(f"<li><a href='/x'>{words(1, 3)}</a></li>" for _ in range(int(rng.integers(lo, hi + 1))))

    def menu() -> str:
        return pick(
            "<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<div id="navbar"><ul>{}</ul></div>', '<ul class="nav-links">{}</ul>',
            '<div class="breadcrumbs"><ul>{}</ul></div>', '<div role="navigation"><ul>{}</ul></div>',
        ).format(links(2, 9))

    def header() -> str:
        return pick("<header><p>{}</p></header>", '<div class="site-header"><h2>{}</h2></div>', "<header><h2>{}</h2></header>", '<div id="header"><span>{}</span></div>').format(words(1, 8)) + (menu() if chance(0.4) else "")

    def advert() -> str:
        return pick(
            '<div class="ad">{}</div>', '<div class="ads"><p>{}</p></div>', '<div class="advertisement">{}</div>', '<aside class="sponsored"><p>{}</p></aside>',
            '<div class="promo"><p>{}</p></div>', '<div id="ad-slot">{}</div>', '<section class="advert"><p>{}</p></section>',
        ).format(words(3, 60))

    def notice() -> str:
        return pick(
            '<div class="cookie-notice"><p>{}</p><button>ok</button></div>', '<div class="notice">{}</div>', '<div class="consent" role="dialog"><p>{}</p></div>',
            '<div class="cookie-banner">{}</div>', '<div role="alert"><p>{}</p></div>', '<div class="banner">{}</div>', '<div id="cookies"><p>{}</p></div>',
        ).format(words(4, 60))

    def form() -> str:
        return pick(
            "<form><label>{}</label><input name='q'><button>{}</button></form>", '<div class="newsletter"><form><p>{}</p><button>{}</button></form></div>',
            '<form class="search"><p>{}</p><select><option>{}</option></select></form>', '<div class="subscribe"><p>{}</p><p>{}</p></div>',
        ).format(words(2, 30), words(1, 3))

    def sidebar() -> str:
        return pick("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div class="related">{}</div>', '<div class="widget">{}</div>', '<aside class="related-posts">{}</aside>', '<div id="sidebar">{}</div>').format(
            pick(f"<h3>{words(1, 4)}</h3><ul>{links(2, 6)}</ul>", f"<p>{words(5, 80)}</p>", f"<h4>{words(1, 4)}</h4><p>{words(5, 50)}</p>")
        )

    def comments() -> str:
        one = pick('<div class="comment"><p>{}</p></div>', "<li><p>{}</p></li>", '<article class="comment"><p>{}</p></article>', '<div class="reply"><b>{}</b></div>', "<p>{}</p>")
        return pick('<section class="comments">{}</section>', '<div id="comments">{}</div>', '<ol class="comment-list">{}</ol>', '<div class="responses comments">{}</div>', '<section id="comments"><h2>x</h2>{}</section>').format(
            "".join(one.format(words(2, 120)) for _ in range(int(rng.integers(1, 6))))
        )

    def footer() -> str:
        return pick("<footer>{}</footer>", '<div class="footer"><p>{}</p></div>', '<div id="footer">{}</div>', "<footer><p>{}</p></footer>").format("&copy; " + words(2, 30))

    def main_block() -> str:
        text = _MARK + words(1, pick(4, 30, 120, 200))
        return pick(
            "<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>",
            "<p>{}", "<div>{}</div>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>", "<p><i>{}</i></p>", "<section><p>{}</p></section>",
        ).format(text)

    body = f"<h1>{_MARK}{words(2, 14)}</h1>"
    for _ in range(int(rng.integers(1, pick(3, 10, 30)))):
        body += main_block()
        if chance(0.06):
            body += pick(advert, form, sidebar, notice)()
    if chance(0.15):
        body += comments()
    inner = pick(
        "<article>{}</article>", "<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="post-content">{}</div>',
        '<div class="entry">{}</div>', '<div id="content">{}</div>', '<section class="story">{}</section>', '<div role="main">{}</div>', '<article class="post">{}</article>', '<div class="article-body">{}</div>',
    ).format(body)
    before = "".join(f() for f in (header, menu, notice, advert, form, sidebar) if chance(0.45))
    after = "".join(f() for f in (sidebar, comments, advert, form, notice, footer) if chance(0.45))
    head = f"<head><title>{words(2, 12)}</title></head>" if chance(0.9) else ""
    return f"<html>{head}<body>{before}{inner}{after}" + pick("</body></html>", "")


def fit(sample: list[str], seed: int = 11) -> dict[str, np.ndarray]:
    """Train on weakly labelled pages of the sample and on made-up layouts."""
    rng = np.random.default_rng(seed)
    pages, labels, texts = [], [], ["One plain sentence, which says little. Another follows it."]
    for html in sample:
        page = blocks(html)
        texts += [b.text for b in page if len(b.text) > 40]
        y = weak_labels(page)
        if y is not None:
            pages.append(features(page))
            labels.append(y)
    for _ in range(MADE_UP_PAGES):
        page = blocks(made_up_page(rng, texts))
        y = np.array([b.text.startswith(_MARK) for b in page], np.float32)
        for b in page:
            b.text = b.text.removeprefix(_MARK) or "x"
        pages.append(features(page))
        labels.append(y)
    return train(pages, labels)


# ------------------------------------------------------------------- extraction


def main_texts(htmls: list[str | None], weights: dict[str, np.ndarray]) -> list[str]:
    """Main text of each page."""
    parsed = [blocks(h) if h else [] for h in htmls]
    out = [""] * len(parsed)
    order = sorted((k for k, p in enumerate(parsed) if p), key=lambda k: len(parsed[k]))
    at = 0
    while at < len(order):
        to = at + 1  # as many pages as keep the padded batch bounded
        while to < len(order) and to - at < 128 and (to - at + 1) * len(parsed[order[to]]) <= 16_384:
            to += 1
        part = order[at:to]
        for k, p in zip(part, scores([features(parsed[k]) for k in part], weights)):
            out[k] = " ".join(b.text for b, s in zip(parsed[k], p) if s > 0.5)
        at = to
    return out


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training as one task, where numpy has the threads that Spark grants it."""
    sample = [h for b in batches for h in b.column("html").to_pylist()]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(sample)))], pa.binary())], ["weights"])


def _extract(weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = main_texts(part.column("html").to_pylist(), weights)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return run


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    sample = rows.where("html != ''").orderBy(F.xxhash64("page_id", "url"), "html").limit(sample_pages).select("html")
    fitted = sample.repartition(1).mapInArrow(_fit_task, "weights binary").first()
    weights = pickle.loads(fitted["weights"]) if fitted else {}  # no page has any markup: none needs a label
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_extract(weights), f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint")


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return extract(table(spark, sf_dir, "pages"))
