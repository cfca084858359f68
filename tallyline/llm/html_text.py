"""Main text of web pages: a bidirectional LSTM labels every leaf block of a page."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import text as T
from tallyline.llm.quality import sigmoid

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html iframe label legend li main menu nav noframes noscript object ol optgroup option p pre search section select summary "
    "table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = re.compile(r"</(script|style)\b[^>]*>?", re.I)
# An open element of the first kind ends where one of these begins.
CLOSED_BY = {
    "p": BLOCKS - {"button", "label", "legend", "option", "optgroup", "caption"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "head": {"body"},
}
TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|[!?][^>]*>?)""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
MARK = re.compile(r'data-block="([01])"')


@dataclass
class Block:
    path: tuple[str, ...]  # names of the open elements, each with the words of its class, id and role
    text: str
    linked: int  # characters inside links
    mark: str | None = None  # what a training page says about it


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text, in page order.

    Comments, scripts and styles are no text; unclosed elements end where HTML ends them or with the element around
    them; what remains open at the end of the page is read to its end.
    """
    out: list[Block] = []
    names: list[str] = []
    steps: list[str] = []
    marks: list[str | None] = []
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked, in_link
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(steps), text, min(linked, len(text)), next((m for m in reversed(marks) if m), None)))
            parts.clear()
        linked, in_link = 0, False

    at = 0
    while at < len(page):
        found = TAG.search(page, at)
        stop = found.start() if found else len(page)
        if stop > at:
            parts.append(page[at:stop])
            linked += in_link * (stop - at)
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, rest = found[1] or found[4], found[3] or found[6] or ""
        if name in ("script", "style"):
            if not closing and not rest.endswith("/"):
                end = next((m for m in RAW.finditer(page, at) if m[1].lower() == name), None)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
        if name == "a":
            in_link = not closing
        if name not in BLOCKS:
            continue
        flush()
        if closing:
            if name in names:
                while names.pop() != name:
                    steps.pop(), marks.pop()
                steps.pop(), marks.pop()
            continue
        while names and name in CLOSED_BY.get(names[-1], ()):
            names.pop(), steps.pop(), marks.pop()
        if name not in VOID and not rest.endswith("/"):
            words = [w for m in NAMED.finditer(rest) for w in re.findall(r"[a-z]+", (m[2] or m[3] or m[4] or "").lower())]
            mark = MARK.search(rest)
            names.append(name)
            steps.append(".".join([name, *words]))
            marks.append(mark[1] if mark else None)
    flush()
    return out


PATH, LEAF, WORD, PLAIN = 48, 16, 16, 6
INPUTS = PATH + LEAF + WORD + PLAIN
WORD_ROWS = 4096
SIGNS = np.where(T.mix(T.seeds(WORD_ROWS * WORD, 151)) >> T.U64(63), 1.0, -1.0).reshape(WORD_ROWS, WORD).astype(np.float32)


def _hashed(words: list[str], width: int, seed: int) -> np.ndarray:
    """Sum of the words' hashed sign vectors: three places each."""
    out = np.zeros(width, np.float32)
    for w in words:
        h, _, _ = T.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), np.ones(256, bool))
        draws = T.mix(h[:1] + T.seeds(3, seed))
        np.add.at(out, (draws % T.U64(width)).astype(np.int64), np.where(draws >> T.U64(63), 1, -1))
    return out


class Features:
    """Input vectors of the blocks of some pages: tag path, leaf element, hashed words, and plain figures."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 20_000:
                self.paths.clear()
            split = [s.split(".") for s in path]
            words = sorted({w for s in split for w in ([s[0]] + ["." + x for x in s[1:]])} - {"html", "body"})
            leaf = [w if i == 0 else "." + w for i, w in enumerate(split[-1])] if split else []
            self.paths[path] = np.concatenate([_hashed(words, PATH, 157), _hashed(leaf, LEAF, 163)])
        return self.paths[path]

    def __call__(self, found: list[Block], firsts: np.ndarray) -> np.ndarray:
        x = np.zeros((len(found), INPUTS), np.float32)
        if not found:
            return x
        x[:, : PATH + LEAF] = np.stack([self._path(b.path) for b in found])
        length = np.array([len(b.text) for b in found], np.float32)
        for first, last, data, offsets in T.slices(pa.array([b.text for b in found])):
            hashes, _, begins = T.words(data, offsets, T.SPACED)
            n = np.diff(begins)
            full = np.flatnonzero(n)
            if len(full):
                sums = np.add.reduceat(SIGNS[(hashes >> T.U64(52)).astype(np.int64)], begins[:-1][full], axis=0)
                x[first + full, PATH + LEAF : PATH + LEAF + WORD] = sums / np.sqrt(n[full])[:, None] / 4
            x[first:last, -1] = np.log1p(n) / 5
        at = np.arange(len(found)) - np.repeat(firsts[:-1], np.diff(firsts))
        x[:, -6] = np.log1p(length) / 6
        x[:, -5] = np.array([b.linked for b in found]) / np.maximum(length, 1)
        x[:, -4] = [b.text.count(". ") + b.text.endswith(".") for b in found] / np.sqrt(np.maximum(length, 1))
        x[:, -3] = at == 0
        x[:, -2] = np.minimum(at, 50) / 50
        return x


@dataclass
class Lstm:
    """One direction: weights for the gates (input, forget, output, candidate) side by side."""

    w: np.ndarray
    u: np.ndarray
    b: np.ndarray
    kept: list = field(default_factory=list)

    def forward(self, x: np.ndarray, alive: np.ndarray, keep: bool = False) -> np.ndarray:
        """Hidden states (steps x rows x size); where a row is not alive its state stays."""
        size = self.u.shape[0]
        h, c = np.zeros((x.shape[1], size), x.dtype), np.zeros((x.shape[1], size), x.dtype)
        out = np.empty((*x.shape[:2], size), x.dtype)
        inner = x @ self.w + self.b
        self.kept = []
        for t in range(len(x)):
            z = inner[t] + h @ self.u
            i, f, o = (sigmoid(z[:, k * size : (k + 1) * size]) for k in range(3))
            g = np.tanh(z[:, 3 * size :])
            live = alive[t][:, None]
            new_c = np.where(live, f * c + i * g, c)
            new_h = np.where(live, o * np.tanh(new_c), h)
            if keep:
                self.kept.append((i, f, o, g, c, new_c, h, live))
            h, c = new_h, new_c
            out[t] = h
        return out

    def backward(self, x: np.ndarray, out_grad: np.ndarray) -> list[np.ndarray]:
        dw, du, db = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        dh, dc = np.zeros_like(out_grad[0]), np.zeros_like(out_grad[0])
        for t in reversed(range(len(x))):
            i, f, o, g, c, new_c, h, live = self.kept[t]
            dh = dh + out_grad[t]
            tanh = np.tanh(new_c)
            dz_c = np.where(live, dh * o * (1 - tanh * tanh) + dc, 0)
            dz = np.concatenate([dz_c * g * i * (1 - i), dz_c * c * f * (1 - f), np.where(live, dh * tanh * o * (1 - o), 0), dz_c * i * (1 - g * g)], axis=1)
            dw += x[t].T @ dz
            du += h.T @ dz
            db += dz.sum(axis=0)
            dh = np.where(live, dz @ self.u.T, dh)
            dc = np.where(live, dz_c * f, dc)
        return [dw, du, db]


@dataclass
class Labeller:
    """Reads a page's blocks in both directions; a block's score sees both states and the block itself."""

    ahead: Lstm
    back: Lstm
    out: np.ndarray
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.out, self.bias]

    def scores(self, x: np.ndarray, alive: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([self.ahead.forward(x, alive, keep), self.back.forward(x[::-1], alive[::-1], keep)[::-1], x], axis=2)
        return sigmoid(both @ self.out + self.bias[0]), both

    def pages(self, x: np.ndarray, firsts: np.ndarray, cells: int = 20_000) -> np.ndarray:
        """Scores of all blocks; pages of like length are read side by side, about ``cells`` blocks at once."""
        sizes = np.diff(firsts)
        scores = np.zeros(len(x))
        order = [p for p in np.argsort(sizes, kind="stable").tolist() if sizes[p]]
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and (n + 1) * sizes[order[at + n]] <= cells:
                n += 1
            group = np.array(order[at : at + n])
            padded, alive, where = batch_of(x, firsts, group)
            scores[where[alive]] = self.scores(padded, alive)[0][alive]
            at += n
        return scores


def batch_of(x: np.ndarray, firsts: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of some pages side by side (steps x pages x inputs), which places hold one, and their numbers."""
    sizes = np.diff(firsts)[pages]
    steps = np.arange(int(sizes.max()))[:, None]
    alive = steps < sizes
    where = np.where(alive, firsts[pages] + steps, 0)
    return np.where(alive[:, :, None], x[where], 0), alive, where


HIDDEN, EPOCHS, ROWS, RATE = 16, 12, 16, 0.01
VARIANTS = 5


def train(x: np.ndarray, y: np.ndarray, firsts: np.ndarray, seed: int = 5) -> Labeller:
    """Fit by Adam and back-propagation through time on pages of labelled blocks."""
    rng = np.random.default_rng(seed)
    lstm = lambda: Lstm(rng.normal(0, 0.15, (INPUTS, 4 * HIDDEN)), rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN))
    net = Labeller(lstm(), lstm(), rng.normal(0, 0.1, 2 * HIDDEN + INPUTS), np.zeros(1))
    first, second, t = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    pages = np.flatnonzero(np.diff(firsts))
    x = x.astype(np.float64)
    for _ in range(EPOCHS):
        rng.shuffle(pages)
        for a in range(0, len(pages), ROWS):
            padded, alive, where = batch_of(x, firsts, pages[a : a + ROWS])
            p, both = net.scores(padded, alive, keep=True)
            error = np.where(alive, p - y[where], 0) / alive.sum()
            states = error[:, :, None] * net.out
            grads = net.ahead.backward(padded, states[:, :, :HIDDEN]) + net.back.backward(padded[::-1], states[::-1, :, HIDDEN : 2 * HIDDEN])
            grads += [np.tensordot(error, both, axes=((0, 1), (0, 1))), np.array([error.sum()])]
            t += 1
            for w, g, m, v in zip(net.params(), grads, first, second, strict=True):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


# What the training pages call main text and everything else: element names and words of class, id and role.
MAIN = ("article", "main", 'div class="content"', 'div id="main-content"', 'div class="post"', 'div class="article-body"', 'section class="entry"', 'div class="story text"', 'div role="main"')
ASIDE = (
    "nav", "aside", "footer", "header", "form", 'div class="ad"', 'div class="ads banner"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"',
    'div class="promo"', 'div class="sidebar"', 'div id="sidebar"', 'div class="menu"', 'div class="navigation"', 'ul class="nav"', 'div class="breadcrumb"',
    'div class="footer"', 'div id="footer"', 'div class="header"', 'div id="header"', 'div class="cookie"', 'div class="cookie-notice"', 'div class="notice"',
    'div class="consent"', 'div class="popup"', 'div class="newsletter"', 'div class="subscribe"', 'div class="login"', 'div class="search"', 'div class="share"',
    'div class="social"', 'div class="related"', 'div class="widget"', 'div class="copyright"', 'div class="legal"', 'div class="comments"', 'div id="comments"',
    'section class="comments"', 'div class="comment"', 'ol class="comment-list"', 'div class="replies"', 'section class="reader-comments"', 'div class="discussion"',
)
BOILERPLATE = re.compile(
    r"\b(ad|ads|advert\w*|banner|sponsored|promo|sidebar|menu|nav|navigation|breadcrumb|footer|header|cookie|notice|consent|popup|newsletter|subscribe|login|search|"
    r"share|social|related|widget|copyright|legal|comments?|repl(?:y|ies)|discussion)\b"
)


def teacher(block: Block) -> bool:
    """The label a page's own elements give a block: inside an article or main element, and inside nothing that marks by-matter."""
    names = [s.split(".") for s in block.path]
    if any(n[0] in ("nav", "aside", "footer", "header", "form", "head", "button", "select", "menu", "noscript", "dialog", "template") for n in names):
        return False
    if any(BOILERPLATE.search(" ".join(n[1:])) for n in names):
        return False
    if any(n[0] in ("article", "main") for n in names):
        return True
    return any(n[0] in ("p", "pre", "blockquote", "h1", "h2", "h3") for n in names) and block.linked < len(block.text) / 2


def examples(pages: list[str], seed: int = 3) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Blocks and labels of the given pages, each as it is and in VARIANTS variants.

    In a variant the main element has another name and sections of by-matter, filled with sentences of other pages,
    stand before, in and after it. Both carry a mark that tells their label and is no input.
    """
    rng = np.random.default_rng(seed)
    pool = [b.text[:400] for p in pages[:100] for b in blocks(p)] or ["text"]
    found, labels = [], []

    def by_matter() -> str:
        kind = ASIDE[rng.integers(len(ASIDE))]
        inner = "".join(
            {0: "<p>%s</p>", 1: '<li><a href="#">%s</a></li>', 2: "<div>%s</div>", 3: "%s", 4: "<label>%s</label>", 5: "<h3>%s</h3>", 6: "<h1>%s</h1>", 7: "<h2>%s</h2>"}[int(rng.integers(8))]
            % html.escape(pool[rng.integers(len(pool))][: int(rng.integers(8, 300))]) for _ in range(int(rng.integers(1, 5)))
        )
        return f'<{kind} data-block="0">{inner}</{kind.split()[0]}>'

    for page in pages:
        own = blocks(page)
        found.append(own)
        labels.append(np.array([teacher(b) for b in own], float))
        if not labels[-1].any():
            continue
        good = [b for b, g in zip(own, labels[-1], strict=True) if g]
        for _ in range(VARIANTS):
            kind = MAIN[rng.integers(len(MAIN))]
            paragraphs = []
            for b in good:
                name = b.path[-1].split(".")[0]
                name = name if name in ("h1", "h2", "h3", "li", "pre", "blockquote") else "p"
                text = b.text
                if name[0] == "h" or rng.random() < 0.1:
                    name = ("h1", "h2", "h3", "h2", "p")[rng.integers(5)]
                if rng.random() < 0.3:
                    text = text[: int(rng.integers(8, 80))]
                if name == "h1" and rng.random() < 0.3:
                    continue
                paragraphs.append(f"<{name}>{html.escape(text)}</{name}>")
            paragraphs = paragraphs[int(rng.integers(0, 2)) :] or paragraphs
            for _ in range(int(rng.integers(0, 3))):
                paragraphs.insert(int(rng.integers(0, len(paragraphs) + 1)), by_matter())
            before, after = ("".join(by_matter() for _ in range(int(rng.integers(0, 4)))) for _ in range(2))
            made = blocks(f'<html><head><title data-block="0">{html.escape(own[0].text)}</title></head><body>{before}<{kind} data-block="1">{"".join(paragraphs)}</{kind.split()[0]}>{after}</body></html>')
            found.append(made)
            labels.append(np.array([b.mark == "1" for b in made], float))
    return found, labels


SAMPLE, SAMPLE_CHARS = 250, 20_000


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Labeller:
    """A labeller from at most ``sample`` pages of up to SAMPLE_CHARS characters, the first in the order of their ids' hashes."""
    rows = pages.where(F.col(html_col).isNotNull() & (F.length(html_col) <= SAMPLE_CHARS)).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(html_col).alias("html"))
    found, labels = examples([r["html"] for r in rows.orderBy("h", "html").limit(sample).collect()])
    firsts = np.cumsum([0, *map(len, found)])
    flat = [b for f in found for b in f]
    return train(Features()(flat, firsts), np.concatenate(labels) if labels else np.zeros(0), firsts)


def main_text(pages: DataFrame, model: Labeller, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """The given columns, text and n_chars of every page: its blocks that score at least ``threshold``, in page order, joined by two line ends.

    Character references are decoded, white space inside a block becomes one space. Null or empty pages and pages
    without main text have an empty text. Repeated rows are rows of their own; other columns are ignored.
    """
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        features = Features()
        for batch in batches:
            for first, last in T.row_slices(T.column_bytes(batch.column(len(keep)))[1], 1 << 20):
                found = [blocks(p or "") for p in batch.column(len(keep)).slice(first, last - first).to_pylist()]
                firsts = np.cumsum([0, *map(len, found)])
                flat = [b for f in found for b in f]
                good = model.pages(features(flat, firsts), firsts) >= threshold
                texts = ["\n\n".join(b.text for b, g in zip(f, good[a : a + len(f)].tolist(), strict=True) if g) for f, a in zip(found, firsts.tolist(), strict=False)]
                cols = [batch.column(i).slice(first, last - first) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html_col).mapInArrow(run, f"{kinds}, text string, n_chars long")
