"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks: the text between two block-level tags, with the open elements around
it. Every block has a vector of hashed tag-path parts, hashed words and a few shape numbers; a bidirectional
LSTM (numpy) reads the whole sequence, so each block is judged with its document around it. Blocks judged
as main text are joined in page order.

The network is trained here, on at most `SAMPLE` pages of at most `SAMPLE_CHARS` characters, the first by
hash of the id. Their blocks are marked
by structure (inside an article, outside navigation and the like) and training mixes in what web pages also
have: sidebars, notices, forms, comments, and other names for the article. Every page is then labelled.
"""
from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import tasks

SAMPLE, HIDDEN, STEPS, BATCH = 300, 16, 300, 16
#: training takes pages of at most so many characters, and reads stretches of at most so many blocks
SAMPLE_CHARS, STRETCH = 200_000, 48
PATH_DIM, WORD_DIM = 256, 32
DIM = PATH_DIM + WORD_DIM + 5

# fixed values: HTML elements by role
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe object select title".split())
#: of these, elements whose text has no tags but their own end; unclosed they reach to the end of the page
TEXT = frozenset("script style textarea title".split())
ENDS_P = frozenset(("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                    "menu nav ol p pre section table ul").split())
# fixed values: open elements that a start tag ends without their own end tags
_CELLS = frozenset({"td", "th"})
_ROWS = _CELLS | {"tr"}
_PARTS = _ROWS | {"tbody", "thead", "tfoot"}
_TERMS, _CHOICES = frozenset({"dt", "dd"}), frozenset({"option"})
ENDS = {"td": _CELLS, "th": _CELLS, "tr": _ROWS, "tbody": _PARTS, "thead": _PARTS, "tfoot": _PARTS, "dt": _TERMS, "dd": _TERMS, "option": _CHOICES, "optgroup": _CHOICES}
# fixed values: words in tags, classes and ids that mark main text and what surrounds it
MAIN = "article main content post entry story body".split()
AROUND = ("nav menu header footer aside sidebar notice cookie banner ad ads advert promo form comments comment related share breadcrumb "
          "subscribe newsletter widget login search popup").split()

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|$)|[^<]+|<", re.S)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*(?:>|$)", re.I) for tag in RAW}
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int = 0


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order: character references decoded, white space one space, never empty."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, here, unclosed = 0, 0, set()

    def close():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(tuple(x[1] for x in stack if x[0] not in INLINE), text, linked))
        parts.clear()
        linked = 0

    while m := _TOKEN.match(page, here):
        piece, tag, here = m[0], m[2], m.end()
        if tag is None:
            if not piece.startswith("<") or piece == "<":
                parts.append(piece)
                if any(t == "a" for t, _ in stack[-4:]):
                    linked += len(piece)
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                close()
                end = None if tag in unclosed else _END[tag].search(page, here)
                if end:
                    here = end.end()
                elif tag in TEXT:
                    break
                else:
                    unclosed.add(tag)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in INLINE:
            if not m[1]:
                stack.append((tag, tag))
            elif any(t == tag for t, _ in stack):
                at = max(i for i, (t, _) in enumerate(stack) if t == tag)
                if all(t in INLINE for t, _ in stack[at:]):
                    del stack[at]
            continue
        if tag == "br":
            continue
        close()
        if m[1]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                del stack[at:]
        else:
            if tag in ENDS_P:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), None)
                if at is not None and stack[at][0] == "p":
                    del stack[at:]
            if tag == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            while tag in ENDS:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), None)
                if at is None or stack[at][0] not in ENDS[tag]:
                    break
                del stack[at:]
            if tag not in VOID:
                names = " ".join((a or b or c).lower() for _, a, b, c in _NAMES.findall(m[3]))
                stack.append((tag, f"{tag} {names}".rstrip()))
    close()
    return out


def vectors(page: list[Block]) -> np.ndarray:
    """One row per block: hashed path parts, hashed words, shape."""
    x = np.zeros((len(page), DIM), np.float64)
    for i, b in enumerate(page):
        for depth, element in enumerate(b.path):
            for part in _PART.findall(element):
                x[i, zlib.crc32(part.encode()) % PATH_DIM] += 1.0
            if depth == len(b.path) - 1:
                x[i, zlib.crc32(b"leaf " + element.encode()) % PATH_DIM] += 0.5
        words = b.text.split(" ")
        held = np.bincount([zlib.crc32(w.lower().encode()) % WORD_DIM for w in words], minlength=WORD_DIM)
        x[i, PATH_DIM: PATH_DIM + WORD_DIM] = np.log1p(held) * 0.2
        x[i, PATH_DIM + WORD_DIM:] = (np.log1p(len(words)) / 4, min(1.0, b.linked / len(b.text)), b.text[-1] in ".!?", len(b.path) / 10, 1.0)
    np.minimum(x[:, :PATH_DIM], 2.0, out=x[:, :PATH_DIM])
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["W" + d] = (r.standard_normal((DIM, 4 * HIDDEN)) * 0.1).astype(np.float64)
            self.p["U" + d] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float64)
            bias = np.zeros(4 * HIDDEN, np.float64)
            bias[HIDDEN: 2 * HIDDEN] = 1.0
            self.p["b" + d] = bias
        self.p["V"] = (r.standard_normal((2 * HIDDEN, 1)) * 0.2).astype(np.float64)
        self.p["c"] = np.zeros(1, np.float64)

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray):
        """States of one direction over (time, page, feature); padded steps keep the state."""
        t, n, _ = x.shape
        z = (x.reshape(t * n, -1) @ self.p["W" + d] + self.p["b" + d]).reshape(t, n, -1)
        h, c = np.zeros((n, HIDDEN), np.float64), np.zeros((n, HIDDEN), np.float64)
        states, memo = np.zeros((t, n, HIDDEN), np.float64), []
        for k in (range(t) if d == "f" else range(t - 1, -1, -1)):
            g = z[k] + h @ self.p["U" + d]
            i, f, o = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN: 2 * HIDDEN]), _sigmoid(g[:, 2 * HIDDEN: 3 * HIDDEN])
            u = np.tanh(g[:, 3 * HIDDEN:])
            c2 = f * c + i * u
            th = np.tanh(c2)
            m = mask[k][:, None]
            memo.append((k, h, c, i, f, o, u, th, m))
            h, c = m * (o * th) + (1 - m) * h, m * c2 + (1 - m) * c
            states[k] = h
        return states, memo

    def scores(self, x: np.ndarray, mask: np.ndarray):
        hf, mf = self._pass("f", x, mask)
        hb, mb = self._pass("b", x, mask)
        both = np.concatenate([hf, hb], 2)
        return _sigmoid((both @ self.p["V"])[:, :, 0] + self.p["c"]), both, mf, mb

    def gradients(self, x, mask, y):
        s, both, mf, mb = self.scores(x, mask)
        dz = ((s - y) * mask / mask.sum())[:, :, None]
        g = {"V": np.einsum("tnh,tno->ho", both, dz), "c": dz.sum((0, 1))}
        dh_all = dz @ self.p["V"].T
        for d, memo, part in (("f", mf, dh_all[:, :, :HIDDEN]), ("b", mb, dh_all[:, :, HIDDEN:])):
            pre, before = np.zeros((*x.shape[:2], 4 * HIDDEN)), np.zeros((*x.shape[:2], HIDDEN))
            dh = np.zeros((x.shape[1], HIDDEN))
            dc = np.zeros_like(dh)
            for k, h0, c0, i, f, o, u, th, m in reversed(memo):
                dh = dh + part[k]
                dm, hold, dhold = dh * m, dh * (1 - m), dc * (1 - m)
                dc2 = dc * m + dm * o * (1 - th ** 2)
                da = np.concatenate([dc2 * u * i * (1 - i), dc2 * c0 * f * (1 - f), dm * th * o * (1 - o), dc2 * i * (1 - u ** 2)], 1)
                pre[k], before[k] = da, h0
                dh, dc = da @ self.p["U" + d].T + hold, dc2 * f + dhold
            flat = pre.reshape(-1, 4 * HIDDEN)
            g |= {"W" + d: x.reshape(len(flat), -1).T @ flat, "U" + d: before.reshape(len(flat), -1).T @ flat, "b" + d: flat.sum(0)}
        return g, s

    def main_blocks(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page which blocks are main text; pages of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            n = max(1, min(64, 4096 // len(pages[order[at]])))
            some = order[at: at + n]
            x, mask, _ = _padded([(vectors(pages[i]), None) for i in some])
            s = self.scores(x, mask)[0]
            for j, i in enumerate(some):
                out[i] = s[: len(pages[i]), j] > 0.5
            at += n
        return out


def _padded(rows):
    t = max(len(x) for x, _ in rows)
    x, mask, y = np.zeros((t, len(rows), DIM), np.float64), np.zeros((t, len(rows)), np.float64), np.zeros((t, len(rows)), np.float64)
    for j, (v, lab) in enumerate(rows):
        x[: len(v), j], mask[: len(v), j] = v, 1
        if lab is not None:
            y[: len(v), j] = lab
    return x, mask, y


def marked(page: list[Block]) -> list[bool]:
    """Structural marks for training: the innermost telling element decides; without any, running text is main."""
    out = []
    for b in page:
        mark = None
        for element in reversed(b.path):
            parts = set(_PART.findall(element))
            if parts & set(AROUND):
                mark = False
            elif parts & set(MAIN) - {"body"} or element.startswith("article"):
                mark = True
            if mark is not None:
                break
        out.append(b.linked < len(b.text) / 2 and b.text[-1] in ".!?" and len(b.text) > 60 if mark is None else mark)
    return out


def _varied(page: list[Block], marks: list[bool], pool: list[str], r: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A training page: other names for the article, and surrounding blocks put in between."""
    wrap = r.choice(["article", "article", "main", "div content", "div post", "section article body", "div entry content", "article post"])
    leaf = r.choice(["p", "p", "div", "section"])
    new = [(Block(tuple(wrap if e.split(" ")[0] == "article" else e if e != "p" else leaf for e in b.path), b.text, b.linked), m) for b, m in zip(page, marks)]
    inside = next((b.path[: next(i for i, e in enumerate(b.path) if e == wrap) + 1] for b, m in new if m and wrap in b.path), ("html", "body"))
    for _ in range(int(r.integers(1, 7))):
        word = str(r.choice(AROUND))
        tag = word if word in ("nav", "header", "footer", "aside", "form") else str(r.choice(["div", "section", "ul", "aside"])) + " " + word
        if r.random() < 0.3:
            tag += " " + str(r.choice(["box", "wrapper", "list", "inner", "content", "body"]))
        top = inside if r.random() < 0.45 else ("html", "body")
        leafs = ["p", "li", "h2", "h3", "div", "label", "button", ""]
        run = []
        for _ in range(int(r.integers(1, 5))):
            leaf2 = str(r.choice(leafs))
            text = pool[int(r.integers(len(pool)))]
            if r.random() < 0.5:
                text = " ".join(text.split(" ")[: int(r.integers(1, 9))])
            run.append((Block((*top, tag) + ((leaf2,) if leaf2 else ()), text, len(text) if r.random() < 0.2 else 0), False))
        at = int(r.integers(0, len(new) + 1)) if top == inside else int(r.choice([0, len(new)]))
        new[at:at] = run
    return [b for b, _ in new], [m for _, m in new]


def train(pages: list[str], steps: int = STEPS, seed: int = 3) -> Labeller:
    """Fit with Adam on varied forms of the sample pages; the sample's order does not matter beyond its ids."""
    model, r = Labeller(seed), np.random.default_rng(seed)
    parsed = [p for p in map(blocks, pages) if p]
    if not parsed:
        parsed = [[Block(("html", "body", "article", "p"), "Some running text of a page, long enough to be a paragraph of its own."),
                   Block(("html", "body", "nav", "li"), "Home", 4)]]
    marks = [marked(p) for p in parsed]
    pool = [b.text for p in parsed for b in p][:4000]
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    ready = []
    for i in range(max(len(parsed), 2 * BATCH)):
        b, y = _varied(parsed[i % len(parsed)], marks[i % len(parsed)], pool, r)
        ready.append((vectors(b), np.array(y, np.float64)))
    wrong = 1.0
    for t in range(1, steps + 1):
        rows = []
        for i in r.integers(0, len(ready), BATCH):
            x, y = ready[i]
            at = int(r.integers(0, max(1, len(y) - STRETCH + 1)))
            rows.append((x[at: at + STRETCH], y[at: at + STRETCH]))
        x, mask, y = _padded(rows)
        g, guess = model.gradients(x, mask, y)
        wrong = 0.95 * wrong + 0.05 * float((np.abs(guess - y) * mask).sum() / mask.sum())
        if wrong < 0.003:
            break
        rate = 0.02 * min(1.0, 2 * (1 - t / (steps + 1)))
        for k in model.p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
            model.p[k] = model.p[k] - (rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.99 ** t)) + 1e-7)).astype(np.float64)
    return model


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars) for every page; n_chars counts code points.

    A null or empty page, and one without main text, has the empty text. Null ids and urls stay; repeated
    rows give repeated rows; every page is judged alone, whole, however long. Other columns are ignored; an
    empty table gives an empty table.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    # chosen by hashes alone, so that tasks send the driver the pages of the sample and no others
    hashed = rows.where(F.length("html") <= SAMPLE_CHARS).select("page_id", F.xxhash64("page_id").alias("h"), F.xxhash64("html").alias("g"), "html")
    chosen = hashed.select("h", "page_id", "g").distinct().orderBy("h", "page_id", "g").limit(sample).collect()
    ids = pages.sparkSession.createDataFrame([(r.h, r.g) for r in chosen], "h long, g long")
    few = [r.html for r in hashed.join(F.broadcast(ids), ["h", "g"], "left_semi").dropDuplicates(["h", "page_id", "g"]).orderBy("h", "page_id", "g").select("html").collect()]
    model = train(few)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                parsed = [blocks(t or "") for t in part.column(2).to_pylist()]
                texts = [" ".join(b.text for b, yes in zip(p, m) if yes) for p, m in zip(parsed, model.main_blocks(parsed))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    return tasks(rows, run, "page_id long, url string, text string, n_chars long")
