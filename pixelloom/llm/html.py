"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of open elements (tags,
classes, ids). A bidirectional LSTM in numpy reads the page's blocks in order, each as a vector of hashed path
tokens, hashed words and a few measures, and labels every block as main text or not, so that a block is judged
with the whole page before and after it. The text is the main blocks in page order, one a line.

The labeller is trained here, at first use in a process, on ``PAGES`` made-up pages (pages.py); a fixed seed
makes training, and so results, the same everywhere. Its weights (some tens of thousands of numbers) go to the tasks.

Edge cases: null or empty html gives an empty text; text outside any element is a block; unclosed elements end with their
parents; scripts, styles, comments and the head are never blocks; pages of any length are read whole; rows without page_id or url have null
there; repeated rows give repeated results; an empty table gives no rows; other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pages
from .common import mapped

PAGES = 500
HIDDEN = 20
EPOCHS = 6
BATCH = 20
SEED = 11
PATH, LEAF, WORDS, MEASURES = 96, 24, 24, 8
INPUT = PATH + LEAF + WORDS + MEASURES

#: Comment, declaration, script or style with its content (to the page's end if not closed), or tag.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(script|style)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
#: Elements whose content isn't text, if they are closed; those of other vocabularies can close themselves.
SKIPPED = frozenset("template svg iframe annotation annotation-xml".split())
FOREIGN = frozenset(("svg",))
#: What a head can hold; any other tag ends it.
IN_HEAD = frozenset("head base link meta title style script noscript template basefont bgsound noframes".split())
#: Elements of a head whose content isn't text.
HEAD_TEXT = frozenset(("title", "noframes", "noscript"))
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object canvas "
    # formulas are text of their block
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of these ends the open ones named with it, up to the nearest parent.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("div article main section aside nav header footer ul ol dl table form body blockquote td th figure".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path of "tag" or "tag.name name" entries, text, characters inside links) of each leaf block in order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    links = in_link = at = 0

    def end() -> None:
        nonlocal links
        if text:
            # unescaping first, so that references to white space count as white space
            t = " ".join(entities.unescape("".join(text)).split())
            if t:
                out.append((tuple(x for _, x in stack), t, links))
            text.clear()
        links = 0

    def add(s: str) -> None:
        nonlocal links
        text.append(s)
        if in_link:
            links += len(s)

    def close(tags: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in SCOPES:
                return

    marks = list(MARKUP.finditer(page))
    tags = [(m[3] or m[6] or "").lower() for m in marks]
    skips = _skips(marks, tags)
    until, head = 0, False
    for k, m in enumerate(marks):
        if k < until:
            at = m.end()
            continue
        tag = tags[k]
        shut = m[2] if m[3] else m[5]
        if head and tag and tag not in IN_HEAD:
            head = False
        if m.start() > at:
            # text between a head's elements is the body's, unless it is blank or a title
            between = page[at : m.start()]
            if not head or (between.strip() and not (k and tags[k - 1] in HEAD_TEXT and tag in HEAD_TEXT)):
                head = False
                add(between)
        at = m.end()
        if not tag:
            if m[1]:
                add(" ")
            continue
        if tag == "head":
            end()
            head = not shut
            continue
        if k in skips:
            until = skips[k]
            add(" ")
            continue
        if head:
            continue
        if tag == "a":
            in_link = 0 if shut else 1
        if tag in INLINE:
            if tag == "br":
                add(" ")
            continue
        end()
        if shut:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in ENDS:
            close(ENDS[tag])
        if tag in CLOSES_P:
            close(("p",))
        if tag not in VOID:
            attributes = m[4] if m[3] else m[7]
            names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)) if attributes else ""
            stack.append((tag, f"{tag}.{names}" if names else tag))
    if at < len(page):
        add(page[at:])
    end()
    return out


def _skips(marks: list, tags: list[str]) -> dict[int, int]:
    """For each opening tag of a skipped element that is closed or closes itself, the number of the mark after its end."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for k, (m, tag) in enumerate(zip(marks, tags, strict=True)):
        if tag not in SKIPPED:
            continue
        if m[2] if m[3] else m[5]:
            if open_.get(tag):
                out[open_[tag].pop()] = k + 1
        elif tag in FOREIGN and m[0].endswith("/>"):
            out[k] = k + 1
        else:
            open_.setdefault(tag, []).append(k)
    return out


class Vectors:
    """Block vectors; hashes of paths and words are remembered."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.cells: dict[str, int] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        v = self.paths.get(path)
        if v is None:
            v = np.zeros(PATH + LEAF, np.float32)
            for depth, x in enumerate(path):
                tag, _, names = x.partition(".")
                for token in (f"<{tag}", *re.split(r"[^a-z0-9]+", names.lower())):
                    if token:
                        h = zlib.crc32(token.encode("utf-8", "replace"))
                        v[h % PATH] += 1.0 if h & 0x1000000 else -1.0
                        if depth == len(path) - 1:
                            v[PATH + (h >> 7) % LEAF] += 1.0
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = v
        return v

    def word(self, w: str) -> int:
        c = self.cells.get(w)
        if c is None:
            if len(self.cells) > 500_000:
                self.cells.clear()
            c = self.cells[w] = zlib.crc32(w.encode("utf-8", "replace")) % WORDS
        return c

    def page(self, found: list) -> np.ndarray:
        out = np.zeros((len(found), INPUT), np.float32)
        for k, (path, text, links) in enumerate(found):
            words = text.lower().split()
            n = len(words)
            out[k, : PATH + LEAF] = self.path(path)
            out[k, PATH + LEAF : PATH + LEAF + WORDS] = np.bincount([self.word(w) for w in words], minlength=WORDS) * (2.0 / n)
            out[k, PATH + LEAF + WORDS :] = (math.log1p(n) / 3, min(1.0, links / len(text)), text[-1] in ".!?", text.count(",") / n, len(path) / 8, k / len(found), math.log1p(len(found)) / 4, float("©" in text))
        return out


class Labeller:
    """Two LSTMs over the blocks, one in each direction, and a logistic layer over both."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = (r.standard_normal((INPUT, 4 * h)) * 0.1).astype(np.float32)
            self.w[f"h{d}"] = (r.standard_normal((h, 4 * h)) * 0.2).astype(np.float32)
            self.w[f"b{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.w["o"] = (r.standard_normal(2 * h) * 0.2).astype(np.float32)
        self.w["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple:
        """x: pages x steps x INPUT. Steps behind a page's end leave the state as it is."""
        n, steps, h = x.shape[0], x.shape[1], HIDDEN
        pre = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        hs, cs = np.zeros((steps + 1, n, h), np.float32), np.zeros((steps + 1, n, h), np.float32)
        gates = np.zeros((steps, n, 4 * h), np.float32)
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        for k, t in enumerate(order):
            z = pre[:, t] + hs[k] @ self.w[f"h{d}"]
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            gates[k] = g
            m = mask[:, t, None]
            c = g[:, h : 2 * h] * cs[k] + g[:, :h] * g[:, 3 * h :]
            cs[k + 1] = m * c + (1 - m) * cs[k]
            hs[k + 1] = m * (g[:, 2 * h : 3 * h] * np.tanh(c)) + (1 - m) * hs[k]
        out = hs[1:] if d == "f" else hs[:0:-1]
        return out.transpose(1, 0, 2), hs, cs, gates, list(order)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, b = self._run(x, mask, "f")[0], self._run(x, mask, "b")[0]
        return np.concatenate([f, b], 2) @ self.w["o"] + self.w["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        runs = {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        z = both @ self.w["o"] + self.w["c"]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        n = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
        dz = ((p - y) * mask / n).astype(np.float32)
        g = {"o": np.einsum("nt,nth->h", dz, both), "c": np.array([dz.sum()], np.float32)}
        h = HIDDEN
        for i, d in enumerate("fb"):
            _, hs, cs, gates, order = runs[d]
            dout = dz[:, :, None] * self.w["o"][i * h : (i + 1) * h]
            dh, dc = np.zeros_like(hs[0]), np.zeros_like(cs[0])
            dpre = np.zeros((x.shape[0], x.shape[1], 4 * h), np.float32)
            dwh = np.zeros_like(self.w[f"h{d}"])
            for k in range(len(order) - 1, -1, -1):
                t, gate = order[k], gates[k]
                m = mask[:, t, None]
                full = dh + dout[:, t]
                own, c = full * m, gate[:, h : 2 * h] * cs[k] + gate[:, :h] * gate[:, 3 * h :]
                th = np.tanh(c)
                dcell = dc * m + own * gate[:, 2 * h : 3 * h] * (1 - th * th)
                dgate = np.concatenate([dcell * gate[:, 3 * h :], dcell * cs[k], own * th, dcell * gate[:, :h]], 1)
                slope = gate * (1 - gate)
                slope[:, 3 * h :] = 1 - gate[:, 3 * h :] ** 2
                dzk = dgate * slope
                dpre[:, t] = dzk
                dwh += hs[k].T @ dzk
                dh = dzk @ self.w[f"h{d}"].T + full * (1 - m)
                dc = dcell * gate[:, h : 2 * h] + dc * (1 - m)
            g[f"x{d}"] = x.reshape(-1, INPUT).T @ dpre.reshape(-1, 4 * h)
            g[f"h{d}"], g[f"b{d}"] = dwh, dpre.sum((0, 1))
        return loss, g

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, seed: int = SEED) -> Labeller:
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            by_size = sorted(range(len(xs)), key=lambda i: len(xs[i]) + r.random())
            batches = [by_size[i : i + BATCH] for i in range(0, len(by_size), BATCH)]
            r.shuffle(batches)
            for b in batches:
                x, mask = padded([xs[i] for i in b])
                y = np.zeros(mask.shape, np.float32)
                for row, i in enumerate(b):
                    y[row, : len(ys[i])] = ys[i]
                _, g = self.gradients(x, mask, y)
                step += 1
                for k, v in g.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.999 * m2[k] + 0.001 * v * v
                    self.w[k] = (self.w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, xs: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """For each page, whether each block is main text. Pages of like length run together, ``cells`` steps at most."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(xs)
        order, at = sorted((i for i in range(len(xs)) if len(xs[i])), key=lambda i: len(xs[i])), 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(xs[order[to]]) <= cells:
                to += 1
            x, mask = padded([xs[i] for i in order[at:to]])
            z = self.logits(x, mask)
            for row, i in enumerate(order[at:to]):
                out[i] = z[row, : len(xs[i])] > 0
            at = to
        return out


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, xs))
    x, mask = np.zeros((len(xs), steps, INPUT), np.float32), np.zeros((len(xs), steps), np.float32)
    for i, v in enumerate(xs):
        x[i, : len(v)] = v
        mask[i, : len(v)] = 1
    return x, mask


def training_set(first: int, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    vectors, xs, ys = Vectors(), [], []
    for seed in range(first, first + n):
        text, labels = pages.page(seed)
        found = blocks(text)
        if len(found) == len(labels):
            xs.append(vectors.page(found))
            ys.append(np.array(labels, np.float32))
    return xs, ys


_trained: dict[tuple, Labeller] = {}


def labeller(n: int = PAGES, seed: int = SEED) -> Labeller:
    if (n, seed) not in _trained:
        _trained[n, seed] = Labeller(seed).fit(*training_set(seed * 1_000_000, n))
    return _trained[n, seed]


SCHEMA = "page_id long, url string, text string, n_chars long"


def main_text(pages_: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page. Nothing is shuffled."""
    weights = (model or labeller()).w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, vectors = Labeller(), Vectors()
        net.w = weights
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [blocks(h or "") for h in part.column(2).to_pylist()]
                keep = net.label([vectors.page(f) for f in found])
                texts = ["\n".join(b[1] for b, k in zip(f, ks, strict=True) if k) for f, ks in zip(found, keep, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages_.select("page_id", "url", "html").transform(mapped(run, SCHEMA))
