"""Main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks (runs of text between block-level tags). Each block is a vector of its
hashed tag path (element names, class and id words), its hashed words and a few proportions; a bidirectional LSTM in
numpy reads the sequence both ways, so every block is classified in the context of the whole page.

The weights are fitted on the driver, in seconds, on pages from a small generator of layouts whose labels are known by
construction, with fixed seeds: every run has the same weights.
"""

from __future__ import annotations

import functools
import html as htmllib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, pages
from .layouts import layout
from .wordhash import U, Words

# ---- from markup to leaf blocks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object head title canvas audio video".split())
RAW = frozenset("script style noscript template svg math iframe title canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea "
    "tfoot th thead title tr ul".split()
)
#: What an opening tag closes by itself, up to the nearest of the tags that stop it.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
_ENDS_P = BLOCK - frozenset("button label option select textarea caption legend td th tr tbody thead tfoot html head body title li dt dd summary".split()) | {"li", "dt", "dd"}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_END = re.compile(r"[>\"']")
_WORDY = re.compile(r"""(?:\s|^)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Element:
    """An open element; the path of a block is the chain of parents, so that paths share what they have in common."""

    __slots__ = ("parent", "tokens", "sums")

    def __init__(self, parent: Element | None, tokens: str):
        self.parent, self.tokens, self.sums = parent, tokens, None


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element | None, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked

    @property
    def path(self) -> tuple[str, ...]:
        out, at = [], self.element
        while at:
            out.append(at.tokens)
            at = at.parent
        return tuple(reversed(out))


class Scanner:
    """Ends of tags. A quotation mark with another one after it hides what lies between; a tag that then finds no end is cut at its
    first ``>``, and marks hide nothing from there on, so a page is read once whatever it holds."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.quotes = True

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``; -1 if there is none."""
        i = at
        while self.quotes and i <= self.last[">"]:
            m = _END.search(self.page, i)
            if not m or m[0] == ">":
                return m.start() if m else -1
            q = m[0]
            i = self.page.find(q, m.end()) + 1 if m.start() < self.last[q] else m.end()
        if at <= self.last[">"]:
            self.quotes = False
        return self.page.find(">", at)


def _tokens(tag: str, attributes: str) -> str:
    """The element's name and the words of its class, id and role, as one string."""
    if not attributes:
        return tag
    out = [tag]
    for name, *values in _WORDY.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append("is-hidden")
        elif name in ("hidden", "aria-hidden"):
            if name == "hidden" or value.lower() == "true":
                out.append("is-hidden")
        else:
            out += ["." + w.lower() for w in _PARTS.findall(value)]
    return " ".join(out)


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, from tag soup: open elements are tracked, stray closing tags ignored, a cut-off end
    taken as it is. Character references are decoded; white space in a block becomes one blank."""
    out: list[Block] = []
    names: list[str] = []
    elements: list[Element] = []
    depths: dict[str, list[int]] = defaultdict(list)  # of the open elements of each name
    boxes: list[int] = []  # of the open block-level elements
    pieces: list[str] = []
    linked = links = skipped = at = 0
    scan = Scanner(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(htmllib.unescape("".join(pieces)).split())
            if text:
                out.append(Block(elements[-1] if elements else None, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links, skipped
        while len(names) > depth:
            tag = names.pop()
            elements.pop()
            depths[tag].pop()
            if tag in BLOCK:
                boxes.pop()
            links -= tag == "a"
            skipped -= tag in SKIPPED

    def deepest(tags: tuple[str, ...]) -> int:
        return max((depths[t][-1] for t in tags if depths[t]), default=-1)

    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not skipped:
            pieces.append(page[at:lt])
            if links:
                linked += lt - at
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        end = scan.end(m.end()) if m else -1
        if end < 0:
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/"):  # a tag without an end
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            if not skipped:
                pieces.append("<")
            at = lt + 1
            continue
        at, closing, tag, attributes = end + 1, m[1], m[2].lower(), page[m.end() : end]
        if tag in BLOCK:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if closing:
            if depths[tag]:
                pop_to(depths[tag][-1])
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            i = deepest(ends)
            if i > deepest(stops):
                pop_to(i)
        elif tag in _ENDS_P and depths["p"] and boxes[-1] == depths["p"][-1]:  # nothing block-level is open within it
            pop_to(boxes[-1])
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        depths[tag].append(len(names))
        if tag in BLOCK:
            boxes.append(len(names))
        names.append(tag)
        elements.append(Element(elements[-1] if elements else None, _tokens(tag, attributes)))
        links += tag == "a"
        skipped += tag in SKIPPED
    flush()
    return out


# ---- from blocks to vectors

PATH_DIMS, WORD_DIMS, MORE = 96, 32, 8
DIMS = PATH_DIMS + WORD_DIMS + MORE


@functools.lru_cache(100_000)
def _token_sums(element: str, prefix: str) -> np.ndarray:
    """Hashed tokens of an element, signs by hash."""
    v = np.zeros(PATH_DIMS, np.float32)
    for token in element.split():
        h = zlib.crc32((prefix + token).encode())
        v[h % PATH_DIMS] += 1.0 if h >> 16 & 1 else -1.0
    return v


def _path_vector(element: Element | None) -> np.ndarray:
    """Sums over the path, the two innermost elements once more as such. Sums are kept at every element on the way, so each is
    reckoned once."""
    if element is None:
        return np.zeros(PATH_DIMS, np.float32)
    todo, at = [], element
    while at and at.sums is None:
        todo.append(at)
        at = at.parent
    for e in reversed(todo):
        own = _token_sums(e.tokens, "")
        e.sums = own if e.parent is None else e.parent.sums + own
    v = element.sums + _token_sums(element.tokens, "leaf:")
    if element.parent:
        v = v + _token_sums(element.parent.tokens, "leaf:")
    return np.clip(v, -2, 2)


_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?")] = True


def vectors(page: list[Block]) -> np.ndarray:
    """A row per block."""
    n = len(page)
    x = np.zeros((n, DIMS), np.float32)
    if not n:
        return x
    raw = [b.text.encode() for b in page]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(r) for r in raw], np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    w = Words(buf, offsets)
    words = np.maximum(np.diff(w.first), 1)
    for i, b in enumerate(page):
        x[i, :PATH_DIMS] = _path_vector(b.element)
    counts = np.bincount(w.doc * WORD_DIMS + (w.hash >> U(59)).astype(np.int64), minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / words[:, None]
    marks = np.diff(np.concatenate(([0], np.cumsum(_MARKS[buf], dtype=np.int64)))[offsets])
    at = np.arange(n)
    x[:, PATH_DIMS + WORD_DIMS :] = np.stack(
        [np.log1p(size) / 6, np.log1p(words) / 5, np.array([b.linked for b in page]) / np.maximum(size, 1), marks / words, at / n, at < 3, at >= n - 3, np.full(n, np.log1p(n) / 5)], axis=1
    )
    return x


# ---- the network

HIDDEN = 16


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Two LSTMs, one for each direction, and a logistic output over both states. Batches are padded at the end; the
    backward pass runs over each sequence reversed in place, so padding is never read before a block."""

    def __init__(self, seed: int = 3, hidden: int = HIDDEN):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {"o": r.normal(0, 0.2, 2 * hidden).astype(np.float32), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p["w" + d] = (r.normal(0, 1, (DIMS, 4 * hidden)) / np.sqrt(DIMS)).astype(np.float32)
            self.p["u" + d] = (r.normal(0, 1, (hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1.0
            self.p["b" + d] = bias

    def _run(self, d: str, x: np.ndarray, keep: bool):
        """States of every step; x is (steps, pages, DIMS)."""
        steps, n, _ = x.shape
        k, w, u = self.h, self.p["w" + d], self.p["u" + d]
        pre = x.reshape(-1, DIMS) @ w + self.p["b" + d]
        pre = pre.reshape(steps, n, 4 * k)
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, tape = np.empty((steps, n, k), np.float32), []
        for t in range(steps):
            z = pre[t] + h @ u
            gate = _sigmoid(z[:, : 3 * k])
            i, f, o, g = gate[:, :k], gate[:, k : 2 * k], gate[:, 2 * k :], np.tanh(z[:, 3 * k :])
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                tape.append((i, f, o, g, before, last, tc))
        return out, tape

    def _back(self, d: str, x: np.ndarray, tape: list, dout: np.ndarray, grads: dict) -> None:
        steps, n, k = dout.shape
        u = self.p["u" + d]
        dz_all, dh, dc = np.empty((steps, n, 4 * k), np.float32), np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        du = np.zeros_like(u)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, last, tc = tape[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            du += last.T @ dz
            dz_all[t] = dz
            dh, dc = dz @ u.T, dc * f
        flat = dz_all.reshape(-1, 4 * k)
        grads["u" + d], grads["w" + d], grads["b" + d] = du, x.reshape(-1, DIMS).T @ flat, flat.sum(0)

    @staticmethod
    def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(forward, reversed, mask), each over (steps, pages)."""
        steps = max(len(p) for p in pages)
        x, y, mask = np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages)), bool)
        for j, p in enumerate(pages):
            x[: len(p), j], y[: len(p), j], mask[: len(p), j] = p, p[::-1], True
        return x, y, mask

    @staticmethod
    def _flip(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """States of the reversed sequences, put back into the order of the blocks (and the other way round)."""
        steps, n = mask.shape
        at = mask.sum(0)[None, :] - 1 - np.arange(steps)[:, None]
        return np.where(mask[..., None], states[np.where(mask, at, 0), np.arange(n)[None, :]], 0)

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for every block of every page."""
        x, y, mask = self._batch(pages)
        hf, hb = self._run("f", x, False)[0], self._flip(self._run("b", y, False)[0], mask)
        s = _sigmoid(np.concatenate([hf, hb], axis=2) @ self.p["o"] + self.p["c"][0])
        return [s[: len(p), j] for j, p in enumerate(pages)]

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, dict]:
        """Mean cross-entropy of the blocks and its gradient."""
        x, y, mask = self._batch(pages)
        target = np.zeros(mask.shape, np.float32)
        for j, v in enumerate(labels):
            target[: len(v), j] = v
        (hf, tf), (hb, tb) = self._run("f", x, True), self._run("b", y, True)
        both = np.concatenate([hf, self._flip(hb, mask)], axis=2)
        s = _sigmoid(both @ self.p["o"] + self.p["c"][0])
        ds = np.where(mask, s - target, 0).astype(np.float32) / mask.sum()
        grads = {"o": np.einsum("tn,tnk->k", ds, both), "c": np.array([ds.sum()], np.float32)}
        dh = ds[..., None] * self.p["o"]
        self._back("f", x, tf, dh[..., : self.h], grads)
        self._back("b", y, tb, self._flip(dh[..., self.h :], mask), grads)
        value = -(np.where(mask, target * np.log(s + 1e-7) + (1 - target) * np.log(1 - s + 1e-7), 0)).sum() / mask.sum()
        return float(value), grads

    def step(self, pages: list[np.ndarray], labels: list[np.ndarray], state: dict, rate: float) -> float:
        """One Adam step."""
        value, grads = self.gradients(pages, labels)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        state["t"] = t = state.get("t", 0) + 1
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m, v = state.get(k, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[k] = (m, v)
            self.p[k] = (self.p[k] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return value


MAIN, OTHER = "\ue000", "\ue001"  # private characters that no page uses


def labelled_page(rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """Blocks of a made-up page; every text starts with a mark of its label, which is taken off again."""
    found = leaf_blocks(layout(rng, MAIN, OTHER))
    labels = np.array([b.text.startswith(MAIN) for b in found], np.float32)
    for b in found:
        b.text = b.text.replace(MAIN, "").replace(OTHER, "").strip() or "-"
    return found, labels


@functools.lru_cache(2)
def trained(n_pages: int = 1600, passes: int = 5, batch: int = 32, seed: int = 7) -> Labeller:
    rng = np.random.default_rng(seed)
    made = [labelled_page(rng) for _ in range(n_pages)]
    made = sorted(((vectors(b), y) for b, y in made if len(b)), key=lambda m: len(m[0]))
    parts = [made[i : i + batch] for i in range(0, len(made), batch)]
    model, state, k, total = Labeller(), {}, 0, passes * len(parts)
    for _ in range(passes):
        for i in rng.permutation(len(parts)):
            xs, ys = zip(*parts[i])
            model.step(list(xs), list(ys), state, 0.01 * (1 - k / total) + 0.0005)
            k += 1
    return model


def main_texts(model: Labeller, found: list[list[Block]], most: int = 20_000) -> list[str]:
    """The main text of every page; pages of like length share a batch of at most ``most`` padded blocks."""
    out = [""] * len(found)
    order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
    while order:
        longest, take = len(found[order[-1]]), 1
        while take < len(order) and (take + 1) * longest <= most:
            take += 1
        part, order = order[-take:], order[:-take]
        for i, s in zip(part, model.scores([vectors(found[i]) for i in part])):
            out[i] = " ".join(b.text for b, p in zip(found[i], s) if p >= 0.5)
    return out


def extract(df: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per input row.

    Defined results: null or empty html, and pages without main blocks, give an empty text; text outside any tag is a
    block like any other; repeated rows get equal texts; an empty table gives an empty result; other columns are
    ignored.
    """
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "html"):
            texts = main_texts(model, [leaf_blocks(p) for p in b.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return df.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(pages(spark, sf_dir))
