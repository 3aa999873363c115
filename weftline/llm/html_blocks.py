"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, the text between block-level tags. Each block is
read as a vector: its tag path (elements with their classes, ids and roles,
hashed), its words (hashed), and a few sizes. A bidirectional LSTM in numpy runs
over the page's blocks and labels each as main text or not, with the whole page
as context. It is trained here (train_model) on made-up pages whose layouts,
class names, languages and lengths vary; the weights are kept in data/.

Defined cases: a null or empty page gives an empty text; broken markup is read
as far as it goes (unclosed elements end with their parents, an open head ends
where flow content begins, an unended tag is text, an unended drawing, frame or
object is passed over by its tag alone); scripts, styles, comments and the head
are never text; nothing is cut off however long a page or a block is (all blocks
and all words are read); rows that repeat give the same text each; an empty table
gives no row; columns text and n_chars among those kept are replaced.
"""

from __future__ import annotations

import html
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as X

PATH_DIM, WORD_DIM, SIZES = 256, 32, 9
HIDDEN = 20
WEIGHTS = Path(__file__).parent / "data" / "block_lstm.npz"

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d")
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "object", "canvas", "audio", "video"}
#: Without an end these take the rest of the page.
_TO_END = {"script", "style", "textarea", "title"}
_IN_HEAD = _RAW | {"html", "head", "meta", "link", "base"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "ruby", "rt", "rp", "math", "mrow", "mi", "mn", "mo", "ms", "mtext", "mfrac", "msqrt", "mroot", "msup", "msub", "msubsup", "mover", "munder", "munderover", "mspace", "mstyle", "mfenced", "semantics"}
_SCOPE = {"div", "article", "section", "main", "td", "th", "table", "aside", "nav", "header", "footer", "form", "blockquote", "body", "ul", "ol", "li", "dd", "figure", "details"}
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: tuple[str, ...], text: str, linked: float) -> None:
        self.path, self.text, self.linked = path, text, linked


def _described(tag: str, attrs: str) -> str:
    """The tag with its class, id and role words, as 'div ad'."""
    if not attrs:
        return tag
    words = [tag]
    for name, *values in _ATTR.findall(attrs):
        name = name.lower()
        if name in ("hidden", "aria-hidden"):
            words.append("hidden")
        else:
            words += _PART.findall("".join(values).lower())
    return " ".join(words)


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks in page order: path of elements from the outside, text, and the share of it in links."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    linked = 0
    at, n = 0, len(page)

    def flush():
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(tuple(d for t, d in stack if t not in _INLINE), text, min(1.0, linked / max(1, len(text)))))
            held.clear()
            linked = 0

    def close(k):
        del stack[k:]

    while at < n:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            held.append(piece)
            if any(t == "a" for t, _ in stack):
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in _INLINE:
            if tag == "br":
                held.append(" ")
            elif m[1]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] not in _INLINE:
                        break
            elif tag not in _VOID and not m[3].endswith("/"):
                stack.append((tag, tag))
            continue
        flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in _RAW:
            if tag == "svg" and m[3].endswith("/"):
                continue
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n if tag in _TO_END else at
            continue
        if tag not in _IN_HEAD:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "head":
                    close(k)
                    break
        ends = _ENDS.get(tag, {"p"} if tag not in _VOID else set())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ends:
                close(k)
                break
            if stack[k][0] in _SCOPE:
                break
        if tag not in _VOID and not m[3].endswith("/"):
            stack.append((tag, _described(tag, m[3])))
    flush()
    return [b for b in out if not any(d.split(" ", 1)[0] == "head" for d in b.path)]


_slots: dict[str, int] = {}


def _slot(token: str, dim: int) -> int:
    got = _slots.get(token)
    if got is None:
        if len(_slots) > 200_000:
            _slots.clear()
        got = _slots[token] = zlib.crc32(token.encode()) % dim
    return got


def vectors(blocks: list[Block]) -> np.ndarray:
    """A row for each block: hashed path, hashed words, sizes."""
    out = np.zeros((len(blocks), PATH_DIM + WORD_DIM + SIZES), np.float32)
    paths: dict[tuple, list[int]] = {}
    for k, b in enumerate(blocks):
        slots = paths.get(b.path)
        if slots is None:
            tokens = set()
            for element in b.path:
                tag, *names = element.split(" ")
                tokens.add(f"<{tag}")
                tokens.update(f".{x}" for x in names)
            if b.path:
                tokens.add(f"^{b.path[-1].split(' ')[0]}")
            slots = paths[b.path] = [_slot(t, PATH_DIM) for t in tokens]
        out[k, slots] = 1
        words = b.text.lower().split()
        out[k, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount([_slot(w, WORD_DIM) for w in words], minlength=WORD_DIM) / max(1.0, len(words)) ** 0.5
        n = len(b.text)
        out[k, PATH_DIM + WORD_DIM :] = (
            np.log1p(n) / 6, np.log1p(len(words)) / 5, b.linked, b.text[-1] in ".!?…\"'", sum(b.text.count(c) for c in ".,;") / (len(words) + 1), len(_DIGITS.findall(b.text)) / n, k / len(blocks), len(blocks) < 4, any(c in b.text for c in "©|»›·")
        )
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class BiLSTM:
    """Two LSTMs over a sequence, one from either end, and a logistic unit on both states."""

    NAMES = ("wx0", "wh0", "b0", "wx1", "wh1", "b1", "wo", "bo")

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = params

    @classmethod
    def fresh(cls, seed: int, dim: int = PATH_DIM + WORD_DIM + SIZES, hidden: int = HIDDEN) -> BiLSTM:
        r = np.random.default_rng(seed)
        p = {}
        for d in "01":
            p["wx" + d] = r.normal(0, 0.08, (dim, 4 * hidden))
            p["wh" + d] = r.normal(0, hidden**-0.5 / 2, (hidden, 4 * hidden))
            p["b" + d] = np.zeros(4 * hidden)
            p["b" + d][hidden : 2 * hidden] = 1
        p["wo"], p["bo"] = r.normal(0, 0.1, 2 * hidden), np.zeros(1)
        return cls(p)

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> BiLSTM:
        with np.load(path) as z:
            return cls({k: z[k].astype(np.float32) for k in cls.NAMES})

    def _run(self, x, d, lengths, keep):
        """States (T, B, H) of direction d over x (T, B, D); steps past a sequence's end leave the state as it is."""
        p = self.p
        wh, h = p["wh" + d], p["wh" + d].shape[0]
        z = x @ p["wx" + d] + p["b" + d]
        state = cell = np.zeros((x.shape[1], h), z.dtype)
        out, trace = np.zeros((len(x), x.shape[1], h), z.dtype), []
        for t in range(len(x)) if d == "0" else range(len(x) - 1, -1, -1):
            g = z[t] + state @ wh
            i, f, o = _sigmoid(g[:, :h]), _sigmoid(g[:, h : 2 * h]), _sigmoid(g[:, 2 * h : 3 * h])
            a = np.tanh(g[:, 3 * h :])
            live = (t < lengths)[:, None]
            c = np.where(live, f * cell + i * a, cell)
            tc = np.tanh(c)
            s = np.where(live, o * tc, state)
            if keep:
                trace.append((t, i, f, o, a, cell, tc, state, live))
            state, cell = s, c
            out[t] = s
        return out, trace

    def logits(self, x, lengths, keep=False):
        a, ta = self._run(x, "0", lengths, keep)
        b, tb = self._run(x, "1", lengths, keep)
        h = np.concatenate([a, b], 2)
        return h @ self.p["wo"] + self.p["bo"], h, (ta, tb)

    def grads(self, x, y, lengths):
        z, h, traces = self.logits(x, lengths, keep=True)
        live = np.arange(len(x))[:, None] < lengths[None, :]
        prob = _sigmoid(z)
        err = (prob - y) * live / live.sum()
        loss = -(np.where(y > 0, np.log(prob + 1e-12), np.log(1 - prob + 1e-12)) * live).sum() / live.sum()
        p, size = self.p, HIDDEN
        g = {"wo": np.einsum("tb,tbh->h", err, h), "bo": np.array([err.sum()])}
        dh_all = err[:, :, None] * p["wo"]
        for d, trace in zip("01", traces, strict=True):
            part = dh_all[:, :, :size] if d == "0" else dh_all[:, :, size:]
            dz = np.zeros((*x.shape[:2], 4 * size))
            dwh = np.zeros_like(p["wh" + d])
            dh, dc = np.zeros(part.shape[1:]), np.zeros(part.shape[1:])
            for t, i, f, o, a, c0, tc, s0, on in reversed(trace):
                dh = dh + part[t]
                ds = np.where(on, dh, 0)
                dct = np.where(on, dc + ds * o * (1 - tc * tc), 0)
                dg = np.concatenate([dct * a * i * (1 - i), dct * c0 * f * (1 - f), ds * tc * o * (1 - o), dct * i * (1 - a * a)], 1)
                dz[t] = dg
                dwh += s0.T @ dg
                dh = np.where(on, dg @ p["wh" + d].T, dh)
                dc = np.where(on, dct * f, dc)
            g["wx" + d] = np.einsum("tbd,tbg->dg", x, dz, optimize=True)
            g["wh" + d], g["b" + d] = dwh, dz.sum((0, 1))
        return loss, g

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of main text of each block of each page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            group = order[at : at + 64]
            group = group[: max(1, 20_000 // len(pages[group[-1]]))]
            at += len(group)
            lengths = np.array([len(pages[k]) for k in group])
            x = np.zeros((lengths.max(), len(group), pages[group[0]].shape[1]), np.float32)
            for j, k in enumerate(group):
                x[: lengths[j], j] = pages[k]
            z = self.logits(x, lengths)[0]
            for j, k in enumerate(group):
                out[k] = _sigmoid(z[: lengths[j], j])
        return out


def train_model(pages: int = 2500, epochs: int = 6, seed: int = 11, batch: int = 24, rate: float = 0.01) -> BiLSTM:
    """Fit the labeller on made-up pages with Adam."""
    from .page_maker import make_page

    made = [make_page(seed * 100_003 + k) for k in range(pages)]
    data = [(vectors([b for b, _ in m]), np.array([y for _, y in m], float)) for m in (labelled(page, main) for page, main in made) if m]
    model = BiLSTM.fresh(seed)
    order = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    step = 0
    for epoch in range(epochs):
        mixed = order.permutation(len(data))
        for a in range(0, len(mixed), batch):
            group = [data[k] for k in mixed[a : a + batch]]
            lengths = np.array([len(x) for x, _ in group])
            x, y = np.zeros((lengths.max(), len(group), group[0][0].shape[1])), np.zeros((lengths.max(), len(group)))
            for j, (f, t) in enumerate(group):
                x[: len(f), j], y[: len(f), j] = f, t
            # words are dropped at random, so that layout decides where words don't
            x[:, :, PATH_DIM : PATH_DIM + WORD_DIM] *= order.random((1, len(group), 1)) > 0.4
            _, g = model.grads(x, y, lengths)
            step += 1
            scale = min(1.0, 1.0 / (np.sqrt(sum((q * q).sum() for q in g.values())) + 1e-9))
            lr = rate * (1 - epoch / epochs)
            for k in model.p:
                q = g[k] * scale
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                model.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def labelled(page: str, main: set[str]) -> list[tuple[Block, int]]:
    """The page's blocks, 1 where the block's text is one of main."""
    return [(b, int(b.text in main)) for b in blocks_of(page)]


def main_text(pages: list[str | None], model: BiLSTM) -> list[str]:
    cut = [blocks_of(p) for p in pages]
    found = model.label([vectors(b) for b in cut])
    return ["\n".join(b.text for b, p in zip(blocks, prob, strict=True) if p >= 0.5) for blocks, prob in zip(cut, found, strict=True)]


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep's columns, text and n_chars (code points) of each row; one map, no shuffle."""
    X.prepare(pages.sparkSession)
    keep = tuple(c for c in keep if c.lower() not in ("text", "n_chars"))
    params = {k: w.astype(np.float32) for k, w in BiLSTM.load().p.items()}
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string, n_chars long"])

    def run(batches):
        model = BiLSTM(params)
        for b in batches:
            column, size, at = b.column(len(keep)), 0, 0
            for k in range(b.num_rows):
                size += len(column[k].as_buffer() or b"") if column[k].is_valid else 0
                if size > 4_000_000 or k - at >= 255 or k == b.num_rows - 1:
                    texts = main_text(column.slice(at, k + 1 - at).to_pylist(), model)
                    yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, k + 1 - at) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])
                    at, size = k + 1, 0

    return pages.select(*keep, html_col).mapInArrow(run, schema)
