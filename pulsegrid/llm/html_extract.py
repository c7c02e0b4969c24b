"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags. Each block becomes a vector (hashed tag path, what its path's names say, hashed
words, size, share of link text), and a bidirectional LSTM in numpy reads the page's blocks in order and back and labels each as article or not.
It is trained when the query starts, on at most TRAIN_PAGES pages (the lowest by hash of page_id), against the labels that the pages' own semantic
elements give (inside article or main, outside navigation, adverts, forms, comments and the like), with such blocks mixed in from names that the sample
may lack and with semantic elements hidden at random, so that paths, words and neighbours all carry weight. Same pages, same model.

A block's path counts with its innermost PATH_NAMES names. Pages of over LONG_BLOCKS blocks are read in stretches, the network's state carried from one to the next
in each direction, so that a page of any length takes a few MB beside its text.

Defined results: null html counts as empty and gives empty text, as does a page without article blocks. Broken markup never fails: an unclosed tag or
comment is text or runs to the end. Rows that share a page_id are handled alike. Extra columns are ignored, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 300
#: Characters of a page that training reads at most; prediction reads all.
TRAIN_CHARS = 200_000
#: Blocks of a page used in training; prediction reads all.
TRAIN_BLOCKS = 120
LONG_BLOCKS = 20_000
PATH_NAMES = 24
PATH_DIMS, WORD_DIMS, HIDDEN = 48, 24, 12
EPOCHS, RATE, SEED = 14, 0.01, 7

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN_TEXT = frozenset("script style noscript template title textarea select option button svg math iframe object canvas head".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements that a start tag ends at the top of the stack (besides p and inline ones), and in a table or select at any depth in it: their end tags may be left out.
_SECTIONS = frozenset("td th tr thead tbody tfoot caption colgroup".split())
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"]),
    "td": frozenset(["td", "th", "caption", "colgroup"]), "th": frozenset(["td", "th", "caption", "colgroup"]), "tr": frozenset(["td", "th", "tr", "caption", "colgroup"]), "thead": _SECTIONS, "tbody": _SECTIONS, "tfoot": _SECTIONS,
}
WITHIN = {"option": "select", "optgroup": "select", **dict.fromkeys(("td", "th", "tr", "thead", "tbody", "tfoot"), "table")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names in tags, classes, ids and roles that mark what is not the article, and what is.
BESIDE = frozenset(
    "nav navbar navigation menu header masthead banner footer foot sidebar aside side complementary notice cookie cookies consent gdpr ad ads advert adverts advertisement sponsor sponsored promo form login signup subscribe newsletter search comment comments discussion replies reply disqus share sharing social related breadcrumb breadcrumbs pager pagination copyright widget popup modal toolbar".split()
)
ARTICLE = frozenset("article main post entry content story body-text".split())


class _Node:
    """An open element. Elements that begin alike under the same parent share one."""

    __slots__ = ("tag", "beside", "article", "hidden", "link", "path", "inline", "below")

    def __init__(self, tag: str, names: tuple[str, ...], up: _Node | None):
        self.tag = tag
        self.beside = (up.beside if up else 0) + any(x in BESIDE for x in names)
        self.article = (up.article if up else 0) + (tag in ("article", "main"))
        self.hidden = bool(up and up.hidden) or tag in HIDDEN_TEXT
        self.link = bool(up and up.link) or tag == "a"
        self.path = ((up.path if up else ()) + names)[-PATH_NAMES:]
        self.inline = tag in INLINE
        self.below: dict[str, _Node] = {}

    def child(self, start: str, tag: str, attributes: str) -> _Node:
        found = self.below.get(start)
        if found is None:
            names = [tag]
            if "=" in attributes:
                for a in ATTRIBUTE.finditer(attributes):
                    names += re.findall(r"[a-z][a-z-]*[a-z]|[a-z]", (a[1] or a[2] or a[3] or "").lower())
                names += [y for x in names[1:] if "-" in x for y in x.split("-")]
            found = _Node(tag, tuple(dict.fromkeys(names)), self)
            if len(self.below) < 1000:
                self.below[start] = found
        return found


def blocks(page: str) -> list[tuple[str, _Node, float]]:
    """(text, innermost block element, share of link text) of each block with text, in page order."""
    out: list[tuple[str, _Node, float]] = []
    stack: list[_Node] = [_Node("html", (), None)]
    opened: dict[str, list[int]] = {}  # positions in the stack by tag, the root's left out
    text: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if text:
            joined = "".join(text)
            whole = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            if whole:
                k = len(stack) - 1
                while k and stack[k].inline:
                    k -= 1
                out.append((whole, stack[k], min(1.0, linked / len(whole))))
            text.clear()
            linked = 0

    def drop(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag].pop()
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        raw = False
        for m in MARKUP.finditer(page, at):
            start = m.start()
            top = stack[-1]
            if start > at and not top.hidden:
                text.append(page[at:start])
                if top.link:
                    linked += start - at
            at = m.end()
            closing, tag, attributes, closing2, tag2, attributes2 = m.groups()
            tag = (tag or tag2 or "").lower()
            if not tag:
                if page.startswith("<![CDATA[", start) and not top.hidden:
                    text.append(html.escape(m.group()[9:].removesuffix("]]>")))
                continue
            inline = tag in INLINE
            if closing or closing2:
                if not inline:
                    close()
                if opened.get(tag):
                    drop(opened[tag][-1])
                continue
            if tag == "br":
                text.append(" ")
                continue
            if not inline:
                close()
                ends = ENDS.get(tag, ())
                if (ends or tag not in HIDDEN_TEXT) and tag not in VOID:
                    while len(stack) > 1 and (stack[-1].inline or stack[-1].tag == "p" or stack[-1].tag in ends):
                        drop(len(stack) - 1)
                    if opened.get(WITHIN.get(tag, "")):
                        outer = opened[WITHIN[tag]][-1]
                        ended = [opened[x][-1] for x in ends if opened.get(x) and opened[x][-1] > outer]
                        if ended:
                            drop(min(ended))
            attributes = attributes or attributes2 or ""
            if tag in VOID or attributes.endswith("/"):
                continue
            opened.setdefault(tag, []).append(len(stack))
            stack.append(stack[-1].child(m.group(), tag, attributes))
            if tag in RAW:  # its content is no markup
                found = re.compile(f"</{tag}", re.I).search(page, at)
                at, raw = found.start() if found else end, True
                break
        if not raw:
            if at < end and not stack[-1].hidden:
                text.append(page[at:])
            break
    close()
    return out


def _bucket(word: str, dims: int) -> int:
    return zlib.crc32(word.encode()) % dims


EXTRA = 9
DIMS = PATH_DIMS + WORD_DIMS + EXTRA


def vectors(found: list[tuple[str, _Node, float]], memo: dict[str, int], hide: bool = False) -> np.ndarray:
    """(blocks, DIMS) features. memo: buckets of words met before. hide: without the names that mark an article."""
    n = len(found)
    out = np.zeros((n, DIMS), dtype=np.float32)
    if not n:
        return out
    paths: dict[int, np.ndarray] = {}
    buckets: list[int] = []
    counts, marks = [], []
    for i, (text, node, _) in enumerate(found):
        v = paths.get(id(node))
        if v is None:
            v = paths[id(node)] = np.zeros(PATH_DIMS + WORD_DIMS + 6, dtype=np.float32)
            for name in node.path:
                if not (hide and name in ARTICLE):
                    v[_bucket(name, PATH_DIMS)] = 1
            v[PATH_DIMS + WORD_DIMS :] = (
                min(node.beside, 2),
                0 if hide else min(node.article, 1),
                0 if hide else any(x in ARTICLE for x in node.path),
                node.tag[:1] == "h" and node.tag[1:].isdigit(),
                node.tag == "p",
                node.tag == "li",
            )
        out[i, : PATH_DIMS + WORD_DIMS + 6] = v
        words = text.split(" ")
        try:
            buckets += [memo[w] for w in words]
        except KeyError:
            for w in words:
                if w not in memo:
                    memo[w] = _bucket(w.lower().strip(".,;:!?"), WORD_DIMS)
            buckets += [memo[w] for w in words]
        counts.append(len(words))
        marks.append(text.count(".") + text.count(","))
    size = np.array(counts)
    at = np.array(buckets) + np.repeat(np.arange(n) * WORD_DIMS, size)
    out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount(at, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS) / size[:, None]
    out[:, -3] = np.log1p(size) / 5
    out[:, -2] = [x for _, _, x in found]
    out[:, -1] = np.minimum(1.0, np.array(marks) / size)
    return out


class Labeller:
    """Bidirectional LSTM with a logistic output; batches of padded sequences."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 0.15, (DIMS + HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])  # forget gate open at first
        self.p["o"] = rng.normal(0, 0.2, 2 * HIDDEN)
        self.p["k"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list]:
        """Hidden values in one direction, and what training needs of each step, or else the state at the end."""
        n, steps, _ = x.shape
        h, c = state or (np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype))
        saved, out = [], np.zeros((n, steps, HIDDEN), x.dtype)
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        w, bias = self.p["w" + d].astype(x.dtype), self.p["c" + d].astype(x.dtype)
        inputs = x @ w[:DIMS] + bias
        for t in order:
            z = inputs[:, t] + h @ w[DIMS:]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tc = np.tanh(new)
            m = mask[:, t : t + 1]
            if keep:
                saved.append((t, h, c, f, i, o, g, tc, m))
            c = m * new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[:, t] = h
        return out, saved if keep else [h, c]

    def _forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        hf, sf = self._run(x, mask, "f", keep)
        hb, sb = self._run(x, mask, "b", keep)
        both = np.concatenate([hf, hb], axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["k"], -30, 30))), (both, sf, sb)

    def predict(self, pages: list[np.ndarray], batch: int = 256) -> list[np.ndarray]:
        """Probability of each block to be article."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and n < batch and (n + 1) * len(pages[order[at + n]]) <= 20_000:
                n += 1
            some = order[at : at + n]
            at += n
            p, _ = self._forward(*_padded([pages[i] for i in some], np.float32))
            for k, i in enumerate(some):
                out[i] = p[k, : len(pages[i])]
        return out

    def predict_long(self, found: list[tuple[str, _Node, float]], memo: dict[str, int], stretch: int = LONG_BLOCKS) -> np.ndarray:
        """As predict() for one page, without the vectors of more than one stretch at a time."""
        cuts = [(a, min(a + stretch, len(found))) for a in range(0, len(found), stretch)]
        both = np.zeros((len(found), 2 * HIDDEN), np.float32)
        for d, order, at in (("f", cuts, slice(0, HIDDEN)), ("b", cuts[::-1], slice(HIDDEN, 2 * HIDDEN))):
            state = None
            for a, b in order:
                out, state = self._run(vectors(found[a:b], memo)[None], np.ones((1, b - a), np.float32), d, False, state and tuple(state))
                both[a:b, at] = out[0]
        return 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["k"], -30, 30)))

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = RATE) -> None:
        rng = np.random.default_rng(SEED + 1)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), 32):
                some = order[at : at + 32]
                x, mask = _padded([pages[i] for i in some])
                y = _padded([labels[i][:, None] for i in some])[0][:, :, 0]
                grads = self._gradients(x, mask, y)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (both, sf, sb) = self._forward(x, mask, keep=True)
        err = (p - y) * mask / max(1.0, mask.sum())
        grads = {"o": (both * err[:, :, None]).sum(axis=(0, 1)), "k": np.array([err.sum()])}
        back = err[:, :, None] * self.p["o"]
        for d, saved, dh_all in (("f", sf, back[:, :, :HIDDEN]), ("b", sb, back[:, :, HIDDEN:])):
            w = self.p["w" + d]
            dw, dc_bias = np.zeros_like(w), np.zeros_like(self.p["c" + d])
            dh, dc = np.zeros_like(saved[0][1]), np.zeros_like(saved[0][2])
            for t, h, c, f, i, o, g, tc, m in reversed(saved):
                total = dh_all[:, t] + dh
                inner = m * total
                dnew = m * dc + inner * o * (1 - tc * tc)
                dz = np.concatenate([dnew * c * f * (1 - f), dnew * g * i * (1 - i), inner * tc * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
                dw[:DIMS] += x[:, t].T @ dz
                dw[DIMS:] += h.T @ dz
                dc_bias += dz.sum(axis=0)
                dh = (1 - m) * total + dz @ w[DIMS:].T
                dc = (1 - m) * dc + dnew * f
            grads["w" + d], grads["c" + d] = dw, dc_bias
        return grads


def _padded(rows: list[np.ndarray], kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask = np.zeros((len(rows), steps, rows[0].shape[1]), kind), np.zeros((len(rows), steps), kind)
    for k, r in enumerate(rows):
        x[k, : len(r)] = r
        mask[k, : len(r)] = 1
    return x, mask


def weak_labels(found: list[tuple[str, _Node, float]]) -> np.ndarray:
    """1 for article blocks, by the page's semantic elements; without any, all blocks whose path has no name of something beside the article."""
    semantic = any(node.article for _, node, _ in found)
    return np.array([float(node.beside == 0 and (node.article > 0 or not semantic)) for _, node, _ in found])


def _mixed(found: list[tuple[str, _Node, float]], rng: np.random.Generator) -> list[tuple[str, _Node, float]]:
    """A page with blocks of other kinds put in: words of the page under names that mark what is not the article."""
    names = sorted(BESIDE)
    out = list(found)
    for _ in range(int(rng.integers(0, 4))):
        k = int(rng.integers(0, len(out) + 1))
        up = out[min(k, len(out) - 1)][1]
        words = " ".join(t for t, _, _ in found[:3]).split(" ")
        for _ in range(int(rng.integers(1, 3))):
            picked = " ".join(words[int(i)] for i in rng.integers(0, len(words), int(rng.integers(1, 25))))
            out.insert(k, (picked, _Node("p" if rng.random() < 0.5 else "div", ("div", names[int(rng.integers(0, len(names)))]), up if rng.random() < 0.5 else None), 0.0))
    return out


def train_labeller(pages: list[str]) -> Labeller:
    rng, memo, xs, ys = np.random.default_rng(SEED), {}, [], []
    for page in pages:
        found = blocks(page)
        if not found:
            continue
        for variant in (found, _mixed(found, rng)):
            at = int(rng.integers(0, max(1, len(variant) - TRAIN_BLOCKS + 1)))
            cut = slice(at, at + TRAIN_BLOCKS)
            xs.append(vectors(variant, memo, hide=variant is not found and rng.random() < 0.3)[cut])
            ys.append(weak_labels(variant)[cut])
    model = Labeller()
    if xs:
        model.train(xs, ys)
    return model


def extract(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    ids = F.broadcast(pages.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages))
    sample = pages.select("page_id", "html").where("html is not null").join(ids, "page_id", "left_semi")
    sample = sample.select("page_id", F.substring("html", 1, TRAIN_CHARS).alias("html")).orderBy("page_id", "html").limit(train_pages).collect()
    model = train_labeller([r["html"] for r in sample])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                found = [blocks(x or "") for x in some.column(2).to_pylist()]
                chances = model.predict([vectors(f, memo) if len(f) <= LONG_BLOCKS else vectors([], memo) for f in found])
                chances = [c if len(f) <= LONG_BLOCKS else model.predict_long(f, memo) for c, f in zip(chances, found, strict=True)]
                texts = ["\n".join(t for (t, _, _), p in zip(f, c, strict=True) if p >= 0.5) for f, c in zip(found, chances, strict=True)]
                if len(memo) > 500_000:
                    memo = {}
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(label, "page_id long, url string, text string, n_chars long")
