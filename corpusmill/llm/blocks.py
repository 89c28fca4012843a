"""Main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks, each with the path of tags (and
class and id names) above it and its words. A bidirectional LSTM in numpy reads
hashed vectors of both and labels every block in the context of the whole page.
Names and words are hashed with signs into thousands of slots; a block is the
sum of the embeddings of its slots, so cost follows the names and words present.

The network is trained here, on a bounded sample of pages (``sample_pages``, by
hash) and variants of them in other layouts: their article blocks put under
other containers, boilerplate of other kinds around and inside them. Labels come
from the markup of the sample (inside ``article`` or ``main``, outside of menus
and the like); the network sees names and words, and generalises to pages where
the container has other names. All names above a block and all its words are
hashed. Sample pages are learnt whole, in windows of ``WINDOW`` blocks, which bound
the memory of a training step; pages to be labelled are read in one go.

Scripts, styles, templates, forms' controls, comments and the head hold no
blocks. Null and empty html gives an empty text. Pages of any length are read
whole. Unclosed and crossed tags are closed by their parents. Null page_ids and
urls are kept. Repeated rows are labelled alike. Empty tables give no rows.
Extra columns are ignored.
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
from pyspark.sql import functions as F

SAMPLE_PAGES = 240
PATH_SIZE, WORD_SIZE, EMBED, HIDDEN = 8191, 8192, 32, 24
EPOCHS, RATE, BATCH = 14, 0.01, 32
KEEP_WORDS = 0.5
LABEL_BATCH = 256
WINDOW = 512
WORD_SCALE = 2.0
OUT = "page_id long, url string, text string, n_chars long"

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN_NOW = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+|[0-9]+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template iframe svg math canvas object select option textarea button head title".split())
RAW = set("script style textarea title".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
# A new block of these ends an open paragraph.
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

# Words for the sample's labels and its variants.
MAIN_TAGS = {"article", "main"}
SIDE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
SIDE_NAMES = set(
    "ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent notice notices alert popup newsletter subscribe signup sidebar side menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer copyright legal comments comment replies reply discussion disqus share social related recommended recommendations trending widget tags login search pagination".split()
)
MAIN_NAMES = "content article post entry story body main text page-content article-body post-content entry-content story-body".split()


class Block:
    __slots__ = ("path", "text", "link")

    def __init__(self, path: tuple, text: str, link: bool):
        self.path, self.text, self.link = path, text, link


def _names(tag: str, attributes: str) -> tuple:
    """A tag with the words of its class, id and role."""
    found = [tag]
    if attributes and "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            found += NAME.findall((m[2] or m[3] or m[4] or "").lower())
    return tuple(found)


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order; inline tags do not part a block."""
    page = page or ""
    stack: list[tuple[str, tuple, bool]] = []  # tag, names, silent
    blocks: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                path = tuple(names for tag, names, _ in stack if tag not in INLINE)
                blocks.append(Block(path, text, linked * 2 > len(text)))
            parts.clear()
        linked = 0

    def pop_to(depth: int):
        if any(tag not in INLINE for tag, _, _ in stack[depth:]):
            flush()
        del stack[depth:]

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not (stack and stack[-1][2]):
            parts.append(page[at:end])
            if any(tag == "a" for tag, _, _ in stack):
                linked += end - at
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        silent = bool(stack and stack[-1][2]) or tag in SILENT or ("hidden" in m[3] or "none" in m[3]) and bool(HIDDEN_NOW.search(m[3]))
        if tag in VOID:
            if tag in ("br", "hr") and not silent:
                parts.append(" ")
            continue
        if tag not in INLINE or silent:
            if not silent:
                flush()
            elif tag not in INLINE and tag not in SILENT:
                flush()
            same = {"li": ("ul", "ol"), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",)}.get(tag)
            for k in range(len(stack) - 1, -1, -1):
                if (tag in ENDS_P and stack[k][0] == "p") or (same and stack[k][0] == tag):
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE and (not same or stack[k][0] in same):
                    break
        if m[3].endswith("/") and tag not in INLINE:
            continue
        stack.append((tag, _names(tag, m[3]), silent))
        if tag in RAW:  # nothing inside is markup
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            stack.pop()
    flush()
    return blocks


# ---- vectors --------------------------------------------------------------------------

_SLOTS: dict[tuple[str, int], int] = {}
PIECE = 65536


def _slot(word: str, size: int) -> int:
    """Signed slot: twice the slot, and one more for the negative sign."""
    if len(_SLOTS) > 200_000:
        _SLOTS.clear()
    hashed = zlib.crc32(word.encode("utf-8", "replace"))
    found = _SLOTS[word, size] = hashed % size * 2 + (hashed >> 31)
    return found


class Rows:
    """Sparse rows, one per block: entries ``at`` (ascending), ``slot``, ``value``, and the dense ``rest``."""

    __slots__ = ("at", "slot", "value", "rest", "_order")

    def __init__(self, at: np.ndarray, slot: np.ndarray, value: np.ndarray, rest: np.ndarray):
        self.at, self.slot, self.value, self.rest, self._order = at, slot, value, rest, None

    def __len__(self) -> int:
        return len(self.rest)

    def summed(self, table: np.ndarray) -> np.ndarray:
        """Sum of the rows of ``table`` under the entries of each block."""
        out = np.zeros((len(self), table.shape[1]), table.dtype)
        for a in range(0, len(self.at), PIECE):
            at = self.at[a : a + PIECE]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            out[at[first]] += np.add.reduceat(table[self.slot[a : a + PIECE]] * self.value[a : a + PIECE, None], first, axis=0)
        return out

    def by_slot(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries ordered by slot, and where each slot begins."""
        if self._order is None:
            order = np.argsort(self.slot, kind="stable")
            slots = self.slot[order]
            self._order = order, np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        return self._order

    def spread(self, d: np.ndarray, grad: np.ndarray) -> None:
        """Adds the gradient of ``summed`` to ``grad``, given that of its result."""
        if not len(self.at):
            return
        order, first = self.by_slot()
        grad[self.slot[order[first]]] += np.add.reduceat(d[self.at[order]] * self.value[order, None], first, axis=0)

    def windows(self, size: int) -> list[tuple[int, Rows]]:
        """Consecutive pieces of at most ``size`` rows, with the row each begins at; together they are the page."""
        out = []
        for a in range(0, len(self), size):
            first, last = np.searchsorted(self.at, [a, a + size])
            out.append((a, Rows(self.at[first:last] - a, self.slot[first:last], self.value[first:last], self.rest[a : a + size])))
        return out

    def thinned(self, rng: np.random.Generator) -> Rows:
        """The same rows without some of their words, for training: no page may be told by its rare words alone."""
        keep = np.where(self.slot < PATH_SIZE, 1.0, (rng.random(len(self.slot)) < KEEP_WORDS) / KEEP_WORDS).astype(np.float32)
        rows = Rows(self.at, self.slot, self.value * keep, self.rest)
        rows._order = self.by_slot() if len(self.at) else None
        return rows


def vectors(blocks: list[Block]) -> Rows:
    """One row per block: hashed path, hashed words, length, link share, place."""
    paths: dict[tuple, list] = {}
    known = _SLOTS.get
    codes: list[int] = []
    sizes, values = np.zeros((len(blocks), 2), np.int64), np.ones((len(blocks), 2), np.float32)
    rest = np.zeros((len(blocks), 4), np.float32)
    for n, block in enumerate(blocks):
        path = paths.get(block.path)
        if path is None:
            path = paths[block.path] = [known((name, PATH_SIZE)) or _slot(name, PATH_SIZE) for name in {name for names in block.path for name in names}]
        words = set(block.text.lower().split())
        codes += path
        codes += [2 * PATH_SIZE + (known((w, WORD_SIZE)) or _slot(w, WORD_SIZE)) for w in words]
        sizes[n] = len(path), len(words)
        values[n, 1] = WORD_SCALE / math.sqrt(len(words) or 1)  # long blocks weigh as much as short ones
        rest[n] = min(1.0, math.log1p(len(block.text)) / 8), block.link, n / len(blocks), 1.0
    sizes = sizes.ravel()
    coded = np.array(codes, np.int64)
    return Rows(np.repeat(np.arange(len(sizes)) // 2, sizes), coded >> 1, np.repeat(values.ravel(), sizes) * (1 - 2 * (coded & 1)).astype(np.float32), rest)


# ---- the network ------------------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size, h = EMBED + 4, HIDDEN
    weights = {"out": rng.normal(0, 0.1, (2 * h, 1)), "skip": rng.normal(0, 0.05, (size, 1)), "bias": np.zeros(1)}
    weights["emb"] = np.zeros((PATH_SIZE + WORD_SIZE, EMBED))  # a name that training never met says nothing
    for side in "fb":
        weights[f"x{side}"] = rng.normal(0, 0.15, (size, 4 * h))
        weights[f"h{side}"] = rng.normal(0, 0.15, (h, 4 * h))
        weights[f"c{side}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
    return {k: v.astype(np.float32) for k, v in weights.items()}


def embedded(x: np.ndarray | list[Rows], mask: np.ndarray, w: dict) -> np.ndarray:
    """Inputs of the LSTM: embedding sums and the dense rest, for sparse pages or full rows."""
    if isinstance(x, np.ndarray):
        return np.concatenate([x[..., :-4] @ w["emb"], x[..., -4:]], axis=2)
    out = np.zeros((*mask.shape, EMBED + 4), np.float32)
    for k, rows in enumerate(x):
        out[: len(rows), k, :EMBED], out[: len(rows), k, EMBED:] = rows.summed(w["emb"]), rows.rest
    return out


def _run(x: np.ndarray, mask: np.ndarray, w: dict, side: str, keep: bool):
    """States of one direction; ``x`` is time by page by size. Padding leaves the state as it is."""
    steps, pages, _ = x.shape
    h = np.zeros((pages, HIDDEN), np.float32)
    c = np.zeros_like(h)
    states, memo = np.zeros((steps, pages, HIDDEN), np.float32), {}
    gates_x = x @ w[f"x{side}"] + w[f"c{side}"]
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = gates_x[t] + h @ w[f"h{side}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new_c = f * c + i * g
        tc = np.tanh(new_c)
        if keep:
            memo[t] = (h, c, i, f, o, g, tc, m)
        h, c = np.where(m, o * tc, h), np.where(m, new_c, c)
        states[t] = h
    return states, memo


def label_scores(x: np.ndarray | list[Rows], mask: np.ndarray, w: dict, keep: bool = False):
    x = embedded(x, mask, w)
    forward, memo_f = _run(x, mask, w, "f", keep)
    backward, memo_b = _run(x, mask, w, "b", keep)
    both = np.concatenate([forward, backward], axis=2)
    return (both @ w["out"] + x @ w["skip"] + w["bias"])[:, :, 0], (x, both, memo_f, memo_b)


def _gradients(x, mask, y, w):
    rows = x
    scores, (x, both, memo_f, memo_b) = label_scores(rows, mask, w, True)
    d = ((_sigmoid(scores) - y) * mask / max(1, mask.sum()))[:, :, None].astype(np.float32)
    grads = {"out": np.einsum("tpk,tpo->ko", both, d), "skip": np.einsum("tpk,tpo->ko", x, d), "bias": d.sum((0, 1))}
    d_both = d @ w["out"].T
    d_x = d @ w["skip"].T
    for side, memo, part in (("f", memo_f, d_both[:, :, :HIDDEN]), ("b", memo_b, d_both[:, :, HIDDEN:])):
        d_z = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        d_h = np.zeros((x.shape[1], HIDDEN), np.float32)
        d_c, d_wh = np.zeros_like(d_h), np.zeros_like(w[f"h{side}"])
        for t in range(x.shape[0] - 1, -1, -1) if side == "f" else range(x.shape[0]):
            h, c, i, f, o, g, tc, m = memo[t]
            d_h = d_h + part[t]
            here_h, here_c = d_h * m, d_c * m
            d_o = here_h * tc
            d_new = here_c + here_h * o * (1 - tc * tc)
            z = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), d_o * o * (1 - o), d_new * i * (1 - g * g)], axis=1)
            d_z[t] = z
            d_wh += h.T @ z
            d_h = np.where(m, z @ w[f"h{side}"].T, d_h)
            d_c = np.where(m, d_new * f, d_c)
        grads[f"x{side}"] = np.einsum("tpk,tpz->kz", x, d_z)
        grads[f"h{side}"] = d_wh
        grads[f"c{side}"] = d_z.sum((0, 1))
        d_x = d_x + d_z @ w[f"x{side}"].T
    d_x = d_x[:, :, :EMBED]
    if isinstance(rows, np.ndarray):
        grads["emb"] = np.einsum("tps,tpe->se", rows[..., :-4], d_x)
    else:
        grads["emb"] = np.zeros_like(w["emb"])
        for k, page in enumerate(rows):
            page.spread(d_x[: len(page), k], grads["emb"])
    return grads


def padded(rows: list) -> tuple:
    """Pages of one batch and the mask of their blocks; sparse pages stay as they are."""
    longest = max(len(r) for r in rows)
    if isinstance(rows[0], Rows):
        return rows, np.arange(longest)[:, None] < np.array([len(r) for r in rows])
    x = np.zeros((longest, len(rows), rows[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(rows)), bool)
    for n, r in enumerate(rows):
        x[: len(r), n], mask[: len(r), n] = r, True
    return x, mask


def train(examples: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Adam over windows of similar length; every block of every page is in one of them."""
    w = fresh_weights()
    data = [(rows, np.array(y[a : a + len(rows)], np.float32)) for b, y in examples if b for a, rows in vectors(b).windows(WINDOW)]
    data.sort(key=lambda e: len(e[0]))
    batches = [data[i : i + BATCH] for i in range(0, len(data), BATCH)]
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    rng, step = np.random.default_rng(11), 0
    for _ in range(epochs):
        for n in rng.permutation(len(batches)):
            x, mask = padded([v.thinned(rng) for v, _ in batches[n]])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(batches[n]):
                y[: len(labels), k] = labels
            step += 1
            for k, g in _gradients(x, mask, y, w).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] = (w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


# ---- the sample -----------------------------------------------------------------------------


def taught(block: Block) -> int:
    """Label by markup: 1 inside an article or main part and outside of everything around it."""
    label = 0
    for names in block.path:
        if names[0] in MAIN_TAGS:
            label = 1
        elif names[0] in SIDE_TAGS or SIDE_NAMES & set(names[1:]):
            return 0
    return label


def variants(blocks: list[Block], labels: list[int], rng: np.random.Generator, phrases: list[str]) -> list[tuple[list[Block], list[int]]]:
    """The page in other layouts, with boilerplate of other kinds and names."""
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    phrase = lambda: " ".join(pick(phrases) for _ in range(int(rng.integers(1, 14))))
    side_names = sorted(SIDE_NAMES)
    out = []
    for _ in range(3):
        root = (("html",), ("body",))
        wrap = pick([(("div", *NAME.findall(pick(MAIN_NAMES))),), (("main",),), (("article",),), (("main",), ("article",)), (("section", *NAME.findall(pick(MAIN_NAMES))),), (("div", "container"), ("article",))])

        def side():
            kind = int(rng.integers(4))
            if kind == 0:
                head = ((pick(sorted(SIDE_TAGS)),),)
            elif kind == 1:
                head = ((pick(["div", "section", "ul", "p"]), pick(side_names)),)
            elif kind == 2:
                head = (("aside", pick(side_names)),)
            else:
                head = (("div", pick(side_names)), ("div", pick(side_names)))
            inner = pick([(), (("p",),), (("ul",), ("li",)), (("h2",),), (("div",),), (("h3",),)])
            return [Block((*head, *inner), phrase(), bool(rng.integers(2))) for _ in range(int(rng.integers(1, 5)))]

        built, marks = [], []

        def add(items, prefix, label):
            for b in items:
                built.append(Block((*prefix, *b.path), b.text, b.link))
                marks.append(label)

        for _ in range(int(rng.integers(1, 4))):
            add(side(), root, 0)
        inside = [b for b, y in zip(blocks, labels) if y]
        cut = sorted(rng.integers(0, len(inside) + 1, 2).tolist()) if rng.random() < 0.5 else []
        for n, b in enumerate(inside):
            if n in cut:
                add(side(), (*root, *wrap), 0)
            tail = tuple(p for p in b.path if p[0] not in {"html", "body", *MAIN_TAGS})
            if rng.random() < 0.25:
                tail = pick([(("ul",), ("li",)), (("ol",), ("li",)), (("h2",),), (("h3",),), (("blockquote",), ("p",)), (("table",), ("tr",), ("td",)), (("pre",),), (("section",), ("p",)), (("div",),)])
            add([Block(tail or (("p",),), b.text, b.link)], (*root, *wrap), 1)
        if rng.random() < 0.5:
            add(side(), (*root, *wrap), 0)
        for _ in range(int(rng.integers(1, 4))):
            add(side(), root, 0)
        out.append((built, marks))
    return out


def fitted(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, np.ndarray]:
    """Weights trained on ``sample_pages`` pages chosen by hash; only their html comes to the driver."""
    ids = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    rows = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").where("html is not null").orderBy("page_id").limit(sample_pages).collect()
    rng, examples, phrases = np.random.default_rng(5), [], ["home", "about", "contact"]
    read = [leaf_blocks(r["html"]) for r in rows]
    for blocks in read:
        phrases += [w for b in blocks[:40] for w in b.text.split()[:4]]
    for blocks in read:
        labels = [taught(b) for b in blocks]
        examples.append((blocks, labels))
        examples += variants(blocks, labels, rng, phrases)
    return train(examples)


# ---- extraction ------------------------------------------------------------------------------


def main_texts(pages: list[str | None], w: dict) -> list[str]:
    """Texts of the blocks labelled as main, for a batch of pages labelled by length."""
    read = [leaf_blocks(p) for p in pages]
    texts = [""] * len(pages)
    order = sorted((n for n in range(len(pages)) if read[n]), key=lambda n: len(read[n]))
    at = 0
    while at < len(order):
        take = max(1, min(LABEL_BATCH, 65536 // len(read[order[min(at + LABEL_BATCH, len(order)) - 1]])))
        some = order[at : at + take]
        at += take
        x, mask = padded([vectors(read[n]) for n in some])
        scores, _ = label_scores(x, mask, w)
        for k, n in enumerate(some):
            texts[n] = " ".join(b.text for t, b in enumerate(read[n]) if scores[t, k] > 0)
    return texts


def extract_pages(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Per page ``page_id, url, text, n_chars``."""
    weights = pages.sparkSession.sparkContext.broadcast(fitted(pages, sample_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(batch.column(2).to_pylist(), weights.value)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], [f.split()[0] for f in OUT.split(", ")])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, OUT)
