"""Main text of web pages: a recurrent labeller of text blocks.

A page is read into its leaf blocks of text, each with the path of open
elements above it.  A block is a vector: the mean of learned vectors of hashed
features (tags, classes and ids of its path, some of its words) and a few
numbers.  A bidirectional LSTM in numpy reads the blocks of the whole page in
both directions and labels each as main text or not.

The labeller is fitted on a bounded sample of pages (``PAGES``, those with the
smallest hash of their id).  Their labels come from the elements that name
their purpose (article, nav, footer ...); copies of these pages with other
elements and class names in their place, and with notices, forms, sidebars and
comments put in, teach it to do without those names.  Pages are then labelled
whole, map-only.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailfold.llm.common import text_slices

PAGES, LONGEST, VARIANTS, EPOCHS = 240, 40_000, 3, 6
FEATURES, WIDTH, HIDDEN, NUMBERS = 4096, 24, 20, 8
MARKUP = re.compile(
    r"""<!--.*?(?:--\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*+(?:"[^"]*"|'[^']*')|[^>])*+)>|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<open>/?[a-zA-Z][^<>]*)(?P<close>>|\Z)?""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
SPACE = re.compile(r"\s+")
RAW = frozenset("script style iframe textarea title".split())
#: Elements whose own elements give no text; one that stays open ends with its parent.
SILENT = frozenset("noscript template svg object select head".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody
    td tfoot th thead tr ul button label""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes, if it stands open and nothing of the second set is opened since.
CLOSES = {t: ({"p"}, BLOCKS - {"p"}) for t in BLOCKS} | {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
MAIN = frozenset({"article", "main"})
ASIDE = frozenset("nav header footer aside form dialog button label".split())
ASIDE_NAMES = re.compile(r"(?i)(^|[-_ ])(ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|reply|replies|respond|side-?bar|"
                         r"widget|related|menu|navbar|navigation|breadcrumbs?|footer|cookies?|notice|consent|popup|modal|"
                         r"share|social|newsletter|subscribe)([-_ ]|$)")


def end_of_silent(page: str, tag: str, at: int, open_above: frozenset[str]) -> int | None:
    """Where the silent element that begins at ``at`` ends: after its end tag, or before what ends its parent.

    A drawing also ends before a block element outside ``foreignObject``, a head
    before the body.  None where nothing ends it.
    """
    inside: list[str] = []
    while m := MARKUP.search(page, at):
        at = m.end()
        name = m["tag"] or (m["open"] and m["close"] and re.match(r"/?[^\s/>]*", m["open"])[0])
        if not name:
            continue
        ending, name = bool(m["end"]) or name.startswith("/"), name.lstrip("/").lower()
        if ending:
            if name in inside:
                del inside[len(inside) - 1 - inside[::-1].index(name):]
            elif name == tag:
                return at
            elif name in open_above:
                return m.start()
        elif (tag == "head" and name == "body") or (
                tag == "svg" and name in BLOCKS and "foreignobject" not in inside):
            return m.start()
        elif name in RAW and not (m["rest"] or "").endswith("/"):
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else at
        elif name not in VOID and not (m["rest"] or "").endswith("/"):
            inside.append(name)
    return None


@dataclass
class Block:
    path: tuple[tuple[str, str], ...]
    text: str
    linked: int


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in order; markup, scripts, styles and comments give none."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    endless: set[str] = set()
    linked = at = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                found.append(Block(tuple(stack), text, linked))
        linked = 0

    while at < len(page):
        m = MARKUP.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            parts.append(text)
            if links:
                linked += len(text)
        if m is None:
            break
        at = m.end()
        tag = m["tag"]
        rest = m["rest"] or ""
        if tag is None:
            # a comment or declaration, or a tag with an odd quote; one that the page's end cuts off is dropped
            if m["open"] is None or not m["close"]:
                continue
            tag = re.match(r"/?[^\s/>]*", m["open"])[0]
            rest = m["open"][len(tag):]
        tag, ending = tag.lstrip("/").lower(), bool(m["end"]) or tag.startswith("/")
        if tag == "br":
            parts.append(" ")
        elif ending:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in BLOCKS:
                flush()
            if depth is not None and (tag in BLOCKS or not any(t in BLOCKS for t, _ in stack[depth + 1:])):
                links -= sum(t == "a" for t, _ in stack[depth:])
                del stack[depth:]
        elif tag in SILENT and not rest.endswith("/"):
            # one that nothing ends is read as if it were not there, and so are those of its name that follow
            end = None if tag in endless else end_of_silent(page, tag, at, frozenset(t for t, _ in stack))
            if end is None:
                endless.add(tag)
            else:
                at = end
        elif tag in RAW and not rest.endswith("/"):
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|</{tag}\Z", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID:
            if tag in BLOCKS:
                flush()
            if tag in CLOSES:
                shut, bounds = CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in shut:
                        links -= sum(t == "a" for t, _ in stack[i:])
                        del stack[i:]
                        if tag not in ("tr", "td", "th"):
                            break
                    elif stack[i][0] in bounds:
                        break
            names = " ".join(n.strip("\"'") for n in NAMES.findall(rest)) if "=" in rest else ""
            stack.append((tag, names))
            links += tag == "a"
        elif tag in BLOCKS:
            flush()
    flush()
    return found


# ------------------------------------------------------------------ features

_SLOTS: dict[str, int] = {}


def _slot(feature: str) -> int:
    slot = _SLOTS.get(feature)
    if slot is None:
        if len(_SLOTS) > 200_000:
            _SLOTS.clear()
        slot = _SLOTS[feature] = zlib.crc32(feature.encode()) % FEATURES
    return slot


def features(blocks: list[Block]) -> tuple[list[list[int]], np.ndarray]:
    """Slots of the hashed features of each block, and its numbers."""
    slots, numbers = [], np.zeros((len(blocks), NUMBERS))
    for i, b in enumerate(blocks):
        words = b.text.split(" ")
        tags = [t for t, _ in b.path]
        own = [_slot("t:" + t) for t in dict.fromkeys(tags)]
        own += [_slot("n:" + n) for _, names in b.path if names for n in re.split(r"[\s_-]+", names.lower()) if n]
        own += [_slot("l:" + t) for t in tags[-2:]]
        own += [_slot("w:" + w.lower()) for w in words[:6] + words[-2:]]
        slots.append(own)
        size = len(b.text)
        numbers[i] = (np.log1p(len(words)) / 5, np.log1p(size) / 8, min(1.0, b.linked / size), len(tags) / 10,
                      b.text[-1] in ".!?\"'", sum(b.text.count(c) for c in ",.;") / len(words),
                      i / len(blocks), 1.0)
    return slots, numbers


# ------------------------------------------------------------------ the labeller

@dataclass
class Labeller:
    """Learned vectors of features, both directions' gates, and the output layer."""
    table: np.ndarray
    gates: list[np.ndarray]
    out: np.ndarray

    @staticmethod
    def new(seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        size = WIDTH + NUMBERS + HIDDEN + 1
        gates = [rng.normal(0, 1 / np.sqrt(size), (size, 4 * HIDDEN)) for _ in range(2)]
        for g in gates:
            g[-1] = 0
            g[-1, HIDDEN:2 * HIDDEN] = 1
        return Labeller(rng.normal(0, 0.3, (FEATURES, WIDTH)), gates, rng.normal(0, 0.1, 2 * HIDDEN + 1))

    def inputs(self, slots: list[list[int]], numbers: np.ndarray) -> np.ndarray:
        sizes = np.array([len(s) for s in slots])
        flat = np.concatenate([np.array(s) for s in slots])
        sums = np.add.reduceat(self.table[flat], np.cumsum(sizes) - sizes)
        return np.concatenate([sums / sizes[:, None], numbers], axis=1)

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Both directions over (steps, pages, inputs); the padding at the end of a page carries nothing on."""
        states, saved = [], []
        for d, w in enumerate(self.gates):
            order = range(len(x)) if d == 0 else range(len(x) - 1, -1, -1)
            h, c = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
            hs = np.zeros((len(x), x.shape[1], HIDDEN))
            tape = {}
            for t in order:
                joined = np.concatenate([x[t], h, np.ones((len(h), 1))], axis=1)
                z = joined @ w
                s = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
                g = np.tanh(z[:, 3 * HIDDEN:])
                i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
                m = mask[t][:, None]
                before = c
                c = (f * before + i * g) * m
                tc = np.tanh(c)
                h = o * tc * m
                hs[t] = h
                if keep:
                    tape[t] = (joined, i, f, o, g, before, tc, m)
            states.append(hs)
            saved.append(tape)
        both = np.concatenate([*states, np.ones((*x.shape[:2], 1))], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.out, -30, 30)))
        return (p, both, saved) if keep else p

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, float]:
        """Gradients of the mean log loss: of the inputs, the gates and the output layer."""
        p, both, saved = self.run(x, mask, keep=True)
        n = mask.sum()
        error = (p - y) * mask / n
        loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
        d_out = np.einsum("tb,tbh->h", error, both)
        d_both = error[..., None] * self.out
        d_x, d_gates = np.zeros_like(x), [np.zeros_like(w) for w in self.gates]
        for d, w in enumerate(self.gates):
            order = range(len(x) - 1, -1, -1) if d == 0 else range(len(x))
            d_h, d_c = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
            for t in order:
                joined, i, f, o, g, before, tc, m = saved[d][t]
                d_h = (d_h + d_both[t][:, d * HIDDEN:(d + 1) * HIDDEN]) * m
                d_c = (d_c + d_h * o * (1 - tc ** 2)) * m
                d_z = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * tc * o * (1 - o),
                                      d_c * i * (1 - g ** 2)], axis=1)
                d_gates[d] += joined.T @ d_z
                d_in = d_z @ w.T
                d_x[t] += d_in[:, :x.shape[2]]
                d_h, d_c = d_in[:, x.shape[2]:-1], d_c * f
        return d_x, d_gates, d_out, loss

    def label(self, pages: list[tuple[list[list[int]], np.ndarray]]) -> list[np.ndarray]:
        """Chance of main text for every block of every page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, (s, _) in enumerate(pages) if s), key=lambda i: len(pages[i][0]))
        first = 0
        while first < len(order):
            last = first + 1
            while last < len(order) and len(pages[order[last]][0]) * (last + 1 - first) < 8192:
                last += 1
            chosen = order[first:last]
            x, mask, _ = _padded(self, [pages[i] for i in chosen])
            p = self.run(x, mask)
            for j, i in enumerate(chosen):
                out[i] = p[:len(pages[i][0]), j]
            first = last
        return out


def _padded(model: Labeller, pages: list[tuple[list[list[int]], np.ndarray]], labels: list[np.ndarray] | None = None):
    steps = max(len(s) for s, _ in pages)
    x = np.zeros((steps, len(pages), WIDTH + NUMBERS))
    mask, y = np.zeros((steps, len(pages))), np.zeros((steps, len(pages)))
    flat = model.inputs([f for s, _ in pages for f in s], np.concatenate([n for _, n in pages]))
    at = 0
    for j, (s, _) in enumerate(pages):
        x[:len(s), j] = flat[at:at + len(s)]
        mask[:len(s), j] = 1
        if labels is not None:
            y[:len(s), j] = labels[j]
        at += len(s)
    return x, mask, y


def train(pages: list[list[Block]], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    """Adam on batches of pages of like length."""
    model = Labeller.new(seed)
    ready = [features(p) for p in pages]
    rng = random.Random(seed)
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
    batches = [order[i:i + 24] for i in range(0, len(order), 24)]
    weights = [model.table, *model.gates, model.out]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    t = 0
    for _ in range(epochs):
        rng.shuffle(batches)
        for batch in batches:
            chosen = [ready[i] for i in batch]
            x, mask, y = _padded(model, chosen, [labels[i] for i in batch])
            d_x, d_gates, d_out, _ = model.step(x, mask, y)
            d_table = np.zeros_like(model.table)
            flat = np.concatenate([np.array(f) for s, _ in chosen for f in s])
            sizes = np.array([len(f) for s, _ in chosen for f in s])
            per_block = np.concatenate([d_x[:len(s), j, :WIDTH] for j, (s, _) in enumerate(chosen)])
            np.add.at(d_table, flat, np.repeat(per_block / sizes[:, None], sizes, axis=0))
            t += 1
            for w, g, a, b in zip(weights, [d_table, *d_gates, d_out], first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g ** 2 - b)
                w -= 0.01 * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
    return model


# ------------------------------------------------------------------ training pages

def purpose(blocks: list[Block]) -> np.ndarray:
    """Labels by elements that name their purpose; without any, by length and links."""
    named = any(t in MAIN for b in blocks for t, _ in b.path)
    out = np.zeros(len(blocks))
    for i, b in enumerate(blocks):
        tags = [t for t, _ in b.path]
        start = max((j for j, t in enumerate(tags) if t in MAIN), default=-1)
        aside = any(t in ASIDE and not (t == "header" and j > start >= 0) or n and ASIDE_NAMES.search(n)
                    for j, (t, n) in enumerate(b.path))
        inside = start >= 0 if named else len(b.text.split()) >= 15 and b.linked < 0.3 * len(b.text)
        out[i] = inside and not aside
    return out


#: Elements and names that stand in for those of a page's parts.
MAIN_PARTS = [("div", "content"), ("div", "post-content"), ("div", "entry"), ("section", "story"), ("div", "article-body"),
              ("main", ""), ("article", "post"), ("div", "page"), ("td", "text"), ("div", "")]
NAV_PARTS = [("div", "menu"), ("ul", "navigation"), ("header", ""), ("div", "navbar"), ("nav", "breadcrumb"), ("div", "header")]
AD_PARTS = [("aside", ""), ("div", "sidebar"), ("div", "banner"), ("section", "promo"), ("div", "sponsored"), ("div", "ad-slot")]
FOOT_PARTS = [("div", "footer"), ("footer", "site-footer"), ("div", "bottom copyright"), ("section", "legal")]
EXTRA_PARTS = [("section", "comments", 4), ("div", "comment-list", 3), ("ol", "commentlist", 3), ("div", "cookie-notice", 1),
               ("div", "notice", 1), ("form", "newsletter", 1), ("form", "", 2), ("aside", "related", 3), ("div", "sidebar", 2),
               ("div", "share", 1), ("div", "advert", 1), ("div", "comments", 2)]


def variant(blocks: list[Block], labels: np.ndarray, texts: list[str], rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """The page with other elements around its parts, and with parts put in that are not main text."""
    main, nav, ad, foot = (rng.choice(p) for p in (MAIN_PARTS, NAV_PARTS, AD_PARTS, FOOT_PARTS))
    drop_names = rng.random() < 0.3

    def renamed(b: Block) -> Block:
        path = []
        for t, n in b.path:
            part = main if t in MAIN else nav if t in ("nav", "header") else foot if t == "footer" else \
                ad if n and ASIDE_NAMES.search(n) or t == "aside" else (t, n)
            path.append((part[0], "" if drop_names else part[1]) if part != (t, n) else (t, n))
        return Block(tuple(path), b.text, b.linked)

    def put_in() -> list[Block]:
        tag, name, number = rng.choice(EXTRA_PARTS)
        out = []
        for _ in range(rng.randint(1, number)):
            words = rng.choice(texts).split()
            size = rng.choice([4, 12, 30])
            start = rng.randrange(max(1, len(words) - size))
            text = " ".join(words[start:start + size])
            inner = rng.choice([("p", ""), ("li", ""), ("div", "body"), ("label", "")])
            out.append(Block((("html", ""), ("body", ""), (tag, name), inner), text, len(text) if rng.random() < 0.2 else 0))
        return out

    pairs = [(renamed(b), y) for b, y in zip(blocks, labels)]
    inside = [i for i, (_, y) in enumerate(pairs) if y]
    for _ in range(rng.randint(0, 3)):
        extra = [(b, 0.0) for b in put_in()]
        place = rng.choice([0, len(pairs), max(inside, default=0) + 1, min(inside, default=0)])
        pairs[place:place] = extra
        inside = [i for i, (_, y) in enumerate(pairs) if y]
    return [b for b, _ in pairs], np.array([y for _, y in pairs])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", number: int = PAGES,
        longest: int = LONGEST, variants: int = VARIANTS, epochs: int = EPOCHS) -> Labeller | None:
    """A labeller from a bounded sample; None where no page has text.

    The sample: one page an id, at most ``number`` pages; those of up to
    ``longest`` characters by the hash of their id, then longer ones, shortest
    first, until ``number * longest`` characters are reached (one page at least).
    """
    rows = (pages.select(pages[id_col].alias("id"), pages[html_col].alias("html")).filter("html IS NOT NULL")
            .withColumn("size", F.length("html")).withColumn("mark", F.xxhash64("html")))
    ids = (rows.groupBy("id").agg(F.min(F.struct("size", "mark")).alias("page")).select("id", "page.*")
           .orderBy(F.greatest("size", F.lit(longest)), F.xxhash64("id"), "id").limit(number).collect())
    room, wanted = number * longest, []
    for r in ids:
        if wanted and r["size"] > room:
            break
        room -= r["size"]
        wanted.append(tuple(r))
    if not wanted:
        return None
    kind = rows.select("id", "size", "mark").schema
    chosen = F.broadcast(pages.sparkSession.createDataFrame(wanted, kind))
    sample = [r["html"] for r in rows.join(chosen, rows["id"].eqNullSafe(chosen["id"]) & (rows["size"] == chosen["size"])
                                           & (rows["mark"] == chosen["mark"]), "left_semi")
              .dropDuplicates(["id"]).orderBy("id").collect()]
    read = [b for b in map(blocks_of, sample) if b]
    if not read:
        return None
    rng = random.Random(11)
    texts = [b.text for p in read for b in p if len(b.text) > 20] or [b.text for p in read for b in p]
    all_pages, labels = [], []
    for p in read:
        y = purpose(p)
        all_pages.append(p)
        labels.append(y)
        for _ in range(variants):
            v, w = variant(p, y, texts, rng)
            all_pages.append(v)
            labels.append(w)
    return train(all_pages, labels, epochs)


def extract(pages: DataFrame, model: Labeller | None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """Per page: id, url, ``text`` (main blocks joined by an empty line; empty if none) and ``n_chars``.

    Every row gives one, repeated rows alike; null html is an empty page; null
    ids and urls stay null; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in text_slices(batches, "html", 2 << 20):
            read = [blocks_of(h) if h else [] for h in part.column("html").to_pylist()]
            chances = m.label([features(b) if b else ([], None) for b in read]) if m else [np.zeros(len(b)) for b in read]
            texts = ["\n\n".join([b.text for b, p in zip(bs, ps) if p >= 0.5]) for bs, ps in zip(read, chances)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return (pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
            .mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
            .withColumnsRenamed({"id": id_col, "url": url_col}))
