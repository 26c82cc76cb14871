"""Main text of web pages: a recurrent labeller reads the leaf blocks of a page in order, both ways, and keeps the article."""

from __future__ import annotations

import functools
import html as entities
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import LOWER, NOT_ALNUM, map_batches, text_blocks, word_bounds, word_hashes

# Elements of HTML by role.
HIDDEN = ("script", "style", "noscript", "template", "svg", "annotation", "annotation-xml", "iframe", "object", "textarea", "select", "canvas", "audio", "video")
#: Of these, elements whose text stands in for something else; outside a head it is a block like others, which the labeller judges.
FALLBACKS = frozenset("noscript object audio video".split())
#: Elements that may stand in a head; the first other one ends it, as its tags may be omitted.
IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript template object".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()) | FALLBACKS
CLOSES_P = BLOCKS - FALLBACKS - {"button", "label", "option", "optgroup", "legend"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(HIDDEN) + r")(?=[\s>/])(?P<own>[^>]*)>|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.I | re.S,
)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Leaf(NamedTuple):
    """A block of text: the tags (and `.name` parts of class, id and role) around it, and its characters inside links."""

    path: tuple[str, ...]
    text: str
    linked: int


def leaves(page: str | None) -> list[Leaf]:
    """The leaf blocks of a page in order. Scripts, styles, comments and the head have none; unclosed elements end with what holds them.
    What noscript, object, audio and video hold is a block outside the head.

    The head, tagged or not, ends at its end tag or before the first element or text that cannot stand in it.
    """
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    page, at, linked, in_link, in_head = page or "", 0, 0, False, True
    never: set[str] = set()  # of these no end tag follows

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Leaf(stack[-1][1] if stack else (), text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked, in_head
        in_head = in_head and not raw.strip("\ufeff \t\r\n\f")
        if raw and not in_head:
            text = entities.unescape(raw)
            parts.append(text)
            if in_link:
                linked += len(text)

    def end_of(tag: str) -> re.Match | None:
        """The next end tag; one that was not found is not looked for again."""
        found = None if tag in never else re.compile(rf"</{tag}(?=[\s>/])[^>]*>", re.I).search(page, at)
        if not found:
            never.add(tag)
        return found

    while m := _MARKUP.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        raw = (m["raw"] or "").lower()
        if raw and (in_head or raw not in FALLBACKS):
            in_head = in_head and raw in IN_HEAD
            if raw == "svg" and re.search(r"(?:^|[\s\"'])/\Z", m["own"]):
                continue
            if end := end_of(raw):
                at = end.end()
            else:  # hidden up to the end of the innermost block that has one
                at = next((end.start() for tag, _ in reversed(stack) if (end := end_of(tag))), len(page))
            continue
        tag, closing, attributes = raw or (m["tag"] or "").lower(), m["end"], m["own"] or m["attributes"]
        if not tag:
            continue
        if in_head:
            if tag == "title" and not closing:
                end = end_of(tag)
                at = end.end() if end else page.find("<", at) if "<" in page[at:] else len(page)
                continue
            in_head = tag not in ("head", "body", "html") if closing else tag in IN_HEAD
        if tag == "a":
            in_link = not closing
        elif tag in ("br", "wbr", "img"):
            parts.append(" ")
        if tag in ("br", "hr") or tag not in BLOCKS:
            if tag == "hr":
                flush()
            continue
        flush()
        in_link = in_link and not closing
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if stack and stack[-1][0] == "p" and tag in CLOSES_P or stack and stack[-1][0] == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
            stack.pop()
        names = [f".{p.lower()}" for v in _NAMES.findall(attributes) for p in _PARTS.findall(v)] if attributes else []
        stack.append((tag, (*(stack[-1][1] if stack else ()), tag, *names)))
    add(page[at:])
    flush()
    return out


# ---- numbers for the network -------------------------------------------------------------------

PATH_SLOTS, WORD_SLOTS, SHAPE = 512, 64, 6


@functools.lru_cache(1 << 16)
def _slot(token: str, slots: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % slots


@functools.lru_cache(1 << 14)
def _path_slots(path: tuple[str, ...]) -> tuple[int, ...]:
    tags = [t for t in path if t not in ("html", "body")]
    return tuple({_slot(t, PATH_SLOTS) for t in tags} | {_slot(f">{t}", PATH_SLOTS) for t in tags[-1:]})


def numbers(pages: list[list[Leaf]]) -> list[tuple[list[tuple[int, ...]], np.ndarray]]:
    """For each page the slots of each leaf's tag path, and the leaves' hashed-word and shape vectors (one row a leaf)."""
    every = [leaf for page in pages for leaf in page]
    x = np.zeros((len(every), WORD_SLOTS + SHAPE), np.float32)
    for at, to, data, offsets in text_blocks(pa.array([leaf.text for leaf in every], pa.large_string())):
        starts, ends, rows = word_bounds(LOWER[data], offsets, NOT_ALNUM)
        slots = (word_hashes(LOWER[data], starts, ends) >> np.uint64(40)).astype(np.int64) % WORD_SLOTS
        n = np.diff(rows)
        counts = np.bincount(np.repeat(np.arange(to - at), n) * WORD_SLOTS + slots, minlength=(to - at) * WORD_SLOTS).reshape(-1, WORD_SLOTS)
        x[at:to, :WORD_SLOTS] = 2 * counts / np.maximum(np.linalg.norm(counts, axis=1), 1)[:, None]
    at, out = 0, []
    for page in pages:
        size = len(page)
        for i, leaf in enumerate(page):
            n = len(leaf.text)
            x[at + i, WORD_SLOTS:] = (np.log1p(n) / 6, leaf.linked / n, leaf.text[-1] in ".!?:,;", i / size, (size - i) / size, 1)
        out.append(([_path_slots(leaf.path) for leaf in page], x[at : at + size]))
        at += size
    return out


class Labeller:
    """Bidirectional LSTM with one logistic output a leaf; trained here by back-propagation through time and Adam."""

    def __init__(self, hidden: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.hidden = hidden
        self.w = {}
        for side in "fb":
            self.w |= {f"path_{side}": draw(PATH_SLOTS, 4 * hidden), f"x_{side}": draw(WORD_SLOTS + SHAPE, 4 * hidden), f"h_{side}": draw(hidden, 4 * hidden)}
            self.w[f"x_{side}"][-1, :hidden] += 1  # gates begin open to what was read before
        self.w |= {"out": draw(2 * hidden + 1, 1)}

    @staticmethod
    def batch(pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Path counts and vectors [steps, pages, ..] and a mask; shorter pages are padded."""
        steps = max(len(p) for p, _ in pages)
        path = np.zeros((steps, len(pages), PATH_SLOTS), np.float32)
        x = np.zeros((steps, len(pages), WORD_SLOTS + SHAPE), np.float32)
        mask = np.zeros((steps, len(pages)), np.float32)
        for j, (slots, rows) in enumerate(pages):
            for i, s in enumerate(slots):
                path[i, j, list(s)] = 1
            x[: len(rows), j] = rows
            mask[: len(rows), j] = 1
        return path, x, mask

    def _side(self, side: str, given: np.ndarray, mask: np.ndarray) -> dict:
        n, h, w = self.hidden, np.zeros((given.shape[1], self.hidden), np.float32), self.w[f"h_{side}"]
        c, out = h.copy(), []
        order = range(len(given)) if side == "f" else range(len(given) - 1, -1, -1)
        for t in order:
            z = given[t] + h @ w
            s = 1 / (1 + np.exp(-z[:, : 3 * n]))
            f, i, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            c_new = (f * c + i * g) * m
            tc = np.tanh(c_new)
            h_new = o * tc * m
            out.append((t, h, c, f, i, o, g, tc))
            h, c = h_new, c_new
        states = np.zeros((*mask.shape, n), np.float32)
        for t, *_, o, _, tc in out:
            states[t] = o * tc * mask[t][:, None]
        return {"steps": out, "states": states}

    def forward(self, given: dict[str, np.ndarray], mask: np.ndarray) -> tuple[np.ndarray, dict, dict, np.ndarray]:
        f, b = self._side("f", given["f"], mask), self._side("b", given["b"], mask)
        both = np.concatenate([f["states"], b["states"], np.ones((*mask.shape, 1), np.float32)], 2)
        return 1 / (1 + np.exp(-(both @ self.w["out"])[..., 0])), f, b, both

    def probabilities(self, pages: list[tuple]) -> list[np.ndarray]:
        """Of each leaf of each page; pages come in runs of like length so that padding stays small."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][0])), key=lambda i: len(pages[i][0]))
        while order:
            steps, take = len(pages[order[-1]][0]), []
            while order and len(take) < max(1, 4000 // steps):
                take.append(order.pop())
            given, mask = {s: np.zeros((steps, len(take), 4 * self.hidden), np.float32) for s in "fb"}, np.zeros((steps, len(take)), np.float32)
            for j, i in enumerate(take):
                slots, rows = pages[i]
                mask[: len(slots), j] = 1
                flat, at = np.array([s for p in slots for s in p], np.int64), np.array([len(p) for p in slots])
                leaf = np.repeat(np.arange(len(slots)), at)
                for side in "fb":
                    g = rows @ self.w[f"x_{side}"]
                    np.add.at(g, leaf, self.w[f"path_{side}"][flat])
                    given[side][: len(slots), j] = g
            p = self.forward(given, mask)[0]
            for j, i in enumerate(take):
                out[i] = p[: len(pages[i][0]), j]
        return out

    def fit(self, pages: list[tuple], labels: list[np.ndarray], rounds: int = 6, size: int = 32, rate: float = 0.02, seed: int = 1) -> Labeller:
        rng, n = np.random.default_rng(seed), self.hidden
        m1, m2, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for _ in range(rounds):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), size):
                take = order[at : at + size]
                path, x, mask = self.batch([pages[i] for i in take])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(take):
                    y[: len(labels[i]), j] = labels[i]
                drop = (rng.random((1, 1, PATH_SLOTS)) > 0.1).astype(np.float32)
                path = path * drop
                p, f, b, both = self.forward({s: path @ self.w[f"path_{s}"] + x @ self.w[f"x_{s}"] for s in "fb"}, mask)
                d = ((p - y) * mask / mask.sum())[..., None]
                grad = {"out": (both * d).sum((0, 1))[:, None]}
                back = d @ self.w["out"].T
                for k, (side, got) in enumerate((("f", f), ("b", b))):
                    dz_all = np.zeros((*mask.shape, 4 * n), np.float32)
                    dh_next = dc_next = np.zeros((len(take), n), np.float32)
                    w, gh = self.w[f"h_{side}"], np.zeros((n, 4 * n), np.float32)
                    for t, h0, c0, fg, ig, og, gg, tc in reversed(got["steps"]):
                        m = mask[t][:, None]
                        dh = (back[t, :, k * n : (k + 1) * n] + dh_next) * m
                        dc = (dh * og * (1 - tc * tc) + dc_next) * m
                        dz = np.concatenate([dc * c0 * fg * (1 - fg), dc * gg * ig * (1 - ig), dh * tc * og * (1 - og), dc * ig * (1 - gg * gg)], 1)
                        gh += h0.T @ dz
                        dh_next, dc_next = dz @ w.T, dc * fg
                        dz_all[t] = dz
                    flat = dz_all.reshape(-1, 4 * n)
                    grad |= {f"h_{side}": gh, f"x_{side}": x.reshape(len(flat), -1).T @ flat, f"path_{side}": path.reshape(len(flat), -1).T @ flat}
                step += 1
                for key, g in grad.items():
                    m1[key] = 0.9 * m1[key] + 0.1 * g
                    m2[key] = 0.99 * m2[key] + 0.01 * g * g
                    self.w[key] -= rate * (m1[key] / (1 - 0.9**step)) / (np.sqrt(m2[key] / (1 - 0.99**step)) + 1e-7)
        return self


# ---- labelled pages to learn from ----------------------------------------------------------------

_MAIN = (("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".main", ".content"), ("div", ".post", ".body"), ("div", ".entry", ".content"), ("section", ".article", ".body"), ("div", ".story"), ("div", ".container", "article", ".post"), ("div", ".wrapper", "main", "div", ".text"), ("div", ".page", "section", ".entry"), (), ("div",), ("section",))
#: A title, and what an article may begin with, where its frame says that it is one.
_HEADS = (("h1",), ("h1",), ("h2",), ("header", "h1"), ("header", "h1"), ("header", "h2"), ("header", "p"), ("header", "div", "h1"))
_INNER = (("p",), ("p",), ("p",), ("h2",), ("h3",), ("ul", "li"), ("blockquote", "p"), ("blockquote",), ("pre",), ("figure", "figcaption"), ("table", "tr", "td"), ("div",), ("ol", "li"), ("section", "p"), ("dl", "dd"), ("div", ".note"), ("div", ".note", "p"), ("div", ".box"), ("div", ".info", "p"), ("details", "summary"), ("details", "p"), ("noscript", "p"), ())
_NOISE = {
    "before": (
        (("nav", "ul", "li"), "link"), (("div", ".menu", "ul", "li"), "link"), (("header", "div", ".logo"), "short"), (("header", "h1"), "short"), (("header", "p"), "text"), (("header", "nav", "ul", "li"), "link"), (("div", ".header", "div"), "short"), (("div", ".navbar", "ul", "li"), "link"), (("div", ".breadcrumb", "ol", "li"), "link"), (("div", ".navigation"), "link"), (("div", ".top", ".bar"), "short"), (("div", ".masthead", "p"), "short"), (("ul", ".nav", "li"), "link"), (("div", ".skip"), "link"), (("table", "tr", "td"), "link"), (("table", "tbody", "tr", "td"), "link"), (("table", "tr", "td", "ul", "li"), "link"), (("noscript",), "text"), (("noscript", "p"), "text"), (("noscript", "div"), "text"),
    ),
    "any": (
        (("div", ".ad"), "text"), (("div", ".ads"), "text"), (("div", ".advert"), "text"), (("div", ".advertisement", "p"), "text"), (("aside", ".ad"), "text"), (("div", ".banner"), "text"), (("div", ".promo", "p"), "text"), (("div", ".sponsored"), "text"), (("div", ".sponsor", "p"), "text"),
        (("aside",), "text"), (("aside", "p"), "text"), (("aside", "ul", "li"), "link"), (("aside", ".sidebar", "div"), "text"), (("div", ".sidebar", "p"), "text"), (("div", ".sidebar", "ul", "li"), "link"), (("div", ".widget", "p"), "text"), (("div", ".related", "ul", "li"), "link"), (("div", ".share"), "link"), (("div", ".social", "ul", "li"), "link"),
        (("div", ".cookie", ".notice", "p"), "text"), (("div", ".cookie", ".banner"), "text"), (("div", ".notice"), "text"), (("div", ".consent", "p"), "text"), (("div", ".alert"), "text"), (("div", ".popup", "p"), "text"), (("div", ".modal", "p"), "text"), (("section", ".notice", "p"), "text"), (("dialog", "p"), "text"), (("div", ".gdpr"), "text"), (("div", ".disclaimer", "p"), "text"), (("div", ".paywall", "p"), "text"),
        (("form",), "short"), (("form", "label"), "short"), (("form", "p"), "text"), (("form", "div"), "text"), (("form", "button"), "short"), (("form", ".search", "button"), "short"), (("div", ".newsletter", "form", "p"), "text"), (("div", ".newsletter", "p"), "text"), (("div", ".subscribe", "p"), "text"), (("form", "fieldset", "legend"), "short"), (("div", ".login", "form", "label"), "short"), (("button",), "short"),
    ),
    "after": (
        (("footer",), "text"), (("footer", "p"), "text"), (("footer", "div"), "text"), (("footer", "ul", "li"), "link"), (("div", ".footer", "p"), "text"), (("div", ".copyright"), "text"), (("div", ".pagination"), "link"), (("div", ".author", ".bio", "p"), "text"), (("div", ".tags", "ul", "li"), "link"),
        (("section", ".comments", "p"), "text"), (("section", ".comments", "h2"), "short"), (("section", ".comments", "article", "p"), "text"), (("section", ".comments", "article", ".comment", "p"), "text"), (("div", ".comments", "div", ".comment", "p"), "text"), (("div", ".comment", "p"), "text"), (("ol", ".comment", ".list", "li", "p"), "text"), (("ul", ".comments", "li"), "text"), (("div", ".reply", "p"), "text"), (("div", ".comments", "h3"), "short"), (("div", ".responses", "p"), "text"), (("div", ".disqus", "p"), "text"), (("section", ".reviews", "p"), "text"), (("div", ".discussion", "p"), "text"), (("div", ".feedback", "p"), "text"), (("section", ".comments", "form", "label"), "short"),
    ),
}
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve le la el ur é ai un sch ü ei ß ción os".split()


def made_pages(n: int, seed: int = 3) -> tuple[list[list[Leaf]], list[np.ndarray]]:
    """n pages of invented words in the usual frames of web pages, and which of their leaves belong to the article."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[rng.integers(len(items))]
    some = lambda a, b: "".join(pick(_SYLLABLES) for _ in range(rng.integers(a, b)))

    pool = [some(1, 4) for _ in range(20_000)]

    def text(kind: str) -> tuple[str, int]:
        most = 4 if kind in ("link", "short") else int(np.exp(rng.uniform(0.7, 6)))
        words = [pool[i] for i in rng.integers(0, len(pool), rng.integers(1, max(2, most)))]
        out = pick((" ", " ", " ", " ", "!! ", "*** ")).join(words) + ("." if kind == "text" else "")
        return out, len(out) if kind == "link" else int(rng.random() < 0.1) * (len(out) // 3)

    pages, labels = [], []
    for _ in range(n):
        if rng.random() < 0.12:  # nothing around the article: one block, bare or in a frame, or plain ones
            main, inner = pick(((), (), (), *_MAIN)), pick(((), (), ("p",), ("pre",)))
            pages.append([Leaf(("html", "body", *main, *inner), *text("text")) for _ in range(1 if inner != ("p",) or rng.random() < 0.5 else rng.integers(2, 8))])
            labels.append(np.ones(len(pages[-1]), np.float32))
            continue
        outer = pick(((), (), ("div", ".page"), ("div", ".site"), ("div", ".wrapper"), ("div", ".container"), ("div",)))
        main = (*outer, *pick(_MAIN))
        page: list[tuple[Leaf, int]] = []

        def noise(where: str, most: int, inside: tuple[str, ...]) -> None:
            for _ in range(rng.integers(0, most + 1)):
                path, kind = pick(_NOISE[where])
                for _ in range(rng.integers(1, 6) if kind == "link" else rng.integers(1, 3)):
                    page.append((Leaf(("html", "body", *inside, *path), *text(kind)), 0))  # noqa: B023

        noise("before", 3, outer)
        noise("any", 2, outer)
        if rng.random() < 0.85:
            heads = _HEADS if {"article", ".article", "main"} & {*main} else _HEADS[:3]
            page += [(Leaf(("html", "body", *main, *pick(heads)), *text("text")), 1) for _ in range(rng.integers(1, 3))]
        one = rng.random() < 0.3
        for _ in range(rng.integers(1, 25) if rng.random() < 0.85 else rng.integers(25, 120)):
            page.append((Leaf(("html", "body", *main, *(("p",) if one else pick(_INNER))), *text("text" if rng.random() < 0.9 else "short")), 1))
            if rng.random() < 0.12:
                noise("any", 1, main if rng.random() < 0.7 else outer)
        noise("after", 2, main if rng.random() < 0.3 else outer)
        noise("any", 2, outer)
        noise("after", 3, outer)
        pages.append([leaf for leaf, _ in page])
        labels.append(np.array([y for _, y in page], np.float32))
    return pages, labels


@functools.lru_cache(4)
def trained(n_pages: int = 1000, rounds: int = 4, seed: int = 3) -> Labeller:
    """A labeller fitted to n_pages made pages; always the same for the same arguments."""
    pages, labels = made_pages(n_pages, seed)
    return Labeller().fit(numbers(pages), labels, rounds)


def extract(pages: DataFrame, text: str = "html", labeller: Labeller | None = None, threshold: float = 0.2) -> DataFrame:
    """page_id, url, text, n_chars and blocks (path, text, score of every leaf) of every page.

    text: the blocks that the labeller keeps, in page order, joined by two line ends. Character
    references are decoded and white space within a block is one space; nothing else changes. Null,
    empty or markup-only html gives an empty text; repeated rows stay; other columns are left out.
    Pages are read once and never shuffled; the network (0.3 MB) travels with the tasks.
    """
    model = labeller or trained()
    kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("score", pa.float64())]))

    def run(b: pa.RecordBatch):
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            pages = [leaves(x) for x in part.column(2).to_pylist()]
            scores = model.probabilities(numbers(pages))
            texts = ["\n\n".join(leaf.text for leaf, s in zip(p, q) if s >= threshold) for p, q in zip(pages, scores)]
            yield {
                "page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "blocks": pa.array([[{"path": "/".join(leaf.path), "text": leaf.text, "score": float(s)} for leaf, s in zip(p, q)] for p, q in zip(pages, scores)], kind),
            }

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(text).cast("string").alias("html")), run, "page_id long, url string, text string, n_chars long, blocks array<struct<path:string,text:string,score:double>>")
