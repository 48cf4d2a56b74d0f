"""Main text of web pages with a linear-chain conditional random field.

A page is read into leaf blocks: runs of text between block-level tags, with
their ancestors. Each block is content or not; a chain model over the blocks of
a page weighs features of ancestors (tags, words of class, id and role), of the
text and of links, and how labels follow each other. It is trained by gradient
ascent on the likelihood of labelled pages and decoded by Viterbi.

Labelled pages are laid out here: a bounded number of pages of the given table
lends its blocks of text, which are placed into layouts whose parts are known
to be content or not.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import smallest_hashes

# Element names of the markup language.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td textarea tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("noscript script style svg template".split())
#: an element that starts ends an open one of these, unless one of the second kind stands between
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = _BLOCK - {"button", "label", "legend", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption",
                    "head", "body", "html", "title", "textarea", "select", "iframe", "summary"}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")

#: size of the feature table
WIDTH = 1 << 13


#: inline elements that an end tag looks back over
INLINE = 64


class Path:
    """An element with its ancestors, which it shares with its siblings."""

    __slots__ = ("parent", "tag", "words", "numbers", "own", "marked")

    def __init__(self, parent: Path | None, tag: str, words: tuple[str, ...]):
        self.parent, self.tag, self.words = parent, tag, words
        above = parent.numbers if parent else frozenset()
        new = {_number(f"in:{tag}"), *(_number(f"word:{w}") for w in words)}
        #: features of all ancestors; a set that doesn't grow is shared
        self.numbers = above if new <= above else above | new
        self.own = tag if tag in _BLOCK else parent.own if parent else ""
        self.marked = tag in ("article", "main") or bool(parent and parent.marked)

    def __iter__(self):
        steps, at = [], self
        while at is not None:
            steps.append((at.tag, at.words))
            at = at.parent
        return reversed(steps)


class Block:
    """A run of text and the elements it stands in: (tag, words of class, id and role) of every ancestor."""

    __slots__ = ("text", "node", "linked", "label")

    def __init__(self, text: str, path: Path | tuple | None, linked: int = 0, label: int = 0):
        self.text, self.linked, self.label = text, linked, label
        if isinstance(path, tuple):
            node = None
            for tag, words in path:
                node = Path(node, tag, words)
            path = node
        self.node = path

    @property
    def path(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        return tuple(self.node) if self.node else ()


class _Open:
    """The open elements, with the places of every tag among them: no question walks the whole stack."""

    def __init__(self):
        self.nodes: list[Path] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def top(self) -> Path | None:
        return self.nodes[-1] if self.nodes else None

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        if tag in _BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(Path(self.top(), tag, words))

    def cut(self, place: int) -> list[Path]:
        """Close everything from ``place`` on."""
        closed = self.nodes[place:]
        del self.nodes[place:]
        for node in reversed(closed):
            self.places[node.tag].pop()
            if node.tag in _BLOCK:
                self.blocks.pop()
        return closed

    def end_inline(self, tag: str) -> None:
        """Close an inline element of the innermost block, and leave those inside it open."""
        place = self.last((tag,))
        if place > (self.blocks[-1] if self.blocks else -1) and len(self.nodes) - place <= INLINE:
            for node in self.cut(place)[1:]:
                self.push(node.tag, node.words)


def blocks_of(html: str | None) -> list[Block]:
    """Leaf blocks with text, in page order. White space is single spaces; raw elements have no text.

    One pass: a tag ends at the next ``>``, quotes considered; a ``<`` with no ``>``
    behind it is text, a comment without end reaches to the end.
    """
    html = html or ""
    out: list[Block] = []
    stack = _Open()
    parts: list[str] = []
    linked, at, end = 0, 0, html.rfind(">") + 1

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack.top(), linked))
            parts.clear()
        linked = 0

    def pop_to(names, barrier=()) -> None:
        place = stack.last(names)
        if place > stack.last(barrier):
            close()
            stack.cut(place)

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if stack.places.get("a"):
                linked += len(text)

    while True:
        m = _MARKUP.search(html, at, end) if at < end else None
        if m is None:
            rest = html[at:]
            open_comment = rest.find("<!--")
            add(rest if open_comment < 0 else rest[:open_comment])
            break
        add(html[at : m.start()])
        at = m.end()
        if at == end and m[0].startswith("<!--") and not m[0].endswith("-->"):
            break  # the comment goes on behind the last tag
        name = m[2] or m[5]
        if not name:
            continue
        tag, ending, rest = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending:
            if tag in _BLOCK:
                pop_to((tag,))
            else:
                stack.end_inline(tag)
            continue
        if tag in _RAW:
            if not rest.endswith("/"):
                ends = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at, end)
                at = ends.end() if ends else len(html)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCK:
            close()
            if tag in _ENDS_P:
                pop_to(("p",), ("button", "table"))
            if tag in _ENDS:
                pop_to(*_ENDS[tag])
        if tag not in _VOID:
            words = tuple(w for v in _NAMES.findall(rest) for w in _WORD.findall(v.lower())) if "=" in rest else ()
            stack.push(tag, words)
    close()
    return out


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) % WIDTH


class Features:
    """Feature numbers of blocks; those of an ancestor path are kept."""

    def __init__(self):
        self._paths: dict[tuple, list[int]] = {}

    def _of_path(self, node: Path | None) -> list[int]:
        key = (node.numbers, node.own, node.marked) if node else (frozenset(), "", False)
        found = self._paths.get(key)
        if found is None:
            if len(self._paths) > 50_000:
                self._paths.clear()
            numbers, own, marked = key
            found = self._paths[key] = sorted({*numbers, _number(f"own:{own}"), _number("marked" if marked else "bare")})
        return found

    def of(self, blocks: list[Block]) -> list[list[int]]:
        out = []
        for k, b in enumerate(blocks):
            size = len(b.text)
            share = b.linked / size
            own = [
                f"size:{min(size, 4000).bit_length()}", f"links:{0 if not share else 1 + min(int(share * 3), 2)}",
                f"end:{b.text[-1] if not b.text[-1].isalnum() else 'w'}", f"first:{'c' if b.text[0].isupper() else 'o'}",
                f"commas:{min(b.text.count(','), 3)}"]
            if "©" in b.text:
                own.append("copyright")
            if k == 0:
                own.append("start")
            out.append(self._of_path(b.node) + [_number(n) for n in own])
        return out


@dataclass
class ChainModel:
    """Weights of content against the rest, of label pairs, and of the first label."""

    weights: np.ndarray
    follow: np.ndarray
    start: np.ndarray

    def decode(self, rows: list[list[int]]) -> list[int]:
        """Viterbi: the likeliest labels."""
        if not rows:
            return []
        w = self.weights
        (stay0, turn1), (turn0, stay1) = self.follow.tolist()
        off, on = self.start.tolist()
        back: list[tuple[int, int]] = []
        for k, features in enumerate(rows):
            gain = float(w[features].sum())
            if k:
                to0, to1 = (off + stay0, on + turn0), (off + turn1, on + stay1)
                back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
                off, on = max(to0), max(to1)
            on += gain
        label = int(on > off)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], *, rounds: int = 120, rate: float = 0.5, decay: float = 1e-4) -> ChainModel:
    """Maximise the likelihood of labelled chains; each page is (feature numbers, labels)."""
    model = ChainModel(np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(2))
    pages = [p for p in pages if p[0]]
    if not pages:
        return model
    length = np.array([len(rows) for rows, _ in pages])
    n, steps = len(pages), int(length.max())
    flat = np.array([f for rows, _ in pages for r in rows for f in r], dtype=np.int64)
    page = np.array([p for p, (rows, _) in enumerate(pages) for r in rows for _ in r])
    step = np.array([k for rows, _ in pages for k, r in enumerate(rows) for _ in r])
    cell = page * steps + step
    label = np.zeros((n, steps), dtype=np.int64)
    inside = np.arange(steps)[None, :] < length[:, None]
    for p, (_, labels) in enumerate(pages):
        label[p, : len(labels)] = labels
    seen = [np.zeros_like(x) + 1e-8 for x in (model.weights, model.follow, model.start)]
    for _ in range(rounds):
        gain = np.bincount(cell, model.weights[flat], n * steps).reshape(n, steps)
        score = np.stack((np.zeros_like(gain), gain), axis=2)
        ahead, behind = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        ahead[:, 0] = model.start + score[:, 0]
        for k in range(1, steps):
            ahead[:, k] = np.logaddexp.reduce(ahead[:, k - 1, :, None] + model.follow[None], axis=1) + score[:, k]
        for k in range(steps - 2, -1, -1):
            then = np.logaddexp.reduce(model.follow[None] + (score[:, k + 1] + behind[:, k + 1])[:, None, :], axis=2)
            behind[:, k] = np.where((k + 1 < length)[:, None], then, 0.0)
        whole = np.logaddexp.reduce(ahead[np.arange(n), length - 1], axis=1)
        chance = np.exp(np.minimum(ahead + behind - whole[:, None, None], 0.0)) * inside[:, :, None]
        error = np.where(inside, label - chance[:, :, 1], 0.0).reshape(-1)
        pair = np.zeros((2, 2))
        for k in range(1, steps):
            live = k < length
            joint = np.exp(np.minimum(
                ahead[:, k - 1, :, None] + model.follow[None] + (score[:, k] + behind[:, k])[:, None, :] - whole[:, None, None], 0.0))
            pair += np.bincount(2 * label[live, k - 1] + label[live, k], minlength=4).reshape(2, 2) - joint[live].sum(axis=0)
        first = np.bincount(label[:, 0], minlength=2) - chance[:, 0].sum(axis=0)
        slopes = (np.bincount(flat, error[cell], WIDTH) - decay * n * model.weights, pair - decay * n * model.follow, first - decay * n * model.start)
        for x, slope, square in zip((model.weights, model.follow, model.start), slopes, seen):
            square += slope**2
            x += rate * slope / np.sqrt(square)
    return model


# --- labelled pages --------------------------------------------------------------------------

# Names that sites give to the parts of a page.
_OTHER_PARTS = {
    "menu": (("nav", ""), ("div", "nav"), ("ul", "menu"), ("div", "navbar"), ("nav", "main-menu"), ("div", "breadcrumbs")),
    "header": (("header", ""), ("div", "header"), ("div", "site-header"), ("header", "masthead")),
    "ad": (("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "advertisement"), ("div", "banner"), ("div", "sponsored"), ("section", "promo")),
    "side": (("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("section", "recommended")),
    "notice": (("div", "cookie"), ("div", "cookie-notice"), ("div", "notice"), ("div", "consent"), ("div", "gdpr-banner"), ("section", "alert"), ("div", "popup"), ("div", "paywall")),
    "form": (("form", ""), ("form", "newsletter"), ("div", "subscribe"), ("form", "search"), ("div", "login")),
    "comments": (("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "responses"), ("div", "discussion"), ("section", "reader-comments")),
    "share": (("div", "share"), ("ul", "social"), ("div", "share-buttons")),
    "footer": (("footer", ""), ("div", "footer"), ("footer", "site-footer"), ("div", "copyright")),
}
_CONTENT_PARTS = (
    ("article", ""), ("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "article-body"), ("div", "post-content"),
    ("div", "entry-content"), ("section", "story"), ("div", "main"), ("main", "content"))
_BEFORE, _WITHIN, _AFTER = ("menu", "header", "ad", "notice", "side", "form"), ("ad", "form", "side", "share", "notice", "comments"), (
    "side", "comments", "ad", "form", "notice", "share", "menu")


def laid_out(texts: list[str], pages: int, seed: int = 11) -> list[list[Block]]:
    """Pages of random layout whose blocks carry labels. ``texts`` are the blocks to place."""
    rng = random.Random(seed)
    texts = texts or ["A few words of text.", "Another line, with a comma."]
    out = []

    def text(short: bool) -> str:
        t = rng.choice(texts)
        return " ".join(t.split()[: rng.randint(1, 6)]) if short else t

    def other(kind: str, path) -> list[Block]:
        tag, name = rng.choice(_OTHER_PARTS[kind])
        top = (*path, (tag, tuple(_WORD.findall(name))))
        inner: list[Block] = []
        for _ in range(rng.randint(1, 6)):
            style = rng.random()
            if kind in ("menu", "share") or (kind in ("side", "footer") and style < 0.4):
                t = text(True)
                inner.append(Block(t, (*top, ("ul", ()), ("li", ()), ("a", ()))[: len(top) + rng.choice((2, 3))], rng.choice((len(t), len(t), 0))))
            elif kind == "footer" and style < 0.8:
                inner.append(Block(f"© {text(True)} · {text(style < 0.6)}", top, 0))
            elif kind == "form":
                inner.append(Block(text(style < 0.7), (*top, (rng.choice(("label", "button", "p", "option")), ()))))
            else:
                extra = ((rng.choice(("div", "li", "p", "article") if kind == "comments" else ("div", "p")), ()),) if style < 0.7 else ()
                inner.append(Block(text(style < 0.3), top + extra))
        return inner

    for _ in range(pages):
        base = (("html", ()), ("body", ()))
        blocks = [Block(text(True), (("html", ()), ("head", ()), ("title", ())))] if rng.random() < 0.9 else []
        wrap = (("div", tuple(_WORD.findall(rng.choice(("wrapper", "page", "container", "site"))))),) if rng.random() < 0.4 else ()
        for kind in _BEFORE:
            if rng.random() < (0.8 if kind == "menu" else 0.45):
                blocks += other(kind, base + wrap)
        tag, name = rng.choice(_CONTENT_PARTS)
        path = (*base, *wrap, (tag, tuple(_WORD.findall(name))))
        if rng.random() < 0.85:
            head = (("header", ()),) if rng.random() < 0.2 else ()
            blocks.append(Block(text(rng.random() < 0.7), (*path, *head, ("h1", ())), 0, 1))
        for _ in range(rng.randint(1, 14)):
            inner = rng.choice((("p",), ("p",), ("p",), ("p", "b"), (), ("h2",), ("ul", "li"), ("blockquote", "p"), ("div", "p"), ("pre",), ("section", "p"), ("table", "tr", "td")))
            t = text(rng.random() < 0.25)
            blocks.append(Block(t, path + tuple((x, ()) for x in inner), len(t) // 8 if rng.random() < 0.1 else 0, 1))
            if rng.random() < 0.2:
                blocks += other(rng.choice(_WITHIN), path)
        for kind in _AFTER:
            if rng.random() < 0.35:
                blocks += other(kind, path if kind == "comments" and rng.random() < 0.3 else base + wrap)
        if rng.random() < 0.9:
            blocks += other("footer", base + wrap)
        out.append(blocks)
    return out


def fit(pages: DataFrame, *, lenders: int = 100, layouts: int = 600) -> ChainModel:
    """Train on ``layouts`` laid-out pages with the text of at most ``lenders`` rows of ``pages`` (html), those with the smallest hashes."""
    some = pages.where("html IS NOT NULL").select("html", F.xxhash64("html").alias("h"))
    some = smallest_hashes(some, "h", lenders).groupBy("h").agg(F.first("html").alias("html"))
    lent = some.orderBy("h").select("html").collect()
    texts = [b.text for r in lent for b in blocks_of(r[0])]
    features = Features()
    return train([(features.of(blocks), [b.label for b in blocks]) for blocks in laid_out(texts, layouts)])


def extract(pages: DataFrame, model: ChainModel | None = None) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    The whole html is read; null is empty. Content blocks are joined by line breaks,
    in page order; a page without any has empty text. Repeated rows each get their
    row, null ids and urls stay, other columns are ignored.
    """
    model = model or fit(pages)

    def run(batches):
        features = Features()
        for batch in batches:
            texts = []
            for html in batch.column(2):
                blocks = blocks_of(html.as_py())
                labels = model.decode(features.of(blocks))
                texts.append("\n".join(b.text for b, y in zip(blocks, labels) if y))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
