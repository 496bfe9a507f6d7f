"""Main text of web pages: a recurrent block labeller.

A page is cut into blocks, the runs of text between block-level tags. Each
block is described by its tag path (names and classes of its ancestors, hashed),
its words (hashed) and a few figures; a bidirectional LSTM in numpy reads the
blocks of a page in order and labels every one with the whole page in view.

Training pages are a bounded sample (``FIT_PAGES`` pages, the first by a
hash, whole) and ``FIT_LAYOUTS`` generated layouts filled with the words
of that sample, for page parts that a sample may lack. Their blocks are
labelled by the rules in ``taught``. The weights sent to the executors have a
fixed size. Pages are labelled row by row in Arrow batches, without a shuffle.

Defined results: null or empty html, and pages without main blocks, give an
empty text; unclosed and stray tags are tolerated; scripts, styles, forms'
fields, templates, comments and the page's head have no blocks, but only
scripts, styles, titles, text areas and comments run to the page's end where
nothing closes them; a head ends at the first block-level tag, and what is in
an unclosed field or template counts as text. ``<br>`` is white space; repeated
rows are labelled each; an empty table gives no rows; other columns are left
out, whatever their names. A page of more than ``BLOCKS_AT_ONCE`` blocks is read
in windows that hand on the network's state, so its memory is that of its text.
A block is main text from a probability of 0.5 on.
"""

from __future__ import annotations

import hashlib
import html as html_
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.workers import resident

FIT_PAGES = 300
FIT_LAYOUTS = 1200
HIDDEN = 20
PATH_SLOTS, WORD_SLOTS, FIGURES = 256, 16, 5
EPOCHS = 8
DROPPED = 0.5
BLOCKS_AT_ONCE = 8192

#: Tags that end a block, and those whose content is never text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title"
#: Left out where an end tag closes them within the element that they began in.
LEFT_OUT = frozenset("head template button select".split())
TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(" + RAW.replace(" ", "|") + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PARTS = re.compile(r"[a-z]+")

#: What the teaching rules take for furniture, by tag and by part of a class, id or role.
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments complementary contentinfo consent cookie cookies disclaimer discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup privacy promo promoted promotion related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe tags toc toolbar topbar warning widget widgets".split()
)


#: What no class names of an element that holds the article can hide, and what stays furniture whatever it holds.
CONTENT_NAMES = frozenset("article content main post story entry".split())
REMARKS = frozenset("comment comments discussion disqus footer nav navigation replies reply respond".split())
#: A block in a plain element reads as prose from so many characters on.
PROSE, LINKED = 40, 0.3


def _names(attributes: str) -> tuple[str, ...]:
    found = NAMED.findall(attributes)
    return tuple(dict.fromkeys(p for f in found for p in NAME_PARTS.findall("".join(f).lower()))) if found else ()


def blocks_of(page: str) -> list[tuple[tuple, str, float]]:
    """(tag path, text, share of linked characters) of each block, in order.
    A path is a tuple of (tag, name parts), outermost first."""
    stack: list[tuple[str, tuple[str, ...], int]] = []
    out, parts = [], []
    linked, link_depth, begun = 0, 0, 0
    open_ = []  # of LEFT_OUT: the tag, and what was there before it

    def end() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join(html_.unescape(raw).split())
            if text:
                out.append((tuple(stack), text, min(1.0, linked / max(1, len(raw)))))
            parts.clear()
        linked = 0

    for m in TOKENS.finditer(page):
        text = m.group(5)
        if text is not None:
            parts.append(text)
            if link_depth:
                linked += len(text)
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):  # an end tag
            if tag == "a":
                link_depth = max(0, link_depth - 1)
            elif tag in LEFT_OUT:
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i][0] == tag:
                        _, stack[:], n, parts[:], linked, link_depth = open_[i]
                        del out[n:], open_[i:]
                        break
            elif tag in BLOCK_TAGS:
                end()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        open_ = [o for o in open_ if len(o[1]) <= i]
                        break
        elif tag == "a":
            link_depth = 1
        elif tag == "br":
            parts.append(" ")
        elif tag in LEFT_OUT:
            if tag != "template":  # the others do not lie within each other
                open_ = [o for o in open_ if o[0] != tag]
            open_.append((tag, stack[:], len(out), parts[:], linked, link_depth))
        elif tag in BLOCK_TAGS:
            end()
            link_depth = 0
            open_ = [o for o in open_ if o[0] != "head"]
            if len(stack) > (len(open_[-1][1]) if open_ else 0) and (stack[-1][0] == "p" or stack[-1][0] == tag == "li" or stack[-1][0] in ("dd", "dt") and tag in ("dd", "dt")):
                stack.pop()  # these end where the next begins
            if tag not in VOID_TAGS:
                begun += 1
                stack.append((tag, _names(m.group(4)), begun))
    end()
    return [*_unwrapped(out)]


def _furniture(tag: str, names: tuple[str, ...]) -> bool:
    return tag in FURNITURE_TAGS or bool(FURNITURE_NAMES.intersection(names))


def _unwrapped(blocks: list[tuple[tuple, str, float]]) -> Iterator[tuple[tuple, str, float]]:
    """Paths without the elements' numbers. An element around the article is a
    plain one, whatever its tag and names: the body, what holds a main element,
    and what holds most of the page's unlinked text with a heading of the page
    or a content element in it, remarks and navigation excepted."""
    size: dict[int, float] = {}
    holds_main: set[int] = set()
    holds_content: set[int] = set()
    for path, text, linked in blocks:
        weight, main, content = len(text) * (1 - linked), False, path[-1][0] == "h1" if path else False
        for tag, names, number in reversed(path):
            size[number] = size.get(number, 0) + weight
            if main:
                holds_main.add(number)
            if content:
                holds_content.add(number)
            plain = not _furniture(tag, names)
            main |= tag == "main" and plain
            content = (content and not REMARKS.intersection(names)) or (plain and (tag in ("article", "main") or bool(CONTENT_NAMES.intersection(names))))
    whole = sum(len(text) * (1 - linked) for _, text, linked in blocks)
    for path, text, linked in blocks:
        yield tuple(
            ("div", ())
            if (_furniture(tag, names) or tag == "header") and (tag == "body" or number in holds_main or (number in holds_content and size[number] * 2 >= whole and tag not in ("nav", "footer") and not REMARKS.intersection(names)))
            else (tag, names)
            for tag, names, number in path
        ), text, linked


def prose(text: str, linked: float) -> bool:
    """Whether a block reads as a sentence or more, and is not mostly links."""
    return len(text) >= PROSE and linked < LINKED and text.rstrip("\"'”’)»").endswith((".", "!", "?", "…", "。"))


def taught(path: tuple, text: str = "", linked: float = 0.0) -> bool:
    """The teaching rules: a block is main unless an ancestor is furniture by
    tag or name; outside an article, main, or a content element, only
    paragraphs, headings and prose in plain elements count. A header counts
    within an article. Elements around the article are plain (``_unwrapped``)."""
    inside = False
    for tag, names in path:
        if _furniture(tag, names) or (tag == "header" and not inside):
            return False
        inside |= tag in ("article", "main") or bool(CONTENT_NAMES.intersection(names))
    return inside or (bool(path) and (path[-1][0] in ("p", "h1", "h2", "h3", "blockquote", "pre") or (prose(text, linked) and path[-1][0] in ("div", "section", "td"))))


def _slot(text: str, slots: int) -> tuple[int, float]:
    h = zlib.crc32(text.encode())
    return h % slots, 1.0 if (h >> 16) & 1 else -1.0


class _WordSlots(dict):
    """word -> its slot, in the second half where its sign is negative."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        at, sign = _slot(word, WORD_SLOTS)
        found = self[word] = at + WORD_SLOTS * (sign < 0)
        return found


_WORDS = _WordSlots()
_PATHS: dict[tuple, np.ndarray] = {}


def _path_vector(path: tuple) -> np.ndarray:
    found = _PATHS.get(path)
    if found is None:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        found = _PATHS[path] = np.zeros(PATH_SLOTS)
        for depth, (tag, names) in enumerate(path):
            for item in (f"<{tag}", *(f".{n}" for n in names), *([f"<{tag}$"] if depth == len(path) - 1 else [])):
                at, sign = _slot(item, PATH_SLOTS)
                found[at] += sign
    return found


def features(blocks: list[tuple[tuple, str, float]]) -> np.ndarray:
    out = np.zeros((len(blocks), PATH_SLOTS + WORD_SLOTS + FIGURES))
    for i, (path, text, linked) in enumerate(blocks):
        out[i, :PATH_SLOTS] = _path_vector(path)
        slots = [*map(_WORDS.__getitem__, text.lower().split(" "))]
        signed = np.bincount(slots, minlength=2 * WORD_SLOTS)
        out[i, PATH_SLOTS:-FIGURES] = (signed[:WORD_SLOTS] - signed[WORD_SLOTS:]) / len(slots)
        n = len(text)
        out[i, -FIGURES:] = (np.log1p(n) / 6, min(1.0, n / 400), linked, min(4, text.count(".") + text.count(",")) / 4, prose(text, linked))
    return out


def init_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d = PATH_SLOTS + WORD_SLOTS + FIGURES
    w = {}
    for way in ("f", "b"):
        w[f"{way}x"] = rng.normal(0, 1 / np.sqrt(d), (d, 4 * HIDDEN))
        w[f"{way}h"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w[f"{way}0"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # input, forget, output, candidate
    w["o"] = rng.normal(0, 1 / np.sqrt(2 * HIDDEN + d), (2 * HIDDEN + d, 1))
    w["o0"] = np.zeros(1)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, state: tuple | None = None, *, keep: bool = False) -> tuple[np.ndarray, list, tuple]:
    """One direction over (time, page, feature), from ``state`` on; padding
    leaves the state as it is. Only training keeps what the steps computed."""
    steps, pages, _ = x.shape
    h, c = state or (np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)))
    projected, out, kept = x @ wx + b, np.empty((steps, pages, HIDDEN)), []
    for t in range(steps):
        z = projected[t] + h @ wh
        gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        m = mask[t][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep:
            kept.append((h, c, i, f, o, g, tc, m))
        h, c = m * (o * tc) + (1 - m) * h, m * c_new + (1 - m) * c
        out[t] = h
    return out, kept, (h, c)


def _run_back(dout: np.ndarray, x: np.ndarray, kept: list, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, pages, _ = x.shape
    dz_all = np.empty((steps, pages, 4 * HIDDEN))
    dwh = np.zeros_like(wh)
    dh, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc, m = kept[t]
        dh = dh + dout[t]
        dho = m * dh
        dcn = m * dc + dho * o * (1 - tc**2)
        dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), dho * tc * o * (1 - o), dcn * i * (1 - g**2)], axis=1)
        dz_all[t] = dz
        dwh += h.T @ dz
        dh, dc = (1 - m) * dh + dz @ wh.T, (1 - m) * dc + dcn * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1])), np.zeros((steps, len(pages)))
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


def forward(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, alive: np.ndarray | float = 1.0, *, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Probability of main text for each block, shape (time, page)."""
    ahead, kept_f, _ = _run(x, mask, w["fx"], w["fh"], w["f0"], keep=keep)
    behind, kept_b, _ = _run(x[::-1], mask[::-1], w["bx"], w["bh"], w["b0"], keep=keep)
    joined = np.concatenate([ahead, behind[::-1], x], axis=2) * alive
    return _sigmoid((joined @ w["o"])[..., 0] + w["o0"]), (joined, kept_f, kept_b)


def forward_long(w: dict[str, np.ndarray], blocks: list[tuple[tuple, str, float]], at_once: int = BLOCKS_AT_ONCE) -> np.ndarray:
    """``forward`` for one page of any length, in windows that hand on the
    state; a block leaves one number and one state of HIDDEN numbers behind."""
    n, starts = len(blocks), range(0, len(blocks), at_once)
    window = lambda a: features(blocks[a : a + at_once])[:, None, :]
    ahead, p, state = np.empty((n, HIDDEN)), np.empty(n), None
    for a in starts:
        x = window(a)
        out, _, state = _run(x, np.ones(x.shape[:2]), w["fx"], w["fh"], w["f0"], state)
        ahead[a : a + at_once] = out[:, 0]
    state = None
    for a in reversed(starts):
        x = window(a)
        out, _, state = _run(x[::-1], np.ones(x.shape[:2]), w["bx"], w["bh"], w["b0"], state)
        joined = np.concatenate([ahead[a : a + at_once], out[::-1, 0], x[:, 0]], axis=1)
        p[a : a + at_once] = _sigmoid((joined @ w["o"])[:, 0] + w["o0"])
    return p


def train(pages: list[tuple[np.ndarray, np.ndarray]], *, seed: int = 10, epochs: int = EPOCHS, rate: float = 0.01, at_once: int = 24) -> dict[str, np.ndarray]:
    """Adam over batches of pages of like length; the same pages and seed give the same weights."""
    w, rng = init_weights(seed), np.random.default_rng(seed)
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
    batches, step = [order[i : i + at_once] for i in range(0, len(order), at_once)], 0
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        for b in rng.permutation(len(batches)):
            x, mask = _padded([pages[i][0] for i in batches[b]])
            want = np.zeros(mask.shape)
            for j, i in enumerate(batches[b]):
                want[: len(pages[i][1]), j] = pages[i][1]
            # units are left out of a page at random, so that a block's own path and words must tell it too
            alive = np.ones((1, x.shape[1], w["o"].shape[0]))
            alive[..., : 2 * HIDDEN] = (rng.random((1, x.shape[1], 2 * HIDDEN)) >= DROPPED) / (1 - DROPPED)
            p, (joined, kept_f, kept_b) = forward(w, x, mask, alive, keep=True)
            dz = (p - want) * mask / mask.sum()
            grad = {"o": np.einsum("tpk,tp->k", joined, dz)[:, None], "o0": np.array([dz.sum()])}
            dj = dz[..., None] * w["o"][:, 0] * alive
            grad["fx"], grad["fh"], grad["f0"] = _run_back(dj[..., :HIDDEN], x, kept_f, w["fh"])
            grad["bx"], grad["bh"], grad["b0"] = _run_back(dj[::-1, :, HIDDEN : 2 * HIDDEN], x[::-1], kept_b, w["bh"])
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in w.items()}


def layout(rng: np.random.Generator, words: list[str]) -> str:
    """A generated page with parts that web pages have, in a random order."""
    say = lambda a, b: " ".join(words[i] for i in rng.integers(0, len(words), rng.integers(a, b)))
    pick = lambda *x: x[rng.integers(0, len(x))]
    link = lambda: f'<a href="/x">{say(1, 4)}</a>'
    links = lambda n: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>" if rng.random() < 0.7 else pick(" ", " | ").join(link() for _ in range(rng.integers(1, n + 1)))
    part = lambda tag, name, body: f'<{tag}{f" class=\"{name}\"" if name else ""}>{body}</{tag}>'
    ad = lambda: part(pick("div", "aside", "section"), pick("ad", "ads", "advert", "sponsored", "promo", "banner"), pick(say(3, 14), f"<p>{say(4, 25)}</p>", links(2)))
    note = lambda: part(pick("div", "section"), pick("cookie-notice", "notice", "consent", "warning", "gdpr", "popup", "newsletter"), pick(say(5, 25), f"<p>{say(6, 30)}</p>"))
    inner = [f"<h1>{say(3, 10)}</h1>"] * (rng.random() < 0.55)
    for _ in range(rng.integers(1, 9) if rng.random() < 0.95 else rng.integers(20, 120)):
        kind = rng.random()
        inner.append(f"<p>{say(1, 80)}</p>" if kind < 0.7 else f"<h2>{say(2, 7)}</h2>" if kind < 0.78 else "<ul>" + "".join(f"<li>{say(2, 14)}</li>" for _ in range(rng.integers(2, 5))) + "</ul>" if kind < 0.85 else f"<blockquote>{say(4, 30)}</blockquote>" if kind < 0.89 else f"<table><tr><td>{say(1, 5)}</td><td>{say(1, 5)}</td></tr></table>" if kind < 0.92 else ad())
    comments = lambda: part(pick("section", "div"), pick("comments", "discussion", "replies"), f"<h3>{say(1, 3)}</h3>" + "".join(part(pick("div", "article", "p"), pick("comment", "reply", ""), f"<p>{say(3, 40)}</p>") for _ in range(rng.integers(1, 5))))
    if rng.random() < 0.15:
        inner.append(comments())
    if rng.random() < 0.2:  # divisions in place of paragraphs, with names that say nothing
        name, around = ("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 6))) for _ in "ab")
        inner = [x if not x.startswith("<p>") else part("div", name, x[3:-4].capitalize() + pick(".", "!", "?", ".")) for x in inner]
        wrapped = [part("div", pick("", around), "".join(inner))]
    else:
        wrapped = [part(*pick(("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "story"), ("section", "")), "".join(inner))]
    if rng.random() < 0.25:
        wrapped = [part("main", "", wrapped[0])]
    elif rng.random() < 0.15:  # paragraphs that nothing encloses
        wrapped = inner
    before = [x for x, p in ((part("header", "", f"{pick('h1', 'div', 'p') and ''}<p>{say(1, 6)}</p>"), 0.4), (part("nav", "", links(rng.integers(2, 8))), 0.7), (part("div", pick("menu", "navbar", "breadcrumbs", "header"), links(3)), 0.25), (note(), 0.3), (ad(), 0.5), (part("form", "", f"<label>{say(1, 3)}</label><input><p>{say(1, 6)}</p>"), 0.2)) if rng.random() < p]
    after = [x for x, p in ((part("aside", pick("", "sidebar"), f"<h3>{say(1, 4)}</h3>" + pick(links(4), f"<p>{say(4, 30)}</p>")), 0.4), (part("div", pick("sidebar", "related", "widget", "share", "social"), links(3) + f"<p>{say(2, 15)}</p>"), 0.35), (comments(), 0.35), (ad(), 0.3), (note(), 0.2), (part("form", "", f"<p>{say(1, 9)}</p>"), 0.15), (part("footer", "", pick(say(3, 20), f"<p>{say(3, 20)}</p>", links(3))), 0.8)) if rng.random() < p]
    parts = [*before, *wrapped, *after] if rng.random() < 0.93 else inner
    return "".join(parts) if rng.random() < 0.2 else "<body>" + "".join(parts) + "</body>"


def fit_labeller(pages: list[str], *, layouts: int = FIT_LAYOUTS, seed: int = 10) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    parsed = [blocks_of(p) for p in pages]
    words = sorted({w for blocks in parsed for _, text, _ in blocks for w in text.split(" ")})[:20_000] or ["a"]
    parsed += [blocks_of(layout(rng, words)) for _ in range(layouts)]
    return train([(features(b), np.array([taught(*block) for block in b], float)) for b in parsed if b], seed=seed)


class Extractor:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = {k: v.astype(np.float64) for k, v in weights.items()}

    def texts(self, pages: list[str]) -> list[str]:
        """The main text of each page; pages of like length are read together,
        very long ones alone."""
        parsed = [blocks_of(p) for p in pages]
        out = [""] * len(pages)
        main = lambda i, p: "\n".join(text for (_, text, _), own in zip(parsed[i], p, strict=False) if own >= 0.5)
        for i, b in enumerate(parsed):
            if len(b) > BLOCKS_AT_ONCE:
                out[i] = main(i, forward_long(self.weights, b))
        order = sorted((i for i, b in enumerate(parsed) if 0 < len(b) <= BLOCKS_AT_ONCE), key=lambda i: len(parsed[i]))
        at = 0
        while at < len(order):
            n = max(1, BLOCKS_AT_ONCE // len(parsed[order[min(at + 255, len(order) - 1)]]))
            group = order[at : at + min(n, 256)]
            at += len(group)
            p, _ = forward(self.weights, *_padded([features(parsed[i]) for i in group]))
            for j, i in enumerate(group):
                out[i] = main(i, p[:, j])
        return out


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fit_pages: int = FIT_PAGES, at_once: int = 256) -> DataFrame:
    """Per page: (page_id, url, text, n_chars)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    # only hashes are ordered; then the pages up to the last chosen hash are read
    hashed = rows.select(F.xxhash64("url", "html").alias("h"), "html")
    last = hashed.select("h").distinct().orderBy("h").limit(fit_pages).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.any_value("html").alias("html")).collect()
    packed = pickle.dumps(fit_labeller([r["html"] for r in sorted(sample, key=lambda r: r["h"])]))
    sent, key = pages.sparkSession.sparkContext.broadcast(packed), hashlib.sha256(packed).hexdigest()
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = resident(key, lambda: Extractor(pickle.loads(sent.value)))
        for whole in batches:
            for at in range(0, len(whole), at_once):
                batch = whole.slice(at, at_once)
                texts = extractor.texts(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extracted, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
