"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its blocks: the text between block-level tags,
with the path of open tags and their classes, ids and roles.  Each block is a
vector of hashed path steps, the mean of its words' vectors (learnt, one per
hash) and a few ratios; a bidirectional LSTM in numpy reads the whole sequence
and labels every block as article or not, so a block is judged in the light of
the document around it.  The model is fitted when first used, to pages that
``example_page`` composes with known labels in many layouts.

Tags are read as HTML reads them (attributes quoted, unquoted or broken, raw
text, comments) in one pass whose time grows with the page alone.  What stands
in scripts, styles, templates, drawings, frames and form fields is no text.  A
tag that the page's end cuts off is dropped; a quote that is never closed ends
with its tag.

Null, empty and textless pages give the empty text.  Rows are treated one by
one, so repeated rows and ties agree, and an empty table gives no rows.  Pages
are read whole however long, and no block is cut.  A block's path is looked at to
the root however deep: its 64 innermost steps one by one, those above as the set of
their hashes that is handed down.  Columns other than id, url and html, whatever
their names, don't reach the result.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark picture q s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes textarea".split())
UNSEEN = frozenset("template noscript svg object canvas math".split())
CLOSED_BY_NEXT = frozenset("li tr td th dt dd option".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())

TAG_NAME = re.compile(r"[a-zA-Z][^ \t\n\f\r/>]*+")
SKIPPED = re.compile(r"[ \t\n\f\r/]*+")
ATTRIBUTE_NAME = re.compile(r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+")
EQUALS = re.compile(r"[ \t\n\f\r]*+=[ \t\n\f\r]*+")
UNQUOTED = re.compile(r"[^ \t\n\f\r>]*+")
RAW_END = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>])", re.I) for name in RAW | {"title"}}
NAME = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

PATH, WORDS, EXTRA, HIDDEN, TABLE = 512, 16, 8, 24, 4096
SIZE = PATH + WORDS + EXTRA
#: Steps of a path that are kept as such; those above are a set of places, a number of PATH bits that stands first.
STEPS = 64

Path = tuple[int | str, ...]
Block = tuple[str, Path, float]


def _hash(text: str, n: int, seed: int = 0) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"), seed) % n


def stepped(path: Path, steps: list[str]) -> Path:
    """A path with more steps at its end; what is no longer among the innermost goes into the set."""
    whole = (*path, *steps)
    if len(whole) <= STEPS:
        return whole
    places = 0
    for step in whole[:-STEPS]:
        places |= step if isinstance(step, int) else 1 << _hash(step, PATH, 0) | 1 << _hash(step, PATH, 1)
    return (places, *whole[-STEPS:])


def _tag_end(page: str, at: int, last: dict[str, int], names: list[str] | None) -> int:
    """Where a tag's attributes end, past the ``>``; -1 if the page ends first.  Fills ``names``."""
    size = len(page)
    while True:
        at = SKIPPED.match(page, at).end()
        if at >= size:
            return -1
        if page[at] == ">":
            return at + 1
        key = ATTRIBUTE_NAME.match(page, at)
        at = key.end()
        sign = EQUALS.match(page, at)
        if not sign:
            continue
        at = sign.end()
        if at >= size:
            return -1
        quote = page[at]
        if quote in "\"'":
            if at >= last[quote]:  # never closed
                end = page.find(">", at)
                return end + 1 if end >= 0 else -1
            end = page.find(quote, at + 1)
            value, at = page[at + 1 : end], end + 1
        else:
            m = UNQUOTED.match(page, at)
            value, at = m[0], m.end()
        if names is not None and key[0].lower() in ("class", "id", "role"):
            names += NAME.findall(value.lower())


def blocks(page: str) -> list[Block]:
    """Text, path steps and share of linked characters of each block that has text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, Path, bool]] = [("", (), False)]  # element, steps down to it, whether its text is no text
    still_open: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link = 0, False
    last = {q: page.rfind(q) for q in "\"'"}

    def say(text: str) -> None:
        nonlocal linked
        if text and not stack[-1][2]:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) * in_link

    def close() -> None:
        nonlocal linked, in_link
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((text, stack[-1][1], min(1.0, linked / len(text))))
            parts.clear()
        linked, in_link = 0, False

    def pop() -> None:
        still_open[stack.pop()[0]] -= 1

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        following = page[start + 1 : start + 2]
        ends = following == "/"
        name = TAG_NAME.match(page, start + 1 + ends)
        if not name and not ends and following not in ("!", "?") or not following or ends and start + 2 >= size:
            say(page[at : start + 1])  # a mere sign
            at = start + 1
            continue
        say(page[at:start])
        if not name:
            if page.startswith("<!--", start):
                if page.startswith(">", start + 4):
                    at = start + 5
                elif page.startswith("->", start + 4):
                    at = start + 6
                else:
                    end = page.find("-->", start + 4)
                    at = end + 3 if end >= 0 else size
            else:
                end = page.find(">", start)
                at = end + 1 if end >= 0 else size
            continue
        tag = name[0].lower()
        names: list[str] | None = None if ends or tag in INLINE else []
        at = _tag_end(page, name.end(), last, names)
        if at < 0:
            break
        if tag in RAW or tag == "title":
            if ends:
                continue
            end = RAW_END[tag].search(page, at)
            inner = page[at : end.start() if end else size]
            at = end.end() if end else size
            if end:
                at = _tag_end(page, at, last, None)
                at = at if at >= 0 else size
            if tag == "title" and not stack[-1][2]:
                close()
                stack.append((tag, stepped(stack[-1][1], ["<title"]), False))
                say(inner)
                close()
                stack.pop()
            elif tag in ("iframe", "textarea"):
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = not ends
            continue
        close()
        if tag in VOID:
            continue
        if ends:
            if still_open[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if stack[-1][0] in CLOSED_BY_BLOCK:
            pop()
        if stack[-1][0] == tag and tag in CLOSED_BY_NEXT:
            pop()
        stack.append((tag, stepped(stack[-1][1], [f"<{tag}", *names]), stack[-1][2] or tag in UNSEEN))
        still_open[tag] += 1
    close()
    return out


class Vectors:
    """Blocks to vectors; remembers the hashes of words and the vectors of paths."""

    def __init__(self, table: np.ndarray | None = None) -> None:
        self.table = table
        self.words: dict[str, int] = {}
        self.paths: dict[Path, np.ndarray] = {}

    def path(self, steps: Path) -> np.ndarray:
        """Hashed steps; the three innermost weigh more."""
        row = self.paths.get(steps)
        if row is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            row = self.paths[steps] = np.zeros(PATH, np.float32)
            if steps and isinstance(steps[0], int):
                row[np.unpackbits(np.frombuffer(steps[0].to_bytes(PATH // 8, "little"), np.uint8), bitorder="little") == 1] = 0.7
                steps = steps[1:]
            for depth, step in enumerate(reversed(steps)):
                for seed in (0, 1):
                    k = _hash(step, PATH, seed)
                    row[k] = max(row[k], 1.0 if depth < 3 else 0.7)
        return row

    def word_ids(self, words: list[str]) -> list[int]:
        if len(self.words) > 500_000:
            self.words.clear()
        get, add = self.words.get, self.words.setdefault
        return [i if (i := get(w)) is not None else add(w, _hash(w.lower().strip(".,:;!?()"), TABLE)) for w in words]

    def of(self, page: list[Block]) -> tuple[np.ndarray, list[list[int]]]:
        """Vectors without their word part, and the words' places."""
        x, ids = np.zeros((len(page), SIZE), np.float32), []
        for row, (text, path, linked) in zip(x, page, strict=True):
            row[:PATH] = self.path(path)
            words = text.split()
            ids.append(self.word_ids(words))
            n = len(words)
            ends = text.count(".") + text.count(",") + text.count("!") + text.count("?")
            row[PATH + WORDS :] = (np.log1p(n) / 5, linked, min(1.0, ends / n), n < 5, n > 25, len(path) / 10, "©" in text, linked > 0.5 and n < 8)
        return x, ids

    def whole(self, page: list[Block]) -> np.ndarray:
        """Vectors with the mean of the words' vectors."""
        x, ids = self.of(page)
        if ids:
            starts = np.cumsum([0, *map(len, ids[:-1])])
            sums = np.add.reduceat(self.table[np.concatenate([np.asarray(i, np.int64) for i in ids])], starts)
            x[:, PATH : PATH + WORDS] = sums / np.array([[len(i)] for i in ids], np.float32)
        return x


class BiLSTM:
    """A bidirectional LSTM with a logistic output per step, for padded (time, batch, size) arrays."""

    def __init__(self, weights: list[np.ndarray] | None = None, seed: int = 1):
        rng = np.random.default_rng(seed)
        w = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        table = rng.normal(0, 0.3, (TABLE, WORDS)).astype(np.float32)
        self.w = weights or [w(SIZE, 4 * HIDDEN), w(HIDDEN, 4 * HIDDEN), bias, w(SIZE, 4 * HIDDEN), w(HIDDEN, 4 * HIDDEN), bias.copy(), w(2 * HIDDEN + SIZE, 1), np.zeros(1, np.float32), table]

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x: np.ndarray, mask: np.ndarray, d: int, keep: list | None) -> np.ndarray:
        wx, wh, b = self.w[3 * d : 3 * d + 3]
        steps, batch = mask.shape
        gates = x @ wx + b
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        out = np.zeros((steps, batch, HIDDEN), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a = gates[t] + h @ wh
            s = self._sigmoid(a[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = (f * c + i * g) * m
            tanh = np.tanh(c_new)
            if keep is not None:
                keep.append((t, i, f, o, g, c, tanh, h, m))
            h, c = o * tanh * m, c_new
            out[t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict[int, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([*(self._run(x, mask, d, keep and keep[d]) for d in (0, 1)), x], axis=2)
        return self._sigmoid(every @ self.w[6] + self.w[7])[:, :, 0], every

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Of the mean logistic loss over all blocks, by back-propagation through time: for the weights, and for the word parts of ``x``."""
        keep: dict[int, list] = {0: [], 1: []}
        p, every = self.forward(x, mask, keep)
        d_out = ((p - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        grads = [np.zeros_like(w) for w in self.w[:8]]
        grads[6] = np.einsum("tbi,tbo->io", every, d_out)
        grads[7] = d_out.sum(axis=(0, 1))
        d_every = d_out @ self.w[6].T
        part = slice(PATH, PATH + WORDS)
        d_words = d_every[:, :, 2 * HIDDEN :][:, :, part].copy()
        for d in (0, 1):
            wh = self.w[3 * d + 1]
            d_gates = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            dh_next = dc_next = np.zeros((mask.shape[1], HIDDEN), np.float32)
            for t, i, f, o, g, c, tanh, h, m in reversed(keep[d]):
                dh = (d_every[t, :, d * HIDDEN : (d + 1) * HIDDEN] + dh_next) * m
                dc = (dh * o * (1 - tanh**2) + dc_next) * m
                da = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                d_gates[t] = da
                grads[3 * d + 1] += h.T @ da
                dh_next, dc_next = da @ wh.T, dc * f
            flat = d_gates.reshape(-1, 4 * HIDDEN)
            grads[3 * d] = x.reshape(-1, SIZE).T @ flat
            grads[3 * d + 2] = flat.sum(axis=0)
            d_words += d_gates @ self.w[3 * d][part].T
        return grads, d_words


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), SIZE), np.float32), np.zeros((longest, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


# What page furniture is called and says, for composed pages.
ROLES = {
    "ad": ("ad ads advert advertisement banner sponsored sponsor promo promotion adsense dfp commercial".split(), "advertisement sponsored buy now offer sale shop deal free discount anzeige jetzt kaufen publicité anuncio oferta".split()),
    "nav": ("menu nav navbar navigation breadcrumb breadcrumbs topnav mainmenu submenu toc pagination pager tabs skip left links".split(), "home news about contact products login next previous start über kontakt accueil inicio contacto blog archive".split()),
    "aside": ("sidebar side widget related share social recommended recent popular trending author tags aside rail promobox right left secondary sharing".split(), "related read more share follow popular latest tags mehr lesen auch partager lire leer más twitter facebook".split()),
    "notice": ("cookie cookies notice consent alert popup modal newsletter gdpr overlay banner message subscribe warning".split(), "we use cookies accept privacy policy subscribe newsletter browser wir verwenden cookies acceptez utilizamos notice".split()),
    "form": ("form search login signup contact subscribe newsletter comment".split(), "search submit email name password send sign up suche senden rechercher envoyer buscar enviar your".split()),
    "header": ("header masthead top logo branding site title tagline banner topbar".split(), "the daily site official welcome magazine online willkommen bienvenue bienvenido".split()),
    "footer": ("footer copyright legal bottom colophon credits footnote siteinfo".split(), "copyright all rights reserved imprint terms privacy policy impressum datenschutz mentions légales aviso legal contact".split()),
    "comments": ("comments comment replies disqus responses discussion commentlist respond thread reactions".split(), "reply says great thanks i think comment posted agree antworten danke répondre merci gracias responder".split()),
}
CONTENT = "content maincontent main post entry story article text body page primary single blog news document maintext hentry copy section inner".split()
NEUTRAL = "wrapper container site row col grid layout box inner outer clearfix block group region panel wide center page".split()


def example_page(rng: random.Random) -> list[tuple[str, tuple[str, ...], float, int]]:
    """A composed page: blocks as ``blocks`` gives them, each with its label (1: article)."""
    syllables = ["an", "er", "the", "on", "ti", "re", "ou", "sch", "ei", "en", "la", "que", "os", "ci", "mo", "ka", "lu", "st", "be", "ing"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(150)]
    noise = rng.random() < 0.1
    spoken = rng.random() < 0.35  # furniture says what it is

    def text(lo: int, hi: int, stops: bool = True, says: list[str] | None = None) -> str:
        out = []
        for _ in range(rng.randint(lo, hi)):
            w = rng.choice(says) if says and spoken and rng.random() < 0.5 else rng.choice(vocabulary)
            out.append(w + (rng.choice([".", ",", ""]) if stops and rng.random() < 0.2 else "") + (rng.choice(["%%%", "***", "&&&"]) if noise else ""))
        return " ".join(out) + ("." if stops else "")

    def name() -> tuple[str, ...]:
        """A class that means nothing."""
        k = rng.random()
        return () if k < 0.55 else (rng.choice(NEUTRAL),) if k < 0.9 else ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))),)

    out: list[tuple[str, tuple[str, ...], float, int]] = []
    base = rng.choice([("<html", "<body"), ("<html", "<body"), ("<html", "<body"), ("<html", "<body", *rng.sample(CONTENT, 1), *name()), ("<body",), ()])
    for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
        base = (*base, "<div", *name())

    def add(n: str, path: tuple[str, ...], label: int, linked: float = 0.0) -> None:
        out.append((n, path, linked, label))

    def part(inside: tuple[str, ...], kind: str, element: str) -> tuple[str, ...]:
        """An element of the kind's own, or one that its class names."""
        if rng.random() < 0.5:
            return (*inside, element, *name())
        return (*inside, rng.choice(["<div", "<div", "<section", "<ul"]), *name(), *rng.sample(ROLES[kind][0], rng.choice([1, 1, 2])))

    def chrome(inside: tuple[str, ...], kinds: tuple[str, ...] = tuple(ROLES)) -> None:
        often = [k for k in ("ad", "comments") if k in kinds]
        kind = rng.choice(often) if often and rng.random() < 0.2 else rng.choice(kinds)
        says = ROLES[kind][1]
        if kind == "ad":
            p = (*inside, rng.choice(["<div", "<div", "<section", "<aside"]), *name(), rng.choice(ROLES["ad"][0]))
            for _ in range(rng.choice([1, 1, 2])):
                add(text(3, 40, says=says), (*p, *rng.choice([(), (), ("<p",), ("<h3",)])), 0, rng.choice([0.0, 1.0]))
        elif kind == "nav":
            p = part(inside, "nav", "<nav")
            for _ in range(rng.randint(1, 9)):
                add(text(1, 3, False, says), (*p, *rng.choice([("<ul", "<li"), ("<ul", "<li"), (), ("<div",), ("<ol", "<li")])), 0, float(rng.random() < 0.92))
        elif kind == "aside":
            p = part(inside, "aside", "<aside")
            if rng.random() < 0.6:
                add(text(1, 4, False, says), (*p, rng.choice(["<h2", "<h3", "<h4", "<div"])), 0)
            for _ in range(rng.randint(1, 5)):
                add(text(*rng.choice([(1, 8), (3, 40)]), says=says), (*p, *rng.choice([("<p",), ("<ul", "<li"), ("<div",), ()])), 0, rng.choice([0.0, 0.9, 1.0]))
        elif kind == "notice":
            p = (*inside, "<div", *name(), *rng.sample(ROLES["notice"][0], rng.choice([1, 1, 2])))
            add(text(4, 40, says=says), (*p, *rng.choice([(), ("<p",)])), 0, rng.choice([0.0, 0.0, 0.3]))
            if rng.random() < 0.4:
                add(text(1, 2, False, says), (*p, "<button"), 0)
        elif kind == "form":
            for _ in range(rng.randint(1, 4)):
                add(text(1, 12, False, says), (*inside, "<form", *name(), *rng.choice([("<button",), ("<div",), ("<p",), ("<select", "<option"), ("<fieldset",), ("<fieldset", "<legend"), ()])), 0)
        elif kind == "header":
            p = part(inside, "header", "<header")
            for _ in range(rng.choice([1, 1, 2])):
                add(text(1, 8, False, says), (*p, *rng.choice([(), ("<h1",), ("<p",), ("<div",), ("<h2",)])), 0, rng.choice([0.0, 0.0, 1.0]))
        elif kind == "footer":
            p = part(inside, "footer", "<footer")
            for _ in range(rng.choice([1, 1, 2, 4])):
                add(rng.choice(["© ", "© 2024 ", "(c) ", "", ""]) + text(*rng.choice([(1, 3), (2, 30)]), says=says), (*p, *rng.choice([(), ("<p",), ("<div",), ("<ul", "<li")])), 0, rng.choice([0.0, 0.0, 0.5, 1.0]))
        else:
            p = (*inside, rng.choice(["<div", "<section", "<ol", "<ul"]), *name(), *rng.sample(ROLES["comments"][0], rng.choice([1, 1, 2])))
            if rng.random() < 0.4:
                add(text(1, 4, False, says), (*p, rng.choice(["<h2", "<h3"])), 0)
            for _ in range(rng.randint(1, 6)):
                q = (*p, *rng.choice([(), ("<div", "comment"), ("<li",), ("<article", "comment"), ("<div",)]))
                add(text(*rng.choice([(1, 5), (3, 60)]), says=says), (*q, *rng.choice([("<p",), (), ("<div", "body")])), 0)

    def content(body: tuple[str, ...]) -> None:
        kind = rng.random()
        lengths = rng.choice([(1, 3), (2, 12), (10, 80), (10, 80), (40, 160)])
        if rng.random() < 0.1:  # what words alone would take for furniture, or for nothing
            again = rng.choice(vocabulary)
            add(text(2, 12, True, ROLES[rng.choice(list(ROLES))][1]) if rng.random() < 0.6 else " ".join([again + rng.choice(["", "."])] * rng.randint(3, 60)), (*body, "<p"), 1)
        if kind < 0.52:
            add(text(*lengths), (*body, "<p", *(name() if rng.random() < 0.2 else ())), 1, rng.choice([0.0, 0.0, 0.0, 0.2, 0.5]))
        elif kind < 0.62:
            add(text(1, 10, rng.random() < 0.3), (*body, rng.choice(["<h2", "<h2", "<h3", "<h4"]), *(name() if rng.random() < 0.2 else ())), 1)
        elif kind < 0.75:
            p = (*body, rng.choice(["<ul", "<ol"]))
            for _ in range(rng.randint(1, 6)):
                add(text(*rng.choice([(1, 4), (2, 30)]), rng.random() < 0.5), (*p, "<li", *rng.choice([(), (), ("<p",)])), 1, rng.choice([0.0, 0.0, 0.3]))
        elif kind < 0.83:
            p = (*body, "<table", *name())
            if rng.random() < 0.3:
                add(text(2, 10, False), (*p, "<caption"), 1)
            p = (*p, *rng.choice([(), ("<tbody",), ("<thead",)]), "<tr")
            for _ in range(rng.randint(1, 12)):
                add(text(1, 5, False) if rng.random() < 0.7 else str(rng.randint(0, 99999)), (*p, rng.choice(["<td", "<td", "<td", "<th"])), 1)
        elif kind < 0.88:
            add(text(2, 25, rng.random() < 0.5), (*body, "<figure", *name(), *rng.choice([("<figcaption",), ("<figcaption",), ()])), 1)
        elif kind < 0.93:
            add(text(*lengths), (*body, rng.choice(["<blockquote", "<pre", "<blockquote"]), *rng.choice([(), ("<p",)])), 1)
        elif kind < 0.95:
            for _ in range(rng.randint(1, 4)):
                add(text(1, 4, False), (*body, "<dl", "<dt"), 1)
                add(text(3, 30), (*body, "<dl", "<dd"), 1)
        else:
            add(text(*lengths), (*body, rng.choice(["<div", "<div", "<section", "<center", "<details"]), *name()), 1)

    if rng.random() < 0.06:  # a scrap
        base = rng.choice([base, ()])
        for _ in range(rng.choice([1, 1, 2, 3])):
            add(text(*rng.choice([(1, 6), (5, 60)]), rng.random() < 0.7), (*base, *rng.choice([(), (), ("<p",), ("<p",), ("<div",)])), 1)
        return out
    if rng.random() < 0.9:
        add(text(2, 10), (("<html", "<head", "<title") if base[:1] == ("<html",) else ("<title",)), 0)
    kind = rng.random()
    bare = 0.68 <= kind < 0.86
    few = rng.choice([0, 0, 0, 1, 2, 4]) if bare else rng.choice([0, 0, 1, 1, 2, 3, 4])
    for _ in range(few):
        chrome(base)
    if kind < 0.3:
        body = (*base, "<article", *(name() if rng.random() < 0.5 else (rng.choice(CONTENT),)))
    elif kind < 0.47:
        body = (*base, "<main", *rng.choice([(), (rng.choice(CONTENT),)]), *rng.choice([(), (), ("<article",), ("<div", *name()), ("<section", *name())]))
    elif kind < 0.68:
        body = (*base, rng.choice(["<div", "<div", "<section"]), *name(), *rng.sample(CONTENT, rng.choice([1, 1, 2])), *rng.choice([(), (), ("<div", *name()), ("<div", rng.choice(CONTENT))]))
    elif bare:
        body = base
    elif kind < 0.95:
        body = (*base, "<table", *name(), *rng.choice([(), ("<tbody",)]), "<tr", "<td", *name())
        if rng.random() < 0.5:  # a column of links beside
            for _ in range(rng.randint(2, 8)):
                add(text(1, 3, False, ROLES["nav"][1]), body, 0, 1.0)
    else:  # furniture alone
        for _ in range(rng.randint(1, 4)):
            chrome(base)
        return out
    if rng.random() < 0.8:
        add(text(2, 14, rng.random() < 0.5), (*body, *rng.choice([(), (), (), ("<header", *rng.choice([(), (rng.choice(CONTENT), "header")]))]), rng.choice(["<h1", "<h1", "<h1", "<h2"]), *rng.choice([(), (), (rng.choice(CONTENT), "title"), ("title",), ("headline",)])), 1)
    elif bare and rng.random() < 0.5:
        add(text(*rng.choice([(1, 8), (8, 30), (20, 80)])), body, 1)
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 16])):
        content(body)
        if rng.random() < 0.07:
            chrome(body, ("ad", "aside", "notice", "form", "nav"))
    if rng.random() < 0.1:
        chrome(body, ("footer", "comments", "aside"))
    if "<td" in body and rng.random() < 0.4:  # a last row
        add(rng.choice(["© ", ""]) + text(2, 20, False, ROLES["footer"][1]), (*body[: body.index("<tr")], "<tr", "<td"), 0, rng.choice([0.0, 0.5]))
    for _ in range(few if bare else rng.choice([0, 0, 1, 1, 2, 3])):
        chrome(base)
    return out


@lru_cache(maxsize=1)
def trained(pages: int = 6000, epochs: int = 4, batch: int = 64, rate: float = 0.012, seed: int = 5) -> tuple[np.ndarray, ...]:
    """Weights after Adam on ``pages`` composed pages."""
    rng, make = random.Random(seed), Vectors()
    rows = []
    for _ in range(pages):
        page = example_page(rng)
        rows.append((*make.of([(t, p, a) for t, p, a, _ in page]), np.array([y for *_, y in page], np.float32)))
    net = BiLSTM(seed=seed)
    m, v, n = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w], 0
    steps = epochs * -(-pages // batch)
    for _ in range(epochs):
        order = sorted(range(pages), key=lambda k: (len(rows[k][2]) + rng.random() * 10))
        chunks = [order[a : a + batch] for a in range(0, pages, batch)]
        rng.shuffle(chunks)
        for chunk in chunks:
            x, mask = _padded([rows[k][0] for k in chunk])
            y = np.zeros(mask.shape, np.float32)
            for b, k in enumerate(chunk):
                y[: len(rows[k][2]), b] = rows[k][2]
            ids = [i for k in chunk for i in rows[k][1]]
            where = (np.array([t for k in chunk for t in range(len(rows[k][2]))]), np.array([b for b, k in enumerate(chunk) for _ in rows[k][2]]))
            counts = np.array([len(i) for i in ids])
            words = np.concatenate([np.array(i) for i in ids])
            sums = np.add.reduceat(net.w[8][words], np.cumsum(counts) - counts)
            x[where[0], where[1], PATH : PATH + WORDS] = sums / counts[:, None]
            n += 1
            grads, d_words = net.gradient(x, mask, y)
            table = np.zeros_like(net.w[8])
            np.add.at(table, words, np.repeat(d_words[where] / counts[:, None], counts, axis=0))
            now = rate * (1 - 0.9 * n / steps)
            for k, g in enumerate([*grads, table]):
                g = np.clip(g, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                net.w[k] -= now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
    return tuple(net.w)


def main_texts(pages: list[str | None], net: BiLSTM, make: Vectors, at_once: int = 4000) -> list[str]:
    """Article text of each page: its blocks with a probability of over a half, two line feeds between."""
    found = [blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    while order:
        chunk = [order.pop()]
        while order and len(chunk) < 64 and (len(chunk) + 1) * len(found[chunk[0]]) <= at_once:
            chunk.append(order.pop())
        x, mask = _padded([make.whole(found[k]) for k in chunk])
        p, _ = net.forward(x, mask)
        for b, k in enumerate(chunk):
            out[k] = "\n\n".join(t for (t, _, _), q in zip(found[k], p[:, b], strict=False) if q > 0.5)
    return out


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its id and url, ``text`` and ``n_chars`` (code points)."""
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, make = BiLSTM(list(sent.value)), Vectors(sent.value[8])
        for batch in batches:
            texts = []
            for a in range(0, len(batch), 256):
                texts += main_texts(batch["html"].iloc[a : a + 256].tolist(), net, make)
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)})

    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInPandas(read, f"page_id {kinds[id_col]}, url string, text string, n_chars long")
