"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is the sequence of its leaf blocks (blocks.py); each has a label, main text or not, a score linear
in its features (ancestor tags, words of their class, id and role, and the block's own text) and in the
pair of neighbouring labels.  Weights maximise the conditional likelihood of labelled pages (gradient
steps on exact forward-backward sums) and pages are decoded by Viterbi.

The labelled pages are made by a seeded generator from common page layouts, as no table labels blocks:
PAGES of them, a documented bound.  Training takes a few seconds on the driver, once a process.

Defined results: a null or empty html, and a page without main text, has the text ``''``; white space in a
block is one space, <br> included; main blocks are joined by one line feed; null and repeated page_ids
are carried through row by row; an empty table gives an empty table; a page of any length is one sequence,
decoded in time and memory in proportion to it; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.llm.blocks import features, leaf_blocks
from epochal.llm.work import small_batches

PAGES, STEPS, SEED = 1800, 250, 3


# labelled pages ------------------------------------------------------------------------------------

_MAIN = [("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article body"), ("div", "post content"), ("div", "entry content"), ("section", "story"), ("div", "main text"), ("div", "page body"), ("section", "article")]
_OTHER = {  # kind: (tags, names)
    "menu": (["nav", "ul", "div"], ["", "menu", "nav bar", "navigation", "main menu", "breadcrumb", "toolbar", "tabs", "pagination"]),
    "header": (["header", "div"], ["", "header", "masthead", "site header", "top bar", "logo", "branding"]),
    "footer": (["footer", "div"], ["", "footer", "site footer", "copyright", "legal", "bottom"]),
    "side": (["aside", "div"], ["", "sidebar", "side", "related", "widget", "recommended", "popular", "trending", "share", "social", "tags", "author"]),
    "notice": (["div", "section", "dialog", "noscript"], ["cookie notice", "notice", "cookie banner", "consent", "alert", "gdpr", "newsletter", "modal", "popup", "subscribe", "banner", "disclaimer", "message"]),
    "advert": (["div", "aside", "section", "iframe", "object"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad slot", "banner ad", "commercial"]),
    "form": (["form", "fieldset"], ["", "search", "login", "signup", "contact"]),
    "comments": (["section", "div", "ol"], ["comments", "comment list", "discussion", "replies", "responses", "user comments", "disqus thread", "reader comments"]),
}
_CUES = "home about contact login search share more next previous subscribe follow terms privacy sitemap".split()


def _words(random: np.random.Generator, n: int) -> str:
    letters = "eeeeaaaiioonnnrrrttsslldcumphgbfvyw"
    return " ".join("".join(letters[i] for i in random.integers(0, len(letters), random.integers(1, 12))) for _ in range(n))


def _sentence(random: np.random.Generator, most: int) -> str:
    n = int(random.integers(1, most + 1))
    return _words(random, n).capitalize() + str(random.choice([".", ".", ".", "?", "!", "", ":"]))


def labelled_page(random: np.random.Generator) -> tuple[str, list[str]]:
    """A page in one of many layouts, and the words (marks) that stand in its main text only."""
    marks: list[str] = []

    def named(tag: str, name: str, inner: str) -> str:
        if name:
            name = str(random.choice([name, name.replace(" ", "-"), name.replace(" ", "_"), name.title().replace(" ", "")]))
        attribute = f' {random.choice(["class", "id", "class"])}="{name}"' if name else ""
        return f"<{tag}{attribute}>{inner}" + (f"</{tag}>" if random.random() < 0.97 else "")

    def text(main: bool, most: int) -> str:
        out = " ".join(_sentence(random, most) for _ in range(int(random.integers(1, 5))))
        if main:
            marks.append(mark := f"qz{len(marks)}zq")
            out = mark if random.random() < 0.12 else f"{mark} {out}"  # paragraphs of one word are main text too
        if random.random() < 0.2:
            out = f"<b>{out}" + ("</b>" if random.random() < 0.7 else "")
        if random.random() < 0.15:
            out += f' <a href="/x">{_words(random, 2)}</a>'
        return out + ("<br>" if random.random() < 0.1 else "")

    def links(n: int) -> str:
        item = lambda: f'<a href="/{_words(random, 1)}">{random.choice(_CUES) if random.random() < 0.3 else _words(random, int(random.integers(1, 4)))}</a>'
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>" if random.random() < 0.7 else " ".join(item() for _ in range(n))

    def other(kind: str) -> str:
        tags, names = _OTHER[kind]
        tag, name = str(random.choice(tags)), str(random.choice(names))
        if tag == "div" and not name:
            name = names[-1]
        if kind == "menu":
            return named(tag, name, links(int(random.integers(2, 9))))
        if kind == "form":
            field = "<input name=q>" if random.random() < 0.7 else f"<textarea>{_words(random, 3)}</textarea>"
            return named(tag, name, f"<label>{_words(random, 2)}</label>{field}<button>{random.choice(_CUES)}</button>")
        if kind == "footer":
            return named(tag, name, random.choice(["&copy; ", "", "(c) "]) + _words(random, 2) + " &middot; " + text(False, 8))
        if kind == "comments":
            bare = random.random() < 0.4
            one = lambda: f"<p>{text(False, 20)}</p>" if bare else named(str(random.choice(["div", "li", "article"])), "comment", f"<p>{text(False, 20)}</p>")
            return named(tag, name, (f"<h3>{_words(random, 1)}</h3>" if random.random() < 0.6 else "") + "".join(one() for _ in range(int(random.integers(1, 5)))))
        if kind == "side":
            return named(tag, name, f"<h3>{_words(random, 2)}</h3>" + (links(4) if random.random() < 0.5 else f"<p>{text(False, 12)}</p>"))
        if kind == "header":
            return named(tag, name, f"<h1>{_words(random, 2)}</h1>" if random.random() < 0.3 else _words(random, 3))
        return named(tag, name, text(False, 14) if random.random() < 0.6 else f"<p>{text(False, 14)}</p>")

    def main() -> str:
        tag, name = _MAIN[random.integers(len(_MAIN))]
        parts = [f"<h1>{text(True, 8)}</h1>"] if random.random() < 0.8 else []
        for _ in range(int(random.integers(0, 12))):
            kind = random.random()
            if kind < 0.75:
                parts.append(f"<p>{text(True, 25)}" + ("</p>" if random.random() < 0.9 else ""))
            elif kind < 0.82:
                parts.append(f"<h{random.integers(2, 5)}>{text(True, 5)}</h2>")
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li>{text(True, 8)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{text(True, 20)}</blockquote>")
            elif kind < 0.92:
                parts.append(f"<table><tr><td>{text(True, 3)}</td><td>{text(True, 3)}</td></tr></table>")
            elif kind < 0.94:
                shown = str(random.choice(["svg", "canvas", "object", "template", "noscript"]))
                parts.append(f"<{shown}>{_words(random, 3)}</{shown}>")
            else:
                parts.append(other(str(random.choice(["advert", "side", "notice", "form"]))))
        inner = "".join(parts)
        if random.random() < 0.25:
            inner = f"<div>{inner}</div>"
        if random.random() < 0.15:
            inner += other("comments")
        place = random.random()
        return inner if place < 0.12 else f"<div>{inner}</div>" if place < 0.2 else named(tag, name, inner)

    # anything may stand before and after the article, or nothing; some pages are a text without any element around it
    around = lambda kinds: [other(k) for k in kinds if random.random() < share] if (share := float(random.choice([0.0, 0.15, 0.5, 0.5]))) else []
    before = around(("header", "menu", "notice", "advert", "form", "side", "menu"))
    after = around(("comments", "side", "advert", "notice", "form", "menu", "footer"))
    if random.random() < 0.06:
        plain = text(True, 25)
        return random.choice([plain, f"<body>{plain}</body>", f"<html><head><title>{_words(random, 2)}</title></head><body>{plain}"]), marks
    return f"<!DOCTYPE html><html><head><title>{_words(random, 3)}</title></head><body>{''.join(before)}{main()}{''.join(after)}</body></html>", marks


# the field ---------------------------------------------------------------------------------------------


def _fit(pages: list[tuple[list[list[str]], np.ndarray]]) -> tuple[dict[str, float], np.ndarray]:
    """Weights of the main label's features and of pairs of labels (2 x 2)."""
    names = {n: i for i, n in enumerate(sorted({f for blocks, _ in pages for b in blocks for f in b}))}
    rows = [(p, t, names[f]) for p, (blocks, _) in enumerate(pages) for t, b in enumerate(blocks) for f in b]
    p, t, f = np.array(rows).T
    longest = max(len(b) for b, _ in pages)
    cell = p * longest + t
    label, real = np.zeros((len(pages), longest)), np.zeros((len(pages), longest))
    for i, (_, y) in enumerate(pages):
        label[i, : len(y)], real[i, : len(y)] = y, 1
    both = real[:, 1:] * real[:, :-1]
    seen = np.array([[(both * (label[:, :-1] == a) * (label[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    w, pair = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros(len(names)), np.zeros(len(names)), np.zeros((2, 2)), np.zeros((2, 2))]
    blocks = real.sum()
    for step in range(1, STEPS + 1):
        score = np.zeros((len(pages), longest, 2))
        score[:, :, 1] = np.bincount(cell, weights=w[f], minlength=len(pages) * longest).reshape(len(pages), longest)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for k in range(1, longest):
            own = np.logaddexp.reduce(forward[:, k - 1, :, None] + pair, axis=1) + score[:, k]
            forward[:, k] = np.where(real[:, k, None] > 0, own, forward[:, k - 1])
        for k in range(longest - 2, -1, -1):
            own = np.logaddexp.reduce(pair + (score[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
            backward[:, k] = np.where(real[:, k + 1, None] > 0, own, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * real
        joint = np.exp(forward[:, :-1, :, None] + pair + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        grads = (np.bincount(f, weights=(label - chance).ravel()[cell], minlength=len(names)) / blocks - 1e-5 * w, (seen - joint.sum(axis=(0, 1))) / blocks - 1e-5 * pair)
        for k, (x, g) in enumerate(zip((w, pair), grads, strict=True)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {n: float(w[i]) for n, i in names.items()}, pair


@lru_cache(maxsize=2)
def train(pages: int = PAGES, seed: int = SEED) -> tuple[dict[str, float], np.ndarray]:
    random = np.random.default_rng(seed)
    made = []
    for _ in range(pages):
        html, marks = labelled_page(random)
        blocks = leaf_blocks(html)
        known = set(marks)
        if blocks:
            made.append((features(blocks), np.array([float(bool(known & set(b[0].split()))) for b in blocks])))
    return _fit(made)


def decode(blocks: list, weights: dict[str, float], pair: np.ndarray) -> list[bool]:
    """Viterbi: is each block main text?"""
    (p00, p01), (p10, p11) = pair.tolist()
    back, a, b = [], 0.0, 0.0
    for k, own in enumerate(features(blocks)):
        score = sum(weights.get(f, 0.0) for f in own)
        if k == 0:
            a, b = 0.0, score
        else:
            back.append((a + p00 < b + p10, a + p01 < b + p11))
            a, b = max(a + p00, b + p10), max(a + p01, b + p11) + score
    label = a < b
    out = [label]
    for from_main in reversed(back):
        label = from_main[label]
        out.append(label)
    return out[::-1] if blocks else []


def main_text(html: str | None, weights: dict[str, float], pair: np.ndarray) -> str:
    blocks = leaf_blocks(html or "")
    return "\n".join(b[0] for b, main in zip(blocks, decode(blocks, weights, pair), strict=True) if main)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page."""
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(train())  # a weight for each feature of the labelled pages

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, pair = sent.value
        for batch in batches:
            found = [main_text(html.as_py(), weights, pair) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(work, "page_id long, url string, text string, n_chars long")
