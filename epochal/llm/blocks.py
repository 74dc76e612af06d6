"""Leaf blocks of a page and their features."""

from __future__ import annotations

import re
from html import unescape

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template textarea tfoot th thead tr ul canvas".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = BLOCK_TAGS - {"button", "option", "optgroup", "select"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(title)(?=[\s/>])[^>]*>[^<]*|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][a-z0-9:-]*+)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^<>]*\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def leaf_blocks(html: str) -> list[tuple[str, tuple[str, ...], int, int, str]]:
    """(text, ancestors, characters in links, characters, own tag) of each run of text between block boundaries.

    Ancestors are the open block tags and the words of their class, id and role attributes.  Unclosed
    paragraphs, items and cells end where the next begins; stray end tags are ignored.  Only comments, scripts,
    styles and the title are no text; what fallback elements (noscript, object, ...) hold are blocks like any other.
    """
    out: list[tuple[str, tuple[str, ...], int, int, str]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    run: list[str] = []
    linked, in_link = 0, False

    def text(raw: str) -> None:
        nonlocal linked
        raw = unescape(raw) if "&" in raw else raw
        run.append(raw)
        if in_link:
            linked += len(raw.strip())

    def flush() -> None:
        nonlocal linked
        words = " ".join("".join(run).split())
        if words:
            out.append((words, tuple(x for _, names in stack for x in names), linked, len(words), stack[-1][0] if stack else ""))
        run.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        tag = m[4] or m[7]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), (m[3] or m[6]) == "/", m[5] if m[4] else m[8]
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            run.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            in_link = False
            if closing:
                if any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
                continue
            if tag in _CLOSES_P and stack and stack[-1][0] == "p":
                stack.pop()
            if tag in _SIBLINGS:
                own, limit = _SIBLINGS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in limit:
                        break
                    if stack[k][0] in own:
                        del stack[k:]
                        break
            if tag not in _VOID and not attributes.endswith("/"):
                names = [f"<{tag}>"]
                for n in _NAMES.finditer(attributes):
                    names += [w.lower() for w in _PARTS.findall(n[1] or n[2] or n[3] or "")]
                stack.append((tag, tuple(names)))
    if at < len(html):
        text(html[at:])
    flush()
    return out


def features(blocks: list[tuple[str, tuple[str, ...], int, int, str]]) -> list[list[str]]:
    """Names of each block's features."""
    out = []
    for text, ancestors, linked, size, tag in blocks:
        words = text.count(" ") + 1
        share = linked / size if size else 0.0
        own = [
            "bias", f"tag={tag}", f"words={0 if words < 3 else 1 if words < 6 else 2 if words < 16 else 3 if words < 41 else 4}", f"links={0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3}",
            f"end={text[-1] in '.!?:;' if text else False}", f"inside={len(ancestors) > 0}",
        ]
        if "©" in text:
            own.append("copyright")
        own += [f"in={a}" for a in dict.fromkeys(ancestors)]
        out.append(own)
    return out
