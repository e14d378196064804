"""Main text of web pages from the distribution of text over lines.

Markup is stripped into lines, one for each block in page order, without scripts,
styles and comments of the markup. A line's length is that of its text outside
links, nothing if most of it is links. Lengths are summed over sliding windows of
``WINDOW`` lines:

* a region begins where a window is not empty and ends where a whole one is,
* it **surges** if a window reaches ``SURGE``, or the page's fullest window if none
  does, and its text runs from its first long line to its last, where it **dives**;
  a line is long from ``LONG`` characters on,
* the region with most text is kept, and others that hold a quarter as much.

What the markup says of a line, by element, role or class, breaks ties that length
leaves open, and no more: short lines just outside the surge and the dive stay if
they lie in an ``article`` or ``main`` or all else is boilerplate by name, and where
nothing is said only the last short line before the surge, a title, stays. Boilerplate
between two lines of text cuts a region in two, of which each has to hold its own;
but boilerplate without which no other region surges is taken for text, as then
the name says nothing.

Null and empty pages, and pages without text, give an empty text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import per_row

WINDOW = 3
SURGE = 80
LONG = 80
KEPT = 0.25  # of the fullest region's text

_RAW = "script|style|textarea|iframe|noscript|title"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{_RAW})\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# Elements of the markup language, by what they mean for a page's text.
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOISE = frozenset("nav footer aside form button dialog menu head select option optgroup datalist".split())
# What never is text, wherever it stands.
_HIDDEN = frozenset("head select option optgroup datalist svg math object template button".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr "
    "popup modal overlay sidebar widget widgets menu navbar nav navigation breadcrumb breadcrumbs masthead header footer comment comments "
    "reply replies disqus respond share sharing social related recommended newsletter subscribe subscription signup login search pagination "
    "pager toolbar skip".split()
)


# Words that say where a thing is on the page, not what it is.
_NEUTRAL = frozenset("site page main list area box bar block wrap wrapper container section left right top bottom buttons links".split())


def _named(value: str) -> bool:
    """Whether a class or id is a name of boilerplate: all its parts are, or only tell its place."""
    for token in value.split():
        parts = {p for p in re.split(r"[^a-z]+", token) if p}
        if parts & _WORDS and parts <= _WORDS | _NEUTRAL:
            return True
    return False


def _noisy(name: str, attributes: str, inside: int) -> bool:
    if name in ("html", "body", "main", "article"):
        return False
    if name in _NOISE or (name == "header" and not inside):
        return True
    for kind, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        kind, value = kind.lower(), "".join(values).lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            return True
        if kind == "role" and value in _ROLES:
            return True
        if kind in ("class", "id") and not (name == "header" and inside) and _named(value):
            return True
    return False


def lines(page: str) -> list[tuple[str, int, int]]:
    """``(text, characters outside links, mark)`` per block; the mark is 1 inside an article, -1 for boilerplate, else 0."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, bool]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    noise = inside = hidden = link = plain = at = 0

    def flush() -> None:
        nonlocal plain
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, plain, -1 if noise else int(inside > 0)))
        parts.clear()
        plain = 0

    def pop() -> None:
        nonlocal noise, inside, hidden
        name, noisy = stack.pop()
        opened[name] -= 1
        noise -= noisy
        inside -= name in ("article", "main")
        hidden -= name in _HIDDEN

    def say(text: str) -> None:
        nonlocal plain
        if text and not hidden:
            parts.append(text)
            if not link:
                plain += len(text.strip())

    for match in _TOKEN.finditer(page):
        say(page[at : match.start()])
        at = match.end()
        name = (match["name"] or "").lower()
        if not name:
            continue
        if name == "a":
            link = 0 if match["end"] else 1
        block = name not in _INLINE
        if block:
            flush()
            link = 0
        if match["end"]:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name not in _VOID:
            noisy = _noisy(name, match["attributes"], inside)
            # A paragraph ends where the next block begins, an option with the next one; so do those that were never closed.
            while block and stack and (stack[-1][0] == "p" or stack[-1][0] == name == "option"):
                pop()
            if not match["attributes"].endswith("/"):
                if noisy and not block:
                    flush()
                stack.append((name, noisy))
                opened[name] += 1
                noise += noisy
                inside += name in ("article", "main")
                hidden += name in _HIDDEN
    say(page[at:])
    flush()
    return out


def _regions(lengths: list[int]) -> list[tuple[int, int, int, int]]:
    """``(fullest window, text, first line, last line)`` of each stretch without an empty window."""
    windows = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    regions, start = [], None
    for i, total in enumerate([*windows, 0]):
        if total and start is None:
            start = i
        elif not total and start is not None:
            inner = [k for k in range(start, i) if lengths[k]]
            regions.append((max(windows[start:i]), sum(lengths[start:i]), inner[0], inner[-1]))
            start = None
    return regions


def _chosen(found: list[tuple[str, int, int]], marks: list[int]) -> list[int]:
    """The lines between surge and dive of the regions that are kept."""
    lengths = [n if 2 * n >= len(text) else 0 for text, n, _ in found]
    # Boilerplate cuts regions: each stretch of lines is measured by itself.
    stretches: list[list[int]] = []
    for k, mark in enumerate(marks):
        if mark >= 0:
            if not stretches or stretches[-1][-1] != k - 1:
                stretches.append([])
            stretches[-1].append(k)
    regions = [(peak, text, s[a], s[b], s) for s in stretches for peak, text, a, b in _regions([lengths[k] for k in s])]
    if not regions:
        return []
    surge, most = min(SURGE, max(r[0] for r in regions)), max(r[1] for r in regions)
    # Inside an article even a region that does not surge is a tie.
    kept = [r for r in regions if (r[0] >= surge and r[1] >= KEPT * most) or any(marks[k] > 0 for k in range(r[2], r[3] + 1))]
    told = any(m < 0 for m in marks) and not any(m > 0 for m in marks)
    out: list[int] = []
    for _, text, first, last, stretch in kept:
        inner = range(first, last + 1)
        long = [k for k in inner if lengths[k] >= LONG]
        if told or 2 * sum(lengths[k] for k in long) < text:
            # All boilerplate is named, or the region lives on short lines: nothing tells its edges apart from it.
            long = [first, last]
        lead = [k for k in stretch if k < long[0] and marks[k] > 0]
        if not lead and long[0] > first and lengths[long[0] - 1]:
            lead = [long[0] - 1]
        out += lead + list(range(long[0], long[-1] + 1)) + [k for k in stretch if k > long[-1] and marks[k] > 0]
    return sorted(set(out))


def main_text(page: str | None, marked: bool = True) -> str:
    """The page's text between surge and dive; ``marked`` false leaves all that the markup says unused."""
    found = lines(page or "")
    marks = [m if marked else 0 for *_, m in found]
    chosen = _chosen(found, marks)
    if any(m < 0 for m in marks) and not any(m > 0 for m in marks):
        # No article is marked, and what is not boilerplate does not surge.
        fullest = max((r[0] for r in _regions([found[k][1] for k in chosen])), default=0)
        if fullest < SURGE:
            bare = _chosen(found, [0] * len(found))
            if max((r[0] for r in _regions([found[k][1] for k in bare])), default=0) >= SURGE:
                chosen = bare
    return "\n".join(found[k][0] for k in chosen)


def _extract(pages: pa.Array) -> pa.StructArray:
    texts = [main_text(page) for page in pages.to_pylist()]
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["text", "n_chars"])


def extract(pages: DataFrame, column: str = "html", out: str = "main") -> DataFrame:
    """``pages`` with the struct ``out`` of ``text`` and ``n_chars``; one row per page, repeated ones too.

    Other columns stay, but for one named ``out``. An empty table gives no rows.
    """
    return per_row(pages, column, _extract, "text string, n_chars long", out)
