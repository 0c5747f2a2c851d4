"""Main text of HTML pages by line-block distribution.

Markup is stripped so that each block element is a line. Lengths of text outside links are summed
over a sliding window of lines; where the sum surges a region begins, where it dives to nothing the
region ends, and the text between is kept, also its short lines. So a list of links, wherever it
stands, is a dive, and a lone link between paragraphs is not.

Elements that can't be the article have no lines: boilerplate by tag or role (menus, footers,
sidebars, forms), by class or id (all parts of a word of it tell of boilerplate, as in ``site-footer``
but not in ``ad-hoc``), reader comments, scripts, styles, markup comments. Where only one of several
words of a class does, the lines decide: the element goes if a third of its text is links or if it has
fewer than ``3 * SURGE`` characters.

If a page marks its article (``article``, ``main``, a main role, an item property or a whole class or
id, on an element that isn't boilerplate), the scan looks only there, and any text
outside links is a surge. If what is marked has fewer than ``SURGE`` characters or is mostly links, and the lines of the
page as if unmarked give more text than it has outside links, they are taken. In an unmarked page a
line that is mostly links, or a copyright notice, has no length.

Defined cases: a null or empty page, or one without text, gives an empty text; unclosed and
misnested elements end with their parent; unknown character references stay as they are; rows are
independent, so repeated rows, ties and other columns don't matter; an empty table gives an empty
result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import tidied

#: Lines of a window, and the characters in it at which a region begins; in an article that is marked
#: any text outside links is a surge, and the dives decide.
WINDOW, SURGE, MARKED = 3, 60, 1

# Elements of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select option datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
_CLOSES_P = _BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "title"}
_DROPPED = _RAW | frozenset("head nav aside footer form button dialog menu audio video canvas object search".split())
# Words of class, id and role that tell what an element is for, and words that say nothing of it.
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr menu modal masthead nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promos promotion related share sharing sidebar skiplink social sponsor "
    "sponsored sponsors subscribe tags toolbar widget widgets complementary contentinfo search copyright".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus replies respond responses".split())
_NEUTRAL = frozenset(
    "a and area bar block body bottom box btn button buttons col cols column container content form global group head header icon icons inner item items "
    "label left link links list main outer page panel primary right row secondary section signup site skip slot text the title to top unit user reader "
    "readers visitor customer wrap wrapper".split()
)
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td th dd dt figcaption caption span em strong b i a code q cite".split())
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
_MAIN = frozenset("main article articlebody article-body post-body postbody entry-content post-content main-content maincontent".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([a-zA-Z:_-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)")
_HIDDEN = re.compile(r"\shidden(?=[\s>=/])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def _kind(word: str) -> str:
    """What a word of class, id or role tells: noise, comments, or nothing."""
    parts = {p.rstrip("0123456789") for p in re.split(r"[-_]+", word)} - {""} - _NEUTRAL
    if parts and parts <= _COMMENTS | _NOISE:
        return "noise" if parts <= _NOISE else "comments"
    return ""


def _role(name: str, tag: str) -> tuple[bool, bool, bool]:
    """Whether an element is noise, may be, or marks the article, by its name and attributes."""
    if "=" not in tag and " hidden" not in tag:
        return False, False, name in ("article", "main")
    values = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(tag)}
    words = " ".join(values.get(k, "") for k in ("class", "id", "role")).split()
    sure = name == "main" or "main" in values.get("role", "").split() or "articlebody" in values.get("itemprop", "").split()
    main = sure or name == "article" or not _MAIN.isdisjoint(x.replace("_", "-") for x in words)
    kinds = {k for k in map(_kind, words)} if not sure else set()
    hidden = bool(_HIDDEN.search(tag))
    if name == "article":  # an article can have comments, and be called so
        kinds = {_kind(words[0])} if words else set()
    some = kinds - {""}
    noise = "comments" in some or bool(some) and (len(kinds) == 1 or not (main or name in _TEXTUAL) and any(k and "-" in w for w, k in zip(words, map(_kind, words))))
    return noise or hidden, bool(some), main


def lines_of(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, characters within links, in the article) of each line with text, and whether the
    page marks its article."""
    out: list[tuple[str, int, bool, int]] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, dropped, in the article, number of what may be noise
    parts: list[str] = []
    linked, marked, links, at, doubtful = 0, False, 0, 0, 0

    def end_line() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, min(linked, len(text)), bool(stack) and stack[-1][2], stack[-1][3] if stack else 0))
            parts, linked = [], 0

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not (stack and stack[-1][1]):
            parts.append(page[at:stop])
            linked += links and len(page[at:stop].strip())
        if not m:
            break
        at, tag = m.end(), m.group()
        if tag[1] in "!?":
            continue
        name = _NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if name in _BLOCK or name in _RAW:
                end_line()
            if any(x[0] == name for x in stack):
                while True:
                    gone = stack.pop()
                    links -= gone[0] == "a"
                    if gone[0] == name:
                        break
            elif name == "p":
                end_line()
            continue
        if name == "br":
            parts.append("\n") if not (stack and stack[-1][1]) else None
            continue
        if name in _BLOCK:
            end_line()
            if name in _CLOSES_P:  # a new block ends an open paragraph, with what is open in it
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        links -= sum(x[0] == "a" for x in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][0] in _BLOCK:
                        break
            if name in ("li", "dd", "dt", "tr", "td", "th") and stack and stack[-1][0] == name:
                stack.pop()
        if name in _VOID:
            continue
        noise, doubt, main = _role(name, tag)
        dropped, inside, of = stack[-1][1:] if stack else (False, False, 0)
        if doubt and not of and not main and name not in _TEXTUAL and name not in ("html", "body"):
            doubtful += 1
            of = doubtful
        header = name == "header" and not inside
        dropped = dropped or name in _DROPPED or noise or header
        if name in ("html", "body"):
            dropped = False
        if main and not dropped and name not in ("html", "body"):
            marked = inside = True
        if name in _RAW and name not in ("noscript", "select", "option", "datalist", "svg", "math", "template"):
            close = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        links += name == "a"
        stack.append((name, dropped, inside, of))
    end_line()
    sums = {k: (sum(len(t) for t, _, _, of in out if of == k), sum(n for _, n, _, of in out if of == k)) for k in {x[3] for x in out} - {0}}
    gone = {k for k, (size, within) in sums.items() if 3 * within >= size or size < 3 * SURGE}
    return [x[:3] for x in out if x[3] not in gone], marked


def regions(lines: list[tuple[str, int, bool]], size: list[int], surge: int, whole: bool) -> list[str]:
    """The lines from each surge to the next dive; ``whole``: also those in it that have no size."""
    kept: list[str] = []
    n, k = len(lines), 0
    while k < n:
        if size[k] and sum(size[k : k + WINDOW]) >= surge:
            while k < n and sum(size[k : k + WINDOW]):  # until the dive
                if size[k] or whole:
                    kept.append(lines[k][0])
                k += 1
        else:
            k += 1
    return kept


def main_text(page: str | None) -> str:
    """The article: the lines between each surge and the next dive, joined by two line breaks."""
    lines, marked = lines_of(page or "")
    kept: list[str] = []
    if marked:
        inside = [x for x in lines if x[2]]
        size = [len(t) - linked for t, linked, _ in inside]
        whole, own = sum(len(t) for t, _, _ in inside), sum(size)
        kept = regions(inside, size, MARKED, True)
    if not marked or own < SURGE or 2 * own < whole:
        plain = regions(lines, [len(t) if 2 * linked <= len(t) and not _COPYRIGHT.match(t) else 0 for t, linked, _ in lines], SURGE, False)
        if not marked or sum(map(len, plain)) > own:
            kept = plain
    return "\n\n".join(kept)


def extract(page: Column | str) -> Column:
    """The main text of a column of pages."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(p) for p in part], dtype=object)

    return F.pandas_udf(tidied(run), "string")(page)
