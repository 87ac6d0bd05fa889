"""HTML extraction by line-block distribution.

The markup is stripped first: the page becomes a list of lines, one for every
block-level element's own text (inline elements and line breaks don't end a
line). Scripts, styles, forms and comments leave no text; menus, page
headers, footers, sidebars, notices, adverts and reader comments, known by
their element or by the words of their class, id or role, leave empty lines,
but none where they stand inside an article: in a marked one (``article`` or
``main``), or beside text of their own parent. An element that holds most of
the article, or most of the text of an unmarked page, is no noise. Lines that
are mostly links are empty too, except in a marked article and where one or
two of them stand between lines of text.

Then the lengths of the lines are summed over sliding windows of WINDOW
lines. The text surges where such a sum reaches SURGE characters after
emptiness and dives where the next window is empty; every stretch between a
surge and its dive is kept, with the short lines at its ends that the
windows touch. If no sum reaches SURGE, the longest stretch is kept (a short
article).

The mark of an article is a prior for the stretches: one that holds marked
lines gives these alone; one that holds none is kept if it is longer than all
marked text that surges (the marks are on teasers then). If no marked stretch
surges, the longest of them is kept as well.

Kept lines are joined by an empty line. Character references are decoded,
white space inside a line becomes one space.

Edge cases: null and empty pages, and pages without text, give the empty
text; an element that is never closed ends where its parent does, a noise
element that is never closed at the next block; broken tags and stray ``<``
are text or skipped, never an error; pages of any length are read whole;
repeated rows and extra columns are kept, but one that has the name of the
output column is replaced.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

WINDOW = 3
SURGE = 60
LINK_SHARE = 0.6

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
                    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>", re.S)
_ATTR = re.compile(r"(class|id|role|aria-label|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/>]|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements whose content is never text of the article.
_RAW = frozenset("script style textarea title noscript template iframe noframes noembed xmp".split())
_NEVER = frozenset("form nav footer aside select button svg canvas object audio video dialog menu fieldset label datalist head".split())
_BLOCK = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption head").split())
_SPACE = frozenset("br td th wbr img input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset("article main".split())
_CONTROLS = frozenset("button label".split())
#: Words of a class, id or role that mark an element as noise.
NOISE_WORDS = frozenset(("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
                         "menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead sidebar rail widget widgets aside "
                         "footer foot header cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog "
                         "newsletter subscribe subscription signup login register search paywall share sharing social follow "
                         "comment comments reply replies disqus respond discussion related recommended recommendations "
                         "pagination pager copyright legal disclaimer complementary contentinfo").split())


#: What a class says of the layout around an element's content, not of the content: has-sidebar.
_LAYOUT_WORDS = frozenset("has with no without".split())
#: Words that are part of an article where its own names begin with these (entry-header), inside its mark, or on an element of running text.
_ARTICLE_WORDS = frozenset("entry article post story".split())
_OF_ARTICLES = frozenset("header notice notices alert discussion legal".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li".split())
_COMMENT_WORDS = frozenset("comment comments reply replies disqus respond".split())
MOST = 0.5               # of the text: an element with more of it is no noise,
MOST_COMMENTS = 0.9      # and with the words of reader comments only with more than this


#: Words that say what shape an element has; a name of these and noise words is noise through and through.
_SHAPE_WORDS = frozenset(("top bottom left right inner outer main box slot block list links buttons button bar area section container wrapper wrap "
                          "content group item items posts articles stories unit").split())
#: Noise words that also mark elements of running text, outside a marked article.
_STRONG_WORDS = frozenset(("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr "
                           "newsletter paywall popup disqus").split())
_SENTENCE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())


class Line(NamedTuple):
    text: str
    links: int   # characters of it inside links
    main: bool   # inside article or main
    para: bool = False  # a paragraph


def _noise_words(value: str, name: str, inside_main: bool) -> set[str]:
    found: set[str] = set()
    for part in value.split():
        words = [w.lower() for w in _WORD.findall(part)]
        if not words or words[0] in _LAYOUT_WORDS:
            continue
        bad = NOISE_WORDS.intersection(words)
        if inside_main:
            whole = name not in _TEXT and all(w in NOISE_WORDS or w in _SHAPE_WORDS for w in words)
            found |= bad - _OF_ARTICLES if whole else set()
        elif name in _TEXT:
            found |= bad & _STRONG_WORDS
        else:
            found |= bad - _OF_ARTICLES if words[0] in _ARTICLE_WORDS else bad
    return found


def _noisy(name: str, attrs: str, inside_main: bool) -> str:
    """Why an element is noise: "hidden", "element", "form", "words", "comments"; "" if it isn't."""
    if name in _NEVER:
        return "form" if name == "form" else "element"
    if name == "header":
        return "" if inside_main else "element"
    if not attrs or name in ("body", "html", *_MAIN):
        return ""
    words: set[str] = set()
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return "hidden"
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "hidden"
        elif key != "itemprop":
            words |= _noise_words(value, name, inside_main)
    return "comments" if words & _COMMENT_WORDS else "words" if words else ""


class _Sizes:
    """Characters of text before each token: of the marked article, if the
    page has one with text, else of all that is no menu, footer or the like."""

    def __init__(self, tokens: list[tuple[str, str, str]], closed: dict[int, int]):
        marked, plain = [0], [0]
        main_until = never_until = -1
        for k, (kind, x, _) in enumerate(tokens):
            size = 0
            if kind == "text":
                size = len(x.strip())
            elif kind == "open" and k in closed:
                if x in _MAIN:
                    main_until = max(main_until, closed[k])
                elif x in _NEVER and x != "form":
                    never_until = max(never_until, closed[k])
            marked.append(marked[-1] + (size if k < main_until else 0))
            plain.append(plain[-1] + (size if k >= never_until else 0))
        self.marked = marked[-1] > 0
        self.before = marked if self.marked else plain

    def holds_article(self, why: str, start: int, end: int, inside_main: bool) -> bool:
        """Whether the element from token ``start`` to ``end``, noise by ``why``, is where the article is."""
        size, total = self.before[end] - self.before[start], self.before[-1]
        if why == "hidden" or size <= (MOST_COMMENTS if why == "comments" else MOST) * total:
            return False
        if self.marked and not inside_main:  # it holds the mark
            return True
        # small forms and adverts can be all the text of a page without an article
        return why != "element" and size >= (SURGE if why == "form" else 4 * SURGE)


def _tidy(raw: str) -> str:
    return " ".join((_html.unescape(raw) if "&" in raw else raw).split())


def _ends(page: str, at: int, name: str) -> int:
    """Where a raw-text element's content ends."""
    found = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
    return found.start() if found else len(page)


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "")."""
    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            yield "text", page[at:], ""
            return
        if found.start() > at:
            yield "text", page[at : found.start()], ""
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if found["end"]:
            yield "close", name, ""
            continue
        if name in _RAW and not found["attrs"].endswith("/"):
            at = _ends(page, at, name)
            continue
        yield "open", name, found["attrs"]
        if name in _VOID or found["attrs"].endswith("/") and name not in _BLOCK:
            yield "close", name, ""


def lines(page: str) -> list[Line]:
    """The page as lines; noise is an empty line."""
    tokens = list(_tokens(page))
    closed = _matched(tokens)
    ends = set(closed.values())
    out: list[Line] = []
    parts: list[str] = []
    links: list[str] = []
    sizes = _Sizes(tokens, closed)
    stack: list[tuple[str, bool, bool, int]] = []  # name, noise begins here, main begins here, position
    noise = main = link = 0
    until_block = False  # inside a noise element that is never closed
    with_text: set[int] = set()  # elements with a line of text of their own or of a child
    within = False  # the noise stands inside an article

    def end_line() -> None:
        text = _tidy("".join(parts))
        # markup alone makes one empty line, every noise block outside an article one more
        if text or noise and not within or not out or out[-1].text:
            inner = blocks()
            out.append(Line(text, len(_tidy("".join(links))) if links else 0, main > 0, inner[0] >= 0 and tokens[inner[0]][1] in _SENTENCE))
            if text:
                with_text.update(inner)
        parts.clear()
        links.clear()

    def blocks() -> list[int]:
        """The innermost three open blocks, the third only below the body."""
        found = []
        for name, _, _, at in reversed(stack):
            if name in _BLOCK and (len(found) < 2 or name not in ("html", "body")):
                found.append(at)
                if len(found) == 3:
                    return found
        return [*found, -1] if len(found) < 2 else found

    def in_sentence(k: int) -> bool:
        """Whether the element at token k stands in a paragraph with text beside it."""
        inner = blocks()[0]
        if inner < 0 or tokens[inner][1] not in _SENTENCE or k not in closed:
            return False
        after = tokens[closed[k] + 1] if closed[k] + 1 < len(tokens) else ("", "", "")
        return any(x.strip() for x in parts) or after[0] == "text" and bool(after[1].strip())

    for k, (kind, x, attrs) in enumerate(tokens):
        if kind == "text":
            if not noise and not until_block:
                parts.append(x)
                if link:
                    links.append(x)
            continue
        if x in _BLOCK:
            end_line()
            until_block = False
        elif x in _SPACE:
            parts.append(" ")
        if kind == "open" and x not in _VOID:
            bad = _noisy(x, attrs, main > 0)
            if bad and not noise and x in _CONTROLS and in_sentence(k):
                bad = ""
            if bad and not noise and k in closed and sizes.holds_article(bad, k, closed[k], main > 0):
                bad = ""
            if bad and k not in closed:
                bad, until_block = "", True
            if bad and not noise:
                within = main > 0 or blocks()[0] in with_text
            begins = x in _MAIN and not noise
            if k in closed:
                stack.append((x, bool(bad), begins, k))
                noise, main, link = noise + bool(bad), main + begins, link + (x == "a")
        elif kind == "close":
            if k in ends:  # closes the element it was matched with, and what is open inside
                while stack:
                    name, bad, begins, _ = stack.pop()
                    noise, main, link = noise - bad, main - begins, link - (name == "a")
                    if name == x:
                        break
    end_line()
    return out


def _matched(tokens: list[tuple[str, str, str]]) -> dict[int, int]:
    """Positions of opening tags and of their closing tags. A closing
    tag closes the nearest open element of its name; elements opened inside
    it and not closed are unmatched."""
    found: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    counts: dict[str, int] = {}
    for k, (kind, x, _) in enumerate(tokens):
        if kind == "open" and x not in _VOID:
            open_.append((x, k))
            counts[x] = counts.get(x, 0) + 1
        elif kind == "close" and counts.get(x):
            while True:
                name, at = open_.pop()
                counts[name] -= 1
                if name == x:
                    found[at] = k
                    break
    return found


def _stretches(lengths: list[int]) -> list[tuple[int, int, int, bool]]:
    """(start, end, characters, whether a sum surges) of all stretches of
    ``lengths`` that end in a dive of the sums over sliding windows."""
    n = len(lengths)
    total = [0]
    for x in lengths:
        total.append(total[-1] + x)
    sums = [total[min(n, i + WINDOW)] - total[i] for i in range(n)]
    found, i = [], 0
    while i < n:
        if not lengths[i]:
            i += 1
            continue
        j, surged = i, False
        while j < n and sums[j]:  # until the dive: the next window is empty
            surged |= sums[j] >= SURGE
            j += 1
        found.append((i, j, total[j] - total[i], surged))
        i = j
    return found


def stretches(lengths: list[int]) -> list[tuple[int, int]]:
    """[start, end) of the stretches between surges and dives of the sums of
    ``lengths`` over sliding windows; the longest, if no sum surges."""
    found = _stretches(lengths)
    return [x[:2] for x in found if x[3]] or [x[:2] for x in sorted(found, key=lambda x: -x[2])[:1]]


def _marked_lines(rows: list[Line], lengths: list[int]) -> list[int]:
    """Positions of the lines kept of a page that marks an article."""
    found = _stretches(lengths)
    inside = [[i for i in range(start, end) if rows[i].main and lengths[i]] for start, end, _, _ in found]
    sizes = [sum(lengths[i] for i in at) for at in inside]
    kept = {k for k, x in enumerate(found) if inside[k] and x[3]}
    marked = sum(sizes[k] for k in kept)
    if not kept:
        kept = {max(range(len(found)), key=lambda k: sizes[k])}
    kept |= {k for k, x in enumerate(found) if not inside[k] and x[3] and x[2] > marked}
    return [i for k in sorted(kept) for i in inside[k] or range(found[k][0], found[k][1])]


def _lengths(rows: list[Line]) -> list[int]:
    """Characters of the lines; 0 for those that are mostly links, unless marked or a few between lines of text."""
    out = [len(r.text) if r.main or r.links <= LINK_SHARE * len(r.text) else 0 for r in rows]
    texts = [i for i, r in enumerate(rows) if r.text]
    k = 0
    while k < len(texts):
        end = k
        while end < len(texts) and not out[texts[end]]:
            end += 1
        if 0 < k < end < len(texts) and (end - k < WINDOW or all(rows[i].para for i in texts[k:end])) and texts[end] - texts[k - 1] <= 2 * (end - k + 1):
            for i in texts[k:end]:
                out[i] = len(rows[i].text)
        k = end + 1
    return out


def extract(page: str | None) -> str:
    """The main text of a page."""
    rows = lines(page or "")
    lengths = _lengths(rows)
    if any(r.main and r.text for r in rows):
        kept = _marked_lines(rows, lengths)
    else:
        kept = [i for start, end in stretches(lengths) for i in range(start, end)]
    return "\n\n".join(rows[i].text for i in kept if lengths[i])


def extract_text(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``df`` (all columns) with the main text of ``html_col``: a map-only job."""
    return add_columns(df, [html_col], [T.StructField(text_col, T.StringType())],
                       lambda pages: [pa.array([extract(x.as_py()) for x in pages], pa.string())])
