"""Main text of web pages: the line-block distribution.

Markup is stripped into lines, one for each block of the page in page order. The weight of a
line is the length of its text; lines made of links and lines inside elements that announce
themselves as navigation, notices, adverts, forms or comments weigh nothing. Summed over a
sliding window of lines, the weights rise steeply where the article begins (surge) and fall to
nothing behind it (dive). The lines with weight between surge and dive are the text.

What an element is called is evidence as well. Wrappers of whole pages have names like
"overflow-hidden", "header-fixed" or "widget-container". So a name is held against the weights: if
all elements of a name hold many times the text that would be left without them, the name says
nothing on this page, and their lines weigh as others do.

An <article> or <main> is evidence, not proof: its words weigh `GAIN` times as much. If one of
them then weighs no less than the heaviest stretch between surge and dive outside, the marked
elements are the text, every word of them. Otherwise the page is read like one without marks;
where several elements are marked on it, they are teasers and not part of the text.

Defined results: a null or empty page, or one without text, has the empty text; an open tag,
comment or script at the end of a cut page runs to its end; repeated rows are rows of their
own; rows with null ids or urls are kept; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import table

WINDOW = 3  # lines in a block
SURGE = 86  # characters that a block needs, where no article is marked
SHORT = 40  # characters of a line that may stand at the edge of the text
LINKED = 0.5  # share of link text from which a line is a menu
GAIN = 4  # weight of a word that stands in a marked article

# Element names of HTML by their role here.
_RAW = "script|style|noscript|template|svg|math|textarea|select|iframe|object|title|button"
_BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section
    summary table tbody td tfoot th thead tr ul""".split()
)
# elements that are parts of a running text, and those that only hold such parts
_LISTED = frozenset("li dd dt".split())
_RUNNING = _LISTED | frozenset("p pre blockquote td th".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HOLDERS = (_RUNNING | _HEADS | frozenset("ul ol dl table tbody thead tr caption".split())) - {"td", "th"}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ASIDE = frozenset("nav footer aside form dialog menu search fieldset".split())
_FIRM = _ASIDE - {"form", "fieldset"}  # whole pages stand in a form, but not in a menu
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
# Words of class names and ids that side matter commonly has.
_NAMES = frozenset(
    """ad adbox ads adv advert advertisement advertisements advertising adverts adsense alert banner breadcrumb
    breadcrumbs comment commentform commentlist comments consent cookie cookiebar cookies copyright disclaimer
    discussion disqus feedback footer gdpr header hidden legal login masthead menu menubar modal nav navbar
    navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related
    replies reply respond response responses share sharing sidebar signup sitenav skip social sponsor sponsored
    sponsors subscribe subscription toolbar topbar topnav widget widgets""".split()
)
# "has-sidebar" and the like name what a wrapper holds or how it looks, not what it is
_WRAPS = frozenset("with without has no main overflow free".split())
# what readers write may be longer than the article
_REPLIES = frozenset("comment comments commentlist discussion disqus replies reply response responses".split())

_ENDS = tuple(".!?…:;\"'”’»)")

# attributes up to the end of the tag; a quoted value may hold ">"
_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*'|["'])*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b{_ATTRIBUTES}(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    rf"|<(/?)([a-z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([a-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _beside(name: str, attributes: str, inside: bool) -> str | None:
    """Why this element says that it is not the article; `inside` one, a header is its title."""
    titled = inside and name == "header"
    if name in _ASIDE or name == "header" and not titled:
        return name
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "role" and value.lower() in _ROLES and not titled:
            return f"{key}={value}"
        if key == "aria-hidden" and value.lower() == "true":
            return key
        if key == "style" and "display:none" in value.lower().replace(" ", ""):
            return key
        if key in ("class", "id") and name not in ("html", "body", "main", "h1") and not titled:
            for word in value.split():
                # "md:hidden" is hidden on some screens, "layout--sidebar-left" a layout
                parts = {x.lower() for x in _PART.findall(word.partition("--")[0])} if ":" not in word else set()
                if parts & _NAMES and not parts & _WRAPS:
                    return f".{word}"
    return None


class Line(NamedTuple):
    text: str
    linked: float  # share of link text
    article: int  # number of the outermost marked article around it; 0 outside
    element: str
    holder: int  # number of the element that holds the running text of which it is a part
    blank: bool  # no text at all, not even one that is left out


class Piece(NamedTuple):
    text: str
    link: bool
    side: int  # number of the innermost element around it that says it is beside; 0 for none


class Side(NamedTuple):
    """An element that says it is not the article."""

    reason: str
    around: int  # the next one outside
    article: int  # the marked article that it lies in
    holds: bool  # a marked article lies in it


def _named(reason: str) -> set[str]:
    return {x.lower() for x in _PART.findall(reason)}


def _believed(pieces: list[list[Piece]], articles: list[int], sides: list[Side]) -> list[bool]:
    """For each element that says it is beside: are its words left out?

    Reasons are tried by the text that their outermost elements hold, the largest first, and
    struck off while what is left without them is many times smaller.
    """
    own = [0] * len(sides)
    marked = [0] * len(sides)
    for line, article in zip(pieces, articles, strict=True):
        for piece in line:
            if not piece.link:
                own[piece.side] += len(piece.text.strip())
                marked[piece.side] += len(piece.text.strip()) if article else 0
    struck: set[str] = set()
    while True:
        kept, kept_marked = own[0], marked[0]
        outer = [0] * len(sides)  # the outermost believed element; elements follow those around them
        weight: dict[str, int] = {}
        loose: dict[str, tuple[bool, bool]] = {}
        for k in range(1, len(sides)):
            side = sides[k]
            outer[k] = outer[side.around] or (0 if side.reason in struck else k)
            if not outer[k]:
                kept += own[k]
                kept_marked += marked[k]
                continue
            top = sides[outer[k]]
            weight[top.reason] = weight.get(top.reason, 0) + own[k]
            inside, holds = loose.get(top.reason, (True, False))
            loose[top.reason] = (inside and bool(top.article), holds or top.holds)
        for reason in sorted(weight, key=lambda r: (-weight[r], r)):
            inside, holds = loose[reason]
            if weight[reason] < SURGE:
                break
            if inside:  # all within the marked article, which would be nearly empty without it
                wrapper = kept_marked * 20 < weight[reason]
            elif kept_marked or reason in _FIRM and not holds:
                wrapper = False
            else:
                wrapper = kept * (20 if _named(reason) & _REPLIES else 4) < weight[reason]
            if wrapper:
                struck.add(reason)
                break
        else:
            break
        if reason not in struck:
            break
    return [bool(x) for x in outer]


def lines_of(page: str) -> tuple[list[Line], list[list[int]]]:
    """The blocks of a page; for each holder, the numbers of its first line and of the line behind its last.

    What stands beside the article leaves its block without text.
    """
    pieces: list[list[Piece]] = [[]]
    places: list[tuple[int, str, int]] = []  # article, element and holder of each line
    holders: list[list[int]] = [[0, -1]]
    sides: list[Side] = [Side("", 0, 0, False)]
    # name, side, article, linked, holder
    stack: list[tuple[str, int, int, bool, int]] = []
    open_names: Counter[str] = Counter()
    articles = side = article = 0
    link = False

    def end_line():
        name, *_, holder = stack[-1] if stack else ("", 0)
        places.append((article, name, holder))
        pieces.append([])

    def close(k: int):
        for name, *_, holder in stack[k:]:
            holders[holder][1] = len(places)
            open_names[name] -= 1
        del stack[k:]
        holders[stack[-1][-1] if stack else 0][1] = -1  # a holder that goes on is closed later

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            pieces[-1].append(Piece(page[at : token.start()], link, side))
        at = token.end()
        name = token[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            pieces[-1].append(Piece(" ", link, side))
            continue
        if name in _BLOCKS:
            end_line()
        if token[2]:
            if open_names[name]:  # an end without a beginning costs no search
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
        elif name not in _VOID and not token[4].endswith("/") and (name in _BLOCKS or name == "a" or token[4]):
            if name in ("p", "li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                close(len(stack) - 1)  # these close themselves
            side_now, article_now = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
            reason = _beside(name, token[4], bool(article_now))
            if reason:
                sides.append(Side(reason, side_now, article_now, False))
                side_now = len(sides) - 1
            elif name in ("article", "main") and not article_now:
                articles += 1
                article_now = articles
                k = side_now
                while k and not sides[k].holds:
                    sides[k] = sides[k]._replace(holds=True)
                    k = sides[k].around
            holder = stack[-1][-1] if stack else 0
            if name in _BLOCKS and name not in _HOLDERS:
                holders.append([len(places), -1])
                holder = len(holders) - 1
            stack.append((name, side_now, article_now, link or name == "a", holder))
            open_names[name] += 1
        _, side, article, link, _ = stack[-1] if stack else ("", 0, 0, False, 0)
    pieces[-1].append(Piece(page[at:], link, side))
    end_line()
    pieces.pop()
    for holder in holders:
        holder[1] = len(places) if holder[1] < 0 else holder[1]
    left_out = _believed(pieces, [place[0] for place in places], sides)
    lines = []
    for line, (article, name, holder) in zip(pieces, places, strict=True):
        kept = [piece for piece in line if not left_out[piece.side]]
        linked = sum(len(piece.text.strip()) for piece in kept if piece.link)
        plain = sum(len(piece.text.strip()) for piece in kept if not piece.link)
        text = " ".join(html.unescape("".join(piece.text for piece in kept)).split())
        blank = not any(piece.text.strip() for piece in line)
        lines.append(Line(text, linked / max(1, plain + linked), article, name, holder, blank))
    return lines, holders


def _edges(lines: list[Line], stretch: list[int], holders: list[list[int]]) -> list[int]:
    """The stretch between the edges that the window blurs.

    It goes from its main heading, else from its first long line and the heading before it, to the
    last line that is long or ends like a sentence. Short list items before that and short
    paragraphs, items and cells behind belong to it where they stand in the same element.
    """
    full = [k for k in stretch if len(lines[k].text) >= SHORT or lines[k].text[-1:] in _ENDS]
    if not full:
        first = last = None
    else:
        first, last = full[0], full[-1]
        low, high = holders[lines[first].holder][0], holders[lines[last].holder][1]
        for k in reversed([k for k in stretch if low <= k < first]):
            if lines[k].element not in _LISTED:
                break
            first = k
        for k in [k for k in stretch if last < k < high]:
            if lines[k].element in _RUNNING:
                last = k
            elif lines[k].element not in _HEADS:
                break
    heads = [k for k in stretch if lines[k].element == "h1"]
    heads += [k for k in stretch if lines[k].element in ("h2", "h3") and first is not None and k < first]
    start = heads[0] if heads else stretch[0] if first is None else first
    end = stretch[-1] if last is None or last < start else last
    return [k for k in stretch if start <= k <= end]


def _closed_up(lines: list[Line]) -> list[int]:
    """Numbers of the lines, without gaps of two and more between lines of the same element.

    Such a gap is side matter in the middle of a text; one between elements is a border.
    """
    kept, gap, holder = [], [], None
    for k, line in enumerate(lines):
        if not line.text:
            gap.append(k)
            continue
        kept += gap[:1] if line.holder == holder else gap
        kept.append(k)
        gap, holder = [], line.holder
    return kept + gap


def _stretches(lines: list[Line], weights: list[int], holders: list[list[int]]) -> list[list[int]]:
    """Numbers of the lines with weight from each surge to its dive.

    Headings, and short parts of the same running text, that lead to the surge belong to it.
    """
    order = _closed_up(lines)
    weights = [weights[k] for k in order]
    blocks = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    surge = min(SURGE, max(blocks, default=0))
    found, i = [], 0
    while i < len(blocks):
        if not blocks[i] or blocks[i] < surge:
            i += 1
            continue
        start = dive = i
        low = holders[lines[order[next(k for k in range(i, len(weights)) if weights[k])]].holder][0]
        while start and blocks[start - 1]:
            name = lines[order[start - 1]].element
            if weights[start - 1] and name not in _HEADS and not (name in _RUNNING and order[start] > low):
                break
            start -= 1
        above = start - 1
        while above >= 0 and lines[order[above]].blank:
            above -= 1
        if above >= 0 and weights[above] and lines[order[above]].element == "h1":
            start = above  # the title, in a box of its own
        while dive < len(blocks) and blocks[dive]:
            dive += 1
        found.append([order[k] for k in range(start, dive) if weights[k]])
        i = dive
    return found


def main_text(page: str) -> str:
    lines, holders = lines_of(page)
    plain = [len(x.text) if x.linked < LINKED else 0 for x in lines]
    marked: Counter[int] = Counter()
    for x in lines:
        if x.article and x.text:
            marked[x.article] += GAIN * len(x.text)
    if marked:
        beside = [0 if x.article else w for x, w in zip(lines, plain, strict=True)]
        heaviest = max((sum(beside[k] for k in found) for found in _stretches(lines, beside, holders)), default=0)
        if max(marked.values()) >= heaviest:  # every word of an article counts, a line of links included
            return "\n".join(x.text for x in lines if x.article and x.text)
        plain = beside if len(marked) > 1 else plain
    return "\n".join(lines[k].text for found in _stretches(lines, plain, holders) for k in _edges(lines, found, holders))


@F.arrow_udf(T.StringType())
def extract(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in pages:
        yield pa.array([main_text(page or "") for page in column.to_pylist()], pa.string())


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of (page_id, url, html)."""
    return pages.select("page_id", "url", extract("html").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "pages"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLES: dict[str, str] = {}  # no SQL for nested markup; tests compare with pages made around known text
