"""Main text of web pages by line-block distribution.

Markup is stripped into lines: every block element is a line of its own, its
white space one blank.  What cannot be article text by its element or its
declared role (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) weighs nothing, like an empty line.  The
weight of a line is its number of characters, without those in links for lines
that are mostly links.  Block ``i`` of the distribution is the sum of the
weights of ``WIDTH`` lines from line ``i`` on, within one container.

The text begins at a *surge*, a line from which on the distribution is at least the
page's threshold, and ends at a *dive*, behind which it falls below it: lines
between them reach the threshold with the lines behind and with those before them.
The threshold is an eighth of the page's largest block, ``ENOUGH`` characters at
most, so a menu or a closing line falls below it beside a story's paragraphs.
Headings directly above a surge belong to it, and so do short lines that stand as
paragraphs (or list items, cells and the like) directly in the container of the
heaviest region, where that is a part of the page and not its whole body.  Lines of a marked main element are
text by that mark, whatever their sums.  The regions of a page are found over all
its lines.  Where the page marks its main element (``article``,
``main``) with text in it, the regions that touch it count, and besides, if the
heaviest region of the page weighs more than all text of the marked elements, the
regions beside that one.  Without marked text, the regions beside the heaviest
count.  Beside it are all regions, however short, with a line in the same container: the
nearest common ancestor of the parents of its lines, where sections, lists,
tables and the like are part of the text and no containers.

Outside a marked main element, any name of a class, id or role can mark a part as
no article text; inside it only a container's, by its first word, and only what is
never a subject, so a story may hold a section named "advertising".

Nothing else is dropped or cut.  Time and memory grow with the page, whatever its
nesting.  Broken pages are read like a browser would:
unclosed elements end with their parent, a ``<p>`` ends at the next block,
stray end tags are skipped, an unclosed comment or script runs to the end.

Defined results: a null or empty page, and one without text, give an empty
text and 0 characters; rows are read one by one, so repeated rows give equal
results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 3
MOSTLY_LINKS = 0.6
ENOUGH = 120

# Element names of the HTML standard, by what they mean here.
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe object svg canvas audio video select "
                 "noframes noembed xmp".split())
_OUTSIDE = frozenset("nav footer aside form header menu dialog button fieldset head search".split())
_MAIN = frozenset(("article", "main"))
# An open <p> ends where one of these begins.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
# Words of class, id and role values that mark what is no article text.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav rail "
    "footer header masthead comment comments disqus reply replies respond widget widgets share sharing social related "
    "recommended newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar tags "
    "copyright contentinfo complementary search skip masthead topbar".split())
# The same for containers within the main element.
_INSIDE = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie consent notice nav navbar "
    "breadcrumb breadcrumbs sidebar comment comments disqus share sharing social related recommended newsletter subscribe "
    "signup popup pagination".split())
_CONTAINERS = frozenset("div section aside ul ol table figure".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A container that holds the article is not dropped for a mark in a longer name such as "with-sidebar".
_HOLDS = frozenset("with has content main article wrapper container page layout body post entry".split())

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>"
    r"|<(?P<tail>/?[a-zA-Z][^>]*)\Z", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) if v else "" for k, v in _ATTR.findall(raw)} if raw.strip() else {}


def _unwanted(name: str, attrs: dict[str, str], in_main: bool) -> bool:
    """Whether an element holds what is no article text."""
    if name == "header":
        return not in_main
    if name in _OUTSIDE:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    if name in _MAIN or name in ("html", "body"):
        return False
    if in_main:
        return name in _CONTAINERS and any(
            words[:1] and words[0] in _INSIDE for key in ("role", "id", "class") for value in attrs.get(key, "").split()
            for words in [_WORD.findall(value.lower())])
    for key in ("role", "id", "class"):
        for value in attrs.get(key, "").split():
            words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            if _MARKS.intersection(words) and not _HOLDS.intersection(words):
                return True
            if words and words[-1] in _MARKS and words[0] not in ("with", "has", "no"):
                return True
    return False


# Elements that order a text but do not hold a page's parts.
_INNER = frozenset(
    "address blockquote caption dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split())


class Line:
    __slots__ = ("parts", "links", "main", "outside", "container", "kind")

    def __init__(self, main: bool, outside: bool):
        self.parts: list[str] = []
        self.links = 0
        self.main = main
        self.outside = outside
        self.container = -1
        self.kind = 0


def lines(html: str) -> list[tuple[str, int, bool, bool]]:
    """``(text, characters in links, in the main element, outside the article)`` of every block in page order."""
    return [line[:4] for line in _placed(html)[0]]


def _placed(html: str) -> tuple[list[tuple[str, int, bool, bool, int, int]], list[int], list[int], list[bool]]:
    """The lines, each with the number of the container around its block and its kind (2: heading, 1: another element of
    a text, 0: other); the parent of each container, -1 for the page and its body; the last container opened within
    each; and which are main elements.  Container 0 is the page; numbers go up in page order."""
    out: list[tuple[str, int, bool, bool, int, int]] = []
    parent, last, mains = [-1], [0], [False]
    holds: list[tuple[int, int]] = []  # open blocks: place in the stack, and the container around what is in them
    stack: list[tuple[str, bool]] = []  # open elements, and whether each began the outside
    count: dict[str, int] = {}  # open elements by name
    outside = main = links = headings = 0
    now = Line(False, False)

    def flush() -> None:
        nonlocal now
        text = _SPACE.sub(" ", "".join(now.parts)).strip()
        if text:
            out.append((text, min(now.links, len(text)), now.main, now.outside, max(now.container, 0), now.kind))
        now = Line(main > 0, outside > 0)

    def say(raw: str) -> None:
        if raw:
            text = unescape(raw)
            if now.parts == []:
                now.main, now.outside = main > 0, outside > 0
            if now.container < 0 and not text.isspace():
                now.container = holds[-2][1] if len(holds) > 1 else 0
                now.kind = 2 if headings else int(bool(holds) and stack[holds[-1][0]][0] in _INNER)
            now.parts.append(text)
            if links:
                now.links += len(_SPACE.sub(" ", text).strip())

    def close(upto: int) -> None:
        nonlocal outside, main, links, headings
        while len(stack) > upto:
            name, bad = stack.pop()
            count[name] -= 1
            if name in _BLOCKS or bad:
                flush()
            if holds and holds[-1][0] == len(stack):
                own = holds.pop()[1]
                last[own] = len(parent) - 1
            outside -= bad
            main -= name in _MAIN
            links -= name == "a"
            headings -= name in _HEADINGS
        now.main, now.outside = (main > 0, outside > 0) if not now.parts else (now.main, now.outside)

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at:m.start()])
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if m.group("close"):
            if not count.get(name):
                if name == "p":
                    flush()
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in _BLOCKS and name not in _BLOCKS:
                    break
            continue
        if name in _BLOCKS:
            flush()
        if name in _ENDS_P and count.get("p"):
            # The innermost <p>, unless another block lies within it.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    kept = [x for x in stack[k + 1:] if not x[1] and x[0] != "a"]
                    close(k)
                    for x in kept:  # formatting goes on in the next block
                        stack.append(x)
                        count[x[0]] = count.get(x[0], 0) + 1
                        headings += x[0] in _HEADINGS
                    break
                if stack[k][0] in _BLOCKS:
                    break
        if name in _RAW and not html[m.start():m.end()].endswith("/>"):
            end = re.compile(rf"</{name}\s*/?>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if name == "br":
            now.parts.append(" ")
        if name in _VOID or name == "br":
            continue
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and count.get(name):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "menu", "tr" if name in ("td", "th") else "table"):
                    break
        bad = _unwanted(name, _attributes(m.group("attrs")), main > 0)
        if bad:
            flush()
        if name in _BLOCKS:
            around = holds[-1][1] if holds else 0
            if name not in _INNER:
                parent.append(-1 if name == "body" else around)
                last.append(len(parent) - 1)
                mains.append(name in _MAIN)
                around = len(parent) - 1
            holds.append((len(stack), around))
        stack.append((name, bad))
        count[name] = count.get(name, 0) + 1
        headings += name in _HEADINGS
        outside += bad
        main += name in _MAIN
        links += name == "a"
        if not now.parts:
            now.main, now.outside = main > 0, outside > 0
    flush()
    close(0)
    last[0] = len(parent) - 1
    return out, parent, last, mains


def weights(page: list[tuple[str, int, bool, bool]]) -> list[int]:
    """Characters of each line that can be article text."""
    return [0 if outside or (not main and linked > MOSTLY_LINKS * len(text)) else len(text)
            for text, linked, main, outside in page]


def distribution(weight: list[int], width: int = WIDTH) -> list[int]:
    """Sums of the weights of ``width`` lines from each line on."""
    sums, total = [], 0
    padded = [*weight, *([0] * width)]
    total = sum(padded[:width])
    for i in range(len(weight)):
        sums.append(total)
        total += padded[i + width] - padded[i]
    return sums


def regions(weight: list[int], width: int = WIDTH, sure: list[bool] | None = None,
            heading: list[bool] | None = None) -> list[tuple[int, int]]:
    """``(surge, dive)`` lines: text lies in [surge, dive).

    A ``sure`` line with weight is text whatever its sums; a ``heading`` directly above a surge belongs to it."""
    n = len(weight)
    ahead = distribution(weight, width)
    before = distribution(weight[::-1], width)[::-1]
    least = max(1, min(max(ahead, default=0) / 8, ENOUGH))
    inside = [(sure is not None and sure[i] and weight[i] > 0) or (ahead[i] >= least and before[i] >= least)
              for i in range(n)]
    found, i = [], 0
    while i < n:
        if not inside[i] or not weight[i]:
            i += 1
            continue
        start, end, at = i, i + 1, i + 1
        while at < n and (inside[at] or (not weight[at] and at - end < width - 1)):
            if weight[at]:
                end = at + 1
            at += 1
        floor = found[-1][1] if found else 0
        while heading is not None and start > floor and heading[start - 1] and weight[start - 1]:
            start -= 1
        found.append((start, end))
        i = at
    return found


def extract(html: str | None) -> str:
    """Main text of one whole page: its blocks, joined by an empty line."""
    if not html:
        return ""
    page, parent, last, mains = _placed(html)
    weight = weights([line[:4] for line in page])
    sure, heading = [line[2] for line in page], [line[5] == 2 for line in page]
    found = regions(weight, WIDTH, sure, heading)
    if not found:
        return ""
    marked = sum(w for w, line in zip(weight, page, strict=True) if line[2])
    mass = [sum(weight[a:b]) for a, b in found]
    first, end = found[mass.index(max(mass))]
    held = [page[i][4] for i in range(first, end) if weight[i]]
    # The nearest common ancestor of all is that of the first and the last in page order.
    one, two = min(held), max(held)
    while one != two and one >= 0 and two >= 0:
        one, two = (one, parent[two]) if two > one else (parent[one], two)
    one = max(one if one == two else 0, 0)
    # The container of the story: around a marked element also what holds that.
    around = {c for c in (one, parent[one] if mains[one] else one) if parent[c] >= 0}
    if around:
        sure = [x or (line[4] in around and line[5] > 0) for x, line in zip(sure, page, strict=True)]
        found = regions(weight, WIDTH, sure, heading)
    beside = max(mass) > marked
    keep = [(a, b) for a, b in found if any(
        weight[i] and (page[i][2] or (beside and one <= page[i][4] <= last[one])) for i in range(a, b))]
    return "\n\n".join(page[i][0] for a, b in keep for i in range(a, b) if weight[i])


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
              keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column("html").to_pylist()]
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id_col, *keep, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(id_col, *keep, F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (id_col, *keep)), "text string", "n_chars long"]))
