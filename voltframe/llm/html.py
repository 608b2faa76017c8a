"""Main text of web pages by tag-path ratios.

A page is read into blocks: text between block-level tags, with its path of tags from the root. For each path
the length of text that is no link and the number of punctuation marks are summed and divided by the number of
blocks there; along the page both ratios are smoothed, and their product is the block's score. A threshold between
the two classes of scores (Otsu's) picks content blocks. They choose the place of the content: the marked articles
if these hold most of what is picked (all that hold a good share), else the element that holds most of it. There,
everything counts but for tags and names that say menu, header, footer, sidebar, notice, advert, form or comments;
outside of marked articles only paths that were picked, headings, and what stands between under the same parent.
A name is no veto: an element that holds most of the page's text is kept whatever it is called.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import for_python, table

# Tags by kind, and names that mark what is not content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("nav footer aside form menu button select option search dialog head svg object canvas datalist".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav footer header masthead comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations widget widgets toolbar pagination pager login search copyright".split())
#: Words that may stand beside one of these in a name and leave it what it is.
BESIDE = frozenset("area bar block body bottom box button buttons container content entries footer form global header icon icons inner item items left line link links list main menu message module outer page panel primary right secondary section site slot text thread top unit view wrap wrapper".split())
#: Elements that are outside of content whatever they hold; others are kept if they hold most of a page.
HARD = frozenset("nav footer aside menu button select option dialog head svg object canvas datalist".split())
#: Elements that are no place of their own for a page's content.
LEAVES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th tr pre caption legend figcaption summary address center blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: What a start tag closes: tags that end an open one of the given kinds, as far as the given bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset({"article", "main"})

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_CUT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_MARKS = regex.compile(r"\p{P}")


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None = None
    path: int = 0
    flag: int = 0  # 1: named as something outside of content; 2: outside whatever it holds
    article: bool = False
    inside: bool = False  # of a marked article
    out: bool = False
    text: int = 0
    marks: int = 0
    picked: float = 0.0


@dataclass(slots=True)
class Block:
    at: Element
    text: str
    linked: int


def blocks(page: str) -> tuple[list[Element], list[Block]]:
    """The elements of a page, parents first, and its blocks in order (but for scripts, styles, comments and the like)."""
    root = Element("#")
    elements, stack, out, held = [root], [root], [], []
    open_: Counter = Counter()
    linked = link = 0
    at = 0

    def end_block() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(held)).strip()
        if text:
            out.append(Block(stack[-1], text, min(linked, len(text))))
        held.clear()
        linked = 0

    def said(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = entities.unescape(piece)
            held.append(piece)
            if link:
                linked += len(piece)

    def pop() -> str:
        tag = stack.pop().tag
        open_[tag] -= 1
        return tag

    lower = None
    while m := _TOKEN.search(page, at):
        said(page[at : m.start()])
        at = m.end()
        if not (tag := (m[2] or "").lower()):
            continue
        if tag == "br" or (tag in VOID and tag != "hr"):
            held.append(" ")
            continue
        if m[1]:
            if tag == "a":
                link = 0
            if tag in BLOCKS and open_[tag]:
                end_block()
                while pop() != tag:
                    pass
            continue
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            lower = lower if len(lower) == len(page) else "".join([c if len(c) == 1 else "?" for c in map(str.lower, page)])
            stop = lower.find(f"</{tag}", at)
            if stop < 0:
                at = len(page)
                break
            at = page.find(">", stop) + 1 or len(page)
            held.append(" ")
            continue
        if tag == "a":
            link = 1
            continue
        if tag not in BLOCKS:
            continue
        end_block()
        if tag == "hr":
            continue
        close, bound = CLOSES.get(tag, ((), ()))
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in close:
                while len(stack) > i:
                    pop()
            elif stack[i].tag in bound or stack[i].tag == "p" and close:
                break
        if stack[-1].tag == "p":  # a paragraph holds no blocks
            pop()
        top = stack[-1]
        names, role, hidden = _names(m[3])
        e = Element(tag, top, hash((top.path, tag, *sorted(names))), inside=top.inside)
        if hidden or tag in HARD or (top.inside and top.tag == "header" and tag not in HEADINGS and tag != "hgroup"):
            e.flag = 2
        elif tag in ARTICLE or role == "main" or "articlebody" in names:
            if any(_called(n, TALK) for n in names):
                e.flag = 2
            else:
                e.article, e.inside = not top.inside, True
        elif tag in OUTSIDE or role in ROLES or (tag == "header" and not top.inside) or (tag not in KEPT and any(_called(n, NAMES) for n in names)):
            e.flag = 1
        stack.append(e)
        elements.append(e)
        open_[tag] += 1
    said(page[at:])
    end_block()
    return elements, out


TALK = frozenset("comment comments commentlist reply replies respond ad ads advert sponsored related recommended".split())
#: Elements that names say nothing about: the page itself, and what is text in its own right.
KEPT = frozenset("html body p h1 h2 h3 h4 h5 h6 td th tr tbody thead tfoot table blockquote pre hgroup".split())


@lru_cache(maxsize=1 << 14)
def _called(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id says one of the words: it is one, or one with others that leave it what it is."""
    parts = [x.lower() for x in _CUT.split(name) if x]
    return any(x in words for x in parts) and all(x in words or x in BESIDE for x in parts)


def _names(attributes: str) -> tuple[set[str], str, bool]:
    names, role, hidden = set(), "", False
    if "=" not in attributes and "hidden" not in attributes.lower():
        return names, role, hidden
    for m in _NAMED.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind in ("class", "id"):
            names.update(value.split())
        elif kind == "role":
            role = value.lower()
        elif kind == "itemprop" and value.lower() == "articlebody":
            names.add("articlebody")
        elif kind == "hidden":
            hidden = True
        elif kind == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            hidden = True
    return names, role, hidden


def ratios(found: list[Block]) -> np.ndarray:
    """For each block the fused ratio of its tag path, smoothed along the page."""
    size: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for b in found:
        s = size[b.at.path]
        s[0] += len(b.text) - b.linked
        s[1] += len(_MARKS.findall(b.text)) if not b.linked else 0
        s[2] += 1
    text = np.array([size[b.at.path][0] / size[b.at.path][2] for b in found])
    marks = np.array([size[b.at.path][1] / size[b.at.path][2] for b in found])
    window = np.array([0.054, 0.242, 0.408, 0.242, 0.054])
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), window, mode="valid")
    return smooth(text) * (1 + smooth(marks))


def threshold(scores: np.ndarray) -> float:
    """The score that splits them best in two classes, on a logarithmic scale (Otsu's method); the least if all are equal."""
    x = np.sort(np.log1p(scores))
    n = np.arange(1, len(x))
    left = np.cumsum(x)[:-1]
    between = (left / n - (x.sum() - left) / (len(x) - n)) ** 2 * n * (len(x) - n)
    if not len(between) or between.max() <= 1e-12:
        return float(np.expm1(x[0]) - 1e-9)
    at = int(between.argmax())
    return float(np.expm1((x[at] + x[at + 1]) / 2))


def _exclude(elements: list[Element], found: list[Block]) -> None:
    """Marks elements that are outside of content: flagged ones, unless (flag 1) they hold most of the page's text."""
    for e in elements[1:]:
        e.out = e.parent.out or e.flag == 2
    for b in found:
        if not b.at.out:
            b.at.text += len(b.text) - b.linked
    for e in reversed(elements[1:]):
        if not e.out:
            e.marks += e.article or e.tag == "h1"
            e.parent.text += e.text
            e.parent.marks += e.marks
    root = elements[0]
    for e in elements[1:]:
        kept = 2 * e.text > root.text and (e.marks or not root.marks)
        e.out = e.parent.out or e.flag == 2 or (e.flag == 1 and not kept)


def _ancestors(e: Element) -> Iterator[Element]:
    while e is not None:
        yield e
        e = e.parent


def main_blocks(page: str) -> list[str]:
    """The blocks of the main text in page order."""
    elements, found = blocks(page)
    if not found:
        return []
    _exclude(elements, found)
    score = ratios(found)
    free = [i for i, b in enumerate(found) if not b.at.out]
    if not free:
        return []
    limit = threshold(score[free])
    picked = [i for i in free if score[i] >= limit and 2 * found[i].linked <= len(found[i].text)]
    for i in picked:
        found[i].at.picked += len(found[i].text)
    for e in reversed(elements[1:]):
        e.parent.picked += e.picked
    articles = [e for e in elements if e.article and not e.out]
    if articles and (not picked or 2 * sum(e.picked for e in articles) >= elements[0].picked):
        most = max(e.picked for e in articles)
        places = {id(e) for e in articles if 4 * e.picked >= most}
        return [found[i].text for i in free if found[i].at.inside and any(id(e) in places for e in _ancestors(found[i].at))]
    if not picked:
        return []
    place, down = elements[0], defaultdict(list)
    for e in elements[1:]:
        if e.picked:
            down[id(e.parent)].append(e)
    while (next_ := max(down[id(place)], key=lambda e: e.picked, default=None)) and next_.tag not in LEAVES and 4 * next_.picked >= 3 * place.picked:
        place = next_
    inner = {id(place)}
    for e in elements[1:]:
        if id(e.parent) in inner:
            inner.add(id(e))
    paths, parents = {found[i].at.path for i in picked}, {id(found[i].at.parent) for i in picked}
    title = [i for i in free if found[i].at.tag == "h1" and i < picked[0]][-1:]

    def stays(i: int) -> bool:
        b = found[i]
        if i in title:
            return True
        if id(b.at) not in inner:
            return False
        if b.at.path in paths or b.at.tag in HEADINGS:
            return True
        return picked[0] < i < picked[-1] and 2 * b.linked <= len(b.text) and (id(b.at.parent) in parents or any(id(e) in parents for e in _ancestors(b.at)))

    return [found[i].text for i in free if stays(i)]


def main_text(page: str | None) -> str:
    """Blocks of the main text joined by two line breaks; empty if there are none. Null and empty pages: empty."""
    return "\n\n".join(main_blocks(page)) if page else ""


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with main_text (string, never null), one row for each row; a column of that name is replaced.

    Whole pages are read. Null, empty and blank pages, and pages that are nothing but menus and the like, give
    an empty text. Repeated rows and further columns pass through. Narrow: no shuffle.
    """
    for_python(pages.sparkSession)
    pages = pages.drop("main_text")
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in pages.schema), "main_text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(t) for t in b.column(b.schema.get_field_index(html)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "main_text"])

    return pages.mapInArrow(run, schema)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_text() of all pages; nulls, repeated rows and empty tables as there, further columns are not looked at."""
    found = extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.selectExpr("page_id", "url", "main_text as text", "cast(length(main_text) as long) as n_chars")
