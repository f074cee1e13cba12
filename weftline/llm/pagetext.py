"""Main text of web pages by tag-path ratios (op4).

A page is read as a flat run of tags and text. A block of text has a root-to-leaf path: the tags open around it, and ``a`` at the end
where links hold half of it or more; the cells of a table row are one node of the row's path. For each path the lengths of its texts (the
text of links counting LINK) and their punctuation marks are summed up; its ratios are these sums by the number of its nodes. Along the
page's nodes the ratios are smoothed by KERNEL. A path's own and smoothed ratios of length and of punctuation are fused into one weight,
by geometric means; where a page names an article (``article`` or ``main``), paths outside it weigh OUTSIDE_SHARE of that. A path is content
when its weight reaches THRESHOLD of the page's mean weight, each path weighted by the length that counts; this one threshold decides for all pages. A
heading also belongs to the content path beside it.

Before, what the elements of REMOVED hold is taken away, as is what a class, id or role marks as a menu, header, footer, sidebar, notice,
advert, form or reader comments: whole words of a class only (MARKS). A mark doesn't count on an element that holds ``main`` or ``h1``; one
that may mean the page's layout doesn't either where it holds an article, or most of the article it stands in.

Character references are decoded, white space within a block becomes one blank, blocks are trimmed and joined by one newline in the
page's order. A null, empty or unreadable page has an empty text. Repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import shared

#: Share of the page's mean weight from which a path is content; weight of paths outside a page's article; length of a link's character.
THRESHOLD, OUTSIDE_SHARE, LINK = 0.005, 1 / 64, 0.01
#: Smoothing along the page's nodes, renormalised at its ends.
KERNEL = (1, 4, 6, 4, 1)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROWS = 256

#: Elements by role (fixed values, from the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is never an article's.
REMOVED = frozenset("nav footer aside form button select option input textarea script style noscript template iframe title head menu dialog object svg math canvas datalist".split())
#: Words of a class, or an id, that mark such text: a name, with what goes before or after it. What a name of the second kind holds may be the
#: article all the same.
MARKS = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary|mobile|user|reader|post|article|blog|web)[-_])?"
    r"(?:(?P<sure>nav|navbar|navigation|menu|menubar|breadcrumbs?|footer|ads?|adverts?|advertisements?|advertising|sponsored|cookies?|newsletter|subscribe|share|sharing|related|recommended|"
    r"recommendations|comments?|respond|replies|disqus|pagination|pager)|(?P<head>header|masthead)|side-?bar|aside|banner|sponsor|promo|promotion|consent|gdpr|notices?|disclaimer|popup|modal|subscription|social|"
    r"widgets?|toolbar|copyright|legal|search|login|signup|skip)"
    r"(?:[-_](?:bar|banner|notice|box|list|area|section|wrapper|wrap|container|block|slot|unit|form|links?|items?|inner|content|body|thread|widget|popup|consent|posts?|articles?|stories|menu|nav|buttons?|top|bottom|left|right|main))*(?:[-_]?[0-9]+)?"
)
#: How sure it is that an element holds none of the article.
FREE, MARKED, SURE, GONE = range(4)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Elements that an opening tag of the same kind, or of a block, closes.
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

#: A quote opens a value only after an equals sign; an end tag without a name is a comment, as "<!" and "<?" are.
TAG = re.compile(
    r"<(?:!--(?:-?>|(.*?)(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?)?|=)*+)>|[!?][^>]*>|/(?![a-zA-Z])[^>]*>)", re.S
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SIMPLE_TAG = re.compile(r"<(?:(\x00)|(/?)([a-zA-Z][^\s/>]*)([^>]*))>")
PUNCTUATION = re.compile(r"[.,;:!?¡¿…、。，！？]")


def _marked(name: str, attributes: str, within: bool) -> int:
    """What tag and attributes say of an element. within: it stands in an article, whose header may hold its title."""
    if name in REMOVED or name == "header" and not within:
        return GONE
    found = FREE
    if attributes and name not in ("html", "body", "main"):
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            value, key = (a or b or c).lower(), key.lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return GONE
            if key == "role" and value in ROLES:
                found = SURE
            if key in ("class", "id"):
                for m in filter(None, map(MARKS.fullmatch, value.split())):
                    if m["sure"] or name != "article" and not (within and m["head"]):
                        found = max(found, SURE if m["sure"] else MARKED)
    return found


@dataclass
class Block:
    """A block of text: its path's number, its element's, whether it stands in an article; own is the length that counts, node the row it belongs to."""

    text: str
    path: int
    element: int
    within: bool
    own: float
    node: int


def blocks(page: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """Blocks of a page in order, without what is removed; paths, each (its parent's number, last tag)."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    paths: list[tuple[int, str]] = [(-1, "")]
    numbers: dict[tuple[int, str], int] = {}
    elements: list[tuple[int, str, int]] = [(-1, "", FREE)]  # parent, name, mark
    stack: list[tuple[str, bool, bool, int, int, bool]] = [("", False, False, 0, 0, False)]  # name, apart, within an article, path, element, in a link
    opened: dict[str, int] = {}

    def number_of(path, name):
        if (number := numbers.get((path, name))) is None:
            number = numbers[path, name] = len(paths)
            paths.append((path, name))
        return number

    def end_block():
        if parts:
            text = " ".join("".join([htmllib.unescape(t) for t, _ in parts]).split())
            if text:
                _, _, within, path, element, _ = stack[-1]
                linked = len(" ".join("".join([htmllib.unescape(t) for t, link in parts if link]).split())) if any(link for _, link in parts) else 0
                row = element
                while elements[row][1] in INLINE:
                    row = elements[row][0]
                if elements[row][1] in ("td", "th"):
                    row, path = elements[row][0], paths[path][0]
                out.append(Block(text, number_of(path, "a") if 2 * linked >= len(text) else path, element, within, len(text) - linked + LINK * linked, row))
            parts.clear()

    def pop():
        opened[stack.pop()[0]] -= 1

    pos, size = 0, len(page)
    while pos < size:
        at = page.find("<", pos)
        if at < 0:
            parts.append((page[pos:], stack[-1][5]))
            break
        if at > pos:
            parts.append((page[pos:at], stack[-1][5]))
        m = TAG.match(page, at) or SIMPLE_TAG.match(page, at)  # quotes may not be paired
        if not m:
            if (sign := page[at + 1 : at + 2]).isascii() and sign.isalpha() or sign in ("/", "!"):
                break  # a tag that the page's end cuts off
            parts.append(("<", stack[-1][5]))
            pos = at + 1
            continue
        pos = m.end()
        if not (name := m[3]):
            continue
        name = name.lower()
        if m[2]:
            if opened.get(name):
                if name not in INLINE or stack[-1][1]:
                    end_block()
                while (top := stack[-1][0]) != name:
                    if name in INLINE and top not in INLINE:
                        break  # a stray end of an inline element closes no block
                    if stack[-1][1] or top not in INLINE:
                        end_block()
                    pop()
                else:
                    pop()
            elif name not in INLINE:
                end_block()
            continue
        if name not in INLINE:
            end_block()
            k = len(stack) - 1
            while stack[k][0] in INLINE:
                k -= 1
            if name in CLOSED_BY.get(stack[k][0], ()):
                while len(stack) > k:
                    pop()
        _, outer, within, path, parent, link = stack[-1]
        marked = _marked(name, m[4], within)
        if marked and not outer:
            end_block()
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, pos)
            pos = close.end() if close else size
            continue
        if name not in INLINE:
            path = number_of(path, name)
        stack.append((name, outer or marked > FREE, within or name in ("article", "main"), path, len(elements), link or name == "a"))
        elements.append((parent, name, marked))
        opened[name] = opened.get(name, 0) + 1
    end_block()
    return _kept(out, elements), paths


def _kept(found: list[Block], elements: list[tuple[int, str, int]]) -> list[Block]:
    """Blocks that stand in no removed element and in no marked one whose mark counts."""
    length, holds, article = [0] * len(elements), [FREE] * len(elements), [-1] * len(elements)
    for b in found:
        length[b.element] += len(b.text)
    for k in range(len(elements) - 1, 0, -1):
        parent, name, _ = elements[k]
        length[parent] += length[k]
        holds[parent] = max(holds[parent], holds[k], SURE if name in ("main", "h1") else MARKED if name == "article" else FREE)
    out = [False] * len(elements)
    for k in range(1, len(elements)):
        parent, name, marked = elements[k]
        article[k] = k if name in ("article", "main") else article[parent]
        most = marked == MARKED and article[parent] > 0 and 2 * length[k] > length[article[parent]]
        out[k] = out[parent] or marked > holds[k] and not most
    return [b for b in found if not out[b.element]]


def smoothed(values: np.ndarray) -> np.ndarray:
    """A row of values by KERNEL, renormalised at the ends."""
    reach = len(KERNEL) // 2
    return (np.convolve(values, KERNEL) / np.convolve(np.ones(len(values)), KERNEL))[reach : reach + len(values)]


def weights(found: list[Block]) -> dict[int, float]:
    """Fused weight of each path."""
    order: dict[int, int] = {}
    path = np.array([order.setdefault(b.path, len(order)) for b in found])
    # blocks of one table row are one node
    node = np.cumsum([k == 0 or b.path != found[k - 1].path or b.node != found[k - 1].node for k, b in enumerate(found)]) - 1
    nodes = np.zeros((node[-1] + 1, 3))
    np.add.at(nodes, node, np.array([(b.own, len(PUNCTUATION.findall(b.text)), 0) for b in found], float))
    at = np.zeros(len(nodes), np.int64)
    at[node] = path
    count = np.bincount(at, minlength=len(order))
    fused = np.ones(len(order))
    for k, more in ((0, 0), (1, 1)):
        own = np.bincount(at, nodes[:, k], len(order)) / count
        smooth = np.bincount(at, smoothed(own[at]), len(order)) / count
        fused *= np.sqrt((own + more) * (smooth + more))
    if any(b.within for b in found):
        inside = np.zeros(len(order), bool)
        inside[path[[b.within for b in found]]] = True
        fused[~inside] *= OUTSIDE_SHARE
    return dict(zip(order, fused.tolist(), strict=True))


def main_text(page: str | None) -> str:
    found, paths = blocks(page or "")
    if not found:
        return ""
    weight = weights(found)
    heading = {p: (paths[paths[p][0]] if paths[p][1] == "a" else paths[p])[1] in HEADINGS for p in weight}
    body = [b for b in found if not heading[b.path]] or found
    mean = sum(weight[b.path] * b.own for b in body) / sum(b.own for b in body)
    content = {p for p, w in weight.items() if w >= THRESHOLD * mean}
    parents = {paths[p][0] for p in content}
    return "\n".join(b.text for b in found if b.path in content or heading[b.path] and paths[b.path][0] in parents)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""

    def work(batch):
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield {"page_id": part.column(0), "url": part.column(1), "text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)}

    return shared.by_batch(pages.select("page_id", "url", "html"), work, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(shared.table(spark, sf_dir, "pages"))
