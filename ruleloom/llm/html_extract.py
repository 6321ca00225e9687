"""Main text of web pages: blocks labelled content or boilerplate by a minimum cut.

A page is cut into blocks at its block-level tags.  A linear classifier gives each
block the odds of being content, from the elements it stands in, their classes and
roles, its links and its sentences; the logarithmic losses of the two labels are its
capacities to the terminals.  Blocks that follow one another are joined by edges
whose capacity falls with the number of tree steps between them, as are successive
blocks of one parent.  The maximum flow finds the labelling of least total cost.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mincut import minimum_cut
from .word_bpe import in_small_batches
from .worker import begin

# Names of HTML elements, and words that authors put in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title noscript template svg math iframe object canvas audio video select textarea button datalist".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEVER_TAGS = frozenset("nav aside footer menu dialog search".split())
NEVER_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored breadcrumb breadcrumbs comment comments disqus reply replies respond cookie cookies consent gdpr newsletter subscribe subscription nav navbar navigation navigationbar menu menubar related share sharing social popup modal overlay widget widgets login signin signup pagination pager toolbar complementary contentinfo footer sidebar banner alert alertdialog dialog notice notices notification notifications promo promotion".split())
#: Words beside which such a word still names the whole element.
PLAIN_WORDS = frozenset("area bar block body bottom box button buttons col column container footer form group header holder icons inner item items left link links list main module outer page panel post posts right row section site slot top unit wrap wrapper zone".split())
MAYBE_TAGS = frozenset(["header", "form"])
MAYBE_WORDS = frozenset("header masthead search form topbar".split())
MAIN_TAGS = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())

#: Weights of the classifier, in log-odds of content.
W_NEVER, W_MAYBE, W_MAIN, W_TAG, W_HINT = -7.0, -3.0, 4.0, 1.0, -0.8
W_WORDS, W_LINKS, W_SENTENCE, W_HEADING, W_BIAS = 0.9, -3.5, 1.0, 1.8, -2.5
#: Capacity of an edge between blocks one tree step apart; more steps divide it.
SMOOTH = 1.0
SCALE = 1000

_tag_name = re.compile(r"[a-zA-Z][^\s/>]*+")
_gap = re.compile(r"[\s/]*+")
_attribute_name = re.compile(r"=?[^\s/>=]*+")
_equals = re.compile(r"\s*+=\s*+")
_unquoted = re.compile(r"[^\s>]*+")
_name = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_not_shown = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Element:
    """``near`` is the marker of the nearest marked element from here up, ``near_tag`` its tag; ``inner``: an article lies between."""

    tag: str
    parent: int
    depth: int
    hidden: bool = False
    never: bool = False
    hint: bool = False
    near: str = ""
    near_tag: str = ""
    inner: bool = False
    main: bool = False


@dataclass
class Block:
    parent: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    text: str = ""


class Scanner:
    """Reads tags of a page; every character is passed a bounded number of times, whatever the page."""

    def __init__(self, page: str):
        self.page = page
        self.unclosed: set[str] = set()  # quotes that don't occur any more

    def attributes(self, at: int) -> tuple[int, dict[str, str]] | None:
        """Attributes from ``at`` on and where their tag ends; None if it never does.

        A quote counts only behind an equals sign; the value of one that is never
        closed ends with the tag.
        """
        page, found = self.page, {}
        while True:
            at = _gap.match(page, at).end()
            if at >= len(page):
                return None
            if page[at] == ">":
                return at + 1, found
            m = _attribute_name.match(page, at)
            name, value, at = m.group().lower(), "", m.end()
            if m := _equals.match(page, at):
                at = m.end()
                quote = page[at : at + 1]
                if quote in ('"', "'"):
                    end = -1 if quote in self.unclosed else page.find(quote, at + 1)
                    if end < 0:
                        self.unclosed.add(quote)
                        if (end := page.find(">", at + 1)) < 0:
                            return None
                        value, at = page[at + 1 : end], end
                    else:
                        value, at = page[at + 1 : end], end + 1
                else:
                    m = _unquoted.match(page, at)
                    value, at = m.group(), m.end()
            found.setdefault(name, value)

    def behind_raw(self, tag: str, at: int) -> int:
        """Where the content that is no markup, and its end tag, end."""
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
        end = -1 if m is None else self.page.find(">", m.end())
        return len(self.page) if end < 0 else end + 1


def _marks(tag: str, attributes: dict[str, str]) -> tuple[str, bool]:
    """What an element's tag and names say of it, and whether they hint at boilerplate without saying so.

    A name made of words for boilerplate and plain ones, as "cookie-notice" or
    "related-posts", says so; beside other words, as in "notice-of-change", it is a hint.
    """
    if tag in ("html", "body"):
        return "", False
    never, hint, every = tag in NEVER_TAGS, False, set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".split():
        words = [w.lower() for w in _name.findall(name)]
        every.update(words)
        if not NEVER_WORDS.isdisjoint(words):
            if words[-1] not in MAIN_WORDS - PLAIN_WORDS and all(w in NEVER_WORDS or w in PLAIN_WORDS or w in MAIN_WORDS for w in words):
                never = True
            else:
                hint = True
    if never:
        return "never", False
    if tag in MAIN_TAGS or every & MAIN_WORDS:
        return "main", hint
    return "maybe" if tag in MAYBE_TAGS or every & MAYBE_WORDS else "", hint


def _element(tag: str, parent: int, above: Element, attributes: dict[str, str]) -> Element:
    marker, hint = _marks(tag, attributes)
    hidden = above.hidden or tag in HIDDEN or "hidden" in attributes or bool(_not_shown.search(attributes.get("style", "")))
    here = tag in MAIN_TAGS
    near = (marker, tag, False) if marker else (above.near, above.near_tag, above.inner or here)
    return Element(tag, parent, above.depth + 1, hidden, above.never or marker == "never", hint or above.hint and marker != "main", *near, above.main or here)


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements of a page and its blocks of text in order."""
    elements = [Element("", -1, 0)]
    blocks: list[Block] = []
    stack, block_stack = [0], [0]
    opened: Counter[str] = Counter()
    current: Block | None = None
    scanner = Scanner(page)

    def say(text: str) -> None:
        nonlocal current
        if not text or elements[stack[-1]].hidden:
            return
        if current is None:
            current = Block(block_stack[-1], heading=elements[block_stack[-1]].tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
            blocks.append(current)
        text = html.unescape(text)
        current.parts.append(text)
        if opened["a"]:
            current.linked += len(text)

    def close(at: int) -> None:
        """Ends the element at this place of the stack and all in it; an inline one ends alone where blocks stand in it."""
        nonlocal current
        ending = stack[at:]
        if elements[stack[at]].tag not in BLOCK and block_stack[-1] > stack[at]:
            ending = stack[at : at + 1]
            del stack[at]
        else:
            del stack[at:]
        for i in ending:
            opened[elements[i].tag] -= 1
            if elements[i].tag in BLOCK:
                current = None
        while block_stack[-1] and block_stack[-1] >= ending[0] and ending[-1] >= block_stack[-1]:
            block_stack.pop()

    def innermost(tags: set[str]) -> int | None:
        return next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag in tags), None)

    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        following = page[begin + 1 : begin + 2]
        name = _tag_name.match(page, begin + 1 + (following == "/"))
        if name is None and following not in ("!", "?", "/"):
            say(page[at : begin + 1])  # a sign, not a tag
            at = begin + 1
            continue
        say(page[at:begin])
        if name is None:
            if page.startswith("<!--", begin):
                end, skip = page.find("-->", begin + 4), 3
            elif page.startswith("<![CDATA[", begin):
                end, skip = page.find("]]>", begin + 9), 3
                say(page[begin + 9 : end if end >= 0 else n])
            else:
                end, skip = page.find(">", begin), 1
            at = n if end < 0 else end + skip
            continue
        tag = name.group().lower()
        read = scanner.attributes(name.end())
        if read is None:
            break  # a tag that never ends: the page was cut off in it
        at, attributes = read
        if tag == "br":
            say(" ")
            continue
        if following == "/":
            if opened[tag] > 0:
                close(innermost({tag}))
            if tag in BLOCK:
                current = None
            continue
        if tag in BLOCK:
            current = None
            if elements[block_stack[-1]].tag == "p":
                close(innermost({"p"}))
        if tag in CLOSED_BY and any(opened[x] > 0 for x in CLOSED_BY[tag]):
            k = innermost(CLOSED_BY[tag] | {"ul", "ol", "dl", "table", "menu"})
            if elements[stack[k]].tag in CLOSED_BY[tag]:
                close(k)
        if tag in VOID:
            continue
        if tag in RAW:
            at = scanner.behind_raw(tag, at)
            continue
        if page[at - 2] == "/" and tag not in BLOCK and tag != "a":
            continue
        elements.append(_element(tag, stack[-1], elements[stack[-1]], attributes))
        stack.append(len(elements) - 1)
        opened[tag] += 1
        if tag in BLOCK:
            block_stack.append(len(elements) - 1)
    kept = []
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            kept.append(b)
    return elements, kept


def log_odds(elements: list[Element], block: Block) -> float:
    """The classifier: log-odds that the block is content."""
    e = elements[block.parent]
    decided = "never" if e.never else e.near
    if decided == "maybe" and e.main and not e.inner:  # within the article: its own heading, or a form to fill in
        decided = "main" if e.near_tag == "header" else "never"
    z = W_BIAS + {"never": W_NEVER, "maybe": W_MAYBE, "main": W_MAIN}.get(decided, 0.0) + W_TAG * e.main + W_HINT * e.hint
    words = len(block.text.split())
    z += W_WORDS * min(math.log1p(words), 4.0) + W_HEADING * block.heading
    z += W_LINKS * min(1.0, block.linked / max(1, len(block.text)))
    return z + W_SENTENCE * (words > 5 and block.text[-1] in ".!?…。！？\"'”’)»")


def _steps(elements: list[Element], a: int, b: int) -> int:
    """Tree steps between two elements."""
    steps = 0
    while a != b:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        steps += 1
    return steps


def graph(elements: list[Element], blocks: list[Block]) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """Capacities from the source, to the sink, and between blocks."""
    odds = [max(-30.0, min(30.0, log_odds(elements, b))) for b in blocks]
    source = [round(SCALE * math.log1p(math.exp(z))) for z in odds]
    sink = [round(SCALE * math.log1p(math.exp(-z))) for z in odds]
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, round(SCALE * SMOOTH / (1 + _steps(elements, blocks[i - 1].parent, b.parent)))))
        container = elements[b.parent].parent if elements[b.parent].parent >= 0 else b.parent
        if container in last and last[container] != i - 1:
            edges.append((last[container], i, round(SCALE * SMOOTH / 2)))
        last[container] = i
    return source, sink, edges


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line."""
    elements, blocks = parse(page or "")
    return "\n".join(b.text for b, content in zip(blocks, minimum_cut(*graph(elements, blocks)), strict=True) if content)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of every row, from its whole HTML.

    A null or empty page, or one without content, has the empty text.  A very long
    page is read whole, in time that grows with its length.  Ids and
    addresses pass through, null or not; repeated rows give repeated rows; other
    columns are not read.  Pages are not shuffled.
    """
    fields = [T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            schema = pa.schema([pa.field("id", batch.schema.field(0).type), pa.field("url", batch.schema.field(1).type), pa.field("text", pa.string())])
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (main_text(x.as_py()) for x in batch.column(2)), strict=True)
            yield from in_small_batches(rows, schema, lambda r: len(r[2]) + 64)

    out = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string")).mapInArrow(run, T.StructType(fields))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
