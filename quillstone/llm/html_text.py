"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags, in one pass over it whose time grows with its length alone.
The first pass decides each block by where it stands (menus, headers, footers, sidebars, adverts, forms and
comments are boilerplate, and so is all that lies outside the article of a page that has one), then by link
density, length and stop-word density: blocks mostly of links are boilerplate, blocks rich in stop words are
text, short blocks and long ones of unknown vocabulary stay open. The second pass gives these the label of
the nearest decided blocks of the same container; text wins a tie. Where nothing is text yet, long open blocks are;
where nothing is decided, all are.

Edges: null or empty html gives an empty text; unclosed tags end with their container, an unclosed comment
with the page; comments, scripts and styles never give text; a ``<`` that begins no tag is text; repeated rows
are extracted alike; long pages are read whole.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillstone.llm.quality import STOP_WORDS
from quillstone.llm.storage import read, small_batches

# Fixed values of HTML: elements by their part in a page.
RAW = frozenset("script style noscript template iframe svg math canvas object audio video head textarea select option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|header|masthead|comments?|"
    r"disqus\w*|replies|reply|respond|cookies?\w*|consent|notices?|alert|newsletter|subscribe|signup|social\w*|share|sharing|related|recommend\w*|"
    r"popup|modal|toolbar|pagination|pager|widget)(?:$|[\s_-])",
    re.I,
)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: What may come next in a tag: its end, or a value in quotes. A quote elsewhere is a character like others.
STEP = re.compile(r"""=\s*(["'])|>""")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS, LINKS_INSIDE = 70, 200, 0.1, 0.3, 0.2, 0.8
STOPS = frozenset(STOP_WORDS)


class Block(NamedTuple):
    text: str
    link_chars: int
    context: str  # main, boiler or open


def _is_boilerplate(name: str, attributes: str) -> bool:
    if name in BOILERPLATE:
        return True
    if name in MAIN or name in HEADINGS or name in ("body", "html") or not attributes:
        return False  # a heading's class names the part that it heads, or how it looks
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if key.lower() == "hidden" or (value in ROLES if key.lower() == "role" else NAMES.search(value)):
            return True
    return False


class _Frame(NamedTuple):
    """An open block-level element, and by name the inline elements open in it (whether each is boilerplate)."""

    name: str
    boilerplate: bool
    main: bool
    inline: dict[str, list[bool]]


class _Open:
    """The open elements. Counters stand for them, so that no tag or text looks through them."""

    def __init__(self):
        self.frames = [_Frame("", False, False, {})]
        self.named: dict[str, int] = {}
        self.boilerplate = self.main = self.links = 0

    def context(self) -> str:
        return "boiler" if self.boilerplate else "main" if self.main else "open"

    def begin(self, name: str, boilerplate: bool) -> None:
        self.frames.append(_Frame(name, boilerplate, name in MAIN, {}))
        self.named[name] = self.named.get(name, 0) + 1
        self.boilerplate += boilerplate
        self.main += name in MAIN

    def end_last(self) -> None:
        frame = self.frames.pop()
        self.named[frame.name] -= 1
        self.boilerplate -= frame.boilerplate + sum(map(sum, frame.inline.values()))
        self.main -= frame.main
        self.links -= len(frame.inline.get("a", ()))

    def end(self, name: str) -> None:
        """Ends the innermost element of this name and all that is open in it; without one, nothing."""
        while self.named.get(name):
            last = self.frames[-1].name
            self.end_last()
            if last == name:
                break

    def begin_inline(self, name: str, boilerplate: bool) -> None:
        self.frames[-1].inline.setdefault(name, []).append(boilerplate)
        self.boilerplate += boilerplate
        self.links += name == "a"

    def end_inline(self, name: str) -> None:
        if own := self.frames[-1].inline.get(name):
            self.boilerplate -= own.pop()
            self.links -= name == "a"


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, white space inside each turned into single spaces."""
    blocks: list[Block] = []
    opened, parts = _Open(), []
    linked, at, end = 0, 0, len(page)
    never: set[str] = set()  # what does not come any more

    def after(what: str, start: int) -> int:
        """The place after the next ``what``, or -1; what was once sought in vain is not sought again."""
        if what in never:
            return -1
        found = page.find(what, start)
        if found < 0:
            never.add(what)
            return -1
        return found + len(what)

    def after_raw(name: str, start: int) -> int:
        if name in never:
            return -1
        found = _closing(name).search(page, start)
        if not found:
            never.add(name)
            return -1
        return found.end()

    def tag_end(start: int) -> tuple[int, int]:
        """Where a tag's attributes end and where the tag does; (-1, -1) without an end. A value in quotes may be of any length and hold
        any character. Where quotes leave no end up to the page's, this tag and all later ones end at the next ``>``."""
        place = start
        while "quoted" not in never:
            step = STEP.search(page, place)
            if step and not step[1]:
                return step.start(), step.end()
            place = after(step[1], step.end()) if step else -1
            if place < 0:
                never.add("quoted")
        stop = after(">", start)
        return stop - 1 if stop >= 0 else -1, stop

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, linked, opened.context()))
        parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if opened.links:
                linked += len(text.strip())

    while at < end:
        start = page.find("<", at)
        if start < 0:
            break
        say(page[at:start])
        at = start
        if page.startswith("<!--", at):
            stop = after("-->", at + 4)
            at = stop if stop >= 0 else end
            continue
        if page.startswith("<![CDATA[", at) and (stop := after("]]>", at)) >= 0:
            say(page[at + 9 : stop - 3])
            at = stop
            continue
        if page[at + 1 : at + 2] in ("!", "?") and (stop := after(">", at)) >= 0:
            at = stop
            continue
        m = None if ">" in never else TAG.match(page, at)
        until, stop = tag_end(m.end()) if m else (-1, -1)
        if stop < 0:
            say("<")
            at += 1
            continue
        name, attributes, at = m[2].lower(), page[m.end() : until], stop
        if name in RAW:
            if not m[1] and not attributes.endswith("/"):
                stop = after_raw(name, at)
                at = stop if stop >= 0 else (end if name != "head" else at)
        elif name == "br":
            parts.append(" ")
        elif name in INLINE:
            if m[1]:
                opened.end_inline(name)
            elif name not in VOID and not attributes.endswith("/"):
                opened.begin_inline(name, _is_boilerplate(name, attributes))
        else:
            flush()
            if m[1]:
                opened.end(name)
            elif name not in VOID and not attributes.endswith("/"):
                if opened.frames[-1].name == "p":  # an open paragraph ends where another block begins
                    opened.end_last()
                opened.begin(name, _is_boilerplate(name, attributes))
    say(page[at:])
    flush()
    return blocks


@functools.cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOPS for w in words) / len(words)


def first_pass(block: Block, has_main: bool) -> bool | None:
    """Text (True), boilerplate (False), or undecided (None)."""
    if block.context == "boiler" or (has_main and block.context == "open"):
        return False
    if block.link_chars > (LINKS if block.context == "open" else LINKS_INSIDE) * len(block.text):
        return False
    if len(block.text) < SHORT:
        return False if block.link_chars and block.context == "open" else None
    stops = stop_density(block.text)
    return True if stops >= STOP_HIGH or (stops >= STOP_LOW and len(block.text) > LONG) else None


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided ones of their context; text wins a tie.

    In a context without text, the undecided blocks of some length are taken for it: its language is not known.
    """
    n, labels = len(blocks), list(labels)
    rich = {b.context for b, label in zip(blocks, labels, strict=True) if label}
    for i, b in enumerate(blocks):
        if labels[i] is None and b.context not in rich and len(b.text) >= SHORT:
            labels[i] = True
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for out, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[str, tuple[int, bool]] = {}
        for i in order:
            out[i] = last.get(blocks[i].context)
            if labels[i] is not None:
                last[blocks[i].context] = (i, labels[i])
    out = []
    for i, label in enumerate(labels):
        if label is None:
            near = sorted((abs(j - i), not good) for x in (before[i], after[i]) if x for j, good in [x])
            label = not near[0][1] if near else blocks[i].context != "boiler"  # nothing speaks against it
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    has_main = any(b.context == "main" for b in blocks)
    labels = second_pass(blocks, [first_pass(b, has_main) for b in blocks])
    return "\n".join(b.text for b, good in zip(blocks, labels, strict=True) if good)


def extract(df: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the html column replaced by the main text. Rows stay where they are: no shuffle."""
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (column, out)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(len(names))], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), texts], [*names, out])

    return df.select(*names, column).mapInArrow(run, StructType([*kept, StructField(out, StringType())]))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
