"""Main text of web pages: flat text blocks, shallow features of neighbours, a decision tree."""

from __future__ import annotations

import html
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decision_tree import Node, grow, positive

# HTML element names and words of class and id attributes.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
RAW = ("script", "style", "textarea", "title")  # up to their end tag or the end of the page
SILENT = frozenset(("template", "svg", "iframe", "button", "select", "noscript"))  # up to their end tag, if there is one
AROUND = frozenset("nav header footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Words that mostly name what stands beside an article, and words that name parts of articles as well.
_STRONG = r"ads?|advert\w*|adslot|sponsor\w*|promo\w*|sidebar|menu|nav\w*|breadcrumbs?|footer|masthead|comments?|comment-?list|disqus|replies|respond|cookies?|consent|notices?|popup|modal|newsletter|subscribe|signup|login|related|recommended|teasers?|pagination|pager|copyright"
STRONG = regex.compile(rf"(?<![a-z])(?<!has-|with-|no-)({_STRONG})(?![a-z])", regex.I)
# A whole class name that is such a word, or such a word and the name of a part: not a layout that mentions it.
BOXED = regex.compile(rf"(?<!\S)({_STRONG})(?:[-_]{{1,2}}(?:area|block|body|box|card|content|entry|item|list|post|section|wrapper))?(?!\S)", regex.I)
BESIDE = frozenset("nav footer aside menu dialog".split())
# A line of rights under a page's text.
RIGHTS, RIGHTS_WORDS = regex.compile(r"^(?:©|\(c\)|copyright\b)|\ball rights reserved\b", regex.I), 25
WEAK = regex.compile(r"(?<![a-z])(?<!has-|with-)(banner|side|header|reply|alert|overlay|share|sharing|social|widget|toolbar|legal|disclaimer)(?![a-z])", regex.I)

_TOKEN = regex.compile(
    r"<!--.*?(?:-->|$)|(?P<start><(?P<raw>" + "|".join(RAW) + r")(?=[\s>/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>).*?(?:</(?P=raw)\s*>|$)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>",
    regex.S | regex.I,
)
_NAMED = regex.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", regex.I)
_HIDDEN = regex.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", regex.I)
_TELLING = regex.compile(r"class|id|role|hidden|style|data-label", regex.I)
_CLOSED = regex.compile(r"/\s*>?$")
_UNQUOTED = regex.compile(r"=\s*[^\s\"'>]+>?$")
_LABEL = regex.compile(r'data-label="([01])"')


@dataclass(slots=True)
class TextBlock:
    """Text between two block borders, and what surrounds it."""

    text: str
    words: int
    linked: int
    around: int
    strong: int
    weak: int
    article: int
    heading: int
    label: int

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def self_closed(tag: str) -> bool:
    """Whether a start tag, or its attributes, end in a slash that is no part of an unquoted value."""
    return bool(_CLOSED.search(tag)) and not _UNQUOTED.search(tag)


def markup(page: str) -> list[tuple[regex.Match, int]]:
    """The tags and comments outside of silent elements, each with the place where text goes on after it.

    An end tag belongs to the last open silent element of its name. A self-closed svg is empty, and so
    are self-closed elements inside one; of a silent element that is never closed only the tag is left out.
    """
    found: list[tuple[regex.Match, int]] = []
    opened: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    at = 0
    while match := _TOKEN.search(page, at):
        at = match.end()
        if match["raw"] is not None:
            if opened.get("svg") and self_closed(match["start"]):
                at = match.end("start")
        elif match["name"] is not None and (name := match["name"].lower()) in SILENT:
            if match["close"]:
                if opened.get(name):
                    ends[opened[name].pop()] = at
            elif not (name == "svg" and self_closed(match["attrs"])):
                opened.setdefault(name, []).append(match.start())
        found.append((match, at))
    if not ends:
        return found
    kept, until = [], 0
    for match, stop in found:
        if match.start() >= until:
            until = ends.get(match.start(), stop)
            kept.append((match, until))
    return kept


def text_blocks(page: str) -> list[TextBlock]:
    """The page as flat blocks. Open elements are kept on a stack, which an end tag cuts back to its match."""
    blocks: list[TextBlock] = []
    stack: list[tuple[str, int, int, int, int, int, int, int]] = []  # name, around, strong, weak, article, heading, label, boxed
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked, at = 0, 0

    def end_block() -> None:
        nonlocal linked
        if not parts:
            linked = 0
            return
        text = "".join(parts)
        parts.clear()
        words = (html.unescape(text) if "&" in text else text).split()
        if words:
            text = " ".join(words)
            block = TextBlock(text, len(words), linked, *(stack[-1][1:7] if stack else (0, 0, 0, 0, 0, -1)))
            if not block.article and block.words <= RIGHTS_WORDS and RIGHTS.search(text):
                block.strong += 1
            blocks.append(block)
        linked = 0

    def close(name: str) -> None:
        while stack:
            open_name = stack.pop()[0]
            opened[open_name] -= 1
            if open_name == name:
                break

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if opened.get("a"):
                linked += len(text.split())

    for match, stop in markup(page):
        start = match.start()
        if start > at:
            add(page[at:start])
        at = stop
        name = match["name"]
        if name is None:
            if match["raw"] is not None and match["raw"].lower() == "title":
                end_block()
            continue
        name = name.lower()
        if name in SILENT or name == "head":  # a head has no text but that of its own silent elements
            if name in ("head", "select"):
                end_block()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            end_block()
        if match["close"]:
            if opened.get(name):
                close(name)
            continue
        if name in VOID:
            continue
        if name in ("p", "li", "td", "tr", "dt", "dd", "option") and any(open_name == name for open_name, *_ in stack[-4:]) and stack[-1][0] not in ("ul", "ol", "table", "tbody", "dl"):
            close(name)  # an unclosed sibling ends here, with what is still open inside it
        _, around, strong, weak, article, heading, label, boxed = stack[-1] if stack else ("", 0, 0, 0, 0, 0, -1, 0)
        inside = name == "article" or name == "main"
        if inside and not article and (name == "main" or not boxed):  # the layout around the outermost article says nothing of its parts
            around = strong = weak = boxed = 0
        attrs = match["attrs"]
        boxed += name in BESIDE
        if attrs and _TELLING.search(attrs):
            named = " ".join(a or b or c for a, b, c in _NAMED.findall(attrs))
            if named and name not in ("body", "html"):
                whole = bool(STRONG.search(named)) and bool(BOXED.search(named))
                boxed += whole
                strong += whole if inside else bool(STRONG.search(named))
                weak += not inside and bool(WEAK.search(named))
            strong += bool(_HIDDEN.search(attrs))
            marked = _LABEL.search(attrs)
            label = int(marked[1]) if marked else label
        opened[name] = opened.get(name, 0) + 1
        stack.append((name, around + (name in AROUND and not (name == "header" and article)), strong, weak, article or int(inside), int(name in ("h1", "h2", "h3", "h4", "h5", "h6")) or heading, label, boxed))
    add(page[at:])
    end_block()
    return blocks


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "around", "strong", "weak", "article", "heading", "has article", "words before links", "heading before links", "words after links")


def features(blocks: list[TextBlock]) -> list[list[float]]:
    """``FEATURES`` of each block: word counts and link densities of it and its neighbours, and where it stands.

    The neighbours of a run of mostly linked blocks are the blocks around the run: a list of sources stands
    between paragraphs, a list of other pages under its heading.
    """
    if not blocks:
        return []
    edge = TextBlock("", 0, 0, 0, 0, 0, 0, 0, -1)
    has_article = float(any(b.article for b in blocks))
    padded = [edge, *blocks, edge]
    above, below = [edge] * len(padded), [edge] * len(padded)
    for i in range(1, len(padded)):
        above[i] = above[i - 1] if padded[i - 1].density >= 0.5 else padded[i - 1]
    for i in range(len(padded) - 2, -1, -1):
        below[i] = below[i + 1] if padded[i + 1].density >= 0.5 else padded[i + 1]
    rows = []
    for i, own in enumerate(blocks, 1):
        before, after = padded[i - 1], padded[i + 1]
        rows.append([own.words, own.density, before.words, before.density, after.words, after.density, float(own.around > 0), float(own.strong > 0), float(own.weak > 0), float(own.article > 0), float(own.heading), has_article, above[i].words, float(above[i].heading), below[i].words])
    return rows


def labelled_pages(count: int = 800, seed: int = 5) -> list[str]:
    """The labelled table: small pages by rule, whose ``data-label`` says whether an element's text is main text.

    Half have an article element, some only a main, the others neither. What stands beside the text is
    marked by elements, by class words or not at all; class words also stand on parts of the text. Link
    lists and their headings stand inside articles too, without a mark; linked sources without a heading are text.
    """
    rng = random.Random(seed)
    words = lambda low, high: " ".join("text" for _ in range(rng.randint(low, high)))
    link = lambda low, high: f"<a href=x>{words(low, high)}</a>"
    many = lambda low, high, make: "".join(make() for _ in range(rng.randint(low, high)))
    pick = rng.choice
    strong = lambda: pick(["ad", "advert", "sponsored", "promo", "comments", "newsletter", "related", "cookie-notice", "notice", "sidebar", "menu", "footer"])
    weak = lambda: pick(["side-note", "legal", "share", "social", "alert", "widget", "banner"])

    def text() -> str:
        kind = rng.random()
        if kind < 0.55:
            return f"<p>{words(10, 90)}</p>" if kind < 0.4 else f"<p>{words(8, 50)} {link(1, 3)} {words(3, 30)}</p>"
        if kind < 0.72:
            return f"<p>{words(1, 6)}</p>"
        if kind < 0.80:
            return f"<h2>{words(1, 6)}</h2><p>{words(12, 70)}</p>"
        if kind < 0.86:
            return "<ul>" + many(2, 5, lambda: f"<li>{words(1, 14)}</li>") + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{words(5, 40)}</blockquote>"
        if kind < 0.95:
            return f"<p>{link(3, 7)}</p><p>{words(10, 40)}</p>"
        return f'<div class="{weak()}">{words(12, 50)}</div>'

    def box() -> str:
        """What stands inside an article and is no part of it."""
        return pick([
            lambda: f'<h3 data-label="0">{words(1, 4)}</h3><ul data-label="0">' + many(2, 6, lambda: f"<li>{link(2, 9)}</li>") + "</ul>",
            lambda: f'<div class="{strong()}" data-label="0">{words(4, 40)}</div>',
            lambda: f'<div class="{weak()}" data-label="0">' + many(2, 4, lambda: f"<p>{link(1, 2)}</p>") + "</div>",
            lambda: f'<form data-label="0"><p>{words(3, 15)}</p></form>',
            lambda: f'<aside data-label="0"><p>{words(5, 40)}</p></aside>',
        ])()

    def beside(bare: bool) -> str:
        kinds = [
            lambda: "<nav><ul>" + many(3, 7, lambda: f"<li>{link(1, 3)}</li>") + "</ul></nav>",
            lambda: "<div>" + many(2, 6, lambda: f"<p>{link(1, 8)}</p>") + "</div>",
            lambda: f'<div class="{strong()}">{many(1, 3, lambda: f"<p>{words(4, 40)}</p>")}</div>',
            lambda: f"<footer>{words(3, 14)}{pick(['', ' ' + link(1, 3)])}</footer>",
            lambda: f"<aside><p>{words(5, 40)}</p></aside>",
            lambda: f"<h3>{words(1, 4)}</h3><ul>" + many(2, 6, lambda: f"<li>{link(2, 9)}</li>") + "</ul>",
        ]
        if bare:  # nothing but the place tells these from the text
            kinds += [lambda: f"<div>{words(5, 30)}</div>", lambda: f"<div><p>{words(5, 30)}</p></div>"]
        else:
            kinds += [lambda: f"<div>{words(1, 6)}</div>"]
        return f'<div data-label="0">{pick(kinds)()}</div>'

    pages = []
    for number in range(count):
        kind = number % 4  # 0 and 1: article, 2: main, 3: neither
        parts = [f"<h1>{words(2, 10)}</h1>"] * (rng.random() < 0.9) + [text() for _ in range(rng.randint(1, 9))]
        if kind == 3:
            parts = [part for part in parts if len(part.split()) > 6] or [f"<p>{words(30, 60)}</p>"]
        if kind < 3 and rng.random() < 0.3:
            sources = many(2, 4, lambda: f"<li>{link(2, 9)}</li>")
            parts.insert(rng.randint(1, len(parts)), f"<p>{words(8, 60)}</p><ul>{sources}</ul><p>{words(8, 60)}</p>")
        for _ in range(rng.randint(0, 2) if kind < 3 else 0):
            parts.insert(rng.randint(1, len(parts)), box())
        body = "".join(parts)
        own = {0: f'<article data-label="1">{body}</article>', 1: f'<article data-label="1">{body}</article>', 2: f'<main data-label="1">{body}</main>', 3: f'<div data-label="1">{body}</div>'}[kind]
        pages.append("<body>" + many(0, 3, lambda: beside(kind < 3)) + own + many(0, 3, lambda: beside(kind < 3)) + "</body>")
    return pages


def train(pages: list[str] | None = None) -> Node:
    rows, labels = [], []
    for page in pages or labelled_pages():
        blocks = text_blocks(page)
        for block, row in zip(blocks, features(blocks), strict=True):
            if block.label >= 0:
                rows.append(row)
                labels.append(block.label)
    return grow(np.array(rows, float), np.array(labels, float), depth=9, least=4)


def main_text(page: str | None, tree: Node) -> str:
    blocks = text_blocks(page or "")
    return "\n\n".join(block.text for block, row in zip(blocks, features(blocks), strict=True) if positive(tree, row))


def extract(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The whole html is read and no block is cut. A null or empty page gives an empty text. Scripts, styles,
    textareas, titles and comments that are never closed end with the page; of other elements without an
    end tag the text is read. Repeated pages give repeated rows; page_id and url may be null
    and other columns are not read. An empty table gives no rows. ``labelled`` replaces the labelled
    table that the tree learns from.
    """
    tree = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page, tree) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, f"page_id {dict(source.dtypes)['page_id']}, url string, text string, n_chars long")
