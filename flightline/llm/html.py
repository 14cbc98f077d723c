"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks of text at block-level tags. Each block is described by its word
count and link density, those of the blocks before and after it, and by where it stands (inside an
article, inside a container that names itself a menu, advert, comment list and so on). A decision
tree trained on a small labelled table of such blocks decides which blocks are main text.

Scripts, styles, page heads, comments in the markup and form controls are never text. A head ends at its
end tag or the first block-level tag, a control without an end tag at the next block-level tag. Character
references are decoded, white space in a block becomes one space, blocks are trimmed and joined in
page order by an empty line; nothing else is dropped or cut.

Results for odd input: a null, empty or markup-free page gives the empty text, or its only block if
that reads as prose; unclosed tags end where an enclosing block ends; an unclosed script, style,
title, text area, inline frame or comment runs to the end of the page; pages of any length are read whole; repeated rows, null ids and null
URLs are carried through; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightline.llm.forest import Node, evaluate, grow

# Fixed names of HTML elements.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw text up to the end tag or, without one, the end of the page.
HIDDEN_TAGS = "script style title textarea iframe".split()
#: Hidden up to the end tag or, without one, the next block-level tag; the second kind does not nest.
SHUT_TAGS = frozenset("noscript template select button object svg canvas".split())
FLAT_TAGS = frozenset("noscript select button".split())

# Fixed names: elements and words in class, id or role that announce text beside the article.
BESIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
BESIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment "
    "comments complementary consent contentinfo cookie cookies copyright disclaimer discussion "
    "disqus footer gdpr header links login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup promo promoted promotion recommended "
    "related replies reply responses search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription teaser toolbar topbar widget widgets".split()
)
ARTICLE_TAGS = frozenset(["article", "main"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<hidden>{'|'.join(HIDDEN_TAGS)})\b[^>]*>.*?(?:</(?P=hidden)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-z!?][^>]*>",
    re.IGNORECASE | re.DOTALL,
)
_SHUT = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in SHUT_TAGS}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+")

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after",
    "in_article", "page_has_article", "beside", "heading",
)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_article: bool
    beside: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _announces_beside(attributes: str) -> bool:
    for groups in _NAMED.findall(attributes):
        if any(w.lower() in BESIDE_WORDS for w in _WORD.findall("".join(groups))):
            return True
    return False


def _ends(page: str, name: str) -> dict[int, int]:
    """Start of every closed element of a name and the end of its end tag."""
    found: dict[int, int] = {}
    starts: list[int] = []
    for tag in _SHUT[name].finditer(page):
        if not tag[1]:
            if name in FLAT_TAGS:
                starts.clear()
            starts.append(tag.start())
        elif starts:
            found[starts.pop()] = tag.end()
    return found


def blocks_of(page: str | None) -> list[Block]:
    """Flat text blocks of a page in page order; blocks without a character are left out."""
    page = page or ""
    found: list[Block] = []
    #: Open elements: name, inside an article, beside the article.
    open_: list[tuple[str, bool, bool]] = [("", False, False)]
    parts: list[str] = []
    linked: list[str] = []
    in_link = muted = False
    ends: dict[str, dict[int, int]] = {}

    def text(piece: str) -> None:
        if piece and not muted:
            parts.append(piece)
            if in_link:
                linked.append(piece)

    def end_block() -> None:
        nonlocal in_link
        joined = " ".join(entities.unescape("".join(parts)).split())
        if joined:
            name, article, beside = open_[-1]
            words = len(joined.split())
            links = len(entities.unescape(" ".join(linked)).split())
            heading = any(n in ("h1", "h2", "h3", "h4", "h5", "h6") for n, _, _ in open_[-2:])
            found.append(Block(joined, words, min(links, words), article, beside, heading))
        parts.clear()
        linked.clear()

    at = 0
    while token := _TOKEN.search(page, at):
        text(page[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            if token["hidden"]:
                text(" ")
            continue
        if name == "head":
            muted = not token["close"]
        elif name in SHUT_TAGS:
            if token["close"]:
                muted = False
            elif not token["rest"].endswith("/"):
                if name not in ends:
                    ends[name] = _ends(page, name)
                closed = ends[name].get(token.start())
                text(" ")
                if closed:
                    at = closed
                else:
                    muted = True
        elif name == "a":
            in_link = not token["close"]
        elif name == "br":
            text(" ")
        elif name in BLOCK_TAGS or "=" in token["rest"]:
            block = name in BLOCK_TAGS
            if block:
                end_block()
                in_link = muted = False
            if token["close"]:
                depth = next((d for d in range(len(open_) - 1, 0, -1) if open_[d][0] == name), 0)
                if depth:
                    del open_[depth:]
            elif name not in VOID_TAGS and not token["rest"].endswith("/") and block:
                if open_[-1][0] == "p" or (name == "li" and open_[-1][0] == "li"):
                    open_.pop()
                _, article, beside = open_[-1]
                named = name not in ("html", "body", *ARTICLE_TAGS) and _announces_beside(token["rest"])
                # A header inside an article holds its title; elsewhere it is the page's banner.
                aside = name in BESIDE_TAGS or (name == "header" and not article)
                open_.append((name, article or name in ARTICLE_TAGS, beside or aside or named))
    text(page[at:])
    end_block()
    return found


def features_of(blocks: Sequence[Block]) -> list[tuple[float, ...]]:
    """A row of ``FEATURES`` for every block; a missing neighbour has no words and no links."""
    article = float(any(b.in_article for b in blocks))
    nothing = Block("", 0, 0, False, False, False)
    padded = [nothing, *blocks, nothing]
    return [
        (
            float(b.words), b.density, float(before.words), before.density, float(after.words),
            after.density, float(b.in_article), article, float(b.beside), float(b.heading),
        )
        for before, b, after in zip(padded, blocks, padded[2:], strict=False)
    ]


def labelled_pages() -> list[tuple[str, list[int]]]:
    """The small labelled table: pages in several layouts with a label for each of their blocks."""

    def prose(n: int) -> str:
        return " ".join(f"word{i}" for i in range(n)) + "."

    def links(n: int, width: int = 1) -> tuple[str, list[int]]:
        inside = "".join(f"<li><a href='/{i}'>{prose(width)}</a></li>" for i in range(n))
        return f"<ul>{inside}</ul>", [0] * n

    def paragraphs(lengths: Sequence[int]) -> tuple[str, list[int]]:
        return "".join(f"<p>{prose(n)}</p>" for n in lengths), [1] * len(lengths)

    lengths = ((1, 40, 3), (120, 2, 60), (8, 15, 200), (30,), (1,), (500, 12, 1, 1), (25, 25, 25, 4))
    pages = []
    for k, some in enumerate(lengths):
        menu, menu_labels = links(3 + k, 1 + k % 3)
        body, body_labels = paragraphs(some)
        title = f"<h1>{prose(3 + 2 * k)}</h1>"
        advert = f"<div class='ad'>{prose(5 + 9 * k)}</div>"
        comments = f"<section id='comments'><p>{prose(6 + 11 * k)}</p><p>{prose(2 + k)}</p></section>"
        footer = f"<footer>{prose(4 + 5 * k)}</footer>"
        notice = f"<div class='cookie-notice'>{prose(10 + 6 * k)}</div>"
        side, side_labels = links(4, 4 + k)
        inner = f"<p>See {prose(12)} <a href='/x'>{prose(2 + k)}</a></p>"
        pages += [
            # An article element with a menu, an advert and a footer around it.
            (
                f"<nav>{menu}</nav>{advert}<article>{title}{body}{inner}</article>{footer}",
                [*menu_labels, 0, 1, *body_labels, 1, 0],
            ),
            # Text beside the article without any name, reader comments inside it.
            (
                f"<div>{prose(7 + 4 * k)}</div><main>{title}{body}{comments}</main><div>{prose(9 + k)}</div>",
                [0, 1, *body_labels, 0, 0, 0],
            ),
            # Nothing but an article, with a paragraph that is all link.
            (
                f"<article>{body}<p><a href='/x'>{prose(3 + 2 * k)}</a></p>{body}</article>",
                [*body_labels, 1, *body_labels],
            ),
            # Prose without any container.
            (f"<h2>{prose(4 + k)}</h2><p>{prose(16 + 30 * k)}</p><p>{prose(5 + k)}</p>", [1, 1, 1]),
            (f"<p>{prose(14 + 40 * k)}</p>", [1]),
            (f"<div>{prose(2 + k)}</div><div>{menu}</div><p>{prose(1 + k)}</p>", [0, *menu_labels, 0]),
            # Plain containers: only words and links tell.
            (
                f"<div>{menu}</div><div><h1>{prose(6 + k)}</h1><p>{prose(45 + 20 * k)}</p>"
                f"<p>{prose(30 + 9 * k)}</p></div><div>{side}</div>",
                [*menu_labels, 1, 1, 1, *side_labels],
            ),
            # Notices and sidebars around plain containers.
            (
                f"{notice}<div><p>{prose(50 + 10 * k)}</p><p>{prose(22 + k)}</p></div>"
                f"<aside>{side}<p>{prose(20 + 4 * k)}</p></aside>{footer}",
                [0, 1, 1, *side_labels, 0, 0],
            ),
        ]
    return pages


@functools.cache
def trained_tree() -> Node:
    rows, labels = [], []
    for page, marks in labelled_pages():
        blocks = blocks_of(page)
        if len(blocks) != len(marks):
            raise ValueError("a labelled page has another number of blocks than labels")
        rows += features_of(blocks)
        labels += marks
    return grow(np.array(rows), np.array(labels, float), depth=8)


def main_text(page: str | None, tree: Node | None = None) -> str:
    tree = tree or trained_tree()
    blocks = blocks_of(page)
    kept = [b.text for b, row in zip(blocks, features_of(blocks), strict=True) if evaluate(tree, row) > 0.5]
    return "\n\n".join(kept)


def extract_text(
    pages: DataFrame, *, html: str = "html", keep: Sequence[str] = ("page_id", "url"), text: str = "text"
) -> DataFrame:
    """``keep`` columns and the main text of every page."""
    tree = trained_tree()
    chosen = pages.select(*keep, F.col(html).alias("_html"))
    schema = T.StructType(
        [*[f for f in chosen.schema.fields if f.name != "_html"], T.StructField(text, T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page.as_py(), tree) for page in batch.column("_html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + [pa.array(found, pa.string())], schema.names
            )

    return chosen.mapInArrow(run, schema)
