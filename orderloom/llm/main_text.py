"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. A block's features are its word count
and link density, those of its neighbours, and what the innermost telling element around it says: that it
holds the article, the lead of one (a header within an article), or something else; and whether it is a
heading. A decision tree, trained on a small labelled table of blocks (``LABELLED``), says which blocks are
main text. Where elements say nothing, word counts and link densities decide. Time is linear in the page.

Character references are decoded, white space inside a block becomes one space, and blocks are joined by a
line feed in page order. ``<br>`` is white space. Contents of scripts, styles, comments and the like are
no text.

Results for odd input: a NULL or empty page gives an empty text; broken or unclosed markup is read as far
as it goes; a repeated row is read again; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession

# HTML element names by their role.
RAW = "script style noscript template svg math iframe object canvas textarea select title head"
BLOCK = (
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
EMPTY = "area base br col embed hr img input link meta param source track wbr".split()
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE = {"article", "main"}
ASIDE = {"nav", "aside", "footer", "header", "form", "menu", "dialog", "button", "fieldset"}
#: Words in class, id or role that mark what is not the article.
ASIDE_WORDS = (
    "ad ads adv advert adverts advertisement advertising aside banner breadcrumb breadcrumbs captcha comment comments "
    "complementary consent contentinfo cookie cookies copyright disclaimer disqus footer form gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion "
    "recommended related replies reply responses search share sharing sidebar signup social sponsor sponsored sponsors "
    "subscribe tags toolbar trending widget"
).split()
ARTICLE_WORDS = "article content entry main post story text body".split()

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(RAW.split()[:-1])})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLOSED_BY = {"p": set(BLOCK), "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


@dataclass
class Block:
    text: str
    at: int  # place in the page
    words: int
    linked: int
    role: str | None  # of the innermost element that says one
    heading: bool


#: Before a word, these say that the page lacks it or makes room for it: ``no-sidebar``.
NOT_HERE = frozenset("no not without has have with hide hidden before after skip".split())
#: What an element says of the text in it.
ASIDE_ROLE, ARTICLE_ROLE, LEAD_ROLE = "aside", "article", "lead"


def _named(value: str) -> tuple[bool, bool]:
    """(a word for what is not the article, a word for the article) in a class, id or role."""
    words = [w.lower() for w in NAME.findall(value)]
    said = {w for before, w in zip(["", *words], words) if before not in NOT_HERE}
    return not said.isdisjoint(ASIDE_WORDS), not said.isdisjoint(ARTICLE_WORDS)


def _role(tag: str, attributes: str, above: str | None) -> str | None:
    """What the element says; if it says nothing, what stands above it."""
    if tag in ("html", "body"):
        return above
    aside, article = False, False
    if attributes and not attributes.isspace():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return ASIDE_ROLE
            if name == "style":
                if re.search(r"display\s*:\s*none", value, re.I):
                    return ASIDE_ROLE
            else:
                marks = _named(value)
                aside, article = aside or marks[0], article or marks[1]
    if tag in ARTICLE or article and not aside:
        return ARTICLE_ROLE
    if tag == "header" and above in (ARTICLE_ROLE, LEAD_ROLE):
        return LEAD_ROLE
    return ASIDE_ROLE if aside or tag in ASIDE else above


class _Open:
    """The open elements: name and role of each. Every element is entered and left once, whatever the markup."""

    def __init__(self):
        self.tags: list[str] = []
        self.roles: list[str | None] = []
        self.places: dict[str, list[int]] = {}  # of each name, innermost last
        self.blocks: list[int] = []
        self.headings = 0

    def enter(self, tag: str, attributes: str) -> None:
        at = len(self.tags)
        self.roles.append(_role(tag, attributes, self.roles[-1] if at else None))
        self.tags.append(tag)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK_SET:
            self.blocks.append(at)
        self.headings += tag in HEADINGS

    def cut(self, at: int) -> None:
        """Leave the element at a place and all within it."""
        while len(self.tags) > at:
            tag = self.tags.pop()
            self.roles.pop()
            if tag:
                self.places[tag].pop()
                self.headings -= tag in HEADINGS
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def leave(self, tag: str) -> None:
        found = self.places.get(tag)
        if not found:
            return
        if tag in BLOCK_SET or not self.blocks or self.blocks[-1] < found[-1]:
            self.cut(found[-1])
        else:  # blocks are open within it: it ends, they stay
            self.tags[found.pop()] = ""

    def before(self, tag: str) -> None:
        """Leave what a block of this name ends."""
        for at in reversed(self.blocks):
            if tag in CLOSED_BY.get(self.tags[at], ()):
                self.cut(at)
                return
            if self.tags[at] not in CLOSED_BY:
                return


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order."""
    out: list[Block] = []
    elements = _Open()
    texts: list[str] = []
    linked = first = 0
    link = 0

    def close() -> None:
        nonlocal linked
        words = "".join(texts).split()
        if words:
            role = elements.roles[-1] if elements.roles else None
            out.append(Block(" ".join(words), first, len(words), min(linked, len(words)), role, elements.headings > 0))
        texts.clear()
        linked = 0

    for token in TOKEN.finditer(page):
        tag = token[3]
        if tag is None:
            raw = token[0]
            if raw[0] == "<" and len(raw) > 1:
                if token[1]:
                    texts.append(" ")
                continue
            text = html.unescape(raw)
            if not texts:
                first = token.start()
            texts.append(text)
            if link:
                linked += len(text.split())
            continue
        tag = tag.lower()
        if token[2]:
            if tag == "a":
                link = 0
            if tag in BLOCK_SET:
                close()
            elements.leave(tag)
            continue
        if tag == "br":
            texts.append("\n")
            continue
        if tag in BLOCK_SET:
            close()
            elements.before(tag)
        if tag in EMPTY:
            continue
        if tag == "a":
            link = 1
        elements.enter(tag, token[4])
    close()
    return out


BLOCK_SET = frozenset(BLOCK)
FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "aside", "article", "lead", "heading",
)


def features(found: list[Block]) -> list[list[float]]:
    plain = [(float(b.words), b.linked / b.words) for b in found]
    edge = (0.0, 0.0)
    return [
        [*plain[i], *(plain[i - 1] if i else edge), *(plain[i + 1] if i + 1 < len(found) else edge),
         float(b.role == ASIDE_ROLE), float(b.role == ARTICLE_ROLE), float(b.role == LEAD_ROLE), float(b.heading)]
        for i, b in enumerate(found)
    ]


# The labelled table: pages in pieces, each with 1 where its blocks are main text. Pages are all sequences of a
# beginning, an article and an end, within elements that say what they are and within elements that do not.
_LONG = "The council met on Tuesday to discuss the new bridge across the river, and after a long debate the members agreed to it."
_MID = "Work on the northern side begins in spring and ends before the first snow."
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "sport", "about", "contact"))
_MENU = f"<ul>{_LINKS}</ul>"
Pieces = tuple[tuple[str, int], ...]

BEGINNINGS: tuple[Pieces, ...] = (
    (),
    ((f"<nav>{_MENU}</nav><div class='ad'>Buy new shoes for a small price today and save.</div>", 0),),
    ((f"<header><a href='/'>The Paper</a> Daily news</header><div class='menu'>{_MENU}</div>", 0),),
    ((f"<div class='cookie-notice'>{_LONG}</div>", 0),),
    (("<nav><a href='/'>Front page</a><div><a href='/a'>About the paper and us</a></div></nav>", 0),),
)
ARTICLES: tuple[Pieces, ...] = (
    ((f"<p>{_LONG} {_LONG}</p>", 1),),
    ((f"<h1>A bridge</h1><p>{_LONG}</p><p>Yes.</p><p>{_MID}</p>", 1),),
    (("<h1>Ode</h1><p>Blue.</p><p>Green and gold.</p>", 1),),
    ((f"<header><h1>Bridge agreed</h1>", 1), ("<p>By a writer, Tuesday</p></header>", 0), (f"<p>{_MID}</p><p>{_LONG}</p><p>Short.</p>", 1)),
    ((f"<h2>Notes</h2><p>See <a href='/q'>the plan</a> here.</p>", 1), ("<aside>Not this one</aside>", 0),
     (f"<p><a href='/w'>Only a link</a></p><blockquote>{_MID}</blockquote><ul><li>One lane.</li><li><a href='/e'>A source</a></li></ul>", 1)),
    ((f"<p>{_LONG}</p>", 1), (_MENU, 0), (f"<p>{_MID}</p>", 1)),
    ((f"<p>{_LONG}</p><p><a href='/z'>The whole plan</a></p><p>No.</p><h2>After that</h2><p><a href='/y'>Yes</a></p><p>{_MID}</p>", 1),),
    ((f"<h2>Bread</h2><p><a href='/z'>Here it is</a></p><p>Rye.</p>", 1),),
    ((f"<h1>On the river</h1><p>{_LONG}</p>", 1), ("<p><a href='/1'>One</a></p><p><a href='/2'>Two of them</a></p>", 0)),
    ((f"<p>{_LONG}</p>", 1), (f"<div class='share'><a href='/s'>Share this</a></div><form>Your name and mail</form>", 0), (f"<p>{_MID}</p>", 1)),
)
ENDS_OF_PAGES: tuple[Pieces, ...] = (
    (),
    (("<footer>&copy; 2020 The Paper, all rights reserved by it.</footer>", 0),),
    ((f"<div class='comments'><h3>Comments</h3><p>{_LONG}</p><p>I like it.</p></div><footer>Contact us</footer>", 0),),
    ((f"<section class='related'><h2>More</h2>{_MENU}</section>", 0),),
)
WITHIN = (("<article>", "</article>"), ("<div class='post-content'>", "</div>"))
#: Articles in elements that say nothing: what stands around them is told by its words and links.
PLAIN: tuple[Pieces, ...] = tuple(
    (*before, (f"<div>{text}</div>", 1), *after)
    for before in ((), ((f"<div>{_MENU}</div>", 0),), (("<div><a href='/'>The Paper</a></div><div>News since 1901</div><div><a href='/in'>Sign in</a></div>", 0),), (("<table><tr><td><a href='/'>The Paper</a> daily</td></tr></table>", 0),))
    for text in (f"<p>{_LONG}</p>", f"<p>{_LONG}</p><p>{_MID}</p>", f"<p>{_LONG}</p><p>Yes.</p><p>{_LONG}</p><p>He said no.</p><p>{_MID}</p>", f"<h1>A long way to the river and back</h1><p>{_LONG}</p><p>{_MID}</p><p>{_LONG}</p>",
                 f"<p>{_LONG} {_LONG}</p><p>See <a href='/x'>the plan</a> for all of it, it is long and has many parts.</p>")
    for after in ((), (("<div><a href='/a'>Previous page</a> <a href='/b'>Next page</a></div>", 0),),
                  (("<div><a href='/terms'>Terms of use</a></div><div>Since 1901</div>", 0),), ((f"<div>{_MENU}</div>", 0),))
)
LABELLED: tuple[Pieces, ...] = PLAIN + tuple(
    (*before, (opening, 0), *text, (closing, 0), *after)
    for before in BEGINNINGS for text in ARTICLES for after in ENDS_OF_PAGES for opening, closing in WITHIN
)


def labelled_blocks() -> list[tuple[list[float], float]]:
    rows = []
    for page in LABELLED:
        found = blocks("".join(piece for piece, _ in page))
        ends, total = [], 0
        for piece, _ in page:
            total += len(piece)
            ends.append(total)
        for block, values in zip(found, features(found)):
            rows.append((values, float(page[next(i for i, e in enumerate(ends) if block.at < e)][1])))
    return rows


def train(spark: SparkSession, depth: int = 7) -> tuple:
    """The tree as nested (feature, threshold, at most, above), leaves True or False."""
    rows = [(Vectors.dense(v), y) for v, y in labelled_blocks()]
    table = spark.createDataFrame(rows, ["features", "label"])
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(table.coalesce(1))

    def walk(node):
        if node.subtreeDepth() == 0:
            return bool(node.prediction())
        split = node.split()
        return (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))

    return walk(model._call_java("rootNode"))


def is_main(tree, values: list[float]) -> bool:
    while not isinstance(tree, bool):
        feature, threshold, low, high = tree
        tree = low if values[feature] <= threshold else high
    return tree


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, values in zip(found, features(found)) if is_main(tree, values))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), page: str = "html", tree: tuple | None = None) -> DataFrame:
    """Per row: the columns ``keep``, text, and its length n_chars in code points."""
    tree = tree or train(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(p, tree) for p in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*keep, "text", "n_chars"],
                )

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)
    return pages.select(*keep, page).mapInArrow(work, f"{kinds}, text string, n_chars long")
