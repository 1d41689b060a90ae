"""Main text of pages by block rules in two passes.

A page is read once into blocks: the text between block-level tags, with
character references decoded and white space reduced to single blanks. Scripts,
styles, comments and markup are no text.

The first pass decides what it can. A block in an element that stands for a
menu, header, footer, sidebar, notice, advert, form or reader comments, by its
tag, role or class, is boilerplate; so is any block outside the page's article,
if it has one. Of the others three measures decide: the share of linked
characters, the share of stop words, and length. Blocks that consist mostly of
links are boilerplate, and those with a fifth of links and hardly any stop word.
Long blocks with enough stop words are content. Long ones with few are
boilerplate where nothing marks the page's article; in an article, which gives
them some credit, they stay open, as do short blocks. A page without stop words
at all is in a language that the list doesn't hold: there length and links decide
alone.

The second pass gives each open block the label of its nearest decided
neighbours: if they differ, the nearer one's; at equal distance, content. Open
blocks without any decided neighbour are content in an article and boilerplate
elsewhere. Content blocks are joined by a line feed, in page order, and nothing
is cut.

Row rules: null or empty html gives an empty text. An element that isn't closed
ends with the element around it. Each row is returned; null ids and urls stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill.llm.common import small_batches

#: Characters from which a block is long; shares of linked characters that are boilerplate, and that are without stop words.
LONG, LINK_SHARE, SOME_LINKS = 70, 0.5, 0.2
#: Shares of stop words: enough on a page without an article, enough in an article, and what a page in a known language has.
STOP_SHARE, STOP_SHARE_INSIDE, KNOWN = 0.25, 0.1, 0.03

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a about all also an and are as at be been but by can for from had has have he her his if in into is it its more
    no not of on one or our she so some than that the their them then there these they this to was we were what when
    which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er
    es für hat ich ihr im in ist ja kann mit nach nicht noch nur ob oder sein sich sie sind so über um und uns unter
    vom von vor war was wenn wie wir wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me même mes nous on ou
    par pas pour qu que qui sa se ses son sur te tu un une vous
    al como con de del el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero
    por que se ser si sin sobre son su sus también te un una uno y ya
    """.split()
)
# Elements whose content is never text.
_RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|canvas|audio|video"
# Elements that begin and end blocks.
_BLOCK = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section
    summary table tbody td tfoot th thead title tr ul
    """.split()
)
# Elements that aren't main text.
_OUT = frozenset("aside button dialog footer form head menu nav title".split())
# Words of a class, id or role that mark what isn't main text.
_OUT_WORDS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
    alert announcement consent cookie cookies disclaimer gdpr modal newsletter notice notices notification overlay
    popup signup subscribe subscription toast
    breadcrumb breadcrumbs complementary contentinfo footer masthead menu nav navbar navigation pager pagination
    sidebar sitemap toc toolbar topbar widget widgets
    comment comments commentlist disqus replies respond discussion
    login recommended related search share sharing social
    """.split()
)
#: Elements whose ends are followed up; others neither contain blocks nor matter.
_KEPT = frozenset(
    """
    article aside blockquote body button center details dialog div dl fieldset figure footer form head header hgroup
    html main menu nav ol section span table title ul
    """.split()
)
# An attribute's value. Quotes count only here; one that is never closed doesn't count.
_QUOTED, _UNQUOTED = r"""(?:"[^"]*+"|'[^']*+')""", r"""[^\s"'<>][^\s<>]*+"""
# Every part is possessive and a tag with a quoted value always matches, so no place is read again from each start before it.
# Such a tag ends at the next tag or the page's end if it has no end of its own; without a quoted value that is text.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?![\w:-])[^>]*(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)"
    rf"(?P<attrs>(?:[^<>=]++|=\s*+(?:(?P<quoted>{_QUOTED})|{_UNQUOTED})?+)*+)(?(quoted)(?:>|(?=<)|\Z)|>)"
    r"|</?[a-zA-Z!?][^<>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(rf"([^\s/=]++)(?:\s*+=\s*+({_QUOTED}|{_UNQUOTED})?+)?+")
_WORD = re.compile(r"[^\W_]+")
_OPEN, _CONTENT, _BOILERPLATE = 0, 1, 2


class Block:
    __slots__ = ("text", "linked", "inside", "out")

    def __init__(self, text: str, linked: int, inside: bool, out: bool):
        self.text, self.linked, self.inside, self.out = text, linked, inside, out


def _marked(attrs: str) -> bool:
    """Whether class, id or role has one of the words."""
    if "=" not in attrs:
        return False
    for m in _ATTRIBUTE.finditer(attrs):
        if not m[2] or m[1].lower() not in ("class", "id", "role"):
            continue
        value = m[2].lower()
        if not _OUT_WORDS.isdisjoint(_WORD.findall(value.replace("_", "-"))):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    found: list[Block] = []
    stack: list[tuple[str, bool]] = []  # followed elements that are open: name, whether it isn't main text
    out = articles = links = breaks = 0
    parts: list[str] = []
    linked = at = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, linked, articles > 0, out > 0))
            parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal out, articles
        name, bad = stack.pop()
        out -= bad
        articles -= name in ("article", "main")

    def text(a: int, b: int) -> None:
        nonlocal linked, breaks
        piece = page[a:b]
        if piece and not piece.isspace():
            breaks = 0
        parts.append(piece)
        if links:
            linked += len(piece)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(at, m.start())
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            breaks += 1
            if breaks > 1:
                end()
            else:
                parts.append(" ")
            continue
        if name == "a":
            links = 0 if m["close"] else 1
            continue
        is_block = name in _BLOCK
        if is_block:
            end()
            links = breaks = 0
        if name not in _KEPT:
            continue
        if m["close"]:
            if any(n == name for n, _ in stack):
                end() if is_block else None
                while stack[-1][0] != name:
                    pop()
                pop()
        elif not m["attrs"].endswith("/"):
            bad = name in _OUT or (name == "header" and not articles)
            if not bad and name not in ("html", "body", "article", "main"):
                bad = _marked(m["attrs"])
            if bad and not is_block:
                end()
            stack.append((name, bad))
            out += bad
            articles += name in ("article", "main")
    if at < len(page):
        text(at, len(page))
    end()
    return found


def stop_share(text: str) -> float:
    found = _WORD.findall(text.lower())
    return sum([w in STOP_WORDS for w in found]) / len(found) if found else 0.0


def label(found: list[Block]) -> list[bool]:
    """Whether each block is content."""
    article = any(b.inside and not b.out for b in found)
    asked = [not b.out and (b.inside or not article) for b in found]
    shares = [stop_share(b.text) if ask else 0.0 for b, ask in zip(found, asked)]
    enough = STOP_SHARE_INSIDE if article else STOP_SHARE
    telling = [(len(b.text), share) for b, ask, share in zip(found, asked, shares) if ask and b.linked <= LINK_SHARE * len(b.text)]
    if sum([size * share for size, share in telling]) < KNOWN * sum([size for size, _ in telling]):
        enough = 0.0
    labels = []
    for b, ask, share in zip(found, asked, shares):
        size = len(b.text)
        if not ask or b.linked > LINK_SHARE * size or (share < enough and b.linked > SOME_LINKS * size):
            labels.append(_BOILERPLATE)
        elif size < LONG:
            labels.append(_BOILERPLATE if b.linked and not article else _OPEN)
        elif share >= enough:
            labels.append(_CONTENT)
        else:
            labels.append(_OPEN if article else _BOILERPLATE)
    if article:
        # What lies outside or is marked decides nothing about the article's own short blocks.
        own = [k for k, ask in enumerate(asked) if ask]
    else:
        own = list(range(len(found)))
    before, last = {}, None
    for k in own:
        before[k] = last
        if labels[k] != _OPEN:
            last = k
    result = [x == _CONTENT for x in labels]
    after = None
    for k in reversed(own):
        if labels[k] != _OPEN:
            after = k
            continue
        p, q = before[k], after
        if p is None and q is None:
            result[k] = article
        elif p is None or q is None:
            result[k] = labels[q if p is None else p] == _CONTENT
        elif labels[p] == labels[q] or k - p < q - k:
            result[k] = labels[p] == _CONTENT
        else:
            result[k] = labels[q] == _CONTENT or k - p == q - k
    return result


def extract(page: str | None) -> str:
    """The page's main text."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join([b.text for b, good in zip(found, label(found)) if good])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column(2)]
        sizes = pa.array([len(x) for x in texts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"]
        )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long")
