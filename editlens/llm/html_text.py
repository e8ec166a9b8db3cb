"""Main text of web pages by block rules in two passes: each block by itself, then undecided ones by their neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words by language.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by can for from had has have he her his i if in is it its more not of on or our she
    so that the their them there they this to was we were which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die durch ein eine einem einen einer er es für
    hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und von vor war was wenn wie wir
    wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou
    par pas pour qu que qui sa se ses son sur un une vous
    al así como con cuando de del desde donde el ella ellos en entre era es esta este ha hay la las lo los más me mi
    muy no o para pero por porque que se sin sobre son su sus también un una y ya
    """.split()
)
# Elements that begin a block, whose content is no text, and that have no content.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
SILENT = frozenset("head script style noscript template iframe object svg math select textarea button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What marks a part of a page as something else than the article.
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OUTSIDE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted "
    "related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar widget widgets".split()
)
READERS = frozenset("comment comments disqus replies reply respond".split())
# What may stand beside such a name in one class or id; with any other word it says something else.
BESIDE_NAMES = frozenset(
    "a area bar block bottom box btn button buttons container desktop div fixed form global header icons inner item items "
    "left link links list main mobile module of page panel post posts primary right secondary section site sticky text "
    "the title top wrap wrapper".split()
)
PAGE_TAGS = frozenset("html body main article".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORDS = re.compile(r"[^\W\d_]+")

#: A block of this many words can be decided by its stop words alone.
LONG_WORDS = 10
#: The same in letters, on pages in a language without known stop words.
LONG_LETTERS = 50
STOP_HIGH, STOP_KNOWN, STOP_LOW, LINKS_HIGH = 0.30, 0.20, 0.12, 0.5
GOOD, BAD = True, False


def names_in(value: str) -> set[str]:
    """The names of OUTSIDE_NAMES that whole classes or ids consist of, words of BESIDE_NAMES aside."""
    found: set[str] = set()
    for name in value.split():
        parts = {n.lower() for n in NAME_PARTS.findall(name)}
        if parts <= OUTSIDE_NAMES | BESIDE_NAMES | READERS:
            found |= parts & (OUTSIDE_NAMES | READERS)
    return found


class Block:
    __slots__ = ("parts", "linked", "zone", "tag")

    def __init__(self, zone: str, tag: str):
        self.parts: list[str] = []
        self.linked, self.zone, self.tag = 0, zone, tag

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Reader(HTMLParser):
    """Cuts a page into blocks, each with its zone: article, outside, comments or page."""

    def __init__(self, exempt: frozenset[int] = frozenset()) -> None:
        """``exempt``: elements, by their place among those with such names, whose names do not count."""
        super().__init__(convert_charrefs=True)
        self.exempt = exempt
        self.open: list[tuple[str, str]] = []
        self.wrappers: list[tuple[int, str]] = []
        self.inside: list[tuple[int, int]] = []
        self.unlinked: dict[int, int] = {-1: 0}
        self.silent = self.links = 0
        self.blocks: list[Block] = []
        self.block = Block("page", "")

    @property
    def zone(self) -> str:
        return self.open[-1][1] if self.open else "page"

    def _cut(self, tag: str) -> None:
        if self.block.parts:
            self.blocks.append(self.block)
        self.block = Block(self.zone, tag)

    def _zone_of(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        given = {k: v or "" for k, v in attrs}
        zone = self.zone
        names = set() if tag in PAGE_TAGS else names_in(f"{given.get('class', '')} {given.get('id', '')}")
        if names:
            at = len(self.wrappers)
            self.wrappers.append((at, "comments" if names & READERS else "outside"))
            self.inside.append((len(self.open), at))
            self.unlinked[at] = 0
            if at in self.exempt:
                names = set()
        if zone == "comments" or names & READERS:
            return "comments"
        hidden = "hidden" in given or given.get("aria-hidden") == "true"
        if hidden or tag in OUTSIDE or given.get("role") in OUTSIDE_ROLES or names & OUTSIDE_NAMES:
            return "outside"
        if tag in ("article", "main") or given.get("role") in ("main", "article"):
            return "outside" if any(t == "aside" for t, _ in self.open) else "article"
        if tag == "header" and zone != "article":
            return "outside"
        return zone

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        if tag == "body" and any(t == "head" for t, _ in self.open):
            self.handle_endtag("head")
        self.open.append((tag, self._zone_of(tag, attrs)))
        self.silent += tag in SILENT
        self.links += tag == "a"
        if tag in BLOCKS:
            self._cut(tag)
        elif self.block.zone != self.zone:
            self._cut(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in BLOCKS:
            self._cut(tag)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            if tag == "p":
                self._cut(tag)
            return
        closed, self.open = self.open[at:], self.open[:at]
        while self.inside and self.inside[-1][0] >= at:
            self.inside.pop()
        self.silent -= sum(t in SILENT for t, _ in closed)
        self.links -= sum(t == "a" for t, _ in closed)
        if any(t in BLOCKS for t, _ in closed) or self.block.zone != self.zone:
            self._cut(tag)

    def handle_data(self, data: str) -> None:
        if not self.silent and data:
            self.block.parts.append(data)
            if self.links:
                self.linked(data)
            else:
                for at in (-1, *(w for _, w in self.inside)):
                    self.unlinked[at] += len(data.strip())

    def linked(self, data: str) -> None:
        self.block.linked += len(data.strip())

    def finish(self, html: str) -> list[Block]:
        self.feed(html)
        self.close()
        self._cut("")
        return [b for b in self.blocks if b.text]


def first_pass(block: Block, known: bool = True) -> bool | None:
    """Good, bad or undecided, from the block alone; if no language is ``known``, its length decides."""
    text = block.text
    if block.zone in ("outside", "comments"):
        return BAD
    if block.linked > LINKS_HIGH * len(text):
        return BAD
    words = WORDS.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if block.zone == "article":
        return GOOD if len(words) >= LONG_WORDS and density >= STOP_LOW else None
    if not known:
        return GOOD if len(words) >= LONG_WORDS or sum(map(len, words)) >= LONG_LETTERS else None
    if len(words) < LONG_WORDS:
        return None
    return GOOD if density >= STOP_HIGH else None if density >= STOP_LOW else BAD


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks get the label of their nearest decided neighbours in the same zone.

    With different labels on both sides the nearer one counts, and of equally near ones the good one; a heading looks
    ahead only. Inside the article one good neighbour, or none decided on a side, is enough.
    """
    ahead = _nearest(blocks, labels, range(len(blocks) - 1, -1, -1))
    behind = _nearest(blocks, labels, range(len(blocks)))
    final: list[bool] = []
    for i, (block, label) in enumerate(zip(blocks, labels, strict=True)):
        after, before = ahead[i], behind[i]
        if label is not None:
            final.append(label)
        elif block.zone == "article":
            final.append(after is None or before is None or bool(labels[after] or labels[before]))
        elif block.tag in HEADINGS:
            final.append(after is not None and bool(labels[after]))
        else:
            near = sorted((abs(j - i), not labels[j]) for j in (after, before) if j is not None)
            final.append(bool(near) and not near[0][1])
    return final


def _nearest(blocks: list[Block], labels: list[bool | None], order: range) -> list[int | None]:
    """For each block, the last decided one of its zone met before it in this order."""
    found: list[int | None] = [None] * len(blocks)
    known: dict[str, int] = {}
    for i in order:
        found[i] = known.get(blocks[i].zone)
        if labels[i] is not None:
            known[blocks[i].zone] = i
    return found


def known_language(blocks: list[Block]) -> bool:
    """Whether the unmarked blocks that are no link lists, or a long one of them, have as many stop words as a text of
    their languages."""
    free = [WORDS.findall(b.text.lower()) for b in blocks if b.zone == "page" and b.linked <= LINKS_HIGH * len(b.text)]
    counts = [(sum(w in STOP_WORDS for w in words), len(words)) for words in free]
    return sum(c for c, _ in counts) >= STOP_KNOWN * sum(n for _, n in counts) or any(n >= LONG_WORDS and c >= STOP_HIGH * n for c, n in counts)


def judged(blocks: list[Block]) -> str:
    known = known_language(blocks)
    labels = [first_pass(b, known) for b in blocks]
    final = second_pass(blocks, labels)
    if any(good and b.zone == "article" for good, b in zip(final, blocks, strict=True)):
        final = [good and b.zone == "article" for good, b in zip(final, blocks, strict=True)]
    return " ".join(b.text for good, b in zip(final, blocks, strict=True) if good)


def main_text(html: str | None) -> str:
    """An element that holds most of the text outside links is no outside part by its name alone.

    For reader comments, which can be longer than the text, that is so only if nothing else is left.
    """
    reader = Reader()
    text = judged(reader.finish(html or ""))
    most = {(at, kind) for at, kind in reader.wrappers if 2 * reader.unlinked[at] > reader.unlinked[-1]}
    exempt = frozenset(at for at, kind in most if kind == "outside" or not text)
    return judged(Reader(exempt).finish(html or "")) if exempt else text


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``text`` (main text, empty if there is none) and ``n_chars`` (its code points) to every row.

    Blocks in parts of the page that are marked as menu, header, footer, sidebar, form, advert, notice or reader
    comments are bad; otherwise link density, length and the share of stop words decide, or leave it open for the
    second pass; on pages with hardly any known stop word, link density and length alone. If an article or main element has good blocks, only its blocks count. Character references are
    decoded, white space inside a block is one space, blocks are joined by one space. Null and empty pages give an
    empty text; repeated rows are treated alike; all other columns stay (those two names are replaced).
    """

    @F.pandas_udf("text string, n_chars long")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for page in batches:
            texts = [main_text(h) for h in page]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    return pages.select(*rest, read(F.col(html)).alias("_read")).select(*rest, "_read.*")
