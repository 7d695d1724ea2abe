"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block-level tags. The first pass labels each block by
its length, its share of stop words and its share of linked characters, with what the
markup says of it: menus, footers, sidebars, forms, adverts, notices and reader
comments are bad by element, role or name. The second pass decides the ambiguous ones:
a short block takes the label of its nearest decided neighbour (at equal distance the
one before it, a heading that of what follows), a nearly good one is bad only between
bad ones; a short block at an edge of a marked article is good. Where the markup names the article, blocks outside it are
bad, and neighbours are looked for inside it only. Where names leave a page that has an
article without any text (a layout called after its sidebar, say), they are not heeded.

Defined cases: null or empty html and pages without main text give an empty text.
An unclosed comment, script or tag runs to the page's end. Pages of any length are read
whole, one by one and in time linear in their length; repeated rows stay; other columns
of pages are not read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shorter blocks are ambiguous (unless linked), longer ones than LONG decided by stop words alone.
SHORT, LONG = 70, 200
#: Shares of stop words from which a block reads like prose, and of linked characters from which it is a menu.
STOP_LOW, STOP_HIGH, LINKED = 0.1, 0.18, 0.2
#: In a marked article only a block that is mostly links is bad.
ARTICLE_LINKED = 0.5

# Frequent function words.
STOP_WORDS = frozenset("""
the of and to a in is that it for was on with as by be this are at from or not which have has but they his her
de la que el en y los se las del con un por no una su para es al lo como
le et les des du une pour est par qui dans sur pas au avec il ce
der die und den von zu das mit sich auf für nicht ist im dem ein eine als auch
di il che per una non sono da o em um não os ao het een van dat op te zijn och att som det av i på
и в не на что с по как к у из от это の に は を が と も で 的 了 是 在 和 有 不 我 他
""".split())
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W぀-ヿ㐀-鿿]+")

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
#: Inline controls: their text is left out, the block around them goes on.
CONTROLS = frozenset("button canvas datalist math object option select svg template".split())
#: Elements that end an open one of their own kind, unless one of the second kind lies between.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDERS = frozenset("ul ol menu dl table".split())

#: Elements, roles and names that are never main text. Soft ones can't contain the article: one opened inside them shows that they were not closed.
SOFT = frozenset("nav menu form fieldset header".split())
HARD = frozenset("aside dialog footer search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
SOFT_NAMES = frozenset("ad ads adsbygoogle adsense advert adverts advertisement advertisements advertising alert announcement banner breadcrumb breadcrumbs consent cookie cookies form gdpr header login masthead menu menubar nav navbar navigation notice notices notification pager pagination paywall popup promo promotion search signup sponsor sponsored sponsors subscribe subscription toc toolbar topbar".split())
HARD_NAMES = frozenset("comment comments commentlist copyright discussion disqus footer hidden legal modal newsletter overlay recommended recommendations related replies reply respond share sharebar sharing sidebar sidebars social tags trending widget widgets".split())
HOLDING = frozenset("article content entry main post story".split())
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>|</[^>]*>|<(?P<open>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"'=]++|=\s*+"[^"]*"|=\s*+'[^']*'|["'=])*+)>""",
    re.S,
)
_ARTICLE = re.compile(r"<(?:article|main)[\s>]", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}

GOOD, NEAR, AMBIGUOUS, BAD = "good", "near", "short", "bad"


class Block:
    __slots__ = ("text", "linked", "barred", "tagged", "named", "heading", "title", "label")

    def __init__(self, text: str, linked: int, place: Place) -> None:
        self.text, self.linked = text, linked
        self.title, self.heading = place.tag == "h1", place.tag in HEADINGS
        self.barred, self.tagged, self.named = place.barred, place.tagged, place.named
        self.label = AMBIGUOUS


class Place:
    """An open element: how it bars its text, and the article that it belongs to by tag and by name (0: none)."""

    __slots__ = ("tag", "barred", "muted", "tagged", "named")

    def __init__(self, tag: str, barred: int = 0, muted: bool = False, tagged: int = 0, named: int = 0) -> None:
        self.tag, self.barred, self.muted, self.tagged, self.named = tag, barred, muted, tagged, named


def _marks(tag: str, rest: str, names: bool) -> tuple[int, bool, bool]:
    """How an element bars its text (0 no, 1 soft, 2 hard), whether it is hidden, and whether its name says article."""
    barred = 2 if tag in HARD else 1 if tag in SOFT else 0
    if "=" not in rest and "hidden" not in rest:
        return barred, False, False
    hidden = holds = False
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            hidden = True
        elif name == "role":
            if value == "main" or value == "article":
                holds = True
            elif value in ROLES:
                barred = max(barred, 2 if value in ("complementary", "contentinfo") else 1)
        elif name == "itemprop" and value == "articleBody":
            holds = True
        elif names and name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for part in value.split():
                words = [w.lower() for w in _NAME.findall(part)]
                if words and words[0] in ("no", "has", "with", "without"):
                    continue
                if HARD_NAMES.intersection(words):
                    barred = 2
                elif SOFT_NAMES.intersection(words):
                    if not (words[-1] == "header" and HOLDING.intersection(words)):
                        barred = max(barred, 1)
                elif words and words[-1] in HOLDING | {"body", "text"} and HOLDING.intersection(words):
                    holds = True
    return barred, hidden, holds


class _Reader:
    """Cuts one page into blocks."""

    def __init__(self, names: bool = True) -> None:
        self.names = names  # do classes and ids count?
        self.blocks: list[Block] = []
        self.stack = [Place("")]
        self.parts: list[str] = []
        self.linked = 0
        self.link_at = 0  # stack size when the open link began; 0: none
        self.articles = 0
        self.opened: Counter[str] = Counter()

    def read(self, page: str) -> list[Block]:
        page = page[: page.rfind(">") + 1] + _loose_end(page[page.rfind(">") + 1 :])
        at = 0
        while m := _TOKEN.search(page, at):
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            if name := m["close"]:
                self.close(name.lower())
            elif name := m["open"]:
                name = name.lower()
                self.open(name, m["rest"])
                if name in RAW:
                    end = _RAW_END[name].search(page, at)
                    at = end.end() if end else len(page)
        self.text(page[at:])
        self.flush()
        return self.blocks

    def text(self, raw: str) -> None:
        if raw and not self.stack[-1].muted:
            raw = markup.unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.link_at:
                self.linked += len("".join(raw.split()))

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.linked, self.stack[-1]))
            self.parts.clear()
        self.linked = 0

    def push(self, place: Place) -> None:
        self.stack.append(place)
        self.opened[place.tag] += 1

    def drop(self, size: int) -> None:
        self.opened.subtract(p.tag for p in self.stack[size:])
        del self.stack[size:]
        if self.link_at > size:
            self.link_at = 0

    def open(self, tag: str, rest: str) -> None:
        if tag in BLOCKS:
            self.flush()
            if self.stack[-1].tag == "p":
                self.drop(len(self.stack) - 1)
            if any(self.opened[t] for t in SIBLINGS.get(tag, ())):
                for k in range(len(self.stack) - 1, 0, -1):
                    if self.stack[k].tag in HOLDERS:
                        break
                    if (found := self.stack[k].tag) in SIBLINGS[tag]:
                        self.drop(k)
                        if tag != "tr" or found == "tr":
                            break
        if tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.link_at = len(self.stack) if "href" in rest.lower() else 0
        elif tag in CONTROLS:
            if not rest.endswith("/"):
                self.push(Place(tag, 2, True))
        elif tag not in VOID and tag not in RAW:
            outer = self.stack[-1]
            barred, hidden, holds = _marks(tag, rest, self.names)
            if tag not in BLOCKS:
                if barred or hidden:
                    self.push(Place(tag, 2, True))
                return
            here = Place(tag, max(outer.barred, barred), outer.muted or hidden, outer.tagged, outer.named)
            if tag in ("article", "main") and here.barred < 2:
                here.barred = barred
                holds = True
            if tag == "header" and barred == 1 and (outer.tagged or outer.named):
                here.barred = outer.barred
            if holds and not here.barred:
                if tag in ("article", "main"):
                    self.articles += not here.tagged
                    here.tagged = here.tagged or self.articles
                elif not here.named:
                    self.articles += 1
                    here.named = self.articles
            self.push(here)

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag == "a":
            self.link_at = 0
        elif tag == "br":
            self.parts.append(" ")
        elif self.opened[tag]:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    self.drop(k)
                    break
                if tag not in BLOCKS and self.stack[k].tag in BLOCKS:
                    break


def _loose_end(tail: str) -> str:
    """What follows the last ">": an unfinished tag in it is left out."""
    m = re.search(r"<[a-zA-Z/!?]", tail)
    return tail[: m.start()] if m else tail


def _first_pass(blocks: list[Block]) -> None:
    by_tag = any(b.tagged and not b.barred for b in blocks)
    for b in blocks:
        b.tagged = b.tagged if by_tag else b.named
    marked = any(b.tagged and not b.barred for b in blocks)
    for b in blocks:
        if b.barred or (marked and not b.tagged):
            b.label = BAD
            continue
        size, linked = len(b.text), b.linked / (len(b.text) - b.text.count(" "))
        words = _WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        if linked > (ARTICLE_LINKED if marked else LINKED):
            b.label = BAD
        elif size < SHORT:
            b.label = AMBIGUOUS
        elif stops >= STOP_HIGH:
            b.label = GOOD if size > LONG else NEAR
        elif stops >= STOP_LOW or marked:
            b.label = NEAR
        else:
            b.label = BAD
        if not marked:
            if b.text.startswith("\xa9") or ("\xa9" in b.text and size <= LONG):
                b.label = BAD
            elif b.title and b.label != BAD:
                b.label = GOOD


def _second_pass(blocks: list[Block]) -> None:
    """Ambiguous blocks inherit from the nearest decided neighbours of their own article (or of the page, where none is marked)."""
    groups: dict[int, list[Block]] = {}
    marked = any(b.tagged and not b.barred for b in blocks)
    for b in blocks:
        if not marked or (b.tagged and not b.barred):
            groups.setdefault(b.tagged if marked else 0, []).append(b)
    for group in groups.values():
        _inherit(group, lambda b: b.label == NEAR, nearly=True, alone=GOOD)
        _inherit(group, lambda b: b.label == AMBIGUOUS, nearly=False, alone=GOOD if marked else BAD)
    if len(groups) > 1:  # teasers of other articles have no prose of their own
        prose = {g: sum(len(b.text) for b in group if b.label == GOOD and len(b.text) >= SHORT) for g, group in groups.items()}
        if any(prose.values()):
            for b in (b for g, group in groups.items() if not prose[g] for b in group):
                b.label = BAD


def _inherit(group: list[Block], undecided, nearly: bool, alone: str) -> None:
    decided = [b.label if b.label in (GOOD, BAD) else None for b in group]
    before, after = [(None, 0)] * len(group), [(None, 0)] * len(group)
    last = (None, 0)
    for i, label in enumerate(decided):
        before[i] = last
        last = (label, i) if label else last
    last = (None, 0)
    for i in range(len(group) - 1, -1, -1):
        after[i] = last
        last = (decided[i], i) if decided[i] else last
    for i, b in enumerate(group):
        if not undecided(b):
            continue
        (x, at_x), (y, at_y) = before[i], after[i]
        if nearly:
            b.label = BAD if x == y == BAD and not b.tagged else GOOD
        elif x is None or y is None:
            b.label = alone if alone == GOOD else x or y or alone
        elif b.heading:
            b.label = y
        else:
            b.label = x if i - at_x <= at_y - i else y


def main_blocks(page: str | None) -> list[tuple[str, bool]]:
    """Every block of a page in order, and whether it is main text."""
    for names in (True, False):
        blocks = _Reader(names).read(page or "")
        _first_pass(blocks)
        _second_pass(blocks)
        if any(b.label == GOOD for b in blocks) or not _ARTICLE.search(page or ""):
            break
    return [(b.text, b.label == GOOD) for b in blocks]


def _run(batches):
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for page in batch.column("html"):
            blocks = main_blocks(page.as_py())
            kept = [text for text, good in blocks if good]
            text = "\n\n".join(kept)
            for column, value in zip(rows, (text, len(text), len(blocks), len(kept)), strict=True):
                column.append(value)
        names = [n for n in batch.schema.names if n != "html"]
        made = [pa.array(c, kind) for c, kind in zip(rows, (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], names=[*names, "text", "n_chars", "n_blocks", "n_kept"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (its code points), n_blocks and n_kept (blocks of the page and of the text) of each row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long, n_blocks int, n_kept int")


def op11_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: For pages whose article is an element of that name without further markup of its own than paragraphs, a heading, bold text and line breaks, as in the given tables.
ORACLE = r"""
with a as (select page_id, url, unnest(string_split_regex(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(p|h1)>')) as raw,
  generate_subscripts(string_split_regex(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(p|h1)>'), 1) as k from pages),
t as (select page_id, url, k, trim(regexp_replace(regexp_replace(regexp_replace(raw, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '[\s\x{A0}]+', ' ', 'g')) as text from a),
d as (select page_id, k, regexp_replace(replace(replace(replace(replace(text, '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') as text from t where text <> ''),
j as (select page_id, string_agg(text, chr(10) || chr(10) order by k) as text, count(*) as n_kept from d group by page_id)
select p.page_id, p.url, coalesce(text, '') as text, length(coalesce(text, '')) as n_chars from pages p left join j using (page_id)
"""
