"""Main text of web pages by union-free wrapper inference.

Pages of a host come from one template.  A page is read as a stream of tokens, its containers nested, and the text in
between is a slot.  A host's wrapper is inferred from all of its pages: the first page is the first wrapper, and each
further one is aligned with it; siblings that repeat become one repeated group, what only one side has becomes optional,
and texts that differ make a slot variable.  The result is a regular expression over containers without unions.  Map tasks
fold the pages that they have, and what comes out is folded per host, so no page is moved for it.

Where a host has enough pages that differ, the wrapper decides: the main region is where the text that varies is, and what
says the same on every page, or is mostly links on all of them, is the template's.  Tags and names decide where pages say
nothing, and ties.  Every page is aligned with its host's wrapper, and what falls into the region is its text.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

#: Different pages of a host, and share of the text that varies, from which on the wrapper decides.
LEAST_PAGES, LEAST_VARIED = 3, 0.1
#: Share of a region's varying text that an inner container has if it is the region, and share of links in a menu.
DOMINANT, LINKED = 0.7, 0.6
#: Hosts whose wrappers a map task holds at a time.
HELD_HOSTS = 2000
#: Bytes of all wrappers that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

CONTAINERS = frozenset("html body main article section div nav header footer aside form dialog menu fieldset noscript iframe template button select textarea svg object video audio canvas".split())
NEVER = frozenset("nav header footer aside form dialog menu noscript iframe template button select textarea svg object video audio canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img area map input td th".split())
#: What ends a head that has no end tag: anything else.
IN_HEAD = frozenset("title meta link base style script noscript template".split())
HEADINGS = frozenset(("h1", "h2"))
#: Words of names (in class, id or role) of what is not main text, and words that add nothing to them.  A name counts only if
#: it holds nothing else: "ad-box" does, "share-price" does not.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead topbar "
    "header footer comment comments disqus replies reply respond social share sharing related recommended recommendations widget toolbar "
    "pagination pager login search skip toc complementary contentinfo".split()
)
NEUTRAL = frozenset(
    "box left right top bottom area body site page main bar form slot container wrap wrapper list item items block section inner outer global "
    "primary secondary content panel unit text link links button buttons group row col column small big new the user reader bottom".split()
)
MAIN_WORDS = frozenset(("article", "post", "entry", "story", "content", "articlebody", "main", "maincontent"))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+>|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER, _LONG_NUMBER = re.compile(r"\d+"), re.compile(r"\d{3,}")
TEXT = "#text"
#: Containers nested deeper only break blocks, unless they never hold main text: their text is kept, but has no part of its
#: own in the wrapper.
DEEP = 120


@dataclass
class Node:
    """A container, or a slot (sign is TEXT; pieces are its strings, None where a block ends)."""

    sign: str
    children: list[Node] = field(default_factory=list)
    pieces: list[str | None] = field(default_factory=list)
    never: bool = False
    #: Letters in links, and in headings.
    links: int = 0
    headings: int = 0


def _boilerplate(name: str) -> bool:
    words = {w.lower() for w in _WORDS.findall(name)}
    return not words.isdisjoint(BOILERPLATE) and words <= BOILERPLATE | NEUTRAL


@lru_cache(1 << 14)
def _container(tag: str, attributes: str) -> tuple[str, bool] | None:
    """Signature of a start tag, and whether it never holds main text; None if it only shapes text."""
    names: list[str] = []
    sign: set[str] = set()
    hidden = False
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden":
            hidden = True
        own = value.strip("\"'").split()
        names += own
        # numbers of items are no part of a signature: those in ids, and long ones
        sign |= {(_NUMBER if name.lower() == "id" else _LONG_NUMBER).sub("", n.lower()) for n in own}
    # a name of the whole page or article says nothing about what is in it
    named = tag not in INLINE and tag not in ("html", "body", "main", "article") and any(map(_boilerplate, names))
    never = tag in NEVER or hidden or named
    if tag not in CONTAINERS and not never:
        return None
    return ".".join([tag, *sorted(sign)]), never


def read_page(page: str) -> Node:
    """The tree of containers and slots.  End tags without a start are dropped, starts without an end are closed with what
    holds them; a paragraph or list item that counts as a container ends where the next block begins.  What is in a container
    that never holds main text is not read."""
    root = Node("#page")
    stack = [(root, "")]
    slot: Node | None = None
    at, in_head, in_link, in_heading = 0, False, 0, 0
    # stack entries from which on all is within a container that never holds main text
    shut: int | None = None

    def put(piece: str | None) -> None:
        nonlocal slot
        if shut is not None:
            return
        if slot is None:
            slot = Node(TEXT)
            stack[-1][0].children.append(slot)
        slot.pieces.append(piece)
        if piece:
            slot.links += len(piece) if in_link else 0
            slot.headings += len(piece) if in_heading else 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            in_head = in_head and not piece.strip()
            if not in_head:
                put(piece)
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        closing = bool(m[2])
        if tag == "head":
            in_head = not closing
            continue
        if in_head and not closing and tag not in IN_HEAD:
            in_head = False
        if tag == "br":
            put(" ")
            continue
        block = tag not in INLINE
        if tag in ("td", "th"):
            put(" ")
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in HEADINGS:
            in_heading = 0 if closing else 1
        if closing:
            held = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][1] == tag), 0)
            if held:
                del stack[held:]
                slot = None
                if shut is not None and len(stack) <= shut:
                    shut = None
            elif block:
                put(None)
            continue
        if block and stack[-1][1] in ("p", "li"):
            stack.pop()
            slot = None
            if shut is not None and len(stack) <= shut:
                shut = None
        made = None if tag in VOID else _container(tag, m[4] or "")
        if made and shut is not None:
            # only so that end tags find their starts
            stack.append((root, tag))
        elif made and (made[1] or len(stack) <= DEEP):
            node = Node(made[0], never=made[1])
            stack[-1][0].children.append(node)
            shut = len(stack) if made[1] else None
            stack.append((node, tag))
            slot = None
        elif block:
            put(None)
    if at < len(page) and not (in_head and not page[at:].strip()):
        put(page[at:])
    return root


# ---- wrappers --------------------------------------------------------------------------------------------------------


@dataclass
class Part:
    """A node of a wrapper: a container or slot that occurs once, at most once (optional), or any number of times."""

    sign: str
    children: list[Part] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    never: bool = False
    #: Of a slot: letters that the pages had here, those in links and in headings, and a digest of the text while all pages
    #: have the same.
    letters: int = 0
    links: int = 0
    headings: int = 0
    text: str | None = None
    variable: bool = False
    #: Pages that have it.
    pages: int = 1
    # what mark() decides: is it the main region, is it a menu, and the digests of its texts if it is the template's
    main: bool = False
    menu: bool = False
    constant: frozenset[str] = frozenset()

    @property
    def tag(self) -> str:
        return self.sign.split(".", 1)[0]


def _slot_text(node: Node) -> str:
    return " ".join("".join(p or "\n" for p in node.pieces).split())


def _text_digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _said(node: Node) -> Iterator[str]:
    """Digests of a container's texts, but of what is never main text."""
    for c in node.children:
        if c.sign != TEXT:
            if not c.never:
                yield from _said(c)
        elif text := _slot_text(c):
            yield _text_digest(text)


def as_wrapper(node: Node) -> Part:
    if node.sign == TEXT:
        text = _slot_text(node)
        return Part(TEXT, letters=len(text), links=min(node.links, len(text)), headings=min(node.headings, len(text)), text=_text_digest(text))
    part = Part(node.sign, never=node.never)
    part.children = _folded([as_wrapper(c) for c in node.children if c.sign != TEXT or _slot_text(c)])
    return part


def _folded(parts: list[Part]) -> list[Part]:
    """Groups of one or two neighbours that repeat become one repeated group each."""
    out: list[Part] = []
    for part in parts:
        if out and out[-1].sign == part.sign and part.sign != TEXT:
            out[-1] = joined(out[-1], part, repeated=True)
        elif len(out) >= 3 and [p.sign for p in out[-3:]] == [out[-1].sign, part.sign, out[-1].sign] and part.sign != out[-1].sign:
            # x y x y: one x and one y that repeat
            x = out.pop()
            out[-2] = joined(out[-2], x, repeated=True)
            out[-1] = joined(out[-1], part, repeated=True)
        else:
            out.append(part)
    return out


def joined(a: Part, b: Part, repeated: bool = False) -> Part:
    """One part for both."""
    out = Part(a.sign, never=a.never, optional=a.optional or b.optional, repeated=repeated or a.repeated or b.repeated)
    out.letters, out.links, out.headings = a.letters + b.letters, a.links + b.links, a.headings + b.headings
    out.pages = max(a.pages, b.pages) if repeated else a.pages + b.pages
    out.text = a.text if a.text == b.text else None
    out.variable = a.variable or b.variable or (a.sign == TEXT and a.text != b.text)
    out.children = align(a.children, b.children)
    return out


def align(a: list[Part], b: list[Part]) -> list[Part]:
    """The longest common sequence of signs stays; what only one side has becomes optional.  Then repeats are folded."""
    if [x.sign for x in a] == [x.sign for x in b]:
        return _folded([joined(x, y) for x, y in zip(a, b)])
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i].sign == b[j].sign else max(below[j], row[j + 1])
    out: list[Part] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i].sign == b[j].sign:
            out.append(joined(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            a[i].optional = True
            out.append(a[i])
            i += 1
        else:
            b[j].optional = True
            out.append(b[j])
            j += 1
    return _folded(out)


def infer(pages: list[str]) -> Part:
    """The wrapper of a host's pages, with what it decides."""
    wrapper: Part | None = None
    for page in pages:
        found = as_wrapper(read_page(page))
        wrapper = found if wrapper is None else joined(wrapper, found)
    return mark(wrapper or Part("#page"))


# ---- decisions -------------------------------------------------------------------------------------------------------


def _letters(part: Part, varied: bool) -> int:
    """Letters outside links, of slots that vary or of all."""
    if part.never:
        return 0
    own = part.letters - part.links if part.variable or not varied else 0
    return own + sum(_letters(c, varied) for c in part.children)


def _sum(part: Part, name: str) -> int:
    return 0 if part.never else getattr(part, name) + sum(_sum(c, name) for c in part.children)


def _containers(part: Part) -> Iterator[Part]:
    if not part.never and part.sign != TEXT:
        yield part
        for c in part.children:
            yield from _containers(c)


def _tagged(part: Part) -> list[Part]:
    """Its articles, else what is called main, but none within another."""
    every = [p for p in _containers(part) if p.tag == "article" and _letters(p, False)] or [p for p in _containers(part) if p.tag == "main"][:1]
    inner = {id(q) for p in every for c in p.children for q in _containers(c)}
    return [p for p in every if id(p) not in inner]


def mark(wrapper: Part) -> Part:
    """Marks the main region, and in it what is the template's.  The wrapper decides if there are enough pages and if
    enough of their text varies: then the region is the deepest container that holds most of that.  Else, and where no
    container holds most of it, articles are, or main, or a container called so, or the deepest that holds most text."""
    total, varied = _letters(wrapper, False), _letters(wrapper, True)
    evidence = wrapper.pages >= LEAST_PAGES and varied >= LEAST_VARIED * total > 0
    at, beside = _densest(wrapper, evidence)
    tagged = _tagged(wrapper)
    inside = {id(p) for p in _containers(at)}
    if evidence and not (tagged and any(id(p) in inside for p in tagged)):
        # no article within it: if one lies elsewhere with text that varies, the two don't agree
        elsewhere = [p for p in tagged if _letters(p, True) * 4 > varied and not any(q is at for q in _containers(p))]
        regions = elsewhere or [at, *beside]
    elif tagged:
        regions = [p for p in tagged if _letters(p, True) > 0 or not evidence] or tagged
    else:
        named = [p for p in _containers(wrapper) if not MAIN_WORDS.isdisjoint(re.split(r"[._-]", p.sign)[1:]) and 2 * _letters(p, False) > total]
        regions = named[-1:] or [at, *beside]
    for p in regions:
        p.main = True
    if evidence:
        for p in regions:
            for c in p.children:
                for q in _containers(c):
                    _mark_template(q, wrapper.pages)
    return wrapper


def _densest(wrapper: Part, varied: bool) -> tuple[Part, list[Part]]:
    """The deepest container that holds most text, and the headings beside the way there."""
    at, beside = wrapper, []
    while at.tag not in ("article", "main"):
        whole = _letters(at, varied)
        inner = [c for c in at.children if c.sign != TEXT and not c.never and _letters(c, varied) >= DOMINANT * whole > 0]
        if not inner:
            break
        own = [c for c in at.children if c is not inner[0] and not c.never and _letters(c, varied) and 10 * _sum(c, "headings") >= 9 * _sum(c, "letters")]
        beside += own
        at = inner[0]
    return at, beside


def _mark_template(part: Part, pages: int) -> None:
    letters = _sum(part, "letters")
    if part.pages < LEAST_PAGES or not letters:
        return
    if _letters(part, True) == 0 and not any(s.variable for s in _slots(part)):
        part.constant = frozenset(s.text for s in _slots(part) if s.text)
    elif 2 * part.pages >= pages and _sum(part, "links") >= LINKED * letters:
        part.menu = True


def _slots(part: Part) -> Iterator[Part]:
    for c in part.children:
        if c.sign == TEXT:
            yield c
        elif not c.never:
            yield from _slots(c)


def to_json(part: Part) -> str:
    def plain(p: Part) -> list:
        flags = p.optional | p.repeated << 1 | p.never << 2 | p.variable << 3
        return [p.sign, flags, p.letters, p.links, p.headings, p.text, p.pages, [plain(c) for c in p.children]]

    return json.dumps(plain(part), ensure_ascii=False, separators=(",", ":"))


def from_json(text: str) -> Part:
    def part(x: list) -> Part:
        sign, flags, letters, links, headings, digest, pages, children = x
        return Part(
            sign, [part(c) for c in children], bool(flags & 1), bool(flags & 2), bool(flags & 4), letters, links, headings, digest, bool(flags & 8), pages
        )

    return part(json.loads(text))


@lru_cache(256)
def _marked(text: str) -> Part:
    return mark(from_json(text))


# ---- extraction ------------------------------------------------------------------------------------------------------


def _matches(node: Node, part: Part) -> Iterator[tuple[Node, Part | None]]:
    """The wrapper's part for each child of the node: the next with its sign, from where the last one matched on, so that
    optional parts are skipped and repeated ones come again; None for what the wrapper does not know."""
    at = 0
    for child in node.children:
        found = None
        if child.sign != TEXT or _slot_text(child):
            for k in range(at, len(part.children)):
                if part.children[k].sign == child.sign:
                    found, at = part.children[k], k if part.children[k].repeated else k + 1
                    break
            if found is None:
                found = next((p for p in part.children if p.sign == child.sign), None)
        yield child, found


def _regions(node: Node, part: Part) -> Iterator[tuple[Node, Part]]:
    if part.main:
        yield node, part
        return
    for child, own in _matches(node, part):
        if own is not None and not own.never:
            yield from _regions(child, own)


def _blocks(node: Node, part: Part | None, out: list[str]) -> None:
    if node.sign == TEXT:
        run: list[str] = []
        for piece in [*node.pieces, None]:
            if piece is None:
                text = " ".join("".join(run).split())
                if text:
                    out.append(text)
                run = []
            else:
                run.append(html.unescape(piece) if "&" in piece else piece)
        return
    for child, own in _matches(node, part) if part else ((c, None) for c in node.children):
        if child.never or (own and (own.never or own.menu or (own.constant and own.constant.issuperset(_said(child))))):
            continue
        _blocks(child, own, out)


def extract(page: str, wrapper: Part | None) -> str:
    """The page's main text under its host's wrapper; under one of its own where it doesn't fit or there is none."""
    root = read_page(page)
    regions = list(_regions(root, wrapper)) if wrapper else []
    if not any(node.sign != TEXT for node, _ in regions):
        regions = list(_regions(root, mark(as_wrapper(root))))
    out: list[str] = []
    for node, part in regions:
        _blocks(node, part, out)
    return "\n\n".join(out)


# ---- tables ----------------------------------------------------------------------------------------------------------


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """pages: url, html.  Returns host, wrapper (JSON): one row per host, folded over all its pages.

    A task folds its own pages first, copies of a page once, so that a host leaves each task as few rows, whatever it has; these
    come sorted by host and are folded as they stream by, one wrapper at a time."""
    schema = "host string, wrapper string"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Part] = {}
        seen: set[bytes] = set()

        def flush() -> pd.DataFrame:
            frame = pd.DataFrame({"host": list(held), "wrapper": [to_json(p) for p in held.values()]})
            held.clear()
            seen.clear()
            return frame

        for batch in batches:
            for name, page in zip(batch["host"], batch["html"]):
                if not isinstance(page, str):
                    continue
                key = hashlib.blake2b(f"{name} {page}".encode("utf-8", "surrogatepass"), digest_size=12).digest()
                if key in seen:
                    continue
                seen.add(key)
                found = as_wrapper(read_page(page))
                held[name] = joined(held[name], found) if name in held else found
                if len(held) > HELD_HOSTS:
                    yield flush()
        if held:
            yield flush()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, wrapper = None, None
        for batch in batches:
            out = []
            for name, text in zip(batch["host"], batch["wrapper"]):
                if name != last and wrapper is not None:
                    out.append((last, to_json(wrapper)))
                    wrapper = None
                last, wrapper = name, from_json(text) if wrapper is None else joined(wrapper, from_json(text))
            if out:
                yield pd.DataFrame(out, columns=["host", "wrapper"])
        if wrapper is not None:
            yield pd.DataFrame([(last, to_json(wrapper))], columns=["host", "wrapper"])

    parts = pages.select(host(F.col("url")).alias("host"), "html").mapInPandas(fold, schema)
    dealt = parts.repartition(partitions(pages.sparkSession), "host").sortWithinPartitions("host", "wrapper")
    return dealt.mapInPandas(merge, schema)


def main_text(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html.  Returns page_id, url, text, n_chars (code points); a row per row.

    Null html counts as empty and gives an empty text; a null url, or one without a host, is of the host "".  White space
    in a block is one space, blocks are joined by blank lines.  Rows that repeat keep their rows.  Empty tables give an
    empty result.  Other columns are ignored.
    """
    known = materialize(wrappers(pages), "wrappers").select(F.col("host").alias("of_host"), "wrapper")
    size = known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("of_host"))).first()[0] or 0
    known = F.broadcast(known) if size <= BROADCAST_BYTES else known.hint("merge")
    joined_pages = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(known, F.col("host") == F.col("of_host"), "left")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                texts = [extract(h, _marked(w) if isinstance(w, str) else None) if isinstance(h, str) else "" for h, w in zip(part["html"], part["wrapper"])]
                frame = pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": texts})
                frame["n_chars"] = [len(t) for t in texts]
                yield frame

    return joined_pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "wrapper").mapInPandas(
        work, "page_id long, url string, text string, n_chars long"
    )
