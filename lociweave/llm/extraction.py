"""Main text of web pages by templates deduced from pages of one host.

A token of a page is an element's path (tags, classes and ids from the root) or
a text at a path.  Tokens that occur equally often in each page of a host, that
is, whose occurrence vectors are equal, form a class.

1. ``streams``: one pass over all pages writes each page's tokens in order, with
   how many words are below an element and how many of them in links.  Later
   passes read these only.
2. ``occurrences``: for each host and token a fingerprint of its vector (two
   64-bit exclusive ors over pages of a hash of page and count, with the number
   of pages and occurrences), its words, and where it comes.  Tasks add these up
   before the shuffle, so a host of very many pages is a row a task and token.
3. ``templates``: the large and frequent classes of a host, in order.  The root
   class has the tokens that each page has once.
4. ``deduced``: each page is compared with its host's classes.  Tokens that don't
   keep their class's order leave it, and of two classes of which the instances
   of one don't all lie in one gap of the other, or all outside, the weaker one
   goes.  By the classes that stay, tokens are told apart: other tokens of a path
   are different ones in different gaps of a class.  With them, vectors are added
   up again and classes found again, until a host has no more tokens in classes.
   What is left nests; the root class is the host's frame, and its texts belong
   to the template.
5. ``extract``: each page is parsed again.  If its frame is in the template's
   order, the frame tells in which element the article is: where the page marks
   none, the walk from the root goes down while one element of the frame holds
   most of the host's words.  What is left in that element's slots is the text:
   without texts of the template that stand in no paragraph or heading, without
   elements that are lists of links, and without what tags, roles, classes or ids
   mark as menu, header, footer, sidebar, notice, advert, form or comments.

Paragraphs and headings of the article stay, however often they are repeated;
so copies of a page are extracted like any other.  Pages of which no other of
the host is known, or whose url names no host, are taken by themselves.

A null or empty html gives an empty text.  Each row gives a row; repeated rows
and keys are told apart by nothing.  Any key is passed on.  Markup that isn't
closed, or closed twice, is read as browsers do in common cases.  Very long
pages are parsed whole.  Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import html
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .classes import Classes, relations, roles_of, settled
from .store import BROADCAST_KEYS, stored

# Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img input script style noscript template svg math button select option".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul td th tr".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
CONTAINERS = frozenset("html body div section article main center table tbody tr td blockquote fieldset details #document".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
# Elements and words of roles, classes and ids that mark what isn't the article.
NEVER = frozenset("head script style noscript template svg math canvas object audio video iframe embed button select option textarea input datalist dialog xmp noembed noframes title".split())
OTHER = frozenset("nav header footer aside form menu".split())
OTHER_WORDS = frozenset("ad ads adbox adslot adsense advert adverts advertisement advertisements advertising banner sponsor sponsored sponsors promo promos promoted promotion nav navbar navigation menu menubar submenu breadcrumb breadcrumbs sidebar sidebars aside header masthead topbar footer colophon copyright cookie cookies consent gdpr notice notices notification notifications alert alerts announcement disclaimer popup modal overlay toast share sharing social follow subscribe subscription newsletter signup login signin search searchbox related recommended recommendations trending widget widgets toolbar pagination pager complementary contentinfo paywall".split())
COMMENT_WORDS = frozenset("comment comments commentlist commenter disqus respond replies discussion".split())

#: Distinct pages that a host's template rests on at least, share of its pages that other classes are in, and tokens of a class.
SUPPORT, FREQUENT, SIZE = 4, 0.5, 2
#: Share of the words that the walk follows along a host's frame and in a page by itself, and share of words in links that makes a class a list of links.
MOST, MOST_ALONE, LINKS = 0.6, 0.75, 0.8
#: Tokens of which a task adds up occurrences at once, and tokens of pages that it holds for a host.
HELD, ALIKE = 100_000, 1_000

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_DIGITS, _NUMBERS = re.compile(r"[0-9]+"), re.compile(r"[0-9]{3,}")
_HOST = re.compile(r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m.group(1).lower() if m else None


def hashed(*parts: str | int) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


ROOT = hashed("#document")


class Element:
    """An element, with its path as a token; words are counted below it: all, and those in links; those of parts marked as others are left out."""

    __slots__ = ("tag", "parent", "token", "marked", "comments", "hidden", "words", "links", "has_article", "has_title", "role", "place", "linked", "unseen")

    def __init__(self, tag: str, parent: Element | None, token: int, role: str = "", marked: bool = False, comments: bool = False, hidden: bool = False):
        self.tag, self.parent, self.token, self.role = tag, parent, token, role
        self.marked, self.comments, self.hidden = marked, comments, hidden
        self.words = self.links = self.place = 0
        self.has_article = self.has_title = self.linked = self.unseen = False

    def up(self) -> Iterator[Element]:
        e: Element | None = self
        while e is not None:
            yield e
            e = e.parent

    def other(self, total: int) -> bool:
        """Whether the element is no part of an article: by its tag, or marked so."""
        if self.tag in NEVER or self.hidden:
            return True
        if self.has_article or self.tag in ("html", "body", "main", "article") and not self.comments:
            return False
        if self.tag == "header" or (self.marked and self.has_title):
            inside = any(e.tag in ("article", "main") for e in self.up())
            return not (inside and self.has_title)
        if self.has_title:
            return False
        if self.tag in OTHER or self.comments:
            return True
        return self.marked and 2 * self.words <= total


_PATHS: dict[tuple, int] = {}
_MARKS: dict[str, tuple[str, bool, bool, bool, str]] = {}


def _marks(tag: str, attributes: str) -> tuple[str, bool, bool, bool, str]:
    """(what a path says of an element, marked, comments, hidden, role) from its attributes."""
    key = f"{tag} {attributes}"
    found = _MARKS.get(key)
    if found is None:
        a = {}
        for name, value in _ATTRIBUTE.findall(attributes):
            a.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in "\"'" and value else value))
        named = " ".join(a.get(k, "") for k in ("class", "id", "role"))
        words = {w.lower() for w in _WORD.findall(named)}
        hidden = "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower()
        role = "main" if a.get("role") == "main" or a.get("itemprop") == "articleBody" else ""
        named_by = [tag, *sorted(_NUMBERS.sub("0", a.get("class", "")).split()), _DIGITS.sub("0", a.get("id", ""))]
        found = (".".join(named_by), bool(words & OTHER_WORDS), bool(words & COMMENT_WORDS), hidden, role)
        if len(_MARKS) < HELD:
            _MARKS[key] = found
    return found


def _path(parent: int, name: str) -> int:
    key = (parent, name)
    found = _PATHS.get(key)
    if found is None:
        found = hashed(parent, name)
        if len(_PATHS) < HELD:
            _PATHS[key] = found
    return found


class Page:
    """Elements in order, and pieces of text (element, text, elements before it); None between pieces ends a block.  said: numbers of pieces with words, and these."""

    def __init__(self, source: str):
        self.root = Element("#document", None, ROOT)
        self.elements, self.pieces, self.said = [self.root], [], []
        self._read(source)
        self._count()

    def _close(self, to: Element | None) -> None:
        """Leaves elements until the one given has been left."""
        while self.at is not self.root:
            e, self.at = self.at, self.at.parent
            if e.tag not in INLINE:
                self.pieces.append(None)
            if e is to:
                break

    def _open_within(self, tags: tuple[str, ...] | frozenset, stops: tuple[str, ...] = ()) -> Element | None:
        return next((e for e in self.at.up() if e.tag in tags or e.tag in stops), None)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and any(e.tag == tag for e in self.at.up()):
            return
        if self.at.tag == "head" and tag not in ("meta", "link", "title", "style", "script", "base", "noscript", "template"):
            self._close(self.at)
        if tag in CLOSES_P:
            p = self._open_within(("p",), ("td", "th", "table", "button", "article", "div", "section", "body"))
            if p is not None and p.tag == "p":
                self._close(p)
        if tag in CLOSES:
            closed, stops = CLOSES[tag]
            e = self._open_within(tuple(closed.split()), stops)
            if e is not None and e.tag not in stops:
                if tag == "tr" and e.tag != "tr":  # a cell of the row before
                    row = next((x for x in e.up() if x.tag in ("tr", "table")), None)
                    e = row if row is not None and row.tag == "tr" else e
                self._close(e)
        name, marked, comments, hidden, role = _marks(tag, attributes)
        e = Element(tag, self.at, _path(self.at.token, name), role, marked, comments, hidden)
        self.elements.append(e)
        if tag not in INLINE:
            self.pieces.append(None)
        if tag not in VOID:
            self.at = e

    def _end(self, tag: str) -> None:
        if tag == "p" and not any(e.tag == "p" for e in self.at.up()):
            self.pieces.append(None)
        headings = ("h1", "h2", "h3", "h4", "h5", "h6")
        e = self._open_within(headings if tag in headings else (tag,), () if tag not in INLINE else ("td", "th", "table", "article", "section", "div", "body"))
        if e is not None and (e.tag == tag or tag in headings):
            self._close(e)

    def _text(self, raw: str) -> None:
        if raw:
            self.pieces.append((self.at, html.unescape(raw), len(self.elements)))

    def _read(self, source: str) -> None:
        self.at, place = self.root, 0
        find = _TOKEN.search
        while True:
            m = find(source, place)
            if m is None:
                self._text(source[place:])
                break
            self._text(source[place : m.start()])
            place = m.end()
            closes, tag, attributes, ended, closes_, tag_, attributes_, ended_ = m.groups()
            if not tag:
                closes, tag, attributes, ended = closes_, tag_, attributes_, ended_
            if not tag or not ended:  # a comment, or a tag that the page's end cuts off
                continue
            tag = tag.lower()
            if closes:
                self._end(tag)
                continue
            self._start(tag, attributes)
            if tag in RAW or tag in ("title", "textarea"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, place)
                place = end.end() if end else len(source)
                self._close(self.at)
        self._close(None)

    def _count(self) -> None:
        titled = set()
        for e in self.elements:
            if e.tag in ("h1", "h2"):
                article = next((x for x in e.up() if x.tag == "article"), None)
                titled.add(id(article))
                if e.tag == "h1" or article is not None:
                    for x in e.up():
                        if e.tag == "h2" and x is article:
                            break
                        x.has_title = True
        for e in self.elements:
            if (e.tag == "article" and not e.comments) or e.tag == "main" or e.role:
                if id(e) in titled or not any(x.comments for x in e.up()):  # comments may be articles, but have no title
                    for x in e.parent.up():
                        x.has_article = True
        for e in self.elements:  # parents come first
            above = e.parent
            e.linked = e.tag == "a" or (above is not None and above.linked)
            e.unseen = e.hidden or e.tag in NEVER or (above is not None and above.unseen)
        for number, piece in enumerate(self.pieces):
            if piece is not None:
                said = piece[1].split()
                if said:
                    e = piece[0]
                    self.said.append((number, " ".join(said)))
                    if e.unseen:
                        continue
                    if e.linked:
                        e.links += len(said)
                    else:
                        e.words += len(said)
        for e in reversed(self.elements):
            if e.parent is not None and not (e.tag in OTHER or e.marked or e.comments):  # those aren't counted further up
                e.parent.words += e.words
                e.parent.links += e.links

    def texts(self) -> Iterator[tuple[Element, str]]:
        """Each text at its element, white space as one space; blank ones are left out."""
        for number, t in self.said:
            yield self.pieces[number][0], t

    def stream(self, texts: bool = True) -> list[tuple[Element, int, int]]:
        """(element, token, number of the piece or -1) of all elements and texts in order; elements learn their place in it."""
        out: list[tuple[Element, int, int]] = []
        done = 0

        def elements(n: int) -> None:
            for e in self.elements[done:n]:
                e.place = len(out)
                out.append((e, e.token, -1))

        if texts:
            for number, t in self.said:
                e, _, before = self.pieces[number]
                if before > done:
                    elements(before)
                    done = before
                out.append((e, hashed(e.token, "text", t), number))
        elements(len(self.elements))
        return out


_STREAMS = "host string, page long, content long, tokens binary, parents binary, words binary, links binary, tags string"


def streams(pages: DataFrame) -> DataFrame:
    """The tokens of each page of a host in order, as arrays of numbers; pages: (key, url, html).  parents are places in the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _STREAMS.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.string()]
        for batch in batches:
            out = []
            for key, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host = host_of(url)
                if host is None or not source:
                    continue
                content = int.from_bytes(hashlib.blake2b(source.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                items = Page(source).stream()
                tokens = array("q", [token for _, token, _ in items])
                parents = array("i", [e.place if number >= 0 else e.parent.place if e.parent else -1 for e, _, number in items])
                words, links = (array("i", [0 if number >= 0 else n for n, (_, _, number) in zip(found, items, strict=True)]) for found in ([e.words for e, _, _ in items], [e.links for e, _, _ in items]))
                tags = " ".join(["#text" if number >= 0 else e.tag for e, _, number in items])
                out.append((host, hashed(content, key), content & 63, tokens.tobytes(), parents.tobytes(), words.tobytes(), links.tobytes(), tags))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names)

    return pages.select("key", "url", "html").mapInArrow(run, _STREAMS)


def by_host(make: Callable[..., object]) -> Callable[..., object]:
    """Makes what belongs to a host once for many of its rows; its columns are read then only."""
    held: dict[str, object] = {}
    size = 0

    def of(host: str, *columns: pa.Scalar) -> object:
        nonlocal size
        found = held.get(host)
        if found is None:
            given = [c.as_py() for c in columns]
            size += ALIKE + sum(len(g) for g in given if isinstance(g, list))
            if size > 250 * ALIKE:
                held.clear()
                size = 0
            found = held[host] = make(*given)
        return found

    return of


def classes_of(found: list[dict]) -> Classes:
    return {c["token"]: (c["number"], c["place"], c["size"]) for c in found}


class Host:
    """What is known of a host; pages whose frequent tokens are alike are worked out once, while they are held."""

    def __init__(self, frequent: list[int], rounds: list[list[dict]], classes: list[dict] | None = None):
        self.frequent, self.rounds, self.classes = set(frequent), [classes_of(r) for r in rounds], classes_of(classes or [])
        self._roles: dict[tuple[int, ...], list[int]] = {}
        self._relations: dict[tuple[int, ...], tuple[set[int], Counter]] = {}
        self._held = 0

    def _room(self, n: int) -> None:
        self._held += n
        if self._held > ALIKE:
            self._roles.clear()
            self._relations.clear()
            self._held = n

    def roles(self, tokens: list[int]) -> list[int]:
        key = tuple(tokens)
        found = self._roles.get(key)
        if found is None:
            self._room(len(key))
            found = self._roles[key] = roles_of(tokens, self.rounds)
        return found

    def relations(self, tokens: list[int]) -> tuple[set[int], Counter]:
        key = tuple(tokens)
        found = self._relations.get(key)
        if found is None:
            self._room(len(key))
            found = self._relations[key] = relations(roles_of(tokens, self.rounds), self.classes)
        return found


_STATS = "host string, token long, x1 long, x2 long, pages long, n long, mask long, words long, links long, place long, tag string, parent long"


def occurrences(pages: DataFrame) -> DataFrame:
    """_STATS of each host's tokens, added up; pages: (key, url, html)."""
    return added_up(streams(pages))


def added_up(found: DataFrame) -> DataFrame:
    """_STATS of the tokens of streams; with columns frequent and rounds, of the roles of frequent tokens.

    Other tokens are in no class, and no role has more pages than its token.  mask has a bit for each page, by a hash of its html."""
    refined = "rounds" in found.columns
    numbers = (("tokens", "q"), ("parents", "i"), ("words", "i"), ("links", "i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        names = [x.split()[0] for x in _STATS.split(", ")]
        known = by_host(Host)

        def rows() -> pa.RecordBatch:
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            flat = [[h, t, signed(v[0]), signed(v[1]), v[2], v[3], signed(v[4]), *v[5:]] for (h, t), v in held.items()]
            types = [pa.string(), *[pa.int64()] * 9, pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else [[]] * 12, types, strict=True)], names)

        for batch in batches:
            hosts, mes, contents, tag_lists = (batch.column(c).to_pylist() for c in ("host", "page", "content", "tags"))
            columns = [batch.column(c).to_pylist() for c, _ in numbers]
            for row, (host, me, content) in enumerate(zip(hosts, mes, contents, strict=True)):
                tokens, parents, words, links = (array(t, c[row]) for c, (_, t) in zip(columns, numbers, strict=True))
                tags = tag_lists[row].split(" ")
                places, roles = range(len(tokens)), tokens
                if refined:
                    of = known(host, batch.column("frequent")[row], batch.column("rounds")[row])
                    places = [k for k in places if tokens[k] in of.frequent]
                    roles = dict(zip(places, of.roles([tokens[k] for k in places]), strict=True))
                here: dict[int, list] = {}
                for k in places:
                    x = here.get(roles[k])
                    if x is None:
                        above = parents[k]
                        here[roles[k]] = [1, words[k], links[k], k, tags[k], roles[above] if above >= 0 else 0]
                    else:
                        x[0] += 1
                        x[1] += words[k]
                        x[2] += links[k]
                marks: dict[int, tuple[int, int]] = {}
                for token, (n, words_, links_, place, tag, parent) in here.items():
                    if n not in marks:
                        r = hashlib.blake2b(b"%d %d" % (me, n), digest_size=16).digest()
                        marks[n] = int.from_bytes(r[:8], "little"), int.from_bytes(r[8:], "little")
                    x1, x2 = marks[n]
                    v = held.get((host, token))
                    if v is None:
                        held[host, token] = [x1, x2, 1, n, 1 << content, words_, links_, place, tag, parent]
                    else:
                        v[0] ^= x1
                        v[1] ^= x2
                        v[2] += 1
                        v[3] += n
                        v[4] |= 1 << content
                        v[5] += words_
                        v[6] += links_
                        v[7] += place
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    sums = [F.sum(c).alias(c) for c in ("pages", "n", "words", "links", "place")]
    return found.mapInArrow(run, _STATS).groupBy("host", "token").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.bit_or("mask").alias("mask"), *sums, F.min("tag").alias("tag"), F.min("parent").alias("parent"))


def templates(stats: DataFrame) -> DataFrame:
    """(host, frame, texts, lists, frequent, classes) of hosts of SUPPORT distinct pages or more.

    frame: (token, parent, tag, words) of the root class's elements in order; texts: tokens of its texts; lists: elements in most pages that are lists of links;
    frequent: tokens in most pages; classes: (number, place, token, size) of those of them in classes of SIZE or more, the root class first, then by pages and size.
    All are of tokens that most pages have, so they are no longer than about two pages' tokens."""
    hosts = stats.filter(F.col("token") == ROOT).filter(F.bit_count("mask") >= SUPPORT).select("host", F.col("pages").alias("host_pages"))
    # tokens that few pages have are dropped before hosts are looked up, so a host of very many pages brings few rows together
    t = stats.filter(F.bit_count("mask") >= SUPPORT).join(hosts, "host").filter(F.col("pages") >= FREQUENT * F.col("host_pages"))
    root = (F.col("pages") == F.col("host_pages")) & (F.col("n") == F.col("host_pages"))
    element = F.col("tag") != "#text"
    by_class = Window.partitionBy("host", "x1", "x2", "pages", "n")
    t = t.withColumn("root", root).withColumn("order", F.col("place") / F.col("pages")).withColumn("size", F.count("*").over(by_class).cast("int"))
    strongest = Window.partitionBy("host").orderBy(F.desc("root"), F.desc("pages"), F.desc("size"), "n", "x1", "x2")
    t = t.withColumn("index", (F.row_number().over(by_class.orderBy("order", "token")) - 1).cast("int")).withColumn("number", F.dense_rank().over(strongest))
    frame = F.array_sort(F.collect_list(F.when(F.col("root") & element, F.struct("order", "token", "parent", "tag", "words"))))
    texts = F.collect_list(F.when(F.col("root") & ~element, F.col("token")))
    linked = (F.col("links") >= LINKS * (F.col("links") + F.col("words"))) & (F.col("links") > 0) & F.col("tag").isin("ul", "ol", "div", "section", "table", "nav", "dl", "p")
    lists = F.collect_list(F.when(linked & element, F.col("token")))
    classes = F.array_sort(F.collect_list(F.when(F.col("size") >= SIZE, F.struct("number", F.col("index").alias("place"), "token", "size"))))
    frequent = [F.collect_list("token").alias("frequent"), F.count(F.when(~element, 1)).alias("frequent_texts")]
    out = t.groupBy("host").agg(frame.alias("f"), texts.alias("texts"), lists.alias("lists"), *frequent, classes.alias("classes"))
    return out.select("host", F.transform("f", lambda x: F.struct(x["token"].alias("token"), x["parent"].alias("parent"), x["tag"].alias("tag"), x["words"].alias("words"))).alias("frame"), "texts", "lists", "frequent", "frequent_texts", "classes")


_CLASSES = "array<struct<number:int,place:int,token:bigint,size:int>>"


def with_host(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of pages with what is found of their host (stored); a host's pages may be a third of all: few tokens are sent
    to all tasks, many are joined, where Spark splits large partitions."""
    arrays = [F.size(F.flatten(c) if t.startswith("array<array") else c) for c, t in found.dtypes if t.startswith("array")]
    tokens = found.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, arrays)), F.lit(0))).first()[0]
    return rows.join(F.broadcast(found) if tokens <= BROADCAST_KEYS else found, "host", how)


def compared(found: DataFrame) -> DataFrame:
    """(host, a, b, gap, n): ``relations`` of streams to their host's classes, added up; b is null where a is a token that breaks the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = by_host(Host)
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            flat = [(*k, n) for k, n in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else [[]] * 5, types, strict=True)], ["host", "a", "b", "gap", "n"])

        for batch in batches:
            for row, (host, tokens) in enumerate(zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist(), strict=True)):
                of = known(host, *(batch.column(c)[row] for c in ("frequent", "rounds", "classes")))
                broken, counts = of.relations([t for t in array("q", tokens) if t in of.frequent])
                for token in broken:
                    held[host, token, None, None] += 1
                for (number, other, gap), n in counts.items():
                    held[host, number, other, gap] += n
            if len(held) > HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    rows = found.select("host", "tokens", "frequent", "rounds", "classes").mapInArrow(run, "host string, a long, b int, gap int, n long")
    return rows.groupBy("host", "a", "b", "gap").agg(F.sum("n").alias("n"))


def _settled(classes: list, found: list | None) -> list:
    broken = {x["a"] for x in found or [] if x["b"] is None}
    counts = {(x["a"], x["b"], x["gap"]): x["n"] for x in found or [] if x["b"] is not None}
    return settled([(c["number"], c["place"], c["token"], c["size"]) for c in classes], broken, Counter(counts))


def deduced(found: DataFrame) -> DataFrame:
    """(host, frame, texts, lists, judged, first_lists, frequent, frequent_texts, rounds) of the hosts of streams (stored).

    rounds: the classes that are ordered and nested, by which tokens are told apart one round after the other; frame, texts
    and lists are of the roles they have then.  judged: roles in most pages; first_lists: lists by tokens, for other roles.
    A host takes another round while its classes win tokens, so the rounds end."""
    first = stored(templates(added_up(found)), "templates")
    given = ["frequent", "frequent_texts", "first_lists"]
    at = first.withColumns({"judged": F.col("frequent"), "first_lists": F.col("lists"), "rounds": F.array().cast(f"array<{_CLASSES}>"), "before": F.lit(0)})
    done = []
    while True:
        facts = compared(with_host(found, at.select("host", "frequent", "rounds", "classes"))).groupBy("host").agg(F.collect_list(F.struct("a", "b", "gap", "n")).alias("facts"))
        at = stored(at.join(facts, "host", "left").withColumn("valid", F.udf(_settled, _CLASSES)("classes", "facts")).drop("facts"), "templates")
        more = F.size("valid") > F.col("before")
        done.append(at.filter(~more))
        at = at.filter(more).withColumn("rounds", F.concat("rounds", F.array("valid")))
        if at.isEmpty():
            break
        again = templates(added_up(with_host(found, at.select("host", "frequent", "rounds"))))
        again = again.withColumnRenamed("frequent", "judged").drop("frequent_texts")
        kept = at.select("host", *given, "rounds", "valid", F.col("classes").alias("classes_before"), F.size("valid").alias("before"))
        at = stored(again.join(kept, "host"), "templates")
        same = F.col("classes") == F.col("classes_before")
        done.append(at.filter(same))
        at = at.filter(~same).drop("classes_before", "valid")
        if at.isEmpty():
            break
    columns = ["host", "frame", "texts", "lists", "judged", *given, "rounds", "valid"]
    all_ = reduce(DataFrame.unionByName, [d.select(columns) for d in done])
    valid = F.col("valid")["token"]
    frame = F.filter("frame", lambda x: (x["token"] == ROOT) | F.array_contains(valid, x["token"]))
    return all_.withColumn("frame", frame).withColumn("texts", F.array_intersect("texts", valid)).drop("valid")


class Template(Host):
    """A host's row of ``deduced``."""

    def __init__(self, frame: list[dict], texts: list[int], lists: list[int], judged: list[int], first_lists: list[int], frequent: list[int], frequent_texts: int, rounds: list[list[dict]]):
        super().__init__(frequent, rounds)
        self.order = {f["token"]: k for k, f in enumerate(frame)}
        self.article = frame_place(frame)
        self.texts, self.lists, self.has_texts = set(texts), set(lists), frequent_texts > 0
        self.judged, self.first_lists = set(judged), set(first_lists)

    def told(self, page: Page) -> tuple[set[int], set[int]]:
        """Gives the page's elements their roles; returns ids of those that are lists of links, and numbers of pieces that belong to the template."""
        items = [x for x in page.stream(self.has_texts) if x[1] in self.frequent]
        lists, fixed = set(), set()
        for (e, token, number), role in zip(items, self.roles([token for _, token, _ in items]), strict=True):
            if number >= 0:
                if role in self.texts:
                    fixed.add(number)
                continue
            e.token = role
            if role in self.lists or (role not in self.judged and token in self.first_lists):
                lists.add(id(e))
        return lists, fixed


def frame_place(frame: list[dict]) -> int | None:
    """The token of the element in which the walk along the frame ends."""
    children: dict[int, list[dict]] = {}
    for f in frame:
        children.setdefault(f["parent"], []).append(f)
    at = next((f for f in frame if f["token"] == ROOT), None)
    while at is not None:
        inside = [f for f in children.get(at["token"], []) if f["tag"] in CONTAINERS]
        best = max(inside, key=lambda f: f["words"], default=None)
        if best is None or not best["words"] or best["words"] < MOST * at["words"]:
            return at["token"]
        at = best
    return None


def own_place(page: Page) -> Element:
    """The element in which the walk along the page's own elements ends."""
    children: dict[int, list[Element]] = {}
    for e in page.elements[1:]:
        children.setdefault(id(e.parent), []).append(e)
    at = page.root
    while True:
        inside = [e for e in children.get(id(at), []) if e.tag in CONTAINERS and not e.other(page.root.words)]
        best = max(inside, key=lambda e: e.words, default=None)
        if best is None or not best.words or best.words < MOST_ALONE * at.words:
            return at
        at = best


def article_places(page: Page, template: Template | None) -> list[Element]:
    """The elements that hold the article."""
    total = page.root.words
    open_ = lambda e: not any(x.other(total) for x in e.up())
    for wanted in (lambda e: e.tag == "article" and not e.comments, lambda e: e.role == "main", lambda e: e.tag == "main"):
        marked = [e for e in page.elements if wanted(e) and open_(e)]
        marked = [e for e in marked if not any(wanted(x) for x in e.up() if x is not e)]
        if len(marked) > 1:
            once = template.order if template else {}
            framed = [e for e in marked if e.token in once]
            longest = max(marked, key=lambda e: e.words)
            marked = framed or ([longest] if 2 * longest.words > sum(e.words for e in marked) else marked)
        if marked:
            return marked
    if template:
        order = template.order
        seen = [order[e.token] for e in page.elements if e.token in order]
        if len(seen) == len(order) and seen == sorted(seen):  # the page has the frame, once and in order
            found = [e for e in page.elements if e.token == template.article]
            if found and open_(found[0]):
                return found
    return [own_place(page)]


def main_text(source: str | None, template: Template | None = None) -> str:
    """The text of one page."""
    if not source:
        return ""
    page = Page(source)
    lists, fixed = template.told(page) if template else (set(), set())
    places = {id(e) for e in article_places(page, template)}
    total = page.root.words
    kept: dict[int, bool] = {}

    def keeps(e: Element) -> bool:
        """Whether texts of the element belong to the article."""
        found = kept.get(id(e))
        if found is None:
            if id(e) in places:
                found = True
            elif e.other(total) or id(e) in lists:
                found = False
            else:
                found = e.parent is not None and keeps(e.parent)
            kept[id(e)] = found
        return found

    for e in page.elements:  # parents come first, so no chain is followed far
        keeps(e)
    blocks, block = [], []
    for number, piece in enumerate([*page.pieces, None]):
        if piece is None:
            t = " ".join("".join(block).split())
            if t:
                blocks.append(t)
            block = []
        elif keeps(piece[0]):
            if number in fixed and not any(x.tag in PROSE for x in piece[0].up()):
                continue
            block.append(piece[1])
    return " ".join(blocks)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row."""
    p = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{markup}`").cast("string").alias("html"))
    found = stored(deduced(stored(streams(p.select(F.xxhash64("key").alias("key"), "url", "html")), "streams")), "templates")
    columns = [c for c in found.columns if c != "host"]
    host = F.lower(F.regexp_extract("url", r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    joined = with_host(p.withColumn("host", host), found, "left")
    key_type = p.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = by_host(lambda *given: Template(**dict(zip(columns, given, strict=True))))
        for batch in batches:
            hosts, sources = (batch.column(c).to_pylist() for c in ("host", "html"))
            given = [batch.column(c) for c in columns]
            out = []
            for k, source in enumerate(sources):
                template = known(hosts[k], *(c[k] for c in given)) if given[0][k].is_valid else None
                out.append(main_text(source, template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["key", "url", "text", "n_chars"])

    rows = joined.select("key", "url", "html", "host", *columns).mapInArrow(run, f"key {key_type}, url string, text string, n_chars long")
    return rows.withColumnRenamed("key", key).withColumnRenamed("url", url)
