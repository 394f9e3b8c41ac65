"""Main text of web pages: a host's template by equivalence classes of tokens, and the slots it leaves.

Pages of one host come from one template, or from one for each type of page. A page is read as tokens: tags in their
place (the path of open elements, containers of one name counted among their siblings) and texts in theirs. Tokens
that occur equally often on each distinct page content of the host form an equivalence class; how often each content
has a token is held as one digest, combined like a sum, so it is computed for hosts of any size. A class is valid if

- enough distinct contents have it,
- its tokens keep one order: a page has them as one unit, or as that unit repeated (tokens whose rank differs between
  pages are left out),
- it nests: each unit lies in one gap between neighbouring tokens of the class of the element around it, the same gap
  on all pages.

Valid classes nest into the template. A text of a valid class is constant if the same contents have it and the element
it lies in, or if its class holds an element with labels outside the content (which marks a type of page). What is left is in slots: elements
of valid classes with text that isn't constant, scored by the mean of its length over the host's contents. Containers
whose number varies (a list of comments, paragraphs in ``div``) belong to the slot around them.

Names and labels say what is never main text, and which element is the content if a page names one. Where it names
none, the page's slot of the best score is the text, with all that lies below it; on hosts without a template it is
the page's own fullest element.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, written

#: A class is frequent if so many distinct page contents of a host have it.
LEAST_PAGES = 4
#: Kinds of tokens: a tag in its place; an opening one with labels, outside the content; a text that may be main text;
#: containers of one name within one element.
STRUCTURE, MARKER, TEXT, GROUP = range(4)
#: What a template says: a constant text, containers whose number varies, a slot and its score.
CONSTANT, VARIES, SLOT = range(3)
#: Tokens and templates are broadcast up to so many rows, 24 bytes each; beyond it each page gets those it has by
#: shuffles.
BROADCAST_ROWS = 1_000_000

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(script|style|noscript|template|svg|iframe|object|textarea|select|canvas|video|audio)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>(?:.*?)(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_attribute = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_any_attribute = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_maybe_hidden = re.compile(r"hidden|display\s*:\s*none", re.I)
_no_display = re.compile(r"display\s*:\s*none", re.I)
_name = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()) | frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd semantics annotation annotation-xml".split()
)
#: Elements that are never main text, and names in class, id or role that say the same.
ASIDE = frozenset("head title nav footer aside form button fieldset menu dialog input option".split())
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert "
    "newsletter subscribe subscription signup popup modal overlay sidebar rail menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments "
    "disqus respond reply replies discussion share sharing social related recommended recommendations widget toolbar pagination pager login search skip contentinfo complementary".split()
)
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: Elements within a text: what they hold belongs to the element around them.
WITHIN = frozenset("p h1 h2 h3 h4 h5 h6 hgroup section ul ol li dl dt dd blockquote pre address figure figcaption details summary table caption thead tbody tfoot tr td th".split())
HOLDERS = frozenset("ul ol dl table body html article main section div".split())
#: Turns the token of an element's opening tag into that of its closing one.
CLOSES = 0x5555


class Node:
    """An open element: digests of its path and of its place (a path that counts containers), of the containers of its
    name beside it, whether its text can be main text, and whether it is the content."""

    __slots__ = ("tag", "path", "place", "group", "main", "content", "above", "counts")

    def __init__(self, tag: str, path: int, place: int, group: int, main: bool, content: bool, above: Node | None = None):
        self.tag, self.path, self.place, self.group, self.main, self.content, self.above = tag, path, place, group, main, content, above
        self.counts: dict[str, int] = {}


def _digest(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed & (1 << 64) - 1)


def _hides(attributes: str) -> bool:
    """Whether an element is hidden by an attribute of its own, not by a word in another's value."""
    if not _maybe_hidden.search(attributes):
        return False
    for m in _any_attribute.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _no_display.search(value):
            return True
    return False


class Reader:
    """Reads one page into structural tokens and blocks of text."""

    def __init__(self, page: str):
        self.tokens: list[int] = []
        #: The place of the element around each token.
        self.around: list[int] = []
        #: Tokens of elements with labels outside the content, and of texts that may be main text with that of their element.
        self.markers: set[int] = set()
        self.texts: dict[int, int] = {}
        #: How many containers of one name an element has.
        self.groups: dict[int, int] = {}
        #: (text, in the content element, may be main, token of the text, element that holds it)
        self.blocks: list[tuple[str, bool, bool, int, Node]] = []
        self.stack = [Node("", 0, 0, 0, True, False)]
        self.parts: list[str] = []
        self._read(page)

    def _token(self, token: int, around: int) -> None:
        self.tokens.append(token)
        self.around.append(around)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            top = self.stack[-1]
            token = _digest(text, top.place)
            self._token(token, top.place)
            if top.main:
                self.texts[token] = top.place
            holder = next(n for n in reversed(self.stack) if n.tag not in WITHIN)
            self.blocks.append((text, top.content, top.main, token, holder))

    def _open(self, tag: str, attributes: str) -> None:
        names, labels = set(), ""
        for m in _attribute.finditer(attributes):
            value = next((g for g in m.groups()[1:] if g is not None), "").lower()
            names.update(_name.findall(value))
            labels += f".{value}" if m[1].lower() != "id" or not any(c.isdigit() for c in value) else ""
        above = self.stack[-1]
        content = above.content or tag in ("article", "main") or "main" in names and tag not in ("html", "body")
        main = above.main and tag not in ASIDE and not (names & NOT_MAIN and tag not in ("html", "body", "article", "main")) and not (tag == "header" and not above.content)
        if main and attributes and _hides(attributes):
            main = False
        key, group = tag + labels, 0
        path = place = _digest(key, above.path)
        if tag not in WITHIN:
            number = above.counts[key] = above.counts.get(key, 0) + 1
            place = _digest(f"{key}#{number}", above.place)
            group = _digest(f"{key}*", above.place)
            self.groups[group] = max(number, self.groups.get(group, 0))
        elif above.place != above.path:
            place = _digest(key, above.place)
        self.stack.append(Node(tag, path, place, group, main, content, above))
        self._token(place, above.place)
        if labels and not content:
            self.markers.add(place)

    def _read(self, page: str) -> None:
        at = 0
        for m in _token.finditer(page):
            if m.start() > at:
                self.parts.append(entities.unescape(page[at : m.start()]))
            at = m.end()
            if m[3] is None:
                if m[1] is not None:
                    self.parts.append(" ")
                continue
            tag = m[3].lower()
            if tag in INLINE:
                if tag in ("br", "img"):
                    self.parts.append(" ")
                continue  # marks within a block don't part it
            self._flush()
            if m[2]:
                if any(n.tag == tag for n in self.stack[1:]):
                    while (top := self.stack.pop()).tag != tag:
                        pass
                    self._token(top.place ^ CLOSES, self.stack[-1].place)
                continue
            if tag == "p" or tag in CLOSED_BY or tag not in VOID:
                self._imply(tag)
            if tag in VOID:
                continue
            self._open(tag, m[4])
            if m[4].endswith("/") and tag not in HOLDERS:
                self.stack.pop()
        if at < len(page):
            rest = page[at:]
            self.parts.append(entities.unescape(rest))
        self._flush()

    def _imply(self, tag: str) -> None:
        """A block ends an open paragraph, an item the item before it."""
        ends = CLOSED_BY.get(tag, frozenset()) | {"p"}
        for k in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[k].tag
            if open_tag in ends:
                del self.stack[k:]
                return
            if open_tag in HOLDERS or open_tag in ASIDE:
                return


def host_of(url_col: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _content(reader: Reader) -> int:
    return xxhash.xxh64_intdigest(np.array(reader.tokens, np.uint64).tobytes())


def _listed(batch: pa.RecordBatch, contents: list[int], columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    """A row for each page: host, digest of its content, and lists of equal length."""
    lists = [pa.array(values, pa.list_(kind)) for values, kind in columns.values()]
    return pa.RecordBatch.from_arrays([batch.column("host"), pa.array(_signed(contents)), *lists], names=["host", "content", *columns])


def _occurrences(pages: DataFrame) -> DataFrame:
    """(host, content, token, n, kind, parent) of distinct page contents: how often one has each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "h", 1 << 22):
            contents, tokens, times, kinds, parents = [], [], [], [], []
            for page in batch.column("h").to_pylist():
                reader = Reader(page or "")
                contents.append(_content(reader))
                often = Counter(reader.tokens)
                kind = dict.fromkeys(often, STRUCTURE) | dict.fromkeys(reader.markers, MARKER) | dict.fromkeys(reader.texts, TEXT) | dict.fromkeys(reader.groups, GROUP)
                tokens.append(_signed(list(kind)))
                times.append([often.get(t) or reader.groups[t] for t in kind])
                kinds.append(list(kind.values()))
                parents.append(_signed([reader.texts.get(t, 0) for t in kind]))
            yield _listed(batch, contents, {"token": (tokens, pa.int64()), "n": (times, pa.int32()), "kind": (kinds, pa.int8()), "parent": (parents, pa.int64())})

    read = pages.select("host", "h").mapInArrow(run, "host string, content long, token array<long>, n array<int>, kind array<byte>, parent array<long>")
    return read.dropDuplicates(["host", "content"]).select("host", "content", F.inline(F.arrays_zip("token", "n", "kind", "parent")))


def frequent_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, vector, present, pages, kind, parent, least, most): tokens that ``LEAST_PAGES`` distinct contents have."""
    found = _occurrences(pages).groupBy("host", "token")
    # each content has a token once here, so nothing cancels out
    found = found.agg(F.expr("bit_xor(xxhash64(content, n))").alias("vector"), F.expr("bit_xor(content)").alias("present"), F.count("*").alias("pages"), F.max("kind").alias("kind"), F.max("parent").alias("parent"), F.min("n").alias("least"), F.max("n").alias("most"))
    return found.filter(f"pages >= {LEAST_PAGES}")


class Known:
    """What is known of a host's tokens: the class of each, and containers whose number varies."""

    def __init__(self, listed: list[dict]):
        self.classes = {t["token"] & MASK: t["vector"] for t in listed if t["kind"] != GROUP}
        self.varies = {t["token"] & MASK for t in listed if t["kind"] == GROUP and t["least"] < t["most"]}


MASK = (1 << 64) - 1


def _ranks(tokens: list[int]) -> dict[int, int]:
    """The place, from 1, of each token of a class in the unit that a page repeats; 0 where units differ."""
    unit = len(set(tokens))
    ranks: dict[int, int] = {}
    for i, t in enumerate(tokens):
        rank = i % unit + 1
        if ranks.setdefault(t, rank) != rank:
            ranks[t] = 0
    return ranks


def _gap(reader: Reader, classes: dict[int, int], where: list[int], of_class: dict[int, list[int]]) -> int:
    """The gap of the class around it that all units of a class lie in; 0 if they lie in several or across one's end."""
    unit = len({reader.tokens[i] for i in where})
    gaps = set()
    for k in range(0, len(where), unit):
        first, last = where[k], where[min(k + unit, len(where)) - 1]
        outer = of_class.get(classes.get(reader.around[first], 0), ())
        a, b = bisect.bisect(outer, first), bisect.bisect(outer, last)
        gaps.add((classes.get(reader.around[first], 0), reader.tokens[outer[a - 1]] if a else 0) if a == b else None)
    return _digest(str(gaps.pop())) or 1 if len(gaps) == 1 and None not in gaps else 0


def _slot(node: Node, varies: set[int]) -> Node:
    """The element whose slot an element's text is in: containers whose number varies belong to what is around them."""
    while node.above and (node.tag in WITHIN or node.group in varies):
        node = node.above
    return node


def _measured(rows: DataFrame, by_host: bool) -> DataFrame:
    """(host, what, key, ordered, gap): of each content, the rank of each token in its class and the gap of that (what 0),
    and the length of the text in each element (what 1, in ``ordered``); rows have host, h and known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = _Remembered(by_host, Known)
        for batch in blocks(batches, "h", 1 << 22):
            contents, whats, keys, orders, gaps = [], [], [], [], []
            for k, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("h").to_pylist())):
                known, reader = remembered(host, batch.column("known"), k), Reader(page)
                of_class: dict[int, list[int]] = {}
                for i, t in enumerate(reader.tokens):
                    if t in known.classes:
                        of_class.setdefault(known.classes[t], []).append(i)
                rows = []
                for where in of_class.values():
                    gap = _gap(reader, known.classes, where, of_class)
                    rows += [(0, t, rank, gap) for t, rank in _ranks([reader.tokens[i] for i in where]).items()]
                size: Counter[int] = Counter()
                for text, _, main, token, holder in reader.blocks:
                    if main and token not in known.classes:
                        size[_slot(holder, known.varies).place] += len(text)
                rows += [(1, place, n, 0) for place, n in size.items()]
                what, key, order, gap = zip(*rows) if rows else ((), (), (), ())
                contents.append(_content(reader))
                whats.append(list(what))
                for to, values in ((keys, key), (orders, order), (gaps, gap)):
                    to.append(_signed([v & MASK for v in values]))
            lists = {"what": (whats, pa.int8()), "key": (keys, pa.int64()), "ordered": (orders, pa.int64()), "gap": (gaps, pa.int64())}
            yield _listed(batch, contents, lists)

    read = rows.select("host", "h", "known").mapInArrow(run, "host string, content long, what array<byte>, key array<long>, ordered array<long>, gap array<long>")
    return read.dropDuplicates(["host", "content"]).select("host", F.inline(F.arrays_zip("what", "key", "ordered", "gap")))


def template(tokens: DataFrame, measured: DataFrame) -> DataFrame:
    """(host, token, says, value) of hosts' templates, from their frequent tokens and the contents measured by them."""
    same = (F.min("ordered") == F.max("ordered")) & (F.min("ordered") != 0) & (F.min("gap") == F.max("gap")) & (F.min("gap") != 0)
    valid = measured.filter("what = 0").groupBy("host", F.col("key").alias("token")).agg(same.alias("same")).filter("same").select("host", "token")
    holds = tokens.filter(f"kind <> {GROUP}").join(valid, ["host", "token"], "left_semi")
    texts, tags = holds.filter(f"kind = {TEXT}"), holds.filter(f"kind <> {TEXT}")
    elements = tokens.filter(f"kind in ({STRUCTURE}, {MARKER})").select("host", F.col("token").alias("parent"), F.col("present").alias("around"))
    markers = tags.filter(f"kind = {MARKER}").select("host", "vector").distinct().withColumn("marked", F.lit(True))
    constant = texts.join(elements, ["host", "parent"], "left").join(markers, ["host", "vector"], "left").filter("around = present or marked")
    filled = measured.filter("what = 1").groupBy("host", F.col("key").alias("token")).agg(F.sum("ordered").alias("size"))
    slots = tags.join(filled, ["host", "token"]).select("host", "token", F.lit(SLOT).alias("says"), F.expr("size div pages").alias("value"))
    varies = tokens.filter(f"kind = {GROUP} and least < most").select("host", "token", F.lit(VARIES).alias("says"), F.lit(0).cast("long").alias("value"))
    return constant.select("host", "token", F.lit(CONSTANT).alias("says"), F.lit(0).cast("long").alias("value")).unionByName(varies).unionByName(slots)


def _with_known(rows: DataFrame, table: DataFrame, columns: list[str]) -> tuple[DataFrame, bool]:
    """Rows with what a table (host, token, ...) says of their host, ``known``, and whether that is the same for all pages
    of it: a table too large to be broadcast gives each page what it says of the page's own tokens."""
    entry = F.struct("token", *columns)
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.groupBy("host").agg(F.collect_list(entry).alias("known"))), "host", "left"), True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "h", 1 << 22):
            found = []
            for h in batch.column("h").to_pylist():
                reader = Reader(h)
                found.append(_signed(list({*reader.tokens, *reader.groups})))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(found, pa.list_(pa.int64()))], names=["host", "page", "token"])

    paged = rows.withColumn("page", F.xxhash64("h"))
    had = paged.select("host", "page", "h").mapInArrow(run, "host string, page long, token array<long>")
    had = had.dropDuplicates(["host", "page"]).select("host", "page", F.explode("token").alias("token"))
    said = had.join(table, ["host", "token"]).groupBy("host", "page").agg(F.collect_list(entry).alias("known"))
    return paged.join(said, ["host", "page"], "left").drop("page"), False


class _Remembered:
    """What is known of a page's host, made once for neighbouring pages of a host."""

    def __init__(self, by_host: bool, make: Callable):
        self.by_host, self.make, self.of = by_host, make, {}

    def __call__(self, host: str, column: pa.Array, k: int):
        if not self.by_host:
            return self.make(column[k].as_py() or [])
        if host not in self.of:
            if len(self.of) > 64:
                self.of.clear()
            self.of[host] = self.make(column[k].as_py() or [])
        return self.of[host]


class Template:
    """A host's constant texts, containers whose number varies, and slots with their scores."""

    def __init__(self, listed: list[dict] = ()):
        of = lambda what: {t["token"] & MASK: t["value"] for t in listed if t["says"] == what}
        self.constant, self.varies, self.slots = of(CONSTANT), of(VARIES), of(SLOT)


def _below(node: Node, known: dict[int, bool], place: Callable[[Node], int]) -> bool:
    """Whether an element or one around it is known to be in the slot; the answer is kept for all on the way."""
    way, at = [], node
    while at and place(at) not in known:
        way.append(place(at))
        at = at.above
    found = known[place(at)] if at else False
    known.update(dict.fromkeys(way, found))
    return found


def main_text(page: str, template: Template = Template(), named: bool = True) -> str:
    """The page's blocks that are main text, one a line. Without ``named``, a content element that is named counts as any."""
    reader = Reader(page)
    left = [b for b in reader.blocks if b[2] and b[3] not in template.constant]
    content = [b for b in left if b[1]] if named else []
    if not content and left:  # the page's best slot with all that lies below it
        place = (lambda n: n.place) if template.slots else (lambda n: n.path)
        size: Counter[int] = Counter()
        nodes: dict[int, Node] = {}
        for text, _, _, _, holder in left:
            node = _slot(holder, template.varies)
            size[place(node)] += len(text)
            nodes.setdefault(place(node), node)
        best = max(size, key=lambda p: (template.slots.get(p, -1), size[p]))
        node = nodes[best].above
        while node:  # it is part of a slot around it that has text of its own
            best, node = place(node) if place(node) in size else best, node.above
        below: dict[int, bool] = {best: True}
        content = [b for b in left if _below(b[4], below, place)]
    return "\n".join(b[0] for b in content)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", named: bool = True) -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    A null or empty html gives the empty text. A page without a host (null or relative url) is one of the pages of the
    host "". Hosts of fewer than ``LEAST_PAGES`` distinct contents have no template, so only elements' names and labels
    decide. Repeated rows give repeated results and change no other; of slots of equal score the page's fuller one
    counts; an empty table gives no rows; extra columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"), host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("h"))
    tokens = written(frequent_tokens(rows))
    known, by_host = _with_known(rows, tokens, ["vector", "kind", "least", "most"])
    found = written(template(tokens, written(_measured(known, by_host))))
    joined, by_host = _with_known(rows, found, ["says", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = _Remembered(by_host, Template)
        for batch in blocks(batches, "h", 1 << 22):
            hosts, htmls = batch.column("host").to_pylist(), batch.column("h").to_pylist()
            texts = [main_text(page, remembered(host, batch.column("known"), k), named) for k, (host, page) in enumerate(zip(hosts, htmls))]
            columns = [batch.column("id"), batch.column("u"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "u", "text", "n_chars"])

    schema = f"id {pages.schema[id_col].dataType.simpleString()}, u string, text string, n_chars long"
    return joined.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "u": url_col})
