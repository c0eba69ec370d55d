"""Main text of web pages by wrappers inferred from pages of the same host.

A page is a stream of tags and texts, read as nested elements (missing end tags are implied). A host's wrapper is a
union-free regular expression over such streams: each element has a sequence of parts, every part being required or
optional, single or repeated, and every text either fixed or a slot. It is inferred by alignment. Within one page,
neighbouring equal elements, and neighbouring equal groups of up to GROUP elements, become one repeated part. Two
expressions of one element are merged by aligning their parts: texts that differ become a slot, parts that only one has
become optional, a part that is repeated in either is repeated.

The wrapper tells what is main text: the content elements (those ``article`` and ``main`` that hold slots, else the smallest
element that holds most of the slots' text), without fixed texts that at least FIXED_PAGES different pages share (pages of
the same texts count once; within content, only lines without slots that aren't titles), and without elements whose tag or class
names page furniture. Such a name is a hint only: an
element that holds most of the text of ``article``/``main``, or most of the slots' text, is read. Texts in a run of
neighbouring equal elements are slots. A page whose content elements are missing or hold fixed texts only is read with these,
then from its body, then from any ``article``/``main``, then with elements that only a class names furniture.

Text: character references are decoded, white space within a block becomes one space, blocks are joined by two line feeds.

Distribution: wrappers are merged inside each task first, then per host by groups of PARTIALS partial wrappers, level by
level, so that no task holds a partial wrapper of every task. A wrapper grows with the different structures of a host's pages. Pages
meet their wrapper in a join on the host. The order in which pages are merged depends on the file splits and can decide which of
two equally long alignments is taken.

Null and empty pages have empty text. Null URLs and URLs without a host share one wrapper. Unclosed tags, comments and
references are read as far as they go. Repeated rows get equal texts; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidied, with_fields
from .url_filter import host_and_path

GROUP = 3
FIXED_PAGES = 4
#: Nested elements; deeper ones hold nothing themselves.
DEPTH = 128
#: Partial wrappers of a host that are merged at once.
PARTIALS = 64
#: Most parts that are aligned by the quadratic method; longer sequences are aligned by their longest common blocks.
ALIGNED = 120

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
             "sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
               "nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
                "option": {"option"}}
FURNITURE = set("nav footer aside form button select menu dialog head title".split())
BARRIERS = {"p", "td", "th", "li", "button"}
CONTENT = {"article", "main"}
#: Titles within content stay whether or not other pages have them too.
TITLES = set("h1 h2 h3 h4 h5 h6 caption figcaption summary th dt".split())
FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|side-?bar|aside|footer|site-?header|masthead|"
    r"top-?bar|comments?|respon[ds]\w*|replies|disqus\w*|cookies?|consent|gdpr|notice|alert|newsletter|subscribe|signup|login|share|sharing|"
    r"social|related|recommended|popup|modal|overlay|widget|tags?|pagination|pager|search\w*|skip\w*|copyright)(?:$|[\s_-])", re.I)


class Element:
    __slots__ = ("key", "parts", "text", "size", "optional", "repeated", "pages")

    def __init__(self, key: str):
        self.key, self.parts, self.text, self.size = key, [], None, 0
        self.optional, self.repeated = False, False
        self.pages: tuple[int, ...] = ()  # of a text: the least FIXED_PAGES hashes of the pages that hold it


def parse(page: str) -> Element:
    """The page's elements; a text is a part with the key ``#`` and its raw string.

    Elements nested deeper than DEPTH hold nothing themselves: what they hold follows them, and they end with an
    empty element of their own, so that blocks stay apart.
    """
    root = Element("")
    stack, tags = [root], [""]
    opened = Counter(tags)
    marks: list[int] = []  # places in ``tags`` of the elements that decide whether a paragraph is open
    at = 0

    def add(raw: str) -> None:
        if raw and not raw.isspace():
            e = Element("#")
            e.text = raw
            stack[-1].parts.append(e)

    def close(size: int) -> None:
        """Ends all elements from place ``size`` on."""
        while len(tags) > size:
            tag = tags.pop()
            opened[tag] -= 1
            if stack.pop() is stack[-1] and tag not in INLINE:
                stack[-1].parts.append(Element(tag))
        while marks and marks[-1] >= size:
            marks.pop()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if opened[tag]:
                size = len(tags) - 1
                while tags[size] != tag:
                    size -= 1
                close(size)
            continue
        if tag in CLOSES_P and marks and tags[marks[-1]] == "p":
            close(marks[-1])
        elif tag in SELF_CLOSING and any(opened[x] for x in SELF_CLOSING[tag]):
            for i in range(len(tags) - 1, 0, -1):
                if tags[i] in SELF_CLOSING[tag]:
                    close(i)
                    break
                if tags[i] in ("ul", "ol", "dl", "table", "select"):
                    break
        names = " ".join(x or y or z for x, y, z in _NAMES.findall(m.group(4))) if "=" in m.group(4) else ""
        key = tag + ("." + " ".join(sorted(set(re.sub(r"\d+", "", names).split()))) if names else "")
        e = Element(key)
        stack[-1].parts.append(e)
        if tag not in VOID and not m.group(4).rstrip().endswith("/"):
            if tag in BARRIERS:
                marks.append(len(tags))
            stack.append(e if len(stack) < DEPTH else stack[-1])
            tags.append(tag)
            opened[tag] += 1
    if at < len(page) and (cut := page[at:].find("<")) != 0:
        add(page[at:] if cut < 0 else page[at:at + cut])
    return root


# ---- inference ----------------------------------------------------------------------------------------------

def _summary(raw: str) -> tuple[int, int]:
    s = " ".join(raw.split())
    return zlib.crc32(s.encode("utf-8", "replace")), len(s)


def _page_hash(e: Element, seed: int = 0) -> int:
    """Hash of all texts of a page, whatever their tags."""
    for p in e.parts:
        seed = _page_hash(p, seed) if p.text is None else zlib.crc32(b"%d" % _summary(p.text)[0], seed)
    return seed


def expression(e: Element, page: int | None = None) -> Element:
    """The element as an expression of its own: texts by hash and size, repeated parts folded."""
    page = _page_hash(e) if page is None else page
    out = Element(e.key)
    if e.text is not None:
        out.text, out.size = _summary(e.text)
        out.pages = (page,)
        return out
    out.parts = fold([expression(x, page) for x in e.parts])
    return out


def fold(parts: list[Element]) -> list[Element]:
    """Neighbouring equal parts, then neighbouring equal groups, as one repeated part."""
    for width in range(1, GROUP + 1):
        out: list[Element] = []
        i = 0
        while i < len(parts):
            keys = [x.key for x in parts[i:i + width]]
            j = i + width
            if len(keys) == width and [x.key for x in parts[j:j + width]] == keys:
                group = _grouped(parts[i:j])
                while [x.key for x in parts[j:j + width]] == keys:
                    merge(group, _grouped(parts[j:j + width]))
                    j += width
                group.repeated = True
                out.append(group)
                i = j
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def _grouped(parts: list[Element]) -> Element:
    if len(parts) == 1:
        return parts[0]
    g = Element("(" + " ".join(x.key for x in parts) + ")")
    g.parts = list(parts)
    return g


def merge(a: Element, b: Element) -> Element:
    """``a`` widened so that it matches what ``b`` matches too; of equal keys."""
    a.optional |= b.optional
    a.repeated |= b.repeated
    a.size += b.size
    if a.pages != b.pages:
        a.pages = tuple(sorted({*a.pages, *b.pages})[:FIXED_PAGES])
    if a.key == "#":
        a.text = a.text if a.text == b.text else None
        return a
    if [x.key for x in a.parts] == [x.key for x in b.parts]:
        for x, y in zip(a.parts, b.parts):
            merge(x, y)
        return a
    out: list[Element] = []
    i = j = 0
    for x, y in [*_common([p.key for p in a.parts], [p.key for p in b.parts]), (len(a.parts), len(b.parts))]:
        for lone in (*a.parts[i:x], *b.parts[j:y]):
            lone.optional = True
            out.append(lone)
        if x < len(a.parts):
            out.append(merge(a.parts[x], b.parts[y]))
        i, j = x + 1, y + 1
    a.parts = _unified(out)
    return a


def _unified(parts: list[Element]) -> list[Element]:
    """Neighbouring parts of one key (one optional, say) become one repeated part."""
    out: list[Element] = []
    for p in parts:
        if out and out[-1].key == p.key:
            both = out[-1].optional and p.optional
            merge(out[-1], p)
            out[-1].repeated, out[-1].optional = True, both
        else:
            out.append(p)
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence."""
    if len(a) * len(b) > ALIGNED ** 2:
        from difflib import SequenceMatcher

        return [(m.a + i, m.b + i) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for i in range(m.size)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def dumped(e: Element) -> list:
    return [e.key, e.text, e.size, int(e.optional), int(e.repeated), e.pages, [dumped(x) for x in e.parts]]


def loaded(x: list) -> Element:
    e = Element(x[0])
    e.text, e.size, e.optional, e.repeated, e.pages = x[1], x[2], bool(x[3]), bool(x[4]), tuple(x[5])
    e.parts = [loaded(y) for y in x[6]]
    return e


# ---- reading ------------------------------------------------------------------------------------------------

def _tag(key: str) -> str:
    return key.partition(".")[0]


def is_furniture(key: str, in_content: bool) -> bool:
    tag, _, names = key.partition(".")
    if tag in CONTENT:
        return False
    return tag in FURNITURE or (tag == "header" and not in_content) or bool(names and FURNITURE_NAME.search(names))


class Wrapper:
    """What a host's expression tells: the content elements' paths, fixed texts by path, and the paths of elements that are
    read though their names are furniture's."""

    def __init__(self, root: Element):
        self.fixed: dict[str, set[int]] = {}
        self.slots: dict[int, int] = {}
        self.content: set[str] = set()
        self.read: set[str] = set()
        self._all: dict[int, tuple[int, int]] = {}
        self._sum(root)
        self.whole, self.marked = self._all[id(root)]
        self._walk(root, "", None)
        if not self.content:
            self._descend(root)

    @staticmethod
    def _is_fixed(p: Element) -> bool:
        return p.text is not None and len(p.pages) >= FIXED_PAGES

    def _sum(self, e: Element) -> tuple[int, int]:
        """Size of all slots below, furniture's too, and of those in ``article``/``main``."""
        total = marked = 0
        for p in e.parts:
            if p.key == "#":
                total += 0 if self._is_fixed(p) else p.size
            elif _tag(p.key) not in ("head", "title"):
                some = self._sum(p)
                total, marked = total + some[0], marked + some[1]
        self._all[id(e)] = total, total if _tag(e.key) in CONTENT else marked
        return self._all[id(e)]

    def _holds_most(self, p: Element, inside: Element | None) -> bool:
        """Whether an element with a furniture name holds most of what is sought."""
        total, marked = self._all.get(id(p), (0, 0))
        if inside is None and self.marked:
            return 2 * marked > self.marked
        named_only = _tag(p.key) not in FURNITURE - {"form"}
        return named_only and 2 * total > (self.whole if inside is None else self._all[id(inside)][0])

    def _line(self, e: Element) -> int:
        """Size of the slots that stand in one line with the texts of ``e``."""
        total = 0
        for p in e.parts:
            if p.key == "#":
                total += 0 if self._is_fixed(p) else p.size
            elif p.key.startswith("(") or _tag(p.key) in INLINE:
                total += self._line(p)
        return total

    def _walk(self, e: Element, path: str, inside: Element | None, line: int = 0) -> int:
        """Collects fixed texts and content; returns the size of the slots below that aren't furniture. Within content a
        fixed text is kept if ``line``, the slots beside it, is not 0 (it is part of a sentence), or in a title."""
        total = 0
        for p in e.parts:
            if p.key == "#":
                if not self._is_fixed(p):
                    total += p.size
                elif inside is None or not line:
                    self.fixed.setdefault(path, set()).add(p.text)
            elif p.key.startswith("("):
                total += self._walk(p, path, inside, line)
            else:
                below = f"{path}/{p.key}"
                if is_furniture(p.key, inside is not None):
                    if not self._holds_most(p, inside):
                        continue
                    self.read.add(below)
                content = _tag(p.key) in CONTENT and self._all[id(p)][0] > 0
                if content:
                    self.content.add(below)
                beside = line if _tag(p.key) in INLINE else 1 if _tag(p.key) in TITLES else self._line(p)
                total += self._walk(p, below, inside or (p if content else None), beside)
        self.slots[id(e)] = total
        return total

    def _descend(self, root: Element) -> None:
        """The smallest element that holds most of the slots' text."""
        e, path = root, ""
        while True:
            kids = [k for p in e.parts for k in (p.parts if p.key.startswith("(") else [p]) if k.key != "#" and id(k) in self.slots]
            big = max(kids, key=lambda k: self.slots[id(k)], default=None)
            if big is None or big.repeated or _tag(big.key) in INLINE | {"p"} or self.slots[id(big)] < 0.7 * self.slots[id(e)]:
                break
            e, path = big, f"{path}/{big.key}"
        if path:
            self.content.add(path)


def blocks(page: Element, wrapper: Wrapper | None) -> list[str]:
    """Main text of a page, block by block."""
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    def read(e: Element, path: str, on: bool, inside: bool, fixed: bool, any_content: bool = False, named: bool = False) -> None:
        """``fixed``: fixed texts are left out; ``any_content``: every article and main is read, wherever it lies;
        ``named``: only tags tell furniture."""
        for p in e.parts:
            if p.text is not None:
                if on and not (fixed and wrapper and path in wrapper.fixed and _summary(p.text)[0] in wrapper.fixed[path]):
                    now.append(html.unescape(p.text))
                continue
            tag = _tag(p.key)
            below = f"{path}/{p.key}"
            if is_furniture(tag if named else p.key, inside) and not (wrapper and below in wrapper.read) and not (any_content and not on):
                end()
                continue
            if tag == "br":
                now.append(" ")
            if tag not in INLINE:
                end()
            start = tag in CONTENT if any_content or wrapper is None else below in wrapper.content
            read(p, below, on or start, inside or tag in CONTENT, fixed, any_content, named)
            if tag not in INLINE:
                end()

    for on, fixed, any_content, named in ((False, True, False, False), (False, False, False, False), (True, True, False, False),
                                          (True, False, False, False), (False, False, True, False), (True, False, False, True)):
        if not out:
            read(page, "", on, False, fixed, any_content, named)
            end()
    return out


# ---- Spark steps --------------------------------------------------------------------------------------------

def wrappers(rows: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) from rows (host, html)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, Element] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                e = expression(parse(page or ""))
                got[host] = merge(got[host], e) if host in got else e
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array([json.dumps(dumped(e)) for e in got.values()], pa.string())],
                                         names=["host", "wrapper"])

    def whole(t: pa.Table) -> pa.Table:
        parts = sorted(t["wrapper"].to_pylist())
        e = loaded(json.loads(parts[0]))
        for x in parts[1:]:
            merge(e, loaded(json.loads(x)))
        group = t["part"][0].as_py() // PARTIALS
        return pa.table({"host": t["host"].slice(0, 1), "part": pa.array([group], pa.int64()), "wrapper": [json.dumps(dumped(e))]})

    schema = "host string, part long, wrapper string"
    out = rows.select("host", "html").mapInArrow(tidied(partial), "host string, wrapper string").withColumn("part", F.spark_partition_id().cast("long"))
    parts = rows.rdd.getNumPartitions()
    while parts > PARTIALS:  # a host's partial wrappers are merged by groups of PARTIALS
        out = out.groupBy("host", F.expr(f"part DIV {PARTIALS}").alias("group")).applyInArrow(whole, schema)
        parts = -(-parts // PARTIALS)
    return out.select("host", "wrapper", F.lit(0).cast("long").alias("part")).groupBy("host").applyInArrow(whole, schema).select("host", "wrapper")


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_blocks) of every row."""
    host, _ = host_and_path(F.col(url_col))
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            text, n = [], []
            for raw, page in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()):
                if raw not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[raw] = Wrapper(loaded(json.loads(raw)))
                found = blocks(parse(page or ""), known[raw])
                text.append("\n\n".join(found))
                n.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(n, pa.int32())],
                                             names=["page_id", "url", "text", "n_blocks"])

    both = rows.join(wrappers(rows), "host").select("page_id", "url", "html", "wrapper")
    return both.mapInArrow(tidied(run), with_fields(both, "text string, n_blocks int", "html", "wrapper"))


def op9_wrapper_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = main_texts(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
