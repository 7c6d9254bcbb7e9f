"""Main text of web pages by union-free wrappers of their hosts.

A page is read as a stream of tags and text slots. Streams of one host are
aligned: equal neighbours fold into a repeated group, what only one side has
becomes optional, and texts become slots. The outcome is the host's wrapper, a
regular expression without unions that covers all its pages. Wrappers are merged
pairwise, first within a task and then between tasks, so all pages shape them and
no task holds a host's pages.

A text is part of the alignment too: where all pages of a host have the same text in
the same place, that text is template, else the place is a slot. Template texts are
no page's own and are left out, but for headings and on hosts with fewer than
``PAGES`` different pages, where what is equal may be chance.

Each slot of a wrapper gets a role from its path: boilerplate (menus, headers,
footers, sidebars, notices, adverts, forms, comments), main (inside an article or
main element), or other. Slots that are neither are judged by the share of their
text that is links, summed over the host. A page's text is that of its main slots,
or, on a page without any, of the other slots that aren't mostly links.

A class or id names boilerplate inside an article only if all its words do
(``share-buttons``, but not ``alert-level``); elsewhere one word is enough. An element
whose class, id or tag names boilerplate is layout if it holds most of
the page's text and parts of its own (``<div class="has-sidebar">`` or a form around
the page): its own mark then doesn't count, those of the elements inside do.

Tags that are not closed are closed as browsers do for paragraphs, list items and
table parts. A block ends at every block-level tag; ``<br>`` is white space.

Elements nested deeper than ``DEPTH`` count as lying side by side there, with the
marks of those between; lists of neighbours too long to align side by side are
merged by label. Reading takes time in proportion to the page.

**Defined results.** A null page is empty and has an empty text, and so has a page
without main text. A null url is host "". Repeated rows each get a row. An empty
table gives no rows. Other columns are not looked at.
"""

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractflow.llm.common import staged

#: Wrappers in all up to which they are handed to every task; beyond it pages are joined with them.
BROADCAST_BYTES = 32 << 20
#: Hosts whose wrappers a task holds before it hands them on.
HELD = 2_000
#: Share of link text from which a slot outside main elements counts as a menu.
MENU = 0.6
#: Levels of nesting that paths tell apart.
DEPTH = 90
#: Neighbours of both sides, multiplied, up to which they are aligned one by one.
CELLS = 100_000
#: Different pages of a host from which equal texts count as template.
PAGES = 4

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select title".split())
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html dd dt li option td th tr tbody thead tfoot".split())
#: An opening tag ends the nearest open one of these, if none of the second kind lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
#: Words of class, id and role that name boilerplate.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner nav "
    "navbar navigation menu menus breadcrumb breadcrumbs footer sidebar aside widget widgets cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations comment comments disqus reply replies respond pagination pager "
    "toolbar copyright disclaimer paywall complementary contentinfo search form dialog".split())
NEVER_LAYOUT = frozenset("nav footer aside article".split())
ADVERTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion".split())
#: Words that add nothing to a class or id whose other words name boilerplate.
NEUTRAL = frozenset(
    "area articles bar block bottom box button buttons container content group icon icons inner item items left link links "
    "list main outer page panel post posts primary right row secondary section site slot text title top unit wrap wrapper".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
HEADERS = frozenset("header masthead".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def label(tag: str, attributes: str) -> str:
    """A tag's name with what its attributes tell: ``!`` boilerplate, ``~`` perhaps, ``!!`` comments, ``^`` header."""
    if not attributes or tag in ("html", "body"):
        return tag
    words, whole, role = set(), False, ""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        for token in value.split():
            parts = {w.lower() for w in TOKENS.findall(token)}
            words |= parts
            whole |= bool(parts & BOILERPLATE) and parts <= BOILERPLATE | NEUTRAL
        if name.lower() == "role":
            role = value.strip().lower()
    if tag == "main" or role == "main":
        return "main"
    if tag == "article":
        return "article!" if words & (COMMENTS | ADVERTS) else tag
    perhaps = words & BOILERPLATE
    return tag + ("!!" if whole and words & COMMENTS else "!" if whole else "~" if perhaps else "^" if words & HEADERS else "")


def kind(name: str) -> set[str]:
    """What remains of a deeply nested element in the paths below it: its mark, or its part in judging text."""
    tag = name.rstrip("!^~")
    if name in MAIN or tag in BOILERPLATE_TAGS or tag in HEADERS:
        return {name if name in MAIN else tag}
    return {"h1"} if name in HEADINGS else {"div" + name[len(tag):]} if name != tag else set()


def shown(stack: list[tuple[str, str, frozenset]]) -> tuple[str, ...]:
    """The path of labels; of a very deep one the upper part, the kinds of elements below it, and the last label."""
    if len(stack) <= DEPTH:
        return tuple(x[1] for x in stack)
    return (*(x[1] for x in stack[:DEPTH - 1]), *sorted(stack[-2][2]), stack[-1][1])


def read(page: str) -> Iterator[tuple[str, str | tuple[str, ...]]]:
    """Events of a page: ("text", text) under the path last given, ("path", labels), ("break", tag)."""
    stack: list[tuple[str, str, frozenset]] = []  # tag, label, kinds of the deep elements down to it
    at, end, last = 0, len(page), page.rfind(">") + 1

    inside: Counter = Counter()  # open elements by tag

    def close(kinds, stops) -> bool:
        if not any(inside[k] for k in kinds):
            return False
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in kinds:
                inside.subtract(x[0] for x in stack[i:])
                del stack[i:]
                return True
            if stack[i][0] in stops:
                return False
        return False

    while at < end:
        # Behind the last ">" nothing is left to look for but a tag or comment that never ends.
        match = TOKEN.search(page, at, last) if at < last else None
        if match is None:
            unfinished = UNFINISHED.search(page, at)
            yield "text", page[at:unfinished.start() if unfinished else end]
            return
        if match.start() > at:
            yield "text", page[at:match.start()]
        at = match.end()
        if at == last and match.group().startswith("<!--") and not match.group().endswith("-->"):
            return
        closing, tag, attributes = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCK:
                yield "break", tag
            if close({tag}, ()):
                yield "path", shown(stack)
            continue
        if tag in RAW and not attributes.endswith("/"):
            shut = RAW_END[tag].search(page, at)
            shut = page.find(">", shut.start()) if shut else -1
            at = end if shut < 0 else shut + 1
            continue
        if tag in BLOCK or tag == "br":
            yield "break", tag
        if tag in VOID:
            continue
        moved = tag in CLOSES_P and close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in CLOSES:
            moved |= close(*CLOSES[tag])
        name, deep = label(tag, attributes), frozenset()
        if len(stack) >= DEPTH - 1:
            deep = stack[-1][2] | kind(name)
        stack.append((tag, name, deep))
        inside[tag] += 1
        yield "path", shown(stack)


# -- wrappers: (optional, repeated, label, children); texts have the label "#", and template texts their digest as child ----

def digest(text: str) -> str:
    return f"{zlib.crc32(' '.join(text.split()).encode('utf-8', 'surrogatepass')):08x}"


def skeleton(page: str) -> tuple[list, dict[tuple, list[int]]]:
    """A page's own wrapper, and the text and link characters of each slot."""
    root: list = [False, False, "", []]
    opened: list[tuple[str, list]] = []
    sizes: dict[tuple, list[int]] = {}
    path: tuple = ()
    for kind, value in read(page):
        if kind == "path":
            same = 0
            while same < min(len(opened), len(value)) and opened[same][0] == value[same]:
                same += 1
            # a path of equal labels may still be a new element
            if same == len(value) and len(opened) == len(value) and same:
                same -= 1
            del opened[same:]
            for name in value[same:]:
                node = [False, False, name, []]
                (opened[-1][1] if opened else root)[3].append(node)
                opened.append((name, node))
            path = value
        elif kind == "text" and value.strip():
            children = (opened[-1][1] if opened else root)[3]
            if not children or children[-1][2] != "#":
                children.append([False, False, "#", [digest(value)]])
            else:
                children[-1][3] = []  # texts around an element that ended: a place, not one text
            size = sizes.setdefault(path, [0, 0])
            size[0] += len(value)
            size[1] += len(value) * ("a" in path)
    return [fold(n) for n in _folded(root[3])], sizes


def fold(node: list) -> list:
    return node if node[2] == "#" else [node[0], node[1], node[2], _folded(node[3])]


def _folded(nodes: list) -> list:
    """Repeated groups of up to three neighbours become one repeated group."""
    nodes = [fold(n) for n in nodes]
    for period in (1, 2, 3):
        out, i = [], 0
        while i < len(nodes):
            group, n = nodes[i:i + period], i + period
            names = [x[2] for x in group]
            while len(group) == period and "#" not in names and [x[2] for x in nodes[n:n + period]] == names:
                group, n = align(group, nodes[n:n + period]), n + period
            if n > i + period:
                out.append([False, True, group[0][2], group[0][3]] if period == 1 else [False, True, "", group])
            else:
                out.append(nodes[i])
                n = i + 1
            i = n
        nodes = out
    return nodes


def align(a: list, b: list) -> list:
    """One expression that covers both: matches merge, what one side lacks becomes optional."""
    if a == b:
        return a
    n, m = len(a), len(b)
    if n * m > CELLS:
        return _by_label(a + b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if _like(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and _like(a[i], b[j]) and best[i][j] == 1 + best[i + 1][j + 1]:
            x, y = a[i], b[j]
            out.append([x[0] or y[0], x[1] or y[1], x[2], _inside(x, y)])
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([True, *a[i][1:]])
            i += 1
        else:
            out.append([True, *b[j][1:]])
            j += 1
    return _squeezed(out)


def _like(x: list, y: list) -> bool:
    return x[2] == y[2] and (x[2] != "" or [c[2] for c in x[3]] == [c[2] for c in y[3]])


def _squeezed(nodes: list) -> list:
    """Neighbours of one label that alignment left side by side are one repeated group."""
    out: list = []
    for node in nodes:
        if out and node[2] not in ("#", "") and out[-1][2] == node[2]:
            last = out.pop()
            node = [last[0] and node[0], True, node[2], align(last[3], node[3])]
        out.append(node)
    return out


def _inside(x: list, y: list) -> list:
    """Children of two nodes of one label; texts that differ leave a slot."""
    if x[2] == "#":
        return x[3] if x[3] == y[3] else []
    return align(x[3], y[3])


def _by_label(nodes: list) -> list:
    """One optional, repeated node for each label."""
    held: dict[str, list] = {}
    for node in [c for n in nodes for c in (n[3] if n[2] == "" else [n])]:
        old = held.get(node[2])
        held[node[2]] = [True, node[2] != "#", node[2], _inside(old, node) if old else node[3]]
    return list(held.values())


def slots(wrapper: list, path: tuple = ()) -> Iterator[tuple]:
    """Paths of all text slots."""
    for _, _, name, children in wrapper:
        if name == "#":
            yield path
        else:
            yield from slots(children, path + (name,) if name else path)


def template_texts(wrapper: list, path: tuple = ()) -> Iterator[tuple[tuple, str]]:
    """Path and digest of the texts that all pages have, headings apart."""
    for optional, repeated, name, children in wrapper:
        if name == "#":
            if children and not optional and not HEADINGS.intersection(path):
                yield path, children[0]
        elif not optional and not repeated:
            yield from template_texts(children, path + (name,) if name else path)


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression for people."""
    parts = []
    for optional, repeated, name, children in wrapper:
        inner = "#text" if name == "#" else f"<{name}>{expression(children)}</{name}>" if name else expression(children)
        sign = "*" if optional and repeated else "+" if repeated else "?" if optional else ""
        parts.append(f"({inner}){sign}" if sign else inner)
    return "".join(parts)


def marked(name: str) -> bool:
    return name.endswith(("!", "~")) or name in BOILERPLATE_TAGS


def role(path: tuple, layout: frozenset = frozenset()) -> str:
    """What a slot's path says: "main", "boilerplate" or "other". Elements in ``layout`` don't count as boilerplate."""
    inside, header = False, False
    for depth, name in enumerate(path, 1):
        tag = name.rstrip("!^~")
        if (name.endswith("!") or name.endswith("~") and not inside or tag in BOILERPLATE_TAGS) and path[:depth] not in layout:
            return "boilerplate"
        header |= tag in HEADERS or name.endswith("^")
        inside |= name in MAIN
    if header and not (inside and any(name in HEADINGS for name in path)):
        return "boilerplate"
    return "main" if inside else "other"


def layouts(events: list) -> frozenset:
    """Paths of elements that are marked as boilerplate but hold the page: most of its text, and parts of its own.

    Parts are an article, a heading or marked elements. Comments and menus, footers and asides by tag are never layout.
    """
    opened: list[list] = []  # label, text characters, has parts
    found, total, path = [], 0, ()

    def shut(depth: int) -> None:
        while len(opened) > depth:
            name, size, parts = opened.pop()
            if opened:
                opened[-1][1] += size
                opened[-1][2] |= parts or name in MAIN or name in HEADINGS or marked(name)
            if parts and marked(name) and not name.endswith("!!") and name.rstrip("!~") not in NEVER_LAYOUT:
                found.append((path[:len(opened) + 1], size))

    for kind, value in events:
        if kind == "path":
            same = 0
            while same < min(len(path), len(value)) and path[same] == value[same]:
                same += 1
            if same == len(value) == len(path) and same:
                same -= 1
            shut(same)
            path = value
            opened.extend([name, 0, False] for name in value[same:])
        elif kind == "text":
            size = len(value.strip())
            total += size
            if opened:
                opened[-1][1] += size
    shut(0)
    return frozenset(p for p, size in found if 2 * size > total)


# -- Spark ----------------------------------------------------------------------------------

def _host(url: str | None) -> str:
    match = HOST.match(url or "")
    return match.group(1).lower() if match else ""


def _merged(held: dict, host: str, wrapper: list, sizes: dict, pages: list[str]) -> None:
    old = held.get(host)
    if old is None:
        held[host] = [wrapper, dict(sizes), pages]
        return
    old[0] = align(old[0], wrapper)
    old[2] = sorted({*old[2], *pages})[:PAGES]
    for path, (text, links) in sizes.items():
        size = old[1].setdefault(path, [0, 0])
        old[1][path] = [size[0] + text, size[1] + links]


def _packed(wrapper: list, sizes: dict, pages: list[str]) -> str:
    return json.dumps([wrapper, [[*path, *size] for path, size in sorted(sizes.items())], pages], ensure_ascii=False)


def _unpacked(text: str) -> tuple[list, dict, list[str]]:
    wrapper, sizes, pages = json.loads(text)
    return wrapper, {tuple(x[:-2]): x[-2:] for x in sizes}, pages


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one row for each host, the wrapper and its slots' sizes as JSON."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            return pa.RecordBatch.from_arrays(
                [pa.array(held, pa.string()), pa.array([_packed(*x) for x in held.values()], pa.string())], ["host", "wrapper"])

        held: dict[str, list] = {}
        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _merged(held, _host(url), *skeleton(page or ""), [digest(page or "")])
            if len(held) > HELD:
                yield out(held)
                held = {}
        yield out(held)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, list] = {}
        for text in sorted(frame["wrapper"]):
            _merged(held, "", *_unpacked(text))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [_packed(*held[""])]})

    schema = "host string, wrapper string"
    parts = pages.select("url", "html").mapInArrow(gather, schema)
    # Many tasks hand on a wrapper of a large host: these are merged in two steps.
    salted = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(16)).alias("part")).applyInPandas(merge, schema)
    return salted.groupBy("host").applyInPandas(merge, schema)


class Roles:
    """The slots of one host that are kept."""

    def __init__(self, packed: str):
        wrapper, sizes, pages = _unpacked(packed)
        self.sizes = sizes
        self.template = frozenset(template_texts(wrapper)) if len(pages) >= PAGES else frozenset()
        self.main, self.other = set(), set()
        for path in slots(wrapper):
            kind, (text, links) = role(path), sizes.get(path, [0, 0])
            if kind == "main":
                self.main.add(path)
            elif kind == "other" and links <= MENU * text:
                self.other.add(path)

    def text(self, page: str) -> str:
        main, other = self._blocks(page)
        return "\n\n".join(main or other)

    def _into(self, layout: frozenset):
        """Where the text of a path goes: 0 main, 1 other, None nowhere."""
        def into(path: tuple) -> int | None:
            if layout and any(path[:len(x)] == x for x in layout):
                kind = role(path, layout)
                text, links = self.sizes.get(path, [0, 0])
                return 0 if kind == "main" else 1 if kind == "other" and links <= MENU * text else None
            return 0 if path in self.main else 1 if path in self.other else None
        return into

    def _blocks(self, page: str) -> tuple[list[str], list[str]]:
        found: tuple[list[str], list[str]] = ([], [])
        open_: tuple[list[str], list[str]] = ([], [])
        events = list(read(page))
        place = self._into(layouts(events))
        path: tuple = ()
        into = place(path)

        def flush():
            for blocks, parts in zip(found, open_):
                if parts:
                    block = " ".join(unescape("".join(parts)).split())
                    if block:
                        blocks.append(block)
                    parts.clear()

        for kind, value in events:
            if kind == "text":
                if into is not None and not (self.template and value.strip() and (path, digest(value)) in self.template):
                    open_[into].append(value)
            elif kind == "path":
                path = value
                into = place(path)
            elif value == "br":
                for parts in open_:
                    if parts:
                        parts.append(" ")
            else:
                flush()
        flush()
        return found


def _extract(with_wrapper: bool, known: dict[str, str]):
    """(page_id, url, html[, wrapper]) to the result rows."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roles: dict[str, Roles] = {}
        for batch in batches:
            urls, pages = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            given = batch.column(3).to_pylist() if with_wrapper else [None] * len(urls)
            texts = []
            for url, page, wrapper in zip(urls, pages, given):
                host = _host(url)
                if host not in roles:
                    if len(roles) > HELD:
                        roles.clear()
                    roles[host] = Roles(wrapper if with_wrapper else known[host])
                texts.append(roles[host].text(page or ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return extract


def main_texts(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    hosts = staged(wrappers(rows), "wrappers")
    size = hosts.agg(F.sum(F.octet_length("wrapper").cast("long"))).first()[0] or 0
    schema = "page_id long, url string, text string, n_chars long"
    if size <= broadcast_bytes:
        known = {r["host"]: r["wrapper"] for r in hosts.toLocalIterator()}
        return rows.mapInArrow(_extract(False, known), schema)
    host = F.pandas_udf(lambda urls: urls.map(_host), "string")
    keyed = rows.withColumn("host", host("url"))  # a host may have a third of all pages: adaptive joins split it
    return keyed.join(hosts, "host").select("page_id", "url", "html", "wrapper").mapInArrow(_extract(True, {}), schema)
