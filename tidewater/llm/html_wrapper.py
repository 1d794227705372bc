"""HTML extraction by union-free wrapper inference per host.

A page is a stream of tags and texts, read into a tolerant tree of block elements, whose symbols are their names
with the class and id words that the host's template has; words of single pages are slots, so a wrapper grows with
the template and not with the pages. Pages of one host are aligned one after another: equal children are matched in order, a child that only one side has becomes an
optional group, adjacent equal children (or short sequences of them) become a repeated group, and texts that
differ become slots. The result is a wrapper, a regular expression without unions. Wrappers of the same host
that different tasks inferred are aligned in the same way, so every page takes part and a large host is
spread over all tasks.

From a host's wrapper comes its rule. Text slots, the places where pages differ, show the body: the walk goes
down from the root to the smallest subtree that holds most of the slot text, and an article or main element on
that way, or the ones that share its slot text, ends it. Below the body, paths whose every element is on all
pages with one text (or, without a named body, mostly links) are template and left out. Pages are then read
again and their text is taken by that rule; names that say menu, advert, comment and so on are left out
everywhere. Only a host without slots is read by names and text mass.

Elements nested deeper than DEEPEST hang below the element at that depth, as browsers do; no text is lost.

Defined results: null or empty html gives an empty text; a page of a host alone is read by names and text
mass only; null urls share one host; repeated rows are extracted alike; an empty table gives an empty result;
texts of any length are whole; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import cut, sliced, tidy

_OPENS = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_QUOTE_OR_END = re.compile(r"[>\"']")
_MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Elements without content, inline elements, and what a new block closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BREAKS = frozenset({"br", "hr"})
#: Fixed value: elements whose content is no text of the page.
UNREAD = frozenset("script style noscript template svg iframe textarea select head".split())
_CLOSES = {n: re.compile(rf"</{n}\s*>", re.I) for n in UNREAD}
#: Element names, and words in class, id or role, that are never the main text.
NOT_MAIN_TAGS = frozenset("nav footer aside form button dialog menu noscript".split())
NOT_MAIN_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|masthead|menu|modal|nav\w*|newsletter"
    r"|notices?|pagination|popup|promo\w*|related|share|sharing|sidebar|side|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
MAIN_TAGS = ("article", "main")
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)


class Element:
    """A block element: its name with class and id words, its own text pieces in order, its children."""

    __slots__ = ("children", "drop", "linked", "marks", "name", "parts", "symbol")

    def __init__(self, name: str, marks: str) -> None:
        self.name, self.symbol, self.marks = name, f"{name}.{marks}" if marks else name, marks
        self.drop = name in NOT_MAIN_TAGS or bool(marks and NOT_MAIN_WORDS.search(marks))
        self.parts: list = []  # texts and child elements, in page order
        self.children: list[Element] = []
        self.linked = 0


#: Stands in a symbol for words, not of the template, that are never main text.
OUT = "~"
#: Elements that say nothing by their name; those that hold text alone and those that hold elements are told apart.
PLAIN, LEAF = frozenset({"div", "section"}), "="
#: Fixed value: nesting beyond this hangs below the element at this depth.
DEEPEST = 128


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each piece of markup, in one scan; comments and unread elements have no name.

    A quote that never closes ends with the first `>` after it. Where a tag's quotes swallow every `>` of the page, that
    tag and the later ones end at their first `>`. What opens after the last `>` is text.
    """
    at, last, quoted = 0, page.rfind(">"), True

    def end_of(i: int) -> int:
        nonlocal quoted
        begin = i
        while quoted:
            m = _QUOTE_OR_END.search(page, i)
            if m is None:
                quoted = False
            elif m[0] == ">":
                return m.end()
            else:
                close = page.find(m[0], m.end())
                if close < 0:
                    begin = m.end() if m.end() <= last else begin
                    break
                i = close + 1
        return page.find(">", begin) + 1

    while (m := _OPENS.search(page, at)) is not None:
        start, name = m.start(), (m[4] or "").lower()
        if m[1]:
            close = page.find("-->", m.end())
            at = close + 3 if close >= 0 else len(page)
        elif start > last:
            return
        elif m[2] or (name in UNREAD and not m[3]):
            at = page.find(">", m.end()) + 1
            if name:
                close = _CLOSES[name].search(page, at)
                at, name = close.end() if close else len(page), ""
        else:
            at = end_of(m.end())
            yield start, at, bool(m[3]), name, page[m.end() : at - 1]
            continue
        yield start, at, False, "", ""


def parse(page: str | None) -> Element:
    """The tree of block elements; inline tags leave no trace, breaks and blocks cut words."""
    root = Element("html", "")
    stack, anchors, at = [root], 0, 0
    below: list[Element] = []  # open elements beyond DEEPEST; what they hold goes to the last open one's stand-in
    page = page or ""

    def hang(e: Element) -> None:
        stack[-1].parts.append(e)
        stack[-1].children.append(e)

    def text(a: int, b: int) -> None:
        if b > a:
            piece = html.unescape(page[a:b])
            if below and stack[-1].parts[-1] is not below[-1]:  # back in an element after a deeper one ended
                again = Element("", "")
                again.name, again.symbol, again.marks, again.drop = below[-1].name, below[-1].symbol, below[-1].marks, below[-1].drop
                below[-1] = again
                hang(again)
            holder = below[-1] if below else stack[-1]
            holder.parts.append(piece)
            if anchors:
                holder.linked += len(piece)

    for start, end, closing, name, attributes in tags(page):
        text(at, start)
        at = end
        if not name or name in ("html", "body"):
            continue
        if name in INLINE:
            if name == "a":
                anchors = 0 if closing else 1
            continue
        if name in BREAKS:
            (below[-1] if below else stack[-1]).parts.append(" ")
        if name in VOID:
            continue
        if closing:
            for level in (below, stack):
                k = next((k for k in range(len(level) - 1, -1 if level is below else 0, -1) if level[k].name == name), None)
                if k is not None:
                    if level is stack:
                        below.clear()
                    del level[k:]
                    anchors = 0
                    break
            continue
        marks = " ".join(" ".join(filter(None, x)) for x in _MARKS.findall(attributes)) if attributes else ""
        shut = CLOSED_BY.get(name, ())
        for level in (below, stack):
            while len(level) > (level is stack) and (level[-1].name == "p" or level[-1].name in shut):
                level.pop()
            if level:
                break
        new = Element(name, marks)
        if below:
            new.drop = new.drop or below[-1].drop
        hang(new)
        if not attributes.endswith("/"):
            (below if below or len(stack) >= DEEPEST else stack).append(new)
    text(at, len(page))
    return root


def settle(e: Element, words: frozenset[str]) -> Element:
    """Keeps in the tree's symbols only the class and id words of the host's template; the others are slots of the markup.

    That words, kept or not, say an element is never main text stays known, by a word of its own. So does, for plain
    elements without words, whether they hold elements.
    """
    pending = [e]
    while pending:
        x = pending.pop()
        kept = [w for w in x.marks.split() if w in words]
        if x.marks and NOT_MAIN_WORDS.search(x.marks) and not NOT_MAIN_WORDS.search(" ".join(kept)):
            kept.append(OUT)
        if x.name in PLAIN and not kept and not x.children:
            kept.append(LEAF)
        x.symbol = f"{x.name}.{' '.join(kept)}" if kept else x.name
        pending.extend(x.children)
    return e


# --- wrappers: [symbol, pages, repeated, optional, text state, chars, linked chars, children] -----------

SYMBOL, PAGES, REPEATED, OPTIONAL, TEXT, CHARS, LINKED, CHILDREN = range(8)
SLOT = -1


def skeleton(e: Element) -> list:
    own = " ".join("".join(p for p in e.parts if isinstance(p, str)).split())
    state = zlib.crc32(own.encode()) if own else None
    return [e.symbol, 1, False, False, state, len(own), e.linked, fold([skeleton(c) for c in e.children])]


def fold(items: list[list]) -> list[list]:
    """Adjacent equal children, or sequences of two or three, become one repeated group."""
    for width in (1, 2, 3):
        out: list[list] = []
        i = 0
        names = [x[SYMBOL] for x in items]
        while i < len(items):
            j = i + width
            if names[i:j] == names[j : j + width] and len(names[i:j]) == width:
                group = items[i:j]
                while names[j : j + width] == names[i : i + width]:
                    group = [merge(a, b, same_page=True) for a, b in zip(group, items[j : j + width], strict=True)]
                    j += width
                if width == 1:
                    group[0][REPEATED] = True
                    out += group
                else:
                    label = "(" + " ".join(names[i : i + width]) + ")"
                    out.append([label, max(g[PAGES] for g in group), True, False, None, 0, 0, group])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


#: Symbols of either list in the alignment's table; longer lists are aligned window by window.
WINDOW = 1000


def _subsequence(x: list[str], y: list[str]) -> list[tuple[int | None, int | None]]:
    """Longest common subsequence, as index pairs in order with gaps on either side."""
    out: list[tuple[int | None, int | None]] = []
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def _align(a: list[list], b: list[list]) -> list[tuple[int | None, int | None]]:
    """A common subsequence of the symbols, as index pairs in order with gaps on either side.

    A longest one for lists within the window; for longer ones, the first half of each window's longest one.
    """
    x, y = [n[SYMBOL] for n in a], [n[SYMBOL] for n in b]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    out: list[tuple[int | None, int | None]] = [(i, i) for i in range(head)]
    i = j = head
    while i < len(x) or j < len(y):
        whole = len(x) - i <= WINDOW and len(y) - j <= WINDOW
        u = v = 0
        for p, q in _subsequence(x[i : i + WINDOW], y[j : j + WINDOW]):
            if not whole and max(u, v) >= WINDOW // 2:
                break
            out.append((None if p is None else i + p, None if q is None else j + q))
            u, v = u + (p is not None), v + (q is not None)
        i, j = i + u, j + v
    return out


def merge(a: list, b: list, same_page: bool = False) -> list:
    """The least general wrapper of this form that covers both."""
    children = []
    for i, j in _align(a[CHILDREN], b[CHILDREN]):
        if i is not None and j is not None:
            children.append(merge(a[CHILDREN][i], b[CHILDREN][j], same_page))
        else:
            alone = list(a[CHILDREN][i] if j is None else b[CHILDREN][j])
            alone[OPTIONAL] = True
            children.append(alone)
    return [
        a[SYMBOL],
        max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES],
        a[REPEATED] or b[REPEATED],
        a[OPTIONAL] or b[OPTIONAL],
        a[TEXT] if a[TEXT] == b[TEXT] else SLOT,
        a[CHARS] + b[CHARS],
        a[LINKED] + b[LINKED],
        fold(children),
    ]


def as_expression(w: list) -> str:
    """The wrapper as a regular expression over tags and texts: `?` optional, `+` repeated, `#` a text slot."""
    text = "" if w[TEXT] is None else "#" if w[TEXT] == SLOT else "="
    inner = text + " ".join(as_expression(c) for c in w[CHILDREN])
    body = f"({inner})" if w[SYMBOL][0] == "(" else f"<{w[SYMBOL]}>{inner}</>"
    return body + ("+" if w[REPEATED] else "") + ("?" if w[OPTIONAL] else "")


# --- rules ------------------------------------------------------------------------------------------


def _named_out(w: list) -> bool:
    """Whether the element's names say that it is never main text."""
    name, _, marks = w[SYMBOL].partition(".")
    return name in NOT_MAIN_TAGS or bool(marks and (OUT in marks.split() or NOT_MAIN_WORDS.search(marks)))


def _mass(w: list) -> tuple[int, int]:
    """Characters in the subtree outside names that are never main, and those in links."""
    if _named_out(w):
        return 0, 0
    total, linked = w[CHARS], w[LINKED]
    for c in w[CHILDREN]:
        a, b = _mass(c)
        total, linked = total + a, linked + b
    return total, linked


def _slots(w: list) -> int:
    """Characters, outside links and names that are never main, of texts that differ between pages or are on some pages only."""

    def walk(w: list, some: bool) -> int:
        if _named_out(w):
            return 0
        some = some or w[OPTIONAL] or w[REPEATED]
        own = max(0, w[CHARS] - w[LINKED]) if w[TEXT] == SLOT or (some and w[TEXT] is not None) else 0
        return own + sum(walk(c, some) for c in w[CHILDREN])

    return walk(w, False)


def template_paths(wrapper: list, main: list[str], links: bool) -> list[str]:
    """Paths below `main` whose every node is template: on all pages, and either constant there or (with `links`) mostly links.

    Constant: in the wrapper neither optional nor repeated, with one text on all pages, down to the leaves. Pages are
    read by path, so one node at a path that is not template keeps the path. A main subtree that is constant as a
    whole shows no slot to tell template from text by, and loses nothing.
    """
    template: dict[str, bool] = {}
    steady: dict[str, bool] = {}

    def walk(w: list, at: str, again: bool) -> bool:
        again = again or w[REPEATED]
        group = w[SYMBOL][0] == "("
        everywhere = w[PAGES] == wrapper[PAGES] and not w[OPTIONAL]
        inner = [walk(c, at if c[SYMBOL][0] == "(" else f"{at}/{c[SYMBOL]}", again) for c in w[CHILDREN]]
        constant = everywhere and not again and w[TEXT] != SLOT and all(inner)
        if not group:
            total, linked = _mass(w)
            template[at] = template.get(at, True) and bool(total) and everywhere and (constant or (links and linked > 0.8 * total))
            steady[at] = steady.get(at, True) and constant
        return constant

    walk(wrapper, wrapper[SYMBOL], False)
    tops = {m for m in main if not steady[m]}

    def below(at: str) -> bool:
        while at and at not in tops:
            at = at.rpartition("/")[0]
        return bool(at)

    return [at for at, is_so in template.items() if is_so and below(at.rpartition("/")[0])]


def _named_main(w: list, path: tuple[str, ...]) -> list[tuple[tuple[str, ...], list]]:
    """The outermost article and main elements with text, with their paths; articles alone if there are any."""
    found: list[tuple[tuple[str, ...], list]] = []

    def seek(w: list, path: tuple[str, ...]) -> None:
        if _named_out(w):
            return
        here = path if w[SYMBOL][0] == "(" else (*path, w[SYMBOL])
        if w[SYMBOL].partition(".")[0] in MAIN_TAGS and _mass(w)[0]:
            inner = [x for c in w[CHILDREN] for x in _named_main(c, here)] if not w[SYMBOL].startswith("article") else []
            articles = [x for x in inner if x[1][SYMBOL].startswith("article")]
            found.extend(articles or [(here, w)])
            return
        for c in w[CHILDREN]:
            seek(c, here)

    seek(w, path)
    articles = [x for x in found if x[1][SYMBOL].startswith("article")]
    return articles or found


def rule_of(wrapper: list) -> dict:
    """`main`: paths of the main subtrees; `drop`: template paths of a wrapper of three pages or more.

    The body is where the slots are: down from the root while one child holds most of the slot text. Article and
    main elements only say where on that way to stop, or which parts of the found subtree share its slot text.
    """
    weigh = _slots if wrapper[PAGES] > 1 and _slots(wrapper) else lambda w: _mass(w)[0]
    node, path, named = wrapper, (wrapper[SYMBOL],), False
    while not named:
        whole = weigh(node)
        inside = _named_main(node, path[:-1])
        if sum(weigh(w) for _, w in inside) > 0.5 * whole:
            named = True
            break
        own = max(0, node[CHARS] - node[LINKED])
        inner = [c for c in node[CHILDREN] if c[SYMBOL][0] != "(" and not c[REPEATED] and weigh(c) > 0.6 * whole]
        if not inner or own > 0.3 * whole:
            break
        node = max(inner, key=lambda c: (bool(MAIN_WORDS.search(c[SYMBOL])), weigh(c)))
        path = (*path, node[SYMBOL])
    main = ["/".join(p) for p, _ in inside] if named else ["/".join(path)]
    drop = template_paths(wrapper, main, links=not named) if wrapper[PAGES] >= 3 else []
    return {"main": sorted(set(main)), "drop": sorted(set(drop))}


def main_text(page: str | None, rule: dict | None) -> str:
    """The page's main text by a rule; by names and mass where the rule finds nothing."""
    root = parse(page)
    if rule and "words" in rule:
        settle(root, frozenset(rule["words"]))
    for attempt in ([rule] if rule else []) + [rule_of(skeleton(root))]:
        main, drop = set(attempt["main"]), set(attempt["drop"])
        pieces: list[str] = []
        pending: list[tuple[object, str, bool]] = [(root, "html", False)]
        while pending:
            e, path, inside = pending.pop()
            if isinstance(e, str):
                pieces.append(e)
                continue
            if e.drop or path in drop:
                pieces.append(" ")
                continue
            inside = inside or path in main
            todo: list[tuple[object, str, bool]] = []
            for p in e.parts:
                if isinstance(p, Element):
                    todo += [(" ", "", True), (p, f"{path}/{p.symbol}", inside), (" ", "", True)]
                elif inside:
                    todo.append((p, "", True))
            pending.extend(reversed(todo))
        found = " ".join("".join(pieces).split())
        if found:
            return found
    return ""


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


# --- the operator --------------------------------------------------------------------------------------

#: Bytes of rules up to which they are broadcast; beyond, pages and rules are joined by host, and AQE splits hot hosts.
BROADCAST_BYTES = 32 << 20
#: Parts in which a host's partial wrappers are aligned before the last task aligns those.
SPREAD = 16
_PAIR = pa.schema([("host", pa.string()), ("wrapper", pa.string())])


def template_words(pages: DataFrame) -> DataFrame:
    """`(host, words)`: the class and id words that half of a host's pages or more have, so those that vary by page go.

    A host has at most twice as many as its pages have on average.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str | None]] = Counter()

        def flush() -> pa.RecordBatch:
            hosts, words = (pa.array(x, pa.string()) for x in zip(*counts, strict=True))
            out = pa.RecordBatch.from_arrays([hosts, words, pa.array(list(counts.values()), pa.int64())], ["host", "word", "n"])
            counts.clear()
            return out

        for batch in sliced(batches, 1000, "html"):
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host = host_of(url)
                counts.update((host, w) for w in {w for x in _MARKS.findall(page or "") for m in x for w in m.split()})
                counts[host, None] += 1
            if len(counts) > 50_000:
                yield flush()
        if counts:
            yield flush()

    found = pages.select("url", "html").mapInArrow(tidy(seen), "host string, word string, n long").groupBy("host", "word").agg(F.sum("n").alias("n"))
    whole = found.filter("word IS NULL").select(F.col("host").alias("h"), F.col("n").alias("pages"))
    kept = found.filter("word IS NOT NULL").join(whole, F.col("host") == F.col("h")).filter(2 * F.col("n") >= F.col("pages"))
    return kept.groupBy("host").agg(F.array_sort(F.collect_list("word")).alias("words"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """`(host, wrapper)` as JSON: partial wrappers per task, then aligned per host in a stable order, first in `SPREAD` parts.

    `pages` has url, html, host and the host's `words`.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]}, schema=_PAIR)
            held.clear()
            return out

        for batch in sliced(batches, 1000, "html"):
            known: dict[str, frozenset[str]] = {}
            for host, page, words in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "words")), strict=True):
                if host not in known:
                    known[host] = frozenset(words or ())
                own = skeleton(settle(parse(page), known[host]))
                held[host] = merge(held[host], own) if host in held else own
            if len(held) > 5000:
                yield flush()
        if held:
            yield flush()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wrapper = None, None
        for batch in batches:
            for host, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if host != last:
                    if last is not None:
                        yield pa.RecordBatch.from_pydict({"host": [last], "wrapper": [json.dumps(wrapper)]}, schema=_PAIR)
                    last, wrapper = host, json.loads(text)
                else:
                    wrapper = merge(wrapper, json.loads(text))
        if last is not None:
            yield pa.RecordBatch.from_pydict({"host": [last], "wrapper": [json.dumps(wrapper)]}, schema=_PAIR)

    found = pages.select("host", "html", "words").mapInArrow(tidy(partial), "host string, wrapper string")
    part = F.pmod(F.xxhash64("wrapper"), F.lit(SPREAD))
    for keys in (["host", part], ["host"]):
        found = found.repartition(*keys).sortWithinPartitions("host", "wrapper").mapInArrow(tidy(align), "host string, wrapper string")
    return found


def _sized(by_host: DataFrame) -> DataFrame:
    """The table marked for broadcast if its texts are small enough; otherwise joined by host, where AQE splits hot hosts."""
    own = next(c for c in by_host.columns if c != "host")
    text = F.array_join(own, " ") if own == "words" else F.col(own)
    size = by_host.agg(F.sum(F.length(text) + F.length("host") + 64)).first()[0] or 0
    return F.broadcast(by_host) if size <= BROADCAST_BYTES else by_host


def extract(pages: DataFrame) -> DataFrame:
    """`(page_id, url, text)` of every page row, by its host's rule."""

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("wrapper").to_pylist(), batch.column("words").to_pylist(), strict=True)
            made = [json.dumps(rule_of(json.loads(w)) | {"words": words or []}) for w, words in both]
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "rule": pa.array(made, pa.string())})

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=[*batch.schema.names, "host"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000, "html"):
            known: dict[str, dict] = {}
            texts = []
            for page, rule in zip(batch.column("html").to_pylist(), batch.column("rule").to_pylist(), strict=True):
                if rule is not None and rule not in known:
                    known[rule] = json.loads(rule)
                texts.append(main_text(page, known.get(rule)))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string())})

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    named = own.mapInArrow(tidy(hosts), "page_id long, url string, html string, host string")
    words = cut(template_words(own), "html-words")
    wrappers = infer_wrappers(named.join(_sized(words), "host", "left"))
    by_host = cut(wrappers.join(words, "host", "left").mapInArrow(tidy(rules), "host string, rule string"), "html-rules")
    known = _sized(by_host)
    return named.join(known, "host", "left").select("page_id", "url", "html", "rule").mapInArrow(tidy(read), "page_id long, url string, text string")
