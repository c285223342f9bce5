"""HTML main text by wrappers: union-free expressions over the tag streams of a host's pages.

Every page becomes a tree of block tags (tag plus class, id and role) with text slots; inline tags belong to the text
around them, and missing end tags are put in as HTML asks. Pages of a host are aligned one after the other: where two
child sequences agree they merge, neighbours of one kind fold into a repeated group, and what only one side has becomes
an optional group. The result is one expression per host without alternatives. An element of it has the text and link
characters of its slots, the pages that have it, and the texts that are the same in all of these: where two pages differ
a text becomes a slot, where they agree it stays the wrapper's own. Partial wrappers are built where the pages lie and
merged by host in two steps, so a host of any size sends a small row for each task.

What a wrapper says of a page's text:

- A slot is main text if no tag on its path is boilerplate by its name, class, id or role, and it lies in an ``article``
  or ``main`` element; where the host has none, anywhere. ``html``, ``body``, ``main`` and ``article``, and elements that
  hold more than half of the host's text outside links, are not boilerplate by a word of class, id or role.
- Where the host has no such element, the wrapper's own texts (of elements that half of the pages have, three different
  ones at least) are template, whatever their tags are called; so are repeated groups whose text lies in links, as menus
  do. An ``article`` or ``main`` keeps them: it says itself what its text is.
- A page on which nothing is left is judged by its own wrapper, and if that leaves nothing either, template texts stay.

Text of main slots: references are decoded, white space inside a block becomes one space, ends are trimmed, and blocks
join in page order by one newline. Nothing else is dropped.

A page is read in time in proportion to its length, whatever is unclosed in it, and trees of any depth are walked without
recursion. A tag whose quotes do not close ends at the next ``>``; without one, the rest is text.

Defined cases: null or empty html gives an empty text; a null url, or one without a host, shares the wrapper of ""; a
page without markup is one block; broken or unclosed markup is read as far as it goes; repeated rows get a row each;
other columns pass through, and an output name that is among them is refused (``out`` names it); an empty table gives
none.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch, refuse_clash
from .urls import url_parts

#: Elements whose text runs on with the text around them.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never have content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Elements that are never main text.
BOILER_TAGS = frozenset("nav header footer aside form script style noscript iframe template svg button select option textarea menu dialog head title object canvas".split())
#: Words of a class, id or role that are never main text.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies respond share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar topbar widget widgets complementary contentinfo search alert".split()
)
#: Elements that hold the main text where a page has them.
MAIN_TAGS = frozenset(("article", "main"))
#: A start tag in the key ends open elements in the value, up to the nearest container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
STOPS = frozenset("ul ol dl table td th body html article section div".split())
#: How a start or an end tag begins, and what its attributes may end with.
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[>\"']")
#: What ends a raw element: nothing inside it is a tag.
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in RAW}
_ATTR = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Za-z0-9]+")
#: Elements that are not boilerplate by a word of class, id or role.
NEVER_BOILER = frozenset(("html", "body", "main", "article"))
#: Verdicts in all that may be broadcast, in bytes; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 4 << 20


def _hash(above: int, key: str) -> int:
    """The number of a path, from that of the path above."""
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"), above)


class Page:
    """A page's text blocks: for each the place of its path, the text with references decoded, and characters in links.

    Paths are numbered in the order in which they come up; ``above`` and ``keys`` lead from one to its parent, 0.
    """

    __slots__ = ("above", "keys", "paths", "texts", "links")

    def __init__(self, page: str):
        self.above, self.keys = [-1], [""]
        self.paths: list[int] = []
        self.texts: list[str] = []
        self.links: list[int] = []
        known: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, int]] = []
        opened: Counter[str] = Counter()
        here = links = in_link = 0
        text: list[str] = []

        def flush() -> None:
            nonlocal links
            if text:
                whole = " ".join("".join(text).split())
                text.clear()
                if whole:
                    self.paths.append(here)
                    self.texts.append(whole)
                    self.links.append(min(links, len(whole)))
            links = 0

        def pop_to(i: int) -> None:
            nonlocal here, in_link
            for tag, _ in stack[i:]:
                opened[tag] -= 1
            del stack[i:]
            here = stack[-1][1] if stack else 0
            in_link = 0

        for kind, tag, body in _tokens(page):
            if kind == "text":
                piece = entities.unescape(body)
                text.append(piece)
                links += len(piece) if in_link else 0
                continue
            end = kind == "end"
            if tag in INLINE:
                if tag == "br":
                    text.append(" ")
                elif tag == "a":
                    in_link = 0 if end else 1
                continue
            flush()
            if end:
                if opened[tag]:
                    pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                continue
            if tag in P_CLOSERS and stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
            closes = CLOSES.get(tag, ())
            if any(opened[x] for x in closes):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        pop_to(i)
                    elif stack[i][0] in STOPS:
                        break
            if tag in RAW or tag in VOID or body.endswith("/") and tag in ("p", "div"):
                continue
            names = sorted({w.lower() for _, v in _ATTR.findall(body) for w in _WORDS.findall(v) if not w.isdigit()}) if "=" in body else ()
            key = f"{tag}.{'.'.join(names)}" if names else tag
            at = known.setdefault((here, key), len(self.keys))
            if at == len(self.keys):
                self.above.append(here)
                self.keys.append(key)
            stack.append((tag, at))
            opened[tag] += 1
            here = at
        flush()

    def path(self, at: int) -> tuple[str, ...]:
        out = []
        while at:
            out.append(self.keys[at])
            at = self.above[at]
        return tuple(reversed(out))

    def blocks(self) -> list[tuple[tuple[str, ...], str, int]]:
        return [(self.path(p), t, n) for p, t, n in zip(self.paths, self.texts, self.links, strict=True)]


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, body): texts, and start and end tags with their attributes; what is inside raw elements is skipped.

    Every stretch is scanned a bounded number of times: where a scan for a tag's end has failed is remembered.
    """
    at, shown, size = 0, 0, len(page)
    dead: set[int] = set()  # quotes from which no tag ends
    span = (0, -1, -1)  # from the first to the second place the next of > " ' is the third
    no_end = False  # no > is left

    def special(x: int) -> int:
        nonlocal span
        if not span[0] <= x <= span[1]:
            m = _SPECIAL.search(page, x)
            y = m.start() if m else size
            span = (x, y, y)
        return span[2]

    def end_of(x: int) -> int:
        """Where the tag whose attributes begin at x ends; -1 if its quotes do not let it."""
        entered = []
        while (x := special(x)) < size and page[x] != ">":
            over = -1 if x in dead else page.find(page[x], x + 1)
            entered.append(x)
            if over < 0:
                x = size
                break
            x = over + 1
        if x < size:
            return x
        dead.update(entered)
        return -1

    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            over = page.find("-->", at + 4)
            end = over + 3 if over >= 0 else size
            kind = tag = body = ""
        elif no_end:  # nothing but a comment can begin
            at += 1
            continue
        elif page.startswith(("<!", "<?"), at):
            over = page.find(">", at)
            if over < 0:
                no_end = True
                continue
            end, kind, tag, body = over + 1, "", "", ""
        elif m := _NAME.match(page, at):
            over = end_of(m.end())
            if over < 0:
                over = page.find(">", m.end())
                if over < 0:
                    no_end = True
                    continue
            end, kind, tag, body = over + 1, "end" if m[1] else "start", m[2].lower(), page[m.end() : over]
        else:
            at += 1
            continue
        if at > shown:
            yield "text", "", page[shown:at]
        if kind:
            yield kind, tag, body
        if kind == "start" and tag in RAW:
            over = _RAW_END[tag].search(page, end)
            end = over.end() if over else size
        at = shown = end
    if shown < size:
        yield "text", "", page[shown:]


def boilerplate(key: str) -> bool:
    tag, _, names = key.partition(".")
    return tag in BOILER_TAGS or bool(names) and tag not in NEVER_BOILER and not BOILER_WORDS.isdisjoint(names.split("."))


def is_main(key: str) -> bool:
    tag, _, names = key.partition(".")
    return tag in MAIN_TAGS or "main" in names.split(".")


class Wrapper:
    """An element of a union-free expression.

    ``rep`` and ``opt`` mark groups; ``chars`` and ``links`` count its slots' characters; each text whose hash is in
    ``own`` stands in ``seen`` pages at least.
    """

    __slots__ = ("key", "rep", "opt", "chars", "links", "seen", "own", "kids")

    def __init__(self, key: str, rep: bool = False, opt: bool = False, chars: int = 0, links: int = 0, seen: int = 1, own: set[int] | None = None):
        self.key, self.rep, self.opt, self.chars, self.links, self.seen = key, rep, opt, chars, links, seen
        self.own: set[int] = own if own is not None else set()
        self.kids: list[Wrapper] = []

    @classmethod
    def of_page(cls, page: Page) -> Wrapper:
        root = cls("")
        # The elements that are open, with the places of their paths.
        open_: list[tuple[int, Wrapper]] = [(0, root)]
        at_of: dict[int, int] = {0: 0}
        for path, text, links in zip(page.paths, page.texts, page.links, strict=True):
            up, missing = path, []
            while up not in at_of:
                missing.append(up)
                up = page.above[up]
            same = at_of[up]
            if not missing and same == len(open_) - 1 and same:  # the next element of the same kind, or text after a child
                open_[same][1].rep = True
            for p, _ in open_[same + 1 :]:
                del at_of[p]
            del open_[same + 1 :]
            for p in reversed(missing):
                at_of[p] = len(open_)
                open_.append((p, open_[-1][1].child(page.keys[p])))
            node = open_[-1][1]
            node.chars += len(text)
            node.links += links
            node.own.add(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
        return root

    def child(self, key: str) -> Wrapper:
        """The last child if it is of this kind (then repeated), else a new one."""
        # A period of two or more kinds (dt dd dt dd): the earlier one of the same kind repeats.
        for k in [*self.kids[-1:], *self.kids[-4:]]:
            if k.key == key:
                k.rep = True
                return k
        self.kids.append(Wrapper(key))
        return self.kids[-1]

    def merge(self, other: Wrapper) -> None:
        """Aligns two expressions of one element; what only one of them has becomes optional."""
        todo: deque[tuple[Wrapper, Wrapper, bool]] = deque([(self, other, False)])
        while todo:
            x, y, side = todo.popleft()
            x.rep, x.opt = x.rep or y.rep or side, x.opt or y.opt
            x.chars, x.links = x.chars + y.chars, x.links + y.links
            # Side by side, both may stand in the same pages; else the pages are others.
            x.own, x.seen = (x.own | y.own, min(x.seen, y.seen)) if side else (x.own & y.own, x.seen + y.seen)
            out, mine, i = [], x.kids, 0
            at: dict[str, list[int]] = {}
            for n, k in enumerate(mine):
                at.setdefault(k.key, []).append(n)
            for k in y.kids:
                places = at.get(k.key, ())
                n = bisect_left(places, i)
                if n == len(places):
                    k.opt = True
                    out.append(k)
                    continue
                j = places[n]
                for skipped in mine[i:j]:
                    skipped.opt = True
                out.extend(mine[i:j])
                todo.append((mine[j], k, False))
                out.append(mine[j])
                i = j + 1
            for skipped in mine[i:]:
                skipped.opt = True
            out.extend(mine[i:])
            folded: list[Wrapper] = []
            for k in out:  # alignment may have put two of a kind side by side
                if folded and folded[-1].key == k.key:
                    todo.append((folded[-1], k, True))
                else:
                    folded.append(k)
            x.kids = folded

    def dump(self) -> list:
        """The elements from the root on, each before its children."""
        out, stack = [], [self]
        while stack:
            w = stack.pop()
            out.append([w.key, int(w.rep), int(w.opt), w.chars, w.links, w.seen, sorted(w.own), len(w.kids)])
            stack.extend(reversed(w.kids))
        return out

    @classmethod
    def parse(cls, rows: list) -> Wrapper:
        stack: list[tuple[Wrapper, int]] = []
        for key, rep, opt, chars, links, seen, own, kids in rows:
            w = cls(key, bool(rep), bool(opt), chars, links, seen, set(own))
            while stack and len(stack[-1][0].kids) == stack[-1][1]:
                stack.pop()
            if stack:
                stack[-1][0].kids.append(w)
            else:
                root = w
            stack.append((w, kids))
        return root

    def expression(self) -> str:
        """The wrapper as a regular expression over tags; # is a text slot."""
        parts: list[str] = []
        stack: list[Wrapper | str] = [self]
        while stack:
            w = stack.pop()
            if isinstance(w, str):
                parts.append(w)
                continue
            mark = "*" if w.rep and w.opt else "+" if w.rep else "?" if w.opt else ""
            parts.append(("(" if mark else "") + (f"<{w.key}>" if w.key else "") + ("#" if w.chars else ""))
            stack.append(("</>" if w.key else "") + (f"){mark}" if mark else ""))
            stack.extend(reversed(w.kids))
        return "".join(parts)


@dataclass(frozen=True)
class Verdict:
    """What a wrapper says: numbers of paths, and of paths with texts."""

    roots: frozenset[int]  # elements that hold the main text; none: anywhere
    large: frozenset[int]  # elements that no word makes boilerplate
    menus: frozenset[int]  # repeated groups of links
    template: frozenset[int]  # texts of the wrapper itself

    def dump(self) -> str:
        return json.dumps([sorted(x) for x in (self.roots, self.large, self.menus, self.template)])

    @classmethod
    def parse(cls, x: str) -> Verdict:
        return cls(*map(frozenset, json.loads(x)))


def judge(w: Wrapper, pages: int) -> Verdict:
    """``pages``: how many different pages there are, or more than three."""
    nodes, stack = [], [(w, -1, 0)]
    while stack:  # every element after the one above it
        node, above, number = stack.pop()
        nodes.append((node, above, number))
        at = len(nodes) - 1
        stack.extend((k, at, _hash(number, k.key)) for k in node.kids)
    # Characters outside links and boilerplate tags at or below each element.
    plain = [max(0, n.chars - n.links) for n, _, _ in nodes]
    for at in range(len(nodes) - 1, 0, -1):
        if nodes[at][0].key.partition(".")[0] not in BOILER_TAGS:
            plain[nodes[at][1]] += plain[at]
    by: Counter[int] = Counter()
    for (_, _, number), n in zip(nodes, plain, strict=True):
        by[number] += n
    large = frozenset(number for node, above, number in nodes if above >= 0 and 2 * by[number] > plain[0] and boilerplate(node.key))
    dead = [False] * len(nodes)
    roots = set()
    for at, (node, above, number) in enumerate(nodes[1:], 1):
        dead[at] = dead[above] or boilerplate(node.key) and number not in large
        if is_main(node.key) and not dead[at]:
            roots.add(number)
    if roots:
        return Verdict(frozenset(roots), large, frozenset(), frozenset())
    menus = frozenset(number for node, _, number in nodes if node.rep and node.chars and 10 * node.links >= 9 * node.chars)
    enough = max(3, (w.seen + 1) // 2)
    template = frozenset(number ^ t for node, _, number in nodes if node.seen >= enough for t in node.own) if pages >= 3 else frozenset()
    return Verdict(frozenset(), large, menus, template)


def text_of(page: Page, v: Verdict, template: bool = True) -> str:
    """The main text by a verdict; ``template`` tells whether menus and the wrapper's own texts go."""
    numbers, dead, inside = [0], [False], [not v.roots]
    for at in range(1, len(page.keys)):
        above, key = page.above[at], page.keys[at]
        number = _hash(numbers[above], key)
        numbers.append(number)
        dead.append(dead[above] or boilerplate(key) and number not in v.large or template and number in v.menus)
        inside.append(inside[above] or number in v.roots)
    out = []
    for path, text in zip(page.paths, page.texts, strict=True):
        if inside[path] and not dead[path]:
            if not (template and v.template and numbers[path] ^ xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) in v.template):
                out.append(text)
    return "\n".join(out)


def main_text(html: str, host: Verdict | None) -> str:
    """The page's main text by its host's wrapper, or by its own."""
    page = Page(html)
    if not page.texts:
        return ""
    if host is None:
        return text_of(page, judge(Wrapper.of_page(page), 1), False)
    if text := text_of(page, host):
        return text
    own = judge(Wrapper.of_page(page), 1)
    own = Verdict(own.roots, host.large, host.menus, host.template if not own.roots else frozenset())
    return text_of(page, own) or text_of(page, own, False)


def host_wrappers(pages: DataFrame, html: str, host: str) -> DataFrame:
    """(host, pages, wrapper): all pages of each host aligned, in three steps; ``pages`` has the least hashes of three."""
    schema = "host string, pages array<long>, wrapper string"

    def frame(made: dict[str, tuple[set[int], Wrapper]]) -> pd.DataFrame:
        return pd.DataFrame({"host": list(made), "pages": [sorted(p)[:3] for p, _ in made.values()], "wrapper": [json.dumps(w.dump()) for _, w in made.values()]})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, tuple[set[int], Wrapper]] = {}
        held = 0
        for b in batches:
            for h, x in zip(b["host"], b["html"], strict=True):
                if not x:
                    continue
                number = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1
                w = Wrapper.of_page(Page(x))
                if h not in made:
                    made[h] = {number}, w
                    held += len(x)
                elif number not in made[h][0]:
                    made[h][1].merge(w)
                    seen = made[h][0]
                    seen.add(number)
                    if len(seen) > 1000:  # enough to know copies by; the least three go on
                        made[h] = set(sorted(seen)[:500]), made[h][1]
                if held > 1 << 26:
                    yield frame(made)
                    made, held = {}, 0
        if made:
            yield frame(made)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["wrapper"], pdf["pages"], strict=True), key=lambda r: r[0])
        whole, seen = Wrapper.parse(json.loads(rows[0][0])), set(rows[0][1])
        for x, p in rows[1:]:
            whole.merge(Wrapper.parse(json.loads(x)))
            seen |= set(p)
        return frame({pdf["host"].iloc[0]: (seen, whole)})

    rows = pages.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInPandas(partial, schema)
    salted = rows.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(32))).applyInPandas(join, schema)
    return salted.groupBy("host").applyInPandas(join, schema)


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in a new column."""
    refuse_clash(pages, [out])
    host = "_html_host"
    keyed = pages.withColumn(host, url_parts(F.col(url))[0])

    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for numbers, ws in batches:
            yield pd.Series([judge(Wrapper.parse(json.loads(w)), len(n)).dump() for n, w in zip(numbers, ws, strict=True)])

    said = host_wrappers(keyed, html, host).select(F.col("host").alias(host), F.pandas_udf(judged, "string")("pages", "wrapper").alias("_html_said"))
    said = Scratch(pages.sparkSession, "html").cut(said)
    size = said.agg(F.coalesce(F.sum(F.length(host) + F.length("_html_said") + 32), F.lit(0))).first()[0]
    joined = keyed.join(F.broadcast(said) if size <= BROADCAST_BYTES else said, host, "left")

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, Verdict] = {}
        for pages_, said_ in batches:
            got = []
            for x, v in zip(pages_, said_, strict=True):
                if v is not None and v not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[v] = Verdict.parse(v)
                got.append(main_text(x or "", known[v] if v is not None else None))
            yield pd.Series(got)

    return joined.withColumn(out, F.pandas_udf(cut, "string")(html, "_html_said")).drop(host, "_html_said")
