"""Main text of web pages by wrappers inferred per host.

Method (union-free regular expressions).  A page is a stream of block tags and texts.  Within
a page, neighbours of one kind fold into a repeated item and recurring runs into a repeated
group.  Pages of one host are then aligned one after another: at each level the item
sequences are matched by dynamic programming; an item that only one side has becomes optional,
or joins its like beside it as a repeated item; texts become slots, constant while all pages
agree.  The result is a regular expression without unions, the wrapper, whose slots count
pages, characters, linked characters and whether they vary.  Pages that share too little
with a host's wrappers found another one.

The wrapper decides once per host what its slots are: by the meaning of tags, classes and
roles first, by varying text and link share where a template names nothing.  A page is
matched to its host's nearest wrapper and gives the texts in kept slots.

Spark.  Each partition aligns its own pages; partial wrappers merge in rounds of bounded groups,
so a host may hold any share of all pages.  Statistics cover every page; a host keeps its
``TEMPLATES`` most frequent wrappers, and a page that fits none is its own wrapper.  Wrappers are
broadcast while all of them together stay below ``BROADCAST_BYTES``, else joined by host.

Blocks are block-level elements; ``br`` and inline tags do not end one.  White space (Unicode,
no-break spaces too) becomes one space.  Unclosed tags end with their parent; an unclosed comment or
script runs to the end of the page.

Odd rows.  Null and empty html give an empty text.  A null url or one without a host counts
as host ''.  Repeated pages count again and are returned again.  Extra columns are ignored.
Nesting deeper than ``DEPTH`` is flattened, its texts are kept.  Empty pages give no rows.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import slices, staged, table

#: Wrappers a host keeps, partial wrappers merged in one group, bytes of all wrappers that are still broadcast.
TEMPLATES = 64
FAN = 256
BROADCAST_BYTES = 32 << 20
#: Levels of nesting told apart, items of one level before they are generalised, longest run looked for.
DEPTH = 60
WIDTH = 48
RUN = 4
#: Share of a page's paths that a wrapper must know.
ALIKE = 0.5

# HTML's elements by kind.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LISTED = set("p li dt dd tr td th h2 h3 h4 h5 h6 pre blockquote figure".split())
RAW = set("script style title textarea xmp noembed noframes".split())
SKIPPED = set("noscript template svg canvas audio video object iframe select button".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Opening one of the first closes an open one of the second, up to the third.
CLOSES = {
    **{t: ({"p"}, {"button"}) for t in BLOCKS},
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "body": ({"head"}, set()),
}
# What tags and words of class, id and role say.
OTHER_TAGS = set("head nav aside footer form menu dialog header fieldset".split())
OTHER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar side aside rail widget widgets related recommended recommendations share sharing social comment "
    "comments reply replies respond discussion disqus footer foot header masthead topbar toolbar copyright legal search searchbox "
    "pagination pager paywall form toc skip hidden complementary contentinfo".split()
)
MAIN_WORDS = set("article articlebody content main post entry story body text page".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
INVISIBLE = re.compile(r"display\s*:\s*none", re.I)


def label_of(tag: str, attributes: str) -> str:
    """A tag with its class, id and role words, without numbers: ``div.ad.top``."""
    if not attributes or attributes.isspace():
        return tag
    words = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            words.update(w.lower() for w in WORD.findall(value))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and INVISIBLE.search(value):
            words.add("hidden")
    return ".".join([tag, *sorted(words)])


class Item:
    """A piece of a page or wrapper: an element, a repeated group (label ``()``) or a text slot (label ``#``)."""

    __slots__ = ("label", "items", "optional", "repeated", "stat", "raw", "keep")

    def __init__(self, label, items=None, optional=False, repeated=False, stat=None, raw=None, keep=False):
        self.label, self.items, self.optional, self.repeated = label, items if items is not None else [], optional, repeated
        self.stat, self.raw, self.keep = stat, raw if raw is not None else [], keep

    def packed(self) -> list:
        return [self.label, [i.packed() for i in self.items], int(self.optional), int(self.repeated), self.stat, int(self.keep)]


def unpacked(data: list) -> Item:
    label, items, optional, repeated, stat, keep = data
    return Item(label, [unpacked(i) for i in items], bool(optional), bool(repeated), stat, keep=bool(keep))


def parse(page: str) -> tuple[Item, list[str]]:
    """The tree of a page's block elements and its text blocks; a slot's ``raw`` names its blocks."""
    root, blocks = Item("root"), []
    stack = [("", root)]  # open tags with their elements
    pieces: list[str] = []
    linked, link, muted, at = 0, False, None, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            mark = zlib.crc32(text.encode("utf-8", "surrogatepass"))
            stack[-1][1].items.append(Item("#", stat=[1, 1, len(text), min(linked, len(text)), mark, mark], raw=[len(blocks)]))
            blocks.append(text)
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and muted is None:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if link:
                linked += len(text)

    n = len(page)
    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        if found.group(1) is not None:
            say(found.group(1))
            continue
        closing, tag, attributes = found.group(2, 3, 4) if found.group(3) else found.group(5, 6, 7)
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW or tag in SKIPPED:
            if not closing and not attributes.endswith("/"):
                end = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n if tag in RAW else at
        elif tag not in BLOCKS:
            if tag in ("br", "img", "wbr"):
                pieces.append(" ")
            elif tag == "a":
                link = not closing
            if muted is not None:
                if tag == muted[0]:
                    muted[1] += -1 if closing else 1
                    muted = muted if muted[1] else None
            elif not closing and attributes and not OTHER_WORDS.isdisjoint(label_of(tag, attributes).split(".")[1:]):
                muted = [tag, 1] if not attributes.endswith("/") and tag not in ("br", "img", "input", "link", "meta") else None
        else:
            flush()
            link, muted = False, None
            if closing:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if depth:
                    del stack[depth:]
            elif tag != "hr":
                ended, within = CLOSES.get(tag, ((), ()))
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ended:
                        del stack[i:]
                        break
                    if stack[i][0] in within or stack[i][0] not in ("p",) and ended == {"p"}:
                        break
                if tag in ("html", "body") and any(t == tag for t, _ in stack):
                    continue
                parent = stack[-1][1]
                if len(stack) > DEPTH:
                    stack.append((tag, parent))
                else:
                    element = Item(label_of(tag, attributes))
                    parent.items.append(element)
                    stack.append((tag, element))
    flush()
    return root, blocks


# ---- union-free expressions


def tag_of(label: str) -> str:
    return label.split(".", 1)[0]


def general(label: str) -> str:
    """A label with its words left out, but for what they say."""
    return f"{tag_of(label)}.*" + ("!" if is_other(label) else "")


def same(a: Item, b: Item) -> bool:
    if a.label == b.label:
        return a.label != "()" or not {i.label for i in a.items}.isdisjoint(i.label for i in b.items)
    if ".*" in a.label or ".*" in b.label:
        return general(a.label) == general(b.label) if a.label[0] not in "(#" and b.label[0] not in "(#" else False
    return False


def is_other(label: str) -> bool:
    """Do a label's tag or words name something beside the main text?"""
    if label.endswith(".*!"):
        return True
    tag, *words = label.split(".")
    return tag in OTHER_TAGS or not OTHER_WORDS.isdisjoint(words)


def merge_stats(a: list | None, b: list | None, within: bool) -> list | None:
    """Slot statistics [pages, blocks, characters, linked, lowest hash, highest hash] of one page or of two."""
    if a is None or b is None:
        return a or b
    if within:
        mixed = zlib.crc32(b"%d %d" % (a[4], b[4]))
        return [1, a[1] + b[1], a[2] + b[2], a[3] + b[3], mixed, mixed]
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3], min(a[4], b[4]), max(a[5], b[5])]


def merge(a: Item, b: Item, within: bool) -> Item:
    """One item for two like ones: of one page (``within``) or of different pages."""
    label = a.label if a.label == b.label else general(a.label) if a.label != "()" else "()"
    items = grouped(a.items, b.items, within) if label == "()" else align(a.items, b.items, within)
    return Item(label, items, a.optional or b.optional, a.repeated or b.repeated or within, merge_stats(a.stat, b.stat, within), a.raw + b.raw, a.keep or b.keep)


def grouped(a: list[Item], b: list[Item], within: bool) -> list[Item]:
    """The items of two repeated groups: one of each label, all optional."""
    out = list(a)
    for item in b:
        at = next((i for i, own in enumerate(out) if same(own, item)), None)
        if at is None:
            out.append(item)
        else:
            out[at] = merge(out[at], item, within)
    for item in out:
        item.optional = True
    return out


def alike(a: Item, b: Item) -> bool:
    """May two neighbours of one label be one repeated item?"""
    if a.label == "#" or tag_of(a.label) in LISTED or "." in a.label and ".*" not in a.label:
        return True
    x, y = {i.label for i in a.items}, {i.label for i in b.items}
    return bool(x | y) and 2 * len(x & y) > len(x | y)


def as_group(items: list[Item], within: bool) -> Item:
    group = Item("()", repeated=True)
    for item in items:
        group.items = grouped(group.items, item.items if item.label == "()" else [item], within)
    return group


def fold(items: list[Item]) -> list[Item]:
    """A page's items of one level with neighbours and recurring runs folded, level by level from below."""
    for item in items:
        if item.items:
            item.items = fold(item.items)
    out: list[Item] = []
    for item in items:
        if out and out[-1].label == item.label and item.label != "()" and (tag_of(item.label) in LISTED or "." in item.label):
            out[-1] = merge(out[-1], item, True)
        else:
            out.append(item)
    for size in range(2, RUN + 1):
        at = 0
        while at + 2 * size <= len(out):
            labels = [i.label for i in out[at : at + size]]
            end = at + size
            while len(set(labels)) == size and "()" not in labels and [i.label for i in out[end : end + size]] == labels:
                end += size
            if end > at + size:
                out[at:end] = [as_group(out[at:end], True)]
            at += 1
    return narrowed(out, True)


def narrowed(items: list[Item], within: bool) -> list[Item]:
    """A level of bounded width: past it, what lies between recurring labels becomes one repeated group of optional items."""
    if len(items) <= WIDTH:
        return items
    if len({i.label for i in items}) > WIDTH:
        for item in items:
            if item.label[0] not in "(#":
                item.label = general(item.label)
    places: dict[str, list[int]] = {}
    for at, item in enumerate(items):
        places.setdefault(item.label, []).append(at)
    recurring = [p for p in places.values() if len(p) > 1]
    if not recurring:
        return items
    low, high = min(p[0] for p in recurring), max(p[-1] for p in recurring) + 1
    return items[:low] + [as_group(items[low:high], within)] + items[high:]


def absorbed(items: list[Item], others: list[Item], within: bool) -> list[Item]:
    """``items`` with runs that a group among ``others`` can repeat turned into such a group."""
    for group in others:
        if group.label != "()" or any(i.label == "()" and same(i, group) for i in items):
            continue
        known = [i.label for i in group.items]
        at = next((i for i, item in enumerate(items) if item.label in known), None)
        if at is not None:
            end = at
            while end < len(items) and items[end].label in known:
                end += 1
            items = items[:at] + [as_group(items[at:end], within)] + items[end:]
    return items


def matched(a: list[Item], b: list[Item]) -> list[tuple[int, int]]:
    """The longest common subsequence of two levels, items with like contents preferred."""
    if [i.label for i in a] == [i.label for i in b] and all(same(x, y) for x, y in zip(a, b)):
        return [(i, i) for i in range(len(a))]
    score = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best = max(score[i + 1][j], score[i][j + 1])
            if same(a[i], b[j]):
                x, y = {k.label for k in a[i].items}, {k.label for k in b[j].items}
                best = max(best, score[i + 1][j + 1] + 1 + (len(x & y) / len(x | y) if x | y else 1))
            score[i][j] = best
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if score[i][j] == score[i + 1][j]:
            i += 1
        elif score[i][j] == score[i][j + 1]:
            j += 1
        else:
            pairs.append((i, j))
            i, j = i + 1, j + 1
    return pairs


def align(a: list[Item], b: list[Item], within: bool) -> list[Item]:
    """One level of the expression for both: like items merged, others optional or repeated."""
    if not a or not b:
        for item in a or b:
            item.optional = True
        return a or b
    a, b = absorbed(a, b, within), absorbed(b, a, within)
    out: list[Item] = []
    i = j = 0
    for x, y in [*matched(a, b), (len(a), len(b))]:
        for item in (*a[i:x], *b[j:y]):
            item.optional = True
            out.append(item)
        if x < len(a):
            out.append(merge(a[x], b[y], within))
        i, j = x + 1, y + 1
    folded: list[Item] = []
    for item in out:
        beside = folded[-1] if folded else None
        if beside is not None and beside.label == item.label and (beside.optional or item.optional) and alike(beside, item):
            both = merge(beside, item, within)
            both.repeated, both.optional = True, beside.optional and item.optional
            folded[-1] = both
        else:
            folded.append(item)
    return narrowed(folded, within)


def paths(item: Item, above: str = "") -> Iterator[str]:
    for child in item.items:
        here = above if child.label == "()" else f"{above}/{child.label}"
        yield here
        yield from paths(child, here)


def likeness(page: set[str], wrapper: set[str]) -> float:
    return len(page & wrapper) / len(page) if page else 1.0


def page_tree(page: str) -> tuple[Item, list[str]]:
    root, blocks = parse(page)
    root.items = fold(root.items)
    return root, blocks


class Templates:
    """The wrappers of one host, most pages first, with the number of their pages."""

    def __init__(self):
        self.found: list[list] = []  # [wrapper, paths, pages]

    def add(self, tree: Item, pages: int = 1) -> None:
        own = set(paths(tree))
        best = max(self.found, key=lambda f: likeness(own, f[1]), default=None)
        if best is None or likeness(own, best[1]) < ALIKE:
            self.found.append([tree, own, pages])
        else:
            best[0] = merge(best[0], tree, False)
            best[1] |= own
            best[2] += pages

    def kept(self) -> list[list]:
        return sorted(self.found, key=lambda f: (-f[2], json.dumps(f[0].packed())))[:TEMPLATES]


def bare(item: Item) -> Item:
    """A wrapper without its links to the blocks of one page."""
    item.raw = []
    for child in item.items:
        bare(child)
    return item


# ---- what a wrapper's slots are


def amount(item: Item, varying: bool) -> tuple[int, int]:
    """Characters and linked characters of an item's slots (of varying ones only, if asked)."""
    own = item.stat
    counts = own is not None and not (varying and own[4] == own[5])
    total, linked = (own[2], own[3]) if counts else (0, 0)
    for child in item.items:
        a, b = amount(child, varying)
        total, linked = total + a, linked + b
    return total, linked


def every(item: Item) -> Iterator[Item]:
    yield item
    for child in item.items:
        yield from every(child)


def holds(item: Item, tags: set[str]) -> bool:
    return any(tag_of(i.label) in tags for i in every(item) if i is not item)


def assign(root: Item, pages: int) -> Item:
    """Mark the items of the main text as kept."""
    varying = pages > 2 and amount(root, True)[0] > 0
    dropped: set[int] = set()

    def drop(item: Item, inside: bool) -> None:
        for child in item.items:
            tag, *words = child.label.split(".")
            other = is_other(child.label)
            named = other and tag in OTHER_TAGS
            said = set(words) & OTHER_WORDS
            titled = tag == "header" and not said - {"header"} and holds(child, HEADINGS) or not named and said == {"header"}
            around = not named and holds(child, {"main", "h1"})
            if tag in ("html", "body") or around or inside and titled:
                other = False
            if other:
                dropped.add(id(child))
            else:
                drop(child, inside or tag in ("article", "main"))

    drop(root, False)

    def candidates(item: Item, wanted) -> list[Item]:
        out = []
        for child in item.items:
            if id(child) in dropped:
                continue
            if wanted(child) and amount(child, False)[0]:
                out.append(child)
            else:
                out += candidates(child, wanted)
        return out

    def text_in(item: Item) -> int:
        if id(item) in dropped:
            return 0
        return (item.stat[2] - item.stat[3] if item.stat else 0) + sum(text_in(i) for i in item.items)

    articles = candidates(root, lambda i: tag_of(i.label) == "article")
    mains = candidates(root, lambda i: tag_of(i.label) == "main" or {"articlebody"} & set(i.label.split(".")[1:]))
    if articles and mains and 2 * sum(map(text_in, articles)) < sum(map(text_in, mains)):
        articles = []
    chosen = articles or mains
    if not chosen:
        at, rest = root, lambda i: text_in(i) if not varying else _open(i, dropped)
        while True:
            inner = [i for i in at.items if id(i) not in dropped and i.label != "#" and tag_of(i.label) not in LISTED | HEADINGS]
            best = max(inner, key=rest, default=None)
            if best is None or not rest(best) or rest(best) < 0.7 * rest(at):
                break
            at = best
        chosen = [at]
        for child in at.items:
            total, linked = amount(child, False)
            if child.label != "#" and total and tag_of(child.label) not in HEADINGS:
                menu = 2 * linked > total
                fixed = varying and tag_of(child.label) not in LISTED and not amount(child, True)[0]
                if menu or fixed:
                    dropped.add(id(child))

    def keep(item: Item) -> None:
        item.keep = True
        for child in item.items:
            if id(child) not in dropped:
                keep(child)

    for item in chosen:
        keep(item)
    if chosen and not any(holds(i, {"h1"}) for i in chosen):
        _keep_title(root, {id(i) for i in chosen}, dropped)
    return root


def _open(item: Item, dropped: set[int]) -> int:
    """Varying text outside links and dropped items."""
    if id(item) in dropped:
        return 0
    own = item.stat[2] - item.stat[3] if item.stat and item.stat[4] != item.stat[5] else 0
    return own + sum(_open(i, dropped) for i in item.items)


def _keep_title(item: Item, chosen: set[int], dropped: set[int]) -> bool:
    """Keep an ``h1`` that stands beside the main text or beside what holds it."""
    if id(item) in chosen:
        return True
    within = [i for i in item.items if id(i) not in dropped and _keep_title(i, chosen, dropped)]
    if within:
        for child in item.items:
            if tag_of(child.label) == "h1" and id(child) not in dropped:
                for part in every(child):
                    part.keep = True
    return bool(within)


def kept_blocks(page: Item, wrapper: Item) -> list[int]:
    """Numbers of a page's blocks that lie in kept slots of its wrapper."""
    out: list[int] = []

    def walk(items: list[Item], known: list[Item], inside: bool) -> None:
        items = absorbed(items, known, True)
        pairs = dict(matched(items, known))
        for at, item in enumerate(items):
            own = known[pairs[at]] if at in pairs else _nearest(item, known)
            if own is None:  # the wrapper has no such item here
                if inside and not is_other(item.label):
                    out.extend(b for part in every(item) if part.label == "#" for b in part.raw)
            elif item.label == "#":
                if own.keep:
                    out.extend(item.raw)
            else:
                walk(item.items, own.items, own.keep)

    walk(page.items, wrapper.items, wrapper.keep)
    return sorted(out)


def _nearest(item: Item, known: list[Item]) -> Item | None:
    """An item of the same kind elsewhere on the level, or in one of its groups."""
    for own in known:
        if same(item, own):
            return own
        if own.label == "()":
            for part in own.items:
                if same(item, part):
                    return part
    return None


# ---- on Spark


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


WRAPPERS = "host string, wrapper string, pages long"


def _rows(found: dict[str, Templates]) -> pa.RecordBatch:
    rows = [(h, json.dumps(bare(w).packed(), separators=(",", ":")), n) for h, t in found.items() for w, _, n in t.kept()]
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = (pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "wrapper", "pages"])


def partial_wrappers(pages: DataFrame) -> DataFrame:
    """Wrappers of the pages of each partition."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Templates] = {}
        for batch in slices(batches, "html"):
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                found.setdefault(host, Templates()).add(bare(page_tree(page or "")[0]))
            if sum(len(t.found) for t in found.values()) > FAN:
                yield _rows(found)
                found = {}
        yield _rows(found)

    return pages.select("host", "html").mapInArrow(learn, WRAPPERS)


def inferred(pages: DataFrame) -> DataFrame:
    """(host, wrappers): all wrappers of a host with their slots assigned, as one JSON text."""
    parts = staged(partial_wrappers(pages), "wrapper-parts")

    def combine(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["host", "wrapper", "pages"]).to_pylist(), key=lambda r: (-r["pages"], r["wrapper"]))
        found = Templates()
        for row in rows:
            found.add(unpacked(json.loads(row["wrapper"])), row["pages"])
        return pa.Table.from_batches([_rows({rows[0]["host"]: found})])

    while True:
        sizes = parts.groupBy("host").agg(F.count("*").alias("parts"))
        most = sizes.agg(F.coalesce(F.max("parts"), F.lit(0))).first()[0]
        # A host's partial wrappers are dealt to groups of about FAN; a group leaves TEMPLATES at most.
        spread = F.pmod(F.xxhash64("wrapper", "pages"), F.ceil(F.col("parts") / F.lit(FAN)))
        dealt = parts.join(sizes, "host").withColumn("bucket", spread)
        parts = staged(dealt.groupBy("host", "bucket").applyInArrow(combine, WRAPPERS), "wrapper-parts")
        if most <= FAN:
            break

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [
                json.dumps(assign(unpacked(json.loads(w)), n).packed(), separators=(",", ":"))
                for w, n in zip(batch.column("wrapper").to_pylist(), batch.column("pages").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(done, pa.string())], ["host", "wrapper"])

    settled = parts.mapInArrow(settle, "host string, wrapper string")
    return staged(settled.groupBy("host").agg(F.array_sort(F.collect_list("wrapper")).alias("wrappers")), "wrappers")


def extract(page: str, wrappers: list[tuple[Item, set[str]]]) -> str:
    tree, blocks = page_tree(page)
    own = set(paths(tree))
    best = max(wrappers, key=lambda w: likeness(own, w[1]), default=None)
    if best is None or likeness(own, best[1]) < ALIKE:
        alone = assign(unpacked(tree.packed()), 1)
        best = (alone, own)
    return "\n".join(blocks[i] for i in kept_blocks(tree, best[0]))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page (columns page_id, url, html)."""
    named = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    wrappers = inferred(named)
    size = wrappers.agg(F.coalesce(F.sum(F.length(F.to_json("wrappers"))), F.lit(0))).first()[0]
    known = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list] = {}
        for batch in slices(batches, "html"):
            texts = []
            hosts, own = batch.column("host").to_pylist(), batch.column("wrappers")
            for at, (host, page) in enumerate(zip(hosts, batch.column("html").to_pylist())):
                if host not in cache:
                    if len(cache) >= FAN:
                        cache.clear()
                    trees = [unpacked(json.loads(w)) for w in own[at].as_py() or []]
                    cache[host] = [(t, set(paths(t))) for t in trees]
                texts.append(extract(page or "", cache[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return named.join(known, "host", "left").mapInArrow(cut, ", ".join([*kinds, "text string, n_chars long"]))


def op13_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
