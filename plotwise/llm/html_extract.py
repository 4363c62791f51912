"""Operator 9: main-text extraction by equivalence-class template deduction.

A page is read as tokens: a start or end tag with its place in the tree, its
class and its id; or a block of text with its place. A token's occurrence
vector is its count on each page of the host. Tokens of one host with the same
vector form an equivalence class. A class needs enough of the host's pages and
more than one token (tags come in pairs at least) or a text, which stands for
its words. Pages of equal html count once.

A class is valid if it is ordered and nested. Ordered: on every page its
tokens come in one order, as often as they come. Of those outside the longest
run in order on some page, those that are furthest out over all pages (by more
than half as many places as the worst) form a class of their own, if they are
fewer than all; both are judged again. Nested: its span never crosses that of another class, whose next
token would come before its last. Of two that cross, the one on fewer pages (of
fewer tokens) is broken up: its texts remain, its tags are no template.

Tokens are then told apart by where they stand: an occurrence between two
tokens of a valid class has another role than one elsewhere. Roles have
vectors, and so classes, of their own, and this goes on until the classes of a
host stay as they were. All that is valid in some round is part of the template.

Valid classes whose tokens occur once a page make the frame of the template;
classes that repeat within a page (list items, paragraphs) nest in its slots
and are part of these. What lies between two frame tokens is a slot. Text
tokens of a valid class are the host's own (notices, imprints), not data,
wherever they stand, articles included.

Slots are then told apart: those within navigation, page headers and footers,
sidebars, forms, adverts, notices and reader comments go. The slot that holds
most text over all pages of the host decides what an article mark is worth: if
it lies in articles, then on a page whose article has it, slots outside the
article go (else the mark is a teaser's). Elsewhere slots go whose text over all
pages of the host is links by half or more, the slot of most text excepted.
The blocks of the slots that remain are the text. Without a template, a page
is its own host and its outermost lists and tables are slots.

A vector is kept as a count of pages and a hash over (page, count), so vectors
of a host with a third of all pages combine like any sum.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.llm.common import cut_lineage, ship, small_batches

#: A host needs this many pages for a template, and a class this share of them.
MIN_PAGES, SUPPORT = 3, 0.5
#: Hosts, and tokens (of 8 bytes) of their templates, that may be broadcast; beyond, a shuffle join.
BROADCAST_HOSTS, BROADCAST_TOKENS = 20_000, 4_000_000
PAGE_ROLES = "host string, page bigint, roles array<bigint>"

# FIXED: the HTML elements without content of their own, inline elements, and those that never hold main text
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr"}
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|select|title"
NEVER = {"head", "nav", "footer", "aside", "button", "menu", "dialog", "figcaption", "canvas", "audio", "video", "address"}
# FIXED: elements that hold no main text unless they hold most of the page
LABELS = {"form", "fieldset", "header"}
CLOSES_P = {"p", "div", "section", "article", "main", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6",
            "pre", "blockquote", "figure", "form", "nav", "aside", "header", "footer", "hr", "address", "fieldset"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
# FIXED: classes, ids and roles (whole ones) that mark something other than main text
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo",
         "promotion", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer",
         "foot", "masthead", "topbar", "header", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup",
         "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search", "share", "sharing", "social",
         "related", "recommended", "comment", "comments", "commentlist", "respond", "responses", "replies", "disqus",
         "discussion", "pagination", "pager", "widget", "toolbar", "copyright", "legal", "disclaimer", "skip",
         "alert", "complementary", "contentinfo"}
HEADER_MARKS = {"header", "masthead"}
LISTS = {"ul", "ol", "dl", "table", "menu"}
ARTICLE_MARKS = {"articlebody", "main"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
                   r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
                   r"|<[!?/][^>]*>|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


class Block:
    """A run of text: its place (elements from the root), its text and the characters of it within links."""
    __slots__ = ("path", "text", "linked", "slot")  # slot: the frame tag that opens it, 0 before the first

    def __init__(self, path, text, linked):
        self.path, self.text, self.linked, self.slot = path, text, linked, 0


def events(html: str) -> Iterator[tuple[str, object]]:
    """("tag", token string) and ("block", Block) in page order."""
    path: list[tuple[str, frozenset, int]] = []  # (element, marks, its number in the page)
    text: list[str] = []
    linked, in_link = 0, 0
    at = 0

    def block():
        nonlocal text, linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            out = Block(tuple(path), joined, linked) if joined else None
            text, linked = [], 0
            return out

    def place():
        return "/".join(e[0] for e in path)

    for m in TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at:m.start()]
            text.append(piece)
            linked += len(piece) if in_link else 0
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, end = name.lower(), bool(m["end"] or m["end2"])
        if name == "br":
            text.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if end else 1
            continue
        if b := block():
            yield "block", b
        if end:
            for i in range(len(path) - 1, -1, -1):
                if path[i][0] == name:
                    del path[i:]
                    yield "tag", f"</{name} {place()}"
                    break
            in_link = 0
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and path and path[-1][0] == "p":
            path.pop()
        elif name == "body" and path and path[-1][0] == "head":
            path.pop()
        elif name in SIBLINGS and path and path[-1][0] in SIBLINGS[name]:
            path.pop()
        marks, names = set(), []
        for k, v in ATTRIBUTE.findall(m["attrs"] or ""):
            v = v.strip("\"'").lower()
            names.append(v)
            marks.update(v.split())
            if v in ARTICLE_MARKS:
                marks.add("@article")
        path.append((name, frozenset(marks), m.start()))
        yield "tag", f"<{place()} {' '.join(names)}"
    rest = html[at:]
    # a tag that the end of the page cuts off is no text
    cut = rest.rfind("<")
    if cut >= 0 and re.match(r"<[a-zA-Z/!?]", rest[cut:]):
        rest = rest[:cut]
    text.append(rest)
    if b := block():
        yield "block", b


def text_token(b: Block) -> str:
    return "=" + "/".join(e[0] for e in b.path) + " " + b.text


def is_article(e: str, marks: frozenset) -> bool:
    return e in ("article", "main") or "@article" in marks


def in_article(b: Block) -> bool:
    return any(is_article(e, marks) for e, marks, _ in b.path)


def wrappers(blocks: list[Block], slots: bool = True) -> set[int]:
    """The named elements (by number) that hold most of a page's text and, with ``slots``, most of its slots."""
    blocks = [b for b in blocks if not any(e in NEVER for e, _, _ in b.path)]
    per, size, held = Counter(b.slot for b in blocks), Counter(), Counter()
    for b in blocks:
        for e, marks, at in b.path:
            if e in LABELS or marks & MARKS:
                size[at] += len(b.text)
                held[at, b.slot] += 1
    whole = Counter(at for (at, slot), n in held.items() if n == per[slot])
    total = sum(len(b.text) for b in blocks)
    return {at for at, n in size.items() if n * 2 > total and (not slots or whole[at] * 2 > len(per))}


def excluded(b: Block, unnamed: set[int]) -> bool:
    """Whether the block's place marks it as something other than main text.

    The names of html, body, articles and the ``unnamed`` elements don't count.
    """
    inside = False
    for e, marks, at in b.path:
        if e in NEVER:
            return True
        if is_article(e, marks):
            inside = True
        elif e not in ("html", "body") and at not in unnamed:
            if not inside and (e == "header" or marks & HEADER_MARKS):
                return True
            if e in LABELS - {"header"} or marks & MARKS - HEADER_MARKS:
                return True
    return False


def key(token: str) -> int:
    """A token's first role: its hash, the last bit set for texts."""
    import xxhash
    return (xxhash.xxh64_intdigest(token) - (1 << 63)) & ~1 | (token[0] == "=")


@lru_cache(1 << 16)
def role_at(role: int, place: tuple[int, int]) -> int:
    """The role of an occurrence at a place: the class around it, and the class's token before it."""
    import xxhash
    return (xxhash.xxh64_intdigest(struct.pack("<qqq", role, *place)) - (1 << 63)) & ~1 | role & 1


def page_roles(found: list[tuple[str, object]]) -> list[int]:
    return [key(x if kind == "tag" else text_token(x)) for kind, x in found]


class Member(NamedTuple):
    """What a role is in its class: ``rank`` is its number in the class's order, ``on`` the class's pages."""
    cls: int
    rank: int
    size: int
    on: int = 0


def in_order(values: list[int]) -> set[int]:
    """The places of a longest rising run of ``values``."""
    least, at, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(least, v)
        before.append(at[k - 1] if k else -1)
        least[k:k + 1], at[k:k + 1] = [v], [i]
    kept, i = set(), at[-1] if at else -1
    while i >= 0:
        kept.add(i)
        i = before[i]
    return kept


def disordered(roles: list[int], classes: dict[int, Member]) -> Counter:
    """How far the roles, as (class, role), that are out of their class's order on a page are from their places in it."""
    runs: dict[int, list[tuple[int, int]]] = {}
    seen: Counter = Counter()
    for r in roles:
        if m := classes.get(r):
            runs.setdefault(m.cls, []).append((seen[r] * m.size + m.rank, r))
            seen[r] += 1
    out: Counter = Counter()
    for cls, run in runs.items():
        if any(run[i][0] >= run[i + 1][0] for i in range(len(run) - 1)):
            kept = in_order([v for v, _ in run])
            due = {v: i for i, v in enumerate(sorted(v for v, _ in run))}
            for i, (v, r) in enumerate(run):
                if i not in kept:
                    out[cls, r] += 1 + abs(i - due[v])
    return out


def places(roles: list[int], classes: dict[int, Member], crossed: set | None = None) -> list[tuple[int, int] | None]:
    """The place of each occurrence: the innermost class around it and the number of its token before; None outside.

    ``crossed`` takes the classes that lose against one that they cross.
    """
    out, stack = [], []  # stack: (class, number of its last token)
    weight = {m.cls: (m.on, m.size, m.cls) for m in classes.values()} if crossed is not None else {}
    for r in roles:
        m = classes.get(r)
        if m and m.rank and any(cls == m.cls for cls, _ in stack):
            while stack[-1][0] != m.cls:
                other = stack.pop()[0]
                if crossed is not None:
                    crossed.add(min(m.cls, other, key=weight.get))
            stack.pop()
        out.append(stack[-1] if stack else None)
        if m and m.rank < m.size - 1:
            stack.append((m.cls, m.rank))
    return out


def told_apart(roles: list[int], classes: dict[int, Member]) -> list[int]:
    return [r if p is None else role_at(r, p) for r, p in zip(roles, places(roles, classes))]


def rounds(steps) -> list[dict[int, Member]]:
    """The classes of each round, of numbers as in ``templates``."""
    out: list[dict[int, Member]] = []
    for i in range(0, len(steps), 5):
        n, role, cls, rank, size = steps[i:i + 5]
        out += [{} for _ in range(n + 1 - len(out))]
        out[n][role] = Member(cls, rank, size)
    return out


def data_blocks(html: str, frame: frozenset, own: frozenset, steps=()) -> list[Block]:
    """The blocks of a page that are not excluded, nor the host's own text, with their slots (tokens are hashes).

    A token is of the template if it is by its role of any round.
    """
    page = list(events(html))
    slots, gone = [0] * len(page), set()
    if frame or own:
        roles = page_roles(page)
        for classes in [None, *rounds(steps)]:
            roles = told_apart(roles, classes) if classes else roles
            for i, r in enumerate(roles):
                if r in frame:
                    slots[i] = slots[i] or r
                elif r in own:
                    gone.add(i)
    found, slot = [], 0
    for i, (kind, x) in enumerate(page):
        if kind == "block":
            x.slot = slot if frame else next((at for e, _, at in x.path if e in LISTS), -1)
            if i not in gone:
                found.append(x)
        else:
            slot = slots[i] or slot
    unnamed, most = wrappers(found), wrappers(found, slots=False)
    # names that would leave nothing of a page don't count where most of its text is
    return [b for b in found if not excluded(b, unnamed)] or [
        b for b in found if not excluded(b, most)]


def slot_sizes(blocks: list[Block]) -> dict[int, list[int]]:
    """Per slot: characters, those within links, those within articles."""
    out: dict[int, list[int]] = {}
    for b in blocks:
        x = out.setdefault(b.slot, [0, 0, 0])
        x[0] += len(b.text)
        x[1] += min(b.linked, len(b.text))
        x[2] += len(b.text) if in_article(b) else 0
    return out


class Slots(NamedTuple):
    """What a host's slots are: the one of most text, whether that lies in articles, and those of links."""
    top: int
    marked: bool
    links: frozenset


def judged(sizes: dict[int, list[int]]) -> Slots:
    top, (n, _, inside) = max(sizes.items(), key=lambda x: (x[1][0], x[0]))
    return Slots(top, inside * 2 >= n, frozenset(k for k, x in sizes.items() if x[1] * 2 >= x[0]))


def main_blocks(html: str, frame: frozenset, own: frozenset, slots: Slots | None, steps=()) -> list[Block]:
    """The main-text blocks of a page, given its host's frame tags, own texts (as hashes), slots and rounds.

    Without ``slots`` the page's own are judged.
    """
    kept = data_blocks(html, frame, own, steps)
    if not kept:
        return kept
    slots = slots or judged(slot_sizes(kept))
    article = [b for b in kept if in_article(b)]
    if slots.marked and any(b.slot == slots.top for b in article):
        return article
    return [b for b in kept if b.slot == slots.top or b.slot not in slots.links]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _roles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"host": pdf["host"], "page": pdf["page"], "roles": [page_roles(list(events(x))) for x in pdf["html"]]})


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for h, page, roles in zip(pdf["host"], pdf["page"], pdf["roles"]):
            roles = roles.tolist()
            first = {r: i for i, r in reversed([*enumerate(roles)])}
            rows += [(h, r, n, first[r], page) for r, n in Counter(roles).items()]
        yield pd.DataFrame(rows, columns=["host", "role", "n", "first", "page"])


def _members(x) -> dict[int, Member]:
    x = [] if x is None else x.tolist()
    return {x[i]: Member(*x[i + 1:i + 5]) for i in range(0, len(x), 5)}


def _faults(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: Counter = Counter()
        for h, roles, members in zip(pdf["host"], pdf["roles"], pdf["members"]):
            roles, classes = roles.tolist(), _members(members)
            out = disordered(roles, classes)
            rows.update({(h, cls, r, False): n for (cls, r), n in out.items()})
            if not out:
                crossed: set = set()
                places(roles, classes, crossed)
                rows.update((h, cls, 0, True) for cls in crossed)
        yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["host", "cls", "role", "crosses", "n"])


def _told_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"host": pdf["host"], "page": pdf["page"], "roles": [
            told_apart(roles.tolist(), _members(m)) for roles, m in zip(pdf["roles"], pdf["members"])]})


def beside(rows: DataFrame, known: DataFrame, on: Column | str = "host", how: str = "left") -> DataFrame:
    """``rows`` with the template of their host: a row for each host, whose arrays are broadcast where they are few."""
    arrays = [f.name for f in known.schema if f.dataType.typeName() == "array"]
    hosts, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(F.greatest(F.size(c), F.lit(0)) for c in arrays)), F.lit(0))).first()
    # a template has at most a few times a page's tokens, but there may be many
    fits = hosts <= BROADCAST_HOSTS and size <= BROADCAST_TOKENS
    return rows.join(F.broadcast(known) if fits else known, on, how)


def _with_classes(pages: DataFrame, members: DataFrame) -> DataFrame:
    """``pages`` of the hosts that have classes, with these as flat numbers."""
    member = F.array("role", "cls", F.col("rank").cast("bigint"), "size", "on")
    return beside(pages, members.groupBy("host").agg(F.flatten(F.collect_list(F.when(F.col("size") > 1, member))).alias("members")),
                  how="inner")


def _classes(members: DataFrame) -> DataFrame:
    """``members`` of the classes that are more than a tag, with their rank and the size of their class."""
    cls = Window.partitionBy("host", "cls")
    # of two tokens in one order on all pages, the first one's mean place is the lesser
    return members.withColumn("size", F.count(F.lit(1)).over(cls)).filter(
        (F.col("size") > 1) | (F.col("role") % 2 != 0)).withColumn(
        "rank", F.row_number().over(cls.orderBy("first", "role")) - 1)


def equal_vectors(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, role, cls, on, most, first, size, rank): the classes of roles with equal occurrence vectors.

    ``pages`` has host, page and roles, ``sizes`` the pages of each host.
    """
    roles = pages.mapInPandas(_counted, "host string, role bigint, n int, first int, page bigint")
    vectors = roles.groupBy("host", "role").agg(
        F.count(F.lit(1)).alias("on"), F.max("n").alias("most"), F.sum("n").alias("all"), F.avg("first").alias("first"),
        F.bit_xor(F.xxhash64("page", "n")).alias("vector")).filter("on > 1")
    # a text on two of three pages may be an article that is there twice
    common = vectors.join(sizes, "host").filter(
        (F.col("on") >= F.col("pages") * SUPPORT) & ((F.col("role") % 2 == 0) | (F.col("on") >= MIN_PAGES)))
    # roles on at least half of the pages: at most twice a page's tokens per host
    return cut_lineage(_classes(common.select(
        "host", "role", F.xxhash64("vector", "on", "all", "most").alias("cls"), "on", "most", "first")))


def valid(pages: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` in ordered and nested classes, by the rules at the head of the module."""
    todo = members
    while True:
        faults = cut_lineage(_with_classes(pages, todo).select("host", "roles", "members").mapInPandas(
            _faults, "host string, cls bigint, role bigint, crosses boolean, n bigint").groupBy(
            "host", "cls", "role", "crosses").agg(F.sum("n").alias("n")))
        if faults.isEmpty():
            return members
        # a token that wanders is far out; one that it passed may be in order without it
        out = faults.filter(~F.col("crosses")).withColumn("most", F.max("n").over(Window.partitionBy("host", "cls"))).filter(
            F.col("n") * 2 > F.col("most")).select("host", "cls", "role", F.lit(True).alias("out"))
        # spans are known once a host's classes are in order
        broken = faults.filter("crosses").join(out.select("host").distinct(), "host", "left_anti").select(
            "host", "cls", F.lit(True).alias("broken"))
        judged_again = members.join(out, ["host", "cls", "role"], "left").join(broken, ["host", "cls"], "left").withColumn(
            "outs", F.count("out").over(Window.partitionBy("host", "cls")))
        alone = F.col("broken").isNotNull() | (F.col("out").isNotNull() & (F.col("outs") == F.col("size")))
        cls = F.when(alone, F.xxhash64("cls", "role")).when(F.col("out"), F.xxhash64("cls", F.lit("out"))).otherwise(F.col("cls"))
        members = cut_lineage(_classes(judged_again.withColumn("cls", cls).drop("out", "outs", "broken", "size", "rank")))
        todo = members.join(faults.select("host").distinct(), "host", "left_semi")


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, frame, own, steps): per host the hashes of the frame's tags and of the host's own texts, and what tells
    roles apart, as a table: of each round but the last, the round, role, class, rank and class size one after the other.

    Hosts of fewer than ``MIN_PAGES`` different pages, and pages without a host, have none.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(host(F.col(url_col)).alias("host"), html.alias("html")).filter("host != ''").withColumn(
        "page", F.xxhash64("html", F.col("host")))
    # a page is parsed once for all rounds; pages of equal html are one page
    read = cut_lineage(rows.mapInPandas(_roles, PAGE_ROLES).dropDuplicates(["host", "page"]))
    sizes = cut_lineage(read.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= MIN_PAGES))
    found, before = [], None
    while True:
        members = equal_vectors(read, sizes)
        state = cut_lineage(members.groupBy("host").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("cls", F.col("role") % 2 == 0).cast("decimal(38,0)")).alias("sum")))
        if before is not None:
            # hosts whose roles have the vectors that they had are done
            members = members.join(state.join(before, ["host", "n", "sum"]).select("host"), "host", "left_anti")
        if found and members.isEmpty():
            break
        members, before = valid(read, members), state
        found.append(members.withColumn("round", F.lit(len(found)).cast("bigint")))
        read = cut_lineage(_with_classes(read, members).select("host", "page", "roles", "members").mapInPandas(
            _told_apart, PAGE_ROLES))
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    once, text = F.col("most") == 1, F.col("role") % 2 != 0
    step = F.array("round", "role", "cls", F.col("rank").cast("bigint"), "size")
    rows = rows.withColumn("last", F.max("round").over(Window.partitionBy("host")))
    return cut_lineage(rows.groupBy("host").agg(
        F.collect_list(F.when(once & ~text, F.col("role"))).alias("frame"),
        F.collect_list(F.when(once & text, F.col("role"))).alias("own"),
        F.flatten(F.collect_list(F.when((F.col("size") > 1) & (F.col("round") < F.col("last")), step))).alias("steps")))


def _sets(*columns) -> Iterator[tuple[frozenset, ...]]:
    """Rows of array columns as sets; nulls as empty ones."""
    for row in zip(*columns):
        yield tuple(frozenset(() if x is None else x) for x in row)


def _numbers(steps) -> list[int]:
    return [] if steps is None else steps.tolist()


def _slot_sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        total: dict[tuple, list[int]] = {}
        for h, html, (frame, own), steps in zip(pdf["host"], pdf["html"], _sets(pdf["frame"], pdf["own"]), pdf["steps"]):
            for slot, x in slot_sizes(data_blocks(html, frame, own, _numbers(steps))).items():
                have = total.setdefault((h, slot), [0, 0, 0])
                for i, n in enumerate(x):
                    have[i] += n
        yield pd.DataFrame([(*k, *x) for k, x in total.items()], columns=["host", "slot", "chars", "linked", "inside"])


def with_slots(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` (host, frame, own, steps) with the host's ``Slots`` (top, marked, links).

    ``rows`` has __host, html, frame, own and steps.
    """
    sizes = rows.filter("__host IS NOT NULL").select(F.col("__host").alias("host"), "html", "frame", "own", "steps").mapInPandas(
        _slot_sizes, "host string, slot bigint, chars bigint, linked bigint, inside bigint").groupBy("host", "slot").agg(
        *(F.sum(x).alias(x) for x in ("chars", "linked", "inside")))
    top = sizes.groupBy("host").agg(
        F.max(F.struct("chars", "slot", "inside")).alias("t"),
        F.collect_list(F.when(F.col("linked") * 2 >= F.col("chars"), F.col("slot"))).alias("links")).select(
        "host", F.col("t.slot").alias("top"), (F.col("t.inside") * 2 >= F.col("t.chars")).alias("marked"), "links")
    return cut_lineage(known.join(top, "host", "left"))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        sets = _sets(pdf["frame"], pdf["own"], pdf["links"])
        for html, (frame, own, links), steps, top, marked in zip(pdf["html"], sets, pdf["steps"], pdf["top"], pdf["marked"]):
            slots = None if top is None else Slots(int(top), marked == "1", links)
            blocks = main_blocks(html, frame, own, slots, _numbers(steps))
            out.append("\n\n".join(b.text for b in blocks))
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": out})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Character references are decoded, white space inside a block is one
    space, blocks are joined by two line feeds. A page without main text, or
    whose html is null or empty, has an empty text. Every page is read by itself
    with its host's template, so repeated ids and rows keep their rows. An
    empty table gives an empty result. Columns besides the three named are not
    read. ``n_chars`` counts code points.
    """
    small_batches(pages.sparkSession)
    # ids travel as text: pandas would make floats of whole numbers beside nulls
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def placed(known):
        return beside(rows, known.withColumnRenamed("host", "__host"), host(F.col("url")) == F.col("__host"))

    known = templates(pages, url_col, html_col)
    # slots and marks travel as text, like ids
    joined = placed(with_slots(placed(known), known))
    return joined.select("page_id", "url", "html", "frame", "own", "steps", "links", F.col("top").cast("string").alias("top"),
                         F.col("marked").cast("int").cast("string").alias("marked")).mapInPandas(
        _extract, "page_id string, url string, text string").select(
        F.col("page_id").cast(pages.schema[id_col].dataType), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


ship(__name__)
