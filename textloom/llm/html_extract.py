"""Main text of web pages by wrappers: union-free regular expressions inferred per host."""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, workspace
from .license_scan import rising
from .url_filter import host_of

#: Attributes up to the end of a tag; quoted ones may hold any sign. A try that fails takes no step back.
TAG_END = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>", re.S)
TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][A-Za-z0-9:-]*))")
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Fixed values of HTML: elements without content, elements whose content is no markup, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LIKE = frozenset("li dt dd tr td th option".split())
#: Elements, and words of class, id and role, of what is not the article.
CHROME_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg canvas button select textarea dialog menu head title object".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer contentinfo sidebar complementary widget notice cookie cookies consent gdpr popup modal overlay dialog alert subscribe newsletter "
    "signup login search share sharing social related recommended comment comments disqus reply replies respond discussion".split()
)
MAIN_TAGS = frozenset(["article", "main"])
#: Elements whose names say what they are; only these words count on them, and none on html and body.
NAMED = frozenset("article main h1 h2 h3 h4 h5 h6".split())
NAMED_WORDS = frozenset("ad advert advertisement sponsored promo related comment comments reply replies".split())
#: In an article or main element a text is template if it comes in its slot on so many pages of different content, and on this share of
#: the pages that have the slot: a share bar or a notice of every page, and not a passage that some pages quote.
MAIN_PAGES, MAIN_SHARE = 5, 0.8
#: Forms that are aligned in one task, on average, and bytes of wrappers up to which they are broadcast.
FOLD, BROADCAST_BYTES = 64, 16 << 20


def signature(tag: str, attributes: str) -> str:
    """The tag, with the words of class, id and role that mark what is not the article."""
    if tag in CHROME_TAGS:
        return tag + "!"
    if attributes and tag not in ("html", "body"):
        found = dict(ATTRIBUTE.findall(attributes))
        words = {w.lower() for k, v in found.items() if k.lower() in ("class", "id", "role") for w in PARTS.findall(v)}
        if words & (NAMED_WORDS if tag in NAMED else CHROME_WORDS):
            return tag + "!"
    return tag


def tags(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(text, raw, "", end), (open, tag, attributes, end), (close, tag, "", end), in time that grows with the page: a "<"
    that no ">" follows is text, and once a tag has an odd quote, quotes count no more. Send a place to go on from there."""
    at, n, quotes = 0, len(page), True
    while at < n:
        m = TAG.search(page, at)
        if m is None or page.find(">", m.end()) < 0 and not m[1]:
            yield "text", page[at:], "", n
            return
        if m.start() > at:
            yield "text", page[at : m.start()], "", m.start()
        if m[1]:
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        close = TAG_END.match(page, m.end()) if quotes and m[4] else None
        quotes = quotes and (close is not None or not m[4])
        at = close.end() if close else page.find(">", m.end()) + 1
        if m[4]:
            jump = yield "close" if m[3] else "open", m[4].lower(), page[m.end() : at - 1], at
            if jump is not None:
                at = jump
                yield "", "", "", at


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """(open, signature), (close, signature), (break, tag), (text, raw). Elements that a page leaves open are
    closed where the next one or an outer end closes them; elements may be nested to any depth."""
    stack: list[tuple[str, str]] = []
    within: Counter = Counter()  # the elements of the stack by tag
    lower = None
    read = tags(page)
    for kind, tag, attributes, at in read:
        if kind == "text":
            yield "text", tag
        elif kind == "close":
            if within[tag]:
                while stack:
                    t, s = stack.pop()
                    within[t] -= 1
                    yield "close", s
                    if t == tag:
                        break
            elif tag in ("p", "br"):
                yield "break", tag
        elif tag in VOID:
            yield "break", tag
        else:
            if tag in CLOSES_P and within["p"]:
                while stack:
                    t, s = stack.pop()
                    within[t] -= 1
                    yield "close", s
                    if t == "p":
                        break
            elif tag in LIKE and stack and stack[-1][0] == tag:
                within[tag] -= 1
                yield "close", stack.pop()[1]
            if attributes.endswith("/") and tag not in RAW:
                yield "break", tag
                continue
            sig = signature(tag, attributes)
            if tag in RAW:
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at)
                yield "open", sig
                yield "text", page[at : len(page) if end < 0 else end]
                yield "close", sig
                read.send(len(page) if end < 0 else (page.find(">", end) + 1 or len(page)))
                continue
            stack.append((tag, sig))
            within[tag] += 1
            yield "open", sig
    while stack:
        yield "close", stack.pop()[1]


# A wrapper is a tree of nodes [kind, optional, children]. A kind is the signature of a block element, "#" for a slot of
# text, or "*" for a repeated group, whose children are optional, each of another kind, and come in any number.


def merged(nodes: list[list]) -> list:
    """One node from nodes of one kind: their token streams aligned level by level."""
    out = [nodes[0][0], any(x[1] for x in nodes), []]
    todo = [(out, nodes)]
    while todo:
        node, sources = todo.pop()
        level = [[x[0], x[1], [x]] for x in sources[0][2]]
        for other in sources[1:]:
            level = aligned(level, [[x[0], x[1], [x]] for x in other[2]])
        for kind, optional, parts in level:
            child = [kind, optional, []]
            node[2].append(child)
            if kind == "*":
                members: dict[str, list] = {}
                for part in parts:
                    for x in part[2] if part[0] == "*" else [part]:
                        members.setdefault(x[0], []).append(x)
                for k, own in members.items():
                    child[2].append([k, True, []])
                    todo.append((child[2][-1], own))
            elif len(parts) == 1:
                child[2] = parts[0][2]
            else:
                todo.append((child, parts))
    return out


def kinds(items: list) -> set[str]:
    return {k for kind, _, parts in items for k in ([x[0] for p in parts for x in (p[2] if p[0] == "*" else [p])] if kind == "*" else [kind])}


def aligned(a: list, b: list) -> list:
    """Two levels, lists of [kind, optional, the nodes it stands for], as one. Equal ends pair up. Where the middles differ
    and a kind comes more than once there, or also right beside it, they become a repeated group; else what both
    have, in order, pairs up and the rest is optional. Time and memory grow with the lengths alone."""
    pair = lambda x, y: [x[0], x[1] or y[1], x[2] + y[2]]
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo][0] == b[lo][0]:
        lo += 1
    while n > lo and m > lo and a[n - 1][0] == b[m - 1][0]:
        n, m = n - 1, m - 1
    head, tail = [pair(x, y) for x, y in zip(a[:lo], b[:lo], strict=True)], [pair(x, y) for x, y in zip(a[n:], b[m:], strict=True)]
    left, right = a[lo:n], b[lo:m]
    if not left and not right:
        return head
    loose = kinds(left) | kinds(right)
    repeated = any(x[0] == "*" for x in left + right) or len({x[0] for x in left}) < len(left) or len({x[0] for x in right}) < len(right)
    beside = []
    while head and kinds(head[-1:]) & loose:
        beside.insert(0, head.pop())
        loose |= kinds(beside[:1])
    while tail and kinds(tail[:1]) & loose:
        beside.append(tail.pop(0))
        loose |= kinds(beside[-1:])
    if repeated or beside:
        parts = [p for x in [*left, *right, *beside] for p in x[2]]
        return [*head, ["*", False, parts], *tail]
    place = {x[0]: j for j, x in enumerate(right)}
    both = rising([(i, place[x[0]]) for i, x in enumerate(left) if x[0] in place])
    out, i, j = [], 0, 0
    for x, y in [*both, (len(left), len(right))]:
        out += [[k, True, p] for k, _, p in left[i:x]] + [[k, True, p] for k, _, p in right[j:y]]
        if x < len(left):
            out.append(pair(left[x], right[y]))
        i, j = x + 1, y + 1
    return [*head, *out, *tail]


def written(node: list) -> str:
    """A wrapper as text: kind, ? if optional, and its children in brackets."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        out.append(x[0] + "?" * x[1])
        if x[2]:
            out.append("(")
            todo.append(")")
            todo += reversed(x[2])
    return " ".join(out)


def parsed(text: str) -> list:
    root: list = ["", False, []]
    stack = [root]
    for part in text.split(" "):
        if part == "(":
            stack.append(stack[-1][2][-1])
        elif part == ")":
            stack.pop()
        else:
            stack[-1][2].append([part.rstrip("?"), part.endswith("?"), []])
    return root[2][0]


class Walk:
    """Follows a page through a wrapper: every text of the page gets the number of its slot, or none if the wrapper has no
    place for it. At each level a cursor moves on to the next node of the kind that the page has."""

    def __init__(self, wrapper: list):
        self.numbers: dict[int, int] = {}
        self.places: dict[int, dict[str, list[int]]] = {}
        todo, order = [wrapper], 0
        while todo:  # in order, so that a wrapper numbers its slots always alike
            node = todo.pop()
            self.numbers[id(node)] = order
            order += 1
            todo += reversed(node[2])
            at: dict[str, list[int]] = {}
            for i, child in enumerate(node[2]):
                for kind in [x[0] for x in child[2]] if child[0] == "*" else [child[0]]:
                    at.setdefault(kind, []).append(i)
            self.places[id(node)] = at
        self.wrapper = wrapper
        self.restart()

    def restart(self) -> None:
        self.stack: list[list] = [[self.wrapper, 0]]  # node, cursor

    def step(self, kind: str) -> list | None:
        """The wrapper's node for the page's next child of this kind."""
        here = self.stack[-1]
        node, cursor = here
        if node is None:
            return None
        found = self.places[id(node)].get(kind, ())
        k = bisect_left(found, cursor)
        if k == len(found):
            return None
        child = node[2][found[k]]
        if child[0] == "*":
            here[1] = found[k]
            return next(x for x in child[2] if x[0] == kind)
        here[1] = found[k] + 1
        return child

    def open(self, kind: str) -> None:
        self.stack.append([self.step(kind), 0])

    def close(self) -> None:
        self.stack.pop()

    def text(self) -> int | None:
        """The slot of a block of text."""
        found = self.step("#")
        return None if found is None else self.numbers[id(found)]


def content(texts: list[str]) -> int:
    """A hash of the longest of a page's texts that are together more than half of it: pages that differ in less
    are copies of one."""
    texts = sorted(set(texts), key=lambda t: (-len(t), t))
    half, size, main = sum(map(len, texts)) / 2, 0, hashlib.blake2b(digest_size=8)
    for text in texts:
        main.update(f"{len(text)}\n{text}".encode())
        size += len(text)
        if size > half:
            break
    return int.from_bytes(main.digest(), "little", signed=True)


def block_texts(page: str) -> Iterator[tuple[str, str, bool]]:
    """(open, signature, _), (close, "", _) of block elements and of those that are not the article, and (text, raw, in an
    article or main element) of the blocks between. Inline elements and their ends are part of the text; what is not
    the article (CHROME) is left out, with all it holds."""
    held, chrome, main = [], 0, 0
    for kind, value in tokens(page):
        if kind == "text":
            if not chrome:
                held.append(value)
            continue
        other = value.endswith("!")
        if not other and value in INLINE:
            continue
        if held:
            yield "text", "".join(held), main > 0
            held = []
        if kind == "open":
            if not chrome:
                yield "open", value, main > 0
            chrome += other
            main += value in MAIN_TAGS
        elif kind == "close":
            chrome -= other
            main -= value in MAIN_TAGS
            if not chrome:
                yield "close", value, main > 0
    if held:
        yield "text", "".join(held), False


def clean(raw: str) -> str:
    return " ".join(entities.unescape(raw).split())


def form(page: str) -> tuple[list, list[int], int, bool]:
    """A page as a wrapper of its own; a hash of each of its texts, in order, or 0 where the page has an article or main element
    and the text is outside; its content; and whether it has such an element."""
    root: list = ["", False, []]
    stack, texts, main = [root], [], False
    for kind, value, inside in block_texts(page):
        if kind == "open":
            stack.append(["!" if value.endswith("!") else value, False, []])
            stack[-2][2].append(stack[-1])
            main = main or value in MAIN_TAGS
        elif kind == "close":
            stack.pop()
        elif text := clean(value):
            stack[-1][2].append(["#", False, []])
            texts.append((text, inside))
    own = [t for t, inside in texts if inside or not main]
    return root, [text_hash(t) if inside or not main else 0 for t, inside in texts], content(own), main


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True) or 1


def blocks(page: str, walk: Walk | None, template: frozenset) -> Iterator[str]:
    """The blocks of a page's article: what is in its article or main element, if it has one, else all. The wrapper of the host
    decides what of it is template: a text that is part of the template in the slot that the wrapper gives it is left out,
    and all else is kept, also text that the wrapper has no place for."""
    has_main, found = False, []
    if walk:
        walk.restart()
    for kind, value, main in block_texts(page):
        if kind == "open":
            if value in MAIN_TAGS and not has_main:
                has_main, found = True, []
            if walk:
                walk.open("!" if value.endswith("!") else value)
        elif kind == "close":
            if walk:
                walk.close()
        elif text := clean(value):
            slot = walk.text() if walk else None
            if (main or not has_main) and (slot, text_hash(text) if walk else 0, has_main) not in template:
                found.append(text)
    yield from found


def slotted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, content, main, slot, text) of the texts of forms with the wrapper of their host."""
    walks: dict[str, Walk] = {}
    for frame in frames:
        out = []
        for host, own, loose, what, main, wrapper in zip(frame["host"], frame["form"], frame["loose"], frame["content"], frame["main"], frame["wrapper"], strict=True):
            walk = followed(walks, wrapper)
            left, todo = iter(loose), [parsed(own)[2]]
            steps = [iter(todo[0])]
            walk.restart()
            while steps:
                node = next(steps[-1], None)
                if node is None:
                    steps.pop()
                    if steps:
                        walk.close()
                elif node[0] == "#":
                    slot, text = walk.text(), next(left)
                    if slot is not None and text:
                        out.append((host, what, main, slot, text))
                else:
                    walk.open(node[0])
                    steps.append(iter(node[2]))
        yield pd.DataFrame(out, columns=["host", "content", "main", "slot", "text"])


#: Wrappers that a worker keeps parsed before it starts anew: a bound on its memory, not on input.
KEPT_WRAPPERS = 256


def followed(walks: dict[str, Walk], wrapper: str) -> Walk:
    if wrapper not in walks:
        if len(walks) >= KEPT_WRAPPERS:
            walks.clear()
        walks[wrapper] = Walk(parsed(wrapper))
    return walks[wrapper]


def forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        made = [form(h or "") for h in frame["html"]]
        yield pd.DataFrame({"host": frame["host"], "form": [written(f) for f, _, _, _ in made], "loose": [x for _, x, _, _ in made], "content": [c for _, _, c, _ in made], "main": [m for _, _, _, m in made]})


def infer(frame: pd.DataFrame) -> pd.DataFrame:
    """Forms of a host, longest first, aligned into one."""
    rows = sorted(frame["form"], key=lambda x: (-len(x), x))
    wrapper = merged([parsed(row) for row in rows])
    return pd.DataFrame({"host": frame["host"].iloc[:1], "form": [written(wrapper)]})


def folded(forms: DataFrame, fold: int = FOLD) -> DataFrame:
    """The wrapper of each host from its distinct forms (host, form): groups of some `fold` forms are aligned, then
    what they give in the same way, until a host has one."""
    while True:
        sized = cut(forms.groupBy("host").agg(F.ceil(F.count("*") / F.lit(float(fold))).alias("parts")))
        salted = forms.join(small(sized), "host").withColumn("part", F.pmod(F.xxhash64("form"), F.col("parts")))
        forms = cut(salted.groupBy("host", "part").applyInPandas(infer, "host string, form string").distinct())
        if sized.where("parts > 1").isEmpty():
            return forms


def extracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    walks: dict[str, Walk] = {}
    for frame in frames:
        texts = []
        for page, wrapper, template in zip(frame["html"], frame["wrapper"], frame["template"], strict=True):
            known = frozenset() if template is None else frozenset((x["slot"], x["text"], x["main"]) for x in template)
            texts.append("\n".join(blocks(page or "", followed(walks, wrapper) if known else None, known)))
        yield pd.DataFrame({"key": frame["key"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of pages: key, url, text (the article), n_chars.

    Every page is reduced to the form of its token stream: its block elements, with slots for text. The distinct forms
    of a host are aligned into its wrapper, a union-free expression: mismatches become optional parts or repeated
    groups; a fixed number of forms is aligned in a task, then the results in the same way. A page's article or main
    element, or the whole page if it has none, holds its text, and the wrapper decides what of it is template: texts get
    the wrapper's slots, and a text that comes in the same slot on two pages of different content and on at least half of
    the pages with that slot is left out; in an article or main element it has to come on MAIN_PAGES pages and MAIN_SHARE of
    them. Pages that share more than half of their text count as one. A slot's template texts are at most twice as many as a
    page of the host has there on average, so a host's row in the table of templates is of a page's size.

    Elements that their names mark as navigation, adverts, forms, notices or comments are not the article. Character
    references are decoded, white space in a block is one space, blocks are joined by a line feed; nothing else is
    dropped or capped, at any depth or length.

    Null and empty html have an empty text; a null url has the empty host. Repeated rows are extracted
    each. No rows give no rows. Other columns, whatever their names, are ignored.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    with workspace(pages.sparkSession) as keep:
        made = cut(rows.select("host", "html").mapInPandas(forms, "host string, form string, loose array<long>, content long, main boolean"))
        wrappers = folded(cut(made.select("host", "form").distinct())).select(F.col("host").alias("h"), F.col("form").alias("wrapper"))
        loose = made.where(F.size("loose") > 0).distinct()
        slots = loose.join(small(wrappers), F.col("host") == F.col("h")).select("host", "form", "loose", "content", "main", "wrapper")
        seen = cut(slots.mapInPandas(slotted, "host string, content long, main boolean, slot int, text long").distinct())
        sizes = seen.select("host", "main", "slot", "content").distinct().groupBy("host", "main", "slot").agg(F.count("*").alias("n"))
        enough = F.when(F.col("main"), (F.col("k") >= MAIN_PAGES) & (F.col("k") >= MAIN_SHARE * F.col("n"))).otherwise((F.col("k") >= 2) & (2 * F.col("k") >= F.col("n")))
        common = seen.groupBy("host", "main", "slot", "text").agg(F.count("*").alias("k")).where("k >= 2").join(sizes, ["host", "main", "slot"]).where(enough)
        common = common.groupBy(F.col("host").alias("th")).agg(F.collect_list(F.struct("slot", "text", "main")).alias("template"))
        known = keep(cut(wrappers.join(common, F.col("h") == F.col("th"), "left").select("h", F.when(F.col("template").isNotNull(), F.col("wrapper")).alias("wrapper"), "template")))
    joined = rows.join(small(known, BROADCAST_BYTES), F.col("host") == F.col("h")).select("key", "url", "html", "wrapper", "template")
    kind = pages.schema[key].dataType.simpleString()
    return joined.mapInPandas(extracted, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key).withColumnRenamed("url", url)


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
