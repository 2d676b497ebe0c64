"""Main text of web pages: subtrees that recur over a site are its template and go."""

from __future__ import annotations

import hashlib
import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch, freed, ready
from cohortry.llm.url_filters import url_host

# A subtree belongs to the template of a host from so many pages on, however many the host has.
TEMPLATE_PAGES = 5
# Template rows that are broadcast at most; more are joined with the hashes of the pages.
BROADCAST_ROWS = 200_000

# Elements of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup td th time tt u var wbr".split())
NEVER = frozenset(
    "head script style noscript iframe template form nav footer aside button select textarea dialog svg canvas object menu "
    "title input".split())
LANDMARKS = frozenset(["article", "main"])
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split())
SAME_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
               "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
# Elements that words of their own never remove.
KEPT = frozenset(["html", "body", "main"])
# Words in class, id or role that name a part which is no article text, as a whole name or its first or last word.
CLUTTER = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices "
    "popup promo promotion related replies search share sharing sidebar signup social sponsor sponsored subscribe "
    "widget".split())

# Words before or after them which say that a name is about the layout around the part.
LAYOUT = frozenset("has have is no non not with without show hide hidden free less off closed".split())

_OPEN = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|!--|[!?/])")
# Quotes hold an attribute's value only behind its equals sign.
_CLOSE = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


def names_clutter(value: str) -> bool:
    """Whether one of the names in an attribute is, begins with or ends with a word of CLUTTER, and none of its words is of LAYOUT."""
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and (words[0] in CLUTTER or words[-1] in CLUTTER) and not LAYOUT.intersection(words):
            return True
    return False


class Node:
    """An element: its tag, whether it is clutter by itself or by its names, and its parts (texts and elements) in order."""

    __slots__ = ("tag", "mark", "clutter", "named", "parts")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.parts, self.mark, self.clutter, self.named = tag, [], "", tag in NEVER, False
        if attributes and not attributes.isspace():
            marks = []
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), next((v for v in values if v), "")
                if name in ("class", "id", "role"):
                    marks.append(value)
                    self.named |= tag not in KEPT and names_clutter(value)
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    self.clutter = True
                elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    self.clutter = True
            self.mark = " ".join(marks)


def _tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where the tag that is open at ``at`` ends (its ``>``), or -1; ``unclosed`` remembers quotes that never come again."""
    while True:
        found = _CLOSE.search(page, at)
        if found is None:
            return -1
        if found[1] is None:
            return found.start()
        at = found.end()
        if found[1] not in unclosed:
            end = page.find(found[1], at)
            if end < 0:
                unclosed.add(found[1])
            else:
                at = end + 1


class _Open:
    """The elements open at a place, innermost last."""

    def __init__(self, root: Node):
        self.nodes, self.counts = [root], {}
        # For every open element the place of the innermost one, itself included, that is not inline.
        self.block = [0]

    def push(self, node: Node) -> None:
        self.block.append(self.block[-1] if node.tag in INLINE else len(self.nodes))
        self.nodes.append(node)
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1

    def cut(self, place: int) -> None:
        for node in self.nodes[place:]:
            self.counts[node.tag] -= 1
        del self.nodes[place:], self.block[place:]

    def close(self, tags, until=()) -> None:
        """Close the innermost element of ``tags``, unless one of ``until`` is further in."""
        if any(self.counts.get(tag) for tag in tags):
            for place in range(len(self.nodes) - 1, 0, -1):
                if self.nodes[place].tag in until:
                    return
                if self.nodes[place].tag in tags:
                    return self.cut(place)

    def close_paragraph(self) -> None:
        if self.nodes[self.block[-1]].tag == "p":
            self.cut(self.block[-1])


def parse(page: str) -> Node:
    """The element tree of a page, however broken: unclosed elements end with their parents, stray end tags count for nothing.

    One pass over the page; a tag that never ends, and all after it, is text.
    """
    root = Node("#root")
    tree, at, unclosed = _Open(root), 0, set()
    while True:
        tag = _OPEN.search(page, at)
        end = -1 if tag is None else _tag_end(page, tag.end(), unclosed) if tag[2] is not None else tag.end()
        if end < 0:
            tree.nodes[-1].parts.append(page[at:])
            return root
        if tag.start() > at:
            tree.nodes[-1].parts.append(page[at:tag.start()])
        if tag[2] is None:
            end = page.find("-->" if tag[0] == "<!--" else ">", end)
            at = len(page) if end < 0 else end + (3 if tag[0] == "<!--" else 1)
            continue
        at = end + 1
        name = tag[2].lower()
        if tag[1]:
            tree.close([name])
            continue
        if name in CLOSES_PARAGRAPH:
            tree.close_paragraph()
        elif name in SAME_CLOSES:
            closes, until = (x.split() for x in SAME_CLOSES[name])
            tree.close(closes, until)
        node = Node(name, page[tag.end():end])
        tree.nodes[-1].parts.append(node)
        if name in VOID:
            continue
        if name in RAW:
            last = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            end = -1 if last is None else page.find(">", last.end())
            at = len(page) if end < 0 else end + 1
            continue
        tree.push(node)


def _walk(root: Node, enter=None, leave=None, text=None) -> None:
    """Go through a tree in page order, however deep: ``enter(node)`` may answer False to pass by what is inside."""
    stack = [(root, iter(root.parts))]
    while stack:
        node, parts = stack[-1]
        for part in parts:
            if isinstance(part, str):
                if text is not None:
                    text(part)
            elif enter is None or enter(part) is not False:
                stack.append((part, iter(part.parts)))
                break
        else:
            stack.pop()
            if leave is not None and node is not root:
                leave(node)


def _plain(text: str) -> str:
    return " ".join(references.unescape(text).split())


def subtree_hashes(root: Node) -> dict[int, tuple[int, bool]]:
    """A 64-bit hash of tag, marks, text and inner subtrees, per element that could be template (by identity).

    The flag says whether the element is a list or such container whose text is
    mostly links. Inside article or main only those count: paragraphs of copied
    articles recur too, and are no template.
    """
    found: dict[int, tuple[int, bool]] = {}
    # Of every open element: its digest so far, the size of its text, how much of it is links, whether it is in a landmark.
    frames = [[hashlib.blake2b(digest_size=8), 0, 0, False]]

    def enter(node: Node) -> None:
        mark = f"{node.tag}|{node.mark}".encode("utf-8", "surrogatepass")
        frames.append([hashlib.blake2b(mark, digest_size=8), 0, 0, frames[-1][3] or node.tag in LANDMARKS])

    def text(part: str) -> None:
        plain = _plain(part)
        frames[-1][1] += len(plain)
        frames[-1][0].update(plain.encode("utf-8", "surrogatepass"))

    def leave(node: Node) -> None:
        digest, size, linked, landmark = frames.pop()
        if node.tag == "a":
            linked = size
        code = digest.digest()
        if size and node.tag not in INLINE and node.tag not in LANDMARKS and node.tag not in ("html", "body"):
            links = linked * 2 > size and node.tag not in ("p", "pre", "blockquote", "table") and node.tag[0] != "h"
            if links or not landmark:
                found[id(node)] = int.from_bytes(code, "little", signed=True), links
        above = frames[-1]
        above[0].update(code)
        above[1] += size
        above[2] += linked

    _walk(root, enter, leave, text)
    return found


def _around_article(root: Node) -> set[int]:
    """The largest main or article that is in no clutter by itself, and the elements around it, by identity: names never remove them."""
    sizes, above = [0], {}
    path: list[Node] = [root]
    best, largest = 0, None

    def enter(node: Node) -> bool | None:
        if node.clutter:
            return False
        above[id(node)] = id(path[-1])
        path.append(node)
        sizes.append(0)

    def text(part: str) -> None:
        sizes[-1] += len(_plain(part))

    def leave(node: Node) -> None:
        nonlocal best, largest
        path.pop()
        size = sizes.pop()
        sizes[-1] += size
        if node.tag in LANDMARKS and size > best:
            best, largest = size, id(node)

    _walk(root, enter, leave, text)
    held = set()
    while largest in above:
        held.add(largest)
        largest = above[largest]
    return held


def extract(page: str, template: frozenset[int]) -> str:
    """Blocks of text, one a line, of what is left of the page.

    Where the page has article or main elements outside clutter, only these
    count, else the whole body. Headers outside of them go too. If recurrence
    takes all text of a page, its article is one of several copies: then only
    lists of links go by recurrence.
    """
    root = parse(page)
    hashes = subtree_hashes(root) if template else {}
    held = _around_article(root)
    gone = {node: links for node, (code, links) in hashes.items() if code in template}
    text = _blocks(root, held, gone.keys())
    if not text and gone:
        text = _blocks(root, held, {node for node, links in gone.items() if links})
    return text


def _blocks(root: Node, held: set[int], gone) -> str:
    """The text of a page without clutter and the elements of ``gone``."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        plain = _plain("".join(line))
        line.clear()
        if plain:
            blocks.append(plain)

    def skipped(node: Node) -> bool:
        return node.clutter or node.named and id(node) not in held or id(node) in gone

    focused = False

    def look(node: Node) -> bool | None:
        nonlocal focused
        if focused or skipped(node):
            return False
        focused = node.tag in LANDMARKS

    _walk(root, look)
    inside = [not focused]

    def enter(node: Node) -> bool | None:
        if skipped(node) or node.tag == "header" and not (inside[-1] and focused):
            return False
        if node.tag in INLINE:
            if node.tag in ("br", "td", "th"):
                line.append(" ")
            inside.append(inside[-1])
        else:
            flush()
            inside.append(inside[-1] or node.tag in LANDMARKS)

    def leave(node: Node) -> None:
        inside.pop()
        if node.tag not in INLINE:
            flush()

    def text(part: str) -> None:
        if inside[-1]:
            line.append(part)

    _walk(root, enter, leave, text)
    flush()
    return "\n".join(blocks)


def _codes(page: str) -> set[int]:
    return {code for code, _ in subtree_hashes(parse(page)).values()}


def _page_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column(1).to_pylist()
        codes = [sorted(_codes(page or "")) for page in pages]
        content = [hashlib.blake2b((page or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for page in pages]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], names=["host", "content", "codes"])


def site_templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, code)``: the hashes of subtrees that recur over the pages of a host, one a row.

    Pages of a host with equal content count once, and each a subtree once. Only
    hashes are shuffled, and counts are summed before they are, so a host with a
    third of all pages is no hot key.
    """
    ready(pages.sparkSession)
    seen = pages.select(F.coalesce(url_host(F.col(url)), F.lit("")).alias("host"), F.col(html))
    subtrees = seen.mapInArrow(freed(_page_subtrees), "host string, content binary, codes array<long>")
    distinct = subtrees.groupBy("host", "content").agg(F.first("codes").alias("codes"))
    counts = distinct.select("host", F.explode("codes").alias("code")).groupBy("host", "code").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= TEMPLATE_PAGES).select("host", "code")


def _keyed_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, keys, codes = [], [], []
        for host, key, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
            some = _codes(page)
            hosts += [host] * len(some)
            keys += [key] * len(some)
            codes += some
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.string()), pa.array(codes, pa.int64())],
                                         names=["host", "key", "code"])


def _page_templates(keyed: DataFrame, known: DataFrame, html: str) -> DataFrame:
    """``(host, key, template)``: per host and content of a page, those of its own subtrees that are template."""
    own = keyed.where(F.col("_key").isNotNull()).select("_host", "_key", html).mapInArrow(_keyed_subtrees, "host string, key string, code long")
    return own.join(known, ["host", "code"]).groupBy("host", "key").agg(F.collect_set("code").alias("template"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of the whole page, empty where there is none or html is null.

    Character references are decoded, white space inside a block is one space,
    blocks stand in page order on lines of their own. Pages without a host share
    one template. Repeated pages all stay. An own column ``text`` is replaced.
    """
    ready(pages.sparkSession)
    known = Scratch(pages.sparkSession).store(site_templates(pages, url, html))
    kept = [c for c in pages.columns if c != "text"]
    keyed = pages.select(*kept, F.coalesce(url_host(F.col(url)), F.lit("")).alias("_host"))
    if known.count() <= BROADCAST_ROWS:
        per_host: dict[str, list[int]] = {}
        for r in known.collect():
            per_host.setdefault(r["host"], []).append(r["code"])
        shared = pages.sparkSession.sparkContext.broadcast(per_host)

        def texts_here(column: pa.Array, hosts: pa.Array) -> pa.Array:
            sets: dict[str, frozenset] = {}
            out = []
            for page, host in zip(column.to_pylist(), hosts.to_pylist()):
                if host not in sets:
                    sets[host] = frozenset(shared.value.get(host, ()))
                out.append(extract(page or "", sets[host]))
            return pa.array(out, pa.string())

        texts_here.__annotations__ = {"column": pa.Array, "hosts": pa.Array, "return": pa.Array}
        return keyed.select(*kept, F.arrow_udf(texts_here, "string")(F.col(html), "_host").alias("text"))
    keyed = keyed.withColumn("_key", F.md5(F.col(html).cast("binary")))
    own = _page_templates(keyed, known, html).select(F.col("host").alias("_host"), F.col("key").alias("_key"), F.col("template").alias("_template"))
    joined = keyed.join(own, ["_host", "_key"], "left")

    def texts(column: pa.Array, templates: pa.Array) -> pa.Array:
        return pa.array([extract(page or "", frozenset(template or ())) for page, template in zip(column.to_pylist(), templates.to_pylist())],
                        pa.string())

    texts.__annotations__ = {"column": pa.Array, "templates": pa.Array, "return": pa.Array}
    return joined.select(*kept, F.arrow_udf(texts, "string")(F.col(html), "_template").alias("text"))
