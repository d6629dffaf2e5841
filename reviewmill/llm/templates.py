"""Main text of pages by deduced templates.

Tokens are tags with their path of open elements and text nodes with theirs.  A
token's occurrence vector says how often it stands in each page of its host; it
is kept as a sum of hashes of page and count, so equal sums are equal vectors and
no host's pages have to meet in one task.  Tokens with equal vectors form a
class; a class is valid if it is frequent, has several tokens and hangs below a
valid class.  The valid classes of a host, nested by their paths, are its
template.  What is not template are its slots; the text of slots under a menu,
header, footer, sidebar, notice, advert, form or comments is left out, and where
a page has an article or main element only slots under it count.

Text inside such an element is template too where its class is valid and stands in
``LEAST_ARTICLES`` distinct pages at least (author boxes, follow-us lines).  A page
whose article would lose more than half of its text that way is a copy of others
rather than an article with such parts, and keeps it whole.

Hosts with fewer than ``LEAST_PAGES`` pages share one template.

Edge cases: null or empty html gives an empty text; a null url is an unknown
host of its own group; null page ids stay null; repeated rows are pages of their
own; unclosed and stray tags are closed as browsers do for paragraphs and list
items, else ignored; an empty table gives no rows; other columns are ignored;
pages are used whole.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

LEAST_PAGES, SUPPORT, LEAST_TOKENS = 4, 0.6, 2
#: Distinct pages that must hold a text inside an article before it can be template.
LEAST_ARTICLES = 12
#: A template table of up to so many bytes is sent to every executor, a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20

#: What HTML elements and their usual names stand for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var".split())
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select option textarea button "
                   "datalist dialog".split())
OUTSIDE = frozenset("nav header footer aside form menu".split())
CONTENT = frozenset("article main".split())
RAW = r"script|style|textarea|title|noscript|iframe|template"
_OUTSIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|topbar|footer|sidebar|side-?bar|aside|widget|"
    r"related|recommended|notice|notices|cookies?|consent|gdpr|alert|banner|popup|modal|newsletter|subscribe|signup|ads?|adverts?|"
    r"advertisement|advertising|sponsored|sponsor|promo|promotion|comments?|commentlist|disqus|respond|replies|discussion|share|"
    r"sharing|social|pagination|pager|form|search|skip|toolbar|login|copyright)(?:$|[\s_\d-])", re.I)
#: Names of a page's layout that mention such a part without being one.
_LAYOUT_NAME = re.compile(r"\b(?:has|with|without|no)[-_][\w-]+", re.I)
_OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_CONTENT_NAME = re.compile(r"(?:^|\s)(?:articleBody|article-body|article-content|post-content|entry-content|main-content)(?:$|\s)")

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?P<rawattrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(?P<rawtext>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_DIGITS = re.compile(r"\d")
_CLOSED_BY = {"p": INLINE, "li": frozenset(("ul", "ol", "menu")), "dd": frozenset(("dl",)), "dt": frozenset(("dl",)),
              "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "tr": frozenset(("table", "tbody", "thead")),
              "option": frozenset(("select",))}


class Node:
    """An open element: its path's hash, whether it stands outside the article or inside an explicit one."""

    __slots__ = ("tag", "path", "outside", "content")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        names = marks = ""
        outside = tag in OUTSIDE or tag in HIDDEN
        content = tag in CONTENT
        if attributes and not attributes.isspace():
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), values[0] or values[1] or values[2]
                if name in ("class", "id"):
                    names += " " + value
                    # Ids with digits are mostly numbered, so they tell pages apart rather than places.
                    marks += " " + value if name == "class" or not _DIGITS.search(value) else ""
                elif name == "role":
                    outside |= value.lower() in _OUTSIDE_ROLES
                    content |= value.lower() == "main"
                elif name == "itemprop":
                    content |= value == "articleBody"
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                    outside = True
            if names and tag not in ("html", "body", "article", "main"):
                outside |= bool(_OUTSIDE_NAME.search(_LAYOUT_NAME.sub("", names)))
                content |= bool(_CONTENT_NAME.search(names))
        self.tag = tag
        # Tag tokens are even, text tokens odd.
        self.path = xxhash.xxh64_intdigest(f"{tag}.{marks}", seed=parent.path if parent else 0) >> 2 << 1
        self.outside = outside or (parent.outside if parent else False)
        self.content = (content or (parent.content if parent else False)) and not self.outside


Text = tuple[str, int, bool, bool, int]


def parse(page: str) -> tuple[Counter, dict[int, int], list[Text]]:
    """Counts of the tag tokens, each one's parent, and the text nodes: text, path, outside, in an article, block number."""
    root = Node("#page", "", None)
    stack, tags, parents, texts, block = [root], Counter(), {}, [], 0
    for found in _TOKEN.finditer(page):
        piece = found["text"]
        if piece is not None:
            if not piece.isspace():
                top = stack[-1]
                texts.append((piece, top.path, top.outside, top.content, block))
            elif texts and texts[-1][4] == block:
                texts.append((" ", stack[-1].path, stack[-1].outside, stack[-1].content, block))
            continue
        tag = found["tag"]
        if tag is None:
            if found["raw"]:
                node = Node(found["raw"].lower(), found["rawattrs"], stack[-1])
                tags[node.path] += 1
                parents[node.path] = stack[-1].path
            continue
        tag = tag.lower()
        if tag == "br":
            texts.append((" ", stack[-1].path, stack[-1].outside, stack[-1].content, block))
            continue
        if tag in VOID:
            block += tag == "hr"
            continue
        inline = tag in INLINE
        if found["close"]:
            if not inline:
                block += 1
            # Inline elements are only on the stack where they are left out.
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if inline and stack[depth].tag not in INLINE:
                    break
            continue
        if inline:
            node = Node(tag, found["attrs"], stack[-1])
            if node.outside and not stack[-1].outside and not found["attrs"].endswith("/"):
                stack.append(node)
            continue
        block += 1
        while stack[-1].tag in INLINE or stack[-1].tag == "p":
            stack.pop()
        if tag in _CLOSED_BY:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in _CLOSED_BY[tag] or stack[depth].tag in CONTENT or stack[depth].tag == "div":
                    break
        node = Node(tag, found["attrs"], stack[-1])
        tags[node.path] += 1
        parents[node.path] = stack[-1].path
        if not found["attrs"].endswith("/") or tag in ("p", "div"):
            stack.append(node)
    return tags, parents, texts


def text_token(text: str, path: int) -> int:
    return xxhash.xxh64_intdigest(" ".join(text.split()), seed=path) >> 2 << 1 | 1


def page_tokens(page: str) -> list[tuple[int, int, int, bool]]:
    """The tokens of a page: token, the token it hangs below, how often, whether it is text in an article."""
    tags, parents, texts = parse(page)
    rows = [(token, parents[token], count, False) for token, count in tags.items()]
    words = Counter((text_token(text, path), path, content) for text, path, outside, content, _ in texts if text != " ")
    return rows + [(token, path, count, content) for (token, path, content), count in words.items()]


def main_text(page: str, template: frozenset[int]) -> str:
    """The text of the page's content slots, block by block."""
    _, _, texts = parse(page)
    slots = [(text, content, block, text != " " and text_token(text, path) in template)
             for text, path, outside, content, block in texts if not outside]
    article = [(len(text), held) for text, content, _, held in slots if content and text != " "]
    if article:
        whole = 2 * sum(size for size, held in article if held) > sum(size for size, _ in article)
        slots = [slot for slot in slots if slot[1] and (whole or not slot[3])]
    else:
        slots = [slot for slot in slots if not slot[3]]
    blocks: dict[int, list[str]] = {}
    for text, _, block, _ in slots:
        blocks.setdefault(block, []).append(text)
    lines = (" ".join(markup.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(line for line in lines if line)


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def host_templates(pages: DataFrame) -> DataFrame:
    """``host, template``: the tokens of the valid classes of every host's pages."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256)
                out: tuple[list, ...] = ([], [], [], [], [])
                for host, page in zip(rows.column("host").to_pylist(), rows.column("html").to_pylist()):
                    page = page or ""
                    name = xxhash.xxh64_intdigest(page)
                    mark = 1 << (name >> 32 & 63)
                    mark -= (mark >> 63) << 64
                    for token, parent, count, content in page_tokens(page):
                        part = xxhash.xxh32_intdigest(f"{name}:{count}")
                        # -1 has all bits: other tokens need no number of distinct pages.
                        for column, value in zip(out, (host, token, parent, part, mark if content else -1)):
                            column.append(value)
                yield pa.RecordBatch.from_pydict({
                    "host": pa.array(out[0], pa.string()), **{name: pa.array(column, pa.int64()) for name, column in
                                                             zip(("token", "parent", "part", "mark"), out[1:])}})

    sized = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # Pages without a host are one site of their own, apart from the small hosts that share one.
    sized = sized.withColumn("site", F.when(F.col("pages") >= LEAST_PAGES, F.concat(F.lit("host:"), "host")).otherwise("shared"))
    sized = stored(sized, "hosts")
    sums = pages.select("host", "html").mapInArrow(tokens, "host string, token bigint, parent bigint, part bigint, mark bigint") \
        .groupBy("host", "token", "parent").agg(
        F.sum("part").alias("vector"), F.count(F.lit(1)).alias("support"), F.bit_or("mark").alias("marks"))
    by_site = sums.join(sized, "host").groupBy("site", "token", "parent").agg(
        F.sum("vector").alias("vector"), F.sum("support").alias("support"), F.bit_or("marks").alias("marks"))
    totals = sized.groupBy("site").agg(F.sum("pages").alias("total"))
    # At most the tokens of an average page divided by SUPPORT are left of a site.
    # A page sets one of 64 marks, copies the same one: so many marks are at least so many distinct pages.
    frequent = by_site.where((F.col("support") >= 2) & (F.bit_count("marks") >= LEAST_ARTICLES)).join(totals, "site").where(F.col("support") >= SUPPORT * F.col("total"))

    def nest(group: pd.DataFrame) -> pd.DataFrame:
        """Keep classes of several tokens, from the page's root down, whose tokens hang below tokens that are kept."""
        # An element's token stands for its two tags.
        weights = 2 - group["token"] % 2
        large = group[weights.groupby(group["vector"]).transform("sum") >= LEAST_TOKENS]
        below = dict(zip(large["token"], large["parent"]))
        root = Node("#page", "", None).path
        valid = {root}
        grown = True
        while grown:
            fresh = {token for token, parent in below.items() if parent in valid and token not in valid}
            valid |= fresh
            grown = bool(fresh)
        return pd.DataFrame({"site": [group["site"].iloc[0]], "template": [sorted(valid)]})

    templates = frequent.select("site", "token", "parent", "vector").groupBy("site").applyInPandas(
        nest, "site string, template array<bigint>")
    return sized.join(templates, "site").select("host", "template")


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    templates = stored(host_templates(rows), "templates")
    size = templates.agg(F.sum(F.length("host") + 8 * F.size("template")).alias("bytes")).first()["bytes"] or 0
    if size <= BROADCAST_BYTES:
        templates = F.broadcast(templates)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [main_text(page or "", frozenset(template or ())) for page, template in
                         zip(part.column("html").to_pylist(), part.column("template").to_pylist())]
                yield pa.RecordBatch.from_pydict({
                    "page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(text) for text in texts], pa.int64())})

    return rows.join(templates, "host", "left").select("page_id", "url", "html", "template").mapInArrow(
        extract, "page_id bigint, url string, text string, n_chars bigint")
