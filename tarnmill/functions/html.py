"""Pages to blocks, links and features: a small tree of one page's tags, read inside Arrow batches.

The tree is lenient: a closing tag closes up to its nearest open match, and unclosed tags hold what follows, so the text
of nested blocks repeats.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.functions import scoring, urls
from tarnmill.functions.batches import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags and name hints of page furniture, content and tables of contents (fixed values).
NOISE_TAGS = frozenset("script style noscript svg header footer nav aside form iframe".split())
NOISE = re.compile(r"breadcrumb|pankuzu|topicpath|sidebar|side|sidemenu|localnav|globalnav|gnav|subnav|related|relation|share|sns|pagetop|search|utility|tool|header|footer|pickup|ranking|banner|bnr|advert|ad-|ad_|menu|navi|navigation", re.I)
CONTENT = re.compile(r"main|content|contents|article|entry|post|pagebody|section|honbun|detail|wrapper", re.I)
CONTENTS_LIST = re.compile(r"目次|contents|index|ページ内リンク|このページ", re.I)
HEADINGS = frozenset(("h1", "h2", "h3", "h4"))
BLOCKS = HEADINGS | frozenset(("p", "li", "dd", "dt", "td", "th"))


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, names) -> list[Node]:
        return [n for n in self.walk() if n.name in names]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                if s := c.strip():
                    out.append(s)
            else:
                stack += reversed(c.children)
        return re.sub(r"\s+", " ", " ".join(out)).strip()

    def links(self) -> list[Node]:
        return [a for a in self.find({"a"}) if "href" in a.attrs]

    def hint(self) -> str:
        return " ".join(self.attrs.get(k) or "" for k in ("class", "id", "aria-label")).strip()

    def remove(self) -> None:
        if self.parent and self in self.parent.children:
            self.parent.children.remove(self)


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.name != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def without_noise(root: Node) -> None:
    for node in list(root.walk()):
        if node.name in NOISE_TAGS or NOISE.search(node.hint()):
            node.remove()


def weight(node: Node) -> float:
    text = node.text()
    if not text:
        return 0.0
    links = len(node.links())
    longer = sum(len(n.text()) >= 30 for n in node.find({"p", "li", "dd", "dt"}))
    return len(text) + 180.0 * longer + 120.0 * len(node.find(HEADINGS)) - 20.0 * links - 5000.0 * links / len(text)


def main_node(root: Node) -> Node:
    nodes = list(root.walk())
    first = [next((n for n in nodes if test(n)), None) for test in (lambda n: n.name == "main", lambda n: n.name == "article", lambda n: n.attrs.get("role") == "main")]
    hinted = [n for n in nodes if n.name in {"div", "section", "article", "main"} and CONTENT.search(n.hint())]
    body = next((n for n in nodes if n.name == "body"), None)
    found = list(dict.fromkeys(n for n in [*first, *hinted, body] if n))
    return max(found, key=weight) if found else root


def without_contents_lists(node: Node) -> None:
    for n in node.find({"ul", "ol", "div", "section", "nav"}):
        text, links = n.text(), len(n.links())
        if text and ((CONTENTS_LIST.search(n.hint()) and links >= 3) or (links >= 5 and len(n.find({"li"})) >= 3 and links / len(text) >= 0.04 and len(text) <= 800)):
            n.remove()


def page_blocks(html: str | None) -> tuple[str, list[dict]]:
    """The title, and the blocks of the main part: tag, text, length, link_count, is_heading, is_link_only, is_nav_like."""
    root = Tree(html or "").root
    title = next((n for n in root.walk() if n.name == "title"), None)
    without_noise(root)
    node = main_node(root)
    without_contents_lists(node)
    out = []
    for n in node.find(BLOCKS):
        if not (text := n.text()):
            continue
        links = n.links()
        anchors = re.sub(r"\s+", " ", " ".join(a.text() for a in links)).strip()
        only = bool(anchors) and anchors == text
        out.append({"tag": n.name, "text": text, "length": len(text), "link_count": len(links), "is_heading": n.name in HEADINGS, "is_link_only": only, "is_nav_like": only or (len(links) >= 2 and len(text) <= 20)})
    return title.text() if title else "", out


def page_links(html: str | None) -> list[str]:
    """href of the links that are not furniture: no script or mail links, no hint of it on the link or three nodes up, no form."""
    out = []
    for a in Tree(html or "").root.find({"a"}):
        href, node, hops, noise = (a.attrs.get("href") or "").strip(), a.parent, 0, bool(NOISE.search(a.hint()))
        while node and node.name and hops < 3:
            noise |= node.name == "form" or bool(NOISE.search(node.hint()))
            node, hops = node.parent, hops + 1
        if href and not noise and not href.lower().startswith(("#", "javascript:", "mailto:", "tel:")):
            out.append(href)
    return out


def _per_page(pages: DataFrame, key: str, read: Callable, kind: pa.DataType, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            gc.collect()  # trees point at their parents, so only this frees those of the run before
            found = [read(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, kind)], [key, "found"])

    return pages.select(key, "html").mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, found {schema}")


def blocks(pages: DataFrame, key: str) -> DataFrame:
    """(key, title, at, tag, text, length, link_count, is_heading, is_link_only, is_nav_like) for the blocks of pages(key, html)."""
    fields = "tag string, text string, length int, link_count int, is_heading boolean, is_link_only boolean, is_nav_like boolean"
    one = pa.struct([("tag", pa.string()), ("text", pa.string()), ("length", pa.int32()), ("link_count", pa.int32()), ("is_heading", pa.bool_()), ("is_link_only", pa.bool_()), ("is_nav_like", pa.bool_())])
    kind = pa.struct([("title", pa.string()), ("blocks", pa.list_(one))])
    names = [f.split()[0] for f in fields.split(", ")]
    found = _per_page(pages, key, lambda h: dict(zip(("title", "blocks"), page_blocks(h), strict=True)), kind, "struct<title:string,blocks:array<struct<" + ",".join(f.replace(" ", ":") for f in fields.split(", ")) + ">>>")
    return found.select(key, "found.title", F.posexplode_outer("found.blocks").alias("at", "b")).select(key, "title", "at", *[F.col(f"b.{n}").alias(n) for n in names])


def features(blocks_of_pages: DataFrame, key: str) -> DataFrame:
    """One row a page of blocks(): its text and counts. Ratios have four places."""
    only, nav, there = F.coalesce("is_link_only", F.lit(False)), F.coalesce("is_nav_like", F.lit(False)), F.col("tag").isNotNull()
    kept = F.collect_list(F.when(there & ~only, F.struct("at", "text")))
    paragraph = F.col("tag").isin("p", "li", "dd", "dt", "td", "th") & (F.col("length") >= 30) & ~only
    n = F.count_if(there)
    rows = blocks_of_pages.groupBy(key, "title").agg(
        F.regexp_replace(F.array_join(F.array_sort(kept)["text"], "\n"), r"[ \t]+", " ").alias("text"), F.coalesce(F.sum(F.when(there & ~nav, F.col("link_count"))), F.lit(0)).cast("int").alias("link_count"),
        F.count_if(F.col("is_heading")).alias("heading_count"), F.count_if(paragraph).alias("paragraph_count"), n.alias("block_count"),
        F.when(n > 0, F.round(F.count_if(only) / n, 4)).otherwise(0.0).alias("link_only_block_ratio"), F.when(n > 0, F.round(F.count_if(nav) / n, 4)).otherwise(0.0).alias("nav_like_block_ratio"),
    )
    return rows.withColumns({"text_length": F.length("text"), "short_line_ratio": scoring.short_line_ratio(F.col("text"))})


def links(pages: DataFrame, key: str, url: str = "url") -> DataFrame:
    """(key, at, link): the distinct normalised absolute links of pages(key, url, html), in page order."""
    from urllib.parse import urljoin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            gc.collect()  # trees point at their parents, so only this frees those of the run before
            found = [[urljoin(u or "", h) for h in page_links(x)] for u, x in zip(batch.column("base").to_pylist(), batch.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.list_(pa.string()))], [key, "found"])

    rows = pages.select(key, F.col(url).alias("base"), "html").mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, found array<string>")
    each = rows.select(key, F.posexplode("found").alias("at", "link")).withColumn("link", urls.normalise(F.col("link")))
    return each.groupBy(key, "link").agg(F.min("at").alias("at")).select(key, "at", "link")
