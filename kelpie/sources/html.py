"""Shop pages as rows: a small element tree from the standard library's parser, and what the crawl takes from it."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import zip_longest
from operator import attrgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions import text as T
from kelpie.functions.tables import tables
from kelpie.shared import spread

#: Fixed values of HTML: elements without content; those that stand on lines of their own; those that end an open p.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
ENDS_P = set("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
#: Elements whose end tag may be left out. By the tag that begins: those it ends, unless one of the last lies between.
CELLS, ROWS = ("td", "th"), ("tr", "td", "th")
PARTS = (*ROWS, "thead", "tbody", "tfoot", "caption", "colgroup")
ENDS = {
    **dict.fromkeys(ENDS_P, (("p",), "scope")),
    "li": (("li", "p"), "list"), "dt": (("dt", "dd", "p"), "list"), "dd": (("dt", "dd", "p"), "list"),
    **dict.fromkeys(CELLS, (CELLS, "row")), "tr": (ROWS, "table"), **dict.fromkeys(("thead", "tbody", "tfoot"), (PARTS, "table")),
    "a": (("a",), "scope"), "option": (("option",), "select"), "optgroup": (("option", "optgroup"), "select"),
}
#: What keeps a tag from ending elements outside, by kind.
BORDERS = {
    "scope": {"table", "td", "th", "caption", "button", "object", "template"},
    "list": {"ul", "ol", "menu", "dl", "table", "td", "th", "caption", "button", "object", "template", "section", "article", "aside", "nav", "main", "form", "header", "footer"},
    "row": {"tr", "table"}, "table": {"table"}, "select": {"select"}, "inline": BLOCK | {"td", "th"},
}
KINDS = {t: tuple(k for k, tags in BORDERS.items() if t in tags) for tags in BORDERS.values() for t in tags}


class Node:
    """An element; its descendants are those numbered from at + 1 to last."""

    __slots__ = ("tag", "attrs", "children", "classes", "at", "last", "named")

    def __init__(self, tag: str, attrs: dict[str, str | None], at: int, named: dict) -> None:
        self.tag, self.attrs, self.children, self.at, self.last, self.named = tag, attrs, [], at, at, named
        self.classes = set((attrs.get("class") or "").split())

    def find(self, tag: str = "", cls: str = "", id_: str = "") -> Iterator[Node]:
        """Descendants in page order."""
        own = self.named.get(("id", id_) if id_ else ("class", cls) if cls else ("tag", tag), ())
        for k in range(bisect_right(own, self.at, key=_AT), bisect_right(own, self.last, key=_AT)):
            c = own[k]
            if (not tag or c.tag == tag) and (not cls or cls in c.classes) and (not id_ or c.attrs.get("id") == id_):
                yield c

    def first(self, **what) -> Node | None:
        return next(self.find(**what), None)

    def text(self, lines: bool = True) -> str:
        """Text as shown: white space folded, block elements on lines of their own, cells behind tabs; else all text as it is."""
        out: list[str] = []
        todo: list[Node | tuple[str, str]] = [("", x) if isinstance(x, str) else x for x in reversed(self.children)]
        while todo:
            c = todo.pop()
            if isinstance(c, tuple):
                edge, t = c
                out.append(edge or (" ".join(t.split()).join((" " * t[:1].isspace(), " " * t[-1:].isspace())) if lines and t.strip() else " " if lines else t))
            elif c.tag not in ("script", "style"):
                edge = "\n" if lines and c.tag in BLOCK else ""
                out.append(edge)
                if after := edge or ("\t" if lines and c.tag in CELLS else ""):
                    todo.append((after, ""))
                todo += [("", x) if isinstance(x, str) else x for x in reversed(c.children)]
        if not lines:
            return "".join(out)
        rows = ("\t".join(" ".join(x.split()) for x in r.rstrip("\t ").split("\t")) for r in "".join(out).split("\n"))
        return "\n".join(r for r in rows if r.strip())


_AT = attrgetter("at")


class _Tree(HTMLParser):
    """Builds the tree in time that grows with the page: for each tag and each kind of border it knows where on the stack it is open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.named: dict[tuple[str, str], list[Node]] = defaultdict(list)
        self.count = 0
        self.root = Node("", {}, 0, self.named)
        self.stack = [self.root]
        self.open: dict[str, list[int]] = defaultdict(list)
        self.borders: dict[str, list[int]] = {k: [0] for k in BORDERS}

    def _cut(self, k: int) -> None:
        """Closes all from place k of the stack."""
        while len(self.stack) > k:
            n = self.stack.pop()
            n.last = self.count
            self.open[n.tag].pop()
            for kind in KINDS.get(n.tag, ()):
                self.borders[kind].pop()

    def _add(self, tag: str, attrs: list) -> Node:
        for tags, kind in (ENDS[tag],) if tag in ENDS else ():
            border = self.borders[kind][-1]
            # of those open within the border, the outermost
            places = [own[k] for t in tags if (own := self.open.get(t)) and (k := bisect_right(own, border)) < len(own)]
            if places:
                self._cut(min(places))
        self.count += 1
        n = Node(tag, dict(attrs), self.count, self.named)
        self.stack[-1].children.append(n)
        self.named["tag", tag].append(n)
        for c in n.classes:
            self.named["class", c].append(n)
        if n.attrs.get("id"):
            self.named["id", n.attrs["id"]].append(n)
        return n

    def handle_starttag(self, tag: str, attrs: list) -> None:
        n = self._add(tag, attrs)
        if tag not in VOID:
            for kind in KINDS.get(tag, ()):
                self.borders[kind].append(len(self.stack))
            self.open[tag].append(len(self.stack))
            self.stack.append(n)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        own = self.open.get(tag)
        if own:
            kind = "table" if tag in PARTS else "inline" if tag != "a" and tag not in BLOCK and tag not in KINDS else "" if tag in BORDERS["scope"] else "scope"
            if not kind or own[-1] > self.borders[kind][-1]:
                self._cut(own[-1])

    def updatepos(self, i: int, j: int) -> int:
        """Lines aren't counted, as nothing here asks for them."""
        return j

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def tree(page: str | None) -> Node:
    """The elements of a page. End tags that HTML lets authors leave out are taken as read."""
    t = _Tree()
    t.feed(page or "")
    t.close()
    t._cut(1)
    t.root.last = t.count
    return t.root


def _inner(n: Node | None) -> str:
    return n.text().strip() if n else ""


def catalog_links(root: Node) -> list[dict]:
    """Product links with their names; links without a target are left out."""
    found = [(a, a.first(cls="product__name")) for a in root.find(tag="a", cls="product__link") if a.attrs.get("href")]
    return [{"href": a.attrs["href"], "name": n.text(False).strip() if n else None} for a, n in found]


def specs(root: Node) -> list[dict]:
    """Specification rows of titled sections; a later row of the same name replaces the value."""
    out: dict[str, str] = {}
    for s in root.find(tag="section", cls="technical-content-section"):
        if s.first(tag="p", cls="title"):
            for t in s.find(tag="table", cls="technical-content"):
                for r in t.find(tag="tr", cls="technical-content-item"):
                    cells = [_inner(c) for c in r.find(tag="td")]
                    if len(cells) > 1 and cells[0]:
                        out[cells[0]] = cells[1]
    return [{"key": k, "value": v} for k, v in out.items()]


def variants(root: Node) -> list[dict]:
    """Colours and prices; whether there is stock is a matter of the page, so the same for all."""
    gone = any("TẠM HẾT HÀNG" in b.text().upper() for b in root.find(cls="order-button") if "hidden" not in b.attrs)
    return [{"color": _inner(a.first(cls="item-variant-name")), "price": _inner(a.first(cls="item-variant-price")), "stock": "Tạm hết hàng" if gone else "Còn hàng"} for a in root.find(tag="a", cls="button__change-color")]


def description(root: Node) -> str:
    """The first of four places that has text."""
    places = ({"id_": "cpsKsp"}, {"cls": "ksp-content"}, {"id_": "cpsContentSEO"}, {"id_": "cpsContent"})
    return next((t for p in places if (t := _inner(root.first(**p)))), "")


def faq(root: Node) -> list[dict]:
    out: dict[str, str] = {}
    for item in root.find(cls="accordion-item"):
        q, a = (item.first(cls=c) for c in ("accordion-label", "accordion-content"))
        if q and a:
            q, a = ((_inner(x) or x.text(False).strip()) for x in (q, a))
            if q and a:
                out[q] = a
    return [{"key": k, "value": v} for k, v in out.items()]


def policy(root: Node) -> list[dict]:
    """Menu entries of the policy page, with the content saved for each in page order; without one it is empty."""
    titles, contents = list(root.find(cls="warranty-options-item")), list(root.find(cls="warranty-content"))
    return [{"title": _inner(t), "content": _inner(c)} for t, c in zip_longest(titles, contents[: len(titles)])]


def links(root: Node) -> list[str]:
    return [h for a in root.find(tag="a") if (h := a.attrs.get("href"))]


def more_products(root: Node) -> bool:
    """Whether a listing shows a button for more."""
    return any("hidden" not in b.attrs for b in root.find(cls="button__show-more-product"))


def heading(root: Node) -> str | None:
    return _inner(root.first(tag="h1")) or None


#: Fixed values above: the class names and ids of the shop's pages.
READERS = {f.__name__: f for f in (catalog_links, specs, variants, description, faq, policy, links, heading)}
_ENTRY = "array<struct<key:string,value:string>>"
TYPES = {"catalog_links": "array<struct<href:string,name:string>>", "specs": _ENTRY, "variants": "array<struct<color:string,price:string,stock:string>>", "description": "string", "faq": _ENTRY, "policy": "array<struct<title:string,content:string>>", "links": "array<string>", "heading": "string"}


def parsed(html: Column, *what: str) -> Column:
    """A struct of what the readers take from each page, parsed once."""

    @F.pandas_udf(", ".join(f"{k} {TYPES[k]}" for k in what))
    def read(pages: pd.Series) -> pd.DataFrame:
        roots = [tree(p) for p in pages]
        return pd.DataFrame({k: pd.Series([READERS[k](r) for r in roots], dtype=object) for k in what})

    # filters on the struct would else be moved below a join or a repartition, and there parse each page again in the few tasks of a scan
    return read.asNondeterministic()(html)


def catalog(pages: DataFrame, base: str) -> DataFrame:
    """Products (id, name, url) of listing pages (html)."""
    rows = pages.select(F.explode(parsed(F.col("html"), "catalog_links")["catalog_links"]).alias("x"))
    url = T.resolve_url(base, F.col("x.href"))
    return rows.select(T.url_id(url).alias("id"), F.col("x.name").alias("name"), url.alias("url"))


def enriched(products: DataFrame, pages: DataFrame) -> DataFrame:
    """Products (ord, id, name, url) with what their pages (url, html) say; names backfilled, unsellable products dropped.

    A product stays if it has specifications and variants, and not all variants lack a price and stock.
    """
    pages = spread(pages.select("url", "html"))
    p = products.join(pages.select("url", parsed(F.col("html"), "specs", "variants", "description", "heading").alias("x")), "url", "left")
    name = F.coalesce(T.blank_to_null(F.col("name")), T.blank_to_null(F.col("x.heading")), F.col("id"))
    p = p.select("ord", "id", name.alias("name"), "url", F.map_from_entries("x.specs").alias("specs"), F.col("x.variants").alias("variants"), F.col("x.description").alias("description"))
    dead = F.forall("variants", lambda v: (T.strip(F.coalesce(v["price"], F.lit(""))) == "") & (v["stock"] == "Tạm hết hàng"))
    return p.where((F.size("specs") > 0) & (F.size("variants") > 0) & ~dead)


def described(products: DataFrame) -> DataFrame:
    return products.where(F.coalesce("description", F.lit("")) != "")


def faqs(products: DataFrame, pages: DataFrame) -> DataFrame:
    pages = spread(pages.select("url", "html"))
    rows = products.join(pages.select("url", parsed(F.col("html"), "faq").alias("x")), "url")
    return rows.select("ord", "id", "name", F.map_from_entries("x.faq").alias("faq")).where(F.size("faq") > 0)


def policies(pages: DataFrame) -> DataFrame:
    """Policy sections (section_index, title, content) of saved policy pages (html), tables as markdown."""
    rows = pages.select(F.posexplode(parsed(F.col("html"), "policy")["policy"]).alias("i", "x"))
    return rows.select((F.col("i") + 1).alias("section_index"), T.normalize(F.col("x.title")).alias("title"), tables(T.normalize(F.col("x.content"))).alias("content"))
