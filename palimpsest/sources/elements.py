"""HTML parsed into items: elements, labels, landmarks, headings, tables, dialogs, alerts, frames, images, title.

HTML nests, which expressions over text cannot follow, so pages go through the standard parser
in Arrow batches, one page at a time; everything after is a DataFrame. Shadow roots are
<template shadowrootmode> elements, whose content counts as part of the page; the selectors of
what is in there follow their host's after ` >>> `.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.elements import accessible_label, element_type, field_label, is_pagination, is_search, safe_value
from ..storage import spread

ITEM = "page_id long, kind string, ord int, parent int, id string, tag string, type string, role string, name string, selector string, text string, aria_label string, labelled_by string, title string, placeholder string, value string, checked boolean, enabled boolean, visible boolean, form_id string, in_modal boolean, in_nav boolean, nav_label string, target string, wrapping string, href string, level int, n int, nearby string, width double, height double, frame_src string"
NAMES = [c.split()[0] for c in ITEM.split(", ")]
# Elements without an end tag, and those whose text nobody sees.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head"}
# Landmarks by tag and by role.
LANDMARK_TAGS = {"header": "banner", "nav": "navigation", "main": "main", "aside": "complementary", "footer": "contentinfo", "section": "region", "article": "article", "form": "form"}
LANDMARK_ROLES = {"banner", "navigation", "main", "complementary", "contentinfo", "region", "search", "form", "dialog", "alertdialog", "application"}
# What makes an element one to act on.
ACTIVE_TAGS = {"button", "input", "textarea", "select"}
ACTIVE_ROLES = {"button", "link", "tab", "menuitem", "checkbox", "radio", "combobox", "searchbox", "textbox", "switch", "option"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "words", "ord", "nth", "host", "counts", "last")

    def __init__(self, tag, attrs, parent, ord_):
        self.tag, self.attrs, self.parent, self.children, self.words, self.ord, self.nth, self.host = tag, attrs, parent, [], [], ord_, 1, None
        self.counts: Counter = Counter()
        self.last = ord_  # the last place of a tag inside

    def up(self) -> Iterator[Node]:
        node = self
        while node is not None:
            yield node
            node = node.parent

    def text(self) -> str:
        """All visible text inside, white space collapsed; nodes are visited by a list, as nesting may be deep."""
        out, open_ = [], [self]
        while open_:
            node = open_.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in UNSEEN or node is self or node.host is not None:
                open_.extend(reversed(node.words))
        return " ".join(" ".join(out).split())


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None, 0)
        self.at, self.nodes = self.root, []
        self.feed(html)
        self.close()
        for node in reversed(self.nodes):
            node.parent.last = max(node.parent.last, node.last)

    def handle_starttag(self, tag, attrs):
        # a paragraph, list item, option or table part ends the one before
        if tag in ("li", "option", "tr", "td", "th", "p") and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, len(self.nodes) + 1)
        self.at.counts[tag] += 1
        node.nth = self.at.counts[tag]
        if tag == "template" and "shadowrootmode" in node.attrs:
            node.host = self.at
        self.at.children.append(node)
        self.at.words.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node

    def inside(self, node: Node) -> list[Node]:
        """A node and all in it: they follow each other."""
        return self.nodes[node.ord - 1 : node.last]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        for node in self.at.up():
            if node.tag == tag and node.parent is not None:
                self.at = node.parent
                return

    def handle_data(self, data):
        if data.strip():
            self.at.words.append(data)


def escaped(value: str) -> str:
    return re.sub(r"([^\w-])", r"\\\1", value)


class Selectors:
    """Selectors that stay: a unique id, test id, name, label or hint, else the path from the root."""

    def __init__(self, nodes: list[Node]):
        self.scopes = {id(n): self.scope(n) for n in nodes}
        self.seen: Counter = Counter(c for n in nodes for c in self.candidates(n))

    def scope(self, node: Node) -> int:
        return next((n.ord for n in node.up() if n.host is not None and n is not node), 0)

    def candidates(self, node: Node) -> Iterator[tuple[int, str]]:
        a, scope = node.attrs, self.scopes[id(node)]
        if a.get("id"):
            yield scope, "#" + escaped(a["id"])
        for key in ("data-testid", "data-test", "data-qa"):
            if a.get(key):
                yield scope, f'[{key}="{escaped(a[key])}"]'
        if a.get("name"):
            yield scope, f'{node.tag}[name="{escaped(a["name"])}"]'
        for key in ("aria-label", "placeholder"):
            if 0 < len(a.get(key, "").strip()) < 60:
                yield scope, f'{node.tag}[{key}="{escaped(a[key].strip())}"]'

    def own(self, node: Node) -> str:
        for c in self.candidates(node):
            if self.seen[c] == 1:
                return c[1]
        parts = []
        for n in node.up():
            if n.parent is None or n.host is not None:
                break
            key = (self.scopes[id(n)], "#" + escaped(n.attrs.get("id", "")))
            if n is not node and n.attrs.get("id") and self.seen[key] == 1:
                parts.append(key[1])
                break
            parts.append(f"{n.tag}:nth-of-type({n.nth})")
        return " > ".join(reversed(parts))

    def of(self, node: Node) -> str:
        parts = [self.own(node)]
        host = next((n.host for n in node.up() if n.host is not None), None)
        while host is not None:
            parts.append(self.own(host))
            host = next((n.host for n in host.up() if n.host is not None), None)
        return " >>> ".join(reversed(parts))


def shown(node: Node) -> bool:
    """Whether neither the element nor what it lies in is hidden by attributes or by its own style."""
    for n in node.up():
        style = n.attrs.get("style", "").replace(" ", "").lower()
        if "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or (n.tag == "template" and n.host is None):
            return False
    return True


def size_of(node: Node, side: str) -> float | None:
    found = re.match(r"\s*(\d+(?:\.\d+)?)", node.attrs.get(side, "")) or re.search(rf"(?<![-\w]){side}\s*:\s*(\d+(?:\.\d+)?)px", node.attrs.get("style", ""))
    return float(found[1]) if found else None


def nearby(node: Node) -> str:
    """Words about an element: its own, those of four ancestors' labels, and of two neighbours on each side."""
    a = node.attrs
    out = [a.get(k, "") for k in ("alt", "title", "aria-label", "id", "class", "src")]
    for n in list(node.up())[1:5]:
        out += [n.attrs.get("aria-label", ""), n.attrs.get("id", ""), n.attrs.get("class", "")]
    if node.parent is not None:
        at = node.parent.words.index(node)
        for x in node.parent.words[max(0, at - 2) : at + 3]:
            out.append(x if isinstance(x, str) else x.text()[:200])
    return " ".join(" ".join(out).split())[:2000]


def first_inside(found: list[Node], node: Node) -> Node | None:
    """The first of some nodes, in their order, that is the node or in it."""
    at = bisect_left(found, node.ord, key=lambda x: x.ord)
    return found[at] if at < len(found) and found[at].ord <= node.last else None


def items_of(html: str) -> Iterator[dict]:
    tree = Tree(html)
    nodes = tree.nodes
    selectors = Selectors(nodes)
    by_id = {n.attrs["id"]: n for n in reversed(nodes) if n.attrs.get("id")}
    headings = [n for n in nodes if n.tag in ("h1", "h2", "h3", "h4")]
    titles = [n for n in nodes if n.tag in ("h1", "h2", "h3", "h4") or n.attrs.get("role") == "heading" or re.search(r"(modal|dialog)-title", n.attrs.get("class", ""))]
    forms = {id(n): n.attrs.get("id") or f"form_{i}" for i, n in enumerate(x for x in nodes if x.tag == "form")}
    for n in nodes:
        a, role = n.attrs, n.attrs.get("role", "").lower()
        base = {"ord": n.ord, "tag": n.tag, "role": role, "id": a.get("id"), "aria_label": a.get("aria-label"), "title": a.get("title"), "name": a.get("name"), "visible": shown(n)}
        form = next((forms[id(x)] for x in n.up() if x.tag == "form"), None)
        words = lambda: n.text()  # noqa: B023, E731
        named = " ".join(by_id[i].text() for i in a.get("aria-labelledby", "").split() if i in by_id)
        classes = a.get("class", "").lower()
        if (n.tag in ACTIVE_TAGS or (n.tag == "a" and "href" in a) or role in ACTIVE_ROLES or "onclick" in a or "tabindex" in a or (n.tag in ("div", "span") and re.search(r"cursor:\s*pointer", a.get("style", "")))) and a.get("type") != "hidden":
            nav = next((x for x in n.up() if x.tag == "nav" or x.attrs.get("role") == "navigation"), None)
            modal = any(x.tag == "dialog" and "open" in x.attrs or x.attrs.get("role") in ("dialog", "alertdialog") for x in n.up())
            wrapping = next((x for x in n.up() if x.tag == "label"), None)
            value = a.get("value")
            if n.tag == "textarea":
                value = words()
            if n.tag == "select":
                options = [x for x in n.children if x.tag == "option"] + [x for g in n.children if g.tag == "optgroup" for x in g.children if x.tag == "option"]
                picked = next((x for x in options if "selected" in x.attrs), options[0] if options else None)
                value = None if picked is None or "disabled" in picked.attrs else picked.attrs.get("value", picked.text())
            registered = next((x.ord for x in list(n.up())[1:] if x.tag in ACTIVE_TAGS or x.tag == "a"), None)
            yield base | {
                "kind": "element", "parent": registered, "type": a.get("type"), "selector": selectors.of(n), "text": "" if n.tag in ("input", "select", "textarea") else words(), "labelled_by": named, "placeholder": a.get("placeholder"), "value": value,
                "checked": "checked" in a, "enabled": "disabled" not in a and a.get("aria-disabled") != "true", "form_id": form, "in_modal": modal, "in_nav": nav is not None,
                "nav_label": (nav.attrs.get("aria-label") or nav.attrs.get("class")) if nav is not None else None, "wrapping": wrapping.text() if wrapping is not None else None, "href": a.get("href"), "width": size_of(n, "width"), "height": size_of(n, "height"),
            }
        if n.tag == "label" and a.get("for"):
            yield base | {"kind": "label", "target": a["for"], "text": words()}
        if n.tag == "option":
            within = next((x for x in n.up() if x.tag == "select"), None)
            group = next((x for x in n.up() if x.tag == "optgroup"), None)
            off = "disabled" in a or (group is not None and "disabled" in group.attrs)
            if within is not None:
                yield base | {"kind": "option", "parent": within.ord, "text": words()[:100], "value": a.get("value", words()), "checked": "selected" in a, "enabled": not off, "target": group.attrs.get("label") if group is not None else None}
        mark = LANDMARK_TAGS.get(n.tag) or (role if role in LANDMARK_ROLES else None)
        if mark:
            heading = first_inside(headings, n)
            label = a.get("aria-label") or named or a.get("title") or (heading.text()[:80] if heading else None)
            yield base | {"kind": "landmark", "type": mark, "text": label or None}
        if re.fullmatch("h[1-6]", n.tag) or role == "heading":
            text = words()
            if 0 < len(text) <= 150:
                level = a.get("aria-level", "")
                yield base | {"kind": "heading", "level": int(n.tag[1]) if n.tag[0] == "h" and len(n.tag) == 2 else int(level) if level.isdigit() else 2, "text": text}
        if n.tag == "table" or role in ("table", "grid"):
            inside = tree.inside(n)
            heads = [t[:50] for t in (x.text() for x in inside if x.tag == "th" or x.attrs.get("role") == "columnheader") if t]
            yield base | {"kind": "table", "n": max(0, sum(x.tag == "tr" or x.attrs.get("role") == "row" for x in inside) - 1), "text": "|".join(heads)}
        if (n.tag == "dialog" and "open" in a) or (role == "dialog" and a.get("aria-modal") == "true") or role == "alertdialog":
            heading = first_inside(titles, n)
            yield base | {"kind": "modal", "selector": selectors.of(n), "text": heading.text()[:100] if heading else None}
        bad = role == "alert" or a.get("aria-invalid") == "true" or "alert-danger" in classes or "error" in classes
        good = role == "status" or "alert-success" in classes or "success" in classes
        if (bad or good) and 2 < len(words()) < 300:
            yield base | {"kind": "alert", "type": "error" if bad else "success", "text": words()}
        if a.get("aria-busy") == "true" or re.search(r"(^|\s)spinner(\s|$)|loading-spinner|is-loading", classes):
            yield base | {"kind": "loading", "text": a.get("aria-label") or "Component loading"}
        if n.tag in ("iframe", "frame"):
            yield base | {"kind": "frame", "frame_src": a.get("src"), "width": size_of(n, "width"), "height": size_of(n, "height")}
        if n.tag in ("pre", "code"):
            yield base | {"kind": "code", "text": words()}
        if n.tag in ("img", "canvas"):
            yield base | {"kind": "image", "nearby": nearby(n), "width": size_of(n, "width"), "height": size_of(n, "height")}
        if n.tag == "title":
            yield base | {"kind": "title", "text": words()[:120]}


TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def parsed(pages: DataFrame, rows_of: Callable[[str], Iterator[dict]], schema: str, key: str, html: str) -> DataFrame:
    """What rows_of gives for each page, a few thousand rows at a time; pages are dealt out over all cores."""
    arrow = pa.schema([(c.split()[0], TYPES[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        for batch in batches:
            held: list[dict] = []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in rows_of(text or ""):
                    held.append({"page_id": page} | row)
                    if len(held) > 5000:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held = []
            yield pa.RecordBatch.from_pylist(held, arrow)

    return spread(pages.select(F.col(key).cast("long").alias("page_id"), F.col(html).alias("html")), "page_id").mapInArrow(run, schema)


def page_items(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Every item of every page, as ITEM; null pages have none. ord is the place of the tag among all of its page."""
    return parsed(pages, items_of, ITEM, key, html)


BOX = "page_id long, ord int, last int, up int, host int, tag string, id string, text string, selector string, shown boolean, left double, top double, width double, height double, z int"


def style_number(style: str, name: str) -> float | None:
    found = re.search(rf"(?:^|;)\s*{name}\s*:\s*(-?\d+(?:\.\d+)?)(?:px)?\s*(?:;|$)", style)
    return float(found[1]) if found else None


def boxes_of(html: str) -> Iterator[dict]:
    """Every node with its selector inside its shadow root, the host of that, and its box as far as its own style says.

    up is the positioned ancestor that left and top count from; nodes that aren't positioned have neither.
    """
    tree = Tree(html)
    selectors = Selectors(tree.nodes)
    kind: dict[int, str] = {}
    for n in tree.nodes:
        style = n.attrs.get("style", "").lower()
        found = re.search(r"(?:^|;)\s*position\s*:\s*(absolute|relative|fixed|sticky)", style)
        kind[n.ord] = found[1] if found else ""
        at = bool(found)
        z = style_number(style, "z-index") if at else None
        up = None if kind[n.ord] == "fixed" else next((x.ord for x in list(n.up())[1:] if kind.get(x.ord)), None)
        host = next((x.host.ord for x in n.up() if x.host is not None and x is not n), None)
        yield {
            "ord": n.ord, "last": n.last, "up": up, "host": host, "tag": n.tag, "id": n.attrs.get("id"), "text": " ".join(" ".join(w for w in n.words if isinstance(w, str)).split())[:200], "selector": selectors.own(n), "shown": shown(n),
            "left": style_number(style, "left") if at else None, "top": style_number(style, "top") if at else None, "width": size_of(n, "width"), "height": size_of(n, "height"), "z": None if z is None else int(z),
        }


def page_boxes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Every node of every page, as BOX: what `operators.layout` places, stacks and names."""
    return parsed(pages, boxes_of, BOX, key, html)


def of_kind(items: DataFrame, kind: str, *columns: str, most: int | None = None) -> DataFrame:
    """A page's items of one kind in order, `most` at most."""
    from pyspark.sql import Window

    rows = items.filter(F.col("kind") == kind)
    if most is not None:
        rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).filter(F.col("__k") <= most)
    return rows.select("page_id", "ord", *columns)


def select_options(items: DataFrame, most: int = 50) -> DataFrame:
    """(page_id, ord, options, n_options) of every select element: its first `most` options in order, as structs label, value, group, selected, enabled."""
    c = F.col
    one = F.struct("ord", F.struct(c("text").alias("label"), "value", c("target").alias("group"), c("checked").alias("selected"), "enabled").alias("o"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("page_id", "parent").orderBy("ord"))
    rows = items.filter("kind = 'option'").withColumn("__k", place)
    listed = F.transform(F.array_sort(F.collect_list(F.when(c("__k") <= most, one))), lambda s: s["o"])
    return rows.groupBy("page_id", c("parent").alias("ord")).agg(listed.alias("options"), F.count(F.lit(1)).alias("n_options"))


def interactive(items: DataFrame) -> DataFrame:
    """Elements to act on, with their types, names, labels and safe values, as `operators.elements` takes them."""
    rows = items.filter("kind = 'element'")
    words = items.filter("kind = 'label'").groupBy("page_id", F.col("target").alias("id")).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"])).alias("labels"))
    c = F.col
    typed = rows.join(words, ["page_id", "id"], "left").withColumn("kind_", c("type")).withColumn("type", element_type(c("tag"), c("kind_"), c("role")))
    value = safe_value(c("type"), c("value"), c("checked"))
    text = accessible_label(c("type"), c("aria_label"), F.coalesce("labels", "wrapping"), c("labelled_by"), c("title"), c("text"), c("value"))
    label = field_label(c("aria_label"), c("labelled_by"), c("labels"), c("wrapping"), c("placeholder"), c("name"))
    out = typed.withColumn("text", text).withColumn("label", label).withColumn("value", value)
    out = out.withColumn("has_value", F.when(c("type").startswith("input:") | c("type").isin("select", "textarea"), (F.coalesce("value", F.lit("")) != "") & ~F.coalesce(c("value"), F.lit("")).isin("unchecked", "[REDACTED]")))
    found = out.withColumn("is_search", is_search(c("type"), c("role"), c("name"), c("placeholder"), c("aria_label"), c("id"))).withColumn("is_pagination", c("tag").isin("a", "button") & is_pagination(c("nav_label"), c("text"), c("aria_label")))
    return found.select("page_id", "ord", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("e"), "ord")).alias("id"), "tag", "type", "role", "name", "selector", "text", "label", "aria_label", "placeholder", "value", "has_value", "enabled", "visible", "is_search", "is_pagination", "in_modal", "in_nav", "form_id", "href", "width", "height", c("parent").alias("parent_ord"))
