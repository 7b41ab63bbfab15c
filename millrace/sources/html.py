"""Stored pages: charset, HTML to Markdown, titles. Scripts, menus and forms are dropped; links become
absolute; data tables become pipe tables, layout tables flowing text; images are left out."""

from __future__ import annotations

import html as entities
import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content is no content.
DROPPED = frozenset("head script style noscript template svg canvas iframe nav footer aside form button select".split())
BLOCKS = frozenset("p div section article main header ul ol dl dd dt table tr blockquote figure figcaption address fieldset details summary center body html".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Longest cell of a data table.
CELL_CHARS = 300


def charset_of(header: str | None, raw: bytes) -> str:
    """The charset that the content type or the page itself names, else UTF-8."""
    m = re.search(r"charset=[\"']?([\w.:-]+)", header or "", re.I) or re.search(r"<meta[^>]+charset=[\"']?([\w.:-]+)", raw[:4096].decode("latin-1"), re.I)
    name = (m[1] if m else "utf-8").lower()
    try:
        "".encode(name)
    except LookupError:
        name = "utf-8"
    return {"iso-8859-1": "cp1252", "latin-1": "cp1252", "ascii": "utf-8", "us-ascii": "utf-8", "gb2312": "gb18030", "gbk": "gb18030"}.get(name, name)


class _Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        implied = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, ())
        stop = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(tag, ())
        if tag in BLOCKS or re.fullmatch("h[1-6]", tag):
            implied = (*implied, "p")
        cut = None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in stop or self.open[k].tag in DROPPED:
                break
            if self.open[k].tag in implied:
                cut = k
        if cut is not None:
            del self.open[cut:]
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].kids.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def _absolute(href: str, base: str | None) -> str:
    try:
        url = urljoin(base, href.strip()) if base else href.strip()
    except ValueError:
        url = href.strip()
    return url.replace(" ", "%20").replace("(", "%28").replace(")", "%29")


def _live(href: str) -> bool:
    h = href.strip()
    return bool(h) and not h.startswith("#") and not h.lower().startswith("javascript:")


class _Writer:
    def __init__(self, base: str | None):
        self.base = base

    def inline(self, node) -> str:
        if isinstance(node, str):
            return re.sub(r"\s+", " ", node)
        if node.tag in DROPPED or node.tag == "img":
            return ""
        if node.tag == "br":
            return "\n"
        body = "".join(map(self.inline, node.kids))
        word = body.strip()
        if node.tag == "a":
            href = node.attrs.get("href", "")
            if word and _live(href):
                return f"{' ' * body[:1].isspace()}[{' '.join(word.split())}]({_absolute(href, self.base)}){' ' * body[-1:].isspace()}"
            return body
        mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`"}.get(node.tag)
        return f"{mark}{word}{mark}" if mark and word else f" {body} " if node.tag in BLOCKS else body

    def cell(self, node) -> str:
        return " ".join(self.inline(_Node("", {"": ""}) if node is None else node).replace("**", "").replace("`", "").split())

    def rows(self, node: _Node, out: list[list[str]]) -> None:
        for k in node.kids:
            if isinstance(k, str) or k.tag == "table":
                continue
            if k.tag == "tr":
                row: list[str] = []
                for c in k.kids:
                    if not isinstance(c, str) and c.tag in ("td", "th"):
                        span = c.attrs.get("colspan", "1").strip()
                        row += [self.cell(c), *[""] * (min(20, max(1, int(span) if span.isdigit() else 1)) - 1)]
                out.append(row)
            else:
                self.rows(k, out)

    def table(self, node: _Node) -> str | None:
        rows: list[list[str]] = []
        self.rows(node, rows)
        rows = [r for r in rows if any(r)]
        wide = max(map(len, rows), default=0)
        if wide < 2 or len(rows) < 2 or any(len(c) > CELL_CHARS for r in rows for c in r):
            return None
        line = lambda r: "| " + " | ".join([c.replace("|", "\\|") for c in r] + [""] * (wide - len(r))) + " |"
        return "\n".join([line(rows[0]), "|" + " --- |" * wide, *map(line, rows[1:])])

    def blocks(self, node: _Node, out: list[str], indent: str = "", ordinal: str | None = None) -> None:
        run = ""
        for k in node.kids:
            tag = "" if isinstance(k, str) else k.tag
            if tag in DROPPED:
                continue
            heading = re.fullmatch("h([1-6])", tag)
            if not (heading or tag in BLOCKS or tag in ("li", "pre", "hr", "thead", "tbody", "tfoot", "td", "th")) and not (not isinstance(k, str) and self._holds_block(k)):
                run += self.inline(k)
                continue
            self._flush(run, out, indent)
            run = ""
            if heading:
                text = " ".join("".join(map(self.inline, k.kids)).split())
                if text:
                    out.append("#" * int(heading[1]) + " " + text)
            elif tag == "pre":
                out.append("```\n" + "".join(x if isinstance(x, str) else "".join(map(str, self._texts(x))) for x in k.kids).strip("\n") + "\n```")
            elif tag == "hr":
                out.append("---")
            elif tag == "table":
                made = self.table(k)
                if made:
                    out.append(made)
                else:
                    self.blocks(k, out, indent)
            elif tag in ("ul", "ol"):
                items = []
                for n, item in enumerate((x for x in k.kids if not isinstance(x, str) and x.tag == "li"), 1):
                    inner: list[str] = []
                    self.blocks(item, inner, indent + "  ")
                    if inner:
                        items.append((f"{n}. " if tag == "ol" else "* ") + "\n".join(inner).lstrip())
                if items:
                    out.append("\n".join(items))
            elif tag == "blockquote":
                inner = []
                self.blocks(k, inner)
                if inner:
                    out.append("\n".join("> " + x for x in "\n\n".join(inner).split("\n")))
            else:
                self.blocks(k, out, indent)
        self._flush(run, out, indent)

    def _texts(self, node):
        for k in node.kids:
            if isinstance(k, str):
                yield k
            else:
                yield from self._texts(k)

    def _holds_block(self, node: _Node) -> bool:
        return node.tag not in ("a",) and any(not isinstance(k, str) and (k.tag in BLOCKS or k.tag in ("li", "pre", "hr") or re.fullmatch("h[1-6]", k.tag) or self._holds_block(k)) for k in node.kids)

    @staticmethod
    def _flush(run: str, out: list[str], indent: str) -> None:
        text = "\n".join(" ".join(x.split()) for x in run.split("\n")).strip()
        if text:
            out.append(text)


def tidy(text: str) -> str:
    """No trailing spaces, one blank line at most, one line end."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in text.split("\n"))).strip() + "\n"


def to_markdown(page: str, base: str | None = None) -> str:
    """HTML as Markdown."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    out: list[str] = []
    _Writer(base).blocks(tree.root, out)
    return tidy(re.sub(r"!\[[^\]\n]*\]\([^)]*\)", "", "\n\n".join(out)))


def title_of(page: str) -> str | None:
    m = re.search(r"<title[^>]*>(.*?)</title", page, re.I | re.S)
    return (" ".join(entities.unescape(m[1]).split()) or None) if m else None


def markdown(page: Column, url: Column | None = None) -> Column:
    """Column of Markdown for a column of HTML; relative links resolve against ``url``. Null gives null."""

    @F.arrow_udf(T.StringType())
    def run(pages: pa.Array, bases: pa.Array) -> pa.Array:
        return pa.array([None if p is None else to_markdown(p, b) for p, b in zip(pages.to_pylist(), bases.to_pylist())], pa.string())

    return run(page, url if url is not None else F.lit(None).cast("string"))


def decoded(raw: Column, content_type: Column) -> Column:
    """Column of text for a column of page bytes by the charset of header or page; null for other than text."""

    @F.arrow_udf(T.StringType())
    def run(pages: pa.Array, kinds: pa.Array) -> pa.Array:
        out = []
        for p, k in zip(pages.to_pylist(), kinds.to_pylist()):
            texty = not k or re.search(r"text/|json|xml|javascript", k, re.I)
            out.append(None if p is None or not texty else bytes(p).decode(charset_of(k, bytes(p)), "replace"))
        return pa.array(out, pa.string())

    return run(raw, content_type)


def readable_body(raw: Column, content_type: Column, url: Column | None = None) -> Column:
    """Column of the text of a response: Markdown for HTML, indented JSON, other text as it is; null for what is no text.

    HTML is told by the content type, or by how the page begins where none is given. JSON that cannot be read stays as it is.
    """

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array, kinds: pa.Array, bases: pa.Array) -> pa.Array:
        out = []
        for text, kind, base in zip(texts.to_pylist(), kinds.to_pylist(), bases.to_pylist()):
            kind = (kind or "").lower()
            if text is None:
                out.append(None)
            elif "html" in kind or (not kind and re.match(r"\s*<(?:!doctype html|html)\b", text, re.I)):
                out.append(to_markdown(text, base))
            elif "json" in kind:
                try:
                    out.append(json.dumps(json.loads(text), ensure_ascii=False, indent=2))
                except ValueError:
                    out.append(text)
            else:
                out.append(text)
        return pa.array(out, pa.string())

    return run(decoded(raw, content_type), content_type, url if url is not None else F.lit(None).cast("string"))
