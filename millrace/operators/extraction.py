"""Facts found in documents, one row each: prices, dates, people, links, numbers, e-mail addresses, tables.

A document is read line by line (outside code fences) in one pass, for one kind or for all; the first of equal facts
of a document is kept, then a keyword may filter. Nothing is shuffled. Null bodies hold nothing. Tables are
pipe tables and what a body has left of HTML tables.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions import dateforms, scanners
from ..functions.scanners import readable
from ..sources.html import to_markdown
from ..sources.pipes import find_tables
from .documents import numbered_lines, per_document, split_sections

#: Letters of context around a fact.
CONTEXT_CHARS = 120
KINDS = ("tables", "prices", "dates", "people", "links", "numbers", "emails")


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


# ---------------------------------------------------------------- rows

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()
_PLACE = [("section", _I), ("line", _I), ("doc", _S), ("url", _S)]
SCHEMAS = {
    "prices": [("value", _D), ("currency", _S), ("period", _S), ("per", _S), ("raw", _S), ("context", _S), *_PLACE],
    "dates": [("date", _S), ("precision", _S), ("ambiguous", T.BooleanType()), ("raw", _S), ("context", _S), *_PLACE],
    "people": [("name", _S), ("role", _S), ("org", _S), ("confidence", _D), ("context", _S), *_PLACE],
    "links": [("text", _S), ("url", _S), ("section", _I), ("line", _I), ("doc", _S), ("source", _S)],
    "numbers": [("value", _D), ("unit", _S), ("raw", _S), ("context", _S), *_PLACE],
    "emails": [("email", _S), ("context", _S), *_PLACE],
    "tables": [("title", _S), ("columns", T.ArrayType(_S)), ("rows", T.ArrayType(T.ArrayType(_S))), ("row_count", _I), ("section", _I), ("line", _I), ("doc", _S), ("source", _S)],
}


def _clip(text: str, hit: tuple) -> str:
    return scanners.clip(text, hit[-2], hit[-1], CONTEXT_CHARS)


def _of_line(kind: str, raw: str, text: str, url: str | None, host: str) -> list[tuple]:
    """(key, fields) of the facts of one line; equal keys are one fact of a document."""
    if kind == "links":
        return [((link,), (shown, link)) for shown, link in scanners.links(raw, url)]
    if kind == "prices":
        return [(h[:4], (*h[:5], _clip(text, h))) for h in scanners.prices(text, host)]
    if kind == "dates":
        return [((h[0], h[3]), (*h[:4], _clip(text, h))) for h in dateforms.scan(text)]
    if kind == "people":
        return [((h[0].lower(), h[1].lower()), (*h[:4], _clip(text, h))) for h in scanners.people(text)]
    if kind == "numbers":
        return [((*h[:2], _clip(text, h)), (*h[:3], _clip(text, h))) for h in scanners.numbers(text, host)]
    return [((h[0].lower(),), (h[0], _clip(text, h))) for h in scanners.addresses(text)]


_HTML_TABLE = re.compile(r"<table\b.*?</table\s*>", re.I | re.S)


def tables_in(body: str, url: str | None = None) -> list[tuple[list[str], list[list[str]], int]]:
    """(columns, rows, line) of the pipe tables and of the HTML tables of a body, in order, equal ones once.

    Tables in code fences, without rows and HTML without an end do not count.
    """
    found = find_tables(body)
    if "<" in body:
        open_lines = {n for n, _, _ in numbered_lines(body)}
        for m in _HTML_TABLE.finditer(body):
            line = body.count("\n", 0, m.start()) + 1
            if line in open_lines:
                found += [(columns, rows, line) for columns, rows, _ in find_tables(to_markdown(m[0], url))]
    out, seen = [], set()
    for columns, rows, line in sorted(found, key=lambda x: x[2]):
        key = (tuple(columns), tuple(map(tuple, rows)))
        if columns and rows and key not in seen:
            seen.add(key)
            out.append((columns, rows, line))
    return out


def _has(keyword: str | None, values) -> bool:
    return not keyword or any(keyword.lower() in str(x).lower() for v in values for x in (v if isinstance(v, list) else [v]) if isinstance(x, str))


def _table_facts(body: str, url: str | None, title: str | None, doc: str | None, keyword: str | None) -> list[tuple]:
    out, marks, starts = [], None, None
    for columns, rows, line in tables_in(body, url):
        if not _has(keyword, [columns, *rows]):
            continue
        if marks is None:
            marks, starts = split_sections(body), [0]
            for x in body.split("\n"):
                starts.append(starts[-1] + len(x) + 1)
        own = next((s for s in reversed(marks) if s[3] <= starts[line - 1]), None)
        heading = re.sub(r" \(part \d+/\d+\)$", "", own[1]) if own else "(top)"
        out.append((heading if heading != "(top)" else title or "", columns, rows, len(rows), own[0] if own else 1, line, doc, url))
    return out


def _of_site(url: str, site: str) -> bool:
    host, site = _host(url).removeprefix("www."), site.strip().lower().removeprefix("www.")
    return host == site or host.endswith("." + site)


def facts(kinds: tuple[str, ...], body: str | None, url: str | None, doc: str | None, keyword: str | None = None, site: str | None = None, title: str | None = None, section: int | None = None) -> dict[str, list[tuple]]:
    """Rows of ``SCHEMAS[kind]`` of one document for each kind; its lines are read once for all of them."""
    out: dict[str, list[tuple]] = {k: [] for k in kinds}
    if not body:
        return out
    by_line = [k for k in kinds if k != "tables"]
    if "tables" in kinds:
        out["tables"] = [r for r in _table_facts(body, url, title, doc, keyword) if section in (None, r[4])]
    seen: dict[str, set] = {k: set() for k in by_line}
    host = _host(url)
    for line, at, raw in numbered_lines(body) if by_line else ():
        if section not in (None, at):
            continue
        text = readable(raw)
        for kind in by_line:
            for key, values in _of_line(kind, raw, text, url, host):
                if key in seen[kind]:
                    continue
                seen[kind].add(key)
                row = (*values, at, line, doc, url)
                if _has(keyword, row) and (kind != "links" or not site or _of_site(values[1], site)):
                    out[kind].append(row)
    return out


def _schema(kind: str) -> T.StructType:
    if kind not in KINDS:
        raise EngineError("bad_args", f"`{kind}` is no kind of fact", "Kinds: " + ", ".join(KINDS))
    return T.StructType([T.StructField(n, t) for n, t in SCHEMAS[kind]])


def extract(docs: DataFrame, kind: str, id_col: str = "doc_id", body: str = "body", url: str = "url", keyword: str | None = None, site: str | None = None, title: str | None = None, section: int | None = None) -> DataFrame:
    """The facts of one kind in all documents; columns as in ``SCHEMAS``. ``doc`` is ``doc:N``.

    ``title`` names the column whose text heads a table above the first heading.
    """
    schema = _schema(kind)
    columns = [id_col, body, url, *([title] if title else [])]

    def make(key, text, link, heading=None):
        return facts((kind,), text, link, f"doc:{key}", keyword, site, heading, section)[kind]

    return per_document(docs, columns, make, schema)


def extract_all(docs: DataFrame, kinds: tuple[str, ...] = KINDS, id_col: str = "doc_id", body: str = "body", url: str = "url", keyword: str | None = None) -> DataFrame:
    """(kind, doc, section, line, nth, fact) of several kinds in one pass over the documents: ``fact`` holds the fields of
    the kind as JSON, ``nth`` counts the facts of a kind in their document from 1."""
    for k in kinds:
        _schema(k)
    schema = T.StructType([T.StructField(n, t) for n, t in (("kind", _S), ("doc", _S), ("section", _I), ("line", _I), ("nth", _I), ("fact", _S))])

    def make(key, text, link):
        import json

        out = []
        for kind, rows in facts(tuple(kinds), text, link, f"doc:{key}", keyword).items():
            names = [n for n, _ in SCHEMAS[kind]]
            for nth, row in enumerate(rows, 1):
                fields = dict(zip(names, row))
                doc, section, line = (fields.pop(n) for n in ("doc", "section", "line"))
                out.append((kind, doc, section, line, nth, json.dumps(fields, ensure_ascii=False)))
        return out

    return per_document(docs, [id_col, body, url], make, schema)


def named_sources(*args: str) -> list[str]:
    """Source handles in the order they are named: parted at commas, the first of names that differ in case only."""
    out: dict[str, str] = {}
    for part in (p.strip() for a in args for p in a.split(",")):
        if part:
            out.setdefault(part.lower(), part)
    if not out:
        raise EngineError("bad_args", "no source given", "Name documents, such as doc:1,doc:2")
    return list(out.values())


def extract_from(docs: DataFrame, sources: list[str], kind: str, id_col: str = "doc_id", **options) -> DataFrame:
    """The facts of one kind in the documents named by handles, with ``source_no`` from 1 in the order of naming.

    Handles that name no document give no rows. The list is the caller's, so it is joined as a small table.
    """
    rows = [(n, s.lower()) for n, s in enumerate(named_sources(*sources), 1)]
    order = docs.sparkSession.createDataFrame(rows, "source_no int, handle string")
    handle = F.concat(F.lit("doc:"), F.col(id_col).cast("string"))
    wanted = docs.join(F.broadcast(order), handle == F.col("handle"), "left_semi")  # as many rows as the caller names
    found = extract(wanted, kind, id_col, **options)
    return found.join(F.broadcast(order), found["doc"] == F.col("handle")).drop("handle")
