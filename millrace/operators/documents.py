"""Markdown documents as rows: lines, sections, outline, windows, keyword snippets.

Each document is one row and is read in one pass by one task, in batches; nothing is shuffled. Null
bodies have no lines and no sections.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.scanners import readable
from ..session import spread

#: Letters of a section at most, of context on each side of a hit, and snippets of a document at most.
SECTION_CHARS, CONTEXT, SNIPPETS = 6000, 240, 8
_HEADING = regex.compile(r"^\s*(#{1,6}) (.*)$")


def per_document(docs: DataFrame, columns: list[str], make: Callable[..., list[tuple]], schema: T.StructType) -> DataFrame:
    """``make(*values of a row)`` -> rows of ``schema``; the workhorse of all operators on documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            done: list[tuple] = []
            for i in range(b.num_rows):
                done += make(*(c[i] for c in cols))
                if len(done) > 50_000:
                    yield _table(done, kinds)
                    done = []
            yield _table(done, kinds)

    return spread(docs.select(*columns)).mapInArrow(run, schema)


def _table(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, kinds)], schema=kinds)


def heading_of(line: str) -> tuple[int, str] | None:
    m = _HEADING.match(line)
    if not m:
        return None
    return len(m[1]), m[2].strip().rstrip("#").strip() or "(untitled)"


def fenced(lines: list[str]) -> list[bool]:
    """Whether each line opens, closes or lies in a code fence."""
    out, inside = [], False
    for line in lines:
        mark = line.lstrip().startswith(("```", "~~~"))
        out.append(inside or mark)
        inside ^= mark
    return out


def split_sections(body: str, most: int = SECTION_CHARS) -> list[tuple[int, str, int, int, int]]:
    """(index, heading, level, start, end) in letters; putting the sections together gives the body.

    A section over ``most`` letters is parted at its last blank line that fits, else at the limit.
    """
    lines = body.splitlines(keepends=True) if "\r" not in body else regex.findall(r"[^\n]*\n|[^\n]+$", body)
    starts: list[tuple[str, int, int]] = []
    at = 0
    for line, code in zip(lines, fenced(lines)):
        h = None if code else heading_of(line.rstrip("\n"))
        if h:
            starts.append((h[1], h[0], at))
        at += len(line)
    first = starts[0][2] if starts else len(body)
    spans = [("(top)", 0, 0, first)] if body[:first].strip() else []
    spans += [(t, lvl, s, starts[i + 1][2] if i + 1 < len(starts) else len(body)) for i, (t, lvl, s) in enumerate(starts)]
    out = []
    for title, level, start, end in spans:
        cuts, s = [], start
        while end - s > most:
            gap = body.rfind("\n\n", s, s + most)
            cut_at = gap + 2 if gap >= 0 and gap + 2 <= s + most and gap + 2 > s else s + most
            cuts.append((s, cut_at))
            s = cut_at
        if s < end or not cuts:
            cuts.append((s, end))
        for k, (a, b) in enumerate(cuts, 1):
            out.append((len(out) + 1, title if len(cuts) == 1 else f"{title} (part {k}/{len(cuts)})", level, a, b))
    return out


def _field(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema[name].dataType)


def lines(docs: DataFrame, id_col: str = "doc_id", body: str = "body") -> DataFrame:
    """(id, line, section, raw, plain): non-blank lines outside code fences, numbered from 1, as written and as they read."""
    kinds = (("line", T.IntegerType()), ("section", T.IntegerType()), ("raw", T.StringType()), ("plain", T.StringType()))
    schema = T.StructType([_field(docs, id_col), *[T.StructField(n, t) for n, t in kinds]])

    def make(key, text):
        return [(key, n, sec, raw, readable(raw)) for n, sec, raw in numbered_lines(text)]

    return per_document(docs, [id_col, body], make, schema)


def numbered_lines(text: str | None) -> list[tuple[int, int, str]]:
    """(line number, section, raw) of the non-blank lines outside fences."""
    if not text:
        return []
    bounds = [(0, 1)] if "#" not in text and len(text) <= SECTION_CHARS else [(a, i) for i, _, _, a, _ in split_sections(text)]
    rows = text.split("\n")
    out, at, k = [], 0, 0
    for n, (raw, code) in enumerate(zip(rows, fenced(rows)), 1):
        while k + 1 < len(bounds) and bounds[k + 1][0] <= at:
            k += 1
        if raw.strip() and not code:
            out.append((n, bounds[k][1] if bounds else 1, raw.rstrip("\r")))
        at += len(raw) + 1
    return out


def sections(docs: DataFrame, id_col: str = "doc_id", body: str = "body", most: int = SECTION_CHARS) -> DataFrame:
    """(id, section, heading, level, start, chars, text)."""
    schema = T.StructType([_field(docs, id_col), *[T.StructField(n, t) for n, t in (("section", T.IntegerType()), ("heading", T.StringType()), ("level", T.IntegerType()), ("start", T.LongType()), ("chars", T.LongType()), ("text", T.StringType()))]])

    def make(key, text):
        return [(key, i, h, lvl, a, b - a, text[a:b]) for i, h, lvl, a, b in split_sections(text, most)] if text else []

    return per_document(docs, [id_col, body], make, schema)


def outline(docs: DataFrame, id_col: str = "doc_id", body: str = "body") -> DataFrame:
    """(id, section, heading, chars)."""
    return sections(docs, id_col, body).select(id_col, "section", "heading", "chars")


def window(body: Column, offset: int = 0, limit: int = 4000) -> Column:
    """struct<text, next_offset>: ``limit`` letters (100 at least) from ``offset``; next_offset is null at the end."""
    n = max(limit, 100)
    return F.struct(F.substring(body, offset + 1, n).alias("text"), F.when(F.length(body) > offset + n, F.lit(offset + n).cast("bigint")).alias("next_offset"))


def grep(docs: DataFrame, keyword: str, id_col: str = "doc_id", body: str = "body", context: int = CONTEXT, snippets: int = SNIPPETS, budget: int = 4000) -> DataFrame:
    """(id, section, heading, matches, text, total_matches): snippets around the hits of a keyword,
    without case; windows that touch are one; at most ``snippets`` of a document, ``budget`` letters in all."""
    needle = keyword.strip().lower()
    if not needle:
        raise EngineError("bad_args", "the keyword is empty")
    kinds = (("section", T.IntegerType()), ("heading", T.StringType()), ("matches", T.IntegerType()), ("text", T.StringType()), ("total_matches", T.IntegerType()))
    schema = T.StructType([_field(docs, id_col), *[T.StructField(n, t) for n, t in kinds]])

    def make(key, text):
        if not text:
            return []
        found, total, left = [], 0, budget
        for i, title, _, a, b in split_sections(text):
            part = text[a:b]
            low = "".join(c.lower()[:1] or c for c in part)
            spots, at = [], low.find(needle)
            while at >= 0:
                spots.append(at)
                at = low.find(needle, at + len(needle))
            total += len(spots)
            joined: list[list[int]] = []
            for s in spots:
                lo, hi = max(0, s - context), min(len(part), s + len(needle) + context)
                if joined and lo <= joined[-1][1]:
                    joined[-1][1:] = [hi, joined[-1][2] + 1]
                else:
                    joined.append([lo, hi, 1])
            for lo, hi, n in joined:
                if len(found) >= snippets or left < min(120, budget):
                    continue
                hi = min(hi, lo + left)
                left -= hi - lo
                found.append((i, title, n, ("…" if lo else "") + " ".join(part[lo:hi].split()) + ("…" if hi < len(part) else "")))
        return [(key, *f, total) for f in found]

    return per_document(docs, [id_col, body], make, schema)
