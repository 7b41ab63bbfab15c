"""Results as text: CSV, TSV, Markdown, JSON; changes shown as a diff before they are applied.

Texts of whole files are for results that fit the driver; ``write_csv`` writes any size as a folder.
"""

from __future__ import annotations

import csv
import difflib
import io
import json
from pathlib import Path

from pyspark.sql import DataFrame

from ..errors import EngineError

#: Rows that a text of a result may have; beyond it ``write_csv`` is the way.
MOST_ROWS = 200_000


def _rows(df: DataFrame) -> list[list]:
    got = df.limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise EngineError("too_large", f"more than {MOST_ROWS} rows", "Use write_csv")
    return [list(r) for r in got]


def _text(v) -> str:
    return "" if v is None else json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (list, dict)) else str(v).lower() if isinstance(v, bool) else str(v)


def csv_text(df: DataFrame, sep: str = ",") -> str:
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator="\n")
    w.writerow(df.columns)
    w.writerows([_text(v) for v in r] for r in _rows(df))
    return out.getvalue()


def markdown_text(df: DataFrame) -> str:
    cell = lambda v: _text(v).replace("|", "\\|").replace("\r", "").replace("\n", " ")
    line = lambda r: "| " + " | ".join(cell(v) for v in r) + " |"
    return "\n".join([line(df.columns), "|" + " --- |" * len(df.columns), *map(line, _rows(df))]) + "\n"


def checklist_text(issues: DataFrame) -> str:
    """The issues of reports (severity, rule, line, message) as a Markdown list to tick off, errors first, in order of their lines."""
    box = lambda r: f"- [ ] **{r['severity']}** {r['rule']}" + (f" (line {r['line']})" if r["line"] is not None else "") + f": {r['message']}"
    rows = issues.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise EngineError("too_large", f"more than {MOST_ROWS} rows", "Use write_csv")
    return "".join(box(r) + "\n" for r in sorted(rows, key=lambda r: (r["severity"] != "error", r["line"] is None, r["line"] or 0, r["rule"]))) or "- [x] no issues\n"


def json_text(df: DataFrame) -> str:
    return json.dumps([dict(zip(df.columns, r)) for r in _rows(df)], ensure_ascii=False, indent=2, default=str)


def render(df: DataFrame, form: str = "json") -> str:
    """A result in one of the forms csv, tsv, md, json."""
    made = {"csv": csv_text, "tsv": lambda d: csv_text(d, "\t"), "md": markdown_text, "json": json_text}.get(form)
    if made is None:
        raise EngineError("bad_args", f"`{form}` is no form", "Forms: csv, tsv, md, json")
    return made(df)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """A folder of CSV files, quoted where needed."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"')


def put(path: str, text: str, apply: bool = False) -> str:
    """The unified diff that writing ``text`` makes; the file changes only with ``apply``."""
    p = Path(path)
    old = p.read_text() if p.exists() else ""
    diff = "".join(difflib.unified_diff(old.splitlines(keepends=True), text.splitlines(keepends=True), f"a/{p.name}", f"b/{p.name}"))
    if apply:
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return diff


def attribution(path: str, rows: list[tuple[str, str, str]]) -> None:
    """A file of (source, licence, address), written anew on every import."""
    Path(path).write_text("".join(f"{a}\t{b}\t{c}\n" for a, b, c in sorted(set(rows))))
