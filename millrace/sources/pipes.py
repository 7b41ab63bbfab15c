"""Pipe tables in Markdown texts: header, separator row, data rows; escaped pipes; not in code fences."""

from __future__ import annotations

import re

from ..functions.names import clean_headers

_BAR = re.compile(r"(?<!\\)\|")
_RULE = re.compile(r"^:?-{1,}:?$")


def cells_of(line: str) -> list[str]:
    """The cells of a table row, without escapes."""
    s = line.strip()
    s = s[1:] if s.startswith("|") else s
    if s.endswith("|") and not s.endswith("\\|"):
        s = s[:-1]
    return [c.strip().replace("\\|", "|") for c in _BAR.split(s)]


def _is_rule(line: str) -> bool:
    return "-" in line and "|" in line and all(_RULE.match(c) for c in cells_of(line) if c) and any(cells_of(line))


def squared(header: list[str], rows: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """Clean names and rows of one width: short rows padded, columns added for long ones."""
    wide = max([len(header), *map(len, rows)], default=0)
    names = clean_headers([*header, *[""] * (wide - len(header))])
    return names, [[*r, *[""] * (wide - len(r))] for r in rows]


def find_tables(text: str) -> list[tuple[list[str], list[list[str]], int]]:
    """(columns, rows, line of the header from 1) of each table."""
    lines, out, fence, i = text.split("\n"), [], False, 0
    while i < len(lines):
        s = lines[i].strip()
        if s.startswith(("```", "~~~")):
            fence = not fence
        elif not fence and "|" in s and i + 1 < len(lines) and _is_rule(lines[i + 1]) and not _is_rule(s):
            j, rows = i + 2, []
            while j < len(lines) and "|" in lines[j] and lines[j].strip() and not lines[j].strip().startswith(("```", "~~~")):
                rows.append(cells_of(lines[j]))
                j += 1
            names, body = squared(cells_of(s), rows)
            out.append((names, body, i + 1))
            i = j
            continue
        i += 1
    return out
