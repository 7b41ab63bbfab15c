"""Column names of loosely typed tables: cleaning headers, finding a column, suggesting the nearest."""

from __future__ import annotations

from ..errors import EngineError


def clean_headers(raw: list[str | None]) -> list[str]:
    """Trimmed names without a byte order mark; ``columnN`` for empty ones, ``_2``, ``_3`` for repeated ones."""
    out, seen = [], set()
    for i, h in enumerate(raw, 1):
        name = (h or "").replace("﻿", "").strip() or f"column{i}"
        unique, k = name, 1
        while unique.lower() in seen:
            k += 1
            unique = f"{name}_{k}"
        seen.add(unique.lower())
        out.append(unique)
    return out


def _folded(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def distance(a: str, b: str) -> int:
    """Edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def nearest(name: str, options: list[str]) -> str | None:
    """The option a person may have meant: one contains the other, or few edits apart."""
    n = _folded(name)
    scored = []
    for i, o in enumerate(options):
        f = _folded(o)
        d = 0 if n and f and (n in f or f in n) else distance(n, f)
        if d <= max(2, max(len(n), 3) // 2):
            scored.append((d, i, o))
    return min(scored)[2] if scored else None


def resolve(columns: list[str], name: str) -> str:
    """The column called ``name``: exactly, then without case, then by letters and digits only."""
    wanted = name.strip().strip("\"'`")
    for same in (lambda c: c == wanted, lambda c: c.lower() == wanted.lower(), lambda c: bool(_folded(wanted)) and _folded(c) == _folded(wanted)):
        for c in columns:
            if same(c):
                return c
    near = nearest(wanted, columns)
    raise EngineError(
        "unknown_column", f"no column named `{wanted}`; columns are: {', '.join(columns)}",
        f"Did you mean `{near}`?" if near else "Use one of the listed columns", column=wanted)
