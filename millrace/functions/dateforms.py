"""Written forms of dates, stated once: a scanner of running text, a reader of whole texts and Column patterns come from the same table.

A form is a template. ``Y`` is a year of four digits, ``C`` one of this or the last century, ``E`` a year of
the Minguo era, ``M`` a month and ``D`` a day in digits, ``O`` a day with or without its English ending,
``N`` an English month name; ``~`` is optional white space, ``_`` white space; the rest stands for itself.
"""

from __future__ import annotations

import datetime
import re

#: Month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_FULL = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: The forms in their order of priority; where two overlap the first counts.
FORMS = {
    "era": "民國~E~年~M~月(?:~D~[日號号])?",
    "han": "Y~年~M~月(?:~D~[日號号])?",
    "iso": "CsMsDt",
    "month first": r"N\.?_O,?_Y",
    "day first": r"O_(?:of_)?N\.?,?_Y",
    "digits": "M/D/C",
    "month": r"N\.?,?_C",
}
#: Years that the first year of an era follows.
ERA_START = 1911
_PIECES = {
    "~": r"\s*", "_": r"\s+", "Y": r"(\d{4})", "C": r"((?:19|20)\d\d)", "E": r"(\d{2,3})", "M": r"(\d\d?)", "D": r"(\d\d?)", "O": r"(\d\d?)(?:st|nd|rd|th)?",
    "N": "(" + "|".join(f"{m[:3]}(?:t(?:{m[4:]})?)?" if m == "September" else f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in _FULL) + ")",
}


def _compiled(form: str) -> tuple[str, str]:
    """(pattern, the field of each of its groups)."""
    pattern, fields, escaped = "", "", False
    for c in FORMS[form]:
        if escaped or c not in _PIECES and c not in "st":
            pattern += c
        elif c == "s":  # the same mark both times; it is a group of its own
            pattern += r"([-/.])" if "s" not in fields else r"\2"
            fields += "" if "s" in fields else "s"
        elif c == "t":
            pattern += r"(?:T\d\d:\d\d(?::\d\d)?(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)?)?"
        else:
            pattern += _PIECES[c]
            fields += c if c.isalpha() else ""
        escaped = c == "\\" and not escaped
    return pattern, fields


#: Pattern and fields of each form; the patterns mean the same to Python and to the JVM.
PATTERNS = {form: _compiled(form) for form in FORMS}
_WORD = {form: re.compile(rf"\b{p}\b" if form not in ("era", "han") else p) for form, (p, _) in PATTERNS.items()}
_WHOLE = {form: re.compile(p) for form, (p, _) in PATTERNS.items()}
#: What a text must hold for a form to be tried.
_HINT = {"era": re.compile("民國"), "han": re.compile("年"), "iso": re.compile(r"\d[-/.]\d"), "digits": re.compile(r"\d/\d")}
_NAMED = re.compile("|".join(m[:3] for m in _FULL))
_MAYBE = re.compile(r"\d{4}|民國")


def read(form: str, groups: tuple) -> tuple[str, str, bool] | None:
    """(ISO date, 'day' or 'month', whether month and day could be swapped), or None if there is no such day."""
    got = {k: v for k, v in zip(PATTERNS[form][1], groups) if v and k != "s"}
    year = int(got["E"]) + ERA_START if "E" in got else int(got.get("Y") or got["C"])
    month = MONTHS.index(got["N"][:3].lower()) + 1 if "N" in got else int(got["M"])
    written = got.get("D") or got.get("O")
    if not written:
        return (f"{year:04d}-{month:02d}", "month", False) if 1 <= month <= 12 and 1000 <= year <= 9999 else None
    day = int(written)
    unsure = form == "digits" and month <= 12 and day <= 12 and month != day
    if form == "digits" and month > 12:
        month, day = day, month
    try:
        return datetime.date(year, month, day).isoformat(), "day", unsure
    except ValueError:
        return None


def scan(text: str) -> list[tuple[str, str, bool, str, int, int]]:
    """(ISO date, precision, unsure, raw, start, end) of the dates in a text, in their order."""
    if not _MAYBE.search(text):
        return []
    taken: list[tuple] = []
    named = bool(_NAMED.search(text))
    for form, pattern in _WORD.items():
        if not (_HINT[form].search(text) if form in _HINT else named):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if all(b <= x[4] or a >= x[5] for x in taken) and (date := read(form, m.groups())):
                taken.append((*date, m[0], a, b))
    return sorted(taken, key=lambda x: x[4])


def whole(text: str) -> str | None:
    """The ISO date or month of a text that is one date and nothing else."""
    for form, pattern in _WHOLE.items():
        if m := pattern.fullmatch(text):
            date = read(form, m.groups())
            return date[0] if date else None
    return None
