"""Scanners of one line of text: readable text, quantities (prices, numbers with units), people, links, addresses.

A line is cut into tokens once: words, runs of digits, single marks and single Han or kana letters. Numbers are
found first; what stands around a number says whether it is money and what it is counted in. People are
found from the roles a line names, which most lines do not.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

import regex

from .cells import CODES, DOLLAR_OF, MAGNITUDES, SIGNS, SYNONYMS, YUAN_OF

# ---------------------------------------------------------------- readable text

_MARKED = re.compile(r"[#>*+\-\\\[\]_`|]")
_LEAD = re.compile(r"(?:#{1,6}\s+)?(?:> )?(?:[-*+]\s+)?")
#: Marks of references in encyclopedia text, also with escaped brackets.
_REFERENCE = r"\\?\[(?:\d{1,3}|[a-z]|note \d+|citation needed|update)\\?\](?!\()"
_INLINE = re.compile(rf"{_REFERENCE}|!?\[((?:\\.|[^\]\\])*)\]\([^)]*\)|\\([\\`*_{{}}()#+\-.!<>~\[\]])")
_EMPHASIS = str.maketrans({"`": None})


def readable(raw: str) -> str:
    """A Markdown line as it reads: link texts for links; marks of headings, quotes, lists, emphasis, references and tables dropped."""
    text = raw.strip()
    if _MARKED.search(text):
        text = _INLINE.sub(_shown, text[_LEAD.match(text).end() :])
        text = text.replace("**", "").replace("__", "").translate(_EMPHASIS)
        if text[:1] == "|":
            text = text.strip("|")
        text = text.replace("\\|", "|")
    return " ".join(text.split())


def _shown(m: re.Match) -> str:
    if m[1] is not None:
        return _INLINE.sub(_shown, m[1])
    return m[2] or ""


def clip(text: str, start: int, end: int, most: int) -> str:
    """The part of ``text`` of about ``most`` letters that has a hit in its middle, with ellipses where it was cut."""
    spare = most - (end - start)
    if len(text) <= most:
        return text.strip()
    first = min(start - max(0, spare) // 2, len(text) - max(most, end - start))
    last = max(0, first) + max(most, end - start)
    body = text[max(0, first) : last].strip()
    return "…" * (first > 0) + body + "…" * (last < len(text))


# ---------------------------------------------------------------- tokens

_TOKEN = re.compile(r"[0-9]+|[⺀-꓏가-힯豈-﫿]|[^\W\d_⺀-꓏가-힯豈-﫿]+|[^\s]")
_DIGITS = re.compile(r"[0-9]")


class Tokens:
    """The tokens of a line: ``word[i]`` from ``at[i]``; ``gap(i)`` tells whether white space stands before token i."""

    __slots__ = ("at", "text", "word")

    def __init__(self, text: str) -> None:
        self.text = text
        self.word: list[str] = []
        self.at: list[int] = []
        for m in _TOKEN.finditer(text):
            self.word.append(m[0])
            self.at.append(m.start())

    def end(self, i: int) -> int:
        """Where token i ends."""
        return self.at[i] + len(self.word[i])

    def gap(self, i: int) -> int:
        """Letters of white space before token i."""
        return self.at[i] - (self.end(i - 1) if i else 0)

    def get(self, i: int) -> str:
        return self.word[i] if 0 <= i < len(self.word) else ""

    def number(self, i: int, comma: bool) -> tuple[int, float]:
        """(next token, value) of the number at token i: groups of three behind commas, a fraction behind
        a point, or, with ``comma``, two digits behind a comma."""
        whole, fraction, j = self.word[i], "", i + 1
        if len(whole) <= 3:
            while self._joined(j, ",") and len(self.word[j + 1]) == 3:
                whole += self.word[j + 1]
                j += 2
        if self._joined(j, "."):
            fraction, j = self.word[j + 1], j + 2
        elif comma and j == i + 1 and self._joined(j, ",") and len(self.word[j + 1]) == 2:
            fraction, j = self.word[j + 1], j + 2
        return j, float(f"{whole}.{fraction or 0}")

    def _joined(self, j: int, mark: str) -> bool:
        return j + 1 < len(self.word) and self.word[j] == mark and self.word[j + 1][0] in "0123456789" and not self.gap(j) and not self.gap(j + 1)

    def glued(self, i: int) -> bool:
        """Whether token i is a letter or digit right after token i - 1."""
        return i < len(self.word) and not self.gap(i) and (self.word[i][0].isalnum() or self.word[i][0] == "_")


def currency(sign: str, host: str = "") -> str | None:
    """ISO code of a sign, code or word; bare signs by the country of the host."""
    land, up = host.rpartition(".")[2], sign.strip().upper()
    if up in ("$", "DOLLAR", "DOLLARS"):
        return DOLLAR_OF.get(land, "USD")
    if up in ("¥", "元"):
        return ("CNY" if land == "cn" else "JPY") if up == "¥" else YUAN_OF.get(land, "CNY")
    return SYNONYMS.get(up) or (up if up in CODES else SIGNS.get(up))


# ---------------------------------------------------------------- prices

_CODES, _AFTER = frozenset(CODES), frozenset([*CODES, "€", "元", "円"])
_PRE_SIGNS = frozenset(SIGNS) - {"元", "円"}
#: Magnitudes of prices.
_PRICE_MAGNITUDES = frozenset("thousand million billion mn bn k K M B 萬 万 億 亿".split())
#: What the words after a price mean: a time span or a counting unit.
SPANS = {
    "month": "month", "mo": "month", "monthly": "month", "月": "month", "year": "year", "yr": "year", "annum": "year", "annually": "year", "yearly": "year",
    "年": "year", "week": "week", "wk": "week", "weekly": "week", "週": "week", "周": "week", "day": "day", "daily": "day", "天": "day", "hour": "hour", "hr": "hour", "小時": "hour",
    "one-time": "one-time", "once": "one-time", "lifetime": "one-time",
}
COUNTED = {"user": "user", "member": "user", "agent": "user", "人": "user", "位": "user", "seat": "seat", "席": "seat", "device": "device", "host": "device", "gb": "GB", "tb": "TB", "mb": "MB"}
#: Words that lead to a unit, words that are one by themselves, and what may stand before these.
_LEADING, _ALONE, _PAID = frozenset("per a an each every".split()), frozenset("monthly annually yearly once lifetime weekly daily".split()), frozenset(("billed", "paid"))
_HAN_UNITS = frozenset("月年人位席天週周")


def _unit_at(t: Tokens, i: int) -> tuple[str, int] | None:
    """(unit word, next token) of what leads from a price to a unit at token i."""
    w, n = t.get(i).lower(), t.get(i + 1).lower()
    if w in ("/", "每"):
        if n in _HAN_UNITS:
            return n, i + 2
        if n == "小" and t.get(i + 2) == "時":
            return "小時", i + 3
    if w == "/" or (w in _LEADING and t.gap(i + 1) if i + 1 < len(t.word) else False):
        unit = next((u for u in (n, n.removesuffix("s")) if (u in SPANS or u in COUNTED) and u.isascii() and u not in _ALONE), None)
        if unit and not (t.glued(i + 2) and t.get(i + 2) != "."):
            return unit, i + 2 + (t.get(i + 2) == "." and not t.gap(i + 2) and (i + 3 == len(t.word) or t.glued(i + 3)))
    j = i + (w == ",")
    j += t.get(j).lower() in _PAID
    w = t.get(j).lower()
    if w == "one" and (t.get(j + 1) == "-" or t.get(j + 1).lower() == "time"):
        k = j + 1 + (t.get(j + 1) == "-")
        return ("one-time", k + 1) if t.get(k).lower() == "time" and not t.glued(k + 1) else None
    if w == "per" and t.get(j + 1).lower() == "annum":
        return "annum", j + 2
    return (w, j + 1) if w in _ALONE and not t.glued(j + 1) else None


def _sign_before(t: Tokens, i: int) -> tuple[int, str] | None:
    """(first token, sign) of the money that a number at token i starts with."""
    w = t.get(i - 1)
    if not w or t.gap(i) > 1:
        return None
    if w in _CODES:
        left = t.text[t.at[i - 1] - 1 : t.at[i - 1]]
        return None if left.isalnum() or left == "_" else (i - 1, w)
    if w == "$":
        left = t.get(i - 2) if i > 1 and not t.gap(i - 1) else ""
        known = next((left[-n:] for n in (2, 1) if left[-n:] + "$" in SIGNS and len(left) >= n), None) if left else None
        if known:
            return i - 2, known + "$"
        return None if left[-1:].isascii() and left[-1:].isalnum() else (i - 1, "$")
    return (i - 1, w) if w in _PRE_SIGNS else None


def prices(text: str, host: str = "") -> list[tuple]:
    """(value, currency, period, per, raw, start, end); of a range the low end."""
    out: list[tuple] = []
    if not _DIGITS.search(text):
        return out
    t = Tokens(text)
    i = 0
    while i < len(t.word):
        if not t.word[i][0].isdigit() or not t.word[i].isascii():
            i += 1
            continue
        j, value = t.number(i, comma=True)
        before, sign, start = _sign_before(t, i), None, t.at[i]
        if before:
            sign, start = before[1], t.end(i - 1) - len(before[1])
            if t.get(j) in _PRICE_MAGNITUDES and t.gap(j) <= 1 and (t.get(j) in "萬万億亿" or not t.glued(j + 1)):
                value, j = value * MAGNITUDES[t.word[j]], j + 1
        elif j < len(t.word) and t.gap(j) <= 1 and (t.word[j] in _AFTER or t.word[j].lower() in ("dollars", "euros")) and (t.word[j] in "€元円" or not t.glued(j + 1)):
            sign, j = t.word[j], j + 1
        if sign is None:
            i = j
            continue
        i = j  # the search goes on here; what follows only describes this price
        if t.get(j) in ("–", "—", "-", "to"):  # the high end of a range
            k = j + 1
            k += t.get(k) in ("$", "€", "£") or (t.get(k) == "US" and t.get(k + 1) == "$") * 2
            if t.get(k)[:1].isdigit():
                j = t.number(k, comma=False)[0]
        if t.get(j) in _CODES and not t.glued(j + 1):
            j += 1
        period = per = None
        for _ in range(4):
            found = _unit_at(t, j)
            if not found:
                break
            period, per, j = period or SPANS.get(found[0]), per or COUNTED.get(found[0]), found[1]
        end = t.end(j - 1)
        out.append((value, currency(sign, host), period, per, text[start:end].strip(), start, end))
    return out


# ---------------------------------------------------------------- numbers

#: One name for each unit of time, weight and length; counted things in lower case.
UNIT_NAMES = {
    "percent": "%", "×": "x", "sec": "seconds", "secs": "seconds", "second": "seconds", "seconds": "seconds", "min": "minutes", "mins": "minutes", "minute": "minutes", "minutes": "minutes",
    "hr": "hours", "hrs": "hours", "hour": "hours", "hours": "hours", "day": "days", "days": "days", "week": "weeks", "weeks": "weeks", "month": "months", "months": "months",
    "yr": "years", "yrs": "years", "year": "years", "years": "years", "mile": "miles", "miles": "miles",
}
COUNTS = frozenset("users customers employees people downloads stars subscribers members companies countries cores tokens pages parameters gpus".split())
_EXACT_UNITS = frozenset(
    [p + i + "B" + s for p in "KMGTP" for i in ("", "i") for s in ("", "ps")] + [p + "bps" for p in "KMGT"] + [p + "Hz" for p in ("k", "M", "G", "")]
    + [p + u for p in ("k", "M", "G", "T", "") for u in ("Wh",)] + [p + "W" for p in "kMGT"] + "x ms km cm mm kg lb lbs".split())
_GLUED_MAGNITUDES, _WORD_MAGNITUDES = frozenset("kKMBT"), ("trillion", "billion", "million", "thousand", "tn", "bn", "mn", "萬", "万", "億", "亿", "兆")


def _unit_of(t: Tokens, i: int) -> tuple[str, int] | None:
    """(unit, next token) at token i, at most one space away."""
    w = t.get(i)
    if not w or t.gap(i) > 1:
        return None
    if w in ("%", "×"):
        return UNIT_NAMES.get(w, w), i + 1
    if w == "°":
        return ("°" + t.get(i + 1), i + 2) if t.get(i + 1) in ("C", "F") and not t.gap(i + 1) else None
    low = w.lower()
    if low == "per" and t.get(i + 1).lower() == "cent" and not t.glued(i + 2):
        return "%", i + 2
    if t.glued(i + 1):
        return None
    if w in _EXACT_UNITS:
        return {"lbs": "lb"}.get(w, w), i + 1
    if low in COUNTS:
        return low, i + 1
    return (UNIT_NAMES[low], i + 1) if low in UNIT_NAMES else None


def numbers(text: str, host: str = "") -> list[tuple]:
    """(value, unit, raw, start, end) of numbers with a unit, percent sign or magnitude."""
    out: list[tuple] = []
    if not _DIGITS.search(text):
        return out
    t = Tokens(text)
    i = 0
    while i < len(t.word):
        if not t.word[i][0].isdigit() or not t.word[i].isascii():
            i += 1
            continue
        first, at = i, t.at[i]
        i, value = t.number(i, comma=False)
        sign = t.get(first - 1) if first and not t.gap(first) and t.get(first - 1) in ("$", "€", "£", "¥") else ""
        start = at - len(sign)
        if sign == "$" and text[max(0, start - 2) : start] == "US":
            sign, start = "US$", start - 2
        if not sign and at and (text[at - 1].isalnum() or text[at - 1] in "._"):
            continue
        magnitude = None
        if t.get(i) in _GLUED_MAGNITUDES and not t.gap(i) and not t.glued(i + 1):
            magnitude, i = t.word[i], i + 1
        elif i < len(t.word) and t.gap(i) <= 1:
            magnitude = next((m for m in _WORD_MAGNITUDES if t.word[i] in (m, m + "s")), None)
            i += magnitude is not None
        found = _unit_of(t, i)
        if found:
            unit, i = found
        elif magnitude is None:
            continue
        else:
            unit = currency(sign, host) if sign else None
        end = t.end(i - 1)
        out.append((value * MAGNITUDES.get(magnitude or "", 1.0), unit, text[start:end].strip(), start, end))
    return out


# ---------------------------------------------------------------- links and addresses

#: Shapes of Markdown links, of bare URLs and of e-mail addresses.
_LINK = re.compile(r'\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)')
_BARE_URL = re.compile(r"""https?://[^\s<>()\[\]"'`]+""")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
#: Endings of file names that look like addresses; targets of links that are no pages.
_IMAGES, _NO_PAGES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp"), ("mailto:", "#", "javascript:")


def absolute(target: str, base: str | None) -> str:
    """The target as an http(s) URL, '' if it is none."""
    if target.startswith(_NO_PAGES):
        return ""
    if not target.startswith(("http://", "https://")):
        try:
            target = urljoin(base, target) if base else ""
        except ValueError:
            return ""
    return target if target.startswith(("http://", "https://")) else ""


def links(raw: str, base: str | None = None) -> list[tuple[str, str]]:
    """(text, URL) of the Markdown links of a line, then of its bare URLs."""
    if "](" not in raw and "://" not in raw:
        return []
    marked = list(_LINK.finditer(raw))
    out = [(readable(m[1]), url) for m in marked if (url := absolute(m[2], base))]
    blank = raw
    for m in marked:
        blank = blank[: m.start()] + " " * len(m[0]) + blank[m.end() :]
    return out + [("", u.rstrip(".,;:!?")) for u in _BARE_URL.findall(blank)]


def addresses(text: str) -> list[tuple[str, int, int]]:
    """(e-mail address, start, end)."""
    return [(m[0], m.start(), m.end()) for m in _ADDRESS.finditer(text) if not m[0].lower().endswith(_IMAGES)] if "@" in text else []


# ---------------------------------------------------------------- people

#: Roles by themselves, roles that may name a field, words before roles; Chinese roles.
LONE_ROLES = ("co-founder", "cofounder", "founder", "owner", "president", "chairman", "chairwoman", "chairperson", "chair", "vice chairman", "vice-chairman", "vice chairwoman", "vice-chairwoman",
              "vice chairperson", "vice-chairperson", "vice chair", "vice-chair", "ceo", "cfo", "cto", "coo", "cio", "cmo", "cpo", "cro", "cso", "ciso", "general manager", "managing partner", "partner",
              "chief economist", "chief scientist", "chief architect", "editor-in-chief", "principal")
FIELD_ROLES = ("senior vice president", "executive vice president", "vice president", "sevp", "svp", "evp", "vp", "head", "executive director", "non-executive director", "managing director", "director",
               "prime minister", "minister", "secretary-general", "secretary", "governor", "mayor", "senator", "commissioner", "chancellor", "dean", "professor")
ROLE_MODIFIERS = ("current", "former", "new", "interim", "acting", "incoming", "outgoing")
HAN_ROLES = ("共同創辦人", "創辦人", "副董事長", "董事長", "執行長", "總經理", "財務長", "技術長", "營運長", "副總裁", "總裁", "總監", "部長", "院長", "市長", "主席", "首席執行官", "CEO")
#: Words that no name has, that no organisation starts with, and letters that no Chinese name has.
NO_NAME = frozenset((
    "The A An Our Their His Her Its This That These Those Today Yesterday Meanwhile However According When After Before In On At As And But Also Then Meet Former Current Interim Acting New Chief "
    "Executive Officer President Vice Senior Director Founder Chair Chairman Head Board Team Company Group Inc Corp Corporation University Department Ministry Minister Secretary Governor Mayor Senator "
    "Says Said Mr Ms Mrs Dr Sir Read More January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Partner Owner "
    "Global Technology Technologies Systems Holdings Bank Capital Labs News").split())
NO_ORG = frozenset("The A An Our Meanwhile However Today In On At As And But Former Current New Interim Acting".split())
NO_HAN_NAME = frozenset("的是在了表示說说也將将與与和及為为等就都而指出認今昨曾已")
#: Small words inside names, verbs and articles that lead from a name to a role.
_PARTICLES = frozenset("van von de der den da di du del la le bin al".split())
_BEING, _ARTICLES = ("is", "was", "serves as", "served as", "became", "has been", "remains"), ("the", "a", "an", "its")

#: Shapes of a capitalised run (an organisation) and of a word of a name.
_TITLE_RUN = r"\p{Lu}[\p{L}\d&.'’-]*(?:\s+(?:&\s+)?\p{Lu}[\p{L}\d&.'’-]*){0,3}"
_NAME_WORD = regex.compile(r"(?:Mc|Mac|O')?\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?")
_spaced = lambda words: "|".join(regex.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=len, reverse=True))
_ONE_ROLE = rf"(?:(?i:{_spaced(FIELD_ROLES)})(?:\s+(?i:of|for)\s+(?:the\s+)?{_TITLE_RUN})?|(?i:{_spaced(LONE_ROLES)}|chief\s+[a-z]+(?:\s+[a-z]+)?\s+officer))"
_ROLES = regex.compile(rf"(?<!\p{{L}}){_ONE_ROLE}(?:\s*(?:,|and|&)\s*{_ONE_ROLE}){{0,3}}")
_ROLE_WORD = re.compile("|".join(sorted({regex.split(r"[ -]", r)[-1] for r in (*LONE_ROLES, *FIELD_ROLES)} | {"officer"}, key=len, reverse=True)), re.I)
_NAME_WORDS = regex.compile(rf"{_NAME_WORD.pattern}(?:\s+\p{{Lu}}\.)?(?:\s+(?:(?:{'|'.join(sorted(_PARTICLES))})\s+){{0,2}}{_NAME_WORD.pattern}){{1,2}}")
_ORG_AFTER = regex.compile(rf",?\s+(?:of|at)\s+(?:the\s+)?({_TITLE_RUN})")
_ORG_IN = regex.compile(rf"(?:,\s*|\s+(?:of|at)\s+)(?:the\s+)?({_TITLE_RUN})(?=\))")
_ORG_BEFORE = regex.compile(rf"({_TITLE_RUN})(?:'s|’s)?\s+$")
_MODIFIER = regex.compile(rf"(?:(?i:{'|'.join(ROLE_MODIFIERS)})\s+)$")
#: How sure a name before a role is, by what stands between them.
_BETWEEN = (
    (0.9, regex.compile(rf",?\s+(?:{_spaced(_BEING)})\s+(?:also\s+)?(?:(?:{'|'.join(_ARTICLES)})\s+)?")),
    (0.8, regex.compile(r",\s+(?:(?:the|its)\s+)?")),
    (0.8, regex.compile(r"\s*\(")),
    (0.6, regex.compile(r"\s*(?:[—–|:]|\s-\s)\s*")),
)
_HAN_PERSON = regex.compile(rf"({'|'.join(HAN_ROLES)})\s?(\p{{Han}}{{2,3}})")


def _cleaned(raw: str, bad: frozenset) -> list[str]:
    words = raw.split()
    while words and words[0].rstrip(".") in bad:
        words.pop(0)
    return words


def _name(raw: str) -> str | None:
    words = _cleaned(raw, NO_NAME)
    return " ".join(words) if len(words) > 1 and not any(w.rstrip(".") in NO_NAME for w in words) else None


def _organisation(raw: str | None) -> str | None:
    return " ".join(_cleaned(regex.sub(r"['’]s$", "", (raw or "").strip().rstrip(".,;:")), NO_ORG)) or None


def people(text: str) -> list[tuple]:
    """(name, role, org, confidence, start, end); a name comes once for each role and place, the surest reading first."""
    hits: list[tuple] = []
    if _ROLE_WORD.search(text):
        names = [m for m in _NAME_WORDS.finditer(text)]
        for role in _ROLES.finditer(text):
            hits += _around_role(text, role, names)
    hits += [(m[2], m[1], None, 0.5, *m.span()) for m in _HAN_PERSON.finditer(text) if NO_HAN_NAME.isdisjoint(m[2])]
    out: list[tuple] = []
    for h in sorted(hits, key=lambda h: (-h[3], h[4])):
        if not any(h[0].lower() == o[0].lower() and (h[1].lower() == o[1].lower() or (h[4] < o[5] and o[4] < h[5])) for o in out):
            out.append(h)
    return sorted(out, key=lambda h: h[4])


def _around_role(text: str, role: regex.Match, names: list) -> list[tuple]:
    """People that one mention of a role belongs to: a name before it, a name after it."""
    a, b = role.span()
    said = " ".join(role[0].split())
    lead = m.start() if (m := _MODIFIER.search(text, max(0, a - 20), a)) else a
    found = []
    # the end of a name may be a word of a longer run, so the last name that ends before the role counts
    before = next((n for n in reversed(names) if n.end() <= lead), None)
    if before:
        for sure, link in _BETWEEN:
            reach = a if sure == 0.6 else lead  # a dash or colon leads to the bare role
            if not link.fullmatch(text, before.end(), reach):
                continue
            opened = text[before.end() : reach].strip() == "("
            org = (_ORG_IN if opened else _ORG_AFTER).match(text, b)
            end = org.end() if org else b
            if opened:
                if text[end : end + 1] != ")":
                    break
                end += 1
            if name := _name(before[0]):
                found.append((name, said, _organisation(org[1] if org else None), sure, before.start(), end))
            break
    after = regex.match(r"\s+|\s*[:：]\s*", text, pos=b)
    if after and (n := _NAME_WORDS.match(text, after.end())) and (name := _name(n[0])):
        if after[0].strip():
            found.append((name, said, None, 0.6, a, n.end()))
        else:
            org = _ORG_BEFORE.search(text, 0, lead)
            found.append((name, said, _organisation(org[1] if org else None), 0.7, org.start() if org else lead, n.end()))
    return found
