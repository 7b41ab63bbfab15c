"""Grading of Markdown reports against declarative templates: one pass for each report, issue rows out."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..sources.pipes import _is_rule, cells_of
from .documents import per_document

#: What an error and a warning cost, of 100; other headings of the sources section.
ERROR, WARNING = 12, 4
SOURCE_HEADINGS = ("sources", "source", "references", "reference", "bibliography", "citations", "links", "參考資料", "資料來源", "來源", "參考來源", "参考资料")
_CJK = r"぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
_WORD = re.compile(rf"[{_CJK}]|(?:(?![{_CJK}_])\w)(?:['’.,-]*(?:(?![{_CJK}_])\w))*")
_URL = re.compile(r"https?://[^\s)>\"<\]|]*")


def words_in(text: str) -> int:
    t = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.S)
    t = re.sub(r"\]\((?:<[^)]*|[^)\s]*)\)", "]", t)
    return sum(len(_WORD.findall(w)) for w in t.split() if not w.startswith(("http://", "https://")))


def urls_in(text: str) -> list[str]:
    t = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.S)
    return [u for u in (m.rstrip(".,;:!?'") for m in _URL.findall(t)) if len(u) > 8]


def citations_in(text: str) -> dict[str, int]:
    t = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.S)
    t = "\n".join(x for x in t.split("\n") if not (x.lstrip().startswith("[^") and "]:" in x))
    return {
        "inline": len(re.findall(r"\]\(<?http|(?<!\]\()<http", t)), "footnote": len(re.findall(r"\[\^[^\]\n]+\](?!:)", t)),
        "numbered": len(re.findall(r"(?<![\]!])\[\s*\d+\s*(?:,\s*\d+\s*)*\](?![(:])", t)),
    }


def one_url(url: str) -> str:
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)(?:\?([^#]*))?", url.strip())
    if not m:
        return url.strip().lower()
    q = "&".join(p for p in (m[3] or "").split("&") if p and not p.startswith("utm_"))
    return re.sub(r"^(?:www\.)+", "", m[1].lower()) + m[2].rstrip("/") + (f"?{q}" if q else "")


@dataclass
class Section:
    heading: str = ""
    level: int = 2
    required: bool = True
    repeat_min: int | None = None
    repeat_max: int | None = None
    min_words: int | None = None
    max_words: int | None = None
    require_citation: bool = False
    must_contain: list[str] = field(default_factory=list)
    table: bool = False
    columns: list[str] = field(default_factory=list)
    aliases: list[str] = field(default_factory=list)
    hint: str = ""
    keywords: list[str] = field(default_factory=list)

    def number(self) -> tuple[str, str, bool] | None:
        """(before, after, with title) of a numbered heading such as ``{n}. {title}``."""
        if "{n}" not in self.heading:
            return None
        before, _, rest = self.heading.partition("{n}")
        after, brace, _ = rest.partition("{")
        return before, after, bool(brace)

    def read(self, text: str) -> tuple[int, str, bool] | None:
        """(number, title, exactly as asked) of a heading that is numbered or nearly so."""
        before, after, titled = self.number()
        t = text.strip()
        body = t[len(before) :] if t[: len(before)].lower() == before.lower() else None
        if body is not None and (m := re.match(r"(\d+)", body)):
            rest = body[m.end() :]
            fits = (not after or not rest or rest[:1].isspace()) if not after.strip() else rest.startswith(after.rstrip())
            title = rest.strip() if not after.strip() else rest[len(after.rstrip()) :].strip()
            if fits and (title or not titled):
                return int(m[1]), title, True
        m = re.match(r"(\d{1,2})[.):、：\-–．]+\s*(.*)$", body if body is not None else t)
        return (int(m[1]), m[2].strip(), False) if m else None

    def names(self, text: str) -> bool:
        return text.strip().lower() in {x.strip().lower() for x in (self.heading, *self.aliases)}


@dataclass
class Template:
    name: str = ""
    description: str = ""
    title_level: int = 1
    min_words: int | None = None
    max_words: int | None = None
    citation_style: str = "inline"
    require_sources_section: bool = False
    sources_heading: str = "Sources"
    sources_level: int = 2
    sources_from_notes: bool = False
    min_sources: int = 0
    forbid: list[str] = field(default_factory=list)
    sections: list[Section] = field(default_factory=list)


def template(data: dict, **overrides) -> Template:
    """A template of a mapping (as read from TOML: ``section`` is the list of sections); unknown keys are errors."""
    data = {**data, **{k: v for k, v in overrides.items() if v is not None}}
    parts = data.pop("section", data.pop("sections", []))
    for kind, given in ((Template, data), *((Section, s) for s in parts)):
        unknown = set(given) - {f.name for f in fields(kind)}
        if unknown:
            raise EngineError("bad_template", f"unknown field `{sorted(unknown)[0]}`")
    made = Template(**data, sections=[Section(**s) for s in parts])
    styles = {"inline-link": "inline", "inline_link": "inline"}
    made.citation_style = styles.get(made.citation_style, made.citation_style)
    if made.citation_style not in ("inline", "footnote", "numbered"):
        raise EngineError("bad_template", f"unknown citation style `{made.citation_style}`")
    for s in made.sections:
        if not s.heading or not 1 <= s.level <= 6:
            raise EngineError("bad_template", "a section needs a heading and a level of 1 to 6")
    return made


@dataclass
class Line:
    """A heading with its line, or a line that only looks like one."""

    line: int
    level: int
    text: str
    raw: str


class Outline:
    """Lines, code fences (a fence closes by its own mark, at least as long), headings and near-headings."""

    def __init__(self, text: str):
        self.lines = [x.rstrip("\r") for x in text.split("\n")]
        if self.lines and self.lines[-1] == "":
            self.lines.pop()
        self.code = [False] * len(self.lines)
        self.headings: list[Line] = []
        self.glued: list[int] = []
        self.underlined: list[int] = []
        mark = None
        for i, line in enumerate(self.lines):
            t = line.lstrip()
            indent = len(line) - len(t)
            run = re.match(r"(`{3,}|~{3,})", t)
            if mark:
                self.code[i] = True
                if run and run[1][0] == mark[0] and len(run[1]) >= len(mark) and not t[len(run[1]) :].strip():
                    mark = None
                continue
            if indent <= 3 and run:
                mark, self.code[i] = run[1], True
                continue
            if indent >= 4:
                continue
            h = re.match(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", t)
            if h:
                self.headings.append(Line(i + 1, len(h[1]), (h[2] or "").strip(), line))
            elif re.match(r"#{1,6}\w", t):
                self.glued.append(i + 1)
            elif i and re.fullmatch(r"={3,}|-{3,}", t.strip()):
                before = self.lines[i - 1].strip()
                if before and not self.code[i - 1] and not re.match(r"[#|\-*>+\d]|<!--", before):
                    self.underlined.append(i + 1)

    def body(self, k: int) -> tuple[int, int]:
        """Lines (from 0, end excluded) under heading ``k``, with its sub-sections."""
        h = self.headings[k]
        return h.line, next((x.line - 1 for x in self.headings[k + 1 :] if x.level <= h.level), len(self.lines))

    def text(self, span: tuple[int, int]) -> str:
        return "\n".join(self.lines[span[0] : span[1]])

    def table(self, span: tuple[int, int]) -> tuple[int, list[str], int] | None:
        """(line, columns, data rows) of the first pipe table in a span."""
        for i in range(span[0], span[1] - 1):
            if not self.code[i] and "|" in self.lines[i] and _is_rule(self.lines[i + 1]) and not _is_rule(self.lines[i]):
                j = i + 2
                while j < span[1] and "|" in self.lines[j] and self.lines[j].strip():
                    j += 1
                return i + 1, cells_of(self.lines[i]), j - i - 2
        return None


class Grader:
    """The issues of one report, rule by rule."""

    def __init__(self, text: str, t: Template, allowed: set[str] | None = None):
        self.full, self.t, self.allowed = text, t, allowed
        self.o = Outline(text)
        self.used = [False] * len(self.o.headings)
        self.issues: list[tuple[str, str, int | None, str]] = []
        self.stats: dict[str, int] = {}
        self.order: list[tuple[str, int]] = []

    def say(self, severity: str, rule: str, line: int | None, message: str) -> None:
        self.issues.append((severity, rule, line, message))

    def free(self) -> list[int]:
        return [i for i, u in enumerate(self.used) if not u]

    def run(self) -> Grader:
        self.leftovers()
        self.form()
        title = self.title()
        last = title
        for s in self.t.sections:
            last = (self.numbered(s, last) if s.number() else self.literal(s, last))
        span = self.sources()
        self.strangers()
        self.sequence()
        self.provenance(span, title)
        self.issues.sort(key=lambda x: (x[2] if x[2] is not None else 1 << 60, x[0] != "error"))
        return self

    @property
    def score(self) -> int:
        errors = sum(x[0] == "error" for x in self.issues)
        return max(0, 100 - ERROR * errors - WARNING * (len(self.issues) - errors))

    def leftovers(self) -> None:
        todos = 0
        for i, line in enumerate(self.o.lines):
            if self.o.code[i]:
                continue
            if "<!-- TODO" in line:
                todos += 1
                self.say("error", "todo", i + 1, "unfinished placeholder")
            if "<!-- NOTES" in line:
                self.say("warning", "notes_block", i + 1, "leftover block of notes")
            for phrase in self.t.forbid:
                if phrase.lower() in line.lower():
                    self.say("error", "forbidden", i + 1, f"forbidden phrase: {phrase}")
        self.stats["todos_left"] = todos

    def form(self) -> None:
        for n in self.o.glued:
            self.say("error", "heading_format", n, "no space after #")
        for n in self.o.underlined:
            self.say("warning", "heading_format", n - 1, "underlined heading")

    def title(self) -> int | None:
        if not self.t.title_level:
            return None
        first = next((i for i, x in enumerate(self.o.lines) if x.strip() and not x.lstrip().startswith("<!--")), None)
        heads, found = self.o.headings, None
        if first is not None and heads and heads[0].line == first + 1:
            found = 0
            self.used[0] = True
            if heads[0].level != self.t.title_level:
                self.say("error", "title", heads[0].line, f"the title must be of level {self.t.title_level}")
        else:
            self.say("error", "title", 1, "the first line must be the title")
        if self.t.title_level == 1:
            for i, h in enumerate(heads):
                if i != found and h.level == 1:
                    self.say("error", "multiple_h1", h.line, "another heading of level 1")
        return found

    def content(self, k: int, s: Section) -> None:
        h, span = self.o.headings[k], self.o.body(k)
        text, line = self.o.text(span), h.line
        n = words_in(text)
        if (s.min_words is not None and n < s.min_words) or (s.max_words is not None and n > s.max_words):
            self.say("error", "section_words", line, f"{n} words")
        cites = citations_in(text)
        if s.require_citation and not sum(cites.values()):
            self.say("error", "citation", line, "no citation")
        elif sum(cites.values()) and not cites[self.t.citation_style]:
            self.say("warning", "citation_style", line, "citations of another style")
        for w in s.must_contain:
            if w.lower() not in text.lower():
                self.say("error", "must_contain", line, f"does not mention {w}")
        if s.table:
            t = self.o.table(span)
            if t is None:
                self.say("error", "table", line, "no table")
            else:
                have = {c.lower() for c in t[1]}
                missing = [c for c in s.columns if c.strip().lower() not in have]
                if missing:
                    self.say("error", "table_columns", t[0], "missing columns: " + ", ".join(missing))
                if not t[2]:
                    self.say("warning", "table", t[0], "a table without rows")

    def numbered(self, s: Section, last: int | None) -> int | None:
        heads = self.o.headings
        found = [(i, *r) for i in self.free() if (r := s.read(heads[i].text))]
        least, most = s.repeat_min or 1, s.repeat_max or 1 << 30
        for j, (i, n, _, exact) in enumerate(found):
            self.used[i] = True
            line = heads[i].line
            if j >= most:
                self.say("error", "item_count", line, f"more than {most} items")
                continue
            if heads[i].level != s.level:
                self.say("error", "heading_level", line, f"must be of level {s.level}")
            elif n != j + 1 or not exact:
                self.say("error", "numbering", line, f"should be item {j + 1} written as {s.heading}")
            self.content(i, s)
        adopted: list[int] = []
        if len(found) < least:
            start = heads[found[-1][0]].line if found else heads[last].line if last is not None else 0
            stop = min((h.line for h in heads if h.line > start and self.reserved(h.text)), default=1 << 60)
            adopted = [i for i in self.free() if start < heads[i].line < stop and 2 <= heads[i].level <= s.level + 1][: least - len(found)]
            for j, i in enumerate(adopted, len(found) + 1):
                self.used[i] = True
                self.say("error", "numbering", heads[i].line, f"looks like item {j} without its number")
                self.content(i, s)
        every = [f[0] for f in found] + adopted
        if len(every) < least:
            at = every[-1] if every else last
            self.say("error", "item_count", heads[at].line if at is not None else None, f"{len(every)} of {least} items")
        if every:
            self.order.append((s.heading, every[0]))
            return every[-1]
        return last

    def reserved(self, text: str) -> bool:
        low = text.strip().lower()
        return low == self.t.sources_heading.strip().lower() or low in SOURCE_HEADINGS or any(not s.number() and s.names(text) for s in self.t.sections)

    def literal(self, s: Section, last: int | None) -> int | None:
        heads = self.o.headings
        named = [i for i in self.free() if s.names(heads[i].text)]
        k = next((i for i in named if heads[i].level == s.level), named[0] if named else None)
        if k is not None:
            self.used[k] = True
            if heads[k].level != s.level:
                self.say("error", "heading_level", heads[k].line, f"must be of level {s.level}")
            self.content(k, s)
            self.order.append((s.heading, k))
            return k
        if s.required:
            want = s.heading.lower()
            near = next((i for i in self.free() if want in (x := heads[i].text.lower()) or (x in want and len(x) >= 4)), None)
            if near is not None:
                self.used[near] = True
            self.say("error", "missing_section", heads[near].line if near is not None else None, f"no section {s.heading}")
        return last

    def sources(self) -> tuple[int, int] | None:
        heads, want = self.o.headings, self.t.sources_heading.strip().lower()
        exact = next((i for i in self.free() if heads[i].text.strip().lower() == want), None)
        k = exact if exact is not None else next((i for i in self.free() if heads[i].text.strip().lower() in SOURCE_HEADINGS), None)
        if k is None:
            if self.t.require_sources_section:
                self.say("error", "sources_section", None, "no section of sources")
            return None
        self.used[k] = True
        if self.t.require_sources_section and (exact is None or heads[k].level != self.t.sources_level):
            self.say("error", "sources_section", heads[k].line, "the heading of the sources differs")
        self.order.append((self.t.sources_heading, k))
        return self.o.body(k)

    def strangers(self) -> None:
        deepest = max([s.level for s in self.t.sections] + [self.t.sources_level])
        for i in self.free():
            h = self.o.headings[i]
            if 2 <= h.level <= deepest:
                self.say("warning", "extra_section", h.line, "not a section of the template")

    def sequence(self) -> None:
        top = -1
        for label, k in self.order:
            if k < top:
                self.say("error", "order", self.o.headings[k].line, f"{label} stands too early")
            else:
                top = k

    def provenance(self, span: tuple[int, int] | None, title: int | None) -> None:
        lines = list(self.o.lines)
        if span:
            for i in range(max(0, span[0] - 1), span[1]):
                lines[i] = ""
        distinct = list(dict.fromkeys(one_url(u) for u in urls_in(self.o.text(span) if span else self.full)))
        if len(distinct) < self.t.min_sources:
            self.say("error", "min_sources", span[0] if span else None, f"{len(distinct)} of {self.t.min_sources} sources")
        if self.t.sources_from_notes:
            if not self.allowed:
                self.say("error", "source_not_in_notes", None, "no sources are noted")
            else:
                told = set()
                for i, line in enumerate(self.o.lines):
                    for u in [] if self.o.code[i] else urls_in(line):
                        n = one_url(u)
                        if n not in self.allowed and n not in told:
                            told.add(n)
                            self.say("error", "source_not_in_notes", i + 1, u)
        head = self.o.headings[title].line - 1 if title is not None else -1
        n = words_in("\n".join(x for i, x in enumerate(lines) if i != head and not self.o.code[i]))
        if (self.t.min_words is not None and n < self.t.min_words) or (self.t.max_words is not None and n > self.t.max_words):
            self.say("error", "doc_words", None, f"{n} words")
        self.stats |= {"words": n, "sections": len(self.o.headings) - (title is not None), "citations": sum(citations_in("\n".join(lines)).values()), "sources": len(distinct)}


_ISSUE = [("severity", T.StringType()), ("rule", T.StringType()), ("line", T.IntegerType()), ("message", T.StringType())]


def issues(reports: DataFrame, t: Template, id_col: str = "doc_id", body: str = "body", allowed: list[str] | None = None) -> DataFrame:
    """(id, severity, rule, line, message) of every report; ``allowed`` are the addresses of one session's notes."""
    known = {one_url(u) for u in allowed} if allowed is not None else None
    schema = T.StructType([T.StructField(id_col, reports.schema[id_col].dataType), *[T.StructField(n, k) for n, k in _ISSUE]])
    return per_document(reports, [id_col, body], lambda key, text: [(key, *i) for i in Grader(text or "", t, known).run().issues], schema)


def grades(reports: DataFrame, t: Template, id_col: str = "doc_id", body: str = "body", allowed: list[str] | None = None) -> DataFrame:
    """(id, score, pass, errors, warnings, words, sections, citations, sources, todos_left) of every report."""
    known = {one_url(u) for u in allowed} if allowed is not None else None
    stats = ["words", "sections", "citations", "sources", "todos_left"]
    schema = T.StructType([T.StructField(id_col, reports.schema[id_col].dataType), T.StructField("score", T.IntegerType()), T.StructField("pass", T.BooleanType()), *[T.StructField(n, T.IntegerType()) for n in ("errors", "warnings", *stats)]])

    def make(key, text):
        g = Grader(text or "", t, known).run()
        e = sum(i[0] == "error" for i in g.issues)
        return [(key, g.score, not e, e, len(g.issues) - e, *[g.stats[s] for s in stats])]

    return per_document(reports, [id_col, body], make, schema)


def rule_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("issues"))


def place_notes(notes: DataFrame, t: Template, id_col: str = "id", tag: str = "tag") -> DataFrame:
    """(id, place, heading): the section of a template that each note belongs to, by the rules of ``assign_notes``, as one
    expression over the template's sections; notes that fit none are left out."""
    tags = F.lower(F.coalesce(tag, F.lit("")))
    at = F
    for place, s in enumerate(t.sections, 1):
        words = [k.lower() for k in [s.heading, *s.keywords] if k and "{" not in k]
        fits = tags.rlike(r"^(?:item[-_ ]?)?\d+$") if s.number() else F.lit(False)
        for w in words:
            fits = fits | tags.startswith(w)
        at = at.when(fits, F.struct(F.lit(place).alias("place"), F.lit(s.heading).alias("heading")))
    if not t.sections:
        return notes.limit(0).select(F.col(id_col).alias("id"), F.lit(0).alias("place"), F.lit("").alias("heading"))
    return notes.select(F.col(id_col).alias("id"), at.alias("s")).where("s is not null").select("id", "s.place", "s.heading")


def assign_notes(notes: list[dict], t: Template) -> dict[str, list[int]]:
    """Section heading -> ids of the notes that belong there: by number tags for numbered sections
    (``item-2``), else by keywords at the start of the tag; the first section wins. Driver side."""
    out: dict[str, list[int]] = {s.heading: [] for s in t.sections}
    for n in notes:
        tag = (n.get("tag") or "").lower()
        for s in t.sections:
            numbered = s.number() and re.fullmatch(r"(?:item[-_ ]?)?\d+", tag)
            if numbered or any(tag.startswith(k.lower()) for k in [s.heading, *s.keywords] if k and "{" not in k):
                out[s.heading].append(n["id"])
                break
    return out


def skeleton(t: Template, notes: list[dict] | None = None) -> str:
    """A report to fill in: headings, placeholders, tables, noted sources."""
    placed = assign_notes(notes or [], t)
    text = {n["id"]: n.get("text", "") for n in notes or []}
    out = [f"{'#' * t.title_level} <!-- TODO: title -->", ""] if t.title_level else []
    for s in t.sections:
        numbered = s.number()
        for n in range(1, (s.repeat_min or 1) + 1 if numbered else 2):
            head = f"{numbered[0]}{n}{numbered[1]}Title" if numbered else s.heading
            out += ["#" * s.level + " " + head, "", f"<!-- TODO: {s.hint or 'write this section'} -->"]
            if s.table:
                cols = s.columns or ["Item", "Details"]
                out += ["", "| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols)]
            if placed[s.heading]:
                out += ["<!-- NOTES", *[f"- {text[i]}" for i in placed[s.heading]], "-->"]
            out.append("")
    links = list(dict.fromkeys(n["source"] for n in notes or [] if n.get("source")))
    if t.require_sources_section or links:
        out += ["#" * t.sources_level + " " + t.sources_heading, "", *[f"- <{u}>" for u in links], ""]
    return "\n".join(out)
