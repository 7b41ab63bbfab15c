"""Problem 6: one form for all texts that read the same.

A transducer is compiled once in each Python worker from Unicode data and a short list of look-alike
letters: a trie of code point sequences (a base with its combining marks, a width or presentation
form, a space, an invisible character) with the text that each becomes. A text is cut into grapheme
clusters and each cluster is rewritten by the longest match from each position, in one pass; the
results of clusters are kept, as few differ. Compiling checks the mapping: every output must be a
fixed point, and no input may have two outputs (a look-alike that disagrees with Unicode's own
mapping loses and is listed in ``Transducer.conflicts``).

Accents matter and are composed; other spellings and Han variants (traditional, simplified) stay.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import skew_join

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "H", "а": "a", "е": "e", "ѕ": "s", "і": "i",
    "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "г": "r", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "υ": "u", "κ": "k", "ϲ": "c", "ϳ": "j", "τ": "t", "ε": "e",
    # Latin variants and Armenian letters
    "ɡ": "g", "ɑ": "a", "ı": "i", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L",
}
#: Characters that show nothing; with the format characters (Cf), tags and variation selectors.
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0} | set(range(0xFE00, 0xFE10)) | set(range(0xE0000, 0xE01F0))
#: Code points from which the mapping is built: the planes with characters that have other forms.
_LAST = 0x2FA20
_MARKS = [chr(c) for c in range(0x0300, 0x0370)]


def _letter_form(ch: str) -> str:
    """What one character becomes by Unicode's own data: compatibility form, composed; spaces to one."""
    cat = unicodedata.category(ch)
    if ord(ch) in _INVISIBLE or cat == "Cf":
        return ""
    if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\r\v\f\x85":
        return " "
    return unicodedata.normalize("NFKC", ch)


class Transducer:
    """The compiled mapping; ``apply`` rewrites a text in one pass."""

    def __init__(self, lookalikes: dict[str, str] = LOOKALIKES):
        self.conflicts: list[tuple[str, str, str]] = []
        table: dict[str, str] = {}
        for code in [*range(_LAST), *range(0xE0000, 0xE01F0)]:
            if 0xD800 <= code < 0xE000:
                continue
            ch = chr(code)
            to = _letter_form(ch)
            if to != ch:
                table[ch] = to
        for ch, to in lookalikes.items():
            own = table.get(ch)
            if own is not None and own != to:
                self.conflicts.append((ch, own, to))
            else:
                table[ch] = to
        # accented look-alikes: precomposed letters of other scripts on a base that looks Latin
        for code in range(0x0370, 0x0530):
            d = unicodedata.normalize("NFD", chr(code))
            if len(d) > 1 and d[0] in table:
                table[chr(code)] = unicodedata.normalize("NFC", table[d[0]] + d[1:])
        # outputs must be fixed points: a form that maps on (a wide look-alike) goes to the last form
        for _ in range(4):
            further = {ch: end for ch, to in table.items() if (end := unicodedata.normalize("NFC", "".join(table.get(x, x) for x in to))) != to}
            table.update(further)
            if not further:
                break
        else:
            raise ValueError(f"unstable mappings: {sorted(further)[:5]}")
        self.trie: dict = {}
        for key, to in table.items():
            self._add(key, to)
        # a base, however written, with one combining mark: the composed letter
        bases = {chr(c): chr(c) for r in (range(65, 91), range(97, 123)) for c in r} | {k: v for k, v in table.items() if len(v) == 1 and v.isascii() and v.isalpha()}
        for key, to in bases.items():
            for mark in _MARKS:
                whole = unicodedata.normalize("NFC", to + mark)
                if len(whole) == 1:
                    self._add(key + mark, whole)
        self.table = table
        self.seen: dict[str, str] = {}
        self.clusters = regex.compile(r"\X", regex.DOTALL)

    def _add(self, key: str, to: str) -> None:
        node = self.trie
        for ch in key:
            node = node.setdefault(ch, {})
        node[""] = to

    def cluster(self, text: str) -> str:
        """One grapheme cluster: the longest match from each position, invisible characters never end a match."""
        out, i, n = [], 0, len(text)
        while i < n:
            node, j, best, stop = self.trie, i, None, i
            while j < n:
                nxt = node.get(text[j])
                if nxt is None:
                    if j > i and self.table.get(text[j]) == "":
                        j += 1  # invisible inside a sequence
                        continue
                    break
                node, j = nxt, j + 1
                if "" in node:
                    best, stop = node[""], j
            if best is None:
                out.append(text[i])
                i += 1
            else:
                out.append(best)
                i = stop
        done = "".join(out)
        return done if done.isascii() else unicodedata.normalize("NFC", done)

    def apply(self, text: str) -> str:
        if text.isascii():
            return text.translate(_ASCII_SPACES)
        seen, out = self.seen, []
        for c in self.clusters.findall(text):
            to = seen.get(c)
            if to is None:
                to = self.cluster(c)
                if len(seen) < 200_000 and len(c) < 16:
                    seen[c] = to
            out.append(to)
        return unicodedata.normalize("NFC", "".join(out))

    def key(self, text: str) -> str:
        """The form for comparison: also without case, spaces, punctuation and ASCII symbols."""
        t = self.apply(text).casefold()
        t = "".join(c for c in t if not _dropped(c))
        return unicodedata.normalize("NFC", t)


_ASCII_SPACES = {c: " " for c in (9, 10, 11, 12, 13)}
_DROP: dict[str, bool] = {}


def _dropped(c: str) -> bool:
    d = _DROP.get(c)
    if d is None:
        cat = unicodedata.category(c)
        d = _DROP[c] = cat[0] in "PZC" or (cat[0] == "S" and c.isascii())
    return d


_ONE: list[Transducer] = []


def transducer() -> Transducer:
    if not _ONE:
        _ONE.append(Transducer())
    return _ONE[0]


def _column(name: str):
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        f = getattr(transducer(), name)
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], pa.string())

    return run


def one_form(text: Column | str) -> Column:
    """The text in one consistent form; null for null."""
    return _column("apply")(F.col(text) if isinstance(text, str) else text)


def reading_key(text: Column | str) -> Column:
    """What two texts that read the same have in common; null for null, '' if nothing readable."""
    return _column("key")(F.col(text) if isinstance(text, str) else text)


def plain_key(text: Column) -> Column:
    """Lower case without ASCII spaces and ASCII punctuation: what a plain comparison sees."""
    return F.regexp_replace(F.lower(text), r"[\t\n\x0b\f\r !-/:-@\[-`{-~]", "")


def same_reading(terms: DataFrame, records: DataFrame, term_id: str = "term_id", norm: str = "norm", rec_id: str = "id", names: tuple[str, ...] = ("name_zh",), lists: tuple[str, ...] = ("aliases",)) -> DataFrame:
    """(term_id, id): terms that read like a name of a record but are not plainly equal to one.

    Only distinct strings are rewritten and compared. Nulls and texts without readable characters
    match nothing. Rows of a term asked for very often are spread over tasks.
    """
    t = terms.select(F.col(term_id), F.col(norm).alias("__norm")).where("__norm is not null")
    # nondeterministic, else the filter on the key moves below the distinct and every repeat is rewritten
    once = _column("key").asNondeterministic()
    asked = t.select("__norm").distinct().select("__norm", once(F.col("__norm")).alias("__key"), plain_key(F.col("__norm")).alias("__plain")).where("__key <> ''")
    parts = [F.array(*[F.col(n) for n in names])] + [F.coalesce(F.col(x), F.array().cast("array<string>")) for x in lists]
    named = (
        records.where(F.col(rec_id).isNotNull()).select(F.col(rec_id).alias("__id"), F.explode(F.concat(*parts)).alias("__name")).where("__name is not null").distinct()
    )
    forms = named.select("__name").distinct().select("__name", once(F.col("__name")).alias("__key"), plain_key(F.col("__name")).alias("__plain")).where("__key <> ''")
    named = named.join(forms, "__name").select("__id", "__key", "__plain").distinct()
    pairs = asked.join(named.select("__id", "__key").distinct(), "__key")
    pairs = pairs.join(named.select("__id", "__plain"), ["__id", "__plain"], "left_anti").select("__norm", F.col("__id").alias(rec_id))
    return skew_join(t, pairs, "__norm").select(term_id, rec_id)
