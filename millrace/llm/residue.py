"""Problem 5: rows with unfilled templates, dummy text, or an error page or notice instead of content.

Records are aligned to induce templates, in two passes over the pages and grouped counts between them:

* **Slots in text.** What looks like a variable, a broken value or filler proposes a slot. The words before and after it
  are looked for in the other records: where they stand with something else between, the slot is filled there, and
  here it kept its name. Filler is aligned by its own word sequences, which stand on several sites. A doubtful value (a lone ``null``)
  counts with that evidence only.
* **Slots of whole lines.** Names and numbers of every line are slots, the rest must be equal. A blank, or text in
  marks of any syntax, is residue where more records fill the same slot, and so is a value that stands on several sites in a
  slot that otherwise varies (a default).
* **Whole pages.** The main body (by the block labeller of problem 1) as a template of its lines. Where the same template is
  the whole page on several sites, and its lines stand hardly anywhere else, it is an error page or a notice, whatever
  its words; so is a page made of such lines only. Longer texts than ``NOTICE_LETTERS`` are articles that sites share, not notices.

Messages that no other record repeats are known by their words alone, as is a variable whose surroundings no other
record has; ``evidence`` tells which rows those are. Text quoted or in a code block is an example, not a slot.

Null titles and bodies show nothing. A page without a main body is no case unless its title shows
residue. Rows with the same content are judged alike. Rows without a site count as one site.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .boilerplate import furniture

#: Sites on which a whole-page template, a filler sequence, a default or a title must stand to count as repeated.
MIN_SITES = 3
#: Records that must fill a slot in text, words (Han or kana letters) of its surroundings, and share of a filler's sequences that must be repeated.
MIN_ALIGNED, WORDS, LETTERS, FILLER_SHARE = 2, 3, 5, 0.5
#: Letters of a notice at most (a Han or kana letter counts twice).
NOTICE_LETTERS = 200
#: Keys of surroundings that are sent to the tasks (8 bytes each); if there are more, all surroundings are shuffled and joined.
MOST_ASKED = 4_000_000

#: Records that must fill a slot before a blank or marked text in it counts, and letters that the constant part of a line must have.
MIN_FILLED, MIN_CONSTANT = 5, 8
#: Values that a slot must have, and how many times as often as any other a value must stand there, to be a default.
MIN_VARYING, DEFAULT_TIMES = 20, 4

_ID = r"[A-Za-z_][A-Za-z0-9_.]*"  # names of variables are ASCII, whatever stands around them
VARIABLE = regex.compile("|".join((
    rf"\{{\{{[^{{}}\n]{{1,60}}\}}\}}", rf"[$#]\{{\s*{_ID}\s*\}}", rf"%%\s*{_ID}\s*%%", rf"<<\s*{_ID}\s*>>", rf"\[\[\s*{_ID}\s*\]\]", r"(?<![A-Za-z0-9_])__[A-Za-z][A-Za-z0-9_.]*?__(?![A-Za-z0-9_])",
    r"<%[=\-]?[^%\n]{1,60}%>", r"\{%[^%\n]{1,60}%\}", rf"(?<![$#{{%]){{\s*{_ID}\s*}}(?!\}})", r"\[\s*(?:INSERT|YOUR|ENTER|ADD|TODO)\b[^\]\n]{0,60}\]", r"\[Your [^\]\n]{1,60} here\]",
    r"\((?:[\w .]{1,40} )?TB[DA]\)", r"【請?填入[^】\n]{0,40}】", r"【[^】\n]{0,20}(?:待補|待填|未填)[^】\n]{0,20}】", rf"@@{_ID}@@", r"%\([\w.]+\)[sd]", r"\{\d+\}",
)), regex.I)
#: What broken code leaves in place of a value.
BROKEN = regex.compile(r"\[object Object\]|Invalid Date|(?<![A-Za-zÀ-ÿ0-9_'’-])(?:undefined|NaN|null|nil)(?![A-Za-zÀ-ÿ0-9_'’-])")
#: Titles that were never changed.
DEFAULT_TITLES = regex.compile(
    r"^(?:untitled(?: (?:document|page))?|new (?:page|document)|page title|title|your title here|sample page|無標題(?:文件)?|未命名|新頁面|無題|新しいページ|新規ページ|ohne titel|unbenannt|neue seite|"
    r"sans titre|nouvelle page|sin título|página nueva|nueva página|sem título|nova página)$", regex.I)
#: The words of the usual Latin filler text.
LATIN_FILLER = frozenset((
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum").split())
#: Filler phrases.
FILLER = regex.compile("|".join((
    r"^(?:x{2,}[\s.]*){2,}$", r"^(?:(?:asdf|jkl|qwer\w*|blah|foo|bar|test)[\s,.]*){3,}$", r"(?:sample|dummy|placeholder|filler) text (?:goes|will go|here)", r"type your (?:paragraph|text|content)",
    r"your (?:content|text) (?:will appear|goes) (?:in|here)", r"(?:測試文字){1,}$|這裡是測試文字", r"請在此輸入(?:文字|內容)", r"(?:內文){3,}", r"文字段落範例", r"ここに(?:テキスト|文章)が?(?:入り|を)", r"(?:文章|テキスト)を入力してください",
    r"ダミー(?:文章|テキスト)", r"hier steht ihr text", r"(?:muster|blind|platzhalter)text\b", r"aquí va su texto", r"texto de (?:relleno|ejemplo)", r"texte à remplacer|votre texte ici|texte (?:factice|de remplissage)",
    r"texto fictício|seu texto aqui",
)), regex.I)
#: Messages of servers and notices about access, sessions, maintenance and scripts.
MESSAGE = regex.compile("|".join((
    r"\bnot found\b|could not be found|no longer (?:exists|available)|moved or deleted|nothing here|link you followed|do(?:es)? not have permission|access (?:is )?denied|\bforbidden\b|unauthori[sz]ed|"
    r"session (?:has )?(?:expired|timed out)|sign in again|^#* ?log ?in$|too many requests|please slow down|checking your browser|just a moment|enable javascript|turn on javascript|requires (?:scripts|javascript)|"
    r"temporarily un|service (?:is )?(?:temporarily )?unavailable|try again (?:later|in)|something went wrong|^#* ?oops|internal (?:server )?error|upstream|not answer in time|(?:gateway|request) time-?out|bad gateway|"
    r"under maintenance|scheduled maintenance|housekeeping|be back soon|fatal error|uncaught exception|traceback \(most|sqlstate|connection (?:refused|reset)|stack ?trace|\"error\" ?:|^#* ?(?:http )?(?:error )?[45]\d\d\b|^#* ?error$|"
    r"error (?:id|code)",
    r"找不到(?:網頁|頁面|网页|页面)|(?:網頁|頁面|网页|页面)不存在|移到別的地方|沒有(?:檢視|瀏覽|存取).{0,8}權限|没有权限|拒絕存取|拒绝访问|連線(?:已)?逾時|连接超时|重新登入|重新登录|系統維護|系统维护|維護中|暫時無法|稍後再試|稍后再试|"
    r"(?:開啟|啟用|启用) ?JavaScript|停用指令碼|無法顯示(?:內容|網頁)|伺服器(?:錯誤|忙碌|發生)|發生錯誤|要求過多|請求過多",
    r"見つかりません|移動したか|削除されました|権限がありません|アクセス(?:拒否|が拒否)|ただいま作業中|メンテナンス中|もう一度お試し|JavaScript ?を有効|エラーが発生|期限が?切れ|再度ログイン|混み合って|タイムアウト",
    r"nicht gefunden|existiert nicht|wurde verschoben|keine berechtigung|zugriff verweigert|nicht erreichbar|später noch einmal|aktivieren sie javascript|^#* ?wartung|wartungsarbeiten|sitzung .{0,20}abgelaufen|"
    r"erneut an(?:melden)?\b|interner fehler|zu viele anfragen|zeitüberschreitung|^#* ?fehler$",
    r"introuvable|n['’]existe pas|a été déplacée|pas (?:l['’]autorisation|autorisé)|accès refusé|erreur interne|réessayer|activez javascript|en maintenance|session .{0,20}expiré|trop de requêtes|indisponible|délai dépassé|^#* ?erreur$",
    r"no encontrada|no existe\b|ha cambiado de lugar|no tiene permiso|acceso denegado|error interno|inténtelo|active javascript|en mantenimiento|sesión .{0,20}(?:caducado|expirado)|demasiadas (?:peticiones|solicitudes)|no disponible|"
    r"tiempo de espera",
    r"não encontrada|acesso negado|tente novamente|ative o javascript|em manutenção|sessão .{0,20}expir|erro interno|^#* ?erro$",
)), regex.I)
#: Reference numbers that stand beside messages.
REFERENCE = regex.compile(r"^(?:ray(?: id)?|request(?: id)?|code|reference|ref|error id|trace|incident|錯誤代碼|代碼|エラーコード)?[ :#：]*[0-9a-f.#-]{2,40}$", regex.I)
_QUOTED = regex.compile(r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|「[^」\n]*」|『[^』\n]*』|«[^»\n]*»|„[^“”\n]*[“”]")
_QUOTES = frozenset("`\"“「『«„")
_NAME = regex.compile(r"\p{Lu}\p{Ll}+")
_NUMBER = regex.compile(r"\d[\d.,:/-]*")
_LATIN = regex.compile(r"[A-Za-z]+")


#: Pieces of which every filler phrase has one.
_FILLER_HINTS = ("xx", "asdf", "jkl", "qwer", "blah", "foo", "bar", "test", "text", "your", "測試", "這裡是", "請在此", "內文", "文字段落", "ここに", "を入力", "ダミー", "hier", "aquí")


def is_filler(line: str) -> bool:
    """Filler phrases, or a run of five words or more of Latin filler."""
    low = line.lower()
    if any(x in low for x in _FILLER_HINTS) and FILLER.search(line):
        return True
    marks = [w in LATIN_FILLER for w in _LATIN.findall(low)]
    if sum(marks) < 5:
        return False
    run = 0
    for m in marks:
        run = run + 1 if m else 0
        if run >= 5:
            return True
    return False


def template_key(line: str) -> int:
    """The template of a line: names, numbers and residue are slots."""
    t = _NUMBER.sub("␣", _NAME.sub("␣", BROKEN.sub("␣", VARIABLE.sub("␣", line))))
    return zlib.crc32(regex.sub(r"(?:␣\s*)+", "␣", t).lower().encode("utf-8", "surrogatepass"))


_FILLED = regex.compile(r"(?:\p{Lu}\p{Ll}+|\d(?:[\d.,:/-]*\d)?)(?:[ '’-](?:\p{Lu}\p{Ll}+|\d(?:[\d.,:/-]*\d)?))*")
_MARKED = regex.compile(r"%[^%\s][^%\n]{0,30}%|\{[^{}\n]{1,40}\}|<[^<>\n]{1,40}>|\[[^\[\]\n]{1,40}\](?!\()|[$@#]\p{L}\w*[@#]?|_{2,}|\.{4,}|\?{2,}|-{2,}|(?<!\w)(?:[xX]{3,}|[nN]/[aA]|tbd|TBD)(?!\w)")
_GAP = regex.compile(r"(?<=\S)(?:  +(?=\S)| +(?=[,.;:!?)，。；：！？]))|(?<=[(（]) *(?=[)）])|(?<=[:：])$|^(?=[,;:.!?，。；：！？] )")
#: Without these a line has no text in marks, and no gap.
_MARK_HINT = re.compile(r"[%{<\[$@#_]|\.{4}|\?\?|--|[xX]{3}|[nN]/[aA]|tbd|TBD")
_GAP_HINT = re.compile(r"  | [,.;:!?)，。；：！？]|[(（] *[)）]|[:：]$|^[,;:.!?，。；：！？] ")
_HAN = regex.compile(r"\p{Han}|\p{Hiragana}|\p{Katakana}")


#: Keys of lines are their bytes as one number, by this prime.
_PRIME = (1 << 62) - 57


class _Piece(NamedTuple):
    """A stretch of a line whose slots are ␣, as words with single spaces between: key, bytes, letters (a Han letter counts twice), and whether a space or slot is its first or last."""

    key: int = 0
    size: int = 0
    letters: int = 0
    first: bool = False
    last: bool = False


def _piece(text: str) -> _Piece:
    text = text.replace("␣", " ␣ ")
    flat = " ".join(text.lower().replace("ς", "σ").split())  # the only letter whose lower case depends on its neighbours
    raw = flat.encode("utf-8", "surrogatepass")
    return _Piece(int.from_bytes(raw, "big") % _PRIME, len(raw), sum(c.isalpha() for c in flat) + len(_HAN.findall(flat)), text[:1].isspace(), text[-1:].isspace())


def _joined(a: _Piece, b: _Piece) -> _Piece:
    """The piece of two stretches side by side."""
    space = bool(a.size and b.size and (a.last or b.first))
    key = ((a.key * 256 + 32 if space else a.key) * pow(256, b.size, _PRIME) + b.key) % _PRIME
    return _Piece(key, a.size + b.size + space, a.letters + b.letters, a.first or (not a.size and b.first), b.last or (not b.size and a.last))


def _constant(text: str) -> int | None:
    """The key of a line whose slots are ␣, None if too little of it is constant."""
    return p.key if (p := _piece(text)).letters >= MIN_CONSTANT else None


def _slots(line: str) -> str:
    """The line with its names and numbers as slots, without a name it begins with."""
    at = m.end() if (m := _NAME.match(line)) else 0
    return line[:at] + _FILLED.sub("␣", line[at:])


def filled_slots(line: str) -> list[tuple[int, str]]:
    """(key, values) of the slots of a line; a name it begins with may be one or a constant word."""
    out = {}
    for at in {0, m.end()} if (m := _NAME.match(line)) else {0}:
        values = _FILLED.findall(line[at:])
        if values and (key := _constant(line[:at] + _FILLED.sub("␣", line[at:]))) is not None:
            out[key] = values
    return [(k, "\t".join(v)) for k, v in out.items()]


def empty_slots(line: str) -> list[int]:
    """Keys that the line has if all its gaps, or all its texts in marks, are slots, or any one of them."""
    out = []
    for pattern in (*([_MARKED] if _MARK_HINT.search(line) else []), *([_GAP] if _GAP_HINT.search(line) else [])):
        hits = [m.span() for m in pattern.finditer(line)]
        if hits:
            text, end = "", 0
            for a, b in hits:
                text, end = text + line[end:a] + "␣", b
            out += [_constant(x) for x in (_FILLED.sub("␣", text + line[end:]), _slots(text + line[end:]))]
        if len(hits) > 1:
            out += _one_open(line, hits, 0)
            if m := _NAME.match(line):
                out += [_constant(_slots(line[:a] + "␣" + line[b:])) for a, b in hits if a < m.end()]  # one at most, as words in marks end where a name does
                out += _one_open(line, [h for h in hits if h[0] >= m.end()], m.end())
    return sorted({k for k in out if k is not None})


def _one_open(line: str, hits: list[tuple[int, int]], at: int) -> list[int | None]:
    """For each hit, the key of the line with that hit as a slot, beside its names and numbers after ``at``.

    The line is cut at the edges of hits, or of a name or number that reaches over such an edge, and its pieces are joined from
    both ends, so the work grows with the line and its hits, not with their product.
    """
    filled = [m.span() for m in _FILLED.finditer(line, at)]
    begins = [a for a, _ in filled]

    def around(i: int) -> tuple[int, int]:
        k = bisect.bisect_left(begins, i) - 1
        return filled[k] if k >= 0 and filled[k][1] > i else (i, i)

    def piece(a: int, b: int) -> _Piece:
        return _piece(line[a:b] if a < at else _FILLED.sub("␣", line[a:b]))

    edges = [(around(a)[0], around(b)[1]) for a, b in hits]
    cuts = sorted({0, at, len(line)}.union(*edges))
    pieces = [piece(a, b) for a, b in itertools.pairwise(cuts)]
    before = dict(zip(cuts, itertools.accumulate(pieces, _joined, initial=_Piece())))
    after = dict(zip(reversed(cuts), itertools.accumulate(reversed(pieces), lambda right, left: _joined(left, right), initial=_Piece())))
    slot, out = _piece("␣"), []
    for (a, b), (begin, end) in zip(hits, edges):
        p = functools.reduce(_joined, (before[begin], piece(begin, a), slot, piece(b, end), after[end]))
        out.append(p.key if p.letters >= MIN_CONSTANT else None)
    return out


_OPENERS = frozenset("{[<%_@(【#$")


def _variable(text: str) -> bool:
    return not _OPENERS.isdisjoint(text) and bool(VARIABLE.search(text))


_SEEN: dict[str, tuple[str, bool, bool, bool]] = {}


def _signs(line: str) -> tuple[str, bool, bool, bool]:
    """(line without quotations, sure residue, doubtful value, filler); remembered for lines that repeat."""
    got = _SEEN.get(line)
    if got is None:
        bare = _QUOTED.sub(" ", line) if not _QUOTES.isdisjoint(line) else line
        broken = BROKEN.findall(bare)
        residue = len(broken) > 1 or "[object Object]" in broken or "Invalid Date" in broken or _variable(bare)
        got = (bare, residue, bool(broken) and not residue, is_filler(bare))
        if len(line) < 120:
            if len(_SEEN) > 200_000:
                _SEEN.clear()
            _SEEN[line] = got
    return got


# ---------------------------------------------------------------- slots in text

_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]|\p{L}[\p{L}\p{M}'’]*|\d+|[^\s\p{L}\p{N}]")


_HASHES: dict[str, int] = {}
#: Odd multipliers of the words of a run; keys are the upper 61 of 64 bits.
_MULTIPLIERS = (0x165667B19E3779F9, 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15, 1_000_003, 1)


def _words(text: str) -> list[int]:
    """The words of a text as hashes; names and numbers are one word each, whichever they are."""
    out = []
    for w in _WORD.findall(text):
        h = _HASHES.get(w)
        if h is None:
            plain = "0" if w[0].isdigit() else "␣" if len(w) > 1 and w[0].isupper() and _NAME.fullmatch(w) else w.lower()
            h = zlib.crc32(plain.encode("utf-8", "surrogatepass")) + 1
            if len(_HASHES) < 400_000:
                _HASHES[w] = h
        out.append(h)
    return out


def _windows(w: list[int], letters: bool) -> list[int]:
    """Keys of all runs of words (of letters, in a line with Han or kana)."""
    n = LETTERS if letters else WORDS
    return (_runs(np.array(w, dtype=np.uint64), n)).tolist() if len(w) >= n else []


def _runs(w: np.ndarray, n: int) -> np.ndarray:
    """Keys of all runs of ``n`` words."""
    total = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for i, m in enumerate(_MULTIPLIERS[-n:]):
        total += w[i : len(w) - n + 1 + i] * np.uint64(m)
    return (total >> np.uint64(3)).astype(np.int64)


def _all(words: list[int]) -> int:
    return zlib.crc32(repr(words).encode())


def _parts(line: str) -> list[list[int]]:
    """The words of a line between what looks like residue."""
    cuts = sorted(m.span() for p in (VARIABLE, BROKEN) for m in p.finditer(line)) if _doubtful(line) else []
    parts, at = [], 0
    for a, b in cuts:
        if a >= at:
            parts.append(_words(line[at:a]))
        at = max(at, b)
    return [*parts, _words(line[at:])]


def slot_keys(line: str) -> list[int]:
    """Keys of the surroundings, to the left and right, of what looks like a variable or broken value in a line."""
    keys, parts, letters = [], _parts(line), bool(_HAN.search(line))
    for i, words in enumerate(parts):
        runs = _windows(words, letters)
        if runs:
            keys += ([2 * runs[-1]] if i + 1 < len(parts) else []) + ([2 * runs[0] + 1] if i else [])
    return keys


def _open_key(line: str) -> int:
    """The key of a line with what looks like residue as open slots."""
    return _all([w for words in _parts(line) for w in (*words, 0)])


def filled_keys(parts: list[tuple[list[int], bool]]) -> np.ndarray:
    """Keys of all surroundings in stretches of words (words, whether of letters) that have a word where a slot could be."""
    flat, last, sizes = [], [], []
    for words, letters in parts:
        flat += words
        flat.append(0)  # no word is 0, so runs over an edge can be told
        last.append(len(flat) - 1)
        sizes.append(LETTERS if letters else WORDS)
    if not flat:
        return np.zeros(0, dtype=np.int64)
    w, ends = np.array(flat, dtype=np.uint64), np.array(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    of = np.repeat(np.arange(len(ends)), ends + 1 - starts)
    out = []
    for n in (WORDS, LETTERS):
        if len(w) < n:
            continue
        keys, at = _runs(w, n), np.arange(len(w) - n + 1)
        line = of[: len(at)]
        own = (np.array(sizes)[line] == n) & (at + n <= ends[line])
        out += [2 * keys[own & (at + n < ends[line])], 2 * keys[own & (at > starts[line])] + 1]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def filler_keys(line: str) -> list[int]:
    """Keys of the runs of a filler line."""
    runs = _windows(_words(line), bool(_HAN.search(line)))
    return sorted({2 * h for h in runs[:-1]}) or [_short_key(line)]


def _short_key(line: str) -> int:
    return -1 - _all(_words(line))


def _doubtful(text: str) -> bool:
    return not _OPENERS.isdisjoint(text) or bool(BROKEN.search(text))


def _title_key(title: str) -> int:
    return -1 - _all([0, *_words(title)])


# ---------------------------------------------------------------- pages


def _letters(text: str) -> int:
    return len(text) + len(_HAN.findall(text))


def _message(line: str) -> bool:
    return line.startswith('{"') or bool(MESSAGE.search(line))


def _notice(title: str, heads: list[str], rest: list[str]) -> bool:
    """Messages and references only, or nothing but a heading or title that is one."""
    if not all(_message(x) or REFERENCE.match(x) for x in rest):
        return False
    return any(map(_message, rest)) or (not rest and any(MESSAGE.search(h) for h in heads)) or bool(title and MESSAGE.search(title))


def read_page(title: str | None, body: str | None, numbers: list[int], scores) -> dict:
    """What one page proposes: slots in its text, filler, a title, keys of its main lines, and whether it reads like a notice."""
    lines = (body or "").split("\n")
    out = {"residue": False, "filler": False, "title": False, "notice": False, "slots": [], "doubtful": [], "again": [], "fill": [], "titles": [], "gaps": [], "lines": []}
    heads, rest, main_lines, size, fence = [], [], [], 0, False
    for n, p in zip(numbers, scores):  # residue counts wherever it stands, notices in the main body
        line, main = lines[n - 1].strip(), p < 0.5
        if line.startswith(("```", "~~~")):
            fence = not fence
            continue
        if fence:
            rest += [""] if main else []  # code is content
            size += NOTICE_LETTERS
            continue
        bare, residue, unsure, filler = _signs(line)
        if residue:
            out["residue"] = True
            out["slots"] += slot_keys(bare)
            out["again"].append(_open_key(bare))
        elif unsure:
            out["doubtful"] += slot_keys(bare)
        if filler:
            out["filler"] = True
            out["fill"] += filler_keys(bare)
        if not residue:
            out["gaps"] += empty_slots(bare.strip())
        if main:
            size += _letters(line)
            main_lines.append(line)
            if residue or filler:
                continue
            (heads if line.startswith("#") else rest).append(line if line.startswith('{"') else bare)
    if main_lines and size <= NOTICE_LETTERS:
        kept = [x for x in main_lines if not REFERENCE.match(x)] or main_lines
        out["lines"] = sorted({template_key(x) for x in kept})
    t = (title or "").strip()
    head = regex.split(r" [|–-] ", t)[0].strip()
    broken = BROKEN.findall(t)
    if t and (_variable(t) or DEFAULT_TITLES.match(head) or len(broken) > 1 or "Invalid Date" in broken or head in ("null", "undefined", "NaN") or is_filler(t)):
        out["title"] = True
        out["titles"] = slot_keys(t) + [_title_key(t), _title_key(head)]
    out["notice"] = _notice(head, heads, rest)
    return out


_FLAGS, _KEYS = ("residue", "filler", "title", "notice"), ("slots", "doubtful", "again", "fill", "titles", "gaps", "lines")


def _propose(pages: DataFrame, id_col: str) -> DataFrame:
    """(id, site, flags, keys) of each page; the only pass that labels blocks."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sites, titles, bodies = (part.column(i).to_pylist() for i in (1, 2, 3))
                rows = [read_page(t, x, n, p) for t, x, (n, p) in zip(titles, bodies, furniture(bodies))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x or "" for x in sites], pa.string()), *(pa.array([r[f] for r in rows], pa.bool_()) for f in _FLAGS), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in _KEYS)],
                    names=["id", "site", *_FLAGS, *_KEYS])

    schema = f"id {kind}, site string, " + ", ".join([f"{f} boolean" for f in _FLAGS] + [f"{k} array<bigint>" for k in _KEYS])
    return cut(spread(pages.select(F.col(id_col), "site", "title", "body")).mapInArrow(run, schema))


def _align(pages: DataFrame, id_col: str, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, site) where surroundings that were asked for are filled, once a page, and (id, site, key, values) of the slots of whole lines."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    few = np.sort(asked.limit(MOST_ASKED + 1).toArrow()["key"].to_numpy())
    wanted = spark.sparkContext.broadcast(few if len(few) <= MOST_ASKED else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = wanted.value
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                b = whole.slice(first, 512)
                rows: list[tuple] = []
                for i, (site, title, body) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]))):
                    near, slots = _page_keys(title, body)
                    rows += [(i, site or "", k, None) for k in (near if want is None else _among(near, want)).tolist()]
                    rows += [(i, site or "", *x) for x in slots]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(pa.array([r[j] for r in rows], t) for j, t in ((1, pa.string()), (2, pa.int64()), (3, pa.string())))], names=["id", "site", "key", "values"])

    both = cut(spread(pages.select(id_col, "site", "title", "body")).mapInArrow(run, f"id {kind}, site string, key bigint, values string"))
    near = both.where("values is null").select("key", "site")
    return (near if len(few) <= MOST_ASKED else near.join(asked, "key", "left_semi")), both.where("values is not null")


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The keys that are in a sorted array."""
    if not len(wanted):
        return keys[:0]
    return keys[wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys]


def _page_keys(title: str | None, body: str | None) -> tuple[np.ndarray, set[tuple[int, str]]]:
    """Keys of all surroundings in a page, and the slots of its lines."""
    fence, slots, parts, whole = False, set(), [], []
    if title:
        t = title.strip()
        parts += [(p, bool(_HAN.search(t))) for p in _parts(t)]
        whole += [_title_key(x) for x in {t, regex.split(r" [|–-] ", t)[0].strip()}]
    for line in (body or "").split("\n"):
        line = line.strip()
        if line.startswith(("```", "~~~")):
            fence = not fence
        elif not fence and line:
            got = _LINES.get(line)
            if got is None:
                bare = _signs(line)[0].strip()
                own = _parts(bare)
                got = ([(p, bool(_HAN.search(bare))) for p in own], ([_open_key(bare)] if len(own) > 1 else []) + ([_short_key(bare)] if len(line) < 60 else []), filled_slots(bare))
                if len(line) < 80:
                    if len(_LINES) > 50_000:
                        _LINES.clear()
                    _LINES[line] = got
            parts += got[0]
            whole += got[1]
            slots.update(got[2])
    return np.unique(np.concatenate([filled_keys(parts), np.array(whole, dtype=np.int64)])), slots


#: What lines that repeat give: stretches of words, keys of the line, slots.
_LINES: dict[str, tuple[list, list[int], list]] = {}


def evidence(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, evidence): the rows to keep out, with how they are known: ``slot`` (aligned records fill what is left open here),
    ``filler`` and ``title`` (the same stands on several sites), ``line`` (a line with open slots repeats on several sites, or more records fill the slot of a whole line), ``page`` (a whole-page template), or ``words`` (its own words alone)."""
    read = _propose(pages, id_col)
    asks = [read.select("id", F.lit(name).alias("why"), F.explode(F.array_distinct(column)).alias("key")) for name, column in (("slot", "slots"), ("doubt", "doubtful"), ("line", "again"), ("filler", "fill"), ("title", "titles"))]
    asked = cut(functools.reduce(DataFrame.union, asks))
    near, slots = _align(pages, id_col, asked.select("key").distinct())
    filled = near.groupBy("key", "site").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("sites"))
    each = asked.join(filled, "key", "left")
    many = lambda c, least: F.coalesce(F.col(c) >= least, F.lit(False)).cast("int")
    aligned, repeated = F.max(many("pages", MIN_ALIGNED)) == 1, F.max(many("sites", MIN_SITES)) == 1
    known = each.groupBy("id", "why").agg(
        F.when(F.col("why") == "filler", F.avg(many("sites", MIN_SITES)) >= FILLER_SHARE).when(F.col("why") == "line", repeated).when(F.col("why") == "title", aligned | repeated).otherwise(aligned).alias("known"))
    known = known.where("known").select("id", F.when(F.col("why") == "doubt", "slot").otherwise(F.col("why")).alias("evidence"))
    words = read.where("residue or filler or title or notice").select("id", F.lit("words").alias("evidence"))
    every = known.union(_by_page(read)).union(_by_line(read, slots)).union(words)
    order = F.array_position(F.array(*[F.lit(x) for x in ("page", "slot", "filler", "title", "line", "words")]), F.col("evidence"))
    return every.groupBy("id").agg(F.min_by("evidence", order).alias("evidence")).select(F.col("id").alias(id_col), "evidence")


def found(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id): the rows to keep out."""
    return evidence(pages, id_col).select(id_col)


def _by_page(read: DataFrame) -> DataFrame:
    """(id, evidence): short pages made of lines that, as whole pages, stand on several sites and hardly anywhere else."""
    short = read.where("size(lines) > 0").select("id", "site", "lines", F.xxhash64("lines").alias("whole"))
    repeated = short.groupBy("whole", "site").agg(F.count(F.lit(1)).alias("n")).groupBy("whole").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= MIN_SITES).select("whole", F.lit(1).alias("repeated"))
    marked = short.join(repeated, "whole", "left").select("id", F.size("lines").alias("size"), F.coalesce("repeated", F.lit(0)).alias("repeated"), F.explode("lines").alias("key"))
    own = marked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("repeated").alias("as_page")).where((F.col("as_page") >= MIN_SITES) & (F.col("as_page") * 2 >= F.col("n"))).select("key")
    return marked.join(own, "key", "left_semi").groupBy("id", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size").select("id", F.lit("page").alias("evidence"))


def _by_line(read: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, evidence): rows with a blank or marked text in a slot that more records fill, or with a default in a slot that varies."""
    records = lines.groupBy("key").agg(F.count(F.lit(1)).alias("records")).where(F.col("records") >= MIN_FILLED)
    asked = read.select("id", F.explode(F.array_distinct("gaps")).alias("key"))
    empty = asked.groupBy("key").agg(F.count(F.lit(1)).alias("empty")).join(records, "key").where("records > empty").select("key")
    each = lines.join(records.where(F.col("records") > MIN_VARYING).select("key"), "key", "left_semi").select("id", "site", "key", F.posexplode(F.split("values", "\t")).alias("slot", "value")).where(F.col("value").rlike(r"\p{L}"))
    counts = each.groupBy("key", "slot", "value").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("site").alias("sites"))
    slots = counts.groupBy("key", "slot").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"), F.max("n").alias("top")).where(F.col("kinds") > MIN_VARYING)
    rivals = counts.join(slots, ["key", "slot"]).where(F.col("n") * DEFAULT_TIMES > F.col("top")).groupBy("key", "slot").agg(
        F.count(F.lit(1)).alias("rivals"), F.max("value").alias("value"), F.max("n").alias("n"), F.max("sites").alias("sites"), F.max("all").alias("all"))
    default = rivals.where((F.col("rivals") == 1) & (F.col("sites") >= MIN_SITES) & (F.col("n") * 2 < F.col("all")) & (F.col("n") >= DEFAULT_TIMES))
    ids = asked.join(empty, "key", "left_semi").select("id").union(each.join(default.select("key", "slot", "value"), ["key", "slot", "value"], "left_semi").select("id"))
    return ids.select("id", F.lit("line").alias("evidence"))
