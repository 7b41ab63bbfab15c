"""Problem 3: records of one organisation under different spellings of its name.

Every distinct name is read into parts: kind of organisation, number, person, place, brand (Latin) or
stem (Han). Reading is tolerant: kinds are found by longest-common-subsequence ratio against full and
shortened forms, persons through nicknames and initials, any order of the parts, with or without
brackets. A form is the parts together with the organisation's own web domain.

A name without a known kind is kept as its words. It tells less than a full name, so it links only ids that have no
other: all words must agree, each but for one letter where it has five or more; a single word only with
the same own domain.

Candidates come from blocks under kind and number: the suffix of brand and place, subsequences that near
brands, places and stems must share, and the own domain. A block of names that is common is refined with
the subsequences of the other token, so every pair that the decision accepts shares a block whatever the
size of the table. Pairs are decided by the ratio of the longest common subsequence of place, brand and
stem; another kind, number, person or own domain parts them. Linked forms and the forms of one id are
joined into classes.

Nulls, blanks and placeholders are no names. Repeated rows and copies are one form. Ids that are null or
have no name are left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, spread, stable_hash
from .lookalike import transducer
from .survivor import is_real

#: Kinds of organisations, English and Chinese full forms and shortened ones.
KINDS = {
    "revenue": (["department of revenue", "rev dept", "dept of revenue", "revenue dept"], ["稅務處", "稅處"]),
    "labor": (["labor office", "labour off", "labor ofc", "labour office"], ["勞工事務所", "勞工所"]),
    "housing": (["housing authority", "housing auth", "hsg authority"], ["住宅管理處", "住管處"]),
    "post": (["postal service", "post service", "postal svc"], ["郵政服務處", "郵政", "郵政處"]),
    "library": (["municipal library", "mun library", "muni library"], ["市立圖書館", "圖書館", "市圖"]),
    "technical": (["technical university", "tech univ", "tech university"], ["科技大學", "科大"]),
    "law": (["law office", "law off", "law ofc"], ["律師事務所", "律師所"]),
    "payment": (["payment network", "payment netw", "pay network"], ["支付網路", "支付", "支付網"]),
    "power": (["power corporation", "power corp"], ["電力股份有限公司", "電力公司", "電力"]),
    "airport": (["international airport", "int'l airport", "intl airport"], ["國際機場", "機場"]),
    "clinic": (["clinic", "clin"], ["診所"]),
    "bakery": (["bakery", "bkry"], ["烘焙坊", "烘焙"]),
    "motor": (["motor vehicle agency", "motor veh agency"], ["監理站", "監理"]),
    "savings": (["savings bank", "sav bank"], ["儲蓄銀行", "儲銀", "銀行"]),
    "welfare": (["welfare foundation", "welf foundation", "welfare fdn"], ["社會福利基金會", "福利會", "福利基金會"]),
    "transit": (["transit bureau", "transit bur", "trans bureau"], ["運輸局", "運局"]),
    "department": (["department store", "dept store"], ["百貨公司", "百貨"]),
    "food": (["food cooperative", "food coop", "food co-op"], ["食品合作社", "食品社", "食合社"]),
    "music": (["music school", "mus school"], ["音樂教室", "音教室"]),
    "consumer": (["consumer association", "consumer assn", "cons assoc"], ["消費者協會", "消協", "消費者會"]),
    "water": (["water company", "water co"], ["自來水公司", "水公司"]),
    "film": (["film festival", "film fest"], ["電影節", "影展"]),
    "hospital": (["general hospital", "gen hospital", "gen hosp"], ["綜合醫院", "醫院"]),
    "design": (["design studio", "design std"], ["設計工作室", "設計室"]),
    "weather": (["weather center", "weather ctr", "wx center"], ["氣象中心", "氣象"]),
}
#: Given names and their short forms.
NICKNAMES = {
    "robert": ["rob", "bob", "bobby", "robbie"], "theodore": ["theo", "ted", "teddy"], "elizabeth": ["liz", "betty", "beth", "eliza", "lizzie"],
    "margaret": ["maggie", "peggy", "meg", "marge"], "dorothy": ["dolly", "dot", "dottie"], "michael": ["mike", "mick", "mickey"],
    "charles": ["chuck", "charlie", "chas"], "william": ["bill", "will", "billy", "willie"], "alexander": ["sasha", "alex", "xander"],
    "katherine": ["kate", "kathy", "katie", "kit"], "josephine": ["josie", "jo"], "richard": ["dick", "rick", "rich", "ricky"],
}
#: Simplified letters of the words above and of common names, with the traditional ones.
SIMPLIFIED = dict(zip(
    "务乐处会龙见宁车伦风门维诺罗马萨亚兰凯电劳税气来费协图书馆邮网诊货储银监节综医设计师运输国际机场学饼贸铁业产华东广农厂开关长张陈杨黄赵刘钱孙宝贝财资经纪实验发园艺术馆兴飞云鸟鱼",
    "務樂處會龍見寧車倫風門維諾羅馬薩亞蘭凱電勞稅氣來費協圖書館郵網診貨儲銀監節綜醫設計師運輸國際機場學餅貿鐵業產華東廣農廠開關長張陳楊黃趙劉錢孫寶貝財資經紀實驗發園藝術館興飛雲鳥魚",
))
#: Suffix of a Latin token that is indexed.
MIN_LATIN = 4
#: A block of names shared by more forms than this is refined before its pairs are compared.
COMMON = 60
#: Least ratios that ``alike`` asks of brand, place and the stem beside a brand; if brand and place both differ, one of them reaches NEARER.
NEAR_BRAND, NEAR_PLACE, NEAR_STEM, NEARER = 0.75, 0.72, 0.6, 0.859
#: Two lengths with more subsequences than this make one block, which is compared whole.
MOST_KEYS = 220
#: A letter with at least this share of all letters of Han stems counts as one that names are made of.
USUAL_LETTER = 0.002
_EXACT = {f.replace(".", ""): kind for kind, (fs, _) in KINDS.items() for f in fs}
_EXACT_HAN = {f: kind for kind, (_, fs) in KINDS.items() for f in fs}
_SHORT = {n: full for full, ns in NICKNAMES.items() for n in [full, *ns]}
_LINKING = {"of", "the", "and", "-", "no", "at", "&"}
#: Short forms of words that end names of companies.
LEGAL = {"limited": "ltd", "incorporated": "inc", "corporation": "corp", "company": "co", "international": "intl", "brothers": "bros", "association": "assn", "department": "dept", "university": "univ"}
#: Letters from which a word of a name without a kind may differ by one.
LOOSE_WORD = 5


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if a == b:
        return len(a)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = masks.get(c, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """Longest common subsequence against the mean length, 0..1."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


def _bare(word: str) -> str:
    """Lower case without accents."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)))


@lru_cache(maxsize=100_000)
def _english_kind(words: tuple[str, ...]) -> tuple[float, str | None]:
    best: tuple[float, str | None] = (0.0, None)
    text = " ".join(words)
    for kind, (forms, _) in KINDS.items():
        for f in forms:
            r = ratio(text, f)
            if abs(len(words) - len(f.split())) > 1:
                r -= 0.1
            if r > best[0]:
                best = (r, kind)
        full = forms[0].split()
        # an acronym of the kind, in either order
        if len(words) == 1 and len(full) > 1:
            initials = "".join(w[0] for w in full if w != "of")
            if words[0] in (initials, initials[::-1]) and len(initials) > 1:
                best = max(best, (0.95, kind))
    return best


def _person(word: str) -> str | None:
    """The full given name of a name, a short form or a misspelling of four letters or more."""
    if word in _SHORT:
        return _SHORT[word]
    if len(word) >= 5:
        near = max(NICKNAMES, key=lambda n: ratio(word, n))
        if ratio(word, near) >= 0.8:
            return near
    return None


def _english(text: str) -> dict | None:
    number = "".join(regex.findall(r"\d+", text)[:1])
    words = [w for w in (_bare(x).strip(".'’") for x in regex.split(r"[\s,()（）:：;]+", regex.sub(r"\S*\d+\S*", " ", text))) if w]
    words = [w for w in words if w != "-"]
    if len(words) < 2:
        return None
    best = (0.0, None, 0, 0)
    spans = [(i, j) for i in range(len(words)) for j in range(i + 1, min(len(words), i + 4) + 1) if j - i < len(words)]
    plain = [(j - i, _EXACT[w], i, j) for i, j in spans if (w := " ".join(words[i:j])) in _EXACT]
    if plain:  # a kind that is written in full or in a usual short form
        best = (2.0, *max(plain)[1:])
    else:
        for i, j in spans:
            r, kind = _english_kind(tuple(words[i:j]))
            r += 0.02 * (j - i)
            if kind and r > best[0]:
                best = (r, kind, i, j)
    if best[0] < 0.72:
        return None
    rest = [w for w in words[: best[2]] + words[best[3] :] if w not in _LINKING]
    person, initials, others = None, [], []
    for w in rest:
        p = _person(w)
        if p and person is None:
            person = p
        elif len(w) == 1:
            initials.append(w)
        else:
            others.append(w)
    others = sorted(others, key=len)
    if not others:
        return None
    brand = others[-1]
    place = others[-2] if len(others) > 1 else ""
    if initials and not place and not person:
        place = initials[0] + "."
    elif initials and not person:
        person = initials[0] + "."
    return {"kind": best[1], "number": number, "person": person or "", "place": place, "brand": brand, "stem": ""}


@lru_cache(maxsize=100_000)
def _han_kind(tail: str) -> tuple[float, str | None]:
    best: tuple[float, str | None] = (0.0, None)
    for kind, (_, forms) in KINDS.items():
        for f in forms:
            r = ratio(tail, f)
            if r > best[0] + 1e-9:
                best = (r, kind)
        # any shortening that keeps the order of letters
        full = forms[0]
        if len(tail) >= 2 and lcs(tail, full) == len(tail):
            best = max(best, (0.8 + 0.02 * len(tail) + (0.05 if tail[-1] == full[-1] else 0), kind))
    return best


@lru_cache(maxsize=100_000)
def _han_fit(tail: str) -> float:
    """How well a kind explains the end of a name: letters it has in common, less those it does not know and, lightly, those it misses."""
    fits = ((lcs(tail, f), len(f)) for _, forms in KINDS.values() for f in forms[:1])
    return max(n - 1.5 * (len(tail) - n) - 0.1 * (size - n) for n, size in fits)


def _chinese(text: str) -> dict | None:
    t = "".join(SIMPLIFIED.get(c, c) for c in text)
    number = "".join(regex.findall(r"\d+", t)[:1])
    inner = regex.match(r"^(.*?)[（(]([^（）()]*)[)）]\s*$", t)
    latin = "".join(regex.findall(r"[\p{Latin}\p{M}]+", t))
    han = lambda s: "".join(regex.findall(r"\p{Han}", regex.sub(r"第?\s*\d+\s*號?", "", s)))
    if inner:
        tail, stem = han(inner[1]), han(inner[2])
    elif latin:
        cut_at = t.rfind(latin[-1])
        stem, tail = han(t[:cut_at]), han(t[cut_at:])
    else:
        numbered = regex.match(r"^(\p{Han}+?)第?\s*\d+\s*號?(\p{Han}+)$", t.replace(" ", ""))
        if numbered:
            stem, tail = numbered[1], numbered[2]
        else:
            whole, best = han(t), (0.0, 0)
            exact = next((k for k in range(2, len(whole) - 1) if whole[k:] in _EXACT_HAN), None)
            if exact:  # the longest kind that is written in full or in a usual short form
                best = (2.0, exact)
            for k in range(2, len(whole) - 1) if not exact else ():
                r = _han_fit(whole[k:])
                if r > best[0]:
                    best = (r, k)
            stem, tail = whole[: best[1]], whole[best[1] :]
    r, kind = (1.0, _EXACT_HAN[tail]) if tail in _EXACT_HAN else _han_kind(tail) if tail else (0.0, None)
    if r < 0.55 or not kind or not (stem or latin):
        return None
    return {"kind": kind, "number": number, "person": "", "place": "", "brand": _bare(latin), "stem": stem}


def _untyped(text: str) -> dict | None:
    """A name without a known kind: its words in ``brand``, sorted; its Han letters in ``stem``."""
    number = "".join(regex.findall(r"\d+", text)[:1])
    stem = "".join(SIMPLIFIED.get(c, c) for c in regex.findall(r"\p{Han}", text))
    words = [_bare(w).strip(".'’-") for w in regex.split(r"[^\p{L}\p{M}.'’-]+", regex.sub(r"\S*\d+\S*|\p{Han}", " ", text))]
    words = sorted(LEGAL.get(w, _SHORT.get(w, w)) for w in words if w and w not in _LINKING)
    if not words and not stem and not number:
        return None
    return {"kind": "", "number": number, "person": "", "place": "", "brand": " ".join(words), "stem": stem}


def read_name(text: str | None) -> dict | None:
    """The parts of a name; ``kind`` is empty where it has no known one. None where nothing can be read."""
    if not text:
        return None
    t = transducer().apply(text).strip()
    return (_chinese(t) if regex.search(r"\p{Han}", t) else _english(t)) or _untyped(t)


_PARTS = ["kind", "number", "person", "place", "brand", "stem"]
_KNOWN: dict[str, dict | None] = {}


def _remembered(text: str) -> dict | None:
    """``read_name``, read once for names that repeat in a worker."""
    if text not in _KNOWN:
        if len(_KNOWN) > 200_000:
            _KNOWN.clear()
        _KNOWN[text] = read_name(text)
    return _KNOWN[text]


def forms(records: DataFrame, id_col: str = "id", names: tuple[str, ...] = ("name_zh", "name_en"), lists: tuple[str, ...] = ("aliases",), url: str = "official_url") -> DataFrame:
    """(id, fid, parts..., dom): the distinct forms of each id, written once.

    ``dom`` is the first label of a site of the organisation's own (no path), '' if none is given. Names are read where
    their records lie; what is shuffled are distinct parts.
    """
    parts = [F.array(*names)] + [F.coalesce(F.col(x), F.array().cast("array<string>")) for x in lists]
    base = records.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.array_distinct(F.filter(F.concat(*parts), is_real)).alias("texts"),
        F.regexp_extract(F.coalesce(F.lower(F.trim(F.col(url))), F.lit("")), r"^https?://(?:www\.|m\.|shop\.)?([a-z0-9-]+)\.[a-z.]+/?$", 1).alias("dom"))
    columns = ["id", *_PARTS, "dom"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for key, texts, dom in zip(*(c.to_pylist() for c in batch.columns)):
                found = [f for f in map(_remembered, texts) if f]
                rows.update((key, *(f[p] for p in _PARTS), dom) for f in found)
                if dom and not found:
                    rows.add((key, *[None] * len(_PARTS), dom))  # tells the site of an id whose names stand in other rows
            made = list(zip(*rows)) if rows else [()] * len(columns)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), batch.schema.field("id").type if n == "id" else pa.string()) for n, c in zip(columns, made)], names=columns)

    kind = records.schema[id_col].dataType.simpleString()
    each = spread(base).mapInArrow(read, f"id {kind}, " + ", ".join(f"{p} string" for p in _PARTS) + ", dom string").distinct()
    # one site for an id; a name without a kind counts only where an id has no other
    own = Window.partitionBy("id")
    each = each.withColumns({"dom": F.coalesce(F.min(F.nullif("dom", F.lit(""))).over(own), F.lit("")), "typed": F.coalesce(F.max(F.col("kind") != "").over(own), F.lit(False))})
    each = each.where("kind <> '' or (kind = '' and not typed)").drop("typed").dropDuplicates(["id", *_PARTS])
    # a single word, or two Han letters, is a form of its own id only: equal ones need not mean the same
    alone = F.when(F.expr("kind = '' and dom = '' and instr(brand, ' ') = 0 and length(stem) < 3"), F.col("id").cast("string")).otherwise(F.lit(""))
    return cut(each.withColumn("fid", stable_hash(*_PARTS, "dom", alone, seed=3)))


def usual_letters(own: DataFrame) -> set[str]:
    """Letters that make up Han stems, by share of all; at most 1 / USUAL_LETTER of them."""
    each = own.where("stem <> ''").select(F.explode(F.split("stem", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    total = each.agg(F.sum("n").alias("t"))
    return {r.c for r in each.crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("t") * USUAL_LETTER).select("c").collect()}  # total: one row


@lru_cache(maxsize=100_000)
def near_keys(token: str, share: float) -> list[str]:
    """Keys of which two tokens have one in common if their ratio is at least ``share``: for each length
    the other one may have, the subsequences as long as the common one must be."""
    n, out = len(token), []
    for k in range(1, int(n * (2 - share) / share) + 2):
        m = next((x for x in range(1, min(n, k) + 1) if 2 * x / (n + k) >= share), None)
        if m is None:
            continue
        pair = f"{min(n, k)},{max(n, k)}"
        if comb(max(n, k), m) > MOST_KEYS:
            out.append(pair)
        else:
            out += sorted({f"{pair}:{''.join(x)}" for x in combinations(token, m)})
    return out


def one_off(word: str, loose: int = LOOSE_WORD) -> set[str]:
    """Keys of which two words have one in common if they are equal or, from ``loose`` letters, differ by one letter more, less or other, or two swapped."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) >= loose else {word}


def _told_place(place: str) -> bool:
    """More than an initial."""
    return bool(place) and not place.endswith(".")


def block_keys(form: dict) -> list[tuple[str, str]]:
    """(role, key) of the blocks of a form: b, p, s for brand, place and the stem beside a brand, which may
    be refined; x and d for stems and domains, which are compared as they are."""
    brand, place, stem, out = form["brand"], form["place"], form["stem"], []
    if not form["kind"]:
        words = brand.split()
        out = [("g", k) for k in sorted({k for w in words for k in one_off(w)})] if len(words) > 1 else []
        if stem:
            out += [("x", k) for k in sorted(one_off(stem, 4))]
        return out + ([("d", form["dom"])] if form["dom"] else [])
    if brand:
        out.append(("b", brand[-MIN_LATIN:]))
    if _told_place(place):
        out.append(("p", place[-MIN_LATIN:]))
        if brand:
            # brand and place both differ; equal ones share a suffix
            out += [("b", k) for k in near_keys(brand, NEARER) if not k.endswith(":" + brand) or not k.startswith(f"{len(brand)},{len(brand)}:")]
            out += [("p", k) for k in near_keys(place, NEARER) if not k.endswith(":" + place) or not k.startswith(f"{len(place)},{len(place)}:")]
    if stem and brand:
        out += [("s", k) for k in near_keys(stem, NEAR_STEM)]
    elif stem:  # one letter more, less or other
        out += [("x", k) for k in {stem, *(stem[:i] + stem[i + 1 :] for i in range(len(stem)) if len(stem) > 2)}]
    if form["dom"]:
        out.append(("d", form["dom"]))
    return out


def refined_keys(role: str, form: dict) -> list[tuple[str, int]]:
    """(key, side) that refine a common block of a role by the other token. Forms of side 1 are compared only
    with those of side 0: whole places with initials of a place, which need the same brand."""
    brand, place, stem = form["brand"], form["place"], form["stem"]
    if role == "g":  # all words agree, so every two words do
        keys = sorted((one_off(w) for w in brand.split()), key=min)
        return sorted({(f"g{a} {b}", 0) for x, y in combinations(keys, 2) for m in x for n in y for a, b in [sorted((m, n))]})
    if role != "b":
        return [(k, 0) for k in near_keys(brand, NEAR_BRAND)]
    out = [("s" + k, 0) for k in near_keys(stem, NEAR_STEM)]
    if place:
        out.append((f"i{place[0]} {brand}", int(_told_place(place))))
    if _told_place(place):
        out += [("p" + k, 0) for k in near_keys(place, NEAR_PLACE)]
    return out


def _each(df: DataFrame, make) -> DataFrame:
    """(fid, role, key, side): ``make(role, form)`` of each row (fid, role, parts..., dom)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["fid"], *k) for r in batch.to_pylist() for k in make(r["role"], r)]
            yield pa.RecordBatch.from_pydict({"fid": pa.array([r[0] for r in rows], pa.int64()), "role": pa.array([r[1] for r in rows], pa.string()), "key": pa.array([r[2] for r in rows], pa.string()), "side": pa.array([r[3] for r in rows], pa.int32())})

    return df.mapInArrow(run, "fid bigint, role string, key string, side int")


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs of forms (a_..., b_...) that share a block; the blocks are described in the module text."""
    c = F.col
    first = _each(nodes.withColumn("role", F.lit("")), lambda _, f: [(role, f"{f['kind']} {f['number']} {k}", 0) for role, k in block_keys(f)])
    keyed = cut(first.select("fid", "role", stable_hash("role", "key", seed=1).alias("block"), "side").distinct())
    sizes = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = keyed.join(sizes, "block")
    hot = keyed.where((c("n") > COMMON) & c("role").isin("b", "p", "s", "g")).drop("side")
    more = _each(hot.join(nodes, "fid").withColumn("role", F.concat("role", c("block").cast("string"))), lambda at, f: [(at, k, side) for k, side in refined_keys(at[0], f)])
    refined = more.select("fid", stable_hash("role", "key", seed=2).alias("block"), "side").distinct()
    kept = keyed.where((c("n") <= COMMON) | ~c("role").isin("b", "p", "s", "g")).select("fid", "block", "side")
    keyed = cut(kept.union(refined).join(nodes, "fid").select("block", "side", "fid", *_PARTS, "dom"))
    a = keyed.where("side = 0").select("block", *[c(x).alias("a_" + x) for x in ["fid", *_PARTS, "dom"]])
    b = keyed.select("block", "side", *[c(x).alias("b_" + x) for x in ["fid", *_PARTS, "dom"]])
    # cheap tests that every linked pair passes: the edit distance is at most the share of letters that
    # the ratio of the longest common subsequence may leave out
    backed = "a_dom <> '' and a_dom = b_dom"
    near = lambda x, loose, strict: (
        f"(a_{x} = '' or b_{x} = '' or levenshtein(a_{x}, b_{x}) <= (length(a_{x}) + length(b_{x})) * if({backed}, {loose}, {strict}))")
    tests = [
        "(a_fid < b_fid or side = 1) and a_kind = b_kind and a_number = b_number", "(a_dom = '' or b_dom = '' or a_dom = b_dom)",
        "(a_person = '' or b_person = '' or left(a_person, 1) = left(b_person, 1))", f"(a_kind = '' or {near('brand', 0.5, 0.25)})", f"(a_place like '%.' or b_place like '%.' or {near('place', 0.7, 0.28)})",
        f"(a_brand <> '' or b_brand <> '' or a_stem = '' or b_stem = '' or {backed} or levenshtein(a_stem, b_stem) <= 2)",
    ]
    return a.join(b, "block").where(" and ".join(tests)).drop("block", "side")


def same_person(a: str, b: str) -> bool:
    """Equal, an initial of the other, or one of them not told."""
    if not a or not b or a == b:
        return True
    return a[0] == b[0] and (a.endswith(".") or b.endswith("."))


def _alike_untyped(a: dict, b: dict, usual: set[str]) -> bool:
    """The decision on two names without a kind."""
    if a["dom"] and b["dom"] and a["dom"] != b["dom"]:
        return False
    backed = bool(a["dom"]) and a["dom"] == b["dom"]
    if a["stem"] or b["stem"]:
        s, t = sorted((a["stem"], b["stem"]), key=len)
        near = s == t or (len(s) >= 4 and bool(one_off(s, 4) & one_off(t, 4)) and len(t) - lcs(s, t) <= 1)
        other = len(s) == len(t) and sorted(s) != sorted(t) and all(x in usual and y in usual for x, y in zip(s, t) if x != y)
        return a["brand"] == b["brand"] and near and not other
    rest, words = b["brand"].split(), a["brand"].split()
    if len(words) != len(rest) or (len(words) < 2 and not backed):
        return False
    for w in [w for w in words if w not in rest] if words != rest else ():
        fit = next((x for x in rest if x not in words and one_off(w) & one_off(x) and ratio(w, x) >= 0.75), None)
        if fit is None:
            return False
        rest.remove(fit)
    return bool(words)


def alike(a: dict, b: dict, usual: set[str]) -> bool:
    """The decision on two forms of one kind and number."""
    if not a["kind"]:
        return _alike_untyped(a, b, usual)
    if not same_person(a["person"], b["person"]):
        return False
    backed = bool(a["dom"]) and a["dom"] == b["dom"]
    if a["dom"] and b["dom"] and not backed:
        return False
    told = False
    if a["brand"] and b["brand"]:
        r = ratio(a["brand"], b["brand"])
        if r < (0.5 if backed else 0.75):
            return False
        if a["place"] and b["place"]:
            if a["place"].endswith(".") or b["place"].endswith("."):
                p = 1.0 if a["place"][0] == b["place"][0] else 0.0
                if r < 1 and not backed:
                    return False
            else:
                p = ratio(a["place"], b["place"])
            if p < (0.3 if backed else 0.72) or (r < 1 and p < 1 and not backed and r + p < 1.72):
                return False
            told = True
        elif a["stem"] and b["stem"] and ratio(a["stem"], b["stem"]) >= 0.6:
            told = True
    if a["stem"] and b["stem"] and not (a["brand"] and b["brand"]) and bool(a["brand"]) == bool(b["brand"]):
        s, t = sorted((a["stem"], b["stem"]), key=len)
        if s == t:
            told = True
        else:
            common = lcs(s, t)
            off = len(t) - common
            if backed:
                if common * 2 < len(s):
                    return False
            elif off > 1 or len(s) < 3:
                return False
            elif len(s) == len(t) and sorted(s) != sorted(t) and all(x in usual and y in usual for x, y in zip(s, t) if x != y):
                return False  # two real names that differ in a letter
            told = True
    return told or backed


def links(own: DataFrame) -> DataFrame:
    """(a, b): linked forms."""
    nodes = own.select("fid", *_PARTS, "dom").distinct()
    usual = own.sparkSession.sparkContext.broadcast(usual_letters(own))  # bounded by 1 / USUAL_LETTER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            keep_a, keep_b = [], []
            for i in range(batch.num_rows):
                x = {p: d["a_" + p][i] for p in (*_PARTS, "dom")}
                y = {p: d["b_" + p][i] for p in (*_PARTS, "dom")}
                if alike(x, y, usual.value):
                    keep_a.append(d["a_fid"][i])
                    keep_b.append(d["b_fid"][i])
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])

    return candidates(nodes).mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the connected components of (a, b): smallest label of the neighbours, with
    labels followed to their own labels, until nothing changes. Each round is written once."""
    both = cut(edges.union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        hop = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        after = cut(step.join(hop, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("next"), "label"))
        if after.where("next <> label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", F.col("next").alias("label"))


def classes(own: DataFrame) -> DataFrame:
    """(id, class_id): the class of each id that has a readable name."""
    first = own.groupBy("id").agg(F.min("fid").alias("first"))
    star = own.join(first, "id").select(F.col("first").alias("a"), F.col("fid").alias("b")).where("a <> b")
    labels = components(links(own).union(star))
    return first.join(labels, F.col("first") == F.col("node"), "left").select("id", F.coalesce("label", "first").alias("class_id"))


def _persons(own: DataFrame) -> DataFrame:
    return own.where("person <> ''").groupBy("id").agg(F.max("person").alias("person"))


def same_organisation(records: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: different ids of one organisation."""
    own = forms(records)
    named = cut(classes(own).join(_persons(own), "id", "left"))
    a = named.select("class_id", F.col("id").alias("id_a"), F.coalesce("person", F.lit("")).alias("pa"))
    b = named.select("class_id", F.col("id").alias("id_b"), F.coalesce("person", F.lit("")).alias("pb"))
    dot = lambda x, y: F.col(x).endswith(".") & (F.substring(x, 1, 1) == F.substring(y, 1, 1))
    fits = (F.col("pa") == "") | (F.col("pb") == "") | (F.col("pa") == F.col("pb")) | dot("pa", "pb") | dot("pb", "pa")
    return a.join(b, "class_id").where((F.col("id_a") < F.col("id_b")) & fits).select("id_a", "id_b")


def membership(records: DataFrame) -> DataFrame:
    """(id, class_id, class_size): one row for each id with a readable name."""
    named = cut(classes(forms(records)))
    return named.join(named.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")), "class_id").select("id", "class_id", "class_size")
