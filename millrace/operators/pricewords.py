"""Reading of a written price: amount, currency, time span, counting unit and scale, in seven languages.

Only evidence is read here; ``units`` decides between readings and converts.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Money signs and codes with the ISO codes; '' where the sign alone does not tell.
SIGNS = {
    "US$": "USD", "NT$": "TWD", "HK$": "HKD", "CA$": "CAD", "AU$": "AUD", "NZ$": "NZD", "SG$": "SGD", "MX$": "MXN", "C$": "CAD", "A$": "AUD",
    "S$": "SGD", "R$": "BRL", "€": "EUR", "£": "GBP", "₩": "KRW", "₹": "INR", "円": "JPY", "NTD": "TWD", "RMB": "CNY",
    "US cents": "US¢", "USD cents": "US¢", "¢ (US)": "US¢", "euro cents": "EU¢", "EUR cents": "EU¢", "pence": "GB¢", "$": "", "¥": "", "￥": "", "元": "",
}
#: Sub-units, as (currency, share of one).
SUBUNITS = {"US¢": ("USD", 0.01), "EU¢": ("EUR", 0.01), "GB¢": ("GBP", 0.01)}
#: Whose money a bare sign means, by country; and elsewhere.
BARE = {
    "$": ({"tw": "TWD", "ca": "CAD", "au": "AUD", "nz": "NZD", "sg": "SGD", "hk": "HKD"}, "USD"),
    "¥": ({"cn": "CNY"}, "JPY"), "￥": ({"cn": "CNY"}, "JPY"), "元": ({"tw": "TWD", "hk": "HKD"}, "CNY"),
}
#: Names of currencies in running text.
CURRENCY_WORDS = {
    "TWD": ["New Taiwan dollar", "Neue Taiwan-Dollar", "nouveaux dollars de Taïwan", "nuevos dólares taiwaneses", "新臺幣", "新台幣", "台湾ドル"],
    "USD": ["US dollar", "US-Dollar", "dollars américains", "dólares estadounidenses", "美元", "米ドル"],
    "EUR": ["euro", "歐元", "欧元", "ユーロ"], "GBP": ["pounds sterling", "pound sterling", "Pfund Sterling", "livres sterling", "libras esterlinas", "英鎊", "ポンド"],
    "JPY": ["yen", "日圓", "日元"], "KRW": ["won", "韓元", "韓圓", "ウォン"], "CNY": ["renminbi", "yuan", "人民幣", "人民元"], "HKD": ["Hong Kong dollar", "Hongkong-Dollar", "港幣", "港元"],
    "CAD": ["Canadian dollar", "kanadische Dollar", "加元"], "AUD": ["Australian dollar", "australische Dollar", "澳元"], "SGD": ["Singapore dollar", "新加坡元"],
    "CHF": ["Swiss franc", "Schweizer Franken", "francs suisses", "francos suizos"], "INR": ["rupee", "Rupien", "roupie", "rupia", "盧比"],
    "NZD": ["New Zealand dollar"], "MXN": ["Mexican peso"], "BRL": ["Brazilian real"], "SEK": ["Swedish krona"], "NOK": ["Norwegian krone"], "DKK": ["Danish krone"],
}
#: Time spans; each group of words means the unit, in order of how long its words are.
PERIODS = {
    "year": [r"twelve months", r"12 months", r"zwölf Monate\w*", r"douze mois", r"doce meses", r"doze meses", r"十二個月", r"十二个月", r"十二か月", r"12 ?個月", r"12 ?か月",
             r"p\. ?a\.", r"per annum", r"annum", r"annually", r"annual", r"yearly", r"years?\b", r"yrs?\b", r"jährlich\w*", r"Jahr(?:es)?\b", r"\bans?\b", r"annuel\w*", r"année", r"años?\b", r"anual\w*", r"anos?\b",
             r"年"],
    "quarter": [r"three months", r"3 months", r"drei Monate\w*", r"trois mois", r"tres meses", r"três meses", r"三個月", r"三个月", r"三か月", r"3 ?個月", r"3 ?か月",
                r"quarterly", r"quarter", r"qtr", r"Quartal\w*", r"vierteljährlich\w*", r"trimestr\w*", r"四半期", r"季"],
    "week": [r"weekly", r"weeks?\b", r"wks?\b", r"Woche\w*", r"wöchentlich\w*", r"semaine\w*", r"hebdomadaire\w*", r"seman\w*", r"週間?", r"周", r"星期", r"禮拜"],
    "day": [r"(?:24|twenty-four) ?(?:hours?|Stunden?|heures?|horas?|小時|小时|時間)", r"daily", r"days?\b", r"Tag(?:e|es)?\b", r"Tagessatz", r"täglich\w*", r"jours?\b", r"journali\w*", r"quotidien\w*", r"días?\b", r"diari[oa]\w*", r"dias?\b",
            r"天", r"日"],
    "hour": [r"hourly", r"hours?\b", r"hrs?\b", r"Stunden?\w*", r"stündlich\w*", r"heures?\b", r"horaire", r"horas?\b", r"小時", r"小时", r"時間"],
    "month": [r"(?:one|1) month", r"一個月", r"一个月", r"一か月", r"monthly", r"months?\b", r"mos?\b", r"monatlich\w*", r"Monat\w*", r"mensuel\w*", r"mois\b", r"mensual\w*", r"mes(?:es)?\b", r"mensal\w*", r"mês", r"月"],
}
#: Prices that are paid once.
ONCE = (r"one[- ]?(?:time|off)|lifetime|\bonce\b|買斷|买断|一次付清|一次性|pago único|se paga una vez|una sola vez|pagamento único|einmal\w*|"
        r"paiement unique|une (?:seule )?fois|買い切り|一度だけ|一回払い|永久")
#: Counting units.
UNITS = {
    "user": [r"users?\b", r"Nutzer\w*", r"Benutzer\w*", r"utilisateurs?\b", r"usuarios?\b", r"usuários?\b", r"使用者", r"用戶", r"利用者", r"ユーザー", r"人", r"(?<![單单単席])位"],
    "seat": [r"seats?\b", r"Pl(?:atz|ätze)\b", r"postes?\b", r"puestos?\b", r"assentos?\b", r"席位?"],
    "member": [r"members?\b", r"Mitglied\w*", r"membres?\b", r"miembros?\b", r"membros?\b", r"會員", r"会员", r"会員", r"成員"],
    "device": [r"devices?\b", r"Geräte?\w*", r"appareils?\b", r"dispositivos?\b", r"裝置", r"装置", r"設備", r"端末"],
    "host": [r"hosts?\b", r"hôtes?\b", r"主機", r"主机", r"ホスト"],
    "TB": [r"TB\b", r"terabytes?\b"], "GB": [r"GB\b", r"gigabytes?\b"], "MB": [r"MB\b", r"megabytes?\b"],
}
#: An account as the counting unit means that there is none.
ACCOUNT = r"whole account|account|Konto|帳戶|帐户|cuenta|compte|アカウント"
#: Magnitudes written at the number, and scales told for a line or a site.
MAGNITUDES = {"thousand": 1e3, "Tausend": 1e3, "mille": 1e3, "mil": 1e3, "Millionen": 1e6, "k": 1e3, "K": 1e3, "千": 1e3, "萬": 1e4, "万": 1e4, "億": 1e8, "亿": 1e8, "M": 1e6, "million": 1e6, "millions": 1e6, "m": 1e6, "bn": 1e9, "B": 1e9}
SCALES = [
    (r"hundredths?|hundertstel|百分之一|centièmes?|centésim\w+|百分の一", 0.01),
    (r"in thousands|thousands of|thousands?\b|['’]000|in Tausend|Tausend|en miles|miles de|en milliers|milliers|em milhares|千単位|單位：千|单位：千|以千計|以千计|千(?=\w|$)", 1e3),
    (r"in millions|millions of|in Millionen|en millones|百萬", 1e6),
    (r"單位：萬|单位：万|以萬計|以万计|万単位|萬(?=\p{Han}|$)", 1e4),
]

_NUMBER = re.compile(r"(?<![\w.,])(?:(?:US|NT|HK|CA|AU|NZ|SG|MX|C|A|S|R)?[$€£¥￥₩₹]|[A-Z]{3})?\s*(\d[\d.,'’   ]*\d|\d)\s*((?:thousand|Tausend|mille|mil|millions?|Millionen|bn|[kKMB])(?![A-Za-zÀ-ÿ(])|[千萬万億亿])?")
_SIGN = re.compile("|".join(re.escape(s) for s in sorted(SIGNS, key=len, reverse=True)) + r"|(?<![A-Za-z])(USD|TWD|EUR|GBP|JPY|CNY|HKD|AUD|CAD|SGD|CHF|INR|KRW|BRL|NZD|SEK|NOK|DKK|MXN)(?![A-Za-z])", re.I)
_WORDS = [(c, re.compile("|".join(re.escape(w) for w in ws), re.I)) for c, ws in CURRENCY_WORDS.items()]
_CURRENCY_WORD = re.compile("|".join(re.escape(w) for ws in CURRENCY_WORDS.values() for w in sorted(ws, key=len, reverse=True)), re.I)


def _edged(word: str) -> str:
    """The pattern between edges of Latin letters, so that it also ends before Han and kana."""
    if not re.match(r"[A-Za-zÀ-ÿ\\(]", word) or re.match(r"\(\?<", word):
        return word
    return r"(?<![A-Za-zÀ-ÿ])" + word.replace(r"\b", "") + ("" if word.endswith((r"\w*", r"\w+")) else r"(?![A-Za-zÀ-ÿ])")


_ONCE = re.compile(ONCE, re.I)
_PERIOD = re.compile("|".join(f"(?P<{u}>{'|'.join(map(_edged, ws))})" for u, ws in PERIODS.items()), re.I)
_UNIT = re.compile(r"(?:(?<![\w.,])(?P<n>\d[\d,]*)\s*)?(?:" + "|".join(f"(?P<{u}>{'|'.join(map(_edged, ws))})" for u, ws in UNITS.items()) + ")", re.I)
_ACCOUNT = re.compile(ACCOUNT, re.I)
_SCALES = [(re.compile(p.replace(r"\p{Han}", "一-鿿").replace("(?=一-鿿", "(?=[一-鿿]"), re.I), s) for p, s in SCALES]


def numbers(text: str) -> list[float]:
    """The values that a written number can mean, the likeliest first."""
    t = re.sub(r"[\s'’  ]", "", text)
    if "." in t and "," in t:
        last = max(t.rfind("."), t.rfind(","))
        whole, part = re.sub(r"[.,]", "", t[:last]), t[last + 1 :]
        return [float(f"{whole}.{part}")] if len(re.findall(re.escape(t[last]), t)) == 1 else [float(re.sub(r"[.,]", "", t))]
    sep = "," if "," in t else "." if "." in t else ""
    if not sep:
        return [float(t)]
    groups = t.split(sep)
    grouped = len(groups[0]) <= 3 and groups[0] != "0" and all(len(g) == 3 for g in groups[1:])
    whole = float("".join(groups))
    if len(groups) > 2:
        return [whole]
    decimal = float(".".join(groups))
    if not grouped:
        return [decimal]
    return [whole, decimal] if sep == "," else [decimal, whole]


@lru_cache(maxsize=50_000)
def currency_of(text: str | None, country: str | None) -> tuple[str | None, float, bool]:
    """(ISO code, share of one, told without the country) of the first sign or code in ``text``."""
    best: tuple[str | None, float, bool] = (None, 1.0, False)
    for m in _SIGN.finditer(text or ""):
        s = m.group(0)
        code = m.group(1).upper() if m.group(1) else next(v for k, v in SIGNS.items() if k.lower() == s.lower())
        if code in SUBUNITS:
            return (*SUBUNITS[code], True)
        if code:
            return code, 1.0, True
        if best[0] is None:
            here, other = BARE[s]
            best = (here.get((country or "").lower(), other), 1.0, False)
    return best


def currency_word(text: str | None) -> str | None:
    """ISO code of the first currency named in running text."""
    found = [(m.start(), -len(m.group(0)), c) for c, p in _WORDS if (m := p.search(text or ""))]
    return min(found)[2] if found else None


@lru_cache(maxsize=50_000)
def span_of(text: str | None) -> tuple[str, float] | None:
    """(unit, how many) of the first time span; ('once', 1) if the price is paid once."""
    t = text or ""
    once = _ONCE.search(t)
    m = _PERIOD.search(t)
    if once and (not m or once.start() <= m.start()):
        return "once", 1.0
    return (m.lastgroup, 1.0) if m else None


@lru_cache(maxsize=50_000)
def unit_of(text: str | None) -> tuple[str, float] | None:
    """(unit, how many) of the first counting unit; ('', 1) for an account."""
    t = text or ""
    m, a = _UNIT.search(t), _ACCOUNT.search(t)
    if a and (not m or a.start() < m.start()):
        return "", 1.0
    if not m:
        return None
    return m.lastgroup if m.lastgroup != "n" else None, float((m.group("n") or "1").replace(",", "")) or 1.0


@lru_cache(maxsize=50_000)
def scale_of(text: str | None) -> float | None:
    """The scale told for a line or a site."""
    for p, s in _SCALES:
        if p.search(text or ""):
            return s
    return None


@lru_cache(maxsize=20_000)
def read_note(note: str | None) -> dict | None:
    """What a site's note fixes: currency, span, unit, scale; None unless it names a currency and a span."""
    c = currency_word(note)
    rest = _CURRENCY_WORD.sub(" ", note or "")
    s = span_of(rest)
    if not c or not s:
        return None
    m = re.search(r"[千萬万](?=\s|$)", rest) if scale_of(rest) is None else None
    return {"currency": c, "span": s, "unit": unit_of(rest) or ("", 1.0), "scale": scale_of(rest) or (MAGNITUDES[m.group(0)] if m else 1.0)}


def read_row(raw: str | None, context: str | None) -> dict | None:
    """What the written price and its line tell: amounts (likeliest first), their texts, and what follows."""
    raw, context = raw or "", context or ""
    m = _NUMBER.search(raw)
    if not m:
        return None
    at = context.find(raw) if raw else -1
    rest = context[at + len(raw) :] if at >= 0 else ""
    magnitude = MAGNITUDES.get(m.group(2) or "", 1.0)
    after = raw[m.end() :] + " " + rest
    return {
        "amounts": [x * magnitude for x in numbers(m.group(1))], "plain": numbers(m.group(1)), "magnitude": magnitude,
        "span": span_of(after), "unit": unit_of(after), "scale": scale_of(after), "before": context[:at] if at >= 0 else "",
    }
