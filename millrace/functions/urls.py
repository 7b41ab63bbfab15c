"""URLs as Column expressions: one form for comparison, host and site tests, registrable domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An own short list of suffixes under which names are registered; callers give a full one.
SUFFIXES = [
    "com.tw", "org.tw", "gov.tw", "edu.tw", "net.tw", "idv.tw", "co.jp", "or.jp", "ne.jp", "go.jp", "ac.jp", "co.uk", "org.uk", "gov.uk", "ac.uk", "com.cn", "gov.cn", "org.cn",
    "com.hk", "gov.hk", "com.au", "gov.au", "co.kr", "or.kr", "com.sg", "com.br", "co.nz", "com.mx", "co.in", "github.io", "blogspot.com", "appspot.com", "herokuapp.com",
]


def host(url: Column) -> Column:
    """Lower-case host without port; null if the text is no URL with one."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def normalize_url(url: Column) -> Column:
    """Host (lower case, no leading www.) + path without trailing slashes + query without utm_ fields;
    no scheme, port or fragment. A text that is no URL gives itself in lower case."""
    t = F.trim(url)
    path = F.regexp_replace(F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(t, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    return F.when(host(t).isNull(), F.lower(t)).otherwise(
        F.concat(F.regexp_replace(host(t), r"^(?:www\.)+", ""), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def on_site(url: Column, site: str) -> Column:
    """Is the URL on the site or one of its sub-domains?"""
    s = site.strip().lower()
    while s.startswith("www."):
        s = s[4:]
    h = F.regexp_replace(host(url), r"^(?:www\.)+", "")
    return F.coalesce((h == s) | h.endswith("." + s), F.lit(False))


def registrable(h: Column, suffixes: list[str] | None = None) -> Column:
    """The domain that was registered: one label more than the longest known suffix; null for addresses,
    single labels and bare suffixes."""
    known = suffixes or SUFFIXES
    parts = F.split(F.lower(h), r"\.")
    n = F.size(parts)
    two = F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(parts, F.greatest(n - 2, F.lit(1)), F.lit(3)), ".")
    ip = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^\[")
    return F.when(h.isNull() | ip | (n < 2), None).when(two.isin(known), F.when(n > 2, three)).otherwise(two)
