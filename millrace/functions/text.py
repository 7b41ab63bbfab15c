"""Text as Column expressions: Markdown to plain text, words, URLs, citations, snippets, percent codes, tags."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: letters that count as a word each.
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}\x{20000}-\x{2FA1F}"


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?(?:-->|\z)", "")


def word_count(c: Column) -> Column:
    """Runs of letters and digits count once (inner ' - . , belong), each Han, kana and hangul letter
    once; comments, link targets and bare URLs do not count. Null counts 0."""
    t = F.regexp_replace(strip_comments(c), r"\]\((?:<[^)]*|[^)\s]*)\)", "]")
    t = F.regexp_replace(t, r"(?:^|(?<=\s))https?://\S*", "")
    pattern = rf"[{CJK}]|[\p{{L}}\p{{N}}&&[^{CJK}]](?:['’.,-]*[\p{{L}}\p{{N}}&&[^{CJK}]])*"
    return F.coalesce(F.size(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))), F.lit(0)).cast("bigint")


def urls(c: Column) -> Column:
    """All http(s) URLs in order, without trailing punctuation."""
    found = F.regexp_extract_all(strip_comments(c), F.lit(r"https?://[^\s)>\"<\]|]*"), F.lit(0))
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?']+$", "")), lambda u: F.length(u) > 8)


def citations(c: Column) -> Column:
    """struct<inline, footnote, numbered: bigint>: citation marks by style; definitions are none."""
    t = F.regexp_replace(strip_comments(c), r"(?m)^[ \t]*\[\^[^\n]*\]:[^\n]*$", "")
    count = lambda p: F.coalesce(F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0))), F.lit(0)).cast("bigint")
    return F.struct(
        count(r"\]\(<?http|(?<!\]\()<http").alias("inline"), count(r"\[\^[^\]\n]+\](?!:)").alias("footnote"),
        count(r"(?<![\]!])\[\s*\d+\s*(?:,\s*\d+\s*)*\](?![(:])").alias("numbered"))


def snippet(c: Column, most: int = 240) -> Column:
    """Collapsed text of at most ``most`` letters, cut at a space in the last third, with an ellipsis."""
    t = collapse(c)
    head = F.substring(t, 1, most)
    word = F.regexp_extract(head, rf"(?s)^(.{{{most * 2 // 3 + 1},}}) \S*$", 1)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.when(word != "", word).otherwise(head), r"[,.;: ]+$", ""), F.lit("…")))


def percent_encode(c: Column) -> Column:
    """RFC 3986: everything but letters, digits and - . _ ~ as percent codes."""
    t = F.url_encode(c)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\+", "%20"), "%7E", "~"), r"\*", "%2A")


def percent_decode(c: Column) -> Column:
    """Percent codes as text; a text with a broken code stays as it is; + is no space."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)


def shell_quote(c: Column) -> Column:
    """The text as one word of a shell: as it is if it holds plain letters only, else in single quotes."""
    quoted = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(c.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), c).otherwise(quoted)


def strip_tags(c: Column) -> Column:
    """HTML without tags, entities decoded, white space collapsed."""

    @F.arrow_udf(T.StringType())
    def decode(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())

    return collapse(decode(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", "")))


def page_title(c: Column) -> Column:
    """The text of the first <title> with the usual entities decoded; null if there is none or it is blank."""
    t = F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title", 1)
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(ch))
    return F.nullif(collapse(t), F.lit(""))


def has_cjk(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[{CJK}]"), F.lit(False))


def has_kana(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[\x{3040}-\x{30FF}]"), F.lit(False))
