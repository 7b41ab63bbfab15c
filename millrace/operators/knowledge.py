"""A knowledge base of records: normalised search with a fuzzy score, imports, merges, ranked origins.

A search normalises the texts of the candidates (narrowed by kind) once in expressions; an Arrow function scores whole
batches for each term, equal texts of a batch once, sliding an edit distance and a shortest window over what does not hold the term.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.urls import host, registrable

#: Lowest score of a hit, of a near miss, and how many hits may be asked for.
HIT, CLOSE, MOST = 0.47, 0.32, 50
#: Letters that count as the same.
VARIANTS = {"份": "分", "証": "證", "台": "臺", "裡": "裏"}
#: Punctuation between the words of a query, and words that people add to a name.
PUNCTUATION = ",.，。、；;:：/／|｜()（）[]「」\"'？?！!+&＆"
STOP_WORDS = [
    "官方網站", "官方網址", "官方首頁", "官方網", "官方", "官網", "網站", "網址", "首頁", "主頁", "怎麼辦", "怎麼", "如何", "哪裡", "哪裏", "何處", "在哪裡", "在哪裏", "在哪", "申請", "辦理", "查詢", "是什麼", "是什么",
    "什麼", "什么", "website", "homepage", "official", "url",
]
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def normalize(c: Column) -> Column:
    """Half width, lower case, one of each variant letter, letters and digits only."""
    t = F.lower(F.translate(c, _WIDE, _NARROW))
    t = F.translate(t, "".join(VARIANTS), "".join(VARIANTS.values()))
    return F.regexp_replace(t, r"[^\p{IsAlphabetic}\p{N}]", "")


def normalized(text: str) -> str:
    """The plain twin of ``normalize``."""
    t = text.translate(str.maketrans(_WIDE, _NARROW)).lower().translate(str.maketrans(VARIANTS))
    return "".join(c for c in t if c.isalnum())


def query_terms(query: str) -> list[tuple[str, str, bool]]:
    """(shown, normalised, stop) terms: parted at spaces and punctuation, stop words peeled off both ends,
    the longest first; each normalised term once."""
    stops = sorted({normalized(s) for s in STOP_WORDS}, key=len, reverse=True)

    def peel(n: str) -> list[tuple[str, bool]]:
        if n in stops:
            return [(n, True)]
        for s in stops:
            if n.endswith(s) and len(n) > len(s):
                return [*peel(n[: -len(s)]), (s, True)]
            if n.startswith(s) and len(n) > len(s):
                return [(s, True), *peel(n[len(s) :])]
        return [(n, False)]

    out, seen = [], set()
    for piece in re.split(rf"[\s{re.escape(PUNCTUATION)}]+", query):
        n = normalized(piece)
        for term, stop in peel(n) if n else []:
            if term not in seen:
                seen.add(term)
                out.append((piece if term == n else term, term, stop))
    return out


def terms_of(query: Column) -> Column:
    """The normalised terms of a column of queries, as ``query_terms`` gives them; equal queries are read once in a batch."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def read(texts: pa.Array) -> pa.Array:
        memo: dict[str, list[str]] = {}
        return pa.array([None if q is None else memo[q] if q in memo else memo.setdefault(q, [n for _, n, _ in query_terms(q)]) for q in texts.to_pylist()], pa.list_(pa.string()))

    return read(query)


# ---------------------------------------------------------------- scores

def nearest_stretch(q: str, t: str) -> int:
    """Least edit distance of ``q`` to any stretch of ``t``, one column of bits for each letter of ``t``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(q):
        masks[c] = masks.get(c, 0) | 1 << i
    n = len(q)
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, now, best = full, 0, n, n
    for c in t:
        eq = masks.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(x | plus) & full, plus & x
        now += bool(up & top) - bool(down & top)
        best = min(best, now)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(x | up) & full, up & x
    return best


def shortest_window(text: str, wanted: str) -> int | None:
    """Length of the shortest stretch of ``text`` with all letters of ``wanted``, as often."""
    if not set(wanted) <= set(text):
        return None
    need, missing, left, best = Counter(wanted), len(wanted), 0, None
    for right, c in enumerate(text):
        if need[c] > 0:
            missing -= 1
        need[c] -= 1
        while missing == 0:
            best = min(best or right - left + 1, right - left + 1)
            need[text[left]] += 1
            if need[text[left]] > 0:
                missing += 1
            left += 1
    return best


def text_score(q: str, t: str, edit: bool) -> float:
    """0..1 of a normalised query against a normalised text: equal 1; inside 0.84 and more; else the best
    of edits, letter pairs and shortest window."""
    if not q or not t:
        return 0.0
    if q == t:
        return 1.0
    at = t.find(q)
    if at >= 0:
        return min(0.99, 0.84 + 0.12 * len(q) / len(t) + (0.03 if at == 0 else 0.0))
    best, n = 0.0, len(q)
    budget = 0 if n < 3 else 1 if n <= 6 else 2
    if edit and budget and len(t) <= 80 and n <= 24:
        if len(t) >= max(1, n - budget) and 0 < (d := nearest_stretch(q, t)) <= budget:
            best = 0.78 * (1 - d / n)
    if n >= 4:
        pairs, there = [q[i : i + 2] for i in range(n - 1)], {t[i : i + 2] for i in range(len(t) - 1)}
        share = sum(p in there for p in pairs) / len(pairs)
        if share >= 0.67:
            best = max(best, 0.40 + 0.28 * share)
    if n >= 2 and (win := shortest_window(t, q)):
        share = n / win
        best = max(best, min(0.74, 0.36 + 0.42 * share if win <= 3 * n + 1 else 0.30 * share if win <= 5 * n + 2 else 0.0))
    return best


def score(text: Column, query_norm: str, edit: bool = True) -> Column:
    """Score of a raw text column; equal and inside are expressions, the rest one Arrow function."""
    t = normalize(text)
    at = F.instr(t, query_norm)

    @F.arrow_udf(T.DoubleType())
    def fuzzy(texts: pa.Array) -> pa.Array:
        memo: dict[str, float] = {}
        out = []
        for x in texts.to_pylist():
            if x is None:
                out.append(None)
            else:
                if x not in memo:
                    memo[x] = text_score(query_norm, x, edit)
                out.append(memo[x])
        return pa.array(out, pa.float64())

    inside = F.least(F.lit(0.99), F.lit(0.84) + F.lit(0.12 * len(query_norm)) / F.length(t) + F.when(at == 1, 0.03).otherwise(0.0))
    rest = fuzzy(F.when((t != "") & (at == 0), t))
    return F.coalesce(F.when(t == query_norm, 1.0).when((at > 0) & (t != ""), inside).otherwise(rest), F.lit(0.0)) if query_norm else F.lit(0.0)


def substring_score(text: Column, query_norm: str) -> Column:
    """Only the exact and substring branches, as one expression; 0 elsewhere."""
    t = normalize(text)
    at = F.instr(t, query_norm)
    inside = F.least(F.lit(0.99), F.lit(0.84) + F.lit(0.12 * len(query_norm)) / F.length(t) + F.when(at == 1, 0.03).otherwise(0.0))
    return F.coalesce(F.when(t == query_norm, 1.0).when(at > 0, inside), F.lit(0.0))


_FIELDS = ["name_zh", "name_en", "category", "description", "official_url"]
_VERDICT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("exact", T.BooleanType()), T.StructField("partial", T.BooleanType())])


def with_norms(records: DataFrame) -> DataFrame:
    """Adds the normalised texts that scores read, once for all terms."""
    none = F.array().cast("array<string>")
    return records.withColumns({f"__{f}": normalize(F.col(f)) for f in _FIELDS} | {"__aliases": F.transform(F.coalesce("aliases", none), normalize)})


def verdict(query_norm: str) -> Column:
    """struct<score, exact, partial> of a record of ``with_norms``: the best weighted field (names and
    aliases 1, English 0.96, description 0.7, category 0.6, URL 0.45), whether a name is the term, and
    whether a name or the description holds it. Equal texts are scored once in a worker's batch."""
    url_too = len(query_norm.encode()) >= 12

    @F.arrow_udf(_VERDICT)
    def judge(zh: pa.Array, en: pa.Array, category: pa.Array, text: pa.Array, url: pa.Array, aliases: pa.Array) -> pa.Array:
        memo: dict[tuple[str, bool], float] = {}

        def one(t: str | None, edit: bool) -> float:
            if not t:
                return 0.0
            if (t, edit) not in memo:
                memo[t, edit] = text_score(query_norm, t, edit)
            return memo[t, edit]

        scores, exact, partial = [], [], []
        for z, e, c, x, u, al in zip(*(k.to_pylist() for k in (zh, en, category, text, url, aliases))):
            names = [n for n in (z, e, *(al or [])) if n]
            best = max([one(z, True), 0.96 * one(e, True), *(one(n, True) for n in al or []), 0.6 * one(c, False), 0.7 * one(x, False), 0.45 * one(u, False) if url_too else 0.0])
            scores.append(min(1.0, best))
            exact.append(query_norm in names)
            partial.append(any(query_norm in n for n in [*names, x or ""]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(exact, pa.bool_()), pa.array(partial, pa.bool_())], names=["score", "exact", "partial"])

    return judge(*[F.col(f"__{f}") for f in _FIELDS], F.col("__aliases"))


def recall(records: DataFrame, terms: list[str]) -> DataFrame:
    """Candidates: all rows if a term is shorter than three letters, else the rows in whose normalised
    texts some term stands; all rows again if there is none."""
    if any(len(t) < 3 for t in terms):
        return records
    text = normalize(F.concat_ws(" ", "name_zh", "name_en", F.concat_ws(" ", "aliases"), "category", "description", "official_url"))
    hits = records.where(reduce(lambda a, b: a | b, [text.contains(t) for t in terms]))
    return records if hits.isEmpty() else hits


def search(records: DataFrame, query: str, kind: str | None = None, category: str | None = None, limit: int = 10, narrow: bool = False) -> DataFrame:
    """(id, ..., score, match, matched_terms), the best first, then popularity, shorter names, ids.

    ``narrow`` first keeps substring candidates. The category is applied after scoring.
    """
    terms = query_terms(query)
    if not terms:
        raise EngineError("bad_args", "the query has no words")
    if not 1 <= limit <= MOST:
        raise EngineError("bad_args", f"limit must be 1..{MOST}")
    df = records.where(F.col("kind") == kind) if kind else records
    if narrow:
        df = recall(df, [n for _, n, _ in terms])
    scored = with_norms(df).withColumns({f"__v{i}": verdict(n) for i, (_, n, _) in enumerate(terms)})
    content = [i for i, t in enumerate(terms) if not t[2]] or list(range(len(terms)))
    s = lambda i: F.col(f"__v{i}")["score"]
    top = F.greatest(*[s(i) for i in content]) if len(content) > 1 else s(content[0])
    hits = sum((s(i) >= HIT).cast("int") for i in content)
    total = top if len(content) == 1 else F.when(hits == 0, top).otherwise(F.greatest(F.lit(HIT), 0.62 * hits / float(len(content)) + 0.38 * top))
    stops = [i for i, t in enumerate(terms) if t[2]]
    if stops and len(content) != len(terms):
        bonus = sum((s(i) >= HIT).cast("int") for i in stops) * (0.02 / len(stops))
        total = F.when(hits > 0, F.least(F.lit(1.0), total + bonus)).otherwise(total)
    ex = reduce(lambda a, b: a | b, [(s(i) >= HIT) & F.col(f"__v{i}")["exact"] for i in content])
    pa_ = reduce(lambda a, b: a | b, [(s(i) >= HIT) & ~F.col(f"__v{i}")["exact"] & F.col(f"__v{i}")["partial"] for i in content])
    fz = reduce(lambda a, b: a | b, [(s(i) >= HIT) & ~F.col(f"__v{i}")["exact"] & ~F.col(f"__v{i}")["partial"] for i in content])
    match = F.when(ex & ~pa_ & ~fz, "exact").when(ex | pa_, "partial").when(fz, "fuzzy").otherwise("none")
    b = F.col("popularity_bucket")
    popular = F.when(b.between(1, 1000), 3).when(b <= 5000, 2).when(b <= 10000, 1).otherwise(0)
    found = scored.withColumns({
        "score": F.round(F.least(F.lit(1.0), total), 3), "match": match,
        "matched_terms": F.filter(F.array(*[F.when(s(i) >= HIT, F.lit(t[0])) for i, t in enumerate(terms)]), lambda x: x.isNotNull()), "__p": popular,
    }).where(F.col("score") >= HIT)
    if category:
        found = found.where(F.col("category") == category)
    return found.orderBy(F.desc("score"), F.desc("__p"), F.length("name_zh").asc_nulls_last(), "id", "rec_no").limit(limit).select(*records.columns, "score", "match", "matched_terms")


def near_misses(records: DataFrame, query: str, top: int = 3) -> DataFrame:
    """(id, name_zh, score) of the closest records below a hit."""
    best = F.greatest(*[verdict(n)["score"] for _, n, _ in query_terms(query)], F.lit(0.0))
    return with_norms(records).withColumn("score", best).where((F.col("score") >= CLOSE) & (F.col("score") < HIT)).orderBy(F.desc("score"), "id", "rec_no").limit(top).select("id", "name_zh", "score")


def categories_of(hits: DataFrame) -> DataFrame:
    return hits.where("category is not null").select("category").distinct().orderBy("category")


def service_link(services: Column, rel: str) -> Column:
    """The URL of the first service of a kind."""
    return F.get(F.filter(services, lambda x: F.lower(x["rel"]) == rel.lower()), 0)["url"]


# ---------------------------------------------------------------- imports and merges

def upsert(base: DataFrame, new: DataFrame, key: str = "id", keep: str | None = None, same: str | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``base`` with their key; the column ``keep`` survives where ``same`` is unchanged."""
    cols = base.columns
    b, n = base.alias("b"), new.alias("n")
    both = b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer")
    there = F.col(f"n.{key}").isNotNull()
    pick = {c: F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")) for c in cols}
    if keep and same:
        unchanged = F.col(f"b.{same}").eqNullSafe(F.col(f"n.{same}"))
        pick[keep] = F.when(there & ~unchanged, F.col(f"n.{keep}")).when(there, F.coalesce(F.col(f"b.{keep}"), F.col(f"n.{keep}"))).otherwise(F.col(f"b.{keep}"))
    return both.select(*[v.alias(c) for c, v in pick.items()])


def replace_source(base: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """All rows of one source out, the new rows in."""
    return base.where(~F.col("source").eqNullSafe(source)).unionByName(new)


#: Own short lists, to be replaced by the caller's: labels of hosts that serve machines, endings that are left out.
BACKEND = ["api", "cdn", "static", "assets", "img", "images", "media", "mail", "smtp", "ns1", "ns2", "gateway", "edge", "cache", "tracking", "analytics"]
LEFT_OUT_ENDINGS = ["xxx", "porn", "adult", "sex"]


def drop_reason(origin: Column, suffixes: list[str] | None = None) -> Column:
    """Why an origin is left out: malformed, ip, suffix, adult, backend; null if it stays."""
    h = host(origin)
    ip = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | h.startswith("[")
    labels = F.split(h, r"\.")
    return (
        F.when(h.isNull(), "malformed").when(ip, "ip").when(registrable(h, suffixes).isNull(), "suffix")
        .when(F.element_at(labels, -1).isin(LEFT_OUT_ENDINGS) | F.exists(labels, lambda x: x.rlike("porn|xxx|sex(cam|chat)")), "adult")
        .when(F.exists(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: x.isin(BACKEND)), "backend")
    )


def fold_origins(origins: DataFrame, deny: DataFrame | None = None, suffixes: list[str] | None = None, alternates: int = 6) -> DataFrame:
    """(domain, bucket, homepage, alt_urls): origins of one registered domain as one row.

    The homepage is the lowest-ranked apex or www origin, https before http, else the lowest-ranked one.
    ``deny`` (suffix) lists endings of hosts that are left out; it is joined on every ending of a host, not
    by comparing all pairs.
    """
    kept = origins.where(drop_reason(F.col("origin"), suffixes).isNull()).select("origin", "rank", host(F.col("origin")).alias("host"))
    kept = kept.withColumn("domain", registrable(F.col("host"), suffixes))
    if deny is not None:
        parts = F.split("host", r"\.")
        ends = kept.select("origin", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"))
        kept = kept.join(ends.join(deny.select("suffix").distinct(), "suffix", "left_semi").select("origin").distinct(), "origin", "left_anti")
    main = (F.col("host") == F.col("domain")) | (F.col("host") == F.concat(F.lit("www."), F.col("domain")))
    order = F.struct((~main).alias("a"), F.col("rank").alias("b"), (~F.col("origin").startswith("https")).alias("c"), F.col("origin").alias("d"))
    rest = F.struct(F.col("rank").alias("r"), F.col("origin").alias("o"))
    best = Window.partitionBy("domain").orderBy("rank", "origin")
    top = kept.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= alternates + 1)  # bounded lists only
    lists = top.groupBy("domain").agg(F.array_sort(F.collect_list(rest)).alias("l"))
    head = kept.groupBy("domain").agg(F.min("rank").alias("bucket"), F.min(order).alias("h"))
    return head.join(lists, "domain").select(
        "domain", "bucket", F.col("h.d").alias("homepage"), F.slice(F.filter(F.transform("l", lambda x: x["o"]), lambda o: o != F.col("h.d")), 1, alternates).alias("alt_urls"))


def reason_counts(origins: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """(reason, origins): how many are left out, and why; 'kept' for the rest."""
    return origins.groupBy(F.coalesce(drop_reason(F.col("origin"), suffixes), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("origins"))


def overlay(rows: DataFrame, curated: DataFrame) -> DataFrame:
    """Names and aliases of ``curated`` (domain, name, aliases) over rows with their domain."""
    c = curated.select("domain", F.col("name").alias("__name"), F.col("aliases").alias("__aliases"))
    return rows.join(c, "domain", "left").withColumns({
        "name": F.coalesce("__name", "name"), "aliases": F.array_distinct(F.concat(F.coalesce("__aliases", F.array().cast("array<string>")), F.coalesce("aliases", F.array().cast("array<string>"))))}).drop("__name", "__aliases")


def fold_same_id(rows: DataFrame, aliases: int = 12, alternates: int = 8) -> DataFrame:
    """One row for each id: smallest bucket, first real names, union of aliases and alternates, scope tw
    before others. Lists are cut to their limits after the distinct values of an id are ranked."""
    first = lambda c: F.min(F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.struct("rec_no", F.col(c).alias("v"))))["v"].alias(c)
    base = rows.groupBy("id").agg(
        F.min(F.when(F.col("popularity_bucket") > 0, F.col("popularity_bucket"))).alias("popularity_bucket"), first("name_zh"), first("name_en"), first("official_url"),
        F.coalesce(F.max(F.when(F.col("popularity_scope") == "tw", "tw")), F.max("popularity_scope")).alias("popularity_scope"))

    def merged(col: str, most: int) -> DataFrame:
        each = rows.select("id", "rec_no", F.posexplode(F.col(col)).alias("p", "x")).where("x is not null and x <> ''").groupBy("id", "x").agg(F.min(F.struct("rec_no", "p")).alias("o"))
        w = Window.partitionBy("id").orderBy("o", "x")
        top = each.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
        return top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda y: y["x"]).alias(col))

    return base.join(merged("aliases", aliases), "id", "left").join(merged("alt_urls", alternates), "id", "left")


def merge_by_domain(base: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` with the domain of a base row give it aliases, alternates and a smaller bucket; the others are added."""
    n = new.select("domain", F.col("aliases").alias("__a"), F.col("alt_urls").alias("__u"), F.col("popularity_bucket").alias("__b"))
    none = F.array().cast("array<string>")
    old = base.join(n, "domain", "left").withColumns({
        "aliases": F.slice(F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("__a", none))), 1, 12), "alt_urls": F.slice(F.array_distinct(F.concat(F.coalesce("alt_urls", none), F.coalesce("__u", none))), 1, 8),
        "popularity_bucket": F.least("popularity_bucket", "__b")}).drop("__a", "__u", "__b")
    return old.unionByName(new.join(base, "domain", "left_anti"), allowMissingColumns=True)


def to_traditional(c: Column, simplified: str, traditional: str) -> Column:
    """Letters of one string for those of the other, place by place."""
    return F.translate(c, simplified, traditional)


def polish_name(c: Column, domain: Column) -> Column:
    """A readable name: entities decoded, blanks collapsed, kana or empty names replaced by the brand of the domain."""
    from ..functions.text import has_kana, strip_tags

    t = strip_tags(c)
    brand = F.initcap(F.regexp_extract(domain, r"^([^.]+)", 1))
    return F.when(F.coalesce(t, F.lit("")).isin("", "null", "Home", "Index") | has_kana(t), brand).otherwise(t)


def classify(text: Column, rules: list[tuple[list[str], str]], other: Column) -> Column:
    """The class of the first rule one of whose words stands in the text."""
    out, t = F, F.lower(text)
    for words, name in rules:
        out = out.when(reduce(lambda a, b: a | b, [t.contains(w.lower()) for w in words]), name)
    return out.otherwise(other)


def check_curated(rows: DataFrame, categories: list[str]) -> DataFrame:
    """(id, error) of records that may not be imported: no id, repeated id, unknown category, address without https."""
    n = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    tests = F.array(
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id"), F.when(F.col("n") > 1, "repeated id"), F.when(~F.coalesce(F.col("category").isin(categories), F.lit(False)), "unknown category"),
        F.when(~F.coalesce(F.col("official_url").startswith("https://"), F.lit(False)), "no https address"))
    return rows.join(n, "id", "left").select("id", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("error"))


def fresh(rows: DataFrame, now: Column, days: float, at: str = "fetched_at") -> DataFrame:
    """Rows younger than ``days``."""
    return rows.where(F.col(at).try_cast("timestamp") > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0)))
