"""Problem 9: the language of documents and of the stretches of one language inside them.

Bayesian evidence fusion. The text evidence is a naive Bayes model over hashed character n-grams of
words (and characters of Han and kana), fitted on a bounded sample of labelled rows and refitted on
its own decisions, so wrong labels wash out. The other evidence is the declared label (with the rate
at which labels agreed with the text in the sample) and a prior for each host, smoothed towards its
address suffix and that towards the whole corpus; the counts come from grouped aggregation over all
rows. For each document a hidden-state pass over its sentences joins both: the prior starts the
chain and weighs each change of language. A segment is a longest run of sentences of one language;
sentences without words go with the text before them (at the start, with the text after).

Null, empty and blank texts and texts without words have no segments. Hosts may be null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, skew_join, spread, stable_hash

LANGS = ["en", "zh", "ja", "de", "fr", "es", "pt"]
#: The names of the languages in labels, by language.
NAMES = {
    "en": ["en", "eng", "english", "englisch", "anglais", "inglés", "inglês", "英文", "英語"],
    "zh": ["zh", "zho", "chi", "cmn", "chinese", "mandarin", "chinesisch", "chinois", "chino", "chinês", "中文"],
    "ja": ["ja", "jpn", "jp", "japanese", "japanisch", "japonais", "japonés", "japonês", "日文", "日本語"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "alemão", "德文"],
    "fr": ["fr", "fra", "fre", "french", "französisch", "français", "francés", "francês", "法文"],
    "es": ["es", "spa", "spanish", "castilian", "spanisch", "espagnol", "español", "espanhol", "西班牙文"],
    "pt": ["pt", "por", "portuguese", "portugiesisch", "portugais", "portugués", "português", "葡萄牙文"],
}
#: Labelled rows that the text model is fitted on at most.
SAMPLE_ROWS = 3000
#: Buckets of the hashed n-grams; the model is BUCKETS x languages floats (7 MB), whatever the corpus.
BUCKETS = 1 << 18
#: How much a change of language between two sentences costs, in nats, beside the prior of the new one.
CHANGE_COST = 9.0
#: N-grams of a word overlap; their evidence is scaled down by this.
TEMPER = 0.35
#: Further share that counts for a confidence: the value at which the confidences of pieces of two to five words agree best with how often
#: they are right (figures in the README). It moves no decision.
CALIBRATION = 0.43
#: Rows (of host priors) that are broadcast at most; about 100 bytes each.
BROADCAST_HOSTS = 50_000
#: Pseudo-counts of the next level in the prior of a host and of a suffix.
SMOOTHING = 20.0

_SENTENCE = regex.compile(r"[^\n\r]*?(?:[.!?…]+[\"')\]»”’]*(?=\s|[぀-鿿])|[。！？]+[」』）”’\"]*)\s*|[^\n\r]*[\n\r]+|[^\n\r]+$")
_TOKEN = regex.compile(r"[\p{Han}々〆]+|[\p{Hiragana}\p{Katakana}ー]+|[\p{L}\p{M}'’]+")
#: Addresses have no words of a language.
_ADDRESS = regex.compile(r"\S*(?:://|www\.|@)\S*")
_ROW = regex.compile(r"\s*\|(?:[^\n]*\d|[\s|:-]*$)")
_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々〆]")


def label_language(c: Column) -> Column:
    """The language a label names, in any notation; another language's own text; null if it names none."""
    s = F.lower(F.trim(c))
    head = F.regexp_extract(s, r"^([^-_ ]+)", 1)
    out = F
    for lang, names in NAMES.items():
        out = out.when(head.isin(names), lang)
    return out.when(head.isin("", "xx", "und", "unknown", "mul", "zxx", "none", "null", "n/a", "na", "?", "other"), None).when(head.rlike("^[a-z]{2,}$"), head)


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS


def features(token: str) -> list[int]:
    """Hashed n-grams of one token: 1-2 for Han and kana, 1-4 with word edges for other letters."""
    if _HAN.match(token):
        return [_bucket(g) for g in token] + [_bucket(token[i : i + 2]) for i in range(len(token) - 1)]
    w = f" {token.lower()} "
    return [_bucket(w[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)] + [_bucket("w" + w)] * 2


def sentences(text: str) -> list[str]:
    """The text cut after each sentence and line; joining the parts gives the text."""
    return _SENTENCE.findall(text)


def _tokens(sentence: str) -> list[str]:
    if "www." in sentence or "://" in sentence or "@" in sentence:
        sentence = _ADDRESS.sub(" ", sentence)
    return _TOKEN.findall(sentence)


class TextModel:
    """Log-likelihoods of tokens in each language. A word, or a pair of Han or kana, is a row of a table that
    grows as they are met; a document is one gather of rows and one sum by sentence."""

    def __init__(self, weights: np.ndarray, agreement: float):
        self.weights, self.agreement = weights, agreement
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGS)))

    def _add(self, key: str, buckets: list[int]) -> int:
        at = len(self.index)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.weights[buckets].sum(axis=0) * TEMPER
        self.index[key] = at
        return at

    def sentence(self, s: str) -> list[int] | None:
        """Rows of a sentence. None without words: lone letters, units, and rows of figures of a pipe table say nothing."""
        if s.lstrip().startswith("|") and _ROW.match(s):
            return None
        tokens = _tokens(s)
        if not any(len(t) > 2 or (len(t) > 1 and _HAN.match(t)) for t in tokens):
            return None
        out, get = [], self.index.get
        for t in tokens:
            if _HAN.match(t):
                for i in range(len(t)):
                    key = t[i : i + 2]
                    r = get(key)
                    out.append(r if r is not None else self._add(key, [_bucket(key[0]), _bucket(key)] if len(key) > 1 else [_bucket(key)]))
            else:
                r = get(t)
                out.append(r if r is not None else self._add(t, features(t)))
        return out

    def segments(self, text: str, log_prior: np.ndarray) -> list[tuple[str, float, int, int, bool]]:
        """(lang, confidence, start, end, has words) for each longest run of sentences in one language."""
        if len(self.index) > 400_000:
            self.index.clear()
        parts = sentences(text)
        found = [self.sentence(p) for p in parts]
        worded = [i for i, r in enumerate(found) if r is not None]
        if not worded:
            return []
        flat: list[int] = []
        starts = []
        for i in worded:
            starts.append(len(flat))
            flat += found[i]
        lattice = np.add.reduceat(self.rows[flat], starts, axis=0)
        n, k = lattice.shape
        best = lattice.argmax(axis=1)
        first = int(best[0])
        if (best == first).all() and int((lattice.sum(axis=0) + log_prior).argmax()) == first:
            path = [first] * n  # no path with a change can be better
        else:
            best, back = log_prior + lattice[0], np.zeros((n, k), dtype=int)
            for i in range(1, n):
                j = int(best.argmax())
                change = best[j] - CHANGE_COST + log_prior
                back[i] = np.where(best >= change, np.arange(k), j)
                best = np.maximum(best, change) + lattice[i]
            path = [int(best.argmax())]
            for i in range(n - 1, 0, -1):
                path.append(int(back[i][path[-1]]))
            path.reverse()
        out, bounds = [], []
        offset = [0]
        for p in parts:
            offset.append(offset[-1] + len(p))
        for i, state in enumerate(path):
            if not bounds or bounds[-1][0] != state:
                bounds.append([state, i, i])
            bounds[-1][2] = i
        for b, (state, first, last) in enumerate(bounds):
            start = 0 if b == 0 else offset[worded[first]]
            end = len(text) if b == len(bounds) - 1 else offset[worded[bounds[b + 1][1]]]
            z = lattice[first : last + 1].sum(axis=0) * CALIBRATION + log_prior
            z = np.exp(z - z.max())
            out.append((LANGS[state], float(z[state] / z.sum()), start, end, True))
        return out


def fit(labelled: list[tuple[str, str | None]], rounds: int = 4) -> TextModel:
    """The model of (text, declared language) pairs. Sentences start with the label of their text and
    then take the language that the model of the round before gives them, so that mixed and wrongly
    labelled texts end in the right classes."""
    grams_of: dict[str, list[int]] = {}
    flat: list[int] = []
    starts, declared = [], []
    for text, lang in labelled:
        for s in sentences(text or ""):
            begin = len(flat)
            for t in _tokens(s):
                got = grams_of.get(t)
                if got is None:
                    got = grams_of[t] = features(t)
                flat += got
            if len(flat) > begin:
                starts.append(begin)
                declared.append(LANGS.index(lang) if lang in LANGS else -1)
    k, n = len(LANGS), len(starts)
    grams, edges = np.array(flat, dtype=np.int32), np.array([*starts, len(flat)])
    sizes = np.diff(edges)
    known = np.array(declared, dtype=int)
    now = known.copy()
    weights = np.zeros((BUCKETS, k), dtype=np.float32)
    for _ in range(rounds):
        owner = np.repeat(now, sizes)
        counts = np.array([np.bincount(grams[owner == lang], minlength=BUCKETS) for lang in range(k)], dtype=np.float64)
        total = counts.sum(axis=1, keepdims=True)
        seen = counts.sum(axis=0) > 0
        p = (counts + 0.02) / (total + 0.02 * max(1, seen.sum()))
        weights = np.log(p).T.astype(np.float32)
        # unseen n-grams say nothing; classes without any example are never chosen
        weights[~seen] = 0
        weights[:, total[:, 0] == 0] = -20
        for at in range(0, n, 1024):  # sentences in blocks, so that memory stays small
            lo, hi = edges[at], edges[min(n, at + 1024)]
            now[at : at + 1024] = np.add.reduceat(weights[grams[lo:hi]], edges[at : min(n, at + 1024)] - lo, axis=0).argmax(axis=1)
    told = known >= 0
    agreement = float(np.clip((now[told] == known[told]).mean() if told.any() else 0.5, 0.5, 0.99))
    return TextModel(weights, agreement)


def suffix(site: Column) -> Column:
    """The last label of a host name."""
    return F.element_at(F.split(F.coalesce(site, F.lit("")), r"\."), -1)


def host_priors(docs: DataFrame, site: str = "site", lang: str = "lang") -> DataFrame:
    """(site, prior array<double>) from the declared labels: host -> suffix -> all, each with
    ``SMOOTHING`` pseudo-counts of the level above. Only (site, lang) is read; counts are combined
    before they are shuffled."""
    base = docs.select(F.coalesce(F.col(site), F.lit("")).alias("site"), label_language(F.col(lang)).alias("__l"))
    each = base.groupBy("site").agg(*[F.sum((F.col("__l") == x).cast("long")).alias(x) for x in LANGS]).na.fill(0)
    each = each.withColumn("__suffix", suffix(F.col("site")))
    count = lambda p: [F.sum(x).alias(p + x) for x in LANGS]
    by_suffix = each.groupBy("__suffix").agg(*count("s_"))
    overall = each.agg(*count("a_"))
    both = each.join(by_suffix, "__suffix").crossJoin(F.broadcast(overall))  # one row
    add = lambda p: sum((F.col(p + x) for x in LANGS[1:]), F.col(p + LANGS[0]))
    a = {x: (F.col("a_" + x) + 1.0) / (add("a_") + float(len(LANGS))) for x in LANGS}
    s = {x: (F.col("s_" + x) + SMOOTHING * a[x]) / (add("s_") + SMOOTHING) for x in LANGS}
    h = [(F.col(x) + SMOOTHING * s[x]) / (add("") + SMOOTHING) for x in LANGS]
    return both.select("site", F.array(*h).alias("prior"))


def fit_on(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> TextModel:
    """The text model of at most ``rows`` rows with a known label, the ones with the smallest hash."""
    label, order = label_language(F.col(lang)), stable_hash(F.col(id_col), seed=9)
    known = docs.where(label.isin(LANGS))
    # the bound is found on ids alone; only the texts below it are read
    most = known.select(order.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if most is None:
        return fit([])
    picked = known.where((order <= most) & F.col(text).isNotNull()).select(order.alias("h"), F.col(id_col).alias("i"), label.alias("l"), F.col(text).alias("t"))
    return fit([(r.t, r.l) for r in picked.orderBy("h", "i").limit(rows).collect()])


def segments(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", site: str = "site", model: TextModel | None = None) -> DataFrame:
    """(id, seg_no, lang, confidence, start, length, label, n_langs): the segments of each document.

    ``start`` and ``length`` are in characters; ``label`` is the language that the declared label
    names (null: none), ``n_langs`` the number of different languages of the document.
    """
    spark = docs.sparkSession
    model = model or fit_on(docs, id_col, text, lang)
    shared = spark.sparkContext.broadcast((model.weights, model.agreement))  # fixed size
    priors = cut(host_priors(docs, site, lang))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(site), F.lit("")).alias("site"), label_language(F.col(lang)).alias("label"), F.col(text).alias("text"))
    joined = slim.join(F.broadcast(priors), "site") if priors.count() <= BROADCAST_HOSTS else skew_join(slim, priors, "site")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, seg_no int, lang string, confidence double, start int, length int, label string, n_langs int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = TextModel(*shared.value)
        r = m.agreement
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            ids, labels, texts, prior = (b.column(b.schema.get_field_index(x)) for x in ("id", "label", "text", "prior"))
            for key, label, t, p in zip(ids.to_pylist(), labels.to_pylist(), texts.to_pylist(), prior.to_pylist()):
                if not t:
                    continue
                fused = np.log(np.array(p))
                if label in LANGS:
                    evidence = np.full(len(LANGS), np.log((1 - r) / (len(LANGS) - 1)))
                    evidence[LANGS.index(label)] = np.log(r)
                    fused = fused + evidence
                fused = fused - np.log(np.exp(fused - fused.max()).sum()) - fused.max()
                found = m.segments(t, fused)
                n = len({f[0] for f in found})
                for k, (language, conf, start, end, _) in enumerate(found, 1):
                    for c, v in zip(cols, (key, k, language, round(conf, 6), start, end - start, label, n)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], b.schema.field("id").type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()),
                 pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.string()), pa.array(cols[7], pa.int32())],
                names=["id", "seg_no", "lang", "confidence", "start", "length", "label", "n_langs"])

    return spread(joined.select("id", "label", "text", "prior")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def mislabelled(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, seg_no, lang) of the documents whose label is missing or wrong or that mix languages."""
    return found.where((F.col("n_langs") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))).select(id_col, "seg_no", "lang")
