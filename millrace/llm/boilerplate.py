"""Problem 1: which lines of a page are not part of its main body.

A recurrent block labeller in numpy: every non-blank line is a block with a tag-path vector (heading,
list, table, fence, links and where they lead, neighbours, length) and hashed words; a bidirectional
LSTM reads the blocks of a whole page, so each is labelled with the page's context on both sides. The
network is fitted by ``fit`` on a bounded sample of pages labelled with ``chrome_labels`` (see
``python -m millrace.llm.boilerplate PAGES``) and kept beside this module.

Null and empty bodies have no lines; blank lines are counted and never listed. Very long pages are
read whole; a page is never split.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Hash buckets of words, size of a word vector, size of each LSTM state.
WORDS, WIDE, HIDDEN = 8192, 16, 24
#: Pages that the network is fitted on at most.
SAMPLE_PAGES = 4000
#: A block is furniture from this probability.
LIMIT = 0.5
WEIGHTS = Path(__file__).with_name("boilerplate_weights.npz")

_LINK = regex.compile(r"\[([^\]\n]*)\]\(([^)\s]*)\)")
_TOKEN = regex.compile(r"\p{Han}+|[\p{Hiragana}\p{Katakana}ー]+|\p{L}[\p{L}\p{M}'’]*|\d+|[^\s\p{L}\p{N}]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_NAME = regex.compile(r"\p{Lu}\p{Ll}+$")
_TAG_NAMES = 46
_ORIGIN, _DIGITS, _DIGIT = re.compile(r"^[a-z]+://[^/]*"), re.compile(r"[0-9]+"), re.compile(r"\d")
_MONEY = regex.compile(r"\p{Sc}|\d ?[A-Z]{3}\b|\b[A-Z]{3} ?\d|元|円")


_HASHES: dict[str, int] = {}
_TOKENS: dict[str, tuple[list[int], bool]] = {}


def _word(w: str) -> int:
    h = _HASHES.get(w)
    if h is None:
        h = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS
        if len(_HASHES) < 400_000:
            _HASHES[w] = h
    return h


def _token(t: str) -> tuple[list[int], bool]:
    """Hashed words of one token, and whether it looks like a name."""
    if t[0] >= "\u2e80" and _CJK.match(t):
        return [_word(t[j : j + 2]) for j in range(max(1, len(t) - 1))], False
    if t[0].isdigit():
        return [_word("0" if len(t) < 4 else "0000")], False
    if len(t) > 1 or t.isalpha():
        return [_word(t.lower())], bool(_NAME.match(t))
    return [_word(t)], False


def words_of(text: str) -> list[int]:
    """Hashed words of a block: Latin words (also without case), pairs of Han and kana, runs of digits as one word, marks."""
    out: list[int] = []
    name = _word("^name")
    for i, t in enumerate(_TOKEN.findall(text)):
        got = _TOKENS.get(t)
        if got is None:
            got = _token(t)
            if len(t) < 12 and len(_TOKENS) < 400_000:
                _TOKENS[t] = got
        out += got[0]
        if i and got[1]:
            out.append(name)
    edge = text.strip()
    return out + [_word("^" + edge[:4].lower()), _word("$" + edge[-4:].lower()), _word("$" + edge[-2:].lower())]


def tags_of(line: str) -> tuple[np.ndarray, list[int]]:
    """The part of the tag-path vector that the block itself gives, and its hashed words."""
    s = line.strip()
    v = np.zeros(_TAG_NAMES, dtype=np.float32)
    heading = len(s) - len(s.lstrip("#"))
    bullet = s[:2] in ("- ", "* ", "• ")
    v[min(heading, 4)] = 1
    v[5] = s.startswith("**") and s.endswith("**")
    v[6], v[7] = s.startswith("- "), s.startswith("* ")
    v[8] = s.startswith("|")
    v[9] = s.startswith((">", "`"))
    links = _LINK.findall(s) if "](" in s else []
    bare = (_LINK.sub("", s) if links else s).strip(" -*•|·,/")
    v[10] = len(links) == 1
    v[11] = len(links) > 1
    v[12] = bool(links) and not bare
    v[13] = bool(links) and bare[:1] in (":", "：")
    if links:
        shape = _DIGITS.sub("0", _ORIGIN.sub("", links[0][1]))[:6]
        v[14 + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % 8] = 1
    n = len(bare) + sum(len(a) for a, _ in links)
    wide = n * (2 if _CJK.search(s) else 1)
    v[22 + min(6, int(np.log2(1 + wide / 6)))] = 1
    v[29] = s[-1:] in ".。!?！？"
    v[30] = s[-1:] in ":：…"
    v[31] = bool(_DIGIT.search(s))
    v[32] = bool(_MONEY.search(s))
    parts = max(s.count(" | "), s.count(" · "), s.count("｜"), s.count("  "))
    v[33], v[34] = parts == 1, parts > 1
    v[35] = " > " in s or " » " in s or " / " in s
    v[36] = "©" in s
    v[37] = s.isupper()
    v[38] = bullet and not links
    return v, words_of(bare if not links else " ".join(a for a, _ in links) + " " + bare)


class Reader:
    """Blocks of pages; what lines give by themselves is remembered, as site furniture repeats."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[np.ndarray, list[int]]] = {}

    def line(self, text: str) -> tuple[np.ndarray, list[int]]:
        got = self.memo.get(text)
        if got is None:
            got = tags_of(text)
            if len(text) < 200:
                if len(self.memo) > 100_000:
                    self.memo.clear()
                self.memo[text] = got
        return got

    def page(self, body: str) -> tuple[list[int], np.ndarray, list[list[int]]]:
        """(line numbers from 1, tag-path vectors, hashed words) of the blocks of a body."""
        numbers, tags, words = [], [], []
        gap, fence = True, False
        for i, text in enumerate(body.split("\n"), 1):
            s = text.strip()
            if not s:
                gap = True
                if tags:
                    tags[-1][40] = 1
                continue
            own, hashed = self.line(s)
            v = own.copy()
            v[39] = gap
            if s.startswith(("```", "~~~")):
                fence = not fence
                v[41] = 1
            v[42] = fence
            numbers.append(i)
            tags.append(v)
            words.append(hashed)
            gap = False
        n = len(tags)
        if n:
            tags[0][43] = tags[-1][44] = 1
            for i, v in enumerate(tags):
                v[45] = i / n
        return numbers, np.array(tags, dtype=np.float32).reshape(n, _TAG_NAMES), words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Bidirectional LSTM over blocks with a logistic label for each."""

    def __init__(self, p: dict[str, np.ndarray] | None = None, seed: int = 1):
        if p is None:
            r = np.random.default_rng(seed)
            d, h = WIDE + _TAG_NAMES, HIDDEN
            p = {"E": r.normal(0, 0.3, (WORDS, WIDE)), "u": r.normal(0, 0.2, 2 * h + d), "c": np.zeros(1)}
            for k in "fb":
                p["W" + k] = r.normal(0, 1 / np.sqrt(d), (d, 4 * h))
                p["U" + k] = r.normal(0, 1 / np.sqrt(h), (h, 4 * h))
                p["b" + k] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> Network:
        with np.load(path) as z:
            return cls({k: z[k] for k in z.files})

    def save(self, path: Path = WEIGHTS) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    def inputs(self, pages: list[tuple[np.ndarray, list[list[int]]]]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Padded inputs (time, page, feature), mask, and what the gradient of the word vectors needs."""
        t, n = max(len(x) for x, _ in pages), len(pages)
        x = np.zeros((t, n, WIDE + _TAG_NAMES), dtype=np.float32)
        mask = np.zeros((t, n), dtype=np.float32)
        flat, rows, cols, counts = [], [], [], []
        for j, (tags, words) in enumerate(pages):
            k = len(tags)
            x[:k, j, WIDE:] = tags
            mask[:k, j] = 1
            for i, w in enumerate(words):
                flat += w
                counts.append(len(w))
                rows.append(i)
                cols.append(j)
        counts_a = np.array(counts)
        starts = np.concatenate([[0], np.cumsum(counts_a)[:-1]])
        flat_a = np.array(flat)
        x[rows, cols, :WIDE] = np.add.reduceat(self.p["E"][flat_a], starts, axis=0) / counts_a[:, None] ** 0.75
        return x, mask, (flat_a, np.repeat(np.array(rows), counts_a), np.repeat(np.array(cols), counts_a), np.repeat(counts_a, counts_a) ** 0.75)

    def direction(self, x: np.ndarray, mask: np.ndarray, k: str, keep: bool = False):
        t, n, _ = x.shape
        h = HIDDEN
        W, U, b = self.p["W" + k], self.p["U" + k], self.p["b" + k]
        pre = x @ W + b
        out = np.zeros((t, n, h), dtype=np.float32)
        hs, cs = np.zeros((n, h), dtype=np.float32), np.zeros((n, h), dtype=np.float32)
        steps = range(t) if k == "f" else range(t - 1, -1, -1)
        tape = []
        for s in steps:
            z = pre[s] + hs @ U
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            m = mask[s][:, None]
            c = f * cs + i * g
            tc = np.tanh(c)
            new = o * tc
            if keep:
                tape.append((s, hs, cs, i, f, o, g, tc, m))
            hs, cs = m * new + (1 - m) * hs, m * c + (1 - m) * cs
            out[s] = hs
        return (out, tape) if keep else out

    def scores(self, pages: list[tuple[np.ndarray, list[list[int]]]]) -> list[np.ndarray]:
        """Probability of furniture for each block of each page."""
        x, mask, _ = self.inputs(pages)
        both = np.concatenate([self.direction(x, mask, "f"), self.direction(x, mask, "b"), x], axis=2)
        p = _sigmoid(both @ self.p["u"] + self.p["c"])
        return [p[: len(tags), j] for j, (tags, _) in enumerate(pages)]

    def gradients(self, pages, truth: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        p, h = self.p, HIDDEN
        x, mask, (flat, rows, cols, share) = self.inputs(pages)
        t, n, _ = x.shape
        y = np.zeros((t, n), dtype=np.float32)
        for j, v in enumerate(truth):
            y[: len(v), j] = v
        (hf, tf), (hb, tb) = self.direction(x, mask, "f", True), self.direction(x, mask, "b", True)
        both = np.concatenate([hf, hb, x], axis=2)
        q = _sigmoid(both @ p["u"] + p["c"])
        total = mask.sum()
        loss = float(-(mask * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).sum() / total)
        d = mask * (q - y) / total
        grad = {"u": np.tensordot(d, both, ([0, 1], [0, 1])), "c": np.array([d.sum()])}
        back = d[:, :, None] * p["u"]
        dx = back[:, :, 2 * h :].copy()
        for k, tape, dout in (("f", tf, back[:, :, :h]), ("b", tb, back[:, :, h : 2 * h])):
            W, U = p["W" + k], p["U" + k]
            dh, dc = np.zeros((n, h), dtype=np.float32), np.zeros((n, h), dtype=np.float32)
            dz_all, dU = np.zeros((t, n, 4 * h), dtype=np.float32), np.zeros_like(U)
            for s, hp, cp, i, f, o, g, tc, m in reversed(tape):
                dh = dh + dout[s]
                new, keep_h = dh * m, dh * (1 - m)
                dcell = dc * m + new * o * (1 - tc * tc)
                dz = np.concatenate([dcell * g * i * (1 - i), dcell * cp * f * (1 - f), new * tc * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
                dz_all[s] = dz
                dU += hp.T @ dz
                dh = dz @ U.T + keep_h
                dc = dcell * f + dc * (1 - m)
            grad["W" + k] = np.tensordot(x, dz_all, ([0, 1], [0, 1]))
            grad["U" + k] = dU
            grad["b" + k] = dz_all.sum(axis=(0, 1))
            dx += dz_all @ W.T
        gE = np.zeros_like(p["E"])
        np.add.at(gE, flat, dx[rows, cols, :WIDE] / share[:, None])
        grad["E"] = gE
        return loss, grad


def _fewer(words: list[int], r: np.random.Generator) -> list[int]:
    """A fifth of the words of a block left out at random, so that no single word, such as a name, decides."""
    kept = [w for w, x in zip(words, r.random(len(words))) if x > 0.2]
    return kept or words


_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
_TARGET = regex.compile(r"(\]\([^)\s]*\))")


def reworded(line: str, seed: int) -> str:
    """The line with other letters in the place of its words, the same for the same word; marks, figures and targets of links stay."""

    def other(m) -> str:
        r = np.random.default_rng([seed, zlib.crc32(m[0].lower().encode("utf-8", "surrogatepass"))])
        picks = r.integers(0, 1 << 30, len(m[0]))
        made = [chr(0x4E00 + p % 0x2000) if "一" <= c <= "鿿" else chr(0x3042 + p % 80) if "぀" <= c <= "ヿ" else chr(97 + p % 26) for c, p in zip(m[0], picks.tolist())]
        return "".join(x.upper() if c.isupper() else x for c, x in zip(m[0], made))

    return "".join(x if i % 2 else _LETTERS.sub(other, x) for i, x in enumerate(_TARGET.split(line)))


def _views(body: str, at: int) -> list[tuple[str, list[bool | None]]]:
    """A page as it is; every third also without its furniture, or its lower half alone, as pages come stripped or cut; every third also
    in words that no list has: all its lines, or only one kind, so that layout and context must tell."""
    from .chrome_labels import labels

    lines = body.split("\n")
    marks = labels(lines)
    out = [(body, marks)]
    if at % 3 == 0:
        kept = [(x, m) for x, m in zip(lines, marks) if not m] if at % 2 else list(zip(lines, marks))[len(lines) // 2 :]
        out.append(("\n".join(x for x, _ in kept), [m for _, m in kept]))
    if at % 3 == 1:
        which = ((True, False), (True,), (True, False), (False,))[at // 3 % 4]
        out.append(("\n".join(reworded(x, at) if m in which else x for x, m in zip(lines, marks)), marks))
    return out


def fit(bodies: list[str], rounds: int = 9, batch: int = 32, rate: float = 0.006, seed: int = 1, tell=None) -> Network:
    """A network fitted on pages labelled with ``chrome_labels``; the same bodies give the same network."""
    reader, net, r = Reader(), Network(seed=seed), np.random.default_rng(seed)
    data = []
    for at, body in enumerate(bodies[:SAMPLE_PAGES]):
        views = _views(body or "", at)
        for text, marks in views:
            numbers, tags, words = reader.page(text)
            if not numbers:
                continue
            data.append(((tags, words), np.array([bool(marks[i - 1]) for i in numbers], dtype=np.float32)))
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for turn in range(rounds):
        order = sorted(r.permutation(len(data)), key=lambda i: len(data[i][1]) // 8)
        chunks = [order[i : i + batch] for i in range(0, len(order), batch)]
        r.shuffle(chunks)
        losses = []
        for chunk in chunks:
            pages = [(data[i][0][0], [_fewer(w, r) for w in data[i][0][1]]) for i in chunk]
            loss, grad = net.gradients(pages, [data[i][1] for i in chunk])
            step += 1
            lr = rate * (1 - 0.9 * step / (rounds * len(chunks)))
            for k, g in grad.items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            losses.append(loss)
        if tell:
            tell(turn, float(np.mean(losses)))
    return net


_LOADED: list[tuple[Network, Reader]] = []


def _tools() -> tuple[Network, Reader]:
    if not _LOADED:
        _LOADED.append((Network.load(), Reader()))
    return _LOADED[0]


def furniture(bodies: list[str | None], net: Network | None = None, reader: Reader | None = None, batch: int = 64) -> list[tuple[list[int], np.ndarray]]:
    """(line numbers, probabilities) of the blocks of each body."""
    if net is None or reader is None:
        net, reader = _tools()
    out: list[tuple[list[int], np.ndarray]] = [([], np.zeros(0))] * len(bodies)
    pages = [(i, *reader.page(b)) for i, b in enumerate(bodies) if b]
    pages = sorted((x for x in pages if x[1]), key=lambda x: len(x[1]))
    k = 0
    while k < len(pages):
        # a batch holds pages of like length, fewer of them the longer they are
        room = max(1, min(batch, 16_384 // max(1, len(pages[min(k + batch, len(pages)) - 1][1]))))
        chunk = pages[k : k + room]
        for (i, numbers, _, _), p in zip(chunk, net.scores([(t, w) for _, _, t, w in chunk])):
            out[i] = (numbers, p)
        k += room
    return out


def furniture_lines(pages: DataFrame, id_col: str = "doc_id", body: str = "body", limit: float = LIMIT) -> DataFrame:
    """(id, line_no): the lines that are not part of the main body; nothing is shuffled."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                keys, lines = [], []
                for key, (numbers, p) in zip(part.column(0).to_pylist(), furniture(part.column(1).to_pylist())):
                    hit = [n for n, x in zip(numbers, p) if x >= limit]
                    lines += hit
                    keys += [key] * len(hit)
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(lines, pa.int32())], names=[id_col, "line_no"])

    return spread(pages.select(id_col, body)).mapInArrow(run, f"{id_col} {kind}, line_no int")


def main_body(body: Column | str, limit: float = LIMIT) -> Column:
    """The text of the main body: furniture lines removed, blank lines collapsed; null for null."""

    @F.arrow_udf("string")
    def keep(bodies: pa.Array) -> pa.Array:
        texts, out = bodies.to_pylist(), []
        for text, (numbers, p) in zip(texts, furniture(texts)):
            if text is None:
                out.append(None)
                continue
            drop = {n for n, x in zip(numbers, p) if x >= limit}
            kept = "\n".join(line for i, line in enumerate(text.split("\n"), 1) if i not in drop)
            out.append(regex.sub(r"\n{3,}", "\n\n", kept).strip("\n"))
        return pa.array(out, pa.string())

    return keep(F.col(body) if isinstance(body, str) else body)


if __name__ == "__main__":
    import pyarrow.dataset as ds

    every = [b for f in sys.argv[1:] for b in ds.dataset(f).to_table(columns=["body"])["body"].to_pylist() if b]
    every.sort(key=lambda b: zlib.crc32(b.encode("utf-8", "surrogatepass")))
    fit(every[:SAMPLE_PAGES], tell=lambda turn, loss: print(f"round {turn + 1}: loss {loss:.5f}", flush=True)).save()
