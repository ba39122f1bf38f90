"""Language identification with error-correcting output codes.

Every language has a codeword of signs; a binary classifier per place of the code
predicts that sign of a text from its hashed character n-grams.  Up to seven
languages use the exhaustive code (all ways to part them in two), more use the
random code with the largest smallest distance of many drawn.  Decoding weighs
the loss of each place by how well its classifier did for the language on rows
kept apart, takes the codeword with the smallest loss, and calls a text ambiguous
if the second is about as near.

Features of a text are the n-grams of one to four characters of its words (runs of
letters and what counts as a digit but isn't one), lower-cased, with a mark at
both ends; their mean weight is a classifier's logit.  A worker keeps the sums of
words it has met, so a text costs a lookup a word.

The classifiers are fitted to a bounded sample: ``per_lang`` documents of each
language, fewer if that made more than ``max_rows``, of the ``max_langs`` languages
with most documents; one text of each id, as counts of hashed n-grams of the whole
text and of some short runs of its words.  Every document is predicted on its
whole text.

Null texts and texts without a letter are ``und`` with score 0, as is everything
where no labelled document has a letter.  With one language all others are that
one.  Repeated rows agree, ids may have any type and may be null (never learnt
from), very long texts are read once, an empty table gives no rows, columns that
are not named don't reach the result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W\d_]+")
LETTER = r"\p{L}"
BITS, LONGEST = 16, 4
#: Entries of a worker's word table, beyond which it starts afresh.
TABLE_WORDS = 200_000
#: Characters of a text that are looked up at a time.
SLICE = 500_000
#: Runs of so many words are learnt beside the whole text.
SNIPPETS = (1, 2, 4, 8)
_MARK = 10
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of some words, and the index of each one's word."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    mark = codes == _MARK
    word = np.cumsum(mark) - 1
    places, of = [], []
    rolled = np.zeros(len(codes), np.uint64)
    inner = np.zeros(len(codes), bool)  # whether a mark is inside the n-gram, its ends left out
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            rolled = (rolled[:m] + codes[n - 1 :]) * _FACTORS[n - 1]
            rolled ^= rolled >> np.uint64(29)
            if n > 2:
                inner = inner[:m] | mark[n - 2 : n - 2 + m]
            good = np.flatnonzero(~mark if n == 1 else ~(inner[:m] | (mark[:m] & mark[n - 1 :]) if n == 2 else inner[:m]))
            places.append((rolled[good] * _FACTORS[0] >> np.uint64(64 - BITS)).astype(np.int64))
            of.append(word[good])
    return np.concatenate(places), np.concatenate(of)


def codewords(k: int, tries: int = 200, seed: int = 11) -> np.ndarray:
    """Signs of ``k`` languages, one row each; every column has both signs."""
    if k < 2:
        return np.zeros((k, 0))
    if k <= 7:
        columns = np.arange(1 << (k - 1), dtype=np.int64)[1:]
        return np.vstack([np.ones(len(columns)), *[np.where(columns >> i & 1, -1.0, 1.0) for i in range(k - 1)]])
    draw, best, far = np.random.default_rng(seed), None, -1
    length = math.ceil(10 * math.log2(k))
    for _ in range(tries):
        code = draw.choice([-1.0, 1.0], (k, length))
        if (np.abs(code.sum(0)) == k).any():
            continue
        agree = code @ code.T
        np.fill_diagonal(agree, -length)
        apart = int((length - agree.max()) // 2)
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class Coder:
    """Languages, their codewords, the classifiers' weights, and how to decode."""

    langs: list[str]
    code: np.ndarray
    weight: np.ndarray  # places by bits
    bias: np.ndarray
    trust: np.ndarray  # languages by bits
    sharp: float = 1.0

    def decoded(self, logits: np.ndarray) -> np.ndarray:
        """Probabilities of the languages, a row a text."""
        if not self.code.shape[1]:
            return np.ones((len(logits), len(self.langs)))
        loss = np.logaddexp(0.0, -logits[:, None, :] * self.code[None]) * self.trust[None]
        z = -self.sharp * loss.sum(2)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _logits(rows: tuple[np.ndarray, np.ndarray, np.ndarray], weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    at, part, starts = rows
    # A place of the code at a time, so that what is held at once is one number a feature.
    return np.stack([np.add.reduceat(weight[at, j] * part, starts) for j in range(weight.shape[1])], axis=1) + bias


def _packed(examples: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(a) for a, _ in examples])
    return np.concatenate([a for a, _ in examples]), np.concatenate([n / n.sum() for _, n in examples]), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def fit(examples: list[tuple[np.ndarray, np.ndarray]], langs: list[str], doc: np.ndarray, *, steps: int = 40, rate: float = 0.5, l2: float = 1e-7) -> Coder:
    """Classifiers of all code places at once; a quarter of the documents is kept apart for decoding."""
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs])
    code = codewords(len(names))
    bits = code.shape[1]
    coder = Coder(names, code, np.zeros((1 << BITS, bits)), np.zeros(bits), np.full(code.shape, 1.0 / max(1, bits)))
    if not bits:
        return coder
    apart = doc % 4 == 3
    if len(set(y[~apart])) < len(names) or not apart.any():
        apart = np.zeros(len(y), bool)
    taught = [e for e, a in zip(examples, apart, strict=True) if not a]
    at, part, starts = _packed(taught)
    row = np.repeat(np.arange(len(taught)), np.diff(np.append(starts, len(at))))
    of = y[~apart]
    share = (1.0 / np.bincount(of, minlength=len(names)))[of] / len(names)
    seen, where = np.unique(at, return_inverse=True)
    w, b = np.zeros((len(seen), bits)), np.zeros(bits)
    m, v, target = np.zeros_like(w), np.zeros_like(w), (code[of] + 1) / 2
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(_logits((where, part, starts), w, b), -30, 30)))
        g = (p - target) * share[:, None]
        grad = np.stack([np.bincount(where, part * g[row, j], len(seen)) for j in range(bits)], axis=1) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-7)
        b -= g.sum(0)
    coder.weight[seen], coder.bias = w, b
    held = _packed([e for e, a in zip(examples, apart, strict=True) if a]) if apart.any() else (at, part, starts)
    truth = y[apart] if apart.any() else of
    logits = _logits(held, coder.weight, coder.bias)
    right = (logits * code[truth] > 0).astype(float)
    tally = np.bincount(truth, minlength=len(names)).astype(float)
    good = np.stack([np.bincount(truth, right[:, j], len(names)) for j in range(bits)], axis=1)
    trust = (good + 1) / (tally + 2)[:, None]
    coder.trust = trust / trust.sum(1, keepdims=True)

    def unlikely(sharp: float) -> float:
        coder.sharp = sharp
        p = coder.decoded(logits)[np.arange(len(truth)), truth]
        return float(-np.log(np.maximum(p, 1e-9)) @ (1.0 / tally[truth]))

    coder.sharp = min((float(s) for s in np.geomspace(0.5, 32, 13)), key=unlikely)
    return coder


def sliced(text: str) -> Iterator[str]:
    """A text in parts that end at spaces."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + SLICE) if at + SLICE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class Sums(dict):
    """Words to rows of a table with the sums of their n-grams' weights and how many they are."""

    def __init__(self, weight: np.ndarray):
        super().__init__()
        self.weight, self.table, self.filled = weight, np.zeros((1024, weight.shape[1] + 1)), 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n

    def logits(self, text: str) -> np.ndarray | None:
        found = np.zeros(self.table.shape[1])
        for part in sliced(text):
            words = WORDS.findall(part.lower())
            if len(self) > TABLE_WORDS:
                self.clear()
                self.table, self.filled = np.zeros((1024, self.table.shape[1])), 0
            at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            if len(self) > self.filled:
                self._fill()
            found += self.table[at].sum(0)
        return found[:-1] / found[-1] if found[-1] else None

    def _fill(self) -> None:
        new = [w for _, w in zip(range(len(self) - self.filled), reversed(self), strict=False)][::-1]
        new = [w if any(map(str.isalpha, w)) else "" for w in new]
        if len(self) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((len(self), self.table.shape[1]))])
        places, of = grams(new) if any(new) else (np.empty(0, np.int64), np.empty(0, np.int64))
        rows = np.zeros((len(new), self.table.shape[1]))
        for j in range(self.weight.shape[1]):
            rows[:, j] = np.bincount(of, self.weight[places, j], len(new))
        rows[:, -1] = np.bincount(of, minlength=len(new))
        self.table[self.filled : len(self)] = rows
        self.filled = len(self)


def fold(id_col: Column) -> Column:
    """Which of four parts a row is in."""
    return F.crc32(id_col.cast("string")) % 4


def examples_of(text: Column) -> Column:
    """Places and counts of the n-grams of a text and of some short runs of its words."""

    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            made = []
            for text in batch:
                words = [w for w in WORDS.findall((text or "").lower()) if any(map(str.isalpha, w))]
                draw = np.random.default_rng(len(words))
                runs = [words, *[words[i : i + n] for n in SNIPPETS if len(words) > n for i in [int(draw.integers(len(words) - n))]]]
                found = [np.unique(grams(r)[0], return_counts=True) for r in runs if r]
                made.append([{"places": a.astype(np.int32), "counts": n.astype(np.int32)} for a, n in found])
            yield pd.Series(made)

    return F.pandas_udf(of, "array<struct<places:array<int>,counts:array<int>>>")(text)


def learnt(rows: DataFrame, held_out: int, per_lang: int, max_rows: int, max_langs: int) -> Coder | None:
    """A coder fitted to a bounded sample of ``rows``: ``doc_id, text, lang``."""
    usable = rows.filter((fold(F.col("doc_id")) != held_out) & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not counts:
        return None
    each, order = max(1, min(per_lang, max_rows // len(counts))), F.xxhash64("doc_id", F.lit(12))
    # A share of each language by hash that holds about twice the sample, so that ranks are over few rows.
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 30, 2 * each * (1 << 30) // n + 1))])
    ranked = usable.select("doc_id", "lang", order.alias("h")).filter(F.pmod("h", F.lit(1 << 30)) < F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0)))
    picked = ranked.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("rank") <= each).select("doc_id", "lang")
    found = usable.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = found.select("lang", order.alias("h"), F.col("doc_id").cast("string").alias("id"), examples_of(F.col("text")).alias("examples")).toPandas().sort_values(["h", "id", "lang"], kind="stable")
    examples, names, doc = [], [], []
    for i, (lang, several) in enumerate(zip(found["lang"], found["examples"], strict=True)):
        for e in several:
            examples.append((np.asarray(e["places"], np.int64), np.asarray(e["counts"], float)))
            names.append(lang)
            doc.append(i)
    return fit(examples, names, np.array(doc))


_WORKER: dict[str, tuple[Sums, Coder]] = {}


def languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, per_lang: int = 400, max_rows: int = 4000, max_langs: int = 500, ratio: float = 2.0) -> DataFrame:
    """One row per document: ``held_out, lang_pred, score, runner_up, ambiguous``.

    ``ambiguous`` if the nearest codeword is less than ``ratio`` times as likely as the second.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    coder = learnt(rows, held_out, per_lang, max_rows, max_langs)
    held = F.coalesce(fold(F.col("doc_id")) == held_out, F.lit(False)).alias("held_out")
    if coder is None:
        return rows.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("runner_up"), F.lit(False).alias("ambiguous"))
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((coder.langs, coder.code, coder.weight.astype(np.float32), coder.bias, coder.trust, coder.sharp))

    @F.pandas_udf("lang_pred string, score double, runner_up string, ambiguous boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _WORKER:
            _WORKER.clear()
            ready = Coder(*sent.value)
            _WORKER[key] = Sums(ready.weight), ready
        sums, ready = _WORKER[key]
        for texts in batches:
            logits = [sums.logits(t) if t else None for t in texts]
            known = np.array([z is not None for z in logits], bool)
            out = pd.DataFrame({"lang_pred": ["und"] * len(logits), "score": 0.0, "runner_up": None, "ambiguous": False})
            if known.any():
                p = ready.decoded(np.array([z for z in logits if z is not None]) + ready.bias)
                order = np.argsort(-p, axis=1, kind="stable")
                first, names = order[:, 0], np.array(ready.langs, object)
                best = p[np.arange(len(p)), first]
                out.loc[known, "lang_pred"], out.loc[known, "score"] = names[first], best
                if p.shape[1] > 1:
                    out.loc[known, "runner_up"] = names[order[:, 1]]
                    out.loc[known, "ambiguous"] = best < ratio * p[np.arange(len(p)), order[:, 1]]
            yield out

    return rows.select("doc_id", held, predicted("text").alias("p")).select("doc_id", "held_out", "p.*")
