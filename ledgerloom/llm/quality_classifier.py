"""Quality scores by co-training two separate views of a document.

The content view reads the text alone: the mean weight of its hashed words,
their shapes and pairs of shapes, and what its characters and lines are like.  The metadata view never sees the text: it
knows language, source and the order of magnitude of the stated length.  Each
view learns from labelled rows.  Then, round after round, both score all
unlabelled documents in a Spark pass, those that a bettered view has seen before
too, and what a view is sure of is taught to the other: ``each`` new rows of each
class at most, drawn by hash from all that are sure.  Both views are calibrated on labelled rows kept apart; a document's score
multiplies their odds (each against the classes' own), so a view that knows
nothing changes nothing.

Only the rows that a fit reads are bounded samples (``per_class`` labelled rows
and ``each`` taught ones of each class); one row of each id is chosen before it
is collected, as counts of hashed features, whose size is bounded whatever the
text's length.  Where all documents have labels, those not learnt from take part
as unlabelled ones.  Every document is scored on its whole text.

Null and empty texts are scored as empty; nulls in metadata and values not met
in the fit add nothing.  Repeated rows agree, ids may have any type and may be
null, an empty table gives no rows, without labels every score is a half, and
columns other than those named don't reach the result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import stored
from ledgerloom.llm.toxicity import fold

BITS, HASHED = 15, 256
RUNS = (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+"))
TABLE_WORDS = 300_000

LAYOUT = 12

#: Places and counts of a text's hashed features, and its layout.
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Kinds(dict):
    """Code points to the letter of their kind; what is neither letter nor digit stays."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = self[code] = next((mark for run, mark in zip(RUNS, "Xx9", strict=True) if run.fullmatch(c)), c)
        return out


_KIND_OF, _SAME = _Kinds(), re.compile(r"([Xx9])\1+")


def shape(token: str) -> str:
    """A token's runs of capitals, other letters and digits, and its other characters."""
    return _SAME.sub(r"\1", token.translate(_KIND_OF))


class Tokens(dict):
    """Texts to places of the content view's features; remembers those of words, as rows of ``own`` and ``shapes``."""

    def __init__(self) -> None:
        super().__init__()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.own, self.shapes, self.new, self.kinds, self.weights = np.empty(1024, np.int32), np.empty(1024, np.int32), [], {}, None

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        kinds = token.translate(_KIND_OF)
        place = self.kinds.get(kinds)
        if place is None:
            place = self.kinds[kinds] = xxhash.xxh32_intdigest("shape " + _SAME.sub(r"\1", kinds)) >> (32 - BITS)
        self.new.append((xxhash.xxh32_intdigest(token.lower()) >> (32 - BITS), place))
        return n

    def rows(self, words: list[str]) -> np.ndarray:
        """The words' rows; the table starts afresh where it has grown too large."""
        if len(self) > TABLE_WORDS:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if self.new:
            if len(self) > len(self.own):
                self.own, self.shapes = (np.concatenate([x, np.empty(len(self), np.int32)]) for x in (self.own, self.shapes))
            at = slice(len(self) - len(self.new), len(self))
            self.own[at], self.shapes[at] = zip(*self.new, strict=True)
            self.new = []
        return rows

    @staticmethod
    def pairs(shapes: np.ndarray) -> np.ndarray:
        return (shapes[:-1] * 31 + shapes[1:] * 17 + 7) & ((1 << BITS) - 1)

    def places(self, words: list[str]) -> np.ndarray:
        """Places of the features, repeats included."""
        if not words:
            return np.zeros(1, np.int64)
        rows = self.rows(words)
        shapes = self.shapes[rows]
        return np.concatenate([self.own[rows], shapes, self.pairs(shapes)]).astype(np.int64)

    def mean(self, words: list[str], w: np.ndarray) -> float:
        """Mean of weights over the features, without listing them: a word's own and its shape's are added up once a word."""
        if not words:
            return float(w[0])
        rows = self.rows(words)
        if self.weights is None or self.weights[0] is not w:
            self.weights = w, np.empty(0)
        have = self.weights[1]
        if len(have) < len(self):
            more = slice(len(have), max(len(self), 2 * len(have)))
            have = np.concatenate([have, np.zeros(more.stop - more.start)])
            self.weights = w, have
            self.known = more.start
        if self.known < len(self):
            new = slice(self.known, len(self))
            have[new] = w[self.own[new]] + w[self.shapes[new]]
            self.known = len(self)
        return float(have[rows].sum() + w[self.pairs(self.shapes[rows])].sum()) / (3 * len(words) - 1)


_KINDS = np.zeros((256, 9))  # of bytes: line feeds, capitals, digits, marks, bars, calls, signs, spaces, all
for _k, _bytes in enumerate(((10,), range(65, 91), range(48, 58), (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)), (124,), (33,), (35, 36, 37, 38, 42), (32,), range(256))):
    _KINDS[list(_bytes), _k] = 1


def layout(text: str | None, words: list[str]) -> np.ndarray:
    """Shares of kinds of characters, of lines and of repeated words."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    feeds, capitals, digits, marks, bars, calls, signs, spaces, n = np.bincount(raw, minlength=256) @ _KINDS
    n, lines = max(1.0, n), feeds + 1
    return np.array((
        np.log1p(len(words)) / 5, np.log1p(lines) / 3, np.log1p(len(words) / lines) / 4, capitals / n * 3, digits / n * 5, marks / n * 3,
        bars / n * 20, calls / n * 20, signs / n * 10, spaces / n * 3, len(set(words)) / max(1, len(words)), len(words) < 20,
    ), np.float64)


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Content:
    """Logistic regression on mean feature weights and the layout."""

    def __init__(self) -> None:
        self.w, self.v, self.b = np.zeros(1 << BITS), np.zeros(LAYOUT), 0.0

    def logits(self, rows: list[Counts]) -> np.ndarray:
        return np.array([float(self.w[at] @ n) / n.sum() + float(self.v @ x) for at, n, x in rows]) + self.b

    def fit(self, rows: list[Counts], y: np.ndarray, weight: np.ndarray, steps: int = 120, rate: float = 0.5, l2: float = 1e-6) -> None:
        doc = np.repeat(np.arange(len(rows)), [len(at) for at, *_ in rows])
        at, dense = np.concatenate([at for at, *_ in rows]), np.array([x for *_, x in rows])
        part = np.concatenate([n / n.sum() for _, n, _ in rows])
        size = len(self.w)
        m, v = np.zeros(size + LAYOUT), np.zeros(size + LAYOUT)
        for k in range(1, steps + 1):
            g = (_p(np.bincount(doc, self.w[at] * part, len(rows)) + dense @ self.v + self.b) - y) * weight
            grad = np.concatenate([np.bincount(at, g[doc] * part, size) + l2 * self.w, g @ dense + l2 * self.v])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-7)
            self.w -= step[:size]
            self.v -= step[size:]
            self.b -= g.sum()


#: What the metadata view knows of a document.
Meta = tuple[str | None, str | None, int | None]


class Metadata:
    """Logistic regression on hashed language, source and magnitude of length, by Newton steps."""

    def __init__(self) -> None:
        self.w = np.zeros(HASHED + 1)
        self.seen: dict[Meta, float] = {}

    @staticmethod
    def row(meta: Meta) -> np.ndarray:
        out = np.zeros(HASHED + 1)
        out[-1] = 1.0
        for kind, value in zip(("lang", "source", "length"), meta, strict=True):
            if value is not None:
                out[xxhash.xxh32_intdigest(f"{kind} {value}") % HASHED] += 1.0
        return out

    def logits(self, rows: list[Meta]) -> np.ndarray:
        if len(self.seen) > TABLE_WORDS:
            self.seen.clear()
        for r in set(rows) - self.seen.keys():
            self.seen[r] = float(self.row(r) @ self.w)
        return np.array([self.seen[r] for r in rows])

    def fit(self, rows: list[Meta], y: np.ndarray, weight: np.ndarray, steps: int = 12, l2: float = 3.0) -> None:
        x = np.array([self.row(r) for r in rows])
        for _ in range(steps):
            p = _p(x @ self.w)
            h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + l2 * np.eye(x.shape[1])
            self.w -= np.linalg.solve(h, x.T @ ((p - y) * weight) + l2 * self.w)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale (0 or more) and offset that make logits probabilities."""
    a, b = 1.0, 0.0
    for _ in range(300):
        p = _p(a * z + b)
        a = max(0.0, a - 0.5 * float(((p - y) * z).mean() + 1e-3 * a) / max(1.0, float((z**2).mean())))
        b -= 0.5 * float((p - y).mean())
    return a, b


def _balanced(y: np.ndarray) -> np.ndarray:
    return np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))


class Taught:
    """Rows that a view learns from: those labelled and those that the other view was sure of."""

    def __init__(self, rows: list, y: np.ndarray):
        self.rows, self.y = list(rows), list(y)

    def add(self, rows: list, label: int) -> None:
        self.rows += rows
        self.y += [label] * len(rows)

    def fitted(self, view: Content | Metadata) -> Content | Metadata:
        y = np.array(self.y, float)
        if len(y):
            view.fit(self.rows, y, _balanced(y) * (len(y) if isinstance(view, Metadata) else 1))
        return view


def _meta(docs: DataFrame, lang_col: str, source_col: str, length_col: str | None) -> list[Column]:
    """Language, source and magnitude of the length, as columns of their own names."""
    length = F.floor(2 * F.log1p(F.greatest(F.col(length_col), F.lit(0)).cast("double"))) if length_col else F.lit(None)
    return [F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), length.cast("long").alias("length")]


def _metas(d: pd.DataFrame) -> list[Meta]:
    whole = lambda s: [None if pd.isna(x) else x for x in s]
    return list(zip(whole(d["lang"]), whole(d["source"]), [None if pd.isna(x) else int(x) for x in d["length"]], strict=True))


def counted(text: Column) -> Column:
    """Places and counts of a text's features."""

    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for batch in texts:
            words = [t.split() if t else [] for t in batch]
            found = [np.unique(tokens.places(w), return_counts=True) for w in words]
            yield pd.DataFrame({"places": [a.astype(np.int32) for a, _ in found], "counts": [n.astype(np.int32) for _, n in found], "layout": [layout(t, w) for t, w in zip(batch, words, strict=True)]})

    return F.pandas_udf(of, "places array<int>, counts array<int>, layout array<double>")(text)


def _collected(rows: DataFrame, picked: DataFrame) -> pd.DataFrame:
    """The picked ids (a bounded number) with one row's metadata and feature counts each."""
    found = rows.join(F.broadcast(picked), "doc_id")
    kept = [c for c in found.columns if c != "doc_id"]
    one = found.groupBy("doc_id").agg(F.min_by(F.struct(*kept), F.xxhash64("text", "lang", "source", "length")).alias("r")).select("doc_id", "r.*")
    out = one.select("doc_id", "lang", "source", "length", *[c for c in kept if c == "y"], counted(F.col("text")).alias("f")).withColumn("h", F.xxhash64("doc_id", F.lit(9))).toPandas()
    return out.sort_values("h", kind="stable")


def _ids(rows: DataFrame, ids: list) -> DataFrame:
    """Ids as a table, in their own type."""
    return rows.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]))


def _counts(d: pd.DataFrame) -> list[Counts]:
    return [(np.asarray(f["places"], np.int64), np.asarray(f["counts"], np.float64), np.asarray(f["layout"], np.float64)) for f in d["f"]]


_WORKER: dict[str, Tokens] = {}


def _scorer(docs: DataFrame, views: tuple[Content, Metadata]) -> object:
    """A function of text, lang, source and length to both views' logits."""
    content, meta = views
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((content.w.astype(np.float32), content.v, content.b, meta.w))

    @F.pandas_udf("content double, meta double")
    def logits(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        w, v, b, known = sent.value
        other = Metadata()
        other.w = known
        if key not in _WORKER:
            tokens = next(iter(_WORKER.values()), None) or Tokens()
            _WORKER.clear()
            _WORKER[key] = tokens
        tokens = _WORKER[key]
        for texts, langs, sources, lengths in batches:
            rows = _metas(pd.DataFrame({"lang": langs, "source": sources, "length": lengths}))
            made = []
            for t in texts:
                words = t.split() if t else []
                made.append(tokens.mean(words, w) + float(v @ layout(t, words)))
            yield pd.DataFrame({"content": np.array(made) + b, "meta": other.logits(rows)})

    return logits


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", length_col: str | None = "n_chars", label_col: str = "quality",
    per_class: int = 1000, rounds: int = 2, each: int = 300, sure: float = 0.97, threshold: float = 0.5,
) -> DataFrame:
    """One row per document: ``held_out``, the two views' scores, ``score`` and ``kept``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *_meta(docs, lang_col, source_col, length_col))
    order = F.xxhash64(F.col("doc_id"), F.lit(9))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    usable = known.filter(fold(F.col("doc_id")) != 1)
    picked = stored(usable.filter("y = 1").orderBy(order, "doc_id").limit(per_class).unionByName(usable.filter("y = 0").orderBy(order, "doc_id").limit(per_class)))
    learnt = _collected(rows, picked)
    y, apart = learnt["y"].to_numpy(float), np.arange(len(learnt)) % 4 == 3
    counts, metas = _counts(learnt), _metas(learnt)
    some = lambda x, where: [v for v, w in zip(x, where, strict=True) if w]
    contents, metadata = Taught(some(counts, ~apart), y[~apart]), Taught(some(metas, ~apart), y[~apart])
    views = contents.fitted(Content()), metadata.fitted(Metadata())
    free = rows.filter("doc_id is not null").join(F.broadcast(picked.select("doc_id")), "doc_id", "left_anti")
    given: dict[str, list] = {"content": [], "meta": []}
    for _ in range(rounds if len(learnt) else 0):
        scored = stored(free.select("doc_id", "lang", "source", "length", _scorer(docs, views)("text", "lang", "source", "length").alias("z")).select("*", "z.*", order.alias("h")).drop("z"))
        limit = float(np.log(sure / (1 - sure)))
        for label, sign in ((1, 1.0), (0, -1.0)):
            # Bounded draws from all rows that a view is sure of; what was taught before (at most as many a round) isn't taught again.
            sure_of = lambda view: scored.filter(sign * F.col(view) >= limit).join(F.broadcast(_ids(rows, given[view])), "doc_id", "left_anti").orderBy("h", "doc_id").limit(each)  # noqa: B023, E731
            told = sure_of("content").select("doc_id", "lang", "source", "length").toPandas()
            metadata.add(_metas(told), label)
            given["content"] += told["doc_id"].drop_duplicates().tolist()
            told = _collected(rows, sure_of("meta").select("doc_id").distinct())
            contents.add(_counts(told), label)
            given["meta"] += told["doc_id"].tolist()
        views = contents.fitted(Content()), metadata.fitted(Metadata())
    content, meta = views
    fits = (_platt(content.logits(some(counts, apart)), y[apart]), _platt(meta.logits(some(metas, apart)), y[apart])) if apart.any() else ((1.0, 0.0), (1.0, 0.0))
    share = min(max(float(y[apart].mean()), 1e-3), 1 - 1e-3) if apart.any() else 0.5
    prior = float(np.log(share / (1 - share)))
    (a, b), (c, d) = fits
    odds = lambda x: 1 / (1 + F.exp(-x))
    out = rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), _scorer(docs, views)("text", "lang", "source", "length").alias("z"))
    x, y_ = a * F.col("z.content") + b, c * F.col("z.meta") + d
    out = out.select("doc_id", "held_out", odds(x).alias("content_score"), odds(y_).alias("page_score"), odds(x + y_ - prior).alias("score"))
    return out.withColumn("kept", F.col("score") >= threshold)
