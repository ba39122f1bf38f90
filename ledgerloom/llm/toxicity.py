"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: its words, their first letters (four and
five, which stand for inflected forms), pairs of neighbours and pairs with one
word between.  The model learns online with a rate per coordinate and L1
shrinkage, so most weights are zero and the rest are broadcast as two short
arrays.  Words are runs of letters, digits and ``_``, in lower case.

The model is fitted to a bounded sample of labelled rows: ``per_class`` of each
class, one text of each id, none longer than ``max_bytes``.  Every document is
scored on its whole text, however long.

Null and empty texts have no features and get the score of the intercept alone.
Repeated rows are scored row by row.  Of several labels for one id the highest
counts.  Ids may have any type and may be null; an empty table gives no rows, no
labels a score of a half; columns other than those named don't reach the result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"\w+")
#: Entries of a worker's word table, beyond which it starts afresh.
TABLE_WORDS = 300_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class Features:
    """Texts to hashed feature places; remembers the hashes of words."""

    def __init__(self, bits: int = 22):
        self.shift = np.uint64(64 - bits)
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.hashes = np.empty((1024, 3), np.uint64)

    def _add(self, word: str) -> int:
        i = self.ids[word] = len(self.ids)
        if i == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
        self.hashes[i] = (xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest("4" + word[:4]), xxhash.xxh64_intdigest("5" + word[:5]))
        return i

    def places(self, text: str | None) -> np.ndarray:
        """Places of all features, repeats included."""
        words = WORDS.findall(text.lower()) if text else []
        if not words:
            return np.empty(0, np.int64)
        if len(self.ids) > TABLE_WORDS:
            self.clear()
        get, add = self.ids.get, self._add
        rows = np.fromiter((add(w) if (i := get(w)) is None else i for w in words), np.int64, len(words))
        h = self.hashes[rows]
        w = h[:, 0]
        with np.errstate(over="ignore"):
            pairs = w[:-1] * _ODD[0] + w[1:] * _ODD[1]
            skips = w[:-2] * _ODD[2] + w[2:] * _ODD[3]
            every = np.concatenate([h.ravel(), pairs, skips]) * _ODD[0]
        return (every >> self.shift).astype(np.int64)


@dataclass
class Model:
    bits: int
    bias: float
    at: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.at] = self.weight
        return out


def fit_ftrl(texts: list[str | None], labels: list[int], *, bits: int = 22, alpha: float = 1.0, beta: float = 1.0, l1: float = 15.0, l2: float = 1.0, epochs: int = 8, min_texts: int = 3, max_weight: float = 10.0) -> Model:
    """FTRL-proximal over the rows in the given order, ``epochs`` times."""
    make = Features(bits)
    rows = [np.unique(make.places(t)) for t in texts]
    # Features enter the model once they are seen in some texts; the others can only be learnt by heart.
    seen = np.bincount(np.concatenate([np.empty(0, np.int64), *rows]), minlength=1 << bits)
    rows = [np.append(at[seen[at] >= min_texts], 1 << bits) for at in rows]
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    shrink = np.full((1 << bits) + 1, l1)
    shrink[-1] = 0.0  # the intercept

    def weights(at: np.ndarray) -> np.ndarray:
        za = z[at]
        excess = np.maximum(np.abs(za) - shrink[at], 0.0)
        return -np.sign(za) * excess / ((beta + np.sqrt(n[at])) / alpha + l2)

    rare = min(max_weight, max(1.0, (len(labels) - sum(labels)) / max(1, sum(labels))))  # of a row of the rarer label
    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (rare if y else 1.0)
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(root**2 + g * g) - root) / alpha * w
            n[at] += g * g
    at = np.flatnonzero(np.abs(z[:-1]) > l1)
    return Model(bits, float(weights(np.array([1 << bits]))[0]), at, weights(at).astype(np.float32))


def score(text: str | None, make: Features, dense: np.ndarray, bias: float) -> float:
    at = make.places(text)
    at = np.unique(at[dense[at] != 0])
    return float(1 / (1 + np.exp(-np.clip(bias + float(dense[at].sum()), -35, 35))))


def fold(id_col: Column) -> Column:
    """Which of three parts a row is in."""
    return F.crc32(id_col.cast("string")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, max_bytes: int, held_out: int = 1) -> list[tuple[str | None, int]]:
    """At most ``per_class`` labelled texts of each class, chosen by hash, none from the held-out part.

    ``docs``: ``doc_id, text``; ``labels``: ``doc_id, y``.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id")) != held_out))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    picked = known.filter("y = 0").orderBy(order, "doc_id").limit(per_class).unionByName(known.filter("y = 1").orderBy(order, "doc_id").limit(per_class))
    # At most 2 * per_class ids are broadcast and as many texts of bounded length come back, one of each id.
    found = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes).join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("h", order)
    rows = found.toPandas().sort_values("h", kind="stable")
    return list(zip(rows["text"], rows["y"].astype(int), strict=True))


_WORKER: dict[str, tuple[Features, np.ndarray]] = {}


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000, max_bytes: int = 200_000, threshold: float = 0.7, **fit: float) -> DataFrame:
    """One row per document: ``held_out``, ``score`` from 0 to 1, ``predicted``.

    ``per_class`` and ``max_bytes`` bound the labelled rows that the model is fitted to.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = training_rows(docs, labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")), per_class, max_bytes)
    model = fit_ftrl([t for t, _ in rows], [y for _, y in rows], **fit)
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((model.bits, model.bias, model.at, model.weight))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Features(sent.value[0]), Model(*sent.value).dense()
        make, dense = _WORKER[key]
        for texts in batches:
            yield pd.Series([score(t, make, dense, sent.value[1]) for t in texts], dtype="float64")

    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), scores("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
