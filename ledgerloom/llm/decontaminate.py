"""Benchmark decontamination: a BM25 index of test items, searched by every training passage.

Test items are cut into entries of up to 80 words and indexed: each term has
its entries with their BM25 impacts, divided by the entry's own full score, cut
into blocks of eight entries, and the maximum of each block.  Passages are
windows of 160 words that start every 80, so each entry that a text contains
lies whole in one.  A passage asks for all entries that reach the threshold, as
block-max WAND does, many passages at a time:

* its terms are put in order of their maxima; up to a pivot, where these add up
  to half the threshold, lists stay closed, since an entry that reaches the
  threshold must have the other half from the terms beyond the pivot;
* the blocks in the lists beyond the pivot are bounded by their maxima and the
  closed lists' own, then, if they pass, by the block maxima of all lists;
* only in the blocks that still reach the threshold postings are opened.

What is retrieved is verified word by word: five-word shingles of the item's
question (its first three quarters, or what ends at its last question mark) and
of its answer (the rest) must be in the passage.  Items of fewer than five
words match where their whole word sequence occurs.  In scripts that put no
space between words each character is a word.

The index holds numpy arrays of at most 24 bytes a word.  It is broadcast only
up to ``max_index_chars`` of test texts; larger benchmarks are searched in
parts of that size, one after the other, with statistics of the whole benchmark
(document frequencies, entries, mean length), so results don't depend on it.

Null and empty texts and items match nothing; very long texts are searched
whole, passage by passage.  Repeated documents and repeated items give a row
each.  Ids may have any type.  Empty tables give no rows; extra columns are left
out by ``leaked`` and pass through ``clean`` whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored

_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
WORDS = re.compile(r"\w+")
UNSPACED = re.compile(f"[{_UNSPACED}]")
UNSPACED_WORDS = re.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])\w)+")
ENTRY_WORDS, BLOCK, SHINGLE = 80, 8, 5
K1, B = 1.2, 0.75
#: Expanded (passage, term, block) triples held at a time.
AT_ONCE = 2_000_000


def words_in(text: str | None) -> list[str]:
    """Words of a text in lower case."""
    if not text:
        return []
    text = text.lower()
    return UNSPACED_WORDS.findall(text) if not text.isascii() and UNSPACED.search(text) else WORDS.findall(text)


def entries_of(text: str | None) -> list[tuple[list[str], int]]:
    """Words of each entry of an item, and where the answer starts in it."""
    words = words_in(text)
    asked = len(words_in(text[: text.rindex("?")])) if text and "?" in text else 0
    parts = max(1, -(-len(words) // ENTRY_WORDS))
    out = []
    for k in range(parts):
        a, b = len(words) * k // parts, len(words) * (k + 1) // parts
        if b > a:
            out.append((words[a:b], asked - a if a + SHINGLE <= asked <= b - SHINGLE else (b - a) * 3 // 4))
    return out


def _shingles(words: list[int]) -> set[tuple[int, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``starts`` and have ``counts`` places."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


class _Ids(dict):
    def __missing__(self, _: str) -> int:
        return -1


class Index:
    """BM25 postings in blocks with their maxima, over the entries of test items.

    ``stats`` gives the number of entries, their mean length and the document
    frequencies of the words, where the items are part of a larger benchmark.
    """

    def __init__(self, items: list[tuple[object, str | None]], stats: tuple[int, float, dict[str, int]] | None = None):
        self.items = [item for item, _ in items]
        ids: dict[str, int] = {}
        owner, split, tokens, lengths, terms, entry_of, times = [], [], [], [], [], [], []
        for row, (_, text) in enumerate(items):
            for words, at in entries_of(text):
                here = [ids.setdefault(w, len(ids)) for w in words]
                t, f = np.unique(here, return_counts=True)
                terms.append(t)
                times.append(f)
                entry_of.append(np.full(len(t), len(owner)))
                owner.append(row)
                split.append(at)
                lengths.append(len(here))
                tokens += here
        self.vocabulary = list(ids)
        self.owner, self.split = np.array(owner, np.int64), np.array(split, np.int64)
        self.tokens, self.ends = np.array(tokens, np.int32), np.cumsum(lengths, dtype=np.int64)
        term, entry, f = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (terms, entry_of, times))
        size = len(ids)
        if stats is None:
            n, mean, df = len(owner), len(tokens) / max(1, len(owner)), np.bincount(term, minlength=size)
        else:
            n, mean, known = stats
            df = np.array([known[w] for w in self.vocabulary], np.int64)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        long = np.array(lengths, np.float64)[entry] if len(entry) else np.empty(0)
        impact = idf[term] * f * (K1 + 1) / (f + K1 * (1 - B + B * long / mean)) if len(entry) else np.empty(0)
        share = impact / np.bincount(entry, impact, len(owner))[entry] if len(entry) else impact
        order = np.lexsort((entry, term))
        term, self.entry, self.share = term[order], entry[order].astype(np.int32), share[order].astype(np.float32)
        self.n_blocks = -(-len(owner) // BLOCK)
        # Blocks of each term's list, in order: their key, their first posting, their maximum.
        key = term * max(1, self.n_blocks) + self.entry // BLOCK
        self.key, self.first = np.unique(key, return_index=True)
        self.high = np.maximum.reduceat(self.share, self.first) if len(key) else np.empty(0, np.float32)
        self.first = np.append(self.first, len(key))
        # Each term's blocks and its maximum.
        self.at = np.searchsorted(self.key, np.arange(size + 1) * max(1, self.n_blocks))
        self.most = np.maximum.reduceat(self.high, self.at[:-1]).astype(np.float64) if size else np.empty(0)
        self.ids: _Ids | None = None

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def ready(self) -> Index:
        """With the vocabulary as a table, which isn't sent."""
        if self.ids is None:
            self.ids = _Ids((w, i) for i, w in enumerate(self.vocabulary))
        return self

    def retrieve(self, texts: list[list[int]], threshold: float) -> list[tuple[int, int, int, float]]:
        """(text, first word of the passage, entry, score) of all passages of texts of term ids (-1: unknown)."""
        if not self.n_blocks:
            return []
        lengths = np.array([len(w) for w in texts])
        terms = np.fromiter((i for words in texts for i in words), np.int64, int(lengths.sum()))
        n_segments = np.maximum(1, -(-lengths // ENTRY_WORDS))
        first = np.cumsum(n_segments) - n_segments
        of_text = np.repeat(np.arange(len(texts)), lengths)
        within = np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        segment = first[of_text] + within // ENTRY_WORDS
        known = terms >= 0
        size = len(self.most)
        pairs = np.unique(segment[known] * size + terms[known])
        # A passage is a segment and the next one of its text.
        starts = np.zeros(int(n_segments.sum()) + 1, bool)
        starts[first] = True
        before = pairs[~starts[pairs // size]] - size
        pairs = np.unique(np.concatenate([pairs, before]))
        passage, term = pairs // size, pairs % size
        total = np.bincount(passage, self.most[term], int(n_segments.sum()))
        live = total[passage] >= threshold
        passage, term = passage[live], term[live]
        # By passage, lists in order of their maxima: closed up to the pivot.
        order = np.lexsort((self.most[term], passage))
        passage, term = passage[order], term[order]
        sums = np.cumsum(self.most[term])
        new = np.flatnonzero(np.diff(passage, prepend=-1))
        sums -= np.repeat(np.append(0.0, sums[new[1:] - 1]) if len(new) else sums[:0], np.diff(np.append(new, len(passage))))
        opened = sums > threshold / 2
        closed = np.bincount(passage[~opened], self.most[term[~opened]], len(total))
        return [
            (i, int(w - first[i]) * ENTRY_WORDS, int(e), float(s))
            for a, b in self._slices(passage, np.where(opened, self.at[term + 1] - self.at[term], 0))
            for w, e, s in self._scored(passage[a:b], term[a:b], opened[a:b], closed, threshold)
            for i in (int(np.searchsorted(first, w, "right")) - 1,)
        ]

    @staticmethod
    def _slices(passage: np.ndarray, cost: np.ndarray) -> list[tuple[int, int]]:
        """Whole passages whose costs are about ``AT_ONCE`` together."""
        part = np.cumsum(cost) // AT_ONCE
        cuts = [0]
        for c in np.flatnonzero(np.diff(part)).tolist():
            c = int(np.searchsorted(passage, passage[c], "right"))  # to the end of the passage
            if c > cuts[-1]:
                cuts.append(c)
        if cuts[-1] < len(passage):
            cuts.append(len(passage))
        return list(zip(cuts, cuts[1:], strict=False))

    def _scored(self, passage: np.ndarray, term: np.ndarray, opened: np.ndarray, closed: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(passage, entry, score) of whole passages that reach the threshold."""
        least = threshold - 1e-6  # shares are rounded to four bytes
        low = int(passage[0])
        p, t = passage[opened], term[opened]
        counts = self.at[t + 1] - self.at[t]
        where = _spread(self.at[t], counts)
        keys, back = np.unique((np.repeat(p, counts) - low) * self.n_blocks + self.key[where] % self.n_blocks, return_inverse=True)
        bound = np.bincount(back, self.high[where]) + closed[keys // self.n_blocks + low]
        keys = keys[bound >= least]
        begin = np.searchsorted(passage, np.arange(low, int(passage[-1]) + 2))
        for a in range(0, len(keys), 4096):
            part = keys[a : a + 4096]
            of = part // self.n_blocks
            counts = begin[of + 1] - begin[of]
            mine = term[_spread(begin[of], counts)]
            which = np.repeat(np.arange(len(part)), counts)
            want = mine * self.n_blocks + (part % self.n_blocks)[which]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            there = self.key[at] == want
            at, which = at[there], which[there]
            passes = np.bincount(which, self.high[at], len(part)) >= least
            at, which = at[passes[which]], which[passes[which]]
            if not len(at):
                continue
            counts = self.first[at + 1] - self.first[at]
            posting = _spread(self.first[at], counts)
            place = np.repeat(which, counts) * BLOCK + self.entry[posting] % BLOCK
            score = np.bincount(place, self.share[posting])
            for k in np.flatnonzero(score >= least).tolist():
                yield int(of[k // BLOCK]) + low, int(part[k // BLOCK] % self.n_blocks) * BLOCK + k % BLOCK, score[k]

    def verified(self, words: list[int], start: int, entry: int, least: float) -> tuple[float, float] | None:
        """Parts of the question's and the answer's shingles that the passage has, if enough."""
        end = int(self.ends[entry])
        item = self.tokens[int(self.ends[entry - 1]) if entry else 0 : end].tolist()
        passage = words[start : start + 2 * ENTRY_WORDS]
        if len(item) < SHINGLE:
            return (1.0, 1.0) if any(passage[i : i + len(item)] == item for i in range(len(passage) - len(item) + 1)) else None
        split = int(self.split[entry])
        have, every = _shingles(passage), _shingles(item)
        if len(every & have) < least * len(every):
            return None
        question, answer = _shingles(item[:split]), _shingles(item[max(0, split - SHINGLE + 1) :])
        q = len(question & have) / len(question) if question else 1.0
        a = len(answer & have) / len(answer) if answer else 1.0
        return (q, a) if min(q, a) >= 0.5 else None

    def leaks(self, texts: list[str | None], threshold: float, least: float) -> list[tuple[int, int, float, float, float]]:
        """(text, row of the item, score, question overlap, answer overlap), the best passage of each item."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        get = self.ready().ids.__getitem__
        part: list[list[int]] = []
        base, words = 0, 0

        def flush() -> None:
            for i, start, e, s in self.retrieve(part, threshold):
                if (v := self.verified(part[i], start, e, least)) is not None:
                    k = (base + i, int(self.owner[e]))
                    best[k] = max(best.get(k, (0.0, 0.0, 0.0)), (s, *v))

        for text in texts:
            part.append(list(map(get, words_in(text))))
            words += len(part[-1])
            if words >= 100_000:
                flush()
                base, words, part = base + len(part), 0, []
        if part:
            flush()
        return [(i, item, *v) for (i, item), v in sorted(best.items())]


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, max_chars: int) -> list[object]:
    """Indexes of parts of the benchmark, whose texts have about ``max_chars`` at most, as broadcasts."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-2 * chars // max_chars) if chars > max_chars else 1
    rows = lambda part: sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, str(r[0]), r[1] or ""))
    if n == 1:
        made = [Index(rows(items))]
    else:
        cut = F.udf(lambda text: [words for words, _ in entries_of(text)], "array<array<string>>")
        items = stored(items.withColumn("part", F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n))))
        entries = stored(items.select("part", F.explode(cut("text")).alias("words")))
        count, mean = entries.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
        terms = entries.select("part", F.explode(F.array_distinct("words")).alias("term"))
        df = stored(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        made = []
        for k in range(n):
            mine = df.join(terms.filter(F.col("part") == k).select("term"), "term", "left_semi")
            made.append(Index(rows(items.filter(F.col("part") == k)), (count, mean, {r.term: r.df for r in mine.collect()})))
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(index) for index in made]


def leaked(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6, overlap: float = 0.8, max_index_chars: int = 20_000_000) -> DataFrame:
    """One row per document and test item that it contains: BM25 ``score`` (1: all terms) and overlaps."""
    kinds = f"doc_id {dict(docs.dtypes)[id_col]}, item_id {dict(benchmark.dtypes)[item_col]}, score double, question_overlap double, answer_overlap double"
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def searched(sent: object) -> DataFrame:
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = sent.value
            for batch in batches:
                found = index.leaks(batch["text"].tolist(), threshold, overlap)
                if found:
                    out = pd.DataFrame(found, columns=["i", "row", "score", "question_overlap", "answer_overlap"])
                    out["doc_id"] = batch["doc_id"].to_numpy()[out["i"]]
                    out["item_id"] = [index.items[k] for k in out["row"]]
                    yield out[["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]]

        return docs.mapInPandas(search, kinds)

    return reduce(DataFrame.unionByName, (searched(sent) for sent in _indexes(benchmark, item_col, item_text_col, max_index_chars)))


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6, overlap: float = 0.8, max_index_chars: int = 20_000_000) -> DataFrame:
    """The rows of ``docs`` that contain no test item."""

    def leaks(sent: object) -> Column:
        def flags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                has = np.zeros(len(texts), bool)
                has[[i for i, *_ in sent.value.leaks(texts.tolist(), threshold, overlap)]] = True
                yield pd.Series(has)

        return F.pandas_udf(flags, "boolean")(F.col(text_col))

    for sent in _indexes(benchmark, item_col, item_text_col, max_index_chars):
        docs = docs.filter(~leaks(sent))
    return docs
