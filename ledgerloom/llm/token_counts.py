"""Token counts: a broadcast table of frequent pre-tokens in front of per-worker caches.

The tokenizer is a piece model whose pieces hold a space mark only at their
start, and no line feed.  So no merge crosses the place before a run of spaces
or around a line feed, and the count of a text is the sum over its pre-tokens:
a run of spaces (the model sets one before the text) with what follows, or a
line feed with what follows.  Lengths of frequent pre-tokens are broadcast; the
others are encoded once per worker and remembered.  Nothing is shuffled: the
frequent ones are tallied on the driver, over a sample of bounded size.

Null and empty texts have no tokens; very long ones are counted whole, pre-token
by pre-token.  Repeated rows are counted row by row, ids may have any type, an
empty table gives no rows, and columns other than id and text are left out.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRETOKEN = re.compile(r"\n[^ \n]*| +[^ \n]*")
#: A worker's cache starts afresh beyond so many entries; longer pre-tokens are not kept.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48


class Lengths(dict):
    """Pre-token to number of tokens; what is missing is encoded and remembered."""

    def __init__(self, model: bytes, frequent: dict[str, int]):
        super().__init__(frequent)
        self.frequent = frequent
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        vocabulary = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in vocabulary):
            raise ValueError("this model merges across words or lines; its texts can't be counted by pre-token")

    def __missing__(self, pretoken: str) -> int:
        # The model puts a space mark in front: the pre-token's own, or one before the line feed.
        n = 1 if pretoken == "" else len(self.pieces.encode(pretoken)) - (pretoken[0] == "\n")
        if len(pretoken) <= CACHE_CHARS:
            if len(self) > CACHE_ENTRIES + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[pretoken] = n
        return n


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text that isn't empty, each without its first space."""
    text = text.replace("▁", " ")
    if text[0] == " " or "  " in text or " \n" in text:
        return [p if p[0] == "\n" else p[1:] for p in PRETOKEN.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


def count(text: str | None, lengths: Lengths) -> int:
    return sum(map(lengths.__getitem__, pretokens(text))) if text else 0


_WORKER: dict[str, Lengths] = {}


def token_counts(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, sample_rows: int = 4_000, sample_bytes: int = 8_000, frequent: int = 50_000) -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_tokens`` and whether it is over ``max_tokens``.

    ``sample_rows`` texts of at most ``sample_bytes`` each, the first that are
    met, and ``frequent`` bound the table of frequent pre-tokens.  They steer
    speed alone: counts are the same with any table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seen: Counter[str] = Counter()
    for row in docs.select("text").filter(F.octet_length("text").between(1, sample_bytes)).head(sample_rows):
        seen.update(p for p in pretokens(row.text) if len(p) <= CACHE_CHARS)
    lengths = Lengths(model, {})
    key = uuid.uuid4().hex
    table = spark.sparkContext.broadcast((model, {p: lengths[p] for p, _ in seen.most_common(frequent)}))

    @F.pandas_udf("long")
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _WORKER.get(key)
        if known is None:
            _WORKER.clear()
            known = _WORKER[key] = Lengths(*table.value)
        for batch in texts:
            yield pd.Series([count(t, known) for t in batch], dtype="int64")

    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        n_tokens("text").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > max_tokens)
