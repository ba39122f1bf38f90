"""Line dedup by content-defined chunks of lines, in built-in functions alone.

Lines with a word are hashed, and a rolling hash runs over windows of two line
hashes.  Where it is 0 modulo ``modulus`` a chunk ends; the choice looks at the
two lines alone, so text that is put in elsewhere shifts no boundary.  Chunks
of two and more lines that occur again anywhere are removed.  At the borders,
where a repeated passage shares a chunk with other lines, the rolling hashes
tell how far the repetition reaches: runs of windows that occur elsewhere are
removed too if they have ``min_words`` words.  A line with as many words counts
as a run of its own.

The first occurrence (by id, then place) stays.  Before a line goes, its bytes
are compared with those of the lines that have its hash.  Only hashes and
places are shuffled for the search; texts move once, to meet their verdicts.

Null texts stay null, lines without a word stay where they are, and texts that
lose all their lines become empty.  Very long texts take time in proportion to
their lines.  Rows that are equal in id and text count as one document and lose
the same lines; ids may have any type and may be null or repeat.  Empty tables
give no rows, and extra columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, fresh, let, stored


def _instances(docs: DataFrame, min_words: int, modulus: int) -> DataFrame:
    """Windows, long lines and chunks of each text: ``k, doc_id, kind, h, s, e`` and hashes and words of both ends.

    ``docs`` has ``k`` (hash of id and text), ``doc_id`` and ``text``; ``s`` and
    ``e`` count the lines of the text.
    """
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w")),
    )
    docs = docs.select("k", "doc_id", F.filter(lines, lambda x: x["w"] > 0).alias("l"))
    # Used more than once below, so that it is worked out once a text.
    docs = docs.withColumn("hashes", F.transform("l", lambda y: y["h"]))
    n = F.size("l")
    at = lambda i: F.get(F.col("l"), i)
    window = F.transform(
        F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")),
        lambda j: F.struct(
            F.lit(0).alias("kind"), F.xxhash64(F.get("hashes", j), F.get("hashes", j + 1)).alias("h"), at(j)["i"].alias("s"), at(j + 1)["i"].alias("e"),
            at(j)["h"].alias("hs"), at(j + 1)["h"].alias("he"), at(j)["w"].alias("ws"), at(j + 1)["w"].alias("we"), j.alias("j"),
        ),
    )
    docs = docs.withColumn("windows", window)
    long = F.transform(
        F.filter(F.transform(F.col("l"), lambda x, j: F.struct(x.alias("x"), j.alias("j"))), lambda y: y["x"]["w"] >= min_words),
        lambda y: F.struct(
            F.lit(1).alias("kind"), y["x"]["h"].alias("h"), y["x"]["i"].alias("s"), y["x"]["i"].alias("e"),
            y["x"]["h"].alias("hs"), y["x"]["h"].alias("he"), y["x"]["w"].alias("ws"), y["x"]["w"].alias("we"), y["j"].alias("j"),
        ),
    )
    ends = F.transform(F.filter("windows", lambda x: F.pmod(x["h"], F.lit(modulus)) == 0), lambda x: x["j"])
    docs = docs.withColumn("long", long).withColumn("ends", F.concat(F.array(F.lit(-1)), ends, F.array(n - 1)))
    spans = F.transform("ends", lambda x, i: F.struct((x + 1).alias("a"), F.get(F.col("ends"), i + 1).alias("b")))
    docs = docs.withColumn("spans", F.filter(spans, lambda x: x["b"] > x["a"]))
    chunk = F.transform(
        F.col("spans"),
        lambda x: F.struct(
            F.lit(2).alias("kind"), F.xxhash64(F.slice("hashes", x["a"] + 1, x["b"] - x["a"] + 1)).alias("h"), at(x["a"])["i"].alias("s"), at(x["b"])["i"].alias("e"),
            at(x["a"])["h"].alias("hs"), at(x["b"])["h"].alias("he"), at(x["a"])["w"].alias("ws"), at(x["b"])["w"].alias("we"), x["a"].alias("j"),
        ),
    )
    return docs.select("k", "doc_id", F.explode(F.concat("windows", "long", chunk)).alias("x")).select("k", "doc_id", "x.*")


def _verdicts(found: DataFrame, min_words: int) -> DataFrame:
    """Instances to ``k, drop, kept``: (place, hash) of lines that may go, and of those that stand for them."""
    place = F.struct("doc_id", "k", "s", "e", "hs", "he")
    again = found.groupBy("kind", "h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    marks = found.join(again, ["kind", "h"]).filter(~((F.col("k") == F.col("first.k")) & (F.col("s") == F.col("first.s"))))
    marks = stored(marks.filter((F.col("hs") == F.col("first.hs")) & (F.col("he") == F.col("first.he"))))
    ends = F.array(*[F.struct(F.col(c).alias("i"), F.col(x).alias("h"), F.col(w).alias("w"), (F.col("j") + d).alias("j")) for c, x, w, d in (("s", "hs", "ws", 0), ("e", "he", "we", 1))])
    lines = marks.filter("kind < 2").select("k", F.explode(F.when(F.col("kind") == 0, ends).otherwise(F.slice(ends, 1, 1))).alias("x"))
    lines = lines.select("k", "x.*").distinct()
    # Neighbours in a run have the same difference of place and rank.
    runs = lines.withColumn("run", F.col("j") - F.row_number().over(Window.partitionBy("k").orderBy("j")))
    runs = runs.withColumn("words", F.sum("w").over(Window.partitionBy("k", "run")))
    chunks = marks.filter("kind = 2").select("k", F.explode(F.sequence("s", "e")).alias("i")).distinct().withColumn("whole", F.lit(True))
    drop = runs.join(chunks, ["k", "i"], "left").filter((F.col("words") >= min_words) | F.col("whole"))
    drop = drop.select("k", F.lit(True).alias("gone"), F.struct("i", "h").alias("x"))
    stands = marks.filter("kind < 2").select(F.col("first.k").alias("k"), F.explode(F.array(F.struct(F.col("first.s").alias("i"), F.col("hs").alias("h")), F.struct(F.col("first.e").alias("i"), F.col("he").alias("h")))).alias("x")).distinct()
    every = drop.unionByName(stands.select("k", F.lit(False).alias("gone"), "x"))
    return every.groupBy("k").agg(F.collect_set(F.when(F.col("gone"), F.col("x"))).alias("drop"), F.collect_set(F.when(~F.col("gone"), F.col("x"))).alias("kept"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, modulus: int = 4, removed_col: str | None = None) -> DataFrame:
    """``docs`` without the repeated lines; ``removed_col`` names a column for their number, if wanted."""
    k = F.xxhash64(F.col(id_col), F.col(text_col))
    found = stored(_instances(docs.select(k.alias("k"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), min_words, modulus))
    own, there, drop, kept = fresh("own"), fresh("k"), fresh("drop"), fresh("kept")
    verdicts = _verdicts(found, min_words).select(F.col("k").alias(there), F.col("drop").alias(drop), F.col("kept").alias(kept))
    both = docs.withColumn(own, k).join(verdicts, F.col(own) == F.col(there), "left").drop(there)
    both = stored(both.withColumn(drop, F.coalesce(drop, F.array().cast(_PLACES))))
    return _without(both, docs.columns, text_col, own, drop, kept, removed_col)


_PLACES = "array<struct<i:int,h:bigint>>"


def _without(both: DataFrame, columns: list[str], text_col: str, own: str, drop: str, kept: str, removed_col: str | None) -> DataFrame:
    text, gone = F.col(text_col), F.col(drop)
    split = F.split(text, "\n")
    # Every line that may go or stands for others, with its bytes.
    lines = let(split, lambda ls: F.transform(F.concat(gone, F.coalesce(kept, F.array().cast(_PLACES))), lambda x: F.struct(x["h"].alias("h"), F.get(ls, x["i"]).alias("line"))))
    bytes_of = both.filter(F.size(drop) + F.coalesce(F.size(kept), F.lit(0)) > 0).select(F.explode(lines).alias("x")).groupBy("x.h").agg(F.min("x.line").alias("a"), F.max("x.line").alias("b"))
    # Different lines of one 64-bit hash: none are expected, and a few among trillions of lines.
    clash = stored(bytes_of.filter("a <> b").select("h"))
    if not clash.isEmpty():
        fine = both.select(F.col(own).alias("k"), F.explode(drop).alias("x")).join(clash, F.col("x.h") == clash["h"], "left_anti")
        fine = fine.groupBy("k").agg(F.collect_set("x").alias("fine"))
        key, left = fresh("k"), fresh("fine")
        both = both.join(fine.select(F.col("k").alias(key), F.col("fine").alias(left)), F.col(own) == F.col(key), "left")
        gone = F.coalesce(F.col(left), F.array().cast(_PLACES))
    rest = let(split, lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.transform(gone, lambda x: x["i"])), lambda i: F.get(ls, i)))
    new: Column = F.when(F.size(gone) > 0, F.array_join(rest, "\n")).otherwise(text)
    out = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns]
    return both.select(*out, *([F.size(gone).cast("long").alias(removed_col)] if removed_col else []))
