"""Phrase collocations by hierarchical pair naming.

A phrase of k words has an id, the name of the pair of its first k - 1 and its
last k - 1 words.  Level by level, neighbouring ids of the level before are
paired, the pairs are counted over the whole corpus, and those that are frequent
get an id; since parts of a frequent phrase are frequent, nothing else need be
looked at.  The pair that an id names is also its two parents: following them
gives the counts of all first and last parts, hence every cut, and all phrases
that lie inside one, hence which are subsumed.

The corpus is kept in blocks of about ``BLOCK`` words of one language, in which words
and pairs have small numbers of their own.  A block reports each of its distinct
pairs once with its count.  Reports of a pair meet in one shuffle by the pair,
where they are summed and, if the pair is frequent, get its id; only those go
back to the blocks, which are stored in buckets and needn't move.  So what is shuffled are vocabularies of blocks, a very common
pair is one row a block, and nothing is broadcast but where Spark sees that it is
small.  Tables and shuffle files of a level are deleted when the next one is
written.  A text that is longer than a block goes on in further ones, each with the
next words behind it, so that no phrase is lost at a border.

Texts are split into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into words at spaces
and tabs; A to Z are lower-cased.  Null and empty texts have no words, a null
language is ``und``.  Repeated rows count again; an empty table gives no rows;
columns that are not named don't enter.  Counts may reach 10^15 each.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import kept, lean_shuffles, stored

#: Words of a block; it ends with the document that reaches them.
BLOCK = 1_500_000
#: Bits of a pair's number in its block; the rest of 63 bits tell the block.
NUMBER_BITS = 22
#: Bits of a block's number in its task.
TASK_BITS = 19
#: Bytes of a text that are split into words at a time.
SLICE = 4_000_000
#: How finely rows of a language are dealt before its best are picked.
SALT = 64
#: Parts of all words or pairs that are summed one after the other.
PARTS = 4
#: Rows of a batch that a task hands on.
BATCH = 50_000

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_BREAK, _NONE = -1, -2


class Numbers(dict):
    """Words to numbers in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) - 2
        return n


class Block:
    """Words of a task's texts of one language, numbered."""

    def __init__(self) -> None:
        self.numbers = Numbers({b"\n": _BREAK, b"": _NONE})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def sequence(self, text: str) -> np.ndarray:
        """A text as numbers of words, ``_BREAK`` between pieces and at the end."""
        raw, at, out = text.encode("utf-8", "surrogatepass").translate(_FOLD), 0, []
        while at < len(raw):
            end = raw.find(b" ", at + SLICE) if at + SLICE < len(raw) else len(raw)
            end = len(raw) if end < 0 else end
            words = raw[at:end].replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
            out.append(found[found != _NONE])
            at = end + 1
        out.append(np.full(1, _BREAK, np.int32))
        return np.concatenate(out)

    def words(self) -> list[bytes]:
        return [w for w in self.numbers if w not in (b"\n", b"")]


def packed(seq: np.ndarray) -> bytes:
    """Numbers from -1 in few bytes: their low bytes together, then their higher ones, deflated."""
    return zlib.compress(np.ascontiguousarray((seq + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64) - 1


def by_count(seq: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers 0 to n - 1 in order of falling count, and a sequence in places of that order; -1 stays."""
    order = np.argsort(-np.bincount(seq[seq >= 0], minlength=n), kind="stable")
    place = np.full(n + 1, -1, np.int64)
    place[order] = np.arange(n)
    return order, place[seq]


def _flat(schema: pa.Schema, block: int, seq: np.ndarray, owned: int, columns: list) -> Iterator[pa.RecordBatch]:
    """A block as rows: one with its sequence, then one for each of its words or pairs with id, and count last."""
    start, kinds = block << NUMBER_BITS, list(schema)[2:-2]
    none = [pa.nulls(1, f.type) for f in kinds]
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([start], pa.int64()), *none, pa.array([packed(seq)], pa.binary()), pa.array([owned], pa.int64())], schema=schema)
    for at in range(0, len(columns[0]), BATCH):
        part = [c[at : at + BATCH] for c in columns]
        n = len(part[0])
        arrays = [pa.array(c, f.type) for c, f in zip(part, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block), pa.int64()), pa.array(np.arange(start + at, start + at + n), pa.int64()), *arrays, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], schema=schema)


_WORDS = pa.schema([("block", pa.int64()), ("at", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("count", pa.int64()), ("seq", pa.binary()), ("owned", pa.int64())])
_PAIRS = pa.schema([("block", pa.int64()), ("at", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("count", pa.int64()), ("seq", pa.binary()), ("owned", pa.int64())])


def _blocks_of(longest: int, block: int):  # noqa: ANN202
    """Rows of ``lang, text`` to blocks with their words and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, open_blocks = TaskContext.get().partitionId(), 0, {}

        def closed(lang: str, words: list[bytes], seq: np.ndarray, owned: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            made += 1
            if made >> TASK_BITS:
                raise OverflowError("a task has too many blocks; read the table in more partitions")
            # The block's own numbers, of the words that it has.
            some, seq = np.unique(np.append(seq, _BREAK), return_inverse=True)
            order, seq = by_count(seq[:-1] - 1, len(some) - 1)
            counts = np.bincount(seq[:owned][seq[:owned] >= 0], minlength=len(order))
            names = [words[i].decode("utf-8", "surrogatepass") for i in some[1:][order]]
            yield from _flat(_WORDS, task << TASK_BITS | made, seq, owned, [np.full(len(names), lang, object), names, counts])

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                text, lang = text.as_py(), lang.as_py()
                if not text:
                    continue
                b = open_blocks.setdefault(lang, Block())
                seq = b.sequence(text)
                b.parts.append(seq)
                b.size += len(seq)
                if b.size >= block:
                    seq, words = np.concatenate(b.parts), b.words()
                    # The words behind the border of a long text's block are only looked at.
                    for at in range(0, len(seq), 2 * block):
                        yield from closed(lang, words, seq[at : at + 2 * block + longest - 1], min(2 * block, len(seq) - at))
                    del open_blocks[lang]
        for lang, b in open_blocks.items():
            seq = np.concatenate(b.parts)
            yield from closed(lang, b.words(), seq, len(seq))

    return run


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the ids of their numbers to blocks of numbered pairs and the pairs' ids and counts."""
    for batch in batches:
        for i in range(batch.num_rows):
            block, owned, seq, have = (batch.column(c)[i] for c in ("block", "owned", "seq", "have"))
            seq, owned = unpacked(seq.as_py()), owned.as_py()
            numbers, ids = (have.values.field(c).to_numpy() for c in (0, 1))
            # Numbers that have an id, counted anew from 0; others are -1.
            table = np.full(int(max(seq.max(initial=0), numbers.max(initial=0))) + 2, -1, np.int64)
            table[numbers] = np.arange(len(numbers))
            now = table[seq]
            both = np.flatnonzero((now[:-1] >= 0) & (now[1:] >= 0))
            pairs, where = np.unique(now[both] * len(ids) + now[both + 1], return_inverse=True)
            # What stands alone is no part of a longer phrase: runs of pairs stay, one gap between them.
            starts = np.flatnonzero(np.diff(both, prepend=-2) > 1)
            order, where = by_count(where, len(pairs))
            pairs = pairs[order]
            counts = np.bincount(where[both < owned], minlength=len(pairs))
            runs = np.insert(where, starts, -1)
            owned = int((both < owned).sum()) + int((both[starts] < owned).sum())
            yield from _flat(_PAIRS, block.as_py(), runs, owned, [ids[pairs // max(1, len(ids))], ids[pairs % max(1, len(ids))], counts])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _frequent(read: DataFrame, keys: list[str], least: int) -> tuple[DataFrame, Callable[[], None]]:
    """Words or pairs of blocks whose counts over all blocks reach ``least``: with the sum ``a`` and the ``id``, the first place that has it; and what deletes them.

    They are summed a part of all keys at a time, so that no shuffle holds all reports.
    """
    all_blocks = Window.partitionBy(*keys)
    told = read.filter("seq is null").select("at", *keys, "count")
    made = []
    for part in range(PARTS):
        some = told.filter(F.pmod(F.xxhash64(*keys, F.lit(11)), F.lit(PARTS)) == part)
        summed = some.select("at", *keys, F.sum("count").over(all_blocks).alias("a"), F.min("at").over(all_blocks).alias("id"))
        made.append(kept(summed.filter(F.col("a") >= least)))

    def delete() -> None:
        for _, done in made:
            done()

    return reduce(DataFrame.unionByName, [df for df, _ in made]), delete


def _with_ids(read: DataFrame, named: DataFrame) -> DataFrame:
    """Blocks with their numbers that have an id; blocks without any are gone."""
    block, number = F.shiftright("at", NUMBER_BITS).alias("block"), F.col("at").bitwiseAND((1 << NUMBER_BITS) - 1).alias("number")
    lists = named.select(block, number, "id").groupBy("block").agg(F.collect_list(F.struct("number", "id")).alias("have"))
    return read.filter("seq is not null").select("block", "owned", "seq").join(lists, "block")


def phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, block: int = BLOCK) -> DataFrame:
    """All phrases of 2 to ``longest`` words with ``least`` occurrences, with what their parts have.

    ``lang, n, level, id, words, a``, ``heads`` and ``tails`` (counts of the first and last
    1, 2, ... words) and ``inside`` (level and id of the shorter phrases in it).
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    read, done = kept(rows.mapInArrow(_blocks_of(longest, block), _ddl(_WORDS)), by="block")
    sizes = stored(read.filter("seq is null").groupBy("lang").agg(F.sum("count").alias("n")))
    named, named_done = _frequent(read, ["lang", "word"], least)
    before = stored(named.filter("at = id").select("id", "lang", F.array("word").alias("words"), "a", *[F.array().cast(t).alias(c) for c, t in (("heads", "array<long>"), ("tails", "array<long>"), ("inside", "array<struct<level:int,id:long>>"))]))
    found = None
    for level in range(2, longest + 1):
        pairs, pairs_done = kept(_with_ids(read, named).mapInArrow(_paired, _ddl(_PAIRS)), by="block")
        done()
        named_done()
        read, done = pairs, pairs_done
        named, named_done = _frequent(read, ["left", "right"], least)
        part = lambda side: before.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in before.columns if c != "id"])  # noqa: B023, E731
        both = named.filter("at = id").select("left", "right", "a", "id").join(part("left"), "left").join(part("right"), "right")
        parents = F.array(*[F.struct(F.lit(level - 1).alias("level"), F.col(side).alias("id")) for side in ("left", "right")]) if level > 2 else F.array().cast("array<struct<level:int,id:long>>")
        before = stored(both.select(
            "id", F.col("left_lang").alias("lang"), F.concat("left_words", F.slice("right_words", -1, 1)).alias("words"), "a",
            F.concat("left_heads", F.array("left_a")).alias("heads"), F.concat("right_tails", F.array("right_a")).alias("tails"),
            F.array_distinct(F.concat("left_inside", "right_inside", parents)).alias("inside"),
        ))
        new = before.withColumn("level", F.lit(level))
        found = new if found is None else found.unionByName(new)
    done()
    named_done()
    return found.join(sizes, "lang")


def cut(a: Column, n: Column, heads: Column, tails: Column) -> Column:
    """The cut with the lowest score, the earliest of several: ``score, k, l, r``, exact to 38 digits."""
    whole = lambda c: c.cast("decimal(19,0)")
    top = (1000 * a).cast("decimal(18,0)") * whole(n)
    size = F.size(heads)
    cuts = F.transform(
        F.sequence(F.lit(1), size),
        lambda k: F.struct(
            F.call_function("div", top, whole(F.element_at(heads, k)) * F.element_at(tails, size - k + 1).cast("decimal(18,0)")).alias("score"), k.alias("k"), F.element_at(heads, k).alias("l"), F.element_at(tails, size - k + 1).alias("r")
        ),
    )
    return F.array_min(cuts)


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, percent: int = 100, best: int = 2000, block: int = BLOCK) -> DataFrame:
    """The ``best`` phrases of each language by cohesion: ``lang, rank, phrase, a, l, r, n, score``.

    Phrases that lie inside a longer one with at least ``percent`` of their occurrences are left out.
    """
    with lean_shuffles(docs.sparkSession):
        found = phrases(docs, text_col=text_col, lang_col=lang_col, longest=longest, least=least, block=block)
    covers = found.select("a", F.explode("inside").alias("in")).groupBy(F.col("in.level").alias("level"), F.col("in.id").alias("id")).agg(F.max("a").alias("most"))
    kept = found.join(covers, ["level", "id"], "left").filter(F.coalesce(100 * F.col("most") < percent * F.col("a"), F.lit(True)))
    kept = kept.withColumn("c", cut(F.col("a"), F.col("n"), F.col("heads"), F.col("tails"))).select("lang", F.array_join("words", " ").alias("phrase"), "a", "c.l", "c.r", "n", "c.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # The best of every small share of a language first, so that no task sees a whole language.
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).orderBy(*order)
    some = kept.withColumn("rank", F.row_number().over(shares)).filter(F.col("rank") <= best)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
