"""Mixing sources to target weights by pivotal dependent rounding, natively.

Targets: the sources' weights share a given part of all words; a target stops
at a cap and the excess is shared again by weight.  Each document of a source
then wants ``target / source_size`` copies.  The whole part is taken, and the
fractions are rounded together: two documents trade mass, so that the words
they take stay the same, until one of them is integral; which one gives is
random with the odds that keep each document's expectation.  Blocks of
documents are rounded in parallel and leave at most one fraction each; these
meet in the blocks of the next level, up to one per source, so a source's taken
words differ from its target by at most half its residual document's size (that
last fraction goes to the nearer side).

Null and empty texts have size 0 and are not taken; very long ones are counted
whole.  A null source is a source, the last one.  Of n equal rows (for the
report: equal in source, id and size; for ``mixed``: in all columns) the whole
copies among n fractions are given out first, one to a row, and what is left is
rounded as one row's fraction.  Ids may have any type and may be null or repeat.
Random numbers come from hashes of rows, so reruns agree.  Empty tables give no
rows, and extra columns pass through ``mixed`` whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, n_words_of, row_hash, stored

#: Documents of a block, on average.
BLOCK = 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, size`` rows to ``source, source_size, target``, a row per source."""
    per = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    # These windows see a row per source, not the documents.
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    per = per.withColumn("most", cap * F.col("source_size"))
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(filled), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    # In order of most / weight, the first source that its share of the rest doesn't fill sets the level of all after it.
    level = F.when(rest / open_weight <= F.col("most") / F.col("weight"), rest / open_weight)
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size", "n_docs", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _uniform(*cols: Column) -> Column:
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _round_block(items: Column, seed: int) -> Column:
    """Pivotal rounding of an array of (k, size, p): who is settled, and the item that stays fractional."""
    eps = 1e-9
    kind = "struct<k:struct<a:bigint,b:bigint>,size:bigint,p:double>"
    nobody = F.lit(None).cast(kind)
    settled = F.array().cast("array<struct<k:struct<a:bigint,b:bigint>,up:boolean>>")

    def step(acc: Column, new: Column) -> Column:
        old = acc["rest"]
        # Mass in words: what a size times its fraction gives away, the other takes.
        a, b = old["p"] * old["size"], new["p"] * new["size"]
        up = F.least(old["size"] - a, b)  # from new to old
        down = F.least(a, new["size"] - b)  # from old to new
        u = _uniform(old["k"]["a"], old["k"]["b"], new["k"]["a"], new["k"]["b"], F.lit(seed))
        move = F.when(u * (up + down) < down, up).otherwise(-down)
        pa, pb = (a + move) / old["size"], (b - move) / new["size"]
        done_a, done_b = (pa < eps) | (pa > 1 - eps), (pb < eps) | (pb > 1 - eps)
        keep_a = F.struct(old["k"].alias("k"), old["size"].alias("size"), pa.alias("p"))
        keep_b = F.struct(new["k"].alias("k"), new["size"].alias("size"), pb.alias("p"))
        out = F.struct(
            F.when(~done_a, keep_a).when(~done_b, keep_b).otherwise(nobody).alias("rest"),
            F.concat(
                acc["settled"],
                F.when(done_a, F.array(F.struct(old["k"].alias("k"), (pa > 0.5).alias("up")))).otherwise(settled),
                F.when(done_b, F.array(F.struct(new["k"].alias("k"), (pb > 0.5).alias("up")))).otherwise(settled),
            ).alias("settled"),
        )
        return F.when(old.isNull(), F.struct(new.cast(kind).alias("rest"), acc["settled"].alias("settled"))).otherwise(out)

    return F.aggregate(items, F.struct(nobody.alias("rest"), settled.alias("settled")), step)


def rounded(items: DataFrame, most: int, total: int, sources: int, seed: int = 11) -> DataFrame:
    """``source, k, size, p`` rows to ``source, k, up``: which fractions become 1.

    ``most``: rows of the largest source, which set the number of levels;
    ``total``: rows of all ``sources``, which set the number of tasks.
    """
    done: list[DataFrame] = []
    blocks = -(-max(1, most) // BLOCK)
    level = 0
    while True:
        block = F.pmod(F.xxhash64("k", F.lit(seed + level)), F.lit(blocks))
        grouped = items.groupBy("source", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("k", "size", "p"))).alias("items"))
        # A task takes 64 full blocks; small levels need neither more tasks nor more files.
        got = stored(grouped.select("source", _round_block(F.col("items"), seed + level).alias("r")).coalesce(max(1, total // (64 * BLOCK))))
        done.append(got.select("source", F.explode("r.settled").alias("s")).select("source", "s.k", "s.up"))
        items = got.filter("r.rest is not null").select("source", "r.rest.k", "r.rest.size", "r.rest.p")
        if blocks == 1:
            last = items.select("source", "k", (F.col("p") >= 0.5).alias("up"))
            return reduce(DataFrame.unionByName, [*done, last])
        total = min(total, sources * blocks)
        blocks = -(-blocks // BLOCK)
        level += 1


def copies(sized: DataFrame, **mix: object) -> DataFrame:
    """``source, k, size`` rows (``k``: a struct of longs a, b) to one row per (source, k, size).

    Adds ``n`` (rows that were equal), ``copies`` (that each of them gets),
    ``more`` (how many of them get another), ``source_size`` and ``target``.
    Columns beyond these are part of the key.
    """
    targets = stored(source_targets(sized.select("source", "size"), **mix))
    key = sized.columns
    keys = sized.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    base = keys.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")), "left").select("d.*", "t.source_size", "t.target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = base.withColumn("whole", F.floor(ratio + 1e-9).cast("int"))
    fraction = F.greatest(F.lit(0.0), ratio - F.col("whole")) * F.col("n")
    base = base.withColumn("most", F.floor(fraction + 1e-9).cast("int")).withColumn("p", F.greatest(F.lit(0.0), fraction - F.col("most")))
    most, total, sources = targets.agg(F.max("n_docs"), F.sum("n_docs"), F.count(F.lit(1))).first()
    up = rounded(base.filter("size > 0 and p > 1e-9").select("source", "k", "size", "p"), most or 0, total or 0, sources)
    up = up.filter("up").select(F.col("source").alias("source_up"), F.col("k").alias("k_up"))
    out = base.join(up, (F.col("k") == F.col("k_up")) & F.col("source").eqNullSafe(F.col("source_up")), "left")
    more = F.col("most") + F.col("k_up").isNotNull().cast("int")
    taken = lambda x: F.when(F.col("size") > 0, x).otherwise(0)
    return out.select(*key, "n", "source_size", "target", taken(F.col("whole")).alias("copies"), taken(more).alias("more"))


def mix_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **mix: object) -> DataFrame:
    """One row per document: ``size``, ``source_size``, ``target`` and ``taken`` words."""
    size = n_words_of(F.col(text_col))
    k = F.struct(F.xxhash64(id_col).alias("a"), size.alias("b"))
    got = copies(stored(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), k.alias("k"), size.alias("size"))), **mix)
    got = got.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies_of = F.col("copies") + (F.col("i") <= F.col("more")).cast("int")
    return got.select("doc_id", "size", "source_size", "target", (copies_of * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", **mix: object) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    source, key, there, n, i = F.col(source_col), fresh("key"), fresh("k"), fresh("n"), fresh("i")
    own = [F.col(f"`{c}`") for c in docs.columns]
    k = F.struct(row_hash(docs, 1).alias("a"), row_hash(docs, 2).alias("b"))
    sized = stored(docs.select(source.alias("source"), k.alias("k"), n_words_of(F.col(text_col)).alias("size")))
    got = stored(copies(sized, **mix).select(F.col("k").alias(key), "n", "copies", "more").filter("copies + more > 0"))

    def repeated(rows: DataFrame, times: DataFrame) -> DataFrame:
        both = rows.join(times, F.col(there) == F.col(key))
        return both.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*own)

    # Rows alone get their own copies; of rows that repeat, some get another, and as they are alike, one stands for those.
    alone = F.when(F.col("n") == 1, F.col("more")).otherwise(0)
    keyed = docs.withColumn(there, k)
    every = repeated(keyed, got.select(key, (F.col("copies") + alone).cast("int").alias(n)).filter(F.col(n) > 0))
    again = stored(got.filter("n > 1 and more > 0").select(key, F.col("more").cast("int").alias(n)))
    if again.isEmpty():
        return every
    some = keyed.join(again.select(key), F.col(there) == F.col(key), "left_semi")
    some = some.groupBy(there).agg(*[F.first(c).alias(name) for c, name in zip(own, docs.columns, strict=True)])
    return every.unionByName(repeated(some, again))
