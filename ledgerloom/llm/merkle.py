"""Merkle manifest of a dataset: a tree of digests per source, one over the sources, and a proof for every row.

A leaf is the SHA-256 of a row's columns.  Leaves of a source stand in order of
their id; every ``ARITY`` consecutive nodes (the last run may be shorter, even a
single one) become the digest of their hex digests, until one is left.  The
sources' digests, in order of source with null first, form the same kind of tree.

The trees grow by an event-driven combine by key.  A digest that turns up is put
in its slot of the partial parent; once the parent has as many children as its
place and the tree's size ask for, it is complete, is emitted with its children,
and turns up one level higher itself.  Tasks first resolve what their own rows
complete.  What is left (the frontier: partial parents at the borders of
partitions) is shuffled by the ancestor ``STEP`` levels up, ``STEP`` more with
each round, so a round sees at most ``ARITY ** STEP`` nodes of a key and the
number of rounds follows from the largest tree.  Proofs go the other way: a
parent's list of children tells each child its siblings, so blocks of ``STEP``
levels hand the siblings down to the leaves.

No tree passes one task: places are counted from sorted partitions, and only one
count per partition is collected.

Null columns count as ``-``, so null, empty and absent texts differ.  Rows of one
id are ordered by their leaves, null ids come first, equal rows have equal leaves
at neighbouring places.  Very long texts are hashed whole.  Ids of any type that
sorts are taken; columns that are not named don't enter.  An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored

ARITY = 3
#: Levels that a round resolves, so a key has at most ARITY ** STEP nodes.
STEP = 6
#: Partial parents that a task holds before it hands them on unresolved.
MOST_PARTIAL = 50_000

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string()))])
_NODE_DDL = "tree string, size long, level int, place long, digest string, children array<string>"


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of values in order: each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def join_digests(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def width(size: int, level: int) -> int:
    """Nodes of a tree of ``size`` leaves at a level."""
    for _ in range(level):
        size = -(-size // ARITY)
    return size


def height(size: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


class Growth:
    """Partial parents of a task; complete ones rise at once."""

    def __init__(self) -> None:
        self.partial: dict[tuple[str | None, int, int], tuple[int, list[str | None]]] = {}
        self.done: list[tuple] = []
        self.widths: dict[int, list[int]] = {}

    def _widths(self, size: int) -> list[int]:
        found = self.widths.get(size)
        if found is None:
            if len(self.widths) > 10_000:
                self.widths.clear()
            found = self.widths[size] = [width(size, k) for k in range(height(size) + 1)]
        return found

    def node(self, tree: str | None, size: int, level: int, place: int, digest: str) -> None:
        """A digest turns up: fill its slot, and go on with the parent if that completes it."""
        at = self._widths(size)
        while level < len(at) - 1:
            parent, slot = divmod(place, ARITY)
            arity = min(ARITY, at[level] - ARITY * parent)
            key = tree, level + 1, parent
            slots = self.partial.setdefault(key, (size, [None] * arity))[1]
            slots[slot] = digest
            if None in slots:
                return
            del self.partial[key]
            digest, level, place = join_digests(slots), level + 1, parent
            self.done.append((tree, size, level, place, digest, slots))

    def part(self, tree: str | None, size: int, level: int, place: int, children: list[str | None]) -> None:
        """A partial parent of another task turns up."""
        key = tree, level, place
        have = self.partial.setdefault(key, (size, [None] * len(children)))[1]
        have[:] = [a if b is None else b for a, b in zip(have, children, strict=True)]
        if None not in have:
            del self.partial[key]
            digest = join_digests(have)
            self.done.append((tree, size, level, place, digest, have))
            self.node(tree, size, level, place, digest)

    def out(self) -> pa.RecordBatch:
        """What is complete; the frontier too when there is too much of it."""
        rows, self.done = self.done, []
        if len(self.partial) > MOST_PARTIAL:
            rows += self.left()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, _NODE.types, strict=True)], schema=_NODE)

    def left(self) -> list[tuple]:
        rows = [(tree, size, level, place, None, slots) for (tree, level, place), (size, slots) in self.partial.items()]
        self.partial = {}
        return rows


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    growth = Growth()
    for batch in batches:
        for tree, size, level, place, digest, children in zip(*[batch.column(c).to_pylist() for c in _NODE.names], strict=True):
            if digest is None:
                growth.part(tree, size, level, place, children)
            else:
                growth.node(tree, size, level, place, digest)
        yield growth.out()
    growth.done += growth.left()
    yield growth.out()


def _above(level: int) -> list[Column]:
    """The ancestor at a level (a node above it: itself) that a node is dealt out by."""
    up = F.greatest(F.lit(level) - F.col("level"), F.lit(0))
    return [F.col("tree"), F.greatest(F.col("level"), F.lit(level)), F.floor(F.col("place") / F.pow(F.lit(float(ARITY)), up)).cast("long")]


def _grow(leaves: DataFrame, levels: int) -> DataFrame:
    """All nodes above the leaves: ``tree, size, level, place, digest, children``."""
    start = leaves.select("tree", "size", F.lit(0).alias("level"), "place", "digest", F.lit(None).cast("array<string>").alias("children"))
    found = stored(start.mapInArrow(_grown, _NODE_DDL))
    done = found.filter("digest is not null")
    for top in range(STEP, levels + STEP, STEP):
        found = stored(found.filter("digest is null").repartition(*_above(top)).mapInArrow(_grown, _NODE_DDL))
        done = done.unionByName(found.filter("digest is not null"))
    return done


def _handed_down(names: list[str]):  # noqa: ANN202
    """Rows of blocks, highest first, to rows with ``path``: the runs of siblings up to the root, own places null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ways, top = None, {}, None
        for batch in batches:
            at, paths, tops = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("tree", "block", "kind", "level", "place", "children", "path", "top")]
            for i, (tree, group, kind, level, place, children, path, above) in enumerate(zip(*columns, strict=True)):
                if (tree, group) != block:
                    block, ways = (tree, group), {}
                if kind == "given":
                    ways[level, place] = None, path
                    top = above
                elif kind == "node":
                    for j in range(len(children)):
                        ways[level - 1, ARITY * place + j] = children[:j] + [None] + children[j + 1 :], ways[level, place]
                else:
                    runs, way = [], ways[level, place]
                    while way[0] is not None:
                        runs.append(way[0])
                        way = way[1]
                    at.append(i)
                    paths.append(runs + way[1])
                    tops.append(top)
            rows = batch.select(names).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(paths, pa.list_(pa.list_(pa.string()))), pa.array(tops, pa.string())], names=[*names, "path", "top"])

    return run


def _paths(leaves: DataFrame, nodes: DataFrame, roots: DataFrame, levels: int) -> DataFrame:
    """``leaves`` with ``path`` and ``top``; ``roots``: ``tree, level, place, path, top`` of every tree's root."""
    roots = roots.select("tree", "level", "place", F.lit("given").alias("kind"), "path", "top")
    given, out = roots.limit(0), None
    for low in range(max(0, (levels - 1) // STEP * STEP), -1, -STEP):
        high = low + STEP
        within = (F.col("level") > low) & (F.col("level") <= high)
        given = given.unionByName(roots.filter(within | (F.col("level") == 0) if low == 0 else within))
        inner = nodes.filter(within).select("tree", "level", "place", "children", F.lit("node").alias("kind"))
        if low:
            # Nodes that the next block starts from; roots at this level have starts of their own.
            asked = nodes.filter((F.col("level") == low) & (F.col("size") > ARITY**low)).select("tree", "level", "place", F.lit("wanted").alias("kind"))
        else:
            asked = leaves.withColumns({"level": F.lit(0), "kind": F.lit("wanted")})
        names = [c for c in asked.columns if c not in ("kind", "block")]
        rows = given.unionByName(inner, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
        rows = rows.withColumn("block", F.floor(F.col("place") / F.pow(F.lit(float(ARITY)), F.lit(high) - F.col("level"))).cast("long"))
        rank = F.when(F.col("kind") == "given", 0).when(F.col("kind") == "node", 1).otherwise(2)
        rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), rank, "place")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields if f.name in names)
        out = rows.mapInArrow(_handed_down(names), f"{ddl}, path array<array<string>>, top string")
        if low:
            given = stored(out.select("tree", "level", "place", F.lit("given").alias("kind"), "path", "top"))
    return out


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``tree``) with ``place`` in their tree by ``order``, and the tree's ``size``; stored."""
    dealt = rows.withColumn("deal", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "deal").sortWithinPartitions("tree", *order).drop("deal")
    at = stored(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")))
    # A tree has one row here for each sorted partition that it reaches into.
    runs = at.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    by_part = Window.partitionBy("tree").orderBy("part")
    before = F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("tree").alias("t"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    found = at.join(runs, at["part"].eqNullSafe(runs["p"]) & at["tree"].eqNullSafe(runs["t"]))
    return stored(found.withColumn("place", F.col("nth") + F.col("shift")).drop("t", "p", "part", "nth", "shift"))


def _tops(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tree, level, place, top``: the root of every tree; of a lone leaf itself."""
    last = nodes.filter(F.col("place") == 0).select("tree", "size", "level", "place", F.col("digest").alias("top"))
    lone = leaves.filter("size = 1").select("tree", "size", F.lit(0).alias("level"), "place", F.col("digest").alias("top"))
    return last.unionByName(lone).groupBy("tree").agg(F.max_by(F.struct("level", "place", "top"), "level").alias("r")).select("tree", "r.*")


def manifest(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = LEAF_COLUMNS, also: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, leaf, subroot, root, proof`` and ``also``.

    ``proof`` lists the runs from the leaf to the root, each the siblings in order
    with null at the row's own place.  ``also`` are columns worked out from ``docs``,
    under names other than those of nodes (``tree, place, path`` and so on).
    """
    more = also or {}
    rows = docs.select(F.col(source_col).cast("string").alias("tree"), F.col(id_col).alias("doc_id"), leaf_digest([F.col(c) for c in columns]).alias("digest"), *[c.alias(n) for n, c in more.items()])
    leaves = _placed(rows, ["doc_id", "digest"])
    levels = height(leaves.agg(F.max("size")).first()[0] or 0)
    nodes = _grow(leaves, levels)
    tops = stored(_tops(leaves, nodes))
    # The sources' own tree; its leaves are their roots.
    upper = _placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"), F.col("level").alias("deep")), ["name"])
    rise = height(upper.agg(F.max("size")).first()[0] or 0)
    above = _grow(upper, rise)
    root = _tops(upper, above).withColumn("path", F.array().cast("array<array<string>>"))
    sources = stored(_paths(upper, above, root, rise))
    starts = sources.select(F.col("name").alias("tree"), F.col("deep").alias("level"), F.lit(0).cast("long").alias("place"), "path", F.concat_ws("/", "digest", "top").alias("top"))
    out = _paths(leaves, nodes, starts, levels)
    return out.select("doc_id", F.col("tree").alias("source"), F.col("digest").alias("leaf"), F.substring_index("top", "/", 1).alias("subroot"), F.substring_index("top", "/", -1).alias("root"), F.col("path").alias("proof"), *more)


def folded(proof: Column, leaf: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda have, run: F.sha2(F.call_function("array_join", run, F.lit(""), have), 256))


def siblings_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, left to right and upwards."""
    return F.sha2(F.array_join(F.flatten(proof), ""), 256)


def merkle_report(docs: DataFrame) -> DataFrame:
    """Manifest of ``documents`` and the check of copies whose line feeds were deleted where 2 divides the id's CRC-32.

    A null id has no CRC and its row is left as it is.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = leaf_digest([*[F.col(c) for c in LEAF_COLUMNS[:-1]], F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))])
    out = manifest(docs, also={"given": changed})
    out = out.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("proof"), F.col("given")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
