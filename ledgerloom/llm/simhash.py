"""Near-duplicate groups by SimHash, with BK-trees per shard.

A fingerprint has 64 bits; a bit is set if it is set in over half the hashes of
the text's shingles.  Fingerprints link within a Hamming radius of 4, and the
groups are the connected components.

Candidates: the 64 bits are cut into six bands.  Two fingerprints within four
bits of each other differ in at most four bands and so agree in two, hence each
different fingerprint goes to a shard for each pair of bands (15 copies of
eight bytes).  Shards that are too large for a task are dealt to finer ones by
the bits that they leave open, again by bands of which some must agree, so that
no task holds more than 2^18 fingerprints.  A shard's fingerprints form a BK-tree: a child hangs on its
parent by their distance, and a search follows only the edges within the radius
of its own distance.  The shards' trees are partitioned, not broadcast, since
fingerprints of all documents may not pass the driver and have no size bound.
A shard gives a link to each fingerprint's group in the shard, not its pairs.

Equal fingerprints are merged before, so hot copies cost one node.  Texts
without words (null, empty, blank) have fingerprint zero and link like others;
very long texts are hashed whole.  Repeated rows give a row each.  Ids may have
any type that has an order; a null id never is a component's smallest id unless
the component has no other.  Empty tables give no rows; the filtering forms
keep extra columns whatever their names.

``one_per_alike`` has another contract: texts link if their sets of five-word
shingles have a Jaccard similarity of 0.8 or more.  There two fingerprints of 64
bits differ in about ten bits, and no bands reach all of them short of all
pairs.  So it repeats the fingerprint eight times, under other hashes, and takes
its shards from samples of these 512 bits; three of the repeats form the points of
the shards' BK-trees, whose radius is that of the least similarity with room for
chance.  Samples are so many that by calculation two sets at 0.8 share a shard but
for two times in a million.  What a tree finds is a candidate; only texts whose
shingles, compared exactly, are that alike are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, lean_shuffles, stored

RADIUS = 4
#: Bands of 11, 11, 11, 11, 10 and 10 bits, as (shift, width).
BANDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Least Jaccard similarity of near copies in the pipeline, as a fraction.
ALIKE = (4, 5)
#: Rows and columns of the multipliers that make further hashes of one.
REPEATS, MINIMA = 24, 4
_ODD = np.random.default_rng(7).integers(0, 1 << 63, (REPEATS * MINIMA, 1), np.uint64) * np.uint64(2) + np.uint64(1)
#: Fingerprints of a shard that one task may hold; larger shards are dealt further.
MOST_IN_SHARD = 20_000
#: Repeated fingerprints of a text, and those of them that the trees of ``one_per_alike`` hold.
WIDTH, POINT = 8, 3
#: Bits in which two points may differ; alike ones differ in 31 of 192 at most on average, four shingles and five in 36 (deviation 5), unrelated ones in 96.
ALIKE_RADIUS = 58
#: Most that the bits of alike sets of six shingles and more differ, as a share (counted out for sets of each size), and the share of pairs at it that no sample of bits may bring together.
DIFFER, MISSED = 0.1611, 2e-6
#: Fingerprints a shard of ``one_per_alike`` should have on average, and samples of bits whose shards are made at once.
IN_SHARD, AT_ONCE = 256, 24
#: Candidates that are compared as one group; larger groups are compared shard by shard.
MOST_TOGETHER = 2_000
#: Bits of the map of candidate rows, at most.
MAP_BITS = 26


def _hashes(text: str | None, size: int) -> np.ndarray:
    """Hashes of word shingles; words are what ASCII white space separates, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - size + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[size - 1 :] if len(words) >= size else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(text: str | None, size: int = 4) -> int:
    """SimHash of word shingles; zero without words."""
    hashes = _hashes(text, size)
    n = len(hashes)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, size: int) -> Column:
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return F.pandas_udf(of, "long")(text)


class BKTree:
    """Fingerprints by Hamming distance: each child hangs on its parent by their distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while at != new:
            d = (value ^ self.values[at]).bit_count()
            at = self.children[at].setdefault(d, new)
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Places of values within the radius, following the edges that can lead there."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if kids:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids] if len(kids) > 2 * radius else [c for e, c in kids.items() if abs(e - d) <= radius]
        return found


def _bulk_groups(values: np.ndarray, radius: int, union: object) -> None:
    """BK-tree join of a large shard with itself: whole sets of searches walk the tree together."""
    # A node: its places (the first is the pivot), and the searches that reach it.
    todo = [(np.arange(len(values)), np.arange(len(values)))]
    while todo:
        members, asking = todo.pop()
        pivot = values[members[0]]
        apart = np.bitwise_count(values[asking] ^ pivot)
        for i in asking[apart <= radius]:
            union(int(members[0]), int(i))
        rest = members[1:]
        if not len(rest):
            continue
        edges = np.bitwise_count(values[rest] ^ pivot)
        for e in np.unique(edges):
            near = asking[(apart + radius >= e) & (apart <= int(e) + radius)]
            if len(near):
                todo.append((rest[edges == e], near))


def shard_links(values: list[int], radius: int = RADIUS, bulk: int = 64) -> list[tuple[int, int]]:
    """(value, another of its group) for each value of a shard that links to others."""
    up = list(range(len(values)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(i: int, j: int) -> None:
        i, j = root(i), root(j)
        if i != j:
            up[max(i, j)] = min(i, j)

    if len(values) > bulk:
        _bulk_groups(np.array(values, np.int64).view(np.uint64), radius, union)
    else:
        tree = BKTree()
        for i, v in enumerate(values):
            v &= 0xFFFFFFFFFFFFFFFF
            for j in tree.within(v, radius):
                union(i, j)
            tree.add(v)
    return [(values[i], values[r]) for i in range(len(values)) if (r := root(i)) != i]


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (shard, fp) rows to links; a shard may run over batches."""
    left: list[np.ndarray] = []
    for batch in batches:
        rows = batch[["shard", "fp"]].to_numpy(np.int64)
        if not len(rows):
            continue
        if left and rows[-1, 0] == left[0][0, 0]:  # still the same shard
            left.append(rows)
            continue
        rows = np.concatenate([*left, rows])
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        yield _of_rows(rows[:cut])
        left = [rows[cut:]]
    yield _of_rows(np.concatenate([np.empty((0, 2), np.int64), *left]))


def _of_rows(rows: np.ndarray) -> pd.DataFrame:
    found: list[tuple[int, int]] = []
    if len(rows):
        starts = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[0, 0] - 1))
        sizes = np.diff(starts, append=len(rows))
        for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            found += shard_links(rows[s : s + n, 1].tolist())
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def links(fps: DataFrame, most: int = MOST_IN_SHARD) -> DataFrame:
    """Different fingerprints (column ``fp``) to ``a, b`` links that span each group of links.

    Shards of more than ``most`` fingerprints are dealt to finer ones before any
    of them is gathered; the finest are bounded by the bits that are left.
    """
    keys = []
    for n, ((s, w), (t, v)) in enumerate(combinations(BANDS, 2)):
        part = lambda shift, width: F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(F.lit(n << 22).cast("long").bitwiseOR(F.shiftleft(part(s, w), v)).bitwiseOR(part(t, v)))
    shards = fps.select("fp", F.explode(F.array(*keys)).alias("shard")).select("shard", "fp")
    kind, found = "shard long, fp long, rest long", []
    for level, (widths, agree) in enumerate((*FINER, (None, 0))):
        large = stored(shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("shard")) if widths else None
        if large is None or large.isEmpty():
            found.append(shards)
            break
        found.append(shards.join(large, "shard", "left_anti"))
        shards = stored(shards.join(large, "shard", "left_semi").mapInPandas(partial(_finer, level=level, widths=widths, agree=agree), kind))
    every = reduce(DataFrame.unionByName, (x.select("shard", "fp") for x in found))
    return every.repartition("shard").sortWithinPartitions("shard", "fp").mapInPandas(_links, "a long, b long").distinct()


#: How the bits that a shard leaves open are cut further: widths of bands, and how many of them must agree within four bits.
FINER = (((7, 7, 6, 6, 6, 6, 6), 3), ((5, 5, 4, 4, 4, 4), 2))


def _packed(values: np.ndarray, bands: list[tuple[int, int]]) -> np.ndarray:
    """The bits of some bands, (shift, width) each, side by side."""
    out = np.zeros(len(values), np.uint64)
    for shift, width in bands:
        out = (out << np.uint64(width)) | ((values >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def _finer(batches: Iterator[pd.DataFrame], level: int, widths: tuple[int, ...], agree: int) -> Iterator[pd.DataFrame]:
    """Rows of large shards to finer shards; those of the first level leave the bits of all but two bands open."""
    bands = list(zip(np.cumsum((0, *widths[:-1])).tolist(), widths, strict=True))
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.iloc[at : at + 2000]
            fp, shard = (part[c].to_numpy(np.int64).view(np.uint64) for c in ("fp", "shard"))
            if level:
                rest = part["rest"].to_numpy(np.int64).view(np.uint64)
            else:
                rest = np.zeros(len(part), np.uint64)
                for n, pair in enumerate(combinations(BANDS, 2)):
                    mine = (shard >> np.uint64(22)) == n
                    rest[mine] = _packed(fp[mine], [x for x in BANDS if x not in pair])
            for k, some in enumerate(combinations(bands, agree)):
                # Shards that meet by chance are compared for nothing; none is lost.
                with np.errstate(over="ignore"):
                    key = ((shard * _ODD[0] + np.uint64(k)) * _ODD[1] + _packed(rest, list(some))) * _ODD[2]
                left = _packed(rest, [x for x in bands if x not in some])
                yield pd.DataFrame({"shard": (key ^ (key >> np.uint64(29))).view(np.int64), "fp": fp.view(np.int64), "rest": left.view(np.int64)})


#: Parts into which a node's edges are dealt where its minimum is joined to them.
SALTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``a, b`` edges with ``m`` of their ``a``; the edges of a hot node go to several tasks."""
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")
    copies = least.select("a", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return edges.select("a", "b", salt).join(copies, ["a", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """Undirected ``a, b`` edges to ``node, root``: the smallest node of each node's component.

    Alternates large-star and small-star rounds, each a grouped minimum joined
    back, until no edge changes; each round's edges are written out.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _with_least(both.filter("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Now a > b always: of each node's smaller neighbours and itself, all but the least point to the least.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, low).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        small = small.filter("a <> b").distinct()
        # Rounds add no edges, so the last count tells how many tasks, and files, this one needs.
        edges = stored(small if seen is None else small.coalesce(max(1, -(-seen[0] // 10_000))))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def _roots(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp`` rows with other columns, one per fingerprint, with the ``root`` of their component."""
    roots = components(edges)
    return stored(ids.join(roots, ids.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node"))


def grouped(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``component_id``, its group's smallest id."""
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), size).alias("fp")))
    ids = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    groups = _roots(ids, links(ids.select("fp")))
    least = groups.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = groups.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


#: The bits of a byte as eight bytes, so that sums of up to 255 count each bit.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").view(np.uint64).ravel()


def repeated(hashes: np.ndarray) -> np.ndarray:
    """``WIDTH`` fingerprints of a set of hashes, each under other hashes made of these."""
    first, second = _ODD[:WIDTH, 0], _ODD[WIDTH : 2 * WIDTH, 0]
    bits = np.zeros(64 * WIDTH, np.int64)
    for at in range(0, len(hashes), 255):
        z = hashes[at : at + 255, None] * first
        z = (z ^ (z >> np.uint64(32))) * second
        z ^= z >> np.uint64(29)
        bits += _SPREAD[z.view(np.uint8)].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)


def sketches(text: Column, size: int) -> Column:
    """``fp``, a hash of a text's set of shingles, and its repeated fingerprints; none without words."""

    def of(texts: pd.Series) -> pd.DataFrame:
        fps, prints = [], []
        for t in texts:
            have = np.unique(_hashes(t, size))
            fps.append(xxhash.xxh64_intdigest(have.tobytes()) if len(have) else 0)
            prints.append(repeated(have).view(np.int64) if len(have) else np.empty(0, np.int64))
        return pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64), "prints": prints})

    return F.pandas_udf(of, "fp long, prints array<long>")(text)


def samples(n: int) -> np.ndarray:
    """Samples of the repeated fingerprints' bits, a row each, for ``n`` texts: the more texts, the longer and the more of them."""
    width = max(10, int(np.ceil(np.log2(max(1, n) / IN_SHARD))))
    many = int(np.ceil(np.log(MISSED) / np.log1p(-((1 - DIFFER) ** width))))
    r = np.random.default_rng(11)
    return np.array([r.permutation(64 * WIDTH)[:width] for _ in range(many)])


def sampled(prints: np.ndarray, bits: np.ndarray, first: int = 0) -> np.ndarray:
    """Shards of texts (rows of ``prints``): one for each sample of bits, numbered from ``first``."""
    shards = np.empty((len(bits), len(prints)), np.uint64)
    for n, some in enumerate(bits):
        key = np.full(len(prints), first + n, np.uint64)
        for bit in some.tolist():
            key = (key << np.uint64(1)) | ((prints[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1))
        shards[n] = key
    return shards


def _to_shards(batches: Iterator[pd.DataFrame], bits: np.ndarray, first: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            prints, fp = np.array(batch["prints"].tolist(), np.int64).view(np.uint64), batch["fp"].to_numpy(np.int64)
            points = {f"p{i}": prints[:, i].view(np.int64) for i in range(POINT)}
            for shard in sampled(prints, bits, first):
                yield pd.DataFrame({"shard": shard.view(np.int64), "fp": fp, **points})


def tree_groups(points: np.ndarray, radius: int, leaf: int = 32) -> np.ndarray:
    """BK-tree join of a shard's points (rows of 64-bit words) with itself: the number of each one's group, its first member.

    Whole sets of searches walk the tree together; a subtree of ``leaf`` points or
    fewer is held against its searches at once.  Points of a subtree that are all
    of one group already are no more searched for by that group.
    """
    group = np.arange(len(points))
    words = [np.ascontiguousarray(points[:, i]) for i in range(points.shape[1])]

    def apart_of(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        return reduce(np.add, (np.bitwise_count(w[a] ^ w[b]).astype(np.int16) for w in words))

    def meet(places: np.ndarray) -> None:
        found = np.unique(group[places])
        if len(found) > 1:
            group[np.isin(group, found)] = found[0]

    todo = [(np.arange(len(points)), np.arange(len(points)))]
    while todo:
        members, asking = todo.pop()
        mine = group[members[0]]
        if (group[members] == mine).all():
            asking = asking[group[asking] != mine]
        if not len(asking):
            continue
        if len(members) <= leaf:
            close = (apart_of(members[:, None], asking) <= radius) & (group[members, None] != group[asking])
            for i in np.flatnonzero(close.any(axis=1)).tolist():
                meet(np.append(asking[close[i]], members[i]))
            continue
        # The first point is the pivot, the others hang on it by their distance.
        apart = apart_of(members[0], asking)
        meet(np.append(asking[apart <= radius], members[0]))
        rest = members[1:]
        edges = apart_of(members[0], rest)
        for e in np.unique(edges).tolist():
            near = asking[(apart + radius >= e) & (apart <= e + radius)]
            if len(near):
                todo.append((rest[edges == e], near))
    return group


def _met(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Sorted shards to the groups of several that their trees find; a shard may run over batches."""
    names = ["shard", "fp", *(f"p{i}" for i in range(POINT))]
    left: list[np.ndarray] = []
    for batch in batches:
        rows = batch[names].to_numpy(np.int64)
        if not len(rows):
            continue
        if left and rows[-1, 0] == left[0][0, 0]:  # still the same shard
            left.append(rows)
            continue
        rows = np.concatenate([*left, rows])
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        yield _groups_of_rows(rows[:cut], radius)
        left = [rows[cut:]]
    yield _groups_of_rows(np.concatenate([np.empty((0, len(names)), np.int64), *left]), radius)


def _groups_of_rows(rows: np.ndarray, radius: int) -> pd.DataFrame:
    found: list[np.ndarray] = []
    if len(rows):
        starts = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[0, 0] - 1))
        sizes = np.diff(starts, append=len(rows))
        for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            group = tree_groups(np.ascontiguousarray(rows[s : s + n, 2:]).view(np.uint64), radius)
            for g in np.flatnonzero(np.bincount(group, minlength=n) > 1).tolist():
                found.append(np.sort(rows[s : s + n, 1][group == g]))
    return pd.DataFrame({"fps": pd.Series(found, dtype=object)})


def spanning(met: DataFrame) -> DataFrame:
    """Groups (sorted ``fps``) to ``a, b`` edges that connect what they connect: one for each member, and those between first members.

    A member of many groups is tied to the least of their first members, and these
    to each other, so a large family that many shards find in part has few edges.
    """
    firsts = met.select(F.explode("fps").alias("a"), F.element_at("fps", 1).alias("b")).groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("bs"))
    least = F.element_at("bs", 1).alias("b")
    return firsts.select("a", least).unionByName(firsts.filter(F.size("bs") > 1).select(F.explode("bs").alias("a"), least)).filter("a <> b").distinct()


def candidates(ids: DataFrame, radius: int = ALIKE_RADIUS) -> DataFrame:
    """``fp, prints`` rows, one per fingerprint, to ``bucket, fp``: groups in which all pairs are that share a shard and are close in its tree."""
    asked = ids.select("fp", "prints").filter(F.size("prints") > 0)
    bits = samples(asked.count())
    points = ", ".join(f"p{i} long" for i in range(POINT))
    rounds = []
    with lean_shuffles(ids.sparkSession):
        for at in range(0, len(bits), AT_ONCE):
            shards = asked.mapInPandas(partial(_to_shards, bits=bits[at : at + AT_ONCE], first=at), f"shard long, fp long, {points}")
            rounds.append(stored(shards.repartition("shard").sortWithinPartitions("shard").mapInPandas(partial(_met, radius=radius), "fps array<long>").distinct()))
        met = stored(reduce(DataFrame.unionByName, rounds).distinct())
    # Groups of several shards that overlap are compared as one, unless that is too large for a task.
    roots = components(spanning(met))
    named = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    large = named.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_TOGETHER).select("root")
    small = named.join(large, "root", "left_anti").select(F.col("root").alias("bucket"), F.col("node").alias("fp"))
    by_shard = met.withColumn("node", F.element_at("fps", 1)).join(named.join(large, "root", "left_semi"), "node")
    return small.unionByName(by_shard.select(F.xxhash64("fps").alias("bucket"), F.explode("fps").alias("fp")))


def shingle_sets(text: Column, size: int) -> Column:
    """A text's different shingles as sorted hashes of eight bytes."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_hashes(t, size)).tobytes() for t in texts], dtype=object)

    return F.pandas_udf(of, "binary")(text)


def set_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(place, another of its group) that span the groups of sets with Jaccard similarity of ``ALIKE`` or more.

    One minus the similarity is a metric.  Pivots are taken until each set is
    within the radius of one, and a link between two sets then leads to a set
    within twice the radius of a pivot; only those are held against the pivot's
    own, until one links.  So no link that joins two groups is missed.
    """
    num, den = ALIKE
    up = list(range(len(sets)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(i: int, j: int) -> None:
        i, j = root(i), root(j)
        if i != j:
            up[max(i, j)] = min(i, j)

    sizes = np.array([len(x) for x in sets])
    every, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(len(every), np.int64)

    def common(i: int, others: np.ndarray | None = None) -> np.ndarray:
        """Shingles that a set shares with all sets, or with others."""
        mine = codes[starts[i] : ends[i]]
        mark[mine] = 1
        if others is None:
            got = np.add.reduceat(mark[codes], starts)
        else:
            got = np.array([mark[codes[starts[j] : ends[j]]].sum() for j in others])
        mark[mine] = 0
        return got

    free = np.ones(len(sets), bool)
    for i in range(len(sets)):
        if not free[i]:
            continue
        both = common(i)
        all_of = sizes + sizes[i] - both
        own = np.flatnonzero(den * both >= num * all_of)
        free[own] = False
        for j in own.tolist():
            union(i, j)
        # Within twice the radius: similarity of at least 2 * num / den - 1.
        near = np.flatnonzero((den * both < num * all_of) & (den * both >= (2 * num - den) * all_of))
        for j in near.tolist():
            at, step = 0, 16
            while root(j) != root(i) and at < len(own):
                some = own[at : at + step]
                shared = common(j, some)
                hits = some[den * shared >= num * (sizes[some] + sizes[j] - shared)]
                if len(hits):
                    union(j, int(hits[0]))
                at, step = at + step, 2 * step
    return [(i, r) for i in range(len(sets)) if (r := root(i)) != i]


def _row_map(rows: DataFrame, n: int, row: str) -> Column:
    """Whether column ``row`` may be one of ``n`` rows: a bit map of bounded size, which spares others a shuffle."""
    bits = min(MAP_BITS, max(10, int(32 * n).bit_length()))
    place = F.col("row").bitwiseAND(F.lit((1 << bits) - 1))
    words = rows.groupBy(F.shiftright(place, 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(row & 31 as int))")).alias("v")).toPandas()
    have = np.zeros(1 << (bits - 5), np.int64)
    have[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(have.astype(np.uint32))

    def of(row: pd.Series) -> pd.Series:
        x = row.to_numpy(np.int64)
        at = x & ((1 << bits) - 1)
        return pd.Series(((shared.value[at >> 5] >> (x & 31).astype(np.uint32)) & 1) == 1)

    return F.pandas_udf(of, "boolean")(F.col(row))


def alike_links(docs: DataFrame, ids: DataFrame, size: int, text_col: str, row: str, radius: int) -> DataFrame:
    """``fp, prints, first`` rows, and ``docs`` with ``row``, to ``a, b`` links that span the groups of near copies."""
    asked = stored(candidates(ids, radius))
    rows = stored(asked.select("fp").distinct().join(ids, "fp").select("fp", F.col("first.row").alias("row")))
    some = docs.filter(_row_map(rows, rows.count(), row)).select(F.col(row).alias("own"), F.col(text_col).alias("text"))
    texts = some.join(rows, some["own"] == rows["row"]).groupBy("fp").agg(F.min("text").alias("text"))
    sets = stored(texts.select("fp", shingle_sets(F.col("text"), size).alias("set")))

    def of(group: pd.DataFrame) -> pd.DataFrame:
        fps = group["fp"].tolist()
        found = set_links([np.frombuffer(x, np.uint64) for x in group["set"]])
        return pd.DataFrame([(fps[i], fps[j]) for i, j in found], columns=["a", "b"], dtype="int64")

    return asked.join(sets, "fp").groupBy("bucket").applyInPandas(of, "a long, b long").distinct()


def _firsts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, Column]:
    """``docs`` with a hash of id and text, the name of that column, and what orders rows by their id."""
    row = fresh("row")
    docs = docs.withColumn(row, F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col)))
    return docs, row, F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row"))


def _one_of_each(docs: DataFrame, row: str, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of its smallest id."""
    stay = groups.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    # Rows that are equal in id and text share ``row``; all but one of them go before they meet.
    own = [c for c in docs.columns if c != row]
    once = docs.groupBy(row).agg(*[F.first(f"`{c}`").alias(c) for c in own])
    return once.join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in own])


def one_per_group(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of fingerprints within the radius: that of its smallest id."""
    docs, row, first = _firsts(docs, id_col, text_col)
    rows = stored(docs.select(first.alias("first"), fingerprints(F.col(text_col), size).alias("fp")))
    ids = stored(rows.groupBy("fp").agg(F.min("first").alias("first")))
    return _one_of_each(docs, row, _roots(ids, links(ids.select("fp"))))


def one_per_alike(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text", radius: int = ALIKE_RADIUS) -> DataFrame:
    """``docs`` with one row of each group of texts that are ``ALIKE``: that of its smallest id."""
    docs, row, first = _firsts(docs, id_col, text_col)
    rows = stored(docs.select(first.alias("first"), sketches(F.col(text_col), size).alias("s")).select("first", "s.fp", "s.prints"))
    ids = stored(rows.groupBy("fp").agg(F.min("first").alias("first"), F.any_value("prints").alias("prints")))
    return _one_of_each(docs, row, _roots(ids.drop("prints"), alike_links(docs, ids, size, text_col, row, radius)))


def simhash_report(docs: DataFrame, **cols: str) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of each document."""
    return grouped(docs, 4, **cols).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
