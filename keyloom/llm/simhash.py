"""SimHash near-duplicates: 64-bit fingerprints linked by Hamming distance through vantage-point trees.

Equal fingerprints become one point first, so a group of copies never meets itself. A vantage-point tree fitted on a
bounded sample (`sample_points`) cuts the points into shards: a node keeps points nearer to its vantage point than its
radius in the inner branch and the rest in the outer one. By the triangle bound two linked points on different sides
have distances within `distance` of the radius, so only inner points in that boundary shell are copied to the outer
branch; every pair then meets in a shard. Shards cut their points by the same rule down to small leaves, and leaves
compare their points in blocks. A shard hands on a spanning forest of its links, never the pairs themselves, and
connected components join the forests.

Only the sample is bounded and only the tree's shape depends on it; every point is looked up, and the pairs are exact.

Texts of similar shingle sets (`similar_texts`, `one_of_each`). At a Jaccard similarity of 0.8 fingerprints differ in 15 %
of their bits, where no tree over all points prunes anything. Points there are fingerprints of 512 bits, and the first
partition are shards by minima of the shingles' hashes: a text lies in `BANDS` shards, each of the least values of
`ROWS` hash functions, and two texts of similarity s share one with probability 1 - (1 - s**ROWS)**BANDS (0.985 at 0.8).
Inside a shard, points are peeled off around vantage points: all within the radius of one are linked to it, and by the
triangle bound those of them that no point outside can reach leave with it. A shard of over `CELL` points is peeled by
joins first, its vantage point being the medoid of 64 of its points; what its boundary shell and the points outside
have to compare is dealt to tasks as pairs of blocks. Links within shards are exact.

Defined results. Null and empty texts have no words and fingerprint zero, linked like any other. Texts of fewer words
than a shingle are one shingle. Ties (exactly half of the shingles) give bit 0. Repeated rows are copies. Documents
with a null id have a fingerprint and belong to their component, whose id is its smallest non-null id. Empty tables
give empty results. Very long texts are hashed whole. Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm._shared import small_batches, spare_name, written
from keyloom.llm.components import components

BITS = 64
LEAF = 2048  # points compared whole
WORTH = 0.92  # a cut must leave at most this share of the comparisons

WIDE = 8  # longs of a wide fingerprint
BANDS, ROWS = 8, 4  # shards of a text, and hash functions whose minima name a shard
CELL = 2048  # points that one task compares at a time
PEELS = 4  # rounds in which large shards are peeled before the rest is dealt as pairs of blocks
MEDOID_OF = 64
KEPT_WORDS = 400_000  # word hashes that a task keeps; it forgets them all beyond that


# ---- fingerprints ---------------------------------------------------------------------------------------------------


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash values of the k-th fingerprint: the hashes themselves for 0, else as good as another seed's."""
    if k == 0:
        return hashes
    x = hashes * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42, count: int = 1) -> list[int]:
    """SimHashes of ASCII-lower-cased, white-space-separated words' shingles (repeats included); 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return [0] * count
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n == 1:
        hashes = np.array([digest(joined, seed)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[:n].tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    out = []
    for k in range(count):
        counts = np.zeros(BITS, np.int64)
        for at in range(0, n, 1 << 16):
            some = remixed(hashes[at : at + (1 << 16)], k)
            counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0]))
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, count: int = 1) -> DataFrame:
    """(doc_id, fp, fp_1, ...): fingerprints as signed longs."""
    small_batches(docs)
    names = ["fp", *(f"fp_{k}" for k in range(1, count))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed, count) for t in batch.column(1)], np.uint64).reshape(-1, count)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(count))], names=["doc_id", *names])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} long" for n in names)]))


# ---- vantage-point trees --------------------------------------------------------------------------------------------


def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def best_cut(points: np.ndarray, reach: int, rng: np.random.Generator, tries: int = 6) -> tuple[np.uint64, int] | None:
    """Vantage point and radius that leave the fewest comparisons, a side's copies included; None if no cut pays.

    A cut pays if the squares of both sides' sizes sum to less than WORTH of the whole's. On random 64-bit points the
    best cut leaves 0.71 of them at a reach of 2, 0.79 at 3 and none pays from 5 on: there, points would be compared whole.
    """
    best, found = WORTH * len(points) ** 2, None
    for vp in rng.choice(points, min(tries, len(points)), replace=False):
        below = np.concatenate([[0], np.cumsum(np.bincount(distances(points, vp), minlength=BITS + 1))])  # nearer than r
        radii = np.arange(1, BITS + 1)
        inner = below[radii]
        outer = len(points) - below[np.maximum(radii - reach, 0)]
        cost = np.where((inner > 0) & (inner < len(points)), inner.astype(float) ** 2 + outer.astype(float) ** 2, np.inf)
        k = int(cost.argmin())
        if cost[k] < best:
            best, found = cost[k], (vp, int(radii[k]))
    return found


class VantageTree:
    """Shard numbers of points: inner branches own a point, outer branches also get the boundary shell's copies."""

    def __init__(self, sample: np.ndarray, shard_points: float, reach: int) -> None:
        self.reach = reach
        self.nodes: list[tuple[np.uint64, int, int, int] | None] = []
        self.rng = np.random.default_rng(7)
        self._grow(sample, shard_points)

    def _grow(self, points: np.ndarray, most: float) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        cut = best_cut(points, self.reach, self.rng) if len(points) > max(most, 16) else None
        if cut:
            d = distances(points, cut[0])
            inner = self._grow(points[d < cut[1]], most)
            outer = self._grow(points[d >= cut[1] - self.reach], most)
            self.nodes[at] = (*cut, inner, outer)
        return at

    def shards(self, points: np.ndarray, rows: np.ndarray | None = None, at: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, positions of the points it gets)."""
        rows = np.arange(len(points)) if rows is None else rows
        node = self.nodes[at]
        if node is None:
            if len(rows):
                yield at, rows
            return
        vp, radius, inner, outer = node
        d = distances(points[rows], vp)
        yield from self.shards(points, rows[d < radius], inner)
        yield from self.shards(points, rows[d >= radius - self.reach], outer)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_leaf(points: np.ndarray, rows: np.ndarray, reach: int, forest: Forest, block: int = 512) -> None:
    """Compare all points of a leaf, block by block."""
    for i in range(0, len(rows), block):
        a = points[rows[i : i + block]]
        for j in range(i, len(rows), block):
            near = np.bitwise_count(a[:, None] ^ points[rows[j : j + block]][None, :]) <= reach
            for x, y in zip(*np.nonzero(np.triu(near, 1) if i == j else near), strict=True):
                forest.join(int(rows[i + x]), int(rows[j + y]))


def link_points(points: np.ndarray, reach: int) -> Forest:
    """The links of distinct points within reach, by recursive vantage cuts; a set that no cut helps is compared whole."""
    forest = Forest(len(points))
    rng = np.random.default_rng(11)
    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        sample = points[rows] if len(rows) <= 4096 else points[rng.choice(rows, 4096, replace=False)]
        cut = best_cut(sample, reach, rng) if len(rows) > LEAF else None
        if cut is None:
            link_leaf(points, rows, reach, forest)
            continue
        d = distances(points[rows], cut[0])
        todo += [rows[d < cut[1]], rows[d >= cut[1] - reach]]
    return forest


# ---- the operator ---------------------------------------------------------------------------------------------------


def links(points: DataFrame, distance: int = 2, *, shard_points: int = 8192, sample_points: int = 16384) -> DataFrame:
    """points (fp, distinct) -> (a, b): a spanning forest of each shard's links within distance."""
    total = points.count()
    order = F.xxhash64("fp", F.lit(1))
    share = min(1.0, 2.0 * sample_points / max(1, total))
    picked = points.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(order).limit(sample_points)
    sample = np.array([r["fp"] for r in picked.collect()], np.int64).view(np.uint64)
    tree = points.sparkSession.sparkContext.broadcast(VantageTree(sample, shard_points * len(sample) / max(1, total), distance))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            for shard, rows in tree.value.shards(fps):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int32)), pa.array(fps[rows].view(np.int64))], names=["shard", "fp"])

    def link(shard: tuple, batches: pa.Table) -> pa.Table:
        points = batches.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        forest = link_points(points, distance)
        root = np.fromiter((forest.find(k) for k in range(len(points))), np.int64, len(points))
        moved = np.flatnonzero(root != np.arange(len(points)))
        return pa.table({"a": points[root[moved]].view(np.int64), "b": points[moved].view(np.int64)})

    dealt = points.select("fp").mapInArrow(deal, "shard int, fp long")
    return dealt.groupBy("shard").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 2, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; linked if their fingerprints are within distance."""
    marked = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    points = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    roots = components(links(points, distance))
    named = points.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least_id = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.join(least_id, "root").select(F.col("fp").alias("point"), "component_id")
    return marked.join(classes, F.col("fp") == F.col("point")).select("doc_id", "fp", "component_id")


# ---- texts of similar shingle sets ----------------------------------------------------------------------------------


def radius_of(similarity: float) -> int:
    """Bits in which wide fingerprints of sets of that Jaccard similarity differ at most, for 93 % of such pairs."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = BITS * WIDE
    return int(bits * share + 1.5 * math.sqrt(bits * share * (1 - share)))


class WordHashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


_ODD = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS + 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: list[bytes], shingle: int, known: WordHashes) -> np.ndarray:
    """Distinct hashes of the runs of `shingle` words; of the whole sequence if it is shorter."""
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = _mixed(total + each[k : k + n] * _ODD[k % len(_ODD)])
    return np.unique(total)


def wide_sketch(text: bytes | None, shingle: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(wide fingerprint, shards) of a text's set of shingles; zeros and one shard without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(WIDE, np.uint64), np.zeros(1, np.int64)
    hashes = shingle_hashes(words, shingle, known)
    counts, least = np.zeros(BITS * WIDE, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4080):
        some = hashes[at : at + 4080]
        np.minimum(least, (_ODD[: BANDS * ROWS, None] * some).min(axis=1), out=least)
        spread = np.stack([remixed(some, k) for k in range(WIDE)], axis=1)
        bits = np.unpackbits(spread.view(np.uint8), axis=1, bitorder="little")
        for row in range(0, len(some), 255):
            counts += bits[row : row + 255].sum(axis=0, dtype=np.uint8)
    fp = np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * _ODD[k] + least.reshape(BANDS, ROWS)[:, k])
    return fp, key.view(np.int64)


def wide_sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, node, fp, shards): node is 128 bits of the wide fingerprint."""
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            fps, shards = [], []
            for t in batch.column(1):
                fp, keys = wide_sketch(t.as_py(), shingle, known)
                fps.append(fp.tobytes())
                shards.append(keys)
                if len(known) > KEPT_WORDS:
                    known.clear()
            nodes = [xxhash.xxh3_128_digest(fp) for fp in fps]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(fps, pa.binary()), pa.array(shards, pa.list_(pa.int64()))], names=["doc_id", "node", "fp", "shards"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, node binary, fp binary, shards array<long>")


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column without nulls whose values all have that width."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + width * len(column)].reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)


def wide_distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ to).sum(axis=-1, dtype=np.int64)


def linked_labels(points: np.ndarray, side: np.ndarray, reach: int) -> np.ndarray:
    """A label for each point, equal where links within reach connect points. Points of sides 1 and 2 are compared with the
    other side only, those of side 0 with all."""
    labels = np.arange(len(points))

    def join(v: int, near: np.ndarray) -> None:
        found = np.unique(np.append(labels[near], labels[v]))
        if len(found) > 1:
            labels[np.isin(labels, found)] = found[0]

    if side.any():
        one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        if len(one) > len(two):
            one, two = two, one
        for v in one if len(two) else ():
            join(int(v), two[wide_distances(points[two], points[v]) <= reach])
        return labels
    todo = np.arange(len(points))
    while len(todo) > 1:
        v, rest = int(todo[0]), todo[1:]
        d = wide_distances(points[rest], points[v])
        inside = d <= reach
        if inside.any():
            join(v, rest[inside])
        outside = ~inside
        if not outside.any():
            break
        todo = rest[outside | (d >= d[outside].min() - reach)]
    return labels


def cell_links(cells: DataFrame, reach: int) -> DataFrame:
    """cells (shard, part, side, node, fp), at most a few thousand rows of equal (shard, part) -> (a, b): spanning forests."""
    small_batches(cells)
    dealt = cells.repartition(F.col("shard"), F.col("part")).sortWithinPartitions("shard", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] | None = None
        for batch in batches:
            new = [*(batch.column(k).to_numpy() for k in range(3)), fixed(batch.column(3), 16), fixed(batch.column(4), 8 * WIDE)]
            tail = new if tail is None else [np.concatenate(x) for x in zip(tail, new, strict=True)]
            if out := forests(tail, False):
                yield out
        if tail is not None and (out := forests(tail, True)):
            yield out

    def forests(held: list[np.ndarray], last: bool) -> pa.RecordBatch | None:
        """Links of all whole cells held; the open one stays held."""
        shard, part, side, node, fp = held
        starts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])])) if len(shard) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(shard))
        if not last and len(starts):
            starts, ends = starts[:-1], ends[:-1]
        points = np.ascontiguousarray(fp).view(np.uint64)
        a, b = [], []
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            labels = linked_labels(points[s:e], side[s:e], reach)
            moved = np.flatnonzero(labels != np.arange(e - s))
            a += [node[s + k].tobytes() for k in labels[moved]]
            b += [node[s + k].tobytes() for k in moved]
        if not last and len(ends):
            held[:] = [x[ends[-1] :] for x in held]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"]) if a else None

    return dealt.mapInArrow(run, "a binary, b binary")


def _medoids(members: DataFrame) -> DataFrame:
    """(shard, v, v_fp): of MEDOID_OF points of each shard, in the order of a hash, the one nearest to them all."""
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("node"), "node"))
    some = members.select("shard", "node", "fp", rank.alias("k")).filter(F.col("k") <= MEDOID_OF)

    def pick(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        points = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE)
        best = int(wide_distances(points[:, None, :], points[None, :, :]).sum(axis=1).argmin())
        return pa.table({"shard": rows.column("shard")[:1], "v": rows.column("node")[best : best + 1], "v_fp": rows.column("fp")[best : best + 1]})

    return some.groupBy("shard").applyInArrow(pick, "shard long, v binary, v_fp binary")


def _measured(members: DataFrame) -> DataFrame:
    """members (shard, node, fp, n, v, v_fp) -> (shard, node, fp, n, v, d): distances to the vantage point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = wide_distances(fixed(batch.column(2), 8 * WIDE).copy().view(np.uint64), fixed(batch.column(5), 8 * WIDE).copy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(d.astype(np.int32))], names=["shard", "node", "fp", "n", "v", "d"])

    return members.select("shard", "node", "fp", "n", "v", "v_fp").mapInArrow(run, "shard long, node binary, fp binary, n long, v binary, d int")


def _block_pairs(rest: DataFrame, cell: int, far_pairs: bool) -> DataFrame:
    """Cells for the pairs of the boundary shell with the points outside, and of these among themselves if asked for.

    rest (shard, node, fp, far, n_far, n_near): blocks of both kinds hold half a cell; a shell's point meets every block
    of the outside, so no task gets more than a cell of a shard.
    """
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(cell / 2))).cast("long")
    own = F.pmod(F.xxhash64(F.lit("block"), "node"), F.when(F.col("far"), blocks("n_far")).otherwise(blocks("n_near")))
    rows = rest.withColumn("own", own)
    part = lambda kind, x, y: (x * F.lit(1 << 30) + y) * 2 + kind + 1
    entry = lambda p, side: F.struct(p.cast("long").alias("part"), side.cast("int").alias("side"))
    ids = lambda n: F.sequence(F.lit(0).cast("long"), blocks(n) - 1)
    near = F.transform(ids("n_far"), lambda y: entry(part(0, F.col("own"), y), F.lit(1)))
    shell = F.when(F.col("n_near") > 0, F.transform(ids("n_near"), lambda x: entry(part(0, x, F.col("own")), F.lit(2)))).otherwise(F.array().cast("array<struct<part:long,side:int>>"))
    side = lambda y: F.when(y == F.col("own"), 0).when(y > F.col("own"), 1).otherwise(2)
    among = F.transform(ids("n_far"), lambda y: entry(part(1, F.least("own", y), F.greatest("own", y)), side(y)))
    cells = F.when(F.col("far"), F.concat(shell, among) if far_pairs else shell).otherwise(near)
    return rows.select("shard", "node", "fp", F.explode(cells).alias("to")).select("shard", "to.part", "to.side", "node", "fp")


def wide_links(points: DataFrame, reach: int, cell: int = CELL) -> DataFrame:
    """points (node, fp, shards), nodes distinct -> (a, b): links that connect all points of a shard that are within reach."""
    members = points.select(F.explode("shards").alias("shard"), "node", "fp")
    hot = written(points.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > cell), "hot-shards")
    whole = lambda m: m.select("shard", F.lit(0).cast("long").alias("part"), F.lit(0).alias("side"), "node", "fp")
    if hot.isEmpty():
        return cell_links(whole(members), reach)
    edges = cell_links(whole(members.join(hot, "shard", "left_anti")), reach)
    inside = members.join(hot, "shard")
    for k in range(PEELS):
        inside = written(inside, "hot-members")
        seen = written(_measured(inside.join(written(_medoids(inside), "medoids"), "shard")).filter("node <> v"), "measured")
        far = F.col("d") > reach
        edges = edges.unionAll(seen.filter(~far).select(F.col("v").alias("a"), F.col("node").alias("b")))
        counts = written(seen.groupBy("shard").agg(F.min(F.when(far, F.col("d"))).alias("next"), F.count_if(far).alias("n_far")).filter("n_far > 0"), "shard-counts")
        shell = ~far & (F.col("d") >= F.col("next") - reach)
        near = seen.join(counts, "shard").groupBy("shard").agg(F.first("next").alias("next"), F.first("n_far").alias("n_far"), F.count_if(shell).alias("n_near"))
        rest = seen.join(written(near, "shard-counts"), "shard").filter(far | shell).withColumn("far", far)
        last = k + 1 == PEELS
        edges = edges.unionAll(cell_links(_block_pairs(rest, cell, last), reach))
        if last:
            break
        outside = rest.filter("far").select(F.xxhash64("shard", F.lit(k)).alias("shard"), "node", "fp", F.col("n_far").alias("n"))
        edges = edges.unionAll(cell_links(whole(outside.filter(F.col("n") <= cell)), reach))
        inside = outside.filter(F.col("n") > cell)
        if inside.isEmpty():
            break
    return edges


def _wide_components(marked: DataFrame, similarity: float) -> DataFrame:
    """marked (doc_id, node, fp, shards) -> (node, component_id)."""
    points = written(marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.min("shards").alias("shards")), "points")
    roots = components(wide_links(points, radius_of(similarity)))
    named = points.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(least, "root").select("node", "component_id")


def similar_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, node, component_id) for every row of docs: components of texts whose shingle sets are similar."""
    marked = written(wide_sketches(docs, doc_id, text, shingle), "sketches")
    return marked.select("doc_id", "node").join(_wide_components(marked, similarity), "node").select("doc_id", "node", "component_id")


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents whose id is the least of their group of similar texts; documents with a null id stay, repeated rows
    stay together. Columns of docs are kept as they are, whatever their names."""
    marked = written(wide_sketches(docs, doc_id, text, shingle), "sketches")
    kept = _wide_components(marked, similarity).select(F.col("component_id").alias("doc_id")).distinct()
    gone = marked.filter("doc_id IS NOT NULL").select("doc_id").distinct().join(kept, "doc_id", "left_anti")
    own = spare_name(docs, "gone")
    return docs.join(gone.withColumnRenamed("doc_id", own), F.col(doc_id) == F.col(own), "left_anti")


def hex_of(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
