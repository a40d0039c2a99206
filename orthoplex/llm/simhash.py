"""SimHash near-duplicates linked exactly through vantage-point trees.

Fingerprints: 64 majority bits over the XXH64 (seed 42) of all 3-word shingles.
Equal fingerprints are merged first, so exact copies cost one row.  The distinct
ones are partitioned by Hamming distance: a vantage-point tree built on a bounded
sample sends each fingerprint to the inner or outer shard of every vantage point,
and those within reach of a boundary to both (triangle inequality), so each pair
at ``distance`` or less meets in some shard.  A shard is searched with a tree of
its own, and emits a spanning forest of its links rather than its pairs: that
keeps every connection and never grows with the square of a group.  Components
come from rounds of large-star and small-star over the forests' edges.

Bounds: the sample that shapes the tree has at most ``MAX_SAMPLE`` fingerprints
(about; it decides balance only, never results); shards hold about ``shard_rows`` rows,
more where a dense ball cannot be divided, which is then searched in linear time.

Edge cases: a null or empty text, or one of white space, has fingerprint zero and
links like any other; fewer than three words make one shingle; repeated rows get
the same component; null ids are passed over for the smallest id, and a component
without any id has a null component_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoplex.llm import arrowtext as at
from orthoplex.llm import storage

MAX_SAMPLE, MAX_TASKS = 1 << 20, 20_000
_LEAF = 96

#: For each byte, its bits spread over the eight bytes of a word, lowest bit first.
_SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(i)) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))


def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with one space after each word in place of white space; new starts and ends of words; words per text."""
    begins, ends, bounds = at.words(data, offsets, at.NOT_SPACE)
    keep = at.NOT_SPACE[data]
    gaps = ends[ends < len(data)]
    gaps = gaps[~keep[gaps]]
    keep[gaps] = True
    buffer = data.copy()
    buffer[gaps] = 32
    place = np.cumsum(keep) - 1
    return buffer[keep].tobytes(), place[begins], place[ends - 1] + 1, bounds


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = 3, seed: int = 42) -> np.ndarray:
    """A fingerprint per text."""
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    if not len(data):
        return out
    lowered = at.LOWER[data]
    buffer, begins, ends, bounds = _joined(lowered, offsets)
    counts = np.diff(bounds)
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    total = int(shingles.sum())
    if not total:
        return out
    first = np.concatenate([[0], np.cumsum(shingles)])
    of = np.repeat(np.arange(n), shingles)
    word = bounds[of] + (np.arange(total) - first[of])
    last = np.minimum(word + width, bounds[of + 1]) - 1
    view, digest = memoryview(buffer), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], seed) for a, b in zip(begins[word].tolist(), ends[last].tolist(), strict=True)), np.uint64, total)
    within = np.arange(total) - first[of]
    starts = np.flatnonzero(within % 255 == 0)
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(total, 8)], starts, axis=0)
    per_block = lanes.view(np.uint8).reshape(len(starts), 64)
    full = np.flatnonzero(shingles)
    ones = np.add.reduceat(per_block, np.searchsorted(starts, first[full]), axis=0, dtype=np.int64)
    bits = 2 * ones > shingles[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _map_fingerprints(batches: Iterator[pa.RecordBatch], text_at: int, keep: list[int], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = at.utf8(batch.column(text_at))
        found = [fingerprints(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, seed) for i, j in at.chunks(offsets)]
        whole = np.concatenate(found) if found else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(whole.view(np.int64))], [*(batch.schema.names[k] for k in keep), "fp"])


def with_fingerprint(docs: DataFrame, *, text: str = "text", keep_text: bool = True, width: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` and a column fp: the fingerprint's 64 bits as a long."""
    docs = at.drop_clashing(docs, ["fp"])
    text_at = [c.lower() for c in docs.columns].index(text.lower())
    keep = [k for k in range(len(docs.columns)) if keep_text or k != text_at]
    schema = docs.select(*[docs[f"`{docs.columns[k]}`"] for k in keep]).schema.add("fp", "long")
    return docs.mapInArrow(lambda it: _map_fingerprints(it, text_at, keep, width, seed), schema)


# ---------------------------------------------------------------- vantage-point tree


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _split(points: np.ndarray, reach: int, rng: np.random.Generator, tries: int = 6) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that divide the points with few of them near the boundary."""
    best, chosen = np.inf, None
    n = len(points)
    for vantage in points[rng.integers(0, n, tries)]:
        inner = np.cumsum(np.bincount(_distance(points[:4096], vantage), minlength=66)).astype(np.float64)
        inside = inner[:65] / inner[-1]  # share within each radius
        both = inside - np.concatenate([np.zeros(reach), inside[:-reach]])  # share that goes to both sides
        useful = (inside > 0) & (inside < 1) & (np.maximum(inside, 1 - inside + both) < 0.93)
        if not useful.any():
            continue
        radii = np.flatnonzero(useful)
        p = inside[radii]
        cost = (both[radii] + 0.02) / -(p * np.log(p) + (1 - p) * np.log(1 - p))  # copies for what the split tells apart
        k = int(np.argmin(cost))
        if cost[k] < best:
            best, chosen = cost[k], (np.uint64(vantage), int(radii[k]))
    return chosen


def _sides(points: np.ndarray, vantage: np.uint64, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Inside the ball; outside it, or inside so near the boundary that a point outside can be in reach."""
    d = _distance(points, vantage)
    return d <= radius, d > radius - reach


def build_tree(sample: np.ndarray, leaf: int, reach: int, seed: int = 7):
    """Nested (vantage, radius, inner, outer), with shard numbers as leaves; and the number of shards."""
    rng, shards = np.random.default_rng(seed), 0

    def grow(points: np.ndarray, depth: int):
        nonlocal shards
        found = _split(points, reach, rng) if len(points) > leaf and depth < 40 else None
        if found is None:
            shards += 1
            return shards - 1
        a, b = _sides(points, *found, reach)
        return (*found, grow(points[a], depth + 1), grow(points[b], depth + 1))

    return grow(sample, 0), shards


def route(points: np.ndarray, tree, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards and the points that belong to them or reach into them."""
    todo = [(tree, points)]
    while todo:
        node, some = todo.pop()
        if not len(some):
            continue
        if not isinstance(node, tuple):
            yield node, some
            continue
        vantage, radius, inner, outer = node
        a, b = _sides(some, vantage, radius, reach)
        todo += [(inner, some[a]), (outer, some[b])]


class Forest:
    """Disjoint sets over positions, united in bulk."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while True:
            higher = self.parent[up]
            if np.array_equal(higher, up):
                return up
            up = higher

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _within(reach: int) -> np.ndarray | None:
    """All differences of 1 to ``reach`` bits; None where there are too many to look up each."""
    if reach > 2:
        return None
    ones = np.uint64(1) << np.arange(64, dtype=np.uint64)
    a, b = np.triu_indices(64, 1)
    return np.concatenate([ones[: 64 * (reach > 0)], *[ones[a] | ones[b]] * (reach > 1)])


def link_within(points: np.ndarray, reach: int, seed: int = 11) -> np.ndarray:
    """For each of distinct sorted points the position of its component's least, within these points."""
    n = len(points)
    forest, rng = Forest(n), np.random.default_rng(seed)
    todo = [(np.arange(n), 0)]
    while todo:
        some, depth = todo.pop()
        m = len(some)
        if m < 2:
            continue
        found = _split(points[some], reach, rng, 3) if m > _LEAF and depth < 60 else None
        if found is not None:
            a, b = _sides(points[some], *found, reach)
            todo += [(some[a], depth + 1), (some[b], depth + 1)]
            continue
        own = points[some]
        masks = _within(reach)
        if masks is not None and m > 2 * len(masks):  # a dense ball that no vantage point divides: looked up, in time linear in its size
            for mask in masks:
                place = np.minimum(np.searchsorted(own, own ^ mask), m - 1)
                met = np.flatnonzero(own[place] == (own ^ mask))
                forest.unite(some[met], some[place[met]])
            continue
        for k in range(0, m, 256):
            near = np.bitwise_count(own[k : k + 256, None] ^ own[None, k:]) <= reach
            x, y = np.nonzero(near)
            forest.unite(some[k + x], some[k + y])
    return forest.roots(np.arange(n))


def _route_batches(batches: Iterator[pa.RecordBatch], tree, reach: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = batch.column(0).to_numpy().view(np.uint64)
        for shard, some in route(points, tree, reach):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard, np.int32)), pa.array(some.view(np.int64))], ["shard", "fp"])


def _link_shard(table: pa.Table, reach: int) -> pa.Table:
    points = np.unique(table.column("fp").to_numpy().view(np.uint64))
    root = link_within(points, reach)
    child = np.flatnonzero(root != np.arange(len(points)))
    return pa.table({"a": points[child].view(np.int64), "b": points[root[child]].view(np.int64)})


def links(distinct: DataFrame, *, distance: int = 2, shard_rows: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints: of each shard a spanning forest of its links."""
    n = distinct.count()
    shards = max(1, -(-n // shard_rows))
    size = min(MAX_SAMPLE, max(4096, 24 * shards))
    cut = min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * min(1.0, size / max(1, n))))  # about ``size`` of them, by hash
    sample = np.sort(distinct.select("fp").where(F.xxhash64("fp") <= cut).toArrow().column(0).to_numpy()).view(np.uint64)
    tree, _ = build_tree(sample, max(8, len(sample) // shards), distance) if shards > 1 else (0, 1)
    routed = distinct.select("fp").mapInArrow(lambda it: _route_batches(it, tree, distance), "shard int, fp long")
    # few bytes but much work each: dealt out by number, so that adaptive execution does not put many into one task
    dealt = routed.repartition(min(3 * shards, MAX_TASKS), "shard")
    return dealt.groupBy("shard").applyInArrow(lambda t: _link_shard(t, distance), "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of an edge, root being the least node (as a signed long) of its component."""
    spark = edges.sparkSession
    path = storage.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        e = spark.read.parquet(path)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        fresh = storage.write(small, name)
        storage.remove(spark, path)
        path = fresh
        got = spark.read.parquet(path)
        now = got.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return got.select(F.col("u").alias("node"), F.col("v").alias("root")).union(got.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def component_of(marks: DataFrame, *, distance: int = 2, shard_rows: int = 4096, edges: DataFrame | None = None) -> DataFrame:
    """(fp, root, component_id) for each distinct fp of ``marks`` (doc_id, fp), by ``edges`` if given."""
    nodes = storage.stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    edges = links(nodes, distance=distance, shard_rows=shard_rows) if edges is None else edges
    roots = components(edges).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    shared = rooted.where("linked").groupBy("root").agg(F.min("least").alias("component_id"))
    alone = rooted.where("not linked").select("fp", "root", F.col("least").alias("component_id"))
    return alone.unionByName(rooted.where("linked").select("fp", "root").join(shared, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", distance: int = 2, shard_rows: int = 4096) -> DataFrame:
    """One row per document: doc_id, fp, root (a fingerprint of its component) and component_id, its least doc_id."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = storage.stored(with_fingerprint(plain, keep_text=False), "marks")
    return marks.join(component_of(marks, distance=distance, shard_rows=shard_rows), "fp").select("doc_id", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", distance: int = 2) -> DataFrame:
    """One document of each component, that of the least id; columns as in ``docs``.

    Where ids are null or repeated, rows are told apart by fingerprint and content instead.
    """
    found = near_duplicates(docs, text=text, doc_id=doc_id, distance=distance)
    return one_of_each(docs, found, with_fingerprint, text=text, doc_id=doc_id)


def one_of_each(docs: DataFrame, found: DataFrame, mark: Callable[[DataFrame], DataFrame], *, text: str, doc_id: str) -> DataFrame:
    """The documents that ``deduplicate`` keeps, by the components ``found``; ``mark`` adds their fp."""
    path = storage.write(found, "near-duplicates")
    found = docs.sparkSession.read.schema(found.schema).parquet(path)
    odd = found.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        winners = found.where("doc_id = component_id").select(F.col("doc_id").alias(doc_id))
        return docs.join(winners, doc_id, "left_semi").select(*docs.columns)
    roots = found.select("fp", "root").distinct()
    marked = mark(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")))
    order = F.struct(F.col(f"row.{doc_id}").isNull(), F.col(f"row.{doc_id}"), F.xxhash64("text"))
    return marked.join(roots, "fp").groupBy("root").agg(F.min_by("row", order).alias("row")).select("row.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
