"""Near duplicates by the Jaccard similarity of word shingles, found exactly.

Two texts are linked where their sets of 5-word shingles have a similarity of 0.8
or more; components are those of all links.  Candidates are SimHash fingerprints of
the 5-word shingles within ``DISTANCE`` bits, found through ``simhash``'s vantage-point
trees; their sets are compared exactly.

No SimHash radius is certain: such pairs lie up to a dozen bits apart, where the trees
no longer divide 64 bits.  Prefix filters, which lose no pair, find the rest: texts this
alike share shingles among the lowest hashes of both.  A set of n shingles gives its
n - ceil(0.8 n) + slack lowest, and any partner has at least ``_need(n)`` of them in its
own; sets with fewer that some other set also gave are out.  The rest keep their rarest
hashes, as few as still must meet; of hashes that the same sets have one stays.  Each set
is verified against three hubs of each hash, along with the fingerprints' candidates.  Of
the pairs that this leaves in different components all are compared, in blocks of
``BLOCK`` sets by parity sketches (which differ in no more bits than the sets in shingles,
so that no pair is lost); those that pass are given once, by the least hash they
share, and then compared as sets.

Edge cases: fewer than five words make one shingle; null, empty and blank texts
are alike; repeated rows get the same component.  Sets and shingles are told
apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoplex.llm import arrowtext as at
from orthoplex.llm import simhash, storage

SLACK, BROADCAST_SETS, SKETCH = 16, 1_000_000, 8  # sketches of so many longs
DISTANCE = 3  # bits; at four the trees copy each fingerprint to ten shards
BLOCK, AT_ONCE = 1024, 1 << 14  # sets of a hash that meet in one cell, from either side; pairs held at once
NUMBERS = 1 << 18  # hashes of sets handled at once, beyond those of one pair or cell


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending in each, and where each text's begin (one entry more than texts)."""
    n = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    lowered = at.LOWER[data]
    begins, ends, bounds = at.words(lowered, offsets, at.NOT_SPACE)
    hashes, counts = at.span_hashes(lowered, begins, ends), np.diff(bounds)
    of, found = [], []
    for size in range(1, width + 1):
        grams = at.ngram_hashes(hashes, size)
        texts = np.flatnonzero(counts == size if size < width else counts >= width)
        each = counts[texts] - size + 1
        owner = np.repeat(texts, each)
        at_ = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each) + bounds[owner]
        of.append(owner)
        found.append(at.mix(grams[at_] + np.uint64(size)))
    owner, shingles = np.concatenate(of), np.concatenate(found)
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    owner, shingles = owner[fresh], shingles[fresh]
    return shingles, np.searchsorted(owner, np.arange(n + 1))


def set_hashes(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each set; zero for the empty one."""
    sizes = np.diff(starts)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = at.mix(np.add.reduceat(at.mix(shingles), starts[full]) + sizes[full].astype(np.uint64))
    return out


def sketches(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Parities of each set's shingles over 64 * SKETCH bits: two differ in at most as many bits as their sets in shingles."""
    out = np.zeros((len(starts) - 1, SKETCH), np.uint64)
    spread = at.mix(shingles ^ np.uint64(0x5DEECE66D))
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    np.bitwise_xor.at(out, (of, ((spread >> np.uint64(6)) % np.uint64(SKETCH)).astype(np.int64)), np.uint64(1) << (spread & np.uint64(63)))
    return out


def _ceil(n, part: Fraction):
    return -(-n * part.numerator // part.denominator)


def _slack(n):
    return 1 + n // SLACK


def _need(n, part: Fraction):
    """What the least possible partner of a set of n also gives: at least so many hashes are shared by both prefixes."""
    return _slack(_ceil(n, part))


def _each(batches: Iterator[pa.RecordBatch], text_at: int, width: int) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, offsets = at.utf8(batch.column(text_at))
        for i, j in at.chunks(offsets):
            texts = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            shingles, starts = shingle_sets(*texts, width)
            yield batch.slice(i, j - i), texts, shingles, starts, set_hashes(shingles, starts)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _map_marks(batches: Iterator[pa.RecordBatch], text_at: int, keep: list[int], width: int, fingerprint: bool) -> Iterator[pa.RecordBatch]:
    for batch, texts, _, _, fp in _each(batches, text_at, width):
        found = {"fp": fp} | ({"mark": simhash.fingerprints(*texts, width)} if fingerprint else {})
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *map(_long, found.values())], [*(batch.schema.names[k] for k in keep), *found])


def _map_prefixes(batches: Iterator[pa.RecordBatch], width: int, part: Fraction) -> Iterator[pa.RecordBatch]:
    for _, _, shingles, starts, fp in _each(batches, 0, width):
        _, first = np.unique(fp, return_index=True)
        sizes = np.diff(starts)[first]
        take = np.minimum(sizes, sizes - _ceil(sizes, part) + _slack(sizes))
        take[sizes == 0] = 0
        row = np.repeat(first, take)
        place = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take) + starts[row]
        yield pa.RecordBatch.from_arrays([_long(shingles[place]), _long(fp[row]), pa.array(np.repeat(sizes, take).astype(np.int32))], ["h", "fp", "n"])


def _map_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for _, _, shingles, starts, fp in _each(batches, 0, width):
        bits = sketches(shingles, starts)
        lists = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), _long(shingles)), *(_long(np.ascontiguousarray(bits[:, k])) for k in range(SKETCH))]
        yield pa.RecordBatch.from_arrays([_long(fp), *lists], ["fp", "shingles", *(f"s{k}" for k in range(SKETCH))])


def with_set_hash(docs: DataFrame, *, text: str = "text", keep_text: bool = True, width: int = 5, fingerprint: bool = False) -> DataFrame:
    """``docs`` and a column fp: the hash of the text's shingle set as a long; with ``fingerprint`` also mark, its SimHash."""
    added = ["fp", "mark"] if fingerprint else ["fp"]
    docs = at.drop_clashing(docs, added)
    text_at = [c.lower() for c in docs.columns].index(text.lower())
    keep = [k for k in range(len(docs.columns)) if keep_text or k != text_at]
    schema = docs.select(*[docs[f"`{docs.columns[k]}`"] for k in keep]).schema
    for name in added:
        schema = schema.add(name, "long")
    return docs.mapInArrow(lambda it: _map_marks(it, text_at, keep, width, fingerprint), schema)


def _verified(pairs: DataFrame, sets: DataFrame, part: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""
    p, q = part.numerator, part.denominator
    left = pairs.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    both = left.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a")
    return both.where(F.size(F.array_intersect("x", "y")) * (p + q) >= (F.size("x") + F.size("y")) * p).select("a", "b")


def fingerprint_pairs(marks: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of set hashes fp whose marks are equal, or linked within ``distance`` by the trees of a shard: as many as connect them."""
    nodes = storage.stored(marks.select("fp", "mark").distinct(), "prints")
    heads = storage.stored(nodes.groupBy("mark").agg(F.min("fp").alias("head")), "heads")
    near = simhash.links(heads.select(F.col("mark").alias("fp")), distance=distance)
    met = near.join(heads.select(F.col("mark").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("mark").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
    pairs = met.union(nodes.join(heads, "mark").select("fp", "head"))
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _once(x: np.ndarray, y: np.ndarray, first: np.ndarray, keys: np.ndarray, codes: np.ndarray, size: int) -> np.ndarray:
    """Which pairs of rows have no number in common; those of a row begin at ``first``, ``keys`` are row * size + number."""
    out = np.ones(len(x), bool)
    each = np.diff(first)[x]
    total = np.cumsum(each)
    i = 0
    while i < len(x) and len(keys):
        j = max(i + 1, int(np.searchsorted(total, total[i] - each[i] + NUMBERS, "right")))
        some = each[i:j]
        pair = np.repeat(np.arange(i, j), some)
        wanted = codes[np.arange(len(pair)) - np.repeat(np.cumsum(some) - some, some) + first[x[pair]]] + y[pair] * size
        out[pair[keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted]] = False
        i = j
    return out


def _runs(cells: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Whole cells, as many as have few numbers."""
    h, i, j = (cells.column(c).to_numpy() for c in ("h", "i", "j"))
    starts = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(h)]])
    numbers = (cells.column("hs").offsets.to_numpy().astype(np.int64) + SKETCH * np.arange(len(h) + 1))[starts]
    a = 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(numbers, numbers[a] + NUMBERS, "right")) - 1)
        yield cells.slice(starts[a], starts[b] - starts[a])
        a = b


def _cell_pairs(cells: pa.RecordBatch, part: Fraction) -> Iterator[pa.RecordBatch]:
    """Pairs in whole cells, sorted by cell, that the sketches do not tell apart."""
    p, q = part.numerator, part.denominator
    h, i, j, side, fp, n, root = (cells.column(c).to_numpy() for c in ("h", "i", "j", "side", "fp", "n", "root"))
    bits = np.stack([cells.column(f"s{k}").to_numpy() for k in range(SKETCH)], axis=1).view(np.uint64)
    first = cells.column("hs").offsets.to_numpy().astype(np.int64)
    first -= first[0]
    known, codes = np.unique(cells.column("hs").flatten().to_numpy(), return_inverse=True)
    keys, n = np.repeat(np.arange(len(h)), np.diff(first)) * len(known) + codes, n.astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    sizes = np.diff(np.concatenate([starts, [len(h)]]))
    end, rows, across = np.repeat(starts + sizes, sizes), np.arange(len(h)), i != j
    found, held = [], 0
    for step in range(1, int(sizes.max()) + 1):
        rows = rows[rows + step < end[rows]]
        x, y = rows, rows + step
        fit = (root[x] != root[y]) & (np.minimum(n[x], n[y]) * q >= np.maximum(n[x], n[y]) * p) & ~(across[x] & (side[x] == side[y]))
        x, y = x[fit], y[fit]
        near = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) * (p + q) <= (n[x] + n[y]) * (q - p)
        found.append((x[near], y[near]))
        held += int(near.sum())
        if held and (held >= AT_ONCE or not len(rows)):
            x, y = (np.concatenate(z) for z in zip(*found, strict=True))
            found, held = [], 0
            fresh = _once(x, y, first, keys, codes, len(known))
            a, b = fp[x[fresh]], fp[y[fresh]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _map_cells(batches: Iterator[pa.RecordBatch], part: Fraction) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        h, i, j = (batch.column(c).to_numpy() for c in ("h", "i", "j"))
        last = int(np.flatnonzero((h != h[-1]) | (i != i[-1]) | (j != j[-1]))[-1:].sum() + 1) if (h[0], i[0], j[0]) != (h[-1], i[-1], j[-1]) else 0
        if held and (last or tuple(held[-1].column(c)[-1].as_py() for c in "hij") != (h[0], i[0], j[0])):
            for cells in _runs(pa.concat_batches([*held, batch.slice(0, last)])):
                yield from _cell_pairs(cells, part)
            held = []
        elif last:
            for cells in _runs(batch.slice(0, last)):
                yield from _cell_pairs(cells, part)
        held.append(batch.slice(last))
    if held:
        for cells in _runs(pa.concat_batches(held)):
            yield from _cell_pairs(cells, part)


def open_pairs(placed: DataFrame, sets: DataFrame, part: Fraction, block: int = BLOCK) -> DataFrame:
    """Once each, the pairs (a, b) of ``placed`` (h, fp, n, root) that share an h, have different roots and by their sketches may be alike."""
    bits = [f"s{k}" for k in range(SKETCH)]
    split = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("h", F.expr(f"cast(ceil(m / {block}) as int)").alias("blocks"))
    lists = placed.join(split, "h").groupBy("fp", "n", "root").agg(F.array_sort(F.collect_list(F.struct("h", "blocks"))).alias("x")).join(sets.select("fp", *bits), "fp")
    each = lists.select("fp", "n", "root", *bits, "x", F.posexplode("x").alias("k", "y")).withColumn("hs", F.expr("slice(x.h, 1, k)")).withColumn("side", F.expr("cast(pmod(xxhash64(fp), y.blocks) as int)"))
    dealt = each.withColumn("other", F.explode(F.expr("sequence(0, y.blocks - 1)"))).select("y.h", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "fp", "n", "root", "hs", *bits)
    cells = dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return cells.mapInArrow(lambda it: _map_cells(it, part), "a long, b long")


def links(texts: DataFrame, marks: DataFrame, *, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Edges (a, b) between set hashes of the one column of ``texts``: enough of all links to connect what they connect.

    ``marks``: (fp, mark) of these texts.
    """
    part = Fraction(str(similarity))
    p, q = part.numerator, part.denominator
    given = texts.mapInArrow(lambda it: _map_prefixes(it, width, part), "h long, fp long, n int")
    met = given.groupBy("h").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("h")
    shared = storage.stored(given.join(met, "h", "left_semi").distinct(), "shared-shingles")
    least = F.expr(f"1 + cast(ceil(n * {p} / {q}d - 1e-9) as int) div {SLACK}")  # never more than _need
    df = shared.groupBy("h").agg(F.count("*").alias("df"))
    ranked = shared.join(df, "h").groupBy("fp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("x")).withColumn("need", least).where("size(x) >= need")
    kept = storage.stored(ranked.select("fp", "n", F.explode(F.expr("slice(x, 1, size(x) - need + 1)")).alias("y")).select("fp", "n", "y.h"), "rare-shingles")
    owners = kept.groupBy("h").agg(F.count("*").alias("m"), F.min(F.struct("fp", "n")).alias("u"), F.max(F.struct("fp", "n")).alias("v"), F.min_by(F.struct("fp", "n"), F.xxhash64("fp")).alias("w"), F.bit_xor(F.xxhash64("fp")).alias("all")).where("m > 1")
    alive = storage.stored(owners.groupBy("m", "u", "v", "w", "all").agg(F.min("h").alias("h")), "hubs")
    alike = f"a <> b and least(n, k) * {q} >= greatest(n, k) * {p}"
    hubs = alive.select("h", F.explode(F.array("u", "v", "w")).alias("z")).select("h", F.col("z.fp").alias("b"), F.col("z.n").alias("k"))
    by_hub = kept.withColumnRenamed("fp", "a").join(hubs, "h").where(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    some = storage.stored(fingerprint_pairs(marks).union(by_hub).distinct(), "candidate-pairs")
    wanted = storage.stored(kept.join(alive.select("h"), "h", "left_semi").select("fp").distinct(), "candidates")  # every set with a link is one
    own = wanted if wanted.count() > BROADCAST_SETS else F.broadcast(wanted)
    sets = storage.stored(texts.mapInArrow(lambda it: _map_sets(it, width), f"fp long, shingles array<long>, {', '.join(f's{k} long' for k in range(SKETCH))}").join(own, "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    first = storage.stored(_verified(some, sets, part), "first-links")
    roots = simhash.components(first).select(F.col("node").alias("fp"), "root")
    placed = storage.stored(kept.join(alive.select("h"), "h", "left_semi").join(roots, "fp", "left").select("h", "fp", "n", F.coalesce("root", "fp").alias("root")), "placed")
    rest = storage.stored(open_pairs(placed, sets, part).join(some, ["a", "b"], "left_anti"), "open-pairs")
    return first.unionByName(_verified(rest, sets, part))


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, fp, root (the hash of a set of its component) and component_id, its least doc_id."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = storage.stored(with_set_hash(plain, keep_text=False, width=width, fingerprint=True), "marks")
    found = links(plain.select("text"), marks, width=width, similarity=similarity)
    return marks.join(simhash.component_of(marks, edges=found), "fp").select("doc_id", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each component, as ``simhash.deduplicate`` chooses it; columns as in ``docs``."""
    found = near_duplicates(docs, text=text, doc_id=doc_id, width=width, similarity=similarity)
    return simhash.one_of_each(docs, found, lambda some: with_set_hash(some, width=width), text=text, doc_id=doc_id)
