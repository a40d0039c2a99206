from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from orthoplex.llm import simhash
from tests.llm.helpers import documents, odd_texts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, reach=2):
    marks = [(i, fingerprint(t)) for i, t in rows]
    root = list(range(len(marks)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(marks)):
        for b in range(a):
            if (marks[a][1] ^ marks[b][1]).bit_count() <= reach:
                root[up(a)] = up(b)
    out = []
    for k, (i, f) in enumerate(marks):
        ids = [marks[j][0] for j in range(len(marks)) if up(j) == up(k) and marks[j][0] is not None]
        out.append((i, f"{f:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rnd.choices(words, k=rnd.randint(3, 200))) for _ in range(n // 4)]
    rows = []
    for k in range(n):
        text = rnd.choice(base).split()
        for _ in range(rnd.choice((0, 0, 1, 2, 4))):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((k * 3 + 1, " ".join(text).upper() if rnd.random() < 0.3 else "  ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed) + odd_texts()
    rows[-5:] = [(r[0] and r[0] + 900, r[1]) for r in rows[-5:]]
    got = simhash.digest(simhash.near_duplicates(documents(spark, rows, extra="fp root"), shard_rows=16))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == components(rows)


def test_empty(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.deduplicate(documents(spark, [])).count() == 0


@pytest.mark.parametrize("spread", [3, 12, 64])
def test_trees_lose_no_link(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 1 << 63, 6, np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(spread, min(3, spread), replace=False)) for _ in range(4000)], np.uint64)
    points = np.unique(rng.choice(centres, 4000) ^ flips)
    tree, shards = simhash.build_tree(points[::3], 60, 2)
    roots = simhash.link_within(points, 2)
    edges = []
    for _, some in simhash.route(points, tree, 2):
        own = np.unique(some)
        r = simhash.link_within(own, 2)
        edges.append(np.stack([np.searchsorted(points, own), np.searchsorted(points, own[r])]))
    a, b = np.concatenate(edges, axis=1)
    forest = simhash.Forest(len(points))
    forest.unite(a, b)
    brute = simhash.Forest(len(points))
    for k in range(len(points)):
        near = np.flatnonzero(np.bitwise_count(points ^ points[k]) <= 2)
        brute.unite(np.full(len(near), k), near)
    want = brute.roots(np.arange(len(points)))
    assert np.array_equal(roots, want) and np.array_equal(forest.roots(np.arange(len(points))), want) and shards >= 1


def test_one_stays(spark):
    rows = corpus(3, 60)
    kept = simhash.deduplicate(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in components(rows)}) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    odd = [(1, "a b c d"), (1, "a b c d"), (1, "other words in here"), (None, "third text without an id"), (None, "third text without an id"), (2, "a b c d")]
    assert sorted(((r.doc_id, r.text) for r in simhash.deduplicate(documents(spark, odd)).collect()), key=repr) == [(1, "a b c d"), (1, "other words in here"), (None, "third text without an id")]


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {k: 1 for k in range(1, 201)} | {500: 500, 501: 500}


def test_a_dense_ball_is_linked_in_linear_time():
    """All fingerprints within three bits of a centre: no vantage point divides them, and every one has links."""
    from itertools import combinations

    points = np.unique(np.array([sum(1 << b for b in some) for k in range(4) for some in combinations(range(64), k)], np.uint64) ^ np.uint64(0x123456789ABCDEF))
    far = np.unique(np.concatenate([points, np.array([0xFFFF0000FFFF0000], np.uint64)]))
    roots = simhash.link_within(far, 2)
    assert len(far) == 43746 and len(np.unique(roots)) == 2 and np.array_equal(roots[np.searchsorted(far, points)], np.full(len(points), np.searchsorted(far, points[0])))


def test_a_dense_ball_through_links(spark):
    from itertools import combinations

    points = [sum(1 << b for b in some) for k in range(3) for some in combinations(range(64), k)]
    edges = simhash.links(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long"), shard_rows=100)
    found = simhash.components(edges).collect()
    assert len(found) == len(points) and len({r.root for r in found}) == 1
