from __future__ import annotations

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from orthoplex.llm import neardup, simhash
from tests.llm.helpers import documents, odd_texts


def shingles(text):
    words = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "").encode().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def components(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[up(a)] = up(b)
    out = []
    for k, (i, _) in enumerate(rows):
        out.append((i, min((rows[j][0] for j in range(len(rows)) if up(j) == up(k) and rows[j][0] is not None), default=None)))
    return sorted(out, key=repr)


def corpus(seed, n=160):
    """Copies with few to many changed words, in chains, and a passage that many texts have."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = rnd.choices(words, k=40)
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.7:
            text = list(rnd.choice(texts[-30:]))
            for _ in range(rnd.choice((0, 1, 1, 2, 3, 6))):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            text += rnd.choices(words, k=rnd.choice((0, 0, 3, 12)))
        else:
            text = rnd.choices(words, k=rnd.randint(1, 150)) + (passage if rnd.random() < 0.5 else [])
        texts.append(text)
    return [(3 * k + 1, (" ".join(t).upper() if rnd.random() < 0.3 else "  ".join(t))) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed) + [(i and i + 900, t) for i, t in odd_texts()]
    got = neardup.near_duplicates(documents(spark, rows, extra="fp root"))
    want = components(rows)
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=repr) == want
    assert len({c for _, c in want}) < len({t.lower() for _, t in rows if t}) - 20  # many near copies are no exact ones


def test_pipeline_stage_drops_near_copies(spark):
    import corpus_pipeline

    text = [f"word{k}" for k in range(200)]
    other = [*text[:60], "changed", *text[61:130], "again", *text[131:]]  # 186 of 206 shingles in common
    rows = [(1, " ".join(text)), (2, " ".join(other)), (3, " ".join(text[:150]))]
    kept = corpus_pipeline.near_dedup(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_empty_and_odd(spark):
    assert neardup.deduplicate(documents(spark, [])).count() == 0
    odd = [(1, "a b c d"), (1, "a b c d"), (1, "other words in here"), (None, "third text without an id"), (None, "third text without an id"), (2, "a b c d")]
    assert sorted(((r.doc_id, r.text) for r in neardup.deduplicate(documents(spark, odd)).collect()), key=repr) == [(1, "a b c d"), (1, "other words in here"), (None, "third text without an id")]


def test_stage_gets_links_from_the_fingerprint_trees(spark, monkeypatch):
    import corpus_pipeline

    asked, verified = [], []
    trees, check = simhash.links, neardup._verified

    def links(distinct, **options):
        asked.append((sorted(r.fp for r in distinct.collect()), options))
        return trees(distinct, **options)

    def verify(pairs, *rest):
        verified.append({(r.a, r.b) for r in pairs.collect()})
        return check(pairs, *rest)

    monkeypatch.setattr(simhash, "links", links)
    monkeypatch.setattr(neardup, "_verified", verify)
    text = [f"word{k}" for k in range(400)]
    rows = [(1, " ".join(text)), (2, " ".join([*text, "more"])), (3, "nothing like the others at all")]
    docs = documents(spark, rows)
    marks = neardup.with_set_hash(docs, fingerprint=True)
    assert marks.columns == [*docs.columns, "fp", "mark"] and docs.columns == neardup.with_set_hash(docs).drop("fp").columns
    found = {r.doc_id: r for r in marks.collect()}
    assert (found[1].mark ^ found[2].mark).bit_count() <= neardup.DISTANCE
    pair = tuple(sorted((found[1].fp, found[2].fp)))
    assert {tuple(r) for r in neardup.fingerprint_pairs(marks).collect()} == {pair}
    asked.clear()
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert asked == [(sorted(r.mark for r in found.values()), {"distance": neardup.DISTANCE})] and pair in verified[0]


def placed_sets(spark, seed):
    """Sets in hashes of 2 to 150 members, with roots, and sketches some of which are near."""
    rng = np.random.default_rng(seed)
    sketch = rng.integers(-(1 << 62), 1 << 62, (5, neardup.SKETCH))
    sets = [(int(f), *(int(x) for x in sketch[rng.integers(5)] ^ rng.choice([0, 1, 12, 4095], neardup.SKETCH))) for f in rng.choice(10**6, 200, replace=False) - 500_000]
    sizes, roots = rng.integers(90, 130, 200), rng.integers(0, 60, 200)
    placed = [(h * 7 - 50, sets[k][0], int(sizes[k]), int(roots[k])) for h in range(25) for k in rng.choice(200, rng.choice([2, 3, 40, 150]), replace=False)]
    return placed, sets


@pytest.mark.parametrize("block", [7, 1024])
def test_open_pairs_equal_brute_force_and_come_once(spark, block, monkeypatch):
    placed, sets = placed_sets(spark, block)
    bits = [f"s{k} long" for k in range(neardup.SKETCH)]
    monkeypatch.setattr(neardup, "AT_ONCE", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # cells stand in several batches
    try:
        got = neardup.open_pairs(spark.createDataFrame(placed, "h long, fp long, n int, root long"), spark.createDataFrame(sets, f"fp long, {', '.join(bits)}"), Fraction("0.8"), block).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sketch, want = {f: x for f, *x in sets}, set()
    for h, a, n, r in placed:
        for g, b, k, o in placed:
            if h == g and a < b and r != o and 5 * min(n, k) >= 4 * max(n, k):
                apart = sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(sketch[a], sketch[b], strict=True))
                if 9 * apart <= n + k:
                    want.add((a, b))
    assert len(got) == len(want) > 100 and {tuple(r) for r in got} == want


def test_texts_that_share_a_passage_are_not_joined_in_pairs(spark, monkeypatch):
    """No two of 300 texts with one passage are alike: no join gives a row for each of the 44,850 pairs, nor for each shared shingle."""
    rnd = random.Random(5)
    passage = " ".join(f"pass{k}" for k in range(60))
    rows = [(k, passage + " " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(50))) for k in range(300)]
    plans, sizes = [], {}
    stored = neardup.storage.stored

    def keep(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = stored(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(neardup.storage, "stored", keep)
    assert neardup.deduplicate(documents(spark, rows)).count() == 300
    assert sizes["open-pairs"] < 300 and not [line for plan in plans for line in plan.splitlines() if "Join" in line and "bit_count" in line]
    assert sizes["hubs"] <= 60 and sizes["candidate-pairs"] <= 3 * 300 * 3
