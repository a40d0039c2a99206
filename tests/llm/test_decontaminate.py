from __future__ import annotations

import hashlib
import random

import pytest

from orthoplex.llm import decontaminate as d
from tests.llm.helpers import documents, odd_texts


def brute(docs, items, n=13):
    windows = {}
    for i, t in items:
        if i is None or t is None:
            continue
        w = d.normalised_words(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for doc, text in docs:
        w, hit, found = d.normalised_words(text or ""), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if x := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= x
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def found(spark, docs, items, **how):
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = d.digest(d.find_contamination(documents(spark, docs), bench, **how))
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sample(seed, n_docs=40):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "épée", "zeta9", "x"]
    items = [(k, " ".join(rnd.choices(words, k=rnd.choice((1, 2, 5, 12, 13, 14, 30))))) for k in range(25)] + [(30, None), (None, "alpha beta"), (31, "!!"), (3, "x x x")]
    docs = []
    for k in range(n_docs):
        text = " ".join(rnd.choices(words, k=rnd.randint(0, 60)))
        if rnd.random() < 0.4:
            text += " -- " + rnd.choice(items[:25])[1].upper() + ", " + " ".join(rnd.choices(words, k=5))
        docs.append((k, text))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs, items = sample(seed)
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, block_bytes=200) == brute(docs, items)  # several blocks


def test_odd_rows_and_empty_tables(spark):
    items = [(1, "a b c"), (2, "Привет мир")]
    assert found(spark, odd_texts(), items) == brute(odd_texts(), items)
    assert found(spark, [], items) == [] and found(spark, odd_texts(), []) == brute(odd_texts(), [])


def test_removal(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = documents(spark, [(1, "before " + passage + " after"), (2, "clean text"), (3, None)], extra="n_hit")
    kept = d.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and "n_hit" not in kept.columns
    cut = {r.doc_id: r.text for r in d.decontaminate(docs, bench, mode="spans").collect()}
    assert cut == {1: "before  after", 2: "clean text", 3: None}
    with pytest.raises(ValueError):
        d.decontaminate(docs, bench, mode="x")
