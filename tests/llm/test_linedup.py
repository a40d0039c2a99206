from __future__ import annotations

import random
import re

import pytest

from orthoplex.llm import linedup
from tests.llm.helpers import documents, odd_texts

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, least):
    """Longest earlier occurrence at every line; deleted where it has enough words."""
    docs = [[(n, x.strip(" \t\r\x0b\x0c"), len(WORD.findall(x))) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")] for _, t in rows]
    out = []
    for d, lines in enumerate(docs):
        gone = set()
        for s in range(len(lines)):
            best = 0
            for e in range(d + 1):
                for u in range(len(docs[e]) if e < d else s):
                    k = 0
                    while s + k < len(lines) and u + k < len(docs[e]) and lines[s + k][1] == docs[e][u + k][1]:
                        k += 1
                    best = max(best, k)
            if sum(x[2] for x in lines[s : s + best]) >= least:
                gone |= {x[0] for x in lines[s : s + best]}
        out.append((rows[d][0], len(lines), len(gone), sorted(gone), "\n".join(x for k, x in enumerate((rows[d][1] or "").split("\n")) if k not in gone)))
    return out


def found(spark, rows, least):
    df = linedup.dedup_lines(documents(spark, rows, extra="n_lines"), min_words=least)
    return [(r.doc_id, r.n_lines, r.n_deleted, r.deleted_lines, r.deduped_text or "") for r in df.collect()]


@pytest.mark.parametrize(("seed", "least"), [(1, 6), (2, 12), (3, 1)])
def test_equals_brute_force(spark, seed, least):
    rnd = random.Random(seed)
    lines = ["one two", "three", "four five six", "", " seven ", "eight nine ten eleven"] + [f"u{k} v" for k in range(30)]
    rows = []
    for k in range(40):
        own = rnd.choices(lines, k=rnd.randint(0, 14))
        if rows and rnd.random() < 0.4:
            own += rnd.choice(rows)[1].split("\n")[: rnd.randint(1, 8)]
        rows.append((k, "\n".join(own)))
    assert sorted(found(spark, rows, least)) == sorted(brute(rows, least))


def test_odd_rows(spark):
    rows = [(2, ""), (3, "a b\na b\na b"), (4, "x\n" + "word " * 60), (5, "word " * 60 + "\ny"), (6, None)]
    assert sorted(found(spark, rows, 50)) == sorted(brute(rows, 50))
    assert len(found(spark, odd_texts(), 50)) == len(odd_texts()) and found(spark, [], 50) == []
    twice = found(spark, [(1, "word " * 60), (1, "word " * 60), (None, "word " * 60)], 50)
    assert sorted(r[2] for r in twice) == [0, 1, 1]
