from __future__ import annotations

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from orthoplex.llm import quality
from tests.llm.helpers import documents, odd_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words, seen, again, covered = WORD.findall(text), set(), 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    times = Counter(zip(words, words[1:], words[2:], strict=False))
    for k in range(len(words) - 2):
        if times[tuple(words[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)


def corpus(seed, n=80):
    rnd = random.Random(seed)
    words = ["the", "Quick", "fox", "über", "lazy.", "dog", "and", "of", "time,", "tide"] + [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        lines = []
        for _ in range(rnd.randint(2, 9)):
            some = rnd.choices(words, k=rnd.randint(4, 20))
            lines.append(" ".join(some) + "." if good else "$$$ ".join(some).upper() + "### ")
        rows.append((k, "\n".join(lines + lines[:1] * (k % 5 == 0))))
        labels.append((k, int(good), 0))
    return rows, labels


def judged(spark, rows, labels, **how):
    return quality.judge(documents(spark, rows, extra="kept"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **how)


def test_counts_and_verdicts(spark):
    rows, labels = corpus(1)
    found = quality.digest(judged(spark, rows + [(900 + k, t) for k, (_, t) in enumerate(odd_texts())], labels)).collect()
    texts = dict(rows) | {900 + k: t for k, (_, t) in enumerate(odd_texts())}
    for r in found:
        assert base(texts[r.doc_id]) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.kept and r.base_failed)
    truth = {k: q for k, q, _ in labels}
    decided = [r for r in found if not r.base_failed and r.doc_id in truth]
    assert len(decided) > 20 and all(r.kept == bool(truth[r.doc_id]) for r in decided)


def test_without_labels_and_rows(spark):
    rows, _ = corpus(2, 12)
    assert all(r.kept != r.base_failed for r in judged(spark, rows, []).collect())
    assert judged(spark, rows, [(None, 1, None), (3, None, None), (4, 7, 0)]).count() == 12
    assert judged(spark, [], []).count() == 0
    kept = quality.keep_good(documents(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_is_the_best_labelling(seed):
    rng = np.random.default_rng(seed)
    field = quality.Field(rng.normal(size=quality.N_FEATURES), rng.normal(size=(2, 2)))
    n = int(rng.integers(1, 9))
    x = rng.integers(0, 2, (n, quality.N_FEATURES)).astype(float)

    def score(labels):
        gain = x @ field.weights
        return sum(g for g, y in zip(gain, labels, strict=True) if y) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:], strict=False))

    got = field.decode(x, np.array([0, n])).tolist()
    assert score(got) == pytest.approx(max(score(y) for y in product((0, 1), repeat=n)))


def test_training_gradient_fits_a_simple_field():
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for k in range(60):
        x = np.zeros((int(rng.integers(1, 12)), quality.N_FEATURES))
        x[:, 0], x[:, 5] = 1, k % 2
        docs.append(x)
        labels.append(1 - k % 2)
    field = quality.train(docs, np.array(labels))
    assert all(field.decode(x, np.array([0, len(x)])).mean() == y for x, y in zip(docs, labels, strict=True))


def test_equality_is_by_bytes():
    """Lines and words on which polynomial hashes modulo 2**64 collide whatever their base."""
    def thue_morse(n, a, b):
        return "".join(b if k.bit_count() & 1 else a for k in range(n))

    one, two = "x" + thue_morse(4096, "a", "b") + "y", "x" + thue_morse(4096, "b", "a") + "y"
    text = f"{one}\n{two}\n{one} q r {two} q r"
    raw = np.frombuffer(text.encode(), np.uint8)
    found = quality.Lines(raw, np.array([0, len(raw)]))
    assert (found.n_dup_lines[0], found.n_repeat_words[0]) == base(text)[3:] == (0, 0)
    zeros = "a a\0 a\0\0 a a\0 a\0 a a a"
    raw = np.frombuffer(zeros.encode(), np.uint8)
    assert quality.Lines(raw, np.array([0, len(raw)])).n_repeat_words[0] == base(zeros)[4]


def mixed_corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(150)] + ["the", "and", "of"] * 10
    footer = ["All rights reserved. Licensed under the usual terms", "Subscribe | Login | Privacy | Terms", "Back to the list of pages"]
    rows, labels = [], []
    for k in range(90):
        good = k % 3 > 0
        lines = [" ".join(rnd.choices(words, k=rnd.randint(12, 25))) + "." for _ in range(rnd.randint(3, 6))] if good else ["%%% ".join(rnd.choices(words, k=14)).upper() + "!!!" for _ in range(4)]
        rows.append((k, "\n".join(lines + footer * (good and k % 2))))
        labels.append((k, int(good), 0))
    return rows, labels, footer


def test_a_footer_under_good_text_is_boilerplate(spark):
    rows, labels, footer = mixed_corpus(4)
    field = quality.learn(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text = next(t for i, t in rows if i == 31)
    raw = np.frombuffer(text.encode(), np.uint8)
    lines = quality.Lines(raw, np.array([0, len(raw)]))
    marks = field.decode(lines.features, lines.bounds).tolist()
    assert marks[-2:] != [1, 1] and 0 in marks[-3:] and marks[:-3] == [1] * (len(marks) - 3) and len(set(marks)) == 2


def test_the_whole_query_equals_a_plain_one(spark):
    """Counts from the text, and the verdict from the best of all labellings under the learnt field."""
    rows, labels, _ = mixed_corpus(6)
    docs, given = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    field = quality.learn(docs, given)
    for r in quality.digest(quality.judge(docs, given)).collect():
        text = next(t for i, t in rows if i == r.doc_id)
        assert base(text) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        raw = np.frombuffer(text.encode(), np.uint8)
        lines = quality.Lines(raw, np.array([0, len(raw)]))
        gain = lines.features @ field.weights
        best = max(product((0, 1), repeat=len(gain)), key=lambda y: sum(g for g, k in zip(gain, y, strict=True) if k) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        words = [len(WORD.findall(x)) for x in text.split("\n")]
        share = sum(w for w, k in zip(words, best, strict=True) if k) / sum(words)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.content_share == pytest.approx(share) and r.base_failed == failed and r.kept == (not failed and share >= 0.5)
