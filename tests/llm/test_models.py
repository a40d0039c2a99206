"""Language identification and toxicity: held-out accuracy and odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoplex.llm import langid, toxicity
from tests.llm.helpers import LANGS, documents, odd_texts


def languages(seed, n=120):
    rnd = random.Random(seed)
    names = sorted(LANGS)
    return [(k, " ".join(rnd.choices(LANGS[names[k % 3]].split(), k=rnd.randint(20, 200))), names[k % 3]) for k in range(n)]


def test_languages_of_held_out_documents(spark):
    rows = languages(1)
    df = documents(spark, rows, extra="score")
    got = langid.digest(langid.identify(df, df)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.lang_pred == truth[r.doc_id] and 0.5 <= r.score <= 1 for r in got) and sum(r.held_out for r in got) > 10


def test_odd_languages(spark):
    train = documents(spark, languages(2))
    odd = documents(spark, [*odd_texts(), (50, "123 !!"), (51, "İıß" * 2000)])
    got = {r.doc_id: r for r in langid.identify(odd, train).collect()}
    assert {got[k].lang_pred for k in (1, 2, 3, 50)} == {"und"} and got[1].score == 0 and got[4].lang_pred in LANGS
    assert {r.lang_pred for r in langid.identify(odd, train.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(train.limit(0), train).count() == 0


def test_every_language_is_filled(spark):
    rows, k = [], 0
    for lang, sizes in {"short": [150] * 700, "long": [9000] * 12, "one": [90_000] * 1, "rare": [300] + [100] * 900, "few": [50] * 20}.items():
        for size in sizes:
            k += 1
            while zlib.crc32(str(k).encode()) % 4 == 2:
                k += 1
            rows.append((k, (f"{lang}{k} " * size)[:size], lang))
    got = langid.learn(documents(spark, rows))
    assert all(40_000 <= len(got[x].replace("\n", "")) < 46_000 for x in ("short", "long", "one", "rare")) and len(got["few"].replace("\n", "")) == 1000
    fit = next(t for _, t, x in rows if x == "rare" and len(t) == 300)
    assert got["rare"].startswith(fit) and langid.learn(documents(spark, rows)) == got


def test_parse_equals_a_plain_one():
    parser = langid.Parser({"a": "the cat sat on the mat", "b": "der hund und die katze"})
    rnd = random.Random(5)
    for _ in range(30):
        text = "".join(rnd.choices("thecasonmdrku ", k=rnd.randint(1, 60)))
        for k, source in enumerate(("the cat sat on the mat", "der hund und die katze")):
            phrases, run = 1, ""
            for c in text:
                if run + c in source:
                    run += c
                else:
                    phrases, run = phrases + 1, c if c in source else ""
            symbols = parser.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
            assert parser.phrases([symbols])[0, k] == phrases


@pytest.mark.parametrize("piece", [1, 2, 5, 17])
def test_pieces_lose_nothing(piece, monkeypatch):
    """However a text is cut, its phrases are those of the whole."""
    parser = langid.Parser({"a": "the cat sat on the mat and the cat ate the rat", "b": "der hund und die katze und der hund", "c": "x"})
    rnd = random.Random(piece)
    words = "the cat sat on mat and ate rat der hund und die katze zz".split()
    texts = ["".join(rnd.choices("thecasonmdrku ", k=rnd.randint(1, 80))) if k % 2 else " ".join(rnd.choices(words, k=rnd.randint(1, 30))) for k in range(40)] + ["", "12", "the cat sat on the mat" * 3]
    whole = [parser.predict([t]) for t in texts]
    symbols = [parser.symbol[np.frombuffer(t.encode("utf-32-le"), np.uint32)] for t in texts if t]
    want = parser.phrases(symbols)
    pieces = [x[c : c + piece] for x in symbols for c in range(0, len(x), piece)]
    goes_on = np.array([c > 0 for x in symbols for c in range(0, len(x), piece)])
    owner = np.array([i for i, x in enumerate(symbols) for _ in range(0, len(x), piece)])
    got = np.zeros_like(want)
    np.add.at(got, owner, parser.phrases(pieces, goes_on))
    assert np.array_equal(got, want)
    monkeypatch.setattr(langid, "PIECE", piece)
    assert [parser.predict([t]) for t in texts] == whole and parser.predict(texts) == tuple([w[k][0] for w in whole] for k in (0, 1))


def test_a_brute_force_identifier_agrees(spark):
    """The whole query on a small table against parses with plain string search."""
    rows = languages(9, 60) + [(900, "Der HUND und 12 die Katze!", "de"), (901, "", None)]
    docs = documents(spark, rows)
    learnt = langid.learn(docs)
    texts = {n: "".join(c if c.isalpha() else " " for c in t.lower()) for n, t in learnt.items()}

    def cost(text, source):
        phrases, run = 1, ""
        for c in text:
            if run + c in source:
                run += c
            else:
                phrases, run = phrases + 1, c if c in source else ""
        return phrases * np.log2(max(2, len(source)))

    for r in langid.digest(langid.identify(docs, docs)).collect():
        text = "".join(c if c.isalpha() else " " for c in next(t for i, t, _ in rows if i == r.doc_id).lower())
        costs = {n: cost(text, source) for n, source in texts.items()}
        want = min(costs, key=lambda n: costs[n]) if text.strip() else "und"
        assert r.lang_pred == want
        if want != "und":
            best, second = sorted(costs.values())[:2]
            assert r.score == pytest.approx(second / (second + best))


def toxic_rows(seed, n=240):
    rnd = random.Random(seed)
    words = [f"word{k}" for k in range(150)]
    rows, labels = [], []
    for k in range(n):
        text = rnd.choices(words, k=rnd.randint(5, 80))
        bad = rnd.random() < 0.3
        if bad:
            for _ in range(rnd.randint(1, 4)):
                text.insert(rnd.randrange(len(text)), rnd.choice(["idiotic", "Scumbag", "trashy"]) + rnd.choice(["", "s", "est"]))
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(bad) if rnd.random() > 0.03 else int(not bad)))
    return rows, labels


def test_toxic_documents_are_found(spark):
    rows, labels = toxic_rows(1)
    df = documents(spark, rows, extra="score")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(toxicity.score(df, given)).collect()}
    truth = {i: any(w in t for w in ("idiotic", "Scumbag", "trashy")) for i, t in rows}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 20 and sum((got[i].score >= 0.5) == truth[i] for i in held) >= 0.95 * len(held)
    kept = toxicity.reject_toxic(documents(spark, rows), given)
    assert sum(truth[r.doc_id] for r in kept.collect()) <= 0.05 * sum(truth.values()) + 1 and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_scores_do_not_depend_on_ids_or_labels(spark):
    rows, labels = toxic_rows(2, 120)
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model_rows = documents(spark, rows)
    other = documents(spark, [(i + 1000, t, "xx", "yy") for i, t in rows])
    a = {r.doc_id: r.score for r in toxicity.score(model_rows, given).collect()}
    b = {r.doc_id - 1000: r.score for r in toxicity.score(other, given, learn_from=model_rows).collect()}
    assert a == b


def test_labels_are_used_up_to_the_stated_bound():
    assert toxicity.MAX_LABELLED == toxicity.learn.__kwdefaults__["max_labelled"] == 3000


def test_odd_toxicity(spark):
    rows, labels = toxic_rows(3, 90)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = documents(spark, odd_texts())
    assert all(0 <= r.score < 0.5 for r in toxicity.score(odd, none).collect())
    given = spark.createDataFrame([*labels, (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(odd, given, learn_from=documents(spark, rows)).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd.limit(0), given).count() == 0


def test_posterior_trusts_many_voters_over_one_label():
    rng = np.random.default_rng(1)
    truth = rng.random(500) < 0.4
    votes = (rng.random((500, 6)) < np.where(truth[:, None], 0.7, 0.02)).astype(float)
    labels = np.where(rng.random(500) < 0.1, ~truth, truth).astype(float)
    p = toxicity.posterior(votes, labels, np.ones(500))
    assert ((p > 0.5) == truth).mean() > 0.97 > (labels == truth).mean()


def naive_posterior(votes, labels, parents, rounds):
    """The same model with loops; ``parents`` gives the forest of each round."""
    n, m = len(votes), len(votes[0]) if len(votes) else 0
    p = [0.1 + 0.8 * y for y in labels]
    for r in range(rounds):
        q = [toxicity.ANCHOR * (0.1 + 0.8 * y) + (1 - toxicity.ANCHOR) * x for x, y in zip(p, labels, strict=True)]
        mass = [[1 - x for x in q], q]
        odds = [np.log(sum(mass[1]) / sum(mass[0]))] * n
        for c, sign in ((0, -1), (1, 1)):
            total = sum(mass[c])
            rate = [(sum(w for w, v in zip(mass[c], votes, strict=True) if v[j]) + 0.5) / (total + 1) for j in range(m)]

            def joint(j, a, k, b):
                base = (rate[j] if a else 1 - rate[j]) * (rate[k] if b else 1 - rate[k])
                return (sum(w for w, v in zip(mass[c], votes, strict=True) if v[j] == a and v[k] == b) + 0.5 * base) / (total + 0.5)

            for j in range(m):
                k = parents[r][j]
                for i in range(n):
                    a = votes[i][j]
                    if k < 0:
                        k_ = (j - 1) % m
                        chance = joint(j, a, k_, 0) + joint(j, a, k_, 1)
                    else:
                        b = votes[i][k]

                        def mass_of(c_, a_, j=j, k=k, b=b):
                            return sum(w for w, v in zip(mass[c_], votes, strict=True) if v[j] == a_ and v[k] == b)

                        pooled = (mass_of(0, a) + mass_of(1, a) + 0.5) / (sum(mass_of(x, z) for x in (0, 1) for z in (0, 1)) + 1)
                        chance = (mass_of(c, a) + toxicity.SHARED * pooled) / (mass_of(c, 0) + mass_of(c, 1) + toxicity.SHARED)
                    odds[i] += sign * np.log(chance)
        alone = [1 / (1 + np.exp(-o)) for o in odds]
        right = min(0.97, max(0.05, sum(q * y for q, y in zip(alone, labels, strict=True)) / (sum(alone) + 1e-9)))
        wrong = min(0.9, max(0.02, sum((1 - q) * y for q, y in zip(alone, labels, strict=True)) / (sum(1 - q for q in alone) + 1e-9)))
        p = [1 / (1 + np.exp(-(o + (np.log(right / wrong) if y else np.log((1 - right) / (1 - wrong)))))) for o, y in zip(odds, labels, strict=True)]
    return np.clip(p, 0.01, 0.99)


@pytest.mark.parametrize("seed", range(5))
def test_posterior_equals_a_plain_one(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(8, 30)), int(rng.integers(2, 6))
    votes = (rng.random((n, m)) < 0.4).astype(float)
    votes[:, 1] = np.where(rng.random(n) < 0.9, votes[:, 0], votes[:, 1])  # two that hang together
    labels = (rng.random(n) < 0.5).astype(float)
    labels[:2] = 0, 1
    parents, own = [], toxicity.dependencies
    monkeypatch.setattr(toxicity, "dependencies", lambda *x: parents.append(own(*x)) or parents[-1])
    got = toxicity.posterior(votes, labels, np.ones(n), rounds=3)
    assert np.allclose(got, naive_posterior(votes.astype(int).tolist(), labels.tolist(), parents, 3))


def test_dependencies_are_the_best_forest():
    from itertools import product

    rng = np.random.default_rng(3)
    votes = (rng.random((60, 4)) < 0.5).astype(float)
    votes[:, 2] = np.where(rng.random(60) < 0.85, votes[:, 0], votes[:, 2])
    masses = [rng.random(60), rng.random(60)]
    tables = [toxicity._tables(votes, q) for q in masses]
    gain = np.zeros((4, 4))
    for q, mass in zip(tables, masses, strict=True):
        for i, j in product(range(4), repeat=2):
            for a, b in product((0, 1), repeat=2):
                gain[i, j] += mass.sum() / sum(x.sum() for x in masses) * q[i, j, a, b] * np.log(q[i, j, a, b] / (q[i, j, a].sum() * q[i, j, :, b].sum()))

    def is_forest(parents):
        return all(any(k < 0 for k in _up(parents, j)) for j in range(4))

    def _up(parents, j):
        for _ in range(5):
            j = parents[j]
            yield j
            if j < 0:
                return

    for least in (0.0, 0.02, 10.0):
        found = toxicity.dependencies(tables, [q.sum() for q in masses], least)
        value = lambda ps: sum(gain[j, k] - least for j, k in enumerate(ps) if k >= 0)
        best = max(value(ps) for ps in product(range(-1, 4), repeat=4) if is_forest(ps))
        assert is_forest(found.tolist()) and np.isclose(value(found), best)


def test_the_sample_is_bounded_where_ids_repeat(spark):
    rows, labels = toxic_rows(5, 40)
    given = spark.createDataFrame(labels * 3, "doc_id long, quality int, toxic int")
    many = documents(spark, [(i, f"{t} {k}") for i, t in rows for k in range(30)])
    sample, totals = toxicity.labelled_sample(many, given, text="text", doc_id="doc_id", label="toxic", max_labelled=15)
    assert totals == {k: sum(x[2] == k for x in labels) for k in (0, 1)}
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {0: 15, 1: min(15, 30 * totals[1])}
    assert toxicity.score(many, given, max_labelled=15).count() == len(rows) * 30


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_models(n):
    places = [(0, 0), (0, 1), (1, 1)][: [0, 2, 3][n]]
    model = toxicity.fit(np.array([1, 0][:n]), np.array([r for r, _ in places], np.int64), np.array([c for _, c in places], np.int64), np.array([5, 9], np.uint64), np.ones(n)).prepare()
    assert 0 <= model.scores(np.frombuffer(b"abc def", np.uint8), np.array([0, 7]))[0] <= 1


def test_lexicon_votes_need_no_labels(spark):
    """A stem of the lexicon that no labelled row has taught is still a voter, seen as a word and as the start of one."""
    hashes, stems = toxicity.lexicon_hashes()
    data = np.frombuffer(b"IDIOTIC idiot hello", np.uint8)
    found, _ = toxicity._levels(*toxicity.features(data, np.array([0, len(data)])))
    k = toxicity.LEXICON.index("idiot")
    assert np.isin(hashes[stems == k], found).all() and not np.isin(hashes[stems == toxicity.LEXICON.index("moron")], found).any()
