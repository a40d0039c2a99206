from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from orthoplex.llm import mixing
from orthoplex.llm.ranges import running
from tests.llm.helpers import documents, odd_texts, rows_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(seed, n=300, sources=5):
    rnd = random.Random(seed)
    return [(k, " ".join(["w"] * int(rnd.paretovariate(1) * 3 % 400)), "en", rnd.choice([*[f"s{j}" for j in range(sources)], "s0", "s0", None])) for k in range(n)]


def targets(rows, weights=(3, 1, 2), share=1.5, cap=2.0):
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        rest = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        out = {s: cap * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        more = {s for s in open_ if out[s] > cap * sizes[s] + 1e-9}
        if not more:
            return sizes, out
        full |= more


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_takings(spark, seed):
    rows = corpus(seed)
    sizes, want = targets(rows)
    got = mixing.plan(documents(spark, rows, extra="target")).collect()
    assert len(got) == len(rows)
    taken, largest, by_id = {}, {}, {r[0]: r for r in rows}
    for r in got:
        _, t, _, s = by_id[r.doc_id]
        assert r["size"] == len(WORD.findall(t)) and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_reruns_agree_whatever_the_partitions(spark):
    rows = corpus(4)
    one = mixing.digest(mixing.plan(documents(spark, rows))).collect()
    two = mixing.digest(mixing.plan(documents(spark, rows).repartition(7, "lang"))).collect()
    assert sorted(one) == sorted(two)


def test_expectations_hold(spark):
    rows = [(k, "w " * (1 + k % 5), "en", "s0" if k % 2 else "s1") for k in range(60)]
    total, runs = {}, 10
    for seed in range(runs):
        for r in mixing.plan(documents(spark, rows), weights=(1, 1), share=0.7, seed=seed).collect():
            total[r.doc_id] = total.get(r.doc_id, 0) + r.copies
    mean = sum(total.values()) / runs / len(rows)
    assert abs(mean - 0.7) < 0.05 and sum(0 < v < runs for v in total.values()) > 50


def test_odd_rows(spark):
    rows = [(i, t, "en", s) for (i, t), s in zip(odd_texts(), [None, "a", "a", "b", "b", "a", "a", "b", "b", None], strict=True)]
    got = mixing.plan(documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.plan(documents(spark, [])).count() == 0
    assert {r.target for r in mixing.plan(documents(spark, [(1, None), (2, "")])).collect()} == {0.0}
    same = mixing.plan(documents(spark, [(1, "a b c", "en", "s")] * 200 + [(2, "x", "en", "t")] * 50)).collect()
    assert len(same) == 250


def test_copies_as_rows(spark):
    rows = corpus(5, 80) + [(1, "same text here", "en", "s1")] * 4
    docs = documents(spark, rows)
    want = {}
    for r in mixing.plan(docs).collect():
        if r.copies:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    out = mixing.mix(docs)
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want and out.columns == docs.columns


def test_many_sources_join_without_broadcast(spark, monkeypatch):
    rows = corpus(6, 100)
    one = sorted(mixing.digest(mixing.plan(documents(spark, rows))).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted(mixing.digest(mixing.plan(documents(spark, rows))).collect()) == one


def test_running_places_and_sums(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("k"), (F.col("id") % 3).alias("v")).repartition(6)
    got = running(df, [F.col("k").asc()], {"v": "before"}).orderBy("k").collect()
    total = 0
    for place, r in enumerate(got):
        assert (r.place, r.before) == (place, total)
        total += r.v


def test_no_python_in_the_plan(spark):
    plan = mixing.plan(documents(spark, corpus(7, 30)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_equal_rows_and_clashing_names(spark):
    """Rows equal in id, source and text but not elsewhere: the same one is copied in every run, whatever the columns are called."""
    rows = [(1, "a b c d", "en", "s")] * 30 + [(2, "e f", "en", "s")] * 3
    docs = documents(spark, rows).withColumn("__mix_copies", F.monotonically_increasing_id() % 7).withColumn("__copy", F.lit(1)).withColumn("__text_mark", F.lit(2))
    one = sorted(map(tuple, mixing.mix(docs).collect()))
    assert one == sorted(map(tuple, mixing.mix(docs.repartition(5, "__mix_copies")).collect())) and mixing.mix(docs).columns == docs.columns and len({r[5] for r in one if r[0] == 1}) == 1


def test_a_huge_group_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 7)
    got = mixing.plan(documents(spark, [(1, "a b c", "en", "s")] * 500 + [(2, "x y", "en", "t")] * 40)).collect()
    assert len(got) == 540 and sum(r.taken for r in got if r.doc_id == 1) == pytest.approx(got[0].target if got[0].doc_id == 1 else next(r.target for r in got if r.doc_id == 1), abs=3)


def test_plans_stay_small(spark, monkeypatch):
    """What a plan's text and its joins cost the driver: the rounding's step stands in it once, and each source's facts are joined once."""
    plans, stored = [], mixing.storage.stored
    text = lambda df: df._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(mixing.storage, "stored", lambda df, name: plans.append(text(df)) or stored(df, name))
    plans.append(text(mixing.plan(documents(spark, corpus(8, 200)))))
    assert sum(p.count("Join ") for p in plans) <= 2 and max(map(len, plans)) < 20_000


def test_whole_units_in_a_tree(spark):
    """Units that nothing is left to decide of pass through the rounds as they are."""
    units = spark.range(200).selectExpr("'s' as source", "4L as groups", "named_struct('h', xxhash64(id), 'id', id, 'size', 10L) as unit", "case id % 4 when 0 then 0d when 1 then 1d else 0.5d end as p")
    done, left = mixing._tree(units, 4, 1)
    take = {r.unit.id: r.take for r in done.collect()}
    assert len(take) + left.count() == 200 and all(take[k] == k % 4 for k in range(200) if k % 4 < 2)
    assert abs(sum(v for k, v in take.items() if k % 4 > 1) - 50) <= 1


def test_running_over_few_rows(spark):
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    one, two = (running(df, [F.col("k").desc()], {"v": "before"}, few) for few in (False, True))
    assert rows_of(one, *one.columns) == rows_of(two, *one.columns) and one.dtypes == two.dtypes
