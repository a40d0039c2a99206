from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_texts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


def test_every_query_is_whole(spark, entry):
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, query in entry.queries().items():
        if name.startswith("op"):
            assert query(spark, SF).count() == n["pages" if name.startswith("op4_") else "documents"], name


def test_sql_of_the_first_operator(spark, entry):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()["op1_decontamination"])
    names = [d[0] for d in cur.description]
    df = entry.queries()["op1_decontamination"](spark, SF)
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(repr, cur.fetchall()))


def test_pipeline_keeps_what_it_should(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        if k < 3:
            ids = {r.doc_id for r in out.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(out.toPandas(), out.schema) if k < 4 else out
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    last = docs.orderBy("start").collect()
    assert last[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(last, last[1:], strict=False))
    assert corpus_pipeline.run(spark, SF).count() == counts[5]


@pytest.fixture
def folder(spark, tmp_path):
    """Writes documents, labels and benchmark as the tables of a folder."""

    def write(docs, labels=(), items=()):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        for name, rows in (("labels", labels), ("benchmark", items)):
            schema = spark.read.parquet(f"{SF}/{name}.parquet").schema
            spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_odd_rows_pass_every_stage(spark, folder):
    import corpus_pipeline

    tale = [f"tale{k}" for k in range(60)]
    taken = [f"exam{k}" for k in range(40)]
    rows = [*odd_texts(), (20, " ".join(tale)), (21, " ".join(tale)), (22, " ".join([*tale, "more"])), (23, " ".join(taken)), (24, "kept because it is short and clean", None, None)]
    docs = documents(spark, rows, extra="n_tokens copies fp __mix_text label")
    sf = folder(docs, items=[{"item_id": 1, "text": " ".join(taken)}, {"item_id": 2, "text": None}])
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept.append(spark.createDataFrame(stage(spark, kept[-1], sf).collect(), docs.schema))
        assert kept[-1].schema == docs.schema, name
    ids = [sorted((r.doc_id for r in k.collect()), key=str) for k in kept]
    assert ids[1] == ids[0]  # no labels, nothing is toxic
    assert [i for i in ids[2] if i in (20, 21, 22)] == [20] and ids[2].count(6) == 1 and len([i for i in ids[2] if i in (1, 2, 3)]) == 1
    assert set(ids[3]) == set(ids[2]) - {23}
    assert set(ids[4]) <= set(ids[3]) and all(ids[4].count(i) <= 2 for i in ids[4])
    last = corpus_pipeline.STAGES[4][1](spark, kept[4], sf)
    assert last.count() == len(ids[4]) and sorted((r.doc_id for r in last.collect()), key=str) == ids[4]


def test_empty_tables(spark, folder):
    import corpus_pipeline

    sf = folder(documents(spark, []).where(F.lit(False)))
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_intermediates_need_a_shared_folder_on_a_cluster(spark):
    from orthoplex.llm import storage

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Context, type("Conf", (), {"get": staticmethod(lambda name, other: other)})

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session)
