from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from orthoplex.llm import tokencount, tokenfile
from tests.llm.helpers import documents, odd_texts

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    *odd_texts(), (20, "don't  stop   \n\n'tis <|endoftext|>the end<|endoftext|>"), (21, "<|endoftext|>"), (22, "x" * 5000 + " " + "é" * 3000), (23, "tab\tnbsp\xa0zero​width\x1c sep"),
    (24, "Ⅻ ² ½ ٣ 漢字 ﬁ ß İ Σς"), (25, "'S 'LL we'Ve"), (26, "áͅ"),
]


def library(name):
    t = tokenizers.Tokenizer.from_file(P.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("hot", [5, 1000])
def test_counts_equal_the_library(spark, hot):
    ids = library("byte_bpe_50k.json")
    df = tokencount.count_tokens(documents(spark, TEXTS, extra="n_bytes"), P.path("byte_bpe_50k.json"), keep=["doc_id", "lang"], hot=hot)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in df.collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), len(ids(t))) for i, t in TEXTS), key=repr)


def test_other_tokenizers(spark):
    pieces = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = [t for t in TEXTS if t[1] is None or len(t[1]) < 1000]
    df = tokencount.count_tokens(documents(spark, docs), P.path("piece_bpe_32k.model"), keep=["doc_id"])
    assert sorted(((r.doc_id, r.n_tokens) for r in df.collect()), key=repr) == sorted(((i, len(pieces.encode(t or ""))) for i, t in docs), key=repr)
    ids = library("word_bpe_49k.json")
    df = tokencount.count_tokens(documents(spark, docs), P.path("word_bpe_49k.json"), keep=["doc_id"])
    assert sorted(((r.doc_id, r.n_tokens) for r in df.collect()), key=repr) == sorted(((i, len(ids(t))) for i, t in docs), key=repr)


def test_empty_table(spark, tmp_path):
    none = documents(spark, [])
    assert tokencount.count_tokens(none, P.path("byte_bpe_50k.json"), keep=["doc_id"]).count() == 0
    tokenfile.write_tokens(none, str(tmp_path / "t"), P.path("word_bpe_49k.json"), end_id=2)
    assert tokenfile.read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_files_round_trip(spark, tmp_path):
    encode = library("word_bpe_49k.json")
    rnd = random.Random(4)
    docs = TEXTS + [(100 + k, " ".join(rnd.choices(["Alpha", "beta!", "été", "9", "x-y"], k=rnd.randint(0, 400)))) for k in range(60)]
    path = str(tmp_path / "files")
    tokenfile.write_tokens(documents(spark, docs, extra="start"), path, P.path("word_bpe_49k.json"), end_id=2)
    got = tokenfile.read_tokens(spark, path).orderBy("start").collect()
    want = sorted(((i, encode(t) + [2]) for i, t in docs), key=lambda x: (x[0] is None, x[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert sorted((repr(r.doc_id), list(r.ids)) for r in got) == sorted((repr(i), ids) for i, ids in want)
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens


@pytest.mark.parametrize("seed", range(4))
def test_code(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 3000))
    counts = np.ceil(rng.pareto(0.4, n) * 10 + 1).astype(np.int64)
    lengths = tokenfile.code_lengths(counts, 13)
    assert lengths.max() <= 13 and sum(2.0 ** -lengths) <= 1 + 1e-12
    ids = np.sort(rng.choice(60_000, n, replace=False))
    code = tokenfile.Code(ids, lengths)
    blocks = [rng.choice(ids, int(rng.integers(1, 5000))) for _ in range(5)]
    packed = [code.pack(b) for b in blocks]
    out = code.unpack([p[0] for p in packed], [len(b) for b in blocks], [p[1] for p in packed])
    assert all(np.array_equal(a, b) for a, b in zip(out, blocks, strict=True))


def test_lengths_are_optimal_without_a_binding_limit():
    import heapq

    rng = np.random.default_rng(9)
    counts = rng.integers(1, 1000, 200)
    heap, total = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert int((tokenfile.code_lengths(counts, 40) * counts).sum()) == total


def test_words_equal_the_library(monkeypatch):
    """Random Latin-1 texts, with slices and a table of known words that are far too small."""
    monkeypatch.setattr(tokenfile, "SLICE", 300)
    monkeypatch.setattr(tokenfile, "CACHE_BYTES", 4000)
    encode, rnd = library("word_bpe_49k.json"), random.Random(3)
    encoder = tokenfile.Encoder(P.path("word_bpe_49k.json"), 2)
    signs = "abstmdrevl'' '\n\t.-!9²Àßÿ×÷µªº¼\x85\xa0\x1cZ"
    for _ in range(400):
        texts = ["".join(rnd.choices(signs, k=rnd.choice([0, 1, 5, 40, 900]))) for _ in range(rnd.randint(1, 5))] + rnd.sample(["漢字", "it's <|endoftext|>", "x" * 700], 1)
        assert [x.tolist() for x in encoder.encode(texts)] == [encode(t) for t in texts]


def test_a_huge_group_of_equal_rows(spark, tmp_path):
    path = str(tmp_path / "same")
    tokenfile.write_tokens(documents(spark, [(7, "the same words again")] * 3000 + [(1, "first")]), path, P.path("word_bpe_49k.json"), end_id=2)
    got = tokenfile.read_tokens(spark, path, with_ids=False).orderBy("start").collect()
    assert len(got) == 3001 and got[0].doc_id == 1 and [r.start for r in got[1:4]] == [got[0].n_tokens + k * got[1].n_tokens for k in range(3)]
