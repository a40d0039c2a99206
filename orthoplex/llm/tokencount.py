"""Token counts without token ids.

Byte-level BPE never merges across pre-tokens, so a text has as many tokens as
its pre-tokens have pieces.  Each document becomes its pre-token frequencies;
pieces are counted once per distinct pre-token and joined to them.

The join has two sides.  Frequent pre-tokens (at most ``hot`` of them, each at
most ``HOT_BYTES`` long, so the bound on what is broadcast is a product of two
parameters) are taken from a bounded sample of documents and broadcast; the rest,
about a twentieth of all occurrences of natural text, meet their counts in one
shuffle by pre-token.  The sample decides which side a pre-token takes, never a
count.  Long or unsampled pre-tokens in the shuffle may still be frequent; their side
of the join is split by adaptive execution.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); special tokens inside
a text are matched as the library does by default, one token each; repeated rows
are counted each; very long texts and pre-tokens are handled whole.  A tokenizer
without byte-level pre-tokens of its own is run over whole texts instead.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthoplex.llm import arrowtext as at
from orthoplex.llm import storage

HOT, HOT_BYTES, SAMPLE_DOCS = 200_000, 64, 20_000

# The pre-token pattern that byte-level BPE vocabularies of this kind are trained with, and Unicode white space.
_SPACE = "\t-\r \x85\xa0  -     　"
_LATIN_SPACE = "\t-\r \x85\xa0"
_LATIN_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_LATIN_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"

_ANY = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}", s=_SPACE))
_LATIN = re.compile(PATTERN.format(L=f"[{_LATIN_LETTER}]", N=f"[{_LATIN_NUMBER}]", l=_LATIN_LETTER, n=_LATIN_NUMBER, s=_LATIN_SPACE))


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text without special tokens; together they are the text."""
    return (_LATIN if text.isascii() or max(text) <= "\xff" else _ANY).findall(text)


class Library:
    """A tokenizer opened once per worker process."""

    _open: dict[str, Library] = {}

    def __init__(self, path: str) -> None:
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.byte_level, self.special, self.split = False, [], None
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        added = said.get("added_tokens") or []
        self.special = [t["content"] for t in added]
        before = said.get("pre_tokenizer") or {}
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        self.byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not said.get("normalizer") and plain
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @classmethod
    def at(cls, path: str) -> Library:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def counts(self, texts: list[str]) -> list[int]:
        if self.path.endswith(".model"):
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        return [len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies and the number of special tokens."""
        if self.split is None or not any(s in text for s in self.special):
            return Counter(pre_tokens(text)) if text else Counter(), 0
        parts = self.split.split(text)
        found: Counter = Counter()
        for part in parts:
            if part:
                found.update(pre_tokens(part))
        return found, len(parts) - 1


def _texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def _sample_counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    library, found = Library.at(path), Counter()

    def out() -> pa.RecordBatch:
        keys = [k for k in found if len(k.encode()) <= HOT_BYTES]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["token", "n"])

    for batch in batches:
        for text in _texts(batch.column(0)):
            found.update(library.frequencies(text)[0])
            if len(found) > 400_000:
                yield out()
                found.clear()
    yield out()


def _pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """token -> token, pieces."""
    library = Library.at(path)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(library.counts(batch.column(0).to_pylist()), pa.int64())], ["token", "pieces"])


def _known(batches: Iterator[pa.RecordBatch], path: str, hot, text_at: int, keep: list[int]) -> Iterator[pa.RecordBatch]:
    """Per document its bytes, the tokens of special and hot pre-tokens, and the frequencies of the others."""
    library, counts = Library.at(path), hot.value.get
    for batch in batches:
        texts = _texts(batch.column(text_at))
        size, known, rare, times = [], [], [], []
        for text in texts:
            frequencies, total = library.frequencies(text)
            others, often = [], []
            for token, n in frequencies.items():
                pieces = counts(token)
                if pieces is None:
                    others.append(token)
                    often.append(n)
                else:
                    total += n * pieces
            size.append(len(text) if text.isascii() else len(text.encode()))
            known.append(total)
            rare.append(others)
            times.append(often)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
            [*(batch.schema.names[k] for k in keep), "n_bytes", "known", "rare", "times"],
        )


def _whole(batches: Iterator[pa.RecordBatch], path: str, text_at: int, keep: list[int]) -> Iterator[pa.RecordBatch]:
    library = Library.at(path)
    for batch in batches:
        texts = _texts(batch.column(text_at))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(library.counts(texts), pa.int64())],
            [*(batch.schema.names[k] for k in keep), "n_bytes", "n_tokens"],
        )


def hot_pieces(docs: DataFrame, path: str, *, text: str = "text", hot: int = HOT, sample_docs: int = SAMPLE_DOCS) -> dict[str, int]:
    """Piece counts of at most ``hot`` pre-tokens that are frequent in a sample of about ``sample_docs`` documents."""
    texts = docs.select(F.col(text).alias("text"))
    n = texts.count()
    sample = texts.sample(min(1.0, sample_docs / n), seed=11) if n > sample_docs else texts
    seen = storage.stored(sample.mapInArrow(lambda it: _sample_counts(it, path), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "sample-counts")
    steps = [(r[0], r[1]) for r in seen.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().orderBy(F.desc("n")).collect()]
    least, total = steps[0][0] if steps else 1, 0
    for value, many in steps:
        total += many
        if total > hot:
            break
        least = value
    found = seen.where(F.col("n") >= least).select("token").limit(hot).mapInArrow(lambda it: _pieces(it, path), "token string, pieces long").toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None, hot: int = HOT, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The ``keep`` columns (all but the text, if not given) of ``docs`` with n_bytes and n_tokens of each whole text."""
    docs = at.drop_clashing(docs, ["n_bytes", "n_tokens", "known", "rare", "times", "rid"])
    names = keep if keep is not None else [c for c in docs.columns if c.lower() != text.lower()]
    own = "__text"
    while own in [c.lower() for c in names]:
        own += "_"
    docs = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).alias(own))
    text_at, kept = len(names), list(range(len(names)))
    schema = docs.drop(own).schema
    if not Library.at(path).byte_level:
        return docs.mapInArrow(lambda it: _whole(it, path, text_at, kept), schema.add("n_bytes", "long").add("n_tokens", "long"))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(hot_pieces(docs, path, text=own, hot=hot, sample_docs=sample_docs))
    wide = docs.drop(own).schema.add("n_bytes", "long").add("known", "long").add("rare", T.ArrayType(T.StringType())).add("times", T.ArrayType(T.IntegerType()))
    mapped = docs.mapInArrow(lambda it: _known(it, path, held, text_at, kept), wide)
    known = storage.stored(mapped.withColumn("rid", F.monotonically_increasing_id()), "frequencies")
    rare = known.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("token"), F.col("x.times").alias("n"))
    # written, so that the join meets plain exchanges on both sides and a token that many documents share can be split
    pieces = storage.stored(rare.select("token").distinct().withColumn("pieces", _count_udf(path)("token")), "pieces")
    sums = rare.join(pieces, "token").groupBy("rid").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    out = known.drop("rare", "times").join(sums, "rid", "left")
    return out.select(*[F.col(f"`{c}`") for c in names], "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def _count_udf(path: str) -> Callable:
    @F.pandas_udf("long")
    def count(tokens: pd.Series) -> pd.Series:
        return pd.Series(Library.at(path).counts(tokens.tolist()))

    return count
