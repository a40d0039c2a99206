"""Benchmark decontamination.

A broadcast hash set of the normalised n-grams of the test items is scanned
against every token window of the training texts; each hash hit is verified
word for word, and the words inside verified windows are the contaminated
spans.  Spans or whole documents can then be removed.

Plan: one map over the documents, no shuffle.  What is broadcast comes from the
benchmark alone and its size is checked: items are dealt into blocks of at most
``block_bytes`` of text, each block is one more map in the same stage.

Edge cases: a null or empty text has no words and is never contaminated; an
item with fewer than ``n`` words (but one at least) is a single window; null
texts and null ids of items are ignored; equal windows of several items count
for each of them; repeated document rows are judged each on its own; columns
of the input named like an output column are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from orthoplex.llm import arrowtext as at

WORD = at.table(set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100)))
_WORD_RE = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TO_LOWER = bytes(at.LOWER)

OUTPUT = ["n_words", "n_hit", "hit_items", "hit_spans"]
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_FILTER_BITS = 22


def normalised_words(text: str) -> list[bytes]:
    """A-Z lower-cased; runs of digits, letters and bytes beyond ASCII."""
    return _WORD_RE.findall(text.encode("utf-8", "surrogatepass").translate(_TO_LOWER))


class WindowIndex:
    """Windows of the items by the hash of their words, with a bitmap in front.

    Holds the items' words once and, for each window length, sorted hashes and where
    each window begins; the words themselves decide whether a hash is a hit.
    """

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        texts = [(i, t.encode("utf-8", "surrogatepass").translate(_TO_LOWER)) for i, t in items if i is not None and t is not None]
        self.ids = [i for i, _ in texts]
        self.data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in texts], dtype=np.int64)])
        self.begins, self.ends, bounds = at.words(self.data, offsets, WORD) if len(self.data) else (np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64))
        counts = np.diff(bounds)
        self.item = np.repeat(np.arange(len(texts)), counts)
        hashes = at.span_hashes(self.data, self.begins, self.ends)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.known: dict[tuple[int, int], dict[bytes, tuple]] = {}
        width = np.minimum(counts, n)
        for size in np.unique(width[width > 0]).tolist():
            whole = np.flatnonzero(width[self.item] == size)
            starts = whole[whole + size <= bounds[self.item[whole] + 1]]
            grams = at.ngram_hashes(hashes, size)[starts]
            order = np.argsort(grams, kind="stable")
            bitmap = np.zeros(1 << _FILTER_BITS, bool)
            bitmap[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.sizes[size] = (grams[order], starts[order], bitmap)

    @staticmethod
    def _window(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, k: int, size: int) -> bytes:
        return b" ".join(data[a:b].tobytes() for a, b in zip(begins[k : k + size].tolist(), ends[k : k + size].tolist(), strict=True))

    def _items(self, size: int, gram: np.uint64) -> dict[bytes, tuple]:
        """Ids of the items by window, of all windows with this hash."""
        key = (size, int(gram))
        if key not in self.known:
            grams, starts, _ = self.sizes[size]
            found: dict[bytes, set] = defaultdict(set)
            for k in starts[np.searchsorted(grams, gram, "left") : np.searchsorted(grams, gram, "right")].tolist():
                found[self._window(self.data, self.begins, self.ends, k, size)].add(self.ids[self.item[k]])
            self.known[key] = {w: tuple(i) for w, i in found.items()}
        return self.known[key]

    def hits(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, tuple]]:
        """First word, number of words and items of every verified occurrence."""
        out: list[tuple[int, int, tuple]] = []
        if not len(begins):
            return out
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        hashes = at.span_hashes(data, begins, ends)
        for size, (known, _, bitmap) in self.sizes.items():
            if len(begins) < size:
                continue
            grams = at.ngram_hashes(hashes, size)
            near = np.flatnonzero(bitmap[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            near = near[of[near] == of[near + size - 1]]
            at_known = np.minimum(np.searchsorted(known, grams[near]), len(known) - 1)
            near = near[known[at_known] == grams[near]]
            for k in near.tolist():
                items = self._items(size, grams[k]).get(self._window(data, begins, ends, k, size))
                if items is not None:
                    out.append((k, size, items))
        return out


_INDEX: dict[str, WindowIndex] = {}


def _index(shared) -> WindowIndex:
    if shared.id not in _INDEX:
        _INDEX.clear()
        _INDEX[shared.id] = WindowIndex(*shared.value)
    return _INDEX[shared.id]


class _Shared:
    """A broadcast with an id by which a worker keeps what it has built from it."""

    def __init__(self, broadcast, key: str) -> None:
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def _scan(batches: Iterator[pa.RecordBatch], shared: _Shared, text_at: int, item_type: pa.DataType, first: bool) -> Iterator[pa.RecordBatch]:
    """Adds the hits of one block of the benchmark; after the first block, merges with those found so far."""
    index = _index(shared)
    for batch in batches:
        raw, offsets = at.utf8(batch.column(text_at))
        n_words: list[int] = []
        n_hit: list[int] = []
        hit_items: list[list] = []
        hit_spans: list[list] = []
        keep = batch.num_columns - (0 if first else 4)
        old_items = None if first else batch.column(keep + 2).to_pylist()
        old_spans = None if first else batch.column(keep + 3).to_pylist()
        for i, j in at.chunks(offsets):
            data = at.LOWER[raw[offsets[i] : offsets[j]]]
            base = offsets[i : j + 1] - offsets[i]
            begins, ends, bounds = at.words(data, base, WORD)
            covered = np.zeros(len(begins) + 1, np.int32)
            items: dict[int, set] = defaultdict(set)
            for k, size, found in index.hits(data, begins, ends, bounds):
                covered[k] += 1
                covered[k + size] -= 1
                items[int(np.searchsorted(bounds, k, "right")) - 1].update(found)
            inside = np.cumsum(covered[:-1]) > 0
            for d in range(j - i):
                if not first and old_spans[i + d]:
                    for s in old_spans[i + d]:
                        a, b = bounds[d], bounds[d + 1]
                        inside[a:b] |= (begins[a:b] >= base[d] + s["begin"]) & (ends[a:b] <= base[d] + s["end"])
                    items[d].update(old_items[i + d])
            sums = np.concatenate([[0], np.cumsum(inside)])
            n_words += np.diff(bounds).tolist()
            counts = (sums[bounds[1:]] - sums[bounds[:-1]]).tolist()
            n_hit += counts
            for d, count in enumerate(counts):
                hit_items.append(sorted(items[d]) if count else [])
                hit_spans.append(_runs(inside[bounds[d] : bounds[d + 1]], begins[bounds[d] : bounds[d + 1]] - base[d], ends[bounds[d] : bounds[d + 1]] - base[d]) if count else [])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:keep], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hit_items, pa.list_(item_type)), pa.array(hit_spans, _SPANS)],
            [*batch.schema.names[:keep], *OUTPUT],
        )


def _runs(inside: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return [{"begin": int(begins[a]), "end": int(ends[b - 1])} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside benchmark windows), hit_items (sorted ids) and hit_spans (UTF-8 byte ranges)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = items.schema["i"].dataType
    arrow_kind = to_arrow_type(kind)
    out = at.drop_clashing(docs, OUTPUT)
    text_at = [c.lower() for c in out.columns].index(text.lower())
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", T.ArrayType(kind)), T.StructField("hit_spans", T.ArrayType(span))]
    schema = T.StructType([*out.schema.fields, *added])
    for k in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast(([(r[0], r[1]) for r in some.collect()], n))
        shared = _Shared(held, f"{spark.sparkContext.applicationId}-{held._jbroadcast.id()}")
        first = k == 0
        out = out.mapInArrow(lambda it, s=shared, f=first: _scan(it, s, text_at, arrow_kind, f), schema)
    return out


def contaminated(share_of_words: float = 0.05):
    """True where hit words are at least the given share of all words, and there are some."""
    inverse = round(1 / share_of_words)
    return (F.col("n_hit") > 0) & (F.col("n_hit") * inverse >= F.col("n_words"))


def _cut(batches: Iterator[pa.RecordBatch], text_at: int, spans_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = at.utf8(batch.column(text_at))
        spans = batch.column(spans_at).to_pylist()
        texts = batch.column(text_at).to_pylist()
        for d, some in enumerate(spans):
            if some:
                whole, kept, done = raw[offsets[d] : offsets[d + 1]].tobytes(), [], 0
                for s in some:
                    kept.append(whole[done : s["begin"]])
                    done = s["end"]
                texts[d] = b"".join([*kept, whole[done:]]).decode("utf-8", "replace")
        columns = list(batch.columns)
        columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", share_of_words: float = 0.05, **how) -> DataFrame:
    """Without contaminated documents (mode "documents"), or with the contaminated spans cut out of every text (mode "spans"). Columns as in ``docs``."""
    found = find_contamination(docs, benchmark, **how)
    kept = [c for c in found.columns if c not in OUTPUT]
    if mode == "documents":
        return found.where(~contaminated(share_of_words)).select(*[F.col(f"`{c}`") for c in kept])
    if mode != "spans":
        raise ValueError(f"unknown mode {mode!r}")
    text_at = [c.lower() for c in kept].index(how.get("text", "text").lower())
    spans_at = found.columns.index("hit_spans")
    return found.mapInArrow(lambda it: _cut(it, text_at, spans_at), found.schema).select(*[F.col(f"`{c}`") for c in kept])


def digest(found: DataFrame) -> DataFrame:
    """Per-document digest: counts, the sha256 of the comma-joined ids of the items, and the verdict."""
    ids = F.array_sort(F.transform("hit_items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (
  SELECT r, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k
        FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
h AS (SELECT r, k, iw.size, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.size = iw.size),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS p FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN s USING (r)
"""
