"""Token-id files: canonical length-limited Huffman code in independent blocks.

A file set is a folder with two tables.  ``codes`` (id, length) holds the code
lengths that global id counts give under a limit (package-merge); the canonical
code follows from them alone.  ``blocks`` holds the documents in ascending doc_id
order: each row is one block of whole documents, about ``BLOCK_IDS`` ids, with
``part`` and ``block`` (its place), ``ids_before`` (ids of earlier blocks of the
part), the ids and lengths of its documents, the code bits as bytes, most
significant bit first, and ``checkpoints``: the bit offset of every ``EVERY``-th
id.  Blocks decode on their own, and every checkpoint starts a lane of the
table-driven decoder, so all lanes of a block advance together.

Order: ascending doc_id, nulls last; equal ids by a hash of their token ids.
Edge cases: a null text counts as empty and holds the end id alone; repeated rows
are kept as separate documents; an empty table gives an empty file set; a document
longer than a block is a block of its own; columns besides id and text are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from orthoplex.llm import arrowtext as at
from orthoplex.llm import storage

BLOCK_IDS, EVERY, LIMIT = 1 << 16, 1024, 16

#: Bytes that the table of known words may take in each worker, and bytes of text handled at once.
CACHE_BYTES, SLICE = 48 << 20, 1 << 19

# The split pattern of this kind of vocabulary begins so; its classes for lower-cased characters below U+0100.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|"
_KIND = np.full(256, 3, np.uint8)  # neither of the following
_KIND[[*range(9, 14), 32, 0x85, 0xA0]] = 0  # white space
_KIND[[*range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 1  # letters
_KIND[[*range(48, 58), 0xB2, 0xB3, 0xB9, *range(0xBC, 0xBF)]] = 2  # numbers, each a word of its own
_LOWER = bytes(ord(chr(c).lower()) if c not in (0xD7,) and len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256))
_SHORT, _TWO = at.table(b"stmd"), {b"re", b"ve", b"ll"}


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of lower-cased Latin-1 bytes."""
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    begins = np.flatnonzero((kind != 0) & change[:-1])
    ends = np.flatnonzero((kind != 0) & change[1:]) + 1
    # an apostrophe alone before letters takes what a contraction takes of them
    quotes = np.flatnonzero((data[begins] == 39) & (ends - begins == 1) & (ends < len(data)))
    if len(quotes):
        after = ends[quotes]
        quotes, after = quotes[kind[after] == 1], after[kind[after] == 1]
        take = _SHORT[data[after]].astype(np.int64)
        for k in np.flatnonzero(take == 0).tolist():
            take[k] = 2 * (data[after[k] : after[k] + 2].tobytes() in _TWO)
        ends[quotes] += take
        begins[quotes + 1] += take
        full = begins < ends
        begins, ends = begins[full], ends[full]
    return begins, ends


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Known:
    """Words of at most 16 bytes, told apart by those bytes, with their ids; sorted by a hash of them."""

    def __init__(self, kind: str) -> None:
        self.hash, self.first, self.second = (np.empty(0, np.uint64) for _ in range(3))
        self.start, self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, kind)

    def find(self, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each word, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1)
        place = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where((self.hash[place] == h) & (self.first[place] == a) & (self.second[place] == b), place, -1)

    def add(self, h: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(h, kind="stable")
        start = len(self.ids) + np.cumsum(size) - size
        place = np.searchsorted(self.hash, h[order])
        self.hash = np.insert(self.hash, place, h[order])
        self.first = np.insert(self.first, place, a[order])
        self.second = np.insert(self.second, place, b[order])
        self.start = np.insert(self.start, place, start[order])
        self.size = np.insert(self.size, place, size[order].astype(np.int32))
        self.ids = np.concatenate([self.ids, ids])

    def merge(self, other: Known) -> None:
        self.add(other.hash, other.first, other.second, other.size.astype(np.int64), other.ids[_ranges(other.start, other.size.astype(np.int64))])

    def bytes(self) -> int:
        return 36 * len(self.hash) + self.ids.nbytes


def vocabulary_kind(path: str, end_id: int) -> str:
    """The type that holds all ids."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    last = max([end_id, *(t["id"] for t in said.get("added_tokens") or []), len((said.get("model") or {}).get("vocab") or ())])
    return "<u2" if last < 1 << 16 else "<u4"


class Encoder:
    """Token ids of texts, looking up each distinct word where that is exact.

    It is where the tokenizer lower-cases and splits by the pattern above, and the
    text has neither characters beyond U+00FF, zero bytes nor added tokens; else the library
    encodes the whole text.  Words are found and looked up by array operations; the
    library sees those that no earlier text of the worker had.
    """

    _open: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, end_id: int = 0) -> None:
        self.path, self.end_id, self.kind = path, end_id, vocabulary_kind(path, end_id)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.added = [t["content"] for t in said.get("added_tokens") or []]
        steps = [s.get("type") for s in (said.get("normalizer") or {}).get("normalizers", [])]
        before = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = [s for s in before if s.get("type") == "Split"]
        model = said.get("model") or {}
        suffix = model.get("end_of_word_suffix")
        self.by_word = bool(suffix) and steps == ["NFC", "Replace", "Lowercase"] and len(split) == 1 and split[0]["pattern"].get("Regex", "").startswith(_PATTERN) and split[0].get("invert", False)
        self._texts = None
        if self.by_word:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            # words are lower-cased and apart already
            said["normalizer"] = None
            said["pre_tokenizer"]["pretokenizers"] = [{"type": "WhitespaceSplit"}, *(s for s in before if s.get("type") != "Split")]
            said["truncation"] = said["padding"] = None
            self._words = Tokenizer.from_str(json.dumps(said))
            self.ends = np.zeros(max(model["vocab"].values(), default=0) + 1, bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
            self.known, self.young = Known(self.kind), Known(self.kind)  # the second takes what is new, and is small

    @classmethod
    def at(cls, path: str, end_id: int) -> Encoder:
        if (path, end_id) not in cls._open:
            cls._open.clear()
            cls._open[path, end_id] = cls(path, end_id)
        return cls._open[path, end_id]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if self._texts is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._texts = Tokenizer.from_file(self.path)
            self._texts.no_truncation()
            self._texts.no_padding()
        return [np.array(e.ids, self.kind) for e in self._texts.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single words and how many each has: encoded as one text and cut after every id that ends a word."""
        if not words:
            return np.empty(0, self.kind), np.empty(0, np.int64)
        ids = np.array(self._words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            each = self._library(words)
            return np.concatenate(each), np.array([len(x) for x in each])
        return ids.astype(self.kind), np.diff(ends, prepend=0)

    def _slice(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words of some bytes; where the words begin, and how many ids stand before each and in all."""
        begins, ends = split_words(data)
        size = ends - begins
        a, b = at.word_keys(data, begins, ends)
        h = at.mix(a + at.mix(b ^ np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(h, kind="stable")
        fresh = np.ones(len(order), bool)
        hs, as_, bs = h[order], a[order], b[order]
        fresh[1:] = (hs[1:] != hs[:-1]) | (as_[1:] != as_[:-1]) | (bs[1:] != bs[:-1])
        one = order[fresh]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(fresh) - 1
        found = [t.find(h[one], a[one], b[one]) for t in (self.known, self.young)]
        new = np.flatnonzero((found[0] < 0) & (found[1] < 0) | (size[one] > 16))
        at_new = one[new]
        text = data.tobytes().decode("latin-1")
        ids, many = self._each([text[i:j] for i, j in zip(begins[at_new].tolist(), ends[at_new].tolist(), strict=True)])
        count, start, flat, done = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), [], 0
        for table, place in zip((self.known, self.young), found, strict=True):
            place[new] = -1
            old = np.flatnonzero(place >= 0)
            count[old] = table.size[place[old]]
            start[old] = done + np.cumsum(count[old]) - count[old]
            flat.append(table.ids[_ranges(table.start[place[old]], count[old])])
            done += len(flat[-1])
        count[new], start[new] = many, done + np.cumsum(many) - many
        out = np.concatenate([*flat, ids])[_ranges(start[which], count[which])]
        if self.known.bytes() + self.young.bytes() + 36 * len(new) + ids.nbytes > CACHE_BYTES:
            self.known, self.young = Known(self.kind), Known(self.kind)
        short = size[at_new] <= 16
        keep = at_new[short]
        self.young.add(h[keep], a[keep], b[keep], many[short], ids[np.repeat(short, many)])
        if 8 * len(self.young.hash) > len(self.known.hash):
            self.known.merge(self.young)
            self.young = Known(self.kind)
        return out, begins, np.concatenate([[0], np.cumsum(count[which])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        parts: list[bytes] = []
        which: list[int] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            plain = None
            if self.by_word and "\0" not in text and not any(x in text for x in self.added):
                try:
                    plain = text.encode("latin-1")
                except UnicodeEncodeError:
                    pass
            if plain is None:
                whole.append(i)
            else:
                parts.append(plain)
                which.append(i)
        if parts:
            data = np.frombuffer(b" ".join(parts).translate(_LOWER), np.uint8)
            limits = np.cumsum([len(p) + 1 for p in parts])  # where the text after each begins
            ids, bounds, done, lo = [], np.zeros(len(parts) + 1, np.int64), 0, 0
            while lo < len(data):
                hi = min(len(data), lo + SLICE)
                while hi < len(data):  # up to white space, which no word crosses
                    gaps = np.flatnonzero(_KIND[data[hi : hi + SLICE]] == 0)
                    hi = min(len(data), hi + SLICE) if not len(gaps) else hi + int(gaps[0])
                    if len(gaps):
                        break
                some, begins, before = self._slice(data[lo:hi])
                inside = np.flatnonzero((limits > lo) & (limits <= hi)) if hi < len(data) else np.flatnonzero(limits > lo)
                bounds[inside + 1] = done + before[np.searchsorted(begins, limits[inside] - lo)]
                ids.append(some)
                done, lo = done + len(some), hi
            flat = np.concatenate(ids) if ids else np.empty(0, self.kind)
            for k, i in enumerate(which):
                out[i] = flat[bounds[k] : bounds[k + 1]]
        for i, found in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = found
        return out  # type: ignore[return-value]


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, ids, seen): a row per document, and at the end one row whose ``seen`` has the id counts of them all."""
    encoder = Encoder.at(path, end_id)
    end = np.array([end_id], encoder.kind)
    total = np.zeros(1, np.int64)
    names = ["doc_id", "n", "ids", "seen"]
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        i = 0
        while i < len(sizes):
            j, size = i, 0
            while j < len(sizes) and (j == i or size + sizes[j] <= SLICE):
                size += sizes[j]
                j += 1
            found = encoder.encode(pc.fill_null(batch.column(1).slice(i, j - i), "").to_pylist())
            seen = np.bincount(np.concatenate(found))
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
            total[: len(seen)] += seen
            payload = pa.array([np.concatenate([x, end]).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(x) + 1 for x in found], pa.int64()), payload, pa.nulls(j - i, pa.binary())], names)
            i = j
    used = np.flatnonzero(total)
    counts = np.column_stack([used, total[used]]).astype("<i8").tobytes()
    yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())], names)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for counts in batch.column(0).to_pylist():
            pairs = np.frombuffer(counts, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int32)), pa.array(pairs[:, 1])], ["id", "n"])


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of a minimum-redundancy prefix code with no code longer than ``limit``, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, kinds = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = len(level) // 2
        both = np.concatenate([leaves, level[: 2 * pairs : 2] + level[1 : 2 * pairs : 2]])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        kinds.append(rank < n)
    lengths, take = np.zeros(n, np.int64), 2 * (n - 1)
    for kind in reversed(kinds):
        mine = int(kind[:take].sum())
        lengths[:mine] += 1
        take = 2 * (take - mine)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of (id, length) pairs, as arrays for encoding and a table for decoding."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        self.longest = int(lengths.max(initial=1))
        spans = np.int64(1) << (self.longest - lengths)
        first = np.concatenate([[0], np.cumsum(spans)[:-1]]) if len(ids) else np.zeros(0, np.int64)
        size = int(ids.max(initial=0)) + 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[ids] = (first >> (self.longest - lengths)).astype(np.uint64)
        self.length[ids] = lengths
        self.symbols = np.zeros(1 << self.longest, np.uint32)
        self.steps = np.ones(1 << self.longest, np.uint8)
        self.symbols[: int(spans.sum())] = np.repeat(ids, spans)
        self.steps[: int(spans.sum())] = np.repeat(lengths, spans)

    def pack(self, ids: np.ndarray, every: int = EVERY) -> tuple[bytes, list[int]]:
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        at = ends - lengths
        word, used = at >> 5, (at & 31) + lengths
        shifted = self.code[ids] << (64 - used).astype(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out = np.zeros(int(word[-1]) + 2, np.uint32)
        out[word[starts]] |= np.bitwise_or.reduceat(shifted >> np.uint64(32), starts).astype(np.uint32)
        out[word[starts] + 1] |= np.bitwise_or.reduceat(shifted & np.uint64(0xFFFFFFFF), starts).astype(np.uint32)
        return out.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], at[::every].tolist()

    def unpack(self, bits: list[bytes], n_ids: list[int], checkpoints: list[list[int]], every: int = EVERY) -> list[np.ndarray]:
        """The ids of several blocks, all their lanes advancing together."""
        pad = b"\0" * 8
        data = np.frombuffer(b"".join(x + pad for x in bits), np.uint8).astype(np.uint32)
        windows = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        bases = np.cumsum([0, *[8 * (len(x) + 8) for x in bits]])[:-1]
        lanes = [len(c) for c in checkpoints]
        place = np.concatenate([np.array(c, np.int64) + b for c, b in zip(checkpoints, bases, strict=True)])
        many = np.full(len(place), every)
        lasts = np.cumsum(lanes) - 1
        many[lasts] = [n - (k - 1) * every for n, k in zip(n_ids, lanes, strict=True)]
        order = np.argsort(-many, kind="stable")
        place, sorted_many = place[order], many[order]
        out = np.zeros((len(place), every), np.uint32)
        rows = np.empty((every, len(place)), np.uint32)
        shift = np.uint32(32 - self.longest)
        alive = np.searchsorted(-sorted_many, -np.arange(every), "left")
        for j in range(int(sorted_many[0])):
            m = alive[j]
            p = place[:m]
            index = (windows[p >> 3] << (p & 7).astype(np.uint32)) >> shift
            rows[j, :m] = self.symbols[index]
            p += self.steps[index]
        out[order] = rows.T
        flat, result, row = out.reshape(-1), [], 0
        for n, k in zip(n_ids, lanes, strict=True):
            result.append(flat[row * every : row * every + n])
            row += k
        return result


_CODES: dict[str, Code] = {}


def _code(key: str, shared) -> Code:
    if key not in _CODES:
        _CODES.clear()
        _CODES[key] = Code(*shared.value)
    return _CODES[key]


_BLOCK = ["part", "block", "ids_before", "n_ids", "doc_ids", "doc_lengths", "checkpoints", "bits"]


def _write_blocks(batches: Iterator[pa.RecordBatch], key: str, shared, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    code, part = _code(key, shared), TaskContext.get().partitionId()
    before = block = 0
    docs: list = []
    payload: list[bytes] = []
    sizes: list[int] = []
    pending = 0

    def out() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(payload), f"<u{len(payload[0]) // sizes[0]}")
        bits, checkpoints = code.pack(ids)
        row = [part, block, before, len(ids), docs, sizes, checkpoints, bits]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], _BLOCK)

    for batch in batches:
        for doc, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if pending and pending + n > BLOCK_IDS:
                yield out()
                before, block, pending, docs, payload, sizes = before + pending, block + 1, 0, [], [], []
            docs.append(doc)
            payload.append(ids)
            sizes.append(n)
            pending += n
    if pending:
        yield out()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT) -> None:
    """Encodes every whole text, appends ``end_id``, and writes the file set at ``path`` (any store that Spark writes)."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = plain.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("seen", T.BinaryType())])
    encoded = plain.mapInArrow(lambda it: _encode(it, tokenizer, end_id, arrow_id), schema)
    # identical rows are told apart by a number, so that a huge group of them is not one range
    ids_path = storage.write(encoded.select("*", F.xxhash64("ids").alias("mark"), F.xxhash64(F.monotonically_increasing_id()).alias("row")), "token-ids")
    ids = spark.read.parquet(ids_path)
    seen = ids.where("seen is not null").select("seen").mapInArrow(_seen, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    documents = ids.where("n > 0")
    n_docs = documents.count()
    counts = seen.orderBy("id").toArrow()
    freq = np.zeros(max([end_id, *counts.column(0).to_pylist()]) + 1, np.int64)
    freq[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    freq[end_id] += n_docs
    symbols = np.flatnonzero(freq)
    freq = freq[symbols]
    lengths = code_lengths(freq, max(limit, int(np.ceil(np.log2(max(2, len(symbols)))))))
    spark.createDataFrame(list(zip(symbols.tolist(), lengths.tolist(), strict=True)), "id int, length int").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((symbols, lengths))
    order = [F.col("doc_id").asc_nulls_last(), F.col("mark"), F.col("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = documents.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    blocks = T.StructType([
        T.StructField("part", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("ids_before", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(id_type)),
        T.StructField("doc_lengths", T.ArrayType(T.LongType())),
        T.StructField("checkpoints", T.ArrayType(T.LongType())),
        T.StructField("bits", T.BinaryType()),
    ])
    ranged.mapInArrow(lambda it: _write_blocks(it, path, shared, arrow_id), blocks).write.option("compression", "none").parquet(f"{path}/blocks")
    storage.remove(spark, ids_path)


def _decode(batches: Iterator[pa.RecordBatch], key: str, shared, with_ids: bool) -> Iterator[pa.RecordBatch]:
    code = _code(key, shared)
    for batch in batches:
        for k in range(0, len(batch), 64):
            some = batch.slice(k, 64)
            n_ids = some.column(2).to_pylist()
            found = code.unpack(some.column(6).to_pylist(), n_ids, some.column(5).to_pylist())
            part, doc, start, size, crc, tokens = [], [], [], [], [], []
            for at_part, before, ids, docs, lengths in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), found, some.column(3).to_pylist(), some.column(4).to_pylist(), strict=True):
                view, done = memoryview(ids.astype("<u4").tobytes()), 0
                for d, n in zip(docs, lengths, strict=True):
                    part.append(at_part)
                    doc.append(d)
                    start.append(before + done)
                    size.append(n)
                    crc.append(zlib.crc32(view[4 * done : 4 * (done + n)]))
                    if with_ids:
                        tokens.append(ids[done : done + n].astype(np.int32))
                    done += n
            columns = [pa.array(part, pa.int32()), pa.array(doc, batch.schema.field(3).type.value_type), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, the ids, all decoded from the files."""
    codes = spark.read.parquet(f"{path}/codes").orderBy("id").toArrow()  # at most one row for each id of the vocabulary
    shared = spark.sparkContext.broadcast(tuple(codes.column(k).to_numpy().astype(np.int64) for k in (0, 1)))
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    id_type = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    rows = blocks.select("part", "ids_before", "n_ids", "doc_ids", "doc_lengths", "checkpoints", "bits").mapInArrow(lambda it: _decode(it, path, shared, with_ids), schema)
    joined = rows.join(F.broadcast(bases), "part")  # a row for each partition written
    return joined.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
