"""Quality rules: base statistics, and lines labelled content or boilerplate.

A linear-chain conditional random field over the lines of a text (those with a
word) sees about twenty indicator features of each line; Viterbi decoding marks
every line, and the share of words that stand in content lines decides whether a
text is kept.  The field is trained on labelled documents: a bad document's lines are
boilerplate, a good one's are content but for notices and for lines that several
different documents of the sample share (headers, footers, licences), so that
training sequences change label and the chain's transitions carry the evidence of
neighbours.  Equal lines and words are told by their bytes, not by hashes.

Everything is one map over the documents without a shuffle; the field is a few
dozen numbers.  Bounds: at most ``max_labelled`` labelled documents of each class
train it (least hashes of ids and texts), in stretches of at most ``TRAIN_LINES``
lines, at most ``STRETCHES`` of a document.

Edge cases: a null, empty or wordless text has zero counts and fails the base
rules; null labels teach nothing; without labels of both classes every line is
content; repeated rows are judged each; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthoplex.llm import arrowtext as at
from orthoplex.llm.toxicity import labelled_sample

MAX_LABELLED, TRAIN_LINES, STRETCHES, CONTENT_SHARE = 1500, 80, 4, 0.5

#: Documents with different first lines that share a line make it boilerplate.
SHARED_BY = 3

#: Share of the training weight that good documents have: a lost good text costs more than a kept bad one.
CLEAN_WEIGHT = 0.85

_SYMBOL = at.table(b"#*$%&|<>")
_UPPER, _LETTER = at.table(range(65, 91)), at.table(set(range(65, 91)) | set(range(97, 123)) | set(range(0xC0, 0x100)))
_DIGIT, _BANG, _STOP = at.table(range(48, 58)), at.table(b"!"), at.table(b".!?:;\"'")
_NOTICES = b"license licensed license, license. copyright cookie cookies rights reserved reserved. subscribe login javascript privacy terms".split()
_NOTICES += [w.capitalize() for w in _NOTICES]
_N = np.concatenate([[0], np.cumsum([len(w) for w in _NOTICES])])


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return at.mix(a + at.mix(b))


NOTICE = _key(*at.word_keys(np.frombuffer(b"".join(_NOTICES), np.uint8), _N[:-1], _N[1:]))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
N_FEATURES = 20


class Lines:
    """Counts of each text and features of each of its lines with a word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n = len(offsets) - 1
        begins, ends, bounds = at.words(data, offsets, at.NOT_SPACE)
        inside = at.NOT_SPACE[data]
        of = np.repeat(np.arange(n), np.diff(bounds))
        self.n_words = np.diff(bounds)
        lead = np.concatenate([[0], np.cumsum(inside & ((data & 0xC0) != 0x80))])
        self.word_chars = lead[offsets[1:]] - lead[offsets[:-1]]
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        self.n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]

        # lines: after each text's start and each \n, up to the next
        breaks = np.flatnonzero(data == 10)
        starts = np.concatenate([offsets[:-1], breaks + 1])
        stops = np.concatenate([breaks, offsets[1:]])
        starts.sort()
        stops.sort()
        first = np.searchsorted(begins, starts)
        after = np.searchsorted(begins, stops)
        worded = first < after
        starts, stops, first, after = starts[worded], stops[worded], first[worded], after[worded]
        self.line_doc = of[first] if len(first) else np.empty(0, np.int64)
        again = _repeated_lines(data, self.line_doc, starts, stops)
        self.starts, self.stops = starts, stops
        self.n_dup_lines = np.bincount(self.line_doc[again], minlength=n)[:n] if len(first) else np.zeros(n, np.int64)

        a, b = at.word_keys(data, begins, ends)
        word = at.word_ids(a, b, ends - begins)
        grams = at.triples(word)
        valid = np.flatnonzero(of[:-2] == of[2:]) if len(of) > 2 else np.empty(0, np.int64)
        covered = np.zeros(len(begins) + 1, np.int32)
        if len(valid):
            twice = valid[_shared(of[valid], grams[valid])]
            np.add.at(covered, twice, 1)
            np.add.at(covered, twice + 3, -1)
        repeat = np.cumsum(covered[:-1]) > 0
        repeats = np.concatenate([[0], np.cumsum(repeat)])
        self.n_repeat_words = repeats[bounds[1:]] - repeats[bounds[:-1]]

        self.words = after - first
        self.features = self._features(data, starts, stops, first, after, begins, ends, word, np.isin(_key(a, b), NOTICE), repeats, again)
        self.bounds = np.searchsorted(self.line_doc, np.arange(n + 1))

    def _features(self, data, starts, stops, first, after, begins, ends, word, noted, repeats, again) -> np.ndarray:
        m = len(first)
        w = np.maximum(after - first, 1).astype(np.float64)

        def share(member: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(member[data], dtype=np.int64)])
            return (sums[stops] - sums[starts]).astype(np.float64)

        letters, upper = share(_LETTER) + 1e-9, share(_UPPER)
        signs, bangs, digits = share(_SYMBOL), share(_BANG), share(_DIGIT)
        line = np.repeat(np.arange(m), after - first)
        own = np.concatenate([np.arange(a, b) for a, b in zip(first, after, strict=True)]) if m else np.empty(0, np.int64)
        distinct = _distinct(line, word[own], m) / w
        notices = np.bincount(line[noted[own]], minlength=m)[:m] if m else np.empty(0)
        repeated = (repeats[after] - repeats[first]) / w
        size = (ends[np.maximum(after - 1, 0)] - begins[first]) / w if m else np.empty(0)
        closing = _STOP[data[ends[after - 1] - 1]] if m else np.empty(0, bool)
        return np.column_stack([
            np.ones(m), w <= 3, w <= 10, w > 60, signs / w > 0.05, signs / w > 0.3, signs / w > 1, upper / letters > 0.3, upper / letters > 0.7, bangs / w > 0.3,
            distinct < 0.8, (distinct < 0.5) & (w >= 8), digits / w > 0.5, closing, again, size > 12, size < 3.5, repeated > 0.5, repeated > 0.1, notices > 0,
        ]).astype(np.float64).reshape(m, N_FEATURES)


def _repeated_lines(data: np.ndarray, doc: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether an equal line of the same text stands before."""
    out, whole = np.zeros(len(doc), bool), data.tobytes()
    seen: set[bytes] = set()
    last = -1
    for k, (d, i, j) in enumerate(zip(doc.tolist(), starts.tolist(), stops.tolist(), strict=True)):
        if d != last:
            seen, last = set(), d
        line = whole[i:j]
        out[k] = line in seen
        seen.add(line)
    return out


def _order(group: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return np.lexsort((hashes, group))


def _earlier(group: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether an equal hash of the same group stands before."""
    out = np.zeros(len(group), bool)
    if len(group):
        order = _order(group, hashes)  # stable: equal ones stay in place
        g, h = group[order], hashes[order]
        out[order[1:]] = (g[1:] == g[:-1]) & (h[1:] == h[:-1])
    return out


def _shared(group: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether an equal hash of the same group stands anywhere else."""
    order = _order(group, hashes)
    g, h = group[order], hashes[order]
    same = np.zeros(len(g) + 1, bool)
    same[1:-1] = (g[1:] == g[:-1]) & (h[1:] == h[:-1])
    out = np.empty(len(g), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _distinct(group: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes of each group."""
    return np.bincount(group[~_earlier(group, hashes)], minlength=n)[:n].astype(np.float64)


# ---------------------------------------------------------------- conditional random field


class Field:
    """Weights of content against boilerplate per feature, and scores of the four transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def decode(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Viterbi: the best labels (1: content) of each text's lines."""
        gain = (features @ self.weights).tolist()
        out = np.ones(len(gain), np.int8)
        (stay0, to1), (to0, stay1) = self.moves.tolist()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            low, high = 0.0, gain[a]
            back = []
            for t in range(a + 1, b):
                x, y = low + stay0, high + to0
                u, v = low + to1, high + stay1
                back.append((x < y, u <= v))
                low, high = (y if x < y else x), (v if u <= v else u) + gain[t]
            label = int(high >= low)
            out[b - 1] = label
            for t in range(b - 2, a - 1, -1):
                label = int(back[t - a][label])
                out[t] = label
        return out


def train(features: list[np.ndarray], labels, steps: int = 160, l2: float = 2e-3, rate: float = 0.08) -> Field:
    """Maximum conditional likelihood by Adam, from the features of documents and the labels of their lines (one for all of them, or an array)."""
    start = Field(np.eye(N_FEATURES)[0], np.zeros((2, 2)))
    truth = [np.broadcast_to(np.asarray(y, np.int64), len(f)) for f, y in zip(features, labels, strict=True)]
    packed_y = np.concatenate(truth) if truth else np.empty(0, np.int64)
    if not len(packed_y) or packed_y.min() == packed_y.max():
        return start
    n, size = len(features), np.array([len(f) for f in features])
    longest = int(size.max())
    x = np.concatenate(features).astype(np.float32)
    mask = np.arange(longest) < size[:, None]
    y = np.zeros((n, longest), np.int64)
    y[mask] = packed_y
    good = np.array([t.mean() >= 0.5 for t in truth])
    share = np.where(good, CLEAN_WEIGHT / max(1, good.sum()), (1 - CLEAN_WEIGHT) / max(1, (~good).sum())) / size
    each = np.repeat(share, size)
    theta = np.concatenate([start.weights * 0.5, np.zeros(4)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    both = mask[:, 1:] * share[:, None]
    for step in range(1, steps + 1):
        moves = theta[N_FEATURES:].reshape(2, 2)
        gain = np.zeros((n, longest))
        gain[mask] = x @ theta[:N_FEATURES].astype(np.float32)
        e = np.stack([np.zeros_like(gain), gain], 2)
        alpha = np.empty((n, longest, 2))
        beta = np.zeros((n, longest, 2))
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(alpha[:, t - 1, :1] + moves[0], alpha[:, t - 1, 1:] + moves[1]) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            ahead = e[:, t + 1] + beta[:, t + 1]
            new = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        p1 = np.exp(alpha[..., 1] + beta[..., 1] - z[:, None])
        slope = ((packed_y - p1[mask]) * each) @ x
        joint = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                q = np.exp(np.minimum(alpha[:, :-1, i] + moves[i, j] + e[:, 1:, j] + beta[:, 1:, j] - z[:, None], 0.0))
                joint[i, j] = ((y[:, :-1] == i) * (y[:, 1:] == j) * both).sum() - (q * both).sum()
        g = np.concatenate([slope, joint.reshape(-1)]) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, quality -> quality, features of its lines as one list, hashes of its lines."""
    for batch in batches:
        raw, offsets = at.utf8(batch.column(0))
        lists, marks = [], []
        for i, j in at.chunks(offsets):
            data = raw[offsets[i] : offsets[j]]
            found = Lines(data, offsets[i : j + 1] - offsets[i])
            lines = at.span_hashes(data, found.starts, found.stops).view(np.int64)
            for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True):
                b = min(b, a + STRETCHES * TRAIN_LINES)
                lists.append(found.features[a:b].astype(np.int8).reshape(-1))
                marks.append(lines[a:b])
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.list_(pa.int8())), pa.array(marks, pa.list_(pa.int64()))], ["quality", "found", "marks"])


def line_labels(quality: list[int], features: list[np.ndarray], marks: list[np.ndarray]) -> list[np.ndarray]:
    """Labels of the lines of sampled documents: those of a good one are content, but for notices and for what documents share that begin differently."""
    heads: dict[int, set] = {}
    for lines in marks:
        for x in set(lines.tolist()):
            if len(own := heads.setdefault(x, set())) < SHARED_BY:
                own.add(int(lines[0]))
    return [np.array([int(q == 1 and f[k, -1] == 0 and len(heads[x]) < SHARED_BY) for k, x in enumerate(lines.tolist())], np.int64) for q, f, lines in zip(quality, features, marks, strict=True)]


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Field:
    rows, _ = labelled_sample(docs, labels, text=text, doc_id=doc_id, label=label, max_labelled=max_labelled)
    schema = T.StructType([T.StructField("quality", T.IntegerType()), T.StructField("found", T.ArrayType(T.ByteType())), T.StructField("marks", T.ArrayType(T.LongType()))])
    table = rows.mapInArrow(_collect, schema).toArrow()
    triples = [(int(q.as_py()), f.values.to_numpy().reshape(-1, N_FEATURES), x.values.to_numpy()) for q, f, x in zip(*(table.column(k) for k in range(3)), strict=True) if len(x.values)]
    triples.sort(key=lambda p: (p[0], len(p[1]), p[1].tobytes(), p[2].tobytes()))  # rows come in any order
    each = line_labels(*([p[k] for p in triples] for k in range(3)))
    cuts = [(f[a : a + TRAIN_LINES], y[a : a + TRAIN_LINES]) for (_, f, _), y in zip(triples, each, strict=True) for a in range(0, len(f), TRAIN_LINES)]
    return train([f for f, _ in cuts], [y for _, y in cuts])


def _judge(batches: Iterator[pa.RecordBatch], shared, text_at: int) -> Iterator[pa.RecordBatch]:
    field: Field = shared.value
    for batch in batches:
        raw, offsets = at.utf8(batch.column(text_at))
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for i, j in at.chunks(offsets):
            found = Lines(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            content = field.decode(found.features, found.bounds)
            good = np.bincount(found.line_doc, found.words * content, j - i) if len(content) else np.zeros(j - i)
            share = good / np.maximum(found.n_words, 1)
            for column, value in zip(columns, (found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words, share), strict=True):
                column.append(value)
        arrays = [pa.array(np.concatenate(c) if c else np.empty(0), pa.int64() if k < 5 else pa.float64()) for k, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *COUNTS, "content_share"])


def judge(docs: DataFrame, labels: DataFrame, *, text: str = "text", content_share: float = CONTENT_SHARE, learn_from: DataFrame | None = None, **how) -> DataFrame:
    """``docs`` with the base counts, content_share, base_failed and kept."""
    docs = at.drop_clashing(docs, [*COUNTS, "content_share", "base_failed", "kept"])
    field = learn(docs if learn_from is None else learn_from, labels, text=text, **how)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    text_at = [c.lower() for c in docs.columns].index(text.lower())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("content_share", T.DoubleType())])
    found = docs.mapInArrow(lambda it: _judge(it, shared, text_at), schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= content_share))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    return judge(docs, labels, **how).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "content_share")
