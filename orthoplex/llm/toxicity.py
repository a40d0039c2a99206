"""Toxicity by weak supervision.

Voters are a lexicon of insults and threats, which owes nothing to the labels, word
and word-start patterns that a bounded sample of labelled rows associates with
toxicity, and the annotator's own label.  A generative label model, fitted by
expectation maximisation, has as its parameters each voter's rate of firing in either
class (its accuracy) and the correlations of the voters: within a class a voter
depends on the class and on one other voter, along the tree of greatest mutual
information given the class (see ``posterior``).  Its posterior, not the raw label,
trains a linear classifier over presence of patterns, which then scores every whole
text in one map without a shuffle.

Bounds: at most ``max_labelled`` labelled rows of each class (least hashes of id and
text) shape the model; their features are counted by the executors, of which at most
``MAX_FEATURES`` and each row's places in them reach the driver; the model is at most
so many hashes and weights, which is what is broadcast.

Edge cases: null, empty and letterless texts get the score of no evidence; null
labels teach nothing; of several labels of one document each different one counts
once; repeated rows and ids stay within the bounds; without labels of both classes
every score is the share of toxic labels (0 if none); input columns named like an
output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthoplex.llm import arrowtext as at
from orthoplex.llm import storage

MAX_LABELLED, MAX_FEATURES, VOTERS, PREFIXES = 3000, 4096, 128, (3, 4, 5, 6, 7, 8)
_LETTER = at.table(set(range(0x61, 0x7B)) | set(range(0x80, 0x100)))
_BITS = 22

#: A pattern that a text has so many times is a feature (its hash with the lowest bits naming which).
TIMES, _BASE = (1, 2, 4), np.uint64((1 << 64) - 4)

#: Rows by which the classes share how voters hang together; least standard errors of a feature;
#: weight of the labels against the posterior where the parameters are estimated.
SHARED, FEATURE_Z, ANCHOR = 5.0, 2.5, 0.5

# Stems of insults and threats in the languages of common corpora; a word votes if it begins with one.
LEXICON = (
    "arsehole asshole bastard bitch bullshit coward cretin cunt damn dickhead disgust dumb fool freak fuck garbage hate idiot imbecil jerk kill loser lunatic maggot moron nazi parasit pathetic pervert pig psycho "
    "retard scum shit slut stupid suck subhuman trash ugly vermin whore worthless abschaum arsch bl\u00f6d dreck dumm fotze hass hurens idiotin mistk schei\u00df schlampe schwachk schwein trottel verlierer versager wertlos wichser "
    "abruti b\u00e2tard conard connard connasse cr\u00e9tin d\u00e9bile encul imb\u00e9cile merde nul ordure pourri salaud salope stupide basura bobo cabr\u00f3n escoria est\u00fapid gilipollas hijoputa idiota imb\u00e9cil in\u00fatil mierda pendejo perdedor puta tonto"
).split()

def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of word starts, and the text that each stands in (with repeats)."""
    lowered = at.LOWER[data]
    begins, ends, bounds = at.words(lowered, offsets, _LETTER)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    hashes, texts = [at.span_hashes(lowered, begins, ends)], [of]
    for k in PREFIXES:
        long = np.flatnonzero(ends - begins > k)
        b = begins[long]
        hashes.append(at.mix(at.span_hashes(lowered, b, b + k) + np.uint64(k)))
        texts.append(of[long])
    return np.concatenate(hashes), np.concatenate(texts)


def _levels(hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pattern of a text once for every number of ``TIMES`` that it reaches there, as keys (the lowest bits say which); by text."""
    bases = hashes & _BASE
    order = np.lexsort((bases, texts))
    h, t = bases[order], texts[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(fresh)
    many = np.diff(first, append=len(h))
    h, t = h[first], t[first]
    reached = [np.flatnonzero(many >= k) for k in TIMES]
    keys = np.concatenate([h[some] | np.uint64(level) for level, some in enumerate(reached)])
    owner = np.concatenate([t[some] for some in reached])
    order = np.argsort(owner, kind="stable")
    return keys[order], owner[order]


def lexicon_hashes() -> tuple[np.ndarray, np.ndarray]:
    """The feature hashes by which stems are seen (as a word, and as the start of one), and the stem of each."""
    hashes, stems = [], []
    for k, stem in enumerate(LEXICON):
        raw = stem.encode()[: PREFIXES[-1]]
        data = np.frombuffer(raw, np.uint8)
        whole = at.span_hashes(data, np.array([0]), np.array([len(raw)]))
        hashes += [whole, at.mix(whole + np.uint64(len(raw)))]
        stems += [k, k]
    return np.concatenate(hashes) & _BASE, np.array(stems)


def _distinct(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Keys of the patterns of some texts of a column at a time, and the text of each."""
    raw, offsets = at.utf8(column)
    for i, j in at.chunks(offsets):
        yield *_levels(*features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])), i, j


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, toxic -> of each feature hash the texts that have it, and the toxic ones of them."""
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for h, t, i, _ in _distinct(batch.column(0)):
            found, which = np.unique(h, return_inverse=True)
            n, fires = np.bincount(which, minlength=len(found)), np.bincount(which, toxic[i + t], len(found))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64()), pa.array(fires.astype(np.int64))], ["h", "n", "fires"])


def _placed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """text, toxic -> toxic, places of the text's features among the sorted chosen ones."""
    chosen: np.ndarray = shared.value
    for batch in batches:
        lists = []
        for h, t, i, j in _distinct(batch.column(0)):
            place = np.minimum(np.searchsorted(chosen, h), max(0, len(chosen) - 1))
            known = chosen[place] == h if len(chosen) else np.zeros(len(h), bool)
            place, t = place[known].astype(np.int32), t[known]
            cuts = np.searchsorted(t, np.arange(j - i + 1))
            lists += [place[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["toxic", "found"])


def _pairs(votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Mass of all pairs of voters as [i, j, value of i, value of j], from rows weighted by ``mass``."""
    both = (votes * mass[:, None]).T @ votes
    one, n = np.diag(both), mass.sum()
    q = np.empty((len(one), len(one), 2, 2))
    q[..., 1, 1], q[..., 1, 0], q[..., 0, 1] = both, one[:, None] - both, one[None, :] - both
    q[..., 0, 0] = n - one[:, None] - one[None, :] + both
    return np.maximum(q, 0)


def _tables(votes: np.ndarray, mass: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """P(i, j) of all pairs of voters, as in ``_pairs``."""
    n = mass.sum()
    rate = (mass @ votes + smooth) / (n + 2 * smooth)
    rates = np.stack([1 - rate, rate], 1)
    return (_pairs(votes, mass) + smooth * rates[:, None, :, None] * rates[None, :, None, :]) / (n + smooth)


def dependencies(tables: list[np.ndarray], masses: list[float], least: float) -> np.ndarray:
    """Of each voter the one it depends on, or -1: the forest of greatest mutual information given the class."""
    m = len(tables[0])
    gain = np.zeros((m, m))
    for q, mass in zip(tables, masses, strict=True):
        alone = q.sum(3)[..., :, None] * q.sum(2)[..., None, :]
        gain += mass / sum(masses) * (q * np.log(q / alone)).sum((2, 3))
    parent, best, free = np.full(m, -1), np.full(m, -np.inf), np.ones(m, bool)
    for _ in range(m):  # Prim's algorithm; an edge below ``least`` begins another tree
        k = int(np.argmax(np.where(free, best, -np.inf))) if np.isfinite(best[free]).any() else int(np.flatnonzero(free)[0])
        if best[k] < least:
            parent[k] = -1
        free[k] = False
        closer = free & (gain[k] > best)
        best[closer], parent[closer] = gain[k][closer], k
    return parent


def posterior(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Probability of class 1 from binary votes and a label that may be wrong.

    The model: P(class) P(label | class) times, over voters, P(vote | class, vote of the
    voter it depends on).  How two voters hang together is taken to be the same in both
    classes as far as ``SHARED`` rows say.  The label starts the estimate and then is one more voter,
    whose rates follow from how often it agrees with the others (and are kept off 0 and
    1, so it can be outvoted); it keeps ``ANCHOR`` of the weight in the estimates of the
    voters, so that no group of texts drifts to the other class as a whole.
    """
    n, m = weights.sum(), votes.shape[1]
    x, start = votes.astype(np.int8), 0.1 + 0.8 * labels
    p = start
    for _ in range(rounds):
        q = ANCHOR * start + (1 - ANCHOR) * p
        masses = [weights * (1 - q), weights * q]
        tables = [_tables(votes, q) for q in masses]
        parent = dependencies(tables, [q.sum() for q in masses], np.log(max(n, 2.0)) / max(n, 2.0))
        root = parent < 0
        odds = np.full(len(labels), np.log(masses[1].sum() / masses[0].sum()))
        if m:
            logs = []
            pairs = [_pairs(votes, q)[np.arange(m), parent] for q in masses]  # [voter, its value, value of its parent]
            common = (pairs[0] + pairs[1] + 0.5) / ((pairs[0] + pairs[1]).sum(1, keepdims=True) + 1)
            for q, own in zip(tables, pairs, strict=True):
                given = np.log((own + SHARED * common) / (own.sum(1, keepdims=True) + SHARED))
                given[root] = np.log(q[np.arange(m), np.arange(m) - 1].sum(2))[root][:, :, None]
                logs.append(given)
            odds = odds + (logs[1] - logs[0])[np.arange(m), x, x[:, parent]].sum(1)
        alone = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        right, wrong = (weights * alone) @ labels / (weights @ alone + 1e-9), (weights * (1 - alone)) @ labels / (weights @ (1 - alone) + 1e-9)
        right, wrong = np.clip(right, 0.05, 0.97), np.clip(wrong, 0.02, 0.9)
        odds = odds + np.where(labels > 0, np.log(right / wrong), np.log((1 - right) / (1 - wrong)))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return np.clip(p, 0.01, 0.99)


def _logistic(rows: np.ndarray, cols: np.ndarray, n: int, m: int, target: np.ndarray, weights: np.ndarray, l2: float = 0.3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on a binary sparse matrix, by accelerated gradient descent."""
    w, bias = np.zeros(m), float(np.log(np.average(target, weights=weights) / (1 - np.average(target, weights=weights))))
    base = bias
    v, vb, size = w.copy(), bias, weights.sum()
    seen = np.bincount(cols, weights[rows], m) + l2
    rate, k = 1.0 / np.maximum(seen, 1.0), 1.0
    breadth = max(1.0, np.bincount(rows, minlength=n).max() ** 0.5)
    for _ in range(steps):
        z = np.bincount(rows, v[cols], n) + vb
        g = weights * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        new = v - rate / breadth * 4 * (np.bincount(cols, g[rows], m) + l2 * v)
        new_bias = vb - g.sum() / size * 0.5
        nxt = (1 + (1 + 4 * k * k) ** 0.5) / 2
        v, vb = new + (k - 1) / nxt * (new - w), new_bias + (k - 1) / nxt * (new_bias - bias)
        w, bias, k = new, new_bias, nxt if nxt < 20 else 1.0
    return w, bias if np.isfinite(bias) else base


def _different(votes: np.ndarray, most: int, overlap: float = 0.75) -> list[int]:
    """At most ``most`` columns, in order, that overlap with no column taken before (as intersection over union)."""
    sizes, both = votes.sum(0), votes.T @ votes
    taken: list[int] = []
    for k in range(votes.shape[1]):
        shared = both[k, taken]
        if len(taken) < most and not np.any(shared > overlap * (sizes[k] + sizes[taken] - shared)):
            taken.append(k)
    return taken


class Model:
    """Sorted pattern hashes with a weight for each number of ``TIMES``, and a bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.hashes, place = np.unique(keys & _BASE, return_inverse=True)
        self.weights, self.bias = np.zeros((len(self.hashes), len(TIMES))), bias
        self.weights[place, (keys & ~_BASE).astype(np.int64)] = weights

    def prepare(self) -> Model:
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return self

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, m = len(offsets) - 1, len(self.hashes)
        h, t = features(data, offsets)
        near = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)]) if m else np.empty(0, np.int64)
        h, t = h[near] & _BASE, t[near]
        total = np.zeros(n)
        if len(h):
            place = np.minimum(np.searchsorted(self.hashes, h), m - 1)
            known = self.hashes[place] == h
            key, many = np.unique(t[known] * m + place[known], return_counts=True)
            for level, times in enumerate(TIMES):
                some = key[many >= times]
                total += np.bincount(some // m, self.weights[some % m, level], n)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40)))


def _association(n: np.ndarray, fires: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """Difference of a feature's rates in the classes over its standard error; 0 for rare ones."""
    p1, p0 = (fires + 0.1) / (pos + 0.2), (n - fires + 0.1) / (neg + 0.2)
    both = (n + 0.2) / (pos + neg + 0.4)
    z = (p1 - p0) / np.sqrt(both * (1 - both) * (1 / pos + 1 / neg) + 1e-9)
    return np.where(n < max(3, min(8, (pos + neg) // 400)), 0.0, z)


def fit(labels: np.ndarray, rows: np.ndarray, cols: np.ndarray, hashes: np.ndarray, weights: np.ndarray, tried: int = 0) -> Model:
    """A model from each sampled document's label and sampling weight, and the (row, column) places of its features among ``hashes``.

    ``tried`` is how many features these are the strongest of: what the strongest of so many would show by chance is the least that counts.
    """
    y = labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    n, pos = len(y), y.sum()
    seen, fires = np.bincount(cols, minlength=len(hashes)), np.bincount(cols, y[rows], len(hashes))
    z = _association(seen, fires, pos, n - pos)
    lexicon, stems = lexicon_hashes()
    stem_of = np.full(len(hashes), -1)
    if len(hashes):
        place = np.minimum(np.searchsorted(hashes, lexicon), len(hashes) - 1)
        stem_of[place[hashes[place] == lexicon]] = stems[hashes[place] == lexicon]
    said = np.zeros((n, len(LEXICON)), np.float32)
    said[rows[stem_of[cols] >= 0], stem_of[cols][stem_of[cols] >= 0]] = 1
    said = said[:, said.sum(0) > 0]
    least = max(FEATURE_Z, (2 * np.log(max(2, tried))) ** 0.5)
    useful = np.abs(z) > FEATURE_Z
    if not useful.any():
        useful[np.argsort(-np.abs(z), kind="stable")[:16]] = True
    chosen = np.flatnonzero(useful | (stem_of >= 0))
    rank = np.full(len(hashes), -1)
    rank[chosen] = np.arange(len(chosen))
    inside = rank[cols] >= 0
    r, c = rows[inside], rank[cols[inside]]
    order = np.argsort(-z[chosen], kind="stable")
    once = (hashes[chosen] & ~_BASE) == 0
    candidates = order[(z[chosen][order] > least) & once[order]][: 8 * VOTERS]
    place = np.full(len(chosen), -1)
    place[candidates] = np.arange(len(candidates))
    votes = np.zeros((n, len(candidates)), np.float32)
    vote = place[c] >= 0
    votes[r[vote], place[c[vote]]] = 1
    votes = votes[:, _different(votes, min(VOTERS, max(12, int(pos) // 3)))]
    soft = posterior(np.concatenate([said, votes], 1).astype(np.float64), y, weights)
    w, bias = _logistic(r, c, n, len(chosen), soft, weights)
    keep = np.abs(w) > 1e-3
    return Model(hashes[chosen][keep], w[keep], bias)


def held_out(doc_id: Column, fold: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % fold == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, *, text: str, doc_id: str, label: str, max_labelled: int, keep: Column | None = None) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of at most ``max_labelled`` documents of each of the classes 0 and 1, as a written table; and how many labels of each class there are.

    The least hashes of ids are taken, and of ids that several rows have the least hashes of texts.
    """
    given = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("label")).where(F.col("__id").isNotNull() & F.col("label").isin(0, 1))
    given = (given if keep is None else given.where(keep)).distinct()
    totals = {r[0]: r[1] for r in given.groupBy("label").count().collect()}

    def least(rows: DataFrame, *by: Column) -> DataFrame:
        return rows.where("label = 1").orderBy(*by).limit(max_labelled).unionByName(rows.where("label = 0").orderBy(*by).limit(max_labelled))

    picked = least(given, F.xxhash64("__id"), F.col("__id"))  # at most 2 * max_labelled ids
    rows = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("text")).join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
    rows = storage.stored(rows.select("__id", "text", "label"), "labelled")
    if rows.groupBy("label").count().where(F.col("count") > max_labelled).count():
        rows = storage.stored(least(rows, F.xxhash64("__id", "text"), F.col("__id")), "labelled")
    return rows.select("text", "label"), totals


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_labelled: int = MAX_LABELLED, fold: int = 5) -> Model:
    """Learns from labels of documents that are not held out, at most ``max_labelled`` of each class."""
    spark = docs.sparkSession
    rows, totals = labelled_sample(docs, labels, text=text, doc_id=doc_id, label=label, max_labelled=max_labelled, keep=~held_out(F.col("__id"), fold))
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    neg, pos = sizes.get(0, 0), sizes.get(1, 0)
    if not neg or not pos:
        return fit(np.array([1] * pos + [0] * neg), *(np.empty(0, np.int64),) * 2, np.empty(0, np.uint64), np.ones(pos + neg))
    counts = rows.mapInArrow(_counted, "h long, n long, fires long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("fires").alias("fires"))
    both = (F.col("n") + 0.2) / (neg + pos + 0.4)
    rates = (F.col("fires") + 0.1) / (pos + 0.2) - (F.col("n") - F.col("fires") + 0.1) / (neg + 0.2)
    strength = F.abs(rates) / F.sqrt(both * (1 - both) * (1 / pos + 1 / neg) + 1e-9)  # as in _association
    lexicon = lexicon_hashes()[0].view(np.int64).tolist()
    often = counts.where(F.col("n") >= max(3, min(8, (neg + pos) // 400)))
    often = storage.stored(often, "features")
    tried = often.count()
    top = often.orderBy(strength.desc(), "h").limit(MAX_FEATURES - len(lexicon)).select("h").toArrow().column(0).to_numpy()
    hashes = np.unique(np.concatenate([top, np.array(lexicon)]).view(np.uint64))
    shared = spark.sparkContext.broadcast(hashes)
    table = rows.mapInArrow(lambda it: _placed(it, shared), "toxic int, found array<int>").toArrow()
    y = table.column(0).to_numpy().astype(np.int64)
    lists = [x.values.to_numpy() for x in table.column(1)]
    order = sorted(range(len(y)), key=lambda i: (int(y[i]), len(lists[i]), lists[i].tobytes()))  # rows come in any order
    y, lists = y[order], [lists[i] for i in order]
    share = np.array([totals.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)])
    weights = share[y] / share[y].mean()
    return fit(y, np.repeat(np.arange(len(y)), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64), hashes, weights, tried)


_MODELS: dict[str, Model] = {}


def _score(batches: Iterator[pa.RecordBatch], key: str, shared, text_at: int) -> Iterator[pa.RecordBatch]:
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = shared.value.prepare()
    model = _MODELS[key]
    for batch in batches:
        raw, offsets = at.utf8(batch.column(text_at))
        found = [model.scores(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in at.chunks(offsets)]
        scores = np.concatenate(found) if found else np.empty(0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])


def score(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", learn_from: DataFrame | None = None, **how) -> DataFrame:
    """``docs`` and a column score, from 0 to 1. The model is learnt from ``learn_from`` (``docs``, if not given) and ``labels``."""
    docs = at.drop_clashing(docs, ["score"])
    model = learn(docs if learn_from is None else learn_from, labels, text=text, doc_id=doc_id, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = f"{docs.sparkSession.sparkContext.applicationId}-{shared._jbroadcast.id()}"
    text_at = [c.lower() for c in docs.columns].index(text.lower())
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(lambda it: _score(it, key, shared, text_at), schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **how) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more."""
    return score(docs, labels, **how).where(F.col("score") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(scored: DataFrame, fold: int = 5) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id"), fold), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
