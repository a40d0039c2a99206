"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text.  A text is
parsed into longest matches with the labelled text of each language (the parsing
of Ziv and Merhav); the language that needs the fewest phrases, normalised by the
information one phrase carries, wins.  Case and everything but letters are folded
away first.  The parse runs for all texts and languages in step: a text of more
than ``PIECE`` letters is parsed in pieces of that length, every piece is a lane,
and one array operation advances all lanes by a character.  A piece begins with a
new phrase at first; then the state in which the piece before it ends is carried
over, and the piece is parsed again until both parses meet, which they soon do: the
phrases are those of the whole text.

Bounds: per language whole documents of ``TRAIN_DOC`` characters (least, most), in
the order of a hash of their ids, until they have ``train_chars`` characters; a
language that is still short of them goes on with its shorter documents, then with
pieces of its longer ones.  The ``MAX_LANGUAGES`` values with most rows are learnt
(more are no languages).  Only those texts are broadcast, and each worker builds its
automata once.

Edge cases: null, empty and letterless texts are ``und`` with score 0; null
languages teach nothing; without any labelled text every text is ``und``; ties go
to the language with more labelled rows; input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthoplex.llm import arrowtext as at

TRAIN_CHARS, TRAIN_DOC, PIECE, DOCS = 40_000, (200, 6000), 2048, 60
MAX_LANGUAGES = 1000
UNDETERMINED = "und"


def _folded(text: str) -> np.ndarray:
    """Code points, with everything but letters as a space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_is_letter(points), points, 32)


_LETTERS = np.zeros(0x110000, bool)


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _LETTERS[97]:
        _LETTERS[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _LETTERS[points]


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions (state, symbol) -> state or -1 of the automaton that accepts every substring."""
    step: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for s in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in step[p]:
            step[p][s] = new
            p = link[p]
        if p >= 0:
            q = step[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(s) == q:
                    step[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(step), width), -1, np.int32)
    for state, targets in enumerate(step):
        if targets:
            table[state, list(targets)] = list(targets.values())
    return table


class Parser:
    """Automata of all languages in one transition table."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.names = list(texts)
        folded = [_folded(texts[n]) for n in self.names]
        seen = np.unique(np.concatenate([np.array([32], np.uint32), *folded]))
        self.symbol = np.zeros(0x110000, np.uint8 if len(seen) < 256 else np.uint16)  # 0: in no labelled text
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        tables = [suffix_automaton(self.symbol[f].tolist(), width) for f in folded]
        self.roots = np.cumsum([0, *[len(t) for t in tables]])[:-1].astype(np.int64)
        self.table = np.concatenate([np.where(t >= 0, t + r, -1) for t, r in zip(tables, self.roots, strict=True)]).astype(np.int32) if tables else np.empty((0, width), np.int32)
        self.restart = np.where(self.table[self.roots] >= 0, self.table[self.roots], self.roots[:, None]) if tables else np.empty((0, width), np.int64)
        self.bits = np.log2([max(2, len(f)) for f in folded]) if tables else np.empty(0)
        self.width = width

    def _grid(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols by place and lane, the longest lane first; the lanes' order; how many reach each place."""
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((len(pieces), int(sizes[order[0]])), self.symbol.dtype)
        for row, i in enumerate(order):
            grid[row, : sizes[i]] = pieces[i]
        return np.ascontiguousarray(grid.T), order, np.searchsorted(-sizes[order], -np.arange(grid.shape[1]), "left")

    def _step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after a symbol, and where a phrase ended before it."""
        after = self.table.reshape(-1)[state * self.width + symbols]
        stop = after < 0
        return np.where(stop, self.restart[:, symbols], after), stop

    def _parse(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Number of phrases of each piece in each language, and the state in which each ends."""
        n, k = len(pieces), len(self.names)
        grid, order, alive = self._grid(pieces)
        state = np.repeat(self.roots[:, None], n, axis=1)
        count = np.ones((k, n), np.int64)
        for j in range(len(grid)):
            m = alive[j]
            state[:, :m], stop = self._step(state[:, :m], grid[j, :m].astype(np.int64))
            count[:, :m] += stop
        phrases, ends = np.empty((n, k), np.int64), np.empty((n, k), np.int64)
        phrases[order], ends[order] = count.T, state.T
        return phrases, ends

    def _carried(self, pieces: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many phrases more each piece has that begins in the given states rather than with a new phrase, and its states at the end."""
        grid, order, alive = self._grid(pieces)
        more, out = np.zeros(starts.shape, np.int64), ends.copy()
        lanes = np.arange(len(pieces))
        true, root = starts[order].T.copy(), np.repeat(self.roots[:, None], len(pieces), axis=1)
        change = np.zeros(true.shape, np.int64)
        for j in range(len(grid) + 1):
            over = len(lanes) and j < len(grid) and lanes[-1] < alive[j]
            met = (true == root).all(0)
            gone = met if j < len(grid) and over else met | (lanes >= (alive[j] if j < len(grid) else 0))
            if gone.any():
                left = lanes[gone]
                more[order[left]] = change[:, gone].T
                apart = ~met[gone]  # these end otherwise than they would after a new phrase
                out[order[left[apart]]] = true[:, gone][:, apart].T
                keep = ~gone
                lanes, true, root, change = lanes[keep], true[:, keep], root[:, keep], change[:, keep]
            if not len(lanes):
                break
            symbols = grid[j, lanes].astype(np.int64)
            true, stop = self._step(true, symbols)
            root, other = self._step(root, symbols)
            change += stop.astype(np.int64) - other
        return more - 1, out

    def phrases(self, pieces: list[np.ndarray], goes_on: np.ndarray | None = None) -> np.ndarray:
        """Number of phrases of each piece in each language; a piece that goes on begins in the state in which the one before it ends."""
        found, alone = self._parse(pieces)
        if goes_on is None or not goes_on.any():
            return found
        ends, total, done = alone.copy(), found.copy(), np.full(alone.shape, -1)
        todo = np.flatnonzero(goes_on)
        while len(todo):
            starts = ends[todo - 1]
            fresh = (done[todo] != starts).any(1)
            todo, starts = todo[fresh], starts[fresh]
            if not len(todo):
                break
            more, out = self._carried([pieces[i] for i in todo], starts, alone[todo])
            total[todo], done[todo] = found[todo] + more, starts
            moved = (ends[todo] != out).any(1)
            ends[todo] = out
            after = todo[moved] + 1
            todo = after[(after < len(pieces))]
            todo = todo[goes_on[todo]]
        return total

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.names:
            return names, scores
        folded = [t.lower() for t in texts]
        sizes = [len(t) for t in folded]
        whole = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = _is_letter(whole)
        symbols = self.symbol[np.where(letters, whole, 32)]
        ends = np.cumsum(sizes)
        lettered = np.concatenate([[0], np.cumsum(letters)])
        pieces, owner, goes_on = [], [], []
        for i, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
            if lettered[b] > lettered[a]:
                for c in range(int(a), int(b), PIECE):
                    pieces.append(symbols[c : min(c + PIECE, int(b))])
                    owner.append(i)
                    goes_on.append(c > a)
        if not pieces:
            return names, scores
        found = self.phrases(pieces, np.array(goes_on))
        total = np.zeros((len(texts), len(self.names)))
        np.add.at(total, np.array(owner), found)
        cost = total * self.bits
        for i in set(owner):
            best = int(np.argmin(cost[i]))
            rest = np.delete(cost[i], best)
            names[i] = self.names[best]
            scores[i] = float(rest.min() / (rest.min() + cost[i][best])) if len(rest) else 1.0
        return names, scores


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _kind(size: Column) -> Column:
    """0: fits TRAIN_DOC, 1: shorter, 2: longer; null for a null or empty text."""
    return F.when(size.between(*TRAIN_DOC), 0).when(size.between(1, TRAIN_DOC[0] - 1), 1).when(size > TRAIN_DOC[1], 2)


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train_chars: int = TRAIN_CHARS) -> dict[str, str]:
    """Labelled text per language, the most common language first, from rows that are not held out."""
    given = docs.select(F.col(doc_id).alias("i"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("i is not null and lang is not null").where(~held_out(F.col("i")))
    counts = {r[0]: r[1] for r in given.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}  # reads no text
    given = given.where(F.col("lang").isin(list(counts)))
    parts: dict[str, list[str]] = {}

    def fill(kind: int, cut: dict[str, float], piece: dict[str, int]) -> None:
        """Adds texts of a kind to each language of ``cut``, in the order of their hashes, from that share of the hashes."""
        if not cut:
            return
        ends = {x: min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * min(1.0, c))) for x, c in cut.items()}
        below = F.create_map(*[y for x, c in ends.items() for y in (F.lit(x), F.lit(c))])
        size = F.create_map(*[y for x in cut for y in (F.lit(x), F.lit(piece.get(x, TRAIN_DOC[1])))])
        rows = given.where(F.xxhash64("i") <= below[F.col("lang")]).where(_kind(F.length("text")) == kind)
        some = F.struct(F.xxhash64("i").alias("o"), F.expr("left(text, size)").alias("text"))
        for name, found in rows.withColumn("size", size[F.col("lang")]).groupBy("lang").agg(F.array_sort(F.collect_list(some)).alias("x")).collect():
            mine, texts = parts.setdefault(name, []), [t for _, t in found]
            for at_ in range(0, max(map(len, texts)), TRAIN_DOC[1]):  # a first piece of each text before any second one
                for t in texts:
                    if sum(map(len, mine)) >= train_chars:
                        break
                    mine += [t[at_ : at_ + TRAIN_DOC[1]]] if len(t) > at_ else []

    def short() -> list[str]:
        return [x for x in counts if sum(map(len, parts.get(x, ()))) < train_chars]

    # the documents with the least hashes, about 8 DOCS of each language, hold enough fitting ones in most languages
    fill(0, {x: 8 * DOCS / n for x, n in counts.items()}, {})
    again = short()
    if again:
        for x in again:
            parts.pop(x, None)
        held = given.where(F.col("lang").isin(again)).groupBy("lang", _kind(F.length("text")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.least(F.length("text"), F.lit(TRAIN_DOC[1]))).alias("chars")).where("kind is not null").collect()
        for kind in range(3):
            have = {r.lang: r for r in held if r.kind == kind}
            piece = {x: train_chars for x, r in have.items() if kind == 2 and r.chars < train_chars}
            before, times = {x: list(parts.get(x, ())) for x in have}, 4
            todo = [x for x in short() if x in have]
            while todo:
                cut = {x: (times * train_chars / (have[x].chars / have[x].n) + DOCS) / have[x].n for x in todo}
                for x in todo:
                    parts[x] = list(before[x])
                fill(kind, cut, piece)
                todo = [x for x in short() if x in cut and cut[x] < 1]
                times *= 8
    out = {x: "\n".join(p) for x, p in parts.items() if p}
    return {x: out[x] for x in sorted(out, key=lambda x: (-counts[x], x))}


_PARSERS: dict[str, Parser] = {}


def _predict(batches: Iterator[pa.RecordBatch], key: str, shared, text_at: int) -> Iterator[pa.RecordBatch]:
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(shared.value)
    parser = _PARSERS[key]
    for batch in batches:
        column = batch.column(text_at)
        _, offsets = at.utf8(column)
        names: list[str] = []
        scores: list[float] = []
        for i, j in at.chunks(offsets, 4 << 20):
            a, b = parser.predict(pc.fill_null(column.slice(i, j - i), "").to_pylist())
            names += a
            scores += b
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, labelled: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """``docs`` with lang_pred and score (0.5: a tie with the second language; 1: no other)."""
    docs = at.drop_clashing(docs, ["lang_pred", "score"])
    shared = docs.sparkSession.sparkContext.broadcast(learn(labelled, text=text, **how))
    key = f"{docs.sparkSession.sparkContext.applicationId}-{shared._jbroadcast.id()}"
    text_at = [c.lower() for c in docs.columns].index(text.lower())
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(lambda it: _predict(it, key, shared, text_at), schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
