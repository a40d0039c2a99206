"""Repeated runs of lines, found with the suffix order of line-id sequences.

The corpus is one long sequence of line ids (lines with a word, white space at the
ends aside), documents in ascending order, a break after each.  Prefix doubling
ranks all suffixes by their first 1, 2, 4, ... lines, each round joining a rank
with the rank half a length further on; suffixes whose prefix occurs once are
dropped at once, since no repeated run begins there.  Two suffixes share their
first m lines exactly if they agree in the ranks of the two powers of two that
overlap to m: those sets are the intervals of the suffix order with a longest
common prefix of m or more, and the earliest member of each keeps its lines.

A run counts when it has ``min_words`` words.  Every repeated run is the union of
its windows that reach that many words and are minimal from their first or from
their last line, so only those windows are looked up, and rounds end at the longest
of them (at most ``min_words`` lines): the number of rounds does not grow with the
documents.  Copies after the earliest are deleted; overlapping windows merge into
maximal runs by themselves.

Nothing is collected but counts; a line that many documents share is one rank, and
the joins on ranks are plain equi-joins whose hot keys adaptive execution splits.

Edge cases: a null text is empty; blank lines are neither compared nor deleted;
repeated rows are documents of their own, after the first in the order of (doc_id,
content hash); null ids sort last; lines are told apart by two 64-bit hashes; extra
columns are kept, columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoplex.llm import arrowtext as at
from orthoplex.llm import storage
from orthoplex.llm.ranges import running

MIN_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"
OUTPUT = ["n_lines", "n_deleted", "deleted_lines", "deduped_text"]


def _lines(docs: DataFrame) -> DataFrame:
    """(rid, no, seq, h1, h2, words) of every line with a word; seq counts those lines."""
    split = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("no"), F.btrim(x, F.lit(" \t\r\x0b\x0c")).alias("line")))
    each = docs.select("rid", F.posexplode(F.filter(split, lambda x: x["line"] != "")).alias("seq", "x"))
    return each.select("rid", F.col("x.no").alias("no"), "seq", F.xxhash64(F.lit(1), "x.line").alias("h1"), F.xxhash64(F.lit(2), "x.line").alias("h2"), F.regexp_count("x.line", F.lit(_WORD)).cast("long").alias("words"))


def _windows(active: DataFrame, min_words: int) -> DataFrame:
    """(pos, m): windows of m repeated lines with ``min_words`` words, minimal from their first or their last line."""
    run = active.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("rid").orderBy("pos")))
    w = Window.partitionBy("rid", "run")
    ends = run.withColumn("b", F.sum("words").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("a", F.col("b") - F.col("words"))
    ahead, back = w.orderBy("a").rangeBetween(0, min_words - 1), w.orderBy("b").rangeBetween(-(min_words - 1), 0)
    found = ends.select("pos", F.count("*").over(ahead).alias("m1"), F.sum("words").over(ahead).alias("w1"), F.count("*").over(back).alias("m2"), F.sum("words").over(back).alias("w2"))
    first = found.where(F.col("w1") >= min_words).select("pos", F.col("m1").cast("int").alias("m"))
    last = found.where(F.col("w2") >= min_words).select((F.col("pos") - F.col("m2") + 1).alias("pos"), F.col("m2").cast("int").alias("m"))
    return first.union(last).distinct()


def _ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(pos, rank): suffixes by the order of ``keys``, those alone with theirs dropped."""
    groups = pairs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)  # ``running`` deals them anew by range
    order = running(groups, [F.col(k).asc() for k in keys], {}).withColumnRenamed("place", "rank")
    return storage.stored(pairs.join(order, keys).select("pos", "rank"), "ranks")


def suffix_ranks(first: DataFrame, rounds: int) -> list[DataFrame]:
    """Rank tables (pos, rank) by the first 1, 2, 4, ... lines of each suffix, from (pos, h1, h2)."""
    levels = [_ranked(first, ["h1", "h2"])]
    for k in range(rounds):
        here = levels[-1].select("pos", F.col("rank").alias("r1"))
        ahead = levels[-1].select((F.col("pos") - (1 << k)).alias("pos"), F.col("rank").alias("r2"))
        levels.append(_ranked(here.join(ahead, "pos"), ["r1", "r2"]))
    return levels


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(pos) of every line that stands in a run of ``min_words`` words which occurs before; from (rid, pos, h1, h2, words)."""
    spark = lines.sparkSession
    # written, so that the join meets plain exchanges on both sides and a hot line can be split
    twice = storage.stored(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "repeated-ids")
    active = storage.stored(lines.join(twice, ["h1", "h2"]).select("rid", "pos", "h1", "h2", "words"), "repeated-lines")
    windows = storage.stored(_windows(active.select("rid", "pos", "words"), min_words), "windows")
    longest = windows.agg(F.max("m")).first()[0]
    if longest is None:
        return spark.createDataFrame([], "pos long")
    levels = suffix_ranks(active.select("pos", "h1", "h2"), longest.bit_length() - 1)
    known = None
    for k, level in enumerate(levels):
        some = windows.where(F.col("m").between(1 << k, (2 << k) - 1))
        left = level.select("pos", F.col("rank").alias("r1"))
        right = level.select(F.col("pos").alias("tail"), F.col("rank").alias("r2"))
        found = some.join(left, "pos").withColumn("tail", F.col("pos") + F.col("m") - (1 << k)).join(right, "tail").select("pos", "m", "r1", "r2")
        known = found if known is None else known.unionByName(found)
    known = storage.stored(known, "window-ranks")
    earliest = storage.stored(known.groupBy("m", "r1", "r2").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select("m", "r1", "r2", "first"), "earliest")
    copies = known.join(earliest, ["m", "r1", "r2"]).where("pos > first")
    return copies.select(F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("m") - 1)).alias("pos")).distinct()


def _delete(batches: Iterator[pa.RecordBatch], text_at: int, lines_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        gone = batch.column(lines_at).to_pylist()
        for i, numbers in enumerate(gone):
            if numbers:
                drop = set(numbers)
                texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in drop)
        columns = list(batch.columns)
        columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with n_lines (with a word), n_deleted, deleted_lines (numbers from 0, blank lines included) and deduped_text."""
    docs = at.drop_clashing(docs, OUTPUT)
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != text.lower()]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = storage.stored(wide.withColumn("rid", F.monotonically_increasing_id()), "documents")
    plain = storage.stored(_lines(base), "lines")
    sizes = plain.groupBy("rid").agg((F.count("*") + 1).alias("places"))  # and a place that no line has, which ends every run
    ids = base.select("rid", "doc_id", F.xxhash64("text").alias("h")).join(sizes, "rid")
    order = running(ids, [F.col("doc_id").asc_nulls_last(), F.col("h").asc(), F.col("rid").asc()], {"places": "before"})
    lines = plain.join(order.select("rid", "before"), "rid").withColumn("pos", F.col("before") + F.col("seq"))
    lines = storage.stored(lines.select("rid", "no", "pos", "h1", "h2", "words"), "positions")
    gone = later_copies(lines.select("rid", "pos", "h1", "h2", "words"), min_words)
    marked = lines.select("rid", "no", "pos").join(gone.withColumn("gone", F.lit(True)), "pos", "left")
    per_doc = marked.groupBy("rid").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("no")))).alias("deleted_lines"))
    none: Column = F.array().cast("array<int>")
    joined = base.join(per_doc, "rid", "left").select("row", F.col("text").alias("old_text"), F.col("text").alias("deduped_text"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("deleted_lines", none).alias("deleted_lines"))
    cut = joined.mapInArrow(lambda it: _delete(it, 2, 4), joined.schema)
    named = [F.col("old_text").alias(c) if c.lower() == text.lower() else F.col(f"row.`{c}`") for c in docs.columns]
    return cut.select(*named, "n_lines", F.size("deleted_lines").cast("long").alias("n_deleted"), "deleted_lines", "deduped_text")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_deleted", "deleted_lines", F.sha2(F.coalesce("deduped_text", F.lit("")), 256).alias("text_sha256"), F.length("deduped_text").cast("long").alias("n_chars_left"))
