"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions only.

Every document of a source has the same fractional number of copies, target over
size of the source.  The whole part is taken outright; the fractional parts are
rounded together: a pair of documents trades words, in a random direction that
keeps both expectations, until one of them holds a whole copy or none.  Words, not
documents, are what a trade keeps constant, and large documents are decided before
small ones, so a source misses its target by less than one small document.
Documents meet in groups of about ``FAN`` by hash; the one fractional document that
a group may leave moves to a group of at most ``FAN`` of the next level, a reduction
tree of logarithmic depth in which no task ever holds more than a few groups.

Random numbers are hashes of the ids, so reruns agree whatever the partitioning.

Edge cases: a null or empty text has size 0 and takes 0; a null source is a source
of its own, sorted last; rows equal in id, source and text are counted first and
dealt with a running number, so a huge group of them spreads over all groups;
an empty table gives an empty result; targets of sources without words are 0.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoplex.llm import storage
from orthoplex.llm.ranges import running

FAN, SPAN = 64, 4096
MAX_BROADCAST_SOURCES = 100_000
OUTPUT = ["size", "source_size", "target", "taken"]


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, few: bool = False) -> DataFrame:
    """``sizes`` (source, source_size, ...) with ``target``; ``few``: in one task, which needs no jobs of its own.

    Sharing the excess over a cap by weight until nothing exceeds one ends where the
    level x of target = min(cap, x * weight) spends the whole amount; of the levels
    found by capping the first k sources (least cap for their weight), x is the largest.
    """
    ranked = running(sizes, [F.col("source").asc_nulls_last()], {}, few)
    weighted = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))).drop("place")
    capped = weighted.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    cumulated = running(capped, [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], {"cap": "caps", "weight": "spent"}, few)
    whole = Window.partitionBy()
    sums = [F.sum("source_size").alias("words"), F.sum("weight").alias("weights")]
    totals = [x.over(whole) for x in (F.sum("source_size"), F.sum("weight"))] if few else [F.lit(x or 0) for x in weighted.agg(*sums).first()]
    summed = cumulated.withColumn("words", totals[0].cast("double")).withColumn("weights", totals[1])
    level = F.max((F.col("words") * F.lit(share) - F.col("caps")) / (F.col("weights") - F.col("spent")))
    level = level.over(whole) if few else F.lit(float(summed.agg(level).first()[0] or 0.0))
    levelled = summed.withColumn("level", level)
    return levelled.select(*sizes.columns, F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def _uniform(*columns: Column) -> Column:
    return (F.xxhash64(*columns).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that stands in the expression once, however often it is used: plans stay small."""
    return F.transform(F.array(value), use)[0]


def _near(p: Column) -> Column:
    return (p < 1e-9) | (p > 1 - 1e-9)


def _decided(unit: Column, take: Column) -> Column:
    return F.struct(unit.alias("unit"), take.cast("int").alias("take"))


def _trade(state: Column, x: Column, seed: int) -> Column:
    """One step of a group's fold: the pending document trades with the next until one of them is whole or empty."""
    a = state["pending"]
    sa, sb, pa, pb = a["unit"]["size"].cast("double"), x["unit"]["size"].cast("double"), a["p"], x["p"]

    def chosen(v: Column) -> Column:
        rise = _uniform(a["unit"]["h"], x["unit"]["h"], F.lit(seed)) * (v["up"] + v["down"]) < v["down"]
        return F.struct(v["up"].alias("up"), v["down"].alias("down"), rise.alias("rise"))

    def moved(v: Column) -> Column:
        first = F.when(v["rise"], (1 - pa) * sa <= pb * sb).otherwise(pa * sa <= (1 - pb) * sb)  # whether the pending one is decided
        return F.struct(v["rise"].alias("rise"), first.alias("first"), F.when(v["rise"], v["up"]).otherwise(-v["down"]).alias("moved"))

    def settled(v: Column) -> Column:
        decided = _decided(F.when(v["first"], a["unit"]).otherwise(x["unit"]), v["rise"] == v["first"])
        left = F.struct(F.when(v["first"], x["unit"]).otherwise(a["unit"]).alias("unit"), F.when(v["first"], pb - v["moved"] / sb).otherwise(pa + v["moved"] / sa).alias("p"))
        return F.struct(decided.alias("decided"), left.alias("left"))

    def traded(v: Column) -> Column:
        left, near = v["left"], _near(v["left"]["p"])
        last = F.when(near, F.array(_decided(left["unit"], left["p"] > 0.5))).otherwise(F.slice(state["done"], 1, 0))
        return F.struct(F.when(~near, left).alias("pending"), F.concat(state["done"], F.array(v["decided"]), last).alias("done"))

    up, down = F.least((1 - pa) * sa, pb * sb), F.least(pa * sa, (1 - pb) * sb)
    pair = _let(_let(_let(_let(F.struct(up.alias("up"), down.alias("down")), chosen), moved), settled), traded)
    whole = F.struct(a.alias("pending"), F.concat(state["done"], F.array(_decided(x["unit"], pb > 0.5))).alias("done"))
    return F.when(_near(pb), whole).when(a.isNull(), F.struct(x.alias("pending"), state["done"].alias("done"))).otherwise(pair)


def _tree(units: DataFrame, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Of ``units`` (source, groups, unit, p; ``most`` groups in a source at most) the decided ones (source, unit, take), and of each source the one that is left (source, unit, p), if any."""
    level = units.select("source", F.pmod(F.xxhash64("unit.h", F.lit(seed)), "groups").alias("bucket"), "unit", "p")
    unit_type = units.schema["unit"].dataType.simpleString()
    parts = []
    while True:
        empty = F.struct(F.lit(None).cast(f"struct<unit:{unit_type},p:double>").alias("pending"), F.array().cast(f"array<struct<unit:{unit_type},take:int>>").alias("done"))
        grouped = level.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(F.struct(F.col("unit.h").alias("o"), "unit", "p"))).alias("xs"))
        folded = grouped.select("source", "bucket", F.aggregate("xs", empty, lambda s, x: _trade(s, F.struct(x["unit"].alias("unit"), x["p"].alias("p")), seed)).alias("s"))
        kept = storage.stored(folded.select("source", "bucket", "s.pending", "s.done"), "rounding")
        parts.append(kept.select("source", F.explode("done").alias("x")).select("source", "x.unit", "x.take"))
        left = kept.where("pending is not null")
        if most <= 1:
            return reduce(DataFrame.unionByName, parts), left.select("source", "pending.unit", "pending.p")
        level = left.select("source", F.floor(F.col("bucket") / FAN).alias("bucket"), "pending.unit", "pending.p")
        most = -(-most // FAN)


def _by_lot(left: DataFrame, seed: int) -> DataFrame:
    """The last of each source, decided by its probability: (source, unit, p, take)."""
    return left.withColumn("take", (_uniform(F.col("unit.h"), F.lit(seed + 1000)) < F.col("p")).cast("int"))


def _size_class(size: Column) -> Column:
    return F.floor(F.log2(size)).cast("int")


def _split(sources: DataFrame) -> DataFrame:
    """In place of each source's ``classes`` (cls, words, largest, units): pool, the words of its small documents; limit, their largest class; large and small, the groups of either."""
    def grown(s: Column, y: Column) -> Column:
        pool = s["pool"] + y["words"]
        enough = pool * F.least(F.col("p"), 1 - F.col("p")) >= F.array_max("classes.largest")
        return F.when(s["limit"].isNotNull(), s).otherwise(F.struct(pool.alias("pool"), F.when(enough, y["cls"]).alias("limit")))

    none = F.struct(F.lit(0).cast("long").alias("pool"), F.lit(None).cast("int").alias("limit"))
    found = sources.withColumn("__s", F.aggregate("classes", none, grown)).withColumn("limit", F.coalesce("__s.limit", F.lit(64)))

    def groups(keep: Callable[[Column], Column]) -> Column:
        return F.ceil(F.aggregate(F.filter("classes", keep), F.lit(0).cast("long"), lambda n, y: n + y["units"]) / FAN)

    return found.select(*[c for c in sources.columns if c != "classes"], F.col("__s.pool").alias("pool"), "limit", groups(lambda y: y["cls"] > F.col("limit")).alias("large"), groups(lambda y: y["cls"] <= F.col("limit")).alias("small"))


def round_together(units: DataFrame, large: int, small: int, n_sources: int, seed: int = 5) -> DataFrame:
    """``units`` (source, is_large, groups, unit: struct with h, size and its source's pool, p strictly between 0 and 1, equal within a source) with ``take``, 0 or 1, in place of p.

    Large documents come first, in at most ``large`` groups of a source.  The one that is
    left of them is decided by lot, and the words this adds or lacks are spread evenly over
    the probabilities of the small documents (the smallest size classes whose words suffice
    for that), which are rounded then: a source misses its target by less than one small
    document, and every expectation is kept.
    """
    decided, left = _tree(units.where("is_large"), large, seed)
    last = _by_lot(left, seed)
    shifts = last.select("source", ((F.col("take") - F.col("p")) * F.col("unit.size") / F.col("unit.pool")).alias("shift"))
    shifted = _with_source(units.where("not is_large"), shifts, n_sources, "left")
    more, end = _tree(shifted.withColumn("p", F.col("p") - F.coalesce("shift", F.lit(0.0))), small, seed)
    return reduce(DataFrame.unionByName, [decided, last.drop("p"), _by_lot(end, seed).drop("p"), more])


def _with_source(df: DataFrame, by_source: DataFrame, n_sources: int, how: str = "inner") -> DataFrame:
    """Joins what is known of each source: by broadcast while sources are few, else with the hot ones salted."""
    right = by_source.withColumnRenamed("source", "__source")
    same = F.col("source").eqNullSafe(F.col("__source"))
    if n_sources <= MAX_BROADCAST_SOURCES:
        return df.join(F.broadcast(right), same, how).drop("__source")
    salts = 64
    left = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    right = right.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, same & (F.col("__salt") == F.col("__other")), how).drop("__source", "__salt", "__other")


def plan(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 5) -> DataFrame:
    """One row per document: doc_id, source, mark (a hash of its text), size, source_size, target, copies and taken (copies * size)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), word_count(F.col(text)).alias("size"))
    same = storage.stored(rows.groupBy("doc_id", "source", "mark", "size").agg(F.count("*").alias("same")), "sizes")
    words = F.sum(F.col("size") * F.col("same")).alias("words")
    classes = same.groupBy("source", _size_class(F.col("size")).alias("cls")).agg(words, F.max("size").alias("largest"), F.sum("same").alias("units"))
    listed = F.collect_list(F.when(F.col("words") > 0, F.struct("cls", "words", "largest", "units")))  # a source has at most 64 size classes
    sizes = storage.stored(classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.array_sort(listed).alias("classes")), "sources")
    n_sources = sizes.count()
    targets = source_targets(sizes, weights=weights, share=share, cap=cap, few=n_sources <= MAX_BROADCAST_SOURCES)
    rates = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = rates.withColumn("base", F.floor(F.col("rate") + 1e-9)).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.floor(F.col("rate") + 1e-9))).drop("rate")
    sources = storage.stored(_split(rates), "targets")
    most = sources.where("p > 1e-9").agg(F.max("large"), F.max("small")).first()
    spans = same.withColumn("__span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("same") - 1) / SPAN))))  # so that no row holds a list as long as a group
    each = spans.withColumn("no", F.explode(F.sequence(F.col("__span") * SPAN + 1, F.least("same", (F.col("__span") + 1) * SPAN)))).drop("same", "__span")
    rated = _with_source(each, sources, n_sources)
    is_large = _size_class(F.col("size")) > F.col("limit")
    unit = F.struct(F.xxhash64("doc_id", "mark", "no", F.lit(seed)).alias("h"), "doc_id", "mark", "size", "base", "source_size", "target", "pool")
    open_ = (F.col("p") > 1e-9) & (F.col("size") > 0)
    marked = rated.select("source", open_.alias("open"), is_large.alias("is_large"), F.when(is_large, F.col("large")).otherwise(F.col("small")).alias("groups"), unit.alias("unit"), "p")
    units = storage.stored(marked, "units")
    drawn = round_together(units.where("open").drop("open"), most[0] or 0, most[1] or 0, n_sources, seed)
    out = drawn.unionByName(units.where("not open").select("source", "unit", F.lit(0).alias("take")))
    copies = F.col("unit.base") + F.col("take")
    return out.select("unit.doc_id", "source", "unit.mark", "unit.size", "unit.source_size", "unit.target", copies.alias("copies"), (copies * F.col("unit.size")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it. Rows equal in id, source and text count as copies of the one whose other columns hash least."""
    names = {k: how.get(k, v) for k, v in (("text", "text"), ("doc_id", "doc_id"), ("source", "source"))}
    own = "__mix"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    copies = plan(docs, **how).groupBy("doc_id", "source", "mark").agg(F.sum("copies").alias("copies"), F.count("*").alias("same"))
    copies = storage.stored(copies.select(*[F.col(c).alias(f"{own}_{c}") for c in ("doc_id", "source", "mark", "copies", "same")]), "copies")
    marked = docs.withColumn(f"{own}_text", F.xxhash64(F.coalesce(F.col(names["text"]), F.lit(""))))
    if (copies.agg(F.max(f"{own}_same")).first()[0] or 0) > 1:  # of equal ones the row whose other columns hash least
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = marked.groupBy(F.col(names["doc_id"]).alias(f"{own}_a"), F.col(names["source"]).alias(f"{own}_b"), F.col(f"{own}_text")).agg(F.min_by(row, F.struct(F.xxhash64(F.to_json(row)), F.to_json(row))).alias(f"{own}_row"))
        marked = one.select(f"{own}_row.*", f"{own}_text")
    on = F.col(names["doc_id"]).eqNullSafe(F.col(f"{own}_doc_id")) & F.col(names["source"]).cast("string").eqNullSafe(F.col(f"{own}_source")) & (F.col(f"{own}_text") == F.col(f"{own}_mark"))
    joined = marked.join(copies.where(F.col(f"{own}_copies") > 0), on)
    return joined.withColumn(f"{own}_copy", F.explode(F.sequence(F.lit(1).cast("long"), f"{own}_copies"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(planned: DataFrame) -> DataFrame:
    return planned.select("doc_id", *OUTPUT)
