"""Mixing sources to target weights by Pareto order sampling.

Targets: every source's share of all words follows its weight, but no source may be
repeated more than ``most`` times; what it cannot fill goes to the others by weight (the
water level is found exactly from the sorted sources). Within a source a document is expected
e = level x weight times, at most ``most``, at the level that meets the target; the weight is a
mild one of the document's length in ``mix_documents`` and the query, any column in
``mix_sizes``. The whole part of e is given as certain copies, and the rest, e - floor(e), is
the document's inclusion probability for one more copy.

The sample: with u a hash of the record, q = (u/(1-u)) / (p/(1-p)) orders a source's
documents, and the first of them, as many as fill the words that certain copies left open,
are taken. So the sample has a fixed size, in words; documents longer than what is left are
passed over, and what remains is filled by those next in order that still fit, to the end of
the order. At last one document more is taken if that comes nearer than taking none.

The order is never sorted as a whole: words of documents that may fit are summed by (source,
slice of the order), and only the slice in which they exceed what is left is ordered exactly.
While words are left and later slices have documents that fit, this is done again from
there. Sources are joined by
broadcast only after their number was checked.

Nulls: a null text has size 0; a null source is a source, last in order; null ids are
allowed. Equal rows are taken in any order, which no result shows. Texts are counted whole,
however long, and move only with the rows that the mix takes. Empty tables give empty results;
a document without words is taken 0 times. All columns pass ``mix_documents``, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import need, own_names, stored, unit_hash

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Documents in one slice of a source's order, on average.
SLICE_ROWS = 2_000
#: Rounds that fill what is left within a slice.
FILLS = 4
#: Levels of document weights in an octave.
GRADES = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """sizes: (source, source_size, ...) -> the same with target. A target is level x weight
    up to most x size, at the level where the targets sum up to all sizes. Runs over one row
    for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(most) * F.col("source_size"))
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    full = ranked.withColumn("_all", F.sum("source_size").over(everything)).withColumn("_caps", F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    full = full.withColumn("_open", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    # The level if this source and all after it (by cap over weight) stay open.
    full = full.withColumn("_try", (F.col("_all") - F.col("_caps")) / F.col("_open"))
    fits = F.when(F.col("_try") * F.col("_w") <= F.col("_cap"), F.col("_try"))
    full = full.withColumn("_level", F.max_by(fits, F.when(fits.isNotNull(), -F.col("_cap") / F.col("_w"))).over(everything))
    target = F.coalesce(F.least(F.col("_level") * F.col("_w"), F.col("_cap")), F.col("_cap"))
    return full.select(*sizes.columns, target.cast("double").alias("target"))


def level_of(graded: DataFrame, most: float) -> DataFrame:
    """graded: source, target, _grade, _size -> (source, _level): expected copies are
    min(most, level x weight), at the level where a source's sizes sum up to its target."""
    w = F.pow(F.lit(2.0), F.col("_grade") / float(GRADES))
    heavier = Window.partitionBy("source").orderBy(F.desc("_grade")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    full = F.coalesce(F.sum("_size").over(heavier), F.lit(0)) * F.lit(most)
    rest = F.sum(F.col("_size") * w).over(whole) - F.coalesce(F.sum(F.col("_size") * w).over(heavier), F.lit(0.0))
    tried = graded.withColumn("_try", F.when(rest > 0, (F.col("target") - full) / rest))
    # The first grade, from the heaviest on, that the level does not lift above ``most``.
    fits = F.when(F.col("_try") * w <= most * (1 + 1e-12), F.col("_grade"))
    found = tried.groupBy("source").agg(F.max_by("_try", fits).alias("_level"), F.min("_grade").alias("_low"))
    # None: all are taken as often as may be.
    return found.select("source", F.coalesce(F.greatest(F.lit(0.0), F.col("_level")), F.lit(most) * F.pow(F.lit(2.0), -F.col("_low") / float(GRADES))).alias("_level"))


def mix_sizes(rows: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 20, weight: str | None = None) -> DataFrame:
    """rows: doc_id, source, size and a 64-bit key ``tie``; adds source_size, target, copies.

    weight: a column of positive relative document weights; all alike without it. Weights are
    taken at sixteenths of an octave, so that their levels are few whatever the data."""
    need(rows, "doc_id", "source", "size", "tie")
    grade = F.rint(F.lit(float(GRADES)) * F.log2(F.least(F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)), F.lit(1e-9)), F.lit(1e9)))).cast("int") if weight else F.lit(0)
    rows = stored(rows.withColumn("_grade", grade), "mix")
    graded = stored(rows.groupBy("source", "_grade").agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_docs")), "grades")
    per = graded.groupBy("source").agg(F.sum("_size").alias("source_size"), F.sum("_docs").alias("_docs"))
    per = stored(targets(per, weights, most).withColumn("_slices", F.greatest(F.lit(1), F.least(F.lit(1 << 20), F.col("_docs") / SLICE_ROWS)).cast("int")), "sources")
    small = per.count() <= BROADCAST_SOURCES

    def with_source(df: DataFrame, table: DataFrame) -> DataFrame:
        renamed = table.withColumnRenamed("source", "_s")
        return df.join(F.broadcast(renamed) if small else renamed, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    # Expected copies are level x weight, at most ``most``; the level gives the target in all.
    levels = stored(level_of(with_source(graded, per.select("source", "target")), most), "levels")
    per = stored(with_source(per, levels), "sources")
    expected = F.least(F.lit(float(most)), F.col("_level") * F.pow(F.lit(2.0), F.col("_grade") / float(GRADES)))
    df = with_source(rows, per).withColumn("_e", expected).withColumn("_sure", F.when(F.col("size") > 0, F.floor("_e")).otherwise(0)).withColumn("_p", F.col("_e") - F.floor("_e"))
    u = unit_hash(F.lit(seed), "doc_id", "tie")
    odds, chance = u / (1 - u), F.col("_p") / (1 - F.col("_p"))
    # v in (0, 1) grows with q = odds / chance; documents without a chance come last.
    df = df.withColumn("_v", F.when((F.col("_p") > 0) & (F.col("size") > 0), odds / (odds + chance)).otherwise(F.lit(1.0)))
    # Those have a slice of their own, in which no target falls.
    slice_of = F.when(F.col("_v") < 1, F.least(F.floor(F.col("_v") * F.col("_slices")), F.col("_slices") - 1)).otherwise(F.col("_slices"))
    df = df.withColumn("_k", slice_of.cast("int"))
    extra = F.when((F.col("_v") < 1) & (F.col("_sure") < most), F.col("size")).otherwise(F.lit(0))
    df = stored(df.withColumn("_x", extra).drop("_level", "_grade", "_docs", "_slices"), "mix")

    # How many words are open in each source.
    given = with_source(df.groupBy("source").agg(F.sum(F.col("size") * F.col("_sure")).alias("_given")), per.select("source", "target"))
    state = stored(given.select("source", F.lit(-1).alias("_at"), F.greatest(F.lit(0.0), F.col("target") - F.col("_given")).alias("_left")), "state")
    states, passed, decided = state, None, None
    in_source, everything = Window.partitionBy("source"), 2**30
    order = in_source.orderBy("_v", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    names = [*df.columns, "_more"]
    while True:
        # All that fit up to a slice are taken; in that slice they are chosen one by one.
        part = with_source(df, state).where("_k > _at and _x > 0 and _x <= _left").groupBy("source", "_k").agg(F.first("_at").alias("_at"), F.first("_left").alias("_left"), F.sum("_x").alias("_words"))
        part = part.withColumn("_fit", F.sum("_words").over(in_source.orderBy("_k")) <= F.col("_left"))
        step = part.groupBy("source").agg(F.first("_at").alias("_at"), F.first("_left").alias("_limit"), F.min(F.when(~F.col("_fit"), F.col("_k"))).alias("_edge"), F.sum(F.when(F.col("_fit"), F.col("_words")).otherwise(0)).alias("_before"))
        step = stored(step, "edge")
        if step.isEmpty():
            break
        span = step.select("source", F.struct("_at", F.coalesce("_edge", F.lit(everything)).alias("_edge"), "_limit").alias("_span"))
        passed = span if passed is None else passed.unionAll(span)
        edge = step.where("_edge is not null").select("source", "_edge", (F.col("_limit") - F.col("_before")).alias("_left"))
        inside = with_source(df, edge).where("_k = _edge").withColumn("_in", F.lit(False))
        for _ in range(FILLS):
            fits = ~F.col("_in") & (F.col("_x") > 0) & (F.col("_x") <= F.col("_left"))
            inside = inside.withColumn("_take", fits & (F.sum(F.when(fits, F.col("_x")).otherwise(0)).over(order) <= F.col("_left")))
            filled = F.coalesce(F.sum(F.when(F.col("_take"), F.col("_x"))).over(in_source), F.lit(0))
            inside = inside.withColumn("_left", F.col("_left") - filled).withColumn("_in", F.col("_in") | F.col("_take"))
        inside = stored(inside.withColumn("_more", F.when(F.col("_in"), 1).otherwise(0)).select(*names, "_edge", "_left"), "inside")
        decided = inside.select(*names) if decided is None else decided.unionAll(inside.select(*names))
        state = stored(inside.groupBy("source").agg(F.first("_edge").alias("_at"), F.first("_left").alias("_left")), "state")
        states = states.unionAll(state)
    both = df.withColumn("_more", F.lit(0))
    if passed is not None:
        spans = stored(passed.groupBy("source").agg(F.collect_list("_span").alias("_spans")), "spans")
        k, x = F.col("_k"), F.col("_x")
        both = with_source_left(df, spans, small).withColumn("_spans", F.coalesce("_spans", F.array().cast(spans.schema["_spans"].dataType)))
        both = both.where(~F.exists("_spans", lambda s: s["_edge"] == k))
        taken = F.exists("_spans", lambda s: (s["_at"] < k) & (k < s["_edge"]) & (x <= s["_limit"])) & (x > 0)
        both = stored(both.withColumn("_more", F.when(taken, 1).otherwise(0)).select(*names).unionAll(decided), "mix")
    # At last the one that fits best, if that comes nearer than taking none.
    last = stored(states.groupBy("source").agg(F.max_by("_left", "_at").alias("_left")), "left")
    miss = F.abs(F.col("_x") - F.col("_left"))
    fits = (F.col("_more") == 0) & (F.col("_x") > 0) & (miss < F.col("_left"))
    best = with_source(both, last).where(fits).groupBy("source").agg(F.min(F.struct(miss.alias("_miss"), "_v", "_k"))["_k"].alias("_best"), F.first("_left").alias("_left"))
    both = with_source_left(both, stored(best, "best"), small)
    first = F.row_number().over(in_source.orderBy(F.when(fits, miss).asc_nulls_last(), "_v", "doc_id", "tie")) == 1
    near = both.where("_k = _best").withColumn("_more", F.when(fits & first, 1).otherwise(F.col("_more")))
    both = both.where("_best is null or _k != _best").unionByName(near)
    return both.select("doc_id", "source", "size", "tie", "source_size", "target", (F.col("_sure") + F.col("_more")).cast("int").alias("copies"))


def with_source_left(df: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    renamed = table.withColumnRenamed("source", "_s")
    return df.join(F.broadcast(renamed) if small else renamed, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def row_key() -> Column:
    return F.xxhash64("doc_id", "source", F.coalesce("text", F.lit("")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix: every document as often as it is taken, with the columns of ``docs``."""
    need(docs, "doc_id", "source", "text")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key().alias("tie"))
    rows = rows.withColumn("weight", length_weight(F.col("size")))
    # Equal rows share a key; their copies are summed and dealt out again.
    cols, (tie, c, n, r, times, again) = docs.columns, own_names(docs, "_tie", "_c", "_n", "_r", "_times", "_again")
    taken = mix_sizes(rows, weight="weight", **options).groupBy("tie").agg(F.sum("copies").alias(c), F.count(F.lit(1)).alias(n)).withColumnRenamed("tie", tie)
    out = docs.withColumn(tie, row_key()).join(taken.where(F.col(c) > 0), tie)
    nth = F.when(F.col(n) == 1, 1).otherwise(F.row_number().over(Window.partitionBy(tie).orderBy(c)))
    share = F.floor(F.col(c) * F.col(r) / F.col(n)) - F.floor(F.col(c) * (F.col(r) - 1) / F.col(n))
    out = out.withColumn(r, nth).withColumn(times, share).where(F.col(times) > 0)
    return out.select(*cols, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(again)).select(*cols)


def length_weight(size: Column) -> Column:
    """Relative odds by length: twice as many words, 2^(1/4) times the odds; 1 below 16 words."""
    return F.pow(F.greatest(size.cast("double"), F.lit(16.0)) / 16.0, F.lit(0.25))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key().alias("tie"))
    out = mix_sizes(rows.withColumn("weight", length_weight(F.col("size"))), weight="weight")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")
