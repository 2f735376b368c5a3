"""Sharding by rendezvous hashing.

Every shard j of weight w gets the score -w / ln(u) from a hash u in (0, 1) of the record
key and j; the record goes to the highest score. A further shard takes records only into
itself, and shares follow the weights. The choice is one expression on the row: no shuffle.

Slots number a shard's records without gaps. Records are first counted by (shard, bucket),
buckets being hashes of the record, so that no task orders a whole shard; equal records are
counted before they are numbered, so a repeated record is no hot spot either.

Nulls: a null key is a key like any other; a null text has no bytes and CRC 0. Equal rows
get different slots. Very long texts are measured where they are and never moved. An empty
table gives an empty result. ``assign_shards`` passes all columns; if there is one of the
result's name already, the result is named shard_2 (or the next free).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import need, own_names, stored, unit_hash

#: Records that are ordered by one task for their slots, on average.
SLOT_ROWS = 50_000
#: Slots of one repeated record that are written out at once.
STRETCH = 4_096


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard (0 on) of a stable key."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")

    def score(j: int, w: float) -> Column:
        return -F.lit(float(w)) / F.ln(unit_hash(key, F.lit(j)))

    return -F.array_max(F.array(*[F.struct(score(j, w).alias("s"), F.lit(-j).alias("j")) for j, w in enumerate(weights)]))["j"]


def assign_shards(df: DataFrame, weights: list[float], key: str = "doc_id", into: str = "shard") -> DataFrame:
    need(df, key)
    (into,) = own_names(df, into)
    return df.withColumn(into, shard_of(F.col(key), weights))


def number_slots(rows: DataFrame, shard: str = "shard", into: str = "slot") -> DataFrame:
    """Adds a gapless number from 0 within each shard, in an order that the rows' own
    values decide. ``rows`` should be narrow."""
    cols = rows.columns
    distinct = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    n = rows.count()
    buckets = max(1, n // SLOT_ROWS)
    distinct = stored(distinct.withColumn("_b", F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")), "slots")
    sizes = distinct.groupBy(shard, "_b").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(shard, "_b", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(shard, "_b").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    out = distinct.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(sizes, [shard, "_b"])
    # A record that is there very often is numbered a stretch at a time.
    step, first, end = F.lit(STRETCH), F.col("_base") + F.col("_first"), F.col("_base") + F.col("_first") + F.col("_n") - 1
    out = out.withColumn("_at", F.explode(F.sequence(first, end, step)))
    return out.select(*cols, F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + (step - 1), end))).alias(into))


def shard_table(docs: DataFrame, shards: int = 24, weights: list[float] | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot, grown_shard."""
    need(docs, "doc_id", "text")
    weights = weights or [1.0] * shards
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign_shards(rows, weights)
    slots = number_slots(rows)
    grown = shard_of(F.col("doc_id"), [*weights, sum(weights) / len(weights)])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder for each shard."""
    df.write.partitionBy(shard).parquet(path)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
