"""Benchmark decontamination: MinHash containment search over sizes, DataFrame functions only.

Which documents hold at least ``least`` of a test item's 5-word shingles? The usual MinHash
signature of a whole document says nothing about a 20-word item inside 20,000 words, so the
sketch's length follows the item: items are partitioned by size, and an item of q shingles
is sketched by its k = floor((1 - least) q) + 1 smallest shingle hashes (bottom-k MinHash).
A document without any of these k lacks more than (1 - least) q shingles, so none that holds
the item is missed, whatever its length. Each size partition has a bound, the largest hash
in its sketches, and is asked with a document's hashes up to its own bound only, by documents
that have enough shingles to hold an item of that size. All shingles of the documents found so
meet those of the items, so every pair is verified on the words themselves.

A shingle is five words in a row of the lower-cased text, words being runs of characters
other than ASCII white space. Items under five words are one shorter shingle, which only a
document of the same words has. Null texts and items without words match nothing. Rows that
share an id are told apart by their texts; equal rows give equal pairs, once each. Long texts
are read whole. Empty tables give empty results. Other columns do not matter to ``contained``;
``decontaminate`` passes all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from panelforge.llm.common import if_small, need, own_names, stored

SHINGLE = 5
#: Stands in where there are no items.
_NO_PART = Row(part=0, top=0)
_SPLIT = r"[\x20\x09-\x0D]+"
_SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    clean = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SPACE))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, _SPLIT, -1))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once. A lambda that names a computed column
    would compute it again for every element, since projections are merged."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(w: Column) -> Column:
    """Where SHINGLE words in a row begin; one start if there are fewer, none without words."""
    return F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (SHINGLE - 1))))


def shingle_hashes(text: Column) -> Column:
    return let(words(text), lambda w: F.transform(starts(w), lambda i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(SHINGLE)])))


def shingle_texts(text: Column) -> Column:
    return let(words(text), lambda w: F.array_distinct(F.transform(starts(w), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(SHINGLE))))))


def item_sketches(items: DataFrame, item: str, text: str, least: float) -> DataFrame:
    """(item, part, h): the k smallest hashes of each item; part is the size partition."""
    hashed = items.select(F.col(item).alias("item"), F.array_sort(F.array_distinct(shingle_hashes(F.col(text)))).alias("_h"))
    q = F.size("_h")
    k = F.floor(F.lit(1 - least) * q + F.lit(1e-9)).cast("int") + 1
    sized = hashed.where(q > 0).withColumn("part", F.floor(F.log2(q)).cast("int")).withColumn("_k", k)
    return sized.select("item", "part", F.explode(F.slice("_h", F.lit(1), F.col("_k"))).alias("h"))


def contained(docs: DataFrame, items: DataFrame, least: float = 0.75, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, doc, n_item, n_shared, containment) of every pair with containment >= least."""
    need(docs, doc, text)
    need(items, item, text)
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and at most 1")
    sketch = stored(item_sketches(items, item, text, least), "sketches")
    # One row for each size partition, of which there are as many as item sizes have powers of 2.
    parts = sketch.groupBy("part").agg(F.max("h").alias("top")).collect()
    if not parts:
        sketch = sketch.where("false")
    size = lambda p: 2 ** int(p)
    bounds = F.array(*[F.struct(F.lit(int(r.part)).alias("part"), F.lit(int(r.top)).cast("long").alias("top"), F.lit(least * size(r.part) - 1e-9).alias("least")) for r in parts or [_NO_PART]])

    def probes(h: Column) -> Column:
        """(part, h) up to the partition's own bound, where the document is large enough."""
        n = F.size(h)
        asked = F.filter(bounds, lambda b: n >= b["least"])
        return F.flatten(F.transform(asked, lambda b: F.transform(F.filter(h, lambda x: x <= b["top"]), lambda x: F.struct(b["part"].alias("part"), x.alias("h")))))

    made = docs.select(F.col(doc).alias("doc"), F.explode(let(shingle_hashes(F.col(text)), probes)).alias("p")).select("doc", "p.part", "p.h")
    hits = made.join(if_small(sketch, 48), ["part", "h"])
    suspects = stored(hits.select("doc").distinct(), "suspects")
    # All shingles of the suspects meet those of the items.
    asked = stored(items.select(F.col(item).alias("item"), F.xxhash64(text).alias("of"), F.explode(shingle_texts(F.col(text))).alias("s")).distinct(), "asked")
    longest = asked.agg(F.coalesce(F.max(F.octet_length("s")), F.lit(0))).first()[0]
    counts = asked.groupBy("item", "of").agg(F.count(F.lit(1)).alias("n_item"))
    few = if_small(suspects.withColumnRenamed("doc", "_doc"), 48)
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("_text")).join(few, F.col("doc").eqNullSafe(F.col("_doc")), "left_semi")
    # Rows that share an id are told apart by their texts.
    held = rows.select("doc", F.xxhash64("_text").alias("row"), F.explode(shingle_texts(F.col("_text"))).alias("s"))
    met = held.join(if_small(asked, 64 + longest), "s").groupBy("item", "of", "doc", "row").agg(F.count_distinct("s").alias("n_shared"))
    counts = stored(counts.withColumnsRenamed({"item": "_item", "of": "_of"}), "counts")
    out = met.join(if_small(counts, 64), F.col("item").eqNullSafe(F.col("_item")) & (F.col("of") == F.col("_of")))
    out = out.where(F.col("n_shared") >= F.lit(least) * F.col("n_item") - F.lit(1e-9))
    return out.select(F.col("item").alias(item), F.col("doc").alias(doc), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, least: float = 0.75, **names) -> DataFrame:
    """``docs`` without the rows of documents that hold an item."""
    doc = names.get("doc", "doc_id")
    (found,) = own_names(docs, "_found")
    gone = stored(contained(docs, items, least, **names).select(F.col(doc).alias(found)).distinct(), "found")
    return docs.join(if_small(gone, 48), F.col(doc).eqNullSafe(F.col(found)), "left_anti")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_split_to_array(trim(lower(coalesce(text, '')), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_split_to_array(trim(lower(coalesce(text, '')), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE w <> [''])
), q AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM s WHERE kind = 'i')
SELECT q.id AS item_id, d.id AS doc_id, q.n AS n_item, count(*) AS n_shared, count(*) / q.n AS containment
FROM q JOIN s d ON d.kind = 'd' AND d.s = q.s
GROUP BY q.id, d.id, q.n HAVING count(*) >= 0.75 * q.n
"""
