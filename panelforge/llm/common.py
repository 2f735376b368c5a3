"""What the text operators share: words and shingles as 64-bit hashes, tables in the
folder that all machines share, and connected components.

A word is a run of bytes other than ASCII space, TAB, LF, VT, FF, CR, after A-Z are
lower-cased; other letters keep their case.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a worker tokenises at once; a longer document is taken alone.
SLICE_BYTES = 2 << 20
#: Distinct words that a worker remembers before it forgets them all.
WORD_CACHE = 250_000
_P = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a null doc_id where a key is needed; sorts after every other id.
NO_ID = 2**63 - 1


def need(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"the table has no column {', '.join(missing)}")


def own_names(df: DataFrame, *wanted: str) -> list[str]:
    """A name for each column that an operator adds: the one it asks for, or, where ``df`` has
    that (in any case), the first free of name_2, name_3, ... So every input column passes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        free = name
        k = 2
        while free.lower() in taken:
            free, k = f"{name}_{k}", k + 1
        taken.add(free.lower())
        out.append(free)
    return out


def doc_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


# -- tables in the shared folder ---------------------------------------------------------

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir with its scheme; where it is unset and all runs on this machine (tests),
    a temporary folder of it. A cluster must name a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="pf-")
        spark.conf.set("spark.checkpoint.dir", found)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def local_path(uri: str) -> str | None:
    """The path of a file: URI as Hadoop writes it, with nothing escaped; None for another store."""
    return "/" + uri[5:].lstrip("/") if uri.startswith("file:") else None


def new_path(spark: SparkSession, kind: str) -> str:
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, kind: str = "table", path: str | None = None) -> DataFrame:
    """Written once to the shared folder and read back: cuts the lineage and outlives any
    executor. The shuffle files of the job go as soon as its rows are written."""
    spark = df.sparkSession
    path = path or new_path(spark, kind)
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _tidy() -> None:
    for spark, path in _MADE:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Estimated bytes up to which a table is broadcast.
BROADCAST_BYTES = 64 << 20


def if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a stored table, marked for broadcast if its rows, at most ``row_bytes`` each,
    are few; else as it is, for a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def unit_hash(*columns: Column | str) -> Column:
    """A number in (0, 1), the ends excluded, from a hash of the columns: 52 bits and a half."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def shuffle_parts(spark: SparkSession, data_bytes: float = 0, each: int = 32 << 20) -> int:
    """Partitions for data of this size, never fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(data_bytes // each) + 1)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def release() -> None:
    """Hands the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def lean(run):
    """``run``, for mapInArrow; before and after it the worker, which lives on and serves other tasks,
    releases what it no longer needs."""

    def task(batches):
        release()
        yield from run(batches)
        release()

    return task


# -- words and shingles ------------------------------------------------------------------


class WordHash(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(text: bytes, cache: WordHash) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``width`` words in a row; a shorter text is one shingle."""
    n = len(h)
    if not n:
        return h
    k = min(width, n)
    s = h[: n - k + 1].copy()
    for i in range(1, k):
        s = s * _P + h[i : n - k + 1 + i]
    return np.unique(mix(s + np.uint64(k)))


# -- connected components ----------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that is reachable, for every node with an edge.

    Alternates large and small stars until nothing changes. A star's centre is found by an
    aggregation with a partial step, so a node with very many edges is no hot spot; each
    round is stored."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    spark, path = e.sparkSession, new_path(e.sparkSession, "edges")
    e = stored(e, path=path)
    before = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(low.where("m != u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, path = path, new_path(spark, "edges")
        e = stored(small.unionAll(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), path=path)
        drop_path(spark, last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
