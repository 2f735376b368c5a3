"""Line dedup with two Bloom filters.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased;
keys of at least ``least`` code points found in at least two documents lose all their lines
but those in the smallest doc_id that holds them.

1. Every task puts the key hashes of its documents into a filter "once" and, if they were
   there already, into a filter "twice". Both are cut into segments by hash, so a task sends
   few bytes a line (set bits, compressed), and each segment is merged apart from the others:
   what is in two filters "once", or in any "twice", is in the merged "twice". Errors are on
   one side only: no repeat is missed. The filters grow with the number of lines.
2. Lines that the merged "twice" holds are suspects. Only they are shuffled, as (key, doc_id),
   to find the keys that really are in two documents and the first of these; a partial
   aggregation takes the heat off very common lines, and their keys, being few, are broadcast.
   The filter is broadcast up to ``BROADCAST_BYTES``. Beyond, lines are dealt out by segment,
   and each segment's filter is sent there once.
3. Rows meet their list of keys to drop, by doc_id and a hash of the text.

Nulls: a null text is one empty line; rows that share a doc_id count as one document, rows
without an id as one that comes last. Equal rows keep or lose the same lines. Long texts are
split whole. Empty tables give empty results. ``dedup_lines`` passes all columns; results whose
names are taken are named n_lines_2, n_dropped_2 (or the next free).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import doc_key, need, own_names, raw_texts, shuffle_parts, stored

#: Bits of a filter for each line, and hashes for each.
BITS_A_LINE, HASHES = 16, 3
#: Bits of one segment.
SEGMENT = 1 << 20
#: Hashes of a segment up to which a task sends them instead of bits.
FEW = 4_000
#: Documents from which on a key is frequent, and met by a broadcast.
HOT_ROWS = 5_000
#: A merged filter is broadcast up to this size.
BROADCAST_BYTES = 128 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int) -> bytes | None:
    """The key, or None if it is too short."""
    key = line.strip(_SPACE).lower()
    if len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "replace")) >= least:
        return key
    return None


def keys_of(text: bytes, least: int) -> set[bytes]:
    return {k for k in (line_key(x, least) for x in text.split(b"\n")) if k is not None}


def places(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash, and its bits there (one row for each hash function)."""
    seg = (h >> np.uint64(33)) % np.uint64(segments)
    a, b = h & np.uint64(0xFFFFFFFF), (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) | np.uint64(1)
    bits = [((a + np.uint64(i) * b) % np.uint64(SEGMENT)).astype(np.int64) for i in range(HASHES)]
    return seg.astype(np.int64), np.stack(bits) if len(h) else np.zeros((HASHES, 0), np.int64)


class Filters:
    """A task's filters: sorted set bits of each segment, from the hashes it has seen."""

    def __init__(self, segments: int):
        self.segments = segments
        self.seen: dict[int, list[np.ndarray]] = {}

    def add(self, h: np.ndarray) -> None:
        seg, _ = places(h, self.segments)
        order = np.argsort(seg, kind="stable")
        cuts = np.flatnonzero(np.diff(seg[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                self.seen.setdefault(int(seg[part[0]]), []).append(h[part])

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        press = zstandard.ZstdCompressor(level=1)
        for s, parts in self.seen.items():
            values, count = np.unique(np.concatenate(parts), return_counts=True)
            yield s, _sent(values, self.segments, press), _sent(values[count > 1], self.segments, press)


def _sent(h: np.ndarray, segments: int, press: zstandard.ZstdCompressor) -> bytes:
    """Few hashes of a segment travel as they are, many as its bits."""
    return b"h" + h.tobytes() if len(h) <= FEW else b"b" + press.compress(bitmap(h, segments).tobytes())


def _bits(sent: bytes, segments: int, opened: zstandard.ZstdDecompressor) -> np.ndarray:
    """Places of the bits that are set."""
    if sent[:1] == b"h":
        return places(np.frombuffer(sent, np.uint64, offset=1), segments)[1].ravel()
    return np.flatnonzero(np.unpackbits(np.frombuffer(opened.decompress(sent[1:]), np.uint8)))


def bitmap(h: np.ndarray, segments: int) -> np.ndarray:
    flags = np.zeros(SEGMENT, np.bool_)
    flags[places(h, segments)[1].ravel()] = True
    return np.packbits(flags)


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def _build(least: int, segments: int):
    def run(batches):
        mine = Filters(segments)
        for batch in batches:
            for text in raw_texts(batch.column(0)):
                found = keys_of(text, least)
                if found:
                    mine.add(np.fromiter(map(_hash, found), np.uint64, len(found)))
        for s, once, twice in mine.rows():
            yield pa.RecordBatch.from_pydict({"segment": [s], "once": [once], "twice": [twice]}, schema=pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    return run


def _merge(segments: int):
    """Rows of a partition, sorted by segment -> the merged "twice" of each segment."""

    def run(batches):
        opened = zstandard.ZstdDecompressor()
        now, once, twice = None, None, None
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    if now is not None:
                        yield _segment(now, np.packbits(twice))
                    now, once, twice = s, np.zeros(SEGMENT, np.bool_), np.zeros(SEGMENT, np.bool_)
                a, b = _bits(a, segments, opened), _bits(b, segments, opened)
                twice[b] = True
                twice[a[once[a]]] = True
                once[a] = True
        if now is not None:
            yield _segment(now, np.packbits(twice))

    return run


def _segment(s: int, twice: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"segment": [s], "twice": [zstandard.compress(twice.tobytes(), 1)]}, schema=pa.schema([("segment", pa.int32()), ("twice", pa.binary())]))


def repeated(h: np.ndarray, filters: dict[int, np.ndarray], segments: int) -> np.ndarray:
    seg, bits = places(h, segments)
    out = np.zeros(len(h), np.bool_)
    for s in np.unique(seg):
        if (f := filters.get(int(s))) is not None:
            at = np.flatnonzero(seg == s)
            b = bits[:, at]
            out[at] = ((f[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1).all(axis=0)
    return out


_FOUND = "key binary, d long, r long"
_FOUND_ARROW = pa.schema([("key", pa.binary()), ("d", pa.int64()), ("r", pa.int64())])


def suspects(keyed: DataFrame, least: int) -> DataFrame:
    """(key, d, r) of every line whose key may be in two documents; keyed: d, r, text."""
    spark = keyed.sparkSession
    lines = keyed.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)))).first()[0] or 0
    segments = max(1, -(-lines * BITS_A_LINE // SEGMENT))
    built = keyed.select("text").mapInArrow(_build(least, segments), "segment int, once binary, twice binary")
    parts = min(segments, shuffle_parts(spark, segments * SEGMENT))
    merged = stored(built.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(_merge(segments), "segment int, twice binary"), "twice")
    if segments * SEGMENT // 8 <= BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast([(r.segment, bytes(r.twice)) for r in merged.toLocalIterator()])

        def find(batches):
            filters = {s: np.frombuffer(zstandard.decompress(x), np.uint8) for s, x in sent.value}
            for batch in batches:
                out: list[list] = [[], [], []]
                for d, r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
                    found = list(keys_of(text, least))
                    if found:
                        hit = np.flatnonzero(repeated(np.fromiter(map(_hash, found), np.uint64, len(found)), filters, segments))
                        for c, v in zip(out, ([found[i] for i in hit], [d] * len(hit), [r] * len(hit)), strict=True):
                            c += v
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)

        return keyed.select("d", "r", "text").mapInArrow(find, _FOUND)

    # Too large to send about: lines go to the segment that knows, whose filter comes first.
    asked = pa.schema([("segment", pa.int32()), ("twice", pa.binary()), ("h", pa.int64()), *_FOUND_ARROW])

    def hashes(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for d, r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
                found = keys_of(text, least)
                for c, v in zip(out, (found, [d] * len(found), [r] * len(found)), strict=True):
                    c += v
            h = np.fromiter(map(_hash, out[0]), np.uint64, len(out[0]))
            seg, _ = places(h, segments)
            head = [pa.array(seg.astype(np.int32)), pa.nulls(len(h), pa.binary()), pa.array(h.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, f.type) for c, f in zip(out, _FOUND_ARROW, strict=True))], schema=asked)

    def test(batches):
        now: dict[int, np.ndarray] = {}
        for batch in batches:
            seg, twice = batch.column(0).to_numpy(), batch.column(1)
            first = np.r_[0, np.flatnonzero(np.diff(seg)) + 1]
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(seg)], strict=True):
                if a == b:
                    continue
                if twice[a].is_valid:
                    now = {int(seg[a]): np.frombuffer(zstandard.decompress(twice[a].as_py()), np.uint8)}
                    a += 1
                rows = batch.slice(a, b - a)
                hit = repeated(rows.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), now, segments)
                kept = rows.filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays(kept.columns[3:], schema=_FOUND_ARROW)

    schema = f"segment int, twice binary, h long, {_FOUND}"
    rows = keyed.select("d", "r", "text").mapInArrow(hashes, schema)
    heads = merged.select("segment", "twice", F.lit(None).cast("long").alias("h"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("d"), F.lit(None).cast("long").alias("r"))
    met = rows.unionAll(heads).repartition(parts, "segment").sortWithinPartitions("segment", F.col("twice").isNull())
    return met.mapInArrow(test, _FOUND)


def drops(keyed: DataFrame, least: int = 10) -> DataFrame:
    """(d, r, drop): the keys that a row of document d loses."""
    found = stored(suspects(keyed, least).distinct(), "suspects")
    firsts = found.groupBy("key").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    firsts = stored(firsts.select("key", "first", "n", (F.col("n") > HOT_ROWS).alias("hot")), "firsts")
    # Keys that very many documents have are few: their rows stay where they are.
    longest, n_hot = firsts.where("hot").agg(F.coalesce(F.max(F.octet_length("key")), F.lit(0)), F.count(F.lit(1))).first()
    rest = found
    gone = None
    if 0 < n_hot * (longest + 64) <= BROADCAST_BYTES:
        hot = F.broadcast(firsts.where("hot").select("key", "first"))
        gone = found.join(hot, "key").where("d > first").select("d", "r", "key")
        rest = found.join(hot, "key", "left_anti")
        firsts = firsts.where("not hot")
    met = rest.join(firsts.select("key", "first"), "key").where("d > first").select("d", "r", "key")
    met = met if gone is None else met.unionAll(gone)
    return met.groupBy("d", "r").agg(F.collect_list("key").alias("drop"))


def _strip(width: int, least: int, digest: bool, schema: pa.Schema):
    """Columns: the row's own (``width`` of them), text, drop -> the row's own and results."""

    def run(batches):
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(raw_texts(batch.column(width)), batch.column(width + 1), strict=True):
                lines = text.split(b"\n")
                gone = set(drop.as_py() or ())
                left = [x for x in lines if line_key(x, least) not in gone] if gone else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                body = b"\n".join(left)
                kept.append(hashlib.sha256(body).hexdigest() if digest else body.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run


def dedup_lines(docs: DataFrame, least: int = 10, digest: bool = False) -> DataFrame:
    """The documents without their repeated lines, with n_lines and n_dropped; with
    ``digest`` only doc_id, these and kept_sha256 of the text that is left."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    need(docs, "doc_id", "text")
    own = ["doc_id"] if digest else [c for c in docs.columns if c != "text"]
    d, r, drop, text = own_names(docs, "_d", "_r", "_drop", "_text")
    n_lines, n_dropped = ("n_lines", "n_dropped") if digest else own_names(docs, "n_lines", "n_dropped")
    # Rows of one document are told apart by their texts, so that no list is longer than a text.
    row = F.xxhash64(F.coalesce("text", F.lit("")))
    gone = drops(docs.select(doc_key().alias("d"), row.alias("r"), "text"), least).select(F.col("d").alias(d), F.col("r").alias(r), F.col("drop").alias(drop))
    last = "kept_sha256" if digest else "text"
    out = T.StructType([docs.schema[c] for c in own] + [T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType()), T.StructField(last, T.StringType())])
    rows = docs.withColumns({d: doc_key(), r: row}).join(gone, [d, r], "left").select(*own, F.col("text").alias(text), drop)
    done = rows.mapInArrow(_strip(len(own), least, digest, to_arrow_schema(out)), out)
    return done if digest else done.select(*docs.columns, n_lines, n_dropped)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, digest=True)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first < k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE first IS NULL OR first = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON f.key = k.key GROUP BY k.doc_id
"""
