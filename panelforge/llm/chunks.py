"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes; five bits of it, which hang on the last 16 bytes
only, cut the text about every 32 bytes. Insertions move no cut beyond the next one, so a
passage is cut alike wherever it stands. Cuts that crowd another are dropped and long chunks
are split, by rules that look at the neighbourhood alone.

Chunks of equal digest in two or more documents are repeats; the smallest doc_id keeps its
own. Chunks in a row that stand in the same row in the first document with them are a
candidate. It is extended byte by byte to both sides against that document (windows of both
texts, wider ones while all of a window agrees), and extended spans of at least ``least_words``
words are reported, without those inside another. So each span is whole in kept_doc_id: its
inside has the same 128-bit digest there, the rest is compared. Candidates in stretches too
short for a passage, by a bound that loses none, are not extended. A passage without any whole
chunk, or each of whose chunks has an earlier first holder without the passage, is missed.

Entries of chunks travel packed, by hash range. A chunk that a task has very often goes aside
under a key of that task, and only its first holder goes to the range; so a chunk that very many
documents have gathers nowhere. Texts move only if the candidates are too many to be broadcast.

Nulls: a null text has no chunks. Rows that share an id (or have none) are one document for
what repeats, and are cut each by its own text. Repeats within one document are left. Equal
rows lose the same spans. Very long texts are cut and compared whole. Empty tables give empty
results. ``dedup_substrings`` passes all columns; if there is an n_cut, its own is n_cut_2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import BROADCAST_BYTES, NO_ID, SLICE_BYTES, doc_key, lean, need, own_names, raw_texts, shuffle_parts, slices, stored, text_bytes

#: Bits of the hash that cut, crowding distance and longest chunk in bytes.
SHIFT, CUT, CROWD, LONGEST = 11, 31, 8, 512
#: Words of a passage, bytes at its beginning in which cuts may differ (the hash's reach and CROWD).
LEAST_WORDS, RIM = 40, 24
#: Chunks that a task gathers before it deals them out; how often one may be among them.
FLUSH, OFTEN = 1 << 20, 64
#: Bytes beside a candidate that are compared at first, and how much wider each next window is.
WINDOW, WIDER = 128, 8
GEAR = np.random.default_rng(9).integers(0, 2**32, 256, np.uint64).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[b[i - k]] << k for k below 16, modulo 2^32, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    return h


def chunk_starts(text: bytes) -> np.ndarray:
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    cuts = np.flatnonzero((gear_hash(np.frombuffer(text, np.uint8)) >> np.uint32(SHIFT)) & np.uint32(CUT) == 0) + 1
    cuts = cuts[(np.diff(np.r_[-CROWD, cuts]) >= CROWD) & (cuts < n)]
    starts = np.r_[0, cuts]
    long = np.diff(np.r_[starts, n])
    if (long > LONGEST).any():
        pieces = -(-long // LONGEST)
        first = np.repeat(starts, pieces)
        starts = first + LONGEST * (np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return starts


def words_before(text: bytes) -> np.ndarray:
    """Beginnings of words up to and without each position."""
    data = np.frombuffer(text, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space & np.r_[True, space[:-1]]
    return np.r_[0, np.cumsum(begins)]


#: One entry is a chunk: digest, document and row, start, length, words in it, before it, after it.
_ENTRY = (("h", np.uint64), ("d", np.int64), ("r", np.int32), ("s", np.int32), ("n", np.uint16), ("w", np.uint16), ("pw", np.uint16), ("nw", np.uint16))
_DEALT = "part int, kind int, h long, fl long, entries binary"
_DEALT_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("h", pa.int64()), ("fl", pa.int64()), ("entries", pa.binary())])
#: Kinds of rows: entries by hash range; one entry for many in a flush; these many.
ALL, HEAD, MANY = 0, 1, 2


def _press(entries: list[np.ndarray]) -> bytes:
    body = zstandard.compress(b"".join(x.tobytes() for x in entries[1:]), 1)
    return len(entries[0]).to_bytes(4, "little") + entries[0].tobytes() + body


def _opened(raw: bytes) -> list[np.ndarray]:
    k = int.from_bytes(raw[:4], "little")
    out, rest, at = [np.frombuffer(raw, np.uint64, k, 4)], zstandard.decompress(raw[4 + 8 * k :]), 0
    for _, kind in _ENTRY[1:]:
        out.append(np.frombuffer(rest, kind, k, at))
        at += k * np.dtype(kind).itemsize
    return out


def entries_of(d: int, text: bytes) -> list[np.ndarray]:
    starts = chunk_starts(text)
    k = len(starts)
    ends = np.r_[starts[1:], len(text)]
    count = words_before(text)
    w = count[ends] - count[starts]
    h = np.fromiter((xxhash.xxh3_64_intdigest(text[x:y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, k)
    values = (h, np.full(k, d), np.full(k, row_of(text)), starts, ends - starts, w, np.r_[0, w[:-1]], np.r_[w[1:], 0])
    return [v.astype(t) for v, (_, t) in zip(values, _ENTRY, strict=True)]


def row_of(text: bytes) -> int:
    return xxhash.xxh32_intdigest(text) >> 1


def _deal(parts: int):
    """doc_id, text -> entries packed by hash range; chunks that a task has very often go aside."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        seen: set[tuple[int, int]] = set()
        size = turn = 0

        def flush():
            nonlocal turn
            e = [np.concatenate(x) for x in zip(*held, strict=True)]
            fl = int(np.array(xxhash.xxh3_64_intdigest(e[0].tobytes(), seed=len(held)), np.uint64).view(np.int64))
            by = np.argsort(e[0], kind="stable")
            edge = np.flatnonzero(np.r_[True, e[0][by][1:] != e[0][by][:-1], True])
            rows, often = [], np.zeros(len(by), np.bool_)
            for k in np.flatnonzero(np.diff(edge) > OFTEN).tolist():
                at = by[edge[k] : edge[k + 1]]
                first = at[np.lexsort((e[3][at], e[2][at], e[1][at]))[:1]]
                h = e[0][first[0]]
                often[at] = True
                turn += 1
                rows.append((int((h >> np.uint64(33)) % np.uint64(parts)), HEAD, int(h.view(np.int64)), fl, _press([x[first] for x in e])))
                rows.append(((fl + turn) % parts, MANY, int(h.view(np.int64)), fl, _press([x[at] for x in e])))
            rest = np.flatnonzero(~often)
            part = ((e[0][rest] >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.r_[0, np.flatnonzero(np.diff(part[order])) + 1, len(order)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    at = rest[order[a:b]]
                    rows.append((int(part[order[a]]), ALL, None, None, _press([x[at] for x in e])))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DEALT_ARROW, strict=True)], schema=_DEALT_ARROW)

        for batch in batches:
            texts = raw_texts(batch.column(1))
            for d, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if not text or (d, row_of(text)) in seen:
                    continue
                seen.add((d, row_of(text)))
                held.append(entries_of(d, text))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield flush()

    return run


_MET = "kind int, h long, fl long, d long, r int, s int, e int, w int, pw int, nw int, kd long, kr int, ks int, entries binary"
_MET_ARROW = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _MET.split(", ")])


def _met(kind: int, count: int, **columns) -> pa.RecordBatch:
    out = {"kind": np.full(count, kind, np.int32)} | columns
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name in out else pa.nulls(count, f.type) for f in _MET_ARROW], schema=_MET_ARROW)


def _firsts(batches):
    """A hash range's entries -> each chunk that an earlier document has as well, with its first
    holder; for what went aside the first holder only."""
    held: list[list[np.ndarray]] = []
    heads: list[tuple[int, int]] = []
    for batch in batches:
        for kind, h, fl, raw in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True):
            if kind == MANY:
                yield _met(MANY, 1, h=[h], fl=[fl], entries=[raw])
                continue
            held.append(_opened(raw))
            if kind == HEAD:
                heads.append((h, fl))
    if not held:
        return
    h, d, r, s, n, w, pw, nw = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    by = np.lexsort((s, r, d, h))
    h, d, r, s, n, w, pw, nw = (x[by] for x in (h, d, r, s, n, w, pw, nw))
    fresh = np.r_[True, h[1:] != h[:-1]]
    once = fresh | np.r_[True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1])]
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    at = np.flatnonzero(once & (d > d[first]))
    for i in range(0, len(at), 100_000):
        a = at[i : i + 100_000]
        f = first[a]
        yield _met(ALL, len(a), d=d[a], r=r[a], s=s[a], e=s[a] + n[a].astype(np.int32), w=w[a].astype(np.int32), pw=pw[a].astype(np.int32), nw=nw[a].astype(np.int32), kd=d[f], kr=r[f], ks=s[f])
    if heads:
        heads.sort()
        where = np.searchsorted(h, np.array([x for x, _ in heads], np.int64).view(np.uint64))
        yield _met(HEAD, len(heads), h=[x for x, _ in heads], fl=[y for _, y in heads], kd=d[where], kr=r[where], ks=s[where])


def _unpacked(batches):
    """Chunks that went aside, with their first holder -> the rows of ``_firsts``."""
    for batch in batches:
        for raw, kd, kr, ks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _, d, r, s, n, w, pw, nw = (x.astype(np.int64) for x in _opened(raw))
            a = np.flatnonzero(d > kd)
            k = len(a)
            yield _met(ALL, k, d=d[a], r=r[a], s=s[a], e=(s + n)[a], w=w[a], pw=pw[a], nw=nw[a], kd=np.full(k, kd), kr=np.full(k, kr), ks=np.full(k, ks))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """d, r, s, e, w, pw, nw (words before and after), kd, kr, by: chunks with an earlier holder."""
    parts = shuffle_parts(docs.sparkSession, text_bytes(docs), 8 << 20)
    dealt = docs.select(doc_key().alias("d"), "text").mapInArrow(lean(_deal(parts)), _DEALT)
    met = stored(dealt.repartition(parts, "part").mapInArrow(lean(_firsts), _MET), "chunks")
    cols = ["d", "r", "s", "e", "w", "pw", "nw", "kd", "kr", "ks"]
    again = met.where(F.col("kind") == ALL).select(*cols)
    heads = met.where(F.col("kind") == HEAD)
    if not heads.isEmpty():
        many = met.where(F.col("kind") == MANY).select("h", "fl", "entries").join(heads.select("h", "fl", "kd", "kr", "ks"), ["h", "fl"])
        apart = many.select("entries", "kd", "kr", "ks").repartition(parts).mapInArrow(lean(_unpacked), _MET).select(*cols).distinct()
        again = stored(again.unionAll(apart), "chunks")
    return again.select(*cols[:-1], (F.col("s") - F.col("ks")).alias("by"))


_ENDS = "d long, r int, s int, e int, before binary, after binary, whole binary"


def _ends(width: int):
    """d, text, asked -> for each (s, e) asked of the text's row: up to width + 1 bytes before s,
    the byte before e with up to width after it, and a digest of what is between."""

    def run(batches):
        for batch in batches:
            ids, asked = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = raw_texts(batch.column(1))
            for x, y in slices(texts, SLICE_BYTES):
                out: list[list] = [[] for _ in range(7)]
                for d, ask, text in zip(ids[x:y], asked[x:y], texts[x:y], strict=True):
                    row = row_of(text)
                    for q in ask:
                        s, e = q["s"], q["e"]
                        if q["r"] == row:
                            for c, v in zip(out, (d, row, s, e, text[max(0, s - width - 1) : s], text[e - 1 : e + width], xxhash.xxh3_128_digest(text[s:e])), strict=True):
                                c.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["d", "r", "s", "e", "before", "after", "whole"])

    return run


def same_end(a: bytes, b: bytes) -> int:
    """Length of the longest common suffix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[len(a) - n :], "big") ^ int.from_bytes(b[len(b) - n :], "big")
    return ((x & -x).bit_length() - 1) // 8 if x else n


def same_start(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


_FOUND = "d long, r int, s int, e int, kd long, kr int, by int"


def _grown(width: int):
    """_FOUND and the ends in both documents -> _FOUND extended, and whether it may go on."""

    def run(batches):
        for batch in batches:
            s, e, more = [], [], []
            cols = [batch.column(i).to_pylist() for i in (2, 3, 7, 8, 9, 10)]
            for s0, e0, la, ra, lb, rb in zip(*cols, strict=True):
                n, m = same_end(la[-width:], lb[-width:]), same_start(ra[1:], rb[1:])
                on = (n == width and len(la) > width and len(lb) > width) or m == width
                if not on:  # no part of a character
                    while n and la[len(la) - n] & 0xC0 == 0x80:
                        n -= 1
                    while m and m + 1 < len(ra) and ra[m + 1] & 0xC0 == 0x80:
                        m -= 1
                s.append(s0 - n)
                e.append(e0 + m)
                more.append(on)
            out = [batch.column(0), batch.column(1), pa.array(s, pa.int32()), pa.array(e, pa.int32()), *(batch.column(i) for i in (4, 5, 6)), pa.array(more, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, ["d", "r", "s", "e", "kd", "kr", "by", "more"])

    return run


def _candidates(again: DataFrame, least_words: int) -> DataFrame:
    """Runs of chunks that a document shares with one keeper, in stretches of repeated chunks that
    may hold a passage: what is equal in two documents has all its cuts but those in the first
    RIM bytes in both, so it ends in the chunk after the stretch, and begins in the chunk before
    it or at most RIM bytes earlier."""
    row = Window.partitionBy("d", "r").orderBy("s")
    reach = F.max("e").over(row.rowsBetween(Window.unboundedPreceding, -1))
    stretched = again.withColumn("_new", F.when(reach >= F.col("s"), 0).otherwise(1)).withColumn("_stretch", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    one = Window.partitionBy("d", "r", "_stretch")
    most = F.sum("w").over(one) + F.max_by("pw", -F.col("s")).over(one) + F.max_by("nw", "s").over(one) + F.lit(RIM // 2)
    able = stretched.withColumn("_most", most).where(F.col("_most") >= least_words)
    line = Window.partitionBy("d", "r").orderBy("kd", "kr", "by", "s")
    place = ["d", "r", "kd", "kr", "by"]
    follows = (F.col("_kd") == F.col("kd")) & (F.col("_kr") == F.col("kr")) & (F.col("_by") == F.col("by")) & (F.col("_e") == F.col("s"))
    runs = able.select("*", *[F.lag(c).over(line).alias(f"_{c}") for c in ("kd", "kr", "by", "e")]).withColumn("_run", F.sum(F.when(follows, 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*place, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("d", "r", "s", "e", "kd", "kr", "by")


def _counted(batches):
    """d, r, text, asked -> d, r, s, e, words of each span asked for."""
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for d, text, ask in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            row, count = row_of(text), words_before(text)
            for q in ask:
                if q["r"] == row:
                    for c, v in zip(out, (d, row, q["s"], q["e"], int(count[q["e"]] - count[q["s"]])), strict=True):
                        c.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["d", "r", "s", "e", "w"])


def _asked(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """d, text, asked: documents with the spans (d, r, s, e) that are asked of them. Texts move
    only if the spans are too many to be broadcast."""
    asked = stored(spans.groupBy("d").agg(F.collect_set(F.struct("r", "s", "e")).alias("asked")), "asked")
    total = asked.agg(F.coalesce(F.sum(F.size("asked") * 24 + 64), F.lit(0))).first()[0]
    asked = F.broadcast(asked) if total <= BROADCAST_BYTES else asked
    return docs.select(doc_key().alias("d"), "text").join(asked, "d").select("d", "text", "asked")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """d, r (tells texts of one id apart), start and end in UTF-8 bytes, words, kept_d."""
    need(docs, "doc_id", "text")
    place = ["d", "r", "kd", "kr", "by"]
    found = stored(_candidates(repeated_chunks(docs), least_words), "found")
    whole, width = None, WINDOW
    while True:
        spans = found.select("d", "r", "s", "e").unionAll(found.selectExpr("kd", "kr", "s - by", "e - by"))
        ends = stored(_asked(docs, spans).mapInArrow(lean(_ends(width)), _ENDS).dropDuplicates(["d", "r", "s", "e"]), "ends")
        theirs = ends.selectExpr("d as kd", "r as kr", "s as ks", "e as ke", "before as before_k", "after as after_k", "whole as whole_k")
        both = found.join(ends, ["d", "r", "s", "e"]).withColumns({"ks": F.col("s") - F.col("by"), "ke": F.col("e") - F.col("by")}).join(theirs, ["kd", "kr", "ks", "ke"]).where("whole = whole_k")
        grown = both.select("d", "r", "s", "e", "kd", "kr", "by", "before", "after", "before_k", "after_k").mapInArrow(lean(_grown(width)), _FOUND + ", more boolean")
        grown = stored(grown, "grown")
        whole = grown.where("not more") if whole is None else whole.unionAll(grown.where("not more"))
        # Of those that have met in one place, one goes on for all.
        met = F.max("e").over(Window.partitionBy(*place).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
        found = stored(grown.where("more").drop("more").distinct().withColumn("_met", met).where("_met is null or _met < s").drop("_met"), "found")
        if found.isEmpty():
            break
        width *= WIDER
    spans = stored(whole.groupBy("d", "r", "s", "e").agg(F.min("kd").alias("kept_d")), "spans")
    before = F.max("e").over(Window.partitionBy("d", "r").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1))
    outer = spans.withColumn("_before", before).where("_before is null or _before < e").drop("_before")
    counted = _asked(docs, outer).mapInArrow(lean(_counted), "d long, r int, s int, e int, w int").where(F.col("w") >= least_words).distinct()
    out = counted.join(outer, ["d", "r", "s", "e"])
    return out.select("d", "r", F.col("s").alias("start"), F.col("e").alias("end"), F.col("w").alias("words"), "kept_d")


def dedup_substrings(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated passages cut out of their texts, and n_cut, their number."""
    from pyspark.sql import types as T

    cols, (d, cut, n_cut) = docs.columns, own_names(docs, "_d", "_spans", "n_cut")
    at = cols.index("text")
    spans = repeated_passages(docs, least_words).groupBy("d").agg(F.collect_set(F.struct("r", "start", "end")).alias(cut)).withColumnRenamed("d", d)
    rows = docs.withColumn(d, doc_key()).join(spans, d, "left").select(*cols, cut)

    def run(batches):
        for batch in batches:
            texts, cuts = [], []
            for text, raw, found in zip(batch.column(at).to_pylist(), raw_texts(batch.column(at)), batch.column(len(cols)).to_pylist(), strict=True):
                mine = row_of(raw)
                gone = sorted((f["start"], f["end"]) for f in found or () if f["r"] == mine)
                if gone:
                    met: list[list[int]] = []
                    for x, y in gone:
                        if met and x <= met[-1][1]:
                            met[-1][1] = max(y, met[-1][1])
                        else:
                            met.append([x, y])
                    edges = [0, *[x for s in met for x in s], len(raw)]
                    text = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore")
                texts.append(text)
                cuts.append(len(gone))
            out = [*batch.columns[: len(cols)], pa.array(cuts, pa.int64())]
            out[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(out, [*cols, n_cut])

    return rows.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(n_cut, T.LongType())]))


def _named(spans: DataFrame) -> DataFrame:
    name = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return spans.select(name("d").alias("doc_id"), F.col("start").cast("long").alias("start_byte"), F.col("end").cast("long").alias("end_byte"), F.col("words").cast("long"), name("kept_d").alias("kept_doc_id"))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each repeated passage that is to go: whose it is and who keeps it."""
    return _named(repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")))
