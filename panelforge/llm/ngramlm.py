"""Language-model scores: interpolated modified Kneser-Ney of any order from two.

Words: a first pass counts words by their 64-bit hashes; a word's hash names its part, and each
part numbers its words by falling counts, so frequent words have small numbers everywhere.

Counting: every task sorts and adds up the n-grams of a few million tokens and sends them, as
rising numbers, packed, to the part that their context names; a part adds up what it gets and
writes its sorted n-grams to the shared folder. The n-grams without their first word (how many
first words each has, and how often it occurs) go on in the same way, down to words. Nothing of
the corpus is collected on the driver but count-of-counts.

An n-gram in a file is the bits of its context that its part and bucket leave open, the number of
its word, and two bits of count; what needs more stands beside. Counts of a context's n-grams are
added up when they are asked for, beyond a few they are written down. All numbers have as many bits
as the largest needs and are read in place.

Scoring: workers memory-map the files, one for each part and level, and look the contexts
and n-grams of a slice of text up by binary search, so their memory does not grow with the model, nor
do the files that they hold open. Where the shared folder is
no file system that workers reach, they return the files as rows, which Spark writes there, and
Spark hands every executor a copy of them.

p(w|h) = (max(c(hw) - D(c), 0) + g(h) p'(w)) / c(h), g(h) = D1 n1(h) + D2 n2(h) + D3 n3+(h);
p' is the next lower order's, over distinct first words (n-grams that begin a text: over
occurrences), and below words 1 / (V + 1). Discounts are those of the counts of counts of
each order; where these are too small to tell, 0.75.

The query takes trigrams; ``order`` takes any. What a level hands to the next is deleted once the
next is written, as are its shuffle files, so the disk holds the files and one level's n-grams.

Words are 64-bit hashes, so counts of words are exact unless two words share one; contexts are
their words' numbers, or a 64-bit hash of those where they need more than 64 bits together.
Nulls: a null text is one empty document,
of one end token; a null id counts as an empty string. Equal rows count as often as they are
there. With no text to learn from every token has probability 1 / (V + 1) = 1. Empty tables
give empty results. A text of any length is taken whole, its n-grams in slices.
"""

from __future__ import annotations

import glob
import json
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import WordHash, drop_path, local_path, need, new_path, raw_texts, shuffle_parts, slices, stored, text_bytes

_P = np.uint64(0x9E3779B97F4A7C15)
#: Ids of what stands before a text and behind it: hashes of what is no word.
BEGIN, END = np.uint64(xxhash.xxh3_64_intdigest(b" begin")), np.uint64(xxhash.xxh3_64_intdigest(b" end"))
#: Tokens whose n-grams, and whose words, a task adds up before it sends them on.
FLUSH, FLUSH_WORDS = 1_500_000, 4_000_000
#: Bytes between words.
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_CODEC = pa.Codec("zstd", compression_level=1)
#: The number of what stands before a text, and of a word that has none.
FIRST, NONE = np.uint64(0), np.uint64(2**64 - 1)
#: Counts from one have two bits; this one stands for those that need more.
MORE = 3
#: N-grams to a bucket of a file. A context's sums are written down from so many n-grams on.
BUCKET, WIDE = 4, 4
#: Text bytes to a part, and those that are scored at once.
PART_BYTES, SCORED_BYTES = 24 << 20, 4 << 20
#: Files of the model that a worker has mapped at once; systems allow a process some 65,000 maps.
OPEN = 16_000


def places(word: np.ndarray, starts: np.ndarray, order: int, begin: np.uint64) -> list[np.ndarray]:
    """The n-grams of consecutive documents, as one array for each place."""
    at = len(word)
    since = np.arange(at) - np.repeat(starts, np.diff(np.r_[starts, at]))
    grams = [word]
    for back in range(1, order):
        before = np.r_[np.full(min(back, at), begin), word[:-back]]
        before[since < back] = begin
        grams.insert(0, before)
    return grams


def tokens(texts: list[bytes], cache: WordHash | None, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-grams of some documents, each closed by an end, as one array for each place (the
    words themselves come last), and the documents' starts. Equal words of the texts are hashed once, without the cache."""
    raw = b"\n".join(texts).lower()
    edges = np.flatnonzero(np.diff(_BLANK[np.frombuffer(raw, np.uint8)], prepend=True, append=True))  # a word's start, its end
    kind, size = (pa.binary(), np.int32) if len(raw) < 2**31 else (pa.large_binary(), np.int64)
    runs = pa.Array.from_buffers(kind, max(0, len(edges) - 1), [None, pa.py_buffer(edges.astype(size)), pa.py_buffer(raw)])
    coded = runs.dictionary_encode()  # words and what stands between them, in turn
    _, at, held = coded.dictionary.buffers()
    held, at = held.to_pybytes() if held else b"", np.frombuffer(at, size, len(coded.dictionary) + 1).tolist() if at else [0]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, map(held.__getitem__, map(slice, at, at[1:]))), np.uint64, len(coded.dictionary))
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])[:-1]
    many = np.diff(np.r_[np.searchsorted(edges[::2], begins), len(edges) // 2])
    ends = np.cumsum(many + 1)
    word = np.full(len(edges) // 2 + len(texts), END)
    at = np.ones(len(word), np.bool_)
    at[ends - 1] = False
    word[at] = hashes[coded.indices.to_numpy()[::2]]
    starts = ends - many - 1
    return places(word, starts, order, BEGIN), starts


def place(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids * _P) >> np.uint64(24)) % np.uint64(parts)


def gram_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (context * _P) ^ (word + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# -- n-grams as numbers ------------------------------------------------------------------


def joined(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """Numbers of ``bits`` bits, side by side in one."""
    key = columns[0]
    for c in columns[1:]:
        key = (key << np.uint64(bits)) | c
    return key


def spans(words: int, bits: int, parts: int) -> tuple[int, int]:
    """How many bits contexts of so many words have, and how many of them fall to a part."""
    wide = min(words * bits, 64)
    return wide, -(-(1 << wide) // parts)


def home(context: list[np.ndarray], bits: int, parts: int) -> np.ndarray:
    """Contexts, stirred: another number of as many bits for each. The part is this divided by what
    falls to a part, and the rest is the context's name there."""
    wide, _ = spans(len(context), bits, parts)
    if len(context) * bits <= 64:
        x = joined(context, bits)
    else:
        x = context[0]
        for c in context[1:]:
            x = gram_key(x, c)
    mask, half = np.uint64((1 << wide) - 1), np.uint64(max(1, wide // 2))
    for odd in (_P, np.uint64(0xD6E8FEB86659FD93)):
        x = (x * odd) & mask
        x = x ^ (x >> half)
    return x


def add_up(columns: list[np.ndarray], bits: int, weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of numbers of ``bits`` bits, rising, with how many there are, or sums of ``weight``."""
    if len(columns) * bits <= 64:
        key = joined(columns, bits)
        if weight is None:
            key, n = np.unique(key, return_counts=True)
        else:
            by = np.argsort(key)
            key = key[by]
            at = np.flatnonzero(np.r_[np.ones(min(1, len(key)), np.bool_), key[1:] != key[:-1]])
            key, n = key[at], np.add.reduceat(weight[by], at) if len(at) else weight[:0]
        mask = np.uint64((1 << bits) - 1)
        return [(key >> np.uint64(bits * k)) & mask for k in range(len(columns) - 1, -1, -1)], n
    by = np.lexsort(columns[::-1])
    columns = [c[by] for c in columns]
    new = np.ones(len(by), np.bool_)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, len(by)]) if weight is None else np.add.reduceat(weight[by], at) if len(at) else weight[:0]
    return [c[at] for c in columns], n


def packed(x: np.ndarray) -> bytes:
    """In the fewest bytes that hold the largest, first bytes first, compressed."""
    x = x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    keep = 3 if x.itemsize == 4 and not planes[3].any() else x.itemsize
    return bytes([keep]) + len(x).to_bytes(8, "little") + _CODEC.compress(planes[:keep].tobytes(), asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    keep, rows = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(_CODEC.decompress(raw[9:], keep * rows, asbytes=True), np.uint8).reshape(keep, rows)
    out = np.zeros((rows, 4 if keep == 3 else keep), np.uint8)
    out[:, :keep] = planes.T
    return out.view(f"u{out.shape[1]}").ravel().astype(np.uint64)


def _rises(columns: list[np.ndarray]) -> list[bytes]:
    """Rising rows: a number is what it adds to the one before where all places before it are equal."""
    same, out = np.zeros(len(columns[0]), np.bool_), []
    same[1:] = True
    for c in columns:
        more = c.copy()
        more[1:][same[1:]] -= c[:-1][same[1:]]
        out.append(packed(more))
        same[1:] &= c[1:] == c[:-1]
    return out


def _risen(raws: list[bytes]) -> list[np.ndarray]:
    out, same = [], None
    for raw in raws:
        c = unpacked(raw)
        if same is None:
            same = np.ones(len(c), np.bool_)
            same[:1] = False
        start = np.flatnonzero(~same)
        total = np.cumsum(c, dtype=np.uint64)
        c = total - np.repeat(total[start] - c[start], np.diff(np.r_[start, len(c)]))
        out.append(c)
        same[1:] &= c[1:] == c[:-1]
    return out


_SUMS = ["n1", "n2", "n3", "n4", "types", "total", "top"]
_PACK, _FILE = ["part", "grams", "counts"], ["name", "file"]
_SCHEMA = ", ".join(["part int", "grams array<binary>", "counts binary", *[f"{c} long" for c in _SUMS], "name string", "file binary"])
_KINDS = [pa.int32(), pa.list_(pa.binary()), pa.binary(), *[pa.int64()] * len(_SUMS), pa.string(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*(r + (None,) * (len(_KINDS) - len(r)) for r in rows), strict=True) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], [*_PACK, *_SUMS, *_FILE])


def _dealt(part: np.ndarray, columns: list[np.ndarray], n: np.ndarray) -> list[tuple]:
    """A row for each part of rising rows of numbers."""
    by = np.argsort(smallest(part), kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(part[by].astype(np.int64))) + 1, len(by)]
    rows = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            r = by[a:b]
            rows.append((int(part[r[0]]), _rises([c[r] for c in columns]), packed(n[r])))
    return rows


def _received(rows: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
    grams = zip(*(_risen(x) for _, x, *_ in rows), strict=True)
    return [np.concatenate(c) for c in grams], np.concatenate([unpacked(n) for _, _, n, *_ in rows]).astype(np.int64)


def _sent(grams: list[np.ndarray], n: np.ndarray, bits: int, parts: int) -> list[tuple]:
    if len(grams) == 1:
        return _dealt((grams[0] - np.uint64(1)) % np.uint64(parts), grams, n)
    _, each = spans(len(grams) - 1, bits, parts)
    return _dealt(home(grams[:-1], bits, parts) // np.uint64(each), grams, n)


def smallest(x: np.ndarray) -> np.ndarray:
    """In the fewest bytes that hold the largest."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def _by_part(batches):
    """Rows sorted by part -> (part, its rows)."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield now, rows


# -- files -------------------------------------------------------------------------------


class Bits:
    """Numbers of ``width`` bits each, one behind the other in 64-bit words."""

    def __init__(self, words: np.ndarray, width: int):
        self.words, self.width = words, width

    @staticmethod
    def of(x: np.ndarray, width: int) -> np.ndarray:
        """The words; one more than they fill."""
        out = np.zeros((len(x) * width + 63) // 64 + 1, np.uint64)
        if len(x) and width:
            x = x.astype(np.uint64)
            bit = np.arange(len(x), dtype=np.uint64) * np.uint64(width)
            at, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            out[at[first]] = np.bitwise_or.reduceat(x << shift, first)
            over = np.flatnonzero(shift + np.uint64(width) > 64)
            out[at[over] + 1] |= x[over] >> (np.uint64(64) - shift[over])
        return out

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.int64) * self.width
        at, shift = bit >> 6, (bit & 63).view(np.uint64)
        x = self.words.take(at)
        x >>= shift
        at += 1
        more = self.words.take(at)
        more <<= np.uint64(1)
        more <<= shift ^ np.uint64(63)
        x |= more
        x &= np.uint64((1 << self.width) - 1)
        return x

    def first(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The first place from ``lo`` and before ``hi``, between which numbers rise, that has
        ``value`` or more; else ``hi``."""
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            a, z = lo[live], hi[live]
            mid = (a + z) >> 1
            less = self[mid] < value[live]
            a, z = np.where(less, mid + 1, a), np.where(less, z, mid)
            lo[live], hi[live] = a, z
            live = live[a < z]
        return lo


def _counts(n: np.ndarray) -> dict:
    """Counts from one: two bits each, places and values of the larger."""
    n = n.astype(np.uint64)
    more = np.flatnonzero(n > MORE)
    return {"n": (np.minimum(n - np.uint64(1), np.uint64(MORE)), 2), "more": smallest(more), "much": smallest(n[more])}


def _read_counts(table: dict, i: np.ndarray) -> np.ndarray:
    n = table["n"][i].astype(np.int64) + 1
    more = n > MORE
    if more.any():
        n[more] = table["much"][np.searchsorted(table["more"], i[more].astype(table["more"].dtype))]
    return n


def _put(folder: str, name: str, raws: list[bytes]) -> None:
    """A file that appears whole: written aside, then renamed; a second attempt writes the same."""
    os.makedirs(folder, exist_ok=True)
    aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(aside, "wb") as out:
        out.writelines(raws)
    os.replace(aside, f"{folder}/{name}")


def _save(uri: str, name: str, arrays: dict) -> list[tuple]:
    """One file: the length of what says where the arrays are, that, and the arrays, each an array
    or numbers and their bits. Where workers don't reach the folder, a row for Spark to write there."""
    raws, says, at = [], {}, 0
    for k, x in arrays.items():
        width = 0
        if isinstance(x, tuple):
            x, width = Bits.of(*x), x[1]
            says[k] = [at, len(x), "u8", width]
        else:
            says[k] = [at, len(x), f"u{x.itemsize}", None]
        raw = np.ascontiguousarray(x).tobytes()
        raws.append(raw + bytes(-len(raw) % 8))
        at += len(raws[-1])
    head = json.dumps(says).encode()
    head += b" " * (-len(head) % 8)
    raws = [len(head).to_bytes(8, "little"), head, *raws]
    if folder := local_path(uri):
        _put(folder, name, raws)
        return []
    return [(*[None] * (len(_PACK) + len(_SUMS)), name, b"".join(raws))]


def _mapped(path: str) -> dict:
    """The arrays of a file of ``_save``. The map holds no file open."""
    with pa.memory_map(path) as f:
        raw = f.read_buffer()
    size = int(np.frombuffer(raw, np.int64, 1)[0])
    out = {}
    for k, (at, rows, kind, width) in json.loads(bytes(raw[8 : 8 + size])).items():
        x = np.frombuffer(raw, kind, rows, 8 + size + at) if rows else np.zeros(0, kind)
        out[k] = x if width is None else Bits(x, width)
    return out


def _copy(uri: str, name: str) -> str:
    """The folder of this executor's copy, in which the file of this name, if there is one, has been
    taken from Spark's."""
    from pyspark import SparkFiles

    folder = SparkFiles.get(os.path.basename(uri))
    if not os.path.exists(f"{folder}/{name}"):
        for path in glob.glob(f"{glob.escape(folder)}/name={name}/*.parquet"):
            for raw in pq.ParquetFile(path).read(["file"]).column(0):
                _put(folder, name, [raw.as_py()])
    return folder


class Tables:
    """The files of words, and of n-grams once they are there, opened where they are needed."""

    def __init__(self, words: str, grams: str, parts: int, bits: int):
        self.words, self.grams, self.parts, self.bits = words, grams, parts, bits
        self._open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def table(self, name: str) -> dict | None:
        """The file of this name, if there is one; beyond OPEN, the one used longest ago is let go."""
        found = self._open.pop(name, None)
        if found is None:
            uri = self.words if name.startswith("words-") else self.grams
            folder = local_path(uri) or _copy(uri, name)
            path = f"{folder}/{name}"
            if not os.path.exists(path):
                return None
            while len(self._open) >= OPEN:
                del self._open[next(iter(self._open))]
            found = _mapped(path)
        self._open[name] = found
        return found

    def numbers(self, word: np.ndarray, counts: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each of distinct words, how often it occurs and behind how many words."""
        number, raw, firsts = np.full(len(word), NONE), np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        part = place(word, self.parts).astype(np.int64)
        by = np.lexsort((word, part))
        cuts = np.r_[0, np.flatnonzero(np.diff(part[by])) + 1, len(by)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            at = by[a:b]
            p = int(part[at[0]])
            table = self.table(f"words-{p}")
            if table is None:
                continue
            there = table["word"]
            i = np.minimum(np.searchsorted(there, word[at]), len(there) - 1)
            hit = there[i] == word[at]
            at, i = at[hit], i[hit]
            rank = table["rank"][i]
            number[at] = rank * np.uint64(self.parts) + np.uint64(p + 1)
            if counts:
                raw[at] = _read_counts(table, i)
                firsts[at] = _read_counts(self.table(f"1-{p}"), rank.astype(np.int64))
        return number, raw, firsts


# -- counting ----------------------------------------------------------------------------


def _count_words(parts: int):
    def run(batches):
        held, size = [], 0

        def flush():
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return _batch(_dealt(place(word, parts), [word], n))

        for batch in batches:
            texts = raw_texts(batch.column(0))
            for a, b in slices(texts):
                (word,), _ = tokens(texts[a:b], None, 1)
                held.append(word)
                size += len(word)
                if size > FLUSH_WORDS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _write_words(uri: str, parts: int):
    """Words of a part: hashes, numbers in it, counts."""

    def run(batches):
        for part, rows in _by_part(batches):
            (word,), n = _received(rows)
            (word,), n = add_up([word], 64, n)
            rank = np.empty(len(word), np.uint64)
            rank[np.argsort(-n, kind="stable")] = np.arange(len(word), dtype=np.uint64)
            file = _save(uri, f"words-{part}", {"word": word, "rank": (rank, (len(word) - 1).bit_length())} | _counts(n))
            yield _batch([(None, None, None, None, None, None, None, len(word), int(n.sum()), (len(word) - 1) * parts + part + 1), *file])

    return run


def _count(words: Tables, order: int):
    def run(batches):
        held, begins, size = [], [], 0

        def flush():
            # In a flush, words are places in the list of its numbers: three of them fit in 64 bits.
            hashes, at = np.unique(np.concatenate(held), return_inverse=True)
            number = words.numbers(hashes, counts=False)[0]
            if (number == NONE).any():
                raise ValueError("the texts to learn from were others when their words were counted: store them first")
            by = np.argsort(number)
            local = np.empty(len(by), np.uint64)
            local[by] = np.arange(1, len(by) + 1, dtype=np.uint64)
            number = np.r_[FIRST, number[by]]
            grams, n = add_up(places(local[at], np.concatenate(begins), order, FIRST), len(by).bit_length())
            return _batch(_sent([number[g.astype(np.int64)] for g in grams], n, words.bits, words.parts))

        for batch in batches:
            texts = raw_texts(batch.column(0))
            for a, b in slices(texts):
                (word,), starts = tokens(texts[a:b], None, 1)
                held.append(word)
                begins.append(starts + size)
                size += len(word)
                if size > FLUSH:
                    yield flush()
                    held, begins, size = [], [], 0
        if size:
            yield flush()

    return run


def of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _write_level(uri: str, parts: int, bits: int, k: int):
    """Files of the n-grams of ``k`` words; what goes on to those of one word less, and sums."""

    def grams_of(part: int, grams: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[tuple]]:
        _, each = spans(k - 1, bits, parts)
        name = home(grams[:-1], bits, parts) - np.uint64(part * each)
        wide = (each - 1).bit_length()
        by = np.argsort((name << np.uint64(bits)) | grams[-1]) if wide + bits <= 64 else np.lexsort((grams[-1], name))
        name, word = name[by], grams[-1][by]
        at = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (word[1:] != word[:-1])])
        n, name, word, grams = np.add.reduceat(n[by], at), name[at], word[at], [g[by[at]] for g in grams]
        top = min(wide, (len(n) // BUCKET).bit_length())
        low = wide - top
        start = np.searchsorted(name >> np.uint64(low), np.arange((1 << top) + 1, dtype=np.uint64))
        head = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        long = np.diff(np.r_[head, len(n)]) >= WIDE
        sums = {c: np.add.reduceat(x.astype(np.int64), head)[long] for c, x in (("total", n), ("n1", n == 1), ("n2", n == 2))}
        arrays = {
            "start": (start, len(n).bit_length()),
            "name": (name & np.uint64((1 << low) - 1), low),
            "word": (word, bits),
            "long": smallest(head[long]),
        }
        return grams, n, _save(uri, f"{k}-{part}", arrays | {c: smallest(x) for c, x in sums.items()} | _counts(n))

    def run(batches):
        for part, rows in _by_part(batches):
            grams, n = _received(rows)
            if k == 1:
                n = np.bincount(((grams[0] - np.uint64(1)) // np.uint64(parts)).astype(np.int64), n).astype(np.int64)
                file = _save(uri, f"1-{part}", _counts(n))
            else:
                grams, n, file = grams_of(part, grams, n)
            out = [(None, None, None, *of_counts(n), len(n), int(n.sum())), *file]
            if k > 1:
                # Before a text's first words stand no others: there, occurrences go on.
                rest, firsts = add_up(grams[1:], bits, np.where(grams[1] == FIRST, n, 1))
                out += _sent(rest, firsts, bits, parts)
            yield _batch(out)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    if not n1 or not n2:
        return [0.75, 0.75, 0.75]
    y, n = n1 / (n1 + 2 * n2), [n1, n2, n3, n4]
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75 for k in (1, 2, 3)]
    return [min(max(d, 0.0), float(k)) if d > 0 else 0.75 for k, d in zip((1, 2, 3), found, strict=True)]


class Model(Tables):
    """A trained model; ``sums`` of each order."""

    def __init__(self, words: str, grams: str, parts: int, bits: int, tokens: int, sums: dict[int, dict]):
        super().__init__(words, grams, parts, bits)
        self.tokens, self.sums, self.order = tokens, sums, max(sums)
        self.less_by = {k: discounts(*(x[c] for c in ("n1", "n2", "n3", "n4"))) for k, x in sums.items()}

    def less(self, n: np.ndarray, k: int) -> np.ndarray:
        """Counts without their discounts."""
        return np.maximum(n - np.array([0.0, *self.less_by[k]])[np.minimum(n, 3)], 0.0)

    def level(self, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each n-gram: its count, its context's total and what its context leaves to the lower order."""
        k, rows = len(grams), len(grams[0])
        d, (_, each) = self.less_by[k], spans(k - 1, self.bits, self.parts)
        count, total, back = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
        at = np.flatnonzero(np.all([g != NONE for g in grams[:-1]], axis=0))
        key = home([g[at] for g in grams[:-1]], self.bits, self.parts)
        by = np.argsort(key)
        at, key = at[by], key[by]
        part = (key // np.uint64(each)).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(at)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            table = self.table(f"{k}-{part[a]}") if a < b else None
            if table is None:
                continue
            head = np.flatnonzero(np.r_[True, key[a + 1 : b] != key[a : b - 1]])
            name = key[a + head] - np.uint64(int(part[a]) * each)
            low = table["name"].width
            bucket = (name >> np.uint64(low)).astype(np.int64)
            name &= np.uint64((1 << low) - 1)
            hi = table["start"][bucket + 1].astype(np.int64)
            lo = table["name"].first(table["start"][bucket].astype(np.int64), hi, name)
            hi = table["name"].first(lo, hi, name + np.uint64(1))
            size, sums = hi - lo, np.zeros((4, len(lo)), np.int64)
            long = np.flatnonzero(size >= WIDE)
            i = np.searchsorted(table["long"], lo[long].astype(table["long"].dtype))
            for x, c in zip(sums, ("total", "n1", "n2"), strict=False):
                x[long] = table[c][i]
            sums[3] = size - sums[1] - sums[2]
            live = np.flatnonzero((size > 0) & (size < WIDE))
            sums[3][live] = 0
            for j in range(WIDE - 1):
                live = live[size[live] > j]
                n = _read_counts(table, lo[live] + j)
                sums[0][live] += n
                for x, of in zip(sums[1:], (n == 1, n == 2, n > 2), strict=True):
                    x[live] += of
            times = np.diff(np.r_[head, b - a])
            own = at[a:b]
            total[own] = np.repeat(sums[0], times)
            back[own] = np.repeat(d[0] * sums[1] + d[1] * sums[2] + d[2] * sums[3], times)
            word, lo, hi = grams[-1][own], np.repeat(lo, times), np.repeat(hi, times)
            i = table["word"].first(lo, hi, word)
            hit = np.flatnonzero(i < hi)
            hit = hit[table["word"][i[hit]] == word[hit]]
            count[own[hit]] = _read_counts(table, i[hit])
        return count, total, back

    def score(self, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 p, base log10 p and whether it is known, of each token, from hashes."""
        hashes, at = np.unique(np.concatenate(grams), return_inverse=True)
        number, raw, firsts = self.numbers(hashes)
        number[hashes == BEGIN] = FIRST
        at = at.reshape(len(grams), -1)
        return self.score_numbers([number[x] for x in at], raw[at[-1]], firsts[at[-1]])

    def score_numbers(self, grams: list[np.ndarray], raw: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, d = self.sums[1], self.less_by[1]
        v, mass = words["types"], words["total"]
        g = d[0] * words["n1"] + d[1] * words["n2"] + d[2] * (v - words["n1"] - words["n2"])
        p = (self.less(firsts, 1) + g / (v + 1)) / mass if mass else np.full(len(raw), 1.0 / (v + 1))
        for k in range(2, self.order + 1):
            count, total, back = self.level(grams[-k:])
            p = np.where(total > 0, (self.less(count, k) + back * p) / np.maximum(total, 1), p)
        return np.log10(p), np.log10((raw + 0.1) / (self.tokens + 0.1 * (v + 1))), raw > 0

    def score_words(self, word: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for the words of documents that begin at ``starts``."""
        hashes, at = np.unique(word, return_inverse=True)
        number, raw, firsts = self.numbers(hashes)
        return self.score_numbers(places(number[at], starts, self.order, FIRST), raw[at], firsts[at])


def train(docs: DataFrame, text: str = "text", order: int = 3) -> Model:
    if order < 2:
        raise ValueError("the order must be two or more")
    spark = docs.sparkSession
    docs = docs.select(text)
    parts = max(2, shuffle_parts(spark, text_bytes(docs, text), PART_BYTES))

    def written(rows: DataFrame, write, path: str, uri: str) -> DataFrame:
        made = stored(rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(write, _SCHEMA), path=path)
        if not local_path(uri):
            made.where("name is not null").select(*_FILE).write.partitionBy("name").option("compression", "uncompressed").mode("append").parquet(uri)
        return made

    def handed_out(uri: str) -> None:
        if not local_path(uri) and tokens:
            spark.sparkContext.addFile(uri, recursive=True)

    words, uri, path = new_path(spark, "lm-words"), new_path(spark, "lm"), new_path(spark, "lm-0")
    made = written(docs.mapInArrow(_count_words(parts), _SCHEMA).select(*_PACK), _write_words(words, parts), path, words)
    tokens, top = made.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.max("top"), F.lit(1))).first()
    drop_path(spark, path)
    handed_out(words)
    bits = int(top).bit_length()
    going, sums, read = docs.mapInArrow(_count(Tables(words, uri, parts, bits), order), _SCHEMA).select(*_PACK), {}, None
    for k in range(order, 0, -1):
        path = new_path(spark, f"lm-{k}")
        made = written(going, _write_level(uri, parts, bits, k), path, uri)
        sums[k] = made.where("part is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS[:-1]]).first().asDict()
        going = made.where("part is not null").select(*_PACK)
        if read:  # its n-grams are in this level's files and rows now
            drop_path(spark, read)
        read = path
    drop_path(spark, read)
    handed_out(uri)
    return Model(words, uri, parts, bits, tokens, sums)


def score_texts(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with n_tokens, n_known, base_score and score of each text."""
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            texts, out = raw_texts(batch.column(len(keep))), []
            for a, b in slices(texts, SCORED_BYTES):
                (word,), starts = tokens(texts[a:b], None, 1)
                p, base, known = model.score_words(word, starts)
                out.append((np.diff(np.r_[starts, len(p)]), np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(p, starts)))
            cols = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], [*keep, "n_tokens", "n_known", "base_score", "score"])

    add = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    return docs.select(*keep, text).mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + add))


def remainder(of: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of


def lm_scores(docs: DataFrame, order: int = 3) -> DataFrame:
    need(docs, "doc_id", "text")
    rows = docs.select("doc_id", "text", (remainder(10) == 0).alias("held_out"))
    model = train(rows.where("not held_out"), order=order)
    out = score_texts(rows, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
