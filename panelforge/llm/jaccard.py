"""N-gram Jaccard join with signature trees.

Documents are sets of 5-word shingles (64-bit hashes); two link when their sets' Jaccard
similarity is at least ``least``. ``jaccard_components`` names each document's component of
links, ``jaccard_links`` counts each document's links as well. No link is missed:

1. Equal sets become one node (named by the set's digest; a second digest tells whether two
   sets share a name, and then all are named anew), counted by one aggregation.
   If a node links with any other, at most n - ceil(least * n) of its n shingles are in no other
   node, and so no more of any part of them. Fingerprints of half of all shingles (by one bit of
   the hash) are dealt out by hash, as packed arrays, to count for each node how many of its own
   others have; nodes that lack more go. For those left the same is done with all their
   shingles, among each other. Each hash range has a task of its own: dealt by a hash of
   the range's number, more and more of them would meet in one. (A collision makes a shingle seem shared, which keeps a node and
   never loses one.) What is stored for a step is deleted once the next one is.
2. Groups that can hold links: if A and B link, then under any fixed order of all shingles
   each has a common shingle among its first n - ceil(least * n) + 1. The order is by a
   sketch's count of the shingle among the nodes left (a table of bounded size), rare first, so
   that a passage that many documents share seldom is among them. Each shingle's holders are
   tied to one of them, and the components of these ties are the groups. What a worker keeps
   for it is one holder for each distinct shingle of its hash range.
3. In every group a signature tree: leaves hold documents' token bitmaps, bits being the
   shingles that at least two documents of the group have; a node has the OR of its
   children's bitmaps and their range of sizes. Two trees' nodes are walked together; a pair
   of nodes is left if sizes differ too much, if the overlap that the bitmaps admit is too
   small, or if all its documents are known to be connected. On leaves the bitmaps give the
   overlap exactly.
4. A group with many shingles is cut into blocks. First every block is joined with itself
   and with block 0; blocks that this has connected need no more, and for the others each
   pair of blocks is a task of its own. No task holds more than two blocks, and bitmaps that
   would be too large are walked in parts.

``jaccard_links`` makes no use of what is connected: it walks all node pairs that sizes and
bitmaps leave, of all pairs of blocks. Tasks return a sum for each node and the links that
connect, never all pairs, so the output stays in proportion to the nodes. Equal sets are
links; n_links counts rows, others than the document's own.

Nulls: a text without words has an empty set and links with nothing, so it is its own
component (equal ids share it). The component of rows without any doc_id is null. Equal rows
are equal sets. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import WordHash, components, doc_key, drop_path, if_small, lean, need, new_path, own_names, raw_texts, shingle_set, shuffle_parts, stored, text_bytes, word_hashes

#: Least and most counters of the sketch that orders shingles. Between, one for each shingle
#: of the documents left; beyond, a shingle stands out if it is more frequent than the many that
#: share its counter. The order decides on the groups' size, never on what is found.
FEWEST, COUNTERS = 1 << 20, 1 << 25
PIECES = 16
#: Shingles in one block of a group.
BLOCK = 1 << 18
#: Bytes of bitmaps that a walk holds; beyond, its rows are cut into parts that are walked in turn.
BITMAP_BYTES = 64 << 20
#: Children of a tree node.
FANOUT = 16
#: Entries that a worker gathers before it deals them out.
FLUSH = 1 << 19


def needed_overlap(a, b, least: float):
    """The smallest intersection of sets of these sizes that links them."""
    return np.ceil(least * (a + b) / (1 + least) - 1e-9)


def digest(s: np.ndarray, salt: int) -> int:
    """Names a set. Where two sets of a corpus share a name, another salt is taken."""
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes(), seed=salt), np.uint64).view(np.int64))


def witness(s: np.ndarray) -> int:
    """A second name, to see whether equal digests are equal sets."""
    return xxhash.xxh64_intdigest(s.tobytes(), seed=len(s)) >> 1


def _sets(batch: pa.RecordBatch, column: int, cache: WordHash) -> Iterator[np.ndarray]:
    for text in raw_texts(batch.column(column)):
        yield shingle_set(word_hashes(text, cache))


_DEALT = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("half", pa.int64()), ("node", pa.int64()), ("witness", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
DEALT = "part int, doc_id long, n long, half long, node long, witness long, a binary, b binary, c binary"


def _packed(parts: list[int], *columns: list[bytes]) -> pa.RecordBatch:
    none = pa.nulls(len(parts), pa.int64())
    columns = [pa.array(c, pa.binary()) for c in columns]
    columns += [pa.nulls(len(parts), pa.binary())] * (3 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), none, none, none, none, none, *columns], schema=_DEALT)


def _cut(part: np.ndarray) -> list[np.ndarray]:
    """Positions by part, in the order they have."""
    by = np.argsort(part, kind="stable")
    edges = np.r_[0, np.flatnonzero(np.diff(part[by])) + 1, len(by)]
    return [by[x:y] for x, y in zip(edges, edges[1:], strict=False) if y > x]


def half_of(s: np.ndarray) -> np.ndarray:
    """By a bit that is neither in fingerprints nor names a hash range."""
    return s[(s >> np.uint64(32)) & np.uint64(1) == 0]


def _describe(parts: int, salt: int, every: bool):
    """doc -> n, how many of them are in the half, node and witness; and packed (fingerprints, owners
    of runs, lengths of runs) of the half for each hash range, once for each set that this task has.
    every: only what is packed, of all shingles."""

    def run(batches):
        cache, seen, turn = WordHash(), set(), 0
        tokens, owners, size = [], [], 0

        def flush():
            t = np.concatenate(tokens)
            o = np.repeat(np.array(owners, np.int64), [len(x) for x in tokens])
            part = (t >> np.uint64(33)) % np.uint64(parts)
            ids, fp, who, long = [], [], [], []
            for rows in _cut(part):
                ids.append(int(part[rows[0]]))
                fp.append((t[rows] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
                at = np.r_[0, np.flatnonzero(np.diff(o[rows])) + 1]
                who.append(o[rows][at].tobytes())
                long.append(np.diff(np.r_[at, len(rows)]).astype(np.uint32).tobytes())
            return _packed(ids, fp, who, long)

        for batch in batches:
            n, halves, node, second = [], [], [], []
            for s in _sets(batch, 1, cache):
                half = half_of(s)
                n.append(len(s))
                halves.append(len(half))
                node.append(digest(s, salt) if len(s) else None)
                second.append(witness(s))
                if len(s) and node[-1] not in seen:
                    seen.add(node[-1])
                    tokens.append(s if every else half)
                    owners.append(node[-1])
                    size += len(tokens[-1])
                    if size > 2 * FLUSH:
                        yield flush()
                        tokens, owners, size = [], [], 0
            if len(seen) > 1_000_000:
                seen.clear()
            if every:
                continue
            turn += 1
            none = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([(turn + i) % parts for i in range(len(n))], pa.int32()), batch.column(0), pa.array(n, pa.int64()), pa.array(halves, pa.int64()), pa.array(node, pa.int64()), pa.array(second, pa.int64()), none, none, none], schema=_DEALT)
        if size:
            yield flush()

    return run


def _repeats(parts: int):
    """A hash range's fingerprints -> packed (nodes, how many of their shingles others have),
    by node; rows that describe documents pass."""

    def run(batches):
        known, first, many = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.bool_)
        tokens, owners, size = [], [], 0

        def merge():
            nonlocal known, first, many
            fresh = sum(map(len, tokens))
            t, o = np.concatenate([known, *tokens]), np.concatenate([first, *owners])
            m = np.concatenate([many, np.zeros(fresh, np.bool_)])
            by = np.argsort(t, kind="stable")
            t, o, m = t[by], o[by], m[by]
            start = np.r_[True, t[1:] != t[:-1]]
            head = np.flatnonzero(start)
            run_of = np.cumsum(start) - 1
            other = o != o[head][run_of]
            shared = np.zeros(len(head), np.bool_)
            shared[run_of[other]] = True
            counted = np.concatenate([o[other], o[head][shared & ~m[head]]])
            known, first, many = t[head], o[head], m[head] | shared
            nodes, count = np.unique(counted, return_counts=True)
            if not len(nodes):
                return None
            part = nodes.view(np.uint64) % np.uint64(parts)
            rows = _cut(part)
            return _packed([int(part[r[0]]) for r in rows], [nodes[r].tobytes() for r in rows], [count[r].astype(np.uint32).tobytes() for r in rows])

        for batch in batches:
            packed = batch.column(6).is_valid()
            yield batch.filter(batch.column(6).is_null())
            rows = batch.filter(packed)
            for t, o, k in zip(*(rows.column(c).to_pylist() for c in (6, 7, 8)), strict=True):
                tokens.append(np.frombuffer(t, np.uint32))
                owners.append(np.repeat(np.frombuffer(o, np.int64), np.frombuffer(k, np.uint32)))
                size += len(tokens[-1])
                if size > max(4 * FLUSH, len(known)):
                    if (out := merge()) is not None:
                        yield out
                    tokens, owners, size = [], [], 0
        if size and (out := merge()) is not None:
            yield out

    return run


def _summed(batches):
    """Packed (nodes, counts) of a range of nodes -> node, repeated."""
    nodes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    wait: list = []

    def merge():
        nonlocal nodes, counts
        n, c = np.concatenate([nodes, *[x for x, _ in wait]]), np.concatenate([counts, *[y for _, y in wait]])
        nodes, at = np.unique(n, return_inverse=True)
        counts = np.bincount(at, weights=c, minlength=len(nodes)).astype(np.int64)

    for batch in batches:
        for n, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            wait.append((np.frombuffer(n, np.int64), np.frombuffer(c, np.uint32)))
        if sum(len(x) for x, _ in wait) > FLUSH:
            merge()
            wait = []
    merge()
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(counts[i : i + 100_000])], ["node", "repeated"])


def _verified(salt: int):
    """node, d, text -> once each node whose text it is."""

    def run(batches):
        cache = WordHash()
        for batch in batches:
            mine = [digest(s, salt) if len(s) else None for s in _sets(batch, 2, cache)]
            yield batch.filter(pa.array([a == b for a, b in zip(mine, batch.column(0).to_pylist(), strict=True)], pa.bool_()))

    return run


def _sketch(counters: int):
    def run(batches):
        cache, table, held, size = WordHash(), np.zeros(counters, np.uint32), [], 0

        def count():
            np.add.at(table, (np.concatenate(held) % np.uint64(counters)).astype(np.int64), 1)

        for batch in batches:
            for s in _sets(batch, 0, cache):
                held.append(s)
                size += len(s)
                if size > FLUSH:
                    count()
                    held, size = [], 0
        if size:
            count()
        if table.any():
            for i, part in enumerate(np.split(table, PIECES)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())], ["piece", "counts"])

    return run


def _add_up(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zstandard.decompress(x), np.uint32).astype(np.uint64)
            total[i] = total[i] + part if i in total else part
    for i, part in total.items():
        fine = np.minimum(part, 128 + 8 * np.log2(np.maximum(part, 128) / 128)).clip(0, 255)  # exact to 128, then by powers
        yield pa.RecordBatch.from_pydict({"piece": [i], "counts": [fine.astype(np.uint8).tobytes()]}, schema=pa.schema([("piece", pa.int32()), ("counts", pa.binary())]))


def _prefixes(counts, counters: int, parts: int, least: float, salt: int):
    def run(batches):
        order = np.frombuffer(b"".join(counts.value), np.uint8)
        cache, seen = WordHash(), set()
        tokens, owners, size = [], [], 0

        def flush():
            t, o = np.concatenate(tokens), np.concatenate(owners)
            part = (t >> np.uint64(33)) % np.uint64(parts)
            rows = _cut(part)
            return pa.RecordBatch.from_arrays([pa.array([int(part[r[0]]) for r in rows], pa.int32()), pa.array([t[r].tobytes() for r in rows], pa.binary()), pa.array([o[r].tobytes() for r in rows], pa.binary())], ["part", "tokens", "owners"])

        for batch in batches:
            for s in _sets(batch, 0, cache):
                n = len(s)
                if not n or (d := digest(s, salt)) in seen:
                    continue
                seen.add(d)
                k = n - int(np.ceil(least * n - 1e-9)) + 1
                rare = np.argsort(order[(s % np.uint64(counters)).astype(np.int64)], kind="stable")[:k]
                tokens.append(s[rare])
                owners.append(np.full(k, d, np.int64))
                size += k
                if size > FLUSH:
                    yield flush()
                    tokens, owners, size = [], [], 0
            if len(seen) > 1_000_000:
                seen.clear()
        if size:
            yield flush()

    return run


def _ties(batches):
    """Entries of a hash range -> (a, b): each holder of a shingle with the first one."""
    known, first = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(tokens, owners):
        nonlocal known, first
        t, o = np.concatenate([known, *tokens]), np.concatenate([first, *owners])
        by = np.argsort(t, kind="stable")
        t, o = t[by], o[by]
        start = np.r_[True, t[1:] != t[:-1]]
        center = o[np.flatnonzero(start)][np.cumsum(start) - 1]
        apart = center != o
        known, first = t[start], o[start]
        return np.unique(np.stack([center[apart], o[apart]], 1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)

    tokens, owners, size = [], [], 0
    for batch in batches:
        for t, o in zip(batch.column(1), batch.column(2), strict=True):
            tokens.append(np.frombuffer(t.as_py(), np.uint64))
            owners.append(np.frombuffer(o.as_py(), np.int64))
            size += len(tokens[-1])
            if size > max(4 * FLUSH, len(known)):
                e = merge(tokens, owners)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])
                tokens, owners, size = [], [], 0
    if size:
        e = merge(tokens, owners)
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])


# -- the tree ----------------------------------------------------------------------------


class Forest:
    """Union-find over the documents of a task; ``known`` seeds what is connected."""

    def __init__(self, known: list[int]):
        self.up = list(range(len(known)))
        first: dict[int, int] = {}
        for i, root in enumerate(known):
            self.up[i] = first.setdefault(root, i)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class Tree:
    """Signature tree over rows ``ids`` of bitmaps: levels from leaves up, each with OR
    bitmaps, least and greatest size."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray, sizes: np.ndarray):
        self.ids = ids
        n = len(ids)
        self.levels = []
        orred, low, high = bits[ids], sizes[ids], sizes[ids]
        while True:
            at = np.arange(0, len(low), FANOUT)
            orred, low, high = np.bitwise_or.reduceat(orred, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((orred, low, high))
            if len(low) <= 1:
                break
        self.n = n

    def children(self, level: int, node: int) -> range:
        count = self.n if level == 0 else len(self.levels[level - 1][1])
        return range(node * FANOUT, min(count, (node + 1) * FANOUT))

    def docs(self, level: int, node: int) -> np.ndarray:
        width = FANOUT ** (level + 1)
        return self.ids[node * width : (node + 1) * width]


def shared_tokens(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the shingles that at least two of the sets have: owner and position of each entry, and
    how many there are."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    by = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[by], owner[by]
    start = np.r_[True, tokens[1:] != tokens[:-1]]
    at = np.flatnonzero(start)
    many = np.diff(np.r_[at, len(tokens)]) > 1
    position = np.cumsum(many) - 1
    run = np.cumsum(start) - 1
    shared = many[run]
    return owner[shared], position[run[shared]], int(many.sum())


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, known: list[int], least: float, counts: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that connect what ``known`` leaves apart, between left and right (which may be
    the same rows): enough of them for the components, by a walk of both trees together.

    counts: (weights, sums) of the sets; then nothing is left for being connected, and each
    link adds either side's weight to the other's sum."""
    sizes = np.array([len(s) for s in sets], np.int64)
    # Alike sizes next to each other, and within them sets of the same smallest hash.
    band, smallest = np.floor(np.log(sizes) / -np.log(least)) if least < 1 else sizes, np.array([s[0] for s in sets])
    order = lambda rows: rows[np.lexsort((sizes[rows], smallest[rows], band[rows]))]
    forest, found = Forest(known), []
    first = order(left)
    todo = [(first, first if left is right else order(right))]
    while todo:
        x, y = todo.pop()
        if sizes[x].max() < least * sizes[y].min() - 1e-9 or sizes[y].max() < least * sizes[x].min() - 1e-9:
            continue
        rows = x if x is y else np.concatenate([x, y])
        owner, position, n = shared_tokens([sets[i] for i in rows])
        width = max(1, -(-n // 64))
        if len(rows) * width * 8 > BITMAP_BYTES and len(rows) > 2 * FANOUT:
            if x is y:
                a, b = x[: len(x) // 2], x[len(x) // 2 :]
                todo += [(a, a), (b, b), (a, b)]
            elif len(x) >= len(y):
                todo += [(x[: len(x) // 2], y), (x[len(x) // 2 :], y)]
            else:
                todo += [(x, y[: len(y) // 2]), (x, y[len(y) // 2 :])]
            continue
        bits = np.zeros((len(rows), width), np.uint64)
        np.bitwise_or.at(bits, (owner, position // 64), np.uint64(1) << (position % 64).astype(np.uint64))
        _walk(bits, rows, len(x), x is y, sizes, forest, found, least, counts)
    return found


def _walk(bits, rows, n_left: int, same: bool, sizes, forest, found, least: float, counts) -> None:
    """The trees over the first ``n_left`` rows and over the others (all, if they are the same)."""
    mine = sizes[rows]
    a = Tree(np.arange(n_left), bits, mine)
    b = a if same else Tree(np.arange(n_left, len(rows)), bits, mine)
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, x, lb, y = stack.pop()
        (oa, lowa, higha), (ob, lowb, highb) = a.levels[la], b.levels[lb]
        if higha[x] < least * lowb[y] - 1e-9 or highb[y] < least * lowa[x] - 1e-9:
            continue
        most = min(int(np.bitwise_count(oa[x] & ob[y]).sum()), int(higha[x]), int(highb[y]))
        if most < needed_overlap(int(lowa[x]), int(lowb[y]), least):
            continue
        at_a, at_b = a.docs(la, x), b.docs(lb, y)
        rows_a, rows_b = rows[at_a], rows[at_b]
        if counts is None:
            roots = {forest.root(int(i)) for i in rows_a}
            if len(roots) == 1 and all(forest.root(int(i)) in roots for i in rows_b):
                continue
        if la == 0 and lb == 0:
            overlap = np.bitwise_count(bits[at_a][:, None, :] & bits[at_b][None, :, :]).sum(axis=2, dtype=np.int64)
            hit = overlap >= needed_overlap(sizes[rows_a][:, None], sizes[rows_b][None, :], least)
            if counts is not None:
                weights, sums = counts
                hit &= rows_a[:, None] != rows_b[None, :]
                sums[rows_a] += hit @ weights[rows_b]
                if not (same and x == y):
                    sums[rows_b] += weights[rows_a] @ hit
            for i, j in zip(*np.nonzero(hit), strict=True):
                i, j = int(rows_a[i]), int(rows_b[j])
                if i != j and forest.join(i, j):
                    found.append((i, j))
        elif same and la == lb and x == y:
            kids = a.children(la, x)
            stack += [(la - 1, i, la - 1, j) for i in kids for j in kids if i <= j]
        elif la >= lb:
            stack += [(la - 1, i, lb, y) for i in a.children(la, x)]
        else:
            stack += [(la, x, lb - 1, j) for j in b.children(lb, y)]


def _tasks(least: float, count: bool, salt: int):
    """Rows sorted by (grp, i, j): node, block, root, copies, text -> the links each task
    finds, and with ``count`` each node's sum of linked copies (without b)."""

    def solve(rows):
        nodes, side, sets, known, first, copies = zip(*rows, strict=True)
        counts = (np.array(copies, np.int64), np.zeros(len(rows), np.int64)) if count else None
        side = np.array(side)
        left = np.flatnonzero(side == side.min())
        right = left if side.min() == side.max() else np.flatnonzero(side == side.max())
        out = links(sets, left, right, known, least, counts)
        if right is not left and first[0]:  # the first round joins a block with itself as well
            both = Forest(known)
            for x, y in out:
                both.join(x, y)
            out += links(sets, right, right, [both.root(k) for k in range(len(rows))], least, counts)
        sums = [(nodes[k], None, int(counts[1][k])) for k in np.flatnonzero(counts[1])] if count else []
        return [(nodes[x], nodes[y], None) for x, y in out] + sums

    def run(batches):
        cache, key, rows, seen = WordHash(), None, [], set()

        def done():
            e = solve(rows) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in e], pa.int64()) for k in range(3)], ["a", "b", "n"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[:8]]
            for k, text in enumerate(raw_texts(batch.column(8))):
                now = (cols[0][k], cols[1][k], cols[2][k])
                if now != key:
                    if rows:
                        yield done()
                    key, rows, seen = now, [], set()
                node = cols[3][k]
                if node in seen:
                    continue
                s = shingle_set(word_hashes(text, cache))
                if digest(s, salt) == node:  # else: another row of the same id
                    seen.add(node)
                    rows.append((node, cols[4][k], s, cols[5][k], cols[6][k], cols[7][k]))
        if rows:
            yield done()

    return run


def _near(df: DataFrame, narrow: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a narrow stored table, which is broadcast if it is small."""
    return df.join(if_small(narrow, 96), keys)


def _linked(nodes: DataFrame, texts: DataFrame, tasks: DataFrame, least: float, salt: int, first: bool, count: bool = False) -> DataFrame:
    """tasks: grp, i, j, block. What is found where a task's blocks meet (``_tasks``)."""
    rows = stored(tasks.join(nodes, ["grp", "block"]).select("grp", "i", "j", "node", "block", "root", "copies"), "tasks")
    read = _near(texts, rows, ["node"]).select("grp", "i", "j", "node", "block", "root", F.lit(first).alias("first"), "copies", "text")
    parts = shuffle_parts(texts.sparkSession)
    return stored(read.repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(lean(_tasks(least, count, salt)), "a long, b long, n long"), "links")


def _counted(both: DataFrame, parts: int) -> DataFrame:
    """node, repeated: the sums of what ``_repeats`` has counted."""
    return both.where("a is not null").select("part", "a", "b").repartitionById(parts, "part").mapInArrow(lean(_summed), "node long, repeated long")


def _grouped(docs: DataFrame, least: float) -> tuple:
    """Rows with their node; nodes; texts of those that may link; their groups and blocks;
    the first round's tasks, block j with block 0 and with itself; the salt of the digests."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    parts = shuffle_parts(spark, text_bytes(docs), 16 << 20)
    salt = 0
    while True:
        dealt = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(_describe(parts, salt, False)), DEALT)
        sets = new_path(spark, "sets")
        both = stored(dealt.repartitionById(parts, "part").mapInArrow(lean(_repeats(parts)), DEALT), path=sets)
        described = stored(both.where("a is null").select("doc_id", "n", "half", "node", "witness"), "described")
        ids = described.where("node is not null").groupBy("node").agg(F.min(doc_key()).alias("d"), F.first("n").alias("n"), F.first("half").alias("half"), F.count(F.lit(1)).alias("copies"), (F.min("witness") < F.max("witness")).alias("mixed"))
        ids = stored(ids, "nodes")
        if ids.where("mixed").isEmpty():
            break
        drop_path(spark, sets)
        salt += 1  # two sets share a digest
    missing = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9)  # at most, in a set that links
    left = ids.join(_counted(both, parts), "node", "left").where(F.coalesce("repeated", F.lit(0)) >= F.col("half") - missing).select("node", "d", "n")
    left = stored(left, "left")
    drop_path(spark, sets)
    some = new_path(spark, "some")
    texts = _near(docs.select(doc_key().alias("d"), "text"), left.select("node", "d"), ["d"]).select("node", "d", "text").mapInArrow(lean(_verified(salt)), "node long, d long, text string")
    texts = stored(texts, path=some)
    parts = shuffle_parts(spark, text_bytes(texts), 8 << 20)
    sets = new_path(spark, "sets")
    dealt = texts.select(F.col("d").alias("doc_id"), "text").mapInArrow(lean(_describe(parts, salt, True)), DEALT)
    both = stored(dealt.repartitionById(parts, "part").mapInArrow(lean(_repeats(parts)), DEALT), path=sets)
    left = stored(left.join(_counted(both, parts), "node").where(F.col("repeated") >= F.col("n") - missing), "left")
    drop_path(spark, sets)
    texts = stored(_near(texts, left.select("node"), ["node"]), "texts")
    drop_path(spark, some)
    shingles = left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counters = min(COUNTERS, max(FEWEST, 1 << int(shingles).bit_length()))

    pieces = texts.select("text").mapInArrow(lean(_sketch(counters)), "piece int, counts binary").repartition(PIECES, "piece").mapInArrow(lean(_add_up), "piece int, counts binary")
    table = {r.piece: bytes(r.counts) for r in pieces.collect()}  # at most COUNTERS bytes
    blank = bytes(counters // PIECES)
    counts = spark.sparkContext.broadcast([table.get(i, blank) for i in range(PIECES)])
    entries = texts.select("text").mapInArrow(lean(_prefixes(counts, counters, parts, least, salt)), "part int, tokens binary, owners binary")
    ties = stored(entries.repartitionById(parts, "part").mapInArrow(lean(_ties), "a long, b long"), "ties")
    counts.destroy()
    groups = components(ties).select("node", F.col("root").alias("grp"))

    members = stored(groups.join(ids, "node"), "members")
    sizes = members.groupBy("grp").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    members = members.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = stored(members.select("grp", "node", "d", "block", "blocks", "copies", F.col("node").alias("root")), "members")
    blocks = members.groupBy("grp", "block").agg(F.first("blocks").alias("blocks"))
    own = blocks.select("grp", F.lit(0).alias("i"), F.col("block").alias("j"), "block")
    zero = blocks.where("block > 0").select("grp", F.lit(0).alias("i"), F.col("block").alias("j"), F.lit(0).alias("block"))
    return described, ids, texts, members, own.unionAll(zero), salt


def jaccard_components(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id and node (the digest of the document's set)."""
    described, ids, texts, members, tasks, salt = _grouped(docs, least)
    found = _linked(members, texts, tasks, least, salt, True)
    if not members.where("blocks > 2").isEmpty():
        roots = components(found)
        rooted = members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = stored(rooted, "members")
        state = rooted.where("blocks > 2 and block > 0").groupBy("grp", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        x, y = state.select("grp", F.col("block").alias("i"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1")), state.select("grp", F.col("block").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        pairs = stored(x.join(y, "grp").where("i < j and least(lo1, lo2) < greatest(hi1, hi2)").select("grp", "i", "j"), "pairs")
        tasks = pairs.select("grp", "i", "j", F.explode(F.array("i", "j")).alias("block"))
        found = found.unionAll(_linked(rooted, texts, tasks, least, salt, False))
    return _in_components(described, ids, found, salt).select("doc_id", "n_shingles", "component_id", "node", "salt")


def jaccard_links(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """The columns of ``jaccard_components`` and n_links, how many other rows link with it."""
    described, ids, texts, members, tasks, salt = _grouped(docs, least)
    found = _linked(members, texts, tasks, least, salt, True, True)
    blocks = stored(members.where("blocks > 2 and block > 0").select("grp", "block").distinct(), "blocks")
    if not blocks.isEmpty():
        pairs = blocks.withColumnRenamed("block", "i").join(blocks.withColumnRenamed("block", "j"), "grp").where("i < j")
        tasks = pairs.select("grp", "i", "j", F.explode(F.array("i", "j")).alias("block"))
        found = found.unionAll(_linked(members, texts, tasks, least, salt, False, True))
    sums = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("_sum"))
    out = _in_components(described, ids, found.where("b is not null"), salt).join(sums, "node", "left")
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("_sum", F.lit(0)), F.lit(0)).cast("long")
    return out.select("doc_id", "n_shingles", "component_id", "node", n_links.alias("n_links"))


def _in_components(described: DataFrame, ids: DataFrame, found: DataFrame, salt: int) -> DataFrame:
    """doc_id, n_shingles, component_id, node (with its salt) and copies, the rows of the same set."""
    roots = components(found)
    named = stored(ids.join(roots, "node", "left").select("node", "d", "copies", F.coalesce("root", "node").alias("root")), "named")
    smallest = named.groupBy("root").agg(F.min("d").alias("component_id"))
    classes = named.join(smallest, "root").select("node", "component_id", "copies")
    out = described.join(classes, "node", "left")
    own_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("component_id"), F.lit(2**63 - 1)))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own_id.alias("component_id"), "node", F.lit(salt).alias("salt"), "copies")


def _chosen(name: str):
    """Rows with the digests that their id is kept for, in ``nodes``: marks whose set is one."""

    def run(batches):
        cache = WordHash()
        for batch in batches:
            nodes, salts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            mine = [digest(s, salt) if len(s) else 0 for s, salt in zip(_sets(batch, 0, cache), salts, strict=True)]
            marks = pa.array([n if n in w else None for n, w in zip(mine, nodes, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], marks], [*batch.schema.names[3:], name])

    return run


def keep_one(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """One document of each component: the row with the smallest id. Rows without words all
    stay. Of equal sets under one id one row stays. All columns pass, whatever their names."""
    from pyspark.sql import types as T

    none = F.lit(2**63 - 1)
    d, rows, nodes, salt, text, node = own_names(docs, "_d", "_rows", "_nodes", "_salt", "_text", "_node")
    found = jaccard_components(docs, least).select(F.coalesce("doc_id", none).alias(d), F.coalesce("component_id", none).alias("c"), "node", "salt")
    found = stored(found, "kept")
    ids = found.groupBy(d).agg(F.count(F.lit(1)).alias(rows), F.first("salt").alias(salt), F.collect_set(F.when(F.col(d) == F.col("c"), F.coalesce("node", F.lit(0)))).alias(nodes))
    ids = stored(ids, "kept")
    keyed = docs.withColumn(d, doc_key())
    # Rows alone under their id: of those that stay and the others, the fewer are met.
    stay = (F.col(rows) == 1) & (F.size(nodes) > 0)
    once, others = ids.where(stay).select(d), ids.where(~stay).select(d)
    if others.count() <= once.count():
        out = keyed.join(if_small(others, 64), d, "left_anti").select(*docs.columns)
    else:
        out = keyed.join(if_small(once, 64), d, "left_semi").select(*docs.columns)
    ids = ids.where(F.size(nodes) > 0)
    if ids.where(F.col(rows) > 1).isEmpty():
        return out
    # Ids on several rows: each row's own set decides.
    again = keyed.join(ids.where(F.col(rows) > 1), d).select(F.col("text").alias(text), nodes, salt, *docs.columns)
    marked = again.mapInArrow(lean(_chosen(node)), T.StructType([*docs.schema.fields, T.StructField(node, T.LongType())])).where(F.col(node).isNotNull())
    worded = marked.where(F.col(node) != 0).dropDuplicates(["doc_id", node])
    return out.unionAll(worded.select(*docs.columns)).unionAll(marked.where(F.col(node) == 0).select(*docs.columns))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_links(docs).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)
), sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS same FROM s GROUP BY doc_id),
rep AS (SELECT same, min(doc_id) AS r, any_value(n) AS n, count(*) AS c FROM sets GROUP BY same),
t AS (SELECT r, n, s FROM rep JOIN s ON s.doc_id = rep.r),
p AS (
  SELECT a.r AS x, b.r AS y FROM t a JOIN t b ON a.s = b.s AND a.r < b.r AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
root AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
linked AS (SELECT e.x, sum(rep.c) AS k FROM e JOIN rep ON rep.r = e.y GROUP BY e.x)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(least(rep.r, root.y), d.doc_id) AS component_id, coalesce(rep.c - 1 + coalesce(linked.k, 0), 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN rep USING (same) LEFT JOIN root ON root.x = rep.r LEFT JOIN linked ON linked.x = rep.r
"""
