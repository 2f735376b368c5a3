"""Exact top-k by inner product with M-trees.

Largest inner products become nearest neighbours by one more coordinate, sqrt(M^2 - |x|^2)
with M the largest norm, 0 for queries: then d^2 = |q|^2 + M^2 - 2 <q, x>. Vectors are dealt
out by hash; each part is bulk-loaded into an M-tree: pages of entries under a routing
vector, with its covering radius and, for every entry, the stored distance to its parent.
The search is best first: a queue of pages by the least distance that their radius admits.
|d(q, parent) - d(x, parent)| bounds d(q, x) from below, so many entries are left without a
distance. It ends when the nearest page is further than the k-th best; ties in score are
kept apart by the smaller id, so pages are left only if they are strictly worse.

Queries go in blocks against every part; a task holds one tree and one block. The k best of
all parts are ranked by a window over each query's k x parts rows.

Nulls: vectors that are null, empty or hold null or non-finite components take no part, nor
do rows without an id; shorter vectors count as padded with zeros. Rows with the query's id
are its own and never found; a repeated query id is asked once for each row and its best k
are ranked over all. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import need, stored

#: Vectors in a tree and queries in a block, on average; entries of a page.
PART_ROWS, BLOCK_ROWS, PAGE = 8192, 2048, 256


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norm2 = (vectors**2).sum(1)
        self.m2 = float(norm2.max())
        lifted = np.c_[vectors, np.sqrt(np.maximum(self.m2 - norm2, 0))]
        self.nodes: list[dict] = []
        rng = np.random.default_rng(5)
        self.root = self._build(np.arange(len(ids)), lifted, ids, vectors, None, rng)

    def _build(self, rows, x, ids, vectors, parent, rng) -> int:
        """A page over these rows; ``parent`` is its routing vector (none for the root)."""
        own = x[rows]
        to_parent = np.zeros(len(rows)) if parent is None else np.linalg.norm(own - parent, axis=1)
        if len(rows) <= PAGE:
            node = {"leaf": True, "ids": ids[rows], "vectors": vectors[rows], "to_parent": to_parent}
        else:
            pivots = own[rng.choice(len(rows), min(PAGE, max(2, -(-2 * len(rows) // PAGE))), replace=False)]
            near = ((pivots**2).sum(1)[None] - 2 * own @ pivots.T).argmin(1)
            kept = [p for p in range(len(pivots)) if (near == p).any()]
            if len(kept) == 1:  # all alike: pages of equal vectors
                groups = np.array_split(np.arange(len(rows)), -(-len(rows) // PAGE))
                kept, pivots = list(range(len(groups))), np.repeat(pivots[kept], len(groups), axis=0)
            else:
                groups = [np.flatnonzero(near == p) for p in kept]
                pivots = pivots[kept]
            kids = [self._build(rows[g], x, ids, vectors, p, rng) if len(g) < len(rows) else -1 for g, p in zip(groups, pivots, strict=True)]
            radius = np.array([np.linalg.norm(own[g] - p, axis=1).max() for g, p in zip(groups, pivots, strict=True)])
            node = {"leaf": False, "kids": kids, "pivots": pivots, "radius": radius, "to_parent": np.zeros(len(kids)) if parent is None else np.linalg.norm(pivots - parent, axis=1)}
        self.nodes.append(node)
        return len(self.nodes) - 1

    def search(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id); q is integral, so scores are exact."""
        lifted, q2 = np.r_[q, 0.0], float(q @ q)
        slack = 1e-6 * (1.0 + q2 + self.m2)
        best: list[tuple[int, int]] = []  # heap of (score, -id), worst first
        queue, turn = [(0.0, 0, self.root, 0.0)], 0

        def reach() -> float:
            """The distance beyond which nothing can count."""
            if len(best) < k:
                return np.inf
            return np.sqrt(max(q2 + self.m2 - 2 * best[0][0] + slack, 0.0))

        while queue:
            low, _, at, to_routing = heapq.heappop(queue)
            limit = reach()
            if low > limit:
                break
            node = self.nodes[at]
            root = at == self.root
            if node["leaf"]:
                ids, page = node["ids"], node["vectors"]
                if not root and limit < np.inf:
                    see = np.abs(to_routing - node["to_parent"]) <= limit
                    if not see.all():
                        ids, page = ids[see], page[see]
                score = page @ q
                ok = ids != own
                if len(best) == k:
                    ok &= score >= best[0][0]
                ids, score = ids[ok], score[ok]
                if len(ids) > k:
                    top = np.lexsort((ids, -score))[:k]
                    ids, score = ids[top], score[top]
                for s, i in zip(score.tolist(), ids.tolist(), strict=True):
                    item = (int(s), -i)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                continue
            see = np.arange(len(node["kids"])) if root else np.flatnonzero(np.abs(to_routing - node["to_parent"]) - node["radius"] <= limit)
            d = np.linalg.norm(node["pivots"][see] - lifted, axis=1)
            lower = np.maximum(d - node["radius"][see], 0.0)
            for j, lo, dist in zip(see.tolist(), lower.tolist(), d.tolist(), strict=True):
                if lo <= limit:
                    turn += 1
                    heapq.heappush(queue, (lo, turn, node["kids"][j], dist))
        return [(s, -i) for s, i in best]


def _vectors(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) for v in batch.column(column).to_pylist()]


def _padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _pack(make):
    """Rows (part, id, v) sorted by part -> (part, pickled make(ids, vectors))."""

    def run(batches):
        now, ids, vectors = None, [], []

        def done():
            a = _padded(vectors, max(map(len, vectors)))
            return pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "blob": [pickle.dumps(make(np.array(ids, np.int64), a), 5)]})

        for batch in batches:
            for p, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _vectors(batch, 2), strict=True):
                if p != now and ids:
                    yield done()
                    ids, vectors = [], []
                now = p
                ids.append(i)
                vectors.append(v)
        if ids:
            yield done()

    return run


def _search(k: int):
    def run(batches):
        for batch in batches:
            for tree, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree, (ids, vectors) = pickle.loads(tree), pickle.loads(block)
                width = tree.nodes[0]["vectors"].shape[1] if tree.nodes[0]["leaf"] else len(tree.nodes[0]["pivots"][0]) - 1
                out = []
                for own, q in zip(ids.tolist(), vectors, strict=True):
                    q = q[:width] if len(q) >= width else np.r_[q, np.zeros(width - len(q))]
                    out += [(own, i, s) for s, i in tree.search(q, own, k)]
                cols = zip(*out, strict=True) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables: vec_id, v array<double> of whole numbers."""
    vectors, queries = stored(vectors, "vectors"), stored(queries, "queries")
    parts, blocks = max(1, -(-vectors.count() // PART_ROWS)), max(1, -(-queries.count() // BLOCK_ROWS))

    def packed(df: DataFrame, n: int, make) -> DataFrame:
        dealt = df.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("part"), "vec_id", "v")
        return dealt.repartition(n, "part").sortWithinPartitions("part", "vec_id").mapInArrow(_pack(make), "part int, blob binary")

    trees = stored(packed(vectors, parts, MTree), "trees").select("part", F.col("blob").alias("tree"))
    asked = stored(packed(queries, blocks, lambda ids, v: (ids, v)), "blocks").select(F.col("part").alias("block"), F.col("blob").alias("queries"))
    # Every block meets every tree: pairs by number, one task each.
    pairs = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked, "block").repartition(parts * blocks, "part", "block")
    found = pairs.select("tree", "queries").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(table: DataFrame, column: str = "embedding", grid: float = 64.0) -> DataFrame:
    """vec_id and v, floor(grid * component), of the rows that take part."""
    need(table, "vec_id", column)
    x = F.col(column)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(F.lit(grid) * c.cast("double")).cast("double")).alias("v"))


def op5_topk(spark, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, list_dot_product(q.v, x.v)::BIGINT AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
