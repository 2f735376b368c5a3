import random
import re

import pytest

from panelforge.llm import common, jaccard
from tests.llm.conftest import unharmed

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, num=75):
    sets = [(d, shingles(t)) for d, t in rows]
    kinds = list({s for _, s in sets if s})
    up = {s: s for s in kinds}

    def root(s):
        while up[s] is not s:
            s = up[s]
        return s

    holders = {}
    for s in kinds:
        for x in s:
            holders.setdefault(x, []).append(s)
    for s in kinds:
        near = {}
        for x in s:
            for o in holders[x]:
                near[o] = near.get(o, 0) + 1
        for o, n in near.items():
            if 100 * n >= num * (len(s) + len(o) - n) and root(s) is not root(o):
                up[root(o)] = root(s)
    low = {}
    for d, s in sets:
        if s and d is not None:
            low[root(s)] = min(d, low.get(root(s), d))
    return [(d, len(s), low.get(root(s)) if s else d) for d, s in sets]


def brute_links(rows, num=75):
    """(doc_id, n_shingles, component, links) over all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    out = []
    for k, s in enumerate(sets):
        near = {}
        for x in s:
            for o in holders[x]:
                near[o] = near.get(o, 0) + 1
        out.append(sum(100 * n >= num * (len(s) + len(sets[o]) - n) for o, n in near.items() if o != k))
    return [(*r, n) for r, n in zip(brute(rows, num), out, strict=True)]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in jaccard.op8_jaccard(spark, SF).collect()]
    same(got, brute_links(rows))
    assert sum(r[0] != r[2] for r in got) > 50


@pytest.mark.parametrize("block", [1 << 19, 700])
def test_groups_in_blocks(spark, monkeypatch, block):
    """Near copies of each other at and around the threshold, with one passage in all."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(5)
    passage = " ".join(f"common{i}" for i in range(40))
    rows = []
    for base in range(6):
        words = [f"b{base}w{i}" for i in range(60)]
        for k in range(12):
            w = words[:]
            for _ in range(rng.choice([0, 1, 2, 2, 3])):
                w[rng.randrange(60)] = f"x{rng.random()}"
            rows.append((base * 100 + k, " ".join(w) + " " + passage * (base % 2)))
    rows.append((0, rows[0][1].upper()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same([tuple(r)[:3] for r in jaccard.jaccard_components(df).collect()], brute(rows))


@pytest.mark.parametrize("block", [1 << 19, 700])
def test_every_link_is_counted(spark, monkeypatch, block, odd, none):
    """Groups of mutual near copies, exact copies among them, in one and in several blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(6)
    rows = []
    for base in range(4):
        words = [f"b{base}w{i}" for i in range(60)]
        for k in range(40):
            w = words[:]
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(60)] = f"x{rng.random()}"
            rows.append((base * 100 + k, " ".join(w)))
    rows.append((0, rows[0][1].upper()))
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    same(got, brute_links(rows))
    assert max(r[3] for r in got) > 20
    mine = [(r.doc_id, r.text) for r in odd.collect()]
    same([(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_links(odd).collect()], brute_links(mine))
    assert jaccard.jaccard_links(none).count() == 0


def test_digests_that_collide(spark, monkeypatch):
    """Sets that share a name under the first salt are told apart under the next."""
    real = jaccard.digest
    monkeypatch.setattr(jaccard, "digest", lambda s, salt: len(s) if salt == 0 else real(s, salt))
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(30))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same([tuple(r)[:3] for r in jaccard.jaccard_components(df).collect()], brute(rows))


def test_bitmaps_in_parts(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**60, (20, 40)).astype(np.uint64)
    sets = [np.unique(np.r_[base[i % 20][: rng.integers(34, 41)], rng.integers(0, 2**60, 3).astype(np.uint64)]) for i in range(300)]
    rows, known = np.arange(300), list(range(300))

    def sums(limit, left, right):
        monkeypatch.setattr(jaccard, "BITMAP_BYTES", limit)
        counts = (np.arange(1, 301), np.zeros(300, np.int64))
        jaccard.links(sets, left, right, known, 0.75, counts)
        return counts[1].tolist(), len(jaccard.links(sets, left, right, known, 0.75))

    for left, right in ((rows, rows), (rows[:100], rows[100:])):
        assert sums(1 << 30, left, right) == sums(4000, left, right)
    assert sum(sums(4000, rows, rows)[0]) > 0


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    same([tuple(r)[:3] for r in jaccard.jaccard_components(odd).collect()], brute(rows))
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in unharmed(kept)), key=repr) == sorted([1, 3, 4, 5, None, 6, 7, 8, 9], key=repr)
    assert jaccard.jaccard_components(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_deals_half_and_keeps_what_links(spark, tmp_path, monkeypatch):
    """Shingles that are dealt out at first are about half of all; what is stored for it goes."""
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    rng = random.Random(3)
    rows = []
    for k in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((1, 5, 6, 9, 14, 40, 120)))]
        for copy in range(3):
            other = list(words)
            for _ in range(rng.randrange(1 + len(words) // 25)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(5000)}"
            rows.append((3 * k + copy, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.jaccard_links(df).select("doc_id", "n_shingles", "component_id", "n_links").collect()))
    assert got == sorted(brute_links(rows))
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith(("sets", "some"))] and len([p for p in tmp_path.iterdir() if p.name.startswith("edges")]) <= 2
    batch = df.coalesce(1).toArrow().to_batches()[0]
    dealt = [b for b in jaccard._describe(4, 0, False)(iter([batch]))]
    bytes_dealt = sum(len(x) for b in dealt for x in b.column(6).to_pylist() if x)
    every = {s for _, t in rows if (s := shingles(t))}
    assert 0.4 < bytes_dealt / 4 / sum(map(len, every)) < 0.6


def test_keep_one_sends_the_fewer(spark, monkeypatch):
    """Where few documents go, it is their ids that are broadcast."""
    rows = [(k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(500)] + [(1000 + k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(common, "BROADCAST_BYTES", 5_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jaccard.keep_one(df)
        assert sorted(r.doc_id for r in out.collect()) == list(range(500))
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_task_takes_one_hash_range(spark, docs, monkeypatch):
    """However many hash ranges there are, no worker holds the shingles of two."""

    def watched(made):
        def wrap(batches):
            seen = set()
            for batch in batches:
                seen |= set(batch.column(0).to_pylist())
                assert len(seen) == 1 or not batch.num_rows, f"ranges {sorted(seen)} in one task"
                yield batch

        return lambda batches: made(wrap(batches))

    repeats, ties = jaccard._repeats, jaccard._ties
    monkeypatch.setattr(jaccard, "_repeats", lambda parts: watched(repeats(parts)))
    monkeypatch.setattr(jaccard, "_ties", watched(ties))
    monkeypatch.setattr(jaccard, "shuffle_parts", lambda *_: 16)
    described, *_ = jaccard._grouped(docs.select("doc_id", "text"), 0.75)
    assert described.count() == docs.count()
