"""Chunks, top-k search, quality and language-model scores."""

import collections
import itertools
import math
import os
import pickle
import re
import resource
import types
import uuid
import zlib

import numpy as np
import pytest

from panelforge.llm import chunks, common, ngramlm, quality, topk
from tests.llm.conftest import unharmed

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# -- substring dedup ---------------------------------------------------------------------


def plain_starts(text):
    """The same cuts, byte by byte."""
    cuts, h = [], []
    for i in range(len(text)):
        v = 0
        for k in range(min(16, i + 1)):
            v = (v + (int(chunks.GEAR[text[i - k]]) << k)) & 0xFFFFFFFF
        h.append(v)
    last = -chunks.CROWD
    for i, v in enumerate(h):
        if (v >> chunks.SHIFT) & chunks.CUT == 0:
            if i + 1 - last >= chunks.CROWD and i + 1 < len(text):
                cuts.append(i + 1)
            last = i + 1
    out = []
    edges = [0, *cuts, len(text)]
    for a, b in zip(edges, edges[1:]):
        out += list(range(a, b, chunks.LONGEST))
    return out


def test_cuts(rows):
    for text in [b"", b"a", b"a" * 3000, *[t[:4000].encode() for _, t in rows[:40]]]:
        assert chunks.chunk_starts(text).tolist() == plain_starts(text)


def brute_passages(rows, least=chunks.LEAST_WORDS):
    """Every chunk with an earlier holder, extended by itself, byte by byte."""
    big = 2**63 - 1
    texts = sorted({(big if d is None else d, chunks.row_of((t or "").encode()), (t or "").encode()) for d, t in rows})
    first, last = {}, {}
    cut = [(d, r, t, a, b) for d, r, t in texts for s in [chunks.chunk_starts(t).tolist()] for a, b in zip(s, [*s[1:], len(t)])]
    for d, r, t, a, b in cut:
        first.setdefault(t[a:b], (d, r, t, a))
    spans, seen = {}, set()
    for d, r, t, a, b in cut:
        kd, kr, k, x = first[t[a:b]]
        if kd == d or (d, r, kd, kr, a - x, a) in seen:
            continue
        s, e, y = a, b, x + b - a
        while s and x and t[s - 1] == k[x - 1]:
            s, x = s - 1, x - 1
        while e < len(t) and y < len(k) and t[e] == k[y]:
            e, y = e + 1, y + 1
        while s < a and t[s] & 0xC0 == 0x80:
            s += 1
        while e > b and e < len(t) and t[e] & 0xC0 == 0x80:
            e -= 1
        begins = chunks.words_before(t)
        if begins[e] - begins[s] >= least:
            spans[d, r, s, e] = min(kd, spans.get((d, r, s, e), kd))
    by_row = collections.defaultdict(list)
    for (d, r, s, e), kd in spans.items():
        by_row[d, r].append((s, e, kd))
    count = {(d, r): chunks.words_before(t) for d, r, t in texts}
    return sorted((d, r, s, e, int(count[d, r][e] - count[d, r][s]), kd) for (d, r), x in by_row.items() for s, e, kd in x if not any((s2, e2) != (s, e) and s2 <= s and e <= e2 for s2, e2, _ in x))


@pytest.mark.parametrize("often", [64, 1])
def test_repeated_passages(spark, rows, odd, none, monkeypatch, often):
    monkeypatch.setattr(chunks, "OFTEN", often)
    some = rows[:400] if often == 1 else rows
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = sorted(tuple(r) for r in chunks.repeated_passages(df).collect())
    assert got == brute_passages(some) and len(got) > 20
    mine = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in chunks.repeated_passages(odd, 3).collect()) == brute_passages(mine, 3)
    assert chunks.dedup_substrings(none).count() == 0
    cut = chunks.dedup_substrings(odd, 3)
    assert cut.columns == [*odd.columns, "n_cut_2"]
    unharmed(cut, 12)
    gone = collections.Counter(d for d, *_ in brute_passages(mine, 3))
    assert all(r.n_cut_2 == gone[2**63 - 1 if r.doc_id is None else r.doc_id] for r in cut.collect())


def test_substring_query(spark, rows):
    got = [tuple(r) for r in chunks.op9_substring_dedup(spark, SF).select("doc_id", "start_byte", "end_byte", "words", "kept_doc_id").collect()]
    assert sorted(got) == sorted((d, s, e, w, k) for d, _, s, e, w, k in brute_passages(rows))


def test_passages_of_51_words_are_cut_out(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 7)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passages = [fresh(51) for _ in range(400)]
    data = [(k * 1000 + i, f"{fresh(40)} {p} {fresh(40)}") for k in (0, 1) for i, p in enumerate(passages)]
    left = {r.doc_id: r.text for r in chunks.dedup_substrings(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(p in left[i] for i, p in enumerate(passages)) == 400
    assert sum(p[20:-20] in left[1000 + i] for i, p in enumerate(passages)) <= 4
    assert sum(len(left[1000 + i].split()) <= 82 for i in range(400)) >= 396


def test_passages_are_whole_in_their_keeper(spark, rows, odd, none):
    raw = collections.defaultdict(list)
    for d, t in rows:
        raw[d].append((t or "").encode())
    got = chunks.op9_substring_dedup(spark, SF).collect()
    assert len(got) == len(set(got)) > 100
    for r in got:
        (mine,), (kept,) = raw[r.doc_id], raw[r.kept_doc_id]
        span = mine[r.start_byte : r.end_byte]
        assert r.kept_doc_id < r.doc_id and span in kept
        begins = [m.start() for m in re.finditer(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]", mine)]
        assert r.words == sum(r.start_byte <= b < r.end_byte for b in begins) >= 40
    assert chunks.repeated_passages(odd).count() >= 0 and chunks.repeated_passages(none).count() == 0


def test_windows_widen(spark, monkeypatch):
    """Accents that differ in their second byte stand beside a passage; equal rows, no ids."""
    rng = np.random.default_rng(5)
    p = " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60))
    data = [(1, f"x é{p}é y"), (2, f"z ã{p}ã w"), (2, f"z ã{p}ã w"), (None, f"{p} v"), (None, f"{p} v"), (None, f"u {p}")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = None
    for window in (128, 2):
        monkeypatch.setattr(chunks, "WINDOW", window)
        got = sorted(tuple(r) for r in chunks.repeated_passages(df).select("d", "start", "end", "kept_d").collect())
        assert want in (None, got)
        want = got
    n = len(p.encode())
    big = 2**63 - 1
    assert want == [(2, 4, 4 + n, 1), (big, 0, n, 1), (big, 2, 2 + n, 1)]
    assert [r.text for r in chunks.dedup_substrings(df).where("doc_id = 2").collect()] == ["z ãã w"] * 2


# -- top-k -------------------------------------------------------------------------------


def brute_topk(rows, k=20, every=20):
    good = [(i, np.floor(64 * np.asarray(v, np.float64))) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            score = sorted((-int(np.dot(*(np.pad(a, (0, max(len(q), len(x)) - len(a))) for a in (q, x)))), j) for j, x in good if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(score[:k])]
    return out


@pytest.mark.parametrize("part,page", [(8192, 128), (150, 8)])
def test_topk(spark, monkeypatch, part, page):
    monkeypatch.setattr(topk, "PART_ROWS", part)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 10)
    monkeypatch.setattr(topk, "PAGE", page)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in topk.op5_topk(spark, SF).collect()) == sorted(brute_topk(rows))


def test_topk_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 3, 4) / 64).tolist()) for i in range(300)] + [(400 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(200)]
    rows += [(1000, None), (1001, []), (1002, [float("nan")] * 4), (1003, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (1020, [float("inf")] * 4), (1040, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.whole_vectors(df)
    assert sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 20 = 0")).collect()) == sorted(brute_topk(rows))
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


# -- quality -----------------------------------------------------------------------------


def test_quality(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in quality.op6_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    held = [d for d in labels if got[d].held_out]
    good, bad = [got[d].score for d in held if labels[d] == 1], [got[d].score for d in held if labels[d] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97 and np.mean([got[d].predicted == labels[d] for d in held]) > 0.95
    lab = spark.createDataFrame([(1, 1), (8, 0), (9, None), (None, 1), (3, 0)], "doc_id long, quality int")
    assert quality.score_quality(odd, lab).count() == odd.count()
    unharmed(quality.reject_low_quality(odd, lab.limit(0)), 12)
    assert quality.score_quality(none, lab).count() == 0 and quality.reject_low_quality(none, lab).columns == none.columns


def test_quality_by_brute_force(spark, rows):
    """Features, ridge and calibration again in numpy, from the statistics on."""
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    text = dict(rows)
    use = [(d, y) for d, y in labels if d in text and y is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    x = np.array([quality.statistics((text[d] or "").encode()) for d, _ in use]).clip(-1e6, 1e6)
    y = np.array([y for _, y in use], float)
    scale = x.std(0)
    scale[scale <= 1e-9] = 1
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.standard_normal((x.shape[1], quality.FEATURES)) / quality.WIDTH, rng.uniform(0, 2 * np.pi, quality.FEATURES)
    lift = lambda v: np.c_[np.cos(((v - x.mean(0)) / scale).clip(-8, 8) @ w + b) * (2 / quality.FEATURES) ** 0.5, np.ones(len(v))]
    z = lift(x)
    ridge = np.diag(np.r_[np.full(quality.FEATURES, quality.RIDGE), 0.0])
    beta = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    raw = z @ beta
    k = ((raw.clip(-0.5, 1.5) + 0.5) / 2 * (quality.BINS - 1)).astype(int)
    bins = sorted(set(k.tolist()))
    n, at, mean = (np.array([f(k == j) for j in bins]) for f in (np.sum, lambda m: raw[m].mean(), lambda m: y[m].mean()))
    # Isotonic means by their min-max formula.
    total, count = np.r_[0, np.cumsum(n * mean)], np.r_[0, np.cumsum(n)]
    m = len(bins)
    level = [max(min((total[j] - total[i]) / (count[j] - count[i]) for j in range(c + 1, m + 1)) for i in range(c + 1)) for c in range(m)]
    every = sorted(text)
    want = np.interp(lift(np.array([quality.statistics((text[d] or "").encode()) for d in every]).clip(-1e6, 1e6)) @ beta, at, level)
    got = {r.doc_id: r.score for r in quality.op6_quality(spark, SF).collect()}
    np.testing.assert_allclose([got[d] for d in every], want, atol=1e-6)


def test_isotonic():
    assert quality.isotonic(np.ones(5), np.array([0.1, 0.5, 0.3, 0.3, 0.9])).tolist() == pytest.approx([0.1, 1.1 / 3, 1.1 / 3, 1.1 / 3, 0.9])


# -- language model ----------------------------------------------------------------------


def brute_lm(rows, order=2):
    def grams(t):
        w = [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
        return list(zip(*[[*[0] * j, *w][: len(w)] for j in range(order - 1, -1, -1)]))

    held = {n: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for n, (d, _) in enumerate(rows)}
    level, uni = {order: collections.Counter()}, collections.Counter()
    for n, (_, t) in enumerate(rows):
        if not held[n]:
            level[order].update(grams(t))
            uni.update(g[-1] for g in grams(t))
    often = level[order]
    for k in range(order - 1, 0, -1):
        raw, firsts = collections.Counter(), collections.Counter()
        for g, c in often.items():
            raw[g[1:]] += c
        for g in level[k + 1]:
            firsts[g[1:]] += 1
        level[k], often = collections.Counter({g: raw[g] if g[0] == 0 else c for g, c in firsts.items()}), raw
    total, v = sum(uni.values()), len(uni)
    d = {k: ngramlm.discounts(*(sum(c == i for c in x.values()) for i in (1, 2, 3, 4))) for k, x in level.items()}
    cut = lambda k, g: max(level[k][g] - d[k][min(level[k][g], 3) - 1], 0) if level[k][g] else 0.0
    back = collections.defaultdict(lambda: [0.0, 0])
    for k, x in level.items():
        for g, c in x.items():
            back[k, g[:-1]][0] += d[k][min(c, 3) - 1]
            back[k, g[:-1]][1] += c

    def p(g):
        low = p(g[1:]) if len(g) > 1 else 1 / (v + 1)
        mass, s = back.get((len(g), g[:-1]), (0, 0))
        return (cut(len(g), g) + mass * low) / s if s else low

    out = []
    for n, (i, t) in enumerate(rows):
        w = [g[-1] for g in grams(t)]
        base = sum(math.log10((uni[x] + 0.1) / (total + 0.1 * (v + 1))) for x in w)
        out.append((i, held[n], len(w), sum(uni[x] > 0 for x in w), total, round(base, 5), round(sum(math.log10(p(g)) for g in grams(t)), 5)))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm(spark, rows, odd, none, order):
    shown = lambda df: sorted(repr((*tuple(r)[:5], round(r.base_score, 5), round(r.score, 5))) for r in df.collect())
    some = rows if order < 4 else rows[:200]
    got = ngramlm.lm_scores(spark.createDataFrame(some, "doc_id long, text string"), order) if order != 3 else ngramlm.op7_lm(spark, SF)
    assert shown(got) == sorted(map(repr, brute_lm(some, order)))
    held = [r for r in got.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert shown(ngramlm.lm_scores(odd, order)) == sorted(map(repr, brute_lm([(r.doc_id, r.text) for r in odd.collect()], order)))
    assert ngramlm.lm_scores(none, order).count() == 0


def test_lm_holds_no_files_open(spark):
    """More files of a model than a process may have open."""
    docs = [(i, " ".join(f"w{i * j % 97}" for j in range(40))) for i in range(60)]
    before, soft = spark.conf.get("spark.sql.shuffle.partitions"), resource.getrlimit(resource.RLIMIT_NOFILE)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        model = ngramlm.train(spark.createDataFrame(docs, "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    grams, _ = ngramlm.tokens([t.encode() for _, t in docs], ngramlm.WordHash(), 3)
    want = model.score(grams)
    model = pickle.loads(pickle.dumps(model))
    resource.setrlimit(resource.RLIMIT_NOFILE, (max(map(int, os.listdir("/proc/self/fd"))) + 60, soft[1]))
    try:
        for got in (model.score(grams), model.score(grams)):
            assert all((x == y).all() for x, y in zip(got, want, strict=True))
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, soft)


def test_lm_lets_maps_go(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} c{i % 3} d") for i in range(50)], "doc_id long, text string")
    model, grams = ngramlm.train(docs), ngramlm.tokens([f"a{i} b{i} c{i} d".encode() for i in range(8)], ngramlm.WordHash(), 3)[0]
    want = model.score(grams)
    monkeypatch.setattr(ngramlm, "OPEN", 2)
    model = pickle.loads(pickle.dumps(model))
    assert all((x == y).all() for x, y in zip(model.score(grams), want, strict=True)) and len(model._open) <= 2


def test_lm_in_a_store(spark, monkeypatch, tmp_path):
    """A shared folder that only Spark reaches gives the same scores; one without a scheme is a local one."""
    docs = spark.createDataFrame([(i, f"a b {'c' * (i % 3)} d {i % 5}") for i in range(40)], "doc_id long, text string")
    want = sorted(map(repr, ngramlm.lm_scores(docs).collect()))
    named = types.SimpleNamespace(conf={"spark.checkpoint.dir": f"{tmp_path}/no scheme/"}, sparkContext=spark.sparkContext)
    assert common.shared_dir(named) == f"file:{tmp_path}/no scheme"
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lm.link./shared", f"file://{tmp_path}")
    monkeypatch.setattr(ngramlm, "new_path", lambda _, kind: f"viewfs://lm/shared/{kind}-{uuid.uuid4().hex}")
    assert sorted(map(repr, ngramlm.lm_scores(docs).collect())) == want


def test_lm_disk(spark, monkeypatch, tmp_path):
    """All that a training writes to the shared folder, were none of it deleted."""
    monkeypatch.setattr(ngramlm, "drop_path", lambda *_: None)
    monkeypatch.setattr(ngramlm, "new_path", lambda _, kind: f"file://{tmp_path}/{kind}-{uuid.uuid4().hex}")
    ngramlm.train(spark.read.parquet(f"{SF}/documents.parquet"))
    wrote = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
    assert wrote < 4 * os.path.getsize(f"{SF}/documents.parquet")


def test_lm_wide_contexts(spark, rows, odd):
    """Contexts whose words' numbers need more than 64 bits together, and n-grams that do."""
    some = rows[:40] + [(r.doc_id, r.text) for r in odd.collect()]
    got = ngramlm.lm_scores(spark.createDataFrame(some, "doc_id long, text string"), 8).collect()
    assert sorted(repr((*tuple(r)[:5], round(r.base_score, 5), round(r.score, 5))) for r in got) == sorted(map(repr, brute_lm(some, 8)))


@pytest.mark.parametrize("width", [0, 1, 2, 7, 31, 32, 33, 57, 63, 64])
def test_lm_bits(width):
    rng = np.random.default_rng(width)
    x = rng.integers(0, 2**width - 1, 1000, np.uint64, endpoint=True)
    there = ngramlm.Bits(ngramlm.Bits.of(x, width), width)
    assert (there[np.arange(1000)] == x).all() and (there[np.array([999, 0, 5])] == x[[999, 0, 5]]).all()
    up = np.sort(x)
    asked = rng.integers(0, 2**width - 1, 200, np.uint64, endpoint=True)
    there = ngramlm.Bits(ngramlm.Bits.of(up, width), width)
    assert (there.first(np.zeros(200, np.int64), np.full(200, 1000), asked) == np.searchsorted(up, asked)).all()


def test_lm_rows_travel_unharmed():
    """Rising rows, and adding up, with numbers that fit in 64 bits together and that do not."""
    rng = np.random.default_rng(3)
    for bits in (3, 22, 40):
        rows = [rng.integers(0, 2 ** min(bits, 4), 500, np.uint64) << np.uint64(max(0, bits - 4)) for _ in range(3)]
        weight = rng.integers(1, 400, 500)
        want = collections.Counter()
        for *x, n in zip(*(c.tolist() for c in rows), weight.tolist()):
            want[tuple(x)] += n
        grams, n = ngramlm.add_up(rows, bits, weight)
        again, m = ngramlm._received([(0, ngramlm._rises(grams), ngramlm.packed(n))])
        assert dict(zip(zip(*(c.tolist() for c in again)), m.tolist())) == want
        assert [tuple(c.tolist()) for c in grams] == [tuple(c) for c in zip(*sorted(want))]
        times = collections.Counter(zip(*(c.tolist() for c in rows)))
        grams, n = ngramlm.add_up(rows, bits)
        assert dict(zip(zip(*(c.tolist() for c in grams)), n.tolist())) == times


def test_lm_probabilities_sum_up(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "a b b", "c a b a", "b a", "a d"] * 3)], "doc_id long, text string")
    cache = ngramlm.WordHash()
    ids = np.array([*(cache[w.encode()] for w in "abcd"), 12345], np.uint64)
    every = np.r_[ids, ngramlm.END]
    for order in (2, 3):
        model = ngramlm.train(docs, order=order)
        for h in itertools.product((ids[0], ids[3], ids[4], ngramlm.BEGIN), repeat=order - 1):
            p, _, _ = model.score([*(np.full(len(every), x) for x in h), every])
            assert (10**p).sum() == pytest.approx(1.0)
    with pytest.raises(ValueError):
        ngramlm.train(docs, order=1)


def test_lm_tokens_are_hashed_once(monkeypatch):
    """Texts are cut at ASCII blanks only, whatever their bytes; each distinct word is hashed once."""
    asked, digest = [], ngramlm.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(ngramlm.xxhash, "xxh3_64_intdigest", lambda x: asked.append(x) or digest(x))
    for texts in ([], [b""], [b"", b" \t", b""], [b"A b\x0bC\x0cd\r e\x1cf\x85g\xc2\xa0h", b"", b"x"], [b" lead", b"trail ", b"\x00 z"], ["É é".encode(), b"", b"w w W" * 3]):
        asked.clear()
        (word,), starts = ngramlm.tokens(texts, None, 1)
        want, at = [], []
        for t in texts:
            at.append(len(want))
            want += [*map(digest, t.lower().split()), int(ngramlm.END)]
        assert word.tolist() == want and starts.tolist() == at and word.dtype == np.uint64
        words = [x for x in asked if x.strip(b" \t\n\x0b\x0c\r")]
        assert len(words) == len(set(words))
