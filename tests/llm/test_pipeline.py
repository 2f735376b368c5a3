"""Every stage against brute force on what the stage before it kept."""

import collections
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from panelforge.llm import quality  # noqa: E402
from panelforge.llm.common import stored  # noqa: E402
from tests.llm.test_jaccard import brute  # noqa: E402
from tests.llm.test_plain import brute_contained, brute_targets  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF), "test"))
        assert kept[-1].columns[: len(columns)] == columns
        assert name == corpus_pipeline.STAGES[-1][0] or kept[-1].columns == columns
    rows = [[(r.doc_id, r.text, r.source) for r in k.collect()] for k in kept]
    ids = [sorted(r[0] for r in k) for k in rows]

    score = {r.doc_id: r.predicted for r in quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert ids[1] == sorted(d for d, p in score.items() if p) and 0.6 < len(ids[1]) / len(ids[0]) < 0.98
    assert ids[2] == sorted(d for d, _, c in brute([(d, t) for d, t, _ in rows[1]]) if d == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for _, d, _, _ in brute_contained([(d, t) for d, t, _ in rows[2]], items)}
    assert leaks and ids[3] == sorted(set(ids[2]) - leaks)
    sizes, taken = collections.Counter(), collections.Counter()
    for out, k in ((sizes, 3), (taken, 4)):
        for _, t, s in rows[k]:
            out[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert max(collections.Counter(ids[4]).values()) <= 3
    for s, want in brute_targets(sizes).items():
        assert taken[s] == pytest.approx(want, rel=0.02)
    assert ids[5] == ids[4] and {r.shard for r in kept[5].collect()} <= set(range(24))


def test_odd_and_empty(spark, odd, none, tmp_path):
    for name, table in (("odd", odd), ("none", none)):
        sf = f"{tmp_path}/{name}"
        table.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(1 if name == "odd" else 0).write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert out.columns == [*table.columns, "shard_2" if name == "odd" else "shard"] and (out.count() > 0) == (name == "odd")
