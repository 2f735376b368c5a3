"""Quality classifier on document statistics.

Statistics of the whole text (shares of kinds of characters, repetition, lengths) are
standardised and mapped by random Fourier features, which approximate a Gaussian kernel;
ridge regression of the labels on these is fitted from normal equations that each partition
sums and Spark adds up, and its values are calibrated by isotonic regression over bins of
all training rows. Neither labels nor language, source or id are inputs of a score.

Nulls: a null or empty text has statistics of 0 and a score like any other. Labels that are
null, or whose document is not there, teach nothing; several labels of one id all count, for
every row with that id. Without labels of both kinds the score is the mean label (1 without
any), so that nothing is rejected for want of evidence. Equal rows get equal scores; empty
tables give empty results; other columns pass through ``reject_low_quality``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import need, raw_texts, stored
from panelforge.llm.ngramlm import remainder

NAMES = ("words", "bytes", "upper", "digit", "space", "newline", "stop", "pipe", "shout", "symbol", "other", "distinct", "again", "word_bytes", "lines", "longest")
#: Random features, width of the kernel, ridge, seed; bins of the calibration.
FEATURES, WIDTH, RIDGE, SEED, BINS = 256, 3.0, 1.0, 6, 2000

_CLASS = np.full(256, 9, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"-()?", b"|", b"!", b"#$%&*+/<=>@[\\]^_`{}~", bytes(range(128, 256)), b"abcdefghijklmnopqrstuvwxyz")):
    _CLASS[list(_chars)] = _k


def statistics(text: bytes) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    size = len(text)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=10) / size
    words = text.split()
    n = len(words)
    lines = text.split(b"\n")
    letters = kinds[0] + kinds[9] + kinds[8]
    again = sum(map(bytes.__eq__, words, words[1:])) / max(n - 1, 1)
    return [
        np.log1p(n), np.log1p(size), kinds[0] / max(letters, 1e-9), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8],
        len(set(words)) / max(n, 1) ** 0.8, again, (size - n) / max(n, 1) ** 1.0, len(set(lines)) / len(lines), np.log1p(max(map(len, words), default=0)),
    ]


def feature_batch(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(NAMES)).clip(-1e6, 1e6)


class Fourier:
    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), FEATURES)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(((x - self.mean) / self.scale).clip(-8, 8) @ self.w + self.b) * np.sqrt(2 / FEATURES)
        return np.c_[z, np.ones(len(x))]


class Classifier:
    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, at: np.ndarray, level: np.ndarray):
        self.fourier, self.weights, self.at, self.level = fourier, weights, at, level

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights if self.fourier else np.zeros(len(x))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.level).clip(0, 1) if len(x) else np.zeros(0)


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Pool adjacent violators."""
    blocks: list[list[float]] = []
    for w, v in zip(weight, value, strict=True):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2])
    return np.repeat([b[1] for b in blocks], [int(b[2]) for b in blocks])


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            x = feature_batch(raw_texts(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c) for c in x.T]], [*keep, *(f"x_{n}" for n in NAMES)])

    return docs.select(*keep, text).mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + [T.StructField(f"x_{n}", T.DoubleType()) for n in NAMES]))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(f"x_{n}").to_numpy(zero_copy_only=False) for n in NAMES], 1)


def fit(rows: DataFrame) -> Classifier:
    """rows: the statistics and ``y``, 0 or 1. What reaches the driver has a fixed size."""
    x = [F.col(f"x_{n}") for n in NAMES]
    s = rows.agg(F.count("y"), F.sum("y"), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    n, good = s[0], s[1] or 0
    if not n or good in (0, n):
        return Classifier(None, None, np.zeros(1), np.full(1, good / n if n else 1.0))
    mean, scale = np.array(s[2 : 2 + len(x)], float), np.array(s[2 + len(x) :], float)
    fourier = Fourier(mean, np.where(scale > 1e-9, scale, 1.0))
    d = FEATURES + 1

    def sums(batches):
        total = np.zeros((d, d + 1))
        for batch in batches:
            z = fourier(_matrix(batch))
            total += z.T @ np.c_[z, batch.column("y").to_numpy(zero_copy_only=False)]
        if total.any():
            yield pa.RecordBatch.from_pydict({"row": pa.array(range(d), pa.int32()), "v": [r.tobytes() for r in total]})

    def added(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out[i] = out.get(i, 0) + np.frombuffer(v)
        for i, v in out.items():
            yield pa.RecordBatch.from_pydict({"row": pa.array([i], pa.int32()), "v": [v.tobytes()]})

    parts = rows.mapInArrow(sums, "row int, v binary").repartition(8, "row").mapInArrow(added, "row int, v binary").collect()
    m = np.zeros((d, d + 1))
    for r in parts:
        m[r.row] = np.frombuffer(r.v)
    ridge = np.eye(d) * RIDGE
    ridge[-1, -1] = 0
    model = Classifier(fourier, np.linalg.solve(m[:, :d] + ridge, m[:, d]), np.zeros(1), np.zeros(1))

    def bins(batches):
        for batch in batches:
            raw = model.raw(_matrix(batch))
            k = ((raw.clip(-0.5, 1.5) + 0.5) / 2 * (BINS - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw), batch.column("y").cast(pa.float64())], ["k", "raw", "y"])

    got = sorted(rows.mapInArrow(bins, "k int, raw double, y double").groupBy("k").agg(F.count("y").alias("n"), F.avg("raw").alias("raw"), F.avg("y").alias("y")).collect())
    weight, at, y = (np.array([r[c] for r in got], float) for c in ("n", "raw", "y"))
    model.at, model.level = at, isotonic(weight, y)
    return model


def learn(stats: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2) -> Classifier:
    """stats: doc_id, statistics. Learns from ids outside the held-out fold."""
    y = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where("y is not null and doc_id is not null")
    return fit(stored(stats.where(remainder(fold) != held).join(y, "doc_id").select("y", *[f"x_{n}" for n in NAMES]), "labelled"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    need(docs, "doc_id", "text")
    stats = stored(with_statistics(docs, ["doc_id"]), "stats")
    model = learn(stats, labels)

    def run(batches):
        for batch in batches:
            s = model(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.7).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = stats.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


def reject_low_quality(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score below ``least``."""
    need(docs, "doc_id", "text")
    # Statistics of all documents, so that no text is shuffled to meet its label.
    model = learn(with_statistics(docs, ["doc_id"]), labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model(feature_batch(raw_texts(batch.column(at)))) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
