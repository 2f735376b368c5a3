"""Operators against pandas, plans, libraries and streaming."""

import numpy as np
import pandas as pd
import pytest

from panelforge import Const, Input, Output, compile_factors
from panelforge import operators as op
from panelforge.functions.text import parse
from panelforge.library.alpha101 import FORMULAS, alpha101
from panelforge.library.alpha158 import alpha158
from panelforge.operators.agg import aggregate, corr_with
from panelforge.streaming.ticks import run_stream

X, Y = Input("x"), Input("y")
T, S = 60, 6


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(7)
    x, y = (pd.DataFrame(rng.uniform(0, 1, (T, S))) for _ in range(2))
    x.iloc[5] = np.nan
    x.iloc[20:24] = 0.25  # ties, constant windows
    x.iloc[30, 2] = np.inf
    x[4] = np.nan
    return x, y


@pytest.fixture(scope="module")
def panel(spark, wide):
    rows = [(s, t, None if np.isnan(wide[0].iat[t, s]) else float(wide[0].iat[t, s]), float(wide[1].iat[t, s])) for t in range(T) for s in range(S)]
    return spark.createDataFrame(rows, "sym long, t long, x double, y double").cache()


def table(df, name="v"):
    return df.toPandas().pivot(index="t", columns="sym", values=name).astype(float)


def same(got, want, **kw):
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(dtype=float), rtol=1e-9, atol=1e-12, **kw)


def test_recurrences(panel, wide):
    x = wide[0].replace(np.inf, np.nan)
    clean = op.Select(op.Abs(X) < 10, X, Const("nan"))
    out = compile_factors({"v": op.ExpMovingAvg(clean, 5), "n": op.ExpMovingAvg(op.ExpMovingAvg(op.BackRef(Y, 1), 5), 5)}).run(panel)
    same(table(out), x.ewm(span=5, adjust=False, ignore_na=True).mean())
    same(table(out, "n"), wide[1].shift(1).ewm(span=5, adjust=False, ignore_na=True).mean().ewm(span=5, adjust=False, ignore_na=True).mean())
    acc = compile_factors({"v": op.Accumulate(lambda a, y: (y > 0.5, a + y), Y)}).run(panel)
    same(table(acc), wide[1].where(wide[1] > 0.5, 0).cumsum())


def test_drawdown_and_reduce(panel, wide):
    out = compile_factors({"v": op.WindowedMaxDrawdown(Y, 5), "r": op.WindowedReduce(Y, 4, lambda a, v: a * 0.5 + v, 0.0)}).run(panel)

    def drop(a):
        k = a.argmax()
        return (a[k] - a[k:].min()) / a[k]

    same(table(out), wide[1].rolling(5).apply(drop, raw=True))
    same(table(out, "r"), wide[1].rolling(4).apply(lambda a: a[3] + a[2] / 2 + a[1] / 4 + a[0] / 8, raw=True))


def test_strict_windows(panel, wide):
    out = compile_factors({"v": op.WindowedAvg(X, 5), "k": op.TsRank(X, 4), "m": op.TsArgMax(X, 4), "c": op.WindowedCorrelation(X, 5, Y)}).run(panel)
    x = wide[0]
    got, want = table(out), x.replace(np.inf, np.nan).rolling(5).mean()
    finite = ~np.isinf(got)
    same(got.where(finite & want.notna()), want.where(finite & want.notna()))
    rank = x.rolling(4).apply(lambda a: (a < a[-1]).sum() + ((a == a[-1]).sum() + 1) / 2, raw=True)
    rank[x.rolling(4).count() < 4] = np.nan
    known = x.replace(np.inf, np.nan).rolling(4).count() == 4
    same(table(out, "k").where(known), rank.where(known))
    same(table(out, "m").where(known), x.rolling(4).apply(lambda a: a.argmax() + 1, raw=True).where(known))
    c = table(out, "c")
    assert c.loc[24:, 4].isna().all() and c.iloc[23].isna().sum() < S


def test_rank_and_max_rules(panel, wide):
    out = compile_factors({"v": op.Rank(X), "m": op.Max(X, 0.5), "w": op.Max(0.5, X), "n": op.bool_to_10(~(X < 1)), "z": op.SetInfOrNanToValue(X, 3)}).run(panel)
    same(table(out), wide[0].rank(pct=True, axis=1))
    assert (table(out, "m")[4] == 0.5).all() and table(out, "w")[4].isna().all() and (table(out, "n")[4] == 1).all() and (table(out, "z")[4] == 3).all()


def test_plan_shape(panel):
    r = op.Rank(op.WindowedSum(X, 5))
    plan = compile_factors({"a": op.WindowedSum(r, 3), "b": op.Rank(Y), "c": op.WindowedSum(X, 5) * 2})
    assert [w for w, _ in plan.phases()] == ["instrument", "time", "instrument"]
    assert plan.lookback == {"a": 6, "b": 0, "c": 4} and plan.inputs == ["x", "y"]
    text = plan.run(panel)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 3 and text.count("MapInArrow") == 3
    assert op.WindowedSum(X, 5) is op.WindowedSum(X, 5) and op.Max(X, Y) is not op.Max(Y, X) and op.Add(X, Y) is op.Add(Y, X)


def test_refusals():
    with pytest.raises(ValueError):
        compile_factors([Output(X, "a"), Output(Y, "a")])
    with pytest.raises(TypeError):
        op.Select(X, X, X)
    with pytest.raises(ValueError):
        op.WindowedKurt(X, 3)
    with pytest.raises(NameError):
        parse("__import__('os')", {"x": X})
    with pytest.raises(ValueError):
        Const(float("nan"))


def test_libraries(panel):
    assert len(FORMULAS) == 82 and len(alpha101()) == 82 and len(alpha158()) == 158
    assert list(alpha158({"price": {"windows": [0, 1]}})) == ["OPEN0", "OPEN1", "HIGH0", "HIGH1", "LOW0", "LOW1"]
    assert list(alpha158({"price": {"windows": [2], "feature": [("mid", X)]}})) == ["MID2"] and len(alpha158({"price": {}})) == 15
    assert list(alpha158({"rolling": {"windows": [5], "include": ["LOW", "MA"]}})) == ["MA5", "MIN5"]


def test_engines_agree(spark, panel, monkeypatch):
    """Window expressions and Arrow passes, with batches far smaller than a window's history."""
    every = {
        "rank": op.Rank(X), "ts_rank": op.TsRank(X, 7), "argmax": op.TsArgMax(X, 7), "argmin": op.TsArgMin(Y, 7), "corr": op.WindowedCorrelation(X, 7, Y), "cov": op.WindowedCovariance(Y, 7, X),
        "var": op.WindowedVar(X, 7), "std": op.WindowedStddev(Y, 7), "skew": op.WindowedSkew(Y, 7), "kurt": op.WindowedKurt(Y, 7), "slope": op.WindowedLinearRegressionSlope(X, 7),
        "r2": op.WindowedLinearRegressionRSqaure(X, 7), "resi": op.WindowedLinearRegressionResi(X, 7), "q": op.WindowedQuantile(Y, 7, 0.3), "decay": op.DecayLinear(Y, 7), "lag": op.BackRef(X, 3),
        "sum": op.WindowedSum(op.Rank(Y), 7), "product": op.WindowedProduct(Y, 3), "min": op.WindowedMin(X, 7), "max": op.WindowedMax(X, 7), "draw": op.WindowedMaxDrawdown(Y, 7), "scale": op.Scale(Y),
        "diff": op.DiffWithWeightedSum(Y, X), "ema": op.ExpMovingAvg(op.Rank(X), 5), "acc": op.Accumulate(lambda a, y: (y > 0.5, a + y), Y), "flag": op.Rank(Y) > 0.5,
    }
    plan = compile_factors(every, digits=9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        arrow = plan.run(panel, engine="arrow").toPandas().sort_values(["sym", "t"]).reset_index(drop=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    columns = plan.run(panel, engine="columns").toPandas().sort_values(["sym", "t"]).reset_index(drop=True)
    for k in every:
        finite = ~np.isinf(columns[k].astype(float)) & ~np.isinf(arrow[k].astype(float))
        np.testing.assert_allclose(arrow[k].astype(float)[finite], columns[k].astype(float)[finite], rtol=1e-8, atol=1e-11, err_msg=k)
        assert finite.mean() > 0.9


def test_own_operators_signed_zero_and_tables(spark, panel, wide):
    from pyspark.sql import functions as F

    from panelforge.sources.panels import align, write_into

    fold = op.WindowedReduce(Y, 3, lambda acc, i, y, z: acc + i * y * z, 0.0, others=(Y + 1,), indexed=True)
    out = compile_factors({"v": fold, "u": op.Elementwise(F.cbrt, Y), "d": op.Div(1.0, Const(-0.0)), "e": op.Div(1.0, Const(0.0))}).run(panel)
    y = wide[1]
    same(table(out), (y.shift(1) * (y.shift(1) + 1) + 2 * y * (y + 1)).where(y.shift(2).notna()))
    same(table(out, "u"), np.cbrt(y))
    assert (table(out, "d") == -np.inf).all(axis=None) and (table(out, "e") == np.inf).all(axis=None)
    with pytest.raises(ValueError):
        compile_factors({"v": fold}).run(panel, engine="arrow")
    both = align({"": (panel, "sym", "t"), "o_": (panel.where("t < 5").withColumnRenamed("sym", "who"), "who", "t")})
    assert both.columns == ["sym", "t", "x", "y", "o_x", "o_y"] and both.count() == S * T and both.where("o_y = y").count() == 5 * S
    with pytest.raises(ValueError):
        align({"": (both, "sym", "t"), "o_": (panel, "sym", "t")})
    spark.sql("DROP TABLE IF EXISTS factor_out")
    spark.sql("CREATE TABLE factor_out (t BIGINT, sym BIGINT, v FLOAT, other DOUBLE) USING parquet")
    write_into(out.select("sym", "t", "v"), "factor_out")
    assert spark.table("factor_out").count() == S * T and spark.table("factor_out").where("v is not null").count() == S * (T - 2)
    spark.sql("DROP TABLE factor_out")


def test_aggregate_and_ic(panel, wide):
    from pyspark.sql import functions as F

    out = aggregate(panel, F.floor(F.col("t") / 10), {"s": ("x", "sum"), "f": ("x", "first"), "n": ("x", "count")}).toPandas().set_index(["sym", "label"])
    assert np.isnan(out.loc[(0, 0), "s"]) and out.loc[(0, 0), "n"] == 10 and out.loc[(0, 1), "s"] == pytest.approx(wide[0][0][10:20].sum())
    runs = aggregate(panel, F.pmod(F.floor(F.col("t") / 10), F.lit(2)), {"n": ("y", "count")}, runs=True)
    assert {(r.sym, r.run, r.label, r.n) for r in runs.collect()} == {(s, k + 1, k % 2, 10) for s in range(S) for k in range(6)}
    ic = corr_with(panel.select("t", "y", (F.col("y") * 2 + 1).alias("z")), ["z"], "y").toPandas()
    assert np.allclose(ic.z, 1)


def test_stream_equals_batch_and_restarts(spark, panel, tmp_path):
    plan = compile_factors({"v": op.Rank(op.WindowedAvg(Y, 5)), "e": op.ExpMovingAvg(Y, 5)})
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"

    def feed(lo, hi):
        panel.where(f"t >= {lo} and t < {hi}").coalesce(1).write.mode("append").parquet(src)

    def go():
        ticks = spark.readStream.schema(panel.schema).option("maxFilesPerTrigger", 1).parquet(src)
        emit = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}")
        run_stream(ticks, plan, f"{tmp_path}/state", f"{tmp_path}/check", emit).start().awaitTermination()

    feed(0, 20)
    go()
    feed(20, 30)
    go()
    got = spark.read.parquet(*[str(p) for p in (tmp_path / "out").iterdir()]).drop("_")
    want = plan.run(panel.where("t < 30"))
    for c in ("v", "e"):
        same(table(got, c), table(want, c))


def test_stream_state_is_bounded_and_moves(spark, panel, tmp_path):
    """Saved, loaded by another stream, and no more times kept than are looked back on."""
    from panelforge.streaming.ticks import TickRunner

    plan = compile_factors({"v": op.Rank(op.WindowedAvg(Y, 5))})
    got = []

    def steps(runner, lo, hi, by, first=0):
        for n, a in enumerate(range(lo, hi, by), first):
            runner(panel.where(f"t >= {a} and t < {a + by}"), n)

    emit = lambda df, n: got.append(df.toPandas())
    one = TickRunner(plan, f"{tmp_path}/one", emit)
    steps(one, 0, 30, 3)
    assert len(one._batches(spark)) == 2 and one.history(spark).select("t").distinct().count() == one.keep == 4
    one(panel.where("t < 30"), 10)  # all late
    one.save(spark, f"{tmp_path}/saved")
    two = TickRunner(plan, f"{tmp_path}/two", emit)
    two.load(spark, f"{tmp_path}/saved")
    with pytest.raises(ValueError):
        two.load(spark, f"{tmp_path}/saved")
    steps(two, 30, 60, 10)
    same(pd.concat(got).pivot(index="t", columns="sym", values="v").astype(float), table(plan.run(panel), "v"))


def test_first_of_tied_rows(spark, tmp_path):
    """Rows that the order leaves tied: the first of the table counts, over files by name."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from panelforge.sources.panels import lineitem_panel

    path = tmp_path / "some folder" / "lineitem.parquet"
    path.mkdir(parents=True)
    day = pd.Timestamp("1995-03-04")
    for name, prices in (("b", [1.0, 9.0]), ("a c", [5.0, 3.0, 7.0])):
        rows = [(k, day, p, 1, 1, 2.0) for k in (1, 2) for p in prices[:: 1 if k == 1 else -1]]
        names = ["l_suppkey", "l_shipdate", "l_extendedprice", "l_orderkey", "l_linenumber", "l_quantity"]
        pq.write_table(pa.table(dict(zip(names, zip(*rows, strict=True), strict=True))), path / f"{name}.parquet")
    ends = lambda folder: {r.sym: (r.open, r.close) for r in lineitem_panel(spark, str(folder)).collect()}
    assert ends(tmp_path / "some folder") == {1: (5.0, 5.0), 2: (7.0, 7.0)}
    (tmp_path / "one").mkdir()
    (path / "b.parquet").rename(tmp_path / "one" / "lineitem.parquet")
    assert ends(tmp_path / "one") == {1: (1.0, 1.0), 2: (9.0, 9.0)}


def test_powers_to_the_last_bit(spark):
    """Plans with powers alone, by the C library as everywhere."""
    import math

    x = np.random.default_rng(3).uniform(0, 50, 20_000)
    panel = spark.createDataFrame(pd.DataFrame({"sym": 1, "t": np.arange(len(x)), "x": x}))
    plan = compile_factors({"v": op.Pow(X, 5), "u": op.Pow(X, X / 20), "c": Const(2.0), "b": X > 25})
    got = plan.run(panel).toPandas()
    assert plan.engine() == "arrow" and len(got) == len(x) and (got.c == 2).all()
    x = x[got.t.to_numpy()]
    assert (got.v == [math.pow(a, 5) for a in x]).all() and (got.u == [math.pow(a, a / 20) for a in x]).all() and ((got.b == 1) == (x > 25)).all()


def test_little_travels():
    """Between phases go the inputs and what later phases need, not what was finished early."""
    from panelforge.plans import vector

    jobs = vector.passes(compile_factors(alpha101()))
    assert [j.by_time for j in jobs] == [False, True, False, True, False]
    assert sum(len(j.reads) for j in jobs[1:]) < 250
    deep = op.Rank(op.WindowedSum(op.Rank(X), 3))
    jobs = vector.passes(compile_factors({"d": op.WindowedMax(deep, 2), "a": op.WindowedSum(X * Y, 5), "b": op.Rank(Y) + X, "c": X * Y - 1}))
    assert [j.by_time for j in jobs] == [True, False, True, False] and [len(j.reads) for j in jobs] == [2, 3, 3, 3]
    jobs = vector.passes(compile_factors({"a": op.WindowedSum(op.Rank(X), 3), "b": (X + Y) * 2, "c": (X + Y) / 3}))
    assert [len(j.reads) for j in jobs] == [2, 2]  # the rank and X + Y
