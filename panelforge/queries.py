"""Registered factor queries over the supplier x month panel, each with its SQL.

``a`` = close / high, ``b`` = low / high and ``c`` = open / high lie in (0, 1], which keeps
rounded results of both engines alike. The panel is dense: absent cells are NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge import operators as op
from panelforge.expr import Const, InitialValue, Input, Node
from panelforge.library.alpha101 import alpha101
from panelforge.library.alpha158 import alpha158
from panelforge.operators.agg import aggregate, corr_with
from panelforge.plans.compiler import compile_factors
from panelforge.plans.sqltext import to_sql
from panelforge.sources.panels import align, densify, events_panel, lineitem_panel, nation_panel
from panelforge.streaming.ticks import run_stream

A, B, C = Input("a"), Input("b"), Input("c")

PANEL = """
WITH bars AS (SELECT l_suppkey AS sym, date_trunc('month', l_shipdate)::TIMESTAMP AS t,
  arg_min(l_extendedprice, row(l_shipdate, l_orderkey, l_linenumber)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
  arg_max(l_extendedprice, row(l_shipdate, l_orderkey, l_linenumber)) AS close, sum(l_quantity)::DOUBLE AS volume, sum(l_extendedprice) AS amount
  FROM lineitem GROUP BY 1, 2),
dense AS (SELECT s.sym, d.t, open, high, low, close, volume, amount FROM (SELECT DISTINCT sym FROM bars) s CROSS JOIN (SELECT DISTINCT t FROM bars) d LEFT JOIN bars b ON b.sym = s.sym AND b.t = d.t),
p AS (SELECT *, close / high AS a, low / high AS b, open / high AS c, row_number() OVER (PARTITION BY sym ORDER BY t) AS pos FROM dense)
"""


def panel(spark, sf_dir: str) -> DataFrame:
    p = densify(lineitem_panel(spark, sf_dir))
    return p.select("*", *[(F.col(x) / F.col("high")).alias(n) for n, x in (("a", "close"), ("b", "low"), ("c", "open"))])


def flagship(spark, sf_dir: str) -> DataFrame:
    return compile_factors(alpha101(["alpha001"])).run(panel(spark, sf_dir))


def _factor(node: Node) -> Callable:
    def run(spark, sf_dir: str) -> DataFrame:
        out = compile_factors({"value": node}).run(panel(spark, sf_dir))
        v = F.round("value", 6) + F.lit(0.0)
        return out.select("sym", "t", F.when(F.abs("value") == float("inf"), F.signum("value") * 1e300).otherwise(v).alias("value"))

    return run


def _select(expr: str, more: str = "") -> str:
    return f"{PANEL}{more} SELECT sym, t, CASE WHEN isinf(value) THEN sign(value) * 1e300 ELSE round(value, 6) + 0.0 END AS value FROM (SELECT sym, t, ({expr})::DOUBLE AS value FROM {'q' if more else 'p'})"


def _window(expr: str, w: int, gate: str = "a", more: str = "") -> str:
    over = f"OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    expr = expr.replace("@", over)
    return _select(f"CASE WHEN count({gate}) {over} = {w} THEN {expr} END" if gate else expr, more)


W = 5
LAST5 = "list(a) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
WHOLE5 = f", q AS (SELECT *, CASE WHEN count(a) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 THEN {LAST5} END AS l FROM p)"
SO_FAR = ", q AS (SELECT *, list(a) FILTER (WHERE a IS NOT NULL) OVER (PARTITION BY sym ORDER BY t) AS l FROM p)"
EMA = "list_reduce({l}, lambda acc, v: acc * (1 - 2.0::DOUBLE / 6) + v * (2.0::DOUBLE / 6))"
BOTH = "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END"
RANK = "CASE WHEN a IS NOT NULL THEN (rank() OVER (PARTITION BY t ORDER BY a NULLS LAST) + (count(a) OVER (PARTITION BY t, a) - 1) / 2.0) / count(a) OVER (PARTITION BY t) END"
ZERO = A - A
#: name -> (factor, SQL)
FACTORS: dict[str, tuple[Node, str]] = {
    "ew_add": (op.Add(A, B), _select("a + b")),
    "ew_sub": (op.Sub(A, B), _select("a - b")),
    "ew_mul": (op.Mul(A, B), _select("a * b")),
    "ew_div": (op.Div(A, B), _select("a / b")),
    "ew_div_by_zero": (op.Div(op.Sub(A, 0.5), ZERO), _select("CASE WHEN a > 0.5 THEN 'inf'::DOUBLE WHEN a < 0.5 THEN '-inf'::DOUBLE END")),
    "ew_addconst": (op.AddConst(A, 2), _select("a + 2")),
    "ew_subconst_swap": (op.SubConst(A, 2, swap=True), _select("2 - a")),
    "ew_mulconst": (op.MulConst(A, -1), _select("a * -1")),
    "ew_divconst_swap": (op.DivConst(A, 3, swap=True), _select("3 / a")),
    "ew_greaterthanconst": (op.bool_to_10(op.GreaterThanConst(A, 0.5)), _select("CASE WHEN a > 0.5 THEN 1 ELSE 0 END")),
    "ew_lessthanconst": (op.bool_to_10(op.LessThanConst(A, 0.5)), _select("CASE WHEN a < 0.5 THEN 1 ELSE 0 END")),
    "ew_greaterthan": (op.bool_to_10(op.GreaterThan(A, C)), _select("CASE WHEN a > c THEN 1 ELSE 0 END")),
    "ew_greaterequal": (op.bool_to_10(op.GreaterEqual(A, C)), _select("CASE WHEN a >= c THEN 1 ELSE 0 END")),
    "ew_lessthan": (op.bool_to_10(op.LessThan(A, C)), _select("CASE WHEN a < c THEN 1 ELSE 0 END")),
    "ew_lessequal": (op.bool_to_10(op.LessEqual(A, C)), _select("CASE WHEN a <= c THEN 1 ELSE 0 END")),
    "ew_equals": (op.bool_to_10(op.Equals(A, 1.0)), _select("CASE WHEN a = 1 THEN 1 ELSE 0 END")),
    "ew_and": (op.bool_to_10(op.And(A > 0.5, C > 0.5)), _select("CASE WHEN a > 0.5 AND c > 0.5 THEN 1 ELSE 0 END")),
    "ew_or": (op.bool_to_10(op.Or(A > 0.5, C > 0.5)), _select("CASE WHEN a > 0.5 OR c > 0.5 THEN 1 ELSE 0 END")),
    "ew_not": (op.bool_to_10(op.Not(A > 0.5)), _select("CASE WHEN a > 0.5 THEN 0 ELSE 1 END")),
    "ew_max": (op.Max(A, 0.5), _select("CASE WHEN a > 0.5 THEN a ELSE 0.5 END")),
    "ew_min": (op.Min(A, C), _select("CASE WHEN a < c THEN a ELSE c END")),
    "ew_abs": (op.Abs(A - 0.5), _select("abs(a - 0.5)")),
    "ew_sqrt": (op.Sqrt(A - 0.5), _select("CASE WHEN a >= 0.5 THEN sqrt(a - 0.5) END")),
    "ew_log": (op.Log(A), _select("ln(a)")),
    "ew_log_edges": (op.Log(A - 0.5) + op.Log(op.Max(A, 1) - 1), _select("CASE WHEN a > 0.5 THEN '-inf'::DOUBLE END")),
    "ew_exp": (op.Exp(A), _select("exp(a)")),
    "ew_sign": (op.Sign(A - 0.5), _select("sign(a - 0.5)")),
    "ew_setinfornan": (op.SetInfOrNanToValue(op.Div(A, ZERO), 7), _select("7")),
    "ew_setinfornan_finite": (op.SetInfOrNanToValue(op.Div(A, op.Select(A > 0.5, B, ZERO)), -2), _select("CASE WHEN a > 0.5 THEN a / b ELSE -2 END")),
    "ew_div_signed_zero": (op.Div(A, (A - A) * -1), _select("CASE WHEN a > 0 THEN '-inf'::DOUBLE END")),
    "ew_user": (op.Elementwise(lambda x, y: F.hypot(x, y), A, B), _select("sqrt(a * a + b * b)")),
    "ew_select": (op.Select(A > 0.5, B, C), _select("CASE WHEN a > 0.5 THEN b ELSE c END")),
    "ew_clip": (op.Clip(A - 0.5, 0.2), _select("CASE WHEN a IS NULL THEN 0.2 ELSE greatest(least(a - 0.5, 0.2), -0.2) END")),
    "ew_pow": (op.Pow(A, C), _select("pow(a, c)")),
    "ew_pow_const": (op.Pow(A, 2.5) + op.Pow(A, 3) + op.Pow(A, -2), _select("pow(a, 2.5) + pow(a, 3) + pow(a, -2)")),
    "ew_pow_edges": (op.Pow(A - 0.5, C) + op.Pow(A - A, C) + op.SetInfOrNanToValue(op.Pow(A - A, 0 - C), 9), _select("CASE WHEN a >= 0.5 THEN pow(a - 0.5, c) + 9 END")),
    "ew_constant": (op.ReturnFirstValue(A * 0 + Const(4), B), _select("CASE WHEN a IS NOT NULL THEN 4 END")),
    "ts_backref": (op.BackRef(A, 3), _select("lag(a, 3) OVER (PARTITION BY sym ORDER BY t)")),
    "ts_delta": (op.delta(A, 2), _select("a - lag(a, 2) OVER (PARTITION BY sym ORDER BY t)")),
    "ts_returns": (op.returns(A), _select("a / lag(a) OVER (PARTITION BY sym ORDER BY t) - 1")),
    "ts_sum": (op.WindowedSum(A, W), _window("sum(a) @", W)),
    "ts_product": (op.WindowedProduct(A, W), _window("product(a) @", W)),
    "ts_min": (op.WindowedMin(A, W), _window("min(a) @", W)),
    "ts_max": (op.WindowedMax(A, W), _window("max(a) @", W)),
    "ts_avg": (op.WindowedAvg(A, W), _window("avg(a) @", W)),
    "ts_var": (op.WindowedVar(A, W), _window("var_samp(a) @", W)),
    "ts_stddev": (op.WindowedStddev(A, W), _window("stddev_samp(a) @", W)),
    "ts_covariance": (op.WindowedCovariance(A, W, B), _window("covar_samp(a, b) @", W, BOTH)),
    "ts_correlation": (op.WindowedCorrelation(A, W, B), _window("covar_samp(a, b) @ / sqrt(var_samp(a) @ * var_samp(b) @)", W, BOTH)),
    "ts_skew": (op.WindowedSkew(A, W), _window("skewness(a) @", W)),
    "ts_kurt": (op.WindowedKurt(A, W), _window("kurtosis(a) @", W)),
    "ts_argmax": (op.TsArgMax(A, W), _window(f"arg_max(pos, row(a, -pos)) @ - (pos - {W})", W)),
    "ts_argmin": (op.TsArgMin(A, W), _window(f"arg_min(pos, row(a, pos)) @ - (pos - {W})", W)),
    "ts_rank": (op.TsRank(A, W), _select("CASE WHEN len(l) = 5 AND list_count(l) = 5 THEN len(list_filter(l, lambda x: x < a)) + (len(list_filter(l, lambda x: x = a)) + 1) / 2.0 END", f", q AS (SELECT *, list(a) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS l FROM p)")),
    "ts_decaylinear": (op.DecayLinear(A, W), _window(f"(sum(a * pos) @ - (pos - {W}) * sum(a) @) / {W * (W + 1) / 2}", W)),
    "ts_slope": (op.WindowedLinearRegressionSlope(A, W), _window("regr_slope(a, pos) @", W, "")),
    "ts_rsquare": (op.WindowedLinearRegressionRSqaure(A, W), _window("CASE WHEN var_samp(a) @ > 0 THEN regr_r2(a, pos) @ END", W, "")),
    "ts_resi": (op.WindowedLinearRegressionResi(A, W), _window("a - (regr_slope(a, pos) @ * pos + regr_intercept(a, pos) @)", W, "")),
    "ts_quantile": (op.WindowedQuantile(A, W, 0.3), _window("quantile_cont(a, 0.3) @", W)),
    "xs_rank": (op.Rank(A), _select(RANK)),
    "xs_scale": (op.Scale(A), _select("a / sum(abs(a)) OVER (PARTITION BY t)")),
    "xs_diffwithweightedsum": (op.DiffWithWeightedSum(A, B), _select("CASE WHEN count(a * b) OVER (PARTITION BY t) = count(*) OVER (PARTITION BY t) THEN a - sum(a * b) OVER (PARTITION BY t) END")),
    "xs_user": (op.CrossSectional(lambda w, x: x - F.avg(x).over(w), A), _select("a - avg(a) OVER (PARTITION BY t)")),
    "ts_user_reduce": (op.WindowedReduce(A, W, lambda acc, x: acc * 0.5 + x, 0.0), _select("l[5] + l[4] / 2 + l[3] / 4 + l[2] / 8 + l[1] / 16", WHOLE5)),
    "ts_user_fold": (op.WindowedReduce(A, W, lambda acc, i, x, y: acc + i * x * y, 0.0, others=(A * 2,), indexed=True), _select("2 * (l[2] * l[2] + 2 * l[3] * l[3] + 3 * l[4] * l[4] + 4 * l[5] * l[5])", WHOLE5)),
    "ts_maxdrawdown": (op.WindowedMaxDrawdown(A, W), _select("(list_max(l) - list_min(l[list_position(l, list_max(l)):])) / list_max(l)", WHOLE5)),
    "st_ema": (op.ExpMovingAvg(A, W), _select(EMA.format(l="l"), SO_FAR)),
    "st_accumulate": (op.Accumulate(lambda acc, x: (x > 0.5, acc + x), A), _select("list_reduce(list_prepend(0.0::DOUBLE, coalesce(l, [])), lambda acc, v: CASE WHEN v > 0.5 THEN acc + v ELSE acc END)", SO_FAR)),
}


def _agg(spark, sf_dir: str) -> DataFrame:
    kinds = ("sum", "min", "max", "first", "last", "count", "mean")
    out = aggregate(panel(spark, sf_dir), F.year("t").cast("long"), {k: ("a", k) for k in kinds})
    return out.select("sym", "label", "count", *[F.round(k, 6).alias(k) for k in kinds if k != "count"])


AGG = f"""{PANEL} SELECT sym, year(t)::BIGINT AS label, count(*) AS count, CASE WHEN count(a) = count(*) THEN round(sum(a), 6) END AS sum, CASE WHEN count(a) = count(*) THEN round(min(a), 6) END AS min,
CASE WHEN count(a) = count(*) THEN round(max(a), 6) END AS max, round(arg_min_null(a, t), 6) AS first, round(arg_max_null(a, t), 6) AS last, CASE WHEN count(a) = count(*) THEN round(avg(a), 6) END AS mean FROM p GROUP BY 1, 2"""


def _corr(rank: bool) -> Callable:
    def run(spark, sf_dir: str) -> DataFrame:
        return corr_with(panel(spark, sf_dir), ["a"], "b", rank_inputs=rank).select("t", (F.round("a", 6) + F.lit(0.0)).alias("ic"))

    return run


def _corr_sql(x: str) -> str:
    return f"{PANEL}, q AS (SELECT t, ({x}) AS x, b AS y FROM p) SELECT t, CASE WHEN count(x) = count(*) AND count(y) = count(*) AND var_samp(x) > 0 AND var_samp(y) > 0 THEN round(covar_samp(x, y) / (sqrt(var_samp(x)) * sqrt(var_samp(y))), 6) + 0.0 END AS ic FROM q GROUP BY t"


def _runs(spark, sf_dir: str) -> DataFrame:
    """A label that comes back: each run of it is a group."""
    out = aggregate(panel(spark, sf_dir), F.pmod(F.quarter("t"), F.lit(2)).cast("long"), {"count": ("a", "count"), "high": ("a", "max"), "last": ("a", "last")}, runs=True)
    return out.select("sym", "label", F.col("run").cast("long").alias("run"), "count", F.round("high", 6).alias("high"), F.round("last", 6).alias("last"))


RUNS = f"""{PANEL}, q AS (SELECT *, (quarter(t) % 2)::BIGINT AS label FROM p), f AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY sym ORDER BY t) THEN 0 ELSE 1 END AS fresh FROM q),
g AS (SELECT *, (sum(fresh) OVER (PARTITION BY sym ORDER BY t))::BIGINT AS run FROM f)
SELECT sym, label, run, count(*) AS count, CASE WHEN count(a) = count(*) THEN round(max(a), 6) END AS high, round(arg_max_null(a, t), 6) AS last FROM g GROUP BY 1, 2, 3"""


def _ema_init(spark, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    first = p.groupBy("sym").agg(F.lit(0.5).alias("init_a"))
    out = compile_factors({"value": op.ExpMovingAvg(A, W, init=InitialValue("init_a"))}).run(p, initial=first)
    return out.select("sym", "t", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def _stream(spark, sf_dir: str) -> DataFrame:
    """The panel as a stream of yearly files, a file a batch; what the batches emitted."""
    import uuid

    base = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/ticks-{uuid.uuid4().hex}"
    p = panel(spark, sf_dir).select("sym", "t", "a", F.year("t").alias("year")).cache()
    for (year,) in p.select("year").distinct().orderBy("year").collect():
        p.where(F.col("year") == year).drop("year").coalesce(1).write.mode("append").parquet(f"{base}/in")
    p.unpersist()
    plan = compile_factors({"value": op.Rank(op.WindowedAvg(A, W))}, digits=9)
    ticks = spark.readStream.schema("sym long, t timestamp, a double").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    emit = lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    run_stream(ticks, plan, f"{base}/state", f"{base}/check", emit).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("sym", "t", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def _aligned(spark, sf_dir: str) -> DataFrame:
    """Features of two tables by (sym, t), and the correlation of one with the other's."""
    left, right = panel(spark, sf_dir).select("sym", "t", "a"), panel(spark, sf_dir).where("b < 0.9").select(F.col("sym").alias("supplier"), F.col("t").alias("month"), "b")
    both = align({"": (left, "sym", "t"), "r_": (right, "supplier", "month")})
    out = compile_factors({"value": Input("a") - op.BackRef(Input("r_b"), 1)}).run(both)
    return out.select("sym", "t", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def _slice(spark, sf_dir: str) -> DataFrame:
    out = compile_factors({"value": op.WindowedSum(A, 3)}).run(panel(spark, sf_dir), start=10, length=20)
    return out.select("sym", "t", F.round("value", 6).alias("value"))


SLICE = f"""{PANEL}, q AS (SELECT * FROM p WHERE pos > 10 AND pos <= 30) SELECT sym, t, CASE WHEN count(a) OVER w = 3 THEN round(sum(a) OVER w, 6) END AS value FROM q WINDOW w AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""


def _alphas(names) -> Callable:
    return lambda spark, sf_dir: compile_factors(alpha101(list(names))).run(panel(spark, sf_dir))


def _events(spark, sf_dir: str) -> DataFrame:
    out = compile_factors({"value": op.WindowedMax(Input("high"), 3)}).run(densify(events_panel(spark, sf_dir)))
    return out.select("sym", "t", F.round("value", 6).alias("value"))


EVENTS = """WITH b AS (SELECT user_id AS sym, date_trunc('day', ts)::TIMESTAMP AS t, max(value) AS high FROM events GROUP BY 1, 2),
d AS (SELECT s.sym, x.t, high FROM (SELECT DISTINCT sym FROM b) s CROSS JOIN (SELECT DISTINCT t FROM b) x LEFT JOIN b ON b.sym = s.sym AND b.t = x.t)
SELECT sym, t, CASE WHEN count(high) OVER w = 3 THEN round(max(high) OVER w, 6) END AS value FROM d WINDOW w AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""

ALPHA001 = f"""{PANEL}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY sym ORDER BY t) - 1 AS ret FROM p),
s AS (SELECT *, CASE WHEN coalesce(ret < 0, false) THEN CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END ELSE close END AS x FROM r WINDOW w AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
m AS (SELECT *, CASE WHEN count(x) OVER w = 5 THEN arg_max(pos, row(x * x, -pos)) OVER w - (pos - 5) END AS g FROM s WINDOW w AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT sym, t, CASE WHEN g IS NOT NULL THEN (rank() OVER (PARTITION BY t ORDER BY g NULLS LAST) + (count(g) OVER (PARTITION BY t, g) - 1) / 2.0) / count(g) OVER (PARTITION BY t) END AS alpha001 FROM m"""

# -- the factor libraries, on a panel with a long history ------------------------------------

WEEKS = """
WITH bars AS (SELECT s_nationkey::BIGINT AS sym, date_trunc('week', l_shipdate)::TIMESTAMP AS t, arg_min(price, row(l_shipdate, l_orderkey, l_linenumber)) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, row(l_shipdate, l_orderkey, l_linenumber)) AS close, sum(l_quantity)::DOUBLE / 1000 AS volume, sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE / 1e6 AS amount
  FROM (SELECT *, l_extendedprice / l_quantity / 1000 AS price FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY 1, 2),
p AS (SELECT s.sym, d.t, open, high, low, close, volume, amount, row_number() OVER (PARTITION BY s.sym ORDER BY d.t) AS pos
  FROM (SELECT DISTINCT sym FROM bars) s CROSS JOIN (SELECT DISTINCT t FROM bars) d LEFT JOIN bars b ON b.sym = s.sym AND b.t = d.t)"""


def weeks(spark, sf_dir: str) -> DataFrame:
    return densify(nation_panel(spark, sf_dir)).withColumn("sym", F.col("sym").cast("long"))


def _library(factors: dict[str, Node]) -> tuple[Callable, str]:
    """A query and its SQL, from the factors' definitions (sqltext.py). Ranks and comparisons
    take numbers at nine decimals in both: beyond, they hang on the order of additions."""
    plan = compile_factors(factors, digits=9)

    def run(spark, sf_dir: str) -> DataFrame:
        out = plan.run(weeks(spark, sf_dir))
        return out.select("sym", "t", *[F.when(F.abs(c) == float("inf"), F.signum(c) * 1e300).otherwise(F.rint(F.rint(F.col(c) * 1e9) / 1e9 * 1e6) / 1e6 + F.lit(0.0)).alias(c) for c in plan.output_names])

    return run, to_sql(plan, WEEKS, lambda x: f"CASE WHEN isinf({x}) THEN sign({x}) * 1e300 ELSE round_even(round_even({x} * 1e9, 0) / 1e9 * 1e6, 0) / 1e6 + 0.0 END")


def _libraries() -> dict[str, tuple[Callable, str]]:
    found = {k: _library({k: f}) for k, f in alpha101().items() if k != "alpha001"}
    features = alpha158() | alpha158({"price": {}, "volume": {}})
    families: dict[str, dict[str, Node]] = {}
    for k, f in features.items():
        families.setdefault("kbar" if k[0] == "K" else k.rstrip("0123456789").lower(), {})[k] = f
    return found | {f"a158_{k}": _library(v) for k, v in families.items()}


LIBRARIES = _libraries()
QUERIES: dict[str, Callable] = {"alpha001": flagship} | {k: _factor(node) for k, (node, _) in FACTORS.items()}
QUERIES |= {
    "aggregate": _agg, "aggregate_runs": _runs, "stream_rank": _stream, "align": _aligned, "corr_with": _corr(False), "rank_ic": _corr(True), "st_ema_init": _ema_init, "time_slice": _slice, "events_panel": _events,
    "alpha101_all": _alphas(alpha101()), "alpha158": lambda spark, sf_dir: compile_factors(alpha158()).run(panel(spark, sf_dir)),
} | {k: run for k, (run, _) in LIBRARIES.items()}
ORACLES: dict[str, str] = {"alpha001": ALPHA001} | {k: sql for k, (_, sql) in FACTORS.items() if sql}
ORACLES |= {"aggregate": AGG, "corr_with": _corr_sql("a"), "rank_ic": _corr_sql(RANK), "time_slice": SLICE, "events_panel": EVENTS}
ORACLES |= {"aggregate_runs": RUNS, "st_ema_init": _select(EMA.format(l="list_prepend(0.5::DOUBLE, coalesce(l, []))"), SO_FAR)} | {k: sql for k, (_, sql) in LIBRARIES.items()}
ORACLES["stream_rank"] = f"""{PANEL}, q AS (SELECT *, CASE WHEN count(a) OVER w = 5 THEN round_even(avg(a) OVER w * 1e9, 0) END AS m FROM p WINDOW w AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT sym, t, CASE WHEN m IS NOT NULL THEN round((rank() OVER (PARTITION BY t ORDER BY m NULLS LAST) + (count(m) OVER (PARTITION BY t, m) - 1) / 2.0) / count(m) OVER (PARTITION BY t), 6) + 0.0 END AS value FROM q"""
ORACLES["align"] = f"{PANEL}, q AS (SELECT *, CASE WHEN b < 0.9 THEN b END AS rb FROM p) SELECT sym, t, round(a - lag(rb) OVER (PARTITION BY sym ORDER BY t), 6) + 0.0 AS value FROM q"
