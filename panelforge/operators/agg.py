"""Standalone utilities over panels: labelled aggregation and row-wise correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.plans.lower import divide

KINDS = ("sum", "min", "max", "first", "last", "count", "mean")


def aggregate(panel: DataFrame, label: Column | str, outputs: dict[str, tuple[str, str]], sym: str = "sym", t: str = "t", runs: bool = False) -> DataFrame:
    """For each instrument and label, name -> (column, kind) with a kind of KINDS.

    A missing value makes sum, min, max and mean missing; count counts rows; first and last
    are the first and last row's value, missing or not. Labels that do not decrease over
    time need nothing more; with ``runs`` each run of equal labels is its own group (column
    ``run``, from 1)."""
    if bad := [k for _, k in outputs.values() if k not in KINDS]:
        raise ValueError(f"unknown kinds {bad}; known are {KINDS}")
    lab = F.col(label) if isinstance(label, str) else label
    df = panel.withColumn("label", lab)
    keys = [sym, "label"]
    if runs:
        rows = Window.partitionBy(sym).orderBy(t)
        fresh = F.when(F.row_number().over(rows) == 1, 1).when(F.col("label").eqNullSafe(F.lag("label").over(rows)), 0).otherwise(1)
        df = df.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(rows))
        keys.append("run")

    def one(col: str, kind: str) -> Column:
        x = F.col(col)
        whole = F.count(x) == F.count(F.lit(1))
        return {
            "sum": F.when(whole, F.sum(x)), "mean": F.when(whole, F.avg(x)), "min": F.when(whole, F.min(x)), "max": F.when(whole, F.max(x)),
            "first": F.min_by(x, F.col(t)), "last": F.max_by(x, F.col(t)), "count": F.count(F.lit(1)),
        }[kind]

    return df.groupBy(*keys).agg(*[one(*v).alias(k) for k, v in outputs.items()])


def corr_with(panel: DataFrame, factors: list[str], target: str, t: str = "t", rank_inputs: bool = False) -> DataFrame:
    """For each time, Pearson's correlation over instruments of each factor with ``target``;
    with ``rank_inputs`` the factors (not the target) are ranked first. Any missing value of
    the pair makes that time's result missing, as does a constant side."""
    df = panel.select(t, target, *[c for c in factors if c != target])
    if rank_inputs:
        at = Window.partitionBy(t)

        def rank(c: str) -> Column:
            o = at.orderBy(F.col(c).asc_nulls_last())
            return F.when(F.col(c).isNotNull(), F.rank().over(o) + (F.count(c).over(o.rangeBetween(0, 0)) - 1) / F.lit(2.0))

        df = df.select(t, target, *[rank(c).alias(f"_r_{c}") for c in factors])

    def corr(c: str) -> Column:
        x, y = F.col(f"_r_{c}" if rank_inputs else c), F.col(target)
        whole = (F.count(x) == F.count(F.lit(1))) & (F.count(y) == F.count(F.lit(1)))
        vx, vy = F.var_samp(x), F.var_samp(y)
        return F.when(whole & (vx > 0) & (vy > 0), divide(F.covar_samp(x, y), F.sqrt(vx) * F.sqrt(vy)))

    return df.groupBy(t).agg(*[corr(c).alias(c) for c in factors])
