"""Panels: one row for each (sym, t), unique; prices and volumes as doubles.

A window of w rows means w time steps, so a sparse panel must be made dense first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ("open", "high", "low", "close", "volume", "amount")


@dataclass(frozen=True)
class PanelSpec:
    """Which columns of a table are the instrument, the time and the features."""

    sym: str = "sym"
    t: str = "t"
    features: dict[str, str] = field(default_factory=lambda: {f: f for f in FEATURES})

    def load(self, table: DataFrame, check: bool = False) -> DataFrame:
        """NaN becomes NULL. check: one extra aggregation that refuses repeated (sym, t)."""
        out = table.select(F.col(self.sym).alias("sym"), F.col(self.t).alias("t"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(name) for name, c in self.features.items()])
        if check and not out.groupBy("sym", "t").count().where("count > 1").isEmpty():
            raise ValueError("the panel has the same (sym, t) twice")
        return out


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Any format that Spark reads."""
    return spark.read.format(fmt).options(**options).load(path)


def placed(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with _place, which rises in the order of its files' names and their rows."""
    rows = spark.read.parquet(path)
    name, row = F.col("_metadata.file_path").alias("_name"), F.col("_metadata.row_index")
    if len(rows.inputFiles()) < 2:
        return rows.select("*", row.alias("_place"))
    files = sorted(r[0] for r in rows.select(name).distinct().collect())
    numbers = spark.range(1).select(F.posexplode(F.array(*map(F.lit, files))).alias("_number", "_name"))
    out = rows.select("*", name, row.alias("_row")).join(F.broadcast(numbers), "_name")
    return out.withColumn("_place", F.shiftleft(F.col("_number").cast("long"), 40) + F.col("_row")).select(*rows.columns, "_place")


def bars(rows: DataFrame, sym: str, t, value: str, order: list[str], volume=None, amount=None) -> DataFrame:
    """Open, high, low, close, volume and amount of ``value`` for each (sym, bucket t). Of rows
    that ``order`` leaves tied, the first of the table counts, at the open and at the close."""
    first, last = F.struct(*order, "_place"), F.struct(*order, -F.col("_place"))
    size = F.lit(1.0) if volume is None else F.col(volume)
    return rows.groupBy(F.col(sym).alias("sym"), t.alias("t")).agg(
        F.min_by(value, first).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, last).alias("close"),
        F.sum(size).cast("double").alias("volume"), F.sum(value if amount is None else amount).cast("double").alias("amount"),
    )


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers x months of extended prices."""
    rows = placed(spark, f"{sf_dir}/lineitem.parquet")
    return bars(rows, "l_suppkey", F.date_trunc("month", "l_shipdate"), "l_extendedprice", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity")


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations x weeks of unit prices, in thousands, as are quantities: a panel with a
    long history. Amounts are to the cent, so no sum hangs on the order of additions."""
    rows = placed(spark, f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.withColumn("_price", F.col("l_extendedprice") / F.col("l_quantity") / 1000)
    out = bars(rows, "s_nationkey", F.date_trunc("week", "l_shipdate"), "_price", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity", F.col("l_extendedprice").cast("decimal(18,2)"))
    return out.withColumn("volume", F.col("volume") / 1000).withColumn("amount", F.col("amount") / 1e6)


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users x days of event values."""
    return bars(placed(spark, f"{sf_dir}/events.parquet"), "user_id", F.date_trunc("day", "ts"), "value", ["ts", "event_id"])


def densify(panel: DataFrame, sym: str = "sym", t: str = "t") -> DataFrame:
    """Every instrument has a row for every time; what was absent is NULL. The grid is the
    result's own size, and is made from the distinct times held as one array."""
    times = panel.agg(F.sort_array(F.collect_set(t)).alias("_times"))
    grid = panel.select(sym).distinct().join(times, how="cross").select(sym, F.explode("_times").alias(t))
    return grid.join(panel, [sym, t], "left")


def align(tables: dict[str, tuple[DataFrame, str, str]], how: str = "left") -> DataFrame:
    """One panel from feature tables by (sym, t): prefix -> (table, its sym column, its t column).
    Features are named prefix + column; the first table's rows are the panel's, with ``how``
    "full" those of all. One join by the whole key for each further table."""
    out = None
    for prefix, (table, sym, t) in tables.items():
        one = table.select(F.col(sym).alias("sym"), F.col(t).alias("t"), *[F.col(c).alias(f"{prefix}{c}") for c in table.columns if c not in (sym, t)])
        if out is not None and (twice := set(out.columns) & set(one.columns) - {"sym", "t"}):
            raise ValueError(f"two tables have the features {sorted(twice)}: give them other prefixes")
        out = one if out is None else out.join(one, ["sym", "t"], how)
    return out


def write_into(df: DataFrame, table: str) -> None:
    """Results go into a table that exists, by name; its other columns stay NULL."""
    target = df.sparkSession.table(table).schema
    if missing := [c for c in df.columns if c not in target.names]:
        raise ValueError(f"{table} has no column {', '.join(missing)}")
    cols = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields]
    df.select(*cols).write.insertInto(table)
