"""Factors over a stream of ticks: each micro-batch is joined to the history that the
plan's look-back needs, the batch plan runs over both, and only new times are emitted.

All rows of one time must arrive in one micro-batch (a cross-section is complete then).
Rows whose time is not after the last emitted one are late and left out. After each batch its
folder holds the times that later ones look back on, so a batch reads the folder before it and
nothing else, and older folders go; a batch that is replayed after a restart overwrites its own
folder, so a restart goes on identically. Plans with recurrences depend on every earlier row:
their folders hold one batch each, and all are kept and read.

``TickRunner.save`` writes the state as one Parquet folder, ``TickRunner.load`` starts another
stream from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from panelforge.plans.compiler import FactorPlan


class TickRunner:
    def __init__(self, plan: FactorPlan, state: str, emit: Callable[[DataFrame, int], None], sym: str = "sym", t: str = "t"):
        if any(n.kind == "scan" and n.params[2] for n in plan.order):
            raise ValueError("initial values are for batches only")
        self.plan, self.state, self.emit, self.sym, self.t = plan, state.rstrip("/"), emit, sym, t
        back = plan.lookback.values()
        self.keep = None if None in back else max(1, *back)

    def _system(self, spark: SparkSession, name: str = ""):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.state}/{name}" if name else self.state)
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self, spark: SparkSession) -> list[int]:
        path, system = self._system(spark)
        if not system.exists(path):
            return []
        names = [f.getPath().getName() for f in system.listStatus(path)]
        return sorted(int(n[6:]) for n in names if n.startswith("batch-"))

    def history(self, spark: SparkSession, before: float = float("inf")) -> DataFrame | None:
        done = [b for b in self._batches(spark) if b < before]
        if self.keep is not None:
            done = done[-1:]
        return spark.read.parquet(*[f"{self.state}/batch-{b}" for b in done]) if done else None

    def save(self, spark: SparkSession, path: str) -> None:
        if (held := self.history(spark)) is None:
            raise ValueError("there is no state yet")
        held.write.mode("errorifexists").parquet(path)

    def load(self, spark: SparkSession, path: str) -> None:
        """Begins with a saved state; this runner must not have any."""
        if self._batches(spark):
            raise ValueError("this stream has a state already")
        spark.read.parquet(path).write.parquet(f"{self.state}/batch--1")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, t = batch.sparkSession, self.t
        cols = [self.sym, t, *self.plan.inputs]
        new, old = batch.select(*cols), self.history(spark, number)
        last = None
        if old is not None:
            old = old.select(*cols)
            last = old.agg(F.max(t)).first()[0]
            new = new.where(F.col(t) > F.lit(last)) if last is not None else new
        mine = f"{self.state}/batch-{number}"
        if self.keep is not None:
            aside = f"{self.state}/new-{number}"
            new.write.mode("overwrite").parquet(aside)
            new = spark.read.schema(new.schema).parquet(aside)
            held = new if old is None else old.unionByName(new)
            times = held.select(t).distinct().orderBy(F.col(t).desc()).limit(self.keep)
            held.join(F.broadcast(times), t, "left_semi").select(*cols).write.mode("overwrite").parquet(mine)
        else:
            new.write.mode("overwrite").parquet(mine)
            new = spark.read.schema(new.schema).parquet(mine)
        rows = new if old is None else old.unionByName(new)
        out = self.plan.run(rows, self.sym, t)
        # Times are totally ordered and late rows are gone: the new ones are those after the last.
        self.emit(out if last is None else out.where(F.col(t) > F.lit(last)), number)
        if self.keep is not None:
            self._tidy(spark, number)

    def _tidy(self, spark: SparkSession, number: int) -> None:
        old = [f"batch-{b}" for b in self._batches(spark) if b < number - 1]
        for name in [*old, f"new-{number}"]:
            path, system = self._system(spark, name)
            system.delete(path, True)


def run_stream(ticks: DataFrame, plan: FactorPlan, state: str, checkpoint: str, emit: Callable[[DataFrame, int], None], sym: str = "sym", t: str = "t", **trigger) -> DataStreamWriter:
    """A writer over a streaming DataFrame; ``start()`` it. ``emit(df, batch)`` should
    overwrite what an earlier attempt at the same batch wrote."""
    runner = TickRunner(plan, state, emit, sym, t)
    return ticks.writeStream.foreachBatch(runner).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
