"""Planning of a batch of factors.

Work alternates between instrument phases (windows partitioned by instrument) and time
phases (partitioned by time). There are as many as the deepest alternation of the batch has,
not the sum over factors. Every node is in the latest phase that its readers allow, so that
little travels through the exchanges. Columns are dropped after their last reader.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.expr import Node, Output, walk
from panelforge.plans import lower, vector

#: Operators that cost the width of their window for every row as Columns.
WIDE = {"ts_rank", "drawdown", "quantile"}
#: Windowed operators up to which a plan is Columns.
FEW = 3
#: Operators whose last bit the JVM takes otherwise than the C library.
C_LIBRARY = {"pow", "powi"}


@dataclass(frozen=True)
class FactorPlan:
    outputs: dict[str, Node]
    dtype: str = "double"
    order: list[Node] = field(default_factory=list)
    place: dict[int, tuple[int, int]] = field(default_factory=dict)
    #: Decimals at which ranks, comparisons and positions of extremes tell numbers apart.
    digits: int | None = None

    @property
    def output_names(self) -> list[str]:
        return list(self.outputs)

    @property
    def inputs(self) -> list[str]:
        return sorted({n.params[0] for n in self.order if n.op == "input"})

    @property
    def lookback(self) -> dict[str, int | None]:
        """Rows before the first reliable one, an upper bound; None: the whole history."""
        need: dict[int, float] = {}
        for n in self.order:
            own = n.params[0] - (n.op != "lag") if n.kind == "ts" else float("inf") if n.kind == "scan" else 0
            need[id(n)] = own + max((need[id(a)] for a in n.args), default=0)
        return {k: None if need[id(n)] == float("inf") else int(need[id(n)]) for k, n in self.outputs.items()}

    def phases(self) -> list[tuple[str, list[list[Node]]]]:
        """("instrument" | "time", steps); a step holds nodes that need only earlier steps."""
        found: dict[tuple[int, int], list[Node]] = {}
        for n in self.order:
            if n.kind in ("ts", "scan", "xs"):
                found.setdefault(self.place[id(n)], []).append(n)
        out: list[tuple[str, list[list[Node]]]] = []
        for phase in sorted({p for p, _ in found}):
            out.append(("time" if phase % 2 else "instrument", [found[k] for k in sorted(found) if k[0] == phase]))
        return out

    def engine(self, wish: str = "auto") -> str:
        if wish not in ("auto", "columns", "arrow"):
            raise ValueError("engine is 'auto', 'columns' or 'arrow'")
        windowed = [n for n in self.order if n.kind in ("ts", "scan", "xs")]
        own = sorted({n.op for n in self.order} & vector.COLUMNS_ONLY)
        if wish == "arrow" and own:
            raise ValueError(f"{', '.join(own)}: built from Columns, which only engine='columns' runs")
        if wish == "auto":
            heavy = len(windowed) > FEW or any(n.kind == "scan" or n.op in WIDE for n in windowed) or any(n.op in C_LIBRARY for n in self.order)
            return "arrow" if heavy and not own else "columns"
        return wish

    def explain(self) -> str:
        lines = []
        for i, (what, steps) in enumerate(self.phases()):
            lines += [f"phase {i} by {what}"] + [f"  step {k}: {', '.join(map(repr, s))}" for k, s in enumerate(steps)]
        return "\n".join(lines + [f"outputs: {', '.join(self.outputs)}"])

    def run(self, panel: DataFrame, sym: str = "sym", t: str = "t", start=None, length: int | None = None, initial: DataFrame | None = None, warmup: bool = False, engine: str = "auto") -> DataFrame:
        """(sym, t, one column for each output). ``panel`` has unique (sym, t).

        engine: "columns" (window expressions), "arrow" (one pass for each phase, vector.py), or
        "auto": columns for plans of few windowed operators without powers and for those that users
        build from Columns.

        start and length slice whole time steps before anything is computed, so windows do
        not see earlier rows; with ``warmup`` they do and only the result is sliced."""
        steps = None
        if start is not None or length is not None:
            steps = time_slice(panel, t, start or 0, length)
            panel = panel if warmup else panel.join(steps, t, "left_semi")
        out = _Run(self, sym, t).over(panel, initial, self.engine(engine))
        return out.join(steps, t, "left_semi") if warmup and steps is not None else out


def time_slice(panel: DataFrame, t: str, start: int, length: int | None) -> DataFrame:
    """The distinct times from the start-th on. One row for each time step takes part."""
    from pyspark.sql import Window

    times = panel.select(t).distinct().withColumn("_i", F.row_number().over(Window.orderBy(t)) - 1)
    keep = F.col("_i") >= start if length is None else (F.col("_i") >= start) & (F.col("_i") < start + length)
    return times.where(keep).select(t)


def compile_factors(factors: dict[str, Node] | list[Output], dtype: str = "double", digits: int | None = None) -> FactorPlan:
    """digits: decimals at which numbers count as equal where they are ranked or compared. The
    order of additions differs between partitionings and engines; without it, ranks of numbers
    that are equal on paper hang on their last bit."""
    if not isinstance(factors, dict):
        names = [o.name for o in factors]
        if twice := [k for k, v in Counter(names).items() if v > 1]:
            raise ValueError(f"output names are used twice: {twice}")
        factors = {o.name: o.node for o in factors}
    if not factors or not all(factors):
        raise ValueError("a plan needs outputs, each with a name")
    if dtype not in ("double", "float"):
        raise ValueError("dtype is 'double' or 'float'")
    order = walk(list(factors.values()))
    place: dict[int, tuple[int, int]] = {}
    for n in order:
        before = max((place[id(a)] for a in n.args), default=(-1, 0))
        if n.kind in ("ts", "scan", "xs"):
            mine = 1 if n.kind == "xs" else 0
            phase, step = before
            if phase < 0:
                before = (mine, 0)
            elif phase % 2 == mine:
                before = (phase, step + 1)
            else:
                before = (phase + 1, 0)
        place[id(n)] = before
    return FactorPlan(dict(factors), dtype, order, _late(order, place), digits)


def _late(order: list[Node], place: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """The same phases, with every node in the last one that its readers allow: what is finished
    early would travel through all exchanges that are left, and the inputs travel anyhow."""
    last = max((p for p, _ in place.values()), default=-1)
    until = {id(n): last for n in order}
    for n in reversed(order):
        if n.kind in ("ts", "scan", "xs"):
            until[id(n)] -= (until[id(n)] - (n.kind == "xs")) % 2
        for a in n.args:
            until[id(a)] = min(until[id(a)], until[id(n)])
    out: dict[int, tuple[int, int]] = {}
    for n in order:
        before = max((out[id(a)] for a in n.args), default=(-1, 0))
        if n.kind in ("ts", "scan", "xs"):
            phase = until[id(n)]
            before = (phase, before[1] + 1 if before[0] == phase else 0)
        out[id(n)] = before
    return out


class _Run:
    """One lowering: which column holds which node, and who still needs it."""

    def __init__(self, plan: FactorPlan, sym: str, t: str):
        self.plan, self.sym, self.t = plan, sym, t
        self.pos = "_pos"
        self.frames = lower.Frames(sym, t, self.pos)
        self.column: dict[int, str] = {}
        self.name = {id(n): f"_n{i}" for i, n in enumerate(plan.order)}
        self.readers: Counter[int] = Counter()
        for n in plan.order:
            for a in n.args:
                self.readers[id(a)] += 2 if n.kind != "elem" or n.op in lower.SPELLS_TWICE else 1
        for n in plan.outputs.values():
            self.readers[id(n)] += 1
        self.inline: dict[int, Column] = {}

    def expr(self, node: Node) -> Column:
        if id(node) in self.column:
            return F.col(self.column[id(node)])
        if node.op == "const":
            return F.lit(node.params[0]).cast("double")
        if node.kind != "elem":
            raise AssertionError(f"{node!r} is not there yet")
        return lower.elementwise(node, self.args(node))

    def args(self, node: Node) -> list[Column]:
        found = [self.expr(a) for a in node.args]
        return [lower.at_digits(a, self.plan.digits) for a in found] if node.op in lower.COMPARES else found

    def needed(self, done: set[int]) -> tuple[set[int], set[int]]:
        """Nodes with a column, and those still without, that something not yet computed reads."""
        keep, seen = set(), set()
        stack = [n for n in self.plan.order if n.kind in ("ts", "scan", "xs") and id(n) not in done] + list(self.plan.outputs.values())
        while stack:
            n = stack.pop()
            if id(n) in seen:
                continue
            seen.add(id(n))
            if id(n) in self.column:
                keep.add(id(n))
            else:
                stack.extend(n.args)
        return keep, seen - keep

    def share(self, df: DataFrame, done: set[int]) -> DataFrame:
        """Gives element-wise nodes that are read more than once a column, innermost first, so that
        no expression is spelled twice."""
        rounds: dict[int, int] = {}
        todo: dict[int, list[Node]] = {}
        _, wanted = self.needed(done)
        for n in self.plan.order:
            if n.kind != "elem" or id(n) not in wanted:
                continue
            if any(a.kind in ("ts", "scan", "xs") and id(a) not in done or a.kind == "elem" and id(a) not in self.column and id(a) not in rounds for a in n.args):
                continue
            rounds[id(n)] = max((rounds.get(id(a), 0) + (self.readers[id(a)] > 1 and id(a) in rounds) for a in n.args), default=0)
            if self.readers[id(n)] > 1:
                todo.setdefault(rounds[id(n)], []).append(n)
        for k in sorted(todo):
            df = df.select("*", *[self.expr(n).alias(self.name[id(n)]) for n in todo[k]])
            self.column |= {id(n): self.name[id(n)] for n in todo[k]}
        return df

    def over(self, panel: DataFrame, initial: DataFrame | None, engine: str) -> DataFrame:
        plan, sym, t = self.plan, self.sym, self.t
        if missing := [c for c in plan.inputs if c not in panel.columns]:
            raise ValueError(f"the panel has no column {', '.join(missing)}")
        leaves = [n for n in plan.order if n.kind == "in"]
        started = [n for n in leaves if n.op == "initial"]
        df = panel.select(sym, t, *[lower.clean(F.col(n.params[0]).cast("double")).alias(self.name[id(n)]) for n in leaves if n.op == "input"])
        if started:
            if initial is None:
                raise ValueError("the plan has initial values: pass initial=")
            df = df.join(initial.select(sym, *[F.col(n.params[0]).cast("double").alias(self.name[id(n)]) for n in started]), sym, "left")
        if engine == "arrow":
            return vector.run(plan, df.select(sym, t, *[self.name[id(n)] for n in leaves]), sym, t)
        self.column = {id(n): self.name[id(n)] for n in leaves}
        done: set[int] = set()
        wants_pos = [n for n in plan.order if n.op in lower.NEEDS_POS and n.kind == "ts"]
        has_pos = False
        for what, steps in plan.phases():
            for nodes in steps:
                df = self.share(df, done)
                if what == "instrument" and not has_pos and any(n in wants_pos for n in nodes):
                    df = df.select("*", F.row_number().over(self.frames.rows).alias(self.pos))
                    has_pos = True
                scans = [n for n in nodes if n.kind == "scan"]
                plain = [n for n in nodes if n.kind != "scan"]
                cols = []
                for n in plain:
                    make = lower.look_back if n.kind == "ts" else lower.cross_section
                    cols.append(make(n, self.args(n), self.frames).alias(self.name[id(n)]))
                if pool := self.frames.pool:
                    df = df.select("*", *[c.alias(k) for k, c in pool.values()])
                    self.frames.pool = {}
                if cols:
                    df = df.select("*", *cols)
                if scans:
                    df = vector.fold(df, [(self.name[id(n)], n, [self.expr(a) for a in n.args]) for n in scans], sym, t)
                self.column |= {id(n): self.name[id(n)] for n in nodes}
                done |= {id(n) for n in nodes}
                keep, _ = self.needed(done)
                self.column = {k: c for k, c in self.column.items() if k in keep}
                has_pos = has_pos and any(id(n) not in done for n in wants_pos)
                df = df.select(sym, t, *sorted(set(self.column.values())), *[self.pos] * has_pos)
        df = self.share(df, done)
        return df.select(sym, t, *[(F.when(self.expr(n), 1.0).otherwise(0.0) if n.boolean else self.expr(n)).cast(plan.dtype).alias(k) for k, n in plan.outputs.items()])
