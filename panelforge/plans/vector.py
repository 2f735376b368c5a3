"""The phases of a plan as Arrow passes.

A plan of many operators is one pass for each phase instead of a window for each operator: rows
are dealt out by the phase's key and sorted, and ``mapInArrow`` computes all that phase can
on numpy arrays (kernels.py). Between phases a row is its instrument, its time and one binary
column with the numbers that are still wanted, so Spark moves whole rows and not columns.

Memory is bounded by batches: an instrument phase keeps the rows that its windows look back on
and the state of recurrences, never an instrument's history; a time phase keeps one time step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.expr import Node
from panelforge.plans import kernels

#: Operators that are built from Columns and cannot run here.
COLUMNS_ONLY = {"reduce", "user_xs", "user_elem"}


@dataclass
class Step:
    """One node: the slot it fills, its operator, and the slots of its arguments."""

    slot: int
    op: str
    kind: str
    args: tuple[int, ...]
    params: tuple
    boolean: bool


@dataclass
class Pass:
    """What a phase reads (slots, in the order of the packed row), computes and hands on."""

    by_time: bool
    reads: list[int]
    steps: list[Step]
    gives: list[int]
    digits: int | None
    names: list[str] | None = None  # of the outputs, in the last pass
    single: bool = False


def _fewest(order: list[Node], slot: dict[int, int], wanted: set[int]) -> list[int]:
    """The fewest slots from which those wanted follow element by element: a smallest cut between
    what was windowed or read and what is wanted, by augmenting paths."""
    room: dict = {}  # what can flow still: to a node (i, 0), through it to (i, 1), on to its readers

    def edge(a, b, n: float) -> None:
        room.setdefault(a, {})[b] = n
        room.setdefault(b, {}).setdefault(a, 0)

    todo, seen = list(wanted), set()
    while todo:
        i = todo.pop()
        if i in seen:
            continue
        seen.add(i)
        edge((i, 0), (i, 1), 1)
        args = [slot[id(a)] for a in order[i].args if a.kind != "const"] if order[i].kind == "elem" else []
        for a in args:
            edge((a, 1), (i, 0), np.inf)
        if order[i].kind != "elem":
            edge("from", (i, 0), np.inf)
        if i in wanted:
            edge((i, 1), "to", np.inf)
        todo += args

    def reached(start, forth: bool) -> dict:
        came, line = {start: None}, [start]
        for a in line:
            for b in room.get(a, ()):
                if b not in came and (room[a][b] if forth else room[b][a]) > 0:
                    came[b] = a
                    line.append(b)
        return came

    while "to" in (came := reached("from", True)):
        b = "to"
        while (a := came[b]) is not None:
            room[a][b] -= 1
            room[b][a] += 1
            b = a
    behind = reached("to", False)
    return [i for i in sorted(seen) if (i, 1) in behind and (i, 0) not in behind]


def passes(plan) -> list[Pass]:
    order: list[Node] = plan.order
    slot = {id(n): i for i, n in enumerate(order)}
    phases = plan.phases() or [("rows", [])]
    outputs = list(plan.outputs.values())
    have = {id(n) for n in order if n.kind == "in"}
    reads = [slot[id(n)] for n in order if n.kind == "in"]
    out = []
    for k, (what, steps) in enumerate(phases):
        last = k == len(phases) - 1
        ready = have | {id(n) for s in steps for n in s}
        for n in order:  # element-wise nodes over what is there by now
            if n.kind == "const" or n.kind == "elem" and all(id(a) in ready for a in n.args):
                ready.add(id(n))
        later = [n for _, s in phases[k + 1 :] for x in s for n in x]
        gives: list[int] = []
        seen: set[int] = set()
        stack = [*outputs] if last else [*outputs, *(a for n in later for a in n.args)]
        while stack:
            n = stack.pop()
            if id(n) in seen or n.op == "const" and not last:
                continue
            seen.add(id(n))
            if id(n) in ready:
                gives.append(slot[id(n)])
            else:
                stack.extend(n.args)
        if last:
            gives = [slot[id(n)] for n in outputs]
        else:
            gives = _fewest(order, slot, set(gives))
        wanted, todo = set(), [*gives, *(slot[id(n)] for s in steps for n in s)]
        given = set(reads)
        while todo:
            i = todo.pop()
            if i in wanted or i in given:
                continue
            wanted.add(i)
            todo.extend(slot[id(a)] for a in order[i].args)
        plain = [Step(i, order[i].op, order[i].kind, tuple(slot[id(a)] for a in order[i].args), order[i].params, order[i].boolean) for i in sorted(wanted)]
        out.append(Pass(what == "time", reads, plain, gives, plan.digits, plan.output_names if last else None, plan.dtype == "float"))
        have = have | ready
        reads = gives
    return out


def _run_steps(job: Pass, got: dict[int, np.ndarray], n: int, windowed) -> None:
    for s in job.steps:
        if s.kind == "const":
            got[s.slot] = np.full(n, np.nan if s.params[0] is None else s.params[0])
            continue
        if s.kind != "elem":
            got[s.slot] = windowed(s)
            continue
        args = [got[a] for a in s.args]
        if s.op in kernels.COMPARES:
            args = [kernels.at_digits(a, job.digits) for a in args]
        got[s.slot] = kernels.elementwise(s.op, s.params, args)


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _unpacked(batch: pa.RecordBatch, job: Pass, first: bool, booleans: set[int]) -> dict[int, np.ndarray]:
    n, k = batch.num_rows, len(job.reads)
    if first:
        got = {s: batch.column(2 + i).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64) for i, s in enumerate(job.reads)}
    else:
        column = batch.column(2)
        start = int(np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0])
        block = np.frombuffer(column.buffers()[2], np.float64, n * k, start) if k else np.zeros(0)
        got = {s: block.reshape(n, k)[:, i].copy() for i, s in enumerate(job.reads)} if k else {}
    return {s: x != 0 if s in booleans else x for s, x in got.items()}


def _packed(batch: pa.RecordBatch, job: Pass, got: dict[int, np.ndarray]) -> pa.RecordBatch:
    n = batch.num_rows
    cols = [got[s].astype(np.float64) for s in job.gives]
    if job.names is not None:
        kind = pa.float32() if job.single else pa.float64()
        out = [pa.array(c, pa.float64(), from_pandas=True).cast(kind, safe=False) for c in cols]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], [*batch.schema.names[:2], *job.names])
    block = np.ascontiguousarray(np.stack(cols, axis=1)) if cols else np.zeros((n, 0))
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(8 * len(cols))
    blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(block)])
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blob], [*batch.schema.names[:2], "v"])


def _by_instrument(job: Pass, first: bool, booleans: set[int]):
    """Batches sorted by instrument and time."""
    seen = {a for s in job.steps if s.kind == "ts" for a in s.args}
    back = max((s.params[0] - (s.op != "lag") for s in job.steps if s.kind == "ts"), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: dict[int, np.ndarray] = {a: np.zeros(0) for a in seen}
        state: dict[int, object] = {}
        held, last = 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            got = _unpacked(batch, job, first, booleans)
            code = _codes(batch.column(0))
            goes_on = last is not None and batch.column(0)[0].as_py() == last[0]
            if not goes_on:
                tail, held = {a: np.zeros(0) for a in seen}, 0
                state = {}
            cuts = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1]
            begins = np.repeat(cuts, np.diff(np.r_[cuts, n]))
            here = np.where(begins == 0, 0, begins + held)
            start_of = np.r_[np.zeros(held, np.int64), here]

            def windowed(s: Step):
                if s.kind == "scan":
                    return _scan(s, [got[a] for a in s.args], cuts, n, state, goes_on)
                full = [np.r_[tail[a], got[a]] for a in s.args]
                if s.op in kernels.COMPARES:
                    full = [kernels.at_digits(x, job.digits) for x in full]
                return kernels.look_back(s.op, s.params, full, start_of, held)

            with np.errstate(all="ignore"):
                _run_steps(job, got, n, windowed)
            rows = n - int(cuts[-1]) + (held if len(cuts) == 1 else 0)
            keep = min(back, rows)
            tail = {a: np.r_[tail[a], got[a]][held + n - keep :] for a in seen}
            held, last = keep, (batch.column(0)[n - 1].as_py(),)
            yield _packed(batch, job, got)

    return run


def _scan(s: Step, feeds: list[np.ndarray], cuts: np.ndarray, n: int, state: dict, goes_on: bool) -> np.ndarray:
    step, init, has_initial = s.params
    first_value = feeds.pop() if has_initial else None
    out = np.empty(n)
    for k, (a, b) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=True)):
        now = state[s.slot] if k == 0 and goes_on and s.slot in state else float(first_value[a]) if has_initial else init
        if s.op == "ema":
            out[a:b] = kernels.ema(feeds[0][a:b], now, step.alpha)
            if not np.isnan(now):
                blank = np.isnan(out[a:b])
                out[a:b][blank] = now
            now = float(out[b - 1])
        else:
            for i, row in enumerate(zip(*(f[a:b].tolist() for f in feeds), strict=True), a):
                now, out[i] = step(now, *row)
        state[s.slot] = now
    return out


def fold(df: DataFrame, scans: list[tuple[str, Node, list]], sym: str, t: str) -> DataFrame:
    """``df`` with a column for each recurrence (name, node, feeds): batches pass, and only the
    state of the instrument at hand is kept."""
    feeds = [c.cast("double").alias(f"_f{i}_{j}") for i, (_, _, fs) in enumerate(scans) for j, c in enumerate(fs)]
    jobs = [Step(i, n.op, "scan", tuple(range(len(fs))), n.params, False) for i, (_, n, fs) in enumerate(scans)]
    names, width, at = [k for k, _, _ in scans], len(df.columns), df.columns.index(sym)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = {}, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            code = _codes(batch.column(at))
            goes_on = last is not None and batch.column(at)[0].as_py() == last[0]
            cuts, k, made = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1], width, []
            for s in jobs:
                mine = [batch.column(k + j).to_numpy(zero_copy_only=False).astype(np.float64) for j in s.args]
                k += len(mine)
                made.append(pa.array(_scan(s, mine, cuts, n, state, goes_on), pa.float64(), from_pandas=True))
            last = (batch.column(at)[n - 1].as_py(),)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], [*batch.schema.names[:width], *names])

    schema = T.StructType(list(df.schema.fields) + [T.StructField(k, T.DoubleType()) for k in names])
    return df.select("*", *feeds).repartition(F.col(sym)).sortWithinPartitions(sym, t).mapInArrow(run, schema)


def _by_time(job: Pass, first: bool, booleans: set[int]):
    """Batches sorted by time: whole time steps are worked on, what is left waits."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = _unpacked(batch, job, first, booleans)
        code = _codes(batch.column(1))
        step = np.cumsum(np.r_[False, code[1:] != code[:-1]])

        def crossed(s: Step):
            args = [got[a] for a in s.args]
            if s.op in kernels.COMPARES:
                args = [kernels.at_digits(a, job.digits) for a in args]
            return kernels.cross_section(s.op, args, step)

        with np.errstate(all="ignore"):
            _run_steps(job, got, batch.num_rows, crossed)
        return _packed(batch, job, got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            code = _codes(batch.column(1))
            change = np.flatnonzero(code[1:] != code[:-1]) + 1
            if wait and wait[-1].column(1)[-1].as_py() != batch.column(1)[0].as_py():
                yield work(_one(wait))
                wait = []
            if not len(change):
                wait.append(batch)
                continue
            cut = int(change[-1])
            yield work(_one([*wait, batch.slice(0, cut)]))
            wait = [batch.slice(cut)]
        if wait:
            yield work(_one(wait))

    return run


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(batches) if len(batches) > 1 else pa.concat_batches([batches[0], batches[0].slice(0, 0)])


def run(plan, leaves: DataFrame, sym: str, t: str) -> DataFrame:
    """``leaves``: sym, t and a column for each input of the plan, in the order of its nodes."""
    key = [leaves.schema[sym], leaves.schema[t]]
    booleans = {i for i, n in enumerate(plan.order) if n.boolean}
    df = leaves
    for k, job in enumerate(passes(plan)):
        by = [t, sym] if job.by_time else [sym, t]  # sums do not hang on the order of arrival
        body = (_by_time if job.by_time else _by_instrument)(job, k == 0, booleans)
        kind = T.FloatType() if job.single else T.DoubleType()
        made = [T.StructField("v", T.BinaryType())] if job.names is None else [T.StructField(c, kind) for c in job.names]
        if any(s.kind in ("ts", "scan", "xs") for s in job.steps):  # else rows stay where they are
            df = df.repartition(F.col(by[0])).sortWithinPartitions(*by)
        df = df.mapInArrow(body, T.StructType(key + made))
    return df
