"""A plan as one DuckDB SQL statement, from the definitions of the operators.

It shares nothing with the lowering (lower.py, kernels.py) but the graph: every node becomes a
column of the common table expression of its depth. Missing is NULL; NaN is made NULL where it
may arise. ``panel`` is SQL for WITH clauses that end in a table ``p`` with sym, t, pos (1 for
an instrument's first row) and the plan's inputs as doubles.
"""

from __future__ import annotations

from panelforge.expr import Node

_BINARY = {"add": "+", "sub": "-", "mul": "*"}
_COMPARE = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "="}
_AGGREGATE = {"sum": "sum({x})", "avg": "avg({x})", "product": "product({x})", "wmin": "min({x})", "wmax": "max({x})"}


def _number(v: float | None) -> str:
    if v is None:
        return "NULL::DOUBLE"
    return f"'{v}'::DOUBLE"


class _Writer:
    def __init__(self, plan):
        self.plan = plan
        self.name = {id(n): f"n{i}" for i, n in enumerate(plan.order)}
        self.depth: dict[int, int] = {}
        for n in plan.order:
            self.depth[id(n)] = 1 + max((self.depth[id(a)] for a in n.args), default=-1)

    def seen(self, x: str) -> str:
        """A number as comparisons see it."""
        if self.plan.digits is None:
            return x
        scale = f"1e{self.plan.digits}::DOUBLE"
        return f"(round_even({x} * {scale}, 0) / {scale})"

    def columns(self, n: Node) -> tuple[list[tuple[str, str]], str]:
        """Helper columns of the level before, and the node's expression."""
        me, op, p = self.name[id(n)], n.op, n.params
        a = [self.name[id(x)] for x in n.args]
        clean = lambda e: f"nullif({e}, 'nan'::DOUBLE)"
        if op == "input":
            return [], clean(f"{p[0]}::DOUBLE")
        if op == "const":
            return [], _number(p[0])
        if op in _BINARY:
            return [], clean(f"({a[0]} {_BINARY[op]} {a[1]})")
        if op == "div":
            return [], clean(f"({a[0]} / {a[1]})")
        if op in _COMPARE:
            return [], f"coalesce({self.seen(a[0])} {_COMPARE[op]} {self.seen(a[1])}, false)"
        if op in ("max", "min"):
            return [], f"CASE WHEN {a[0]} {'>' if op == 'max' else '<'} {a[1]} THEN {a[0]} ELSE {a[1]} END"
        if op in ("and", "or"):
            return [], f"({a[0]} {op} {a[1]})"
        if op == "not":
            return [], f"(NOT {a[0]})"
        if op == "abs":
            return [], f"abs({a[0]})"
        if op == "sqrt":
            return [], f"CASE WHEN {a[0]} >= 0 THEN sqrt({a[0]}) END"
        if op == "log":
            return [], f"CASE WHEN {a[0]} > 0 THEN ln({a[0]}) WHEN {a[0]} = 0 THEN '-inf'::DOUBLE END"
        if op == "exp":
            return [], f"exp({a[0]})"
        if op == "sign":
            return [], f"sign({self.seen(a[0])})::DOUBLE"
        if op == "select":
            return [], f"CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END"
        if op == "finite_or":
            return [], f"CASE WHEN {a[0]} IS NULL OR isinf({a[0]}) THEN {_number(p[0])} ELSE {a[0]} END"
        if op == "powi":
            return [], clean(f"pow({a[0]}, {p[0]})")
        if op == "pow":
            return [], f"CASE WHEN {a[0]} > 0 THEN pow({a[0]}, {a[1]}) WHEN {a[0]} = 0 AND {a[1]} > 0 THEN 0.0 WHEN {a[0]} = 0 AND {a[1]} < 0 THEN 'inf'::DOUBLE END"
        if n.kind == "xs":
            return self.cross(n, me, a)
        if n.kind == "ts":
            return self.window(n, me, a, p[0])
        if op == "ema":
            alpha = repr(p[0].alpha)
            held = f"list({a[0]}) FILTER (WHERE {a[0]} IS NOT NULL) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            return [(f"{me}_l", held)], f"list_reduce({me}_l, lambda acc, v: acc * (1 - {alpha}) + v * {alpha})"
        raise ValueError(f"no SQL for {op}")

    def cross(self, n: Node, me: str, a: list[str]) -> tuple[list[tuple[str, str]], str]:
        if n.op == "rank":
            q = f"{me}_q"
            rank = f"(rank() OVER (PARTITION BY t ORDER BY {q} NULLS LAST) + (count({q}) OVER (PARTITION BY t, {q}) - 1) / 2.0) / count({q}) OVER (PARTITION BY t)"
            return [(q, self.seen(a[0]))], f"CASE WHEN {q} IS NOT NULL THEN {rank} END"
        if n.op == "scale":
            return [], f"nullif({a[0]} / sum(abs({a[0]})) OVER (PARTITION BY t), 'nan'::DOUBLE)"
        if n.op == "diff_wsum":
            return [(f"{me}_q", f"{a[0]} * {a[1]}")], f"CASE WHEN count({me}_q) OVER (PARTITION BY t) = count(*) OVER (PARTITION BY t) THEN {a[0]} - sum({me}_q) OVER (PARTITION BY t) END"
        raise ValueError(f"no SQL for {n.op}")

    def window(self, n: Node, me: str, a: list[str], w: int) -> tuple[list[tuple[str, str]], str]:
        op, x = n.op, a[0]
        over = f"OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        if op == "lag":
            return [], f"lag({x}, {w}) OVER (PARTITION BY sym ORDER BY t)"
        if op in ("slope", "rsquare", "resi"):
            f = f"CASE WHEN NOT isinf({x}) THEN {x} END"
            if op == "slope":
                return [], f"regr_slope({f}, pos) {over}"
            if op == "rsquare":
                return [], f"CASE WHEN max({f}) {over} > min({f}) {over} THEN regr_r2({f}, pos) {over} END"
            return [], f"({f}) - (regr_slope({f}, pos) {over} * pos + regr_intercept({f}, pos) {over})"
        # The window's numbers as a list, and the formulas on it.
        q = self.seen(x) if op in ("ts_rank", "argmax", "argmin") else x
        helpers = [(f"{me}_l", f"CASE WHEN count({x}) {over} = {w} THEN list({q}) {over} END")]
        v = f"{me}_l"
        mean = lambda e: f"(list_sum({e}) / {w})"
        if op in _AGGREGATE:
            fn = {"sum": f"list_sum({v})", "avg": mean(v), "product": f"list_product({v})", "wmin": f"list_min({v})", "wmax": f"list_max({v})"}[op]
            return helpers, f"nullif({fn}, 'nan'::DOUBLE)"
        if op in ("cov", "corr"):
            y = a[1]
            u = f"{me}_m"
            helpers = [(v, f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) {over} = {w} THEN list({x}) {over} END"), (u, f"list({y}) {over}")]
            both = f"list_sum(list_transform(list_zip({v}, {u}), lambda e: (e[1] - {mean(v)}) * (e[2] - {mean(u)})))"
            if op == "cov":
                return helpers, f"nullif({both} / {w - 1}, 'nan'::DOUBLE)"
            square = lambda z: f"list_sum(list_transform({z}, lambda e: (e - {mean(z)}) * (e - {mean(z)})))"
            apart = f"list_max({v}) > list_min({v}) AND list_max({u}) > list_min({u})"
            return helpers, f"CASE WHEN {apart} THEN nullif({both} / (sqrt({square(v)}) * sqrt({square(u)})), 'nan'::DOUBLE) END"
        power = lambda k: f"list_sum(list_transform({v}, lambda e: pow(e - {mean(v)}, {k})))"
        if op in ("var", "std"):
            var = f"CASE WHEN list_max({v}) = list_min({v}) THEN 0.0 ELSE nullif({power(2)} / {w - 1}, 'nan'::DOUBLE) END"
            return helpers, f"CASE WHEN {v} IS NOT NULL THEN {var if op == 'var' else f'sqrt({var})'} END"
        if op == "skew":
            return helpers, f"CASE WHEN list_max({v}) > list_min({v}) THEN ({power(3)} / {w}) / pow({power(2)} / {w}, 1.5) * sqrt({w} * {w - 1}.0) / {w - 2} END"
        if op == "kurt":
            return helpers, f"CASE WHEN list_max({v}) > list_min({v}) THEN {w - 1}.0 / ({w - 2} * {w - 3}) * ({w} * {w + 1}.0 * {power(4)} / pow({power(2)}, 2) - 3 * {w - 1}) END"
        if op in ("argmax", "argmin"):
            return helpers, f"list_position({v}, list_{op[3:]}({v}))::DOUBLE"
        if op == "ts_rank":
            return helpers, f"len(list_filter({v}, lambda e: e < {v}[{w}])) + (len(list_filter({v}, lambda e: e = {v}[{w}])) + 1) / 2.0"
        if op == "decay":
            return helpers, f"list_sum(list_transform({v}, lambda e, i: e * i)) / {w * (w + 1) / 2}"
        if op == "quantile":
            return helpers, f"quantile_cont({x}, {n.params[1]}) {over} + 0 * len({v})"
        if op == "drawdown":
            peak = f"list_max({v})"
            return helpers, f"nullif(({peak} - list_min({v}[list_position({v}, {peak}):])) / {peak}, 'nan'::DOUBLE)"
        raise ValueError(f"no SQL for {op}")


def to_sql(plan, panel: str, finish) -> str:
    """``finish(column)`` is the SQL of an output's last step, such as its rounding."""
    w = _Writer(plan)
    ctes, table = [panel.strip()], "p"
    last = {}  # the deepest reader of each node
    for n in plan.order:
        for x in n.args:
            last[id(x)] = max(last.get(id(x), 0), w.depth[id(n)])
    outputs = {id(n) for n in plan.outputs.values()}
    for level in range(max(w.depth.values()) + 1):
        helpers, made = [], []
        for n in (n for n in plan.order if w.depth[id(n)] == level):
            pre, e = w.columns(n)
            helpers += pre
            made.append((w.name[id(n)], e))
        kept = [w.name[id(n)] for n in plan.order if w.depth[id(n)] < level and (id(n) in outputs or last.get(id(n), 0) >= level)]
        base = "*" if level == 0 else ", ".join(["sym", "t", "pos", *kept])
        if helpers:
            ctes.append(f"h{level} AS (SELECT {base}, " + ", ".join(f"{e} AS {k}" for k, e in helpers) + f" FROM {table})")
            table = f"h{level}"
        ctes.append(f"l{level} AS (SELECT {'sym, t, pos' if level == 0 else base}, " + ", ".join(f"{e} AS {k}" for k, e in made) + f" FROM {table})")
        table = f"l{level}"
    out = ", ".join(f'{finish(f"CASE WHEN {w.name[id(n)]} THEN 1.0 ELSE 0.0 END" if n.boolean else w.name[id(n)])} AS "{k}"' for k, n in plan.outputs.items())
    return ",\n".join(ctes) + f"\nSELECT sym, t, {out} FROM {table}"
