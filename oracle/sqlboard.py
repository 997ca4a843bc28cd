"""The same factors stated in DuckDB SQL, for checking: one common table expression per dependency level."""

from __future__ import annotations

from dataclasses import dataclass

from barley.operators import Board, FactorSet, Term

ID_W = "PARTITION BY instrument_id ORDER BY bar"
TS_W = "PARTITION BY ts"


def _w(n: int) -> str:
    return f"OVER ({ID_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) {_w(n)} = {n} THEN {value} END"


def _list(x: str, n: int) -> str:
    return f"list({x}) {_w(n)}"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END)"


def real(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN ({x}) END)"


def _cmp(sign: str):
    return lambda a, b: f"coalesce((({a}) {sign} ({b}))::DOUBLE, {1.0 if sign == '<>' else 0.0})"


def _truth(c: str) -> str:
    return f"coalesce(({c}) <> 0, true)"


SCALAR = {
    "add": lambda a, b: f"({a} + {b})",
    "sub": lambda a, b: f"({a} - {b})",
    "mul": lambda a, b: f"({a} * {b})",
    "neg": lambda a: f"(-({a}))",
    "div": div,
    "gt": _cmp(">"), "lt": _cmp("<"), "ge": _cmp(">="), "le": _cmp("<="), "eq": _cmp("="), "ne": _cmp("<>"),
    "both": lambda a, b: f"({_truth(a)} AND {_truth(b)})::DOUBLE",
    "either": lambda a, b: f"({_truth(a)} OR {_truth(b)})::DOUBLE",
    "negate": lambda a: f"(NOT {_truth(a)})::DOUBLE",
    "if_else": lambda c, a, b: f"(CASE WHEN {_truth(c)} THEN {a} ELSE {b} END)",
    "max": lambda a, b: f"(CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN greatest({a}, {b}) END)",
    "min": lambda a, b: f"(CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN least({a}, {b}) END)",
    "log": lambda a: f"(CASE WHEN ({a}) > 0 THEN ln({a}) END)",
    "sqrt": lambda a: f"(CASE WHEN ({a}) >= 0 THEN sqrt({a}) END)",
    "sign": lambda a: f"sign({a})::DOUBLE",
    "abs": lambda a: f"abs({a})",
    "exp": lambda a: f"exp({a})",
    "floor": lambda a: f"floor({a})",
    "ceil": lambda a: f"ceil({a})",
    "round": lambda a, d=0: f"round_even({a}, {d})",
    "power": lambda a, b: f"(CASE WHEN NOT isnan(pow({a}, {b})) THEN pow({a}, {b}) END)",
    "signed_power": lambda a, b: f"(CASE WHEN NOT isnan(pow(abs({a}), {b})) THEN sign({a}) * pow(abs({a}), {b}) END)",
    "is_nan": lambda a: f"(({a}) IS NULL)::DOUBLE",
    "fill_nan": lambda a, v=0.0: f"coalesce({a}, {float(v)!r}::DOUBLE)",
    "replace_zero": lambda a, e=1e-4: f"(CASE WHEN ({a}) = 0 THEN {float(e)!r}::DOUBLE ELSE ({a}) END)",
}


def _mean(x, n):
    return _full(x, n, f"list_sum({_list(x, n)}) / {n}")


def _corr(x, y, n):
    a, b = _pair(x, y)
    spread = f"(stddev_samp({a}) {_w(n)} * stddev_samp({b}) {_w(n)})"
    return _full(a, n, f"round({div(f'covar_samp({a}, {b}) {_w(n)}', spread)}, 12)")


def _pair(x, y):
    both = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    return f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"


def _slope(x, n):
    # weights from the centred positions of the window, independent of regr_slope
    top = f"list_sum(list_transform({_list(x, n)}, lambda v, i: v * (i - {(n + 1) / 2}::DOUBLE)))"
    return f"{top} / {n * (n * n - 1) / 12}::DOUBLE"


def _selected(x, y, n, k, top):
    both = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    pairs = f"list_sort(list(CASE WHEN {both} THEN struct_pack(y := {y}, t := bar, x := {x}) END) {_w(n)})"
    pairs = f"list_filter({pairs}, lambda p: p IS NOT NULL)"
    part = f"({pairs})[-{k}:]" if top else f"({pairs})[1:{k}]"
    total = f"list_sum(list_transform({part}, lambda p: p.x))"
    return f"CASE WHEN count(*) {_w(n)} = {n} AND count(CASE WHEN {both} THEN 1 END) {_w(n)} >= {k} THEN {total} / {k} END"


def _ema(x, n):
    a = min(1.0, 2.0 / (n + 1))
    prefix = f"list(CASE WHEN ({x}) IS NOT NULL THEN struct_pack(b := bar::DOUBLE, y := {x}) END) OVER ({ID_W})"
    prefix = f"list_filter({prefix}, lambda p: p IS NOT NULL)"
    old = f"pow({1 - a!r}::DOUBLE, q.b - p.b)"
    fold = f"list_reduce({prefix}, lambda p, q: struct_pack(b := q.b, y := ({old} * p.y + {a!r}::DOUBLE * q.y) / ({old} + {a!r}::DOUBLE)))"
    return f"CASE WHEN count({x}) OVER ({ID_W}) > 0 THEN ({fold}).y END"


def _percentile(x, n, q):
    return _full(x, n, f"quantile_cont({x}, {q}) {_w(n)}")


def _sel_diff(x, y, n, k):
    return f"({_selected(x, y, n, k, True)}) - ({_selected(x, y, n, k, False)})"


ROLLING = {
    "ts_mean": _mean,
    "ts_sum": lambda x, n: _full(x, n, f"list_sum({_list(x, n)})"),
    "ts_std": lambda x, n: _full(x, n, f"stddev_samp({x}) {_w(n)}"),
    "ts_min": lambda x, n: _full(x, n, f"min({x}) {_w(n)}"),
    "ts_max": lambda x, n: _full(x, n, f"max({x}) {_w(n)}"),
    "ts_max_to_min": lambda x, n: _full(x, n, f"max({x}) {_w(n)} - min({x}) {_w(n)}"),
    "diff_sign": lambda x, n: f"sign({x} - ({_mean(x, n)}))::DOUBLE",
    "delay": lambda x, n: f"lag({x}, {n}) OVER ({ID_W})",
    "delta": lambda x, n: f"({x} - lag({x}, {n}) OVER ({ID_W}))",
    "ts_product": lambda x, n: _full(x, n, f"list_product({_list(x, n)})"),
    "ts_skew": lambda x, n: _full(x, n, f"CASE WHEN stddev_samp({x}) {_w(n)} > 0 THEN skewness({x}) {_w(n)} END"),
    "decay_linear": lambda x, n: _full(x, n, f"list_sum(list_transform({_list(x, n)}, lambda v, i: v * i)) / {n * (n + 1) / 2}::DOUBLE"),
    "covariance": lambda x, y, n: _full(_pair(x, y)[0], n, f"covar_samp({_pair(x, y)[0]}, {_pair(x, y)[1]}) {_w(n)}"),
    "correlation": _corr,
    "ts_slope": lambda x, n: _full(x, n, _slope(x, n)),
    "ts_rsquare": lambda x, n: _full(x, n, f"CASE WHEN max({x}) {_w(n)} > min({x}) {_w(n)} THEN regr_r2({x}, bar) {_w(n)} END"),
    "ts_residual": lambda x, n: _full(x, n, f"{x} - (regr_intercept({x}, bar) {_w(n)} + regr_slope({x}, bar) {_w(n)} * bar)"),
    "ts_percentile": _percentile,
    "ts_rank": lambda x, n: _full(x, n, f"(len(list_filter({_list(x, n)}, lambda v: v < ({x}))) + 1)::DOUBLE"),
    "wq_ts_rank": lambda x, n: _full(x, n, f"(len(list_filter({_list(x, n)}, lambda v: v < ({x}))) + (len(list_filter({_list(x, n)}, lambda v: v = ({x}))) - 1) / 2.0::DOUBLE) / {max(n - 1, 1)}::DOUBLE"),
    "ts_argmax": lambda x, n: _full(x, n, f"list_position({_list(x, n)}, max({x}) {_w(n)})::DOUBLE"),
    "ts_argmin": lambda x, n: _full(x, n, f"list_position({_list(x, n)}, min({x}) {_w(n)})::DOUBLE"),
    "wq_ts_argmax": lambda x, n: _full(x, n, f"({n} - list_position({_list(x, n)}, max({x}) {_w(n)}))::DOUBLE"),
    "wq_ts_argmin": lambda x, n: _full(x, n, f"({n} - list_position({_list(x, n)}, min({x}) {_w(n)}))::DOUBLE"),
    "rolling_selmean_top": lambda x, y, n, k: _selected(x, y, n, k, True),
    "rolling_selmean_btm": lambda x, y, n, k: _selected(x, y, n, k, False),
    "rolling_selmean_diff": _sel_diff,
    "ts_mean_any": lambda x, n: f"CASE WHEN count({x}) {_w(n)} > 0 THEN list_sum({_list(x, n)}) / count({x}) {_w(n)} END",
    "ema": _ema,
}

C = f"OVER ({TS_W})"


def _has(x, value):
    return f"CASE WHEN ({x}) IS NOT NULL THEN {value} END"


def _normalize(x, use_std=False, limit=0.0):
    v = f"({x} - avg({x}) {C})"
    if use_std:
        v = f"(CASE WHEN stddev_samp({x}) {C} > 0 THEN {v} / (stddev_samp({x}) {C}) ELSE {v} END)"
    if limit > 0:
        v = f"CASE WHEN ({x}) IS NOT NULL THEN greatest(-{float(limit)}::DOUBLE, least({float(limit)}::DOUBLE, {v})) END"
    return f"CASE WHEN count({x}) {C} >= 2 THEN {v} END"


def _quantile(x, driver="gaussian", sigma=1.0):
    n = f"(count({x}) {C})::DOUBLE"
    p = f"(1 / {n} + ((row_number() OVER ({TS_W} ORDER BY {x} NULLS LAST, instrument_id) - 1) / ({n} - 1)) * (1 - 2 / {n}))"
    if driver == "uniform":
        v = f"({p} - 0.5)"
    elif driver == "cauchy":
        v = f"tan(pi() * ({p} - 0.5)) * {float(sigma)}"
    else:
        # bisection on the series of the normal distribution is not SQL; the rational form is used as it is published
        from barley.functions import numeric as f

        def horner(cs, r):
            out = f"{cs[-1]!r}::DOUBLE"
            for c in reversed(cs[:-1]):
                out = f"({out} * {r} + {c!r}::DOUBLE)"
            return out
        q = f"({p} - 0.5)"
        r = f"sqrt(-ln(least({p}, 1 - {p})))"
        inner = f"(0.180625 - {q} * {q})"
        v = (f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {horner(f.CENTRE_NUM, inner)} / {horner(f.CENTRE_DEN, inner)} "
             f"WHEN {r} <= 5 THEN sign({q}) * {horner(f.MIDDLE_NUM, f'({r} - 1.6)')} / {horner(f.MIDDLE_DEN, f'({r} - 1.6)')} "
             f"ELSE sign({q}) * {horner(f.TAIL_NUM, f'({r} - 5)')} / {horner(f.TAIL_DEN, f'({r} - 5)')} END * {float(sigma)}")
    return f"CASE WHEN ({x}) IS NOT NULL AND count({x}) {C} >= 2 THEN {v} END"


def _neut(x, y):
    a, b = _pair(x, y)
    slope = f"coalesce({div(f'covar_pop({a}, {b}) {C}', f'(var_pop({b}) {C})')}, 0)"
    return f"CASE WHEN count({a}) {C} >= 3 THEN ({a}) - avg({a}) {C} - {slope} * (({b}) - avg({b}) {C}) END"


SLICE = {
    "cs_rank": lambda x, *_: _has(x, f"rank() OVER ({TS_W} ORDER BY {x} NULLS LAST)::DOUBLE / count({x}) {C}"),
    "cs_rank_average": lambda x: _has(x, f"rank() OVER ({TS_W} ORDER BY {x} NULLS LAST)::DOUBLE + (count(*) OVER (PARTITION BY ts, {x}) - 1) / 2.0::DOUBLE"),
    "cs_zscore": lambda x: div(f"{x} - avg({x}) {C}", f"stddev_samp({x}) {C}"),
    "cs_zscore_pop": lambda x: div(f"{x} - avg({x}) {C}", f"stddev_pop({x}) {C}"),
    "cs_scale": lambda x: _has(x, f"CASE WHEN sum(abs({x})) {C} = 0 THEN 1.0::DOUBLE / count({x}) {C} ELSE {x} / (sum(abs({x})) {C}) END"),
    "cs_demean": lambda x: f"({x} - avg({x}) {C})",
    "cs_max": lambda x: _has(x, f"max({x}) {C}"),
    "cs_min": lambda x: _has(x, f"min({x}) {C}"),
    "normalize": _normalize,
    "winsorize": lambda x, k=4.0: _has(x, f"greatest(avg({x}) {C} - {float(k)} * stddev_pop({x}) {C}, least(avg({x}) {C} + {float(k)} * stddev_pop({x}) {C}, {x}))"),
    "scale_down": lambda x, c=0.0: f"CASE WHEN ({x}) IS NOT NULL AND count({x}) {C} >= 2 THEN (CASE WHEN max({x}) {C} = min({x}) {C} THEN 0.5::DOUBLE ELSE ({x} - min({x}) {C}) / (max({x}) {C} - min({x}) {C}) END) - {float(c)}::DOUBLE END",
    "clip_quantile": lambda x, lo=.2, hi=.8: _has(x, f"greatest(quantile_cont({x}, {lo}) {C}, least(quantile_cont({x}, {hi}) {C}, {x}))"),
    "quantile": _quantile,
    "vector_neut": _neut,
}
TOTAL = {"scale": lambda x, k=1.0: div(f"({x}) * {float(k)}::DOUBLE", f"(sum(abs({x})) OVER (PARTITION BY instrument_id))")}

ALIAS = {"sma": "ts_mean", "stddev": "ts_std", "ts_std_dev": "ts_std", "ts_delay": "delay", "ts_delta": "delta",
         "product": "ts_product", "skewness": "ts_skew", "ts_decay_linear": "decay_linear", "ts_covariance": "covariance",
         "ts_corr": "correlation", "ts_arg_max": "ts_argmax", "ts_arg_min": "ts_argmin", "rank": "cs_rank",
         "zscore": "cs_zscore", "demean": "cs_demean", "c_residual": "vector_neut"}
STEPS = {**ROLLING, **SLICE, **TOTAL}


@dataclass
class SqlBoard(Board):
    def column(self, name):
        return f'"{name}"'

    def literal(self, value):
        return f"{float(value)!r}::DOUBLE"

    def scalar(self, op, exprs, params):
        return SCALAR[op](*exprs, *params)


def factor_sql(factors: FactorSet, fields: list[str], panel: str = "panel") -> tuple[list[str], dict[str, str]]:
    """Common table expressions, the last named ``cells``, and one output expression per factor."""
    board = SqlBoard(fields)
    out: dict[str, Term] = factors.build(board)
    steps = board.ordered(out.values())
    ctes, source = [], panel
    for level, (turn, depth) in enumerate(sorted({(s.turn, s.depth) for s in steps})):
        here = [s for s in steps if (s.turn, s.depth) == (turn, depth)]
        # inputs get a name first, so that window arguments stay short
        inputs, columns = [], []
        for s in here:
            names = []
            for i, t in enumerate(s.args):
                inputs.append(f"{t.expr} AS {s.name}a{i}")
                names.append(f"{s.name}a{i}")
            columns.append(f"{STEPS[ALIAS.get(s.op, s.op)](*names, *s.params)} AS {s.name}")
        drop = ", ".join(f"{s.name}a{i}" for s in here for i in range(len(s.args)))
        ctes.append(f"in{level} AS MATERIALIZED (SELECT *, {', '.join(inputs)} FROM {source})")
        ctes.append(f"at{level} AS MATERIALIZED (SELECT * EXCLUDE ({drop}), {', '.join(columns)} FROM in{level})")
        source = f"at{level}"
    ctes.append(f"cells AS (SELECT * FROM {source})")
    return ctes, {n: real(t.expr) for n, t in out.items()}
