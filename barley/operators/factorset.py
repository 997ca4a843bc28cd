"""Evaluate many factors over one panel with as few exchanges as their nesting allows.

A factor is a Python function ``o -> value`` that calls operators on a ``Board``::

    lambda o: -1 * o.correlation(o.rank(o.open), o.rank(o.volume), 10)

The board names every windowed intermediate once (equal calls share one column) and notes in which
pass over the panel it can be computed. A pass is one direction: along time, recursive along time, across
instruments, or totals per instrument. All columns of a pass are computed by plain
``DataFrame.select`` on one partitioning, so that each change of direction costs one exchange however many
factors need it.

Passes along time run on blocks of consecutive bars. Each block also receives the few rows before it that
its windows look back on. No task therefore holds more than ``block_bars`` plus look-back rows of an
instrument, whatever the length of the history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barley.functions import finite
from barley.operators.recursive import ema_columns
from barley.operators.registry import OPERATORS, lookup
from barley.operators.spec import BAR, ID, TS, Slice, Track
from barley.session import forget, write_apart

BLOCK_BARS = 4096
BLOCK = "_block"
PASSES = ("rolling", "smooth", "slice", "total")
RANKS = ("cs_rank", "rank")
#: from this many ranks in a pass they are computed on Arrow batches, time by time (one exchange and one sort of the rows for all ranks)
MANY_RANKS = 4


@dataclass(frozen=True)
class Term:
    """A cell value: an expression over named columns, and the columns it needs."""

    board: "Board"
    expr: object
    key: str
    needs: frozenset[str]

    def _op(self, name, *args):
        return self.board.call(name, *args)

    def __add__(self, other): return self._op("add", self, other)
    def __radd__(self, other): return self._op("add", other, self)
    def __sub__(self, other): return self._op("sub", self, other)
    def __rsub__(self, other): return self._op("sub", other, self)
    def __mul__(self, other): return self._op("mul", self, other)
    def __rmul__(self, other): return self._op("mul", other, self)
    def __truediv__(self, other): return self._op("div", self, other)
    def __rtruediv__(self, other): return self._op("div", other, self)
    def __pow__(self, other): return self._op("power", self, other)
    def __rpow__(self, other): return self._op("power", other, self)
    def __neg__(self): return self._op("neg", self)
    def __gt__(self, other): return self._op("gt", self, other)
    def __lt__(self, other): return self._op("lt", self, other)
    def __ge__(self, other): return self._op("ge", self, other)
    def __le__(self, other): return self._op("le", self, other)
    def equals(self, other): return self._op("eq", self, other)
    def differs(self, other): return self._op("ne", self, other)
    def __and__(self, other): return self._op("both", self, other)
    def __or__(self, other): return self._op("either", self, other)
    def __invert__(self): return self._op("negate", self)


@dataclass(frozen=True)
class Step:
    """One named intermediate column."""

    name: str
    op: str
    args: tuple[Term, ...]
    params: tuple
    needs: frozenset[str]
    turn: int   # which pass
    depth: int  # order inside the pass
    back: int   # rows looked back on, inside the pass


@dataclass
class Board:
    fields: Iterable[str]
    steps: dict[str, Step] = field(default_factory=dict)
    named: dict[str, Term] = field(default_factory=dict)
    _seen: dict[str, Term] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in self.fields:
            self.named[name] = Term(self, self.column(name), name, frozenset([name]))

    # -- what a subclass for another engine would replace
    def column(self, name: str):
        return F.col(name)

    def literal(self, value):
        return F.lit(float(value))

    def scalar(self, op: str, exprs: list, params: tuple):
        return lookup(op).build(*exprs, *params)

    # -- building
    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        # operators win over factors of the same name; those are still in ``named``
        if name in self.named and name not in OPERATORS:
            return self.named[name]
        lookup(name)
        return lambda *args: self.call(name, *args)

    def name(self, name: str, term: Term) -> Term:
        """Give a term a name that later factors can use like a field."""
        self.named[name] = term
        return term

    def _term(self, value) -> Term:
        if isinstance(value, Term):
            return value
        return Term(self, self.literal(value), repr(float(value)), frozenset())

    def call(self, name: str, *args) -> Term:
        op = lookup(name)
        op.check(len(args))
        if op.kind == "macro":
            return op.build(self, *args)
        if name in ("ts_min", "ts_max") and isinstance(args[1], Term):
            return self.call(name[3:], *args)
        terms = tuple(self._term(a) for a in args[: op.series])
        params = tuple(args[op.series:])
        key = f"{name}({','.join([t.key for t in terms] + [repr(p) for p in params])})"
        needs = frozenset().union(*(t.needs for t in terms))
        if op.kind == "scalar":
            return Term(self, self.scalar(name, [t.expr for t in terms], params), key, needs)
        if key not in self._seen:
            before = [self.steps[n] for n in needs if n in self.steps]
            place = PASSES.index(op.kind)
            turn = max((s.turn for s in before), default=0)
            turn += (place - turn) % len(PASSES)
            if op.kind in ("smooth", "total") and any(s.turn == turn for s in before):
                turn += len(PASSES)
            same = [s for s in before if s.turn == turn]
            depth = 1 + max((s.depth for s in same), default=0)
            back = (op.back(*params) if op.kind == "rolling" else 0) + max((s.back for s in same), default=0)
            step = Step(f"_{len(self.steps)}", name, terms, params, needs, turn, depth, back)
            self.steps[step.name] = step
            self._seen[key] = Term(self, self.column(step.name), step.name, frozenset([step.name]))
        return self._seen[key]

    def ordered(self, wanted: Iterable[Term]) -> list[Step]:
        """The steps that ``wanted`` needs, in an order of computation."""
        todo, found = set().union(*(t.needs for t in wanted)), {}
        while todo:
            name = todo.pop()
            if name in self.steps and name not in found:
                found[name] = self.steps[name]
                todo |= self.steps[name].needs
        return sorted(found.values(), key=lambda s: (s.turn, s.depth, int(s.name[1:])))


def in_blocks(panel: DataFrame, back: int, block_bars: int = BLOCK_BARS) -> DataFrame:
    """Put each row into the block of its bar and into later blocks that look back on it."""
    bar = F.col(BAR)
    first = F.floor(bar / F.lit(block_bars))
    last = F.floor((bar + F.lit(back)) / F.lit(block_bars))
    return panel.withColumn(BLOCK, F.explode(F.sequence(first, last)))


def at_home(panel: DataFrame, block_bars: int = BLOCK_BARS) -> DataFrame:
    """Keep each row only in the block of its own bar."""
    return panel.where(F.col(BLOCK) == F.floor(F.col(BAR) / F.lit(block_bars))).drop(BLOCK)


@dataclass
class FactorSet:
    """Ordered variables and factors. Later entries may use earlier ones by name."""

    variables: dict[str, Callable] = field(default_factory=dict)
    factors: dict[str, Callable] = field(default_factory=dict)

    def add(self, name: str, factor: Callable) -> "FactorSet":
        self.factors[name] = factor
        return self

    def add_variable(self, name: str, variable: Callable) -> "FactorSet":
        self.variables[name] = variable
        return self

    def only(self, names: Iterable[str]) -> "FactorSet":
        """The named factors, with all variables."""
        return FactorSet(dict(self.variables), {n: self.factors[n] for n in names})

    def build(self, board: Board) -> dict[str, Term]:
        for name, variable in self.variables.items():
            board.name(name, variable(board))
        out = {}
        for name, factor in self.factors.items():
            out[name] = board.name(name, board._term(factor(board)))
        return out

    def evaluate(self, panel: DataFrame, block_bars: int = BLOCK_BARS, keep: tuple[str, ...] = (),
                 cut: bool | None = None) -> DataFrame:
        """The panel's keys and one column per factor. ``panel`` is dense, with a ``bar`` number.

        With ``cut`` the table is written to the checkpoint folder between passes. That bounds what a lost
        executor costs, and keeps the plans of many-pass sets small. By default sets of three and more
        passes, or with a pass that reads its input twice, are cut. A table goes once the next one is written, so
        that the disk holds two of them and one exchange, whatever the number of passes.
        """
        board = Board([c for c in panel.columns if c not in (ID, TS, BAR)])
        out = self.build(board)
        steps = board.ordered(out.values())
        keys = [ID, TS, BAR]
        wanted = frozenset(keep).union(*(t.needs for t in out.values()))
        df = panel
        turns = sorted({s.turn for s in steps})
        twice = [t for t in turns if PASSES[t % len(PASSES)] in ("smooth", "total")]
        if cut is None:
            cut = len(turns) >= 3 or bool(twice)
        written = None
        for at, turn in enumerate(turns):
            here = [s for s in steps if s.turn == turn]
            later = [s for s in steps if s.turn > turn]
            live = wanted.union(*(s.needs for s in later)) if later else wanted
            reads = live.union(*(s.needs for s in here))
            df = df.select(*keys, *[c for c in df.columns if c in reads and c not in keys])
            if cut and (at or turn in twice):
                df, old = write_apart(df), written
                if old is not None:
                    forget(old)
                written = df
            df = _run(df, here, PASSES[turn % len(PASSES)], block_bars)
            df = df.select(*keys, *[c for c in df.columns if c in live and c not in keys])
        return df.select(*keys, *[F.col(c) for c in keep], *[finite(t.expr).alias(n) for n, t in out.items()])

    def long(self, panel: DataFrame, block_bars: int = BLOCK_BARS) -> DataFrame:
        """``(ts, instrument_id, factor, value)``, missing values left out."""
        wide = self.evaluate(panel, block_bars)
        return melt(wide, list(self.factors))


def melt(wide: DataFrame, names: list[str], keys: tuple[str, ...] = (TS, ID)) -> DataFrame:
    return wide.unpivot(list(keys), names, "factor", "value").where(F.col("value").isNotNull())


def rank_shares(groups: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Smallest-rank share in (0, 1] of each value among those of its group; equal values, NaN too, share a rank."""
    out = np.zeros(len(x))
    if len(x):
        order = np.lexsort((x, groups))
        g, v = groups[order], x[order]
        new = np.append(True, g[1:] != g[:-1])
        first = np.flatnonzero(new)
        start = np.repeat(first, np.diff(np.append(first, len(g))))
        size = np.repeat(np.diff(np.append(first, len(g))), np.diff(np.append(first, len(g))))
        fresh = new | np.append(True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1])))
        place = np.maximum.accumulate(np.where(fresh, np.arange(len(g)), 0)) - start + 1
        out[order] = place / size
    return out


def _ranked_together(df: DataFrame, ranks: list[Step]) -> DataFrame:
    """All ranks of one depth over rows that are dealt by time: a task ranks the times it has whole and keeps back the rows of the last one."""
    inputs, names = [f"{s.name}x" for s in ranks], [s.name for s in ranks]
    kept = df.columns
    wide = df.withColumns({x: s.args[0].expr.cast("double") for x, s in zip(inputs, ranks)}).sortWithinPartitions(TS)
    schema = df.select("*", *[F.lit(0.0).cast("double").alias(n) for n in names]).schema
    for name in names:
        schema[name].nullable = True

    def ranked(table: pa.Table, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = [table.column(c) for c in kept]
        for name in inputs:
            x = table.column(name).combine_chunks()
            there = x.is_valid().to_numpy(zero_copy_only=False)
            share = np.zeros(len(x))
            share[there] = rank_shares(codes[there], x.drop_null().to_numpy(zero_copy_only=False))
            columns.append(pa.array(share, mask=~there))
        yield from pa.table(columns, [*kept, *names]).to_batches(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None and batch.column(TS)[-1] == held.column(TS)[-1]:
                held = pa.concat_tables([held, pa.table(batch)])   # still the time that is kept back
                continue
            table = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            codes = table.column(TS).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            cut = int(np.argmax(codes == codes[-1]))
            if cut:
                yield from ranked(table.slice(0, cut), codes[:cut])
            held = table.slice(cut)
        if held is not None:
            yield from ranked(held, np.zeros(held.num_rows, np.int64))

    return wide.mapInArrow(run, schema)


def _run(df: DataFrame, steps: list[Step], kind: str, block_bars: int) -> DataFrame:
    if kind == "smooth":
        inputs = {f"{s.name}x": s.args[0].expr for s in steps}
        spans = {s.name: (f"{s.name}x", int(s.params[0])) for s in steps}
        return ema_columns(df.withColumns(inputs), spans)
    if kind == "total":
        inputs = df.withColumns({f"{s.name}x": s.args[0].expr for s in steps})
        sums = inputs.groupBy(ID).agg(*[F.sum(F.abs(F.col(f"{s.name}x"))).alias(f"{s.name}t") for s in steps])
        return inputs.join(sums, ID).withColumns(
            {s.name: lookup(s.op).build(F.col(f"{s.name}x"), F.col(f"{s.name}t"), *s.params) for s in steps})
    # Windows cost computing time, not bytes. The number of tasks is therefore the session's own
    # ``spark.sql.shuffle.partitions``; partitions are not merged by their size in bytes.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if kind == "rolling":
        df = in_blocks(df, max(s.back for s in steps), block_bars).repartition(tasks, ID, BLOCK)
        on: Track | Slice = Track((ID, BLOCK), BAR)
    else:
        df, on = df.repartition(tasks, TS), Slice((TS,))
    together = sum(s.op in RANKS for s in steps) >= MANY_RANKS
    for depth in sorted({s.depth for s in steps}):
        here = [s for s in steps if s.depth == depth]
        ranks = [s for s in here if together and s.op in RANKS]
        here = [s for s in here if not (together and s.op in RANKS)]
        if here:
            df = df.withColumns({s.name: lookup(s.op).build(*[t.expr for t in s.args], *s.params, on=on) for s in here})
        if ranks:
            df = _ranked_together(df, ranks)
    return at_home(df, block_bars) if kind == "rolling" else df
