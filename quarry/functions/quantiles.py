"""Exact linear-interpolation quantiles that do not pull a whole column into one task."""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.columns import melt
from quarry.session import cut

# A `percentile` aggregate keeps every distinct value of its group in memory, so it is used
# only up to this many rows per group. Larger groups are narrowed first.
DIRECT_ROWS = 1_000_000
GRID = 1000


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """``(by..., variable, n, q0, q1, ...)`` with one column per probability, NULLs skipped."""
    if not by:
        return _whole_columns(df, list(cols), [float(p) for p in probs], direct_rows)
    long = melt(df, cols, by).filter(F.col("value").isNotNull())
    keys = [*by, "variable"]
    biggest = long.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if biggest <= direct_rows:
        out = long.groupBy(*keys).agg(F.count("value").alias("n"), F.percentile("value", F.array(*[F.lit(float(p)) for p in probs])).alias("qs"))
        return out.select(*keys, "n", *[F.col("qs")[i].alias(f"q{i}") for i in range(len(probs))])
    return _narrowed(long, keys, probs, direct_rows)


def _whole_columns(df: DataFrame, cols: list[str], probs: list[float], direct_rows: int) -> DataFrame:
    """All columns side by side: rows are never copied per column, and the number of scans does not grow with the columns.

    One scan counts and sketches. Small tables then need one ``percentile`` per column. Otherwise the sketches give a bracket
    for each wanted rank, a scan counts exactly what lies below and inside each, and the last scan lets only values inside
    brackets leave their row (about 1 in 200). Brackets of more than ``direct_rows`` values are sketched again before.
    """
    value = [F.col(c).cast("double") for c in cols]
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    result = ", ".join(["variable string", "n bigint", *[f"q{i} double" for i in range(len(probs))]])
    if not cols:
        return df.sparkSession.createDataFrame([], result)
    counts = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(value)]).first()
    known = [i for i in range(len(cols)) if counts[f"n{i}"]]
    if sum(counts[f"n{i}"] for i in known) <= direct_rows:
        one = df.agg(*[F.percentile(value[i], F.array(*[F.lit(p) for p in probs])).alias(f"q{i}") for i in known]).first() if known else None
        return df.sparkSession.createDataFrame([(cols[i], counts[f"n{i}"], *one[f"q{i}"]) for i in known], result)
    slots = [_Bracket(i, qi, p * (counts[f"n{i}"] - 1), counts[f"n{i}"]) for i in known for qi, p in enumerate(probs)]
    open_ = slots
    while open_:
        ranges = {(s.column, s.low, s.high): None for s in open_}
        inside = lambda c, low, high: value[c].between(F.lit(low), F.lit(high))
        row = df.agg(*[F.percentile_approx(F.when(inside(*r), value[r[0]]), grid, F.lit(10000)).alias(f"g{m}") for m, r in enumerate(ranges)]).first()
        sketches = {r: row[f"g{m}"] for m, r in enumerate(ranges)}
        before = sum(s.inside for s in open_)
        for s in open_:
            s.narrow(sketches[s.column, s.low, s.high])
        row = df.agg(*[a for m, s in enumerate(open_) for a in (F.count_if(value[s.column] < s.low).alias(f"b{m}"), F.count_if(inside(s.column, s.low, s.high)).alias(f"i{m}"))]).first()
        for m, s in enumerate(open_):
            s.below, s.inside = row[f"b{m}"], row[f"i{m}"]
        if sum(s.inside for s in open_) >= before:
            break  # repeated values only: they are counted, not kept
        open_ = [s for s in open_ if s.inside > direct_rows and s.low < s.high]
    held = F.array_compact(F.array(*[F.when(value[s.column].between(F.lit(s.low), F.lit(s.high)), F.struct(F.lit(m).alias("slot"), value[s.column].alias("value"))) for m, s in enumerate(slots)]))
    freq = df.select(F.explode(held).alias("e")).groupBy("e.slot", "e.value").count()
    facts = df.sparkSession.createDataFrame([(m, cols[s.column], s.qi, s.n, s.rank, s.below) for m, s in enumerate(slots)], "slot int, variable string, qi int, n bigint, h double, below bigint")
    return _picked(freq.join(F.broadcast(facts), "slot"), ["variable"], len(probs))  # as few rows as columns times ranks


@dataclass
class _Bracket:
    """Where the value of a rank lies: between ``low`` and ``high``, with ``below`` values before and ``inside`` values in it."""

    column: int
    qi: int
    rank: float
    n: int
    below: int = 0
    inside: int = 0
    low: float = float("-inf")
    high: float = float("inf")

    def __post_init__(self):
        self.inside = self.n

    def narrow(self, sketch: list[float]) -> None:
        """Ends one grid step beyond the rank; the sketch errs by a tenth of a step at most."""
        at = (self.rank - self.below) / self.inside * GRID
        first, last = math.floor(at) - 1, math.ceil(at) + 3
        if first >= 1:
            self.low = sketch[first]
        if last <= GRID:
            self.high = sketch[last]


def _picked(freq: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Interpolated values at the wanted ranks from how often each value in the brackets occurs."""
    keys_q = [*keys, "qi"]
    run = freq.withColumn("upto", F.col("below") + F.sum("count").over(Window.partitionBy(*keys_q).orderBy("value")))
    picked = run.groupBy(*keys_q, "n", "h").agg(
        F.min(F.when(F.col("upto") > F.floor("h"), F.col("value"))).alias("a"),
        F.min(F.when(F.col("upto") > F.ceil("h"), F.col("value"))).alias("b"),
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))
    return picked.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("qi") == i, value)).alias(f"q{i}") for i in range(count)])


def _narrowed(long: DataFrame, keys: list[str], probs: Sequence[float], direct_rows: int) -> DataFrame:
    """Shrink a bracket around every wanted rank with mergeable sketches, then sort only the bracket.

    A round sketches the values left in each bracket, moves the bracket ends to sketch values one
    grid step beyond the wanted rank, and recounts exactly what lies below and inside. The sketch's
    rank error (1/10000) is smaller than a grid step (1/1000), so the wanted rank stays inside.
    """
    keys_q = [*keys, "qi"]
    h = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("qi") + 1) * (F.col("n") - 1)
    state = long.groupBy(*keys).agg(F.count("value").alias("n")).withColumn("qi", F.explode(F.sequence(F.lit(0), F.lit(len(probs) - 1))))
    state = state.select(
        *keys_q, "n", h.alias("h"), F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"),
        F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"),
    )
    state = cut(state)
    while True:
        # a bracket holding one repeated value needs no further narrowing
        open_ = state.filter((F.col("inside") > direct_rows) & (F.col("lo") < F.col("hi")))
        if open_.isEmpty():
            break
        grid = F.percentile_approx("value", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), F.lit(10000))
        sketch = long.join(open_, keys).filter(F.col("value").between(F.col("lo"), F.col("hi"))).groupBy(*keys_q).agg(grid.alias("_grid"))
        at = (F.col("h") - F.col("below")) / F.col("inside") * GRID
        first = F.floor(at).cast("int") - 1
        last = F.ceil(at).cast("int") + 3
        ends = open_.join(sketch, keys_q).select(
            *keys_q, "n", "h",
            F.when(first < 1, F.col("lo")).otherwise(F.get("_grid", F.greatest(first, F.lit(0)))).alias("lo"),
            F.when(last > GRID, F.col("hi")).otherwise(F.get("_grid", F.least(last, F.lit(GRID)))).alias("hi"),
        )
        counted = long.join(ends, keys).groupBy(*keys_q, "n", "h", "lo", "hi").agg(
            F.sum((F.col("value") < F.col("lo")).cast("bigint")).alias("below"),
            F.sum(F.col("value").between(F.col("lo"), F.col("hi")).cast("bigint")).alias("inside"),
        )
        done = state.join(open_.select(*keys_q), keys_q, "left_anti")
        new = cut(done.select(*keys_q, "n", "h", "below", "inside", "lo", "hi").unionByName(counted.select(*keys_q, "n", "h", "below", "inside", "lo", "hi")))
        if new.agg(F.sum("inside")).first()[0] >= state.agg(F.sum("inside")).first()[0]:
            break
        state = new
    held = long.join(state, keys).filter(F.col("value").between(F.col("lo"), F.col("hi")))
    freq = held.groupBy(*keys_q, "n", "h", "below", "value").count()
    return _picked(freq, keys, len(probs))
