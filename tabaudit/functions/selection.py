"""Exact order statistics of several columns by a sketch bracket.

1. One scan builds a mergeable quantile sketch of every column (``percentile_approx``, whose rank error is at most
   ``n / ACCURACY``) and counts its values. The sketch names a bracket ``[lo, hi]`` around the middle ranks.
2. One scan counts, exactly and in each column's own type, the values below the bracket and inside it, and estimates
   how many distinct values lie inside. If the middle ranks are not inside (a bracket cast through a double can miss
   by a value), the bracket is opened on that side; if more than ``BRACKET_VALUES`` distinct values lie inside, a new
   sketch of the bracket's rows, eight times finer each time, narrows it. Each such round is one more scan of the same
   kind.
3. The values inside the bracket are counted per distinct value (map-side first, so a value held by a third of the
   rows is one row per task) and ranked by a running sum per column; the values at the two middle ranks are read off
   and returned as one row of literals.

Three scans in the usual case, for all columns together. Nothing but a few values per column reaches the driver, and
no task holds more than the bracket's distinct values of a column. Decimals of any precision are compared exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCURACY = 10_000
BRACKET_VALUES = 1_000_000
_ROUNDS = 16


def _usable(df: DataFrame, name: str) -> Column:
    """The column's value where it counts: NULL and NaN do not."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    return col


def _inside(col: Column, lo, hi, kind: T.DataType) -> Column:
    cond = col.isNotNull()
    if lo is not None:
        cond = cond & (col >= F.lit(lo).cast(kind))
    if hi is not None:
        cond = cond & (col <= F.lit(hi).cast(kind))
    return cond


def _below(col: Column, lo, kind: T.DataType) -> Column:
    return col < F.lit(lo).cast(kind) if lo is not None else F.lit(False)


def _sketch(df: DataFrame, values: list[Column], where: list[Column], spots: list[tuple[float, float]], accuracy: int) -> list:
    """Values at two relative ranks of each column's rows that satisfy ``where``."""
    exprs = [
        F.percentile_approx(F.when(w, v), [max(a, 0.0), min(b, 1.0)], accuracy).alias(f"s{i}")
        for i, (v, w, (a, b)) in enumerate(zip(values, where, spots))
    ]
    row = df.agg(*exprs).first()
    return [row[f"s{i}"] for i in range(len(values))]


def middle_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with ``lower_<i>`` and ``upper_<i>`` of the i-th column: the values at ranks ``floor((n+1)/2)`` and
    ``floor((n+2)/2)``. NULL (and NaN) do not count; both are NULL when nothing is left.
    """
    kinds = [df.schema[c].dataType for c in cols]
    values = [_usable(df, c) for c in cols]
    accuracy = ACCURACY
    step = 2.0 / accuracy
    first = df.agg(
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)],
        *[F.percentile_approx(v, [max(0.5 - step, 0.0), min(0.5 + step, 1.0)], accuracy).alias(f"s{i}") for i, v in enumerate(values)],
    ).first()
    n = [first[f"n{i}"] for i in range(len(cols))]
    bounds = [tuple(first[f"s{i}"]) if first[f"s{i}"] else (None, None) for i in range(len(cols))]
    want = [((m + 1) // 2, (m + 2) // 2) for m in n]
    for _ in range(_ROUNDS):
        checks = []
        for i, (v, (lo, hi), kind) in enumerate(zip(values, bounds, kinds)):
            inside = _inside(v, lo, hi, kind)
            checks += [
                F.count_if(_below(v, lo, kind)).alias(f"b{i}"),
                F.count_if(inside).alias(f"c{i}"),
                F.approx_count_distinct(F.when(inside, v)).alias(f"d{i}"),
            ]
        row = df.agg(*checks).first()
        settled, spots = True, []
        for i, (lo, hi) in enumerate(bounds):
            below, inside, distinct = row[f"b{i}"], row[f"c{i}"], row[f"d{i}"]
            r1, r2 = want[i]
            if n[i] == 0:
                spots.append((0.0, 1.0))
            elif below >= r1:
                bounds[i], settled = (None, lo), False
                spots.append((0.0, 1.0))
            elif below + inside < r2:
                bounds[i], settled = (hi, None), False
                spots.append((0.0, 1.0))
            elif distinct > max(BRACKET_VALUES, 2):
                settled = False
                # Half a row inside each wanted rank, so that an exact sketch lands on it.
                spots.append(((r1 - below - 0.5) / inside - step, (r2 - below - 0.5) / inside + step))
            else:
                spots.append(None)
        if settled:
            break
        wide = [i for i, s in enumerate(spots) if s is not None and s != (0.0, 1.0)]
        if wide:
            # Each narrowing sketch is finer than the last, so the bracket shrinks even where a sketch repeats itself.
            accuracy = min(accuracy * 8, (1 << 31) - 1)
            step = 2.0 / accuracy
            found = _sketch(
                df,
                [values[i] for i in wide],
                [_inside(values[i], *bounds[i], kinds[i]) for i in wide],
                [spots[i] for i in wide],
                accuracy,
            )
            for i, s in zip(wide, found):
                if s:
                    bounds[i] = (s[0], s[1])
    else:
        raise RuntimeError("the median bracket did not settle")
    below = [row[f"b{i}"] for i in range(len(cols))]
    return _ranked(df, values, kinds, bounds, below, want)


def _ranked(df: DataFrame, values, kinds, bounds, below, want) -> DataFrame:
    """The values at the wanted ranks, by a running sum over the distinct values inside each bracket.

    One scan for all columns: a row of column ``c`` holds its value in ``x<c>`` and NULL in the others.
    """
    k = len(values)
    if not k:
        return df.sparkSession.range(1).select()
    tagged = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("c"),
                    F.when(_inside(v, *bounds[i], kinds[i]), F.lit(True)).alias("keep"),
                    *[(v if j == i else F.lit(None).cast(kinds[j])).alias(f"x{j}") for j in range(k)],
                )
                for i, v in enumerate(values)
            ]
        )
    )
    xs = [f"x{j}" for j in range(k)]
    counted = df.select(tagged).filter("keep").groupBy("c", *xs).agg(F.count("*").alias("m"))
    # One window per column over at most BRACKET_VALUES distinct values.
    order = Window.partitionBy("c").orderBy(*xs).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.element_at(F.array(*[F.lit(b) for b in below]), F.col("c") + 1)
    r1 = F.element_at(F.array(*[F.lit(w[0]) for w in want]), F.col("c") + 1)
    r2 = F.element_at(F.array(*[F.lit(w[1]) for w in want]), F.col("c") + 1)
    ranked = counted.withColumn("upto", F.sum("m").over(order) + start)
    picked = ranked.groupBy("c").agg(
        F.min_by(F.struct(*xs), F.when(F.col("upto") >= r1, F.col("upto"))).alias("lower"),
        F.min_by(F.struct(*xs), F.when(F.col("upto") >= r2, F.col("upto"))).alias("upper"),
    )
    found = {r["c"]: r for r in picked.collect()}
    cells = []
    for i, kind in enumerate(kinds):
        r = found.get(i)
        for rank in ("lower", "upper"):
            value = r[rank][f"x{i}"] if r is not None and r[rank] is not None else None
            cells.append(F.lit(value).cast(kind).alias(f"{rank}_{i}"))
    return df.sparkSession.range(1).select(*cells)
