"""Aggregates over a join of facts, without carrying the joined rows.

Joining items to orders, payments and reviews and then averaging means shipping every row through every
join, once per partner, and two hot sides multiply. Here a side can be **folded** to one row per join key: a row
count, plus sum and non-NULL count of each measure. Folding combines on the map side, so a hot key is one
row per task. A join of folded sides is a product of counts and sums, and counts, sums and means of the full
join follow exactly:

    rows   = n_left * n_right
    sum(x) = sum_x * n_other          for x on either side
    cnt(x) = cnt_x * n_other

Fan-out (several payments or reviews per order) is therefore kept exactly as the plain join would have it.

When is it worth a shuffle? ``star_fold`` folds

* both sides of a key on which some link can fan out: nothing may multiply row by row. Rows of a hot key
  that differ in their other keys are spread with salts (see ``skew``);
* the running state when at most one key is left to join: it shrinks to the size of that dimension, and if
  it has no group columns yet, the fold and the join share one exchange.

With several keys left and unique partners, folding would move all rows for little, so the rows join as they
are. Both inputs of that join are plain shuffles, which is the case AQE splits when a key is hot.
Small dimensions are broadcast by Catalyst or AQE from their measured size; no hint is forced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import mean, percent
from tabaudit.operators import skew

ROWS = "_rows"


@dataclass(frozen=True)
class Link:
    """A table to join: ``left`` (a column of the fact or of an earlier link) equals ``df[right]``.

    ``unique=True`` says that ``right`` is a key of ``df``. It is a promise about speed only: it skips
    folding this side, and the result stays exact when it is wrong. Leave it off for a table that the same
    plan aggregates or joins on that key, because AQE could not split a hot key of such a join.
    """

    df: DataFrame
    left: str
    right: str | None = None
    where: Column | None = None
    unique: bool = False

    @property
    def key(self) -> str:
        return self.right or self.left


def _sum(m: str) -> str:
    return f"_sum_{m}"


def _cnt(m: str) -> str:
    return f"_cnt_{m}"


def _named(sql: str, name: str) -> str:
    return f"{sql} AS `{name}`"


def _group(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(_named(sql, name)) for name, sql in aggs.items()])


def _project(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.selectExpr(*[_named(sql, name) for name, sql in columns.items()])


def fold(df: DataFrame, keys: Sequence[str], measures: Sequence[str] = ()) -> DataFrame:
    """Raw rows to one row per key: row count, and sum and non-NULL count of every measure."""
    aggs = {ROWS: "count(*)"}
    for m in measures:
        aggs |= {_sum(m): f"sum(`{m}`)", _cnt(m): f"count(`{m}`)"}
    return _group(df, keys, aggs)


def _as_folded(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The folded form of a table whose key is unique: a projection, no shuffle."""
    columns = {k: f"`{k}`" for k in keys} | {ROWS: "1L"}
    for m in measures:
        columns |= {_sum(m): f"`{m}`", _cnt(m): f"CAST(`{m}` IS NOT NULL AS BIGINT)"}
    return _project(df, columns)


def _refold(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return _group(df, keys, {c: f"sum(`{c}`)" for c in folded_columns(measures)})


def folded_columns(measures: Sequence[str]) -> list[str]:
    return [ROWS, *[x for m in measures for x in (_sum(m), _cnt(m))]]


def _unique_order(names: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(names))


def star_fold(
    fact: DataFrame,
    links: Sequence[Link],
    by: Sequence[str],
    measures: Sequence[str] = (),
    where: Column | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """``fact JOIN links ... GROUP BY by`` in folded form.

    ``by`` and ``measures`` name columns of the fact or of any link (first owner wins). Filters sit on the
    table they speak about, below every join, so they reach the scans.
    """
    frames = [fact if where is None else fact.filter(where)]
    frames += [link.df if link.where is None else link.df.filter(link.where) for link in links]
    owned = [set(f.columns) for f in frames]

    def owner(col: str) -> int:
        for i, columns in enumerate(owned):
            if col in columns:
                return i
        raise ValueError(f"no table has a column {col!r}")

    by_owner = {c: owner(c) for c in by}
    measure_owner = {m: owner(m) for m in measures}
    left_owner = [owner(link.left) for link in links]
    for j, link in enumerate(links):
        if left_owner[j] > j:
            raise ValueError(f"{link.left!r} comes from a table that is linked later")
    fans_out = {link.left for link in links if not link.unique}

    def labels_of(i: int) -> list[str]:
        """What later steps need from table i besides measures: group columns and keys of later links."""
        later = [links[j].left for j in range(i, len(links)) if left_owner[j] == i]
        return _unique_order([c for c in by if by_owner[c] == i] + later)

    def measures_of(i: int) -> list[str]:
        return [m for m in measures if measure_owner[m] == i]

    def pending(j: int) -> list[str]:
        """Join keys that the state holds for link ``j`` and later ones."""
        return _unique_order([links[k].left for k in range(j, len(links)) if left_owner[k] <= j])

    def pays(j: int) -> bool:
        return len(pending(j)) <= 1 or links[j].left in fans_out

    have = measures_of(0)
    if not links:
        return fold(frames[0], list(by), have)

    labels = [c for c in by if by_owner[c] == 0]  # group columns in the state so far
    keys = _unique_order([*labels, *pending(0)])
    hot: Column | None = None
    salted: DataFrame | None = None  # rows that hold every pair of key and salt
    others = [c for c in keys if c != links[0].left]
    if links[0].left in fans_out and others:
        # One exchange serves the fold and the join: rows are dealt by key and salt, then folded in place.
        hot = skew.hot_buckets(frames[0], links[0].left, rows_per_task)
        salted = skew.spread(frames[0].select(*_unique_order([*keys, *have])), links[0].left, others, hot)
        keys = [*keys, skew.SALT]
        state = fold(skew.deal(salted, [links[0].left, skew.SALT], frames[0]), keys, have)
    else:
        state = (fold if pays(0) else _as_folded)(frames[0], keys, have)
    for j, link in enumerate(links):
        i = j + 1
        if j > 0 and links[j - 1].left != link.left:
            # A new key: drop what only the last one needed, then see whether the new one must be spread.
            keys = _unique_order([*labels, *pending(j)])
            state = _refold(state, keys, have) if pays(j) else state.select(*keys, *folded_columns(have))
            others = [c for c in keys if c != link.left]
            hot = None
            if link.left in fans_out and left_owner[j] == 0 and others:
                hot = skew.hot_buckets(frames[0], link.left, rows_per_task)
                state = salted = skew.spread(state, link.left, others, hot)
                keys = [*keys, skew.SALT]

        brought = [c for c in labels_of(i) if c not in keys]
        right_keys = _unique_order([link.key, *brought])
        right = (_as_folded if link.unique else fold)(frames[i], right_keys, measures_of(i))
        if hot is not None:
            right = skew.repeat_used(right, link.key, hot, salted, link.left)
            right_keys = [*right_keys, skew.SALT]
        right_columns = [*right_keys, *folded_columns(measures_of(i))]
        right = _project(right, {f"_r_{c}": f"`{c}`" for c in right_columns})

        match = f"`{link.left}` = `_r_{link.key}`"
        if hot is not None:
            match += f" AND `{skew.SALT}` = `_r_{skew.SALT}`"
        columns = {c: f"`{c}`" for c in keys} | {c: f"`_r_{c}`" for c in brought}
        columns[ROWS] = f"`{ROWS}` * `_r_{ROWS}`"
        for m in have:
            columns |= {x: f"`{x}` * `_r_{ROWS}`" for x in (_sum(m), _cnt(m))}
        for m in measures_of(i):
            columns |= {x: f"`_r_{x}` * `{ROWS}`" for x in (_sum(m), _cnt(m))}
        state = _project(state.join(right, F.expr(match)), columns)
        have = have + measures_of(i)
        keys = [*keys, *brought]
        labels += [c for c in by if by_owner[c] == i]
    return _refold(state, list(by), have)


def rows_of() -> Column:
    return F.col(ROWS)


def rate_of(measure: str, scale: int | None = 2) -> Column:
    """Mean of a 0/1 measure in percent, over its non-NULL rows."""
    return percent(F.col(_sum(measure)), F.col(_cnt(measure)), scale)


def mean_of(measure: str, scale: int | None = 2) -> Column:
    return mean(F.col(_sum(measure)), F.col(_cnt(measure)), scale)


def total_of(measure: str) -> Column:
    return F.col(_sum(measure))


def joined_aggregate(
    fact: DataFrame,
    links: Sequence[Link],
    by: Sequence[str],
    measures: Sequence[str],
    outputs: Mapping[str, Column],
    min_n: int | None = None,
    inclusive: bool = False,
    where: Column | None = None,
    order_by: Sequence[Column] = (),
    rows_per_task: int | None = None,
) -> DataFrame:
    """Group the join by ``by``, keep groups above the volume floor, project ``outputs``.

    The floor counts joined rows: ``> min_n``, or ``>= min_n`` with ``inclusive``.
    """
    out = star_fold(fact, links, by, measures, where, rows_per_task)
    if min_n is not None:
        out = out.filter(F.col(ROWS) >= min_n if inclusive else F.col(ROWS) > min_n)
    out = out.select(*by, *[c.alias(name) for name, c in outputs.items()])
    return out.orderBy(*order_by, *by) if order_by else out
