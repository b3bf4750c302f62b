"""Entity-level summary tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.operators import skew
from tabaudit.operators.star import ROWS, folded_columns, fold


def rollup_to_parent(
    parent: DataFrame,
    child: DataFrame,
    key: str,
    aggs: Mapping[str, Column],
    child_key: str | None = None,
) -> DataFrame:
    """Aggregate the child per key and attach the results to the parent. No child leaves NULL.

    The child shrinks to one row per key before it meets the parent, and join and aggregate share one
    hash partitioning.
    """
    grouped = child.groupBy(F.col(child_key or key).alias("_key"))
    totals = grouped.agg(*[e.alias(name) for name, e in aggs.items()])
    kept = [c for c in parent.columns if c not in aggs]
    return parent.join(totals, F.col(key) == F.col("_key"), "left").select(*kept, *aggs)


def entity_summary(base: DataFrame, blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """Metric blocks, each already one row per entity, left-joined to the base block."""
    out = base
    for block in blocks:
        out = out.join(block, key, "left")
    return out


@dataclass(frozen=True)
class Block:
    """A table that reaches entities through a bridge, e.g. payments reach sellers through items.

    ``measures`` are averaged and summed over ``bridge JOIN table``. ``required`` makes it the base of the
    summary: entities without a match here are left out.
    """

    df: DataFrame
    via: str
    measures: Sequence[str] = field(default_factory=tuple)
    where: Column | None = None
    required: bool = False


def bridged_summary(
    bridge: DataFrame,
    entity: str,
    via: str,
    blocks: Mapping[str, Block],
    measures: Sequence[str] = (),
    fan_out: bool = True,
    rows_per_task: int | None = None,
) -> DataFrame:
    """All blocks of an entity summary in one pass over the bridge.

    One row per entity, with ``<block>_keys`` (distinct ``via`` keys with a match), and for each measure
    ``<block>_<measure>_sum``, ``_count`` and ``_mean``; measures of the bridge itself come without a prefix.

    The bridge is dealt by ``via`` and folded there to one row per ``(via, entity)``, each block to one row per
    ``via``; the blocks join on the same partitioning, and one aggregate per entity ends it, so the bridge's rows
    move once and the distinct count is a plain count. A hot entity combines on the map side; the entities of a
    hot ``via`` key are spread with salts, ``rows_per_task`` to a task.

    ``fan_out=True`` repeats a block's row for every bridge row, as the plain join does: an order
    paid once with three items of one seller counts three times in that seller's revenue. ``False`` counts it
    once per entity.
    """
    hot = skew.hot_buckets(bridge, via, rows_per_task)
    salted = skew.spread(bridge.select(via, entity, *measures), via, [entity], hot)
    state = fold(skew.deal(salted, [via, skew.SALT], bridge), [via, skew.SALT, entity], measures)
    for name, block in blocks.items():
        rows = block.df if block.where is None else block.df.filter(block.where)
        keys = [block.via, skew.SALT]
        right = skew.repeat_used(fold(rows, [block.via], block.measures), block.via, hot, salted, via)
        columns = [*keys, *folded_columns(block.measures)]
        right = right.selectExpr(*[f"`{c}` AS `_{name}_{c}`" for c in columns])
        match = f"`{via}` = `_{name}_{block.via}` AND `{skew.SALT}` = `_{name}_{skew.SALT}`"
        state = state.join(right, F.expr(match), "left")

    weight = f"`{ROWS}`" if fan_out else "1L"
    aggs = {}
    for m in measures:
        aggs |= {f"{m}_sum": f"sum(`_sum_{m}`)", f"{m}_count": f"sum(`_cnt_{m}`)"}
    for name, block in blocks.items():
        aggs[f"{name}_keys"] = f"count(`_{name}_{ROWS}`)"
        for m in block.measures:
            aggs[f"{name}_{m}_sum"] = f"sum({weight} * `_{name}__sum_{m}`)"
            aggs[f"{name}_{m}_count"] = f"sum({weight} * `_{name}__cnt_{m}`)"
    out = state.groupBy(entity).agg(*[F.expr(f"{sql} AS `{name}`") for name, sql in aggs.items()])
    for name, block in blocks.items():
        if block.required:
            out = out.filter(f"`{name}_keys` > 0")

    averaged = [*measures, *[f"{name}_{m}" for name, block in blocks.items() for m in block.measures]]
    columns = [f"`{c}`" for c in (entity, *[f"{name}_keys" for name in blocks])]
    for m in averaged:
        average = f"try_divide(CAST(`{m}_sum` AS DOUBLE), CAST(`{m}_count` AS DOUBLE))"
        columns += [f"`{m}_sum`", f"`{m}_count`", f"{average} AS `{m}_mean`"]
    return out.selectExpr(*columns)
