"""Depth lookup and vertical interpolation."""

from __future__ import annotations

import warnings
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import known


def closest_depth(levels: DataFrame, target: float) -> tuple[int, float]:
    """(level, depth) nearest to a target; the smaller level on a tie."""
    best = levels.agg(F.min(F.struct(F.abs(F.col("depth") - target).alias("d"), "level", "depth")).alias("b")).first().b
    if best is None:
        raise ValueError("no depth levels")
    return best.level, float(best.depth)


def closest_depths(levels: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets(target)`` -> ``(target, level, depth)``; levels are a small axis, broadcast."""
    best = F.min(F.struct(F.abs(F.col("depth") - F.col("target")).alias("d"), "level", "depth")).alias("b")
    return targets.crossJoin(F.broadcast(levels.select("level", "depth"))).groupBy("target").agg(best).select("target", "b.level", "b.depth")


def interpolate_to_depth(field: DataFrame, levels: DataFrame, target_depths: float | list[float], keys: list[str] = (), *, value: str = "value") -> DataFrame:
    """``field(keys..., level, point_id, value)`` -> ``(keys..., point_id, depth, value)`` at the
    target depths, linear by column and extrapolated beyond the axis (with a warning). An
    unknown value in a bracket makes the result unknown, even at weight 0.

    The depth axis comes to the driver and fixes each target's two levels, so a column needs one
    hash aggregate and no sort.
    """
    axis = sorted((float(r.depth), r.level) for r in levels.select("level", "depth").collect())
    if len(axis) < 2:
        raise ValueError("at least two depth levels are needed")
    given = field.select("level").distinct().count()
    if given != len(axis):
        raise ValueError(f"data has {given} levels, depth axis has {len(axis)} levels")
    depths = [d for d, _ in axis]
    targets = [float(t) for t in (target_depths if isinstance(target_depths, (list, tuple)) else [target_depths])]
    shallow, deep = sum(t < depths[0] for t in targets), sum(t > depths[-1] for t in targets)
    if shallow or deep:
        warnings.warn(f"Extrapolation: {shallow} targets above the shallowest and {deep} below the deepest level", UserWarning, stacklevel=2)
    x, plans = known(F.col(value)), []
    for t in targets:
        hi = min(max(bisect_left(depths, t), 1), len(axis) - 1)
        (d0, l0), (d1, l1) = axis[hi - 1], axis[hi]
        plans.append((t, l0, l1, 0.0 if d1 == d0 else (t - d0) / (d1 - d0)))
    needed = sorted({lv for _, a, b, _ in plans for lv in (a, b)})
    pivot = field.where(F.col("level").isin(needed)).groupBy(*keys, "point_id").agg(*(F.max(F.when(F.col("level") == lv, x)).alias(f"__{lv}") for lv in needed))
    lerp = [F.struct(F.lit(t).alias("depth"), (F.col(f"__{a}") + (F.col(f"__{b}") - F.col(f"__{a}")) * w).alias("value")) for t, a, b, w in plans]
    return pivot.select(*keys, "point_id", F.inline(F.array(*lerp)))
