"""Sea-ice and mean reductions over a stream of field rows, by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import known, ratio


def windowed_reduction(rows: DataFrame, mesh: DataFrame, *, ts: str = "ts", value: str = "value", window: str = "1 hour", slide: str | None = None, watermark: str | None = "1 hour", threshold: float = 0.15) -> DataFrame:
    """``rows(ts, point_id, value)`` -> per window: mean, extent and number of known rows. Works on
    batch and streaming tables; the static mesh side of the join keeps no state, and the watermark
    bounds that of the aggregate."""
    rows = rows.withWatermark(ts, watermark) if rows.isStreaming and watermark else rows
    x, a = known(F.col(value)), F.col("area")
    spans = F.window(ts, window, slide) if slide else F.window(ts, window)
    joined = rows.join(mesh.select("point_id", "area"), "point_id")
    out = joined.groupBy(spans.alias("w")).agg(
        ratio(F.sum(x * a), F.sum(F.when(x.isNotNull(), a))).alias("mean"),
        F.coalesce(F.sum(F.when(x >= threshold, a)), F.lit(0.0)).alias("extent"),
        F.count(x).alias("n"),
    )
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "mean", "extent", "n")
