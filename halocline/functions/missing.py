"""Missing values: NULL inside the engine, whatever came in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known(x: Column, finite: bool = False) -> Column:
    """``x`` as double with NaN (and with ``finite`` also infinities) as NULL."""
    x = x.cast("double")
    bad = F.isnan(x)
    if finite:
        bad = bad | (F.abs(x) == F.lit(float("inf")))
    return F.when(~bad, x)


def ingest(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with NaN as NULL in the columns (all floating ones by default)."""
    names = columns or [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: known(F.col(n)) for n in names})


def ratio(top: Column, weight: Column) -> Column:
    """``top / weight`` where the weight is positive, else NULL."""
    return F.when(weight > 0, top / weight)
