"""Four-step demand projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project_demand(df: DataFrame, steps: int = 4, cap: float = 1.5) -> DataFrame:
    """``forecasted_qty_w1..n``: moving average plus n slopes, kept in [0, cap x average].

    ``least`` and ``greatest`` skip NULL, so a series without an average gives 0.
    """
    average, slope = F.col("ma_4w"), F.col("trend_slope")
    return df.withColumns(
        {
            f"forecasted_qty_w{n}": F.greatest(
                F.lit(0.0), F.least(average * cap, F.round(average + F.lit(n) * slope, 0))
            )
            for n in range(1, steps + 1)
        }
    )
