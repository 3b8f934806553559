"""Row-based windows over product-store series: lags, rolling means, decomposition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larder.operators.matching import null_safe_join
from larder.operators.positions import with_positions

# Rows of a series that one task takes at a time.
BLOCK_ROWS = 500_000

Columns = Callable[[WindowSpec], dict[str, Column]]


def over_series(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    columns: Columns,
    before: int,
    after: int = 0,
    daily_grain: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` ahead.

    ``columns`` gets the window and may use ``_row``, the 0-based row number in the
    series. A table at daily grain (one row per key and date) has series no longer
    than the calendar, so one window partition per series is enough; a repeated date is an
    error then. Series of any other table are cut into blocks of ``block_rows`` at their
    global positions; each block carries copies of the neighbouring rows its frames
    reach into. Rows with equal order columns are taken in the order of a hash of the row.
    """
    if block_rows < before + after:
        raise ValueError("block_rows must cover the frame")
    if daily_grain:
        return _plain(df, keys, order_by, columns)
    return _blocked(df, keys, order_by, columns, before, after, block_rows)


def _plain(df: DataFrame, keys: list[str], order_by: list[str], columns: Columns) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order_by)
    repeated = F.lag(F.struct(*order_by)).over(w) == F.struct(*order_by)
    checked = F.when(repeated, F.raise_error(F.lit("not at daily grain: a series holds a date twice")))
    rows = df.withColumn("_row", (F.row_number().over(w) - 1).cast("long"))
    return rows.withColumns({name: checked.otherwise(c) for name, c in columns(w).items()}).drop("_row")


def _blocked(
    df: DataFrame, keys: list[str], order_by: list[str], columns: Columns, before: int, after: int, block_rows: int
) -> DataFrame:
    hashed = df.withColumn("_same", F.xxhash64(*df.columns))
    placed = with_positions(hashed, [*keys, *order_by, "_same"], "_pos").drop("_same")
    starts = placed.groupBy(*keys).agg(F.min("_pos").alias("_start"))
    rows = null_safe_join(placed, starts, keys).select(*df.columns, (F.col("_pos") - F.col("_start")).alias("_row"))
    home = F.expr(f"_row div {block_rows}")
    inside = F.col("_row") % block_rows
    nearby = F.array_compact(
        F.array(
            home,
            F.when(inside >= block_rows - before, home + 1),
            F.when((inside < after) & (home > 0), home - 1),
        )
    )
    spread = rows.withColumn("_home", home).withColumn("_block", F.explode(nearby))
    w = Window.partitionBy(*keys, "_block").orderBy("_row")
    done = spread.withColumns(columns(w)).where("_block = _home")
    return done.drop("_row", "_home", "_block")


def lag_columns(value: str, lags: list[int], prefix: str = "lag_") -> Columns:
    """Value n rows earlier in the series."""
    return lambda w: {f"{prefix}{n}": F.lag(value, n).over(w) for n in lags}


def rolling_mean(value: str, rows: int, w: WindowSpec, min_rows: int | None = None, shifted: bool = False) -> Column:
    """Mean of the last ``rows`` rows, null until ``min_rows`` (default all) are there.

    ``shifted`` leaves the current row out, for features of a model that predicts it.
    """
    frame = w.rowsBetween(-rows, -1) if shifted else w.rowsBetween(1 - rows, 0)
    needed = rows if min_rows is None else min_rows
    there, total = F.count(value).over(frame), F.sum(value).over(frame)
    return F.when(there >= needed, total / there)


def with_history(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    value: str,
    lags: list[int] = [1, 7, 30],
    means: list[int] = [7, 30],
    shifted: bool = False,
    daily_grain: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Lag and rolling-mean features of a demand table, in one window pass."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        out = lag_columns(value, lags)(w)
        for n in means:
            out[f"rolling_{n}_mean"] = rolling_mean(value, n, w, shifted=shifted)
        return out

    reach = max([*lags, *means])
    return over_series(df, keys, order_by, columns, reach, daily_grain=daily_grain, block_rows=block_rows)


def naive_forecast(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    value: str = "sales_quantity",
    rows: int = 2,
    daily_grain: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Forecast each row by the mean of it and the row before."""
    return over_series(
        df,
        keys,
        order_by,
        lambda w: {"predicted_demand": rolling_mean(value, rows, w, min_rows=1)},
        rows,
        daily_grain=daily_grain,
        block_rows=block_rows,
    )


def seasonal_decomposition(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    value: str = "sales_quantity",
    period: int = 7,
    daily_grain: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Additive trend / seasonal / residual split of every series.

    Trend is the centred moving average (half weights at both ends for an even
    period); the seasonal part is the mean detrended value per phase, centred on
    zero. Series shorter than two periods are not decomposed: all three are null.
    """
    half = period // 2
    even = period % 2 == 0

    def columns(w: WindowSpec) -> dict[str, Column]:
        wide = w.rowsBetween(-half, half)
        full = F.count(value).over(wide) == 2 * half + 1
        total = F.sum(value).over(wide)
        if even:
            total = total - (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
        return {"trend": F.when(full, total / period), "_phase": F.col("_row") % period, "_first": F.col("_row") < period}

    trended = over_series(df, keys, order_by, columns, half, half, daily_grain, block_rows)
    split = _phase_windows if daily_grain else _phase_join
    enough = F.col("_length") >= 2 * period
    return (
        split(trended, keys, F.col(value) - F.col("trend"))
        .withColumn("trend", F.when(enough, F.col("trend")))
        .withColumn("seasonal", F.when(enough, F.col("_seasonal")))
        .withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))
        .drop("_seasonal", "_length", "_phase", "_first")
    )


def _phase_windows(trended: DataFrame, keys: list[str], detrended: Column) -> DataFrame:
    """Centred phase means of short series: windows on the partitioning the trend has used, no further shuffle."""
    whole = Window.partitionBy(*keys)
    phase_mean = F.avg(detrended).over(Window.partitionBy(*keys, "_phase"))
    means = trended.withColumns({"_mean": phase_mean, "_length": F.count(F.lit(1)).over(whole)})
    centre = F.avg(F.when(F.col("_first"), F.col("_mean"))).over(whole)
    return means.withColumn("_seasonal", F.col("_mean") - centre).drop("_mean")


def _phase_join(trended: DataFrame, keys: list[str], detrended: Column) -> DataFrame:
    """The same for series of any length: means are summed on the map side and joined back, one row per phase."""
    phases = trended.groupBy(*keys, "_phase").agg(F.avg(detrended).alias("_mean"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*keys)
    seasonal = phases.select(
        *keys,
        "_phase",
        (F.col("_mean") - F.avg("_mean").over(whole)).alias("_seasonal"),
        F.sum("_rows").over(whole).alias("_length"),
    )
    return null_safe_join(trended, seasonal, [*keys, "_phase"], "left")
