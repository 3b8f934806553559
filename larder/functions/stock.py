"""Stock arithmetic: demand pick, safety stock, order quantities, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFETY_SHARE = 0.2


def picked_demand(columns: list[str]) -> Column:
    """The demand a forecast row stands for.

    ``predicted_sales_quantity`` wins unless it is zero, then ``predicted_demand``
    is used; a null in the first column stays null. With one column only, that one.
    """
    has_sales = "predicted_sales_quantity" in columns
    has_demand = "predicted_demand" in columns
    if has_sales:
        sales = F.col("predicted_sales_quantity").cast("double")
        other = F.col("predicted_demand").cast("double") if has_demand else F.lit(None).cast("double")
        return F.when(sales.isNull(), F.lit(None).cast("double")).when(sales != 0, sales).otherwise(other)
    if has_demand:
        return F.col("predicted_demand").cast("double")
    raise ValueError("forecast needs predicted_sales_quantity or predicted_demand")


def safety_stock(demand: Column, share: float = SAFETY_SHARE) -> Column:
    return (demand * F.lit(share)).cast("long")


def reorder_qty(demand: Column, stock: Column, share: float = SAFETY_SHARE) -> Column:
    """Whole units to order: demand plus safety minus stock, never below zero; null demand gives 0."""
    need = demand + demand * F.lit(share) - stock
    return F.coalesce(F.greatest(F.lit(0.0), need).cast("long"), F.lit(0).cast("long"))


def needs_reorder(stock: Column, reorder_point: Column, demand: Column) -> Column:
    known = demand.isNotNull() & stock.isNotNull() & reorder_point.isNotNull()
    return known & ((stock < reorder_point) | (stock < demand))


def reorder_point(lead_time: Column, daily_demand: Column, safety: Column) -> Column:
    """Lead time times daily demand plus safety stock, each input floored at zero."""
    zero = F.lit(0)
    return F.greatest(lead_time, zero) * F.greatest(daily_demand, zero) + F.greatest(safety, zero)


def stock_class(stock: Column, low: int = 10, over: int = 300) -> Column:
    return (
        F.when(stock == 0, "out_of_stock")
        .when((stock > 0) & (stock < low), "low_stock")
        .when(stock > over, "overstock")
        .otherwise("normal")
    )


def stock_balance(stock: Column, reorder_point: Column) -> Column:
    """Overstocked / Understocked against the reorder point, null when equal."""
    return F.when(stock > reorder_point, "Overstocked").when(stock < reorder_point, "Understocked")


def stock_gap(stock: Column, predicted: Column) -> Column:
    return F.abs(stock - predicted)


def stockout_risk(stock: Column, reorder_point: Column, inclusive: bool = False) -> Column:
    return stock <= reorder_point if inclusive else stock < reorder_point


def expires_within(expiry: Column, as_of: str, days: int = 30) -> Column:
    """Expiry on or before ``as_of`` + days; already expired rows count, nulls do not."""
    return expiry <= F.date_add(F.lit(as_of).cast("date"), days)


def days_to_expiry(expiry: Column, as_of: str) -> Column:
    return F.datediff(expiry, F.lit(as_of).cast("date"))
