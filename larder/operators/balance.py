"""Redistribution of surplus stock between the stores of a product.

Every store above its reorder point is paired with every store of the same product
below it, and each pair moves min(surplus, shortage), both taken from the levels
before any move. What a store gives is then

    sum over shortages d <= surplus of d  +  surplus * number of shortages d > surplus

and likewise for what a store takes, so running sums over the quantities of a
product replace the pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Quantities are summed in bands this wide first, then inside each band.
BAND = 4096


def _moved_per_quantity(gaps: DataFrame) -> DataFrame:
    """(product_id, qty) -> units a donor / receiver of that size moves.

    Equal gaps are counted on the map side, so a product with very many stores
    shrinks to its distinct gap sizes. Two levels of running sums keep each window
    partition to the bands of a product or the sizes of a band.
    """
    sizes = (
        gaps.groupBy("product_id", "qty")
        .agg(
            F.count_if(F.col("gap") > 0).alias("donors"),
            F.count_if(F.col("gap") < 0).alias("receivers"),
        )
        .withColumn("band", F.expr(f"qty div {BAND}"))
    )
    sides = ["donors", "receivers"]
    bands = sizes.groupBy("product_id", "band").agg(
        *[F.sum(s).alias(f"{s}_n") for s in sides],
        *[F.sum(F.col("qty") * F.col(s)).alias(f"{s}_units") for s in sides],
    )
    lower = Window.partitionBy("product_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("product_id")
    sums = [f"{s}_{m}" for s in sides for m in ("n", "units")]
    bands = bands.select(
        "product_id",
        "band",
        *[F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"{c}_lower") for c in sums],
        *[F.sum(f"{s}_n").over(whole).alias(f"{s}_all") for s in sides],
    )
    upto = Window.partitionBy("product_id", "band").orderBy("qty").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.join(bands, ["product_id", "band"])

    def moved(other: str):
        n = F.col(f"{other}_n_lower") + F.sum(other).over(upto)
        units = F.col(f"{other}_units_lower") + F.sum(F.col("qty") * F.col(other)).over(upto)
        return units + F.col("qty") * (F.col(f"{other}_all") - n)

    return placed.select(
        "product_id",
        "qty",
        moved("receivers").alias("gives"),
        moved("donors").alias("takes"),
        F.col("receivers_all").alias("receivers"),
        F.col("donors_all").alias("donors"),
    )


def _with_gap(inventory: DataFrame) -> DataFrame:
    return inventory.withColumn("gap", F.col("stock_levels") - F.col("reorder_point")).withColumn(
        "qty", F.abs("gap")
    )


def redistribution(inventory: DataFrame) -> DataFrame:
    """Every inventory row with what it gives, takes, its partner count and its new level."""
    rows = _with_gap(inventory)
    active = rows.where((F.col("gap") != 0) & F.col("product_id").isNotNull()).select("product_id", "gap", "qty")
    moves = _moved_per_quantity(active)
    out = rows.join(moves, ["product_id", "qty"], "left")
    zero = F.lit(0).cast("long")
    given = F.when(F.col("gap") > 0, F.col("gives"))
    taken = F.when(F.col("gap") < 0, F.col("takes"))
    partners = F.when(F.col("gap") > 0, F.col("receivers")).when(F.col("gap") < 0, F.col("donors"))
    return out.select(
        *inventory.columns,
        F.coalesce(given, zero).alias("units_given"),
        F.coalesce(taken, zero).alias("units_taken"),
        F.coalesce(partners, zero).alias("partners"),
        (F.col("stock_levels") - F.coalesce(given, zero) + F.coalesce(taken, zero)).alias("new_stock_levels"),
    )


def redistributed_inventory(inventory: DataFrame) -> DataFrame:
    """The inventory with its stock levels after redistribution."""
    done = redistribution(inventory)
    return done.select(
        *[F.col("new_stock_levels").alias("stock_levels") if c == "stock_levels" else F.col(c) for c in inventory.columns]
    )


def transfer_summary(inventory: DataFrame) -> DataFrame:
    """Per product with any move: donors, receivers, pairs and units moved."""
    done = redistribution(inventory).where("partners > 0")
    return (
        done.groupBy("product_id")
        .agg(
            F.count_if(F.col("units_given") > 0).alias("donors"),
            F.count_if(F.col("units_taken") > 0).alias("receivers"),
            F.sum("units_given").alias("units_moved"),
        )
        .withColumn("pairs", F.col("donors") * F.col("receivers"))
    )
