"""Inventory, forecast, pricing, demand and movement tables derived from the driver's tables.

Each view exists twice: as a Spark DataFrame and as the text of a SQL CTE.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-06-30"
AS_OF_TIME = "2024-06-30 08:15:00"


class Views:
    """Lazy views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def inventory(self) -> DataFrame:
        regions = self.table("region").agg(F.array_sort(F.collect_set("r_regionkey"))).scalar()
        rows = self.table("part").select("p_partkey", F.explode(regions).alias("r_regionkey"))
        p, r = F.col("p_partkey"), F.col("r_regionkey")
        # Catalyst takes the exploded rows for as small as part and would broadcast millions of them
        return rows.hint("merge").where((p + r) % 7 != 0).select(
            p.alias("product_id"),
            r.alias("store_id"),
            ((p * 37 + r * 101) % 400).alias("stock_levels"),
            ((p * 13 + r * 7) % 200 + 10).alias("reorder_point"),
            ((p * 7 + r) % 30 + 1).cast("int").alias("lead_time_days"),
            ((p * 31 + r) % 500).alias("warehouse_capacity"),
            F.date_add(F.lit("2024-01-01").cast("date"), ((p * 7) % 365).cast("int")).alias("expiry_date"),
        )

    @cached_property
    def forecast(self) -> DataFrame:
        lines = self.table("lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        supplier = self.table("supplier").select("s_suppkey", "s_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        return (
            lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)
            .join(nation, supplier.s_nationkey == nation.n_nationkey)
            .groupBy(F.col("l_partkey").alias("product_id"), F.col("n_regionkey").alias("store_id"))
            .agg(F.sum("l_quantity").alias("predicted_sales_quantity"), _unit_price().alias("price"))
        )

    @cached_property
    def pricing(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_retailprice")
        f = self.forecast.drop("price").join(part, F.col("product_id") == part.p_partkey)
        price = F.col("p_retailprice") / 10
        return f.select(
            "product_id",
            "store_id",
            price.alias("price"),
            (F.col("predicted_sales_quantity") * (F.lit(0.5) + (F.col("product_id") % 11) / F.lit(10.0))).alias("sales_volume"),
            (price * (F.lit(0.8) + (F.col("product_id") % 5) / F.lit(10.0))).alias("competitor_prices"),
        )

    @cached_property
    def demand(self) -> DataFrame:
        """One row per brand, nation and day."""
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
            F.to_date("l_shipdate").alias("date"),
        )
        part = self.table("part").select("p_partkey", "p_brand")
        supplier = self.table("supplier").select("s_suppkey", "s_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_name")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        customer = self.table("customer").select("c_custkey", "c_mktsegment")
        joined = (
            lines.join(part, lines.l_partkey == part.p_partkey)
            .join(supplier, lines.l_suppkey == supplier.s_suppkey)
            .join(nation, supplier.s_nationkey == nation.n_nationkey)
            .join(orders, lines.l_orderkey == orders.o_orderkey)
            .join(customer, orders.o_custkey == customer.c_custkey)
        )
        # Labels are picked by number: a string in an aggregation buffer would force a sort-based aggregate.
        segments = self.table("customer").agg(F.array_sort(F.collect_set("c_mktsegment"))).scalar()
        segment = F.array_position(segments, F.col("c_mktsegment"))
        flag = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0)
        totals = joined.groupBy(F.col("p_brand").alias("product_id"), F.col("n_name").alias("store_id"), "date").agg(
            F.sum("l_quantity").alias("sales_quantity"),
            _unit_price().alias("unit_price"),
            F.max("l_discount").alias("discount"),
            F.max("l_tax").alias("tax"),
            F.max(flag).alias("flag"),
            F.min(segment).cast("int").alias("segment"),
        )
        month, tax = F.month("date"), F.col("tax")
        return totals.select(
            "product_id",
            "store_id",
            "date",
            "sales_quantity",
            "unit_price",
            F.when(F.col("discount") >= 0.08, "Yes").otherwise("No").alias("promotions"),
            F.when(month.isin(11, 12), "Festival").when(month.isin(1, 7), "Holiday").otherwise("None").alias("seasonality_factors"),
            F.element_at(F.array(F.lit("Decreasing"), F.lit("Stable"), F.lit("Increasing")), F.col("flag") + 1).alias("demand_trend"),
            F.element_at(segments, F.col("segment")).alias("customer_segments"),
            F.when(tax >= 0.08, "Competitor Pricing")
            .when(tax >= 0.05, "Weather")
            .when(tax >= 0.02, "Economic Indicators")
            .otherwise("None")
            .alias("external_factors"),
        )

    @cached_property
    def demand_indexed(self) -> DataFrame:
        """Demand with promotion, weather and economy columns made from its own values."""
        day = F.col("date")
        return self.demand.withColumns(
            {
                "promotion_budget": F.col("unit_price") * F.when(F.col("promotions") == "Yes", 10).otherwise(2),
                "promotion_days": F.day(day) % 8,
                "weather_index": F.month(day) * 5 + 60,
                "economic_index": F.day(day) + 85,
            }
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Demand with the naive forecast as prediction."""
        from larder.operators.windows import naive_forecast
        from larder.schemas import KEYS

        rows = naive_forecast(self.demand, KEYS, ["date"], daily_grain=True)
        return rows.withColumnRenamed("predicted_demand", "prediction")

    @cached_property
    def movements(self) -> DataFrame:
        """Every event; types other than purchase and signup are movements of an unknown kind."""
        return self.table("events").select(
            "event_id",
            "ts",
            F.col("user_id").alias("product_id"),
            (F.col("user_id") % 5).cast("int").alias("store_id"),
            (F.floor("value") + 1).cast("long").alias("qty"),
            F.when(F.col("event_type") == "purchase", "SALE").when(F.col("event_type") == "signup", "RESTOCK").otherwise(F.col("event_type")).alias("tx_type"),
        )

    @cached_property
    def hot_movements(self) -> DataFrame:
        """All movements on eight products of one store."""
        return self.movements.withColumns({"product_id": F.col("product_id") % 8, "store_id": F.lit(1)})

    @cached_property
    def hot_opening(self) -> DataFrame:
        return self.spark.range(8).select(F.col("id").alias("product_id"), F.lit(1).alias("store_id"), (F.col("id") * 40).alias("stock_levels"))

    @cached_property
    def opening(self) -> DataFrame:
        """Opening stock of every user id that is not a multiple of 17."""
        users = self.table("events").select("user_id").distinct().where(F.col("user_id") % 17 != 0)
        return users.select(
            F.col("user_id").alias("product_id"),
            (F.col("user_id") % 5).cast("int").alias("store_id"),
            ((F.col("user_id") * 13) % 200).alias("stock_levels"),
        )


def _unit_price():
    """Average price per unit; cents are summed as integers so that the sum has no rounding order."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return cents.cast("double") / 100 / F.sum("l_quantity")


_PRICE_SQL = "cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / 100 / sum(l_quantity)"

SQL = {
    "inventory": """
        select p_partkey as product_id, r_regionkey as store_id,
               (p_partkey * 37 + r_regionkey * 101) % 400 as stock_levels,
               (p_partkey * 13 + r_regionkey * 7) % 200 + 10 as reorder_point,
               cast(1 + (p_partkey * 7 + r_regionkey) % 30 as integer) as lead_time_days,
               (p_partkey * 31 + r_regionkey) % 500 as warehouse_capacity,
               date '2024-01-01' + cast((p_partkey * 7) % 365 as integer) as expiry_date
        from part cross join region where (p_partkey + r_regionkey) % 7 <> 0""",
    "forecast": f"""
        select l_partkey as product_id, n_regionkey as store_id,
               sum(l_quantity) as predicted_sales_quantity, {_PRICE_SQL} as price
        from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
        group by l_partkey, n_regionkey""",
    "pricing": """
        select f.product_id, f.store_id, p_retailprice / 10 as price,
               f.predicted_sales_quantity * (0.5::double + (f.product_id % 11) / 10.0::double) as sales_volume,
               p_retailprice / 10 * (0.8::double + (f.product_id % 5) / 10.0::double) as competitor_prices
        from forecast f join part on p_partkey = f.product_id""",
    "demand": f"""
        select p_brand as product_id, n_name as store_id, cast(l_shipdate as date) as dt,
               sum(l_quantity) as sales_quantity, {_PRICE_SQL} as unit_price,
               case when max(l_discount) >= 0.08::double then 'Yes' else 'No' end as promotions,
               case when month(max(l_shipdate)) in (11, 12) then 'Festival'
                    when month(max(l_shipdate)) in (1, 7) then 'Holiday' else 'None' end as seasonality_factors,
               case max(l_returnflag) when 'R' then 'Increasing' when 'N' then 'Stable' else 'Decreasing' end as demand_trend,
               min(c_mktsegment) as customer_segments,
               case when max(l_tax) >= 0.08::double then 'Competitor Pricing' when max(l_tax) >= 0.05::double then 'Weather'
                    when max(l_tax) >= 0.02::double then 'Economic Indicators' else 'None' end as external_factors
        from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
             join nation on n_nationkey = s_nationkey join orders on o_orderkey = l_orderkey
             join customer on c_custkey = o_custkey
        group by p_brand, n_name, cast(l_shipdate as date)""",
    "demand_indexed": """
        select *, unit_price * (case when promotions = 'Yes' then 10 else 2 end) as promotion_budget, cast(day(dt) % 8 as integer) as promotion_days,
               cast(month(dt) * 5 + 60 as integer) as weather_index, cast(day(dt) + 85 as integer) as economic_index
        from demand""",
    "scored": """
        select *, avg(sales_quantity) over (partition by product_id, store_id order by dt
                                            rows between 1 preceding and current row) as prediction
        from demand""",
    "movements": """
        select event_id, ts, user_id as product_id, cast(user_id % 5 as integer) as store_id,
               cast(floor(value) as bigint) + 1 as qty,
               case event_type when 'purchase' then 'SALE' when 'signup' then 'RESTOCK' else event_type end as tx_type
        from events""",
    "hot_movements": """
        select event_id, ts, product_id % 8 as product_id, 1 as store_id, qty, tx_type from movements""",
    "hot_opening": "select r as product_id, 1 as store_id, r * 40 as stock_levels from range(0, 8) t(r)",
    "opening": """
        select distinct user_id as product_id, cast(user_id % 5 as integer) as store_id,
               (user_id * 13) % 200 as stock_levels
        from events where user_id % 17 <> 0""",
    "holidays": """
        select d as dt, min(name) as holiday from (
          select unnest([y1, mlk, wb, md, jt, id4, lab, col, vet, tg, xm, y1o, jto, ido, veto, xmo]) as d,
                 unnest(['New Year''s Day', 'Martin Luther King Jr. Day', 'Washington''s Birthday', 'Memorial Day', 'Juneteenth',
                         'Independence Day', 'Labor Day', 'Columbus Day', 'Veterans Day', 'Thanksgiving', 'Christmas Day',
                         'New Year''s Day (observed)', 'Juneteenth (observed)', 'Independence Day (observed)',
                         'Veterans Day (observed)', 'Christmas Day (observed)']) as name
          from (
            select *, case isodow(y1) when 6 then y1 - 1 when 7 then y1 + 1 end as y1o,
                   case isodow(jt) when 6 then jt - 1 when 7 then jt + 1 end as jto,
                   case isodow(id4) when 6 then id4 - 1 when 7 then id4 + 1 end as ido,
                   case isodow(vet) when 6 then vet - 1 when 7 then vet + 1 end as veto,
                   case isodow(xm) when 6 then xm - 1 when 7 then xm + 1 end as xmo
            from (
              select make_date(y, 1, 1) as y1,
                     make_date(y, 1, 1) + cast((8 - isodow(make_date(y, 1, 1))) % 7 + 14 as integer) as mlk,
                     make_date(y, 2, 1) + cast((8 - isodow(make_date(y, 2, 1))) % 7 + 14 as integer) as wb,
                     make_date(y, 5, 31) - cast(isodow(make_date(y, 5, 31)) - 1 as integer) as md,
                     case when y > 2020 then make_date(y, 6, 19) end as jt,
                     make_date(y, 7, 4) as id4,
                     make_date(y, 9, 1) + cast((8 - isodow(make_date(y, 9, 1))) % 7 as integer) as lab,
                     make_date(y, 10, 1) + cast((8 - isodow(make_date(y, 10, 1))) % 7 + 7 as integer) as col,
                     make_date(y, 11, 11) as vet,
                     make_date(y, 11, 1) + cast((11 - isodow(make_date(y, 11, 1))) % 7 + 21 as integer) as tg,
                     make_date(y, 12, 25) as xm
              from (select cast(unnest(range(1990, 2031)) as bigint) as y)))) where d is not null group by d""",
}

# What each CTE builds on.
NEEDS = {"hot_movements": ["movements"], "pricing": ["forecast"], "demand_indexed": ["demand"], "scored": ["demand"]}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` under the CTEs of the named views."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} as ({SQL[n]})" for n in ordered)
    glue = ",\n" if body.lstrip().startswith("+") else "\n"
    return f"with {'recursive ' if recursive else ''}{ctes}{glue}{body.lstrip().lstrip('+')}"
