"""Queries over inventory, forecast, pricing, suggestions and movements."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog import query
from checks.views import AS_OF, AS_OF_TIME
from larder.functions.ratios import pct_change, safe_ratio
from larder.functions.stock import picked_demand, reorder_point, reorder_qty, safety_stock, stock_gap
from larder.operators.balance import redistributed_inventory, redistribution, transfer_summary
from larder.operators.checks import profile, sample_rows, split_rejects, store_ids
from larder.operators.columns import attach_predictions, backfill_store, normal_forecast, stamped, tag
from larder.operators.ledger import adjust, closing_stock, settle
from larder.operators.matching import match, match_or_product, match_suffixed, members, product_filter
from larder.operators.summaries import histogram, shares, stock_maps, stock_matrix, top_n
from larder.plans import monitor, pricing, reorder, reports
from larder.schemas import KEYS
from larder.sources.tables import scan_table

INV = "product_id, store_id, stock_levels, reorder_point, lead_time_days, warehouse_capacity, cast(expiry_date as varchar) as expiry_date"

# --- scans and monitoring ---


@query("table_scan", "S06 S07", f"select {INV} from inventory", "inventory")
def _(v):
    v.inventory.createOrReplaceTempView("inventory")
    return scan_table(v.spark, "inventory")


@query(
    "table_profile",
    "A14 S08",
    """select 'product_id' as column_name, count(*) as row_count, count(*) - count(product_id) as nulls from forecast
       union all select 'store_id', count(*), count(*) - count(store_id) from forecast
       union all select 'predicted_sales_quantity', count(*), count(*) - count(predicted_sales_quantity) from forecast
       union all select 'price', count(*), count(*) - count(price) from forecast""",
    "forecast",
)
def _(v):
    return profile(v.forecast)


@query(
    "first_rows",
    "S08 L03",
    "select product_id, store_id, stock_levels from inventory order by stock_levels desc, product_id, store_id limit 5",
    "inventory",
)
def _(v):
    ordered = v.inventory.select(*KEYS, "stock_levels").orderBy(F.desc("stock_levels"), *KEYS)
    return sample_rows(ordered, 5)


@query(
    "report_counts",
    "B01 A02 S09",
    f"""select 'stockout_risk' as metric, count(*) as items from inventory where stock_levels < reorder_point
        union all select 'expiring_soon', count(*) from inventory where expiry_date <= date '{AS_OF}' + 30
        union all select 'low_capacity', count(*) from inventory where warehouse_capacity < 20""",
    "inventory",
)
def _(v):
    return monitor.inventory_report(v.inventory, AS_OF)


@query(
    "report_text",
    "S09",
    f"""select 'Stockout risk: ' || count(*) || ' items' as value from inventory where stock_levels < reorder_point
        union all select 'Expiring soon: ' || count(*) || ' items' from inventory where expiry_date <= date '{AS_OF}' + 30
        union all select 'Low warehouse capacity items: ' || count(*) from inventory where warehouse_capacity < 20""",
    "inventory",
)
def _(v):
    return monitor.report_lines(monitor.inventory_report(v.inventory, AS_OF))


@query("stockout_rows", "F01", f"select {INV} from inventory where stock_levels < reorder_point", "inventory")
def _(v):
    return monitor.stockouts(v.inventory)


@query("stockout_rows_inclusive", "F02", f"select {INV} from inventory where stock_levels <= reorder_point", "inventory")
def _(v):
    return monitor.stockouts(v.inventory, inclusive=True)


@query("expiring_rows", "F03", f"select {INV} from inventory where expiry_date <= date '{AS_OF}' + 30", "inventory")
def _(v):
    return monitor.expiring(v.inventory, AS_OF)


@query(
    "days_to_expiry_rows",
    "F04",
    f"""select product_id, store_id, datediff('day', date '{AS_OF}', expiry_date)::int as days_to_expiry
        from inventory where datediff('day', date '{AS_OF}', expiry_date) <= 30""",
    "inventory",
)
def _(v):
    from larder.functions.stock import days_to_expiry

    return v.inventory.select(*KEYS, days_to_expiry(F.col("expiry_date"), AS_OF).alias("days_to_expiry")).where("days_to_expiry <= 30")


@query("low_capacity_rows", "F05", f"select {INV} from inventory where warehouse_capacity < 20", "inventory")
def _(v):
    return monitor.low_capacity(v.inventory)


@query("low_capacity_rows_dashboard", "F05", f"select {INV} from inventory where warehouse_capacity < 10", "inventory")
def _(v):
    return monitor.low_capacity(v.inventory, monitor.KPI_CAPACITY)


STOCK_CLASS = """case when stock_levels = 0 then 'out_of_stock' when stock_levels > 0 and stock_levels < 10 then 'low_stock'
                      when stock_levels > 300 then 'overstock' else 'normal' end"""


@query("stock_status", "B08 F06", f"select {INV}, {STOCK_CLASS} as stock_class from inventory", "inventory")
def _(v):
    return monitor.stock_status(v.inventory)


@query("stock_class_counts", "F06", f"select {STOCK_CLASS} as stock_class, count(*) as items from inventory group by 1", "inventory")
def _(v):
    return monitor.stock_status(v.inventory).groupBy("stock_class").agg(F.count(F.lit(1)).alias("items"))


BALANCE = "case when stock_levels > reorder_point then 'Overstocked' else 'Understocked' end"


@query("balance_rows", "F07 U01", f"select {INV}, {BALANCE} as status from inventory where stock_levels <> reorder_point", "inventory")
def _(v):
    return monitor.balance_rows(v.inventory)


@query(
    "balance_shares",
    "A12",
    f"""select {BALANCE} as bucket, count(*) as items, count(*) * 100.0::double / sum(count(*)) over () as pct
        from inventory where stock_levels <> reorder_point group by 1""",
    "inventory",
)
def _(v):
    return monitor.balance_shares(v.inventory)


@query(
    "expiry_shares",
    "A12",
    f"""select case when expiry_date <= date '{AS_OF}' + 30 then 'Expiring Soon' else 'Not Expiring Soon' end as bucket,
               count(*) as items, count(*) * 100.0::double / sum(count(*)) over () as pct
        from inventory group by 1""",
    "inventory",
)
def _(v):
    return monitor.expiry_shares(v.inventory, AS_OF)


@query(
    "product_name_shares",
    "A12",
    """select p_name as bucket, count(*) as items, count(*) * 100.0::double / sum(count(*)) over () as pct
       from inventory join part on p_partkey = product_id group by 1""",
    "inventory",
)
def _(v):
    part = v.table("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"))
    return shares(v.inventory.join(part, "product_id"), F.col("product_name"))


@query(
    "dashboard_kpis",
    "B12 A02 F02 F04 F05",
    f"""select count(*) filter (stock_levels <= reorder_point) as stockout_risk,
               count(*) filter (expiry_date <= date '{AS_OF}' + 30) as expiring_soon,
               count(*) filter (warehouse_capacity < 10) as low_capacity from inventory""",
    "inventory",
)
def _(v):
    return monitor.kpis(v.inventory, as_of=AS_OF)


@query(
    "dashboard_kpis_one_key",
    "B12 F10",
    f"""select count(*) filter (stock_levels <= reorder_point) as stockout_risk,
               count(*) filter (expiry_date <= date '{AS_OF}' + 30) as expiring_soon,
               count(*) filter (warehouse_capacity < 10) as low_capacity
        from inventory where product_id = 33 and store_id = 3""",
    "inventory",
)
def _(v):
    return monitor.kpis(v.inventory, 33, 3, as_of=AS_OF)


@query("key_rows", "F10", f"select {INV} from inventory where product_id = 33 and store_id = 3", "inventory")
def _(v):
    return v.inventory.where("product_id = 33 and store_id = 3")


@query(
    "member_rows",
    "F08",
    f"select {INV} from inventory where product_id in (select l_partkey from lineitem where l_returnflag = 'R')",
    "inventory",
)
def _(v):
    returned = v.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("product_id"))
    return members(v.inventory, returned)


@query("member_list_rows", "F08", f"select {INV} from inventory where product_id in (3, 5, 8, 13, 21, 34)", "inventory")
def _(v):
    return members(v.inventory, [3, 5, 8, 13, 21, 34])


@query("id_pattern_rows", "F09", f"select {INV} from inventory where regexp_matches(cast(product_id as varchar), '1.*7$')", "inventory")
def _(v):
    return product_filter(v.inventory, "1.*7$")


@query(
    "id_literal_rows",
    "F09",
    f"select {INV} from inventory where contains(cast(product_id as varchar), '12') and contains(cast(store_id as varchar), '1')",
    "inventory",
)
def _(v):
    return reports.filter_reports(v.inventory, "12", "1")


@query(
    "valid_and_rejected_keys",
    "F14",
    "select case when c_custkey % 10 = 0 then 'empty store_id' else 'ok' end as reject_reason, count(*) as items from customer group by 1",
)
def _(v):
    rows = v.table("customer").select(
        F.col("c_custkey").alias("product_id"), F.when(F.col("c_custkey") % 10 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("store_id")
    )
    good, bad = split_rejects(rows)
    both = good.withColumn("reject_reason", F.lit("ok")).unionByName(bad)
    return both.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("items"))


@query("distinct_stores", "A03", "select distinct cast(store_id as varchar) as store_id from inventory", "inventory")
def _(v):
    return store_ids(v.inventory)


@query(
    "stock_maps",
    "A10",
    "select product_id, string_agg(store_id || '=' || stock_levels, ',' order by store_id) as cells from inventory group by product_id",
    "inventory",
)
def _(v):
    cells = F.transform(F.map_entries("stock"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return stock_maps(v.inventory).select("product_id", F.array_join(F.array_sort(cells), ",").alias("cells"))


_GAPS = """gaps as (select product_id, case when product_id % 7 = 0 then null when product_id % 11 = 0 then ' ' else store_id::varchar end as store_id,
    stock_levels, reorder_point from inventory), wants as (select product_id, case when product_id % 5 = 0 then null else store_id::varchar end as store_id,
    predicted_sales_quantity from forecast)"""


def _with_gaps(v):
    """Inventory and forecast some of whose store ids are null or blank."""
    p, s = F.col("product_id"), F.col("store_id").cast("string")
    stock = v.inventory.withColumn("store_id", F.when(p % 7 == 0, None).when(p % 11 == 0, " ").otherwise(s))
    return v.forecast.withColumn("store_id", F.when(p % 5 == 0, None).otherwise(s)), stock


@query(
    "suggestions_without_bad_keys",
    "F14 B02",
    f""", {_GAPS} select g.product_id::varchar as product_id, g.store_id, stock_levels from gaps g join wants w on g.product_id = w.product_id and g.store_id = w.store_id
       where trim(g.store_id) <> '' and stock_levels < greatest(reorder_point, predicted_sales_quantity)""",
    "inventory forecast",
)
def _(v):
    out = reorder.reorder_suggestions(*_with_gaps(v))
    return out.select(F.col("product_id").cast("string").alias("product_id"), "store_id", "stock_levels")


@query(
    "suggestion_rejects",
    "F14 B02",
    f""", {_GAPS} select 'inventory' as table_name, product_id::varchar as product_id, store_id, 'empty store_id' as reject_reason from gaps
         where store_id is null or trim(store_id) = ''
       union all select 'forecast', product_id::varchar, store_id, 'empty store_id' from wants where store_id is null""",
    "inventory forecast",
)
def _(v):
    return reorder.suggestion_rejects(*_with_gaps(v))


@query(
    "audit_without_bad_keys",
    "F14 B05",
    f""", {_GAPS} select g.product_id::varchar as product_id, g.store_id, abs(stock_levels - predicted_sales_quantity)::double as stock_gap
       from gaps g join wants w on g.product_id = w.product_id and g.store_id = w.store_id
       where trim(g.store_id) <> '' and abs(stock_levels - predicted_sales_quantity) > 20""",
    "inventory forecast",
)
def _(v):
    wants, stock = _with_gaps(v)
    out = pricing.audit(stock, wants)
    return out.select(F.col("product_id").cast("string").alias("product_id"), "store_id", F.col("stock_gap").cast("double").alias("stock_gap"))


@query(
    "stock_matrix",
    "A10",
    """select product_id, max(stock_levels) filter (store_id = 0)::double as store_0, max(stock_levels) filter (store_id = 1)::double as store_1,
              max(stock_levels) filter (store_id = 2)::double as store_2, max(stock_levels) filter (store_id = 3)::double as store_3,
              max(stock_levels) filter (store_id = 4)::double as store_4
       from inventory group by product_id""",
    "inventory",
)
def _(v):
    return _as_double(stock_matrix(v.inventory), *[f"store_{i}" for i in range(5)])


@query(
    "capacity_histogram",
    "A11",
    """, b as (select min(warehouse_capacity)::double as lo, max(warehouse_capacity)::double as hi from inventory),
       c as (select least(floor((warehouse_capacity - lo) * 10 / (hi - lo)), 9)::int as bin, count(*) as items
             from inventory, b group by 1)
       select r::int as bin, lo + r * (hi - lo) / 10 as bin_start, lo + (r + 1) * (hi - lo) / 10 as bin_end, coalesce(items, 0) as items
       from (select unnest(range(10)) as r) cross join b left join c on c.bin = r""",
    "inventory",
)
def _(v):
    return histogram(v.inventory, "warehouse_capacity", 10)


def _as_double(df, *columns):
    """Whole numbers that can be null, as doubles: both engines then show null alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# --- joins ---


@query(
    "inventory_forecast_join",
    "J01",
    """select product_id, store_id, stock_levels, predicted_sales_quantity from inventory join forecast using (product_id, store_id)""",
    "inventory forecast",
)
def _(v):
    return match(v.inventory, v.forecast).select(*KEYS, "stock_levels", "predicted_sales_quantity")


@query(
    "demand_inventory_join",
    "J02 P05",
    """select cast(product_id as varchar) as product_id, cast(store_id as varchar) as store_id, predicted_sales_quantity, reorder_point
       from forecast join inventory using (product_id, store_id)""",
    "inventory forecast",
)
def _(v):
    as_text = v.forecast.withColumns({k: F.col(k).cast("string") for k in KEYS})
    return match(as_text, v.inventory).select(*KEYS, "predicted_sales_quantity", "reorder_point")


@query(
    "join_with_store_match",
    "J03",
    "select product_id, store_id, predicted_sales_quantity, stock_levels from forecast join inventory using (product_id, store_id)",
    "inventory forecast",
)
def _(v):
    demand = v.forecast.select(*KEYS, "predicted_sales_quantity")
    return match_or_product(demand, v.inventory.select(*KEYS, "stock_levels"))


@query(
    "join_product_fallback",
    "J03",
    """select product_id, i.store_id, predicted_sales_quantity, stock_levels
       from (select product_id, sum(predicted_sales_quantity) as predicted_sales_quantity from forecast group by 1) f
            join inventory i using (product_id)""",
    "inventory forecast",
)
def _(v):
    central = v.forecast.groupBy("product_id").agg(F.sum("predicted_sales_quantity").alias("predicted_sales_quantity"))
    demand = central.withColumn("store_id", F.lit(-1))
    return match_or_product(demand, v.inventory.select(*KEYS, "stock_levels"))


@query(
    "suffixed_join",
    "J04 P01 P02",
    """select product_id, store_id, p.price as price_pricing, competitor_prices, sales_volume, predicted_sales_quantity, f.price as price_forecast
       from pricing p join forecast f using (product_id, store_id)""",
    "pricing forecast",
)
def _(v):
    return match_suffixed(v.pricing, v.forecast, ("_pricing", "_forecast"))


@query(
    "attached_predictions",
    "P09",
    "select product_id, store_id, stock_levels, predicted_sales_quantity from inventory join forecast using (product_id, store_id)",
    "inventory forecast",
)
def _(v):
    return attach_predictions(v.inventory.select(*KEYS, "stock_levels"), v.forecast.select(*KEYS, "predicted_sales_quantity"))


@query(
    "store_backfill",
    "P08",
    """select product_id, case when (select count(distinct store_id) from inventory) = 1
              then (select cast(min(store_id) as varchar) from inventory) else 'DEFAULT_STORE' end as store_id, predicted
       from (select product_id, sum(predicted_sales_quantity) as predicted from forecast group by 1)""",
    "inventory forecast",
)
def _(v):
    central = v.forecast.groupBy("product_id").agg(F.sum("predicted_sales_quantity").alias("predicted"))
    return backfill_store(central, v.inventory)


@query(
    "store_backfill_single",
    "P08",
    """select product_id, case when (select count(distinct store_id) from inventory where store_id = (select max(store_id) from inventory)) = 1
              then (select cast(max(store_id) as varchar) from inventory) else 'DEFAULT_STORE' end as store_id, predicted
       from (select product_id, sum(predicted_sales_quantity) as predicted from forecast group by 1)""",
    "inventory forecast",
)
def _(v):
    central = v.forecast.groupBy("product_id").agg(F.sum("predicted_sales_quantity").alias("predicted"))
    last = v.inventory.agg(F.max("store_id").alias("store_id"))
    return backfill_store(central, v.inventory.join(last, "store_id", "left_semi"))


@query(
    "forecast_shape",
    "P12 E08",
    "select product_id, store_id, predicted_sales_quantity as predicted_demand from forecast",
    "forecast",
)
def _(v):
    return normal_forecast(v.forecast)


@query(
    "picked_demand",
    "E08",
    """select product_id, store_id, case when psq is null then null when psq <> 0 then psq else pd end as picked
       from (select product_id, store_id, case when product_id % 3 = 0 then 0 when product_id % 5 = 0 then null else predicted_sales_quantity end as psq,
                    predicted_sales_quantity + 1 as pd from forecast)""",
    "forecast",
)
def _(v):
    q = F.col("predicted_sales_quantity")
    rows = v.forecast.select(
        *KEYS,
        F.when(F.col("product_id") % 3 == 0, 0.0).when(F.col("product_id") % 5 == 0, None).otherwise(q).alias("predicted_sales_quantity"),
        (q + 1).alias("predicted_demand"),
    )
    return rows.select(*KEYS, picked_demand(rows.columns).alias("picked"))


# --- projections ---


@query("column_subset", "P03 P04", "select product_id, store_id, predicted_sales_quantity from forecast", "forecast")
def _(v):
    return v.forecast.drop("price")


@query("projection_inventory", "P11", "select product_id, stock_levels from inventory", "inventory")
def _(v):
    return reports.projection(v.inventory, "inventory")


@query(
    "projection_forecast",
    "P11 E20",
    """select product_id, predicted_sales_quantity as prediction, predicted_sales_quantity * 0.9::double as pred_lower,
              predicted_sales_quantity * 1.1::double as pred_upper from forecast""",
    "forecast",
)
def _(v):
    return reports.projection(reports.with_bounds(v.forecast.withColumnRenamed("predicted_sales_quantity", "prediction")), "forecast")


@query("projection_pricing", "P11", "select product_id, price, competitor_prices from pricing", "pricing")
def _(v):
    return reports.projection(v.pricing, "pricing")


@query(
    "demo_reorder_point",
    "P13",
    "select product_id, store_id, predicted_sales_quantity as prediction, predicted_sales_quantity * 0.9::double as reorder_point from forecast",
    "forecast",
)
def _(v):
    rows = v.forecast.select(*KEYS, F.col("predicted_sales_quantity").alias("prediction"))
    return reorder.with_demo_reorder_point(rows)


@query(
    "tagged_rows",
    "P10",
    f"select product_id, store_id, 'Auto-Reordered' as status, '{AS_OF_TIME}' as processed_at from inventory where stock_levels < reorder_point",
    "inventory",
)
def _(v):
    return tag(monitor.stockouts(v.inventory).select(*KEYS), status="Auto-Reordered", processed_at=stamped(AS_OF_TIME))


# --- reorder ---

SUGGESTED = """suggestions as (
    select product_id, store_id, stock_levels, predicted_sales_quantity as predicted_demand, lead_time_days,
           cast(trunc(predicted_sales_quantity * 0.2::double) as bigint) as safety_stock,
           cast(trunc(greatest(0.0::double, predicted_sales_quantity + predicted_sales_quantity * 0.2::double - stock_levels)) as bigint) as reorder_qty
    from forecast join inventory using (product_id, store_id)
    where stock_levels < reorder_point or stock_levels < predicted_sales_quantity)"""


def _suggestions(v):
    return reorder.reorder_suggestions(v.forecast, v.inventory)


@query("reorder_suggestions", "B02 E06 E07 F12 F14 J02 J03 L01", f"+{SUGGESTED} select * from suggestions", "inventory forecast")
def _(v):
    return reorder.by_urgency(_suggestions(v))


@query(
    "most_urgent",
    "L01 L03",
    f"+{SUGGESTED} select * from suggestions order by stock_levels, product_id, store_id limit 20",
    "inventory forecast",
)
def _(v):
    return top_n(_suggestions(v), [F.col("stock_levels"), *map(F.col, KEYS)], 20)


@query(
    "reorder_gate",
    "F12",
    """select product_id, store_id from forecast join inventory using (product_id, store_id)
       where stock_levels < reorder_point or stock_levels < predicted_sales_quantity""",
    "inventory forecast",
)
def _(v):
    from larder.functions.stock import needs_reorder

    rows = match(v.forecast, v.inventory)
    return rows.where(needs_reorder(F.col("stock_levels"), F.col("reorder_point"), F.col("predicted_sales_quantity"))).select(*KEYS)


@query(
    "order_quantities",
    "E06 E07",
    """select product_id, store_id,
              cast(trunc(greatest(0.0::double, predicted_sales_quantity + predicted_sales_quantity * 0.2::double - stock_levels)) as bigint) as reorder_qty,
              cast(trunc(predicted_sales_quantity * 0.2::double) as bigint) as safety_stock
       from forecast join inventory using (product_id, store_id)""",
    "inventory forecast",
)
def _(v):
    d = F.col("predicted_sales_quantity")
    rows = match(v.forecast, v.inventory)
    return rows.select(*KEYS, reorder_qty(d, F.col("stock_levels")).alias("reorder_qty"), safety_stock(d).alias("safety_stock"))


@query(
    "reorder_points",
    "E09",
    """select product_id, store_id, greatest(lead_time_days - 5, 0) * greatest(stock_levels % 20 - 4, 0) + greatest(warehouse_capacity - 100, 0) as computed
       from inventory""",
    "inventory",
)
def _(v):
    rows = v.inventory
    point = reorder_point(F.col("lead_time_days") - 5, F.col("stock_levels") % 20 - 4, F.col("warehouse_capacity") - 100)
    return rows.select(*KEYS, point.alias("computed"))


@query(
    "reorder_plan",
    "B09",
    """select product_id, store_id, stock_levels, reorder_point, predicted_sales_quantity as predicted_demand,
              predicted_sales_quantity - stock_levels + 10 as recommended_qty
       from forecast join inventory using (product_id, store_id) where stock_levels < reorder_point""",
    "inventory forecast",
)
def _(v):
    return reorder.reorder_plan(v.forecast, v.inventory)


@query(
    "demand_gap_orders",
    "B10",
    """select product_id, store_id, stock_levels, predicted_sales_quantity as predicted_demand, lead_time_days,
              cast(trunc(predicted_sales_quantity - stock_levels) as bigint) as reorder_qty
       from forecast join inventory using (product_id, store_id) where stock_levels < predicted_sales_quantity""",
    "inventory forecast",
)
def _(v):
    return reorder.demand_gap_orders(v.forecast, v.inventory)


# Orders for a slice of keys that inventory does not hold come from the forecast side.
ORDERS = f"""{SUGGESTED}, orders_in as (
    select product_id, store_id, reorder_qty from suggestions
    union all select product_id, store_id, 7 from suggestions where product_id % 4 = 0
    union all select product_id, store_id + 100, 5 from suggestions where product_id % 9 = 0)"""


def _orders(v):
    s = _suggestions(v).select(*KEYS, "reorder_qty")
    again = s.where("product_id % 4 = 0").withColumn("reorder_qty", F.lit(7).cast("long"))
    unknown = s.where("product_id % 9 = 0").select(
        "product_id", (F.col("store_id") + 100).alias("store_id"), F.lit(5).cast("long").alias("reorder_qty")
    )
    return s.unionByName(again).unionByName(unknown)


@query(
    "applied_stock",
    "B03 J05",
    f"""+{ORDERS}, totals as (select product_id, store_id, sum(reorder_qty) as qty from orders_in group by all)
        select product_id, store_id, cast(stock_levels + coalesce(qty, 0) as bigint) as stock_levels, reorder_point
        from inventory left join totals using (product_id, store_id)""",
    "inventory forecast",
)
def _(v):
    updated, _, _ = reorder.apply_reorders(_orders(v), v.inventory, AS_OF_TIME)
    return updated.select(*KEYS, "stock_levels", "reorder_point")


@query(
    "processed_reorders",
    "B03 J06 P10",
    f"""+{ORDERS} select product_id, store_id, cast(reorder_qty as bigint) as reorder_qty, 'Auto-Reordered' as status, '{AS_OF_TIME}' as processed_at
        from orders_in semi join inventory using (product_id, store_id)""",
    "inventory forecast",
)
def _(v):
    return reorder.apply_reorders(_orders(v), v.inventory, AS_OF_TIME)[1]


@query(
    "rejected_reorders",
    "B03 J07",
    f"""+{ORDERS} select product_id, store_id, cast(reorder_qty as bigint) as reorder_qty
        from orders_in anti join inventory using (product_id, store_id)""",
    "inventory forecast",
)
def _(v):
    return reorder.apply_reorders(_orders(v), v.inventory, AS_OF_TIME)[2]


@query(
    "reorder_log",
    "B11 U02 P02 P10 S04",
    f"""+{SUGGESTED}
        select product_id, store_id, null::double as stock_levels, null::double as predicted_demand, null::double as lead_time_days,
               null::double as safety_stock, cast(reorder_qty as bigint) as reorder_qty, '2024-06-01 00:00:00' as triggered_at, null::varchar as triggered_by
        from suggestions where product_id % 2 = 0
        union all
        select product_id, store_id, stock_levels, predicted_demand, lead_time_days, safety_stock, reorder_qty, '{AS_OF_TIME}', 'Auto-System' from suggestions""",
    "inventory forecast",
)
def _(v):
    s = _suggestions(v)
    before = s.where("product_id % 2 = 0").select(*KEYS, "reorder_qty", F.lit("2024-06-01 00:00:00").alias("triggered_at"))
    return _as_double(reorder.reorder_log(s, AS_OF_TIME, before), "stock_levels", "lead_time_days", "safety_stock")


# --- redistribution ---

PAIRS = """pairs as (
    select o.product_id, o.store_id as donor, u.store_id as receiver, least(o.stock_levels - o.reorder_point, u.reorder_point - u.stock_levels) as units
    from inventory o join inventory u using (product_id)
    where o.stock_levels > o.reorder_point and u.stock_levels < u.reorder_point)"""


@query(
    "redistributed_stock",
    "B04 J08 F07",
    f"""+{PAIRS}, g as (select product_id, donor as store_id, sum(units) as given, count(*) as n from pairs group by all),
              t as (select product_id, receiver as store_id, sum(units) as taken, count(*) as n from pairs group by all)
        select product_id, store_id, stock_levels, reorder_point, cast(coalesce(given, 0) as bigint) as units_given,
               cast(coalesce(taken, 0) as bigint) as units_taken, coalesce(g.n, t.n, 0) as partners,
               cast(stock_levels - coalesce(given, 0) + coalesce(taken, 0) as bigint) as new_stock_levels
        from inventory left join g using (product_id, store_id) left join t using (product_id, store_id)""",
    "inventory",
)
def _(v):
    rows = v.inventory.select(*KEYS, "stock_levels", "reorder_point")
    return redistribution(rows)


@query(
    "redistributed_inventory",
    "B04 S05",
    f"""+{PAIRS}, moves as (select product_id, donor as store_id, -units as units from pairs
                            union all select product_id, receiver, units from pairs),
              m as (select product_id, store_id, sum(units) as units from moves group by all)
        select product_id, store_id, cast(stock_levels + coalesce(units, 0) as bigint) as stock_levels, reorder_point
        from inventory left join m using (product_id, store_id)""",
    "inventory",
)
def _(v):
    return redistributed_inventory(v.inventory.select(*KEYS, "stock_levels", "reorder_point"))


@query(
    "transfer_summary",
    "J08 B04",
    f"""+{PAIRS} select product_id, count(distinct donor) as donors, count(distinct receiver) as receivers,
                        cast(sum(units) as bigint) as units_moved, count(*) as pairs from pairs group by 1""",
    "inventory",
)
def _(v):
    return transfer_summary(v.inventory)


# --- audit, pricing, impact ---


@query(
    "audit_mismatches",
    "B05 E05 J01 P10",
    """select product_id, store_id, stock_levels, predicted_sales_quantity, abs(stock_levels - predicted_sales_quantity) as stock_gap, 'Mismatch' as flag
       from inventory join forecast using (product_id, store_id) where abs(stock_levels - predicted_sales_quantity) > 20""",
    "inventory forecast",
)
def _(v):
    return pricing.audit(v.inventory.select(*KEYS, "stock_levels"), v.forecast.drop("price"))


@query(
    "stock_gaps",
    "E05",
    "select product_id, store_id, abs(stock_levels - predicted_sales_quantity) as gap from inventory join forecast using (product_id, store_id)",
    "inventory forecast",
)
def _(v):
    rows = match(v.inventory, v.forecast)
    return rows.select(*KEYS, stock_gap(F.col("stock_levels"), F.col("predicted_sales_quantity")).alias("gap"))


@query("price_ratios", "E01", "select product_id, store_id, price / sales_volume as price_to_sales from pricing", "pricing")
def _(v):
    return pricing.with_price_ratio(v.pricing).select(*KEYS, "price_to_sales")


@query(
    "ratio_edge_cases",
    "E01",
    """select product_id, store_id, case when d <> 0 then n / d when n > 0 then 'infinity'::double when n < 0 then '-infinity'::double end as ratio
       from (select product_id, store_id, (stock_levels - 200)::double as n, (stock_levels % 10)::double as d from inventory)""",
    "inventory",
)
def _(v):
    return v.inventory.select(*KEYS, safe_ratio(F.col("stock_levels") - 200, F.col("stock_levels") % 10).alias("ratio"))


FLAGGED = """select product_id, store_id, price, sales_volume, competitor_prices, price / sales_volume as price_to_sales{status}
             from pricing where price / sales_volume {test}"""


@query(
    "price_flags",
    "B06 F13 U01",
    FLAGGED.format(test="> 1.5::double", status=", 'Overpriced' as status")
    + " union all "
    + FLAGGED.format(test="< 0.5::double", status=", 'Underpriced'"),
    "pricing",
)
def _(v):
    return pricing.price_flags(v.pricing)


@query("overpriced", "B06 F13", FLAGGED.format(test="> 1.5::double", status=""), "pricing")
def _(v):
    return pricing.overpriced(v.pricing)


@query("underpriced", "B06 F13", FLAGGED.format(test="< 0.5::double", status=""), "pricing")
def _(v):
    return pricing.underpriced(v.pricing)


@query(
    "labelled_union",
    "U01",
    """select product_id, store_id, stock_levels, 'over' as status from inventory where stock_levels > reorder_point
       union all select product_id, store_id, stock_levels, 'under' from inventory where stock_levels < reorder_point""",
    "inventory",
)
def _(v):
    rows = v.inventory.select(*KEYS, "stock_levels", "reorder_point")
    over, under = rows.where("stock_levels > reorder_point"), rows.where("stock_levels < reorder_point")
    return pricing.labelled_union({"over": over.drop("reorder_point"), "under": under.drop("reorder_point")})


IMPACT = """select product_id, store_id, p.price as price_pricing, competitor_prices, sales_volume, predicted_sales_quantity, f.price as price_forecast,
                   (p.price - competitor_prices) / competitor_prices * 100.0::double as price_change_pct,
                   (sales_volume - predicted_sales_quantity) / predicted_sales_quantity * 100.0::double as sales_lift_pct
            from pricing p join forecast f using (product_id, store_id)"""


@query(
    "sales_impact",
    "B07 E02 E03 E04 J04",
    f"""select *, case when sales_lift_pct > 10 then 'Effective' when sales_lift_pct < -10 then 'Ineffective' else 'Neutral' end as impact from ({IMPACT})""",
    "pricing forecast",
)
def _(v):
    return pricing.sales_impact(v.pricing, v.forecast)


@query(
    "impact_counts",
    "E04",
    f"""select case when sales_lift_pct > 10 then 'Effective' when sales_lift_pct < -10 then 'Ineffective' else 'Neutral' end as impact, count(*) as items
        from ({IMPACT}) group by 1""",
    "pricing forecast",
)
def _(v):
    return pricing.sales_impact(v.pricing, v.forecast).groupBy("impact").agg(F.count(F.lit(1)).alias("items"))


@query(
    "price_changes",
    "E02",
    "select product_id, store_id, (price - competitor_prices) / competitor_prices * 100.0::double as price_change_pct from pricing",
    "pricing",
)
def _(v):
    return v.pricing.select(*KEYS, pct_change(F.col("price"), F.col("competitor_prices")).alias("price_change_pct"))


# --- chart tables and texts ---


@query(
    "stock_bars",
    "B14 L03",
    "select product_id, store_id, stock_levels, reorder_point from inventory order by product_id, store_id limit 20",
    "inventory",
)
def _(v):
    return reports.stock_bars(v.inventory)


@query(
    "price_points",
    "B14",
    "select product_id, store_id, price as price_before, competitor_prices as price_after, sales_volume from pricing",
    "pricing",
)
def _(v):
    return reports.price_points(v.pricing)


@query(
    "stock_trend",
    "B14",
    "select cast(expiry_date as varchar) as date, product_id, stock_levels from inventory",
    "inventory",
)
def _(v):
    return reports.stock_trend(v.inventory, "expiry_date")


TEXTS = "(select text from documents union all select text from conversations union all select o_orderpriority from orders union all select html from pages)"
INTENT = """case when contains(lower(text), 'understock') then 'understocked' when contains(lower(text), 'reorder') then 'reorder'
                 when contains(lower(text), 'forecast') or contains(lower(text), 'demand') then 'forecast' else 'unknown' end"""


def _texts(v):
    parts = [v.table("documents").select("text"), v.table("conversations").select("text")]
    parts += [v.table("orders").select(F.col("o_orderpriority").alias("text")), v.table("pages").select(F.col("html").alias("text"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("intent_counts", "E22", f"select {INTENT} as intent, count(*) as texts from {TEXTS} group by 1")
def _(v):
    return reports.intent_counts(_texts(v))


REQUEST = """case product_id % 6 when 0 then 'Show UNDERSTOCKED items of ' when 1 then 'reorder plan for ' when 2 then 'Demand next week: '
                  when 3 then 'forecast or reorder? ' when 4 then 'understock reorder ' else 'hello ' end || cast(product_id as varchar)"""


@query("request_intents", "E22", f"select product_id, store_id, {INTENT} as intent from (select product_id, store_id, {REQUEST} as text from inventory)", "inventory")
def _(v):
    heads = ["Show UNDERSTOCKED items of ", "reorder plan for ", "Demand next week: ", "forecast or reorder? ", "understock reorder ", "hello "]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("product_id") % 6 + 1).cast("int"))
    rows = v.inventory.select(*KEYS, F.concat(head, F.col("product_id").cast("string")).alias("text"))
    return reports.intents(rows).drop("text")


def _section(title: str, source: str, order: str, fields: list[str]) -> str:
    record = "concat_ws(', ', " + ", ".join(f"'{c}: ' || cast({c} as varchar)" for c in fields) + ")"
    return f"""select '{title}' as section, '### {title} ###' || chr(10) || string_agg(n || '. ' || record, chr(10) order by n) as digest
               from (select row_number() over (order by {order}) as n, {record} as record from {source} qualify n <= 5)"""


@query(
    "report_digest",
    "E23 L03",
    "+"
    + SUGGESTED
    + ", under as (select product_id, store_id, stock_levels, reorder_point from inventory where stock_levels < reorder_point)"
    + ", gaps as (select product_id, store_id, case when product_id % 2 = 0 then stock_levels end as even_stock from inventory) "
    + " union all ".join(
        [
            _section("Reorder Suggestions", "suggestions", "stock_levels, product_id, store_id", ["stock_levels", "product_id", "store_id", "predicted_demand", "safety_stock", "reorder_qty"]),
            _section("Demand Forecasts", "forecast", "product_id, store_id", ["product_id", "store_id", "predicted_sales_quantity"]),
            _section("Understocked Products", "under", "product_id, store_id", ["product_id", "store_id", "stock_levels", "reorder_point"]),
            _section("Even Products", "gaps", "product_id, store_id", ["product_id", "store_id", "even_stock"]),
        ]
    ),
    "inventory forecast",
)
def _(v):
    s = _suggestions(v).select("stock_levels", *KEYS, "predicted_demand", "safety_stock", "reorder_qty")
    even = v.inventory.select(*KEYS, F.when(F.col("product_id") % 2 == 0, F.col("stock_levels")).alias("even_stock"))
    return reports.digest(
        {
            "Reorder Suggestions": (s, ["stock_levels", *KEYS]),
            "Demand Forecasts": (v.forecast.select(*KEYS, "predicted_sales_quantity"), KEYS),
            "Understocked Products": (monitor.stockouts(v.inventory).select(*KEYS, "stock_levels", "reorder_point"), KEYS),
            "Even Products": (even, KEYS),
        }
    )


# --- stock movements ---

def _ledger(movements: str, opening: str) -> str:
    return f"""numbered as (
    select m.*, o.stock_levels as first_level, row_number() over (partition by m.product_id, m.store_id order by ts, event_id) as n
    from {movements} m join {opening} o using (product_id, store_id) where tx_type in ('SALE', 'RESTOCK')),
  walk as (
    select event_id, product_id, store_id, qty, tx_type, n, tx_type = 'RESTOCK' or qty <= first_level as accepted,
           case when tx_type = 'RESTOCK' then first_level + qty when qty <= first_level then first_level - qty else first_level end as stock_after
    from numbered where n = 1
    union all
    select x.event_id, x.product_id, x.store_id, x.qty, x.tx_type, x.n, x.tx_type = 'RESTOCK' or x.qty <= w.stock_after,
           case when x.tx_type = 'RESTOCK' then w.stock_after + x.qty when x.qty <= w.stock_after then w.stock_after - x.qty else w.stock_after end
    from walk w join numbered x on x.product_id = w.product_id and x.store_id = w.store_id and x.n = w.n + 1)"""


def _log_sql(movements: str, opening: str) -> str:
    return f"""+{_ledger(movements, opening)}
        select event_id, product_id, store_id, qty, tx_type, accepted, case when not accepted then 'not enough stock' end as reason, stock_after::double as stock_after from walk
        union all
        select event_id, product_id, store_id, qty, tx_type, false,
               case when tx_type in ('SALE', 'RESTOCK') then 'unknown product and store' else 'unknown type' end, stock_levels::double
        from {movements} left join {opening} using (product_id, store_id) where tx_type not in ('SALE', 'RESTOCK') or stock_levels is null"""


@query("movement_log", "T01 T02 T03", _log_sql("movements", "opening"), "movements opening", recursive=True)
def _(v):
    return _as_double(settle(v.movements, v.opening).drop("ts"), "stock_after")


@query("hot_key_log", "T01 T02", _log_sql("hot_movements", "hot_opening"), "hot_movements hot_opening", recursive=True)
def _(v):
    """Few keys, whose movements span several ranges each."""
    return _as_double(settle(v.hot_movements, v.hot_opening, ranges=24).drop("ts"), "stock_after")


@query(
    "closing_stock",
    "T01 T02",
    f"""+{_ledger("movements", "opening")}, net as (select product_id, store_id, sum(case when tx_type = 'SALE' then -qty else qty end) as d from walk where accepted group by all)
        select product_id, store_id, cast(stock_levels + coalesce(d, 0) as bigint) as stock_levels from opening left join net using (product_id, store_id)""",
    "movements opening",
    recursive=True,
)
def _(v):
    return closing_stock(v.opening, settle(v.movements, v.opening))


@query(
    "adjusted_stock",
    "T05 J05",
    """, net as (select product_id, store_id, sum(case when tx_type = 'SALE' then -qty else qty end) as d from movements group by all)
       select product_id, store_id, cast(stock_levels + coalesce(d, 0) as bigint) as stock_levels from opening left join net using (product_id, store_id)""",
    "movements opening",
)
def _(v):
    return adjust(v.opening, _signed(v))[0]


@query(
    "rejected_adjustments",
    "T05",
    """select event_id, product_id, store_id, case when tx_type = 'SALE' then -qty else qty end as amount
       from movements anti join opening using (product_id, store_id)""",
    "movements opening",
)
def _(v):
    return adjust(v.opening, _signed(v))[1]


def _signed(v):
    return v.movements.select("event_id", *KEYS, F.when(F.col("tx_type") == "SALE", -F.col("qty")).otherwise(F.col("qty")).alias("amount"))
