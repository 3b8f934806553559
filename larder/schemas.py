"""Declared schemas of the datasets, and the CSV headings they come from."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
DOUBLE, DATE, TIMESTAMP = T.DoubleType(), T.DateType(), T.TimestampType()

KEYS = ["product_id", "store_id"]


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


INVENTORY = _schema(
    ("product_id", STRING),
    ("store_id", STRING),
    ("stock_levels", LONG),
    ("lead_time_days", INT),
    ("stockout_frequency", INT),
    ("reorder_point", LONG),
    ("expiry_date", DATE),
    ("warehouse_capacity", LONG),
    ("fulfillment_days", INT),
)

DEMAND = _schema(
    ("product_id", STRING),
    ("store_id", STRING),
    ("date", DATE),
    ("sales_quantity", DOUBLE),
    ("price", DOUBLE),
    ("promotions", STRING),
    ("seasonality_factors", STRING),
    ("external_factors", STRING),
    ("demand_trend", STRING),
    ("customer_segments", STRING),
)

PRICING = _schema(
    ("product_id", STRING),
    ("store_id", STRING),
    ("price", DOUBLE),
    ("competitor_prices", DOUBLE),
    ("discounts", DOUBLE),
    ("sales_volume", DOUBLE),
    ("customer_reviews", DOUBLE),
    ("return_rate_pct", DOUBLE),
    ("storage_cost", DOUBLE),
    ("elasticity_index", DOUBLE),
)

FORECAST = _schema(
    ("product_id", STRING),
    ("store_id", STRING),
    ("date", DATE),
    ("predicted_demand", DOUBLE),
    ("pred_lower", DOUBLE),
    ("pred_upper", DOUBLE),
)

SUGGESTIONS = _schema(
    ("product_id", STRING),
    ("store_id", STRING),
    ("stock_levels", LONG),
    ("predicted_demand", DOUBLE),
    ("lead_time_days", INT),
    ("safety_stock", LONG),
    ("reorder_qty", LONG),
)

MOVEMENTS = _schema(
    ("event_id", LONG),
    ("ts", TIMESTAMP),
    ("product_id", STRING),
    ("store_id", STRING),
    ("qty", LONG),
    ("tx_type", STRING),
)

MOVEMENT_LOG = T.StructType(
    MOVEMENTS.fields
    + [
        T.StructField("accepted", T.BooleanType(), True),
        T.StructField("reason", STRING, True),
        T.StructField("stock_after", LONG, True),
    ]
)

# CSV headings and the column each becomes.
HEADINGS = {
    "Product ID": "product_id",
    "Store ID": "store_id",
    "Stock Levels": "stock_levels",
    "Reorder Point": "reorder_point",
    "Supplier Lead Time (days)": "lead_time_days",
    "Stockout Frequency": "stockout_frequency",
    "Expiry Date": "expiry_date",
    "Warehouse Capacity": "warehouse_capacity",
    "Order Fulfillment Time (days)": "fulfillment_days",
    "Product Name": "product_name",
    "Days to Expiry": "days_to_expiry",
    "Date": "date",
    "Sales Quantity": "sales_quantity",
    "Price": "price",
    "Promotions": "promotions",
    "Seasonality Factors": "seasonality_factors",
    "External Factors": "external_factors",
    "Demand Trend": "demand_trend",
    "Customer Segments": "customer_segments",
    "Promotion Budget": "promotion_budget",
    "Promotion Days": "promotion_days",
    "Weather Index": "weather_index",
    "Economic Index": "economic_index",
    "Unit Price": "unit_price",
    "Competitor Prices": "competitor_prices",
    "Discounts": "discounts",
    "Sales Volume": "sales_volume",
    "Customer Reviews": "customer_reviews",
    "Return Rate (%)": "return_rate_pct",
    "Storage Cost": "storage_cost",
    "Elasticity Index": "elasticity_index",
    "Predicted Sales Quantity": "predicted_sales_quantity",
    "Predicted Demand": "predicted_demand",
    "Reorder Quantity": "reorder_qty",
    "Suggested Reorder Qty": "reorder_qty",
}
