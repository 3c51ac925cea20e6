"""Column types of the three inputs."""

from pyspark.sql import types as T

PANEL = T.StructType(
    [
        T.StructField("sku", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("sold_quantity", T.DoubleType()),
        T.StructField("minutes_active", T.DoubleType()),
        T.StructField("current_price", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("listing_type", T.StringType()),
        T.StructField("shipping_payment", T.StringType()),
        T.StructField("shipping_logistic_type", T.StringType()),
    ]
)

ITEM_META = T.StructType(
    [
        T.StructField("sku", T.LongType()),
        T.StructField("item_domain_id", T.StringType()),
        T.StructField("site_id", T.StringType()),
    ]
)

SCORE_ITEMS = T.StructType(
    [
        T.StructField("sku", T.LongType()),
        T.StructField("target_stock", T.DoubleType()),
    ]
)
