"""Schemas of records and of the inputs that the example jobs take."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    ]
)
SENSOR = "sensor_id string, location string, device_type string, timestamp bigint, temperature double, humidity double, pressure double, battery_level double, is_anomaly boolean"
SHOP = (
    "event_id string, timestamp bigint, user_id string, event_type string, product_id string, product_name string, category string, "
    "price double, quantity int, session_id string, cart_size int, total_value double"
)
TICK = (
    "timestamp bigint, symbol string, price double, bid double, ask double, volume bigint, daily_volume bigint, daily_high double, daily_low double, exchange string"
)
WEATHER = "sensor_id string, temperature double, humidity double, wind_speed double, condition string, is_anomaly boolean, timestamp string, source string"
CLICK = "user_id string, ad_id string, timestamp bigint"
BENCHMARK = "id bigint, value bigint, timestamp bigint"
