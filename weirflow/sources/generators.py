"""Generated inputs: sensors, a shop and a market.

All draws come from MD5 of a seed, a name and the row's number, so rows repeat on
any cluster and in any order, and other engines can make the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators import state
from weirflow.operators.aggregates import running

START_MS = 1_704_067_200_000

#: Kinds of sensors, and the ranges of their readings.
DEVICES = ["DHT22", "BME280", "SHT31"]
NORMAL_TEMPERATURE, SWING, SWING_STEPS, TEMPERATURE_NOISE = 22.0, 3.0, 600, 0.5
NORMAL_HUMIDITY, HUMIDITY_NOISE, NORMAL_PRESSURE, PRESSURE_NOISE, FAILURE = 50.0, 5.0, 1013.0, 2.0, -999.9
HOT, DRY, COLD, DAMP = (40.0, 60.0), (10.0, 30.0), (-10.0, 5.0), (80.0, 95.0)
BATTERY_STEPS = 10_000
#: Weights of shop events, and the products (name, price, category).
SHOP_EVENTS = {"page_view": 50, "add_to_cart": 20, "remove_from_cart": 3, "purchase": 8, "search": 19}
PRODUCTS = [
    ("Laptop", 999.99, "Electronics"), ("Wireless Mouse", 29.99, "Electronics"), ("Mechanical Keyboard", 79.99, "Electronics"), ("4K Monitor", 299.99, "Electronics"),
    ("Noise-Cancelling Headphones", 149.99, "Audio"), ("Smartphone", 699.99, "Electronics"), ("Tablet", 399.99, "Electronics"), ("Webcam", 59.99, "Electronics"),
    ("USB-C Hub", 39.99, "Accessories"), ("Desk Lamp", 45.99, "Furniture"),
]
#: First price, volatility and drift of each symbol.
SYMBOLS = {
    "AAPL": (178.0, 0.015, 0.0001), "GOOGL": (141.0, 0.018, 0.00005), "MSFT": (378.0, 0.016, 0.00008), "AMZN": (146.0, 0.020, 0.00003),
    "TSLA": (242.0, 0.035, -0.00002), "NVDA": (496.0, 0.025, 0.00015), "META": (328.0, 0.022, 0.00006), "NFLX": (367.0, 0.024, -0.00001),
}
FLOOR, SPREAD, SPIKE_EVERY, SPIKE_LENGTH = 1.0, 0.0005, 100, 10


def uniform(name: str, number: Column, seed: int) -> Column:
    """A number from 0 to 1 (1 left out) in steps of 2^-48."""
    digest = F.md5(F.encode(F.concat(F.lit(f"{seed}:{name}:"), number.cast("string")), "UTF-8"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def gauss(name: str, number: Column, seed: int) -> Column:
    """About a standard normal number: twelve uniform ones less six, which is exact in binary."""
    total = uniform(f"{name}0", number, seed)
    for k in range(1, 12):
        total = total + uniform(f"{name}{k}", number, seed)
    return total - 6.0


def rounded(value: Column, digits: int) -> Column:
    """Rounding of the double times a power of ten, halves away from zero, as ``round`` does in the SQL of the catalogue.

    Spark's ``round`` goes by the shortest decimal text: a difference of
    61.449999999999996 goes down to 61.4, where ten times it is 614.5 and goes up.
    """
    scaled = F.abs(value) * F.lit(10.0**digits)
    whole = F.floor(scaled).cast("double")
    return F.signum(value) * F.when(scaled - whole >= 0.5, whole + 1).otherwise(whole) / F.lit(10.0**digits)


def _pick(values: list[str], share: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(share * len(values)) + 1).cast("int"))


def sensors(spark: SparkSession, rows: int, count: int = 20, anomaly_rate: float = 0.02, per_second: float = 2, seed: int = 42, start_ms: int = START_MS) -> DataFrame:
    """Readings of ``count`` sensors in turn, all of a round at one time: a swing with noise; anomalies are hot and dry, cold and damp, or a failure."""
    n = F.col("id")
    sensor, step = F.pmod(n, F.lit(count)), F.floor(n / count) + 1
    between = lambda name, span: F.lit(span[0]) + uniform(name, n, seed) * F.lit(span[1] - span[0])
    kind = F.floor(uniform("kind", n, seed) * 3)
    odd = uniform("odd", n, seed) < anomaly_rate
    bad = lambda hot, cold: F.when(kind == 0, hot).when(kind == 1, cold).otherwise(F.lit(FAILURE))
    temperature = F.lit(NORMAL_TEMPERATURE) + SWING * F.sin(2 * F.pi() * step / SWING_STEPS) + gauss("temperature", n, seed) * TEMPERATURE_NOISE
    return spark.range(rows).select(
        F.format_string("sensor_%03d", sensor).alias("sensor_id"),
        F.concat(F.lit("zone_"), F.floor(sensor / 5)).alias("location"),
        _pick(DEVICES, uniform("device", sensor, seed)).alias("device_type"),
        (F.lit(start_ms) + F.floor((step - 1) * (1000 / per_second))).cast("bigint").alias("timestamp"),
        rounded(F.when(odd, bad(between("hot", HOT), between("cold", COLD))).otherwise(temperature), 2).alias("temperature"),
        rounded(F.when(odd, bad(between("dry", DRY), between("damp", DAMP))).otherwise(F.lit(NORMAL_HUMIDITY) + gauss("humidity", n, seed) * HUMIDITY_NOISE), 2).alias("humidity"),
        rounded(F.lit(NORMAL_PRESSURE) + gauss("pressure", n, seed) * PRESSURE_NOISE, 2).alias("pressure"),
        rounded(F.lit(100.0) - step / BATTERY_STEPS * 100, 1).alias("battery_level"),
        odd.alias("is_anomaly"),
    )


def shop(spark: SparkSession, rows: int, users: int = 100, per_second: float = 10, seed: int = 42, start_ms: int = START_MS) -> DataFrame:
    """Events of shoppers, each with a cart of products.

    A product is in a cart once. Taking something out of an empty cart, or buying
    one, is a page view. A purchase has the value and number of all products in the
    cart and empties it. Carts are simulated in order of time, a shopper at a time.
    """
    total, reach, event = sum(SHOP_EVENTS.values()), 0, None
    n = F.col("id")
    share = uniform("event", n, seed) * total
    for name, weight in SHOP_EVENTS.items():
        reach += weight
        event = F.when(share < reach, F.lit(name)) if event is None else event.when(share < reach, F.lit(name))
    base = spark.range(rows).select(
        n,
        (F.lit(start_ms) + F.floor(n * (1000 / per_second))).cast("bigint").alias("timestamp"),
        F.format_string("user_%04d", (F.floor(uniform("user", n, seed) * users) + 1).cast("int")).alias("user_id"),
        event.alias("event_type"),
        F.floor(uniform("product", n, seed) * len(PRODUCTS)).cast("int").alias("product"),
        uniform("taken", n, seed).alias("taken"),
    )
    schema = (
        "event_id string, timestamp bigint, user_id string, event_type string, product_id string, product_name string, price double, category string, "
        "quantity int, session_id string, cart_size int, total_value double"
    )
    return state.keyed_process(base, ["user_id"], ["id"], _shopping, schema)


def _shopping(user, row, cart):
    cart, kind, product, quantity, value = list(cart or ()), row["event_type"], row["product"], 1, None
    if kind == "add_to_cart":
        if product not in cart:
            cart.append(product)
    elif kind in ("remove_from_cart", "purchase") and not cart:
        kind = "page_view"
    elif kind == "remove_from_cart":
        product = cart.pop(int(row["taken"] * len(cart)))
    elif kind == "purchase":
        value, quantity = round(sum(PRODUCTS[p][1] for p in cart), 2), len(cart)
        cart = []
    name, price, category = PRODUCTS[product]
    number = row["timestamp"] * 1000 + row["id"] % 1000
    return [(f"evt_{number}", row["timestamp"], user, kind, f"prod_{product + 1}", name, price, category, quantity, f"sess_{user[5:]}", len(cart), value)], cart


def market(spark: SparkSession, rows: int, symbols: list[str] | None = None, per_second: float = 10, seed: int = 42, start_ms: int = START_MS) -> DataFrame:
    """Ticks of each symbol in turn, all of a round at one time: a random walk by factors, that never falls below 1.

    With B the product of a symbol's factors so far, a walk with a floor is
    B times the larger of its first price and the largest 1 / B so far; so prices
    are running aggregates and no symbol is walked by one task.
    """
    names = [s for s in symbols or SYMBOLS if s in SYMBOLS]
    n = F.col("id")
    which = F.pmod(n, F.lit(len(names)))
    of = lambda k: F.element_at(F.array(*[F.lit(SYMBOLS[s][k]) for s in names]), (which + 1).cast("int"))
    tick = F.floor(n / len(names))
    spike = F.when(F.pmod(tick, F.lit(SPIKE_EVERY)) < SPIKE_LENGTH, F.floor(uniform("spike", n, seed) * 6) + 5).otherwise(F.lit(1))
    base = spark.range(rows).select(
        n,
        F.element_at(F.array(*map(F.lit, names)), (which + 1).cast("int")).alias("symbol"),
        (F.lit(start_ms) + F.floor(tick * (1000 / per_second))).cast("bigint").alias("timestamp"),
        F.log(F.lit(1.0) + of(2) + of(1) * gauss("step", n, seed)).alias("factor"),
        of(0).alias("first"),
        ((F.floor(uniform("volume", n, seed) * 901) + 100) * spike).cast("bigint").alias("volume"),
    )
    walked = running(base, ["symbol"], ["id"], {"whole": ("sum", F.col("factor")), "daily_volume": ("sum", F.col("volume"))})
    floored = running(walked, ["symbol"], ["id"], {"least": ("min", F.col("whole"))})
    price = F.exp(F.col("whole")) * F.greatest(F.col("first"), F.lit(FLOOR) * F.exp(-F.col("least")))
    priced = floored.withColumn("price", F.greatest(price, F.lit(FLOOR)))
    priced = running(priced, ["symbol"], ["id"], {"high": ("max", F.col("price")), "low": ("min", F.col("price"))})
    half = F.col("price") * SPREAD / 2
    return priced.select(
        "timestamp", "symbol", F.round("price", 2).alias("price"), F.round(F.col("price") - half, 2).alias("bid"), F.round(F.col("price") + half, 2).alias("ask"), "volume", "daily_volume",
        F.round(F.greatest("first", "high"), 2).alias("daily_high"), F.round(F.least("first", "low"), 2).alias("daily_low"), F.lit("NASDAQ").alias("exchange"),
    )
