"""Generated demo and benchmark tables.

The demo tables come from one linear congruential sequence, so their rows are drawn
one after the other on the driver; they have a fixed, small number of rows.  The
benchmark fact is computed from row numbers by hashing, in parallel, at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fmod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The sequence of the demo data and the names it draws from; the known totals depend on them.
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407
CATEGORIES = [
    "Electronics", "Clothing", "Food", "Furniture", "Sports", "Books", "Toys", "Automotive", "Health", "Music",
    "Garden", "Office", "Pet Supplies", "Jewelry", "Home", "Baby", "Tools", "Beauty", "Shoes", "Outdoors",
]
TERRITORIES = ["North", "South", "East", "West", "Central", "Northeast", "Southeast", "Northwest"]
CHANNELS = ["Online", "Retail", "Wholesale", "Direct"]
SEGMENTS = ["Consumer", "Business", "Government", "Education", "Non-Profit"]
WAREHOUSES = ["WH-1", "WH-2", "WH-3", "WH-4", "WH-5", "WH-6"]

SALES_SCHEMA = "category string, territory string, channel string, segment string, revenue double, units double, date_key int"
SIZES = {"tiny": 10, "small": 10_000, "medium": 100_000, "large": 1_000_000}


def sequence(seed: int) -> Iterator[int]:
    state = seed
    while True:
        state = (state * MULTIPLIER + INCREMENT) % (1 << 64)
        yield state


def sales_rows(n: int = 20_000, seed: int = 99) -> list[tuple]:
    u = sequence(seed)
    rows = []
    for _ in range(n):
        category, territory, channel, segment = (names[next(u) % len(names)] for names in (CATEGORIES, TERRITORIES, CHANNELS, SEGMENTS))
        revenue = 1000.0 + fmod(float(next(u)), 50_000.0)
        units = float(round(fmod(float(next(u)), 500.0)))
        year, month, day = 2020 + next(u) % 11, next(u) % 12 + 1, next(u) % 28 + 1
        rows.append((category, territory, channel, segment, revenue, units, year * 10_000 + month * 100 + day))
    return rows


def sales_fact(spark: SparkSession, n: int = 20_000, seed: int = 99) -> DataFrame:
    return spark.createDataFrame(sales_rows(n, seed), SALES_SCHEMA)


def two_dimensions(spark: SparkSession) -> DataFrame:
    """Eight rows over two dimensions."""
    rows = [("Kategori A", 100000.0, 200000.0), ("Kategori B", 150000.0, 100000.0), ("Kategori C", 200000.0, 200000.0), ("Kategori D", 200000.0, 100500.5)]
    return spark.createDataFrame([(k, r, v) for k, a, b in rows for r, v in (("North", a), ("South", b))], "produktkategori string, region string, sales double")


def inventory_fact(spark: SparkSession, n: int = 10_000, seed: int = 77) -> DataFrame:
    u = sequence(seed)
    rows = []
    for _ in range(n):
        category, territory, warehouse = (names[next(u) % len(names)] for names in (CATEGORIES, TERRITORIES, WAREHOUSES))
        quantity = 100.0 + fmod(float(next(u)), 10_000.0)
        cost = quantity * (5.0 + fmod(float(next(u)), 45.0))
        rows.append((category, territory, warehouse, float(round(quantity)), float(round(cost))))
    return spark.createDataFrame(rows, "category string, territory string, warehouse string, stock_qty double, stock_cost double")


def benchmark_fact(spark: SparkSession, size: str | int = "medium", seed: int = 1) -> DataFrame:
    """A star's fact of any size, computed from row numbers; a third of the rows of one category."""
    n = SIZES[size] if isinstance(size, str) else size
    i = F.col("id")

    def pick(names: list[str], salt: int):
        return F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64(i, F.lit(seed), F.lit(salt)), F.lit(len(names))) + 1).cast("int"))

    def number(below: int, salt: int):
        return F.pmod(F.xxhash64(i, F.lit(seed), F.lit(salt)), F.lit(below))

    category = F.when(number(3, 0) == 0, F.lit(CATEGORIES[0])).otherwise(pick(CATEGORIES, 1))
    key = ((2020 + number(11, 7)) * 10_000 + (number(12, 8) + 1) * 100 + number(28, 9) + 1).cast("int")
    return spark.range(n).select(category.alias("category"), pick(TERRITORIES, 2).alias("territory"), pick(CHANNELS, 3).alias("channel"), pick(SEGMENTS, 4).alias("segment"), (1000 + number(50_000, 5)).cast("double").alias("revenue"), number(500, 6).cast("double").alias("units"), key.alias("date_key"))
