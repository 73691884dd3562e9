"""Made-up orders to try recipes on: nested, the same on every run, of any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the fields are drawn from.
STATUSES, TIERS = ("pending", "paid", "shipped", "returned"), ("basic", "plus", "business")
COUNTRIES, TAGS = ("DE", "FR", "IN", "JP", "US"), ("gift", "express", "fragile", "bulk")


def _drawn(what: str, n: int, place: Column | int = 0) -> Column:
    """A number below `n` that depends on the row, the field and the place only."""
    return F.pmod(F.xxhash64("i", F.lit(what), F.lit(place) if isinstance(place, int) else place), F.lit(n))


def _one_of(what: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_drawn(what, len(values)) + 1).cast("int"))


def sample_orders(spark: SparkSession, count: int = 80) -> DataFrame:
    """`count` orders with a customer, one to four items and their total."""
    person = _drawn("customer", 40)
    name = F.concat(F.lit("Customer "), person)
    items = F.transform(
        F.sequence(F.lit(1), (_drawn("items", 4) + 1).cast("int")),
        lambda p: F.struct(
            F.concat(F.lit("SKU-"), _drawn("sku", 100, p)).alias("sku"),
            F.concat(F.lit("Item "), _drawn("sku", 100, p)).alias("name"),
            (_drawn("quantity", 5, p) + 1).alias("quantity"),
            ((_drawn("price", 20_000, p) + 100) / 100).cast("decimal(10,2)").alias("price"),
        ),
    )
    rows = spark.range(count).withColumnRenamed("id", "i").withColumn("items", items)
    total = F.aggregate("items", F.lit(0).cast("decimal(12,2)"), lambda sum_, x: (sum_ + x["price"] * x["quantity"]).cast("decimal(12,2)"))
    address = F.struct(_one_of("country", COUNTRIES).alias("country"))
    customer = F.struct(F.concat(F.lit("C-"), person).alias("id"), name.alias("name"), F.concat(F.lit("customer"), person, F.lit("@example.com")).alias("email"), _one_of("tier", TIERS).alias("tier"), address.alias("address"))
    return rows.select(
        F.concat(F.lit("order-"), F.col("i") + 1).alias("id"),
        _one_of("status", STATUSES).alias("status"),
        F.date_format(F.timestamp_seconds(F.lit(1_735_689_600) + F.col("i") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
        customer.alias("customer"),
        "items",
        total.alias("total"),
        F.lit("EUR").alias("currency"),
        F.array(_one_of("tag", TAGS)).alias("tags"),
    )
