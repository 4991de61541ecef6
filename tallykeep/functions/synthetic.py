"""A deterministic change stream over the star schema's tables, which SQL can replay, and typed seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import values as V

SHIFT = 10_000_000
EVENT_COLUMNS = [c.split(" ")[0] for c in V.EVENT_SCHEMA.replace(V.IMAGE, "x").split(", ")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"), "o_orderpriority")


def as_events(df: DataFrame, relation: str, seq, op, old, new) -> DataFrame:
    """Canonical events from expressions over df."""
    values = {"stream_id": F.lit("s"), "seq": seq.cast("long"), "event_id": F.concat(F.lit("e"), seq.cast("string")), "relation": F.lit(relation), "op": op, "old": old, "new": new}
    none = F.from_json(F.lit("{}"), V.EVENT_SCHEMA)  # a NULL of each column's type
    return df.select(*[(values[c] if c in values else none[c]).alias(c) for c in EVENT_COLUMNS])


def changed_orders(o: DataFrame, customers: int) -> DataFrame:
    """orders with the columns that their update brings: n_* for each column, and what happens to the row."""
    k = F.col("o_orderkey")
    status = F.when((k % 23 == 0) & (F.col("o_orderstatus") == "F"), "O").when((k % 23 == 0) & (F.col("o_orderstatus") == "O"), "F").otherwise(F.col("o_orderstatus"))
    price = F.when(k % 17 == 0, F.col("o_totalprice") + F.lit("10.00").cast("decimal(12,2)")).otherwise(F.col("o_totalprice")).cast("decimal(12,2)")
    cust = F.when(k % 29 == 0, (F.col("o_custkey") + 1) % customers).otherwise(F.col("o_custkey"))
    touched = (k % 17 == 0) | (k % 23 == 0) | (k % 29 == 0)
    what = F.when(k % 19 == 0, "DELETE").when(touched, "UPDATE")
    return o.select("*", status.alias("n_o_orderstatus"), price.alias("n_o_totalprice"), cust.alias("n_o_custkey"), F.col("o_orderkey").alias("n_o_orderkey"), F.col("o_orderpriority").alias("n_o_orderpriority"), what.alias("what"))


def order_events(o: DataFrame, customers: int) -> DataFrame:
    """Updates and deletes at seq 2k, inserted copies at 2k + 1."""
    c = changed_orders(o, customers)
    cols = o.columns
    old = V.image(c, {x: x for x in cols})
    new = V.image(c, {x: f"n_{x}" for x in cols})
    some = c.where("what is not null")
    events = as_events(some, "orders", F.col("o_orderkey") * 2, F.col("what"), old, F.when(F.col("what") == "UPDATE", new))
    copies = c.where("o_orderkey % 31 = 0").withColumn("o_orderkey", F.col("o_orderkey") + SHIFT)
    none = F.lit(None).cast(V.IMAGE)
    return events.union(as_events(copies, "orders", (F.col("o_orderkey") - SHIFT) * 2 + 1, F.lit("INSERT"), none, V.image(copies, {x: x for x in cols})))


#: The same changes in SQL: what orders are after the stream.
MUTATED_ORDERS = f"""
base AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice, o_orderpriority FROM orders),
nc AS (SELECT count(*) AS n FROM customer),
mutated AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN (o_custkey + 1) % n ELSE o_custkey END AS o_custkey,
    CASE WHEN o_orderkey % 23 = 0 AND o_orderstatus = 'F' THEN 'O' WHEN o_orderkey % 23 = 0 AND o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 10.00 ELSE o_totalprice END AS o_totalprice, o_orderpriority
  FROM base, nc WHERE o_orderkey % 19 <> 0
  UNION ALL SELECT o_orderkey + {SHIFT}, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM base WHERE o_orderkey % 31 = 0
)"""
