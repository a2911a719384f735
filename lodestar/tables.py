"""The test tables as collections: customers, orders with nested items, documents, vectors, events, a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection import Collection
from .functions import geo as g
from .model import Field, Model


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str, name: str, key: str, **fields: Field) -> Collection:
    df = table(spark, sf_dir, name)
    return Collection(Model.of(name, df, key=key, **fields), df)


def customers(spark: SparkSession, d: str) -> Collection:
    return collection(spark, d, "customer", "c_custkey")


def orders(spark: SparkSession, d: str) -> Collection:
    return collection(spark, d, "orders", "o_orderkey")


def lineitems(spark: SparkSession, d: str) -> Collection:
    """Lines have no key of their own; queries on them must not rely on an order."""
    return collection(spark, d, "lineitem", "l_orderkey")


def parts(spark: SparkSession, d: str) -> Collection:
    words = Field("words", derive=lambda: F.split("p_name", " "))
    return collection(spark, d, "part", "p_partkey", words=words, p_name=Field("p_name", indexed=True))


def documents(spark: SparkSession, d: str) -> Collection:
    return collection(spark, d, "documents", "doc_id", text=Field("text").as_tokenized())


def embeddings(spark: SparkSession, d: str) -> Collection:
    return collection(spark, d, "embeddings", "vec_id", embedding=Field("embedding").as_vector(64))


def orders_with_items(spark: SparkSession, d: str) -> Collection:
    """Orders with their lines as an array of structs."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"))).alias("items"))
    o = table(spark, d, "orders")
    df = o.join(lines, F.col("o_orderkey") == F.col("k"), "left").drop("k")
    return Collection(Model.of("orders_with_items", df, key="o_orderkey"), df)


def customers_with_orders(spark: SparkSession, d: str) -> Collection:
    """Customers with their orders, each with its lines: arrays in arrays."""
    own = orders_with_items(spark, d).stored
    nested = own.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("items"))).alias("orders"))
    df = table(spark, d, "customer").join(nested, F.col("c_custkey") == F.col("k"), "left").drop("k")
    return Collection(Model.of("customers_with_orders", df, key="c_custkey"), df)


def place() -> tuple[Column, Column]:
    """A made-up place of a customer: the tables have none."""
    return (F.col("c_custkey") * 37 % 160 - 80).cast("double"), (F.col("c_custkey") * 91 % 340 - 170).cast("double")


def customers_with_places(spark: SparkSession, d: str) -> Collection:
    lat, lon = place()
    point = Field("point", indexed=True, derive=lambda: F.struct(lat.alias("lat"), lon.alias("lon")))
    geos = Field("geos", indexed=True, derive=lambda: F.array(F.struct(F.lit("Point").alias("kind"), F.array(F.array(F.struct(lat.alias("lat"), lon.alias("lon")))).alias("parts"))))
    return collection(spark, d, "customer", "c_custkey", point=point, geos=geos)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts on consecutive lines of an order, for returned lines of large quantity."""
    a, b = table(spark, d, "lineitem").alias("a"), table(spark, d, "lineitem").alias("b")
    return a.where("l_returnflag = 'R' AND l_quantity > 45").join(b, F.expr("a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1")).select(F.col("a.l_partkey").alias("_from"), F.col("b.l_partkey").alias("_to")).distinct()


#: The graph's edges for DuckDB.
EDGES = "e AS (SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag = 'R' AND a.l_quantity > 45)"

SQUARE = g.Geo.polygon([(-20.0, -60.0), (-20.0, 70.0), (50.0, 70.0), (50.0, -60.0)])
