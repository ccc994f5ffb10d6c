"""Relational tables as edges. Each mapping gives distinct edges without nulls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlog.operators.fixpoint import union
from quiverlog.sources.store import GraphStore


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def edges(df: DataFrame, subject: Column, predicate: str, obj: Column) -> DataFrame:
    return df.select(subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.cast("string").alias("object")).dropna()


def _distinct(df: DataFrame, *keys: str) -> DataFrame:
    """On the narrow keys, before they become strings."""
    return df.select(*keys).distinct()


def _turns(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    ids = F.concat(F.col("conv_id").cast("string"), F.lit(":"))
    return edges(turns.join(after, ["conv_id", "turn"]), F.concat(F.lit("turn/"), ids, F.col("turn").cast("string")), "next", F.concat(F.lit("turn/"), ids, (F.col("turn") + 1).cast("string")))


def _links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return edges(pages.distinct(), node("page", "page_id"), "links_to", F.col("href"))


def _buys(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return edges(_distinct(table(spark, d, "orders").join(lines, "o_orderkey"), "o_custkey", "l_suppkey"), node("customer", "o_custkey"), "buys_from", node("supplier", "l_suppkey"))


#: name -> (spark, folder) -> edges
PARTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "customer_nation": lambda s, d: edges(table(s, d, "customer"), node("customer", "c_custkey"), "in_nation", node("nation", "c_nationkey")),
    "customer_segment": lambda s, d: edges(table(s, d, "customer"), node("customer", "c_custkey"), "segment", F.col("c_mktsegment")),
    "supplier_nation": lambda s, d: edges(table(s, d, "supplier"), node("supplier", "s_suppkey"), "in_nation", node("nation", "s_nationkey")),
    "nation_region": lambda s, d: edges(table(s, d, "nation"), node("nation", "n_nationkey"), "in_region", node("region", "n_regionkey")),
    "nation_name": lambda s, d: edges(table(s, d, "nation"), node("nation", "n_nationkey"), "name", F.col("n_name")),
    "region_name": lambda s, d: edges(table(s, d, "region"), node("region", "r_regionkey"), "name", F.col("r_name")),
    "order_customer": lambda s, d: edges(table(s, d, "orders"), node("order", "o_orderkey"), "placed_by", node("customer", "o_custkey")),
    "order_status": lambda s, d: edges(table(s, d, "orders"), node("order", "o_orderkey"), "status", F.col("o_orderstatus")),
    "supplies": lambda s, d: edges(_distinct(table(s, d, "lineitem"), "l_suppkey", "l_partkey"), node("supplier", "l_suppkey"), "supplies", node("part", "l_partkey")),
    "part_brand": lambda s, d: edges(table(s, d, "part"), node("part", "p_partkey"), "brand", F.col("p_brand")),
    "user_event": lambda s, d: edges(_distinct(table(s, d, "events"), "user_id", "event_type"), node("user", "user_id"), "did", F.col("event_type")),
    "buys": _buys,
    "turns": _turns,
    "ring": lambda s, d: edges(table(s, d, "nation"), node("nation", "n_nationkey"), "next", node("nation", (F.col("n_nationkey") + 1) % 25)),
    "links": _links,
}


def graph(spark: SparkSession, sf_dir: str, *parts: str) -> GraphStore:
    """A store over the named mappings; different mappings never give the same edge."""
    return GraphStore.of_set(spark, union([PARTS[p](spark, sf_dir) for p in parts])) if parts else GraphStore(spark)
