"""The registry's tables seen in the driver's star schema, once as DataFrames and once as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.lineage import spread


#: Rows of a table that are one task's input where each makes several or costs much.
ROWS = 20_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(prefix: str, key: Column, width: int = 10) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), width, "0"))


def members(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """Orders as lots of parts; with ``repeats`` as the lines are."""
    every = read(spark, sf_dir, "lineitem").select(named("O", F.col("l_orderkey")).alias("list_id"), named("P", F.col("l_partkey")).alias("geoid"))
    return every if repeats else every.distinct()


def list_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in customers in nations in regions."""
    o, c, n = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    out = o.select(named("O", F.col("o_orderkey")).alias("child"), named("C", F.col("o_custkey")).alias("parent"))
    out = out.unionByName(c.select(named("C", F.col("c_custkey")).alias("child"), named("N", F.col("c_nationkey")).alias("parent")))
    return out.unionByName(n.select(named("N", F.col("n_nationkey")).alias("child"), named("R", F.col("n_regionkey")).alias("parent")))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where and how each order was made; every seventh without a place."""
    place = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"))
    o = read(spark, sf_dir, "orders").join(place, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(named("O", F.col("o_orderkey")).alias("list_id"), F.when(F.col("o_orderkey") % 7 != 0, named("S", F.col("s"))).alias("location"), F.col("o_orderstatus").alias("event_type"))


def region_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh order also lists one of 100 regions."""
    o = read(spark, sf_dir, "orders").filter("o_orderkey % 11 = 0")
    return o.select(named("G", F.col("o_orderkey") % 100).alias("region_id"), named("O", F.col("o_orderkey")).alias("list_id"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were registered under an older id: p and p - p % 3, every fourth nested only."""
    p = read(spark, sf_dir, "part").filter("p_partkey % 3 <> 0")
    relation = F.when(F.col("p_partkey") % 4 == 0, "child_of").otherwise("same_as")
    return p.select(named("P", F.col("p_partkey")).alias("alias"), named("P", F.col("p_partkey") - F.col("p_partkey") % 3).alias("canonical"), relation.alias("relation"))


def leaf(key: Column) -> Column:
    """A leaf cell made from a key by arithmetic."""
    return key.cast("long") * 2654435761 * 2 + 1


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as plots of a few cells; groups of five share a place: some equal, some overlapping, some nested."""
    p = spread(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n")), ROWS)
    base = cells.parent(leaf(F.col("k") - F.col("k") % 5), 14)
    kids = F.slice(cells.children(base), 1, F.col("n") % 4 + 1)
    inner = F.array(cells.parent(leaf(F.col("k") - F.col("k") % 5), 16))
    return p.select(named("P", F.col("k")).alias("owner"), F.explode(F.when(F.col("k") % 5 == 4, inner).otherwise(kids)).alias("cell"))


def region_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 regions of one cell each, at levels 8 to 13."""
    g = spark.range(100).select(F.col("id").alias("g"))
    return g.select(named("G", F.col("g")).alias("region_id"), cells.parent(leaf(F.col("g") * 17), (F.lit(8) + F.col("g") % 6).cast("int")).alias("cell"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as point plots."""
    c = spread(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), ROWS)
    k = F.col("c_custkey")
    return c.select(named("C", k).alias("geo_id"), (F.lit(14.0) + F.pmod(k * 7919, F.lit(100000)) / 100000.0).alias("lat"), (F.lit(-89.0) + F.pmod(k * 104729, F.lit(200000)) / 100000.0).alias("lng"), (F.pmod(k, F.lit(50)) / 10.0).alias("declared_area"), k.alias("k"), "c_nationkey", "c_acctbal", "c_mktsegment")


#: DuckDB views of the same lenses, put before the oracles' own text.
SQL = {
    "members": "SELECT DISTINCT 'O' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS list_id, 'P' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS geoid FROM lineitem",
    "list_parents": """
        SELECT 'O' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS child, 'C' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS parent FROM orders
        UNION ALL SELECT 'C' || lpad(CAST(c_custkey AS VARCHAR), 10, '0'), 'N' || lpad(CAST(c_nationkey AS VARCHAR), 10, '0') FROM customer
        UNION ALL SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 10, '0'), 'R' || lpad(CAST(n_regionkey AS VARCHAR), 10, '0') FROM nation""",
    "artifacts": """
        SELECT 'O' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS list_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'S' || lpad(CAST(s AS VARCHAR), 10, '0') END AS location, o_orderstatus AS event_type
        FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "region_parents": "SELECT 'G' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 10, '0') AS region_id, 'O' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS list_id FROM orders WHERE o_orderkey % 11 = 0",
    "aliases": """
        SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS alias, 'P' || lpad(CAST(p_partkey - p_partkey % 3 AS VARCHAR), 10, '0') AS canonical,
        CASE WHEN p_partkey % 4 = 0 THEN 'child_of' ELSE 'same_as' END AS relation FROM part WHERE p_partkey % 3 <> 0""",
    "places": """
        SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS owner, p_partkey AS k, p_size AS n, (p_partkey - p_partkey % 5) * 2654435761 * 2 + 1 AS leaf FROM part""",
    "covers": """
        SELECT owner, cell FROM (
            SELECT owner, unnest(CASE WHEN k % 5 = 4 THEN [(leaf & -268435456) | 268435456] ELSE
                list_slice([b - 3221225472, b - 1073741824, b + 1073741824, b + 3221225472], 1, n % 4 + 1) END) AS cell
            FROM (SELECT *, (leaf & -4294967296) | 4294967296 AS b FROM places))""",
    "region_cells": """
        SELECT 'G' || lpad(CAST(g AS VARCHAR), 10, '0') AS region_id, ((g * 17 * 2654435761 * 2 + 1) & -(1::BIGINT << (2 * (30 - 8 - g % 6)))) | (1::BIGINT << (2 * (30 - 8 - g % 6))) AS cell
        FROM (SELECT CAST(range AS BIGINT) AS g FROM range(100))""",
    "ancestors": """
        SELECT owner, cell, (cell & -(1::BIGINT << (2 * (30 - l)))) | (1::BIGINT << (2 * (30 - l))) AS up, l
        FROM (SELECT owner, cell, unnest(range(0, 31)) AS l FROM (SELECT DISTINCT owner, cell FROM covers)) WHERE (1::BIGINT << (2 * (30 - l))) >= (cell & -cell)""",
    "points": """
        SELECT 'C' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS geo_id, 14.0::DOUBLE + ((c_custkey * 7919) % 100000) / 100000.0::DOUBLE AS lat,
        -89.0::DOUBLE + ((c_custkey * 104729) % 200000) / 100000.0::DOUBLE AS lng, (c_custkey % 50) / 10.0::DOUBLE AS declared_area, c_custkey AS k, c_nationkey, c_acctbal, c_mktsegment FROM customer""",
}


def sql(views: str, text: str) -> str:
    """``text`` behind the named views."""
    return "WITH RECURSIVE " + ", ".join(f"{v} AS ({SQL[v]})" for v in views.split()) + ("" if text.lstrip().upper().startswith("SELECT") else ", ") + text
