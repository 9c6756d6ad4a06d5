"""Topologies as tables: machines (machine_id, is_switch, level, pod) and links (src, src_is_switch, dst, dst_is_switch), down to up.

Levels count from 0 at the lowest switches. Ids follow from arithmetic on ranges; nothing is built on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_topology_edges(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return spark.read.format(fmt).options(header=True).schema("src bigint, src_is_switch boolean, dst bigint, dst_is_switch boolean").load(path)


def _link(src: Column, dst: Column, server: bool = False) -> list[Column]:
    return [src.cast("bigint").alias("src"), F.lit(not server).alias("src_is_switch"), dst.cast("bigint").alias("dst"), F.lit(True).alias("dst_is_switch")]


def fat_tree(spark: SparkSession, k: int) -> tuple[DataFrame, DataFrame]:
    """(machines, links) of a fat tree: k*k/4 core, k*k/2 aggregation and k*k/2 top-of-rack switches, k/2 servers each of those.

    Switch ids: core, then aggregation, then racks, by pod; server ids by rack.
    """
    if k % 2:
        raise ValueError("k must be even")
    h = k // 2
    core, pod = h * h, k * h
    i = F.col("id")
    level = F.when(i < core, 2).when(i < core + pod, 1).otherwise(0)
    switches = spark.range(core + 2 * pod).select(i.alias("machine_id"), F.lit(True).alias("is_switch"), level.alias("level"), F.when(i >= core, F.floor((i - core) % pod / h)).cast("bigint").alias("pod"))
    servers = spark.range(pod * h).select(i.alias("machine_id"), F.lit(False).alias("is_switch"), F.lit(-1).alias("level"), F.floor(i / (h * h)).cast("bigint").alias("pod"))
    up = spark.range(pod * h)  # (switch of a pod level, one of its h uplinks)
    s, u = F.floor(i / h), i % h
    rack_up = up.select(*_link(core + pod + s, core + F.floor(s / h) * h + u))
    agg_up = up.select(*_link(core + s, (s % h) * h + u))
    server_up = spark.range(pod * h).select(*_link(i, core + pod + F.floor(i / h), server=True))
    return switches.unionByName(servers), rack_up.unionByName(agg_up).unionByName(server_up)


def binary_tree(spark: SparkSession, height: int) -> tuple[DataFrame, DataFrame]:
    """(machines, links) of a binary tree of switches, two servers at each lowest one. Switch 0 is the root; n has children 2n + 1 and 2n + 2."""
    n, i = 2 ** (height + 1) - 1, F.col("id")
    depth = F.floor(F.log2(i + 1) + 1e-9)
    switches = spark.range(n).select(i.alias("machine_id"), F.lit(True).alias("is_switch"), (height - depth).cast("int").alias("level"), F.lit(None).cast("bigint").alias("pod"))
    servers = spark.range(2 ** (height + 1)).select(i.alias("machine_id"), F.lit(False).alias("is_switch"), F.lit(-1).alias("level"), F.lit(None).cast("bigint").alias("pod"))
    links = spark.range(1, n).select(*_link(i, F.floor((i - 1) / 2)))
    return switches.unionByName(servers), links.unionByName(spark.range(2 ** (height + 1)).select(*_link(i, 2**height - 1 + F.floor(i / 2), server=True)))
