"""Connected components of a graph held as a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendframe.llm.base import cut


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("low"))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both)
    return (
        both.join(low, F.col("u") == F.col("_u"))
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        .distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    low = _lowest(pairs)
    joined = pairs.join(low, F.col("u") == F.col("_u"))
    others = joined.where(F.col("v") > F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return others.union(low.select(F.col("_u").alias("u"), F.col("low").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node that has a link to another; ``label`` is the smallest node reachable.

    ``links`` has two columns of longs, in any order and with repeats; rows with a null and links of a
    node to itself are ignored.  Each round is two joins over at most the number of links; the table is
    written to the shared folder and compared with the last by its count and a sum of hashes.
    Nodes and links stay distributed; a node with very many links only meets aggregates that combine
    on the map side and joins that Spark may split.
    """
    a, b = links.columns
    pairs = cut(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = None
    while True:
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        seen = tuple(mark)
        pairs = cut(_small_star(_large_star(pairs)))
