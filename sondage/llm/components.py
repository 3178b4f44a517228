"""Connected components of an undirected graph held as a table of edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.session import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint), root the smallest node of
    its component.

    Alternates two steps until nothing changes, in a logarithmic number of rounds: every
    node's larger neighbours are linked to its smallest neighbour, then every node and its
    smaller neighbours are linked to the smallest. Minima are aggregated before the join,
    so a hub's neighbours never come together. Each round is kept by checkpoint().
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, mark = checkpointed(edges.distinct()), None
    while True:
        found = edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if found == mark or not found[0]:
            break
        mark = found
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.*")
        edges = checkpointed(small.where("a <> b").distinct())
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b"), F.col("b"))).distinct()
