"""Connected components of a graph given by its links."""

from pyspark.sql import DataFrame, functions as F

from contentloom.session import stage


def components(links: DataFrame, jumps: int = 2) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for each node with a link.

    ``links`` has two columns of numbers. In each round a node points to its smallest
    neighbour, if that is smaller; pointers are followed a few times, the links are carried
    over to where they lead, and those within one node vanish. A round is a few joins of
    narrow rows, each staged, so nothing is held on the driver but the number of links that
    are left. A link from a node to itself makes it a node; nulls are dropped.
    """
    a, b = links.columns
    left = stage(links.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().distinct(), "links")
    rounds = []
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        to = stage(ends.groupBy("node").agg(F.least("node", F.min("near")).alias("root")), "pointers")
        for _ in range(jumps):
            to = stage(_follow(to, to), "pointers")
        rounds.append(to)
        moved = left
        for end in ("a", "b"):
            moved = moved.join(to.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
        left = stage(
            moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
            .where("a <> b")
            .distinct(),
            "links",
        )
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = rounds[0]
    for to in rounds[1:]:
        labels = stage(_follow(labels, to), "labels")
    return labels


def _follow(labels: DataFrame, to: DataFrame) -> DataFrame:
    """Each node's root after one more step."""
    step = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
