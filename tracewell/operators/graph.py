"""Graphs of files: neighbourhoods, rank, transitive boosts. Rounds are joins of edge tables; a table that grows is cut off from its lineage by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """In the shared folder, so that plans stay short and a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 10) -> DataFrame:
    """(path, rank) after a fixed number of rounds; the rank of nodes without edges out is dealt to all. A node with many edges in is a partial aggregate."""
    edges = edges.select("src", "dst").distinct()
    nodes = edges.select(F.col("src").alias("path")).unionByName(edges.select(F.col("dst").alias("path"))).distinct()
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    linked = checkpointed(edges.join(out, "src"))
    nodes = checkpointed(nodes.join(out.withColumnRenamed("src", "path"), "path", "left"))
    n = nodes.count()
    rank = nodes.select("path", "deg", F.lit(1.0 / max(1, n)).alias("rank"))
    for k in range(rounds):
        dangling = rank.agg(F.coalesce(F.sum(F.when(F.col("deg").isNull(), F.col("rank"))), F.lit(0.0)).alias("d"))
        got = linked.join(rank.select(F.col("path").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("path")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        rank = nodes.join(got, "path", "left").crossJoin(F.broadcast(dangling)).select("path", "deg", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("d") / n)).alias("rank"))
        if k % 3 == 2:
            rank = checkpointed(rank)
    return rank.select("path", F.round("rank", 9).alias("rank"))


def within_hops(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(start, path, depth): what is reached in both directions in at most `hops`, at its least depth."""
    both = symmetric(edges)
    reached = starts.select(F.col("path").alias("start"), "path", F.lit(0).alias("depth"))
    front = reached
    for k in range(1, hops + 1):
        nxt = front.join(both.withColumnRenamed("src", "path"), "path").select("start", F.col("dst").alias("path"), F.lit(k).alias("depth")).distinct()
        front = nxt.join(reached, ["start", "path"], "left_anti")
        reached = reached.unionByName(front)
    return reached.where("depth > 0")


def transitive_boosts(activated: DataFrame, edges: DataFrame, first: float = 0.35, second: float = 0.15) -> DataFrame:
    """(path, boost): neighbours in one step, and half of `second` in two; the best over all activated files, which have none themselves."""
    near = within_hops(activated, edges, 2)
    best = near.groupBy("path").agg(F.max(F.when(F.col("depth") == 1, first).otherwise(second / 2)).alias("boost"))
    return best.join(activated.select("path").distinct(), "path", "left_anti")


def import_boosts(seeds: DataFrame, imports: DataFrame, depth: int = 2) -> DataFrame:
    """(path, score): imported files at half a seed's score for each step, importers at 0.7 of that."""
    now, found = seeds.select("path", "score"), None
    for _ in range(depth):
        fwd = now.join(imports.withColumnRenamed("src", "path"), "path").select(F.col("dst").alias("path"), (F.col("score") * 0.5).alias("score"))
        back = now.join(imports.withColumnRenamed("dst", "path"), "path").select(F.col("src").alias("path"), (F.col("score") * 0.5 * 0.7).alias("score"))
        now = fwd.unionByName(back).groupBy("path").agg(F.max("score").alias("score"))
        found = now if found is None else found.unionByName(now)
    return found.groupBy("path").agg(F.round(F.max("score"), 6).alias("score"))


def definers(defs: DataFrame, refs: DataFrame, most: int = 4) -> DataFrame:
    """(src, dst): files that use a name and the files that define it, for names of at most `most` files."""
    defs = defs.select("name", "path").distinct()
    few = defs.join(defs.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("name"), "name")
    return refs.withColumnRenamed("path", "src").join(few.select("name", F.col("path").alias("dst")), "name").where("src <> dst").select("src", "dst").distinct()
