"""Models learned from turns: affinities, co-activation, rhythms, n-grams, usefulness.

Pairs of a basket are formed by a self-join on the basket; a basket is bounded (the top files of a turn, the paths of a commit of usual size), so pairs grow with baskets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOW, FAST = 0.88, 0.50


def pairs(items: DataFrame, basket: list[str], item: str = "path") -> DataFrame:
    """(a, b, shared): how many baskets hold both, a < b."""
    left = items.select(*basket, F.col(item).alias("a")).distinct()
    right = left.select(*basket, F.col("a").alias("b"))
    keys = [c for c in basket if c != "turn_id"] if "turn_id" in basket else []
    return left.join(right, basket).where("a < b").groupBy(*keys, "a", "b").agg(F.count("*").alias("shared"))


def coactivation(items: DataFrame, basket: list[str], order: str, item: str = "path", most: int = 6, least: float = 0.25, shared: int = 3) -> DataFrame:
    """Symmetric edges (src, dst, weight) of items whose baskets overlap: Jaccard at least `least`, at least `shared` baskets in common. Of a basket its first `most` items by `order` count, of equal ones the lower."""
    items = top_n(items.groupBy(*basket, item).agg(F.min(order).alias("_at")), basket, [F.asc("_at"), F.asc(item)], most)
    keys = [c for c in basket if c != "turn_id"]
    sizes = items.select(*basket, item).distinct().groupBy(*keys, item).agg(F.count("*").alias("n"))
    p = pairs(items, basket, item).where(F.col("shared") >= shared)
    p = p.join(sizes.withColumnsRenamed({item: "a", "n": "na"}), [*keys, "a"]).join(sizes.withColumnsRenamed({item: "b", "n": "nb"}), [*keys, "b"])
    p = p.withColumn("weight", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).where(F.col("weight") >= least)
    return p.select(*keys, F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(p.select(*keys, F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def cochange(commits: DataFrame, low: int = 2, high: int = 15, least: float = 0.3, partners: int = 5, hub_share: float = 0.4, hub_least: int = 5) -> DataFrame:
    """(src, dst, strength): the part of a path's commits that also hold another one. Commits of other sizes are left out, paths linked to too many others too."""
    sizes = commits.groupBy("commit_idx").agg(F.count_distinct("path").alias("n")).where(F.col("n").between(low, high))
    kept = commits.join(sizes.select("commit_idx"), "commit_idx").distinct()
    n = kept.groupBy("path").agg(F.count("*").alias("n"))
    p = pairs(kept, ["commit_idx"])
    both = p.select(F.col("a").alias("src"), F.col("b").alias("dst"), "shared").unionByName(p.select(F.col("b").alias("src"), F.col("a").alias("dst"), "shared"))
    strong = both.join(n.withColumnRenamed("path", "src"), "src").withColumn("strength", F.round(F.col("shared") / F.col("n"), 3)).where(F.col("shared") / F.col("n") >= least)
    degree = strong.groupBy("src").agg(F.count("*").alias("degree"))
    total = n.agg(F.greatest(F.lit(float(hub_least)), F.count("*") * hub_share).alias("most"))
    hubs = degree.crossJoin(F.broadcast(total)).where("degree >= most").select("src")  # one row of totals
    kept_edges = strong.join(hubs, "src", "left_anti").join(hubs.withColumnRenamed("src", "dst"), "dst", "left_anti")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("strength"), "dst"))
    return kept_edges.withColumn("rank", rank).where(F.col("rank") <= partners).select("src", "dst", "strength", "rank")


def affinity(words: DataFrame, used: DataFrame, turns_learned: int = 0) -> DataFrame:
    """(word, path, affinity) from words of turns and the files these used: each meeting adds the learning rate, up to 1."""
    rate = 0.08 if turns_learned < 100 else 0.04
    return words.join(used, "turn_id").groupBy("word", "path").agg(F.round(F.least(F.lit(1.0), F.count("*") * F.lit(rate)), 4).alias("affinity"))


def decayed(affinities: DataFrame, rate: float = 0.995, least: float = 0.03) -> DataFrame:
    return affinities.withColumn("affinity", F.col("affinity") * rate).where(F.col("affinity") >= least).withColumn("affinity", F.round("affinity", 4))


def word_frequency(words: DataFrame, turns: Column) -> DataFrame:
    """(word, frequency): the part of turns with a word, for words of at least two turns."""
    return words.select("turn_id", "word").distinct().groupBy("word").agg(F.count("*").alias("n")).where("n >= 2").select("word", F.round(F.col("n") / turns, 3).alias("frequency"))


def rhythm(active: DataFrame) -> DataFrame:
    """(path, decay) from the mean gap between a file's turns, of which there are at least three: gaps of up to 3 decay slowly, from 12 on fast. Gaps add up to last minus first."""
    per = active.select("path", "turn").distinct().groupBy("path").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.max("turn").alias("last")).where("n >= 3")
    gap = (F.col("last") - F.col("first")) / (F.col("n") - 1)
    decay = F.when(gap <= 3, SLOW).when(gap >= 12, FAST).otherwise(SLOW + (gap - 3) / 9 * (FAST - SLOW))
    return per.select("path", F.round(decay, 3).alias("decay"))


def boost(scores: DataFrame, affinities: DataFrame, words: DataFrame, frequency: DataFrame, weight: float = 0.45, dampen: float = 0.30) -> DataFrame:
    """(path, score): scores raised by the affinities of a prompt's words, common words less, up to 1. The order of words does not matter as nothing lowers a score."""
    idf = F.when(F.coalesce("frequency", F.lit(0.0)) > dampen, dampen / F.col("frequency")).otherwise(1.0)
    add = words.join(affinities, "word").join(frequency, "word", "left").groupBy("path").agg(F.sum(F.col("affinity") * idf * weight).alias("add"))
    return scores.join(add, "path", "left").select("path", F.round(F.least(F.lit(1.0), F.col("score") + F.coalesce("add", F.lit(0.0))), 6).alias("score"))


def ngrams(sequence: DataFrame, key: str, order: str, item: str, n: int = 2) -> DataFrame:
    """(context, next, count): what follows the n-1 items before it in a sequence."""
    w = Window.partitionBy(key).orderBy(order)
    before = [F.lag(item, k).over(w).alias(f"c{k}") for k in range(n - 1, 0, -1)]
    s = sequence.select(F.col(item).alias("next"), *before).where(" AND ".join(f"c{k} IS NOT NULL" for k in range(n - 1, 0, -1)))
    return s.groupBy(F.concat_ws(" ", *[f"c{k}" for k in range(n - 1, 0, -1)]).alias("context"), "next").agg(F.count("*").alias("count"))


def strong_keywords(counts: DataFrame, length: int = 4, total: int = 3, share: float = 0.7) -> DataFrame:
    """(word, path): words of which one file has at least `share` of the uses."""
    w = Window.partitionBy("word")
    c = counts.withColumn("total", F.sum("count").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("count"), "path")))
    return c.where((F.length("word") >= length) & (F.col("total") >= total) & (F.col("rank") == 1) & (F.col("count") / F.col("total") >= share)).select("word", "path", "total")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps n rows of each key and task before it shuffles them."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def usage_counters(injected: DataFrame, accessed: DataFrame, edited: DataFrame) -> DataFrame:
    """(path, injected, accessed, edited, usefulness)."""
    from ..functions.text import usefulness

    tag = lambda df, i, a, e: df.select("path", F.lit(i).alias("injected"), F.lit(a).alias("accessed"), F.lit(e).alias("edited"))
    all_ = tag(injected, 1, 0, 0).unionByName(tag(accessed, 0, 1, 0)).unionByName(tag(edited, 0, 0, 1))
    s = all_.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("injected", "accessed", "edited")])
    return s.withColumn("usefulness", usefulness(F.col("accessed"), F.col("edited"), F.col("injected")))


def merged(left: DataFrame, right: DataFrame, keys: list[str], value: str, how: str) -> DataFrame:
    """Two states in one: max, avg (nothing counts as 0 on the left; what only the left has stays), prefer (left, then right), add, weighted (two to one)."""
    a, b = F.col("l"), F.col("r")
    rule = {
        "max": F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))),
        "avg": F.when(b.isNull(), a).otherwise((F.coalesce(a, F.lit(0.0)) + b) / 2),
        "prefer": F.coalesce(a, b),
        "add": F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)),
        "weighted": F.when(a.isNull(), b).when(b.isNull(), a).otherwise((2 * a + b) / 3),
    }[how]
    return left.select(*keys, F.col(value).cast("double").alias("l")).join(right.select(*keys, F.col(value).cast("double").alias("r")), keys, "full").select(*keys, F.round(rule, 9).alias(value))


def maturity(turns: Column) -> Column:
    return F.when(turns < 25, "observing").otherwise("active")


def maturity_boost(turns: Column) -> Column:
    return F.when(turns < 25, 0.0).otherwise(0.45)


def predicted(signals: DataFrame, confident: Column, project: Column | None = None) -> DataFrame:
    """Files for each turn from signals (turn_id, path, points): up to three that reach 0.4 of the best if the turn is confident, else the best two. Files of another project than `project` count 0.15."""
    from ..functions.text import basename  # noqa: F401

    other = F.lit(1.0) if project is None else F.when(F.lower(F.element_at(F.split("path", "/"), 1)) == project, 1.0).otherwise(0.15)
    s = signals.groupBy("turn_id", "path").agg(F.sum("points").alias("p"), F.max(confident.cast("int")).alias("c")).withColumn("score", F.round(F.col("p") * other, 6))
    w = Window.partitionBy("turn_id")
    s = s.withColumn("top", F.max("score").over(w)).withColumn("sure", F.max("c").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "path")))
    return s.where(F.when(F.col("sure") == 1, (F.col("rank") <= 3) & (F.col("score") >= F.col("top") * 0.4)).otherwise(F.col("rank") <= 2)).select("turn_id", "path", "score", "rank")
