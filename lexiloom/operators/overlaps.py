"""Suffix-prefix overlaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.components import connected_components
from lexiloom.plans.stash import dealt


def _keys(words: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    k = max(1, k)
    each = words.where(F.length("b") >= k).select("id", "b", F.explode(F.sequence(F.lit(k), F.length("b"))).alias("n"))
    return each.select(F.col("id").alias("u"), F.right("b", F.col("n")).alias("key")), each.select(F.col("id").alias("v"), F.left("b", F.col("n")).alias("key"))


def overlap_pairs(words: DataFrame, k: int) -> DataFrame:
    """(u, v, ov): the longest overlap of at least ``k`` bytes of each ordered pair of different words.

    ``words``: id, b.  A key is its own length, so one equi-join on the bytes serves all lengths.  Both words come along with their keys, so each
    match tells by itself whether a longer one exists: pairs are never gathered, and a task's memory doesn't grow with their number.
    """
    k = max(1, k)
    each = words.where(F.length("b") >= k).select("id", "b", F.explode(F.sequence(F.lit(k), F.length("b"))).alias("n"))
    suffix = each.select(F.col("id").alias("u"), F.col("b").alias("a"), F.right("b", F.col("n")).alias("key"))
    prefix = each.select(F.col("id").alias("v"), F.col("b").alias("c"), F.left("b", F.col("n")).alias("key"))
    n, most = F.length("key"), F.least(F.length("a"), F.length("c"))
    longer = F.when(most > n, F.exists(F.sequence(n + 1, most), lambda m: F.right("a", m) == F.left("c", m))).otherwise(False)
    return suffix.join(dealt(prefix), "key").where("u <> v").where(~longer).select("u", "v", n.alias("ov"))


def strongest_pairs(words: DataFrame, k: int, n: int) -> DataFrame:
    """The ``n`` longest of ``overlap_pairs(words, k)``, ties by u and v, without listing the others.

    Of one length, the matches of all keys are different pairs, and their number is known from counts by key.  If a length has ``n`` of them, no shorter
    overlap is among the strongest.  Long words are looked at first; the least length goes down until one has enough, or is ``k``.
    """
    k = max(1, k)
    low = max(k, words.agg(F.max(F.length("b")).alias("n")).first()["n"] or 0)
    while low > k:
        low = max(k, low // 2)
        each = words.where(F.length("b") >= low).select("b", F.explode(F.sequence(F.lit(low), F.length("b"))).alias("n"))
        tail, head = F.right("b", F.col("n")), F.left("b", F.col("n"))
        sides = each.select(tail.alias("key"), F.lit(1).alias("s"), F.lit(0).alias("p"), (tail == head).cast("int").alias("own"))
        sides = sides.unionByName(each.select(head.alias("key"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("own")))
        keys = sides.groupBy("key").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("own").alias("own"))
        counts = keys.groupBy(F.length("key").alias("n")).agg(F.sum(F.col("s") * F.col("p") - F.col("own")).alias("c"))
        enough = counts.where(F.col("c") >= n).agg(F.max("n").alias("n")).first()["n"]
        if enough is not None:
            low = enough
            break
    return strongest_overlaps(overlap_pairs(words, low), n)


def islands(words: DataFrame, k: int, one_task_links: int = 0) -> DataFrame:
    """(id, island_id): weak components of the overlaps of at least ``k`` bytes; ``island_id`` is the smallest id.

    Pairs are never listed.  All words around one key (as suffix or as prefix, with both present) hang together, so
    each is linked to the key's smallest word: the edges grow with the keys, not with the pairs.  ``one_task_links``: up to so many links are solved by
    one task's union-find instead of in rounds, with the same result.
    """
    suffix, prefix = _keys(words, k)
    sides = suffix.select(F.col("u").alias("id"), "key", F.lit(1).alias("s"), F.lit(0).alias("p")).unionByName(prefix.select(F.col("v").alias("id"), "key", F.lit(0).alias("s"), F.lit(1).alias("p")))
    keys = sides.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("s").alias("s"), F.max("p").alias("p")).where("s = 1 and p = 1 and low < high").select("key", "low")
    edges = sides.select("id", "key").join(dealt(keys), "key").where("id <> low").select(F.col("id").alias("u"), F.col("low").alias("v"))
    comp = connected_components(edges, small=one_task_links)
    return words.select("id").join(dealt(comp), "id", "left").select("id", F.coalesce("component", "id").alias("island_id"))


def island_count(members: DataFrame) -> DataFrame:
    """Number of islands and of words."""
    return members.agg(F.countDistinct("island_id").alias("islands"), F.count("*").alias("words"))


def strongest_overlaps(pairs: DataFrame, n: int) -> DataFrame:
    """The ``n`` longest overlaps, ties by u and v (a bounded heap per task)."""
    return pairs.orderBy(F.desc("ov"), "u", "v").limit(n)
