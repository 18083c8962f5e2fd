"""Connected components by alternating large-star and small-star contractions.

On request, edges up to a number that the caller sets go to one task instead, a union-find over arrays: a few dozen shuffles cost more than that.

Both contractions are a partial-aggregated ``min`` per node followed by an equi-join.  A node with more neighbours than a quarter of a
partition's fair share would fill its join task, however many machines there are; such nodes are fewer than eight times the partitions,
so their minima are broadcast and their edges stay where they are.
The number of rounds grows with the logarithm of the longest path, not with the path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.stash import cut, dealt


def _with_low(rows: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``m``, the smallest ``v`` of each ``u``; and one row for each of these."""
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    most = max(16, n_rows // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = F.broadcast(low.where(F.col("n") > most).select("u", F.col("m").alias("h")))  # at most n_rows / most of them
    keyed = rows.join(hot, "u", "left").withColumn("k", F.when(F.col("h").isNull(), F.col("u")).otherwise(F.xxhash64("u", "v")))
    return keyed.join(dealt(low.select(F.col("u").alias("k"), "m")), "k", "left").select("u", "v", F.coalesce("h", "m").alias("m")), low


def _settled(e: DataFrame) -> bool:
    """Is every component a star around its smallest node?"""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").head(1)


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_low(both, 2 * n)[0].where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(e: DataFrame, n: int) -> DataFrame:
    joined, low = _with_low(e, n)
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # hook the roots of both ends to the smaller label, then jump to the root of roots
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            far = new[new]
            if np.array_equal(far, new):
                break
            new = far
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        nodes, low = smallest_reachable(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(low, pa.int64())], names=["id", "component"])


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 60, small: int = 0) -> DataFrame:
    """``(id, component)`` for every node that has an edge; ``component`` is the smallest id of it.

    ``small``: up to so many distinct edges are solved in one task.
    Null endpoints and loops are no edges: a node with only a loop does not appear.  Repeated and
    reversed edges count once.  An empty edge table gives an empty result.
    """
    e = (
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct()
    )
    e = cut(e)
    n = e.count()
    if small and n <= small:
        return e.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_in_one_task, "id long, component long")
    for _ in range(max_rounds):
        if not n or _settled(e):
            break
        e = cut(_small_star(_large_star(e, n), n))
        n = e.count()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops.select("id", F.col("id").alias("component")))
