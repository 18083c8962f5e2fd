"""Running numbers and sums over a whole table without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.plans.stash import stash


def running(df: DataFrame, order: list[Column], weight: str | None = None, group: list[str] | None = None, out: str = "base", parts: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``weight`` (default: one) over the rows before, in ``order``, of the same ``group``.

    The rows are range-partitioned and written to the shared folder, so partition numbers stay fixed.  One sum per (partition,
    group) is accumulated over the partitions; inside a partition a window adds the rest.
    """
    group = group or []
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.withColumn("_w", F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(1).cast("long"))
    keys = [F.col(g) for g in group] + order
    named = named.withColumns({f"_o{i}": c for i, c in enumerate(keys)})
    ranged = named.repartitionByRange(n, *[F.col(f"_o{i}").asc_nulls_first() for i in range(len(keys))])
    fixed = stash(ranged.withColumn("_part", F.spark_partition_id()), "running")
    sums = fixed.groupBy("_part", *group).agg(F.sum("_w").alias("_s"))
    ahead = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1) if group else W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.withColumn("_b", F.coalesce(F.sum("_s").over(ahead), F.lit(0))).drop("_s")
    inside = W.partitionBy("_part", *group).orderBy(*[F.col(f"_o{i}").asc_nulls_first() for i in range(len(keys))]).rowsBetween(W.unboundedPreceding, -1)
    run = fixed.withColumn("_r", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    match = run["_part"] == bases["_part"]
    for g in group:
        match = match & run[g].eqNullSafe(bases[g])
    few = bases.select("_part", *group, "_b")
    joined = run.join(few if group else F.broadcast(few), match)  # without groups one row per partition
    return joined.select(*[run[c] for c in df.columns], (run["_r"] + bases["_b"]).cast("long").alias(out))
