"""Superwords: routing islands to solvers, solving them, and slicing islands that are too large for one task."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.bytesview import max_overlap
from lexiloom.operators.kernels.exact import MOST, solve_exact
from lexiloom.operators.kernels.genetic import Settings, Telemetry, solve_genetic
from lexiloom.operators.kernels.greedy import solve_greedy
from lexiloom.operators.kernels.paths import join_path
from lexiloom.plans.running import running
from lexiloom.plans.stash import dealt, stash

#: Words per slice of a large island; the least budget that starts the genetic solver; shares and bounds of a remix.
SLICE, LEAST_SECONDS = 20_000, 0.010
SEED_STEP = 1_000_003  # between the seeds of populations side by side
FIRST_SHARE, REMIX_SHARE, REMIX_PART, REMIX_RATIO = 0.60, 0.15, 5, 0.85


@dataclass(frozen=True)
class Options:
    min_overlap: int = 3
    dp_limit: int = 15
    ga_seconds: float = 0.0
    ga: Settings | None = None
    slice_words: int = SLICE
    verbose: bool = False
    #: Up to so many overlap links find their islands in one task instead of in rounds: the same islands, fewer jobs for a small vocabulary.
    one_task_links: int = 0
    #: Genetic populations of an island side by side, of which the shortest result wins; 0: as many as its budget allows (1 without a time).
    populations: int = 0

    def __post_init__(self) -> None:
        if self.dp_limit > MOST:
            raise ValueError(f"dp limit {self.dp_limit} exceeds the exact solver's {MOST} words")

    def genetic(self) -> Settings | None:
        if self.ga is not None:
            return self.ga
        return Settings(seconds=self.ga_seconds) if self.ga_seconds > 0 else None

    def ga_time(self) -> float:
        """Seconds that the whole genetic search may take, 0 if it is bounded by iterations or off."""
        ga = self.genetic()
        return float(ga.seconds or 0.0) if ga else 0.0


def ga_budgets(sizes: DataFrame, seconds: float, workers: int, dp_limit: int) -> DataFrame:
    """Add ``budget``: seconds * workers, shared over the islands beyond ``dp_limit`` by the square of ``size``; others 0."""
    over = F.when(F.col("size") > dp_limit, F.col("size").cast("double") * F.col("size"))
    total = sizes.agg(F.sum(over).alias("t")).first()["t"]
    if not total:
        return sizes.withColumn("budget", F.lit(0.0))
    return sizes.withColumn("budget", F.coalesce(over * F.lit(float(seconds) * workers) / F.lit(total), F.lit(0.0)))


def wall_and_cores(budget: Column, seconds: Column | float) -> tuple[Column, Column]:
    """Wall time of one island and the number of populations it may run at once."""
    wall = F.least(F.lit(seconds).cast("double"), budget)
    return wall, F.greatest(F.lit(1), F.floor(budget / F.when(wall > 0, wall))).cast("int")


def routing(sizes: DataFrame, dp_limit: int = 15, genetic: bool = False) -> DataFrame:
    """Add ``solver`` to (island_id, size): single, exact, genetic or greedy."""
    rest = F.lit("genetic") if genetic else F.lit("greedy")
    return sizes.withColumn("solver", F.when(F.col("size") == 1, "single").when(F.col("size") <= dp_limit, "exact").otherwise(rest))


def pair_superwords(pairs: DataFrame) -> DataFrame:
    """(first, second) to (sw, second_first, ov): the shorter join of two words; a tie puts the second first."""
    ahead, back = max_overlap(F.col("first"), F.col("second")), max_overlap(F.col("second"), F.col("first"))
    sized = pairs.withColumns({"_a": ahead, "_b": back})
    turned = F.col("_a") <= F.col("_b")
    tail = lambda w, n: F.substring(w, n + 1, F.length(w))
    text = F.when(turned, F.concat("second", tail(F.col("first"), F.col("_b")))).otherwise(F.concat("first", tail(F.col("second"), F.col("_a"))))
    return sized.withColumns({"sw": text, "second_first": turned, "ov": F.when(turned, F.col("_b")).otherwise(F.col("_a"))}).drop("_a", "_b")


_SOLVED = "grp string, id long, start long, ov int, seq int, sw string, solver string, pop int"


def _solver(options: Options):
    ga, limit = options.genetic(), options.dp_limit
    log = Telemetry() if options.verbose else None

    def solve(ids: list[int], texts: list[str], rows: list[tuple], grp: str, pop: int, seconds: float, may_exact: bool) -> None:
        words = [t.encode("latin-1") for t in texts]
        if len(words) == 1:
            path, gains, name = [0], [0], "single"
        elif may_exact and len(words) <= limit:
            (path, gains), name = solve_exact(words), "exact"
        elif ga is not None and (ga.seconds is None or seconds >= LEAST_SECONDS):
            own = replace(ga, seed=ga.seed + pop * SEED_STEP, seconds=None if ga.seconds is None else seconds)
            (path, gains), name = solve_genetic(words, options.min_overlap, own, log), "genetic"
        else:
            (path, gains), name = solve_greedy(words, options.min_overlap), "greedy"
        text, starts = join_path(words, path, gains)
        for seq, (i, gain, start) in enumerate(zip(path, gains, starts, strict=True)):
            rows.append((grp, ids[i], start, gain, seq, text.decode("latin-1") if seq == 0 else None, name, pop))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32())
        names = ["grp", "id", "start", "ov", "seq", "sw", "solver", "pop"]
        current, held, rows = None, ([], []), []

        def flush() -> pa.RecordBatch:
            done = pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
            rows.clear()
            return done

        for batch in batches:
            for grp, pop, word, text, seconds, exact in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if current is None or (grp, pop) != current[:2]:
                    if current is not None:
                        solve(*held, rows, *current)
                    current, held = (grp, pop, seconds, exact), ([], [])
                held[0].append(word)
                held[1].append(text)
            if len(rows) > 50_000:
                yield flush()
        if current is not None:
            solve(*held, rows, *current)
        if rows:
            yield flush()

    return run


def _populations(options: Options, seconds: Column, budget: Column, limit: int) -> tuple[Column, Column]:
    """(seconds, populations) of a group of ``size`` words that may use ``budget`` core seconds within ``seconds``."""
    ga = options.genetic()
    if ga is None:
        return F.lit(0.0), F.lit(1)
    wall, cores = (F.lit(0.0), F.lit(1)) if ga.seconds is None else wall_and_cores(budget, seconds)
    many = F.lit(options.populations) if options.populations else cores
    return wall, F.when((F.col("size") > limit) & ((wall >= LEAST_SECONDS) | F.lit(ga.seconds is None)), many).otherwise(1)


def _solve_groups(rows: DataFrame, options: Options, name: str) -> DataFrame:
    """``rows``: grp, id, b, ord, seconds, exact, pops.  Each group meets in one task, in the order of ``ord``.

    A group with several populations is solved by as many tasks, each with a seed of its own; the shortest superword wins, ties go to the
    first population, so results by iterations don't depend on how groups are dealt.
    """
    if options.genetic() is None:
        parted = rows.withColumn("pop", F.lit(0)).repartition("grp")
    else:  # a fixed number of partitions: small ones put together would search one after the other
        spark = rows.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        parted = rows.withColumn("pop", F.explode(F.sequence(F.lit(0), (F.col("pops") - 1).cast("int")))).repartition(n, "grp", "pop")
    solved = stash(parted.sortWithinPartitions("grp", "pop", "ord").select("grp", "pop", "id", "b", "seconds", "exact").mapInArrow(_solver(options), _SOLVED), name)
    if options.genetic() is None:
        return solved
    best = solved.where("seq = 0").groupBy("grp").agg(F.min_by("pop", F.struct(F.length("sw"), F.col("pop"))).alias("pop"))
    return solved.join(dealt(best), ["grp", "pop"], "left_semi")


def assemble(words: DataFrame, members: DataFrame, options: Options | None = None, workers: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(superwords, places): island_id, sw, solver — and id, island_id, start (the word's byte place in its superword).

    ``words``: id, b; ``members``: id, island_id.  Single words and pairs stay in SQL.  Islands of up to ``slice_words`` words go to
    a kernel, each as one group; larger ones are sorted bytewise, cut into slices that are solved like islands, and the slices' superwords
    are the words of the next round.  ``workers`` cores share the genetic solver's time (default: the session's parallelism).
    """
    options = options or Options()
    workers = workers or words.sparkSession.sparkContext.defaultParallelism
    both = stash(words.join(dealt(members), "id").select("id", "island_id", "b"), "island-words")
    sizes = both.groupBy("island_id").agg(F.count("*").alias("size"))
    sized = stash(ga_budgets(sizes, options.ga_time(), workers, options.dp_limit), "island-sizes")
    rows = both.join(dealt(sized), "island_id")
    single = rows.where("size = 1")
    top = single.select("island_id", F.col("b").alias("sw"), F.lit("single").alias("solver"))
    place = single.select("id", "island_id", F.lit(0).cast("long").alias("start"))
    low = 2
    if options.dp_limit >= 2:
        two = rows.where("size = 2").groupBy("island_id").agg(F.min("id").alias("i"), F.max("id").alias("j"), F.min_by("b", "id").alias("first"), F.max_by("b", "id").alias("second"))
        paired = pair_superwords(two)
        top = top.unionByName(paired.select("island_id", "sw", F.lit("exact").alias("solver")))
        one, other = F.when(F.col("second_first"), F.col("j")).otherwise(F.col("i")), F.when(F.col("second_first"), F.col("i")).otherwise(F.col("j"))
        ahead = F.length(F.when(F.col("second_first"), F.col("second")).otherwise(F.col("first"))) - F.col("ov")
        spots = F.inline(F.array(F.struct(one.alias("id"), F.lit(0).cast("long").alias("start")), F.struct(other.alias("id"), ahead.cast("long").alias("start"))))
        place = place.unionByName(paired.select("island_id", spots).select("id", "island_id", "start"))
        low = 3
    middle = rows.where((F.col("size") >= low) & (F.col("size") <= options.slice_words))
    seconds, pops = _populations(options, F.lit(options.ga_time()), F.col("budget"), options.dp_limit)
    solved = _solve_groups(middle.select(F.col("island_id").cast("string").alias("grp"), "id", "b", F.col("id").alias("ord"), seconds.alias("seconds"), F.lit(True).alias("exact"), pops.alias("pops")), options, "solved")
    top = top.unionByName(solved.where("seq = 0").select(F.col("grp").cast("long").alias("island_id"), "sw", "solver"))
    place = place.unionByName(solved.select("id", F.col("grp").cast("long").alias("island_id"), "start"))
    giant = rows.where(F.col("size") > options.slice_words)
    if giant.head(1):
        more_top, more_place = _assemble_giants(giant.select("id", "island_id", "b", "budget"), options)
        top, place = top.unionByName(more_top), place.unionByName(more_place)
    return top, place


def _assemble_giants(giant: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    place = giant.select("id", "island_id", F.col("id").alias("piece"), F.lit(0).cast("long").alias("start"))
    pieces = giant.select("island_id", F.col("id").alias("piece"), "b", "budget")
    ga, total, began = options.genetic(), options.ga_time(), time.monotonic()
    while True:
        left = max(LEAST_SECONDS, total - (time.monotonic() - began))  # a deeper level has the time that is left
        # the exact row number in bytewise order decides the slice, as the order of words decides ties
        numbered = running(pieces, [F.col("b"), F.col("piece")], group=["island_id"], out="rn")
        sliced = stash(numbered.withColumn("slice", F.floor(F.col("rn") / options.slice_words).cast("long")), "slices")
        solved = _solve_slices(sliced, options, left, FIRST_SHARE)
        if ga is not None:
            solved = _remix(sliced, solved, options, left)
        made = solved.where("seq = 0").select("island_id", F.col("slice").alias("piece"), F.col("sw").alias("b"))
        joined = place.join(dealt(solved.select("island_id", F.col("id").alias("piece"), "slice", F.col("start").alias("more"))), ["island_id", "piece"])
        place = stash(joined.select("id", "island_id", F.col("slice").alias("piece"), (F.col("start") + F.col("more")).alias("start")), "places")
        budgets = pieces.groupBy("island_id").agg(F.max("budget").alias("budget"))
        pieces = stash(made.join(budgets, "island_id").select("island_id", "piece", "b", "budget"), "pieces")
        if not pieces.groupBy("island_id").count().where("count > 1").head(1):
            name = "genetic" if ga is not None else "greedy"
            return pieces.select("island_id", F.col("b").alias("sw"), F.lit(name).alias("solver")), place.select("id", "island_id", "start")


def _solve_slices(sliced: DataFrame, options: Options, left: float, share: float) -> DataFrame:
    """Solve each slice.  The slices of an island have the ``share`` of the ``left`` seconds and of the island's cores; a last one alone has all."""
    total = options.ga_time()
    sizes = sliced.groupBy("island_id", "slice").agg(F.count("*").alias("size"))
    counts = sizes.groupBy("island_id").agg(F.count("*").alias("slices"))
    own = sliced.join(sizes, ["island_id", "slice"]).join(counts, "island_id")
    level = F.when(F.col("slices") > 1, share * left).otherwise(left)
    seconds, pops = _populations(options, level, F.col("budget") * level / F.lit(total or 1.0) / F.col("slices"), 2)
    grouped = own.select(F.concat_ws(":", "island_id", "slice").alias("grp"), F.col("piece").alias("id"), "b", F.col("rn").alias("ord"), seconds.alias("seconds"), F.lit(False).alias("exact"), pops.alias("pops"))
    solved = _solve_groups(grouped, options, "slice-solved")
    parts = F.split("grp", ":")
    return solved.select(parts[0].cast("long").alias("island_id"), parts[1].cast("long").alias("slice"), "id", "start", "seq", "sw")


def slice_ratios(sliced: DataFrame, solved: DataFrame) -> DataFrame:
    """Compression ratio of each slice: bytes of its superword over bytes of its words."""
    before = sliced.groupBy("island_id", "slice").agg(F.sum(F.length("b")).alias("bytes_in"))
    after = solved.where("seq = 0").select("island_id", "slice", F.length("sw").alias("bytes_out"))
    return before.join(after, ["island_id", "slice"]).withColumn("ratio", F.when(F.col("bytes_in") > 0, F.col("bytes_out") / F.col("bytes_in")).otherwise(1.0))


def _remix(sliced: DataFrame, solved: DataFrame, options: Options, left: float) -> DataFrame:
    """Pool the words of the worst fifth of at least three slices, deal them anew and keep the result where it is shorter."""
    from pyspark.sql import Window as W

    ratios = stash(slice_ratios(sliced, solved), "ratios")  # one row per slice
    own = W.partitionBy("island_id")
    ranked = ratios.withColumn("n", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("ratio"), "slice")))
    worst = ranked.where((F.col("n") >= 3) & (F.col("ratio") > REMIX_RATIO) & (F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / REMIX_PART)))).select("island_id", "slice", "bytes_out", "rank")
    if not worst.head(1):
        return solved
    picks = worst.groupBy("island_id").agg(F.sort_array(F.collect_list("slice")).alias("to"), F.sum("bytes_out").alias("old"))
    pool = sliced.join(worst.select("island_id", "slice"), ["island_id", "slice"]).join(picks, "island_id")
    mixed = pool.withColumn("slice", F.get("to", F.pmod(F.xxhash64("piece", "b"), F.size("to")).cast("int"))).select(*sliced.columns)
    again = _solve_slices(stash(mixed, "remix"), options, left * REMIX_SHARE, 1.0)
    gain = again.where("seq = 0").groupBy("island_id").agg(F.sum(F.length("sw")).alias("new")).join(picks, "island_id").where("new < old").select("island_id", F.explode("to").alias("slice"))
    gain = stash(gain, "remix-kept")
    return solved.join(gain, ["island_id", "slice"], "left_anti").unionByName(again.join(gain, ["island_id", "slice"], "left_semi"))
