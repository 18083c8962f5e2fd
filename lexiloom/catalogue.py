"""Queries of the dictionary engine over the driver tables, and the same in DuckDB SQL.

Every query runs over its whole table.  Byte strings are returned as upper-case hex.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.bytesview import bits_needed, from_text, max_overlap, prefix_function, to_hex, to_text, uleb128_hex, uleb128_size
from lexiloom.operators import assembly, containment, layout, membership, merging, overlaps, vocabulary
from lexiloom.operators.kernels.genetic import Settings
from lexiloom.plans.build import Dictionary, build_dictionary
from lexiloom.plans.stash import shared_dir, stash
from lexiloom.sources import archive, text

POSITIONS = 1 << 21
#: The vocabularies of these queries are small: so many links find their islands in one task, as a caller of the engine may ask for.
ONE_TASK = 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text; a table in fewer pieces than there are cores is dealt out first, since its words are many times its rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def work_file(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, which the driver writes and executors read."""
    return f"{shared_dir(spark)}/archives/{uuid.uuid4().hex}-{name}"


# --- corpora -------------------------------------------------------------------------------------------------


def words_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus of all letter runs of all documents, numbered by document and place."""
    words = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("i", "w"))
    number = F.when(F.col("i") < POSITIONS, F.col("doc_id") * POSITIONS + F.col("i")).otherwise(F.raise_error(F.lit(f"a document of more than {POSITIONS} words")).cast("long"))
    return words.select(number.alias("line_no"), from_text(F.col("w")).alias("b"))


def names_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.corpus_of(_table(spark, sf_dir, "part"), "p_partkey", "p_name")


def names_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.corpus_of(_table(spark, sf_dir, "customer"), "c_custkey", "c_name")


_WORDS = r"""SELECT doc_id * 2097152 + i - 1 AS line_no, w FROM (
  SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS x FROM documents))"""
_VOCAB = f"SELECT w, hex(encode(w)) AS h, min(line_no) AS id FROM ({_WORDS}) GROUP BY w"
_SUBS = "SELECT DISTINCT substr(h, 2 * i + 1, 2 * l) AS s FROM (SELECT h, i, unnest(range(1, length(h) // 2 - i + 1)) AS l FROM (SELECT h, unnest(range(0, length(h) // 2)) AS i FROM v)) WHERE 2 * l < length(h)"
_PARTS = "SELECT p_name AS w, min(p_partkey) AS id FROM part GROUP BY p_name"


# --- rows ----------------------------------------------------------------------------------------------------


def dedup_first(spark, sf_dir):
    vocab = vocabulary.distinct_first(words_of_documents(spark, sf_dir))
    return vocab.select(to_hex(F.col("b")).alias("b_hex"), F.col("id").alias("first_line"))


def survivors(spark, sf_dir):
    kept = containment.survivors(stash(vocabulary.distinct_first(words_of_documents(spark, sf_dir)), "vocabulary"))
    return kept.select("id", to_hex(F.col("b")).alias("b_hex"))


def containment_pairs(spark, sf_dir):
    words = _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "w"))
    vocab = vocabulary.distinct_first(words.select((F.col("p_partkey") * 16 + F.col("i")).alias("line_no"), from_text(F.col("w")).alias("b")))
    every = vocab.unionByName(vocabulary.distinct_first(names_of_parts(spark, sf_dir)).select((-F.col("id") - 1).alias("id"), "b"))
    distinct = every.groupBy("b").agg(F.max("id").alias("id")).select("id", "b")
    return containment.contained_pairs(distinct).select("id", "hid", F.col("pos").cast("long").alias("pos"))


def overlap_scalar(spark, sf_dir):
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    pairs = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_name", "r_name")
    a, b = from_text(F.col("n_name")), from_text(F.col("r_name"))
    return pairs.select("n_name", "r_name", max_overlap(a, b).cast("long").alias("forward"), max_overlap(b, a).cast("long").alias("backward"), max_overlap(a, a).cast("long").alias("own"))


def overlap_pairs_k3(spark, sf_dir):
    vocab = vocabulary.distinct_first(names_of_parts(spark, sf_dir))
    return overlaps.overlap_pairs(vocab, 3).select("u", "v", F.col("ov").cast("long").alias("ov"))


def overlap_pairs_k8(spark, sf_dir):
    vocab = vocabulary.distinct_first(words_of_documents(spark, sf_dir))
    return overlaps.overlap_pairs(vocab, 8).select("u", "v", F.col("ov").cast("long").alias("ov"))


def strongest_overlaps(spark, sf_dir):
    vocab = stash(vocabulary.distinct_first(words_of_documents(spark, sf_dir)), "vocabulary")
    return overlaps.strongest_pairs(vocab, 8, 100).select("u", "v", F.col("ov").cast("long").alias("ov"))


def _part_islands(spark, sf_dir):
    vocab = stash(vocabulary.distinct_first(names_of_parts(spark, sf_dir)), "parts")
    return vocab, stash(overlaps.islands(vocab, 3), "islands")


def islands_parts(spark, sf_dir):
    return _part_islands(spark, sf_dir)[1]


def island_sizes(spark, sf_dir):
    return _part_islands(spark, sf_dir)[1].groupBy("island_id").agg(F.count("*").alias("size"))


def island_count(spark, sf_dir):
    return overlaps.island_count(_part_islands(spark, sf_dir)[1])


def islands_words(spark, sf_dir):
    vocab = stash(vocabulary.distinct_first(words_of_documents(spark, sf_dir)), "vocabulary")
    kept = stash(containment.survivors(vocab), "survivors")
    return overlaps.islands(kept, 5, ONE_TASK)


def solver_routing(spark, sf_dir):
    sizes = island_sizes(spark, sf_dir)
    return assembly.routing(sizes, dp_limit=15)


def ga_budgets(spark, sf_dir):
    sizes = _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("island_id")).agg(F.count("*").alias("size"))
    out = assembly.ga_budgets(sizes, 60.0, 8, 15)
    wall, cores = assembly.wall_and_cores(F.col("budget"), 60.0)
    return out.select("island_id", "size", F.round("budget", 6).alias("budget"), F.round(wall, 6).alias("wall"), cores.cast("long").alias("cores"))


def dp_pairs(spark, sf_dir):
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    pairs = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", from_text(F.col("n_name")).alias("first"), from_text(F.col("r_name")).alias("second"))
    return assembly.pair_superwords(pairs).select(F.col("n_nationkey").cast("long").alias("id"), to_text(F.col("sw")).alias("sw"), "second_first")


def dp_optimal_length(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    words = stash(nation.select(F.col("n_nationkey").cast("long").alias("id"), from_text(F.col("n_name")).alias("b")), "nations")
    members = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("island_id"))
    tops, _ = assembly.assemble(words, members)
    return tops.select("island_id", F.length("sw").cast("long").alias("len"))


def _checked(built: DataFrame, places: DataFrame, words: DataFrame, members: DataFrame) -> DataFrame:
    """Per island: words, words that are not where they should be, superword no longer than its words."""
    at = places.join(built, "island_id").join(words, "id").withColumn("bad", (F.substring(F.col("sw"), (F.col("start") + 1).cast("int"), F.length("b")) != F.col("b")).cast("long"))
    return at.groupBy("island_id").agg(F.count("*").alias("n"), F.sum("bad").alias("missing"), (F.max(F.length("sw")) <= F.sum(F.length("b"))).alias("no_longer"))


def greedy_invariants(spark, sf_dir):
    vocab, members = _part_islands(spark, sf_dir)
    tops, places = assembly.assemble(vocab, members, assembly.Options(dp_limit=1))
    return _checked(tops, places, vocab, members)


def hierarchical_invariants(spark, sf_dir):
    vocab, members = _part_islands(spark, sf_dir)
    tops, places = assembly.assemble(vocab, members, assembly.Options(dp_limit=1, slice_words=8))
    return _checked(tops, places, vocab, members)


def ga_not_worse(spark, sf_dir):
    vocab, members = _part_islands(spark, sf_dir)
    greedy, _ = assembly.assemble(vocab, members, assembly.Options(dp_limit=1))
    tops, places = assembly.assemble(vocab, members, assembly.Options(dp_limit=1, ga=Settings(max_iters=300, seed=5)))
    both = _checked(tops, places, vocab, members).join(tops.select("island_id", F.length("sw").alias("a")), "island_id").join(greedy.select("island_id", F.length("sw").alias("g")), "island_id")
    return both.select("island_id", "n", "missing", (F.col("a") <= F.col("g")).alias("not_worse"))


def _customer_layout(spark, sf_dir):
    vocab = vocabulary.distinct_first(names_of_customers(spark, sf_dir))
    return stash(layout.place_superwords(vocab.select("id", F.col("b").alias("sw"))), "layout")


def layout_offsets(spark, sf_dir):
    return _customer_layout(spark, sf_dir).select(to_text(F.col("sw")).alias("sw"), "len", F.col("base").alias("offset"))


def footer_deltas(spark, sf_dir):
    rows = _customer_layout(spark, sf_dir).select(F.col("len").alias("length"), F.col("base").alias("offset"))
    return layout.footer_deltas(rows).select("length", "offset", "delta", F.col("delta_bytes").cast("long").alias("delta_bytes"), "delta_hex")


def ordered_entry_bits(spark, sf_dir):
    placed = _customer_layout(spark, sf_dir)
    offsets = placed.select(F.col("sw").alias("b"), F.col("base").alias("offset"))
    lines = layout.ordered_lines(names_of_customers(spark, sf_dir), offsets)
    payload = placed.agg(F.sum("len").alias("n")).first()["n"] or 0
    return layout.entry_bits(lines, payload).select("longest", "n_lines", F.col("length_bits").cast("long").alias("length_bits"), F.col("offset_bits").cast("long").alias("offset_bits"))


def uleb128(spark, sf_dir):
    n = F.col("n")
    keys = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") * F.col("o_custkey")).alias("n")).distinct()
    return keys.select("n", uleb128_hex(n).alias("uleb_hex"), uleb128_size(n).cast("long").alias("size"), bits_needed(n).cast("long").alias("bits"))


def lps(spark, sf_dir):
    vocab = vocabulary.distinct_first(names_of_parts(spark, sf_dir))
    return vocab.select(to_text(F.col("b")).alias("name"), F.array_join(prefix_function(F.col("b")).cast("array<string>"), ",").alias("lps"))


def multi_pattern_hits(spark, sf_dir):
    patterns = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), from_text(F.col("text")).alias("b"))
    docs = _documents(spark, sf_dir).select("doc_id", from_text(F.col("text")).alias("b"))
    hits = containment.multi_pattern(patterns, docs)
    return hits.select("doc_id", "pattern_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


# --- archives ------------------------------------------------------------------------------------------------


def _written(spark, built: Dictionary, name: str) -> str:
    path = work_file(spark, name)
    built.write(path)
    return path


def archive_ordered_roundtrip(spark, sf_dir):
    path = _written(spark, build_dictionary(names_of_parts(spark, sf_dir)), "parts")
    return archive.read_archive(spark, path).select("ordinal", to_text(F.col("b")).alias("word"), "length")


def archive_roundtrip(spark, sf_dir):
    path = _written(spark, build_dictionary(words_of_documents(spark, sf_dir), assembly.Options(one_task_links=ONE_TASK), ordered=False), "words")
    return archive.read_archive(spark, path).select(to_hex(F.col("b")).alias("b_hex"), "length")


def archive_header(spark, sf_dir):
    path = _written(spark, build_dictionary(names_of_customers(spark, sf_dir)), "customers")
    head = archive.read_header(path)
    return spark.createDataFrame([(head.version, head.separator.hex().upper(), head.ordered, head.footer)], "version long, separator_hex string, is_ordered boolean, footer_offset long")


def search_batch(spark, sf_dir):
    entries = stash(vocabulary.distinct_first(words_of_documents(spark, sf_dir)), "vocabulary")
    both = [F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (r"[A-Za-z]{1,6}", r"\p{L}+")]  # whole words, and pieces that may be none
    asked = _table(spark, sf_dir, "benchmark").select(F.explode(F.concat(*both)).alias("w"))
    return membership.membership(asked.select(from_text(F.col("w")).alias("b")), entries).select(to_text(F.col("b")).alias("word"), "status")


def merge_split(spark, sf_dir):
    path = _written(spark, build_dictionary(names_of_parts(spark, sf_dir)), "first")
    spots = _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "w"))
    words = spots.groupBy("w").agg(F.min(F.col("p_partkey") * 16 + F.col("i")).alias("line_no"))
    other = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("w"), (-1 - F.col("n_nationkey")).cast("long").alias("line_no"))
    news = words.select("w", "line_no").unionByName(other).select("line_no", from_text(F.col("w")).alias("b"))
    split = merging.split_update(news, archive.payload_table(spark, path, 64))
    return split.select(to_text(F.col("b")).alias("word"), F.col("offset").isNotNull().alias("eliminated"))


def merge_roundtrip(spark, sf_dir):
    a = _written(spark, build_dictionary(names_of_parts(spark, sf_dir), ordered=False), "a")
    b = _written(spark, build_dictionary(names_of_customers(spark, sf_dir)), "b")
    c = work_file(spark, "c")
    merging.merge_archives(spark, a, b).write(c)
    return archive.read_archive(spark, c).select(to_text(F.col("b")).alias("word"), "is_ordered")


def merge_ordered(spark, sf_dir):
    a = _written(spark, build_dictionary(names_of_customers(spark, sf_dir)), "a")
    b = _written(spark, build_dictionary(text.corpus_of(_table(spark, sf_dir, "nation"), "n_nationkey", "n_name")), "b")
    c = work_file(spark, "c")
    merging.merge_archives(spark, a, b).write(c)
    return archive.read_archive(spark, c).select("ordinal", to_text(F.col("b")).alias("word"), "is_ordered")


def tokenizer_ranks(spark, sf_dir):
    path = work_file(spark, "customers.tiktoken")
    text.write_tokenizer(path, names_of_customers(spark, sf_dir).withColumn("rank", F.col("line_no")))
    return text.read_tokenizer(spark, path).select(to_text(F.col("b")).alias("word"), "rank")


def rank_sidecar(spark, sf_dir):
    corpus = names_of_customers(spark, sf_dir).withColumn("rank", F.col("line_no"))
    path = _written(spark, build_dictionary(corpus), "ranks.bin")
    return archive.read_ranks(spark, archive.sidecar_path(path, ".rank"))


def compression_ratio(spark, sf_dir):
    rows = []
    both = build_dictionary(vocabulary.distinct_first(words_of_documents(spark, sf_dir)).select(F.col("id").alias("line_no"), "b"))
    for ordered in (True, False):
        built = replace(both, ordered=ordered)  # the two differ in their footers only
        raw = built.corpus.agg(F.sum(F.length("b") + 1).alias("n")).first()["n"]
        words, payload = built.offsets.count(), built.payload_bytes()
        rows.append((ordered, raw, payload < raw - words, built.write(work_file(spark, "ratio")) > 12 + payload))
    return spark.createDataFrame(rows, "is_ordered boolean, raw_bytes long, payload_shrinks boolean, has_footer boolean")


_ALL = (
    dedup_first, survivors, containment_pairs, overlap_scalar, overlap_pairs_k3, overlap_pairs_k8, strongest_overlaps, islands_parts, island_sizes,
    island_count, islands_words, solver_routing, ga_budgets, dp_pairs, dp_optimal_length, greedy_invariants, hierarchical_invariants, ga_not_worse,
    layout_offsets, footer_deltas, ordered_entry_bits, uleb128, lps, multi_pattern_hits, archive_ordered_roundtrip, archive_roundtrip,
    archive_header, search_batch, merge_split, merge_roundtrip, merge_ordered, tokenizer_ranks, rank_sidecar, compression_ratio,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def _overlap(a: str, b: str) -> str:
    return f"coalesce(list_max(list_filter(range(1, least(length({a}), length({b})) + 1), lambda n: right({a}, n) = left({b}, n))), 0)"


_PART_PAIRS = f"SELECT a.id AS u, b.id AS v, {_overlap('a.w', 'b.w')} AS ov FROM p a JOIN p b ON a.id <> b.id"
_PART_ISLANDS = f"""p AS ({_PARTS}), e AS (SELECT u, v FROM ({_PART_PAIRS}) WHERE ov >= 3),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(id, root) AS (SELECT id, id FROM p UNION SELECT s.u, r.root FROM r JOIN s ON s.v = r.id),
i AS (SELECT id, min(root) AS island_id FROM r GROUP BY id)"""
_ULEB = "array_to_string(list_transform(range(0, size), lambda i: printf('%02X', ((n >> (7 * i)) & 127) + CASE WHEN i < size - 1 THEN 128 ELSE 0 END)), '')"
_SIZE = "(length(bin(n)) + 6) // 7"
_LAYOUT = "SELECT w AS sw, length(w) AS len, CAST(coalesce(sum(length(w)) OVER (ORDER BY length(w) DESC, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT DISTINCT c_name AS w FROM customer)"
_K8 = f"""WITH v AS ({_VOCAB}), k AS (SELECT id, h, unnest(range(8, length(h) // 2 + 1)) AS l FROM v),
a AS (SELECT id AS u, right(h, 2 * l) AS key, l FROM k), b AS (SELECT id AS v, left(h, 2 * l) AS key FROM k)
SELECT u, v, max(l) AS ov FROM a JOIN b USING (key) WHERE u <> v GROUP BY u, v"""


def oracle_sql() -> dict[str, str]:
    perm = " JOIN ".join(f"n AS t{i}" + (f" ON t{i}.r = t0.r AND " + " AND ".join(f"t{i}.id <> t{j}.id" for j in range(i)) if i else "") for i in range(5))
    gain = " + ".join(_overlap(f"t{i}.w", f"t{i + 1}.w") for i in range(4))
    return {
        "dedup_first": f"SELECT h AS b_hex, id AS first_line FROM ({_VOCAB})",
        "survivors": f"WITH v AS MATERIALIZED ({_VOCAB}), x AS MATERIALIZED ({_SUBS}) SELECT id, h AS b_hex FROM v ANTI JOIN x ON x.s = v.h",
        "containment_pairs": """WITH t AS (SELECT p_partkey, unnest(x) AS w, generate_subscripts(x, 1) - 1 AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS x FROM part)),
v AS (SELECT w, max(id) AS id FROM (SELECT w, min(p_partkey * 16 + i) AS id FROM t GROUP BY w UNION ALL SELECT p_name, -min(p_partkey) - 1 FROM part GROUP BY p_name) GROUP BY w)
SELECT id, hid, pos FROM (SELECT a.id, b.id AS hid, a.w, b.w AS h, unnest(range(0, length(b.w))) AS pos FROM v a JOIN v b ON a.id <> b.id AND contains(b.w, a.w)) WHERE w <> '' AND substr(h, pos + 1, length(w)) = w""",
        "overlap_scalar": f"SELECT n_name, r_name, {_overlap('n_name', 'r_name')} AS forward, {_overlap('r_name', 'n_name')} AS backward, length(n_name) AS own FROM nation JOIN region ON n_regionkey = r_regionkey",
        "overlap_pairs_k3": f"WITH p AS ({_PARTS}) SELECT u, v, ov FROM ({_PART_PAIRS}) WHERE ov >= 3",
        "overlap_pairs_k8": _K8,
        "strongest_overlaps": f"SELECT * FROM ({_K8}) ORDER BY ov DESC, u, v LIMIT 100",
        "islands_parts": f"WITH RECURSIVE {_PART_ISLANDS} SELECT id, island_id FROM i",
        "island_sizes": f"WITH RECURSIVE {_PART_ISLANDS} SELECT island_id, count(*) AS size FROM i GROUP BY island_id",
        "island_count": f"WITH RECURSIVE {_PART_ISLANDS} SELECT count(DISTINCT island_id) AS islands, count(*) AS words FROM i",
        "islands_words": f"""WITH RECURSIVE v AS MATERIALIZED ({_VOCAB}), x AS MATERIALIZED ({_SUBS}), w AS MATERIALIZED (SELECT id, h FROM v ANTI JOIN x ON x.s = v.h),
k AS MATERIALIZED (SELECT id, h, unnest(range(5, length(h) // 2 + 1)) AS l FROM w),
s AS MATERIALIZED (SELECT id, right(h, 2 * l) AS key, 1 AS s, 0 AS p FROM k UNION ALL SELECT id, left(h, 2 * l), 0, 1 FROM k),
y AS MATERIALIZED (SELECT key, min(id) AS low FROM s GROUP BY key HAVING max(s) = 1 AND max(p) = 1 AND min(id) < max(id)),
e AS MATERIALIZED (SELECT DISTINCT s.id AS u, y.low AS v FROM s JOIN y USING (key) WHERE s.id <> y.low),
b AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(id, island_id) USING KEY (id) AS (SELECT id, id FROM w UNION
  SELECT b.u, min(r.island_id) FROM r JOIN b ON b.v = r.id JOIN recurring.r AS o ON o.id = b.u WHERE r.island_id < o.island_id GROUP BY b.u)
SELECT id, island_id FROM r""",
        "solver_routing": f"WITH RECURSIVE {_PART_ISLANDS} SELECT island_id, count(*) AS size, CASE WHEN count(*) = 1 THEN 'single' WHEN count(*) <= 15 THEN 'exact' ELSE 'greedy' END AS solver FROM i GROUP BY island_id",
        "ga_budgets": """WITH s AS (SELECT CAST(c_nationkey AS BIGINT) AS island_id, count(*) AS size FROM customer GROUP BY c_nationkey),
b AS (SELECT island_id, size, CASE WHEN size > 15 THEN size * size * 480.0::DOUBLE / (SELECT sum(size * size)::DOUBLE FROM s WHERE size > 15) ELSE 0 END AS b FROM s)
SELECT island_id, size, round(b, 6) AS budget, round(least(60.0::DOUBLE, b), 6) AS wall, CASE WHEN b > 0 THEN greatest(1, CAST(floor(b / least(60.0::DOUBLE, b)) AS BIGINT)) ELSE 1 END AS cores FROM b""",
        "dp_pairs": f"""SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN f > b THEN n_name || substr(r_name, f + 1) ELSE r_name || substr(n_name, b + 1) END AS sw, f <= b AS second_first
FROM (SELECT n_nationkey, n_name, r_name, {_overlap('n_name', 'r_name')} AS f, {_overlap('r_name', 'n_name')} AS b FROM nation JOIN region ON n_regionkey = r_regionkey)""",
        "dp_optimal_length": f"WITH n AS (SELECT n_regionkey AS r, n_nationkey AS id, n_name AS w FROM nation) SELECT CAST(t0.r AS BIGINT) AS island_id, min(length(t0.w) + length(t1.w) + length(t2.w) + length(t3.w) + length(t4.w) - ({gain})) AS len FROM {perm} GROUP BY t0.r",
        "greedy_invariants": f"WITH RECURSIVE {_PART_ISLANDS} SELECT island_id, count(*) AS n, CAST(0 AS BIGINT) AS missing, true AS no_longer FROM i GROUP BY island_id",
        "hierarchical_invariants": f"WITH RECURSIVE {_PART_ISLANDS} SELECT island_id, count(*) AS n, CAST(0 AS BIGINT) AS missing, true AS no_longer FROM i GROUP BY island_id",
        "ga_not_worse": f"WITH RECURSIVE {_PART_ISLANDS} SELECT island_id, count(*) AS n, CAST(0 AS BIGINT) AS missing, true AS not_worse FROM i GROUP BY island_id",
        "layout_offsets": _LAYOUT,
        "footer_deltas": f"SELECT length, \"offset\", n AS delta, size AS delta_bytes, {_ULEB} AS delta_hex FROM (SELECT *, {_SIZE} AS size FROM (SELECT len AS length, \"offset\", \"offset\" - coalesce(lag(\"offset\") OVER (PARTITION BY len ORDER BY \"offset\"), 0) AS n FROM ({_LAYOUT})))",
        "ordered_entry_bits": "SELECT max(length(c_name)) AS longest, count(*) AS n_lines, length(bin(max(length(c_name)))) AS length_bits, length(bin((SELECT CAST(sum(length(w)) AS BIGINT) FROM (SELECT DISTINCT c_name AS w FROM customer)))) AS offset_bits FROM customer",
        "uleb128": f"SELECT n, {_ULEB} AS uleb_hex, size, length(bin(n)) AS bits FROM (SELECT n, {_SIZE} AS size FROM (SELECT DISTINCT o_orderkey * o_custkey AS n FROM orders))",
        "lps": f"SELECT w AS name, array_to_string(list_transform(range(1, length(w) + 1), lambda n: coalesce(list_max(list_filter(range(1, n), lambda b: left(w, b) = substr(w, n - b + 1, b))), 0)), ',') AS lps FROM ({_PARTS})",
        "multi_pattern_hits": """SELECT doc_id, pattern_id, strlen(substr(t, 1, p)) AS start, strlen(substr(t, 1, p)) + strlen(x) - 1 AS "end" FROM (
  SELECT d.doc_id, b.item_id AS pattern_id, d.text AS t, b.text AS x, unnest(range(0, length(d.text))) AS p FROM documents d JOIN benchmark b ON contains(d.text, b.text)) WHERE substr(t, p + 1, length(x)) = x""",
        "archive_ordered_roundtrip": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal, p_name AS word, strlen(p_name) AS length FROM part",
        "archive_roundtrip": f"SELECT h AS b_hex, length(h) // 2 AS length FROM ({_VOCAB})",
        "archive_header": "SELECT CAST(2 AS BIGINT) AS version, '0A' AS separator_hex, true AS is_ordered, 12 + CAST(sum(length(w)) AS BIGINT) AS footer_offset FROM (SELECT DISTINCT c_name AS w FROM customer)",
        "search_batch": rf"""WITH v AS ({_VOCAB}), x AS ({_SUBS}), q AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{1,6}}') || regexp_extract_all(text, '\p{{L}}+')) AS w FROM benchmark)
SELECT w AS word, CASE WHEN w IN (SELECT w FROM v) THEN 'member' WHEN hex(encode(w)) IN (SELECT s FROM x) THEN 'substring' ELSE 'absent' END AS status FROM q""",
        "merge_split": "SELECT w AS word, EXISTS (SELECT 1 FROM part WHERE contains(p_name, w)) AS eliminated FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT n_name FROM nation)",
        "compression_ratio": f"SELECT o AS is_ordered, raw_bytes, true AS payload_shrinks, true AS has_footer FROM (SELECT CAST(sum(strlen(w) + 1) AS BIGINT) AS raw_bytes FROM ({_VOCAB})), (VALUES (true), (false)) AS t(o)",
        "merge_roundtrip": "SELECT w AS word, false AS is_ordered FROM (SELECT p_name AS w FROM part UNION SELECT c_name FROM customer)",
        "merge_ordered": "SELECT row_number() OVER (ORDER BY src, k) - 1 AS ordinal, w AS word, true AS is_ordered FROM (SELECT 0 AS src, c_custkey AS k, c_name AS w FROM customer UNION ALL SELECT 1, n_nationkey, n_name FROM nation)",
        "tokenizer_ranks": "SELECT c_name AS word, c_custkey AS rank FROM customer",
        "rank_sidecar": "SELECT row_number() OVER (ORDER BY c_name) - 1 AS place, c_custkey AS rank FROM customer",
    }
