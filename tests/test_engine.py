"""Operators and the whole build, against hand-made goldens and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.cli import main
from lexiloom.operators.assembly import Options, assemble, ga_budgets, pair_superwords, routing, wall_and_cores
from lexiloom.operators.containment import contained_pairs, multi_pattern, occurrences, survivors, survivors_by_force
from lexiloom.operators.kernels.genetic import Settings
from lexiloom.operators.kernels.paths import overlap
from lexiloom.operators.membership import membership
from lexiloom.operators.merging import merge_archives, split_update
from lexiloom.operators.overlaps import islands, overlap_pairs
from lexiloom.operators.vocabulary import distinct_first
from lexiloom.plans.build import build_dictionary
from lexiloom.plans.stash import stash
from lexiloom.sources.archive import payload_table, read_archive, read_payload, write_archive
from lexiloom.sources.codecs import decode_archive
from lexiloom.sources.text import ScanError, read_separated, read_tokenizer


def byte_words(df):
    return [r["b"].encode("latin-1") for r in df.orderBy("id").collect()]


def random_words(n, seed, alphabet="abc", longest=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_distinct_keeps_first_occurrence(corpus):
    got = distinct_first(corpus(["b", "a", "B", "", "b", "a", ""]))
    assert [(r["id"], r["b"]) for r in got.orderBy("id").collect()] == [(0, "b"), (1, "a"), (2, "B"), (3, "")]


@pytest.mark.parametrize("words", [["cart", "art", "car"], ["abcdef", "bcd", "cd"], ["hello", "helloworld", "world"], [""], ["", "a"], [], ["x"], ["aa", "aa"], ["é".encode(), b"\xa9", b"\xc3"]])
def test_survivors_small(corpus, words):
    raw = [w if isinstance(w, bytes) else w.encode() for w in words]
    assert byte_words(survivors(distinct_first(corpus(words)))) == survivors_by_force(raw)


def test_survivors_random_with_long_strings(corpus):
    words = random_words(150, 1) + random_words(40, 2, "ab", 60)
    words += [words[-1] + "tail" * 30, "x" + words[150] * 3]
    assert byte_words(survivors(distinct_first(corpus(words)))) == survivors_by_force([w.encode() for w in words])


def test_occurrences_find_every_place(spark):
    hay = {1: "banana", 2: "ab" * 40, 3: "q" * 30 + "needle-in-hay" + "q" * 30, 4: ""}
    needles = {10: "ana", 11: "abab", 12: "needle-in", 13: "ababababab", 14: "zz", 15: ""}
    want = {(i, h, p) for i, n in needles.items() for h, t in hay.items() if n for p in range(len(t)) if t.startswith(n, p)}
    got = occurrences(spark.createDataFrame(list(needles.items()), "id long, b string"), spark.createDataFrame(list(hay.items()), "hid long, h string"))
    assert {tuple(r) for r in got.select("id", "hid", "pos").collect()} == want


def test_multi_pattern(spark):
    p = spark.createDataFrame([(0, "he"), (1, "she"), (2, "his"), (3, "hers")], "pattern_id long, b string")
    got = multi_pattern(p, spark.createDataFrame([(7, "ushers")], "doc_id long, b string"))
    assert {tuple(r) for r in got.collect()} == {(7, 1, 1, 3), (7, 0, 2, 3), (7, 3, 2, 5)}


@pytest.mark.parametrize("k", [1, 3])
def test_overlaps_and_islands(corpus, k):
    words = survivors(distinct_first(corpus(random_words(60, 5, "abcd", 7))))
    rows = [(r["id"], r["b"].encode()) for r in words.collect()]
    want = {(i, j, o) for i, a in rows for j, b in rows if i != j and (o := overlap(a, b)) >= k}
    assert {tuple(r) for r in overlap_pairs(words, k).collect()} == want
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j, _ in want:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    assert {tuple(r) for r in islands(words, k).collect()} == {(i, find(i)) for i in up}


@pytest.mark.parametrize("words,sizes", [(["abcdef", "defghi", "ghijkl"], [3]), (["abc", "xyz", "mno"], [1, 1, 1]), (["abcde", "cdefg", "12345", "34567"], [2, 2]), (["hello"], [1]), ([], []), (["ab", "bc"], [1, 1])])
def test_island_sizes(corpus, words, sizes):
    got = islands(distinct_first(corpus(words)), 3).groupBy("island_id").count().collect()
    assert sorted(r["count"] for r in got) == sorted(sizes)


def test_chain_with_duplicates(corpus):
    built = build_dictionary(corpus("password swordfish fishbone 123456 admin duplicate duplicate".split()))
    tops = [r["sw"] for r in built.superwords.orderBy("base").collect()]
    assert tops == ["passwordfishbone", "duplicate", "123456", "admin"]
    assert built.payload_bytes() == 36


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_both_ways(spark, small):
    from lexiloom.operators.components import connected_components

    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)] + [(7, 7), (None, 3), (900, 901), (901, 900), (900, 901)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), small=small).collect()
    assert {(r["id"], r["component"]) for r in got} == {(x, find(x)) for x in up} and len(got) == len(up)
    assert connected_components(spark.createDataFrame([], "u long, v long"), small=small).count() == 0


def check_offsets(built):
    payload = b"".join(built.payload())
    for r in built.offsets.collect():
        assert payload[r["offset"] : r["offset"] + r["length"]] == r["b"].encode("latin-1")
    return payload


@pytest.mark.parametrize("options", [Options(), Options(dp_limit=0), Options(min_overlap=1, slice_words=20), Options(dp_limit=3, ga=Settings(max_iters=300, seed=3))])
def test_every_word_is_at_its_offset(corpus, options):
    rng = random.Random(42)
    base = "".join(rng.choice("abcdef") for _ in range(200))
    words = [base[a : a + rng.randint(5, 24)] for a in (rng.randrange(0, 176) for _ in range(50))] + random_words(60, 8, "ghij", 6) + ["", "naïve", "vé"]
    built = build_dictionary(corpus(words), options)
    payload = check_offsets(built)
    assert len(payload) <= sum(map(len, {w.encode() for w in words}))
    assert payload == check_offsets(build_dictionary(corpus(words), options))


def test_giant_island_in_slices_with_remix(corpus):
    words = sorted({w + "z" for w in random_words(400, 9, "abcde", 8) if len(w) > 5})
    options = Options(min_overlap=1, dp_limit=2, ga=Settings(max_iters=40, population=5, seed=2), slice_words=40)
    check_offsets(build_dictionary(corpus(words), options))


def test_populations_side_by_side(spark):
    from lexiloom.operators.assembly import SEED_STEP
    from lexiloom.operators.kernels.genetic import solve_genetic

    texts = sorted(set(random_words(30, 21, "ab", 9)))
    words = spark.createDataFrame(list(enumerate(texts)), "id long, b string")
    ga = Settings(max_iters=60, population=6, seed=4)

    def size(options):
        tops, places = assemble(words, words.selectExpr("id", "0L AS island_id"), options)
        text = tops.first()["sw"]
        assert all(text[r["start"] :].startswith(texts[r["id"]]) for r in places.collect()) and places.count() == len(texts)
        return len(text)

    raw = sum(map(len, texts))
    alone = [raw - sum(solve_genetic([t.encode() for t in texts], 1, Settings(6, 0, 0, 60, None, 4 + p * SEED_STEP))[1]) for p in range(4)]
    assert size(Options(min_overlap=1, dp_limit=2, ga=ga, populations=4)) == min(alone)
    assert size(Options(min_overlap=1, dp_limit=2, ga=ga)) == alone[0]
    assert size(Options(min_overlap=1, dp_limit=2, ga_seconds=0.2)) <= raw


def test_slices_share_the_time(corpus):
    words = sorted({w + "z" for w in random_words(300, 19, "abcde", 8) if len(w) > 5})
    check_offsets(build_dictionary(corpus(words), Options(min_overlap=1, dp_limit=2, ga_seconds=0.5, slice_words=60)))


def test_pairs_and_routing(spark):
    got = pair_superwords(spark.createDataFrame([("xyz", "abc"), ("abcx", "xyab"), ("abab", "baba")], "first string, second string")).collect()
    assert [r["sw"] for r in got] == ["abcxyz", "xyabcx", "babab"]
    sizes = spark.createDataFrame([(1, 1), (2, 15), (3, 16)], "island_id long, size long")
    assert [r["solver"] for r in routing(sizes).orderBy("island_id").collect()] == ["single", "exact", "greedy"]


def test_budgets(spark):
    sizes = spark.createDataFrame([(50,), (100,), (200,), (5,)], "size long")
    got = {r["size"]: r["budget"] for r in ga_budgets(sizes, 60, 1, 15).collect()}
    assert got[100] == pytest.approx(4 * got[50]) and got[200] == pytest.approx(45.714, abs=1e-3) and got[5] == 0
    one = ga_budgets(spark.createDataFrame([(1000,)], "size long"), 60, 2, 15)
    row = one.select(*[c.alias(n) for c, n in zip(wall_and_cores(F.col("budget"), 60), ("wall", "cores"))]).first()
    assert (row["wall"], row["cores"]) == (60, 2)


def test_golden_unordered_tokenizer(spark, tmp_path):
    import base64

    tokens = [b"\n", b"\0", b"hello", b"loworld", b"world", b"abc"]
    source = tmp_path / "t.tiktoken"
    source.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    (tmp_path / "m.json").write_text('{"pat_str": "x"}')
    assert main(["build", "-i", str(source), "-o", str(tmp_path / "t.dict"), "--tiktoken", "--metadata", str(tmp_path / "m.json")], spark) == 0
    data = (tmp_path / "t.dict").read_bytes()
    assert data == bytes.fromhex("534353020a1d000000000000") + b"loworldhelloabc\0\n" + bytes.fromhex("01020f0103010c0502020507" "0100")
    assert (tmp_path / "t.rank").read_bytes() == b"".join(r.to_bytes(4, "little") for r in (1, 0, 5, 4, 2, 3))
    assert (tmp_path / "t.json").read_text() == '{"pat_str": "x"}'


def test_golden_ordered(spark, tmp_path, capfdbinary):
    (tmp_path / "w").write_bytes(b"hello\nworld\n\nfoo\nbar\nbaz\n")
    out = str(tmp_path / "w.dict")
    assert main(["build", "-i", str(tmp_path / "w"), "-o", out], spark) == 0
    assert open(out, "rb").read() == bytes.fromhex("534353020a1f000000000080") + b"helloworldbarbazfoo" + bytes.fromhex("0506052d0083536b")
    capfdbinary.readouterr()
    assert main(["cat", out], spark) == 0
    assert capfdbinary.readouterr().out == b"hello\nworld\n\nfoo\nbar\nbaz\n"
    assert main(["search", "world", out], spark) == 0
    assert main(["search", "wor", out], spark) == 1
    assert main(["search", "zzzzz", out], spark) == 1


@pytest.mark.parametrize("unordered,size", [(False, 14), (True, 12)])
def test_empty_file(spark, tmp_path, unordered, size):
    (tmp_path / "e").write_bytes(b"")
    assert main(["build", "-i", str(tmp_path / "e"), "-o", str(tmp_path / "e.dict"), *["--unordered"] * unordered], spark) == 0
    assert len((tmp_path / "e.dict").read_bytes()) == size


@pytest.mark.parametrize("data,sep,want", [(b"a\r\n\n b\t\n", b"\n", [b"a\r", b"", b" b\t"]), (b"\n\n\n", b"\n", [b"", b"", b""]), (b"hello\nworld\x1f\0data\x1fend\x1f", b"\x1f", [b"hello\nworld", b"\0data", b"end"]), (b"a\xffb\xff", b"\xff", [b"a", b"b"]), (b"x", b"\n", [b"x"])])
def test_separated_scan(spark, tmp_path, data, sep, want):
    (tmp_path / "f").write_bytes(data)
    assert [r["b"].encode("latin-1") for r in read_separated(spark, str(tmp_path / "f"), sep).orderBy("line_no").collect()] == want


def test_tokenizer_scan_errors(spark, tmp_path):
    for k, (text, line) in enumerate([("YQ== 0\nYg\n", 2), ("!!! 1\n", 1), ("YQ== x\n", 1), ("\nYQ== 4294967296\n", 2)]):
        (tmp_path / f"t{k}").write_text(text)
        with pytest.raises(ScanError, match=f"line {line}"):
            read_tokenizer(spark, str(tmp_path / f"t{k}"))
    (tmp_path / "ok").write_text("YQ== 3\n\nYg== 1\nYQ== 7\n")
    assert [(r["b"], r["rank"]) for r in read_tokenizer(spark, str(tmp_path / "ok")).orderBy("line_no").collect()] == [("a", 7), ("b", 1), ("a", 7)]


def test_missing_file_and_arguments(spark, tmp_path, capfd):
    assert main(["cat", str(tmp_path / "none")], spark) == 1
    assert "error:" in capfd.readouterr().err
    for argv in ([], ["fly"], ["build", "-i", "x"], ["merge", "--primary", "x"], ["cat"], ["search", "x"]):
        with pytest.raises(SystemExit):
            main(argv, spark)


def test_split_update(spark, corpus, tmp_path):
    payload, path = b"passwordswordfishbone", str(tmp_path / "p")
    write_archive(path, iter([payload]), len(payload), b"\n")
    got = split_update(corpus(["password", "newword", "fish", "newword", ""]), payload_table(spark, path, 8)).orderBy("line_no").collect()
    assert [r["offset"] for r in got] == [0, None, 13, None, 0]


def test_payload_in_chunks(spark, tmp_path):
    from lexiloom.sources import archive, files

    payload, path = random.Random(5).randbytes(archive.CHUNK * 1030 + 17), str(tmp_path / "p")
    write_archive(path, iter([payload]), len(payload), b"\n")
    for r in payload_table(spark, path, 9).collect():
        assert r["h"].encode("latin-1") == payload[r["hid"] : r["hid"] + archive.CHUNK + 8]
    assert payload_table(spark, path, 9).count() == 1031
    assert b"".join(files.read_range(path, 12, 12 + len(payload))) == payload
    with pytest.raises(EOFError):
        list(files.read_range(path, 0, 13 + len(payload)))
    write_archive(path, iter([]), 0, b"\n")
    assert payload_table(spark, path, 0).count() == 0


def test_merge_overlap(spark, corpus, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    build_dictionary(corpus(["abcdef"])).write(a)
    build_dictionary(corpus(["defghi"])).write(b)
    merged = merge_archives(spark, a, b)
    assert (merged.shared, b"".join(merged.fragments())) == (3, b"ghi")
    merged.write(c)
    _, payload, words = decode_archive(open(c, "rb").read())
    assert payload == b"abcdefghi" and [w for w, _, _ in words] == [b"abcdef", b"defghi"]


@pytest.mark.parametrize("modes", [(True, True), (True, False), (False, False)])
def test_merge_round_trip(spark, corpus, tmp_path, modes):
    first, second = random_words(40, 11, "abcd", 8) + [""], random_words(40, 12, "cdef", 8) + ["zz", "zz"]
    a, b, c = (str(tmp_path / x) for x in "abc")
    build_dictionary(corpus(first), ordered=modes[0]).write(a)
    build_dictionary(corpus(second), ordered=modes[1]).write(b)
    merge_archives(spark, a, b).write(c)
    head, _, words = decode_archive(open(c, "rb").read())
    got = [w.decode() for w, _, _ in words]
    assert head.ordered == all(modes)
    assert {w for w in got if w} == {w for w in first + second if w}
    if head.ordered:
        assert got[: len(first)] == first and got.count("zz") in (1, 2)
    else:
        assert len(got) == len(set(got))


def test_membership(spark, corpus, tmp_path):
    path = str(tmp_path / "m")
    build_dictionary(corpus("password swordfish fishbone".split())).write(path)
    got = membership(corpus(["password", "zzzzz", "sword"]), read_archive(spark, path))
    assert {r["b"]: r["status"] for r in got.collect()} == {"password": "member", "zzzzz": "absent", "sword": "substring"}


def test_payload_and_archive_agree(spark, corpus, tmp_path):
    path = str(tmp_path / "p")
    built = build_dictionary(corpus(random_words(80, 4)))
    assert built.write(path) == len(open(path, "rb").read())
    assert read_payload(path)[1] == b"".join(built.payload())
    assert built.compression() < 1


def test_contained_pairs(corpus):
    got = contained_pairs(distinct_first(corpus(["abcabc", "bc", "c"])))
    assert {tuple(r) for r in got.select("id", "hid", "pos").collect()} == {(1, 0, 1), (1, 0, 4), (2, 0, 2), (2, 0, 5), (2, 1, 1)}


def test_assemble_offsets_only_pairs(spark):
    words = spark.createDataFrame([(1, "abcd"), (2, "cdef")], "id long, b string")
    members = spark.createDataFrame([(1, 1), (2, 1)], "id long, island_id long")
    tops, places = assemble(words, members)
    assert tops.first()["sw"] == "abcdef" and {tuple(r) for r in places.select("id", "start").collect()} == {(1, 0), (2, 2)}


def test_write_archive_is_atomic(tmp_path, corpus):
    path = str(tmp_path / "x")
    with pytest.raises(RuntimeError):
        def broken():
            yield b"abc"
            raise RuntimeError("lost")

        write_archive(path, broken(), 3, b"\n")
    assert not (tmp_path / "x").exists()


def test_limits_are_refused():
    with pytest.raises(ValueError, match="dp limit"):
        Options(dp_limit=19)


def test_files_through_hadoop(spark, tmp_path, monkeypatch):
    from lexiloom.sources import files

    assert files.local("/a/b") == files.local("file:///a/b") == files.local("file:/a/b") == "/a/b" and files.local("hdfs://h/a") is None
    monkeypatch.setattr(files, "local", lambda path: None)
    path = f"file://{tmp_path}/raw"
    with files.writing(path) as write:
        write(b"ab\xff")
        write(b"\0" * 10)
    assert files.read_bytes(path) == b"ab\xff" + b"\0" * 10 and files.read_bytes(path, 3) == b"ab\xff"
    out = f"file://{tmp_path}/x.dict"
    built = build_dictionary(spark.createDataFrame([(0, "hello"), (1, "lower")], "line_no long, b string"))
    size = built.write(out)
    monkeypatch.undo()
    assert size == len(files.read_bytes(out)) and {r["b"] for r in read_archive(spark, out).collect()} == {"hello", "lower"}


def test_encoding_files(tmp_path):
    import json

    import regex
    from lexiloom.sources.archive import write_encodings

    paths = write_encodings(str(tmp_path / "meta"))
    assert len(paths) == 6
    for path in paths:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        assert "".join(regex.findall(data["pat_str"], "it's 1234 naïve\n\n  words")).split()
        assert all(k.startswith("<|") and k.endswith("|>") for k in data["special_tokens"])


def test_encoding_metadata():
    import json

    from lexiloom.sources.archive import encoding_metadata

    text = encoding_metadata("x|y", {"<|b|>": 9, "<|a|>": 7})
    assert json.loads(text) == {"pat_str": "x|y", "special_tokens": {"<|a|>": 7, "<|b|>": 9}} and text.index("<|a|>") < text.index("<|b|>")


def test_stashed_tables_can_be_cleared(spark):
    import os

    from lexiloom.plans import stash

    path = stash.stash_path(spark.range(3), "t").removeprefix("file://")
    assert os.path.isdir(path)
    stash.clear(spark)
    assert not os.path.isdir(path)


def test_no_table_of_the_data_is_broadcast_and_the_payload_comes_in_stretches(corpus):
    built = build_dictionary(corpus([f"Customer#{i:09d}" for i in range(3000)]))
    plans = [built.lines(), survivors(built.offsets.select("id", "b")), islands(built.offsets.select("id", "b"), 3)]
    for df in plans:
        df.count()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    pieces = list(built.payload())
    assert b"".join(pieces) == b"".join(b"Customer#%09d" % i for i in range(3000)) and len(pieces) <= 4


def test_footer_over_several_blocks(spark, corpus, tmp_path, monkeypatch):
    from lexiloom.sources import archive

    monkeypatch.setattr(archive, "BLOCK", 7)
    monkeypatch.setattr(archive, "AT_ONCE", 2)
    monkeypatch.setattr(archive, "SPAN", 50)
    words = random_words(200, 3, "abcdef", 6) + ["", "é", "long" * 20]
    for ordered in (True, False):
        path = str(tmp_path / str(ordered))
        build_dictionary(corpus(words), ordered=ordered).write(path)
        with open(path, "rb") as f:
            got = [b for b, _, _ in decode_archive(f.read())[2]]
        raw = [w.encode() for w in words]
        assert got == raw if ordered else sorted(got) == sorted(set(raw) - {b""})


def test_rank_sidecar_over_several_blocks(spark, corpus, tmp_path, monkeypatch):
    from lexiloom.sources import archive

    monkeypatch.setattr(archive, "BLOCK", 5)
    words = sorted(set(random_words(60, 4, "abcdef", 6)))
    ranked = corpus(words).withColumn("rank", F.lit(2**32 - 1) - F.col("line_no"))
    path = str(tmp_path / "r.bin")
    built = build_dictionary(ranked)
    built.write(path)
    got = [r["rank"] for r in archive.read_ranks(spark, str(tmp_path / "r.rank")).orderBy("place").collect()]
    order = built.offsets.orderBy("length", "offset").collect()
    assert got == [2**32 - 1 - words.index(r["b"]) for r in order]


def test_runs_of_no_needle_never_become_rows(spark):
    """Needles in haystacks of some stretches, at their borders, across haystacks, and longer than the window of a found run."""
    from lexiloom.operators import containment

    rng = random.Random(11)
    hay = {i: "".join(rng.choice("abcdefgh") for _ in range(n)) for i, n in enumerate((30, 5000, 1_100_000, 40))}
    big = hay[2]
    needles = {100: big[:9], 101: big[-8:], 102: big[(1 << 20) - 2000 : (1 << 20) + 900], 103: hay[1][10:1500] + "X", 104: hay[0][-4:] + hay[1][:4] + "zz", 105: hay[1][1000:1020], 106: big[500:2500]}
    want = {(i, h, t.find(n)) for i, n in needles.items() for h, t in hay.items() if n in t}
    got = occurrences(spark.createDataFrame(list(needles.items()), "id long, b string"), spark.createDataFrame(list(hay.items()), "hid long, h string"))
    assert {tuple(r) for r in got.select("id", "hid", "pos").collect()} == want and len(want) >= 5
    scan = containment._seen(containment._bitmap(spark.createDataFrame([(-1,)], "slot long").where("slot >= 0")), 8)
    assert spark.createDataFrame(list(hay.items()), "hid long, h string").mapInArrow(scan, "hid long, p int, g string, left int, win string").count() == 0


@pytest.mark.parametrize("n", [1, 5, 40, 10**6])
def test_strongest_pairs_list_no_others(corpus, n):
    from lexiloom.operators.overlaps import strongest_pairs

    words = stash(distinct_first(corpus(random_words(50, 9, "ab", 12) + ["aaaaaa", "aaaa", "abababab", ""])), "words")
    rows = [(r["id"], r["b"].encode()) for r in words.collect()]
    want = sorted(((i, j, o) for i, a in rows for j, b in rows if i != j and (o := overlap(a, b)) >= 2), key=lambda x: (-x[2], x[0], x[1]))[:n]
    assert [tuple(r) for r in strongest_pairs(words, 2, n).collect()] == want


def test_overlap_pairs_are_not_gathered(corpus):
    plan = overlap_pairs(stash(distinct_first(corpus(["abcabc", "bcabcd", "cabcdd"])), "words"), 2)
    assert "Aggregate" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in plan.collect()} == {(0, 1, 5), (0, 2, 4), (1, 2, 5)}
