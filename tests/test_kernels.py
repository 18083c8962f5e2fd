"""Codecs and assembly kernels."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.functions.bytesview import unescape_separator
from lexiloom.operators.kernels.exact import MOST, solve_exact
from lexiloom.operators.kernels.genetic import Settings, Telemetry, clamp, crossover, first_population, move_one, scramble_span, solve_genetic, swap_two, tournament
from lexiloom.operators.kernels.greedy import LONGEST, solve_greedy
from lexiloom.operators.kernels.paths import Overlaps, borders, join_path, overlap
from lexiloom.sources import codecs
from lexiloom.sources.codecs import ArchiveError, Header


def superstring(words, path, gains):
    text, starts = join_path(words, path, gains)
    assert sorted(path) == list(range(len(words)))
    for i, at in zip(path, starts, strict=True):
        assert text[at : at + len(words[i])] == words[i]
    return text


def strings(n, seed, longest=8, alphabet=b"abc"):
    rng = random.Random(seed)
    return list(dict.fromkeys(bytes(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n)))


@pytest.mark.parametrize("left,right,want", [(b"aba", b"bab", 2), (b"abcabc", b"abcxyz", 3), (b"abc", b"abc", 3), (b"", b"a", 0), (b"a", b"", 0), (b"abc", b"xyz", 0), (b"hello", b"loworld", 2), (b"aaa", b"aaaa", 3)])
def test_overlap(left, right, want):
    assert overlap(left, right) == want


@given(st.binary(max_size=12), st.binary(max_size=12))
def test_overlap_by_definition(a, b):
    assert overlap(a, b) == max([k for k in range(1, min(len(a), len(b)) + 1) if a[-k:] == b[:k]], default=0)


@pytest.mark.parametrize("text,want", [(b"ABAB", [0, 0, 1, 2]), (b"AAAA", [0, 1, 2, 3]), (b"ABCABD", [0, 0, 0, 1, 2, 0]), (b"", [])])
def test_borders(text, want):
    assert borders(text) == want


@pytest.mark.parametrize("words,want", [([b"xyz", b"abc"], b"abcxyz"), ([b"ghijkl", b"abcdef", b"defghi"], b"abcdefghijkl"), ([b"one"], b"one"), ([], b"")])
def test_exact_goldens(words, want):
    assert superstring(words, *solve_exact(words)) == want


@pytest.mark.parametrize("seed", range(8))
def test_exact_is_optimal(seed):
    words = strings(6, seed)
    best = min(sum(map(len, words)) - sum(overlap(a, b) for a, b in zip(p, p[1:])) for p in itertools.permutations(words))
    assert len(superstring(words, *solve_exact(words))) == best


def test_exact_refuses_too_many():
    with pytest.raises(ValueError):
        solve_exact([b"%d" % i for i in range(MOST + 1)])


@pytest.mark.parametrize("words,k,most", [([b"abcde", b"cdefg"], 3, 7), ([b"abcdef", b"defghi", b"ghijkl"], 3, 12), ([b"abc", b"bcd", b"cde", b"def"], 1, 6), ([b"aab", b"baa"], 5, 4), ([], 3, 0), ([b"x"], 3, 1)])
def test_greedy_bounds(words, k, most):
    assert len(superstring(words, *solve_greedy(words, k))) <= most


def plain_greedy(words, k):
    """The same rule by scanning all pairs."""
    n, after, before, gain = len(words), {}, {}, {}
    for size in range(min(max(map(len, words)), LONGEST), 0, -1):
        for u in range(n):
            if u in after or len(words[u]) < size:
                continue
            for v in range(n):
                end = v
                while end in after:
                    end = after[end]
                small = size < k and len(words[u]) >= k and len(words[v]) >= k
                if u != v and v not in before and len(words[v]) >= size and words[u][-size:] == words[v][:size] and end != u and not small:
                    after[u], before[v], gain[v] = v, u, size
                    break
    path = []
    for i in range(n):
        if i not in before:
            while i is not None:
                path.append(i)
                i = after.get(i)
    return path, [gain.get(i, 0) for i in path]


@pytest.mark.parametrize("seed,k", list(itertools.product(range(6), (0, 1, 3))))
def test_greedy_follows_the_rule(seed, k):
    words = strings(25, seed)
    assert solve_greedy(words, k) == plain_greedy(words, max(1, k))


def test_greedy_deadline_gives_a_full_path():
    words = strings(50, 1)
    path, gains = solve_greedy(words, 1, deadline=0.0)
    assert path == list(range(len(words))) and not any(gains)


def test_greedy_ignores_overlaps_beyond_the_cap():
    rng = random.Random(1)
    shared = bytes(rng.choice(b"abcdefgh") for _ in range(LONGEST + 5))
    _, gains = solve_greedy([b"x" + shared, shared + b"y"], 3)
    assert max(gains) <= LONGEST


@pytest.mark.parametrize("edit", [swap_two, move_one, scramble_span])
def test_edits_keep_permutations(edit):
    rng = random.Random(42)
    for n in (0, 1, 2, 17):
        path = list(range(n))
        for _ in range(50):
            edit(path, rng)
        assert sorted(path) == list(range(n))


def test_crossover_and_population():
    rng, words = random.Random(42), strings(30, 3)
    n, ov = len(words), Overlaps(words)
    for _ in range(40):
        a, b = rng.sample(range(n), n), rng.sample(range(n), n)
        child = crossover(a, b, ov, rng)
        assert sorted(child) == list(range(n)) and child[0] == a[0]
    people = first_population(list(range(n)), 50, rng)
    assert people[0] == list(range(n)) and len(people) == 50 and all(sorted(p) == list(range(n)) for p in people)
    assert clamp(3, 50, 500) == 50 and clamp(900, 50, 500) == 500 and tournament([1, 9, 3], 20, rng) == 1


def test_genetic_is_seeded_and_not_worse():
    words = strings(40, 7, 7)
    greedy = len(superstring(words, *solve_greedy(words, 3)))
    told = []
    options = Settings(max_iters=400, seed=9, stagnation=60)
    first = solve_genetic(words, 3, options, lambda what, x: told.append(what))
    assert first == solve_genetic(words, 3, options) and len(superstring(words, *first)) <= greedy and "stagnation" in told


def test_telemetry_is_rate_limited(caplog):
    log = Telemetry(every=60)
    with caplog.at_level("INFO", "lexiloom.genetic"):
        for i in range(5):
            log("optimum", {"step": i})
        log("stagnation", {})
    assert [r.args[0] for r in caplog.records] == ["optimum", "stagnation"]


def test_genetic_stops_in_time():
    import time

    words, began = strings(60, 7, 12), time.monotonic()
    solve_genetic(words, 3, Settings(max_iters=10**9, seconds=0.05, population=50))
    assert time.monotonic() - began < 2


@pytest.mark.parametrize("n,hex_", [(0, "00"), (127, "7f"), (128, "8001"), (624485, "e58e26"), (2**64 - 1, "ffffffffffffffffff01")])
def test_uleb_vectors(n, hex_):
    assert codecs.uleb_encode(n).hex() == hex_ and codecs.uleb_decode(bytes.fromhex(hex_)) == (n, len(hex_) // 2)


@pytest.mark.parametrize("data", [b"", b"\x80", b"\x80" * 11, b"\xff" * 9 + b"\x7f"])
def test_uleb_errors(data):
    with pytest.raises(ArchiveError):
        codecs.uleb_decode(data)


@given(st.lists(st.tuples(st.integers(0, 2**40 - 1), st.integers(1, 40)), max_size=20))
def test_bit_fields(fields):
    fields = [(v & ((1 << w) - 1), w) for v, w in fields]
    data = codecs.pack_bits(fields)
    assert len(data) == -(-sum(w for _, w in fields) // 8)
    assert codecs.unpack_bits(data, [w for _, w in fields]) == [v for v, _ in fields]


@settings(max_examples=30)
@given(st.lists(st.tuples(st.integers(0, 31), st.integers(0, 1000)), min_size=1, max_size=40))
def test_columns_equal_bit_fields(rows):
    a, b = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    data = codecs.pack_columns([a, b], [5, 10])
    assert data == codecs.pack_bits([f for x, y in rows for f in ((x, 5), (y, 10))])
    x, y = codecs.unpack_columns(data, len(rows), [5, 10])
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()


@pytest.mark.parametrize("n,bits", [(0, 1), (1, 1), (2, 2), (3, 2), (255, 8), (256, 9)])
def test_bits_needed(n, bits):
    assert codecs.bits_needed(n) == bits


@pytest.mark.parametrize("head", [Header(b"\n", True, 12345), Header(b"\x1f", False, 67890), Header(b"\0", True, 12), Header(b"|", False, 2**55 - 1)])
def test_header(head):
    data = head.encode()
    assert len(data) == 12 and Header.decode(data) == head


@pytest.mark.parametrize("data", [codecs.MAGIC[:2], b"XYZ\x02\n" + b"\x0c" + b"\0" * 6, codecs.MAGIC + b"\x01\n" + b"\x0c" + b"\0" * 6])
def test_header_errors(data):
    with pytest.raises(ArchiveError):
        Header.decode(data)
    with pytest.raises(ValueError):
        Header(b"\n", True, 2**55).encode()


def test_unordered_footer():
    data = codecs.unordered_footer(np.array([2, 2, 3]), np.array([0, 5, 10]))
    assert list(data) == [2, 2, 0, 5, 3, 1, 10]
    assert codecs.unordered_footer(np.array([3, 2, 2]), np.array([10, 5, 0])) == data
    lengths, offsets = codecs.decode_footer(data, False, 13)
    assert lengths.tolist() == [2, 2, 3] and offsets.tolist() == [0, 5, 10]


@pytest.mark.parametrize("footer,ordered,payload", [(bytes([3, 200]), True, 9), (bytes([3, 1]), True, 9), (bytes([2, 1, 9]), False, 10), (bytes([2, 9, 0]), False, 10), (bytes([2, 2, 1]) + codecs.uleb_encode(2**63), False, 10), (codecs.uleb_encode(3) + bytes([1, 0b11111111]), True, 4)])
def test_broken_footers_raise(footer, ordered, payload):
    with pytest.raises(ArchiveError):
        codecs.decode_footer(footer, ordered, payload)


def test_broken_archives_raise():
    with pytest.raises(ArchiveError):
        codecs.decode_archive(Header(b"\n", True, 5).encode())
    with pytest.raises(ArchiveError):
        codecs.decode_archive(Header(b"\n", True, 99).encode() + b"abc")


def test_ranks():
    data = codecs.encode_ranks([42, 7, 2**32 - 1])
    assert data[:4] == b"\x2a\0\0\0" and codecs.decode_ranks(data) == [42, 7, 2**32 - 1]
    with pytest.raises(ArchiveError):
        codecs.encode_ranks([1, None])


@pytest.mark.parametrize("flag,want", [("\\n", b"\n"), ("\\t", b"\t"), ("\\0", b"\0"), ("\\x1f", b"\x1f"), ("\\037", b"\x1f"), ("||", b"||"), ("\\q", b"\\q"), ("\n", b"\n"), ("\\u00e9", "é".encode())])
def test_separator_flags(flag, want):
    assert unescape_separator(flag) == want
    with pytest.raises(ValueError):
        unescape_separator("")
