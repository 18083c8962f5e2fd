"""The driver contract: queries against their DuckDB oracles, and life without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from lexiloom import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert plain(map(tuple, got.select(*cols).collect())) == plain(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_oracle_runs(spark, duck, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_entry_runs(spark, duck):
    assert entry.entry(spark).columns == ["id", "b_hex"]


def test_oracles_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_subpackage(tmp_path):
    for part in ("lexiloom", "__spark_entry__.py"):
        source, to = os.path.join(ROOT, part), tmp_path / part
        shutil.copytree(source, to, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, to)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.stdout.split()[-3:] == [str(len(catalogue.queries())), str(len(catalogue.oracle_sql())), "False"]


def test_stream_of_words(spark, tmp_path):
    from lexiloom.streaming.updates import known_words, stream_words

    source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    os.makedirs(source)
    for k, words in enumerate(["a\nb\n\na\n", "b\nc\n"]):
        with open(f"{source}/{k}", "w") as f:
            f.write(words)
        query = stream_words(spark, source, table, mark)
        query.awaitTermination(60)
    assert sorted((r["b"], r["batch"]) for r in known_words(spark, table).collect()) == [("a", 0), ("b", 0), ("c", 1)]


def test_both_kinds_of_archive_come_from_one_build(spark, duck, monkeypatch):
    made = []
    monkeypatch.setattr(catalogue, "build_dictionary", lambda *a, build=catalogue.build_dictionary, **b: made.append(1) or build(*a, **b))
    assert sorted(r["is_ordered"] for r in catalogue.compression_ratio(spark, DATA).collect()) == [False, True] and len(made) == 1
