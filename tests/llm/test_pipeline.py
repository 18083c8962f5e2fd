"""The pipeline against brute force over its own small tables."""

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from tests.llm.test_operators import LOWER, base_spans, components, edited, rule_counts, slow_score  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def redacted(text):
    out, at = "", 0
    for start, back, kind in sorted((a, -b, k) for k, a, b in base_spans(text)):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, -back) if start >= at or -back > at else at
    return out + text[at:]


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_run_equals_brute_force(spark, tmp_path):
    import random

    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghilmnorstuv") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = {i: prose(30) for i in range(5)}
    texts = {i: prose(rng.randint(25, 90)) for i in range(60)}
    for i in range(8):
        texts[100 + i] = edited(texts[i], 1, i)
        texts[200 + i] = texts[10 + i]
    for i in range(5):
        texts[300 + i] = prose(20) + " " + items[i] + " " + prose(20)
        texts[310 + i] = prose(30) + f"\nwrite to user{i}@mail{i}.example.org or call +1 (555) 010-99{i}7 now " + prose(9)
    texts |= {400: "too short", 401: "again " * 60, 402: None, 403: "", 404: prose(3000)}
    cols = {"doc_id": list(texts), "text": list(texts.values()), "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": [len(t or "") for t in texts.values()]}
    pq.write_table(pa.table(cols), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": list(items), "text": list(items.values())}), tmp_path / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": [0, 1], "quality": pa.array([1, 0], pa.int32()), "toxic": pa.array([0, 0], pa.int32())}), tmp_path / "labels.parquet")

    left = {i: t for i, t in texts.items() if not rule_counts(t)[-1]}
    left = {i: t for i, t in left.items() if components(left)[i][1] == i}
    worded = {i: WORD.findall(t.translate(LOWER)) for i, t in left.items()}
    asked = [WORD.findall(t) for t in items.values()]
    assert 100 not in left and 200 not in left and 300 in left
    leaked = {i for i in left if i != 404 and any(set(a) & set(worded[i]) and slow_score(a, worded[i]) >= 0.6 * 2 * len(a) for a in asked)}
    assert leaked == {300, 301, 302, 303, 304}
    from tokenizers import Tokenizer

    from lexiloom.llm.queries import byte_bpe

    t = Tokenizer.from_file(byte_bpe())
    want = {i: np.array([*t.encode(redacted(x), add_special_tokens=False).ids, 1], "<u4").tobytes() for i, x in left.items() if i not in leaked}
    got: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in got.items()} == want


def test_stages_on_empty_tables_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, n_words string, base_spans string")
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        return
    docs = empty
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == empty.columns and docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0
