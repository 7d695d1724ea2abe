"""The pipeline's stages against brute-force versions of their operators, on a small fixture."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
import test_decontamination as leaks  # noqa: E402
import test_line_dedup as lines  # noqa: E402
import test_ngram_join as near  # noqa: E402
import test_quality_rules as rules  # noqa: E402
from faultline.llm import packing  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        kept = [tuple(r) for r in rows.collect()]
        out.append((kept, rows.columns))
        docs = spark.createDataFrame(kept, rows.schema)
    return out


def test_quality_and_lines(spark, stages):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = [r for r in docs if rules.brute_kept(r[1])]
    assert sorted(stages[0][0]) == sorted(good)
    want = [(d, text) for d, text, n, gone in lines.brute([r[:2] for r in good], 20, 2, every=True) if not gone or gone < n]
    assert sorted(r[:2] for r in stages[1][0]) == sorted(want)
    assert all(r[4] == len(r[1]) for r in stages[1][0])


def test_near_duplicates_and_leaks(spark, stages):
    before = [r[:2] for r in stages[1][0]]
    want = {d for d, c, _, _ in near.brute(before) if d == c}
    assert {r[0] for r in stages[2][0]} == want
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _ in leaks.brute([r[:2] for r in stages[2][0]], items) if n}
    assert {r[0] for r in stages[3][0]} == want - hit
    assert all(columns == corpus_pipeline.COLUMNS for _, columns in stages[:4])


def test_packing(stages):
    kept, columns = stages[4]
    assert {r[columns.index("doc_id")] for r in kept} == {r[0] for r in stages[3][0]}
    texts = [r[1] for r in stages[3][0]]
    total = sum(len(x) + 1 for x in packing.encode(texts, packing.tokenizer_path()))
    assert sum(r[columns.index("length")] for r in kept) == total


def test_run(spark, stages):
    got = sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    kept, columns = stages[4]
    assert got == sorted(tuple(r[columns.index(c)] for c in ("doc_id", "piece", "length", "ids_crc32")) for r in kept)


def test_edges(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), *[(2, "a b c d e f g h i j k", "en", "s", 21)] * 3, (None, "a b c d e f g h i j k", "en", "s", 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        now = given
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            now.collect()
    assert sorted((r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, SF).collect()), key=str) == [1, 1, 2, None, None]
