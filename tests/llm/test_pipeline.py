"""The pipeline's stages take effect, keep the columns and handle odd rows."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.test_text_operators import odd
from trawl.llm import queries
from trawl.llm.decontaminate import contaminated
from trawl.llm.exchange import stored
from trawl.llm.lines import repeated_lines
from trawl.llm.simhash import near_duplicates


def stages(spark, docs, sf_dir):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir), name.replace(" ", "-")))
    return out


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    return stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def test_stages_keep_the_columns(results):
    assert len(corpus_pipeline.STAGES) == 5
    for df in results[:-1]:
        assert df.dtypes == results[0].dtypes


def test_stages_take_effect(spark, sf_dir, results):
    docs, spoken, lines, unique, clean, bins = results
    assert 0.9 * docs.count() < spoken.count() <= docs.count()
    assert repeated_lines(spoken).count() > 0
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(lines) - ids(unique) == {r["doc_id"] for r in near_duplicates(lines).filter("not keep").collect()}
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert ids(unique) - ids(clean) == ids(contaminated(unique, tests)) and contaminated(clean, tests).count() == 0
    assert ids(bins) == {r["doc_id"] for r in clean.collect() if r["text"] and r["text"].strip()}


def test_run_equals_the_stages(spark, sf_dir, results):
    total = lambda df: sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in df.collect())
    assert total(corpus_pipeline.run(spark, sf_dir)) == total(results[-1])


def test_odd_rows(spark, sf_dir):
    df, line = odd(spark, "doc_id long, text string, lang string, source string, n_chars long, _own_hash long, node long, _gone boolean")
    out = stages(spark, df, sf_dir)
    assert all(x.columns == df.columns for x in out[:-1])
    assert {r["doc_id"] for r in out[1].collect()} >= {1, 5, 6, None}
    empty = stages(spark, df.limit(0), sf_dir)
    assert [x.count() for x in empty] == [0] * 6


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
