"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for each operator and stage."""

import importlib

import public_tokenizers
import pytest
from fixtures import EDGES, frame

from echotable.llm import decontamination, exact_dedup, line_dedup, media, near_dedup, packing, quality, secrets, sharding, substring_dedup, toxicity

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def run(name, df):
    s = df.sparkSession
    return {
        "quality": lambda: quality.quality(df),
        "toxicity": lambda: toxicity.toxicity(df, s.createDataFrame([(1, 1, 0), (8, 1, None), (None, 1, 1), (5, 0, 1), (5, 0, 0)], LABELS)),
        "sharding": lambda: sharding.shard(df),
        "substring": lambda: substring_dedup.remove_repeats(df),
        "secrets": lambda: secrets.scan(df),
        "lines": lambda: line_dedup.dedup_lines(df),
        "media": lambda: media.media(df),
        "packing": lambda: packing.pack(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        "exact": lambda: exact_dedup.exact_duplicates(df),
        "near": lambda: near_dedup.near_duplicates(df, words=4),
    }[name]()


NAMES = ["quality", "toxicity", "sharding", "substring", "secrets", "lines", "media", "packing", "near", "exact"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(spark, name):
    found = [r["doc_id"] for r in run(name, frame(spark)).collect() if "piece" not in r or r["piece"] == 0]
    assert sorted(found, key=str) == sorted((i for i, _ in EDGES), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert run(name, frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_only_nulls(spark, name):
    assert run(name, frame(spark, [(None, None), (None, None)])).count() == 2


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, EDGES[0][1]), (1, EDGES[0][1]), (2, None), (3, ""), (None, "word"), (4, "word")], ITEMS)
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(spark), items).collect()}
    assert found == {(1, 1), (8, 1), (5, 4)}
    assert decontamination.contaminated(frame(spark, []), items).collect() == []
    assert decontamination.contaminated(frame(spark), items.limit(0)).collect() == []


def test_near_edges(spark):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in run("near", frame(spark)).collect()}
    assert {(1, 10, 1, True), (8, 10, 1, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (None, 10, None, True), (10, 60_000 - 3 + 1, 6, False)} <= found


@pytest.mark.parametrize("rows", [EDGES, []])
def test_stages_keep_columns(spark, rows, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame([(1, 1, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a passage that nobody has copied anywhere so far it seems to us")], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, rows)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = out
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns[:2] == ["doc_id", "piece"]
    left = [r["doc_id"] for r in docs.select("doc_id").collect()]
    # of 8 one text is its own and the two that repeat lost their line before; 10 is like 6
    assert sorted(left, key=str) == (sorted([1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 9, -3, None, None], key=str) if rows else [])
