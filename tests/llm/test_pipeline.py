"""The stages one after the other, each against brute force on what the one before kept."""

import re

import public_tokenizers
from pyspark.sql import types as T

import corpus_pipeline
from test_texts import brute_components, brute_substrings, corpus, odd_texts, words_of
from threadloom.llm import pieces

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def test_stages(spark, tmp_path):
    texts = odd_texts() + corpus(seed=9, n=90)
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = sorted((r.asDict() for r in kept.collect()), key=lambda r: r["doc_id"])
        if name != "tokens":
            assert kept.columns == SCHEMA.names

    told = {r["doc_id"]: r["text"] for r in seen["language"]}
    letters = {i for i, t in enumerate(texts) if t and re.search(r"[^\W\d_]", t)}
    assert set(told) == letters

    ids, before = list(told), [told[i] for i in told]
    want = {c for _, c in brute_components(before, ids)}
    one = {r["doc_id"]: r for r in seen["near_duplicates"]}
    assert set(one) == want and all(one[i]["text"] == texts[i] for i in one)

    ids = sorted(one)
    for i, (n, removed, _, words), r in zip(ids, brute_substrings([texts[i] for i in ids]), seen["substrings"], strict=True):
        assert r["doc_id"] == i and words_of(r["text"]) == words and r["n_chars"] == len(r["text"])
        assert removed or r["text"] == texts[i]

    sizes = {r["doc_id"]: len(words_of(r["text"])) for r in seen["substrings"]}
    times = {}
    for r in seen["mix"]:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= {i for i, n in sizes.items() if n} and max(times.values()) <= 3
    total, mixed = sum(sizes.values()), sum(sizes[i] * n for i, n in times.items())
    assert abs(total - mixed) <= 60

    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model")).library
    assert len(seen["tokens"]) == len(seen["mix"])
    by_id = {r["doc_id"]: r["text"] for r in seen["mix"]}
    for r in seen["tokens"]:
        assert list(r["ids"]) == model.encode(by_id[r["doc_id"]], add_eos=True) and r["n_tokens"] == len(r["ids"])


def test_run_is_all_stages(spark, tmp_path):
    """``run`` over a documents table gives what its stages give one after the other, and twice the same."""
    rnd_texts = odd_texts() + corpus(seed=4, n=40)
    rows = [(i, t, "en", ["a", None][i % 2], None if t is None else len(t)) for i, t in enumerate(rnd_texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/stage-{name}")
        kept = spark.read.parquet(f"{tmp_path}/stage-{name}")
    want = sorted((tuple(r) for r in kept.drop("ids").collect()), key=str)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.drop("ids").collect()), key=str) == want and want


def test_empty_corpus(spark, tmp_path):
    kept = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    assert kept.count() == 0
