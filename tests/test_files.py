"""Files: CSV by splits, lists in cells, ordered files, and resumed streams."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import sampling
from threadloom.plans import sqltext
from threadloom.sources import readers, writers
from threadloom.streaming import resume


def set_conf(spark, monkeypatch, key, value):
    before = spark.conf.get(key)
    monkeypatch.setattr(spark, "_kept", (key, before), raising=False)
    spark.conf.set(key, value)
    return lambda: spark.conf.set(key, before)


def csv_rows(n, seed=1):
    rnd = random.Random(seed)
    bits = ['"', "\n", ",", "word ", "ç漢", '""', "\r\n", " ", "\\", "x" * 40]
    return [[f"id{i}", *["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(6)]] for i in range(n)]


@pytest.mark.parametrize("split", ["97", "1000", "100000"])
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_csv_is_split_inside_quotes(spark, tmp_path, monkeypatch, split, ending):
    rows = csv_rows(120)
    rows.append(["long", "a\n\n\n" * 300, "", "", "", "", '"'])
    for k in range(3):
        with open(tmp_path / f"part{k}.csv", "w", newline="") as out:
            w = csv.writer(out, lineterminator=ending)
            w.writerow(["tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id"])
            w.writerows(rows[k::3])
            if k == 1:
                out.write(ending * 2)  # blank lines at the end
    back = set_conf(spark, monkeypatch, "spark.sql.files.maxPartitionBytes", split)
    try:
        got = readers.read_tweets(spark, str(tmp_path))
        if split != "100000":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        assert sorted(map(list, got.collect())) == sorted(rows)
    finally:
        back()


def test_csv_other_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,é,True,,"a\nb",,\n'.encode("latin-1"))
    row = readers.read_tweets(spark, str(tmp_path), encoding="ISO-8859-1").first()
    assert row["author_id"] == "é" and row["text"] == "a\nb" and row["created_at"] == ""


def test_csv_records_of_odd_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text('a,"b\nc"\n')
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\nat all')
    assert [r[0] for r in readers.csv_records(spark, str(tmp_path)).collect()] == ['1,"never closed\nat all']


def test_lists_with_their_own_delimiter(spark, tmp_path):
    turns = [["a", "b | c", " | ", "|", "x |", "| y", "\\| z", "p \\| q", "r \\\\| s", "a|b", "| | |", "back\\"], [], ["", "  ", "only"]]
    schema = (
        "example_id string, conversation_id string, created_at string, customer_message string, previous_turns array<string>, previous_speakers array<string>, "
        "brand_response string, candidate_intents array<string>, human_intent string, human_escalate string, human_reason string, annotation_notes string, part int"
    )
    rows = [(str(i), "c", "", ' "q"\n ', x, [], None, ["one", "two"], None, "Yes", None, None, i) for i, x in enumerate(turns)]
    writers.write_csv(writers.join_lists(spark.createDataFrame(rows, schema)), str(tmp_path / "g"))
    got = {r["example_id"]: r for r in readers.read_golden(spark, str(tmp_path / "g")).collect()}
    assert [got[str(i)]["previous_turns"] for i in range(3)] == [[e.strip() for e in x if e.strip()] for x in turns]
    assert all(r["customer_message"] == ' "q"\n ' and r["candidate_intents"] == ["one", "two"] and r["human_escalate"] for r in got.values())
    assert {r["part"] for r in got.values()} == {0, 1, 2}


def test_ordered_stats_over_many_files(spark, tmp_path):
    scored = spark.createDataFrame([(f"b{i:03d}", float(i * 37 % 100) / 7) for i in range(300)], "brand string, quality_score double")
    writers.write_brand_stats(scored.repartition(5), str(tmp_path / "s"))
    rows = readers.read_ordered(spark, str(tmp_path / "s"), "brand string, quality_score double").orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(1, 301))
    assert [(r["brand"], r["quality_score"]) for r in rows] == sorted(((r["brand"], r["quality_score"]) for r in scored.collect()), key=lambda x: (-x[1], x[0]))


def test_read_ids(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a \n\nb\na\n\t\n b c \n")
    assert sorted(r[0] for r in readers.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b", "b c"]


def answers(limited=()):
    def process(rows):
        error = F.when(F.col("example_id").isin(list(limited) or ["-"]), "Error 429: rate limit reached")
        return rows.select("example_id", F.upper("text").alias("reply"), error.cast("string").alias("api_error"))

    return process


def stored(spark, path):
    return sorted((r["example_id"], r["reply"]) for r in spark.read.parquet(path).collect())


def test_append_returns_what_waits(spark, tmp_path):
    inputs = spark.createDataFrame([(c, c) for c in "abcd"], "example_id string, text string")
    out = str(tmp_path / "out")
    assert [r[0] for r in resume.append_results(inputs, answers("b"), out).collect()] == ["b"]
    assert resume.append_results(inputs, answers(), out).isEmpty()
    assert resume.append_results(inputs, answers(), out).isEmpty()
    assert stored(spark, out) == [(c, c.upper()) for c in "abcd"]


def test_rate_limited_rows_come_again_without_new_files(spark, tmp_path):
    schema = "example_id string, text string"
    spark.createDataFrame([(c, c) for c in "abcd"], schema).write.parquet(str(tmp_path / "in"))
    run = lambda process: resume.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), process, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run(answers("bc"))
    assert [k for k, _ in stored(spark, str(tmp_path / "out"))] == ["a", "d"]
    run(answers("c"))
    assert [k for k, _ in stored(spark, str(tmp_path / "out"))] == ["a", "b", "d"]
    run(answers())
    run(answers())
    assert stored(spark, str(tmp_path / "out")) == [(c, c.upper()) for c in "abcd"]


def test_replay_after_the_append_and_before_the_commit(spark, tmp_path):
    """The step fails once its results are stored; the stream hands the batch out again."""
    schema = "example_id string, text string"
    spark.createDataFrame([(c, c) for c in "abc"], schema).write.parquet(str(tmp_path / "in"))
    (tmp_path / "blocked").write_text("a file where the folder should be")
    run = lambda waiting: resume.follow(
        spark.readStream.schema(schema).parquet(str(tmp_path / "in")), answers("c"), str(tmp_path / "out"), str(tmp_path / "cp"), waiting=waiting
    )
    with pytest.raises(Exception):
        run(str(tmp_path / "blocked" / "in_a_file")).awaitTermination()
    assert [k for k, _ in stored(spark, str(tmp_path / "out"))] == ["a", "b"]
    run(str(tmp_path / "waiting")).awaitTermination()
    assert [k for k, _ in stored(spark, str(tmp_path / "out"))] == ["a", "b"]
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "waiting")).select("example_id").collect()] == ["c"]


def test_context_in_parts(spark):
    turns = spark.createDataFrame(
        [("a", n, f"t{n}", "customer" if n % 2 else "brand") for n in range(1, 9)] + [("b", 1, "alone", "customer"), ("c", 1, "no", "brand")],
        "conversation_id string, turn_number int, text string, speaker string",
    )
    chosen = spark.createDataFrame([("a", 7), ("b", 1)], "conversation_id string, turn_number int")
    rows = {(r[0], r[1]): tuple(r[2:]) for r in sampling.previous_turns(turns, chosen, max_turns_per_row=4).collect()}
    assert rows == {
        ("a", 0): (["t1", "t2", "t3", "t4"], ["customer", "brand"] * 2, "t8"),
        ("a", 1): (["t5", "t6"], ["customer", "brand"], None),
        ("b", 0): ([], [], None),
    }


def test_word_lists_are_lists():
    with pytest.raises(TypeError):
        sqltext.any_of("c", "hat")
