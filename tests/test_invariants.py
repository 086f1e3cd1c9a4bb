"""Properties that hold for every row of the given tables."""

import pytest
from pyspark.sql import functions as F

from sheafwork.functions import arrays
from sheafwork.functions.text import words
from sheafwork.operators import encoding, sampling
from sheafwork.operators.encoding import PAD
from sheafwork.plans import builders, corpus


@pytest.fixture(scope="module")
def vocab(spark, sf_dir):
    return spark.createDataFrame(corpus.vocabulary(spark, sf_dir).toArrow())


def test_clm_rows(spark, sf_dir, vocab):
    """Rows have one length, the mask counts the real ids, and pads stand where it is 0."""
    table = builders.build_clm_table(corpus.summaries(spark, sf_dir), vocab, 256, 64)
    pairs = corpus.summaries(spark, sf_dir).where("text <> '' AND summary <> ''")
    real = pairs.select(
        "example_id",
        (
            F.least(F.size(words(F.concat(F.lit("  "), "title", F.lit(" "), "text"))), F.lit(255))
            + 1
            + F.least(F.size(words(F.col("summary"))), F.lit(64))
        ).alias("real"),
    )
    ones = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    padded = F.forall(F.arrays_zip("input_ids", "attention_mask"), lambda c: (c["attention_mask"] == 1) | (c["input_ids"] == PAD))
    bad = table.join(real, "example_id").where(
        (F.size("input_ids") != 320) | (F.size("attention_mask") != 320) | (ones != F.col("real")) | ~padded
    )
    assert table.count() == real.count() > 0 and bad.count() == 0


def test_decode_returns_known_tokens(spark, sf_dir, vocab):
    rows = corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("example_id"), words(F.col("text")).alias("tokens"))
    codec = encoding.load_codec(vocab)
    back = rows.withColumn("ids", codec.encode(F.col("tokens"))).withColumn("back", codec.decode(F.col("ids")))
    known = back.where(~F.array_contains("ids", encoding.UNK))
    assert known.count() > 0 and known.where(F.col("back") != F.col("tokens")).count() == 0


def test_only_the_head_is_broadcast(vocab):
    codec = encoding.load_codec(vocab, head_rows=10)
    assert codec.head.value.num_rows == 10 and codec.tail.count() == vocab.count() - 10
    with pytest.raises(ValueError):
        codec.encode(F.col("tokens"))
    assert encoding.load_codec(vocab).tail is None


@pytest.mark.parametrize("head", [0, 1000])
def test_heads_of_any_size_give_equal_results(spark, sf_dir, vocab, head):
    rows = corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("example_id"), words(F.col("text")).alias("tokens"))
    unknown = vocab.where("id % 7 != 6")
    want = encoding.decode(encoding.encode(rows, unknown, {"tokens": "ids"}), unknown, {"ids": "text"})
    got = encoding.decode(encoding.encode(rows, unknown, {"tokens": "ids"}, head_rows=head), unknown, {"ids": "text"}, head_rows=head)
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_without_a_tail_nothing_is_shuffled(spark, sf_dir, vocab):
    rows = corpus.documents(spark, sf_dir).select(words(F.col("text")).alias("tokens"))
    plan = encoding.encode(rows, vocab, {"tokens": "ids"})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_long_tokens_stay_out_of_the_head(spark):
    vocab = spark.createDataFrame([("x" * 500, 5), ("a", 6)], "token string, id int")
    codec = encoding.load_codec(vocab)
    assert codec.head.value.num_rows == 1
    rows = spark.createDataFrame([(["a", "x" * 500, "?"],)], "tokens array<string>")
    assert encoding.encode(rows, codec, {"tokens": "ids"}).first()["ids"] == [6, 5, encoding.UNK]


def test_multi_hot_sums_to_the_distinct_labels(spark, sf_dir):
    rows = corpus.multi_labelled(spark, sf_dir)
    total = F.aggregate(arrays.multi_hot(F.col("labels"), 8), F.lit(0.0), lambda a, x: a + x)
    assert rows.where(total != F.size(F.array_distinct("labels"))).count() == 0


@pytest.mark.parametrize("drop_last", [True, False])
def test_shards_have_one_size(spark, sf_dir, drop_last):
    ids = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"))
    placed = sampling.shuffle(ids, 42, total="n_rows")
    even = sampling.assign_shard(sampling.even_shards(placed, 7, drop_last), 7)
    sizes = {r["count"] for r in even.groupBy("shard_id").count().collect()}
    assert len(sizes) == 1


def test_encoding_and_building_do_not_shuffle(spark, sf_dir, vocab):
    rows = corpus.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("example_id"), F.col("source").alias("title"), "text", F.col("lang").alias("summary")
    )
    for table in (builders.build_clm_table(rows, vocab, 64, 8), builders.build_seq2seq_table(rows, vocab)):
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
