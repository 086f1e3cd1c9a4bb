import hashlib

import pytest
from pyspark.sql import functions as F

from sheafwork.operators import packing, sampling
from sheafwork.operators.encoding import BOS, EOS, SEP
from sheafwork.operators.choices import choose, explode_choices
from sheafwork.plans import builders


def shards(df, batch=None):
    placed = sampling.assign_shard(df, 4)
    found = {}
    for r in placed.orderBy("shard_id", "local_position").collect():
        found.setdefault(r["shard_id"], []).append(r["example_id"])
    return [found[i] for i in range(4)]


@pytest.fixture(scope="module")
def ten(spark):
    return sampling.position_by_id(spark.range(10).withColumnRenamed("id", "example_id"), total="n_rows")


def test_even_shards(ten):
    assert shards(sampling.even_shards(ten, 4, drop_last=False)) == [[0, 4, 8], [1, 5, 9], [2, 6, 0], [3, 7, 1]]
    assert shards(sampling.even_shards(ten, 4, drop_last=True)) == [[0, 4], [1, 5], [2, 6], [3, 7]]


def test_even_shards_with_fewer_rows_than_shards(spark):
    three = sampling.position_by_id(spark.range(3).withColumnRenamed("id", "example_id"), total="n_rows")
    kept = sampling.even_shards(three, 8, drop_last=False).orderBy("position").collect()
    assert [r["example_id"] for r in kept] == [0, 1, 2, 0, 1, 2, 0, 1]
    assert sampling.even_shards(three, 8, drop_last=True).count() == 0


def test_batches(ten):
    placed = sampling.assign_batch(sampling.assign_shard(sampling.even_shards(ten, 4, False), 4), 2)
    rows = placed.where("shard_id = 0").orderBy("local_position").collect()
    assert [(r["batch_id"], r["example_id"]) for r in rows] == [(0, 0), (0, 4), (1, 8)]
    assert sampling.first_batches(placed, 1).count() == 8
    assert sampling.first_batches(placed, -1).count() == 12


def test_device_batch_size(spark):
    sizes = sampling.device_batch_size(F.lit(70), F.lit(None).cast("int"), F.lit(8))
    assert tuple(spark.range(1).select(sizes.alias("s")).first()["s"]) == (8, 8)


def test_positions_over_skewed_ids(spark):
    """Most ids lie close together, a few far away; a position has no gap anyhow."""
    ids = [*range(1000), *range(10**12, 10**12 + 5), -7]
    df = spark.createDataFrame([(i,) for i in ids], "example_id bigint").repartition(7)
    got = sampling.position_by_id(df).orderBy("example_id").collect()
    assert [(r["example_id"], r["position"]) for r in got] == list(zip(sorted(ids), range(len(ids))))


def test_shuffle_is_the_md5_order(spark):
    df = spark.range(300).withColumnRenamed("id", "example_id")
    got = [r["example_id"] for r in sampling.shuffle(df, 7).orderBy("position").collect()]
    assert got == sorted(range(300), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    again = [r["example_id"] for r in sampling.shuffle(df.repartition(5), 7).orderBy("position").collect()]
    assert again == got


def test_positions_of_no_rows(spark):
    empty = spark.createDataFrame([], "example_id bigint")
    assert sampling.position_by_id(empty, total="n_rows").count() == 0


ROWS = [(1, [1, 2, 3]), (2, [4, 5]), (3, []), (4, [6, 7, 8, 9])]


@pytest.mark.parametrize("block, want", [(4, [[1, 2, 3, 4], [5, 6, 7, 8]]), (16, [list(range(1, 10))]), (1, [[i] for i in range(1, 10)])])
def test_pack_blocks(spark, block, want):
    df = spark.createDataFrame(ROWS, "example_id int, input_ids array<int>").repartition(3)
    one_batch = packing.pack_blocks(df.withColumn("batch_id", F.lit(0)), block)
    assert [r["input_ids"] for r in one_batch.orderBy("block_id").collect()] == want
    stream = packing.pack_blocks_global(df, block)
    assert [r["labels"] for r in stream.orderBy("block_id").collect()] == want


def test_pack_blocks_by_batch(spark):
    df = spark.createDataFrame(ROWS, "example_id int, input_ids array<int>").withColumn("batch_id", F.col("example_id") % 2)
    rows = packing.pack_blocks(df, 4).orderBy("batch_id", "block_id").collect()
    assert [(r["batch_id"], r["input_ids"]) for r in rows] == [(0, [4, 5, 6, 7]), (1, [1, 2, 3])]


def test_packing_regroups_without_a_second_shuffle(spark):
    df = spark.createDataFrame(ROWS, "example_id int, input_ids array<int>").withColumn("batch_id", F.lit(0))
    plan = packing.pack_blocks(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_multiple_choice_table(spark):
    vocab = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "token string, id int")
    df = spark.createDataFrame(
        [(1, "a a a a", ["b", "", "c c c c c"], 2), (2, "", ["a", "b"], 0)],
        "example_id bigint, context string, endings array<string>, label int",
    )
    rows = builders.build_multiple_choice_table(df, vocab, 8).orderBy("example_id").collect()
    assert rows[0]["input_ids"] == [
        [BOS, 5, 5, 5, 5, SEP, 6, EOS], [BOS, 5, 5, 5, 5, SEP, EOS, 0], [BOS, 5, 5, 5, SEP, 7, 7, EOS],
    ]
    assert rows[0]["token_type_ids"][0] == [0, 0, 0, 0, 0, 0, 1, 1]
    assert rows[1]["attention_mask"] == [[1, 1, 1, 1, 0, 0, 0, 0]] * 2
    assert [r["label"] for r in rows] == [2, 0]
    assert explode_choices(df).where("example_id = 1").count() == 3


def test_choose_takes_the_first_maximum(spark):
    rows = [(1, 0, 0.1, 1), (1, 1, 0.9, 1), (1, 2, 0.9, 1)]
    df = spark.createDataFrame(rows, "example_id int, choice int, score double, label int")
    assert choose(df).first()["pred"] == 1


def test_preview_and_lookup(spark):
    df = spark.createDataFrame([(3, [1]), (1, [1, 2]), (2, [])], "example_id int, input_ids array<int>")
    assert [(r["example_id"], r["input_ids_shape"]) for r in sampling.preview(df).collect()] == [(1, 2), (2, 0)]
    assert sampling.lookup(df, 3).count() == 1
