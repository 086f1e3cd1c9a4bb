"""Cases that went wrong once."""

import pytest
from pyspark.sql import functions as F
from sheafwork.operators import encoding, rouge, sampling, stats
from sheafwork.sources import features


@pytest.mark.parametrize("bound", [0, 6, encoding.HEAD_ROWS])
def test_repeated_ids_encode_alike(spark, bound):
    rows = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b"]), (1, ["b"]), (2, []), (3, None)], "example_id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "token string, id int")
    got = encoding.encode(rows, vocab, {"tokens": "ids"}, head_rows=bound).select("example_id", "ids").collect()
    want = [(1, [5, 6]), (1, [5, 6]), (1, [6]), (2, []), (3, None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_vocabulary_has_no_global_sort(spark):
    docs = spark.createDataFrame([("b a b c ccc ccd",), ("ccd b",)], "text string")
    vocab = encoding.build_vocab(docs)
    tokens = [r["token"] for r in vocab.where("id >= 5").orderBy("id").collect()]
    assert tokens == ["b", "ccd", "a", "c", "ccc"]
    assert [r["id"] for r in vocab.orderBy("id").collect()] == list(range(10))
    assert "TakeOrderedAndProject" not in vocab._jdf.queryExecution().executedPlan().toString()


def test_lsum_counts_what_its_tokenizer_gives(spark):
    pairs = spark.createDataFrame([(1, "a.\nb", "a.\nb")], "example_id long, pred string, ref string")
    row = rouge.rouge_lsum(pairs, tokenizer=lambda c: F.split(c, ",")).first()
    assert row["rougeLsum_fmeasure"] == 1.0


def test_a_copy_with_other_columns_is_refused(spark, tmp_path):
    features.materialize_features(spark.createDataFrame([("x",)], "title string"), str(tmp_path), "k").count()
    with pytest.raises(ValueError):
        features.materialize_features(spark.createDataFrame([("x",)], "name string"), str(tmp_path), "k")


def test_folders_refuse_empty_values(spark, tmp_path):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, "t")], "id long, title string")
    with pytest.raises(Exception, match="empty text"):
        features.write_features(rows, f"{tmp_path}/t", ["title"])
    features.write_features(rows.where("id > 1"), f"{tmp_path}/t", ["title"])
    back = spark.read.parquet(f"{tmp_path}/t").orderBy("id").collect()
    assert [r["title"] for r in back] == [None, "t"]


def test_truncation_loss_of_empty_texts(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 4)], "g string, n int")
    got = {r["g"]: r["ids_cut"] for r in stats.truncation_loss(rows, 2, groups=["g"]).collect()}
    assert got == {"a": 0.0, "b": 0.5}


def test_text_ids_are_refused_by_name(spark):
    with pytest.raises(TypeError):
        sampling.position_by_id(spark.createDataFrame([("x",)], "example_id string"))
