import pytest
from pyspark.sql import functions as F

from sheafwork.functions import text as tx
from sheafwork.operators import filters
from sheafwork.sources import catalog, features, tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "name, style",
    [
        ("google/mt5-small", "mt5"),
        ("t5-large", "t5"),
        ("bigscience/T0_3B", "gpt"),
        ("facebook/bart-base", "t5"),
        ("gpt2", "gpt"),
    ],
)
def test_prompt_style(spark, name, style):
    assert one(spark, tx.prompt_style(F.lit(name)))["style"] == style


def test_prompt_style_without_case(spark):
    assert one(spark, tx.prompt_style(F.lit("bigscience/T0_3B"), case_sensitive=False))["prefix"] == "summarize: "


def test_choice_prompt(spark):
    prompt = one(spark, tx.choice_prompt(F.lit("C"), F.array(F.lit("x"), F.lit("y"))))
    assert prompt == "Context: C\n\nWhich of the following follow from the context?\n0: x\n1: y\n"


def test_titled_prompt_with_null_title(spark):
    assert one(spark, tx.titled_prompt(F.lit(None).cast("string"), F.lit("body"), F.lit(""))) == "  body"


def test_clean_decoded(spark):
    spaced = F.lit(" I 'm here , you do n't say ! we 've  they 're x 's a ' b . ")
    assert one(spark, tx.clean_decoded(spaced)) == "I'm here, you don't say! we've  they're x's a'b."


def test_split_sentences(spark):
    assert one(spark, tx.split_sentences(F.lit("One. Two!  Three?\nFour\n\n v1.2 "))) == [
        "One.", "Two!", "Three?", "Four", " v1.2 ",
    ]


def test_words_of_blank_text(spark):
    assert one(spark, tx.words(F.lit(" \n\t "))) == []


def test_incomplete_pairs(spark):
    rows = [(1, "a", "b"), (2, None, "b"), (3, "a", ""), (4, " ", "b"), (5, "", "b"), (6, "a", None)]
    df = spark.createDataFrame(rows, "id int, text string, summary string")
    assert [r["id"] for r in filters.drop_incomplete_pairs(df).orderBy("id").collect()] == [1, 4]


def test_batched_map_sees_at_most_one_batch(spark):
    df = spark.range(2500, numPartitions=1)
    sizes = filters.batched_map(df, lambda b: b.iloc[:1].assign(id=len(b)), "id bigint", batch_size=1000)
    assert sorted(r["id"] for r in sizes.collect()) == [500, 1000, 1000]


def test_length_alignment(spark):
    df = spark.createDataFrame([([1] * 8,), ([1] * 9,)], "input_ids array<int>")
    assert [r["aligned"] for r in filters.length_alignment(df, 8).collect()] == [True, False]


def test_catalogs(spark):
    tasks = catalog.task_catalog(spark)
    assert tasks.count() == 8
    counts = {r["task"]: r["n"] for r in catalog.label_catalog(spark).groupBy("task").agg(F.count("*").alias("n")).collect()}
    assert counts == {
        "billsum": 1, "case_hold": 5, "ecthr_a": 10, "ecthr_b": 10,
        "eurlex": 100, "ledgar": 100, "scotus": 13, "unfair_tos": 8,
    }
    allowed = {r["task"] for r in catalog.allowed_tasks(tasks).collect()}
    assert len(allowed) == 7 and "billsum" not in allowed


def test_check_task():
    assert catalog.check_task("eurlex") == "multi_label"
    with pytest.raises(ValueError, match="must be one of"):
        catalog.check_task("billsum")
    assert catalog.check_task("billsum", summarization=True) == "summarization"


def test_cache_key(spark):
    key = features.cache_key(F.lit("train"), F.lit("facebook/opt-125m"), F.lit(512), F.lit("case_hold"))
    assert one(spark, key) == "cached_train_FacebookOptM_512_case_hold"


def test_normalize_split(spark):
    rows = [("train", True, "train"), ("validation", True, "test"), ("validation", False, "validation")]
    df = spark.createDataFrame(rows, "split string, summarization boolean, want string")
    got = df.select(tables.normalize_split(F.col("split"), F.col("summarization")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_scan_split_prunes_partitions(spark, tmp_path):
    rows = [(1, "x", "a", "train"), (2, "y", "b", "train"), (3, "z", "a", "test")]
    df = spark.createDataFrame(rows, "example_id bigint, text string, task string, split string")
    features.write_features(df, str(tmp_path / "t"), ["task", "split"])
    table = tables.read_table(spark, str(tmp_path / "t"), df.schema)
    scan = tables.scan_split(table, "a", "train")
    assert [r["example_id"] for r in scan.collect()] == [1]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(task" in plan


def test_materialize_writes_once(spark, tmp_path):
    first = features.materialize_features(spark.range(3), str(tmp_path), "k")
    assert first.count() == 3
    assert features.materialize_features(spark.range(5), str(tmp_path), "k").count() == 3
    assert features.materialize_features(spark.range(5), str(tmp_path), "k", overwrite=True).count() == 5


def test_materialize_ignores_uncommitted_output(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "k"))
    (tmp_path / "k" / "_SUCCESS").unlink()
    assert features.materialize_features(spark.range(5), str(tmp_path), "k").count() == 5
