"""Feature copies and what they were made of, pruned folders, sketches, co-located token losses."""

import time

import pytest
from pyspark.sql import functions as F
from sheafwork.operators import metrics, stats
from sheafwork.plans.queries.tables import multi_class_training
from sheafwork.sources import features, tables


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_same_columns_over_other_data(spark, tmp_path):
    source, root = f"{tmp_path}/source", f"{tmp_path}/root"

    def write(value):
        spark.createDataFrame([(value,)], "title string").write.mode("overwrite").parquet(source)

    def copy(**options):
        return features.materialize_features(spark.read.schema("title string").parquet(source), root, "k", **options)

    write("one")
    assert copy().first()[0] == "one"
    first = copy().inputFiles()
    assert copy().inputFiles() == first
    time.sleep(1.1)
    write("two")
    with pytest.raises(ValueError, match="other sources"):
        copy()
    assert copy(stale="rewrite").first()[0] == "two" and copy().first()[0] == "two"
    with pytest.raises(ValueError):
        copy(arguments={"max_len": 3})
    assert copy(overwrite=True).inputFiles() != first


def test_what_is_not_committed_is_not_read(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    def cached():
        return features.materialize_features(build, f"{tmp_path}", "k", sources=[], arguments={"n": 3}, spark=spark)

    spark.range(9).write.parquet(f"{tmp_path}/k/copy-half")
    assert cached().count() == 3 and cached().count() == 3 and made == [1]
    with pytest.raises(ValueError):
        features.materialize_features(build, f"{tmp_path}", "k")


def test_folders_are_pruned(spark, tmp_path):
    tasks = [r["task"] for r in multi_class_training(spark).collect()] + ["other", None]
    rows = spark.createDataFrame([(i, t, s) for i, t in enumerate(tasks) for s in ("train", "test", None)], "id int, task string, split string")
    features.write_features(rows, f"{tmp_path}/t", ["task", "split"])
    stored = spark.read.schema(rows.schema).parquet(f"{tmp_path}/t")
    one = tables.scan_split(stored, tasks[0], "train")
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(task" in plan_of(one) and "PushedFilters: []" in plan_of(one)
    listed = multi_class_training(spark)
    twice = tables.scan_listed(stored, listed.union(listed))
    assert sorted(r["task"] for r in twice.collect()) == sorted(tasks[:-2])
    # The given catalog is a local table; stored, its filter reaches the folders while the query runs.
    listed.withColumn("kind", F.lit("x")).write.parquet(f"{tmp_path}/catalog")
    pruned = tables.scan_listed(stored, spark.read.parquet(f"{tmp_path}/catalog").where("kind = 'x'"))
    assert "dynamicpruning" in plan_of(pruned).lower() and pruned.count() == len(tasks) - 2


def test_sketches(spark):
    rows = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("n"), (F.col("id") % 5).alias("part"))
    for n_rows, slack in ((4_000, 0.0), (60_000, 0.004)):
        some = rows.where(F.col("n") < n_rows)
        parts = stats.length_sketches(some, groups=["part"])
        merged = stats.sketched_percentiles(stats.merge_sketches(parts)).collect()
        lengths = sorted(r["n"] for r in some.collect())
        got = {r["statistic"]: r["value"] for r in merged}
        assert got["shortest"] == lengths[0] and got["longest"] == lengths[-1]
        for p in stats.PERCENTILES:
            below = sum(x <= got[f"p{p}"] for x in lengths) / len(lengths)
            assert abs(below - p / 100) <= slack + 1 / len(lengths)


def test_sketches_without_rows(spark):
    none = spark.createDataFrame([], "n int, part int")
    assert stats.sketched_percentiles(stats.length_sketches(none)).count() == 0
    nulls = spark.createDataFrame([(None, 1), (4, 2)], "n int, part int")
    got = stats.sketched_percentiles(stats.length_sketches(nulls, groups=["part"]), groups=["part"]).collect()
    assert {r["part"] for r in got} == {2} and {r["value"] for r in got} == {4.0}


def test_token_losses_meet_by_position(spark, tmp_path):
    n = 8064
    logits = spark.range(n).select(F.lit(1).alias("example_id"), F.col("id").cast("int").alias("pos"), F.array(F.lit(0.0), F.col("id") * 0.001).alias("logits"))
    labels = spark.range(1).select(F.lit(1).alias("example_id"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i % 3 == 0, -100).otherwise(i % 2)).alias("labels"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        losses = metrics.token_losses(logits, labels)
        spread = losses.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(spread) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in spread) == losses.count()
        assert max(r["count"] for r in spread) < losses.count() / 2
        for name, table in (("logits_in_buckets", logits), ("targets_in_buckets", metrics.token_targets(labels))):
            table.write.bucketBy(4, "example_id", "pos").option("path", f"{tmp_path}/{name}").mode("overwrite").saveAsTable(name)
        stored = metrics.token_losses(spark.table("logits_in_buckets"), spark.table("targets_in_buckets"))
        assert "Exchange" not in plan_of(stored)
        assert stored.agg(F.sum("loss")).first()[0] == pytest.approx(losses.agg(F.sum("loss")).first()[0])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for name in ("logits_in_buckets", "targets_in_buckets"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
